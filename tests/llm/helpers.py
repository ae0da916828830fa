"""Small fixtures for the corpus operators."""

import random
import re

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"w{k:03d}" for k in range(400)]


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def sentence(draw, n):
    return " ".join(draw.choices(VOCABULARY, k=n))


def prose(seed, n):
    """Text of n words in sentences of 8 to 14 words, some of them ending a line."""
    draw, out = random.Random(seed), []
    while n > 0:
        size = min(n, draw.randint(8, 14))
        out.append(sentence(draw, size).capitalize() + "." + draw.choice([" ", "\n"]))
        n -= size
    return "".join(out).strip()


def documents(spark, rows):
    """Rows of (doc_id, text[, source]) as a documents table."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def odd_texts():
    """Null, empty, blank, one word, other alphabets, a very long word and a very long text."""
    return [
        None, "", " \t\n\r ", "word", "Éa ÉA éa", "日本語 のテキスト 日本語", "x" * 50_000, prose(1, 20_000),
        "a b\x0bc\x0cd\re", "tab\tand\nline\n\n", "\U0001f600 emoji \U0001f600", "A b", "a B",
    ]
