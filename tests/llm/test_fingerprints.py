import hashlib
import random

from rivulet.llm import fingerprints as fp
from tests.llm.helpers import documents, odd_texts, prose


def brute(rows):
    """Edited digests by id, for unique ids."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), edited, following)
    return out


def test_edited_texts_and_likeness(spark):
    rows = [(7 * k + 3, t) for k, t in enumerate(odd_texts() + [prose(k, 120) for k in range(60)])]
    want = brute(rows)
    got = fp.fingerprinted(documents(spark, rows).repartition(6)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, digest, edited, following = want[r.doc_id]
        text = dict(rows)[r.doc_id] or ""
        assert (r.n_chars, r.edited_sha256) == (n, digest)
        assert r.fingerprint == fp.fingerprint(fp.Prefix(text))
        assert r.edited_fingerprint == fp.fingerprint(fp.Prefix(edited))
        assert r.near_next == fp.likeness(r.fingerprint, fp.fingerprint(fp.Prefix(following)))
        common = next((k for k, (a, b) in enumerate(zip(text, edited)) if a != b), min(len(text), len(edited)))
        assert r.common_prefix == common
    plain = [r for r in got if r.doc_id >= 7 * (len(odd_texts()) + 1) + 3]
    assert all(r.near_edited > 0.1 > r.near_next for r in plain)


def test_span_equality_and_extensions_match_strings():
    draw = random.Random(4)
    a, b = ("".join(draw.choices("abé", k=300)) for _ in range(2))
    b = b[:100] + a[50:200] + b[250:]
    left, right = fp.Prefix(a), fp.Prefix(b)
    for _ in range(300):
        i, j, n = draw.randrange(250), draw.randrange(250), draw.randrange(50)
        assert left.equal(i, right, j, n) == (a[i : i + n] == b[j : j + n])
        want = 0
        while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
            want += 1
        assert left.common(i, right, j) == want
    assert left.common(50, right, 100) >= 150


def test_likeness_estimates_common_spans():
    a, b = prose(1, 800), prose(2, 800)
    one, two = fp.fingerprint(fp.Prefix(a + b)), fp.fingerprint(fp.Prefix(a + prose(3, 800)))
    assert 0.1 < fp.likeness(one, two) < 0.6
    assert fp.likeness(one, one) == 1.0
    assert fp.likeness(one, fp.fingerprint(fp.Prefix(prose(4, 800)))) < 0.1
    assert fp.fingerprint(fp.Prefix("")) == fp.EMPTY and fp.likeness(fp.EMPTY, one) == 0.0
    repeated = fp.fingerprint(fp.Prefix("ab" * 5000))
    assert fp.likeness(repeated, repeated) == 1.0


def test_one_row_repeats_nulls_and_no_rows(spark):
    one = fp.fingerprinted(documents(spark, [(5, "abcdef")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1.0
    rows = [(1, "aaaa"), (1, "bbbb"), (None, "cccc"), (None, None), (2, "dddd"), (2, "dddd")]
    docs = documents(spark, rows).selectExpr("*", "1 AS place", "2 AS ahead", "3 AS stand")
    got = fp.fingerprinted(docs).collect()
    # 2 d, 2 d, 1 a, 1 b, null (null), null c, and round to 2 d.
    want = ["dddd", "ddaa", "aabb", "bb", "", "ccdd"]
    assert sorted(r.edited_sha256 for r in got) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in want)
    assert fp.fingerprinted(docs.where("false")).count() == 0
    only_null = fp.fingerprinted(docs.where("doc_id IS NULL"))
    assert only_null.count() == 2
