import numpy as np
import pyarrow as pa

from rivulet.llm import words
from tests.llm.helpers import odd_texts, tokens


def test_words_and_hashes_match_plain_python():
    texts = odd_texts()
    seen, got = {}, []
    for low, high, data, offsets in words.slices(pa.array(texts), size=100):
        hashes, first = words.word_hashes(data, offsets)
        got += [hashes[first[k] : first[k + 1]].tolist() for k in range(high - low)]
    assert [len(g) for g in got] == [len(tokens(t)) for t in texts]
    for hashed, plain in zip(got, map(tokens, texts)):
        for h, word in zip(hashed, plain):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_chunked_and_sliced_columns():
    column = pa.chunked_array([pa.array(["a b", None]), pa.array(["c"])]).slice(1)
    assert [len(data) for _, _, data, _ in words.slices(column)] == [1]
    assert list(words.slices(pa.array([], pa.string()))) == []


def test_shingles_of_short_sequences():
    own = np.array([5, 6], dtype=np.uint64)
    assert len(words.shingles(own, 5)) == 1
    assert len(words.shingles(own[:0], 5)) == 0
    assert words.shingles(own, 2)[0] != words.shingles(own[::-1].copy(), 2)[0]
