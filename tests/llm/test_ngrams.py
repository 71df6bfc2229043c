import random

import numpy as np
import pytest
import xxhash

from frameloom.llm import ngrams, spotsigs, toxicity


def caches():
    return {"hashes": ngrams._Hashes(), "chains": spotsigs._Hashes(), "counts": toxicity.Counts(["abc ", "word", "x" * 64])}


@pytest.mark.parametrize("name", caches())
def test_word_caches_are_bounded_in_bytes(name):
    cache, rng = caches()[name], random.Random(1)
    for _ in range(2000):
        word = f"{rng.getrandbits(40_000):010000x}"[:10_000]
        assert cache[word] == cache[word]
    assert len(cache) == 0
    cache.bound = 10
    for i in range(100):
        cache["x" * 60 + str(i)]
        assert 0 < len(cache) <= 10


def test_long_words_count_as_others():
    long = "z" * 65
    assert ngrams.word_hashes(f"a {long} b").tolist() == [xxhash.xxh32_intdigest(w) for w in ("a", long, "b")]
    assert np.array_equal(spotsigs.signatures(f"the {long} one"), spotsigs.signatures(f"the {long} one"))
    assert toxicity.Counts(["abc "]).of(f"abc{long} x")[0].tolist() == [0]


def test_long_words_are_no_candidates_but_their_beginnings_are(spark):
    rows = [(True, "vile " + "vile" * 30), (True, "vile " + "vile" * 30), *[(False, "kind word")] * 20]
    parts = toxicity.telling_parts(spark.createDataFrame(rows, "positive boolean, text string"), 2, len(rows))
    assert {"vile", "vil ", "vilevile "} <= set(parts) and max(map(len, parts)) <= 64
