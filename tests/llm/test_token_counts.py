import public_tokenizers
import pytest
import sentencepiece
from conftest_llm import odd_texts, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from frameloom.llm import token_counts
from frameloom.llm.token_counts import Counter

JSON = "byte_bpe_50k.json"


def library(texts, name=token_counts.MODEL):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        return [len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False)) for t in texts]
    return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for t in texts])]


def got(df):
    assert df.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    return sorted(map(tuple, df.collect()), key=str)


def wanted(ids, texts, name=token_counts.MODEL, limit=4096):
    return sorted(((i, len((t or "").encode()), n, n > limit) for i, t, n in zip(ids, texts, library(texts, name), strict=True)), key=str)


TEXTS = odd_texts() + ["<s> x </s> <unk>", "a b", "a▁b", "▁▁a", "  a", "﻿x​　y ﬁ \x00", "x" * 4096, "Hello<|endoftext|>"] + [prose(i, 60) for i in range(8)]


@pytest.mark.parametrize("sent", [0, 10**6])
@pytest.mark.parametrize("name", [token_counts.MODEL, JSON])
def test_counts_are_the_librarys(make_docs, tmp_path, name, sent):
    texts, ids = TEXTS + TEXTS[:9], [*range(len(TEXTS)), 0, 1, 500, None, None, 501, 502, 503, 504]
    found = token_counts.token_counts(make_docs(texts, ids, extra=True), str(tmp_path / "c"), path=public_tokenizers.path(name), sent=sent)
    assert got(found) == wanted(ids, texts, name)
    assert any(r[3] for r in got(found))


@pytest.mark.parametrize("sent", [0, 10**6])
def test_only_distinct_misses_are_encoded_and_appended(spark, make_docs, tmp_path, sent):
    at = str(tmp_path / "c")
    first = make_docs(["one text", "one text", "two▁texts", None], [1, 2, 3, 4])
    token_counts.token_counts(first, at, sent=sent).collect()
    assert spark.read.parquet(at).count() == 3
    more = make_docs(["one text", "two texts", "three", "", "three"], [5, 6, 7, 8, 9])
    assert got(token_counts.token_counts(more, at, sent=sent)) == wanted([5, 6, 7, 8, 9], ["one text", "two texts", "three", "", "three"])
    stored = spark.read.parquet(at)
    assert stored.count() == stored.select("content_sha256").distinct().count() == 4
    token_counts.token_counts(more, at, path=public_tokenizers.path(JSON), sent=sent).collect()
    assert {r["count"] for r in spark.read.parquet(at).groupBy("tokenizer_sha256").count().collect()} == {4}


def test_what_the_cache_holds_is_believed_and_may_repeat(spark, make_docs, tmp_path):
    at, counter = str(tmp_path / "c"), Counter(public_tokenizers.path(token_counts.MODEL))
    spark.createDataFrame([("known",)] * 2, "t string").select(F.lit(counter.digest()).alias("tokenizer_sha256"), F.unhex(F.sha2("t", 256)).alias("content_sha256"), F.lit(5000).cast("long").alias("n_tokens")).write.partitionBy("tokenizer_sha256").parquet(at)
    assert got(token_counts.token_counts(make_docs(["known", "new"], [1, 2]), at)) == [(1, 5, 5000, True), (2, 3, library(["new"])[0], False)]


def test_an_empty_table(make_docs, tmp_path):
    docs = make_docs(["x"]).where("false")
    for _ in range(2):
        assert got(token_counts.token_counts(docs, str(tmp_path / "c"))) == []


def test_versions_have_digests_of_their_own():
    digests = {Counter(public_tokenizers.path(n)).digest() for n in (token_counts.MODEL, JSON, "word_bpe_49k.json")}
    assert len(digests) == 3 and all(len(d) == 64 for d in digests)
    with pytest.raises(ValueError, match="neither"):
        Counter("x.txt")
