"""Token counts by a digest cache: each distinct text is encoded once for each version of a tokenizer, ever.

A text's digest is that of its normal form, in which texts that the tokenizer can't tell apart are the same; a tokenizer's
is that of its file, its library's version and the options that it is called with. Digests are joined to the counts that
earlier runs have stored; what the cache lacks is brought together by digest, encoded, and appended.
"""

from __future__ import annotations

import hashlib
from functools import cache
from importlib.metadata import version
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from frameloom.llm.common import map_batches, materialize, release, rows_of

MODEL = "piece_bpe_32k.model"
#: What the cache lacks is sent to all executors if it is so many digests at most (40 bytes each); texts that it holds then stay where they are read.
SENT_DIGESTS = 200_000
CACHE = "tokenizer_sha256 string, content_sha256 binary, n_tokens long"


class Counter:
    """A tokenizer's file, with the library that its name asks for: sentencepiece for .model, tokenizers for .json. No special tokens are added."""

    def __init__(self, path: str):
        if not path.endswith((".model", ".json")):
            raise ValueError(f"neither a .model nor a .json file: {path}")
        self.path, self.library = path, "sentencepiece" if path.endswith(".model") else "tokenizers"

    def digest(self) -> str:
        """Hex SHA-256 of the file, the library's version and the normal form."""
        return hashlib.sha256(Path(self.path).read_bytes() + f"\n{self.library} {version(self.library)} {self._blank()}".encode()).hexdigest()

    def _blank(self) -> str:
        """U+2581 where the model reads it as a blank."""
        return "▁" if self.library == "sentencepiece" else ""

    def normal(self, text: Column) -> Column:
        """The text that stands for all that the tokenizer gives the same pieces: null as empty, and U+2581 as the blank that it means to sentencepiece's models."""
        text = F.coalesce(text, F.lit(""))
        return F.translate(text, self._blank(), " ") if self._blank() else text

    def counts(self, texts: list[str]) -> list[int]:
        """One text at a time, so that only one text's ids are held."""
        if self.library == "sentencepiece":
            return [len(_pieces(self.path).encode(t)) for t in texts]
        return [len(_bpe(self.path).encode(t, add_special_tokens=False)) for t in texts]


@cache
def _pieces(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def _bpe(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def _lacking(named: DataFrame, digests: DataFrame, known: DataFrame, sent: int) -> tuple[DataFrame, DataFrame]:
    """(distinct (content_sha256, text) that known lacks; the table of their digests).

    Copies are brought down to one in each task before they are dealt out. Of many missing digests, the texts are joined after
    that, on the same partitions; a few are sent to the texts instead.
    """
    missing = materialize(digests.select("content_sha256").distinct().join(known, "content_sha256", "left_anti"), "missing")
    if rows_of(missing) <= sent:
        some = named.join(F.broadcast(missing), "content_sha256", "left_semi")
        return some.groupBy("content_sha256").agg(F.first("text").alias("text")), missing
    return named.groupBy("content_sha256").agg(F.first("text").alias("text")).join(missing.hint("merge"), "content_sha256", "left_semi"), missing


def token_counts(docs: DataFrame, cache_path: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 4096, sent: int = SENT_DIGESTS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs; counts come from the cache at cache_path, which gets what it lacks.

    n_bytes: of the text's UTF-8. n_tokens: as the tokenizer's library gives them for the whole text, special strings handled
    as its default. over_limit: more than limit. Null text counts as empty and has none. Rows that repeat stay, and equal texts
    are encoded once. Null ids are reported like others. Other columns are not read. An empty table gives no rows.

    The cache has a folder for each tokenizer's digest. A run that is broken off has appended all of its counts or none; two runs
    at once may both append a text's count, which is the same.
    """
    spark, counter = docs.sparkSession, Counter(path or public_tokenizers.path(MODEL))
    tokenizer = counter.digest()
    content = F.unhex(F.sha2(counter.normal(F.col("text")), 256)).alias("content_sha256")
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", "text", content)
    digests = materialize(named.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "content_sha256"), "digests")
    texts, missing = _lacking(named, digests, _stored(spark, cache_path, tokenizer).select("content_sha256").distinct(), sent)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = counter.counts([t or "" for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["content_sha256", "n_tokens"])

    counted = map_batches(texts, run, "content_sha256 binary, n_tokens long")
    counted.select(F.lit(tokenizer).alias("tokenizer_sha256"), "content_sha256", "n_tokens").write.mode("append").partitionBy("tokenizer_sha256").parquet(cache_path)
    release(missing)
    # one row for each digest, in a table of its own, so that a join with many copies of one text can be split
    needed = digests.select("content_sha256").distinct().join(_stored(spark, cache_path, tokenizer), "content_sha256").groupBy("content_sha256").agg(F.max("n_tokens").alias("n_tokens"))
    found = materialize(needed, "counts")
    return digests.join(found, "content_sha256").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _stored(spark, cache_path: str, tokenizer: str) -> DataFrame:
    """(content_sha256, n_tokens) that the cache has for the tokenizer."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(cache_path)
    there = at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at)
    stored = spark.read.schema(CACHE).parquet(cache_path) if there else spark.createDataFrame([], CACHE)
    return stored.where(F.col("tokenizer_sha256") == tokenizer).select("content_sha256", "n_tokens")
