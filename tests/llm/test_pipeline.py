import random
import zlib

import pytest
from conftest_llm import odd_texts, prose
from pyspark.sql import functions as F
from test_secrets import brute as brute_spans
from test_shingles import brute as brute_components

import corpus_pipeline
from frameloom.llm import common, langid, quality, queries, secrets


def corpus(make_docs):
    rng = random.Random(11)
    texts = [prose(i, rng.randint(20, 90)) for i in range(120)]
    texts += [texts[5], texts[5] + " more", texts[6].replace(" ", "\n")] + [f"{prose(500 + i, 12)} token=abcdefgh{i} {prose(600 + i, 12)}" for i in range(6)]
    texts += odd_texts() + ["12345 !!", "... --- ..."]
    return texts, make_docs(texts, lang=["en" if t and t.isascii() else None for t in texts])


@pytest.fixture
def sf_dir(spark, tmp_path, make_docs):
    texts, docs = corpus(make_docs)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 9 != 0), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), texts


def test_stages_one_by_one(spark, sf_dir):
    at, texts = sf_dir
    docs = common.documents(spark, at)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs, docs.columns
        docs = common.materialize(stage(spark, docs, at), "test")
        if name != "packing":
            assert docs.columns == columns and docs.select("doc_id").distinct().count() == docs.count()
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        given = {r["doc_id"]: r for r in before.collect()}
        if name == "language":
            model = langid.train(before)
            least = langid.least_likeness(before, model)
            sizes = {i: langid.n_grams(r["text"]) for i, r in given.items()}
            asked = {m: spark.range(1).select(least(F.lit(m)).alias("x")).first()["x"] for m in set(sizes.values()) if m}
            cos = {i: float((model[1] @ v).max()) if (v := langid.profile(r["text"])) is not None else -1 for i, r in given.items()}
            assert set(kept[name]) == {i for i, c in cos.items() if c >= asked.get(sizes[i], 2)}
            assert not any(kept[name].get(i) for i, t in enumerate(texts) if not any(c.isalpha() for c in t or ""))
        elif name == "quality":
            w, b = quality.train(before, common.documents(spark, at, "labels"))
            score = {i: b + float(w[v[0]].dot(v[1])) if len((v := quality.vector(r["text"]))[0]) else b for i, r in given.items()}
            assert set(kept[name]) == {i for i, s in score.items() if s >= 0} or all(abs(s) < 1e-4 for i, s in score.items() if (s >= 0) != (i in kept[name]))
        elif name == "near duplicates":
            want = brute_components([(i, r["text"]) for i, r in given.items()])
            assert set(kept[name]) == set(want.values()) and len(kept[name]) < len(given)
            assert all(kept[name][i] == given[i] for i in kept[name])
        elif name == "secrets":
            assert set(kept[name]) == set(given)
            for i, r in kept[name].items():
                spans = [tuple(map(int, s.split(":")[1:])) for s in brute_spans(given[i]["text"]).split(",") if s]
                text, at_ = "", 0
                for s, e in spans:
                    text, at_ = text + given[i]["text"][at_:s] + "[SECRET]", e
                assert r["text"] == text + given[i]["text"][at_:] and r["n_chars"] == len(r["text"])
        else:
            assert {r["doc_id"] for r in docs.collect()} == set(given)


def test_run_is_the_stages_in_turn(spark, sf_dir):
    at, _ = sf_dir
    docs = common.documents(spark, at)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, at), "test")
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, at).collect()))


def test_columns_with_clashing_names_pass_through(spark, sf_dir):
    at, _ = sf_dir
    docs = common.documents(spark, at)
    for name in ("_lang", "_SCORE", "_kept", "_blob", "_spans", "score", "spans", "fp", "n", "blob_id", "rank"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    plain = common.documents(spark, at)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs, plain = (common.materialize(stage(spark, d, at), "test") for d in (docs, plain))
        if name != "packing":
            assert docs.columns == before
        assert sorted(map(tuple, docs.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))


def test_empty_documents(spark, tmp_path, make_docs):
    make_docs(["a"]).where("doc_id < 0").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    assert sorted({int(n[2:].split("_")[0]) for n in queries.QUERIES}) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_folds(spark):
    df = spark.createDataFrame([(i,) for i in (0, 7, 123456, -5)], "doc_id long")
    assert {r["doc_id"]: r["f"] for r in df.select("doc_id", common.fold("doc_id", 5).alias("f")).collect()} == {i: zlib.crc32(str(i).encode()) % 5 for i in (0, 7, 123456, -5)}
    assert spark.range(1).select(common.fold(F.lit(None).cast("long"), 4).alias("f")).first()["f"] == 0
    assert secrets.RULE_VERSION
