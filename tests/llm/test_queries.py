"""The registered queries whose result can be said otherwise, over the smallest tables: against SQL, and against the tokenizer's library."""

from pathlib import Path

import duckdb
import public_tokenizers
import pytest
import sentencepiece

from frameloom.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, str(DATA))
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert sorted((tuple(map(str, r)) for r in got.select(*order).collect())) == sorted(tuple(map(str, r)) for r in want.select(*order).fetchall())


def test_counts_of_all_documents(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{DATA}/documents.parquet'").fetchall()
    want = {(i, len(t.encode()), n, n > 4096) for (i, t), n in zip(rows, (len(model.encode(t)) for _, t in rows), strict=True)}
    assert {tuple(r) for r in queries.op12_token_counts(spark, str(DATA)).collect()} == want
