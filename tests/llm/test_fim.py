import hashlib
import re
from collections import Counter

import pytest
from conftest_llm import odd_texts, prose
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frameloom.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = odd_texts() + ["has <P> mark", "<S>", "a <M>", "ends in <", "< P>", "a <", "S> b", "  x y  ", " \t lead", "\x1c\x1d x"] + [prose(i, i) for i in range(1, 60)] + ["a<\nS> <P M>"] * 3


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    n, digest = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc_id, n, "plain", None, None, text), text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    spm = h[3] % 100 < 80
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc_id, n, "spm" if spm else "psm", len(prefix), len(middle), out), text


IDS = [*range(len(TEXTS) - 4), None, None, 3, 3]


def test_texts_match_brute_force_and_come_back(make_docs):
    made = fim.fill_in_middle(make_docs(TEXTS, IDS, extra=True))
    want = [brute(i, t) for i, t in zip(IDS, TEXTS, strict=True)]
    assert Counter(map(tuple, made.collect())) == Counter(row for row, _ in want)
    assert {row[2] for row, _ in want} == {"plain", "psm", "spm"}
    back = fim.restored(made)
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((row[0], text) for row, text in want)


def test_digests(make_docs):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    found = fim.digested(make_docs(TEXTS, IDS, extra=True))
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = Counter((*row[:5], sha(row[5]), sha(text)) for row, text in (brute(i, t) for i, t in zip(IDS, TEXTS, strict=True)))
    assert Counter(map(tuple, found.collect())) == want


@given(st.text("<>PSM \nabé😀", max_size=40), st.integers(0, 10**6))
def test_every_form_gives_the_text_back(text, doc_id):
    for rates in (fim.Rates(100, 0), fim.Rates(100, 100), fim.Rates()):
        made = fim.cut(text, str(doc_id), rates=rates)
        assert fim.restore(made.output, made.form) == text


def test_rates_and_seed(make_docs):
    docs = make_docs([prose(i, 20) for i in range(400)])
    forms = lambda **kw: dict(fim.fill_in_middle(docs, **kw).groupBy("form").count().collect())
    assert forms(rates=fim.Rates(0)) == {"plain": 400} and forms(rates=fim.Rates(100, 0)) == {"psm": 400}
    some = forms()
    assert 160 < some["plain"] < 240 and some["spm"] > 2 * some["psm"]
    assert fim.fill_in_middle(docs, seed=1).select("output").exceptAll(fim.fill_in_middle(docs).select("output")).count() > 100


@pytest.mark.parametrize("call", [fim.fill_in_middle, fim.digested])
def test_an_empty_table(make_docs, call):
    assert call(make_docs(["x"]).where("false")).collect() == []


def test_restoring_nulls(make_docs):
    rows = make_docs([None, "x"]).select(F.col("text").alias("output"), F.lit(None).cast("string").alias("form"))
    assert sorted(r["text"] or "" for r in fim.restored(rows).collect()) == ["", "x"]
