import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import odd_texts, prose

from frameloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=30):
    """rows of (text, lang, source) -> {(lang, source, part, item, value, rank)}, by whole numbers of any size."""
    docs = [((t or "").translate(LOWER), lang or "", source or "") for t, lang, source in rows]
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        found = TERM.findall(text)
        seen[lang].update(set(found))
        counts[lang, source].update(found)
    out = set()
    for lang in seen.keys() | {lang for lang, _ in counts}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        here = {s: c for (k, s), c in counts.items() if k == lang}

        def share(count, kept=kept):
            total = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // total for t in kept}

        p, q = {s: share(c) for s, c in here.items()}, share(sum(here.values(), Counter()))
        for s in here:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in here if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if here[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked[: None if part == "pair" else 50], 1)}
    return out


def result(spark, rows, **kw):
    df = divergence.audit(spark.createDataFrame([(*r, "own", "own", 7) for r in rows], "text string, lang string, source string, part string, term string, n int").repartition(3), **kw)
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(80)] + ["Éa", "日本", "ß", "ÀÉ", "x" * 3000]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "Z", "ä", None, "b"])
        bias = words[:40] if source == "a" else words
        rows.append((" ".join(rng.choice(bias) if rng.random() < 0.9 else rng.choice(bias).upper() + "1" for _ in range(rng.randint(0, 30))), lang, source))
    return rows + [(t, "en", "odd") for t in odd_texts()] + [(None, None, None), ("", "fr", "only"), ("none kept", "fr", "other"), ("", "fr", "third")] + rows[:20]


def test_matches_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[0] == "fr" and r[4] == 0 for r in want)
    assert result(spark, rows) == want


def test_blocks_and_parts_give_the_same(spark, monkeypatch):
    rows = corpus(2)
    monkeypatch.setattr(divergence, "CELLS", 7)
    monkeypatch.setattr(divergence, "MOST_CELLS", 9)
    monkeypatch.setattr(divergence, "PAIRS", 4)
    assert result(spark, rows, least_docs=3) == brute(rows, 3)


def test_over_fifty_terms_and_many_ties(spark):
    rows = [(" ".join(f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)), "en", "a")] * 2 + [("zz yy", "en", "b")] * 2
    want = brute(rows, 2)
    assert sum(r[1] == "a" and r[2] == "term" for r in want) == 50
    assert result(spark, rows, least_docs=2) == want


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [("a b", "en", "s")] * 30, [("", "en", f"s{i}") for i in range(40)]])
def test_empty_and_single(spark, rows):
    assert result(spark, rows) == brute(rows)


def test_terms_of_a_batch():
    texts = ["Aa aA", "", "é", "Zé", "b", "", "x1y", "日本 日本"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    data = divergence.TABLE[np.frombuffer(b"".join(raw), np.uint8)]
    text, start, end = divergence.boundaries(data, offsets)
    found = [(int(i), data[s:e].tobytes().decode()) for i, s, e in zip(text, start, end, strict=True)]
    assert found == [(i, w) for i, t in enumerate(texts) for w in TERM.findall(t.translate(LOWER))]


@pytest.mark.parametrize("hash_of", [lambda b: 0, lambda b: len(b), lambda b: b[0] % 3])
def test_colliding_hashes_are_told_apart(hash_of):
    words = [w.encode() for w in [*prose(1, 300).split(), "q" * 5000, "q" * 4999 + "r", "q" * 5000]]
    data = np.frombuffer(b" ".join(words), np.uint8)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = end - [len(w) for w in words]
    group, firsts = divergence.grouped(data, start, end, hash_of)
    named = [words[firsts[g]] for g in group]
    assert named == words and len(set(group.tolist())) == len(set(words)) == len(firsts)


def test_shares_are_exact():
    rng = random.Random(3)
    for _ in range(300):
        terms = rng.randint(1, 10**9)
        total = rng.randint(0, 2 ** rng.randint(1, 52))
        count = rng.randint(0, total)
        assert divergence.shares(np.array([count]), np.array([total]), terms).tolist() == [1 + 10**9 * (count + 5) // (total + 5 * terms)]
    assert divergence.shares(np.array([7]), 7, 1).tolist() == [1 + 10**9]
