import itertools
import random

from conftest_llm import odd_texts, prose

import corpus_pipeline
from frameloom.llm import common, setlinks, shingles, simhash


def brute_set(text, k=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute(rows, least=0.8):
    sets = {i: brute_set(t) for i, t in rows}
    comp = {i: i for i in sets}

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        if jaccard(sets[a], sets[b]) >= least:
            x, y = sorted((find(a), find(b)))
            comp[y] = x
    return {i: find(i) for i in sets}


def edited(base, edits, seed):
    words, rng = base.split(), random.Random(seed)
    for k in rng.sample(range(len(words)), edits):
        words[k] = f"changed{seed}x{k}"
    return " ".join(words)


def corpus():
    texts = [prose(i, 5 + i % 60) for i in range(60)] + odd_texts()
    for i in range(12):
        base = prose(900 + i, 125 + i)
        texts += [base, base + " " + prose(950 + i, 12 + i)] + [edited(base, n, 10 * i + n) for n in range(1, 6)]  # from well above the bound to below
    passage = prose(77, 60)
    return texts + [f"{prose(2000 + i, 15)} {passage} {prose(3000 + i, 15)}" for i in range(40)]


def test_matches_brute_force(make_docs, monkeypatch):
    texts = corpus()
    ids = random.Random(0).sample(range(1000), len(texts))
    want = brute(list(zip(ids, texts, strict=True)))
    for sample, rows, many in ((8000, 1000, 64), (20, 2, 1), (8000, 1000, 3)):
        monkeypatch.setattr(setlinks, "SAMPLE", sample)
        monkeypatch.setattr(setlinks, "LIST_ROWS", rows)
        monkeypatch.setattr(setlinks, "MANY", many)
        monkeypatch.setattr(setlinks, "SOME", min(many, 16))
        assert dict(shingles.near_duplicates(make_docs(texts, ids, extra=True)).collect()) == want
    sets = [brute_set(t) for t in texts]
    assert sum(0.8 <= jaccard(a, b) < 0.95 for a, b in itertools.combinations(sets, 2)) > 10


def test_the_stage_drops_near_copies_of_a_likeness_of_four_fifths(spark, make_docs):
    base = [prose(i, 200) for i in range(8)]
    texts = base + [edited(t, 3, i) for i, t in enumerate(base)]
    assert all(0.8 <= jaccard(brute_set(a), brute_set(b)) < 0.9 for a, b in zip(texts[:8], texts[8:], strict=True))
    assert sorted(r["doc_id"] for r in corpus_pipeline.distinct(spark, make_docs(texts), "").collect()) == list(range(8))


def test_empty_table_and_null_ids(make_docs):
    assert shingles.near_duplicates(make_docs(["a"]).where("doc_id < 0")).count() == 0
    assert {r["component_id"] for r in shingles.near_duplicates(make_docs(["same text here"] * 3, [None, 4, 6])).collect()} == {4}


def test_unlike_sets_that_share_half_a_digest_are_told_apart(make_docs, monkeypatch):
    texts = [prose(i, 30) for i in range(6)] + [prose(0, 30)]
    digest = setlinks.digest
    monkeypatch.setattr(setlinks, "digest", lambda sigs: (digest(sigs)[1], 7 if len(sigs) else 0))
    named = setlinks._name(shingles.shingle_set(texts[0].encode()), ())
    assert named[0] == 7 and setlinks._name(shingles.shingle_set(texts[0].encode()), {7})[0] != 7


def test_repeated_rows_and_a_chain_of_near_copies(make_docs):
    words = prose(5, 400).split()
    texts = [" ".join([*(f"new{j}" for j in range(4 * i)), *words[4 * i :]]) for i in range(16)]  # each near the next, the ends far apart
    want = brute(list(enumerate(texts)))
    assert jaccard(brute_set(texts[0]), brute_set(texts[15])) < 0.8 and set(want.values()) == {0}
    rows = shingles.near_duplicates(make_docs([*texts, *texts], [*range(16), *range(16)])).collect()
    assert len(rows) == 32 and {r["component_id"] for r in rows} == {0}


def test_lists_are_built_and_searched_in_rounds(make_docs, monkeypatch):
    texts, tags = corpus()[:90], []
    materialize = setlinks.materialize
    monkeypatch.setattr(setlinks, "ROUND_SETS", 30)
    monkeypatch.setattr(setlinks, "ROUND_ROWS", 40)
    monkeypatch.setattr(setlinks, "materialize", lambda df, tag, *a: tags.append(tag) or materialize(df, tag, *a))
    assert dict(shingles.near_duplicates(make_docs(texts)).collect()) == brute(list(enumerate(texts)))
    assert tags.count("met") > 1 and tags.count("crossing") > 1


def test_ball_hashing_links_come_first_and_rounds_lose_nothing(make_docs, monkeypatch):
    base = prose(3, 400)
    texts = [prose(i, 40) for i in range(20)] + [base, base + " end", edited(base, 1, 1), edited(base, 6, 2)]
    want = brute(list(enumerate(texts)))
    tables = []
    materialize = common.materialize
    monkeypatch.setattr(setlinks, "materialize", lambda df, tag, *a: tables.append((tag, out := materialize(df, tag, *a))) or out)
    monkeypatch.setattr(setlinks, "release", lambda *_: None)
    for per_round in (1 << 16, 8):
        monkeypatch.setattr(setlinks, "ROUND_SETS", per_round)
        monkeypatch.setattr(setlinks, "ROUND_ROWS", per_round)
        tables.clear()
        assert dict(shingles.near_duplicates(make_docs(texts)).collect()) == want
        prints = {digest: simhash.majority(shingles.shingle_set(t.encode())) for t in texts for digest in [setlinks.digest(shingles.shingle_set(t.encode()))[1]]}
        near = {(max(a, b), min(a, b)) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS}
        alike = {(r["hi"], r["lo"]) for tag, df in tables if tag == "alike" for r in df.collect()}
        assert near and alike <= near and {x for p in alike for x in p} == {x for p in near for x in p}
        assert sum(tag == "met" for tag, _ in tables) == (3 if per_round == 8 else 1)
