import math
from collections import Counter

import numpy as np
import public_tokenizers
from conftest_llm import odd_texts, prose
from hypothesis import given, settings
from hypothesis import strategies as st

import frameloom.llm.sentencepiece as s

PATH = public_tokenizers.path(s.MODEL)


def all_ways(word, weight):
    """{tuple of pieces: weight} of every segmentation, by recursion."""
    if not word:
        return {(): 1.0}
    out = {}
    for k in range(1, len(word) + 1):
        if (w := weight.get(word[:k])) is not None:
            for rest, r in all_ways(word[k:], weight).items():
                out[(word[:k], *rest)] = w * r
    return out


def test_samples_follow_the_lattice_weights():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    normal = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    weight = {sp.id_to_piece(i): (n + s.RANK_OFFSET) ** -s.ALPHA for n, i in enumerate(normal)}
    ways = all_ways("▁nation", weight)
    total = sum(ways.values())
    n = 40_000
    got = Counter(tuple(sp.id_to_piece(int(i)) for i in ids) for ids in s.sample(["nation"] * n, s.row_keys(list(range(n)), 1), PATH))
    assert set(got) <= set(ways)
    for way, w in ways.items():
        p = w / total
        assert abs(got[way] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_lossless(text):
    (ids,) = s.sample([text], [7], PATH)
    assert s.decode(ids, PATH) == text.replace("▁", " ")


def test_the_library_decodes_the_ids_alike():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [t for t in odd_texts() if t and "▁" not in t] + [prose(i, 50) for i in range(20)]
    for t, ids in zip(texts, s.sample(texts, s.row_keys(list(range(len(texts))), 3), PATH), strict=True):
        assert sp.decode(ids.tolist()) == t


def test_rows_keep_their_samples_however_they_are_dealt(make_docs):
    texts = odd_texts() + [prose(i, 120) for i in range(40)]
    docs = make_docs(texts, extra=True)
    a = {r["doc_id"]: r["ids"] for r in s.encode(docs).collect()}
    b = {r["doc_id"]: r["ids"] for r in s.encode(docs.repartition(7)).collect()}
    assert a == b and a[0] == a[1] == [] and len(a) == len(texts)
    back = {r["doc_id"]: r["text"] for r in s.decode_rows(s.encode(docs)).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}
    c = {r["doc_id"]: r["ids"] for r in s.encode(docs, seed=1).collect()}
    assert sum(a[i] != c[i] for i in a) > 30
    rows = s.round_trip(docs).collect()
    assert all(r["lossless"] for r in rows) and {r["doc_id"]: r["n_pieces"] for r in rows} == {i: len(x) for i, x in a.items()}
    assert s.round_trip(docs.where("doc_id < 0")).count() == 0


def test_the_kept_words_may_be_dropped(monkeypatch):
    texts, keys = [prose(i, 60) for i in range(30)], list(range(30))
    want = s.sample(texts, keys, PATH)
    monkeypatch.setattr(s, "KEPT_WORDS", 20)
    monkeypatch.setattr(s, "_AT_ONCE", 50)
    s.lattices(PATH).clear()
    assert all((a == b).all() for a, b in zip(s.sample(texts, keys, PATH), want, strict=True))
    s.lattices(PATH).clear()
    assert isinstance(want[0], np.ndarray)


def test_long_runs_of_blanks_leave_all_samples_as_they_are_alone():
    texts = [prose(1, 80), " " * 300 + "nation", "a" + " " * 100_000 + "nation", *(prose(i, 80) for i in range(2, 20))]
    keys = s.row_keys(list(range(len(texts))), 4)
    s.lattices(PATH).clear()
    together = s.sample(texts, keys, PATH)
    assert np.isfinite(s.lattices(PATH).cum[: s.lattices(PATH).arcs]).all()
    for text, key, ids in zip(texts, keys, together, strict=True):
        s.lattices(PATH).clear()
        assert (s.sample([text], [key], PATH)[0] == ids).all() and s.decode(ids, PATH) == text
    ends = {tuple(ids[-2:].tolist()) for ids in s.sample([" " * 300 + "nation"] * 50, s.row_keys(list(range(50)), 4), PATH)}
    assert len(ends) > 1
    s.lattices(PATH).clear()


def test_a_long_word_without_blanks_is_one_lattice():
    """Shares of the arcs at each place against sums over all segmentations, by a plain loop in logarithms."""
    import random

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    normal = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    weight = {sp.id_to_piece(i): math.log((n + s.RANK_OFFSET) ** -s.ALPHA) for n, i in enumerate(normal)}
    longest = max(map(len, weight))
    rng = random.Random(6)
    word = "▁" + "".join(rng.choice(["the", "ation", "q", "é", "ing", "日", "x"]) for _ in range(3500))
    assert len(word) > 5000
    alpha = [0.0]
    shares = []
    for stop in range(1, len(word) + 1):
        ways = [(alpha[at] + weight.get(word[at:stop], math.log(s.OTHER_WEIGHT) if stop - at == 1 else -math.inf), stop - at) for at in range(max(0, stop - longest), stop)]
        top = max(w for w, _ in ways)
        alpha.append(top + math.log(sum(math.exp(w - top) for w, _ in ways)))
        shares.append({back: math.exp(w - alpha[-1]) for w, back in ways if w > -math.inf})
    lat = s.lattices(PATH)
    lat.clear()
    (ids,) = s.sample([word[1:]], [3], PATH)
    assert s.decode(ids, PATH) == word[1:]
    end = lat.end[word]
    for stop in (1, 2, 63, 64, 65, 129, 1000, len(word)):
        node = end - len(word) + stop
        at, got, before = lat.begin[node], {}, float(node)
        while True:
            got[int(lat.back[at])] = lat.cum[at] - before
            before = lat.cum[at]
            if before >= node + 1.0:
                break
            at += 1
        want = shares[stop - 1]
        assert set(got) == set(want) and all(abs(got[b] - want[b]) < 1e-6 for b in got)
    alone = ids.tolist()
    lat.clear()
    assert s.sample(["other words", word[1:], prose(4, 30)], [1, 3, 2], PATH)[1].tolist() == alone
