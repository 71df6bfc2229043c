import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import odd_texts, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from frameloom.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_fast_ids_are_those_of_tokenizers(text):
    encode = packing.encoder(packing.tokenizer_folder())
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")) if not hasattr(test_fast_ids_are_those_of_tokenizers, "t") else test_fast_ids_are_those_of_tokenizers.t
    test_fast_ids_are_those_of_tokenizers.t = slow
    assert encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_white_space_that_the_fast_engine_gives_up_on(tokenizer):
    text = " " * 2_000_000 + "a"
    assert packing.encoder(packing.tokenizer_folder())(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check(rows, texts, tokenizer, window=1024):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, parts in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    used = 0
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        used += at
    return used, len(by_seq)


def test_each_id_lies_in_one_piece(make_docs, tokenizer):
    texts = odd_texts() + [prose(i, 10 + 37 * i % 700) for i in range(150)]
    used, sequences = check(packing.pack(make_docs(texts, extra=True)).collect(), texts, tokenizer)
    assert used / (1024 * sequences) > 0.97
    assert packing.pack(make_docs(["a"]).where("doc_id < 0")).count() == 0


def test_repeated_rows_and_null_ids(make_docs):
    rows = packing.pack(make_docs(["a b"] * 40 + [None], [3] * 40 + [None])).collect()
    assert len(rows) == 41 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 41


LENGTHS = {
    "uniform": lambda rng: rng.integers(1, 1025, 3000), "short": lambda rng: rng.geometric(1 / 50, 3000).clip(1, 1024), "long": lambda rng: rng.integers(600, 1025, 3000),
    "over half": lambda rng: rng.integers(513, 701, 3000), "nearly whole": lambda rng: rng.integers(854, 1024, 3000), "one length": lambda rng: np.full(3000, 600), "few": lambda rng: np.array([1024] * 7 + [1] * 3),
}


@pytest.mark.parametrize("kind", LENGTHS)
def test_plan_uses_each_id_once_with_little_padding(kind):
    lengths = LENGTHS[kind](np.random.default_rng(1))
    hist = np.bincount(lengths, minlength=1025)
    plan = packing.Plan(hist)
    filled = defaultdict(list)
    for n in np.flatnonzero(hist):
        of, at, size, seq, off = plan.place(np.full(hist[n], n), np.arange(hist[n]))
        assert (np.bincount(of, size) == n).all() and all((at[of == i] == np.append(0, size[of == i].cumsum()[:-1])).all() for i in range(min(20, hist[n])))
        for s, o, z in zip(seq.tolist(), off.tolist(), size.tolist(), strict=True):
            filled[s].append((o, z))
    assert sorted(filled) == list(range(plan.sequences))
    for parts in filled.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert plan.ids / 1024 / plan.sequences > 0.98 or kind == "few"


def test_padding_is_small_for_every_single_length():
    """Under 1 %, whatever length all tails have, and whatever few lengths are mixed."""
    kinds = [[n] for n in range(1, 1025)] + [range(a, b) for a, b in ((114, 121), (100, 128), (33, 64), (20, 31), (5, 9))]
    for kind in kinds:
        hist = np.zeros(1025, np.int64)
        hist[list(kind)] = 100_000 // len(kind)
        plan = packing.Plan(hist)
        assert plan.ids / 1024 / plan.sequences > 0.99, list(kind)


def test_short_tails_carry_the_checksums_of_their_ids(make_docs, tokenizer):
    texts = [prose(i, 28 + i % 9) for i in range(400)]
    rows = packing.pack(make_docs(texts)).collect()
    check(rows, texts, tokenizer)
    assert len(rows) > 400 and {r["length"] % 8 for r in rows if r["start"] == 0 and r["length"] < r["doc_tokens"]} == {0}


def test_solution_is_that_of_non_negative_least_squares():
    """At a least squares' minimum no count can fall or rise with gain: the gradient is 0 where a count is positive, and not below 0 elsewhere."""
    rng = np.random.default_rng(3)
    hist = np.bincount(rng.integers(1, 33, 40_000), minlength=33)
    combos = packing.combinations(np.flatnonzero(hist), 32)
    a = np.zeros((33, len(combos)))
    for j, combo in enumerate(combos):
        for n in combo[combo > 0]:
            a[n, j] += 1
    want = np.where(np.arange(33) > 0, hist, 0)
    x = np.zeros(len(combos))
    for _ in range(60_000):  # plain projected gradient
        x = np.maximum(0, x - a.T @ (a @ x - want) / np.linalg.norm(a, 2) ** 2)
    least, got = (float(((a @ y - want) ** 2).sum()) for y in (x, packing.solve(combos, hist)))
    assert got <= least + 1e-3 * float((want**2).sum())


def test_cut_tails_carry_the_checksums_of_their_ids(make_docs, tokenizer):
    texts = [prose(i, 330 + i % 40) for i in range(60)]
    ids = [len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts]
    assert np.mean([n % 1024 > 512 for n in ids]) > 0.9
    rows = packing.pack(make_docs(texts)).collect()
    used, sequences = check(rows, texts, tokenizer)
    assert len(rows) > 60 + sum(n > 1024 for n in ids) and used / (1024 * sequences) > 0.95


def test_combinations_are_all_there():
    lengths = np.array([1, 2, 3, 5, 7, 8])
    got = {tuple(c) for c in packing.combinations(lengths, 8).tolist()}
    want = {(8, 0, 0)} | {(a, b, 0) for a in lengths for b in lengths if a >= b and a + b == 8} | {(a, b, c) for a in lengths for b in lengths for c in lengths if a >= b >= c and a + b + c == 8}
    assert got == want and len(packing.combinations(lengths, 8)) == len(want)
