import hashlib

from conftest_llm import odd_texts, prose

from frameloom.llm import spotsigs


def brute_signatures(text):
    words = spotsigs._WORD.findall((text or "").lower())
    chains = set()
    for i, w in enumerate(words):
        content = [x for x in words[i + 1 :] if x not in spotsigs.ANCHORS][: spotsigs.CHAIN]
        if w in spotsigs.ANCHORS and content:
            chains.add((w, *content))
    return chains or set(words)


def test_signatures_are_the_distinct_chains():
    for text in [*odd_texts()[:9], "the big dog and the big dog", "a cat", "of of", "the", *(prose(i, 80) for i in range(20))]:
        assert len(spotsigs.signatures(text)) == len(brute_signatures(text))
    a, b = prose(1, 200), prose(1, 150)
    x, y = brute_signatures(a), brute_signatures(b)
    assert abs(spotsigs.likeness(spotsigs.signatures(a), spotsigs.signatures(b)) - len(x & y) / len(x | y)) < 1e-12


def test_likeness_prunes_by_size_only_what_cannot_reach():
    a, b = spotsigs.signatures(prose(1, 300)), spotsigs.signatures(prose(1, 100))
    full = spotsigs.likeness(a, b)
    assert spotsigs.likeness(a, b, full - 0.01) == full and spotsigs.likeness(a, b, 0.99) == 0.0
    assert spotsigs.likeness(a[:0], b[:0]) == 1.0 and spotsigs.likeness(a, b[:0]) == 0.0


def test_edited_against_brute_force(make_docs):
    texts = [prose(i, 3 + i * 7 % 90) for i in range(120)] + odd_texts()
    ids = [(i * 37) % 1009 for i in range(len(texts))]
    got = {r["doc_id"]: r for r in spotsigs.edited_fingerprints(make_docs(texts, ids, extra=True)).collect()}
    order = sorted(zip(ids, texts, strict=True), reverse=True, key=lambda x: x[0])
    assert len(got) == len(order)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        other = t[: len(t) - cut] + nxt[:cut]
        r, own, theirs, edit = got[i], *(brute_signatures(x) for x in (t, nxt, other))
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(other.encode()).hexdigest()
        for value, s in ((r["near_edited"], edit), (r["near_next"], theirs)):
            assert abs(value - (len(own & s) / len(own | s) if own | s else 1.0)) < 1e-12
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (own == edit)


def test_one_row_repeats_nulls_and_none(make_docs):
    (r,) = spotsigs.edited_fingerprints(make_docs(["the old house of stone"], [4])).collect()
    assert r["near_next"] == 1.0
    rows = spotsigs.edited_fingerprints(make_docs(["the a", "the a", "the b", None], [1, 1, None, 2])).collect()
    assert len(rows) == 4 and sum(r["doc_id"] is None for r in rows) == 1
    assert spotsigs.edited_fingerprints(make_docs(["a"]).where("doc_id < 0")).count() == 0


def brute_groups(texts, least):
    sets = {i: frozenset(brute_signatures(t)) for i, t in enumerate(texts)}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if a < b and (x == y or (x | y and len(x & y) / len(x | y) >= least)):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in sets}


def test_near_duplicates_lose_no_link(make_docs):
    base = [prose(i, 60 + 5 * i) for i in range(12)]
    texts = list(base)
    for k, t in enumerate(base):
        words = t.split()
        texts += [" ".join(words[: len(words) - cut]) for cut in (2, 6, 15)] + [t, " ".join([*words[:20], "new", *words[21:]])][: 1 + k % 2]
    texts += odd_texts()
    got = {r["doc_id"]: r["group_id"] for r in spotsigs.near_duplicates(make_docs(texts, extra=True)).collect()}
    assert got == brute_groups(texts, 0.8)
    assert len(set(got.values())) < len(got) - 20
    assert spotsigs.near_duplicates(make_docs(["a"]).where("doc_id < 0")).count() == 0


def test_repeated_rows_and_null_ids_of_near_duplicates(make_docs):
    texts = [prose(1, 60), prose(1, 60), prose(2, 60), None, ""]
    rows = spotsigs.near_duplicates(make_docs(texts, [4, 4, None, 9, None])).collect()
    assert sorted(((r["doc_id"], r["group_id"]) for r in rows), key=str) == sorted([(4, 4), (4, 4), (None, None), (9, 9), (None, 9)], key=str)


def test_groups_stand_beside_the_fingerprints(make_docs):
    base = [prose(i, 80) for i in range(6)]
    texts = base + [t + " end" for t in base] + [base[0], None, ""]
    rows = {r["doc_id"]: r for r in spotsigs.grouped_fingerprints(make_docs(texts, extra=True)).collect()}
    want = brute_groups(texts, 0.8)
    of = {i: r["group_fingerprint"] for i, r in rows.items()}
    assert len(rows) == len(texts) and all((of[a] == of[b]) == (want[a] == want[b]) for a in of for b in of)
    assert all(of[i] == min(rows[j]["fingerprint"] for j in of if want[j] == want[i]) for i in of)
    plain = {r["doc_id"]: r for r in spotsigs.edited_fingerprints(make_docs(texts)).collect()}
    assert all(plain[i].asDict() == {k: v for k, v in rows[i].asDict().items() if k != "group_fingerprint"} for i in rows)
    assert all(rows[i]["fingerprint"] == spotsigs.fingerprint(spotsigs.signatures(t)) for i, t in enumerate(texts))
    assert spotsigs.grouped_fingerprints(make_docs(["a"]).where("doc_id < 0")).count() == 0


def test_equal_ids_are_dealt_out_by_their_texts(make_docs):
    texts = [prose(i, 20) for i in range(50)]
    rows = spotsigs.edited_fingerprints(make_docs(texts, [7] * 50)).collect()
    assert len(rows) == 50 and sorted(r["n_chars"] for r in rows) == sorted(map(len, texts))
