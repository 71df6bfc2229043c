import math
import random
import zlib

import numpy as np
import pytest
from conftest_llm import odd_texts, prose
from pyspark.sql import functions as F

from frameloom.llm import langid, quality, toxicity

LETTERS = {"aa": "the and ing er on re th", "bb": "que los ción ado ez ar el", "cc": "sch ein ung keit ich der und"}


def word(rng, lang):
    return "".join(rng.choices(LETTERS[lang].split(), k=rng.randint(1, 4)))


def text_of(rng, lang, n=60):
    return " ".join(word(rng, lang) for _ in range(n))


def held(i, modulus, rest):
    return zlib.crc32(str(i).encode()) % modulus == rest


def test_languages_of_the_held_out_fold(make_docs):
    rng = random.Random(3)
    langs = [rng.choice(list(LETTERS)) for _ in range(300)]
    texts = [text_of(rng, x, rng.randint(8, 60)) for x in langs]
    odd = odd_texts()
    docs = make_docs(texts + odd, lang=langs + [None] * len(odd), extra=True)
    rows = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert len(rows) == len(texts) + len(odd)
    right = [rows[i]["lang_pred"] == langs[i] for i in range(300) if rows[i]["held_out"]]
    assert len(right) > 30 and np.mean(right) > 0.98
    assert all(rows[i]["held_out"] == held(i, 5, 0) and 0 <= rows[i]["score"] <= 1 for i in rows)
    for i, t in enumerate(odd, 300):
        assert (rows[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))


def test_held_out_labels_are_not_learnt(make_docs):
    texts = ["abc def", "ghi jkl", "mno pqr"] * 20
    langs = ["no" if held(i, 5, 0) else "yes" for i in range(60)]
    assert {r["lang_pred"] for r in langid.identify(make_docs(texts, lang=langs)).collect()} == {"yes"}


def test_profile_is_a_sum_of_bound_vectors():
    v = langid._letters()
    a, b = (langid._classes()[ord(c)] for c in "ab")
    want = sum(v[0][x].astype(int) * v[1][y] * v[2][z] for x, y, z in ((0, a, b), (a, b, 0)))
    assert np.allclose(langid.profile("..AB!"), want / np.linalg.norm(want))
    assert langid.profile("12 !") is None and langid.profile(None) is None


def test_long_texts_are_profiled_whole(monkeypatch):
    text = prose(3, 3000)
    whole = langid.profile(text)
    monkeypatch.setattr(langid, "_CHUNK", 100)
    assert np.allclose(langid.profile(text), whole, atol=1e-5)


def test_no_languages_and_no_rows(make_docs):
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(make_docs(["abc", None])).collect()} == {("und", 0.0)}
    assert langid.identify(make_docs(["a"]).where("doc_id < 0")).count() == 0


def labelled(spark, rows, columns):
    return spark.createDataFrame(rows, f"doc_id long, {columns}").repartition(2)


def auc(scores, labels):
    pos, neg = (np.array([s for s, y in zip(scores, labels, strict=True) if y == k]) for k in (1, 0))
    return float((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean())


def test_quality_of_the_held_out_fold(spark, make_docs):
    rng = random.Random(5)
    y = [int(rng.random() < 0.8) for _ in range(800)]
    texts = [prose(i, 50) if k else rng.choice([" ".join(f"{w}%%%" for w in prose(i, 40).split()), " ".join([prose(i, 1)] * 60), prose(i, 30).replace(" ", " | ")]) for i, k in enumerate(y)]
    odd = odd_texts()
    labels = [*enumerate(y), (None, 1), (5, None)]
    rows = {r["doc_id"]: r for r in quality.classify(make_docs(texts + odd, extra=True), labelled(spark, labels, "quality int")).collect()}
    assert len(rows) == 800 + len(odd)
    out = [i for i in range(800) if rows[i]["held_out"]]
    assert all(rows[i]["held_out"] == held(i, 4, 2) and rows[i]["predicted"] == (rows[i]["score"] >= 0.7) for i in rows)
    assert auc([rows[i]["score"] for i in out], [y[i] for i in out]) > 0.97


def plain_ftrl(vectors, labels, epochs):
    """FTRL-proximal, a weight at a time."""
    z, n, bias, bias_n = {}, {}, 0.0, 0.0

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= quality.L1 else -(zi - math.copysign(quality.L1, zi)) / ((quality.BETA + math.sqrt(n.get(i, 0.0))) / quality.ALPHA + quality.L2)

    order = np.random.default_rng(quality.SEED)
    for _ in range(epochs):
        for row in order.permutation(len(vectors)):
            idx, x = vectors[row]
            w = {int(i): weight(int(i)) for i in idx}
            err = 1 / (1 + math.exp(-(sum(w[int(i)] * float(v) for i, v in zip(idx, x, strict=True)) + bias))) - labels[row]
            for i, v in zip(map(int, idx), map(float, x), strict=True):
                g = err * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
            bias_n += err * err
            bias -= 0.1 * err / (1 + math.sqrt(bias_n))
    return {i: weight(i) for i in z}, bias


def test_weights_are_those_of_plain_ftrl():
    rng = random.Random(2)
    texts = [text_of(rng, rng.choice("ab") * 2, 12) for _ in range(60)]
    labels = np.array([float("ing" in t) for t in texts])
    vectors = [quality.vector(t) for t in texts]
    w, b = quality.fit(vectors, labels, 2)
    want, bias = plain_ftrl(vectors, labels, 2)
    assert abs(b - bias) < 1e-6 and np.allclose([w[i] for i in want], list(want.values()), atol=1e-4)
    assert np.count_nonzero(w) == sum(v != 0 for v in want.values()) > 20


def test_scores_are_sparse_dot_products(make_docs):
    texts = ["good words here", "bad bad bad", "", None, "good good words %%"]
    vectors = [quality.vector(t) for t in texts]
    w, b = quality.fit(vectors[:2] * 20, np.array([1, 0] * 20, float))
    s = {i: 1 / (1 + math.exp(-(b + float(w[v[0]] @ v[1])))) for i, v in enumerate(vectors)}
    assert s[0] > s[3] > s[1]
    got = {r["doc_id"]: r["score"] for r in quality.score(make_docs(texts), (w, b)).collect()}
    assert all(abs(got[i] - s[i]) < 1e-5 for i in s)


def test_quality_training_is_bounded_in_rows_and_bytes(spark, make_docs):
    texts = [f"{'good' if i % 2 else 'bad'} {prose(i, 30)}" for i in range(200)]
    labels = labelled(spark, [(i, i % 2) for i in range(200)], "quality int")
    size = sum(len(part.tobytes()) for t in texts for part in quality.vector(t))
    docs, seen = make_docs(texts), []
    fit = quality.fit
    try:
        quality.fit = lambda vectors, y: seen.append(sum(i.nbytes + x.nbytes for i, x in vectors)) or fit(vectors, y)
        whole = quality.train(docs, labels)
        quality.train(docs, labels, most_bytes=size // 3)
        quality.train(docs, labels, most_bytes=1)
        repeated = quality.train(docs.union(docs).union(docs), labels)
    finally:
        quality.fit = fit
    assert seen[0] == size == seen[3] and size // 4 < seen[1] <= size // 3 and seen[2] == 0
    assert np.array_equal(whole[0], repeated[0]) and whole[1] == repeated[1]


def test_toxic_documents_are_caught_and_clean_ones_left_alone(spark, make_docs):
    rng = random.Random(7)
    y = [int(rng.random() < 0.15) for _ in range(900)]

    def spoil(text):
        words = text.split()
        for _ in range(3):
            words.insert(rng.randrange(len(words)), rng.choice(["moronic", "vileness", "scum"]) if rng.random() < 0.5 else "hatest" + word(rng, "bb"))
        return " ".join(words)

    texts = [spoil(prose(i, 60)) if k else prose(i, 60) for i, k in enumerate(y)]
    odd = odd_texts()
    rows = {r["doc_id"]: r for r in toxicity.classify(make_docs(texts + odd, extra=True), labelled(spark, [*enumerate(y), (None, 1), (3, None)], "toxic int")).collect()}
    assert len(rows) == 900 + len(odd)
    out = [i for i in range(900) if rows[i]["held_out"]]
    assert all(rows[i]["held_out"] == held(i, 5, 0) for i in rows)
    assert auc([rows[i]["score"] for i in out], [y[i] for i in out]) > 0.97
    assert np.mean([rows[i]["predicted"] for i in out if y[i]]) > 0.85 and np.mean([rows[i]["predicted"] for i in out if not y[i]]) < 0.03


@pytest.mark.parametrize("module, column", [(quality, "quality"), (toxicity, "toxic")])
def test_no_labels_and_no_rows(spark, make_docs, module, column):
    none = labelled(spark, [(None, None)], f"{column} int")
    rows = module.classify(make_docs(["a b", None, "a b"], [1, None, 1]), none).collect()
    assert len(rows) == 3 and all(0 <= r["score"] <= 1 for r in rows)
    assert module.classify(make_docs(["a"]).where("doc_id < 0"), none).count() == 0


def rows_of(x):
    """Dense rows as toxicity.Rows; the last column is the length."""
    row, part = np.nonzero(x[:, :-1])
    return toxicity.Rows(row, part, x[row, part], x[:, -1])


def plain_risk(x, positive, w, prior):
    """(prior * R+ + |R-|, R-), a row at a time."""
    softplus = lambda s: math.log1p(math.exp(-abs(s))) + max(s, 0)
    scores = [sum(a * b for a, b in zip(row, w, strict=False)) + w[-1] for row in x.tolist()]
    pos = [s for s, p in zip(scores, positive, strict=True) if p]
    negatives = sum(map(softplus, scores)) / len(scores) - prior * sum(map(softplus, pos)) / len(pos)
    return prior * sum(softplus(-s) for s in pos) / len(pos) + math.hypot(negatives, toxicity.ZERO), negatives


def mixed(seed=0, n=4000):
    rng = np.random.default_rng(seed)
    truth = rng.random(n) < 0.2
    x = np.column_stack([np.where(truth, rng.random(n) < 0.9, rng.random(n) < 0.02), rng.random((n, 20)) < 0.3, rng.random(n)]).astype(np.float32)
    positive = truth & (np.cumsum(truth) <= 300)
    return truth, x, positive


def test_risk_and_slope_are_those_of_plain_loops():
    _, x, positive = mixed(1, 200)
    w, step = np.random.default_rng(1).normal(size=(2, 23))
    sums = toxicity.risk_sums(rows_of(x), positive, w, step)
    for t, s in zip(toxicity.TRIED, sums, strict=True):
        at = w + t * step
        want, negatives = plain_risk(x, positive, at, 0.2)
        n, p = len(x), positive.sum()
        assert abs(s[0] / n - 0.2 * s[1] / p - negatives) < 1e-6 and abs(0.2 * s[2] / p + math.hypot(negatives, toxicity.ZERO) - want) < 1e-6
        g_all, g_pos0, g_pos1 = s[3:].reshape(3, 23) / np.array([[n], [p], [p]])
        slope = 0.2 * g_pos1 + negatives / math.hypot(negatives, toxicity.ZERO) * (g_all - 0.2 * g_pos0)
        for i in (0, 5, 21, 22):
            more, less = at.copy(), at.copy()
            more[i] += 1e-4
            less[i] -= 1e-4
            assert abs((plain_risk(x, positive, more, 0.2)[0] - plain_risk(x, positive, less, 0.2)[0]) / 2e-4 - slope[i]) < 1e-4


def test_fit_reaches_the_least_risk():
    """Against a plain descent over all rows in steps so small that each lowers the risk."""
    _, x, positive = mixed(2, 1000)
    rows = rows_of(x)
    w = toxicity.fit(lambda at, step: toxicity.risk_sums(rows, positive, at, step), int(positive.sum()), len(x), 21, 0.2)
    decay = toxicity.DECAY / positive.sum()
    total = lambda v: plain_risk(x, positive, v, 0.2)[0] + 0.5 * decay * float(v[:-1] @ v[:-1])
    v, rate = np.zeros(23), 1.0
    v[-1] = -1.0
    for _ in range(400):
        s = toxicity.risk_sums(rows, positive, v, np.zeros(23))[0]
        g_all, g_pos0, g_pos1 = s[3:].reshape(3, 23) / np.array([[len(x)], [positive.sum()], [positive.sum()]])
        negatives = plain_risk(x, positive, v, 0.2)[1]
        g = 0.2 * g_pos1 + negatives / math.hypot(negatives, toxicity.ZERO) * (g_all - 0.2 * g_pos0) + decay * np.append(v[:-1], 0.0)
        while rate > 1e-6 and total(v - rate * g) > total(v):
            rate /= 2
        v, rate = v - rate * g, rate * 1.2
    assert total(w) <= total(v) + 1e-3


def test_sums_over_a_table_are_those_over_its_rows(spark):
    _, x, positive = mixed(3, 500)
    rows = rows_of(x)
    data = [(bool(p), np.flatnonzero(r[:-1]).tolist(), [float(v) for v in r[:-1][r[:-1] != 0]], float(r[-1])) for r, p in zip(x, positive, strict=True)]
    df = spark.createDataFrame(data, "positive boolean, parts array<int>, values array<float>, length float").repartition(5)
    w, step = np.random.default_rng(4).normal(size=(2, 23))
    assert np.allclose(toxicity.summed(df, 23)(w, step), toxicity.risk_sums(rows, positive, w, step), atol=1e-5)


def test_non_negative_risk_finds_the_positives_among_the_unlabelled():
    truth, x, positive = mixed()
    rows = rows_of(x)
    w = toxicity.fit(lambda at, step: toxicity.risk_sums(rows, positive, at, step), int(positive.sum()), len(x), 21, 0.2)
    found = rows.times(w) > 0
    assert found[truth].mean() > 0.8 and found[~truth].mean() < 0.05


def test_telling_parts_count_all_texts(spark):
    texts = [(i < 30, f"word{i} {'vile' if i < 25 or i % 50 == 0 else 'mild'} the and") for i in range(400)]
    df = spark.createDataFrame(texts, "positive boolean, text string").repartition(4)
    parts = toxicity.telling_parts(df, 30, 400)
    assert "vile" in parts and "the" not in parts and "mild" not in parts
    hits = dict(enumerate(sorted(parts)))
    counts = toxicity.Counts(sorted(parts))
    part, times, n = counts.of("vile vile the")
    assert n == 3 and {hits[i]: int(k) for i, k in zip(part, times, strict=True)}["vile"] == 2


def test_repeated_ids_and_null_ids_of_the_classifiers(spark, make_docs):
    texts = ["vile scum", "mild words", "vile scum", "calm words", None] * 8
    ids = [1, 1, 2, 3, None] * 8
    for module, column in ((toxicity, "toxic"), (quality, "quality")):
        rows = module.classify(make_docs(texts, ids), labelled(spark, [(1, 1), (1, 0), (2, 1), (3, 0), (None, 1)], f"{column} int")).collect()
        assert len(rows) == 40 and all(0 <= r["score"] <= 1 for r in rows) and sum(r["doc_id"] is None for r in rows) == 8
    assert len(langid.identify(make_docs(texts, ids, lang=["aa", "bb", None, "aa", "bb"] * 8)).collect()) == 40


def test_ties_between_languages_go_to_the_first_by_name(make_docs):
    texts = ["same words here"] * 40
    got = {r["lang_pred"] for r in langid.identify(make_docs(texts, lang=["zz", "aa"] * 20)).collect()}
    assert got == {"aa"}


def test_too_many_languages_are_refused(make_docs, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 2)
    with pytest.raises(ValueError, match="more than 2 languages"):
        langid.train(make_docs(["a", "b", "c"], lang=["x", "y", "z"]))


def test_likeness_that_is_asked_rises_with_the_length(spark, make_docs):
    rng = random.Random(4)
    texts = [text_of(rng, "aa", rng.choice([4, 10, 40, 160])) for _ in range(200)]
    docs = make_docs(texts, lang=["aa"] * 200)
    model = langid.train(docs)
    least = langid.least_likeness(docs, model)
    asked = spark.range(1).select(*(least(F.lit(m)).alias(str(m)) for m in (5, 50, 500, 5000))).first()
    assert list(asked) == sorted(asked) and asked[0] > 0
    odd = {"noise": "".join(rng.choice("жзийклмнопр бвгд") for _ in range(2000)), "own": text_of(rng, "aa", 300)}
    got = {r["source"]: r["c"] >= r["least"] for r in langid.predict(make_docs(list(odd.values())), model, names=("p", "c", "m")).withColumn("least", least(F.col("m"))).withColumn("source", F.when(F.col("doc_id") == 0, "noise").otherwise("own")).collect()}
    assert got == {"noise": False, "own": True}
    assert langid.n_grams("ab, c!") == len("_ab_c_") - 2 and langid.n_grams("12") == 0 == langid.n_grams(None)
