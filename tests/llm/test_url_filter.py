import random

import numpy as np
import pytest
import xxhash

from frameloom.llm import url_filter

URLS = [
    None, "", "no scheme", "http://Example.ORG/es/x", "http://a.b.example.org/en/1?q", "http://notexample.org/en/12", "http://example.org/en/2", "https://x.com/fr/?a://b", "https://X.COM/de/1#f",
    "https://com/de/", "://org/", "http://org", "http://", "http://.org/", "ftp://user@x.com:80/fr/", "http://example.org/es", "http://a.com/fr\n/x", "http://É.org/É",
]


def brute(url, rules):
    if not url or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    best = None
    for verdict, rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or (len(rule), len(h)) > (len(best[1]), best[1].index("/"))):
            best = verdict, rule
    return host, path, best[1] if best else None, best[0] if best else "allow"


def judged(spark, urls, rules):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'own' AS host", "'own' AS rule", "'own' AS verdict").repartition(3)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, rules=rules).collect()}


def test_urls_against_brute_force(spark):
    assert judged(spark, URLS * 2, url_filter.RULES) == {i: brute(u, url_filter.RULES) for i, u in enumerate(URLS * 2)}
    assert judged(spark, [], url_filter.RULES) == {} and judged(spark, URLS, [])[3][2:] == (None, "allow")


def test_many_rules(spark):
    rng = random.Random(1)
    parts = ["a", "b", "c", "example"]
    rules = {".".join(rng.choices(parts, k=rng.randint(1, 3))) + "/" + "".join(rng.choices("xy/", k=rng.randint(0, 4))): rng.choice(["allow", "block"]) for _ in range(300)}
    rules = [(v, r) for r, v in rules.items()]
    urls = ["http://" + ".".join(rng.choices(parts, k=rng.randint(1, 5))) + "/" + "".join(rng.choices("xy/", k=rng.randint(0, 6))) for _ in range(400)]
    assert judged(spark, urls, rules) == {i: brute(u, rules) for i, u in enumerate(urls)}


@pytest.mark.parametrize("mapped", [False, True])
def test_collisions_are_told_apart_by_the_strings(tmp_path, monkeypatch, mapped):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda s: len(s) % 2)
    parts = url_filter.digest_array([("block", "aa/x"), ("allow", "bb/x"), ("block", "c/")])
    for name, part in parts.items():
        np.save(tmp_path / f"{name}.npy", part)
    array = url_filter.DigestArray(tmp_path if mapped else parts)
    assert isinstance(array.keys, np.memmap) == mapped
    found = array.probe([b"bb/x", b"zz/x", b"aa/x", b"c/", b"q/"])
    assert [array.rule(i) if i >= 0 else None for i in found] == [b"bb/x", None, b"aa/x", b"c/", None]


def test_rules_that_contradict_are_refused():
    for rules in ([("allow", "a/"), ("block", "a/")], [("maybe", "a/")], [("allow", "a")]):
        with pytest.raises(ValueError):
            url_filter.digest_array(rules)


def test_a_host_of_many_labels_has_few_candidates(spark):
    array = url_filter.digest_array(url_filter.RULES)
    host = ".".join(["a"] * 100_000) + ".example.org"
    found = url_filter.candidates(host, "/es/x", array["lengths"].tolist(), array["labels"].tolist())
    assert len(found) <= len(array["lengths"]) * len(array["labels"]) and max(map(len, found)) < 20
    urls = [f"http://{host}/es/x", f"http://{'x.' * 50_000}com/de/"]
    assert [judged(spark, urls, url_filter.RULES)[i][2:] for i in (0, 1)] == [("example.org/es/", "block"), ("com/de/", "block")]
