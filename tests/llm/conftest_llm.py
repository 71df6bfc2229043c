import random

import pytest

SYLLABLES = "the an re on er in th at en nd st ou ea ha ing tion".split()
COMMON = "the of and to in is that by".split()


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(COMMON) if rng.random() < 0.4 else "".join(rng.choices(SYLLABLES, k=rng.randint(2, 4))) for _ in range(words))


def odd_texts() -> list[str | None]:
    """Null, empty, blank, short, repeated, non-Latin, and one very long text."""
    return [None, "", " \t\n", "a", "the", "!?", "日本語 テスト 😀", "x" * 3000, "a b c", "a b c", prose(1, 40_000), "▁ a  b", "é" * 50, "<|endoftext|> x"]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, lang=None, extra=False):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, lang[k] if lang else None, "s", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        if extra:  # columns whose names clash with those that operators add
            for name in ("fp", "fingerprint", "score", "spans", "rank", "path", "blob_id", "length", "held_out", "_id", "edge"):
                df = df.selectExpr("*", f"'own' AS {name}")
        return df.repartition(3)

    return make
