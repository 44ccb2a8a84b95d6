import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Documents with copies, near copies, shared passages, odd white space, empty and null texts, by doc_id."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(1, 200), 5000) for _ in range(60)]
    texts += [texts[3]] * 6
    for k in (4, 5):
        for _ in range(8):
            words = texts[k].split(" ")
            for _ in range(rng.randrange(1, max(2, len(words) // 25))):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(999)}"
            texts.append(" ".join(words))
    passage = prose(rng, 90, 5000)
    texts += [f"{prose(rng, 20, 5000)} {passage} {prose(rng, 9, 5000)}" for _ in range(5)]
    line = "the same boiler plate line of nine or ten words"
    texts += [f"{line}\n{prose(rng, 30, 5000)}\n{line} more\n\n{prose(rng, 12, 5000)}" for _ in range(6)]
    texts += ["", None, " \t\n ", "one", "one two three", "One TWO three", "été 日本語 \U0001f600 it's 12345 don't!!", "a" * 1500, "ab " * 700, "x\r\ny\tz\x0bq  \n\n"]
    return [(i, t, ("en", "de")[i % 2], f"s{i % 3 if i % 2 else 0}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, repeated rows, and extra columns whose names clash with those that operators use."""
    rows = [(1, "alpha beta gamma delta epsilon zeta eta", "en", "s", 1, 7, "k"), (1, "alpha beta gamma delta epsilon zeta eta", "en", "s", 1, 7, "k"),
            (2, None, None, None, None, None, None), (None, "alpha beta gamma delta epsilon zeta eta", None, "s", None, 1, None), (3, "", "en", None, 0, 2, "z")]
    return spark.createDataFrame(rows, DOCS + ", id bigint, shard string").selectExpr("*", "id as h", "id as ids", "shard as component_id", "id as n_removed", "id as `key`")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
