import random
from collections import Counter, defaultdict

import numpy as np
import regex
from curricle.llm import divergence, queries
from pyspark.sql import functions as F

TERM = regex.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least=3, most=200):
    """The contract, word by word; rows are (text, lang, source)."""
    docs = [(lang or "", source or "", [regex.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]) for text, lang, source in rows]
    out = set()
    for lang in {x for x, *_ in docs}:
        held, counts = Counter(), defaultdict(Counter)
        for _, source, terms in (d for d in docs if d[0] == lang):
            held.update(set(terms))
            counts[source].update(terms)
        kept = [t for t, n in held.items() if n >= least]
        v = len(kept)

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (n + v) for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, found, top in (("pair", pairs, len(pairs)), ("term", terms, most)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:top], 1)}
    return out


def got(df, **how):
    rows = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(df, **how).collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def table(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


def made(n=300, seed=1):
    rng = random.Random(seed)
    words = ["Éa", "éa", "zz", "日本", "\U0001f600x", "ABC", "abc", "it's", "a1b", "_u_"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    return [(" ".join(words[int(rng.random() ** 2 * len(words))] for _ in range(rng.randrange(40))), rng.choice(["en", "de", None, ""]), rng.choice(["s", "s", "s", "t", None, "", "u"])) for _ in range(n)]


def test_against_a_plain_version(spark):
    assert got(table(spark, made())) == plain(made())
    assert got(table(spark, made(80, 2)), least=2, most=3) == plain(made(80, 2), 2, 3)


def test_many_chunks_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(divergence, "ROWS", 60)
    monkeypatch.setattr(divergence, "TILE", 12)
    assert got(table(spark, made(150, 3))) == plain(made(150, 3))


def test_tasks_that_hold_little(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 4)
    assert got(table(spark, made(60, 4))) == plain(made(60, 4))


def test_odd_tables(spark, odd, nothing):
    assert got(nothing) == set()
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    assert got(odd.withColumn("term", F.lit(1)).withColumn("a.b", F.lit(1)).withColumn("n", F.lit("x"))) == plain(rows)
    assert got(odd, least=1) == plain(rows, 1)
    none = [(None, "en", "a"), ("", "en", "b"), ("12 34", "en", None), ("x", "de", "a")]
    assert got(table(spark, none)) == plain(none) and any(r[2:5] == ("pair", "b", 0) for r in plain(none))


def test_very_long_text(spark):
    rows = [("ab " * 400_000 + "c" * 1_000_000, "en", "s"), ("ab cd", "en", "t"), ("ab cd", "en", "t"), ("cd", "en", "s")]
    assert got(table(spark, rows)) == plain(rows)


def test_long_division_is_exact():
    rng = random.Random(9)
    for _ in range(2000):
        total = rng.choice([rng.randrange(1, 50), rng.randrange(1, 10 ** 15)])
        n = rng.randrange(0, min(total, 9 * 10 ** 15 - 1) + 1) - 1
        assert divergence.probability(np.array([n]), total)[0] == 1 + 1_000_000_000 * (n + 1) // total


def test_query(spark, data):
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    found = {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in queries.op12_divergence(spark, data).collect()}
    assert found == plain(rows)
