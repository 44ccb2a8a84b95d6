import hashlib

from curricle.llm import sketches
from pyspark.sql import functions as F


def jaccard(a, b, k=5):
    def shingles(t):
        w = t.split()
        return {tuple(w[i: i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_estimates(spark, corpus):
    texts = [c[1] or "" for c in corpus]
    pairs = [(a, b) for a, b in zip(texts, texts[1:] + texts[:1], strict=True)] + [(texts[4], t) for t in texts[66:74]] + [(t, t) for t in texts[:5]]
    df = spark.createDataFrame(pairs, "a string, b string")
    df = sketches.with_sketch(sketches.with_sketch(df, "a", "sa"), "b", "sb")
    for r in df.select("a", "b", sketches.resemblance(F.col("sa"), F.col("sb")).alias("x"), sketches.distinct_count(F.col("sa")).alias("n"),
                       sketches.containment(F.col("sa"), F.col("sb")).alias("c")).collect():
        assert abs(r.x - jaccard(r.a, r.b)) < 0.15
        n = len({tuple(r.a.split()[i: i + 5]) for i in range(max(1, len(r.a.split()) - 4))}) if r.a.split() else 0
        assert abs(r.n - n) <= max(0.3 * n, 1e-9) and 0 <= r.c <= 1
        if r.a == r.b:
            assert r.x == 1.0


def test_merge_is_the_sketch_of_the_union(spark):
    a, b = " ".join(f"a{i}" for i in range(300)), " ".join(f"b{i}" for i in range(250))
    df = sketches.with_sketch(spark.createDataFrame([("x", a), ("x", b), ("y", a), ("z", None)], "g string, text string"))
    by = {r.g: r.sketch for r in sketches.merged_by(df, ["g"], k=64, salts=3).collect()}
    parts = [r.sketch for r in df.orderBy("text").collect()]
    assert by["x"] == sorted({*parts[1], *parts[3]})[:64] and by["y"] == sorted(parts[1])[:64] and by["z"] == []


def test_query_edits_and_neighbours(spark, corpus, tmp_path):
    from curricle.llm.queries import op3_fingerprints

    path = str(tmp_path)
    rows = sorted((c[0] * 7 % 1000, c[1]) for c in corpus)
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).write.parquet(f"{path}/documents.parquet")
    got = {r.doc_id: r for r in op3_fingerprints(spark, path).collect()}
    assert len(got) == len(rows)
    for (id_, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[id_]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(text, edited)) < 0.16 and abs(r.near_next - jaccard(text, after)) < 0.16
    assert got[rows[0][0]].fingerprint != "" or not rows[0][1]


def test_next_in_small_buckets_and_odd_keys(spark):
    df = spark.createDataFrame([(k, f"v{k}") for k in [5, 1, 9, 2**62, -3, 7, 8, 100]] + [(None, "none")], "k bigint, v string")
    got = {r.v: r.n.v for r in sketches.with_next(df, "k", F.struct("v"), "n", per_bucket=2).collect()}
    order = ["none", "v-3", "v1", "v5", "v7", "v8", "v9", "v100", f"v{2**62}"]
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))
    one = spark.createDataFrame([(4, "v")], "k bigint, v string")
    assert sketches.with_next(one, "k", F.struct("v"), "n").first().n.v == "v"
    assert sketches.with_next(one.where("k > 9"), "k", F.struct("v"), "n").count() == 0
