import random

import corpus_pipeline
from curricle.llm import site_quality
from curricle.llm.common import stored, without
from pyspark.sql import functions as F
from test_line_dedup import brute as brute_lines
from test_minhash import brute as brute_groups
from test_suffixes import brute as brute_repeats


def test_stages(spark, data):
    """Each stage against brute force on what its predecessor kept."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "near_duplicates", "repeats", "packing"]
    stage = dict(corpus_pipeline.STAGES)

    good = stored(stage["quality"](spark, docs, data), "stage")
    verdict = {r.id: r.kept for r in site_quality.classify(docs, spark.read.parquet(f"{data}/labels.parquet")).collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {i for i, k in verdict.items() if k}
    assert 0 < good.count() < docs.count()

    rows = [(r.doc_id, r.text) for r in good.collect()]
    lines = stored(stage["lines"](spark, good, data), "stage")
    gone = brute_lines(rows)
    want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in rows}
    want = {i: t for i, t in want.items() if t.strip() or not gone[i]}
    assert lines.columns == docs.columns and {r.doc_id: r.text for r in lines.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    single = stored(stage["near_duplicates"](spark, lines, data), "stage")
    groups = brute_groups(list(want.items()), 5)
    want = {i: t for i, t in want.items() if groups[i][1] == i}
    assert single.columns == docs.columns and {r.doc_id: r.text for r in single.collect()} == want

    cut = stored(stage["repeats"](spark, single, data), "stage")
    assert cut.columns == docs.columns
    left = {r.doc_id: r.text for r in cut.collect()}
    for i, _, _, b in brute_repeats(list(want.items()), corpus_pipeline.PASSAGE):  # cuts leave a character whole that they would cut
        assert "\ufffd" not in left[i].replace("\ufffd", "" if "\ufffd" in want[i] else "\ufffd") and set(b.decode(errors="ignore")) <= set(left[i])
        assert len(b) <= len(left[i].encode()) <= len(b) + 6 * (1 + len(want[i]) // corpus_pipeline.PASSAGE) and (len(b) < len(want[i].encode()) or left[i] == want[i])

    packed = stage["packing"](spark, cut, data)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(want)
    assert corpus_pipeline.run(spark, data).agg(F.sum("length")).first()[0] == packed.agg(F.sum("length")).first()[0]


def test_without(spark):
    df = spark.createDataFrame([(i if i % 10 else None, i) for i in range(100)], "doc_id bigint, word bigint")
    out = without(df, "doc_id", spark.createDataFrame([(3,), (4,), (4,), (None,)], "gone bigint"), "gone")
    assert sorted(r.word for r in out.collect()) == [i for i in range(100) if i not in (3, 4)]


def test_stages_on_odd_tables(spark, data, odd, nothing):
    """Nulls in any column, empty and very long texts, rows that repeat, clashing and dotted names, and no rows at all."""
    rng = random.Random(2)
    long_ = "\n".join(" ".join(f"w{rng.randrange(9000)}" for _ in range(9)) for _ in range(20_000))
    more = spark.createDataFrame([(7, long_, "en", "s1"), (8, long_, "en", "s1"), (9, "", None, None)], "doc_id bigint, text string, lang string, source string")
    docs = stored(odd.withColumns({"a.b": F.lit(1), "removed": F.lit("r"), "__lines": F.lit(2), "c0": F.lit("x")}).unionByName(more, allowMissingColumns=True), "odd")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, data), name)
        assert out.columns == docs.columns
        assert out.where("text is null").select("n_chars", "`a.b`").collect() == docs.where("text is null").select("n_chars", "`a.b`").collect() or name == "quality"
        assert stage(spark, nothing, data).count() == 0
        if name != "quality":
            docs = out
    ids = sorted((r.doc_id or 0) for r in docs.select("doc_id").collect())
    assert ids == [0, 1, 2, 3, 7, 9] or ids == [0, 1, 1, 2, 3, 7, 9]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert packed.where("doc_id in (2, 3, 9)").select("length", "doc_tokens").distinct().collect() == [(1, 1)]
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, data).count() == 0


def test_runs_at_once_keep_their_tables(spark, data):
    """What a stage of one thread leaves isn't deleted by a stage of another."""
    import threading

    docs, found = spark.read.parquet(f"{data}/documents.parquet").limit(40), {}

    def run(k):
        first = corpus_pipeline.lines(spark, docs, data)
        found[k] = first.count()

    threads = [threading.Thread(target=run, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found[0] == found[1] > 0
