"""Lines of one to four words are removed as others are, by the query and by the pipeline's stage."""

import corpus_pipeline
from curricle.llm import line_dedup
from curricle.llm.queries import op5_line_dedup
from test_line_dedup import brute

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TEXTS = ["All rights reserved.\nLes.\na b c d e", "all  RIGHTS reserved.\n日本語の一行です\n\n \t", "Les.\na b c d\nb c d e f", "日本語の一行です\na b c\nnew one here now", "c b a\nhere now one new\nd c b a", "Les.", "", "\n"]


def rows():
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)]


def test_query_takes_short_lines(spark, tmp_path):
    spark.createDataFrame(rows(), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute(list(enumerate(TEXTS)), least=1)
    assert want[1] == [0] and want[2] == [0, 1] and want[5] == [0]  # "a b c d" is four fifths of "a b c d e"
    assert {r.doc_id: r.removed_lines for r in op5_line_dedup(spark, str(tmp_path)).collect()} == want


def test_stage_takes_short_lines(spark, tmp_path):
    out = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, spark.createDataFrame(rows(), DOCS), str(tmp_path)).collect()}
    assert 5 not in out and out[1] == "日本語の一行です\n\n \t" and out[2] == "b c d e f" and out[6] == "" and out[7] == "\n"


def test_whole_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    for percent in (50, 80, 90, 100):
        got = {r.id: r.removed for r in line_dedup.removed_lines(docs, percent=percent, least_words=1).collect()}
        assert got == brute(texts, percent, 1)
