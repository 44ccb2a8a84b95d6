"""Registered queries over texts report everything that their operators find."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest
from curricle import catalogue

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def written(spark, path, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, "s0"), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_audit_reports_paths(spark, tmp_path):
    d = written(spark, tmp_path, ["C:\\Users\\x\nsee D:/data and D:/more", "https://a.org\nmail a@corp.org", "in ProgramData", "aC:\\Users\\x", ""])
    got = {(r.doc_id, r.category, r.n) for r in catalogue.QUERIES["audit_categories"](spark, d).collect()}
    assert got == {(0, "USERPATH", 1), (0, "DRIVEPATH", 1), (1, "EMAIL", 1), (2, "PROGDATA", 1)}


def test_import_status_reports_both_batches(spark, tmp_path):
    d = written(spark, tmp_path, ["a", "b", "a", "", "b", "c", "a", None], {1: "s1", 2: "s1", 4: "s1", 5: "s1", 7: None})
    got = {r.status: r.n for r in catalogue.QUERIES["import_status"](spark, d).collect()}
    # early: 0 new, 3 failed, 6 duplicate; late: 1 and 5 new, 2 and 4 duplicate, 7 (no text, no hash) duplicate
    assert got == {"new": 3, "duplicate": 4, "failed": 1}


def test_every_document_is_predicted(spark, tmp_path):
    d = written(spark, tmp_path, ["x" * 900, "y", "", *["z" * 801] * 5])  # good and even, bad and odd, nothing said, good and odd
    spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    got = {r.grp: (r.tp, r.fp, r.fn) for r in catalogue.QUERIES["eval_scalar_prf"](spark, d).collect()}
    assert got == {"quality": (6, 1, 2), "toxic": (1, 6, 7)}
    failed = {(r.doc_id, r.grp): (r.fp, r.fn) for r in catalogue.QUERIES["eval_failures_topn"](spark, d).collect()}
    assert failed[(7, "toxic")] == (1, 1) and failed[(2, "quality")] == (0, 1) and (0, "quality") not in failed
    f1 = [2 * p * r / (p + r) for p, r in ((6 / 7, 6 / 8), (1 / 7, 1 / 8))]
    row = catalogue.QUERIES["eval_macro_f1"](spark, d).first()
    assert row.n_groups == 2 and abs(row.macro_f1 - sum(f1) / 2) < 1e-6


#: Texts whose lines may be read in two ways: none, blank ones, newlines at the end, other line ends, white space of other scripts.
ODD = ["", None, "\n", "\n\n", "a\n", "a@b.org\n", "x\r\ny@z.org\r\n", "p\x0bq, r", "a b@c.de", "u\x85v、w", "\r", "one , two\n\x0b, three", "中 文 字|  x ", "  ", "l1\x1cl2", "x ,　y ", "a\x0cb", "\tq\t", "A@B.c0m a@b.com\nc@d.net"]


def differing(spark, d, name):
    """Rows that a query and its SQL don't share."""
    duck = duckdb.connect()
    for t in Path(d).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}{'/*.parquet' if t.is_dir() else ''}')")
    theirs = duck.sql(catalogue.ORACLES[name])
    ours = Counter(tuple(r[c] for c in theirs.columns) for r in catalogue.QUERIES[name](spark, d).collect())
    theirs = Counter(theirs.fetchall())
    return ours - theirs, theirs - ours


@pytest.mark.parametrize("name", ["extract_first_contact", "text_lines", "text_join_wrapped"])
def test_odd_lines_equal_sql(spark, tmp_path, name):
    assert differing(spark, written(spark, tmp_path, ODD), name) == (Counter(), Counter())


def test_odd_labels_equal_sql(spark, tmp_path, data):
    d = written(spark, tmp_path, [*ODD, "a\u2003,b", "\x0ba、\u2003|b\u3000", ", \u2003 ,"])
    spark.read.parquet(f"{data}/part.parquet").write.parquet(f"{d}/part.parquet")
    assert differing(spark, d, "text_split_documents") == (Counter(), Counter())
