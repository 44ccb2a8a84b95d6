"""Command line: import, search, screen, bench and purge. Exit codes: 0 done, 1 failed files, a missed gate or a purge not confirmed, 2 wrong usage or input."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluation, extract, matching, screening
from .operators.intervals import month_intervals
from .plans.sample import write_sample
from .plans.store import PeopleStore
from .sources.documents import read_condition, read_truth
from .sources.files import read_resumes, resume_files
from .storage import stored
from .types import STATE_TEXT

VERSION = "0.1.0"
CONFIRM = "DELETE"


def session() -> SparkSession:
    return (SparkSession.builder.appName("curricle").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="curricle")
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("--store", default="people-store")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("import")
    c.add_argument("path")
    c = sub.add_parser("search")
    c.add_argument("query", nargs="?", default="")
    c.add_argument("--degree")
    c.add_argument("--skill")
    c.add_argument("--min-years", type=float)
    c.add_argument("--limit", type=int, default=20)
    c.add_argument("--unmasked", action="store_true")
    c = sub.add_parser("screen")
    c.add_argument("--jd", required=True)
    c.add_argument("--export")
    c = sub.add_parser("bench")
    c.add_argument("what", choices=["gen", "parse", "match"])
    c.add_argument("--data", default="output")
    c.add_argument("--persons", type=int, default=100)
    c.add_argument("--seed", default="20261005")
    c = sub.add_parser("purge")
    c.add_argument("--confirm")
    return p


def _import(spark: SparkSession, store: PeopleStore, a) -> int:
    if not os.path.exists(a.path):
        print(f"no such path: {a.path}", file=sys.stderr)
        return 2
    rows = store.import_files(a.path, datetime.now().isoformat(timespec="seconds")).orderBy("source_file")
    counts = {r["status"]: r["count"] for r in rows.groupBy("status").count().collect()}
    for r in rows.toLocalIterator():
        print(f"{r.status}\t{r.source_file}" + (f"\t{r.error}" if r.error else ""))
    print(", ".join(f"{k} {v}" for k, v in sorted(counts.items())) or "no files")
    return 1 if counts.get("failed") else 0


def _search(spark: SparkSession, store: PeopleStore, a) -> int:
    rows = store.search(a.query, masked=False if a.unmasked else None, degree=a.degree, skill=a.skill, min_years=a.min_years, limit=a.limit).collect()
    for r in rows:
        print(f"#{r.pid}\t{r.name or '(无名)'}\t{r.degree or '-'}\t{r.school or '-'}\t{'-' if r.years is None else r.years}\t{r.phone}\t{r.email}")
    print(f"{len(rows)} found")
    return 0


def _screen(spark: SparkSession, store: PeopleStore, a) -> int:
    try:
        with open(a.jd, encoding="utf-8") as f:
            want = read_condition(f.read())
    except (OSError, ValueError) as e:
        print(f"the job condition can't be read: {e}", file=sys.stderr)
        return 2
    rows = store.screen(want)
    ranked = screening.ranked(rows)
    for r in ranked.toLocalIterator():
        print(f"{r['rank']}\t{STATE_TEXT[r.state]}\t#{r.pid}\t{r.name or '(无名)'}\t{r.score:.4f}")
    n = screening.summary(rows).first()
    print(f"{n.total} people: {n.n_hit} hit, {n.n_miss} miss, {n.n_insufficient} insufficient, {n.n_excluded} excluded")
    if a.export:
        (screening.export_csv if n.total <= screening.ONE_FILE else screening.export_folder)(ranked, a.export)
    return 0


def parsed_cards(spark: SparkSession, data: str) -> tuple[DataFrame, DataFrame]:
    """Cards of the readable files of a truth folder, and the truth of those files."""
    truth = read_truth(spark, f"{data}/truth.json")
    texts = read_resumes(resume_files(spark, f"{data}/resumes")).where("error is null").withColumn("parsed_at", F.lit(""))
    cards = extract.extract_cards(texts)
    there = cards.select(F.regexp_extract("source_file", r"([^/\\]*)$", 1).alias("file"))
    return cards, truth.join(there, "file", "left_semi")


def match_report(cards: DataFrame, truth: DataFrame):
    """Pair metrics of clusters by automatic merges, over all pairs of files, and counts of the pairs left to a reader: a row each."""
    rows = cards.withColumn("file", F.regexp_extract("source_file", r"([^/\\]*)$", 1)).join(truth.select("file", "grp"), "file")
    ids = rows.withColumn("pid", F.pmod(F.xxhash64("file"), F.lit(1 << 53)))
    names = {"name": "name", "phone": "phone", "email": "email", "school": "school", "major": "major", "desired_position": "desired"}
    people = ids.select("pid", "grp", *(F.col("fields")[f]["value"].alias(n) for f, n in names.items()))
    jobs = month_intervals(ids.select("pid", F.explode("experiences").alias("e")).select("pid", "e.company", "e.start", "e.end"), ["pid", "company"])
    decided = stored(matching.decisions(people, jobs), "decisions")
    found = matching.clusters(people, decided).join(people.select("pid", "grp"), "pid")
    return evaluation.member_metrics(found).first(), evaluation.manual_pairs(decided, people).first()


def _bench(spark: SparkSession, store: PeopleStore, a) -> int:
    if a.what == "gen":
        if a.persons < 1:
            print("a sample has one person at least", file=sys.stderr)
            return 2
        made = write_sample(spark, a.data, a.persons, a.seed)
        print(f"{a.data}: {made['persons']} people, {made['multi_version_persons']} with several versions, {made['homonym_groups']} pairs of one name; "
              f"{made['files']} files: " + ", ".join(f"{k} {n}" for k, n in made["by_format"].items()))
        return 0
    if not os.path.isfile(f"{a.data}/truth.json"):
        print(f"no truth.json in {a.data}", file=sys.stderr)
        return 2
    cards, truth = parsed_cards(spark, a.data)
    if a.what == "parse":
        report = evaluation.parse_report(evaluation.card_counts(cards, truth))
        for r in evaluation.markdown(report, ["grp", "tp", "fp", "fn", "precision", "recall", "f1"]).collect():
            print(r.line)
        f1 = evaluation.macro_f1(report.where("tp + fp + fn > 0")).first().macro_f1
        print(f"macro F1 {f1:.4f}")
        return 0 if f1 >= 0.95 else 1
    row, manual = match_report(cards, truth)
    print(" ".join(f"{k} {row[k]:.4f}" for k in ("precision", "recall", "f1", "false_merge_rate")))
    print(f"manual review: {manual.n_pairs} pairs, {manual.n_same} of one person, {manual.n_cross} of two")
    return 0 if evaluation.passes(row) else 1


def _purge(spark: SparkSession, store: PeopleStore, a) -> int:
    for name, n in store.purge_preview().items():
        print(f"{name}: {n}")
    if a.confirm != CONFIRM:
        print(f"nothing removed; confirm with --confirm {CONFIRM}")
        return 1
    store.purge()
    print("removed")
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    spark = session()
    return {"import": _import, "search": _search, "screen": _screen, "bench": _bench, "purge": _purge}[a.command](spark, PeopleStore(spark, os.path.abspath(a.store)), a)

