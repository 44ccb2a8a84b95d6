"""Screening of people against a job's conditions, with three states and the reasons for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.documents import condition
from ..types import DEGREE_ORDER, EVIDENCE, STATE_TEXT, WEIGHT_DEGREE, WEIGHT_SKILLS, WEIGHT_YEARS
from .numbering import numbered

HIT, MISS, UNSURE, EXCLUDED = "hit", "miss", "insufficient", "excluded"


def degree_state(degree: Column, least: str) -> Column:
    order = F.create_map(*(F.lit(v) for kv in DEGREE_ORDER.items() for v in kv))
    have, want = F.try_element_at(order, strip(degree)), F.try_element_at(order, F.lit(least.strip()))
    return F.when(have.isNull() | want.isNull(), UNSURE).when(have >= want, HIT).otherwise(MISS)


def years_state(years: Column, has_jobs: Column, least: float | None, most: float | None) -> Column:
    fits = F.lit(True)
    if least is not None:
        fits = fits & (years >= least)
    if most is not None:
        fits = fits & (years <= most)
    return F.when(~F.coalesce(has_jobs, F.lit(False)) | years.isNull(), UNSURE).when(fits, HIT).otherwise(MISS)


def skill_cells(skills: Column, required: list[str], evidence: Column | None = None) -> Column:
    """ARRAY<STRUCT<keyword, state, value, evidence>>: equality without case; nobody with no skills at all is judged. evidence: by
    lower-case skill, the lines that show it (MAP<STRING, ARRAY<evidence>>); a hit's cell has them."""
    evidence = F.lit(None).cast(f"MAP<STRING, ARRAY<{EVIDENCE}>>") if evidence is None else evidence
    labels = F.coalesce(F.filter(F.transform(skills, strip), lambda s: s != ""), F.array().cast("array<string>"))
    wanted = F.array(*(F.lit(r) for r in required)) if required else F.array().cast("array<string>")

    def cell(r: Column) -> Column:
        same = F.filter(labels, lambda s: F.lower(s) == F.lower(r))
        state = F.when(F.size(labels) == 0, UNSURE).when(F.size(same) > 0, HIT).otherwise(MISS)
        shown = F.when(F.size(same) > 0, F.try_element_at(evidence, F.lower(r)))
        return F.struct(r.alias("keyword"), state.alias("state"), F.get(same, F.lit(0)).alias("value"), shown.alias("evidence"))

    return F.transform(wanted, cell)


def exclude_cells(texts: Column, keywords: list[str]) -> Column:
    """ARRAY<STRUCT<keyword, state, value>>: the fields (texts: ARRAY<STRUCT<field, text>>) that contain a keyword; a hit is bad."""
    texts = F.filter(texts, lambda t: F.coalesce(t["text"], F.lit("")) != "")
    words = F.array(*(F.lit(k) for k in keywords)) if keywords else F.array().cast("array<string>")

    def cell(k: Column) -> Column:
        where = F.transform(F.filter(texts, lambda t: F.lower(t["text"]).contains(F.lower(k))), lambda t: t["field"])
        state = F.when(F.size(texts) == 0, UNSURE).when(F.size(where) > 0, HIT).otherwise(MISS)
        return F.struct(k.alias("keyword"), state.alias("state"), where.alias("value"))

    return F.transform(words, cell)


def _fit(state: Column) -> Column:
    return F.when(state == HIT, 1.0).when(state == UNSURE, 0.5).otherwise(0.0)


def matrix(people: DataFrame, given: dict, key: str = "pid") -> DataFrame:
    """One row for each person (key, name, degree, years, has_jobs, skills, texts), ranked: state, excluded, score and the cells.

    Set conditions count: any miss is a miss, else anything unsure is unsure. Excluding words overrule. Rank goes by excluded, score, key.
    """
    want = condition(given)
    degree = degree_state(F.col("degree"), str(want["degree_min"])) if want["degree_min"] else F.lit(None).cast("string")
    least, most = want["years"].get("min"), want["years"].get("max")
    years = years_state(F.col("years"), F.col("has_jobs"), least, most) if want["years"] else F.lit(None).cast("string")
    rows = people.select(key, "name", "degree", "years", degree.alias("degree_state"), years.alias("years_state"),
                         skill_cells(F.col("skills"), want["must_have_skills"], F.col("skill_evidence") if "skill_evidence" in people.columns else None).alias("skill_cells"), exclude_cells(F.col("texts"), want["exclude_keywords"]).alias("exclude_cells"))
    states = F.concat(F.array("degree_state", "years_state"), F.col("skill_cells.state"))
    some = lambda s: F.exists(states, lambda x: F.coalesce(x == s, F.lit(False)))
    rows = rows.withColumn("excluded", F.exists("exclude_cells", lambda c: c["state"] == HIT))
    rows = rows.withColumn("state", F.when(F.col("excluded"), EXCLUDED).when(some(MISS), MISS).when(some(UNSURE), UNSURE).otherwise(HIT))
    n = F.size("skill_cells")
    skill_fit = F.when(n > 0, F.aggregate("skill_cells", F.lit(0.0), lambda a, c: a + _fit(c["state"])) / n).otherwise(1.0)
    fit = lambda c: F.when(F.col(c).isNull(), 1.0).otherwise(_fit(F.col(c)))
    rows = rows.withColumn("score", F.floor((WEIGHT_SKILLS * skill_fit + WEIGHT_YEARS * fit("years_state") + WEIGHT_DEGREE * fit("degree_state")) * 10000 + 0.5) / F.lit(10000.0))
    return rows


def ranked(rows: DataFrame, key: str = "pid") -> DataFrame:
    """rows of matrix() with their rank, in order: a sort over all tasks and one count for each, no single window."""
    return numbered(rows, [F.col("excluded").asc(), F.desc("score"), F.col(key).asc()], "rank", 0).withColumn("rank", F.col("rank").cast("int")).orderBy("rank")


def summary(rows: DataFrame) -> DataFrame:
    """Counts of each state: one row."""
    return rows.agg(F.count("*").alias("total"), *(F.count_if(F.col("state") == s).alias(f"n_{s}") for s in (HIT, MISS, UNSURE, EXCLUDED)))


#: Headers of the exported table.
EXPORT_HEADERS = ["排名", "状态", "候选人ID", "姓名", "学历", "学历判定", "工作年限", "年限判定", "必备技能判定", "排除词命中", "匹配分"]


def export_rows(rows: DataFrame, key: str = "pid") -> DataFrame:
    """ranked() rows as text cells under EXPORT_HEADERS; contacts are no part of it."""
    name = F.create_map(*(F.lit(v) for kv in STATE_TEXT.items() for v in kv))
    said = lambda s: F.coalesce(F.try_element_at(name, s), F.lit(""))
    skills = F.array_join(F.transform("skill_cells", lambda c: F.concat(c["keyword"], F.lit(":"), said(c["state"]))), "；")
    hits = F.array_join(F.transform(F.filter("exclude_cells", lambda c: c["state"] == HIT), lambda c: F.concat(c["keyword"], F.lit(":"), F.array_join(c["value"], ","))), "；")
    asked = lambda state, c: F.when(F.col(state).isNull(), "").otherwise(F.coalesce(F.col(c).cast("string"), F.lit("")))
    cells = [F.col("rank").cast("string"), said(F.col("state")), F.col(key).cast("string"), F.coalesce("name", F.lit("(无名)")), asked("degree_state", "degree"), said(F.col("degree_state")),
             asked("years_state", "years"), said(F.col("years_state")), skills, F.when(F.col("excluded"), hits).otherwise(""), F.format_string("%.4f", "score")]
    return rows.select(*(c.alias(h) for c, h in zip(cells, EXPORT_HEADERS, strict=True)))


def export_folder(rows: DataFrame, path: str, key: str = "pid") -> None:
    """A folder of CSV files with headers, in order of rank, written by all tasks."""
    export_rows(rows, key).write.option("header", True).mode("overwrite").csv(path)


#: Rows of one CSV file for readers; longer lists go to a folder.
ONE_FILE = 10_000


def export_csv(rows: DataFrame, path: str, key: str = "pid", limit: int = ONE_FILE) -> None:
    """One CSV file with a byte order mark of the first `limit` of ranked() rows, written by the driver."""
    import csv

    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(EXPORT_HEADERS)
        for row in export_rows(rows.where(F.col("rank") <= limit), key).toLocalIterator():
            out.writerow(list(row))
