"""A folder of made-up resumes of several formats, layouts and versions, with the truth about them; the same for the same seed."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import generation
from ..operators.generation import fraction
from ..shipping import ship
from ..storage import stored
from ..sources import rendering

#: Shares and rates of the sample.
MULTIPLE, THIRD = 0.6, 0.3
FRESH, PDF, DOCX = 0.3, 0.4, 0.4
MISSING = {"phone": 0.10, "email": 0.15, "degree": 0.10, "school": 0.10, "major": 0.20, "graduation": 0.25, "desired": 0.20, "certificates": 0.10}
NOISE = {"pseudo_space": 0.15, "fullwidth_digit": 0.12, "multiline_experience": 0.15, "crlf": 0.12, "gbk_encoding_txt": 0.15, "docx_table": 0.15}
PHONE_CHANGES, EMAIL_CHANGES, DESIRED_CHANGES = 0.3, 0.3, 0.5
#: Pairs of people of one name who never worked at the same place.
HOMONYMS = [(k, k + 1) for k in (3, 11, 23, 47, 81)]

CHARACTERS = "甲乙丙丁戊己庚辛壬癸"
SURNAMES = "张王李赵陈刘杨黄周吴"
TITLES = ["后端开发工程师", "前端开发工程师", "测试工程师", "运维工程师", "数据分析师", "产品经理"]
MAJORS = ["软件工程", "通信工程", "信息管理与信息系统", "工商管理"]
SKILLS = ["Java", "Python", "MySQL", "Redis", "Linux", "Docker", "HTML/CSS", "Spring Boot"]
BULLETS = ["· 负责核心模块的设计与开发", "· 参与需求评审并推动上线", "· 优化流程并整理文档"]
_FILES = "file STRING, content BINARY"


def _one(values: list[str] | str, r: Column) -> Column:
    """The value at the place r in [0, 1)."""
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(r * len(values)) + 1).cast("int"))


def _letters(n: Column) -> Column:
    return F.concat(*(_one(CHARACTERS, F.pmod(F.floor(n / k), F.lit(10)) / 10) for k in (1, 10)))


def _month(n: Column) -> Column:
    """YYYY-MM of months counted from the year 0."""
    return F.format_string("%04d-%02d", F.floor(n / 12).cast("int"), (F.pmod(n, F.lit(12)) + 1).cast("int"))


def versions(spark: SparkSession, persons: int, seed: str) -> DataFrame:
    """Everyone's resumes (pid, v): what is true of each. A later version keeps the past, closes the last job and adds one, and may change contacts and wishes."""
    pid, draw = F.col("pid"), lambda what, *more: fraction(f"{seed}|{what}", F.col("pid"), *more)
    base = spark.range(1, persons + 1).withColumnRenamed("id", "pid").withColumn("fresh", draw("template") < FRESH)
    base = generation.quota(base, "pid", [], MULTIPLE, f"{seed}|multi", "multi")
    base = generation.quota(base, "pid", ["multi"], THIRD, f"{seed}|third", "third")
    base = generation.weighted_choice(base, "pid", [("大专", 0.2), ("本科", 0.5), ("硕士", 0.3)], f"{seed}|degree", "degree")
    base = base.withColumn("versions", F.when(~F.col("multi"), 1).when(F.col("third") & ~F.col("fresh"), 3).otherwise(2))
    base = base.withColumn("name", F.concat(_one(SURNAMES, F.pmod(F.floor(pid / 100), F.lit(10)) / 10), _letters(pid)))
    base = generation.homonyms(base, "pid", [p for p in HOMONYMS if p[1] <= persons])
    base = base.withColumn("graduated", F.when(F.col("fresh"), F.lit(2026 * 12 + 5)).otherwise(2014 * 12 + 5 + 12 * F.floor(draw("year") * 10)))
    # a job for each of the first two, and another for each later version, one after the other
    jobs = base.select("pid", "fresh", "graduated", F.explode(F.sequence(F.lit(1), F.col("versions") + 1)).alias("k"))
    jobs = jobs.withColumn("company", F.concat(_letters(F.floor(draw("company", F.col("k")) * 100)), _one(["数据", "信息", "科技", "软件"], F.pmod(F.col("k"), F.lit(4)) / 4)))
    jobs = generation.independent(jobs, "pid", [p for p in HOMONYMS if p[1] <= persons])
    opened = F.col("graduated") - F.when(F.col("fresh"), 18).otherwise(-1) + (F.col("k") - 1) * F.when(F.col("fresh"), 4).otherwise(14)
    job = F.struct("k", "company", _one(TITLES, draw("title", F.col("k"))).alias("title"), opened.alias("start"), (opened + F.when(F.col("fresh"), 3).otherwise(12)).alias("end"))
    held = jobs.select("pid", job.alias("job")).groupBy("pid").agg(F.array_sort(F.collect_list("job")).alias("all"))
    rows = base.join(held, "pid").withColumn("v", F.explode(F.sequence(F.lit(1), F.col("versions"))))
    so_far = F.filter("all", lambda j: j["k"] <= F.col("v") + 1)
    last = F.array_max(F.transform(so_far, lambda j: j["k"]))
    shown = F.transform(so_far, lambda j: F.struct(j["company"].alias("company"), j["title"].alias("title"), _month(j["start"]).alias("start"), F.when((j["k"] < last) | F.col("fresh"), _month(j["end"])).alias("end")))
    moved = lambda what, rate: F.size(F.filter(F.sequence(F.lit(1), F.col("v")), lambda k: (k > 1) & (draw(what, k) < rate)))
    known = F.filter(F.array(*map(F.lit, SKILLS)), lambda s: (draw("skill", s) < 0.5) | (draw("later", s) < 0.1 * (F.col("v") - 1)))
    number = F.format_string("199%07d%d", F.pmod(pid, F.lit(10_000_000)), moved("phone", PHONE_CHANGES))
    return rows.select(
        "pid", "v", "versions", "fresh", "name", number.alias("phone"), F.format_string("p%d.%d@example.com", pid, moved("email", EMAIL_CHANGES)).alias("email"), "degree",
        F.concat(_letters(F.floor(draw("school") * 100)), F.lit("学院")).alias("school"), _one(MAJORS, draw("major")).alias("major"), _month(F.col("graduated")).alias("graduation"),
        _one(TITLES, draw("desired", moved("wish", DESIRED_CHANGES))).alias("desired"), shown.alias("jobs"), F.when(F.size(known) > 0, known).otherwise(F.array(F.lit(SKILLS[0]))).alias("skills"),
        F.when(draw("certificates") < 0.7, F.array(F.lit("CET-4"), F.lit("CET-6"))).otherwise(F.array().cast("array<string>")).alias("certificates"))


def as_files(rows: DataFrame, seed: str) -> DataFrame:
    """versions() with what each file lacks (null), its name, format, layout, noise and lines."""
    rows = rows.withColumn("key", F.format_string("p%03d_r%02d_v%d", "pid", "v", "v"))
    rows = generation.missing_flags(rows, "key", MISSING, f"{seed}|missing")
    for name in MISSING:
        none = F.array().cast("array<string>") if name == "certificates" else F.lit(None).cast("string")
        rows = rows.withColumn(name, F.when(F.col(f"no_{name}"), none).otherwise(F.col(name))).drop(f"no_{name}")
    rows = generation.quota(rows, "key", [], PDF, f"{seed}|format", "is_pdf")
    rows = generation.quota(rows, "key", ["is_pdf"], DOCX / (1 - PDF), f"{seed}|format 2", "is_docx")
    rows = rows.withColumn("format", F.when(F.col("is_pdf"), "pdf").when(F.col("is_docx"), "docx").otherwise("txt")).drop("is_pdf", "is_docx")
    only = {"crlf": "txt", "gbk_encoding_txt": "txt", "docx_table": "docx"}
    noise = [F.when((fraction(f"{seed}|{n}", F.col("key")) < rate) & (F.col("format") == only[n] if n in only else F.lit(True)), n) for n, rate in NOISE.items()]
    rows = rows.withColumn("noise", F.array_compact(F.array(*noise))).withColumn("layout", F.when(fraction(f"{seed}|layout", F.col("key")) < 0.5, "labeled").otherwise("sectioned"))
    rows = rows.withColumn("chinese", fraction(f"{seed}|dates", F.col("key")) < 0.3).withColumn("lines", generation.resume_lines(seed, BULLETS))
    return rows.withColumn("file", F.concat_ws(".", "key", "format"))


def rendered(files: DataFrame) -> DataFrame:
    """file and content of as_files()."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def body(r) -> bytes:
            lines = list(r.lines)
            if r.format == "pdf":
                return rendering.pdf_bytes(lines)
            if r.format == "docx":
                return rendering.docx_bytes(lines, "docx_table" in r.noise)
            return rendering.text_bytes(lines, "crlf" in r.noise, "gbk_encoding_txt" in r.noise)
        for batch in batches:
            yield pd.DataFrame({"file": batch["file"], "content": [body(r) for r in batch.itertuples()]})
    ship(files.sparkSession)
    return files.select("file", "format", "noise", "lines").mapInPandas(run, _FILES)


def write_sample(spark: SparkSession, data: str, persons: int, seed: str) -> dict:
    """Writes resumes/ and truth.json under data and returns a summary; a sample is small, so the driver writes its files."""
    if persons < 1:
        raise ValueError("a sample has one person at least")
    files = stored(as_files(versions(spark, persons, seed), seed), "sample")
    os.makedirs(f"{data}/resumes", exist_ok=True)
    for r in rendered(files).toLocalIterator():
        with open(f"{data}/resumes/{r.file}", "wb") as f:
            f.write(r.content)
    people: dict[int, dict] = {}
    for r in files.drop("lines").orderBy("pid", "v").toLocalIterator():
        fields = {k: r[c] for k, c in (("name", "name"), ("phone", "phone"), ("email", "email"), ("degree", "degree"), ("school", "school"), ("major", "major"), ("graduation_date", "graduation"), ("desired_position", "desired")) if r[c]}
        entry = {"file": r.file, "format": r.format, "layout": r.layout, "noise": list(r.noise), "truth_fields": fields, "truth_experiences": [j.asDict() for j in r.jobs], "truth_skills": list(r.skills), "truth_certificates": list(r.certificates)}
        if r.format == "txt":
            entry["encoding"] = "gbk" if "gbk_encoding_txt" in r.noise else "utf-8"
        id_ = f"p{r.pid:03d}"
        people.setdefault(r.pid, {"person_id": id_, "same_person_group": id_, "template": "fresh" if r.fresh else "working", "name": r.name, "resumes": []})["resumes"].append(entry)
    alike = [[f"p{k:03d}" for k in p] for p in HOMONYMS if p[1] <= persons]
    relations = {"same_person_groups": [[p["person_id"]] for p in people.values()], "homonym_groups": alike}
    with open(f"{data}/truth.json", "w", encoding="utf-8") as f:
        json.dump({"truth_version": 1, "seed": seed, "persons": list(people.values()), "relations": relations}, f, ensure_ascii=False, indent=1)
    return counted(files) | {"homonym_groups": len(alike)}


def counted(files: DataFrame) -> dict:
    """persons, files, by_format and multi_version_persons of files (pid, format)."""
    formats = {r.format: r["count"] for r in files.groupBy("format").count().collect()}  # as many rows as there are formats
    own = files.groupBy("pid").agg(F.count("*").alias("n")).agg(F.count("*").alias("persons"), F.count_if(F.col("n") > 1).alias("several")).first()
    return {"persons": own.persons, "files": sum(formats.values()), "by_format": dict(sorted(formats.items())), "multi_version_persons": own.several}
