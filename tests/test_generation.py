from collections import Counter

from curricle.operators import generation
from curricle.plans import sample
from pyspark.sql import functions as F


def test_choices_quotas_and_flags(spark):
    rows = spark.range(4000).withColumn("s", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)))
    out = generation.weighted_choice(rows, "id", [("a", 0.3), ("b", 0.45), ("c", 0.25)], "x")
    n = Counter(r.choice for r in out.collect())
    assert all(abs(n[k] / 4000 - w) < 0.03 for k, w in (("a", 0.3), ("b", 0.45), ("c", 0.25)))
    chosen = generation.quota(rows, "id", ["s"], 0.6, "x").groupBy("s").agg(F.count("*").alias("n"), F.count_if("chosen").alias("k")).collect()
    assert all(r.k == int(r.n * 0.6 + 0.5) for r in chosen)
    again = generation.quota(rows.repartition(5), "id", ["s"], 0.6, "x").where("chosen").select("id")
    assert again.exceptAll(generation.quota(rows, "id", ["s"], 0.6, "x").where("chosen").select("id")).count() == 0
    flags = generation.missing_flags(rows, "id", {"phone": 0.1, "email": 0.5}, "x").agg(F.avg(F.col("no_phone").cast("int")), F.avg(F.col("no_email").cast("int"))).first()
    assert abs(flags[0] - 0.1) < 0.03 and abs(flags[1] - 0.5) < 0.03


def test_months_noise_and_homonyms(spark):
    rows = spark.createDataFrame([(2020, 1, -1), (2020, 12, 1), (2020, 6, 30)], "y int, m int, d int")
    assert [tuple(r[0]) for r in rows.select(generation.month_add(F.col("y"), F.col("m"), F.col("d"))).collect()] == [(2019, 12), (2021, 1), (2022, 12)]
    t = spark.createDataFrame([("电话：1990", True, True), ("电话：1990", False, False), ("ab", True, False)], "t string, s boolean, w boolean")
    assert [r[0] for r in t.select(generation.noisy_line(F.col("t"), F.col("s"), F.col("w"))).collect()] == ["电话： １９９０", "电话：1990", "ab"]
    people = spark.createDataFrame([(1, "甲"), (2, "乙"), (3, "丙")], "id bigint, name string")
    assert {r.id: r.name for r in generation.homonyms(people, "id", [(1, 2)]).collect()} == {1: "甲", 2: "甲", 3: "丙"}
    jobs = spark.createDataFrame([(1, "A"), (2, "A"), (2, "B"), (3, "A")], "id bigint, company string")
    assert sorted(tuple(r) for r in generation.independent(jobs, "id", [(1, 2)]).collect()) == [(1, "A"), (2, "B"), (3, "A")]


def test_sample_of_all_formats_and_versions(spark):
    rows = sample.as_files(sample.versions(spark, 50, "7"), "7").collect()
    by_person = {}
    for r in rows:
        by_person.setdefault(r.pid, {})[r.v] = r
    assert len(by_person) == 50 and sum(len(v) > 1 for v in by_person.values()) == 30
    assert sum(len(v) == 3 for v in by_person.values()) <= 9 and all(len(v) < 3 for v in by_person.values() if v[1].fresh)
    n = Counter(r.format for r in rows)
    assert n["pdf"] == int(len(rows) * 0.4 + 0.5) and abs(n["docx"] - n["pdf"]) <= 1 and set(n) == {"pdf", "docx", "txt"}
    assert {r.layout for r in rows} == {"labeled", "sectioned"} and "pseudo_space" in {x for r in rows for x in r.noise} <= set(sample.NOISE)
    assert all(r.format == "txt" for r in rows if {"crlf", "gbk_encoding_txt"} & set(r.noise)) and all(r.format == "docx" for r in rows if "docx_table" in r.noise)
    for them in by_person.values():
        for v in range(2, len(them) + 1):  # the past stays, and skills are only added
            old, new = ([(j.company, j.title, j.start) for j in them[k].jobs] for k in (v - 1, v))
            assert new[: len(old)] == old and len(new) <= len(old) + 1 and set(them[v - 1].skills) <= set(them[v].skills)
    companies = {pid: {j.company for r in them.values() for j in r.jobs} for pid, them in by_person.items()}
    for a, b in (p for p in sample.HOMONYMS if p[1] <= 50):
        assert by_person[a][1]["name"] == by_person[b][1]["name"] and not companies[a] & companies[b]
    made = {r.file: bytes(r.content) for r in sample.rendered(sample.as_files(sample.versions(spark, 50, "7").repartition(3), "7")).collect()}
    assert made == {r.file: bytes(r.content) for r in sample.rendered(sample.as_files(sample.versions(spark, 50, "7"), "7")).collect()} and len(made) == len(rows)
