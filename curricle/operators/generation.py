"""Deterministic choices for synthetic data, from hashes of ids so that they don't depend on order or engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def fraction(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) from an MD5 of the seed and the keys."""
    text = F.concat_ws("|", F.lit(seed), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def weighted_choice(rows: DataFrame, key: str, weights: list[tuple[str, float]], seed: str, out: str = "choice") -> DataFrame:
    """rows with one of the values, by its weight: the first whose cumulative weight reaches the hash."""
    total = sum(w for _, w in weights)
    r, so_far, choice = fraction(seed, F.col(key)) * F.lit(float(total)), 0.0, None
    for value, weight in weights[:-1]:
        so_far += weight
        hit = r <= F.lit(float(so_far))
        choice = F.when(hit, value) if choice is None else choice.when(hit, value)
    last = F.lit(weights[-1][0])
    return rows.withColumn(out, last if choice is None else choice.otherwise(last))


def cumulative(weights: DataFrame, value: str = "value", weight: str = "weight") -> tuple[DataFrame, int]:
    """value, lo, hi: whole weights of distinct values laid end to end in the order of the values, and their sum. Values without weight are left out.

    Values are sorted over all tasks; each task sums its own, and the driver sees one sum for each, at most.
    """
    own = weights.groupBy(F.col(value).alias("value")).agg(F.sum(F.col(weight).cast("bigint")).alias("w")).where("w > 0 and value is not null")
    rows = stored(own.orderBy("value").withColumn("__p", F.shiftright(F.monotonically_increasing_id(), 33)), "weights")
    before, total = {}, 0
    for r in sorted(rows.groupBy("__p").agg(F.sum("w").alias("w")).collect()):
        before[r["__p"]] = total
        total += r["w"]
    if not before:
        return rows.select("value", F.col("w").alias("lo"), F.col("w").alias("hi")), 0
    base = F.element_at(F.create_map(*(F.lit(v) for kv in before.items() for v in kv)), F.col("__p")).cast("bigint")
    hi = base + F.sum("w").over(Window.partitionBy("__p").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select("value", (hi - F.col("w")).alias("lo"), hi.alias("hi")), total


def draw(seed: str, key: Column, total: int) -> Column:
    """A whole number in [0, total) from 60 bits of an MD5 of the seed and the key."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"))), 1, 15), 16, 10).cast("decimal(19,0)")
    return F.call_function("div", h * F.lit(total).cast("decimal(18,0)"), F.lit(1 << 60).cast("decimal(19,0)"))


def drawn(rows: DataFrame, key: str, weights: DataFrame, seed: str, value: str = "value", weight: str = "weight", out: str = "choice", places: int = 1 << 20) -> DataFrame:
    """rows with one of the values of a table of whole weights, each by its weight; null where no value has any.

    The weights lie end to end on a line that is cut in equal places, as many as there are values (at most `places`). A draw is joined with the intervals
    that its place touches and keeps the one that holds it. A heavy value lies over many places, so no join key is hot.
    """
    spans, total = cumulative(weights, value, weight)
    if not total:
        return rows.withColumn(out, F.lit(None).cast(weights.schema[value].dataType))
    width = max(1, -(-total // max(1, min(places, spans.count()))))
    spans = spans.withColumn("__place", F.explode(F.expr(f"sequence(lo div {width}L, (hi - 1) div {width}L)")))
    at = rows.withColumn("__x", draw(seed, F.col(key), total)).withColumn("__at", F.expr(f"__x div {width}L"))
    met = at.join(spans, F.expr("__at = __place and __x >= lo and __x < hi"))
    return met.select(*(F.col(f"`{c}`") for c in rows.columns), F.col("value").alias(out))


def quota(rows: DataFrame, key: str, strata: list[str], share: float, seed: str, out: str = "chosen") -> DataFrame:
    """rows with a boolean: of each stratum of n rows, exactly round(n * share) are true, those of the least hashes.

    Ranks are counted by ranges of the hash first, so that a large stratum isn't sorted in one task.
    """
    rows = rows.withColumn("__h", F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))).withColumn("__b", F.substring("__h", 1, 3))
    counts = rows.groupBy(*strata, "__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*strata)
    before = F.coalesce(F.sum("__n").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*strata, "__b", before.alias("__before"), F.sum("__n").over(w).alias("__of"))
    rank = F.row_number().over(Window.partitionBy(*strata, "__b").orderBy("__h", key)) + F.col("__before")
    out_rows = rows.join(counts, [*strata, "__b"]).withColumn(out, rank <= F.floor(F.col("__of") * F.lit(float(share)) + F.lit(0.5)))
    return out_rows.drop("__h", "__b", "__before", "__of")


def month_add(y: Column, m: Column, delta: Column) -> Column:
    """STRUCT<y, m> after so many months."""
    total = y * 12 + m - 1 + delta
    return F.struct(F.floor(total / 12).cast("int").alias("y"), (F.pmod(total, F.lit(12)) + 1).cast("int").alias("m"))


def missing_flags(rows: DataFrame, key: str, rates: dict[str, float], seed: str) -> DataFrame:
    """rows with `no_<field>` for each field: true for about its share of the keys, each field by itself."""
    return rows.withColumns({f"no_{f}": fraction(f"{seed}|{f}", F.col(key)) < F.lit(r) for f, r in rates.items()})


def noisy_line(text: Column, spaces: Column, wide: Column) -> Column:
    """A line with a space after its third character and full-width digits, where the flags say so."""
    text = F.when(spaces & (F.length(text) > 3), F.concat(F.substring(text, 1, 3), F.lit(" "), F.substring(text, F.lit(4), F.length(text)))).otherwise(text)
    return F.when(wide, F.translate(text, "0123456789", "０１２３４５６７８９")).otherwise(text)


def resume_lines(seed: str, bullets: list[str]) -> Column:
    """ARRAY<STRING>: the lines of a resume (key, name, phone, email, degree, school, major, graduation, desired, jobs: ARRAY<STRUCT<company, title,
    start, end>>, skills, certificates, fresh, layout, chinese: dates with ideographs, noise). Null fields and empty lists have no line.

    Layout `labeled` has a label before each field, `sectioned` has headed sections and one line for the education. A job stands as three
    lines, or as one with its dates first or last.
    """
    def day(x: Column) -> Column:
        return F.when(F.col("chinese"), F.concat(F.substring(x, 1, 4), F.lit("年"), F.substring(x, 6, 2).cast("int").cast("string"), F.lit("月"))).otherwise(x)

    def between(a: Column, b: Column) -> Column:
        return F.concat(day(a), F.when(b.isNull(), " 至今").otherwise(F.concat(F.when(F.col("chinese"), "至").otherwise(" - "), day(b))))

    def label(name: str, c: str, value: Column | None = None) -> Column:
        return F.when(F.col(c).isNotNull(), F.concat(F.lit(name + "："), F.col(c) if value is None else value))

    def one(j: Column, i: Column) -> Column:
        time, r = between(j["start"], j["end"]), fraction(f"{seed}|shape", F.col("key"), i)
        three = F.array(j["company"], F.concat(F.lit("职位："), j["title"]), F.concat(F.lit("时间："), time))
        single = F.when(r < 0.5, F.concat_ws("  ", time, j["company"], j["title"])).otherwise(F.concat_ws(" | ", j["company"], j["title"], time))
        told = F.element_at(F.array(*map(F.lit, bullets)), (F.floor(r * len(bullets)) + 1).cast("int"))
        return F.concat(F.when(F.array_contains("noise", "multiline_experience"), three).otherwise(F.array(single)), F.array(told))

    header, jobs = F.when(F.col("fresh"), "实习经历").otherwise("工作经历"), F.flatten(F.transform("jobs", one))
    skills, shown = F.array_join("skills", "、"), F.size("certificates") > 0
    certificates = F.when(shown, F.array_join("certificates", "、"))
    fields = F.array(label("姓名", "name"), label("电话", "phone"), label("邮箱", "email"), label("学历", "degree"), label("毕业院校", "school"), label("专业", "major"), label("毕业时间", "graduation", day(F.col("graduation"))), label("期望职位", "desired"))
    labelled = F.concat(fields, F.array(F.lit("技能"), skills, header), jobs, F.array(F.when(shown, "证书"), certificates))
    head = lambda name, there: F.when(there, F.concat(F.lit("【"), name if isinstance(name, Column) else F.lit(name), F.lit("】")))
    contact = F.concat_ws(" | ", "phone", "email")
    begun = F.concat((F.substring("graduation", 1, 4).cast("int") - 4).cast("string"), F.lit("-09"))
    taught = F.concat_ws("  ", F.when(F.col("graduation").isNotNull(), between(begun, F.col("graduation"))), "school", "major")
    learnt = F.col("school").isNotNull() | F.col("major").isNotNull() | F.col("graduation").isNotNull()
    education = F.when(learnt, F.concat(taught, F.coalesce(F.concat(F.lit("（"), F.col("degree"), F.lit("）")), F.lit(""))))
    some, wish = F.lit(True), F.col("desired").isNotNull()
    sectioned = F.concat(F.array(F.col("name"), F.when(contact != "", contact), head("基本信息", F.col("degree").isNotNull()), label("学历", "degree"), head("教育背景", learnt), education, head("技能特长", some), skills, head(header, some)), jobs,
                         F.array(head("证书", shown), certificates, head("求职意向", wish), F.col("desired")))
    lines = F.array_compact(F.when(F.col("layout") == "labeled", labelled).otherwise(sectioned))

    def noisy(x: Column, i: Column) -> Column:
        r = fraction(f"{seed}|noise", F.col("key"), i)
        spaced = F.array_contains("noise", "pseudo_space") & (r < 0.3) & x.rlike("^..[\\x{4E00}-\\x{9FFF}]{2}")
        return noisy_line(x, spaced, F.array_contains("noise", "fullwidth_digit") & (r < 0.7) & ~x.contains("@"))
    return F.transform(lines, noisy)


def homonyms(people: DataFrame, key: str, pairs: list[tuple[int, int]], name: str = "name") -> DataFrame:
    """people, in which the second of each pair bears the name of the first. Pairs are a fixed list, so they are broadcast; what is found by them isn't."""
    spark = people.sparkSession
    given = spark.createDataFrame(pairs, "__first bigint, __second bigint")
    named = people.join(F.broadcast(given), F.col(key) == F.col("__first")).select(F.col("__second"), F.col(name).alias("__name"))
    return people.join(named, F.col(key) == F.col("__second"), "left").withColumn(name, F.coalesce("__name", name)).drop("__second", "__name")


def independent(jobs: DataFrame, key: str, pairs: list[tuple[int, int]], company: str = "company") -> DataFrame:
    """jobs, in which the second of each pair never worked where the first did."""
    given = F.broadcast(jobs.sparkSession.createDataFrame(pairs, "__first bigint, __second bigint"))
    taken = jobs.join(given, F.col(key) == F.col("__first")).select("__second", F.col(company).alias("__company")).distinct()
    return jobs.join(taken, (F.col(key) == F.col("__second")) & (F.col(company) == F.col("__company")), "left_anti")
