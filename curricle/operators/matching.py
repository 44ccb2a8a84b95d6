"""Which records are of the same person: blocking, scores, decisions and clusters.

A pair that is not clearly different shares a phone number, an email address, a name (or name key) or the whole history of employment: without
a common name, only equal companies and equal months (0.4) with equal other fields (0.2) reach the lower threshold. So candidates come
from equi-joins on these keys, and what they decide is what comparing all pairs would. Sharing a single company is a wider block of the same use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..types import AUTO, MANUAL, NAME_EQUAL, NAME_KEY, WEIGHT_COMPANY, WEIGHT_EXPERIENCE, WEIGHT_NAME, WEIGHT_OTHER, WEIGHT_TIME
from ..storage import stored
from .blocking import pairs_within
from .graph import components
from .intervals import merged, overlap_of_pairs

OTHER_FIELDS = ["school", "major", "desired"]


def normalize_phone(x: Column) -> Column:
    return F.nullif(F.regexp_replace(x, r"(?U)\D", ""), F.lit(""))


def normalize_email(x: Column) -> Column:
    return F.nullif(F.lower(strip(x)), F.lit(""))


def prepared(profiles: DataFrame) -> DataFrame:
    """Profiles (pid, name, phone, email, school, major, desired and perhaps name_keys) with contacts in normal form and blanks as null."""
    keys = F.col("name_keys") if "name_keys" in profiles.columns else F.array().cast("array<string>")
    blank = lambda c: F.nullif(strip(F.col(c)), F.lit("")).alias(c)
    return profiles.select("pid", blank("name"), normalize_phone(F.col("phone")).alias("phone"), normalize_email(F.col("email")).alias("email"),
                           *(blank(c) for c in OTHER_FIELDS), F.coalesce(keys, F.array().cast("array<string>")).alias("name_keys"))


def histories(jobs: DataFrame) -> DataFrame:
    """(pid, key): the set of companies and the merged months of people who have both. A part that has no month overlaps nothing and doesn't count."""
    companies = jobs.groupBy("pid").agg(F.array_sort(F.filter(F.collect_set(strip(F.col("company"))), lambda c: c != "")).alias("c")).where("size(c) > 0")
    months = merged(jobs.where("s is not null").select("pid", "s", "e"), ["pid"]).where("e > s").groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("m"))
    return companies.join(months, "pid").select("pid", F.to_json(F.struct("c", "m")).alias("key"))


def blocks(profiles: DataFrame, jobs: DataFrame, by: str | None = "history") -> DataFrame:
    """(kind, key, pid): what each profile may meet another by: contacts and names, and by `history`, by any `company` or (None) by no employment."""
    p = prepared(profiles)
    rows = p.select(F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("key")) for c in ("phone", "email", "name")))).alias("k"), "pid")
    rows = rows.select("k.kind", "k.key", "pid").unionByName(p.select(F.lit("name_key").alias("kind"), F.explode("name_keys").alias("key"), "pid"))
    if by == "company":
        rows = rows.unionByName(jobs.select(F.lit("company").alias("kind"), strip(F.col("company")).alias("key"), "pid"))
    elif by == "history":
        rows = rows.unionByName(histories(jobs).select(F.lit("history").alias("kind"), "key", "pid"))
    return rows.where("key is not null and key != ''").distinct()


def candidate_pairs(profiles: DataFrame, jobs: DataFrame, by: str | None = "history") -> DataFrame:
    """(a, b) with a < b of all pairs that share a block. The pairs of a common name are dealt over all tasks."""
    return pairs_within(blocks(profiles, jobs, by), ["kind", "key"]).select("a", "b").distinct()


def rounded4(x: Column) -> Column:
    """To four decimals, by the same floating-point steps in every engine."""
    return F.floor(x * 10000 + 0.5) / F.lit(10000.0)


def pair_scores(pairs: DataFrame, profiles: DataFrame, jobs: DataFrame) -> DataFrame:
    """Pairs (a, b) with name_score, jaccard, iou, experience, other, score, key1 and forced_apart. jobs: pid, company, s, e."""
    p = prepared(profiles)
    companies = jobs.groupBy("pid").agg(F.filter(F.collect_set(strip(F.col("company"))), lambda c: c != "").alias("companies"))
    p = p.join(companies, "pid", "left").withColumn("companies", F.coalesce("companies", F.array().cast("array<string>")))
    rows = overlap_of_pairs(pairs, jobs.select("pid", "s", "e"), "pid")
    for k in "ab":
        rows = rows.join(p.select(F.col("pid").alias(k), F.struct(*p.columns).alias(f"p{k}")), k)
    a, b = F.col("pa"), F.col("pb")
    equal = a["name"] == b["name"]
    near = F.arrays_overlap(a["name_keys"], b["name_keys"])
    name = F.when(equal, NAME_EQUAL).when(near, NAME_KEY).otherwise(0.0)
    shared, union = F.size(F.array_intersect(a["companies"], b["companies"])), F.size(F.array_union(a["companies"], b["companies"]))
    jaccard = F.when((F.size(a["companies"]) > 0) & (F.size(b["companies"]) > 0), shared / union.cast("double")).otherwise(0.0)
    common = sum((F.when(a[c].isNotNull() & b[c].isNotNull(), 1).otherwise(0) for c in OTHER_FIELDS), F.lit(0))
    same = sum((F.when(a[c] == b[c], 1).otherwise(0) for c in OTHER_FIELDS), F.lit(0))
    key1 = F.coalesce(a["phone"] == b["phone"], F.lit(False)) | F.coalesce(a["email"] == b["email"], F.lit(False))
    rows = rows.select("a", "b", "iou", name.alias("name_score"), jaccard.alias("jaccard"), key1.alias("key1"),
                       F.when(common > 0, same / common.cast("double")).otherwise(0.5).alias("other"),
                       F.coalesce((a["phone"] != b["phone"]) & (a["email"] != b["email"]), F.lit(False)).alias("contacts_differ"))
    rows = rows.withColumn("experience", F.when(F.col("jaccard") > 0, WEIGHT_COMPANY * F.col("jaccard") + WEIGHT_TIME * F.col("iou")).otherwise(0.0))
    rows = rows.withColumn("score", rounded4(WEIGHT_NAME * F.col("name_score") + WEIGHT_EXPERIENCE * F.col("experience") + WEIGHT_OTHER * F.col("other")))
    forced = (F.col("name_score") > 0) & F.col("contacts_differ") & (F.col("jaccard") == 0)
    return rows.withColumn("forced_apart", forced).drop("contacts_differ")


def decided(scores: DataFrame) -> DataFrame:
    """scores with decision (auto_merge, manual_review, different_person); an equal contact makes the score 1."""
    score = F.when(F.col("key1"), 1.0).otherwise(F.col("score"))
    tier = F.when(score >= AUTO, "auto_merge").when(score >= MANUAL, "manual_review").otherwise("different_person")
    return scores.withColumn("decision", F.when(F.col("forced_apart"), "different_person").when(F.col("key1"), "auto_merge").otherwise(tier)).withColumn("score", score)


def decisions(profiles: DataFrame, jobs: DataFrame) -> DataFrame:
    return decided(pair_scores(candidate_pairs(profiles, jobs), profiles, jobs))


def cluster_links(profiles: DataFrame, jobs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose components are those of all automatic merges. People that share a contact are all merged, so each is linked with the least
    of its contact alone; other pairs are those that share a name or a name key, as nothing else reaches the tier."""
    rows = blocks(profiles, jobs, by=None)
    least = rows.where("kind in ('phone', 'email')").groupBy("kind", "key").agg(F.min("pid").alias("a"), F.count("*").alias("n")).where("n > 1")
    near = rows.alias("x").join(least.alias("y"), F.expr("x.kind = y.kind and x.key = y.key and x.pid != y.a"))
    stars = near.select("y.a", F.col("x.pid").alias("b"))
    pairs = pairs_within(rows.where("kind in ('name', 'name_key')"), ["kind", "key"]).select("a", "b").distinct()
    merged_ = decided(pair_scores(stored(pairs, "named-pairs"), profiles, jobs)).where("decision = 'auto_merge'").select("a", "b")
    return stars.unionByName(merged_).distinct().withColumn("decision", F.lit("auto_merge"))


def best_matches(pairs: DataFrame) -> DataFrame:
    """For each b, the a with the highest score among those not different; of equals, the least."""
    order = Window.partitionBy("b").orderBy(F.desc("score"), "a")
    return pairs.where("decision != 'different_person'").withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def clusters(profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """pid and cluster: the least pid that automatic merges lead to."""
    group = components(pairs.where("decision = 'auto_merge'").select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")))
    return profiles.select("pid").join(group, F.col("pid") == F.col("id"), "left").select("pid", F.coalesce("component", "pid").alias("cluster"))


def name_keys(names: DataFrame, readings: DataFrame, most: int = 16) -> DataFrame:
    """name, keys: of each distinct name of a column `name`, its full readings and their initials, each once, sorted.

    readings: char, reading, place (0: the usual one). A character without readings stands for itself. All readings of all characters are
    multiplied out while that makes at most `most` full readings; from there on, characters take their usual one. A table of readings
    has no more rows than Unicode has characters and their readings, but it is joined as its size says.
    """
    own = names.select(strip(F.col("name")).alias("name")).where("name is not null and name != ''").distinct()
    each = own.select("name", F.posexplode(F.expr("sequence(1, length(name))")).alias("at", "i")).select("name", "at", F.expr("substring(name, i, 1)").alias("c"))
    known = readings.where("reading is not null and reading != ''").groupBy("char").agg(
        F.transform(F.array_sort(F.collect_set(F.struct("place", "reading"))), lambda r: r["reading"]).alias("r"))
    told = each.join(known, F.col("c") == F.col("char"), "left").select("name", "at", F.array_distinct(F.coalesce("r", F.array("c"))).alias("r"))
    letters = told.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "r"))), lambda x: x["r"]).alias("of"))
    start = F.array(F.struct(F.lit("").alias("full"), F.lit("").alias("initials")))

    def longer(done: Column, r: Column) -> Column:
        r = F.when(F.size(done) * F.size(r) <= most, r).otherwise(F.slice(r, 1, 1))
        return F.flatten(F.transform(done, lambda d: F.transform(r, lambda x: F.struct(F.concat(d["full"], x).alias("full"), F.concat(d["initials"], F.substring(x, 1, 1)).alias("initials")))))

    full = F.aggregate("of", start, longer)
    return letters.select("name", F.array_sort(F.array_distinct(F.concat(F.transform(full, lambda x: x["full"]), F.transform(full, lambda x: x["initials"])))).alias("keys"))


def with_name_keys(profiles: DataFrame, readings: DataFrame, most: int = 16) -> DataFrame:
    """profiles with the column name_keys that blocks() and pair_scores() read."""
    keys = name_keys(profiles.select("name"), readings, most).select(F.col("name").alias("__name"), F.col("keys").alias("name_keys"))
    return profiles.drop("name_keys").join(keys, strip(F.col("name")) == F.col("__name"), "left").drop("__name")
