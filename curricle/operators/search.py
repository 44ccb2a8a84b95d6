"""Search over candidates: substrings, tags, filters and the first rows by years of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 50
#: What full-text search looks at, and the folders that postings fall into by their gram.
COLUMNS = ["name", "skills", "school", "major", "company"]
BUCKETS = 64


def search_documents(candidates: DataFrame, tags: DataFrame, jobs: DataFrame, key: str = "pid") -> DataFrame:
    """key, name, skills, school, major, company: what full-text search looks at. Skills and companies are sorted and joined by a space."""
    skills = tags.where("kind = 'skill'").groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("tag")), " ").alias("skills"))
    companies = jobs.where("company is not null").groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("company")), " ").alias("company"))
    return candidates.select(key, "name", "school", "major").join(skills, key, "left").join(companies, key, "left")


def contains_phrase(columns: list[str], query: str) -> Column:
    """The phrase is part of one of the columns, whatever its case."""
    q = F.lit(query.lower())
    return F.greatest(*(F.coalesce(F.lower(F.col(c)).contains(q), F.lit(False)) for c in columns), F.lit(False))


def full_text(documents: DataFrame, query: str, key: str = "pid") -> DataFrame:
    """Keys whose document has the phrase within one column."""
    return documents.where(contains_phrase(COLUMNS, query)).select(key)


def short_query(candidates: DataFrame, tags: DataFrame, jobs: DataFrame, query: str, key: str = "pid") -> DataFrame:
    """Keys by LIKE over name, school, major, desired position, companies and all tags (a % or _ of the query is a wildcard)."""
    like = lambda c: F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
    own = candidates.where(like("name") | like("school") | like("major") | like("desired")).select(key)
    return own.unionByName(jobs.where(like("company")).select(key)).unionByName(tags.where(like("tag")).select(key)).distinct()


def search(candidates: DataFrame, tags: DataFrame, jobs: DataFrame, query: str = "", degree: str | None = None, skill: str | None = None,
           min_years: float | None = None, limit: int | None = LIMIT, key: str = "pid", found: DataFrame | None = None) -> DataFrame:
    """Candidates that match, by years of work (most first) and key; three characters or more search the full text, fewer by LIKE, none take all.

    Full text is searched in `found`, the keys that an index has for the query, where that is given, else by a scan.
    """
    q, rows = (query or "").strip(), candidates
    if len(q) >= 3 and found is not None:
        rows = rows.join(found.select(key).distinct(), key, "left_semi")
    elif len(q) >= 3:
        rows = rows.join(full_text(search_documents(candidates, tags, jobs, key), q, key), key, "left_semi")
    elif q:
        rows = rows.join(short_query(candidates, tags, jobs, q, key), key, "left_semi")
    if degree:
        rows = rows.where(F.col("degree") == degree)
    if skill:
        rows = rows.join(tags.where(F.lower("tag") == skill.strip().lower()).select(key), key, "left_semi")
    if min_years is not None:
        rows = rows.where(F.col("years") >= min_years)
    return rows.orderBy(F.desc_nulls_last("years"), key).limit(limit or LIMIT)


def trigrams(x: Column) -> Column:
    n = F.length(x)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(x, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def trigram_index(documents: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(gram, key, col) of all lower-case trigrams; worth writing where many queries follow."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.lower(F.col(c)).alias("text")) for c in columns))).alias("x")
    rows = documents.select(key, each).select(key, "x.col", "x.text").where("text is not null")
    return rows.select(F.explode(trigrams(F.col("text"))).alias("gram"), key, "col")


def _grams(query: str) -> list[str]:
    q = query.lower()
    if len(q) < 3:
        raise ValueError("an index of trigrams needs three characters")
    return sorted({q[i: i + 3] for i in range(len(q) - 2)})


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def postings(documents: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(gram, col, key, version, bucket) of documents (key, version, columns): the rows that an index kept on disk gains by them."""
    rows = trigram_index(documents.withColumn(key, F.struct(key, "version")), columns, key)
    return rows.select("gram", "col", F.col(key)[key].alias(key), F.col(key)["version"].alias("version"), bucket(F.col("gram")).alias("bucket"))


def latest(documents: DataFrame, key: str) -> DataFrame:
    """The last version of each document: key, version, and the columns as a struct `text` (all null: the document is gone)."""
    columns = [F.col(c) for c in documents.columns if c not in (key, "version")]
    return documents.groupBy(key).agg(F.max("version").alias("version"), F.max_by(F.struct(*columns), "version").alias("text"))


def find(index: DataFrame, documents: DataFrame, query: str, key: str) -> DataFrame:
    """(key, col) that have the phrase, by a kept index of postings() and all versions of documents (key, version, columns).

    Only the folders of the query's grams are read. Postings of versions that a newer one has replaced count for nothing: a change
    of a document is deleted and inserted by adding its new version alone.
    """
    grams, phrase = _grams(query), query.lower()
    at = index.where(F.col("bucket").isin(*(bucket(F.lit(g)) for g in grams)) & F.col("gram").isin(grams))
    near = at.groupBy(key, "version", "col").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select(key, "version", "col")
    now = latest(documents.join(near.select(key).distinct(), key, "left_semi"), key)
    columns = [c for c in documents.columns if c not in (key, "version")]
    text = F.coalesce(*(F.when(F.col("col") == c, F.col("text")[c].cast("string")) for c in columns))
    return near.join(now, [key, "version"]).where(F.lower(text).contains(phrase)).select(key, "col")


def search_index(index: DataFrame, documents: DataFrame, query: str, key: str) -> DataFrame:
    """(key, col) that have the phrase: those with all of its trigrams, verified on the text."""
    grams = _grams(query)
    near = index.where(F.col("gram").isin(grams)).groupBy(key, "col").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select(key, "col")
    columns = [c for c in documents.columns if c != key]
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("text")) for c in columns))).alias("x")
    texts = documents.select(key, each).select(key, "x.col", "x.text")
    return near.join(texts, [key, "col"]).where(F.lower("text").contains(query.lower())).select(key, "col")
