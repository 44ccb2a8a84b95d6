"""JSON sources: truth files, job conditions and stored cards."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import once
from ..types import CARD, SCHEMA_VERSION

TRUTH_EXPERIENCE = "STRUCT<company: STRING, title: STRING, start: STRING, end: STRING>"
TRUTH = (f"seed LONG, persons ARRAY<STRUCT<person_id: STRING, same_person_group: STRING, name: STRING, resumes: ARRAY<STRUCT<file: STRING, format: STRING, layout: STRING, noise: ARRAY<STRING>, "
         f"encoding: STRING, truth_fields: MAP<STRING, STRING>, truth_experiences: ARRAY<{TRUTH_EXPERIENCE}>, truth_skills: ARRAY<STRING>, truth_certificates: ARRAY<STRING>>>>>, "
         "relations STRUCT<same_person_groups: ARRAY<ARRAY<STRING>>, homonym_groups: ARRAY<ARRAY<STRING>>>")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """One row for each resume of a truth file: person_id, grp, file, format, layout, truth_fields, truth_experiences, truth_skills, truth_certificates."""
    rows = spark.read.schema(TRUTH).option("multiLine", True).json(path).select(F.explode("persons").alias("p")).select("p.person_id", F.col("p.same_person_group").alias("grp"), F.explode("p.resumes").alias("r"))
    return rows.select("person_id", "grp", "r.file", "r.format", "r.layout", "r.truth_fields", "r.truth_experiences", "r.truth_skills", "r.truth_certificates")


def read_condition(text: str) -> dict:
    """A job condition from JSON: degree_min, years (min, max), must_have_skills, exclude_keywords; blanks are dropped, all are optional."""
    given = json.loads(text)
    if not isinstance(given, dict):
        raise ValueError("a job condition is a JSON object")
    return condition(given)


def condition(given: dict | None) -> dict:
    given = given or {}
    words = lambda k: [str(s).strip() for s in given.get(k) or [] if str(s).strip()]
    years = given.get("years") or {}
    return {"degree_min": given.get("degree_min") or None, "years": {k: years.get(k) for k in ("min", "max") if years.get(k) is not None},
            "must_have_skills": words("must_have_skills"), "exclude_keywords": words("exclude_keywords")}


def card_to_json(cards: DataFrame, out: str = "card_json") -> DataFrame:
    return cards.withColumn(out, F.to_json(F.struct(*cards.columns)))


def card_from_json(text: Column) -> Column:
    """A card of the schema version that this engine writes; other versions raise, text that isn't JSON is null."""
    kind = f"STRUCT<{', '.join(x.replace(' ', ': ', 1) for x in _split(CARD))}>"

    def checked(card: Column) -> Column:
        other = card["schema_version"].isNotNull() & (card["schema_version"] != SCHEMA_VERSION)
        return F.when(other, F.raise_error(F.concat(F.lit("card schema version "), card["schema_version"].cast("string"))).cast(kind)).otherwise(card)

    return once(F.from_json(text, CARD), checked)


def _split(ddl: str) -> list[str]:
    from ..operators.extract import _columns

    return _columns(ddl)
