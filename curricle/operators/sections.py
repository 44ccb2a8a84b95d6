"""Lines of texts and the sections that they fall into."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_line, physical_lines, strip

#: Section headers and the keys that they open.
HEADERS = {"技能": "skills", "技能特长": "skills", "证书": "certs", "工作经历": "exp", "实习经历": "exp", "项目经验": "exp", "基本信息": "basic", "教育背景": "edu", "求职意向": "desired"}


def lines_of(texts: DataFrame, key: str = "source_file", text: str = "raw_text") -> DataFrame:
    """One row for each physical line: key, line_no (from 1), raw (stripped), text (normalised), location."""
    rows = texts.select(F.col(key), F.posexplode(physical_lines(F.col(text))).alias("line_no", "line"))
    return rows.select(key, (F.col("line_no") + 1).alias("line_no"), strip(F.col("line")).alias("raw"), normalize_line(F.col("line")).alias("text"),
                       F.concat(F.lit("L"), F.col("line_no") + 1).alias("location"))


def header_key(text):
    """The section that a line opens, bare or in brackets; null for any other line."""
    keys = F.create_map(*(F.lit(v) for kv in HEADERS.items() for v in kv))
    return F.coalesce(F.try_element_at(keys, text), F.try_element_at(keys, F.regexp_extract(text, r"^【([^】]+)】$", 1)))


def with_sections(lines: DataFrame, key: str = "source_file") -> DataFrame:
    """Content lines with section_no (0 before the first header) and section; headers and empty lines are left out.

    Headers open islands: their running count numbers the sections, and the last header seen names them.
    """
    rows = lines.where(F.col("text") != "").withColumn("__h", header_key(F.col("text")))
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("section_no", F.count("__h").over(so_far)).withColumn("section", F.last("__h", True).over(so_far))
    return rows.where(F.col("__h").isNull()).drop("__h")


def joined(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Wrapped lines as one: the texts in order without anything between, raw and location of the first."""
    return lines.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "").alias("text"),
        F.min(F.struct("line_no", "raw", "location")).alias("__f")).select(*keys, "text", "__f.raw", "__f.location")
