"""Audit of texts and files for personal data, and counts of what a purge would remove."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masking import HARD, binary_findings, line_findings, may_have_findings, not_allowed
from ..functions.text import physical_lines
from ..shipping import ship

#: Entries of archives that are scanned as text.
TEXT_ENTRIES = (".xml", ".rels")


def _long(rows: DataFrame, keys: list[str], counts: dict[str, Column]) -> DataFrame:
    each = F.array(*(F.struct(F.lit(k).alias("category"), c.cast("bigint").alias("n")) for k, c in counts.items()))
    return rows.select(*keys, F.explode(each).alias("c")).select(*keys, "c.category", "c.n").where("n > 0")


def audit_texts(texts: DataFrame, key: str, text: str, words: list[str] = ()) -> DataFrame:
    """(key, category, n) of all lines of each text; categories without findings are absent."""
    lines = texts.select(key, F.explode(physical_lines(F.col(text))).alias("line")).where(may_have_findings(F.col("line"), words))
    return _long(lines, [key], line_findings(F.col("line"), words)).groupBy(key, "category").agg(F.sum("n").alias("n"))


def audit_metadata(records: DataFrame, key: str, emails: list[str]) -> DataFrame:
    """(key, category, n) of addresses in columns of metadata (authors, committers) that aren't allowed."""
    return _long(records, [key], {"EMAIL_META": sum((not_allowed(F.col(c)).cast("int") for c in emails), F.lit(0))})


def is_binary(content: Column) -> Column:
    """There is a zero byte in the first 8 KiB."""
    return F.instr(F.decode(F.substring(content, 1, 8192), "ISO-8859-1"), "\0") > 0


def audit_files(files: DataFrame, key: str, content: str, words: list[str] = ()) -> DataFrame:
    """(key, category, n): text files by line, others by their bytes."""
    rows = files.withColumn("__binary", is_binary(F.col(content)))
    binary = _long(rows.where("__binary"), [key], binary_findings(F.col(content), words))
    texts = rows.where("not __binary").select(key, F.make_valid_utf8(F.col(content).cast("string")).alias("__text"))
    return binary.unionByName(audit_texts(texts, key, "__text", words)).groupBy(key, "category").agg(F.sum("n").alias("n"))


def archive_entries(files: DataFrame, key: str, content: str) -> DataFrame:
    """key (`file::entry`), content, as_text of the entries of zip files; what is no archive stays one entry."""
    ship(files.sparkSession)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, body in zip(batch["k"], batch["c"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(body))) as z:
                        for entry in z.namelist():
                            low = entry.lower()
                            yield pd.DataFrame({"k": [f"{name}::{entry}"], "c": [z.read(entry)], "t": [low.endswith(TEXT_ENTRIES) and "fonttable" not in low]})
                except zipfile.BadZipFile:
                    yield pd.DataFrame({"k": [name], "c": [bytes(body)], "t": [False]})

    return files.select(F.col(key).alias("k"), F.col(content).alias("c")).mapInPandas(unpack, "k string, c binary, t boolean").select(F.col("k").alias(key), F.col("c").alias(content), F.col("t").alias("as_text"))


def audit_archives(files: DataFrame, key: str, content: str, words: list[str] = ()) -> DataFrame:
    """(key, category, n) of each entry of zip files."""
    rows = archive_entries(files, key, content)
    binary = _long(rows.where("not as_text"), [key], binary_findings(F.col(content), words)).groupBy(key, "category").agg(F.sum("n").alias("n"))
    texts = rows.where("as_text").select(key, F.make_valid_utf8(F.col(content).cast("string")).alias("__text"))
    return binary.unionByName(audit_texts(texts, key, "__text", words))


def whitelist_status(files: DataFrame, allowed: DataFrame, key: str = "path", sha: str = "sha256") -> DataFrame:
    """(key, status) of binary files against registered hashes: OK, BINARY_UNREGISTERED or BINARY_HASH_MISMATCH."""
    known = allowed.select(F.col(key).alias("__k"), F.col(sha).alias("__sha"))
    status = F.when(F.col("__k").isNull(), "BINARY_UNREGISTERED").when(F.col("__sha") != F.col(sha), "BINARY_HASH_MISMATCH").otherwise("OK")
    return files.join(known, F.col(key) == F.col("__k"), "left").select(key, status.alias("status"))


def verdict(findings: DataFrame) -> DataFrame:
    """One row: n_hard and n_review findings, and exit_code 1 if any is hard."""
    hard = F.col("category").isin(HARD)
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    return findings.agg(n(hard).alias("n_hard"), n(~hard).alias("n_review")).withColumn("exit_code", (F.col("n_hard") > 0).cast("int"))


def purge_preview(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of what a purge would remove."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()))
