"""Incremental import: files and records that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.store import PeopleStore
from ..sources.files import read_resumes

FILES = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"


def watch_folder(spark: SparkSession, folder: str, store: PeopleStore, checkpoint: str, parsed_at: str | None = None, once: bool = True) -> StreamingQuery:
    """Imports files into the store as they appear in a folder. Each batch goes through the same plan as import_files(), which drops files
    that the store has, so that a batch that is run again after a failure changes nothing."""
    source = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(folder)
    rows = source.select(F.col("path").alias("source_file"), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("file_type"), F.sha2("content", 256).alias("file_sha256"), "content", "modificationTime")

    def batch(files: DataFrame, _: int) -> None:
        at = F.lit(parsed_at) if parsed_at else F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss")
        times = files.select("source_file", at.alias("parsed_at"))
        parsed = read_resumes(files.drop("modificationTime")).join(times, "source_file")
        store.import_parsed(parsed, files.select("source_file", "content"))

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def first_arrivals(records: DataFrame, sha: str, at: str, late: str = "7 days") -> DataFrame:
    """A stream of records without those whose hash was seen; hashes are forgotten when they are older than `late`."""
    return records.withWatermark(at, late).dropDuplicatesWithinWatermark([sha])


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of a stream of events (ts, event_type, value) by windows of event time, each final once it is `late` behind."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")
