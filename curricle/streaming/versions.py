"""The current record of each person from versions that arrive in any order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..shipping import ship

#: The state store that arbitrary state needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_AGE = ["latest", "n_jobs", "parsed_at", "resume_id"]


class Latest(StatefulProcessor):
    """Of one person, each field's value with the age of the version that it is from. A newer version overrules, an older one only fills gaps."""

    def __init__(self, key: str, fields: list[str]):
        self.key, self.fields = key, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        age = "STRUCT<latest: INT, n_jobs: INT, parsed_at: STRING, resume_id: BIGINT>"
        self.held = handle.getValueState("held", ", ".join([f"newest {age}", *(f"{f} STRING, age_{f} {age}" for f in self.fields)]))

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        old = self.held.get() if self.held.exists() else None
        ages = {f: tuple(old[2 + 2 * i]) if old is not None and old[2 + 2 * i] is not None else None for i, f in enumerate(self.fields)}
        values = {f: old[1 + 2 * i] if old is not None else None for i, f in enumerate(self.fields)}
        newest = tuple(old[0]) if old is not None else None
        for r in rows:
            age = (r.latest, r.n_jobs, r.parsed_at, r.resume_id)
            newest = age if newest is None or age > newest else newest
            for f in self.fields:
                if r[f] is not None and (ages[f] is None or age > ages[f]):
                    values[f], ages[f] = r[f], age
        self.held.update((newest, *(x for f in self.fields for x in (values[f], ages[f]))))
        yield Row(**{self.key: key[0], **values, **dict(zip(_AGE, newest, strict=True))})

    def close(self) -> None:
        pass


def latest_versions(versions: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A stream of key, fields and the age (latest, n_jobs, parsed_at, resume_id) of each person's current record, once for every batch that has versions of them.

    versions: a stream of key, fields and that age; blank fields are null by then. Late versions are welcome at any time: whatever the order,
    what comes last for a person equals merging.latest_values() over all versions. The state of a person is one row, and it
    is kept for good. The session needs STORE as its state store. Read it in the output mode `update`.
    """
    ship(versions.sparkSession)
    text = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string")).alias(c)
    rows = versions.select(F.col(key), *(text(f) for f in fields), F.coalesce(F.col("latest").cast("int"), F.lit(-1)).alias("latest"), F.coalesce(F.col("n_jobs").cast("int"), F.lit(0)).alias("n_jobs"),
                           F.coalesce("parsed_at", F.lit("")).alias("parsed_at"), F.coalesce(F.col("resume_id").cast("bigint"), F.lit(0)).alias("resume_id"))
    schema = StructType([rows.schema[c] for c in (key, *fields, *_AGE)])
    return rows.groupBy(key).transformWithState(Latest(key, fields), schema, "update", "none")
