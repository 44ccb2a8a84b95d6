"""A stream of versions gives what a batch over all of them gives, in any order of arrival."""

import random

import pytest
from curricle.operators import merging
from curricle.streaming import versions
from pyspark.sql import functions as F

FIELDS = ["name", "phone", "school"]
SCHEMA = "pid bigint, name string, phone string, school string, latest int, n_jobs int, parsed_at string, resume_id bigint"


@pytest.fixture
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", versions.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def made(seed, n=60):
    rng = random.Random(seed)
    pick = lambda *v: rng.choice(v)
    return [(rng.randrange(9), pick(None, "", f"n{i}"), pick(None, " ", f"p{i}"), pick(None, f"s{i}"), pick(None, 24000 + rng.randrange(5)), pick(0, 1, 2), pick(None, f"2026-0{rng.randrange(1, 5)}"), i) for i in range(1, n)]


def of_batch(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    age = F.struct(F.coalesce("latest", F.lit(-1)), F.coalesce("n_jobs", F.lit(0)), F.coalesce("parsed_at", F.lit("")), "resume_id")
    newest = df.groupBy("pid").agg(F.max(F.struct(F.coalesce("latest", F.lit(-1)), F.coalesce("n_jobs", F.lit(0)), F.coalesce("parsed_at", F.lit("")), "resume_id"))["resume_id"].alias("resume_id"))
    out = merging.latest_values(df, ["pid"], FIELDS, age).join(newest, "pid")
    return {r.pid: (r.name, r.phone, r.school, r.resume_id) for r in out.collect()}


@pytest.mark.parametrize("order", ["ascending", "descending", "shuffled"])
def test_any_order_gives_the_batch_result(spark, tmp_path, state_store, order):
    rows = made(3)
    arrived = {"ascending": rows, "descending": rows[::-1], "shuffled": random.Random(1).sample(rows, len(rows))}[order]
    seen, source = {}, str(tmp_path / "in")

    def keep(batch, _):
        for r in batch.collect():
            seen[r.pid] = (r.name, r.phone, r.school, r.resume_id)

    for k in range(0, len(arrived), 20):
        spark.createDataFrame(arrived[k: k + 20], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = versions.latest_versions(spark.readStream.schema(SCHEMA).parquet(source), "pid", FIELDS)
        stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    assert seen == of_batch(spark, rows)
