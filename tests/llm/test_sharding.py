from collections import Counter

from curricle.llm import sharding


def check(rows, shards, sources):
    by = Counter(r.shard for r in rows)
    assert max(by.values()) - min(by.get(s, 0) for s in range(shards)) <= 1
    for s in by:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(by[s]))
    n = Counter(r[sources] for r in rows)
    for (s, shard), k in Counter((r[sources], r.shard) for r in rows).items():
        assert abs(k - n[s] / shards) <= 1 + len(n) / 2


def test_mixture_counts_and_slots(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else concat('s', id % 5) end as source", "id as shard")
    rows = sharding.interleave(df, "source", ["doc_id"], 16, seed=3, range_bits=4).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    check(rows, 16, "source")
    again = sharding.interleave(df.repartition(7), "source", ["doc_id"], 16, seed=3, range_bits=4).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}
    other = sharding.interleave(df, "source", ["doc_id"], 16, seed=4).collect()
    assert {(r.doc_id, r.shard) for r in rows} != {(r.doc_id, r.shard) for r in other}


def test_odd_tables(odd, nothing):
    rows = sharding.interleave(odd, "source", ["doc_id"], 3).collect()
    assert len(rows) == 5 and sorted(Counter(r.shard for r in rows).values()) == [1, 2, 2]
    assert sharding.interleave(nothing, "source", ["doc_id"], 3).count() == 0


def test_query(spark, data):
    import zlib

    from curricle.llm.queries import op4_sharding

    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = op4_sharding(spark, data).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"rows"}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id])) for r in rows)
    by = Counter(r.shard for r in rows)
    assert set(by) == set(range(16)) and max(by.values()) - min(by.values()) <= 1
