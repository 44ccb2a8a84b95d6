"""What a task makes of a small file is bounded by rows, and expressions evaluate their input once."""

from curricle.functions import lexicon, text
from curricle.queries import common
from curricle.sources.documents import card_from_json
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_rows_spread_by_their_number(spark):
    rows = spark.range(2500).coalesce(1)
    sizes = [r.n for r in common.spread(rows, "id", 500).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 2500 and len(sizes) == 5 and max(sizes) < 1000
    assert common.spread(rows.where("id < 0"), "id").count() == 0


def test_input_is_evaluated_once(spark):
    rows = spark.createDataFrame([("2022-07 - 2024-08",)], "x string").withColumn("y", F.concat(F.col("x"), F.lit("")))
    for f, most in ((text.parse_range, 1), (text.date_point, 1), (lambda x: text.split_content(x, lexicon.CERTIFICATES), 3), (lambda x: F.to_json(card_from_json(x)), 1)):
        assert plan(rows.select(f(F.upper("y")))).count("upper(") <= 2 * most  # the plan's text names a column once more


def test_white_space_of_all_scripts_goes(spark):
    white = [chr(i) for i in range(0x3100) if chr(i) in "\t\n\x0b\x0c\r \x85\xa0     　" or 0x2000 <= i <= 0x200A]
    df = spark.createDataFrame([(f"{c}a{c}b{c}",) for c in white] + [("\x1ca​",)], "x string")
    got = [r.y for r in df.select(text.strip(F.col("x")).alias("y")).collect()]
    assert got == [f"a{c}b" for c in white] + ["\x1ca​"]
