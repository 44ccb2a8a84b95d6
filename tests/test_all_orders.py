"""All orders of a customer are employments, whatever their number."""

from curricle import catalogue
from curricle.queries.common import jobs, table, tags


def test_no_order_is_left_out(spark, data):
    orders, lines, parts = (table(spark, data, n) for n in ("orders", "lineitem", "part"))
    assert jobs(spark, data).count() == orders.count()
    assert jobs(spark, data).agg({"rn": "max"}).first()[0] > 2
    brands = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey)
    assert tags(spark, data).count() == brands.selectExpr("o_custkey", "l_linenumber % 2", "p_brand").distinct().count()


def test_no_sql_leaves_rows_out():
    assert not [n for n, q in catalogue.ORACLES.items() if "rn<=" in q or "doc_id%5" in q or "doc_id%7" in q]
