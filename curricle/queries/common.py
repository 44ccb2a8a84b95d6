"""Tables and views that queries share: people and their employments derived from customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one task takes of a small file whose rows grow into many: Parquet's splits go by bytes.
EACH_TASK = 10_000


def spread(rows: DataFrame, key: str, each_task: int = EACH_TASK) -> DataFrame:
    """rows over as many tasks as their number asks for: what a task makes of them doesn't grow with the table."""
    return rows.repartition(-(-rows.count() // each_task) or 1, key)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, grp (true person), name, phone, email, school, major, desired, degree, name_keys of each customer."""
    grp, r = F.floor(F.col("c_custkey") / 10).cast("int"), F.col("c_custkey") % 10
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    key = F.col("c_custkey").cast("string")
    g = grp.cast("string")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("pid"), grp.alias("grp"),
        F.when(r.isin(5, 6), text("h", g)).when(r >= 7, text("n", g)).otherwise(text("c", key)).alias("name"),
        F.when(r < 2, text("199000", F.lpad(g, 5, "0"))).when(r.isin(5, 6), text("199005", F.lpad(key, 5, "0"))).alias("phone"),
        F.when(r.isin(1, 2), text("e", g, "@example.com")).when(r.isin(5, 6), text("u", key, "@example.net")).alias("email"),
        text("S", (grp % 16).cast("string")).alias("school"), text("M", (grp % 2).cast("string")).alias("major"), (F.col("c_custkey") % 2).cast("string").alias("desired"),
        F.when(r == 0, "大专").when(r.isin(1, 2), "本科").when(r.isin(3, 4), "硕士").when(r == 5, "博士").when(r == 6, "其他").alias("degree"),
        F.when(r.isin(3, 4), F.array(text("k", g))).otherwise(F.array().cast("array<string>")).alias("name_keys"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, rn, company, s, e (month indexes): the orders of each customer as employments, numbered by order key."""
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate").withColumn("rn", rank)
    s = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    grp = F.floor(F.col("o_custkey") / 10).cast("int")
    company = F.when(F.col("o_custkey") % 10 == 5, F.concat(F.lit("X"), F.col("rn"))).otherwise(F.concat(F.lit("B"), (grp + F.col("rn")) % 40))
    return rows.select(F.col("o_custkey").alias("pid"), F.col("rn").cast("int").alias("rn"), company.alias("company"), s.cast("int").alias("s"), (s + 24 + F.col("o_orderkey") % 60).cast("int").alias("e"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, kind, tag: the brands that a customer's orders have, as skills (odd lines) or certificates (even lines)."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("o_custkey").alias("pid"), F.when(F.col("l_linenumber") % 2 == 1, "skill").otherwise("certificate").alias("kind"), F.col("p_brand").alias("tag")).distinct()


#: The same views as SQL.
VIEWS = """
profile AS (
  SELECT c_custkey AS pid, CAST(floor(c_custkey/10) AS INT) AS grp,
    CASE WHEN c_custkey%10 IN (5,6) THEN concat('h',CAST(floor(c_custkey/10) AS INT)) WHEN c_custkey%10>=7 THEN concat('n',CAST(floor(c_custkey/10) AS INT)) ELSE concat('c',c_custkey) END AS name,
    CASE WHEN c_custkey%10<2 THEN concat('199000',lpad(CAST(CAST(floor(c_custkey/10) AS INT) AS VARCHAR),5,'0')) WHEN c_custkey%10 IN (5,6) THEN concat('199005',lpad(CAST(c_custkey AS VARCHAR),5,'0')) END AS phone,
    CASE WHEN c_custkey%10 IN (1,2) THEN concat('e',CAST(floor(c_custkey/10) AS INT),'@example.com') WHEN c_custkey%10 IN (5,6) THEN concat('u',c_custkey,'@example.net') END AS email,
    concat('S',CAST(floor(c_custkey/10) AS INT)%16) AS school, concat('M',CAST(floor(c_custkey/10) AS INT)%2) AS major, CAST(c_custkey%2 AS VARCHAR) AS desired,
    CASE WHEN c_custkey%10=0 THEN '大专' WHEN c_custkey%10 IN (1,2) THEN '本科' WHEN c_custkey%10 IN (3,4) THEN '硕士' WHEN c_custkey%10=5 THEN '博士' WHEN c_custkey%10=6 THEN '其他' END AS degree,
    CASE WHEN c_custkey%10 IN (3,4) THEN concat('k',CAST(floor(c_custkey/10) AS INT)) END AS nk
  FROM customer),
ranked AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
expr AS (
  SELECT o_custkey AS pid, CAST(rn AS INT) AS rn, CASE WHEN o_custkey%10=5 THEN concat('X',rn) ELSE concat('B',(CAST(floor(o_custkey/10) AS INT)+rn)%40) END AS company,
    CAST(year(o_orderdate)*12+month(o_orderdate) AS INT) AS s, CAST(year(o_orderdate)*12+month(o_orderdate)+24+o_orderkey%60 AS INT) AS e
  FROM ranked),
tags AS (
  SELECT DISTINCT o_custkey AS pid, CASE WHEN l_linenumber%2=1 THEN 'skill' ELSE 'certificate' END AS kind, p_brand AS tag
  FROM ranked JOIN lineitem ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey),
p0 AS (SELECT pid,s,e,max(e) OVER (PARTITION BY pid ORDER BY s,e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM expr),
p1 AS (SELECT pid,s,e,sum(CASE WHEN pm IS NULL OR s>pm+1 THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY s,e ROWS UNBOUNDED PRECEDING) AS g FROM p0),
merged AS (SELECT pid,CAST(g AS INT) AS g,min(s) AS s,max(e) AS e FROM p1 GROUP BY pid,g),
span AS (SELECT pid,CAST(sum(e-s) AS BIGINT) AS n_months,round_even(sum(e-s)/12.0::DOUBLE,1) AS years FROM merged GROUP BY pid)
"""

#: Candidate pairs, their scores and decisions.
PAIRS = """,
blk AS (SELECT 'phone' AS kind, phone AS k, pid FROM profile WHERE phone IS NOT NULL UNION SELECT 'email', email, pid FROM profile WHERE email IS NOT NULL
        UNION SELECT 'name', name, pid FROM profile UNION SELECT 'name_key', nk, pid FROM profile WHERE nk IS NOT NULL UNION SELECT 'company', company, pid FROM expr),
pairs AS (SELECT DISTINCT x.pid AS a, y.pid AS b FROM blk x JOIN blk y ON x.kind=y.kind AND x.k=y.k AND x.pid<y.pid),
met AS (SELECT a,b,CAST(sum(greatest(0,least(x.e,y.e)-greatest(x.s,y.s))) AS BIGINT) AS shared FROM pairs JOIN merged x ON x.pid=a JOIN merged y ON y.pid=b GROUP BY a,b),
comp AS (SELECT pid, list_sort(list(DISTINCT company)) AS cs FROM expr GROUP BY pid),
iou AS (
  SELECT p.a,p.b,coalesce(shared,0) AS shared, CAST(coalesce(x.n_months,0)+coalesce(y.n_months,0)-coalesce(shared,0) AS BIGINT) AS total
  FROM pairs p LEFT JOIN met m ON p.a=m.a AND p.b=m.b LEFT JOIN span x ON x.pid=p.a LEFT JOIN span y ON y.pid=p.b),
sc0 AS (
  SELECT i.a,i.b,CASE WHEN total>0 THEN shared/total::DOUBLE ELSE 0.0::DOUBLE END AS iou, CASE WHEN x.name=y.name THEN 1.0::DOUBLE WHEN x.nk=y.nk THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS name_score,
    CASE WHEN len(cx.cs)>0 AND len(cy.cs)>0 THEN len(list_intersect(cx.cs,cy.cs))/len(list_distinct(list_concat(cx.cs,cy.cs)))::DOUBLE ELSE 0.0::DOUBLE END AS jaccard,
    coalesce(x.phone=y.phone,false) OR coalesce(x.email=y.email,false) AS key1,
    ((x.school=y.school)::INT+(x.major=y.major)::INT+(x.desired=y.desired)::INT)/3.0::DOUBLE AS other,
    coalesce(x.phone<>y.phone AND x.email<>y.email,false) AS apart
  FROM iou i JOIN profile x ON x.pid=i.a JOIN profile y ON y.pid=i.b LEFT JOIN comp cx ON cx.pid=i.a LEFT JOIN comp cy ON cy.pid=i.b),
sc1 AS (SELECT *, CASE WHEN jaccard>0 THEN 0.4::DOUBLE*jaccard+0.6::DOUBLE*iou ELSE 0.0::DOUBLE END AS experience FROM sc0),
sc AS (SELECT *, floor((0.4::DOUBLE*name_score+0.4::DOUBLE*experience+0.2::DOUBLE*other)*10000+0.5::DOUBLE)/10000.0::DOUBLE AS raw_score, name_score>0 AND apart AND jaccard=0 AS forced FROM sc1),
dec AS (
  SELECT *, CASE WHEN key1 THEN 1.0::DOUBLE ELSE raw_score END AS score,
    CASE WHEN forced THEN 'different_person' WHEN key1 OR raw_score>=0.85::DOUBLE THEN 'auto_merge' WHEN raw_score>=0.6::DOUBLE THEN 'manual_review' ELSE 'different_person' END AS decision FROM sc)
"""


def sql(body: str, pairs: bool = False, recursive: bool = False) -> str:
    """A query over the views. Blocks that aren't used cost nothing."""
    return f"WITH {'RECURSIVE' if recursive else ''} {VIEWS}{PAIRS if pairs else ''} {body}"
