"""Intervals, entity resolution, merging, search and screening over people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocking, evaluation, intervals, matching, merging, screening, search, sequential
from ..storage import scratch
from .common import jobs, profiles, spread, sql, table, tags

QUERIES, ORACLES = {}, {}


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f
    return add


def _month(c: str):
    return (F.year(c) * 12 + F.month(c)).cast("int")


@query("SELECT o_orderkey AS order_key, CAST(year(o_orderdate)*12+month(o_orderdate) AS INT) AS month_index FROM orders")
def interval_month_index(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import month_index

    return table(spark, d, "orders").select(F.col("o_orderkey").alias("order_key"), month_index(F.date_format("o_orderdate", "yyyy-MM")).alias("month_index"))


@query(sql("SELECT pid, g, s, e FROM merged"))
def interval_merged(spark, d):
    return intervals.merged(jobs(spark, d).select("pid", "s", "e"), ["pid"])


@query(sql("SELECT pid, n_months, years FROM span"))
def interval_work_span(spark, d):
    return intervals.spans(jobs(spark, d).select("pid", "s", "e"), ["pid"])


@query(sql(""", q AS (SELECT x.pid AS a, y.pid AS b FROM profile x JOIN profile y ON x.name=y.name AND x.pid<y.pid),
  m AS (SELECT a,b,sum(greatest(0,least(x.e,y.e)-greatest(x.s,y.s))) AS n FROM q JOIN merged x ON x.pid=a JOIN merged y ON y.pid=b GROUP BY a,b)
  SELECT q.a, q.b, CAST(coalesce(n,0) AS BIGINT) AS shared, CAST(coalesce(x.n_months,0)+coalesce(y.n_months,0)-coalesce(n,0) AS BIGINT) AS total
  FROM q LEFT JOIN m ON q.a=m.a AND q.b=m.b LEFT JOIN span x ON x.pid=q.a LEFT JOIN span y ON y.pid=q.b"""))
def interval_iou(spark, d):
    pairs = blocking.pairs_within(profiles(spark, d).select("name", "pid"), ["name"]).select("a", "b")
    return intervals.overlap_of_pairs(pairs, jobs(spark, d).select("pid", "s", "e"), "pid").select("a", "b", "shared", "total")


@query(sql("""SELECT pid, rn, s, e, lo, hi, CAST((s-lo)*1000//greatest(hi-lo,1) AS INT) AS x, CAST((e-s)*1000//greatest(hi-lo,1) AS INT) AS w
  FROM expr CROSS JOIN (SELECT min(s) AS lo, max(e) AS hi FROM expr)"""))
def interval_timeline_extent(spark, d):
    return intervals.extents(jobs(spark, d), ["pid", "rn"])


@query(sql("SELECT x.pid AS a, y.pid AS b, x.name AS name FROM profile x JOIN profile y ON x.name=y.name AND x.pid<y.pid UNION ALL SELECT x.pid, y.pid, x.nk FROM profile x JOIN profile y ON x.nk=y.nk AND x.pid<y.pid"))
def match_name_key_block(spark, d):
    rows = matching.blocks(profiles(spark, d), jobs(spark, d), by=None).where("kind in ('name', 'name_key')")
    return blocking.pairs_within(rows, ["kind", "key"]).select("a", "b", F.col("key").alias("name"))


@query(sql(""", own AS (SELECT pid, array_to_string(list_sort(list(DISTINCT company)),',') AS cs FROM expr GROUP BY pid), hist AS (SELECT m.pid, concat(any_value(cs),'|',string_agg(concat(s,'-',e), ',' ORDER BY s)) AS k FROM merged m JOIN own ON own.pid=m.pid GROUP BY m.pid),
  keys AS (SELECT 'phone' AS kind, phone AS k, pid FROM profile UNION ALL SELECT 'email', email, pid FROM profile UNION ALL SELECT 'name', name, pid FROM profile UNION ALL SELECT 'name_key', nk, pid FROM profile UNION ALL SELECT 'history', k, pid FROM hist)
  SELECT DISTINCT x.pid AS a, y.pid AS b FROM keys x JOIN keys y ON x.kind=y.kind AND x.k=y.k AND x.pid<y.pid"""))
def match_blocked_pairs(spark, d):
    """Pairs that share a contact, a name, a name key or a whole history: all that any decision needs. (Single companies make blocks that grow with the people.)"""
    return matching.candidate_pairs(profiles(spark, d), jobs(spark, d))


@query(sql("SELECT a, b, name_score, round(jaccard,6) AS jaccard, round(iou,6) AS iou, round(other,6) AS other, raw_score AS score FROM sc WHERE name_score>0 OR key1", True))
def match_pair_scores(spark, d):
    p, j = profiles(spark, d), jobs(spark, d)
    six = lambda c: F.round(c, 6).alias(c)
    return matching.pair_scores(matching.candidate_pairs(p, j, by=None), p, j).select("a", "b", "name_score", six("jaccard"), six("iou"), six("other"), "score")


@query(sql("SELECT a, b FROM sc WHERE forced", True))
def match_over_rule(spark, d):
    p, j = profiles(spark, d), jobs(spark, d)
    return matching.pair_scores(matching.candidate_pairs(p, j), p, j).where("forced_apart").select("a", "b")


@query(sql("SELECT a, b, score, decision, key1, forced AS forced_apart FROM dec WHERE forced OR decision<>'different_person'", True))
def match_decisions(spark, d):
    """All pairs but those that nothing speaks for. The oracle compares a wider block, which finds no more."""
    rows = matching.decisions(profiles(spark, d), jobs(spark, d)).where("forced_apart or decision != 'different_person'")
    return rows.select("a", "b", "score", "decision", "key1", "forced_apart")


@query(sql("SELECT decision, count(*) AS n FROM dec WHERE forced OR decision<>'different_person' GROUP BY decision", True))
def match_decision_counts(spark, d):
    return match_decisions(spark, d).groupBy("decision").agg(F.count("*").alias("n"))


@query(sql("SELECT b, a, score, decision FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, a) AS r FROM dec WHERE decision<>'different_person') WHERE r=1", True))
def match_best(spark, d):
    return matching.best_matches(matching.decisions(profiles(spark, d), jobs(spark, d))).select("b", "a", "score", "decision")


@query(None)
def match_sequential(spark, d):
    """All customers imported one after the other, by key, each against the profiles as they are by then."""
    month = lambda c: F.concat_ws("-", F.floor((F.col(c) - 1) / 12).cast("string"), F.lpad(((F.col(c) - 1) % 12 + 1).cast("string"), 2, "0"))
    people = profiles(spark, d).withColumns({"place": F.col("pid"), "parsed_at": F.lit("2026-01-01")})
    return sequential.sequential(people, jobs(spark, d).select("pid", "company", month("s").alias("start"), month("e").alias("end")))


def _clusters(spark, d):
    """Links don't need the company block: a pair that shares no contact and no name stays below the automatic tier."""
    p, j = profiles(spark, d), jobs(spark, d)
    return matching.clusters(p, matching.cluster_links(p, j))


CLOSURE = """, links AS (SELECT a,b FROM dec WHERE decision='auto_merge' UNION SELECT b,a FROM dec WHERE decision='auto_merge'),
  reach AS (SELECT pid AS x, pid AS y FROM profile UNION SELECT r.x, l.b FROM reach r JOIN links l ON l.a=r.y), cl AS (SELECT x AS pid, min(y) AS cluster FROM reach GROUP BY x)"""


@query(sql(CLOSURE + " SELECT pid, cluster FROM cl", True, True))
def match_clusters(spark, d):
    return _clusters(spark, d)


@query(sql(CLOSURE + """, m AS (SELECT c.pid, cluster, grp FROM cl c JOIN profile p ON c.pid=p.pid),
  n AS (SELECT (SELECT sum(n*(n-1)//2) FROM (SELECT count(*) AS n FROM m GROUP BY cluster,grp)) AS tp, (SELECT sum(n*(n-1)//2) FROM (SELECT count(*) AS n FROM m GROUP BY cluster)) AS p,
               (SELECT sum(n*(n-1)//2) FROM (SELECT count(*) AS n FROM m GROUP BY grp)) AS t)
  SELECT CAST(tp AS BIGINT) AS tp, CAST(p-tp AS BIGINT) AS fp, CAST(t-tp AS BIGINT) AS fn, round(tp/p::DOUBLE,6) AS precision_, round(tp/t::DOUBLE,6) AS recall_,
    round(2*(tp/p::DOUBLE)*(tp/t::DOUBLE)/((tp/p::DOUBLE)+(tp/t::DOUBLE)),6) AS f1, round((p-tp)/p::DOUBLE,6) AS false_merge_rate FROM n""", True, True))
def match_cluster_pairs_eval(spark, d):
    members = _clusters(spark, d).join(profiles(spark, d).select("pid", "grp"), "pid")
    six = lambda c, n=None: F.round(c, 6).alias(n or c)
    return evaluation.member_metrics(members).select("tp", "fp", "fn", six("precision", "precision_"), six("recall", "recall_"), six("f1"), six("false_merge_rate"))


@query("""WITH v AS (SELECT user_id, event_type, CASE WHEN event_id%3=0 THEN NULL ELSE value END AS value, CASE WHEN event_id%4=0 THEN '' ELSE props END AS props, ts, event_id FROM events)
  SELECT user_id, event_type, arg_max(value, (ts, event_id)) FILTER (WHERE value IS NOT NULL) AS value, arg_max(props, (ts, event_id)) FILTER (WHERE props<>'') AS props FROM v GROUP BY user_id, event_type""")
def merge_latest_wins(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"),
                                            F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("props")).alias("props"))
    return merging.latest_values(rows, ["user_id", "event_type"], ["value", "props"], F.struct("ts", "event_id"))


@query(sql("""SELECT a, b, f.field AS field, f.pos AS pos, f.x AS option_a, f.y AS option_b FROM (
  SELECT a, b, unnest([{'field':'phone','pos':0,'x':x.phone,'y':y.phone},{'field':'email','pos':1,'x':x.email,'y':y.email},{'field':'school','pos':2,'x':x.school,'y':y.school},
                       {'field':'desired','pos':3,'x':x.desired,'y':y.desired}]) AS f
  FROM dec JOIN profile x ON x.pid=a JOIN profile y ON y.pid=b WHERE key1) WHERE f.x<>f.y""", True))
def merge_conflicts(spark, d):
    p = profiles(spark, d)
    pairs = matching.candidate_pairs(p, jobs(spark, d), by=None)
    for k in "ab":
        pairs = pairs.join(p.select(F.col("pid").alias(k), F.struct("phone", "email", "school", "desired").alias(f"p{k}")), k)
    pairs = pairs.where("pa.phone = pb.phone or pa.email = pb.email")
    return merging.conflicts(pairs, ["phone", "email", "school", "desired"]).select("a", "b", "field", "pos", "option_a", "option_b")


@query(sql("""SELECT p.pid, coalesce(CASE WHEN max(CASE WHEN rn=1 AND p.pid%4=0 THEN 1 ELSE 0 END)=1 THEN '2026-10' END, max(concat((e-1)//12,'-',lpad(CAST((e-1)%12+1 AS VARCHAR),2,'0'))), '2026-01') AS resume_date
  FROM profile p LEFT JOIN expr ON expr.pid=p.pid GROUP BY p.pid"""))
def merge_resume_date(spark, d):
    end = F.concat_ws("-", F.floor((F.col("e") - 1) / 12).cast("string"), F.lpad(((F.col("e") - 1) % 12 + 1).cast("string"), 2, "0"))
    each = jobs(spark, d).select("pid", F.struct(F.when(~((F.col("rn") == 1) & (F.col("pid") % 4 == 0)), end).alias("end")).alias("x")).groupBy("pid").agg(F.collect_list("x").alias("x"))
    rows = profiles(spark, d).select("pid").join(each, "pid", "left")
    return rows.select("pid", merging.resume_date(F.col("x"), F.lit("2026-01-31T00:00:00")).alias("resume_date"))


@query(sql("SELECT DISTINCT CASE WHEN pid%10=1 THEN pid-1 ELSE pid END AS pid, kind, tag FROM tags"))
def merge_id_remap(spark, d):
    moved = profiles(spark, d).where("pid % 10 = 1").select(F.col("pid").alias("source"), (F.col("pid") - 1).alias("target"))
    return merging.remap(tags(spark, d), "pid", moved)


@query(sql("SELECT pid, kind, count(*) AS n_tags, string_agg(tag, ',' ORDER BY tag) AS tag_list FROM tags GROUP BY pid, kind"))
def tag_bridge(spark, d):
    rows = tags(spark, d).groupBy("pid", "kind").agg(F.array_sort(F.collect_list("tag")).alias("t"))
    return rows.select("pid", "kind", F.size("t").cast("bigint").alias("n_tags"), F.array_join("t", ",").alias("tag_list"))


@query(sql(""", docs AS (SELECT p.pid, name, school, major, (SELECT string_agg(tag,' ' ORDER BY tag) FROM tags t WHERE t.pid=p.pid AND kind='skill') AS skills,
    (SELECT string_agg(c,' ' ORDER BY c) FROM (SELECT DISTINCT company AS c FROM expr e WHERE e.pid=p.pid)) AS company FROM profile p)
  SELECT pid FROM docs WHERE contains(lower(name),'brand#1') OR contains(lower(school),'brand#1') OR contains(lower(major),'brand#1') OR contains(lower(skills),'brand#1') OR contains(lower(company),'brand#1')"""))
def search_fulltext(spark, d):
    return search.full_text(search.search_documents(profiles(spark, d), tags(spark, d), jobs(spark, d)), "BRAND#1")


@query(sql("""SELECT pid FROM profile p WHERE name ILIKE '%x1%' OR school ILIKE '%x1%' OR major ILIKE '%x1%' OR desired ILIKE '%x1%'
  OR EXISTS(SELECT 1 FROM expr e WHERE e.pid=p.pid AND company ILIKE '%x1%') OR EXISTS(SELECT 1 FROM tags t WHERE t.pid=p.pid AND tag ILIKE '%x1%')"""))
def search_like_short(spark, d):
    return search.short_query(profiles(spark, d), tags(spark, d), jobs(spark, d), "x1")


def _candidates(spark, d):
    return profiles(spark, d).join(interval_work_span(spark, d).select("pid", "years"), "pid", "left")


@query(sql("""SELECT p.pid, name, degree, years FROM profile p LEFT JOIN span s ON s.pid=p.pid WHERE degree='本科' AND years>=3.0
  AND EXISTS(SELECT 1 FROM tags t WHERE t.pid=p.pid AND lower(tag)='brand#12') ORDER BY years DESC, p.pid LIMIT 50"""))
def search_filtered_topk(spark, d):
    out = search.search(_candidates(spark, d), tags(spark, d), jobs(spark, d), "", degree="本科", skill=" Brand#12 ", min_years=3.0)
    return out.select("pid", "name", "degree", "years")


@query(sql("SELECT p.pid, name, school, years FROM profile p LEFT JOIN span s ON s.pid=p.pid WHERE name ILIKE '%c1%' OR school ILIKE '%c1%' OR major ILIKE '%c1%' OR desired ILIKE '%c1%' "
           "OR EXISTS(SELECT 1 FROM expr e WHERE e.pid=p.pid AND company ILIKE '%c1%') OR EXISTS(SELECT 1 FROM tags t WHERE t.pid=p.pid AND tag ILIKE '%c1%') ORDER BY years DESC NULLS LAST, p.pid LIMIT 20"))
def search_query_topk(spark, d):
    return search.search(_candidates(spark, d), tags(spark, d), jobs(spark, d), " c1 ", limit=20).select("pid", "name", "school", "years")


@query("""SELECT p_partkey AS part_key, c AS col FROM (SELECT p_partkey, unnest(['p_name','p_type']) AS c, unnest([p_name,p_type]) AS t FROM part) WHERE contains(lower(t),'mall')""")
def search_trigram_index(spark, d):
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("part_key"), "p_name", "p_type")
    return search.search_index(search.trigram_index(docs, ["p_name", "p_type"], "part_key"), docs, "Mall", "part_key")


@query("""WITH r AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag='R'), t AS (SELECT p_partkey, p_name, CASE WHEN l_partkey IS NULL THEN p_type ELSE 'RETURNED' END AS p_type FROM part LEFT JOIN r ON l_partkey=p_partkey)
  SELECT p_partkey AS part_key, c AS col FROM (SELECT p_partkey, unnest(['p_name','p_type']) AS c, unnest([p_name,p_type]) AS t FROM t) WHERE contains(lower(t),'mall')""")
def search_kept_index(spark, d):
    """An index kept on disk by gram, to which the parts that customers returned are added again with another text: what they said before isn't found any more."""
    first = table(spark, d, "part").select(F.col("p_partkey").alias("part_key"), F.lit(1).cast("bigint").alias("version"), "p_name", "p_type")
    back = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_partkey").distinct()
    again = first.join(back, F.expr("part_key = l_partkey"), "left_semi").withColumns({"version": F.lit(2).cast("bigint"), "p_type": F.lit("RETURNED")})
    path = scratch(spark, "postings")
    for docs in (first, again):
        search.postings(spread(docs, "part_key", 50_000), ["p_name", "p_type"], "part_key").write.mode("append").partitionBy("bucket").parquet(path)
    return search.find(spark.read.schema("gram string, col string, part_key bigint, version bigint, bucket int").parquet(path), first.unionByName(again), "Mall", "part_key")


@query(sql("SELECT pid, CAST(row_number() OVER (PARTITION BY pid ORDER BY s, rn) AS INT) AS pos, rn, company, s, e FROM expr"))
def timeline_view(spark, d):
    each = jobs(spark, d).groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("s", "rn", "company", "e"))).alias("x"))
    return each.select("pid", F.posexplode("x").alias("i", "v")).select("pid", (F.col("i") + 1).alias("pos"), "v.rn", "v.company", "v.s", "v.e")


JD = {"degree_min": "本科", "years": {"min": 3, "max": 9}, "must_have_skills": ["brand#12", " Brand#23 "], "exclude_keywords": ["x1", "S7", " "]}


def people(spark, d):
    """Everything that screening looks at, one row for each person."""
    skills = tags(spark, d).where("kind = 'skill'").groupBy("pid").agg(F.array_sort(F.collect_list("tag")).alias("skills"))
    companies = jobs(spark, d).groupBy("pid").agg(F.transform(F.array_sort(F.collect_list("company")), lambda c: F.struct(F.lit("company").alias("field"), c.alias("text"))).alias("worked"))
    rows = _candidates(spark, d).join(skills, "pid", "left").join(companies, "pid", "left")
    own = F.array(*(F.struct(F.lit(n).alias("field"), F.col(c).alias("text")) for n, c in (("school", "school"), ("major", "major"), ("desired_position", "desired"))))
    texts = F.concat(own, F.coalesce("worked", F.array().cast("array<struct<field:string,text:string>>")))
    return rows.withColumn("has_jobs", F.col("worked").isNotNull()).withColumn("texts", texts)


STATES = """, sk AS (SELECT pid, list(lower(tag)) AS t FROM tags WHERE kind='skill' GROUP BY pid),
  st AS (SELECT p.pid, name, degree, years,
    CASE WHEN degree IS NULL OR degree='其他' THEN 'insufficient' WHEN degree='大专' THEN 'miss' ELSE 'hit' END AS degree_state,
    CASE WHEN years IS NULL THEN 'insufficient' WHEN years>=3 AND years<=9 THEN 'hit' ELSE 'miss' END AS years_state,
    CASE WHEN t IS NULL THEN 'insufficient' WHEN list_contains(t,'brand#12') THEN 'hit' ELSE 'miss' END AS skill_1,
    CASE WHEN t IS NULL THEN 'insufficient' WHEN list_contains(t,'brand#23') THEN 'hit' ELSE 'miss' END AS skill_2,
    EXISTS(SELECT 1 FROM expr e WHERE e.pid=p.pid AND contains(lower(company),'x1')) AS ex_1, contains(lower(school),'s7') OR EXISTS(SELECT 1 FROM expr e WHERE e.pid=p.pid AND contains(lower(company),'s7')) AS ex_2
    FROM profile p LEFT JOIN span s ON s.pid=p.pid LEFT JOIN sk ON sk.pid=p.pid),
  fit AS (SELECT *, ex_1 OR ex_2 AS excluded, CASE WHEN ex_1 OR ex_2 THEN 'excluded' WHEN 'miss' IN (degree_state,years_state,skill_1,skill_2) THEN 'miss'
      WHEN 'insufficient' IN (degree_state,years_state,skill_1,skill_2) THEN 'insufficient' ELSE 'hit' END AS state,
    floor((0.6::DOUBLE*((f(skill_1)+f(skill_2))/2::DOUBLE)+0.2::DOUBLE*f(years_state)+0.2::DOUBLE*f(degree_state))*10000+0.5::DOUBLE)/10000.0::DOUBLE AS score FROM st)"""


def _fits(text: str) -> str:
    import re

    return re.sub(r"\bf\((\w+)\)", r"(CASE WHEN \1='hit' THEN 1.0::DOUBLE WHEN \1='insufficient' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)", text)


@query(sql(STATES.split(",\n  fit")[0] + " SELECT pid, degree_state, years_state FROM st"))
def screen_degree_years(spark, d):
    return screening.matrix(people(spark, d), {k: JD[k] for k in ("degree_min", "years")}).select("pid", "degree_state", "years_state")


@query(sql(STATES.split(",\n  fit")[0] + " SELECT pid, unnest(['brand#12','Brand#23']) AS keyword, unnest([skill_1,skill_2]) AS state FROM st"))
def screen_skills(spark, d):
    rows = screening.matrix(people(spark, d), {"must_have_skills": JD["must_have_skills"]})
    return rows.select("pid", F.explode("skill_cells").alias("c")).select("pid", "c.keyword", "c.state")


@query(sql("""SELECT pid, keyword, string_agg(field, ',' ORDER BY field) AS fields FROM (
  SELECT DISTINCT pid, 'x1' AS keyword, 'company' AS field, rn FROM expr WHERE contains(lower(company),'x1') UNION ALL SELECT pid, 'S7', 'school', 0 FROM profile WHERE contains(lower(school),'s7')
  UNION ALL SELECT pid, 'S7', 'company', rn FROM expr WHERE contains(lower(company),'s7')) GROUP BY pid, keyword"""))
def screen_excludes(spark, d):
    rows = screening.matrix(people(spark, d), {"exclude_keywords": JD["exclude_keywords"]}).select("pid", F.explode("exclude_cells").alias("c")).where("c.state = 'hit'")
    return rows.select("pid", "c.keyword", F.array_join(F.array_sort("c.value"), ",").alias("fields"))


@query(_fits(sql(STATES + " SELECT pid, name, state, excluded, score, degree_state, years_state FROM fit")))
def screen_matrix(spark, d):
    return screening.matrix(people(spark, d), JD).select("pid", "name", "state", "excluded", "score", "degree_state", "years_state")


@query(_fits(sql(STATES + " SELECT row_number() OVER (ORDER BY excluded, score DESC, pid) AS rank_, pid, state, score FROM fit ORDER BY rank_ LIMIT 100")))
def screen_top(spark, d):
    """The hundred best of a matrix, ranked."""
    best = screening.matrix(people(spark, d), JD).orderBy("excluded", F.desc("score"), "pid").limit(100)
    return screening.ranked(best).select(F.col("rank").cast("bigint").alias("rank_"), "pid", "state", "score")


@query(_fits(sql(STATES + """ SELECT count(*) AS total, count(*) FILTER (state='hit') AS n_hit, count(*) FILTER (state='miss') AS n_miss, count(*) FILTER (state='insufficient') AS n_insufficient,
  count(*) FILTER (state='excluded') AS n_excluded FROM fit""")))
def screen_summary(spark, d):
    return screening.summary(screening.matrix(people(spark, d), JD))
