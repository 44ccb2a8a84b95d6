"""Cards written and read again, versions, exports, audits and samples over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masking
from ..operators import evaluation, extract, generation, matching, merging, privacy, screening
from ..sources.documents import card_from_json, card_to_json
from ..storage import stored
from . import people as people_, texts
from .common import jobs, profiles, sql, table, tags

QUERIES, ORACLES = {}, {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f
    return add


def _month(c: str):
    return F.concat_ws("-", F.floor((F.col(c) - 1) / 12).cast("string"), F.lpad(((F.col(c) - 1) % 12 + 1).cast("string"), 2, "0"))


# --- cards ---

HAN = "甲乙丙丁戊己庚辛壬癸"


def resumes(spark: SparkSession, d: str) -> DataFrame:
    """A resume of every customer, as files for extract_cards(): pid, source_file, file_type, file_sha256, parsed_at, lines.

    Even customers have labels; the others a name of three characters, contacts and a degree that stand by themselves.
    """
    p, no, even = F.col("pid"), F.lit(None).cast("string"), F.col("pid") % 2 == 0
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (p % len(values)).cast("int"))
    after = lambda said, c: F.concat(F.lit(said), c)
    dashed = F.concat_ws("-", F.substring("phone", 1, 3), F.substring("phone", 4, 4), F.substring("phone", 8, 4))
    name = F.when(even, after("姓名：", F.col("name"))).otherwise(F.translate(F.lpad((p % 1000).cast("string"), 3, "0"), "0123456789", HAN))
    phone = F.when(F.col("phone").isNotNull(), F.when(even, after("电话：", dashed)).otherwise(after("联系方式 ", F.col("phone"))))
    graduated = F.when(p % 3 == 0, F.concat(F.lit("毕业时间："), (2000 + p % 20).cast("string"), F.lit("年"), (p % 12 + 1).cast("string"), F.lit("月")))
    taught = F.concat(pick(texts.SCHOOLS), F.lit(" "), pick(texts.MAJORS), F.when(~even & F.col("degree").isNotNull(), F.concat(F.lit("（"), F.col("degree"), F.lit("）"))).otherwise(""))
    head = F.array(name, F.when(even, after("学历：", F.col("degree"))), phone, after("邮箱 ", F.col("email")), graduated, F.lit("教育背景"), taught)
    job = lambda x: F.concat_ws(" | ", x["company"], F.concat(F.lit("T"), x["rn"].cast("string")), F.concat_ws(" - ", x["start"], x["end"]))
    worked = F.when(F.col("worked").isNotNull(), F.concat(F.array(F.lit("工作经历")), F.transform("worked", job))).otherwise(F.array(no))
    listed = lambda title, c: F.when(F.col(c).isNotNull(), F.array(F.lit(title), F.array_join(c, "、"))).otherwise(F.array(no))
    lines = F.array_compact(F.concat(head, worked, listed("技能特长", "skills"), listed("证书", "certs"), F.array(F.lit("求职意向"), after("岗位 ", F.col("desired")))))
    own = jobs(spark, d).select("pid", F.struct("rn", "company", _month("s").alias("start"), _month("e").alias("end")).alias("x")).groupBy("pid").agg(F.array_sort(F.collect_list("x")).alias("worked"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("tag"))))
    tagged = tags(spark, d).groupBy("pid").agg(of("skill").alias("skills"), of("certificate").alias("certs"))
    tagged = tagged.select("pid", *(F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("skills", "certs")))
    rows = profiles(spark, d).join(own, "pid", "left").join(tagged, "pid", "left")
    rows = rows.select("pid", lines.alias("texts"))
    line = lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("raw"), x.alias("text"), F.concat(F.lit("L"), (i + 1).cast("string")).alias("location"))
    return rows.select("pid", F.concat(F.lit("in/"), p.cast("string"), F.lit(".txt")).alias("source_file"), F.lit("txt").alias("file_type"), F.sha2(F.array_join("texts", "\n"), 256).alias("file_sha256"),
                       F.lit("2026-01-01").alias("parsed_at"), F.array_join("texts", "\n").alias("raw_text"), F.transform("texts", line).alias("lines"))


def _cards(spark, d) -> DataFrame:
    return extract.extract_cards(resumes(spark, d).drop("pid", "raw_text"))


_FILE = "concat('in/',pid,'.txt') AS source_file"
#: What the cards of resumes() hold, as SQL.
_FIELDS = f""", fl AS (SELECT pid, f.f AS field, f.v AS value, CAST(f.c AS DOUBLE) AS confidence FROM (SELECT pid, unnest([
  {{'f':'name','v':CASE WHEN pid%2=0 THEN name ELSE translate(lpad(CAST(pid%1000 AS VARCHAR),3,'0'),'0123456789','{HAN}') END,'c':CASE WHEN pid%2=0 THEN 0.95 ELSE 0.9 END}},
  {{'f':'phone','v':phone,'c':0.95}}, {{'f':'email','v':email,'c':0.95}}, {{'f':'degree','v':degree,'c':CASE WHEN pid%2=0 THEN 0.95 ELSE 0.85 END}},
  {{'f':'graduation_date','v':CASE WHEN pid%3=0 THEN concat(2000+pid%20,'-',lpad(CAST(pid%12+1 AS VARCHAR),2,'0')) END,'c':0.95}},
  {{'f':'school','v':{texts.SCHOOLS}[pid%3+1],'c':0.85}}, {{'f':'major','v':{texts.MAJORS}[pid%2+1],'c':0.8}}, {{'f':'desired_position','v':concat('岗位 ',desired),'c':0.9}}]) AS f FROM profile) WHERE f.v IS NOT NULL),
it AS (SELECT pid, 'experiences' AS kind, CAST(row_number() OVER (PARTITION BY pid ORDER BY rn)-1 AS INT) AS pos, concat(company,'|T',rn,'|',(s-1)//12,'-',lpad(CAST((s-1)%12+1 AS VARCHAR),2,'0'),'|',(e-1)//12,'-',lpad(CAST((e-1)%12+1 AS VARCHAR),2,'0')) AS value FROM expr
  WHERE pid IN (SELECT pid FROM profile)
  UNION ALL SELECT pid, CASE kind WHEN 'skill' THEN 'skills' ELSE 'certificates' END, CAST(row_number() OVER (PARTITION BY pid, kind ORDER BY tag)-1 AS INT), tag FROM tags WHERE pid IN (SELECT pid FROM profile))"""


@query(sql(_FIELDS + f" SELECT {_FILE}, field, value, confidence FROM fl"))
def card_fields(spark, d):
    """All fields of the cards read from every customer's resume; the oracle is what the resumes were written from."""
    return _cards(spark, d).select("source_file", F.explode("fields").alias("field", "v")).select("source_file", "field", "v.value", "v.confidence")


@query(sql(_FIELDS + f" SELECT {_FILE}, kind, pos, value FROM it"))
def card_items(spark, d):
    """Employments, skills and certificates of these cards, in their order."""
    texts_ = lambda c: F.transform(c, lambda x: x["value"])
    worked = F.transform("experiences", lambda e: F.concat_ws("|", e["company"], e["title"], e["start"], e["end"]))
    each = F.explode(F.create_map(F.lit("experiences"), worked, F.lit("skills"), texts_("skills"), F.lit("certificates"), texts_("certificates"))).alias("kind", "v")
    return _cards(spark, d).select("source_file", each).select("source_file", "kind", F.posexplode("v").alias("pos", "value"))


_COUNTS = "SELECT p.pid, (SELECT count(*) FROM fl WHERE fl.pid=p.pid) AS nf, (SELECT count(*) FROM it WHERE it.pid=p.pid AND kind='experiences') AS ne, (SELECT count(*) FROM it WHERE it.pid=p.pid AND kind<>'experiences') AS ni FROM profile p"


@query(sql(_FIELDS + f", n AS ({_COUNTS}) SELECT {_FILE}, CAST(nf AS INT) AS n_fields, CAST(ne AS INT) AS n_experiences, CAST(ni AS INT) AS n_items, true AS same FROM n"))
def card_json(spark, d):
    """The cards as JSON and read back: what came back, and whether writing it again gives the same text."""
    written = card_to_json(_cards(spark, d)).select("source_file", "card_json").withColumn("card", card_from_json(F.col("card_json")))
    return written.select("source_file", F.size("card.fields").alias("n_fields"), F.size("card.experiences").alias("n_experiences"), (F.size("card.skills") + F.size("card.certificates")).alias("n_items"),
                          (F.to_json("card") == F.col("card_json")).alias("same"))


@query(sql(_FIELDS + f", n AS ({_COUNTS}) SELECT {_FILE}, CAST(nf+ne+ni AS BIGINT) AS n_snippets, CAST(0 AS BIGINT) AS n_unsupported FROM n"))
def card_evidence(spark, d):
    """How many snippets show each card's values, and how many of them aren't in the resume (none may be)."""
    files = stored(resumes(spark, d), "resumes")
    cards, raw = stored(extract.extract_cards(files.drop("pid", "raw_text")), "cards"), files.select("source_file", "raw_text")
    shown = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + F.size(x["evidence"]))
    n = (shown(F.map_values("fields")) + shown("experiences") + shown("skills") + shown("certificates")).cast("bigint")
    wrong = extract.unsupported_evidence(cards, raw).groupBy("source_file").agg(F.count("*").alias("__wrong"))
    return cards.select("source_file", n.alias("n_snippets")).join(wrong, "source_file", "left").select("source_file", "n_snippets", F.coalesce("__wrong", F.lit(0).cast("bigint")).alias("n_unsupported"))


# --- versions, matching reports and exports ---

@query(sql(""", v AS (SELECT pid, coalesce(max(CASE WHEN rn%2=1 THEN CASE WHEN rn%5=0 THEN 24322 ELSE e END END),-1) AS la, count(*) FILTER (rn%2=1) AS na,
    coalesce(max(CASE WHEN rn%2=0 THEN CASE WHEN rn%5=0 THEN 24322 ELSE e END END),-1) AS lb, count(*) FILTER (rn%2=0) AS nb FROM expr GROUP BY pid)
  SELECT pid, CAST(la AS INT) AS latest_a, CAST(na AS INT) AS n_a, CAST(lb AS INT) AS latest_b, CAST(nb AS INT) AS n_b, lb>la OR (lb=la AND nb>na) AS b_newer FROM v"""))
def merge_freshness(spark, d):
    """Two records of each person, with the odd and the even employments (every fifth lasts), and which is fresher; the second has no time of parsing."""
    rows = jobs(spark, d).select("pid", (F.col("rn") % 2).alias("odd"), F.struct(_month("s").alias("start"), F.when(F.col("rn") % 5 != 0, _month("e")).alias("end")).alias("x"))
    each = rows.groupBy("pid").agg(*(F.collect_list(F.when(F.col("odd") == k, F.col("x"))).alias(c) for c, k in (("a", 1), ("b", 0))))
    each = each.select("pid", merging.freshness(F.col("a"), F.lit("2026-01-02")).alias("fa"), merging.freshness(F.col("b"), F.lit(None).cast("string")).alias("fb"))
    return each.select("pid", F.col("fa.latest").alias("latest_a"), F.col("fa.n").alias("n_a"), F.col("fb.latest").alias("latest_b"), F.col("fb.n").alias("n_b"), (F.col("fb") > F.col("fa")).alias("b_newer"))


@query(sql("""SELECT count(*) AS n_pairs, count(*) FILTER (x.grp=y.grp) AS n_same, count(*) FILTER (x.grp<>y.grp) AS n_cross
  FROM (SELECT DISTINCT a, b FROM dec WHERE decision='manual_review') m JOIN profile x ON x.pid=a JOIN profile y ON y.pid=b""", True))
def match_manual_pairs(spark, d):
    """Pairs left to a reader, and how many of them are of one person."""
    people = profiles(spark, d)
    return evaluation.manual_pairs(matching.decisions(people, jobs(spark, d)), people)


@query(people_.ORACLES["match_cluster_pairs_eval"].split("  SELECT CAST(tp AS BIGINT) AS tp")[0] + """ SELECT CAST(tp AS BIGINT) AS tp, CAST(p-tp AS BIGINT) AS fp, CAST(t-tp AS BIGINT) AS fn,
  CASE WHEN p>0 THEN tp/p::DOUBLE ELSE 0 END>=0.95 AND CASE WHEN t>0 THEN tp/t::DOUBLE ELSE 0 END>=0.95 AND p-tp<=0 AS passed FROM n""")
def match_gate(spark, d):
    """Whether the clusters of all people pass the gate of matching."""
    people = profiles(spark, d)
    members = matching.clusters(people, matching.cluster_links(people, jobs(spark, d))).join(people.select("pid", "grp"), "pid")
    return evaluation.gated(evaluation.member_metrics(members)).select("tp", "fp", "fn", "passed")


@query(sql("SELECT concat('| ',school,' | ',count(*),' | ',printf('%.4f',count(phone)/count(*)::DOUBLE),' |') AS line FROM profile GROUP BY school"))
def report_markdown(spark, d):
    """People and the share of those with a phone number by school, as lines of a table."""
    rows = profiles(spark, d).groupBy("school").agg(F.count("*").alias("n"), (F.count("phone") / F.count("*")).alias("with_phone"))
    return evaluation.markdown(rows, ["school", "n", "with_phone"])


_SAY = "CASE {} WHEN 'hit' THEN '满足' WHEN 'miss' THEN '不满足' WHEN 'insufficient' THEN '待人工确认' WHEN 'excluded' THEN '硬排除' ELSE '' END"


@query(people_._fits(sql(people_.STATES + f""", h AS (SELECT pid, concat('x1:',string_agg('company',',')) AS x1 FROM expr WHERE contains(lower(company),'x1') GROUP BY pid)
  SELECT CAST(row_number() OVER (ORDER BY excluded, score DESC, fit.pid) AS VARCHAR) AS "排名", {_SAY.format('state')} AS "状态", CAST(fit.pid AS VARCHAR) AS "候选人ID", coalesce(name,'(无名)') AS "姓名",
    coalesce(degree,'') AS "学历", {_SAY.format('degree_state')} AS "学历判定", coalesce(CAST(years AS VARCHAR),'') AS "工作年限", {_SAY.format('years_state')} AS "年限判定",
    concat('brand#12:',{_SAY.format('skill_1')},'；Brand#23:',{_SAY.format('skill_2')}) AS "必备技能判定", concat_ws('；', x1, CASE WHEN ex_2 THEN 'S7:school' END) AS "排除词命中", printf('%.4f',score) AS "匹配分"
  FROM fit LEFT JOIN h ON h.pid=fit.pid""")))
def screen_export(spark, d):
    """The ranked matrix of all people as text cells under the headers of the exported table; no contacts."""
    return screening.export_rows(screening.ranked(screening.matrix(people_.people(spark, d), people_.JD)))


# --- privacy ---

@query(sql("""SELECT pid, regexp_matches(regexp_replace(x,'[\\s-]','','g'),'^1[3-9][0-9]{9}$') AS probable FROM (SELECT pid,
  CASE pid%4 WHEN 0 THEN concat(phone[:3],'-',phone[4:7],' ',phone[8:]) WHEN 1 THEN phone WHEN 2 THEN concat('0',phone) ELSE concat(phone[:10],'x') END AS x FROM profile WHERE phone IS NOT NULL)"""))
def phone_probable(spark, d):
    """Phone numbers of all people as they are typed, with hyphens, a digit too many or a letter: which may be one."""
    first = lambda n: F.substring("phone", 1, n)
    r = F.col("pid") % 4
    typed = F.when(r == 0, F.concat(first(3), F.lit("-"), F.substring("phone", 4, 4), F.lit(" "), F.substring("phone", 8, 4))).when(r == 1, F.col("phone")).when(r == 2, F.concat(F.lit("0"), F.col("phone"))).otherwise(F.concat(first(10), F.lit("x")))
    return profiles(spark, d).where("phone is not null").select("pid", masking.is_probable_phone(typed).alias("probable"))


_AUTHORS = "SELECT c_custkey AS id, concat('a',c_custkey,'@',CASE c_custkey%3 WHEN 0 THEN 'Example.com' WHEN 1 THEN 'mail.test' ELSE 'github.com' END) AS author, CASE WHEN c_custkey%2=0 THEN concat('b',c_custkey,'@corp.test') END AS committer FROM customer"


def _authors(spark, d):
    k = F.col("c_custkey")
    host = F.when(k % 3 == 0, "Example.com").when(k % 3 == 1, "mail.test").otherwise("github.com")
    return table(spark, d, "customer").select(k.alias("id"), F.concat(F.lit("a"), k, F.lit("@"), host).alias("author"), F.when(k % 2 == 0, F.concat(F.lit("b"), k, F.lit("@corp.test"))).alias("committer"))


@query(f"SELECT id, 'EMAIL_META' AS category, CAST((id%3=1)::INT+(id%2=0)::INT AS BIGINT) AS n FROM ({_AUTHORS}) WHERE id%3=1 OR id%2=0")
def audit_metadata(spark, d):
    """Addresses of authors and committers of all records that aren't allowed."""
    return privacy.audit_metadata(_authors(spark, d), "id", ["author", "committer"])


_FOUND = texts.ORACLES["audit_categories"].removeprefix("WITH ")


@query(f"""WITH t AS (WITH {_FOUND}), a AS (SELECT category, n FROM t UNION ALL SELECT 'EMAIL_META', CAST((id%3=1)::INT+(id%2=0)::INT AS BIGINT) FROM ({_AUTHORS}))
  SELECT CAST(coalesce(sum(n) FILTER (category IN {tuple(masking.HARD)}),0) AS BIGINT) AS n_hard, CAST(coalesce(sum(n) FILTER (category NOT IN {tuple(masking.HARD)}),0) AS BIGINT) AS n_review,
    CAST(coalesce(sum(n) FILTER (category IN {tuple(masking.HARD)}),0)>0 AS INT) AS exit_code FROM a""")
def audit_report(spark, d):
    """Hard and reviewed findings in all documents and metadata, and the exit code."""
    found = privacy.audit_texts(table(spark, d, "documents"), "doc_id", "text", [texts.WORD]).select("category", "n")
    return privacy.verdict(found.unionByName(privacy.audit_metadata(_authors(spark, d), "id", ["author", "committer"]).select("category", "n")))


_PAGES = "SELECT page_id AS doc_id, concat(CASE WHEN page_id%3=0 THEN 'at C:\\Users\\x ' ELSE '' END, CASE WHEN page_id%5=0 THEN 'sk-abcdefghijklmnopqrst ' ELSE '' END, html) AS text FROM pages WHERE html IS NOT NULL"


@query("WITH " + _FOUND.replace("FROM documents)", f"FROM ({_PAGES}) WHERE doc_id%2=1)").replace("SELECT doc_id, category, CAST(sum(n)", "SELECT doc_id AS page_id, category, CAST(sum(n)") + f"""
  UNION ALL SELECT doc_id, x.c, CAST(x.v AS BIGINT) FROM (SELECT doc_id, unnest([{{'c':'USERPATH','v':len(regexp_extract_all(text,'(?:^|[^A-Za-z0-9])[A-Za-z]:[\\\\/]+Users[\\\\/]+'))}}, {{'c':'SISTER','v':contains(lower(text),'{texts.WORD}')::INT}},
    {{'c':'PROGDATA','v':contains(text,'ProgramData')::INT}}, {{'c':'SECRET','v':regexp_matches(text,'{masking.SECRET_KEY}')::INT}}]) AS x FROM ({_PAGES}) WHERE doc_id%2=0) WHERE x.v>0""")
def audit_files(spark, d):
    """All pages as files, every second with a zero byte in front: these are searched as bytes, the others by line."""
    k = F.col("page_id")
    said = F.concat(F.when(k % 3 == 0, "at C:\\Users\\x ").otherwise(""), F.when(k % 5 == 0, "sk-abcdefghijklmnopqrst ").otherwise(""), F.col("html")).cast("binary")
    files = table(spark, d, "pages").where("html is not null").select("page_id", F.when(k % 2 == 0, F.concat(F.lit(b"\0"), said)).otherwise(said).alias("content"))
    return privacy.audit_files(files, "page_id", "content", [texts.WORD])


# --- samples ---

@query("""SELECT c_custkey AS id, CASE WHEN c_custkey%3=0 THEN translate(t,'0123456789','０１２３４５６７８９') ELSE t END AS line
  FROM (SELECT c_custkey, CASE WHEN c_custkey%2=0 AND length(c_name)>3 THEN concat(c_name[:3],' ',c_name[4:]) ELSE c_name END AS t FROM customer)""")
def gen_noisy_lines(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), generation.noisy_line(F.col("c_name"), k % 2 == 0, k % 3 == 0).alias("line"))


#: People who get the name of another one.
NAMESAKES = [(1, 12), (3, 24), (5, 36), (7, 48), (9, 50)]
_GIVEN = f"(VALUES {', '.join(map(str, NAMESAKES))}) AS g(one, two)"


@query(sql(f"SELECT p.pid, coalesce(o.name, p.name) AS name FROM profile p LEFT JOIN {_GIVEN} ON p.pid=g.two LEFT JOIN profile o ON o.pid=g.one"))
def gen_homonyms(spark, d):
    """All people, five of them under the name of another."""
    return generation.homonyms(profiles(spark, d), "pid", NAMESAKES).select("pid", "name")


@query(sql(f"SELECT pid, rn, company FROM expr x WHERE NOT EXISTS (SELECT 1 FROM {_GIVEN} JOIN expr o ON o.pid=g.one WHERE g.two=x.pid AND o.company=x.company)"))
def gen_independent_jobs(spark, d):
    """All employments but those that would tie namesakes to the company of the other."""
    return generation.independent(jobs(spark, d), "pid", NAMESAKES).select("pid", "rn", "company")
