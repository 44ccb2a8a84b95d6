"""Fields, experiences, skills and certificates of resumes, each with the line that shows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.text import CJK, RANGE, blank_to_null, date_point, first_email, first_phone, normalize_degree, parse_range, split_content, strip
from ..storage import stored
from ..types import CARD, EXPERIENCE, FIELD, SCHEMA_VERSION
from .sections import HEADERS, joined, with_sections

#: Labels of fields.
LABELS = {"name": "姓名", "phone": "电话", "email": "邮箱", "degree": "学历", "school": "毕业院校", "major": "专业", "graduation_date": "毕业时间", "desired_position": "期望职位"}
#: Characters that a major doesn't start or end with, and the pattern of school names.
EDGE = " 　\t.-~至|·、，,/（）()"
SCHOOL = rf"(?<![{CJK}])([{CJK}]{{2,}}?(?:大学|学院|学校))"
#: Patterns of an employment on one line, with bars between its parts or with its dates first.
PIPE, DATED = r"^([^|]+?)\s*\|\s*([^|]+?)\s*\|\s*(.+)$", rf"^({RANGE})\s+(\S.*)$"
DEGREE = "（(大专|本科|硕士|博士|研究生)）"


def label_value(field: str, text: Column) -> Column:
    """The valid value that a line labels as `field`; null where it has none."""
    value = blank_to_null(F.regexp_extract(text, f"^{LABELS[field]}：(.+)$", 1))
    return {"degree": normalize_degree, "graduation_date": date_point, "phone": first_phone, "email": first_email}.get(field, lambda v: v)(value)


def labelled_fields(lines: DataFrame, key: str = "source_file") -> DataFrame:
    """key, field, value, raw, location, as_written: of each field, the first line with a valid value."""
    found = F.filter(F.array(*(F.struct(F.lit(f).alias("field"), label_value(f, F.col("text")).alias("value")) for f in LABELS)), lambda x: x["value"].isNotNull())
    rows = lines.where(F.col("text").contains("：")).select(key, "line_no", "raw", "location", "text", F.explode_outer(found).alias("f")).where("f is not null")
    first = rows.groupBy(key, F.col("f.field").alias("field")).agg(F.min(F.struct("line_no", F.col("f.value").alias("value"), "raw", "location", "text")).alias("x"))
    return first.select(key, "field", "x.value", "x.raw", "x.location", strip(F.substring_index("x.text", "：", -1)).alias("as_written"))


def first_contacts(lines: DataFrame, key: str = "source_file") -> DataFrame:
    """key and the first line with a phone number, an email address, and what may be a name: STRUCT<line_no, value, raw, location>."""
    text = F.col("text")
    name = F.when(text.rlike(f"^[{CJK}]{{2,4}}$") & ~text.isin(*HEADERS), text)
    first = lambda v: F.min(F.when(v.isNotNull(), F.struct("line_no", v.alias("value"), "raw", "location")))
    return lines.groupBy(key).agg(first(first_phone(text)).alias("phone"), first(first_email(text)).alias("email"), first(name).alias("name"))


def education(sections: DataFrame, key: str = "source_file") -> DataFrame:
    """Of each education section (lines joined): graduation_date, school, degree, degree_written, major, raw, location."""
    rows = joined(sections.where("section = 'edu'"), [key, "section_no"])
    head = rf"^\s*{RANGE}(?:\s+|$)"
    span = F.regexp_extract(F.col("text"), head, 0)
    rest = strip(F.regexp_replace(F.col("text"), head, ""))
    rows = rows.withColumn("span", span).withColumn("rest", F.when(F.col("span") != "", rest).otherwise(F.col("text")))
    school, degree = F.regexp_extract("rest", SCHOOL, 1), F.regexp_extract("rest", DEGREE, 1)
    cut = F.regexp_replace(F.col("rest"), DEGREE, "\u0001")  # the first of each goes
    cut = F.concat(F.substring_index(cut, "\u0001", 1), F.substring(F.col("rest"), F.length(F.substring_index(cut, "\u0001", 1)) + F.length(F.regexp_extract("rest", DEGREE, 0)) + 1, 1 << 30))
    rows = rows.withColumn("school", F.nullif(school, F.lit(""))).withColumn("degree_written", F.nullif(degree, F.lit(""))).withColumn("cut", cut)
    without = F.when(F.col("school").isNull(), F.col("cut")).otherwise(F.concat(F.expr("substring(cut, 1, instr(cut, school) - 1)"), F.expr("substring(cut, instr(cut, school) + length(school))")))
    major = F.nullif(F.btrim(without, F.lit(EDGE)), F.lit(""))
    return rows.select(key, "section_no", parse_range(F.col("span"))["end"].alias("graduation_date"), "school", normalize_degree(F.col("degree_written")).alias("degree"),
                       "degree_written", major.alias("major"), "raw", "location")


def experiences(sections: DataFrame, key: str = "source_file") -> DataFrame:
    """key, section_no, entry, company, title, start, end, confidence, lines (line_no, raw, location) of each employment.

    Three shapes open an entry: `company | title | range`, `range company title`, and a company on a line of its own before a
    title line. Later title and time lines of an entry overrule what came before.
    """
    rows = sections.where("section = 'exp'")
    text, order = F.col("text"), Window.partitionBy(key, "section_no").orderBy("line_no")
    rows = (rows.withColumn("next", F.coalesce(F.lead("text").over(order), F.lit("")))
            .withColumn("is_pipe", text.rlike(PIPE)).withColumn("pipe_span", parse_range(F.regexp_extract(text, PIPE, 3)))
            .withColumn("dated_span", F.when(~text.rlike(PIPE), parse_range(F.regexp_extract(text, DATED, 1))))
            .withColumn("words", F.split(strip(F.regexp_extract(text, DATED, 5)), r"(?U)\s+"))
            .withColumn("is_title", text.startswith("职位："))
            .withColumn("time_span", F.when(text.startswith("时间："), parse_range(F.regexp_replace(text, "^时间：", "")))))
    plain = ~F.col("is_pipe") & F.col("dated_span").isNull()
    detail = plain & (F.col("is_title") | F.col("time_span").isNotNull())
    before_title = F.col("next").startswith("职位：")
    opens = F.col("pipe_span").isNotNull() | F.col("dated_span").isNotNull() | (plain & ~detail & before_title)
    rows = rows.withColumn("detail", detail).withColumn("opens", opens).withColumn("maybe", opens | (detail & before_title))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("opens", F.col("opens") | (F.col("maybe") & (F.coalesce(F.count_if("maybe").over(earlier), F.lit(0)) == 0)))
    rows = rows.withColumn("entry", F.count_if("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("entry > 0")
    rows = rows.withColumn("span", F.when(F.col("opens"), F.coalesce("pipe_span", "dated_span")).when(F.col("detail"), F.col("time_span")))
    company = F.when(F.col("is_pipe"), strip(F.regexp_extract(text, PIPE, 1))).when(F.col("dated_span").isNotNull(), F.get("words", F.lit(0))).otherwise(text)
    title = (F.when(F.col("opens") & F.col("is_pipe"), strip(F.regexp_extract(text, PIPE, 2)))
             .when(F.col("opens") & F.col("dated_span").isNotNull(), F.nullif(F.array_join(F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))), " "), F.lit("")))
             .when(~F.col("opens") & F.col("detail") & F.col("is_title"), strip(F.regexp_replace(text, "^职位：", ""))))
    used = F.col("opens") | (F.col("detail") & (F.col("is_title") | F.col("span").isNotNull()))
    rows = rows.withColumn("company", company).withColumn("title", title)
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("line_no", c)))[c]
    out = rows.where(used).groupBy(key, "section_no", "entry").agg(
        F.max(F.when(F.col("opens"), F.col("company"))).alias("company"), last("title").alias("title"), last("span").alias("span"),
        F.max(F.when(F.col("opens"), F.when(F.col("is_pipe") | F.col("dated_span").isNotNull(), 0.85).otherwise(0.8))).alias("confidence"),
        F.array_sort(F.collect_list(F.struct("line_no", "raw", "location"))).alias("lines"))
    return out.select(key, "section_no", "entry", "company", "title", F.col("span.start").alias("start"), F.col("span.end").alias("end"), "confidence", "lines")


def content_items(sections: DataFrame, section: str, pool: list[str], key: str = "source_file") -> DataFrame:
    """key, section_no, pos, value, raw, location of the items of skill or certificate sections."""
    rows = joined(sections.where(F.col("section") == section), [key, "section_no"])
    # an explode that isn't an outer one would split each text three times: Spark infers two conditions on its array and pushes these down
    return rows.select(key, "section_no", F.posexplode_outer(split_content(F.col("text"), pool)).alias("pos", "value"), "raw", "location").where("pos is not null")


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extract_cards(files: DataFrame) -> DataFrame:
    """files (source_file, file_type, file_sha256, parsed_at) and their lines in `lines` (ARRAY<STRUCT<line_no, raw, text, location>>)
    as cards (types.CARD). Labels win over what is found by place, an earlier line over a later one; a field without evidence is absent.
    """
    key = "source_file"
    lines = files.select(key, F.explode("lines").alias("l")).select(key, "l.*").where(F.col("text") != "")
    sections = stored(with_sections(lines), "sections")  # read by every part below; headers hold no value
    file = _name(F.col(key))
    proof = lambda raw, location: F.array(F.struct(file.alias("source_file"), raw.alias("snippet"), location.alias("location")))

    def field(rank: int, name: Column, value: Column, confidence: float, raw: Column, location: Column, warning: Column | None = None) -> Column:
        warning = F.lit(None).cast("string") if warning is None else warning
        return F.struct(name.alias("field"), F.lit(rank).alias("rank"), value.alias("value"), F.lit(confidence).alias("confidence"), proof(raw, location).alias("evidence"), warning.alias("warning"))

    def each(rows: DataFrame, *fields: Column) -> DataFrame:
        """One row for each field that has a value."""
        return rows.select(key, F.explode(F.filter(F.array(*fields), lambda f: f["value"].isNotNull())).alias("f")).select(key, "f.*")

    degree_note = lambda written, value: F.when(written != value, F.concat(F.lit("degree 原文「"), written, F.lit("」按枚举归一为「"), value, F.lit("」")))
    raw, location = F.col("raw"), F.col("location")
    labels = labelled_fields(sections)
    note = F.when(F.col("field") == "degree", degree_note(F.col("as_written"), F.col("value")))
    found = [each(labels, field(0, F.col("field"), F.col("value"), 0.95, raw, location, note))]
    place = lambda n: (F.col(n)["value"], F.col(n)["raw"], F.col(n)["location"])
    found.append(each(first_contacts(sections), *(field(1, F.lit(n), v, c, r, at) for n, c in (("name", 0.9), ("phone", 0.95), ("email", 0.95)) for v, r, at in [place(n)])))
    warnings = {"graduation_date": F.lit("graduation_date 取教育区间终点（推断）"), "degree": degree_note(F.col("degree_written"), F.col("degree"))}
    found.append(each(education(sections), *(field(2, F.lit(n), F.col(n), c, raw, location, warnings.get(n)) for n, c in (("graduation_date", 0.8), ("school", 0.85), ("degree", 0.85), ("major", 0.8)))))
    wanted = sections.where("section = 'desired'").groupBy(key).agg(F.min(F.struct("line_no", "text", "raw", "location")).alias("x"))
    found.append(each(wanted, field(2, F.lit("desired_position"), F.col("x.text"), 0.9, F.col("x.raw"), F.col("x.location"))))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    one = rows.groupBy(key, "field").agg(F.min(F.struct("rank", "evidence", "value", "confidence", "warning")).alias("x"))
    fields = one.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("field", F.struct("x.value", "x.confidence", "x.evidence")))).alias("fields"),
        F.array_sort(F.collect_list("x.warning")).alias("warnings"))

    jobs = experiences(sections).select(key, F.struct("section_no", "entry", F.struct(
        "company", "title", "start", "end", "confidence",
        F.transform("lines", lambda l: F.struct(file.alias("source_file"), l["raw"].alias("snippet"), l["location"].alias("location"))).alias("evidence")).alias("e")).alias("x"))
    jobs = jobs.groupBy(key).agg(F.sort_array(F.collect_list("x"))["e"].alias("experiences"))

    def items(section: str, pool: list[str], out: str) -> DataFrame:
        x = content_items(sections, section, pool).select(key, F.struct("section_no", "pos", F.struct("value", F.lit(0.85).alias("confidence"), proof(raw, location).alias("evidence")).alias("v")).alias("x"))
        return x.groupBy(key).agg(F.sort_array(F.collect_list("x"))["v"].alias(out))

    cards = files.select(key, "file_type", "file_sha256", "parsed_at")
    for part in (fields, jobs, items("skills", lexicon.SKILLS, "skills"), items("certs", lexicon.CERTIFICATES, "certificates")):
        cards = cards.join(part, key, "left")
    empty = {"fields": f"MAP<STRING, {FIELD}>", "experiences": f"ARRAY<{EXPERIENCE}>", "skills": f"ARRAY<{FIELD}>", "certificates": f"ARRAY<{FIELD}>", "warnings": "ARRAY<STRING>"}
    cards = cards.withColumns({c: F.coalesce(F.col(c).cast(t), (F.create_map() if c == "fields" else F.array()).cast(t)) for c, t in empty.items()})
    return cards.withColumn("schema_version", F.lit(SCHEMA_VERSION)).select(*(x.split()[0] for x in _columns(CARD)))


def _columns(ddl: str) -> list[str]:
    """Top-level columns of a DDL string."""
    out, depth, held = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(held.strip())
            held = ""
        else:
            held += c
    return [*out, held.strip()]


def unsupported_evidence(cards: DataFrame, texts: DataFrame) -> DataFrame:
    """Snippets of cards that are no part of the raw text (there should be none): source_file, snippet."""
    parts = F.concat(F.flatten(F.transform(F.map_values("fields"), lambda f: f["evidence"])), F.flatten(F.transform("experiences", lambda e: e["evidence"])),
                     F.flatten(F.transform("skills", lambda s: s["evidence"])), F.flatten(F.transform("certificates", lambda s: s["evidence"])))
    rows = cards.select("source_file", F.explode(parts).alias("e")).select("source_file", "e.snippet")
    return rows.join(texts.select("source_file", "raw_text"), "source_file").where(~F.col("raw_text").contains(F.col("snippet"))).select("source_file", "snippet")
