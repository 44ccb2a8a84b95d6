"""Text normalisation, date points and ranges, and splitting of skill lines, as column expressions."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "一-鿿"
#: Full-width digits, hyphen, lower-case and upper-case letters, and what they stand for.
HALF = "0123456789-abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
FULL = "".join(chr(ord(c) + 0xFEE0) for c in HALF)

#: Patterns (Java).
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"
DATE = r"\d{4}(?:[-/年]\d{1,2}月?)?"
RANGE = rf"({DATE})\s*(?:(?:(?:[-~至]\s*)?(至今))|[-~至]\s*({DATE}))"
PHONE = r"(?<!\d)1[3-9]\d(?:[-\s]?\d{4}){2}(?!\d)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SEPARATOR = r"[、，,/·|]"


#: Fixed value: the characters that Unicode counts as white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def once(x: Column, f) -> Column:
    """f(x) where x is evaluated once, however often f uses it: branches of conditions and lambdas would evaluate it anew each time."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strip(x: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(x, F.lit(WHITE))


def blank_to_null(x: Column) -> Column:
    return F.nullif(strip(x), F.lit(""))


def to_halfwidth(x: Column) -> Column:
    return F.translate(x, FULL, HALF)


def clean_pseudo_spaces(x: Column) -> Column:
    """Drops a space after a Chinese character unless white space or a bar follows; runs of spaces become one."""
    return F.regexp_replace(F.regexp_replace(x, rf"(?<=[{CJK}]) (?=[^\s|])", ""), " {2,}", " ")


def normalize_line(x: Column, clean_spaces: bool = True) -> Column:
    x = to_halfwidth(x)
    return strip(clean_pseudo_spaces(x) if clean_spaces else x)


def physical_lines(text: Column) -> Column:
    """The lines of a text in order; a line end at the very end opens no further line."""
    return once(F.split(text, LINE_END, -1), lambda lines: F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines))


def _parts(x: Column, pattern: str, n: int) -> Column:
    """ARRAY<STRING>: the n groups of a pattern that x matches from its start; empty ones where it doesn't."""
    return F.split(F.regexp_replace(x, rf"{pattern}[\s\S]*|\A[\s\S]*\z", ",".join(f"${i + 1}" for i in range(n))), ",")


def _point(year: Column, month: Column) -> Column:
    """Of groups: digits or nothing. A cast that fails costs an exception each time."""
    return once(F.nullif(month, F.lit("")).cast("int"), lambda m: F.when(m.between(1, 12), F.concat_ws("-", year, F.lpad(m.cast("string"), 2, "0"))))


def date_point(x: Column) -> Column:
    """YYYY-MM of `2022-07`, `2022/7` or `2022年7月`; null without a valid month."""
    return once(_parts(strip(x), r"^(\d{4})[-/年](\d{1,2})月?$", 2), lambda p: _point(p[0], p[1]))


def parse_range(x: Column) -> Column:
    """STRUCT<start, end> of a date range, end null where it goes on; null where it isn't one."""
    date = DATE.replace(r"(?:[-/年]\d{1,2}月?)?", r"(?:[-/年](\d{1,2})月?)?").replace(r"\d{4}", r"(\d{4})")
    parts = _parts(x, rf"^\s*{RANGE.replace(f'({DATE})', date)}\s*$", 5)
    read = once(parts, lambda p: F.struct(_point(p[0], p[1]).alias("start"), (p[2] == "至今").alias("going"), _point(p[3], p[4]).alias("end")))
    return once(read, lambda r: F.when(r["start"].isNotNull() & (r["going"] | r["end"].isNotNull()), F.struct(r["start"].alias("start"), F.when(~r["going"], r["end"]).alias("end"))))


def first_phone(x: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(x, PHONE, 0), r"[-\s]", ""), F.lit(""))


def first_email(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, EMAIL, 0), F.lit(""))


def normalize_degree(x: Column) -> Column:
    """The degree of the enumeration that x names; null for others."""
    #: Fixed values.
    known = {"大专": "大专", "本科": "本科", "硕士": "硕士", "博士": "博士", "其他": "其他", "研究生": "硕士", "专科": "大专", "硕士研究生": "硕士", "博士研究生": "博士"}
    pairs = F.create_map(*(F.lit(v) for kv in known.items() for v in kv))
    return F.try_element_at(pairs, strip(x))


def month_index(x: Column) -> Column:
    """Months since year 0 of YYYY-MM; null where it isn't one."""
    parts = F.split(x, "-")
    return F.get(parts, F.lit(0)).try_cast("int") * 12 + F.get(parts, F.lit(1)).try_cast("int")


def _alternatives(pool: list[str]) -> str:
    return "|".join(re.sub(r"([^\w])", r"\\\1", v) for v in sorted(pool, key=len, reverse=True))


def lexicon_segment(x: Column, pool: list[str]) -> Column:
    """The items of a string that is nothing but two or more known ones, longest first at each place; null for others."""
    items = F.when(x.rlike(rf"(?i)^(?>\s*(?:{_alternatives(pool)})\s*)++$"), F.regexp_extract_all(x, F.lit(rf"(?i)((?>\s*(?:{_alternatives(pool)})\s*))"), 1))
    return once(items, lambda found: F.when(F.size(found) >= 2, found))


def split_content(x: Column, pool: list[str]) -> Column:
    """The labels of a line: known ones without separators, else parts between separators, where neighbours that make a known one join again."""
    held = [v.lower() for v in pool if re.search(SEPARATOR, v)]  # others can't be what is on both sides of a separator
    known = F.array(*(F.lit(v) for v in held))

    def folded(cut: Column) -> Column:
        pieces, marks = cut["pieces"], cut["marks"]

        def step(done: Column, i: Column) -> Column:
            piece = F.get(pieces, i)
            joined = F.concat(F.element_at(done, -1), F.get(marks, i - 1), piece)
            again = (F.size(done) > 0) & F.array_contains(known, F.lower(strip(joined)))
            return F.when(again, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(piece)))

        return F.aggregate(F.sequence(F.lit(0), F.size(pieces) - 1), F.array().cast("array<string>"), step)

    cut = F.struct(F.split(x, SEPARATOR, -1).alias("pieces"), F.regexp_extract_all(x, F.lit(f"({SEPARATOR})"), 1).alias("marks"))
    pieces = F.split(x, SEPARATOR, -1)
    if held:
        some = functools.reduce(Column.__or__, (F.lower(x).contains(v) for v in held))
        pieces = F.when(some, once(cut, folded)).otherwise(pieces)
    parts = F.filter(F.transform(pieces, strip), lambda v: v != "")
    return F.coalesce(lexicon_segment(x, pool), parts)
