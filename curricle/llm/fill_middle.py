"""Fill-in-the-middle texts: a text's units are cut in three and put in another order, between marks.

A unit grammar says how a text falls into units. Each is translated to a regular expression of no width that matches between two
neighbouring characters, by their classes, so that split() cuts there and loses nothing. An empty text has no unit; as split() would
give one empty piece for it, it is handled apart. All of it is built-in functions on columns: one row at a time, no shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

MARKS = ("<P>", "<S>", "<M>")
ANY = r"[\s\S]"


@dataclass(frozen=True)
class Grammar:
    """What a unit is: `pattern` matches units from left to right over the code points of a text; `boundary` matches, without width, between two of them."""

    pattern: str
    boundary: str


def ended_by(chars: str) -> Grammar:
    """Units end with a character of the class `chars` (or with the text): lines are ended_by("\\\\n")."""
    return Grammar(f"[^{chars}]*[{chars}]|[^{chars}]+", f"(?<=[{chars}])(?={ANY})")


def begun_by(chars: str) -> Grammar:
    """Each character of the class begins a unit, and so does the text."""
    return Grammar(f"[{chars}][^{chars}]*|[^{chars}]+", f"(?<={ANY})(?=[{chars}])")


def led_by(chars: str) -> Grammar:
    """A run of other characters with the run of the class before it: words with the space before them are led_by("\\\\s")."""
    return Grammar(f"[{chars}]*[^{chars}]+|[{chars}]+", f"(?<=[^{chars}])(?=[{chars}])")


def followed_by(chars: str) -> Grammar:
    """A run of other characters with the run of the class after it: words with the space after them are followed_by("\\\\s")."""
    return Grammar(f"[^{chars}]+[{chars}]*|[{chars}]+", f"(?<=[{chars}])(?=[^{chars}])")


def runs_of(chars: str) -> Grammar:
    """Runs of characters of the class and runs of others."""
    return Grammar(f"[{chars}]+|[^{chars}]+", f"(?<=[{chars}])(?=[^{chars}])|(?<=[^{chars}])(?=[{chars}])")


LINES = ended_by(r"\n")
WORDS = followed_by(r"\s")
CHARACTERS = Grammar(ANY, f"(?<={ANY})(?={ANY})")


def units(text: Column, grammar: Grammar = LINES) -> Column:
    """The array of a text's units, in order; joined they are the text. A null or empty text has none."""
    return F.when(F.coalesce(F.octet_length(text), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary, -1))


def _checked(marks: tuple[str, str, str]) -> str:
    """The marks as one expression; no mark may hold, or begin with the end of, a mark, as outputs couldn't be read back then."""
    for a in marks:
        for b in marks:
            if not a or (a != b and a in b) or any(a[k:] == b[: len(a) - k] for k in range(1, len(a))):
                raise ValueError(f"marks {a!r} and {b!r} overlap")
    if len({*marks}) != 3:
        raise ValueError("marks must differ")
    return "|".join(map(re.escape, marks))


def transform(df: DataFrame, id_: str = "doc_id", text: str = "text", grammar: Grammar = LINES, seed: int = 7, rate: int = 100, spm_share: int = 50,
              marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """df with n (units), form, output and prefix, middle, suffix (null where the form is plain); columns of df of these names are replaced.

    The cuts and the form of a row hang on seed and id alone: four numbers are the first four 8-digit groups of the hexadecimal SHA-256 of
    "seed:id". The prefix ends after the smaller of the first two (modulo n + 1) units and the middle after the larger. The form is plain, with
    the text as output, if the text is empty or holds a mark, or the third number modulo 100 is not below `rate`; else spm
    (suffix, prefix, middle) if the fourth modulo 100 is below `spm_share`, else psm. A null text counts as empty, its output is empty; a null
    id as an empty one. Repeated rows are cut alike. Other columns may have any names; an empty table gives an empty result. A text is held whole, in one row.
    """
    pattern = _checked(marks)
    p, s, m = marks
    made = ["n", "form", "output", "prefix", "middle", "suffix"]
    kept = [c for c in df.columns if c.lower() not in made]
    body, parts, digest, a, b, kind, pre, mid, suf = fresh(df, "body", "units", "digest", "a", "b", "kind", "pre", "mid", "suf")
    number = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")
    rows = df.withColumn(body, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    rows = rows.withColumn(parts, units(F.col(body), grammar)).withColumn(digest, F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_}`").cast("string"), F.lit(""))), 256))
    n = F.size(parts)
    rows = rows.withColumn(a, F.least(number(0) % (n + 1), number(1) % (n + 1)).cast("int")).withColumn(b, F.greatest(number(0) % (n + 1), number(1) % (n + 1)).cast("int"))
    plain = (n == 0) | F.col(body).rlike(pattern) | (number(2) % 100 >= rate)
    rows = rows.withColumn(kind, F.when(plain, "plain").when(number(3) % 100 < spm_share, "spm").otherwise("psm"))
    cut = lambda start, length: F.when(F.col(kind) != "plain", F.array_join(F.slice(parts, start, length), ""))
    rows = (rows.withColumn(pre, cut(F.lit(1), F.col(a))).withColumn(mid, cut(F.col(a) + 1, F.col(b) - F.col(a))).withColumn(suf, cut(F.col(b) + 1, n - F.col(b))))
    output = (F.when(F.col(kind) == "psm", F.concat(F.lit(p), pre, F.lit(s), suf, F.lit(m), mid))
              .when(F.col(kind) == "spm", F.concat(F.lit(s), suf, F.lit(p), pre, F.lit(m), mid)).otherwise(F.col(body)))
    return rows.select(*(F.col(f"`{c}`") for c in kept), n.cast("long").alias("n"), F.col(kind).alias("form"), output.alias("output"),
                       F.col(pre).alias("prefix"), F.col(mid).alias("middle"), F.col(suf).alias("suffix"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from an output and its form alone."""
    _checked(marks)
    p, s, m = map(re.escape, marks)
    return (F.when(form == "psm", F.regexp_replace(output, f"(?s)\\A{p}(.*){s}(.*){m}(.*)\\z", "$1$3$2"))
            .when(form == "spm", F.regexp_replace(output, f"(?s)\\A{s}(.*){p}(.*){m}(.*)\\z", "$2$3$1")).otherwise(output))
