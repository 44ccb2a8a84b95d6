"""Texts cut by a dictionary that is a table: entries of any number meet the places of texts by equi-joins.

A text is all entries or it isn't cut: at each place the longest entry goes, with the white space around it. Places of texts are keyed by their
next characters, in each length that entries have, so that a match is equality of keys; texts that have a character of no entry, or don't begin
with an entry, have left before places are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SEPARATOR, WHITE, once, strip
from ..storage import stored

#: A dictionary, or what is found of texts, of at most so many bytes is broadcast.
SMALL = 16 << 20
#: Characters that are looked at first, before a whole text is.
AHEAD = 32
_LEAD = r"(?U)^\s+"
_SPACE = r"(?U)^\s$"


def entries(lexicon: DataFrame, entry: str = "entry") -> DataFrame:
    """(entry): the distinct entries of a column, in lower case and without white space at both ends; blanks are left out."""
    return lexicon.select(F.lower(strip(F.col(entry))).alias("entry")).where("entry is not null and entry != ''").distinct()


def _lengths(known: DataFrame) -> list[int]:
    """The lengths that entries have: as many numbers as the longest has characters, at most."""
    return sorted(r.n for r in known.select(F.length("entry").alias("n")).distinct().collect())


def _letters(known: DataFrame) -> str:
    """The characters that entries are made of: a text that has others isn't made of entries. There are as many as Unicode has, at most."""
    return "".join(sorted(r.c for r in known.select(F.explode(F.split("__e", "")).alias("c")).distinct().collect() if r.c))


def _starts(text: Column, at: Column | int, lengths: list[int]) -> Column:
    """ARRAY<STRING>: the next characters of a text from a place on, in each length that the text has room for."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.filter(F.array(*(F.when(F.length(text) - at + 1 >= n, F.substring(text, at, F.lit(n))) for n in lengths)), lambda x: x.isNotNull())


def segmented(texts: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """key, items: of texts that are nothing but two or more entries, what stands for each; other texts have no row. Keys are distinct.

    Items are parts of the text as it is written and make it up together. Entries are those of entries().
    """
    lengths = _lengths(known)
    if not lengths:
        return texts.select(F.col(f"`{key}`").alias(key), F.array().cast("array<string>").alias("items")).where("false")
    known = stored(known.select(F.col("entry").alias("__e")), "entries")
    rows_of = known.count() * (max(lengths) * 3 + 64)  # bytes, at most
    meets = F.broadcast(known) if rows_of <= SMALL else known.hint("merge")
    rows = texts.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"), F.lower(F.col(f"`{text}`")).alias("__low")).where(F.length("__low") == F.length("__text"))
    letters = _letters(known)
    of_letters = lambda x: F.translate(x, letters, "").rlike(r"(?U)^\s*$")
    rows = stored(rows.where((F.col("__low") != "") & of_letters(F.substring("__low", 1, AHEAD)) & of_letters(F.col("__low"))), "made-of")
    first = rows.select("__key", F.explode(F.array_distinct(_starts(F.regexp_replace("__low", _LEAD, ""), 1, lengths))).alias("__s"))
    begun = first.join(meets, F.col("__s") == F.col("__e"), "left_semi").select(F.col("__key").alias("__begun")).distinct()
    rows = stored(rows.join(begun, F.col("__key") == F.col("__begun"), "left_semi"), "begun")
    # a place has the longest entry that begins there: n; white space has none, 0
    window = F.expr(f"substring(__low, __at, {max(lengths)})")
    places = rows.where("length(__low) > 0").select("__key", "__low", F.explode(F.expr("sequence(1, length(__low))")).alias("__at")).select("__key", "__at", window.alias("__w"))
    space = F.substring("__w", 1, 1).rlike(_SPACE)
    met = places.where(~space).select("__key", "__at", F.explode(_starts(F.col("__w"), 1, lengths)).alias("__s")).join(meets, F.col("__s") == F.col("__e"))
    found = met.groupBy("__key", "__at").agg(F.max(F.length("__s")).alias("__n")).unionByName(places.where(space).select("__key", "__at", F.lit(0).alias("__n")))
    walked = found.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("__at", "__n"))).alias("__m"))

    def step(done: Column, m: Column) -> Column:
        here = m["__at"] == done["next"]
        return F.struct(F.when(here, m["__at"] + F.greatest(m["__n"], F.lit(1))).otherwise(done["next"]).alias("next"),
                        F.when(here & (m["__n"] > 0), F.concat(done["at"], F.array(m["__at"]))).otherwise(done["at"]).alias("at"))

    walk = F.aggregate("__m", F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("at")), step)
    walked = stored(walked.select(F.col("__key").alias("__of"), walk.alias("__walk")), "walks")
    whole = rows.join(walked, F.col("__key") == F.col("__of"))
    whole = whole.where("__walk.next = length(__low) + 1 and size(__walk.at) >= 2").withColumn("__at", F.concat(F.array(F.lit(1)), F.expr("slice(__walk.at, 2, size(__walk.at))"), F.array(F.expr("length(__text) + 1"))))
    items = F.expr("transform(sequence(1, size(__at) - 1), i -> substring(__text, element_at(__at, i), element_at(__at, i + 1) - element_at(__at, i)))")
    return whole.select(F.col("__key").alias(key), items.alias("items"))


def _with(rows: DataFrame, found: DataFrame, of: str) -> DataFrame:
    """rows with what was found of some of them, by the key `of`. If that is little, it goes to the rows, which aren't shuffled then."""
    found = stored(found, "found")
    size = found.agg(F.sum(F.octet_length(F.to_json(F.struct(*found.columns)))).cast("bigint")).first()[0] or 0
    return rows.join(F.broadcast(found) if size <= SMALL else found.hint("merge"), F.col("__key") == F.col(of), "left").drop(of)


def split_labels(texts: DataFrame, key: str, text: str, known: DataFrame, white: str = WHITE) -> DataFrame:
    """key, items: every text's labels. A text of nothing but entries is cut between them; others are cut at separators, where neighbours that make
    an entry together (the text between them included) join again, from left to right. Keys are distinct; null texts have no labels. White space at both ends of a label goes.
    """
    cut = segmented(texts, key, text, known).select(F.col(key).alias("__cut"), F.col("items").alias("__items"))
    rows = texts.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    pieces, marks = F.split("__text", SEPARATOR, -1), F.regexp_extract_all("__text", F.lit(f"({SEPARATOR})"), 1)
    parted = F.struct(pieces.alias("pieces"), marks.alias("marks"))
    marked = stored(known.withColumn("__m", F.size(F.regexp_extract_all("entry", F.lit(f"({SEPARATOR})"), 1))).where("__m > 0"), "marked-entries")
    most, longest = marked.agg(F.max("__m"), F.max(F.length("entry"))).first()
    none = F.array().cast("array<string>")
    if most is None:
        out = rows.withColumn("__known", none)
    else:
        # runs of neighbours, up to as many as any entry has parts, that make an entry; lower case is never shorter
        tokens = once(parted, lambda c: F.flatten(F.transform(c["pieces"], lambda p, i: F.array(p, F.coalesce(F.get(c["marks"], i), F.lit(""))))))
        run = lambda t, i, n: strip(F.array_join(F.slice(t, 2 * i + 1, 2 * n - 1), ""))
        runs_at = lambda t, i: F.transform(F.sequence(F.lit(2), F.least(F.lit(most + 1), (F.size(t) / 2).cast("int") - i)), lambda n: run(t, i, n))
        runs = once(tokens, lambda t: F.flatten(F.transform(F.sequence(F.lit(0), (F.size(t) / 2).cast("int") - 2), lambda i: runs_at(t, i))))
        runs = F.transform(F.filter(runs, lambda r: F.length(r) <= longest), F.lower)
        # an explode that isn't an outer one would make all runs again for the conditions that Spark infers
        each = rows.where(F.col("__text").rlike(SEPARATOR)).select("__key", F.explode_outer(runs).alias("__run")).where("__run is not null")
        met = each.join(marked.select("entry"), F.col("__run") == F.col("entry"), "left_semi").groupBy(F.col("__key").alias("__of")).agg(F.collect_set("__run").alias("__known"))
        out = _with(rows, met, "__of").withColumn("__known", F.coalesce("__known", none))

    def folded(c: Column) -> Column:
        def step(done: Column, i: Column) -> Column:
            piece = F.get(c["pieces"], i)
            joined = F.concat(F.element_at(done, -1), F.get(c["marks"], i - 1), piece)
            again = (F.size(done) > 0) & F.array_contains("__known", F.lower(strip(joined)))
            return F.when(again, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(piece)))
        return F.aggregate(F.sequence(F.lit(0), F.size(c["pieces"]) - 1), none, step)

    plain = F.when(F.size("__known") == 0, pieces).otherwise(once(parted, folded))
    parts = F.filter(F.transform(plain, lambda v: F.btrim(v, F.lit(white))), lambda v: v != "")
    return _with(out, cut, "__cut").select(F.col("__key").alias(key), F.coalesce("__items", parts, none).alias("items"))
