"""The registered queries of this subpackage: thin layers that apply an operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, divergence, fill_middle, host_rules, line_dedup, minhash, packing, prefix_tokens, sharding, site_quality, sketches, suffixes, warc
from .common import scratch, table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document's text and the text decoded from them, as digests."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), path, pattern, keep=["doc_id"])
    ids = ids.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
                     F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"))
    out = byte_bpe.decode(ids, path, pattern)
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back: digests of its whole payload, and what it revisits."""
    path = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    if not spark.read.format("binaryFile").load(path).select("path").take(1):
        return spark.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, whole boolean")
    out = warc.payloads(warc.reassembled(warc.read_archives(spark, path)))
    digest = F.when(F.col("type") == "revisit", F.col("digest")).otherwise(F.sha2("payload", 256))
    return out.select("page_id", "payload_bytes", digest.alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", "whole")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every text and of its edited text, whose second half is replaced by the start of the next document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = sketches.with_sketch(docs, "text", "own")
    docs = sketches.with_next(docs, "doc_id", F.struct("text", "own"), "next")
    docs = docs.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("n_new", F.expr("cast(n_chars div 2 as int)"))
    docs = docs.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - n_new), substring(next.text, 1, n_new))"))
    docs = sketches.with_sketch(docs, "edited", "edited_sketch")
    return docs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        sketches.as_text(F.col("own")).alias("fingerprint"), sketches.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketches.resemblance(F.col("own"), F.col("edited_sketch")).alias("near_edited"),
        sketches.resemblance(F.col("own"), F.col("next.own")).alias("near_next"),
        sketches.containment(F.col("edited_sketch"), F.col("own")).alias("edited_within_own"),
        sketches.distinct_count(F.col("own")).alias("n_shingles_estimate"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards whose counts differ by one at most and which hold every source in proportion."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.interleave(docs, "source", ["doc_id", "text_crc32", "size"], shards=16, seed=1)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document, the lines that are like an earlier line of this or another document."""
    out = line_dedup.removed_lines(table(spark, sf_dir, "documents"), least_words=1)
    return out.select(F.col("id").alias("doc_id"), "n_lines", F.size("removed").alias("n_removed"), F.col("removed").alias("removed_lines"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of at most 2048."""
    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(F.col("doc").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents over 4-word shingles at a similarity of 0.8."""
    out = minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts of every document, and whether it and its host pass."""
    out = host_rules.judge(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), *host_rules.NAMES, "base_failed", (~F.col("base_failed") & F.col("host_ok")).alias("kept"), F.round("host_rate", 6).alias("host_rate"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes in 400-byte strings that also start elsewhere."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    out = suffixes.without_repeats(docs.select("doc_id", size, "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("text").cast("string")).alias("kept_text"))


def op10_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by its own features, its source and its language within the source."""
    out = site_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines cut in three and put in another order, and the text rebuilt from that, as digests."""
    out = fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"), grammar=fill_middle.LINES, seed=7, rate=100, spm_share=50)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
                      F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source is from the others of its language, and the terms that set it apart."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, and how many characters of it 4096 tokens hold."""
    out = prefix_tokens.count(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], budget=4096)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "fit_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_warc": op2_warc,
    "op3_fingerprints": op3_fingerprints,
    "op4_sharding": op4_sharding,
    "op5_line_dedup": op5_line_dedup,
    "op6_packing": op6_packing,
    "op7_minhash": op7_minhash,
    "op8_host_rules": op8_host_rules,
    "op9_suffix_array": op9_suffix_array,
    "op10_site_quality": op10_site_quality,
    "op11_fill_middle": op11_fill_middle,
    "op12_divergence": op12_divergence,
    "op13_prefix_tokens": op13_prefix_tokens,
}

_WORDS = r"list_filter(string_split_regex({}, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: DuckDB SQL where it can say the same over whole tables.
ORACLES: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY sha256(html)) AS first, strlen(html) AS n FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to, true AS whole FROM f""",
    "op7_minhash": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
        g AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT g.doc_id, coalesce(n, 0) AS n_shingles, component_id, g.doc_id = component_id AS kept FROM g LEFT JOIN n ON n.doc_id = g.doc_id""",
    "op8_host_rules": f"""
        WITH w AS (SELECT doc_id, coalesce('=' || source, '-') AS site, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        t AS (SELECT doc_id, i, w[i] || chr(1) || w[i+1] || chr(1) || w[i+2] AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w)),
        d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM t) WHERE c > 1),
        m AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM d, (VALUES (0), (1), (2)) v(j) GROUP BY doc_id),
        x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
        y AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM x WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') GROUP BY doc_id),
        c AS (SELECT w.doc_id, site, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
            CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(y.n, 0) AS n_dup_lines, coalesce(m.n, 0) AS n_repeat_words
          FROM w LEFT JOIN m ON m.doc_id = w.doc_id LEFT JOIN y ON y.doc_id = w.doc_id),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
        h AS (SELECT site, sum(base_failed::INT)::DOUBLE AS bad, count(*)::DOUBLE AS n FROM b GROUP BY site),
        p AS (SELECT sum(bad) AS g, sum(n) AS t, count(*) AS h, sum(bad * bad / n) AS q, (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1) AS m FROM h),
        e AS (SELECT m, least(1e6::DOUBLE, greatest(1::DOUBLE, m * (1 - m) / greatest((q - 2 * m * g + m * m * t - (h - 1) * m * (1 - m)) / greatest(t, 1), 1e-9::DOUBLE) - 1)) AS s FROM p),
        r AS (SELECT site, round((bad + m * s) / (n + s), 6) AS rate FROM h, e)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept, rate AS host_rate FROM b JOIN r ON r.site = b.site""",
    "op11_fill_middle": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
            CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
        c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST(least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS BIGINT) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
        p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a+1:b], '') AS m, array_to_string(u[b+1:n], '') AS s FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
          sha256(CASE WHEN form = 'plain' THEN text ELSE p || m || s END) AS restored_sha256 FROM p""",
    "op12_divergence": rf"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        t AS (SELECT doc_id, lang, source, unnest(terms) AS term FROM d),
        k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 3),
        v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
        n AS (SELECT g.lang, g.source, coalesce(sum(n), 0) + coalesce(max(v), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source LEFT JOIN v ON v.lang = g.lang GROUP BY ALL),
        p AS (SELECT n.lang, n.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // n.total AS BIGINT) AS p
          FROM n JOIN k ON k.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
        lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
        ln AS (SELECT lang, sum(n) AS n FROM lc GROUP BY lang),
        q AS (SELECT lc.lang, lc.term, CAST(1 + (1000000000::HUGEINT * (lc.n + 1)) // (ln.n + v.v) AS BIGINT) AS q FROM lc JOIN ln ON ln.lang = lc.lang JOIN v ON v.lang = lc.lang),
        x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p)::HUGEINT * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
          UNION ALL SELECT p.lang, source, 'term', p.term, CAST((p - q)::HUGEINT * (p - q) // q AS BIGINT) FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p > q),
        o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
        SELECT * FROM o WHERE part = 'pair' OR rank <= 200""",
}
