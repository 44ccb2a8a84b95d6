import hashlib

import pytest
import regex
from curricle.llm import fill_middle as fm
from curricle.llm import queries
from pyspark.sql import functions as F

GRAMMARS = {"lines": fm.LINES, "words": fm.WORDS, "characters": fm.CHARACTERS, "begun": fm.begun_by("#a"), "led": fm.led_by(r"\s"), "runs": fm.runs_of(r"\s"), "emoji": fm.ended_by("\U0001f600")}
TEXTS = ["", None, " ", "\n", "\n\n", "a\nb", "a\nb\n", " a b  c ", "x\U0001f600y\U0001f600\U0001f600 \né́z", "\U0001f600", "ab\r\n c#d##a", "aa#", "日本\n語"]


def plain(doc_id, text, seed=7, rate=100, share=50, pattern=fm.LINES.pattern):
    """n, form, prefix, middle, suffix, output of one text, as the contract words it."""
    text = text or ""
    units = regex.findall(pattern, text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k: 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fm.MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, None, text
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    return (n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < share else (n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def row(r):
    return r.n, r.form, r.prefix, r.middle, r.suffix, r.output


@pytest.mark.parametrize("name", GRAMMARS)
def test_boundaries_cut_what_patterns_match(spark, name):
    g = GRAMMARS[name]
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    for r in df.select("text", fm.units(F.col("text"), g).alias("u")).collect():
        assert r.u == regex.findall(g.pattern, r.text or "")


@pytest.mark.parametrize("how", [{}, {"seed": 1, "rate": 50, "spm_share": 0}, {"rate": 0}, {"spm_share": 100, "grammar": fm.CHARACTERS}])
def test_rows(spark, corpus, how):
    texts = [*corpus, *((900 + i, t, None, None, None) for i, t in enumerate([*TEXTS, "has <P> in it", "has <M>", "<S", "S>", "<<S", "P><"]))]
    df = spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = fm.transform(df, **how)
    args = {"seed": how.get("seed", 7), "rate": how.get("rate", 100), "share": how.get("spm_share", 50), "pattern": how.get("grammar", fm.LINES).pattern}
    rows = out.withColumn("back", fm.restored(F.col("output"), F.col("form"))).collect()
    want = {i: (t, plain(i, t, **args)) for i, t, *_ in texts}
    assert len(rows) == len(want)
    for r in rows:
        text, expected = want[r.doc_id]
        assert row(r) == expected and r.back == (text or "")


def test_odd_tables(spark, odd, nothing):
    out = fm.transform(odd.withColumn("__body", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("form", F.lit("x")))
    rows = out.collect()
    assert out.columns.count("form") == 1 and {"__body", "a.b", "h", "ids"} <= {*out.columns}
    assert sorted(map(str, map(row, rows))) == sorted(str(plain(r.doc_id, r.text)) for r in odd.collect()) and all(r["a.b"] == 2 for r in rows)
    assert fm.transform(nothing).count() == 0


def test_very_long_text(spark):
    text = "line\n" * 200_000 + "z" * 2_000_000
    df = spark.createDataFrame([(5, text)], "doc_id bigint, text string")
    r = fm.transform(df).withColumn("back", fm.restored(F.col("output"), F.col("form"))).first()
    assert row(r) == plain(5, text) and r.back == text


def test_marks_that_overlap(spark, docs):
    for marks in [("<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("a", "bab", "c"), ("", "b", "c")]:
        with pytest.raises(ValueError):
            fm.transform(docs, marks=marks)
    out = fm.transform(docs, marks=("{p}", "{s}", "{m}")).select("text" if "text" in docs.columns else "output", "output", "form", fm.restored(F.col("output"), F.col("form"), ("{p}", "{s}", "{m}")).alias("back"))
    assert all(r.back == (r.text or "") for r in out.collect())


def test_query(spark, data):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op11_fill_middle(spark, data).collect()
    assert len(rows) == len(texts)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in rows:
        n, form, p, m, _, output = plain(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, None if p is None else len(p), None if m is None else len(m))
        assert (r.output_sha256, r.restored_sha256) == (sha(output), sha(texts[r.doc_id]))
