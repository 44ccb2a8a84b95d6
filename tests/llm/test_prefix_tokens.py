import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from curricle.llm import prefix_tokens as pt
from curricle.llm import queries
from curricle.llm.common import raw
from pyspark.sql import functions as F

PATH = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = ["a", "b", "c", "e", "t", "h", " ", "  ", "\n", "é", "日", "本", "\U0001f600", "▁", "1", "0", "-", "=", "ing", "tion", "T", "\t", ".", "\0", "<s>", "<0x0A>"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def counter():
    return pt.PrefixCounter(PATH)


def of(counter, texts):
    return counter.texts(*raw(pa.array(texts, pa.string())))


def check(counter, model, texts):
    found = of(counter, texts)
    assert found.totals().tolist() == [len(x) for x in model.encode(texts)] and found.n_chars().tolist() == [len(t) for t in texts]
    fits = {n: found.within(n).tolist() for n in (0, 1, 3, 8)}
    for i, t in enumerate(texts):
        want = [len(x) for x in model.encode([t[:k] for k in range(len(t) + 1)])]
        assert found.prefix(i).tolist() == want
        assert all(fits[n][i] == max(k for k, v in enumerate(want) if v <= n) for n in fits)


def test_every_prefix_of_random_texts(counter, model):
    rng = random.Random(3)
    check(counter, model, ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(50))) for _ in range(400)])
    names = counter.names[: counter.single]
    check(counter, model, ["".join(rng.choice(names) for _ in range(rng.randrange(10))) for _ in range(400)])


def test_odd_texts(counter, model):
    check(counter, model, ["", " ", "   ", "\n", "a", "▁", "▁▁ a▁ b", "    def f(x):\n        return  x\n" + " " * 40, "a" * 200, " " * 200, "=-" * 60 + "=" * 150 + "ab" * 50,
                           "日本語テキスト" * 20, "\U0001f600" * 40, "́‍�", "www.example.com/a/b?c=d&e=f" * 4])
    check(counter, model, ["", "", ""])
    assert of(counter, []).totals().tolist() == []


def test_long_parts_over_blocks(counter, model):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdeinst") for _ in range(40_000))
    found = of(counter, [text, "x " + text[:100]])
    assert found.totals()[0] == len(model.encode(text))
    counts = found.prefix(0)
    for k in (1, 2, 16_383, 16_384, 16_385, 16_400, 32_768, 39_999):
        assert counts[k] == len(model.encode(text[:k]))


def test_few_slots_give_the_same(counter, model):
    small = pt.PrefixCounter(PATH)
    texts = ["the quick brown fox jumps over the lazy dog", "information retrieval institution", "überraschung naïve"]
    small.keys, small.answers = np.full(pt._SLOTS, -1, np.int64), np.zeros(pt._SLOTS, bool)
    for _ in range(3):
        assert of(small, texts).totals().tolist() == of(counter, texts).totals().tolist()
        small.keys[::2] = -1


def test_pieces_that_never_stand(counter, model):
    """Every piece stands alone exactly if the model keeps it whole after a character that nothing joins."""
    barrier = "\U0001f600"
    n = len(model.encode(barrier))
    names = counter.names[: counter.single]
    whole = [len(x) == n + 1 for x in model.encode([barrier + p for p in names])]
    assert [counter.stand("", p) for p in names] == whole


def test_other_models_are_refused(tmp_path):
    data = open(PATH, "rb").read()
    unigram = data.replace(b"\x12\x06tok_v0\x18\x02", b"\x12\x06tok_v0\x18\x01")
    other = tmp_path / "unigram.model"
    other.write_bytes(unigram)
    assert unigram != data
    with pytest.raises(ValueError):
        pt.load_pieces(str(other))


def test_columns(spark, docs, model):
    rows = pt.count(docs, PATH, budget=20).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == len(texts) and set(rows[0].asDict()) == {*docs.columns, "n_bytes", "n_tokens", "fit_chars"} - {"text"}
    stored = {r.doc_id: r for r in pt.prefix_counts(docs, PATH, keep=["doc_id"]).select(
        "doc_id", "counts", pt.longest_prefix(F.col("counts"), 20).alias("fit"), pt.tokens_of_prefix(F.col("counts"), 5).alias("five")).collect()}
    for r in rows:
        t = texts[r.doc_id]
        want = [len(x) for x in model.encode([t[:k] for k in range(len(t) + 1)])]
        s = stored[r.doc_id]
        fit = max(k for k, v in enumerate(want) if v <= 20)
        assert s.counts == want and (r.n_bytes, r.n_chars, r.n_tokens, r.fit_chars) == (len(t.encode()), len(t), want[-1], fit) and (s.fit, s.five) == (fit, want[min(5, len(t))])


def test_odd_tables(odd, nothing):
    df = odd.withColumn("a.b", F.lit(1)).withColumn("__text", F.lit(2)).withColumn("n_tokens", F.lit(3))
    out = pt.count(df, PATH)
    rows = out.collect()
    assert len(rows) == 5 and out.columns.count("n_tokens") == 1 and all((r["a.b"], r["__text"]) == (1, 2) for r in rows)
    assert sorted(r.n_tokens for r in rows)[:2] == [0, 0]
    assert pt.count(nothing, PATH, budget=1).count() == 0 and pt.prefix_counts(nothing, PATH).count() == 0
    assert sorted(len(r.counts) for r in pt.prefix_counts(df, PATH).collect())[:2] == [1, 1]


def test_query(spark, data, model):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op13_prefix_tokens(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        n = len(model.encode(t))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 4096)
        assert len(model.encode(t[: r.fit_chars])) <= 4096
        assert r.fit_chars == len(t) if n <= 4096 else all(len(model.encode(t[: r.fit_chars + k])) > 4096 for k in range(1, 17))
