import base64
import hashlib

import public_tokenizers
import tiktoken
from curricle.llm import byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_piece_is_reached():
    codec = byte_bpe.Codec(PATH, PATTERN)
    model = codec.model
    for rank, token in enumerate(codec.vocabulary):
        assert model.id_to_piece(rank).encode() == token.decode("latin-1").translate(codec.letters).encode()
    assert [codec.decode(codec.encode(t).tolist()) for t in ("", "a b", "<unk>")] == [b"", b"a b", b"<unk>"]


def test_small_cache_gives_the_same():
    small, large = byte_bpe.Codec(PATH, PATTERN, cache=3), byte_bpe.Codec(PATH, PATTERN)
    for text in ("the quick brown fox jumps over it again", "the the the", "qqqqq zzzzz 12 345 日本"):
        assert small.encode(text).tolist() == large.encode(text).tolist()


def test_ids_and_round_trip(spark, docs):
    ids = byte_bpe.encode(docs, PATH, PATTERN, keep=["doc_id", "text"])
    known = reference()
    for row in byte_bpe.decode(ids, PATH, PATTERN, keep=["doc_id", "text", "ids"]).collect():
        assert row.ids == known.encode_ordinary(row.text or "")
        assert bytes(row.decoded) == (row.text or "").encode()


def test_odd_tables(odd, nothing):
    out = byte_bpe.encode(odd, PATH, PATTERN)
    assert out.columns.count("ids") == 1 and "text" not in out.columns
    rows = out.collect()
    assert len(rows) == 5 and sum(len(r.ids) == 0 for r in rows) == 2
    named = odd.selectExpr("*", "1 as `__text`", "2 as `__ids`", "3 as `a.b`", "4 as `c0`")
    back = byte_bpe.decode(byte_bpe.encode(named, PATH, PATTERN), PATH, PATTERN)
    assert all((r["__text"], r["__ids"], r["a.b"], r.c0) == (1, 2, 3, 4) for r in back.collect()) and back.where("decoded != ''").count() == 3
    assert byte_bpe.decode(byte_bpe.encode(nothing, PATH, PATTERN), PATH, PATTERN).count() == 0


def test_very_long_text(spark):
    text = "one two three four " * 100_000 + "x" * 100_000
    row = byte_bpe.encode(spark.createDataFrame([(text,)], "text string"), PATH, PATTERN).first()
    assert row.ids == reference().encode_ordinary(text)


def test_query(spark, data):
    from curricle.llm.queries import op1_byte_bpe

    known = reference()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = op1_byte_bpe(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows[:50]:
        ids = known.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
