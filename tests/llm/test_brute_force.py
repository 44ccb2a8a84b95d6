"""Whole registered queries against plain versions of what they compute."""

import hashlib
import math
import struct
import zlib

import numpy as np
import public_tokenizers
import regex
import tiktoken
import xxhash
from curricle.llm import queries, sharding, site_quality, sketches
from curricle.llm.byte_bpe import load_ranks
from pyspark.sql import functions as F


def documents(spark, data):
    return sorted((r.doc_id, r.text or "", r.source, r.lang) for r in spark.read.parquet(f"{data}/documents.parquet").collect())


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_of(parts):
    """What xxhash64() makes of strings, ints (as 4 bytes) and longs (as 8)."""
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else struct.pack("<i" if isinstance(p, bool) else "<q", p), seed)
    return signed(seed)


def sketch(text, k=sketches.K, n=sketches.SHINGLE):
    words = [w for w in regex.split("[ \\t\\n\\x0B\\f\\r]+", text) if w]
    h = [hash_of([w]) for w in words]
    if len(h) >= n:
        found = {hash_of(h[i: i + n]) for i in range(len(h) - n + 1)}
    elif h:
        seed = xxhash.xxh64_intdigest(struct.pack("<i", n), 42)
        found = {signed(xxhash.xxh64_intdigest(" ".join(map(str, h)).encode(), seed))}
    else:
        found = set()
    return sorted(found)[:k]


def likeness(a, b, k=sketches.K):
    union = sorted({*a, *b})[:k]
    return len({*union} & {*a} & {*b}) / len(union) if union else 1.0


def test_fingerprints(spark, data):
    docs = documents(spark, data)
    got = {r.doc_id: r for r in queries.op3_fingerprints(spark, data).collect()}
    assert len(got) == len(docs)
    own = {i: sketch(t) for i, t, *_ in docs}
    for (i, text, *_), (j, following, *_) in zip(docs, docs[1:] + docs[:1], strict=True):
        n = len(text) // 2
        edited = text[: len(text) - n] + following[:n]
        r, other = got[i], sketch(edited)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{x & (1 << 64) - 1:016x}" for x in own[i]) and r.edited_fingerprint == "".join(f"{x & (1 << 64) - 1:016x}" for x in other)
        assert math.isclose(r.near_edited, likeness(own[i], other)) and math.isclose(r.near_next, likeness(own[i], own[j]))


def test_sharding(spark, data):
    """Places recomputed from each source's ranks; only the hash that shuffles is taken from Spark."""
    text = F.coalesce("text", F.lit(""))
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source", F.crc32(text).alias("crc"), (F.octet_length(text).cast("long") + 1).alias("size"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(1), "doc_id", "crc", "size")).collect()
    by = {}
    for r in rows:
        by.setdefault("-" if r.source is None else f"={r.source}", []).append(r)
    order = sorted(((2 * k - 1) / (2 * len(rs)), s, k, r.doc_id) for s, rs in by.items() for k, r in enumerate(sorted(rs, key=lambda r: (r.h, r.doc_id, r.crc, r.size)), 1))
    n, want, used = len(order), {}, {}
    for p, (*_, doc) in enumerate(order):
        shard = p * 16 // n
        want[doc] = (shard, used.setdefault(shard, 0))
        used[shard] += 1
    got = queries.op4_sharding(spark, data).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == want and len(got) == n
    assert max(used.values()) - min(used.values()) <= 1
    texts = {i: t for i, t, *_ in documents(spark, data)}
    assert all((r["size"], r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode()), "rows", None) for r in got)
    sources = {r.doc_id: r.source for r in rows}
    for s in set(sources.values()):
        share = [sum(1 for r in got if r.shard == k and sources[r.doc_id] == s) for k in range(16)]
        assert max(abs(x - sum(share) / 16) for x in share) <= 1.5


def test_sharding_with_clashing_names(spark):
    rows = [(i, f"s{i % 3}", i, i, i) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, __s int, __h int, __r int")
    out = sharding.interleave(df, "source", ["doc_id"], 4, 1)
    plain = sharding.interleave(df.select("doc_id", "source"), "source", ["doc_id"], 4, 1)
    assert out.columns == [*df.columns, "shard", "slot"] and all(r["__s"] == r["__h"] == r["__r"] == r.doc_id for r in out.collect())
    assert {(r.doc_id, r.shard, r.slot) for r in out.collect()} == {(r.doc_id, r.shard, r.slot) for r in plain.collect()}


def test_sketches_with_clashing_names(spark):
    df = spark.createDataFrame([(i, f"a b c d e f {i}", 1, 2, 3, 4) for i in range(6)], "doc_id bigint, text string, __h int, __k int, __b int, __to int")
    out = sketches.with_next(sketches.with_sketch(df), "doc_id", F.col("text"), "following")
    assert out.columns == [*df.columns, "sketch", "following"]
    assert {(r.doc_id, r["__h"], r["__k"], r["__b"], r["__to"], r.following) for r in out.collect()} == {(i, 1, 2, 3, 4, f"a b c d e f {(i + 1) % 6}") for i in range(6)}


def test_packing(spark, data):
    """Every piece holds the tokenizer's own ids; sequences have no gaps, and little of them is padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = queries.op6_packing(spark, data).collect()
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    docs, total = documents(spark, data), 0
    assert set(pieces) == {i for i, *_ in docs}
    for i, text, *_ in docs:
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, 1], 0
        total += len(ids)
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at: at + r.length]))
            at += r.length
        assert at == len(ids)
    for held in windows.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    partitions = len({s >> 32 for s in windows})
    assert len(windows) <= total / 2048 + partitions


def test_byte_bpe(spark, data):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    model = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(load_ranks(path))}, special_tokens={})
    got = {r.doc_id: r for r in queries.op1_byte_bpe(spark, data).collect()}
    for i, text, *_ in documents(spark, data):
        ids, r = model.encode_ordinary(text), got.pop(i)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(b"".join(model.decode_single_token_bytes(x) for x in ids)).hexdigest()
    assert not got


def plain_features(text):
    """The features of one text, character by character."""
    space = " \t\n\x0b\x0c\r"
    words = [w for w in regex.split(f"[{space}]+", text) if w]
    if not words:
        return [0.0] * len(site_quality.FEATURES)
    n, chars = len(words), sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip(space)]
    three = [tuple(words[i: i + 3]) for i in range(n - 2)]
    seen = {}
    for t in three:
        seen[t] = seen.get(t, 0) + 1
    repeated = {i + j for i, t in enumerate(three) if seen[t] > 1 for j in range(3)}
    data = text.encode()
    among = lambda s: sum(data.count(bytes([c])) for c in s)
    upper, lower = among(range(65, 91)), among(range(97, 123))
    shares = [upper, lower, among(b"0123456789"), among(b"!?"), among(b"|"), among(b"#*$%&<>@^~=_+{}[]\\/"), among(b".,;:"), among(range(128, 256))]
    return [math.log1p(n), min(chars / n, 30) / 10, among(b"#*$%&|<>") / chars, (len(lines) - len(set(lines))) / len(lines), len(repeated) / n, math.log1p(n / len(lines)),
            len(set(words)) / n, upper / max(upper + lower, 1), *(x / chars for x in shares)]


def test_quality(spark, data):
    """The model is the optimum of its ridge likelihood over plain features, and posteriors are recomputed from all documents' scores."""
    docs = documents(spark, data)
    x = {i: plain_features(t) for i, t, *_ in docs}
    labels = {r.doc_id: float(r.quality) for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r.quality is not None and r.doc_id in x}
    ids = sorted(labels)
    model = site_quality.Logistic(np.array([x[i] for i in ids]), np.array([labels[i] for i in ids]))
    wide = np.hstack([np.array([x[i] for i in ids])] * 2)
    wide[:, len(site_quality.FEATURES):] **= 2
    z = np.hstack([np.clip((wide - wide.mean(axis=0)) / (wide.std(axis=0) + 1e-9), -8, 8), np.ones((len(ids), 1))])
    p = 1 / (1 + np.exp(-z @ model.weights))
    slope = z.T @ (np.array([labels[i] for i in ids]) - p) - np.append(np.ones(z.shape[1] - 1), 1e-6) * model.weights
    assert np.abs(slope).max() < 1e-4

    got = {r.doc_id: r for r in queries.op10_site_quality(spark, data).collect()}
    assert set(got) == set(x)
    odds = dict(zip(x, model.log_odds(np.array(list(x.values()))), strict=True))
    assert all(math.isclose(got[i].log_odds, odds[i], rel_tol=1e-6, abs_tol=1e-6) for i in x)

    sums = {}
    for i, _, source, lang in docs:
        s = sums.setdefault((source, lang), [0.0, 0])
        s[0] += 1 / (1 + math.exp(-odds[i]))
        s[1] += 1

    def prior(sites):
        g, t, h = sum(a for a, _ in sites), sum(b for _, b in sites), len(sites)
        m = (g + 0.5) / (t + 1)
        between = (sum(a * a / b for a, b in sites) - 2 * m * g + m * m * t - (h - 1) * m * (1 - m)) / max(t, 1)
        return m, min(1e6, max(1.0, m * (1 - m) / max(between, 1e-9) - 1))

    hosts = {}
    for (source, _), (g, n) in sums.items():
        hosts.setdefault(source, []).append((g, n))
    hosts = {s: (sum(a for a, _ in v), sum(b for _, b in v)) for s, v in hosts.items()}
    base, strength = prior(list(hosts.values()))
    _, within = prior([tuple(v) for v in sums.values()])
    logit = lambda q: math.log(q / (1 - q))
    for i, _, source, lang in docs:
        host = (hosts[source][0] + base * strength) / (hosts[source][1] + strength)
        path = (sums[source, lang][0] + host * within) / (sums[source, lang][1] + within)
        quality = 1 / (1 + math.exp(-(odds[i] + logit(path) - logit(base))))
        assert math.isclose(got[i].host_posterior, host, rel_tol=1e-6) and math.isclose(got[i].path_posterior, path, rel_tol=1e-6)
        assert math.isclose(got[i].quality, quality, rel_tol=1e-5, abs_tol=1e-9) and got[i].kept == (got[i].quality >= 0.5)
