import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from curricle.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, size):
    """Every token once, sequences without gaps; returns the number of sequences and of tokens."""
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert 0 < r.length <= size and len(r.ids) == 4 * r.length
    total = 0
    for doc, text in texts.items():
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        total += len(want)
        at, got = 0, []
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want)
            got += np.frombuffer(bytes(r.ids), "<u4").tolist()
            at += r.length
        assert got == want
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    return len(by_sequence), total


def test_tokens_and_padding(docs, corpus):
    texts = {c[0]: c[1] for c in corpus}
    for size in (64, 2048):
        n, total = check(packing.pack(docs.coalesce(2), PATH, size=size).collect(), texts, size)
        assert n <= -(-total // size) + 2


def test_levels_follow_the_least_sum_of_squares():
    rng = np.random.default_rng(1)
    packer = packing.SumOfSquares(20, 0)
    for s in rng.integers(1, 20, 500):
        s, c = int(s), packer.count.copy()

        def squares(h):
            d = c.copy()
            if h:
                d[h] -= 1
            if h + s < 20:
                d[h + s] += 1
            return int((d[:20] ** 2).sum())
        best = min(squares(h) for h in range(0, 21 - s) if h == 0 or c[h])
        assert squares(packer.level_for(s)) == best
        packer.place(s)


def test_second_pass_cuts_only_what_it_leaves_open():
    rng = np.random.default_rng(2)
    first = packing.SumOfSquares(100, 7)
    for s in rng.integers(1, 100, 3000):
        first.place(int(s))
    blocks = list(first.left())
    again = packing.SumOfSquares(100, 0)
    for _, s in blocks:
        again.place(s)
    open_ = len(list(again.left()))
    rows = list(packing.settled(blocks, 100, 1000))
    parts, sequences = defaultdict(list), defaultdict(list)
    for window, begin, end, sequence, offset in rows:
        assert begin < end
        parts[window].append((begin, end))
        sequences[sequence].append((offset, offset + end - begin))
    for window, s in blocks:
        ends = sorted(parts[window])
        assert ends[0][0] == 0 and ends[-1][1] == s and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    for ends in sequences.values():
        ends.sort()
        assert ends[0][0] == 0 and ends[-1][1] <= 100 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert sum(max(e)[1] < 100 for e in sequences.values()) <= 1  # one sequence is padded
    assert sum(len(p) > 1 for p in parts.values()) < open_  # at each seam of the sequences that were open in the end, one window is cut at most


def test_pieces_that_never_fill_a_window(spark):
    """Pieces of 60 of 100 that share no window: all are open after the first pass, and hold no ids there."""
    packer = packing.SumOfSquares(100, 0)
    assert [packer.place(60) for _ in range(500)] == [(k, 0) for k in range(500)]
    rows = list(packing.settled(list(packer.left()), 100, 1000))
    assert len({r[3] for r in rows}) == 300 and sum(r[2] - r[1] for r in rows) == 30_000
    texts = {k: " ".join(["word"] * 59) for k in range(400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    for blocks, tasks in ((1000, 1), (100, 4)):
        n, total = check(packing.pack(docs, PATH, size=100, blocks=blocks).collect(), texts, 100)
        assert total == 24_000 and n <= 240 + tasks


def test_sequences_cut_depend_on_the_last_pass_alone(spark, data):
    """However many partitions there are, the first pass cuts nothing, and the second cuts at seams of what it leaves open."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    shares = []
    for partitions in (1, 6):
        rows = packing.pack(docs.repartition(partitions, "doc_id"), PATH).drop("ids").collect()
        second = {r.sequence_id for r in rows if r.sequence_id >= packing.SECOND}
        cut = {r.sequence_id for r in rows if r.start % 2048}  # a piece begins inside a window of its document only where it was cut
        assert cut <= second
        shares.append(len(cut) / len({r.sequence_id for r in rows}))
    assert shares[1] <= shares[0] + 0.15


def test_odd_tables(odd, nothing):
    rows = packing.pack(odd, PATH).collect()
    assert sorted((r.doc or 0, r.length) for r in rows)[-2:] == [(2, 1), (3, 1)] and len(rows) == 5
    assert packing.pack(nothing, PATH).count() == 0


def test_special_strings_and_spaces():
    known = Tokenizer.from_file(PATH)
    texts = ["<|endoftext|> a<|startoftext|>b", "é ́ x", "a b c\td\x1ce\x85f", "ΑΣ ΑΣΑ İ", "  \n\n ", "don't WE'LL 123 4"]
    got = packing.WordEncoder(PATH, cache=4).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [known.encode(t, add_special_tokens=False).ids for t in texts]


def test_query(spark, data):
    from curricle.llm.queries import op6_packing

    rows = op6_packing(spark, data).collect()
    ids = {(r.doc, r.start): r.ids for r in packing.pack(spark.read.parquet(f"{data}/documents.parquet"), PATH).collect()}
    assert all(r.ids_crc32 == zlib.crc32(bytes(ids[r.doc_id, r.start])) for r in rows)
    assert sum(r.length for r in rows) == sum(len(x) // 4 for x in ids.values())
