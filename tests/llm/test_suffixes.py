import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from curricle.llm import suffixes


def brute(rows, length):
    """Per row: removed bytes, runs, and what stays."""
    where = Counter()
    bodies = [(i, (t or "").encode()) for i, t in rows]
    for _, b in bodies:
        where.update(b[s: s + length] for s in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if where[b[s: s + length]] > 1:
                gone[s: s + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def ours(df, length, **how):
    return sorted((r.doc_id, r.n_removed, r.n_spans, bytes(r.text)) for r in suffixes.without_repeats(df, length=length, **how).collect())


@pytest.mark.parametrize("most", [2000, 2])
@pytest.mark.parametrize("length", [60, 400])
def test_cut_equals_brute_force(docs, corpus, length, most):
    assert ours(docs, length, most=most) == brute([(c[0], c[1]) for c in corpus], length)


def test_random_small_alphabet(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 60)))) for i in range(40)] + [(99, "ab" * 200), (98, "a" * 50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for length in (9, 14):
        assert ours(df, length) == brute(rows, length)


def test_very_long_text_in_segments(spark, monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh") for _ in range(30_000))
    rows = [(1, text + text[5000:9000]), (2, text[20_000:20_700])]
    import numpy as np

    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    at = np.array([0, len(rows[0][1]), len(data)])
    monkeypatch.setattr(suffixes, "SEGMENT", 7000)
    monkeypatch.setattr(suffixes, "pieces", lambda at: ((i, i + 1) for i in range(len(at) - 1)))
    cut, whole = set(), set()
    for i, j, part, of, shift, lo, hi in suffixes._regions(data, at):
        p, g, _ = suffixes.anchors_of(part, of, 400)
        cut |= {(i, int(x) + shift, int(y)) for x, y in zip(p, g, strict=True) if lo <= x < hi}
    for i in range(2):
        p, g, _ = suffixes.anchors_of(data[at[i]: at[i + 1]], np.array([0, at[i + 1] - at[i]]), 400)
        whole |= {(i, int(x), int(y)) for x, y in zip(p, g, strict=True)}
    assert cut == whole
    monkeypatch.undo()
    assert ours(spark.createDataFrame(rows, "doc_id bigint, text string"), 400) == brute(rows, 400)


def test_intervals_are_those_of_the_suffix_tree():
    rng = random.Random(3)
    for _ in range(50):
        rights = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 8))) for _ in range(rng.randrange(2, 12))]
        group = suffixes.SuffixGroup(rights, [b""] * len(rights))
        got = {(d, tuple(sorted(group.order[a: b + 1]))) for d, a, b in suffixes.intervals(group.lcp) if d}
        want = set()
        for a in range(len(rights)):
            for b in range(a):
                d = suffixes.common(rights[a], rights[b])
                if d:
                    want.add((d, tuple(k for k in range(len(rights)) if rights[k][:d] == rights[a][:d])))
        assert got == want


def _covered_by_pairs(rights, lefts, length, group):
    before, after = [0] * len(rights), [0] * len(rights)
    for i in range(len(rights)):
        for j in range(len(rights)):
            if i != j and group[i] == group[j]:
                right, left = suffixes.common(rights[i], rights[j]), suffixes.common(lefts[i], lefts[j])
                if right + left >= length:
                    before[i], after[i] = max(before[i], left), max(after[i], right)
    return before, after


@pytest.mark.parametrize("steps", [0, 1, 2, 500])
def test_many_groups_are_scanned_together(monkeypatch, steps):
    rng = random.Random(11)
    monkeypatch.setattr(suffixes, "STEPS", steps)
    for _ in range(200):
        letters, n = rng.choice([b"a", b"ab", b"\0a"]), rng.randrange(1, 25)
        rights, lefts = ([bytes(rng.choice(letters) for _ in range(rng.randrange(9))) for _ in range(n)] for _ in range(2))
        group, length = np.sort([rng.randrange(3) for _ in range(n)]), rng.randrange(3, 12)
        got = suffixes.covered(rights, lefts, length, group)
        assert tuple(x.tolist() for x in got) == _covered_by_pairs(rights, lefts, length, group)


def test_groups_need_no_scan_of_each_repeat(monkeypatch):
    """A group of many near copies, whose scan cost some ten numpy calls for each of its intervals, is settled by neighbours."""
    rng = random.Random(12)
    monkeypatch.setattr(suffixes.SuffixGroup, "groups", lambda *_: pytest.fail("scanned by maximal repeats"))
    whole = [bytes(rng.choice(b"abcdefgh") for _ in range(200)) for _ in range(2)]
    edit = lambda b: b[: (k := rng.randrange(60, len(b)))] + b"#%d" % rng.randrange(999) + b[k:]
    rights, lefts = ([edit(b) for _ in range(150)] for b in whole)
    before, after = suffixes.covered(rights, lefts, 250)
    assert (before.tolist(), after.tolist()) == _covered_by_pairs(rights, lefts, 250, [0] * 150)


def check_groups(rows, found, length):
    """Every repeated window lies in a group that has all of its occurrences; the members of a group are equal and can't all be extended within reach."""
    bodies = {i: (t or "").encode() for i, t in rows}
    groups = {}
    for r in found:
        assert r.n_bytes == r.end - r.begin >= length and 0 <= r.begin and r.end <= len(bodies[r.id])
        groups.setdefault(r.repeat, set()).add((r.id, r.begin, r.end))
    for members in groups.values():
        assert len(members) > 1 and len({bodies[i][b:e] for i, b, e in members}) == 1
    where = {}
    for i, b in bodies.items():
        for s in range(len(b) - length + 1):
            where.setdefault(b[s: s + length], set()).add((i, s))
    for places in where.values():
        if len(places) > 1:
            i, s = min(places)
            assert any({(x, b + (s - b0)) for x, b, _ in m} == places for m in groups.values() for j, b0, e0 in m if j == i and b0 <= s and s + length <= e0)
    return groups


def test_repeat_groups_have_all_occurrences(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(10, 50)))) for i in range(25)] + [(99, "abc" * 20), (98, "a" * 30), (97, None), (96, "")]
    passage = "".join(rng.choice("abcdefgh") for _ in range(40))
    rows += [(200 + i, f"{rng.choice('xyz')}{passage}{rng.choice('xyz')}{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for length in (9, 14):
        groups = check_groups(rows, suffixes.repeat_groups(df, length=length).collect(), length)
        covered = {(i, k) for m in groups.values() for i, b, e in m for k in range(b, e)}
        spans = {(r.id, k) for r in suffixes.repeated_spans(df, length=length).collect() for k in range(r.begin, r.end)}
        assert covered == spans


def test_repeat_groups_of_prose(docs, corpus):
    check_groups([(c[0], c[1]) for c in corpus], suffixes.repeat_groups(docs, length=60).collect(), 60)


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, "x" * 30, 1, 2, 3, 4) for i in range(3)], "doc_id bigint, text string, __maybe int, __id int, __spans int, __owner int")
    out = suffixes.without_repeats(df, length=10)
    assert out.columns == [*df.columns, "n_removed", "n_spans"] and [(r["__spans"], r.n_removed) for r in out.collect()] == [(3, 30)] * 3


def test_odd_tables(odd, nothing):
    out = suffixes.without_repeats(odd, length=10)
    assert out.columns.count("n_removed") == 1 and sorted(out.columns) == sorted({*odd.columns, "n_spans"})
    assert sorted(((r.doc_id or 0), bytes(r.text)) for r in out.collect())[1:] == [(1, b""), (1, b""), (2, b""), (3, b"")]
    assert suffixes.without_repeats(nothing).count() == 0


def test_query(spark, data):
    from curricle.llm.queries import op9_suffix_array

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = {i: (n, runs, hashlib.sha256(b).hexdigest()) for i, n, runs, b in brute(rows, 400)}
    sizes = {i: len((t or "").encode()) for i, t in rows}
    for r in op9_suffix_array(spark, data).collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 or "\ufffd" in r.kept_text
        assert r.n_bytes == sizes[r.doc_id] and (r.n_removed, r.n_spans, r.kept_sha256) == want.pop(r.doc_id)
    assert not want


def test_cuts_between_characters(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("äöü日本€") for _ in range(30))
    rows = [(i, f"{chr(0xe4 + i)}{passage}{chr(0x65e6 + i)}z{i}") for i in range(4)]  # neighbours share lead bytes with each other
    out = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), length=20, characters=True)
    assert {r.doc_id: bytes(r.text).decode() for r in out.collect()} == {i: f"{chr(0xe4 + i)}{chr(0x65e6 + i)}z{i}" for i, _ in rows}
