import random

from curricle.llm import minhash
from curricle.operators.graph import components

SPACES = " \t\n\x0b\x0c\r"


def shingles(text, k):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for s in SPACES:
        words = words.replace(s, " ")
    w = [x for x in words.split(" ") if x]
    return {tuple(w[i: i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_groups_equal_brute_force(docs, corpus):
    for k in (4, 5):
        got = {r.id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, shingle=k).collect()}
        assert got == brute([(c[0], c[1]) for c in corpus], k)


def test_chains_and_large_groups_of_near_copies(spark):
    """Chains whose ends are unlike, and many near copies that are like their original but seldom each other."""
    rng = random.Random(1)
    words = [f"c{i}" for i in range(300)]
    rows = []
    for i in range(12):  # each step changes a few words of the one before
        rows.append((1000 - i, " ".join(words)))
        for j in range(i * 12, i * 12 + 8):
            words[j] = f"d{i}-{j}"
    base = [f"b{i}" for i in range(200)]
    rows.append((5000, " ".join(base)))
    for i in range(60):
        other = list(base)
        for _ in range(4):
            other[rng.randrange(200)] = f"n{i}-{rng.randrange(9)}"
        rows.append((100 + i, " ".join(other)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, shingle=4).collect()}
    assert got == brute(rows, 4)

def test_rows_that_share_an_id(spark):
    """Each text of an id is a class of its own, so that no link of either is lost."""
    words = [f"w{i}" for i in range(120)]
    other = [f"v{i}" for i in range(120)]
    near = other[:60] + ["x"] + other[61:]
    rows = [(1, " ".join(words)), (1, " ".join(other)), (2, " ".join(other)), (3, " ".join(near)), (4, " ".join(words)), (5, "alone")]
    got = sorted((r.id, r.component_id, r.n_shingles) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(1, 1, 116), (1, 1, 116), (2, 1, 116), (3, 1, 116), (4, 1, 116), (5, 5, 1)]


def test_collisions_are_counted(spark):
    """Equal coordinates of pairs, and how many of pairs planted at a similarity of 0.8 or a little more the threshold keeps."""
    rng = random.Random(4)
    rows = []
    for i in range(300):
        words = [f"a{i}-{j}" for j in range(100)]
        near = list(words)
        near[50], near[70] = "new", "other"  # 86 of 96 shingles stay: a similarity of 0.811
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sigs = minhash.signatures(df, "doc_id", "text", 5).cache()
    pairs = spark.createDataFrame([(2 * i + 1, 2 * i) for i in range(300)], "a bigint, b bigint")
    sig = {r.id: r.sig for r in sigs.collect()}
    got = {r.b: r.n_equal for r in minhash.collisions(pairs, sigs).collect()}
    assert got == {2 * i: sum(x == y for x, y in zip(sig[2 * i], sig[2 * i + 1], strict=True)) for i in range(300)}
    want = brute(rows, 5)
    assert all(want[2 * i + 1][1] == 2 * i for i in range(300)) and min(got.values()) >= minhash.M
    assert {r.id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()} == want


def test_odd_tables(odd, nothing):
    got = {(r.id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(odd, shingle=5).collect()}
    assert got == {(1, 3, 1), (2, 0, 2), (3, 0, 3), (None, 3, 1)}
    assert minhash.near_duplicates(nothing).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(90)] + [(500, 500)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: find(i) for a, b in links if a != b for i in (a, b)}


def test_query(spark, data):
    from curricle.llm.queries import op7_minhash

    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()], 4)
    for r in op7_minhash(spark, data).collect():
        assert (r.n_shingles, r.component_id) == want.pop(r.doc_id) and r.kept == (r.doc_id == r.component_id)
    assert not want
