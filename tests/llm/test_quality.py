import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from curricle.llm import host_rules, site_quality
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"


def words_of(text):
    for s in SPACES:
        text = text.replace(s, " ")
    return [w for w in text.split(" ") if w]


def counts(text):
    text = text or ""
    w = words_of(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i: i + 3]) for i in range(len(w) - 2))
    marked = {j for i in range(len(w) - 2) if windows[tuple(w[i: i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def test_counts_equal_brute_force(docs, corpus):
    rows = {r.id: r for r in host_rules.judge(docs).collect()}
    for id_, text, *_ in corpus:
        r = rows[id_]
        assert tuple(r[k] for k in host_rules.NAMES) == counts(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_hosts_are_shrunk_and_judged(spark):
    good, bad = "word " * 3 + " ".join(f"q{i}" for i in range(80)), "short"
    rows = [(i, good, "clean") for i in range(200)] + [(300 + i, bad, "junk") for i in range(60)] + [(400, bad, "tiny")] + [(500 + i, good if i % 9 else bad, None) for i in range(90)]
    out = {r.id: r for r in host_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert out[0].host_ok and not out[300].host_ok and out[500].host_ok
    assert out[0].host_rate < 0.05 and out[300].host_rate > 0.9 and out[300].host_rate > out[400].host_rate > 0.3
    n, f = Counter(r[2] for r in rows), Counter(r[2] for r in rows if r[1] == bad)
    m = (sum(f.values()) + 0.5) / (len(rows) + 1)
    q = sum(f[h] ** 2 / n[h] for h in n)
    between = (q - 2 * m * sum(f.values()) + m * m * len(rows) - (len(n) - 1) * m * (1 - m)) / len(rows)
    strength = min(1e6, max(1, m * (1 - m) / max(between, 1e-9) - 1))
    for h, id_ in (("clean", 0), ("junk", 300), ("tiny", 400), (None, 500)):
        assert out[id_].host_rate == pytest.approx((f[h] + m * strength) / (n[h] + strength))


def test_odd_tables(odd, nothing, spark):
    assert host_rules.judge(odd).count() == 5 and host_rules.judge(nothing).count() == 0
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (2, None)], "doc_id bigint, quality int")
    assert site_quality.classify(odd, labels).count() == 5 and site_quality.classify(nothing, labels).count() == 0
    assert site_quality.keep_good(odd, labels).columns == odd.columns
    none = labels.where("doc_id > 9")
    out = site_quality.classify(odd, none).collect()
    assert len(out) == 5 and all(r.kept for r in out) and all(abs(r.log_odds) < 1e-9 for r in out)


def test_posteriors_equal_a_plain_computation(spark):
    rng = random.Random(4)
    rows = [(i, f"h{int(rng.random() ** 3 * 6)}", rng.choice("ab"), rng.gauss(1 if rng.random() < 0.7 else -3, 1)) for i in range(400)] + [(999, "lonely", "a", -2.0)]
    got = {r.id: r for r in site_quality.posterior(spark.createDataFrame(rows, "id bigint, site string, path string, log_odds double")).collect()}
    p = {i: 1 / (1 + np.exp(-x)) for i, _, _, x in rows}

    def groups(key):
        g, n = defaultdict(float), Counter()
        for r in rows:
            g[key(r)] += p[r[0]]
            n[key(r)] += 1
        return g, n

    def prior(g, n):
        total, all_ = sum(g.values()), sum(n.values())
        m = (total + 0.5) / (all_ + 1)
        between = (sum(g[k] ** 2 / n[k] for k in n) - 2 * m * total + m * m * all_ - (len(n) - 1) * m * (1 - m)) / all_
        return m, min(1e6, max(1, m * (1 - m) / max(between, 1e-9) - 1))

    logit = lambda x: np.log(x / (1 - x))
    (hg, hn), (pg, pn) = groups(lambda r: r[1]), groups(lambda r: r[1:3])
    (m, s), (_, t) = prior(hg, hn), prior(pg, pn)
    for i, h, q, x in rows:
        host = (hg[h] + m * s) / (hn[h] + s)
        path = (pg[h, q] + host * t) / (pn[h, q] + t)
        want = 1 / (1 + np.exp(-(x + logit(path) - logit(m))))
        assert (got[i].host_posterior, got[i].path_posterior, got[i].quality) == pytest.approx((host, path, want))


def test_held_out_accuracy(spark):
    """Fitted on even ids, judged on odd ids."""
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    out = site_quality.classify(docs, labels.where("doc_id % 2 = 0"))
    held = out.join(labels.where("doc_id % 2 = 1"), F.expr("id = doc_id")).select("kept", labels["quality"].alias("y")).collect()
    good = [r.kept for r in held if r.y == 1]
    bad = [r.kept for r in held if r.y == 0]
    assert len(bad) > 15 and sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.15


def test_all_labels_count(spark):
    """The model is that of all labelled rows at once, here 20,500 over several tasks."""
    texts = [f"word{i % 97} " * (i % 13 + 1) + "!" * (i % 5) for i in range(20_500)]
    y = [int(i * 7919 % 101 < 30 + 9 * (i % 5)) for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id bigint, quality int")
    got = [r.log_odds for r in site_quality.classify(docs, labels).orderBy("id").collect()]
    x = site_quality.features(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)]))
    np.testing.assert_allclose(got, site_quality.Logistic(x, np.array(y, float)).log_odds(x), rtol=1e-6, atol=1e-8)
