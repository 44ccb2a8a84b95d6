"""The kept full-text index, and what a purge leaves behind."""

from pathlib import Path

import pytest
from curricle import storage
from curricle.operators import search
from curricle.plans import store as module
from curricle.plans.store import PeopleStore
from pyspark.sql import functions as F

PEOPLE = {"a": ("张三丰", "19900000001", "南湖师范学院", "极光数据", "Java、Kafka"), "b": ("李四光", "19900000002", "东海大学", "丙系统公司", "Python"), "c": ("王小二", "19900000003", "南湖师范学院", "丁公司总部", "Java")}
QUERIES = ["师范学院", "南湖师", "JAVA KAFKA", "ava", "没有的人"]


def resume(name, phone, school, company, skills):
    return f"姓名：{name}\n电话：{phone}\n毕业院校：{school}\n工作经历\n{company} | 开发 | 2018-03 - 2020-06\n技能\n{skills}\n"


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.txt").write_text(text, encoding="utf-8")
    return str(folder)


@pytest.fixture
def store(spark, tmp_path):
    s = PeopleStore(spark, str(tmp_path / "store"))
    s.import_files(put(tmp_path / "one", **{k: resume(*v) for k, v in PEOPLE.items()}), "2026-01-01T00:00:00")
    return s


def same_as_a_scan(store):
    """Found by the index for each query: the same as by a scan."""
    people, tags, jobs = store._as_people()
    docs, texts = search.search_documents(people, tags, jobs).cache(), (store.table("postings").cache(), store.table("documents").cache())
    out = {}
    for q in QUERIES:
        out[q] = {r.candidate_id for r in search.find(*texts, q, "candidate_id").collect()}
        assert out[q] == {r.pid for r in search.full_text(docs, q).collect()}, q
    return {q: len(found) for q, found in out.items()}


def test_index_follows_every_change(spark, store, tmp_path):
    assert same_as_a_scan(store)["师范学院"] == 2
    before, parts = store._now(), {p.name for p in (tmp_path / "store" / "postings").iterdir()}
    store.import_files(put(tmp_path / "two", d=resume("赵五六", "19900000004", "西山学院", "戊公司", "Go语言"), a2=resume("张三丰", "19900000001", "北山师范学院", "极光数据", "Redis")), "2026-02-01T00:00:00")
    now = store._now()
    assert now["postings"][:-1] == before["postings"] and parts < {p.name for p in (tmp_path / "store" / "postings").iterdir()}
    ids = {r.name: r.pid for r in store.search().collect()}
    added = spark.read.parquet(str(tmp_path / "store" / "postings" / now["postings"][-1]))
    assert {r[0] for r in added.select("candidate_id").distinct().collect()} == {ids["赵五六"], ids["张三丰"]}
    found = same_as_a_scan(store)
    assert found["师范学院"] == 2 and store.search("南湖师").count() == 1 and store.search("北山师").count() == 1 and store.search("戊公司").count() == 1
    conflict = store.pending_reviews().where("field = 'school'").first()
    store.resolve_conflict(conflict.conflict_id, "南湖师范学院")
    assert same_as_a_scan(store)["南湖师"] == 2 and store.search("北山师").count() == 0
    store.merge_candidates(ids["赵五六"], ids["李四光"])
    assert same_as_a_scan(store) and [r.pid for r in store.search("戊公司").collect()] == [ids["李四光"]] and store.search("李四光").count() == 0


def test_index_written_anew_keeps_the_last_versions(spark, store, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "MOST_PARTS", 2)
    for k in range(2):
        store.import_files(put(tmp_path / f"n{k}", x=resume("张三丰", "19900000001", f"新校{k}学院", "极光数据", "Java")), f"2026-0{k + 2}-01T00:00:00")
    same_as_a_scan(store)
    assert store.search("新校1").count() == 1 and store.search("新校0").count() == 0 and len(store._now()["postings"]) <= 2


def test_only_the_folders_of_a_query_are_read(spark, store, tmp_path):
    df = search.find(store.table("postings"), store.table("documents"), "师范学院", "candidate_id")
    read = df._jdf.queryExecution().sparkPlan().toString()
    assert "PartitionFilters: [" in read and "bucket" in read.split("PartitionFilters: [")[1].split("]")[0]
    with pytest.raises(ValueError):
        search.find(store.table("postings"), store.table("documents"), "师范", "candidate_id")


def test_purge_leaves_nothing_behind(spark, tmp_path):
    shared = Path(storage.shared_dir(spark).removeprefix("file:"))
    before = set(storage.written())
    s = PeopleStore(spark, str(tmp_path / "store"))
    report = s.import_files(put(tmp_path / "in", **{k: resume(*v) for k, v in PEOPLE.items()}), "2026-01-01T00:00:00")
    assert report.count() == 3 and len([p for p in storage.written() if p not in before]) == 1
    s.import_files(put(tmp_path / "in2", a=resume("张三丰", "19900000001", "北山学院", "极光数据", "Go")), "2026-02-01T00:00:00")
    ids = [r.pid for r in s.search().collect()]
    s.resolve_conflict(s.pending_reviews().where("field = 'school'").first().conflict_id, "北山学院")
    s.merge_candidates(ids[1], ids[0])
    s.purge()
    assert set(storage.written()) <= before
    tables = [p for root in (shared, tmp_path / "store") for p in root.rglob("*.parquet")]
    for path in tables:
        df = spark.read.parquet(str(path))
        for c, t in df.dtypes:
            if t == "string":
                assert df.where(F.col(f"`{c}`").rlike("1990000000[123]")).count() == 0, path


def test_scopes_of_threads_are_apart(spark):
    import threading

    seen = {}

    def work(name):
        with storage.scope() as outer:
            a = storage.scratch(spark, name)
            with storage.scope():
                b = storage.scratch(spark, name)
            seen[name] = (list(outer), [a, b])

    threads = [threading.Thread(target=work, args=(n,)) for n in "xy"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    for paths, want in seen.values():
        assert paths == want
        storage.release(spark, want)
