import re

import pytest
from curricle import cli
from curricle.operators import privacy
from curricle.plans.store import PeopleStore, numbered
from curricle.streaming import arrivals
from pyspark.sql import functions as F

A1 = "姓名：张三\n电话：19900000001\n毕业院校：南湖学院\n期望职位：开发\n工作经历\n甲数据 | 开发 | 2018-03 - 2020-06\n技能\nJava、MySQL\n"
A2 = "姓名：张三\n电话：19900000001\n期望职位：架构师\n工作经历\n甲数据 | 开发 | 2018-03 - 2020-06\n乙信息 | 架构 | 2020-07 至今\n技能\nJava\n"
B = "姓名：李四\n邮箱：li@example.com\n工作经历\n丙系统 | 测试 | 2019-01 至今\n"


@pytest.fixture
def folder(tmp_path):
    f = tmp_path / "in"
    f.mkdir()
    for name, text in (("a1.txt", A1), ("a2.txt", A2), ("b.txt", B), ("copy_of_b.txt", B)):
        (f / name).write_text(text, encoding="utf-8")
    (f / "broken.docx").write_bytes(b"?")
    return f


def names(rows):
    return {r.source_file.rsplit("/", 1)[1]: r.status for r in rows.collect()}


def test_import_search_merge_purge(spark, tmp_path, folder):
    store = PeopleStore(spark, str(tmp_path / "store"))
    assert names(store.import_files(str(folder), "2026-01-01T00:00:00")) == {"a1.txt": "new", "a2.txt": "merged", "b.txt": "new", "copy_of_b.txt": "duplicate", "broken.docx": "failed"}
    again = names(store.import_files(str(folder), "2026-01-02T00:00:00"))
    assert set(again.values()) == {"duplicate", "failed"}
    (folder / "c.txt").write_text("姓名：李四\n电话：19900000009\n工作经历\n丁公司 | 测试 | 2010-01 - 2011-01\n", encoding="utf-8")
    assert names(store.import_files(str(folder), "2026-01-03T00:00:00"))["c.txt"] in ("new", "manual_review")
    people = {r.name: r for r in store.search().where("pid <= 2").collect()}
    assert people["张三"].desired == "架构师" and people["张三"].school == "南湖学院" and people["张三"].phone == "199****0001" and people["张三"].years == pytest.approx(8.6)
    assert {r.field for r in store.pending_reviews().where("candidate_id = 1").collect()} == {"desired_position"}
    conflict = store.pending_reviews().where("candidate_id = 1").first()
    with pytest.raises(ValueError):
        store.resolve_conflict(conflict.conflict_id, "nothing")
    assert store.resolve_conflict(conflict.conflict_id, "开发") and not store.resolve_conflict(conflict.conflict_id, "开发")
    assert store.search("张三").first().desired == "开发"
    line = store.timeline(1).first()
    assert len(line.resumes) == 2 and len(line.experiences) == 3 and [t.tag for t in line.tags] == ["Java", "MySQL"]
    store.set_setting("masking", "off")
    assert store.search("张三").first().phone == "19900000001" and not store.masking()
    assert {r.pid for r in store.screen({"must_have_skills": ["mysql"]}).where("state = 'hit'").collect()} == {1}
    cell = store.screen({"must_have_skills": ["mysql"]}).where("pid = 1").first().skill_cells[0]
    assert cell.value == "MySQL" and [e.snippet for e in cell.evidence] == ["Java、MySQL"]
    store.merge_candidates(2, 1)
    assert store.timeline(1).first().email == "li@example.com" and store.table("candidates").where("candidate_id = 2").count() == 0
    with pytest.raises(ValueError):
        store.merge_candidates(2, 1)
    removed = store.purge()
    assert removed["resumes"] == 4 and sum(store.purge_preview().values()) == 0 and store.setting("masking") == "off"


def state(store):
    return {n: sorted(map(str, store.table(n).collect())) for n in ("candidates", "resumes", "experiences", "tags", "conflicts", "originals", "settings")}


def test_a_write_that_fails_changes_nothing(spark, tmp_path, folder, monkeypatch):
    """Each write of an import fails in turn; the store stays as it was, and the import that is run again is complete."""
    store = PeopleStore(spark, str(tmp_path / "store"))
    store.set_setting("masking", "off")
    before, written, publish = state(store), PeopleStore._written, PeopleStore._publish
    for broken in (0, 3, 6):
        count = iter(range(100))

        def fails(self, name, rows, n=broken, count=count):
            if next(count) == n:
                raise OSError("no space left")
            return written(self, name, rows)

        def unpublished(self, parts):
            raise OSError("no space left")

        monkeypatch.setattr(PeopleStore, "_written", fails)
        monkeypatch.setattr(PeopleStore, "_publish", unpublished if broken >= 6 else publish)
        with pytest.raises(OSError):
            store.import_files(str(folder), "2026-01-01T00:00:00")
        assert state(store) == before
    monkeypatch.setattr(PeopleStore, "_written", written)
    monkeypatch.setattr(PeopleStore, "_publish", publish)
    assert sorted(names(store.import_files(str(folder), "2026-01-01T00:00:00")).values()) == ["duplicate", "failed", "merged", "new", "new"]
    assert store.table("candidates").count() == 2 and store.table("resumes").count() == 3
    kept = {r.source_file.rsplit("/", 1)[1]: bytes(r.content) for r in store.table("originals").collect()}
    assert kept["a1.txt"] == A1.encode() and set(kept) == {"a1.txt", "a2.txt", "b.txt"}
    store.purge()
    assert not list((tmp_path / "store" / "originals").iterdir()) and not list((tmp_path / "store" / "resumes").iterdir())


def test_appends_write_only_what_is_new(spark, tmp_path, monkeypatch):
    from curricle.plans import store as module

    monkeypatch.setattr(module, "MOST_PARTS", 3)
    store = PeopleStore(spark, str(tmp_path / "store"))
    for i in range(5):
        store.append("tags", spark.createDataFrame([(i, "skill", f"t{i}")], "candidate_id bigint, kind string, tag string"))
        assert len(store._now()["tags"]) == (1, 2, 3, 1, 2)[i] and store.table("tags").count() == i + 1


def test_a_tag_has_one_kind(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, head in enumerate(("技能\nCET-6\n", "证书\nCET-6、PMP\n", "技能\nPMP、Java\n证书\nJava\n")):
        (tmp_path / "in" / f"{i}.txt").write_text(f"姓名：人{i}甲\n电话：1990000001{i}\n{head}", encoding="utf-8")
    store = PeopleStore(spark, str(tmp_path / "store"))
    store.import_files(str(tmp_path / "in"), "2026-01-01T00:00:00")
    got = {(r.candidate_id, r.kind, r.tag) for r in store.table("tags").collect()}
    assert {(k, t) for _, k, t in got} == {("skill", "CET-6"), ("certificate", "PMP"), ("skill", "Java")} and len(got) == 5


def test_numbers_follow_the_order(spark):
    df = spark.range(500).withColumn("k", F.md5(F.col("id").cast("string"))).repartition(9)
    got = [r.k for r in numbered(df, ["k"], "n", 10).orderBy("n").collect()]
    assert got == sorted(got) and numbered(df, ["k"], "n", 10).agg(F.min("n"), F.max("n")).first()[:] == (11, 510)


def test_files_that_arrive(spark, tmp_path, folder):
    store = PeopleStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        arrivals.watch_folder(spark, str(folder), store, str(tmp_path / "checkpoint"), "2026-01-01").awaitTermination(120)
        (folder / "late.txt").write_text("姓名：王五\n电话：19900000005\n", encoding="utf-8")
    assert store.table("candidates").count() == 3 and store.table("resumes").count() == 4


def test_event_windows_and_first_arrivals(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 0{i % 3}:10:00", "a", 1.0, f"h{i % 4}") for i in range(12)], "t string, event_type string, value double, sha string").withColumn("ts", F.to_timestamp("t")).drop("t")
    rows.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "events"))
    for name, df, n in (("counted", arrivals.event_counts(stream), 3), ("firsts", arrivals.first_arrivals(stream, "sha", "ts"), 4)):
        df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "counted" else "append").trigger(availableNow=True).start().awaitTermination(120)
        assert spark.table(name).count() == n


def test_audit_controls(spark):
    hit = [("EMAIL", "contact@mail.com"), ("PHONE", "13800000000"), ("IDCARD", "1" * 17 + "X"), ("USERPATH", "C:\\Users\\someone\\doc"), ("SECRET", "sk-" + "a" * 20), ("SECRET", "token = '" + "v" * 12 + "'"), ("INTRANET_IP", "192.168.1.100"), ("SISTER", "the Secret-Project")]
    clean = ["user@example.com", "USER@EXAMPLE.COM", "dev@users.noreply.github.com", "19900000001", "19900050007", "+@pytest.fixture", "电话 1[3-9]\\d{9}", "seed 20261005 fixed",
             "https://www.cac.gov.cn/2021-08/20/c_1631050028355286.htm", "http://schemas.openxmlformats.org/2006/relationships", '<w:panose1 w:val="02000500000000000000"/>']
    df = spark.createDataFrame([(f"hit{i}", t) for i, (_, t) in enumerate(hit)] + [(f"clean{i}", t) for i, t in enumerate(clean)], "k string, text string")
    found = {(r.k, r.category) for r in privacy.audit_texts(df, "k", "text", ["secret-project"]).collect()}
    assert found == {(f"hit{i}", c) for i, (c, _) in enumerate(hit)}
    row = privacy.verdict(privacy.audit_texts(df, "k", "text")).first()
    assert row.n_hard == 7 and row.exit_code == 1
    blobs = spark.createDataFrame([("b", b"\0 C:/Users/x sk-" + b"a" * 20), ("t", b"mail me@mail.com")], "k string, c binary")
    assert {(r.k, r.category, r.n) for r in privacy.audit_files(blobs, "k", "c").collect()} == {("b", "USERPATH", 1), ("b", "SECRET", 1), ("t", "EMAIL", 1)}


def test_archives(spark):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("docProps/core.xml", "<a>me@mail.com</a>")
        z.writestr("word/fontTable.xml", "11111111111111111X")
    df = spark.createDataFrame([("f.docx", out.getvalue()), ("no.docx", b"C:\\Users\\me")], "k string, c binary")
    assert {(r.k, r.category) for r in privacy.audit_archives(df, "k", "c").collect()} == {("f.docx::docProps/core.xml", "EMAIL"), ("no.docx", "USERPATH")}


def test_command_line(spark, tmp_path, folder, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    store = ["--store", str(tmp_path / "store")]
    assert cli.main(["--version"]) == 0 and cli.main([]) == 2 and cli.main([*store, "import", str(tmp_path / "none")]) == 2
    assert cli.main([*store, "import", str(folder)]) == 1
    assert cli.main([*store, "search", "南湖学院"]) == 0 and "199****0001" in capsys.readouterr().out
    jd = tmp_path / "jd.json"
    jd.write_text('{"must_have_skills": ["Java"]}', encoding="utf-8")
    assert cli.main([*store, "screen", "--jd", str(jd), "--export", str(tmp_path / "out.csv")]) == 0 and (tmp_path / "out.csv").exists()
    jd.write_text("[]")
    assert cli.main([*store, "screen", "--jd", str(jd)]) == 2
    assert cli.main([*store, "purge"]) == 1 and cli.main([*store, "purge", "--confirm", "DELETE"]) == 0
    data = str(tmp_path / "made")
    assert cli.main(["bench", "parse", "--data", data]) == 2
    assert cli.main(["bench", "gen", "--data", data, "--persons", "0"]) == 2
    capsys.readouterr()
    assert cli.main(["bench", "gen", "--data", data, "--persons", "12"]) == 0 and "12 people, 7 with several versions, 2 pairs of one name" in capsys.readouterr().out
    first = sorted((p.name, p.read_bytes()) for p in (tmp_path / "made" / "resumes").iterdir())
    assert cli.main(["bench", "gen", "--data", data, "--persons", "12"]) == 0
    assert first == sorted((p.name, p.read_bytes()) for p in (tmp_path / "made" / "resumes").iterdir())
    assert cli.main(["bench", "parse", "--data", data]) == 0
    capsys.readouterr()
    code, said = cli.main(["bench", "match", "--data", data]), capsys.readouterr().out  # twelve people have too few pairs for the gate of a hundred: the code says what is printed
    rates = {k: float(v) for k, v in re.findall(r"(precision|recall|false_merge_rate) ([0-9.]+)", said)}
    assert code == (0 if rates["precision"] >= 0.95 and rates["recall"] >= 0.95 and rates["false_merge_rate"] == 0 else 1)
    assert rates["precision"] == 1 and rates["false_merge_rate"] == 0 and rates["recall"] >= 0.8
