from curricle.functions import lexicon, masking, text
from pyspark.sql import functions as F


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize_line(spark):
    cases = {"电话：１９９０－０６": "电话：1990-06", "ＣＥＴ－６": "CET-6", "（本科）": "（本科）", "姓 名：毛丹妮": "姓名：毛丹妮", "鹤鸣师范 学院 通信工程": "鹤鸣师范学院通信工程",
             "2025年3月  元界信息  Java开发实习生": "2025年3月 元界信息 Java开发实习生", "磐石系统 | Java开发实习生": "磐石系统 | Java开发实习生", "· 配合运维完成服务升级": "· 配合运维完成服务升级", "Spring Boot": "Spring Boot", "　ａＺ　": "aZ"}
    assert column(spark, cases, text.normalize_line) == list(cases.values())


def test_physical_lines(spark):
    assert column(spark, ["a\r\nb\n\nc\n", "", "x\ry\u2028z", "\n"], text.physical_lines) == [["a", "b", "", "c"], [], ["x", "y", "z"], [""]]


def test_ranges_and_points(spark):
    cases = {"2022-07 - 2024-08": ("2022-07", "2024-08"), "2022年7月至2024年8月": ("2022-07", "2024-08"), "2022年10月 至 2025年2月": ("2022-10", "2025-02"), "2022-07~至今": ("2022-07", None),
             "2022-07 至今": ("2022-07", None), "2022-13 - 2024-08": None, "去年": None, "2022 - 2024": None}
    assert [r and tuple(r) for r in column(spark, cases, text.parse_range)] == list(cases.values())
    assert column(spark, ["2022/7", " 2022年12月 ", "2022-00", "2022", None], text.date_point) == ["2022-07", "2022-12", None, None, None]
    assert column(spark, ["2018-10", "x", "2018"], text.month_index) == [2018 * 12 + 10, None, None]


def test_contents(spark):
    cases = {"Java、Python、MySQL": ["Java", "Python", "MySQL"], "Java | Python": ["Java", "Python"], "HTML/CSS/Java": ["HTML/CSS", "Java"], "JavaSPSSPython爬虫": ["Java", "SPSS", "Python爬虫"], "单项": ["单项"], "": [], "XHTML/CSS": ["XHTML", "CSS"]}
    assert column(spark, cases, lambda x: text.split_content(x, lexicon.SKILLS)) == list(cases.values())
    assert column(spark, ["初级会计职称CET-6CET-4", "CET-6", "CET-6与CET-4"], lambda x: text.lexicon_segment(x, lexicon.CERTIFICATES)) == [["初级会计职称", "CET-6", "CET-4"], None, None]


def test_contacts_and_degrees(spark):
    assert column(spark, ["电话 199-0000-0001。", "1990000 00012", "a19900000001b", "x"], text.first_phone) == ["19900000001", None, "19900000001", None]
    assert column(spark, ["研究生", " 专科 ", "博士后", "其他"], text.normalize_degree) == ["硕士", "大专", None, "其他"]


def test_masks(spark):
    assert column(spark, ["19900000003", "199-0000-0003", "12345", None], masking.mask_phone) == ["199****0003", "199****0003", "12345", ""]
    assert column(spark, ["zhangsan3@example.com", "a@example.com", "none", "@x", "ab@c@d", None], masking.mask_email) == ["z******3@example.com", "a******@example.com", "none", "@x", "a******b@c@d", ""]
    assert column(spark, [" 19900000003 ", "12900000003"], masking.is_probable_phone) == [True, False]
