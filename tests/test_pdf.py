import base64
import zlib

import pytest
from curricle.operators import extract
from curricle.sources import files, pdf, rendering
from pyspark.sql import functions as F

LINES = ["姓名：张甲乙", "电话：19900000009", "工作经历", "甲公司 | 开发 | 2020-01 - 2021-01", "2021-02 - 至今  乙公司  Java开发", "· " + "负责接口与数据" * 20, "技能", "Java · HTML/CSS"]


def lines_of(body):
    return pdf.page_lines(pdf.glyphs(body))


def objects(*parts, tail=b"trailer\n<</Root 1 0 R>>"):
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, p) for i, p in enumerate(parts, 1)) + tail


def stream(body, head=b""):
    return b"<<" + head + b"/Length %d>>\nstream\n%s\nendstream" % (len(body), body)


PAGE = b"<</Type/Page/Parent 2 0 R/Contents 4 0 R>>"
PAGES = b"<</Type/Pages/Count 1/Kids[3 0 R]/MediaBox[0 0 200 100]/Resources<</Font<</A 5 0 R>>/XObject<</X 6 0 R>>>>>>"
LATIN = b"<</Type/Font/Subtype/Type1/Encoding/WinAnsiEncoding/FirstChar 65/Widths[500 500]>>"


def test_rendered_lines_come_back():
    many = LINES * 12
    got = lines_of(rendering.pdf_bytes(many))
    assert [x[2] for x in got] == [p for x in many for p in rendering.wrapped(x)] and got[-1][0] > 1 and got[0][:2] == (1, 1)
    assert rendering.pdf_bytes(many) == rendering.pdf_bytes(many) and lines_of(rendering.pdf_bytes([])) == []


def test_operators_fonts_and_filters():
    shown = rb'''q 1 0 0 1 10 0 cm BT /A 10 Tf 14 TL 5 80 Td (A\(B\)\101) Tj T* [(B) -2000 (A)] TJ (x) ' 0 0 (\344) " ET Q /X Do'''
    form = stream(b"BT /A 10 Tf 1 0 0 1 150 80 Tm (right) Tj ET", b"/Type/XObject/Subtype/Form")
    for body, head in ((shown, b""), (zlib.compress(shown), b"/Filter/FlateDecode"), (base64.a85encode(zlib.compress(shown)) + b"~>", b"/Filter[/ASCII85Decode/FlateDecode]"), (shown.hex().encode() + b">", b"/Filter/ASCIIHexDecode")):
        got = lines_of(objects(b"<</Type/Catalog/Pages 2 0 R>>", PAGES, PAGE, stream(body, head), LATIN, form))
        assert got == [(1, 1, "A(B)Aright"), (1, 2, "BA"), (1, 3, "x"), (1, 4, "ä")]


def test_maps_object_streams_and_later_versions():
    packed = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: PAGES}
    at, heads, body = 0, [], b""
    for k, v in packed.items():
        heads.append(b"%d %d" % (k, at))
        body += v + b" "
        at = len(body)
    first = b" ".join(heads) + b" "
    held = stream(zlib.compress(first + body), b"/Type/ObjStm/N 2/First %d/Filter/FlateDecode" % len(first))
    font = b"<</Type/Font/Subtype/Type0/Encoding/Identity-H/DescendantFonts[<</DW 1000>>]/ToUnicode 8 0 R>>"
    cmap = stream("1 beginbfchar <0001> <7532> endbfchar 2 beginbfrange <0002> <0003> <4E00> <0005> <0006> [<4E59> <00660069>] endbfrange".encode())
    numbered = lambda k, v: b"%d 0 obj\n%s\nendobj\n" % (k, v)
    old, new = (stream(b"BT /A 10 Tf <%s> Tj ET" % x) for x in (b"0001", b"000100020003000500060009"))
    out = b"%PDF-1.5\n" + numbered(4, old) + numbered(3, PAGE) + numbered(5, font) + numbered(8, cmap) + numbered(9, held) + numbered(4, new)
    assert lines_of(out) == [(1, 1, "甲一丁乙fi�")]


@pytest.mark.parametrize("body", [b"", b"no pdf", b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj", objects(b"<</Type/Catalog/Pages 2 0 R>>", PAGES, PAGE, stream(b"xx", b"/Filter/LZWDecode"), LATIN),
                                  rendering.pdf_bytes(LINES * 12)[:-3000], objects(b"<</Type/Catalog/Pages 2 0 R>>", tail=b"trailer <</Encrypt 9 0 R>>"), objects(b"<</Type/Catalog/Pages 2 0 R>>", b"<</Kids[2 0 R]>>"),
                                  objects(b"<</Type/Catalog/Pages 2 0 R>>", PAGES, PAGE, stream(zlib.compress(b"BT ET" * 99)[:-9], b"/Filter/FlateDecode"), LATIN)])
def test_what_cannot_be_read(body):
    with pytest.raises(pdf.Unreadable):
        pdf.glyphs(body)


def test_same_card_from_every_format(spark, tmp_path):
    for name, body in (("a.pdf", rendering.pdf_bytes(LINES)), ("b.docx", rendering.docx_bytes(LINES, table=True)), ("c.txt", rendering.text_bytes(LINES, crlf=True, gbk=True)), ("d.pdf", b"%PDF-1.4"), ("e.pdf", rendering.pdf_bytes([]))):
        (tmp_path / name).write_bytes(body)
    rows = files.read_resumes(files.resume_files(spark, str(tmp_path))).withColumn("parsed_at", F.lit(""))
    assert {r.source_file[-5:]: r.error is None for r in rows.collect()} == {"a.pdf": True, ".docx": True, "c.txt": True, "d.pdf": False, "e.pdf": True}
    cards = {r.file_type: r for r in extract.extract_cards(rows.where("error is null and raw_text != ''")).collect()}
    for card in cards.values():
        assert {k: v.value for k, v in card.fields.items()} == {"name": "张甲乙", "phone": "19900000009"}
        assert [tuple(e)[:4] for e in card.experiences] == [("甲公司", "开发", "2020-01", "2021-01"), ("乙公司", "Java开发", "2021-02", None)] and [s.value for s in card.skills] == ["Java", "HTML/CSS"]
    assert len(cards) == 3 and cards["pdf"].fields["phone"].evidence[0].location == "p1/L2"


def test_line_rule_is_that_of_glyph_tables(spark):
    body = rendering.pdf_bytes(LINES * 8)
    g = spark.createDataFrame([("f", *x) for x in pdf.glyphs(body)], "source_file string, page int, top double, x0 double, text string")
    got = files.read_glyphs(g).first()
    assert [(x.location, x.raw) for x in got.lines] == [(f"p{p}/L{n}", t.strip()) for p, n, t in lines_of(body)]
