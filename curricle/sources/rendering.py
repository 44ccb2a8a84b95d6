"""Resume lines as the bytes of text, Word and PDF files; the same lines give the same bytes."""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.sax.saxutils import escape

#: The page, its margins and what a character takes, in points.
PAGE, LEFT, RIGHT, TOP, BOTTOM, LEADING, SIZE = (595, 842), 60, 50, 800, 60, 17, 10.5
WORD_SPACE = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_TYPES = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
          '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" '
          'ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
_LINKS = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
          '<Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')


def text_bytes(lines: list[str], crlf: bool = False, gbk: bool = False) -> bytes:
    return ("\r\n" if crlf else "\n").join(lines).encode("gbk" if gbk else "utf-8")


def docx_bytes(lines: list[str], table: bool = False) -> bytes:
    """A Word document with a paragraph for each line; with `table`, leading `label：value` lines are rows of a table."""
    def paragraph(x: str) -> str:
        return f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>'

    rows = 0
    while table and rows < len(lines) and "：" in lines[rows]:
        rows += 1
    cells = ("".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in x.split("：", 1)) for x in lines[:rows])
    head = f"<w:tbl>{''.join(f'<w:tr>{c}</w:tr>' for c in cells)}</w:tbl>" if rows else ""
    body = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document {WORD_SPACE}><w:body>{head}{"".join(map(paragraph, lines[rows:]))}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, part in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _LINKS), ("word/document.xml", body)):
            entry = zipfile.ZipInfo(name, date_time=(1980, 1, 1, 0, 0, 0))
            entry.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(entry, part)
    return out.getvalue()


def wrapped(line: str, size: float = SIZE) -> list[str]:
    """The line in parts that fit the page: an ideograph takes an em, everything else 0.6."""
    out, part, width = [], "", 0.0
    for c in line:
        w = size if ord(c) > 0x2E7F or c in "（）【】·，、：；" else 0.6 * size
        if part and width + w > PAGE[0] - LEFT - RIGHT:
            out.append(part)
            part, width = "", 0.0
        part, width = part + c, width + w
    return [*out, part]


def pdf_bytes(lines: list[str]) -> bytes:
    """A PDF of these lines in a font that readers bring along (UCS-2 codes); lines that are too long are wrapped."""
    pages, y = [[]], TOP
    for part in (p for line in lines for p in wrapped(line)):
        if y < BOTTOM:
            pages.append([])
            y = TOP
        if part:
            pages[-1].append(f"1 0 0 1 {LEFT} {y} Tm <{part.encode('utf-16-be').hex()}> Tj")
        y -= LEADING
    first = 5
    kids = " ".join(f"{first + 2 * i} 0 R" for i in range(len(pages)))
    objects = ["<</Type/Catalog/Pages 2 0 R>>", f"<</Type/Pages/Kids[{kids}]/Count {len(pages)}>>",
               "<</Type/Font/Subtype/Type0/BaseFont/STSong-Light/Encoding/UniGB-UCS2-H/DescendantFonts[4 0 R]>>",
               "<</Type/Font/Subtype/CIDFontType0/BaseFont/STSong-Light/DW 1000/W[1 95 500]/CIDSystemInfo<</Registry(Adobe)/Ordering(GB1)/Supplement 0>>>>"]
    for i, page in enumerate(pages):
        body = zlib.compress(f"BT /F1 {SIZE} Tf\n{chr(10).join(page)}\nET".encode())
        objects.append(f"<</Type/Page/Parent 2 0 R/MediaBox[0 0 {PAGE[0]} {PAGE[1]}]/Resources<</Font<</F1 3 0 R>>>>/Contents {first + 2 * i + 1} 0 R>>")
        objects.append(f"<</Length {len(body)}/Filter/FlateDecode>>\nstream\n".encode() + body + b"\nendstream")
    out, places = bytearray(b"%PDF-1.4\n"), []
    for number, o in enumerate(objects, 1):
        places.append(len(out))
        out += f"{number} 0 obj\n".encode() + (o if isinstance(o, bytes) else o.encode()) + b"\nendobj\n"
    start = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
    return bytes(out + f"trailer\n<</Size {len(objects) + 1}/Root 1 0 R>>\nstartxref\n{start}\n%%EOF\n".encode())
