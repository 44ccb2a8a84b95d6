"""Resume files as texts and lines: plain text, Word documents, PDF files and glyphs of pages."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_line, physical_lines, strip
from ..shipping import ship
from . import pdf

SUFFIXES = ("pdf", "docx", "txt")
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
LINES = "ARRAY<STRUCT<line_no: INT, raw: STRING, text: STRING, location: STRING>>"


def resume_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under path (or the one file): source_file, file_type (lower-case suffix), file_sha256, content, in no order.

    Folders are read recursively and only known suffixes are taken from them; a file named itself is taken whatever its suffix.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = not where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = rows.withColumn("file_type", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)))
    if not single:
        rows = rows.where(F.col("file_type").isin(*SUFFIXES))
    return rows.select(F.col("path").alias("source_file"), "file_type", F.sha2("content", 256).alias("file_sha256"), "content")


def _numbered(text, clean_spaces: bool = True):
    lines = F.transform(physical_lines(text), lambda x, i: F.struct((i + 1).cast("int").alias("line_no"), strip(x).alias("raw"), normalize_line(x, clean_spaces).alias("text"),
                                                                    F.concat(F.lit("L"), (i + 1).cast("string")).alias("location")))
    return lines


def read_txt(files: DataFrame) -> DataFrame:
    """raw_text and lines of text files: UTF-8, else GBK; null where neither decodes."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def text(body: bytes) -> str | None:
            for name in ("utf-8", "gbk"):
                try:
                    return bytes(body).decode(name)
                except UnicodeDecodeError:
                    continue
            return None
        for batch in batches:
            yield pd.DataFrame({"source_file": batch["source_file"], "file_type": batch["file_type"], "file_sha256": batch["file_sha256"], "raw_text": batch["content"].map(text)})

    rows = files.mapInPandas(decode, "source_file STRING, file_type STRING, file_sha256 STRING, raw_text STRING")
    return rows.withColumn("lines", _numbered(F.col("raw_text")).cast(LINES))


def docx_lines(content: bytes) -> list[str]:
    """Paragraphs and two-column table rows (`label：value`) of a Word document in order of its body, empty ones left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    marks = {f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n"}

    def text(node) -> str:
        return "".join(x.text or "" if x.tag == f"{WORD}t" else marks.get(x.tag, "") for x in node.iter())

    out = []
    for child in body:
        if child.tag == f"{WORD}p":
            out.append(text(child))
        elif child.tag == f"{WORD}tbl":
            for row in child.iter(f"{WORD}tr"):
                cells = [" ".join(text(p) for p in cell.iter(f"{WORD}p")).replace("\n", " ").strip() for cell in row.findall(f"{WORD}tc")]
                if len(cells) >= 2 and cells[0] and cells[1]:
                    out.append(f"{cells[0]}：{cells[1]}")
    return [x for x in out if x.strip()]


def read_docx(files: DataFrame) -> DataFrame:
    """raw_text and lines of Word documents; null where the archive can't be read."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def lines(body: bytes) -> list[str] | None:
            try:
                return docx_lines(bytes(body))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError):
                return None
        for batch in batches:
            yield pd.DataFrame({"source_file": batch["source_file"], "file_type": batch["file_type"], "file_sha256": batch["file_sha256"], "parts": batch["content"].map(lines)})

    rows = files.mapInPandas(decode, "source_file STRING, file_type STRING, file_sha256 STRING, parts ARRAY<STRING>")
    lines = F.transform("parts", lambda x, i: F.struct((i + 1).cast("int").alias("line_no"), strip(x).alias("raw"), normalize_line(x).alias("text"), F.concat(F.lit("L"), (i + 1).cast("string")).alias("location")))
    return rows.select("source_file", "file_type", "file_sha256", F.array_join("parts", "\n").alias("raw_text"), lines.cast(LINES).alias("lines"))


def glyph_lines(glyphs: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Lines of pages from glyphs (source_file, page, top, x0, text): source_file, page, line_no, raw.

    Glyphs go from top to bottom; one that lies more than `tolerance` below the first of its line opens the next line, and each line reads
    from left to right. Where a line starts depends on where the last one did, so the scan is a fold over a page's distinct heights.
    """
    page = ["source_file", "page"]
    tops = glyphs.groupBy(*page).agg(F.array_sort(F.collect_set("top")).alias("tops"))
    starts = F.aggregate("tops", F.array().cast("array<double>"), lambda a, t: F.when((F.size(a) == 0) | (t - F.element_at(a, -1) > tolerance), F.concat(a, F.array(t))).otherwise(a))
    ruled = tops.select(*page, F.posexplode(starts).alias("i", "start"))
    order = Window.partitionBy(*page).orderBy("start")
    ruled = ruled.withColumn("stop", F.lead("start").over(order)).withColumn("line_no", F.col("i") + 1)
    rows = glyphs.join(ruled, page).where((F.col("top") >= F.col("start")) & (F.col("stop").isNull() | (F.col("top") < F.col("stop"))))
    return rows.groupBy(*page, "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "top", "text"))), lambda g: g["text"]), "").alias("raw"))


def read_glyphs(glyphs: DataFrame) -> DataFrame:
    """raw_text and lines of paged files from their glyphs; locations are `p<page>/L<line>`."""
    rows = glyph_lines(glyphs).withColumn("location", F.format_string("p%d/L%d", "page", "line_no"))
    each = rows.groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("page", "line_no", "raw", "location"))).alias("x"))
    lines = F.transform("x", lambda v, i: F.struct((i + 1).cast("int").alias("line_no"), strip(v["raw"]).alias("raw"), normalize_line(v["raw"]).alias("text"), v["location"].alias("location")))
    return each.select("source_file", F.array_join(F.col("x.raw"), "\n").alias("raw_text"), lines.cast(LINES).alias("lines"))


def read_pdf(files: DataFrame) -> DataFrame:
    """raw_text and lines of PDF files, each decoded where it lies; null where the bytes can't be read. A file without text has no lines."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def parts(body: bytes) -> list[dict] | None:
            try:
                return [{"location": f"p{page}/L{line}", "raw": raw} for page, line, raw in pdf.page_lines(pdf.glyphs(bytes(body)))]
            except pdf.Unreadable:
                return None
        for batch in batches:
            yield pd.DataFrame({"source_file": batch["source_file"], "file_type": batch["file_type"], "file_sha256": batch["file_sha256"], "parts": batch["content"].map(parts)})

    rows = files.mapInPandas(decode, "source_file STRING, file_type STRING, file_sha256 STRING, parts ARRAY<STRUCT<location: STRING, raw: STRING>>")
    lines = F.transform("parts", lambda v, i: F.struct((i + 1).cast("int").alias("line_no"), strip(v["raw"]).alias("raw"), normalize_line(v["raw"]).alias("text"), v["location"].alias("location")))
    return rows.select("source_file", "file_type", "file_sha256", F.array_join(F.col("parts.raw"), "\n").alias("raw_text"), lines.cast(LINES).alias("lines"))


def read_resumes(files: DataFrame, glyphs: DataFrame | None = None) -> DataFrame:
    """source_file, file_type, file_sha256, raw_text, lines, error: every file, each by its type.

    PDF files with glyphs from elsewhere (source_file, page, top, x0, text) are read from these, all others from their bytes.
    """
    names = ["source_file", "file_type", "file_sha256", "raw_text", "lines"]
    ship(files.sparkSession)
    out = read_txt(files.where("file_type = 'txt'")).select(names).unionByName(read_docx(files.where("file_type = 'docx'")).select(names))
    pages = files.where("file_type = 'pdf'")
    if glyphs is not None:
        given = read_glyphs(glyphs)
        out = out.unionByName(pages.select("source_file", "file_type", "file_sha256").join(given, "source_file").select(names))
        pages = pages.join(given.select("source_file"), "source_file", "left_anti")
    out = out.unionByName(read_pdf(pages).select(names))
    known = F.col("file_type").isin(*SUFFIXES)
    rest = files.where(~known).select("source_file", "file_type", "file_sha256").withColumn("raw_text", F.lit(None).cast("string")).withColumn("lines", F.lit(None).cast(LINES))
    out = out.unionByName(rest.select(names))
    return out.withColumn("error", F.when(~known, F.concat(F.lit("unsupported file type: "), "file_type")).when(F.col("raw_text").isNull(), F.lit("the file can't be read")))
