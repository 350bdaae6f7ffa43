"""PDF files: checks before a job, from the bytes and the page texts; spans and page images through an optional library."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import strip

LOW_TEXT = 30
SPANS = "path string, page_no int, block_no int, block_type int, x0 double, y0 double, x1 double, y1 double, size double, text string, width double, height double, rotation int"


def files_of(spark, path: str) -> DataFrame:
    """path, content of the files under a path."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def preflight(files: DataFrame) -> DataFrame:
    """path, sha256, problem: null for what starts as a PDF does and isn't encrypted. With a column page_count, which who parses the files
    knows (null: it could not be opened), that is looked at too."""
    raw = F.col("content")
    locked = F.decode(raw, "ISO-8859-1").rlike(r"/Encrypt\s*(\d+\s+\d+\s+R|<<)")
    magic = F.substring(raw, 1, 5) == F.lit(b"%PDF-")
    problem = F.when(raw.isNull() | (F.octet_length(raw) == 0), "empty file").when(~magic, "not a PDF").when(locked, "encrypted")
    if "page_count" in files.columns:
        problem = problem.when(F.col("page_count").isNull(), "unopenable").when(F.col("page_count") < 1, "no pages")
    return files.select("path", F.sha2(raw, 256).alias("sha256"), problem.alias("problem"))


def low_text_pages(pages: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, n_pages, low_text: sorted numbers of the pages with fewer than 30 characters, which are scans, most likely."""
    low = F.length(strip(F.coalesce(F.col(text), F.lit("")))) < LOW_TEXT
    return pages.groupBy(*by).agg(F.count("*").alias("n_pages"), F.array_sort(F.collect_list(F.when(low, F.col("page_no")))).alias("low_text"))


def required_text(pages: DataFrame, by: list[str], text: str = "text") -> None:
    """Raises if a page has too little text to be anything but a scan."""
    found = low_text_pages(pages, by, text).where(F.size("low_text") > 0).first()
    if found:
        raise RuntimeError(f"pages without text in {[found[c] for c in by]}: {found['low_text']}")


def output_problem(source_pages: Column, output_pages: Column, text: Column, path: Column, folder: str, encrypted: Column, bilingual: bool = False) -> Column:
    """What is wrong with a translated PDF, the first that holds; null if nothing is: its number of pages, no Han character in its
    text, a place outside the output folder, encryption."""
    wanted = source_pages * 2 if bilingual else source_pages
    outside = ~path.startswith(folder.rstrip("/") + "/") | F.contains(path, F.lit("/../"))
    return F.when(encrypted, "encrypted").when(output_pages != wanted, "another number of pages").when(~text.rlike(r"[\x{4e00}-\x{9fff}]"), "nothing translated").when(outside, "outside the output folder")


def _library():
    try:
        import pymupdf
    except ImportError as e:
        raise RuntimeError("reading PDF pages needs the pymupdf library, which is not installed") from e
    return pymupdf


def spans_of(files: DataFrame) -> DataFrame:
    """SPANS, one row for each span of the files' pages. Needs a PDF library on the executors; untested without one."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        library = _library()
        names = [c.split()[0] for c in SPANS.split(", ")]
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                with library.open(stream=bytes(content), filetype="pdf") as doc:
                    for page in doc:
                        for block in page.get_text("dict")["blocks"]:
                            spans = [s for line in block.get("lines", ()) for s in line["spans"]]
                            rows += [(path, page.number + 1, block["number"], block["type"], *s["bbox"], s["size"], s["text"], page.rect.width, page.rect.height, page.rotation) for s in spans]
                yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(read, SPANS)


def page_images(files: DataFrame, dpi: int = 110) -> DataFrame:
    """path, page_no, jpeg. Needs a PDF library on the executors; untested without one."""

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        library = _library()
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with library.open(stream=bytes(content), filetype="pdf") as doc:
                    for page in doc:
                        yield pd.DataFrame([(path, page.number + 1, page.get_pixmap(dpi=dpi).tobytes("jpeg"))], columns=["path", "page_no", "jpeg"])

    return files.mapInPandas(draw, "path string, page_no int, jpeg binary")
