"""Layout of text blocks: font sizes, headings, reading order, labels and the reasons to skip a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import strip

#: Fixed values.
HEADING = (
    r"(?iU)\A(?:(\d+\.?\s*)?(references?( cited)?( and notes)?|bibliography|literature cited|works cited|literatur(verzeichnis)?|quellen(verzeichnis)?|"
    r"références( bibliographiques)?|bibliographie|referencias( bibliográficas)?|bibliografía|参考文献|參考文獻|引用文献|참고문헌))\z"
)
CAPTION = r"(?U)\A(?:Fig\.|Figure|Figura|Abb\.|Abbildung|Table|Tab\.|Tabelle|Tabla|Tableau|図|表|그림|표)\s*\d"
#: The page of spans that have no width and height.
PAGE_WIDTH, PAGE_HEIGHT = 595.0, 842.0
NOT_TRANSLATED = "not translated"


def document_spans(docs: DataFrame) -> DataFrame:
    """One span for each line of a text, placed on pages of twelve lines by integer arithmetic: doc_id, block_no (the line's
    number), line_no, block_type, page_no, width, height, x0, y0, x1, y1, size, text. Every seventh document has wide pages, every thirteenth
    line is a picture's block."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    right = F.col("n") % 5 == 3
    narrow = F.col("n") % 11 == 10
    x0 = F.when(right, 320.0).otherwise(72.0)
    x1 = F.when(narrow, x0 + F.when(right, 15.0).otherwise(13.0)).otherwise(F.when(right, 560.0).otherwise(300.0))
    y0 = (40 + (F.col("n") % 12) * 60).cast("double")
    size = F.when(F.col("n") % 7 == 6, 6.0).when(F.col("n") % 7 == 0, 12.0).otherwise(10.0)
    wide = F.col("doc_id") % 7 == 3
    page = [F.when(wide, 1000.0).otherwise(PAGE_WIDTH).alias("width"), F.when(wide, 400.0).otherwise(PAGE_HEIGHT).alias("height")]
    kind = F.when(F.col("n") % 13 == 12, 1).otherwise(0).alias("block_type")
    return lines.select("doc_id", F.col("n").alias("block_no"), F.lit(0).alias("line_no"), kind, *page, (F.floor(F.col("n") / 12) + 1).cast("int").alias("page_no"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), (y0 + 15).alias("y1"), size.alias("size"), "text")


def text_blocks(spans: DataFrame) -> DataFrame:
    """Spans of text blocks (block_type 0, where there is one), with the default page's width and height if they have none."""
    usual = {"width": PAGE_WIDTH, "height": PAGE_HEIGHT}
    spans = spans.withColumns({c: F.lit(v) for c, v in usual.items() if c not in spans.columns})
    return spans.where("block_type = 0") if "block_type" in spans.columns else spans


def blocks(spans: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Spans of lines (doc_id, page_no, block_no, line_no, ...) put together: a row for each block, with its box, its lines joined as text, n_lines, its own
    dominant size (the document's where it has no span) and body_size. known: doc_id, compounds (of the documents' whole texts)."""
    rows = text_blocks(spans)
    by = ["doc_id", "page_no", "block_no"]
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"])
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.first("width").alias("width"), F.first("height").alias("height")]
    made = rows.groupBy(*by).agg(*box, F.filter(lines, lambda x: strip(x) != "").alias("lines"))
    body = dominant_size(rows, ["doc_id"], ["page_no", "block_no", "line_no"])
    own = dominant_size(rows, by, ["line_no"]).withColumnRenamed("body_size", "own_size")
    made = made.join(own, by, "left").join(body, "doc_id").withColumn("size", F.coalesce("own_size", "body_size")).drop("own_size")
    none = F.array().cast("array<string>")
    words = F.lit(None).cast("array<string>") if known is None else F.col("compounds")
    made = made if known is None else made.join(known, "doc_id", "left")
    made = made.withColumn("text", joined_lines(F.col("lines"), F.coalesce(words, none))).withColumn("n_lines", F.size("lines"))
    return made.drop("lines", "compounds")


def dominant_size(spans: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """by, size: the size (1 decimal) with the most characters, at a tie the one that comes first."""
    w = F.length(strip(F.col("text"))).cast("long")
    sizes = spans.select(*by, F.round("size", 1).alias("size"), w.alias("w"), F.struct(*order).alias("seq")).groupBy(*by, "size").agg(F.sum("w").alias("n"), F.min("seq").alias("first"))
    best = F.struct((-F.col("n")).alias("n"), "first", "size")
    return sizes.groupBy(*by).agg(F.min(best).alias("b")).select(*by, F.col("b.size").alias("body_size"))


def is_heading(c: Column) -> Column:
    """The line, with its white space collapsed or without any, is a heading of the references."""
    line = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return line.rlike(HEADING) | F.replace(line, F.lit(" "), F.lit("")).rlike(HEADING)


def references_heading(spans: DataFrame) -> DataFrame:
    """doc_id, heading(page_no, right, top): the last heading in the order of pages and blocks."""
    spans, right = text_blocks(spans), F.col("x0") > F.col("width") / 2
    return spans.where(is_heading(F.col("text"))).groupBy("doc_id").agg(F.max_by(F.struct("page_no", right.alias("right"), F.col("y0").alias("top")), F.struct("page_no", "block_no")).alias("heading"))


def after_heading(heading: Column) -> Column:
    right = F.col("x0") > F.col("width") / 2
    later = F.struct(right, F.col("y0")) > F.struct(heading["right"], heading["top"] + 1)
    return F.coalesce((F.col("page_no") > heading["page_no"]) | ((F.col("page_no") == heading["page_no"]) & later), F.lit(False))


def skip_reason(heading: Column | None = None) -> Column:
    """Why a block is skipped, the first that holds; null if it is kept."""
    first = F.when(after_heading(heading) if heading is not None else F.lit(False), "references")
    return first.when(F.col("x1") - F.col("x0") < 20, "narrow margin text").when(~F.col("text").rlike(r"\p{L}{3}"), "no words").when(F.col("y1") < F.col("height") * 0.085, "running header")


def label(lines: Column | int = 1) -> Column:
    """title, caption, figure_text or text, by caption start, size against the body's, and shape."""
    lines = F.lit(lines) if isinstance(lines, int) else lines
    small = (F.col("size") < 0.75 * F.col("body_size")) & (F.col("body_size") != 0)
    title = (lines <= 2) & (F.length("text") < 120) & ~F.col("text").rlike("[.,;:。，；：、]\\z") & (F.col("size") >= 0.95 * F.col("body_size"))
    return F.when(F.col("text").rlike(CAPTION), "caption").when(small, "figure_text").when(title, "title").otherwise("text")


def percent_box() -> list[Column]:
    """left, top, width and height as percents of the page, 2 decimals."""
    width, height = F.col("width"), F.col("height")
    at = {"left": F.col("x0") / width, "top": F.col("y0") / height, "width": (F.col("x1") - F.col("x0")) / width, "height": (F.col("y1") - F.col("y0")) / height}
    return [F.round(c * 100, 2).alias(n) for n, c in at.items()]


def told(spans: DataFrame, heading: DataFrame | None = None) -> DataFrame:
    """Blocks with text, their label, and the reason to skip them (null for those that are kept). Rows of blocks() have
    their sizes and numbers of lines; others are blocks of one line."""
    rows = text_blocks(spans)
    if "body_size" not in rows.columns:
        rows = rows.join(dominant_size(rows, ["doc_id"], ["page_no", "block_no"]), "doc_id")
    rows = rows.where(strip(F.col("text")) != "")
    if heading is not None:
        rows = rows.join(heading, "doc_id", "left")
    reason = skip_reason(F.col("heading") if heading is not None else None)
    return rows.withColumn("reason", reason).withColumn("label", label(F.col("n_lines") if "n_lines" in rows.columns else 1))


def paragraphs(spans: DataFrame, heading: DataFrame | None = None) -> DataFrame:
    """Kept blocks with label, id (dense from 0 in each document, in reading order: page, column, height, block) and checks: long
    texts of figures are not translated, by rule; null for the others. Sizes and headings are those of the whole document. Blocks without
    text are neither kept nor skipped."""
    order = Window.partitionBy("doc_id").orderBy("page_no", F.col("x0") > F.col("width") / 2, "y0", "block_no")
    kept = told(spans, heading).where("reason is null").drop("reason").withColumn("id", (F.row_number().over(order) - 1).cast("long"))
    return kept.withColumn("checks", F.when((F.col("label") == "figure_text") & (F.length("text") > 80), NOT_TRANSLATED))


def skipped(spans: DataFrame, heading: DataFrame | None = None) -> DataFrame:
    """doc_id, page_no, reason, text (its first 80 characters) of the blocks that are left out."""
    return told(spans, heading).where("reason is not null").select("doc_id", "page_no", "reason", F.left("text", F.lit(80)).alias("text"))


def paired_pages(source: DataFrame, output: DataFrame, by: list[str], page: str = "page_no") -> DataFrame:
    """by, source, output: the pages of two documents by position; null where one has none."""
    place = lambda df, name: df.select(*by, F.col(page).alias(name), F.row_number().over(Window.partitionBy(*by).orderBy(page)).alias("at"))
    return place(source, "source").join(place(output, "output"), [*by, "at"], "full_outer").drop("at")


def joined_lines(lines: Column, compounds: Column) -> Column:
    """An array of lines as one text: a line that ends in a hyphen after ASCII letters and goes on in lower case is joined, and
    keeps the hyphen if the compound is known (an array of lower-case words); others are joined by a space."""
    own = F.filter(F.transform(lines, lambda x: strip(x)), lambda x: x != "")

    def step(a, x):
        torn = a.rlike(r"[A-Za-z]-\z") & x.rlike(r"\A[a-z]")
        word = F.lower(F.concat(F.regexp_extract(a, r"([A-Za-z]+-)\z", 1), F.regexp_extract(x, r"\A([a-z]+)", 1)))
        return F.when(a == "", x).when(torn & F.array_contains(compounds, word), F.concat(a, x)).when(torn, F.concat(F.regexp_replace(a, r"-\z", ""), x)).otherwise(F.concat(a, F.lit(" "), x))

    return F.aggregate(own, F.lit(""), step)


def compounds(texts: DataFrame, by: str, text: str = "text") -> DataFrame:
    """by, compounds: the distinct hyphenated words of all its text, in lower case."""
    found = texts.select(by, F.explode(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+-[a-z]+)"), F.lit(1))).alias("w")).distinct()
    return found.groupBy(by).agg(F.array_sort(F.collect_list("w")).alias("compounds"))


def region_union(regions: DataFrame, glyphs: DataFrame, by: list[str]) -> DataFrame:
    """by, region_id, x0, y0, x1, y1: each region's box grown to the boxes of the glyphs whose centre lies in it (edges count)."""
    g = glyphs.select(*by, *[F.col(c).alias(f"g_{c}") for c in ("x0", "y0", "x1", "y1")])
    x, y = (F.col("g_x0") + F.col("g_x1")) / 2, (F.col("g_y0") + F.col("g_y1")) / 2
    met = regions.join(g, by).where(x.between(F.col("x0"), F.col("x1")) & y.between(F.col("y0"), F.col("y1")))
    grown = met.groupBy(*by, "region_id").agg(F.min("g_x0").alias("a"), F.min("g_y0").alias("b"), F.max("g_x1").alias("c"), F.max("g_y1").alias("d"))
    all_ = regions.join(grown, [*by, "region_id"], "left")
    return all_.select(*by, "region_id", F.least("x0", "a").alias("x0"), F.least("y0", "b").alias("y0"), F.greatest("x1", "c").alias("x1"), F.greatest("y1", "d").alias("y1"))
