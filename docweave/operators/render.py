"""Reading pages as HTML, rendered row by row and put together in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import escape_html, inline_jpeg, shown
from docweave.operators.layout import NOT_TRANSLATED


def _ordered(rows: Column) -> Column:
    """The html of an aggregate's structs, in their order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda s: s["html"]), "")


def _joined(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def page_sections(rows: DataFrame, by: list[str], page: str = "page_no", references_page: str | None = None, pages: DataFrame | None = None) -> DataFrame:
    """by, page, html, n_rows: rows have id, label, output and perhaps checks and source. Text rows come in order of id, with a mark where the
    checks failed; figure texts are grouped in a table, beside the first 80 characters of their source, those that are not translated by
    rule with a hint. pages: by, page and perhaps jpeg: these pages have a section even without rows, which then says so, and their
    image in it; by default only pages with rows have one. Pages from the references on say that they are left as they are; references_page is
    a column of pages or, where pages do not have it, of rows, and then a document without rows has none."""
    tag = F.when(F.col("label") == "title", "h2").when(F.col("label") == "caption", "figcaption").otherwise("p")
    checks = F.coalesce(F.col("checks"), F.lit("passed")) if "checks" in rows.columns else F.lit("passed")
    mark = F.when(checks.isin("passed", NOT_TRANSLATED), "").otherwise(_joined('<span class="warn">', escape_html(checks), "</span>"))
    body = F.when(checks == NOT_TRANSLATED, F.lit("<em>see the page</em>")).when(F.col("output") == "", F.lit("<em>no text</em>")).otherwise(escape_html(F.col("output")))
    beside = _joined("<td>", shown(F.coalesce(F.col("source"), F.lit(""))), "</td>") if "source" in rows.columns else F.lit("")
    cell = _joined("<tr>", beside, "<td>", body, "</td></tr>")
    html = F.when(F.col("label") == "figure_text", cell).otherwise(_joined("<", tag, ">", body, mark, "</", tag, ">"))
    made = rows.withColumn("html", html).withColumn("figure", F.col("label") == "figure_text")
    text, cells = (_ordered(F.when(which, F.struct("id", "html"))) for which in (~F.col("figure"), F.col("figure")))
    of_pages = pages is not None and references_page in pages.columns
    of_rows = references_page is not None and not of_pages
    sections = made.groupBy(*by, page).agg(text.alias("text"), cells.alias("cells"), F.count_if("figure").alias("n_figures"), F.count("*").alias("n_rows"), *([F.first(references_page).alias("ref")] if of_rows else []))
    jpeg = F.lit(None).cast("binary")
    if pages is not None:
        kept = [*by, page, *(["jpeg"] if "jpeg" in pages.columns else []), *([F.col(references_page).alias("ref")] if of_pages else [])]
        sections = pages.select(kept).join(sections, [*by, page], "left")
        jpeg = F.col("jpeg") if "jpeg" in pages.columns else jpeg
        if of_rows:  # a page without rows has its document's
            known = rows.groupBy(*by).agg(F.first(references_page).alias("own_ref"))
            sections = sections.join(known, by, "left").withColumn("ref", F.coalesce("ref", "own_ref"))
    n_rows = F.coalesce("n_rows", F.lit(0))
    figures = F.when(F.col("n_figures") > 0, _joined("<details><summary>", F.col("n_figures").cast("string"), "</summary><table>", F.col("cells"), "</table></details>")).otherwise("")
    note = F.when(n_rows == 0, F.lit("<p>Nothing on this page</p>")).otherwise("")
    if references_page:
        note = F.when(F.col(page) >= F.col("ref"), F.lit("<p>References</p>")).otherwise(note)
    number = F.col(page).cast("string")
    image = F.when(jpeg.isNotNull(), _joined('<img alt="page ', number, '" loading="lazy" src="', inline_jpeg(jpeg), '">')).otherwise("")
    whole = _joined('<section id="page-', number, '">', F.coalesce("text", F.lit("")), figures, note, image, "</section>")
    return sections.select(*by, page, whole.alias("html"), n_rows.alias("n_rows"))


STYLE = "section{display:flex;gap:1em}img{max-width:50%}.warn{color:#a00}"
#: Sends a question about the page that is shown to the service, with the token that it put into the page.
SCRIPT = "document.forms.ask.onsubmit=async e=>{e.preventDefault();const f=e.target,r=await fetch('/api/ask',{method:'POST',headers:{'X-Token':f.dataset.token},body:JSON.stringify({question:f.question.value,page:+(location.hash.slice(6)||f.dataset.first),full:f.full.checked})});f.answer.value=(await r.json()).answer}"


def reading_pages(sections: DataFrame, titles: DataFrame, by: list[str], page: str = "page_no", lang: str = "en") -> DataFrame:
    """by, html: one document a row. sections: page_sections' result; titles: by, title, facts (array of struct(name, value)), of
    which a null value is shown as empty. A document without sections has no row."""
    number = F.col(page).cast("string")
    link = _joined('<a href="#page-', number, '">', number, "</a>")
    whole = sections.withColumn("link", link).groupBy(*by).agg(
        _ordered(F.struct(page, F.col("link").alias("html"))).alias("nav"),
        _ordered(F.struct(page, "html")).alias("main"),
        F.min(page).cast("string").alias("first"),
    )
    facts = F.array_join(F.transform("facts", lambda f: _joined("<dt>", escape_html(f["name"]), "</dt><dd>", escape_html(F.coalesce(f["value"], F.lit(""))), "</dd>")), "")
    title = escape_html(F.coalesce("title", F.lit("")))
    head = _joined(f'<!doctype html><html lang="{lang}"><head><meta charset="utf-8"><title>', title, f"</title><style>{STYLE}</style></head><body><header><h1>", title, "</h1></header>")
    ask = _joined('<aside><form name="ask" data-token="{token}" data-first="', F.col("first"), f'"><textarea name="question"></textarea><label><input type="checkbox" name="full">all pages</label><button>Ask</button><output name="answer"></output></form></aside><script>{SCRIPT}</script>')
    return whole.join(titles, by).select(*by, _joined(head, "<nav>", F.col("nav"), "</nav><main>", F.col("main"), "</main><footer><dl>", facts, "</dl></footer>", ask, "</body></html>").alias("html"))
