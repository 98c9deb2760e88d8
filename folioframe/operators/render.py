"""Renderings: Markdown, HTML and previews, as string columns built by ordered aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import layout

PREVIEW = 50_000
NO_DATA = "<html><body><p>No data available</p></body></html>"
#: Lead of an HTML document made from Markdown; fixed text.
HEAD = "\n".join(
    [
        "<!DOCTYPE html>",
        "<html>",
        "<head>",
        '<meta charset="UTF-8">',
        "<title>Document</title>",
        "<style>",
        "body { font-family: Arial, sans-serif; line-height: 1.6; margin: 2em; }",
        "h1 { text-align: center; font-size: 24px; }",
        "h2 { margin-top: 2em; }",
        "h3 { margin-top: 1.5em; }",
        "hr { margin: 2em 0; }",
        "</style>",
        "</head>",
        "<body>",
    ]
)


def hundredths(px: str | Column) -> Column:
    """Pixels as centimetres with two decimals, half up, in exact arithmetic: a pixel has 127 / 96 hundredths."""
    c = F.col(px) if isinstance(px, str) else px
    return F.format_string("%.2f", F.floor((c * 254 + 96) / 192) / 100)


def academic_pages(envelopes: DataFrame) -> DataFrame:
    """(env_id, file_idx, page_idx, markdown): headings by detected page number, bands, indents, typed lines, footnotes last.

    All of it is told from the page's own row.
    """
    pages = layout.page_lines(envelopes)

    def line(r: Column, i: Column) -> Column:
        t, kind = T.strip(r["text"]), layout.line_type(r["text"], i, F.col("page.footnote_start"))
        pad = F.repeat(F.lit(" "), layout.nearest(r["x"], F.col("page.centres")) * 2)
        shown = (
            F.when(kind == "page_number", F.concat(pad, F.lit("**"), t, F.lit("**")))
            .when(kind == "header", F.concat(F.lit("\n## "), t, F.lit("\n")))
            .when(kind == "reference", F.concat(pad, F.lit("> "), t))
            .when(kind == "footnote", F.concat(F.lit("   "), t))
            .otherwise(F.concat(pad, t))
        )
        return F.struct(T.band(r["y"]).alias("band"), r["x"].alias("x"), i.alias("i"), (kind == "footnote").alias("note"), shown.alias("s"))

    rows = pages.withColumn("items", F.array_sort(F.transform("lines", line)))
    # a band ends with an empty line
    body = F.flatten(F.transform("items", lambda r, i: F.concat(
        F.when(r["note"], F.array().cast("array<string>")).otherwise(F.array(r["s"])),
        F.when(F.coalesce(F.get("items", i + 1)["band"] == r["band"], F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit(""))),
    )))
    notes = F.transform(F.filter("items", lambda r: r["note"]), lambda r: r["s"])
    rows = rows.select(*layout.PAGE, *layout.extents(), F.col("page.page_number").alias("page_number"), F.array_join(body, "\n").alias("main"), notes.alias("notes"))
    number = F.coalesce(F.nullif("page_number", F.lit(0)), F.col("page_idx") + 1).cast("string")
    size = F.concat(F.lit("<!-- Page dimensions: "), hundredths("width_px"), F.lit("cm x "), hundredths("height_px"), F.lit("cm -->\n"))
    foot = F.when(F.size("notes") > 0, F.concat(F.lit("\n---\n\n*Footnotes:*\n\n"), F.array_join("notes", "\n")))
    return rows.select(*layout.PAGE, F.concat_ws("\n", F.concat(F.lit("# Page "), number, F.lit("\n")), size, "main", foot, F.lit("\n\n---\n")).alias("markdown"))


def academic_markdown(envelopes: DataFrame) -> DataFrame:
    """(env_id, file_idx, markdown): the pages' Markdown in order."""
    pages = academic_pages(envelopes).groupBy("env_id", "file_idx").agg(F.array_sort(F.collect_list(F.struct("page_idx", "markdown"))).alias("p"))
    return pages.select("env_id", "file_idx", F.array_join(F.transform("p", lambda x: x["markdown"]), "\n").alias("markdown"))


def plain_markdown(lines: Column) -> Column:
    """A page's lines as Markdown by the plain types, without positions; blank lines dropped."""
    shown = lambda x: F.when(layout.plain_type(x) == "header", F.concat(F.lit("\n## "), T.strip(x), F.lit("\n"))).when(layout.plain_type(x) == "page_number", F.concat(F.lit("**"), T.strip(x), F.lit("**"))).otherwise(T.strip(x))
    return F.array_join(F.transform(F.filter(lines, lambda x: x.isNotNull() & (T.strip(x) != "")), shown), "\n")


def positioned_html(envelopes: DataFrame) -> DataFrame:
    """(env_id, file_idx, page_idx, html): lines as absolutely positioned boxes in centimetres (opt-in rendering)."""
    box = lambda r: F.concat(F.lit('<div style="position:absolute;left:'), hundredths(r["x"]), F.lit("cm;top:"), hundredths(r["y"]), F.lit('cm">'), T.html_escape_quotes(T.strip(r["text"])), F.lit("</div>"))
    return layout.page_lines(envelopes).where("size(lines) > 0").select(*layout.PAGE, F.array_join(F.transform("lines", box), "\n").alias("html"))


def markdown_to_html(markdown: Column) -> Column:
    """Line prefixes to tags, nothing escaped, rules for lines that begin with three hyphens, blank lines dropped."""
    tag = lambda x, mark, name: F.concat(F.lit(f"<{name}>"), F.substring(x, len(mark) + 1, 1_000_000_000), F.lit(f"</{name}>"))
    line = lambda x: (
        F.when(x.startswith("# "), tag(x, "# ", "h1")).when(x.startswith("## "), tag(x, "## ", "h2")).when(x.startswith("### "), tag(x, "### ", "h3")).when(x.startswith("#### "), tag(x, "#### ", "h4"))
        .when(x.startswith("---"), F.lit("<hr>")).when(T.strip(x) != "", F.concat(F.lit("<p>"), x, F.lit("</p>")))
    )
    return F.array_join(F.concat(F.array(F.lit(HEAD)), F.filter(F.transform(F.split(markdown, "\n"), line), lambda x: x.isNotNull()), F.array(F.lit("</body></html>"))), "\n")


def text_html(text: Column, filename: Column, timestamp: Column) -> Column:
    """A simple page: title, source line, and the escaped text in a preformatted block."""
    name, time = F.coalesce(filename, F.lit("")), F.coalesce(timestamp, F.lit(""))
    meta = F.concat_ws(" | ", F.when(name != "", F.concat(F.lit("Source: "), T.html_escape(name))), F.when(time != "", F.concat(F.lit("Processed: "), T.html_escape(time))))
    return F.concat(
        F.lit('<!DOCTYPE html>\n<html>\n<head>\n    <meta charset="UTF-8">\n    <title>Document Text'),
        F.when(name != "", F.concat(F.lit(" - "), T.html_escape(name))).otherwise(""),
        F.lit("</title>\n</head>\n<body>\n    <h1>Document Text</h1>\n    "),
        F.when(meta != "", F.concat(F.lit('<div class="metadata">'), meta, F.lit("</div>"))).otherwise(""),
        F.lit("\n    <pre>"), T.html_escape(text), F.lit("</pre>\n</body>\n</html>"),
    )


def preview(text: Column, limit: int = PREVIEW) -> Column:
    """The first `limit` characters with a notice of what is left out; an error line for nothing."""
    notice = F.concat(F.lit(f"\n\n...\n\n[PREVIEW TRUNCATED: Showing {limit:,} of "), F.format_number(F.length(text), 0), F.lit(" characters]\n[The complete content will be saved when using 'Save Markdown']"))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("Error: Markdown conversion failed to produce content.")).when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), notice)).otherwise(text)


def status(content: Column) -> Column:
    """ok, empty or error: failures that older tools return as content are told apart."""
    return F.when(content.isNull() | (T.strip(content) == ""), "empty").when(content.startswith("Error:") | content.startswith("Error generating markdown:") | (content == "No pages found in document."), "error").otherwise("ok")
