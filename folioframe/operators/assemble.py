"""Assembly of records: text from recognised blocks, combined layouts, Markdown of batches, previews, routes, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import extract, layout, markers, nested, render

RULE = "---"


def block_text(envelopes: DataFrame) -> DataFrame:
    """(env_id, file_idx, text): blocks of each page by relative top and text, each followed by a space; markers from page 2 on.

    Only blocks with text and a polygon count; without a page height the tops are taken as they are.
    """
    height = lambda p: F.coalesce(F.nullif(p["dimension"]["height"], F.lit(0.0)), F.lit(1.0))

    def page(p: Column, i: Column) -> Column:
        live = F.filter(p["blocks"], lambda b: (F.size(b["layout"]["bounding_poly"]["vertices"]) > 0) & b["text"].isNotNull() & (b["text"] != ""))
        top = lambda b: F.coalesce(F.array_min(F.transform(b["layout"]["bounding_poly"]["vertices"], lambda v: v["y"])), F.lit(0.0)) / height(p)
        rows = F.array_sort(F.transform(live, lambda b: F.struct(top(b).alias("top"), b["text"].alias("t"))))
        body = F.array_join(F.transform(rows, lambda r: F.concat(r["t"], F.lit(" "))), "")
        return F.concat(F.when(i > 0, F.concat(F.lit("\n\n----- Page "), (i + 1).cast("string"), F.lit(" -----\n\n"))).otherwise(""), F.coalesce(body, F.lit("")))

    return nested.with_files(envelopes).where("pages is not null").select("env_id", "file_idx", F.array_join(F.transform("pages", page), "").alias("text")).distinct()


def combined_pages(chunks: DataFrame, limit: int = markers.MAX_PAGES) -> DataFrame:
    """Pages of the chunks of a file in one layout: (file, page_number, page) from (file, chunk_idx, pages)."""
    rows = chunks.select("file", "chunk_idx", F.posexplode("pages").alias("i", "page"))
    return rows.select("file", markers.renumbered(F.col("chunk_idx"), F.col("i"), limit).alias("page_number"), "page")


def combined_text(parts: DataFrame) -> DataFrame:
    """(file, text): the texts of a file's chunks in order; a failed chunk leaves a placeholder of its kind."""
    shown = F.when(F.col("status") == "ok", F.coalesce("text", F.lit(""))).otherwise(F.concat(F.lit("[Chunk "), (F.col("chunk_idx") + 1).cast("string"), F.lit(" could not be processed]")))
    return parts.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", shown.alias("s")))).alias("p")).select("file", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("text"))


def _none() -> Column:
    return F.array().cast("array<string>")


def _known(pages: Column) -> Column:
    """The contents of a layout's pages by their numbers, pages without content left out."""
    rows = F.transform(F.coalesce(pages, F.array()), lambda p: F.struct(p["page_number"].alias("n"), extract.page_content(p).alias("content")))
    return F.filter(rows, lambda r: r["n"].isNotNull() & r["content"].isNotNull())


def _content(known: Column, number: Column) -> Column:
    """The content of the last page with that number, null without one."""
    return F.try_element_at(F.filter(known, lambda r: r["n"] == number.try_cast("int")), F.lit(-1))["content"]


def _bodies(text: Column, pattern: str, one) -> Column:  # noqa: ANN001
    """The parts that `one` makes of every match and the text behind it, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.flatten(F.zip_with(found, F.slice(markers.parts(text, pattern), 2, 1_000_000_000), lambda m, g: F.when(m.isNotNull(), one(m, g)).otherwise(_none())))


def page_parts(text: Column, known: Column | None, mark: str) -> Column:
    """Each marked page under a heading, its body from the layout or else the text; text before the first marker is left out."""

    def one(m: Column, g: Column) -> Column:
        n = F.regexp_extract(m, markers.PAGE, 1)
        body = F.nullif(T.strip(g), F.lit(""))
        body = body if known is None else F.coalesce(_content(known, n), body)
        return F.concat(F.array(F.concat(F.lit(f"{mark} Page "), n), F.lit("")), F.when(body.isNotNull(), F.array(body, F.lit(""))).otherwise(_none()))

    return _bodies(text, markers.PAGE, one)


def _chunk_heading(n: Column, a: Column, z: Column) -> Column:
    return F.array(F.concat(F.lit("### Chunk "), n, F.lit(" (Pages "), a, F.lit("-"), z, F.lit(")")), F.lit(""))


def chunk_parts(text: Column, known: Column | None) -> Column:
    """Each marked chunk under a heading, with its pages."""
    g = lambda m, i: F.regexp_extract(m, markers.CHUNK, i)
    return _bodies(text, markers.CHUNK, lambda m, body: F.concat(_chunk_heading(g(m, 1), g(m, 2), g(m, 3)), page_parts(body, known, "####")))


def _page_one(known: Column | None) -> Column:
    if known is None:
        return _none()
    first = _content(known, F.lit("1"))
    return F.when(first.isNotNull(), F.array(F.lit("#### Page 1"), F.lit(""), first, F.lit(""))).otherwise(_none())


def implicit_parts(text: Column, known: Column | None) -> Column:
    """What lies between the first document marker and the first chunk marker, as chunk 1."""
    head, found = F.get(markers.parts(text, markers.DOCUMENT), F.lit(0)), F.get(F.regexp_extract_all(text, F.lit(markers.DOCUMENT), F.lit(0)), F.lit(0))
    end, begin = F.length(head) + F.length(found), F.length(F.get(markers.parts(text, markers.CHUNK), F.lit(0)))
    last = (F.get(F.regexp_extract_all(text, F.lit(markers.CHUNK), F.lit(2)), F.lit(0)).try_cast("int") - 1).cast("string")
    parts = F.concat(_chunk_heading(F.lit("1"), F.lit("1"), last), _page_one(known), page_parts(F.substring(text, end + 1, begin - end), known, "####"))
    return F.when(found.isNotNull() & last.isNotNull() & (end < begin), parts).otherwise(_none())


def leading_parts(text: Column, known: Column) -> Column:
    """What lies before a first chunk marker that is number 2, as chunk 1 of the usual 15 pages."""
    first = F.get(F.regexp_extract_all(text, F.lit(markers.CHUNK), F.lit(1)), F.lit(0))
    parts = F.concat(_chunk_heading(F.lit("1"), F.lit("1"), F.lit(str(markers.MAX_PAGES))), _page_one(known), page_parts(F.get(markers.parts(text, markers.CHUNK), F.lit(0)), known, "####"))
    return F.when(F.coalesce(first == "2", F.lit(False)), parts).otherwise(_none())


def _chunked(text: Column) -> Column:
    return F.coalesce(text.contains("--- Chunk "), F.lit(False))


def _hybrid(text: Column, files: Column) -> Column:
    """Whether a record's text has chunk markers and one of its files a layout."""
    return _chunked(text) & F.coalesce(F.exists(files, lambda f: f["document_data"].isNotNull()), F.lit(False))


def batch_markdown(envelopes: DataFrame) -> DataFrame:
    """(env_id, markdown): every file of a batch under its name and page count, chunked or by pages, closed by a rule.

    In a hybrid record page bodies come from the layouts of the files so far; a leading chunk and one behind a document
    marker can both be written.
    """
    r = envelopes.where("files is not null").select("env_id", F.col("metadata.mode").alias("mode"), _hybrid(F.col("text"), F.col("files")).alias("hybrid"), "files", F.posexplode_outer("files").alias("i", "f"))
    so_far = F.when(F.col("hybrid"), _known(F.flatten(F.transform(F.slice("files", 1, F.col("i") + 1), lambda f: F.coalesce(f["document_data"]["pages"], F.array())))))
    r = r.select("env_id", "mode", "hybrid", "i", F.col("f.metadata.filename").alias("name"), F.col("f.metadata.page_count").alias("n"), so_far.alias("known"), T.nfc(F.col("f.text")).alias("text"))
    text, known = F.col("text"), F.col("known")
    head = F.when(F.col("name").isNotNull(), F.array(F.concat(F.lit("## File: "), "name"), F.concat(F.lit("Total Pages: "), F.coalesce(F.col("n").cast("string"), F.lit("Unknown"))), F.lit(""))).otherwise(F.array(F.concat(F.lit("## File "), (F.col("i") + 1).cast("string")), F.lit("")))
    body = (
        F.when(text.isNull(), _none())
        .when(F.col("hybrid"), F.concat(leading_parts(text, known), implicit_parts(text, known), chunk_parts(text, known)))
        .when(_chunked(text), F.concat(implicit_parts(text, None), chunk_parts(text, None)))
        .otherwise(page_parts(text, None, "###"))
    )
    parts = F.when(F.col("i").isNotNull(), F.array_join(F.concat(head, body, F.array(F.lit(RULE), F.lit(""))), "\n"))
    rows = r.select("env_id", "mode", F.struct("i", parts.alias("s")).alias("p")).groupBy("env_id", "mode").agg(F.array_sort(F.collect_set("p")).alias("p"))
    mode = F.when(F.col("mode").isNotNull(), F.array(F.concat(F.lit("# Document Processing Mode: "), "mode"), F.lit(""))).otherwise(_none())
    return rows.select("env_id", F.array_join(F.concat(mode, F.transform("p", lambda x: x["s"])), "\n").alias("markdown"))


def simple_markdown(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, markdown): a marked text line by line; a document's line comes again before the next document and at the end."""
    rows = markers.line_headings(df, key, text)
    before = F.lag("document").over(Window.partitionBy(key).orderBy("line_no"))
    again = F.when(F.col("markdown").startswith("## --- Document ") & before.isNotNull(), F.array(before, F.lit(""))).otherwise(_none())
    gap = F.when(F.col("markdown").rlike("^(?:## --- Document |### Page \\d+$|#### --- Chunk )"), F.array(F.lit(""))).otherwise(_none())
    parts = rows.withColumn("parts", F.concat(again, F.array("markdown"), gap))
    every = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "parts"))).alias("p"), F.max_by("document", "line_no").alias("document"))
    flat = every.select(key, "document", F.flatten(F.transform("p", lambda x: x["parts"])).alias("parts"))
    last = F.when(F.col("document").isNotNull() & ~F.array_contains("parts", F.col("document")), F.array("document")).otherwise(_none())
    return flat.select(key, F.array_join(F.concat("parts", last), "\n").alias("markdown"))


def chunked_markdown(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, route, markdown) of marked texts: documents with their chunks and pages, chunks alone, or line by line."""
    t = df.select(key, T.nfc(text).alias("text")).where("text is not null")
    c, g = F.col("text"), lambda m, i: F.regexp_extract(m, markers.DOCUMENT, i)
    chunks = F.size(F.regexp_extract_all(c, F.lit(markers.CHUNK), F.lit(0))) > 0
    route = F.when(_chunked(c) & c.rlike(markers.DOCUMENT), "documents").when(_chunked(c) & chunks, "chunks").otherwise("simple")
    t = t.withColumn("route", route)

    def document(m: Column, body: Column) -> Column:
        head = F.array(F.concat(F.lit("## Document "), g(m, 1), F.lit(": "), T.strip(g(m, 2))), F.concat(F.lit("Total Pages: "), g(m, 3)), F.lit(""))
        return F.concat(head, F.when(body.rlike(markers.CHUNK), chunk_parts(body, None)).otherwise(page_parts(body, None, "####")))

    whole = t.where("route <> 'simple'").select(key, "route", F.array_join(F.when(F.col("route") == "documents", _bodies(c, markers.DOCUMENT, document)).otherwise(chunk_parts(c, None)), "\n").alias("markdown"))
    return whole.unionByName(simple_markdown(t.where("route = 'simple'"), key).select(key, F.lit("simple").alias("route"), "markdown"))


def conversion_route(record_text: Column, files: Column, document: Column) -> Column:
    """Which conversion a record takes: hybrid, files, academic, text or none."""
    return F.when(files.isNotNull() & _hybrid(record_text, files), "hybrid").when(files.isNotNull(), "files").when(document.isNotNull(), "academic").when(F.coalesce(record_text, F.lit("")) != "", "text").otherwise("none")


def record_markdown(envelopes: DataFrame) -> DataFrame:
    """(env_id, markdown, status): batches by files, single records by their layout; a record without either has an error's status."""
    single = envelopes.where("files is null")
    academic = render.academic_markdown(single).where("file_idx = 0").select("env_id", "markdown")
    have = batch_markdown(envelopes).unionByName(academic)
    return envelopes.select("env_id").distinct().join(have, "env_id", "left").select("env_id", "markdown", F.coalesce(render.status(F.col("markdown")), F.lit("empty")).alias("status"))


def record_html(envelopes: DataFrame) -> DataFrame:
    """(env_id, html, status): batches through their Markdown, single records as positioned lines; a record that gives neither
    comes out as the simple page of its text, with the status fallback."""
    batch = batch_markdown(envelopes).select("env_id", render.markdown_to_html(F.col("markdown")).alias("made"))
    lines = render.positioned_html(envelopes.where("files is null")).where("file_idx = 0").groupBy("env_id").agg(F.array_sort(F.collect_list(F.struct("page_idx", "html"))).alias("p"))
    pages = lines.select("env_id", F.array_join(F.transform("p", lambda x: x["html"]), "\n").alias("made"))
    head = envelopes.select("env_id", F.col("metadata.filename").alias("filename"), F.col("timestamp").alias("at")).distinct()
    rows = extract.document_text(envelopes).join(head, "env_id").join(batch.unionByName(pages), "env_id", "left")
    return rows.select("env_id", F.coalesce("made", render.text_html(F.col("text"), F.col("filename"), F.col("at"))).alias("html"), F.when(F.col("made").isNull(), "fallback").otherwise("ok").alias("status"))


def previews(envelopes: DataFrame, limit: int = render.PREVIEW) -> DataFrame:
    """All five previews of each record in one row: text, HTML, Markdown in short and in full, JSON; and whether it is cut."""
    cols = [c for c in ("text", "timestamp", "metadata", "document_data", "files") if c in envelopes.columns]
    json = envelopes.select("env_id", F.to_json(F.struct(*cols), {"pretty": "true"}).alias("json_preview")).distinct()
    rows = extract.document_text(envelopes).join(record_html(envelopes), "env_id").join(record_markdown(envelopes).drop("status"), "env_id").join(json, "env_id")
    return rows.select("env_id", "text", "html", render.preview(F.col("markdown"), limit).alias("markdown_preview"), F.col("markdown").alias("full_markdown"), "json_preview", F.coalesce(F.length("markdown") > limit, F.lit(False)).alias("was_truncated"))


def assembled(envelopes: DataFrame) -> DataFrame:
    """Per file: paragraphs joined by blank lines in page order, and its page, paragraph and character counts."""
    p = nested.elements(envelopes).where("elem_level = 'paragraph'").withColumn("t", T.strip(F.col("text"))).where("t <> ''")
    rows = p.groupBy("env_id", "file_idx").agg(F.array_sort(F.collect_list(F.struct("page_idx", "elem_idx", "t"))).alias("r"), F.countDistinct("page_idx").alias("n_pages"))
    text = F.array_join(F.transform("r", lambda x: x["t"]), "\n\n")
    return rows.select("env_id", "file_idx", text.alias("text"), "n_pages", F.size("r").alias("n_paragraphs"), F.length(text).alias("n_chars"))


def zones(width: Column, height: Column, margin: Column | None = None, slack: float = 0.0) -> Column:
    """The body region of a page: measured margins where there are some, else 10 % at the sides and 5 % at top and foot."""
    side = F.coalesce(margin, width * 0.1) if margin is not None else width * 0.1
    return F.struct(F.greatest(F.lit(0.0), side - width * slack).alias("left"), (height * (0.05 - slack)).alias("top"), F.least(width, width - side + width * slack).alias("right"), (height * (0.95 + slack)).alias("bottom"))


def masking(use_cropping: Column) -> Column:
    """How matter outside the body is kept from recognition: crop where the option says so, else mask."""
    return F.when(F.coalesce(use_cropping, F.lit(False)), "crop").otherwise("mask")


def masked(lines: DataFrame, left: Column | float, top: Column | float, right: Column | float, bottom: Column | float) -> DataFrame:
    """Lines with their text blanked outside the body region; positions and ranks stay."""
    inside = F.col("x").between(left, right) & F.col("y").between(top, bottom)
    return lines.withColumn("text", F.when(inside, F.col("text")).otherwise(""))


def value_clusters(values: Column, gap: float) -> Column:
    """Running-mean clusters of sorted values, repeats kept, joined at a distance of at most `gap`: their means."""
    start = F.struct(F.array().cast("array<double>").alias("done"), F.lit(0.0).alias("s"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        joins = (a["n"] > 0) & (F.abs(x - a["s"] / a["n"]) <= gap)
        return F.when(joins, F.struct(a["done"].alias("done"), (a["s"] + x).alias("s"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.when(a["n"] > 0, F.array_append(a["done"], a["s"] / a["n"])).otherwise(a["done"]).alias("done"), x.alias("s"), F.lit(1).alias("n")))

    return F.when(F.size(values) > 0, F.aggregate(F.array_sort(values), start, step, lambda a: F.array_append(a["done"], a["s"] / a["n"]))).otherwise(F.array().cast("array<double>"))


def content_type(lines: DataFrame, key: str) -> DataFrame:
    """poetry for short even lines, prose else, from at least three lines (`genre.lines` rows)."""
    size = F.length(T.strip(F.col("line")))
    g = lines.groupBy(key).agg(F.count("*").alias("n"), F.avg(size).alias("m"), F.stddev_pop(size).alias("d"))
    return g.select(key, F.when((F.col("n") >= 3) & (F.col("m") < 50) & (F.try_divide("d", "m") < 0.3), "poetry").otherwise("prose").alias("content_type"))


def line_clusters(envelopes: DataFrame, gap: float = 50.0) -> DataFrame:
    """Per page the left edges of its lines clustered with repeats."""
    return layout.page_lines(envelopes).where("size(lines) > 0").select(*layout.PAGE, value_clusters(F.transform("lines", lambda r: r["x"]), gap).alias("centres"))
