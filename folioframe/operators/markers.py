"""The page, chunk and document marker protocol: parsing, planning and renumbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MAX_PAGES = 15
# The marker protocol.
PAGE = r"-{5} Page (\d+) -{5}"
CHUNK = r"--- Chunk (\d+) \(Pages (\d+)-(\d+)\) ---"
DOCUMENT = r"---\s+Document\s+(\d+):\s+([^(]+)\s+\((\d+)\s+pages\)\s+---"


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else key


def parts(text: Column, pattern: str) -> Column:
    """The pieces of a text before, between and behind the matches of a pattern."""
    return F.split(text, pattern.replace("(", "(?:").replace("\\(?:", "\\("))


def bodies(df: DataFrame, key: str | list[str], pattern: str, text: str = "text") -> DataFrame:
    """(key, ord, marker, body): every match with the text up to the next one; text before the first belongs to none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = df.select(*_keys(key), F.posexplode(F.zip_with(found, F.slice(parts(F.col(text), pattern), 2, 1_000_000_000), lambda m, g: F.struct(m.alias("marker"), g.alias("body")))).alias("ord", "r"))
    return rows.where("r.marker is not null").select(*_keys(key), "ord", "r.marker", "r.body")


def spans(df: DataFrame, key: str | list[str], pattern: str, text: str = "text") -> DataFrame:
    """(key, ord, marker, begin, stop, body_end): every match with code-point positions; its body ends at the next match."""
    lead = df.select(*_keys(key), F.length(F.get(parts(F.col(text), pattern), F.lit(0))).alias("lead"))
    rows = bodies(df, key, pattern, text).select(*_keys(key), "ord", "marker", F.length("marker").alias("m"), F.length("body").alias("b"))
    order = Window.partitionBy(*_keys(key)).orderBy("ord")
    before = F.coalesce(F.sum(F.col("m") + F.col("b")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = rows.withColumn("before", before).join(lead, key)
    begin = (F.col("lead") + F.col("before")).cast("int")
    return at.select(*_keys(key), "ord", "marker", begin.alias("begin"), (begin + F.col("m")).alias("stop"), (begin + F.col("m") + F.col("b")).alias("body_end"))


def pages(df: DataFrame, key: str | list[str], text: str = "text") -> DataFrame:
    """(key, ord, page_number, body): text before the first page marker belongs to no page."""
    return bodies(df, key, PAGE, text).select(*_keys(key), "ord", F.regexp_extract("marker", PAGE, 1).cast("int").alias("page_number"), T.strip(F.col("body")).alias("body"))


def chunks(df: DataFrame, key: str | list[str], text: str = "text") -> DataFrame:
    g = lambda i: F.regexp_extract("marker", CHUNK, i).cast("int")
    return bodies(df, key, CHUNK, text).select(*_keys(key), "ord", g(1).alias("chunk_no"), g(2).alias("page_from"), g(3).alias("page_to"), F.length("body").alias("n_chars"))


def documents(df: DataFrame, key: str | list[str], text: str = "text") -> DataFrame:
    g = lambda i: F.regexp_extract("marker", DOCUMENT, i)
    return bodies(df, key, DOCUMENT, text).select(*_keys(key), "ord", g(1).cast("int").alias("document_no"), T.strip(g(2)).alias("name"), g(3).cast("int").alias("n_pages"), F.length("body").alias("n_chars"))


def nested_pages(df: DataFrame, key: str | list[str], text: str = "text") -> DataFrame:
    """(key, ord, document_no, chunk_no, page_number): every page marker with the chunk and the document it lies in.

    One pass over all markers in order; the last chunk and document are carried along, a document marker ends a chunk.
    """
    every = "|".join(p.replace("(", "(?:").replace("\\(?:", "\\(") for p in (PAGE, CHUNK, DOCUMENT))
    rows = df.select(*_keys(key), F.posexplode(F.regexp_extract_all(text, F.lit(every), F.lit(0))).alias("ord", "marker"))
    order = Window.partitionBy(*_keys(key)).orderBy("ord")
    number = lambda p: F.nullif(F.regexp_extract("marker", p, 1), F.lit("")).try_cast("int")
    rows = rows.withColumn("d", number(DOCUMENT)).withColumn("c", number(CHUNK)).withColumn("p", number(PAGE))
    rows = rows.withColumn("document_ord", F.last(F.when(F.col("d").isNotNull(), F.col("ord")), ignorenulls=True).over(order)).withColumn("document_no", F.last("d", ignorenulls=True).over(order))
    inside = Window.partitionBy(*_keys(key), "document_ord").orderBy("ord")
    return rows.withColumn("chunk_no", F.last("c", ignorenulls=True).over(inside)).where("p is not null").select(*_keys(key), "ord", "document_no", "chunk_no", F.col("p").alias("page_number"))


def line_headings(df: DataFrame, key: str | list[str], text: str = "text") -> DataFrame:
    """Lines of a marked text as Markdown: headings for markers, blank lines dropped, the current document carried along."""
    lines = df.select(*_keys(key), F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where(T.strip(F.col("line")) != "")
    doc, page = F.col("line").startswith("--- Document "), F.col("line").startswith("----- Page ")
    number = F.regexp_extract("line", PAGE, 1)
    md = F.when(doc, F.concat(F.lit("## "), "line")).when(page, F.when(number != "", F.concat(F.lit("### Page "), number))).when(F.col("line").startswith("--- Chunk "), F.concat(F.lit("#### "), "line")).otherwise(T.nfc(T.strip(F.col("line"))))
    order = Window.partitionBy(*_keys(key)).orderBy("line_no")
    return lines.withColumn("document", F.last(F.when(doc, F.col("line")), ignorenulls=True).over(order)).withColumn("markdown", md).where("markdown is not null").select(*_keys(key), "line_no", "document", "markdown")


def split_plan(n_pages: Column, limit: int = MAX_PAGES) -> Column:
    """Contiguous slices of at most `limit` pages as (slice_no, page_from, page_to), pages counted from 1."""
    count = F.greatest(F.lit(1), F.ceil(n_pages / limit)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("slice_no"), (i * limit + 1).alias("page_from"), F.least((i + 1) * limit, n_pages).alias("page_to")))


def renumbered(chunk_idx: Column, page_idx: Column, limit: int = MAX_PAGES) -> Column:
    """A page's number in the whole from its place in its chunk."""
    return chunk_idx * limit + page_idx + 1


def adjust_markers(text: Column, pages: Column, chunk_idx: int | Column, limit: int = MAX_PAGES) -> Column:
    """A chunk's text with the page markers of the whole: page p becomes base + p, the chunk's own markers lead.

    Markers of pages 2 to `pages` are renumbered, each once, in one pass.
    """
    chunk = F.lit(chunk_idx) if isinstance(chunk_idx, int) else chunk_idx
    base = chunk * limit
    mark = lambda p: F.concat(F.lit("----- Page "), p.cast("string"), F.lit(" -----"))
    head = F.concat(mark(base + 1), F.lit("\n\n--- Chunk "), (chunk + 1).cast("string"), F.lit(" (Pages "), (base + 1).cast("string"), F.lit("-"), (pages + base).cast("string"), F.lit(") ---\n\n"))
    gaps, numbers = parts(text, PAGE), F.regexp_extract_all(text, F.lit(PAGE), F.lit(1))

    def moved(n: Column, gap: Column) -> Column:
        old = n.try_cast("int")
        return F.concat(mark(F.when(~n.startswith("0") & old.between(F.lit(2), pages), (old + base).cast("string")).otherwise(n)), gap)

    body = F.concat(F.get(gaps, F.lit(0)), F.array_join(F.zip_with(numbers, F.slice(gaps, 2, 1_000_000_000), moved), ""))
    return F.when(chunk == 0, text).otherwise(F.concat(head, body))
