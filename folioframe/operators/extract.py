"""Text extracted from nested records: pages, files, anchors and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

NO_TEXT = "No text content found in document."


def block_text(b: Column) -> Column:
    """The first non-blank of a block's own and its layout's text, stripped; null without either."""
    return F.coalesce(F.nullif(T.strip(b["text"]), F.lit("")), F.nullif(T.strip(b["layout"]["text"]), F.lit("")))


def page_parts(p: Column) -> Column:
    """A page's text and its block texts, in this order; both are kept although one may repeat the other."""
    own = F.filter(F.array(F.nullif(T.strip(p["text"]), F.lit(""))), lambda t: t.isNotNull())
    return F.concat(own, F.coalesce(F.filter(F.transform(p["blocks"], block_text), lambda t: t.isNotNull()), F.array()))


def pages_text(pages: Column) -> Column:
    """Pages in order of their number, each under its marker; pages of one number are joined, empty ones left out."""
    rows = F.transform(F.coalesce(pages, F.array()), lambda p, i: F.struct(F.coalesce(p["page_number"], F.lit(1)).alias("n"), i.alias("i"), F.array_join(page_parts(p), "\n\n").alias("t"), F.size(page_parts(p)).alias("k")))
    rows = F.array_sort(F.filter(rows, lambda r: r["k"] > 0))
    before = F.concat(F.array(F.lit(-1)), F.transform(rows, lambda r: r["n"]))  # the number of the page before
    head = lambda r, n: F.concat(F.when(n["i"] > 0, F.lit("\n")).otherwise(""), F.lit("\n\n----- Page "), r["n"].cast("string"), F.lit(" -----\n\n"))
    last = F.transform(F.slice(before, 1, F.greatest(F.size(before) - 1, F.lit(0))), lambda n, i: F.struct(n.alias("n"), i.alias("i")))
    return F.array_join(F.zip_with(rows, last, lambda r, n: F.concat(F.when((n["i"] > 0) & (n["n"] == r["n"]), F.lit("\n\n")).otherwise(head(r, n)), r["t"])), "")


def document_text(envelopes: DataFrame) -> DataFrame:
    """(env_id, text): all files under document markers for a batch, else the pages, else the record's own text."""

    def file_part(f: Column, i: Column) -> Column:
        name = F.coalesce(f["metadata"]["filename"], F.concat(F.lit("File "), (i + 1).cast("string")))
        head = F.concat(F.lit("\n\n--- Document "), (i + 1).cast("string"), F.lit(": "), name, F.lit(" ---\n\n"))
        body = F.when(f["document_data"].isNotNull(), pages_text(f["document_data"]["pages"])).otherwise(F.nullif(f["text"], F.lit("")))
        return F.concat(head, F.coalesce(F.concat(F.lit("\n"), body), F.lit("")))

    batch = F.array_join(F.transform("files", file_part), "\n")
    single = F.coalesce(F.nullif(pages_text(F.col("document_data.pages")), F.lit("")), F.nullif("text", F.lit("")), F.lit(NO_TEXT))
    return envelopes.select("env_id", F.when(F.size("files") > 0, batch).otherwise(single).alias("raw")).distinct().select("env_id", T.nfc("raw").alias("text"))


def layout_text(pages: Column) -> Column:
    """Text rebuilt from a layout: page texts or joined block texts, with a marker by position from the second page on."""
    body = lambda p: F.coalesce(F.nullif(p["text"], F.lit("")), F.array_join(F.filter(F.transform(p["blocks"], lambda b: b["text"]), lambda t: t.isNotNull() & (t != "")), " "), F.lit(""))
    return F.array_join(F.transform(pages, lambda p, i: F.concat(F.when(i > 0, F.concat(F.lit("\n\n----- Page "), (i + 1).cast("string"), F.lit(" -----\n\n"))).otherwise(""), body(p))), "")


def page_content(p: Column) -> Column:
    """A page's content for headings: block texts, or paragraph texts where it has no blocks at all; null without any."""
    texts = lambda arr: F.nullif(F.array_join(F.filter(F.transform(arr, lambda e: e["text"]), lambda t: T.strip(t) != ""), "\n\n"), F.lit(""))
    return F.when(p["blocks"].isNotNull(), texts(p["blocks"])).otherwise(texts(p["paragraphs"]))


def anchored(text: Column, segments: Column, sep: str = "") -> Column:
    """The parts of a text that anchor segments [begin, stop) name, empty and reversed segments left out."""
    live = F.filter(segments, lambda s: s["begin"] < s["stop"])
    return F.array_join(F.transform(live, lambda s: F.substring(text, s["begin"] + 1, s["stop"] - s["begin"])), sep)


def anchored_nfc(text: Column, segments: Column) -> Column:
    """The segments' parts joined by one space, each part and the whole in NFC."""
    live = F.filter(segments, lambda s: s["begin"] < s["stop"])
    return T.nfc(F.array_join(T.nfc_each(F.transform(live, lambda s: F.substring(text, s["begin"] + 1, s["stop"] - s["begin"]))), " "))


def first_segment(text: Column, segments: Column) -> Column:
    """The part that the first anchor segment alone names; null without a segment or for an empty one."""
    s = F.get(segments, F.lit(0))
    return F.nullif(F.when(s["begin"] < s["stop"], F.substring(text, s["begin"] + 1, s["stop"] - s["begin"])), F.lit(""))
