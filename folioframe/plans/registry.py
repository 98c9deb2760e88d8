"""Registered queries of the layout engine, each with its SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assemble, extract, genre, jobs, layout, markers, nested, render, template
from ..runtime import table
from ..streaming import batch as streams
from .training import ELEMENTS, FILES

Query = Callable[[SparkSession, str], DataFrame]
PAGE = layout.PAGE

# --- SQL fragments -------------------------------------------------------------------------------------------------
WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def s_upper(x: str) -> str:
    return f"(upper({x}) = {x} AND lower({x}) <> {x})"


def s_digits(x: str) -> str:
    return rf"regexp_matches({x}, '^\p{{Nd}}+$')"


def s_reference(x: str) -> str:
    return rf"regexp_matches({s_strip(x)}, '^\p{{Nd}}+{WS}+(?:[A-Z][a-z]+|[a-z]+\.){WS}')"


def s_footnote(x: str) -> str:
    return rf"regexp_matches({s_strip(x)}, '^(\p{{Nd}}+|\*){WS}+[^\p{{Nd}}]')"


def s_escape(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


CM = "(2.54::DOUBLE / 96) * 0.5::DOUBLE"
RECORDS = "r AS (SELECT DISTINCT env_id, text, metadata, document_data, files FROM envelopes)"
POSITIONED = f"""{FILES}{ELEMENTS}, l0 AS (
  SELECT DISTINCT env_id, file_idx, page_idx, elem_idx, e.text AS text, e.layout.confidence AS confidence, e.layout.bounding_poly.vertices AS v
  FROM e WHERE elem_level = 'line' AND len(e.layout.bounding_poly.vertices) > 0 AND {s_strip('e.text')} <> ''
), l1 AS (
  SELECT env_id, file_idx, page_idx, elem_idx, nfc_normalize(text) AS text, coalesce(confidence, 0) AS confidence, v, coalesce(v[1].x, 0) AS x, coalesce(v[1].y, 0) AS y FROM l0
), l AS (
  SELECT *, CASE WHEN len(v) > 1 THEN coalesce(v[2].x, x) - x ELSE 0 END AS width, CASE WHEN len(v) > 2 THEN coalesce(v[3].y, y) - y ELSE 0 END AS height,
    CAST(row_number() OVER (PARTITION BY env_id, file_idx, page_idx ORDER BY y, x, elem_idx) - 1 AS INTEGER) AS reading_rank FROM l1
)"""
KEY = "env_id, file_idx, page_idx"
EXTENTS = f"""far AS (
  SELECT {KEY}, max(coalesce(v[-1].x, 0)) AS fx, max(coalesce(v[-1].y, 0)) AS fy FROM l GROUP BY ALL
), ext AS (
  SELECT env_id, file_idx, page_idx, CASE WHEN p.dimension IS NOT NULL THEN CAST(trunc(coalesce(p.dimension.width, 1000)) AS DOUBLE) ELSE coalesce(fx, 1000) END AS width_px,
    CASE WHEN p.dimension IS NOT NULL THEN CAST(trunc(coalesce(p.dimension.height, 1400)) AS DOUBLE) ELSE coalesce(fy, 1400) END AS height_px, (p.dimension IS NOT NULL OR fx IS NOT NULL) AS known
  FROM (SELECT DISTINCT env_id, file_idx, page_idx, p FROM p) LEFT JOIN far USING (env_id, file_idx, page_idx)
)"""
FOOT = f"""g AS (
  SELECT *, greatest(0, max(list_max(list_transform(v, lambda q: coalesce(q.y, 0)))) OVER (PARTITION BY {KEY})) AS page_height,
    coalesce(v[1].y, 0) - lag(coalesce(v[-1].y, 0)) OVER (PARTITION BY {KEY} ORDER BY reading_rank) AS gap FROM l
), fs AS (SELECT {KEY}, min(reading_rank) AS footnote_start FROM g WHERE y > page_height * 0.75 AND gap > 20 AND {s_footnote('text')} GROUP BY ALL)"""
TYPED = f"""{FOOT}, ty AS (
  SELECT l.*, CASE WHEN reading_rank = 0 AND {s_digits(s_strip('text'))} THEN 'page_number' WHEN {s_upper(s_strip('text'))} AND length({s_strip('text')}) > 3 THEN 'header'
    WHEN {s_reference('text')} THEN 'reference' WHEN reading_rank >= footnote_start THEN 'footnote' ELSE 'line' END AS elem_type
  FROM l LEFT JOIN fs USING (env_id, file_idx, page_idx)
)"""
CENTRES = f"""ce AS (
  SELECT {KEY}, list_reduce(list_transform(list_sort(list_distinct(list(x))), lambda q: {{'c': [q], 's': q, 'n': 1}}),
    lambda a, b: CASE WHEN abs(b.s - a.s / a.n) < 50 THEN {{'c': list_append(a.c[1:len(a.c) - 1], (a.s + b.s) / (a.n + 1)), 's': a.s + b.s, 'n': a.n + 1}} ELSE {{'c': list_append(a.c, b.s), 's': b.s, 'n': 1}} END).c AS centres
  FROM l GROUP BY ALL
), ind AS (
  SELECT l.*, CAST(list_position(list_transform(centres, lambda c: abs(x - c)), list_min(list_transform(centres, lambda c: abs(x - c)))) - 1 AS INTEGER) AS indent_level
  FROM l JOIN ce USING (env_id, file_idx, page_idx)
)"""
NUMBERS = rf"""pn AS (
  SELECT {KEY}, arg_min(number, reading_rank) AS page_number FROM (
    SELECT {KEY}, reading_rank, CAST(translate(list_filter(regexp_extract_all({s_strip('text')}, '(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])(\p{{Nd}}+)(?:$|[^\p{{L}}\p{{M}}\p{{N}}_])', 1), lambda q: length(q) <= 2 AND TRY_CAST(translate(q, '０１２３４５６７８９', '0123456789') AS INTEGER) > 0)[1], '０１２３４５６７８９', '0123456789') AS INTEGER) AS number FROM l WHERE reading_rank < 10
  ) WHERE number IS NOT NULL GROUP BY ALL
)"""


def s_spans(pattern: str) -> str:
    """Matches of a pattern in the marked texts, with the text up to the next."""
    plain = pattern.replace("(", "(?:").replace("\\(?:", "\\(")
    return f"""m AS (
  SELECT env_id, file_idx, regexp_extract_all(text, '{pattern}', 0) AS found, string_split_regex(text, '{plain}') AS gaps FROM ({MARKED})
), sp AS (SELECT env_id, file_idx, CAST(i AS INTEGER) AS ord, found[i + 1] AS marker, gaps[i + 2] AS body FROM (SELECT *, unnest(range(len(found))) AS i FROM m))"""


def s_pages_text(pages: str) -> str:
    """Pages in order of number under their markers."""
    parts = f"list_concat(list_filter([nullif({s_strip('p.text')}, '')], lambda t: t IS NOT NULL), coalesce(list_filter(list_transform(p.blocks, lambda b: coalesce(nullif({s_strip('b.text')}, ''), nullif({s_strip('b.layout.text')}, ''))), lambda t: t IS NOT NULL), []))"
    rows = f"list_transform(coalesce({pages}, []), lambda p: {{'n': coalesce(p.page_number, 1), 'parts': {parts}}})"
    of = f"flatten(list_transform(list_filter({rows}, lambda r: r.n = n), lambda r: r.parts))"
    numbers = f"list_sort(list_distinct(list_transform(coalesce({pages}, []), lambda p: coalesce(p.page_number, 1))))"
    return f"array_to_string(list_transform(list_filter({numbers}, lambda n: len({of}) > 0), lambda n: chr(10) || chr(10) || '----- Page ' || n || ' -----' || chr(10) || chr(10) || array_to_string({of}, chr(10) || chr(10))), chr(10))"


NAMED = r"[^(]+"
DOC_LINES = f"SELECT doc_id, i - 1 AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL) WHERE {s_strip('line')} <> ''"


# --- Spark sides ------------------------------------------------------------------------------------------------------
def env(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "envelopes")


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def lines(s: SparkSession, d: str) -> DataFrame:
    return layout.positioned(env(s, d))


def marked(s: SparkSession, d: str) -> DataFrame:
    """The marked texts of records (file_idx 0) and of the entries of batches (1, 2, …)."""
    own = env(s, d).select("env_id", F.lit(0).alias("file_idx"), "text")
    many = env(s, d).select("env_id", F.posexplode("files").alias("i", "f")).select("env_id", (F.col("i") + 1).cast("int").alias("file_idx"), "f.text")
    return own.unionByName(many).where("text is not null").distinct()


MARKED = """SELECT DISTINCT env_id, CAST(0 AS INTEGER) AS file_idx, text FROM envelopes WHERE text IS NOT NULL
  UNION SELECT env_id, CAST(g.i AS INTEGER), g.f.text FROM (SELECT env_id, unnest(list_transform(files, lambda x, i: {'f': x, 'i': i})) AS g FROM envelopes) WHERE g.f.text IS NOT NULL"""
TEXT_KEY = ["env_id", "file_idx"]


def projected(s: SparkSession, d: str) -> DataFrame:
    """Marked texts made of the documents: eight lines a page, two pages a chunk; by the id's rest of 3 with a document marker,
    with chunk markers alone, or with page markers alone."""
    t = docs(s, d).where("text is not null").select("doc_id", F.split("text", "\n").alias("lines"))
    t = t.select("doc_id", "lines", F.ceil(F.size("lines") / 8).cast("int").alias("n"))
    kind = F.pmod("doc_id", F.lit(3))

    def page(p: Column) -> Column:
        chunk = F.concat(F.lit("--- Chunk "), (F.floor(p / 2) + 1).cast("string"), F.lit(" (Pages "), (p + 1).cast("string"), F.lit("-"), F.least(p + 2, F.col("n")).cast("string"), F.lit(") ---\n"))
        return F.concat(F.when((kind < 2) & (p % 2 == 0), chunk).otherwise(""), F.lit("----- Page "), (p + 1).cast("string"), F.lit(" -----\n"), F.array_join(F.slice("lines", p * 8 + 1, F.lit(8)), "\n"))

    head = F.when(kind == 0, F.concat(F.lit("--- Document "), F.col("doc_id").cast("string"), F.lit(": doc.pdf ("), F.col("n").cast("string"), F.lit(" pages) ---\n"))).otherwise("")
    return t.select("doc_id", F.concat(head, F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), page), "\n")).alias("text"))


# the projection's parts, from which results follow without parsing
PROJECTED = """t AS (SELECT doc_id, string_split(text, chr(10)) AS ls, doc_id % 3 AS kind FROM documents WHERE text IS NOT NULL), pj AS (
  SELECT doc_id, kind, n, CAST(unnest(range(n)) AS INTEGER) AS p, ls FROM (SELECT *, CAST(ceil(len(ls) / 8.0) AS INTEGER) AS n FROM t)
), pg AS (SELECT doc_id, kind, n, p, array_to_string(ls[p * 8 + 1:p * 8 + 8], chr(10)) AS body, ls[p * 8 + 1:p * 8 + 8] AS ls FROM pj)"""


def projected_layout(s: SparkSession, d: str) -> DataFrame:
    """Records laid out from the documents: a line's place follows from its number; every eighth line is set apart as a note,
    every first of an even page is a page number, every fourth a reference."""
    t = docs(s, d).where("text is not null").select(F.col("doc_id").alias("env_id"), F.split("text", "\n").alias("ls"))

    def element(p: Column, k: Column) -> Column:
        i = p * 8 + k
        raw, n = F.get("ls", i), (p + 1).cast("string")
        text = F.when((k == 0) & (p % 2 == 0), n).when(k == 3, F.concat(n, F.lit(" Themistius Or. "), raw)).when(k == 7, F.concat(F.lit("* "), raw)).otherwise(raw)
        x, y = (100 + 35 * ((F.col("env_id") + i * 7) % 6)).cast("double"), (60 + 40 * k + F.when(k == 7, 700).otherwise(0)).cast("double")
        far, low = x + 10 * F.least(F.length(raw), F.lit(80)), y + 20
        corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
        poly = F.struct(F.array(corner(x, y), corner(far, y), corner(far, low), corner(x, low)).alias("vertices"))
        return F.struct(text.alias("text"), F.struct(text.alias("text"), (F.pmod(F.col("env_id") * 31 + i * 17, F.lit(100)) / 100.0).cast("double").alias("confidence"), poly.alias("bounding_poly")).alias("layout"))

    def page(p: Column) -> Column:
        lines = F.transform(F.sequence(F.lit(0), F.least(F.lit(8), F.size("ls") - p * 8) - 1), lambda k: element(p, k))
        return F.struct((p + 1).alias("page_number"), lines.alias("lines"))

    rows = t.select("env_id", F.transform(F.sequence(F.lit(0), F.ceil(F.size("ls") / 8).cast("int") - 1), page).alias("pages"))
    none = F.when(F.lit(False), F.transform("pages", lambda p: p["lines"])[0])
    whole = lambda p: F.struct(p["page_number"].alias("page_number"), F.lit(None).cast("struct<width:double,height:double>").alias("dimension"), F.lit(None).cast("string").alias("text"), none.alias("blocks"), none.alias("paragraphs"), p["lines"].alias("lines"), none.alias("tokens"))
    rows = rows.select("env_id", F.struct(F.transform("pages", whole).alias("pages")).alias("document_data"))
    return rows.withColumn("files", F.when(F.lit(False), F.array(F.struct("document_data"))))


PROJECTED_LAYOUT = """jl AS (SELECT doc_id, i - 1 AS i, line AS raw, (i - 1) // 8 AS p, (i - 1) % 8 AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
), je AS (SELECT *, CASE WHEN k = 0 AND p % 2 = 0 THEN CAST(p + 1 AS VARCHAR) WHEN k = 3 THEN p + 1 || ' Themistius Or. ' || raw WHEN k = 7 THEN '* ' || raw ELSE raw END AS t,
  CAST(100 + 35 * ((doc_id + i * 7) % 6) AS DOUBLE) AS x, CAST(60 + 40 * k + CASE WHEN k = 7 THEN 700 ELSE 0 END AS DOUBLE) AS y, ((doc_id * 31 + i * 17) % 100) / 100.0::DOUBLE AS c, CAST(10 * least(length(raw), 80) AS DOUBLE) AS w FROM jl
), jp AS (SELECT doc_id, p, list({'text': t, 'layout': {'text': t, 'confidence': c, 'bounding_poly': {'vertices': [{'x': x, 'y': y}, {'x': x + w, 'y': y}, {'x': x + w, 'y': y + 20}, {'x': x, 'y': y + 20}]}}} ORDER BY k) AS lines FROM je GROUP BY ALL
), jd AS (SELECT doc_id, list({'page_number': CAST(p + 1 AS INTEGER), 'dimension': CASE WHEN false THEN {'width': 1.0::DOUBLE, 'height': 1.0::DOUBLE} END, 'text': NULL::VARCHAR, 'blocks': CASE WHEN false THEN lines END, 'paragraphs': CASE WHEN false THEN lines END, 'lines': lines, 'tokens': CASE WHEN false THEN lines END} ORDER BY p) AS pages FROM jp GROUP BY doc_id
), envelopes AS (SELECT doc_id AS env_id, {'pages': pages} AS document_data, CASE WHEN false THEN [{'document_data': {'pages': pages}}] END AS files FROM jd)"""


def s_projected(sql: str) -> str:
    """A query's SQL over the projected records."""
    return f"WITH {PROJECTED_LAYOUT}, " + sql.removeprefix("WITH ")


def elements_table(s: SparkSession, d: str) -> DataFrame:
    """The positioned elements, rows delivered again once."""
    return table(s, d, "positioned_elements").drop("loaded_at", "recognized_at").distinct()


def line_classes(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(T.strip(F.col("line")) != "").groupBy("doc_id", layout.plain_type(F.col("line")).alias("line_type")).agg(F.count("*").alias("n"))


def page_join(s: SparkSession, d: str) -> DataFrame:
    """Marked pages of records' and files' texts with the content of their layout's page of that number, the marked body without one."""
    paged = nested.with_files(env(s, d)).select(*TEXT_KEY, F.posexplode("pages").alias("i", "p")).where("p.page_number is not null")
    paged = paged.select(*TEXT_KEY, F.col("p.page_number").alias("page_number"), extract.page_content(F.col("p")).alias("content"), "i").where("content is not null")
    content = paged.groupBy(*TEXT_KEY, "page_number").agg(F.max_by("content", "i").alias("content"))
    got = markers.pages(marked(s, d), TEXT_KEY).join(content, [*TEXT_KEY, "page_number"], "left")
    return got.select(*TEXT_KEY, "ord", "page_number", F.coalesce("content", F.nullif("body", F.lit(""))).alias("body"), F.col("content").isNotNull().alias("from_layout"))


def split_plan(s: SparkSession, d: str) -> DataFrame:
    n = env(s, d).select("env_id", F.col("metadata.page_count").alias("n")).where("n > 0").distinct()
    return n.select("env_id", "n", F.explode(markers.split_plan(F.col("n"))).alias("x")).select("env_id", "n", "x.*")


def split_totals(s: SparkSession, d: str) -> DataFrame:
    """Requests per job: one per slice of 15 pages, one where the page count is unknown."""
    e = env(s, d).select("env_id", "job_id", F.col("metadata.page_count").alias("n")).distinct()
    return e.groupBy("job_id").agg(F.sum(F.coalesce(F.greatest(F.lit(1), F.ceil(F.col("n") / markers.MAX_PAGES)), F.lit(1))).cast("long").alias("n_requests"), F.count("*").alias("n_files"))


def page_renumber(s: SparkSession, d: str) -> DataFrame:
    p = nested.pages(env(s, d)).select(*PAGE)
    chunk, within = F.floor(F.col("page_idx") / markers.MAX_PAGES).cast("int"), F.col("page_idx") % markers.MAX_PAGES
    return p.select(*PAGE, chunk.alias("chunk_idx"), markers.renumbered(chunk, within).cast("int").alias("new_number"))


def confidence_summary(s: SparkSession, d: str) -> DataFrame:
    e = nested.elements(env(s, d)).where("elem_level = 'block'")
    per = e.groupBy("env_id", "file_idx").agg(F.avg(F.nullif("confidence", F.lit(0.0))).alias("avg_confidence"), F.array_sort(F.collect_set(F.when(F.col("confidence") == 0, F.col("page_idx")))).alias("p"))
    return per.select("env_id", "file_idx", "avg_confidence", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("pages_with_errors"))


def token_heights(s: SparkSession, d: str) -> DataFrame:
    """Font size per page: the upper median of its tokens' heights, 12 without tokens."""
    v = lambda i: F.try_element_at("vertices", F.lit(i))["y"]
    t = nested.elements(env(s, d)).where("elem_level = 'token'").withColumn("h", v(3) - v(1)).where("h > 0").groupBy(*PAGE).agg(F.array_sort(F.collect_list("h")).alias("hs"))
    return nested.pages(env(s, d)).select(*PAGE).join(t, PAGE, "left").select(*PAGE, F.coalesce(F.get("hs", F.floor(F.size("hs") / 2).cast("int")), F.lit(12.0)).alias("font_size"))


def sized_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines with the extents of their page."""
    return layout.page_lines(env(s, d)).select(*PAGE, *layout.extents(), F.explode("lines").alias("r")).select(*PAGE, "width_px", "height_px", "r.elem_idx", "r.x", "r.y", "r.width")


def indent_hint(s: SparkSession, d: str) -> DataFrame:
    left = F.array_min(F.transform("lines", lambda r: r["x"]))
    x = layout.page_lines(env(s, d)).select(*PAGE, layout.extents()[0], left.alias("left"), F.explode("lines").alias("r"))
    share = (F.col("r.x") - F.col("left")) / F.col("width_px")
    return x.select(*PAGE, "r.elem_idx", F.when(F.col("width_px") <= 0, 0).when(share < 0.02, 0).when(share < 0.06, 1).otherwise(2).alias("hint"))


def to_pdf(s: SparkSession, d: str) -> DataFrame:
    """Lines in points with the origin at the lower left, for a page drawn at 72 points per inch from 96."""
    k = 0.75
    return sized_lines(s, d).select(*PAGE, "elem_idx", (F.col("x") * k).alias("pdf_x"), (F.col("height_px") * k - F.col("y") * k).alias("pdf_y"))


def element_profile(s: SparkSession, d: str) -> DataFrame:
    """Lines per strip of 50 pixels over all pages of an edition: a projection profile."""
    e = elements_table(s, d).where("elem_type = 'line' and y_position is not null and edition_id is not null")
    return e.groupBy("edition_id", F.floor(F.col("y_position") / 50).cast("int").alias("strip")).agg(F.count("*").cast("double").alias("ink"))


PROFILE = "SELECT edition_id, CAST(floor(y_position / 50) AS INTEGER) AS strip, CAST(count(*) AS DOUBLE) AS ink FROM (SELECT DISTINCT element_id, edition_id, y_position, elem_type, job_id, page_number, elem_idx, text, confidence, bounding_poly, x_position, width, height, indent_level FROM positioned_elements) WHERE elem_type = 'line' AND y_position IS NOT NULL AND edition_id IS NOT NULL GROUP BY ALL"


def template_confidence(s: SparkSession, d: str) -> DataFrame:
    left = F.avg((F.col("body_left") / F.col("width_px") > 0.08).cast("double")) > 0.5
    got = template.consistency(zones_measured(s, d), ["env_id", "file_idx"], ZONES, left.alias("left_margin"))
    return got.select("env_id", "file_idx", F.round("confidence", 9).alias("confidence"), "left_margin")


def anchors(s: SparkSession, d: str) -> DataFrame:
    """Each document's lines as the anchor segments of its text, joined without and with a space, and the first alone."""
    ends = F.transform(F.split("text", "\n"), F.length)
    t = docs(s, d).where("text is not null").select("doc_id", "text", ends.alias("n"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,stop:int>>").alias("segs"))
    segs = F.aggregate("n", start, lambda a, n: F.struct((a["at"] + n + 1).alias("at"), F.array_append(a["segs"], F.struct(a["at"].alias("begin"), (a["at"] + n).alias("stop"))).alias("segs")), lambda a: a["segs"])
    t = t.select("doc_id", "text", segs.alias("segs"))
    return t.select("doc_id", extract.anchored(F.col("text"), F.col("segs")).alias("joined"), extract.anchored_nfc(F.col("text"), F.col("segs")).alias("spaced"), extract.first_segment(F.col("text"), F.col("segs")).alias("first_segment"))


def adjusted(s: SparkSession, d: str) -> DataFrame:
    """The texts of a batch's entries as consecutive chunks with the page numbers of the whole."""
    rows = env(s, d).select("env_id", F.posexplode("files").alias("chunk", "f")).where("f.text is not null").select("env_id", "chunk", "f.text", F.greatest(F.coalesce("f.metadata.page_count", F.lit(0)), F.lit(0)).alias("n")).distinct()
    return rows.select("env_id", "chunk", markers.adjust_markers(F.col("text"), F.col("n"), F.col("chunk")).alias("text"))


ZONES = ["width_px", "height_px", "body_left", "body_right", "body_top"]


def zones_measured(s: SparkSession, d: str) -> DataFrame:
    side = lambda f, of: f(F.transform("lines", of))
    return layout.page_lines(env(s, d)).where("size(lines) > 0").select(*PAGE, *layout.extents()[:2], side(F.array_min, lambda r: r["x"]).alias("body_left"), side(F.array_max, lambda r: r["x"] + r["width"]).alias("body_right"), side(F.array_min, lambda r: r["y"]).alias("body_top"))


def templates(s: SparkSession, d: str) -> DataFrame:
    return template.extract_template(zones_measured(s, d), ["env_id", "file_idx"], ZONES, ZONES).drop("confidence")


def template_keys(s: SparkSession, d: str) -> DataFrame:
    f = nested.with_files(env(s, d)).where("pages is not null")
    return f.select("env_id", "file_idx", template.cache_key(F.transform("pages", lambda p: p["dimension"]), F.size("pages")).alias("cache_key")).distinct()


def event_windows(s: SparkSession, d: str) -> DataFrame:
    return streams.windowed(table(s, d, "events")).groupBy("window_start", "event_type").agg(F.sum("n").alias("n"))


def build() -> dict[str, tuple[Query, str | None]]:
    q: dict[str, tuple[Query, str | None]] = {}
    r = lambda c, k=6: F.round(c, k)
    q["line_classes"] = (line_classes, f"SELECT doc_id, CASE WHEN {s_upper(s_strip('line'))} AND length(line) > 3 THEN 'header' WHEN {s_digits(s_strip('line'))} AND length(line) <= 2 THEN 'page_number' ELSE 'line' END AS line_type, count(*) AS n FROM ({DOC_LINES}) GROUP BY ALL")
    q["reading_order"] = (lambda s, d: lines(s, d).select(*PAGE, "elem_idx", "reading_rank", "x", "y", "width", "height", "confidence", "text"), f"WITH {POSITIONED} SELECT {KEY}, elem_idx, reading_rank, x, y, width, height, confidence, text FROM l")
    q["page_dimensions"] = (lambda s, d: layout.page_extents(env(s, d)).select(*PAGE, "width_px", "height_px", r("width_cm").alias("width_cm"), r("height_cm").alias("height_cm")), f"WITH {POSITIONED}, {EXTENTS} SELECT {KEY}, width_px, height_px, round(width_px * {CM}, 6) AS width_cm, round(height_px * {CM}, 6) AS height_cm FROM ext")
    q["page_dimensions_a4"] = (lambda s, d: layout.page_extents(env(s, d), default_cm=(21.0, 29.7)).select(*PAGE, r("width_cm").alias("width_cm"), r("height_cm").alias("height_cm")), f"WITH {POSITIONED}, {EXTENTS} SELECT {KEY}, CASE WHEN known THEN round(width_px * {CM}, 6) ELSE 21.0 END AS width_cm, CASE WHEN known THEN round(height_px * {CM}, 6) ELSE 29.7 END AS height_cm FROM ext")
    q["y_bands"] = (lambda s, d: layout.bands(lines(s, d)).select(*PAGE, "elem_idx", "band", "band_rank"), f"WITH {POSITIONED}, b AS (SELECT *, CAST(round_even(y / 5, 0) * 5 AS INTEGER) AS band FROM l) SELECT {KEY}, elem_idx, band, CAST(row_number() OVER (PARTITION BY {KEY} ORDER BY band, x, reading_rank) - 1 AS INTEGER) AS band_rank FROM b")
    q["element_types"] = (lambda s, d: layout.classified(lines(s, d)).select(*PAGE, "elem_idx", "elem_type"), f"WITH {POSITIONED}, {TYPED} SELECT {KEY}, elem_idx, elem_type FROM ty")
    q["footnote_sections"] = (lambda s, d: layout.footnote_starts(lines(s, d)), f"WITH {POSITIONED}, {FOOT} SELECT * FROM fs")
    q["references_detected"] = (lambda s, d: elements_table(s, d).where("text is not null").groupBy("edition_id").agg(F.count_if(T.is_reference(F.col("text"))).alias("n_references"), F.count_if(T.is_footnote_marker(F.col("text"))).alias("n_markers"), F.count_if(T.is_upper(T.strip(F.col("text")))).alias("n_upper")), f"SELECT edition_id, count_if({s_reference('text')}) AS n_references, count_if({s_footnote('text')}) AS n_markers, count_if({s_upper(s_strip('text'))}) AS n_upper FROM (SELECT DISTINCT * EXCLUDE (loaded_at, recognized_at) FROM positioned_elements) WHERE text IS NOT NULL GROUP BY ALL")
    q["page_numbers_detected"] = (lambda s, d: layout.detected_page_numbers(lines(s, d)).where("page_number is not null"), f"WITH {POSITIONED}, {NUMBERS} SELECT * FROM pn")
    q["indent_levels"] = (lambda s, d: layout.indented(lines(s, d)).select(*PAGE, "elem_idx", "indent_level"), f"WITH {POSITIONED}, {CENTRES} SELECT {KEY}, elem_idx, indent_level FROM ind")
    q["bounding_boxes"] = (lambda s, d: elements_table(s, d).select("element_id", layout.bounding_box(F.col("bounding_poly.vertices")).alias("b")).select("element_id", "b.*").distinct(), """SELECT DISTINCT element_id, CAST(trunc(coalesce(list_min(list_filter(list_transform(v, lambda q: q.x), lambda c: c IS NOT NULL)), 0)) AS INTEGER) AS "left", CAST(trunc(coalesce(list_min(list_filter(list_transform(v, lambda q: q.y), lambda c: c IS NOT NULL)), 0)) AS INTEGER) AS top,
  CAST(trunc(coalesce(list_max(list_filter(list_transform(v, lambda q: q.x), lambda c: c IS NOT NULL)), 0)) AS INTEGER) AS "right", CAST(trunc(coalesce(list_max(list_filter(list_transform(v, lambda q: q.y), lambda c: c IS NOT NULL)), 0)) AS INTEGER) AS bottom FROM (SELECT element_id, bounding_poly.vertices AS v FROM positioned_elements)""")
    q["body_region"] = (lambda s, d: layout.cropped(lines(s, d), 100, 100, 900, 1300).select(*PAGE, "elem_idx", "x", "y"), f"WITH {POSITIONED} SELECT {KEY}, elem_idx, x - 100 AS x, y - 100 AS y FROM l WHERE x BETWEEN 100 AND 900 AND y BETWEEN 100 AND 1300")
    q["element_level_priority"] = (lambda s, d: layout.finest_level(nested.elements(env(s, d))).groupBy(*PAGE, "elem_level").agg(F.count("*").alias("n")), f"WITH {FILES}{ELEMENTS}, u AS (SELECT DISTINCT {KEY}, elem_level, elem_idx, e FROM e), k AS (SELECT *, CASE elem_level WHEN 'token' THEN 0 WHEN 'line' THEN 1 WHEN 'paragraph' THEN 2 ELSE 3 END AS lr FROM u) SELECT {KEY}, elem_level, count(*) AS n FROM (SELECT *, min(lr) OVER (PARTITION BY {KEY}) AS best FROM k) WHERE lr = best GROUP BY ALL")
    q["margin_notes_beside"] = (lambda s, d: layout.beside(lines(s, d).where("x < 130"), lines(s, d).where("x >= 130"), 40.0), f"WITH {POSITIONED}, a AS (SELECT * FROM l WHERE x < 130), b AS (SELECT * FROM l WHERE x >= 130) SELECT a.env_id, a.file_idx, a.page_idx, a.elem_idx AS left_idx, arg_min(b.elem_idx, {{'d': abs(a.y - b.y), 'y': b.y, 'i': b.elem_idx}}) AS right_idx, min(abs(a.y - b.y)) AS distance FROM a JOIN b USING (env_id, file_idx, page_idx) WHERE abs(a.y - b.y) <= 40 GROUP BY ALL")
    q["marker_pages"] = (lambda s, d: markers.pages(marked(s, d), TEXT_KEY), f"WITH {s_spans(markers.PAGE)} SELECT env_id, file_idx, ord, CAST(regexp_extract(marker, '{markers.PAGE}', 1) AS INTEGER) AS page_number, {s_strip('body')} AS body FROM sp")
    q["marker_chunks"] = (lambda s, d: markers.chunks(projected(s, d), "doc_id"), f"""WITH {PROJECTED}, c AS (SELECT doc_id, n, p // 2 AS c, sum(length('----- Page ' || p + 1 || ' -----' || chr(10) || body)) + count(*) + max(CASE WHEN p // 2 = (n - 1) // 2 THEN 0 ELSE 1 END) AS k FROM pg WHERE kind < 2 GROUP BY doc_id, n, p // 2)
SELECT doc_id, CAST(c AS INTEGER) AS ord, CAST(c + 1 AS INTEGER) AS chunk_no, CAST(2 * c + 1 AS INTEGER) AS page_from, CAST(least(2 * c + 2, n) AS INTEGER) AS page_to, CAST(k AS INTEGER) AS n_chars FROM c""")
    q["marker_documents"] = (lambda s, d: markers.documents(marked(s, d), TEXT_KEY), f"WITH {s_spans(markers.DOCUMENT)} SELECT env_id, file_idx, ord, CAST(regexp_extract(marker, '{markers.DOCUMENT}', 1) AS INTEGER) AS document_no, {s_strip(f"regexp_extract(marker, '{markers.DOCUMENT}', 2)")} AS name, CAST(regexp_extract(marker, '{markers.DOCUMENT}', 3) AS INTEGER) AS n_pages, CAST(length(body) AS INTEGER) AS n_chars FROM sp")
    q["marker_nesting"] = (lambda s, d: markers.nested_pages(projected(s, d), "doc_id"), f"WITH {PROJECTED} SELECT doc_id, CAST(p + CASE WHEN kind < 2 THEN p // 2 + 1 ELSE 0 END + CASE WHEN kind = 0 THEN 1 ELSE 0 END AS INTEGER) AS ord, CASE WHEN kind = 0 THEN CAST(doc_id AS DOUBLE) END AS document_no, CASE WHEN kind < 2 THEN CAST(p // 2 + 1 AS DOUBLE) END AS chunk_no, p + 1 AS page_number FROM pg")
    page_md = f"list_concat(['#### Page ' || p + 1, ''], CASE WHEN {s_strip('nfc_normalize(body)')} <> '' THEN [{s_strip('nfc_normalize(body)')}, ''] ELSE [] END)"
    plain_md = f"list_concat(['### Page ' || p + 1, ''], list_filter(list_transform(ls, lambda q: {s_strip('nfc_normalize(q)')}), lambda q: q <> ''))"
    q["chunked_markdown"] = (lambda s, d: assemble.chunked_markdown(projected(s, d), "doc_id"), f"""WITH {PROJECTED}, b AS (
  SELECT doc_id, kind, n, p, CASE WHEN kind = 2 THEN {plain_md} ELSE list_concat(CASE WHEN p % 2 = 0 THEN ['### Chunk ' || p // 2 + 1 || ' (Pages ' || p + 1 || '-' || least(p + 2, n) || ')', ''] ELSE [] END, {page_md}) END AS parts FROM pg
) SELECT doc_id, CASE kind WHEN 0 THEN 'documents' WHEN 1 THEN 'chunks' ELSE 'simple' END AS route, array_to_string(list_concat(CASE WHEN kind = 0 THEN ['## Document ' || doc_id || ': doc.pdf', 'Total Pages: ' || n, ''] ELSE [] END, flatten(list(parts ORDER BY p))), chr(10)) AS markdown FROM b GROUP BY doc_id, kind, n""")
    full = s_strip("t") + " <> ''"
    content = f"nullif(CASE WHEN p.blocks IS NOT NULL THEN array_to_string(list_filter(list_transform(p.blocks, lambda b: b.text), lambda t: {full}), chr(10) || chr(10)) ELSE array_to_string(list_filter(list_transform(p.paragraphs, lambda b: b.text), lambda t: {full}), chr(10) || chr(10)) END, '')"
    q["page_content_join"] = (page_join, f"""WITH {FILES}, {s_spans(markers.PAGE)}, c AS (
  SELECT env_id, file_idx, page_number, arg_max(content, page_idx) AS content FROM (SELECT env_id, file_idx, page_idx, p.page_number AS page_number, {content} AS content FROM p) WHERE page_number IS NOT NULL AND content IS NOT NULL GROUP BY ALL
), b AS (SELECT env_id, file_idx, ord, CAST(regexp_extract(marker, '{markers.PAGE}', 1) AS INTEGER) AS page_number, {s_strip('body')} AS body FROM sp)
SELECT env_id, file_idx, ord, page_number, coalesce(content, nullif(body, '')) AS body, content IS NOT NULL AS from_layout FROM b LEFT JOIN c USING (env_id, file_idx, page_number)""")
    q["simple_lines_markdown"] = (lambda s, d: markers.line_headings(marked(s, d), TEXT_KEY), f"""WITH x AS (SELECT env_id, file_idx, CAST(i - 1 AS INTEGER) AS line_no, line FROM (SELECT env_id, file_idx, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM ({MARKED})) WHERE {s_strip('line')} <> '')
SELECT env_id, file_idx, line_no, document, markdown FROM (SELECT env_id, file_idx, line_no, last_value(CASE WHEN starts_with(line, '--- Document ') THEN line END IGNORE NULLS) OVER (PARTITION BY env_id, file_idx ORDER BY line_no) AS document,
  CASE WHEN starts_with(line, '--- Document ') THEN '## ' || line WHEN starts_with(line, '----- Page ') THEN CASE WHEN regexp_extract(line, '{markers.PAGE}', 1) <> '' THEN '### Page ' || regexp_extract(line, '{markers.PAGE}', 1) END WHEN starts_with(line, '--- Chunk ') THEN '#### ' || line ELSE nfc_normalize({s_strip('line')}) END AS markdown FROM x) WHERE markdown IS NOT NULL""")
    q["page_text_join"] = (lambda s, d: nested.with_files(env(s, d)).select("env_id", "file_idx", extract.layout_text(F.col("pages")).alias("text")).where("text is not null").distinct(), f"WITH {FILES} SELECT DISTINCT env_id, file_idx, array_to_string(list_transform(pages, lambda q, i: (CASE WHEN i > 1 THEN chr(10) || chr(10) || '----- Page ' || i || ' -----' || chr(10) || chr(10) ELSE '' END) || coalesce(nullif(q.text, ''), array_to_string(list_filter(list_transform(q.blocks, lambda b: b.text), lambda t: t IS NOT NULL AND t <> ''), ' '), '')), '') AS text FROM f WHERE pages IS NOT NULL")
    batch = f"array_to_string(list_transform(files, lambda f, i: chr(10) || chr(10) || '--- Document ' || i || ': ' || coalesce(f.metadata.filename, 'File ' || i) || ' ---' || chr(10) || chr(10) || coalesce(chr(10) || (CASE WHEN f.document_data IS NOT NULL THEN {s_pages_text('f.document_data.pages')} ELSE nullif(f.text, '') END), '')), chr(10))"
    q["document_text"] = (lambda s, d: extract.document_text(env(s, d)), f"WITH {RECORDS} SELECT DISTINCT env_id, nfc_normalize(CASE WHEN len(files) > 0 THEN {batch} ELSE coalesce(nullif({s_pages_text('document_data.pages')}, ''), nullif(text, ''), '{extract.NO_TEXT}') END) AS text FROM r")
    q["nfc_normalized"] = (lambda s, d: docs(s, d).select("doc_id", T.nfc("text").alias("text")), "SELECT doc_id, nfc_normalize(text) AS text FROM documents")
    q["normalised_lines"] = (lambda s, d: docs(s, d).where("text is not null").select("doc_id", T.squeeze_lines(T.nfc("text")).alias("text")), f"SELECT doc_id, {s_strip('array_to_string(list_transform(string_split(nfc_normalize(text), chr(10)), lambda q: ' + s_strip(f"regexp_replace(q, '{WS}+', ' ', 'g')") + '), chr(10))')} AS text FROM documents WHERE text IS NOT NULL")
    q["html_escaped"] = (lambda s, d: docs(s, d).select("doc_id", T.html_escape(F.col("text")).alias("simple"), T.html_escape_quotes(F.col("text")).alias("full")), f"""SELECT doc_id, {s_escape('text')} AS simple, replace(replace({s_escape('text')}, '"', '&quot;'), '''', '&#x27;') AS "full" FROM documents""")
    q["text_html"] = (lambda s, d: env(s, d).select("env_id", render.text_html(F.coalesce("text", F.lit("")), F.col("metadata.filename"), F.col("timestamp")).alias("html")).distinct(), f"""SELECT DISTINCT env_id, '<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head>' || chr(10) || '    <meta charset="UTF-8">' || chr(10) || '    <title>Document Text' || CASE WHEN coalesce(metadata.filename, '') <> '' THEN ' - ' || {s_escape('metadata.filename')} ELSE '' END || '</title>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || '    <h1>Document Text</h1>' || chr(10) || '    ' ||
  CASE WHEN coalesce(metadata.filename, '') <> '' OR coalesce("timestamp", '') <> '' THEN '<div class="metadata">' || concat_ws(' | ', CASE WHEN coalesce(metadata.filename, '') <> '' THEN 'Source: ' || {s_escape('metadata.filename')} END, CASE WHEN coalesce("timestamp", '') <> '' THEN 'Processed: ' || {s_escape('"timestamp"')} END) || '</div>' ELSE '' END || chr(10) || '    <pre>' || {s_escape("coalesce(text, '')")} || '</pre>' || chr(10) || '</body>' || chr(10) || '</html>' AS html FROM envelopes""")
    head = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in render.HEAD.split("\n")) + "]"
    md = "'# ' || replace(text, '----- Page', '## Page')"
    q["markdown_to_html"] = (lambda s, d: marked(s, d).where("file_idx = 0").select("env_id", render.markdown_to_html(F.concat(F.lit("# "), F.replace("text", F.lit("----- Page"), F.lit("## Page")))).alias("html")), f"SELECT DISTINCT env_id, array_to_string(list_concat(list_concat({head}, list_filter(list_transform(string_split({md}, chr(10)), lambda q: CASE WHEN starts_with(q, '# ') THEN '<h1>' || q[3:] || '</h1>' WHEN starts_with(q, '## ') THEN '<h2>' || q[4:] || '</h2>' WHEN starts_with(q, '### ') THEN '<h3>' || q[5:] || '</h3>' WHEN starts_with(q, '#### ') THEN '<h4>' || q[6:] || '</h4>' WHEN starts_with(q, '---') THEN '<hr>' WHEN {s_strip('q')} <> '' THEN '<p>' || q || '</p>' END), lambda q: q IS NOT NULL)), ['</body></html>']), chr(10)) AS html FROM envelopes WHERE text IS NOT NULL")
    q["preview_truncate"] = (lambda s, d: docs(s, d).select("doc_id", render.preview(F.col("text"), 5000).alias("preview"), (F.length("text") > 5000).alias("was_truncated")), r"SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'Error: Markdown conversion failed to produce content.' WHEN length(text) > 5000 THEN left(text, 5000) || chr(10) || chr(10) || '...' || chr(10) || chr(10) || '[PREVIEW TRUNCATED: Showing 5,000 of ' || regexp_replace(CAST(length(text) AS VARCHAR), '^(\d+)(\d{3})$', '\1,\2') || ' characters]' || chr(10) || '[The complete content will be saved when using ''Save Markdown'']' ELSE text END AS preview, length(text) > 5000 AS was_truncated FROM documents")
    q["academic_markdown"] = (lambda s, d: render.academic_markdown(env(s, d)), f"""WITH {POSITIONED}, {EXTENTS}, {TYPED}, {CENTRES}, {NUMBERS}, z AS (
  SELECT {KEY}, elem_type, band, CAST(row_number() OVER (PARTITION BY {KEY} ORDER BY band, x, reading_rank) AS INTEGER) AS br,
    CASE elem_type WHEN 'page_number' THEN repeat(' ', 2 * indent_level) || '**' || {s_strip('text')} || '**' WHEN 'header' THEN chr(10) || '## ' || {s_strip('text')} || chr(10) WHEN 'reference' THEN repeat(' ', 2 * indent_level) || '> ' || {s_strip('text')} WHEN 'footnote' THEN '   ' || {s_strip('text')} ELSE repeat(' ', 2 * indent_level) || {s_strip('text')} END AS s
  FROM (SELECT ty.*, ind.indent_level, CAST(round_even(ty.y / 5, 0) * 5 AS INTEGER) AS band FROM ty JOIN ind USING (env_id, file_idx, page_idx, elem_idx, reading_rank))
), w AS (SELECT {KEY}, band, coalesce(list(s ORDER BY br) FILTER (WHERE elem_type <> 'footnote'), []) AS main, list(s ORDER BY br) FILTER (WHERE elem_type = 'footnote') AS notes FROM z GROUP BY ALL
), pg AS (SELECT {KEY}, array_to_string(flatten(list(list_append(main, '') ORDER BY band)), chr(10)) AS main, flatten(coalesce(list(notes ORDER BY band) FILTER (WHERE notes IS NOT NULL), [])) AS notes FROM w GROUP BY ALL
), md AS (SELECT env_id, file_idx, page_idx, concat_ws(chr(10), '# Page ' || coalesce(nullif(page_number, 0), page_idx + 1) || chr(10), printf('<!-- Page dimensions: %.2fcm x %.2fcm -->' || chr(10), floor((width_px * 254 + 96) / 192) / 100, floor((height_px * 254 + 96) / 192) / 100), coalesce(main, ''), CASE WHEN len(notes) > 0 THEN chr(10) || '---' || chr(10) || chr(10) || '*Footnotes:*' || chr(10) || chr(10) || array_to_string(notes, chr(10)) END, chr(10) || chr(10) || '---' || chr(10)) AS markdown
  FROM ext LEFT JOIN pg USING (env_id, file_idx, page_idx) LEFT JOIN pn USING (env_id, file_idx, page_idx))
SELECT env_id, file_idx, string_agg(markdown, chr(10) ORDER BY page_idx) AS markdown FROM md GROUP BY ALL""")
    shown = f"CASE WHEN {s_upper(s_strip('q'))} AND length(q) > 3 THEN chr(10) || '## ' || {s_strip('q')} || chr(10) WHEN {s_digits(s_strip('q'))} AND length(q) <= 2 THEN '**' || {s_strip('q')} || '**' ELSE {s_strip('q')} END"
    q["plain_markdown"] = (lambda s, d: nested.with_files(env(s, d)).select("env_id", "file_idx", F.posexplode("pages").alias("page_idx", "p")).select(*PAGE, render.plain_markdown(F.transform("p.lines", lambda e: e["text"])).alias("markdown")).where("markdown <> ''").distinct(), f"WITH {FILES} SELECT DISTINCT * FROM (SELECT {KEY}, array_to_string(list_transform(list_filter(list_transform(p.lines, lambda e: e.text), lambda q: q IS NOT NULL AND {s_strip('q')} <> ''), lambda q: {shown}), chr(10)) AS markdown FROM p) WHERE markdown <> ''")
    esc = f"""replace(replace({s_escape(s_strip('text'))}, '"', '&quot;'), '''', '&#x27;')"""
    q["positioned_html"] = (lambda s, d: render.positioned_html(env(s, d)), f"""WITH {POSITIONED} SELECT {KEY}, string_agg(printf('<div style="position:absolute;left:%.2fcm;top:%.2fcm">', floor((x * 254 + 96) / 192) / 100, floor((y * 254 + 96) / 192) / 100) || {esc} || '</div>', chr(10) ORDER BY reading_rank) AS html FROM l GROUP BY ALL""")
    q["format_route"] = (lambda s, d: table(s, d, "raw_exports").select("file_id", jobs.route(F.col("payload")).alias("route")).distinct(), "SELECT DISTINCT file_id, CASE WHEN NOT json_valid(payload) OR payload IS NULL THEN NULL WHEN json_exists(payload, '$.files') THEN 'alternative' WHEN json_exists(payload, '$.document_data') THEN 'standard' ELSE 'unknown' END AS route FROM raw_exports")
    q["structure_flags"] = (lambda s, d: env(s, d).select("env_id", F.col("text").contains("--- Chunk ").alias("chunked"), (F.col("text").contains("--- Chunk ") & F.coalesce(F.exists("files", lambda f: f["document_data"].isNotNull()), F.lit(False))).alias("hybrid"), F.coalesce(F.size("document_data.pages"), F.lit(0)).alias("n_pages"), F.col("files").isNotNull().alias("has_files")).distinct(), "SELECT DISTINCT env_id, contains(text, '--- Chunk ') AS chunked, contains(text, '--- Chunk ') AND coalesce(len(list_filter(files, lambda f: f.document_data IS NOT NULL)) > 0, false) AS hybrid, CAST(coalesce(len(document_data.pages), 0) AS INTEGER) AS n_pages, files IS NOT NULL AS has_files FROM envelopes")
    q["page_split_plan"] = (split_plan, "WITH e AS (SELECT DISTINCT env_id, metadata.page_count AS n FROM envelopes WHERE metadata.page_count > 0) SELECT env_id, n, CAST(i AS INTEGER) AS slice_no, CAST(i * 15 + 1 AS INTEGER) AS page_from, CAST(least((i + 1) * 15, n) AS INTEGER) AS page_to FROM (SELECT env_id, n, unnest(range(CAST(ceil(n / 15.0) AS BIGINT))) AS i FROM e)")
    q["split_totals"] = (split_totals, "SELECT job_id, CAST(sum(coalesce(greatest(1, ceil(n / 15.0)), 1)) AS BIGINT) AS n_requests, count(*) AS n_files FROM (SELECT DISTINCT env_id, job_id, metadata.page_count AS n FROM envelopes) GROUP BY ALL")
    q["chunk_progress"] = (lambda s, d: jobs.progress(table(s, d, "chunk_runs")), "WITH o AS (SELECT DISTINCT job_id, run_id, status FROM chunk_runs) SELECT job_id, run_id, CAST(b AS INTEGER) AS done_before, CAST(floor(100 * (b + 1) / n) AS INTEGER) AS percent FROM (SELECT *, coalesce(count(*) OVER (PARTITION BY job_id ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, count(*) OVER (PARTITION BY job_id) AS n FROM o)")
    q["rate_limit_schedule"] = (lambda s, d: jobs.request_slots(table(s, d, "chunk_runs")), "SELECT job_id, run_id, CAST(floor(n / 15) AS INTEGER) AS slot, CAST(floor(n / 15) * 60 AS INTEGER) AS start_second FROM (SELECT job_id, run_id, row_number() OVER (PARTITION BY job_id ORDER BY run_id) - 1 AS n FROM (SELECT DISTINCT job_id, run_id FROM chunk_runs))")
    again = "|".join(("timeout", "temporary", "rate limit", "too many requests", "retry", "try again", "server busy"))
    q["retry_plan"] = (lambda s, d: table(s, d, "chunk_runs").select("run_id", jobs.recoverable(F.col("error_text")).alias("recoverable"), jobs.backoff(F.col("attempt")).alias("wait_s")).distinct(), f"SELECT DISTINCT run_id, coalesce(regexp_matches(lower(error_text), '{again}'), false) AS recoverable, least(power(2.0, attempt), 60.0) AS wait_s FROM chunk_runs")
    q["read_modes"] = (lambda s, d: table(s, d, "raw_exports").select("file_id", jobs.read_mode(F.octet_length("payload")).alias("mode"), jobs.chunk_pages(F.octet_length("payload")).alias("pages"), jobs.conversion_method(F.octet_length("payload")).alias("method")).distinct(), "SELECT DISTINCT file_id, CASE WHEN b < 5242880 THEN 'standard' WHEN b < 52428800 THEN 'chunked' ELSE 'streaming' END AS mode, CASE WHEN b > 104857600 THEN 5 WHEN b > 52428800 THEN 7 ELSE 10 END AS pages, CASE WHEN b <= 5242880 THEN 'regular' ELSE 'large_file' END AS method FROM (SELECT file_id, CAST(strlen(payload) AS BIGINT) AS b FROM raw_exports)")
    q["page_renumber"] = (page_renumber, f"WITH {FILES} SELECT DISTINCT {KEY}, CAST(floor(page_idx / 15) AS INTEGER) AS chunk_idx, page_idx + 1 AS new_number FROM p")
    num = f"regexp_extract_all(text, '{markers.PAGE}', 1)"
    gaps = f"string_split_regex(text, '{markers.PAGE.replace('(', '(?:')}')"
    q["adjusted_markers"] = (adjusted, f"""WITH g AS (SELECT DISTINCT env_id, CAST(k.i - 1 AS INTEGER) AS chunk, k.f.text AS text, greatest(coalesce(k.f.metadata.page_count, 0), 0) AS n FROM (SELECT env_id, unnest(list_transform(files, lambda x, i: {{'f': x, 'i': i}})) AS k FROM envelopes) WHERE k.f.text IS NOT NULL)
SELECT env_id, chunk, CASE WHEN chunk = 0 THEN text ELSE '----- Page ' || chunk * 15 + 1 || ' -----' || chr(10) || chr(10) || '--- Chunk ' || chunk + 1 || ' (Pages ' || chunk * 15 + 1 || '-' || chunk * 15 + n || ') ---' || chr(10) || chr(10) ||
  {gaps}[1] || array_to_string(list_transform(range(1, len({num}) + 1), lambda i: '----- Page ' || CASE WHEN {num}[i] NOT LIKE '0%' AND TRY_CAST({num}[i] AS INTEGER) BETWEEN 2 AND n THEN CAST(TRY_CAST({num}[i] AS INTEGER) + chunk * 15 AS VARCHAR) ELSE {num}[i] END || ' -----' || {gaps}[i + 1]), '') END AS text FROM g""")
    q["confidence_summary"] = (lambda s, d: confidence_summary(s, d).withColumn("avg_confidence", r("avg_confidence", 9)), f"WITH {FILES}{ELEMENTS}, u AS (SELECT DISTINCT {KEY}, elem_idx, e FROM e WHERE elem_level = 'block') SELECT env_id, file_idx, round(avg(nullif(e.layout.confidence, 0)), 9) AS avg_confidence, coalesce(array_to_string(list_sort(list(DISTINCT page_idx) FILTER (WHERE e.layout.confidence = 0)), ','), '') AS pages_with_errors FROM u GROUP BY ALL")
    q["median_token_height"] = (token_heights, f"WITH {FILES}{ELEMENTS}, t AS (SELECT {KEY}, list_sort(list(h)) AS hs FROM (SELECT DISTINCT {KEY}, elem_idx, e, e.layout.bounding_poly.vertices[3].y - e.layout.bounding_poly.vertices[1].y AS h FROM e WHERE elem_level = 'token') WHERE h > 0 GROUP BY ALL) SELECT {KEY}, coalesce(hs[CAST(floor(len(hs) / 2) AS BIGINT) + 1], 12.0) AS font_size FROM (SELECT DISTINCT {KEY} FROM p) LEFT JOIN t USING (env_id, file_idx, page_idx)")
    q["indent_hints"] = (indent_hint, f"WITH {POSITIONED}, {EXTENTS} SELECT {KEY}, elem_idx, CASE WHEN width_px <= 0 THEN 0 WHEN sh < 0.02 THEN 0 WHEN sh < 0.06 THEN 1 ELSE 2 END AS hint FROM (SELECT l.*, width_px, (x - min(x) OVER (PARTITION BY {KEY})) / width_px AS sh FROM l JOIN ext USING (env_id, file_idx, page_idx))")
    q["pdf_coordinates"] = (to_pdf, f"WITH {POSITIONED}, {EXTENTS} SELECT {KEY}, elem_idx, x * 0.75::DOUBLE AS pdf_x, height_px * 0.75::DOUBLE - y * 0.75::DOUBLE AS pdf_y FROM l JOIN ext USING (env_id, file_idx, page_idx)")
    q["line_length_stats"] = (lambda s, d: genre.line_lengths(docs(s, d), "doc_id").select("doc_id", "n_lines", r("avg_length").alias("avg_length"), r("std_length").alias("std_length"), r("cv").alias("cv"), "confidence"), f"""WITH n AS (SELECT doc_id, count(*) AS n_lines, avg(length({s_strip('line')})) AS m, stddev_pop(length({s_strip('line')})) AS dv FROM ({DOC_LINES}) GROUP BY ALL)
SELECT doc_id, n_lines, CASE WHEN n_lines < 5 THEN 0 ELSE round(m, 6) END AS avg_length, CASE WHEN n_lines < 5 THEN 0 ELSE round(dv, 6) END AS std_length, CASE WHEN n_lines >= 5 THEN round(dv / m, 6) END AS cv, CASE WHEN n_lines < 5 THEN 0.0 WHEN dv / m < 0.2 AND m < 60 THEN 0.9 WHEN dv / m < 0.3 AND m < 80 THEN 0.7 WHEN dv / m > 0.5 THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM n""")
    name = r"coalesce(nullif(regexp_extract(line, '^\s*([Α-Ω]{2,4})\.\s', 1), ''), nullif(regexp_extract(line, '^\s*([A-Z]{2,4})\.\s', 1), ''), nullif(regexp_extract(line, '^\s*([Α-Ω]{4,12}|[A-Z]{4,12})[.:]\s', 1), ''))"
    speaker_sql = f"SELECT doc_id, count(*) AS total_lines, count({name}) AS speaker_lines, count(DISTINCT {name}) AS unique_speakers, list(DISTINCT {name}) FILTER ({name} IS NOT NULL) AS names FROM ({DOC_LINES}) GROUP BY ALL"
    q["speaker_stats"] = (lambda s, d: genre.speakers(docs(s, d), "doc_id").select("doc_id", "total_lines", "speaker_lines", "unique_speakers", "confidence", F.array_join("speakers", ",").alias("speakers")), f"SELECT * EXCLUDE (names), coalesce(array_to_string(list_sort(names)[1:10], ','), '') AS speakers, CASE WHEN speaker_lines / total_lines > 0.3 AND unique_speakers BETWEEN 2 AND 10 THEN 0.9 WHEN speaker_lines / total_lines > 0.2 AND unique_speakers >= 2 THEN 0.7 WHEN speaker_lines / total_lines > 0.1 THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM ({speaker_sql})")
    counts = " + ".join(f"len(regexp_extract_all(text, '{p}', 0))" for p in (r"Fr(?:ag)?\.?\s*\d+", r"\b[AB]\d+\b", r"(?m)^\s*\d{1,3}\.\s", r"\[\d{1,3}\]", r"§\s*\d+"))
    fragment_sql = f"SELECT doc_id, CAST({counts} AS INTEGER) AS fragment_markers, CAST(len(list_filter(string_split(text, chr(10) || chr(10)), lambda q: {s_strip('q')} <> '')) AS INTEGER) AS total_paragraphs FROM documents WHERE {s_strip('text')} <> ''"
    q["fragment_stats"] = (lambda s, d: genre.fragments(docs(s, d), "doc_id").drop("fragment_ratio"), f"SELECT *, CASE WHEN fragment_markers / total_paragraphs > 0.5 THEN 0.9 WHEN fragment_markers / total_paragraphs > 0.3 THEN 0.7 WHEN fragment_markers / total_paragraphs > 0.1 THEN 0.5 ELSE 0.2 END::DOUBLE AS confidence FROM ({fragment_sql})")
    q["genre_hint"] = (lambda s, d: genre.hints(docs(s, d), "doc_id").select("doc_id", "genre"), f"""WITH n AS (SELECT doc_id, count(*) AS n_lines, avg(length({s_strip('line')})) AS m, stddev_pop(length({s_strip('line')})) AS dv FROM ({DOC_LINES}) GROUP BY ALL), sp AS ({speaker_sql}), fr AS ({fragment_sql}), x AS (
  SELECT doc_id, length({s_strip('text')}) AS k, coalesce(CASE WHEN n_lines < 5 THEN false ELSE m < 60 AND dv / m < 0.3 END, false) AS verse, coalesce(speaker_lines / total_lines > 0.15, false) AS talk, coalesce(fragment_markers / total_paragraphs > 0.2, false) AS frag FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN sp USING (doc_id) LEFT JOIN fr USING (doc_id))
SELECT doc_id, CASE WHEN coalesce(k < 50, true) THEN 'unknown' WHEN frag THEN 'fragments' WHEN verse AND talk THEN 'verse_speakers' WHEN talk THEN 'speakers' WHEN verse THEN 'verse' ELSE 'prose' END AS genre FROM x""")
    q["sample_pages"] = (lambda s, d: env(s, d).select("env_id", F.col("metadata.page_count").alias("n")).where("n > 0").distinct().select("env_id", "n", F.explode(template.sample_pages(F.col("n"), 6)).alias("page_idx")), """WITH e AS (SELECT DISTINCT env_id, metadata.page_count AS n FROM envelopes WHERE metadata.page_count > 0), k AS (SELECT env_id, n, CASE WHEN n - 4 <= 0 THEN least(2, n // 4) ELSE 2 END AS a FROM e)
SELECT env_id, n, CAST(unnest(CASE WHEN n <= 5 THEN range(n) WHEN n - 2 * a <= 6 THEN range(a, n - a) ELSE list_transform(range(6), lambda i: CAST(a + floor(i * ((n - 2 * a) / 6.0::DOUBLE)) AS BIGINT)) END) AS INTEGER) AS page_idx FROM k""")
    dedup = "SELECT DISTINCT element_id, edition_id, width, x_position FROM positioned_elements WHERE width IS NOT NULL AND edition_id IS NOT NULL"
    q["robust_median"] = (lambda s, d: template.robust_medians(table(s, d, "positioned_elements").where("width is not null and edition_id is not null").select("element_id", "edition_id", "width", "x_position").distinct(), ["edition_id"], "width"), f"""WITH x AS (SELECT edition_id, width AS v FROM ({dedup})), a AS (SELECT edition_id, median(v) AS m, count(*) AS n FROM x GROUP BY ALL), b AS (SELECT x.edition_id, v, m, n, abs(v - m) AS dev FROM x JOIN a USING (edition_id)), c AS (SELECT edition_id, median(dev) AS mad FROM b GROUP BY ALL), k AS (SELECT b.*, n >= 3 AND mad >= 1 AND dev > 2.0 * mad AS far FROM b JOIN c USING (edition_id)), o AS (SELECT *, sum(CAST(far AS INTEGER)) OVER (PARTITION BY edition_id) AS nf FROM k)
SELECT edition_id, CAST(any_value(n) AS INTEGER) AS n, CAST(trunc(median(v) FILTER (WHERE NOT (far AND nf < n / 2))) AS INTEGER) AS median, CAST(any_value(nf) AS INTEGER) AS n_outliers FROM o GROUP BY ALL""")
    q["template_confidence"] = (template_confidence, f"""WITH {POSITIONED}, {EXTENTS}, m AS (SELECT {KEY}, min(x) AS bl, max(x + width) AS br, min(y) AS bt FROM l GROUP BY ALL), a AS (SELECT ext.*, bl, br, bt FROM ext JOIN m USING (env_id, file_idx, page_idx)), b AS (
  SELECT env_id, file_idx, count(*) AS n, ({" + ".join(f"CASE WHEN avg({c}) > 0 THEN stddev_pop({c}) / avg({c}) ELSE 1.0 END" for c in ("width_px", "height_px", "bl", "br", "bt"))}) / 5 AS cv, avg(CAST(bl / width_px > 0.08 AS DOUBLE)) > 0.5 AS left_margin FROM a GROUP BY ALL)
SELECT env_id, file_idx, round(CASE WHEN n < 3 THEN 0.5 ELSE greatest(0, least(1, 1 - cv)) END, 9) AS confidence, left_margin FROM b""")
    q["profile_gaps"] = (lambda s, d: template.low_runs(element_profile(s, d), ["edition_id"], "strip", "ink", 2.0, 2), f"WITH pr AS ({PROFILE}), a AS (SELECT *, ink <= 2.0 AS low FROM pr), b AS (SELECT *, CASE WHEN coalesce(lag(low) OVER (PARTITION BY edition_id ORDER BY strip) <> low, true) THEN 1 ELSE 0 END AS ch FROM a), c AS (SELECT *, sum(ch) OVER (PARTITION BY edition_id ORDER BY strip) AS run FROM b) SELECT edition_id, min(strip) AS first, max(strip) AS last, count(*) AS n FROM c WHERE low GROUP BY edition_id, run HAVING count(*) >= 2")
    q["profile_edges"] = (lambda s, d: template.edges(element_profile(s, d), ["edition_id"], "strip", "ink", 3.0), f"WITH pr AS ({PROFILE}), a AS (SELECT *, ink > 3.0 AS up, lag(ink > 3.0) OVER (PARTITION BY edition_id ORDER BY strip) AS was, lag(strip) OVER (PARTITION BY edition_id ORDER BY strip) AS prev FROM pr) SELECT edition_id, CASE WHEN up THEN strip ELSE prev END AS at, CASE WHEN up THEN 'rising' ELSE 'falling' END AS edge FROM a WHERE was IS NOT NULL AND up <> was")
    q["profile_smoothed"] = (lambda s, d: template.smoothed(element_profile(s, d), ["edition_id"], "strip", "ink"), f"WITH pr AS ({PROFILE}) SELECT *, 0.25::DOUBLE * coalesce(lag(ink) OVER w, ink) + 0.5::DOUBLE * ink + 0.25::DOUBLE * coalesce(lead(ink) OVER w, ink) AS smooth FROM pr WINDOW w AS (PARTITION BY edition_id ORDER BY strip)")
    q["profile_threshold"] = (lambda s, d: element_profile(s, d).groupBy("edition_id").agg(r(F.percentile("ink", 0.1)).alias("p10"), r(F.percentile("ink", 0.9)).alias("p90")), f"SELECT edition_id, round(quantile_cont(ink, 0.1), 6) AS p10, round(quantile_cont(ink, 0.9), 6) AS p90 FROM ({PROFILE}) GROUP BY ALL")
    side = "CASE WHEN q.dimension.{0} IS NULL THEN 'null' ELSE CAST(CAST(trunc(q.dimension.{0}) AS INTEGER) AS VARCHAR) END"
    shown = f"""'{{"dpi": 300, "height": ' || {side.format('height')} || ', "width": ' || {side.format('width')} || '}}'"""
    q["template_keys"] = (template_keys, f"""WITH {FILES} SELECT DISTINCT env_id, file_idx, sha256('{{"count": ' || len(pages) || ', "pages": [' || array_to_string(list_transform(pages[1:10], lambda q: {shown}), ', ') || ']}}') AS cache_key FROM f WHERE pages IS NOT NULL""")
    q["file_headings"] = (lambda s, d: env(s, d).select("env_id", F.posexplode("files").alias("i", "f")).select("env_id", "i", F.concat(F.lit("## "), F.coalesce("f.metadata.filename", F.concat(F.lit("File "), (F.col("i") + 1).cast("string")))).alias("heading"), F.concat(F.lit("Total Pages: "), F.coalesce(F.col("f.metadata.page_count").cast("string"), F.lit("Unknown"))).alias("pages")).distinct(), "SELECT DISTINCT env_id, CAST(i - 1 AS INTEGER) AS i, '## ' || coalesce(f.metadata.filename, 'File ' || i) AS heading, 'Total Pages: ' || coalesce(CAST(f.metadata.page_count AS VARCHAR), 'Unknown') AS pages FROM (SELECT env_id, unnest(files) AS f, unnest(range(1, len(files) + 1)) AS i FROM envelopes)")
    q["anchored_text"] = (anchors, "SELECT doc_id, replace(text, chr(10), '') AS joined, array_to_string(list_filter(string_split(nfc_normalize(text), chr(10)), lambda q: q <> ''), ' ') AS spaced, nullif(string_split(text, chr(10))[1], '') AS first_segment FROM documents WHERE text IS NOT NULL")
    q["record_json"] = (lambda s, d: env(s, d).where("metadata is not null").select("env_id", F.from_json(F.to_json("metadata"), "filename string, page_count int, mode string").alias("m")).select("env_id", "m.filename", F.col("m.page_count").cast("double").alias("page_count"), "m.mode").distinct(), "SELECT DISTINCT env_id, metadata.filename AS filename, CAST(metadata.page_count AS DOUBLE) AS page_count, metadata.mode AS mode FROM envelopes WHERE metadata IS NOT NULL")
    q["content_status"] = (lambda s, d: docs(s, d).select("doc_id", render.status(F.col("text")).alias("status")), f"SELECT doc_id, CASE WHEN text IS NULL OR {s_strip('text')} = '' THEN 'empty' WHEN starts_with(text, 'Error:') OR starts_with(text, 'Error generating markdown:') OR text = 'No pages found in document.' THEN 'error' ELSE 'ok' END AS status FROM documents")
    q["event_windows"] = (event_windows, "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
    tops = "list_sort(list_transform(list_filter(q.blocks, lambda b: len(b.layout.bounding_poly.vertices) > 0 AND b.text IS NOT NULL AND b.text <> ''), lambda b: {'top': coalesce(list_min(list_transform(b.layout.bounding_poly.vertices, lambda v: v.y)), 0) / coalesce(nullif(q.dimension.height, 0), 1), 't': b.text}))"
    q["block_text"] = (lambda s, d: assemble.block_text(env(s, d)), f"WITH {FILES} SELECT DISTINCT env_id, file_idx, array_to_string(list_transform(pages, lambda q, i: (CASE WHEN i > 1 THEN chr(10) || chr(10) || '----- Page ' || i || ' -----' || chr(10) || chr(10) ELSE '' END) || coalesce(array_to_string(list_transform({tops}, lambda x: x.t || ' '), ''), '')), '') AS text FROM f WHERE pages IS NOT NULL")
    plain = markers.PAGE.replace("(", "(?:")
    hit = "list_filter(coalesce(f.document_data.pages, []), lambda p: p.page_number = CAST(n AS INTEGER))"
    one = f"CASE WHEN len({hit}) > 0 THEN {content.replace('p.', hit + '[-1].')} END"
    bn, bg = f"regexp_extract_all(t, '{markers.PAGE}', 1)", f"string_split_regex(t, '{plain}')"
    q["batch_markdown"] = (lambda s, d: assemble.batch_markdown(env(s, d)), f"""WITH g AS (SELECT DISTINCT env_id, metadata.mode AS mode, k.i AS i, k.f.metadata.filename AS name, k.f.metadata.page_count AS n, nfc_normalize(k.f.text) AS t, k IS NULL AS nil
  FROM (SELECT env_id, metadata, unnest(CASE WHEN len(files) = 0 THEN [NULL] ELSE list_transform(files, lambda x, i: {{'f': x, 'i': i}}) END) AS k FROM envelopes WHERE files IS NOT NULL)
), h AS (SELECT env_id, mode, i, nil, array_to_string(list_concat(list_concat(CASE WHEN name IS NOT NULL THEN ['## File: ' || name, 'Total Pages: ' || coalesce(CAST(n AS VARCHAR), 'Unknown'), ''] ELSE ['## File ' || i, ''] END,
  coalesce(flatten(list_transform(range(1, len({bn}) + 1), lambda j: list_concat(['### Page ' || {bn}[j], ''], CASE WHEN {s_strip(bg + '[j + 1]')} <> '' THEN [{s_strip(bg + '[j + 1]')}, ''] ELSE [] END))), [])), ['---', '']), chr(10)) AS s FROM g)
SELECT env_id, array_to_string(list_concat(CASE WHEN mode IS NOT NULL THEN ['# Document Processing Mode: ' || mode, ''] ELSE [] END, coalesce(list(s ORDER BY i) FILTER (NOT nil), [])), chr(10)) AS markdown FROM h GROUP BY env_id, mode""")
    q["conversion_routes"] = (lambda s, d: env(s, d).select("env_id", assemble.conversion_route(F.col("text"), F.col("files"), F.col("document_data")).alias("route")).distinct(), "SELECT DISTINCT env_id, CASE WHEN files IS NOT NULL AND coalesce(contains(text, '--- Chunk '), false) AND coalesce(len(list_filter(files, lambda f: f.document_data IS NOT NULL)) > 0, false) THEN 'hybrid' WHEN files IS NOT NULL THEN 'files' WHEN document_data IS NOT NULL THEN 'academic' WHEN coalesce(text, '') <> '' THEN 'text' ELSE 'none' END AS route FROM envelopes")
    single_md = f"SELECT env_id, markdown FROM ({q['academic_markdown'][1]}) WHERE file_idx = 0 AND env_id IN (SELECT env_id FROM envelopes WHERE files IS NULL)"
    every_md = f"({q['batch_markdown'][1]} UNION ALL {single_md})"
    status = f"CASE WHEN markdown IS NULL OR {s_strip('markdown')} = '' THEN 'empty' WHEN starts_with(markdown, 'Error:') OR starts_with(markdown, 'Error generating markdown:') OR markdown = 'No pages found in document.' THEN 'error' ELSE 'ok' END"
    q["record_markdown"] = (lambda s, d: assemble.record_markdown(env(s, d)), f"SELECT env_id, markdown, {status} AS status FROM (SELECT DISTINCT env_id FROM envelopes) LEFT JOIN ({every_md}) USING (env_id)")
    made = f"list_concat(list_concat({head}, list_filter(list_transform(string_split(markdown, chr(10)), lambda q: CASE WHEN starts_with(q, '# ') THEN '<h1>' || q[3:] || '</h1>' WHEN starts_with(q, '## ') THEN '<h2>' || q[4:] || '</h2>' WHEN starts_with(q, '### ') THEN '<h3>' || q[5:] || '</h3>' WHEN starts_with(q, '#### ') THEN '<h4>' || q[6:] || '</h4>' WHEN starts_with(q, '---') THEN '<hr>' WHEN {s_strip('q')} <> '' THEN '<p>' || q || '</p>' END), lambda q: q IS NOT NULL)), ['</body></html>'])"
    simple = q["text_html"][1].split(" AS html FROM")[0].removeprefix("SELECT DISTINCT env_id, ").replace("coalesce(text, '')", "t.text")
    q["record_html"] = (lambda s, d: assemble.record_html(env(s, d)), f"""WITH m AS (SELECT env_id, array_to_string({made}, chr(10)) AS made FROM ({q['batch_markdown'][1]})
  UNION ALL SELECT env_id, string_agg(html, chr(10) ORDER BY page_idx) FROM ({q['positioned_html'][1]}) WHERE file_idx = 0 AND env_id IN (SELECT env_id FROM envelopes WHERE files IS NULL) GROUP BY env_id)
SELECT t.env_id, coalesce(made, {simple}) AS html, CASE WHEN made IS NULL THEN 'fallback' ELSE 'ok' END AS status FROM ({q['document_text'][1]}) t JOIN (SELECT DISTINCT env_id, metadata, "timestamp" FROM envelopes) e ON t.env_id = e.env_id LEFT JOIN m ON m.env_id = t.env_id""")
    q["previews"] = (lambda s, d: assemble.previews(env(s, d), 2000).drop("html", "json_preview"), rf"""WITH md AS (SELECT * FROM ({every_md}))
SELECT t.env_id, t.text, markdown AS full_markdown, coalesce(length(markdown) > 2000, false) AS was_truncated, CASE WHEN coalesce(markdown, '') = '' THEN 'Error: Markdown conversion failed to produce content.' WHEN length(markdown) > 2000 THEN left(markdown, 2000) || chr(10) || chr(10) || '...' || chr(10) || chr(10) || '[PREVIEW TRUNCATED: Showing 2,000 of ' || regexp_replace(CAST(length(markdown) AS VARCHAR), '^(\d+)(\d{{3}})$', '\1,\2') || ' characters]' || chr(10) || '[The complete content will be saved when using ''Save Markdown'']' ELSE markdown END AS markdown_preview FROM ({q['document_text'][1]}) t LEFT JOIN md USING (env_id)""")
    q["assembled_files"] = (lambda s, d: assemble.assembled(env(s, d)), f"WITH {FILES}{ELEMENTS}, u AS (SELECT DISTINCT {KEY}, elem_idx, {s_strip('e.text')} AS t FROM e WHERE elem_level = 'paragraph') SELECT env_id, file_idx, string_agg(t, chr(10) || chr(10) ORDER BY page_idx, elem_idx) AS text, count(DISTINCT page_idx) AS n_pages, CAST(count(*) AS INTEGER) AS n_paragraphs, CAST(length(string_agg(t, chr(10) || chr(10) ORDER BY page_idx, elem_idx)) AS INTEGER) AS n_chars FROM u WHERE t <> '' GROUP BY ALL")
    q["line_clusters"] = (lambda s, d: assemble.line_clusters(env(s, d)).select(*PAGE, F.size("centres").alias("n_clusters"), F.array_join(F.transform("centres", lambda c: F.format_string("%.6f", c)), ",").alias("centres")), f"""WITH {POSITIONED}, ce AS (SELECT {KEY}, list_reduce(list_transform(list_sort(list(x)), lambda q: {{'c': [q], 's': q, 'n': 1}}), lambda a, b: CASE WHEN abs(b.s - a.s / a.n) <= 50 THEN {{'c': list_append(a.c[1:len(a.c) - 1], (a.s + b.s) / (a.n + 1)), 's': a.s + b.s, 'n': a.n + 1}} ELSE {{'c': list_append(a.c, b.s), 's': b.s, 'n': 1}} END).c AS c FROM l GROUP BY ALL)
SELECT {KEY}, CAST(len(c) AS INTEGER) AS n_clusters, array_to_string(list_transform(c, lambda q: printf('%.6f', q)), ',') AS centres FROM ce""")
    q["content_types"] = (lambda s, d: assemble.content_type(genre.lines(docs(s, d), "doc_id"), "doc_id"), f"SELECT doc_id, CASE WHEN count(*) >= 3 AND avg(length({s_strip('line')})) < 50 AND stddev_pop(length({s_strip('line')})) / avg(length({s_strip('line')})) < 0.3 THEN 'poetry' ELSE 'prose' END AS content_type FROM ({DOC_LINES}) GROUP BY ALL")
    q["page_chunks"] = (lambda s, d: nested.pages(env(s, d)).groupBy("env_id", "file_idx", F.floor(F.col("page_idx") / 10).cast("int").alias("chunk_no")).agg(F.count("*").alias("n_pages")), f"WITH {FILES} SELECT env_id, file_idx, CAST(floor(page_idx / 10) AS INTEGER) AS chunk_no, count(*) AS n_pages FROM (SELECT DISTINCT {KEY} FROM p) GROUP BY ALL")
    q["confidence_gates"] = (lambda s, d: elements_table(s, d).groupBy("elem_type").agg(F.count_if(F.col("confidence") >= 0.5).alias("kept"), F.count_if(F.coalesce(F.col("confidence") < 0.5, F.lit(True))).alias("dropped"), F.count_if(F.coalesce(F.col("confidence") < 0.3, F.lit(True))).alias("for_review")), "SELECT elem_type, count_if(confidence >= 0.5) AS kept, count_if(coalesce(confidence < 0.5, true)) AS dropped, count_if(coalesce(confidence < 0.3, true)) AS for_review FROM (SELECT DISTINCT * EXCLUDE (loaded_at, recognized_at) FROM positioned_elements) GROUP BY ALL")
    q["failed_pages_semi"] = (lambda s, d: table(s, d, "chunk_runs").select("run_id", "job_id", "page_from", "page_to", "status").distinct().join(table(s, d, "ocr_jobs").where("finished_at is null").select("job_id"), "job_id", "left_semi"), "SELECT DISTINCT run_id, job_id, page_from, page_to, status FROM chunk_runs WHERE job_id IN (SELECT job_id FROM ocr_jobs WHERE finished_at IS NULL)")
    q["projected_footnotes"] = (lambda s, d: layout.footnote_starts(layout.positioned(projected_layout(s, d))), s_projected(q["footnote_sections"][1]))
    q["projected_types"] = (lambda s, d: layout.classified(layout.positioned(projected_layout(s, d))).select(*PAGE, "elem_idx", "elem_type"), s_projected(q["element_types"][1]))
    q["projected_indents"] = (lambda s, d: layout.indented(layout.positioned(projected_layout(s, d))).select(*PAGE, "elem_idx", "indent_level"), s_projected(q["indent_levels"][1]))
    q["projected_markdown"] = (lambda s, d: render.academic_markdown(projected_layout(s, d)), s_projected(q["academic_markdown"][1]))
    q["document_templates"] = (templates, f"""WITH {POSITIONED}, {EXTENTS}, z AS (SELECT env_id, file_idx, page_idx, width_px, height_px, min(x) AS body_left, max(x + width) AS body_right, min(y) AS body_top FROM ext JOIN l USING (env_id, file_idx, page_idx) GROUP BY ALL
), x AS (SELECT env_id, file_idx, zone, v FROM (UNPIVOT z ON width_px, height_px, body_left, body_right, body_top INTO NAME zone VALUE v)), a AS (SELECT env_id, file_idx, zone, median(v) AS m, count(*) AS n FROM x GROUP BY ALL), b AS (SELECT x.*, m, n, abs(v - m) AS dev FROM x JOIN a USING (env_id, file_idx, zone)), c AS (SELECT env_id, file_idx, zone, median(dev) AS mad FROM b GROUP BY ALL),
k AS (SELECT b.*, n >= 3 AND mad >= 1 AND dev > 2.0 * mad AS far FROM b JOIN c USING (env_id, file_idx, zone)), o AS (SELECT *, sum(CAST(far AS INTEGER)) OVER (PARTITION BY env_id, file_idx, zone) AS nf FROM k), md AS (SELECT env_id, file_idx, zone, CAST(trunc(median(v) FILTER (WHERE NOT (far AND nf < n / 2))) AS INTEGER) AS v FROM o GROUP BY ALL)
SELECT env_id, file_idx, (SELECT count(*) FROM z z2 WHERE z2.env_id = md.env_id AND z2.file_idx = md.file_idx) AS pages_analysed, {", ".join(f"max(v) FILTER (zone = '{z}') AS {z}" for z in ZONES)} FROM md GROUP BY env_id, file_idx""")
    kernel = template.gaussian_kernel(2.0)
    mirror = "list_extract(v, CAST(least(((i + {0}) % (2 * n) + 2 * n) % (2 * n), 2 * n - 1 - ((i + {0}) % (2 * n) + 2 * n) % (2 * n)) + 1 AS BIGINT))"
    q["profile_gaussian"] = (lambda s, d: template.gaussian(element_profile(s, d), ["edition_id"], "strip", "ink", 2.0).withColumn("smooth", r("smooth")), f"WITH pr AS ({PROFILE}), g AS (SELECT edition_id, list(strip ORDER BY strip) AS places, list(ink ORDER BY strip) AS v, CAST(count(*) AS BIGINT) AS n FROM pr GROUP BY ALL), e AS (SELECT *, unnest(range(n)) AS i FROM g) SELECT edition_id, places[i + 1] AS strip, round({' + '.join(f'{w!r}::DOUBLE * {mirror.format(k - len(kernel) // 2)}' for k, w in enumerate(kernel))}, 6) AS smooth FROM e")
    q["profile_gradient"] = (lambda s, d: template.gradient(element_profile(s, d), ["edition_id"], "strip", "ink"), f"WITH pr AS ({PROFILE}), x AS (SELECT *, lag(ink) OVER w AS a, lead(ink) OVER w AS b FROM pr WINDOW w AS (PARTITION BY edition_id ORDER BY strip)) SELECT edition_id, strip, CASE WHEN a IS NULL AND b IS NULL THEN 0.0 WHEN a IS NULL THEN b - ink WHEN b IS NULL THEN ink - a ELSE (b - a) / 2 END::DOUBLE AS gradient FROM x")
    q["profile_transitions"] = (lambda s, d: template.transitions(template.gradient(element_profile(s, d), ["edition_id"], "strip", "ink"), ["edition_id"], "strip", 1.0), f"SELECT edition_id, strip FROM (SELECT *, lag(gradient) OVER (PARTITION BY edition_id ORDER BY strip) AS was FROM ({q['profile_gradient'][1]})) WHERE gradient > 1.0 AND coalesce(was <= 1.0, true)")
    q["masked_lines"] = (lambda s, d: assemble.masked(lines(s, d), 100, 100, 900, 1300).select(*PAGE, "elem_idx", "text"), f"WITH {POSITIONED} SELECT {KEY}, elem_idx, CASE WHEN x BETWEEN 100 AND 900 AND y BETWEEN 100 AND 1300 THEN text ELSE '' END AS text FROM l")
    q["page_scale"] = (lambda s, d: layout.page_lines(env(s, d)).select(*PAGE, *layout.extents()).select(*PAGE, r(T.scale_factor(F.col("width_cm"), F.col("width_px")), 9).alias("scale")), f"WITH {POSITIONED}, {EXTENTS} SELECT {KEY}, CASE WHEN width_px <> 0 THEN round(width_px * {CM} / (width_px * (2.54::DOUBLE / 96)), 9) END AS scale FROM ext")
    q["event_sessions"] = (lambda s, d: streams.sessions(table(s, d, "events"), "30 minutes").drop("session_end"), "WITH e AS (SELECT user_id, ts, CASE WHEN coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTE, true) THEN 1 ELSE 0 END AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY user_id, k")
    q["events_matched"] = (lambda s, d: streams.matched(table(s, d, "events").where("event_type = 'click'"), table(s, d, "events").where("event_type = 'purchase'"), ["user_id"], "event_id", "ts", "30 minutes"), "SELECT a.user_id, a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 30 MINUTE WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
    q["runs_once"] = (lambda s, d: table(s, d, "chunk_runs").dropDuplicates(["run_id", "status", "attempt"]).select("run_id", "status", "attempt"), "SELECT DISTINCT run_id, status, attempt FROM chunk_runs")
    q["job_text_so_far"] = (lambda s, d: streams.so_far(streams.progress_rows(env(s, d))).select("job_id", "env_id", "n_files", "n_chars"), "WITH e AS (SELECT DISTINCT job_id, env_id, coalesce(length(text), 0) AS n FROM envelopes WHERE job_id IS NOT NULL) SELECT job_id, env_id, count(*) OVER w AS n_files, CAST(sum(n) OVER w AS BIGINT) AS n_chars FROM e WINDOW w AS (PARTITION BY job_id ORDER BY env_id ROWS UNBOUNDED PRECEDING)")
    return q


QUERIES = build()


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}
