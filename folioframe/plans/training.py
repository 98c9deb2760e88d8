"""Registered queries of the general data-preparation operators: schema drift and nested records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, nested
from ..runtime import cut, table

Query = Callable[[SparkSession, str], DataFrame]


def _changes(s: SparkSession, d: str) -> DataFrame:
    raw, base = table(s, d, "raw_exports"), table(s, d, "schema_fields")
    return drift.changes(raw, base, cut(drift.observe(raw, base)))


def _conform(s: SparkSession, d: str) -> DataFrame:
    raw, base = table(s, d, "raw_exports"), table(s, d, "schema_fields")
    return drift.conform(raw, base, cut(drift.observe(raw, base)))


def _alternatives(s: SparkSession, d: str) -> DataFrame:
    return drift.alternatives(cut(drift.observe(table(s, d, "raw_exports"), table(s, d, "schema_fields"))))


COUNTS = ("page_count", "chunks", "file_index", "total_files", "total_chunks", "file_count")


def _doubles(df: DataFrame) -> DataFrame:
    """Counts that can be null as doubles."""
    return df.withColumns({n: F.col(n).cast("double") for n in COUNTS})


def queries() -> dict[str, Query]:
    env = lambda s, d: table(s, d, "envelopes")
    return {
        "p1_found": _changes,
        "p1_table": _conform,
        "p1_alternatives": _alternatives,
        "p7_found": lambda s, d: nested.keys(env(s, d)),
        "p7_variants": lambda s, d: nested.nodes(env(s, d), tuple(arr for _, arr in nested.LEVELS)).groupBy("elem_level", "variant").agg(F.count("*").alias("n_nodes")),
        "p7_pages": lambda s, d: nested.pages(env(s, d)).drop("variant").withColumn("page_number", F.col("page_number").cast("double")),
        "p7_elements": lambda s, d: nested.elements(env(s, d)).drop("vertices", "variant"),
        "p7_vertices": lambda s, d: nested.vertices(env(s, d)),
        "p7_polygons": lambda s, d: nested.polygons(env(s, d)).drop("variant"),
        "p7_records": lambda s, d: _doubles(nested.records(env(s, d))),
        "p7_files": lambda s, d: _doubles(nested.files(env(s, d))),
        "p7_subtypes": lambda s, d: nested.subtypes(env(s, d)).withColumn("page_number", F.col("page_number").cast("double")),
    }


FILES = """f AS (
  SELECT env_id, CAST(0 AS INTEGER) AS file_idx, document_data.pages AS pages FROM envelopes WHERE document_data IS NOT NULL
  UNION ALL
  SELECT env_id, CAST(g.i AS INTEGER), g.f.document_data.pages
  FROM (SELECT env_id, unnest(list_transform(files, lambda x, i: {'f': x, 'i': i})) AS g FROM envelopes)
), p AS (
  SELECT env_id, file_idx, CAST(h.i - 1 AS INTEGER) AS page_idx, h.p AS p
  FROM (SELECT env_id, file_idx, unnest(list_transform(pages, lambda x, i: {'p': x, 'i': i})) AS h FROM f) WHERE h.p IS NOT NULL
)"""
ELEMENTS = ", e AS (" + " UNION ALL ".join(
    f"SELECT env_id, file_idx, page_idx, '{level}' AS elem_level, CAST(h.i - 1 AS INTEGER) AS elem_idx, h.e AS e FROM (SELECT env_id, file_idx, page_idx, unnest(list_transform(p.{arr}, lambda x, i: {{'e': x, 'i': i}})) AS h FROM p) WHERE h.e IS NOT NULL"
    for level, arr in nested.LEVELS
) + ")"
VERTICES = """, v AS (
  SELECT env_id, file_idx, page_idx, elem_idx, CAST(h.i - 1 AS INTEGER) AS vertex_idx, h.v AS v
  FROM (SELECT env_id, file_idx, page_idx, elem_idx, unnest(list_transform(e.layout.bounding_poly.vertices, lambda x, i: {'v': x, 'i': i})) AS h FROM e WHERE elem_level = 'block') WHERE h.v IS NOT NULL
)"""

POLYGONS = """, v AS (
  SELECT env_id, file_idx, page_idx, elem_level, elem_idx, CAST(h.i - 1 AS INTEGER) AS vertex_idx, h.v AS v
  FROM (SELECT env_id, file_idx, page_idx, elem_level, elem_idx, unnest(list_transform(e.layout.bounding_poly.vertices, lambda x, i: {'v': x, 'i': i})) AS h FROM e) WHERE h.v IS NOT NULL
)"""
META = "m IS NOT NULL AS has_metadata, " + ", ".join(f"CAST(m.{n} AS DOUBLE) AS {n}" if n in COUNTS else f"m.{n} AS {'metadata_timestamp' if n == 'timestamp' else n}" for n in nested.META)

PAGE_STATE = "coalesce(nullif(concat_ws('+', CASE WHEN p.dimension IS NOT NULL THEN 'dim' END, CASE WHEN p.text <> '' THEN 'text' END, " + ", ".join(f"CASE WHEN len(list_filter(p.{arr}, lambda q: q IS NOT NULL)) > 0 THEN '{level}' END" for level, arr in nested.LEVELS) + "), ''), 'hollow')"
RING = "e.layout.bounding_poly.vertices"
ELEMENT_STATE = f"""CASE WHEN e.text IS NULL THEN 'untexted' WHEN e.text = '' THEN 'blank' ELSE 'text' END || '-' || CASE WHEN e.layout IS NULL THEN 'bare' WHEN e.layout.confidence IS NULL THEN 'unscored' WHEN e.layout.confidence = 0 THEN 'zeroscored' ELSE 'scored' END || '-' ||
  CASE WHEN {RING} IS NULL THEN 'none' WHEN len({RING}) = 0 THEN 'empty' WHEN len(list_filter({RING}, lambda q: q IS NULL OR q.x IS NULL OR q.y IS NULL)) > 0 THEN 'holed' WHEN len({RING}) >= 4 THEN 'ring' ELSE 'short' END"""


def oracle_sql() -> dict[str, str]:
    return {
        "p7_found": f"""WITH {FILES}{ELEMENTS}{VERTICES}
SELECT DISTINCT env_id, file_idx, page_idx, 'page' AS elem_level, CAST(-1 AS INTEGER) AS elem_idx, CAST(-1 AS INTEGER) AS vertex_idx FROM p
UNION ALL SELECT DISTINCT env_id, file_idx, page_idx, elem_level, elem_idx, CAST(-1 AS INTEGER) FROM e
UNION ALL SELECT DISTINCT env_id, file_idx, page_idx, 'vertex', elem_idx, vertex_idx FROM v""",
        "p7_variants": f"""WITH {FILES}{ELEMENTS}{POLYGONS}, n AS (
  SELECT DISTINCT env_id, file_idx, page_idx, 'page' AS elem_level, -1 AS elem_idx, -1 AS vertex_idx, '' AS parent_level, {PAGE_STATE} AS variant FROM p
  UNION ALL SELECT DISTINCT env_id, file_idx, page_idx, elem_level, elem_idx, -1, '', {ELEMENT_STATE} FROM e
  UNION ALL SELECT DISTINCT env_id, file_idx, page_idx, 'vertex', elem_idx, vertex_idx, elem_level, CASE WHEN v.x IS NOT NULL AND v.y IS NOT NULL THEN 'xy' WHEN v.x IS NOT NULL THEN 'x' WHEN v.y IS NOT NULL THEN 'y' ELSE 'none' END FROM v
) SELECT elem_level, variant, count(*) AS n_nodes FROM n GROUP BY ALL""",
        "p7_subtypes": f"""WITH {FILES}{ELEMENTS}{POLYGONS}
SELECT DISTINCT env_id, file_idx, page_idx, 'page' AS elem_level, CAST(-1 AS INTEGER) AS elem_idx, CAST(-1 AS INTEGER) AS vertex_idx, 'file' AS parent_level, {PAGE_STATE} AS variant, CAST(p.page_number AS DOUBLE) AS page_number, p.dimension.width AS width, p.dimension.height AS height, nullif(p.text, '') AS text, NULL::VARCHAR AS layout_text, NULL::DOUBLE AS confidence, NULL::DOUBLE AS x, NULL::DOUBLE AS y FROM p
UNION ALL SELECT DISTINCT env_id, file_idx, page_idx, elem_level, elem_idx, CAST(-1 AS INTEGER), 'page', {ELEMENT_STATE}, NULL, NULL, NULL, nullif(e.text, ''), e.layout.text, e.layout.confidence, NULL, NULL FROM e
UNION ALL SELECT DISTINCT env_id, file_idx, page_idx, 'vertex', elem_idx, vertex_idx, elem_level, CASE WHEN v.x IS NOT NULL AND v.y IS NOT NULL THEN 'xy' WHEN v.x IS NOT NULL THEN 'x' WHEN v.y IS NOT NULL THEN 'y' ELSE 'none' END, NULL, NULL, NULL, NULL, NULL, NULL, v.x, v.y FROM v""",
        "p7_pages": f"WITH {FILES} SELECT DISTINCT env_id, file_idx, page_idx, CAST(p.page_number AS DOUBLE) AS page_number, p.dimension.width AS width, p.dimension.height AS height, p.text AS text FROM p",
        "p7_elements": f"WITH {FILES}{ELEMENTS} SELECT DISTINCT env_id, file_idx, page_idx, elem_level, elem_idx, e.text AS text, e.layout.text AS layout_text, e.layout.confidence AS confidence FROM e",
        "p7_vertices": f"WITH {FILES}{ELEMENTS}{VERTICES} SELECT DISTINCT env_id, file_idx, page_idx, elem_idx, vertex_idx, v.x AS x, v.y AS y FROM v",
        "p7_polygons": f"WITH {FILES}{ELEMENTS}{POLYGONS} SELECT DISTINCT env_id, file_idx, page_idx, elem_level, elem_idx, vertex_idx, v.x AS x, v.y AS y FROM v",
        "p7_records": f"SELECT DISTINCT env_id, files IS NOT NULL AS is_batch, document_data IS NOT NULL AS has_document, text, timestamp, {META} FROM (SELECT *, metadata AS m FROM envelopes)",
        "p7_files": f"""WITH g AS (
  SELECT env_id, CAST(0 AS INTEGER) AS file_idx, text, timestamp, metadata AS m, document_data AS d FROM envelopes WHERE document_data IS NOT NULL OR files IS NULL
  UNION ALL
  SELECT env_id, CAST(h.i AS INTEGER), h.f.text, h.f.timestamp, h.f.metadata, h.f.document_data
  FROM (SELECT env_id, unnest(list_transform(files, lambda x, i: {{'f': x, 'i': i}})) AS h FROM envelopes) WHERE h.f IS NOT NULL
) SELECT DISTINCT env_id, file_idx, text, timestamp, {META}, d IS NOT NULL AS has_document, d.text AS document_text FROM g""",
    }
