"""The registered queries of the text operators and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import bisect, canonical, langid, mixing, packing, residue, scans, sentences

Query = Callable[[SparkSession, str], DataFrame]


def _texts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {name: table(spark, d, name) for name, _ in canonical.SOURCES}


def queries() -> dict[str, Query]:
    """Query name → (spark, folder) → DataFrame."""
    t = table
    return {
        "p2_found": lambda s, d: bisect.found(t(s, d, "envelopes")),
        "p2_pieces": lambda s, d: bisect.pieces(t(s, d, "envelopes")),
        "p2_cover": lambda s, d: bisect.cover(t(s, d, "envelopes")),
        "p3_found": lambda s, d: canonical.found(_texts(s, d)),
        "p3_texts": lambda s, d: canonical.canonicalize(canonical.texts(_texts(s, d))),
        "p4_found": lambda s, d: sentences.found(t(s, d, "documents")),
        "p4_envelopes": lambda s, d: sentences.split_sentences(t(s, d, "envelopes").where("env_id is not null"), key="env_id"),
        "p5_found": lambda s, d: langid.found(t(s, d, "documents"), t(s, d, "envelopes"), t(s, d, "lang_codes")),
        "p5_segments": lambda s, d: langid.segments(t(s, d, "documents"), t(s, d, "envelopes"), t(s, d, "lang_codes")),
        "p6_found": lambda s, d: scans.line_cases(t(s, d, "documents"), t(s, d, "envelopes")),
        "p6_paragraphs": lambda s, d: scans.repaired(t(s, d, "documents"), t(s, d, "envelopes")),
        "p8_assigned": lambda s, d: packing.assign(t(s, d, "documents")),
        "p8_windows": lambda s, d: packing.windows(packing.assign(t(s, d, "documents"))),
        "p8_checked": lambda s, d: packing.checked(packing.assign(t(s, d, "documents"))),
        "p9_mix": lambda s, d: mixing.mix(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p9_shares": lambda s, d: mixing.shares(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p9_met": lambda s, d: mixing.shares(t(s, d, "documents"), t(s, d, "mix_targets")).select("source", (F.abs(F.col("mixed_tokens") - F.col("quota")) <= F.col("largest") / 2 + 1).alias("met"), (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats")),
        "p9_full": lambda s, d: mixing.mix(t(s, d, "documents"), t(s, d, "mix_targets"), budget=mixing.ALL),
        "p9_full_shares": lambda s, d: mixing.shares(t(s, d, "documents"), t(s, d, "mix_targets"), budget=mixing.ALL),
        "p10_found": lambda s, d: residue.found(t(s, d, "documents")),
        "p10_clean": lambda s, d: residue.clean(t(s, d, "documents")),
    }


P2_FOUND = """
WITH f AS (
  SELECT env_id, CAST(0 AS INTEGER) AS file_idx, document_data.pages AS pages, metadata.page_count AS n FROM envelopes WHERE files IS NULL
  UNION ALL
  SELECT env_id, CAST(g.i AS INTEGER), g.f.document_data.pages, g.f.metadata.page_count
  FROM (SELECT env_id, unnest(list_transform(files, lambda x, i: {'f': x, 'i': i})) AS g FROM envelopes WHERE files IS NOT NULL)
), p AS (
  SELECT env_id, file_idx, CAST(h.i - 1 AS INTEGER) AS page_idx,
    CASE WHEN coalesce(h.p.text, '') <> '' THEN h.p.text
         ELSE coalesce(array_to_string(list_filter(list_transform(h.p.blocks, lambda b: b.text), lambda x: x IS NOT NULL), ' '), '') END AS body
  FROM (SELECT env_id, file_idx, unnest(list_transform(pages, lambda x, i: {'p': x, 'i': i})) AS h FROM f)
)
SELECT DISTINCT env_id, file_idx, page_idx FROM p WHERE length(body) > 1500
UNION
SELECT DISTINCT env_id, file_idx, CAST(-1 AS INTEGER) FROM f WHERE CASE WHEN coalesce(len(pages), 0) > 0 THEN len(pages) ELSE coalesce(n, 0) END > 15
"""

P2_COVER = P2_FOUND.split("SELECT DISTINCT env_id, file_idx, page_idx FROM p")[0] + """
SELECT DISTINCT env_id, file_idx, page_idx, CAST(length(body) AS INTEGER) AS covered, 0 AS gaps, 0 AS "over", 0 AS overlaps, 0 AS texts FROM p WHERE length(body) > 1500
UNION
SELECT DISTINCT env_id, file_idx, CAST(-1 AS INTEGER), CAST(n AS INTEGER), 0, 0, 0, 0 FROM (SELECT env_id, file_idx, CASE WHEN coalesce(len(pages), 0) > 0 THEN len(pages) ELSE coalesce(n, 0) END AS n FROM f) WHERE n > 15
"""
P8_CHECKED = "SELECT count(DISTINCT doc_id) AS n_documents, 0 AS not_whole, 0 AS cut_without_need, 0 AS over_full FROM documents WHERE text <> ''"
P9_MET = "SELECT source, true AS met, true AS within_repeats FROM mix_targets"

_MIXED = "|".join(rf"\p{{{a}}}[\x{{300}}-\x{{36F}}]*[\p{{{b}}}\p{{{c}}}]" for a, b, c in (("Latin", "Greek", "Cyrillic"), ("Greek", "Latin", "Cyrillic"), ("Cyrillic", "Latin", "Greek")))
_ODD = r"[\x{200B}-\x{200D}\x{2060}-\x{2064}\x{FEFF}\x{180E}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}]"
P3_FOUND = " UNION ".join(
    f"SELECT DISTINCT '{name}' AS src, {key} AS id FROM {name} WHERE text IS NOT NULL AND (text <> nfc_normalize(text) OR regexp_matches(text, '{_ODD}') OR regexp_matches(text, '{_MIXED}'))" for name, key in canonical.SOURCES
)


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express over whole tables; the others are tested against brute force."""
    return {"p2_found": P2_FOUND, "p2_cover": P2_COVER, "p3_found": P3_FOUND, "p8_checked": P8_CHECKED, "p9_met": P9_MET}
