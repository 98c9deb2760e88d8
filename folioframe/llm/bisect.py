"""Oversized pages and files cut at natural boundaries by recursive bisection.

A text longer than `limit` is cut at the strongest boundary near its midpoint, halves still longer than
`limit - overlap` are cut again, and each piece but the first is then extended backwards by `overlap`, so that no piece
exceeds `limit`.  Boundaries by strength: blank line, line break, sentence end, clause mark, white space, any position.
Files are cut the same way between pages; a page that ends with a sentence is the stronger boundary.

Only oversized items leave the JVM; the others are told by their length there.

Defined results: null and empty texts and files without pages and page_count give no pieces; a null page keeps its place;
records delivered again (same key and content) give their pieces once; negative page counts count as none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_LIMIT, PAGE_OVERLAP = 1500, 150
FILE_LIMIT, FILE_OVERLAP = 15, 1

#: Boundary patterns, strongest first; a cut lies at the end of a match.
BOUNDARIES = [
    re.compile(p)
    for p in (
        r"\n[ \t]*\n\s*",
        r"\n[ \t]*",
        r"[.!?;؟;][\"'»”’)\]]*\s+|[。！？][」』”）]*",
        r"[,،:·;](?:\s+)|[，、；：]|\s+[–—-]\s+",
        r"\s+",
    )
]


def cut_at(text: str, lo: int, hi: int) -> int:
    """The strongest boundary near the midpoint of text[lo:hi], the closest among equals.

    Near means within a quarter of the stretch, so that both parts hold something.
    """
    mid, reach = (lo + hi) // 2, max(1, (hi - lo) // 4)
    a, z = max(lo + 1, mid - reach), min(hi - 1, mid + reach)
    for pattern in BOUNDARIES:
        best = None
        for m in pattern.finditer(text, a, z):
            if lo < m.end() < hi and (best is None or abs(m.end() - mid) < abs(best - mid)):
                best = m.end()
        if best is not None:
            return best
    return mid


def bisect_text(text: str, limit: int = PAGE_LIMIT, overlap: int = PAGE_OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces (start, core_start, end) of a text: text[start:end] is the piece, text[core_start:end] its own part."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    if len(text) <= limit:
        return [(0, 0, len(text))] if text else []
    size, cores, todo = limit - overlap, [], [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= size:
            cores.append((lo, hi))
        else:
            c = cut_at(text, lo, hi)
            todo += [(c, hi), (lo, c)]
    return [(max(0, lo - overlap) if lo else 0, lo, hi) for lo, hi in cores]


def bisect_pages(n: int, strong: list[bool] | None, limit: int = FILE_LIMIT, overlap: int = FILE_OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces (first, core_first, end) of n pages; strong[i] tells whether page i ends at a natural boundary."""
    if n <= limit:
        return [(0, 0, n)] if n > 0 else []
    size, cores, todo = limit - overlap, [], [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= size:
            cores.append((lo, hi))
            continue
        mid, reach = (lo + hi) // 2, max(1, (hi - lo) // 4)
        near = sorted(range(max(lo + 1, mid - reach), min(hi, mid + reach + 1)), key=lambda c: (abs(c - mid), c))
        c = next((c for c in near if strong and c - 1 < len(strong) and strong[c - 1]), mid)
        todo += [(c, hi), (lo, c)]
    return [(max(0, lo - overlap) if lo else 0, lo, hi) for lo, hi in cores]


def page_text(p: Column) -> Column:
    """A page's text; where it is null or empty, its block texts joined by one space."""
    blocks = F.array_join(F.transform(F.filter(p["blocks"], lambda b: b["text"].isNotNull()), lambda b: b["text"]), " ")
    return F.when(F.coalesce(p["text"], F.lit("")) != "", p["text"]).otherwise(F.coalesce(blocks, F.lit("")))


def files_of(envelopes: DataFrame) -> DataFrame:
    """(env_id, file_idx, pages, page_count): the entries of batch records, the record itself where it has none."""
    entry = lambda i, m, d: F.struct(i.cast("int").alias("file_idx"), d["pages"].alias("pages"), m["page_count"].alias("page_count"))
    own = F.array(entry(F.lit(0), F.col("metadata"), F.col("document_data")))
    many = F.transform("files", lambda f, i: entry(i + 1, f["metadata"], f["document_data"]))
    return envelopes.select("env_id", F.explode(F.when(F.col("files").isNotNull(), many).otherwise(own)).alias("f")).select("env_id", "f.*")


PIECES = "env_id long, file_idx int, page_idx int, piece_no int, start_pos int, core_start int, end_pos int, piece string"


def pieces(envelopes: DataFrame, page_limit: int = PAGE_LIMIT, page_overlap: int = PAGE_OVERLAP, file_limit: int = FILE_LIMIT, file_overlap: int = FILE_OVERLAP) -> DataFrame:
    """The pieces of every oversized page (positions in code points) and, with page_idx -1, file (positions in pages)."""
    files = files_of(envelopes)
    ends = r"(?s).*[.!?;·。！？؟][\s\"»”’)\]]*$"
    pages = files.select("env_id", "file_idx", F.posexplode("pages").alias("page_idx", "p")).select("env_id", "file_idx", "page_idx", page_text(F.col("p")).alias("body")).where(F.length("body") > page_limit)
    n = F.when(F.size("pages") > 0, F.size("pages")).otherwise(F.coalesce("page_count", F.lit(0)))
    whole = files.select("env_id", "file_idx", n.alias("n"), F.when(n > file_limit, F.transform("pages", lambda p: F.coalesce(F.regexp_like(F.substring(page_text(p), -40, 40), F.lit(ends)), F.lit(False)))).alias("strong")).where(F.col("n") > file_limit)
    items = pages.select("env_id", "file_idx", "page_idx", F.lit(0).alias("n"), F.lit(None).cast("array<boolean>").alias("strong"), "body").unionByName(whole.select("env_id", "file_idx", F.lit(-1).alias("page_idx"), "n", "strong", F.lit("").alias("body"))).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(8)]
            for env, fi, pi, count, strong, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ps = bisect_text(body, page_limit, page_overlap) if pi >= 0 else bisect_pages(count, strong, file_limit, file_overlap)
                for k, (start, core, end) in enumerate(ps):
                    for col, v in zip(rows, (env, fi, pi, k, start, core, end, body[start:end] if pi >= 0 else None), strict=True):
                        col.append(v)
            kinds = [pa.int64(), *[pa.int32()] * 6, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    return items.mapInArrow(run, PIECES)


def cover(envelopes: DataFrame, page_limit: int = PAGE_LIMIT, page_overlap: int = PAGE_OVERLAP, file_limit: int = FILE_LIMIT, file_overlap: int = FILE_OVERLAP) -> DataFrame:
    """Per item that was cut what its pieces cover, and how many leave a gap, exceed the limit or overlap otherwise than told."""
    page = F.col("page_idx") >= 0
    limit, overlap = F.when(page, page_limit).otherwise(file_limit), F.when(page, page_overlap).otherwise(file_overlap)
    before = F.coalesce(F.lag("end_pos").over(Window.partitionBy("env_id", "file_idx", "page_idx").orderBy("piece_no")), F.lit(0))
    p = pieces(envelopes, page_limit, page_overlap, file_limit, file_overlap).withColumn("before", before)
    wrong = lambda c: F.count_if(c).alias
    return p.groupBy("env_id", "file_idx", "page_idx").agg(
        F.max("end_pos").alias("covered"), wrong(F.col("core_start") != F.col("before"))("gaps"), wrong(F.col("end_pos") - F.col("start_pos") > limit)("over"),
        wrong(F.col("start_pos") != F.greatest(F.lit(0), F.col("core_start") - F.when(F.col("piece_no") > 0, overlap).otherwise(0)))("overlaps"), wrong(page & (F.length("piece") != F.col("end_pos") - F.col("start_pos")))("texts"),
    )


def found(envelopes: DataFrame) -> DataFrame:
    """The items that had to be cut: distinct (env_id, file_idx, page_idx)."""
    return pieces(envelopes).where("piece_no > 0 and env_id is not null").select("env_id", "file_idx", "page_idx").distinct()
