"""Deeply nested envelopes as related flat tables (structural-variant tables).

A bottom-up tree automaton gives every vertex, polygon, layout, element and page a state from the states of its
children.  The run of the automaton over one record, its *shape tree*, holds only small state names, so records are
de-duplicated and exploded at that size.  Each state is a structural variant; `variant_table` routes the nodes of one
variant into a table that has just the columns the variant guarantees and `subtypes` holds all of these in one, while
`records`, `files`, `pages`, `elements`, `polygons` (of all four levels) and `vertices` (of blocks) keep the common
supertype keys and the parent links `(env_id, file_idx, page_idx, elem_level, elem_idx, vertex_idx)`.

Defined results: a null array or struct is an absent child and gives no rows; a null entry of an array keeps its
place in the numbering and gives no row; a null coordinate gives a vertex row; empty tables give empty tables; rows
delivered again (same key and same content) give their rows once; extra columns are ignored.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = (("block", "blocks"), ("paragraph", "paragraphs"), ("line", "lines"), ("token", "tokens"))
KEYS = ["env_id", "file_idx", "page_idx", "elem_level", "elem_idx", "vertex_idx"]


def vertex_state(v: Column) -> Column:
    """Leaf transition: which coordinates a vertex has."""
    return (
        F.when(v.isNull(), None)
        .when(v["x"].isNotNull() & v["y"].isNotNull(), "xy")
        .when(v["x"].isNotNull(), "x")
        .when(v["y"].isNotNull(), "y")
        .otherwise("none")
    )


def polygon_state(poly: Column) -> Column:
    """Polygon state from its vertices' states: none, empty, ring (four or more complete), short, holed."""
    states = F.transform(poly["vertices"], vertex_state)
    return (
        F.when(states.isNull(), "none")
        .when(F.size(states) == 0, "empty")
        .when(F.exists(states, lambda s: s.isNull() | (s != "xy")), "holed")
        .when(F.size(states) >= 4, "ring")
        .otherwise("short")
    )


def layout_state(lay: Column) -> Column:
    """Layout state `<confidence>-<polygon>` from its confidence and its polygon's state; bare for an absent layout."""
    score = F.when(lay["confidence"].isNull(), "unscored").when(lay["confidence"] == 0, "zeroscored").otherwise("scored")
    return F.when(lay.isNull(), "bare-none").otherwise(F.concat_ws("-", score, polygon_state(lay["bounding_poly"])))


def element_state(e: Column) -> Column:
    """Element state `<text>-<layout>` from its text and its layout's state; null for an absent element."""
    text = F.when(e["text"].isNull(), "untexted").when(e["text"] == "", "blank").otherwise("text")
    return F.when(e.isNotNull(), F.concat_ws("-", text, layout_state(e["layout"])))


def page_state(p: Column) -> Column:
    """Page state: dimension, text, and the levels of which a child has a state, that is, of which an element is there."""
    parts = [F.when(p["dimension"].isNotNull(), "dim"), F.when(p["text"].isNotNull() & (p["text"] != ""), "text")]
    parts += [F.when(F.exists(p[arr], lambda e: e.isNotNull()), level) for level, arr in LEVELS]
    return F.when(p.isNotNull(), F.coalesce(F.nullif(F.concat_ws("+", *parts), F.lit("")), F.lit("hollow")))


def with_files(df: DataFrame) -> DataFrame:
    """`env_id`, `file_idx` and the file's own columns: 0 for a record's own document_data, 1, 2, … for its entries."""
    own = F.when(F.col("document_data").isNotNull(), F.array(F.struct(F.lit(0).alias("file_idx"), F.col("document_data.pages").alias("pages")))).otherwise(F.array())
    entries = F.coalesce(
        F.transform("files", lambda f, i: F.struct((i + 1).cast("int").alias("file_idx"), f["document_data"]["pages"].alias("pages"))),
        F.array(),
    )
    return df.select("env_id", F.explode(F.concat(own, entries)).alias("file")).select("env_id", "file.file_idx", "file.pages")


def shape_trees(df: DataFrame, polygons: tuple[str, ...] = ("blocks",)) -> DataFrame:
    """Run the automaton: the states of each file's pages, elements and the vertices of `polygons`.

    One row for every different tree of a file, with `versions`, the number of these: more than one where a record came
    again with other content.
    """

    def page(p: Column) -> Column:
        levels = [F.transform(p[arr], element_state).alias(level) for level, arr in LEVELS]
        corners = [F.coalesce(F.transform(p[arr], lambda b: F.transform(b["layout"]["bounding_poly"]["vertices"], vertex_state)), F.array()) for arr in polygons]
        parts = F.struct(p["dimension"].isNotNull().alias("dim"), (F.coalesce(p["text"], F.lit("")) != "").alias("text"))
        return F.struct(p.isNotNull().alias("there"), parts.alias("own"), *levels, F.concat(*corners).alias("vertex"))

    def stated(t: Column) -> Column:
        parts = [F.when(t["own"]["dim"], "dim"), F.when(t["own"]["text"], "text")] + [F.when(F.exists(t[level], lambda s: s.isNotNull()), level) for level, _ in LEVELS]
        state = F.when(t["there"], F.coalesce(F.nullif(F.concat_ws("+", *parts), F.lit("")), F.lit("hollow")))
        return F.struct(state.alias("page"), *(t[level].alias(level) for level, _ in LEVELS), t["vertex"].alias("vertex"))

    trees = with_files(df).where("pages is not null").select("env_id", "file_idx", F.transform("pages", page).alias("pages"))
    trees = trees.groupBy("env_id", "file_idx").agg(F.collect_set("pages").alias("trees"))
    return trees.select("env_id", "file_idx", F.size("trees").alias("versions"), F.explode("trees").alias("t")).select("env_id", "file_idx", "versions", F.transform("t", stated).alias("pages"))


def nodes(df: DataFrame, polygons: tuple[str, ...] = ("blocks",)) -> DataFrame:
    """All nodes of all records: the six key columns, the node's `variant` (its automaton state) and its file's `versions`.

    With `polygons` of more than one level the vertices' `elem_idx` only tells them apart, it is no place: for counts.
    """

    def row(level: str, e: Column, v: Column, state: Column) -> Column:
        return F.struct(F.lit(level).alias("elem_level"), e.cast("int").alias("elem_idx"), v.cast("int").alias("vertex_idx"), state.alias("variant"))

    def element_row(level: str, state: Column, i: Column) -> Column:
        return row(level, i, none, state)

    none = F.lit(-1)
    key = ["env_id", "file_idx", "versions"]
    pages = shape_trees(df, polygons).select(*key, F.posexplode("pages").alias("page_idx", "s")).where("s.page is not null")
    rows = [F.array(row("page", none, none, F.col("s.page")))]
    rows += [F.coalesce(F.transform(F.col("s")[level], partial(element_row, level)), F.array()) for level, _ in LEVELS]
    corners = F.transform(F.col("s.vertex"), lambda vs, b: F.coalesce(F.transform(vs, lambda s, v: row("vertex", b, v, s)), F.array()))
    rows.append(F.coalesce(F.flatten(corners), F.array()))
    return pages.select(*key, "page_idx", F.explode(F.concat(*rows)).alias("n")).where("n.variant is not null").select(*key, "page_idx", "n.*")


def keys(df: DataFrame) -> DataFrame:
    """The six key columns of every node, each once; only nodes of files that came in several versions are compared."""
    n = nodes(df)
    return n.where("versions = 1").select(*KEYS).unionByName(n.where("versions > 1").select(*KEYS).distinct())


def pages(df: DataFrame) -> DataFrame:
    """Page table with its parent keys, scalar fields and variant."""
    p = with_files(df).select("env_id", "file_idx", F.posexplode("pages").alias("page_idx", "p")).where("p is not null")
    return p.select("env_id", "file_idx", "page_idx", "p.page_number", F.col("p.dimension.width").alias("width"), F.col("p.dimension.height").alias("height"), F.col("p.text").alias("text"), page_state(F.col("p")).alias("variant")).distinct()


def elements(df: DataFrame) -> DataFrame:
    """Element table of all four levels: supertype columns, variant, and the link to its page."""

    def level(p: Column, name: str, arr: str) -> Column:
        return F.coalesce(
            F.transform(
                p[arr],
                lambda e, i: F.struct(
                    F.lit(name).alias("elem_level"), i.cast("int").alias("elem_idx"), e["text"].alias("text"), e["layout"]["text"].alias("layout_text"), e["layout"]["confidence"].alias("confidence"), e["layout"]["bounding_poly"]["vertices"].alias("vertices"), element_state(e).alias("variant")
                ),
            ),
            F.array(),
        )

    p = with_files(df).select("env_id", "file_idx", F.posexplode("pages").alias("page_idx", "p"))
    return p.select("env_id", "file_idx", "page_idx", F.explode(F.concat(*[level(F.col("p"), n, a) for n, a in LEVELS])).alias("e")).where("e.variant is not null").select("env_id", "file_idx", "page_idx", "e.*").distinct()


def vertices(df: DataFrame) -> DataFrame:
    """Vertex table of the blocks' polygons, linked to their block."""
    b = elements(df).where("elem_level = 'block'")
    return b.select("env_id", "file_idx", "page_idx", "elem_idx", F.posexplode("vertices").alias("vertex_idx", "v")).where("v is not null").select("env_id", "file_idx", "page_idx", "elem_idx", "vertex_idx", "v.x", "v.y")


def polygons(df: DataFrame) -> DataFrame:
    """Vertex table of the polygons of all four levels, linked to their element by its level and place."""
    e = elements(df).select("env_id", "file_idx", "page_idx", "elem_level", "elem_idx", F.posexplode("vertices").alias("vertex_idx", "v"))
    return e.where("v is not null").select("env_id", "file_idx", "page_idx", "elem_level", "elem_idx", "vertex_idx", "v.x", "v.y", vertex_state(F.col("v")).alias("variant"))


META = ("filename", "page_count", "chunks", "file_index", "total_files", "total_chunks", "timestamp", "mode", "file_count", "process_date")


def _own(df: DataFrame) -> list[Column]:
    """The record's own text, time and metadata; null where the table has no such column."""
    kinds = {"text": "string", "timestamp": "string", "metadata": f"struct<{','.join(f'{n}:string' for n in META)}>"}
    if "files" in df.columns:
        kinds |= {f.name: f.dataType for f in df.schema["files"].dataType.elementType.fields if f.name in kinds}
    return [F.col(n) if n in df.columns else F.lit(None).cast(k).alias(n) for n, k in kinds.items()]


def _flat_meta(meta: str) -> list[Column]:
    return [F.col(meta).isNotNull().alias("has_metadata")] + [F.col(f"{meta}.{n}").alias("metadata_timestamp" if n == "timestamp" else n) for n in META]


def records(df: DataFrame) -> DataFrame:
    """Record table: the record's own text, time and metadata, and whether it is a batch."""
    r = df.select("env_id", F.col("files").isNotNull().alias("is_batch"), F.col("document_data").isNotNull().alias("has_document"), *_own(df))
    return r.select("env_id", "is_batch", "has_document", "text", "timestamp", *_flat_meta("metadata")).distinct()


def files(df: DataFrame) -> DataFrame:
    """File table: 0 for a single record (or a record's own document_data), 1, 2, … for the entries of a batch."""
    own = df.where("document_data is not null or files is null").select("env_id", F.lit(0).alias("file_idx"), *_own(df), "document_data")
    e = df.select("env_id", F.posexplode("files").alias("i", "f")).where("f is not null")
    entries = e.select("env_id", (F.col("i") + 1).cast("int").alias("file_idx"), "f.text", "f.timestamp", "f.metadata", "f.document_data")
    cols = ["env_id", "file_idx", "text", "timestamp", *_flat_meta("metadata"), F.col("document_data").isNotNull().alias("has_document"), F.col("document_data.text").alias("document_text")]
    return own.select(*cols).unionByName(entries.select(*cols)).distinct()


def subtypes(df: DataFrame) -> DataFrame:
    """The typed subtype tables in one: every page, element and vertex with its keys, its parent's level, its variant, and
    just the columns of that variant filled."""
    blank = {n: F.lit(None).cast(k).alias(n) for n, k in (("page_number", "int"), ("width", "double"), ("height", "double"), ("text", "string"), ("layout_text", "string"), ("confidence", "double"), ("x", "double"), ("y", "double"))}
    none = F.lit(-1)

    def rows(t: DataFrame, level: Column, parent: Column, elem: Column, vertex: Column, *have: str) -> DataFrame:
        text = F.nullif(F.col("text"), F.lit("")).alias("text") if "text" in have else blank["text"]
        cols = [text if n == "text" else F.col(n) if n in have else c for n, c in blank.items()]
        return t.select("env_id", "file_idx", "page_idx", level.alias("elem_level"), elem.alias("elem_idx"), vertex.alias("vertex_idx"), parent.alias("parent_level"), "variant", *cols)

    page = rows(pages(df), F.lit("page"), F.lit("file"), none, none, "page_number", "width", "height", "text")
    element = rows(elements(df), F.col("elem_level"), F.lit("page"), F.col("elem_idx"), none, "text", "layout_text", "confidence")
    vertex = rows(polygons(df), F.lit("vertex"), F.col("elem_level"), F.col("elem_idx"), F.col("vertex_idx"), "x", "y")
    return page.unionByName(element).unionByName(vertex)


def variant_table(df: DataFrame, variant: str) -> DataFrame:
    """Subtype table of one variant: the supertype keys and only the columns that variant guarantees."""
    if variant in ("xy", "x", "y", "none"):
        return subtypes(df).where((F.col("elem_level") == "vertex") & (F.col("variant") == variant)).select(*KEYS, "parent_level", *(c for c in "xy" if c in variant and variant != "none"))
    if variant.count("-") != 2:
        parts = variant.split("+")
        keep = [*KEYS[:3], "page_number", *["width", "height"] * ("dim" in parts), *["text"] * ("text" in parts)]
        return pages(df).where(F.col("variant") == variant).select(*keep)
    text, layout, polygon = variant.split("-")
    keep = ["env_id", "file_idx", "page_idx", "elem_level", "elem_idx"]
    keep += ["text"] * (text == "text") + ["layout_text"] * (layout != "bare") + ["confidence"] * (layout in ("scored", "zeroscored"))
    keep += ["vertices"] * (polygon in ("ring", "short", "holed"))
    return elements(df).where(F.col("variant") == variant).select(*keep)
