from folioframe.operators import nested
from folioframe.sources.records import DOCUMENT, FILE

SCHEMA = f"env_id long, document_data {DOCUMENT}, files array<{FILE}>, variant string, pages int"


def elem(text, vertices=None, conf=0.9):
    poly = None if vertices is None else (vertices,)
    return (text, (text, conf, poly))


def page(**k):
    return tuple(k.get(n) for n in ("page_number", "dimension", "text", "blocks", "paragraphs", "lines", "tokens"))


QUAD = [(0.0, 0.0), (1.0, 0.0), (1.0, None), (0.0, 1.0)]


def frame(spark, rows):
    return spark.createDataFrame([r + ("clash", 7) for r in rows], SCHEMA)


def test_nodes_keep_parents_and_places(spark):
    p = page(text="t", blocks=[elem("a", QUAD), None, elem("b")], lines=[elem("l", [])], tokens=[])
    batch = [(None, None, None, ("x", [p, None, page()])), None, (None, None, None, None)]
    rows = [(1, ("d", [p]), None), (1, ("d", [p]), None), (2, None, batch), (3, None, None), (4, (None, None), []), (None, ("d", [page()]), None)]
    got = {tuple(r) for r in nested.nodes(frame(spark, rows)).select(*nested.KEYS).collect()}

    def expect(env, file, at):
        out = {(env, file, at, "page", -1, -1), (env, file, at, "block", 0, -1), (env, file, at, "block", 2, -1), (env, file, at, "line", 0, -1)}
        return out | {(env, file, at, "vertex", 0, i) for i in range(4)}

    assert got == expect(1, 0, 0) | expect(2, 1, 0) | {(2, 1, 2, "page", -1, -1), (None, 0, 0, "page", -1, -1)}


def test_variants_and_typed_tables(spark):
    p = page(dimension=(1.0, 2.0), blocks=[elem("a", QUAD), elem(None, [(0.0, 0.0)] * 4, None), (("z"), None)])
    df = frame(spark, [(1, ("d", [p]), None)])
    states = {(r.elem_idx, r.variant) for r in nested.nodes(df).where("elem_level = 'block'").collect()}
    assert states == {(0, "text-scored-holed"), (1, "untexted-unscored-ring"), (2, "text-bare-none")}
    assert nested.nodes(df).where("elem_level = 'page'").first().variant == "dim+block"
    assert nested.variant_table(df, "text-bare-none").columns == ["env_id", "file_idx", "page_idx", "elem_level", "elem_idx", "text"]
    assert nested.vertices(df).count() == 8
    assert nested.pages(df).first().width == 1.0


def test_empty_table(spark):
    df = frame(spark, [])
    assert nested.nodes(df).count() == nested.elements(df).count() == nested.pages(df).count() == 0


def test_every_level_has_its_tables(spark):
    p = page(page_number=3, text="t", dimension=(1.0, 2.0), blocks=[elem("a", QUAD)], paragraphs=[elem("p", QUAD[:1])], lines=[elem("", [None, (5.0, 6.0)])], tokens=[elem("k", [(None, None)])])
    batch = [("own", "time", None, ("x", [p])), None, ("only text", None, None, None)]
    df = frame(spark, [(1, None, batch), (1, None, batch), (2, ("d", [p]), None)])
    got = {(r.elem_level, r.elem_idx, r.vertex_idx, r.x, r.y) for r in nested.polygons(df).where("env_id = 1").collect()}
    assert got == {("block", 0, i, *v) for i, v in enumerate(QUAD)} | {("paragraph", 0, 0, 0.0, 0.0), ("line", 0, 1, 5.0, 6.0), ("token", 0, 0, None, None)}
    rows = {(r.env_id, r.file_idx): (r.text, r.timestamp, r.has_document, r.document_text) for r in nested.files(df).collect()}
    assert rows == {(1, 1): ("own", "time", True, "x"), (1, 3): ("only text", None, False, None), (2, 0): (None, None, True, "d")}
    assert {(r.env_id, r.is_batch) for r in nested.records(df).collect()} == {(1, True), (2, False)}
    typed = nested.subtypes(df).where("env_id = 1")
    assert typed.count() == 1 + 4 + 7 and typed.where("elem_level = 'vertex' and parent_level = 'token' and variant = 'none'").count() == 1
    assert [(r.text, r.confidence, r.width) for r in typed.where("elem_level = 'line'").collect()] == [(None, 0.9, None)]
    assert nested.variant_table(df, "xy").columns[-2:] == ["x", "y"] and nested.variant_table(df, "xy").where("env_id = 1").count() == 5
    assert [r.page_number for r in nested.variant_table(df, "dim+text+block+paragraph+line+token").collect()] == [3, 3]
    assert nested.nodes(df, tuple(a for _, a in nested.LEVELS)).where("env_id = 1 and elem_level = 'vertex'").count() == 7
