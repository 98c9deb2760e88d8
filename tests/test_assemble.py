import json

from pyspark.sql import functions as F

from folioframe.operators import assemble, genre
from folioframe.sources.records import DOCUMENT, FILE, METADATA

SCHEMA = f"env_id long, text string, timestamp string, metadata {METADATA}, document_data {DOCUMENT}, files array<{FILE}>"


def meta(name, n):
    return (name, n) + (None,) * 8


def page(n, blocks=None, paragraphs=None, dimension=None):
    return (n, dimension, None, blocks, paragraphs, None, None)


def blk(text, y):
    return (text, (text, 0.9, ([(0.0, y), (1.0, y)],)))


def test_blocks_by_top_and_text(spark):
    doc = ("d", [page(1, [blk("b", 5.0), blk("a", 5.0), blk("top", 1.0), ("no polygon", None)]), page(2, None)])
    df = spark.createDataFrame([(1, None, None, None, doc, None)], SCHEMA)
    assert assemble.block_text(df).first().text == "top a b \n\n----- Page 2 -----\n\n"


CHUNKED = "lost\n----- Page 2 -----\ntwo\n--- Chunk 2 (Pages 16-20) ---\nlost\n----- Page 16 -----\nsixteen\n----- Page 17 -----\n\n"


def batch(spark, record_text, *files, mode=None):
    m = (None,) * 7 + (mode,) + (None,) * 2
    return spark.createDataFrame([(1, record_text, None, m, None, list(files))] * 2, SCHEMA)


def test_files_of_a_batch(spark):
    """A file's own chunks; without a document marker the text before the first chunk is lost, as is the layout."""
    files = [(CHUNKED, None, meta("a.pdf", 20), ("d", [page(17, [blk("seventeen", 0.0)])])), ("----- Page 1 -----\n x \n----- Page 2 -----\n", None, None, None), (None, None, meta("c.pdf", None), None)]
    want = [
        "# Document Processing Mode: batch", "", "## File: a.pdf", "Total Pages: 20", "", "### Chunk 2 (Pages 16-20)", "", "#### Page 16", "", "sixteen", "", "#### Page 17", "", "---", "",
        "## File 2", "", "### Page 1", "", "x", "", "### Page 2", "", "---", "", "## File: c.pdf", "Total Pages: Unknown", "", "---", "",
    ]
    got = assemble.batch_markdown(batch(spark, "plain", *files, mode="batch")).collect()
    assert [r.markdown for r in got] == ["\n".join(want)]


def test_hybrid_batch(spark):
    """Bodies come from the layouts so far; a leading chunk and one behind a document marker are both written."""
    marked = CHUNKED.replace("lost\n", "--- Document 1: a.pdf (20 pages) ---\n", 1)
    files = [(marked, None, meta("a.pdf", 20), ("d", [page(1, [blk("one", 0.0)]), page(17, None, [blk("seventeen", 0.0)])])), ("--- Chunk 1 (Pages 1-1) ---\n----- Page 1 -----\nown", None, None, None)]
    first = ["#### Page 1", "", "one", "", "#### Page 2", "", "two", ""]
    want = [
        "## File: a.pdf", "Total Pages: 20", "", "### Chunk 1 (Pages 1-15)", "", *first, "### Chunk 1 (Pages 1-15)", "", *first, "### Chunk 2 (Pages 16-20)", "", "#### Page 16", "", "sixteen", "", "#### Page 17", "", "seventeen", "", "---", "",
        "## File 2", "", "### Chunk 1 (Pages 1-1)", "", "#### Page 1", "", "one", "", "---", "",
    ]
    assert assemble.batch_markdown(batch(spark, "x --- Chunk y", *files)).first().markdown == "\n".join(want)


def test_first_chunk_behind_a_document_marker(spark):
    text = "--- Document 1: a.pdf (9 pages) ---\n----- Page 1 -----\none\n--- Chunk 2 (Pages 6-9) ---\n----- Page 6 -----\nsix"
    got = assemble.batch_markdown(batch(spark, None, (text, None, None, None))).first().markdown.split("\n")
    assert got == ["## File 1", "", "### Chunk 1 (Pages 1-5)", "", "#### Page 1", "", "one", "", "### Chunk 2 (Pages 6-9)", "", "#### Page 6", "", "six", "", "---", ""]


def test_marked_texts(spark):
    rows = [
        (1, "--- Document 1: a.pdf (2 pages) ---\n----- Page 1 -----\none\n--- Document 2: b.pdf (1 pages) ---\n--- Chunk 1 (Pages 1-1) ---\n----- Page 1 -----\n"),
        (2, "lost\n--- Chunk 1 (Pages 1-1) ---\n----- Page 1 -----\nx"),
        (3, "--- Document 1: a.pdf ---\nA\n\n----- Page 1 -----\n--- Document 2\n b "),
        (4, None),
    ]
    got = {r.k: (r.route, r.markdown.split("\n")) for r in assemble.chunked_markdown(spark.createDataFrame(rows, "k long, text string"), "k").collect()}
    assert got[1] == ("documents", ["## Document 1: a.pdf", "Total Pages: 2", "", "#### Page 1", "", "one", "", "## Document 2: b.pdf", "Total Pages: 1", "", "### Chunk 1 (Pages 1-1)", "", "#### Page 1", ""])
    assert got[2] == ("chunks", ["### Chunk 1 (Pages 1-1)", "", "#### Page 1", "", "x", ""])
    assert got[3] == ("simple", ["## --- Document 1: a.pdf ---", "", "A", "### Page 1", "", "--- Document 1: a.pdf ---", "", "## --- Document 2", "", "b", "--- Document 2"]) and 4 not in got


def test_record_outputs(spark):
    line = ("Line", ("Line", 0.9, ([(1.0, 1.0), (9.0, 1.0), (9.0, 5.0), (1.0, 5.0)],)))
    rows = [(1, "t", None, meta("a.pdf", 1), ("d", [(1, (100.0, 100.0), None, None, None, [line], None)]), None), (2, "only <text>", "2024", meta("b.pdf", 1), None, None), (3, None, None, None, None, [("----- Page 1 -----\nx", None, None, None)])]
    df = spark.createDataFrame(rows, SCHEMA)
    md = {r.env_id: (r.markdown, r.status) for r in assemble.record_markdown(df).collect()}
    assert md[1][0].startswith("# Page 1") and md[2] == (None, "empty") and md[3] == ("## File 1\n\n### Page 1\n\nx\n\n---\n", "ok")
    html = {r.env_id: (r.html, r.status) for r in assemble.record_html(df).collect()}
    assert "position:absolute" in html[1][0] and html[1][1] == "ok" and html[2][1] == "fallback" and "only &lt;text&gt;" in html[2][0] and "<h3>Page 1</h3>" in html[3][0]
    p = {r.env_id: r for r in assemble.previews(df, 10).collect()}
    assert len(p) == 3 and p[3].was_truncated and p[3].markdown_preview.startswith("## File 1\n") and p[2].markdown_preview.startswith("Error:") and json.loads(p[2].json_preview)["text"] == "only <text>"


def test_routes_and_combination(spark):
    df = spark.createDataFrame([(1, "--- Chunk 1", None, None, None, [(None, None, None, ("d", None))]), (2, None, None, None, None, []), (3, None, None, None, ("d", None), None), (4, "t", None, None, None, None), (5, "", None, None, None, None)], SCHEMA)
    got = df.select("env_id", assemble.conversion_route(F.col("text"), F.col("files"), F.col("document_data")).alias("r")).collect()
    assert [r.r for r in sorted(got)] == ["hybrid", "files", "academic", "text", "none"]
    parts = spark.createDataFrame([("f", 1, "b", "failed"), ("f", 0, "a", "ok")], "file string, chunk_idx int, text string, status string")
    assert assemble.combined_text(parts).first().text == "a[Chunk 2 could not be processed]"
    chunks = spark.createDataFrame([("f", 1, ["x", "y"])], "file string, chunk_idx int, pages array<string>")
    assert [(r.page_number, r.page) for r in assemble.combined_pages(chunks).collect()] == [(16, "x"), (17, "y")]


def test_clusters_zones_and_masks(spark):
    one = spark.range(1)
    assert one.select(assemble.value_clusters(F.array(*map(F.lit, (0.0, 50.0, 200.0, 0.0))), 50).alias("c")).first().c == [50 / 3, 200.0]
    z = one.select(assemble.zones(F.lit(1000.0), F.lit(1000.0), slack=0.02).alias("z")).first().z
    assert tuple(round(v, 6) for v in z) == (80.0, 30.0, 920.0, 970.0)
    assert [one.select(assemble.masking(F.lit(x).cast("boolean")).alias("m")).first().m for x in (True, False, None)] == ["crop", "mask", "mask"]


def test_content_types_need_three_lines(spark):
    df = spark.createDataFrame([(1, "short line\nshort line"), (2, "short line\nshort lime\nshort lane"), (3, "x" * 50 + "\n" + "x" * 51 + "\n" + "x" * 52), (4, "a\nlonger than the first\nb")], "k long, text string")
    assert {r.k: r.content_type for r in assemble.content_type(genre.lines(df, "k"), "k").collect()} == {1: "prose", 2: "poetry", 3: "prose", 4: "prose"}
