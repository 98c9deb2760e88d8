from pyspark.sql import functions as F

from folioframe.functions import text as T
from folioframe.operators import extract, genre, jobs, layout, markers, render, template
from folioframe.sources.records import DOCUMENT, FILE, METADATA


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def line(text, x, y, h=20.0):
    return (text, (text, 0.9, ([(x, y), (x + 50, y), (x + 50, y + h), (x, y + h)],)))


def envelope(spark, lines, dimension=None):
    page = (1, dimension, None, None, None, lines, None)
    return spark.createDataFrame([(1, "t", None, ("d", [page]), None)], f"env_id long, text string, metadata {METADATA}, document_data {DOCUMENT}, files array<{FILE}>")


def test_text_functions(spark):
    assert one(spark, T.strip(F.col("a")), a="　 x\ny\t ") == "x\ny"
    assert [one(spark, T.is_upper(F.col("a")), a=v) for v in ("ΣΩ 1", "Ab", "12", "")] == [True, False, False, False]
    assert one(spark, T.is_reference(F.col("a")), a="12 Themistius Or.") and not one(spark, T.is_reference(F.col("a")), a="12 Σωκράτης x")
    assert one(spark, T.is_footnote_marker(F.col("a")), a="* note") and not one(spark, T.is_footnote_marker(F.col("a")), a="1 2")
    assert one(spark, T.html_escape_quotes(F.col("a")), a="<a href='x'>&\"") == "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"
    assert [one(spark, T.band(F.lit(y))) for y in (12.5, 62.5, 17.5)] == [10, 60, 20]
    assert one(spark, T.nfc("a"), a="é") == "é"
    assert one(spark, T.squeeze_lines(F.col("a")), a="  a \t b\n\n c ") == "a b\n\nc"


def test_indent_clusters_follow_the_running_mean(spark):
    e = envelope(spark, [line(str(i), x, 10.0 * i) for i, x in enumerate((300.0, 100.0, 140.0, 170.0, 100.0))])
    lines = layout.positioned(e)
    assert layout.indent_centres(lines).first().centres == [120.0, 170.0, 300.0]
    assert [r.indent_level for r in layout.indented(lines).orderBy("elem_idx").collect()] == [2, 0, 0, 1, 0]


def test_order_types_and_footnotes(spark):
    lines = [line("7", 10.0, 0.0), line("BOOK ONE", 10.0, 30.0), line("b", 60.0, 60.0), line("a", 10.0, 60.0), line("1 Note text", 10.0, 60.0), line("12 Themistius Or. 3", 10.0, 90.0), line("* note here", 10.0, 900.0), line("last", 10.0, 921.0), line("  ", 0.0, 5.0)]
    e = envelope(spark, lines)
    got = [(r.text, r.elem_type) for r in layout.classified(layout.positioned(e)).orderBy("reading_rank").collect()]
    assert got == [("7", "page_number"), ("BOOK ONE", "header"), ("a", "line"), ("1 Note text", "reference"), ("b", "line"), ("12 Themistius Or. 3", "reference"), ("* note here", "footnote"), ("last", "footnote")]
    assert layout.detected_page_numbers(layout.positioned(e)).first().page_number == 7
    md = render.academic_markdown(e).first().markdown
    assert md.startswith("# Page 7\n\n<!-- Page dimensions: 0.79cm x 12.45cm -->\n\n**7**\n") and "*Footnotes:*\n\n   * note here\n   last" in md and md.endswith("\n\n---\n")


def test_declared_extent(spark):
    r = layout.page_extents(envelope(spark, [line("a", 1.0, 1.0)], (1000.0, 1400.0))).first()
    assert (round(r.width_cm, 2), round(r.height_cm, 2)) == (13.23, 18.52)
    r = layout.page_extents(envelope(spark, None), default_cm=(21.0, 29.7)).first()
    assert (r.width_px, r.height_cm) == (1000.0, 29.7)


def test_markers(spark):
    text = "lost\n--- Document 1: a.pdf (20 pages) ---\n----- Page 1 -----\none\n--- Chunk 2 (Pages 16-20) ---\n----- Page 16 -----\n\n"
    df = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "k long, text string")
    assert [(r.page_number, r.body) for r in markers.pages(df, "k").orderBy("ord").collect()] == [(1, "one\n--- Chunk 2 (Pages 16-20) ---"), (16, "")]
    assert [(r.chunk_no, r.page_from, r.page_to) for r in markers.chunks(df, "k").collect()] == [(2, 16, 20)]
    assert [(r.name, r.n_pages) for r in markers.documents(df, "k").collect()] == [("a.pdf", 20)]
    assert [r.markdown for r in markers.line_headings(df.where("k = 1"), "k").orderBy("line_no").collect()][:3] == ["lost", "## --- Document 1: a.pdf (20 pages) ---", "### Page 1"]
    plan = spark.range(1).select(F.explode(markers.split_plan(F.lit(20))).alias("x")).select("x.*").collect()
    assert [(r.page_from, r.page_to) for r in plan] == [(1, 15), (16, 20)]
    assert len(one(spark, markers.split_plan(F.lit(15)))) == 1
    adjusted = one(spark, markers.adjust_markers(F.col("a"), F.lit(3), 1), a="x\n\n----- Page 2 -----\n\ny")
    assert adjusted.startswith("----- Page 16 -----\n\n--- Chunk 2 (Pages 16-18) ---") and "----- Page 17 -----" in adjusted


def test_extraction(spark):
    page = lambda n, t, b=None: (n, None, t, b, None, None, None)
    rows = [(1, "root", None, ("d", [page(2, "two"), page(1, " one ", [(None, (" blk ", None, None))])]), None), (2, "root", None, None, None), (3, None, None, None, None), (4, "x", None, None, [("ft", None, None, None)])]
    df = spark.createDataFrame(rows, f"env_id long, text string, metadata {METADATA}, document_data {DOCUMENT}, files array<{FILE}>")
    got = {r.env_id: r.text for r in extract.document_text(df).collect()}
    assert got[1] == "\n\n----- Page 1 -----\n\none\n\nblk\n\n\n----- Page 2 -----\n\ntwo"
    assert got[2] == "root" and got[3] == extract.NO_TEXT and got[4] == "\n\n--- Document 1: File 1 ---\n\n\nft"


def test_rendering(spark):
    html = one(spark, render.markdown_to_html(F.col("a")), a="# A\n---\n\n&x")
    assert html.endswith("<body>\n<h1>A</h1>\n<hr>\n<p>&x</p>\n</body></html>")
    assert one(spark, render.preview(F.col("a"), 3), a="abcd").startswith("abc\n\n...\n\n[PREVIEW TRUNCATED: Showing 3 of 4 characters]")
    assert [one(spark, render.status(F.col("a")), a=v) for v in (" ", "Error: x", "y")] == ["empty", "error", "ok"]


def test_genre_and_template(spark):
    talk = "\n".join(f"{w}. says something of this length" for w in ("SOC", "PROT") * 6)
    verse = "\n".join("a line of verse that is short enough" for _ in range(9))
    df = spark.createDataFrame([(1, talk), (2, verse), (3, "short"), (4, "Fr. 1 [2] " + "x" * 60), (5, None)], "k long, text string")
    assert {r.k: r.genre for r in genre.hints(df, "k").collect()} == {1: "verse_speakers", 2: "verse", 3: "unknown", 4: "fragments", 5: "unknown"}
    sample = lambda n: one(spark, template.sample_pages(F.lit(n), 4))
    assert sample(5) == [0, 1, 2, 3, 4] and sample(100) == [2, 26, 50, 74] and sample(7) == [2, 3, 4]
    m = template.robust_medians(spark.createDataFrame([(1, float(v)) for v in (10, 12, 11, 13, 90)], "k long, v double"), ["k"], "v").first()
    assert (m.median, m.n_outliers) == (11, 1)
    prof = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate((5, 0, 0, 5, 0, 5))], "k long, i int, v double")
    assert [(r["first"], r["last"]) for r in template.low_runs(prof, ["k"], "i", "v", 1.0, 2).collect()] == [(1, 2)]
    assert {(r["at"], r.edge) for r in template.edges(prof, ["k"], "i", "v", 1.0).collect()} == {(0, "falling"), (3, "rising"), (3, "falling"), (5, "rising")}


def test_jobs(spark):
    assert one(spark, jobs.route(F.col("a")), a='{"files": null, "document_data": {}}') == "alternative"
    assert one(spark, jobs.route(F.col("a")), a="{") is None
    assert one(spark, jobs.endpoint(F.col("a"), "host"), a=" EU ") == "eu-host"
    runs = spark.createDataFrame([(1, i, "ok") for i in range(4)] * 2, "job_id long, run_id long, status string")
    assert [r.percent for r in jobs.progress(runs).orderBy("run_id").collect()] == [25, 50, 75, 100]
    e = spark.createDataFrame([("Connection reset",), ("Server BUSY",), ("try again later",), ("HTTP 500",), (None,)], "e string")
    assert [r.x for r in e.select(jobs.recoverable(F.col("e")).alias("x")).collect()] == [False, True, True, False, False]
    assert spark.range(1).select(jobs.recoverable(F.lit("x"), F.lit("TimeoutError")).alias("x")).first().x
    assert [one(spark, jobs.conversion_method(F.lit(n))) for n in (5 * 2**20, 5 * 2**20 + 1)] == ["regular", "large_file"]
    assert [one(spark, jobs.read_mode(F.lit(n * 2**20))) for n in (4, 5, 50)] == ["standard", "chunked", "streaming"] and [one(spark, jobs.chunk_pages(F.lit(n * 2**20))) for n in (50, 51, 101)] == [10, 7, 5]
    ago = lambda h: F.expr(f"timestamp'2024-01-03 00:00:00' - interval {h} hours")
    assert [one(spark, jobs.stale(F.lit(n), ago(h), ago(0))) for n, h in (("tmpab.pdf", 25), ("tmpab.pdf", 24), ("book.pdf", 99))] == [True, False, False]
    assert [one(spark, jobs.job_status(F.lit(k).cast("string"))) for k in (None, "InvalidArgument", "NotFound", "Other")] == ["ok", "invalid_argument", "processor_not_found", "failed"]


def test_profiles(spark):
    prof = spark.createDataFrame([(1, i, v) for i, v in enumerate((0.0, 0.0, 10.0, 0.0, 4.0))] + [(2, 7, 3.0)], "k long, i int, v double")
    w, v = template.gaussian_kernel(1.0), (0.0, 0.0, 10.0, 0.0, 4.0)
    assert len(w) == 9 and abs(sum(w) - 1) < 1e-12
    wide = [*v[::-1], *v, *v[::-1]]
    want = [sum(x * wide[5 + i + k - 4] for k, x in enumerate(w)) for i in range(5)]
    got = {(r.k, r.i): r.smooth for r in template.gaussian(prof, ["k"], "i", "v", 1.0).collect()}
    assert all(abs(got[1, i] - x) < 1e-9 for i, x in enumerate(want)) and abs(got[2, 7] - 3) < 1e-9
    g = template.gradient(prof, ["k"], "i", "v")
    assert {(r.k, r.i): r.gradient for r in g.collect()} == {(1, 0): 0.0, (1, 1): 5.0, (1, 2): 0.0, (1, 3): -3.0, (1, 4): 4.0, (2, 7): 0.0}
    assert {(r.k, r.i) for r in template.transitions(g, ["k"], "i", 3.0).collect()} == {(1, 1), (1, 4)}


def test_positions_of_markers(spark):
    text = "ab----- Page 1 -----x\u00e9y----- Page 22 -----"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "k long, text string")
    got = [(r.ord, r.begin, r.stop, r.body_end) for r in markers.spans(df, "k", markers.PAGE).orderBy("ord").collect()]
    assert got == [(0, 2, 20, 23), (1, 23, 42, 42)] and len(text) == 42
    nest = spark.createDataFrame([(1, "----- Page 9 -----\n--- Document 1: a (2 pages) ---\n--- Chunk 3 (Pages 1-2) ---\n----- Page 1 -----\n--- Document 2: b (1 pages) ---\n----- Page 2 -----")], "k long, text string")
    assert [(r.document_no, r.chunk_no, r.page_number) for r in markers.nested_pages(nest, "k").orderBy("ord").collect()] == [(None, None, 9), (1, 3, 1), (2, None, 2)]


def test_anchor_segments(spark):
    df = spark.createDataFrame([("ae\u0301b", [(1, 3), (2, 2), (3, 1), (0, 1)]), ("x", []), ("xy", [(1, 1)])], "t string, s array<struct<begin:int,stop:int>>")
    got = df.select(extract.anchored(F.col("t"), F.col("s")).alias("a"), extract.anchored_nfc(F.col("t"), F.col("s")).alias("b"), extract.first_segment(F.col("t"), F.col("s")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("e\u0301a", "\u00e9 a", "e\u0301"), ("", "", None), ("", "", None)]
