import json
import time
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioframe import runtime
from folioframe.operators import layout
from folioframe.sources import records
from folioframe.streaming import batch


def test_json_round_trip_and_quarantine(spark, tmp_path):
    good = {"text": "a", "metadata": {"filename": "f.pdf", "page_count": 1}, "document_data": {"text": "d", "pages": [{"page_number": 1}]}}
    for name, body in (("a", json.dumps(good)), ("b", "{broken"), ("c", json.dumps({"text": "root", "pages": [{"page_number": 3}]})), ("d", json.dumps({"files": None, "document_data": {}}))):
        (tmp_path / f"{name}.json").write_text(body, encoding="utf-8")
    got = {r.path.rsplit("/", 1)[1]: r for r in records.read_json(spark, str(tmp_path)).collect()}
    assert got["a.json"].route == "standard" and got["a.json"].document_data.pages[0].page_number == 1
    assert got["b.json"].status == "broken" and got["c.json"].document_data.pages[0].page_number == 3
    assert got["d.json"].route == "alternative"
    back = records.to_json(records.read_json(spark, str(tmp_path / "a.json"))).first().payload
    assert json.loads(back)["document_data"] == {"text": "d", "pages": [{"page_number": 1}]}


def test_provider_and_sink(spark, tmp_path):
    (tmp_path / "p.bin").write_bytes("BOOK\nline".encode())
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.bin"))
    read = records.recognise(files, records.Echo())
    parsed = records.parse_json(read.withColumnRenamed("path", "source")).withColumnRenamed("source", "path").selectExpr("1L as env_id", "document_data", "files")
    assert [r.elem_type for r in layout.classified(layout.positioned(parsed)).orderBy("reading_rank").collect()] == ["header", "line"]

    class Bad(records.Provider):
        def recognise(self, name, content):
            raise RuntimeError("no service")

    assert records.recognise(files, Bad()).first().status == "error: RuntimeError: no service"
    rows = spark.createDataFrame([("x", "héllo"), ("y", " "), ("z", "Error: no")], "n string, c string")
    got = {r["name"]: r for r in records.save(rows, str(tmp_path / "out"), "n", "c", ".md").collect()}
    assert got["x"].status == "ok" and (tmp_path / "out" / "x.md").read_text(encoding="utf-8") == "héllo"
    assert got["y"].status == got["z"].status == "rejected"


def test_options(tmp_path):
    p = tmp_path / "o.json"
    p.write_text('{"a": 1, "b": {"c": 2}}')
    o = records.options(str(p), {"FOLIOFRAME_A": "3"}, d=4)
    assert o == {"a": "3", "b": {"c": 2}, "d": 4} and records.lookup(o, "b.c") == 2 and records.missing(o, ["b.c", "x"]) == ["x"]


def test_windows_stream_like_a_batch(spark, tmp_path, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = batch.windowed(stream, late="1 hour").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in batch.windowed(events, late="1 hour").collect()}
    assert {tuple(r) for r in spark.sql("select * from w").collect()} == want
    assert sum(r.n for r in batch.sessions(events).collect()) == events.count()


def test_rate_limit_keeps_state_over_triggers(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(pd.DataFrame(rows, columns=["service", "request_id", "asked_at"])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / name))

    t0 = pd.Timestamp("2024-01-01")
    put("a", [("s", i, t0) for i in range(3)])
    stream = spark.readStream.schema("service string, request_id long, asked_at timestamp").parquet(str(tmp_path / "in" / "*"))
    q = batch.limited(stream, calls=2, seconds=60).writeStream.outputMode("append").format("memory").queryName("lim").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    put("b", [("s", 9, t0 + pd.Timedelta(seconds=10))])
    q.processAllAvailable()
    q.stop()
    starts = {r.request_id: (r.start_at - t0.to_pydatetime()).total_seconds() for r in spark.sql("select * from lim").collect()}
    assert starts == {0: 0, 1: 0, 2: 60, 9: 60}


def test_isolated_rows(spark):
    rows = spark.createDataFrame([(1,), (0,)], "n long")
    got = {r.n: r.status for r in batch.isolated(rows, lambda r: {"n": 1 // r["n"]}, "n long").collect()}
    assert got == {1: "ok", 0: "error: ZeroDivisionError: integer division or modulo by zero"}


def test_where_json_breaks_and_envelopes(spark):
    raw = spark.createDataFrame([("a", '{"x": 1,\n "y": }'), ("b", "{}"), ("c", "[1]"), ("d", None), ("e", "")], "name string, payload string")
    assert {(r.name, r.line, r.column) for r in records.broken_at(raw).collect()} == {("a", 2, 7), ("e", 1, 1)}
    one = spark.range(1).select(records.envelope(F.lit("t"), F.struct(F.lit("f").alias("filename")), F.lit(None).cast("struct<text:string>"), F.lit("now")).alias("j")).first().j
    assert json.loads(one) == {"text": "t", "timestamp": "now", "metadata": {"filename": "f"}}


def test_pdf_pages(spark):
    page = b"1 0 obj << /Type /Page >> endobj "
    packed = b"9 0 obj << /Type /ObjStm /N 2 >> stream\n" + zlib.compress(b"<</Type/Page>> <</Type/Pages>> <</Type /Page /X 1>>") + b"\nendstream endobj "
    df = spark.createDataFrame([("a", b"%PDF-1.4 " + page * 3 + b"<< /Type /Pages >>"), ("b", b"%PDF-1.5 " + page + packed), ("c", b"text"), ("d", None)], "path string, content binary")
    assert {r.path: r.n_pages for r in records.page_counts(df).collect()} == {"a": 3, "b": 3, "c": None, "d": None}
    assert {r.path: r.status for r in records.validated(df).collect()} == {"a": "ok", "b": "ok", "c": "not_pdf", "d": "empty"}


def test_provider_errors_by_kind(spark):
    files = spark.createDataFrame([("x/bad", b"1"), ("x/gone", b"2")], "path string, content binary")

    class Strict(records.Provider):
        def recognise(self, name, content):
            raise records.InvalidArgument("pages") if name == "bad" else records.NotFound("processor")

    assert {r.path: r.status for r in records.recognise(files, Strict()).collect()} == {"x/bad": "invalid_argument: pages", "x/gone": "processor_not_found: processor"}


def test_settings_files(tmp_path):
    assert records.detected(str(tmp_path)).endswith("config.yaml" if records.yaml else "config.json")
    path = str(tmp_path / "config.json")
    records.save_settings({"a": {"b": "\u00e9"}}, path)
    assert records.load_settings(path) == {"a": {"b": "\u00e9"}} and records.detected(str(tmp_path)) == path
    (tmp_path / "ENV").write_text("# c\nexport FOLIOFRAME_KEY='v 1'\nFOLIOFRAME_A=2\nOTHER=3\nbroken\n")
    assert records.options(path, {"FOLIOFRAME_A": "5"}, env_path=str(tmp_path / "ENV")) == {"a": "5", "key": "v 1"}
    (tmp_path / "list.json").write_text("[1]")
    with pytest.raises(ValueError):
        records.load_settings(str(tmp_path / "list.json"))
    if records.yaml:
        records.save_settings({"a": [1, 2]}, str(tmp_path / "config.yaml"))
        assert records.load_settings(str(tmp_path / "config.yaml")) == {"a": [1, 2]} and records.detected(str(tmp_path)).endswith(".yaml")


def test_reconstruction_job(spark, tmp_path):
    line = {"text": "Body", "layout": {"text": "Body", "bounding_poly": {"vertices": [{"x": 1, "y": 1}, {"x": 5, "y": 1}, {"x": 5, "y": 3}]}}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"document_data": {"pages": [{"page_number": 1, "lines": [line]}]}}))
    (tmp_path / "in" / "b.json").write_text(json.dumps({"files": [], "text": "plain"}))
    (tmp_path / "in" / "c.json").write_text("{")
    got = {r["name"]: r.status for r in records.reconstruct(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    assert got == {"a": "ok", "b": "fallback"} and "Body" in (tmp_path / "out" / "a.md").read_text() and (tmp_path / "out" / "b.md").read_text() == "plain"


def test_page_stream_emits_and_signals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"document_data": {"pages": [{"page_number": 1, "text": f"p{i}"}, {"page_number": 2}]}}))
    told, seen = [], []
    signals = batch.Signals(lambda *x: told.append(x))
    spark.streams.addListener(signals)
    pages = records.stream_pages(spark, str(tmp_path / "in")).select("path", F.col("page.text").alias("text")).where("text is not null")
    q = batch.emit(pages, "path", "text", lambda df, n: seen.extend(r.text for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    time.sleep(1)
    spark.streams.removeListener(signals)
    assert sorted(seen) == ["p0", "p1", "p2"] and {"started", "progress", "ended"} <= {t[0] for t in told}


def test_streams_matched(spark, tmp_path):
    at = lambda m: (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)).to_pydatetime()
    rows = [(1, 7, "a", at(0)), (2, 7, "b", at(30)), (3, 7, "b", at(31)), (4, 8, "b", at(5)), (5, 7, "b", at(-1)), (6, None, "a", at(0))]
    spark.createDataFrame(rows, "event_id long, user_id long, kind string, ts timestamp").write.parquet(str(tmp_path / "e"))
    e = spark.read.parquet(str(tmp_path / "e"))
    pairs = lambda df, late=None: batch.matched(df.where("kind = 'a'"), df.where("kind = 'b'"), ["user_id"], "event_id", "ts", "30 minutes", late)
    assert [tuple(r) for r in pairs(e).collect()] == [(7, 1, 2)]
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = pairs(stream, "1 hour").writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.sql("select * from pairs").collect()] == [(7, 1, 2)]


def test_checkpoints_need_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Rows:
        class sparkSession:  # noqa: N801
            sparkContext = Context()
            conf = {}

    with pytest.raises(RuntimeError):
        runtime.cut(Rows())
