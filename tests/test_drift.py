import json

from folioframe.operators import drift

BASE = [
    *[("single", p, k, r) for p, k, r in (
        ("text", "string", True), ("timestamp", "string", True), ("metadata", "object", True), ("metadata.filename", "string", True), ("metadata.page_count", "number", True),
        ("document_data", "object", False), ("document_data.text", "string", True), ("document_data.pages", "array", True), ("document_data.pages[].page_number", "number", True), ("document_data.pages[].blocks", "array", True))],
    *[("batch", p, k, r) for p, k, r in (("text", "string", True), ("metadata", "object", True), ("files", "array", True), ("files[].text", "string", True), ("files[].timestamp", "string", True), ("files[].metadata", "object", True), ("files[].metadata.filename", "string", True))],
]
GOOD = {"text": "a b", "timestamp": "2024-01-01T00:00:00.5", "metadata": {"filename": "a_1.pdf", "page_count": 2}, "document_data": {"text": "a", "pages": [{"page_number": 1, "blocks": []}]}}


def run(spark, payloads):
    base = spark.createDataFrame(BASE, "shape string, field_path string, json_kind string, is_required boolean")
    rows = [(i, p if p is None or isinstance(p, str) else json.dumps(p), "x") for i, p in enumerate(payloads)]
    raw = spark.createDataFrame(rows, "file_id long, payload string, path string")
    return raw, base, {(r.file_id, r.field_path, r.change_kind) for r in drift.changes(raw, base).collect()}


def changed(**k):
    return {**GOOD, **k}


def without(d, *names):
    return {k: v for k, v in d.items() if k not in names}


def test_each_kind_of_change(spark):
    meta = GOOD["metadata"]
    payloads = [
        GOOD,
        changed(metadata={"filename": "b_2.pdf", "pageCount": "2 "}),  # renamed and retyped
        changed(extra={"deep": {"x": 1}}, timestamp=None),  # added, nothing inside; null is no change
        without(GOOD, "timestamp"),  # removed
        without(GOOD, "document_data"),  # optional
        {**without(GOOD, "document_data"), "doc": GOOD["document_data"]},  # a container told by its structure
        changed(document_data=json.dumps({"text": 1})),  # retyped, nothing inside
        changed(document_data={"text": "a", "pages": {"1": {"page_number": "1", "blocks": []}, "2": {"page_number": 2}}}),  # kept in an object
        {**without(GOOD, "timestamp"), "created": "2024-05-05T01:00:00.1"},
        {"text": "b", "metadata": {}, "items": [{"text": "c", "timestamp": 5, "metadata": meta}, {"text": "c", "timestamp": 6, "metadata": meta}]},
        '{"text": "cut',
        None,
        "[]",
        '{"text": NaN}',
    ]
    raw, base, got = run(spark, payloads)
    assert {g for g in got if g[0] in (0, 4, 10, 11, 12, 13)} == set()
    assert {g[1:] for g in got if g[0] == 1} == {("metadata.page_count", "renamed"), ("metadata.page_count", "retyped")}
    assert {g[1:] for g in got if g[0] == 2} == {("extra", "added")}
    assert {g[1:] for g in got if g[0] == 3} == {("timestamp", "removed")}
    assert {g[1:] for g in got if g[0] == 5} == {("document_data", "renamed")}
    assert {g[1:] for g in got if g[0] == 6} == {("document_data", "retyped")}
    assert {g[1:] for g in got if g[0] == 7} == {("document_data.pages", "retyped"), ("document_data.pages[].page_number", "retyped"), ("document_data.pages[].blocks", "removed")}
    assert {g[1:] for g in got if g[0] == 8} == {("timestamp", "renamed")}
    assert {g[1:] for g in got if g[0] == 9} == {("files", "renamed"), ("files[].timestamp", "retyped"), ("files[].metadata.page_count", "added")}
    table = {r.file_id: r for r in drift.conform(raw, base).where("file_idx is null or file_idx < 2").collect()}
    assert table[1].page_count == 2 and table[1].page_count_string == "2 "
    assert table[10].is_complete is False and table[8].timestamp == "2024-05-05T01:00:00.1"
    assert json.loads(table[2].extra["extra"]) == {"deep": {"x": 1}}


def test_repeats_and_empty(spark):
    _, _, got = run(spark, [without(GOOD, "text")] * 2)
    assert got == {(0, "text", "removed"), (1, "text", "removed")}
    assert run(spark, [])[2] == set()


def test_alternatives(spark):
    raw, base, _ = run(spark, [GOOD, changed(timestamp=7)])
    kinds = {(r["name"], r.json_kind): r.n_values for r in drift.alternatives(drift.observe(raw, base)).collect()}
    assert kinds["timestamp", "string"] == kinds["timestamp", "number"] == 1


def test_table_keeps_every_value(spark):
    page = {"page_number": "1", "blocks": [{"text": "b", "odd": 1}, None], "stamp": {"x": 1}}
    payloads = [
        changed(document_data={"text": "a", "pages": [page, None, {"page_number": 2, "blocks": "none"}, 5]}, metadata={"filename": "a_1.pdf", "page_count": 2.5}, timestamp={"at": 1}),
        {"text": "whole batch", "metadata": {}, "files": [{"text": "c", "timestamp": 5, "metadata": {"filename": ["f"]}, "more": 1}, None, {"text": "d", "timestamp": None, "metadata": {}, "more": 2}]},
    ]
    raw, base, _ = run(spark, payloads)
    single, *files = drift.conform(raw, base).orderBy("file_id", "file_idx").collect()
    assert [p.page_idx for p in single.pages] == [0, 2] and [json.loads(b) for b in single.pages[0].blocks] == page["blocks"]
    assert single.pages[0].page_number == 1 and single.pages[0].branches["document_data.pages[].page_number"].text == "1" and json.loads(single.pages[0].extra["document_data.pages[].stamp"]) == {"x": 1}
    assert single.pages[1].branches["document_data.pages[].blocks"].text == "none" and single.extra["document_data.pages[3]"] == "5"
    assert single.page_count is None and single.branches["metadata.page_count"].number == 2.5 and json.loads(single.branches["timestamp"].json) == {"at": 1}
    assert [(r.file_idx, r.text, r.batch_text, r.extra["files[].more"]) for r in files] == [(1, "c", "whole batch", "1"), (3, "d", "whole batch", "2")]
    assert files[0].timestamp_number == 5 and json.loads(files[0].branches["files[].metadata.filename"].json) == ["f"]


def test_base_fields_without_a_column(spark):
    raw, base, _ = run(spark, [changed(note="n")])
    more = spark.createDataFrame([("single", "note", "string", True)], base.schema)
    assert json.loads(drift.conform(raw, base.unionByName(more)).first().extra["note"]) == "n"


def test_alternatives_by_path(spark):
    batch = {"text": "b", "metadata": {}, "files": [{"text": 3, "timestamp": "t", "metadata": {}}]}
    renamed = [{**without(GOOD, "timestamp"), "time_stamp": 5}] * 2
    raw, base, _ = run(spark, [GOOD, batch, *renamed])
    got = {(r["shape"], r.field_path, r.json_kind): r.n_values for r in drift.alternatives(drift.observe(raw, base)).collect()}
    assert got["batch", "text", "string"] == got["batch", "files[].text", "number"] == 1 and got["single", "document_data.text", "string"] == 3
    assert got["single", "timestamp", "string"] == 1 and got["single", "timestamp", "number"] == 2
