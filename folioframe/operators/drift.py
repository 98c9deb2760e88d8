"""Schemas that drift between files: tagged-union inference over JSON records.

Every payload is parsed once where it lies and fused against the base layout.  Per path the alternatives that occur are
kept as tags (JSON kind and value form), a field missing under its base name is matched with an unknown field of the
same object by evidence from all payloads (how often the two exclude each other, and whether their value forms or names
agree), and conflicts are split into typed branches beside a canonical value.

`observe` emits narrow tagged observations; `aliases` decides renames from counts over the whole table; `changes` names
every change per payload; `conform` reads all payloads into one consistent table; `alternatives` reports the tags.

Defined results: null payloads, null ids and payloads that are not one complete JSON object give no rows of change (in
`conform` they come out with `is_complete` false); a null value is never a change of kind; repeated payloads give their
rows once; unknown shapes of the base table are ignored; empty tables give empty tables.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A rename needs the old name missing in at least this share of the objects that have the new name.
EXCLUSION = 0.9
#: … and at least this share of the new name's values in a form that the old name's values have.
FORM_SHARE = 0.3
#: An unknown container is a missing one renamed if the base knows at least this share of its fields.
RESEMBLANCE = 0.3

OBS = "file_id long, what string, shape string, path string, name string, kind string, form string, occ int, n long, cands array<struct<base:string,missing:boolean,similar:boolean>>"


def kind_of(v: object) -> str:
    """JSON kind; whole and fractional numbers are one kind."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, str):
        return "string"
    if isinstance(v, int | float):
        return "number"
    return "object" if isinstance(v, dict) else "array"


def form_of(v: object) -> str:
    """The form of a value: kind, and the character classes of a string (running text is one form), the digits of a number,
    the fields of an object, or the kinds of an array's entries; all of the value counts."""
    k = kind_of(v)
    if k == "string":
        runs = re.sub(r"\s+", " ", re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", "a", v)))
        return "s:text" if runs.count(" ") > 4 else "s:" + runs
    if k == "number":
        return f"n:{len(str(abs(int(v))))}" if abs(v) < 1e18 else "n:big"
    if k == "object":
        return "o:" + ",".join(sorted(v))
    if k == "array":
        return "a:" + ("+".join(sorted(set(map(kind_of, v)))) or "empty")
    return k


def words_of(name: str) -> list[str]:
    """A field name's words, whatever its notation."""
    return [w for w in re.split(r"[^0-9a-z]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()) if w]


def similar(a: str, b: str) -> bool:
    """Names that are one word sequence in another notation, or share a word or word stem."""
    x, y = words_of(a), words_of(b)
    return "".join(x) == "".join(y) or any(min(len(p), len(q)) >= 4 and p[: max(4, min(len(p), len(q)) - 2)] == q[: max(4, min(len(p), len(q)) - 2)] for p in x for q in y)


class Layout:
    """The base layout of one shape: kinds, required flags and children by parent path."""

    def __init__(self, rows: list[tuple[str, str, bool]]):
        self.kind = {p: k for p, k, _ in rows}
        self.required = {p: bool(r) for p, _, r in rows}
        self.children: dict[str, dict[str, str]] = {}
        for p in self.kind:
            parent, _, leaf = p.rpartition(".")
            self.children.setdefault(parent, {})[leaf] = p
        self.inner = {p: set(self.children.get(p if k == "object" else p + "[]", {})) for p, k in self.kind.items() if k in ("object", "array")}

    def entries(self, value: object) -> list[dict]:
        """The entries of a collection, whatever it is kept in."""
        vs = value if isinstance(value, list) else list(value.values()) if isinstance(value, dict) else []
        return [v for v in vs if isinstance(v, dict)]

    def resembles(self, value: object, path: str) -> float:
        """Share of the value's fields that the base container at `path` knows."""
        inner = self.inner.get(path)
        if not inner:
            return 0.0
        if isinstance(value, str):
            if value[:1] not in "{[":
                return 0.0
            try:
                value = json.loads(value)
            except ValueError:
                return 0.0
        if self.kind[path] == "array":
            es = self.entries(value)
            fields = [f for e in es for f in e.items()]
            if isinstance(value, dict) and len(es) < len(value):
                return 0.0
        else:
            fields = list(value.items()) if isinstance(value, dict) else []
        at = path if self.kind[path] == "object" else path + "[]"
        deep = [p for p in self.children.get(at, {}).values() if self.inner.get(p)]

        def known(k: str, v: object) -> bool:
            if any(k == b or "".join(words_of(k)) == "".join(words_of(b)) for b in inner):
                return True
            return isinstance(v, dict | list) and any(self.resembles(v, p) >= 0.5 for p in deep)  # a container told by its own fields

        return sum(known(k, v) for k, v in fields) / len(fields) if fields else 0.0


def parse(text: object) -> dict | None:
    """The payload as one JSON object, or None where it is null, cut off or something else."""

    def no(_: str) -> None:
        raise ValueError

    try:
        v = json.loads(text, parse_constant=no) if isinstance(text, str) else None
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def containers(lay: Layout, path: str, obj: dict) -> dict[str, str]:
    """Unknown fields of an object that are base containers under another name, told by their structure."""
    kids = lay.children.get(path, {})
    free = {leaf: p for leaf, p in kids.items() if leaf not in obj and p in lay.inner}
    found: dict[str, str] = {}
    scored = sorted(((s, n, leaf) for n, v in obj.items() if n not in kids and isinstance(v, str | dict | list) for leaf, p in free.items() if (s := lay.resembles(v, p)) >= RESEMBLANCE), reverse=True)
    for _, n, leaf in scored:
        if n not in found and leaf not in found.values():
            found[n] = leaf
    return found


def shape_of(layouts: dict[str, Layout], obj: dict) -> str:
    """A payload with a collection of files is a batch."""
    lay = layouts.get("batch")
    if lay and ("files" in obj or "files" in containers(lay, "", obj).values()):
        return "batch"
    return "single"


def fuse(lay: Layout, obj: dict) -> tuple[set[tuple[str, str]], list[tuple], Counter]:
    """One payload against its layout: certain changes, unknown fields with their candidates, value forms."""
    certain: set[tuple[str, str]] = set()
    unknown: list[tuple] = []
    forms: Counter = Counter()
    occ = 0

    def walk(path: str, o: dict) -> None:
        nonlocal occ
        occ += 1
        kids = lay.children.get(path, {})
        moved = containers(lay, path, o)
        values = {leaf: o[leaf] for leaf in kids if leaf in o} | {leaf: o[n] for n, leaf in moved.items()}
        for leaf in moved.values():
            certain.add(("renamed", kids[leaf]))
        cands = [{"base": p, "missing": leaf not in values, "similar": False} for leaf, p in kids.items() if leaf not in moved.values()]
        new = [n for n in o if n not in kids and n not in moved]
        for n in new:
            unknown.append((path, n, kind_of(o[n]), form_of(o[n]), occ, [c | {"similar": similar(n, c["base"].rpartition(".")[2])} for c in cands]))
        for leaf, p in kids.items():
            if leaf not in values:
                if lay.required[p]:
                    unknown.append((path, None, None, None, occ, [{"base": p, "missing": True, "similar": False}]))
                continue
            v = values[leaf]
            forms[(p, form_of(v))] += 1
            k = kind_of(v)
            if k not in ("null", lay.kind[p]):
                certain.add(("retyped", p))
            if not lay.inner.get(p):  # nothing is compared below it
                continue
            if lay.kind[p] == "object" and k == "object":
                walk(p, v)
            elif lay.kind[p] == "array":
                for e in lay.entries(v):
                    walk(p + "[]", e)

    walk("", obj)
    return certain, unknown, forms


def _layouts(base: list[tuple[str, str, str, bool]]) -> dict[str, Layout]:
    shapes: dict[str, list] = {}
    for s, p, k, r in base:
        shapes.setdefault(s, []).append((p, k, r))
    return {s: Layout(rows) for s, rows in shapes.items()}


def base_rows(schema_fields: DataFrame) -> list[tuple]:
    """The base layout (a fixed table; refused beyond 10,000 fields)."""
    rows = schema_fields.select("shape", "field_path", "json_kind", "is_required").take(10_001)
    if len(rows) > 10_000:
        raise ValueError("base layout has more than 10,000 fields")
    return [tuple(r) for r in rows]


def observe(raw: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """Tagged observations of all payloads, parsed where they lie."""
    base = base_rows(schema_fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        layouts = _layouts(base)
        for pdf in batches:
            out: list[tuple] = []
            forms: Counter = Counter()
            for fid, text in zip(pdf["file_id"], pdf["payload"], strict=True):
                obj = parse(text)
                if obj is None or pd.isna(fid):
                    continue
                shape = shape_of(layouts, obj)
                lay = layouts.get(shape)
                if lay is None:
                    continue
                certain, unknown, seen = fuse(lay, obj)
                forms.update({(shape, *k): n for k, n in seen.items()})
                out += [(int(fid), what, shape, p, None, None, None, None, 1, None) for what, p in certain]
                out += [(int(fid), "unknown" if n else "missing", shape, path, n, k, f, occ, 1, cands) for path, n, k, f, occ, cands in unknown]
            out += [(None, "form", shape, p, p.rpartition(".")[2], None, f, None, n, None) for (shape, p, f), n in forms.items()]
            yield pd.DataFrame(out, columns=["file_id", "what", "shape", "path", "name", "kind", "form", "occ", "n", "cands"], dtype=object)

    return raw.select("file_id", "payload").mapInPandas(run, OBS)


def _leaf(c: str) -> F.Column:
    return F.element_at(F.split(F.col(c), r"\."), -1)


def aliases(obs: DataFrame) -> DataFrame:
    """Renames by evidence over all payloads: (parent leaf, new name) → base leaf."""
    unknown = obs.where("what = 'unknown'").select(_leaf("path").alias("parent"), "name", "form", F.explode("cands").alias("c")).select("parent", "name", "form", F.expr("element_at(split(c.base, '[.]'), -1)").alias("base"), "c.missing", "c.similar")
    counts = unknown.groupBy("parent", "name", "form", "base", "similar").agg(F.count("*").alias("n"), F.sum(F.col("missing").cast("int")).alias("gone"))
    known = obs.where("what = 'form'").groupBy(F.col("name").alias("base"), "form").agg(F.sum("n").alias("seen"))
    pairs = (
        counts.join(known, ["base", "form"], "left")
        .groupBy("parent", "name", "base")
        .agg(F.sum("n").alias("n"), F.sum("gone").alias("gone"), F.sum(F.when(F.col("seen").isNotNull() & (F.col("form") != "null"), F.col("n")).otherwise(0)).alias("agree"), F.bool_or("similar").alias("similar"))
        .where((F.col("gone") >= EXCLUSION * F.col("n")) & (F.col("similar") | (F.col("agree") >= FORM_SHARE * F.col("n"))))
    )
    best = Window.partitionBy("parent", "name").orderBy(F.desc("similar"), F.desc(F.col("agree") / F.col("n")), F.desc(F.col("gone") / F.col("n")), "base")
    return pairs.withColumn("r", F.row_number().over(best)).where("r = 1").select("parent", "name", F.col("base").alias("base_leaf"))


def resolved(obs: DataFrame) -> DataFrame:
    """The unknown fields with the base path they stand for, null for added ones."""
    key = ["file_id", "path", "occ"]
    unknown = obs.where("what = 'unknown'").select(*key, "shape", "name", "kind", "cands", _leaf("path").alias("parent")).join(aliases(obs), ["parent", "name"], "left")
    hit = F.get(F.filter("cands", lambda c: c["missing"] & (F.element_at(F.split(c["base"], r"\."), -1) == F.col("base_leaf"))), F.lit(0))["base"]
    unknown = unknown.withColumn("base", hit)
    # one new name per missing field of an object; a second candidate counts as added
    first = Window.partitionBy(*key, "base").orderBy("name")
    return unknown.withColumn("r", F.dense_rank().over(first)).withColumn("base", F.when(F.col("r") == 1, F.col("base"))).drop("r")


def changes(raw: DataFrame, schema_fields: DataFrame, obs: DataFrame | None = None) -> DataFrame:
    """Every change of every payload: distinct (file_id, field_path, change_kind)."""
    obs = observe(raw, schema_fields) if obs is None else obs
    base = raw.sparkSession.createDataFrame([(s, p, k) for s, p, k, _ in base_rows(schema_fields)], "shape string, base string, base_kind string").select("base", "base_kind").distinct()
    certain = obs.where("what in ('renamed', 'retyped')").select("file_id", F.col("path").alias("field_path"), F.col("what").alias("change_kind"))
    key = ["file_id", "path", "occ"]
    unknown = resolved(obs)
    renamed = unknown.where("base is not null").join(base, "base")
    added = unknown.where("base is null").select("file_id", F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws(".", "path", "name")).alias("field_path"), F.lit("added").alias("change_kind"))
    retyped = renamed.where("kind <> 'null' and kind <> base_kind").select("file_id", F.col("base").alias("field_path"), F.lit("retyped").alias("change_kind"))
    missing = obs.where("what = 'missing'").select(*key, F.col("cands")[0]["base"].alias("base")).join(renamed.select(*key, "base"), [*key, "base"], "left_anti")
    removed = missing.select("file_id", F.col("base").alias("field_path"), F.lit("removed").alias("change_kind"))
    moved = renamed.select("file_id", F.col("base").alias("field_path"), F.lit("renamed").alias("change_kind"))
    return certain.unionByName(moved).unionByName(retyped).unionByName(added).unionByName(removed).distinct()


def alternatives(obs: DataFrame) -> DataFrame:
    """The tags of each base path of a shape: value kinds that occur and how often, over all payloads, whatever the field's name."""
    kind = F.expr("case substr(form, 1, 2) when 's:' then 'string' when 'n:' then 'number' when 'o:' then 'object' when 'a:' then 'array' else form end")
    named = obs.where("what = 'form'").select("shape", F.col("path").alias("field_path"), kind.alias("json_kind"), "n")
    moved = resolved(obs).where("base is not null").select("shape", F.col("base").alias("field_path"), F.col("kind").alias("json_kind"), F.lit(1).cast("long").alias("n"))
    return named.unionByName(moved).groupBy("shape", "field_path", _leaf("field_path").alias("name"), "json_kind").agg(F.sum("n").alias("n_values"))


#: A value as it came: its kind, its JSON, and the branch of its kind (objects and arrays in `json` alone).
BRANCH = "struct<kind:string,json:string,text:string,number:double,boolean:boolean>"
PAGE_LISTS = ("blocks", "paragraphs", "lines", "tokens")
PAGE = (
    "struct<page_idx:int,page_number:bigint,dimension:string,text:string,blocks:array<string>,paragraphs:array<string>,lines:array<string>,tokens:array<string>,"
    f"branches:map<string,{BRANCH}>,extra:map<string,string>>"
)
CONFORMED = (
    "file_id long, is_complete boolean, shape string, file_idx int, text string, timestamp string, timestamp_number double, filename string, mode string, process_date string, "
    "page_count long, page_count_string string, file_index long, total_files long, chunks long, n_pages int, document_text string, extra map<string,string>, "
    f"batch_text string, batch_timestamp string, batch_total_files long, file_count long, total_chunks long, pages array<{PAGE}>, branches map<string,{BRANCH}>"
)
COLUMNS = [c.split()[0] for c in re.split(r", (?=\w+ )", CONFORMED)]
_FILE = ("text", "timestamp", "metadata", "document_data", "document_data.text", "document_data.pages")
_META = ("filename", "page_count", "file_index", "total_files", "chunks")
_PAGES = tuple(f"document_data.pages[].{n}" for n in ("page_number", "dimension", "text", *PAGE_LISTS))
#: Base paths that have a column; any other base field comes out in `extra`.
PLACED = {
    "single": {*_FILE, *_PAGES, *(f"metadata.{n}" for n in (*_META, "mode", "process_date", "file_count", "total_chunks"))},
    "batch": {"text", "metadata", "files", *(f"metadata.{n}" for n in ("mode", "process_date", "file_count", "total_files", "total_chunks", "timestamp")), *(f"files[].{n}" for n in (*_FILE, *_PAGES, *(f"metadata.{m}" for m in _META)))},
}


def whole(v: object) -> int | None:
    """A whole number, also one written as text, that a long can hold."""
    try:
        n = v if isinstance(v, int) and not isinstance(v, bool) else int(v.strip()) if isinstance(v, str) and re.fullmatch(r"[+-]?\d+", v.strip()) else float(str(v).strip())
        return int(n) if n == int(n) and abs(n) < 2**63 else None
    except (ValueError, OverflowError):
        return None


def iso(v: object) -> str | None:
    """A time as ISO text, also one given as a number of seconds."""
    if isinstance(v, int | float) and not isinstance(v, bool):
        try:
            return pd.Timestamp(v, unit="s").isoformat()
        except (ValueError, OverflowError):
            return None
    return v if isinstance(v, str) else None


def dumped(v: object) -> str:
    return json.dumps(v, ensure_ascii=False)


def plain(v: object) -> str | None:
    """A text, or the JSON of another value."""
    return v if v is None or isinstance(v, str) else dumped(v)


def opened(v: object) -> object:
    """A container, also one kept as JSON text."""
    if isinstance(v, str) and v.lstrip()[:1] in ("{", "["):
        try:
            return json.loads(v)
        except (ValueError, RecursionError):
            return v
    return v


def places(v: object) -> list:
    """The entries of a collection in their places, whatever it is kept in."""
    v = opened(v)
    return v if isinstance(v, list) else list(v.values()) if isinstance(v, dict) else []


def branch(v: object) -> dict:
    k = kind_of(v)
    number = None
    if k == "number":
        try:
            number = float(v)
        except OverflowError:  # in `json` alone
            pass
    return {"kind": k, "json": dumped(v), "text": v if k == "string" else None, "number": number, "boolean": v if k == "boolean" else None}


class Conformer:
    """Payloads as rows: each value in its column, in a typed branch where it is in conflict with the base, or in `extra`."""

    def __init__(self, base: list[tuple], names: dict[tuple[str, str], str]):
        self.layouts, self.names = _layouts(base), names

    def fields(self, shape: str, lay: Layout, path: str, o: object, extra: dict, branches: dict) -> dict:
        """The base fields of an object by their base names."""
        o = opened(o)
        if not isinstance(o, dict):
            return {}
        kids, moved, got = lay.children.get(path, {}), containers(lay, path, o), {}
        for n, v in sorted(o.items(), key=lambda x: x[0] not in kids):  # base names come before other names
            leaf = n if n in kids else moved.get(n) or self.names.get((path.rpartition(".")[2], n))
            if leaf not in kids or leaf in got or kids[leaf] not in PLACED.get(shape, ()):
                extra[f"{path}.{n}".lstrip(".")] = dumped(v)
                continue
            got[leaf] = v
            k, want = kind_of(v), lay.kind[kids[leaf]]
            if k not in ("null", want) or want == "number" and k == "number" and whole(v) is None:
                branches[kids[leaf]] = branch(v)
        return got

    def entries(self, path: str, value: object, extra: dict) -> list[tuple[int, dict]]:
        """The objects of a collection with their places; other entries, but null, go to `extra`."""
        out = []
        for i, e in enumerate(places(value)):
            if isinstance(opened(e), dict):
                out.append((i, e))
            elif e is not None:
                extra[f"{path}[{i}]"] = dumped(e)
        return out

    def page(self, shape: str, lay: Layout, path: str, i: int, o: object) -> dict:
        extra: dict[str, str] = {}
        branches: dict[str, dict] = {}
        got = self.fields(shape, lay, path, o, extra, branches)
        lists = {n: [dumped(e) for e in places(got[n])] if isinstance(opened(got.get(n)), list | dict) else None for n in PAGE_LISTS}
        return {"page_idx": i, "page_number": whole(got.get("page_number")), "dimension": None if got.get("dimension") is None else dumped(opened(got["dimension"])), "text": plain(got.get("text")), **lists, "branches": branches, "extra": extra or None}

    def rows(self, fid: int | None, text: object) -> list[tuple]:
        obj = parse(text)
        if obj is None:
            return [(fid, False) + (None,) * (len(COLUMNS) - 2)]
        shape = shape_of(self.layouts, obj)
        lay = self.layouts.get(shape) or Layout([])
        shared: dict[str, str] = {}
        common: dict[str, dict] = {}
        root = self.fields(shape, lay, "", obj, shared, common)
        top = self.fields(shape, lay, "metadata", root.get("metadata"), shared, common)
        batch = shape == "batch"
        parts = [(i + 1, e) for i, e in self.entries("files", root.get("files"), shared)] if batch else []
        out = []
        for i, entry in parts or [(0, None)]:
            extra, branches = dict(shared), dict(common)
            at = "files[]." if entry is not None else ""
            part = self.fields(shape, lay, "files[]", entry, extra, branches) if at else root
            meta = self.fields(shape, lay, at + "metadata", part.get("metadata"), extra, branches) if at else top
            doc = self.fields(shape, lay, at + "document_data", part.get("document_data"), extra, branches)
            at += "document_data.pages"
            found = self.entries(at, doc.get("pages"), extra)
            pages = [self.page(shape, lay, at + "[]", k, e) for k, e in found] if isinstance(opened(doc.get("pages")), list | dict) else None
            ts, pc = part.get("timestamp", top.get("timestamp")), meta.get("page_count")
            out.append((
                fid, True, shape, i, plain(part.get("text")), iso(ts), branch(ts)["number"], plain(meta.get("filename")), plain(top.get("mode")), plain(top.get("process_date")),
                whole(pc), pc if isinstance(pc, str) else None, whole(meta.get("file_index")), whole(meta.get("total_files", top.get("total_files"))), whole(meta.get("chunks")),
                None if pages is None else len(pages), plain(doc.get("text")), extra or None,
                plain(root.get("text")) if batch else None, iso(top.get("timestamp")) if batch else None, whole(top.get("total_files")) if batch else None, whole(top.get("file_count")), whole(top.get("total_chunks")), pages, branches or None,
            ))
        return out


def conform(raw: DataFrame, schema_fields: DataFrame, obs: DataFrame | None = None) -> DataFrame:
    """All payloads in one table, a row per file: canonical values, pages nested, and typed branches of values in conflict.

    A number given as text comes out canonical as a number, a time given as a number of seconds as ISO text; every value
    that is not of its base kind, or no whole number that a long holds, is kept as it came in `branches` by its base path.
    Elements of pages, inside which nothing is compared, come out as JSON, one string each.  Everything the base lacks is
    kept in `extra` as JSON, fields of a page in the page's own `extra`.
    """
    obs = observe(raw, schema_fields) if obs is None else obs
    base = base_rows(schema_fields)
    rows = aliases(obs).take(20_001)
    if len(rows) > 20_000:
        raise ValueError("more than 20,000 renamed fields")
    names = {(r["parent"], r["name"]): r["base_leaf"] for r in rows}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Conformer(base, names)
        for b in batches:
            out = [r for fid, text in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in model.rows(fid, text)]
            items = lambda m: None if m is None else list(m.items())
            for r in out:
                for p in r[COLUMNS.index("pages")] or ():
                    p["branches"], p["extra"] = items(p["branches"] or None), items(p["extra"])
            cols = [[items(r[i]) if c in ("extra", "branches") else r[i] for r in out] for i, c in enumerate(COLUMNS)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds, strict=True)], COLUMNS)

    kinds = to_arrow_schema(StructType.fromDDL(CONFORMED))
    return raw.select(F.col("file_id").cast("long").alias("file_id"), "payload").mapInArrow(run, CONFORMED)
