"""Readers and writers of layout records: JSON files, Parquet tables, page images through a provider, rendered files."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # settings are JSON then
    yaml = None

ELEMENT = "struct<text:string,layout:struct<text:string,confidence:double,bounding_poly:struct<vertices:array<struct<x:double,y:double>>>>>"
PAGE = f"struct<page_number:int,dimension:struct<width:double,height:double>,text:string,blocks:array<{ELEMENT}>,paragraphs:array<{ELEMENT}>,lines:array<{ELEMENT}>,tokens:array<{ELEMENT}>>"
DOCUMENT = f"struct<text:string,pages:array<{PAGE}>>"
METADATA = "struct<filename:string,page_count:int,chunks:int,file_index:int,total_files:int,total_chunks:int,timestamp:string,mode:string,file_count:int,process_date:string>"
FILE = f"struct<text:string,timestamp:string,metadata:{METADATA},document_data:{DOCUMENT}>"
RECORD = f"struct<text:string,timestamp:string,metadata:{METADATA},document_data:{DOCUMENT},files:array<{FILE}>,pages:array<{PAGE}>>"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file: path, the record's columns, `route` and `status`; broken files stay as rows of status broken.

    A record without `document_data` and `files` is itself the document.
    """
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("payload"))
    return parse_json(raw)


def parse_json(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """The record's columns for a column of JSON text; key presence, not value, decides the route."""
    keys = F.json_object_keys(payload)
    r = raw.withColumn("keys", keys).withColumn("r", F.from_json(payload, RECORD))
    route = F.when(F.col("keys").isNull(), None).when(F.array_contains("keys", "files"), "alternative").when(F.array_contains("keys", "document_data"), "standard").otherwise("unknown")
    root = F.struct(F.col("r.text").alias("text"), F.col("r.pages").alias("pages"))
    document = F.when(route == "unknown", root).otherwise(F.col("r.document_data"))
    keep = [c for c in raw.columns if c != payload]
    return r.select(*keep, F.col("r.text").alias("text"), F.col("r.timestamp").alias("timestamp"), F.col("r.metadata").alias("metadata"), document.alias("document_data"), F.col("r.files").alias("files"), route.alias("route"), F.when(F.col("keys").isNull(), "broken").otherwise("ok").alias("status"))


def broken_at(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """The rows of JSON text that is no JSON, with `line`, `column` and `reason` of the first error.

    Only what the JVM's parser refuses goes through Python.
    """

    def where(text: str) -> tuple[int, int, str]:
        try:
            json.loads(text)
        except json.JSONDecodeError as e:
            return e.lineno, e.colno, e.msg
        except RecursionError:
            return 1, 1, "nested too deeply"
        return 0, 0, ""

    spot = F.pandas_udf(lambda t: pd.DataFrame(list(map(where, t)), columns=["line", "column", "reason"]), "line int, column int, reason string")
    bad = raw.where(F.col(payload).isNotNull() & F.json_object_keys(payload).isNull() & F.json_array_length(payload).isNull())
    return bad.withColumn("e", spot(payload)).where("e.line > 0").select(*[c for c in raw.columns if c != payload], "e.*")


def envelope(text: Column, metadata: Column, document: Column, timestamp: Column | None = None) -> Column:
    """A record as JSON text from its parts; an absent layout is left out, the time is the present one unless given."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if timestamp is None else timestamp
    return F.to_json(F.struct(text.alias("text"), now.alias("timestamp"), metadata.alias("metadata"), document.alias("document_data")))


def to_json(records: DataFrame, columns: tuple[str, ...] = ("text", "timestamp", "metadata", "document_data", "files")) -> DataFrame:
    """The records as JSON text; absent parts are left out."""
    have = [c for c in columns if c in records.columns]
    return records.withColumn("payload", F.to_json(F.struct(*have), {"pretty": "true"}))


class InvalidArgument(ValueError):
    """A provider refuses a request as it is: sending it again is of no use."""


class NotFound(LookupError):
    """A provider does not know the processor that a request names."""


class Provider:
    """What turns page images into records; implementations wrap a service and are passed to `recognise`."""

    def recognise(self, name: str, content: bytes) -> dict:
        raise NotImplementedError


class Echo(Provider):
    """A provider without a service: the content's own lines as the lines of one page. For tests and dry runs."""

    def recognise(self, name: str, content: bytes) -> dict:
        lines = content.decode("utf-8", "replace").split("\n")
        box = lambda i, t: {"vertices": [{"x": 100.0, "y": 60.0 + 40 * i}, {"x": 100.0 + 10 * len(t), "y": 60.0 + 40 * i}, {"x": 100.0 + 10 * len(t), "y": 80.0 + 40 * i}, {"x": 100.0, "y": 80.0 + 40 * i}]}
        elements = [{"text": t, "layout": {"text": t, "confidence": 1.0, "bounding_poly": box(i, t)}} for i, t in enumerate(lines)]
        return {"text": "\n".join(lines), "metadata": {"filename": name, "page_count": 1}, "document_data": {"text": "\n".join(lines), "pages": [{"page_number": 1, "text": " ".join(lines), "lines": elements, "blocks": elements}]}}


def recognise(files: DataFrame, provider: Provider) -> DataFrame:
    """(path, payload, status) of binary files; a file that fails comes out with its error, never failing the batch.

    The status tells what kind of failure it was: invalid_argument, processor_not_found, or another error by its name.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    out.append((path, json.dumps(provider.recognise(os.path.basename(path), bytes(content)), ensure_ascii=False), "ok"))
                except InvalidArgument as e:
                    out.append((path, None, f"invalid_argument: {e}"))
                except NotFound as e:
                    out.append((path, None, f"processor_not_found: {e}"))
                except Exception as e:  # noqa: BLE001
                    out.append((path, None, f"error: {type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "payload", "status"])

    return files.select("path", "content").mapInPandas(run, "path string, payload string, status string")


PAGE_OBJECT = re.compile(rb"/Type\s*/Page(?![A-Za-z])")
STREAM = re.compile(rb"/ObjStm\b.*?\bstream\r?\n(.*?)endstream", re.S)


def count_pages(content: bytes | None) -> int | None:
    """The pages of a PDF: its page objects, those in compressed object streams too; null for other content."""
    if content is None or b"%PDF-" not in content[:1024]:
        return None
    n = len(PAGE_OBJECT.findall(content))
    for m in STREAM.finditer(content):
        try:
            n += len(PAGE_OBJECT.findall(zlib.decompressobj().decompress(m.group(1))))
        except zlib.error:
            continue
    return n


def page_counts(files: DataFrame) -> DataFrame:
    """(path, n_pages) of binary files."""
    n = F.pandas_udf(lambda c: pd.Series([count_pages(None if x is None else bytes(x)) for x in c], dtype="Int32"), "int")
    return files.select("path", n("content").alias("n_pages"))


def validated(files: DataFrame) -> DataFrame:
    """(path, status) of binary files before they are sent: ok, empty, or not_pdf."""
    c = F.col("content")
    return files.select("path", F.when(c.isNull() | (F.octet_length(c) == 0), "empty").when(F.substring(c, 1, 5) != F.lit(b"%PDF-"), "not_pdf").otherwise("ok").alias("status"))


def with_fallback(content: Column, fallback: Column) -> Column:
    """A rendering, or where it is null, blank or an error the other one."""
    bad = content.isNull() | (F.trim(content) == "") | content.startswith("Error:")
    return F.when(bad, fallback).otherwise(content)


def save(rows: DataFrame, folder: str, name: str, content: str, suffix: str, fallback: str | None = None) -> DataFrame:
    """One file per row in a folder all executors share: (name, path, n_bytes, status); empty and failed content is not written.

    Where `fallback` names a column, that is written in place of such content, with status fallback.  Files are written
    under another name and moved, so a task that runs twice leaves one whole file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            out = []
            for n, text, other in zip(pdf["n"], pdf["c"], pdf["f"], strict=True):
                status = "ok"
                if text is None or not text.strip() or text.startswith("Error:"):
                    text, status = other, "fallback"
                if text is None or not text.strip() or text.startswith("Error:"):
                    out.append((str(n), None, 0, "rejected"))
                    continue
                path, data = os.path.join(folder, f"{n}{suffix}"), text.encode()
                part = f"{path}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, path)
                out.append((str(n), path, len(data), status))
            yield pd.DataFrame(out, columns=["name", "path", "n_bytes", "status"])

    other = F.col(fallback) if fallback else F.lit(None).cast("string")
    return rows.select(F.col(name).cast("string").alias("n"), F.col(content).alias("c"), other.alias("f")).mapInPandas(run, "name string, path string, n_bytes long, status string")


def detected(folder: str) -> str:
    """The settings file of a folder: config.yaml if there is one, else config.json, else the one to create."""
    paths = [os.path.join(folder, f"config.{kind}") for kind in ("yaml", "json")]
    return next((p for p in paths if os.path.exists(p)), paths[0 if yaml else 1])


def _is_yaml(path: str) -> bool:
    if not path.endswith((".yaml", ".yml")):
        return False
    if yaml is None:
        raise ValueError("no YAML library is installed")
    return True


def load_settings(path: str) -> dict[str, object]:
    """Settings from a YAML or JSON file; anything but one mapping is an error."""
    with open(path, encoding="utf-8") as f:
        got = yaml.safe_load(f) if _is_yaml(path) else json.load(f)
    if got is None:
        return {}
    if not isinstance(got, dict):
        raise ValueError(f"{path} holds no mapping")
    return got


def save_settings(settings: dict[str, object], path: str) -> None:
    """Settings to a YAML or JSON file, written whole or not at all."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        if _is_yaml(path):
            yaml.safe_dump(settings, f, allow_unicode=True)
        else:
            json.dump(settings, f, ensure_ascii=False, indent=2)
    os.replace(part, path)


def env_file(path: str) -> dict[str, str]:
    """NAME=value lines of a file; blank lines and comments are left out, quotation marks around a value are dropped."""
    out: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                name, eq, value = line.strip().removeprefix("export ").partition("=")
                if eq and not name.startswith("#"):
                    value = value.strip()
                    out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def options(path: str | None = None, environ: dict[str, str] | None = None, prefix: str = "FOLIOFRAME_", env_path: str | None = None, **given: object) -> dict[str, object]:
    """Settings: those given win over the environment, this over a file of its own kind, that over a settings file."""
    found: dict[str, object] = load_settings(path) if path and os.path.exists(path) else {}
    if env_path:
        found |= {k[len(prefix) :].lower(): v for k, v in env_file(env_path).items() if k.startswith(prefix)}
    found |= {k[len(prefix) :].lower(): v for k, v in (os.environ if environ is None else environ).items() if k.startswith(prefix)}
    return found | {k: v for k, v in given.items() if v is not None}


def lookup(settings: dict, dotted: str, default: object = None) -> object:
    """A nested setting by its dotted name."""
    at: object = settings
    for part in dotted.split("."):
        if not isinstance(at, dict) or part not in at:
            return default
        at = at[part]
    return at


def missing(settings: dict, required: list[str]) -> list[str]:
    """The required dotted names that are absent or blank."""
    return [r for r in required if lookup(settings, r) in (None, "")]


def stream_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the pages of JSON records as their files arrive: (path, page_idx, page); broken files give none."""
    raw = spark.readStream.format("text").option("wholetext", True).load(folder).select(F.input_file_name().alias("path"), F.col("value").alias("payload"))
    r = parse_json(raw)
    return r.select("path", F.posexplode("document_data.pages").alias("page_idx", "page"))


def reconstruct(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """JSON files to one Markdown file each by their layout, the whole job: (name, path, n_bytes, status)."""
    from ..operators import assemble

    r = read_json(spark, source).where("status = 'ok'")
    named = r.withColumn("env_id", F.xxhash64("path")).withColumn("metadata", F.col("metadata"))
    name = F.regexp_replace(F.regexp_extract("path", r"[^/]*$", 0), r"\.json$", "")
    made = assemble.record_markdown(named).join(named.select("env_id", name.alias("name"), F.col("text").alias("plain")), "env_id")
    return save(made, folder, "name", "markdown", ".md", fallback="plain")
