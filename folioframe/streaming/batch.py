"""Streaming pieces: windowed counts, exact rate limiting, and isolated per-file work; they run on batches too."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener


def timed(rows: DataFrame, time: str, late: str | None) -> DataFrame:
    """With `late`, the time as a timestamp under a watermark (a time without a zone counts as the session's)."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late else rows


def windowed(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """(window_start, event_type, n) over event time; with `late` a watermark bounds the state of a stream."""
    rows = timed(events, "ts", late)
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, session_start, session_end, n): a user's events without a pause of `gap`."""
    rows = timed(events, "ts", late)
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduplicated(rows: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Rows delivered again within `late` are dropped, with state bounded by the watermark."""
    return timed(rows, time, late).dropDuplicatesWithinWatermark(keys)


def matched(left: DataFrame, right: DataFrame, keys: list[str], row_id: str, time: str, within: str, late: str | None = None) -> DataFrame:
    """(keys, left_id, right_id): rows of the right that come within `within` after one of the left with the same keys.

    On streams both sides need `late`: the watermarks and the time bound let old state go.
    """
    a = timed(left, time, late).select(*[F.col(k).alias(f"l_{k}") for k in keys], F.col(row_id).alias("left_id"), F.col(time).alias("left_time"))
    b = timed(right, time, late).select(*keys, F.col(row_id).alias("right_id"), F.col(time).alias("right_time"))
    on = (F.col("right_time") >= F.col("left_time")) & (F.col("right_time") <= F.col("left_time") + F.expr(f"interval {within}"))
    for k in keys:
        on = on & (F.col(f"l_{k}") == F.col(k))
    return a.join(b, on).select(*keys, "left_id", "right_id")


def progress_rows(envelopes: DataFrame) -> DataFrame:
    """(job_id, env_id, text): the records of a job, rows delivered again once."""
    return envelopes.where("job_id is not null").select("job_id", "env_id", F.coalesce("text", F.lit("")).alias("text")).distinct()


def so_far(rows: DataFrame) -> DataFrame:
    """(job_id, env_id, n_files, n_chars): what a job has produced up to each of its files, in order of the key."""
    w = Window.partitionBy("job_id").orderBy("env_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("job_id", "env_id", F.count("*").over(w).alias("n_files"), F.sum(F.length("text")).over(w).alias("n_chars"))


def emit(rows: DataFrame, key: str, text: str, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger: object) -> StreamingQuery:
    """A stream that hands every batch's new texts, in order of the key, to `sink` as they come; a restart repeats a batch whole."""
    once = lambda df, n: sink(df.select(key, text).orderBy(key), n)
    return rows.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Signals(StreamingQueryListener):
    """Progress, end and error of streams as calls of a function: (what, name, rows or message)."""

    def __init__(self, tell: Callable[[str, str | None, object], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.tell("started", event.name, None)

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self.tell("progress", event.progress.name, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.tell("failed" if event.exception else "ended", None, event.exception)


def limited(requests: DataFrame, calls: int = 15, seconds: float = 60.0) -> DataFrame:
    """(service, request_id, asked_at, start_at): each request's earliest start when any window takes `calls` starts.

    State per service is the last `calls` start times; requests of one trigger are served in order of asking.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        starts = list(state.get[0]) if state.exists else []
        got = pd.concat(list(batches)).sort_values(["asked_at", "request_id"])
        out = []
        for r in got.itertuples():
            at = r.asked_at.timestamp()
            if len(starts) >= calls:
                at = max(at, starts[-calls] + seconds)
            starts = (starts + [at])[-calls:]
            out.append((key[0], r.request_id, r.asked_at, pd.Timestamp(at, unit="s")))
        state.update((starts,))
        yield pd.DataFrame(out, columns=["service", "request_id", "asked_at", "start_at"])

    return requests.groupBy("service").applyInPandasWithState(run, "service string, request_id long, asked_at timestamp, start_at timestamp", "starts array<double>", "append", "NoTimeout")


def isolated(rows: DataFrame, work, schema: str) -> DataFrame:  # noqa: ANN001
    """`work` on each row's dict; a row whose work fails comes out with its error in `status`, never failing the batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split()[0] for c in schema.split(",")]
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    out.append({**work(row), "status": "ok"})
                except Exception as e:  # noqa: BLE001
                    out.append({k: row.get(k) for k in names} | {"status": f"error: {type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=[*names, "status"], dtype=object)

    return rows.mapInPandas(run, schema + ", status string")
