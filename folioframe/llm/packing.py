"""Documents packed into windows of fixed token capacity by the sum-of-squares rule.

Each document goes, online, into the fill level that makes the sum over levels of the squared number of windows at that
level smallest; the numbers are tracked in one array of `capacity` levels.  A document is whole in one window unless it
alone exceeds the capacity; such a document fills windows of its own and its rest is packed like any other document.

Packing runs in groups of about `group_tokens` tokens drawn by a hash of the key, so that no task grows with the data and
only (key, n_tokens) is shuffled.  The windows of a group that stay open at its end are a bounded number.

Defined results: null keys and texts without tokens get no window; ties go to the fuller level; repeated rows are items of
their own; empty tables give empty tables.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import VOCABULARY, with_counts

CAPACITY = 2048
GROUP_TOKENS = 8_000_000


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """For each size its parts as (window, offset in the window, tokens); windows are numbered from 0."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open windows by fill level
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, out = 0, []
    for size in sizes:
        parts = []
        while size > capacity:
            parts.append((used, 0, capacity))
            used, size = used + 1, size - capacity
        if size > 0:
            # change of the sum of squares when a window at level h becomes one at level h + size
            h = np.arange(0, capacity - size + 1)
            gain = 2 * count[size : capacity + 1] + 1
            gain[-1] = 0  # a full window is closed and counts no more
            gain = gain - np.where(h > 0, 2 * count[: capacity - size + 1] - 1, 0)
            gain[(h > 0) & (count[: capacity - size + 1] == 0)] = np.iinfo(np.int64).max
            level = int(len(gain) - 1 - np.argmin(gain[::-1]))
            if level:
                window = open_at[level].pop()
                count[level] -= 1
            else:
                window, used = used, used + 1
            if level + size < capacity:
                open_at[level + size].append(window)
                count[level + size] += 1
            parts.append((window, level, size))
        out.append(parts)
    return out


def assign(documents: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, part_no, group_no, window_no, start_token, window_offset, n_tokens): every document's place."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    items = with_counts(documents.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), "text"), path=vocabulary).where("n_tokens > 0")
    # the number of groups follows from the bytes of text, known without tokenizing twice: a token has at least one byte
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, math.ceil(total / 4 / group_tokens))
    grouped = items.withColumn("group_no", F.pmod(F.xxhash64(key), F.lit(groups)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "n_tokens"], kind="stable")
        order = np.random.default_rng(len(pdf)).permutation(len(pdf))
        keys, sizes = pdf[key].to_numpy()[order], pdf["n_tokens"].to_numpy()[order]
        rows = []
        for k, parts in zip(keys, pack(sizes.tolist(), capacity), strict=True):
            start = 0
            for no, (window, offset, n) in enumerate(parts):
                rows.append((k, no, window, start, offset, n))
                start += n
        got = pd.DataFrame(rows, columns=[key, "part_no", "window_no", "start_token", "window_offset", "n_tokens"])
        got.insert(2, "group_no", int(pdf["group_no"].iloc[0]))
        return got

    return grouped.groupBy("group_no").applyInPandas(run, f"{key} long, part_no int, group_no int, window_no long, start_token int, window_offset int, n_tokens int")


def windows(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per window its fill and unused space."""
    return assigned.groupBy("group_no", "window_no").agg(F.count("*").alias("n_parts"), F.sum("n_tokens").alias("n_tokens")).withColumn("unused", F.lit(capacity) - F.col("n_tokens"))


def checked(assigned: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """One row: documents placed, and how many windows are too full and documents are not whole or cut without need."""
    w = windows(assigned, capacity).agg(F.count_if(F.col("unused") < 0).alias("over_full"))
    d = assigned.groupBy(key).agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("n"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"))
    d = d.agg(F.count("*").alias("n_documents"), F.count_if(F.col("n") != F.col("end")).alias("not_whole"), F.count_if((F.col("parts") > 1) & (F.col("n") <= capacity)).alias("cut_without_need"))
    return _side_by_side(d, w)


def _side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables of one row as one row."""
    return a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one").drop("one")
