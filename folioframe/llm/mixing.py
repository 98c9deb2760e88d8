"""Sources mixed to target shares of all tokens by temperature mixing with budgeted block permutations.

Weights are the sources' natural token shares p tilted towards the targets q by an exponent: w ∝ p · (q / p)^τ.  At
τ = 1 they are the targets themselves.  Without a budget the mixture is the largest one at τ = 1 in which no source is
repeated more than `max_repeats` times; with a budget the largest τ in [0, 1] that keeps within the repetitions is found by
bisection (τ = 0 is the natural mixture).

A source's quota of tokens is realised as whole passes over its documents and one partial pass: a hash of seed, pass and
key deals the documents of the pass into `BLOCKS` blocks, the blocks are permuted, and blocks are taken while the quota
lasts; the block at the edge is dealt into blocks again, and of the last one only are the documents put in order.  A source
comes within half its largest document of its quota.  Block
sums are pre-aggregated, so no source, however large, is ordered as a whole.

Defined results: documents with a null key, a source without a target or a null source, and texts without tokens are left
out; a target whose source has no tokens is reported with share 0 and the other targets are scaled up; a null
`max_repeats` counts as 1 and one of 0 leaves its source out like one without tokens; repeated rows count as rows of their own; empty tables give empty mixtures.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .tokens import VOCABULARY, with_counts

#: Blocks of a pass, and how often the block at the edge of a quota is dealt out.
BLOCKS, LEVELS = 1024, 2
MAX_SOURCES = 100_000


@dataclass(frozen=True)
class Quota:
    """What the mixture takes of one source."""

    source: str
    target: float
    tokens: int
    repeats: int
    quota: float

    @property
    def passes(self) -> int:
        return int(self.quota // self.tokens) if self.tokens else 0

    @property
    def rest(self) -> float:
        return self.quota - self.passes * self.tokens


def solve(sources: list[tuple[str, float, int, int]], budget: float | None = None) -> tuple[list[Quota], float]:
    """Quotas of (source, target, max_repeats, tokens) and the exponent τ used."""
    live = [s for s in sources if s[3] > 0 and s[1] > 0 and s[2] > 0]
    total, share = sum(s[3] for s in live), sum(s[1] for s in live)
    if not live:
        return [Quota(s, t, n, r, 0.0) for s, t, r, n in sources], 1.0

    def weights(tau: float) -> dict[str, float]:
        raw = {s: math.exp(math.log(n / total) + tau * (math.log(t / share) - math.log(n / total))) for s, t, _, n in live}
        z = sum(raw.values())
        return {s: v / z for s, v in raw.items()}

    def room(w: dict[str, float]) -> float:
        return min(r * n / w[s] for s, _, r, n in live)

    tau = 1.0
    if budget is None:
        budget = room(weights(1.0))
    elif room(weights(1.0)) < budget:
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if room(weights(mid)) >= budget else (lo, mid)
        tau, budget = lo, min(budget, room(weights(lo)))
    w = weights(tau)
    return [Quota(s, t, n, r, w.get(s, 0.0) * budget) for s, t, r, n in sources], tau


def counted(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents whose source has a target, written once to the checkpoint folder."""
    known = F.broadcast(targets.where("source is not null").select("source").distinct().limit(MAX_SOURCES + 1))
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").join(known, "source", "left_semi")
    return cut(with_counts(rows, path=vocabulary).where("n_tokens > 0"))


def quotas(items: DataFrame, targets: DataFrame, budget: float | None = None) -> tuple[list[Quota], float]:
    """The quotas for counted items; one row per source reaches the driver, of a checked number."""
    rows = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("t"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("r")).take(MAX_SOURCES + 1)
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    tokens = {r["source"]: r["n"] for r in items.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    return solve(sorted((r["source"], float(r["t"] or 0), max(0, int(r["r"])), int(tokens.get(r["source"], 0))) for r in rows), budget)


def realise(items: DataFrame, plan: list[Quota], seed: int = 0, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, source, pass_no, n_tokens, mix_key): the rows of the mixture; sorting by mix_key interleaves the sources."""
    spark = items.sparkSession
    table = spark.createDataFrame([(q.source, q.passes, float(q.rest)) for q in plan], "source string, passes int, left double")
    rows = items.join(F.broadcast(table), "source")
    key = F.xxhash64(F.lit(seed), F.col("pass_no"), F.col("doc_id"))
    cols = ["doc_id", "source", "pass_no", "n_tokens"]
    out = rows.where("passes > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("pass_no"), "n_tokens")
    part = rows.where("left >= 1").withColumn("pass_no", F.col("passes") + 1).withColumn("k", key).select(*cols, "k", "left")
    for level in range(LEVELS):
        part = part.withColumn("block_no", F.pmod(F.xxhash64(F.lit(level), "k"), F.lit(blocks)))
        sums = part.groupBy("source", "left", "block_no").agg(F.sum("n_tokens").alias("n"))
        order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), F.lit(level), "block_no"), "block_no")
        before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.withColumn("room", F.col("left") - before).where("room > 0").select("source", "block_no", "n", "room")
        met = part.drop("left").join(sums, ["source", "block_no"])
        out = out.unionByName(met.where("n <= room").select(*cols))
        part = met.where("n > room").select(*cols, "k", F.col("room").alias("left"))  # the block at the edge, one a source
    within = Window.partitionBy("source").orderBy("k", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    # the document that crosses the quota is taken if that comes nearer to it
    edge = part.withColumn("upto", F.sum("n_tokens").over(within)).where("upto <= left or (upto - n_tokens < left and upto - left < left - (upto - n_tokens))")
    return out.unionByName(edge.select(*cols)).withColumn("mix_key", key)


#: A budget of as many tokens as the sources with a target have.
ALL = "all"


def planned(items: DataFrame, targets: DataFrame, budget: float | str | None) -> tuple[list[Quota], float]:
    if budget == ALL:
        budget = float(items.agg(F.sum("n_tokens")).first()[0] or 0)
    return quotas(items, targets, budget)


def mix(documents: DataFrame, targets: DataFrame, budget: float | str | None = None, seed: int = 0, vocabulary: str = VOCABULARY) -> DataFrame:
    """The mixture of `documents` to `targets` (source, target_share, max_repeats)."""
    items = counted(documents, targets, vocabulary)
    return realise(items, planned(items, targets, budget)[0], seed)


def shares(documents: DataFrame, targets: DataFrame, budget: float | str | None = None, seed: int = 0, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per source its target, natural and actual share, quota, tokens, largest document and the most times one is repeated."""
    items = counted(documents, targets, vocabulary)
    plan, tau = planned(items, targets, budget)
    got = realise(items, plan, seed).groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.max("pass_no").alias("most_repeats"))
    table = items.sparkSession.createDataFrame([(q.source, q.target, q.tokens, q.repeats, tau, float(q.quota)) for q in plan], "source string, target_share double, source_tokens long, max_repeats int, tau double, quota double")
    table = table.join(items.groupBy("source").agg(F.max("n_tokens").alias("largest")), "source", "left")
    every = Window.partitionBy()
    out = table.join(got, "source", "left").na.fill(0, ["mixed_tokens", "most_repeats", "largest"])
    return out.withColumn("natural_share", F.try_divide("source_tokens", F.sum("source_tokens").over(every))).withColumn("actual_share", F.try_divide("mixed_tokens", F.sum("mixed_tokens").over(every)))
