"""Page templates from measurements: page samples, robust medians, consistency, gaps and edges of profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_pages(n: Column, size: int = 20, skip: int = 2, least: int = 5) -> Column:
    """Evenly spread page indices without the first and last `skip`; all pages of short documents."""
    tight = n - 2 * skip <= 0
    first = F.when(tight, F.least(F.lit(skip), F.floor(n / 4).cast("int"))).otherwise(F.lit(skip))
    room = n - 2 * first
    run = lambda a, z: F.when(z > a, F.sequence(a, z - 1)).otherwise(F.array().cast("array<int>"))
    even = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (first + F.floor(i * (room / size))).cast("int"))
    return F.when(n <= least, run(F.lit(0), n)).when(room <= size, run(first, n - first)).otherwise(even)


def robust_medians(df: DataFrame, keys: list[str], value: str, threshold: float = 2.0) -> DataFrame:
    """(keys, n, median, n_outliers): the median without values over `threshold` median deviations away, if they are few."""
    w = Window.partitionBy(*keys)
    x = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    x = x.join(x.groupBy(*keys).agg(F.median("v").alias("m"), F.count("*").alias("n")), keys)
    x = x.withColumn("dev", F.abs(F.col("v") - F.col("m")))
    x = x.join(x.groupBy(*keys).agg(F.median("dev").alias("mad")), keys)
    far = (F.col("n") >= 3) & (F.col("mad") >= 1) & (F.col("dev") > threshold * F.col("mad"))
    x = x.withColumn("far", far).withColumn("n_far", F.sum(far.cast("int")).over(w))
    kept = x.withColumn("kept", F.when(~(far & (F.col("n_far") < F.col("n") / 2)), F.col("v")))
    return kept.groupBy(*keys).agg(F.first("n").cast("int").alias("n"), F.median("kept").cast("int").alias("median"), F.first("n_far").cast("int").alias("n_outliers"))


def consistency(df: DataFrame, keys: list[str], columns: list[str], *more: Column) -> DataFrame:
    """1 minus the mean coefficient of variation of the columns, within 0 and 1; 0.5 for fewer than three rows."""
    cv = [F.when(F.avg(c) > 0, F.stddev_pop(c) / F.avg(c)).otherwise(1.0) for c in columns]
    mean = sum(cv[1:], cv[0]) / len(cv)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), mean.alias("mean_cv"), *more).withColumn("confidence", F.when(F.col("n") < 3, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("mean_cv")))))


def low_runs(profile: DataFrame, keys: list[str], at: str, value: str, most: float, least: int) -> DataFrame:
    """Gaps of a profile: runs of at least `least` neighbouring positions whose value is at most `most`."""
    order = Window.partitionBy(*keys).orderBy(at)
    low = profile.withColumn("low", F.col(value) <= most)
    start = low.withColumn("run", F.sum(F.when(F.coalesce(F.lag("low").over(order) != F.col("low"), F.lit(True)), 1).otherwise(0)).over(order))
    return start.where("low").groupBy(*keys, "run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("run")


def edges(profile: DataFrame, keys: list[str], at: str, value: str, threshold: float) -> DataFrame:
    """Rising and falling edges: where the value passes the threshold upwards, and the last place before it falls back."""
    order = Window.partitionBy(*keys).orderBy(at)
    x = profile.withColumn("up", F.col(value) > threshold).withColumn("was", F.lag("up").over(order)).withColumn("prev", F.lag(at).over(order)).where("was is not null and up <> was")
    return x.select(*keys, F.when(F.col("up"), F.col(at)).otherwise(F.col("prev")).alias("at"), F.when(F.col("up"), "rising").otherwise("falling").alias("edge"))


def smoothed(profile: DataFrame, keys: list[str], at: str, value: str, kernel: tuple[float, ...] = (0.25, 0.5, 0.25)) -> DataFrame:
    """A profile smoothed with a fixed centred kernel; positions past the ends repeat the end value."""
    order = Window.partitionBy(*keys).orderBy(at)
    half = len(kernel) // 2
    terms = [w * F.coalesce(F.lag(value, half - i).over(order) if i != half else F.col(value), F.col(value)) for i, w in enumerate(kernel)]
    return profile.withColumn("smooth", sum(terms[1:], terms[0]))


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    """Weights of a Gaussian cut at `truncate` deviations, summing to one."""
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def gaussian(profile: DataFrame, keys: list[str], at: str, value: str, sigma: float) -> DataFrame:
    """(keys, at, smooth): a profile under a Gaussian; past its ends it is mirrored, the end value repeated.

    A profile is as long as a page has strips, so one profile is one row.
    """
    w = gaussian_kernel(sigma)
    r, n = len(w) // 2, F.size("v")
    rows = profile.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).cast("double").alias("v")))).alias("p"))
    rows = rows.select(*keys, F.transform("p", lambda x: x["at"]).alias("at"), F.transform("p", lambda x: x["v"]).alias("v"))

    def mirrored(j: Column) -> Column:
        m = F.pmod(j, 2 * n)
        return F.get("v", F.least(m, 2 * n - 1 - m).cast("int"))

    smooth = F.transform("at", lambda a, i: F.struct(a.alias("at"), sum((mirrored(i + (k - r)) * x for k, x in enumerate(w)), F.lit(0.0)).alias("smooth")))
    return rows.select(*keys, F.explode(smooth).alias("s")).select(*keys, F.col("s.at").alias(at), "s.smooth")


def gradient(profile: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """(keys, at, gradient): half the difference of the neighbours, at the ends the difference to the only one."""
    order = Window.partitionBy(*keys).orderBy(at)
    before, after, v = F.lag(value).over(order), F.lead(value).over(order), F.col(value)
    g = F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2)
    return profile.select(*keys, at, g.alias("gradient"))


def transitions(slopes: DataFrame, keys: list[str], at: str, threshold: float) -> DataFrame:
    """(keys, at): where a gradient passes the threshold from below."""
    was = F.lag("gradient").over(Window.partitionBy(*keys).orderBy(at))
    return slopes.withColumn("was", was).where((F.col("gradient") > threshold) & F.coalesce(F.col("was") <= threshold, F.lit(True))).select(*keys, at)


def extract_template(measures: DataFrame, keys: list[str], columns: list[str], confidence: list[str], threshold: float = 2.0) -> DataFrame:
    """One row per document: the robust median of every measured column, pages analysed and confidence of consistency."""
    long = measures.select(*keys, F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("double") for c in columns]))).alias("zone", "v"))
    medians = robust_medians(long, [*keys, "zone"], "v", threshold)
    wide = medians.groupBy(*keys).pivot("zone", columns).agg(F.first("median"))
    sure = consistency(measures, keys, confidence).select(*keys, F.col("n").alias("pages_analysed"), "confidence")
    return sure.join(wide, keys, "left")


def cache_key(sizes: Column, n: Column, dpi: int = 300) -> Column:
    """The key of a document's template: a digest of its page count and the sizes of its first ten pages."""
    page = lambda p: F.concat(F.lit(f'{{"dpi": {dpi}, "height": '), F.coalesce(p["height"].cast("int").cast("string"), F.lit("null")), F.lit(', "width": '), F.coalesce(p["width"].cast("int").cast("string"), F.lit("null")), F.lit("}"))
    return F.sha2(F.concat(F.lit('{"count": '), n.cast("string"), F.lit(', "pages": ['), F.array_join(F.transform(F.slice(sizes, 1, 10), page), ", "), F.lit("]}")), 256)
