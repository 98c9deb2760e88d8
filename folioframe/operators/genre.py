"""Genre signals of a text: line lengths, speakers, fragment marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Speakers at the start of a line, and marks of fragments.
SPEAKER = [r"^\s*([Α-Ω]{2,4})\.\s", r"^\s*([A-Z]{2,4})\.\s", r"^\s*([Α-Ω]{4,12}|[A-Z]{4,12})[.:]\s"]
FRAGMENT = [r"Fr(?:ag)?\.?\s*\d+", r"\b[AB]\d+\b", r"(?m)^\s*\d{1,3}\.\s", r"\[\d{1,3}\]", r"§\s*\d+"]


def lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line): the lines of texts that are not blank."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where(T.strip(F.col("line")) != "")


def _name() -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract("line", p, 1), F.lit("")) for p in SPEAKER])


LENGTHS = ("n_lines", "avg_length", "std_length", "cv", "line_confidence")
SPEECH = ("total_lines", "speaker_lines", "unique_speakers", "speaker_ratio", "speaker_confidence", "speakers")


def line_stats(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Line lengths and speakers of each text in one aggregation over its lines.

    Fewer than five lines tell nothing of lengths.  `speakers` holds the first ten names in order.
    """
    size = F.length(T.strip(F.col("line")))
    n = lines(df, key, text).withColumn("name", _name()).groupBy(key).agg(
        F.count("*").alias("n_lines"), F.avg(size).alias("m"), F.stddev_pop(size).alias("d"), F.count("name").alias("speaker_lines"), F.array_sort(F.collect_set("name")).alias("names")
    )
    few = F.col("n_lines") < 5
    cv = F.when(~few, F.col("d") / F.col("m"))
    sure = F.when(few, 0.0).when((cv < 0.2) & (F.col("m") < 60), 0.9).when((cv < 0.3) & (F.col("m") < 80), 0.7).when(cv > 0.5, 0.8).otherwise(0.5)
    r, k = F.col("speaker_lines") / F.col("n_lines"), F.size("names")
    said = F.when((r > 0.3) & k.between(2, 10), 0.9).when((r > 0.2) & (k >= 2), 0.7).when(r > 0.1, 0.5).otherwise(0.3)
    return n.select(
        key, "n_lines", F.when(few, 0.0).otherwise(F.col("m")).alias("avg_length"), F.when(few, 0.0).otherwise(F.col("d")).alias("std_length"), cv.alias("cv"), sure.alias("line_confidence"),
        F.col("n_lines").alias("total_lines"), "speaker_lines", k.cast("long").alias("unique_speakers"), r.alias("speaker_ratio"), said.alias("speaker_confidence"), F.slice("names", 1, 10).alias("speakers"),
    )


def line_lengths(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Mean, population deviation, variation and confidence of line lengths."""
    return line_stats(df, key, text).select(key, *LENGTHS).withColumnRenamed("line_confidence", "confidence")


def speakers(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Share of lines that begin with a speaker's name, distinct names and ten of them, and confidence."""
    return line_stats(df, key, text).select(key, *SPEECH).withColumnRenamed("speaker_confidence", "confidence")


def fragments(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Fragment marks per paragraph and confidence; a mark may count in several forms."""
    return df.where(T.strip(F.col(text)) != "").select(key, *fragment_stats(text))


def fragment_stats(text: str) -> list[Column]:
    marks = sum((F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))) for p in FRAGMENT), F.lit(0))
    paragraphs = F.size(F.filter(F.split(text, "\n\n"), lambda p: T.strip(p) != ""))
    r = F.try_divide(marks, paragraphs)
    return [marks.alias("fragment_markers"), paragraphs.alias("total_paragraphs"), r.alias("fragment_ratio"), F.when(r > 0.5, 0.9).when(r > 0.3, 0.7).when(r > 0.1, 0.5).otherwise(0.2).alias("confidence")]


def hints(df: DataFrame, key: str, text: str = "text", verse_length: float = 60, verse_cv: float = 0.3, speaker_ratio: float = 0.15, fragment_ratio: float = 0.2) -> DataFrame:
    """One genre per text: fragments before verse with speakers, speakers, verse and prose; short texts are unknown."""
    _, _, ratio, found = fragment_stats(text)
    x = df.select(key, F.length(T.strip(F.col(text))).alias("n"), ratio, found.alias("c3")).join(line_stats(df, key, text), key, "left")
    verse, talk = (F.col("avg_length") < verse_length) & (F.col("cv") < verse_cv), F.col("speaker_ratio") > speaker_ratio
    short = F.coalesce(F.col("n") < 50, F.lit(True))
    kind = F.when(short, "unknown").when(F.col("fragment_ratio") > fragment_ratio, "fragments").when(verse & talk, "verse_speakers").when(talk, "speakers").when(verse, "verse").otherwise("prose")
    sure = F.when(short, 0.0).when(F.col("fragment_ratio") > fragment_ratio, F.col("c3")).when(verse & talk, F.least("line_confidence", "speaker_confidence")).when(talk, F.col("speaker_confidence")).when(verse, F.col("line_confidence")).otherwise(0.7)
    return x.select(key, kind.alias("genre"), sure.alias("confidence"))
