"""Removal of repeated passages by windows of three consecutive lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, text_of, written

LINES = 3


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """One row per document: id, n_lines, n_removed, deduped_text.

    Every window of `lines` consecutive lines (cut at line feeds, compared exactly, not all blank) that also stands
    elsewhere, in whatever document, keeps its first place in order of id and position; at later places its lines are
    covered, windows overlap, and covered lines are removed. Windows are told apart by 128 bits of hashes.

    A null text counts as empty: one empty line. Texts of fewer lines stay as they are. Null ids order last; rows with
    equal ids are ordered by a hash of the text; repeated rows count as one document, and all of them get its result.
    An empty table gives an empty result; other columns are ignored.
    """
    text = text_of(text_col)
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text).alias("k1"), F.xxhash64(text, F.lit(9), id_col).alias("k2"), F.split(text, "\n").alias("lines"))
    joined = lambda i: F.array_join(F.slice("lines", i + 1, lines), "\n")
    windows = F.transform(F.sequence(F.lit(0), F.size("lines") - lines), lambda i: F.struct(i.alias("at"), joined(i).alias("text")))
    at = source.where(F.size("lines") >= lines).select("id", "k1", "k2", F.explode(windows).alias("w")).where(F.trim(F.translate("w.text", "\n\r\t", "   ")) != "")
    at = at.select("id", "k1", "k2", "w.at", F.xxhash64("w.text").alias("h1"), F.xxhash64(F.lit(31), "w.text", F.lit(7)).alias("h2"))
    at = written(at, "windows")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2", "at")
    groups = at.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    later = join_groups(at, written(groups, "repeated"), ["h1", "h2"], "times", max(1, at.count())).where(~place.eqNullSafe(F.col("first")))
    covered = later.select("k1", "k2", F.explode(F.sequence("at", F.col("at") + lines - 1)).alias("line"))
    covered = covered.groupBy("k1", "k2").agg(F.collect_set("line").alias("covered"))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.when(F.col("covered").isNull(), F.col("lines")).otherwise(F.transform(F.array_except(every, "covered"), lambda i: F.get("lines", i)))
    both = source.join(covered, ["k1", "k2"], "left").select("id", F.size("lines").alias("n_lines"), kept.alias("kept"))
    return both.select(
        F.col("id").alias(id_col), F.col("n_lines").cast("long").alias("n_lines"), (F.col("n_lines") - F.size("kept")).cast("long").alias("n_removed"), F.array_join("kept", "\n").alias("deduped_text")
    )
