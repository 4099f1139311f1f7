"""Result trees and release manifests: flattening, comparing, auditing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names that hold run times and are left out of comparisons.
TIMING = ("elapsed", "seconds", "runtime", "duration")


def _leaves(schema: T.DataType, at: Column, path: str) -> list[Column]:
    if isinstance(schema, T.StructType):
        return [leaf for f in schema.fields for leaf in _leaves(f.dataType, at[f.name], f"{path}.{f.name}" if path else f.name)]
    number = at.cast("double") if isinstance(schema, T.NumericType) else F.lit(None).cast("double")
    return [F.struct(F.lit(path).alias("path"), F.lit(schema.simpleString()).alias("type"), at.cast("string").alias("value"), number.alias("number"))]


def flattened(df: DataFrame, key: str, tree: str) -> DataFrame:
    """(path, type, value, number): one row per leaf that is not null, its path led by the key."""
    leaves = _leaves(df.schema[tree].dataType, F.col(tree), "")
    rows = df.select(F.col(key).cast("string").alias("_k"), F.explode(F.array(*leaves)).alias("e")).where("e.value IS NOT NULL")
    return rows.select(F.concat_ws(".", "_k", "e.path").alias("path"), "e.type", "e.value", "e.number")


def result_diff(left: DataFrame, right: DataFrame, rtol: float = 1e-12, atol: float = 1e-14) -> DataFrame:
    """(path, reason): missing, unexpected, type, float (beyond tolerance) or value; timing leaves don't count."""
    skip = F.lower("path").rlike("|".join(TIMING))
    l, r = left.where(~skip).alias("l"), right.where(~skip).alias("r")
    both = l.join(r, F.col("l.path") == F.col("r.path"), "full")
    apart = F.abs(F.col("l.number") - F.col("r.number")) > atol + rtol * F.abs(F.col("r.number"))
    reason = (
        F.when(F.col("r.path").isNull(), "missing").when(F.col("l.path").isNull(), "unexpected").when(F.col("l.type") != F.col("r.type"), "type")
        .when(F.col("l.number").isNotNull() & F.col("r.number").isNotNull(), F.when(apart, "float")).when(F.col("l.value") != F.col("r.value"), "value")
    )
    return both.select(F.coalesce("l.path", "r.path").alias("path"), reason.alias("reason")).where("reason IS NOT NULL")


def manifest_mismatch(expected: DataFrame, seen: DataFrame, forbidden: tuple[str, ...]) -> DataFrame:
    """(path, reason) of files seen with a forbidden suffix, or with other bytes or hash than expected."""
    e = expected.select("path", F.col("bytes").alias("_b"), F.col("sha").alias("_s"))
    suffix = F.col("path").rlike("(" + "|".join(x.replace(".", r"\.") for x in forbidden) + ")$")
    differs = (F.col("bytes") != F.col("_b")) | (F.col("sha") != F.col("_s"))
    reason = F.when(suffix, "forbidden suffix").when(differs, "content differs")
    return seen.join(e, "path", "left").select("path", reason.alias("reason")).where("reason IS NOT NULL")


def release_audit(expected: DataFrame, seen: DataFrame, leaves: DataFrame, keys: tuple[str, ...], suffixes: tuple[str, ...]) -> DataFrame:
    """(check, findings): files missing, unexpected or different, leaves under forbidden keys or with forbidden suffixes."""
    missing = expected.select("path").exceptAll(seen.select("path"))
    unexpected = seen.select("path").exceptAll(expected.select("path"))
    different = manifest_mismatch(expected, seen, suffixes)
    bad_key = leaves.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*keys))
    bad_value = leaves.where(F.col("value").rlike("(" + "|".join(x.replace(".", r"\.") for x in suffixes) + ")$"))
    counted = [(("missing", missing), ("unexpected", unexpected), ("different", different), ("forbidden key", bad_key), ("forbidden value", bad_value))]
    rows = [df.agg(F.count(F.lit(1)).alias("findings")).select(F.lit(name).alias("check"), "findings") for name, df in counted[0]]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
