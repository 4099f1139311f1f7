"""Reading and writing tables: projected scans, sectioned text, score bundles, write-once and sealed paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, columns: list[str] | None = None) -> DataFrame:
    """A CSV with header under a declared schema; only `columns` are parsed when given."""
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    return df.select(columns) if columns else df


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*dict.fromkeys(columns)) if columns else df


def read_sectioned(lines: DataFrame, fields: list[str], kinds: dict[str, str], order: str = "line", marker: str = "@data") -> DataFrame:
    """Typed rows of a sectioned text (columns file, line, value): what follows the marker line of each file, cut at
    commas, with quotes stripped; rows with fewer fields are dropped and fields that don't parse are null."""
    mark = lines.where(F.lower(F.trim("value")) == marker).groupBy("file").agg(F.min(order).alias("mark"))
    cells = F.split("value", ",")
    rows = lines.join(F.broadcast(mark), "file").where((F.col(order) > F.col("mark")) & (F.size(cells) >= len(fields)))
    cell = lambda i: F.trim(F.translate(F.get(cells, i), "'\"", ""))
    typed = [(cell(i).try_cast(kinds[f]) if f in kinds else cell(i)).alias(f) for i, f in enumerate(fields)]
    return rows.select("file", order, *typed)


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Publish df at path, which must not exist, and return it read back; a count that differs fails."""
    df.write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    if back.count() != df.count():
        raise ValueError(f"{path}: rows written and read differ")
    return back


def write_sealed(df: DataFrame, open_path: str, sealed_path: str, split: str = "split", sealed: str = "test") -> None:
    """Open rows partitioned by split; the sealed split alone at its own path, without any statistic on it."""
    df.where(F.col(split) != sealed).write.mode("errorifexists").partitionBy(split).parquet(open_path)
    df.where(F.col(split) == sealed).write.mode("errorifexists").parquet(sealed_path)


def guarded_reader(spark: SparkSession, sealed: tuple[str, ...]):
    """A parquet reader that refuses every path at or below a sealed one."""

    def read(path: str) -> DataFrame:
        clean = path.removeprefix("file://").rstrip("/")
        if any(clean == s or clean.startswith(f"{s}/") for s in (x.removeprefix("file://").rstrip("/") for x in sealed)):
            raise PermissionError(f"{path} is sealed")
        return spark.read.parquet(path)

    return read


def checked_bundle(scores: DataFrame, rows: int) -> DataFrame:
    """method, n, bad, valid: a method counts when it has `rows` rows, all finite."""
    bad = F.count_if(~S.finite(F.col("score")))
    return scores.groupBy("method").agg(F.count(F.lit(1)).alias("n"), bad.alias("bad")).withColumn("valid", (F.col("n") == rows) & (F.col("bad") == 0))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows, xor and sum of a 32-bit hash per row: the same for any order and partitioning."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns))
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor("h").alias("xor_hash"), F.sum("h").alias("sum_hash"))


def hash_mismatches(expected: DataFrame, observed: DataFrame, key: str, value: str) -> DataFrame:
    """key and reason (missing or differs) of what `expected` has and `observed` has not so."""
    seen = observed.select(F.col(key), F.col(value).alias("_seen"), F.lit(True).alias("_there"))
    reason = F.when(F.col("_there").isNull(), "missing").when(~F.col(value).eqNullSafe(F.col("_seen")), "differs")
    return expected.join(seen, key, "left").select(key, reason.alias("reason")).where("reason IS NOT NULL")
