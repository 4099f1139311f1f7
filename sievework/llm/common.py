"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A run of the six ASCII white-space characters.
SPACES = r"[\x20\x09-\x0D]+"
#: A run of anything else: one word.
WORD = r"[^\x20\x09-\x0D]+"
#: A group with more than one row in HOT_SHARE of all rows counts as hot; fewer than HOT_SHARE such groups can exist.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder serves a
    local master; on a cluster, whose executors would not see it, this is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sievework-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/sievework/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: lineage ends here, so a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str | Column) -> Column:
    """The text, an empty one for null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_hot(groups: DataFrame, size: str, total: int) -> tuple[DataFrame, DataFrame]:
    """(hot, cold) groups. Sizes sum to total, so fewer than HOT_SHARE groups are hot, whatever the input: hot may be broadcast."""
    is_hot = F.col(size) * HOT_SHARE > F.lit(total)
    return groups.where(is_hot), groups.where(~is_hot)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with one row per group (columns keys, size, more), safe for a group that holds a large share of the rows.

    The fewer than HOT_SHARE hot groups are broadcast; the rows of the others meet their group by a shuffle in which
    no key has more than one row in HOT_SHARE. Both inputs are read twice: pass written tables.
    """
    hot, cold = split_hot(groups, size, total)
    return rows.join(F.broadcast(hot), keys).unionByName(
        rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.hint("shuffle_hash"), keys)
    )


def running(df: DataFrame, order: list[Column], sums: list[str], name: str) -> DataFrame:
    """df, written, with `number` (from 0, in the given order) and before_<c> for each of sums: its sum over the rows before.

    Ranges of the order are sorted in tasks of their own, and only one row for each range goes through one task.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = written(ranged, name).withColumn("range", F.shiftright("at", 33))
    whole = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), *(F.sum(c).alias(f"all_{c}") for c in sums))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    whole = whole.select("range", F.coalesce(F.sum("rows").over(before), none).alias("base"), *(F.coalesce(F.sum(f"all_{c}").over(before), none).alias(f"base_{c}") for c in sums))
    within = Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumns({f"in_{c}": F.coalesce(F.sum(c).over(within), none) for c in sums}).join(F.broadcast(whole), "range")
    place = F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)
    return inside.select(*df.columns, place.alias("number"), *((F.col(f"base_{c}") + F.col(f"in_{c}")).alias(f"before_{c}") for c in sums))
