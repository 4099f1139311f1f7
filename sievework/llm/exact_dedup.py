"""Exact deduplication as a stateful stream over content digests."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, free_name, join_groups, new_path, text_of, written

#: Keyed state on the executors' disks, without space that each of many small stores would allocate ahead.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Copies that are compared with one replica of the row that stays.
COPIES_A_REPLICA = 500


def normalised(column: str = "text"):
    """The text with every run of ASCII white space replaced by one space; null counts as empty."""
    return F.regexp_replace(text_of(column), SPACES, " ")


@contextmanager
def _disk_state(spark: SparkSession):
    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def digest_state(keys: DataFrame, state: str, log: str) -> None:
    """Run the stream of (digest, id, locator) rows that have arrived through keyed state, then stop.

    State lives in RocksDB under `state` without a watermark, so no digest ever expires; for each digest it holds the
    smallest id, that row's locator and the number of rows. What a micro-batch changes is written to `log`/batch=N,
    replacing what a failed attempt left. A later call with the same paths goes on from the committed offset.
    """
    spark = keys.sparkSession
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "locator")
    grouped = keys.groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    with _disk_state(spark):
        query = (
            grouped.writeStream.outputMode("update")
            .option("checkpointLocation", state)
            .foreachBatch(keep)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def groups_of(spark: SparkSession, log: str, id_type: str) -> DataFrame:
    """One row per digest from the update log: keep_id, locator, group_size. Later updates only lower the id and raise the count."""
    schema = f"digest binary, first struct<no_id:boolean,id:{id_type},locator:string>, n long"
    return (
        spark.read.schema(schema).parquet(f"{log}/batch=*")
        .groupBy("digest")
        .agg(F.min("first").alias("first"), F.max("n").alias("group_size"))
        .select("digest", F.col("first.id").alias("keep_id"), F.col("first.locator").alias("locator"), "group_size")
    )


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files_a_batch: int = 10_000, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (the hex digits of `digest`).

    Texts are equal when they are identical after each run of ASCII white space has become one space; of equal texts
    the row with the smallest id stays. Digests go through a stream with disk-backed state (`digest_state`); every hit
    is then compared in full with the text of the row that stays, both fetched by their locators. Rows whose digests
    alone agree are grouped by their full texts.

    Null texts count as empty, and empty texts are copies of each other. A row without an id stays only where no row
    of its group has an id. Of repeated rows (same id and equal text) one is kept. An empty table gives an empty
    result. Other columns are ignored, whatever their names. The documents may be any table, a join's result too, that
    gives the same rows each time it is read; if rows are not found again, that is an error.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    # the id and a hash that tells rows of one id apart: the same however the rows are read, from files or out of a join
    where = F.concat_ws("#", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.hex(F.xxhash64(F.col(text_col))))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), where.alias("locator"))
    keys_path, work = new_path(spark, "digests"), new_path(spark, "dedup")
    source.select("id", digest(normalised()).alias("digest"), "locator").write.parquet(keys_path)
    schema = f"id {id_type}, digest binary, locator string"
    keys = spark.read.schema(schema).parquet(keys_path)
    total = keys.count()
    if not total:
        return spark.createDataFrame([], f"{id_col} {id_type}, keep_id {id_type}, group_size long, kept boolean, text_sha256 string")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(keys_path)
    digest_state(stream, f"{work}/state", f"{work}/log")
    groups = written(groups_of(spark, f"{work}/log", id_type).withColumnRenamed("locator", "keep_locator"), "groups")

    info = keys.groupBy("id", "digest", "locator").agg(F.count(F.lit(1)).alias("times"))
    info = written(join_groups(info, groups, ["digest"], "group_size", total), "info")
    lone = info.where("group_size = 1").select("id", "digest", "keep_id", "group_size")
    checked = written(_compared(source, info.where("group_size > 1"), digest), "compared")
    hits = info.where("group_size > 1").agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    if checked.count() != hits:
        raise RuntimeError(f"{hits} rows hit a digest, but {checked.count()} were found again by their locators: the documents changed between two reads")
    same = checked.where("other IS NULL").select("id", "digest", "keep_id", "group_size")
    # rows with the digest, but not the text, of the row that stays; as good as never any
    other = checked.where("other IS NOT NULL")
    if not other.isEmpty():
        apart = other.groupBy("digest", "other").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"), F.count(F.lit(1)).alias("own"))
        away = apart.groupBy("digest").agg(F.sum("own").alias("away"))
        same = same.join(away, "digest", "left").withColumn("group_size", F.col("group_size") - F.coalesce("away", F.lit(0))).drop("away")
        other = other.select("id", "digest", "other").join(apart, ["digest", "other"])
        same = same.unionByName(other.select("id", "digest", F.col("first.id").alias("keep_id"), F.col("own").alias("group_size")))
    rows = lone.unionByName(same)
    # of rows that repeat with the id that stays, one is kept
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    first = rows.where(stays & (F.col("group_size") > 1)).groupBy("id", "digest", "keep_id", "group_size").agg(F.count(F.lit(1)).alias("n"))
    first = first.select("id", "digest", "keep_id", "group_size", F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: i == 1)).alias("kept"))
    rows = rows.where(~(stays & (F.col("group_size") > 1))).withColumn("kept", stays).unionByName(first)
    return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _compared(source: DataFrame, hits: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """One row per source row of `hits`, with `other`: its text where that differs from the text of the row that stays.

    Texts are fetched by locator, so only those of hits are normalised and digested again; a row that stays meets its
    copies in as many replicas as COPIES_A_REPLICA asks for, so a group of any size spreads over many tasks.
    """
    replicas = F.ceil(F.col("group_size") / COPIES_A_REPLICA).cast("int")
    wanted = hits.select("locator", F.col("digest").alias("hit"), "keep_id", "keep_locator", "group_size")
    texts = source.join(wanted, "locator").withColumn("norm", normalised()).drop("text")
    texts = texts.withColumn("digest", digest(F.col("norm"))).where("digest = hit").drop("hit")
    texts = written(texts.withColumn("salt", F.pmod(F.xxhash64("id", F.rand(7)), replicas).cast("int")), "hits")
    stays = texts.where("locator = keep_locator").groupBy("digest", "group_size").agg(F.min("norm").alias("kept_norm"))
    stays = stays.select("digest", "kept_norm", F.explode(F.sequence(F.lit(0), replicas - 1)).alias("salt"))
    other = F.when(F.col("norm") != F.col("kept_norm"), F.col("norm"))
    return texts.join(stays, ["digest", "salt"]).select("id", "digest", "keep_id", "group_size", other.alias("other"))


def stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns. Of rows with the same id and equal texts one stays.

    Null texts count as empty; a row without an id stays where no row of its group has one. Texts of any length, ties,
    an empty table and further columns, whatever their names, are as in `exact_dedup`.
    """
    key = free_name(docs, "row_key")
    of = lambda id_, sha: F.concat_ws("#", F.coalesce(F.col(id_).cast("string"), F.lit("null")), sha)
    keep = exact_dedup(docs).where("kept").select(of("doc_id", F.col("text_sha256")).alias(key))
    marked = docs.withColumn(key, of("doc_id", F.sha2(normalised(), 256)))
    return marked.join(keep, key, "left_semi").dropDuplicates([key]).drop(key)
