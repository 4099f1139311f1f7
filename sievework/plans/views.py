"""Views on the given tables that the queries score, split and audit, each in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .staging import staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(body: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Register the decorated function under its name, with the SQL `body` over the named views."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if body is not None:
            SQL[f.__name__] = with_views(body, *views)
        return f

    return register


def with_views(body: str, *views: str) -> str:
    named = ",\n".join(f"{v} AS ({VIEW_SQL[v]})" for v in views)
    body = body.strip()
    if not views:
        return body
    return f"WITH {named}, {body[5:]}" if body.startswith("WITH ") else f"WITH {named} {body}"


def u_sql(seed, draw, row_id: str) -> str:
    """SQL twin of keyed_uniform."""
    return f"(('0x' || substr(md5(concat_ws(':', {seed}, {draw}, {row_id})), 1, 8))::BIGINT / 4294967296.0)"


def poisson_sql(u: str) -> str:
    return "(" + " + ".join(f"({u} >= {c!r})::INT" for c in S.POISSON_CUTS) + ")"


def weights_sql(source: str, seed: int, draws: int) -> str:
    """SQL twin of bootstrap.row_weights: the rows of source by draw, with their weight w; rows of weight 0 are left out."""
    from ..operators.bootstrap import CUTS, FIRST, SECOND, STEP

    def mixed(of: str) -> str:
        for shift, factor in ((16, FIRST), (13, SECOND), (16, None)):
            step = f"xor(x, x >> {shift})"
            of = f"SELECT * REPLACE ({f'({step} * {factor}::UBIGINT) % 4294967296::UBIGINT' if factor else step} AS x) FROM ({of})"
        return of

    words = ", ".join(f"('0x' || substr(md5('{seed}:' || row_id), {at}, 8))::UBIGINT AS {name}" for at, name in ((1, "_lo"), (9, "_hi")))
    first = mixed(f"SELECT *, (_lo + draw::UBIGINT * {STEP}::UBIGINT) % 4294967296::UBIGINT AS x FROM (SELECT *, {words} FROM {source}), (SELECT unnest(range({draws})) AS draw)")
    second = mixed(f"SELECT * REPLACE (xor(x, _hi) AS x) FROM ({first})")
    weight = " + ".join(f"(x >= {c})::INT" for c in CUTS)
    return f"SELECT * EXCLUDE (x, _lo, _hi) FROM (SELECT *, {weight} AS w FROM ({second})) WHERE w > 0"


def seconds(column: str):
    """Seconds since 1970 of a timestamp without time zone."""
    return F.floor(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))") / 1_000_000)


def docs_labeled(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("row_id"), F.col("toxic").alias("y"), "lang", "source", "n_chars", "quality")


def txn(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("row_id"), seconds("ts").alias("t"), F.col("user_id").alias("card"), F.col("event_type").alias("category"), F.col("value").alias("amount"), "props")


def line_scored(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    row_id = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")), F.col("l_quantity").cast("int").cast("string"))
    y = ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") >= 48)).cast("int")
    return line.select(
        row_id.alias("row_id"), seconds("l_shipdate").alias("t"), y.alias("y"), F.col("l_extendedprice").alias("s_a"), F.col("l_quantity").alias("s_b"), F.col("l_discount").alias("s_c"),
        F.round(F.col("l_quantity") * 0.016 + F.col("l_discount") * 2, 6).alias("p"), F.when(S.keyed_uniform(7, 0, row_id) < 0.5, "val").otherwise("test").alias("part"),
    )


def features(spark: SparkSession, d: str) -> DataFrame:
    line, orders, part, supplier = (table(spark, d, t) for t in ("lineitem", "orders", "part", "supplier"))
    y = ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") >= 48)).cast("byte")
    # the joins shuffle the label, not the flags it comes from
    line = line.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", y.alias("_y"))
    row_id = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")), F.col("l_quantity").cast("int").cast("string"))
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    named = zip(("l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice", "p_size", "p_retailprice", "s_acctbal"), range(1, 9), strict=True)
    return joined.select(row_id.alias("row_id"), F.col("_y").cast("int").alias("y"), *(F.col(c).cast("double").alias(f"x{i}") for c, i in named))


def written_features(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The named columns of features, or all, joined once and written: for queries that read them again."""
    return staged(features(spark, d).select(*(columns or ("*",))), "features")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """First four coordinates, moved to about [0, 1], and a label that is 1 for one of the ten kinds."""
    e = table(spark, d, "embeddings")
    u = [F.round(S.clip(F.get("embedding", i).cast("double") * 2 + 0.5, 0.0, 1.0), 6).alias(f"u{i}") for i in range(4)]
    return e.select(F.col("vec_id").alias("row_id"), (F.col("label") == 3).cast("int").alias("y"), F.col("label").alias("kind"), *u)


def bundled() -> dict[str, Column]:
    """The scores of a line by method: columns of line_scored, a constant and a noise control."""
    return {"price": F.col("s_a"), "quantity": F.col("s_b"), "const": F.lit(0.5), "neg_price": -F.col("s_a"), "noise": S.keyed_uniform(11, 0, "row_id")}


def score_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Long scores: five methods a row, a constant and a noise control among them."""
    line = line_scored(spark, d)
    each = F.array(*(F.struct(F.lit(k).alias("method"), v.cast("double").alias("score")) for k, v in bundled().items()))
    return line.select("row_id", "t", "y", "part", F.explode(each).alias("e")).select("row_id", "t", "y", "part", "e.method", "e.score")


def patterns(spark: SparkSession, d: str, seeds: int = 2) -> DataFrame:
    """Eight keyed non-negative numbers per event and seed, with sum one."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("row_id"), F.explode(F.sequence(F.lit(1), F.lit(seeds))).alias("seed"))
    # plain columns, each hashed once a row; inside a lambda the hashes would be taken again for each entry
    raw = [f"_r{k}" for k in range(8)]
    rows = rows.select("row_id", "seed", *(S.keyed_uniform("seed", F.lit(k), "row_id").alias(r) for k, r in enumerate(raw)))
    rows = rows.withColumn("_all", reduce(lambda a, b: a + b, map(F.col, raw)))
    return rows.select("row_id", "seed", F.array(*(F.col(r) / F.col("_all") for r in raw)).alias("p"))


def geo(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    at = {"lat": 90, "lon": 180, "mlat": 90, "mlon": 180}
    return c.select(F.col("c_custkey").alias("row_id"), *((S.keyed_uniform(5, i, "c_custkey") * 2 * r - r).alias(k) for i, (k, r) in enumerate(at.items())))


_ROW = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::INT)"
_Y = "(l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity >= 48)::INT"
VIEW_SQL: dict[str, str] = {
    "docs_labeled": "SELECT d.doc_id AS row_id, toxic AS y, lang, source, n_chars, quality FROM documents d LEFT JOIN labels l USING (doc_id)",
    "txn": "SELECT event_id AS row_id, floor(epoch_us(ts) / 1000000)::BIGINT AS t, user_id AS card, event_type AS category, value AS amount, props FROM events",
    "line_scored": f"""SELECT *, CASE WHEN {u_sql(7, 0, 'row_id')} < 0.5 THEN 'val' ELSE 'test' END AS part FROM (
        SELECT {_ROW} AS row_id, floor(epoch_us(l_shipdate) / 1000000)::BIGINT AS t, {_Y} AS y, l_extendedprice AS s_a, l_quantity AS s_b,
            l_discount AS s_c, round(l_quantity * 0.016 + l_discount * 2, 6) AS p FROM lineitem)""",
    "features": f"""SELECT {_ROW} AS row_id, {_Y} AS y, l_quantity AS x1, l_extendedprice AS x2, l_discount AS x3, l_tax AS x4, o_totalprice AS x5,
        p_size::DOUBLE AS x6, p_retailprice AS x7, s_acctbal AS x8 FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "vectors": "SELECT vec_id AS row_id, (label = 3)::INT AS y, label AS kind, "
    + ", ".join(f"round(greatest(0.0, least(1.0, embedding[{i + 1}]::DOUBLE * 2 + 0.5)), 6) AS u{i}" for i in range(4))
    + " FROM embeddings",
    "score_bundle": f"""SELECT row_id, t, y, part, unnest(['price', 'quantity', 'const', 'neg_price', 'noise']) AS method,
        unnest([s_a, s_b, 0.5::DOUBLE, -s_a, {u_sql(11, 0, 'row_id')}::DOUBLE]) AS score FROM line_scored""",
    "patterns": f"""SELECT row_id, seed, list_transform(raw, lambda x: x / list_sum(raw)) AS p FROM (
        SELECT event_id AS row_id, seed, list_transform(range(8), lambda k: {u_sql('seed', 'k', 'event_id')}) AS raw
        FROM events, (SELECT unnest([1, 2]) AS seed))""",
    "geo": "SELECT c_custkey AS row_id, "
    + ", ".join(f"{u_sql(5, i, 'c_custkey')} * {2 * r} - {r} AS {k}" for i, (k, r) in enumerate({"lat": 90, "lon": 180, "mlat": 90, "mlon": 180}.items()))
    + " FROM customer",
}
