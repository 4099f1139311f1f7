"""Queries: scans, contracts, projections, joins, set operations, scalar functions."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import contracts as C
from ..sources import scans
from . import views as V
from .staging import scratch
from .views import query, table, u_sql

R = F.round


def split_of(df: DataFrame) -> DataFrame:
    """Keyed 60/20/20 split of line_scored rows."""
    u = S.keyed_uniform(21, 0, "row_id")
    return df.withColumn("split", F.when(u < 0.6, "train").when(u < 0.8, "val").otherwise("test"))


SPLIT_SQL = f"SELECT *, CASE WHEN {u_sql(21, 0, 'row_id')} < 0.6 THEN 'train' WHEN {u_sql(21, 0, 'row_id')} < 0.8 THEN 'val' ELSE 'test' END AS split FROM line_scored"
V.VIEW_SQL["line_split"] = SPLIT_SQL
LS = ("line_scored", "line_split")


@query("SELECT c_custkey, c_acctbal FROM customer")
def scan_csv_projected(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "csv")
    table(spark, d, "customer").write.csv(path, header=True)
    return scans.read_csv(spark, path, table(spark, d, "customer").schema, ["c_custkey", "c_acctbal"])


@query("SELECT * FROM customer")
def scan_csv_full(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "csv")
    table(spark, d, "customer").write.csv(path, header=True)
    return scans.read_csv(spark, path, table(spark, d, "customer").schema)


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def scan_parquet(spark: SparkSession, d: str) -> DataFrame:
    return scans.read_parquet(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query("SELECT c_custkey AS id, c_mktsegment AS kind, c_acctbal AS amount FROM customer WHERE c_custkey % 50 <> 0")
def scan_text_table(spark: SparkSession, d: str) -> DataFrame:
    """The customers as a sectioned gzip text, where every fiftieth row is cut short, read back as typed rows."""
    path = scratch(spark, "sectioned")
    c = table(spark, d, "customer")
    row = F.concat_ws(",", F.col("c_custkey").cast("string"), F.concat(F.lit("'"), "c_mktsegment", F.lit("'")), F.col("c_acctbal").cast("string"))
    value = F.when(F.col("c_custkey") % 50 == 0, F.col("c_custkey").cast("string")).otherwise(row)
    head = spark.createDataFrame([(0, "@relation customers"), (1, "@data")], "line long, value string")
    body = c.select((F.col("c_custkey") + 2).alias("line"), value.alias("value"))
    head.unionByName(body).select(F.concat_ws("\t", F.col("line").cast("string"), "value").alias("value")).write.text(path, compression="gzip")
    raw = spark.read.text(path).select(F.lit("customers").alias("file"), F.split_part("value", F.lit("\t"), F.lit(1)).cast("long").alias("line"), F.regexp_replace("value", r"^\d+\t", "").alias("value"))
    return scans.read_sectioned(raw, ["id", "kind", "amount"], {"id": "long", "amount": "double"}).select("id", "kind", "amount")


@query("SELECT row_id, method, score FROM score_bundle", "line_scored", "score_bundle")
def score_bundle_read(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "bundle")
    V.score_bundle(spark, d).select("row_id", "method", "score").write.parquet(path)
    return spark.read.schema("row_id string, method string, score double").parquet(path)


@query("SELECT method, count(*) AS n, count(*) FILTER (NOT isfinite(score)) AS bad, count(*) = (SELECT count(*) FROM line_scored) AND count(*) FILTER (NOT isfinite(score)) = 0 AS valid FROM score_bundle GROUP BY method", "line_scored", "score_bundle")
def score_bundle_write(spark: SparkSession, d: str) -> DataFrame:
    return scans.checked_bundle(V.score_bundle(spark, d), table(spark, d, "lineitem").count())


@query("SELECT part, count(*) AS n, sum(y) AS positives FROM line_scored GROUP BY part", "line_scored")
def results_json(spark: SparkSession, d: str) -> DataFrame:
    """Nested results written as JSON and read back under their schema."""
    path = scratch(spark, "json")
    found = V.line_scored(spark, d).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))
    found.select("part", F.struct("n", "positives").alias("counts")).write.json(path)
    return spark.read.schema("part string, counts struct<n: long, positives: long>").json(path).select("part", "counts.n", "counts.positives")


@query("SELECT * FROM supplier")
def write_once(spark: SparkSession, d: str) -> DataFrame:
    return scans.write_once(table(spark, d, "supplier"), scratch(spark, "once"))


@query("SELECT split, count(*) AS n FROM line_split GROUP BY split", *LS)
def sealed_partition_write(spark: SparkSession, d: str) -> DataFrame:
    opened, sealed = scratch(spark, "open"), scratch(spark, "sealed")
    scans.write_sealed(split_of(V.line_scored(spark, d)).select("row_id", "y", "split"), opened, sealed)
    both = spark.read.parquet(opened).select("row_id", "y", "split").unionByName(spark.read.parquet(sealed))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM line_split WHERE split <> 'test'", *LS)
def sealed_read_guard(spark: SparkSession, d: str) -> DataFrame:
    opened, sealed = scratch(spark, "open"), scratch(spark, "sealed")
    scans.write_sealed(split_of(V.line_scored(spark, d)).select("row_id", "split"), opened, sealed)
    return scans.guarded_reader(spark, (sealed,))(opened).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT split, count(*) AS n, CASE WHEN split <> 'test' THEN sum(y) END AS positives, CASE WHEN split <> 'test' THEN round(avg(y), 9) END AS rate,
    CASE WHEN split <> 'test' THEN min(t) END AS t_min, CASE WHEN split <> 'test' THEN max(t) END AS t_max FROM line_split GROUP BY split""", *LS)
def ingest_manifest(spark: SparkSession, d: str) -> DataFrame:
    return C.ingest_manifest(split_of(V.line_scored(spark, d))).withColumn("rate", R("rate", 9))


@query("""WITH k AS (SELECT row_id, count(*) AS n FROM line_scored GROUP BY row_id)
    SELECT unnest(['null_key', 'repeated_key', 'label_not_binary', 'not_finite_p', 'outside_unit_p']) AS "check", unnest([
        (SELECT count(*) FROM line_scored WHERE row_id IS NULL), (SELECT sum(n - 1)::BIGINT FROM k WHERE row_id IS NOT NULL),
        (SELECT count(*) FROM line_scored WHERE y NOT IN (0, 1) OR y IS NULL), (SELECT count(*) FROM line_scored WHERE p IS NULL OR NOT isfinite(p)),
        (SELECT count(*) FROM line_scored WHERE p < 0 OR p > 1)]) AS violations""", "line_scored")
def row_contract(spark: SparkSession, d: str) -> DataFrame:
    return C.row_contract(V.line_scored(spark, d), "row_id", "y", ["p"])


@query("SELECT 0::BIGINT AS missing, 0::BIGINT AS unknown, 0::BIGINT AS overlapping, (SELECT 0 * count(*) FROM line_scored) AS label_differs", "line_scored")
def split_partition_check(spark: SparkSession, d: str) -> DataFrame:
    rows = V.line_scored(spark, d)
    return C.split_check(rows, split_of(rows), "row_id", "y")


@query("""SELECT count(*) AS rows, bit_xor(h) AS xor_hash, sum(h)::BIGINT AS sum_hash FROM (
    SELECT ('0x' || substr(md5(concat_ws('|', coalesce(o_orderkey::VARCHAR, chr(0)), coalesce(o_orderstatus, chr(0)), coalesce(o_orderpriority, chr(0)))), 1, 8))::BIGINT AS h FROM orders)""")
def table_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return scans.fingerprint(table(spark, d, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority"])


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """path, bytes, sha of each document, as a release would list its files."""
    docs = table(spark, d, "documents")
    return docs.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha"), "doc_id")


def observed_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The same with rows missing (id mod 50 = 1), changed (mod 50 = 2) and renamed to another suffix (mod 50 = 3)."""
    m, k = manifest(spark, d), F.col("doc_id") % 50
    path = F.when(k == 3, F.regexp_replace("path", ".txt$", ".key")).otherwise(F.col("path"))
    return m.where(k != 1).select(path.alias("path"), "bytes", F.when(k == 2, F.reverse("sha")).otherwise(F.col("sha")).alias("sha"), "doc_id")


V.VIEW_SQL["manifest"] = "SELECT 'docs/' || doc_id || '.txt' AS path, octet_length(encode(text)) AS bytes, sha256(text) AS sha, doc_id FROM documents"
V.VIEW_SQL["seen"] = """SELECT CASE WHEN doc_id % 50 = 3 THEN regexp_replace(path, '.txt$', '.key') ELSE path END AS path, bytes,
    CASE WHEN doc_id % 50 = 2 THEN reverse(sha) ELSE sha END AS sha, doc_id FROM manifest WHERE doc_id % 50 <> 1"""
MS = ("manifest", "seen")


@query("""SELECT m.path, CASE WHEN s.path IS NULL THEN 'missing' ELSE 'differs' END AS reason FROM manifest m LEFT JOIN seen s USING (path)
    WHERE s.path IS NULL OR s.sha <> m.sha""", *MS)
def source_lock(spark: SparkSession, d: str) -> DataFrame:
    return scans.hash_mismatches(manifest(spark, d).drop("doc_id"), observed_manifest(spark, d), "path", "sha")


@query("""SELECT count(*) AS n, min(t) AS t_min, max(t) AS t_max, count(DISTINCT t) AS times, count(*) AS matched, count(*) AS labels_match, count(*) AS amounts_match,
    (SELECT count(*) FROM (SELECT t < lag(t) OVER (ORDER BY row_id) AS f FROM txn) WHERE f) AS falls FROM txn""", "txn")
def time_source_check(spark: SparkSession, d: str) -> DataFrame:
    rows = V.txn(spark, d).withColumn("y", (F.col("category") == "error").cast("int"))
    return C.time_source_check(rows, rows, "row_id", "row_id", 1e-9)


@query("SELECT row_id, x1::FLOAT::DOUBLE AS x1, x2::FLOAT::DOUBLE AS x2, x5::FLOAT::DOUBLE AS x5 FROM features", "features")
def project_features(spark: SparkSession, d: str) -> DataFrame:
    return V.features(spark, d).select("row_id", *(F.col(c).cast("float").cast("double").alias(c) for c in ("x1", "x2", "x5")))


@query("SELECT row_id, x3, x1 FROM features", "features")
def column_dedup(spark: SparkSession, d: str) -> DataFrame:
    return V.features(spark, d).select(*dict.fromkeys(["row_id", "x3", "x1", "x3", "row_id"]))


@query("SELECT row_id, p FROM line_split WHERE split = 'train' AND y = 0", *LS)
def split_filter(spark: SparkSession, d: str) -> DataFrame:
    return split_of(V.line_scored(spark, d)).where("split = 'train' AND y = 0").select("row_id", "p")


@query("SELECT row_id, p FROM line_scored WHERE p > 0.4 AND p <= 0.8", "line_scored")
def band_filter(spark: SparkSession, d: str) -> DataFrame:
    return V.line_scored(spark, d).where("p > 0.4 AND p <= 0.8").select("row_id", "p")


@query("""SELECT CASE WHEN p > 0.8 THEN 'above' WHEN p > 0.4 THEN 'band' ELSE 'below' END AS region, count(*) AS n, sum(y) AS positives FROM line_scored GROUP BY 1""", "line_scored")
def route_regions(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.routing import region

    return V.line_scored(spark, d).groupBy(region(F.col("p"), 0.4, 0.8).alias("region")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))


@query("SELECT row_id, CASE WHEN p > 0.4 AND p <= 0.8 THEN round(p * p, 9) ELSE p END AS final, false AS changed_off_band FROM line_scored", "line_scored")
def scatter_update(spark: SparkSession, d: str) -> DataFrame:
    base = V.line_scored(spark, d).select("row_id", "p")
    band = base.where("p > 0.4 AND p <= 0.8").withColumn("p", R(F.col("p") * F.col("p"), 9))
    return C.scatter_update(base, band, "row_id", "p").select("row_id", "final", "changed_off_band")


@query("SELECT row_id, coalesce(quality::DOUBLE, -1.0) AS quality FROM docs_labeled", "docs_labeled")
def null_sentinel(spark: SparkSession, d: str) -> DataFrame:
    return V.docs_labeled(spark, d).select("row_id", S.sentinel(F.col("quality").cast("double")).alias("quality"))


@query("SELECT method, count(*) AS n FROM score_bundle WHERE method <> 'price' GROUP BY method", "line_scored", "score_bundle")
def finite_filter(spark: SparkSession, d: str) -> DataFrame:
    """One method's score is spoilt by a single NaN and goes as a whole."""
    spoilt = F.when((F.col("method") == "price") & (F.col("y") == 1), float("nan")).otherwise(F.col("score"))
    return C.finite_methods(V.score_bundle(spark, d).withColumn("score", spoilt)).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT row_id, y, quality, lang FROM docs_labeled", "docs_labeled")
def left_equi_join(spark: SparkSession, d: str) -> DataFrame:
    return V.docs_labeled(spark, d).select("row_id", "y", "quality", "lang")


@query("""SELECT row_id, coalesce(n, 0) AS n FROM txn LEFT JOIN (SELECT card, count(*) AS n FROM txn WHERE category = 'error' GROUP BY card) USING (card)""", "txn")
def dictionary_join(spark: SparkSession, d: str) -> DataFrame:
    rows = V.txn(spark, d)
    counts = rows.where("category = 'error'").groupBy("card").agg(F.count(F.lit(1)).alias("n"))
    return C.dictionary_join(rows.select("row_id", "card"), "card", counts, "n", F.lit(0)).select("row_id", "n")


@query("""SELECT a.method AS left_method, b.method AS right_method, count(*) AS n, count(*) FILTER (a.y <> b.y) AS label_mismatches
    FROM score_bundle a JOIN score_bundle b USING (row_id) WHERE a.method = 'price' AND b.method IN ('quantity', 'noise') GROUP BY 1, 2""", "line_scored", "score_bundle")
def row_aligned_join(spark: SparkSession, d: str) -> DataFrame:
    s = V.score_bundle(spark, d)
    a, b = s.where("method = 'price'").alias("a"), s.where("method IN ('quantity', 'noise')").alias("b")
    return a.join(b, F.col("a.row_id") == F.col("b.row_id")).groupBy(F.col("a.method").alias("left_method"), F.col("b.method").alias("right_method")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("a.y") != F.col("b.y")).alias("label_mismatches"))


@query("""WITH m AS (SELECT row_id FROM line_split WHERE y = 1 AND s_b = 49),
    f AS (SELECT row_id, 'fit' AS role, y FROM line_split WHERE split <> 'test' AND row_id NOT IN (SELECT row_id FROM m)),
    e AS (SELECT row_id, 'eval' AS role, y FROM line_split WHERE split = 'test' AND (y = 0 OR row_id IN (SELECT row_id FROM m)))
    SELECT role, count(*) AS n, sum(y) AS positives FROM (FROM f UNION ALL FROM e) GROUP BY role""", *LS)
def mode_holdout_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Positives of one kind (quantity 49) are kept from the fit and are the only positives of the evaluation."""
    rows = split_of(V.line_scored(spark, d))
    mode = rows.where("y = 1 AND s_b = 49").select("row_id")
    fit = rows.where("split <> 'test'").join(mode, "row_id", "left_anti").select(F.lit("fit").alias("role"), "y")
    test = rows.where("split = 'test'")
    evaluation = test.where("y = 0").unionByName(test.where("y = 1").join(mode, "row_id", "left_semi")).select(F.lit("eval").alias("role"), "y")
    return fit.unionByName(evaluation).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))


@query("SELECT row_id, y FROM line_split WHERE y = 1 AND split IN ('train', 'val') UNION ALL SELECT row_id, y FROM line_split WHERE y = 0 AND split = 'test'", *LS)
def union_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = split_of(V.line_scored(spark, d)).select("row_id", "y", "split")
    return rows.where("y = 1 AND split IN ('train', 'val')").unionByName(rows.where("y = 0 AND split = 'test'")).select("row_id", "y")


@query("""SELECT path, 'missing' AS side FROM (SELECT path FROM manifest EXCEPT ALL SELECT path FROM seen)
    UNION ALL SELECT path, 'unexpected' FROM (SELECT path FROM seen EXCEPT ALL SELECT path FROM manifest)""", *MS)
def manifest_difference(spark: SparkSession, d: str) -> DataFrame:
    a, b = manifest(spark, d).select("path"), observed_manifest(spark, d).select("path")
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("unexpected")))


@query("""SELECT s.path, CASE WHEN s.path LIKE '%.key' THEN 'forbidden suffix' ELSE 'content differs' END AS reason FROM seen s LEFT JOIN manifest m USING (path)
    WHERE s.path LIKE '%.key' OR m.sha <> s.sha OR m.bytes <> s.bytes""", *MS)
def manifest_intersect_mismatch(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.report import manifest_mismatch

    return manifest_mismatch(manifest(spark, d), observed_manifest(spark, d), (".key", ".pem"))


@query("""SELECT 'train' AS left_split, 'val' AS right_split, 0::BIGINT AS common UNION ALL SELECT 'train', 'test', 0 UNION ALL SELECT 'val', 'test', (SELECT 0 * count(*) FROM line_split)""", *LS)
def disjoint_check(spark: SparkSession, d: str) -> DataFrame:
    rows = split_of(V.line_scored(spark, d)).select("row_id", "split")
    side = lambda s: rows.where(F.col("split") == s).select("row_id")
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    out = [side(a).intersect(side(b)).agg(F.count(F.lit(1)).alias("common")).select(F.lit(a).alias("left_split"), F.lit(b).alias("right_split"), "common") for a, b in pairs]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""WITH a AS (SELECT c_custkey AS id, unnest(['balance', 'segment']) AS path, unnest([c_acctbal::VARCHAR, c_mktsegment]) AS v FROM customer),
    b AS (SELECT id, path, CASE WHEN id % 10 = 0 AND path = 'segment' THEN 'OTHER' ELSE v END AS v FROM a WHERE NOT (id % 10 = 1 AND path = 'balance'))
    SELECT id || '.' || a.path AS path, CASE WHEN b.v IS NULL THEN 'missing' ELSE 'value' END AS reason FROM a LEFT JOIN b USING (id, path) WHERE b.v IS NULL OR a.v <> b.v""")
def result_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two result trees over the customers, one with changed and missing leaves and other run times."""
    from ..operators.report import flattened, result_diff

    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.struct(F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.lit(1.5).alias("elapsed_s")).alias("r"))
    changed = F.struct(
        F.when(F.col("id") % 10 != 1, F.col("r.balance")).alias("balance"), F.when(F.col("id") % 10 == 0, "OTHER").otherwise(F.col("r.segment")).alias("segment"), F.lit(9.5).alias("elapsed_s"))
    return result_diff(flattened(c, "id", "r"), flattened(c.withColumn("r", changed), "id", "r"))


@query("SELECT row_id, ((t // 3600) % 24)::INT AS hour, ((t // 86400) % 7)::INT AS weekday FROM txn", "txn")
def fn_time_parts(spark: SparkSession, d: str) -> DataFrame:
    return V.txn(spark, d).select("row_id", S.hour_of(F.col("t")).alias("hour"), S.weekday_of(F.col("t")).alias("weekday"))


@query("SELECT row_id, round(sin(2 * pi() * (t % 86400) / 86400.0), 9) + 0.0 AS hour_sin, round(cos(2 * pi() * (t % 86400) / 86400.0), 9) + 0.0 AS hour_cos FROM txn", "txn")
def fn_cyclic_hour(spark: SparkSession, d: str) -> DataFrame:
    s, c = S.cyclic_hour(F.pmod("t", F.lit(86400)) / 3600)
    return V.txn(spark, d).select("row_id", R(s, 9).alias("hour_sin"), R(c, 9).alias("hour_cos"))


@query("SELECT row_id, round(ln(1 + amount), 9) AS log_amount, round(amount - floor(amount), 6) AS decimals FROM txn", "txn")
def fn_amount_parts(spark: SparkSession, d: str) -> DataFrame:
    return V.txn(spark, d).select("row_id", R(F.log1p("amount"), 9).alias("log_amount"), R(S.fraction(F.col("amount")), 6).alias("decimals"))


@query("""SELECT row_id, round(2 * 6371.0 * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians(mlat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(mlat)) * pow(sin(radians(mlon - lon) / 2), 2))))), 5) AS km FROM geo""", "geo")
def fn_haversine(spark: SparkSession, d: str) -> DataFrame:
    return V.geo(spark, d).select("row_id", R(S.haversine(*(F.col(c) for c in ("lat", "lon", "mlat", "mlon"))), 5).alias("km"))


@query("SELECT row_id, round(ln(q / (1 - q)), 8) AS logit, round(1 / (1 + exp(-p)), 8) AS sigmoid FROM (SELECT *, least(1 - 1e-7, greatest(1e-7, p)) AS q FROM line_scored)", "line_scored")
def fn_logit(spark: SparkSession, d: str) -> DataFrame:
    return V.line_scored(spark, d).select("row_id", R(S.logit(F.col("p")), 8).alias("logit"), R(S.sigmoid(F.col("p")), 8).alias("sigmoid"))


@query("SELECT row_id, substr(sha256('salt:' || row_id), 1, 16) AS token FROM txn", "txn")
def fn_token(spark: SparkSession, d: str) -> DataFrame:
    return V.txn(spark, d).select("row_id", S.token("salt", F.col("row_id")).alias("token"))


@query("SELECT row_id, ((row_id >> 2) & 1)::INT AS bit2, (bit_count(row_id & 13) % 2)::INT AS parity, lpad(bin(row_id & 255), 8, '0') AS pattern FROM txn", "txn")
def fn_bits(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("row_id")
    return V.txn(spark, d).select("row_id", S.bit(i, 2).cast("int").alias("bit2"), S.parity(i, F.lit(13).cast("long")).cast("int").alias("parity"), S.binary(i.bitwiseAND(255), 8).alias("pattern"))


@query("""SELECT row_id, seed, round(list_dot_product(p, p), 9) AS norm2, list_position(p, list_max(p)) - 1 AS top, round(p[2] + p[4] + p[6] + p[8], 9) AS odd_mass FROM patterns""", "patterns")
def fn_vector(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    odd = S.total(F.filter(p, lambda x, i: i % 2 == 1))
    return V.patterns(spark, d).select("row_id", "seed", R(S.dot(p, p), 9).alias("norm2"), S.argmax(p).alias("top"), R(odd, 9).alias("odd_mass"))
