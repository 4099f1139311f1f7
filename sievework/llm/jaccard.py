"""Similarity join of documents on word 5-grams: MinHash bands propose, full n-gram sets decide."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, parts, text_of, written

WORDS = 5
THRESHOLD = 0.8
#: Share of the pairs at the threshold that must meet in a band.
RECALL = 0.9999
#: Documents, and bytes of n-grams, in one side of a comparison task; larger groups are split into blocks of this size on average.
BLOCK, BLOCK_BYTES = 256, 4 << 20
#: Bands that a document shares with the first one of their buckets to be compared with all documents of its group.
CORE_BANDS = 4
#: Distinct n-grams held as columns of one dense incidence matrix.
COLUMNS = 8192
MOST_WORDS_REMEMBERED = 1_000_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 6) -> tuple[int, int]:
    """(bands, rows): the fewest bands of `rows` minima with 1 - (1 - threshold^rows)^bands >= recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


class Grams:
    """The sorted 64-bit hashes of a text's word n-grams. Words are the lower-cased runs between ASCII white space."""

    def __init__(self, n: int = WORDS) -> None:
        self.n, self.known = n, {}

    def word(self, word: bytes) -> int:
        import xxhash

        if len(self.known) > MOST_WORDS_REMEMBERED:
            self.known.clear()
        self.known[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: str) -> np.ndarray:
        known = self.known
        words = text.lower().encode("utf-8", "surrogatepass").split()
        h = np.array([known.get(w) or self.word(w) for w in words], np.uint64)
        if not len(h):
            return h
        n = min(self.n, len(h))
        grams = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            grams = (grams ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            grams ^= grams >> np.uint64(29)
        return np.unique(grams)


class Bands:
    """One 64-bit hash per band of minima over random linear maps of the n-gram hashes."""

    def __init__(self, bands: int, rows: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.shape = (bands, rows)
        self.a = rng.integers(1, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.mix = rng.integers(1, 1 << 63, rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for start in range(0, len(grams), 4096):
            g = grams[start : start + 4096]
            x = g[:, None] * self.a
            x ^= x >> np.uint64(32)
            np.minimum(least, x.min(0), out=least)
        return (least.reshape(self.shape) * self.mix).sum(1, dtype=np.uint64).view(np.int64)


def word_key(text: str) -> bytes:
    """Equal for texts with the same sequence of lower-cased words."""
    return hashlib.blake2b(b" ".join(text.lower().encode("utf-8", "surrogatepass").split()), digest_size=16).digest()


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, n: int) -> DataFrame:
    """id, word_key, bands (null for a text without words), n_grams of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, banded = Grams(n), Bands(bands, rows)
        for batch in batches:
            sets = [grams.of(t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "word_key": [word_key(t) for t in batch["text"]], "bands": [banded.of(s) if len(s) else None for s in sets], "n_grams": [len(s) for s in sets]})

    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return source.mapInPandas(run, f"id {id_type}, word_key binary, bands array<long>, n_grams long")


def components(members: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node of each connected component, from rows (node, bucket); a bucket links its members.

    Labels go from nodes to buckets and back as minima, which Spark sums up before it shuffles, and then jump to the
    label of the label; buckets and labels that hold many rows are joined by broadcast (`join_groups`). Each round is
    written to the shared folder.
    """
    members = written(members.distinct(), "members")
    total = members.count()
    sizes = written(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")), "sizes")
    sized = written(join_groups(members, sizes, ["bucket"], "size", total), "sized")
    labels = written(sized.groupBy("node").agg(F.min("node").alias("label")), "labels")
    for _ in range(most_rounds):
        seen = sized.join(labels, "node")
        least = seen.groupBy("bucket", "size").agg(F.min("label").alias("least"))
        seen = written(join_groups(sized.drop("size"), least, ["bucket"], "size", total), "seen")
        after = seen.groupBy("node").agg(F.min("least").alias("label"))
        after = written(after.join(labels.withColumnRenamed("label", "before"), "node"), "after")
        count = after.count()
        counts = after.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
        jump = counts.join(after.select(F.col("node").alias("label"), F.col("label").alias("further")), "label")
        jumped = join_groups(after, written(jump, "jump"), ["label"], "size", count)
        after = written(jumped.select("node", F.least("label", "further").alias("label"), "before"), "labels")
        labels = after.select("node", "label")
        if not after.where("label <> before").limit(1).count():
            return labels
    raise RuntimeError(f"components: not settled after {most_rounds} rounds")


def _linked(sets: list[np.ndarray], of_left: np.ndarray, of_right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (left, right) whose sets have a Jaccard similarity of threshold or more, by blocked matrix products."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    grams, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1  # an n-gram of one set only adds to no intersection
    new = np.cumsum(times > 1) - 1
    owner, column = owner[shared], new[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(of_left), len(of_right)), np.float32)
    for start in range(0, int((times > 1).sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[owner[lo:hi], column[lo:hi] - start] = 1
        both += m[of_left] @ m[of_right].T
    either = sizes[of_left][:, None] + sizes[of_right][None, :] - both
    return np.nonzero(both >= threshold * either - 1e-9)


def _compare(group: pd.DataFrame, threshold: float) -> list[tuple]:
    """(node, root, links) of each document of a group, or pair of its blocks, that has a link here. In a bucket of a band
    only pairs of different groups count that share no earlier band."""
    sets = [np.frombuffer(g, np.uint64) for g in group["grams"]]
    block, nodes, weight = group["block"].to_numpy(), group["node"].to_numpy(), group["size"].to_numpy()
    left = np.flatnonzero(block == group["left"].iloc[0])
    right = np.flatnonzero(block == group["right"].iloc[0])
    i, j = _linked(sets, left, right, threshold)
    i, j = left[i], right[j]
    apart = i < j if group["left"].iloc[0] == group["right"].iloc[0] else i != j
    band = group["band"].iloc[0]
    if band >= 0:
        of = group["label"].to_numpy()
        apart &= of[i] != of[j]
    if band > 0:
        bands = np.stack(group["bands"].to_numpy())[:, :band]
        apart &= ~(bands[i] == bands[j]).any(1)
    i, j = i[apart], j[apart]
    links = np.zeros(len(nodes), np.int64)
    np.add.at(links, i, weight[j])
    np.add.at(links, j, weight[i])
    root = np.arange(len(nodes))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(nodes[x], nodes[top(x)], int(links[x])) for x in np.flatnonzero(links)]


def comparisons(met: DataFrame, n_grams: DataFrame) -> DataFrame:
    """(node, label, work): what each candidate is to be compared with, as entries (group, band, blocks, block).

    met: (node, band, bucket, size) of all buckets with two documents or more. A document that shares CORE_BANDS bands
    with the smallest one of their buckets belongs to its group, and groups hang together by such documents only, so
    a chance collision joins none. Within a group (band -1) all pairs are compared. A pair of different groups that
    meets in a bucket is compared there: such buckets, whole, are further entries. So a document is sent once for its
    group, and once for each bucket in which it meets another group. Large groups and buckets are cut into blocks.
    """
    total = max(1, met.count())
    leads = written(met.groupBy("bucket", "size").agg(F.min("node").alias("first")), "leads")
    led = join_groups(met.drop("size"), leads, ["bucket"], "size", total)
    near = written(led.where("node <> first").groupBy("first", "node").agg(F.count(F.lit(1)).alias("bands")).where(F.col("bands") >= CORE_BANDS).select("first", "node"), "near")
    cores = components(near.select("node", F.col("first").alias("bucket")).unionByName(near.select(F.col("first").alias("node"), F.col("first").alias("bucket"))))
    nodes = met.select("node").distinct().join(cores, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    nodes = written(nodes.join(n_grams, "node"), "nodes")
    blocks = lambda docs, grams: F.greatest(F.ceil(F.col(docs) / BLOCK), F.ceil(F.col(grams) * 8 / BLOCK_BYTES)).cast("int")
    sizes = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_grams").alias("grams"))
    own = join_groups(nodes, written(sizes, "group-sizes"), ["label"], "docs", max(1, nodes.count())).where("docs > 1")
    own = own.select("node", F.xxhash64("label", F.lit("group")).alias("group"), F.lit(-1).alias("band"), blocks("docs", "grams").alias("blocks"))
    placed = written(met.join(nodes, "node"), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("docs"), F.sum("n_grams").alias("grams")).where("low <> high")
    across = join_groups(placed, written(mixed.drop("low", "high"), "mixed"), ["bucket"], "docs", total)
    across = across.select("node", F.col("bucket").alias("group"), "band", blocks("docs", "grams").alias("blocks"))
    work = own.unionByName(across).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    return written(work.groupBy("node").agg(F.collect_list(F.struct("group", "band", "blocks", "block")).alias("work")).join(nodes, "node"), "work")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, n: int = WORDS) -> DataFrame:
    """One row per document: id, class_id, class_size, copy_of, n_links.

    Two documents are linked when the Jaccard similarity of their sets of word n-grams (a shorter text: the one gram
    of all its words) is threshold or more. class_id is the smallest id of the documents that are linked directly or
    through others, class_size their number, n_links the number of other documents linked directly. Documents with the
    same words are linked and carried as one (copy_of: the smallest id among them), weighted by their number.

    Bands of minima propose candidates (`comparisons`), which are verified on their full n-gram sets, pair of blocks by
    pair of blocks; only counts and spanning links leave such a task, and classes are closed over verified links alone.
    Nothing is capped or sampled; a pair at the threshold is proposed with probability `recall` at least.

    A text without words, null or empty, is a copy of other such texts and linked to nothing else. Rows must have ids;
    rows with a null id are left out. Repeated rows count as one. An empty table gives an empty result.
    """
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    bands, rows = choose_bands(threshold, recall)
    docs = docs.where(F.col(id_col).isNotNull())
    signed = written(signatures(docs, id_col, text_col, bands, rows, n), "signatures")
    keys = signed.select("id", "word_key").distinct()
    total = signed.count()
    copies = written(keys.groupBy("word_key").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("size")), "copies")
    member = written(join_groups(keys, copies, ["word_key"], "size", total), "copy-members")

    firsts = signed.join(copies.select(F.col("node").alias("id"), "word_key"), ["id", "word_key"]).dropDuplicates(["id"])
    firsts = firsts.where("bands IS NOT NULL").select(F.col("id").alias("node"), "bands", "n_grams")
    banded = firsts.select("node", F.posexplode("bands").alias("band", "hash"))
    banded = written(banded.select("node", "band", F.xxhash64("band", "hash").alias("bucket")), "bands")
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = written(join_groups(banded, written(shared, "shared"), ["bucket"], "size", max(1, banded.count())), "met")
    work = comparisons(met, firsts.select("node", "n_grams"))

    texts = docs.select(F.col(id_col).alias("node"), text_of(text_col).alias("text"))
    info = work.join(copies.select("node", "size"), "node").join(firsts.select("node", "bands"), "node")
    texts = texts.join(info, "node").dropDuplicates(["node"])

    @F.pandas_udf("binary")
    def grams_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams = Grams(n)
        for batch in batches:
            yield pd.Series([grams.of(t).tobytes() for t in batch])

    sets = texts.select("node", "label", "size", "bands", "work", grams_of("text").alias("grams"))
    # small groups share tasks of about BLOCK documents; a large one has a task for each pair of its blocks
    small = work.select("n_grams", F.explode("work").alias("w")).where("w.blocks = 1").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n_grams"), F.lit(0)).alias("grams")).first()
    tasks = max(1, math.ceil(small.docs / BLOCK), math.ceil(small.grams * 8 / BLOCK_BYTES), parts(spark))
    own = F.col("w.block")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("w.blocks") - 1), lambda o: F.struct(F.least(own, o).alias("left"), F.greatest(own, o).alias("right"))))
    sent = sets.withColumn("w", F.explode("work")).select("node", "label", "size", "grams", "w", F.when(F.col("w.band") > 0, F.col("bands")).alias("bands"), pair.alias("pair"))
    sent = sent.select("node", "label", "size", "grams", "bands", "w.group", "w.band", "w.block", "w.blocks", "pair.left", "pair.right")
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("group"), F.lit(tasks))).otherwise(F.xxhash64("group", "left", "right"))

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (of, left, right), part in group.groupby(["group", "left", "right"], sort=False):
            out += [(node, root, links, of, left, right) for node, root, links in _compare(part, threshold)]
        return pd.DataFrame(out, columns=["node", "root", "links", "of", "left", "right"])

    found = sent.withColumn("task", task).groupBy("task").applyInPandas(verify, f"node {id_type}, root {id_type}, links long, of long, left int, right int")
    found = written(found, "links")
    classes = components(found.select("node", F.xxhash64("of", "left", "right", "root").alias("bucket")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links")).join(classes, "node")

    # what is linked to another text, and the copies of each: rows per document
    known = member.select("node", "size").distinct().join(linked, "node", "left")
    known = written(known.select("node", "size", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links")), "known")
    class_sizes = known.groupBy("label").agg(F.sum("size").alias("class_size"), F.count(F.lit(1)).alias("texts"))
    known = written(join_groups(known, written(class_sizes, "class-sizes"), ["label"], "texts", max(1, known.count())), "classes")
    result = join_groups(member.select("id", "node"), known.select("node", "size", "label", "links", "class_size"), ["node"], "size", total)
    return result.select(
        F.col("id").alias(id_col), F.col("label").alias("class_id"), "class_size", F.col("node").alias("copy_of"), (F.col("links") + F.col("size") - 1).alias("n_links")
    )


def stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents with the smallest id of their class, with all their columns; rows without an id stay, and so do all rows
    that share the smallest id. Null, empty and very long texts, an empty table and further columns, whatever their
    names, are as in `similar`."""
    firsts = similar(docs).where("class_id = doc_id").select("doc_id").distinct()
    return docs.join(firsts, "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id IS NULL"))
