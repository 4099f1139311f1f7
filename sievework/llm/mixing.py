"""Mixing sources to target weights by a low-discrepancy schedule over shuffled blocks of equal numbers of words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, join_groups, parts, running, text_of, written

#: Weights of the sources in code-point order of their names, repeating; null comes last.
WEIGHTS = (5, 2, 1)
#: The mix has this share of all words; a source gives at most MOST_PASSES times its own.
SHARE, MOST_PASSES = 1.5, 2
#: Words in a block, which one slot of the schedule takes.
BLOCK = 1024
#: 2^32 divided by the golden ratio: slot j stands at the fractional part of j / ratio.
GOLDEN = 2654435769
#: Consecutive slots that are ranked together.
CHUNK = 1 << 14


def size_of(text_col: str = "text") -> Column:
    """Number of words: runs of anything but ASCII white space."""
    return F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_passes: int = MOST_PASSES) -> DataFrame:
    """One row per source: key, docs, source_size, weight, target, ordinal.

    Targets share `share` of all words by weight; one that would pass most_passes times its source's words stops there
    and the excess goes to the others by weight, until none is above. In order of cap / weight the first sources are
    those that stop, so running sums give the level at which the rest meet. Any number of sources is spread over tasks.
    """
    by = sized.groupBy("source", "key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    by = running(by, [F.col("source").isNull(), F.encode(F.col("source").cast("string"), "UTF-8")], [], "by-name").withColumnRenamed("number", "ordinal")
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("ordinal") % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", (F.col("source_size") * most_passes).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = running(by, [F.col("ratio"), F.col("ordinal")], ["cap", "weight"], "by-ratio")
    whole = by.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    by = by.withColumn("level", (share * (whole.words or 0) - F.col("before_cap")) / ((whole.weight or 0) - F.col("before_weight")))
    # the level of the first source that does not stop holds for all that follow
    free = by.where("level <= ratio").agg(F.min(F.struct("ratio", "ordinal", "level")).alias("first")).first().first
    target = F.col("cap") if free is None else F.least(F.col("cap"), F.lit(free.level) * F.col("weight"))
    return by.withColumn("target", target).select("key", "docs", "source_size", "weight", "target", "ordinal")


def _numbered(sized: DataFrame) -> DataFrame:
    """sized with `start`: the words of the source that come before the document in an order shuffled by a hash of the id.

    Rows of one id, or without one, follow each other by the hash of their texts and then by number. Ranges of the whole
    order are summed up in tasks of their own, so neither a source nor an id that many rows share is one task.
    """
    mixed = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc").cast("string"), F.lit("")))), 1, 10), 16, 10).cast("long")
    order = [F.col(c) for c in ("ordinal", "mixed", "doc", "row", "nth")]
    placed = running(sized.withColumn("mixed", mixed), order, ["size"], "in-order")
    return placed.withColumn("start", F.col("before_size") - F.col("ahead")).drop("before_size", "ahead", "mixed", "nth", "number")


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """(ordinal, slot, rank) of `slots` slots: slot j falls, by the golden ratio, on the source whose share of all needs it
    hits. sources: (ordinal, needs), one row per source. rank numbers a source's slots in the order of the schedule.

    Slots and the points at which sources begin run in one order; the last beginning before a slot is its source. The
    order is cut into cells of about CHUNK slots, each of which also has the source in which it begins. Ranks are
    counted in chunks of slots, whose counts are then summed up.
    """
    spark = sources.sparkSession
    cells = max(1, slots // CHUNK)
    total = sources.agg(F.sum("needs")).first()[0]
    spans = running(sources.where("needs > 0"), [F.col("ordinal")], ["needs"], "spans")
    low, high = F.col("before_needs") / F.lit(float(total or 1)), (F.col("before_needs") + F.col("needs")) / F.lit(float(total or 1))
    cell = lambda c: F.least(F.floor(c * cells), F.lit(cells - 1)).cast("int")
    first, last = cell(low), cell(high)
    begins = spans.select("ordinal", low.alias("point"), first.alias("cell"))
    covers = spans.where(last > first).select("ordinal", F.explode(F.sequence(first + 1, last)).alias("cell"))
    edges = begins.unionByName(covers.select("ordinal", (F.col("cell") / F.lit(float(cells))).alias("point"), "cell"))
    point = F.pmod(F.col("id") * GOLDEN, F.lit(1 << 32)) / float(1 << 32)
    drawn = spark.range(0, slots, 1, max(1, min(parts(spark), cells))).select(F.col("id").alias("slot"), point.alias("point"))
    both = drawn.withColumn("cell", cell(F.col("point"))).unionByName(edges, allowMissingColumns=True)
    upto = Window.partitionBy("cell").orderBy("point", F.col("slot").isNotNull(), "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("own", F.last("ordinal", True).over(upto)).where("slot IS NOT NULL AND own IS NOT NULL")
    found = found.select(F.col("own").alias("ordinal"), "slot", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = found.groupBy("ordinal", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("ordinal").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("ordinal", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    here = F.row_number().over(Window.partitionBy("ordinal", "chunk").orderBy("slot")) - 1
    return found.withColumn("here", here).join(bases, ["ordinal", "chunk"]).select("ordinal", "slot", (F.col("base") + F.col("here")).alias("rank"))


def plan(sources: DataFrame) -> tuple[DataFrame, int]:
    """(slots, their number): ordinal, slot, pass, block, words, from sources (ordinal, source_size, goal).

    A source needs as many slots as it has blocks up to its goal, pass after pass. The schedule has as many slots as all
    need together; by its discrepancy a source has some too many there, which stay empty, or some too few, which follow
    at the end. More of these than a golden-ratio sequence can lack is an error.
    """
    blocks = F.ceil(F.col("source_size") / BLOCK)
    needs = F.floor(F.col("goal") / F.col("source_size")) * blocks + F.ceil(F.col("goal") % F.col("source_size") / BLOCK)
    sources = written(sources.where("goal > 0").select("ordinal", "source_size", "goal", blocks.alias("blocks"), needs.cast("long").alias("needs")), "needs")
    slots = sources.agg(F.coalesce(F.sum("needs"), F.lit(0))).first()[0]
    drawn = written(schedule(sources.select("ordinal", "needs"), slots), "schedule")
    had = sources.join(drawn.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n")), "ordinal", "left").select("ordinal", "needs", F.coalesce("n", F.lit(0)).alias("n"))
    short = running(had.where("needs > n").withColumn("short", F.col("needs") - F.col("n")), [F.col("ordinal")], ["short"], "short")
    most = short.agg(F.coalesce(F.max("short"), F.lit(0)).alias("one"), F.coalesce(F.sum("short"), F.lit(0)).alias("all")).first()
    bound = (4 + 2 * math.log(max(1, slots))) * (1 + (slots >> 32))
    if most.one > bound:
        raise RuntimeError(f"a source lacks {most.one} of {slots} slots; the schedule's discrepancy is below {bound:.0f}")
    closing = short.select("ordinal", "n", "before_short", F.explode(F.sequence(F.lit(0), (F.col("short") - 1).cast("int"))).alias("i"))
    closing = closing.select("ordinal", (slots + F.col("before_short") + F.col("i")).alias("slot"), (F.col("n") + F.col("i")).alias("rank"))
    rows = drawn.unionByName(closing).join(sources, "ordinal").where("rank < needs")
    rows = rows.withColumn("pass", F.floor(F.col("rank") / F.col("blocks"))).withColumn("block", F.col("rank") % F.col("blocks"))
    at = F.col("block") * BLOCK
    words = F.least(F.lit(BLOCK), F.col("source_size") - at, F.col("goal") - F.col("pass") * F.col("source_size") - at)
    return rows.select("ordinal", "slot", "pass", "block", words.cast("long").alias("words")), slots + most["all"]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken (words the mix takes of it, repeats counted),
    slots (for each pass that takes words of it the first slot that does, in order), row (the hash of id and text).

    Each source's documents are shuffled by hash and laid end to end, and the words are cut into blocks of BLOCK. The
    schedule (`plan`) gives each source slots in proportion to what it needs; the slot of rank r takes the source's block
    r, starting again after the last, and the last slot takes part of its block. A document's `taken` is the sum over the
    slots whose blocks it lies in, so each source's sum is its target rounded, and no document exceeds MOST_PASSES times
    its size. Of any run of slots each source has its share, but for the discrepancy.

    Null texts and texts of white space have size 0 and nothing is taken of them. A null source is a source of its own,
    the last in order. Ids may be null or repeat: rows are told apart by a hash of id and text; equal rows follow
    each other, in any order. Reruns agree. An empty table gives an empty result; other columns are ignored.
    """
    sized = docs.select(F.col(id_col).alias("doc"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), F.xxhash64(id_col, text_col).alias("row"), F.monotonically_increasing_id().alias("nth"))
    sized = sized.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")))
    sized = written(sized, "sizes")
    sources = running(targets(sized).withColumn("goal", F.round("target").cast("long")), [F.col("ordinal")], ["source_size"], "sources")
    sources = written(sources.drop("number").withColumnRenamed("before_source_size", "ahead"), "sources")
    joined = join_groups(sized, sources.select("key", "docs", "ordinal", "source_size", "target", "ahead"), ["key"], "docs", sized.count()).drop("docs", "key")
    planned, _ = plan(sources)
    placed = written(_numbered(joined), "placed")
    within = F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK))
    pieces = placed.where("size > 0").select("ordinal", "start", "size", F.explode(within).alias("block"))
    low, high = F.greatest(F.col("start"), F.col("block") * BLOCK), F.least(F.col("start") + F.col("size"), F.col("block") * BLOCK + F.col("words"))
    got = pieces.join(planned, ["ordinal", "block"]).withColumn("part", high - low).where("part > 0")
    of_pass = [F.min(F.when(F.col("pass") == p, F.col("slot"))).alias(f"slot_{p}") for p in range(MOST_PASSES)]
    got = got.groupBy("ordinal", "start", "size").agg(F.sum("part").alias("taken"), *of_pass)
    slots = F.array_sort(F.array_compact(F.array(*(f"slot_{p}" for p in range(MOST_PASSES)))))
    names = [F.col("doc").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target"]
    return placed.join(got, ["ordinal", "start", "size"], "left").select(*names, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), slots.alias("slots"), "row")


def stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them, with all their columns, in the order of the slots: each as often as `taken`
    holds its size, rounded; one without words stays once, before all others. Of the words of a document that the mix
    takes in part, half or more count as a whole. A copy stands at the slot at which its pass begins to take it.

    Rows with equal ids and texts share what the mix takes of them; null texts, ids and sources, an empty table and
    further columns, whatever their names, are as in `mix`.
    """
    key, slot, copies = (free_name(docs, n) for n in ("mix_key", "mix_slot", "mix_copies"))
    of = lambda row: F.concat_ws("#", F.hex(row), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    keyed = docs.withColumn(key, of(F.xxhash64("doc_id", "text")))
    sizes = mix(docs.select("doc_id", "text", "source")).withColumn(key, of(F.col("row")))
    sizes = sizes.groupBy(key).agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"), F.min("slots").alias("slots"))
    times = F.round(F.col("taken") / F.col("size")).cast("int")
    chosen = sizes.select(key, F.when(F.col("size") == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.slice("slots", F.lit(1), F.greatest(times, F.lit(0)))).alias(copies))
    chosen = written(chosen.where(F.size(copies) > 0), "chosen")
    last = chosen.agg(F.max(F.array_max(copies))).first()[0]
    rows = keyed.join(chosen, key).withColumn(slot, F.explode(copies))
    ranges = parts(spark)
    part = F.least(F.floor((F.col(slot) + 1) * ranges / float((last or 0) + 2)), F.lit(ranges - 1)).cast("int")
    return rows.repartitionById(ranges, part).sortWithinPartitions(slot, key).drop(key, slot, copies)
