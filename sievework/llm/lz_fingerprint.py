"""Lempel-Ziv phrase fingerprints, and each document's likeness to its edited text and to its neighbour."""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts, text_of

#: Number of smallest phrase hashes in a fingerprint.
SIZE = 128
MASK = (1 << 64) - 1
MULTIPLIER = 6364136223846793005


def code_points(text: str) -> list[int]:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").tolist()


class Phrases:
    """The growing phrase dictionary of one text: a new phrase is the longest known one and the code point after it."""

    def __init__(self, steps: dict[int, int] | None = None, hashes: list[int] | None = None, node: int = 0) -> None:
        self.steps, self.hashes, self.node = steps or {}, hashes or [1], node

    def copy(self) -> Phrases:
        return Phrases(self.steps.copy(), self.hashes.copy(), self.node)

    def read(self, points: list[int]) -> Phrases:
        steps, hashes, node = self.steps, self.hashes, self.node
        known = steps.get
        for c in points:
            key = node << 21 | c
            after = known(key)
            if after is None:
                steps[key] = len(hashes)
                hashes.append(hashes[node] * MULTIPLIER + c + 1 & MASK)
                node = 0
            else:
                node = after
        self.node = node
        return self

    def fingerprint(self) -> np.ndarray:
        """The SIZE smallest 32-bit hashes of the phrase set, in order; all of them where there are fewer."""
        h = np.array(self.hashes[1:], np.uint64)
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        return np.unique((h >> np.uint64(32)).astype("<u4"))[:SIZE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two phrase sets: the share, among the smallest hashes of both, of those in both.

    1 for two empty texts, 0 where one of them is empty.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    k = SIZE if max(len(a), len(b)) >= SIZE else len(a) + len(b)
    smallest = np.union1d(a, b)[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(both <= smallest[-1]) / len(smallest))


def written_out(fingerprint: np.ndarray) -> str:
    return base64.b64encode(fingerprint.astype("<u4").tobytes()).decode()


#: Sampled ids for each range of ids.
SAMPLED = 30


def cuts_of(ids: DataFrame, ranges: int) -> list:
    """ranges - 1 ids in order, null first, at even steps of a sorted sample of the column `id`; an id that many rows have
    stands there more than once. SAMPLED ids a range are put in order in one task, whatever the number of rows."""
    share = SAMPLED * ranges / max(1, ids.count())
    sample = ids.sample(False, share, 17) if share < 1 else ids
    numbered = sample.select("id", F.row_number().over(Window.orderBy(F.asc_nulls_first("id"))).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("m"))
    slice_ = lambda i: F.floor(i * ranges / F.col("m"))
    # as many cuts as steps that end at the row, more than one where the sample is smaller than the ranges
    times = F.least(slice_(F.col("i")), F.lit(ranges - 1)) - slice_(F.col("i") - 1)
    return [r.id for r in numbered.where(times > 0).orderBy("i").select("id", times.alias("times")).collect() for _ in range(r.times)]


def range_of(edges: list, type_: T.DataType) -> Column:
    """How many of the edges, distinct ids in order, are at or below the row's id, found by halving. A null id is below all
    others and at an edge that is null."""
    known = [e for e in edges if e is not None]
    none = len(edges) - len(known)
    if not known:
        return F.lit(none)
    cuts = F.array(*(F.lit(e) for e in known)).cast(T.ArrayType(type_))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(known).bit_length()))))
    # beyond the last edge there is null, which no id is at or above
    found = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.coalesce(F.get(cuts, low + step - 1) <= F.col("id"), F.lit(False)), low + step).otherwise(low))
    return F.lit(none) + F.when(F.col("id").isNull(), 0).otherwise(found)


def neighbours(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns part, extra, id, text: the documents dealt out by ranges of ids, in descending order within each part.

    The last document of a part needs the first one of the next lower part (the lowest needs the highest), so those
    first documents, one for each part, come a second time as extra rows at the end. One shuffle of the texts. Parts are
    cut at sampled ids, compared as they are, so ids of any length that begin alike are cut like others. Null ids order
    last. Rows with equal ids follow each other by a hash of the text; an id that many rows share is cut into parts by
    that hash.
    """
    spark, type_ = docs.sparkSession, docs.schema[id_col].dataType
    if not isinstance(type_, T.NumericType | T.StringType):
        raise TypeError(f"ids must be numbers or strings, not {type_.simpleString()}")
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("mixed"))
    ranges = parts(spark)
    cuts = cuts_of(rows.select("id"), ranges) if ranges > 1 else []
    times = Counter(cuts)
    edges = list(dict.fromkeys(cuts))
    pieces = {e: n for e, n in times.items() if n > 1}
    dealt = rows.withColumn("range", range_of(edges, type_))
    # parts number the ranges upwards; a hot id has its pieces before the rest of the range that it begins
    first_part, at = [0], 0
    for edge in edges:
        at += 1
        first_part.append(at)
        at += pieces.get(edge, 0)
    n_parts = at + 1
    base = F.element_at(F.array(*map(F.lit, first_part)), (F.col("range") + 1).cast("int"))
    if pieces:
        known = {e: n for e, n in pieces.items() if e is not None}
        held = F.lit(None).cast("int") if not known else F.element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)).cast(T.MapType(type_, T.IntegerType())), F.col("id"))
        held = F.when(F.col("id").isNull(), F.lit(pieces.get(None)).cast("int")).otherwise(held)
        of_range = F.element_at(F.array(*(F.lit(pieces.get(e, 0)) for e in [None, *edges])), (F.col("range") + 1).cast("int"))
        piece = F.floor((F.shiftrightunsigned("mixed", 1) / float(1 << 63)) * held)
        dealt = dealt.withColumn("part", (base + F.when(held.isNotNull(), F.least(piece, held - 1)).otherwise(of_range)).cast("int"))
    else:
        dealt = dealt.withColumn("part", base.cast("int"))
    rank = F.struct(F.col("id").isNotNull().alias("known"), "id", F.shiftrightunsigned("mixed", 1).alias("mixed"))
    # one row for each part that has rows: what its first document is
    firsts = sorted(dealt.groupBy("part").agg(F.max(rank).alias("first")).collect(), key=lambda r: r.part)
    if not firsts:
        return dealt.select("part", F.lit(0).alias("extra"), "id", "text")
    id_type = type_.simpleString()
    goes_to = [(r.first.known, r.first.id, r.first.mixed, r.part, firsts[(i + 1) % len(firsts)].part) for i, r in enumerate(firsts)]
    extra = spark.createDataFrame(goes_to, f"known boolean, first_id {id_type}, first_mixed long, own int, also int")
    on = (F.col("part") == F.col("own")) & F.col("id").eqNullSafe(F.col("first_id")) & (F.shiftrightunsigned("mixed", 1) == F.col("first_mixed"))
    both = dealt.join(F.broadcast(extra), on, "left").select(
        "id", "text", F.shiftrightunsigned("mixed", 1).alias("mixed"), F.explode(F.array_compact(F.array(
            F.struct(F.col("part"), F.lit(0).alias("extra")),
            F.when(F.col("also").isNotNull(), F.struct(F.col("also").alias("part"), F.lit(1).alias("extra"))),
        ))).alias("to"),
    )
    both = both.select("to.part", "to.extra", "mixed", "id", "text").repartitionById(n_parts, F.col("part"))
    return both.sortWithinPartitions("part", "extra", F.desc_nulls_last("id"), F.desc("mixed")).drop("mixed")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the document's with its last floor(n_chars / 2) code points replaced by the first as many, or
    all, of the next document in descending order of id (after the last: the first). Both texts are parsed whole; what
    they have in common is parsed once. A null text counts as empty and has the empty fingerprint; likeness is 1
    between two empty texts and 0 between an empty and another one. A single document is its own neighbour. Equal
    texts have equal fingerprints. Ids are numbers or strings, of any size; null ids order last; rows with equal ids
    follow each other by a hash of the text. An empty table gives an empty result; other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def finish(mine: tuple, text: str, print_: np.ndarray) -> tuple:
        id_, own, first_half, own_print = mine
        half = len(own) // 2
        tail = text[:half]
        edited = first_half.read(code_points(tail)).fingerprint()
        return (id_, len(own), own[: len(own) - half] + tail, written_out(own_print), written_out(edited), likeness(own_print, edited), likeness(own_print, print_))

    columns = [id_col, "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, of_part = None, None
        for batch in batches:
            done = []
            for part, extra, id_, text in zip(batch["part"], batch["extra"], batch["id"], batch["text"], strict=True):
                if extra and (waiting is None or part != of_part):
                    continue  # one more document with the id of the first
                keep = len(text) - len(text) // 2
                first_half = Phrases().read(code_points(text[:keep]))
                print_ = first_half.copy().read(code_points(text[keep:])).fingerprint()
                if waiting is not None:
                    done.append(finish(waiting, text, print_))
                waiting, of_part = (None, None) if extra else ((id_, text, first_half, print_), part)
            yield pd.DataFrame(done, columns=columns)

    # ids travel as text: pandas would turn integers beside nulls into floats
    schema = f"{id_col} string, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    dealt = neighbours(docs, id_col, text_col).withColumn("id", F.col("id").cast("string"))
    return dealt.mapInPandas(run, schema).withColumn(id_col, F.col(id_col).cast(id_type))
