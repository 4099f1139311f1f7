"""How filters act on each other: what each removes, in every order in which they can be applied."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

#: What the transducer says of a byte: a word begins here, one ended before it, a code point begins, a capital, a symbol.
BEGINS, ENDED, POINT, CAPITAL, SYMBOL = 1, 2, 4, 8, 16
#: Byte classes. Bytes that no UTF-8 text has are STRAY, as are further bytes where none are due.
SPACE, UPPER, SIGN, PLAIN, FURTHER, TWO, THREE, FOUR, STRAY = range(9)
#: States: between words, in a word, and in a word with one, two or three further bytes of a code point due.
GAP, WORD, DUE = 0, 1, 2
#: Bytes that a lane of the transducer reads, and those that it reads before, after which its state is known.
LANE, BEFORE = 512, 4
#: Bytes of text that are read at once, or one longer text.
BLOCK = 1 << 20
#: Bytes of words that are compared at once.
COMPARED = 1 << 21
#: Odd multiplier of the words' hash.
BASE = 0x9E3779B97F4A7C15


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each byte, next state and output by state * 16 + class); the next state comes already multiplied by 16."""
    classes = np.full(256, PLAIN, np.uint8)
    classes[[*range(9, 14), 32]] = SPACE
    classes[65:91] = UPPER
    classes[list(b"#$%&*|")] = SIGN
    classes[0x80:0xC0], classes[0xC0:0xE0], classes[0xE0:0xF0], classes[0xF0:] = FURTHER, TWO, THREE, FOUR
    classes[[0xC0, 0xC1, *range(0xF5, 0x100)]] = STRAY
    goes, says = np.zeros(5 * 16, np.uint8), np.zeros(5 * 16, np.uint8)
    for state in range(5):
        for kind in range(9):
            at = state * 16 + kind
            if kind == FURTHER and state >= DUE:
                goes[at] = (state - 1) * 16
                continue
            goes[at] = 16 * {SPACE: GAP, TWO: DUE, THREE: DUE + 1, FOUR: DUE + 2}.get(kind, WORD)
            says[at] = POINT | {UPPER: CAPITAL, SIGN: SYMBOL}.get(kind, 0)
            if kind == SPACE:
                says[at] |= ENDED if state != GAP else 0
            elif state == GAP:
                says[at] |= BEGINS
    return classes, goes, says


CLASSES, GOES, SAYS = tables()


def transduced(data: np.ndarray) -> np.ndarray:
    """The transducer's output for each byte. Lanes of LANE bytes go in step; each begins BEFORE bytes early, since after
    so many bytes, of which at most three can be further bytes of a code point, the state no longer depends on what was
    before."""
    n = len(data)
    lanes = -(-n // LANE)
    padded = np.full(BEFORE + lanes * LANE, SPACE, np.uint8)
    padded[BEFORE : BEFORE + n] = CLASSES[data]
    steps = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (lanes, LANE + BEFORE), (LANE, 1), writeable=False).T)
    out, state = np.empty((LANE + BEFORE, lanes), np.uint8), np.full(lanes, GAP * 16, np.uint8)
    for kind, says in zip(steps, out, strict=True):
        at = state | kind
        np.take(SAYS, at, out=says)
        np.take(GOES, at, out=state)
    return out[BEFORE:].T.reshape(-1)[:n]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span, from running sums over all bytes."""
    with np.errstate(over="ignore"):
        powers = np.full(len(data), BASE, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)])
        # multiplied up to the power of the last byte of all, so that a word's hash doesn't depend on its place
        return (sums[ends] - sums[starts]) * powers[len(data) - 1 - starts]


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans of equal length that begin at a and at b have the same bytes."""
    same = np.ones(len(a), bool)
    done = np.cumsum(lengths)
    low = 0
    while low < len(a):
        high = max(low + 1, int(np.searchsorted(done, done[low] - lengths[low] + COMPARED, "right")))
        size = lengths[low:high]
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum()))
        differ = data[at + np.repeat(a[low:high] - first, size)] != data[at + np.repeat(b[low:high] - first, size)]
        same[low:high] = ~np.logical_or.reduceat(differ, first)
        low = high
    return same


def first_of_equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which spans are the first of their owner with their bytes.

    All spans enter one hash table of open addressing, a probe of each still homeless span at a time. A slot holds the
    first span that came to it; one that meets a span of the same owner, length and hash is equal only if their bytes are.
    """
    n = len(starts)
    first = np.zeros(n, bool)
    bits = max(4, (2 * n).bit_length())
    held, lengths = np.full(1 << bits, -1, np.int64), ends - starts
    with np.errstate(over="ignore"):
        mixed = (hashes(data, starts, ends) ^ (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)) * np.uint64(BASE)
    slot = (mixed >> np.uint64(64 - bits)).astype(np.int64)
    left = np.arange(n)
    while len(left):
        at = slot[left]
        free = held[at] < 0
        held[at[free][::-1]] = left[free][::-1]  # of several the first is written last
        there = held[at]
        first[left[there == left]] = True
        left, there = left[there != left], there[there != left]
        alike = (owner[left] == owner[there]) & (lengths[left] == lengths[there]) & (mixed[left] == mixed[there])
        alike[alike] = same_bytes(data, starts[left[alike]], starts[there[alike]], lengths[left[alike]])
        left = left[~alike]
        slot[left] = (slot[left] + 1) & ((1 << bits) - 1)
    return first


def counted(texts: list[bytes]) -> np.ndarray:
    """Words, distinct words, capitals, code points and symbols of each text, one row each."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    at = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    said = transduced(data)
    starts, ends = np.flatnonzero(said & BEGINS), np.flatnonzero(said & ENDED)
    owner = np.searchsorted(at, starts, "right") - 1
    first = first_of_equal(data, starts, ends, owner)
    points, capitals, symbols = (np.add.reduceat((said & bit) != 0, at, dtype=np.int64) for bit in (POINT, CAPITAL, SYMBOL))
    # each text has one more code point here, the space after it
    return np.stack([np.bincount(owner, minlength=len(texts)), np.bincount(owner[first], minlength=len(texts)), capitals, points - 1, symbols], 1)


def blocks(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of BLOCK bytes together, or of one longer text."""
    block, size = [], 0
    for text in texts:
        if block and size + len(text) > BLOCK:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text) + 1
    if block:
        yield block


COUNTS = ("n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols")


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with COUNTS instead of the text: words (runs of anything but ASCII white space), distinct words (case counts), the
    letters A to Z, code points, and the symbols #$%&*|. A null text counts as empty. A byte that isn't UTF-8 counts as a code
    point and as part of a word. A text is read whole, one longer than BLOCK by itself."""
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(*others, F.col(text_col).cast("binary").alias(text_col))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others), *(f"{c} long" for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.concatenate([counted(block) for block in blocks(t.as_py() or b"" for t in batch.column(len(others)))])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, found.T.copy())], [*others, *COUNTS])

    return rows.mapInArrow(run, schema)


#: Conditions under which a text fails, by the letter of the filter; that of copies, COPIES, needs the whole table.
CONDITIONS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 3 * n_chars",
    "D": "n_symbols > 0",
}
COPIES = "E"


def failures(docs: DataFrame, labels: DataFrame, conditions: dict[str, str], copies: str, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """One row per part and set of failed filters: part, fails (bits in the order of the letters), n, good, toxic.

    Equal texts fail equal conditions, so rows are first counted by digest, id and what else matters; the rows with the
    smallest id of a digest are the ones that do not fail as copies. No step needs the rows of a digest together.
    """
    letters = sorted([*conditions, copies])
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    bits = [F.when(F.expr(condition), F.lit(1 << letters.index(x))).otherwise(F.lit(0)) for x, condition in conditions.items()]
    rows = text_counts(rows).select("id", "part", "digest", sum(bits[1:], bits[0]).alias("fails"))
    cells = written(rows.groupBy("digest", "id", "part", "fails").agg(F.count(F.lit(1)).alias("n")), "cells")
    smallest = cells.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"))).alias("least"))
    smallest = smallest.select(F.col("digest").alias("of"), F.col("least.id").alias("least"), F.lit(0).alias("stays"))
    copy = F.when(F.col("stays").isNull(), F.lit(1 << letters.index(copies))).otherwise(F.lit(0))
    same = (F.col("digest") == F.col("of")) & F.col("id").eqNullSafe(F.col("least"))
    cells = cells.join(smallest, same, "left").select("id", "part", "n", (F.col("fails") + copy).alias("fails"))
    marks = labels.select(F.col(id_col).alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marks = marks.where("id IS NOT NULL AND (good OR toxic)").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    # rows without an id have no labels and stay out of the join
    known = cells.where("id IS NOT NULL").groupBy("id", "part", "fails").agg(F.sum("n").alias("n")).join(marks, "id", "left")
    both = known.select("part", "fails", "n", "good", "toxic").unionByName(cells.where("id IS NULL").select("part", "fails", "n"), allowMissingColumns=True)
    of = lambda mark: F.sum(F.when(F.col(mark), F.col("n")).otherwise(F.lit(0))).alias(mark)
    return both.groupBy("part", "fails").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def interactions(failed: DataFrame, letters: list[str]) -> DataFrame:
    """From rows part, fails, n, good, toxic: one row per part, order of the letters and step, with what `audit` returns.

    A part has at most 2^len(letters) rows; they become one, and each order and step adds up those that it concerns.
    """
    orders = ["".join(o) for o in permutations(letters)]
    bit = {x: 1 << i for i, x in enumerate(letters)}
    steps = [{"filter_order": o, "step": i + 1, "own": bit[x], "earlier": sum(bit[y] for y in o[:i])} for o in orders for i, x in enumerate(o)]
    steps = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,own:int,earlier:int>>")
    sets = failed.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"))
    both = sets.select("part", "sets", F.inline(steps))
    own, earlier = F.col("own"), F.col("earlier")

    def total(what: str, where) -> Column:
        return F.aggregate("sets", F.lit(0).cast("long"), lambda t, s: t + F.when(where(s["fails"]), s[what]).otherwise(F.lit(0)))

    fails = lambda f: f.bitwiseAND(own) > 0
    past = lambda f: f.bitwiseAND(earlier) == 0
    # a set of m failed filters is removed by each of them in the m-th part of the orders
    share = lambda s: F.floor(F.lit(factorial(len(letters))) / F.greatest(F.bit_count(s["fails"]), F.lit(1))) * s["n"]
    shapley = F.aggregate("sets", F.lit(0).cast("long"), lambda t, s: t + F.when(fails(s["fails"]), share(s)).otherwise(F.lit(0)))
    return both.select(
        "part", "filter_order", "step", total("n", lambda f: f.bitwiseAND(own.bitwiseOR(earlier)) == 0).alias("kept"), total("n", lambda f: fails(f) & past(f)).alias("removed"),
        total("n", lambda f: fails(f) & ~past(f)).alias("redundant"), total("n", lambda f: f == own).alias("unique_fails"), total("good", lambda f: fails(f) & past(f)).alias("good_lost"),
        total("toxic", lambda f: fails(f) & past(f)).alias("toxic_lost"), shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, str] = CONDITIONS, copies: str = COPIES, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, filter_order and step: kept (after this step), removed (by it), redundant (its filter fails them, but
    an earlier one has removed them), unique_fails (only its filter fails them), good_lost and toxic_lost (of the removed, by
    label), shapley (what its filter removes at whatever step, summed over all orders).

    conditions: SQL over COUNTS by the filter's letter; the filter `copies` fails every text that is identical to that of a
    smaller id, by its 256-bit digest. Parts are the values of part_col as text; null and the empty string are one part.

    A null text counts as empty. Null ids order last among equal texts and have no labels; rows with the smallest id of
    their text never fail as copies, repeated or not. Of several labels of an id one that is 1 counts. Long texts are
    read whole. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    return interactions(failures(docs, labels, conditions, copies, id_col, text_col, part_col), sorted([*conditions, copies]))
