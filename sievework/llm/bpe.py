"""Byte-level BPE: each distinct pre-token of the corpus is encoded once, then documents are put together by position."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of, written
from .wordblocks import by_position, valued, word_blocks

#: Rows whose decoded bytes a task holds at once.
SLICE = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file (one base64 token and its rank a line), read on the driver; its size is that of the vocabulary."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _cutter(pattern: str):
    import regex

    return regex.compile(pattern).findall


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: while neighbouring parts together make a token, the pair of lowest rank, the first of
    equal ones, becomes one part. A heap holds the pairs, so a word of n bytes takes n log n steps."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    if n < 32:
        parts = [word[i : i + 1] for i in range(n)]
        while True:
            pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            known = [p for p in pairs if p is not None]
            if not known:
                return [ranks[p] for p in parts]
            i = pairs.index(min(known))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
    # part i begins at byte i and ends where the next one begins; 0 marks one that has been taken up
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The pieces flat[starts[c] : starts[c] + lengths[c]] of all codes c, one after the other."""
    n = lengths[codes]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def token_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens, one after the other, and by id where a token's begin and how many they are."""
    tokens = sorted(ranks, key=ranks.get)
    ranked = np.array([ranks[t] for t in tokens])
    lengths, starts = np.zeros(ranked[-1] + 1, np.int64), np.zeros(ranked[-1] + 1, np.int64)
    lengths[ranked] = [len(t) for t in tokens]
    starts[ranked] = np.cumsum(lengths[ranked]) - lengths[ranked]
    return np.frombuffer(b"".join(tokens), np.uint8), starts, lengths


def bytes_of(ids: bytes, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> bytes:
    return gather(flat, starts, lengths, np.frombuffer(ids, "<u4")).tobytes()


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens and ids (little-endian unsigned 32-bit integers in one binary value) of every row's whole text.

    Texts are cut by `pattern`; every distinct match of the corpus is merged once by `ranks`, and its ids are joined
    back to the blocks that hold it. A null or empty text has no tokens. Repeated rows each give a row; columns other
    than the two named are ignored; an empty table gives an empty result.
    """
    return _encoded(docs, ranks, pattern, id_col, text_col, lambda ids: (len(ids), ids.tobytes()), "n_tokens long, ids binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What `decode` gives of `encode`: the task that has put a text's ids together decodes them from the token-byte table.

    Ids don't go to a second Python worker beside the first, so an executor has one worker for each core here, not two.
    """
    table = docs.sparkSession.sparkContext.broadcast(token_table(ranks))

    def both(ids: np.ndarray) -> tuple[int, bytes, bytes]:
        raw = ids.tobytes()
        return len(ids), raw, bytes_of(raw, *table.value)

    return _encoded(docs, ranks, pattern, id_col, text_col, both, "n_tokens long, ids binary, decoded binary")


def _encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str, text_col: str, of_ids: Callable[[np.ndarray], tuple], columns: str) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)
    coded, words = word_blocks(docs, id_col, text_col, lambda: _cutter(pattern))

    def merger():
        ranks = shipped.value
        return lambda word: np.array(merged(word.encode(), ranks), "<u4")

    def assemble(numbers: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple:
        return of_ids(gather(numbers, starts, lengths, codes))

    return by_position(coded, valued(words, merger), assemble, columns, id_col, docs.schema[id_col].dataType.simpleString())


def encode_rows(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What `encode` gives, in plain rows: one row per pre-token and position, a shuffle to the distinct words, which are
    merged once, a join of their ids back, and a sort by position. Rows are ten times the texts' bytes, and a frequent
    word is one key of the join; `encode` carries the same in blocks. Rows are told apart by a number."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)
    rows = written(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.monotonically_increasing_id().alias("row")), "numbered")

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(_cutter(pattern))

    @F.pandas_udf("array<int>")
    def merge(words: pd.Series) -> pd.Series:
        return words.map(lambda w: merged(w.encode(), shipped.value))

    places = rows.select("row", F.posexplode(cut("text")).alias("place", "word"))
    words = places.select("word").distinct().withColumn("ids", merge("word"))
    joined = places.join(words, "word").groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "ids"))), lambda x: x["ids"])).alias("ids"))
    return rows.select("id", "row").join(joined, "row", "left").select(F.col("id").alias(id_col), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def decode_rows(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """encode_rows' result with `decoded`: ids by position joined with the token-byte table, and put together in order."""
    table = encoded.sparkSession.createDataFrame([(i, t.hex()) for t, i in ranks.items()], "token int, bytes string")
    rows = written(encoded.withColumn("row", F.monotonically_increasing_id()), "numbered")
    places = rows.select("row", F.posexplode("ids").alias("place", "token")).join(table, "token")
    back = places.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "bytes"))), lambda x: x["bytes"]), "").alias("hex"))
    return rows.join(back, "row", "left").withColumn("decoded", F.unhex(F.coalesce("hex", F.lit("")))).drop("row", "hex")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """encoded with the column `decoded`: the bytes of its ids, joined from the token-byte table by id and position.

    The table has one row per token of the vocabulary, a fixed size, so every task gets it whole and gathers from it.
    Other columns pass through as Arrow has them. Null ids decode to null; an id that the vocabulary lacks fails the job.
    """
    table = encoded.sparkSession.sparkContext.broadcast(token_table(ranks))
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                back = [None if ids is None else bytes_of(ids, *table.value) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(back, pa.binary())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of decoded rows."""
    return encoded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
