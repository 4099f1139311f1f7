"""Dictionary-coded blocks of pre-tokens: the positions of a document's words as codes into its block's list of words.

Exploding every pre-token of a corpus into a row would shuffle far more bytes than the texts have. A block of whole
documents keeps its positions as codes instead, and its distinct words leave it in packed rows, one per bucket of
words. What is computed per word is computed once for each distinct word of the corpus, where all rows of a bucket
meet; the values go back to the blocks in the same order and are put together by position.
"""

from __future__ import annotations

import atexit
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, parts, text_of

#: A block ends at the document that takes it to this many code points; a longer document is a block of its own.
BLOCK_CHARS = 8_000_000
#: Buckets of words for each shuffle partition.
BUCKETS_A_PART = 2
#: Ends a word in a packed row; a word that holds it is led by ESCAPE.
END, ESCAPE = "\x00", "\x01"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def pack_words(words: list[str]) -> bytes:
    marked = (w.replace(ESCAPE, ESCAPE + "1").replace(END, ESCAPE + "0") if ESCAPE in w or END in w else w for w in words)
    return zlib.compress(END.join(marked).encode("utf-8", "surrogatepass"), 6)


def unpack_words(packed: bytes) -> list[str]:
    words = zlib.decompress(packed).decode("utf-8", "surrogatepass").split(END)
    return [w.replace(ESCAPE + "0", END).replace(ESCAPE + "1", ESCAPE) if ESCAPE in w else w for w in words]


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte plane by byte plane."""
    return zlib.compress(np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_numbers(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def dealt_buckets(words: list[str], prefix: int | None, n_buckets: int) -> np.ndarray:
    """The bucket of each word: a hash of the word, or of its first `prefix` code points. Where more words of the block than
    an even share of the buckets begin alike, they are dealt by twice as long a beginning, and so on."""
    if prefix is None:
        return np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % n_buckets for w in words], np.int64)
    most, out, left = max(8, len(words) // n_buckets), np.empty(len(words), np.int64), range(len(words))
    while left:
        alike: dict[str, list[int]] = {}
        for i in left:
            alike.setdefault(words[i][:prefix], []).append(i)
        left = []
        for start, members in alike.items():
            if len(members) > most:
                left += [i for i in members if len(words[i]) > prefix]
                members = [i for i in members if len(words[i]) <= prefix]
            out[members] = zlib.crc32(start.encode("utf-8", "surrogatepass")) % n_buckets
        prefix *= 2
    return out


def word_blocks(
    docs: DataFrame, id_col: str, text_col: str, splitter: Callable[[], Callable[[str], list[str]]], prefix: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(coded documents, words): (block, id, codes) and (bucket, block, packed words).

    splitter() is called in each task and gives the function that cuts a text into pre-tokens. Words are dealt to buckets
    by `dealt_buckets`. Codes number the words of a block by bucket and then by word.
    Both results are parts of one table in the shared folder, bucketed by block, so documents are not shuffled when
    their values come back. Null texts count as empty; a document without words has no codes. Rows are carried one by
    one, so repeated rows and repeated ids stay apart.
    """
    spark = docs.sparkSession
    n_buckets = BUCKETS_A_PART * parts(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = splitter()
        number = TaskContext.get().partitionId() << 40
        ids, coded, first_code, size = [], [], {}, 0
        for batch in batches:
            for id_, text in zip(batch["id"], batch["text"], strict=True):
                ids.append(id_)
                coded.append(np.array([first_code.setdefault(word, len(first_code)) for word in cut(text)], np.int32))
                size += len(text)
                if size >= BLOCK_CHARS:
                    yield from block(number, ids, coded, first_code)
                    number += 1
                    ids, coded, first_code, size = [], [], {}, 0
        if ids:
            yield from block(number, ids, coded, first_code)

    def block(number: int, ids: list, coded: list[np.ndarray], first_code: dict[str, int]) -> Iterator[pd.DataFrame]:
        words = list(first_code)
        buckets = dealt_buckets(words, prefix, n_buckets)
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        order = order[np.argsort(buckets[order], kind="stable")]
        code = np.empty(len(words), np.int32)
        code[order] = np.arange(len(words))
        yield pd.DataFrame({"block": number, "id": ids, "codes": [pack_numbers(code[c]) for c in coded], "bucket": None, "words": None})
        if not words:
            return
        buckets = buckets[order]
        edges = np.flatnonzero(np.diff(buckets, prepend=-1)).tolist()
        lists = [pack_words([words[i] for i in order[a:b].tolist()]) for a, b in zip(edges, [*edges[1:], len(words)], strict=True)]
        yield pd.DataFrame({"block": number, "id": None, "codes": None, "bucket": buckets[edges], "words": lists})

    # ids travel as text: pandas would turn integers beside nulls into floats
    schema = "block long, id string, codes binary, bucket int, words binary"
    source = docs.select(F.col(id_col).cast("string").alias("id"), text_of(text_col).alias("text"))
    name = f"sievework_blocks_{uuid.uuid4().hex}"
    with _small_batches(spark):
        writer = source.mapInPandas(run, schema).write.format("parquet").option("path", new_path(spark, "blocks"))
        writer.bucketBy(parts(spark), "block").saveAsTable(name)
    atexit.register(_forget, spark, name)
    coded = spark.table(name).where("codes IS NOT NULL").select("block", "id", "codes")
    return coded, spark.table(name).where("words IS NOT NULL").select("bucket", F.col("block").alias("of_block"), "words")


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Fewer texts in each Arrow batch while the blocks are written."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, "500")
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def _forget(spark: SparkSession, name: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None and not sc._jsc.sc().isStopped():
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def valued(words: DataFrame, of_bucket: Callable[[], Callable[[str], np.ndarray]]) -> DataFrame:
    """(block, bucket, lengths, numbers): for every packed word the unsigned 32-bit numbers that it is worth.

    All rows of a bucket meet in one task, one after the other; of_bucket() is called for each bucket and gives the
    function of a word, which is called once for each distinct word of the corpus.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, known, worth = None, {}, None
        for batch in batches:
            out = []
            for bucket, block, packed in zip(batch["bucket"], batch["of_block"], batch["words"], strict=True):
                if bucket != current:
                    current, known, worth = bucket, {}, of_bucket()
                values = []
                for word in unpack_words(packed):
                    value = known.get(word)
                    if value is None:
                        value = known[word] = worth(word)
                    values.append(value)
                lengths = np.array([len(v) for v in values], np.uint32)
                out.append((block, bucket, pack_numbers(lengths), pack_numbers(np.concatenate(values))))
            yield pd.DataFrame(out, columns=["of_block", "bucket", "lengths", "numbers"])

    dealt = words.repartition(parts(words.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInPandas(run, "of_block long, bucket int, lengths binary, numbers binary")


def by_position(coded: DataFrame, values: DataFrame, of_document: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple], columns: str, id_col: str, id_type: str) -> DataFrame:
    """One row per document: its id (as id_type) and of_document(numbers, starts, lengths, codes), where the word of code c is worth
    numbers[starts[c] : starts[c] + lengths[c]]. A task holds one block's words and documents."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(documents: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        words = words.sort_values("bucket")
        lengths = np.concatenate([np.zeros(0, np.int64), *(unpack_numbers(x).astype(np.int64) for x in words["lengths"])])
        numbers = np.concatenate([np.zeros(0, "<u4"), *(unpack_numbers(x) for x in words["numbers"])])
        starts = np.cumsum(lengths) - lengths
        rows = [of_document(numbers, starts, lengths, unpack_numbers(codes)) for codes in documents["codes"]]
        out = pd.DataFrame(rows, columns=names)
        out.insert(0, id_col, documents["id"].array)
        return out

    out = coded.groupBy("block").cogroup(values.groupBy("of_block")).applyInPandas(run, f"{id_col} string, {columns}")
    return out.withColumn(id_col, F.col(id_col).cast(id_type))
