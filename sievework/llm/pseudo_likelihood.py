"""Masked pseudo-likelihood of documents under a window network that predicts every token from both sides."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

#: Tokens are the lower-cased words hashed to this many values, so that every table over them has a fixed size.
TOKENS = 1 << 14
#: Stands for what lies beyond a text, and between two texts of a stream.
BEYOND = TOKENS
#: Neighbours on each side, numbers in an embedding and in the hidden layer, word distributions that the network mixes.
REACH, HIDDEN, SORTS = 3, 16, 16
#: Buckets into which the neighbours of a token are counted for the first embeddings.
SKETCH = 32
ROUNDS, BATCH, RATE = 2, 2048, 0.15
#: Vectors that one task adds up.
FAN_IN = 4
MOST_WORDS_REMEMBERED = 1_000_000
#: Tokens that are counted, or scored, together.
CHUNK = 1 << 16


#: BEYOND is the largest.
STORED = np.dtype("<u2")


class Tokens:
    """The token of each word of a text, by a hash."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def word(self, word: bytes) -> int:
        import xxhash

        if len(self.known) > MOST_WORDS_REMEMBERED:
            self.known.clear()
        self.known[word] = token = xxhash.xxh64_intdigest(word) % TOKENS
        return token

    def of(self, text: str) -> np.ndarray:
        known = self.known
        return np.array([t if (t := known.get(w)) is not None else self.word(w) for w in text.lower().encode("utf-8", "surrogatepass").split()], STORED)


GAP = np.full(REACH, BEYOND, STORED)
#: Sums of rows by a product; logits beyond MOST count as MOST.
ONES, MOST = np.ones((SORTS, 1), np.float32), 60


def streams(texts: Iterable[np.ndarray], length: int) -> Iterator[np.ndarray]:
    """All tokenised texts in order as one stream with REACH times BEYOND before, between and after them, cut into pieces of
    `length` positions; each piece has REACH more positions on either side."""
    held, size = [GAP], REACH
    for tokens in texts:
        held += [tokens, GAP]
        size += len(tokens) + REACH
        if size >= length + 2 * REACH:
            stream, at = np.concatenate(held), 0
            while len(stream) - at >= length + 2 * REACH:
                yield stream[at : at + length + 2 * REACH]
                at += length
            held, size = [stream[at:]], len(stream) - at
    if size > 2 * REACH:
        yield np.concatenate(held)


@dataclass
class Model:
    """embed[token], one weight per neighbour's place and number, two layers, and words[token], the probability of the token
    in each of SORTS distributions. Given its neighbours a token has the mixture of these with the network's shares."""

    embed: np.ndarray
    place: np.ndarray
    mix: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    prior: np.ndarray
    words: np.ndarray


LEARNT = {"embed": (TOKENS + 1, HIDDEN), "place": (2 * REACH, HIDDEN), "mix": (HIDDEN, HIDDEN), "bias": (HIDDEN,), "out": (HIDDEN, SORTS), "prior": (SORTS,)}


def start(counts: np.ndarray, seen: np.ndarray, seed: int = 3) -> Model:
    """The first model, from the tokens' counts and the counts of their neighbours' buckets: embeddings are the main
    directions in which the neighbours of tokens differ, and each distribution holds the tokens of one cluster of them."""
    rng = np.random.default_rng(seed)
    around = seen.sum(1, keepdims=True)
    usual = seen.sum(0) / max(1.0, seen.sum())
    # neighbours of rare tokens count as partly the usual ones
    differ = np.sqrt((seen + 20 * usual) / (around + 20)) - np.sqrt(usual)
    _, directions = np.linalg.eigh((differ * counts[:, None]).T @ differ)
    embed = np.zeros((TOKENS + 1, HIDDEN))
    embed[:-1] = differ @ directions[:, ::-1][:, :HIDDEN]
    embed /= np.sqrt((counts[:, None] * embed[:-1] ** 2).sum(0) / max(1.0, counts.sum())) + 1e-9
    embed = np.clip(embed, -5, 5)
    weight = counts / max(1.0, counts.sum())
    centres = embed[rng.choice(TOKENS, SORTS, replace=False, p=(weight + 1e-9) / (weight + 1e-9).sum())]
    for _ in range(12):
        near = ((embed[:-1, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        mass = np.bincount(near, counts, SORTS)
        moved = np.stack([np.bincount(near, counts * embed[:-1, i], SORTS) for i in range(HIDDEN)], 1) / np.maximum(mass, 1e-9)[:, None]
        centres = np.where(mass[:, None] > 0, moved, centres)
    member = np.full((TOKENS, SORTS), 0.2 / SORTS)
    member[np.arange(TOKENS), near] += 0.8
    f = lambda x: x.astype(np.float32)
    return Model(
        f(embed), np.full((2 * REACH, HIDDEN), 1 / REACH, np.float32), f(np.eye(HIDDEN) * 0.5 + rng.normal(0, 0.02, (HIDDEN, HIDDEN))), np.zeros(HIDDEN, np.float32),
        f(rng.normal(0, 0.1, (HIDDEN, SORTS))), np.zeros(SORTS, np.float32), distributions(counts[:, None] * member, counts),
    )


def distributions(expected: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each column of expected counts as a distribution over all tokens, mixed with a hundredth of the corpus's."""
    corpus = (counts + 0.5) / (counts + 0.5).sum()
    total = expected.sum(0)
    own = np.where(total > 0, expected / np.maximum(total, 1e-9), corpus[:, None])
    return (0.99 * own + 0.01 * corpus[:, None]).astype(np.float32)


def layers(m: Model, stream: np.ndarray) -> tuple[np.ndarray, ...]:
    """(embedded stream, hidden layer and shares of the positions that have neighbours on both sides)."""
    e = m.embed[stream]
    n = len(stream) - 2 * REACH
    a = np.zeros((n, HIDDEN), np.float32)
    for k, o in enumerate(o for o in range(2 * REACH + 1) if o != REACH):
        a += e[o : o + n] * m.place[k]
    h = a @ m.mix
    h += m.bias
    np.tanh(h, out=h)
    z = h @ m.out
    z += m.prior
    np.clip(z, -MOST, MOST, out=z)
    np.exp(z, out=z)
    z /= z @ ONES
    return e, a, h, z


def log_probabilities(m: Model, stream: np.ndarray) -> np.ndarray:
    """log p(token | neighbours) of the stream without its ends; 0 at BEYOND."""
    target = stream[REACH : len(stream) - REACH]
    real = target < BEYOND
    shares = layers(m, stream)[3][real]
    out = np.zeros(len(target))
    out[real] = np.log(np.einsum("ij,ij->i", shares, m.words[target[real]]))
    return out


class Trainer:
    """Adagrad on pieces of a stream, every token of which is a target; `expected` adds up how much of each token is put
    down to each distribution."""

    def __init__(self, model: Model) -> None:
        self.m = Model(**{k: v.copy() for k, v in vars(model).items()})
        self.squares = {k: np.full(s, 1e-4, np.float32) for k, s in LEARNT.items()}
        self.expected = np.zeros((TOKENS, SORTS), np.float32)
        self.seen = 0

    def step(self, stream: np.ndarray) -> None:
        m, n = self.m, len(stream) - 2 * REACH
        target = stream[REACH : REACH + n]
        real = target < BEYOND
        count = int(np.count_nonzero(real))
        if not count:
            return
        e, a, h, shares = layers(m, stream)
        whole = count == n
        owed = shares * m.words[target if whole else np.where(real, target, 0)]
        owed /= owed @ ONES
        d = shares - owed
        if not whole:
            owed *= real[:, None]
            d *= real[:, None]
        d /= np.float32(count)
        dh = d @ m.out.T
        dh *= 1 - h * h
        da = dh @ m.mix.T
        de = np.zeros_like(e)
        place = np.empty((2 * REACH, HIDDEN), np.float32)
        for k, o in enumerate(o for o in range(2 * REACH + 1) if o != REACH):
            de[o : o + n] += da * m.place[k]
            place[k] = np.einsum("ij,ij->j", da, e[o : o + n])
        for k, g in {"place": place, "mix": a.T @ dh, "bias": dh.sum(0), "out": h.T @ d, "prior": d.sum(0)}.items():
            self.move(k, slice(None), g)
        # rows of one token are added up at once
        order = np.argsort(stream, kind="stable")
        of = stream[order]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        of = of[first]
        both = np.zeros((len(stream), HIDDEN + SORTS), np.float32)
        both[:, :HIDDEN] = de
        both[REACH : REACH + n, HIDDEN:] = owed
        both = np.cumsum(both[order], axis=0, dtype=np.float32)[np.append(first[1:], len(order)) - 1]
        both[1:] -= both[:-1].copy()
        self.move("embed", of, both[:, :HIDDEN])
        if of[-1] == BEYOND:
            of, both = of[:-1], both[:-1]
        self.expected[of] += both[:, HIDDEN:]
        self.seen += count

    def move(self, name: str, at, gradient: np.ndarray) -> None:
        squares, values = self.squares[name], getattr(self.m, name)
        square = squares[at] + gradient * gradient
        squares[at] = square
        values[at] -= RATE * gradient / np.sqrt(square)

    def packed(self) -> np.ndarray:
        """What is learnt, times the tokens seen, and then the expected counts: a vector that may be added up."""
        return np.concatenate([getattr(self.m, k).ravel() * np.float32(self.seen) for k in LEARNT] + [self.expected.ravel()])


def unpacked(flat: np.ndarray, seen: int, counts: np.ndarray) -> Model:
    out, at = {}, 0
    for k, s in LEARNT.items():
        n = int(np.prod(s))
        out[k], at = (flat[at : at + n].reshape(s) / seen).astype(np.float32), at + n
    return Model(**out, words=distributions(flat[at:].reshape(TOKENS, SORTS).astype(float), counts))


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id as text, tokens): every row's tokens, two bytes each. A null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens()
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "tokens": [tokens.of(t).tobytes() for t in batch["text"]]})

    # ids travel as text: pandas would turn integers beside nulls into floats
    return docs.select(F.col(id_col).cast("string").alias("id"), text_of(text_col).alias("text")).mapInPandas(run, "id string, tokens binary")


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    for batch in batches:
        for tokens in batch["tokens"]:
            yield np.frombuffer(tokens, STORED)


VECTOR = "part long, seen long, flat binary"


def _vector(seen: int, flat: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"part": [TaskContext.get().partitionId()], "seen": [seen], "flat": [flat.astype(np.float32).tobytes()]})


def summed(vectors: DataFrame) -> tuple[np.ndarray | None, int]:
    """Sum of the VECTOR rows, FAN_IN at a time until one is left, which goes to the driver."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(group["flat"].iloc[0]) // 4)
        for flat in group["flat"]:
            total += np.frombuffer(flat, np.float32)
        return pd.DataFrame({"part": [int(group["part"].iloc[0])], "seen": [int(group["seen"].sum())], "flat": [total.astype(np.float32).tobytes()]})

    left = vectors.rdd.getNumPartitions()
    while True:
        left = -(-left // FAN_IN)
        vectors = vectors.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInPandas(add, VECTOR)
        if left <= 1:
            break
    rows = vectors.collect()
    return (np.frombuffer(rows[0].flat, np.float32), rows[0].seen) if rows else (None, 0)


def counted(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each token stands in all texts, and how often a neighbour of it falls in each of SKETCH buckets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, seen, n = np.zeros(TOKENS), np.zeros((TOKENS + 1) * (SKETCH + 1)), 0
        for stream in streams(_texts(batches), CHUNK):
            stream = stream.astype(np.int64)
            target = stream[REACH : len(stream) - REACH]
            counts += np.bincount(target, minlength=TOKENS + 1)[:TOKENS]
            n += int(np.count_nonzero(target < BEYOND))
            bucket = np.where(stream < BEYOND, stream % SKETCH, SKETCH)
            for o in (REACH - 1, REACH + 1):
                seen += np.bincount(target * (SKETCH + 1) + bucket[o : o + len(target)], minlength=len(seen))
        if n:
            yield _vector(n, np.concatenate([counts, seen.reshape(TOKENS + 1, SKETCH + 1)[:-1, :-1].ravel()]))

    flat, n = summed(texts.select("tokens").mapInPandas(run, VECTOR))
    if not n:
        return np.zeros(TOKENS), np.zeros((TOKENS, SKETCH))
    return flat[:TOKENS].astype(float), flat[TOKENS:].reshape(TOKENS, SKETCH).astype(float)


def fit(texts: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model of all `tokenised` texts, which are read once for each round and once before. In each round every task
    goes on from the same model over every token of its own texts; then what they have learnt is averaged by the tokens
    they have seen, and their expected counts are added up to the next word distributions. Results do not depend on how
    a task's rows come in batches."""
    spark = texts.sparkSession
    counts, seen = counted(texts)
    model = start(counts, seen)
    for _ in range(rounds):
        shipped = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            trainer = Trainer(shipped.value)
            for stream in streams(_texts(batches), BATCH):
                trainer.step(stream)
            if trainer.seen:
                yield _vector(trainer.seen, trainer.packed())

        flat, n = summed(texts.select("tokens").mapInPandas(run, VECTOR))
        if not n:
            break
        model = unpacked(flat, n, counts)
    return model


def train(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> Model:
    """`fit` of docs, whose tokens are written to the shared folder first."""
    return fit(written(tokenised(docs, docs.columns[0], text_col).select("tokens"), "tokens"), rounds)


def scored(model: Model, texts: list[np.ndarray]) -> list[float]:
    """The sum of the log-probabilities of each tokenised text."""
    stream = np.concatenate([GAP, *(x for t in texts for x in (t, GAP))])
    edges = np.cumsum([0, *(len(t) + REACH for t in texts)])
    step = BATCH
    each = np.concatenate([log_probabilities(model, stream[at : at + step + 2 * REACH]) for at in range(0, max(1, len(stream) - 2 * REACH), step)])
    total = np.concatenate([[0.0], np.cumsum(each), [0.0] * REACH])
    total[len(each) + 1 :] = total[len(each)]
    return (total[edges[1:]] - total[edges[:-1]]).tolist()


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, log_likelihood (sum of the conditional log-probabilities), per_token.

    A null text counts as empty; an empty one has log_likelihood 0 and a null per_token. Rows with a null id are scored as
    any other; repeated rows score alike, an empty table gives an empty result, other columns are ignored. No shuffle.
    """
    return _score(tokenised(docs, id_col, text_col), model, id_col, docs.schema[id_col].dataType.simpleString())


def _score(texts: DataFrame, model: Model, id_col: str, id_type: str) -> DataFrame:
    shipped = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shipped.value
        for batch in batches:
            sums, waiting, size, n = [], [], 0, []
            for tokens in _texts([batch]):
                waiting.append(tokens)
                n.append(len(tokens))
                size += n[-1]
                if size >= CHUNK // 16:
                    sums += scored(model, waiting)
                    waiting, size = [], 0
            if waiting:
                sums += scored(model, waiting)
            per = [s / k if k else None for s, k in zip(sums, n, strict=True)]
            yield pd.DataFrame({"id": batch["id"], "n_tokens": n, "log_likelihood": sums, "per_token": per})

    out = texts.mapInPandas(run, "id string, n_tokens long, log_likelihood double, per_token double")
    return out.select(F.col("id").cast(id_type).alias(id_col), "n_tokens", "log_likelihood", "per_token")


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`score` of docs by the model that `fit` has from the same docs; the texts are tokenised once."""
    texts = written(tokenised(docs, id_col, text_col), "tokens")
    return _score(texts, fit(texts), id_col, docs.schema[id_col].dataType.simpleString())
