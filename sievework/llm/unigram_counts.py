"""Token counts under a unigram model, by dynamic programming over a trie of the corpus's distinct pre-tokens."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from .wordblocks import by_position, valued, word_blocks

#: What SentencePiece puts for the space before a word.
MARK = "▁"
#: Code points, MARK among them, that decide the bucket of a word; where many words begin alike, more of them do.
PREFIX = 5
#: Code points of a word that are kept in the trie; beyond them the states of one word are computed for it alone.
DEPTH = 64


def piece_scores(path: str) -> dict[str, float]:
    """Log-probability of each normal piece of a SentencePiece model file: the pieces in the order of their stored
    scores, with probabilities that fall as 1 / rank. Read on the driver; its size is that of the vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    ranked = sorted(normal, key=lambda i: (-model.get_score(i), i))
    total = math.log(sum(1 / r for r in range(1, len(ranked) + 1)))
    return {model.id_to_piece(i): -math.log(rank) - total for rank, i in enumerate(ranked, 1)}


class Trie:
    """Words that share a prefix share its forward states: a node holds (best score, its number of tokens, children) for
    the code points up to it, computed when the first word passes. Of equal scores the fewer tokens count. A code point
    that no piece covers is taken as its UTF-8 bytes, one token each, at `floor` a byte."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.floor = min(scores.values(), default=0.0) - 1.0
        self.root = (0.0, 0, {})

    def count(self, word: str) -> int:
        """Tokens on the best path of `word`, from the terminal node."""
        node, path = self.root, [self.root]
        for end, c in enumerate(word[:DEPTH], 1):
            after = node[2].get(c)
            if after is None:
                after = node[2][c] = (*self.best(word, end, path, 0), {})
            path.append(after)
            node = after
        if len(word) > DEPTH:
            # only as many states back as the longest piece has code points
            near = deque(path[-self.longest :], self.longest)
            for end in range(DEPTH + 1, len(word) + 1):
                near.append((*self.best(word, end, near, end - len(near)), None))
            node = near[-1]
        return node[1]

    def best(self, word: str, end: int, path: Sequence[tuple], first: int) -> tuple[float, int]:
        """Best score and tokens up to `end`, from the states of the ends `first` and on in path."""
        n_bytes = len(word[end - 1].encode("utf-8", "surrogatepass"))
        score, tokens, _ = path[end - 1 - first]
        best = (score + self.floor * n_bytes, tokens + n_bytes)
        scores = self.scores.get
        for start in range(max(0, end - self.longest), end):
            piece = scores(word[start:end])
            if piece is not None:
                score, tokens, _ = path[start - first]
                score += piece
                if score > best[0] or score == best[0] and tokens + 1 < best[1]:
                    best = (score, tokens + 1)
        return best


def _cutter():
    def cut(text: str) -> list[str]:
        return [MARK + w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]

    return cut


def token_counts(docs: DataFrame, scores: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_tokens.

    Words are the runs between ASCII white space, each with MARK before it. Words that begin alike meet in one task,
    bucket by bucket, which inserts the distinct ones in a trie and keeps each one's count; the counts go back to the
    documents and are summed up. Of many words that begin alike, buckets take those with the same longer beginning, so no
    beginning makes one task's trie large; a word of any length adds DEPTH nodes at most. A null or empty text has no
    tokens. Repeated rows each give a row; other columns are
    ignored; an empty table gives an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(scores)
    coded, words = word_blocks(docs, id_col, text_col, _cutter, PREFIX)

    def walker():
        trie = Trie(shipped.value)
        return lambda word: np.array([trie.count(word)], "<u4")

    def add(numbers: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[int, int]:
        return len(codes), int(numbers[codes].sum(dtype=np.int64))

    return by_position(coded, valued(words, walker), add, "n_words long, n_tokens long", id_col, docs.schema[id_col].dataType.simpleString())
