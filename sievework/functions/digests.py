"""MD5 of many short texts at once, in numpy."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa

_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: Bytes of a text that fits one block.
SHORT = 55


class Tails:
    """Texts that follow prefixes; for each length of prefix their blocks are laid out once."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.binary()).combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts.cast(pa.binary())
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        self.texts, self.lengths, self.laid = texts, np.diff(at), {}
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        inside = np.arange(SHORT)[None, :] < self.lengths[:, None]
        self.bytes = np.zeros((len(texts), SHORT + 1), np.uint8)
        self.bytes[:, :SHORT][inside] = raw[(at[:-1, None] + np.arange(SHORT)[None, :])[inside]]
        self.bytes[np.arange(len(texts)), np.minimum(self.lengths, SHORT)] = 0x80

    def _blocks(self, n: int) -> tuple[list[np.ndarray | None], np.ndarray]:
        """The 16 words of each text's block behind n bytes, None where all are 0, and the texts that are too long for one."""
        if n not in self.laid:
            block = np.zeros((len(self.lengths), 64), np.uint8)
            block[:, n:56] = self.bytes[:, : 56 - n]
            words = np.ascontiguousarray(block.view("<u4").T)
            words[14] = (self.lengths + n).astype(np.uint32) * np.uint32(8)
            self.laid[n] = [w if w.any() else None for w in words], np.flatnonzero(self.lengths + n > SHORT)
        return self.laid[n]

    def uniforms(self, prefix: bytes) -> np.ndarray:
        """The first 32 bits of the digest of prefix and text, as a number in [0, 1): S.keyed_uniform."""
        if len(prefix) > SHORT:
            words, long = [None] * 16, np.arange(len(self.lengths))
        else:
            words, long = self._blocks(len(prefix))
            words = words.copy()
            for i in range(0, len(prefix), 4):
                put = np.uint32(int.from_bytes(prefix[i : i + 4], "little"))
                words[i // 4] = put if words[i // 4] is None else words[i // 4] | put
        out = _first_words(words, len(self.lengths)).byteswap()
        for i in long:
            out[i] = int.from_bytes(hashlib.md5(prefix + self.texts[int(i)].as_py()).digest()[:4], "big")
        return out / float(1 << 32)


def _first_words(words: list, n: int) -> np.ndarray:
    """The first word of the digest of each single block."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f = np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            g = (3 * i + 5) % 16
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
            g = 7 * i % 16
        a += f
        a += _SINES[i]
        if words[g] is not None:
            a += words[g]
        turn = _TURNS[i // 16][i % 4]
        np.right_shift(a, np.uint32(32 - turn), out=f)
        a <<= np.uint32(turn)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return a + _START[0]
