"""Words of UTF-8 texts as 64-bit hashes, a text at a time, in numpy.

A word is a run of bytes that are not separators; A-Z count as a-z. A word of up to
eight bytes is packed into its hash, so two of them never have the same. A longer
one's is eight bytes of its BLAKE2 digest: for any two different words, made to collide
or not, hashes agree with a probability of about 2^-64.

Hashes of short words can be inverted, so they are for words alone. Runs of words are
told apart by digests: 128 bits of BLAKE2 for each word, combined by a step after each
word that is not linear in it. Equal digests of different runs can't be computed from them,
only searched for among 2^64 of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np

from pulsegrid.llm.common import LOWER

#: Texts are taken in blocks of about so many bytes, cut between words, so memory doesn't grow with a text.
BLOCK = 1 << 20

#: Long words whose digests a worker remembers, and the longest of them.
REMEMBERED, LONGEST_REMEMBERED = 1 << 17, 64

#: Masks of a number's lowest bytes, by count.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_TOP = np.array([n << 56 for n in range(8)] + [0], dtype=np.uint64)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of bytes that separate words, from inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: ASCII white space.
SPACES = separators((9, 13), (32, 32))
#: All ASCII but digits and letters.
SIGNS = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * _MIX1
    h = (h ^ (h >> np.uint64(29))) * _MIX2
    return h ^ (h >> np.uint64(32))


class _Digests:
    """Digests of words; those of the last ones are remembered, up to a number."""

    def __init__(self, make: Callable[[bytes | int], int | bytes]):
        self.make, self.known = make, {}

    def of(self, word: bytes | int) -> int | bytes:
        found = self.known.get(word)
        if found is None:
            found = self.make(word)
            if isinstance(word, int) or len(word) <= LONGEST_REMEMBERED:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = found
        return found


_digests = _Digests(lambda word: int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))
_long = _Digests(lambda word: hashlib.blake2b(word, digest_size=16, person=b"long").digest())
_short = _Digests(lambda packed: hashlib.blake2b(packed.to_bytes(8, "little"), digest_size=16, person=b"short").digest())


def _found(text: bytes, table: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The text in lower case; where its words start and end; the short ones packed; which are long."""
    text = text.translate(LOWER)
    padded = text + bytes(8)
    inside = np.zeros(len(text) + 2, dtype=bool)
    np.logical_not(table[np.frombuffer(text, dtype=np.uint8)], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    size = ends - starts
    eight = np.ndarray(len(text) + 1, dtype="<u8", buffer=padded, strides=(1,))[starts]  # the eight bytes from each start on
    # The highest byte of a shorter word is its length, which no eighth letter is: a word with a control character there is a long one.
    kept = np.minimum(size, 8)
    packed = eight & _LOW[kept] | _TOP[kept]
    return text, starts, ends, packed, np.flatnonzero((size > 8) | (size == 8) & (packed >> np.uint64(56) < 32))


def _block_hashes(text: bytes, table: np.ndarray) -> np.ndarray:
    text, starts, ends, packed, long = _found(text, table)
    out = mixed(packed)
    of = _digests.of
    out[long] = np.array([of(text[i:j]) for i, j in zip(starts[long].tolist(), ends[long].tolist(), strict=True)], dtype=np.uint64)
    return out


def _block_digests(text: bytes, table: np.ndarray) -> np.ndarray:
    text, starts, ends, packed, long = _found(text, table)
    kinds, which = np.unique(packed, return_inverse=True)
    of = _short.of
    out = np.frombuffer(b"".join([of(k) for k in kinds.tolist()]), dtype="<u8").reshape(-1, 2)[which]
    if len(long):
        of = _long.of
        out[long] = np.frombuffer(b"".join([of(text[i:j]) for i, j in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]), dtype="<u8").reshape(-1, 2)
    return out


def word_hashes(text: bytes, table: np.ndarray) -> np.ndarray:
    """The hash of each word of a text, in order."""
    return _by_blocks(text, table, _block_hashes)


def word_digests(text: bytes, table: np.ndarray) -> np.ndarray:
    """The digest of each word of a text, in order, as rows of two numbers."""
    return _by_blocks(text, table, _block_digests)


def _by_blocks(text: bytes, table: np.ndarray, of: Callable[[bytes, np.ndarray], np.ndarray]) -> np.ndarray:
    if len(text) <= BLOCK:
        return of(text, table)
    b = np.frombuffer(text, dtype=np.uint8)
    out, start = [], 0
    while start < len(b):
        end = min(start + BLOCK, len(b))
        while end < len(b):  # not inside a word
            stop = np.flatnonzero(table[b[end : end + BLOCK]])
            end = end + int(stop[0]) if len(stop) else min(end + BLOCK, len(b))
            if len(stop):
                break
        out.append(of(text[start:end], table))
        start = end
    return np.concatenate(out)


def shingle_set(words: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of `size` words, from the words' digests, as two halves of a digest each, in order; of fewer words, the whole sequence as one."""
    if not len(words):
        return words[:, 0], words[:, 1]
    size = min(size, len(words))
    n = len(words) - size + 1
    a, b = np.full(n, size, dtype=np.uint64), np.full(n, size, dtype=np.uint64)
    for i in range(size):
        a = mixed(a * _MIX1 + words[i : n + i, 0] + b)
        b = mixed(b * _MIX2 + words[i : n + i, 1] + a)
    order = np.lexsort((b, a)) if n < 1000 else np.argsort(a)
    a, b = a[order], b[order]
    same = a[1:] == a[:-1]
    if n >= 1000 and (same & (b[1:] != b[:-1])).any():  # two runs that agree in one half
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        same = a[1:] == a[:-1]
    first = np.concatenate([[True], ~(same & (b[1:] == b[:-1]))])
    return a[first], b[first]
