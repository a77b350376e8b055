"""Word shingles as sorted sets of 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORDS = 5
_CACHE_LIMIT = 150_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()
#: One odd multiplier a place, so that the order of a shingle's words counts.
_PLACES = np.array([xxhash.xxh3_64_intdigest(f"place {i}") | 1 for i in range(64)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of MurmurHash3."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(text: str | None) -> list[bytes]:
    """ASCII lower case, split at space and U+0009 to U+000D: what ``bytes`` calls white space."""
    return (text or "").encode().lower().split()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``words_of`` every text, one after the other as binary values, and each text's number of them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, row = lists.flatten(), pc.list_parent_indices(lists)
    whole = pc.not_equal(pc.binary_length(words), 0)  # blank ends give empty ones
    return words.filter(whole).cast(pa.binary()), np.bincount(row.filter(whole).to_numpy(), minlength=len(texts))


def shingle_set(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct shingles; with fewer words than ``width``, the whole sequence as one; without words, none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    own = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    total = own[:n] * _PLACES[0]
    for i in range(1, width):
        total += own[i : i + n] * _PLACES[i]
    return np.unique(mix(total))


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
