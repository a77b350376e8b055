"""BPE encoding with a segment tree, and decoding.

A word's symbols are merged through a segment tree over the ranks of adjacent pairs: a
leaf holds its pair's rank and place, an inner node the least of its children, so the
root is the leftmost pair of lowest rank. A merge changes three leaves, each in
logarithmic time, and the word is done when no leaf holds a mergeable pair.

The tokenizer's file is a parameter; its normalizer (NFC, white space, lower case), its
splitting pattern, its byte alphabet, its word ends and its added tokens are followed.

Cases: null and empty texts have no tokens; a word of any length is merged in
O(n log n); the cache of words is bounded and only saves time; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

NONE = 1 << 62
CACHE_WORDS, GROUP_CHARS, WIDE = 80_000, 2_000_000, 64
ADDED = " "  # begins no piece but an added token

_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[^\\S\x1c-\x1f]+")


class PairTree:
    """Segment tree over pair ranks: ``tree[1]`` is the least ``rank << 32 | place``, the leftmost lowest rank, or NONE."""

    def __init__(self, ranks: list[int]) -> None:
        self.size = 1 << max(0, len(ranks) - 1).bit_length()
        self.tree = tree = [NONE] * (2 * self.size)
        for i, rank in enumerate(ranks):
            if rank >= 0:
                tree[self.size + i] = rank << 32 | i
        for i in range(self.size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b



def merge(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """``pairs`` maps adjacent ids to (rank, merged id). A leaf's change climbs only as far as it changes a node."""
    n = len(symbols)
    get = pairs.get
    found = [get(x) for x in zip(symbols, symbols[1:], strict=False)]
    if not any(found):
        return symbols
    ids = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    held = PairTree([x[0] if x else -1 for x in found])
    tree, size = held.tree, held.size
    while (top := tree[1]) != NONE:
        at = top & 0xFFFFFFFF
        right = after[at]
        ids[at] = pairs[ids[at], ids[right]][1]
        ids[right] = -1
        after[at] = beyond = after[right]
        pair = None
        if beyond < n:
            before[beyond] = at
            pair = get((ids[at], ids[beyond]))
        changed = [(at, pair)]
        if right < n - 1:
            changed.append((right, None))
        left = before[at]
        if left >= 0:
            changed.append((left, get((ids[left], ids[at]))))
        for place, pair in changed:
            i = size + place
            value = pair[0] << 32 | place if pair else NONE
            if tree[i] == value:
                continue
            tree[i] = value
            while i > 1:
                beside = tree[i ^ 1]
                if beside < value:
                    value = beside
                i >>= 1
                if tree[i] == value:
                    break
                tree[i] = value
    return [x for x in ids if x >= 0]


class PairRanks:
    """Ranks of pairs for arrays of ids: -1 where a pair cannot be merged."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]) -> None:
        self.span = 1 + max((max(*p, m[1]) for p, m in pairs.items()), default=0)
        keys = np.array([a * self.span + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        ranks = np.array([m[0] for m in pairs.values()], np.int64)
        self.keys, self.ranks = np.append(keys[order], NONE), np.append(ranks[order], -1)
        self.merged = np.zeros(len(pairs) + 1, np.int64)
        self.merged[ranks] = [m[1] for m in pairs.values()]

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = np.where((left < 0) | (right < 0), -1, left * self.span + right)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def merge_all(words: list[list[int]], ranks: PairRanks) -> list[list[int]]:
    """``merge`` for many words of similar length: one segment tree a row, a step of all rows at once."""
    rows, width = len(words), max(map(len, words))
    size = 1 << max(1, (width - 1).bit_length())
    ids = np.full((rows, size + 1), -1, np.int64)
    for i, w in enumerate(words):
        ids[i, : len(w)] = w
    length = np.array([len(w) for w in words])
    after = np.tile(np.arange(1, size + 2), (rows, 1))
    before = np.tile(np.arange(-1, size), (rows, 1))
    tree = np.full((rows, 2 * size), NONE, np.int64)

    def leaf(rank: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.where(rank < 0, NONE, rank * size + place)

    tree[:, size:] = leaf(ranks.of(ids[:, :-1], ids[:, 1:]), np.arange(size))
    for i in range(size - 1, 0, -1):
        np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
    # From here on flat arrays: row r's symbol i is at r * (size + 1) + i, its node i at r * 2 * size + i.
    ids, after, before, tree = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
    row = np.arange(rows)
    top = tree[row * (2 * size) + 1]
    while True:
        keep = top != NONE
        if not keep.all():
            row, top = row[keep], top[keep]
        if not row.size:
            break
        base, root, end = row * (size + 1), row * (2 * size), length[row]
        rank, at = np.divmod(top, size)
        here = base + at
        right = after[here]
        beyond, left = after[base + right], before[here]
        own = ranks.merged[rank]
        ids[here] = own
        ids[base + right] = -1
        after[here] = beyond
        inside = beyond < end
        beyond = np.minimum(beyond, size)  # beyond a full row nothing is read
        before[base + beyond] = np.where(inside, at, before[base + beyond])
        value = leaf(ranks.of(own, np.where(inside, ids[base + beyond], -1)), at)
        edge = left < 0
        beside = leaf(ranks.of(np.where(edge, -1, ids[base + left]), own), left)
        left, beside = np.where(edge, at, left), np.where(edge, value, beside)
        right = np.where(right >= size, at, right)  # the last symbol of a full row has no pair of its own
        tree[root + size + right] = NONE
        tree[root + size + at] = value
        tree[root + size + left] = beside
        for node in (size + right, size + at, size + left):
            node = node >> 1
            while node[0]:
                child = root + 2 * node
                tree[root + node] = np.minimum(tree[child], tree[child + 1])
                node = node >> 1
        top = tree[root + 1]
    return [[x for x in own if x >= 0] for own in ids.reshape(rows, size + 1).tolist()]


def byte_alphabet() -> list[str]:
    """The printable character of each byte: itself where visible in Latin-1, else from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = [""] * 256, 256
    for b in range(256):
        if b in visible:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


class Recent:
    """A bounded cache in two generations: what is used stays, the rest goes when a generation is full."""

    def __init__(self, limit: int) -> None:
        self.limit, self.new, self.old = limit, {}, {}

    def lookup(self, keys: set[str], make: Callable[[list[str]], list]) -> dict:
        """Values of all keys, made together where they are not held."""
        new, old = self.new, self.old
        missing = [k for k in keys if k not in new]
        if missing:
            if len(new) >= self.limit:
                self.old, self.new = new, {}
                new, old, missing = self.new, self.old, list(keys)
            made = []
            for k in missing:
                value = old.get(k)
                if value is None:
                    made.append(k)
                else:
                    new[k] = value
            new.update(zip(made, make(made), strict=True))
        return new


class WordBpe:
    """A byte-level BPE tokenizer with word ends, read from a ``tokenizers`` JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: s for s, i in (self.vocab | self.added).items()}
        self.numbers = {i: str(i) for i in self.names}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.rule = next(x["pattern"]["Regex"] for x in steps if x["type"] == "Split")
        self.pattern = regex.compile(self.rule, regex.V1)
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)))
        self.alphabet = byte_alphabet()
        self.symbols = [self.vocab.get(c, -1) for c in self.alphabet]
        self.last = [self.vocab.get(c + self.end, -1) for c in self.alphabet]
        self.ranks = PairRanks(self.pairs)
        self.words, self.pieces = Recent(CACHE_WORDS), Recent(CACHE_WORDS)

    @cached_property
    def unicode(self) -> tuple[Callable[[str], str], Callable[[str], list]]:
        """Normalizing and splitting beyond Latin letters, by the library's own Unicode tables."""
        lower = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        split = pre_tokenizers.Split(Regex(self.rule), "removed", invert=True)
        return lower.normalize_str, split.pre_tokenize_str

    def _symbols(self, word: str) -> list[int]:
        raw = word.encode()
        ids = [self.symbols[b] for b in raw[:-1]]
        ids.append(self.last[raw[-1]])
        return [i for i in ids if i >= 0]

    def _words(self, words: list[str]) -> list[list[int]]:
        """Ids of normalized words, merged together by width."""
        out: list = [None] * len(words)
        by_width: dict[int, list[int]] = {}
        symbols = [self._symbols(w) for w in words]
        for i, own in enumerate(symbols):
            if 1 < len(own) <= WIDE:
                by_width.setdefault((len(own) - 1).bit_length(), []).append(i)
            else:
                out[i] = merge(own, self.pairs) if len(own) > WIDE else own
        for group in by_width.values():
            for k in range(0, len(group), 4096):
                part = group[k : k + 4096]
                for i, ids in zip(part, merge_all([symbols[i] for i in part], self.ranks), strict=True):
                    out[i] = ids
        return out

    def _split(self, piece: str) -> list[str]:
        if max(piece) >= "\u0250":
            lower, split = self.unicode
            return [w for w, _ in split(lower(piece))]
        # Below, every character is composed, and every version of Unicode has it alike.
        low = piece.lower()
        if low.isalpha():
            return [low]
        if low[-1] in ".,;:!?" and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        return self.pattern.findall(low)

    def _pieces(self, pieces: list[str]) -> list[tuple[int, str, str]]:
        """``(count, ids, tokens)`` of pieces without white space."""
        split = [self._split(p) for p in pieces]
        known = self.words.lookup({w for own in split for w in own}, self._words)
        name, number, out = self.names.__getitem__, self.numbers.__getitem__, []
        for own in split:
            ids = known[own[0]] if len(own) == 1 else [i for w in own for i in known[w]]
            out.append((len(ids), " ".join(map(number, ids)), " ".join(map(name, ids))))
        return out

    def parts(self, texts: list[str]) -> list[list[tuple[int, str, str]]]:
        """For each text ``(count, ids, tokens)`` of each piece between white space, to be joined by spaces.

        No match of the pattern and no canonical composition crosses white space, so
        pieces are independent of one another. Texts go in groups of bounded size.
        """
        out, group, size = [], [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size > GROUP_CHARS:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _group(self, texts: list[str]) -> list[list[tuple[int, str, str]]]:
        split: list[list[str]] = []
        for text in texts:
            if "<|" not in text:
                split.append(self._plain(text))
                continue
            at, own = 0, []
            for m in self.special.finditer(text):
                own += [*self._plain(text[at : m.start()]), ADDED + m[0]]
                at = m.end()
            split.append(own + self._plain(text[at:]))
        distinct = {p for own in split for p in own}
        added = {p: (1, str(self.added[p[1:]]), p[1:]) for p in distinct if p[0] == ADDED}
        known = self.pieces.lookup(distinct - added.keys(), self._pieces)
        if added:
            known = known | added
        found = [list(map(known.__getitem__, own)) for own in split]
        if any(known[p][0] == 0 for p in distinct):
            found = [[x for x in own if x[0]] for own in found]
        return found

    def _plain(self, text: str) -> list[str]:
        # str.split() also splits at U+001C to U+001F, which the file's white space leaves out.
        return text.split() if not _SEPARATORS.search(text) else [x for x in _SPACE.split(text) if x]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for _, ids, _ in own for i in ids.split(" ")] for own in self.parts(texts)]

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder: tokens joined by spaces, special ones included."""
        return " ".join(self.names[i] for i in ids)


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    # The caches hold hundreds of thousands of small tuples, none in a cycle: look for garbage among them seldom.
    gc.set_threshold(200_000, 50, 100)
    return WordBpe(path)


def encode(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """``(key, ids array<int>)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(path)
        for batch in batches:
            ids = pa.array(own.encode_all([x or "" for x in batch.column(1).to_pylist()]), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["key", "ids"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, "key bigint, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """``(key, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["key", "text"])

    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, "key bigint, text string").withColumnRenamed("key", key)


DIGEST = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_digest(df: DataFrame, key: str, text: str, path: str, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes every text in one pass: digests of ids and decoded text, and the ids if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(path)
        types = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))
        names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch, rows = whole.slice(at, 1000), []
                for parts in own.parts([x or "" for x in batch.column(1).to_pylist()]):
                    ids, decoded = (" ".join([p[k] for p in parts]) for k in (1, 2))
                    row = (sum([p[0] for p in parts]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                    rows.append((*row, np.fromstring(ids, np.int32, sep=" ")) if with_ids else row)
                width = 3 + with_ids
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], types[i]) for i in range(width))], names=["key", *names[:width]])

    schema = f"key bigint, {DIGEST}" + ", ids array<int>" * with_ids
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)
