"""Toxicity: a lexicon learned from labels, misspelled terms, and their context.

Terms are words and word beginnings that toxic training texts have far more often than
others, by a large-deviation bound corrected for the number of candidates. A trie holds
them; a Levenshtein automaton for each unknown token walks the trie and keeps only the
branches that can still end within the allowed distance. What a distant match is worth
is learned as well: words near a term that clean texts use are no misspellings.

Each hit is looked at in its context: between quotation marks, which are paired over the
whole text, it counts as quoted, otherwise as abuse, and more if the window of
``WINDOW_WORDS`` words around it addresses someone. A logistic regression on
these sums gives the score.

The lexicon and the regression are fitted on at most ``SAMPLE`` labelled texts, chosen by
a hash of their ids; every text is scored whole.

Cases: null and empty texts have no hits and get the score of a text without any; labels
that are null are left out and rows of one id that disagree count as toxic; of texts that share a
labelled id the least is learned from; without
labels of both kinds there is no lexicon and every score is the smoothed rate; repeated
rows are scored alike; an empty table gives an empty result; other columns are kept,
but for those named like the results, which are replaced.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .shingles import shingle_set

SAMPLE = 20_000
#: How many times as often a term must be in toxic texts.
MIN_RATIO = 20
PREFIXES = range(3, 8)
WINDOW_WORDS = 6
#: Pairs of quotation marks, and words that address someone.
QUOTES = (("“", "”"), ("«", "»"), ("„", "“"), ("‘", "’"))
ADDRESS = frozenset("you your yours u ur du dich dir ihr euch tu te toi vous usted ustedes ti".split())

_WORD = re.compile(r"\w+")
_FLUSH, _CACHE = 120_000, 100_000


def allowed(term: str) -> int:
    """Edits that may separate a term from its misspelling; beginnings of words are matched as they are."""
    n = len(term)
    return 0 if n < 5 or term.endswith("*") else 1 if n < 9 else 2


class Lexicon:
    """A trie of terms; ``nearest(token)`` is the closest term within its distance, if any."""

    def __init__(self, terms: list[str]) -> None:
        self.exact = {t for t in terms if not t.endswith("*")}
        self.beginnings = {t[:-1] for t in terms if t.endswith("*")}
        self.lengths = sorted({len(b) for b in self.beginnings})
        self.root: dict = {}
        pieces: set[str] = set()
        sizes: set[int] = set()
        for term in terms:
            d = allowed(term)
            if not d:
                continue
            bare = term
            node = self.root
            for c in bare:
                node = node.setdefault(c, {})
            node[""] = (term, d)
            sizes |= set(range(len(bare) - d, len(bare) + d + 1))
            # Of d + 1 pieces of a term, d edits leave one whole.
            cuts = [len(bare) * i // (d + 1) for i in range(d + 2)]
            pieces |= {bare[a:b] for a, b in zip(cuts, cuts[1:], strict=False)}
        self.sizes = sizes
        self.pieces = re.compile("|".join(map(re.escape, sorted(pieces)))) if pieces else None
        self.cache: dict[str, tuple[str, int] | None] = {}

    def nearest(self, token: str) -> tuple[str, int] | None:
        try:
            return self.cache[token]
        except KeyError:
            if len(self.cache) >= _CACHE:
                self.cache.clear()
            found = self.cache[token] = self._nearest(token)
            return found

    def _nearest(self, token: str) -> tuple[str, int] | None:
        if token in self.exact:
            return token, 0
        for n in self.lengths:
            if token[:n] in self.beginnings and len(token) >= n:
                return token[:n] + "*", 0
        if self.pieces is None or len(token) not in self.sizes or not self.pieces.search(token):
            return None
        best: tuple[int, str] | None = None
        # The automaton's state is the row of distances between the trie's path and the token's beginnings.
        stack = [(self.root, list(range(len(token) + 1)))]
        while stack:
            node, row = stack.pop()
            for c, child in node.items():
                if c == "":
                    term, d = child
                    far = row[-1]
                    if far <= d and (best is None or (far, term) < best):
                        best = (far, term)
                    continue
                new = [row[0] + 1]
                for i, t in enumerate(token):
                    new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (t != c)))
                if min(new) <= 2:
                    stack.append((child, new))
        return (best[1], best[0]) if best else None


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans between quotation marks, over the whole text; straight marks pair up, within their line where their number is odd."""
    out = []
    for begin, end in QUOTES:
        start = -1
        for m in re.finditer(f"[{begin}{end}]", text):
            if m[0] == begin and start < 0:
                start = m.end()
            elif m[0] == end and start >= 0:
                out.append((start, m.start()))
                start = -1
    parts = [text] if text.count('"') % 2 == 0 else text.split("\n")
    at = 0
    for part in parts:
        marks = [at + m.start() for m in re.finditer('"', part)]
        out += [(a + 1, b) for a, b in zip(marks[::2], marks[1::2], strict=False)]
        at += len(part) + 1
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


class Model:
    """The fitted scorer: its terms and clean words come from the labelled texts, which ``SAMPLE`` bounds."""

    def __init__(self, weights: dict[str, float], clean: frozenset[str], beta: list[float]) -> None:
        self.weights, self.clean, self.beta = weights, clean, beta
        self._lexicon: Lexicon | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_lexicon": None}

    @property
    def lexicon(self) -> Lexicon:
        if self._lexicon is None:
            self._lexicon = Lexicon(sorted(self.weights))
        return self._lexicon

    def hits(self, text: str) -> list[tuple[str, str, int, bool, bool]]:
        """``(token, term, edits, quoted, addressed)`` of every hit, in order."""
        low = text.lower()
        nearest = self.lexicon.nearest
        found = {t for t in set(_WORD.findall(low)) if nearest(t) is not None and t not in self.clean}
        if not found:
            return []
        spans = [(m[0], m.start(), m.end()) for m in _WORD.finditer(low)]
        out = []
        quoted = quotations(low)
        for i, (token, start, end) in enumerate(spans):
            if token in found:
                near = spans[max(0, i - WINDOW_WORDS) : i + WINDOW_WORDS + 1]
                addressed = any(t in ADDRESS for t, _, _ in near)
                span = bisect.bisect_right(quoted, (start, len(low)))
                inside = span > 0 and end <= quoted[span - 1][1]
                out.append((token, *nearest(token), inside, addressed))
        return out

    def features(self, text: str) -> list[float]:
        abuse = quoted = near = 0.0
        kinds = set()
        for _, term, edits, inside, addressed in self.hits(text):
            w = self.weights[term] * (1.25 if addressed else 1.0)
            if edits:
                near += w * (0.4 if inside else 1.0)
            elif inside:
                quoted += w
            else:
                abuse += w
                kinds.add(term)
        return [1.0, math.log1p(abuse), math.log1p(quoted), math.log1p(near), float(len(kinds))]

    def score(self, text: str) -> float:
        z = sum(b * x for b, x in zip(self.beta, self.features(text), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]
    for batch in batches:
        marks = []
        for text in batch.column(0):
            own = shingle_set(text.as_py())
            marks.append([int((own * np.uint64(f)).min().view(np.int64)) if len(own) else 0 for f in factors])
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([m[i] for m in marks], pa.int64()) for i in range(3))], names=["text", "y", "k", "m0", "m1", "m2"])


def _families(rows: list) -> dict[int, int]:
    """A family for each id of ``(id, minima)``: texts that share a minimum, directly or by others, are of one."""
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k, *minima in rows:
        for node in (k, *((i, m) for i, m in enumerate(minima) if m)):
            parent.setdefault(node, node)
            parent[root(node)] = root(k)
    numbers: dict = {}
    return {k: numbers.setdefault(root(k), len(numbers)) for k, *_ in rows}


def _terms_of(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    out = {w for w in words if len(w) >= 3}
    for n in PREFIXES:
        out |= {w[:n] + "*" for w in words if len(w) >= n}
    return out


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts ordered by family and label: by how many families each term is used, for either label."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    now, terms = None, set()

    def flush() -> pa.RecordBatch:
        found = list(counts[0].keys() | counts[1].keys())
        out = [pa.array(found, pa.string()), *(pa.array([counts[y][t] for t in found], pa.int64()) for y in (1, 0))]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(out, names=["term", "pos", "neg"])

    for batch in batches:
        for text, y, family in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if (family, y) != now:
                if now:
                    counts[now[1]].update(terms)
                now, terms = (family, y), set()
                if len(counts[0]) + len(counts[1]) > _FLUSH:
                    yield flush()
            terms |= _terms_of(text.as_py() or "")
    if now:
        counts[now[1]].update(terms)
    yield flush()  # at most _FLUSH terms and one family's are held


def _choose(rows: list, candidates: int, toxic: int, clean: int) -> dict[str, float]:
    """Terms by the strength of their evidence; of terms that begin alike, the one that explains the others."""
    rate = toxic / (toxic + clean)
    need = math.log(max(2, candidates))
    scored = []
    for term, pos, neg in rows:
        n, p = pos + neg, pos / (pos + neg)
        bound = n * (p * math.log(p / rate) + ((1 - p) * math.log((1 - p) / (1 - rate)) if p < 1 else 0))
        ratio = ((pos + 0.5) / (toxic + 1)) / ((neg + 0.5) / (clean + 1))
        if p > rate and bound >= need and ratio >= MIN_RATIO:
            scored.append((round(bound, 6), not term.endswith("*"), len(term), term, pos, math.log(ratio)))
    out: dict[str, float] = {}
    taken: list[tuple[str, int]] = []
    for _, _, _, term, pos, weight in sorted(scored, reverse=True):
        bare = term.rstrip("*")
        if not any((bare.startswith(b) or b.startswith(bare)) and n >= 0.8 * pos for b, n in taken):
            out[term] = weight
            taken.append((bare, pos))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> list[float]:
    """Ridge-penalized logistic regression by Newton steps; no weight of evidence may be negative."""
    beta = np.zeros(x.shape[1])
    free = np.arange(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(3):
        for _ in range(40):
            z = np.clip(x[:, free] @ beta[free], -30, 30)
            p = 1 / (1 + np.exp(-z))
            w = weight * np.maximum(p * (1 - p), 1e-6)
            grad = x[:, free].T @ (weight * (y - p)) - penalty[free] * beta[free]
            step = np.linalg.solve((x[:, free] * w[:, None]).T @ x[:, free] + np.diag(penalty[free]), grad)
            beta[free] += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-7:
                break
        negative = [i for i in free if i and beta[i] < 0]
        if not negative:
            break
        beta[negative] = 0
        free = np.array([i for i in free if i not in negative])
    return [float(b) for b in beta]


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled texts; ``labels`` holds only rows that may be learned from."""
    per_id = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    chosen = per_id.orderBy(F.xxhash64("k"), "k").limit(sample)
    texts = documents.select(F.col(key).alias("k"), F.col(text).alias("text"))
    # Texts that share a minimum of their shingles are a family. All of them are learned from, but a family
    # is one witness of a term, and weighs as one text of each label that it has.
    drawn = texts.join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min("text").alias("text"))
    marked = cut(drawn.select("text", "y", "k").mapInArrow(_marks, "text string, y int, k bigint, m0 bigint, m1 bigint, m2 bigint"), "labelled")
    # At most ``sample`` rows of four numbers.
    families = _families([tuple(r) for r in marked.select("k", "m0", "m1", "m2").orderBy("k").collect()])
    of_id = documents.sparkSession.createDataFrame(list(families.items()), "k bigint, family int")
    sized = marked.select("text", "y", "k").join(F.broadcast(of_id), "k")
    sizes = sized.groupBy("family", "y").agg((1 / F.count("*")).alias("w"))
    drawn = cut(sized.join(F.broadcast(sizes), ["family", "y"]).select("text", "y", "family", "w"), "witnesses")
    size = {r["y"]: r["n"] for r in drawn.groupBy("y").agg(F.count_distinct("family").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    prior = math.log((toxic + 0.5) / (clean + 0.5))
    if not toxic or not clean:
        return Model({}, frozenset(), [prior if toxic + clean else -30.0, 0.0, 0.0, 0.0, 0.0])
    dealt = drawn.select("text", "y", "family").repartition("family").sortWithinPartitions("family", "y")
    counts = cut(dealt.mapInArrow(_count_terms, "term string, pos bigint, neg bigint").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos + neg > 3"), "terms")
    candidates = counts.count()
    # Every term that ``_choose`` would take passes here: their number is the labelled texts' matter, not the corpus's.
    ratio = f"((pos + 0.5) / {toxic + 1}D) / ((neg + 0.5) / {clean + 1}D)"
    rate = toxic / (toxic + clean)
    other = f"if(neg > 0, neg / (pos + neg) * ln(neg / (pos + neg) / {1 - rate!r}D), 0D)"
    bound = f"(pos + neg) * (pos / (pos + neg) * ln(pos / (pos + neg) / {rate!r}D) + {other})"
    rows = counts.where(f"pos > 3 and {ratio} >= {MIN_RATIO} and {bound} >= {math.log(max(2, candidates)) - 1e-6!r}D").select("term", "pos", "neg").collect()
    weights = _choose([tuple(r) for r in rows], candidates, toxic, clean)
    if not weights:
        return Model({}, frozenset(), [prior, 0.0, 0.0, 0.0, 0.0])
    rough = Model(weights, frozenset(), [0.0] * 5)

    def near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, *rest = (c.to_pylist() for c in batch.columns)
            rows = [(t, y, w) for x, y, w in zip(texts, *rest, strict=True) for t in {h[0] for h in rough.hits(x or "") if h[2]}]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.float64()))], names=["token", "y", "w"])

    # Words near a term that clean texts use: words of the labelled texts, no more.
    near = drawn.select("text", "y", "w").mapInArrow(near_words, "token string, y int, w double").groupBy("token")
    near = near.agg(F.sum(F.col("w") * F.col("y")).alias("pos"), F.sum(F.col("w") * (1 - F.col("y"))).alias("neg"))
    clean_words = near.where("neg > 0 and neg * 4 >= pos").select("token").collect()
    model = Model(weights, frozenset(r["token"] for r in clean_words), [0.0] * 5)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [[round(v, 3) for v in model.features(t.as_py() or "")] for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in x], pa.float64()) for i in range(1, 5)), *batch.columns[1:]], names=["a", "b", "c", "d", "y", "w"])

    # At most ``sample`` rows of six numbers, equal ones weighed together.
    keys = ["a", "b", "c", "d", "y"]
    table = drawn.select("text", "y", "w").mapInArrow(described, "a double, b double, c double, d double, y int, w double").groupBy(*keys).agg(F.round(F.sum("w"), 6).alias("w")).orderBy(*keys).collect()
    x = np.array([[1.0, r["a"], r["b"], r["c"], r["d"]] for r in table])
    y, weight = np.array([r["y"] for r in table], float), np.array([r["w"] for r in table])
    model.beta = _logistic(x, y, weight)
    return model


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``score`` and ``predicted``; columns of those names are replaced."""
    df, scored = df.drop("score", "predicted"), F.col(text)
    own = df.select("*", scored.alias("_scored"))
    n = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py() or "") for t in batch.column(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=[*batch.schema.names[:n], "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return own.mapInArrow(run, f"{fields}, score double, predicted int")


def training_labels(labels: DataFrame) -> DataFrame:
    """Rows that may be learned from: crc32 of the id as text, modulo 5, is not 0."""
    return labels.where(~held_out("doc_id"))


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))
