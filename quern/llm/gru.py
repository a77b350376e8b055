"""A gated recurrent language model in numpy.

Symbols below ``words`` are predicted one by one: symbol ``s`` belongs to output class
``s // per_class``, and a second softmax tells apart the members of a class. Every other
symbol is a class of its own, told apart outside the model. Texts are laid side by side
in lanes, one after the other in a lane, the state cleared where a text begins; a step
advances all lanes. Arrays are laid out with lanes last, so that every operation runs
over contiguous memory. Training is truncated backpropagation through time: gradients
stop at a window's start, the state goes on. Scoring carries the state through the whole
text, however long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

HIDDEN, RATE = 24, 0.01
#: Steps of a training window; lanes of training and of scoring.
WINDOW, LANES, SCORING_LANES = 16, 256, 512
#: Training reads longer texts in pieces of this many symbols, each with a state of its own.
PIECE = 2048
SCORING_WINDOW = 32


def lay(lengths: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lane and first step of each text, longest first to the lane that is free first, and the lanes' lengths, which fall."""
    lane, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free = [(0, i) for i in range(min(lanes, len(lengths)))]
    for d in np.argsort(-lengths, kind="stable").tolist():
        used, i = free[0]
        lane[d], at[d] = i, used
        heapq.heapreplace(free, (used + int(lengths[d]), i))
    ends = np.zeros(len(free), np.int64)
    for used, i in free:
        ends[i] = used
    order = np.argsort(-ends, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return rank[lane], at, ends[order]


class Lanes:
    """Texts of symbols laid out for parallel steps: what is read, what is to be predicted, and where texts begin.

    All of it lies flat, lane after lane, so that one very long text takes no more room than its symbols.
    """

    def __init__(self, texts: list[np.ndarray], lanes: int, before: list[int]) -> None:
        lengths = np.array([len(t) for t in texts], np.int64)
        lane, at, self.ends = lay(lengths, lanes)
        self.steps = int(self.ends.max(initial=0))
        self.order = np.lexsort((at, lane))
        self.base = np.cumsum(self.ends) - self.ends
        self.target = np.concatenate([texts[i] for i in self.order]).astype(np.int16)
        self.starts = np.cumsum(lengths[self.order]) - lengths[self.order]
        self.read = np.empty_like(self.target)
        self.read[1:] = self.target[:-1]
        self.read[self.starts] = np.array(before)[self.order]
        self.begins = np.zeros(len(self.target), bool)
        self.begins[self.starts] = True

    def window(self, lo: int, width: int) -> tuple[np.ndarray, ...]:
        """(steps, lanes) of what is read, predicted, begins and is there, over the lanes that reach ``lo``, and their places."""
        n = int(np.searchsorted(-self.ends, -lo, side="left"))
        step = np.arange(lo, min(lo + width, self.steps))[:, None]
        there = step < self.ends[None, :n]
        place = np.minimum(self.base[None, :n] + step, len(self.target) - 1)
        return self.read[place], self.target[place], self.begins[place] & there, there, place


class Gru:
    """``symbols`` in all, the first ``words`` predicted one by one in classes of ``per_class``."""

    def __init__(self, words: int, symbols: int, per_class: int, counts: np.ndarray, hidden: int = HIDDEN, dtype: type = np.float32) -> None:
        self.words, self.symbols, self.per_class, self.hidden = words, symbols, per_class, hidden
        self.groups = words // per_class
        classes, h = self.groups + symbols - words, hidden
        # The last row of the output weights is the bias: a constant 1 follows the state.
        self.shapes = {"wx": (3 * h, symbols), "u": (3 * h, h), "wc": (h + 1, classes), "ww": (self.groups, h + 1, per_class)}
        self.own = np.zeros(sum(int(np.prod(s)) for s in self.shapes.values()), dtype)
        self.rooms: dict[str, np.ndarray] = {}
        p, rng = self.views(self.own), np.random.default_rng(7)
        p["wx"][:] = rng.normal(0, 0.1, p["wx"].shape)
        p["wx"][:h] += 1.0  # keep the state at first
        p["u"][:] = rng.normal(0, 1 / np.sqrt(h), p["u"].shape)
        kinds = np.concatenate([counts[:words].reshape(self.groups, per_class).sum(axis=1), counts[words:]]) + 0.5
        p["wc"][h] = np.log(kinds / kinds.sum())
        p["ww"][:, h] = np.log(counts[:words] + 0.5).reshape(self.groups, per_class)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rooms": {}}

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array whose memory is used again in every window: fresh memory costs more than the arithmetic."""
        n = int(np.prod(shape))
        if name not in self.rooms or self.rooms[name].size < n:
            self.rooms[name] = np.empty(n, self.own.dtype)
        return self.rooms[name][:n].reshape(shape)

    def flat(self) -> np.ndarray:
        return self.own.copy()

    def load(self, flat: np.ndarray) -> None:
        self.own[:] = flat

    def _forward(self, p: dict, read: np.ndarray, begins: np.ndarray, h: np.ndarray, tape: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The state after each step as (hidden, steps, lanes), and the last one.

        A gate is ``(1 + tanh(a)) / 2``, which is the logistic function of ``2a``.
        """
        n, (steps, lanes) = self.hidden, read.shape
        seen, inputs = self._room("seen", n, steps, lanes), self._room("inputs", 3 * n, steps, lanes)
        np.take(p["wx"], read.ravel(), axis=1, out=inputs.reshape(3 * n, -1), mode="clip")
        fresh = begins.any(axis=1).tolist()
        if tape is not None:
            tape |= {k: self._room(k, m * n, steps, lanes) for k, m in (("before", 1), ("zr", 2), ("g", 1), ("c", 1))}
        g = self._room("now", 3 * n, lanes)
        for t in range(steps):
            if fresh[t]:
                h = np.where(begins[t], 0, h)
            np.matmul(p["u"], h, out=g)
            zr, c = g[: 2 * n], g[2 * n :]
            zr += inputs[: 2 * n, t]
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            if tape is not None:
                tape["before"][:, t], tape["zr"][:, t], tape["g"][:, t] = h, zr, c
            c *= zr[n:]
            c += inputs[2 * n :, t]
            np.tanh(c, out=c)
            if tape is not None:
                tape["c"][:, t] = c
            h = np.subtract(h, c, out=seen[:, t])
            h *= zr[:n]
            h += c
        return seen, h.copy()

    def _softmax(self, logits: np.ndarray) -> np.ndarray:
        """Makes ``logits`` exponentials in place; their sums by row. Logits stay as they are where none can overflow."""
        if logits.size and logits.max() > 60:
            logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        return logits @ np.ones(logits.shape[1], logits.dtype)

    def _outputs(self, p: dict, seen: np.ndarray, target: np.ndarray, there: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probabilities of the targets, 0 where nothing is there; with ``grads``, also the states' gradients."""
        n, target, there = self.hidden, target.ravel(), there.ravel()
        order = np.argsort(target, kind="stable")
        s, e = self._room("s", len(order), n + 1), self._room("e", len(order), p["wc"].shape[1])
        s[:, n] = 1
        np.take(np.ascontiguousarray(seen.reshape(n, -1).T), order, axis=0, out=s[:, :n], mode="clip")
        y = target[order].astype(np.int64)
        at = np.arange(len(y))
        bounds = np.searchsorted(y, np.arange(self.groups + 1) * self.per_class).tolist()
        inside = bounds[-1]
        kind = np.where(y < self.words, y // self.per_class, y - self.words + self.groups)
        np.matmul(s, p["wc"], out=e)
        total = self._softmax(e)
        found = np.log(e[at, kind] / total)
        spans = [(c, lo, hi) for c, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)) if lo < hi]
        ew = self._room("ew", inside, self.per_class)
        for c, lo, hi in spans:
            np.matmul(s[lo:hi], p["ww"][c], out=ew[lo:hi])
        total_w = self._softmax(ew)
        place, at_w = y[:inside] % self.per_class, at[:inside]
        found[:inside] += np.log(ew[at_w, place] / total_w)
        out = np.empty_like(found)
        out[order] = found
        out *= there
        if grads is None:
            return out, None
        live = there[order].astype(s.dtype)
        e *= (live / total)[:, None]
        e[at, kind] -= live
        ew *= (live[:inside] / total_w)[:, None]
        ew[at_w, place] -= live[:inside]
        grads["wc"][:] = s.T @ e
        grads["ww"][:] = 0
        back, unsorted = self._room("back", len(order), n), self._room("unsorted", len(order), n)
        np.matmul(e, p["wc"][:n].T, out=back)
        for c, lo, hi in spans:
            grads["ww"][c] = s[lo:hi].T @ ew[lo:hi]
            back[lo:hi] += ew[lo:hi] @ p["ww"][c, :n].T
        unsorted[order] = back
        return out, unsorted

    def window(self, p: dict, read: np.ndarray, target: np.ndarray, begins: np.ndarray, there: np.ndarray, h: np.ndarray, grads: dict) -> tuple[float, np.ndarray]:
        """Sets the gradients of a window's negative log likelihood; the log likelihood, and the last state."""
        n, (steps, lanes) = self.hidden, read.shape
        tape: dict = {}
        seen, last = self._forward(p, read, begins, h, tape)
        out, back = self._outputs(p, seen, target, there, grads)
        wanted, deltas, rest, through = (self._room(k, *shape) for k, shape in (("wanted", (n, steps, lanes)), ("deltas", (3 * n, steps, lanes)), ("rest", (n, steps, lanes)), ("through", (3 * n, lanes))))
        wanted.reshape(n, -1)[:] = back.T
        fresh = begins.any(axis=1).tolist()
        dh = np.zeros((n, lanes), h.dtype)
        for t in reversed(range(steps)):  # past a lane's end nothing is wanted, and the gradient is 0
            dh += wanted[:, t]
            before, c, g = tape["before"][:, t], tape["c"][:, t], tape["g"][:, t]
            z, r = tape["zr"][:n, t], tape["zr"][n:, t]
            dz, dr, dc = through[:n], through[n : 2 * n], through[2 * n :]
            keep = dh * z
            np.multiply(c, c, out=dc)
            np.subtract(1, dc, out=dc)
            dh -= keep
            dc *= dh
            deltas[2 * n :, t] = dc
            np.subtract(before, c, out=dz)
            dz *= keep
            dz *= 1 - z
            dz *= 2
            dc *= r
            np.subtract(1, r, out=dr)
            dr *= dc
            dr *= g
            dr *= 2
            deltas[: 2 * n, t], rest[:, t] = through[: 2 * n], dc
            dh = p["u"].T @ through
            dh += keep
            if fresh[t]:
                dh[:, begins[t]] = 0
        before = tape["before"].reshape(n, -1).T
        grads["u"][: 2 * n] = deltas[: 2 * n].reshape(2 * n, -1) @ before
        grads["u"][2 * n :] = rest.reshape(n, -1) @ before
        order = np.argsort(read.ravel(), kind="stable")
        x = read.ravel()[order]
        starts = np.flatnonzero(np.diff(x, prepend=-1))
        grads["wx"][:] = 0
        ordered = self._room("inputs", 3 * n, len(order))
        np.take(deltas.reshape(3 * n, -1), order, axis=1, out=ordered, mode="clip")
        grads["wx"][:, x[starts]] = np.add.reduceat(ordered, starts, axis=1)
        return float(out.sum(dtype=np.float64)), last

    def train(self, blocks: Iterator[list[np.ndarray]], first: int) -> int:
        """One pass over blocks of texts by Adam; the symbols seen. Blocks are of bounded size, and so is what is held."""
        p, grad = self.views(self.own), np.zeros_like(self.own)
        grads = self.views(grad)
        m, v, used = np.zeros_like(grad), np.zeros_like(grad), np.empty_like(grad)
        updates = seen = 0
        for texts in blocks:
            pieces = [(t[at : at + PIECE], first if not at else int(t[at - 1])) for t in texts for at in range(0, len(t), PIECE)]
            total = sum(len(t) for t, _ in pieces)
            if not total:
                continue
            seen += total
            # A small block has fewer lanes, and so as many updates as a large one has at least.
            laid = Lanes([t for t, _ in pieces], int(min(LANES, max(16, total // (WINDOW * 100)))), [b for _, b in pieces])
            h = np.zeros((self.hidden, len(laid.ends)), grad.dtype)
            for lo in range(0, laid.steps, WINDOW):
                read, target, begins, there, _ = laid.window(lo, WINDOW)
                _, h = self.window(p, read, target, begins, there, np.ascontiguousarray(h[:, : read.shape[1]]), grads)
                updates += 1
                grad *= 1 / max(1, int(there.sum()))
                np.clip(grad, -1, 1, out=grad)
                np.subtract(grad, m, out=used)
                used *= 0.1
                m += used
                np.multiply(grad, grad, out=used)
                used -= v
                used *= 0.01
                v += used
                np.sqrt(v, out=used)
                used *= 1 / np.sqrt(1 - 0.99**updates)
                used += 1e-6
                np.divide(m, used, out=used)
                # As lanes run out, fewer texts speak, and each step counts for less.
                used *= RATE * min(1.0, float(there.sum()) / (WINDOW * len(laid.ends))) / (1 - 0.9**updates)
                self.own -= used
        return seen

    def log_likelihood(self, texts: list[np.ndarray], first: int) -> np.ndarray:
        """Natural log probability of each whole text, the state carried from window to window."""
        if not texts:
            return np.zeros(0)
        p, laid = self.views(self.own), Lanes(texts, SCORING_LANES, [first] * len(texts))
        found = np.zeros(len(laid.target), np.float64)
        h = np.zeros((self.hidden, len(laid.ends)), self.own.dtype)
        for lo in range(0, laid.steps, SCORING_WINDOW):
            read, target, begins, there, place = laid.window(lo, SCORING_WINDOW)
            seen, h = self._forward(p, read, begins, np.ascontiguousarray(h[:, : read.shape[1]]))
            out, _ = self._outputs(p, seen, target, there)
            found[place[there]] = out[there.ravel()]
        sums = np.empty(len(texts))
        sums[laid.order] = np.add.reduceat(found, laid.starts)
        return sums
