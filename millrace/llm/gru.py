"""A gated recurrent language model in numpy: training by truncated backpropagation, scoring with
carried state, and an output softmax factored into classes. Documents go through lanes one after
another and the state starts at zero with each. Scoring gives a lane whole documents; training cuts one
stream of them into lanes of equal length, so the document at a lane's end goes on, with a fresh state,
in the next lane.

Classes are runs of words by frequency, cut at equal shares of the summed roots of their counts, so
that frequent words stand in small classes and a token costs few comparisons.

Gates lie one after another (gates x lanes x width), so that each is one stretch of memory: slices of a
row of three gates cost numpy many times the arithmetic."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

#: Ids 0 and 1; words follow by falling frequency.
END, OTHER = 0, 1
#: Rows whose class logits, and parameters that the optimiser, takes through the processor's cache at once.
ROWS, ENTRIES = 2048, 1 << 14


@dataclass
class Shape:
    classes: int = 32
    members: int = 32
    width: int = 32

    @property
    def vocabulary(self) -> int:
        return self.classes * self.members


def class_bounds(counts: np.ndarray, classes: int) -> np.ndarray:
    """Where each class begins, and the end: no class is empty."""
    n = len(counts)
    upto = np.cumsum(np.sqrt(counts))
    cut = np.searchsorted(upto, upto[-1] * np.arange(classes + 1) / classes)
    cut[0], cut[-1] = 0, n
    i = np.arange(classes + 1)
    cut = np.maximum.accumulate(cut - i) + i
    return np.minimum(cut, n - classes + i)


def summed(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs of rows that begin at first: neighbours in a run are added until one row is left of each."""
    out = np.empty((len(first), rows.shape[1]), rows.dtype)
    size, run = np.diff(np.append(first, len(rows))), np.arange(len(first))
    start = first
    while len(run):
        one = size == 1
        out[run[one]] = rows.take(start[one], axis=0)
        run, start, size = run[~one], start[~one], size[~one]
        half = (size + 1) // 2
        begin = np.cumsum(half) - half
        even = np.arange(half.sum())
        even += np.repeat(start - begin, half) + even - np.repeat(begin, half)
        left = rows.take(even, axis=0)
        odd = even + 1 < np.repeat(start + size, half)
        if odd.all():
            left += rows.take(even + 1, axis=0)
        else:
            left[odd] += rows.take(even[odd] + 1, axis=0)
        rows, start, size = left, begin, half
    return out


def descend(p: np.ndarray, v: np.ndarray, g: np.ndarray, clip: float, rate: float, done: int) -> None:
    """The running mean square of the clipped gradient, and a step along it by its root. g is used up."""
    share, scale, least = np.float32(0.01 * clip * clip), np.float32((1 - 0.99**done) ** -0.5 / (clip * rate)), np.float32(1e-8 / (clip * rate))
    room = np.empty(min(len(p), ENTRIES), np.float32)
    for i in range(0, len(p), ENTRIES):
        a, b, c = p[i : i + ENTRIES], v[i : i + ENTRIES], g[i : i + ENTRIES]
        d = room[: len(a)]
        np.multiply(c, c, out=d)
        d *= share
        b *= np.float32(0.99)
        b += d
        np.sqrt(b, out=d)
        d *= scale
        d += least
        c /= d
        a += c


@dataclass
class Model:
    shape: Shape
    p: dict[str, np.ndarray] = field(default_factory=dict)
    bounds: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.cls = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds)).astype(np.uint16)

    @classmethod
    def start(cls, shape: Shape, counts: np.ndarray, seed: int = 0) -> Model:
        """Output biases from counts of the whole corpus: an untrained model is the unigram model."""
        rng, h = np.random.default_rng(seed), shape.width
        full = np.full(shape.vocabulary, 1e-12)
        full[: len(counts)] = np.maximum(counts, 0.5)
        bounds = class_bounds(full, shape.classes)
        mass = np.add.reduceat(full, bounds[:-1])
        scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {
            "E": scale(shape.vocabulary, h) * np.float32(np.sqrt(shape.vocabulary / h)),
            "W": scale(h, 3 * h), "U": scale(h, 3 * h), "b": np.zeros(3 * h, np.float32),
            "C": scale(h, shape.classes) * np.float32(0.1), "c": np.log(mass / full.sum()).astype(np.float32),
            "M": scale(shape.vocabulary, h) * np.float32(0.1 * np.sqrt(shape.vocabulary / h)), "m": np.log(full / np.repeat(mass, np.diff(bounds))).astype(np.float32),
        }
        return cls(shape, p, bounds)

    def gates(self, k: str) -> np.ndarray:
        """W or U as gates x width x width."""
        w = self.shape.width
        return np.ascontiguousarray(self.p[k].reshape(w, 3, w).swapaxes(0, 1))

    def step(self, gx: np.ndarray, h: np.ndarray, u: np.ndarray, gh: np.ndarray, n: np.ndarray) -> np.ndarray:
        """One step from the input part and the state, by gates. gh is left with both gates and the state's part
        of the candidate, n with the candidate."""
        np.matmul(h, u, out=gh)
        # By exp, which is faster than tanh: (1 + tanh a) / 2 = 1 / (1 + exp -2a).
        zr = gh[:2]
        zr += gx[:2]
        zr *= np.float32(-2)
        np.exp(zr, out=zr)
        zr += np.float32(1)
        np.reciprocal(zr, out=zr)
        np.multiply(zr[1], gh[2], out=n)
        n += gx[2]
        np.tanh(n, out=n)
        new = h - n
        new *= zr[0]
        new += n
        return new

    @np.errstate(over="ignore")
    def cell(self, gx: np.ndarray, h: np.ndarray):
        """One step by rows: the new state, both gates, the candidate and the state's part of it."""
        w = self.shape.width
        gh, n = np.empty((3, *h.shape), np.float32), np.empty(h.shape, np.float32)
        new = self.step(gx.reshape(-1, 3, w).swapaxes(0, 1), h, self.gates("U"), gh, n)
        return new, np.hstack(gh[:2]), n, gh[2]

    def by_id(self, ids: np.ndarray) -> np.ndarray:
        return np.argsort(ids.astype(np.uint16) if self.shape.vocabulary <= 65536 else ids, kind="stable")

    @np.errstate(over="ignore", invalid="ignore", divide="ignore")
    def output(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None, order: np.ndarray | None = None, shift: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probabilities of the targets; with grads also their gradient by the states. order: by_id of
        the targets. Logits are shifted only where a sum of exps could leave the range."""
        p, n = self.p, len(targets)
        if not n:
            if grads is not None:
                grads.update({k: np.zeros_like(p[k]) for k in "CcMm"})
            return np.zeros(0), np.zeros_like(states)
        # Classes are runs of ids, so the order by id is one by class too.
        order = self.by_id(targets) if order is None else order
        s, t = states.take(order, axis=0), targets[order]
        own = self.cls[t]
        sizes = np.bincount(own, minlength=self.shape.classes)
        ends = np.cumsum(sizes)
        rows, ones = np.arange(n), np.ones(max(n, self.shape.vocabulary), np.float32)
        back = None
        if grads is not None:
            back, by_m, by_bias = np.empty_like(s), np.zeros_like(p["M"]), np.zeros_like(p["m"])
            by_class, by_c = np.zeros(p["C"].T.shape, np.float32), np.zeros_like(p["c"])

        def part(i: slice, at: np.ndarray, m: np.ndarray, bias: np.ndarray, logits: np.ndarray, total: np.ndarray) -> np.ndarray:
            """Fills the logits of the columns at and the sums of exps; exps, or with grads the gradient by the logits."""
            e = s[i] @ m
            e += bias
            if shift:
                e -= e.max(axis=1, keepdims=True)
            there = rows[: len(e)], at
            logits[i] = e[there]
            np.exp(e, out=e)
            np.matmul(e, ones[: len(bias)], out=total[i])
            if grads is not None:
                e *= (np.float32(-1) / total[i])[:, None]
                e[there] += np.float32(1)
            return e

        out, total, more, within = np.empty(n, np.float32), np.ones(n, np.float32), np.zeros(n, np.float32), np.ones(n, np.float32)
        for a in range(0, n, ROWS):
            i = slice(a, min(n, a + ROWS))
            e = part(i, own[i], p["C"], p["c"], out, total)
            if grads is not None:
                by_class += e.T @ s[i]
                by_c += ones[: len(e)] @ e
                np.matmul(e, p["C"].T, out=back[i])
        at = t - self.bounds[own]
        for c in np.flatnonzero(sizes):
            lo, hi = self.bounds[c], self.bounds[c + 1]
            if hi - lo == 1:
                continue
            i = slice(ends[c] - sizes[c], ends[c])
            m = p["M"][lo:hi]
            e = part(i, at[i], m.T, p["m"][lo:hi], more, within)
            if grads is not None:
                np.matmul(e.T, s[i], out=by_m[lo:hi])
                np.matmul(ones[: len(e)], e, out=by_bias[lo:hi])
                back[i] += e @ m
        if not shift and not (min(total.min(), within.min()) >= 1e-30 and max(total.max(), within.max()) <= 1e26):
            return self.output(states, targets, grads, order, True)
        if grads is not None:
            grads.update(C=np.ascontiguousarray(by_class.T), c=by_c, M=by_m, m=by_bias)
        out += more
        out -= np.log(total)
        out -= np.log(within)
        place = np.empty_like(order)
        place[order] = rows
        return out[place], None if back is None else back.take(place, axis=0)

    @np.errstate(over="ignore")
    def window(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, real: np.ndarray | None = None) -> tuple[np.ndarray, dict[str, np.ndarray], float]:
        """One window of truncated backpropagation. x: time x lanes; fresh: a document starts here; real: not padding."""
        p, w = self.p, self.shape.width
        steps, lanes = x.shape
        flat_x, n = x.ravel(), x.size
        # Each word's input part is made once, and its gradients are summed before they go through W.
        order = self.by_id(flat_x)
        ids = flat_x[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        ids = ids[first]
        word = np.empty(n, np.int64)
        word[order] = np.repeat(np.arange(len(ids)), np.diff(np.append(first, n)))
        emb = p["E"].take(ids, axis=0)
        table = emb @ p["W"]
        table += p["b"]
        gx = table.reshape(-1, w).take(3 * word + np.arange(3)[:, None], axis=0).reshape(3, steps, lanes, w)
        starts = [np.flatnonzero(f) for f in fresh]
        states, cand = (np.empty((steps, lanes, w), np.float32) for _ in range(2))
        gh, u = np.empty((3, steps, lanes, w), np.float32), self.gates("U")
        for t in range(steps):
            states[t] = h
            if len(starts[t]):
                states[t, starts[t]] = 0
            h = self.step(gx[:, t], states[t], u, gh[:, t], cand[t])
        grads: dict[str, np.ndarray] = {}
        if real is None:
            logp, back = self.output(states.reshape(-1, w), flat_x, grads, order)
        else:
            use = np.flatnonzero(real.ravel())
            back = np.zeros((n, w), np.float32)
            logp, back[use] = self.output(states.reshape(-1, w)[use], flat_x[use], grads)
        back = back.reshape(steps, lanes, w)
        # By z, by r, by the state's part of the candidate, by the candidate. A gate is (1 + tanh) / 2.
        d, through = np.empty((4, steps, lanes, w), np.float32), np.empty((3, lanes, w), np.float32)
        a, dh, back_u = np.empty((lanes, w), np.float32), np.zeros((lanes, w), np.float32), np.ascontiguousarray(u.swapaxes(1, 2))
        one, two = np.float32(1), np.float32(2)
        for t in range(steps - 1, -1, -1):
            (z, r, part), c, (by_z, by_r, by_part, by_cand) = gh[:, t], cand[t], d[:, t]
            np.subtract(one, z, out=a)
            a *= dh
            np.multiply(c, c, out=by_cand)
            np.subtract(one, by_cand, out=by_cand)
            by_cand *= a
            np.subtract(states[t], c, out=by_z)
            by_z *= a
            by_z *= z
            by_z *= two
            np.multiply(by_cand, r, out=by_part)
            np.subtract(one, r, out=by_r)
            by_r *= by_part
            by_r *= part
            by_r *= two
            np.matmul(d[:3, t], back_u, out=through)
            dh *= z
            for x_ in through:
                dh += x_
            dh += back[t]
            if len(starts[t]):
                dh[starts[t]] = 0
        by_gate = np.matmul(states.reshape(-1, w).T, d[:3].reshape(3, -1, w))
        grads["U"] = by_gate.swapaxes(0, 1).reshape(w, 3 * w)
        by_token = d.reshape(-1, w).take(order[:, None] + n * np.array([0, 1, 3]), axis=0).reshape(n, 3 * w)
        by_word = summed(by_token, first)
        grads["W"], grads["b"] = emb.T @ by_word, by_word.sum(axis=0)
        grads["E"] = np.zeros_like(p["E"])
        grads["E"][ids] = by_word @ p["W"].T
        return h, grads, float(logp.sum())

    def train(self, docs: list[np.ndarray], epochs: int = 3, lanes: int = 64, steps: int = 32, rate: float = 4e-3, seed: int = 0, kept: dict | None = None) -> list[float]:
        """Mean log probability per token of each epoch. docs end with END. Every token is trained on.
        Steps are scaled by the running root mean square of each parameter's gradient.
        kept: the optimiser's state from call to call; the rate stays, without it it falls to the end."""
        rng = np.random.default_rng(seed)
        state = {} if kept is None else kept
        if not state:
            state.update(done=0, v={k: np.zeros_like(x) for k, x in self.p.items()})
        v, curve = state["v"], []
        docs = [d for d in docs if len(d)]
        if not docs:
            return curve
        windows = epochs * max(1, -(-sum(map(len, docs)) // (lanes * steps)))
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            stream = np.concatenate([docs[i] for i in order])
            fresh = np.zeros(len(stream), bool)
            fresh[np.concatenate([[0], np.cumsum([len(docs[i]) for i in order])[:-1]])] = True
            b = min(lanes, len(stream))
            per = -(-len(stream) // b)
            pad = b * per - len(stream)
            x = np.ascontiguousarray(np.pad(stream, (0, pad), constant_values=END).reshape(b, per).T)
            f = np.pad(fresh, (0, pad)).reshape(b, per).T.copy()
            real = np.pad(np.ones(len(stream), bool), (0, pad)).reshape(b, per).T
            f[0] = True
            h = np.zeros((b, self.shape.width), np.float32)
            total = 0.0
            for at in range(0, per, steps):
                told = real[at : at + steps]
                n = int(told.sum())
                h, grads, logp = self.window(x[at : at + steps], f[at : at + steps], h, told if n < told.size else None)
                total += logp
                state["done"] += 1
                done = state["done"]
                norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
                clip = min(1.0, 2.0 * n / max(norm, 1e-9)) / max(1, n)
                now = rate * (max(0.05, 1 - done / windows) if kept is None else 1)
                for k, g in grads.items():
                    if k != "E":
                        descend(self.p[k].reshape(-1), v[k].reshape(-1), g.reshape(-1), clip, now, done)
                        continue
                    # Words that the window lacks have no gradient: their mean square falls, they stay.
                    rows = np.flatnonzero(np.bincount(x[at : at + steps].ravel()))
                    mine, square = self.p[k][rows], v[k][rows]
                    v[k] *= np.float32(0.99)
                    descend(mine.reshape(-1), square.reshape(-1), g[rows].reshape(-1), clip, now, done)
                    self.p[k][rows], v[k][rows] = mine, square
            curve.append(total / len(stream))
        return curve

    @np.errstate(over="ignore")
    def score(self, docs: list[np.ndarray], lanes: int = 512, steps: int = 32) -> np.ndarray:
        """Natural log probability of each whole document; the state is carried from window to window.
        Windows have `steps` steps at full lanes and more where few lanes are left, as much work each."""
        out = np.zeros(len(docs))
        if not docs:
            return out
        w = self.shape.width
        lanes = min(lanes, len(docs))
        heap = [(0, i) for i in range(lanes)]
        held: list[list[int]] = [[] for _ in range(lanes)]
        for d in np.argsort([-len(x) for x in docs], kind="stable"):
            size, i = heapq.heappop(heap)
            held[i].append(int(d))
            heapq.heappush(heap, (size + len(docs[d]), i))
        held.sort(key=lambda x: -sum(len(docs[d]) for d in x))
        sizes = np.array([sum(len(docs[d]) for d in x) for x in held])
        begin = np.cumsum(sizes) - sizes
        stream = np.concatenate([docs[d] for x in held for d in x])
        owner = np.repeat(np.array([d for x in held for d in x], dtype=np.int32), [len(docs[d]) for x in held for d in x])
        starts = sorted((int(s), i) for i, x in enumerate(held) for s in np.cumsum([0, *[len(docs[d]) for d in x[:-1]]]))
        table = (self.p["E"] @ self.p["W"] + self.p["b"]).reshape(-1, w)
        u, gate = self.gates("U"), np.arange(3)[:, None]
        h = np.zeros((lanes, w), np.float32)
        next_start = 0
        at, work = 0, lanes * steps
        while at < sizes[0]:
            live = int((sizes > at).sum())
            span = min(max(steps, work // live), int(sizes[0]) - at)
            place = at + np.arange(span)[:, None]
            within = place < sizes[:live]
            place = np.minimum(place + begin[:live], len(stream) - 1)
            xt = np.where(within, stream[place], 0).astype(np.int64)
            who = np.where(within, owner[place], -1).ravel()
            states, gh, n = np.empty((span, live, w), np.float32), np.empty((3, live, w), np.float32), np.empty((live, w), np.float32)
            h = h[:live]
            for t in range(span):
                while next_start < len(starts) and starts[next_start][0] == at + t:
                    h[starts[next_start][1]] = 0
                    next_start += 1
                states[t] = h
                h = self.step(table.take(3 * xt[t] + gate, axis=0), h, u, gh, n)
            use = np.flatnonzero(who >= 0)
            full = len(use) == len(who)
            logp, _ = self.output(states.reshape(-1, w) if full else states.reshape(-1, w)[use], xt.ravel() if full else xt.ravel()[use])
            out += np.bincount(who[use], weights=logp, minlength=len(docs))
            at += span
        return out
