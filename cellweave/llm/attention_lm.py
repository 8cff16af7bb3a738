"""A causal self-attention language model in numpy over subword ids.

One attention layer reads a window of ids and predicts the class of the next id; within its class an id has its share of
the training documents' counts. Windows overlap: each begins CONTEXT ids before the ids that it scores, so every id is
scored once, with CONTEXT to WINDOW - 1 ids before it in view.

Weights of shards of a corpus, each trained from the same start, go through `packed` and `mean` into those of their union.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

WIDTH = 16  # of the hidden state
WINDOW = 24
CONTEXT = 8  # ids of a window that only serve as context
SCORED = WINDOW - CONTEXT
CLASSES = 48
STEPS, BATCH, RATE, SEED = 250, 128, 0.01, 7
NEVER = np.float32(-1e9)
SAFE = 80.0  # exponents of at most this size need no shift
UNIT = 1 << 16  # packed weights are whole numbers of 1 / UNIT, so that their sums don't depend on the order


def id_classes(counts: np.ndarray, groups: np.ndarray, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """Each id's class, and the natural log of its share in it. Ids of a group, by frequency, fill classes of like mass."""
    smooth = counts.astype(np.float64) + 1
    of, base = np.zeros(len(counts), np.int32), 0
    kinds = np.unique(groups)
    for g in kinds:
        ids = np.flatnonzero(groups == g)
        ids = ids[np.lexsort((ids, -smooth[ids]))]
        bins = max(1, classes // len(kinds))
        before = np.cumsum(smooth[ids]) - smooth[ids]
        of[ids] = base + np.minimum(bins - 1, (bins * before / smooth[ids].sum()).astype(np.int32))
        base += bins
    return of, np.log(smooth / np.bincount(of, smooth, base)[of])


def _bias(relative: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each query (a scored place) adds for each key: never for later places, and a value by distance."""
    far = (np.arange(SCORED)[:, None] + CONTEXT) - np.arange(WINDOW)[None, :]
    return np.where(far >= 0, np.float32(0), NEVER), relative[np.maximum(far, 0)].astype(np.float32)


def _shifted(x: np.ndarray) -> np.ndarray:
    """x, with the largest of each row taken off if its exponentials could overflow or all vanish."""
    if x.size and max(x.max(), -x.min()) > SAFE:
        x -= x.max(axis=-1, keepdims=True)
    return x


def _close(a: np.ndarray, x: np.ndarray, pad: int, some: np.ndarray) -> None:
    """No place sees padding, which only some windows have."""
    if len(some):
        a[some] += np.where(x[some] == pad, NEVER, np.float32(0))[:, None, :]


def _most(*tables: np.ndarray) -> float:
    """The product of the tables' longest rows: no product of two rows is larger."""
    return float(np.prod([np.sqrt(np.einsum("ij,ij->i", x, x).max()) for x in tables]))


def windows(docs: list[np.ndarray], start: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (n, WINDOW), targets (n, SCORED; pad where there is none) and the number of windows of each document."""
    each = np.array([-(-len(x) // SCORED) for x in docs], np.int64)
    room = each * SCORED + CONTEXT
    at = np.cumsum(room) - room
    ids, out = np.full(int(room.sum()), pad, np.int32), np.full(int(room.sum()), pad, np.int32)
    for x, a in zip(docs, at.tolist()):
        a += CONTEXT
        ids[a] = start
        ids[a + 1 : a + len(x)] = x[:-1]
        out[a : a + len(x)] = x
    first = np.repeat(at - SCORED * (np.cumsum(each) - each), each) + SCORED * np.arange(int(each.sum()))
    return ids[first[:, None] + np.arange(WINDOW)], out[first[:, None] + np.arange(CONTEXT, WINDOW)], each


def _aligned(x: np.ndarray) -> np.ndarray:
    """A copy of x that begins where a line of the cache does: a row of WIDTH numbers then lies in one."""
    room = np.empty(x.nbytes + 64, np.uint8)
    at = -room.ctypes.data % 64
    out = room[at : at + x.nbytes].view(x.dtype).reshape(x.shape)
    out[...] = x
    return out


@dataclass
class AttentionModel:
    """Tables by id, so that scoring looks projections up instead of multiplying them out. The last id is padding."""

    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    skip: np.ndarray
    relative: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    of_class: np.ndarray
    in_class: np.ndarray
    start: int

    @cached_property
    def tame(self) -> bool:
        """Whether no exponent can need a shift."""
        places = _most(self.query, self.key) + np.abs(self.relative).max()
        classes = (_most(self.value) + _most(self.skip)) * _most(self.out.T) + np.abs(self.out_bias).max()
        return bool(max(places, classes) <= SAFE)

    @cached_property
    def rows(self) -> list[np.ndarray]:
        return [_aligned(x) for x in (self.query, self.key, self.value, self.skip)]

    @cached_property
    def targets(self) -> tuple[np.ndarray, np.ndarray]:
        """By id: its class, and what is added to that class's logit; nothing for padding."""
        of = np.append(self.of_class, np.zeros(1, self.of_class.dtype))
        own = np.append(self.in_class, 0.0)
        if self.tame:  # else the bias is in the logits
            own[:-1] += self.out_bias.take(self.of_class)
        return of, own

    def log10(self, docs: list[np.ndarray], chunk: int = 256) -> np.ndarray:
        """log10 probability of each list of ids, which ends with the end id."""
        pad, d = len(self.key) - 1, WIDTH
        ids, targets, each = windows(docs, self.start, pad)
        never, near = _bias(self.relative)
        both, padded = (never + near).ravel(), (ids == pad).any(axis=1)
        total, classes = np.empty(len(ids)), self.out.shape[1]
        ones, firsts = np.ones(WINDOW, np.float32), np.arange(0, chunk * SCORED * classes, classes)
        by = np.exp(self.out_bias if self.tame else np.zeros(classes, np.float32))
        (query, key, value, skip), (of_class, own) = self.rows, self.targets
        for lo in range(0, len(ids), chunk):
            x, y = ids[lo : lo + chunk], targets[lo : lo + chunk].ravel()
            n = len(x)
            a = np.matmul(query.take(x[:, CONTEXT:], axis=0), key.take(x, axis=0).transpose(0, 2, 1))
            if self.tame:
                flat = a.reshape(n, -1)
                flat += both
            else:
                a = _shifted(a + near) + never
            _close(a, x, pad, np.flatnonzero(padded[lo : lo + chunk]))
            np.exp(a, out=a)
            h = np.matmul(a, value.take(x, axis=0))
            h *= np.repeat(1 / (a.reshape(-1, WINDOW) @ ones + np.float32(1e-20)), d).reshape(h.shape)
            h += skip.take(x[:, CONTEXT:], axis=0)
            z = np.matmul(h.reshape(SCORED, n, d), self.out).reshape(-1, classes)  # in parts that stay in the cache
            if not self.tame:
                _shifted(np.add(z, self.out_bias, out=z))
            picked = z.ravel().take(firsts[: len(y)] + of_class.take(y))
            np.exp(z, out=z)
            lp = picked.astype(np.float64) - np.log(z @ by)
            lp *= y != pad
            lp += own.take(y)
            total[lo : lo + chunk] = lp.reshape(-1, SCORED).sum(axis=1)
        ends = np.cumsum(each)
        sums = np.concatenate(([0.0], np.cumsum(total)))
        return (sums[ends] - sums[ends - each]) / np.log(10)


Weights = dict[str, np.ndarray]  # e: ids; w: query, key, value and skip side by side; r: distances; u, b: classes


def initial(counts: np.ndarray, of: np.ndarray) -> Weights:
    """Small random weights; the classes' biases are the logs of their shares."""
    rng = np.random.default_rng(SEED)
    n, d, k = len(counts) + 1, WIDTH, int(of.max()) + 1
    p = {"e": rng.normal(0, 0.1, (n, d)), "r": np.zeros(WINDOW), "u": rng.normal(0, 0.1, (d, k)), "b": np.log(np.bincount(of, counts + 1.0, k) / (counts + 1.0).sum())}
    p["w"] = rng.normal(0, d**-0.5, (d, 4 * d))
    return {name: x.astype(np.float32) for name, x in p.items()}


def _adam(x: np.ndarray, m: np.ndarray, v: np.ndarray, grad: np.ndarray, scale: np.float32) -> None:
    m *= np.float32(0.9)
    m += np.float32(0.1) * grad
    v *= np.float32(0.99)
    grad *= grad
    grad *= np.float32(0.01)
    v += grad
    by = np.sqrt(v)
    by += np.float32(1e-8)
    x -= np.divide(m, by, out=by) * scale


def train(p: Weights, of: np.ndarray, xs: np.ndarray, ys: np.ndarray, picks: list[np.ndarray]) -> None:
    """Adam on the cross-entropy of classes, in place: a step for each batch of windows, at a rate that falls to a tenth.

    The weights but those of ids are one vector, and the large arrays are made once. Products over all places of a batch go
    in parts that stay in the cache.
    """
    d, pad, k = WIDTH, len(p["e"]) - 1, p["u"].shape[1]
    names = ("w", "u", "b", "r")
    cuts = np.cumsum([p[x].size for x in names])
    rest = np.concatenate([p[x].ravel() for x in names])
    rest_m, rest_v, grad = (np.zeros_like(rest) for _ in range(3))
    (w, u, b, r), (grad_w, grad_u, grad_b, grad_r) = ((x[: cuts[0]].reshape(d, 4 * d), x[cuts[0] : cuts[1]].reshape(d, k), x[cuts[1] : cuts[2]], x[cuts[2] :]) for x in (rest, grad))
    state = np.stack((p["e"], *np.zeros((2, *p["e"].shape), np.float32)))
    root = np.repeat(np.array([d**-0.5, 1, 1, 1], np.float32), d)  # of queries, into w
    most, float32 = max(map(len, picks), default=0), np.float32
    backs = np.zeros((most, WINDOW, 4 * d), float32)
    seen, d_seen = np.empty((2, most, SCORED, WINDOW), float32)
    hidden, d_hidden = np.empty((2, most, SCORED, d), float32)
    logits, starts = np.empty((most * SCORED, k), float32), np.arange(0, most * SCORED * k, k)
    far = np.maximum((np.arange(SCORED)[:, None] + CONTEXT) - np.arange(WINDOW)[None, :], 0)
    never = _bias(r)[0]
    ones = np.ones(max(WINDOW, k, most * SCORED), float32)
    padded = (xs == pad).any(axis=1)
    for step, pick in enumerate(picks, 1):
        x, y = xs.take(pick, axis=0), ys.take(pick, axis=0).ravel()
        n, flat = len(x), x.ravel()
        order = np.argsort(flat, kind="stable")
        ids = flat.take(order)
        new = ids[1:] != ids[:-1]
        edge, back = np.append(0, np.flatnonzero(new) + 1), np.empty(len(ids), np.int64)
        back[order[:1]], back[order[1:]] = 0, np.cumsum(new)
        rows = ids.take(edge)
        e, e_m, e_v = own = [x.take(rows, axis=0) for x in state]
        by_root = w * root
        at = (e @ by_root).take(back, axis=0).reshape(n, WINDOW, 4 * d)
        q, key, val = at[:, CONTEXT:, :d], at[:, :, d : 2 * d], at[:, :, 2 * d : 3 * d]
        near = r.take(far)
        a = np.matmul(q, key.transpose(0, 2, 1), out=seen[:n])
        if max(a.max(), -a.min()) + np.abs(r).max() <= SAFE:
            flat_a = a.reshape(n, -1)
            flat_a += (never + near).ravel()
        else:
            a += near
            _shifted(a)
            a += never
        some = np.flatnonzero(padded.take(pick))
        _close(a, x, pad, some)
        np.exp(a, out=a)
        a *= np.repeat(1 / ((a.reshape(-1, WINDOW) @ ones[:WINDOW]) + float32(1e-20)), WINDOW).reshape(a.shape)
        h = np.matmul(a, val, out=hidden[:n])
        h += at[:, CONTEXT:, 3 * d :]
        dz = np.matmul(h.reshape(SCORED, n, d), u, out=logits[: n * SCORED].reshape(SCORED, n, k)).reshape(n, -1)
        dz += np.tile(b, SCORED)
        dz = _shifted(dz.reshape(-1, k))
        np.exp(dz, out=dz)
        real = y != pad
        weight = real / float32(max(1, real.sum()))
        dz *= np.repeat(weight / (dz @ ones[:k]), k).reshape(dz.shape)
        dz.reshape(-1)[starts[: n * SCORED] + of.take(np.where(real, y, 0))] -= weight
        parts_z, dh = dz.reshape(SCORED, n, k), d_hidden[:n]
        np.matmul(parts_z, np.ascontiguousarray(u.T), out=dh.reshape(SCORED, n, d))
        ds = np.matmul(dh, val.transpose(0, 2, 1), out=d_seen[:n])
        ds *= a
        ds -= a * np.repeat(ds.reshape(-1, WINDOW) @ ones[:WINDOW], WINDOW).reshape(a.shape)
        back4 = backs[:n]
        np.matmul(ds, key, out=back4[:, CONTEXT:, :d])
        np.matmul(ds.transpose(0, 2, 1), q, out=back4[:, :, d : 2 * d])
        np.matmul(a.transpose(0, 2, 1), dh, out=back4[:, :, 2 * d : 3 * d])
        back4[:, CONTEXT:, 3 * d :] = dh
        parts = back4.reshape(WINDOW, n, 4 * d)
        np.multiply(np.matmul(e.take(back, axis=0).reshape(WINDOW, n, d).transpose(0, 2, 1), parts).sum(axis=0), root, out=grad_w)
        each = np.matmul(parts, np.ascontiguousarray(by_root.T)).reshape(-1, d).take(order, axis=0)
        grad_e = np.add.reduceat(each.view(np.complex64), edge, axis=0).view(float32)  # two at a time
        np.matmul(h.reshape(SCORED, n, d).transpose(0, 2, 1), parts_z).sum(axis=0, out=grad_u)
        np.matmul(ones[: n * SCORED], dz, out=grad_b)
        grad_r[:] = np.bincount(far.ravel(), (ones[:n] @ ds.reshape(n, -1)), WINDOW)
        rate = RATE * (1 - 0.9 * (step - 1) / len(picks))
        scale = float32(rate * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step))
        _adam(e, e_m, e_v, grad_e, scale)
        _adam(rest, rest_m, rest_v, grad, scale)
        for to, kept in zip(state, own):
            to[rows] = kept
    p["e"][:] = state[0]
    for name, x in zip(names, np.split(rest, cuts[:-1])):
        p[name][...] = x.reshape(p[name].shape)


def train_shard(p: Weights, of: np.ndarray, docs: list[np.ndarray], start: int, passes: int, seed: int) -> np.ndarray:
    """Train p in place on every window of docs, passes times each, in random order; how often each id was an input."""
    xs, ys, _ = windows(docs, start, len(p["e"]) - 1)
    xs = xs.astype(np.uint16) if len(p["e"]) <= 1 << 16 else xs  # sorted faster
    rng = np.random.default_rng((SEED, seed))
    turns = np.concatenate([rng.permutation(len(xs)) for _ in range(passes)])
    train(p, of, xs, ys, np.array_split(turns, max(1, len(turns) // BATCH)))
    return np.bincount(xs.ravel(), minlength=len(p["e"]))


def _rest(p: Weights) -> list[str]:
    return [name for name in sorted(p) if name != "e"]


def packed(p: Weights, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of WIDTH weights: their places, what each counts for in a mean, and their whole numbers times that.

    The row of an id counts as often as the id was seen; the other weights, after all ids, as the places seen.
    """
    rest = np.concatenate([p[name].ravel() for name in _rest(p)])
    rest = np.append(rest, np.zeros(-len(rest) % WIDTH, np.float32)).reshape(-1, WIDTH)
    rows = np.flatnonzero(seen)
    n = np.append(seen[rows], np.full(len(rest), seen.sum()))
    values = np.rint(np.concatenate((p["e"][rows], rest)).astype(np.float64) * UNIT).astype(np.int64)
    return np.append(rows, len(p["e"]) + np.arange(len(rest))), n, values * n[:, None]


def mean(p: Weights, place: np.ndarray, n: np.ndarray, values: np.ndarray) -> Weights:
    """p with the means of packed rows, summed by place, in their places."""
    rest = np.concatenate([p[name].ravel() for name in _rest(p)])
    every = np.append(np.append(p["e"].ravel(), rest), np.zeros(-len(rest) % WIDTH, np.float32)).reshape(-1, WIDTH)
    every[place] = values / (n[:, None] * float(UNIT))
    out, flat, at = {"e": every[: len(p["e"])]}, every.ravel(), p["e"].size
    for name in _rest(p):
        out[name] = flat[at : at + p[name].size].reshape(p[name].shape)
        at += p[name].size
    return out


def model(p: Weights, of: np.ndarray, inside: np.ndarray, start: int) -> AttentionModel:
    q, k, v, s = (p["e"] @ w for w in np.split(p["w"], 4, axis=1))
    return AttentionModel(q * np.float32(WIDTH**-0.5), k, v, s, p["r"], p["u"], p["b"], of, inside, start)


def trained(docs: list[np.ndarray], counts: np.ndarray, groups: np.ndarray, start: int, steps: int = STEPS) -> AttentionModel:
    """A model of docs after steps of BATCH random windows; the same input gives the same model."""
    of, inside = id_classes(counts, groups)
    p = initial(counts, of)
    if docs:
        xs, ys, _ = windows(docs, start, len(counts))
        train(p, of, xs, ys, list(np.random.default_rng(SEED).integers(0, len(xs), (steps, BATCH))))
    return model(p, of, inside, start)
