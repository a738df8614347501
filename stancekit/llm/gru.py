"""A gated recurrent language model in numpy with a class-factored softmax.

``P(word) = P(class | h) P(word | class, h)``, so a step costs two softmaxes of
the square root of the vocabulary. Training is truncated backpropagation over
windows of parallel streams; the state is carried from window to window, in
training and in scoring, and reset where a document starts.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

END, RARE = 0, 1
SIDE = 64  # classes, and words a class
EMBED, HIDDEN = 24, 32
WINDOW = 32
WINDOW_WORDS = 1 << 14  # words scored at a time, at least
ROWS = 1 << 10  # rows of logits at a time: they stay in a core's cache
BLOCK = 1 << 14  # parameters stepped at a time, for the same reason


def initial(counts: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Parameters before training: output biases of the words' frequencies."""
    rng = np.random.default_rng(seed)
    full = np.ones(SIDE * SIDE)
    full[:len(counts)] += counts
    full = full.reshape(SIDE, SIDE)
    p = {"embed": rng.normal(0, 0.3, (SIDE * SIDE, EMBED)), "wx": rng.normal(0, EMBED**-0.5, (EMBED, 3 * HIDDEN)),
         "wh": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)), "b": np.zeros(3 * HIDDEN),
         "wc": rng.normal(0, 0.1, (HIDDEN, SIDE)), "bc": np.log(full.sum(1) / full.sum()),
         "ww": rng.normal(0, 0.1, (SIDE, HIDDEN, SIDE)), "bw": np.log(full / full.sum(1, keepdims=True))}
    return {k: v.astype(np.float32) for k, v in p.items()}


def pieces(docs: list[np.ndarray], size: int) -> tuple[list[np.ndarray], list[int]]:
    """Documents cut into pieces of at most ``size`` words, and the word before each."""
    cuts = [(d, a) for d in docs for a in range(0, len(d), size)]
    return [d[a:a + size] for d, a in cuts], [int(d[a - 1]) if a else END for d, a in cuts]


class Lanes:
    """Documents dealt to parallel lanes of about equal length, the longest lane
    first, so that the lanes in use are always the first ones. Lanes lie end to end:
    what is held grows with the words, not with the longest document."""

    def __init__(self, docs: list[np.ndarray], lanes: int, before: list[int] | None = None):
        size = np.array([len(d) for d in docs], np.int64)
        lanes = max(1, min(lanes, len(docs)))
        heap, lane = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
        for i in np.argsort(-size, kind="stable").tolist():
            load, k = heap[0]
            lane[k].append(i)
            heapq.heapreplace(heap, (load + int(size[i]), k))
        load = np.zeros(lanes, np.int64)
        for n, k in heap:
            load[k] = n
        order = np.argsort(-load, kind="stable")
        self.load = load[order]
        self.first = np.cumsum(self.load) - self.load
        own = np.array([i for k in order for i in lane[k]], np.int64)
        self.steps = int(load.max(initial=0))
        self.y = np.concatenate([docs[i] for i in own] or [np.zeros(0, np.int32)]).astype(np.int32)
        self.doc = np.repeat(own.astype(np.int32), size[own])
        starts = (np.cumsum(size[own]) - size[own])[size[own] > 0]
        self.x, self.keep = np.empty_like(self.y), np.ones(len(self.y), np.float32)
        self.x[1:] = self.y[:-1]
        self.x[starts] = [before[i] for i in own if size[i]] if before else END
        self.keep[starts] = 0

    def on(self, step: int) -> int:
        """Lanes that have a word at this step."""
        return int(np.searchsorted(-self.load, -step, side="left"))

    def window(self, a: int, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``x`` (input: the word before, END at a start or what ``before`` says), ``y``
        (word), ``keep`` (0 where the state is reset) and ``doc`` (-1 on padding) of the
        lanes in use, each (steps, lanes)."""
        on = self.on(a)
        at = np.arange(a, min(a + steps, self.steps))[:, None]
        there = at < self.load[:on]
        at = np.where(there, at + self.first[:on], 0)
        x, y, keep, doc = (v[at] for v in (self.x, self.y, self.keep, self.doc))
        if not there.all():
            gone = ~there
            x[gone], y[gone], keep[gone], doc[gone] = 0, 0, 0, -1
        return x, y, keep, doc


class Room:
    """Arrays that windows of one training run share: fresh memory for each
    window costs more than what is computed in it."""

    def __init__(self, dtype: type = np.float32):
        self._have: dict[str, np.ndarray] = {}
        self._dtype = dtype

    def get(self, name: str, *shape: int, dtype: type | None = None) -> np.ndarray:
        size = math.prod(shape)
        have = self._have.get(name)
        if have is None or have.size < size:
            have = self._have[name] = np.empty(size, dtype or self._dtype)
        return have[:size].reshape(shape)


def _gates_last(wh: np.ndarray) -> np.ndarray:
    """Recurrent weights, a row for each gate's unit. Those of the sigmoids are
    negative, so that taking the input's part off gives what exp is taken of."""
    wh = np.ascontiguousarray(wh.T)
    np.negative(wh[:2 * HIDDEN], out=wh[:2 * HIDDEN])
    return wh


def _run(p, gates, keep, h, room):
    """States after each step; what backpropagation needs. Inside, lanes are the
    last axis, so that each gate's part of an array is one piece of memory."""
    gates, h, wh = gates.transpose(0, 2, 1), h.T, _gates_last(p["wh"])
    steps, _, lanes = gates.shape
    out, n, kept = [room.get(x, steps, HIDDEN, lanes) for x in ("out", "n", "kept")]
    zrn, whole, before = room.get("zrn", steps, 3 * HIDDEN, lanes), keep.all(1).tolist(), []
    with np.errstate(over="ignore"):  # infinity stands for a gate of 0
        for t in range(steps):
            g, rec, m = gates[t], zrn[t], n[t]
            if not whole[t]:
                h = np.multiply(h, keep[t], kept[t])
            before.append(h)
            np.matmul(wh, h, rec)
            zr, new = rec[:2 * HIDDEN], out[t]
            zr -= g[:2 * HIDDEN]
            np.exp(zr, zr)
            zr += 1
            np.reciprocal(zr, zr)
            np.multiply(rec[HIDDEN:2 * HIDDEN], rec[2 * HIDDEN:], m)
            m += g[2 * HIDDEN:]
            np.tanh(m, m)
            np.subtract(h, m, new)
            new *= rec[:HIDDEN]
            new += m
            h = new
    return out.transpose(0, 2, 1), (before, zrn, n, whole)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def _states(wh, wx, embed, x, keep, h):
    """States after each step, for scoring. ``embed`` ends in a one for the bias, the
    last row of ``wx``. Lanes are the last axis inside."""
    h, wh, wx = np.ascontiguousarray(h.T), _gates_last(wh), np.ascontiguousarray(wx.T)
    steps, lanes = x.shape
    out, kept = np.empty((steps, HIDDEN, lanes), np.float32), np.empty_like(h)
    rec, g, inputs = [np.empty(shape, np.float32) for shape in ((3 * HIDDEN, lanes), (3 * HIDDEN, lanes), (lanes, EMBED + 1))]
    zr, z, r, rec_n = rec[:2 * HIDDEN], rec[:HIDDEN], rec[HIDDEN:2 * HIDDEN], rec[2 * HIDDEN:]
    of_zr, n = g[:2 * HIDDEN], g[2 * HIDDEN:]
    whole, x = keep.all(1).tolist(), x.astype(np.intp)
    with np.errstate(over="ignore"):  # infinity stands for a gate of 0
        for t in range(steps):
            if not whole[t]:
                h = np.multiply(h, keep[t], kept)
            np.take(embed, x[t], axis=0, out=inputs, mode="clip")
            np.matmul(wx, inputs.T, g)
            np.matmul(wh, h, rec)
            new = out[t]
            zr -= of_zr
            np.exp(zr, zr)
            zr += 1
            np.reciprocal(zr, zr)
            rec_n *= r
            n += rec_n
            np.tanh(n, n)
            np.subtract(h, n, new)
            new *= z
            new += n
            h = new
    return np.ascontiguousarray(out.transpose(0, 2, 1))


def _shifted(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Biases lowered so that no logit is above 0: states lie within -1 and 1."""
    return b - (b + np.abs(w).sum(-2)).max(-1, keepdims=True)


def _with_bias(p: dict[str, np.ndarray], w: str, b: str) -> np.ndarray:
    """Weights and, as one more row, the shifted biases."""
    return np.concatenate((p[w], _shifted(p[w], p[b])[..., None, :]), axis=-2)


def _segments(group: np.ndarray) -> list[tuple[slice, list[tuple[int, slice]]]]:
    """Ascending classes in blocks of ``ROWS``: the rows of each block, and the rows
    of each class in it, counted within the block."""
    edges = np.searchsorted(group, np.arange(SIDE + 1)).tolist()
    out, k = [], 0
    for a in range(0, len(group), ROWS):
        end, own = min(a + ROWS, len(group)), []
        while k < SIDE and edges[k] < end:
            if edges[k + 1] > max(a, edges[k]):
                own.append((k, slice(max(a, edges[k]) - a, min(end, edges[k + 1]) - a)))
            if edges[k + 1] > end:
                break
            k += 1
        out.append((slice(a, end), own))
    return out


_ONES = np.ones(SIDE, np.float32)


def _picked(logit: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log softmax of logits of at most 0, at one place a row."""
    own = logit[np.arange(len(at)), at]
    np.exp(logit, out=logit)
    return own - np.log(np.maximum(logit @ _ONES, 1e-37))


def log_probs(p: dict[str, np.ndarray], docs: list[np.ndarray], lanes: int = 512) -> np.ndarray:
    """Natural log probability of every whole document."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    dealt = Lanes(docs, lanes)
    embed = np.concatenate((p["embed"], np.ones((SIDE * SIDE, 1), np.float32)), axis=1)
    wx = np.concatenate((p["wx"], p["b"][None]))
    wc, ww = _with_bias(p, "wc", "bc"), _with_bias(p, "ww", "bw")
    h, logits = np.zeros((len(dealt.load), HIDDEN), np.float32), np.empty((ROWS, SIDE), np.float32)
    a = 0
    while a < dealt.steps:
        steps = max(WINDOW, WINDOW_WORDS // dealt.on(a))  # few lanes, long windows
        x, y, keep, doc = dealt.window(a, steps)
        a += steps
        states = _states(p["wh"], wx, embed, x, keep, h[:x.shape[1]])
        h = states[-1].copy()
        at = np.flatnonzero(doc >= 0)
        at = at[_by_class(y.ravel()[at])]
        word, of = y.ravel()[at], doc.ravel()[at]
        s = np.empty((len(at), HIDDEN + 1), np.float32)  # with a one for the bias
        s[:, :HIDDEN] = states.reshape(-1, HIDDEN)[at]
        s[:, HIDDEN] = 1
        group, within, lp = word // SIDE, word % SIDE, np.empty(len(at), np.float32)
        for rows, classes in _segments(group):
            own = s[rows]
            logit = np.matmul(own, wc, out=logits[:len(own)])
            lp[rows] = _picked(logit, group[rows])
            for k, part in classes:
                np.matmul(own[part], ww[k], out=logit[part])
            lp[rows] += _picked(logit, within[rows])
        total += np.bincount(of, lp, minlength=len(docs))
    return total


def _by_class(words: np.ndarray) -> np.ndarray:
    """An order by class, of equal ones as they come."""
    return np.argsort((words // SIDE).astype(np.uint8), kind="stable")  # small numbers are sorted by digit


def _is_near(w: np.ndarray) -> bool:
    """Whether a softmax of shifted logits is exact without taking off the largest
    of each row: that one is at most twice the reach of the weights below 0."""
    return bool(2 * np.abs(w).sum(-2).max() < 80)


def _softmax_minus(logit: np.ndarray, at: np.ndarray, n: int, near: bool) -> np.ndarray:
    """Gradient of the mean loss by the shifted logits, which it overwrites."""
    if not near:
        logit -= logit.max(1, keepdims=True)
    np.exp(logit, out=logit)
    total = logit @ np.ones(SIDE, logit.dtype)
    total *= n
    logit *= np.reciprocal(total, out=total)[:, None]
    logit[np.arange(len(at)), at] -= 1 / n
    return logit


def _views(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Arrays of the shapes of ``like`` that lie end to end in ``flat``."""
    ends = np.cumsum([v.size for v in like.values()])
    return {k: x.reshape(like[k].shape) for k, x in zip(like, np.split(flat, ends[:-1]), strict=True)}


def _gradients(p, x, y, keep, on, h, room):
    """Loss gradients over one window, and the state after it."""
    steps, lanes = x.shape
    words = steps * lanes
    g = _views(room.get("g", sum(v.size for v in p.values())), p)
    inputs = np.take(p["embed"], x.ravel(), axis=0, out=room.get("inputs", words, EMBED), mode="clip").reshape(steps, lanes, EMBED)
    gates = np.matmul(p["wx"].T, inputs.transpose(0, 2, 1), out=room.get("gates", steps, 3 * HIDDEN, lanes))
    gates += p["b"][:, None]
    states, saved = _run(p, gates.transpose(0, 2, 1), keep, h, room)
    last, n = states[-1].copy(), max(1, int(on.sum()))
    at = np.flatnonzero(on)
    at = at[_by_class(y.ravel()[at])]
    word = y.ravel()[at]
    s = room.get("s", len(at), HIDDEN + 1)  # with a one for the bias
    s[:, :HIDDEN] = states.reshape(-1, HIDDEN)[at]
    s[:, HIDDEN] = 1
    d_states = room.get("d_states", words, HIDDEN)
    d_states.fill(0)
    d_states[at] = _softmax_gradients(p, g, s, word // SIDE, word % SIDE, n, room)
    ahead = room.get("ahead", steps, HIDDEN, lanes)
    ahead[:] = d_states.reshape(steps, lanes, HIDDEN).transpose(0, 2, 1)
    d_in = _gate_gradients(p, g, inputs, ahead, keep, saved, room)
    cell = np.take(_CELLS, x.ravel(), axis=0, out=room.get("cell", words, EMBED, dtype=np.intp), mode="clip")
    g["embed"][:] = np.bincount(cell.ravel(), d_in.ravel(), p["embed"].size).reshape(p["embed"].shape)
    return g, last


_CELLS = np.arange(SIDE * SIDE * EMBED, dtype=np.intp).reshape(-1, EMBED)


def _softmax_gradients(p, g, s, group, within, n, room):
    """Gradients by the states of words in order of class; of the two softmaxes'
    parameters into ``g``."""
    wc, ww = _with_bias(p, "wc", "bc"), _with_bias(p, "ww", "bw")
    near_c, near_w = _is_near(p["wc"]), _is_near(p["ww"])
    d_wc, d_ww = room.get("d_wc", *wc.shape), room.get("d_ww", *ww.shape)
    d_wc.fill(0)
    d_ww.fill(0)
    of_wc = room.get("of_wc", *wc.shape)
    ds, logits, more = room.get("ds", len(s), HIDDEN), room.get("logits", ROWS, SIDE), room.get("more", ROWS, HIDDEN)
    for rows, classes in _segments(group):
        own, back = s[rows], ds[rows]
        d = np.matmul(own, wc, out=logits[:len(own)])
        _softmax_minus(d, group[rows], n, near_c)
        d_wc += np.matmul(own.T, d, of_wc)
        np.matmul(d, p["wc"].T, out=back)
        parts = [(k, own[part], d[part], more[part]) for k, part in classes]
        for k, one, logit, _ in parts:
            np.matmul(one, ww[k], logit)
        _softmax_minus(d, within[rows], n, near_w)
        for k, one, logit, by_word in parts:
            d_ww[k] += np.matmul(one.T, logit, of_wc)
            np.matmul(logit, p["ww"][k].T, by_word)
        back += more[:len(own)]
    g["wc"][:], g["bc"][:], g["ww"][:], g["bw"][:] = d_wc[:HIDDEN], d_wc[HIDDEN], d_ww[:, :HIDDEN], d_ww[:, HIDDEN]
    return ds


def _gate_gradients(p, g, inputs, ahead, keep, saved, room):
    """Gradients by the inputs, last step first; of the gates' parameters into ``g``.
    A step's gradients are used up while they are in cache."""
    before, zrn, n, whole = saved
    steps, _, lanes = n.shape
    # of n, z, r and the recurrent part of n: the first three are the gates', the last three the recurrent weights'
    d = room.get("d", 4 * HIDDEN, lanes)
    dn, dz, dr, d_rec_n = d.reshape(4, HIDDEN, lanes)
    d_gates, d_rec = d[:3 * HIDDEN], d[HIDDEN:]
    wx = np.ascontiguousarray(np.roll(p["wx"], HIDDEN, axis=1).T)  # n, z, r
    back, through, new = [room.get(k, HIDDEN, lanes) for k in ("back", "through", "new")]
    d_in, ones = room.get("d_in", steps, lanes, EMBED), np.ones(lanes, d.dtype)
    d_wx, d_wh, d_b = room.get("d_wx", 3 * HIDDEN, EMBED), room.get("d_wh", 3 * HIDDEN, HIDDEN), room.get("d_b", 3 * HIDDEN)
    of_wx, of_wh = room.get("of_wx", *d_wx.shape), room.get("of_wh", *d_wh.shape)
    for x in (back, d_wx, d_wh, d_b):
        x.fill(0)
    for t in range(steps - 1, -1, -1):
        (z, r, rec_n), m, b = zrn[t].reshape(3, HIDDEN, lanes), n[t], before[t]
        back += ahead[t]
        np.multiply(back, z, through)
        np.subtract(back, through, new)
        np.multiply(m, m, dn)
        np.subtract(1, dn, dn)
        dn *= new
        np.subtract(b, m, dz)
        dz *= z
        dz *= new
        np.multiply(dn, r, d_rec_n)
        np.subtract(1, r, dr)
        dr *= rec_n
        dr *= d_rec_n
        np.matmul(p["wh"], d_rec, back)
        back += through
        if not whole[t]:
            back *= keep[t]
        d_wh += np.matmul(d_rec, b.T, of_wh)
        d_wx += np.matmul(d_gates, inputs[t], of_wx)
        d_b += d_gates @ ones
        np.matmul(d_gates.T, wx, d_in[t])
    g["wh"][:], g["wx"][:], g["b"][:] = d_wh.T, np.roll(d_wx, -HIDDEN, axis=0).T, np.roll(d_b, -HIDDEN)
    return d_in


def _dealt(docs: list[np.ndarray], lanes: int) -> tuple[list[np.ndarray], int, list[int]]:
    parts, before = pieces(docs, max(WINDOW, -(-sum(map(len, docs)) // lanes)))
    return parts, lanes, before


def train(p: dict[str, np.ndarray], docs: list[np.ndarray], epochs: int, rate: float, lanes: int = 16,
          clip: float = 1.0) -> dict[str, np.ndarray]:
    """Adam over windows of ``WINDOW`` steps; the state runs on, its gradient
    does not. Documents longer than a lane's share are learned in pieces side
    by side, each from a state of zero after the word before it, so that no
    lane goes on alone. Deterministic."""
    flat = np.concatenate([v.ravel() for v in p.values()])
    p = _views(flat, p)
    if not docs:
        return p
    dealt, room = Lanes(*_dealt(docs, lanes)), Room()
    m, v, step = np.zeros_like(flat), np.zeros_like(flat), 0
    for _ in range(epochs):
        h = np.zeros((len(dealt.load), HIDDEN), np.float32)
        for a in range(0, dealt.steps, WINDOW):
            x, y, keep, doc = dealt.window(a, WINDOW)  # finished lanes leave the batch
            g, h = _gradients(p, x, y, keep, doc >= 0, h[:x.shape[1]], room)
            norm, step = float(np.sqrt(sum(float(np.vdot(q, q)) for q in g.values()))), step + 1
            _step(flat, room.get("g", flat.size), m, v, step, min(1.0, clip / (norm + 1e-8)), rate)
    return p


def _step(flat: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray, step: int, scale: float, rate: float) -> None:
    """One step of Adam along ``g`` times ``scale``; ``g`` is overwritten."""
    spread = (1 - 0.999**step) ** 0.5
    room = np.empty(BLOCK, flat.dtype)
    for a in range(0, flat.size, BLOCK):
        q, own_m, own_v = g[a:a + BLOCK], m[a:a + BLOCK], v[a:a + BLOCK]
        by = room[:len(q)]
        q *= scale
        np.subtract(q, own_m, by)
        by *= 0.1
        own_m += by
        q *= q
        q -= own_v
        q *= 0.001
        own_v += q
        np.sqrt(own_v, q)
        q += 1e-8 * spread
        np.divide(own_m, q, q)
        q *= rate * spread / (1 - 0.9**step)
        flat[a:a + BLOCK] -= q
