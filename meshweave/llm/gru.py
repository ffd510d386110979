"""A gated recurrent language model in numpy, with a class-factored output.

Word w of class k has probability p(k | state) * p(w | k, state).  Classes hold
words of neighbouring frequency, few of the frequent ones and more of the rare ones: under
Zipf's law a class as large as the root of its words' ranks costs least.
Texts run side by side in lanes; a lane's state goes on from window to window
and starts afresh with a text, and gradients stop at a window's edge.  For learning, long texts
are cut into parts, each of which starts from the state that its text has there.
"""

from __future__ import annotations

import heapq

import numpy as np

WIDTH = 16
LANES, WINDOW = 512, 24
#: Lanes of scoring, which has no updates to keep frequent.
SCORING_LANES = 1024
#: Rows of one product with outputs, so that it stays in a core's cache.
AT_ONCE = 2048
#: Few words to learn from are put in fewer lanes, for about so many updates.
UPDATES, LEAST_LANES = 80, 16
RATE = 0.2
#: Gradients are means over a full window times this; with squares that start at 0.1, small ones take small steps.
SCALE = 16.0
#: Words of a part of a text.  Parts are learnt from in any order, so that lanes end together; each starts from the
#: state that the parameters before this learning give at its place in the text.
SEGMENT = 512
Parameters = dict[str, np.ndarray]


def classes(words: int) -> np.ndarray:
    """First word of each class, and the end of the last: class k of n begins at ``words * (k / n) ** 2``."""
    n = max(1, int(np.ceil(0.6 * np.sqrt(words))))
    return np.unique(np.round(words * (np.arange(n + 1) / n) ** 2).astype(np.int64))


def initial(counts: np.ndarray, seed: int = 11) -> Parameters:
    """Starts from the words' frequencies: without any state the output is their distribution."""
    begins = classes(len(counts))
    random = np.random.default_rng(seed)
    mass = np.maximum(counts, 0.1)
    total = np.add.reduceat(mass, begins[:-1])
    small = lambda *n: random.normal(0, 0.1, n).astype(np.float32)
    return {
        "embed": small(len(counts), WIDTH),
        "wx": small(WIDTH, 3 * WIDTH),
        "wh": small(WIDTH, 3 * WIDTH),
        "b": np.zeros(3 * WIDTH, np.float32),
        "wc": np.zeros((WIDTH, len(total)), np.float32),
        "bc": np.log(total / total.sum()).astype(np.float32),
        "ww": np.zeros((len(counts), WIDTH), np.float32),
        "bw": np.log(mass / np.repeat(total, np.diff(begins))).astype(np.float32),
    }


def flatten(p: Parameters) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflatten(flat: np.ndarray, like: Parameters) -> Parameters:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def lanes(lengths: np.ndarray, order: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lane and first step of each text, the next in ``order`` into the emptiest lane; longer lanes have smaller numbers."""
    width = max(1, min(width, len(lengths)))
    heap = [(0, i) for i in range(width)]
    lane, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order.tolist():
        used, j = heapq.heappop(heap)
        lane[i], at[i] = j, used
        heapq.heappush(heap, (used + int(lengths[i]), j))
    rank = np.empty(width, np.int64)
    rank[[j for _, j in sorted(heap, reverse=True)]] = np.arange(width)
    return rank[lane], at


def arrange(codes: np.ndarray, before: np.ndarray, lengths: np.ndarray, order: np.ndarray, width: int = LANES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(step, lane) arrays for parts of texts: target word (-1: none), word before it, whether the part goes on, and its number where it begins."""
    lane, at = lanes(lengths, order, width)
    of = np.repeat(np.arange(len(lengths)), lengths)
    step = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = (at[of] + step, lane[of])
    size = (int(place[0].max()) + 1, int(lane.max()) + 1)
    target, previous, text, goes_on = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.full(size, -1, np.int64), np.zeros(size, np.float32)
    target[place], previous[place], text[place], goes_on[place] = codes, before, np.where(step > 0, -1, of), step > 0
    return target, previous, goes_on, text


def laid_out(codes: np.ndarray, before: np.ndarray, lengths: np.ndarray, order: np.ndarray, width: int = LANES):
    """The arrays of ``arrange`` window by window, of lanes that have not ended; beyond a window, memory follows the words."""
    lane, at = lanes(lengths, order, width)
    texts = np.lexsort((at, lane))
    texts = texts[lengths[texts] > 0]
    n = lengths[texts]
    own = np.repeat(np.cumsum(lengths)[texts] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())
    text, first = np.repeat(texts, n), np.zeros(len(own), bool)
    first[np.cumsum(n) - n] = True
    target, before = codes[own], before[own]
    size = np.bincount(lane, lengths).astype(np.int64)
    begins = np.cumsum(size) - size
    for t in range(0, int(size.max()), WINDOW):
        live = int((size > t).sum())  # longer lanes have smaller numbers
        steps = np.arange(t, min(t + WINDOW, int(size[0])))[:, None]
        real = steps < size[:live]
        place = np.where(real, begins[:live] + steps, 0)
        yield np.where(real, target[place], -1), np.where(real, before[place], 0), (real & ~first[place]).astype(np.float32), np.where(real, text[place], 0)


def windows(target: np.ndarray):
    """Window by window: its steps, and the lanes that have not ended."""
    for t in range(0, len(target), WINDOW):
        yield slice(t, t + WINDOW), slice(0, int((target[t] >= 0).sum()))


def previous(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The word before each word; 0 before a text's first."""
    out = np.concatenate([[0], codes[:-1]])
    out[(np.cumsum(lengths) - lengths)[lengths > 0]] = 0
    return out


def segments(lengths: np.ndarray) -> np.ndarray:
    """Lengths of the parts of at most SEGMENT words that texts are cut into for learning."""
    parts = -(-lengths // SEGMENT)
    out = np.full(int(parts.sum()), SEGMENT)
    some = parts > 0
    out[np.cumsum(parts)[some] - 1] = (lengths - SEGMENT * (parts - 1))[some]
    return out


def _sigmoid_of_twice(x: np.ndarray) -> np.ndarray:
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def _gates(w: np.ndarray) -> np.ndarray:
    """The three gates' columns, each an array of its own: steps work on whole arrays."""
    return np.stack(np.split(w, 3, axis=1))


def _recur(p: Parameters, before: np.ndarray, goes_on: np.ndarray, state: np.ndarray, keep: bool, begins: np.ndarray | None = None, carried: np.ndarray | None = None):
    """States of all steps.  Where ``begins`` is not 0, a text goes on from that row of ``carried``."""
    by_word = before.size > len(p["embed"])
    embed = p["embed"] if by_word else p["embed"][before]
    half = np.array([0.5, 0.5, 1], embed.dtype)  # of what the sigmoids take
    gx = [(embed @ w + b) * c for w, b, c in zip(_gates(p["wx"]), np.split(p["b"], 3), half, strict=True)]
    gx = np.stack([np.take(x, before, axis=0) for x in gx] if by_word else gx)
    wh = _gates(p["wh"]) * half[:, None, None]
    out = np.empty((*before.shape, WIDTH), gx.dtype)
    kept = []
    for t in range(len(before)):
        h = state * goes_on[t][:, None]
        if begins is not None and begins[t].any():
            lane = np.flatnonzero(begins[t])
            h[lane] = carried[begins[t, lane]]
        g = h @ wh
        zr = g[:2]
        zr += gx[:2, t]
        z, r = _sigmoid_of_twice(zr)
        n = r * g[2]
        n += gx[2, t]
        np.tanh(n, out=n)
        state = h - n
        state *= z
        state += n
        out[t] = state
        if keep:
            kept.append((h, z, r, n, g[2]))
    return out, state, kept


def _softmax(h: np.ndarray, w: np.ndarray, b: np.ndarray, at: np.ndarray, learn: bool):
    """Log probability at ``at`` among outputs (output, WIDTH); with ``learn`` also gradients of its negative sum by h, w and b.

    Logits start at log frequencies and move by bounded steps; they are cut where a float32 would overflow.
    """
    x = h @ w.T
    x += b
    rows = np.arange(len(x))
    if (np.abs(w).sum(axis=1) + b).max() > 80:  # no component of a state is beyond 1
        np.minimum(x, 80, out=x)
    own = x[rows, at]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    log_p = own - np.log(total)
    if not learn:
        return log_p, None, None, None
    # the gradient is (x - total at the target) / total; the narrow sides of the products are divided
    x[rows, at] -= total
    part = 1 / total
    back = x @ w
    back *= part[:, None]
    return log_p, back, x.T @ (h * part[:, None]), part @ x


def _predict(p: Parameters, states: np.ndarray, target: np.ndarray, learn: bool):
    """Natural log probability of each target; with ``learn`` also gradients of its negative sum."""
    begins = classes(len(p["bw"]))
    kind = np.repeat(np.arange(len(begins) - 1, dtype=np.uint16 if len(begins) <= 2**16 else np.int64), np.diff(begins))[target]
    order = np.argsort(kind, kind="stable")
    h, kind = states[order], kind[order].astype(np.int64)
    member = target[order] - begins[kind]
    log_p, dh = np.empty(len(h), h.dtype), np.empty_like(h)
    grads: Parameters = {k: np.zeros_like(p[k]) for k in ("wc", "bc", "ww", "bw")} if learn else {}
    wc = np.ascontiguousarray(p["wc"].T)
    for first in range(0, len(h), AT_ONCE):
        own = slice(first, first + AT_ONCE)
        log_p[own], dh[own], w, b = _softmax(h[own], wc, p["bc"], kind[own], learn) if learn else (_softmax(h[own], wc, p["bc"], kind[own], False)[0], 0, None, None)
        if learn:
            grads["wc"] += w.T
            grads["bc"] += b
    cuts = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(kind) else np.zeros(0, int)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(kind)], strict=True):
        words = slice(begins[kind[a]], begins[kind[a] + 1])
        if words.stop - words.start == 1:  # the class says it all
            continue
        for first in range(a, b, AT_ONCE):
            own = slice(first, min(b, first + AT_ONCE))
            own_p, back, w, bias = _softmax(h[own], p["ww"][words], p["bw"][words], member[own], learn)
            log_p[own] += own_p
            if learn:
                dh[own] += back
                grads["ww"][words] += w
                grads["bw"][words] += bias
    out = np.empty_like(log_p)
    out[order] = log_p
    if not learn:
        return out, None, None
    back = np.empty_like(dh)
    back[order] = dh
    return out, back, grads


def score(p: Parameters, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log probability of each whole text; ``codes`` has the texts one after another."""
    total = np.zeros(len(lengths))
    if not len(codes):
        return total
    state, held, size = None, [], 0

    def predict() -> None:
        states, target, text = (np.concatenate(x) for x in zip(*held, strict=True))
        log_p, _, _ = _predict(p, states, target, False)
        np.add(total, np.bincount(text, log_p.astype(np.float64), minlength=len(total)), out=total)
        held.clear()

    for target, before, goes_on, text in laid_out(codes, previous(codes, lengths), lengths, np.argsort(-lengths, kind="stable"), SCORING_LANES):
        state = np.zeros((target.shape[1], WIDTH), np.float32) if state is None else state[: target.shape[1]]
        states, state, _ = _recur(p, before, goes_on, state, False)
        real = target >= 0
        held.append((states[real], target[real], text[real]))
        size += len(held[-1][1])
        if size >= LANES * WINDOW:
            predict()
            size = 0
    if held:
        predict()
    return total


def states_between(p: Parameters, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """State before each part but the first of every text, text by text; a first row of zeros."""
    more = np.maximum(-(-lengths // SEGMENT) - 1, 0)
    out = np.zeros((1 + int(more.sum()), WIDTH), np.float32)
    row = 1 + np.cumsum(more) - more
    words, begin = previous(codes, lengths), np.cumsum(lengths) - lengths
    long = np.argsort(-more, kind="stable")[: int((more > 0).sum())]
    for first in range(0, len(long), LANES):
        own = long[first : first + LANES]
        state = np.zeros((len(own), WIDTH), np.float32)
        for part in range(int(more[own[0]])):
            own = own[more[own] > part]
            state = state[: len(own)]
            for t in range(part * SEGMENT, (part + 1) * SEGMENT, 64):
                goes_on = np.ones((64, len(own)), np.float32)
                goes_on[0] = t > 0
                _, state, _ = _recur(p, words[begin[own] + np.arange(t, t + 64)[:, None]], goes_on, state, False)
            out[row[own] + part] = state
    return out


class Learner:
    """Truncated backpropagation through time with adaptive steps (Adagrad)."""

    def __init__(self, p: Parameters):
        self.p = {k: v.copy() for k, v in p.items()}
        self.squares = {k: np.full_like(v, 0.1) for k, v in p.items()}
        self.words = 0

    def gradients(self, target, before, goes_on, state, begins=None, carried=None):
        p = self.p
        states, last, kept = _recur(p, before, goes_on, state, True, begins, carried)
        real = target >= 0
        log_p, back, grads = _predict(p, states[real], target[real], True)
        dout = np.zeros_like(states)
        dout[real] = back
        carry = np.zeros_like(state)
        dgx, dgn, hs = np.empty((3, *before.shape, WIDTH), states.dtype), np.empty_like(states), np.empty_like(states)
        back_h = np.ascontiguousarray(_gates(p["wh"]).transpose(0, 2, 1))
        for t in range(len(target) - 1, -1, -1):
            h, z, r, n, gn = kept[t]
            dh = dout[t]
            dh += carry
            through = dh * z
            dh -= through
            dn = dgx[2, t]
            np.multiply(dh, 1 - n * n, out=dn)
            np.multiply(through - through * z, h - n, out=dgx[0, t])
            np.multiply(dn, r, out=dgn[t])
            np.multiply(dgn[t] * gn, 1 - r, out=dgx[1, t])
            through += dgx[0, t] @ back_h[0]
            through += dgx[1, t] @ back_h[1]
            through += dgn[t] @ back_h[2]
            carry = through * goes_on[t][:, None]
            hs[t] = h
        flat = hs.reshape(-1, WIDTH).T
        grads["wh"] = np.concatenate([flat @ d.reshape(-1, WIDTH) for d in (dgx[0], dgx[1], dgn)], axis=1)
        # summed by word first: a window has far fewer words than tokens
        order = np.argsort(before.ravel().astype(np.uint16) if len(p["embed"]) <= 2**16 else before.ravel(), kind="stable")
        ordered = before.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        words = ordered[first]
        by_word = np.concatenate([np.add.reduceat(d.reshape(-1, WIDTH)[order], first, axis=0) for d in dgx], axis=1)
        grads["b"] = by_word.sum(0)
        grads["wx"] = p["embed"][words].T @ by_word
        grads["embed"] = (words, by_word @ p["wx"].T)
        return grads, last, int(real.sum()), float(log_p.sum())

    def learn(self, codes: np.ndarray, lengths: np.ndarray, rate: float = RATE) -> None:
        if not len(codes):
            return
        parts = segments(lengths)
        order = np.random.default_rng(len(codes)).permutation(len(parts))
        width = int(np.clip(len(codes) // (WINDOW * UPDATES), LEAST_LANES, LANES))
        target, before, goes_on, part = arrange(codes, previous(codes, lengths), parts, order, width)
        carried = states_between(self.p, codes, lengths)
        later = np.ones(len(parts), bool)  # parts that do not begin their text
        number = -(-lengths // SEGMENT)
        later[(np.cumsum(number) - number)[number > 0]] = False
        begins = np.where(part >= 0, (np.cumsum(later) * later)[part], 0)
        state = np.zeros((target.shape[1], WIDTH), np.float32)
        for step, lane in windows(target):
            grads, state, n, _ = self.gradients(target[step, lane], before[step, lane], goes_on[step, lane], state[lane], begins[step, lane], carried)
            self.words += n
            for k, g in grads.items():
                at = slice(None)
                if k == "embed":
                    at, g = g
                g = g * np.float32(SCALE / (width * WINDOW))
                self.squares[k][at] += g * g
                self.p[k][at] -= rate * g / np.sqrt(self.squares[k][at])
