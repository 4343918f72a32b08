"""Personal data: exact base patterns, and a character BiLSTM with CRF transitions that adds spans."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, table
from .onnx_graph import lstm_session

#: The kinds of base spans, in the order in which spans are listed, and their patterns; the tagger knows one more kind.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Runs of digits joined by dots: an ip pattern's matches are four consecutive runs of one.
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
#: A training takes windows with and without one of these apart: a digit, an @, or a spelt-out dot in an address.
TRIGGER = re.compile(r"[0-9@]|[\[({ ](?:dot|DOT|Dot)[\])} ]")
#: Every base span holds one of these.
HOLDS = re.compile("[0-9@]")
#: Characters of a window and of the step to the next; windows of each sort that a training takes at most.
LENGTH, STEP, SAMPLE = 64, 32, 800
#: Texts are decoded in stretches of at most so many characters, SHARED of them shared with the next; stretches decoded together.
STRETCH, SHARED, TOGETHER = 512, 64, 512
#: Made spans of each kind in a training, made texts without one, and the share of windows that calibrate the threshold.
MADE, HARD, HELD_OUT = 500, 1500, 0.2
#: A decoded span counts from the least mean posterior at which so many of the held-out spans found are right.
PRECISION = 0.95
HIDDEN, EPOCHS, BATCH, RATE = 24, 10, 128, 0.01
TAGS = 1 + 2 * len(KINDS)  # outside; for each kind its first and its further characters
CHARS = 130  # 0: beyond the text, 1-128: ASCII, 129: all others


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _email_matches(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's matches, tried only from the start of a run of local characters before an @."""
    at, upto = text.find("@"), 0
    while at >= 0:
        start = at
        while start > upto and (c := text[start - 1]) < "\x80" and (c.isalnum() or c in "._%+-"):
            start -= 1
        m = PATTERNS["email"].match(text, start) if start < at else None
        if m:
            yield m.span()
            upto = m.end()
        at = text.find("@", max(at + 1, upto))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; places in code points, end exclusive."""
    if not text or not HOLDS.search(text):
        return []
    out = [("email", a, b) for a, b in _email_matches(text)] if "@" in text else []
    for m in DOTTED.finditer(text) if "." in text else ():
        at, runs = m.start(), m[0].split(".")
        for k in range(0, len(runs) - 3, 4):
            four = runs[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x := r.lstrip("0")) <= 3 and int(x or 0) <= 255 for r in four):
                out.append(("ip", at, end))
            at = end + 1
    for m in PATTERNS["card"].finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PATTERNS["phone"].finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def window_starts(text: str) -> list[int]:
    """Starts (multiples of STEP) of the windows that cover the whole text; two cover each character but at its ends."""
    return list(range(0, max(1, len(text) - STEP), STEP)) if text else []


def coded(windows: list[str], length: int = LENGTH) -> np.ndarray:
    out = np.zeros((len(windows), length), np.uint8)
    for k, w in enumerate(windows):
        codes = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), "<u4")
        out[k, : len(codes)] = np.minimum(codes, 128) + 1
    return out


def tags_of(spans: list[tuple[str, int, int]], start: int) -> np.ndarray:
    """Tags of the window from ``start``; where kinds overlap, the one listed first stays."""
    out = np.zeros(LENGTH, np.int8)
    for kind, a, b in reversed(spans):
        if a < start + LENGTH and b > start:
            t = 1 + 2 * KINDS.index(kind)
            out[max(0, a - start) : b - start] = t + 1
            if a >= start:
                out[a - start] = t
    return out


# numpy's tanh in single precision is vectorised, and takes a third of the time of a clipped rational approximation.
def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _lstm(w: dict, d: str, x: np.ndarray):
    """Hidden states (LENGTH, windows, HIDDEN) of one direction, and what its gradient needs."""
    n, length = x.shape
    kind = w["re" + d].dtype
    h, c = np.zeros((n, HIDDEN), kind), np.zeros((n, HIDDEN), kind)
    out, kept = np.empty((length, n, HIDDEN), kind), []
    for t in range(length) if d == "f" else range(length - 1, -1, -1):
        g = w["in" + d][x[:, t]] + h @ w["re" + d]
        s = _sigmoid(g[:, : 3 * HIDDEN])
        i, f, o, u = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
        before, c = c, f * c + i * u
        tc = np.tanh(c)
        kept.append((t, h, before, s, i, o, u, f, tc))
        h = o * tc
        out[t] = h
    return out, kept


def _lstm_gradient(w: dict, d: str, x: np.ndarray, dout: np.ndarray, kept, g: dict) -> None:
    n, kind = len(x), w["re" + d].dtype
    dh, dc = np.zeros((n, HIDDEN), kind), np.zeros((n, HIDDEN), kind)
    din, dre = np.zeros_like(w["in" + d]), np.zeros_like(w["re" + d])
    for t, h, before, s, i, o, u, f, tc in reversed(kept):
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        dg = np.concatenate([dc * u, dc * before, dh * tc, dc * i], axis=1)
        dg[:, : 3 * HIDDEN] *= s * (1 - s)
        dg[:, 3 * HIDDEN :] *= 1 - u * u
        np.add.at(din, x[:, t], dg)
        dre += h.T @ dg
        dh, dc = dg @ w["re" + d].T, dc * f
    g["in" + d], g["re" + d] = din, dre


def _emissions(w: dict, x: np.ndarray):
    hf, kf = _lstm(w, "f", x)
    hb, kb = _lstm(w, "b", x)
    both = np.concatenate([hf, hb], axis=2)
    return both @ w["out"] + w["bias"], both, kf, kb


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _marginals(w: dict, e: np.ndarray, moves: bool = True):
    """log Z, tag posteriors and summed transition posteriors (if asked for), by forward and backward sums."""
    a, b = np.empty_like(e), np.zeros_like(e)
    a[0] = e[0] + w["first"]
    for t in range(1, len(e)):
        a[t] = e[t] + _lse(a[t - 1][:, :, None] + w["next"], 1)
    for t in range(len(e) - 2, -1, -1):
        b[t] = _lse(w["next"][None] + (e[t + 1] + b[t + 1])[:, None, :], 2)
    z = _lse(a[-1], 1)
    post = np.exp(a + b - z[None, :, None])
    step = sum(np.exp(a[t - 1][:, :, None] + w["next"] + (e[t] + b[t])[:, None, :] - z[:, None, None]).sum(axis=0) for t in range(1, len(e))) if moves else None
    return z, post, step


def _starting(starts: np.ndarray | None) -> dict[int, np.ndarray]:
    """The rows that start at each position but the first."""
    return {} if starts is None else {int(t): np.flatnonzero(starts == t) for t in np.unique(starts) if t}


def _posteriors(w: dict, e: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Tag posteriors as ``_marginals`` has them, by sums of scaled exponentials, which take products only; in double precision.

    Rows start at ``starts`` (None: at 0); what is before means nothing.
    """
    e, begin = e.astype(np.float64), _starting(starts)
    first, step = w["first"].astype(np.float64), w["next"].astype(np.float64)
    first, step, one = np.exp(first - first.max()), np.exp(step - step.max()), np.exp(e - e.max(axis=2, keepdims=True))
    a, b = one.copy(), np.ones_like(one)
    a[0] *= first
    with np.errstate(all="ignore"):
        for t in range(1, len(e)):
            a[t] *= (a[t - 1] / a[t - 1].sum(axis=1, keepdims=True)) @ step
            if t in begin:
                a[t, begin[t]] = one[t, begin[t]] * first
        for t in range(len(e) - 2, -1, -1):
            later = one[t + 1] * b[t + 1]
            b[t] = (later / later.sum(axis=1, keepdims=True)) @ step.T
        post = a * b
        post /= post.sum(axis=2, keepdims=True)
    for j in np.flatnonzero(~np.isfinite(post).all(axis=(0, 2))):  # scores too far apart for exponentials
        s = 0 if starts is None else starts[j]
        post[s:, j] = _marginals(w, e[s:, j : j + 1], False)[1][:, 0]
    return post


def _viterbi(w: dict, e: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """The best path of each row from its start (None: 0) on; what is before means nothing."""
    length, n, tags = e.shape
    begin = _starting(starts)
    best, back = e[0] + w["first"], np.zeros((length, n, tags), np.int8)
    for t in range(1, length):
        s = best[:, :, None] + w["next"]
        back[t] = s.argmax(axis=1)
        best = s.max(axis=1) + e[t]
        if t in begin:
            best[begin[t]] = e[t, begin[t]] + w["first"]
    out = np.zeros((n, length), np.int8)
    out[:, -1] = best.argmax(axis=1)
    for t in range(length - 1, 0, -1):
        out[:, t - 1] = back[t][np.arange(n), out[:, t]]
    return out


def _gradients(w: dict, xs: np.ndarray, ys: np.ndarray) -> tuple[float, dict]:
    """Mean negative log likelihood of the tags ``ys`` (position, window), and its gradient."""
    e, both, kf, kb = _emissions(w, xs)
    z, post, moves = _marginals(w, e)
    n, cols = len(xs), np.arange(len(xs))
    right = w["first"][ys[0]] + sum(e[t, cols, ys[t]] for t in range(len(e))) + sum(w["next"][ys[t - 1], ys[t]] for t in range(1, len(e)))
    de = post.copy()
    for t in range(len(e)):
        de[t, cols, ys[t]] -= 1
    de /= n
    g = {"bias": de.sum(axis=(0, 1)), "out": np.tensordot(both, de, ([0, 1], [0, 1])), "first": post[0].sum(axis=0) / n, "next": moves / n}
    np.add.at(g["first"], ys[0], -1 / n)
    np.add.at(g["next"], (ys[:-1].ravel(), ys[1:].ravel()), -1 / n)
    dh = de @ w["out"].T
    _lstm_gradient(w, "f", xs, dh[:, :, :HIDDEN], kf, g)
    _lstm_gradient(w, "b", xs, dh[:, :, HIDDEN:], kb, g)
    return float((z - right).mean()), g


def weights(rng: np.random.Generator) -> dict:
    w = {"out": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), "bias": np.zeros(TAGS), "first": np.zeros(TAGS), "next": np.zeros((TAGS, TAGS))}
    for d in "fb":
        w["in" + d] = rng.normal(0, 0.3, (CHARS, 4 * HIDDEN))
        w["in" + d][:, HIDDEN : 2 * HIDDEN] += 1
        w["re" + d] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
    return {k: v.astype(np.float32) for k, v in w.items()}


def train(x: np.ndarray, y: np.ndarray, seed: int = 11) -> dict | None:
    """Weights from windows (codes) and their tags, and ``sure`` from those held out; None without windows.

    ``sure`` is the least mean posterior of a span from which on PRECISION of the
    spans found in the held-out windows are exactly right.
    """
    if not len(x):
        return None
    rng = np.random.default_rng(seed)
    w, m, v, step = weights(rng), {}, {}, 0
    mixed = rng.permutation(len(x))
    held, used = mixed[: int(HELD_OUT * len(x))], mixed[int(HELD_OUT * len(x)) :]
    rounds = EPOCHS * max(1, min(4, 12 * BATCH // len(used)))
    for k in range(rounds):
        order = rng.permutation(used)
        rate = RATE * (1 - 0.8 * k / rounds)
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            _, g = _gradients(w, x[part], y[part].T.astype(np.int64))
            size = np.sqrt(sum(float((d**2).sum()) for d in g.values()))
            step += 1
            for name, d in g.items():
                d = d * min(1.0, 5 / (size + 1e-9))
                m[name] = 0.9 * m.get(name, 0) + 0.1 * d
                v[name] = 0.999 * v.get(name, 0) + 0.001 * d * d
                w[name] = (w[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    found = []
    if len(held):
        tags, p = tag(w, x[held])
        for row, gold, q in zip(tags, y[held], p, strict=True):
            right = {s[:3] for s in reconcile([0], gold[None], np.ones((1, LENGTH)), LENGTH)}
            # a span that the window cuts may go on outside
            found += [(s[3], s[:3] in right) for s in reconcile([0], row[None], q[None], LENGTH) if s[1] > 0 and s[2] < LENGTH]
    found.sort(reverse=True)
    good = np.cumsum([ok for _, ok in found]) / np.arange(1, len(found) + 1)
    enough = np.flatnonzero(good >= PRECISION)
    return w | {"sure": max(0.5, found[enough[-1]][0]) if len(enough) else 0.99}


def _scores_by_graph(w: dict, codes: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Scores (position, direction, tag, row) of the characters ``codes`` (direction, position, row), each direction in its own order."""
    _, length, n = codes.shape
    session, scores = lstm_session(HIDDEN, TAGS), np.empty((length, 2, TAGS, n), np.float32)
    ends = [0, *(np.flatnonzero(np.diff(active)) + 1).tolist(), length]  # rows end here
    for k, d in enumerate("fb"):
        held = {"in": w["in" + d], "re": w["re" + d], "out": w["out"][k * HIDDEN : (k + 1) * HIDDEN], "bias": np.zeros((TAGS, 1), np.float32)}
        h, c = np.zeros((2, n, HIDDEN), np.float32)
        for a, b in zip(ends, ends[1:], strict=False):
            m = active[a]
            e, h, c = session.run(["scores", "h1", "c1"], held | {"h0": h[:m], "c0": c[:m], "x": np.ascontiguousarray(codes[k, a:b, :m])})
            scores[a:b, k, :, :m] = e
    return scores


def _scores_by_numpy(w: dict, codes: np.ndarray, active: np.ndarray) -> np.ndarray:
    """As ``_scores_by_graph``; both directions take each step together, and the characters of the second have tables of their own."""
    _, length, n = codes.shape
    codes = (codes + np.array([0, CHARS])[:, None, None]).transpose(1, 0, 2)
    # numpy's exp takes half the time of its tanh: a gate is 1 / (1 + exp(-x)), and divides instead of multiplying; tanh(x)
    # is 1 - 2 / (1 + exp(2 x)). The weights carry the factors, and 2 c is carried on instead of c. Beyond the range of exp
    # its infinity gives the limits of both
    factor = np.array([-1, -1, -1, 2], np.float32)[:, None, None]
    parts = [[w[k + d].reshape(-1, 4, HIDDEN).transpose(1, 0, 2) * factor for d in "fb"] for k in ("in", "re")]
    table, re_ = np.concatenate(parts[0], axis=1), np.stack(parts[1], axis=1)
    emit = np.ascontiguousarray(w["out"].reshape(2, HIDDEN, TAGS).transpose(0, 2, 1))
    scores = np.empty((length, 2, TAGS, n), np.float32)
    h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
    m = -1
    with np.errstate(over="ignore"):
        for t in range(length):
            if m != active[t]:  # rows end here
                m = active[t]
                h, c = h[:, :m].copy(), c[:, :m].copy()
                i, f, o, u, y = np.empty((5, 2, m, HIDDEN), np.float32)
            at = codes[t, :, :m]
            for gate, g in enumerate((i, f, o, u)):
                np.matmul(h, re_[gate], out=g)
                table[gate].take(at, 0, y, "clip")
                g += y
                np.exp(g, out=g)
                g += 1
            np.divide(-4, u, out=u)
            u += 2
            u /= i
            c /= f
            c += u
            np.exp(c, out=h)
            h += 1
            np.divide(-2, h, out=h)
            h += 1
            h /= o
            scores[t, :, :, :m] = emit @ h.transpose(0, 2, 1)
    return scores


def _scores(w: dict, x: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Emissions (position, tag, row) as ``_emissions`` has them, without what a gradient needs.

    Rows are sorted by length, longest first, and ``active`` tells how many reach
    each position; scores beyond a row's length mean nothing. onnxruntime takes the
    steps, or numpy where it is not installed.
    """
    n, length = x.shape
    sizes = (active[:, None] > np.arange(n)).sum(axis=0)
    ends = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), n]
    same = [(slice(a, b), int(sizes[a])) for a, b in zip(ends, ends[1:], strict=False) if sizes[a]]
    # the second direction goes from each row's own end on
    codes = np.zeros((2, length, n), np.int32)
    codes[0] = x.T
    for rows, size in same:
        codes[1, :size, rows] = x[rows, size - 1 :: -1].T
    scores = (_scores_by_graph if lstm_session(HIDDEN, TAGS) else _scores_by_numpy)(w, codes, active)
    out = scores[:, 0]
    for rows, size in same:  # what lies beyond a row's length was never set
        out[:size, :, rows] += scores[size - 1 :: -1, 1, :, rows]
        out[:size, :, rows] += w["bias"][:, None]
    return out


def _doubtful(w: dict, e: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Rows of the scores whose best path may leave the tag "outside"; of all others it does not, whatever they hold.

    A path's gain over staying outside is the sum of its parts with other tags, and
    no part from a to b gains more than its positions' best scores over "outside",
    the best inner steps between them, and the best steps in and out.
    """
    step, first = w["next"] - w["next"][0, 0], w["first"] - w["first"][0]
    inner = step[1:, 1:].max()
    ends = max(step[0, 1:].max(), first[1:].max()) + max(step[1:, 0].max(), 0) - inner
    now, best = np.full(e.shape[2], -np.inf, np.float32), np.full(e.shape[2], -np.inf, np.float32)
    with np.errstate(all="ignore"):  # what lies beyond a row's length may be anything
        gains = e[:, 1:].max(axis=1) + (inner - e[:, 0])
    for gain, m in zip(gains, active, strict=True):
        now[:m] = np.maximum(now[:m], 0) + gain[:m]
        np.maximum(best[:m], now[:m], out=best[:m])
    return np.flatnonzero(best + ends > -0.01)  # for rounding


def tag(w: dict, x: np.ndarray, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Viterbi tags of every row and their posteriors; posteriors are only taken where a row has a span."""
    lengths = np.full(len(x), x.shape[1]) if lengths is None else np.asarray(lengths)
    tags, sure = np.zeros(x.shape, np.int8), np.ones(x.shape, np.float32)
    order = np.argsort(-lengths, kind="stable")
    doubtful = []  # rows and their scores, of all that are scored together

    def decode() -> None:
        # all rows end at the last position, and start where their lengths tell
        rows, own = np.array([row for row, _ in doubtful]), np.array([len(e) for _, e in doubtful])
        size = int(own.max())
        starts = size - own
        scores = np.zeros((size, len(rows), TAGS), np.float32)
        for j, ((_, e), s) in enumerate(zip(doubtful, starts, strict=True)):
            scores[s:, j] = e
        doubtful.clear()
        best = _viterbi(w, scores, starts)
        for row, s, path in zip(rows, starts, best, strict=True):
            tags[row, : size - s] = path[s:]
        spans = np.flatnonzero([path[s:].any() for path, s in zip(best, starts, strict=True)])
        if len(spans):
            # sums over a stretch in single precision would move its posteriors by several per cent
            post = _posteriors(w, scores[:, spans], starts[spans])
            chosen = np.take_along_axis(post, best[spans].T[:, :, None].astype(np.int64), 2)[:, :, 0].T
            for row, s, p in zip(rows[spans], starts[spans], chosen, strict=True):
                sure[row, : size - s] = p[s:]

    for rows in np.array_split(order, max(1, round(len(x) / TOGETHER))) if len(x) else ():
        own = lengths[rows]
        active = (own[None] > np.arange(own[0])[:, None]).sum(axis=1)
        e = _scores(w, x[rows, : own[0]], active)
        for j in _doubtful(w, e, active):
            doubtful.append((rows[j], e[: own[j], :, j].copy()))
            if len(doubtful) == 256:
                decode()
    if doubtful:
        decode()
    return tags, sure


def _joined(at: np.ndarray, tagged: np.ndarray, p: np.ndarray) -> list[tuple[str, int, int, float]]:
    """Spans of the places ``at``, ascending, with their tags (none is outside) and posteriors."""
    out = []
    for j, (place, t) in enumerate(zip(at.tolist(), tagged.tolist(), strict=True)):
        kind, begins = (t - 1) // 2, t % 2 == 1
        if out and out[-1][2] == place and out[-1][0] == kind and not begins:
            out[-1][2], out[-1][4] = place + 1, j + 1
        else:
            out.append([kind, place, place + 1, j, j + 1])
    return [(KINDS[k], a, b, float(p[i:j].mean())) for k, a, b, i, j in out]


def reconcile(starts: list[int], tags: np.ndarray, sure: np.ndarray, size: int) -> list[tuple[str, int, int, float]]:
    """Spans of one text from its overlapping windows: each character has the tag of the window in whose middle it is most."""
    middle = -np.abs(2 * np.arange(LENGTH) - LENGTH + 1)
    first = starts[0]
    upto = min(size, starts[-1] + LENGTH)
    best, tagged, p = np.full(upto - first, -2 * LENGTH), np.zeros(upto - first, np.int64), np.zeros(upto - first)
    for s, row, q in zip(starts, tags, sure, strict=True):
        n = min(LENGTH, size - s)
        part = slice(s - first, s - first + n)
        better = middle[:n] > best[part]
        best[part][better], tagged[part][better], p[part][better] = middle[:n][better], row[:n][better], q[:n][better]
    at = np.flatnonzero(tagged)
    return _joined(at + first, tagged[at], p[at])


def decoded(texts: list[str], model: dict) -> list[list[tuple[str, int, int, float]]]:
    """The tagger's spans of each whole text, with their mean posteriors.

    A text is decoded in stretches, and each character has the tag of the stretch in
    which it is farther from an end that goes on. A stretch is filled up to a multiple
    of LENGTH as windows are, so that no result depends on the texts decoded beside it.
    """
    found = [[] for _ in texts]
    jobs = []

    def run() -> None:
        x, lengths = np.zeros((len(jobs), STRETCH), np.uint8), []
        for row, (_, _, codes, _) in zip(x, jobs, strict=True):
            row[: len(codes)] = codes
            lengths.append(-(-len(codes) // LENGTH) * LENGTH)
        tags, p = tag(model, x, np.array(lengths))
        for j in np.flatnonzero(tags.any(axis=1)):
            k, s, codes, last = jobs[j]
            at = np.flatnonzero(tags[j])
            at = at[(at >= (SHARED // 2 if s else 0)) & (at < (len(codes) if last else STRETCH - SHARED // 2))]
            found[k].append((s + at, tags[j][at], p[j][at]))
        jobs.clear()

    for k, t in enumerate(texts):
        codes = coded([t], len(t))[0]
        for s in range(0, max(1, len(t) - SHARED), STRETCH - SHARED) if t else ():
            jobs.append((k, s, codes[s : s + STRETCH], s + STRETCH >= len(t)))
            if len(jobs) == MOST:
                run()
    if jobs:
        run()
    # a text's stretches are cut in order, and tag() gives rows back in their order
    return [_joined(*map(np.concatenate, zip(*parts, strict=True))) if parts else [] for parts in found]


# Made spans: forms of each kind that no base pattern fits, and texts that look alike but are none.
_HOSTS, _ENDS = ("mail", "post", "web", "example", "inbox", "box", "host", "office"), ("com", "org", "net", "de", "fr", "es", "io", "example")
_NAMES = ("token", "api_key", "api key", "secret", "password", "passwd", "access_token", "auth", "apikey", "client_secret")


def _word(r: random.Random, least: int = 2, most: int = 8) -> str:
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(least, most)))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def made_span(kind: str, r: random.Random) -> tuple[str, str, str]:
    """(before, span, after) of a made span."""
    if kind == "email":
        user = _word(r) + r.choice(("", "." + _word(r), "." + _digits(r, 2), _digits(r, 2)))
        host, end = r.choice((*_HOSTS, _word(r), r.choice(_HOSTS) + _digits(r, 1))), r.choice(_ENDS)
        at, dot = r.choice(((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "."), (" @ ", "."), ("@", " dot "), (" {at} ", " {dot} ")))
        return "", f"{user}{at}{host}{r.choice(('', dot + _word(r, 3, 6)))}{dot}{end}", ""
    if kind == "ip":
        sep = r.choice((" . ", "[.]", "(.)", "-", " dot ", ". "))
        return "", sep.join(str(r.randint(1, 255)) for _ in range(4)), ""
    if kind == "card":
        sep = r.choice((".", "/", "_", "  ", " - ", ""))
        body = [_digits(r, 4) for _ in range(4)]
        if not sep and luhn("".join(body)):
            body[3] = body[3][:3] + str((int(body[3][3]) + 1) % 10)
        return "", sep.join(body), ""
    if kind == "phone":
        a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
        return "", r.choice((f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{r.randint(1, 99)} {a} {b}{c}", f"00{r.randint(1, 99)}-{a}-{c}", f"0{a[:2]}/{b}{c}", f"1-{a}-{b}-{c}")), ""
    value = r.choice((lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40, 40)))), lambda: r.choice(("sk-", "AKIA", "ghp_", "key-", "")) + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(r.randint(18, 32)))))()
    quote = r.choice(('"', '"', "'", ""))
    return r.choice(_NAMES) + r.choice((" = ", "=", ": ", " ")) + quote, value, quote


def look_alike(r: random.Random) -> str:
    """A text with digits that is no personal data."""
    n = r.randint
    return r.choice((
        f"{n(1990, 2030)}-{n(1, 12):02}-{n(1, 28):02}", f"{n(1, 28)}.{n(1, 12)}.{n(1990, 2030)}", f"{n(1, 12)}/{n(1, 28)}/{n(1990, 2030)}", f"{n(0, 23)}:{n(0, 59):02}", f"{n(1, 999)},{n(0, 999):03}.{n(0, 99):02}",
        f"version {n(1, 20)}.{n(0, 30)}.{n(0, 30)}", f"v{n(1, 9)}.{n(0, 9)}", f"Version {n(1, 4)}.0", f"{n(1, 99)}.{_digits(r, n(1, 6))}", f"#{n(1, 10**6)}", f"{n(1, 400)}-{n(401, 900)}", str(n(1, 10 ** n(1, 9))),
        f'"{_word(r)} {_word(r)} {n(1, 99)}"', _word(r) + _digits(r, n(1, 4)), f"= {n(1, 10**5)}", f"{n(1, 99)}%", f"@{_word(r)}", f"{_word(r)} @ {_word(r)}", f"{_word(r)} dot {_word(r)}", f"{_digits(r, 3)} {_word(r)} {_digits(r, 3)}", f"({n(1, 99)})", f"token {_word(r)}", f"CC BY-NC {n(1, 4)}.0.",
    ))


def made_windows(plain: list[str], made: int = MADE, hard: int = HARD, seed: int = 5) -> tuple[list[str], list[np.ndarray]]:
    """Windows with made spans, and with look-alikes, set into plain ones."""
    r, chars, tags = random.Random(seed), [], []
    for kind in [k for k in KINDS for _ in range(made)] + [None] * hard if plain else []:
        context = r.choice(plain)
        cut = r.choice([m.start() for m in re.finditer(" ", context)] or [len(context)])
        before, span, after = made_span(kind, r) if kind else ("", look_alike(r), "")
        before, after = context[:cut] + " " + before, after + r.choice(("", "", ".", ",", "###", "!!")) + context[cut:]
        if r.random() < 0.15:
            before, span, after = before.upper(), span.upper(), after.upper()
        text = before + span + after
        at = max(0, min(len(before) - r.randint(4, LENGTH - 8), len(text) - LENGTH))
        chars.append(text[at : at + LENGTH])
        tags.append(tags_of([(kind, len(before), len(before) + len(span))] if kind else [], at))
    return chars, tags


def _listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (overlapping ones together) replaced by the kind that starts first."""
    out, upto = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= upto:
            out += [text[upto:a], f"[{kind.upper()}]"]
        upto = max(upto, b)
    return "".join([*out, text[upto:]])


def labelled_windows(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, made: int = MADE, hard: int = HARD) -> tuple[np.ndarray, np.ndarray]:
    """Windows and their tags: from the documents with the base spans as tags, and with made spans set into plain windows.

    Of the different windows of all texts, ``sample`` of each sort are taken, by hash:
    with a base span; with a trigger and without a span; without either. ``made`` spans
    of each kind and ``hard`` look-alikes are made. Null and empty texts have no windows.
    """

    def cut(batches: Iterator[pa.RecordBatch]):
        # the windows of least hash of each sort: no more of a partition can be among those of all
        least, bound = {1: {}, 2: {}, 3: {}}, dict.fromkeys((1, 2, 3), 1 << 32)

        def cut_down(sort: int) -> None:
            kept = sorted((h, w) for w, h in least[sort].items())[:sample]
            least[sort] = {w: h for h, w in kept}
            if len(kept) == sample:
                bound[sort] = kept[-1][0] if kept else -1

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                starts, spans = window_starts(text), base_spans(text)
                sorts = [3] * len(starts)
                spelt = "dot" in text or "DOT" in text or "Dot" in text
                for m in (TRIGGER if spelt else HOLDS).finditer(text):
                    k = m.start() // STEP
                    for j in (k - 1, k):
                        if 0 <= j < len(sorts):
                            sorts[j] = 2
                for _, a, b in spans:
                    for j in range(max(0, (a - LENGTH) // STEP + 1), min(len(sorts), (b - 1) // STEP + 1)):
                        sorts[j] = 1
                for s, sort in zip(starts, sorts, strict=True):
                    window = text[s : s + LENGTH]
                    h = zlib.crc32(window.encode("utf-8", "surrogatepass"))
                    # digits that pass for a span of the tagger's own kinds are no evidence against it
                    if h <= bound[sort] and (sort == 1 or not DOUBTFUL.search(window)):
                        least[sort][window, bytes(tags_of(spans, s)) if sort == 1 else OUTSIDE] = h
                        if len(least[sort]) > 4 * sample:
                            cut_down(sort)
        for sort in least:
            cut_down(sort)
        rows = [(w, t, sort, h) for sort in least for (w, t), h in least[sort].items()]
        if rows:
            yield None, None, dict(zip(("chars", "tags", "sort", "r"), map(list, zip(*rows, strict=True)), strict=True))

    found = map_arrow(docs.select(F.col(f"`{text_col}`").cast("string").alias("text")), [], "chars string, tags binary, sort int, r long", cut).distinct()
    place = F.row_number().over(Window.partitionBy("sort").orderBy("r", "chars", "tags"))
    taken = found.withColumn("place", place).filter(F.col("place") <= sample).collect()
    taken.sort(key=lambda r: (r["sort"], r["place"]))
    got = {k: [r for r in taken if r["sort"] == k] for k in (1, 2, 3)}
    chars = [r["chars"] for r in taken]
    tags = [np.frombuffer(r["tags"], np.int8) for r in taken]
    plain = [r["chars"] for r in got[3] or got[2] or got[1]]
    more, their = made_windows(plain, made, hard)
    return coded([*chars, *more]), np.array([*tags, *their], np.int8).reshape(-1, LENGTH)


#: The tags of a window without a span.
OUTSIDE = bytes(LENGTH)
#: Long digit or hexadecimal runs: windows with them and without a base span are left to the made examples.
DOUBTFUL = re.compile("[0-9][0-9 .-]{11}|[0-9A-Fa-f]{16}")


def spans_of(texts: list[str | None], model: dict | None, sure: float | None, base: list | None = None) -> list[list[tuple[str, int, int]]]:
    """All spans of each text: base spans first, then those the tagger adds; the stretches of many texts are decoded together."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts] if base is None else base
    out = [list(s) for s in base]
    if not model:
        return out
    sure = model["sure"] if sure is None else sure
    for own, spans in zip(out, decoded(texts, model), strict=True):
        for name, a, b, q in spans:
            if q >= sure and b - a >= 6 and all(b <= x or a >= y for _, x, y in own):
                own.append((name, a, b))
    return out


#: Stretches that are cut at once at most, so that a very long text does not fill the memory.
MOST = 4096


def find_pii(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", sure: float | None = None, with_text: bool = False) -> DataFrame:
    """Base spans by pattern in every whole text, and further spans by the trained tagger, in one narrow pass.

    Every character of every text is decoded, in stretches of at most STRETCH that
    share SHARED characters; those of a batch's texts are decoded together. A decoded
    span is added if it has 6 characters or more, meets no other span and is sure
    enough (None: as calibrated in training). Places are code points.
    Kinds are the base ones and ``secret``, which the tagger alone finds.

    Null and empty texts have no spans; repeated rows, ties and null ids each keep
    their row, and ids of any type go through unchanged. Patterns and windows are
    linear in a text, however long its runs of digits. Without a model (no windows to
    train on) base spans stand alone. An empty table gives no rows; other columns
    take no part.

    Returns ``id_col``, n_email, n_ip, n_card, n_phone (base spans), base_sha256,
    spans (all, listed), added (number) and, with ``with_text``, redacted: the text
    with its spans replaced (null where there is none).
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def find(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            out = []
            for t, s, every in zip(texts, base, spans_of(texts, held.value, sure, base), strict=True):
                count = [sum(x[0] == name for x in s) for name in BASE_KINDS]
                row = (*count, hashlib.sha256(_listed(s).encode()).hexdigest(), _listed(every), len(every) - len(s))
                out.append((*row, redacted(t, every) if every else None) if with_text else row)
            if out:
                yield batch, None, dict(zip(names, map(list, zip(*out, strict=True)), strict=True))

    names = [*[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans", "added"] + ["redacted"] * with_text
    ddl = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, added long" + ", redacted string" * with_text
    return map_arrow(rows, ["id"], ddl, find).withColumnRenamed("id", id_col)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return Scratch(spark, "pii").save(find_pii(docs, train(*labelled_windows(docs))), "found")  # written here, in small Arrow batches


QUERIES = {"op7_pii": op7_pii}


def redact(docs: DataFrame, model: dict | None, text_col: str = "text", sure: float | None = None, out_col: str = "_redacted") -> DataFrame:
    """(text, changed) as a struct column ``out_col`` beside the rows' own columns, in one narrow pass.

    The text has each span replaced by its kind in brackets; null stays null.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def change(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [redacted(t, s) if s else t for t, s in zip(texts, spans_of(texts, held.value, sure), strict=True)]
            yield batch, None, {out_col: [{"text": n, "changed": n is not t} for n, t in zip(new, texts, strict=True)]}

    return map_arrow(docs, docs.columns, f"`{out_col}` struct<text: string, changed: boolean>", change)
