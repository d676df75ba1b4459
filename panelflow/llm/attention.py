"""A small causal self-attention model over subword ids, in numpy.

One head attends over a window of ids; a hidden layer takes the id at hand and what was attended
to, and predicts the class of the next id.  The class's share of the id is a count.  Windows of one
length overlap: each position is scored once, in the window where it has at least ``overlap``
earlier positions, or all there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

WINDOW, OVERLAP = 32, 8
WIDTH, HIDDEN = 16, 32
LIMIT = 1e26  # sums up to it stay far from overflow
BATCH = 128  # windows scored at once
BLOCK = 96  # rows of a product's factor

Params = dict[str, np.ndarray]


def fresh(ids: int, classes: int, seed: int = 7) -> Params:
    """Parameters before training; ``ids`` counts rows of the embedding."""
    draw = np.random.default_rng(seed)
    normal = lambda scale, *shape: (draw.standard_normal(shape) * scale).astype(np.float32)
    return {
        "embed": normal(0.5, ids, WIDTH),
        "place": normal(0.1, WINDOW, WIDTH),
        "mix": normal(WIDTH**-0.5, WIDTH, 3 * WIDTH + HIDDEN),
        "back": normal(WIDTH**-0.5, WIDTH, HIDDEN),
        "lift": np.zeros(HIDDEN, np.float32),
        "out": normal(HIDDEN**-0.5, HIDDEN + 1, classes),  # the last row is a class's own share
    }


def starts_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first position and first scored position of the windows of texts of these lengths."""
    step = WINDOW - OVERLAP
    counts = 1 + np.maximum(0, -(-(lengths - WINDOW) // step))
    text = np.repeat(np.arange(len(lengths)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.minimum(number * step, np.maximum(0, lengths[text] - WINDOW))
    scored = np.where(number == 0, 0, (number - 1) * step + WINDOW)
    return text, first, scored


_SEEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))
_ONES = np.ones((WINDOW, 1), np.float32)
_SCALE = np.float32(WIDTH**-0.5)
_ASKED = 3 * WIDTH  # columns of queries, keys and values in ``mix``; the own parts follow


class Room:
    """Arrays that batch after batch is worked out in: fresh memory costs more than the work does."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}
        self.shaped: dict[str, dict[tuple[int, ...], np.ndarray]] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        shaped = self.shaped.setdefault(name, {})
        if shape not in shaped:
            size = math.prod(shape)
            if name not in self.held or self.held[name].size < size:
                self.held[name] = np.empty(size, np.float32)
                shaped.clear()
            shaped[shape] = self.held[name][:size].reshape(shape)
        return shaped[shape]


@lru_cache(maxsize=1024)
def _together(rows: int, windows: int) -> int:
    return next(k for k in (4, 2, 1) if windows % k == 0 and (k == 1 or k * rows <= BLOCK))


def _blocks(x: np.ndarray, windows: int) -> np.ndarray:
    """Rows in blocks of a few windows: BLAS multiplies small matrices without copying them first."""
    rows = len(x) // max(1, windows)
    many = _together(rows, windows)
    return x.reshape(windows // many, many * rows, x.shape[1])


def _exps(left: np.ndarray, right: np.ndarray, out: np.ndarray, ones: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
    """exp of a product, in ``out``, and the sums of its rows, of the parts ``seen`` alone if given.

    If a sum comes near overflow, or to nothing, rows are moved to a largest value of 0 first, which no share notices.
    """
    for moved in (False, True):
        np.matmul(left, right, out=out)
        if moved:
            if seen is not None:
                np.copyto(out, -np.inf, where=seen == 0)
            out -= out.max(axis=-1, keepdims=True)
        with np.errstate(over="ignore", invalid="ignore"):
            np.exp(out, out=out)
            if seen is not None:
                out *= seen
            total = out @ ones
            if not total.size or (float(total.max()) < LIMIT and float(total.min()) > 1 / LIMIT):  # nan does neither
                break
    return total


@dataclass
class Pass:
    """What the gradients need of a pass over windows; rows of ``hidden`` end in a one, those of ``inputs`` too."""

    inputs: np.ndarray  # (n, WINDOW, 2 * WIDTH + 1): an id's own vector, and what was attended to
    asked: np.ndarray  # queries, keys and values
    attend: np.ndarray
    lower: np.ndarray  # own parts, what was attended to and the lift, as one matrix
    mix: np.ndarray  # the matrix of queries, keys and values, queries scaled
    hidden: np.ndarray


def forward(p: Params, given: np.ndarray, room: Room, skip: int = 0) -> Pass:
    """Hidden layer of windows of embedding rows ``given`` (n, WINDOW), one row per position from ``skip`` on."""
    n, kept = len(given), WINDOW - skip
    inputs = room("inputs", n, WINDOW, 2 * WIDTH + 1)
    np.add(np.take(p["embed"], given, axis=0, out=room("x", n, WINDOW, WIDTH), mode="clip"), p["place"], out=inputs[:, :, :WIDTH])
    mix = p["mix"][:, :_ASKED].copy()
    mix[:, :WIDTH] *= _SCALE
    lower = np.concatenate([p["mix"][:, _ASKED:], p["back"], p["lift"][None]])
    asked = np.matmul(inputs.reshape(n * WINDOW, -1)[:, :WIDTH], mix, out=room("asked", n * WINDOW, _ASKED)).reshape(n, WINDOW, _ASKED)
    turned = room("turned", n, WIDTH, WINDOW)
    turned[...] = asked[:, :, WIDTH : 2 * WIDTH].transpose(0, 2, 1)
    attend = room("attend", n, kept, WINDOW)
    total = _exps(asked[:, skip:, :WIDTH], turned, attend, _ONES, _SEEN[skip:])
    total += _LEAST
    attend *= np.divide(1, total, out=total)
    np.matmul(attend, asked[:, :, 2 * WIDTH :], out=inputs[:, skip:, WIDTH : 2 * WIDTH])
    inputs[:, :, 2 * WIDTH] = 1
    hidden = room("hidden", n * kept, HIDDEN + 1)
    np.matmul(inputs[:, skip:], lower, out=hidden.reshape(n, kept, -1)[:, :, :HIDDEN])
    hidden[:, HIDDEN] = 1
    np.maximum(hidden, 0, out=hidden)
    return Pass(inputs, asked, attend, lower, mix, hidden)


def _class_shares(p: Params, hidden: np.ndarray, windows: int, wanted: np.ndarray, room: Room) -> tuple[np.ndarray, ...]:
    """Unscaled shares of all classes, their sums, the wanted ones, and the places of these."""
    classes = p["out"].shape[1]
    shares = room("shares", len(hidden), classes)
    sums = _exps(_blocks(hidden, windows), p["out"], _blocks(shares, windows), np.ones(classes, np.float32)).reshape(-1)
    at = np.arange(0, shares.size, classes)
    at += wanted
    return shares, sums, shares.reshape(-1).take(at), at


_LEAST = np.float32(1e-30)


def log_shares(p: Params, given: np.ndarray, wanted: np.ndarray, scored: np.ndarray, room: Room | None = None, skip: int = 0) -> np.ndarray:
    """log10 of the class shares ``wanted`` at the ``scored`` positions of some windows, row by row; none is before ``skip``."""
    room = room or Room()
    _, total, share, _ = _class_shares(p, forward(p, given, room, skip).hidden, len(given), wanted[:, skip:].ravel(), room)
    share = np.maximum(share, _LEAST, out=share)
    share /= total
    return np.log10(share[scored[:, skip:].ravel()])


def empty_like(p: Params) -> tuple[np.ndarray, Params]:
    """One array for all parameters but the embedding, and its parts by name."""
    flat, parts, k = np.zeros(sum(v.size for name, v in p.items() if name != "embed"), np.float32), {}, 0
    for name, v in p.items():
        if name != "embed":
            parts[name] = flat[k : k + v.size].reshape(v.shape)
            k += v.size
    return flat, parts


def _slopes(p: Params, given: np.ndarray, wanted: np.ndarray, real: np.ndarray, room: Room, grads: Params) -> tuple[np.ndarray, ...]:
    """Writes the gradients but the embedding's; these, the rows they are for, and shares wanted and sums of shares."""
    n = len(given)
    done = forward(p, given, room)
    top, inputs, asked, attend = done.hidden, done.inputs, done.asked, done.attend
    shares, sums, share, at = _class_shares(p, top, n, wanted.ravel(), room)
    shares.reshape(-1)[at] = share - sums  # gradients of the logits, but for each row's factor, which is none where nothing is real
    shares *= (real.ravel() * np.float32(1 / max(1, np.count_nonzero(real))) / sums)[:, None]
    grads["out"][...] = np.matmul(_blocks(shares, n).transpose(0, 2, 1), _blocks(top, n)).sum(0).T
    d_top = room("d_top", n * WINDOW, HIDDEN)
    np.matmul(_blocks(shares, n), p["out"][:HIDDEN].T.copy(), out=_blocks(d_top, n))
    d_top *= top[:, :HIDDEN] > 0
    seen = inputs[:, :, WIDTH : 2 * WIDTH]
    np.matmul(seen.reshape(-1, WIDTH).T, d_top, out=grads["back"])
    np.matmul(np.ones(n * WINDOW, np.float32), d_top, out=grads["lift"])
    # what attention gives to a position, by the whole, is the product of what was seen and its gradient: the last column
    d_both = room("d_seen", n, WINDOW, WIDTH + 1)
    d_seen = d_both[:, :, :WIDTH]
    np.matmul(d_top, done.lower[WIDTH : 2 * WIDTH].T.copy(), out=d_both.reshape(n * WINDOW, -1)[:, :WIDTH])
    np.einsum("nkw,nkw->nk", d_seen, seen, out=d_both[:, :, WIDTH])
    turned = room("turned", n, WIDTH + 1, WINDOW)
    turned[:, :WIDTH] = asked[:, :, 2 * WIDTH :].transpose(0, 2, 1)
    turned[:, WIDTH] = -1
    d_score = np.matmul(d_both, turned, out=room("d_score", n, WINDOW, WINDOW))
    d_score *= attend
    d_asked = room("d_asked", n, WINDOW, _ASKED)
    np.matmul(d_score, asked[:, :, WIDTH : 2 * WIDTH], out=d_asked[:, :, :WIDTH])
    np.matmul(d_score.transpose(0, 2, 1), asked[:, :, :WIDTH], out=d_asked[:, :, WIDTH : 2 * WIDTH])
    np.matmul(attend.transpose(0, 2, 1), d_seen, out=d_asked[:, :, 2 * WIDTH :])
    flat = d_asked.reshape(n * WINDOW, _ASKED)
    x = inputs.reshape(n * WINDOW, -1)[:, :WIDTH]
    np.matmul(x.T, flat, out=grads["mix"][:, :_ASKED])
    np.matmul(x.T, d_top, out=grads["mix"][:, _ASKED:])
    grads["mix"][:, :WIDTH] *= _SCALE
    d_x = np.matmul(flat, done.mix.T.copy(), out=room("d_x", n * WINDOW, WIDTH))
    d_x += np.matmul(d_top, done.lower[:WIDTH].T.copy(), out=room("d_own", n * WINDOW, WIDTH))
    np.add.reduce(d_x.reshape(n, WINDOW, WIDTH), axis=0, out=grads["place"])
    names = given.ravel()
    if len(p["embed"]) <= 1 << 16:
        names = names.astype(np.uint16)  # two bytes are sorted by counting
    order = np.argsort(names, kind="stable")
    ordered = names[order]
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    heads = np.flatnonzero(new)
    moved = np.take(d_x, order, axis=0, out=room("moved", n * WINDOW, WIDTH), mode="clip")
    return (np.add.reduceat(moved, heads) if n else moved), ordered[heads].astype(np.int64), share, sums


def gradients(p: Params, given: np.ndarray, wanted: np.ndarray, real: np.ndarray) -> tuple[float, Params, np.ndarray]:
    """Mean loss over the ``real`` positions, its gradient for every parameter, and the rows of the embedding it is for."""
    _, grads = empty_like(p)
    embed, rows, share, sums = _slopes(p, given, wanted, real, Room(), grads)
    lost = -np.log(np.maximum(share, _LEAST) / sums)[real.ravel()]
    return float(lost.mean()) if len(lost) else 0.0, {"embed": embed, **grads}, rows


def batches(count: int, size: int = BATCH) -> Iterator[slice]:
    return (slice(k, min(count, k + size)) for k in range(0, count, size))


@dataclass
class Learner:
    """Adam on mini-batches of windows, from given parameters; only the embedding's rows at hand are moved."""

    params: Params
    rate: float = 0.02
    size: int = 32

    def __post_init__(self) -> None:
        self.flat, parts = empty_like(self.params)
        for name, part in parts.items():
            part[...] = self.params[name]
        self.params = {"embed": self.params["embed"].copy(), **parts}
        self.slope, self.grads = empty_like(self.params)
        self.moments = [np.zeros_like(self.flat), np.zeros_like(self.flat)]
        self.moments_of = [np.zeros_like(self.params["embed"]), np.zeros_like(self.params["embed"])]
        self.steps = self.windows = 0
        self.room = Room()

    def learn(self, given: np.ndarray, wanted: np.ndarray, real: np.ndarray) -> None:
        embed = self.params["embed"]
        for part in batches(len(given), self.size):
            self.steps += 1
            self.windows += part.stop - part.start
            slope, rows, _, _ = _slopes(self.params, given[part], wanted[part], real[part], self.room, self.grads)
            self.flat -= self._step(self.slope, *self.moments)
            mean, square = (m.take(rows, axis=0) for m in self.moments_of)
            embed[rows] -= self._step(slope, mean, square)
            for m, now in zip(self.moments_of, (mean, square)):
                m[rows] = now

    def _step(self, g: np.ndarray, mean: np.ndarray, square: np.ndarray) -> np.ndarray:
        """What to take off, in place of the gradient; the moments are moved on."""
        scale = np.float32(self.rate * (1 - 0.99**self.steps) ** 0.5 / (1 - 0.9**self.steps))
        mean *= np.float32(0.9)
        mean += np.float32(0.1) * g
        g *= g
        g *= np.float32(0.01)
        square *= np.float32(0.99)
        square += g
        np.sqrt(square, out=g)
        g += np.float32(1e-8)
        np.divide(mean, g, out=g)
        g *= scale
        return g
