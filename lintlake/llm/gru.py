"""A gated recurrent language model in numpy, with a class-factored softmax."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Words in a class of the frequent words.
CLASS = 64
# Tokens over which gradients run back, and over which states of a group of texts are held when scoring.
WINDOW = 32
_GROUP = 512
# States whose probabilities are worked out at once.
_ROWS = 1024
# Weights that Adam moves at once.
_BLOCK = 1 << 16
# Logits below this need no shift before their exponentials are added up in single precision.
_SAFE = 60.0


@dataclass(frozen=True)
class Shape:
    """Token ids: frequent words by rank, in classes of CLASS; then a class each for the other words; then the start."""

    words: int
    others: int
    hidden: int = 48

    @property
    def classes(self) -> int:
        return self.words // CLASS + self.others

    @property
    def start(self) -> int:
        return self.words + self.others


def initial(shape: Shape, word_counts: np.ndarray, other_counts: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights whose biases give the frequencies of the corpus: before training the model is a unigram model."""
    rng = np.random.default_rng(seed)
    h = shape.hidden
    by_class = np.concatenate([word_counts.reshape(-1, CLASS).sum(1), other_counts]) + 0.5
    with np.errstate(divide="ignore"):
        in_class = np.log(word_counts / np.repeat(by_class[: shape.words // CLASS], CLASS))
    return {
        "input": rng.normal(0, 0.1, (shape.start + 1, 3 * h)).astype(np.float32),
        "state": (rng.normal(0, 1, (h, 3 * h)) / h**0.5).astype(np.float32),
        "class": rng.normal(0, 0.05, (h, shape.classes)).astype(np.float32),
        "class_bias": np.log(by_class / by_class.sum()).astype(np.float32),
        "word": rng.normal(0, 0.05, (shape.words, h)).astype(np.float32),
        "word_bias": np.maximum(in_class, -30).astype(np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _tanh(x: np.ndarray) -> np.ndarray:
    return 2 / (1 + np.exp(-2 * x)) - 1


def _step(w: dict[str, np.ndarray], h: np.ndarray, token: np.ndarray):
    """The next state, and what its gradient needs."""
    n = h.shape[1]
    into, from_state = w["input"][token], h @ w["state"]
    gates = _sigmoid(into[:, : 2 * n] + from_state[:, : 2 * n])
    update, reset = gates[:, :n], gates[:, n:]
    recurrent = from_state[:, 2 * n :]
    fresh = _tanh(into[:, 2 * n :] + reset * recurrent)
    return fresh + update * (h - fresh), (update, reset, recurrent, fresh)


class _Room:
    """Arrays by name, used anew in every window: their memory is asked for once."""

    def __init__(self, kind: np.dtype):
        self.kind, self.held = kind, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.empty(size, self.kind)
        return self.held[name][:size].reshape(shape)


def _advance(to_next: np.ndarray, h: np.ndarray, gates: np.ndarray, fresh: np.ndarray, after: np.ndarray, room: _Room) -> None:
    """Puts the next state into `after`; `gates` and `fresh` are what the tokens give, and are used up.

    What goes to the gates comes times -1, what goes to the fresh state times -2: see `_scaled`.
    """
    n = h.shape[1]
    given = np.dot(h, to_next, out=room("given", len(h), 3 * n))
    gates += given[:, : 2 * n]
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    fresh += np.multiply(given[:, 2 * n :], gates[:, n:], out=room("recurrent", len(h), n))
    np.exp(fresh, out=fresh)
    fresh += 1
    np.divide(2, fresh, out=fresh)
    fresh -= 1
    np.subtract(h, fresh, out=after)
    after *= gates[:, :n]
    after += fresh


def _scaled(weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts for the gates and for the fresh state, as the exponentials in them take them; both factors are exact."""
    return np.multiply(weights[:, : 2 * n], -1), np.multiply(weights[:, 2 * n :], -2)


def class_of(target: np.ndarray, shape: Shape) -> np.ndarray:
    return np.where(target < shape.words, target // CLASS, target - shape.words + shape.words // CLASS)


def _most(weights: np.ndarray, bias: np.ndarray) -> float:
    """No logit is larger, nor any below its negative: all states are between -1 and 1."""
    return float(np.abs(weights).sum(0).max(initial=0) + np.abs(bias).max(initial=0))


def _exponentials(logits: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials in place of the logits, their sum in each row, and the logarithm of that of the logits themselves."""
    if safe:
        np.exp(logits, out=logits)
        total = logits @ np.ones(logits.shape[1], logits.dtype)
        return total, np.log(total)
    top = logits.max(1)
    logits -= top[:, None]
    np.exp(logits, out=logits)
    total = logits.sum(1)
    return total, np.log(total) + top


def _by_class(target: np.ndarray, shape: Shape) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Places of the frequent words in order of their classes, and of every class its number, its first place and its end."""
    rows = np.flatnonzero(target < shape.words)
    classes = (target[rows] // CLASS).astype(np.uint16 if shape.words <= CLASS << 16 else np.int64)
    order = np.argsort(classes, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(classes[order])) + 1).tolist(), len(rows)]
    rows = rows[order]
    return rows, [(int(target[rows[a]] // CLASS), a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def log_likelihood(
    w: dict[str, np.ndarray], shape: Shape, states: np.ndarray, target: np.ndarray, room: _Room | None = None
) -> np.ndarray:
    """Natural logarithm of each target's probability: its class, and for frequent words the word in its class."""
    room = room or _Room(np.result_type(states, w["class"]))
    found = np.empty(len(target))
    every = np.arange(_ROWS)
    own = class_of(target, shape)
    safe = _most(w["class"], w["class_bias"]) < _SAFE
    for start in range(0, len(target), _ROWS):
        part = states[start : start + _ROWS]
        logits = np.dot(part, w["class"], out=room("logits", len(part), shape.classes))
        logits += w["class_bias"]
        mine = logits[every[: len(part)], own[start : start + _ROWS]]
        found[start : start + _ROWS] = mine - _exponentials(logits, safe)[1]
    safe = _most(w["word"].T, w["word_bias"]) < _SAFE
    word, bias = w["word"].reshape(-1, CLASS, shape.hidden), w["word_bias"].reshape(-1, CLASS)
    chosen, classes = _by_class(target, shape)
    for start in range(0, len(chosen), _ROWS):
        rows = chosen[start : start + _ROWS]
        near = np.take(states, rows, axis=0, out=room("near", len(rows), shape.hidden), mode="clip")
        logits = room("logits", len(rows), CLASS)
        for number, begin, end in classes:
            if begin < start + len(rows) and end > start:
                part = slice(max(begin - start, 0), min(end - start, len(rows)))
                np.dot(near[part], word[number].T, out=logits[part])
        goal = target[rows]
        logits += np.take(bias, goal // CLASS, axis=0)
        mine = logits[every[: len(rows)], goal % CLASS]
        found[rows] += mine - _exponentials(logits, safe)[1]
    return found


def score(w: dict[str, np.ndarray], shape: Shape, texts: list[np.ndarray]) -> np.ndarray:
    """Log-likelihood of each whole text, its state carried from window to window.

    Texts of like length go side by side; memory is that of a window for each of them, whatever their length.
    """
    n = shape.hidden
    room = _Room(w["state"].dtype)
    tables = _scaled(w["input"], n)
    to_next = np.concatenate(_scaled(w["state"], n), axis=1)
    lengths = np.array([len(t) for t in texts], np.int64)
    total = np.zeros(len(texts))
    order = np.argsort(-lengths, kind="stable")
    for begin in range(0, len(order), _GROUP):
        group = order[begin : begin + _GROUP]
        size = lengths[group]
        every = np.concatenate([texts[i] for i in group]) if size[0] else np.zeros(0, np.int64)
        first = np.cumsum(size) - size
        h = np.zeros((len(group), shape.hidden), np.float32)
        before = np.full(len(group), shape.start)
        for at in range(0, int(size[0]), WINDOW):
            active = int(np.searchsorted(-size, -at, side="left"))
            h, before = h[:active], before[:active]
            span = min(WINDOW, int(size[0]) - at)
            place = at + np.arange(span)
            there = place < size[:active, None]
            target = every[np.minimum(first[:active, None] + place, len(every) - 1)]
            token = np.concatenate([before[:, None], target[:, :-1]], axis=1)
            states = room("states", span, active, n)
            order_of_time = token.T.ravel()
            gates, fresh = (
                np.take(table, order_of_time, axis=0, out=room(name, len(order_of_time), table.shape[1]), mode="clip").reshape(span, active, -1)
                for name, table in zip(("gates", "fresh"), tables, strict=True)
            )
            for t in range(span):
                _advance(to_next, h, gates[t], fresh[t], states[t], room)
                h = states[t]
            h = h.copy()
            before = target[:, -1]
            flat, goal, place = states.reshape(-1, n), target.T.ravel(), np.tile(np.arange(active), span)
            if not there.all():
                some = there.T.ravel()
                flat, goal, place = flat[some], goal[some], place[some]
            total[group[:active]] += np.bincount(place, log_likelihood(w, shape, flat, goal, room), active)
    return total


def _gradients(w: dict[str, np.ndarray], shape: Shape, h: np.ndarray, token: np.ndarray, target: np.ndarray, fresh: np.ndarray):
    """Gradients of the mean loss over a window, the loss, and the last state; `fresh` marks where a text begins."""
    g = {name: np.zeros_like(value) for name, value in w.items()}
    touched, values, loss, last = _window(w, shape, h, token, target, fresh, g, _Room(w["state"].dtype))
    g["input"][touched] = values
    return g, loss, last


def _window(
    w: dict[str, np.ndarray], shape: Shape, h: np.ndarray, token: np.ndarray, target: np.ndarray, fresh: np.ndarray,
    g: dict[str, np.ndarray], room: _Room,
):
    """The tokens of a window with the gradients of their `input` rows, the loss, and the last state.

    All other gradients are put into `g`.  Only what a step needs of the one before is done step by step, the rest for
    the whole window at once.
    """
    rows, span = target.shape
    n, size = shape.hidden, target.size
    kind = w["state"].dtype
    begins = [np.flatnonzero(column) if some else None for column, some in zip(fresh.T, fresh.any(0).tolist(), strict=True)]
    tokens, goal = token.T.ravel(), target.T.ravel()

    into = np.take(w["input"], tokens, axis=0, out=room("through", size, 3 * n), mode="clip")
    gates = np.multiply(into[:, : 2 * n], -1, out=room("gates", size, 2 * n)).reshape(span, rows, -1)
    candidate = np.multiply(into[:, 2 * n :], -2, out=room("candidate", size, n)).reshape(span, rows, n)
    to_next = np.concatenate(_scaled(w["state"], n), axis=1)
    before, states, change = (room(name, span, rows, n) for name in ("before", "states", "change"))
    from_state, part = room("from_state", span, rows, 3 * n), room("part", rows, n)
    for t in range(span):
        before[t] = h
        h = before[t]
        if begins[t] is not None:
            h[begins[t]] = 0
        gate, new, after = gates[t], candidate[t], states[t]
        given = np.dot(h, to_next, out=from_state[t])
        gate += given[:, : 2 * n]
        np.exp(gate, out=gate)
        gate += 1
        np.reciprocal(gate, out=gate)
        new += np.multiply(given[:, 2 * n :], gate[:, n:], out=part)
        np.exp(new, out=new)
        new += 1
        np.divide(2, new, out=new)
        new -= 1
        np.subtract(h, new, out=change[t])
        np.multiply(change[t], gate[:, :n], out=after)
        after += new
        h = after
    last = h.copy()

    flat = states.reshape(-1, n)
    scale = kind.type(1 / size)
    every = np.arange(size)
    own = class_of(goal, shape)
    p = np.dot(flat, w["class"], out=room("classes", size, shape.classes))
    p += w["class_bias"]
    loss = -float(p[every, own].sum())
    total, norm = _exponentials(p, _most(w["class"], w["class_bias"]) < _SAFE)
    loss += float(norm.sum())
    p *= (scale / total)[:, None]
    p[every, own] -= scale
    np.dot(flat.T, p, out=g["class"])
    np.dot(np.ones(size, kind), p, out=g["class_bias"])
    back = np.dot(p, w["class"].T, out=room("back", size, n))
    g["word"].fill(0)
    g["word_bias"].fill(0)
    chosen, classes = _by_class(goal, shape)
    if classes:
        near = np.take(flat, chosen, axis=0, out=room("near", len(chosen), n), mode="clip")
        hit, each = goal[chosen] % CLASS, every[: len(chosen)]
        p, to_state = room("words", len(chosen), CLASS), room("to_state", len(chosen), n)
        word, bias = w["word"].reshape(-1, CLASS, n), w["word_bias"].reshape(-1, CLASS)
        for number, a, b in classes:
            np.dot(near[a:b], word[number].T, out=p[a:b])
        p += np.take(bias, goal[chosen] // CLASS, axis=0)
        loss -= float(p[each, hit].sum())
        total, norm = _exponentials(p, _most(w["word"].T, w["word_bias"]) < _SAFE)
        loss += float(norm.sum())
        p *= (scale / total)[:, None]
        p[each, hit] -= scale
        slope = g["word"].reshape(-1, CLASS, n)
        for number, a, b in classes:
            np.dot(p[a:b].T, near[a:b], out=slope[number])
            np.dot(p[a:b], word[number], out=to_state[a:b])
        numbers, starts = [number for number, _, _ in classes], [a for _, a, _ in classes]
        g["word_bias"].reshape(-1, CLASS)[numbers] = np.add.reduceat(p, starts, axis=0)
        back[chosen] += to_state
    back = back.reshape(span, rows, n)

    # Factors from the gradient of a state to those of its candidate, its update and, through the candidate, its reset.
    update, reset, keep, recurrent = (room(name, span, rows, n) for name in ("update", "reset", "keep", "recurrent"))
    update[...], reset[...] = gates[:, :, :n], gates[:, :, n:]
    np.subtract(1, update, out=keep)
    candidate *= candidate
    np.subtract(1, candidate, out=candidate)
    candidate *= keep
    change *= update
    change *= keep
    np.multiply(from_state[:, :, 2 * n :], -0.5, out=recurrent)
    recurrent *= reset
    np.subtract(1, reset, out=keep)
    recurrent *= keep
    through, d_candidate = room("through", span, rows, 3 * n), keep
    to_before = np.ascontiguousarray(w["state"].T)
    carry = np.zeros((rows, n), kind)
    for t in range(span - 1, -1, -1):
        d, into, new = back[t], through[t], d_candidate[t]
        d += carry
        np.multiply(d, candidate[t], out=new)
        np.multiply(d, change[t], out=into[:, :n])
        np.multiply(new, recurrent[t], out=into[:, n : 2 * n])
        np.multiply(new, reset[t], out=into[:, 2 * n :])
        np.dot(into, to_before, out=carry)
        d *= update[t]
        carry += d
        if begins[t] is not None:
            carry[begins[t]] = 0
    np.dot(before.reshape(-1, n).T, through.reshape(-1, 3 * n), out=g["state"])
    through[:, :, 2 * n :] = d_candidate
    touched, values = _sums(tokens, through.reshape(-1, 3 * n), shape, room)
    return touched, values, loss, last


def _sums(tokens: np.ndarray, rows: np.ndarray, shape: Shape, room: _Room) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens, and the sum of the rows of each: neighbours are added up, then sums of two, of four and so on."""
    order = np.argsort(tokens.astype(np.uint16) if shape.start < 1 << 16 else tokens, kind="stable")
    found = tokens[order]
    heads = np.flatnonzero(np.concatenate([[True], np.diff(found) != 0]))
    counts = np.diff(np.append(heads, len(found)))
    rows = np.take(rows, order, axis=0, out=room("sorted", *rows.shape), mode="clip")
    live = np.arange(len(found))
    place = live - np.repeat(heads, counts)
    left = np.repeat(counts, counts) - place
    step = 1
    while len(live := live[(place[live] & (2 * step - 1) == 0) & (left[live] > step)]):
        rows[live] += rows[live + step]
        step *= 2
    return found[heads], rows[heads]


def _flat(shapes: dict[str, tuple[int, ...]], kind: np.dtype) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """One array of zeros, and its parts by name and shape."""
    ends = np.cumsum([0, *(int(np.prod(s)) for s in shapes.values())]).tolist()
    whole = np.zeros(ends[-1], kind)
    return whole, {name: whole[a:b].reshape(s) for (name, s), a, b in zip(shapes.items(), ends, ends[1:], strict=False)}


class _Adam:
    """Moves all weights; those of the tokens, `input`, come first, and most of their gradients are zero.

    The moving averages of the gradients and of their squares are `mean` and `square` times `0.1 * 0.9**k` and
    `0.005 * 0.995**k`, where `k` steps were done since the averages were last brought up to date: so a step changes
    only those of weights that have a gradient.
    """

    EVERY = 64

    def __init__(self, weights: np.ndarray, width: int):
        self.weights, self.width = weights, width
        self.steps = self.k = 0
        self.mean, self.square = np.zeros_like(weights), np.zeros_like(weights)
        self.room = np.empty(min(_BLOCK, len(weights)), weights.dtype)

    def step(self, touched: np.ndarray, values: np.ndarray, rest: np.ndarray, speed: float) -> None:
        """One step against the gradients: `values` of the tokens `touched`, and the `rest`; both are used up."""
        self.steps += 1
        self.k += 1
        size = max(1.0, float(np.sqrt(float(np.vdot(values, values)) + float(rest @ rest))))
        first = len(self.weights) - len(rest)
        values *= 1 / (size * 0.9**self.k)
        rest *= 1 / (size * 0.9**self.k)
        self.mean[:first].reshape(-1, self.width)[touched] += values
        self.mean[first:] += rest
        values *= values
        rest *= rest
        again = 0.9 ** (2 * self.k) / 0.995**self.k
        values *= again
        rest *= again
        self.square[:first].reshape(-1, self.width)[touched] += values
        self.square[first:] += rest
        root = (0.005 * 0.995**self.k) ** 0.5
        lift = speed * np.sqrt(1 - 0.995**self.steps) / (1 - 0.9**self.steps) * 0.1 * 0.9**self.k / root
        for begin in range(0, len(self.weights), _BLOCK):
            part = slice(begin, begin + _BLOCK)
            weights = self.weights[part]
            room = self.room[: len(weights)]
            np.sqrt(self.square[part], out=room)
            room += 1e-8 / root
            np.divide(self.mean[part], room, out=room)
            room *= lift
            weights -= room
        if self.k == self.EVERY:
            self.mean *= 0.9**self.k
            self.square *= 0.995**self.k
            self.k = 0


def train(
    w: dict[str, np.ndarray],
    shape: Shape,
    texts: list[np.ndarray],
    epochs: int | list[int],
    rate: float,
    rows: int = 64,
    seed: int = 7,
) -> dict[str, np.ndarray]:
    """New weights after truncated back-propagation over the texts, laid end to end in `rows` streams.

    States run on from window to window and start anew with each text.  A list says of each text in how many of the
    first epochs it is.
    """
    every = [epochs] * len(texts) if isinstance(epochs, int) else epochs
    texts, every = [t for t in texts if len(t)], [n for t, n in zip(texts, every, strict=True) if len(t)]
    if not texts:
        return w
    kind = w["state"].dtype
    shapes = {name: w[name].shape for name in ("input", *(x for x in w if x != "input"))}
    whole, own = _flat(shapes, kind)
    for name, value in w.items():
        own[name][...] = value
    rest, g = _flat({name: s for name, s in shapes.items() if name != "input"}, kind)
    adam, room = _Adam(whole, 3 * shape.hidden), _Room(kind)
    rng = np.random.default_rng(seed)
    streams = []
    for epoch in range(max(every)):
        tokens = sum(len(t) for t, n in zip(texts, every, strict=True) if n > epoch)
        streams.append((most := max(1, min(rows, tokens // WINDOW)), tokens // most))
    steps = max(1, sum(-(-length // WINDOW) for _, length in streams))
    step = 0
    for epoch, (rows, length) in enumerate(streams):
        chosen = [texts[i] for i in rng.permutation(len(texts)) if every[i] > epoch]
        target = np.concatenate(chosen)
        fresh = np.zeros(len(target), bool)
        fresh[np.cumsum([0, *map(len, chosen)])[:-1]] = True
        token = np.where(fresh, shape.start, np.concatenate([[shape.start], target[:-1]]))
        target, token, fresh = (a[: rows * length].reshape(rows, length) for a in (target, token, fresh))
        h = np.zeros((rows, shape.hidden), np.float32)
        for at in range(0, length, WINDOW):
            part = slice(at, at + WINDOW)
            touched, values, _, h = _window(own, shape, h, token[:, part], target[:, part], fresh[:, part], g, room)
            step += 1
            adam.step(touched, values, rest, rate * min(1.0, step / 20) * (1 - 0.9 * step / steps))
    return {name: own[name].copy() for name in w}
