"""A small causal self-attention model over token classes, in numpy: gradients, training steps and batched scoring.

Subword ids are grouped into classes: the most frequent ids alone, the rest by frequency. The model gives the class of the
next token from the classes before it; the id within its class follows the corpus counts. A window is WIDTH inputs of which
the last SPAN predict their successor, so windows overlap, every token has WIDTH - SPAN tokens of context or more, and is
scored once.
"""

from __future__ import annotations

import numpy as np

CLASSES, OWN_CLASSES = 128, 112
DIM, SPAN, WIDTH = 16, 16, 32
START = CLASSES  # input only
LIMIT, FAINT = 50.0, 40.0
#: Windows of a training step that are worked on at a time; what is made of them stays in a cache.
BLOCK = 64
_DISTANCE = (np.arange(WIDTH - SPAN, WIDTH)[:, None] - np.arange(WIDTH)[None, :])
_MASK, _BEHIND = _DISTANCE < 0, np.maximum(_DISTANCE, 0)

Params = dict[str, np.ndarray]


def classes_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per id its class and the log10 share within it, and the share of each class, from corpus counts of all ids."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    kind = np.empty(len(counts), np.uint8)
    own = order[:OWN_CLASSES]
    kind[own] = np.arange(len(own))
    tail = order[OWN_CLASSES:]
    mass = np.cumsum(counts[tail] + 0.1)
    if len(tail):
        kind[tail] = OWN_CLASSES + np.minimum((mass / mass[-1] * (CLASSES - OWN_CLASSES)).astype(int), CLASSES - OWN_CLASSES - 1)
    smooth = counts + 0.1
    total = np.bincount(kind, weights=smooth, minlength=CLASSES)
    return kind, np.log10(smooth / total[kind]), np.maximum(total, 1e-9) / max(total.sum(), 1e-9)


def fresh(shares: np.ndarray, seed: int = 5) -> Params:
    """Parameters before training: predictions are the class shares."""
    rng = np.random.default_rng(seed)
    near = lambda *shape: (rng.normal(size=shape) * 0.25).astype(np.float32)
    return {"E": near(CLASSES + 1, DIM) * 2, "Q": near(DIM, DIM), "K": near(DIM, DIM), "V": near(DIM, DIM), "O": near(DIM, DIM),
            "U": near(DIM, CLASSES) * np.float32(0.2), "b": np.log(shares).astype(np.float32), "r": np.zeros(WIDTH, np.float32)}


def flat(params: Params) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)])


def shaped(vector: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = vector[at:at + like[k].size].reshape(like[k].shape).astype(like[k].dtype)
        at += like[k].size
    return out


def _tables(params: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What attention needs, by class: factors of a pair of classes and of a place in the window (0 for what lies ahead), and
    what a class gives to later tokens, with a 1 beside it that sums the factors.

    Queries, keys and values hang on the input class alone, so a weight before norming is a factor of the two classes times one
    of their distance, and no exponential is taken per token. Factors under exp(-FAINT) of the largest count as that.
    """
    e, r = params["E"], params["r"]
    near = (e @ params["Q"] / np.sqrt(np.array(DIM, e.dtype))) @ (e @ params["K"]).T
    near = np.exp(np.maximum(near - near.max(-1, keepdims=True), -FAINT))
    far = np.where(_MASK, 0, np.exp(np.maximum(r - r.max(), -FAINT))[_BEHIND]).astype(e.dtype)
    return near, far, np.hstack([e @ params["V"] @ params["O"], np.ones((len(e), 1), e.dtype)])


def _attend(near: np.ndarray, far: np.ndarray, values: np.ndarray, inputs: np.ndarray):
    """Pairs of classes, their weights, values, the sums of weights, and what the last SPAN places take from their past."""
    pairs = inputs[:, WIDTH - SPAN:, None] * len(near) + inputs[:, None, :]
    a = np.take(near.ravel(), pairs, mode="clip")  # clip: no pass that checks the bounds
    a *= far
    v = np.take(values, inputs, axis=0)
    o = np.matmul(a, v)
    mass = o[..., DIM:]
    return pairs, a, v, mass, o[..., :DIM] / mass


def _sums(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(at.ravel(), weights=values.ravel(), minlength=size)


def loss_and_gradient(params: Params, inputs: np.ndarray, targets: np.ndarray, weights: np.ndarray) -> tuple[float, Params]:
    """Mean cross entropy of ``targets`` (windows x SPAN) behind ``inputs`` (windows x WIDTH), and its gradient.

    Gradients are summed by class, and by pair of classes, before they meet the matrices.
    """
    e, u = params["E"], params["U"]
    real, size = e.dtype, len(e)
    near, far, values = _tables(params)
    to_logits, back = np.vstack([u, params["b"]]), np.vstack([u, np.ones((1, CLASSES), real)]).T
    by_class, ones, cells = np.ascontiguousarray(u.T), np.ones(DIM, real), np.arange(size * DIM).reshape(size, DIM)
    each = (weights / max(float(weights.sum()), 1.0)).astype(real)
    loss, dlogits, dfar = 0.0, np.zeros((CLASSES, DIM + 1), real), np.zeros((SPAN, WIDTH), real)
    dnear, dvalues, dlast = np.zeros(size * size), np.zeros(size * DIM), np.zeros(size * DIM)
    for s in range(0, len(inputs), BLOCK):
        x = inputs[s:s + BLOCK].astype(np.intp)
        last, aim, share = x[:, WIDTH - SPAN:], targets[s:s + BLOCK].ravel(), each[s:s + BLOCK].ravel()
        pairs, a, v, mass, o = _attend(near, far, values, x)
        h = np.empty((len(aim), DIM + 1), real)
        h[:, DIM] = 1
        np.add(np.take(e, last.ravel(), axis=0), o.reshape(-1, DIM), out=h[:, :DIM])
        z = h @ to_logits
        if z.max() > LIMIT or z.min() < -LIMIT:
            z -= z.max(-1, keepdims=True)
        picked = np.arange(len(z)) * CLASSES + aim
        chosen = np.take(z, picked)
        np.exp(z, out=z)
        got = z @ back
        whole = got[:, DIM]
        loss += float(((np.log(whole) - chosen) * share).sum(dtype=np.float64))
        z.ravel()[picked] -= whole
        part = (share / whole)[:, None]
        h *= part
        dlogits += z.T @ h
        dh = got[:, :DIM] * part
        dh -= np.take(by_class, aim, axis=0) * share[:, None]
        dh = dh.reshape(o.shape)
        down = np.empty((*o.shape[:2], DIM + 1), real)
        np.divide(dh, mass, out=down[..., :DIM])
        np.negative((down[..., :DIM] * o) @ ones, out=down[..., DIM])
        da = np.matmul(down, v.transpose(0, 2, 1))
        da *= a
        dfar += da.sum(0)
        dnear += _sums(pairs, da, size * size)
        dvalues += _sums(np.take(cells, x, axis=0), np.matmul(a.transpose(0, 2, 1), down[..., :DIM]), size * DIM)
        dlast += _sums(np.take(cells, last, axis=0), dh, size * DIM)
    dnear, dvalues, dlast = dnear.astype(real).reshape(size, size), dvalues.astype(real).reshape(size, DIM), dlast.astype(real).reshape(size, DIM)
    scale = 1 / np.sqrt(np.array(DIM, real))
    dq, dk, dv = dnear @ (e @ params["K"]) * scale, dnear.T @ (e @ params["Q"]) * scale, dvalues @ params["O"].T
    return loss, {"U": dlogits[:, :DIM].T, "b": dlogits[:, DIM], "r": _sums(_BEHIND, dfar, WIDTH).astype(real), "Q": e.T @ dq, "K": e.T @ dk, "V": e.T @ dv,
                  "O": (e @ params["V"]).T @ dvalues, "E": dlast + dq @ params["Q"].T + dk @ params["K"].T + dv @ params["V"].T}


class Adam:
    def __init__(self, params: Params, rate: float = 0.01):
        self.params, self.rate, self.steps = {k: x.copy() for k, x in params.items()}, rate, 0
        self.mean, self.square = ({k: np.zeros_like(x) for k, x in params.items()} for _ in range(2))

    def step(self, grad: Params) -> None:
        self.steps += 1
        for k, g in grad.items():
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.01 * (g * g - self.square[k])
            fit = self.mean[k] / (1 - 0.9 ** self.steps) / (np.sqrt(self.square[k] / (1 - 0.99 ** self.steps)) + 1e-8)
            self.params[k] -= np.float32(self.rate) * fit.astype(np.float32)


class Windows:
    """Window inputs and targets of texts whose classes stand in a row, ``sizes`` of them per text."""

    def __init__(self, kinds: np.ndarray, sizes: np.ndarray):
        blocks = -(-sizes // SPAN)
        room = WIDTH + blocks * SPAN
        begin = np.cumsum(room) - room
        self.row = np.full(int(room.sum()), START, np.uint8)
        first = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(sizes)), blocks)
        self.number = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        self.row[np.arange(len(kinds)) + np.repeat(begin + WIDTH - first, sizes)] = kinds
        self.at = begin[self.owner] + self.number * SPAN
        self.left = np.minimum(sizes[self.owner] - self.number * SPAN, SPAN)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = self.at[which][:, None]
        inputs = self.row[at + np.arange(SPAN - 1, SPAN - 1 + WIDTH)]
        used = np.arange(SPAN)[None, :] < self.left[which][:, None]
        return inputs, np.where(used, self.row[at + np.arange(WIDTH, WIDTH + SPAN)], 0), used


def _bounded(x: np.ndarray) -> np.ndarray:
    """Logits that exponentials can bear."""
    return np.clip(x, -LIMIT, LIMIT, out=x) if x.size and x.max() > LIMIT else x


class Scorer:
    """Scores many windows at once."""

    def __init__(self, params: Params):
        self.near, self.far, self.values = _tables(params)
        self.e, self.u, self.b = params["E"], params["U"], params["b"]
        # biases are factors once exponentials are taken
        self.prior = np.exp(self.b)

    def log10(self, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
        inputs = inputs.astype(np.intp)
        o = _attend(self.near, self.far, self.values, inputs)[-1]
        o += np.take(self.e, inputs[:, WIDTH - SPAN:], axis=0)
        z = _bounded(o.reshape(-1, DIM) @ self.u)
        chosen = np.take(z, np.arange(len(z)) * CLASSES + targets.ravel()) + self.b[targets.ravel()]
        np.exp(z, out=z)
        return ((chosen - np.log(z @ self.prior)) / np.float32(np.log(10))).reshape(targets.shape)
