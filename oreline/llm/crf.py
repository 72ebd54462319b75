"""Linear-chain conditional random field in numpy: training and batched Viterbi.

Words fall into classes of equal features, so weights are looked up per class;
a token's score is its own class's plus what the classes before and after add.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

_NEVER = -1e4


@dataclass
class Model:
    """Weights by feature for the word before, the word itself and the word after."""

    labels: list[str]
    features: dict[str, int]
    weights: np.ndarray  # 3 x features x labels: own, before, after
    steps: np.ndarray  # labels x labels
    start: np.ndarray


def allowed_steps(labels: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Penalties that keep an inside label behind its own kind only."""
    k = len(labels)
    steps, start = np.zeros((k, k)), np.zeros(k)
    for j, b in enumerate(labels):
        if b.startswith("I-"):
            start[j] = _NEVER
            for i, a in enumerate(labels):
                if a[2:] != b[2:]:
                    steps[i, j] = _NEVER
    return steps, start


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def fit(table: list[list[tuple[str, str]]], describe: Callable[[str], tuple[str, ...]], labels: list[str], *, rounds: int = 120, rate: float = 0.3, l2: float = 2e-3) -> Model:
    """Maximum likelihood by AdaGrad on a small table of (word, label) sentences."""
    words = sorted({w for row in table for w, _ in row})
    features = {f: i for i, f in enumerate(sorted({f for w in words for f in describe(w)}))}
    incidence = np.zeros((len(words) + 1, len(features)))  # the last class stands for no word
    for i, w in enumerate(words):
        incidence[i, [features[f] for f in describe(w)]] = 1
    at = {w: i for i, w in enumerate(words)}
    n, longest, k = len(table), max(map(len, table)), len(labels)
    ids = np.full((n, longest + 2), len(words))
    gold = np.zeros((n, longest), np.int64)
    live = np.zeros((n, longest), bool)
    for r, row in enumerate(table):
        for t, (w, label) in enumerate(row):
            ids[r, t + 1], gold[r, t], live[r, t] = at[w], labels.index(label), True
    fixed_steps, fixed_start = allowed_steps(labels)
    values = [np.zeros((3, len(features), k)), np.zeros((k, k)), np.zeros(k)]
    squares = [np.full_like(v, 1e-8) for v in values]
    rows = np.arange(n)
    for _ in range(rounds):
        per_class = incidence @ values[0]
        score = per_class[0][ids[:, 1:-1]] + per_class[1][ids[:, :-2]] + per_class[2][ids[:, 2:]]
        steps, start = values[1] + fixed_steps, values[2] + fixed_start
        forward = np.zeros((n, longest, k))
        forward[:, 0] = score[:, 0] + start
        for t in range(1, longest):
            new = _logsumexp(forward[:, t - 1, :, None] + steps, 1) + score[:, t]
            forward[:, t] = np.where(live[:, t, None], new, forward[:, t - 1])
        total = _logsumexp(forward[:, -1], 1)
        backward = np.zeros((n, longest, k))
        step_grad = np.zeros((k, k))
        for t in range(longest - 2, -1, -1):
            ahead = backward[:, t + 1] + score[:, t + 1]
            on = live[:, t + 1, None]
            backward[:, t] = np.where(on, _logsumexp(steps + ahead[:, None, :], 2), 0.0)
            both = np.exp(forward[:, t, :, None] + steps + ahead[:, None, :] - total[:, None, None]) * on[:, :, None]
            step_grad += both.sum(axis=0)
            np.add.at(step_grad, (gold[live[:, t + 1], t], gold[live[:, t + 1], t + 1]), -1)
        error = np.exp(forward + backward - total[:, None, None]) * live[:, :, None]
        r, t = np.nonzero(live)
        error[r, t, gold[r, t]] -= 1
        start_grad = error[:, 0].sum(axis=0)
        by_class = np.zeros((3, len(words) + 1, k))
        for place, shift in enumerate((1, 0, 2)):
            np.add.at(by_class[place], ids[:, shift : shift + longest][r, t], error[r, t])
        grads = [incidence.T @ by_class, step_grad, start_grad]
        for v, s, g in zip(values, squares, grads):
            g = g / n + l2 * v
            s += g * g
            v -= rate * g / np.sqrt(s)
    return Model(labels, features, values[0].astype(np.float32), (values[1] + fixed_steps).astype(np.float32), (values[2] + fixed_start).astype(np.float32))


class Classes(dict):
    """Class number of each word; a class has three rows of label scores."""

    def __init__(self, model: Model, describe: Callable[[str], tuple[str, ...]], limit: int = 300_000):
        super().__init__()
        self.model, self.describe, self.limit = model, describe, limit
        self.known: dict[tuple[str, ...], int] = {}
        self.scores = np.zeros((3, 1, len(model.labels)), np.float32)  # class 0: no word

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        described = self.describe(word)
        found = self.known.get(described)
        if found is None:
            found = self.known[described] = self.scores.shape[1]
            hits = [self.model.features[f] for f in described if f in self.model.features]
            self.scores = np.concatenate([self.scores, self.model.weights[:, hits].sum(axis=1)[:, None]], axis=1)
        self[word] = found
        return found


def viterbi(model: Model, classes: Classes, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Best labels of many sentences laid end to end; ``starts`` are their places."""
    if not len(ids):
        return np.zeros(0, np.int8)
    ends = np.append(starts[1:], len(ids))
    before, after = np.concatenate([[0], ids[:-1]]), np.concatenate([ids[1:], [0]])
    before[starts], after[ends - 1] = 0, 0
    score = classes.scores[0][ids] + classes.scores[1][before] + classes.scores[2][after]
    order = np.argsort(starts - ends, kind="stable")  # longest first
    at, length = starts[order], (ends - starts)[order]
    running = np.searchsorted(-length, -np.arange(length[0]), side="left")  # sentences longer than t
    best = score[at] + model.start
    back: list[np.ndarray] = []
    for t in range(1, int(length[0])):
        n = running[t]
        ways = best[:n, :, None] + model.steps
        pick = ways.argmax(axis=1)
        back.append(pick.astype(np.int8))
        best[:n] = np.take_along_axis(ways, pick[:, None, :], axis=1)[:, 0] + score[at[:n] + t]
    out = np.empty(len(ids), np.int8)
    now = best.argmax(axis=1)
    for t in range(int(length[0]) - 1, -1, -1):
        n = running[t]
        out[at[:n] + t] = now[:n]
        if t:
            now[:n] = back[t - 1][np.arange(n), now[:n]]
    return out
