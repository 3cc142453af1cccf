"""Ordered rule lists by incremental reduced-error pruning.

Rules are learned one after another. The examples not yet covered are split into
a growing and a pruning part; a rule grows by the condition with the best
information gain until it covers no negative, loses final conditions as long as
that does not lower its worth on the pruning part, and is kept if it errs there on
at most a tenth of what it covers. What a kept rule covers is removed; after three
rules in a row that are not kept (each with a new split), the list is complete.
"""

from __future__ import annotations

import numpy as np

#: The least worth, (right - wrong) / covered, of a kept rule.
KEPT = 0.8


def _covered(x: np.ndarray, rule: list[tuple[int, str, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c, op, v in rule:
        out &= x[:, c] <= v if op == "<=" else x[:, c] > v
    return out


def _grow(x: np.ndarray, y: np.ndarray, conditions: int) -> list[tuple[int, str, float]]:
    rule: list = []
    while len(y) and not y.all() and len(rule) < conditions:
        p0, n0 = y.sum(), len(y) - y.sum()
        if not p0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
        for c in range(x.shape[1]):
            order = np.argsort(x[:, c], kind="stable")
            v, pos = x[order, c], np.cumsum(y[order])
            ends = np.flatnonzero(v[1:] != v[:-1])
            if not len(ends):
                continue
            for op, p, t in (("<=", pos[ends], ends + 1), (">", p0 - pos[ends], len(v) - ends - 1)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / t) - base), 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    i = ends[k]
                    best = (float(gain[k]), (c, op, float((v[i] + v[i + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        keep = _covered(x, [best[1]])
        x, y = x[keep], y[keep]
    return rule


def _worth(x: np.ndarray, y: np.ndarray, rule: list) -> float:
    hit = y[_covered(x, rule)]
    return (2 * hit.sum() - len(hit)) / len(hit) if len(hit) else -1.0


def learn(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], seed: int = 7, most: int = 24, conditions: int = 6) -> dict:
    """A rule list for ``y`` (bool) from the columns of ``x``: {rules: [[column, op, threshold]...], then, else}.

    ``most`` rules of at most ``conditions`` conditions each: a longer list would fit its labels, not the corpus.
    """
    rng, rules = np.random.default_rng(seed), []
    x, y = np.asarray(x, float), np.asarray(y, bool)
    failed = 0
    while y.any() and len(rules) < most and failed < 3:
        part = np.zeros(len(y), bool)
        for value in (True, False):
            own = rng.permutation(np.flatnonzero(y == value))
            part[own[: (2 * len(own) + 2) // 3]] = True
        rule = _grow(x[part], y[part], conditions)
        if not rule:
            failed += 1
            continue
        px, py = x[~part], y[~part]
        while len(rule) > 1 and _worth(px, py, rule[:-1]) >= _worth(px, py, rule):
            rule = rule[:-1]
        if _worth(px, py, rule) < KEPT:
            failed += 1
            continue
        failed = 0
        tight: dict = {}
        for c, op, v in rule:
            tight[c, op] = v if (c, op) not in tight else (min if op == "<=" else max)(v, tight[c, op])
        rules.append([[names[c], op, round(v, 6)] for (c, op), v in tight.items()])
        keep = ~_covered(x, rule)
        x, y = x[keep], y[keep]
    return {"rules": rules, "then": 1, "else": 0}


def predict(rules: dict, x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(len(x), bool)
    for rule in rules["rules"]:
        out |= _covered(np.asarray(x, float), [(names.index(c), op, v) for c, op, v in rule])
    return out
