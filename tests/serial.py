"""Plain one-record-at-a-time reference runs, kept as simple as possible."""

from __future__ import annotations

import numpy as np


def sgd(records, p, q, rate, penalty, kind=np.float64, half=False):
    store = (lambda x: x.astype(np.float16).astype(np.float32)) if half else (lambda x: x)
    rate, penalty = kind(rate), kind(penalty)
    for u, i, r in records:
        pu, qi = p[u].copy(), q[i].copy()
        e = kind(kind(np.sum(pu * qi)) - kind(r))
        p[u] = store(pu - rate * (penalty * pu + e * qi))
        q[i] = store(qi - rate * (penalty * qi + e * pu))


def adagrad(records, p, q, pa, qa, rate, penalty):
    for u, i, r in records:
        pu, qi = p[u].copy(), q[i].copy()
        e = pu @ qi - r
        gp, gq = penalty * pu + e * qi, penalty * qi + e * pu
        pa[u] += gp * gp
        qa[i] += gq * gq
        p[u] -= np.where(pa[u] > 0, rate / np.sqrt(np.where(pa[u] > 0, pa[u], 1)), 0) * gp
        q[i] -= np.where(qa[i] > 0, rate / np.sqrt(np.where(qa[i] > 0, qa[i], 1)), 0) * gq


def minibatch(records, p, q, size, rate, penalty):
    for first in range(0, len(records), size):
        batch = records[first:first + size]
        gp, gq = {}, {}
        for u, i, r in batch:
            e = p[u] @ q[i] - r
            gp[u] = gp.get(u, 0) + e * q[i]
            gq[i] = gq.get(i, 0) + e * p[u]
        for u, g in gp.items():
            p[u] = p[u] - rate * (g + penalty * p[u])
        for i, g in gq.items():
            q[i] = q[i] - rate * (g + penalty * q[i])


def initial(rows, width, salt):
    ids, k = np.arange(rows)[:, None], np.arange(width)[None, :]
    return ((ids * 7919 + k * 104729 + salt * 1299709) % 10007) / 100070.0


def block(ids, copy, blocks):
    return (np.asarray(ids) * 1299709 + copy * 104729) % 2147483647 % blocks


def matrices(state, users, items, width, column="features"):
    """The two factor matrices of a state table."""
    p, q = np.full((users, width), np.nan), np.full((items, width), np.nan)
    for row in state.select("side", "id", column).collect():
        (p if row.side == 0 else q)[row.id] = row[column]
    return p, q
