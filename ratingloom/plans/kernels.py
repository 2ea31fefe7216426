"""Numpy update rules for one block of ratings.

Spark decides which ratings and factor rows meet in a block; the functions here only
apply the update rule to them. Arrays are ``(rows, features)``.
"""

from __future__ import annotations

import numpy as np


def rounder(precision: str):
    """How an updated array is rounded for storage; arithmetic keeps its own type."""
    if precision == "half":
        return lambda values: values.astype(np.float16).astype(np.float32)
    return lambda values: values


def arithmetic_type(precision: str):
    return np.float64 if precision == "double" else np.float32


def wave_numbers(users: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Wave of each record, given in serial order, such that waves run like the serial order.

    A record comes one wave after the latest earlier record of the same user or item. Within a
    wave no row occurs twice, so the wave can be updated as a whole: every record still reads
    exactly the values that a one-by-one run would have left for it.
    """
    user_index = np.unique(users, return_inverse=True)[1].tolist()
    item_index = np.unique(items, return_inverse=True)[1].tolist()
    last_user = [0] * (max(user_index, default=-1) + 1)
    last_item = [0] * (max(item_index, default=-1) + 1)
    waves = np.empty(len(user_index), dtype=np.int32)
    for n, (u, i) in enumerate(zip(user_index, item_index)):
        a, b = last_user[u], last_item[i]
        wave = (a if a > b else b) + 1
        waves[n] = last_user[u] = last_item[i] = wave
    return waves


def sequential(p, q, p_acc, q_acc, users, items, ratings, waves, rate, penalty, precision, adaptive):
    """One-record-at-a-time descent over a block, in place, wave by wave."""
    store = rounder(precision)
    kind = arithmetic_type(precision)
    rate, penalty = kind(rate), kind(penalty)
    order = np.argsort(waves, kind="stable")
    bounds = np.flatnonzero(np.diff(waves[order])) + 1
    for chunk in np.split(order, bounds) if len(order) else []:
        u, i = users[chunk], items[chunk]
        pu, qi = p[u], q[i]
        error = (np.einsum("nk,nk->n", pu, qi) - ratings[chunk])[:, None]
        pg = penalty * pu + error * qi
        qg = penalty * qi + error * pu
        if adaptive:
            p_sum, q_sum = p_acc[u] + pg * pg, q_acc[i] + qg * qg
            p[u] = store(pu - _adaptive_step(rate, pg, p_sum))
            q[i] = store(qi - _adaptive_step(rate, qg, q_sum))
            p_acc[u], q_acc[i] = store(p_sum), store(q_sum)
        else:
            p[u] = store(pu - rate * pg)
            q[i] = store(qi - rate * qg)


def _adaptive_step(rate, gradient, history):
    """``rate / sqrt(history) * gradient``; a zero gradient without history moves nothing."""
    root = np.sqrt(history)
    return np.divide(rate, root, out=np.zeros_like(root), where=root > 0) * gradient


def batched(p, q, users, items, ratings, batch_size, rate, penalty, precision):
    """Mini-batches of consecutive records, in place; each touched row moves once per batch."""
    store = rounder(precision)
    kind = arithmetic_type(precision)
    rate, penalty = kind(rate), kind(penalty)
    for start in range(0, len(users), batch_size):
        u, i = users[start:start + batch_size], items[start:start + batch_size]
        pu, qi = p[u], q[i]
        error = (np.einsum("nk,nk->n", pu, qi) - ratings[start:start + batch_size])[:, None]
        for rows, ids, terms in ((p, u, error * qi), (q, i, error * pu)):
            touched, where = np.unique(ids, return_inverse=True)
            total = np.zeros((len(touched), terms.shape[1]), dtype=terms.dtype)
            np.add.at(total, where, terms)
            before = rows[touched]
            rows[touched] = store(before - rate * (total + penalty * before))
