"""Linear assignment: least total cost of a one-to-one match, for one matrix or for many at once."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a match of least cost; rows must not outnumber columns.

    Shortest augmenting paths with potentials. Plain lists: for a dozen rows they beat array calls several times.
    """
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    rows = cost.tolist()
    row_price, col_price = [0.0] * n, [0.0] * m
    owner = [-1] * m  # row of each column
    for start in range(n):
        slack, via, done = [float("inf")] * m, [-1] * m, [False] * m
        row, last = start, -1
        while True:
            costs, base, step, nxt = rows[row], row_price[row], float("inf"), -1
            for j in range(m):
                if not done[j]:
                    s = costs[j] - base - col_price[j]
                    if s < slack[j]:
                        slack[j], via[j] = s, last
                    if slack[j] < step:
                        step, nxt = slack[j], j
            row_price[start] += step
            for j in range(m):
                if done[j]:
                    row_price[owner[j]] += step
                    col_price[j] -= step
                else:
                    slack[j] -= step
            done[nxt], last = True, nxt
            if owner[nxt] < 0:
                break
            row = owner[nxt]
        while last >= 0:
            before = via[last]
            owner[last] = owner[before] if before >= 0 else start
            last = before
    out = np.empty(n, int)
    for j, i in enumerate(owner):
        if i >= 0:
            out[i] = j
    return out


def assign_many(cost: np.ndarray) -> np.ndarray:
    """``assign`` of each of the matrices (problems, rows, columns): the same matches, all problems a step at a time."""
    problems, n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    row_price, col_price = np.zeros((problems, n)), np.zeros((problems, m))
    owner = np.full((problems, m), -1)
    every = np.arange(problems)
    for start in range(n):
        slack, via, done = np.full((problems, m), np.inf), np.full((problems, m), -1), np.zeros((problems, m), bool)
        row, last, live = np.full(problems, start), np.full(problems, -1), every
        while len(live):
            s = cost[live, row[live]] - row_price[live, row[live]][:, None] - col_price[live]
            open_ = ~done[live]
            better = open_ & (s < slack[live])
            slack[live] = np.where(better, s, slack[live])
            via[live] = np.where(better, last[live][:, None], via[live])
            reach = np.where(open_, slack[live], np.inf)
            nxt = reach.argmin(1)
            step = reach[np.arange(len(live)), nxt][:, None]
            row_price[live, start] += step[:, 0]
            p, j = np.nonzero(~open_)
            row_price[live[p], owner[live[p], j]] += step[p, 0]
            col_price[live] -= np.where(open_, 0.0, step)
            slack[live] -= np.where(open_, step, 0.0)
            done[live, nxt], last[live] = True, nxt
            row[live] = owner[live, nxt]
            live = live[row[live] >= 0]
        back = every
        while len(back):
            before = via[back, last[back]]
            owner[back, last[back]] = np.where(before >= 0, owner[back, before], start)
            last[back] = before
            back = back[before >= 0]
    out = np.empty((problems, n), int)
    p, j = np.nonzero(owner >= 0)
    out[p, owner[p, j]] = j
    return out
