"""Forests grown to purity, many fits and all their trees at a time.

A tree sees every row a number of times drawn from a hash of (row, tree), as in a Poisson bootstrap, and
at every node the first ``sqrt(d)`` of the features that still vary, in an order hashed from the node's
path. Both hold on any layout of the table. Nodes are split until they are pure or their rows agree in
all features; depth has no limit.

A table of checked size is broadcast, and tasks grow whole trees on it. Beyond that the top of all trees
grows level by level: one scan counts labels by (feature, bin), a task adds them up by (job, tree, node), and
Spark chooses the splits node by node. Rows of nodes that have become small are then shuffled by (job, tree,
node), and each such group is finished on its exact values; the same scan settles the cuts of the tops.

Grown trees stay in the checkpoint folder, one row each; the driver takes their gains. A small forest is
sent to the tasks that predict, blocks of rows meet a larger one part by part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.operators import blocks, fitting
from scarpline.operators.columns import quoted
from scarpline.operators.fitting import Job, Rows
from scarpline.session import cut_lineage

# Chances of drawing a row at most 0, 1, 2, ... times.
_DRAWS = np.cumsum(np.exp(-1.0) / np.cumprod([1, *range(1, 16)]))
# The number of draws by the first 12 bits of a share, at their least and most.
_LEAST = np.searchsorted(_DRAWS, np.arange(1 << 12) / (1 << 12), side="right")
_MOST = np.searchsorted(_DRAWS, np.nextafter(np.arange(1, (1 << 12) + 1) / (1 << 12), 0), side="right")
# A model of at most this many bytes is sent to every task that predicts.
MODEL_BYTES = 1 << 24
# Beyond that, parts of at least so many bytes meet blocks of about so many rows in a task.
PART_BYTES = 1 << 22
PART_ROWS = 1 << 19
# Rows of nodes that are finished together, few enough for a core's cache.
BLOCK = 1 << 18
# Rows of a table beyond the bound that a task works on at a time.
CHUNK = 1 << 17
# Two sums of weights share 64 bits.
ONES = 32
# Up to so many features are put in order by comparing each with each.
FEW = 12
# A node of at most so many feature values is finished in one task.
FINISH_CELLS = 1 << 24
# In the place of a node: the extremes of the rows of a top's leaves.
ENDS = -2
# Counts that a task holds before it passes them on.
HELD = 1 << 22
UNIT = float(1 << 50)  # shares of ones are added as integers
STORED = "job int, tree int, nodes binary, gains array<double>"


def hashed(values: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """64 well-mixed bits of each value and the seed."""
    out = np.asarray(values).astype(np.uint64) ^ (np.asarray(seed).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for _ in range(2):
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def draws(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree sees each row."""
    share = hashed(key, seed * 1_000_003 + tree + 1) >> np.uint64(11)
    first = (share >> np.uint64(41)).astype(np.intp)
    out = _LEAST.take(first)
    unclear = np.flatnonzero((_LEAST < _MOST).take(first))
    out[unclear] = np.searchsorted(_DRAWS, share[unclear] / float(1 << 53), side="right")
    return out


def root_path(tree: int, seed: int) -> int:
    return int(hashed(np.array([tree + 1]), seed + 7)[0])


def child_paths(paths: np.ndarray) -> np.ndarray:
    """Paths of the left and right children, side by side."""
    return np.stack([hashed(paths, 1), hashed(paths, 2)], axis=1).ravel()


def eligible(paths: np.ndarray, varies: np.ndarray, tried: int) -> np.ndarray:
    """Which features each node may split: the first ``tried`` that vary, in the order of its path."""
    order = hashed(paths[:, None], np.arange(varies.shape[1])[None, :] + 11).astype(np.float64)
    order[~varies] = np.inf
    if varies.shape[1] > FEW:
        place = np.argsort(np.argsort(order, axis=1, kind="stable"), axis=1, kind="stable")
        return varies & (place < tried)
    out = np.empty(varies.shape, dtype=bool)
    columns = np.ascontiguousarray(order.T)
    for f, mine in enumerate(columns):  # how many come before it, the earlier ones on ties
        place = sum(((other <= mine) if g < f else (other < mine)).astype(np.int8)
                    for g, other in enumerate(columns) if g != f)
        out[:, f] = varies[:, f] & (place < tried)
    return out


@dataclass(frozen=True)
class Grown:
    """A tree: per node the feature (-1: leaf), cut, left child (the right one follows) and share of ones."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gains: np.ndarray

    def place(self, x: np.ndarray) -> np.ndarray:
        flat, out = np.ascontiguousarray(x).ravel(), np.zeros(len(x), dtype=np.int64)
        cell, here = np.arange(len(x)) * x.shape[1], out.copy()  # of the rows at inner nodes: first value, node
        while True:
            feature = self.feature.take(here)
            inner = np.flatnonzero(feature >= 0)
            if len(inner) < len(here):
                ended = np.flatnonzero(feature < 0)
                out[cell.take(ended) // x.shape[1]] = here.take(ended)
                cell, here, feature = cell.take(inner), here.take(inner), feature.take(inner)
            if not len(here):
                return out
            here = self.left.take(here) + (flat.take(cell + feature) >= self.cut.take(here))

    def depth(self) -> int:
        level = np.zeros(len(self.feature), dtype=np.int64)
        for node in np.flatnonzero(self.feature >= 0):
            level[self.left[node]:self.left[node] + 2] = level[node] + 1
        return int(level.max())


def grow(x: np.ndarray, label: np.ndarray, weight: np.ndarray, allowed: np.ndarray, tried: int, path: int,
         max_depth: int | None = None) -> Grown:
    """One tree on exact values, level by level, the rows of every feature kept in (node, value) order.

    The split of least weighted Gini impurity wins, then the first feature, then the lowest cut. Nodes that
    together have at most ``BLOCK`` rows are finished before the others, so that their rows stay in cache.
    """
    use = np.flatnonzero(weight > 0)
    weight, label = weight[use].astype(np.int64), label[use].astype(np.int64)
    values, ranks, orders = [], [], []
    for f in range(x.shape[1]):
        column = x[use, f]
        order = np.argsort(column, kind="stable")
        inside = column[order]
        new = np.r_[False, inside[1:] != inside[:-1]]
        rank = np.empty(len(use), dtype=np.int32)
        rank[order] = np.cumsum(new, dtype=np.int32)
        new[:1] = True
        values.append(inside[new])
        ranks.append(rank)
        orders.append(order)
    gains, size = np.zeros(x.shape[1]), 1
    whole, ones = float(weight.sum()), float((weight * label).sum())
    nodes: list[tuple[np.ndarray, ...]] = []  # number, feature, cut, left child and share of ones
    first = _Open(np.array([0]), np.array([path], dtype=np.uint64), np.array([len(use)]), np.array([whole]),
                  np.array([ones]), orders, np.array(ranks), weight + (weight * label << ONES), 0)
    todo = [first] if 0 < ones < whole else []
    if not todo:
        nodes.append((first.number, np.full(1, -1), np.zeros(1), np.zeros(1, np.int64), first.ones / max(whole, 1)))
    while todo:
        level = todo.pop()
        if max_depth is not None and level.depth >= max_depth:
            none = np.zeros(len(level.number), dtype=np.int64)
            nodes.append((level.number, none - 1, none * 0.0, none, level.ones / level.whole))
            continue
        found, leaves, size, below = level.split(values, allowed, tried, gains, size)
        nodes += [found, leaves]
        todo += below.blocks()
    number, *parts = (np.concatenate(p) for p in zip(*nodes, strict=True))
    place = np.argsort(number, kind="stable")
    return Grown(*(p[place] for p in parts), gains)


def _purity(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight of all, of ones, and the share of squares of sides given by packed weights."""
    one = (weight >> ONES).astype(np.float64)
    whole = (weight & ((1 << ONES) - 1)).astype(np.float64)
    zero = whole - one
    return whole, one, (one * one + zero * zero) / whole


@dataclass(frozen=True)
class _Open:
    """Nodes of one level that hold both labels, and their rows; per feature the rows by (node, value)."""

    number: np.ndarray
    path: np.ndarray
    sizes: np.ndarray
    whole: np.ndarray
    ones: np.ndarray
    orders: list[np.ndarray]
    ranks: np.ndarray  # (feature, row)
    weight: np.ndarray  # of all, and from bit ``ONES`` on that of ones
    depth: int

    def split(self, values: list[np.ndarray], allowed: np.ndarray, tried: int, gains: np.ndarray, size: int
              ) -> tuple[tuple, tuple, int, _Open]:
        """The nodes, their children that hold one label only, the next free number, and the other children."""
        k, d = len(self.number), len(self.orders)
        ends = np.cumsum(self.sizes)
        starts = ends - self.sizes
        varies = np.zeros((k, d), dtype=bool)
        for f in np.flatnonzero(allowed):
            varies[:, f] = self.ranks[f][self.orders[f][starts]] < self.ranks[f][self.orders[f][ends - 1]]
        may = eligible(self.path, varies, tried)
        score, chosen = np.full(k, -np.inf), np.full(k, -1)
        cut, last = np.zeros(k), np.zeros(k, dtype=np.int32)  # and the last rank of the left side
        n_left, one_left, left_size = np.zeros(k), np.zeros(k), np.zeros(k, dtype=np.int64)
        for f in np.flatnonzero(may.any(axis=0)):
            mine = np.flatnonzero(may[:, f])
            order, sizes = self.orders[f], self.sizes[mine]
            if len(mine) < k:
                order = order.take(np.flatnonzero(np.repeat(may[:, f], self.sizes)))
            stop = np.cumsum(sizes)
            rank = self.ranks[f].take(order)
            edge = rank[1:] != rank[:-1]
            edge[stop[:-1] - 1] = False
            at = np.flatnonzero(edge)  # the last row left of every cut
            total = np.cumsum(self.weight.take(order))
            below = total.take(at)
            upto = np.searchsorted(at, stop)
            begins = np.r_[0, upto[:-1]]
            cuts = upto - begins
            ending = total[stop - 1]
            left, left_one, purity = _purity(below - np.repeat(np.r_[0, ending[:-1]], cuts))
            purity += _purity(np.repeat(ending, cuts) - below)[2]
            best = np.maximum.reduceat(purity, begins)
            hit = np.flatnonzero(purity == np.repeat(best, cuts))
            hit = hit[np.searchsorted(hit, begins)]  # the lowest cut of every node
            better = best > score[mine]
            hit, nodes = hit[better], mine[better]
            row = at[hit]
            score[nodes], chosen[nodes] = best[better], f
            last[nodes] = rank[row]
            cut[nodes] = fitting.between(values[f][rank[row]], values[f][rank[row + 1]])
            n_left[nodes], one_left[nodes] = left[hit], left_one[hit]
            left_size[nodes] = row + 1 - (stop - sizes)[better]
        split = np.flatnonzero(chosen >= 0)
        parent = (self.ones**2 + (self.whole - self.ones) ** 2) / self.whole
        gains += np.bincount(chosen[split], weights=(score - parent)[split], minlength=d)
        left_child = np.zeros(k, dtype=np.int64)
        left_child[split] = size + 2 * np.arange(len(split))
        found = (self.number, chosen, cut, left_child, self.ones / self.whole)
        # Children: all left ones, then all right ones.
        whole = np.r_[n_left[split], (self.whole - n_left)[split]]
        ones = np.r_[one_left[split], (self.ones - one_left)[split]]
        number = np.r_[left_child[split], left_child[split] + 1]
        sizes = np.r_[left_size[split], (self.sizes - left_size)[split]]
        open_ = (ones > 0) & (ones < whole)
        leaf = np.flatnonzero(~open_)
        leaves = (number[leaf], np.full(len(leaf), -1), np.zeros(len(leaf)), np.zeros(len(leaf), np.int64),
                  ones[leaf] / whole[leaf])
        # Rows of open children move on, each side in its order.
        goes = np.full((k, 2), 2, dtype=np.uint8)
        goes[split] = np.where(open_.reshape(2, -1).T, np.array([0, 1], dtype=np.uint8), np.uint8(2))
        first, rows = self.orders[0], self.ranks.shape[1]
        right_side = self.ranks.ravel().take(
            first + np.repeat(np.maximum(chosen, 0) * rows, self.sizes)) > np.repeat(last, self.sizes)
        side = np.empty(rows, dtype=np.uint8)
        side[first] = np.where(right_side, np.repeat(goes[:, 1], self.sizes), np.repeat(goes[:, 0], self.sizes))
        orders = []
        for order in self.orders:
            to = side.take(order)
            orders.append(order.take(np.concatenate([np.flatnonzero(to == 0), np.flatnonzero(to == 1)])))
        paths = child_paths(self.path[split]).reshape(-1, 2).T.ravel()
        below = _Open(number[open_], paths[open_], sizes[open_], whole[open_], ones[open_], orders,
                      self.ranks, self.weight, self.depth + 1)
        return found, leaves, size + 2 * len(split), below

    def blocks(self) -> list[_Open]:
        """These nodes in groups of at most ``BLOCK`` rows, a larger node alone; rows are numbered anew."""
        k = len(self.number)
        if not k:
            return []
        ends = np.cumsum(self.sizes)
        if self.ranks.shape[1] <= BLOCK:
            return [self]
        if ends[-1] <= BLOCK:
            bounds = [0, k]
        else:
            bounds = [0]
            while bounds[-1] < k:
                begin = bounds[-1]
                fits = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + BLOCK, side="right"))
                bounds.append(max(begin + 1, fits))
        if len(bounds) == 2 and 2 * ends[-1] > self.ranks.shape[1]:
            return [self]
        new, out = np.empty(self.ranks.shape[1], dtype=np.int64), []
        for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
            low, high = (ends[begin - 1] if begin else 0), ends[end - 1]
            rows = self.orders[0][low:high]
            new[rows] = np.arange(len(rows))
            part = slice(begin, end)
            out.append(_Open(
                self.number[part], self.path[part], self.sizes[part], self.whole[part], self.ones[part],
                [new[order[low:high]] for order in self.orders], self.ranks.take(rows, axis=1), self.weight[rows], self.depth))
        return out


def packed(tree: Grown) -> bytes:
    """The nodes as bytes: cuts and children of inner nodes, shares of leaves that hold both labels."""
    inner = tree.feature >= 0
    share = tree.value[~inner]
    pure = (share == 0) | (share == 1)
    listed, which = np.unique(share[~pure], return_inverse=True)
    kind = tree.feature.astype(np.int16)
    kind[~inner] = np.where(pure, np.where(share > 0, -2, -1), -3)
    small = len(listed) <= 1 << 16
    sizes = np.array([len(kind), inner.sum(), len(listed), small], dtype=np.int64)
    return b"".join(part.tobytes() for part in (
        sizes, tree.cut[inner], listed, tree.left[inner].astype(np.int32),
        which.astype(np.uint16 if small else np.uint32), kind))


def unpacked(data: bytes, gains: list[float]) -> Grown:
    """The tree of these bytes; inner nodes have no share of ones."""
    n, n_inner, n_listed, small = np.frombuffer(data, np.int64, 4).tolist()
    at = 32
    cuts, listed = np.split(np.frombuffer(data, np.float64, n_inner + n_listed, at), [n_inner])
    at += 8 * (n_inner + n_listed)
    lefts = np.frombuffer(data, np.int32, n_inner, at)
    kind = np.frombuffer(data, np.int16, n, len(data) - 2 * n)
    which = np.frombuffer(data[at + 4 * n_inner:len(data) - 2 * n], np.uint16 if small else np.uint32)
    inner = kind >= 0
    cut, left, value = np.zeros(n), np.zeros(n, dtype=np.int64), (kind == -2).astype(np.float64)
    cut[inner], left[inner] = cuts, lefts
    value[kind == -3] = listed.take(which)
    return Grown(np.maximum(kind, -1).astype(np.int64), cut, left, value, np.array(gains))


@dataclass(frozen=True)
class Forest:
    """The trees of a job as stored rows (tree, nodes, gains), the bytes of their nodes, and their gains."""

    stored: DataFrame
    size: int
    gains: list[np.ndarray]

    @property
    def trees(self) -> list[Grown]:
        """All trees in the driver; for models of a known small size."""
        rows = self.stored.toArrow().sort_by("tree").to_pylist()
        return [unpacked(r["nodes"], r["gains"]) for r in rows]

    @property
    def importances(self) -> np.ndarray:
        """Mean of the trees' shares of impurity decrease."""
        shares = [g / g.sum() for g in self.gains if g.sum() > 0]
        mean = np.sum(shares, axis=0) if shares else np.zeros(len(self.gains[0]))
        return mean / mean.sum() if mean.sum() > 0 else mean


def _forests(stored: DataFrame, jobs: int) -> list[Forest]:
    """Forests of the checkpointed trees of all jobs."""
    found = stored.select("job", "tree", "gains", F.length("nodes").alias("size")).toArrow().to_pylist()
    found.sort(key=lambda r: (r["job"], r["tree"]))
    out = []
    for k in range(jobs):
        mine = [r for r in found if r["job"] == k]
        out.append(Forest(stored.where(F.col("job") == k), sum(r["size"] for r in mine),
                          [np.array(r["gains"]) for r in mine]))
    return out


def _tried(job: Job) -> int:
    return max(1, isqrt(len(job.features)))


def plant(table: DataFrame, features: list[str], jobs: list[Job], trees: int, seed: int,
          max_depth: int | None = None, cells: int | None = None, bins: int = 256) -> list[Forest]:
    """A forest for every job; ``cells`` bounds the table that is broadcast, and a node finished in one task."""
    spark, n = table.sparkSession, len(features)
    rows = fitting.held_locally(table, n, cells)
    allowed = [np.array([f in job.features for f in features]) for job in jobs]
    if rows is not None:
        for job in jobs:
            if len(np.unique(rows.label[rows.seen_by(job)])) < 2:
                raise ValueError("a binary target is needed, found one class")
        sent = spark.sparkContext.broadcast(rows)

        def one(number: int) -> Iterator[tuple]:
            k, tree = divmod(number, trees)
            held = sent.value
            weight = draws(held.key, tree, seed) * held.seen_by(jobs[k])
            grown = grow(held.x, held.label, weight, allowed[k], _tried(jobs[k]), root_path(tree, seed), max_depth)
            yield k, tree, packed(grown), grown.gains.tolist()

        stored = cut_lineage(fitting.spread(spark, list(range(len(jobs) * trees)), one, STORED).drop("number"))
        sent.destroy()
        return _forests(stored, len(jobs))
    return _Tops(table, jobs, allowed, trees, seed, max_depth, cells, bins).forests()


class _Tops:
    """Tops of all trees over a table beyond the bound, and the groups of rows that finish them."""

    def __init__(self, table: DataFrame, jobs: list[Job], allowed: list[np.ndarray], trees: int, seed: int,
                 max_depth: int | None, cells: int | None, bins: int) -> None:
        self.table, self.jobs, self.allowed, self.trees, self.seed = cut_lineage(table), jobs, allowed, trees, seed
        self.n = len(allowed[0])
        self.small = max(1, (FINISH_CELLS if cells is None else cells) // self.n)
        self.max_depth = max_depth
        # Bins follow the number of small nodes, so that a bin holds less than one of them.
        rows = self.table.count()
        self.cuts = fitting.cut_points(
            fitting.sampled(self.table, None, self.n), int(min(max(bins, 4 * rows // self.small), fitting.SAMPLE)))
        self.width = max(len(c) for c in self.cuts) + 1
        top = Grown(np.array([-1]), np.zeros(1), np.zeros(1, np.int64), np.zeros(1), np.zeros(self.n))
        self.tops = {(k, t): top for k in range(len(jobs)) for t in range(trees)}
        self.paths = {(k, t): {0: root_path(t, seed)} for k, t in self.tops}
        self.open = {(k, t): [0] for k, t in self.tops}  # nodes to split by histogram
        self.finish: dict[tuple[int, int], list[int]] = {kt: [] for kt in self.tops}

    def forests(self) -> list[Forest]:
        level = 0
        while any(self.open.values()) and (self.max_depth is None or level < self.max_depth):
            self._level()
            level += 1
        for kt, nodes in self.open.items():  # a bound on depth was reached
            self.open[kt] = []
        return _forests(cut_lineage(self._grafted(self._ended())), len(self.jobs))

    def _grafted(self, grafts: DataFrame) -> DataFrame:
        """One row per tree: its top with the finished subtrees, put together in one group."""
        tops = self.table.sparkSession.sparkContext.broadcast(self.tops)
        every = self.table.sparkSession.createDataFrame(
            [(k, t, -1, None, None) for k, t in self.tops],
            "job int, tree int, node long, nodes binary, gains array<double>")

        def whole(group: pa.Table) -> pa.Table:
            k, t = group.column("job")[0].as_py(), group.column("tree")[0].as_py()
            top, found = tops.value[k, t], []
            for row in group.to_pylist():
                if row["node"] >= 0:
                    found.append((row["node"], unpacked(row["nodes"], row["gains"])))
                elif row["nodes"] is not None:
                    top = _settled(top, row["nodes"])
            tree = _grafted(top, found)
            return pa.table({
                "job": pa.array([k], pa.int32()), "tree": pa.array([t], pa.int32()),
                "nodes": pa.array([packed(tree)], pa.binary()),
                "gains": pa.array([tree.gains.tolist()], pa.list_(pa.float64()))})

        return every.unionByName(grafts).groupBy("job", "tree").applyInArrow(whole, STORED)

    def _rows_of(self, nodes: dict[tuple[int, int], list[int]], whole: bool = False):
        """Per chunk of rows, and per tree with some of the given nodes: (job, tree, the rows in them, draws, nodes).

        ``whole``: of every tree that has a split, all rows with their nodes.
        """
        jobs, seed = self.jobs, self.seed
        tops = {kt: self.tops[kt] for kt, wanted in nodes.items() if wanted or whole and len(self.tops[kt].feature) > 1}
        sent = self.table.sparkSession.sparkContext.broadcast((tops, nodes))

        def each(rows: Rows) -> Iterator[tuple]:
            tops, wanted = sent.value
            drawn: dict[int, np.ndarray] = {}
            seen = {job.held_out: rows.seen_by(job) for job in jobs}
            for k, t in sorted(tops, key=lambda kt: kt[::-1]):
                if t not in drawn:
                    drawn = {t: draws(rows.key, t, seed)}
                mine = np.flatnonzero((drawn[t] > 0) & seen[jobs[k].held_out])
                top = tops[k, t]
                is_wanted = np.zeros(len(top.feature), dtype=bool)
                is_wanted[wanted[k, t]] = True
                if len(is_wanted) > 1:
                    node = top.place(rows.x.take(mine, axis=0))
                    if not whole:
                        inside = np.flatnonzero(is_wanted.take(node))
                        mine, node = mine.take(inside), node.take(inside)
                else:
                    node = np.zeros(len(mine), dtype=np.int64)
                if len(mine):
                    yield k, t, mine, drawn[t][mine], node
        return each

    def _level(self) -> None:
        each, cuts, width, n = self._rows_of(self.open), self.cuts, self.width, self.n
        size = 2 * width  # cells of a node and feature

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[tuple[int, int, int], np.ndarray] = {}
            for rows in fitting.chunks(batches, n, CHUNK):
                columns = np.ascontiguousarray((2 * fitting.codes_of(rows.x, cuts).astype(np.intp) + rows.label[:, None]).T)
                for k, t, mine, weight, node in each(rows):
                    there = np.bincount(node) > 0
                    found, weight = np.flatnonzero(there), weight.astype(np.float64)
                    base = (np.cumsum(there) - 1).take(node) * size
                    count = np.stack([np.bincount(column.take(mine) + base, weights=weight, minlength=len(found) * size)
                                      .reshape(len(found), size) for column in columns], axis=1)
                    for at, own in zip(found.tolist(), count, strict=True):
                        held = totals.get((k, t, at))
                        totals[k, t, at] = own if held is None else held + own
                if len(totals) * n * size > HELD:
                    yield sums(totals)
                    totals = {}
            if totals:
                yield sums(totals)

        def sums(totals: dict[tuple[int, int, int], np.ndarray]) -> pa.RecordBatch:
            job, tree, node = zip(*totals, strict=True)
            return pa.RecordBatch.from_arrays([
                pa.array(job, pa.int32()), pa.array(tree, pa.int32()), pa.array(node, pa.int64()),
                pa.array([own.astype(np.int64).tobytes() for own in totals.values()], pa.binary())],
                ["job", "tree", "node", "counts"])

        allowed, tried = self.allowed, [_tried(job) for job in self.jobs]
        paths = self.table.sparkSession.sparkContext.broadcast(self.paths)

        def chosen(group: pa.Table) -> pa.Table:
            k, t, node = (group.column(c)[0].as_py() for c in ("job", "tree", "node"))
            count = sum(np.frombuffer(c.as_buffer(), np.int64) for c in group.column("counts")).reshape(n, width, 2)
            feature, at, *found = _histogram_split(count, allowed[k], tried[k], paths.value[k, t][node])
            cut = float(cuts[feature][at]) if feature >= 0 else 0.0  # settled on the node's own values in the end
            whole = count[0].sum(axis=0)
            row = (k, t, node, feature, cut, *found, int(whole.sum()), int(whole[1]))
            return pa.table({f.name: pa.array([v], f.type) for f, v in zip(arrow, row, strict=True)})

        schema = ("job int, tree int, node long, feature int, cut double, gain double, n_left long, ones_left long, "
                  "n long, ones long")
        arrow = pa.schema([(name, {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[kind])
                           for name, kind in (part.split() for part in schema.split(", "))])
        splits = self.table.mapInArrow(counted, "job int, tree int, node long, counts binary").groupBy(
            "job", "tree", "node").applyInArrow(chosen, schema).toArrow().to_pylist()
        opened = {kt: [] for kt in self.tops}
        by_tree: dict[tuple[int, int], list[dict]] = {}
        for row in splits:
            by_tree.setdefault((row["job"], row["tree"]), []).append(row)
        for kt, found in by_tree.items():
            top = self.tops[kt]
            feature, cut, left, value = (a.tolist() for a in (top.feature, top.cut, top.left, top.value))
            gains = top.gains.copy()
            for row in sorted(found, key=lambda r: r["node"]):
                node = row["node"]
                value[node] = row["ones"] / row["n"]
                if row["n"] <= self.small or row["feature"] < 0:
                    if 0 < row["ones"] < row["n"]:
                        self.finish[kt].append(node)
                    continue
                feature[node], left[node] = row["feature"], len(feature)
                cut[node] = row["cut"]
                gains[row["feature"]] += row["gain"]
                sides = [(row["n_left"], row["ones_left"]), (row["n"] - row["n_left"], row["ones"] - row["ones_left"])]
                both = child_paths(np.array([self.paths[kt][node]], dtype=np.uint64))
                for side, (size, ones) in enumerate(sides):
                    child = len(feature)
                    self.paths[kt][child] = int(both[side])
                    feature.append(-1)
                    cut.append(0.0)
                    left.append(0)
                    value.append(ones / size)
                    if 0 < ones < size:
                        (opened if size > self.small else self.finish)[kt].append(child)
            self.tops[kt] = Grown(np.array(feature), np.array(cut), np.array(left), np.array(value), gains)
        self.open = opened

    def _grafts(self) -> DataFrame:
        """Finished subtrees of all small nodes."""
        return self._ended().where(F.col("node") != ENDS)

    def _ended(self) -> DataFrame:
        """Finished subtrees of all small nodes; their rows are shuffled by (job, tree, node), in short blocks.

        Node ``ENDS`` stands for the extremes of the top's leaves by feature, which settle its cuts.
        """
        each, n = self._rows_of(self.finish, whole=True), self.n
        finish = {kt: np.array(nodes) for kt, nodes in self.finish.items()}
        allowed, tried = self.allowed, [_tried(job) for job in self.jobs]
        paths = self.table.sparkSession.sparkContext.broadcast(self.paths)
        tops = self.table.sparkSession.sparkContext.broadcast(self.tops)
        max_depth = self.max_depth

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in fitting.chunks(batches, n, CHUNK):
                x = np.column_stack([rows.x, rows.label])
                layout = blocks.Layout.of(x)
                words, head = layout.words(x), layout.head()
                by_word = np.argsort(words[0], kind="stable")  # so are the rows of every node
                words, rows = words.take(by_word, axis=1), rows.take(by_word)
                for k, t, mine, weight, node in each(rows):
                    order = np.argsort(node.astype(np.uint16) if node.max() < 1 << 16 else node, kind="stable")
                    node, own = node.take(order), mine.take(order)
                    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
                    parts = []
                    for at, part, drawn in zip(node[starts], np.split(own, starts[1:]),
                                               np.split(weight.take(order), starts[1:]), strict=True):
                        if at in finish[k, t]:
                            parts.append((at, _halved(drawn), blocks.packed(head, words.take(part, axis=1))))
                    if len(tops.value[k, t].feature) > 1:
                        inside = rows.x.take(own, axis=0)
                        parts.append((ENDS, node[starts].astype(np.int64).tobytes(), np.stack(
                            [np.minimum.reduceat(inside, starts), np.maximum.reduceat(inside, starts)]).tobytes()))
                    if not parts:
                        continue
                    found, drawn, values = zip(*parts, strict=True)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(found), k, np.int32)), pa.array(np.full(len(found), t, np.int32)),
                        pa.array(found, pa.int64()), pa.array(drawn, pa.binary()), pa.array(values, pa.binary()),
                    ], ["job", "tree", "node", "drawn", "x"])

        def finished(group: pa.Table) -> pa.Table:
            k, t, node = (group.column(c)[0].as_py() for c in ("job", "tree", "node"))
            if node == ENDS:
                return pa.table({
                    "job": pa.array([k], pa.int32()), "tree": pa.array([t], pa.int32()), "node": pa.array([node], pa.int64()),
                    "nodes": pa.array([_extremes(group, len(tops.value[k, t].feature), n).tobytes()], pa.binary()),
                    "gains": pa.array([[]], pa.list_(pa.float64()))})
            parts = [blocks.unpacked(v.as_buffer()) for v in group.column("x")]
            drawn = np.concatenate([_whole(d.as_buffer(), len(p)) for d, p in zip(group.column("drawn"), parts, strict=True)])
            x, label = np.concatenate([p[:, :n] for p in parts]), np.concatenate([p[:, n] for p in parts]).astype(np.int64)
            del parts
            deep = 0 if max_depth is None else _level_of(tops.value[k, t], node)
            grown = grow(x, label, drawn, allowed[k], tried[k], paths.value[k, t][node],
                         None if max_depth is None else max_depth - deep)
            return pa.table({
                "job": pa.array([k], pa.int32()), "tree": pa.array([t], pa.int32()), "node": pa.array([node], pa.int64()),
                "nodes": pa.array([packed(grown)], pa.binary()),
                "gains": pa.array([grown.gains.tolist()], pa.list_(pa.float64()))})

        groups = self.table.mapInArrow(
            sent, "job int, tree int, node long, drawn binary, x binary").groupBy("job", "tree", "node")
        return groups.applyInArrow(
            finished, "job int, tree int, node long, nodes binary, gains array<double>")


def _extremes(group: pa.Table, nodes: int, n: int) -> np.ndarray:
    """(node, feature, least and largest) of what chunks of rows gave by their leaves."""
    low, high = np.full((nodes, n), np.inf), np.full((nodes, n), -np.inf)
    for found, ends in zip(group.column("drawn"), group.column("x"), strict=True):
        at = np.frombuffer(found.as_buffer(), np.int64)
        own = np.frombuffer(ends.as_buffer()).reshape(2, len(at), n)
        low[at], high[at] = np.minimum(low[at], own[0]), np.maximum(high[at], own[1])
    return np.stack([low, high], axis=2)


def _settled(top: Grown, ends: bytes) -> Grown:
    """The top with every cut half-way between the values next to it that its node holds."""
    cut = top.cut.copy()
    low, high = np.moveaxis(np.frombuffer(ends).reshape(len(cut), -1, 2), 2, 0).copy()
    for node in np.flatnonzero(top.feature >= 0)[::-1]:  # children come after their parents
        f, left = top.feature[node], top.left[node]
        cut[node] = fitting.between(high[left, f], low[left + 1, f])
        low[node], high[node] = low[left:left + 2].min(axis=0), high[left:left + 2].max(axis=0)
    return Grown(top.feature, cut, top.left, top.value, top.gains)


def _halved(drawn: np.ndarray) -> bytes:
    """Draws of 1 to 16 times, two to a byte."""
    less = np.append(drawn - 1, 0)[:len(drawn) + len(drawn) % 2].astype(np.uint8)
    return (less[::2] | less[1::2] << 4).tobytes()


def _whole(data: memoryview, rows: int) -> np.ndarray:
    both = np.frombuffer(data, np.uint8)
    return np.stack([both & 15, both >> 4], axis=1).ravel()[:rows].astype(np.int64) + 1


def _level_of(tree: Grown, node: int) -> int:
    level = 0
    while node:
        node = int(np.flatnonzero((tree.feature >= 0) & ((tree.left == node) | (tree.left + 1 == node)))[0])
        level += 1
    return level


def _histogram_split(count: np.ndarray, allowed: np.ndarray, tried: int, path: int
                     ) -> tuple[int, int, float, int, int]:
    """(feature or -1, bin, gain, rows and ones at or below the bin) by counts (feature, bin, label)."""
    below = np.cumsum(count, axis=1)
    whole = below[0, -1].astype(np.float64)
    varies = allowed & ((count.sum(axis=2) > 0).sum(axis=1) > 1)
    may = eligible(np.array([path], dtype=np.uint64), varies[None, :], tried)[0]
    left = below.astype(np.float64)
    right = whole - left
    n_left, n_right = left.sum(axis=2), right.sum(axis=2)
    valid = (n_left > 0) & (n_right > 0) & may[:, None]
    if not valid.any() or not whole.all():
        return -1, 0, 0.0, 0, 0
    purity = np.full(valid.shape, -np.inf)
    purity[valid] = (left[valid] ** 2).sum(axis=1) / n_left[valid] + (right[valid] ** 2).sum(axis=1) / n_right[valid]
    feature, at = np.unravel_index(np.argmax(purity), purity.shape)
    gain = purity[feature, at] - (whole**2).sum() / whole.sum()
    return int(feature), int(at), float(gain), int(below[feature, at].sum()), int(below[feature, at, 1])


def _grafted(top: Grown, grafts: list[tuple[int, Grown]]) -> Grown:
    """The top with every finished subtree in the place of its leaf."""
    parts = [[top.feature.copy()], [top.cut.copy()], [top.left.copy()], [top.value.copy()]]
    gains, size = top.gains.copy(), len(top.feature)
    for node, tree in sorted(grafts, key=lambda g: g[0]):
        gains += tree.gains
        # The subtree's root replaces the leaf, its other nodes go to the end.
        shift = size - 1
        left = np.where(tree.feature >= 0, tree.left + shift, 0)
        for part, values in zip(parts, (tree.feature, tree.cut, left, tree.value), strict=True):
            part[0][node] = values[0]
            part.append(values[1:])
        size += len(tree.feature) - 1
    return Grown(*(np.concatenate(p) for p in parts), gains)


def _votes(trees: list[Grown], x: np.ndarray) -> np.ndarray:
    """Summed shares of ones in integer units, the same in whichever order trees are added."""
    out = np.zeros(len(x), dtype=np.int64)
    for tree in trees:
        out += np.rint(tree.value * UNIT).astype(np.int64)[tree.place(x)]
    return out


def predictor(model: Forest, features: list[str], spark):
    """Adds ``prediction`` (0.0/1.0): whether the mean share of ones is above one half."""
    n_trees = len(model.gains)
    if model.size > MODEL_BYTES:
        return lambda df: _shuffled_votes(model, df, features)
    sent = spark.sparkContext.broadcast(model.stored.select("nodes").toArrow().column("nodes").to_pylist())

    @F.pandas_udf("double")
    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        held = [unpacked(t, []) for t in sent.value]
        for values in batches:
            x = values.to_numpy(dtype=np.float64)
            yield pd.Series((_votes(held, x) > n_trees * UNIT / 2).astype(float))

    return lambda df: df.withColumn("prediction", vote(fitting.feature_struct(features)))


def _shuffled_votes(model: Forest, df: DataFrame, features: list[str]) -> DataFrame:
    """Every block of distinct feature values meets every part of the forest; votes are joined back.

    A vote depends on the feature values alone, so they are the key. Pairs of blocks and parts are read from
    the checkpoint folder, not shuffled, and a task holds a block and one tree at a time. There are no more
    parts than keep the cores busy, since each of them adds a sum of votes per distinct row.
    """
    n_trees, n = len(model.gains), len(features)
    names = [f"__x{i}" for i in range(n)]
    tagged = df.withColumns(dict(zip(names, (quoted(f).cast("double") for f in features), strict=True)))
    # A null goes left at every cut, as NaN does in a comparison.
    keyed = tagged.withColumn("__x", F.array(*[F.coalesce(F.col(c), F.lit(float("nan"))) for c in names])).drop(*names)

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _values(batches, n):
            layout = blocks.Layout.of(x)
            words = layout.words(x)
            words = words.take(np.argsort(words[0], kind="stable"), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([blocks.packed(layout.head(), words)], pa.binary())], ["x"])

    rows = cut_lineage(keyed.select("__x").distinct().mapInArrow(blocked, "x binary").withColumn(
        "block", F.monotonically_increasing_id()))
    least = -(-2 * df.sparkSession.sparkContext.defaultParallelism // max(1, rows.count()))
    parts = min(n_trees, max(1, least), -(-model.size // PART_BYTES))

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, x, nodes in zip(*(batch.column(c) for c in ("block", "x", "nodes")), strict=True):
                if (at := block.as_py()) not in held:
                    own = blocks.unpacked(x.as_buffer())
                    held[at] = own, np.zeros(len(own), dtype=np.int64)
                held[at][1][:] += _votes([unpacked(nodes.as_buffer(), [])], held[at][0])
        for x, sums in held.values():
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([values, pa.array(sums)], ["__x", "votes"])

    pairs = model.stored.select("nodes").coalesce(parts).crossJoin(rows.hint("shuffle_replicate_nl"))
    votes = pairs.mapInArrow(voted, "__x array<double>, votes long").groupBy("__x").agg(F.sum("votes").alias("__votes"))
    above = (F.col("__votes") > F.lit(int(n_trees * UNIT / 2))).cast("double")
    return keyed.join(votes, "__x", "left").withColumn("prediction", above).drop("__x", "__votes")


def _values(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[np.ndarray]:
    """Feature values by the ``PART_ROWS`` or a batch more."""
    held, size = [], 0
    for batch in batches:
        held.append(batch.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(-1, n))
        size += len(held[-1])
        if size >= PART_ROWS:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)
