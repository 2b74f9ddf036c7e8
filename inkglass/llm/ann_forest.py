"""Nearest neighbours by inner product: a forest of random-projection trees.

The trees are grown on a bounded sample and sent to all tasks; every vector is then placed
in one leaf of each tree. A query walks all trees through one shared priority queue, the
branch first that its margins speak for most, until its leaves hold enough candidates, and the candidates are ranked again by their exact inner product.

Vectors of unlike length are searched by inner product through one more coordinate,
sqrt(M^2 - |v|^2) with M the largest norm, which makes it a matter of angles.

Equal vectors are one point of the index. Of their rows only the few smallest ids can be
among the nearest k, so a vector that fills a third of the table costs no more than another.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash


@dataclass
class Tree:
    """Inner node i sends a vector left if normals[i] . v < offsets[i]; children below 0 are leaves, as -1 - leaf."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaves: int

    @cached_property
    def nodes(self) -> list[tuple[np.ndarray, float, int, int, int, int]]:
        """Of each inner node: normal, offset, and its children, each with the cuts that lie below it at most."""
        below = [0] * len(self.normals)
        out = []
        # children come after their parents
        for node in range(len(below) - 1, -1, -1):
            left, right = self.children[node].tolist()
            a, b = (below[c] if c >= 0 else 0 for c in (left, right))
            below[node] = 1 + max(a, b)
            out.append((self.normals[node], float(self.offsets[node]), left, a, right, b))
        return out[::-1]

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``x``."""
        node = np.zeros(len(x), np.int64)
        out = np.zeros(len(x), np.int64)
        if not len(self.normals):
            return out
        active = np.arange(len(x))
        while len(active):
            at = node[active]
            side = (np.einsum("ij,ij->i", x[active], self.normals[at]) >= self.offsets[at]).astype(np.int64)
            child = self.children[at, side]
            ended = child < 0
            out[active[ended]] = -1 - child[ended]
            node[active] = child
            active = active[~ended]
        return out


def grow(sample: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """A tree whose leaves hold at most ``leaf`` vectors of the sample.

    A node is cut at the median along the direction between two of its vectors.
    """
    normals, offsets, children = [], [], []
    leaves = 0
    # (rows, parent, side); the root has no parent
    todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(sample)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        left = None
        if len(rows) > leaf:
            for _ in range(4):
                a, b = sample[rng.choice(rows, 2, replace=False)]
                normal = b - a
                if (norm := np.linalg.norm(normal)) > 0:
                    normal = normal / norm
                    along = sample[rows] @ normal
                    cut = np.median(along)
                    if 0 < (left := along < cut).sum() < len(rows):
                        break
                    left = None
        if left is None:
            child, leaves = -1 - leaves, leaves + 1
        else:
            child = len(normals)
            normals.append(normal)
            offsets.append(cut)
            children.append([0, 0])
            todo += [(rows[left], child, 0), (rows[~left], child, 1)]
        if parent >= 0:
            children[parent][side] = child
    d = sample.shape[1]
    return Tree(np.array(normals).reshape(-1, d), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), leaves)


def walk(trees: list[Tree], counts: list[np.ndarray], query: np.ndarray, enough: int) -> tuple[list[tuple[int, int]], int]:
    """The leaves (tree, leaf) that a query looks into, and how many nodes it visited.

    One queue holds nodes of all trees, first their roots. The node with the least priority
    is taken from it; an inner one puts its two children back, a leaf is looked into, until
    leaves hold ``enough`` vectors, counted once for each tree. A node's priority adds up the
    margins of the cuts on the way to it: in full where the cut parts it from the query, and
    a fifth of it off where both lie on one side. As much is taken off ahead for each level
    that the node stands above its leaves, by the margin that can be expected, so that nodes
    of unlike heights compare.
    """
    ahead = NEAR * float(np.linalg.norm(query)) / math.sqrt(len(query))
    nodes = [tree.nodes for tree in trees]
    # (priority, tree, node, margins so far)
    queue = [(0.0, t, 0 if len(known) else -1, 0.0) for t, known in enumerate(nodes)]
    leaves: list[tuple[int, int]] = []
    held = visited = 0
    pop, push = heapq.heappop, heapq.heappush
    while queue and held < enough:
        _, t, node, at = pop(queue)
        visited += 1
        if node < 0:
            leaves.append((t, -1 - node))
            held += counts[t][-1 - node]
            continue
        normal, offset, left, below_left, right, below_right = nodes[t][node]
        margin = float(normal.dot(query)) - offset
        to_left, to_right = (at + margin, at - NEAR * margin) if margin > 0 else (at + NEAR * margin, at - margin)
        push(queue, (to_left - ahead * below_left, t, left, to_left))
        push(queue, (to_right - ahead * below_right, t, right, to_right))
    return leaves, visited


#: What a margin counts for where query and node lie on one side of a cut.
NEAR = 0.2


def _valid(vector: str) -> Column:
    """Not null, not empty, all components and the length finite, and not all components zero."""
    norm2 = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))) & (norm2 != float("inf"))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 20,
    k: int = 20,
    trees: int = 8,
    leaf: int = 64,
    reach: float = 7.0,
    power: float = 0.75,
    sample: int = 50_000,
    floor_sample: int = 50_000,
    cell: int = 32,
    chunk: int = 8_192,
    seed: int = 7,
) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` nearest found of each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all other rows.
    Nearness is the inner product in double precision, ties go to the smaller id, and a
    query with fewer candidates than ``k`` gets all that were found. Vectors that are null,
    empty, zero, or hold a null or a component that is not finite take no part, nor do those
    whose squares overflow, nor rows without an id; vectors must be of one length (the most frequent; rows of another
    take no part). Rows that repeat an id with the same vector count once. Other columns are
    ignored; an empty table gives no rows.

    The index is fitted on at most ``sample`` vectors, chosen by hash; it holds all of them.
    Its leaves hold about ``leaf`` points of the sample; ``cell`` neighbouring leaves of a tree
    are kept together, in parts of about ``chunk`` points and as many queries at most. A
    query's leaves hold at least ``reach`` * n ** ``power`` of n points, counting a point
    once for each tree; so the work grows as n ** (1 + ``power``), and a tenth of a table's
    leaves, or less, is read from some 10,000 points on. The default finds nine in ten
    neighbours among 50,000 vectors without any structure in 64 dimensions, the hardest
    case; data of low intrinsic dimension need far less.

    Candidates that cannot be among the nearest are dropped where they are met: those below
    the ``k`` + 1 best of those of ``floor_sample`` points that the query's leaves hold, and
    those below the ``k`` + 1 best of their cell.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(_valid("v") & F.col("id").isNotNull())
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    if not lengths:
        return empty
    d = lengths[0]["d"]
    rows = rows.filter(F.size("v") == d).withColumn("key", F.md5(F.array_join(F.transform("v", lambda x: (x + 0.0).cast("string")), ",").cast("binary")))
    rows = rows.select("id", "v", F.unhex("key").alias("key"))
    # of equal vectors, k + 1 ids are enough for every query, even one of their own
    order = Window.partitionBy("key").orderBy("id")
    ids = rows.select("key", "id").withColumn("_r", F.dense_rank().over(order)).filter(F.col("_r") <= k + 1)
    points = stash(
        rows.groupBy("key").agg(F.first("v").alias("v")).join(ids.groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("ids")), "key"), "ann-points"
    )
    asked = stash(rows.filter(F.col("id") % every == 0).select("id", "key").distinct(), "ann-asked")
    total = points.count()
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    longest = points.agg(F.max(norm2)).first()[0]
    # a hash threshold takes about `sample` points whatever their number, and limit bounds them
    share = min(1.0, 1.2 * sample / total)
    bound = int((share - 0.5) * 2**32) * 2**32 if share < 1 else 2**63 - 1
    drawn = points.select("key", "v").filter(F.xxhash64("key") <= bound).orderBy("key").limit(sample).toPandas()

    def extended(v: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(longest - np.einsum("ij,ij->i", v, v), 0.0))
        return np.concatenate((v, rest[:, None]), 1)

    rng = np.random.default_rng(seed)
    plain = np.stack(drawn["v"].to_numpy())
    forest = [grow(extended(plain), leaf, rng) for _ in range(trees)]
    shared = spark.sparkContext.broadcast(forest)
    # the key orders the sample, so its first points are as random as any
    some = plain[:floor_sample]
    few = spark.sparkContext.broadcast((drawn["key"].tolist()[:floor_sample], some, [tree.place(extended(some)) for tree in forest]))
    enough = math.ceil(reach * total**power)
    # of a forest's slots this share is read, and as many of the queries meet in a leaf
    query_parts = max(1, math.ceil(asked.count() * enough / (total * trees) / chunk))

    # vectors travel as bytes, of the precision that they came in
    wide = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    told = lambda c: np.frombuffer(b"".join(c), wide).reshape(len(c), d).astype(np.float64)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                v = np.stack(batch["v"].to_numpy())
                x, coded = extended(v), [r.tobytes() for r in v.astype(wide)]
                for t, tree in enumerate(shared.value):
                    at = tree.place(x)
                    yield pd.DataFrame({"t": np.int32(t), "cell": at // cell, "leaf": at, "key": batch["key"], "v": coded, "ids": batch["ids"]})

    placed = points.mapInPandas(place, "t int, cell long, leaf long, key binary, v binary, ids array<long>")
    # one number per leaf, and the number of leaves is bounded by the sample
    held = placed.groupBy("t", "leaf").agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts = [np.zeros(tree.leaves, np.int64) for tree in forest]
    for t, at, n in zip(held["t"], held["leaf"], held["n"]):
        counts[t][at] = n
    known = spark.sparkContext.broadcast(counts)
    parts = [np.maximum(1, -(-np.add.reduceat(c, np.arange(0, len(c), cell)) // chunk)) for c in counts]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, some, leaf_of = few.value
        place_of = {bytes(key): i for i, key in enumerate(keys)}
        for batch in (b.iloc[at : at + 64] for b in batches for at in range(0, len(b), 64)):
            found: list[tuple] = []
            vectors = np.stack(batch["v"].to_numpy())
            # the added coordinate of a query is 0, and its length does not matter
            scaled = np.sqrt(longest) * vectors / np.linalg.norm(vectors, axis=1)[:, None]
            for key, v, query in zip(batch["key"], vectors, np.concatenate((scaled, np.zeros((len(vectors), 1))), 1)):
                cells: dict[tuple[int, int], list[int]] = {}
                walked = [np.zeros(tree.leaves, bool) for tree in shared.value]
                for t, at in walk(shared.value, known.value, query, enough)[0]:
                    cells.setdefault((t, at // cell), []).append(at)
                    walked[t][at] = True
                # points that the walk meets, but for the query's own
                met = np.logical_or.reduce([w[leaves] for w, leaves in zip(walked, leaf_of)])
                if (own := place_of.get(bytes(key))) is not None:
                    met[own] = False
                scores, coded = some[met] @ v, v.astype(wide).tobytes()
                floor = -np.inf if len(scores) <= k else np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                found += [(t, c, part, key, coded, floor, leaves) for (t, c), leaves in cells.items() for part in range(parts[t][c])]
            yield pd.DataFrame(found, columns=["t", "cell", "part", "qkey", "q", "floor", "leaves"])

    sizes = spark.createDataFrame(
        pd.DataFrame([(t, c, int(n)) for t, ns in enumerate(parts) for c, n in enumerate(ns)], columns=["t", "cell", "parts"]), "t int, cell long, parts int"
    )
    queries = points.join(asked.select("key").distinct(), "key", "left_semi").select("key", "v")
    wanted = queries.mapInPandas(search, "t int, cell long, part int, qkey binary, q binary, floor double, leaves array<long>")
    wanted = wanted.withColumn("qpart", F.pmod(F.xxhash64("qkey"), F.lit(query_parts)).cast("int"))
    members = placed.join(F.broadcast(sizes), ["t", "cell"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).drop("parts")
    members = members.withColumn("qpart", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))))
    # what a product of matrices may be off by, for vectors of length 1
    error = 8 * d * np.finfo(np.float64).eps

    def rank(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame([], columns=["qkey", "key", "score", "ids"])
        if not len(left) or not len(right):
            return none
        right = right.sort_values("leaf", kind="stable")
        x, q, floors = told(right["v"]), told(left["q"]), left["floor"].to_numpy()
        near, far = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1).max()
        cuts = floors - 2 * error * near * far
        leaves, starts = np.unique(right["leaf"].to_numpy(), return_index=True)
        ends = np.append(starts[1:], len(right))
        asks = np.repeat(np.arange(len(left)), [len(a) for a in left["leaves"]])
        which = np.concatenate(left["leaves"].to_numpy())
        pairs = []
        for at, start, end in zip(leaves, starts, ends):
            of = asks[which == at]
            for first in range(0, len(of), 1024):
                some = of[first : first + 1024]
                i, j = np.nonzero(q[some] @ x[start:end].T >= cuts[some][:, None])
                pairs.append((some[i], j + start))
        if not pairs:
            return none
        i, j = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        score = np.concatenate([(q[i[s : s + 65536]] * x[j[s : s + 65536]]).sum(1) for s in range(0, max(len(i), 1), 65536)])
        ids = right["ids"].to_numpy()
        smallest = np.array([g[0] for g in ids])
        # of each query the k + 1 best of the cell
        order = np.lexsort((smallest[j], -score, i))
        heads = np.flatnonzero(np.append(True, i[order][1:] != i[order][:-1])) if len(order) else order
        place_in = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
        best = order[place_in <= k]
        keys, qkeys = right["key"].to_numpy(), left["qkey"].to_numpy()
        return pd.DataFrame({"qkey": qkeys[i[best]], "key": keys[j[best]], "score": score[best], "ids": ids[j[best]]})

    met = wanted.groupBy("t", "cell", "part", "qpart").cogroup(members.groupBy("t", "cell", "part", "qpart"))
    scored = met.applyInPandas(rank, "qkey binary, key binary, score double, ids array<long>").dropDuplicates(["qkey", "key"])
    listed = scored.select("qkey", "score", F.explode("ids").alias("id"))
    best = Window.partitionBy("qkey").orderBy(F.desc("score"), "id")
    top = listed.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1)
    answers = stash(top.groupBy("qkey").agg(F.array_sort(F.collect_list(F.struct("_r", "id", "score"))).alias("found")), "ann-answers")
    own = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    joined = asked.select(F.col("id").alias("query_id"), "key").join(answers, F.col("key") == F.col("qkey"))
    return joined.select("query_id", F.posexplode(own).alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))
