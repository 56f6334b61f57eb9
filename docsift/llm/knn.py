"""Problem 5: the most similar vectors of every vector, by NN-descent.

Vectors are normalised and those that are equal share one node.  A forest of
random-projection trees, fitted on at most ``SAMPLE`` vectors, puts every node
into one leaf per tree; exact search inside the leaves starts the graph.  Each
round of NN-descent then joins neighbours of neighbours: a node receives the
vectors of its best neighbours and of the nodes that count it among theirs,
compares them all with each other, and tells each of them of better neighbours.
Rounds end when few edges change.  The graph works on vectors of 8 bits, whose
dot products are exact integers; final similarities are computed again on the
full vectors.

Leaves and neighbourhoods are bounded, so no task holds an unbounded group: a
leaf with more than ``2 * LEAF`` nodes is divided by hash, and what that
separates is found again by other trees and by the rounds.

Defined results: only vectors of ``dim`` finite values, not all zero, take part;
null keys don't; a repeated key is one record; equal similarities rank by key;
of more than six copies of a vector, each has the five smallest other keys as
its neighbours; empty tables give empty results.  Only the key and vector
columns are read.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docsift.llm.words import by_batch
from docsift.stage import Stage

log = logging.getLogger(__name__)

DIM, NEAREST, COPIES = 64, 5, 6


@dataclass(frozen=True)
class Build:
    """How a graph is built, the same at every size: its degree, the share of forward and of as many reverse neighbours that a
    round joins, trees, nodes of a leaf, edges per node that a leaf contributes to the start, and the rounds at most."""

    degree: int
    joined: float
    trees: int
    leaf: int
    per_leaf: int
    rounds: int


#: For close pairs, for whole neighbour lists, and for the graph that searches walk on.
CLOSE = Build(12, 0.67, 5, 256, 7, 3)
FULL = Build(30, 0.67, 8, 256, 12, 8)
WALK = Build(24, 0.67, 8, 256, 10, 4)
#: Rounds end when this share of the edges is new.
CHANGED = 0.01
#: Graph search: entry nodes, kept candidates, and how many of them a step opens, until no query opens any.
ENTRIES, BEAM, WIDTH, STEPS = 128, 48, 12, 12
#: Vectors that the trees are fitted on, and the depth to which that many can balance them.
SAMPLE, FITTED_DEPTH = 20_000, 11
#: How far 8-bit similarities may be off; edges this near a threshold are computed again.
ERROR = 0.012


def _vectors(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are usable, their normalised vectors) of a batch."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(lengths == dim)
    if not len(right):
        return right, np.zeros((0, dim), np.float32)
    x = column.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.sqrt((x * x).sum(1))
    ok = np.isfinite(norm) & (norm > 0)
    return right[ok], (x[ok] / norm[ok, None]).astype(np.float32)


def usable(df: DataFrame, key: str, vector: str, dim: int = DIM) -> DataFrame:
    """k, cls (digest of the vector), v (normalised, float32) of the records that take part."""
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<float>").alias("e")).filter("k is not null and e is not null")

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            at, x = _vectors(batch.column(1), dim)
            if not len(at):
                return None
            raw = [r.tobytes() for r in x]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())], ["k", "cls", "v"])

        return run

    return by_batch(rows, make, "k long, cls binary, v binary")


def quantised(x: np.ndarray) -> np.ndarray:
    """8-bit integers of normalised vectors, each scaled by its own largest value."""
    return np.rint(x * (127 / np.abs(x).max(1, keepdims=True))).astype(np.int8)


def _inverse(q: np.ndarray) -> np.ndarray:
    return (1 / np.sqrt((q.astype(np.float32) ** 2).sum(1))).astype(np.float32)


class Forest:
    """Random-projection trees; a node of a tree splits its sample at the median of a direction between two of its vectors."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.fitted, self.depth = min(depth, FITTED_DEPTH, max(0, int(math.log2(max(1, len(sample) / 8))))), depth
        self.planes = rng.standard_normal((trees, depth, dim)).astype(np.float32)
        size = 2**self.fitted - 1
        self.direction, self.cut = np.zeros((trees, size, dim), np.float32), np.zeros((trees, size), np.float32)
        for t in range(trees):
            members = {0: np.arange(len(sample))}
            for node in range(size):
                m = members.pop(node)
                a, b = (sample[rng.choice(m, 2)] if len(m) > 1 else rng.standard_normal((2, dim))).astype(np.float32)
                direction = a - b if (a != b).any() else rng.standard_normal(dim).astype(np.float32)
                p = sample[m] @ direction
                cut = np.median(p) if len(m) else 0
                self.direction[t, node], self.cut[t, node] = direction, cut
                members[2 * node + 1], members[2 * node + 2] = m[p <= cut], m[p > cut]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """rows x trees: leaf numbers."""
        out = np.empty((len(x), len(self.direction)), np.int64)
        for t in range(out.shape[1]):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.fitted):
                side = np.einsum("ij,ij->i", x, self.direction[t, node]) > self.cut[t, node]
                node = 2 * node + 1 + side
            for level in range(self.fitted, self.depth):
                node = 2 * node + 1 + (x @ self.planes[t, level] > 0)
            out[:, t] = node
        return out


def _top(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise k largest: (columns, values), unordered."""
    k = min(k, sims.shape[1])
    at = np.argpartition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k :]
    return at, np.take_along_axis(sims, at, 1)


EDGES = "i long, j long, s float"


def _edge_batch(i: np.ndarray, j: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(s, pa.float32())], ["i", "j", "s"])


def _leaf_edges(table: pa.Table, degree: int) -> pa.Table:
    """The nearest of each node inside its leaf."""
    k = table.column("k").to_numpy()
    if len(k) < 2:
        return pa.Table.from_batches([_edge_batch(k[:0], k[:0], np.zeros(0, np.float32))])
    q = np.frombuffer(b"".join(table.column("q").to_pylist()), np.int8).reshape(len(k), -1)
    inv, x = _inverse(q), q.astype(np.float32)
    out = []
    for a in range(0, len(k), 512):
        s = x[a : a + 512] @ x.T
        s *= inv[a : a + 512, None] * inv[None, :]
        rows = np.arange(len(s))
        s[rows, a + rows] = -2
        at, value = _top(s, min(degree, len(k) - 1))
        out.append(_edge_batch(np.repeat(k[a : a + 512], at.shape[1]), k[at.ravel()], value.ravel()))
    return pa.Table.from_batches(out)


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k best distinct edges of each node: i, j, s, r (rank), old, least (what a better edge must exceed)."""
    best = W.partitionBy("i").orderBy(F.desc("s"), "j")
    top = edges.withColumn("r", F.dense_rank().over(best)).filter(F.col("r") <= k)
    one = top.groupBy("i", "j", "s", "r").agg(F.max("old").alias("old"))
    last = F.max("r").over(W.partitionBy("i"))
    low = F.min("s").over(W.partitionBy("i"))
    return one.withColumn("least", F.when(last >= k, low).otherwise(F.lit(-2.0)).cast("float"))


def start(nodes: DataFrame, count: int, stage: Stage, build: Build) -> DataFrame:
    """Edges from exact search inside the leaves of the forest. nodes: k, v, q."""
    spark, degree, trees, leaf, per_leaf = nodes.sparkSession, build.degree, build.trees, build.leaf, build.per_leaf
    parts = 1_000_000_000
    rows = nodes.filter(F.pmod(F.xxhash64("k"), F.lit(parts)) < int(parts * min(1.0, SAMPLE / max(1, count)))).select("v").collect()
    sample = np.frombuffer(b"".join(r.v for r in rows), np.float32).reshape(len(rows), -1)
    depth = max(0, math.ceil(math.log2(max(1, count / leaf))))
    forest = spark.sparkContext.broadcast(Forest(sample, trees, depth))

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(batch.num_rows, -1)
            leaves = forest.value.leaves(x)
            t = leaves.shape[1]
            return pa.RecordBatch.from_arrays(
                [pa.array((leaves * t + np.arange(t)).ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), t))), batch.column(2).take(pa.array(np.repeat(np.arange(batch.num_rows), t)))],
                ["leaf", "k", "q"],
            )

        return run

    placed = by_batch(nodes.select("k", "v", "q"), make, "leaf long, k long, q binary")
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * leaf)
    large = sizes.select("leaf", F.ceil(F.col("n") / leaf).cast("long").alias("parts"))
    placed = placed.join(large, "leaf", "left")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("k", "leaf"), F.coalesce("parts", F.lit(1))))
    edges = placed.select("leaf", "part", "k", "q").groupBy("leaf", "part").applyInArrow(lambda table: _leaf_edges(table, min(degree, per_leaf)), EDGES)
    return stage.save(_nearest(edges.withColumn("old", F.lit(False)), degree), "graph")


def _proposals(around: DataFrame) -> DataFrame:
    """Better edges that the members of each neighbourhood find among each other. around: members as arrays of (k, q, least)."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            lists = batch.column(0)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            rows = lists.flatten()
            k = rows.field(0).to_numpy(zero_copy_only=False)
            q = np.frombuffer(b"".join(rows.field(1).to_pylist()), np.int8).reshape(len(k), -1)
            least, inv = rows.field(2).to_numpy(zero_copy_only=False), _inverse(q)
            ends = np.cumsum(sizes)
            found = []
            for size in np.unique(sizes[sizes > 1]):
                at = (ends[sizes == size] - size)[:, None] + np.arange(size)
                for a in range(0, len(at), 1024):
                    part = at[a : a + 1024]
                    x = q[part].astype(np.float32)
                    s = x @ x.transpose(0, 2, 1)
                    s *= inv[part][:, :, None] * inv[part][:, None, :]
                    b, i, j = np.nonzero(s > least[part][:, :, None])
                    ki, kj = k[part[b, i]], k[part[b, j]]
                    ok = ki != kj
                    found.append((ki[ok], kj[ok], s[b, i, j][ok]))
            if not found:
                return None
            i, j, s = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((j, i))
            i, j, s = i[order], j[order], s[order]
            first = np.ones(len(i), bool)
            first[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            return _edge_batch(i[first], j[first], s[first])

        return run

    return by_batch(around, make, EDGES)


def descend(graph: DataFrame, nodes: DataFrame, stage: Stage, count: int, build: Build) -> DataFrame:
    """NN-descent from a start graph, as ``_nearest`` gives it."""
    packed = nodes.select("k", "q")
    degree, join = build.degree, max(2, round(build.degree * build.joined))
    for _ in range(build.rounds):
        near = graph.filter(F.col("r") <= join)
        forward = near.select(F.col("i").alias("center"), F.col("j").alias("k"))
        by = W.partitionBy("center").orderBy(F.desc("s"), "k")
        back = near.select(F.col("j").alias("center"), F.col("i").alias("k"), "s").withColumn("n", F.row_number().over(by)).filter(F.col("n") <= join)
        member = packed.join(graph.filter("r = 1").select(F.col("i").alias("k"), "least"), "k", "left").withColumn("least", F.coalesce("least", F.lit(-2.0).cast("float")))
        sent = forward.union(back.select("center", "k")).join(member, "k")
        around = sent.groupBy("center").agg(F.collect_list(F.struct("k", "q", "least")).alias("rows")).select("rows")
        both = graph.select("i", "j", "s", F.lit(True).alias("old")).union(_proposals(around).withColumn("old", F.lit(False)))
        merged = stage.save(_nearest(both, degree), "graph")
        fresh = merged.filter("not old").count()
        log.info("round changed %d of %d edges", fresh, count * degree)
        stage.drop(graph)
        graph = merged
        if fresh <= CHANGED * count * degree:
            break
    return graph


class Neighbours:
    """The finished graph with what is needed to turn nodes into records."""

    def __init__(self, df: DataFrame, key: str, vector: str, dim: int, build: Build):
        self.stage = stage = Stage(df.sparkSession, "knn")
        rows = stage.save(usable(df, key, vector, dim), "vectors")
        self.members = rows.select("k", "cls").distinct()
        classes = rows.groupBy("cls").agg(F.min("k").alias("rep"), F.first("v").alias("v"), F.min("k").alias("low"), F.max("k").alias("high"))

        def make():
            def run(batch: pa.RecordBatch) -> pa.RecordBatch:
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(batch.num_rows, -1)
                return pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in quantised(x)], pa.binary())], ["k", "v", "cls", "several", "q"])

            return run

        self.nodes = stage.save(by_batch(classes.select(F.col("rep").alias("k"), "v", "cls", (F.col("low") < F.col("high")).alias("several")), make, "k long, v binary, cls binary, several boolean, q binary"), "nodes")
        count = self.nodes.count()
        self.graph = descend(start(self.nodes, count, stage, build), self.nodes, stage, count, build) if count > 1 else None

    def firsts(self) -> DataFrame:
        """rep, ks: the smallest keys of each vector that several records share."""
        shared = self.nodes.filter("several").select("cls", F.col("k").alias("rep"))
        rank = F.row_number().over(W.partitionBy("rep").orderBy("k"))
        rows = self.members.join(shared, "cls").withColumn("n", rank).filter(F.col("n") <= COPIES)
        return rows.groupBy("rep").agg(F.sort_array(F.collect_list("k")).alias("ks"))

    def exact(self, edges: DataFrame) -> DataFrame:
        """i, j, s with similarities of the full vectors."""
        v = self.nodes.select("k", "v")
        both = edges.select("i", "j").join(v.withColumnsRenamed({"k": "i", "v": "vi"}), "i").join(v.withColumnsRenamed({"k": "j", "v": "vj"}), "j")

        def make():
            def run(batch: pa.RecordBatch) -> pa.RecordBatch:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float32).reshape(batch.num_rows, -1).astype(np.float64) for c in (2, 3))
                s = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
                return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], ["i", "j", "s"])

            return run

        return by_batch(both.select("i", "j", "vi", "vj"), make, "i long, j long, s double")

    def records(self, edges: DataFrame) -> DataFrame:
        """i, j, s between records, from edges between nodes: at most COPIES records stand for a node, and they are edges of each other."""
        firsts = self.firsts()
        one = lambda c: F.coalesce(F.col(f"ks_{c}"), F.array(c))
        wide = edges.join(firsts.withColumnsRenamed({"rep": "i", "ks": "ks_i"}), "i", "left").join(firsts.withColumnsRenamed({"rep": "j", "ks": "ks_j"}), "j", "left")
        across = wide.select("s", F.explode(one("i")).alias("x"), one("j").alias("ys")).select(F.col("x").alias("i"), F.explode("ys").alias("j"), "s")
        own = firsts.select(F.explode("ks").alias("i"), "ks").select("i", F.explode("ks").alias("j"), F.lit(1.0).alias("s")).filter("i <> j")
        return across.union(own)


def _ranked(edges: DataFrame) -> DataFrame:
    best = W.partitionBy("i").orderBy(F.desc("s"), "j")
    return edges.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= NEAREST)


def _similar(pairs: DataFrame) -> DataFrame:
    """i, j, s of pairs i, j, qi, qj of 8-bit vectors."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int8).reshape(batch.num_rows, -1) for c in (2, 3))
            dots = np.einsum("ij,ij->i", a.astype(np.float32), b.astype(np.float32))
            return _edge_batch(batch.column(0), batch.column(1), dots * (_inverse(a) * _inverse(b)))

        return run

    return by_batch(pairs.select("i", "j", "qi", "qj"), make, EDGES)


def greedy_search(found: Neighbours, queries: DataFrame, k: int) -> DataFrame:
    """i, j, s: the k nearest nodes j of each query i (k, q), by best-first search on the graph.

    Every query starts at the same few nodes.  A step opens the best unopened
    candidates of each query, scores their neighbours and keeps the best ``BEAM``.
    """
    stage, nodes = found.stage, found.nodes.select(F.col("k").alias("j"), F.col("q").alias("qj"))
    asked = queries.select(F.col("k").alias("i"), F.col("q").alias("qi"))
    links = found.graph.select(F.col("i").alias("at"), "j")
    entries = nodes.orderBy(F.xxhash64("j")).limit(ENTRIES)  # a fixed number of rows
    best = W.partitionBy("i").orderBy(F.desc("s"), "j")
    state = stage.save(_similar(asked.crossJoin(F.broadcast(entries))).withColumn("opened", F.lit(False)).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= BEAM).drop("r"), "beam")
    for _ in range(STEPS):
        turn = F.row_number().over(W.partitionBy("i", "opened").orderBy(F.desc("s"), "j"))
        now = stage.save(state.withColumn("n", turn).withColumn("now", ~F.col("opened") & (F.col("n") <= WIDTH)).drop("n"), "turn")
        if now.filter("now").isEmpty():
            break
        steps = now.filter("now").select("i", F.col("j").alias("at")).join(links, "at").select("i", "j").distinct()
        fresh = steps.join(now.select("i", "j"), ["i", "j"], "left_anti")
        scored = _similar(fresh.join(nodes, "j").join(asked, "i")).withColumn("opened", F.lit(False))
        both = now.select("i", "j", "s", (F.col("opened") | F.col("now")).alias("opened")).unionByName(scored)
        following = stage.save(both.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= BEAM).drop("r"), "beam")
        stage.drop(state)
        stage.drop(now)
        state = following
    return state.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("i", "j", "s")


def search(df: DataFrame, asks, key: str = "section_id", vector: str = "embedding", dim: int = DIM, build: Build | None = None) -> DataFrame:
    """section_id, rank, neighbour_id, similarity for the records whose key satisfies ``asks``, against all records.

    asks: function from the key column to a condition.  The five most similar
    other records of each are found by graph search.
    """
    found = Neighbours(df, key, vector, dim, build or WALK)
    who = found.members.filter(asks(F.col("k")))
    if found.graph is None:
        return df.sparkSession.createDataFrame([], "section_id long, rank int, neighbour_id long, similarity double")
    # a query is asked by the node of its vector
    place = found.nodes.select("cls", F.col("k").alias("rep"), "q")
    mine = who.join(place, "cls").select("k", "rep", "q")
    near = found.exact(greedy_search(found, mine.groupBy("rep").agg(F.first("q").alias("q")).withColumnRenamed("rep", "k"), NEAREST + 3))
    firsts = found.firsts().withColumnRenamed("rep", "j")
    wide = mine.select("k", F.col("rep").alias("i")).join(near, "i").join(firsts, "j", "left")
    flat = wide.select(F.col("k").alias("i"), F.explode(F.coalesce("ks", F.array("j"))).alias("j"), "s").filter("i <> j")
    return _ranked(flat).select(F.col("i").alias("section_id"), "rank", F.col("j").alias("neighbour_id"), F.round("s", 6).alias("similarity"))


_NONE = "i long, j long, s double"


def mutual(df: DataFrame, key: str = "section_id", vector: str = "embedding", least: float = 0.9, dim: int = DIM, build: Build | None = None) -> DataFrame:
    """section_id_a, section_id_b: pairs of at least the given cosine, each among the five most similar of the other."""
    found = Neighbours(df, key, vector, dim, build or CLOSE)
    if found.graph is None:
        near = df.sparkSession.createDataFrame([], _NONE)
    else:
        near = found.exact(found.graph.filter(F.col("s") >= least - ERROR)).filter(F.col("s") >= least)
    ranked = _ranked(found.records(near))
    pairs = ranked.groupBy(F.least("i", "j").alias("section_id_a"), F.greatest("i", "j").alias("section_id_b")).agg(F.count("*").alias("n"))
    return pairs.filter("n = 2").select("section_id_a", "section_id_b")


def neighbours(df: DataFrame, key: str = "section_id", vector: str = "embedding", dim: int = DIM, build: Build | None = None) -> DataFrame:
    """section_id, rank, neighbour_id, similarity: the five most similar records of every record that takes part."""
    found = Neighbours(df, key, vector, dim, build or FULL)
    spare = NEAREST + 3
    near = found.exact(found.graph.filter(F.col("r") <= spare)) if found.graph is not None else df.sparkSession.createDataFrame([], _NONE)
    ranked = _ranked(found.records(near))
    # records beyond the first COPIES of a vector share the list of its smallest keys
    firsts = found.firsts()
    rest = found.members.join(found.nodes.filter("several").select("cls", F.col("k").alias("rep")), "cls").join(firsts, "rep").filter(~F.array_contains("ks", F.col("k")))
    more = rest.select(F.col("k").alias("i"), F.posexplode(F.slice("ks", 1, NEAREST)).alias("p", "j")).select("i", "j", F.lit(1.0).alias("s"), (F.col("p") + 1).alias("rank"))
    out = ranked.select("i", "j", "s", "rank").union(more)
    return out.select(F.col("i").alias("section_id"), "rank", F.col("j").alias("neighbour_id"), F.round("s", 6).alias("similarity"))
