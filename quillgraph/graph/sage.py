"""Node vectors from two layers of neighbour means, trained to tell edges from sampled pairs.

Layer one is relu(x A1 + mean(x of neighbours) B1 + c1), layer two the same of that without relu, at length 1. The loss is the
cross entropy of sigmoid(z_u . z_v) over edges and as many sampled pairs. Means and sums over neighbours are aggregations of
vectors by Spark, combined before the shuffle, so a hub costs its partial sums only; the dense steps are matrix products on
batches of rows; gradients are summed like any column, and nothing but the weights, two small matrices a layer, is ever on
the driver. An epoch is one step of all edges: a mean forward, a sum over pairs, and a sum backward.

Sampled pairs take an edge's start and another edge's end: edges are dealt into groups by a hash of epoch and edge, and
each takes its neighbour's end in the group; pairs that are edges, or one node twice, are left out. Defined cases: edges go
both ways, repeated ones and self-loops and those with an unknown end don't count; a node without neighbours has zero means;
all vectors must have one length; without edges the weights stay as drawn. Runs with one seed agree up to rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import cut, written

HIDDEN, OUT, EPOCHS = 128, 96, 12
RATE, DECAY, SEED = 1e-3, 1e-5, 42
GROUP = 64
_NAMES = ("a1", "b1", "c1", "a2", "b2", "c2")


def drawn_weights(width: int, hidden: int = HIDDEN, out: int = OUT, seed: int = SEED) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    shape = lambda a, b: draw.normal(0, 1 / np.sqrt(a), (a, b))
    return {"a1": shape(width, hidden), "b1": shape(width, hidden), "c1": np.zeros(hidden), "a2": shape(hidden, out), "b2": shape(hidden, out), "c2": np.zeros(out)}


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1] or 1, dtype=np.int32)[: len(rows) + 1]), pa.array(rows.ravel()))


def _mapped(rows: DataFrame, keep: str, step: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], columns: tuple[str, ...], made: str) -> DataFrame:
    """rows with their id and what `step` makes of the matrices of some columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = step({c: _matrix(batch[c]) for c in columns})
                yield pa.RecordBatch.from_pydict(({"id": batch["id"]} if keep else {}) | {c: _lists(v) for c, v in out.items()})

    return rows.select(*(["id"] if keep else []), *columns).mapInArrow(run, keep + made)


def both_ways(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, other) of edges between known nodes, each once in each direction."""
    ends = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))
    rows = edges.where("src <> dst").select(F.explode(ends).alias("e")).select("e.id", "e.other").distinct()
    for end in ("id", "other"):
        rows = rows.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return rows.select("id", "other")


def _gathered(adjacent: DataFrame, rows: DataFrame, value: str, mean: bool) -> DataFrame:
    """(id, value): the mean or sum of a vector over the rows next to each node."""
    near = adjacent.join(rows.select(F.col("id").alias("other"), array_to_vector(value).alias("v")), "other")
    total = Summarizer.mean(F.col("v")) if mean else Summarizer.sum(F.col("v"))
    return near.groupBy("id").agg(total.alias("v")).select("id", vector_to_array("v").alias(value))


def _with_zeros(rows: DataFrame, more: DataFrame, value: str, name: str, width: int) -> DataFrame:
    zeros = F.array_repeat(F.lit(0.0), width)
    return rows.join(more.withColumnRenamed(value, name), "id", "left").withColumn(name, F.coalesce(name, zeros))


def first_layer(inputs: DataFrame, w: dict[str, np.ndarray]) -> DataFrame:
    """(id, h) of inputs(id, x, m)."""
    return _mapped(inputs, "id string, ", lambda c: {"h": np.maximum(0, c["x"] @ w["a1"] + c["m"] @ w["b1"] + w["c1"])}, ("x", "m"), "h array<double>")


def second_layer(rows: DataFrame, w: dict[str, np.ndarray]) -> DataFrame:
    """(id, z, size) of rows(id, h, n): vectors of length 1 and the length they had; zeros stay."""

    def step(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        y = c["h"] @ w["a2"] + c["n"] @ w["b2"] + w["c2"]
        size = np.linalg.norm(y, axis=1, keepdims=True)
        size[size == 0] = 1
        return {"z": y / size, "size": size}

    return _mapped(rows, "id string, ", step, ("h", "n"), "z array<double>, size array<double>")


def sampled_pairs(adjacent: DataFrame, epoch: int, seed: int = SEED) -> DataFrame:
    """(u, v, label): each edge once with 1, and with 0 its start and another edge's end, where that is no edge."""
    edges = adjacent.where("id < other").select(F.col("id").alias("u"), F.col("other").alias("v"))
    hashed = edges.withColumn("at", F.xxhash64(F.lit(seed), F.lit(epoch), "u", "v"))
    groups = max(1, edges.count() // GROUP)
    window = Window.partitionBy(F.pmod("at", F.lit(groups))).orderBy("at", "u", "v")
    around = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = hashed.select("u", F.coalesce(F.lead("v").over(window), F.first("v").over(around)).alias("v")).where("u <> v")
    other = other.join(adjacent.select(F.col("id").alias("u"), F.col("other").alias("v")), ["u", "v"], "left_anti")
    return edges.withColumn("label", F.lit(1.0)).unionByName(other.withColumn("label", F.lit(0.0)))


@dataclass
class Step:
    """What a step over some pairs gives: the mean loss, and the gradient of each weight."""

    loss: float
    gradients: dict[str, np.ndarray]


def step(inputs: DataFrame, adjacent: DataFrame, pairs: DataFrame, w: dict[str, np.ndarray]) -> Step:
    """Loss and gradients of inputs(id, x, m) and pairs(u, v, label) at these weights."""
    hidden, out = w["a2"].shape
    h = written(first_layer(inputs, w))
    near = _gathered(adjacent, h, "h", True)
    rows = written(_with_zeros(h, near, "h", "n", hidden))
    z = written(second_layer(rows, w))
    ends = pairs.join(z.select(F.col("id").alias("u"), F.col("z").alias("a")), "u").join(z.select(F.col("id").alias("v"), F.col("z").alias("b")), "v")
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    ends = ends.withColumn("p", 1 / (1 + F.exp(-dot)))
    loss = -F.when(F.col("label") == 1, F.log("p")).otherwise(F.log1p(-F.col("p")))
    ends = written(ends.select("u", "v", "a", "b", (F.col("p") - F.col("label")).alias("g"), loss.alias("loss")))
    many, total = ends.agg(F.count("*"), F.avg("loss")).first()
    if not many:
        return Step(0.0, {n: np.zeros_like(x) for n, x in w.items()})
    scaled = lambda c: F.transform(c, lambda x: x * F.col("g") / many)
    sides = F.array(F.struct(F.col("u").alias("id"), scaled("b").alias("d")), F.struct(F.col("v").alias("id"), scaled("a").alias("d")))
    dz = ends.select(F.explode(sides).alias("s")).select("s.id", array_to_vector("s.d").alias("v")).groupBy("id").agg(Summarizer.sum(F.col("v")).alias("v")).select("id", vector_to_array("v").alias("d"))

    def through_length(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        dy = (c["d"] - (c["d"] * c["z"]).sum(1, keepdims=True) * c["z"]) / c["size"]
        return {"y": dy, "k": dy @ w["b2"].T}

    back = written(_mapped(dz.join(z, "id"), "id string, ", through_length, ("d", "z", "size"), "y array<double>, k array<double>"))
    degrees = adjacent.groupBy("id").agg(F.count("*").alias("degree"))
    shared = back.join(degrees, "id").select("id", F.transform("k", lambda x: x / F.col("degree")).alias("k"))
    # the mean of a node's neighbours sends its gradient back to each of them
    sent = _gathered(adjacent, shared, "k", False)
    full = _with_zeros(_with_zeros(rows.join(inputs, "id"), back.select("id", "y"), "y", "y", out), sent, "k", "k", hidden)

    def summed(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        dh = (c["y"] @ w["a2"].T + c["k"]) * (c["h"] > 0)
        parts = {"a1": c["x"].T @ dh, "b1": c["m"].T @ dh, "c1": dh.sum(0), "a2": c["h"].T @ c["y"], "b2": c["n"].T @ c["y"], "c2": c["y"].sum(0)}
        return {"g": np.concatenate([parts[n].ravel() for n in _NAMES])[None, :]}

    grown = _mapped(full, "", summed, ("x", "m", "h", "n", "y", "k"), "g array<double>")
    flat = np.array(grown.select(array_to_vector("g").alias("v")).agg(Summarizer.sum(F.col("v")).alias("v")).select(vector_to_array("v")).first()[0])
    cuts = np.cumsum([w[n].size for n in _NAMES])[:-1]
    return Step(total, {n: x.reshape(w[n].shape) for n, x in zip(_NAMES, np.split(flat, cuts))})


@dataclass
class Trained:
    """Weights, and the loss before each epoch's change of them."""

    weights: dict[str, np.ndarray]
    losses: list[float] = field(default_factory=list)


def prepared(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """inputs(id, x, m), adjacent(id, other) and the vectors' length, of nodes(id, x)."""
    adjacent = written(both_ways(nodes, edges))
    first = nodes.select(F.size("x").alias("n")).first()
    width = first.n if first else 0
    rows = nodes.select("id", F.col("x").cast("array<double>").alias("x"))
    return written(_with_zeros(rows, _gathered(adjacent, rows, "x", True), "x", "m", width)), adjacent, width


def train(nodes: DataFrame, edges: DataFrame, hidden: int = HIDDEN, out: int = OUT, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY, seed: int = SEED) -> Trained:
    """Weights for nodes(id, x) and edges(src, dst), by Adam with decay."""
    inputs, adjacent, width = prepared(nodes, edges)
    model = Trained(drawn_weights(width, hidden, out, seed))
    first, second = ({n: np.zeros_like(x) for n, x in model.weights.items()} for _ in range(2))
    for epoch in range(1, epochs + 1):
        found = step(inputs, adjacent, cut(sampled_pairs(adjacent, epoch, seed)), model.weights)
        model.losses.append(found.loss)
        for n, g in found.gradients.items():
            g = g + decay * model.weights[n]
            first[n], second[n] = 0.9 * first[n] + 0.1 * g, 0.999 * second[n] + 0.001 * g * g
            model.weights[n] = model.weights[n] - rate * (first[n] / (1 - 0.9**epoch)) / (np.sqrt(second[n] / (1 - 0.999**epoch)) + 1e-8)
    return model


def embedded(nodes: DataFrame, edges: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """(id, graph): the vector of every node at these weights."""
    inputs, adjacent, _ = prepared(nodes, edges)
    h = written(first_layer(inputs, weights))
    rows = _with_zeros(h, _gathered(adjacent, h, "h", True), "h", "n", weights["a2"].shape[0])
    return second_layer(rows, weights).select("id", F.col("z").alias("graph"))
