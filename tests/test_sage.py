import numpy as np

from quillgraph.graph import sage


def graph():
    draw = np.random.default_rng(4)
    x = np.r_[draw.normal(0, 1, (10, 5)) + 2, draw.normal(0, 1, (10, 5)) - 2, draw.normal(0, 1, (1, 5))]
    ids = [f"n{n:02}" for n in range(21)]
    pairs = {(int(a), int(b)) for a, b in draw.integers(0, 10, (18, 2))} | {(int(a) + 10, int(b) + 10) for a, b in draw.integers(0, 10, (18, 2))} | {(2, 12)}
    return ids, x, [(ids[a], ids[b]) for a, b in sorted(pairs)] + [(ids[0], "lost"), (ids[1], ids[1]), (None, ids[2])]


def means(adjacency, h):
    degree = adjacency.sum(1, keepdims=True)
    return adjacency @ h / np.where(degree == 0, 1, degree)


def forward(x, adjacency, w):
    h = np.maximum(0, x @ w["a1"] + means(adjacency, x) @ w["b1"] + w["c1"])
    y = h @ w["a2"] + means(adjacency, h) @ w["b2"] + w["c2"]
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def plain_loss(x, adjacency, w, pairs):
    z = forward(x, adjacency, w)
    p = np.array([1 / (1 + np.exp(-z[u] @ z[v])) for u, v, _ in pairs])
    y = np.array([label for *_, label in pairs])
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def test_layers_and_gradients_equal_a_numpy_version(spark):
    ids, x, edges = graph()
    at = {i: n for n, i in enumerate(ids)}
    adjacency = np.zeros((len(ids), len(ids)))
    for s, d in edges:
        if s in at and d in at and s != d:
            adjacency[at[s], at[d]] = adjacency[at[d], at[s]] = 1
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, x array<double>").repartition(3)
    links = spark.createDataFrame(edges, "src string, dst string")
    w = sage.drawn_weights(5, 6, 4)
    got = {r.id: r.graph for r in sage.embedded(nodes, links, w).collect()}
    assert np.allclose([got[i] for i in ids], forward(x, adjacency, w))
    inputs, adjacent, _ = sage.prepared(nodes, links)
    pairs = sage.sampled_pairs(adjacent, 1)
    known = [(at[r.u], at[r.v], r.label) for r in pairs.collect()]
    assert sum(y for *_, y in known) == adjacency.sum() / 2
    assert all(u != v and (adjacency[u, v] == 1) == (y == 1) for u, v, y in known) and len(known) > adjacency.sum() / 2 + 5
    found = sage.step(inputs, adjacent, pairs, w)
    assert np.isclose(found.loss, plain_loss(x, adjacency, w, known))
    for name, value in w.items():
        for place in list(np.ndindex(value.shape))[::5]:
            moved = {}
            for sign in (1, -1):
                other = {n: v.copy() for n, v in w.items()}
                other[name][place] += sign * 1e-6
                moved[sign] = plain_loss(x, adjacency, other, known)
            assert abs(found.gradients[name][place] - (moved[1] - moved[-1]) / 2e-6) < 1e-5, (name, place)


def test_training_lowers_the_loss(spark):
    ids, x, edges = graph()
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, x array<double>")
    model = sage.train(nodes, spark.createDataFrame(edges, "src string, dst string"), 8, 6, epochs=4, rate=0.05)
    assert model.losses[-1] < model.losses[0] - 0.02
    none = sage.train(nodes, spark.createDataFrame([], "src string, dst string"), 8, 6, epochs=1)
    assert none.losses == [0.0]
