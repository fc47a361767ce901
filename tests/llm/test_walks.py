import random

import numpy as np

from quillgraph.llm import editprints, simhash


def test_walk_equals_one_step_a_time():
    """Straight from the method: at each time a coin of class and time says whether the walk goes on to the next character."""
    coins = np.random.default_rng(editprints.SEED).integers(0, 2, (editprints.CLASSES, editprints.PERIOD), dtype=np.uint8).astype(bool)
    coins[:, -1] = True
    walker, draw = editprints.Walker(), random.Random(5)
    for n in range(120):
        text = "".join(draw.choice("abcdeé日 \n😀") for _ in range(draw.choice([0, 1, 3, 4, 5, 97, 400])))
        codes, start = walker.classes(text), draw.choice([0, 1, editprints.PERIOD - 1, 5 * editprints.PERIOD + 7])
        time, left = start, []
        for code in codes:
            while not coins[code, time % editprints.PERIOD]:
                time += 1
            time += 1
            left.append(time)
        assert walker.walk(codes, start).tolist() == left, n


def test_bucket_rows_are_short_and_component_rounds_keep_few_partitions(spark, monkeypatch):
    walker, draw, asked, components = editprints.Walker(), random.Random(3), [], simhash.connected_components

    def recorded(links, *more, partitions=None, **rest):
        asked.append(partitions)
        return components(links, *more, partitions=partitions, **rest)

    monkeypatch.setattr(simhash, "connected_components", recorded)
    base = "".join(draw.choice("abcdefgh ") for _ in range(400))
    rows = [(n, walker.fingerprint(base + "x" * n)) for n in range(30)]
    prints = spark.createDataFrame(rows, "id long, fingerprint string")
    assert all(0 <= r.node < 2**40 for r in editprints._distinct(prints).collect())
    assert {r.near_group for r in editprints.near_groups(prints, editprints.LINKED).collect()} == {0}
    assert asked and None not in asked
