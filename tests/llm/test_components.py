import random

from pointspark.llm.components import connected_components

SCHEMA = "a long, b long, root string"


def test_components_equal_brute_force(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1300)] + [(5000, i) for i in range(2000, 2200)]
    edges += [(7, 7), (-5, -9), (-9, -5), *edges[:20]]
    label = {x: x for e in edges for x in e}
    for a, b in edges:
        low, high = sorted((label[a], label[b]))
        label = {x: low if y == high else y for x, y in label.items()}
    table = spark.createDataFrame([(a, b, "x") for a, b in edges] + [(None, 1, "x"), (2, None, None), (None, None, None)], SCHEMA)
    assert {r.node: r.root for r in connected_components(table).collect()} == label


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], SCHEMA)).collect() == []
    assert connected_components(spark.createDataFrame([(None, 4, "x")], SCHEMA)).collect() == []
