"""Labels through derived columns against a walk over the graph."""

import random

from adjudica import schemas
from adjudica.operators import lineage

LABELS = "field string, category string, regimes array<string>"
EDGES = "source string, target string"


def walked(labels, edges):
    tags = {}
    for field, category, regimes in labels:
        seen, todo = {field}, [field]
        while todo:
            at = todo.pop()
            mine = tags.setdefault(at, (set(), set()))
            mine[0].update([category] if category else [])
            mine[1].update(regimes or [])
            for source, target in edges:
                if source == at and target is not None and target not in seen and source is not None:
                    seen.add(target)
                    todo.append(target)
    order = schemas.PII_CATEGORIES
    return {f: (min(c, key=order.index) if c else None, sorted(r)) for f, (c, r) in tags.items()}


def found(spark, labels, edges):
    out = lineage.inherited_labels(spark.createDataFrame(labels, LABELS), spark.createDataFrame(edges, EDGES))
    return {r["field"]: (r["category"], r["regimes"]) for r in out.collect()}


def test_depth_six_with_a_diamond_and_a_cycle(spark):
    edges = [("a0", "a1"), ("a1", "a2"), ("a1", "b2"), ("a2", "a3"), ("b2", "a3"), ("a3", "a4"), ("a4", "a5"), ("a5", "a6")]
    edges += [("a6", "a4"), ("a6", "a6"), ("a0", "a1"), ("z", "a2"), ("q", None), (None, "q")]
    labels = [("a0", "sensitive", ["GLBA"]), ("b2", "direct", []), ("z", None, ["CCPA"]), ("a5", "quasi", None), ("alone", None, None)]
    got = found(spark, labels, edges)
    assert got["a6"] == ("direct", ["CCPA", "GLBA"])
    assert got["a2"] == ("sensitive", ["CCPA", "GLBA"])
    assert got["z"] == (None, ["CCPA"]) and got["b2"] == ("direct", ["GLBA"])
    want = walked(labels, edges)
    assert {f: v for f, v in got.items() if f != "alone"} == {f: v for f, v in want.items() if f != "alone"}
    assert got.get("alone", (None, [])) == (None, [])


def test_random_graphs_and_empty_tables(spark):
    draw = random.Random(11)
    names = [f"c{i}" for i in range(60)]
    edges = [(draw.choice(names), draw.choice(names)) for _ in range(90)]
    labels = [(draw.choice(names), draw.choice([None, *schemas.PII_CATEGORIES]), draw.sample(["A", "B", "C"], 2)) for _ in range(12)]
    assert found(spark, labels, edges) == walked(labels, edges)
    assert found(spark, [], edges) == {}
    assert found(spark, [("a", "quasi", ["A"])], []) == {"a": ("quasi", ["A"])}
