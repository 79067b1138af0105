import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vantage.llm.components import Forest, components


def roots(edges):
    group = {}

    def find(i):
        group.setdefault(i, i)
        while group[i] != i:
            i = group[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        group[max(x, y)] = min(x, y)
    return {i: find(i) for e in edges for i in e}


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
@settings(max_examples=100, deadline=None)
def test_forest(edges):
    f = Forest(31)
    for i in range(0, len(edges), 7):
        part = np.array(edges[i : i + 7]).reshape(-1, 2)
        f.union(part[:, 0], part[:, 1])
    want = roots(edges)
    assert all(f.roots()[i] == want.get(i, i) for i in range(31))


def test_components(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 260)]
    edges = path[::-1] + star + [(260, 259), (1, 1), (5, 3), (3, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (None, 4)], "a long, b long"), "a", "b").collect()}
    assert got == {k: v for k, v in roots(edges).items() if k != 1}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_contraction_and_one_task_agree(spark, monkeypatch):
    import random

    from vantage.llm import components as module

    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    frame = spark.createDataFrame(edges, "a long, b long")
    want = roots([e for e in edges if e[0] != e[1]])
    for limit in (0, 1 << 20):
        monkeypatch.setattr(module, "AT_ONCE", limit)
        assert {r.node: r.root for r in components(frame, "a", "b").collect()} == want
