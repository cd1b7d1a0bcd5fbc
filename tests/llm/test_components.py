"""Components against a plain search, on paths, stars, random graphs and odd input."""

from __future__ import annotations

import random

import pytest

from sessionloom.llm.components import components


def searched(edges):
    near: dict[int, set[int]] = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        if start not in out:
            todo = [start]
            while todo:
                v = todo.pop()
                if v not in out:
                    out[v] = start
                    todo += near[v]
    return out


def cases():
    rng = random.Random(3)
    path = [(i, i + 1) for i in range(60)]
    rng.shuffle(path)
    yield "path", path
    yield "star", [(50, i) for i in range(100) if i != 50]
    yield "random", [(rng.randrange(200), rng.randrange(200)) for _ in range(160)]
    yield "odd", [(3, 3), (5, 4), (4, 5), (5, 4), (9, 8)]


@pytest.mark.parametrize("name,edges", list(cases()))
def test_components(spark, name, edges):
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == searched(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
