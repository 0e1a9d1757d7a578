"""Common ancestors, walks and sets of missing objects on small graphs with known answers."""

import inspect
import sys

import pytest

from strataquill.operators import graph, rewriting, trees
from strataquill.plans.closure import closure, longest


def parents(spark, spec):
    return spark.createDataFrame([(c, i + 1, p) for c, *ps in spec for i, p in enumerate(ps)] or [], "commit long, parent_no int, parent long")


def ids(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node long")


def got(df, column="node"):
    return sorted(r[column] for r in df.collect())


TWO = [[5, 1, 2], [4, 3, 1], [3, 2], [2, 0]]
NONE = [[4, 2], [3, 1], [1, 0]]
CHAIN = [[7, 4, 6], [6, 5], [4, 3], [3, 2], [5, 2], [2, 1]]
CROSS = [[6, 5, 3], [4, 3, 5], [3, 2], [5, 2], [2, 1]]


@pytest.mark.parametrize(("spec", "a", "b", "want"), [(TWO, 4, 5, [1, 2]), (NONE, 4, 3, []), (CHAIN, 4, 3, [3]), (CHAIN, 7, 4, [4]), (CROSS, 4, 6, [3, 5])])
def test_lowest_common(spark, spec, a, b, want):
    assert got(graph.lowest_common(parents(spark, spec), ids(spark, a), ids(spark, b))) == want


def test_merge_and_octopus_base(spark):
    p = parents(spark, [[2, 1], [3, 2], [10, 1], [11, 1], [12, 2]])
    assert got(graph.merge_base(p, [10, 11, 12])) == [1]
    p = parents(spark, [[2, 1], [4, 1], [3, 2], [5, 2]])
    assert got(graph.merge_base(p, [4, 3, 5])) == [1]
    assert got(graph.octopus_base(p, [3, 5, 4])) == [1]
    assert got(graph.merge_base(p, [3])) == [3]


def test_walks(spark):
    p = parents(spark, [[2, 1], [3, 2], [4, 1]])
    assert got(graph.walk(p, ids(spark, 4, 3), ids(spark, 2))) == [3, 4]
    assert got(graph.walk(p, ids(spark, 3), ids(spark, 4))) == [2, 3]
    p = parents(spark, [[2, 1], [3, 1], [4, 2, 3]])
    assert got(graph.walk(p, ids(spark, 4))) == [1, 2, 3, 4]
    assert got(graph.walk(p, ids(spark, 4), ids(spark, 2))) == [3, 4]


def test_depth_and_generation_of_a_long_chain(spark):
    n = 40
    p = parents(spark, [[i, i - 1] for i in range(1, n)])
    commits = spark.range(n).selectExpr("id as commit")
    assert {r.commit: r.generation for r in graph.generations(commits, p).collect()} == {i: i + 1 for i in range(n)}
    assert graph.depth_of(p, ids(spark, n - 1)).first().depth == n
    assert graph.depth_of(p, ids(spark, n - 1), 5).first().depth == 5


def test_closures_have_no_bound_on_depth(spark, monkeypatch):
    """4000 links take a thousand jobs, so the bounds are looked for by name and the tables' folding is met on a shorter chain."""
    for f in (closure, longest, trees.flatten, rewriting.follow):
        assert "most" not in inspect.signature(f).parameters
    monkeypatch.setattr(sys.modules[closure.__module__], "FOLD", 2)
    edges = spark.createDataFrame([(i, i + 1) for i in range(18)], "src long, dst long")
    want = [(i, i) for i in range(19)]
    assert sorted(map(tuple, closure(edges, ids(spark, 0)).collect())) == want
    assert sorted(map(tuple, longest(edges, ids(spark, 0)).collect())) == want


def test_longest_raises_on_a_cycle(spark):
    with pytest.raises(ValueError, match="cycle"):
        longest(spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "src long, dst long"), ids(spark, 0))


def test_shallow_overlaps(spark):
    p = parents(spark, [[3, 2, 1], [2, 1]])
    at, before = graph.shallow(p, ids(spark, 3), 2)
    assert got(at) == [1, 2] and got(before) == [3]


def test_independent_and_ancestor(spark):
    p = parents(spark, [[2, 1], [3, 2], [4, 1]])
    assert got(graph.independent(p, ids(spark, 1, 2, 3, 4))) == [3, 4]
    assert graph.is_ancestor(p, ids(spark, 1), ids(spark, 3)).first().is_ancestor
    assert not graph.is_ancestor(p, ids(spark, 4), ids(spark, 3)).first().is_ancestor


def test_closure_with_cycle_stop_and_bound(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src long, dst long")
    assert {(r.node, r.depth) for r in closure(e, ids(spark, 1)).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)}
    assert got(closure(e, ids(spark, 1), stop=ids(spark, 3))) == [1, 2]
    assert got(closure(e, ids(spark, 1), max_depth=2)) == [1, 2, 3]
    assert closure(e, ids(spark, 1).limit(0)).count() == 0
    assert longest(e.where("src <> 3 or dst <> 1"), ids(spark, 1)).where("node = 5").first().depth == 4


def test_missing_objects_and_tags(spark):
    e = spark.createDataFrame([("c1", "t1"), ("t1", "f1"), ("t1", "f2"), ("c2", "c1"), ("c2", "t2"), ("t2", "f2"), ("t2", "f3")], "src string, dst string")
    n = lambda *x: spark.createDataFrame([(i,) for i in x], "node string")
    assert got(graph.missing_objects(e, n("c1"), n("c2"))) == ["c2", "f3", "t2"]
    tags = spark.createDataFrame([("a", "b"), ("b", "c2")], "tag string, target string")
    assert {tuple(r) for r in graph.peel(tags, spark.createDataFrame([("a",), ("c1",)], "oid string")).collect()} == {("a", "c2"), ("c1", "c1")}


def test_bisect(spark):
    p = parents(spark, [[i, i - 1] for i in range(2, 10)])
    c = graph.bisect_candidates(p, ids(spark, 9), ids(spark, 2))
    assert got(c) == [3, 4, 5, 6, 7, 8]
    row = graph.bisect_next(c).first()
    assert (row.remaining, row.steps) == (6, 2) and row.node == 5


def plain_depths(edges, seeds, far=min):
    """Least (or largest) number of edges from the seeds, by relaxation."""
    depth = {n: 0 for n in seeds}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in depth and (b not in depth or far(depth[b], depth[a] + 1) != depth[b]):
                depth[b] = depth[a] + 1
                changed = True
    return depth


@pytest.mark.parametrize("seed", range(3))
def test_contracted_runs_give_the_same_depths(spark, monkeypatch, seed):
    """Chains of several lengths between a few branching points, with a shortcut and a dead end; runs are contracted at once."""
    import random

    monkeypatch.setattr(sys.modules[closure.__module__], "DEEP", 1)
    monkeypatch.setattr(sys.modules[closure.__module__], "LEVELS", 1)
    rng, edges, n = random.Random(seed), [], 100
    for _ in range(9):
        a, b = sorted(rng.sample(range(8), 2))
        last = a
        for _ in range(rng.randint(0, 12)):
            edges.append((last, n))
            last, n = n, n + 1
        edges.append((last, b))
    edges += [(7, n), (n, n + 1), (n + 50, n + 51)]
    e = spark.createDataFrame(edges, "src long, dst long")
    want = plain_depths(edges, [0, 3])
    assert {r.node: r.depth for r in closure(e, ids(spark, 0, 3)).collect()} == want
    assert {r.node: r.depth for r in closure(e, ids(spark, 0, 3), max_depth=9).collect()} == {k: v for k, v in want.items() if v <= 9}
    blocked = [x for x in want if x > 100][:2]
    inside = [(a, b) for a, b in edges if a not in blocked and b not in blocked]
    assert {r.node: r.depth for r in closure(e, ids(spark, 0, 3), stop=ids(spark, *blocked)).collect()} == plain_depths(inside, [0, 3])
    by = {(r.k, r.node): r.depth for r in closure(e, spark.createDataFrame([(1, 0), (2, 3)], "k long, node long"), keys=("k",)).collect()}
    assert by == {(k, x): d for k, s in ((1, 0), (2, 3)) for x, d in plain_depths(edges, [s]).items()}
    unique = sorted(set(edges))
    assert {r.node: r.depth for r in longest(e, ids(spark, 0)).collect()} == plain_depths(unique, [0], max)


def test_a_chain_of_5000_commits(spark):
    n = 5000
    p = spark.range(1, n).selectExpr("id as commit", "1 as parent_no", "id - 1 as parent")
    found = graph.generations(spark.range(n).selectExpr("id as commit"), p).selectExpr("count(*) as n", "count_if(generation = commit + 1) as right").first()
    assert (found.n, found.right) == (n, n)
    assert graph.missing_objects(p.selectExpr("commit as src", "parent as dst"), ids(spark, 10), ids(spark, n - 1)).count() == n - 11
