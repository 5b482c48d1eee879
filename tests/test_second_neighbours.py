import itertools

from pairloom.operators import graph


def test_second_neighbours_of_many_cells_alike(spark):
    """Cells with the same contacts count once until the end; all pairs are there, none twice."""
    pairs = {(0, i) for i in range(2, 40)} | {(1, i) for i in range(2, 40)} | {(0, 1), (50, 51), (51, 52), (39, 50)}
    edges = spark.createDataFrame(sorted(pairs), "a long, b long")
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {(a, c) for a in near for b in near[a] for c in near[b]} - {(a, b) for a in near for b in {a, *near[a]}}
    ends = graph.both_ways(edges)
    alike = {r["src"]: r["class"] for r in graph.classes(ends).collect()}
    assert all((alike[a] == alike[b]) == (near[a] == near[b]) for a, b in itertools.product(near, near)) and alike[38] == 2
    old, graph.MEMBERS = graph.MEMBERS, 7
    try:
        got = [tuple(r) for r in graph.second_neighbours(edges).collect()]
    finally:
        graph.MEMBERS = old
    assert len(got) == len(set(got)) and set(got) == want
