"""Graph operators against plain searches; rounds of long graphs; hubs and graphs without cheap nodes."""

import random

from codeloom.operators import graph


def searched(pairs):
    """What each node reaches, itself included."""
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    reach = {}
    for start in out:
        seen, stack = {start}, [start]
        while stack:
            for x in out[stack.pop()] - seen:
                seen.add(x)
                stack.append(x)
        reach[start] = seen
    return reach


def components(pairs):
    reach = searched(pairs)
    of = {x: {y for y in reach[x] if x in reach[y]} for x in reach}
    return {(x, min(ys)) for x, ys in of.items() if len(ys) > 1}


def check(spark, pairs):
    edges = spark.createDataFrame(pairs, "src long, dst long")
    assert {tuple(r) for r in graph.strong_components(edges).select("node", "component").collect()} == components(pairs)
    reach = searched(pairs)
    own = {x: (1 << x % 61 if x % 3 == 0 else 0, 1 if x % 7 == 0 else 0) for x in reach} | {-5: (8, 0)}
    masks = spark.createDataFrame([(x, a, b) for x, (a, b) in own.items() if a or b], "node long, m0 long, m1 long")
    got = {r.node: (r.m0, r.m1) for r in graph.propagate_masks(masks, edges).collect()}
    want = {-5: (8, 0)}
    for x, ys in reach.items():
        a = b = 0
        for y in ys:
            a, b = a | own[y][0], b | own[y][1]
        if a or b:
            want[x] = (a, b)
    assert got == want


def test_against_search(spark, monkeypatch):
    """Elimination from the start, without plain rounds. Random graphs of several densities, a hub, a thick cycle, in one table."""
    rng = random.Random(3)
    parts = [[(rng.randrange(n), rng.randrange(n)) for _ in range(m)] for n, m in ((8, 10), (20, 28), (40, 60), (60, 200))]
    parts.append([(x, 100) for x in range(20)] + [(100, x) for x in range(30, 50)] + [(35, 3), (36, 36), (7, 8)])
    parts.append([(a, b) for layer in range(6) for a in range(4 * layer, 4 * layer + 4) for b in range(4 * layer + 4, 4 * layer + 8)] + [(27, 0)])
    monkeypatch.setattr(graph, "PLAIN", 0)
    check(spark, [(1000 * n + a, 1000 * n + b) for n, pairs in enumerate(parts) for a, b in pairs])


def test_plain_rounds(spark, monkeypatch):
    """Short paths are settled by plain rounds; longer ones too if nothing may be taken out."""
    check(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 6)])
    monkeypatch.setattr(graph, "FILLS", ())
    monkeypatch.setattr(graph, "PLAIN", 1)
    check(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 6)])


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    """A ring with a chain into it: a few rounds more for a graph several times as long."""
    rounds, one = [], graph._round
    monkeypatch.setattr(graph, "_round", lambda *a: rounds.append(1) or one(*a))
    took = []
    for n in (60, 960):
        rounds.clear()
        ring = [(i, (i + 1) % n) for i in range(n)] + [(n + i, n + i + 1) for i in range(n // 4)] + [(n + n // 4, 0)]
        edges = spark.createDataFrame(ring, "src long, dst long")
        assert {tuple(r) for r in graph.strong_components(edges).select("node", "component").collect()} == {(i, 0) for i in range(n)}
        took.append(len(rounds))
    assert took[1] <= took[0] + 12 and took[1] <= 24


def test_none(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert graph.strong_components(none).count() == 0
    masks = spark.createDataFrame([(1, 2)], "node long, m0 long")
    assert [tuple(r) for r in graph.propagate_masks(masks, none).collect()] == [(1, 2)]
    assert graph.propagate_masks(masks.limit(0), spark.createDataFrame([(1, 2)], "src long, dst long")).count() == 0


def test_pieces_of_a_few_edges(spark, monkeypatch):
    """Pieces that cut components, nodes and chains in two agree with plain searches, all pairs too."""
    rng = random.Random(5)
    parts = [[(rng.randrange(n), rng.randrange(n)) for _ in range(m)] for n, m in ((8, 10), (30, 40), (40, 60))]
    pairs = [(1000 * n + a, 1000 * n + b) for n, part in enumerate(parts) for a, b in part] + [(-9, -8), (-8, -8), (-7, -9)]
    monkeypatch.setattr(graph, "PIECE", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        check(spark, pairs)
        told = graph.reachable(spark.createDataFrame(pairs, "src long, dst long")).collect()
        out = {}
        for a, b in pairs:
            out.setdefault(a, set()).add(b)
        reach = searched(pairs)
        want = {(a, c) for a, bs in out.items() for b in bs for c in reach[b]}
        assert len(told) == len(want) and {tuple(r) for r in told} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_what_lies_in_a_piece_takes_no_rounds(spark, monkeypatch):
    def none(*_):
        raise AssertionError("a round")

    monkeypatch.setattr(graph, "_coloured", none)
    monkeypatch.setattr(graph, "_carried", lambda edges, masks, real=graph._carried: none() if edges.count() else real(edges, masks))
    blocks = [(12 * n + k, 12 * n + (k * 7 + n) % 12) for n in range(50) for k in range(12)]
    check(spark, blocks)


def test_long_ways_are_short_outside_of_their_pieces(spark, monkeypatch):
    """A ring with a chain into it, cut in pieces: a few edges of each go on to rounds; all nodes are settled again."""
    left, one = [], graph._shortened
    monkeypatch.setattr(graph, "_shortened", lambda edges: left.append(one(edges)) or left[-1])
    monkeypatch.setattr(graph, "PIECE", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 32)
    try:
        n = 1000
        ring = [(i, (i + 1) % n) for i in range(n)] + [(n + i, n + i + 1) for i in range(200)] + [(n + 200, 0)]
        edges = spark.createDataFrame(ring, "src long, dst long")
        assert {tuple(r) for r in graph.strong_components(edges).select("node", "component").collect()} == {(i, 0) for i in range(n)}
        masks = spark.createDataFrame([(500, 1), (n + 150, 2)], "node long, m0 long")
        got = {r.node: r.m0 for r in graph.propagate_masks(masks, edges).collect()}
        assert got == {i: 1 for i in range(n)} | {n + i: 3 if i <= 150 else 1 for i in range(201)}
        assert len(left) == 2 and all(x.count() < 200 for x in left)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
