"""Graph operators: reachability, strongly connected components, propagation of sets.

Components and sets come from elimination. A node with few ways in and out is taken out of the graph, and each way through
it becomes an edge, so that what reaches what stays as it is; of neighbours one is taken at a time, by a hash that
changes with the round. A round takes a part of all such nodes (a third of a chain's), whatever the length of paths, so
rounds grow with the logarithm of the graph; what was taken out is then settled in the opposite order. Graphs of short
paths need none of that: a few plain rounds, along one edge each, are tried first. Where nothing cheap is left (hubs,
dense cores), paths are short again, and plain rounds do the rest. Every round is a few joins and sums of shrinking
tables; no task or driver holds a graph.

Before all that, edges are range-sorted by src and cut in pieces of at most PIECE rows. A piece has all edges of its nodes, so
what happens within it is settled there: its strong components become one node each, and what leads to no node of another
piece has no part in the rounds. Nodes near each other in their order (files of a folder, functions of a module) often are in
the graph too. Long ways through a piece are made short there: of what leads to other pieces, nodes with few ways through them
that no other piece leads to go, each way an edge; when the rounds are done, they are settled in their piece again. A chain or
ring of all nodes in order leaves a few nodes a piece.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written

#: A node may be taken out if it has at most so many times as many ways through it as edges; grown as little is left that
#: costs less.
FILLS = (1, 2, 4, 8)
#: A round that leaves more than this share of the edges has stalled.
STALLED = 0.95
#: Plain rounds that are tried first.
PLAIN = 12
SOURCE, SINK, CHOSEN, REST = range(4)
#: Rows of a piece.
PIECE = 1 << 18


def _pieces(batches, size: int):
    """Batches sorted by src, as (rows, whole): tables of about `size` rows, and which rows are of nodes that have all their
    rows in the piece. The first and last src of a piece may have rows in others."""
    held, n, cut = [], 0, None

    def piece(last: bool):
        rows = pa.Table.from_batches(held).combine_chunks()
        src = rows["src"].combine_chunks()
        whole = pc.fill_null(pc.not_equal(src, cut), True) if cut is not None else pa.array([True] * len(src))
        end = src[len(src) - 1]
        return rows, whole if last else pc.and_(whole, pc.not_equal(src, end)), end

    for batch in batches:
        if not batch.num_rows:
            continue
        held, n = [*held, batch], n + batch.num_rows
        if n >= size:
            rows, whole, cut = piece(False)
            yield rows, whole.to_pylist()
            held, n = [], 0
    if n:
        rows, whole, _ = piece(True)
        yield rows, whole.to_pylist()


def _components(first: list[int], to: list[int]) -> list[int]:
    """Strong components (Tarjan's) of nodes that have the edges to[first[i]:first[i + 1]], as numbers: edges lead to equal
    or lower ones."""
    n = len(first) - 1
    low, number, found, at, stack, count, seen = [0] * n, [0] * n, [-1] * n, first[:], [], 0, 0
    for root in range(n):
        path = [] if number[root] else [root]
        while path:
            v = path[-1]
            if not number[v]:
                seen += 1
                number[v] = low[v] = seen
                stack.append(v)
            if at[v] < first[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if not number[w]:
                    path.append(w)
                elif found[w] < 0:
                    low[v] = min(low[v], number[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == number[v]:
                while found[v] < 0:
                    found[stack.pop()] = count
                count += 1
    return found


class _Piece:
    """Nodes of a piece, whose edges are all in it; each one's component, that one's least node (`name`), and whether it
    leads to a node of another piece. Edges of other nodes are `passed` on."""

    def __init__(self, src: list, dst: list, whole: list[bool]):
        self.nodes = list(dict.fromkeys(s for s, w in zip(src, whole) if w))
        place = {node: i for i, node in enumerate(self.nodes)}
        self.place, self.passed = place, [(s, d) for s, d, w in zip(src, dst, whole) if not w and d is not None]
        n = len(self.nodes)
        inner: list[list[int]] = [[] for _ in range(n)]
        self.out: list[list] = [[] for _ in range(n)]
        self.sinks: list[list] = [[] for _ in range(n)]
        for s, d, w in zip(src, dst, whole):
            if w and d is not None:
                if d in place:
                    inner[place[s]].append(place[d])
                else:  # a node without rows between those of the piece has no edges
                    (self.sinks if self.nodes[0] < d < self.nodes[-1] else self.out)[place[s]].append(d)
        first = [0]
        for targets in inner:
            first.append(first[-1] + len(targets))
        self.inner, self.of = inner, _components(first, [t for targets in inner for t in targets])
        count = max(self.of, default=-1) + 1
        self.members: list[list[int]] = [[] for _ in range(count)]
        for i, c in enumerate(self.of):
            self.members[c].append(i)
        self.name = [self.nodes[m[0]] for m in self.members]
        self.below = [{self.of[t] for i in m for t in inner[i]} - {c} for c, m in enumerate(self.members)]
        self.leads = [False] * count
        for c, m in enumerate(self.members):
            self.leads[c] = any(self.out[i] for i in m) or any(self.leads[b] for b in self.below[c])

    def left(self) -> list[tuple]:
        """Edges between components that may be part of paths through other pieces."""
        found = list(self.passed)
        for c, m in enumerate(self.members):
            found += [(self.name[c], self.name[b]) for b in self.below[c] if self.leads[b]]
            found += [(self.name[c], d) for d in {d for i in m for d in self.out[i]}]
        return found


def _by_src(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange("src").sortWithinPartitions("src")


def _contracted(edges: DataFrame, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, label) of the nodes that share a component within a piece, and the edges that are left between labels, with the
    piece that has all of src's (null if several do)."""
    size = size or PIECE

    def run(batches):
        for nth, (rows, whole) in enumerate(_pieces(batches, size)):
            src, dst = (rows[c].to_pylist() for c in ("src", "dst"))
            piece = _Piece(src, dst, whole)
            same = [(piece.nodes[i], piece.name[c]) for c, m in enumerate(piece.members) if len(m) > 1 for i in m]
            left = piece.left()
            columns = [pa.array([x[at] for x in same + left], rows.schema.field("src").type) for at in (0, 1)]
            numbers = [None] * (len(same) + len(piece.passed)) + [_number(nth)] * (len(left) - len(piece.passed))
            yield pa.RecordBatch.from_arrays([*columns, pa.array([True] * len(same) + [False] * len(left), pa.bool_()), pa.array(numbers, pa.int64())], ["src", "dst", "same", "piece"])

    kind = edges.schema["src"].dataType.simpleString()
    found = written(_by_src(edges).mapInArrow(run, f"src {kind}, dst {kind}, same boolean, piece long"), "pieces")
    labels, left = found.where("same").select(F.col("src").alias("node"), F.col("dst").alias("label")), found.where("not same").select("src", "dst", "piece")
    known = labels.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_semi").toDF("dst", "label")
    return labels, left.join(known, "dst", "left").select("src", F.coalesce("label", "dst").alias("dst"), "piece")


def _number(nth: int) -> int:
    """Of a task's nth piece."""
    return TaskContext.get().partitionId() << 32 | nth


#: A node with more ways into it or out of it stays.
MOST_WAYS = 8


def _shorter(src: list, dst: list, entered: list) -> list[tuple]:
    """The edges of a piece without the nodes that have few ways through them and no way in from another piece."""
    out: dict = {}
    for s, d in zip(src, dst):
        out.setdefault(s, set()).add(d)
    into: dict = {node: set() for node in out}
    for s, targets in out.items():
        for d in targets & into.keys():
            into[d].add(s)
    kept = {s for s, e in zip(src, entered) if e}
    for v in [node for node in out if node not in kept]:
        a, b = into[v], out[v]
        if v in a or max(len(a), len(b)) > MOST_WAYS or len(a) * len(b) > len(a) + len(b):
            continue
        for s in a:
            out[s].discard(v)
            out[s] |= b
        for d in b & into.keys():
            into[d].discard(v)
            into[d] |= a
        del out[v], into[v]
    return [(s, d) for s, targets in out.items() for d in targets]


def _shortened(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, piece) of which each piece's are made short: src, dst."""
    of = edges.select(F.col("src").alias("dst"), F.col("piece").alias("to")).distinct()
    # a piece leads to its own nodes, to another's, or to such as several have
    crossing = edges.join(of, "dst", "left").where("piece is null or to is null or piece <> to")
    marked = edges.where("piece is not null").join(crossing.select(F.col("dst").alias("src"), F.lit(True).alias("entered")).distinct(), "src", "left")

    def run(rows: pa.Table) -> pa.Table:
        left = _shorter(*(rows[c].to_pylist() for c in ("src", "dst", "entered")))
        return pa.table([pa.array([x[at] for x in left], rows.schema.field("src").type) for at in (0, 1)], ["src", "dst"])

    kind = edges.schema["src"].dataType.simpleString()
    short = marked.groupBy("piece").applyInArrow(run, f"src {kind}, dst {kind}")
    return written(short.where("src <> dst").unionByName(edges.where("piece is null").select("src", "dst")).distinct(), "edges")


def _numbered(src: list, dst: list) -> tuple[dict, list[int]]:
    """The nodes' places, and their components in the order of _components."""
    place = {node: i for i, node in enumerate(dict.fromkeys([*src, *dst]))}
    to: list[list[int]] = [[] for _ in place]
    for s, d in zip(src, dst):
        to[place[s]].append(place[d])
    first = [0]
    for targets in to:
        first.append(first[-1] + len(targets))
    return place, _components(first, [t for targets in to for t in targets])


def _labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """labels, and those of the nodes of each piece (src, dst, piece) that lie on ways between nodes of one label."""
    here = edges.where("piece is not null")
    for end in ("src", "dst"):
        here = here.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")), end, "left")

    def run(rows: pa.Table) -> pa.Table:
        src, dst, *known = (rows[c].to_pylist() for c in ("src", "dst", "src_label", "dst_label"))
        # nodes of a label are one
        s, d = ([(label is not None, node if label is None else label) for node, label in zip(*ends)] for ends in ((src, known[0]), (dst, known[1])))
        place, of = _numbered(s, d)
        label_of = {of[i]: node for (labelled, node), i in place.items() if labelled}
        found = {node: label_of[c] for node, x in zip(src, s) if not x[0] and (c := of[place[x]]) in label_of}
        return pa.table([pa.array(x, rows.schema.field("src").type) for x in (list(found), list(found.values()))], ["node", "label"])

    kind = edges.schema["src"].dataType.simpleString()
    return labels.unionByName(here.groupBy("piece").applyInArrow(run, f"node {kind}, label {kind}"))


def _united_in_pieces(masks: DataFrame, edges: DataFrame, known: DataFrame, rest: DataFrame, columns: list[str]) -> DataFrame:
    """Of each piece's nodes (src of src, dst, piece) that aren't in rest (node): masks united with what they reach. known
    are the united masks of nodes in rest."""
    here = edges.where("piece is not null").join(rest.withColumn("is_in", F.lit(True)).withColumnRenamed("node", "src"), "src", "left_anti")
    places = here.select("src", "piece").distinct()
    whole = known.select(F.col("node").alias("dst"), *columns)
    own = places.join(masks.withColumnRenamed("node", "src"), "src").select("src", F.col("src").alias("dst"), "piece", *columns)
    rows = here.select("src", "dst", "piece").join(whole, "dst", "left").select("src", "dst", "piece", *columns).unionByName(own)

    def run(rows: pa.Table) -> pa.Table:
        src, dst, *bits = (rows[c].to_pylist() for c in ("src", "dst", *columns))
        place, of = _numbered(src, dst)
        sets = [[0] * len(columns) for _ in range(max(of, default=-1) + 1)]
        # a row's bits are those of its dst, or of src itself; components that edges lead to have lower numbers
        for nth in sorted(range(len(src)), key=lambda i: of[place[src[i]]]):
            into, found = sets[of[place[src[nth]]]], sets[of[place[dst[nth]]]]
            for b, column in enumerate(bits):
                into[b] |= found[b] | (column[nth] or 0)
        nodes = [n for n in dict.fromkeys(src) if any(sets[of[place[n]]])]
        return pa.table([pa.array(nodes, rows.schema.field("src").type), *(pa.array([sets[of[place[n]]][b] for n in nodes], pa.int64()) for b in range(len(columns)))], ["node", *columns])

    kind = edges.schema["src"].dataType.simpleString()
    return rows.groupBy("piece").applyInArrow(run, ", ".join([f"node {kind}", *(f"{c} long" for c in columns)]))


def _settled(masks: DataFrame, edges: DataFrame, columns: list[str], size: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """masks of nodes that lead to no other piece, united with all they reach; those of others with what they reach in
    their own; and the edges that are left, with the piece that has all of src's (null if several do)."""
    size = size or PIECE

    def run(batches):
        for at, (rows, whole) in enumerate(_pieces(batches, size)):
            src, dst, *bits = (rows[c].to_pylist() for c in ("src", "dst", *columns))
            piece = _Piece(src, dst, whole)
            own, more = [[0] * len(columns) for _ in piece.members], []
            for nth, (s, d, w) in enumerate(zip(src, dst, whole)):
                if d is None and w:
                    into = own[piece.of[piece.place[s]]]
                    for b, column in enumerate(bits):
                        into[b] |= column[nth]
                elif d is None:
                    more.append((s, None, False, None, *(column[nth] for column in bits)))
            for c, m in enumerate(piece.members):
                for b in piece.below[c]:
                    own[c] = [x | y for x, y in zip(own[c], own[b])]
                if any(own[c]):
                    more += [(piece.nodes[i], None, not piece.leads[c], None, *own[c]) for i in m]
                if piece.leads[c]:
                    more += [(piece.nodes[i], piece.name[c], False, _number(at), *[0] * len(columns)) for i in m[1:]]
            more += [(s, d, False, None if i < len(piece.passed) else _number(at), *[0] * len(columns)) for i, (s, d) in enumerate(piece.left())]
            kinds = [rows.schema.field("src").type] * 2 + [pa.bool_(), pa.int64()] + [pa.int64()] * len(columns)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*more), kinds)] if more else [pa.array([], t) for t in kinds], ["src", "dst", "final", "piece", *columns])

    kind = edges.schema["src"].dataType
    rows = edges.select("src", "dst", *[F.lit(0).cast("long").alias(c) for c in columns]).unionByName(masks.select(F.col("node").cast(kind).alias("src"), F.lit(None).cast(kind).alias("dst"), *columns))
    found = written(_by_src(rows).mapInArrow(run, ", ".join([f"src {kind.simpleString()}, dst {kind.simpleString()}, final boolean, piece long", *(f"{c} long" for c in columns)])), "pieces")
    of = lambda test: found.where(test).select(F.col("src").alias("node"), *columns)
    return of("dst is null and final"), of("dst is null and not final"), found.where("dst is not null").select("src", "dst", "piece").distinct()


def propagate(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """The least (node, value) rows that hold facts and, for each edge (src, dst), all values of dst at src. A round
    takes only the rows that the round before found, and compares what it finds with all that is known."""
    edges = written(edges.select("src", "dst").distinct(), "edges")
    known = [written(facts.select("node", "value").distinct(), "known")]
    while not known[-1].isEmpty():
        step = known[-1].join(edges, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), "value").distinct()
        known.append(written(step.join(reduce(DataFrame.unionAll, known), ["node", "value"], "left_anti"), "known"))
    return reduce(DataFrame.unionAll, known)


def _closed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All pairs (src, dst) of nodes that lead to no other piece, and the edges of all other nodes."""
    size = PIECE

    def pairs(piece: _Piece):
        for c, m in enumerate(piece.members):
            if not piece.leads[c]:
                seen, todo = {c} if len(m) > 1 or m[0] in piece.inner[m[0]] else set(), list(piece.below[c])
                while todo:
                    if (b := todo.pop()) not in seen:
                        seen.add(b)
                        todo += piece.below[b]
                ends = [piece.nodes[i] for b in seen for i in piece.members[b]] + list({d for b in seen | {c} for i in piece.members[b] for d in piece.sinks[i]})
                for i in m:
                    yield [piece.nodes[i]] * len(ends), ends, True
            else:
                for i in m:
                    ends = [piece.nodes[t] for t in piece.inner[i]] + piece.out[i] + piece.sinks[i]
                    yield [piece.nodes[i]] * len(ends), ends, False
        for s, d in piece.passed:
            yield [s], [d], False

    def run(batches):
        for rows, whole in _pieces(batches, size):
            kinds, held = [rows.schema.field("src").type] * 2 + [pa.bool_()], ([], [], [])
            for src, dst, closed in pairs(_Piece(*(rows[c].to_pylist() for c in ("src", "dst")), whole)):
                for at in range(0, len(src), 1 << 16):
                    for column, more in zip(held, (src[at : at + (1 << 16)], dst[at : at + (1 << 16)])):
                        column.extend(more)
                    held[2].extend([closed] * (len(held[0]) - len(held[2])))
                    if len(held[0]) >= 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(held, kinds)], ["src", "dst", "closed"])
                        held = ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(held, kinds)], ["src", "dst", "closed"])

    kind = edges.schema["src"].dataType.simpleString()
    found = written(_by_src(edges).mapInArrow(run, f"src {kind}, dst {kind}, closed boolean"), "pieces")
    return found.where("closed").select("src", "dst"), found.where("not closed").select("src", "dst").distinct()


def reachable(edges: DataFrame) -> DataFrame:
    """(src, dst) for every path of at least one edge."""
    closed, edges = _closed(edges.select("src", "dst").where("src is not null and dst is not null"))
    needed = closed.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    pairs = propagate(edges.unionByName(needed).toDF("node", "value"), edges)
    pairs = pairs.select(F.col("node").alias("src"), F.col("value").alias("dst"))
    return closed.unionByName(pairs.join(needed.select("src").distinct(), "src", "left_anti"))


@dataclass
class Round:
    """Edges of a graph by what becomes of their ends: src, dst, and kinds src_is, dst_is. Sources go first, then sinks,
    then the chosen, no two of which are neighbours."""

    flagged: DataFrame

    @property
    def kinds(self) -> DataFrame:
        return self.flagged.select(F.col("src").alias("node"), F.col("src_is").alias("is")).union(self.flagged.select("dst", "dst_is")).distinct()

    @property
    def from_sources(self) -> DataFrame:
        return self.flagged.where(F.col("src_is") == SOURCE)

    @property
    def to_sinks(self) -> DataFrame:
        return self.flagged.where((F.col("src_is") != SOURCE) & (F.col("dst_is") == SINK))

    def _between(self, src: Column, dst: Column) -> DataFrame:
        return self.flagged.where((F.col("src_is") != SOURCE) & (F.col("dst_is") != SINK)).where(src & dst).select("src", "dst")

    @property
    def into_chosen(self) -> DataFrame:
        return self._between(F.lit(True), F.col("dst_is") == CHOSEN)

    @property
    def out_of_chosen(self) -> DataFrame:
        return self._between(F.col("src_is") == CHOSEN, F.lit(True))

    def left(self) -> DataFrame:
        """The edges of what remains."""
        rest = self._between(F.col("src_is") == REST, F.col("dst_is") == REST)
        ways = self.into_chosen.toDF("src", "via").join(self.out_of_chosen.toDF("via", "dst"), "via").where("src <> dst").select("src", "dst")
        return rest.union(ways).distinct()


def _round(edges: DataFrame, nth: int, fill: int) -> Round:
    """What to take out of a graph next. A node of few ways is chosen if its hash is less than its neighbours'."""
    rank = lambda c: F.xxhash64(F.lit(nth), F.col(c))
    less = F.struct(rank("src"), "src") < F.struct(rank("dst"), "dst")
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"), less.alias("least"))
    ends = ends.union(edges.select("dst", F.lit(0), F.lit(1), ~less))
    n = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"), F.bool_and("least").alias("least"))
    ways = F.col("out").cast("double") * F.col("into")
    kind = F.when(F.col("into") == 0, SOURCE).when(F.col("out") == 0, SINK).when(F.col("least") & (ways <= fill * (F.col("out") + F.col("into"))), CHOSEN).otherwise(REST)
    kinds = n.select("node", kind.alias("is"))
    flagged = edges.join(kinds.toDF("src", "src_is"), "src").join(kinds.toDF("dst", "dst_is"), "dst")
    return Round(written(flagged.select("src", "dst", "src_is", "dst_is"), "flagged"))


class Elimination:
    """Rounds of a graph without loops and repeated edges, one at a time, until no edges are left or nothing cheap is."""

    def __init__(self, edges: DataFrame):
        self.edges, self.n, self.nth, self.fill = edges, None, 0, 0

    def next(self) -> Round | None:
        """The next round; None if no edges are left (n is 0) or it has stalled. What it leaves becomes the graph."""
        while self.fill < len(FILLS):
            found = _round(self.edges, self.nth, FILLS[self.fill])
            n, before, self.nth = found.flagged.count(), self.n, self.nth + 1
            self.n = n
            if n == 0:
                return None
            if before is not None and n > STALLED * before:
                self.fill += 1
            self.edges = found.left()
            return found
        self.edges = written(self.edges, "edges")
        self.n = self.edges.count()
        return None


def _coloured(edges: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """Some strong components of a graph (node, label), and the edges that may lie in others; None if that takes more
    than `most` rounds one way. A node's colour is the least node that reaches it; the nodes of a colour that reach the
    node it is named after are a component."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    colour, nth, moving = nodes.select("node", F.col("node").alias("colour")), 0, True
    while moving:
        if nth == most:
            return None
        reached = edges.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("least"))
        moved = written(colour.join(reached, "node", "left").select("node", F.least("colour", "least").alias("colour"), (F.col("least") < F.col("colour")).alias("moved")), "colours")
        colour, nth, moving = moved.select("node", "colour"), nth + 1, not moved.where("moved").isEmpty()
    a, b = (colour.select(F.col("node").alias(x), F.col("colour").alias(f"{x}_colour")) for x in ("src", "dst"))
    inside = written(edges.join(a, "src").join(b, "dst").where("src_colour = dst_colour").select("src", "dst"), "edges")
    # back from each colour's own node, along the edges within it
    found = [written(colour.where("node = colour").select("node", F.col("colour").alias("label")), "found")]
    while not found[-1].isEmpty():
        if len(found) == most:
            return None
        step = inside.join(found[-1].toDF("dst", "label"), "dst").select(F.col("src").alias("node"), "label").distinct()
        found.append(written(step.join(reduce(DataFrame.unionAll, found), ["node", "label"], "left_anti"), "found"))
    every = reduce(DataFrame.unionAll, found)
    ends = lambda c: every.select(F.col("node").alias(c))
    return every, written(inside.join(ends("src"), "src", "left_anti").join(ends("dst"), "dst", "left_anti"), "edges")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) for nodes on cycles of two nodes or more; component is the least node.

    A chosen node is in a component if some edge into it and some edge out of it have their other ends in that component;
    if both ends are one node, the two are a component. Sources and sinks are in none.
    """
    within, left = _contracted(edges.select("src", "dst").where("src <> dst"))
    left = written(left.where("src <> dst").distinct(), "edges")
    both = left.select(F.col("src").alias("node")).intersect(left.select("dst"))
    long = written(left.join(both.toDF("src"), "src", "left_semi").join(both.toDF("dst"), "dst", "left_semi"), "edges")
    left = _shortened(long)
    labels, most = left.select(F.col("src").alias("node"), F.col("src").alias("label")).where("false"), PLAIN
    rounds: list[Round] = []
    while not left.isEmpty():
        coloured = _coloured(left, most)
        if coloured is None:  # paths are long
            graph, most = Elimination(left), None
            while found := graph.next():
                rounds.append(found)
            left = graph.edges
        else:
            labels, left = written(labels.unionByName(coloured[0]), "labels"), coloured[1]
    for found in reversed(rounds):
        into = found.into_chosen.select(F.col("src").alias("node"), F.col("dst").alias("chosen"))
        out = found.out_of_chosen.select(F.col("dst").alias("node"), F.col("src").alias("chosen"))
        into, out = (x.join(labels, "node", "left").select("chosen", F.coalesce("label", "node").alias("label")).distinct() for x in (into, out))
        joined = into.join(out, ["chosen", "label"])
        ends = joined.select(F.explode(F.array("chosen", "label")).alias("node"), "label")
        labels = written(labels.unionByName(ends).distinct(), "labels")
    labels = written(_labelled(long, labels), "labels")
    # what a piece has as one node is in that node's component; nodes of no piece's components are as they are
    outer = labels.toDF("name", "outer")
    inside = within.join(outer, F.col("label") == F.col("name"), "left").select("node", F.coalesce("outer", "label").alias("label"))
    labels = written(inside.unionByName(labels.join(within.select(F.col("label").alias("node")).distinct(), "node", "left_anti")), "labels")
    named = labels.groupBy("label").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
    return labels.join(named, "label").select("node", "component")


def _united(masks: DataFrame) -> DataFrame:
    return masks.groupBy("node").agg(*[F.bit_or(c).alias(c) for c in masks.columns if c != "node"])


def _carried(edges: DataFrame, masks: DataFrame) -> DataFrame:
    """The masks of the edges' dst, at src."""
    return edges.select(F.col("src").alias("to"), F.col("dst").alias("node")).join(masks, "node").drop("node").withColumnRenamed("to", "node")


def _spread(masks: DataFrame, edges: DataFrame, columns: list[str], most: int | None = None) -> tuple[DataFrame, bool]:
    """masks after rounds along one edge each, until nothing changes or there were `most`; whether nothing changes."""
    nth = 0
    while nth != most:
        was = masks.select("node", *[F.col(c).alias(f"was_{c}") for c in columns])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"was_{c}")) for c in columns])
        more = _united(masks.unionByName(_carried(edges, masks))).join(was, "node", "left")
        grown = written(more.select("node", *columns, (~same).alias("grown")), "masks")
        masks, nth = grown.select("node", *columns), nth + 1
        if grown.where("grown").isEmpty():
            return masks, True
    return masks, False


def propagate_masks(masks: DataFrame, edges: DataFrame) -> DataFrame:
    """masks (node, and longs whose bits are the members of a set) united, at each node, with those of all nodes that it
    reaches along edges (src, dst). Nodes without bits have no row."""
    columns = [c for c in masks.columns if c != "node"]
    final, masks, edges = _settled(_united(masks), edges.select("src", "dst").where("src <> dst"), columns)
    edges = written(edges, "edges")
    needed = final.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
    short, masks = _shortened(edges), written(_united(masks.unionByName(needed)), "masks")
    rest = written(short.select(F.col("src").alias("node")).union(short.select("dst")).distinct(), "rest")
    inner = edges.where("piece is not null").select(F.col("src").alias("node")).distinct().join(rest, "node", "left_anti")
    known = _spread_masks(written(masks.join(inner, "node", "left_anti"), "masks"), short, columns)
    masks = known.unionByName(_united_in_pieces(masks, edges, known, rest, columns))
    return final.unionByName(masks.join(needed.select("node"), "node", "left_anti"))


def _spread_masks(masks: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """The same for masks of one row a node and distinct edges."""
    masks, settled = _spread(masks, edges, columns, PLAIN)
    if settled:
        return masks
    graph, rounds = Elimination(edges), []
    while found := graph.next():
        placed = masks.join(found.kinds, "node", "left")
        here = placed.where("is is not null").drop("is")
        own = written(_united(here.unionByName(_carried(found.to_sinks, here))).join(found.kinds, "node"), "masks")
        rounds.append((found, own, placed.where("is is null").drop("is")))
        masks = written(_united(own.where(F.col("is") == REST).drop("is").unionByName(_carried(found.into_chosen, own.drop("is")))), "masks")
    if graph.n:
        masks, _ = _spread(masks, graph.edges, columns)
    for found, own, apart in reversed(rounds):
        # the chosen from what they lead to, then sinks, which have their own, then sources
        of = lambda kind, own=own: own.where(F.col("is") == kind).drop("is")
        known = masks.unionByName(_united(of(CHOSEN).unionByName(_carried(found.out_of_chosen, masks)))).unionByName(of(SINK))
        sources = _united(of(SOURCE).unionByName(_carried(found.from_sources, known)))
        masks = written(known.unionByName(sources).unionByName(apart), "masks")
    return masks
