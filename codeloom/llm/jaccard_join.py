"""Similarity join on word shingles with signature trees.

A document's set is its distinct word shingles. Two documents link if the Jaccard similarity of their sets reaches
`percent`. No link is lost, and no group of copies is expanded into its pairs:

1. Documents of equal sets become one class, represented by the least doc_id.
2. Every class has a prefix of its set: so many of the rarest-placed shingles that two classes that link share one of
   them. The order is by hash, but the `MAX_HOT` most frequent shingles come last, so passages that very many
   documents share are hardly ever in a prefix. Any order is exact; this one keeps the lists short.
3. Classes that share a prefix shingle with another are first joined within groups of equal minhash, with their whole
   texts at hand. That links nearly everything that links.
4. What may still be missing lies between classes that share a prefix shingle but no component. First a few pairs of
   each longer list are tried, up to STARS for each component in it: this connects what is left of large groups at a
   cost that grows with the lists, not their squares. Then each list that still has several components is joined on
   bitmaps alone, and the pairs that survive are compared exactly.

Both joins run on signature trees, one for each group or list: nodes hold the OR of the token bitmaps below them, the
range of set sizes and of bits set, and the common component if there is one. Pairs of nodes are traversed from the
roots and dropped if the sizes don't fit, if the most that sets below can have in common is too little, or if all below
is connected already. The trees of many lists are traversed side by side. Large groups are cut into blocks (GROUP_ROWS,
GROUP_TOKENS) that share some classes; of a list of more than BLOCK classes, blocks of its largest component are joined
with blocks of the others, and these with one another, but no block of the largest component with another of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, found_in, gram_hashes, hot_join, mixed, raw, written
from .components import components

MAX_HOT = 20_000
#: The most classes in a block of a list; classes and shingles in a block of a group, whose texts are at hand, about.
BLOCK = 4096
GROUP_ROWS, GROUP_TOKENS = 1024, 4_000_000
#: Classes of a cut group that go to every block of it, about, to hold the blocks together.
PIVOTS = 48
STARS = 8
#: Lists up to this length have no pairs tried beforehand; buckets of lists have about so many rows.
SMALL, BUCKET_ROWS = 16, 30_000
LEAST_BITS, MOST_BITS = 64, 1 << 16
#: Children of a node; pairs of nodes, and bytes of bitmaps, that are tested at a time.
FANOUT, CHUNK, CHUNK_BYTES = 8, 60_000, 32 << 20


def shingles(text: bytes | None, k: int, hasher: WordHasher) -> np.ndarray:
    """The sorted hashes of a whole text's distinct shingles: k consecutive words, or all words if they are fewer."""
    words = (text or b"").lower().split()
    return np.unique(gram_hashes(hasher.of(words), min(k, len(words)))) if words else np.empty(0, np.uint64)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Bits of the tokens' lowest hash bits, about twice as many as tokens, as 64-bit words."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(2 * len(tokens) - 1).bit_length()))
    flags = np.zeros(bits, np.uint8)
    flags[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def folded(maps: np.ndarray) -> np.ndarray:
    """Bitmaps (rows) at half the width."""
    half = maps.shape[1] // 2
    return maps[:, :half] | maps[:, half:]


class Trees:
    """Signature trees, one for each group of sets, over sets in the given order (a group's sets side by side).
    levels[0] are the sets themselves; the last level has one root for each group, that of groups[i] at i."""

    def __init__(self, index: np.ndarray, group: np.ndarray, sizes: np.ndarray, maps: np.ndarray):
        bits = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.index, self.group_of, self.levels, self.first = index, group, [(maps, sizes, sizes, bits)], [np.arange(len(index))]
        while True:
            start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            if len(start) == len(group):
                break
            maps, low, high, bits = self.levels[-1]
            within = np.arange(len(group)) - np.repeat(start, np.diff(np.r_[start, len(group)]))
            at = np.flatnonzero(within % FANOUT == 0)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(bits, at)))
            self.first.append(at)
            group = group[at]
        self.groups = group

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the nodes (by place) each child is below, and the children."""
        first = self.first[level]
        count = np.diff(np.r_[first, len(self.levels[level - 1][0])])[nodes]
        of = np.repeat(np.arange(len(nodes)), count)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[nodes], count)


def _uniform(trees: Trees, component: np.ndarray) -> list[np.ndarray]:
    """By level and node, the component of all sets below, or -1."""
    out = [component[trees.index]]
    for at in trees.first[1:]:
        low, high = np.minimum.reduceat(out[-1], at), np.maximum.reduceat(out[-1], at)
        out.append(np.where(low == high, low, -1))
    return out


def traverse(one: Trees, two: Trees, percent: int, component: np.ndarray):
    """Pairs (places of sets) of one group that may link and aren't of one component, in chunks. one is two: each pair
    once."""
    own = one is two
    known = _uniform(one, component), _uniform(two, component)
    _, a, b = np.intersect1d(one.groups, two.groups, assume_unique=True, return_indices=True)
    stack = [(len(one.levels) - 1, len(two.levels) - 1, a, b)]
    while stack:
        la, lb, a, b = stack.pop()
        chunk = max(1, min(CHUNK, CHUNK_BYTES // one.levels[0][0][:1].nbytes))
        if len(a) > chunk:
            cut = np.arange(chunk, len(a), chunk)
            stack += [(la, lb, x, y) for x, y in zip(np.split(a, cut), np.split(b, cut))]
            continue
        ma, low_a, high_a, bits_a = one.levels[la]
        mb, low_b, high_b, bits_b = two.levels[lb]
        ca, cb = known[0][la][a], known[1][lb][b]
        fit = (100 * high_a[a] >= percent * low_b[b]) & (100 * high_b[b] >= percent * low_a[a]) & ((ca < 0) | (ca != cb))
        a, b = a[fit], b[fit]
        if not len(a):
            continue
        both = np.bitwise_count(ma[a] & mb[b]).sum(axis=1, dtype=np.int64)
        # A set has at least as many tokens outside the other as it has bits outside the other's bitmap.
        most = np.minimum(high_a[a] - np.maximum(bits_a[a] - both, 0), high_b[b] - np.maximum(bits_b[b] - both, 0))
        fit = (100 + percent) * most >= percent * (low_a[a] + low_b[b])
        a, b = a[fit], b[fit]
        if la == lb == 0:
            if own:
                a, b = a[a < b], b[a < b]
            if len(a):
                yield one.index[a], two.index[b]
            continue
        if la >= lb:
            of, a = one.children(la, a)
            b = b[of]
            la -= 1
        if lb > la or own:
            of, b = two.children(lb, b)
            a = a[of]
            lb -= 1
        if own:
            a, b = a[a <= b], b[a <= b]
        stack.append((la, lb, a, b))


def candidates(sizes: np.ndarray, maps: list[np.ndarray], near: np.ndarray, percent: int, component: np.ndarray, group: np.ndarray | None = None):
    """Pairs of sets (of one group) that may link, from trees by bitmap width; sets that link have widths at most one
    step apart. near: similar sets have close numbers, by which trees are ordered within sizes."""
    widths = np.array([len(m) for m in maps])
    group = np.zeros(len(maps), np.int64) if group is None else group
    trees = {}
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        at = at[np.lexsort((sizes[at], near[at], group[at]))]
        trees[w] = Trees(at, group[at], sizes[at], np.stack([maps[i] for i in at]))
    for w, narrow in trees.items():
        yield from traverse(narrow, narrow, percent, component)
        if 2 * w in trees:
            wide = trees[2 * w]
            at = np.flatnonzero(np.isin(wide.group_of, narrow.groups))
            if len(at):
                maps_w, sizes_w, *_ = wide.levels[0]
                yield from traverse(narrow, Trees(wide.index[at], wide.group_of[at], sizes_w[at], folded(maps_w[at])), percent, component)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = int(found_in(a, b)[0].sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = i = parent[parent[i]]
    return i


def _join_exact(sets: list[np.ndarray], near: np.ndarray, percent: int) -> list[int]:
    """The root of each set's component, with the sets at hand."""
    n = len(sets)
    parent = list(range(n))
    for one, two in candidates(np.array([len(x) for x in sets]), [bitmap(x) for x in sets], near, percent, np.arange(n)):
        if len(one) > n:  # pairs that earlier chunks have connected
            root = np.array([_find(parent, i) for i in range(n)])
            apart = root[one] != root[two]
            one, two = one[apart], two[apart]
        for i, j in zip(one.tolist(), two.tolist()):
            a, b = _find(parent, i), _find(parent, j)
            if a != b and linked(sets[i], sets[j], percent):
                parent[max(a, b)] = min(a, b)
    return [_find(parent, i) for i in range(n)]


def _hot(k: int):
    """Shingles that stand out in a task's stretches of documents, with how many documents of the stretch have them."""

    def run(batches):
        hasher, kept, n = WordHasher(), [], 0

        def counted():
            tokens, counts = np.unique(np.concatenate(kept), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(tokens[counts >= 4].view(np.int64)), pa.array(counts[counts >= 4])], ["token", "n"])

        for batch in batches:
            for text in raw(batch["text"]):
                kept.append(shingles(text, k, hasher))
                n += len(kept[-1])
                if n > 1_500_000:
                    yield counted()
                    kept, n = [], 0
        if kept:
            yield counted()

    return run


FEATURES = "doc_id long, n_shingles long, d1 long, d2 long, near long, prefix array<long>, bits binary"


def _features(k: int, percent: int, hot: np.ndarray):
    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, text in zip(batch["doc_id"].to_pylist(), raw(batch["text"])):
                tokens = shingles(text, k, hasher)
                n = len(tokens)
                digest = xxhash.xxh3_128_intdigest(tokens.tobytes())
                length = n - -(-percent * n // 100) + 1 if n else 0
                last = found_in(tokens, hot)[0]
                prefix = tokens[np.argsort(last, kind="stable")[:length]]
                row = (doc, n, digest >> 64, digest & (1 << 64) - 1, int(mixed(tokens).min()) if n else 0, prefix.view(np.int64), bitmap(tokens).tobytes() if n else b"")
                for column, x in zip(out, row):
                    column.append(x)
            d1, d2, near = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in out[2:5])
            ends = np.cumsum([0, *map(len, out[5])])
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *out[5]])))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), d1, d2, near, prefix, pa.array(out[6], pa.binary())], [x.split()[0] for x in FEATURES.split(", ")])

    return run


def _near_groups(k: int, percent: int):
    def run(group: pa.Table) -> pa.Table:
        hasher = WordHasher()
        pivot, docs = np.array(group["pivot"].to_pylist()), group["doc"].to_pylist()
        order = sorted(range(len(docs)), key=lambda i: (not pivot[i], docs[i]))  # roots are pivots where there are any
        texts = group["text"].cast(pa.binary())
        sets = [shingles(texts[i].as_py(), k, hasher) for i in order]
        # A second minhash puts like next to like.
        near = np.array([int(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).min() >> np.uint64(1)) for s in sets])
        root = _join_exact(sets, near, percent)
        return pa.table({"doc": pa.array([docs[i] for i in order], pa.int64()), "root": pa.array([docs[order[r]] for r in root], pa.int64())})

    return run


def surviving(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, maps: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the pairs (places of sets) may link by size and bitmap; the others certainly don't."""
    may = 100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])
    widths = np.array([len(m) for m in maps])
    swap = widths[a] > widths[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    may &= widths[b] <= 2 * widths[a]
    used = np.unique(np.r_[a[may], b[may]])
    place = np.zeros(len(maps), np.int64)
    stacked = {}
    for w in np.unique(widths[used]) if len(used) else ():
        at = used[widths[used] == w]
        place[at] = np.arange(len(at))
        stacked[w] = np.stack([maps[i] for i in at])
    for w, narrow in stacked.items():
        for v in (w, 2 * w):
            if v not in stacked:
                continue
            at = np.flatnonzero(may & (widths[a] == w) & (widths[b] == v))
            other = stacked[v] if v == w else folded(stacked[v])
            bits_a, bits_b = (np.bitwise_count(m).sum(axis=1, dtype=np.int64) for m in (narrow, other))
            for part in np.array_split(at, len(at) // CHUNK + 1):
                x, y = place[a[part]], place[b[part]]
                both = np.bitwise_count(narrow[x] & other[y]).sum(axis=1, dtype=np.int64)
                m, n = sizes[a[part]], sizes[b[part]]
                most = np.minimum(np.minimum(m - bits_a[x], n - bits_b[y]) + both, np.minimum(m, n))
                may[part] = (100 + percent) * most >= percent * (m + n)
    return may


def _lists_of(group: pa.Table):
    """A bucket's lists: the columns in the order of lists, and the lists' edges in it."""
    token, i, j, docs = (group[c].to_numpy() for c in ("token", "i", "j", "doc"))
    order = np.lexsort((docs, j, i, token))
    token, i, j = token[order], i[order], j[order]
    edges = np.r_[np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]), len(order)]
    columns = {c: group[c].to_numpy()[order] for c in ("doc", "pos", "n", "near", "component", "side")}
    bits = group["bits"].combine_chunks()
    return token, columns, [np.frombuffer(bits[int(x)].as_buffer(), np.uint64) for x in order], edges


def _pair_table(docs: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> pa.Table:
    one, two = docs[np.concatenate([np.empty(0, np.int64), *a])], docs[np.concatenate([np.empty(0, np.int64), *b])]
    pairs = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)]), axis=1)
    return pa.table({"a": pairs[0], "b": pairs[1]})


def _list_pairs(percent: int):
    """The pairs of a bucket's lists that may link and aren't connected, from the lists' trees side by side."""

    def run(group: pa.Table) -> pa.Table:
        _, c, maps, edges = _lists_of(group)
        sizes, component, side = c["n"], np.unique(c["component"], return_inverse=True)[1], c["side"]
        of_list = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        one, two = [], []
        for a, b in candidates(sizes, maps, c["near"], percent, component, of_list):
            # Pairs on two sides, and, as each is found in the list of its first common shingle, only those that have
            # enough of their sets from here on.
            left = np.minimum(sizes[a] - c["pos"][a], sizes[b] - c["pos"][b])
            fit = ((side[a] != side[b]) | (side[a] == 2)) & ((100 + percent) * left >= percent * (sizes[a] + sizes[b]))
            one.append(a[fit])
            two.append(b[fit])
        return _pair_table(c["doc"], one, two)

    return run


def _list_stars(percent: int):
    """Of each long list of a bucket, for each component a member that the list picks at random, with members of the
    list's largest component and with the next component's."""

    def run(group: pa.Table) -> pa.Table:
        token, c, maps, edges = _lists_of(group)
        one, two = [], []
        for k in np.flatnonzero(np.diff(edges) > SMALL):
            at = np.arange(edges[k], edges[k + 1])
            at = at[np.argsort(mixed(c["doc"][at].view(np.uint64) ^ np.uint64(int(token[edges[k]]) & (1 << 64) - 1)), kind="stable")]
            _, first, component, counts = np.unique(c["component"][at], return_index=True, return_inverse=True, return_counts=True)
            top = np.argmax(counts)
            largest, picked = at[component == top], at[np.sort(np.delete(first, top))]
            if len(picked):
                turn = (np.arange(len(picked))[:, None] * STARS + np.arange(STARS)) % len(largest)
                one += [np.repeat(picked, STARS), picked[1:]]
                two += [largest[turn].ravel(), picked[:-1]]
        a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (one, two))
        fit = surviving(a, b, c["n"], maps, percent)
        return _pair_table(c["doc"], [a[fit]], [b[fit]])

    return run


def _compare(k: int, percent: int):
    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            fits = [linked(shingles(x, k, hasher), shingles(y, k, hasher), percent) for x, y in zip(raw(batch["text_a"]), raw(batch["text_b"]))]
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    return run


def _dealt(near: DataFrame) -> DataFrame:
    """near (doc, near, n_shingles) with the block (salt) of each class in its group of equal minhash, and `pivot`:
    whether it goes to all blocks. Classes alone in their group are left out."""
    n, tokens = F.count("*").alias("n"), F.sum("n_shingles").alias("tokens")
    groups = near.groupBy("near").agg(n, tokens).where("n > 1")
    groups = written(groups.select("near", "n", F.greatest(F.ceil(F.col("n") / GROUP_ROWS), F.ceil(F.col("tokens") / GROUP_TOKENS)).cast("int").alias("blocks")), "groups")
    turn = F.pmod(F.xxhash64(F.lit(8), "doc"), F.lit(1 << 30))
    pivot = (F.col("blocks") > 1) & (turn * F.col("n") < PIVOTS * (1 << 30))
    own = F.array((turn % F.col("blocks")).cast("int"))
    dealt = hot_join(near, groups, ["near"]).withColumn("pivot", pivot)
    return dealt.select("doc", "near", "pivot", F.explode(F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)).alias("salt"))


def links(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, classes, links): sets (doc_id, n_shingles, d1, d2) of every row, with the hash of its set; classes (d1, d2,
    representative, n) of the distinct sets that aren't empty; links (a, b) joins representatives so that their
    components are those of all links between different sets."""
    found = docs.mapInArrow(_hot(k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(MAX_HOT).collect()
    hot = np.sort(np.array([x["token"] for x in found], np.int64).view(np.uint64))
    features = written(docs.mapInArrow(_features(k, percent, hot), FEATURES), "features")
    classes = written(features.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("representative"), F.count("*").alias("n")), "classes")

    of_class = features.join(classes.select(F.col("representative").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "doc")
    bits = written(of_class.select("doc", F.col("n_shingles").alias("n"), "bits", "near", "prefix"), "of-class")
    tokens = bits.select("doc", F.posexplode("prefix").alias("pos", "token"))
    counts = written(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "tokens")
    shared = written(hot_join(tokens, counts, ["token"]).select("token", "doc", "pos"), "shared")

    dealt = _dealt(bits.select("doc", "near", F.col("n").alias("n_shingles"))).withColumnRenamed("doc", "doc_id")
    roots = docs.join(dealt, "doc_id").select(F.col("doc_id").alias("doc"), "text", "near", "salt", "pivot").groupBy("near", "salt").applyInArrow(_near_groups(k, percent), "doc long, root long")
    roots = written(roots.where("doc <> root").distinct(), "roots")

    bits = bits.drop("prefix")
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shared.count() // BUCKET_ROWS))

    def compared(lists: DataFrame, pairs) -> DataFrame:
        bucket = F.pmod(F.xxhash64("token", "i", "j"), F.lit(buckets))
        maybe = written(lists.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(pairs(percent), "a long, b long").distinct(), "pairs")
        ends = maybe.select(F.col("a").alias("doc_id")).unionByName(maybe.select(F.col("b").alias("doc_id"))).distinct()
        texts = written(docs.join(ends, "doc_id", "left_semi"), "texts")
        one, two = (texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        return maybe.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(_compare(k, percent), "a long, b long")

    known = roots.select(F.col("doc").alias("a"), F.col("root").alias("b"))
    part = roots.groupBy("doc").agg(F.min("root").alias("component"))
    known = known.unionByName(written(compared(_open_lists(shared, part, bits, SMALL + 1), _list_stars), "stars"))
    part = components(known).select(F.col("node").alias("doc"), "component")
    return features.select("doc_id", "n_shingles", "d1", "d2"), classes, known.unionByName(compared(_open_lists(shared, part, bits, 2), _list_pairs))


def _open_lists(shared: DataFrame, part: DataFrame, bits: DataFrame, least: int) -> DataFrame:
    """The lists (token, doc) of at least so many classes that still have several components, dealt to pairs of blocks
    (i, j). side 2: both blocks are one; in a pair of different blocks only pairs of sets that cross it (0 and 1) count."""
    placed = written(shared.join(part, "doc", "left").withColumn("component", F.coalesce("component", "doc")), "placed")
    # Of lists of the same classes one is enough: that of the shingle that comes first in their prefixes.
    same = F.bit_xor(F.xxhash64("doc")).alias("x"), F.sum(F.xxhash64(F.lit(3), "doc").cast("decimal(38,0)")).alias("y"), F.sum("pos").alias("places")
    lists = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("of"), *same)
    lists = lists.where((F.col("low") < F.col("high")) & (F.col("of") >= least)).groupBy("x", "y", "of").agg(F.min_by("token", "places").alias("token")).select("token", "of")
    lists = written(lists, "lists")
    rows = hot_join(placed, lists, ["token"], "of")
    whole = rows.where(F.col("of") <= BLOCK).select("token", "doc", "pos", "component", F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"))).alias("pairs"))
    if not lists.where(F.col("of") > BLOCK).isEmpty():
        whole = whole.unionByName(_in_blocks(written(rows.where(F.col("of") > BLOCK), "long-lists")))
    every = whole.join(bits, "doc").select("token", "doc", "pos", "n", "bits", "near", "component", F.explode("pairs").alias("p"))
    return every.select("token", "doc", "pos", "n", "bits", "near", "component", "p.i", "p.j", "p.side")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """rows (token, doc, pos, component, of) of long lists with the pairs of blocks that each goes to. The classes of a
    list's largest component are in blocks of their own, which are never joined with one another."""
    sizes = rows.groupBy("token", "component").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "component")).alias("top"), F.sum("k").alias("n"))
    blocks = lambda k: F.ceil(k / BLOCK).cast("int")
    sizes = written(sizes.select("token", "n", F.col("top.component").alias("largest"), blocks(F.col("n") - F.col("top.k")).alias("others"), blocks(F.col("top.k")).alias("larges")), "sizes")
    placed = hot_join(rows, sizes, ["token"]).withColumn("large", F.col("component") == F.col("largest"))
    own = F.pmod(F.xxhash64("doc"), F.when(F.col("large"), F.col("larges")).otherwise(F.col("others"))).cast("int")
    placed = placed.withColumn("own", F.when(F.col("large"), F.col("others") + own).otherwise(own))
    pair = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    other = F.col("own")
    with_large = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: pair(o, other, F.lit(1)))
    among = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: pair(F.least(o, other), F.greatest(o, other), F.when(o == other, 2).when(other < o, 0).otherwise(1)))
    across = F.transform(F.sequence(F.col("others"), F.col("others") + F.col("larges") - 1), lambda o: pair(other, o, F.lit(0)))
    return placed.select("token", "doc", "pos", "component", F.when(F.col("large"), with_large).otherwise(F.concat(among, across)).alias("pairs"))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs (doc_id, text; other columns are ignored): doc_id, n_shingles, representative (the least doc_id
    with the same set) and component_id (the least doc_id reached by links, its own included).

    Words are runs of characters other than ASCII white space, A-Z in lower case; a document of fewer than k words has
    one shingle, all of them. Documents without words (null, empty) are linked with nothing and their own component.
    Rows that share a doc_id are documents of their own, each judged by its own text. A row whose doc_id is null is
    compared with nothing and has neither representative nor component.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return _components_of(docs, k, percent)
    without = docs.where("doc_id is null").mapInArrow(_features(k, percent, np.empty(0, np.uint64)), FEATURES)
    without = without.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("representative"), F.lit(None).cast("long").alias("component_id"))
    rows = written(docs.where("doc_id is not null").withColumn("row", F.monotonically_increasing_id()), "rows")
    found = _components_of(rows.select(F.col("row").alias("doc_id"), "text"), k, percent).withColumnRenamed("doc_id", "row")
    found = written(found.join(rows.select("row", "doc_id"), "row"), "rows")
    for name in ("representative", "component_id"):  # from rows to the least doc_id
        least = written(found.groupBy(name).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "least")
        found = hot_join(found, least, [name]).withColumn(name, F.col("least")).drop("least", "n")
    return found.select("doc_id", "n_shingles", "representative", "component_id").unionByName(without)


def _components_of(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """jaccard_components() of documents whose ids are there and unique."""
    sets, classes, found = links(docs, k, percent)
    of = components(found).withColumnRenamed("node", "representative")
    classes = classes.join(of, "representative", "left").select("d1", "d2", "n", "representative", F.coalesce("component", "representative").alias("component_id"))
    known = hot_join(sets.where("n_shingles > 0"), written(classes, "components"), ["d1", "d2"])
    names = ["doc_id", "n_shingles", "representative", "component_id"]
    empty = sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("representative"), F.col("doc_id").alias("component_id"))
    return known.select(names).unionByName(empty)
