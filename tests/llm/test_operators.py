"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and columns
of clashing names."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from codeloom.llm import bm25_search, common, decontamination, extendible_hashing, fair_mix, importance, jaccard_join, line_dedup, queries, substring_dedup, toxicity, warc
from codeloom.llm.components import components

random.seed(5)
WORDS = [f"{a}{b}" for a in ("al", "bo", "ci", "dé", "eu") for b in ("ra", "no", "Tim", "x", "zu.")]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    passage, base = prose(70), prose(300)
    texts = [prose(120), prose(40) + " " + passage + " " + prose(30), prose(5) + "\t" + passage, passage, None, "", "  \n ", "one two", "one two", base]
    texts += [base, " ".join(["new", *base.split()[1:]]), " ".join(base.split()[:280]), " ".join(base.split()[:150]) + " " + prose(150), prose(9000)]
    texts += ["\n".join(["a line", "b line", "", "c line ", "d line"]), "x\na line\nb line\nc line\nend", "a line\nb line\nc line\na line\nb line\nc line"]
    out = [(i, t, "src" + str(i % 3) if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    return out + [out[1], out[10]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    schema = "doc_id long, text string, source string, n_chars long"
    found = spark.createDataFrame(rows, schema)
    return found.withColumns({c: F.lit("clash") for c in ("of", "shard", "doc", "n", "words", "token", "hash", "size", "kept", "n_bytes", "page", "fp")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, n_chars long, lang string")


def test_hot_join(spark):
    """Keys of most rows, of few, of none; the same rows as a plain join."""
    keys = [7] * 900 + [None] * 5 + [random.randrange(50, 400) for _ in range(700)]
    big = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    count = collections.Counter(k for k in keys if k is not None)
    small = spark.createDataFrame([(k, str(k), n) for k, n in count.items() if k % 3] + [(1, "1", 0)], "k long, name string, n long")
    for share, most in ((1, 1 << 40), (10, 1 << 40), (1000, 1 << 40), (1, 3)):
        before = common.HOT_SHARE, common.HOT_ROWS
        common.HOT_SHARE, common.HOT_ROWS = share, most
        got = sorted((r.k, r.i, r.name) for r in common.hot_join(big, small, ["k"]).collect())
        common.HOT_SHARE, common.HOT_ROWS = before
        assert got == sorted((k, i, str(k)) for i, k in enumerate(keys) if k is not None and k % 3)
    assert common.hot_join(big, small.limit(0), ["k"]).count() == 0


def test_running(spark):
    """Sums by group over ranges, null groups too, and rows that are alike in all but their number."""
    rows = [(random.choice(("a", "b", None)), 5 if i % 2 else random.randrange(9), i) for i in range(500)]
    table = spark.createDataFrame([(g, x, i) for g, x, i in rows], "g string, x long, i long").repartition(6)
    got = {r.i: r.through for r in common.running(table, ["g", "x", "i"], "x", "through", ("g",)).collect()}
    sums = collections.Counter()
    for g, x, i in sorted(rows, key=lambda r: r[1:]):
        sums[g] += x
        assert got[i] == sums[g]
    assert len(got) == 500 and common.running(table.limit(0), ["g", "x", "i"], "x", "through", ("g",)).count() == 0


def test_substring_dedup_of_rows_that_share_an_id(spark):
    """Rows of one id never remove each other; each is judged by its own text, whatever shard it is in."""
    one, two, own = prose(120), prose(120), prose(60)
    rows = [(5, own + " " + one), (5, two), (5, two), (9, two + " " + own), (9, prose(10) + " " + one), (3, prose(49)), (4, own)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for shard_bytes in (100, 1 << 20):
        got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(table, shard_bytes=shard_bytes).collect())
        assert got == [(3, 49, 0), (4, 60, 0), (5, 120, 0), (5, 120, 0), (5, 180, 60), (9, 130, 120), (9, 180, 180)]


def test_substring_dedup_of_many_copies(spark):
    """A passage that hundreds of documents share, over many shards, is kept in the first."""
    passage = prose(70)
    table = spark.createDataFrame([(i, f"start{i} {passage} end{i}") for i in range(400)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(table, shard_bytes=2000).collect()}
    assert got[0] == (0, f"start0 {passage} end0") and all(got[i] == (70, f"start{i} end{i}") for i in range(1, 400))


def test_substring_dedup(docs, rows, none):
    first = {}
    split = {d: (t or "").encode().split() for d, t, *_ in rows}
    for d in sorted(split):
        for i in range(len(split[d]) - 49):
            first.setdefault(tuple(split[d][i : i + 50]), d)
    expected = {}
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        expected[d] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    got = substring_dedup.substring_dedup(docs, shard_bytes=3000).collect()
    assert len(got) == len(rows) and {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == expected
    assert sum(x[1] for x in expected.values()) > 500 and substring_dedup.substring_dedup(none).count() == 0
    assert all(sum(b - a for a, b in r.spans) == r.n_removed for r in got)


def test_substring_dedup_keeps_null_ids(spark):
    text = prose(80)
    got = substring_dedup.substring_dedup(spark.createDataFrame([(None, text), (3, text), (4, text)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {None: 0, 3: 0, 4: 80}


def test_decontamination(spark, docs, rows, none):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    items = [(1, " ".join(rows[1][1].split()[45:70])), (10, "one TWO"), (2, None), (3, "…"), (4, prose(30)), (5, rows[14][1][500:900]), (1, "alra")]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(0, len(w) - min(10, len(w)) + 1) if w else 0):
            windows[tuple(w[k : k + min(10, len(w))])].add(str(i))
    expected = {}
    for d, t, *_ in rows:
        w, of = split(t), set()
        hit = [False] * len(w)
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    of |= found
                    hit[k : k + n] = [True] * n
        expected[d] = (len(w), sum(hit), sorted(of))
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for block in (200_000, 3):
        got = decontamination.decontaminate(docs, table, block_terms=block).collect()
        assert len(got) == len(rows) and {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == expected
    assert sum(bool(x[1]) for x in expected.values()) > 4
    assert decontamination.decontaminate(none, table).count() == 0
    assert decontamination.decontaminate(docs, table.limit(0)).where("contaminated").count() == 0


def test_decontamination_with_one_rare_term_of_many_items(spark, monkeypatch):
    """A template whose one rare term all items share, in lists of three places; null ids on both sides."""
    monkeypatch.setattr(decontamination, "LIST", 3)
    items = [(i, f"the task {i} needs zyx and so on for a while now") for i in range(40)] + [(None, "a null item with words"), (None, None)]
    rows = [(i, f"x y the task {i} needs zyx and so on for a while now z") for i in range(0, 40, 7)] + [(None, "say a null item with words here"), (None, "clean"), (50, "the task needs zyx"), (51, None)]
    got = decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(rows) and {(r.doc_id, tuple(r["items"]), r.n_hit) for r in got} == {*((i, (str(i),), 12) for i in range(0, 40, 7)), (None, ("",), 5), (None, (), 0), (50, (), 0), (51, (), 0)}


def test_proximity(spark, docs):
    docs = spark.createDataFrame([(1, "red and a blue"), (2, "Blue, red"), (3, "red one two three four blue"), (4, None)], "doc_id long, text string")
    pairs = spark.createDataFrame([(7, "red", "blue")], "pair_id long, first string, second string")
    assert sorted((r.doc_id, r.position, r.distance) for r in decontamination.proximity_matches(docs, pairs, 3).collect()) == [(1, 0, 3), (2, 1, 1)]


def test_line_dedup(docs, rows, none):
    content = {d: [(i, x.strip(" ")) for i, x in enumerate((t or "").split("\n")) if x.strip(" ")] for d, t, *_ in rows}
    first = {}
    for d in sorted(content):
        for p in range(len(content[d]) - 2):
            first.setdefault(tuple(x for _, x in content[d][p : p + 3]), (d, p))
    expected = {}
    for d, t, *_ in rows:
        c = content[d]
        gone = {c[p + j][0] for p in range(len(c) - 2) if first[tuple(x for _, x in c[p : p + 3])] < (d, p) for j in range(3)}
        expected[d] = (len(gone), "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone))
    got = line_dedup.line_dedup(docs).collect()
    assert len(got) == len(rows) and {r.doc_id: (r.n_removed, r.kept_text) for r in got} == expected
    assert expected[16][0] == 3 and expected[17][0] == 6 and line_dedup.line_dedup(none).count() == 0


def test_line_dedup_of_long_texts_and_missing_ids(spark):
    """20,000 lines, twice; a null doc_id comes first; runs that very many documents share."""
    long, common_run = "\n".join(f"line {i % 15000}" for i in range(20_000)), "one\ntwo\n\nthree\nfour"
    rows = [(1, long), (2, long), (None, common_run), *((i, f"own {i}\n{common_run}\n") for i in range(10, 200)), (300, "one\ntwo"), (301, ""), (302, None)]
    got = collections.defaultdict(list)
    for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].append((r.n_lines, r.n_removed, r.kept_text))
    assert got[1] == [(20_000, 5_000, "\n".join(f"line {i}" for i in range(15_000)))] and got[2] == [(20_000, 20_000, "")]
    assert got[None] == [(5, 0, common_run)] and all(got[i] == [(7, 4, f"own {i}\n\n")] for i in range(10, 200))
    assert got[300] == [(2, 0, "one\ntwo")] and got[301] == [(1, 0, "")] and got[302] == [(0, 0, "")]


def test_warc_of_rows_that_are_alike(spark, tmp_path, monkeypatch):
    """Pages without an id, and one page many times, are spread over archives; one response is left of each payload."""
    big = "<p>" + "x" * 1500
    rows = [(None, None, big)] * 60 + [(5, "u", "<b>" * 700)] * 60 + [(None, "v", None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_arc(table, str(tmp_path / "arc"), archive_bytes=20_000)
    sizes = [len(warc.unpacked(r.content)) for r in warc.files(spark, str(tmp_path / "arc")).collect()]
    assert len(sizes) > 5 and max(sizes) < 80_000
    got = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in warc.archive_pages(table).collect())
    assert got == {(None, "response", None): 2, (None, "revisit", None): 59, (5, "response", None): 1, (5, "revisit", 5): 59}


def test_warc(spark, tmp_path):
    big, other = "<p>" + "é" * 700, "<b>" * 500
    pages = [(1, "http://a/x y\n", big), (2, None, big), (3, "http://b", big), (4, "http://c", "short\r\n\r\nWARC/1.1"), (5, "http://d", "short\r\n\r\nWARC/1.1"), (6, "http://e", None), (7, "http://f", ""), (9, "u", other), (9, "u", other)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("type", F.lit("clash"))
    got = warc.archive_pages(table).collect()
    sha = lambda x: hashlib.sha1((x or "").encode()).hexdigest()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == sorted((p, len((h or "").encode()), sha(h)) for p, _, h in pages)
    kind = sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.page_id != 9)
    assert kind == [(1, "revisit", 3), (2, "revisit", 3), (3, "response", None), *((i, "response", None) for i in (4, 5, 6, 7))]
    assert sorted((r.record_type, r.refers_to) for r in got if r.page_id == 9) == [("response", None), ("revisit", 9)]
    assert len({r.record_id for r in got}) == len(got) and warc.archive_pages(table.limit(0)).count() == 0


def test_arc_versions():
    for version in (b"1", b"2"):
        block = version + b" 0 x\n" + warc.ARC_FIELDS[version] + b"\n"
        data = warc.arc_record(version, b"filedesc://a.arc", b"0.0.0.0", b"20000101000000", b"text/plain", block, 0, b"a") + b"\n"
        data += warc.arc_record(version, b"http://h/with space", b"1.2.3.4", b"19990203040506", b"text/html", b"HTTP/1.0 200 OK\n\nbody\n", 9, b"a") + b"\n"
        (_, head, _), (_, fields, body) = warc.arc_records(data)
        assert head[b"url"] == b"filedesc://a.arc" and fields[b"url"] == b"http://h/with space" and fields[b"archive-date"] == b"19990203040506" and warc.split_http(body) == (b"HTTP/1.0 200 OK\n\n", b"body\n")


def test_arc_lf_headers_and_damage(spark, tmp_path):
    """Headers that end in bare line feeds, a member for each record, a record cut short, lines that are none."""
    import gzip
    import time

    long = [b"<p>%d</p>" % i * 300 for i in range(3)]
    opening = warc.arc_record(b"1", b"filedesc://a.arc", b"0.0.0.0", b"20000101000000", b"text/plain", b"1 0 x\n" + warc.ARC_FIELDS[b"1"] + b"\n", 0, b"a")
    record = lambda end, payload, page: warc.arc_record(b"1", b"http://h/", b"1.2.3.4", b"19990203040506", b"text/html", b"HTTP/1.0 200 OK" + end + b"X-Page-Id: %d" % page + 2 * end + payload, 0, b"a")
    sound = [record(b"\n", long[0], 1), record(b"\r\n", long[0], 2), record(b"\n", long[1], 3), record(b"\r\n", b"a\n\nb", 4)]
    data = b"\n".join([opening, *sound[:2], b"no header here", b"http://h/ 1.2.3.4 never text/html 9", *sound[2:], record(b"\n", long[2], 5)[:-50]])
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc/part-0.gz").write_bytes(b"".join(gzip.compress(x + b"\n") for x in (opening, *sound)))
    (tmp_path / "arc/part-1").write_bytes(data)
    whole, cut = gzip.compress(opening + b"\n" + sound[0] + b"\n"), gzip.compress(record(b"\n", bytes(random.randrange(256) for _ in range(3000)), 6))
    (tmp_path / "arc/part-2.gz").write_bytes(whole + cut[:2500])
    at = sorted((r.file, r.at) for r in warc.damage(spark, str(tmp_path / "arc")).collect())
    assert [f for f, _ in at] == ["part-1", "part-1", "part-2.gz"] and at[0][1] == data.index(b"no header") and at[1][1] == data.rindex(b"http://h/ 1.2.3.4 1999")
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = warc.read_warc(spark, str(tmp_path / "warc")).collect()
    digest = lambda x: hashlib.sha1(x).hexdigest()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == sorted([(p, len(x), digest(x)) for p, x in ((1, long[0]), (2, long[0]), (3, long[1]), (4, b"a\n\nb"))] * 2 + [(1, len(long[0]), digest(long[0]))])
    assert all(r.type == ("response" if r.payload_bytes < 1000 else "revisit") or r.page_id in (2, 3) for r in got)
    took = []
    for n in (2_000, 16_000):
        content, began = gzip.compress(b"x" * 100) * n, time.thread_time()
        assert len(warc.unpacked(content)) == 100 * n
        took.append(time.thread_time() - began)
    assert took[1] < 24 * took[0]  # in proportion, with room: copies of what is left would take 64 times as long


def test_importance(spark, none):
    good = [(i, prose(60)) for i in range(60)]
    bad = [(100 + i, " ".join(random.choice(("$$$", "###", "buy", "&&& now")) for _ in range(60))) for i in range(20)]
    docs = spark.createDataFrame([*good, *bad, (200, None), (201, "")], "doc_id long, text string").withColumn("of", F.lit("clash"))
    target = spark.createDataFrame([(i,) for i in range(0, 40)], "doc_id long")
    got = {r.doc_id: r for r in importance.resample(docs, target, 62 / 82).collect()}
    assert [d for d, r in got.items() if r.kept and 100 <= d < 200] == [] and sum(r.kept for r in got.values()) == 62
    again = {r.doc_id: r.gumbel_key for r in importance.resample(docs, target, 62 / 82).collect()}
    assert again == {d: r.gumbel_key for d, r in got.items()} and got[200].log_weight == 0 == got[201].log_weight
    assert importance.resample(none, target, 0.5).count() == 0 and importance.resample(docs, target.limit(0), 1.0).where("kept").count() == 82


def _signed(h):
    return h - (h >> 63 << 64)


def _spark_hash(seed, *parts):
    """Spark's xxhash64 of a seed (int), then longs, strings (bytes) and nulls."""
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    for x in parts:
        if x is not None:
            h = xxhash.xxh64_intdigest(x if isinstance(x, bytes) else struct.pack("<q", x), h)
    return h


def test_importance_by_brute_force(spark, docs, rows, tmp_path):
    """Counts, weights, noise and choice of the registered query, computed anew, word by word."""
    quality = [(d, d % 3 != 0) for d in range(0, 18, 2)] + [(99, True), (3, None)]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, None if q is None else int(q), 0) for d, q in quality], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    mask = (1 << 64) - 1

    def buckets(text):
        words = [xxhash.xxh64_intdigest(w) for w in re.findall(rb"[0-9a-z_\x80-\xff]+|[^0-9a-z_\x80-\xff\s]+", (text or "").encode().lower())]
        out = [w % importance.BUCKETS for w in words]
        for a, b in zip(words, words[1:]):
            x = (a + b * 0x9E3779B97F4A7C15) & mask
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
            out.append((x ^ (x >> 31)) % importance.BUCKETS)
        return out

    raw, target = collections.Counter(), collections.Counter()
    for d, t, *_ in rows:
        raw.update(buckets(t))
        if (d, True) in quality:
            target.update(buckets(t))
    raw_sum, target_sum = (sum(c.values()) + importance.BUCKETS for c in (raw, target))
    want = []
    for d, t, *_ in rows:
        weight = sum(math.log((target[b] + 1) / target_sum) - math.log((raw[b] + 1) / raw_sum) for b in buckets(t))
        of = _signed(xxhash.xxh64_intdigest((t or "").encode(), 42)) if t is not None else 42
        u = ((_spark_hash(importance.SEED, d, of) >> 11) + 0.5) / 2**53
        want.append((d, len(buckets(t)), weight, weight - math.log(-math.log(u))))
    got = sorted((r.doc_id, r.n_grams, r.log_weight, r.gumbel_key, r.kept) for r in queries.op5_importance(spark, str(tmp_path)).collect())
    want.sort()
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2:4] for x in got], [x[2:] for x in want], atol=1e-9)
    share = sum(q for _, q in quality if q is not None) / sum(q is not None for _, q in quality)
    limit = sorted((x[3] for x in want), reverse=True)[round(len(rows) * share)]
    assert all(x[4] for x in got if x[3] > limit + 1e-9) and not any(x[4] for x in got if x[3] < limit - 1e-9) and sum(x[4] for x in got) == round(len(rows) * share)


def test_top_k_by_sorting(spark):
    """The k largest by all keys, and exactly k, however many rows tie at the limit."""
    keys = [random.gauss(0, 1) * 10 ** random.randint(-9, 9) for _ in range(3000)] + [1.0] * 500
    rows = [(x, random.randrange(5), i) for i, x in enumerate(keys)]
    scored = spark.createDataFrame(rows, "gumbel_key double, tie long, row long")
    at = sorted(keys, reverse=True).index(1.0)
    for k in (0, 1, 17, at + 250, 1500, 3500):
        kept = importance.top_k(scored, k, ("gumbel_key", "tie", "row")).where("kept").collect()
        assert sorted(tuple(r)[:3] for r in kept) == sorted(sorted(rows, reverse=True)[:k])
    keys = spark.createDataFrame([(float(x),) for x in (5, 4, 3, 3, 3, 3, 1)], "gumbel_key double").withColumns({"tie": F.lit(0), "row": F.monotonically_increasing_id()})
    assert sorted(r.gumbel_key for r in importance.top_k(keys, 4, ("gumbel_key", "tie", "row")).where("kept").collect()) == [3, 3, 4, 5]


def test_importance_keeps_its_share_of_equal_rows(spark):
    docs = spark.createDataFrame([(1, "same text here")] * 40 + [(None, None)] * 3, "doc_id long, text string")
    got = importance.resample(docs.repartition(3), docs.select("doc_id"), 0.5).collect()
    assert len(got) == 43 and sum(r.kept for r in got) == 22 and len({r.row for r in got}) == 43


def test_fair_mix(spark, docs, rows, none):
    got = fair_mix.mix(docs).collect()
    size = collections.Counter()
    for _, t, source, _ in rows:
        size[source] += len((t or "").split())
    weights = dict(zip(sorted(size, key=lambda s: (s is None, s)), (5, 2, 1, 5)))
    target, total, capped = {}, sum(size.values()), set()
    while True:
        level = (total - sum(3 * size[s] for s in capped)) / sum(weights[s] for s in size if s not in capped)
        target = {s: 3 * size[s] if s in capped else level * weights[s] for s in size}
        over = {s for s in size if target[s] > 3 * size[s]} - capped
        if not over:
            break
        capped |= over
    assert all(abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source] for r in got)
    longest = max(len((t or "").split()) for _, t, *_ in rows)
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"])
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= longest for s in size) and sum(taken.values()) <= total
    assert sorted(map(str, got)) == sorted(map(str, fair_mix.mix(docs).collect())) and fair_mix.mix(none).count() == 0


def test_toxicity(spark, none):
    plain = [(i, ". ".join(prose(8) for _ in range(6)), 0) for i in range(300)]
    toxic = [(1000 + i, ". ".join([*(prose(8) for _ in range(4)), f"you {random.choice(('scumble', 'scumly', 'scumish'))} here", prose(8)]), 1) for i in range(80)]
    table = spark.createDataFrame([*plain, *toxic, (5000, None, None), (5001, "", 0)], "doc_id long, text string, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(table.drop("toxic"), table.select("doc_id", "toxic")).collect()}
    held = [(got[d], y) for d, _, y in plain + toxic if got[d].held_out]
    assert sum(r.predicted == y for r, y in held) >= 0.95 * len(held) > 50
    assert got[5000].score == 0 == got[5001].score and all((r.score >= 0.3) == bool(r.predicted) for r in got.values())
    texts = {d: t for d, t, _ in toxic}
    marked = [(d, got[d].offending[0]) for d in texts if got[d].offending]
    assert len(marked) >= 70 and all("scum" in texts[d].encode()[o["from"] : o["to"]].decode() for d, o in marked)
    assert toxicity.toxicity(none, table.select("doc_id", "toxic").limit(0)).count() == 0


def test_toxicity_by_brute_force(spark, tmp_path):
    """The model, fitted by a plain loop over sentences, and the scores of the registered query, word by word."""
    texts = {i: ". ".join(prose(random.randint(1, 5)) + (" scumble" if i % 4 == 0 and j == 1 else "") for j in range(3)) for i in range(60)}
    labels = [(i, int(i % 4 == 0)) for i in range(60)] + [(7, 1), (9, None), (500, 1)]  # 7 has two labels
    rows = [*texts.items(), (5, texts[5]), (None, texts[0]), (600, None), (601, "…!")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "label", "sum", "score")}).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, 0, y) for d, y in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    known = collections.defaultdict(list)
    for d, y in labels:
        if y is not None and not held(d):
            known[d].append(y)
    sample = [(t, sum(known[d]) / len(known[d])) for d, t in rows if d in known]
    word = lambda s: re.findall(rb"[0-9a-z_'\x80-\xff]+", s.lower())
    bags = lambda t: [b for s in re.split(rb"[.!?\n]+", (t or "").encode()) if (b := word(s))]
    features = lambda w: [xxhash.xxh64_intdigest(x) % toxicity.BUCKETS for x in (b"=" + w, *(w[:n] for n in (4, 5, 6, 7) if len(w) >= n))]
    docs_of, toxic_of = collections.Counter(), collections.Counter()
    for t, y in sample:
        for f in {f for b in bags(t) for w in b for f in features(w)}:
            docs_of[f] += 1
            toxic_of[f] += y
    chosen = [f for f in docs_of if docs_of[f] >= toxicity.LEAST_DOCS]
    assert len(chosen) < toxicity.MOST_FEATURES
    w, bias = dict.fromkeys(chosen, 0.0), toxicity.START
    mean, square = collections.Counter(), collections.Counter()
    counted = [([collections.Counter(f for x in b for f in features(x) if f in w) for b in bags(t)], y) for t, y in sample]
    for step in range(1, toxicity.ROUNDS + 1):
        gradient = collections.Counter()
        for sentences, y in counted:
            z = [bias + sum(w[f] * n for f, n in s.items()) for s in sentences]
            p = [1 / (1 + math.exp(-x)) for x in z]
            none = math.prod(1 - x for x in p)  # noisy-or: the document's probability is 1 - none
            for s, x in zip(sentences, p):
                pull = ((1 - y) - y * none / max(1 - none, 1e-9)) * x / len(sample)  # d loss / d z
                gradient["bias"] += pull
                for f, n in s.items():
                    gradient[f] += pull * n
        for f in [*w, "bias"]:
            mean[f] = 0.9 * mean[f] + 0.1 * gradient[f]
            square[f] = 0.99 * square[f] + 0.01 * gradient[f] ** 2
            rate = toxicity.RATE / (math.sqrt(square[f] / (1 - 0.99**step)) + 1e-6)
            move = rate * mean[f] / (1 - 0.9**step)
            if f == "bias":
                bias -= move
            else:
                moved = w[f] - move
                w[f] = math.copysign(max(abs(moved) - rate * toxicity.PENALTY, 0), moved)
    got = queries.op7_toxicity(spark, str(tmp_path)).collect()
    want = []
    for d, t in rows:
        z = [bias + sum(w.get(f, 0) for x in b for f in features(x)) for b in bags(t)]
        want.append((d, held(d), 1 - math.prod(1 - 1 / (1 + math.exp(-x)) for x in z)))
    got, want = (sorted(x, key=lambda r: (str(r[0]), r[2])) for x in (got, want))
    assert [tuple(r)[:2] for r in got] == [x[:2] for x in want] and np.allclose([r.score for r in got], [x[2] for x in want], atol=1e-4)
    assert all(r.predicted == (r.score >= 0.3) for r in got) and sum(r.predicted for r in got) > 5


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_jaccard_join(docs, rows, none, k, percent):
    sets = {}
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = jaccard_join.jaccard_components(docs, k, percent).collect()
    assert len(got) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (len(s), find(d)) for d, s in sets.items()}
    assert len({find(d) for d in sets}) < len(sets) - 3 and jaccard_join.jaccard_components(none).count() == 0


def test_jaccard_join_in_blocks(spark, monkeypatch):
    """Cut groups and lists, long lists and stars give the links that all pairs give."""
    for name, value in (("BLOCK", 40), ("GROUP_ROWS", 40), ("SMALL", 6), ("PIVOTS", 4)):
        monkeypatch.setattr(jaccard_join, name, value)
    base, common, texts = prose(200).split(), prose(60), []
    for i in range(160):
        w = base[:]
        for _ in range(i % 9):
            w[random.randrange(200)] = f"new{random.randrange(10**6)}"
        texts.append(" ".join(w) if i < 100 else " ".join(f"w{random.randrange(10**6)}" for _ in range(120)) + " " + common)
    hashes = [frozenset(tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)) for t in texts]
    root = list(range(160))
    for i in range(160):
        for j in range(i):
            if 100 * len(hashes[i] & hashes[j]) >= 85 * len(hashes[i] | hashes[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    got = jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root)) and len(set(root)) > 60


def test_jaccard_join_of_rows_that_share_an_id(spark):
    """Each row by its own text; the component is the least id reached; rows without an id stay outside."""
    base, other = prose(100), prose(100)
    rows = [(7, base), (7, other), (9, base + " end"), (3, other), (None, base), (None, None), (4, ""), (4, None), (8, "two words"), (8, "TWO words")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    want = [(7, 97, 7), (7, 97, 3), (9, 98, 7), (3, 97, 3), (None, 97, None), (None, 0, None), (4, 0, 4), (4, 0, 4), (8, 1, 8), (8, 1, 8)]
    distinct = lambda t: len({tuple(t.lower().split()[i : i + 4]) for i in range(len(t.split()) - 3)})
    want = [(d, distinct(t) if n > 90 else n, c) for (d, n, c), (_, t) in zip(want, rows)]
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted((str(d), n, str(c)) for d, n, c in want)


def test_trees_side_by_side():
    """Every pair of one group that links is among the candidates of many groups' trees, none of two groups is."""
    sets, group = [], []
    for g in range(30):
        base = np.unique(np.random.default_rng(g).integers(0, 1 << 62, 40 + 15 * (g % 7), dtype=np.uint64))
        for i in range(1 + g % 12 * (3 if g % 5 == 0 else 1)):
            more = np.random.default_rng(1000 * g + i).integers(0, 1 << 62, i % 9, dtype=np.uint64)
            sets.append(np.unique(np.r_[base[i % 4 :], more]))
            group.append(g)
    group = np.array(group)
    at = np.random.default_rng(1).permutation(len(sets))
    sets, group = [sets[i] for i in at], group[at]
    near, component = np.random.default_rng(2).integers(0, 9, len(sets)), np.random.default_rng(3).integers(0, 60, len(sets))
    found = {frozenset((int(a), int(b))) for x, y in jaccard_join.candidates(np.array(list(map(len, sets))), [jaccard_join.bitmap(s) for s in sets], near, 85, component, group) for a, b in zip(x, y)}
    want = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if group[i] == group[j] and component[i] != component[j] and jaccard_join.linked(sets[i], sets[j], 85)}
    assert want <= found and len(want) > 100 and all(len({group[i] for i in pair}) == 1 and len(pair) == 2 for pair in found)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 10), (5, 5), *((i, i + 1) for i in range(100, 160))]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 10: 8} | {i: 100 for i in range(100, 161)}


@pytest.mark.parametrize("ratio", [2, 8, 1000])
def test_search(docs, rows, none, ratio, monkeypatch):
    """The same hits in many rounds, in two, and in one."""
    monkeypatch.setattr(bm25_search, "ROUND", ratio)
    word = re.compile(rb"[0-9a-z\x80-\xff]+")
    counted = [(d, collections.Counter(word.findall((t or "").encode().lower()))) for d, t, *_ in rows]
    n, average = len(rows), sum(sum(c.values()) for _, c in counted) / len(rows)
    df = collections.Counter(w for _, c in counted for w in c)
    idf = {w: math.log1p((n - x + 0.5) / (x + 0.5)) for w, x in df.items()}
    signed = lambda w: (h := xxhash.xxh64_intdigest(w)) - (h >> 63 << 64)
    got = collections.defaultdict(list)
    queries = docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), "text").distinct()
    for r in bm25_search.top_k(docs, queries, k=4, max_terms=6, shard_bytes=1500).orderBy("query_id", "rank").collect():
        got[r.query_id].append((round(r.score, 6), r.doc_id))
    for d, c in dict(counted).items():
        if d % 5:
            continue
        terms = sorted((-c[w] * idf[w], signed(w), w) for w in c if df[w] >= 2)[:6]
        scores = []
        for e, x in counted:
            s = sum(-m * x[w] * 2.2 / (x[w] + 1.2 * (0.25 + 0.75 * sum(x.values()) / average)) for m, _, w in terms if w in x)
            if s:
                scores.append((-round(s, 6), e))
        assert got[d] == [(-s, e) for s, e in sorted(scores)[:4]]
    assert bm25_search.top_k(none, queries).count() == 0 and bm25_search.top_k(docs, queries.limit(0)).count() == 0


@pytest.mark.parametrize(("ratio", "chunk"), [(2, 4000), (10**6, 8 << 20)])
def test_search_by_whole_texts(docs, rows, none, ratio, chunk, monkeypatch):
    """All terms of a query count, those of one document too."""
    monkeypatch.setattr(bm25_search, "ROUND", ratio)
    monkeypatch.setattr(bm25_search, "CHUNK_BYTES", chunk)
    word = re.compile(rb"[0-9a-z\x80-\xff]+")
    counted = [(d, collections.Counter(word.findall((t or "").encode().lower()))) for d, t, *_ in rows]
    n, average = len(rows), sum(sum(c.values()) for _, c in counted) / len(rows)
    df = collections.Counter(w for _, c in counted for w in c)
    assert 1 in df.values() and max(len(c) for _, c in counted) > 12
    got = collections.defaultdict(list)
    queries = docs.select(F.col("doc_id").alias("query_id"), "text").distinct()
    for r in bm25_search.top_k(docs, queries, k=4, shard_bytes=1500).orderBy("query_id", "rank").collect():
        got[r.query_id].append((round(r.score, 6), r.doc_id))
    for d, c in dict(counted).items():
        scores = []
        for e, x in counted:
            s = sum(m * math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * x[w] * 2.2 / (x[w] + 1.2 * (0.25 + 0.75 * sum(x.values()) / average)) for w, m in c.items() if w in x)
            if s:
                scores.append((-round(s, 6), e))
        assert got[d] == [(-s, e) for s, e in sorted(scores)[:4]]
    assert bm25_search.top_k(none, queries).count() == 0 and bm25_search.top_k(docs, queries.limit(0)).count() == 0


@pytest.mark.parametrize("dense", [0, 3, 768])
def test_matrix_skips_nothing(dense, monkeypatch):
    """By postings, by matrix, and by both, with and without floors."""
    monkeypatch.setattr(bm25_search, "DENSE_TERMS", dense)
    index, hasher = bm25_search.Index(40.0), bm25_search.WordHasher()
    texts = [prose(random.randint(0, 60)).encode() for _ in range(300)]
    index.add(list(range(0, 960, 3)), texts + texts[:20], hasher)
    impacts = [dict(zip(t.tolist(), i.tolist())) for t, _, i in index.parts]
    index.close()
    asked = {q: collections.Counter(bm25_search.terms_of(t, hasher).tolist()) for q, t in enumerate(texts[:40]) if t}
    flat = [(7, q, t, c) for q, x in asked.items() for t, c in x.items()]
    chunk, query, term, tf = (np.array(x, kind) for x, kind in zip(zip(*flat), ("i8", "i8", "u8", "i8")))
    idf = {t: 0.1 + (t % 97) / 30 for t in term.tolist()}
    table = {"chunk": chunk, "query_id": query, "term": term.view(np.int64), "tf": tf, "idf": np.array([idf[t] for t in term.tolist()])}
    packed = bm25_search._pack(bm25_search.pa.table(table))["packed"][0].as_py()
    want = {}
    for q, x in asked.items():
        scores = [(-sum(c * idf[t] * d[t] for t, c in x.items() if t in d), 3 * i) for i, d in enumerate(impacts)]
        want[q] = sorted((round(s, 9), d) for s, d in scores if s)[:5]
    matrix, got = bm25_search.Matrix(index), collections.defaultdict(list)
    hits = matrix.search(packed, None, 5)
    for q, d, s in hits:
        got[q].append((round(-s, 9), d))
    assert {q: sorted(x) for q, x in got.items()} == {q: x for q, x in want.items() if x}
    third = {q: sorted((-s, d) for p, d, s in hits if p == q)[2] for q in got}
    floors = [{"query_id": q, "floor": -s, "floor_doc": d} for q, (s, d) in third.items()]
    assert sorted(matrix.search(packed, floors, 5)) == sorted((q, d, s) for q, d, s in hits if (-s, d) < third[q])


def test_texts_of_two_languages_have_matrices_of_their_own(monkeypatch):
    """As many terms as a matrix may have are common in each of them; none is left to postings, and no score is lost."""
    monkeypatch.setattr(bm25_search, "DENSE_TERMS", 100)
    added, ranges = [], bm25_search._ranges
    monkeypatch.setattr(bm25_search, "_ranges", lambda first, sizes: (added.append(int(sizes.sum())), ranges(first, sizes))[1])
    index, rng = bm25_search.Index(80.0), random.Random(5)
    texts = [" ".join(f"{'ab'[i % 2]}{rng.randrange(100)}" for _ in range(80)).encode() for i in range(400)]
    index.add(list(range(400)), texts)
    index.close()
    matrix, query, place, weight = bm25_search.Matrix(index), [], [], []
    for q in range(40):
        terms = np.unique(bm25_search.terms_of(texts[q]))
        query += [q] * len(terms)
        place += np.searchsorted(matrix.terms, terms).tolist()
        weight += [1.0 + t % 7 for t in terms.tolist()]
    query, place, weight = np.array(query), np.array(place), np.array(weight)
    got = matrix.bounds(40, query, place, weight)
    asked, impacts = np.zeros((40, len(matrix.terms))), np.zeros((len(matrix.terms), 400))
    asked[query, place] = weight
    impacts[np.searchsorted(matrix.terms, index.terms), index.docs] = index.impacts
    assert np.allclose(got, (asked @ impacts)[:, matrix.ids], rtol=bm25_search.ERROR)
    assert sum(added) == 0


@pytest.mark.parametrize(("dense", "products"), [(768, 0), (768, 10**9), (3, 600)])
def test_products_and_postings_give_the_same_scores(dense, products, monkeypatch):
    """Whatever share of a matrix is left to its postings, and with documents of many terms, scored by themselves."""
    monkeypatch.setattr(bm25_search, "DENSE_TERMS", dense)
    monkeypatch.setattr(bm25_search, "PRODUCTS", products)
    index, rng = bm25_search.Index(150.0), random.Random(6)
    texts = [" ".join(f"{'abc'[i % 3]}{int(rng.paretovariate(0.4)) % 900}" for _ in range(rng.choice((20, 150, 900)))).encode() for i in range(150)]
    index.add(list(range(150)), texts + [])
    index.close()
    matrix = bm25_search.Matrix(index)
    assert matrix.doc_sizes.max() >= bm25_search.LONG > matrix.doc_sizes.min()
    terms = [np.unique(bm25_search.terms_of(t)) for t in texts[:30]]
    query, place = np.repeat(np.arange(30), [len(t) for t in terms]), np.searchsorted(matrix.terms, np.concatenate(terms))
    weight = 1.0 + place % 5
    impacts, asked = np.zeros((len(matrix.terms), 150)), np.zeros((30, len(matrix.terms)))
    impacts[np.searchsorted(matrix.terms, index.terms), index.docs], asked[query, place] = index.impacts, weight
    want = (asked @ impacts)[:, matrix.ids]
    assert np.allclose(matrix.bounds(30, query, place, weight), want, rtol=bm25_search.ERROR)
    rows, docs = np.divmod(np.arange(30 * 150), 150)
    exact = matrix.scores(rows, docs, np.searchsorted(query, np.arange(31)), place, weight)
    assert np.allclose(exact, want.ravel(), rtol=1e-12)


def test_chunks_are_not_copied_for_every_shard(docs):
    """Chunks meet indexes in a cartesian product; no row is made, shuffled and sorted for each pair of them."""
    plan = bm25_search.top_k(docs, docs.selectExpr("doc_id AS query_id", "text"), k=4, shard_bytes=1500)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan


def test_index_of_a_shard_is_kept_whole():
    """As one row, with documents without an id in the numbers of documents only."""
    texts = [prose(random.randint(0, 60)).encode() for _ in range(50)]
    ids = [None if i % 7 == 0 else i * 10**12 for i in range(50)]
    shard = bm25_search.pa.table({"shard": [3] * 50, "doc_id": bm25_search.pa.array(ids, bm25_search.pa.int64()), "text": [t.decode() for t in texts]})
    row, plain = bm25_search._indexed(shard).to_pylist()[0], bm25_search.Index(20.0)
    plain.add([i for i in ids if i is not None], [t for i, t in zip(ids, texts) if i is not None], bm25_search.WordHasher())
    plain.close()
    got = bm25_search.Index.unpacked(row["terms"], row["postings"], 20.0)
    assert all(np.array_equal(getattr(got, x), getattr(plain, x)) for x in ("ids", "terms", "docs", "impacts"))
    df = collections.Counter(t for x in texts for t in set(bm25_search.terms_of(x, bm25_search.WordHasher()).tolist()))
    assert dict(zip(np.frombuffer(row["terms"], np.uint64).tolist(), np.frombuffer(row["df"], np.uint32).tolist())) == df and row["n"] == 50


def test_wand_skips_nothing():
    for _ in range(200):
        lists, every = [], collections.Counter()
        for _ in range(random.randint(1, 5)):
            at = sorted(random.sample(range(400), random.randint(1, 300)))
            impacts, w = [random.choice((0.25, random.random())) for _ in at], random.choice((0.5, 3.0))
            lists.append((bm25_search.Postings(np.array(at), np.array(impacts)), w))
            for d, x in zip(at, impacts):
                every[d] += w * x
        best = sorted(every.items(), key=lambda x: (-x[1], x[0]))[:7]
        assert [d for _, d in bm25_search.search(lists, 400, 7)] == [d for d, _ in best]
        floor = random.choice(best)[1]
        assert [d for _, d in bm25_search.search(lists, 400, 7, floor * (1 - 1e-9))] == [d for d, s in best if s >= floor * (1 - 1e-9)]


def test_search_rounds():
    for shards in (1, 8, 9, 64, 103, 10**6):
        edges = bm25_search.round_edges(shards)
        assert edges[0] == 0 and edges[-1] == shards and edges == sorted(set(edges))
        assert edges[1] <= 8 and all(b <= 8 * a for a, b in zip(edges[1:], edges[2:]))


def test_sharding_with_a_large_directory(spark, docs, monkeypatch):
    """The same shards if the directory is not broadcast; rows without a key and rows of one key fit too."""
    some = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "null key")] * 9 + [(3, "y" * 300)] * 20, "doc_id long, text string"))
    one = sorted((str(r.doc_id), r.n_bytes, r.depth, r.prefix) for r in extendible_hashing.shard(some, 900).collect())
    monkeypatch.setattr(extendible_hashing, "MOST_BROADCAST", 0)
    two = extendible_hashing.shard(some, 900).collect()
    assert one == sorted((str(r.doc_id), r.n_bytes, r.depth, r.prefix) for r in two) and len(one) == some.count() and len({r.depth for r in two}) > 2


def test_sharding(spark, docs, rows, none):
    for limit in (64 << 20, 5000, 900):
        got = extendible_hashing.shard(docs, limit).collect()
        size, depth = collections.Counter(), {}
        for r in got:
            size[r.shard] += r.n_bytes
            depth[r.shard] = r.depth
        assert len(got) == len(rows) and all(b <= limit for s, b in size.items() if not s.startswith("big"))
        assert all(s.startswith("big") == (r.n_bytes > limit) for r in got for s in [r.shard])
    same = spark.createDataFrame([(7, "x" * 100)] * 50, "doc_id long, text string")
    size = collections.Counter(r.shard for r in extendible_hashing.shard(same, 1000).collect())
    assert sum(size.values()) == 50 and max(size.values()) <= 10 and extendible_hashing.shard(none).count() == 0


def test_search_words_of_many_texts_at_once():
    """Words and their texts as a regular expression finds them; equal words have equal hashes and others don't, also long
    words and slices; nulls and empty texts have none."""
    import random
    import re

    pa, rng = bm25_search.pa, random.Random(9)
    texts = [None, "", "-", "Äb-C1 ", "x" * 70_000 + " y", "y " + "X" * 70_000, "ab" * 32_768, *("".join(rng.choice("abAB01 -é\x00\n") for _ in range(rng.randrange(200))) for _ in range(500))]
    for kind, first in ((pa.string(), 0), (pa.large_string(), 3), (pa.string(), len(texts))):
        terms, docs = bm25_search.words_of(pa.array(texts, kind).slice(first))
        want = [(i, w) for i, t in enumerate(texts[first:]) for w in re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())]
        known = dict(zip((w for _, w in want), terms.tolist()))
        assert docs.tolist() == [i for i, _ in want] and terms.tolist() == [known[w] for _, w in want] and len(set(known.values())) == len(known)
