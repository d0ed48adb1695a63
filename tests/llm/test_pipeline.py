"""The pipeline against its stages' brute-force meaning, on small driver tables."""

import itertools
import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import importance
from codeloom.llm.common import table, written

SF = "/root/testdata/sf0.01"  # the share of good documents is estimated from labels: 87 of them (sf0.001) tell too little


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    stage = dict(corpus_pipeline.STAGES)
    kept = {}
    for name in list(stage)[:4]:
        docs = written(stage[name](spark, docs, SF), name)
        assert docs.columns == table(spark, SF, "documents").columns
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    n_bad, n_good = (sum(q == x for q in labels.values()) for x in (0, 1))
    assert sum(labels.get(d) == 0 for d in kept["quality"]) <= 0.15 * n_bad and sum(labels.get(d) == 1 for d in kept["quality"]) >= 0.97 * n_good
    texts = {r.doc_id: (r.text or "").encode() for r in table(spark, SF, "documents").collect()}
    sets = {}
    for d in kept["near_duplicates"]:
        w = texts[d].lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    assert not any(a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a in sets for b in sets)
    assert len(kept["near_duplicates"]) == len(set(kept["near_duplicates"])) and set(kept["decontamination"]) < set(kept["near_duplicates"])
    words = sum(len(texts[d].split()) for d in kept["decontamination"])
    assert 0.9 * words <= sum(len(texts[d].split()) for d in kept["mix"]) <= words and max(map(kept["mix"].count, kept["mix"])) <= 3
    assert stage["sharding"](spark, docs, SF).count() == len(kept["mix"])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_stages_on_awkward_rows(spark):
    """What each stage keeps of rows with nulls, without words, repeated, with columns of clashing names."""
    rows = [(1, None, "en", None, 0), (None, "a b c", None, "s", 5), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "word " * 200, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("of", "copies", "kept", "shard", "row")})
    stage = dict(corpus_pipeline.STAGES)
    kept = {name: sorted(((r.doc_id, r.text) for r in stage[name](spark, docs, SF).collect()), key=str) for name in stage}
    every = sorted((r[:2] for r in rows), key=str)
    assert kept["decontamination"] == kept["sharding"] == every
    assert kept["near_duplicates"] == sorted({r[:2] for r in rows}, key=str)
    share = round(5 * importance.target_share(table(spark, SF, "labels")))
    assert set(kept["quality"]) <= set(every) and share <= len(kept["quality"]) <= share + 1  # of rows that are alike both stay
    assert set(kept["mix"]) == {(3, "word " * 200)} or set(kept["mix"]) == {(None, "a b c"), (3, "word " * 200)}
    assert sum(len(t.split()) for _, t in kept["mix"]) <= 203
    for name, f in stage.items():
        assert f(spark, docs.limit(0), SF).count() == 0, name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_stages_by_brute_force(spark):
    """What near_duplicates and decontamination keep of all documents, by comparing all pairs and looking up all windows."""
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    sets = {}
    for d, t in texts.items():
        w = t.lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    least = {d: d for d in texts}

    def root(d):
        while least[d] != d:
            d = least[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * (both := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - both):
            one, two = sorted((root(a), root(b)))
            least[two] = one
    want = sorted(d for d in texts if root(d) == d)
    assert len(want) < len(texts) and sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).select("doc_id").collect()) == want
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", t.lower())
    passages = set()
    for (t,) in table(spark, SF, "benchmark").select("text").collect():
        w = words((t or "").encode())
        passages |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    lengths = {len(p) for p in passages}
    want = sorted(d for d, t in texts.items() if not any(tuple(w[i : i + n]) in passages for w in [words(t)] for n in lengths for i in range(len(w) - n + 1)))
    assert len(want) < len(texts) and sorted(r.doc_id for r in corpus_pipeline.decontaminated(spark, docs, SF).select("doc_id").collect()) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_repeated_and_missing_ids(spark):
    """A text goes for what it is itself, not for what another text under its doc_id, or without one, is."""
    item = next(t for (t,) in table(spark, SF, "benchmark").select("text").collect() if len((t or "").split()) >= 20)
    clean, other, third = (" ".join(f"{x}{i}" for i in range(60)) for x in ("clean", "other", "third"))
    rows = [(None, item), (None, clean), (1, item), (1, other), (2, third)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.decontaminated(spark, docs, SF).collect()
    assert {tuple(r) for r in got} == {(None, clean), (1, other), (2, third)} and len(got) == 3
    # 1 has a text of its own and one like that of 0; 3 has the same row twice
    rows = [(0, clean), (1, clean + " end"), (1, other), (2, other), (3, third), (3, third), (None, third), (4, ""), (5, None)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, component_id string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(0, clean), (1, other), (3, third), (None, third), (4, ""), (5, None)], key=str)
