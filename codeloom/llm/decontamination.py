"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

A phrase is `phrase` consecutive words of an item (a shorter item is one phrase). Each phrase is looked up by its rarest
term in the training text. The postings of these terms are stored: (term, document, position, and the hashes of the
words around it). Joined with the items' places of the same term, the lists of the terms beside it are intersected,
offset by offset, from the neighbours that both sides carry. Every phrase that lies around a posting is found at once,
as the longest run on one diagonal (document position minus item position).

Only terms (64-bit hashes) are broadcast, at most BLOCK_TERMS at a time: more take another pass over the documents. What
has the items' words is joined with the stored postings, in lists of at most LIST places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Terms that are broadcast at a time (16 bytes each), and places of one term that a row of the items' lists has.
BLOCK_TERMS, LIST = 1_000_000, 256


def words_of(text: str | Column) -> Column:
    """The words of a text: A-Z in lower case, cut at every ASCII character that is no letter or digit. Null has none."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), NOT_WORD), "")


def _blocks(df: DataFrame, key: str, rows: int, at_most: int) -> list[DataFrame]:
    """df in blocks of about at_most rows, by a hash of the key."""
    n = -(-rows // at_most)
    return [df] if n <= 1 else [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def _tokens(docs: DataFrame, *more: str) -> DataFrame:
    """A row for each word of each text: doc_id, more, position, term (its hash)."""
    return docs.select("doc_id", *more, F.posexplode(words_of("text") if not more else "words").alias("position", "word")).withColumn("term", F.xxhash64("word"))


def frequencies(docs: DataFrame, terms: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """How often each of the terms (column term, distinct) occurs in all of docs: term, frequency (0 if it doesn't)."""
    words = _tokens(docs).select("term")
    counted = [words.join(F.broadcast(b), "term").groupBy("term").agg(F.count("*").alias("frequency")) for b in _blocks(terms, "term", terms.count(), block_terms)]
    return terms.join(reduce(DataFrame.unionAll, counted), "term", "left").select("term", F.coalesce("frequency", F.lit(0)).alias("frequency"))


def anchors(items: DataFrame, frequency: DataFrame, phrase: int) -> DataFrame:
    """The rarest term of each phrase: item_id, place, n (the phrase's words), before, term, after (hashes of the item's
    words on both sides, as far as a phrase can reach), frequency. items: item_id, row, words (hashes)."""
    placed = items.select("item_id", "row", "words", F.posexplode("words").alias("place", "term")).join(frequency, "term")
    rare = F.array_sort(F.collect_list(F.struct("place", "frequency")))
    by_item = placed.groupBy("item_id", "row").agg(F.first("words").alias("words"), rare.alias("rare"))
    n = F.least(F.size("words"), F.lit(phrase))
    starts = F.sequence(F.lit(0), F.size("words") - n)
    least = F.transform(starts, lambda s: F.array_min(F.transform(F.slice("rare", s + 1, n), lambda x: F.struct(x["frequency"], x["place"])))["place"])
    chosen = by_item.select("item_id", "words", "rare", n.alias("n"), F.explode(F.array_distinct(least)).alias("place"))
    at = F.col("place") + 1
    return chosen.select("item_id", "place", "n", F.element_at("words", at).alias("term"), *_around("words", F.col("place"), phrase), F.element_at("rare", at)["frequency"].alias("frequency")).distinct()


def _around(words: str, place: Column, phrase: int, hashed: bool = True) -> tuple[Column, Column]:
    """The up to phrase - 1 words before a place, nearest first, and after it, as hashes."""
    from_ = F.greatest(place - (phrase - 1), F.lit(0))
    of = (lambda x: x) if hashed else lambda x: F.transform(x, lambda w: F.xxhash64(w))
    return of(F.reverse(F.slice(words, from_ + 1, place - from_))).alias("before"), of(F.slice(words, place + 2, F.lit(phrase - 1))).alias("after")


def postings(docs: DataFrame, terms: DataFrame, phrase: int, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The positional index of the given terms (column term), stored: term, doc_id, position, doc_before, doc_after."""
    before, after = _around("words", F.col("position"), phrase, hashed=False)
    words = _tokens(docs.select("doc_id", words_of("text").alias("words")), "words")
    found = [
        words.join(F.broadcast(b), "term").select("term", "doc_id", "position", before.alias("doc_before"), after.alias("doc_after"))
        for b in _blocks(terms, "term", terms.count(), block_terms)
    ]
    return written(reduce(DataFrame.unionAll, found), "postings")


def _agree(one: str, two: str) -> Column:
    """How many leading entries of two arrays are equal."""
    equal = F.transform(F.arrays_zip(F.col(one).alias("a"), F.col(two).alias("b")), lambda x: F.coalesce(x["a"] == x["b"], F.lit(False)))
    at = F.array_position(equal, F.lit(False))
    return F.when(at == 0, F.size(equal).cast("long")).otherwise(at - 1)


def _hashed(text: str = "text") -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def phrase_matches(docs: DataFrame, items: DataFrame, phrase: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Occurrences of the items' phrases: doc_id, item_id, start, length, in words. Every occurrence of a phrase lies in
    one of the rows, and every row consists of occurrences. Items without words have none."""
    items = items.select("item_id", _hashed().alias("words")).where(F.size("words") > 0).withColumn("row", F.xxhash64("words")).dropDuplicates(["item_id", "row"])
    terms = written(items.select(F.explode("words").alias("term")).distinct(), "terms")
    chosen = written(anchors(items, frequencies(docs, terms, block_terms), phrase), "anchors")
    index = postings(docs, chosen.select("term").distinct(), phrase, block_terms)
    # a term's places in lists, dealt by their hash
    place = F.struct("item_id", "n", "before", "after")
    of_term = chosen.groupBy("term").agg(F.count("*").alias("places"))
    dealt = chosen.join(of_term, "term").withColumn("list", F.pmod(F.xxhash64("item_id", "place"), F.ceil(F.col("places") / LIST)))
    lists = written(dealt.groupBy("term", "list").agg(F.max("frequency").alias("n"), F.collect_list(place).alias("items")).drop("list"), "lists")
    hit = hot_join(index, lists, ["term"]).select("doc_id", "position", "doc_before", "doc_after", F.explode("items").alias("item"))
    hit = hit.select("doc_id", "position", "doc_before", "doc_after", "item.*").withColumns({"left": _agree("before", "doc_before"), "right": _agree("after", "doc_after")})
    hit = hit.where(F.col("left") + F.col("right") + 1 >= F.col("n"))
    return hit.select("doc_id", "item_id", (F.col("position") - F.col("left")).cast("long").alias("start"), (F.col("left") + F.col("right") + 1).alias("length")).distinct()


def proximity_matches(docs: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """Where two terms stand within `slop` words of each other: pair_id, doc_id, position of the first, distance.

    pairs (pair_id, first, second): any number of queries; both terms in lower case. The postings of the first terms
    are joined with the pairs, and the second looked for among their neighbours.
    """
    asked = written(pairs.select("pair_id", F.xxhash64("first").alias("term"), F.xxhash64("second").alias("other")), "pairs")
    near = postings(docs, asked.select("term").distinct(), slop + 1).join(asked, "term")
    a, b = (F.array_position(c, F.col("other")) for c in ("doc_before", "doc_after"))
    distance = F.least(F.when(a > 0, a), F.when(b > 0, b))
    return near.select("pair_id", "doc_id", "position", distance.alias("distance")).where("distance is not null")


def decontaminate(docs: DataFrame, items: DataFrame, phrase: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Per row of docs (doc_id, text; other columns are ignored): doc_id, of (a hash of the text), n_words, n_hit (words
    in an occurrence of an item's phrase), items (ids of the items that occur, as sorted strings) and contaminated (n_hit > 0).

    Words are compared by 64-bit hashes, so that rows have a bounded size however long words are.
    A null or empty text has no words and isn't hit. Rows that share a doc_id are told apart by their text. A null
    doc_id or item_id is a value like others (such an item counts as ''). No items: nothing is hit.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    key = F.struct("doc_id", F.xxhash64("text").alias("of"))
    hits = written(phrase_matches(docs.select(key.alias("doc_id"), "text"), items, phrase, block_terms), "hits")
    # Words are counted once however many phrases cover them: the union of the rows' ranges, by document.
    places = hits.select("doc_id", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("place")).distinct()
    n_hit = places.groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    of = hits.select("doc_id", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")).distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    hit = n_hit.join(of, "doc_id").select(F.col("doc_id.doc_id").alias("hit_doc"), F.col("doc_id.of").alias("hit_of"), "n_hit", "items")
    every = docs.select("doc_id", F.xxhash64("text").alias("of"), F.size(words_of("text")).cast("long").alias("n_words"))
    joined = every.join(hit, every["doc_id"].eqNullSafe(hit["hit_doc"]) & (every["of"] == hit["hit_of"]), "left")
    return joined.select("doc_id", "of", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))
