"""Benchmark decontamination by a distributed positional inverted index (operator 3).

The index holds postings (term, document, positions) of training tokens. A phrase is looked up from its rarest term: its
list gives candidate starts, and the lists of the other terms, adjusted by their offsets, are intersected with these.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import alnum_words, free_names, lean, small_side, stored

#: Terms of a benchmark up to which they are sent to every task (about 100 bytes each); beyond, all terms are indexed.
VOCABULARY = 300_000


def phrase_windows(items: DataFrame, n: int) -> DataFrame:
    """(item_id, terms): every n consecutive words of items(item_id, text); an item of fewer words, but not none, is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = [x.decode("utf-8", "replace") for x in alnum_words(text)]
                for i in range(max(1, len(w) - n + 1) if w else 0):
                    ids.append(item)
                    terms.append(w[i : i + n])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(terms, pa.list_(pa.string()))], ["item_id", "terms"])

    return items.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null").mapInArrow(run, "item_id string, terms array<string>")


def _count_terms(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value if vocabulary is not None else None
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column("text").to_pylist():
                words = set(alnum_words(text))
                seen.update(words if known is None else words.intersection(known))
            yield pa.RecordBatch.from_arrays([pa.array([k.decode("utf-8", "replace") for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "docs"])

    return run


_POSTING = pa.list_(pa.struct([("term", pa.string()), ("positions", pa.list_(pa.int32()))]))


def _postings(vocabulary, anchors, reach: int):
    """For each document its number of words and, near its anchor terms, the positions of the vocabulary's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = names = rare = None
        if vocabulary is not None:
            names = sorted(vocabulary.value)
            number = {w: i for i, w in enumerate(names)}
            rare = np.array([w in anchors.value for w in names] + [False])
            names = [w.decode("utf-8", "replace") for w in names]
        for batch in batches:
            sizes, lists = [], []
            for text in batch.column("text").to_pylist():
                words = alnum_words(text)
                sizes.append(len(words))
                own = []
                if words and number is None:
                    places: dict[bytes, list[int]] = {}
                    for i, w in enumerate(words):
                        places.setdefault(w, []).append(i)
                    own = [{"term": w.decode("utf-8", "replace"), "positions": p} for w, p in places.items()]
                elif words and not number.keys().isdisjoint(words):
                    ids = np.fromiter((number.get(w, -1) for w in words), np.int32, len(words))
                    at = np.flatnonzero(rare[ids])
                    if len(at):
                        edge = np.zeros(len(ids) + 1, np.int32)
                        np.add.at(edge, np.maximum(at - reach + 1, 0), 1)
                        np.add.at(edge, np.minimum(at + reach, len(ids)), -1)
                        near = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (ids >= 0))
                        order = near[np.argsort(ids[near], kind="stable")]
                        cuts = np.flatnonzero(np.diff(ids[order])) + 1
                        own = [{"term": names[ids[run_[0]]], "positions": run_.astype(np.int32)} for run_ in np.split(order, cuts)]
                lists.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(sizes, pa.int64()), pa.array(lists, _POSTING)], ["doc_id", "mark", "n_words", "postings"])

    return run


class PositionalIndex:
    """Postings (term, doc_id, mark, positions), sorted by term in the shared folder, and documents' numbers of words.

    `mark` is a hash of the text, so that rows that repeat a doc_id with other texts stay apart. With a vocabulary and
    anchors, only terms of the vocabulary within `reach` words of an anchor are stored; without, all are.
    """

    def __init__(self, documents: DataFrame, vocabulary=None, anchors=None, reach: int = 1):
        rows = documents.select("doc_id", "text", F.xxhash64("text").alias("mark"))
        forward = stored(rows.mapInArrow(lean(_postings(vocabulary, anchors, reach)), "doc_id long, mark long, n_words long, postings array<struct<term:string,positions:array<int>>>"), "forward")
        self.sizes = forward.select("doc_id", "mark", "n_words")
        flat = forward.select(F.coalesce("doc_id", F.lit(-(1 << 62))).alias("doc"), "mark", F.explode("postings").alias("p")).select("p.term", "doc", "mark", "p.positions").distinct()
        self.postings = stored(flat.repartitionByRange("term", "doc").sortWithinPartitions("term", "doc"), "postings")


def _with_frequencies(windows: DataFrame, frequency: DataFrame) -> DataFrame:
    """Windows all of whose terms occur, with (docs, at, term) of their terms from the rarest."""
    flat = windows.select("window", F.posexplode("terms").alias("at", "term")).join(frequency, "term", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "at", "term")))
    return flat.groupBy("window").agg(order.alias("rarest")).filter("rarest[0].docs > 0").withColumn("size", F.size("rarest"))


def phrase_matches(index: PositionalIndex, windows: DataFrame) -> DataFrame:
    """(window, doc, mark, start, size): exact occurrences of windows(window, rarest, size) in the index.

    The windows' side is small beside the corpus: it is broadcast if its size allows, else the lists are joined by shuffle.
    """
    p = index.postings
    first = small_side(windows.select("window", "size", "rarest", F.col("rarest")[0]["term"].alias("term"), F.col("rarest")[0]["at"].alias("at")), 200_000)
    begun = p.join(first, "term").select("window", "size", "rarest", "doc", "mark", F.explode("positions").alias("place"), "at").select("window", "size", "rarest", "doc", "mark", (F.col("place") - F.col("at")).alias("start")).filter("start >= 0")
    begun = stored(begun, "begun")
    second = begun.filter("size > 1").select("*", F.col("rarest")[1]["term"].alias("term"), (F.col("start") + F.col("rarest")[1]["at"]).alias("place"))
    second = second.join(p, ["term", "doc", "mark"]).filter(F.array_contains("positions", F.col("place"))).select("window", "size", "rarest", "doc", "mark", "start")
    found = begun.filter("size = 1").select("window", "doc", "mark", "start", "size").unionAll(second.filter("size = 2").select("window", "doc", "mark", "start", "size"))
    rest = second.filter("size > 2").select("window", "size", "doc", "mark", "start", F.explode(F.slice("rarest", 3, F.greatest(F.col("size") - 2, F.lit(1)))).alias("t"))
    rest = rest.select("window", "size", "doc", "mark", "start", F.col("t.term").alias("term"), (F.col("start") + F.col("t.at")).alias("place"))
    rest = rest.join(p, ["term", "doc", "mark"]).filter(F.array_contains("positions", F.col("place")))
    rest = rest.groupBy("window", "doc", "mark", "start", "size").count().filter("count = size - 2").select("window", "doc", "mark", "start", "size")
    return found.unionAll(rest)


def proximity_matches(index: PositionalIndex, queries: DataFrame, frequency: DataFrame, span: int) -> DataFrame:
    """(window, doc, mark, place): places of the rarest term of queries(window, terms) that have all other terms within `span` words."""
    q = _with_frequencies(queries.select("window", F.array_distinct("terms").alias("terms")), frequency)
    p = index.postings
    first = small_side(q.select("window", "size", "rarest", F.col("rarest")[0]["term"].alias("term")), 200_000)
    near = p.join(first, "term").select("window", "size", "rarest", "doc", "mark", F.explode("positions").alias("place"))
    alone = near.filter("size = 1").select("window", "doc", "mark", "place")
    rest = near.filter("size > 1").select("window", "size", "doc", "mark", "place", F.explode(F.slice("rarest", 2, F.greatest(F.col("size") - 1, F.lit(1)))).alias("t")).withColumn("term", F.col("t.term"))
    rest = rest.join(p, ["term", "doc", "mark"]).filter(F.exists("positions", lambda x: F.abs(x - F.col("place")) <= span))
    return alone.unionAll(rest.groupBy("window", "doc", "mark", "place", "size").count().filter("count = size - 1").select("window", "doc", "mark", "place"))


def term_frequencies(documents: DataFrame, vocabulary=None) -> DataFrame:
    """(term, docs): the number of documents that hold each term, over all documents."""
    return documents.select("text").mapInArrow(lean(_count_terms(vocabulary)), "term string, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20) -> DataFrame:
    """For each row of documents(doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated, mark.

    A word inside an occurrence of a window of benchmark(item_id, text) is hit; a document is contaminated if any word is
    and share * n_hit >= n_words. Null and empty texts have no words; items without words have no windows; a null
    item_id takes no part; items that repeat a text all count, rows that repeat an item_id count once.
    """
    spark = documents.sparkSession
    owners = stored(phrase_windows(benchmark, n).select("item_id", F.unhex(F.md5(F.concat_ws(" ", "terms"))).alias("window"), "terms").distinct(), "owners")
    windows = stored(owners.dropDuplicates(["window"]).select("window", "terms"), "windows")
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    vocabulary = anchors = None
    if (few := [r.term.encode() for r in terms.limit(VOCABULARY + 1).collect()]) and len(few) <= VOCABULARY:
        vocabulary = spark.sparkContext.broadcast(frozenset(few))
    frequency = stored(term_frequencies(documents, vocabulary), "frequency")
    ranked = stored(_with_frequencies(windows, frequency), "ranked")
    if vocabulary is not None:
        rarest = ranked.select(F.col("rarest")[0]["term"].alias("term")).distinct()  # part of the vocabulary, so bounded as that is
        anchors = spark.sparkContext.broadcast(frozenset(r.term.encode() for r in rarest.collect()))
    index = PositionalIndex(documents, vocabulary, anchors, n)
    matches = stored(phrase_matches(index, ranked).distinct(), "matches")
    spans = matches.groupBy("doc", "mark").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("spans"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))
    step = lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["hit"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("hit"))
    hits = spans.select("doc", "mark", F.aggregate("spans", zero, step)["hit"].alias("n_hit"))
    held = matches.select("doc", "mark", "window").distinct().join(small_side(owners.select("window", "item_id")), "window").groupBy("doc", "mark").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    sizes = index.sizes.withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 62))))
    out = sizes.join(hits, ["doc", "mark"], "left").join(held, ["doc", "mark"], "left")
    none = F.array().cast("array<string>")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        ((hit > 0) & (hit * share >= F.col("n_words"))).alias("contaminated"), "mark",
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20) -> DataFrame:
    """documents without the contaminated ones; all columns stay."""
    doc, mark = free_names(documents, "__doc", "__mark")
    bad = stored(contamination(documents, benchmark, n, share).filter("contaminated").select(F.coalesce("doc_id", F.lit(-(1 << 62))).alias(doc), F.col("mark").alias(mark)).distinct(), "contaminated")
    key = [F.coalesce(documents["doc_id"].cast("long"), F.lit(-(1 << 62))).alias(doc), F.xxhash64(documents["text"]).alias(mark)]
    return documents.select("*", *key).join(small_side(bad), [doc, mark], "left_anti").drop(doc, mark)
