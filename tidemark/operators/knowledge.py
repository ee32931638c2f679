"""Entities in text: a dictionary tagger, the co-occurrence graph, walks and boosts on it, spelling, phrase-to-column lookup, text generation tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import query_tokens, spaced, tokens
from tidemark.scratch import BROADCAST_ROWS, small_side, stored

MIN_JACCARD = 0.1


def tag(sections: DataFrame, dictionary: dict[str, str], longest_only: bool = True) -> DataFrame:
    """(id, tags): actions of the dictionary's phrases that stand in the body's tokens.

    Longest only: from the left, the longest phrase that starts at a token wins and the next one starts after it; else all.
    """
    phrases: dict[tuple[str, ...], set[str]] = {}
    for phrase, action in dictionary.items():
        words = tuple(query_tokens(phrase, keep_stop_words=True))
        phrases.setdefault(words, set()).add(action or "".join(c for c in phrase.upper() if c.isalnum()))
    most = max(map(len, phrases), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for words in batch.column("words").to_pylist():
                found, i = [], 0
                while i < len(words):
                    step = 1
                    for n in range(min(most, len(words) - i), 0, -1):
                        if hit := phrases.get(tuple(words[i : i + n])):
                            found += sorted(hit)
                            if longest_only:
                                step = n
                                break
                    i += step
                out.append(sorted(set(found)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(pa.string()))], ["id", "tags"])

    return sections.select("id", tokens(F.col("body")).alias("words")).mapInArrow(run, "id long, tags array<string>")


def _tagged(book, longest_only: bool):
    """Tags by a tree of the phrases' words: all places of a batch go down a level at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(sorted({w for phrase, _ in book.value for w in phrase}), pa.string())
        number, actions = {w: i for i, w in enumerate(words.to_pylist())}, [a for _, a in book.value]
        tree: dict[tuple[int, int], int] = {}
        ends = {}
        for k, (phrase, _) in enumerate(book.value):
            node = 0
            for w in phrase:
                node = tree.setdefault((node, number[w]), len(tree) + 1)
            ends[node] = k
        edges = np.array(sorted((a * len(words) + w, b) for (a, w), b in tree.items()), np.int64).reshape(-1, 2)
        phrase_of = np.full(len(tree) + 1, -1)
        phrase_of[list(ends)] = list(ends.values())

        for batch in batches:
            parts = pc.split_pattern(batch.column("words"), " ")
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
            coded = parts.flatten().dictionary_encode()
            code = coded.indices.to_numpy()
            own = pc.fill_null(pc.index_in(coded.dictionary, value_set=words), -1).to_numpy(zero_copy_only=False)[code]
            real = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[code]
            row, own = row[real], own[real]
            at, n, found = np.flatnonzero(own >= 0), 0, []
            node = np.zeros(len(at), np.int64)
            while len(at):
                key = node * len(words) + own[at + n]
                place = np.minimum(np.searchsorted(edges[:, 0], key), len(edges) - 1)
                there = edges[place, 0] == key
                at, node, n = at[there], edges[place[there], 1], n + 1
                hit = phrase_of[node] >= 0
                found.append((at[hit], np.full(hit.sum(), n), phrase_of[node[hit]]))
                on = at + n < len(own)
                at, node = at[on], node[on]
                on = (row[at + n] == row[at]) & (own[at + n] >= 0)
                at, node = at[on], node[on]
            tags = [set() for _ in range(batch.num_rows)]
            if found:
                at, size, phrase = (np.concatenate(x) for x in zip(*found, strict=True))
                if longest_only:
                    order, keep, free = np.lexsort((-size, at)), [], 0
                    for i, a, k in zip(order.tolist(), at[order].tolist(), size[order].tolist(), strict=True):
                        if a >= free:
                            keep.append(i)
                            free = a + k
                    at, phrase = at[keep], phrase[keep]
                for x in np.unique(row[at] * len(actions) + phrase).tolist():
                    tags[x // len(actions)].update(actions[x % len(actions)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([sorted(x) for x in tags], pa.list_(pa.string()))], ["id", "tags"])

    return run


def tag_by_table(sections: DataFrame, phrases: DataFrame, longest_only: bool = True) -> DataFrame:
    """tag() for a dictionary that is a table, phrases(phrase, action).

    Up to BROADCAST_ROWS phrases go to the tasks, which look for them where the texts lie; of more, runs of tokens are
    joined with the table, so that neither side meets the driver.
    """
    d = phrases.select(F.array_join(tokens(F.col("phrase")), " ").alias("run"), "action").filter("run != ''").groupBy("run").agg(F.collect_set("action").alias("actions"))
    d = stored(d.withColumn("n", F.size(F.split("run", " "))), "phrases")
    if d.count() <= BROADCAST_ROWS:
        book = d.sparkSession.sparkContext.broadcast([(r.run.split(" "), sorted(r.actions)) for r in d.collect()])
        return sections.select("id", spaced(F.col("body")).alias("words")).mapInArrow(_tagged(book, longest_only), f"id {dict(sections.dtypes)['id']}, tags array<string>")
    sizes = [r.n for r in d.select("n").distinct().collect()]  # lengths of phrases
    words = sections.select("id", tokens(F.col("body")).alias("words"))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - (n - 1)), lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice("words", i, n), " ").alias("run")))
    none = F.lit([]).cast("array<struct<at:int,n:int,run:string>>")
    every = F.concat(none, *[F.when(F.size("words") >= n, runs(n)).otherwise(none) for n in sizes])
    hits = words.select("id", F.explode(every).alias("r")).select("id", "r.at", F.col("r.run").alias("run")).join(small_side(d), "run")
    hits = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("less"), "actions"))).alias("hits"))
    zero = F.struct(F.lit(0).alias("free"), F.lit([]).cast("array<string>").alias("tags"))
    step = lambda a, h: F.when(h["at"] < a["free"], a).otherwise(F.struct((h["at"] - h["less"] if longest_only else F.lit(0)).cast("int").alias("free"), F.concat(a["tags"], h["actions"]).alias("tags")))
    tagged = hits.select("id", F.array_sort(F.array_distinct(F.aggregate("hits", zero, step)["tags"])).alias("tags"))
    return sections.select("id").join(tagged, "id", "left").select("id", F.coalesce("tags", F.lit([]).cast("array<string>")).alias("tags"))


def tag_pruned(candidates: DataFrame, tagged: DataFrame, query_tags: list[str]) -> DataFrame:
    """Candidates whose section has every tag of the query; a tag that no section has leaves none."""
    need = F.array(*map(F.lit, query_tags)).cast("array<string>")
    return candidates.join(tagged.filter(F.size(F.array_except(need, F.col("tags"))) == 0).select("id"), "id", "left_semi")


def entity_graph(mentions: DataFrame, least: float = MIN_JACCARD, touching: list[str] | None = None) -> DataFrame:
    """(a, b, both, jaccard, relatedness) of entities that share sections, from mentions(id, entity).

    jaccard is at least `least`. relatedness is tanh(sign(z) ln(1 + |z|) / 3) with z the number of shared sections against
    what independence would give, in standard deviations; 0 where that has no spread. Pairs come from co-occurrence in a
    section, so the work is the sum of squares of entities a section, not of entities. With touching, only edges of
    these entities are made, and the work is their mentions times entities a section.
    """
    m = mentions.select("id", "entity").distinct()
    n = m.select("id").distinct().count()
    sizes = m.groupBy("entity").agg(F.count("*").alias("k"))
    if touching is None:
        lists = m.groupBy("id").agg(F.array_sort(F.collect_set("entity")).alias("e"))
        pairs = lists.select("e", F.posexplode("e").alias("i", "a")).select("a", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("b"))
    else:
        own = m.filter(F.col("entity").isin(*touching))
        pairs = m.select("id", F.col("entity").alias("other")).join(own.select("id", F.col("entity").alias("seed")), "id").filter(F.col("other") != F.col("seed"))
        pairs = pairs.filter((F.col("seed") < F.col("other")) | ~F.col("other").isin(*touching)).select(F.least("seed", "other").alias("a"), F.greatest("seed", "other").alias("b"))  # a pair of two of them once
    both = pairs.groupBy("a", "b").agg(F.count("*").alias("both"))
    g = both.join(sizes.toDF("a", "ka"), "a").join(sizes.toDF("b", "kb"), "b")
    g = g.withColumn("jaccard", F.col("both") / (F.col("ka") + F.col("kb") - F.col("both"))).filter(F.col("jaccard") >= least)
    expect = F.col("ka") * F.col("kb") / F.lit(float(n))
    spread = expect * (1 - F.col("ka") / F.lit(float(n))) * (1 - F.col("kb") / F.lit(float(n)))
    z = F.when(spread > 0, (F.col("both") - expect) / F.sqrt(spread)).otherwise(F.lit(0.0))
    return g.select("a", "b", "both", "jaccard", F.tanh(F.signum(z) * F.log(1 + F.abs(z)) / 3).alias("relatedness"))


def graph_walk(graph: DataFrame, mentions: DataFrame, seeds: list[str], least: float = 0.05, most: int = 8, damp: float = 0.5) -> DataFrame:
    """(id, mass): sections by the entities near the seeds: 1 for a seed, damp times the edge for its `most` closest neighbours, the best over seeds; masses are sums, divided by the largest."""
    spark = graph.sparkSession
    start = spark.createDataFrame([(s,) for s in seeds], "seed string")
    both = graph.select("a", "b", "relatedness").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "relatedness"))
    near = both.join(F.broadcast(start), F.col("a") == F.col("seed")).filter(F.col("relatedness") >= least)
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy(F.round("relatedness", 9).desc(), "b"))).filter(F.col("n") <= most)
    weights = near.select(F.col("b").alias("entity"), (damp * F.col("relatedness")).alias("w")).unionByName(start.select(F.col("seed").alias("entity"), F.lit(1.0).alias("w"))).groupBy("entity").agg(F.max("w").alias("w"))
    mass = mentions.select("id", "entity").distinct().join(weights, "entity").groupBy("id").agg(F.sum("w").alias("raw"))
    return mass.join(F.broadcast(mass.agg(F.max("raw").alias("most"))), F.lit(True)).select("id", (F.col("raw") / F.col("most")).alias("mass"))


def graph_boost(scored: DataFrame, mass: DataFrame, beta: float = 0.4, admit: float = 0.5) -> DataFrame:
    """(id, score): score * (1 + beta * mass); sections without a score but a mass of `admit` join at beta * mass."""
    j = scored.select("id", "score").join(mass, "id", "full")
    m = F.coalesce("mass", F.lit(0.0))
    return j.filter(F.col("score").isNotNull() | (m >= admit)).select("id", F.when(F.col("score").isNotNull(), F.col("score") * (1 + beta * m)).otherwise(beta * m).alias("score"))


def trigrams(word: Column) -> Column:
    padded = F.concat(F.lit("_"), word, F.lit("_"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substr(padded, i, F.lit(3))))


def spell(words: DataFrame, vocabulary: DataFrame, shortlist: int = 20, most: int = 2) -> DataFrame:
    """(word, suggestion): each word's best known one; known words stand for themselves, words without a close one for none.

    Candidates share trigrams with the word, the `shortlist` best by the sum of their trigrams' rarity; among those within
    `most` edits the rarity sum times 1, 0.8 or 0.5 (for 0, 1 or 2 edits) decides, then the spelling.
    """
    v = vocabulary.select("word").distinct()
    known = words.select("word").distinct().join(v, "word", "left_semi").select("word", F.col("word").alias("suggestion"))
    asked = words.select("word").distinct().join(v, "word", "left_anti")
    n = v.count()
    index = v.select(F.col("word").alias("candidate"), F.explode(trigrams(F.col("word"))).alias("g"))
    weight = index.groupBy("g").agg(F.log(1 + (F.lit(float(n)) - F.count("*") + 0.5) / (F.count("*") + 0.5)).alias("idf"))
    q = asked.select("word", F.explode(trigrams(F.col("word"))).alias("g"))
    scored = q.join(index, "g").join(weight, "g").groupBy("word", "candidate").agg(F.sum("idf").alias("score"))
    short = scored.withColumn("n", F.row_number().over(Window.partitionBy("word").orderBy(F.round("score", 9).desc(), "candidate"))).filter(F.col("n") <= shortlist)
    edits = F.levenshtein("word", "candidate")
    factor = F.when(edits == 0, 1.0).when(edits == 1, 0.8).when(edits <= most, 0.5)
    fair = short.withColumn("value", F.round(F.col("score") * factor, 9)).filter("value is not null")
    best = fair.groupBy("word").agg(F.min_by("candidate", F.struct(-F.col("value"), "candidate")).alias("suggestion"))
    return known.unionByName(asked.join(best, "word", "left").select("word", "suggestion"))


def transitions(sections: DataFrame) -> DataFrame:
    """(w1, w2, w3, times): how often w3 follows the pair in the bodies' tokens; a generator's table."""
    t = sections.select(tokens(F.col("body")).alias("t")).filter(F.size("t") >= 3)
    at = F.explode(F.sequence(F.lit(1), F.size("t") - 2))
    run = F.array_join(F.slice("t", F.col("i"), 3), " ")  # tokens have no spaces: one short key instead of three padded ones
    w = F.split("run", " ")
    return t.select("t", at.alias("i")).select(run.alias("run")).groupBy("run").agg(F.count("*").alias("times")).select(*[F.get(w, F.lit(i)).alias(f"w{i + 1}") for i in range(3)], "times")


#: Words of a phrase that stand for others; fixed values.
SYNONYMS = {"left": "port", "right": "starboard", "stbd": "starboard"}


def _swapped(a: Column, b: Column) -> Column:
    """Whether two adjacent letters of a, exchanged, give b."""
    at = F.sequence(F.lit(1), F.length(a) - 1)
    return (F.length(a) == F.length(b)) & F.exists(at, lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b)


def resolve(phrase: str, columns: DataFrame, k: int = 5) -> DataFrame:
    """(path, score): columns(path, description, unit) ranked for a phrase: BM25-like rarity of shared words, synonyms applied, one-edit typos of unknown words of four letters or more repaired if only one word is that close."""
    words = columns.select("path", F.explode(F.array_distinct(tokens(F.concat_ws(" ", F.regexp_replace("path", "([a-z])([A-Z])", "$1 $2"), F.coalesce("description", F.lit("")), F.coalesce("unit", F.lit("")))))).alias("term")).distinct()
    spark, n = columns.sparkSession, columns.count()
    asked = spark.createDataFrame([(SYNONYMS.get(w, w),) for w in dict.fromkeys(phrase.lower().split())] or [("",)], "asked string")
    vocab = words.select("term").distinct()
    near = asked.join(vocab, asked.asked == vocab.term, "left_anti").filter(F.length("asked") >= 4).join(vocab, (F.levenshtein("asked", "term") <= 1) | _swapped(F.col("asked"), F.col("term")))  # a few words of a phrase
    fixed = near.groupBy("asked").agg(F.min("term").alias("term"), F.count("*").alias("c")).filter("c = 1").select("term")
    terms = asked.join(vocab, asked.asked == vocab.term).select("term").unionByName(fixed).distinct()
    df = words.groupBy("term").agg(F.log(1 + (F.lit(float(n)) - F.count("*") + 0.5) / (F.count("*") + 0.5)).alias("idf"))
    return words.join(terms, "term").join(df, "term").groupBy("path").agg(F.sum("idf").alias("score")).orderBy(F.desc("score"), "path").limit(k)
