"""N-gram Jaccard join by parity sketches (operator 9).

Each document is the set of its distinct word shingles, as 64-bit hashes. Two sets of a and b shingles with Jaccard
similarity of at least p/q differ in at most D = (a + b)(q - p) div (q + p) shingles. A band of sizes fixes a number of
parts P > D; the shingles of a part are XORed into its 64-bit word. Of P > D parts at least one holds no differing
shingle, so documents that agree in the word of a part are candidates. A second sketch, in which every shingle toggles
one of at least twice as many bits, has a Hamming distance of at most the symmetric difference; it and then the shingles
verify them. Sketches are powers of two long, so the longer of two is folded to the length of the shorter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, free_names, lean, small_side, space_words, stored
from tidemark.llm.graph import connected_components

#: Shingles for each 64 bits of the sketch that is compared before shingles are, at most; the least length in longs.
SKETCH_LOAD, SKETCH_LEAST = 32, 4
#: Documents of the sample in which frequent shingles are looked for, occurrences that make one, bits of their table.
FREQUENT_SAMPLE, FREQUENT_TIMES, FREQUENT_BITS = 20_000, 3, 24
#: Signatures in a bucket up to which each is paired with each (a constant factor); larger buckets go by a star and by chunks.
FEW = 16
#: Members of a large bucket that one task compares with as many others; pairs of one document that are verified together.
CHUNK, BLOCK = 512, 256
#: Documents of that sample that make a bucket hot (a thousandth); documents for each part that hot buckets are dealt into.
HOT_TIMES, HOT_ROWS = 20, 50_000
#: Signatures that a task remembers, to give the keys of a copy once.
SEEN = 200_000
_WORDS_KEPT = 300_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word n-grams as sorted arrays of 64-bit hashes; keeps hashes of frequent words between documents."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = space_words(text)
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < self.n:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
        known = self.known
        if len(known) > _WORDS_KEPT:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = len(h) - self.n + 1
        s = h[:k].copy()
        for i in range(1, self.n):
            s = _mix(s * _M1 + h[i : i + k])
        s = _mix(s)
        s.sort()
        return s[np.concatenate(([True], s[1:] != s[:-1]))]


def _signature(shingles: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


class Bands:
    """Size bands; for each the number of parts P = D + 1 + E, and the keys of a set.

    P = D + m + E: linked sets agree in m + E parts at least. A part without shingles says nothing; if either set has at
    most E of them, they agree in m parts with shingles. A set with more empty parts also emits keys under the next seed,
    and so does any partner that it could miss. What is left after the last seed (a chance of about 1e-6) emits its empty
    parts. Keys carry the logarithm of m in four bits: pairs that share fewer than m keys are no candidates.

    Under the first seeds shingles that are frequent in a sample don't count: that takes nothing from the bound (the
    difference of two subsets chosen by a rule for single shingles is no larger), and passages that many documents share
    make no candidates. The sample changes the work, never the result.
    """

    RARE_SEEDS, SEEDS, RARE_SHARE = 3, 8, 0.95

    def __init__(self, p: int, q: int):
        assert 0 < p <= q
        self.p, self.q, self.ratio, self.made = p, q, max(1.5, 1.02 * q / p), {}

    def most_apart(self, a: int, b: int) -> int:
        return (a + b) * (self.q - self.p) // (self.q + self.p)

    def of(self, n: int) -> int:
        k = int(math.log(n) / math.log(self.ratio))
        while self.start(k + 1) <= n:
            k += 1
        while self.start(k) > n:
            k -= 1
        return k

    def start(self, k: int) -> int:
        """Least size of band k; bands of small sizes can be empty."""
        return math.ceil(self.ratio**k)

    def homes(self, n: int) -> list[int]:
        """The band of the size, and the next one up if partners can be there."""
        most = n * self.q // self.p
        if self.most_apart(n, most) == 0:
            return []  # only equal sets are that similar
        return list(range(self.of(n), self.of(most) + 1))

    def plan(self, k: int, rare: bool) -> tuple[int, int, int]:
        """Parts, allowed empty parts and m, at the least expected number of keys."""
        if (k, rare) not in self.made:
            low, high = max(1, self.start(k) * self.p // self.q), max(1, self.start(k + 1) - 1)
            low = low * self.RARE_SHARE if rare else low
            d, best = self.most_apart(high, high), None
            m = 1 if d < 8 else 1 << max(1, int(math.log2(d / 12)))  # a power of two, about a twelfth of D
            for e in range(0, d // 2 + 12):
                parts = d + m + e
                mean = parts * math.exp(-low / parts)
                term = total = math.exp(-mean)
                for i in range(1, e + 1):
                    term *= mean / i
                    total += term
                if best is None or parts / max(total, 1e-9) < best[0]:
                    best = parts / max(total, 1e-9), parts, e, m
            self.made[k, rare] = best[1:]
        return self.made[k, rare]

    def keys(self, s: np.ndarray, frequent: np.ndarray | None = None) -> np.ndarray:
        out, rare = [], s if frequent is None else s[~frequent[s >> np.uint64(64 - FREQUENT_BITS)]]
        for k in self.homes(len(s)):
            for seed in range(self.SEEDS):
                x = rare if seed < self.RARE_SEEDS else s
                parts, spare, m = self.plan(k, seed < self.RARE_SEEDS)
                spread = _mix(x ^ np.uint64((k << 8 | seed) * 0x5851F42D4C957F2D & (1 << 64) - 1)) >> np.uint64(32)
                part = (spread * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                word = np.zeros(parts, np.uint64)
                np.bitwise_xor.at(word, part, x)
                count = np.bincount(part, minlength=parts).astype(np.uint64)
                full = np.flatnonzero(count)
                key = _mix(_mix(word[full] + _mix(full.astype(np.uint64) + np.uint64(k << 40 | seed << 32))) + count[full] * _M1)
                out.append(key & ~np.uint64(15) | np.uint64(m.bit_length() - 1))
                if parts - len(full) <= spare:
                    break
            else:
                out.append(_mix(np.flatnonzero(count == 0).astype(np.uint64) + np.uint64(k << 40 | 0xFF << 32)) & ~np.uint64(15))
        return np.unique(np.concatenate(out)).view(np.int64) if out else np.empty(0, np.int64)


def _sketch(s: np.ndarray) -> np.ndarray:
    """The parity sketch: Hamming distances are at most symmetric differences."""
    bits = 64 * max(SKETCH_LEAST, 1 << max(0, (len(s) - 1) // SKETCH_LOAD).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(sketch: np.ndarray, longs: int) -> np.ndarray:
    """Sketches (rows) of the same sets in fewer bits."""
    while sketch.shape[1] > longs:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def _level(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of sketches as rows of the shortest one's length."""
    raw = column.to_pylist()
    longs = np.array([len(x) // 8 for x in raw])
    out = np.empty((len(raw), longs.min(initial=1 << 40) if len(raw) else 1), np.uint64)
    for n in np.unique(longs):
        at = np.flatnonzero(longs == n)
        out[at] = _folded(np.frombuffer(b"".join(raw[i] for i in at), np.uint64).reshape(len(at), n), out.shape[1])
    return out


def _texts(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column("text").to_pylist()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64), pa.int64()))


def _index(ngram: int, p: int, q: int, frequent):
    """Signatures and keys of each text; copies that a task has met lately are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, bands, seen = Shingler(ngram), Bands(p, q), set()
        often = np.unpackbits(np.frombuffer(frequent.value, np.uint8)).view(bool)
        for batch in batches:
            ids, keys = [], []
            for text in _texts(batch):
                if len(s := shingle(text)) and (sig := _signature(s)[0]) not in seen:
                    ids.append(sig)
                    keys.append(bands.keys(s, often))
                    seen.add(sig)
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(keys)], ["sig", "keys"])

    return run


def _places(ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(ngram)
        for batch in batches:
            for text in _texts(batch):
                s = shingle(text) >> np.uint64(64 - FREQUENT_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32))], ["place"])

    return run


def _sample(docs: DataFrame, n: int) -> DataFrame:
    """At most about FREQUENT_SAMPLE of n documents."""
    return docs if n <= FREQUENT_SAMPLE else docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) < FREQUENT_SAMPLE)


def _frequent(sample: DataFrame, ngram: int) -> bytes:
    """A bit for each place of the table: whether shingles there are frequent in the sample."""
    often = sample.select("text").mapInArrow(lean(_places(ngram)), "place int").groupBy("place").count().filter(F.col("count") >= FREQUENT_TIMES).select("place")
    bits = np.zeros(1 << FREQUENT_BITS, np.uint8)
    bits[often.toPandas()["place"].to_numpy(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _slim(ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(ngram)
        for batch in batches:
            sets = [shingle(text) for text in _texts(batch)]
            marks = [_signature(s) if len(s) else (None, None) for s in sets]
            own = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, own), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in marks], pa.int64()), pa.array([b for _, b in marks], pa.int64())],
                [*own, "n_shingles", "sig", "sig2"],
            )

    return run


def _sets(ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(ngram)
        for batch in batches:
            sets = [s for text in _texts(batch) if len(s := shingle(text))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_signature(s)[0] for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_sketch(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["sig", "n_shingles", "sketch", "shingles"],
            )

    return run


def _similar(s: np.ndarray, t: np.ndarray, p: int, q: int) -> bool:
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    both = int((t[at] == s).sum())
    return q * both >= p * (len(s) + len(t) - both)


def _within_reach(p: int, q: int):
    """Pairs whose sketches don't rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()) * (q - p) // (q + p)
            raw, keep = [batch.column(c) for c in ("sketch_a", "sketch_b")], np.zeros(batch.num_rows, bool)
            least = np.minimum(*(pc.binary_length(c).to_numpy() for c in raw))
            for n in np.unique(least):
                at = np.flatnonzero(least == n)
                x, y = (_folded(_level(c.take(pa.array(at))), n // 8) for c in raw)
                keep[at] = np.bitwise_count(x ^ y).sum(1) <= most[at]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(p: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (batch.column(c) for c in ("shingles_a", "shingles_b"))
            keep = [_similar(np.frombuffer(u.as_buffer(), np.uint64), np.frombuffer(v.as_buffer(), np.uint64), p, q) for u, v in zip(*sides, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs(a, b) that link: by sizes, by sketches, then by shingles, which move for the pairs that are left only.

    An a of many pairs is dealt into blocks, and its shingles move once a block, not once a pair.
    """
    side = lambda end: sets.select(F.col("sig").alias(end), F.col("n_shingles").alias(f"n_{end}"), F.col("sketch").alias(f"sketch_{end}"))
    close = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.col("n_a") * p <= F.col("n_b") * q).filter(F.col("n_b") * p <= F.col("n_a") * q)
    near = stored(close.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(lean(_within_reach(p, q)), "a long, b long").distinct(), "close")
    busy = stored(near.groupBy("a").count().filter(F.col("count") > BLOCK).select("a", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "busy")
    near = near.join(small_side(busy), "a", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    firsts = near.select("a", "blocks").distinct().select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    shingles = lambda end: sets.select(F.col("sig").alias(end), F.col("shingles").alias(f"shingles_{end}"))
    left = shingles("a").join(firsts, "a")
    right = shingles("b").join(near.select("a", "b", "block"), "b")
    out = stored(right.join(left, ["a", "block"]).select("a", "b", "shingles_a", "shingles_b").mapInArrow(lean(_verify(p, q)), "a long, b long").distinct(), "links")
    discard(busy)
    return out


def _reach(t: pa.Table, left: int, right: int, p: int, q: int) -> tuple[np.ndarray, ...]:
    """Places i and j of rows in two chunks of a bucket, and their sketches' distance: pairs of different components that the sketches don't rule out."""
    sig, root, size, chunk = (t.column(c).to_numpy() for c in ("sig", "root", "n_shingles", "chunk"))
    order = np.argsort(sig, kind="stable")
    sketch, others, found = _level(t.column("sketch")), order[chunk[order] == right], [np.empty((3, 0), np.int64)]
    for i in order[chunk[order] == left]:
        rest = others if left != right else others[sig[others] > sig[i]]
        rest = rest[root[rest] != root[i]]
        rest = rest[(q * np.minimum(size[rest], size[i]) >= p * np.maximum(size[rest], size[i]))]
        apart = np.bitwise_count(sketch[rest] ^ sketch[i]).sum(1).astype(np.int64)
        ok = apart <= (size[rest] + size[i]) * (q - p) // (q + p)
        found.append(np.stack([np.full(ok.sum(), i), rest[ok], apart[ok]]))
    return tuple(np.concatenate(found, axis=1))


_OPEN = "bucket long, i int, j int, sig long, root long, chunk int"


def _near(p: int, q: int):
    """Within two chunks of a bucket: the members that the sketches leave a partner in another component."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        _, left, right = (k.as_py() for k in key)
        a, b, _ = _reach(t, left, right, p, q)
        return t.select(["bucket", "i", "j", "sig", "root", "chunk"]).take(pa.array(np.union1d(a, b)))

    return run


def _forest(p: int, q: int):
    """Within two chunks of a bucket: links that join components, the closest pairs first. Pairs that the links so far join aren't verified; every other one is."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        _, left, right = (k.as_py() for k in key)
        a, b, apart = _reach(t, left, right, p, q)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in t.column("shingles").chunks for x in c]
        sig, above = t.column("sig").to_numpy(), np.unique(t.column("root").to_numpy(), return_inverse=True)[1]
        parent = list(range(len(sig)))

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        links = []
        for k in np.argsort(apart, kind="stable"):
            x, y = top(int(above[a[k]])), top(int(above[b[k]]))
            if x != y and _similar(sets[a[k]], sets[b[k]], p, q):
                parent[x] = y
                links.append(k)
        return pa.table({"a": pa.array(sig[a[links]] if links else [], pa.int64()), "b": pa.array(sig[b[links]] if links else [], pa.int64())})

    return run


def _chunk_pairs(members: DataFrame) -> DataFrame:
    """members(bucket, sig, root): each row once for each pair of chunks that holds it, with chunk, i and j.

    Chunks are dealt by hash. Members of a bucket's largest component have chunks of their own (from 0 up; the others from
    -1 down), which meet the others' chunks, not each other: a straggler costs a pass over the bucket, not its square.
    """
    parts = stored(members.groupBy("bucket", "root").agg(F.count("*").alias("n")), "parts")
    sizes = stored(parts.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n")).select("bucket", "main", F.ceil(F.col("most") / CHUNK).cast("int").alias("mains"), F.ceil((F.col("n") - F.col("most")) / CHUNK).cast("int").alias("rests")).filter("rests > 0"), "sizes")
    dealt = members.join(small_side(sizes), "bucket").withColumn("h", F.xxhash64("sig"))
    dealt = dealt.withColumn("chunk", F.when(F.col("root") == F.col("main"), F.pmod("h", "mains")).otherwise(-1 - F.pmod("h", "rests")).cast("int"))
    rests = F.sequence(-F.col("rests"), F.lit(-1))
    partners = F.when(F.col("chunk") >= 0, rests).otherwise(F.concat(rests, F.sequence(F.lit(0), F.col("mains") - 1)))
    pairs = F.transform(partners, lambda c: F.struct(F.least("chunk", c).alias("i"), F.greatest("chunk", c).alias("j")))
    return dealt.select("bucket", "sig", "root", "chunk", F.explode(pairs).alias("pair")).select("bucket", "sig", "root", "chunk", "pair.i", "pair.j")


def jaccard_components(documents: DataFrame, ngram: int = 5, p: int = 80, q: int = 100, marks: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, sig) for each row of documents(doc_id, text); links join texts of Jaccard >= p/q.

    component_id is the smallest doc_id that links reach. Null or wordless texts have no shingles, link with nothing and
    are their own component. A row with a null doc_id counts as a copy in its group; alone, its component is null. Rows
    that repeat a doc_id keep their own rows. Equal sets form one class (a 128-bit hash of the set), so copies are never
    paired with each other; all links between classes are found, and only a spanning forest of them is kept. With marks
    there are also group, a signature that the rows of a component share (null without shingles), and mark, a hash of the text.
    """
    spark, docs = documents.sparkSession, documents.select("doc_id", "text")

    # 1. Pigeonhole join: signatures that share a bucket, and so the word of a part. Small buckets count shared keys;
    # in large ones the least signature is a candidate for each other. Buckets that are hot in the sample are dealt out.
    n = docs.count()
    frequent = spark.sparkContext.broadcast(_frequent(_sample(docs, n), ngram))
    keyed = lambda d: d.select("text").mapInArrow(lean(_index(ngram, p, q, frequent)), "sig long, keys array<long>").select("sig", F.explode("keys").alias("bucket"))
    hot = stored(keyed(_sample(docs, n)).groupBy("bucket").count().filter(F.col("count") >= HOT_TIMES).select("bucket", F.lit(True).alias("hot")), "hot")
    part = F.when(F.col("hot"), 1 + F.pmod("sig", F.lit(2 + n // HOT_ROWS))).otherwise(0).cast("int")
    index = keyed(docs).join(F.broadcast(hot), "bucket", "left").select("bucket", "sig", part.alias("part"))  # at most FREQUENT_SAMPLE documents' keys over HOT_TIMES
    w = Window.partitionBy("bucket", "part").orderBy("sig")
    ranked = index.select("bucket", "sig", "part", F.lag("sig").over(w).alias("before"), F.first("sig").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("leader"), F.dense_rank().over(w).alias("rank"))
    ranked = ranked.filter("(before IS NULL OR sig != before) AND (sig != leader OR part > 0)")
    members = stored(ranked.select("bucket", "leader", "sig", "rank", "part"), "members")
    cold = members.filter("part = 0")
    per = cold.groupBy("bucket").agg(F.first("leader").alias("leader"), F.max("rank").alias("m"), F.collect_list(F.when(F.col("rank") <= FEW, F.col("sig"))).alias("few"), F.min("sig").alias("least"), F.bit_xor(F.xxhash64("sig")).alias("mark"))
    small = per.filter(F.col("m") <= FEW).select(F.expr("shiftleft(1, CAST(bucket & 15 AS INT))").alias("need"), F.array_sort(F.concat(F.array("leader"), "few")).alias("few"))
    pairs = small.select("need", "few", F.posexplode("few").alias("at", "a")).select("need", "a", F.explode(F.slice("few", F.col("at") + 2, F.lit(FEW))).alias("b"))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("need").alias("need")).filter("shared >= need").select("a", "b")
    warm = members.filter("part > 0").groupBy("bucket").agg(F.min("sig").alias("leader"), F.count("*").alias("m"), F.min("sig").alias("least"), F.bit_xor(F.xxhash64("sig")).alias("mark")).filter("m > 1")
    large = per.filter(F.col("m") > FEW).select("bucket", "leader", "m", "least", "mark").unionByName(warm)
    large = stored(large.groupBy("leader", "m", "least", "mark").agg(F.min("bucket").alias("bucket")), "large")  # buckets of the same members once
    crowd = stored(members.select("bucket", "sig").join(small_side(large.select("bucket", "leader")), "bucket").filter("sig != leader"), "crowd")
    stars = stored(pairs.unionAll(crowd.select(F.col("leader").alias("a"), F.col("sig").alias("b"))).distinct(), "stars")

    # 2. A slim row for every document, and the shingles of one document for each signature of a candidate.
    extra_columns = ["group", "mark"] if marks else []
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text") if marks else docs
    rows = stored(marked.mapInArrow(lean(_slim(ngram)), f"doc_id long, {'mark long, ' if marks else ''}n_shingles long, sig long, sig2 long"), "rows")
    wanted = stored(stars.select("a").unionAll(stars.select("b")).distinct().toDF("sig"), "wanted")
    chosen_ids = stored(rows.join(wanted, "sig", "left_semi").groupBy("sig").agg(F.min("doc_id").alias("doc_id")).select("doc_id").filter("doc_id is not null").distinct(), "chosen")
    shingled = lambda d: d.select("text").mapInArrow(lean(_sets(ngram)), "sig long, n_shingles long, sketch binary, shingles binary").join(small_side(wanted), "sig", "left_semi")
    sets = shingled(docs.join(small_side(chosen_ids), "doc_id", "left_semi"))
    if docs.filter("doc_id is null").limit(1).count():  # rows that can't be picked by id
        sets = sets.unionAll(shingled(docs.filter("doc_id is null")).dropDuplicates(["sig"]))
    sets = stored(sets, "sets")

    # 3. Verify one candidate of each signature, that of the least signature; then those that still lie apart.
    first = stored(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    links = _linked(first, sets, p, q)
    root = stored(connected_components(links), "roots")
    at = lambda end: root.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))  # noqa: E731  (the latest roots)
    apart = stars.join(first, ["a", "b"], "left_anti").join(at("a"), "a", "left").join(at("b"), "b", "left")
    apart = apart.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    links = stored(links.unionAll(_linked(stored(apart, "apart"), sets, p, q)), "links")
    root = stored(connected_components(links), "roots")

    # 4. Large buckets whose members still lie in more than one component: compare across components, in chunks. Pairs in
    # reach of the sketches are verified where they meet, so they are never rows: first the members that have any, then
    # their shingles come, and links that join components leave.
    slim = sets.select("sig", "n_shingles", "sketch")
    everyone = stored(crowd.select("bucket", "sig").unionAll(large.select("bucket", F.col("leader").alias("sig"))), "everyone")
    rooted = everyone.join(root, everyone.sig == root.node, "left").select("bucket", "sig", F.coalesce("root", "sig").alias("root"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("bucket")
    open_ = stored(rooted.join(small_side(stored(mixed, "mixed")), "bucket"), "open")
    if open_.limit(1).count():
        near = stored(_chunk_pairs(open_).join(slim, "sig").groupBy("bucket", "i", "j").applyInArrow(_near(p, q), _OPEN), "near")
        extra = stored(near.join(sets, "sig").groupBy("bucket", "i", "j").applyInArrow(_forest(p, q), "a long, b long").distinct(), "joins")
        if extra.limit(1).count():
            root = stored(connected_components(links.unionAll(extra)), "roots")

    # 5. Classes of equal sets, and the least doc_id of all classes that a component holds.
    classes = rows.filter("sig is not null").groupBy("sig", "sig2").agg(F.min("doc_id").alias("least"))
    classes = classes.join(root, classes.sig == root.node, "left").select("sig", "sig2", "least", F.coalesce("root", "sig").alias("group"))
    tops = classes.groupBy("group").agg(F.min("least").alias("component_id"))
    named = classes.join(tops, "group").select("sig", "sig2", "component_id", *extra_columns[:1])
    out = stored(
        rows.filter("sig is not null").join(named, ["sig", "sig2"]).select("doc_id", "n_shingles", "component_id", "sig", *extra_columns).unionAll(rows.filter("sig is null").withColumn("group", F.col("sig")).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "sig", *extra_columns)),
        "components",
    )
    discard(hot, members, large, crowd, stars, first, wanted, chosen_ids, rows, sets, everyone, open_, links, root)
    return out


def keep_one(documents: DataFrame, ngram: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """documents without those that link, directly or not, to a document of smaller doc_id; all columns stay as they are.

    What goes is a (doc_id, text), not all rows of a doc_id. Of rows of one doc_id that link to each other one stays, and of
    rows that repeat both doc_id and text. Rows with a null doc_id count as rows of one id: of those that link one stays,
    also beside the document that stays by its doc_id, as a null is neither smaller nor larger.
    """
    doc, mark, group, least, of = free_names(documents, "__doc", "__mark", "__group", "__least", "__of")
    key = lambda df, of_text: [F.coalesce(df["doc_id"].cast("long"), F.lit(-(1 << 62))).alias(doc), of_text.alias(mark)]
    found = jaccard_components(documents, ngram, p, q, marks=True)
    found = found.select(*key(found, found["mark"]), "group", F.coalesce(F.col("doc_id") != F.col("component_id"), F.lit(False)).alias("linked"))
    gone, left = found.filter("linked").select(doc, mark), found.filter("not linked").select(doc, mark, F.col("group").alias(group))
    # Ids with more than one row in a group, or without one: few. There the least mark of a group stays.
    several = stored(left.groupBy(doc, group).agg(F.min(mark).alias(least), F.count("*").alias("n")).filter("n > 1").select(doc, F.col(group).alias(of), least), "several")
    if several.limit(1).count():
        both = left.join(small_side(several), (left[doc] == several[doc]) & left[group].eqNullSafe(several[of])).select(left[doc], mark, (F.col(group).isNull() | (F.col(mark) == F.col(least))).alias("stays"))
        both = stored(both.groupBy(doc, mark, "stays").count(), "both")
        gone = gone.unionAll(both.filter("not stays").select(doc, mark))
        again = stored(both.filter("stays and count > 1").select(doc, mark), "again")
    gone = stored(gone.distinct(), "gone")
    kept = documents.select("*", *key(documents, F.xxhash64(documents["text"]))).join(small_side(gone), [doc, mark], "left_anti")
    if several.limit(1).count() and again.limit(1).count():
        again = small_side(again)
        kept = kept.join(again, [doc, mark], "left_anti").unionByName(kept.join(again, [doc, mark], "left_semi").dropDuplicates([doc, mark]))
    return kept.drop(doc, mark)
