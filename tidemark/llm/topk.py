"""Exact top-k inner-product search over a pivot-distance index (operator 1).

A vector v gets one more coordinate, sqrt(M^2 - |v|^2) with M the largest norm, and a query q a zero: then
|q - v|^2 = |q|^2 + M^2 - 2 q.v, so the largest products are the smallest distances and the triangle inequality holds.
Vectors are keyed by nearest pivot and by their annulus (distance to it). A query looks into its own annulus first; the
k-th score found there bounds what can still win, and of the other annuli only those within reach of that bound are
searched, and in them only the rows whose distance to the pivot lies within it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, stored

#: Vectors of the sample from which pivots are chosen, pivots, annuli of a pivot (at least and at most, one for each BLOCK vectors
#: between), vectors of a block of an annulus, queries of a block.
SAMPLE, PIVOTS, RINGS, MOST_RINGS, BLOCK, QUERIES = 4096, 32, 8, 1024, 4096, 2048
_EXACT32, _EXACT64 = 1 << 24, 1 << 53


def _rows(table, column: str, dim: int) -> np.ndarray:
    """Packed vectors of a batch or table as 64-bit integers; their width follows from the bytes."""
    raw = table.column(column).to_pylist()
    width = len(raw[0]) // dim if raw else 8
    return np.frombuffer(b"".join(raw), f"<i{width}").astype(np.int64).reshape(-1, dim)


def _largest(x: np.ndarray) -> np.ndarray:
    """Each row's largest magnitude, as a double (integers' own magnitude can leave their range)."""
    return np.abs(x.astype(np.float64)).max(1, initial=0)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in floats where every partial sum is exact, else in integers of any size, held to 64 bits."""
    a, b = _largest(q) * max(1, q.shape[1]), _largest(v)
    top = a.max(initial=0) * b.max(initial=0)
    if top < _EXACT32:
        return (q.astype(np.float32) @ v.astype(np.float32).T).astype(np.int64)
    if top < _EXACT64:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    if top < 1 << 62:
        return q @ v.T
    if len(q) * len(v) > 1:  # only the rows that are that long need wide integers
        for wide, other in ((a, b), (b, a)):
            long = wide * np.median(other) >= 1 << 62
            if 0 < long.sum() < len(wide):
                out = np.empty((len(q), len(v)), np.int64)
                for rows in (np.flatnonzero(long), np.flatnonzero(~long)):
                    at = (rows, slice(None)) if wide is a else (slice(None), rows)
                    out[at] = products(q[rows], v) if wide is a else products(q, v[rows])
                return out
    exact = q.astype(object) @ v.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def integer_vectors(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as a long array (held to 64 bits), a row for each row that takes part.

    Rows with a null id, a null vector, or a null or non-finite component take no part. Empty vectors and rows that repeat
    a vec_id do.
    """
    scaled = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(-9.3e18), F.least(F.lit(9.3e18), x.cast("double") * scale))))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def _pack(dim: int, width: int):
    """Rows (row, vec_id, v) to (row, vec_id, x): components as integers of `width` bytes, shorter vectors filled up with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            size = np.diff(v.offsets.to_numpy())
            x = np.zeros((len(v), dim), f"<i{width}")
            x[np.arange(dim) < size[:, None]] = v.flatten().to_numpy()
            raw = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), raw], ["row", "vec_id", "x"])

    return run


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Far-first traversal of the sample, then a few rounds of means."""
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    pivots = sample[chosen].copy()
    for _ in range(5):
        own = _distances(sample, pivots).argmin(1)
        for j in range(len(pivots)):
            if (own == j).any():
                pivots[j] = sample[own == j].mean(0)
    return pivots


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d2, 0))


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    norms = (x.astype(np.float64) ** 2).sum(1)
    return np.column_stack((x.astype(np.float64), np.sqrt(np.maximum(top - norms, 0))))


def _slack(top: float, dim: int) -> float:
    """More than rounding can change in the difference of two distances: their squares are of the order of `top`."""
    return 2e-7 * float(np.sqrt((dim + 16) * top)) + 1e-6


def _keyed(pivots, top: float, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_lift(_rows(batch, "x", dim), top), pivots.value)
            own = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(own)), own]), batch.column("x")], ["row", "vec_id", "pivot", "far", "x"])

    return run


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by score, then smaller id."""
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(ids))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _first_look(every: int, k: int, dim: int):
    """Queries among the rows of a block against that block: k-th score found (null if there are fewer)."""

    def run(t: pa.Table) -> pa.Table:
        ids = t.column("vec_id").to_numpy()
        x = _rows(t, "x", dim)
        at = np.flatnonzero(ids % every == 0)
        low = []
        for part in np.array_split(at, max(1, len(at) // 256 + 1)):
            s = products(x[part], x)
            for row, i in zip(s, part, strict=True):
                others = np.delete(row, i)
                low.append(int(np.partition(others, len(others) - k)[len(others) - k]) if len(others) >= k else None)
        take = pa.array(at)
        return pa.table({"cell": t.column("cell").take(take), "query": t.column("row").take(take), "query_id": pa.array(ids[at], pa.int64()), "x": t.column("x").take(take), "low": pa.array(low, pa.int64())})

    return run


def _bounds(t: pa.Table, pivots, top: float, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of queries: vectors, distances to the pivots, how far a vector as good as the bound can lie, the bound."""
    q = _rows(t, "x", dim)
    wide = q.astype(np.float64)
    d = _distances(np.column_stack((wide, np.zeros(len(q)))), pivots.value)
    low = np.array([-(1 << 63) if v is None else v for v in t.column("low").to_pylist()], np.int64)
    bound = np.where(low == -(1 << 63), -np.inf, low.astype(np.float64))  # scores that low may be cut off
    radius = np.sqrt(np.maximum((wide**2).sum(1) + top - 2 * bound, 0)) * (1 + 1e-9) + _slack(top, dim)
    return q, d, radius, low


def _reach(pivots, cells, top: float, dim: int):
    """The blocks of the annuli that can hold a vector as good as the bound of any query of a deal."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        pivot, near, far, blocks = cells.value
        _, d, radius, _ = _bounds(t, pivots, top, dim)
        hit = np.zeros(len(pivot), bool)
        for a, b in zip(d, radius, strict=True):
            hit |= np.maximum(a[pivot] - far, near - a[pivot]) <= b
        c = np.flatnonzero(hit)
        times = blocks[c]
        within = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        n = len(within)
        return pa.table({"deal": pa.array([key[0].as_py()] * n, pa.int32()), "cell": pa.array(np.repeat(c, times).astype(np.int32)), "block": pa.array(within.astype(np.int32))})

    return run


def _search(pivots, cells, k: int, top: float, dim: int):
    """A block of an annulus, sorted by distance to the pivot, against the queries of a deal that reaches it."""

    def run(key: tuple, queries: pa.Table, block: pa.Table) -> pa.Table:
        out_r, out_q, out_v, out_s = [], [], [], []
        if block.num_rows and queries.num_rows:
            far = block.column("far").to_numpy()
            order = np.argsort(far, kind="stable")
            far, ids, rows = far[order], block.column("vec_id").to_numpy()[order], block.column("row").to_numpy()[order]
            x = _rows(block, "x", dim)[order]
            q, d, radius, low = _bounds(queries, pivots, top, dim)
            d = d[:, cells.value[0][key[0].as_py()]]
            names, own = queries.column("query_id").to_numpy(), queries.column("query").to_numpy()
            begin, end = np.searchsorted(far, d - radius, "left"), np.searchsorted(far, d + radius, "right")
            by = np.flatnonzero(begin < end)
            by = by[np.argsort(begin[by], kind="stable")]
            for part in np.array_split(by, max(1, -(-len(by) // 256))):
                if not len(part):
                    continue
                a, b = begin[part].min(), end[part].max()
                scores = products(q[part], x[a:b])
                for row, i in zip(scores, part, strict=True):
                    at = np.flatnonzero(row >= low[i])
                    at = at[rows[a + at] != own[i]]
                    at = at[_best(row[at], ids[a + at], k)]
                    out_r.append(np.full(len(at), own[i])), out_q.append(np.full(len(at), names[i])), out_v.append(ids[a + at]), out_s.append(row[at])
        join = lambda z: pa.array(np.concatenate(z) if z else np.empty(0, np.int64), pa.int64())
        return pa.table({"query": join(out_r), "query_id": join(out_q), "vec_id": join(out_v), "score": join(out_s)})

    return run


def _dealt(counts: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(cell, first deal, deals) of (cell, queries): cells in order fill deals of at most QUERIES; one that has more is split."""
    out, deal, held = [], 0, 0
    for cell, n in counts:
        parts = -(-n // QUERIES)
        if held and (held + n > QUERIES or parts > 1):
            deal, held = deal + 1, 0
        out.append((cell, deal, parts))
        deal, held = (deal + parts, 0) if parts > 1 else (deal, held + n)
    return out


def top_k(embeddings: DataFrame, every: int = 20, k: int = 20, scale: int = 64, pivots: int = PIVOTS, rings: int = RINGS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by `every`, its k highest integer inner products with the others.

    Ties go to the smaller vec_id; fewer than k others give fewer rows; an empty table gives none. Missing components of
    shorter (or empty) vectors count as 0. Rows that repeat a vec_id are candidates each, and queries each, also for one
    another. Scores are held to 64 bits. Pivots are fitted on at most SAMPLE vectors (those of the smallest hashes); every
    vector is indexed and the result is exact. What is broadcast has a bounded size: the pivots, and a row for each
    annulus, of which there are at most MOST_RINGS a pivot.
    """
    spark = embeddings.sparkSession
    vectors = stored(integer_vectors(embeddings, scale).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    largest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    n, dim, top, most = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(norm), F.max(largest)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(1, dim)
    width = next((b for b in (1, 2, 4) if (most or 0) < 1 << 8 * b - 1), 8)
    packed = vectors.mapInArrow(_pack(dim, width), "row long, vec_id long, x binary")
    sample = packed.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE).select("x").collect()
    lifted = _lift(np.frombuffer(b"".join(bytes(r.x) for r in sample), f"<i{width}").reshape(-1, dim), top)
    centres = spark.sparkContext.broadcast(choose_pivots(lifted, pivots))
    keyed = stored(packed.mapInArrow(_keyed(centres, top, dim), "row long, vec_id long, pivot int, far double, x binary"), "keyed")

    # annuli: approximate quantiles of the distances to each pivot, then exact bounds of what fell into each
    rings = min(MOST_RINGS, max(rings, -(-n // (pivots * block))))
    cuts = keyed.groupBy("pivot").agg(F.percentile_approx("far", [i / rings for i in range(1, rings)] or [0.5], max(1000, 20 * rings)).alias("cuts"))
    ringed = keyed.join(F.broadcast(cuts), "pivot").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("far"))))  # a row a pivot
    sizes = ringed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("far").alias("near"), F.max("far").alias("far")).orderBy("pivot", "ring").collect()  # pivots x MOST_RINGS rows at most
    blocks = np.array([-(-r.n // block) for r in sizes], np.int64)
    cells = spark.sparkContext.broadcast((np.array([r.pivot for r in sizes]), np.array([r.near for r in sizes]), np.array([r.far for r in sizes]), blocks))
    named = spark.createDataFrame([(r.pivot, r.ring, i, int(b)) for i, (r, b) in enumerate(zip(sizes, blocks, strict=True))], "pivot int, ring int, cell int, blocks int")
    index = stored(ringed.join(F.broadcast(named), ["pivot", "ring"]).select("cell", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), "row", "vec_id", "far", "x"), "index")

    # queries of neighbouring annuli are dealt into groups of about QUERIES; which blocks a group reaches is all that is kept, no vectors
    looked = stored(index.groupBy("cell", "block").applyInArrow(_first_look(every, k, dim), "cell int, query long, query_id long, x binary, low long"), "looked")
    counts = looked.groupBy("cell").count().orderBy("cell").collect()  # a row an annulus
    deals = spark.createDataFrame(_dealt([(r["cell"], r["count"]) for r in counts]), "cell int, first int, parts int")
    asked = looked.join(F.broadcast(deals), "cell").withColumn("deal", (F.col("first") + F.pmod(F.xxhash64("query"), "parts")).cast("int"))
    asked = stored(asked.select("deal", "query", "query_id", "x", "low"), "asked")
    reached = stored(asked.groupBy("deal").applyInArrow(_reach(centres, cells, top, dim), "deal int, cell int, block int"), "reached")
    keys = ["cell", "block", "deal"]
    left, right = asked.join(reached, "deal"), index.join(reached, ["cell", "block"])
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(centres, cells, k, top, dim), "query long, query_id long, vec_id long, score long")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    out = stored(found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "topk")
    discard(vectors, keyed, index, looked, asked, reached)
    return out
