"""Best-fit packing with bound-certified repacking (operator 8).

Pieces of at most `capacity` tokens are dealt to cells of bounded size; every cell is packed by best fit decreasing. A
lower bound from dual feasible functions certifies cells whose bin count is the least possible; they keep all bins but the
emptiest. The other cells exchange their pieces: these are dealt to fewer, larger cells (still of bounded size) and packed
again, round after round, until nothing is open or a round wins nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean, stored
from tidemark.llm.tokens import encoder, ended

#: Pieces of a cell on average (a cell's arrays take a few MB), and how many times that once cells exchange them.
CELL, POOL = 50_000, 8
#: Rounds at most.
ROUNDS = 12


def _pieces(vocabulary: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                rows = []
                flat, bounds = ended(*encode(batch.column("text")), end_id)
                for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                    ids = flat[bounds[i] : bounds[i + 1]]
                    for k in range(0, len(ids), capacity):
                        part = ids[k : k + capacity]
                        rows.append((doc_id, k // capacity, k, len(part), zlib.crc32(part.tobytes())))
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i != 1 else pa.int32()) for i, c in enumerate(columns)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece. Bins are kept by free room (a list for each room), so that a piece costs a short search."""
    order = np.argsort(-lengths, kind="stable")
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0  # bit r is set if a bin with room r is open
    out, bins = np.empty(len(lengths), np.int64), 0
    for i in order:
        n = int(lengths[i])
        fit = filled >> n
        if fit:
            room = n + ((fit & -fit).bit_length() - 1)
            b = rooms[room].pop()
            if not rooms[room]:
                filled &= ~(1 << room)
        else:
            room, b, bins = capacity, bins, bins + 1
        out[i] = b
        if room > n:
            rooms[room - n].append(b)
            filled |= 1 << (room - n)
    return out


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest of several dual feasible functions' sums: volume, the rounding family u^(k), and the threshold family f^(t)."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    size = np.flatnonzero(count)
    count = count[size]
    best = -(-int((size * count).sum()) // capacity)
    for k in range(1, 21):
        scaled = (k + 1) * size
        exact = scaled % capacity == 0
        total = int((np.where(exact, size * k, scaled // capacity * capacity) * count).sum())  # in units of 1 / (k * capacity)
        best = max(best, -(-total // (k * capacity)))
    for t in np.unique(np.concatenate((size[size <= capacity // 2], [1]))):
        value = np.where(size > capacity - t, capacity, np.where(size < t, 0, size))
        best = max(best, -(-int((value * count).sum()) // capacity))
    return best


def _pack(capacity: int):
    def run(t: pa.Table) -> pa.Table:
        length = t.column("length").to_numpy()
        key = np.lexsort((t.column("piece").to_numpy(), t.column("row").to_numpy(), -length))
        t, length = t.take(pa.array(key)), length[key]
        b = best_fit_decreasing(length, capacity)
        n = int(b.max(initial=-1)) + 1
        gap = n > lower_bound(length, capacity)
        used = np.bincount(b, weights=length, minlength=n)
        # a certified cell still gives up its emptiest bin, so that what cells lose by rounding comes together
        open_ = np.full(len(b), gap) | ((b == used.argmin()) & (used.min() < capacity)) if n else np.zeros(0, bool)
        # the place in a bin: pieces of a bin follow one another in the order of the table
        by = np.argsort(b, kind="stable")
        before = np.cumsum(length[by]) - length[by]
        first = np.concatenate(([True], b[by][1:] != b[by][:-1])) if len(by) else np.empty(0, bool)
        base = np.maximum.accumulate(np.where(first, before, 0)) if len(by) else before
        offset = np.empty(len(b), np.int64)
        offset[by] = before - base
        return t.append_column("bin", pa.array(b)).append_column("offset", pa.array(offset)).append_column("open", pa.array(open_))

    return run


_FIELDS = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def piece_table(documents: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents' ids and the end id, cut only where longer than capacity."""
    return documents.select("doc_id", "text").mapInArrow(lean(_pieces(vocabulary, end_id, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int, cell: int = CELL, pool: int = POOL, rounds: int = ROUNDS) -> DataFrame:
    """pieces with sequence_id and offset: each sequence holds at most capacity tokens, gapless from 0.

    Full pieces are sequences of their own. Each row is packed, whatever its doc_id (null or repeated); pieces of length
    above capacity are an error. An empty table gives an empty one. Cells hold about `cell` pieces, dealt by a hash of
    the row, so no document, length or copy makes a large one. Each round is written to the shared folder.
    """
    rows = stored(pieces.select(F.monotonically_increasing_id().alias("row"), "doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
    full = rows.filter(F.col("length") >= capacity).select("*", F.lit(0).alias("offset"), F.lit(0).alias("round"), F.lit(0).alias("cell"), F.col("row").alias("bin"))
    loose = rows.filter(F.col("length") < capacity)
    cells = max(1, -(-loose.count() // cell))
    done, before, held = [full], None, 0
    for r in range(1, rounds + 1):
        dealt = loose.select("row", "doc_id", "piece", "start", "length", "ids_crc32", F.pmod(F.xxhash64("row", F.lit(r)), F.lit(cells)).cast("int").alias("cell"))
        packed = stored(dealt.groupBy("cell").applyInArrow(_pack(capacity), f"{_FIELDS}, cell int, bin long, offset long, open boolean"), "packed").withColumn("round", F.lit(r))
        bins, n_open, left = packed.agg(F.count_if(F.col("offset") == 0), F.count_if((F.col("offset") == 0) & F.col("open")), F.count_if(F.col("open"))).first()
        if before is not None and bins >= held:
            done.append(before.filter(F.col("open")))  # the exchange won nothing: the bins stay as they were
            break
        done.append(packed.filter(~F.col("open")))
        if not n_open or cells == 1 or r == rounds:
            done.append(packed.filter(F.col("open")))
            break
        before, held, loose = packed, n_open, packed.filter(F.col("open"))
        cells = max(1, -(-left // (cell * pool)))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "offset", "round", "cell", "bin"]
    out = done[0].select(*columns)
    for d in done[1:]:
        out = out.unionByName(d.select(*columns))
    # numbers of sequences: round and cell in the high bits, the bin (or the row of a full piece) below
    number = F.when(F.col("round") == 0, -1 - F.col("bin")).otherwise(F.shiftleft(F.col("round").cast("long"), 58) + F.shiftleft(F.col("cell").cast("long"), 26) + F.col("bin"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def packed_documents(documents: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048, **how) -> DataFrame:
    return pack(piece_table(documents, vocabulary, end_id, capacity), capacity, **how)


def sequences(packed: DataFrame) -> DataFrame:
    """The plan of each sequence, for writing training rows: its pieces in order and the tokens that it holds."""
    piece = F.struct("offset", "doc_id", "piece", "start", "length")
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.sum("length").alias("tokens"))
