"""Token ids in bit-plane files (operator 5).

A file holds blocks of ids. A block is transposed into bit planes (plane k has bit k of every id, packed to bytes) or
byte planes, each compressed with zstandard; all-zero high planes are left out. After the blocks comes the index: the
documents (id and number of ids) and, for each block, its place, its number of ids and the sizes of its planes.

    magic TDP1 | blocks | index (zstandard over JSON) | length of the index, 8 bytes little-endian | magic TDP1
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import lean, scratch_path, small_side, stored
from tidemark.llm.tokens import encoder, ended

MAGIC = b"TDP1"
BLOCK = 1 << 16


def split_planes(ids: np.ndarray, kind: str = "bit") -> list[bytes]:
    """Planes of a block of unsigned ids, lowest first, without all-zero planes at the end."""
    wide = ids.astype("<u4")
    width = max(1, int(wide.max(initial=0)).bit_length())
    raw = wide.view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range((width + 7) // 8)]
    bits = np.unpackbits(raw[:, : (width + 7) // 8], axis=1, bitorder="little")
    return [row.tobytes() for row in np.packbits(np.ascontiguousarray(bits.T[:width]), axis=1, bitorder="little")]


def join_planes(planes: list[bytes], n: int, kind: str = "bit") -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for k, p in enumerate(planes):
            out[:, k] = np.frombuffer(p, np.uint8)
    else:
        bits = np.unpackbits(np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), -1), axis=1, bitorder="little")[:, :n]
        whole = np.zeros(((len(planes) + 7) // 8 * 8, n), np.uint8)
        whole[: len(planes)] = bits
        packed = np.packbits(np.ascontiguousarray(whole.T), axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
    return out.view("<u4").ravel()


class PlaneWriter:
    def __init__(self, out, kind: str = "bit", block: int = BLOCK):
        self.out, self.kind, self.block, self.zstd = out, kind, block, zstandard.ZstdCompressor(level=1)
        self.parts, self.held, self.at, self.blocks, self.docs = [], 0, len(MAGIC), [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.add_all([doc_id], np.array([len(ids)]), ids)

    def add_all(self, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents, the number of ids of each, and the ids of all."""
        self.docs += zip(doc_ids, sizes.tolist(), strict=True)
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            run = np.concatenate(self.parts)
            whole = len(run) // self.block * self.block
            for i in range(0, whole, self.block):
                self._put(run[i : i + self.block])
            self.parts, self.held = [run[whole:]], len(run) - whole

    def _put(self, ids: np.ndarray) -> None:
        planes = [self.zstd.compress(p) for p in split_planes(ids, self.kind)]
        self.blocks.append((self.at, len(ids), [len(p) for p in planes]))
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> int:
        """The number of ids written."""
        if self.held:
            self._put(np.concatenate(self.parts))
        index = self.zstd.compress(json.dumps({"kind": self.kind, "docs": self.docs, "blocks": self.blocks}).encode())
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)
        return sum(n for _, n in self.docs)


class PlaneReader:
    def __init__(self, f, size: int):
        self.f, z = f, zstandard.ZstdDecompressor()
        f.seek(size - 12)
        tail = f.read(12)
        if tail[8:] != MAGIC:
            raise ValueError("not a complete plane file")
        n = struct.unpack("<Q", tail[:8])[0]
        f.seek(size - 12 - n)
        self.index, self.zstd = json.loads(z.decompress(f.read(n))), z

    def block(self, i: int) -> np.ndarray:
        at, n, sizes = self.index["blocks"][i]
        self.f.seek(at)
        raw, planes = self.f.read(sum(sizes)), []
        for s in sizes:
            planes.append(self.zstd.decompress(raw[:s]))
            raw = raw[s:]
        return join_planes(planes, n, self.index["kind"])

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document's ids, in file order, with a block or a document in memory at a time."""
        held, i = np.empty(0, "<u4"), 0
        for doc_id, n in self.index["docs"]:
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.block(i))
                have, i = have + len(parts[-1]), i + 1
            run = np.concatenate(parts) if len(parts) > 1 else held
            yield doc_id, run[:n]
            held = run[n:]


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or a local path, and the path in it."""
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def _write(path: str, vocabulary: str, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary), TaskContext.get().partitionId()
        store, root = open_fs(path)
        store.create_dir(root, recursive=True)
        name = posixpath.join(root, f"part-{part:06d}-{uuid.uuid4().hex}.tdp")  # an attempt that fails leaves a file that the manifest doesn't name
        docs = 0
        with store.open_output_stream(name) as out:
            w = PlaneWriter(out, kind)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    some = batch.slice(at, 4096)
                    ids, bounds = ended(*encode(some.column("text")), end_id)
                    w.add_all(some.column("doc_id").to_pylist(), np.diff(bounds), ids)
                    docs += some.num_rows
            n = w.close()
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([docs], pa.int64()), pa.array([n], pa.int64())], ["part", "file", "docs", "tokens"])
        else:
            store.delete_file(name)

    return run


def _read(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_fs(path)
        for batch in batches:
            for part, name in zip(batch.column("part").to_pylist(), batch.column("file").to_pylist(), strict=True):
                ids, starts, sizes, sums, at = [], [], [], [], 0
                with store.open_input_file(name) as f:
                    for doc_id, run_ in PlaneReader(f, f.size()).documents():
                        ids.append(doc_id), starts.append(at), sizes.append(len(run_))
                        sums.append(zlib.crc32(np.ascontiguousarray(run_).tobytes()))
                        at += len(run_)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), *(pa.array(x, pa.int64()) for x in (ids, starts, sizes, sums))], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_tokens(documents: DataFrame, vocabulary: str, end_id: int, path: str | None = None, kind: str = "bit") -> DataFrame:
    """Encodes documents(doc_id, text) and writes plane files in ascending doc_id order over the files; returns the manifest.

    Manifest: part (the order of the files), file, docs, tokens. A null text is empty: its document is the end id alone.
    Null doc_ids come first; rows that repeat a doc_id (or have none) stay apart, ordered by a hash of the text, by which
    they are also dealt out. The files go to `path`, or to the shared folder. One shuffle deals the texts out by ranges of
    doc_id; a task holds one block and one batch at a time.
    """
    spark = documents.sparkSession
    path = path or scratch_path(spark, "planes")
    hashed = documents.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    ranged = hashed.repartitionByRange("doc_id", "hash").sortWithinPartitions(F.asc_nulls_first("doc_id"), "hash").select("doc_id", "text")
    manifest = stored(ranged.mapInArrow(lean(_write(path, vocabulary, end_id, kind)), "part int, file string, docs long, tokens long"), "manifest")
    manifest._tidemark_root = path
    return manifest


def read_tokens(manifest: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files: start counts the ids of all documents before it."""
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    bases = manifest.select("part", F.coalesce(F.sum("tokens").over(w), F.lit(0)).alias("base"))
    files = manifest.repartition(max(1, min(manifest.count(), 10_000)), "file")  # a number, so that tiny rows aren't put together
    rows = files.select("part", "file").mapInArrow(lean(_read(path)), "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(small_side(bases), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def token_digests(spark: SparkSession, documents: DataFrame, vocabulary: str, end_id: int, kind: str = "bit") -> DataFrame:
    manifest = write_tokens(documents, vocabulary, end_id, kind=kind)
    return read_tokens(manifest, manifest._tidemark_root)
