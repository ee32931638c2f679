"""What the operators share: words, batch functions, and names of columns; scratch tables are the library's."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.scratch import discard as discard
from tidemark.scratch import scratch_path as scratch_path
from tidemark.scratch import small_side as small_side
from tidemark.scratch import stored as stored

#: Bytes that split words of the decontamination rule; A-Z go to lower case. Bytes from 0x80 up are parts of words.
_KEEP = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


def alnum_words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text after lower-casing A-Z, as UTF-8; none of a null."""
    return [] if text is None else text.encode("utf-8", "replace").translate(_KEEP).split()


def space_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text after lower-casing A-Z, as UTF-8; none of a null."""
    return [] if text is None else text.encode("utf-8", "replace").lower().split()


def lean(run):
    """A batch function that gives freed memory back to the system when its task ends: workers live on between tasks and stages."""

    def task(batches):
        pa.set_memory_pool(pa.system_memory_pool())  # the others keep what is freed for later use
        yield from run(batches)
        with contextlib.suppress(OSError, AttributeError):  # where there is no glibc
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return task


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened by underscores where df has a column of that name (whatever its case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_columns_from(df: DataFrame, text: str, start, added: list[str], fields: str) -> DataFrame:
    """df with columns more, which a function of each task, start(), derives from its column `text`: from a list of texts, their arrays.

    Columns are passed by place, so df's own may have any name. `text` itself is replaced if `added` names it.
    """
    types = [f.dataType.simpleString() for f in df.schema]
    at = df.columns.index(text)
    replaced = text in added
    order = [c for c in added if c != text]

    def batches_(batches):
        run = start()
        for batch in batches:
            new = dict(zip(added, run(batch.column(at).to_pylist()), strict=True))
            columns = [new[text] if replaced and i == at else c for i, c in enumerate(batch.columns)]
            columns += [new[c] for c in order]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    kinds = dict(f.split(" ", 1) for f in fields.split(", "))
    schema = ", ".join([*(f"c{i} {t}" for i, t in enumerate(types)), *(f"c{len(types) + i} {kinds[c]}" for i, c in enumerate(order))])
    named = df.toDF(*[f"c{i}" for i in range(len(types))])
    return named.mapInArrow(lean(batches_), schema).toDF(*df.columns, *order)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
