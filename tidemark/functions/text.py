"""Tokens for search: Latin accents folded, dashes dropped, lower case, split at all else; stop words; an English stemmer."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tidemark.functions.stem import stem

#: Words that a query is searched without; fixed values.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "but", "by", "can", "could", "did", "do", "does", "for",
    "from", "had", "has", "have", "he", "her", "here", "hers", "him", "his", "how", "i", "if", "in", "into", "is", "it",
    "its", "may", "me", "might", "must", "my", "no", "nor", "not", "of", "on", "or", "our", "shall", "she", "should",
    "so", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "to", "us", "was",
    "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with", "would", "you", "your",
)

#: Letters that fold to two.
_PAIRS = {"æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ß": "ss", "ẞ": "SS", "þ": "th", "Þ": "TH"}
_ODD = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ı": "i", "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T"}
DASHES = "-­‐‑‒–—―−﹘﹣－"


def fold_table() -> dict[str, str]:
    """Latin letters with marks and the ASCII letters they fold to, by Unicode decomposition."""
    out = dict(_ODD)
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base = unicodedata.normalize("NFD", c)[0]
        if base != c and base.isascii() and base.isalpha():
            out[c] = base
    return {k: v for k, v in out.items() if k not in _PAIRS}


def folded(text: Column) -> Column:
    """Lower-case ASCII of Latin text; dashes vanish, so `sw-lucene` is `swlucene`."""
    table = fold_table()
    out = F.translate(text, "".join(table) + DASHES, "".join(table.values()))
    for k, v in _PAIRS.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.lower(out)


def spaced(text: Column) -> Column:
    """The tokens of the text as one string, with a space between two; a space may lead or end it."""
    return F.regexp_replace(F.coalesce(folded(text), F.lit("")), "[^a-z0-9]+", " ")


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits of the folded text; anything else separates."""
    return F.filter(F.split(spaced(text), " "), lambda t: t != "")


def duck_tokens(expr: str) -> str:
    """The same as DuckDB SQL."""
    table = fold_table()
    out = f"translate({expr}, '{''.join(table)}{DASHES}', '{''.join(table.values())}')"
    for k, v in _PAIRS.items():
        out = f"replace({out}, '{k}', '{v}')"
    return f"list_filter(string_split(regexp_replace(coalesce(lower({out}), ''), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"


@F.arrow_udf(ArrayType(StringType()))
def _stemmed(words: pa.Array) -> pa.Array:
    coded = words.flatten().dictionary_encode()
    stems = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy()))), pa.int32()), stems.take(coded.indices))


def stems(text: Column) -> Column:
    """tokens(text), each stemmed by the English stemmer; each different word of a batch once."""
    return _stemmed(tokens(text))


def query_tokens(text: str, keep_stop_words: bool = False, stemmed: bool = False) -> list[str]:
    """Tokens of a query, on the driver; without stop words unless there is nothing else. Words are stemmed before stop words go."""
    table = fold_table() | _PAIRS
    plain = "".join(table.get(c, "" if c in DASHES else c) for c in text).lower()
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in plain).split()
    words = [stem(w) for w in words] if stemmed else words
    kept = [w for w in words if w not in STOP_WORDS]
    return words if keep_stop_words or not kept else kept
