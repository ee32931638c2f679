"""Encoding of whole texts with the tokenizers library, column-wise: each distinct chunk between spaces is encoded once."""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

_START, _MARK = "\x03", "\x01"
#: Texts that are encoded whole: white space beside white space or at the end, white space other than space and line feed, marks of special tokens, the characters used as marks here.
_ODD = "[\\x01\\x03\\t\\x0b\\f\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[ \\n][ \\n]|[ \\n]$|<\\|"
_TAIL = ".,;:!?"


class ChunkEncoder:
    """Ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False).ids.

    Both kinds of pre-tokenizer break a text before each single space and around each single line feed (byte-level) or at
    all white space (word ends), and between a letter and punctuation, so chunks can be encoded alone and remembered. Odd
    texts are encoded whole. Chunks and their ids are Arrow and numpy arrays, looked up and gathered a batch at a time.
    Beyond `keep` chunks the half that was met least often is forgotten.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        self.keep = keep
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tok = Tokenizer.from_file(path)
        n = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        names = [self.tok.id_to_token(i) or "" for i in range(n)]
        self.leads = np.array([x.startswith("Ġ") for x in names])
        self.ends = np.array([x.endswith("</w>") for x in names])
        self.spaced = not self.ends.any()  # byte-level: a token at the start of a word holds the space
        feed, mark = self._ids("\n"), self._ids(_MARK)
        self.feed = int(feed[0]) if len(feed) == 1 else None
        self.mark = int(mark[0]) if len(mark) == 1 else None
        # The chunks known: their ids lie one after another in `flat`. The empty chunk is the first.
        self.chunks = pa.array([""], pa.large_string())
        self.tail_ids: dict[str, np.ndarray] = {}
        self.flat, self.size, self.met = np.empty(0, self.dtype), np.zeros(1, np.int64), np.full(1, 1 << 40)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _runs(self, chunks: pa.Array, glue: str, cut: np.ndarray | int | None, lead: str = "") -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after another, and how many each has. cut: which ids begin a chunk, or (ends) finish one, or the id of the glue."""
        flat, sizes = [np.empty(0, self.dtype)], [np.empty(0, np.int64)]
        starts = np.append(np.arange(0, len(chunks), 512), len(chunks))
        for i, text in enumerate(pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), chunks.cast(pa.string())), glue).to_pylist() if len(chunks) else []):
            n, ids = int(starts[i + 1] - starts[i]), self._ids(lead + text)
            if cut is self.leads:
                at = np.flatnonzero(cut[ids])
                ok, size = len(at) == n and at[0] == 0, np.diff(np.append(at, len(ids)))
            elif cut is self.ends:
                at = np.flatnonzero(cut[ids]) + 1
                ok, size = len(at) == n and at[-1] == len(ids), np.diff(np.concatenate(([0], at)))
            elif cut is not None:
                glues = ids == cut
                at = np.flatnonzero(glues)
                ok, size, ids = len(at) == n - 1, np.diff(np.concatenate(([-1], at, [len(ids)]))) - 1, ids[~glues]
            else:
                ok = False
            if not ok:
                own = [self._ids(lead + x) for x in chunks.slice(starts[i], n).to_pylist()]
                ids, size = np.concatenate(own), np.array([len(x) for x in own])
            flat.append(ids), sizes.append(size)
        return np.concatenate(flat), np.concatenate(sizes)

    def _add(self, chunks: pa.Array, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The places of the chunks added."""
        at = np.arange(len(self.size), len(self.size) + len(size))
        self.chunks = pa.concat_arrays([self.chunks, chunks])
        self.flat, self.size = np.concatenate((self.flat, flat)), np.concatenate((self.size, size))
        self.met = np.concatenate((self.met, np.zeros(len(size), np.int64)))
        return at

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """Ids of the chunks at these places, one after another."""
        pool = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(self.size)))), pa.array(self.flat))
        return pool.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)

    def _encode(self, new: pa.Array) -> np.ndarray:
        """Encodes and adds different chunks that aren't known; returns their places."""
        out = np.empty(len(new), np.int64)
        if self.spaced:
            bare = pc.or_(pc.starts_with(new, _START), pc.starts_with(new, "\n")).to_numpy(zero_copy_only=False)  # at the start of a text or after a line feed: no space before
            plain, others = new.filter(pa.array(~bare)), new.filter(pa.array(bare))
            out[~bare] = self._add(plain, *self._runs(plain, " ", self.leads, " "))
            if len(others):
                fed = pc.starts_with(others, "\n").to_pylist()
                bodies = pc.utf8_slice_codeunits(others, 1)
                some = pc.unique(bodies)
                some = some.filter(pc.not_equal(some, ""))
                flat, size = self._runs(some, "\n", self.feed)
                own = dict(zip(some.to_pylist(), np.split(flat, np.cumsum(size)[:-1]) if len(size) else [], strict=True)) | {"": np.empty(0, self.dtype)}
                feed = self._ids("\n")
                rows = [np.concatenate((feed, own[b])) if f else own[b] for f, b in zip(fed, bodies.to_pylist(), strict=True)]
                out[bare] = self._add(others, np.concatenate(rows), np.array([len(x) for x in rows]))
        else:
            words = pc.utf8_is_alpha(new).to_numpy(zero_copy_only=False)
            for mask, glue, cut in ((words, " ", self.ends), (~words, f" {_MARK} ", self.mark)):
                some = new.filter(pa.array(mask))
                out[mask] = self._add(some, *self._runs(some, glue, cut))
        return out

    def _tails(self, tails: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of punctuation one after another, and how many each has."""
        for t in set(tails).difference(self.tail_ids):
            self.tail_ids[t] = self._ids(t)
        own = [self.tail_ids[t] for t in tails]
        return np.concatenate(own), np.array([len(x) for x in own])

    def _places(self, chunks: pa.Array) -> np.ndarray:
        """The places of different chunks, which are learned if they aren't known. One that ends in punctuation is put together."""
        base = pc.utf8_rtrim(chunks, _TAIL)
        split = pc.and_(pc.match_substring_regex(chunks, "\\pL[.,;:!?]+$"), pc.invert(pc.ends_with(base, "İ"))).to_numpy(zero_copy_only=False)  # whose lower case ends in a mark, which joins punctuation
        base = base.filter(pa.array(split))
        found = pc.fill_null(pc.index_in(pa.concat_arrays([chunks, base]), value_set=self.chunks), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        place, of_base = found[: len(chunks)], found[len(chunks) :]
        if not len(place) or place.min() >= 0:
            return place
        alone, joined = (place < 0) & ~split, place[split] < 0
        fresh = joined & (of_base < 0)
        coded = pa.concat_arrays([chunks.filter(pa.array(alone)), base.filter(pa.array(fresh))]).dictionary_encode()
        learned = self._encode(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        place[alone], of_base[fresh] = np.split(learned, [int(alone.sum())])
        if joined.any():
            later, of_base = chunks.filter(pa.array(split)).filter(pa.array(joined)), of_base[joined]
            cut = pc.binary_length(base.filter(pa.array(joined))).to_pylist()
            tail, n_tail = self._tails([x[k:].decode() for x, k in zip(later.cast(pa.large_binary()).to_pylist(), cut, strict=True)])
            n_base = self.size[of_base]
            end = np.cumsum(n_base + n_tail)
            is_tail = np.repeat(np.tile([False, True], len(end)), np.column_stack((n_base, n_tail)).ravel())
            flat = np.empty(int(end[-1]), self.dtype)
            flat[is_tail], flat[~is_tail] = tail, self._gather(of_base)
            place[np.flatnonzero(split)[joined]] = self._add(later, flat, n_base + n_tail)
        return place

    def _forget(self) -> None:
        """Keeps the more frequent half."""
        at = np.sort(np.argsort(-self.met, kind="stable")[: self.keep // 2])
        self.flat, self.size, self.met, self.chunks = self._gather(at), self.size[at], self.met[at] // 2, self.chunks.take(pa.array(at))
        self.met[0] = 1 << 40  # the empty chunk

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and where each text's begin (one more entry than texts). A null text is empty."""
        if len(self.chunks) > self.keep:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.flatnonzero(pc.match_substring_regex(texts, _ODD if self.spaced else "<\\||[\\x01\\x03]").to_numpy(zero_copy_only=False))
        if self.spaced:
            ready = pc.replace_substring(pc.binary_join_element_wise(pa.scalar(_START, pa.large_string()), texts, pa.scalar("", pa.large_string())), "\n", " \n")
        else:
            ready = pc.replace_substring(texts, "\n", " ")
        if len(odd):
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            ready = pc.if_else(pa.array(mask), pa.scalar(_START if self.spaced else "", pa.large_string()), ready)
        split = pc.split_pattern(ready, " ")
        coded = split.flatten().dictionary_encode()
        place = self._places(coded.dictionary)
        each = coded.indices.to_numpy(zero_copy_only=False)
        self.met[place] += np.bincount(each, minlength=len(place))
        at = place[each]
        flat = self._gather(at)
        ends = np.concatenate(([0], np.cumsum(self.size[at])))
        bounds = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        if len(odd):  # the ids of odd texts come from elsewhere
            parts, last = [], 0
            grown = np.zeros(len(texts) + 1, np.int64)
            for i in odd:
                own = self._ids(texts[int(i)].as_py())
                parts += [flat[last : bounds[i]], own]
                last = bounds[i]
                grown[i + 1] = len(own)
            flat, bounds = np.concatenate([*parts, flat[last:]]), bounds + np.cumsum(grown)
        return flat, bounds


def ended(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (32 bits) with the end id after each text's, and where each text's begin then."""
    out = np.insert(ids.astype("<u4"), bounds[1:], end_id)
    return out, bounds + np.arange(len(bounds))


@functools.lru_cache(maxsize=2)
def encoder(path: str, keep: int = 1_000_000) -> ChunkEncoder:
    """The worker process's own encoder, kept from task to task."""
    return ChunkEncoder(path, keep)
