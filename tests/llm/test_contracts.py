"""Each operator's query against a brute-force version in plain Python, on the smallest tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import queries as q


@pytest.fixture(scope="module")
def docs(spark, data):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").collect()]


def test_topk(spark, data):
    got = [tuple(r) for r in q.op1_exact_topk(spark, data).select("query_id", "rank", "vec_id", "score").collect()]
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([[int(np.floor(64 * float(c))) for c in r.embedding] for r in rows], np.int64)
    want = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        best = sorted((-int(v), int(j)) for v, j in zip(s, ids) if j != ids[i])[:20]
        want += [(int(ids[i]), k + 1, j, -v) for k, (v, j) in enumerate(best)]
    assert sorted(got) == sorted(want)


def test_url_filter(spark, data):
    got = {r.page_id: r for r in q.op2_url_filter(spark, data).collect()}
    for p in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url").collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", p.url)
        host, path = m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]
        fits = [(len(t), t, v) for v, t in q.RULES for h, _, rest in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + rest)]
        r = got[p.page_id]
        assert (r.host, r.path) == (host, path)
        assert r.rule == (max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")


def test_decontamination(spark, data, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    windows = collections.defaultdict(set)
    for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        w = low(r.text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(str(r.item_id))
    sizes = {len(w) for w in windows}
    got = {r.doc_id: r for r in q.op3_decontamination(spark, data).collect()}
    assert len(got) == len(docs)
    found = 0
    for doc_id, text, _ in docs:
        w, hit, items = low(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    items |= own
        r = got[doc_id]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(items))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
        found += r.contaminated
    assert found


def test_tokens(spark, data, docs):
    tok, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r.doc_id: r for r in q.op5_bit_plane_tokens(spark, data).collect()}
    for doc_id, text, _ in sorted(docs):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_languages(spark, data, docs):
    lang = {i: x for i, _, x in docs}
    got = q.op6_language_id(spark, data).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_warc(spark, data):
    got = {r.page_id: r for r in q.op7_warc(spark, data).collect()}
    first = {}
    rows = sorted((r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{data}/pages.parquet").collect())
    for i, html in rows:
        first.setdefault(html, i)
    for i, html in rows:
        again = len(html) >= 100 and first[html] != i
        assert tuple(got[i])[:5] == (i, len(html), hashlib.sha256(html).hexdigest(), "revisit" if again else "response", first[html] if again else None)


def test_packing(spark, data, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = q.op8_best_fit_packing(spark, data).collect()
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        by_bin[r.sequence_id].append((r.offset, r.length))
    for doc_id, text, _ in docs:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
        assert sorted(by_doc[doc_id]) == want
    for parts in by_bin.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by_bin) <= -(-sum(r.length for r in rows) // 2048) + 1


@pytest.mark.parametrize("ngram,p", [(3, 90), (5, 80)])
def test_jaccard(spark, data, docs, ngram, p):
    from tidemark.llm.parity_join import jaccard_components

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + ngram]) for i in range(len(w) - ngram + 1)} if len(w) >= ngram else {tuple(w)} if w else set()

    sets, up = {i: shingles(t) for i, t, _ in docs}, {i: i for i, _, _ in docs}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= p * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= p * (len(a) + len(b) - both):
                    x, y = sorted((top(i), top(j)))
                    up[y] = x
    got = jaccard_components(spark.read.parquet(f"{data}/documents.parquet"), ngram, p, 100).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(i, len(sets[i]), top(i)) for i in ids]
    assert any(top(i) != i for i in ids)


def test_sharding(spark, data, docs):
    rows = q.op10_virtual_slots(spark, data).collect()
    text = {i: (t or "").encode() for i, t, _ in docs}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    loads, places = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        assert r.size == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "bytes" and r.grown_shard is None
        loads[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert set(loads) <= set(range(24)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(loads.values()) - min(loads.values()) <= max(r.size for r in rows)
