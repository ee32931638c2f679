"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns with clashing names, for each operator and stage."""

import collections
import gzip
import io
import math
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tidemark.llm import decontam, graph, langid, packing, parity_join, pii, sharding, token_planes, topk, url_filter, warc
from tidemark.llm import queries as q
from tidemark.llm.tokens import ChunkEncoder

LONG = "Lorem ipsum dolor " * 6000
TEXTS = [(1, "one two three four five six seven"), (2, "one two three four five six seven"), (2, "one two three four five six seven"), (3, None), (4, ""), (5, "  \n\t "), (6, LONG), (7, "short"), (8, "a b"), (None, "one two three four five six seven"), (9, "ÀÉ ünïcode — 日本語 text with © signs 12345")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASH = ["sig", "keys", "bucket", "mark", "term", "window", "row", "cell", "bin", "offset", "round", "own", "before", "slot", "size", "h", "ids", "part"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "fr")[k % 2], "s", None if t is None else len(t)) for k, (i, t) in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "two three four five"), (2, None), (3, ""), (None, "one two"), (4, "two three four five"), (4, "two three four five"), (5, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")


def test_jaccard_edges(docs, empty):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in parity_join.jaccard_components(docs, 3, 90, 100).collect())
    assert got == collections.Counter({(1, 5, 1): 1, (2, 5, 1): 2, (None, 5, 1): 1, (3, 0, 3): 1, (4, 0, 4): 1, (5, 0, 5): 1, (6, 3, 6): 1, (7, 1, 7): 1, (8, 1, 8): 1, (9, 7, 9): 1})
    kept = parity_join.keep_one(docs, 3, 90, 100)
    assert kept.columns == docs.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter([1, 3, 4, 5, 6, 7, 8, 9, None])
    assert parity_join.jaccard_components(empty).count() == 0 and parity_join.keep_one(empty).count() == 0


def test_keep_one_of_each_text(spark):
    """Rows that share a doc_id, or have none, with unlike, alike and equal texts."""
    a, b, c, d, e, f, g = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcdefg")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (3, d), (None, e), (None, e), (None, f"{e} more"), (None, a), (4, None), (4, None), (4, f), (5, g), (5, f"{g} more"), (None, ""), (None, "")]
    got = [(r.doc_id, r.text) for r in parity_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    either = [(i, t.removesuffix(" more") if t else t) for i, t in got]
    assert collections.Counter(either) == collections.Counter([(1, a), (2, b), (3, c), (3, d), (None, e), (None, a), (4, None), (4, f), (5, g), (None, "")]) and set(got) <= set(rows)


@pytest.mark.parametrize("p,ngram", [(80, 5), (90, 3), (60, 1)])
def test_jaccard_near_the_threshold(spark, p, ngram):
    """Chains of texts that differ in a few words, over sizes from 5 to 2,000 and a crowd that shares most words, against brute force."""
    rng = np.random.default_rng(p)
    texts = []
    for size in (5, 9, 12, 20, 45, 90, 200, 450, 2000):
        for _ in range(4):
            words = [f"v{x}" for x in rng.integers(0, 10**6, size)]
            texts.append(" ".join(words))
            for share in (0.01, 0.02, 0.03, 0.05):
                for i in rng.integers(0, size, max(1, int(size * share))):
                    words[i] = f"v{rng.integers(0, 10**6)}"
                texts.append(" ".join(words))
    base = [f"c{x}" for x in range(120)]
    for k in range(60):
        texts.append(" ".join([*base[: 100 + k % 20], f"z{k}", *base[: k % 3]]))
    got = {r.doc_id: r for r in parity_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ngram, p, 100).collect()}
    shingle = parity_join.Shingler(ngram)
    sets, up = [set(shingle(t).tolist()) for t in texts], list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    links = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if 100 * both >= p * (len(a) + len(b) - both):
                x, y = sorted((top(i), top(j)))
                up[y], links = x, links + 1
    assert links > 40
    assert [got[i].component_id for i in range(len(texts))] == [top(i) for i in range(len(texts))]


def test_crowded_bucket(spark, monkeypatch):
    """More members of a bucket than are paired, in components that only members other than the least join."""
    monkeypatch.setattr(parity_join, "FEW", 2)
    monkeypatch.setattr(parity_join, "CHUNK", 3)
    base = [f"c{x}" for x in range(200)]
    texts = []
    for g in range(5):
        for k in range(4):
            own = [f"g{g}_{x}" for x in range(60)]
            texts.append(" ".join([*base, *own[: 59 - k]]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in parity_join.jaccard_components(df, 1, 95, 100).collect()}
    assert got == {i: i // 4 * 4 for i in range(20)}


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, x) for x in range(2001, 2100)] + [(5, 5)]
    up = {}

    def top(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in pairs:
        if a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: top(i) for i in up}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination_edges(docs, empty, items, monkeypatch):
    for limit in (decontam.VOCABULARY, 0):  # 0: no vocabulary is sent out, all terms are indexed
        monkeypatch.setattr(decontam, "VOCABULARY", limit)
        got = collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.contamination(docs, items).collect())
        assert got == collections.Counter({(1, 7, 4, 2, True): 1, (2, 7, 4, 2, True): 2, (None, 7, 4, 2, True): 1, (3, 0, 0, 0, False): 1, (4, 0, 0, 0, False): 1, (5, 0, 0, 0, False): 1, (6, 18000, 0, 0, False): 1, (7, 1, 0, 0, False): 1, (8, 2, 0, 0, False): 1, (9, 9, 0, 0, False): 1})
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7, 8, 9]
    assert decontam.contamination(empty, items).count() == 0
    assert not decontam.contamination(docs, items.filter("false")).filter("contaminated").count()


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x x beta x gamma"), (2, "alpha x x x x x x x x beta"), (3, "gamma beta alpha")], "doc_id long, text string")
    index = decontam.PositionalIndex(d)
    w = spark.createDataFrame([(7, ["alpha", "beta"]), (8, ["gamma"]), (9, ["alpha", "missing"])], "window long, terms array<string>")
    got = decontam.proximity_matches(index, w, decontam.term_frequencies(d), 4)
    assert sorted((r.window, r.doc) for r in got.collect()) == [(7, 1), (7, 3), (8, 1), (8, 3)]


def test_packing_edges(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.packed_documents(docs, path).collect()
    assert collections.Counter(r.doc_id for r in rows if r.piece == 0) == collections.Counter(i for i, _ in TEXTS)
    assert all(r.length == 1 for r in rows if r.doc_id in (3, 4, 5))
    assert packing.packed_documents(empty, path).count() == 0


@pytest.mark.parametrize("cell", [40, 1000])
def test_packing_bound(spark, cell):
    rng = np.random.default_rng(1)
    lengths = np.concatenate((rng.integers(1, 100, 700), [100] * 3, [51] * 40)).tolist()
    p = spark.createDataFrame([(i, 0, 0, int(n), i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(p, 100, cell=cell, pool=4).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(lengths)))
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 100
    bound = packing.lower_bound(np.array(lengths), 100)
    assert bound <= len(bins) <= bound * (1.03 if cell == 40 else 1.003)


def test_lower_bound_is_one():
    """No packing can beat it: checked against exhaustive search on small cases."""
    rng = np.random.default_rng(2)

    def fewest(sizes, room):
        if not sizes:
            return 0
        best, first, rest = len(sizes), sizes[0], sizes[1:]
        for mask in range(1 << len(rest)):
            own = [s for i, s in enumerate(rest) if mask >> i & 1]
            if first + sum(own) <= room:
                best = min(best, 1 + fewest([s for i, s in enumerate(rest) if not mask >> i & 1], room))
        return best

    for _ in range(25):
        sizes = sorted(rng.integers(1, 20, 7).tolist(), reverse=True)
        low, exact = packing.lower_bound(np.array(sizes), 20), fewest(sizes, 20)
        assert low <= exact <= packing.best_fit_decreasing(np.array(sizes), 20).max() + 1
    assert packing.lower_bound(np.array([51] * 9), 100) == 9


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 65, 1000])
def test_planes(kind, n):
    for top in (1, 2, 255, 256, 50256, 2**32 - 1):
        ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64, endpoint=True).astype("<u4")
        assert (token_planes.join_planes(token_planes.split_planes(ids, kind), n, kind) == ids).all()


def test_plane_files():
    rng, out = np.random.default_rng(4), io.BytesIO()
    runs = [rng.integers(0, 50000, n).astype("<u4") for n in (3, 0, 1000, 1, 130, 64)]
    w = token_planes.PlaneWriter(out, "bit", 64)
    for i, r in enumerate(runs):
        w.add(i, r)
    assert w.close() == sum(map(len, runs))
    back = list(token_planes.PlaneReader(io.BytesIO(out.getvalue()), len(out.getvalue())).documents())
    assert [i for i, _ in back] == list(range(len(runs))) and all((a == b).all() for (_, a), b in zip(back, runs, strict=True))
    with pytest.raises(ValueError):
        token_planes.PlaneReader(io.BytesIO(out.getvalue()[:-3]), len(out.getvalue()) - 3)


def test_token_edges(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = token_planes.token_digests(spark, docs, path, 2).collect()
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(i for i, _ in TEXTS)
    assert token_planes.token_digests(spark, empty, path, 2).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunk_encoder(name):
    rng = np.random.default_rng(9)
    alphabet = list("abé É.,'\n 1☃\t😀-ßΣİ") + ["'s", " the", "\n\n", "<|endoftext|>", "\x01", "\x03"]
    texts = [None, "", " ", *("".join(rng.choice(alphabet, rng.integers(1, 30))) for _ in range(1500)), LONG]
    tok, encode = Tokenizer.from_file(public_tokenizers.path(name)), ChunkEncoder(public_tokenizers.path(name))
    for _ in range(2):
        ids, at = encode(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == tok.encode(t or "", add_special_tokens=False).ids, t


def test_language_edges(spark, docs, empty):
    got = {(r.doc_id, r.lang_pred) for r in langid.language_digests(docs).collect()}
    assert {(3, "und"), (4, "und"), (5, "und")} <= got
    assert langid.language_digests(empty).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in langid.language_digests(unlabelled).collect()} == {("und", 0.0)}
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and not {3, 4, 5} & {r.doc_id for r in kept.collect()}


def test_marks_are_no_letters_and_names_may_clash(spark):
    rows = [(1, "\u0301\u0302"), (2, "the cat"), (3, "\u0301 5")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__text", F.lit("y")).withColumn("__lang", F.lit("z")).withColumn("__score", F.lit(7))
    m = langid.Model(["en"], np.zeros((langid.FEATURES, 1), np.float32), np.zeros(1), 1.0)
    out = langid.identify(df, m)
    assert out.columns == [*df.columns, "__lang_", "__score_"]
    assert {r.doc_id: r["__lang_"] for r in out.collect()} == {1: "und", 2: "en", 3: "und"}


def test_scores_against_a_plain_model(spark):
    """The same weights applied character by character in Python."""
    rng = np.random.default_rng(2)
    langs = ["aa", "bb", "cc"]
    m = langid.Model(langs, rng.normal(0, 50, (langid.FEATURES, 3)).astype(np.float32), rng.normal(0, 1, 3), 1.7)
    texts = ["Hello, wörld! 12", "é", "ab  ab\tab", "12 x", "ǅ ŁÓDŹ", "日本 語", "a\u0301b " * 50, "", None, "123"]

    def plain(text):
        mask = (1 << 32) - 1
        s = "".join((c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] in "LM" else " " for c in text or "")
        if not any(unicodedata.category(c)[0] == "L" for c in s):
            return "und", 0.0
        c = [32, *map(ord, re.sub(" +", " ", s)), 32]
        grams = []
        for n in (1, 2, 3):
            for i in range(len(c) - n + 1):
                h = 0
                for k in range(n):
                    h = (h * 0x01000193 + c[i + k] * 0x9E3779B1 & mask) ^ (k + 1)
                grams.append((h * 0x85EBCA6B & mask) >> 16)
        z = [sum(float(m.weights[f][y]) for f in grams) / len(grams) + m.bias[y] for y in range(3)]
        e = [math.exp((v - max(z)) / 1.7) for v in z]
        return langs[int(np.argmax(z))], max(e) / sum(e)

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in langid.identify(df, m).collect():
        want = plain(texts[r.doc_id])
        assert r["__lang"] == want[0] and abs(r["__score"] - want[1]) < 1e-4, (texts[r.doc_id], want)


@pytest.mark.parametrize("rare,others", [(40, [20] * 7), (6, [22] * 6 + [23])])
def test_rare_languages_are_learned_from(spark, monkeypatch, rare, others):
    """Eight languages of skewed counts: each gives an equal part of the sample, or all that it has."""
    used = []
    monkeypatch.setattr(langid, "train_ftrl", lambda examples, classes: used.extend(y for y, _, _ in examples) or (np.zeros((langid.FEATURES, classes)), np.zeros(classes)))
    monkeypatch.setattr(langid, "held_out", lambda doc_id: F.lit(False))
    rows = [(k * 10**6 + i, f"text {chr(97 + k)}", f"l{k}") for k in range(8) for i in range(rare if k == 3 else 1500)]
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 160 if rare == 40 else 161)
    got, part = collections.Counter(used), lambda n: n - n // 5  # every fifth sets the temperature
    assert got[3] == part(min(rare, 20)) and sorted(n for k, n in got.items() if k != 3) == sorted(map(part, others))


def test_one_hash_of_many_rows(spark):
    """Rows that repeat id and text lie all within or all beyond a share of the hashes."""
    rows = [(1, f"text {c}", c) for c in "abcdefgh" for _ in range(300)]
    learnable = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    assert collections.Counter(r.lang for r in langid._drawn(learnable, dict.fromkeys("abcdefgh", 300), 80)) == dict.fromkeys("abcdefgh", 10)


def test_ftrl_is_sparse_and_right():
    rng = np.random.default_rng(5)
    examples = []
    for i in range(300):
        y = i % 2
        ids = np.unique(np.concatenate((rng.integers(0, 50, 3) + 50 * y, rng.integers(100, 1000, 5)))).astype(np.int32)
        examples.append((y, ids, np.ones(len(ids), np.float32)))
    w, b = langid.train_ftrl(examples, 2, l1=0.5)
    right = sum(int((x @ w[ids] + b).argmax()) == y for y, ids, x in examples)
    assert right >= 290 and (w == 0).mean() > 0.5
    logits = np.array([[4.0, 0.0], [0.0, 4.0], [4.0, 0.0], [4.0, 0.0]])
    assert langid.fit_temperature(logits, np.array([0, 1, 1, 0])) > 1.5


def test_pseudonyms():
    p = pii.Pseudonyms(b"k")
    text = "Card 4539 1488 0343 6467 or 4539148803436467, not 4539148803436468; +1 (415) 555-2671, 123-45-6789, 000-45-6789, GB82 WEST 1234 5698 7654 32, 2024-02-29, 2023-02-29, 31.12.1999, 12/31/1999, 10.20.30.40, 300.1.1.1, Ann.Lee9@mail.example.com"
    new, kinds = p.replace(text)
    assert kinds == ["card", "card", "phone", "ssn", "iban", "ymd", "dmy", "dmy", "ip", "email"]
    assert len(new) >= len(text) - 12 and p.replace(new, back=True)[0] == text
    a, b = new.split(" or ")[0].removeprefix("Card "), new.split(" or ")[1].split(",")[0]
    assert a.replace(" ", "") == b and pii.luhn_digit(b[:-1]) == b[-1] and b != "4539148803436467"
    assert "not 4539148803436468" in new and "2023-02-29" in new and "000-45-6789" in new and "300.1.1.1" in new
    assert pii.Pseudonyms(b"other").replace(text)[0] != new
    f = pii.Feistel(b"x")
    for n in (1, 2, 10, 97, 1000):
        image = [f.permute(i, n, "t") for i in range(n)]
        assert sorted(image) == list(range(n)) and all(f.permute(y, n, "t", True) == i for i, y in enumerate(image))


def test_pseudonyms_without_digits():
    p, text = pii.Pseudonyms(b"k"), "Write to anna.smith@example.com today"
    alone, kinds = p.replace(text)
    assert kinds == ["email"] and "anna.smith" not in alone and p.replace(alone, back=True) == (text, ["email"])
    assert p.replace(f"{text}, room 7") == (f"{alone}, room 7", ["email"])


@pytest.mark.parametrize("key", [b"k", b"a", b"b", b"c"])
def test_pseudonyms_beside_other_groups(key):
    """The value gets the pseudonym that it has alone, whatever stands beside it, and comes back."""
    p = pii.Pseudonyms(key)
    card, iban = "4539 1488 0343 6467", "ES91 2100 0418 4502 0005 1332"
    for value, around in [(card, "{} 123"), (card.replace(" ", ""), "{} 99 items"), (card, "order 12 {}"), (card, "AB12 {}"), (card, "{} {}"), (iban, "{} PAID"), (iban, "{} 12 PAID"), (iban, "{} 2024-02-29, {}"), ("378282246310005", "{} 1234"), ("3782 822463 10005", "7 {} 12")]:
        text, n = around.format(value, value), around.count("{}")
        new, kinds = p.replace(text)
        alone, own = p.replace(value)
        assert alone != value and kinds.count(own[0]) == n and new.count(alone) == n and p.replace(new, back=True)[0] == text


def test_phones_and_addresses():
    """Numbers with area codes that can't be stay; exchanges stay of their kind; addresses of any letters are found."""
    p = pii.Pseudonyms(b"k")
    for text in ("call 555-123-4567 now", "(415) 555-2671", "+1 212 555 0199", "212.555.0199 or so", "an jörg.müller@köln.example.de", "иван@пример.рф", "to jo_e+x@example.co.uk."):
        new, kinds = p.replace(text)
        assert len(kinds) == 1 and new != text and len(new) == len(text) and p.replace(new, back=True) == (text, kinds), text
        if kinds == ["phone"]:
            digits = [re.sub(r"\D", "", x)[-10:] for x in (text, new)]
            assert digits[1][0] >= "2" and digits[1][1:3] != "11" and (digits[0][3] >= "2") == (digits[1][3] >= "2")
        else:
            assert new.split("@")[1] == text.split("@")[1]
    for text in ("(017) 555-7713", "911-555-1234", "1.555-123-4567", "555-123-45678", "2024-555-123-4568", "a@b", "x@-y.com"):
        assert p.replace(text) == (text, [])


def test_equal_values_stay_linked_across_documents(spark):
    """Brute force over documents with and without digits: a value has one pseudonym everywhere, different values have different ones."""
    values = ["jane.doe@example.com", "JANE.doe@example.com", "kim@example.org", "4539 1488 0343 6467", "+1 (415) 555-2671", "415-555-2671", "123-45-6789", "2024-02-29", "10.20.30.40"]
    around = ["{}", "write to {} now", "{} 5 times", "no. 17: {}", "{}, {}"]
    rows = [(i * 10 + k, a.format(v, v), v) for i, v in enumerate(values) for k, a in enumerate(around)] + [(900, "clean words", None), (901, None, None), (902, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, value string")
    for c in ("__text", "__kinds", "__kinds_", "__lang", "__score"):
        df = df.withColumn(c, F.lit("x"))
    out = pii.pseudonymised(df, b"k")
    assert out.columns == [*df.columns, "__kinds__"]
    of = collections.defaultdict(set)
    for r in out.collect():
        if r.value is None:
            assert (r.text, r["__kinds__"]) == ({901: None, 902: "", 900: "clean words"}[r.doc_id], [])
            continue
        before, after = around[r.doc_id % 10].split("{}")[0], around[r.doc_id % 10].split("{}")[-1]
        new = r.text[len(before) : len(r.text) - len(after)]
        of[r.value].update(new.split(", ") if r.doc_id % 10 == 4 else [new])
        assert r.value not in r.text and r["__text"] == "x"
    assert all(len(x) == 1 for x in of.values()) and len({next(iter(x)) for x in of.values()}) == len(values)


def test_pseudonyms_of_runs_come_back():
    """Groups at random, in which several readings overlap."""
    rng, p, some = np.random.default_rng(8), pii.Pseudonyms(b"k"), 0
    for _ in range(3000):
        groups = ["".join(rng.choice(list("0123456789"), n)) for n in rng.choice([2, 3, 4, 4, 4, 5, 6, 8, 13, 16], rng.integers(1, 9))]
        text = rng.choice(["", "AB12 ", "DE89 ", "on 2024-02-29 "]) + "".join(g + rng.choice([" ", " ", "-", "  ", " x "]) for g in groups)
        new, kinds = p.replace(text)
        some += len(kinds)
        assert p.replace(new, back=True) == (text, kinds), text
    assert some > 1000


def test_pseudonym_edges(docs, empty):
    out = pii.pseudonymised(docs, b"k")
    assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == collections.Counter(TEXTS)
    assert pii.pseudonymised(empty, b"k").count() == 0


def brute_top_k(rows, every=20, k=20):
    """Rows (vec_id, embedding) that take part, each against every other row, in Python's integers."""
    take = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    hold = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = []
    for at, (a, u) in enumerate(take):
        if a % every == 0:
            best = sorted((-hold(sum(x * y for x, y in zip(u, v))), b) for j, (b, v) in enumerate(take) if j != at)[:k]
            want += [(a, r + 1, b, -s) for r, (s, b) in enumerate(best)]
    return sorted(want)


def test_topk_edges(spark):
    """Only vectors that are null or hold null or non-finite components take no part (and rows without an id)."""
    rows = [(0, [1.0, 0.5]), (20, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [-1.0, 3.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, []), (1, [1.0, 0.5]), (9, [1e9, 0.0]), (2, [0.0, 1.0]), (10, [-3e15, 2e15]), (20, [0.25, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).withColumn("cell", F.lit(1))
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df).collect()) == brute_top_k(rows)
    assert topk.top_k(df.filter("false")).count() == 0
    assert sorted(r.rank for r in topk.top_k(df.filter("vec_id in (0, 8)")).collect()) == [1]


def test_topk_of_mixed_magnitudes(spark):
    """Norms that lie many powers of ten apart, where a lifted coordinate loses its last digits."""
    rng = np.random.default_rng(16)
    rows = [(i, [float(v) for v in rng.normal(0, 10.0 ** rng.integers(-1, 8), 6)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, every=10, k=5, pivots=8, rings=4, block=32)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == brute_top_k(rows, 10, 5)


def test_topk_pruning_is_exact(spark):
    """Clusters of different norms, small blocks, many annuli."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.3, (150, 8)) for c in rng.normal(0, 2, (6, 8))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, every=10, k=7, pivots=6, rings=4, block=16).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    v = np.floor(64 * x).astype(np.int64)
    for a in range(0, len(x), 10):
        best = sorted((-int(s), int(b)) for b, s in enumerate(v @ v[a]) if b != a)[:7]
        assert sorted(got[a]) == [(i + 1, b, -s) for i, (s, b) in enumerate(best)]


def test_products_of_any_size():
    big = np.array([[2**31 - 1, -(2**31)], [3, 4]], np.int64)
    assert topk.products(big, big).tolist() == [[min((2**31 - 1) ** 2 + 2**62, 2**63 - 1), 3 * (2**31 - 1) - 2**33], [3 * (2**31 - 1) - 2**33, 25]]


def test_url_edges(spark):
    urls = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.ORG", "http://a.org?x=1", "http://a.org/#f", "http://A.org/p/1/2?q", "x://y://z/w", "http://u:p@h.com:8/de/1", "http://xcom/de/1"]
    p = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("said", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.judged(p, q.RULES).collect()}
    assert got == {0: ("", "", None), 1: ("", "", None), 2: ("", "", None), 3: ("", "", None), 4: ("", "", None), 5: ("www.example.org", "", None), 6: ("a.org", "", None), 7: ("a.org", "/", "org/"), 8: ("a.org", "/p/1/2", "org/"), 9: ("y:", "//z/w", None), 10: ("u:p@h.com:8", "/de/1", None), 11: ("xcom", "/de/1", None)}
    assert url_filter.judged(p.filter("false"), q.RULES).count() == 0
    assert url_filter.allowed(p, [("block", "a.org/p/")]).count() == len(urls) - 1


def test_templates_generalise(spark):
    rows = [(i, f"http://shop.net/item/name-{chr(97 + i % 26)}{chr(97 + i // 26)}/view") for i in range(60)] + [(100 + i, f"http://shop.net/spam/{i}") for i in range(20)] + [(200, "http://shop.net/spam/x/y")]
    out = {r.page_id: r for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string"), [("block", "shop.net/spam/1"), ("allow", "shop.net/item/name-a")]).collect()}
    assert {out[i].template for i in range(60)} == {"/item/*/view"} and out[30].verdict == "allow"
    assert out[105].rule is None and out[105].template == "/spam/*" and out[105].verdict == "block"


def plain_verdicts(urls, rules):
    """The tree in plain Python: (template, purity) of each (host, path), and of each its rule's verdict."""
    rows, labels = set(), collections.Counter()
    for host, path in urls:
        fits = [(len(t), v) for v, t in rules for h, _, r in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + r)]
        rows.add((host, path))
        if fits:
            labels[host, path, max(fits)[1] == "block"] += 1
    template = {x: x[1].rstrip("/").split("/") for x in rows}
    for level in range(1, max(map(len, template.values()))):
        own = collections.defaultdict(set)
        for (host, _), t in template.items():
            if len(t) > level:
                own[host, tuple(t[:level])].add(t[level])
        for (host, _), t in template.items():
            if len(t) > level and (len(c := own[host, tuple(t[:level])]) > url_filter.FAN or len(c) >= url_filter.FEW and sum(bool(re.search("[0-9]", x)) for x in c) >= url_filter.DIGITS * len(c)):
                t[level] = "*"
    sums = collections.defaultdict(lambda: [0, 0])
    for (host, path), t in template.items():
        for level in range(len(t)):
            for bad in (False, True):
                sums[host, tuple(t[: level + 1])][0] += labels[host, path, bad]
            sums[host, tuple(t[: level + 1])][1] += labels[host, path, True]
    rate = lambda n, b: (b + 0.5) / (n + 1)
    spread = lambda n, b: rate(n, b) * (1 - rate(n, b)) / (n + 1)
    groups = collections.defaultdict(list)
    for (host, node), (n, b) in sums.items():
        if n:
            groups[host, node[:-1]].append((rate(n, b), "/".join(node), node, n, b))
    pooled = {}
    for (host, _), members in groups.items():
        branches = []
        for r, _, node, n, b in sorted(members):
            if branches and r - rate(*branches[-1][0]) <= url_filter.Z * (spread(*branches[-1][0]) + spread(n, b)) ** 0.5:
                branches[-1][0][0] += n
                branches[-1][0][1] += b
                branches[-1][1].append(node)
            else:
                branches.append(([n, b], [node]))
        pooled.update({(host, node): sums_ for sums_, nodes in branches for node in nodes})
    out = {}
    for (host, path), t in template.items():
        purity = sum(n for (_, _, bad), n in labels.items() if bad) / len(urls)
        for level in range(len(t)):
            if (x := pooled.get((host, tuple(t[: level + 1])))) is not None:
                weight = url_filter.TEMPLATE_PRIOR if level else url_filter.HOST_PRIOR
                purity = (x[1] + weight * purity) / (x[0] + weight)
        out[host, path] = "/".join(t), round(purity, 6)
    return out


def test_the_tree_against_plain_python(spark):
    """Wildcards on several levels, siblings that merge and that don't, templates without labels of their own, very deep paths."""
    rng = np.random.default_rng(3)
    urls = [("a.com", f"/{x}/{y}/{z}") for x in ("shop", "news") for y in ("de", "fr", "it") for z in rng.integers(0, 500, 12)]
    urls += [("a.com", f"/u/{''.join(rng.choice(list('abcdefgh'), 4))}/p{i % 3}") for i in range(120)] + [("a.com", "/deep" + "/x" * 12), ("a.com", ""), ("a.com", "/"), ("b.com", "/x"), ("b.com", "/bad/1"), ("c.org", "/y/z/")]
    urls += [("m.a.com", f"/bad/{k}/{i}") for k in "abcde" for i in range(k == "a" and 40 or 3)] + [("m.a.com", f"/free/{i}") for i in range(9)]
    rules = [("block", "a.com/shop/de/"), ("allow", "a.com/news/fr"), ("block", "a.com/bad/a"), ("allow", "a.com/bad/b"), ("block", "b.com/bad"), ("allow", "a.com/u/a"), ("block", "a.com/u/b")]
    df = spark.createDataFrame([(i, f"http://{h}{p}?q") for i, (h, p) in enumerate(urls)], "page_id long, url string")
    got = {(r.host, r.path): r for r in url_filter.judged(df, rules).collect()}
    want = plain_verdicts(urls, rules)
    assert {k: (r.template, r.purity) for k, r in got.items()} == want
    free = [r for r in got.values() if r.rule is None]
    assert all(r.verdict == ("block" if r.purity >= 0.5 else "allow") for r in free)
    assert {r.verdict for r in free if r.host == "m.a.com" and r.path.startswith("/free/")} == {"block"}  # by its host's labels, having none
    assert {r.verdict for r in free if r.host == "m.a.com" and r.path.startswith("/bad/c")} == {"block"} and got["c.org", "/y/z/"].verdict == "allow"


def test_deeper_levels_are_one_segment(spark):
    path = "/a" * 40
    r = url_filter.judged(spark.createDataFrame([(1, "http://h" + path)], "page_id long, url string"), [("block", "h/a")]).first()
    assert (r.path, r.template, r.verdict) == (path, path, "block")


def test_urls_without_a_rule_are_blocked_by_their_host(spark, data):
    """On the pages, where no url outside the rules has labels in its own branch, the parents' purity decides."""
    rows = q.op2_url_filter(spark, data.replace("sf0.001", "sf0.01")).collect()  # the smallest has no such host
    want = plain_verdicts([(r.host, r.path) for r in rows], q.RULES)
    assert all((r.template, r.purity) == want[r.host, r.path] and (r.rule or r.verdict == ("block" if r.purity >= 0.5 else "allow")) for r in rows)
    assert {r.host for r in rows if not r.rule and r.verdict == "block"}


def test_warc_edges(spark):
    html = "<p>same</p>" * 20
    rows = [(1, "http://a/", html), (2, "http://b/\r\nX: y", html), (2, "http://b/", html), (3, None, None), (4, "u", ""), (5, "é", "short"), (6, "u", "short"), (None, "n", html), (7, "u", "é" * 60), (8, "u", "é" * 60)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(spark, p).collect())
    n = len(html)
    assert got == collections.Counter({(1, n, "response", None): 1, (2, n, "revisit", 1): 2, (None, n, "response", None): 1, (3, 0, "response", None): 1, (4, 0, "response", None): 1, (5, 5, "response", None): 1, (6, 5, "response", None): 1, (7, 120, "response", None): 1, (8, 120, "revisit", 7): 1})
    assert warc.round_trip(spark, p.filter("false")).count() == 0


def test_warc_headers(spark, tmp_path):
    """Every record has an id of its own and a date; revisits name their profile and the id of a response that is there."""
    html = "<p>same</p>" * 20
    rows = [(1, "http://a/", html), (1, "http://b/", html), (2, "http://b/", html), (3, "http://c/", "x" * 200), (4, "http://c/", "x" * 200), (5, "u", "short"), (6, "v", "short")]
    warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = warc.read_warc(spark, str(tmp_path / "w"), payloads=False).collect()
    assert len({r.record_id for r in got}) == len(rows) and all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", r.date) for r in got)
    responses = {r.record_id: r for r in got if r.record_type == "response"}
    again = [r for r in got if r.record_type == "revisit"]
    assert sorted(r.page_id for r in again) == ["2", "4"] and all(r.profile == warc.PROFILE and responses[r.refers_to].payload_digest == r.payload_digest for r in again)
    assert all(r.profile is None and r.refers_to is None for r in responses.values())


def test_warc_foreign_files(spark, tmp_path):
    """Plain and ordinary gzip archives, several record types, filters that the source takes and ones that it leaves to Spark."""
    records = [warc.record_bytes([("WARC-Type", k), ("WARC-Record-ID", f"<urn:{i}>"), ("WARC-Target-URI", f"http://h/{i}")], b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + b"x" * (i * 1000) if k == "response" else b"info") for i, k in enumerate(["warcinfo", "response", "request", "response"])]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    df = warc.read_warc(spark, str(tmp_path))
    assert df.count() == 8
    got = df.filter("record_type = 'response' and target_uri != 'http://h/3'").select(F.octet_length("payload").alias("n")).collect()
    assert [r.n for r in got] == [1000, 1000]
    slim = warc.read_warc(spark, str(tmp_path), payloads=False).filter("record_id in ('<urn:1>', '<urn:2>')")
    assert sorted((r.record_id, r.payload) for r in slim.collect()) == [("<urn:1>", None)] * 2 + [("<urn:2>", None)] * 2


def test_sharding_edges(spark, docs, empty):
    rows = sharding.sharded(docs).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(i for i, _ in TEXTS)
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (3, 4)} == {(8, 0)}
    for places in [[r.slot for r in rows if r.shard == s] for s in range(24)]:
        assert sorted(places) == list(range(len(places)))
    assert sharding.sharded(empty).count() == 0


def test_growth_moves_only_to_the_new_shard(spark):
    totals = spark.range(512).select(F.col("id").cast("int").alias("virtual_slot"), (F.col("id") * 37 % 101 + 1).alias("bytes"), F.lit(1).cast("long").alias("rows"))
    v1 = sharding.first_map(totals, 8)
    v2 = sharding.grow(v1, 8)
    a, b = {r.virtual_slot: r.shard for r in v1.collect()}, {r.virtual_slot: r.shard for r in v2.collect()}
    moved = [s for s in a if a[s] != b[s]]
    assert moved and {b[s] for s in moved} == {8} and {r.version for r in v2.collect()} == {2}
    loads = collections.Counter()
    for r in v2.collect():
        loads[r.shard] += r.bytes
    assert max(loads.values()) <= 1.15 * sum(loads.values()) / 9
    path = cp.stored(v1, "unused")._tidemark_path + "-map"
    sharding.store_map(v1, path)
    sharding.store_map(v2, path)
    assert sharding.load_map(spark, path, 2).count() == 512


def test_stages_on_edges(spark, docs, empty, items, tmp_path):
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    for df in (docs, empty):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, df, str(tmp_path))
            assert out.columns == df.columns, name
            out.collect()
        cp.STAGES[-1][1](spark, df, str(tmp_path)).collect()


def test_pipeline(spark, data):
    """Each stage's decisions, one after the other, on the smallest tables."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        before, docs = docs, cp.stored(stage(spark, docs, data), name)
        ids = {r.doc_id for r in docs.collect()}
        assert docs.columns == before.columns and ids <= {r.doc_id for r in before.collect()}
        sizes.append(len(ids))
    assert sizes[0] >= sizes[1] > sizes[2] > sizes[3] == sizes[4] and sizes[1] >= 0.97 * sizes[0]
    assert not decontam.contamination(docs, spark.read.parquet(f"{data}/benchmark.parquet")).filter("contaminated").count()
    packed = cp.STAGES[-1][1](spark, docs, data)
    assert {r.doc_id for r in packed.collect()} == ids
    assert {r.doc_id for r in cp.run(spark, data).collect()} == ids


def test_crc_of_ids():
    assert zlib.crc32(np.array([2], "<u4").tobytes()) == zlib.crc32(b"\x02\0\0\0")


def test_pairs_in_reach_are_no_rows(spark):
    """Of many sets in reach of each other's sketches that hardly link, members and links are rows, not pairs; components are those of brute force."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base, rng.integers(0, 1 << 63, 26 - (k % 4 == 0) * 10).astype(np.uint64)])) for k in range(60)]
    t = pa.table({
        "bucket": pa.array([7] * 60, pa.int64()), "i": pa.array([-1] * 60, pa.int32()), "j": pa.array([-1] * 60, pa.int32()), "sig": pa.array(range(60), pa.int64()), "root": pa.array(range(60), pa.int64()),
        "chunk": pa.array([-1] * 60, pa.int32()), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "sketch": pa.array([parity_join._sketch(s).tobytes() for s in sets], pa.binary()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary()),
    })
    p, q = 90, 100
    key = tuple(pa.scalar(x) for x in (7, -1, -1))
    reach = len(parity_join._reach(t, -1, -1, p, q)[0])
    near = parity_join._near(p, q)(key, t)
    links = parity_join._forest(p, q)(key, t)
    assert reach > 4 * 60 and near.num_rows <= 60 and links.num_rows < 60
    parent = list(range(60))
    top = lambda x: x if parent[x] == x else top(parent[x])
    for a in range(60):
        for b in range(a):
            if parity_join._similar(sets[a], sets[b], p, q):
                parent[top(a)] = top(b)
    want = [top(x) for x in range(60)]
    parent = list(range(60))
    for a, b in zip(*(links.column(c).to_pylist() for c in "ab"), strict=True):
        assert parity_join._similar(sets[a], sets[b], p, q) and top(a) != top(b)
        parent[top(a)] = top(b)
    found = [top(x) for x in range(60)]
    assert len(set(zip(want, found, strict=True))) == len(set(want)) == len(set(found)) < 60
