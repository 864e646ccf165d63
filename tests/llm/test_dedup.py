"""Dedup operators against brute force on small tables with nulls, repeats, empty and long texts."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from spanwise.llm import near_dedup, recompression, suffix_dedup
from spanwise.llm.suffix_groups import suffix_array

WORD = re.compile("[^\x20\x09-\x0D]+")


def _texts(seed, count, vocabulary, longest):
    rng = random.Random(seed)
    made = []
    for _ in range(count):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, longest))]
        if made and rng.random() < 0.6:
            source = made[rng.randrange(len(made))].split(" ")
            at = rng.randrange(len(source))
            words[len(words) // 2 : len(words) // 2] = source[at : at + rng.randint(1, longest)]
        made.append(rng.choice([" ", "\n", " \t"])[:1].join(words))
    return made


def _table(spark, texts, first=0):
    rows = [(first + i, t, i % 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans int").repartition(3)


def _brute_words(rows, window):
    seen, out = set(), {}
    for ident, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out[ident] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


@pytest.mark.parametrize("vocabulary", [["a", "b"], ["x"], list("abcdefgh"), [f"w{i}" for i in range(60)]])
def test_recompression_equals_brute_force(spark, vocabulary):
    texts = [*_texts(len(vocabulary), 40, vocabulary, 60), None, "", "  ", " ".join(vocabulary * 300)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in recompression.remove_repeats(_table(spark, texts), window=8).collect()}
    assert got == _brute_words(list(enumerate(texts)), 8)


def test_recompression_default_window_and_edges(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    texts = ["start " + passage, passage + " end", None, passage, "ä ö " * 30]
    docs = _table(spark, texts)
    result = recompression.remove_repeats(docs)
    assert "spans" in result.columns  # an extra column whose name the operator uses inside
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in result.collect()}
    assert got == _brute_words(list(enumerate(texts)), 20)
    assert recompression.remove_repeats(docs.limit(0)).count() == 0
    twice = recompression.remove_repeats(docs.filter("doc_id = 0").unionByName(docs.filter("doc_id = 0"))).collect()
    assert [r.n_removed for r in twice] == [0, 0]  # rows that share a doc_id are one document
    unknown = docs.filter("doc_id < 2").withColumn("doc_id", F.when(F.col("doc_id") == 0, F.col("doc_id")))
    assert {r.doc_id: r.n_removed > 0 for r in recompression.remove_repeats(unknown).collect()} == {0: True, None: False}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abc", max_size=40), min_size=1, max_size=4))
def test_equal_windows_share_an_anchor(texts):
    window = 6
    words = [list(t) for t in texts]
    flat = np.array([ord(c) for w in words for c in w], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first = np.cumsum([0] + [len(w) for w in words])
    name, begin, last = recompression.anchored(recompression.recompress(flat, first), first, window, recompression.RangeDigest(flat))
    anchor, seen = {}, {}
    for n, a, b in zip(name, begin, last):
        anchor.update({i: n for i in range(a, b + 1)})
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            assert anchor[first[d] + i] == seen.setdefault(key, anchor[first[d] + i])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.text("ab", max_size=14), min_size=1, max_size=4), min_size=1, max_size=4))
def test_suffixes_are_sorted(groups):
    symbols, first = [], [0]
    for strings in groups:
        symbols += [0] + [x for s in strings for x in [*(ord(c) for c in s), 0]]
        first.append(len(symbols))
    order = suffix_array(np.array(symbols, np.int64), np.array(first))
    for a, b in zip(first[:-1], first[1:]):
        assert sorted(order[a:b]) == list(range(a, b))
        keys = [symbols[i : symbols.index(0, i)] for i in order[a:b]]
        assert keys == sorted(keys)


def _brute_bytes(rows, width):
    owner, out = {}, {}
    for ident, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - width + 1):
            if owner.setdefault(data[i : i + width], ident) != ident:
                gone[i : i + width] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[ident] = (len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("vocabulary", [["ab", "é"], ["x"], ["one", "two", "drei", "für", "naïve"], [f"word{i}" for i in range(80)]])
def test_suffix_arrays_equal_brute_force(spark, vocabulary):
    texts = [*_texts(len(vocabulary) + 9, 40, vocabulary, 60), None, "", "y" * 500, "y" * 700, "short"]
    result = suffix_dedup.remove_repeats(_table(spark, texts)).withColumn("sha", F.sha2("kept", 256))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in result.collect()}
    assert got == _brute_bytes(list(enumerate(texts)), 50)


def test_suffix_dedup_edges(spark):
    texts = ["é" * 60, "x" + "é" * 60, None]
    docs = _table(spark, texts)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    whole = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(docs, whole_characters=True).collect()}
    assert whole == {0: "é".encode() * 60, 1: b"x", 2: b""}
    same = docs.filter("doc_id = 0").unionByName(docs.filter("doc_id = 0"))
    assert [r.n_removed for r in suffix_dedup.remove_repeats(same).collect()] == [0, 0]


def _brute_components(rows, size, percent):
    sets, parent = {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    for ident, text in sorted(rows):
        words = WORD.findall((text or "").translate(lower))
        sets[ident] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())
        parent[ident] = ident
        for other in sets:
            common = len(sets[ident] & sets[other])
            if common and 100 * common >= percent * (len(sets[ident]) + len(sets[other]) - common):
                a, b = sorted((find(ident), find(other)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("block", [2_000_000, 300])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", block)
    rng = random.Random(5)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randrange(40)) for _ in range(90)) for _ in range(6)]
    texts = list(base)
    for _ in range(60):
        words = rng.choice(texts).split()
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(9)}"
        texts.append(" ".join(words))
    texts += [None, "", "one two", "ONE two", "one two three", base[0].upper(), base[1], "  "]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(_table(spark, texts), size=4).collect()}
    assert got == _brute_components(list(enumerate(texts)), 4, 80)


@pytest.mark.parametrize("order", ["ordered", "shuffled"])
def test_near_duplicates_of_a_long_chain(spark, order):
    words = [f"w{random.Random(i).randrange(10**9)}" for i in range(700)]
    texts = [" ".join(words[i : i + 60]) for i in range(600)]  # each near the one before, far from most
    ids = list(range(600)) if order == "ordered" else random.Random(2).sample(range(600), 600)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    assert {r.component_id for r in near_dedup.near_duplicates(docs, size=4).select("component_id").distinct().collect()} == {0}


def test_near_duplicates_edges(spark):
    docs = _table(spark, ["a b c d e", None])
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    twice = near_dedup.near_duplicates(docs.unionByName(docs)).collect()
    assert sorted((r.doc_id, r.component_id) for r in twice) == [(0, 0), (0, 0), (1, 1), (1, 1)]


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    a, b = pool[:3000], pool[500:3500]
    r = [near_dedup.registers(np.sort(x), np.array([0, len(x)])) for x in (a, b)]
    value = near_dedup.estimate(r[0], r[1], np.array([3000.0]), np.array([3000.0]))[0]
    assert abs(value - 2500 / 3500) < 0.15
    merged = np.maximum(r[0], r[1])  # registers of a union are the maxima
    assert (merged == near_dedup.registers(np.sort(pool[:3500]), np.array([0, 3500]))).all()


def _packed(sets):
    return np.concatenate([np.array(sorted(x), np.uint64) for x in sets]), np.cumsum([0] + [len(x) for x in sets])


@pytest.mark.parametrize("across", [False, True])
def test_links_join_what_brute_force_joins(across):
    rng = random.Random(12)
    for turn in range(40):
        pool = [rng.getrandbits(64) for _ in range(60)]
        sets = []
        for _ in range(rng.randint(1, 40)):
            if sets and rng.random() < 0.6:
                base = set(rng.choice(sets))
                base -= set(rng.sample(sorted(base), min(len(base) - 1, rng.randint(0, 3))))
                sets.append(base | set(rng.sample(pool, rng.randint(0, 2))))
            else:
                sets.append(set(rng.sample(pool, rng.randint(1, 40))))
        block = np.array([rng.randrange(2) if across else 0 for _ in sets])
        values, first = _packed(sets)
        found = near_dedup.links_among(values, first, near_dedup.registers(values, first), block, 80)
        near = {(x, y) for x in range(len(sets)) for y in range(x) if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])}
        assert set(found) <= near

        def joined(pairs):
            of = list(range(len(sets)))
            for a, b in pairs:
                of = [of[b] if c == of[a] else c for c in of]
            return of

        if across and block.min() != block.max():  # pairs within a block are another unit's work
            got, want = joined(found), joined(p for p in near if block[p[0]] != block[p[1]])
            assert all(got[a] == got[b] for a in range(len(sets)) for b in range(a) if want[a] == want[b]), turn
        else:
            got, want = joined(found), joined(near)
            assert all((got[a] == got[b]) == (want[a] == want[b]) for a in range(len(sets)) for b in range(a)), turn


def test_boilerplate_and_copies_in_one_group_take_no_pairs():
    rng = np.random.default_rng(3)
    n = 20_000
    common = rng.integers(0, 1 << 63, 14, dtype=np.uint64)
    own = rng.integers(0, 1 << 63, (n, 6), dtype=np.uint64)
    alike = np.sort(np.hstack([np.broadcast_to(common, (n, 14)), own]), axis=1)  # all pairs of similarity 0.54
    copies = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    some = np.sort(np.where(rng.random((3000, 100)) < 0.02, rng.integers(0, 1 << 63, (3000, 100), dtype=np.uint64), copies), axis=1)
    sets, first = np.concatenate([alike.ravel(), some.ravel()]), np.cumsum([0] + [20] * n + [100] * 3000)
    begin = time.process_time()
    found = near_dedup.links_among(sets, first, near_dedup.registers(sets, first), np.zeros(n + 3000, int), 80)
    assert time.process_time() - begin < 60 and len(found) == 2999
