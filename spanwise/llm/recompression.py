"""Substring dedup by recompression: remove words of windows that also start earlier.

Every document is a row of word symbols.  A round names maximal runs of one symbol, then
splits the alphabet in two by a bit of the name and names the pairs (left, right) that
stand together.  A name is a digest of its parts, so all tasks give equal strings equal
names without exchanging a dictionary, and whether a symbol exists depends on a known
context: the words ``left..right`` that decided it.  Equal windows hence hold the same
symbols wherever the context lies inside the window.

A window's anchor is its first such symbol of the highest round that has one; windows
without any stand for themselves.  Neighbouring windows with one anchor make one row, so
that a row is shuffled for about four words instead of one per window:

1. rows are dealt by anchor name.  A name that occurs once has no repeat.  Rows whose whole
   stretch of words is equal are repeats of the first of them, verified by 64 bits that do
   not depend on the name's 64; the first rows of different stretches under one name go on;
2. only their windows are compared one by one, by 128-bit digests;
3. what repeats goes back to its document by doc_id, where words are removed.

A task keeps one row of each stretch for 1 MB of text and passes on the others as repeats,
so a passage in a third of all documents gives few rows of one name.

Windows are judged on the input.  Null text: no words.  A null doc_id is smaller than all
others.  Rows that share a doc_id count as one document, whose windows repeat each other
only at different starts.  Very long texts are read whole.  Extra columns stay, but for
those named as the new ones.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import mix, pack_texts, read_table, released, signed, split_words, text_buffer, unpacked_slices, word_hashes

ROUNDS = 5
#: Place of a context that runs past its document: never inside a window.
BEYOND = np.int64(1) << 50
_RUN, _PAIR, _BASE = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x9FB21C651E98DF25)
_BASE2 = np.uint64(0xD1342543DE82EF95)


@dataclass
class Symbols:
    """Symbols of one round in order: name, the words they span, the context that decides them, their document."""

    name: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    doc: np.ndarray


def _neighbours(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each symbol has one before and after it in its document."""
    inner = doc[1:] == doc[:-1]
    before, after = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    before[1:], after[:-1] = inner, inner
    return before, after


def name_runs(s: Symbols, word: np.ndarray, turn: int) -> Symbols:
    """Name each maximal run of one symbol.

    That a neighbour differs is often seen from the next word alone; else its whole context counts.
    """
    before, _ = _neighbours(s.doc)
    same = before.copy()
    same[1:] &= s.name[1:] == s.name[:-1]
    start = np.flatnonzero(~same)
    length = np.diff(np.append(start, len(s.name)))
    last = start + length - 1
    begin, end, doc = s.begin[start], s.end[last], s.doc[start]
    if (length > 1).any():
        left, right = np.minimum.reduceat(s.left, start), np.maximum.reduceat(s.right, start)
        named = mix(s.name[start] * _RUN + length.astype(np.uint64) * _PAIR + np.uint64(turn))
        name = np.where(length > 1, named, s.name[start])
    else:
        left, right, name = s.left.copy(), s.right.copy(), s.name
    before, after = _neighbours(doc)
    tail, head = word[s.end[start] - 1], word[begin]  # of the repeated symbol
    plain = before & (word[np.maximum(begin - 1, 0)] != tail)
    i = np.flatnonzero(plain)
    left[i] = np.minimum(left[i], begin[i] - 1)
    i = np.flatnonzero(before & ~plain)
    left[i], right[i] = np.minimum(left[i], s.left[start[i] - 1]), np.maximum(right[i], s.right[start[i] - 1])
    plain = after & (word[np.minimum(end, len(word) - 1)] != head)
    i = np.flatnonzero(plain)
    right[i] = np.maximum(right[i], end[i] + 1)
    i = np.flatnonzero(after & ~plain)
    left[i], right[i] = np.minimum(left[i], s.left[last[i] + 1]), np.maximum(right[i], s.right[last[i] + 1])
    left[~before], right[~after] = -BEYOND, BEYOND
    return Symbols(name, begin, end, left, right, doc)


def name_pairs(s: Symbols, turn: int) -> Symbols:
    """Name neighbours whose first is of the left and whose second is of the right half of the alphabet."""
    before, after = _neighbours(s.doc)
    is_left = (mix(s.name ^ (np.array([turn + 1], np.uint64) * _BASE)) >> np.uint64(63)).astype(bool)
    pair = is_left & after
    pair[:-1] &= ~is_left[1:]
    second = np.zeros(len(pair), bool)
    second[1:] = pair[:-1]
    name, end, left, right = s.name.copy(), s.end.copy(), s.left.copy(), s.right.copy()
    p = np.flatnonzero(pair)
    name[p] = mix(mix(s.name[p] * _PAIR + np.uint64(turn)) ^ s.name[p + 1])
    end[p] = s.end[p + 1]
    left[p], right[p] = np.minimum(s.left[p], s.left[p + 1]), np.maximum(s.right[p], s.right[p + 1])
    alone = is_left & ~pair  # the next symbol, being left too, decided that
    i = np.flatnonzero(alone & after)
    left[i], right[i] = np.minimum(s.left[i], s.left[i + 1]), np.maximum(s.right[i], s.right[i + 1])
    right[alone & ~after] = BEYOND
    alone = ~is_left & ~second
    i = np.flatnonzero(alone & before)
    left[i], right[i] = np.minimum(s.left[i], s.left[i - 1]), np.maximum(s.right[i], s.right[i - 1])
    left[alone & ~before] = -BEYOND
    keep = ~second
    return Symbols(name[keep], s.begin[keep], end[keep], left[keep], right[keep], s.doc[keep])


def recompress(word: np.ndarray, first: np.ndarray, turns: int = ROUNDS) -> list[Symbols]:
    """The symbols of all rounds, the words themselves first."""
    place = np.arange(len(word))
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    rounds = [Symbols(word, place, place + 1, place, place + 1, doc)]
    for turn in range(turns):
        rounds.append(name_pairs(name_runs(rounds[-1], word, turn), turn))
    return rounds


class RangeDigest:
    """Digests of word ranges from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, word: np.ndarray, base: np.uint64 = _BASE):
        n = len(word)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]))
        self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(word * self.power[:n])])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))


def anchored(rounds: list[Symbols], first: np.ndarray, window: int, digest: RangeDigest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of neighbouring windows with one anchor: anchor name, first and last window start."""
    doc = rounds[0].doc
    open_ = np.flatnonzero(np.arange(len(doc)) + window <= first[1:][doc])
    anchor, name = np.full(len(doc), -1, np.int64), np.zeros(len(doc), np.uint64)
    for level in range(len(rounds) - 1, 0, -1):
        s = rounds[level]
        good = np.flatnonzero((s.left >= 0) & (s.right - s.left <= window))
        if not len(good) or not len(open_):
            continue
        left, right = s.left[good], s.right[good]
        j = np.searchsorted(np.maximum.accumulate(left), open_)
        at, begin = np.arange(len(open_)), s.begin[good]
        while len(at):  # the first symbol with its context inside the window
            inside = (j < len(good))
            at, j = at[inside], j[inside]
            i = open_[at]
            near = begin[j] < i + window
            at, j, i = at[near], j[near], i[near]
            hit = (left[j] >= i) & (right[j] <= i + window)
            anchor[i[hit]] = (np.int64(level) << 40) + j[hit]
            name[i[hit]] = digest(left[j[hit]], right[j[hit]]) + np.uint64(level)
            at, j = at[~hit], j[~hit] + 1
        open_ = open_[anchor[open_] < 0]
    anchor[open_] = open_  # windows without a symbol of their own
    name[open_] = digest(open_, open_ + window)
    i = np.flatnonzero(anchor >= 0)
    if not len(i):
        return name[:0], i, i
    starts = np.ones(len(i), bool)
    starts[1:] = (anchor[i[1:]] != anchor[i[:-1]]) | (i[1:] != i[:-1] + 1) | (doc[i[1:]] != doc[i[:-1]])
    at = np.flatnonzero(starts)
    return name[i[at]], i[at], i[np.append(at[1:], len(i)) - 1]


#: A row of windows as one number: first window start, further windows, and a flag of two bits.
def pack_span(begin: np.ndarray, more: np.ndarray, flag: np.ndarray | int) -> np.ndarray:
    return (begin.astype(np.int64) << 18) | (more.astype(np.int64) << 2) | flag


def unpack_span(span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return span >> 18, (span >> 2) & 0xFFFF, span & 3


ROWS = "name long, digest long, doc long, span long"
_ROWS = ["name", "digest", "doc", "span"]


def _rows_of(window: int, turns: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in unpacked_slices(batch):
                words = split_words(*text_buffer(part["text"]))
                word = word_hashes(words)
                digest = RangeDigest(word)
                name, begin, last = anchored(recompress(word, words.first, turns), words.first, window, digest)
                text = words.of_text()[begin] if len(begin) else np.zeros(0, np.int64)
                doc = part["doc"].to_numpy()[text]
                stretch = signed(RangeDigest(mix(word), _BASE2)(begin, last + window))
                local = begin - words.first[text]
                order = np.lexsort((local, doc, stretch, name))
                name, stretch, doc, local, more = name[order], stretch[order], doc[order], local[order], (last - begin)[order]
                again = np.zeros(len(name), bool)  # a repeat within this slice
                again[1:] = (name[1:] == name[:-1]) & (stretch[1:] == stretch[:-1]) & ((doc[1:] != doc[:-1]) | (local[1:] != local[:-1]))
                own = mix(doc.astype(np.uint64) * _RUN + local.astype(np.uint64)) >> np.uint64(32)  # short, as nothing is compared under it
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.where(again, own, name))), pa.array(stretch), pa.array(doc), pa.array(pack_span(local, more, again.astype(np.int64)))], names=_ROWS)

    return run


def _windows_of(window: int):
    """128-bit digests of the windows of rows that are flagged for it."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in unpacked_slices(batch):
                words = split_words(*text_buffer(part["text"]))
                word = word_hashes(words)
                spans = part["spans"].combine_chunks()
                counts = spans.value_lengths().fill_null(0).to_numpy()
                begin, more, flag = unpack_span(spans.flatten().to_numpy())
                text = np.repeat(np.arange(part.num_rows), counts)
                begin, more, text = begin[flag == 1], more[flag == 1], text[flag == 1]
                text = np.repeat(text, more + 1)
                local = np.repeat(begin - (np.cumsum(more + 1) - more - 1), more + 1) + np.arange(int((more + 1).sum()))
                at = words.first[text] + local
                fits = at + window <= words.first[text + 1]  # rows that share a doc_id may be shorter
                text, local, at = text[fits], local[fits], at[fits]
                one, two = RangeDigest(word), RangeDigest(mix(word), _BASE2)
                yield pa.RecordBatch.from_arrays([pa.array(signed(one(at, at + window))), pa.array(signed(two(at, at + window))), pa.array(part["doc"].to_numpy()[text]), pa.array(local, pa.int64())], names=["one", "two", "doc", "start"])

    return run


def _removed(window: int):
    """Kept words of each document, and counts."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in unpacked_slices(batch):
                kept, total, gone = [], [], []
                for text, spans, starts in zip(part["text"].to_pylist(), part["spans"], part["starts"], strict=True):
                    words = (text or b"").split()
                    change = np.zeros(len(words) + window + 1, np.int64)
                    if spans.is_valid:
                        begin, more, flag = unpack_span(spans.values.to_numpy())
                        ok = (flag == 0) & (begin + more + window <= len(words))
                        np.add.at(change, begin[ok], 1)
                        np.add.at(change, begin[ok] + more[ok] + window, -1)
                    if starts.is_valid:
                        begin = starts.values.to_numpy()
                        begin = begin[begin + window <= len(words)]
                        np.add.at(change, begin, 1)
                        np.add.at(change, begin + window, -1)
                    removed = np.cumsum(change)[: len(words)] > 0
                    n = int(removed.sum())
                    kept.append(b" ".join(compress(words, ~removed) if n else words))
                    total.append(len(words))
                    gone.append(n)
                yield pa.RecordBatch.from_arrays([part["row"].combine_chunks(), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=["row", "text", "n_words", "n_removed"])

    return run


def repeats_by_name(rows: DataFrame) -> DataFrame:
    """Per document the spans that repeat (flag 0), and those whose windows must be compared (flag 1)."""
    order = Window.partitionBy("name").orderBy("digest", "doc", "span")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    already = F.col("span").bitwiseAND(F.lit(1)) == 1
    judged = rows.select(
        "doc", "span", already.alias("already"),
        F.count(F.lit(1)).over(whole).alias("n"),
        (F.first("digest").over(whole) != F.last("digest").over(whole)).alias("several"),
        F.coalesce(F.lag("digest").over(order) == F.col("digest"), F.lit(False)).alias("later"),
        F.coalesce((F.lag("doc").over(order) == F.col("doc")) & (F.lag("span").over(order) == F.col("span")), F.lit(False)).alias("twin"),
    )
    repeat = F.col("already") | (F.col("later") & ~F.col("twin"))
    clean = F.col("span") - F.col("span").bitwiseAND(F.lit(1))
    return (
        judged.filter(F.col("already") | (F.col("n") > 1))
        .filter(repeat | F.col("several"))
        .select("doc", F.when(repeat, clean).otherwise(clean + 1).alias("span"))
        .groupBy("doc").agg(F.collect_list("span").alias("spans"))
    )


def remove_repeats(docs: DataFrame, window: int = 20, turns: int = ROUNDS) -> DataFrame:
    """docs with text reduced to its kept words, joined by one space, and columns n_words and n_removed."""
    others = [c for c in docs.columns if c not in ("text", "n_words", "n_removed")]
    # the other columns travel as one, so that their names can't clash with those used here
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), "text", F.struct(*others).alias("row"))
    dealt = pack_texts(keyed).repartition("doc")  # all its columns go everywhere, so that one shuffle serves all three uses
    rows = dealt.mapInArrow(_rows_of(window, turns), ROWS)
    spans = repeats_by_name(rows).hint("shuffle_hash")
    to_compare = dealt.join(spans.filter(F.exists("spans", lambda s: s.bitwiseAND(F.lit(1)) == 1)), "doc")
    windows = to_compare.mapInArrow(_windows_of(window), "one long, two long, doc long, start long")
    order = Window.partitionBy("one", "two").orderBy("doc", "start")
    earlier = F.lag("doc").over(order)
    starts = (
        windows.select("doc", "start", (earlier.isNotNull() & ~((earlier == F.col("doc")) & (F.lag("start").over(order) == F.col("start")))).alias("later"))
        .filter("later").groupBy("doc").agg(F.collect_set("start").alias("starts")).hint("shuffle_hash")
    )
    joined = dealt.join(spans, "doc", "left").join(starts, "doc", "left")
    schema = keyed.select("row").schema
    for name, kind in (("text", "string"), ("n_words", "long"), ("n_removed", "long")):
        schema = schema.add(name, kind)
    return joined.select("row", "doc", "text", "spans", "starts").mapInArrow(_removed(window), schema).select("row.*", "text", "n_words", "n_removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
d AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT t.doc_id, count(d.i) AS gone, coalesce(string_agg(word, ' ' ORDER BY t.i) FILTER (WHERE d.i IS NULL), '') AS kept FROM t LEFT JOIN d ON d.doc_id = t.doc_id AND d.i = t.i GROUP BY t.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
