"""Exact substring dedup over UTF-8 bytes by suffix arrays.

Bytes covered by a string of ``width`` bytes that also starts in a document with a smaller
doc_id are removed.  Equal strings must meet in one task, so each string is dealt by its
anchor: of the byte grams inside it the one with the least hash, the first of equals.
Neighbouring strings with one anchor make one row, about one row for sixteen bytes:

1. a text that a smaller document has as a whole (128 bits of its digest) repeats from end
   to end and goes no further; the rows of all others are dealt by the hash of their anchor.  A gram that only
   one document has needs nothing more.  Rows of one gram whose whole stretch of bytes is
   equal (56 bits of digest besides the gram's own 64) are one string of the suffix array,
   owned by its smallest document; all others repeat it;
2. where several stretches share a gram, and go on alike for half a string's rest on one
   side of it, their suffixes are sorted by linear grouping (``suffix_groups``), the
   stretches of many such longer grams side by side.  Neighbours in the suffix array
   that agree in ``width`` bytes form runs, and a suffix repeats if its run has a smaller
   document.  A gram of more than ``HOT`` such stretches is in no suffix array: its strings
   are grouped by 128-bit digests, which spreads them over all tasks;
3. what repeats goes back to its document by doc_id, where bytes are removed.

A task keeps one row of each stretch for 1 MB of text and passes on the others as repeats,
so a text in a third of all documents gives few rows of one gram.  Grams of one task are
sorted in portions of bounded size.

Strings are judged on the input and never cross documents.  Null text: no bytes.  A null
doc_id is smaller than all others.  Rows that share a doc_id are one document, which does
not repeat itself.  Very long texts are read whole.  Extra columns stay, but for those
named as the new ones.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import eight_bytes, hash_ranges, mix, pack_texts, read_table, released, signed, text_buffer, unpacked_slices
from .recompression import pack_span, unpack_span
from .suffix_groups import suffix_array

#: Bytes of a gram (17 to 24), and bytes of stretches whose suffixes are sorted side by side.
GRAM, PORTION = 20, 1_500_000
#: Most stretches of one gram whose suffixes are sorted, in one task.
HOT = 4096
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: The digest's empty low byte follows the empty high bytes of most doc ids, where the shuffle's compression sees them as one run.
_ROWS = ["name", "doc", "digest", "span"]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place (zeros beyond the end)."""
    n = len(data)
    view = eight_bytes(np.concatenate([data, np.zeros(16, np.uint8)]))
    h = view[:n] * _A
    h ^= h >> np.uint64(32)
    h ^= view[8 : n + 8]
    h *= _B
    h ^= h >> np.uint64(29)
    h ^= view[16 : n + 16] & np.uint64((1 << 8 * (GRAM - 16)) - 1)
    return mix(h)


def stretches(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of neighbouring strings with one anchor: gram hash, first and last string start, text."""
    n = len(data)
    h = gram_hashes(data)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)  # by hash, then place
    span, grams = 1, width - GRAM + 1
    while span < grams and n > span:
        step = min(span, grams - span)
        np.minimum(least[:-step], least[step:], out=least[:-step])
        span += step
    closes = np.maximum(offsets[1:] - width + 1, offsets[:-1])  # one past the last string start of each text
    counts = closes - offsets[:-1]
    total = np.cumsum(counts)
    at = np.repeat(offsets[:-1] - (total - counts), counts) + np.arange(int(total[-1]) if len(total) else 0)
    anchor = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    heads = (total - counts)[counts > 0]
    new[heads] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    text = np.searchsorted(total, first, side="right")
    return h[anchor[first]], at[first], at[last], text


def _rows_of(width: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in unpacked_slices(batch):
                data, offsets = text_buffer(part["text"])
                name, begin, last, text = stretches(data, offsets, width)
                doc = part["doc"].to_numpy()[text]
                digest = signed(hash_ranges(data, begin, last + width, 3) & np.uint64(~0xFF & 0xFFFFFFFFFFFFFFFF))
                local, more = begin - offsets[text], last - begin
                order = np.lexsort((doc, digest, name))
                name, digest, doc, local, more = name[order], digest[order], doc[order], local[order], more[order]
                lead = np.ones(len(name), bool)
                lead[1:] = (name[1:] != name[:-1]) | (digest[1:] != digest[:-1])
                owner = doc[np.flatnonzero(lead)][np.cumsum(lead) - 1] if len(name) else doc
                again = doc > owner  # a repeat within this slice
                own = mix(doc.astype(np.uint64) * _A + local.astype(np.uint64)) >> np.uint64(32)  # short, as nothing is compared under it
                digest[again] = 0  # known to repeat: nothing is compared with it
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.where(again, own, name))), pa.array(doc), pa.array(digest), pa.array(pack_span(local, more, again.astype(np.int64)))], names=_ROWS)

    return run


def repeats_by_gram(rows: DataFrame) -> DataFrame:
    """Per document the rows that repeat (flag 0), those whose suffixes must be sorted (flag 1), and those of hot grams (flag 2).

    All come in one list, so that one shuffle serves what follows for each of them.
    """
    order = Window.partitionBy("name").orderBy("digest", "doc", "span")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    already = F.col("span").bitwiseAND(F.lit(1)) == 1
    judged = rows.withColumn("several", F.first("digest").over(whole) != F.last("digest").over(whole)).withColumn("owner", F.min("doc").over(Window.partitionBy("name", "digest")))
    repeat = already | (F.col("doc") > F.col("owner"))
    judged = judged.withColumn("shared", F.min("doc").over(whole) != F.max("doc").over(whole)).withColumn("n", F.count(F.when(~repeat, 1)).over(whole))
    clean = F.col("span") - F.col("span").bitwiseAND(F.lit(3))
    flag = F.when(repeat, 0).when(F.col("n") > HOT, 2).otherwise(1)
    return judged.filter(already | (F.col("shared") & (repeat | F.col("several")))).select("doc", (clean + flag).alias("span")).groupBy("doc").agg(F.collect_list("span").alias("spans"))


def _flagged(flag: int) -> Column:
    return F.exists("spans", lambda s: s.bitwiseAND(F.lit(3)) == flag)


def _strings_of(width: int):
    """128-bit digests of the strings of hot grams."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in unpacked_slices(batch):
                data, offsets = text_buffer(part["text"])
                spans = part["spans"].combine_chunks()
                begin, more, flag = unpack_span(spans.flatten().to_numpy())
                text = np.repeat(np.arange(part.num_rows), spans.value_lengths().fill_null(0).to_numpy())
                begin, more, text = begin[flag == 2], more[flag == 2], text[flag == 2]
                text = np.repeat(text, more + 1)
                local = np.repeat(begin - (np.cumsum(more + 1) - more - 1), more + 1) + np.arange(int((more + 1).sum()))
                at = offsets[text] + local
                fits = at + width <= offsets[text + 1]  # rows that share a doc_id may be shorter
                text, local, at = text[fits], local[fits], at[fits]
                one, two = (signed(hash_ranges(data, at, at + width, seed)) for seed in (5, 6))
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(part["doc"].to_numpy()[text]), pa.array(pack_span(local, np.zeros(len(local), np.int64), 0))], names=["one", "two", "doc", "span"])

    return run


def repeated_strings(strings: DataFrame) -> DataFrame:
    """(doc, span) of strings that a smaller document has too; a string that very many have is one row of the groups."""
    owners = strings.groupBy("one", "two").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).filter("owner < last")
    return strings.join(owners.select("one", "two", "owner"), ["one", "two"]).filter("doc > owner").select("doc", "span")


def _bytes_of(width: int):
    """The bytes of rows whose suffixes must be sorted, with their gram."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in unpacked_slices(batch):
                data, offsets = text_buffer(part["text"])
                spans = part["spans"].combine_chunks()
                counts = spans.value_lengths().fill_null(0).to_numpy()
                begin, more, flag = unpack_span(spans.flatten().to_numpy())
                text = np.repeat(np.arange(part.num_rows), counts)
                at = offsets[text] + begin
                fits = (flag == 1) & (at + more + width <= offsets[text + 1])  # rows that share a doc_id may be shorter
                text, begin, more, at = text[fits], begin[fits], more[fits], at[fits]
                grams = at[:, None] + np.arange(width - GRAM + 1)[None]
                h = gram_hashes(data)
                found = h[grams] if len(at) else np.zeros((0, 1), np.uint64)
                best = (found >> np.uint64(32)).argmin(axis=1)
                name = found[np.arange(len(at)), best]
                order = np.argsort(name, kind="stable")  # alike side by side, where the shuffle's compression sees them
                text, begin, more, at, best, name = text[order], begin[order], more[order], at[order], best[order], name[order]
                raw = data.tobytes()
                pieces = [raw[a:b] for a, b in zip(at.tolist(), (at + more + width).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(name)), pa.array(part["doc"].to_numpy()[text]), pa.array(begin, pa.int64()), pa.array(best, pa.int32()), pa.array(pieces, pa.binary())], names=["name", "doc", "start", "gram_at", "bytes"])

    return run


def _halves(table: pa.Table, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Parts of the pieces whose strings may repeat: key, document, start and bytes, ordered by key.

    A string has its rest on both sides of the gram, half of it on one side at least.  So it
    can only equal strings whose gram goes on alike for half the rest on that side; pieces
    that share this longer gram are sorted together, those that share it with none not at all.
    """
    name, doc, start = (table[c].to_numpy() for c in ("name", "doc", "start"))
    data, offsets = text_buffer(table["bytes"])
    half = (width - GRAM + 1) // 2
    at = offsets[:-1] + table["gram_at"].to_numpy()
    raw = data.tobytes()
    sides = (
        (at - half, at + GRAM, offsets[:-1], np.minimum(offsets[1:], at - half + width)),  # strings from at - half or before
        (at, at + GRAM + half, np.maximum(offsets[:-1], at - half + 1), offsets[1:]),  # strings from after that
    )
    for side, (key_begin, key_end, begin, end) in enumerate(sides):
        rows = np.flatnonzero((key_begin >= offsets[:-1]) & (key_end <= offsets[1:]) & (end - begin >= width))
        key = mix(hash_ranges(data, key_begin[rows], key_end[rows], side) ^ mix(name[rows].view(np.uint64)))
        _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
        keep = np.flatnonzero(counts[which] > 1) if len(rows) else rows
        keep = keep[np.argsort(which[keep], kind="stable")]
        rows, which = rows[keep], which[keep]
        if len(rows):
            yield which, doc[rows], (start + begin - offsets[:-1])[rows], pa.array([raw[i:j] for i, j in zip(begin[rows].tolist(), end[rows].tolist(), strict=True)], pa.binary())


def _repeated_suffixes(name: np.ndarray, doc: np.ndarray, start: np.ndarray, pieces: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, span) of suffixes that agree in width bytes with one of a smaller document under the same name."""
    data, offsets = text_buffer(pieces)
    lengths = np.diff(offsets)
    lead = np.ones(len(name), bool)
    lead[1:] = name[1:] != name[:-1]
    # symbols: 0, piece, 0, piece, 0 ... for each gram
    place = offsets[:-1] + np.arange(len(name)) + np.cumsum(lead)
    total = len(data) + len(name) + int(lead.sum())
    symbols = np.zeros(total, np.int16)
    owner = np.full(total, -1, np.int64)
    at = np.repeat(place - offsets[:-1], lengths) + np.arange(len(data))
    symbols[at] = data.astype(np.int16) + 1
    owner[at] = np.repeat(np.arange(len(name)), lengths)
    first = np.append(place[lead] - 1, total)
    order = suffix_array(symbols, first)
    piece = owner[order]
    inside = np.flatnonzero(piece >= 0)
    source = order[inside] - place[piece[inside]] + offsets[piece[inside]]
    full = source + width <= offsets[piece[inside] + 1]
    piece, source, order = piece[inside][full], source[full], order[inside][full]
    view = eight_bytes(data)
    same = np.zeros(len(piece), bool)
    if len(piece):
        gram = np.cumsum(lead)[piece]
        near = np.flatnonzero(gram[1:] == gram[:-1])
        for shift in [*range(0, width - 8, 8), width - 8]:
            near = near[view[source[near] + shift] == view[source[near + 1] + shift]]
        same[near + 1] = True
    runs = np.flatnonzero(~same)
    docs = doc[piece]
    smallest = np.minimum.reduceat(docs, runs)[np.cumsum(~same) - 1] if len(piece) else docs
    again = np.flatnonzero(docs > smallest)
    piece, local = piece[again], (source - offsets[:-1][piece] + start[piece])[again]
    by_piece = np.lexsort((local, piece))
    piece, local = piece[by_piece], local[by_piece]
    new = np.ones(len(piece), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (local[1:] != local[:-1] + 1)
    heads = np.flatnonzero(new)
    last = np.append(heads[1:], len(piece)) - 1
    return doc[piece[heads]], pack_span(local[heads], local[last] - local[heads], 0) if len(heads) else np.zeros(0, np.int64)


def _sort_suffixes(width: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def portions() -> Iterator[pa.Table]:
            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += batch.column("bytes").nbytes
                if size >= PORTION:
                    table = pa.Table.from_batches(held)
                    name = table["name"].to_numpy()
                    edges = np.flatnonzero(name[1:] != name[:-1]) + 1
                    taken = np.cumsum(pa.compute.binary_length(table["bytes"]).to_numpy())
                    begin = 0
                    for edge in edges:  # whole grams only; the last one may go on in the next batch
                        if taken[edge - 1] - (taken[begin - 1] if begin else 0) >= PORTION or edge == edges[-1]:
                            yield table.slice(begin, edge - begin)
                            begin = edge
                    rest = table.slice(begin).combine_chunks()
                    held, size = rest.to_batches(), rest.nbytes if len(edges) else 0
            if held:
                yield pa.Table.from_batches(held)

        for table in portions():
            for key, doc, start, pieces in _halves(table, width):
                found, span = _repeated_suffixes(key, doc, start, pieces, width)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(span, pa.int64())], names=["doc", "span"])

    return run


def _removed(width: int, whole_characters: bool):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in unpacked_slices(batch):
                data, offsets = text_buffer(part["text"])
                n = len(data)
                change = np.zeros(n + 1, np.int64)
                for column in ("spans", "sorted"):
                    lists = part[column].combine_chunks()
                    counts = lists.value_lengths().fill_null(0).to_numpy()
                    begin, more, flag = unpack_span(lists.flatten().to_numpy())
                    text = np.repeat(np.arange(part.num_rows), counts)
                    at = offsets[text] + begin
                    ok = (flag == 0) & (at + more + width <= offsets[text + 1])
                    np.add.at(change, at[ok], 1)
                    np.add.at(change, (at + more + width)[ok], -1)
                whole = part["copy"].combine_chunks().fill_null(False).to_numpy(zero_copy_only=False) & (np.diff(offsets) >= width)
                change[offsets[:-1][whole]] += 1
                np.add.at(change, offsets[1:][whole], -1)
                gone = np.cumsum(change)[:n] > 0
                if whole_characters and n:
                    begins = np.flatnonzero((data & 0xC0) != 0x80)
                    gone = np.repeat(np.logical_or.reduceat(gone, begins), np.diff(np.append(begins, n)))
                head = gone.copy()
                head[1:] &= ~gone[:-1]
                edges = offsets[:-1][np.diff(offsets) > 0]
                head[edges] = gone[edges]
                sums = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (gone, head)]
                removed, spans = (s[offsets[1:]] - s[offsets[:-1]] for s in sums)
                left = np.ascontiguousarray(data[~gone]) if n else data
                ends = np.cumsum(np.diff(offsets) - removed)
                kept = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64).tobytes()), pa.py_buffer(left.tobytes())])
                yield pa.RecordBatch.from_arrays([part["row"].combine_chunks(), kept.cast(pa.binary()), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], names=["row", "kept", "n_bytes", "n_removed", "n_spans"])

    return run


def exact_copies(keyed: DataFrame, width: int) -> DataFrame:
    """doc and the digests of its texts that a smaller document has too (copies of less than width bytes do not matter)."""
    slim = keyed.filter(F.octet_length("text") >= width).select("doc", "whole")
    owners = slim.groupBy("whole").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).filter("owner < last")
    return slim.join(owners.select("whole", "owner"), "whole").filter("doc > owner").groupBy("doc").agg(F.collect_set("whole").alias("copied"))


def remove_repeats(docs: DataFrame, width: int = 50, whole_characters: bool = False) -> DataFrame:
    """docs without text, with its kept bytes and columns n_bytes, n_removed and n_spans.

    With whole_characters, a character that loses a byte goes as a whole, so that what is kept is text.
    """
    others = [c for c in docs.columns if c not in ("text", "kept", "n_bytes", "n_removed", "n_spans")]
    # the other columns travel as one, so that their names can't clash with those used here
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), "text", F.struct(*others).alias("row"), F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("whole"))
    dealt = pack_texts(keyed).repartition("doc")  # all its columns go everywhere, so that one shuffle serves all three uses
    copies = exact_copies(keyed, width).hint("shuffle_hash")
    copy = F.coalesce(F.array_contains("copied", F.col("whole")), F.lit(False))
    own = dealt.join(copies, "doc", "left").filter(~copy).drop("copied")
    rows = own.mapInArrow(_rows_of(width), "name long, doc long, digest long, span long")
    spans = repeats_by_gram(rows).hint("shuffle_hash")
    to_sort = dealt.join(spans.filter(_flagged(1)), "doc")
    pieces = to_sort.mapInArrow(_bytes_of(width), "name long, doc long, start long, gram_at int, bytes binary")
    found = pieces.repartition("name").sortWithinPartitions("name").mapInArrow(_sort_suffixes(width), "doc long, span long")
    strings = dealt.join(spans.filter(_flagged(2)), "doc").mapInArrow(_strings_of(width), "one long, two long, doc long, span long")
    found = found.unionByName(repeated_strings(strings))
    found = found.groupBy("doc").agg(F.collect_list("span").alias("sorted")).hint("shuffle_hash")
    joined = dealt.join(copies, "doc", "left").join(spans, "doc", "left").join(found, "doc", "left").withColumn("copy", copy)
    schema = keyed.select("row").schema
    for name, kind in (("kept", "binary"), ("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long")):
        schema = schema.add(name, kind)
    result = joined.select("row", "doc", "text", "copy", "spans", "sorted").mapInArrow(_removed(width, whole_characters), schema)
    return result.select("row.*", "kept", "n_bytes", "n_removed", "n_spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM h)),
f AS (SELECT g, min(doc_id) AS o FROM g GROUP BY g HAVING count(DISTINCT doc_id) > 1),
r AS (SELECT g.doc_id, g.i FROM g JOIN f ON f.g = g.g WHERE g.doc_id > f.o),
o AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
q AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o),
s AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM q GROUP BY doc_id, k),
c AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS y FROM s),
t AS (SELECT c.doc_id, sum(z - a) AS gone, count(*) AS spans, max(z) AS tail, string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) AS head FROM c JOIN h ON h.doc_id = c.doc_id GROUP BY c.doc_id)
SELECT h.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256 FROM h LEFT JOIN t ON t.doc_id = h.doc_id
"""
