"""Best-fit decreasing packing of tokenised documents into fixed-length sequences.

Tokenising runs where the documents are read; only piece rows of a few numbers are
shuffled.  All pieces are packed together, not shard by shard: pieces of one length are
alike to best fit, so the packing needs only how many there are of each length, at most
``capacity`` numbers.  From these, best-fit decreasing is run by whole ranges: a segment
tree over the remaining capacities finds the tightest open room in a logarithm of the
capacity, and all open sequences with that room and a common past take their pieces in one
step.  The steps are runs (length, first rank, first sequence, offset, pieces a sequence);
a piece finds its run by its rank among those of its length.  Ranks come from counts by
length and block of pieces, so neither a common length nor a long document fills one task.
The packing is that of one best-fit decreasing pass over all pieces, whatever their number
and however the tasks are dealt.

Nulls: a null text is empty and gives one piece that holds only the end id.  Repeated
rows are packed as often as they occur, rows with a null doc_id as well.  Pieces of one
length are ranked by block, doc_id, piece and checksum; those that agree in all are alike.
Very long texts are tokenised whole.  Extra columns are ignored, whatever their names; an
empty table gives none.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Words, ensure_checkpoint_dir, hash_ranges, read_table, released, split_words, text_buffer, text_slices, worker_state

#: Distinct words whose ids a worker remembers (about 45 bytes each) before it starts anew.
CACHED_WORDS = 400_000
#: Bytes of text whose distinct words are looked up together.
SLICE_BYTES = 1_000_000
#: Pieces of one block, the unit of ranking.
BLOCK_PIECES = 1024

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def folds_and_parts(path: str) -> bool:
    """Whether a tokenizer file drops white space, folds case, and cuts runs of letters from marks.

    Only then are a text's ids its words' ids in a row, and only then may words be folded
    and marks parted from them beforehand.
    """
    with open(path, encoding="utf-8") as file:
        told = json.load(file)

    def kinds(part: dict | None, inner: str) -> list[dict]:
        return [] if not part else [x for y in part[inner] for x in kinds(y, inner)] if part["type"] == "Sequence" else [part]

    folds = any(x["type"] == "Lowercase" for x in kinds(told["normalizer"], "normalizers"))
    splits = [x for x in kinds(told["pre_tokenizer"], "pretokenizers") if x["type"] == "Split"]
    parts = any(x["invert"] and x["behavior"] == "Removed" and r"[\p{L}]+" in (rule := x["pattern"].get("Regex", "").split("|")) and r"[^\s\p{L}\p{N}]+" in rule for x in splits)
    spaced = any(x.get("add_prefix_space") for x in kinds(told["pre_tokenizer"], "pretokenizers"))
    return folds and parts and not spaced


class WordEncoder:
    """Token ids of words by one tokenizer, remembered by word.

    The tokenizer's normaliser and splitter never look across white space (folds_and_parts
    checks that), so a text's ids are its words' ids in a row.  New words are encoded
    together, parted by a special token that the tokenizer cuts at before anything else.
    """

    def __init__(self, path: str, separator: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = separator
        self.separator_id = self.tokenizer.token_to_id(separator)
        self.forget()

    def forget(self) -> None:
        self.hashes, self.checks, self.places = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode("utf-8") for w in words]
        odd = [i for i, t in enumerate(texts) if "<|" in t]
        plain = self.separator.join("" if "<|" in t else t for t in texts)
        ids = np.array(self.tokenizer.encode_batch_fast([plain], add_special_tokens=False)[0].ids, np.uint32)
        cut = ids == self.separator_id
        counts = np.bincount(np.cumsum(cut)[~cut], minlength=len(words))
        ids = ids[~cut]
        if odd:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in odd:
                parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
                counts[i] = len(parts[i])
            ids = np.concatenate(parts).astype(np.uint32)
        return ids, counts

    def numbers(self, hashes: np.ndarray, checks: np.ndarray, word: Callable[[int], bytes]) -> np.ndarray:
        """A number for each word, to look its ids up by; words are known by two 64-bit hashes (hashes ascend)."""
        if len(self.hashes) > CACHED_WORDS:
            self.forget()
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        same = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        known = same & (self.checks[at] == checks) if len(self.hashes) else same
        numbers = np.zeros(len(hashes), np.int64)
        numbers[known] = self.places[at[known]]
        new = np.flatnonzero(~known)
        for begin in range(0, len(new), 20_000):
            part = new[begin : begin + 20_000]
            ids, counts = self._encode([word(i) for i in part.tolist()])
            numbers[part] = len(self.ends) + np.arange(len(part))
            self.ends = np.concatenate([self.ends, len(self.ids) + np.cumsum(counts)])
            self.ids = np.concatenate([self.ids, ids])
        keep = np.flatnonzero(~same)  # of two words with one first hash only one is remembered
        place = np.searchsorted(self.hashes, hashes[keep])
        self.hashes, self.checks, self.places = (np.insert(old, place, more[keep]) for old, more in ((self.hashes, hashes), (self.checks, checks), (self.places, numbers)))
        return numbers


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def part_marks(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of words, with ASCII marks that follow a word's last letter parted from it.

    The tokenizer cuts between a letter and a mark in any case, so the ids stay the same and
    far fewer words are distinct.  Letters are those of ASCII, and of U+00C0 to U+024F but
    for the two signs there and U+0130, whose small form ends in a mark; any other word stays whole.  Also gives the first range of each text.
    """
    data, place = words.data, np.arange(len(words.data))
    before = np.maximum.accumulate(np.where(_PUNCTUATION[data], -1, place))[words.end - 1] if len(words.end) else words.end
    at = np.maximum(before, 0)
    lead, last = data[np.maximum(at - 1, 0)] if len(data) else at, data[at] if len(data) else at
    wide = (at > words.start) & (last >= 0x80) & (last < 0xC0) & (((lead == 0xC3) & (last != 0x97) & (last != 0xB7)) | ((lead >= 0xC4) & (lead <= 0xC9) & ((lead != 0xC4) | (last != 0xB0))))
    cut = (before >= words.start) & (before < words.end - 1) & (_LETTER[last] | wide)
    places = np.flatnonzero(cut)
    start, end = np.insert(words.start, places + 1, before[places] + 1), np.insert(words.end, places, before[places] + 1)
    return start, end, words.first + np.concatenate([[0], np.cumsum(cut)])[words.first]


def encode_texts(encoder: WordEncoder, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each closed by end_id, and the place where each text ends.

    The tokenizer folds case; folding ASCII first and parting marks leaves fewer words,
    unless a text may hold a special token, which would be changed or cut.
    """
    raw = data.tobytes()
    if b"<|" in raw:
        words = split_words(data, offsets)
        start, end, begins_at = words.start, words.end, words.first
    else:
        raw = raw.lower()
        start, end, begins_at = part_marks(split_words(np.frombuffer(raw, np.uint8), offsets))
        data = np.frombuffer(raw, np.uint8)
    hashes, first, which = np.unique(hash_ranges(data, start, end), return_index=True, return_inverse=True)
    begin, stop = start[first].tolist(), end[first].tolist()
    numbers = encoder.numbers(hashes, hash_ranges(data, start[first], end[first], 1), lambda i: raw[begin[i] : stop[i]])
    ends = np.concatenate([encoder.ends, [len(encoder.ids) + 1]])  # the last entry is end_id
    flat = np.concatenate([encoder.ids, np.array([end_id], np.uint32)])
    begins = np.concatenate([[0], ends[:-1]])
    sequence = np.insert(numbers[which], begins_at[1:], len(ends) - 1)
    counts = (ends - begins)[sequence]
    out_end = np.cumsum(counts)
    ids = flat[np.repeat(begins[sequence] - (out_end - counts), counts) + np.arange(out_end[-1] if len(out_end) else 0)]
    closes = begins_at[1:] + np.arange(len(begins_at) - 1)
    return ids, out_end[closes]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, separator: str = "<|endoftext|>") -> DataFrame:
    """Tokenise whole texts, close each by end_id and cut those longer than capacity into pieces of it."""
    if not folds_and_parts(tokenizer_path):
        raise ValueError(f"{tokenizer_path} does not fold case and part letters from marks; its ids can't be looked up word by word")

    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, key = worker_state(), ("word encoder", tokenizer_path, separator)
        if key not in kept:
            kept[key] = WordEncoder(tokenizer_path, separator)
        encoder = kept[key]
        for batch in batches:
            for part in text_slices(batch, size=SLICE_BYTES):
                data, offsets = text_buffer(part["text"])
                ids, ends = encode_texts(encoder, data, offsets, end_id)
                lengths = np.diff(np.concatenate([[0], ends]))
                counts = -(-lengths // capacity)
                row = np.repeat(np.arange(len(lengths)), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * capacity
                length = np.minimum(capacity, lengths[row] - start)
                place = ((ends - lengths)[row] + start) * 4
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(raw[a : a + 4 * n]) for a, n in zip(place.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"].combine_chunks().take(pa.array(row)) if row.size else pa.array([], pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


class CapacityTree:
    """Segment tree over remaining capacities; a leaf tells whether an open sequence has just that much room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.size)

    def put(self, room: int, there: bool) -> None:
        tree, i = self.open, self.size + room
        tree[i] = there
        while i > 1:
            i >>= 1
            now = tree[2 * i] | tree[2 * i + 1]
            if tree[i] == now:
                return
            tree[i] = now

    def tightest(self, need: int) -> int:
        """The smallest room of at least need, or -1."""
        tree, i = self.open, self.size + need
        if tree[i]:
            return need
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


@dataclass
class Run:
    """Where the pieces of one length from rank ``rank`` on go: ``each`` of them into every sequence from ``first`` on."""

    length: int
    rank: int
    first: int
    offset: int
    each: int


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing over so many pieces of each length, by ranges of sequences with one room.

    A piece goes where the room is tightest.  What it leaves there is tighter still, so the
    next piece of its length follows it as long as it fits: every sequence of a range takes
    ``room // length`` pieces before the next one gets any.
    """
    tree = CapacityTree(capacity)
    ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (first sequence, sequences) by room
    runs, made = [], 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if not ranges[room]:
                tree.put(room, True)
            ranges[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                room = capacity
                first, n = made, -(-left // (capacity // length))
                made += n
            else:
                first, n = ranges[room].pop()
                if not ranges[room]:
                    tree.put(room, False)
            each = room // length
            taken = min(left, n * each)
            runs.append(Run(length, rank, first, capacity - room, each))
            full, rest = divmod(taken, each)
            leave(room - each * length, first, full)
            leave(room - rest * length, first + full, 1 if rest else 0)
            leave(room, first + full + (1 if rest else 0), n - full - (1 if rest else 0))
            rank, left = rank + taken, left - taken
    return runs


def ranked(items: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """items with ``rank`` among those of their length, and how many there are of each length."""
    dealt = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    counts = dealt.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before")
    order = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    placed = dealt.withColumn("rank", F.row_number().over(order) - 1).join(counts.select("length", "block", before), ["length", "block"])
    return placed.withColumn("rank", F.col("rank") + F.col("before")).drop("before", "block"), counts.groupBy("length").agg(F.sum("n").alias("n"))


def pack(items: DataFrame, capacity: int = 2048, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Place pieces into sequences of at most capacity tokens."""
    ensure_checkpoint_dir(items.sparkSession)
    items = items.checkpoint()  # tokenised once; read for counting and for placing
    placed, counts = ranked(items, max(1, -(-items.count() // block_pieces)))
    runs = best_fit_runs({r["length"]: r["n"] for r in counts.collect()}, capacity)  # at most capacity rows
    table = np.array(sorted((r.length, r.rank, r.first, r.offset, r.each) for r in runs), np.int64).reshape(-1, 5)
    shared = items.sparkSession.sparkContext.broadcast(table)  # its size grows with the capacity alone

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, first, offset, each = shared.value.T
        key = length * (1 << 48) + rank
        for batch in batches:
            rows = {c: batch.column(c) for c in batch.schema.names}
            mine = rows["rank"].to_numpy()
            run = np.searchsorted(key, rows["length"].to_numpy() * (1 << 48) + mine, side="right") - 1
            nth = mine - rank[run]
            rows["sequence_id"], rows["offset"] = pa.array(first[run] + nth // each[run]), pa.array(offset[run] + nth % each[run] * length[run])
            del rows["rank"]
            yield pa.RecordBatch.from_arrays(list(rows.values()), names=list(rows))

    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PLACED)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise and pack all documents; one row per piece with its sequence and offset."""
    return pack(pieces(docs, tokenizer_path, capacity, end_id), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
