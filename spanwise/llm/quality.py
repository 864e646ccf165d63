"""Quality rules: base counts, and divergence from language references.

A document's histogram of character classes and its histogram of common words are compared
with those of its language by the Jensen-Shannon distance (base 2, from 0 to 1).  Every
language has its own reference, the sum over all its documents, however few they are: the
references are a table that joins the documents, broadcast only if it is found small.
They are not smoothed towards each other, as a script of its own would then be far from
its own language.  Rows without a language (null or empty) use the sum over all documents.
A document shorter than ``least_chars`` characters or ``least_words`` words is not judged
by its characters or words: short histograms are far from any reference by chance.

Base counts are those of whole texts.  Nulls: a null text has no words and fails the base
rule; null doc_ids stay.  Repeated rows are judged alike, and count as often in references.
A distance or share just at its limit passes.  Very long texts are read whole.  Extra
columns stay if asked for, but for those named as the new ones, whatever their names; an
empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Words, ensure_checkpoint_dir, hash_ranges, mix, read_table, released, split_words, text_buffer, text_slices

#: Guards and limits of the divergence rule.
LEAST_CHARS, LEAST_WORDS, MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 200, 100, 0.2, 0.45
#: Languages up to which their references (under a kilobyte each) are broadcast.
BROADCAST_LANGUAGES = 4096
#: Base rule: least words, and percent of words in repeated windows.
BASE_WORDS, BASE_REPEATED, REPEAT_WINDOW = 10, 20, 5

# The common words counted, of all languages in one histogram.
COMMON_WORDS = """
the of and to in is that it was for on are with as at be this by an not
der die das und ist von den mit zu im auf nicht ein eine sich des dem
le la les des et est une dans que qui pour du pas sur un en
el los las y una por con para es se al lo como no de a
""".split()

# Character classes by byte; a byte that continues a character counts for none.
CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "inner", "quote", "bar", "mark", "symbol", "control", "wide")
_CLASS_OF = np.full(256, CLASSES.index("wide"), np.uint8)
for _name, _bytes in {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t", "line": b"\n\r",
    "stop": b".?", "inner": b",;:", "quote": b"\"'()[]{}-", "bar": b"|/\\_", "mark": b"!", "symbol": b"#*$%&<>+=@^~`",
    "control": bytes([*range(9), 11, 12, *range(14, 32), 127]),
}.items():
    _CLASS_OF[list(_bytes)] = CLASSES.index(_name)
_CLASS_OF[0x80:0xC0] = len(CLASSES)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring edges."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[edges[1:]] - total[edges[:-1]]


def char_histogram(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, width = len(offsets) - 1, len(CLASSES) + 1
    text = np.repeat(np.arange(n, dtype=np.int64) * width, np.diff(offsets))
    return np.bincount(text + _CLASS_OF[data], minlength=n * width).reshape(n, width)[:, :-1]


def _common_table() -> tuple[np.ndarray, np.ndarray]:
    words = list(dict.fromkeys(COMMON_WORDS))
    data = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w.encode()) for w in words])
    hashes = hash_ranges(data, np.concatenate([[0], end[:-1]]), end)
    order = np.argsort(hashes)
    return hashes[order], order


def word_histogram(words: Words) -> np.ndarray:
    """Counts of each common word, and of all others together; case and a closing mark do not count."""
    known, number = _common_table()
    lower = _LOWER[words.data]
    closing = np.isin(words.data[words.end - 1], list(b".,;:!?")) & (words.end - words.start > 1) if len(words.end) else np.zeros(0, bool)
    hashes = hash_ranges(lower, words.start, words.end - closing)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    slot = np.where(known[at] == hashes, number[at], len(known)) if len(hashes) else np.zeros(0, np.int64)
    n, width = len(words.first) - 1, len(known) + 1
    return np.bincount(words.of_text() * width + slot, minlength=n * width).reshape(n, width)


def duplicate_lines(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Per text, its lines with a word that equal an earlier line of it."""
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))  # a break closing a text starts an empty line there
    text = np.searchsorted(offsets[1:], start, side="right")
    ends = np.sort(np.concatenate([offsets[1:], breaks]))
    keep = (text < len(offsets) - 1) & (ends > start)
    start, ends, text = start[keep], ends[keep], text[keep]
    words = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    keep = words[ends] > words[start]
    start, ends, text = start[keep], ends[keep], text[keep]
    line = mix(hash_ranges(data, start, ends) + mix(text.astype(np.uint64)))
    _, first = np.unique(line, return_index=True)
    return np.bincount(text, minlength=len(offsets) - 1) - np.bincount(text[first], minlength=len(offsets) - 1)


def repeated_words(words: Words, hashes: np.ndarray, window: int = REPEAT_WINDOW) -> np.ndarray:
    """Per text, its words in windows that occur twice or more in it."""
    n, text = len(hashes), words.of_text()
    at = np.flatnonzero(np.arange(n) + window <= words.first[1:][text]) if n else np.zeros(0, np.int64)
    h = mix(text[at].astype(np.uint64) + np.uint64(1))
    for j in range(window):
        h = mix((h ^ hashes[at + j]) * np.uint64(0x9E3779B97F4A7C15))
    _, which, counts = np.unique(h, return_inverse=True, return_counts=True)
    again = at[counts[which] > 1] if len(at) else at
    change = np.zeros(n + window + 1, np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + window, -1)
    return _sums(np.cumsum(change)[:n] > 0, words.first)


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    words = split_words(data, offsets)
    inside = (data != 32) & ((data < 9) | (data > 13))
    return {
        "n_words": words.count(),
        "word_chars": _sums(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _sums(_SYMBOL[data], offsets),
        "n_dup_lines": duplicate_lines(data, offsets, inside),
        "n_repeat_words": repeated_words(words, hash_ranges(data, words.start, words.end)),
    }


def jensen_shannon(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Distance of each row of counts to its row of the reference, base 2; 0 for empty rows."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    q = reference / np.maximum(reference.sum(axis=1, keepdims=True), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip(bits.sum(axis=1) / 2, 0, 1)), 0.0)


def language_references(docs: DataFrame) -> DataFrame:
    """Summed histograms (character classes, then words) of each language over all documents; lang "" has those of all together."""
    ensure_checkpoint_dir(docs.sparkSession)

    @released
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                data, offsets = text_buffer(part["text"])
                both = np.hstack([char_histogram(data, offsets), word_histogram(split_words(data, offsets))])
                langs, which = np.unique(np.array(part["lang"].to_pylist(), object).astype(str), return_inverse=True)
                total = np.zeros((len(langs), both.shape[1]), np.int64)
                np.add.at(total, which, both)
                yield pa.RecordBatch.from_arrays([pa.array(langs.tolist(), pa.string()), pa.array(list(total), pa.list_(pa.int64()))], names=["lang", "counts"])

    parts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text").mapInArrow(sums, "lang string, counts array<long>")
    width = len(CLASSES) + len(set(COMMON_WORDS)) + 1
    added = F.array(*[F.sum(F.col("counts")[i]) for i in range(width)]).alias("counts")
    by_language = parts.groupBy("lang").agg(added).checkpoint()
    together = by_language.groupBy(F.lit("").alias("lang")).agg(added)
    return by_language.filter("lang <> ''").unionByName(together)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
JUDGED = ("base_failed", "kept", "char_distance", "word_distance")


def judge(docs: DataFrame, references: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """The given columns (doc_id by default), base counts, distances and verdicts of each document."""
    columns = [c for c in columns or ["doc_id"] if c not in (*BASE, *JUDGED)]
    references = (language_references(docs) if references is None else references).select("lang", "counts").checkpoint()
    if references.count() <= BROADCAST_LANGUAGES:
        references = F.broadcast(references)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                data, offsets = text_buffer(part["text"])
                base = base_counts(data, offsets)
                words = word_histogram(split_words(data, offsets))
                chars = char_histogram(data, offsets)
                reference = part["counts"].combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1).astype(np.float64)
                char_distance = jensen_shannon(chars, reference[:, : len(CLASSES)])
                word_distance = jensen_shannon(words, reference[:, len(CLASSES) :])
                known = part["known"].combine_chunks().to_numpy(zero_copy_only=False)
                failed = (base["n_words"] < BASE_WORDS) | (100 * base["n_repeat_words"] > BASE_REPEATED * base["n_words"])
                far = ((chars.sum(axis=1) >= LEAST_CHARS) & (char_distance > MOST_CHAR_DISTANCE)) | ((base["n_words"] >= LEAST_WORDS) & (word_distance > MOST_WORD_DISTANCE))
                far &= known
                yield pa.RecordBatch.from_arrays(
                    [part["row"].combine_chunks(), *(pa.array(base[k].astype(np.int64)) for k in BASE), pa.array(failed), pa.array(~failed & ~far), pa.array(char_distance, mask=~known), pa.array(word_distance, mask=~known)],
                    names=["row", *BASE, *JUDGED],
                )

    # the given columns travel as one, so that their names can't clash with those used here
    rows = docs.select(F.struct(*columns).alias("row"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text").join(references, "lang", "left")
    # a language that given references lack: no distances, judged by the base rule alone
    width = len(CLASSES) + len(set(COMMON_WORDS)) + 1
    rows = rows.withColumns({"known": F.col("counts").isNotNull(), "counts": F.coalesce("counts", F.array_repeat(F.lit(0).cast("long"), width))})
    schema = rows.select("row").schema
    for name in BASE:
        schema = schema.add(name, "long")
    for name, kind in zip(JUDGED, ("boolean", "boolean", "double", "double"), strict=True):
        schema = schema.add(name, kind)
    return rows.select("row", "text", "counts", "known").mapInArrow(run, schema).select("row.*", *BASE, *JUDGED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "lang")
    return judge(docs)
