"""Similarity joins of short texts: exact filters on shared letter runs before any ratio is worked out."""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from ..functions.text import fold, folded
from .checkpoints import Rounds

#: Two texts of at least this ratio are one; a shorter text of at least this share in a row is a piece.
SAME, PIECE = 0.9, 0.9
#: Letters of a run.
RUN = 3
MIDDLE = 8
#: Titles of at most so many letters in all are known to every task; more meet the elements by joins.
LETTERS = 1 << 21
#: Letters of titles that are counted in one table.
BLOCK = 1 << 17


@lru_cache(maxsize=1024)
def _places(text: str) -> dict[str, int]:
    """Where each letter stands in a text, as bits."""
    found: dict[str, int] = {}
    for i, c in enumerate(text):
        found[c] = found.get(c, 0) | 1 << i
    return found


def _in_order(x: str, y: str, least: int) -> bool:
    """Whether two texts have ``least`` letters in common in one order: as many as matching blocks hold, or more.

    The lengths of common subsequences by bits, a letter of x at a time (Hyyrö, "Bit-parallel
    LCS-length computation revisited", 2004); it ends once too many letters are left out.
    """
    places, every = _places(y), (1 << len(y)) - 1
    row, spare = every, len(x) - least
    for i, c in enumerate(x, 1):
        here = row & places.get(c, 0)
        row = ((row + here) | (row - here)) & every
        if not i % 16 and i - (len(y) - row.bit_count()) > spare:
            return False
    return len(y) - row.bit_count() >= least


def _alike(x: str, y: str) -> float:
    if not _in_order(x, y, math.ceil((len(x) + len(y)) * (SAME / 2) - 1e-9)):
        return 0.0
    return difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()


def _whole_in(p: str, w: str) -> bool:
    size = -(-9 * len(p) // 10)
    return any(p[i : i + size] in w for i in range(len(p) - size + 1))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters, or 0 where that is surely below the bound."""
    return pd.Series([_alike(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(BooleanType())
def _holds(piece: pd.Series, whole: pd.Series) -> pd.Series:
    """Whether nine tenths of a piece stand in a row in the whole text."""
    return pd.Series([_whole_in(p, w) for p, w in zip(piece, whole, strict=True)], dtype="bool")


def _grams(text: Column) -> Column:
    """The distinct runs of a text, as hashes; none of a text shorter than a run."""
    n = F.length(text)
    return F.when(n >= RUN, F.array_distinct(F.transform(F.sequence(F.lit(1), n - RUN + 1), lambda i: F.xxhash64(F.substring(text, i, F.lit(RUN)))))).otherwise(F.array().cast("array<long>"))


def similar(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str) -> DataFrame:
    """(left_id, right_id, ratio) of all pairs of texts with a ratio of at least ``SAME``.

    Different texts meet by their lengths, which differ by a bounded share.  With m letters
    matched, a text of n letters keeps all runs but ``RUN`` for each of its other letters and
    ``RUN`` - 1 for each other letter of its partner; pairs that share fewer runs are left out
    before any ratio is worked out.
    """
    most = SAME / (2 - SAME)
    left_ids, right_ids = (rows.select(F.col(ident).alias(ident), F.col(text).alias(name)).filter(F.col(name) != "") for rows, ident, name in ((left, left_id, "_ta"), (right, right_id, "_tb")))
    given = right_ids.select("_tb").distinct().withColumn("_lb", F.length("_tb"))
    fits = F.sequence(F.ceil(F.col("_lb") * most - 1e-9).cast("int"), F.floor(F.col("_lb") / most + 1e-9).cast("int"))
    lengths = given.select(F.explode(fits).alias("_la")).distinct()
    asked = left_ids.select("_ta").distinct().withColumn("_la", F.length("_ta")).join(lengths, "_la", "left_semi")
    place = [F.floor(F.log(F.col(c).cast("double")) / (math.log(1 / most) + 1e-9)) for c in ("_la", "_lb")]
    a = asked.select("_ta", "_la", place[0].alias("_cell"), _grams(F.col("_ta")).alias("_ga"))
    b = given.select("_tb", "_lb", F.explode(F.array(*[place[1] + i for i in (-1, 0, 1)])).alias("_cell"), _grams(F.col("_tb")).alias("_gb"))
    both = F.col("_la") + F.col("_lb")
    matched = F.ceil(both * (SAME / 2) - 1e-9)
    least = F.greatest(*[F.size(g) - RUN * (F.col(n) - matched) - (RUN - 1) * (F.col(o) - matched) for g, n, o in (("_ga", "_la", "_lb"), ("_gb", "_lb", "_la"))])
    near = a.join(b, "_cell").filter(2 * F.least("_la", "_lb") >= SAME * both - 1e-9).filter(F.size(F.array_intersect("_ga", "_gb")) >= least)
    alike = near.select("_ta", "_tb", _ratio("_ta", "_tb").alias("ratio")).filter(F.col("ratio") >= SAME)
    return alike.join(left_ids, "_ta").join(right_ids, "_tb").select(left_id, right_id, "ratio")


def _middle(text: Column) -> tuple[Column, Column]:
    """Size and letters of the run in the middle that any nine tenths of a text in a row hold."""
    size = F.greatest(F.lit(1), F.least(F.lit(MIDDLE), F.floor(F.length(text) * 0.8).cast("int")))
    return size, F.substring(text, (F.floor((F.length(text) - size) / 2) + 1).cast("int"), size)


def pieces(rows: DataFrame, wholes: DataFrame, ident: str, whole: str, text: str) -> DataFrame:
    """(ident, whole) where a text is a piece of a longer one: shorter than nine tenths of it, and nine tenths of it in a row there."""
    asked = rows.filter(F.length(text) > 0).select(F.col(ident).alias("_id"), F.col(text).alias("_text"))
    size, letters = _middle(F.col("_text"))
    asked = asked.withColumns({"_size": size, "_run": letters})
    n = F.length("_whole")
    given = wholes.filter(F.length(text) > 0).select(F.col(whole).alias("_of"), F.col(text).alias("_whole"))
    held = given.withColumn("_size", F.explode(F.sequence(F.lit(1), F.least(F.lit(MIDDLE), n)))).select("_of", "_size", F.explode(F.transform(F.sequence(F.lit(1), n - F.col("_size") + 1), lambda i: F.substring(F.col("_whole"), i, F.col("_size")))).alias("_run")).distinct()
    met = asked.join(held, ["_size", "_run"]).join(given, "_of").filter(F.length("_text") < PIECE * n)
    return met.filter(_holds("_text", "_whole")).select(F.col("_id").alias(ident), F.col("_of").alias(whole))


def _runs(text: str) -> np.ndarray:
    """The runs of a text as numbers, equal where the runs are."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return (letters[:-2] << 42) | (letters[1:-1] << 21) | letters[2:]


class _Titles:
    """Titles of like length with how often each holds each run."""

    def __init__(self, texts: list[str]):
        self.texts, self.sizes = texts, np.array([len(t) for t in texts])
        found = [np.unique(_runs(t), return_counts=True) for t in texts]
        self.runs = np.unique(np.concatenate([r for r, _ in found]))
        most = max((int(n.max(initial=0)) for _, n in found), default=0)
        self.counts = np.zeros((len(self.runs), len(texts)), np.uint8 if most < 256 else np.uint32)
        for i, (runs, n) in enumerate(found):
            self.counts[np.searchsorted(self.runs, runs), i] = n

    def near(self, text: str, runs: np.ndarray, counts: np.ndarray) -> list[str]:
        """The titles that may be of the least ratio: of fitting length and with enough runs in common.

        With m letters matched, a text keeps all runs but ``RUN`` for each of its other letters and
        ``RUN`` - 1 for each other letter of its partner, repeated ones counted.
        """
        both = self.sizes + len(text)
        lo, hi = np.searchsorted(self.sizes, [len(text) * SAME / (2 - SAME) - 1e-6, len(text) * (2 - SAME) / SAME + 1e-6])
        fits = np.arange(lo, hi)
        fits = fits[2 * np.minimum(self.sizes[fits], len(text)) >= SAME * both[fits] - 1e-9]
        if not len(fits):
            return []
        shared = np.zeros(len(fits), np.int64)
        if len(self.runs) and len(runs):
            at = np.minimum(np.searchsorted(self.runs, runs), len(self.runs) - 1)
            known = self.runs[at] == runs
            limit = np.minimum(counts[known], np.iinfo(self.counts.dtype).max).astype(self.counts.dtype)
            shared = np.minimum(self.counts[at[known], fits[0] : fits[-1] + 1], limit[:, None]).sum(axis=0, dtype=np.int64)[fits - fits[0]]
        matched = np.ceil(both[fits] * (SAME / 2) - 1e-9)
        least = (2 * RUN - 1) * matched - (RUN - 1) * both[fits] - (RUN - 1)
        return [self.texts[i] for i in fits[shared >= least].tolist()]


def _met(titles: list[str]):
    """A function that gives, for a text, the titles that are alike and their ratios, and those that it is a piece of (ratio: none)."""
    texts = sorted(set(titles), key=lambda t: (len(t), t))
    blocks: list[list[str]] = [[]]
    held = 0
    for t in texts:
        if held + len(t) > BLOCK and blocks[-1]:
            blocks.append([])
            held = 0
        blocks[-1].append(t)
        held += len(t)
    tables = [_Titles(b) for b in blocks if b]
    longest = len(texts[-1]) if texts else 0
    holders: dict[str, list[str]] = {}
    for t in texts:
        for run in {t[i : i + MIDDLE] for i in range(len(t) - MIDDLE + 1)}:
            holders.setdefault(run, []).append(t)

    @lru_cache(maxsize=1 << 14)
    def of(text: str) -> list[tuple[str, float | None]]:
        runs, counts = np.unique(_runs(text), return_counts=True)
        alike = {t: r for table in tables for t in table.near(text, runs, counts) if (r := _alike(text, t)) >= SAME}
        size = int(len(text) * 0.8)  # any nine tenths in a row hold so many letters of the middle
        begin = (len(text) - MIDDLE) // 2
        wholes = holders.get(text[begin : begin + MIDDLE], []) if size >= MIDDLE else texts
        pieces = [t for t in wholes if len(text) < PIECE * len(t) and t not in alike and _whole_in(text, t)]
        return [*alike.items(), *((t, None) for t in pieces)]

    return lambda text: of(text) if text and len(text) <= longest * (2 - SAME) / SAME + 1e-6 else []


def _met_in_tasks(elements: DataFrame, titles: list[str], ident: str, text: str, span: str) -> DataFrame:
    """(ident, span, _t, ratio) of the elements and titles that are alike, without a ratio where the element is a piece: each element looked at once, where it is read."""
    rows = elements.select(ident, span, text)
    schema = StructType([*rows.select(ident, span).schema, StructField("_t", StringType()), StructField("ratio", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _met(titles)
        for batch in batches:
            found = [(i, *m) for i, s in enumerate(batch.column(2).to_pylist()) if s is not None for m in met(fold(s))]
            if found:
                at, whole, ratio = zip(*found, strict=True)
                kept = batch.select([0, 1]).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(whole, pa.string()), pa.array(ratio, pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def title_integrity(elements: DataFrame, titles: DataFrame, ident: str, title: str, text: str, span: str) -> DataFrame:
    """Per title: whether an element holds it whole, which one (the longest seen, then the most alike), how many more do, and its pieces.

    Texts are compared in compatibility form, case folded, white space collapsed.
    """
    rounds = Rounds(elements.sparkSession)
    gold = rounds.keep(titles.select(title, folded(text).alias("_t")), "gold")
    texts = gold.filter("_t <> ''").select("_t").distinct()
    best = F.max(F.struct(span, "ratio", (-F.col(ident)).alias("_less"))).alias("_best")
    if (texts.agg(F.sum(F.length("_t"))).first()[0] or 0) <= LETTERS:
        met = rounds.keep(_met_in_tasks(elements, [r[0] for r in texts.collect()], ident, text, span), "met").join(gold, "_t")
        alike, parts = met.filter("ratio is not null"), met.filter("ratio is null")
    else:
        shown = rounds.keep(elements.select(ident, span, folded(text).alias("_t")).filter("_t <> ''"), "shown")
        alike = rounds.keep(similar(shown, gold, ident, title, "_t").join(shown.select(ident, span), ident), "alike")
        parts = pieces(shown, gold, ident, title, "_t").join(alike.select(ident, title), [ident, title], "left_anti")
    whole = alike.groupBy(title).agg(best, (F.count(F.lit(1)) - 1).alias("duplicates"))
    broken = parts.groupBy(title).agg(F.count(F.lit(1)).alias("fragments"), F.sort_array(F.collect_list(ident)).alias("fragment_ids"))
    found = titles.select(title).join(whole, title, "left").join(broken, title, "left")
    none = F.array().cast(broken.schema["fragment_ids"].dataType)
    return found.select(title, F.col("_best").isNotNull().alias("whole"), (-F.col("_best._less")).alias("element"), F.round("_best.ratio", 3).alias("ratio"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("duplicates", "fragments")], F.coalesce("fragment_ids", none).alias("fragment_ids"))
