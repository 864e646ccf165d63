"""Consensus of repeated reads of one text."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.text import best_of_windows, compact, squeezed
from .match import whole_entities

#: An entity of more distinct reads is searched in parts, by several tasks; every part sees all its reads.
BLOCK = 2048
#: Up to so many pairs of a read and a candidate all are matched, which takes less than bounds.
FEW = 48
#: Letters are counted in so many classes at most.
CLASSES = 64


def _bounds(forms: list[str], each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each letter stands in each text, and how much each text holds of all at most, a letter of text j worth each[j].

    Matching blocks hold no more of a letter than the poorer of two texts, so the sum over all
    texts goes letter by letter and by counts, without pairs.
    """
    letters, of = np.unique(np.frombuffer("".join(forms).encode("utf-32-le"), np.uint32), return_inverse=True)
    classes = min(len(letters), CLASSES)
    owner = np.repeat(np.arange(len(forms)), [len(f) for f in forms])
    held = np.bincount(owner * classes + of % max(1, classes), minlength=len(forms) * classes).reshape(len(forms), classes)
    most, top = np.zeros(len(forms)), int(held.max(initial=0)) + 1
    for column in held.T:
        at_least = np.bincount(column, weights=each, minlength=top)[::-1].cumsum()[::-1]
        most += np.concatenate([[0.0], at_least[1:].cumsum()])[column]
    return held, most + [0.0 if f else e for f, e in zip(forms, each, strict=True)]  # an empty text holds itself


def _widest(forms: list[str], weights: list[int], asked: list[int]) -> tuple[int, float]:
    """Which of the asked texts holds most of all texts by their weights, the first of equals, and how much.

    A text holds a matched letter's share of another for each letter of the best window match.
    The texts that could hold most come first; a text is given up as soon as the bounds of what
    is not matched yet leave it behind the best one, so that the result is that of all pairs.
    Sums are of whole numbers over one denominator: what is equal is a tie.
    """
    sizes = [max(1, len(f)) for f in forms]
    whole = math.lcm(*set(sizes))
    worth = [w * (whole // n) for w, n in zip(weights, sizes, strict=True)]
    known: dict[tuple[int, int], int] = {}

    def met(j: int, f: int) -> int:
        """Letters of text j in text f, which are those of f in j unless they are equally long."""
        if j == f:
            return sizes[f]
        key = (f, j) if len(forms[j]) != len(forms[f]) and f < j else (j, f)
        if key not in known:
            known[key] = round(best_of_windows(forms[j], forms[f]) * min(len(forms[j]), len(forms[f])))
        return known[key]

    every = range(len(forms))
    if len(forms) * len(asked) <= FEW:
        best, first = max((sum(worth[j] * met(j, f) for j in every), -n) for n, f in enumerate(asked))
        return asked[-first], best / whole
    each = np.array([w / n for w, n in zip(weights, sizes, strict=True)])
    held, most = _bounds(forms, each)
    best, found, slack = -1, len(asked), 0.0
    for n in np.argsort(-most[asked], kind="stable").tolist():
        f = asked[n]
        if most[f] < slack:
            break
        bound = np.minimum(held, held[f]).sum(axis=1) * each
        bound[f] = sizes[f] * each[f]
        left, total = float(bound.sum()), 0
        for j in np.argsort(-bound, kind="stable").tolist():
            letters = met(j, f)
            total += worth[j] * letters
            left += letters * each[j] - bound[j]
            if left < slack:
                break
        else:
            if (total, -n) > (best, -found):
                best, found = total, n
                slack = best / whole * (1 - 1e-9) - 1e-9
    return asked[found], best / whole


def _consensus(reads: list[str], counts: list[int], part: int, parts: int) -> tuple[int, float, int] | None:
    """Of one entity's distinct reads, most common first: place of the best one, its score, and the place where its text stands first."""
    if len(reads) == 1:
        return 0, float(counts[0]), 0
    texts = [squeezed(r) for r in reads]
    weights: dict[str, int] = {}
    for t, n in zip(texts, counts, strict=True):
        weights[t] = weights.get(t, 0) + n
    places = [i for i, n in enumerate(counts) if n >= 2 or counts[0] < 2]
    if parts > 1:
        places = [i for i in places if zlib.crc32(texts[i].encode()) % parts == part]
    if not places:
        return None
    at = {t: i for i, t in enumerate(weights)}
    asked = list(dict.fromkeys(at[texts[i]] for i in places))
    best, score = _widest(list(at), list(weights.values()), asked)
    alike = [i for i in places if at[texts[i]] == best]
    return max(alike, key=lambda i: (len(reads[i].split()), -i)), score, alike[0]


def best_read(reads: DataFrame, entity: list[str], order: str, text: str) -> DataFrame:
    """The read that holds most of all reads, weighted by how often each was seen.

    Candidates are all distinct reads, or those seen twice if there are any; ties go
    to the more frequent, then to the first seen, and of reads equal but for spacing the one
    with most words wins.  White space and case aside, equal reads meet as one.  A task holds
    the distinct reads of one entity; large entities' candidates are dealt to several tasks.
    """
    counts = reads.filter(F.col(text).isNotNull()).groupBy(*entity, F.col(text).alias("read")).agg(F.count(F.lit(1)).alias("count"), F.min(order).alias("_seen"))
    parts = F.ceil(F.count(F.lit(1)).over(Window.partitionBy(*entity)) / BLOCK).cast("int")
    dealt = counts.withColumn("_parts", parts).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).repartition(*entity, "_part")
    rank = F.row_number().over(Window.partitionBy(*entity, "_part").orderBy(F.desc("count"), "_seen"))
    ranked = dealt.withColumn("_rank", rank).select(*entity, "read", "count", "_part", "_parts", "_rank").sortWithinPartitions(*entity, "_part", "_rank")
    schema = StructType([*ranked.select(*entity, "read", "count").schema, StructField("score", DoubleType()), StructField("_first", LongType())])
    kept = schema.names[:-2]

    def chosen(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        texts, seen, part, of = (rows[c].to_pylist() for c in ("read", "count", "_part", "_parts"))
        cuts = [*np.flatnonzero(rows["_rank"].to_numpy() == 1).tolist(), len(texts)]
        found = [(i, best) for i, j in zip(cuts, cuts[1:], strict=False) if (best := _consensus(texts[i:j], seen[i:j], part[i], of[i]))]
        out = rows.select(kept).take(pa.array([i + b[0] for i, b in found], pa.int64()))
        yield from out.append_column("score", pa.array([b[1] for _, b in found], pa.float64())).append_column("_first", pa.array([b[2] for _, b in found], pa.int64())).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_entities(batches):
            yield from chosen(rows)

    one = ranked.mapInArrow(run, schema).groupBy(*entity).agg(F.max(F.struct("score", (-F.col("_first")).alias("_less"), "read", "count")).alias("_best"))
    return one.select(*entity, "_best.read", "_best.count", "_best.score")


def caret_marks(reads: DataFrame, entity: list[str], text: str, full: str) -> DataFrame:
    """Per entity, distinct reads that end in a caret-like mark after a proper prefix of the full text but are none themselves."""
    # What a blinking caret is read as.
    caret = F.lit("|li1!")
    b, c = compact(F.col(full)), compact(F.col(text))
    ends = [F.instr(caret, F.substring(x, -1, 1)) > 0 for x in (b, c)]
    stem = [F.substring(x, F.lit(1), F.length(x) - 1) for x in (b, c)]
    rides = (F.length(b) >= 2) & (F.length(c) >= 2) & ends[0] & ends[1] & (F.length(c) < F.length(b)) & F.startswith(stem[0], stem[1]) & ~F.startswith(b, c)
    return reads.groupBy(*entity).agg(F.countDistinct(F.when(rides, c)).alias("carets"))


def caret_dropped(reads: DataFrame, entity: list[str], text: str, full: str, fewest: int = 2) -> DataFrame:
    """Per entity, how many reads show a caret and the full text, without its last character if that many show it."""
    lines = reads.groupBy(*entity).agg(F.first(full).alias(full))
    trimmed = F.rtrim(F.substring(F.rtrim(F.col(full)), F.lit(1), F.length(F.rtrim(F.col(full))) - 1))
    return caret_marks(reads, entity, text, full).join(lines, entity).withColumn(full, F.when(F.col("carets") >= fewest, trimmed).otherwise(F.col(full)))


def fragment_hits(items: DataFrame, docs: DataFrame, item: str, doc: str, text: str, size: int) -> DataFrame:
    """Per item, the documents that hold any of its runs of ``size`` words, and those that hold all of them.

    The runs of items are few: a document's run goes on only if its hash is one of theirs, so
    the texts of runs are made and joined for likely hits alone.
    """

    def runs(rows: DataFrame, ident: str) -> DataFrame:
        words = rows.select(ident, F.split(text, " ").alias("_w")).filter(F.size("_w") >= size)
        return words.select(ident, "_w", F.explode(F.sequence(F.lit(1), F.size("_w") - size + 1)).alias("_i"))

    key = F.xxhash64(*[F.element_at("_w", F.col("_i") + j) for j in range(size)])
    piece = F.array_join(F.slice("_w", F.col("_i"), size), " ")
    wanted = runs(items, item).select(item, key.alias("_key"), piece.alias("_piece")).distinct()
    keys = wanted.select("_key").distinct()
    likely = runs(docs, doc).withColumn("_key", key).join(keys, "_key", "left_semi").select(doc, "_key", piece.alias("_piece")).distinct()
    hits = likely.join(wanted, ["_key", "_piece"]).groupBy(item, doc).agg(F.count(F.lit(1)).alias("_n"))
    pieces = wanted.groupBy(item).agg(F.count(F.lit(1)).alias("_pieces"))
    return hits.join(pieces, item).groupBy(item).agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("_n") == F.col("_pieces")).cast("long")).alias("wholly"))


def reconciled(options: dict[str, Column]) -> tuple[Column, Column]:
    """The first known of several readings, in order, and its name (the last one's, if none is known)."""
    *first, last = options
    name = F.lit(last)
    for option in reversed(first):
        name = F.when(options[option].isNotNull(), option).otherwise(name)
    return F.coalesce(*options.values()), name


def digits_agree(whole: Column, part: Column) -> Column:
    """Whether the digits of one text stand in a row in those of the other."""
    return F.contains(F.regexp_replace(whole, r"\D", ""), F.regexp_replace(part, r"\D", ""))


def parsed_answer(answer: Column, label: str, choices: list[str], note: str, longest: int) -> tuple[Column, Column]:
    """The label (one of the choices, else null) and the note, cut to a length, of the first JSON object in an answer."""
    fields = F.from_json(F.regexp_extract(answer, r"\{.*\}", 0), f"struct<{label}:string,{note}:string>")
    return F.when(fields[label].isin(*choices), fields[label]), F.substring(fields[note], 1, longest)


def set_share(a: Column, b: Column) -> Column:
    """Shared over joint members of two arrays of distinct values; 1 where both are empty."""
    joint = F.size(F.array_union(a, b))
    return F.when(joint == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / joint)
