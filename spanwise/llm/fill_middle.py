"""Fill-in-the-middle with a sparse checkpoint index.

A text is counted once, from left to right; while counting, the byte offset and the
code-point offset of every ``step``-th unit are recorded.  A cut after k units is found by
binary search in these checkpoints and a short rescan from there, so no offset of each unit
is ever held and texts are not decoded (code points are counted on their bytes).  Units are
code points, or what a pattern matches, left to right over code points: then a cut after k
units lies where the next unit begins, so that what is between two units goes with the
first of them.

Two draws cut the text; the output is the text itself (plain), or prefix, suffix, middle
(psm) or suffix, prefix, middle (spm), each after its marker:

    psm: <P>prefix<S>suffix<M>middle        spm: <S>suffix<P>prefix<M>middle

A text that holds a marker stays plain, and no marker can begin inside another, so the three
parts are read back from the output exactly (``restored``, on the JVM).  Draws come from a
digest of seed and id, so reruns agree.

Nulls: a null text is empty, an empty one plain; a null id is drawn as an empty one.  Rows
that repeat, or share an id, are each cut by the same draws.  Very long texts are cut whole,
one at a time.  Bytes that are no UTF-8 are kept as they are.  Extra columns are ignored,
whatever their names; an empty table gives none.  Nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import read_table, released, text_slices

#: Units from one checkpoint to the next, and bytes counted at a time.
STEP, CHUNK = 512, 1 << 16
MARKERS = ("<P>", "<S>", "<M>")
CUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


@dataclass
class Checkpoints:
    """Number of units, and for every step-th unit its number, byte offset and code-point offset."""

    count: int
    units: Sequence[int]
    bytes: Sequence[int]
    chars: Sequence[int]


def _first_bytes(data: np.ndarray) -> np.ndarray:
    """Places where a code point begins."""
    return np.flatnonzero((data & 0xC0) != 0x80)


class CodePoints:
    """Every code point is a unit."""

    def index(self, text: bytes, step: int = STEP) -> Checkpoints:
        count, found = 0, []
        for at in range(0, len(text), CHUNK):
            places = _first_bytes(np.frombuffer(text, np.uint8, min(CHUNK, len(text) - at), at))
            found.append(places[-count % step :: step] + at)
            count += len(places)
        places = np.concatenate(found) if found else np.zeros(0, np.int64)
        units = range(0, len(places) * step, step)
        return Checkpoints(count, units, places, units)

    def cut(self, text: bytes, index: Checkpoints, unit: int) -> tuple[int, int]:
        """Byte and code-point offset after so many units."""
        if unit >= index.count:
            return len(text), index.count
        if unit == 0:
            return 0, 0
        nearest = bisect_right(index.units, unit) - 1
        begin, left = int(index.bytes[nearest]), unit - index.units[nearest]
        places = _first_bytes(np.frombuffer(text, np.uint8, min(4 * (left + 1), len(text) - begin), begin))
        return begin + int(places[left]), unit


class Matches:
    """Every match of a pattern is a unit."""

    def __init__(self, pattern: str):
        self.pattern = re.compile(pattern)

    def index(self, text: bytes, step: int = STEP) -> Checkpoints:
        whole, count, chars, sizes = text.decode(errors="surrogateescape"), 0, [], []
        for match in self.pattern.finditer(whole):
            if count % step == 0:
                last = chars[-1] if chars else 0
                sizes.append((sizes[-1] if sizes else 0) + len(whole[last : match.start()].encode(errors="surrogateescape")))
                chars.append(match.start())
            count += 1
        return Checkpoints(count, range(0, len(chars) * step, step), sizes, chars)

    def cut(self, text: bytes, index: Checkpoints, unit: int) -> tuple[int, int]:
        if unit == 0:
            return 0, 0
        if unit >= index.count:
            return len(text), len(text.decode(errors="surrogateescape"))
        nearest = bisect_right(index.units, unit) - 1
        begin, left = index.bytes[nearest], unit - index.units[nearest]
        later = index.bytes[nearest + 1] if nearest + 1 < len(index.bytes) else len(text)
        part = text[begin:later].decode(errors="surrogateescape")  # from one checkpoint to the next
        start = 0 if left == 0 else next(islice(self.pattern.finditer(part), left, None)).start()
        return begin + len(part[:start].encode(errors="surrogateescape")), index.chars[nearest] + start


def _transform(units: CodePoints | Matches, fim_percent: int, spm_percent: int, markers: tuple[bytes, bytes, bytes]):
    p, s, m = markers

    def one(text: bytes, h: list[int]) -> tuple[int, str, int | None, int | None, bytes]:
        index = units.index(text)
        if not text or h[2] % 100 >= fim_percent or any(x in text for x in markers):
            return index.count, "plain", None, None, text
        low, high = sorted((h[0] % (index.count + 1), h[1] % (index.count + 1)))
        (a, a_chars), (b, b_chars) = units.cut(text, index, low), units.cut(text, index, high)
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h[3] % 100 < spm_percent:
            return index.count, "spm", a_chars, b_chars - a_chars, b"".join((s, suffix, p, prefix, m, middle))
        return index.count, "psm", a_chars, b_chars - a_chars, b"".join((p, prefix, s, suffix, m, middle))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                draws = zip(*(part[f"h{i}"].to_pylist() for i in (1, 2, 3, 4)), strict=True)
                rows = [one(text or b"", h) for text, h in zip(part["text"].to_pylist(), draws, strict=True)]
                n, form, prefix, middle, output = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"].combine_chunks(), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def fill_in_middle(docs: DataFrame, seed: str = "1", fim_percent: int = 90, spm_percent: int = 20, pattern: str | None = None, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """doc_id, n (units), form, prefix_chars and middle_chars (null if plain), output, for each row of docs (doc_id, text)."""
    firsts = {x[:1] for x in markers}
    if len(set(markers)) < 3 or any(not x or set(x[1:]) & firsts for x in markers) or any(x != y and x.startswith(y) for x in markers for y in markers):
        raise ValueError("no marker may begin inside of another")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    drawn = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), *draws)
    units = Matches(pattern) if pattern else CodePoints()
    cut = drawn.mapInArrow(_transform(units, fim_percent, spm_percent, tuple(x.encode() for x in markers)), CUT)
    return cut.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of."""
    p, s, m = markers
    middle, before = F.substring_index(output, m, -1), F.substring_index(output, m, 1)
    psm = F.concat(F.substring_index(F.substring_index(before, s, 1), p, -1), middle, F.substring_index(before, s, -1))
    spm = F.concat(F.substring_index(before, p, -1), middle, F.substring_index(F.substring_index(before, p, 1), s, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    shas = [F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256")]
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *shas)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), g AS (
  SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
         t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 AS plain,
         CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 AS spm
  FROM d
), c AS (
  SELECT *, least(x, y) AS a, greatest(x, y) AS b, substring(t, 1, least(x, y)) AS prefix,
         substring(t, least(x, y) + 1, greatest(x, y) - least(x, y)) AS middle, substring(t, greatest(x, y) + 1) AS suffix
  FROM g
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN a END AS prefix_chars, CASE WHEN NOT plain THEN b - a END AS middle_chars,
       sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
              ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""
