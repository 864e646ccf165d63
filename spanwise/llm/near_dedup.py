"""MinHash near-dedup with SetSketch registers.

A document's set holds the hashes of its distinct word shingles.  Its sketch is a row of
registers: each takes the minimum of the set's hashes, read as exponential variables, on
an exponentially spaced, truncated scale.  Sketches of parts merge by maximum, and two
registers are equal about as often as the sets are similar.

1. documents with one set are one class; only its smallest doc_id goes on;
2. bands of register values are keys; per key one member is the centre, and every member
   pairs with it (a star instead of all pairs).  What the stars join is a candidate group:
   any two members of one key are in one group;
3. a group's texts meet once, a large group's in pairs of blocks of bounded size, and those
   of a group of very many blocks by band key.  There an index of each set's rarest shingles
   finds the pairs that can reach the threshold at all: sets of similarity s share one of
   their (1 - s) n + 1 rarest, whatever they have in common otherwise.  Pairs of different
   components are estimated jointly, by the likelihood of their registers above, below and
   equal given both set sizes; what may reach the threshold within six deviations is
   confirmed on the full sets.  Members meet the first of their shingle before all others,
   so a cluster of copies joins in one pass over it.  Only links that join components come out;
4. links are joined to components by alternating stars, so a chain of versions, each near the
   one before, takes passes that grow with the logarithm of its length.

With 32 bands of 4 registers a pair of similarity 0.8 shares no band once in ten million.

Nulls: a null text or one without words has an empty set and is linked with nothing.  A
null doc_id is smaller than all others.  Rows that share a doc_id are one document: each
set among them is linked under it.  Very long texts are read whole, a similarity just at
the threshold links.  Extra columns are ignored, whatever their names; an empty table gives
none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.graph import components
from .common import ensure_checkpoint_dir, mix, read_table, released, signed, split_words, text_buffer, text_slices, word_hashes

BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: SetSketch scale: base, rate and the largest register value (two bytes).
BASE, RATE, LARGEST = 1.001, 20.0, (1 << 16) - 1
#: Shingles of one block of a candidate group; two blocks meet in one task.
BLOCK_SHINGLES = 2_000_000
#: Blocks of a group from which its members meet by band key: a text has no more keys than that.
MOST_BLOCKS = BANDS
_ODD = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(1001, REGISTERS + 1001, dtype=np.uint64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SKETCHES = "doc long, n_shingles long, one long, two long, registers binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, ordered within the text, and where each text's begin."""
    words = split_words(_LOWER[data], offsets)
    h, counts, n = word_hashes(words), words.count(), len(offsets) - 1
    text = words.of_text()
    at = np.flatnonzero(np.arange(len(h)) + size <= words.first[1:][text]) if len(h) else np.zeros(0, np.int64)
    shingle = np.full(len(at), size, np.uint64)
    for j in range(size):
        shingle = mix((shingle ^ h[at + j]) * np.uint64(0x9E3779B97F4A7C15))
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = counts[short].astype(np.uint64)
    for j in range(size - 1):
        live = counts[short] > j
        whole[live] = mix((whole[live] ^ h[words.first[short[live]] + j]) * np.uint64(0x9E3779B97F4A7C15))
    text, shingle = np.concatenate([text[at], short]), np.concatenate([shingle, whole])
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    text, shingle = text[new], shingle[new]
    return shingle, np.searchsorted(text, np.arange(n + 1))


def registers(shingle: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SetSketch registers of non-empty sets, (sets, REGISTERS) of two bytes."""
    low = np.empty((len(first) - 1, REGISTERS), np.uint64)
    for j in range(REGISTERS):
        low[:, j] = np.minimum.reduceat(shingle * _ODD[j] + _ADD[j], first[:-1])
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / math.log(BASE)), 0, LARGEST).astype("<u2")


def estimate(u: np.ndarray, v: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, steps: int = 200) -> np.ndarray:
    """Most likely similarity of sets of known sizes, from how their registers compare."""
    above, below = (u > v).sum(axis=1), (u < v).sum(axis=1)
    equal = u.shape[1] - above - below
    share = n_u / (n_u + n_v)
    most = np.minimum(share / (1 - share), (1 - share) / share)
    grid = most[:, None] * (np.arange(steps + 1) / steps)[None]

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE)

    up, down = p(share[:, None] - (1 - share[:, None]) * grid), p(1 - share[:, None] - share[:, None] * grid)
    tiny = 1e-12
    likelihood = above[:, None] * np.log(up + tiny) + below[:, None] * np.log(down + tiny) + equal[:, None] * np.log(np.maximum(1 - up - down, 0) + tiny)
    return grid[np.arange(len(grid)), likelihood.argmax(axis=1)]


def sketch(docs: DataFrame, size: int) -> DataFrame:
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                shingle, first = shingle_sets(*text_buffer(part["text"]), size)
                count = np.diff(first)
                full = np.flatnonzero(count)
                sums = np.zeros((2, len(count)), np.uint64)
                packed: list[bytes | None] = [None] * len(count)
                if len(full):
                    edges = np.append(first[:-1][full], first[-1])
                    sums[0, full] = np.add.reduceat(mix(shingle), edges[:-1])
                    sums[1, full] = np.add.reduceat(mix(shingle ^ np.uint64(0x5851F42D4C957F2D)), edges[:-1])
                    for i, row in zip(full, registers(shingle, edges), strict=True):
                        packed[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays([part["doc"].combine_chunks(), pa.array(count, pa.int64()), pa.array(signed(sums[0])), pa.array(signed(sums[1])), pa.array(packed, pa.binary())], names=["doc", "n_shingles", "one", "two", "registers"])

    return docs.mapInArrow(run, SKETCHES)


def _flat(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = np.cumsum(count)
    return np.repeat(begin - (total - count), count) + np.arange(int(total[-1]) if len(total) else 0)


def _ends(begin: np.ndarray, total: int) -> np.ndarray:
    return np.append(begin[1:], total)[: len(begin)]


class Linker:
    """Links that join the components of some sets: (later, earlier) pairs confirmed on full sets."""

    def __init__(self, sets: np.ndarray, first: np.ndarray, sketches: np.ndarray, percent: int):
        self.first, self.size, self.sketches, self.percent = first, np.diff(first), sketches, percent
        similarity = percent / 100
        self.least = similarity - 6 * math.sqrt(similarity * (1 - similarity) / REGISTERS)
        n = len(self.size)
        self.component, self.members = np.arange(n), [[i] for i in range(n)]
        self.links: list[tuple[int, int]] = []
        # shingles numbered by how many sets have them, rarest first; each set in that order
        values, which, counts = np.unique(sets, return_inverse=True, return_counts=True)
        number = np.empty(len(values), np.int64)
        by_count = np.lexsort((values, counts))
        number[by_count] = np.arange(len(values))
        owner = np.repeat(np.arange(n), self.size)
        self.shingle = number[which]
        self.shingle = self.shingle[np.lexsort((self.shingle, owner))]
        self.mark = np.zeros(len(values), bool)
        rarest = self.size - -(-percent * self.size // 100) + 1
        near = np.arange(len(owner)) - first[:-1][owner] < rarest[owner]
        at = np.flatnonzero(near & (counts[by_count][self.shingle] > 1)) if len(owner) else owner
        at = at[np.argsort(self.shingle[at], kind="stable")]
        self.doc = owner[at]  # sets by shared shingle
        self.begin = np.flatnonzero(np.diff(self.shingle[at], prepend=-1))
        self.end = _ends(self.begin, len(at))

    def test(self, x: int, others: np.ndarray) -> None:
        """Link x with those of the others that reach the threshold and are in other components."""
        others = others[self.component[others] != self.component[x]]
        others = others[100 * np.minimum(self.size[others], self.size[x]) >= self.percent * np.maximum(self.size[others], self.size[x])]
        others = others[(self.sketches[others] == self.sketches[x]).sum(axis=1) >= REGISTERS * self.least * 0.8]
        if not len(others):
            return
        n = self.size[others].astype(np.float64)
        others = others[estimate(np.broadcast_to(self.sketches[x], (len(others), REGISTERS)), self.sketches[others], np.full(len(others), float(self.size[x])), n) >= self.least]
        if not len(others):
            return
        mine = self.shingle[self.first[x] : self.first[x + 1]]
        self.mark[mine] = True
        shared = self.mark[self.shingle[_flat(self.first[others], self.size[others])]]
        self.mark[mine] = False
        common = np.add.reduceat(shared.astype(np.int64), np.cumsum(self.size[others]) - self.size[others])
        for y in others[100 * common >= self.percent * (self.size[x] + self.size[others] - common)].tolist():
            a, b = sorted((int(self.component[x]), int(self.component[y])), key=lambda c: len(self.members[c]))
            if a != b:
                self.links.append((max(x, y), min(x, y)))
                self.component[self.members[a]] = b
                self.members[b] += self.members[a]
                self.members[a] = []


def links_among(sets: np.ndarray, first: np.ndarray, sketches: np.ndarray, block: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the members' components: (later, earlier) pairs confirmed on full sets.

    First the first set that has a shingle meets the others that have it.  Where these are
    then in several components, those outside the first one's meet all sets of the shingle.
    Of two blocks, only pairs across them are looked at in that second turn.
    """
    if len(first) < 3:
        return []
    linker = Linker(sets, first, sketches, percent)
    doc, begin, end = linker.doc, linker.begin, linker.end
    head = np.repeat(doc[begin], end - begin)
    pairs = np.unique(head * len(first) + doc)
    heads, starts = np.unique(pairs // len(first), return_index=True)
    for x, a, b in zip(heads.tolist(), starts, _ends(starts, len(pairs)), strict=True):
        linker.test(x, pairs[a:b] % len(first))
    across = block.min() != block.max()
    of = linker.component[doc]
    open_ = np.minimum.reduceat(of, begin) != np.maximum.reduceat(of, begin) if len(begin) else np.zeros(0, bool)
    if across and len(begin):
        open_ &= np.minimum.reduceat(block[doc], begin) != np.maximum.reduceat(block[doc], begin)
    begin, end = begin[open_], end[open_]
    at = _flat(begin, end - begin)
    which = np.repeat(np.arange(len(begin)), end - begin)
    outside = of[at] != of[begin[which]]
    x, which = doc[at][outside], which[outside]
    order = np.argsort(x, kind="stable")
    x, which = x[order], which[order]
    starts = np.flatnonzero(np.diff(x, prepend=-1))
    for a, b in zip(starts, _ends(starts, len(x)), strict=True):
        some = which[a:b]
        others = np.unique(doc[_flat(begin[some], (end - begin)[some])])
        linker.test(int(x[a]), others[block[others] != block[x[a]]] if across else others)
    return linker.links


def _confirmed(size: int, percent: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rep")
        sets, first = shingle_sets(*text_buffer(rows["text"]), size)
        full = np.flatnonzero(np.diff(first))  # a row without words under a shared doc_id has no set
        first, rep, block = np.append(first[:-1][full], first[-1]), rows["rep"].to_numpy()[full], rows["block"].to_numpy()[full]
        found = links_among(sets, first, registers(sets, first), block, percent)
        return pa.table({"a": pa.array([int(rep[x]) for x, _ in found], pa.int64()), "b": pa.array([int(rep[y]) for _, y in found], pa.int64())})

    return run


def _units(groups: DataFrame) -> DataFrame:
    """Groups (rep, group, n_shingles) as units of bounded size: the group itself, or pairs of its blocks."""
    blocks = groups.groupBy("group").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = groups.join(blocks, "group").select("rep", "group", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.select("rep", "group", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), "text")
    sketches = sketch(keyed, size).checkpoint()
    set_key = ["one", "two", "n_shingles"]
    classes = sketches.filter("n_shingles > 0").groupBy(*set_key).agg(F.min("doc").alias("rep"), F.first("registers").alias("registers")).checkpoint()
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.expr("registers").substr(i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    bands = classes.select("rep", F.explode(band).alias("key"))
    # the smallest member: keys of one group mostly agree in it, so that a member has few links
    centres = bands.groupBy("key").agg(F.min("rep").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "centre")
    shared = bands.join(centres, "key").checkpoint()
    stars = shared.filter("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
    groups = components(stars, "a", "b").withColumnsRenamed({"node": "rep", "component": "group"})
    groups = groups.join(classes.select("rep", "n_shingles"), "rep").checkpoint()
    # a group of very many blocks meets by band key instead: its keys are few to a text
    wide = groups.groupBy("group").agg(F.sum("n_shingles").alias("n")).filter(F.col("n") > MOST_BLOCKS * BLOCK_SHINGLES).select("group")
    by_key = shared.join(groups.join(wide, "group", "left_semi"), "rep").select("rep", F.col("key").alias("group"), "n_shingles")
    dealt = _units(groups.join(wide, "group", "left_anti")).unionByName(_units(by_key))
    texts = keyed.filter("text is not null").join(dealt, keyed["doc"] == dealt["rep"]).select("group", "low", "high", "rep", "block", "text")
    links = texts.groupBy("group", "low", "high").applyInArrow(_confirmed(size, percent), "a long, b long").checkpoint()
    labels = components(links, "a", "b")
    of_class = classes.select(*set_key, "rep").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select(*set_key, F.coalesce("component", "rep").alias("component_id"))
    found = sketches.select("doc", *set_key).join(of_class, set_key, "left").select("doc", "n_shingles", F.coalesce("component_id", "doc").alias("component_id"))
    null_id = F.lit(-(1 << 63))
    return found.select(F.nullif("doc", null_id).alias("doc_id"), "n_shingles", F.nullif("component_id", null_id).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), size=4)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, reach) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach),
m AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT node AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id, node = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = node
"""
