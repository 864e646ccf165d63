"""Curves of an entity as keys: eased pieces within a tolerance, and flat stretches as holds.

A curve is compressed as a whole, so an entity's channel is one unit of work; entities and
channels run in parallel.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window, functions as F

from .sequence import noise_bound

# Cubic-bezier easings by name (x1, y1, x2, y2).
EASES = {
    "in_quad": (0.11, 0.0, 0.5, 0.0),
    "out_quad": (0.5, 1.0, 0.89, 1.0),
    "in_out_quad": (0.45, 0.0, 0.55, 1.0),
    "in_cubic": (0.32, 0.0, 0.67, 0.0),
    "out_cubic": (0.33, 1.0, 0.68, 1.0),
    "in_out_cubic": (0.65, 0.0, 0.35, 1.0),
    "out_back": (0.34, 1.56, 0.64, 1.0),
}
# Tolerance and default of each property.
TOLERANCE = {"x": 2.0, "y": 2.0, "sx": 0.01, "sy": 0.01, "rot": 1.0, "skx": 1.0, "sky": 1.0, "opacity": 0.02, "reveal": 0.01, "rx": 1.0, "ry": 1.0}
DEFAULT = {"x": 0.0, "y": 0.0, "sx": 1.0, "sy": 1.0, "rot": 0.0, "skx": 0.0, "sky": 0.0, "opacity": 1.0, "reveal": 1.0, "rx": 0.0, "ry": 0.0}
NAMES = ("linear", *EASES)
#: Errors of pieces that are worked out at once (a longer piece alone).
ELEMENTS = 1 << 20
KEYS = "t long, v double, ease string, error double"


@lru_cache(maxsize=len(EASES))
def _drawn(ease: tuple[float, float, float, float], points: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """x and y along an easing's curve, x ascending."""
    s = np.linspace(0.0, 1.0, points + 1)
    x, y = ((3 * a * (1 - s) + 3 * b * s) * s * (1 - s) + s**3 for a, b in ((ease[0], ease[2]), (ease[1], ease[3])))
    return x, y


def ease_at(x: np.ndarray, ease: tuple[float, float, float, float]) -> np.ndarray:
    """y of an easing at each x, between densely drawn points."""
    return np.interp(x, *_drawn(tuple(ease)))


@lru_cache(maxsize=256)
def _shapes(steps: int) -> np.ndarray:
    """All easings at 0, 1/steps ... 1, the straight line first."""
    u = np.arange(steps + 1) / max(steps, 1)
    return np.stack([u, *(ease_at(u, e) for e in EASES.values())])


def _draw(a: int, b: int, first: float, last: float, ease: int) -> np.ndarray:
    return first + (last - first) * _shapes(b - a)[ease]


def eased_pieces(v: np.ndarray, first: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last row, easing and error of the pieces that together cover each curve, in order.

    ``first`` has where each curve begins in v, and the end of all; a curve of one row is one
    piece.  All open pieces of all curves are halved in rounds until they fit, those of one
    length at once.  A piece is drawn by the easing with the smallest largest error, the
    straight line among equals; one that misses its rows by more than the curve's bound is cut
    where it misses most.
    """
    done: list[tuple[np.ndarray, ...]] = []
    a, b, most = first[:-1], first[1:] - 1, bound
    while len(a):
        cut: list[tuple[np.ndarray, ...]] = []
        order = np.argsort(b - a, kind="stable")
        a, b, most = a[order], b[order], most[order]
        begins = np.concatenate([[0], np.flatnonzero(np.diff(b - a)) + 1, [len(a)]])
        for g, h in zip(begins, begins[1:], strict=False):
            steps = int(b[g] - a[g])
            shapes, at_once = _shapes(steps), max(1, ELEMENTS // (8 * (steps + 1)))
            for i in range(g, h, at_once):
                x, y, limit = (part[i : min(i + at_once, h)] for part in (a, b, most))
                error = np.abs(v[x][:, None, None] + (v[y] - v[x])[:, None, None] * shapes - v[x[:, None] + np.arange(steps + 1)][:, None])
                worst = error.max(axis=2)
                ease = np.where(worst[:, 0] <= worst.min(axis=1) + 1e-9, 0, worst.argmin(axis=1))
                miss = worst[np.arange(len(x)), ease]
                fits = (miss <= limit) | (steps < 2)
                done.append((x[fits], y[fits], ease[fits], miss[fits]))
                if not fits.all():
                    x, y, limit = x[~fits], y[~fits], limit[~fits]
                    at = x + 1 + error[~fits, ease[~fits], 1:-1].argmax(axis=1)
                    cut += [(x, at, limit), (at, y, limit)]
        a, b, most = (np.concatenate(part) for part in zip(*cut, strict=True)) if cut else (np.zeros(0, np.int64),) * 3
    a, b, ease, miss = (np.concatenate(part) for part in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 4
    order = np.argsort(a, kind="stable")
    return a[order], b[order], ease[order], miss[order]


def _levels(v: np.ndarray, at: np.ndarray, low: list[float], high: list[float], bound: float) -> list[tuple[int, int, float]]:
    """Stretches of pieces (first key, last key, level) whose rows all lie within bound of one level, as long as they can be.

    Rows fit a level if their range is at most twice the bound; the level is their median where
    that fits, else the middle of the range.  Stretches share no key, so each has one level.
    ``low`` and ``high`` are those of each piece's rows.
    """
    found, i = [], 0
    while i + 1 < len(at):
        k, least, most = i, np.inf, -np.inf
        while k + 1 < len(at):
            down, up = min(least, low[k]), max(most, high[k])
            if up - down > 2 * bound:
                break
            k, least, most = k + 1, down, up
        if k == i:
            i += 1
            continue
        rows = v[at[i] : at[k] + 1]
        level = float(np.median(rows))
        found.append((i, k, level if max(most - level, level - least) <= bound else float((most + least) / 2)))
        i = k + 1
    return found


def keys_of(v: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, list[int], float]:
    """Rows, values and easings of one curve's keys, and the largest deviation of what they draw."""
    return next(keys_of_all(v, np.array([0, len(v)]), np.array([bound])))


def keys_of_all(v: np.ndarray, first: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], float]]:
    """What ``keys_of`` gives, for each of the curves that begin at ``first``, none of them empty."""
    a, b, ease, miss = eased_pieces(v, first, bound)
    low, high = (f(f.reduceat(v, a), v[b]) for f in (np.minimum, np.maximum)) if len(a) else (v, v)
    of = np.searchsorted(a, first)
    low, high, ease, miss = low.tolist(), high.tolist(), ease.tolist(), miss.tolist()
    for n, limit in enumerate(bound.tolist()):
        own = slice(of[n], of[n + 1])
        yield _keys(v[first[n] : first[n + 1]], np.append(a[own], first[n + 1] - 1) - first[n], ease[own], miss[own], low[own], high[own], limit)


def _keys(v: np.ndarray, at: np.ndarray, ease: list[int], miss: list[float], low: list[float], high: list[float], bound: float) -> tuple[np.ndarray, np.ndarray, list[int], float]:
    """Rows, values and easings of a curve's keys, and the largest deviation of what they draw.

    Of the stretches that could be held at one level, those are held that leave fewest keys
    while every piece beside them still stays within bound (or within what it missed before):
    a choice over all stretches at once, by least keys up to each of them, held or not.
    """
    if len(v) == 1:
        return np.zeros(1, int), v.astype(float), [0], 0.0
    levels = _levels(v, at, low, high, bound)
    if not levels and (len(at) > 2 or v[0] != v[-1]):  # all pieces stay as they are
        value = v[at].astype(float)
        return at, value, [*(0 if x == y else e for e, x, y in zip(ease, value.tolist(), value[1:].tolist(), strict=False)), 0], max(miss)

    def fits(piece: int, first: float | None, last: float | None) -> bool:
        a, b = at[piece], at[piece + 1]
        return bool(np.abs(_draw(a, b, v[a] if first is None else first, v[b] if last is None else last, ease[piece]) - v[a : b + 1]).max() <= max(bound, miss[piece]))

    # for each stretch left raw (0) or held (1): keys saved so far, and the state of the stretch before
    ways: list[list[tuple[int, int] | None]] = []
    for n, (i, k, level) in enumerate(levels):
        row: list[tuple[int, int] | None] = []
        for held in (0, 1):
            options = []
            for before in (0, 1) if n else (0,):
                past = ways[-1][before] if n else (0, 0)
                if past is None:
                    continue
                earlier, joined = (levels[n - 1][2] if n and before else None), n and levels[n - 1][1] + 1 == i
                mine = level if held else None
                if i and joined and (held or before) and not fits(i - 1, earlier, mine):
                    continue  # one piece lies between the two stretches
                if i and not joined and held and not fits(i - 1, None, mine):
                    continue
                options.append((past[0] + (k - i - 1 if held else 0), held, before))
            after = levels[n + 1][0] if n + 1 < len(levels) else None
            if held and k < len(ease) and after != k + 1 and not fits(k, level, None):
                options = []
            best = max(options, default=None)
            row.append(None if best is None else (best[0], best[2]))
        ways.append(row)
    held = [False] * len(levels)
    state = max((s for s in (0, 1) if ways and ways[-1][s] is not None), key=lambda s: (ways[-1][s][0], s), default=0)
    for n in range(len(levels) - 1, -1, -1):
        held[n], state = bool(state), ways[n][state][1]
    value, keep = v[at].astype(float), np.ones(len(at), bool)
    for (i, k, level), yes in zip(levels, held, strict=True):
        if yes:
            value[i : k + 1] = level
            keep[i + 1 : k] = False
    at, value, ease = at[keep], value[keep], [*np.array([*ease, 0])[keep].tolist()]
    ease = [0 if i + 1 >= len(value) or value[i] == value[i + 1] else e for i, e in enumerate(ease)]
    if len(at) == 2 and value[0] == value[1]:
        return at[:1], value[:1], [0], float(np.abs(v - value[0]).max())
    return at, value, ease, max(float(np.abs(_draw(a, b, x, y, e) - v[a : b + 1]).max()) for a, b, x, y, e in zip(at, at[1:], value, value[1:], ease, strict=False))


def eased_keys(rows: DataFrame, entity: list[str], position: str, value: str, bound: str | Column) -> DataFrame:
    """Keys (t, v, ease to the next one) of each entity's curve over consecutive positions, and the curve's error.

    Null values are left out; bound may differ by entity, its largest value counts.
    """
    bound = F.col(bound) if isinstance(bound, str) else bound
    slim = rows.select(*entity, F.col(position).cast("long").alias("t"), F.col(value).cast("double").alias("v"), bound.cast("double").alias("_bound")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    # tasks of a number of their own: the work is in the curves, which are small in bytes
    session = rows.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    curves = slim.repartition(tasks, *entity).groupBy(*entity).agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("_rows"), F.max("_bound").alias("_bound"))
    curves = curves.select(*entity, F.col("_rows.t").alias("_t"), F.col("_rows.v").alias("_v"), "_bound")
    schema = curves.select(*entity).schema
    for name, kind in (part.split() for part in KEYS.split(", ")):
        schema = schema.add(name, kind)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t, v = (batch.column(name).flatten().to_numpy() for name in ("_t", "_v"))
            first = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(batch.column("_v")).to_numpy().astype(np.int64))])
            at, values, eases, errors = zip(*keys_of_all(v, first, batch.column("_bound").to_numpy()), strict=True)
            size = np.array([len(x) for x in at])
            of = np.repeat(np.arange(len(size)), size)
            kept = [batch.column(name).take(pa.array(of)) for name in entity]
            found = [pa.array(t[np.concatenate(at) + first[of]]), pa.array(np.concatenate(values)), pa.array([NAMES[e] for e in itertools.chain.from_iterable(eases)]), pa.array(np.repeat(np.array(errors), size))]
            yield pa.RecordBatch.from_arrays([*kept, *found], names=schema.names)

    return curves.mapInArrow(compress, schema)


def _long(rows: DataFrame, entity: list[str], position: str, properties: list[str], extent: dict[str, str]) -> tuple[DataFrame, Column]:
    """Rows by property, and each one's tolerance: a scale may move an edge of the canonical extent by half the place's tolerance."""
    pairs = F.map_from_arrays(F.array(*[F.lit(p) for p in properties]), F.array(*[F.col(p).cast("double") for p in properties]))
    sizes = F.map_from_arrays(F.array(*[F.lit(p) for p in properties]), F.array(*[(F.col(extent[p]) if p in extent else F.lit(None)).cast("double") for p in properties]))
    long = rows.select(*entity, F.col(position).cast("long").alias("t"), sizes.alias("_sizes"), F.explode(pairs).alias("property", "v")).withColumn("_size", F.col("_sizes")[F.col("property")]).drop("_sizes")
    fixed = F.create_map(*[F.lit(x) for pair in TOLERANCE.items() for x in pair])[F.col("property")]
    return long, F.greatest(fixed, F.when(F.col("_size").isNotNull(), TOLERANCE["x"] / F.greatest(F.col("_size"), F.lit(1.0))))


def property_keys(rows: DataFrame, entity: list[str], position: str, properties: list[str], extent: dict[str, str] | None = None) -> DataFrame:
    """Keys of each property that leaves its default by more than its tolerance, which measurement noise may widen.

    extent names the columns of an element's own width and height by scale (sx, sy).
    """
    by = [*entity, "property"]
    long, tolerance = _long(rows, entity, position, properties, extent or {})
    default = F.create_map(*[F.lit(x) for pair in DEFAULT.items() for x in pair])[F.col("property")]
    noise = noise_bound(long, by, ["t"], "v").select(*by, F.coalesce("bound", F.lit(0.0)).alias("_noise"))
    bounds = long.filter("v is not null").groupBy(*by).agg(F.max(F.abs(F.col("v") - default)).alias("_away"), F.max(tolerance).alias("_fixed")).join(noise, by).withColumn("_bound", F.greatest("_fixed", "_noise"))
    return eased_keys(long.join(bounds.filter("_away > _bound").select(*by, "_bound"), by), by, "t", "v", "_bound")


def fit_errors(keys: DataFrame, rows: DataFrame, entity: list[str], position: str, properties: list[str], extent: dict[str, str] | None = None) -> DataFrame:
    """Per entity: the largest error of its place, and the longest run of positions at which some property misses its tolerance."""
    by = [*entity, "property"]
    long, tolerance = _long(rows, entity, position, properties, extent or {})
    noise = noise_bound(long, by, ["t"], "v").select(*by, F.coalesce("bound", F.lit(0.0)).alias("_noise"))
    met = long.filter("v is not null").join(noise, by).withColumn("_bound", F.greatest(tolerance, "_noise"))
    drawn = key_errors(keys, met, by, "t", "v").withColumnRenamed("drawn", "_drawn").filter("_drawn is not null")
    off = met.join(drawn.select(*by, "t", "_drawn"), [*by, "t"]).withColumn("_off", F.abs(F.col("v") - F.col("_drawn")))
    # errors at the bound itself are no misses: what is drawn carries a rounding of its own
    at = off.groupBy(*entity, "t").agg(F.max((F.col("_off") > F.col("_bound") + 1e-6).cast("int")).alias("_missed"), F.max(F.when(F.col("property").isin("x", "y"), F.col("_off"))).alias("_place"))
    turn = F.row_number().over(Window.partitionBy(*entity).orderBy("t")) - F.row_number().over(Window.partitionBy(*entity, "_missed").orderBy("t"))
    runs = at.withColumn("_run", turn).groupBy(*entity, "_missed", "_run").agg(F.count(F.lit(1)).alias("_n"), F.max("_place").alias("_place"))
    return runs.groupBy(*entity).agg(F.coalesce(F.max("_place"), F.lit(0.0)).alias("place_error"), F.coalesce(F.max(F.when(F.col("_missed") == 1, F.col("_n"))), F.lit(0)).cast("long").alias("longest_miss"))


def key_errors(keys: DataFrame, rows: DataFrame, entity: list[str], position: str, value: str) -> DataFrame:
    """What the keys draw at each position (position, value, drawn): the piece by the last key at or before, eased."""
    order = Window.partitionBy(*entity).orderBy("t")
    pieces = keys.select(*entity, "t", F.struct("t", "v", "ease", F.lead("t").over(order).alias("t1"), F.lead("v").over(order).alias("v1")).alias("_piece"))
    at = rows.select(*entity, F.col(position).cast("long").alias("t"), F.col(value).alias("_value"))
    held = F.last("_piece", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    p = F.col("_piece")
    u = F.coalesce(F.try_divide(F.col("t") - p["t"], p["t1"] - p["t"]), F.lit(0.0))
    drawn = at.join(pieces, [*entity, "t"], "left").withColumn("_piece", held)
    from ..functions.geometry import bezier_ease

    eased = u
    for name, e in EASES.items():
        eased = F.when(p["ease"] == name, bezier_ease(u, *[F.lit(x) for x in e])).otherwise(eased)
    return drawn.select(*entity, F.col("t").alias(position), F.col("_value").alias(value), (p["v"] + (F.coalesce(p["v1"], p["v"]) - p["v"]) * eased).alias("drawn"))
