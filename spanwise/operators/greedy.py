"""Passes over an entity's rows in a fixed order, each choice depending on those before.

An entity is one unit of work by meaning; entities run in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .match import band_join, greedy_pairs


def fit_in_budget(rows: DataFrame, entity: list[str], order: list[str], full: str, small: str, budget: int) -> DataFrame:
    """In order, take each row at its full size if that fits what is left, else at its small size, else not."""
    schema = rows.select(*entity, *order).schema.add("form", "string")

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part, left, form = part.sort_values(order, ignore_index=True), budget, []
        for whole, short in zip(part[full], part[small], strict=True):
            form.append("full" if whole <= left else "small" if short <= left else None)
            left -= whole if whole <= left else short if short <= left else 0
        return part[[*entity, *order]].assign(form=form)

    return rows.select(*dict.fromkeys([*entity, *order, full, small])).groupBy(*entity).applyInPandas(fill, schema)


def spaced(rows: DataFrame, entity: list[str], position: str, gap: int, most: int) -> DataFrame:
    """Rows in order of position, each at least ``gap`` after the one kept before, at most ``most`` of them."""

    def keep(part: pd.DataFrame) -> pd.DataFrame:
        part, last, kept = part.sort_values(position, kind="stable", ignore_index=True), None, []
        for i, at in enumerate(part[position]):
            if (last is None or at - last >= gap) and len(kept) < most:
                kept.append(i)
                last = at
        return part.iloc[kept]

    return rows.groupBy(*entity).applyInPandas(keep, rows.schema)


def merged_points(rows: DataFrame, entity: list[str], ident: str, axes: list[str], within: float) -> DataFrame:
    """Give each point, in order of id, to the first representative within a distance; else it becomes one."""
    schema = rows.select(*entity, ident).schema.add("representative", rows.schema[ident].dataType)

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(ident, ignore_index=True)
        points, ids, given = part[axes].to_numpy(np.float64), part[ident].tolist(), []
        heads: list[int] = []
        for i, p in enumerate(points):
            near = np.flatnonzero(np.linalg.norm(points[heads] - p, axis=1) <= within) if heads else np.zeros(0, np.int64)
            if not len(near):
                heads.append(i)
            given.append(ids[heads[near[0]]] if len(near) else ids[i])
        return part[[*entity, ident]].assign(representative=given)

    return rows.select(*entity, ident, *axes).groupBy(*entity).applyInPandas(merge, schema)


def boundary_scores(truth: DataFrame, found: DataFrame, keys: list[str], position: str, tolerance: int) -> DataFrame:
    """Precision, recall and F1 of found positions: a pair may differ by the tolerance, and each side is used once."""
    a = truth.select(*keys, F.col(position).alias("_t")).distinct()
    b = found.select(*keys, F.col(position).alias("_f")).distinct()
    pairs = band_join(a, b, keys, "_t", "_f", -tolerance, tolerance).withColumn("_c", F.abs(F.col("_t") - F.col("_f")).cast("double"))
    hits = greedy_pairs(pairs, keys, "_t", "_f", "_c", float(tolerance)).groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"))
    counts = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("wanted")).join(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("found")), keys, "full_outer").join(hits, keys, "left")
    h, w, f = (F.coalesce(c, F.lit(0)) for c in ("hits", "wanted", "found"))
    return counts.select(*keys, h.alias("hits"), F.try_divide(h, f).alias("precision"), F.try_divide(h, w).alias("recall"), F.try_divide(2 * h, w + f).alias("f1"))


def scene_spans(rows: DataFrame, entity: list[str], index: str, cut: str, least: int) -> DataFrame:
    """Scenes (scene, first, last) between cuts: a cut that would leave one of fewer than ``least`` rows on either side is no cut."""
    schema = rows.select(*entity, F.lit(0).cast("long").alias("scene"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last")).schema
    slim = rows.groupBy(*entity).agg((F.max(index) + 1).cast("long").alias("_n"), F.array_sort(F.collect_list(F.when(F.col(cut), F.col(index)))).alias("_cuts"))

    def split(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for *key, n, cuts in part[[*entity, "_n", "_cuts"]].itertuples(index=False):
            edges = [0]
            for at in cuts:
                if at - edges[-1] >= least and n - at >= least:
                    edges.append(int(at))
            out += [(*key, i + 1, a, z - 1) for i, (a, z) in enumerate(zip(edges, [*edges[1:], n], strict=True))]
        return pd.DataFrame(out, columns=[*entity, "scene", "first", "last"])

    return slim.mapInPandas(lambda parts: (split(p) for p in parts), schema)
