"""Deviation from neighbours for all channels in one exchange of the series.

Sites stand in cells of at most ``CELL_SITES`` that lie together. A row of the series goes to its site's own cell and,
as border, to every cell with a site that has it for a neighbour; (cell, block of time) is what rows are dealt by, so
no site or city is a hot key. Within one such block everything that a site needs is there.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.geo import unit_sphere
from ..functions.time import DAY_US, epoch_us
from .clean import q
from .lookup import beside
from .ordering import global_row_number

SITE = "site_id"
CELL_SITES = 64
# Cube sizes, coarse to fine, that order the sites so that neighbours in the order lie together.
LEVELS = (3, 6, 9, 12, 15, 18, 21)


def site_cells(sites: DataFrame, size: int = CELL_SITES) -> DataFrame:
    """``site_id, cell``: at most ``size`` sites per cell, near each other; dense and empty regions get equal cells."""
    axes = unit_sphere(F.col("lat"), F.col("lon"))
    order = [F.floor((a + 1) * float(1 << (level - 1))).cast("long") for level in LEVELS for a in axes]
    names = [f"_o{i}" for i in range(len(order))]
    placed = sites.select(SITE, *[o.alias(n) for o, n in zip(order, names)])
    numbered = global_row_number(placed, [*names, SITE], "_rn")
    return numbered.select(SITE, F.floor((F.col("_rn") - 1) / size).cast("long").alias("cell"))


def _destinations(sites: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """Per site: its neighbours in order of rank, and the cells that need its rows."""
    cells = site_cells(sites, size)
    from_i = cells.select(F.col(SITE).alias("site_i"), "cell")
    # Merge joins by hint: Spark takes compressed files for far smaller than their rows and would broadcast them.
    needed = edges.join(from_i.hint("merge"), "site_i").select(F.col("site_j").alias(SITE), "cell").unionByName(cells)
    near = edges.groupBy(F.col("site_i").alias(SITE)).agg(F.array_sort(F.collect_list(F.struct("rank", "site_j"))).alias("_n"))
    near = near.select(SITE, F.transform("_n", lambda n: n["site_j"]).alias("_near"))
    own = cells.withColumnRenamed("cell", "_own")
    return needed.groupBy(SITE).agg(F.collect_set("cell").alias("_cells")).join(own.hint("merge"), SITE).join(near.hint("merge"), SITE, "left")


def _mean(values: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Mean of the present values over the last axis; undefined without any."""
    use = use & ~np.isnan(values)
    n = use.sum(axis=-1)
    total = np.where(use, values, 0.0).sum(axis=-1)
    return np.where(n > 0, total / np.maximum(n, 1), np.nan)


def neighbour_deviations(
    grid: DataFrame,
    sites: DataFrame,
    edges: DataFrame,
    channels: Sequence[str],
    weather: Sequence[str],
    k_meteo: int = 4,
    eps: float = 1e-6,
    block_us: int = 256 * DAY_US,
    size: int = CELL_SITES,
) -> DataFrame:
    """Long ``channel, site_id, dt, x, ref, e, e_meteo`` of a wide series ``site_id, dt, <channels>, <weather>``.

    ``ref`` is the mean of the neighbours' present values at the same time, ``e`` the relative deviation from it, and
    ``e_meteo`` the one from the ``k_meteo`` neighbours with the most similar weather then (ties to the nearer one; a
    missing weather value adds nothing). ``edges`` are ``site_i, rank, site_j``. A site without place or neighbours
    has no reference. ``block_us`` is the length of a time block; choose it so that a cell's block fits a task.
    """
    measures = list(dict.fromkeys((*channels, *weather)))
    row = grid.agg(*[F.stddev_pop(q(c)).alias(f"w{i}") for i, c in enumerate(weather)]).first() if weather else ()
    scale = [(s if s is not None and s > 1e-9 else 1.0) + eps for s in row]
    read = grid.select(SITE, "dt", *[q(c).cast("double").alias(f"m{i}") for i, c in enumerate(measures)])
    dealt = beside(read, _destinations(sites, edges, size), [SITE])
    # A site without a place stays by itself.
    alone = -1 - F.pmod(F.xxhash64(SITE), F.lit(4096))
    dealt = dealt.select(
        "*", F.explode(F.coalesce("_cells", F.array(alone))).alias("_cell"), F.floor(epoch_us(F.col("dt")) / block_us).alias("_block")
    ).withColumn("_here", F.col("_cell") == F.coalesce("_own", alone))
    dealt = dealt.withColumn("_near", F.when(F.col("_here"), F.col("_near"))).drop("_cells", "_own")
    kinds = {f.name: f.dataType for f in grid.schema}
    doubles = ("x", "ref", "e", "e_meteo")
    schema = T.StructType(
        [T.StructField("channel", T.StringType()), T.StructField(SITE, kinds[SITE]), T.StructField("dt", kinds["dt"]), *(T.StructField(c, T.DoubleType()) for c in doubles)]
    )
    at = {c: i for i, c in enumerate(measures)}

    def deviations(table: pa.Table) -> pa.Table:
        site, dt = (table[c].combine_chunks().dictionary_encode() for c in (SITE, "dt"))
        s, t = site.indices.to_numpy(), dt.indices.to_numpy()
        shape = (len(dt.dictionary), len(site.dictionary))
        held = np.full((len(measures), *shape), np.nan)
        for i in range(len(measures)):
            held[i, t, s] = table[f"m{i}"].to_numpy()
        exists = np.zeros(shape, bool)
        exists[t, s] = True
        here = np.flatnonzero(table["_here"].to_numpy())
        lists = table["_near"].combine_chunks()
        # A site's neighbours as columns of the matrix; the last column stands for nobody.
        known = pc.index_in(lists.flatten(), value_set=site.dictionary).fill_null(shape[1]).to_numpy()
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        starts = np.cumsum(lengths) - lengths
        width = max(1, int(lengths.max(initial=0)))
        near = np.full((shape[1] + 1, width), shape[1])
        own, first = np.unique(s[here], return_index=True)
        for code, r in zip(own, here[first]):
            near[code, : lengths[r]] = known[starts[r] : starts[r] + lengths[r]]
        held = np.concatenate([held, np.full((len(measures), shape[0], 1), np.nan)], axis=2)
        exists = np.concatenate([exists, np.zeros((shape[0], 1), bool)], axis=1)
        rows, cols = t[here], near[s[here]]
        there = exists[rows[:, None], cols]
        gap = np.where(there, 0.0, np.inf)
        for c, unit in zip(weather, scale):
            step = (held[at[c], rows, s[here]][:, None] - held[at[c], rows[:, None], cols]) / unit
            gap = gap + np.nan_to_num(step * step, nan=0.0)
        order = np.argsort(gap, axis=1, kind="stable")
        alike = np.zeros_like(there)
        np.put_along_axis(alike, order[:, :k_meteo], True, axis=1)
        out = []
        for c in channels:
            x, around = held[at[c], rows, s[here]], held[at[c], rows[:, None], cols]
            ref, meteo = _mean(around, there), _mean(around, there & alike)
            e, em = (np.abs(x - r) / (np.abs(r) + eps) for r in (ref, meteo))
            columns = [pa.array([c] * len(here), pa.string()), table[SITE].combine_chunks().take(here), table["dt"].combine_chunks().take(here)]
            out.append(pa.table([*columns, *(pa.array(v, pa.float64(), from_pandas=True) for v in (x, ref, e, em))], schema.names))
        return pa.concat_tables(out)

    return dealt.groupBy("_cell", "_block").applyInArrow(deviations, schema)
