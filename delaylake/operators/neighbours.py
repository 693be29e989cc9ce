"""Nearest neighbours with exclusions: a top-k join of targets and libraries.

A kernel compares some targets to some of the library in numpy and returns the best k of each target;
a second step keeps the best k over all. A library of one block is compared whole. A larger one is
searched exactly but not whole: library and targets of a task (emb_num, bundle_num, set_num) are dealt
into cells of about ``CELL`` rows, slabs of the first coordinate cut by the last one, each with its box.
Every target first searches the cell nearest to its own, and its k-th distance there bounds what can
still count; it then goes only to cells whose box is not farther than that. Only pairs of boxes are
compared all with all. No task holds more than a cell of either side.

Squared distances are summed in coordinate order. Ties go to the smaller vec_num, then vec_idx.
``seq`` counts from the farthest (1) to the nearest neighbour.

``with_nearest`` hands each target's neighbours straight to a function and writes no table of them. Rows
are dealt once into tiles that travel and are kept as packed columns, one row a tile. A tile is searched
by itself first, in small cells; then it gets from other tiles only rows that can still count, judged
by the boxes and k-th distances of its cells, and is searched again. Of rows equally far only those of
smaller numbers count, so large groups of equal vectors are not sent about.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import IntFlag
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from delaylake.functions.tables import cut, positions
from delaylake.operators.split import GROUP, Sets

TASK = [*GROUP, "set_num"]
TARGET_BLOCK, LIBRARY_BLOCK, CELL = 2048, 4096, 2048
#: Rows of a packed tile and of a cell inside it; one row of so many helps to place the tiles' borders, and only that; most pairs compared at once.
TILE, INNER, BORDER, STACK = 8192, 128, 128, 1 << 22
TARGET, LIBRARY = 1, 2


class Exclusion(IntFlag):
    """What is excluded beside the target itself."""

    NONE = 0
    TIME_COORD = 1  # a candidate that shares a time of a coordinate (of the same variable if corrected)
    TIME_WINDOW = 2  # a candidate whose first coordinate's time is nearer than ``window``


@dataclass(frozen=True)
class Search:
    exclude: Exclusion = Exclusion.NONE
    window: int = 0
    once: bool = False  # a vector that the library holds more than once counts once
    #: Variable numbers of the coordinates, for compat="corrected": one tuple for all embeddings, or one for each emb_num.
    co_var: tuple[int, ...] | dict[int, tuple[int, ...]] | None = None

    def variables(self, emb_num: int) -> tuple[int, ...] | None:
        return self.co_var[emb_num] if isinstance(self.co_var, dict) else self.co_var


def excluded(search: Search, t_target: np.ndarray, t_lib: np.ndarray, v_target: np.ndarray, v_lib: np.ndarray, emb_num: int = 0) -> np.ndarray:
    """Targets x library: whether a candidate is excluded."""
    out = v_target[:, None] == v_lib[None, :]
    if search.exclude & Exclusion.TIME_COORD:
        e, variable = t_target.shape[1], search.variables(emb_num)
        for i in range(e):
            for j in range(e):
                if variable is None or variable[i] == variable[j]:
                    out |= t_target[:, i][:, None] == t_lib[:, j][None, :]
    if search.exclude & Exclusion.TIME_WINDOW:
        out |= np.abs(t_target[:, 0][:, None] - t_lib[:, 0][None, :]) < search.window
    return out


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        d = a[:, i][:, None] - b[:, i][None, :]
        out += d * d
    return out


def _stack(column: pd.Series, kind) -> np.ndarray:
    return np.array(column.tolist(), dtype=kind).reshape(len(column), -1)


FOUND = "target_idx long, target_num long, num long, vec_idx long, sqdst double, pre array<double>"


def _nearest(search: Search, k_of: dict[int, int]):
    """k_of: neighbours for each emb_num."""

    def kernel(key, targets: pd.DataFrame, library: pd.DataFrame) -> pd.DataFrame:
        names = [*TASK, "target_idx", "target_num", "num", "vec_idx", "sqdst", "pre"]
        if not len(targets) or not len(library):
            return pd.DataFrame([], columns=names, dtype=object)
        k = min(k_of[int(key[0])], len(library))
        library = library.sort_values(["vec_num", "vec_idx"], kind="stable")
        if search.once:
            library = library.drop_duplicates("vec_num")
            k = min(k, len(library))
        v_lib, v_target = library["vec_num"].to_numpy(), targets["vec_num"].to_numpy()
        distance = squared_distances(_stack(targets["co"], float), _stack(library["co"], float))
        distance[excluded(search, _stack(targets["t_co"], np.int64), _stack(library["t_co"], np.int64), v_target, v_lib, int(key[0]))] = np.inf
        # the k smallest with their ties at the edge in the library's order
        edge = np.partition(distance, k - 1, axis=1)[:, k - 1]
        row, column = np.nonzero((distance <= edge[:, None]) & np.isfinite(distance))
        order = np.lexsort((column, distance[row, column], row))
        row, column = row[order], column[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, column = row[rank < k], column[rank < k]
        out = pd.DataFrame({n: np.full(len(row), int(x)) for n, x in zip(TASK, key, strict=False)})
        out["target_idx"], out["target_num"] = targets["vec_idx"].to_numpy()[row], v_target[row]
        out["num"], out["vec_idx"], out["sqdst"] = v_lib[column], library["vec_idx"].to_numpy()[column], distance[row, column]
        out["pre"] = library["pre"].to_numpy()[column]
        return out[names]

    return kernel


def with_vectors(members: DataFrame, vectors: DataFrame) -> DataFrame:
    points = vectors.select("emb_num", "vec_num", "t_co", "co", "pre")
    return _own(_own(members).join(_own(points), ["emb_num", "vec_num"]))


def _compared(left: DataFrame, right: DataFrame, key: list[str], k_of: dict[int, int], search: Search) -> DataFrame:
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_nearest(search, k_of), f"emb_num int, bundle_num int, set_num long, {FOUND}")


def _tiled(rows: DataFrame, name: str) -> DataFrame:
    """Rows of each task in cells of about ``CELL``, numbered from 0: slabs of the first coordinate, cut by the last."""
    ends = rows.withColumns({"_c0": F.get("co", F.lit(0)), "_c1": F.element_at("co", -1)})
    slabs = positions(ends, TASK, ["_c0", "_c1", "vec_idx"], "_p", "_n")
    slabs = slabs.withColumn("_slab", F.floor(F.col("_p") * F.ceil(F.sqrt(F.col("_n") / CELL)) / F.col("_n"))).drop("_p", "_n")
    cut_ = positions(slabs, [*TASK, "_slab"], ["_c1", "_c0", "vec_idx"], "_p", "_n")
    cell = F.shiftleft("_slab", 32) + F.floor(F.col("_p") * F.ceil(F.col("_n") / CELL) / F.col("_n"))
    return cut(cut_.withColumn(name, cell).drop("_c0", "_c1", "_p", "_n", "_slab"), name)


def _boxes(rows: DataFrame, name: str, most: int) -> DataFrame:
    """(task, cell, lo, hi): the smallest and largest value of each coordinate."""
    side = lambda f: F.filter(F.array(*[f(F.get("co", F.lit(i))) for i in range(most)]), lambda x: x.isNotNull())
    return cut(rows.groupBy(*TASK, name).agg(side(F.min).alias(f"{name}_lo"), side(F.max).alias(f"{name}_hi")), "boxes")


def _gap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """The squared distance of two boxes, summed in coordinate order like that of two points, so never above theirs."""
    sides = F.zip_with(F.zip_with(lo_a, hi_b, lambda a, b: a - b), F.zip_with(lo_b, hi_a, lambda a, b: a - b), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(sides, F.lit(0.0), lambda total, x: total + x * x)


def _dealt(tiles: DataFrame, cells: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _own(tiles.join(pairs, [*TASK, "_tile"])), _own(_own(cells).join(_own(pairs.select(*TASK, "_tile", "_cell")), [*TASK, "_cell"]))


def _own(rows: DataFrame) -> DataFrame:
    """The same rows under names of their own: both sides of a cogroup may come from the same tables."""
    return rows.select(*[F.col(c).alias(c) for c in rows.columns])


def rounds(tiles: DataFrame, cells: DataFrame, k_of: dict[int, int], search: Search):
    """The two rounds of a search: what meets, each as (targets, library) keyed by task, tile and cell, and the first one's result."""
    key = [*TASK, "_tile", "_cell"]
    most = max(r["n"] for r in tiles.select(F.size("co").alias("n")).distinct().collect())
    met = _boxes(tiles, "_tile", most).join(_boxes(cells, "_cell", most), TASK)
    gap = _gap(F.col("_tile_lo"), F.col("_tile_hi"), F.col("_cell_lo"), F.col("_cell_hi"))
    middle = F.aggregate(F.zip_with(F.zip_with("_tile_lo", "_tile_hi", lambda a, b: a + b), F.zip_with("_cell_lo", "_cell_hi", lambda a, b: a + b), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
    home = cut(met.groupBy(*TASK, "_tile").agg(F.min_by("_cell", F.struct(gap, middle, "_cell")).alias("_cell")), "home")
    first = _dealt(tiles, cells, home)
    found = cut(_compared(*first, key, k_of, search), "first")
    yield first, found
    k = F.create_map(*[F.lit(x) for pair in k_of.items() for x in pair])[F.col("emb_num")]
    far = found.groupBy(*TASK, "target_idx").agg(F.count(F.lit(1)).alias("_n"), F.max("sqdst").alias("_far"))
    # a target with fewer than k in the first cell has no bound
    bounds = far.select(*TASK, F.col("target_idx").alias("vec_idx"), F.when(F.col("_n") >= k, F.col("_far")).alias("_bound"))
    bounded = cut(tiles.join(bounds, [*TASK, "vec_idx"], "left").withColumn("_bound", F.coalesce("_bound", F.lit(float("inf")))), "bounded")
    reach = bounded.groupBy(*TASK, "_tile").agg(F.max("_bound").alias("_reach"))
    others = met.join(reach, [*TASK, "_tile"]).join(home.withColumnRenamed("_cell", "_home"), [*TASK, "_tile"]).filter((F.col("_cell") != F.col("_home")) & (gap <= F.col("_reach")))
    others = cut(others.select(*TASK, "_tile", "_cell", "_cell_lo", "_cell_hi"), "others")
    left, right = _dealt(bounded, cells, others)
    left = left.filter(_gap(F.col("co"), F.col("co"), F.col("_cell_lo"), F.col("_cell_hi")) <= F.col("_bound"))
    second = left.drop("_bound", "_cell_lo", "_cell_hi"), right
    yield second, _compared(*second, key, k_of, search)


def _searched(tiles: DataFrame, cells: DataFrame, k_of: dict[int, int], search: Search) -> DataFrame:
    first, second = (found for _, found in rounds(tiles, cells, k_of, search))
    return first.unionByName(second)


def neighbours(sets: Sets, vectors: DataFrame, k_of: dict[int, int], search: Search = Search()) -> DataFrame:
    """(task, target_idx, target_num, seq, num, vec_idx, sqdst, pre of the neighbour), at most k a target."""
    targets, library = with_vectors(sets.prediction, vectors), with_vectors(sets.library, vectors)
    largest = sets.library.agg(F.max("vec_idx")).first()[0] or 0
    if largest < LIBRARY_BLOCK:
        key = [*TASK, "_tb"]
        block = F.floor(F.col("vec_idx") / TARGET_BLOCK).alias("_tb")
        blocks = sets.prediction.select(*TASK, block).distinct()
        found = _compared(targets.select("*", block), library.join(blocks, TASK), key, k_of, search)
    else:
        tiles = _tiled(targets, "_tile")
        cells = tiles.withColumnRenamed("_tile", "_cell") if sets.prediction is sets.library else _tiled(library, "_cell")
        found = _searched(tiles, cells, k_of, search)
    order = Window.partitionBy(*TASK, "target_idx").orderBy("sqdst", "num", "vec_idx")
    limit = F.create_map(*[F.lit(x) for pair in k_of.items() for x in pair])[F.col("emb_num")]
    if search.once:
        again = Window.partitionBy(*TASK, "target_idx", "num").orderBy("vec_idx")
        found = found.withColumn("_again", F.row_number().over(again)).filter("_again = 1").drop("_again")
    ranked = found.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit)
    count = F.count(F.lit(1)).over(Window.partitionBy(*TASK, "target_idx"))
    return ranked.withColumn("n_found", count).withColumn("seq", (F.col("n_found") - F.col("_rank") + 1).cast("int")).drop("_rank")


class Points(NamedTuple):
    """Rows of a task as arrays; ``side`` says whether a row is a target, in the library or both."""

    idx: np.ndarray
    num: np.ndarray
    side: np.ndarray
    co: np.ndarray
    pre: np.ndarray
    t_co: np.ndarray

    def of(self, rows: np.ndarray) -> Points:
        return Points(*(a[rows] for a in self))

    def packed(self) -> dict:
        return {name: np.ascontiguousarray(a).tobytes() for name, a in zip(self._fields, self, strict=True)}


_KINDS = Points(np.int64, np.int64, np.int8, np.float64, np.float64, np.int64)
PACKED = "n int, " + ", ".join(f"{name} binary" for name in Points._fields)


def _points(table: pa.Table) -> Points:
    some = table.num_rows

    def column(name: str, kind) -> np.ndarray:
        found = table.column(name)
        if not pa.types.is_list(found.type) and not pa.types.is_large_list(found.type):
            return found.to_numpy().astype(kind)
        return pc.list_flatten(found).to_numpy().astype(kind).reshape(some, -1) if some else np.zeros((0, 0), kind)

    return Points(*(column(name, kind) for name, kind in zip(("vec_idx", "vec_num", "side", "co", "pre", "t_co"), _KINDS, strict=True)))


def _unpacked(rows: list[dict]) -> Points:
    """The rows of packed columns, one after the other."""
    parts = []
    for r in rows:
        flat = [np.frombuffer(r[name], kind) for name, kind in zip(Points._fields, _KINDS, strict=True)]
        parts.append(Points(*flat[:3], *(a.reshape(r["n"], -1) for a in flat[3:])))
    return Points(*(np.concatenate(arrays) for arrays in zip(*parts, strict=True))) if len(parts) > 1 else parts[0]


def _split(co: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers in cells of at most ``most``: slabs of the first coordinate cut by the last one."""
    if not len(co):
        return []
    slabs = max(1, round(np.sqrt(len(co) / most)))
    out = []
    for slab in np.array_split(np.lexsort((co[:, -1], co[:, 0])), slabs):
        slab = slab[np.lexsort((co[slab, 0], co[slab, -1]))]
        out += np.array_split(slab, max(1, -(-len(slab) // most)))
    return [rows for rows in out if len(rows)]


def _apart(lo: np.ndarray, hi: np.ndarray, other_lo: np.ndarray, other_hi: np.ndarray) -> np.ndarray:
    """Squared distances of boxes (a row each) to others, summed in coordinate order: never above those of points inside."""
    out = np.zeros((len(lo), len(other_lo)))
    for i in range(lo.shape[1]):
        d = np.maximum(np.maximum(lo[:, i][:, None] - other_hi[:, i], other_lo[:, i] - hi[:, i][:, None]), 0.0)
        out += d * d
    return out


class Found(NamedTuple):
    """Of each target the ``k`` nearest, near to far: library rows (-1: none), squared distances, how many there are."""

    row: np.ndarray
    sqdst: np.ndarray
    number: np.ndarray


def _best(search: Search, emb_num: int, k: int, targets: Points, library: Points, candidates: np.ndarray) -> Found:
    """Targets against ``candidates``, row numbers of a library in order of (num, idx)."""
    row = np.full((len(targets.idx), k), -1)
    sqdst, number = np.full((len(targets.idx), k), np.inf), np.zeros(len(targets.idx), np.int64)
    if not len(candidates):
        return Found(row, sqdst, number)
    some = library.of(candidates)
    step = max(1, STACK // len(candidates))
    for a in range(0, len(targets.idx), step):
        mine = targets.of(slice(a, a + step))
        distance = squared_distances(mine.co, some.co)
        distance[excluded(search, mine.t_co, some.t_co, mine.num, some.num, emb_num)] = np.inf
        edge = np.partition(distance, min(k, len(candidates)) - 1, axis=1)[:, min(k, len(candidates)) - 1]
        at, column = np.nonzero((distance <= edge[:, None]) & np.isfinite(distance))
        order = np.lexsort((column, distance[at, column], at))
        at, column = at[order], column[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        at, column, rank = at[rank < k], column[rank < k], rank[rank < k]
        row[a + at, rank], sqdst[a + at, rank] = candidates[column], distance[at, column]
        number[a : a + step] = np.bincount(at, minlength=len(mine.idx))
    return Found(row, sqdst, number)


def _bounds(found: Found, library: Points) -> tuple[float, float]:
    """How far a row may be to count for any of some targets, and the largest number that counts at that distance."""
    if (found.number < found.row.shape[1]).any():
        return np.inf, np.inf
    far = found.sqdst[:, -1]
    reach = far.max()
    return float(reach), float(library.num[found.row[far == reach, -1]].max())


def _counting(gap: np.ndarray, num: np.ndarray, reach, last) -> np.ndarray:
    return (gap < reach) | ((gap == reach) & (num <= last))


def _ordered(library: Points, search: Search) -> Points:
    library = library.of(np.lexsort((library.idx, library.num)))
    return library.of(np.flatnonzero(np.diff(library.num, prepend=library.num[:1] - 1) != 0)) if search.once else library


def nearest_rows(search: Search, emb_num: int, k: int, targets: Points, library: Points):
    """Of each cell of targets their row numbers, what an ``_ordered`` library has near them, and lo, hi, reach and last number."""
    homes = [np.sort(rows) for rows in _split(library.co, max(INNER, 2 * k))]
    if homes:
        lows, highs = (np.array([f(library.co[rows], axis=0) for rows in homes]) for f in (np.min, np.max))
    for rows in _split(targets.co, INNER):
        some = targets.of(rows)
        lo, hi = some.co.min(0), some.co.max(0)
        candidates = np.zeros(0, np.int64)
        if homes:
            middle = ((lows + highs - lo - hi) ** 2).sum(1)
            home = homes[np.lexsort((middle, _apart(lo[None], hi[None], lows, highs)[0]))[0]]
            reach, last = _bounds(_best(search, emb_num, k, some, library, home), library)
            candidates = np.flatnonzero(_counting(_apart(lo[None], hi[None], library.co, library.co)[0], library.num, reach, last))
        found = _best(search, emb_num, k, some, library, candidates)
        yield rows, found, (*lo, *hi, *_bounds(found, library))


def _borders(rows: DataFrame, tile: int) -> dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From one in ``BORDER`` rows, for each task: borders of the slabs, of the cells in each, and the parts of each cell."""
    ends = [F.get("co", F.lit(0)).alias("a"), F.element_at("co", -1).alias("b"), F.col("side").bitwiseAND(LIBRARY).alias("side")]
    some = rows.select(*TASK, *ends).toPandas()
    out = {}
    for key, each in some.groupby(TASK):
        count, known = len(each) * BORDER / tile, each[each["side"] > 0] if (each["side"] > 0).any() else each
        slabs = max(1, round(np.sqrt(count)))
        inside = np.arange(1, slabs) / slabs
        cut_ = np.quantile(known["a"], inside, method="nearest") if slabs > 1 else np.zeros(0)
        slab, cells = np.searchsorted(cut_, known["a"], side="right"), np.full((slabs, slabs - 1), np.inf)
        for i in range(slabs):
            if slabs > 1 and (slab == i).any():
                cells[i] = np.quantile(known["b"][slab == i], inside, method="nearest")
        at = _cells(each["a"].to_numpy(), each["b"].to_numpy(), cut_, cells)
        out[tuple(int(x) for x in key)] = cut_, cells, np.maximum(1, np.ceil(np.bincount(at, minlength=slabs * slabs) * BORDER / tile - 0.5)).astype(np.int64)
    return out


def _cells(a: np.ndarray, b: np.ndarray, cut_: np.ndarray, cells: np.ndarray) -> np.ndarray:
    slab = np.searchsorted(cut_, a, side="right")
    return slab * len(cells) + (b[:, None] >= cells[slab]).sum(1)


def _in_tiles(rows: DataFrame, borders: dict) -> DataFrame:
    """``rows`` with ``_tile``; a cell of far more than a tile's rows (equal ones) is dealt into parts by vec_idx."""

    @F.pandas_udf("long")
    def tile(emb: pd.Series, bundle: pd.Series, number: pd.Series, idx: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(idx), np.int64)
        keys, which = np.unique(np.stack([emb, bundle, number], axis=1), axis=0, return_inverse=True)
        for i, key in enumerate(keys):
            if tuple(int(x) for x in key) in borders:
                cut_, cells, parts = borders[tuple(int(x) for x in key)]
                at = np.flatnonzero(which.ravel() == i)
                cell = _cells(a.to_numpy()[at], b.to_numpy()[at], cut_, cells)
                out[at] = (cell << 32) + idx.to_numpy()[at] % parts[cell]
        return pd.Series(out)

    return rows.withColumn("_tile", tile(*TASK, "vec_idx", F.get("co", F.lit(0)), F.element_at("co", -1)))


def _sides(points: Points) -> tuple[Points, Points]:
    return points.of((points.side & TARGET) > 0), points.of((points.side & LIBRARY) > 0)


def _met(tiles: pd.DataFrame) -> list[tuple]:
    """(task, _tile, _cell) of tiles and other tiles whose library may count for them."""
    out, step = [], 256
    for key, each in tiles.groupby(TASK):
        box = [np.array(each[c].tolist(), float).reshape(len(each), -1) for c in ("lo", "hi", "lib_lo", "lib_hi")]
        reach, names, has = each["reach"].to_numpy(), each["_tile"].to_numpy(), each["lib_n"].to_numpy() > 0
        wants = reach >= 0  # -1: no targets
        for a in range(0, len(each), step):
            near = (_apart(box[0][a : a + step], box[1][a : a + step], box[2], box[3]) <= reach[a : a + step, None]) & has & wants[a : a + step, None]
            for i, j in zip(*np.nonzero(near), strict=True):
                if a + i != j:
                    out.append((*(int(x) for x in key), int(names[a + i]), int(names[j])))
    return out


def _held(targets: Points, held: list[tuple], library: Points) -> tuple[Points, Points, Found]:
    return targets.of(np.concatenate([rows for rows, _ in held])), library, Found(*(np.concatenate(a) for a in zip(*(found for _, found in held), strict=True)))


def with_nearest(sets: Sets, vectors: DataFrame, k: int, search: Search, made: Callable, schema: str) -> DataFrame:
    """What ``made(key, targets, library, found)``, an Arrow table, gives for all targets, in portions; the same neighbours as ``neighbours``."""
    spark, key, width = vectors.sparkSession, [*TASK, "_tile"], "emb_num int, bundle_num int, set_num long, _tile long, "
    alike = sets.prediction is sets.library
    sides = [(sets.library, TARGET | LIBRARY)] if alike else [(sets.prediction, TARGET), (sets.library, LIBRARY)]

    def points(some: Column | None = None) -> DataFrame:
        out = None
        for members, side in sides:
            one = with_vectors(members, vectors) if some is None else with_vectors(members.filter(some), vectors.filter(some))
            one = one.select(*TASK, "vec_idx", "vec_num", F.lit(side).alias("side"), "co", "pre", "t_co" if search.exclude else F.array().cast("array<long>").alias("t_co"))
            out = one if out is None else out.unionByName(one)
        return out

    made_schema = to_arrow_schema(StructType.fromDDL(schema))

    def ended(task: tuple, targets: Points, library: Points) -> pa.Table:
        """Cells of targets are put together as far as their neighbours fit a stack."""
        library, out, held = _ordered(library, search), [], []
        for rows, found, _ in nearest_rows(search, task[0], k, targets, library):
            held.append((rows, found))
            if sum(len(r) for r, _ in held) * k > STACK // 8:
                out.append(made(task[:3], *_held(targets, held, library)))
                held = []
        if held:
            out.append(made(task[:3], *_held(targets, held, library)))
        return pa.concat_tables(out) if out else made_schema.empty_table()

    sizes = [members.groupBy(*TASK).count().agg(F.max("count")).first()[0] or 0 for members, _ in sides]
    tile = max(TILE, 4 * k)
    if sum(sizes) <= tile:
        alone = lambda task, rows: ended(tuple(x.as_py() for x in task), *_sides(_points(rows)))
        return points().groupBy(*TASK).applyInArrow(alone, schema)

    tile_ddl = f"{width}{PACKED}, cells binary, lo array<double>, hi array<double>, reach double, lib_n int, lib_lo array<double>, lib_hi array<double>"
    tile_schema, sent_ddl = to_arrow_schema(StructType.fromDDL(tile_ddl)), width + PACKED
    sent_schema = to_arrow_schema(StructType.fromDDL(sent_ddl))

    def packed(task: tuple, rows: pa.Table) -> pa.Table:
        all_ = _points(rows)
        task = tuple(x.as_py() for x in task)
        targets, library = _sides(all_)
        cells = np.array([cell for _, _, cell in nearest_rows(search, task[0], k, targets, _ordered(library, search))])
        ends = lambda some: [f(axis=0).tolist() if len(some) else [0.0] * some.shape[1] for f in (some.min, some.max)]
        (lo, hi), (lib_lo, lib_hi) = ends(targets.co), ends(library.co)
        reach = max((float(cell[-2]) for cell in cells), default=-1.0)
        one = dict(zip(key, task, strict=True)) | all_.packed() | {"n": len(all_.idx), "cells": cells.tobytes()}
        one |= {"lo": lo, "hi": hi, "reach": reach, "lib_n": len(library.idx), "lib_lo": lib_lo, "lib_hi": lib_hi}
        return pa.Table.from_pylist([one], schema=tile_schema)

    dealt = _in_tiles(points(), _borders(points(F.pmod(F.xxhash64("vec_num"), F.lit(BORDER)) == 0), tile))
    tiles = cut(dealt.groupBy(*key).applyInArrow(packed, tile_ddl), "tiles")
    met = _met(tiles.select(*key, "lo", "hi", "reach", "lib_n", "lib_lo", "lib_hi").toPandas())
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    columns = zip(*met, strict=True) if met else [[]] * 5
    pairs = spark.createDataFrame(pa.table({name: pa.array(c, kind) for name, c, kind in zip([*key, "_cell"], columns, kinds, strict=True)}))
    wants = _own(pairs.join(tiles.select(*key, "cells"), key))

    def sent(task: tuple, cell: pa.Table, wants: pa.Table) -> pa.Table:
        """The rows of a tile's library that may count for each of some tiles."""
        out = []
        if cell.num_rows and wants.num_rows:
            library = _sides(_unpacked(cell.to_pylist()))[1]
            library = library._replace(side=np.full(len(library.idx), LIBRARY, np.int8))
            e = library.co.shape[1]
            lo, hi = library.co.min(0)[None], library.co.max(0)[None]
            for want in wants.to_pylist():
                cells = np.frombuffer(want["cells"]).reshape(-1, 2 * e + 2)
                cells = cells[_apart(cells[:, :e], cells[:, e : 2 * e], lo, hi)[:, 0] <= cells[:, -2]]
                gap = _apart(cells[:, :e], cells[:, e : 2 * e], library.co, library.co)
                some = library.of(_counting(gap, library.num, cells[:, -2:-1], cells[:, -1:]).any(0))
                if len(some.idx):
                    out.append({c: want[c] for c in key} | some.packed() | {"n": len(some.idx)})
        return pa.Table.from_pylist(out, schema=sent_schema)

    rows = [*TASK, "n", *Points._fields]
    givers = _own(tiles.filter("lib_n > 0").select(*rows, F.col("_tile").alias("_cell")))
    given = givers.groupBy(*TASK, "_cell").cogroup(wants.groupBy(*TASK, "_cell")).applyInArrow(sent, sent_ddl)

    def joined(task: tuple, own: pa.Table, given: pa.Table) -> pa.Table:
        if not own.num_rows:
            return made_schema.empty_table()
        targets, library = _sides(_unpacked(own.to_pylist()))
        if given.num_rows:
            library = Points(*(np.concatenate(a) for a in zip(library, _unpacked(given.to_pylist()), strict=True)))
        return ended(tuple(x.as_py() for x in task), targets, library)

    takers = _own(tiles.filter("reach >= 0").select(*rows, "_tile"))
    return takers.groupBy(*key).cogroup(given.groupBy(*key)).applyInArrow(joined, schema)
