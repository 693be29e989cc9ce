"""Locally weighted total least squares maps (S-maps).

For each target the library (all of it, or the nearest ``nnn``) makes an augmented matrix of the
constant, coordinates and prediction values, rows weighted by exp(-theta d / reference distance);
its total least squares solution is evaluated at the target.

Only the triangular factor of a weighted matrix matters, and that of stacked factors is that of the
whole, so a library of any size is dealt in blocks: a first pass gives each target its distance scale
and means, a second one a factor of each library block, and small factors are joined and solved. A
library of one block takes one pass. Factors, singular values and solutions of many targets are
computed as stacks. With neighbours each portion of targets is solved where they are found, so they are
never a table; only the log asks for that.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from delaylake.functions.tables import cut
from delaylake.operators.neighbours import TASK, Found, Points, Search, _stack, excluded, neighbours, squared_distances, with_nearest, with_vectors
from delaylake.operators.split import Sets

TOL_RANK, TOL_SINGULAR, SMALL = 1e-16, 1e-5, 1e-15
#: Status bits.
NO_POINTS, WARNED, FAILED, WARNING_IS_ERROR, RESTRICTED, WARNING, ERROR = 0x0001, 0x0002, 0x0004, 0x0008, 0x0010, 0x0100, 0x2000
TARGET_BLOCK, LIBRARY_BLOCK, STACK = 512, 4096, 1 << 22
OUT = (
    "emb_num int, bundle_num int, set_num long, params_id int, target_idx long, target_num long, pre_val_num int, "
    "pre_val double, obs_val double, status int, coef array<double>, means array<double>, rank int, n_used int, n_lib int, "
    "singular array<double>, vectors array<double>"
)


def triangles(c: np.ndarray) -> np.ndarray:
    """The triangular factors of a stack of matrices, square: rows of zeros where a matrix has fewer rows than columns."""
    *some, m, width = c.shape
    if m < width:
        c = np.concatenate((c, np.zeros((*some, width - m, width))), axis=-2)
    return np.linalg.qr(c, mode="r")


def from_singular(s: np.ndarray, vt: np.ndarray, m: int, n: int) -> tuple[np.ndarray, int, int]:
    """X with (A + dA) X = B + dB for C = [A B] of m rows, A of n columns, from C's singular values and right vectors.

    The rank counts singular values above sqrt(2 max(m, n + l)) * 1e-16, at most min(m, n).
    Warning 1: equal singular values at the cut lower the rank; 2: the solution would not exist,
    the rank is lowered until it does. Rank 0 gives X = 0.
    """
    width = len(s)
    s = np.where(np.arange(width) < m, s, 0.0)
    bound = np.sqrt(2.0 * max(m, width)) * TOL_RANK
    rank, warning = min(int((s > bound).sum()), min(m, n)), 0
    while rank and rank < width and s[rank - 1] - s[rank] <= bound:
        rank, warning = rank - 1, 1
    while rank:
        v2 = vt[rank:].T
        lower = np.linalg.qr(v2[n:].T, mode="r")
        if lower.shape[0] >= width - n and (np.abs(np.diag(lower)) > TOL_SINGULAR).all():
            return -v2[:n] @ np.linalg.pinv(v2[n:]), rank, warning
        rank, warning = rank - 1, 2
    return np.zeros((n, width - n)), 0, warning


def all_from_singular(s: np.ndarray, vt: np.ndarray, m: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``from_singular`` of many matrices of m rows each: solutions, ranks and warnings."""
    count, width = s.shape
    s = np.where(np.arange(width) < m[:, None], s, 0.0)
    bound = np.sqrt(2.0 * np.maximum(m, width)) * TOL_RANK
    rank, warning = np.minimum((s > bound[:, None]).sum(1), np.minimum(m, n)), np.zeros(count, np.int64)
    gaps, every = s - np.concatenate((s[:, 1:], np.full((count, 1), -np.inf)), axis=1), np.arange(count)
    while (even := (rank > 0) & (gaps[every, rank - 1] <= bound)).any():
        rank[even], warning[even] = rank[even] - 1, 1
    out, open_ = np.zeros((count, n, width - n)), rank > 0
    while open_.any():
        for r in np.unique(rank[open_]):
            at = np.flatnonzero(open_ & (rank == r))
            v2 = vt[at, r:].swapaxes(1, 2)
            exists = (np.abs(np.diagonal(np.linalg.qr(v2[:, n:].swapaxes(1, 2), mode="r"), axis1=1, axis2=2)) > TOL_SINGULAR).all(1)
            out[at[exists]] = -v2[exists, :n] @ np.linalg.pinv(v2[exists, n:])
            open_[at[exists]] = False
            rest = at[~exists]
            rank[rest], warning[rest] = rank[rest] - 1, 2
            open_[rest] = rank[rest] > 0
    return out, rank, warning


def total_least_squares(c: np.ndarray, n: int) -> tuple[np.ndarray, int, int]:
    """``from_singular`` of one matrix: X, numerical rank and warning."""
    _, s, vt = np.linalg.svd(triangles(c))
    return from_singular(s, vt, len(c), n)


def reference_distance(distance: np.ndarray, xnn: int | None, all_: bool, compat: str) -> float:
    """The scale of the weights: the mean distance, or one from the ``xnn`` nearest.

    The reference's recurrence v <- (d - v) / i over the nearest is no mean; it runs over the
    distances above 1e-15 from near to far for whole libraries, and over all neighbours from far
    to near else. "corrected" takes the mean of the nearest above 1e-15.
    """
    mean = float(distance.mean())
    if xnn is None:
        return mean
    return from_nearest(nearest(distance, xnn, all_, compat), mean, all_, compat)


def nearest(distance: np.ndarray, xnn: int, all_: bool, compat: str) -> np.ndarray:
    """The ``xnn`` smallest of the distances that count, in order."""
    counted = distance[distance >= SMALL] if all_ or compat != "reference" else distance
    return np.sort(np.partition(counted, xnn - 1)[:xnn] if 0 < xnn < len(counted) else counted)[:xnn]


def from_nearest(near: np.ndarray, mean: float, all_: bool, compat: str) -> float:
    if compat != "reference":
        return float(near.mean()) if len(near) else mean
    value = 0.0
    for i, d in enumerate(near if all_ else near[::-1], 1):
        value = (d - value) / i
    return float(value) if value != 0 else mean


@dataclass(frozen=True)
class SMap:
    """``thetas`` by repeated addition from the smallest to the largest (``sweep``); nnn = 0 uses the whole library.

    ``restrict``: predictions beyond +-restrict become missing. ``xnn``: see ``reference_distance``.
    """

    thetas: tuple[float, ...] = (0.0,)
    nnn: int = 0
    search: Search = Search()
    center: bool = False
    restrict: float = 0.0
    warn_is_error: bool = False
    xnn: int | None = None
    compat: str = "reference"
    arrays: bool = False  # keep singular values and right vectors, for the log
    kind = "tls"

    @staticmethod
    def sweep(least: float, most: float, step: float) -> tuple[float, ...]:
        if step <= 0:
            raise ValueError("a sweep needs a positive step")
        out, theta = [], least
        while theta <= most + 1e-10:
            out.append(theta)
            theta += step
        return tuple(out)

    def params(self) -> list[dict]:
        return [{"params_id": i, "theta": t} for i, t in enumerate(self.thetas)]

    def logged(self) -> tuple[str, list[tuple]]:
        schema = "nnn int, excl int, var_win int, theta double, center int"
        return schema, [(i, self.nnn, int(self.search.exclude), self.search.window, float(t), int(self.center)) for i, t in enumerate(self.thetas)]

    def _scales(self, distance: np.ndarray, usable: np.ndarray) -> np.ndarray:
        """The distance scale of each target (1 where it is 0, as all weights are 1 then)."""
        number = np.maximum(usable.sum(1), 1)
        out = np.where(usable, distance, 0.0).sum(1) / number
        if self.xnn is not None:
            for i in np.flatnonzero(usable.any(1)):
                out[i] = from_nearest(nearest(distance[i][usable[i]], self.xnn, self.nnn <= 0, self.compat), out[i], self.nnn <= 0, self.compat)
        return out

    def _means(self, matrix: np.ndarray, usable: np.ndarray) -> np.ndarray:
        """Column means over the usable rows of each target, 0 for the constant; all 0 unless centred."""
        if not self.center:
            return np.zeros((len(usable), matrix.shape[-1]))
        sums = usable.astype(float) @ matrix[0] if len(matrix) == 1 else np.einsum("tm,tmw->tw", usable.astype(float), matrix)
        out = sums / np.maximum(usable.sum(1), 1)[:, None]
        out[:, 0] = 0.0
        return out

    def _factors(self, matrix: np.ndarray, distance: np.ndarray, usable: np.ndarray, scales: np.ndarray, means: np.ndarray) -> np.ndarray:
        """thetas x targets x width x width: triangular factors of the weighted matrices; ``matrix`` is one for all targets or one each."""
        targets, m = usable.shape
        width = matrix.shape[-1]
        out = np.empty((len(self.thetas), targets, width, width))
        step = max(1, STACK // max(1, m * width))
        for a in range(0, targets, step):
            part = slice(a, a + step)
            centred = (matrix if len(matrix) == 1 else matrix[part]) - means[part, None, :]
            scaled = distance[part] / np.where(scales[part] == 0, 1.0, scales[part])[:, None] * (scales[part] != 0)[:, None]
            for k, theta in enumerate(self.thetas):
                weight = np.where(usable[part], np.exp(-theta * scaled), 0.0)
                out[k, part] = triangles(centred * weight[:, :, None])
        return out

    def _solved(self, key, rows: list[tuple], factors: np.ndarray, used: np.ndarray, n_lib: int, means: np.ndarray) -> list[tuple]:
        """Output rows of targets (vec_idx, vec_num, x, observed) from their factors."""
        out = []
        for k in range(len(self.thetas)):
            good = np.isfinite(factors[k]).all(axis=(1, 2)) & (used > 0)
            s, vt = np.zeros(factors.shape[1:3]), np.zeros(factors.shape[1:])
            if good.any():
                _, s[good], vt[good] = np.linalg.svd(factors[k][good])
            for i, (idx, num, x, obs) in enumerate(rows):
                got = self._evaluate(x, len(obs), s[i], vt[i], int(used[i]), means[i], bool(good[i]))
                spare = (s[i].tolist(), vt[i].T.ravel().tolist()) if self.arrays and good[i] else (None, None)
                for j, value in enumerate(got["pre_val"]):
                    coef = None if got["coef"] is None else [float(v) for v in got["coef"][:, j]]
                    out.append((*key, k, idx, num, j, value, obs[j], got["status"], coef, got["means"], got["rank"], int(used[i]), n_lib, *spare))
        return out

    def _evaluate(self, x: np.ndarray, outputs: int, s: np.ndarray, vt: np.ndarray, used: int, means: np.ndarray, good: bool) -> dict:
        """One target: prediction values, status, coefficients, means, rank."""
        e = len(x)
        nothing = {"pre_val": [None] * outputs, "coef": None, "means": None, "rank": 0}
        if not used:
            return nothing | {"status": NO_POINTS}
        if not good:
            return nothing | {"status": ERROR | FAILED}
        coef, rank, warning = from_singular(s, vt, used, e + 1)
        if warning and self.warn_is_error:
            return nothing | {"status": warning * WARNING | WARNING_IS_ERROR, "rank": rank}
        status = warning * WARNING | WARNED if warning else 0
        value = np.concatenate(([1.0], x - means[1 : e + 1])) @ coef + means[e + 1 :]
        made = [float(v) for v in value]
        if self.restrict > 0 and any(abs(v) > self.restrict for v in made):
            made = [v if abs(v) <= self.restrict else None for v in made]
            status |= RESTRICTED
        return {"pre_val": made, "status": status, "coef": coef, "means": [float(v) for v in means] if self.center else None, "rank": rank}

    def solve(self, x: np.ndarray, co: np.ndarray, pre: np.ndarray, distance: np.ndarray, theta: float) -> dict:
        """One target and its library."""
        one, usable = replace(self, thetas=(theta,)), np.ones((1, len(co)), bool)
        matrix = _augmented(co, pre)[None]
        means = one._means(matrix, usable)
        factor = one._factors(matrix, distance[None], usable, one._scales(distance[None], usable), means)[0, 0]
        s, vt = np.linalg.svd(factor)[1:]
        return one._evaluate(x, pre.shape[1], s, vt, len(co), means[0], True)

    def predict(self, sets: Sets, vectors: DataFrame, e_of: dict[int, int]) -> tuple[DataFrame, Callable[[], DataFrame] | None]:
        """The predictions, and what finds the neighbours for the log: no table of them is needed here."""
        if self.nnn > 0:
            return self._near(sets, vectors), lambda: neighbours(sets, vectors, dict.fromkeys(e_of, self.nnn), self.search)
        targets = with_vectors(sets.prediction, vectors).withColumn("_tb", F.floor(F.col("vec_idx") / TARGET_BLOCK))
        largest = sets.library.agg(F.max("vec_idx")).first()[0] or 0
        if largest < LIBRARY_BLOCK:
            by = [*TASK, "_tb"]
            library = with_vectors(sets.library, vectors).join(cut(targets.select(*by).distinct(), "blocks"), TASK)
            return targets.groupBy(*by).cogroup(library.groupBy(*by)).applyInPandas(lambda key, some, library: self._whole(key, some, library), OUT), None
        return self._blockwise(sets, vectors, targets), None

    def _near(self, sets: Sets, vectors: DataFrame) -> DataFrame:
        schema = to_arrow_schema(StructType.fromDDL(OUT))

        def few(key, targets: Points, library: Points, found: Found) -> pa.Table:
            # from far to near, as ``seq`` counts
            order = found.number[:, None] - 1 - np.arange(self.nnn)
            usable = order >= 0
            row = np.where(usable, np.take_along_axis(found.row, np.maximum(order, 0), 1), 0)
            distance = np.sqrt(np.where(usable, np.take_along_axis(found.sqdst, np.maximum(order, 0), 1), 0.0))
            lines = _augmented(library.co, library.pre)
            matrix = lines[row] * usable[:, :, None] if len(lines) else np.zeros((*row.shape, 1 + targets.co.shape[1] + targets.pre.shape[1]))
            means = self._means(matrix, usable)
            factors = self._factors(matrix, distance, usable, self._scales(distance, usable), means)
            return self._table(key, targets, factors, found.number, means, schema)

        return with_nearest(sets, vectors, self.nnn, self.search, few, OUT)

    def _table(self, key, targets: Points, factors: np.ndarray, used: np.ndarray, means: np.ndarray, schema: pa.Schema) -> pa.Table:
        """What ``_solved`` gives, of all targets at once."""
        n, e, outputs = len(targets.idx), targets.co.shape[1], targets.pre.shape[1]
        made = []
        for k in range(len(self.thetas)):
            good = np.isfinite(factors[k]).all(axis=(1, 2)) & (used > 0)
            s, vt = np.zeros(factors.shape[1:3]), np.zeros(factors.shape[1:])
            if good.any():
                _, s[good], vt[good] = np.linalg.svd(factors[k][good])
            coef, rank, warning = np.zeros((n, e + 1, outputs)), np.zeros(n, np.int64), np.zeros(n, np.int64)
            coef[good], rank[good], warning[good] = all_from_singular(s[good], vt[good], used[good], e + 1)
            refused = (warning > 0) & self.warn_is_error
            status = np.where(warning > 0, warning * WARNING | (WARNING_IS_ERROR if self.warn_is_error else WARNED), 0)
            status = np.where(used == 0, NO_POINTS, np.where(good, status, ERROR | FAILED))
            solved = good & ~refused
            x = np.concatenate((np.ones((n, 1)), targets.co - means[:, 1 : e + 1]), axis=1)
            value = (x[:, None, :] @ coef)[:, 0] + means[:, e + 1 :]
            absent = ~solved[:, None] | np.isnan(value)
            if self.restrict > 0:
                far = np.abs(value) > self.restrict
                status = np.where(solved & far.any(1), status | RESTRICTED, status)
                absent |= far
            each = lambda a: np.repeat(a, outputs)
            spare = [_lists(a, each(good)) if self.arrays else pa.nulls(n * outputs) for a in (s.repeat(outputs, 0), vt.swapaxes(1, 2).reshape(n, -1).repeat(outputs, 0))]
            columns = [
                *(np.full(n * outputs, x) for x in (*key, k)), each(targets.idx), each(targets.num), np.tile(np.arange(outputs), n), pa.array(value.ravel(), mask=absent.ravel()),
                pa.array(targets.pre.ravel()), each(status), _lists(coef.swapaxes(1, 2).reshape(n * outputs, -1), each(solved)),
                _lists(means.repeat(outputs, 0), each(solved)) if self.center else pa.nulls(n * outputs), each(rank), each(used), np.full(n * outputs, self.nnn), *spare,
            ]
            made.append(pa.table([pa.array(c).cast(f.type) if isinstance(c, np.ndarray) else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))
        return pa.concat_tables(made)

    def _block(self, some: pd.DataFrame, library: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The matrix of a library block, and targets x library distances and whether a row may be used."""
        library = library.sort_values(["vec_num", "vec_idx"], kind="stable")
        co = _stack(library["co"], float)
        distance = np.sqrt(squared_distances(_stack(some["co"], float), co))
        out = excluded(self.search, _stack(some["t_co"], np.int64), _stack(library["t_co"], np.int64), some["vec_num"].to_numpy(), library["vec_num"].to_numpy(), int(some["emb_num"].iloc[0]))
        return _augmented(co, _stack(library["pre"], float))[None], distance, ~out

    def _whole(self, key, some: pd.DataFrame, library: pd.DataFrame) -> pd.DataFrame:
        """A target block against a whole library."""
        if not len(some):
            return pd.DataFrame([], columns=NAMES)
        rows = _rows(some)
        width = 1 + len(rows[0][2]) + len(rows[0][3])
        matrix, distance, usable = self._block(some, library) if len(library) else (np.zeros((1, 0, width)), np.zeros((len(some), 0)), np.zeros((len(some), 0), bool))
        means = self._means(matrix, usable)
        factors = self._factors(matrix, distance, usable, self._scales(distance, usable), means)
        return pd.DataFrame(self._solved(key[:3], rows, factors, usable.sum(1), len(library), means), columns=NAMES)

    def _blockwise(self, sets: Sets, vectors: DataFrame, targets: DataFrame) -> DataFrame:
        """Target blocks against library blocks: scales and means first, then factors, joined for each target."""
        library = with_vectors(sets.library, vectors).withColumn("_lb", F.floor(F.col("vec_idx") / LIBRARY_BLOCK))
        t_blocks, l_blocks = cut(targets.select(*TASK, "_tb").distinct(), "blocks"), cut(library.select(*TASK, "_lb").distinct(), "blocks")
        by, wide = [*TASK, "_tb", "_lb"], library.join(t_blocks, TASK)
        made = "target_idx long, number long, total double, sums array<double>, near array<double>"

        def summed(key, some: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
            names = [*TASK, *(c.split()[0] for c in made.split(", "))]
            if not len(some) or not len(part):
                return pd.DataFrame([], columns=names)
            matrix, distance, usable = self._block(some, part)
            sums = usable.astype(float) @ matrix[0]
            near = [nearest(distance[i][usable[i]], self.xnn, True, self.compat).tolist() if self.xnn else [] for i in range(len(some))]
            rows = zip(some["vec_idx"], usable.sum(1), np.where(usable, distance, 0.0).sum(1), sums.tolist(), near, strict=True)
            return pd.DataFrame([(*key[:3], *r) for r in rows], columns=names)

        schema = "emb_num int, bundle_num int, set_num long, "
        first = targets.join(l_blocks, TASK).groupBy(*by).cogroup(wide.groupBy(*by)).applyInPandas(summed, schema + made)

        def joined(key, parts: pd.DataFrame) -> pd.DataFrame:
            number = int(parts["number"].sum())
            mean = float(parts["total"].sum()) / max(number, 1)
            if self.xnn is not None and number:
                near = np.sort(np.concatenate(parts["near"].tolist()))[: self.xnn]
                mean = from_nearest(near, mean, True, self.compat)
            means = np.sum(parts["sums"].tolist(), axis=0) / max(number, 1) * (1.0 if self.center else 0.0)
            means[0] = 0.0
            return pd.DataFrame([(*key, number, mean, means.tolist())], columns=[*TASK, "target_idx", "number", "scale", "means"])

        scales = cut(first.groupBy(*TASK, "target_idx").applyInPandas(joined, schema + "target_idx long, number long, scale double, means array<double>"), "scales")
        known = targets.join(scales.withColumnRenamed("target_idx", "vec_idx"), [*TASK, "vec_idx"])

        def factored(key, some: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
            names = [*TASK, "target_idx", "n_lib", "factors"]
            if not len(some) or not len(part):
                return pd.DataFrame([], columns=names)
            factors = self._factors(*self._block(some, part), some["scale"].to_numpy(float), _stack(some["means"], float))
            return pd.DataFrame([(*key[:3], idx, len(part), factors[:, i].ravel().tolist()) for i, idx in enumerate(some["vec_idx"])], columns=names)

        parts = known.join(l_blocks, TASK).groupBy(*by).cogroup(library.join(t_blocks, TASK).groupBy(*by)).applyInPandas(factored, schema + "target_idx long, n_lib int, factors array<double>")
        parts = parts.withColumn("_tb", F.floor(F.col("target_idx") / TARGET_BLOCK))

        def ended(key, some: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
            if not len(some):
                return pd.DataFrame([], columns=NAMES)
            rows = _rows(some)
            width, place = 1 + len(rows[0][2]) + len(rows[0][3]), {r[0]: i for i, r in enumerate(rows)}
            factors = np.zeros((len(self.thetas), len(rows), width, width))
            at = parts["target_idx"].map(place).to_numpy(np.int64)
            found = np.array(parts["factors"].tolist()).reshape(len(parts), len(self.thetas), width, width)
            for i in range(len(rows)):
                mine = found[at == i]
                if len(mine):
                    factors[:, i] = triangles(mine.transpose(1, 0, 2, 3).reshape(len(self.thetas), -1, width))
            means, used = _stack(some["means"], float), some["number"].to_numpy(np.int64)
            n_lib = int(parts.loc[at == 0, "n_lib"].sum()) if len(parts) else 0
            return pd.DataFrame(self._solved(key[:3], rows, factors, used, n_lib, means), columns=NAMES)

        by = [*TASK, "_tb"]
        # a target without a library has no scale and gets its status all the same
        none = F.transform(F.sequence(F.lit(1), F.lit(1) + F.size("co") + F.size("pre")), lambda _: F.lit(0.0))
        every = targets.join(scales.withColumnRenamed("target_idx", "vec_idx"), [*TASK, "vec_idx"], "left")
        every = every.withColumns({"number": F.coalesce("number", F.lit(0)), "means": F.coalesce("means", none)})
        return every.groupBy(*by).cogroup(parts.groupBy(*by)).applyInPandas(ended, OUT)


NAMES = [c.split()[0] for c in OUT.split(", ")]


def _augmented(co: np.ndarray, pre: np.ndarray) -> np.ndarray:
    return np.concatenate((np.ones((len(co), 1)), co, pre), axis=1)


def _lists(values: np.ndarray, known: np.ndarray) -> pa.Array:
    """A list for each row, null where not known."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel()), mask=pa.array(~known))


def _rows(some: pd.DataFrame) -> list[tuple]:
    """(vec_idx, vec_num, x, observed values) of targets."""
    return [(r.vec_idx, r.vec_num, np.array(r.co, float), r.pre) for r in some.itertuples()]
