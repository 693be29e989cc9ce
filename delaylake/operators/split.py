"""Library and prediction sets.

A split turns bundled vectors into two membership tables (emb_num, bundle_num, set_num, vec_idx,
vec_num): ``library`` and ``prediction``. vec_idx numbers the members of a set, so a set can hold
a vector more than once. Set numbers run from 0 and are the same for every predictor parameter.
``rng="arith"`` uses integer arithmetic that any engine repeats; ``rng="libc"`` the C library's
generator, on the driver, for groups of up to ``DRIVER_ROWS`` vectors.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delaylake.functions.rng import LibcRandom, mixed
from delaylake.functions.tables import cut, positions

GROUP = ["emb_num", "bundle_num"]
MEMBER = [*GROUP, "set_num", "vec_idx", "vec_num"]
DRIVER_ROWS, BLOCK = 1_000_000, 1 << 16


class Sets(NamedTuple):
    library: DataFrame
    prediction: DataFrame
    params: DataFrame  # emb_num, bundle_num, set_num and the split's own fields


def placed(vectors: DataFrame) -> DataFrame:
    """(emb_num, bundle_num, vec_num, pos, n, flags, addit) with pos from 0 inside each group.

    vec_num is dense inside an embedding, so places come from counts of its blocks; no group is one task's.
    """
    rows = vectors.select(*GROUP, "vec_num", "use_in_lib", "use_in_pre", "addit", F.floor(F.col("vec_num") / BLOCK).alias("_block"))
    counts = rows.groupBy(*GROUP, "_block").agg(F.count(F.lit(1)).alias("_n"))
    whole, before = Window.partitionBy(*GROUP), Window.partitionBy(*GROUP).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*GROUP, "_block", F.sum("_n").over(whole).alias("n"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*GROUP, "_block").orderBy("vec_num")) - 1
    out = rows.withColumn("_place", place).join(counts, [*GROUP, "_block"])
    return cut(out.withColumn("pos", F.col("_before") + F.col("_place")).drop("_block", "_place", "_before"), "placed")


def _members(rows: DataFrame, idx: Column) -> DataFrame:
    return rows.withColumn("vec_idx", idx.cast("long")).select(*MEMBER)


def _all(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Every vector of a group in each of its sets."""
    return _members(rows.join(sets.select(*GROUP, "set_num"), GROUP), F.col("pos"))


def _groups(rows: DataFrame) -> DataFrame:
    return cut(rows.select(*GROUP, "n").distinct(), "groups")


def _permuted(rows: DataFrame, sets: DataFrame, rng: str, key: str) -> DataFrame:
    """rows with ``pos`` replaced by a random place, one permutation for each value of ``key`` in ``sets``."""
    if rng == "arith":
        each = rows.join(sets.select(*GROUP, key).distinct(), GROUP).withColumnRenamed("pos", "_old")
        each = each.withColumn("_mixed", mixed(F.col("_old"), F.col(key)))
        return positions(each, [*GROUP, key], ["_mixed", "_old"], "pos").drop("_mixed", "_old")
    wanted: dict[tuple, set] = {}
    for r in sets.select(*GROUP, "n", key).distinct().collect():
        if r["n"] > DRIVER_ROWS:
            raise ValueError(f"rng='libc' shuffles on the driver; a group has {r['n']} vectors")
        wanted.setdefault((r["emb_num"], r["bundle_num"], r["n"]), set()).add(r[key])
    made = []
    for (emb, bundle, n), keys in wanted.items():
        random = LibcRandom(1)
        for k in sorted(keys):
            made += [(emb, bundle, k, old, new) for new, old in enumerate(random.permutation(n))]
    places = rows.sparkSession.createDataFrame(made, f"emb_num int, bundle_num int, {key} long, pos long, _new long")
    return rows.join(places, [*GROUP, "pos"]).drop("pos").withColumnRenamed("_new", "pos")


@dataclass(frozen=True)
class UserSplit:
    """Library and prediction by the flags of the rows; an empty side of any group is an error."""

    def split(self, vectors: DataFrame) -> Sets:
        rows = placed(vectors)
        sets = _groups(rows).withColumn("set_num", F.lit(0).cast("long"))
        rows = rows.withColumn("set_num", F.lit(0).cast("long")).drop("pos", "n")
        used = rows.groupBy(*GROUP).agg(F.coalesce(F.bool_or("use_in_lib"), F.lit(False)).alias("lib"), F.coalesce(F.bool_or("use_in_pre"), F.lit(False)).alias("pre"))
        bad = used.filter(~(F.col("lib") & F.col("pre"))).first()
        if bad is not None or rows.isEmpty():
            raise ValueError(f"the library or the prediction set is empty: {bad}")
        sides = [_members(positions(rows.filter(flag), GROUP, ["vec_num"], "pos"), F.col("pos")) for flag in ("use_in_lib", "use_in_pre")]
        return Sets(*sides, sets)


@dataclass(frozen=True)
class LeaveOneOut:
    """Library and prediction are all vectors; a neighbour search excludes the target itself."""

    def split(self, vectors: DataFrame) -> Sets:
        rows = placed(vectors).withColumn("set_num", F.lit(0).cast("long"))
        both = _members(rows, F.col("pos"))
        return Sets(both, both, rows.select(*GROUP, "set_num").distinct())


@dataclass(frozen=True)
class KFold:
    """Repeated k-fold over a fresh shuffle for each repetition.

    ``compat="reference"``: the library begins one place behind the fold's end and wraps around,
    so it lacks the point after the fold and holds the fold's first point; ``"corrected"``: it is
    all that is not in the fold.
    """

    k: int
    repetitions: int = 1
    compat: str = "reference"
    rng: str = "arith"

    def split(self, vectors: DataFrame) -> Sets:
        rows = placed(vectors)
        groups = _groups(rows)
        if not groups.filter(F.col("n") < self.k).isEmpty():
            raise ValueError("more folds than vectors")
        each = groups.withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(self.repetitions - 1)).cast("array<long>")))
        each = each.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(self.k - 1)).cast("array<long>")))
        bound = lambda f: F.floor(f / F.lit(float(self.k)) * F.col("n")).cast("long")
        sets = each.select(*GROUP, "n", "repetition", (F.col("repetition") * self.k + F.col("fold")).alias("set_num"), F.col("fold").alias("k"), bound(F.col("fold")).alias("lo"), bound(F.col("fold") + 1).alias("hi"))
        shuffled = cut(_permuted(rows, sets, self.rng, "repetition"), "shuffled").drop("n")
        joined = shuffled.join(sets, [*GROUP, "repetition"])
        inside = (F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi"))
        prediction = _members(joined.filter(inside), F.col("pos") - F.col("lo"))
        if self.compat == "reference":
            place = F.pmod(F.col("pos") - F.col("hi") - 1, F.col("n"))
            library = _members(joined.filter(place < F.col("n") - (F.col("hi") - F.col("lo"))), place)
        else:
            library = _members(joined.filter(~inside), F.pmod(F.col("pos") - F.col("hi"), F.col("n")))
        return Sets(library, prediction, sets.select(*GROUP, "set_num", "k", "repetition"))


def library_sizes(smallest: int, largest: int, step: int, factor: float, n: int, replacing: bool = False) -> list[int]:
    """Growing library sizes: the step itself grows by ``factor`` in single precision; the first size beyond ``largest`` is cut to it."""
    out, size, stride = [], smallest, max(step, 1)
    exact = np.float32(stride)
    while size <= largest and (replacing or size < n):
        out.append(size)
        following = size + stride
        size = largest if size < largest < following else following
        exact = np.float32(exact + np.float32(factor) * exact)
        stride = int(exact)
    return out


@dataclass(frozen=True)
class Convergent:
    """Libraries of growing size (for convergence curves); the prediction set is all vectors.

    ``shift``: windows of consecutive vectors, wrapping around, from offsets 0, shift, 2 shift, ...;
    ``random``: the same over one random order; ``bootstrap``: draws with replacement;
    ``boot_permut``: draws without replacement, the first of a fresh random order for each set.
    """

    smallest: int
    largest: int
    step: int = 1
    factor: float = 0.0
    method: str = "shift"
    shift: int = 1
    n_bootstrap: int = 1
    rng: str = "arith"

    def split(self, vectors: DataFrame) -> Sets:
        if self.smallest > self.largest:
            raise ValueError("the smallest library is larger than the largest")
        rows = placed(vectors)
        groups = _groups(rows)
        steps = []  # a size schedule for each different number of vectors; sizes grow to the largest only
        for n in sorted(r["n"] for r in groups.select("n").distinct().collect()):
            largest = min(self.largest, n) if self.method == "boot_permut" else self.largest
            if self.smallest > n and self.n_bootstrap != 1 and self.method != "bootstrap":
                raise ValueError("the smallest library is larger than the group")
            steps.append((n, library_sizes(self.smallest, largest, self.step, self.factor, n, self.method == "bootstrap")))
        sized = groups.join(F.broadcast(vectors.sparkSession.createDataFrame(steps, "n long, sizes array<long>")), "n")
        # every size with each of its shifts or draws, numbered in that order
        if self.method in ("shift", "random"):
            stride = max(self.shift, 1)
            each, last = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(stride).cast("long")), F.floor((F.col("n") - 1) / stride) + 1
        else:
            each, last = F.sequence(F.lit(0).cast("long"), F.lit(max(self.n_bootstrap, 1) - 1).cast("long")), F.lit(max(self.n_bootstrap, 1))
        sets = sized.select(*GROUP, "n", F.posexplode("sizes").alias("_size", "lib_size")).select(*GROUP, "n", "_size", "lib_size", F.posexplode(each).alias("_each", "_value"))
        shifting = self.method in ("shift", "random")
        sets = sets.select(
            *GROUP, "n", (F.col("_size") * last + F.col("_each")).cast("long").alias("set_num"), "lib_size",
            (F.col("_value") if shifting else F.lit(0).cast("long")).alias("shift"), (F.lit(0).cast("long") if shifting else F.col("_value")).alias("boot_i"),
        )
        if self.method == "bootstrap" and self.rng == "libc":
            order = [(r["emb_num"], r["bundle_num"], r["n"], r["set_num"], r["lib_size"]) for r in sets.orderBy(*GROUP, "set_num").collect()]
            library = _drawn(rows, order)
        elif self.method == "bootstrap":
            draws = sets.withColumn("vec_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lib_size") - 1)))
            draws = draws.withColumn("pos", F.pmod(mixed(F.col("vec_idx"), F.col("set_num")), F.col("n")))
            library = draws.join(rows.drop("n"), [*GROUP, "pos"]).select(*MEMBER)
        else:
            if self.method == "random":
                order = _permuted(rows, sets.withColumn("_one", F.lit(1).cast("long")), self.rng, "_one").drop("_one", "n")
                joined = order.join(sets, GROUP)
            elif self.method == "boot_permut":
                joined = _permuted(rows, sets, self.rng, "set_num").drop("n").join(sets, [*GROUP, "set_num"])
            else:
                joined = rows.drop("n").join(sets, GROUP)
            place = F.pmod(F.col("pos") - F.col("shift"), F.col("n"))
            library = _members(joined.filter(place < F.col("lib_size")), place)
        return Sets(library, _all(rows, sets), sets.drop("n"))


def _drawn(rows: DataFrame, order: list[tuple]) -> DataFrame:
    """Draws of the C library's generator for sets (emb_num, bundle_num, n, set_num, size) in order, seeded anew for each group."""
    made, random, group = [], LibcRandom(1), None
    for emb, bundle, n, number, size in order:
        if n > DRIVER_ROWS or len(made) > DRIVER_ROWS:
            raise ValueError(f"rng='libc' draws on the driver; a group has {n} vectors, {len(made)} are drawn")
        if (emb, bundle) != group:
            random, group = LibcRandom(1), (emb, bundle)
        made += [(emb, bundle, number, i, p) for i, p in enumerate(random.draws(n, size))]
    drawn = rows.sparkSession.createDataFrame(made, "emb_num int, bundle_num int, set_num long, vec_idx long, pos long")
    return drawn.join(rows, [*GROUP, "pos"]).select(*MEMBER)


@dataclass(frozen=True)
class Bootstrap:
    """Draws with replacement, ``n_bootstrap`` times; ``per_addit_group`` draws inside each tuple of additional values."""

    n_bootstrap: int
    lib_size: int | None = None  # None: as many as vectors
    pre_is_lib: bool = False
    per_addit_group: bool = False
    rng: str = "arith"

    def split(self, vectors: DataFrame) -> Sets:
        if self.n_bootstrap < 1 or self.per_addit_group and self.lib_size is not None:
            raise ValueError("n_bootstrap is below 1, or a library size is given for stratified draws")
        if self.per_addit_group and self.rng == "libc":
            raise ValueError("stratified draws have no rng='libc'")
        rows = placed(vectors)
        sets = _groups(rows).withColumn("set_num", F.explode(F.sequence(F.lit(0), F.lit(self.n_bootstrap - 1)).cast("array<long>")))
        if self.per_addit_group:
            rows = cut(positions(rows, [*GROUP, "addit"], ["pos"], "_in", "_m"), "strata")
            each = rows.join(sets.select(*GROUP, "set_num"), GROUP)
            each = each.select(*GROUP, "set_num", "addit", F.col("pos").alias("vec_idx"), F.pmod(mixed(F.col("pos"), F.col("set_num")), F.col("_m")).alias("_in"))
            source = rows.select(*GROUP, F.col("addit").alias("_addit"), "_in", "vec_num")
            same = (F.col("a.addit").eqNullSafe(F.col("b._addit"))) & (F.col("a._in") == F.col("b._in"))
            for g in GROUP:
                same = same & (F.col(f"a.{g}") == F.col(f"b.{g}"))
            library = each.alias("a").join(source.alias("b"), same).select(*[F.col(f"a.{g}").alias(g) for g in GROUP], "set_num", "vec_idx", "vec_num")
        elif self.rng == "libc":
            groups = sorted((r["emb_num"], r["bundle_num"], r["n"]) for r in _groups(rows).collect())
            library = _drawn(rows, [(e, b, n, i, self.lib_size or n) for e, b, n in groups for i in range(self.n_bootstrap)])
        else:
            size = F.lit(self.lib_size).cast("long") if self.lib_size else F.col("n")
            drawn = sets.withColumn("vec_idx", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)))
            drawn = drawn.withColumn("pos", F.pmod(mixed(F.col("vec_idx"), F.col("set_num")), F.col("n"))).drop("n")
            library = drawn.join(rows, [*GROUP, "pos"]).select(*MEMBER)
        library = cut(library, "library")
        prediction = library if self.pre_is_lib else _all(rows, sets)
        return Sets(library, prediction, sets.select(*GROUP, "set_num", F.col("set_num").alias("boot_i")))
