"""Delay embedding: rows of lagged values.

Lags are row offsets in the order of the series. Rows are cut into blocks of consecutive rows;
each block also gets the rows that its lags reach (its halo), so a window works inside a block
and one series of any length is spread over tasks.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delaylake.functions.tables import cut
from delaylake.plans.spec import ROLES, EmbeddingDef
from delaylake.sources.series import TimeSeries

BLOCK = 1 << 16
COLUMNS = ("emb_num", "vec_num", "id", "t_co", "co", "t_pre", "pre", "t_addit", "addit", "bundle", "use_in_lib", "use_in_pre")


def _with_halo(rows: DataFrame, past: int, future: int, block: int) -> DataFrame:
    first = F.floor((F.col("row") - future) / block)
    last = F.floor((F.col("row") + past) / block)
    return rows.withColumn("_block", F.explode(F.sequence(first, last)))


def _array(columns: list[Column], kind: str) -> Column:
    return F.array(*columns).cast(f"array<{kind}>")


def embed(series: TimeSeries, definitions: list[EmbeddingDef], block: int = BLOCK, skip_unknown: bool = False) -> DataFrame:
    """The embedding vectors of all definitions (``COLUMNS``), ``emb_num`` from 0 and numbered in order inside each.

    A vector needs its whole span of rows (from the largest to the smallest lag) in one system,
    by the ids at the span's ends, and its coordinates and prediction values not missing.
    Additional and bundle values may be missing. ``skip_unknown`` leaves out definitions with
    unknown variables, with a warning.

    It is one plan: every lag that any definition names is taken once, and each row gives a vector
    for each definition.
    """
    known = []
    for i, definition in enumerate(definitions):
        unknown = sorted(set(definition.variables) - set(series.data))
        if unknown and not skip_unknown:
            raise ValueError(f"unknown variables: {unknown}")
        if unknown:
            logging.getLogger("delaylake").warning("embedding %d has unknown variables and is skipped: %s", i, unknown)
        else:
            known.append((i, definition))
    if not known:
        raise ValueError("no embedding is left")
    past, future = max(d.max_lag for _, d in known), -min(d.min_lag for _, d in known)
    block = max(block, past + future)
    window, taken = Window.partitionBy("_block").orderBy("row"), {}

    def at(name: str, lag: int) -> Column:
        """A column's value at a lag, by the name that it gets in the window's output."""
        alias = taken.setdefault((name, lag), f"_lag{len(taken)}")
        return F.col(alias)

    made = [
        F.struct(
            F.lit(i).alias("emb_num"),
            (at("row", d.max_lag).isNotNull() & at("row", d.min_lag).isNotNull() & at("id", d.max_lag).eqNullSafe(at("id", d.min_lag))).alias("_whole"),
            *[_array([at(v.name, v.lag) for v in getattr(d, role)], "double").alias(role) for role in ROLES],
            *[_array([at("t", v.lag) for v in getattr(d, role)], "long").alias(f"t_{role}") for role in ROLES],
        )
        for i, d in known
    ]
    rows = _with_halo(series.rows, past, future, block)
    rows = rows.select(
        "_block", "row", "id", F.col("in_lib").alias("use_in_lib"), F.col("in_pre").alias("use_in_pre"), _array([F.col(b) for b in series.bundle], "double").alias("bundle"),
        *[(F.lag(name, lag).over(window) if lag else F.col(name)).alias(alias) for (name, lag), alias in taken.items()],
    )
    own = rows.filter(F.floor(F.col("row") / block) == F.col("_block"))
    each = own.select("_block", "row", "id", "use_in_lib", "use_in_pre", "bundle", F.inline(F.array(*made)))
    kept = each.filter(F.col("_whole") & F.forall("co", lambda x: x.isNotNull()) & F.forall("pre", lambda x: x.isNotNull()))
    place = F.row_number().over(Window.partitionBy("emb_num", "_block").orderBy("row")) - 1
    kept = cut(kept.withColumn("_place", place), "embedding")
    counts = kept.groupBy("emb_num", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("emb_num").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("emb_num", "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    return kept.join(offsets, ["emb_num", "_block"]).withColumn("vec_num", F.col("_before") + F.col("_place")).select(*COLUMNS)


def co_variables(definition: EmbeddingDef) -> tuple[int, ...]:
    """A number for each coordinate's variable, for exclusion by shared times of one variable."""
    names = list(dict.fromkeys(v.name for v in definition.co))
    return tuple(names.index(v.name) for v in definition.co)


def embedding_meta(series: TimeSeries, definitions: list[EmbeddingDef]) -> DataFrame:
    """(emb_num, emb_label, e, n_pre_val, n_addit_val, n_bundle_val, copr, coord, var_name, lag)."""
    rows = []
    for i, d in enumerate(definitions):
        head = (i, d.label(series.bundle), len(d.co), len(d.pre), len(d.addit), len(series.bundle))
        rows += [(*head, copr, k, v.name, v.lag) for copr, role in zip("CPA", ROLES, strict=True) for k, v in enumerate(getattr(d, role))]
        rows += [(*head, "B", k, b, None) for k, b in enumerate(series.bundle)]
    return series.rows.sparkSession.createDataFrame(rows, "emb_num int, emb_label string, e int, n_pre_val int, n_addit_val int, n_bundle_val int, copr string, coord int, var_name string, lag int")


def bundles(vectors: DataFrame, keep: list[float] | None = None, some: bool = True) -> DataFrame:
    """``vectors`` with bundle_num: 0 without bundle values (``some`` false: there are none), else 1, 2, ... by ascending bundle vector.

    ``keep`` selects vectors whose first bundle value is one of the list. A missing bundle value
    is an error, as groups could not be told apart.
    """
    if not some and keep is None:
        return vectors.withColumn("bundle_num", F.lit(0))
    if keep is not None:
        vectors = vectors.filter(F.col("bundle")[0].isin([float(x) for x in keep]))
    bad = F.exists("bundle", lambda x: x.isNull() | F.isnan(x))
    checked = vectors.withColumn("bundle", F.when(bad, F.raise_error(F.lit("a bundle value is missing")).cast("array<double>")).otherwise(F.col("bundle")))
    groups = checked.select("emb_num", "bundle").distinct()
    order = Window.partitionBy("emb_num").orderBy("bundle")
    numbers = groups.select("emb_num", "bundle", F.when(F.size("bundle") > 0, F.row_number().over(order)).otherwise(0).alias("bundle_num"))
    return checked.join(cut(numbers, "bundles"), ["emb_num", "bundle"])
