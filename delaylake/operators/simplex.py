"""Simplex projection: exponentially weighted neighbours."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from delaylake.functions.tables import cut
from delaylake.operators.neighbours import TASK, Search, neighbours, with_vectors
from delaylake.operators.split import Sets

TINY = 1e-200


class Denominator(IntEnum):
    MINIMUM = 1  # the smallest distance that is not 0 (0 if none)
    AVG_NN = 2  # the mean distance of the neighbours
    AVG_LIB = 3  # the root mean square of all distances inside the library
    MAXIMUM = 4  # compat="reference": the nearest distance; "corrected": the farthest


@dataclass(frozen=True)
class Simplex:
    """k = dimension + ``nnn_add`` neighbours with weights exp(-exp_k d / denominator).

    A denominator below 1e-200 gives equal weights; fewer than k neighbours give no prediction.
    """

    nnn_add: int = 1
    denominator: Denominator = Denominator.AVG_NN
    exp_k: float = 1.0
    search: Search = Search()
    compat: str = "reference"
    kind = "exp"

    def params(self) -> list[dict]:
        return [{"params_id": 0, "theta": None}]

    def logged(self) -> tuple[str, list[tuple]]:
        schema = "nnn_add int, excl int, var_win int, denom_type int, exp_k double, object_only_once int"
        return schema, [(0, self.nnn_add, int(self.search.exclude), self.search.window, int(self.denominator), float(self.exp_k), int(self.search.once))]

    def predict(self, sets: Sets, vectors: DataFrame, e_of: dict[int, int]) -> tuple[DataFrame, DataFrame]:
        """(task, params_id, target_idx, target_num, pre_val_num, pre_val, obs_val, status), and the neighbours."""
        k_of = {emb: e + self.nnn_add for emb, e in e_of.items()}
        found = cut(neighbours(sets, vectors, k_of, self.search), "neighbours")
        target = Window.partitionBy(*TASK, "target_idx")
        distance = F.sqrt("sqdst")
        rows = found.withColumn("_d", distance)
        if self.denominator == Denominator.AVG_NN:
            rows = rows.withColumn("_den", F.avg("_d").over(target))
        elif self.denominator == Denominator.MINIMUM:
            rows = rows.withColumn("_den", F.coalesce(F.min(F.when(F.col("_d") > 0, F.col("_d"))).over(target), F.lit(0.0)))
        elif self.denominator == Denominator.MAXIMUM:
            rows = rows.withColumn("_den", (F.min if self.compat == "reference" else F.max)("_d").over(target))
        else:
            rows = rows.join(library_rms(sets, vectors, e_of), TASK)
        k = F.create_map(*[F.lit(x) for pair in k_of.items() for x in pair])[F.col("emb_num")]
        weight = F.when(F.col("_den") < TINY, 1.0).otherwise(F.exp(-F.lit(float(self.exp_k)) * F.col("_d") / F.col("_den")))
        each = rows.filter(F.col("n_found") == k).withColumn("_w", weight).select(*TASK, "target_idx", "_w", F.posexplode("pre").alias("pre_val_num", "_p"))
        made = each.groupBy(*TASK, "target_idx", "pre_val_num").agg((F.sum(F.col("_w") * F.col("_p")) / F.nullif(F.sum("_w"), F.lit(0.0))).alias("pre_val"))
        return observed(sets, vectors).join(made, [*TASK, "target_idx", "pre_val_num"], "left").select(
            *TASK, F.lit(0).alias("params_id"), "target_idx", "target_num", "pre_val_num", "pre_val", "obs_val", F.lit(0).alias("status")
        ), found


def observed(sets: Sets, vectors: DataFrame) -> DataFrame:
    """(task, target_idx, target_num, pre_val_num, obs_val) of every target."""
    rows = with_vectors(sets.prediction, vectors)
    return rows.select(*TASK, F.col("vec_idx").alias("target_idx"), F.col("vec_num").alias("target_num"), F.posexplode("pre").alias("pre_val_num", "obs_val"))


def library_rms(sets: Sets, vectors: DataFrame, e_of: dict[int, int]) -> DataFrame:
    """(task, _den): root mean square distance of all pairs of a library, 0 below two members.

    The mean squared distance of pairs is 2 n / (n - 1) times the sum of the coordinates'
    population variances, so no pairs are formed.
    """
    rows = with_vectors(sets.library, vectors)
    most = max(e_of.values(), default=0)
    spread = sum((F.coalesce(F.var_pop(F.get("co", F.lit(i))), F.lit(0.0)) for i in range(most)), F.lit(0.0))
    n = F.count(F.lit(1))
    return rows.groupBy(*TASK).agg(F.when(n < 2, 0.0).otherwise(F.sqrt(2 * n / F.greatest(n - 1, F.lit(1)) * spread)).alias("_den"))
