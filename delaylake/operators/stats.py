"""Prediction-skill statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylake.functions.tables import cut, medians, null_safe

FIELDS = (
    "n_pre_obs", "avg_pre", "avg_obs", "var_pre", "var_obs", "cov_pre_obs", "mae_pre_obs", "rmse_pre_obs",
    "md_pre", "md_obs", "mdad_pre", "mdad_obs", "mdae_pre_obs",
)


def skill(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of pre_val and obs_val for each group of ``keys`` (nulls equal).

    A pair with a missing value is left out. A group without pairs has n_pre_obs 0, means and
    moments 0 and missing medians. Variances and the covariance are the population's; medians
    are exact; ``rho`` is the correlation, missing where a variance is 0. ``pairs`` is read several
    times, so it should be a table.
    """
    pairs = pairs.select(*keys, "pre_val", "obs_val")
    both = F.col("pre_val").isNotNull() & F.col("obs_val").isNotNull() & ~F.isnan("pre_val") & ~F.isnan("obs_val")
    groups = pairs.select(*keys).distinct()
    full = pairs.filter(both).withColumn("_e", F.abs(F.col("pre_val") - F.col("obs_val")))
    moments = full.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pre_obs"), F.avg("pre_val").alias("avg_pre"), F.avg("obs_val").alias("avg_obs"), F.var_pop("pre_val").alias("var_pre"),
        F.var_pop("obs_val").alias("var_obs"), F.covar_pop("pre_val", "obs_val").alias("cov_pre_obs"), F.avg("_e").alias("mae_pre_obs"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse_pre_obs"),
    )
    first = cut(medians(full.select(*keys, F.col("pre_val").alias("md_pre"), F.col("obs_val").alias("md_obs"), F.col("_e").alias("mdae_pre_obs")), keys, ["md_pre", "md_obs", "mdae_pre_obs"]), "medians")
    around = null_safe(full, first.drop("mdae_pre_obs"), keys)
    spread = around.select(*keys, F.abs(F.col("pre_val") - F.col("md_pre")).alias("mdad_pre"), F.abs(F.col("obs_val") - F.col("md_obs")).alias("mdad_obs"))
    second = medians(spread, keys, ["mdad_pre", "mdad_obs"])
    out = null_safe(null_safe(null_safe(groups, moments, keys), first, keys), second, keys)
    zero = [F.coalesce(F.col(f), F.lit(0 if f == "n_pre_obs" else 0.0)).alias(f) for f in FIELDS[:8]]
    rho = F.when((F.col("var_pre") > 0) & (F.col("var_obs") > 0), F.col("cov_pre_obs") / F.sqrt(F.col("var_pre") * F.col("var_obs"))).alias("rho")
    return out.select(*keys, *zero, *FIELDS[8:], rho)
