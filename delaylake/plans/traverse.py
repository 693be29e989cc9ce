"""A run: all embeddings, bundles, parameters and sets of a series in one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaylake.functions.tables import cut, numbered
from delaylake.operators.embed import bundles, embed, embedding_meta
from delaylake.operators.log import LogLevel, log_table, records
from delaylake.operators.neighbours import TASK
from delaylake.operators.smap import TOL_RANK, TOL_SINGULAR
from delaylake.operators.split import GROUP, LeaveOneOut, Sets
from delaylake.operators.stats import skill
from delaylake.plans.spec import EmbeddingDef
from delaylake.sources.series import TimeSeries


EVERYTHING = LogLevel(0x3FFF)
_SET_KINDS = {"Convergent": "SPCL", "KFold": "SPKF", "LeaveOneOut": "SPLO", "Bootstrap": "SPBT", "UserSplit": "SPUV"}
#: Record kinds in the order in which a serial run writes them, and the stage of a task that each belongs to.
_RANK = (
    "EMBPAR1", "EMBPAR2", "EMBPAR3", "VID", "VAL", "BP", "BV", "KP", "KPEXP", "KPTLS", "SPCL", "SPKF", "SPLO", "SPBT", "SPUV", "SH", "SD",
    "TG1", "NN", "VPM", "VPT", "DTLSO", "DTLSAN", "DTLSAV", "TG2", "PD", "ADHD", "ADDT", "STNP", "STAT",
)
_STAGE = {k: 0 if k in _RANK[:17] else 3 if k in _RANK[26:] else 2 if k in ("TG2", "PD") else 1 for k in _RANK}


def _numbered(code: str):
    return lambda v, i: F.struct(F.lit(code).alias("copr"), i.alias("idx"), v["t"].alias("t"), v["val"].alias("val"))


@dataclass(frozen=True)
class Run:
    series: TimeSeries
    definitions: list[EmbeddingDef]
    vectors: DataFrame  # embedding vectors with bundle_num
    sets: Sets
    predictions: DataFrame
    near: DataFrame | Callable[[], DataFrame] | None
    meta: DataFrame
    params: list[dict]
    predictor: object
    split: object

    @cached_property
    def neighbours(self) -> DataFrame | None:
        """The neighbours of all targets, found now if the predictor kept none."""
        return self.near() if callable(self.near) else self.near

    def stats(self, per_additional: bool = False) -> DataFrame:
        """Skill by task, parameter and prediction value; with ``per_additional`` also by tuple of additional values.

        ``set_num`` counts from 1 here. Rows over all of a set have grouped = false and no addit.
        """
        keys = [*TASK, "params_id", "pre_val_num"]
        pairs = self.predictions
        overall = skill(pairs, keys).withColumns({"grouped": F.lit(False), "addit": F.lit(None).cast("array<double>")})
        if per_additional:
            addit = self.vectors.select("emb_num", F.col("vec_num").alias("target_num"), "addit")
            grouped = skill(cut(pairs.join(addit, ["emb_num", "target_num"]), "pairs"), [*keys, "addit"]).withColumn("grouped", F.lit(True))
            overall = overall.unionByName(grouped.select(*overall.columns))
        sizes = [self._size(self.sets.library, "lib_set_n_point"), self._size(self.sets.prediction, "pre_set_n_point")]
        out = overall
        for s in sizes:
            out = out.join(s, TASK, "left")
        thetas = F.create_map(*[x for p in self.params for x in (F.lit(p["params_id"]), F.lit(p["theta"]).cast("double"))])
        return out.withColumns({"set_num": F.col("set_num") + 1, "theta": thetas[F.col("params_id")]})

    @staticmethod
    def _size(members: DataFrame, name: str) -> DataFrame:
        return members.groupBy(*TASK).agg(F.count(F.lit(1)).alias(name))

    def tables(self, level: LogLevel = EVERYTHING) -> dict[str, DataFrame]:
        """Typed tables of the record kinds at ``level``: the task keys that apply and the kind's fields.

        Numbers are the log's: sets from 0, neighbours from the farthest. Lazy; nothing is truncated.
        """
        spark, out = self.series.rows.sparkSession, {}
        task, target = [*TASK, "params_id"], [*TASK, "params_id", "target_idx", "target_num"]
        vectors = self.vectors
        if level & LogLevel.EMB_PAR:
            rows = vectors.groupBy("emb_num").agg(F.count(F.lit(1)).alias("n_row"))
            ranges = F.create_map(*[F.lit(x) for i, d in enumerate(self.definitions) for x in (i, len(d.ranges))])
            names = self.meta.select("emb_num", "emb_label", "e", "n_pre_val", "n_bundle_val").distinct()
            out["EMBPAR1"] = names.join(rows, "emb_num", "left").withColumns({"n_row": F.coalesce("n_row", F.lit(0)), "n_ranges": ranges[F.col("emb_num")]})
            numbers = F.create_map(*[F.lit(x) for i, name in enumerate((*self.series.data, *self.series.bundle)) for x in (name, i)])
            out["EMBPAR2"] = self.meta.select("emb_num", "copr", "coord", "var_name", "lag", numbers[F.col("var_name")].alias("var_no"))
            made = [(i, k, dim, tau) for i, d in enumerate(self.definitions) for k, (dim, tau) in enumerate(d.ranges)]
            out["EMBPAR3"] = spark.createDataFrame(made, "emb_num int, seq int, dim int, tau int")
        if level & LogLevel.EMB_VEC:
            flag = lambda c, given: F.col(c).cast("int") if given else F.lit(-1)
            out["VID"] = vectors.select("emb_num", "vec_num", "id", flag("use_in_lib", self.series.has_lib).alias("use_in_lib"), flag("use_in_pre", self.series.has_pre).alias("use_in_pre"))
            parts = [F.transform(F.arrays_zip(F.col(f"t_{c}").alias("t"), F.col(c).alias("val")), _numbered(code)) for code, c in (("C", "co"), ("P", "pre"), ("A", "addit"))]
            parts.append(F.transform(F.transform("bundle", lambda v: F.struct(F.lit(0).cast("long").alias("t"), v.alias("val"))), _numbered("B")))
            out["VAL"] = vectors.select("emb_num", "vec_num", F.explode(F.concat(*parts)).alias("v")).select("emb_num", "vec_num", "v.*")
        if level & LogLevel.BUNDLE_PAR:
            groups = vectors.filter("bundle_num > 0").select(*GROUP, "bundle").distinct()
            out["BP"] = groups.select(*GROUP)
            out["BV"] = groups.select(*GROUP, F.posexplode("bundle").alias("vec_idx", "vec_val"))
        if level & LogLevel.FN_PAR:
            out["KP"] = spark.createDataFrame([(p["params_id"], self.predictor.kind) for p in self.params], "params_id int, fn_type string")
            schema, rows = self.predictor.logged()
            out["KPEXP" if self.predictor.kind == "exp" else "KPTLS"] = spark.createDataFrame(rows, f"params_id int, {schema}")
        if level & LogLevel.SET_PAR:
            fields = [c for c in self.sets.params.columns if c not in (*TASK, "n")]
            out[_SET_KINDS[type(self.split).__name__]] = self.sets.params.select(*TASK, *(fields or [F.lit(0).alias("dummy")]))
        sides = [(code, m) for code, bit, m in (("L", LogLevel.LIB_SET, self.sets.library), ("P", LogLevel.PRE_SET, self.sets.prediction)) if level & bit]
        for code, members in sides:
            head = members.groupBy(*TASK).agg(F.count(F.lit(1)).alias("n_point")).withColumn("set_code", F.lit(code)).select(*TASK, "set_code", "n_point")
            rows = members.select(*TASK, F.lit(code).alias("set_code"), "vec_idx", "vec_num")
            out["SH"] = out["SH"].unionByName(head) if "SH" in out else head
            out["SD"] = out["SD"].unionByName(rows) if "SD" in out else rows
        if level & LogLevel.NEAR_NEIGH and self.neighbours is not None:
            out["TG1"] = self.neighbours.select(*TASK, "target_idx", "target_num").distinct()
            out["NN"] = self.neighbours.select(*TASK, "target_idx", "target_num", "seq", "num", "sqdst")
        if level & LogLevel.PREDICTED:
            out["TG2"] = self.predictions.select(*target).distinct()
            out["PD"] = self.predictions.select(*target, "pre_val_num", "pre_val", "obs_val", "status")
        if self.predictor.kind == "tls":
            once = self.predictions.filter("pre_val_num = 0")
            if level & LogLevel.VAR_PAR:
                means = once.select(*target, F.posexplode(F.coalesce("means", F.transform(F.concat(F.array(F.lit(0.0)), F.col("coef")), lambda _: F.lit(None).cast("double")))).alias("var_num", "var_mean"))
                out["VPM"] = means.withColumn("copr", F.when(F.col("var_num") <= F.create_map(*[F.lit(x) for i, d in enumerate(self.definitions) for x in (i, len(d.co))])[F.col("emb_num")], "C").otherwise("P"))
                out["VPT"] = self.predictions.select(*target, "pre_val_num", F.posexplode("coef").alias("var_coord", "var_val"))
            if level & (LogLevel.DTLS_STATUS | LogLevel.DTLS_ARRAYS):
                warning = F.shiftright(F.col("status"), 8).bitwiseAND(0x1F)
                dims = lambda f: F.create_map(*[F.lit(x) for i, d in enumerate(self.definitions) for x in (i, f(d))])[F.col("emb_num")]
                a, b = dims(lambda d: len(d.co) + 1), dims(lambda d: len(d.pre))
                out["DTLSO"] = once.select(
                    *target, F.lit(TOL_RANK).alias("tol1"), F.lit(TOL_SINGULAR).alias("tol2"), a.alias("ldx"), "rank", F.shiftright("status", 13).alias("ierr"), warning.alias("iwarn"),
                    F.greatest(F.col("n_lib"), a + b).alias("ldc"), F.col("n_used").alias("m"), a.alias("n"), b.alias("l"),
                )
            if level & LogLevel.DTLS_ARRAYS:
                # the solution; with SMap(arrays=True) also the singular values and, for C, the right vectors that the solver leaves there
                width = F.size("singular")
                cells = [
                    once.select(*target, F.lit("C").alias("name"), width.alias("ncol"), F.posexplode("vectors").alias("at", "val")),
                    once.select(*target, F.lit("S").alias("name"), F.lit(1).alias("ncol"), F.posexplode("singular").alias("at", "val")),
                ]
                cells = [c.select(*target, "name", F.floor(F.col("at") / F.col("ncol")).cast("int").alias("row"), F.pmod("at", "ncol").alias("col"), "val") for c in cells]
                solution = self.predictions.select(*target, F.lit("X").alias("name"), F.posexplode("coef").alias("row", "val"), F.col("pre_val_num").alias("col"))
                out["DTLSAV"] = cells[0].unionByName(cells[1]).unionByName(solution)
                out["DTLSAN"] = out["DTLSAV"].groupBy(*target, "name").agg((F.max("row") + 1).alias("nrow"), (F.max("col") + 1).alias("ncol"))
        if level & LogLevel.STATISTICS:
            stats = self.stats(per_additional=any(d.addit for d in self.definitions)).withColumn("set_num", F.col("set_num") - 1)
            out["STNP"] = stats.groupBy(*task, "grouped", "addit").agg(F.count(F.lit(1)).alias("n_pre_val"))
            out["STAT"] = stats
            out["ADHD"] = stats.filter("grouped").select(*task, "addit", F.size("addit").alias("n_addit_val")).distinct()
            out["ADDT"] = out["ADHD"].select(*task, "addit", F.posexplode("addit").alias("idx", "addit_val"))
        return out

    def log(self, level: LogLevel = EVERYTHING) -> DataFrame:
        """(seq, kind, fields): the records of ``tables`` in the order of a serial run, densely numbered."""
        out = None
        for kind, rows in self.tables(level).items():
            if kind in ("KP", "KPEXP", "KPTLS"):
                rows = self.vectors.select(*GROUP).distinct().withColumn("params_id", F.explode(F.array(*[F.lit(p["params_id"]) for p in self.params]))).join(F.broadcast(rows), "params_id")
            elif kind in ("SH", "SD", "SPCL", "SPKF", "SPLO", "SPBT", "SPUV", "TG1", "NN") and "params_id" not in rows.columns:
                rows = rows.withColumn("params_id", F.explode(F.array(*[F.lit(p["params_id"]) for p in self.params])))
            has = lambda c, rows=rows: F.col(c) if c in rows.columns else F.lit(-1)
            inner = next((c for c in ("pre_val_num", "seq", "var_coord", "idx") if c in rows.columns), None)
            group = has("grouped").cast("int") if "grouped" in rows.columns else F.lit(0)
            order = [has("emb_num"), has("vec_num") if kind in ("VID", "VAL") else F.lit(-1), has("bundle_num"), has("params_id"), has("set_num"), F.lit(_STAGE[kind]), group]
            order += [has("target_idx"), has("vec_idx") if kind == "SD" else F.lit(-1), F.lit(_RANK.index(kind)), has(inner) if inner else F.lit(-1)]
            one = records(rows, kind, order)
            out = one if out is None else out.unionByName(one)
        return numbered(out, ["order", "kind"], "seq", "log").drop("order")

    def log_table(self, fields: list[str], trigger: str, level: LogLevel = EVERYTHING) -> DataFrame:
        """One row for each ``trigger`` record at ``level``, with the last values of ``fields``."""
        return log_table(self.log(level), fields, trigger)


def traverse(series: TimeSeries, definitions: list[EmbeddingDef], predictor, split=LeaveOneOut(), bundle_filter: list[float] | None = None, skip_unknown: bool = False) -> Run:
    """Embed, group, split and predict; ``skip_unknown`` goes on without the embeddings that name unknown variables."""
    vectors = cut(bundles(embed(series, definitions, skip_unknown=skip_unknown), bundle_filter, bool(series.bundle)), "vectors")
    sets = split.split(vectors)
    library = cut(sets.library, "library")
    sets = Sets(library, library if sets.prediction is sets.library else cut(sets.prediction, "prediction"), sets.params)
    predictions, near = predictor.predict(sets, vectors, {i: len(d.co) for i, d in enumerate(definitions)})
    return Run(series, definitions, vectors, sets, cut(predictions, "predictions"), near, embedding_meta(series, definitions), predictor.params(), predictor, split)
