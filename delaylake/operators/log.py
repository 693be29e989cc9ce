"""The run log: typed records, sinks and the log-to-table query."""

from __future__ import annotations

import struct
from enum import IntFlag

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from delaylake.functions.tables import cut
from delaylake.sources.series import frame

BLOCK = 1 << 16


class LogLevel(IntFlag):
    STATISTICS = 0x1
    EMB_PAR = 0x2
    EMB_VEC = 0x4
    FN_PAR = 0x8
    NEAR_NEIGH = 0x10
    SET_PAR = 0x20
    LIB_SET = 0x40
    PRE_SET = 0x80
    PREDICTED = 0x100
    MSGS = 0x200
    VAR_PAR = 0x400
    BUNDLE_PAR = 0x800
    DTLS_STATUS = 0x1000
    DTLS_ARRAYS = 0x2000


#: Record kinds with their fields; a field is named kind_field in queries.
KINDS = {
    "STNP": ("n_pre_val",),
    "STAT": ("pre_val_num", "n_pre_obs", "avg_pre", "avg_obs", "var_pre", "var_obs", "cov_pre_obs", "mae_pre_obs", "rmse_pre_obs", "md_pre", "md_obs", "mdad_pre", "mdad_obs", "mdae_pre_obs"),
    "ADHD": ("n_addit_val",),
    "ADDT": ("idx", "addit_val"),
    "EMBPAR1": ("emb_num", "emb_label", "n_row", "e", "n_pre_val", "n_bundle_val", "n_ranges"),
    "EMBPAR2": ("copr", "coord", "var_name", "lag", "var_no"),
    "EMBPAR3": ("seq", "dim", "tau"),
    "VID": ("vec_num", "id", "use_in_lib", "use_in_pre"),
    "VAL": ("copr", "idx", "t", "val"),
    "KP": ("fn_type",),
    "KPEXP": ("nnn_add", "excl", "var_win", "denom_type", "exp_k", "object_only_once"),
    "KPTLS": ("nnn", "excl", "var_win", "theta", "center"),
    "TG1": ("target_num",),
    "NN": ("seq", "num", "sqdst"),
    "SPCL": ("lib_size", "shift", "boot_i"),
    "SPKF": ("k", "repetition"),
    "SPLO": ("dummy",),
    "SPBT": ("boot_i",),
    "SPUV": ("dummy",),
    "SH": ("set_code", "set_num", "n_point"),
    "SD": ("set_code", "vec_idx", "vec_num"),
    "TG2": ("target_num",),
    "PD": ("pre_val_num", "pre_val", "obs_val", "status"),
    "MSG": ("text",),
    "VPM": ("copr", "var_num", "var_mean"),
    "VPT": ("target_num", "pre_val_num", "var_coord", "var_val"),
    "BP": ("bundle_num",),
    "BV": ("vec_idx", "vec_val"),
    "DTLSO": ("tol1", "tol2", "ldx", "rank", "ierr", "iwarn", "ldc", "m", "n", "l"),
    "DTLSAN": ("name", "nrow", "ncol"),
    "DTLSAV": ("row", "col", "val"),
}


def records(rows: DataFrame, kind: str, order: list) -> DataFrame:
    """(kind, order, fields) of one kind: the rows' columns that the kind has, as text, and an ordering key."""
    names = [f for f in KINDS[kind] if f in rows.columns]
    fields = F.map_from_arrays(F.array(*[F.lit(f"{kind.lower()}_{f}") for f in names]), F.array(*[F.col(f).cast("string") for f in names]))
    return rows.select(F.lit(kind).alias("kind"), F.array(*[F.coalesce(o.cast("long"), F.lit(-1).cast("long")) for o in order]).alias("order"), fields.alias("fields"))


def log_table(log: DataFrame, fields: list[str], trigger: str, seq: str = "seq", kind: str = "kind", values: str = "fields", block: int = BLOCK) -> DataFrame:
    """One row for each record of kind ``trigger``: the last value of every field up to it.

    ``log`` has dense sequence numbers. Blocks of consecutive records fill themselves; what
    comes from before a block is the last value of the blocks before it (one row a block).
    """
    if trigger not in KINDS:
        raise ValueError(f"no such record kind: {trigger}")
    known = {f"{k.lower()}_{f}" for k, names in KINDS.items() for f in names}
    if set(fields) - known:
        raise ValueError(f"no such fields: {sorted(set(fields) - known)}")
    wide = log.select(F.col(seq).alias("seq"), F.col(kind).alias("kind"), *[F.col(values)[f].alias(f) for f in fields]).withColumn("_block", F.floor(F.col("seq") / block))
    wide = cut(wide, "log")
    ends = wide.groupBy("_block").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_block", *[F.last(f, ignorenulls=True).over(before).alias(f"_{f}") for f in fields])
    inside = Window.partitionBy("_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    filled = wide.select("seq", "kind", "_block", *[F.last(f, ignorenulls=True).over(inside).alias(f) for f in fields])
    joined = filled.filter(F.col("kind") == trigger).join(carried, "_block")
    return joined.select("seq", *[F.coalesce(f, f"_{f}").alias(f) for f in fields])


def text_lines(rows: DataFrame, kind: str, sep: str = "\t", quote: str = '"') -> DataFrame:
    """(value): the kind, then its fields; floating values with seven digits, text in quotes."""
    parts = [F.lit(kind)]
    types = dict(rows.dtypes)
    for f in KINDS[kind]:
        if f in types:
            value = F.col(f)
            if types[f] in ("double", "float"):
                value = F.when(value.isNull(), F.lit("nan")).otherwise(F.format_string("%e", value))
            elif types[f] == "string":
                value = F.concat(F.lit(quote), F.coalesce(value, F.lit("")), F.lit(quote))
            else:
                value = F.coalesce(value.cast("string"), F.lit(""))
            parts.append(value)
    return rows.select(F.concat_ws(sep, *parts).alias("value"))


#: Payload types of a binary log: little-endian, a text as its length and bytes.
_PACKED = {"double": "<d", "float": "<d", "int": "<i", "smallint": "<i", "tinyint": "<i", "bigint": "<q", "boolean": "<i"}


def binary_records(rows: DataFrame, kind: str) -> DataFrame:
    """(value): each row as a framed record, the kind's number and its fields in order; null numbers are NaN or 0."""
    number, types = list(KINDS).index(kind), dict(rows.dtypes)
    names = [f for f in KINDS[kind] if f in types]
    formats = [_PACKED.get(types[f]) for f in names]

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for values in zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True):
                payload = b""
                for form, v in zip(formats, values, strict=True):
                    if form is None:
                        text = str("" if v is None else v).encode()
                        payload += struct.pack("<i", len(text)) + text
                    else:
                        payload += struct.pack(form, (float("nan") if form == "<d" else 0) if v is None else v)
                out.append(frame(number, payload))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return rows.select(*names).mapInArrow(pack, "value binary")


def write_log(tables: dict[str, DataFrame], folder: str, form: str = "parquet", sep: str = "\t", quote: str = '"') -> None:
    """One table for each record kind: Parquet, or lines of text."""
    for kind, rows in tables.items():
        if form == "text":
            text_lines(rows, kind, sep, quote).write.mode("overwrite").text(f"{folder}/{kind.lower()}")
        else:
            rows.write.mode("overwrite").parquet(f"{folder}/{kind.lower()}")
