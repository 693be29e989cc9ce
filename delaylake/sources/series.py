"""Time series as tables: rows in order, columns by role."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylake.functions.tables import numbered

NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
WHOLE = r"^\s*([+-]?\d+)"


@dataclass(frozen=True)
class TimeSeries:
    """``rows`` has row (dense, in order), id, t, in_lib, in_pre and the columns ``data`` and ``bundle``."""

    rows: DataFrame
    data: tuple[str, ...]
    bundle: tuple[str, ...] = ()
    has_lib: bool = False
    has_pre: bool = False

    @classmethod
    def from_dataframe(cls, df: DataFrame, data, time: str | None = None, id: str | None = None, in_lib: str | None = None, in_pre: str | None = None, bundle=(), order=None) -> TimeSeries:
        """Columns by role. Rows are ordered by id, time and then ``order``; NaN becomes null."""
        value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        name = F.col(id).cast("string") if id else F.lit(None).cast("string")
        flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c else F.lit(True)
        rows = df.select(
            name.alias("id"), (F.col(time).cast("long") if time else F.lit(None).cast("long")).alias("t"), flag(in_lib).alias("in_lib"), flag(in_pre).alias("in_pre"),
            *[value(c).alias(c) for c in (*data, *bundle)], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order or ())],
        )
        keys = ["id", "t", *[f"_o{i}" for i in range(len(order or ()))]]
        rows = numbered(rows, keys, "row", "series").drop(*keys[2:])
        return cls(rows.withColumn("t", F.coalesce("t", "row")), tuple(data), tuple(bundle), in_lib is not None, in_pre is not None)

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, data, head: bool = True, time: str | None = None, id: str | None = None, in_lib: str | None = None, in_pre: str | None = None, bundle=(), sep: str = ",") -> TimeSeries:
        """A CSV file with quotes doubled inside quotes. Without a head columns are "0", "1", ...

        A row with a wrong number of fields or an unreadable time ends the load. Values that
        begin with NA or are no number are missing; a flag is set iff its text is 1.
        """
        first = spark.read.csv(path, header=False, sep=sep, quote='"', escape='"').limit(1).first()
        names = [str(x) for x in first] if head else [str(i) for i in range(len(first))]
        schema = ", ".join(f"`{n}` string" for n in names)
        raw = spark.read.csv(path, header=head, schema=schema, sep=sep, quote='"', escape='"', mode="FAILFAST", enforceSchema=True)
        missing = {*data, *bundle, *(c for c in (time, id, in_lib, in_pre) if c)} - set(names)
        if missing:
            raise ValueError(f"no such columns: {sorted(missing)}")
        rows = raw.select(
            *[cls._number(F.col(f"`{c}`")).alias(c) for c in (*data, *bundle)],
            (F.col(f"`{id}`") if id else F.lit(None).cast("string")).alias("id"),
            (cls._time(F.col(f"`{time}`")) if time else F.lit(None).cast("long")).alias("t"),
            *[((F.trim(F.col(f"`{c}`")) == "1") if c else F.lit(True)).alias(n) for c, n in ((in_lib, "in_lib"), (in_pre, "in_pre"))],
            F.monotonically_increasing_id().alias("_line"),
        )
        rows = numbered(rows, ["_line"], "row", "csv").drop("_line")
        return cls(rows.withColumn("t", F.coalesce("t", "row")), tuple(data), tuple(bundle), in_lib is not None, in_pre is not None)

    @staticmethod
    def _number(text: Column) -> Column:
        part = F.regexp_extract(text, NUMBER, 1)
        return F.when(~F.startswith(text, F.lit("NA")) & (part != ""), part.cast("double"))

    @staticmethod
    def _time(text: Column) -> Column:
        part = F.regexp_extract(text, WHOLE, 1)
        return F.when(part != "", part.cast("long")).otherwise(F.raise_error(F.concat(F.lit("unreadable time: "), F.coalesce(text, F.lit("")))))


def frames(data: bytes):
    """(kind, payload) of a binary log: byte 2, kind and size as ints, the payload, byte 3."""
    at = 0
    while at < len(data):
        if data[at] != 2:
            raise ValueError(f"no frame begins at byte {at}")
        if at + 9 > len(data):
            raise ValueError(f"the frame at byte {at} has no header")
        kind, size = struct.unpack_from("<ii", data, at + 1)
        end = at + 9 + size
        if size < 0 or end >= len(data) or data[end] != 3:
            raise ValueError(f"the frame at byte {at} does not end")
        yield kind, data[at + 9 : end]
        at = end + 1


def frame(kind: int, payload: bytes) -> bytes:
    return b"\x02" + struct.pack("<ii", kind, len(payload)) + payload + b"\x03"


def read_binary_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, kind, payload) of every record of the binary logs at ``path``; one task a file."""
    import pyarrow as pa

    def read(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(frames(data))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(found), pa.string()), pa.array(range(len(found)), pa.int64()), pa.array([k for k, _ in found], pa.int32()), pa.array([p for _, p in found], pa.binary())],
                    names=["file", "seq", "kind", "payload"],
                )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "file string, seq long, kind int, payload binary")
