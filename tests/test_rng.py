import ctypes

import pytest
from pyspark.sql import functions as F

from delaylake.functions.rng import WORD, LibcRandom, mixed


def test_libc_sequence():
    try:
        libc = ctypes.CDLL("libc.so.6")
    except OSError:
        pytest.skip("no GNU C library here")
    for seed in (1, 7):
        libc.srand(seed)
        mine = LibcRandom(seed)
        assert [mine.rand() for _ in range(5000)] == [libc.rand() for _ in range(5000)]


def test_permutation():
    assert sorted(LibcRandom(1).permutation(100)) == list(range(100))
    assert LibcRandom(1).permutation(50) == LibcRandom(1).permutation(50)


def test_mixed_spreads(spark):
    rows = spark.range(20_000).select(mixed(F.col("id"), F.lit(3).cast("long")).alias("v"))
    assert rows.filter((F.col("v") < 0) | (F.col("v") >= WORD)).count() == 0
    counts = [r["count"] for r in rows.groupBy(F.pmod("v", F.lit(10))).count().collect()]
    assert len(counts) == 10 and max(counts) < 1.15 * min(counts)
