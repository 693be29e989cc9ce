"""Random numbers for splits.

``mixed`` is integer arithmetic that Spark and DuckDB compute alike, so splits depend on no
partitioning. ``LibcRandom`` gives the numbers of the GNU C library's ``rand``, for comparison
with programs that use it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 1 << 32


def mixed(i: Column, s: Column) -> Column:
    """A number in [0, 2^32) from a place and a set number."""
    x = F.pmod(F.pmod(i, F.lit(WORD)) * F.lit(1103515245) + F.pmod(s, F.lit(WORD)) * F.lit(40503) + F.lit(12345), F.lit(WORD))
    for _ in range(2):
        x = x.bitwiseXOR(F.shiftright(x, 16))
        x = F.pmod(x * F.lit(73244475), F.lit(WORD))
    return x.bitwiseXOR(F.shiftright(x, 16))


def mixed_sql(i: str, s: str) -> str:
    """The same in DuckDB's SQL."""
    x = f"((({i}) * 1103515245 + ({s}) * 40503 + 12345) % {WORD})"
    for _ in range(2):
        x = f"((xor({x}, {x} >> 16) * 73244475) % {WORD})"
    return f"xor({x}, {x} >> 16)"


class LibcRandom:
    """Additive feedback generator with the published seeding, 31 words of state."""

    def __init__(self, seed: int = 1):
        state = [seed or 1]
        for _ in range(30):
            state.append(16807 * state[-1] % 2147483647)
        self._last = state
        for _ in range(310 + 3):
            self._step()

    def _step(self) -> int:
        last = self._last
        value = (last[-3] + last[-31]) % WORD if len(last) >= 34 else last[-31]
        last.append(value)
        if len(last) > 64:
            del last[:-34]
        return value

    def rand(self) -> int:
        return self._step() >> 1

    def permutation(self, n: int) -> list[int]:
        """0..n-1 shuffled from the end, each place with a place at or below it."""
        out = list(range(n))
        for i in range(n - 1, 0, -1):
            j = self.rand() % (i + 1)
            out[i], out[j] = out[j], out[i]
        return out

    def draws(self, n: int, times: int) -> list[int]:
        return [self.rand() % n for _ in range(times)]
