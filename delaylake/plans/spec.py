"""The notation for delay embeddings.

Explicit: ``x,0,1;y,0:x,-1:g,0|...`` - embeddings by ``|``, roles by ``:`` (coordinates,
prediction, additional values), variables by ``;``, then a name and lags by ``,``. A positive
lag is the past. Range: each variable is ``name,from[,to[,step[,method]]]``; a ``shift`` range
gives one embedding for each lag, any other method (``trail``) one for each leading run of lags,
and the embeddings of several variables multiply, the first varying slowest. Empty sections
collapse, so ``x,0::z,0`` makes z a prediction variable; sections after the third are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

ROLES = ("co", "pre", "addit")
_NUMBER = re.compile(r"[ \t]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)[ \t]*$")


@dataclass(frozen=True)
class LagVar:
    name: str
    lag: int


@dataclass(frozen=True)
class EmbeddingDef:
    co: tuple[LagVar, ...] = ()
    pre: tuple[LagVar, ...] = ()
    addit: tuple[LagVar, ...] = ()
    ranges: tuple[tuple[int, int], ...] = field(default=())  # (dim, tau) of ranged coordinates

    @property
    def lags(self) -> list[int]:
        return [v.lag for role in ROLES for v in getattr(self, role)]

    @property
    def max_lag(self) -> int:
        return max([0, *self.lags])

    @property
    def min_lag(self) -> int:
        return min([0, *self.lags])

    @property
    def variables(self) -> list[str]:
        return sorted({v.name for role in ROLES for v in getattr(self, role)})

    def label(self, bundles: tuple[str, ...] = ()) -> str:
        """Three ``:`` always; a name is written again only where it changes inside a group."""

        def group(items) -> str:
            out, name = "", None
            for v in items:
                if v.name != name:
                    out += (";" if out else "") + v.name
                    name = v.name
                out += f",{v.lag}"
            return out

        return ":".join([*(group(getattr(self, role)) for role in ROLES), ";".join(bundles)])


def _whole(text: str) -> int:
    found = _NUMBER.match(text)
    if not found:
        raise ValueError(f"not a number: {text!r}")
    return int(float(found[1]))


def _parts(text: str, mark: str) -> list[str]:
    return [p for p in text.split(mark) if p]


def parse_lags(text: str) -> list[EmbeddingDef]:
    """Embedding definitions from the explicit notation."""
    out = []
    for embedding in _parts(text, "|"):
        roles = {}
        for role, section in zip(ROLES, _parts(embedding, ":"), strict=False):
            roles[role] = tuple(LagVar(name, _whole(lag)) for name, *lags in (_parts(v, ",") for v in _parts(section, ";")) for lag in lags)
        out.append(EmbeddingDef(**roles))
    return out


def parse_ranges(text: str) -> list[EmbeddingDef]:
    """Embedding definitions from the range notation; the ranges of one embedding multiply."""
    out = []
    for embedding in _parts(text, "|"):
        defs = [EmbeddingDef()]
        for role, section in zip(ROLES, _parts(embedding, ":"), strict=False):
            for variable in _parts(section, ";"):
                name, *fields = _parts(variable, ",")
                if not 1 <= len(fields) <= 4:
                    raise ValueError(f"a range is name,from[,to[,step[,method]]]: {variable!r}")
                start = _whole(fields[0])
                stop = _whole(fields[1]) if len(fields) > 1 else start
                step = _whole(fields[2]) if len(fields) > 2 else 1
                shift = len(fields) < 4 or fields[3] == "shift"
                if stop < start or step < 1:
                    raise ValueError(f"a range must ascend: {variable!r}")
                lags = [start + i * step for i in range(1 + (stop - start) // step)]
                choices = [(lag,) for lag in lags] if shift else [tuple(lags[: i + 1]) for i in range(len(lags))]
                grown = []
                for d in defs:
                    for choice in choices:
                        more = replace(d, **{role: getattr(d, role) + tuple(LagVar(name, lag) for lag in choice)})
                        if role == "co":
                            more = replace(more, ranges=d.ranges + ((len(choice), step),))
                        grown.append(more)
                defs = grown
        out += defs
    return out
