import pytest

from delaylake.operators.split import library_sizes
from delaylake.plans.spec import EmbeddingDef, LagVar, parse_lags, parse_ranges


def lags(items):
    return [(v.name, v.lag) for v in items]


def test_explicit():
    one, two = parse_lags("x,0,1;y,0:x,-1;y,-2:g,0|z,3:z,-1")
    assert lags(one.co) == [("x", 0), ("x", 1), ("y", 0)] and lags(one.pre) == [("x", -1), ("y", -2)] and lags(one.addit) == [("g", 0)]
    assert lags(two.co) == [("z", 3)] and (one.max_lag, one.min_lag, two.max_lag, two.min_lag) == (1, -2, 3, -1)
    assert one.label(("f", "h")) == "x,0,1;y,0:x,-1;y,-2:g,0:f;h" and two.label() == "z,3:z,-1::"


def test_empty_sections_collapse_and_late_ones_are_ignored():
    d = parse_lags("x,0::z,0")[0]
    assert lags(d.pre) == [("z", 0)] and d.addit == ()
    assert lags(parse_lags("x,0:x,-1:g,0:h,1")[0].addit) == [("g", 0)]
    assert lags(parse_lags("x,1.9,-1.9:x,-1")[0].co) == [("x", 1), ("x", -1)]
    with pytest.raises(ValueError):
        parse_lags("x,a:x,-1")


def test_ranges():
    assert [lags(d.co) for d in parse_ranges("x,0,2,1,trail:x,-1")] == [[("x", 0)], [("x", 0), ("x", 1)], [("x", 0), ("x", 1), ("x", 2)]]
    assert [lags(d.co) for d in parse_ranges("x,0,4,2:x,-1")] == [[("x", 0)], [("x", 2)], [("x", 4)]]
    both = parse_ranges("x,0,2,1,trail;y,0,1,1,trail:x,-1")
    assert [(len([v for v in d.co if v.name == "x"]), len([v for v in d.co if v.name == "y"])) for d in both] == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2)]
    assert both[3].ranges == ((2, 1), (2, 1)) and parse_ranges("x,3:x,-1")[0].ranges == ((1, 1),)
    for bad in ("x,2,0:x,-1", "x,0,1,1,trail,9:x,-1", "x,0,1,0:x,-1"):
        with pytest.raises(ValueError):
            parse_ranges(bad)


def test_definitions_are_values():
    assert EmbeddingDef((LagVar("x", 0),)) == EmbeddingDef((LagVar("x", 0),))


def test_library_sizes():
    assert library_sizes(10, 100, 30, 0.0, 1000) == [10, 40, 70, 100]
    assert library_sizes(10, 100, 40, 0.0, 1000) == [10, 50, 90, 100]
    assert library_sizes(10, 10, 5, 0.0, 1000) == [10]
    assert library_sizes(10, 100, 40, 0.0, 60) == [10, 50]
    assert library_sizes(50, 100, 0, 0.0, 50) == []
    assert library_sizes(50, 52, 0, 0.0, 10, replacing=True) == [50, 51, 52]
    grown = library_sizes(10, 500, 10, 0.5, 1000)
    assert grown[:4] == [10, 20, 35, 57] and grown[-1] == 500
