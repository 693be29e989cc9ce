import math

import pytest

from delaylake.operators.embed import bundles, embed
from delaylake.plans.spec import parse_lags
from delaylake.sources.series import TimeSeries, frame, frames, read_binary_log

PANEL = [("a", t, float(t), 1.0 if t % 2 else 0.0, t % 3 == 0) for t in range(9)] + [("b", t, 100.0 + t if t != 3 else None, float(t % 2), True) for t in range(7)]


def series(spark, rows=PANEL, **roles):
    df = spark.createDataFrame(rows, "who string, t long, x double, g double, f boolean").repartition(3)
    return TimeSeries.from_dataframe(df, ["x", "g"] if "bundle" not in roles else ["x"], time="t", id="who", **roles)


def brute(rows, co, pre, addit):
    """(id, t of each, values) by plain row offsets."""
    lags = [*co, *pre, *addit]
    past, future = max(0, *lags), -min(0, *lags)
    out = []
    for r in range(past, len(rows) - future):
        if rows[r - past][0] != rows[r + future][0]:
            continue
        values = [rows[r - k][2] for k in lags]
        if any(v is None or math.isnan(v) for v in values[: len(co) + len(pre)]):
            continue
        out.append((rows[r][0], [rows[r - k][1] for k in lags], values))
    return out


@pytest.mark.parametrize("block", [2, 5, 1 << 16])
@pytest.mark.parametrize("co, pre, addit", [((0, 1), (-1,), ()), ((0, 2), (-1, -2), (4,)), ((1,), (0,), (-3,)), ((0,), (-1,), (1, 2))])
def test_against_brute_force(spark, block, co, pre, addit):
    text = ":".join(",".join(["x", *map(str, part)]) for part in (co, pre, addit) if part)
    rows = embed(series(spark), parse_lags(text), block).orderBy("vec_num").collect()
    assert [r["vec_num"] for r in rows] == list(range(len(rows)))
    assert [(r["id"], [*r["t_co"], *r["t_pre"], *r["t_addit"]], [*r["co"], *r["pre"], *r["addit"]]) for r in rows] == brute(PANEL, co, pre, addit)


def test_unknown_variable_and_short_series(spark):
    with pytest.raises(ValueError):
        embed(series(spark), parse_lags("y,0:x,-1"))
    assert embed(series(spark), parse_lags("x,0,20:x,-1")).count() == 0
    assert embed(series(spark, PANEL[:0] or [("a", 0, None, None, True)]), parse_lags("x,0:x,-1")).count() == 0


def test_bundles(spark):
    vectors = embed(series(spark, bundle=["g"]), parse_lags("x,0:x,-1"))
    numbered = bundles(vectors).collect()
    assert {(r["bundle_num"], r["bundle"][0]) for r in numbered} == {(1, 0.0), (2, 1.0)}
    assert {r["bundle"][0] for r in bundles(vectors, [1]).collect()} == {1.0}
    assert {r["bundle_num"] for r in bundles(embed(series(spark), parse_lags("x,0:x,-1"))).collect()} == {0}
    gap = series(spark, [("a", t, 1.0, None, True) for t in range(4)], bundle=["g"])
    with pytest.raises(Exception, match="bundle value is missing"):
        bundles(embed(gap, parse_lags("x,0:x,-1"))).count()


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('Id,Time,"Var ""A""",B,in\nA1,0,20,-10,1\nA1,1,NA,-7,0\nA1,2,1.5x,nonsense,1\nB1,0,"31",-1,1\nB1,1,2e1,-5,x\n')
    ts = TimeSeries.from_csv(spark, str(path), ['Var "A"', "B"], time="Time", id="Id", in_lib="in")
    rows = ts.rows.orderBy("row").collect()
    assert [(r["id"], r["t"], r['Var "A"'], r["B"], r["in_lib"]) for r in rows] == [
        ("A1", 0, 20.0, -10.0, True), ("A1", 1, None, -7.0, False), ("A1", 2, 1.5, None, True), ("B1", 0, 31.0, -1.0, True), ("B1", 1, 20.0, -5.0, False),
    ]
    with pytest.raises(ValueError):
        TimeSeries.from_csv(spark, str(path), ["C"])
    bare = tmp_path / "b.csv"
    bare.write_text("1,2\n3,4\n")
    rows = TimeSeries.from_csv(spark, str(bare), ["1"], head=False).rows.orderBy("row").collect()
    assert [(r["t"], r["1"]) for r in rows] == [(0, 2.0), (1, 4.0)]
    short = tmp_path / "c.csv"
    short.write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception):
        TimeSeries.from_csv(spark, str(short), ["a", "b"]).rows.count()
    late = tmp_path / "d.csv"
    late.write_text("t,b\nx,2\n")
    with pytest.raises(Exception, match="unreadable time"):
        TimeSeries.from_csv(spark, str(late), ["b"], time="t").rows.count()


def test_binary_log(spark, tmp_path):
    data = frame(3, b"abc") + frame(7, b"") + frame(3, b"\x02\x03")
    assert list(frames(data)) == [(3, b"abc"), (7, b""), (3, b"\x02\x03")]
    (tmp_path / "x.log").write_bytes(data)
    rows = read_binary_log(spark, str(tmp_path / "x.log")).orderBy("seq").collect()
    assert [(r["kind"], bytes(r["payload"])) for r in rows] == [(3, b"abc"), (7, b""), (3, b"\x02\x03")]
    for bad in (b"\x01", data[:-1], b"\x02\x00", data + b"\x02\x00\x00\x00\x00\xff\xff\xff\xff\x03"):
        with pytest.raises(ValueError):
            list(frames(bad))
