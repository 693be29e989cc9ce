import math

import numpy as np
import pytest

from delaylake.functions.rng import LibcRandom
from delaylake.functions.tables import medians, numbered
from delaylake.operators.embed import bundles, co_variables, embed
from delaylake.operators.log import KINDS, binary_records, log_table, records, text_lines, write_log
from delaylake.operators.neighbours import Exclusion, Search, neighbours
from delaylake.operators import neighbours as nb
from delaylake.operators import smap
from delaylake.operators.simplex import Denominator, Simplex, library_rms
from delaylake.operators.smap import FAILED, NO_POINTS, RESTRICTED, SMap, reference_distance, total_least_squares
from delaylake.operators.split import Bootstrap, Convergent, KFold, LeaveOneOut, UserSplit
from delaylake.operators.stats import skill
from delaylake.plans.spec import parse_lags
from delaylake.plans.traverse import traverse
from delaylake.sources.series import TimeSeries, frames


def series(spark, values, **more):
    df = spark.createDataFrame([(t, float(v)) for t, v in enumerate(values)], "t long, x double")
    return TimeSeries.from_dataframe(df, ["x"], time="t", **more)


def logistic(n):
    x = [0.4]
    while len(x) < n:
        x.append(3.8 * x[-1] * (1 - x[-1]))
    return x


def vectors_of(spark, values, text="x,0,1:x,-1"):
    return bundles(embed(series(spark, values), parse_lags(text)))


@pytest.mark.parametrize("search", [Search(), Search(Exclusion.TIME_COORD), Search(Exclusion.TIME_WINDOW, 5), Search(Exclusion.TIME_COORD | Exclusion.TIME_WINDOW, 3)])
def test_neighbours_against_brute_force(spark, monkeypatch, search):
    from delaylake.operators import neighbours as module

    monkeypatch.setattr(module, "TARGET_BLOCK", 7)
    monkeypatch.setattr(module, "LIBRARY_BLOCK", 11)
    values = [round(v, 1) for v in logistic(60)]  # many ties
    vectors = vectors_of(spark, values)
    rows = vectors.collect()
    got = {}
    for r in neighbours(LeaveOneOut().split(vectors), vectors, {0: 4}, search).collect():
        got.setdefault(r["target_num"], []).append((-r["seq"], r["num"], r["sqdst"]))
    for t in rows:
        able = []
        for c in rows:
            if c["vec_num"] == t["vec_num"]:
                continue
            if search.exclude & Exclusion.TIME_COORD and set(c["t_co"]) & set(t["t_co"]):
                continue
            if search.exclude & Exclusion.TIME_WINDOW and abs(c["t_co"][0] - t["t_co"][0]) < search.window:
                continue
            able.append((sum((a - b) * (a - b) for a, b in zip(t["co"], c["co"])), c["vec_num"]))
        assert [(n, d) for _, n, d in sorted(got[t["vec_num"]])] == [(n, d) for d, n in sorted(able)[:4]]


def test_simplex_forecasts_a_logistic_map(spark):
    run = traverse(series(spark, logistic(300)), parse_lags("x,0,1:x,-1;x,-4"), Simplex())
    near, far = (r["rho"] for r in run.stats().orderBy("pre_val_num").collect())
    assert near > 0.99 and far < near


def test_too_few_neighbours_and_equal_points(spark):
    assert [r["pre_val"] for r in traverse(series(spark, [1, 2, 3]), parse_lags("x,0:x,-1"), Simplex(3)).predictions.collect()] == [None, None]
    for d in Denominator:
        assert [r["pre_val"] for r in traverse(series(spark, [5] * 6), parse_lags("x,0:x,-1"), Simplex(1, d)).predictions.collect()] == [5.0] * 5


def test_library_rms_is_the_mean_over_pairs(spark):
    vectors = vectors_of(spark, logistic(40))
    co = np.array([r["co"] for r in vectors.collect()])
    pairs = [((a - b) ** 2).sum() for i, a in enumerate(co) for b in co[i + 1 :]]
    got = library_rms(LeaveOneOut().split(vectors), vectors, {0: 2}).first()["_den"]
    assert got == pytest.approx(math.sqrt(np.mean(pairs)), rel=1e-9)


def sets_of(split, vectors):
    made = split.split(vectors)
    out = {}
    for side, table in (("L", made.library), ("P", made.prediction)):
        for r in table.orderBy("set_num", "vec_idx").collect():
            out.setdefault(r["set_num"], {"L": [], "P": []})[side].append(r["vec_num"])
    return out


@pytest.mark.parametrize("rng", ["arith", "libc"])
def test_kfold(spark, rng):
    vectors = vectors_of(spark, logistic(25), "x,0:x,-1")  # 24 vectors
    right = sets_of(KFold(5, 2, "corrected", rng), vectors)
    assert len(right) == 10
    for r in range(2):
        folds = [right[5 * r + k]["P"] for k in range(5)]
        assert sorted(sum(folds, [])) == list(range(24)) and [len(f) for f in folds] == [4, 5, 5, 5, 5]
    assert all(sorted(s["L"] + s["P"]) == list(range(24)) for s in right.values())
    assert right[0]["P"] != right[5]["P"]
    for s in sets_of(KFold(5, 1, rng=rng), vectors).values():
        assert len(s["L"]) == 24 - len(s["P"]) and len(set(s["L"]) & set(s["P"])) == 1 and s["P"][0] in s["L"]
    with pytest.raises(ValueError):
        KFold(30).split(vectors)


def test_other_splits(spark):
    vectors = vectors_of(spark, logistic(13), "x,0:x,-1")  # 12 vectors
    everything = list(range(12))
    assert sets_of(LeaveOneOut(), vectors) == {0: {"L": everything, "P": everything}}
    shifts = sets_of(Convergent(3, 6, 3, 0.0, "shift", 5), vectors)
    assert [shifts[i]["L"] for i in range(6)] == [[0, 1, 2], [5, 6, 7], [10, 11, 0], [0, 1, 2, 3, 4, 5], [5, 6, 7, 8, 9, 10], [10, 11, 0, 1, 2, 3]]
    assert all(s["P"] == everything for s in shifts.values())
    mixed = sets_of(Convergent(4, 8, 4, 0.0, "boot_permut", n_bootstrap=2), vectors)
    assert [len(set(mixed[i]["L"])) for i in range(4)] == [4, 4, 8, 8] and mixed[0]["L"] != mixed[1]["L"]
    drawn = sets_of(Bootstrap(2, pre_is_lib=True), vectors)
    assert all(len(s["L"]) == 12 and s["L"] == s["P"] and len(set(s["L"])) < 12 for s in drawn.values())
    assert len(sets_of(Bootstrap(1, 30, rng="libc"), vectors)[0]["L"]) == 30
    with pytest.raises(ValueError):
        Bootstrap(0).split(vectors)
    with pytest.raises(ValueError):
        Bootstrap(1, 5, per_addit_group=True).split(vectors)


def test_user_split(spark):
    df = spark.createDataFrame([(t, float(t), t < 6, t >= 4) for t in range(10)], "t long, x double, l boolean, p boolean")
    ts = TimeSeries.from_dataframe(df, ["x"], time="t", in_lib="l", in_pre="p")
    assert sets_of(UserSplit(), bundles(embed(ts, parse_lags("x,0:x,-1")))) == {0: {"L": [0, 1, 2, 3, 4, 5], "P": [4, 5, 6, 7, 8]}}
    none = TimeSeries.from_dataframe(df.filter("l"), ["x"], time="t", in_lib="l", in_pre="p")
    with pytest.raises(ValueError):
        UserSplit().split(bundles(embed(none, parse_lags("x,0:x,-1"))).filter("not use_in_pre"))


def test_user_split_needs_both_sides_of_every_group(spark):
    df = spark.createDataFrame([(t, float(t), t < 6 or t % 2 == 0, t >= 4, float(t % 2)) for t in range(12)], "t long, x double, l boolean, p boolean, g double")
    ts = TimeSeries.from_dataframe(df.withColumn("l", df.l & (df.g == 0)), ["x"], time="t", in_lib="l", in_pre="p", bundle=["g"])
    with pytest.raises(ValueError, match="empty"):
        UserSplit().split(bundles(embed(ts, parse_lags("x,0:x,-1"))))


def test_draws_of_the_c_library(spark):
    vectors = bundles(embed(series(spark, list(range(12))), parse_lags("x,0:x,-1")))
    random = LibcRandom(1)
    want = {i: random.draws(11, size) for i, size in enumerate((4, 4, 6, 6))}
    got = sets_of(Convergent(4, 6, 2, 0.0, "bootstrap", n_bootstrap=2, rng="libc"), vectors)
    assert {i: s["L"] for i, s in got.items()} == want
    random = LibcRandom(1)
    assert [s["L"] for _, s in sorted(sets_of(Bootstrap(2, rng="libc"), vectors).items())] == [random.draws(11, 11) for _ in range(2)]
    with pytest.raises(ValueError):
        Bootstrap(2, per_addit_group=True, rng="libc").split(vectors)


def test_unknown_variables_are_skipped(spark):
    ts = series(spark, logistic(30))
    definitions = parse_lags("x,0:x,-1|y,0:x,-1|x,0,1:x,-1")
    with pytest.raises(ValueError):
        traverse(ts, definitions, Simplex())
    run = traverse(ts, definitions, Simplex(search=Search(Exclusion.TIME_COORD, co_var={0: (0,), 2: (0, 0)})), skip_unknown=True)
    assert {r["emb_num"] for r in run.predictions.select("emb_num").distinct().collect()} == {0, 2}


@pytest.mark.parametrize("search", [Search(), Search(Exclusion.TIME_WINDOW, 3), Search(once=True)])
def test_a_pruned_search_finds_the_same(spark, monkeypatch, search):
    values = [v + 0.001 * (i % 7) for i, v in enumerate(logistic(1200))]
    vectors = bundles(embed(series(spark, values), parse_lags("x,0,1:x,-1|x,0,1,2:x,-1")))
    split = (Bootstrap(2, 900) if search.once else LeaveOneOut()).split(vectors)
    rows = lambda: sorted(map(tuple, nb.neighbours(split, vectors, {0: 3, 1: 5}, search).select(*nb.TASK, "target_idx", "seq", "num", "vec_idx", "sqdst").collect()))
    want = rows()
    monkeypatch.setattr(nb, "LIBRARY_BLOCK", 100)
    monkeypatch.setattr(nb, "CELL", 60)
    assert rows() == want and len(want) > 5000


def test_a_pruned_search_compares_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(nb, "CELL", 100)
    vectors = bundles(embed(series(spark, logistic(4000)), parse_lags("x,0,1:x,-1")))
    tiles = nb._tiled(nb.with_vectors(LeaveOneOut().split(vectors).library, vectors), "_tile")
    sizes = [r["count"] for r in tiles.groupBy("_tile").count().collect()]
    assert sum(sizes) == 3998 and max(sizes) <= 101 and len(sizes) >= 40
    key, compared = [*nb.TASK, "_tile", "_cell"], 0
    for (left, right), _ in nb.rounds(tiles, tiles.withColumnRenamed("_tile", "_cell"), {0: 3}, Search()):
        sides = [side.groupBy(*key).count().withColumnRenamed("count", name) for side, name in ((left, "a"), (right, "b"))]
        compared += sides[0].join(sides[1], key).selectExpr("sum(a * b)").first()[0]
    assert compared < 0.1 * 3998**2


def test_total_least_squares():
    rng = np.random.default_rng(0)
    a, x = rng.normal(size=(50, 3)), np.array([[2.0, 1.0], [-0.5, 0.0], [1.0, 3.0]])
    found, rank, warning = total_least_squares(np.concatenate((a, a @ x), axis=1), 3)
    assert np.allclose(found, x) and (rank, warning) == (3, 0)
    for m in (2, 3, 20):  # the closest consistent system: the residual is orthogonal in the sense of the smallest singular vectors
        c = rng.normal(size=(m, 5))
        found, rank, warning = total_least_squares(c, 3)
        u, s, vt = np.linalg.svd(c)
        near = (u[:, :rank] * s[:rank]) @ vt[:rank]
        assert np.allclose(near[:, :3] @ found, near[:, 3:], atol=1e-8) and warning == 0
    twin = np.concatenate((a[:, :1], a[:, :1], a[:, :1] * 4), axis=1)
    found, rank, _ = total_least_squares(twin, 2)
    assert rank <= 2 and np.allclose(twin[:, :2] @ found, twin[:, 2:], atol=1e-6)
    found, rank, _ = total_least_squares(np.zeros((4, 3)), 2)
    assert rank == 0 and not found.any()
    # a target that the coordinates do not explain at all has no generic solution
    found, rank, warning = total_least_squares(np.diag([1e-9, 1.0, 1.0]), 2)
    assert warning in (0, 1, 2)


def test_reference_distance():
    d = np.array([3.0, 0.0, 1.0, 2.0])
    assert reference_distance(d, None, True, "reference") == 1.5
    assert reference_distance(d, 2, True, "corrected") == 1.5
    assert reference_distance(d, 2, True, "reference") == (2.0 - 1.0) / 2
    assert reference_distance(d, 2, False, "reference") == (0.0 - 1.0) / 2
    assert reference_distance(np.zeros(3), 2, True, "corrected") == 0.0


def test_map_recovers_a_linear_rule(spark):
    values = [1.0, 0.5]
    while len(values) < 40:
        values.append(1.2 * values[-1] - 0.7 * values[-2] + 1)
    for predictor in (SMap((0.0, 1.0)), SMap((0.5,), nnn=8), SMap((0.5,), center=True), SMap((1.0,), xnn=3, compat="corrected")):
        run = traverse(series(spark, values), parse_lags("x,0,1:x,-1"), predictor)
        rows = run.predictions.collect()
        assert len(rows) == 38 * len(predictor.thetas)
        assert all(r["pre_val"] == pytest.approx(r["obs_val"], abs=1e-5) for r in rows if r["status"] == 0)
        assert sum(r["status"] == 0 for r in rows) > 0.8 * len(rows)
    one = SMap((0.0,))
    assert one.solve(np.zeros(2), np.zeros((0, 2)), np.zeros((0, 1)), np.zeros(0), 0.0)["status"] == NO_POINTS
    tight = SMap((0.0,), restrict=0.1).solve(np.ones(1), np.arange(4.0)[:, None], np.arange(4.0)[:, None] * 2, np.arange(4.0), 0.0)
    assert tight["status"] == RESTRICTED and tight["pre_val"] == [None]
    assert FAILED == 4 and SMap.sweep(0, 1, 0.25) == (0, 0.25, 0.5, 0.75, 1.0)
    with pytest.raises(ValueError):
        SMap.sweep(0, 1, 0)


def plain_map(map_, x, co, pre, distance, theta):
    """One target by the singular values of its whole weighted matrix."""
    scale = reference_distance(distance, map_.xnn, map_.nnn <= 0, map_.compat)
    matrix = np.concatenate((np.ones((len(co), 1)), co, pre), axis=1)
    means = matrix.mean(0) * map_.center
    means[0] = 0
    c = (matrix - means) * (np.exp(-theta * distance / scale) if scale else np.ones(len(co)))[:, None]
    e, rank = co.shape[1], min(co.shape[1] + 1, len(co))
    v2 = np.linalg.svd(c)[2][rank:].T
    return np.concatenate(([1.0], x - means[1 : e + 1])) @ (-v2[: e + 1] @ np.linalg.pinv(v2[e + 1 :])) + means[e + 1 :]


@pytest.mark.parametrize("block", [4096, 16])
def test_maps_against_a_plain_loop(spark, monkeypatch, block):
    monkeypatch.setattr(smap, "LIBRARY_BLOCK", block)
    monkeypatch.setattr(smap, "TARGET_BLOCK", 20)
    monkeypatch.setattr(smap, "STACK", 500)
    values = [v + 0.01 * math.sin(7.3 * i * i) for i, v in enumerate(logistic(60))]
    ts, definitions = series(spark, values), parse_lags("x,0,1:x,-1;x,-2")
    vectors = embed(ts, definitions).orderBy("vec_num").collect()
    co, pre, t = (np.array([v[c] for v in vectors], float) for c in ("co", "pre", "t_co"))
    for map_ in (SMap((0.0, 1.5)), SMap((0.7,), center=True), SMap((1.0,), xnn=4), SMap((1.0,), xnn=4, compat="corrected"), SMap((0.5,), search=Search(Exclusion.TIME_WINDOW, 3)), SMap((0.0, 0.8), nnn=9, center=True), SMap((1.2,), nnn=9, xnn=3)):
        run = traverse(ts, definitions, map_)
        rows = run.predictions.collect()
        assert len(rows) == len(vectors) * 2 * len(map_.thetas)
        for r in rows:
            i = r["target_num"]
            d = np.sqrt(((co - co[i]) ** 2).sum(1))
            use = np.arange(len(co)) != i
            if map_.search.exclude:
                use &= np.abs(t[:, 0] - t[i, 0]) >= 3
            if map_.nnn:
                near = sorted(np.flatnonzero(use), key=lambda j: (d[j], j))[: map_.nnn]
                use = np.isin(np.arange(len(co)), near)
            assert r["status"] == 0 and r["n_used"] == use.sum()
            want = plain_map(map_, co[i], co[use], pre[use], d[use], map_.thetas[r["params_id"]])
            assert r["pre_val"] == pytest.approx(want[r["pre_val_num"]], abs=1e-8), (map_, r)


def test_singular_values_and_vectors_are_logged(spark):
    run = traverse(series(spark, logistic(20)), parse_lags("x,0:x,-1"), SMap((0.5,), arrays=True))
    tables = run.tables()
    one = tables["DTLSO"].orderBy("target_num").first()
    assert (one["ldx"], one["n"], one["l"], one["m"], one["ldc"]) == (2, 2, 1, 18, 19)
    heads = {(r["name"], r["nrow"], r["ncol"]) for r in tables["DTLSAN"].collect()}
    assert heads == {("C", 3, 3), ("S", 3, 1), ("X", 2, 1)}
    cells = {(r["name"], r["row"], r["col"]): r["val"] for r in tables["DTLSAV"].filter("target_num = 3").collect()}
    assert len(cells) == 9 + 3 + 2 and cells["S", 0, 0] >= cells["S", 1, 0] >= cells["S", 2, 0] >= 0
    v = np.array([[cells["C", i, j] for j in range(3)] for i in range(3)])
    assert np.allclose(v.T @ v, np.eye(3))
    assert np.allclose([cells["X", i, 0] for i in range(2)], -v[:2, 2] / v[2, 2])


def test_skill(spark):
    rows = [("a", 1.0, 2.0), ("a", 3.0, 3.0), ("a", None, 1.0), ("a", 8.0, 5.0), ("b", None, 1.0), (None, 2.0, 2.0), ("c", float("nan"), 1.0), ("d", 1.0, 1.0), ("d", 2.0, 4.0)]
    got = {r["k"]: r for r in skill(spark.createDataFrame(rows, "k string, pre_val double, obs_val double"), ["k"]).collect()}
    a = got["a"]
    assert (a["n_pre_obs"], a["avg_pre"], a["md_pre"], a["md_obs"], a["mdad_pre"], a["mdae_pre_obs"]) == (3, 4.0, 3.0, 3.0, 2.0, 1.0)
    assert a["var_pre"] == pytest.approx(26 / 3) and a["rmse_pre_obs"] == pytest.approx(math.sqrt(10 / 3)) and a["mae_pre_obs"] == pytest.approx(4 / 3)
    for k in ("b", "c"):
        assert (got[k]["n_pre_obs"], got[k]["avg_pre"], got[k]["cov_pre_obs"], got[k]["md_pre"], got[k]["rho"]) == (0, 0.0, 0.0, None, None)
    assert (got[None]["n_pre_obs"], got[None]["md_pre"], got[None]["mdad_pre"]) == (1, 2.0, 0.0)
    assert (got["d"]["md_obs"], got["d"]["mdad_obs"]) == (2.5, 1.5)


def test_numbers_and_medians(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as k", "cast(pmod(id * 37, 101) as double) as v").repartition(5)
    rows = numbered(df, ["v", "id"], "n").orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1000)) and [(r["v"], r["id"]) for r in rows] == sorted((r["v"], r["id"]) for r in rows)
    want = {k: float(np.median([r["v"] for r in rows if r["k"] == k])) for k in range(7)}
    assert {r["k"]: r["v"] for r in medians(df, ["k"], ["v"]).collect()} == want


def test_log_table(spark):
    log = [("EMBPAR1", {"embpar1_emb_num": "0"}), ("PD", {"pd_pre_val": "1"}), ("TG2", {"tg2_target_num": "5"}), ("PD", {"pd_pre_val": "2"}), ("PD", {"pd_pre_val": None}), ("EMBPAR1", {"embpar1_emb_num": "1"}), ("PD", {"pd_pre_val": "3"})]
    rows = spark.createDataFrame([(i, k, f) for i, (k, f) in enumerate(log)], "seq long, kind string, fields map<string,string>")
    for block in (1, 2, 100):
        got = log_table(rows, ["embpar1_emb_num", "tg2_target_num", "pd_pre_val"], "PD", block=block).orderBy("seq").collect()
        assert [tuple(r)[1:] for r in got] == [("0", None, "1"), ("0", "5", "2"), ("0", "5", "2"), ("1", "5", "3")]
    for fields, trigger in ((["nothing"], "PD"), (["pd_pre_val"], "XX")):
        with pytest.raises(ValueError):
            log_table(rows, fields, trigger)
    lines = text_lines(spark.createDataFrame([(0, 1.5, 2.0, 0)], "pre_val_num int, pre_val double, obs_val double, status int"), "PD").first()["value"]
    assert lines == "PD\t0\t1.500000e+00\t2.000000e+00\t0"
    assert records(rows.selectExpr("seq as target_num"), "TG2", []).first()["fields"] == {"tg2_target_num": "0"}


def test_every_level_of_the_log(spark, tmp_path):
    df = spark.createDataFrame([(t, float(v), float(t % 2), float(t % 3)) for t, v in enumerate(logistic(40))], "t long, x double, g double, h double")
    ts = TimeSeries.from_dataframe(df, ["x", "h"], time="t", bundle=["g"])
    kinds = set()
    for predictor, split in ((Simplex(), KFold(2)), (SMap((0.0, 1.0)), LeaveOneOut())):
        run = traverse(ts, parse_lags("x,0:x,-1:h,0"), predictor, split)
        tables = run.tables()
        kinds |= set(tables)
        for kind, rows in tables.items():
            assert set(KINDS[kind]) & set(rows.columns) and (kind == "EMBPAR3" or rows.count() > 0), kind
        log = run.log()
        rows = log.orderBy("seq").collect()
        assert [r["seq"] for r in rows] == list(range(len(rows))) and rows[0]["kind"] == "EMBPAR1"
        number = len(run.predictions.select("params_id").distinct().collect())
        table = run.log_table(["bp_bundle_num", "kp_fn_type", "tg2_target_num", "pd_pre_val", "pd_obs_val"], "PD").collect()
        keyed = {(str(r["bundle_num"]), str(r["target_num"]), str(r["obs_val"])) for r in run.predictions.collect()}
        assert len(table) == run.predictions.count() and {(r["bp_bundle_num"], r["tg2_target_num"], r["pd_obs_val"]) for r in table} == keyed
        assert number == len(run.params)
    assert {"STAT", "ADDT", "VAL", "BV", "SPKF", "SPLO", "NN", "PD", "VPM", "VPT", "DTLSO", "DTLSAV", "KPEXP", "KPTLS"} <= kinds
    write_log({"PD": tables["PD"]}, str(tmp_path), "text")
    assert spark.read.text(str(tmp_path / "pd")).count() == tables["PD"].count()
    framed = b"".join(bytes(r["value"]) for r in binary_records(tables["PD"], "PD").collect())
    assert sum(1 for _ in frames(framed)) == tables["PD"].count()


def test_same_variable_exclusion():
    d = parse_lags("x,0,1;y,0:x,-1")[0]
    assert co_variables(d) == (0, 0, 1)


def test_maps_run_on_the_daily_series(spark, sf):
    from delaylake.plans import queries as q

    want = q.QUERIES["simplex_min"](spark, sf).select("target_num").distinct().count()
    got = q.QUERIES["tls_knn"](spark, sf).select("target_num").distinct().count()
    assert got > 0.9 * want
    panel = q.QUERIES["tls_status_panel"](spark, sf).groupBy().sum("n").first()[0]
    assert panel > 1000


@pytest.mark.parametrize("search", [Search(), Search(Exclusion.TIME_WINDOW, 3), Search(Exclusion.TIME_COORD, once=True)])
@pytest.mark.parametrize("split", [LeaveOneOut(), KFold(3), Bootstrap(2, 900), UserSplit()])
def test_tiles_find_the_same_neighbours(spark, monkeypatch, split, search):
    values = [round(v + 0.01 * (i % 7), 2) for i, v in enumerate(logistic(1200))] + [0.5] * 300  # many ties, and equal vectors
    df = spark.createDataFrame([(t, v, t % 3 > 0, t % 5 < 3) for t, v in enumerate(values)], "t long, x double, l boolean, p boolean")
    ts = TimeSeries.from_dataframe(df, ["x"], time="t", in_lib="l", in_pre="p")
    vectors = bundles(embed(ts, parse_lags("x,0,1:x,-1|x,0,1,2:x,-1;x,-2")))
    sets = split.split(vectors)
    names = ["target_idx", "target_num", "seq", "num", "vec_idx", "sqdst", "pre"]

    def listed(key, targets, library, found):
        import numpy as np
        import pyarrow as pa

        at, rank = np.nonzero(found.row >= 0)
        row = found.row[at, rank]
        columns = [np.full(len(at), x) for x in key] + [targets.idx[at], targets.num[at], found.number[at] - rank, library.num[row], library.idx[row], found.sqdst[at, rank]]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table([*(pa.array(c).cast(t) for c, t in zip(columns, types)), pa.array(library.pre[row].tolist(), pa.list_(pa.float64()))], names=[*nb.TASK, *names])

    schema = "emb_num int, bundle_num int, set_num long, target_idx long, target_num long, seq int, num long, vec_idx long, sqdst double, pre array<double>"
    rows = lambda df: sorted(map(str, df.select(*nb.TASK, *names).collect()))
    want = rows(nb.neighbours(sets, vectors, {0: 6, 1: 6}, search))
    for tile in (1 << 20, 150):
        monkeypatch.setattr(nb, "TILE", tile)
        monkeypatch.setattr(nb, "BORDER", 2)
        assert rows(nb.with_nearest(sets, vectors, 6, search, listed, schema)) == want and len(want) > 5000


def test_maps_of_neighbours_write_no_table_of_them(spark, monkeypatch):
    from delaylake.plans import traverse as module

    written = {}

    def kept(df, label, cut=nb.cut):
        out = cut(df, label)
        written[label] = out.count()
        return out

    for each in (nb, smap, module):
        monkeypatch.setattr(each, "cut", kept)
    monkeypatch.setattr(nb, "LIBRARY_BLOCK", 300)
    monkeypatch.setattr(nb, "TILE", 300, raising=False)
    run = traverse(series(spark, logistic(2000)), parse_lags("x,0,1:x,-1"), SMap((0.0, 1.0), nnn=20))
    assert run.predictions.count() == written["predictions"] == 2 * 1998
    assert max(written.values()) <= 2 * 1998, written
    assert run.neighbours.count() == 20 * 1998


def test_maps_over_tiles_are_those_of_one(spark, monkeypatch):
    values = [round(v + 0.01 * math.sin(7.3 * i * i), 3) for i, v in enumerate(logistic(1500))] + [0.5] * 200
    ts = series(spark, values)
    for map_ in (SMap((0.0, 1.5), nnn=12), SMap((1.0,), nnn=3, xnn=2, center=True, restrict=0.9, arrays=True), SMap((0.5,), nnn=2, warn_is_error=True)):
        got = []
        for tile in (1 << 20, 200):
            monkeypatch.setattr(nb, "TILE", tile)
            monkeypatch.setattr(nb, "BORDER", 4)
            rows = traverse(ts, parse_lags("x,0,1:x,-1;x,-2"), map_).predictions.orderBy("params_id", "target_num", "pre_val_num").collect()
            got.append(rows)
        assert len(got[0]) == len(got[1]) == 1697 * 2 * len(map_.thetas)
        for a, b in zip(*got):
            assert a["status"] == b["status"] and a["rank"] == b["rank"] and a["n_used"] == b["n_used"] == map_.nnn
            assert (a["pre_val"] is None) == (b["pre_val"] is None) and (a["coef"] is None) == (b["coef"] is None)
            assert a["pre_val"] is None or a["pre_val"] == pytest.approx(b["pre_val"], abs=1e-9)


def test_many_solutions_at_once_are_those_of_each():
    rng = np.random.default_rng(1)
    stack = [rng.normal(size=(m, 5)) * scale for m in (1, 2, 3, 4, 9) for scale in (1.0, 1e-12, 1e-20)]
    stack += [np.zeros((4, 5)), np.eye(5), np.diag([1e-9, 1.0, 1.0, 1.0, 1.0]), np.ones((6, 5)), np.repeat(rng.normal(size=(1, 5)), 7, 0)]
    made = [np.linalg.svd(smap.triangles(c))[1:] for c in stack]
    for n in (3, 4):
        got = smap.all_from_singular(np.array([s for s, _ in made]), np.array([vt for _, vt in made]), np.array([len(c) for c in stack]), n)
        for c, (s, vt), x, rank, warning in zip(stack, made, *got):
            want = smap.from_singular(s, vt, len(c), n)
            assert (rank, warning) == want[1:] and np.allclose(x, want[0], rtol=1e-9)
