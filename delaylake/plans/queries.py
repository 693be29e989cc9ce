"""Registered queries of the engine and their SQL.

Series: ``daily`` is the price volume by ship date in thousands; ``panel`` has one system a user,
events in time order, their value x and the code g of their type; ``gappy`` lacks every 17th x.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaylake.functions.rng import mixed_sql
from delaylake.operators.embed import bundles, embed, embedding_meta
from delaylake.operators.log import LogLevel
from delaylake.operators.neighbours import Exclusion, Search, neighbours
from delaylake.operators.simplex import Denominator, Simplex
from delaylake.operators.smap import SMap
from delaylake.operators.split import Bootstrap, Convergent, KFold, LeaveOneOut, UserSplit, library_sizes
from delaylake.plans.spec import EmbeddingDef, parse_lags, parse_ranges
from delaylake.plans.traverse import Run, traverse
from delaylake.sources.series import TimeSeries

KINDS = ("click", "error", "purchase", "signup", "view")
DAILY, SHORT, TWO = "x,0,1,2:x,-1", "x,0,1:x,-1", "x,0,1:x,-1;x,-2"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- series


def _code() -> F.Column:
    code = F.lit(None).cast("int")
    for i, kind in enumerate(KINDS):
        code = F.when(F.col("event_type") == kind, F.lit(i)).otherwise(code)
    return code


def daily(spark: SparkSession, sf_dir: str) -> TimeSeries:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.to_date("l_shipdate").alias("dt"), "l_extendedprice")
    days = lines.groupBy("dt").agg((F.round(F.sum("l_extendedprice"), 2) / 1000.0).alias("x"))
    return TimeSeries.from_dataframe(days, ["x"], order=["dt"])


def panel(spark: SparkSession, sf_dir: str, gaps: bool = False, bundle: bool = False, flags: bool = False) -> TimeSeries:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    x = F.when(F.col("event_id") % 17 == 0, F.lit(None)).otherwise(F.col("value")) if gaps else F.col("value")
    rows = events.select(
        "user_id", F.col("ts").alias("us"), "event_id", x.cast("double").alias("x"), _code().cast("double").alias("g"),
        (F.col("event_id") % 3 != 0).alias("lib"), (F.col("event_id") % 3 == 0).alias("pre"),
    )
    given = {"in_lib": "lib", "in_pre": "pre"} if flags else {}
    data = ["x"] if bundle else ["x", "g"]
    series = TimeSeries.from_dataframe(rows, data, id="user_id", bundle=["g"] if bundle else [], order=["us", "event_id"], **given)
    return series


_DAILY = """s as (select cast(l_shipdate as date) as dt, round(sum(l_extendedprice), 2) / 1000e0 as x from lineitem group by 1),
r as (select row_number() over (order by dt) - 1 as row, null::varchar as id, row_number() over (order by dt) - 1 as t, x, true as lib, true as pre from s)"""


def _panel(gaps: bool = False) -> str:
    code = " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS))
    x = "case when event_id % 17 = 0 then null else value end" if gaps else "value"
    n = "row_number() over (order by cast(user_id as varchar), ts, event_id) - 1"
    return f"""r as (select {n} as row, cast(user_id as varchar) as id, {n} as t, {x} as x,
      (case event_type {code} end)::double as g, event_id % 3 <> 0 as lib, event_id % 3 = 0 as pre from events)"""


def _emb(definition: EmbeddingDef, emb_num: int = 0, extra: str = "") -> str:
    """The embedding of r in SQL: lag and lead over all rows, then the filters."""
    past, future = definition.max_lag, -definition.min_lag

    def at(column: str, lag: int) -> str:
        return column if not lag else f"lag({column}, {lag}) over w" if lag > 0 else f"lead({column}, {-lag}) over w"

    names, parts = {"co": "c", "pre": "p", "addit": "a"}, []
    for role, name in names.items():
        for i, v in enumerate(getattr(definition, role)):
            parts += [f"{at(v.name, v.lag)} as {name}{i}", f"{at('t', v.lag)} as t{name}{i}"]
    needed = " and ".join(f"{names[role]}{i} is not null" for role in ("co", "pre") for i in range(len(getattr(definition, role))))
    whole = f"{at('row', past)} is not null and {at('row', -future)} is not null and {at('id', past)} is not distinct from {at('id', -future)}"
    return f"""(select {emb_num} as emb_num, row_number() over (order by row) - 1 as vec_num, * exclude (whole) from (
      select row, id, lib as use_lib, pre as use_pre, {', '.join(parts)}{extra}, {whole} as whole from r window w as (order by row)) where whole and {needed})"""


def _arrays(vectors: DataFrame, definition: EmbeddingDef, times: bool = False) -> list:
    out = []
    for role, name in (("co", "c"), ("pre", "p"), ("addit", "a")):
        for i in range(len(getattr(definition, role))):
            out.append(vectors[role][i].alias(f"{name}{i}"))
            if times:
                out.append(vectors[f"t_{role}"][i].alias(f"t{name}{i}"))
    return out


# ---------------------------------------------------------------- embedding


def _explicit(text: str, source: str, times: bool = True) -> str:
    d = parse_lags(text)[0]
    columns = [f"{n}{i}" + (f", t{n}{i}" if times else "") for role, n in (("co", "c"), ("pre", "p"), ("addit", "a")) for i in range(len(getattr(d, role)))]
    return f"with {source}, e as {_emb(d)} select vec_num, id, {', '.join(columns)} from e"


def _embedded(series: TimeSeries, text: str, times: bool = True) -> DataFrame:
    d = parse_lags(text)[0]
    vectors = embed(series, [d])
    return vectors.select("vec_num", "id", *_arrays(vectors, d, times))


@query(_explicit(DAILY, _DAILY))
def embed_explicit(spark, sf_dir):
    return _embedded(daily(spark, sf_dir), DAILY)


@query(_explicit("x,0,-1:x,-2", _panel()))
def embed_future(spark, sf_dir):
    return _embedded(panel(spark, sf_dir), "x,0,-1:x,-2")


@query(_explicit("x,0,1;g,0:x,-1;g,-1", _panel()))
def embed_multi(spark, sf_dir):
    return _embedded(panel(spark, sf_dir), "x,0,1;g,0:x,-1;g,-1")


@query(_explicit("x,0,7:x,-5", _panel(), times=False))
def embed_id_boundary(spark, sf_dir):
    return _embedded(panel(spark, sf_dir), "x,0,7:x,-5", times=False)


@query(_explicit("x,0,1:x,-1:g,4;x,6", _panel(gaps=True)))
def embed_addit(spark, sf_dir):
    return _embedded(panel(spark, sf_dir, gaps=True), "x,0,1:x,-1:g,4;x,6")


def _ranged(text: str, source: str) -> str:
    unions = " union all ".join(f"select emb_num, vec_num, {len(d.co)} as e, c0, c{len(d.co) - 1} as last, p0 from {_emb(d, i)}" for i, d in enumerate(parse_ranges(text)))
    return f"with {source} {unions}"


def _ranged_rows(series: TimeSeries, text: str) -> DataFrame:
    vectors = embed(series, parse_ranges(text))
    return vectors.select("emb_num", "vec_num", F.size("co").alias("e"), vectors["co"][0].alias("c0"), F.element_at("co", -1).alias("last"), vectors["pre"][0].alias("p0"))


@query(_ranged("x,0,3,1,shift:x,-1", _DAILY))
def embed_range_shift(spark, sf_dir):
    return _ranged_rows(daily(spark, sf_dir), "x,0,3,1,shift:x,-1")


@query(_ranged("x,0,2,1,trail;g,0,1,1,trail:x,-1", _panel()))
def embed_range_trail(spark, sf_dir):
    return _ranged_rows(panel(spark, sf_dir), "x,0,2,1,trail;g,0,1,1,trail:x,-1")


@query(
    "select * from (values (0, 'x,0:x,-1::', 1, 'C', 0, 'x', 0), (0, 'x,0:x,-1::', 1, 'P', 0, 'x', -1), (1, 'x,0,1:x,-1::', 2, 'C', 0, 'x', 0), "
    "(1, 'x,0,1:x,-1::', 2, 'C', 1, 'x', 1), (1, 'x,0,1:x,-1::', 2, 'P', 0, 'x', -1)) as v(emb_num, emb_label, e, copr, coord, var_name, lag)"
)
def embedding_labels(spark, sf_dir):
    return embedding_meta(daily(spark, sf_dir), parse_ranges("x,0,1,1,trail:x,-1")).select("emb_num", "emb_label", "e", "copr", "coord", "var_name", "lag")


# ---------------------------------------------------------------- bundles

_BUNDLED = f"{_panel()}, e as {_emb(parse_lags(SHORT)[0], extra=', g')}, b as (select *, dense_rank() over (order by g) as bundle_num from e)"


@query(f"with {_BUNDLED} select bundle_num, g, count(*) as n, min(vec_num) as first from b group by all")
def bundle_groups(spark, sf_dir):
    rows = bundles(embed(panel(spark, sf_dir, bundle=True), parse_lags(SHORT)))
    return rows.groupBy("bundle_num", rows["bundle"][0].alias("g")).agg(F.count("*").alias("n"), F.min("vec_num").alias("first"))


@query(f"with {_panel()}, e as {_emb(parse_lags(SHORT)[0], extra=', g')} select dense_rank() over (order by g) as bundle_num, g, vec_num, c0 from e where g in (1, 3)")
def bundle_filter(spark, sf_dir):
    rows = bundles(embed(panel(spark, sf_dir, bundle=True), parse_lags(SHORT)), [1, 3])
    return rows.select("bundle_num", rows["bundle"][0].alias("g"), "vec_num", rows["co"][0].alias("c0"))


# ---------------------------------------------------------------- neighbours


def _square(e: int) -> str:
    return " + ".join(f"(l.c{i} - t.c{i}) * (l.c{i} - t.c{i})" for i in range(e))


def _near(text: str, k: int, where: str = "", library: str = "select * from e") -> str:
    d = parse_lags(text)[0]
    pre = ", ".join(f"l.p{i} as p{i}" for i in range(len(d.pre)))
    return f"""e as {_emb(d)}, l as ({library}),
    k as (select t.vec_num as target_num, l.vec_num as num, {_square(len(d.co))} as sqdst, {pre} from e t join l on l.vec_num <> t.vec_num {where}),
    n as (select *, row_number() over (partition by target_num order by sqdst, num) as rank from k qualify rank <= {k})"""


def _neighbours(series: TimeSeries, text: str, k: int, search: Search = Search(), split=LeaveOneOut()) -> DataFrame:
    vectors = bundles(embed(series, parse_lags(text)))
    return neighbours(split.split(vectors), vectors, {0: k}, search).select("target_num", "seq", "num", "sqdst")


_NEAR_OUT = "select target_num, count(*) over (partition by target_num) - rank + 1 as seq, num, sqdst from n"


@query(f"with {_DAILY}, {_near(DAILY, 4)} {_NEAR_OUT}")
def knn(spark, sf_dir):
    return _neighbours(daily(spark, sf_dir), DAILY, 4)


_SHARED = "and not list_has_any([t.tc0, t.tc1, t.tc2], [l.tc0, l.tc1, l.tc2])"


@query(f"with {_DAILY}, {_near(DAILY, 4, _SHARED)} {_NEAR_OUT}")
def knn_excl_coord(spark, sf_dir):
    return _neighbours(daily(spark, sf_dir), DAILY, 4, Search(Exclusion.TIME_COORD))


@query(f"with {_DAILY}, {_near(DAILY, 4, 'and abs(t.tc0 - l.tc0) >= 30')} {_NEAR_OUT}")
def knn_excl_window(spark, sf_dir):
    return _neighbours(daily(spark, sf_dir), DAILY, 4, Search(Exclusion.TIME_WINDOW, 30))


_DRAWN = f"select e.* from (select distinct {mixed_sql('i', '0')} % n as pos from (select unnest(range(0, n)) as i, n from (select count(*) as n from e))) join e on vec_num = pos"


@query(f"with {_DAILY}, {_near(DAILY, 4, library=_DRAWN)} {_NEAR_OUT}")
def knn_once(spark, sf_dir):
    return _neighbours(daily(spark, sf_dir), DAILY, 4, Search(once=True), Bootstrap(1))


# ---------------------------------------------------------------- simplex


def _simplex(text: str, denominator: str, k: int, exp_k: float = 1.0, where: str = "") -> str:
    d = parse_lags(text)[0]
    outputs = " union all ".join(f"select target_num, {i} as pre_val_num, sum(w * p{i}) / nullif(sum(w), 0) as pre_val from w group by target_num" for i in range(len(d.pre)))
    observed = " union all ".join(f"select vec_num as target_num, {i} as pre_val_num, p{i} as obs_val from e" for i in range(len(d.pre)))
    lib = " + ".join(f"var_pop(c{i})" for i in range(len(d.co)))
    return f"""{_near(text, k, where)}, lib as (select sqrt(2 * count(*) / (count(*) - 1e0) * ({lib})) as rms from e),
    d as (select n.*, sqrt(sqdst) as d, {denominator} as den, count(*) over (partition by target_num) as found from n),
    w as (select *, case when den < 1e-200 then 1 else exp(-{exp_k!r}e0 * d / den) end as w from d where found = {k}),
    q as ({outputs}), o as ({observed}),
    pairs as (select o.target_num, o.pre_val_num, pre_val, obs_val from o left join q on o.target_num = q.target_num and o.pre_val_num = q.pre_val_num)"""


_OVER = "over (partition by target_num)"
_DENOMINATORS = {
    "min": f"coalesce(min(case when sqdst > 0 then sqrt(sqdst) end) {_OVER}, 0)",
    "avg_nn": f"avg(sqrt(sqdst)) {_OVER}",
    "avg_lib": "(select rms from lib)",
    "max": f"min(sqrt(sqdst)) {_OVER}",
}
_PAIRS = "select target_num, pre_val_num, round(pre_val, 5) as pre_val, round(obs_val, 5) as obs_val from pairs"


def _pairs(run: Run) -> DataFrame:
    return run.predictions.select("target_num", "pre_val_num", F.round("pre_val", 5).alias("pre_val"), F.round("obs_val", 5).alias("obs_val"))


def _daily_run(spark, sf_dir, predictor, text: str = DAILY, split=LeaveOneOut()) -> Run:
    return traverse(daily(spark, sf_dir), parse_lags(text), predictor, split)


@query(f"with {_DAILY}, {_simplex(DAILY, _DENOMINATORS['min'], 4)} {_PAIRS}")
def simplex_min(spark, sf_dir):
    return _pairs(_daily_run(spark, sf_dir, Simplex(1, Denominator.MINIMUM)))


@query(f"with {_DAILY}, {_simplex(DAILY, _DENOMINATORS['avg_nn'], 4)} {_PAIRS}")
def simplex_avg_nn(spark, sf_dir):
    return _pairs(_daily_run(spark, sf_dir, Simplex(1, Denominator.AVG_NN)))


@query(f"with {_DAILY}, {_simplex(DAILY, _DENOMINATORS['avg_lib'], 4)} {_PAIRS}")
def simplex_avg_lib(spark, sf_dir):
    return _pairs(_daily_run(spark, sf_dir, Simplex(1, Denominator.AVG_LIB)))


@query(f"with {_DAILY}, {_simplex(DAILY, _DENOMINATORS['max'], 4)} {_PAIRS}")
def simplex_max(spark, sf_dir):
    return _pairs(_daily_run(spark, sf_dir, Simplex(1, Denominator.MAXIMUM)))


@query(f"with {_DAILY}, {_simplex(TWO, _DENOMINATORS['avg_nn'], 5, 2.0)} {_PAIRS}")
def simplex_multi_out(spark, sf_dir):
    return _pairs(_daily_run(spark, sf_dir, Simplex(3, Denominator.AVG_NN, 2.0), TWO))


# ---------------------------------------------------------------- splits


def _members(sets) -> DataFrame:
    parts = [m.select(F.lit(code).alias("set_code"), "set_num", "vec_idx", "vec_num") for code, m in (("L", sets.library), ("P", sets.prediction))]
    return parts[0].unionByName(parts[1])


def _split(spark, sf_dir, split) -> DataFrame:
    return _members(split.split(bundles(embed(daily(spark, sf_dir), parse_lags(SHORT)))))


_E = f"e as {_emb(parse_lags(SHORT)[0])}, z as (select count(*) as n from e)"


@query(
    f"with {_panel()}, e as {_emb(parse_lags(SHORT)[0])} select 'L' as set_code, 0 as set_num, row_number() over (order by vec_num) - 1 as vec_idx, vec_num from e where use_lib "
    "union all select 'P', 0, row_number() over (order by vec_num) - 1, vec_num from e where use_pre"
)
def split_user(spark, sf_dir):
    return _members(UserSplit().split(bundles(embed(panel(spark, sf_dir, flags=True), parse_lags(SHORT)))))


@query(f"with {_DAILY}, {_E} select c as set_code, 0 as set_num, vec_num as vec_idx, vec_num from e, (values ('L'), ('P')) as v(c)")
def split_looc(spark, sf_dir):
    return _split(spark, sf_dir, LeaveOneOut())


@query(
    f"""with {_DAILY}, {_E},
    m as (select vec_num, rep, row_number() over (partition by rep order by {mixed_sql('vec_num', 'rep')}, vec_num) - 1 as pos from e, (values (0), (1)) as v(rep)),
    f as (select m.*, n, k, rep * 5 + k as set_num, floor(k / 5e0 * n)::bigint as lo, floor((k + 1) / 5e0 * n)::bigint as hi from m, z, (values (0), (1), (2), (3), (4)) as v(k)),
    g as (select *, (pos - hi - 1 + 2 * n) % n as place from f)
    select 'L' as set_code, set_num, place as vec_idx, vec_num from g where place < n - (hi - lo)
    union all select 'P', set_num, pos - lo, vec_num from g where pos >= lo and pos < hi"""
)
def split_kfold(spark, sf_dir):
    return _split(spark, sf_dir, KFold(5, 2))


def _windows(order: str, sizes: str, shift: int) -> str:
    return f"""m as (select vec_num, {order} as pos from e),
    v as (select *, row_number() over (order by size, sh) - 1 as set_num from (select size, unnest(range(0, n, {shift})) as sh, n from z, (values {sizes}) as w(size))),
    g as (select set_num, size, (pos - sh + n) % n as place, vec_num, n from m, v)
    select 'L' as set_code, set_num, place as vec_idx, vec_num from g where place < size
    union all select 'P', set_num, vec_num, vec_num from e, v"""


@query(f"with {_DAILY}, {_E}, {_windows('vec_num', '(50), (100), (130)', 500)}")
def split_shift(spark, sf_dir):
    return _split(spark, sf_dir, Convergent(50, 130, 50, 0.0, "shift", 500))


_RANDOM = f"row_number() over (order by {mixed_sql('vec_num', '1')}, vec_num) - 1"


@query(f"with {_DAILY}, {_E}, {_windows(_RANDOM, '(50), (100), (130)', 500)}")
def split_random(spark, sf_dir):
    return _split(spark, sf_dir, Convergent(50, 130, 50, 0.0, "random", 500))


@query(
    f"""with {_DAILY}, {_E}, v as (select unnest(range(0, 3)) as set_num),
    d as (select set_num, i as vec_idx, {mixed_sql('i', 'set_num')} % n as pos from (select set_num, unnest(range(0, 200)) as i, n from v, z))
    select 'L' as set_code, set_num, vec_idx, vec_num from d join e on e.vec_num = d.pos
    union all select 'P', set_num, vec_num, vec_num from e, v"""
)
def split_bootstrap(spark, sf_dir):
    return _split(spark, sf_dir, Bootstrap(3, 200))


@query(
    f"""with {_DAILY}, {_E}, v as (select unnest([40, 40, 60, 60]) as size, unnest([0, 1, 2, 3]) as set_num),
    m as (select set_num, size, vec_num, row_number() over (partition by set_num order by {mixed_sql('vec_num', 'set_num')}, vec_num) - 1 as pos from e, v)
    select 'L' as set_code, set_num, pos as vec_idx, vec_num from m where pos < size
    union all select 'P', set_num, vec_num, vec_num from e, v"""
)
def split_boot_permut(spark, sf_dir):
    return _split(spark, sf_dir, Convergent(40, 60, 20, 0.0, "boot_permut", n_bootstrap=2))


@query(
    f"""with {_DAILY}, {_E}, v as (select unnest([30, 45, 60]) as size, unnest([0, 1, 2]) as set_num),
    d as (select set_num, i as vec_idx, {mixed_sql('i', 'set_num')} % n as pos from (select set_num, unnest(range(0, size)) as i, n from v, z))
    select 'L' as set_code, set_num, vec_idx, vec_num from d join e on e.vec_num = d.pos
    union all select 'P', set_num, vec_num, vec_num from e, v"""
)
def split_convergent_bootstrap(spark, sf_dir):
    return _split(spark, sf_dir, Convergent(30, 60, 15, 0.0, "bootstrap"))


_STRATA = "x,0,1:x,-1:g,0"


@query(
    f"""with {_panel()}, e as {_emb(parse_lags(_STRATA)[0])},
    m as (select vec_num, a0, row_number() over (partition by a0 order by vec_num) - 1 as inside, count(*) over (partition by a0) as n from e),
    d as (select set_num, vec_num as vec_idx, a0, {mixed_sql('vec_num', 'set_num')} % n as pos from m, (values (0), (1)) as v(set_num))
    select 'L' as set_code, set_num, vec_idx, m.vec_num from d join m on m.a0 = d.a0 and m.inside = d.pos
    union all select 'P', set_num, vec_num, vec_num from m, (values (0), (1)) as v(set_num)"""
)
def bootstrap_strat(spark, sf_dir):
    return _members(Bootstrap(2, per_addit_group=True).split(bundles(embed(panel(spark, sf_dir), parse_lags(_STRATA)))))


@query("select * from (values (0, 10), (1, 20), (2, 35), (3, 57), (4, 90), (5, 140), (6, 200)) as v(step, lib_size)")
def lib_schedule(spark, sf_dir):
    return spark.createDataFrame([*enumerate(library_sizes(10, 200, 10, 0.5, 1000))], "step int, lib_size int")


# ---------------------------------------------------------------- statistics


def _moments(keys: str, source: str) -> str:
    by = f"group by {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    return f"""select {head}count(*) as n_pre_obs, round(avg(pre_val), 4) as avg_pre, round(avg(obs_val), 4) as avg_obs, round(var_pop(pre_val), 4) as var_pre,
      round(var_pop(obs_val), 4) as var_obs, round(covar_pop(pre_val, obs_val), 4) as cov_pre_obs, round(avg(abs(pre_val - obs_val)), 4) as mae_pre_obs,
      round(sqrt(avg((pre_val - obs_val) * (pre_val - obs_val))), 4) as rmse_pre_obs, round(median(pre_val), 4) as md_pre, round(median(obs_val), 4) as md_obs,
      round(mad(pre_val), 4) as mdad_pre, round(mad(obs_val), 4) as mdad_obs, round(median(abs(pre_val - obs_val)), 4) as mdae_pre_obs
      from {source} {by}"""


def _rounded(stats: DataFrame, *keys) -> DataFrame:
    fields = [c for c in stats.columns if c.split("_")[0] in ("avg", "var", "cov", "mae", "rmse", "md", "mdad", "mdae")]
    return stats.select(*keys, "n_pre_obs", *[F.round(f, 4).alias(f) for f in fields])


_FULL = "(select * from pairs where pre_val is not null and obs_val is not null)"


@query(f"with {_DAILY}, {_simplex(DAILY, _DENOMINATORS['avg_nn'], 4)} {_moments('', _FULL)}")
def stats_overall(spark, sf_dir):
    return _rounded(_daily_run(spark, sf_dir, Simplex()).stats())


_GROUPED = "x,0,1:x,-1:g,0"
_IN_G = "and t.use_pre and l.use_lib"


@query(
    f"""with {_panel()}, {_simplex(_GROUPED, _DENOMINATORS['avg_nn'], 3, where=_IN_G)},
    f as (select p.*, a0 from pairs p join e on e.vec_num = p.target_num where e.use_pre and pre_val is not null)
    select false as grouped, null::double as a0, * from ({_moments('', 'f')})
    union all select true, * from ({_moments('a0', 'f')})"""
)
def stats_per_addit(spark, sf_dir):
    run = traverse(panel(spark, sf_dir, flags=True), parse_lags(_GROUPED), Simplex(), UserSplit())
    stats = run.stats(per_additional=True)
    return _rounded(stats, "grouped", F.get("addit", F.lit(0)).alias("a0"))


_CURVE_SETS = "v as (select *, row_number() over (order by size, sh) - 1 as set_num from (select size, unnest(range(0, n, 800)) as sh from z, (values (40), (80), (120)) as w(size)))"


@query(
    f"""with {_DAILY}, {_E}, {_CURVE_SETS},
    l as (select set_num, size, e.* from e, v, z where (vec_num - sh + n) % n < size),
    k as (select l.set_num, l.size, t.vec_num as target_num, l.vec_num as num, {_square(2)} as sqdst, l.p0 from e t join l on l.vec_num <> t.vec_num),
    n as (select *, row_number() over (partition by set_num, target_num order by sqdst, num) as rank from k qualify rank <= 3),
    d as (select *, sqrt(sqdst) as d, avg(sqrt(sqdst)) over (partition by set_num, target_num) as den from n),
    w as (select *, case when den < 1e-200 then 1 else exp(-d / den) end as w from d),
    q as (select set_num, size, target_num, sum(w * p0) / sum(w) as pre_val from w group by all),
    pairs as (select q.*, e.p0 as obs_val from q join e on e.vec_num = q.target_num)
    select set_num + 1 as set_num, size as lib_size, count(*) as n_pre_obs, round(avg(abs(pre_val - obs_val)), 4) as mae_pre_obs,
           round(covar_pop(pre_val, obs_val) / sqrt(var_pop(pre_val) * var_pop(obs_val)), 4) as rho from pairs group by set_num, size"""
)
def ccm_curve(spark, sf_dir):
    run = _daily_run(spark, sf_dir, Simplex(), SHORT, Convergent(40, 120, 40, 0.0, "shift", 800))
    return run.stats().select("set_num", F.col("lib_set_n_point").alias("lib_size"), "n_pre_obs", F.round("mae_pre_obs", 4).alias("mae_pre_obs"), F.round("rho", 4).alias("rho"))


# ---------------------------------------------------------------- log


@query(f"with {_DAILY}, {_E} select 'P' as set_code, 1 as set_num, count(*) as n_point from e")
def log_members(spark, sf_dir):
    run = _daily_run(spark, sf_dir, Simplex(), SHORT)
    rows = run.log_table(["sh_set_code", "sh_n_point"], "SH", LogLevel.EMB_PAR | LogLevel.PRE_SET)
    return rows.select(F.col("sh_set_code").alias("set_code"), F.lit(1).alias("set_num"), F.col("sh_n_point").cast("long").alias("n_point"))


_LOGGED = "select target_num, pre_val_num, round(pre_val, 5) as pre_val, round(obs_val, 5) as obs_val"


@query(f"with {_DAILY}, {_simplex(TWO, _DENOMINATORS['avg_nn'], 3)} {_LOGGED}, 0 as emb_num from pairs")
def log_forward_fill(spark, sf_dir):
    run = _daily_run(spark, sf_dir, Simplex(), TWO)
    rows = run.log_table(["embpar1_emb_num", "tg2_target_num", "pd_pre_val_num", "pd_pre_val", "pd_obs_val"], "PD", LogLevel.EMB_PAR | LogLevel.PREDICTED)
    value = lambda f: F.round(F.col(f).cast("double"), 5)
    return rows.select(
        F.col("tg2_target_num").cast("long").alias("target_num"), F.col("pd_pre_val_num").cast("int").alias("pre_val_num"),
        value("pd_pre_val").alias("pre_val"), value("pd_obs_val").alias("obs_val"), F.col("embpar1_emb_num").cast("int").alias("emb_num"),
    )


@query(
    f"""with {_panel()}, e as {_emb(parse_lags(SHORT)[0], extra=', g')}
    select vec_num, 'C' as copr, 0 as idx, tc0 as t, c0 as val from e union all select vec_num, 'C', 1, tc1, c1 from e
    union all select vec_num, 'P', 0, tp0, p0 from e union all select vec_num, 'B', 0, 0, g from e"""
)
def log_vectors(spark, sf_dir):
    run = traverse(panel(spark, sf_dir, bundle=True), parse_lags(SHORT), Simplex())
    return run.tables(LogLevel.EMB_VEC)["VAL"].select("vec_num", "copr", "idx", "t", "val")


@query(f"with {_BUNDLED} select distinct bundle_num, 0 as vec_idx, g as vec_val from b")
def log_bundles(spark, sf_dir):
    run = traverse(panel(spark, sf_dir, bundle=True), parse_lags(SHORT), Simplex())
    return run.tables(LogLevel.BUNDLE_PAR)["BV"].select("bundle_num", "vec_idx", "vec_val")


@query(f"with {_DAILY}, {_near(SHORT, 3)} {_NEAR_OUT}")
def log_neighbours(spark, sf_dir):
    return _daily_run(spark, sf_dir, Simplex(), SHORT).tables(LogLevel.NEAR_NEIGH)["NN"].select("target_num", "seq", "num", "sqdst")


@query(f"with {_DAILY}, {_simplex(SHORT, _DENOMINATORS['avg_nn'], 3)} {_LOGGED}, 0 as status from pairs")
def log_predicted(spark, sf_dir):
    run = _daily_run(spark, sf_dir, Simplex(), SHORT)
    return run.predictions.select("target_num", "pre_val_num", F.round("pre_val", 5).alias("pre_val"), F.round("obs_val", 5).alias("obs_val"), "status")


# ---------------------------------------------------------------- S-maps


def _map(spark, sf_dir, predictor, text: str = SHORT) -> Run:
    return _daily_run(spark, sf_dir, predictor, text)


def _tls(run: Run) -> DataFrame:
    return run.predictions.select("params_id", "target_num", "pre_val_num", F.round("pre_val", 3).alias("pre_val"), F.round("obs_val", 3).alias("obs_val"), "status", "rank")


@query()
def tls_theta(spark, sf_dir):
    run = _map(spark, sf_dir, SMap(SMap.sweep(0.0, 2.0, 0.5)))
    return run.stats().select("params_id", "theta", "n_pre_obs", F.round("mae_pre_obs", 3).alias("mae_pre_obs"), F.round("rho", 4).alias("rho"))


@query()
def tls_knn(spark, sf_dir):
    return _tls(_map(spark, sf_dir, SMap((0.0, 1.0), nnn=20)))


@query()
def tls_center(spark, sf_dir):
    return _tls(_map(spark, sf_dir, SMap((0.5,), center=True)))


@query()
def tls_xnn(spark, sf_dir):
    return _tls(_map(spark, sf_dir, SMap((1.0,), xnn=5)))


@query()
def tls_status(spark, sf_dir):
    run = _map(spark, sf_dir, SMap((0.0, 4.0), nnn=2, restrict=1e4))
    return run.predictions.groupBy("params_id", "status").agg(F.count("*").alias("n"))


@query()
def tls_knn_panel(spark, sf_dir):
    return _tls(traverse(panel(spark, sf_dir), parse_lags(SHORT), SMap((0.0, 1.0), nnn=20)))


@query()
def tls_status_panel(spark, sf_dir):
    run = traverse(panel(spark, sf_dir), parse_lags(SHORT), SMap((0.0, 4.0), nnn=2, restrict=1e4))
    return run.predictions.groupBy("params_id", "status").agg(F.count("*").alias("n"))


@query()
def tls_coefficients(spark, sf_dir):
    run = _map(spark, sf_dir, SMap((0.0,)))
    return run.predictions.select("target_num", "pre_val_num", F.posexplode("coef").alias("var_coord", "var_val"))
