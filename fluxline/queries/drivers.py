"""Queries on lagged drivers: moments, discovery, scoring, attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxline.operators.grid import lagged
from fluxline.plans import causal
from fluxline.queries.catalog import EVENTS_SQL, events, query, rounded
from fluxline.queries.temporal import features, features_sql
from fluxline.session import stored

TERMS = [("kp", 1)]
WIDE_TERMS = [("bz_min", 1), ("bt_max", 1), ("kp", 1), ("kp", 2)]


@query("feature_gaps", features_sql() + """
SELECT count(*) AS "rows", min(timestamp) AS t0, max(timestamp) AS t1,
  count(*) FILTER (WHERE bz_min IS NULL) AS missing_bz_min,
  count(*) FILTER (WHERE sw_speed_mean IS NULL) AS missing_sw_speed_mean,
  count(*) FILTER (WHERE kp IS NULL) AS missing_kp FROM f""")
def feature_gaps(spark, sf_dir):
    return causal.missing_counts(features(spark, sf_dir), ["bz_min", "sw_speed_mean", "kp"])


@query("lag_correlations", features_sql() + """
, w AS (SELECT bz_min, bt_max, kp, lag(bz_min, 1) OVER o AS bz1, lag(bz_min, 3) OVER o AS bz3,
  lag(bt_max, 2) OVER o AS bt2, lag(kp, 1) OVER o AS kp1 FROM f WINDOW o AS (ORDER BY timestamp))
SELECT round(corr(bz1, kp), 6) AS bz1_kp, round(corr(bz3, kp), 6) AS bz3_kp,
  round(corr(bt2, kp), 6) AS bt2_kp, round(corr(kp1, kp), 6) AS kp1_kp,
  round(corr(kp1, bz_min), 6) AS kp1_bz FROM w""")
def lag_correlations(spark, sf_dir):
    grid = features(spark, sf_dir).select("timestamp", "bz_min", "bt_max", "kp")
    wide = lagged(grid, "timestamp", ["bz_min", "bt_max", "kp"], [0, 1, 2, 3], 3600)
    pairs = {"bz1_kp": ("bz_min__1", "kp__0"), "bz3_kp": ("bz_min__3", "kp__0"),
             "bt2_kp": ("bt_max__2", "kp__0"), "kp1_kp": ("kp__1", "kp__0"),
             "kp1_bz": ("kp__1", "bz_min__0")}
    return rounded(wide.agg(*[F.corr(a, b).alias(n) for n, (a, b) in pairs.items()]), *pairs)


@query("driver_discovery")
def driver_discovery(spark, sf_dir):
    matrix = stored(features(spark, sf_dir, "minute"), "features")
    return causal.discover(matrix, ["bz_min", "bt_max", "kp"],
                           step_seconds=60, tau_max=3, missing="pairwise")


_PAIRS = [(s, t, k) for s, t in (("bz_min", "kp"), ("bt_max", "kp"), ("kp", "bz_min"),
                                 ("kp", "bt_max"), ("sw_speed_mean", "kp")) for k in (1, 2, 3)]


PAIR_NAMES = ("bz_min", "bt_max", "kp", "sw_speed_mean")


def _pair_edges(spark, sf_dir) -> DataFrame:
    return pair_edges(features(spark, sf_dir))


def pair_edges(matrix: DataFrame) -> DataFrame:
    """Lagged correlations of at least 0.02 as edges."""
    grid = matrix.select("timestamp", *PAIR_NAMES)
    wide = lagged(grid, "timestamp", PAIR_NAMES, [0, 1, 2, 3], 3600)
    one = wide.agg(*[F.corr(f"{s}__{k}", f"{t}__0").alias(f"{s}__{t}__{k}") for s, t, k in _PAIRS])
    rows = F.array(*[F.struct(
        F.lit(s).alias("source"), F.lit(t).alias("target"), F.lit(k).alias("lag"),
        F.col(f"{s}__{t}__{k}").alias("strength"), F.lit(0.0).alias("p_value")) for s, t, k in _PAIRS])
    return one.select(F.inline(rows)).filter(F.abs("strength") >= 0.02)


_EDGES = features_sql() + ", edges AS (" + " UNION ALL ".join(
    f"SELECT '{s}' AS source, '{t}' AS target, {k} AS lag, corr(x, {t}) AS strength FROM "
    f"(SELECT {t}, lag({s}, {k}) OVER (ORDER BY timestamp) AS x FROM f)" for s, t, k in _PAIRS) + ")"


@query("lag_edges", _EDGES + """
SELECT source, target, lag, round(strength, 6) AS strength FROM edges WHERE abs(strength) >= 0.02""")
def lag_edges(spark, sf_dir):
    return rounded(_pair_edges(spark, sf_dir).select("source", "target", "lag", "strength"), "strength")


def _variables(spark):
    return spark.createDataFrame([(v,) for v in ("bz_min", "bt_max", "kp", "sw_speed_mean")], "variable string")


@query("link_scorecard", _EDGES + """
, e AS (SELECT * FROM edges WHERE abs(strength) >= 0.02),
x AS (SELECT count(*) FILTER (WHERE source = 'bz_min' AND target = 'kp') > 0 AS gate,
  (count(*) FILTER (WHERE source = 'bt_max' AND target = 'kp') > 0)::BIGINT
    + (count(*) FILTER (WHERE source = 'sw_speed_mean' AND target = 'kp') > 0)::BIGINT AS soft_found,
  count(*) FILTER (WHERE source = 'kp') AS violations FROM e)
SELECT CAST(1 AS BIGINT) AS gating_total, gate::BIGINT AS gating_found, CAST(2 AS BIGINT) AS soft_total,
  soft_found, violations, gate::DOUBLE AS gating_recall, (gate AND violations = 0) AS passed FROM x""")
def link_scorecard(spark, sf_dir):
    v = _variables(spark)
    return causal.scorecard(
        causal.links_among(causal.expected_links(spark), v),
        causal.links_among(causal.forbidden_links(spark), v),
        _pair_edges(spark, sf_dir))


@query("link_matches", _EDGES + """
SELECT l.source, l.target, l.gating, coalesce(string_agg(e.lag::VARCHAR, ',' ORDER BY e.lag), '') AS lags
FROM (VALUES ('bz_min', 'kp', true), ('bt_max', 'kp', false), ('sw_speed_mean', 'kp', false)) l(source, target, gating)
LEFT JOIN (SELECT * FROM edges WHERE abs(strength) >= 0.02) e ON l.source = e.source AND l.target = e.target
GROUP BY ALL""")
def link_matches(spark, sf_dir):
    links = causal.links_among(causal.expected_links(spark), _variables(spark))
    out = causal.match_links(links, _pair_edges(spark, sf_dir))
    return out.select("source", "target", "gating",
                      F.array_join(F.transform("lags", lambda x: x.cast("string")), ",").alias("lags"))


_LINE = features_sql() + """
, w AS (SELECT timestamp, kp AS y, lag(kp, 1) OVER (ORDER BY timestamp) AS x FROM f),
line AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, regr_count(y, x) AS n FROM w)"""


@query("model_fit", _LINE + """
SELECT 'kp' AS var, CAST(1 AS INTEGER) AS lag, round(b, 6) AS coef, round(a, 6) AS intercept,
  round(r2, 6) AS r2, CAST(n AS BIGINT) AS n FROM line""")
def model_fit(spark, sf_dir):
    model = causal.fit(stored(features(spark, sf_dir), "features"), TERMS)
    out = model.table(spark).select(
        "var", "lag", "coef", F.lit(model.intercept).alias("intercept"), F.lit(model.r2).alias("r2"),
        F.lit(model.n).cast("bigint").alias("n"))
    return rounded(out, "coef", "intercept", "r2")


@query("attribution", _LINE + """
SELECT timestamp, y AS observed, round(a + coalesce(b * x, 0), 6) AS predicted, 'kp' AS var,
  CAST(1 AS INTEGER) AS lag, x AS value, round(b * x, 6) AS contribution FROM w, line""")
def attribution(spark, sf_dir):
    f = stored(features(spark, sf_dir), "features")
    out = causal.attribute(f, causal.fit(f, TERMS)).drop("coef")
    return rounded(out, "predicted", "contribution")


def _solved_sql(terms) -> str:
    """Least squares by elimination over moment sums: ``coefs`` with one row, the
    coefficients b1.., the intercept and r2."""
    k = len(terms)
    columns = ", ".join(f"lag({v}, {lag}) OVER o AS x{i}" for i, (v, lag) in enumerate(terms, 1))
    known = " AND ".join(f"x{i} IS NOT NULL" for i in range(k + 1))
    pairs = [(i, j) for i in range(1, k + 1) for j in [*range(i, k + 1), 0]]
    first = ", ".join(f"covar_pop(x{i}, x{j}) AS c{i}_{j}" for i, j in pairs)
    means = ", ".join(f"avg(x{i}) AS m{i}" for i in range(k + 1))
    sql = f""", wide AS (SELECT timestamp, kp AS x0, {columns} FROM f WINDOW o AS (ORDER BY timestamp)),
whole AS (SELECT * FROM wide WHERE {known}),
e1 AS (SELECT {first}, {means}, var_pop(x0) AS c0_0 FROM whole)"""
    for p in range(1, k):
        rest = ", ".join(f"c{i}_{j} - c{p}_{i} * c{p}_{j} / c{p}_{p} AS c{i}_{j}" for i, j in pairs if i > p)
        sql += f",\ne{p + 1} AS (SELECT * REPLACE ({rest}) FROM e{p})"
    sql += f",\ns{k + 1} AS (SELECT * FROM e{k})"
    for i in range(k, 0, -1):
        above = "".join(f" - c{i}_{j} * b{j}" for j in range(i + 1, k + 1))
        sql += f",\ns{i} AS (SELECT *, (c{i}_0{above}) / c{i}_{i} AS b{i} FROM s{i + 1})"
    fitted = " - ".join(["m0", *[f"b{i} * m{i}" for i in range(1, k + 1)]])
    products = " + ".join(f"b{i} * o.c{i}_0" for i in range(1, k + 1))
    names = ", ".join(f"s1.b{i}" for i in range(1, k + 1))
    return sql + f""",
coefs AS (SELECT {names}, {fitted} AS a, ({products}) / o.c0_0 AS r2 FROM s1, (SELECT {", ".join(
    f"c{i}_0" for i in range(k + 1))} FROM e1) o)"""


@query("model_fit_wide", features_sql() + _solved_sql(WIDE_TERMS) + " UNION ALL ".join(
    f"\nSELECT '{v}' AS var, CAST({k} AS INTEGER) AS lag, round(b{i}, 6) AS coef, round(r2, 6) AS r2 FROM coefs"
    for i, (v, k) in enumerate(WIDE_TERMS, 1)))
def model_fit_wide(spark, sf_dir):
    model = causal.fit(stored(features(spark, sf_dir), "features"), WIDE_TERMS)
    return rounded(model.table(spark).select(
        "var", "lag", "coef", F.lit(model.r2).alias("r2")), "coef", "r2")


@query("moving_fit", features_sql() + """
, w AS (SELECT CAST(timestamp AS DATE) AS day, kp AS y, lag(kp, 1) OVER (ORDER BY timestamp) AS x FROM f),
c AS (SELECT * FROM w WHERE x IS NOT NULL AND y IS NOT NULL), d AS (SELECT DISTINCT day FROM c)
SELECT CAST(d.day AS VARCHAR) AS day, 'kp' AS var, CAST(1 AS INTEGER) AS lag, round(regr_slope(y, x), 6) AS coef,
  round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2, count(*) AS n
FROM d JOIN c ON c.day BETWEEN d.day - 6 AND d.day GROUP BY d.day HAVING count(*) >= 3""")
def moving_fit(spark, sf_dir):
    """Persistence fitted anew for every day from the week up to it."""
    out = causal.moving_fits(features(spark, sf_dir), TERMS, 7)
    return rounded(out.withColumn("day", F.col("day").cast("string")), "coef", "intercept", "r2")


@query("model_fit_two", features_sql() + """
, w AS (SELECT kp AS y, lag(kp, 1) OVER o AS a, lag(kp, 2) OVER o AS b FROM f WINDOW o AS (ORDER BY timestamp)),
c AS (SELECT * FROM w WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
s AS (SELECT var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay,
  covar_pop(b, y) AS bz, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, count(*) AS n FROM c),
q AS (SELECT *, (ay * vb - bz * ab) / (va * vb - ab * ab) AS ca, (bz * va - ay * ab) / (va * vb - ab * ab) AS cb FROM s)
SELECT 'kp' AS var, CAST(1 AS INTEGER) AS lag, round(ca, 6) AS coef, round(my - ca * ma - cb * mb, 6) AS intercept, n FROM q
UNION ALL SELECT 'kp', 2, round(cb, 6), round(my - ca * ma - cb * mb, 6), n FROM q""")
def model_fit_two(spark, sf_dir):
    model = causal.fit(stored(features(spark, sf_dir), "features"), [("kp", 1), ("kp", 2)])
    return rounded(model.table(spark).select(
        "var", "lag", "coef", F.lit(model.intercept).alias("intercept"),
        F.lit(model.n).cast("bigint").alias("n")), "coef", "intercept")


@query("top_events", _LINE + """
SELECT timestamp, y AS observed, round(a + coalesce(b * x, 0), 6) AS predicted,
  round(coalesce(b * x, 0), 6) AS persistence, round(a, 6) AS baseline FROM w, line
ORDER BY y DESC NULLS LAST, timestamp LIMIT 5""")
def top_events(spark, sf_dir):
    f = stored(features(spark, sf_dir), "features")
    out = causal.explain_top(f, causal.fit(f, TERMS), 5)
    return rounded(out.select("timestamp", "observed", "predicted", "persistence", "baseline"),
                   "predicted", "persistence", "baseline")


def _drivers_sql() -> str:
    terms = list(enumerate(WIDE_TERMS, 1))
    predicted = " + ".join(["a", *[f"coalesce(b{i} * x{i}, 0)" for i, _ in terms]])
    own = " + ".join(["0", *[f"coalesce(b{i} * x{i}, 0)" for i, (v, _) in terms if v == "kp"]])
    others = ", ".join(f"{{'var': '{v}', 'lag': CAST({k} AS INTEGER), 'value': x{i}, 'part': b{i} * x{i}, 'at': {i}}}"
                       for i, (v, k) in terms if v != "kp")
    return f"""
, top AS (SELECT timestamp, x0 AS observed, {predicted} AS predicted, {own} AS persistence, a AS baseline,
  list_filter([{others}], lambda c: c.part IS NOT NULL) AS parts FROM wide, coefs
  ORDER BY x0 DESC NULLS LAST, timestamp LIMIT 5),
best AS (SELECT *, list_reduce(parts, lambda m, c: CASE WHEN abs(c.part) > abs(m.part) THEN c ELSE m END) AS p
  FROM top WHERE len(parts) > 0 UNION ALL SELECT *, NULL FROM top WHERE len(parts) = 0)
SELECT timestamp, observed, round(predicted, 6) AS predicted, p.var AS primary_cause, p.lag AS primary_lag,
  p.value AS primary_value, round(p.part, 6) AS primary_contribution, round(persistence, 6) AS persistence,
  round(baseline, 6) AS baseline FROM best"""


@query("top_event_drivers", features_sql() + _solved_sql(WIDE_TERMS) + _drivers_sql())
def top_event_drivers(spark, sf_dir):
    f = stored(features(spark, sf_dir), "features")
    out = causal.explain_top(f, causal.fit(f, WIDE_TERMS), 5).drop("drivers")
    return rounded(out, "predicted", "primary_contribution", "persistence", "baseline")


# -- graphs --------------------------------------------------------------------

_GRAPH = f"""(SELECT 'v' || (user_id % 4) AS source, 'v' || (k % 3) AS target, CAST(1 + k % 5 AS INTEGER) AS lag,
  count(*) / 1000.0::DOUBLE AS strength FROM {EVENTS_SQL} GROUP BY 1, 2, 3)"""


def _graph(spark, sf_dir):
    return events(spark, sf_dir).groupBy(
        F.concat(F.lit("v"), F.col("user_id") % 4).alias("source"),
        F.concat(F.lit("v"), F.col("k") % 3).alias("target"), (1 + F.col("k") % 5).cast("int").alias("lag"),
    ).agg((F.count(F.lit(1)) / 1000.0).alias("strength"))


@query("edges_by_end", f"""
SELECT 'into' AS part, * FROM {_GRAPH} WHERE target = 'v1' UNION ALL
SELECT 'from', * FROM {_GRAPH} WHERE source = 'v3' UNION ALL
SELECT 'between', * FROM {_GRAPH} WHERE source = 'v0' AND target = 'v2' UNION ALL
SELECT 'at', * FROM {_GRAPH} WHERE source = 'v0' AND target = 'v2' AND lag = 3""")
def edges_by_end(spark, sf_dir):
    g = _graph(spark, sf_dir)
    parts = {"into": causal.edges_into(g, "v1"), "from": causal.edges_from(g, "v3"),
             "between": causal.edges_between(g, "v0", "v2"), "at": causal.edges_between(g, "v0", "v2", 3)}
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("part"), "source", "target", "lag", "strength")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("model_terms", f"""
SELECT DISTINCT 'as found' AS form, source AS var, lag FROM {_GRAPH} WHERE target = 'v1' UNION ALL
SELECT DISTINCT 'drivers', source, lag FROM {_GRAPH} WHERE target = 'v1' AND source <> 'v1' UNION ALL
SELECT 'widened', source, CAST(unnest(range(1, 9)) AS INTEGER) FROM
  (SELECT DISTINCT source FROM {_GRAPH} WHERE target = 'v1' AND source <> 'v1') UNION ALL
SELECT DISTINCT 'widened', source, lag FROM {_GRAPH} WHERE target = 'v1' AND source = 'v1'""")
def model_terms(spark, sf_dir):
    """Terms of a target's model in its three forms."""
    g = _graph(spark, sf_dir)
    forms = {"as found": {}, "drivers": {"autoregressive": False}, "widened": {"exogenous_lags": 8}}
    rows = [(form, v, k) for form, kw in forms.items() for v, k in causal.model_terms(g, "v1", **kw)]
    return spark.createDataFrame(rows, "form string, var string, lag int")
