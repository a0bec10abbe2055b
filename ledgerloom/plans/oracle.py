"""The same results in plain SQL, written without the operators' shortcuts.

Gaps are found by joining a full grid, lags by self-joins.
"""

from __future__ import annotations

from ledgerloom.functions.metrics import EPSILON
from ledgerloom.plans import queries as q
from ledgerloom.plans.tables import DRIVERS, HORIZONS, LAGS, PRIORITIES, WINDOWS, YEARS

EPS = repr(EPSILON)
MONTH = "CAST(year({0}) * 12 + month({0}) - 1 AS INTEGER)"


def rnd(expr: str, places: int = 6) -> str:
    scale = f"1e{places}"
    return f"floor(({expr}) * {scale} + 0.5) / {scale}"


def ledger(code: str = "l_partkey", years=(YEARS.first, YEARS.last)) -> str:
    source = "lineitem"
    if code == "p_brand":
        source = "lineitem JOIN part ON l_partkey = p_partkey"
    return f"""
ledger AS (
  SELECT {code} AS rm_code, l_shipdate AS ts, floor(100 * l_extendedprice / l_quantity + 0.5) AS price,
         l_quantity AS weight, l_suppkey AS supplier_no, {MONTH.format('l_shipdate')} AS month_idx
  FROM {source} WHERE year(l_shipdate) BETWEEN {years[0]} AND {years[1]}
)"""


def panel(code: str = "l_partkey") -> str:
    return (
        ledger(code)
        + """,
monthly AS (
  SELECT rm_code, month_idx, avg(price) AS avg_price, last(price ORDER BY ts, price) AS last_price,
         max(ts) AS ts, count(*) AS n
  FROM ledger GROUP BY rm_code, month_idx
),
grid AS (
  SELECT rm_code, CAST(y * 12 + m - 1 AS INTEGER) AS month_idx
  FROM (SELECT DISTINCT rm_code FROM ledger)
  CROSS JOIN (SELECT DISTINCT year(ts) AS y FROM ledger)
  CROSS JOIN (SELECT DISTINCT month(ts) AS m FROM ledger)
),
filled AS (
  SELECT g.rm_code, g.month_idx, m.avg_price, m.ts, m.n,
         last_value(m.last_price IGNORE NULLS) OVER (
           PARTITION BY g.rm_code ORDER BY g.month_idx
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried
  FROM grid g LEFT JOIN monthly m ON g.rm_code = m.rm_code AND g.month_idx = m.month_idx
),
panel AS (
  SELECT rm_code, month_idx, coalesce(avg_price, carried) AS price, n IS NULL AS is_imputed,
         coalesce(ts, CAST(make_date(month_idx // 12, month_idx % 12 + 1, 15) AS TIMESTAMP)) AS ts,
         coalesce(n, 0) AS n_purchases
  FROM filled WHERE carried IS NOT NULL
)"""
    )


def lagged(lags=LAGS.lags) -> str:
    """Panel with one self-join per lag."""
    columns = ", ".join(f"l{i}.price AS AR_{i}" for i in lags)
    joins = "\n  ".join(
        f"LEFT JOIN panel l{i} ON l{i}.rm_code = p.rm_code AND l{i}.month_idx = p.month_idx - {i}"
        for i in lags
    )
    return f"""
lagged AS (
  SELECT p.*, {columns}
  FROM panel p
  {joins}
)"""


def complete(lags) -> str:
    return " AND ".join(f"AR_{i} IS NOT NULL" for i in lags)


def ar_matrix(code: str = "l_partkey", lags=LAGS.lags) -> str:
    return f"""{panel(code)},{lagged(lags)},
ar_matrix AS (
  SELECT rm_code, month_idx, ts, price AS average_price, {", ".join(f"AR_{i}" for i in lags)}
  FROM lagged WHERE NOT is_imputed AND {complete(lags)}
)"""


NAMED = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITIES.items()) + " END"

DAILY = f"""
daily AS (
  SELECT {NAMED} AS driver, CAST(o_orderdate AS DATE) AS date, floor(avg(o_totalprice) + 0.5) AS value
  FROM orders GROUP BY 1, 2
)"""

SERIES = f"""{DAILY},
series AS (
  SELECT driver, {MONTH.format('date')} AS month_idx, avg(value) AS value
  FROM daily WHERE year(date) BETWEEN {YEARS.first} AND {YEARS.last} GROUP BY 1, 2
),
wide AS (
  SELECT month_idx, {", ".join(f"max(value) FILTER (driver = '{d}') AS {d}" for d in DRIVERS)}
  FROM series GROUP BY month_idx HAVING count(*) FILTER (driver = '{DRIVERS[0]}') > 0
)"""

DRIVER_LAGS = f"""{SERIES},
months AS (SELECT DISTINCT CAST(month_idx + i AS INTEGER) AS month_idx
           FROM wide, (SELECT unnest(range({LAGS.first}, {LAGS.last + 1})) AS i)),
driver_lags AS (
  SELECT m.month_idx, {", ".join(f"w{i}.{d} AS {d}_{i}" for i in LAGS.lags for d in DRIVERS)}
  FROM months m
  {" ".join(f"LEFT JOIN wide w{i} ON w{i}.month_idx = m.month_idx - {i}" for i in LAGS.lags)}
)"""

DRIVER_COLUMNS = [f"{d}_{i}" for i in LAGS.lags for d in DRIVERS]
AR_COLUMNS = [f"AR_{i}" for i in LAGS.lags]

FEATURES = f"""{ar_matrix()},{DRIVER_LAGS},
features AS (
  SELECT a.*, {", ".join(DRIVER_COLUMNS)}
  FROM ar_matrix a JOIN driver_lags d ON a.month_idx = d.month_idx
  WHERE {" AND ".join(f"{c} IS NOT NULL" for c in DRIVER_COLUMNS)}
)"""

TEST_WINDOWS = "windows(test, a, b) AS (VALUES " + ", ".join(
    f"(CAST({n} AS INTEGER), TIMESTAMP '{w.start}', TIMESTAMP '{w.end}')" for n, w in enumerate(WINDOWS, 1)
) + ")"

CALENDAR = """
span AS (SELECT CAST(min(l_shipdate) AS DATE) AS a, CAST(max(l_shipdate) AS DATE) AS b FROM lineitem),
days AS (
  SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date
  FROM span
)"""


def ape(actual: str, predicted: str) -> str:
    return f"abs({actual} - ({predicted})) / greatest(abs({actual}), {EPS})"


def digest(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"


def hot(column: str, value, name: str) -> str:
    literal = f"'{value}'" if isinstance(value, str) else value
    return f"{column} = {literal} AS {name}"


def brand_name(brand: str) -> str:
    return brand.replace("#", "_").lower()


FULL = """
full_ledger AS (
  SELECT l_shipdate AS ts, lower(p_type) AS group_desc, l_partkey AS rm_code,
         floor(100 * l_extendedprice / l_quantity + 0.5) AS price, l_quantity AS weight, n_name AS site,
         l_suppkey AS supplier_no, l_orderkey AS purchase_no
  FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)"""

SHIFTED = """
monthly_avg AS (SELECT rm_code, month_idx, avg(price) AS avg_price FROM ledger GROUP BY 1, 2),
shifted AS (
  SELECT *, lag(avg_price, {k}) OVER (PARTITION BY rm_code ORDER BY month_idx) AS predicted_price
  FROM monthly_avg
)"""

TWO_LEVEL = f"""{ledger()},{CALENDAR},{DAILY},
index_days AS (
  SELECT days.date, {", ".join(f"max(value) FILTER (driver = '{d}') AS {d}" for d in DRIVERS)}
  FROM days LEFT JOIN daily ON days.date = daily.date GROUP BY days.date
),
indices AS (
  SELECT {MONTH.format('date')} AS month_idx, min(date) AS date, {", ".join(f"avg({d}) AS {d}" for d in DRIVERS)}
  FROM index_days GROUP BY 1
),
by_day AS (
  SELECT rm_code, month_idx, CAST(ts AS DATE) AS day, sum(weight) AS weight, avg(price) AS price
  FROM ledger GROUP BY 1, 2, 3
),
by_month AS (
  SELECT rm_code, month_idx, sum(weight) AS weight, avg(price) AS price FROM by_day GROUP BY 1, 2
),
two_level AS (
  SELECT c.rm_code, i.month_idx, coalesce(m.weight, 0) AS weight, m.price, {", ".join(DRIVERS)}, i.date
  FROM (SELECT DISTINCT rm_code FROM ledger) c CROSS JOIN indices i
  LEFT JOIN by_month m ON m.rm_code = c.rm_code AND m.month_idx = i.month_idx
)"""

PERSISTENCE = " UNION ALL ".join(
    f"""SELECT f.rm_code, w.test, CAST({h} AS INTEGER) AS horizon, count(*) AS n,
        100 * avg({ape('f.average_price', f'f.AR_{h}')}) AS mape_pct
    FROM ar_matrix f JOIN windows w ON f.ts >= w.a AND f.ts < w.b GROUP BY 1, 2"""
    for h in HORIZONS
)


def share(source: str, key: str) -> str:
    return f"""SELECT {key}, sum(weight) AS volume,
      {rnd("100 * sum(weight) / (SELECT sum(weight) FROM " + source + ")")} AS share_pct
    FROM {source} GROUP BY {key}"""


def zscore(column: str) -> str:
    train = f"CASE WHEN NOT is_test THEN {column} END"
    over = "OVER (PARTITION BY rm_code, test)"
    return f"""({column} - avg({train}) {over}) /
      CASE WHEN stddev_pop({train}) {over} = 0 THEN 1 ELSE stddev_pop({train}) {over} END"""


def robust(column: str) -> str:
    spread = f"(q3_{column} - q1_{column})"
    return f"({column} - q2_{column}) / CASE WHEN {spread} = 0 THEN 1 ELSE {spread} END"


TRAIN_TEST = """
rows AS (
  SELECT f.*, w.test, f.ts >= w.a AS is_test FROM ar_matrix f JOIN windows w ON f.ts < w.b
)"""

LASSO_ONE = " UNION ALL ".join(
    f"""SELECT r.rm_code, CAST({h} AS INTEGER) AS horizon, r.test, s.n_train,
        count(*) AS n_test, any_value(s.beta) AS beta,
        100 * avg({ape('r.average_price', f's.my + s.sy * s.beta * (r.AR_{h} - s.mx) / s.sx')}) AS mape_pct
    FROM rows r JOIN (
      SELECT *, sign(rho) * greatest(abs(rho) - {q.ALPHA}, 0) AS beta FROM (
        SELECT *, cxy / (sx * sy) AS rho FROM (
          SELECT rm_code, test, count(*) AS n_train, avg(AR_{h}) AS mx, avg(average_price) AS my,
                 CASE WHEN stddev_pop(AR_{h}) = 0 THEN 1 ELSE stddev_pop(AR_{h}) END AS sx,
                 CASE WHEN stddev_pop(average_price) = 0 THEN 1 ELSE stddev_pop(average_price) END AS sy,
                 covar_pop(AR_{h}, average_price) AS cxy
          FROM rows WHERE NOT is_test GROUP BY rm_code, test HAVING count(*) > 1))
    ) s ON r.rm_code = s.rm_code AND r.test = s.test
    WHERE r.is_test GROUP BY r.rm_code, r.test, s.n_train"""
    for h in HORIZONS
)

# One feature per model: its folds, all candidates and the choice have closed forms.
SEARCH = f"""
horizons(horizon) AS (VALUES {", ".join(f"(CAST({h} AS INTEGER))" for h in HORIZONS)}),
long AS (
  SELECT rm_code, ts, average_price AS y, horizon,
         CASE horizon {" ".join(f"WHEN {h} THEN AR_{h}" for h in HORIZONS)} END AS x
  FROM ar_matrix, horizons),
sizes AS (
  SELECT l.rm_code, l.horizon, w.test, any_value(w.a) AS a, any_value(w.b) AS b,
         CAST(count(*) FILTER (l.ts < w.a) AS INTEGER) AS n_train,
         CAST(count(*) FILTER (l.ts >= w.a AND l.ts < w.b) AS INTEGER) AS n_test,
         avg(l.x) FILTER (l.ts < w.a) AS mx, avg(l.y) FILTER (l.ts < w.a) AS my,
         stddev_pop(l.x) FILTER (l.ts < w.a) AS dx, stddev_pop(l.y) FILTER (l.ts < w.a) AS dy
  FROM long l CROSS JOIN windows w GROUP BY 1, 2, 3),
cells AS (
  SELECT *, CASE WHEN dx = 0 THEN 1 ELSE dx END AS sx, CASE WHEN dy = 0 THEN 1 ELSE dy END AS sy,
         CASE WHEN n_train < 10 THEN 'too few training rows' WHEN n_test = 0 THEN 'no test rows' ELSE 'ok' END AS status
  FROM sizes),
train AS (
  SELECT c.rm_code, c.horizon, c.test, c.n_train, (l.x - mx) / sx AS x, (l.y - my) / sy AS y,
         row_number() OVER (PARTITION BY c.rm_code, c.horizon, c.test ORDER BY l.ts) - 1 AS i
  FROM cells c JOIN long l ON l.rm_code = c.rm_code AND l.horizon = c.horizon AND l.ts < c.a
  WHERE status = 'ok'),
folded AS (
  SELECT *, CASE WHEN i < (n_train % 5) * (n_train // 5 + 1) THEN i // (n_train // 5 + 1)
            ELSE (n_train % 5) + (i - (n_train % 5) * (n_train // 5 + 1)) // (n_train // 5) END AS fold
  FROM train),
sides AS (
  SELECT f.rm_code, f.horizon, f.test, k.fold, avg(x) FILTER (f.fold <> k.fold) AS xm, avg(y) FILTER (f.fold <> k.fold) AS ym,
         var_pop(x) FILTER (f.fold <> k.fold) AS g, covar_pop(x, y) FILTER (f.fold <> k.fold) AS c,
         count(*) FILTER (f.fold = k.fold) AS n, avg(x) FILTER (f.fold = k.fold) AS hx, avg(y) FILTER (f.fold = k.fold) AS hy,
         var_pop(x) FILTER (f.fold = k.fold) AS vx, var_pop(y) FILTER (f.fold = k.fold) AS vy,
         covar_pop(x, y) FILTER (f.fold = k.fold) AS vxy
  FROM folded f CROSS JOIN (SELECT unnest(range(5)) AS fold) k GROUP BY 1, 2, 3, 4),
alphas AS (SELECT i, 0.01::DOUBLE + 10 * i * (0.99::DOUBLE / 2999) AS alpha FROM (SELECT unnest(range(300)) AS i)),
fits AS (
  SELECT s.*, i, alpha, CASE WHEN abs(c) <= alpha THEN 0 ELSE sign(c) * (abs(c) - alpha) / g END AS beta
  FROM sides s CROSS JOIN alphas),
errors AS (
  SELECT *, n * (vy - 2 * beta * vxy + beta * beta * vx + (hy - ym - beta * (hx - xm)) ** 2) AS sse FROM fits),
means AS (
  SELECT rm_code, horizon, test, i, any_value(alpha) AS alpha, avg(CASE WHEN vy > 0 THEN 1 - sse / (n * vy) ELSE 0 END) AS r2
  FROM errors GROUP BY 1, 2, 3, 4),
chosen AS (
  SELECT * FROM means
  QUALIFY row_number() OVER (PARTITION BY rm_code, horizon, test ORDER BY round(r2, 9) DESC, i) = 1),
weights AS (
  SELECT t.rm_code, t.horizon, t.test, any_value(alpha) AS alpha, any_value(r2) AS cv_r2,
         CASE WHEN abs(avg(x * y)) <= any_value(alpha) THEN 0
              ELSE sign(avg(x * y)) * (abs(avg(x * y)) - any_value(alpha)) / avg(x * x) END AS coef
  FROM train t JOIN chosen USING (rm_code, horizon, test) GROUP BY 1, 2, 3),
tested AS (
  SELECT w.rm_code, w.horizon, w.test, 100 * avg({ape('l.y', 'my + sy * coef * (l.x - mx) / sx')}) AS mape_pct
  FROM weights w JOIN cells c USING (rm_code, horizon, test)
  JOIN long l ON l.rm_code = c.rm_code AND l.horizon = c.horizon AND l.ts >= c.a AND l.ts < c.b GROUP BY 1, 2, 3),
models AS (
  SELECT c.rm_code, c.horizon, c.test, n_train, n_test, status, alpha, cv_r2, coef, mape_pct
  FROM cells c LEFT JOIN weights USING (rm_code, horizon, test) LEFT JOIN tested USING (rm_code, horizon, test))"""

SUPPLIER_FEATURES = FEATURES.replace(ar_matrix(), ar_matrix("l_suppkey"))

ALPHAS = "alphas AS (SELECT i, 0.01::DOUBLE + 10 * i * (0.99::DOUBLE / 2999) AS alpha FROM (SELECT unnest(range(300)) AS i))"


def two_weights(g: str = "g", c: str = "c") -> str:
    """Both weights of a LASSO of two columns: one or none used, else the signs that agree with themselves."""
    g1, g2, g12, c1, c2 = f"{g}1", f"{g}2", f"{g}12", f"{c}1", f"{c}2"
    solo1 = f"CASE WHEN abs({c1}) <= alpha THEN 0 ELSE sign({c1}) * (abs({c1}) - alpha) / {g1} END"
    solo2 = f"CASE WHEN abs({c2}) <= alpha THEN 0 ELSE sign({c2}) * (abs({c2}) - alpha) / {g2} END"
    det = f"nullif({g1} * {g2} - {g12} * {g12}, 0)"
    both = ""
    for s1 in (1, -1):
        for s2 in (1, -1):
            w1 = f"(({c1} - alpha * {s1}) * {g2} - ({c2} - alpha * {s2}) * {g12}) / {det}"
            w2 = f"(({c2} - alpha * {s2}) * {g1} - ({c1} - alpha * {s1}) * {g12}) / {det}"
            both += f" WHEN ({w1}) * {s1} > 0 AND ({w2}) * {s2} > 0 THEN [{w1}, {w2}]"
    return f"""CASE WHEN abs({c2} - {g12} * ({solo1})) <= alpha THEN [{solo1}, 0]
        WHEN abs({c1} - {g12} * ({solo2})) <= alpha THEN [0, {solo2}]{both} END"""


def search_two(matrix: str, first: str, second: str, horizons=HORIZONS, p: str = "") -> str:
    """As ``SEARCH`` with two columns per horizon ``{h}``; tables are named with the prefix ``p``."""

    def of_horizon(column: str) -> str:
        return "CASE horizon " + " ".join(f"WHEN {h} THEN {column.format(h=h, next=h + 1)}" for h in horizons) + " END"

    def scaled(x: str) -> str:
        return f"avg(l.{x}) FILTER (l.ts < w.a) AS m{x}, stddev_pop(l.{x}) FILTER (l.ts < w.a) AS d{x}"

    out, held = "FILTER (f.fold <> k.fold)", "FILTER (f.fold = k.fold)"
    keys = "rm_code, horizon, test"
    return f"""
{p}horizons(horizon) AS (VALUES {", ".join(f"(CAST({h} AS INTEGER))" for h in horizons)}),
{p}long AS (
  SELECT rm_code, ts, month_idx, average_price AS y, horizon, CAST({of_horizon(first)} AS DOUBLE) AS u,
         CAST({of_horizon(second)} AS DOUBLE) AS v
  FROM {matrix}, {p}horizons),
{p}sizes AS (
  SELECT l.rm_code, l.horizon, w.test, any_value(w.a) AS a, any_value(w.b) AS b,
         CAST(count(*) FILTER (l.ts < w.a) AS INTEGER) AS n_train,
         CAST(count(*) FILTER (l.ts >= w.a AND l.ts < w.b) AS INTEGER) AS n_test,
         {", ".join(scaled(x) for x in "uvy")}
  FROM {p}long l CROSS JOIN windows w GROUP BY 1, 2, 3),
{p}cells AS (
  SELECT *, {", ".join(f"CASE WHEN d{x} = 0 THEN 1 ELSE d{x} END AS s{x}" for x in "uvy")},
         CASE WHEN n_train < 10 THEN 'too few training rows' WHEN n_test = 0 THEN 'no test rows' ELSE 'ok' END AS status
  FROM {p}sizes),
{p}train AS (
  SELECT c.rm_code, c.horizon, c.test, c.n_train, (u - mu) / su AS u, (v - mv) / sv AS v, (y - my) / sy AS y,
         row_number() OVER (PARTITION BY c.rm_code, c.horizon, c.test ORDER BY l.ts) - 1 AS i
  FROM {p}cells c JOIN {p}long l ON l.rm_code = c.rm_code AND l.horizon = c.horizon AND l.ts < c.a
  WHERE status = 'ok'),
{p}folded AS (
  SELECT *, CASE WHEN i < (n_train % 5) * (n_train // 5 + 1) THEN i // (n_train // 5 + 1)
            ELSE (n_train % 5) + (i - (n_train % 5) * (n_train // 5 + 1)) // (n_train // 5) END AS fold
  FROM {p}train),
{p}sides AS (
  SELECT {keys}, k.fold, {", ".join(f"avg({x}) {out} AS {x}m, avg({x}) {held} AS {x}h" for x in "uvy")},
         var_pop(u) {out} AS g1, var_pop(v) {out} AS g2, covar_pop(u, v) {out} AS g12,
         covar_pop(u, y) {out} AS c1, covar_pop(v, y) {out} AS c2, count(*) {held} AS n,
         var_pop(u) {held} AS h1, var_pop(v) {held} AS h2, covar_pop(u, v) {held} AS h12,
         covar_pop(u, y) {held} AS r1, covar_pop(v, y) {held} AS r2, var_pop(y) {held} AS vy
  FROM {p}folded f CROSS JOIN (SELECT unnest(range(5)) AS fold) k GROUP BY {keys}, k.fold),
{p}{ALPHAS},
{p}fits AS (SELECT s.*, i, alpha, {two_weights()} AS w FROM {p}sides s CROSS JOIN {p}alphas),
{p}errors AS (
  SELECT *, n * (vy - 2 * (w[1] * r1 + w[2] * r2) + w[1] * w[1] * h1 + 2 * w[1] * w[2] * h12 + w[2] * w[2] * h2
                 + (yh - ym - w[1] * (uh - um) - w[2] * (vh - vm)) ** 2) AS sse FROM {p}fits),
{p}means AS (
  SELECT {keys}, i, any_value(alpha) AS alpha, avg(CASE WHEN vy > 0 THEN 1 - sse / (n * vy) ELSE 0 END) AS cv_r2
  FROM {p}errors GROUP BY {keys}, i),
{p}chosen AS (
  SELECT * FROM {p}means QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY round(cv_r2, 9) DESC, i) = 1),
{p}products AS (
  SELECT {keys}, any_value(alpha) AS alpha, any_value(cv_r2) AS cv_r2, avg(u * u) AS g1, avg(v * v) AS g2,
         avg(u * v) AS g12, avg(u * y) AS c1, avg(v * y) AS c2
  FROM {p}train JOIN {p}chosen USING ({keys}) GROUP BY {keys}),
{p}weights AS (SELECT {keys}, alpha, cv_r2, {two_weights()} AS w FROM {p}products),
{p}forecasts AS (
  SELECT w.rm_code, w.horizon, w.test, l.month_idx, l.ts, l.y AS actual,
         my + sy * (w.w[1] * (u - mu) / su + w.w[2] * (v - mv) / sv) AS predicted
  FROM {p}weights w JOIN {p}cells c USING ({keys})
  JOIN {p}long l ON l.rm_code = c.rm_code AND l.horizon = c.horizon AND l.ts >= c.a AND l.ts < c.b),
{p}tested AS (SELECT {keys}, 100 * avg({ape('actual', 'predicted')}) AS mape_pct FROM {p}forecasts GROUP BY {keys}),
{p}models AS (
  SELECT c.rm_code, c.horizon, c.test, n_train, n_test, status, alpha, cv_r2, w[1] AS coef_1, w[2] AS coef_2, mape_pct
  FROM {p}cells c LEFT JOIN {p}weights USING ({keys}) LEFT JOIN {p}tested USING ({keys}))"""


TWO_SHOWN = f"""rm_code, horizon, test, n_train, n_test, status, {rnd('alpha', 5)} AS alpha, {rnd('cv_r2', 5)} AS cv_r2,
             {rnd('mape_pct', 4)} AS mape_pct, {rnd('coef_1', 5)} AS coef_1, {rnd('coef_2', 5)} AS coef_2"""

WITH_DRIVER = f"WITH {SUPPLIER_FEATURES}, {TEST_WINDOWS}, {search_two('features', q.PAIR_DRIVER + '_{h}', 'AR_{h}')}"

WEEKDAYS = "strftime(date, '%A')"

BACKS = ", ".join(f"CAST(date - INTERVAL {i} MONTH AS DATE) AS back_{i}" for i in LAGS.lags)


def date_flags() -> str:
    families = {
        "YEAR": ("year(date)", q.YEAR_LIST),
        "QUARTER": ("quarter(date)", range(1, 5)),
        "MONTH": ("month(date)", range(1, 13)),
        "WEEK": ("week(date)", range(1, 54)),
        "DAY": ("day(date)", range(1, 32)),
    }
    return ", ".join(
        f"CAST({expr} = {v} AS INTEGER) AS {name}_{v}"
        for name, (expr, values) in families.items()
        for v in values
    )


def flagged(code_column: str) -> str:
    return ", ".join(hot(code_column, b, brand_name(b)) for b in q.BRANDS)


ORACLES: dict[str, str] = {
    "scan_ledger": f"WITH {FULL} SELECT * FROM full_ledger",
    "driver_series": f"WITH {SERIES} SELECT driver, month_idx, value FROM series",
    "driver_archive": f"WITH {SERIES} SELECT driver, month_idx, value FROM series WHERE driver IS NOT NULL",
    "driver_electricity": f"""
      SELECT 'Electricity' AS driver, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
             {MONTH.format('o_orderdate')} AS month_idx, avg(floor(o_totalprice + 0.5)) AS value
      FROM orders WHERE year(o_orderdate) BETWEEN {YEARS.first} AND {YEARS.last} GROUP BY 1, 2, 3""",
    "json_records_parse": """
      SELECT event_id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    "json_records_variant": """WITH parts AS (
        SELECT event_id, event_id % 10 AS kind, props, '"Time":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '"' AS stamp
        FROM events),
      records AS (
        SELECT event_id, kind, CASE kind
            WHEN 0 THEN '{' || stamp || ',' WHEN 2 THEN '{"props":' || props || '}'
            WHEN 3 THEN '{"Time":"n/a","props":' || props || '}' WHEN 4 THEN '{' || stamp || ',"props":{"k":"none"}}'
            WHEN 5 THEN CAST(event_id AS VARCHAR) ELSE '{' || stamp || ',"props":' || props || '}' END AS record
        FROM parts),
      bodies AS (SELECT event_id, CASE kind WHEN 1 THEN record ELSE '[' || record || ']' END AS body FROM records),
      valid AS (SELECT event_id, json_valid(body) AS ok, CASE WHEN json_valid(body) THEN body END AS body FROM bodies),
      typed AS (
        SELECT event_id, ok, ok AND json_type(body) = 'ARRAY' AS listed, json_type(body, '$[0]') = 'OBJECT' AS whole,
               json_extract_string(body, '$[0].Time') AS t, json_extract_string(body, '$[0].props.k') AS k
        FROM valid)
      SELECT event_id, CASE WHEN listed THEN CAST(0 AS INTEGER) END AS position,
             CASE WHEN listed THEN TRY_CAST(t AS TIMESTAMP) END AS time,
             CASE WHEN listed THEN TRY_CAST(k AS BIGINT) END AS k,
             CASE WHEN NOT ok THEN 'not JSON' WHEN NOT listed THEN 'not an array' WHEN NOT whole THEN 'not an object'
               WHEN t IS NULL THEN 'time absent' WHEN TRY_CAST(t AS TIMESTAMP) IS NULL THEN 'time is no timestamp_ntz'
               WHEN k IS NOT NULL AND TRY_CAST(k AS BIGINT) IS NULL THEN 'k is no long' END AS reason
      FROM typed""",
    "json_records_write": f"""WITH {ledger()}
      SELECT CAST(to_json(struct_pack(rm_code := rm_code, label := strftime(ts, '%Y-%m'),
        year := year(ts), month := month(ts), month_idx := month_idx)) AS VARCHAR) AS record
      FROM ledger""",
    "calendar_dim": f"""WITH {CALENDAR}
      SELECT date, CAST(day(date) AS INTEGER) AS day, {WEEKDAYS} AS weekday,
             CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year,
             CAST(week(date) AS INTEGER) AS iso_week, CAST(isoyear(date) AS INTEGER) AS iso_year
      FROM days""",
    "ingest_incremental": f"""WITH {panel()}
      SELECT rm_code, month_idx, ts, price, n_purchases, is_imputed FROM panel""",
    "ingest_by_code": f"""WITH {panel()},{lagged(q.SHORT_LAGS.lags)}
      SELECT rm_code, month_idx, ts, price, n_purchases, is_imputed, {", ".join(f"AR_{i}" for i in q.SHORT_LAGS.lags)}
      FROM lagged""",
    "clean_ledger": f"""WITH {FULL}
      SELECT rm_code, group_desc, ts, price, CAST(year(ts) AS INTEGER) AS year,
             CAST(month(ts) AS INTEGER) AS month, {MONTH.format('ts')} AS month_idx
      FROM full_ledger WHERE year(ts) BETWEEN {YEARS.first} AND {YEARS.last}""",
    "year_window": f"WITH {ledger(years=(1997, 1999))} SELECT rm_code, ts, price, weight FROM ledger",
    "train_test_windows": f"""WITH {ledger()}, {TEST_WINDOWS}
      SELECT test, ts >= a AS is_test, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts,
             sum(weight) AS weight
      FROM ledger JOIN windows ON ts < b GROUP BY 1, 2""",
    "code_filter": f"""WITH {ledger()}
      SELECT rm_code, ts, price FROM ledger
      WHERE rm_code IN (SELECT p_partkey FROM part WHERE lower(p_type) = 'promo')""",
    "one_hot_codes": f"""WITH {panel('p_brand')}
      SELECT rm_code, CAST(month_idx // 12 AS INTEGER) AS year, CAST(month_idx % 12 + 1 AS INTEGER) AS month,
             month_idx, ts, price AS average_price, is_imputed, {flagged('rm_code')}
      FROM panel""",
    "one_hot_dates": f"WITH {CALENDAR} SELECT date, {date_flags()} FROM days",
    "month_label_and_index": f"""WITH {ledger()}
      SELECT month_idx, strftime(ts, '%Y-%m') AS label, count(*) AS n FROM ledger GROUP BY 1, 2""",
    "month_offset": f"""
      SELECT date, {BACKS} FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)""",
    "shift_series_days": f"""WITH {DAILY}
      SELECT driver, CAST(date + {q.SHIFT_DAYS} AS DATE) AS date, value
      FROM daily WHERE date + {q.SHIFT_DAYS} >= DATE '{q.FLOOR_DAY}'""",
    "horizon_prune": f"""WITH {ar_matrix('l_suppkey')}
      SELECT rm_code, month_idx, ts, average_price,
             {", ".join(f"AR_{i}" for i in LAGS.from_horizon(6))}
      FROM ar_matrix""",
    "interaction_terms": f"""WITH {ar_matrix('p_brand', q.SHORT_LAGS.lags)}
      SELECT rm_code, month_idx, {", ".join(
          f"CASE WHEN rm_code = '{b}' THEN AR_{i} ELSE 0 END AS {brand_name(b)}_ar_{i}"
          for b in q.BRANDS for i in q.SHORT_LAGS.lags)}
      FROM ar_matrix""",
    "period_flag": f"""WITH {CALENDAR}
      SELECT date, CAST(date BETWEEN DATE '1998-02-23' AND DATE '2000-03-07' AS INTEGER) AS flag FROM days""",
    "calendar_parts_of_purchases": """
      SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(quarter(l_shipdate) AS INTEGER) AS quarter,
             CAST(month(l_shipdate) AS INTEGER) AS month, CAST(week(l_shipdate) AS INTEGER) AS week,
             CAST(day(l_shipdate) AS INTEGER) AS day, count(*) AS n
      FROM lineitem GROUP BY 1, 2, 3, 4, 5""",
    "quarter_end_points": f"""WITH {ledger()}
      SELECT rm_code, concat(year(ts), '-', month(ts)) AS year_month, avg(price) AS avg_price
      FROM ledger WHERE month(ts) IN (3, 6, 9, 12) GROUP BY 1, 2""",
    "drop_incomplete": f"""WITH {panel()},{lagged()}
      SELECT rm_code, month_idx, is_imputed, AR_12 FROM lagged WHERE {complete(LAGS.lags)}""",
    "base_category_rows": f"""WITH {ledger('p_brand')}
      SELECT rm_code, month_idx, avg(price) AS avg_price FROM ledger
      WHERE rm_code NOT IN ({", ".join(f"'{b}'" for b in q.BRANDS[:-1])}) GROUP BY 1, 2""",
    "log_roundtrip": f"""
      SELECT l_partkey AS rm_code, l_shipdate AS ts,
             {rnd('ln(floor(100 * l_extendedprice / l_quantity + 0.5))')} AS log_price,
             TRUE AS is_inverse FROM lineitem""",
    "month_grid": f"""WITH {panel()}
      SELECT rm_code, CAST(month_idx // 12 AS INTEGER) AS year, CAST(month_idx % 12 + 1 AS INTEGER) AS month
      FROM grid""",
    "grid_left_facts": f"""WITH {panel()}
      SELECT g.rm_code, g.month_idx, l.ts, l.price
      FROM grid g LEFT JOIN ledger l ON g.rm_code = l.rm_code AND g.month_idx = l.month_idx""",
    "missing_cells": f"""WITH {panel()}
      SELECT rm_code, month_idx, carried IS NULL AS is_leading FROM filled WHERE n IS NULL""",
    "impute_ffill": f"""WITH {panel()}
      SELECT rm_code, month_idx, ts, price, FALSE AS is_imputed FROM ledger
      UNION ALL SELECT rm_code, month_idx, ts, price, TRUE FROM panel WHERE is_imputed""",
    "monthly_avg_price": f"""WITH {ledger()}
      SELECT rm_code, month_idx, avg(price) AS avg_price FROM ledger GROUP BY 1, 2""",
    "monthly_last": f"""WITH {ledger()}
      SELECT rm_code, month_idx, max(ts) AS last_ts, last(price ORDER BY ts, price) AS last_price,
             last(weight ORDER BY ts, weight) AS last_weight
      FROM ledger GROUP BY 1, 2""",
    "monthly_target": f"""WITH {panel()}
      SELECT rm_code, CAST(month_idx // 12 AS INTEGER) AS year, CAST(month_idx % 12 + 1 AS INTEGER) AS month,
             month_idx, ts, price AS average_price, is_imputed, lower(p_type) AS group_desc
      FROM panel JOIN part ON rm_code = p_partkey""",
    "exclude_imputed": f"""WITH {panel()}
      SELECT rm_code, month_idx, ts, price AS average_price FROM panel WHERE NOT is_imputed""",
    "driver_ffill": f"""WITH {CALENDAR},{DAILY}
      SELECT c.driver, days.date, {MONTH.format('days.date')} AS month_idx, last_value(value IGNORE NULLS)
        OVER (PARTITION BY c.driver ORDER BY days.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
      FROM days CROSS JOIN (SELECT DISTINCT driver FROM daily) c
      LEFT JOIN daily ON daily.driver = c.driver AND daily.date = days.date""",
    "driver_panel": f"""WITH {SERIES}
      SELECT month_idx, {", ".join(DRIVERS)} FROM wide""",
    "driver_lags": f"""WITH {DRIVER_LAGS}
      SELECT month_idx, {", ".join(DRIVER_COLUMNS)} FROM driver_lags""",
    "ar_lags": f"""WITH {panel()},{lagged()}
      SELECT rm_code, month_idx, is_imputed, {", ".join(["price", *AR_COLUMNS])}
      FROM lagged""",
    "feature_matrix": f"""WITH {FEATURES}
      SELECT rm_code, month_idx, ts, {", ".join(["average_price", *AR_COLUMNS])},
             {", ".join(DRIVER_COLUMNS)}
      FROM features""",
    "calendar_indices": f"""WITH {CALENDAR},{SERIES}
      SELECT days.date, CAST(year(days.date) AS INTEGER) AS year, CAST(month(days.date) AS INTEGER) AS month,
             o.value AS DAILY, {", ".join(
               f"s_{d}.value AS {d}" for d in DRIVERS)}
      FROM days LEFT JOIN (
        SELECT CAST(o_orderdate AS DATE) AS date, avg(floor(o_totalprice + 0.5)) AS value FROM orders GROUP BY 1) o
        ON o.date = days.date
      {" ".join(f"LEFT JOIN series s_{d} ON s_{d}.driver = '{d}' AND s_{d}.month_idx = "
                f"year(days.date) * 12 + month(days.date) - 1" for d in DRIVERS)}""",
    "residual_topk": f"""WITH {ledger()},{SHIFTED.format(k=1)}
      SELECT rm_code, month_idx, avg_price, predicted_price,
             abs(avg_price - predicted_price) AS abs_error
      FROM shifted WHERE predicted_price IS NOT NULL
      ORDER BY abs(avg_price - predicted_price) DESC, rm_code, month_idx LIMIT {q.TOP_K}""",
    "volume_by_year": """
      SELECT l_partkey AS rm_code, CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) AS volume
      FROM lineitem GROUP BY 1, 2""",
    "volume_pivot": f"""
      SELECT l_partkey AS rm_code, {", ".join(
        f"coalesce(sum(l_quantity) FILTER (year(l_shipdate) = {y}), 0) AS y{y}" for y in q.YEAR_LIST)}
      FROM lineitem GROUP BY 1""",
    "site_flags": f"""WITH {FULL}
      SELECT rm_code, site, CAST(ts AS DATE) AS date, sum(weight) AS weight, avg(price) AS price,
             {", ".join(f"CAST(site = '{s}' AS INTEGER) AS SITE_{s}" for s in q.SITES)}
      FROM full_ledger GROUP BY 1, 2, 3""",
    "volume_share_group": f"WITH {FULL} {share('full_ledger', 'group_desc')}",
    "volume_share_site": f"WITH {FULL} {share('full_ledger', 'site')}",
    "volume_share_code": f"WITH {FULL} {share('full_ledger', 'rm_code')}",
    "codes_per_group": f"""WITH {FULL},
      counts AS (SELECT group_desc, count(DISTINCT rm_code) AS n_codes FROM full_ledger GROUP BY 1)
      SELECT group_desc, n_codes, n_codes = (SELECT max(n_codes) FROM counts) AS is_max FROM counts""",
    "code_catalog": f"""WITH {FULL}
      SELECT group_desc, rm_code, count(*) AS n_rows FROM full_ledger GROUP BY 1, 2""",
    "codes_by_group": f"WITH {FULL} SELECT DISTINCT group_desc, rm_code FROM full_ledger",
    "distinct_group_of_codes": f"WITH {FULL} SELECT DISTINCT group_desc FROM full_ledger",
    "monthly_panel_two_level": f"""WITH {TWO_LEVEL}
      SELECT rm_code, month_idx, weight, {rnd('price')} AS price,
             {", ".join(DRIVERS)}, date
      FROM two_level""",
    "driver_correlation": f"""WITH {TWO_LEVEL},
      corrs AS ({" UNION ALL ".join(
        f"SELECT rm_code, '{d}' AS driver, corr(coalesce({d}, 0), coalesce(price, 0)) AS correlation, "
        f"{k} AS place FROM two_level GROUP BY rm_code" for k, d in enumerate(DRIVERS))})
      SELECT rm_code, driver, {rnd('correlation')} AS correlation,
             row_number() OVER (PARTITION BY rm_code ORDER BY correlation DESC, place) = 1 AS is_best
      FROM corrs""",
    "peak_shift_days": f"""WITH {TWO_LEVEL},
      price_peaks AS (SELECT rm_code, max(date) AS price_peak FROM (
        SELECT *, max(price) OVER (PARTITION BY rm_code) AS top FROM two_level) WHERE price = top GROUP BY 1),
      driver_peaks AS ({" UNION ALL ".join(
        f"SELECT '{d}' AS driver, max(date) AS driver_peak FROM indices "
        f"WHERE {d} = (SELECT max({d}) FROM indices)" for d in DRIVERS)})
      SELECT rm_code, price_peak, driver, driver_peak,
             CAST(date_diff('day', driver_peak, price_peak) AS INTEGER) AS shift_days
      FROM price_peaks CROSS JOIN driver_peaks""",
    "price_evolution": f"""WITH {panel()}
      SELECT lower(p_type) AS group_desc, rm_code, CAST(month_idx // 12 AS INTEGER) AS year,
             CAST(month_idx % 12 + 1 AS INTEGER) AS month, price,
             concat(month_idx // 12, '-', month_idx % 12 + 1) AS year_month,
             month_idx % 12 + 1 IN (3, 6, 9, 12) AS is_tick
      FROM panel JOIN part ON rm_code = p_partkey""",
    "naive_backtest": f"""WITH {ar_matrix()}, {TEST_WINDOWS}, scores AS ({PERSISTENCE})
      SELECT rm_code, horizon, count(*) AS n_windows, {rnd('avg(mape_pct)', 4)} AS mape_pct
      FROM scores GROUP BY 1, 2""",
    "persistence_mape": f"""WITH {ar_matrix('l_suppkey')}, {TEST_WINDOWS}, scores AS ({PERSISTENCE})
      SELECT rm_code, test, n, horizon, {rnd('mape_pct', 3)} AS mape_pct FROM scores""",
    "naive_shift_forecast": f"""WITH {ledger()},{SHIFTED.format(k=3)}
      SELECT rm_code, month_idx, avg_price, predicted_price
      FROM shifted WHERE predicted_price IS NOT NULL""",
    "forecast_errors": f"""WITH {ledger()},{SHIFTED.format(k=1)},
      pairs AS (
        SELECT lower(p_type) AS group_desc, avg_price AS a, predicted_price AS p
        FROM shifted JOIN part ON rm_code = p_partkey WHERE predicted_price IS NOT NULL)
      SELECT group_desc, count(*) AS n, {rnd(f"avg({ape('a', 'p')})", 5)} AS mape,
             {rnd(f"100 * avg({ape('a', 'p')})", 5)} AS mape_pct, {rnd('avg((a - p) * (a - p))', -4)} AS mse,
             {rnd('avg(abs(a - p))', 5)} AS mae,
             {rnd('1 - avg((a - p) * (a - p)) / var_pop(a)', 5)} AS r2
      FROM pairs GROUP BY 1""",
    "actual_vs_pred_long": f"""WITH {ar_matrix(lags=q.SHORT_LAGS.lags)}
      SELECT rm_code, month_idx, ts >= TIMESTAMP '{q.CUT}' AS is_forecast, 'ground_truth' AS kind,
             average_price AS value FROM ar_matrix
      UNION ALL
      SELECT rm_code, month_idx, ts >= TIMESTAMP '{q.CUT}', 'prediction', AR_1 FROM ar_matrix""",
    "standardize_train": f"""WITH {ar_matrix('l_suppkey')}, {TEST_WINDOWS},{TRAIN_TEST}
      SELECT rm_code, test, month_idx, is_test, {rnd(zscore('average_price'))} AS average_price,
             {rnd(zscore('AR_1'))} AS AR_1
      FROM rows""",
    "robust_scale": f"""WITH {ar_matrix('l_suppkey')},
      quartiles AS (
        SELECT rm_code, {", ".join(
          f"quantile_cont({c}, {p}) AS q{k}_{c}" for c in ("average_price", "AR_1")
          for k, p in ((1, 0.25), (2, 0.5), (3, 0.75)))}
        FROM ar_matrix GROUP BY 1)
      SELECT rm_code, month_idx, {rnd(robust('average_price'))} AS average_price, {rnd(robust('AR_1'))} AS AR_1
      FROM ar_matrix JOIN quartiles USING (rm_code)""",
    "hash_split": f"""WITH {panel()}
      SELECT rm_code, month_idx, is_imputed,
             CAST('0x' || substr(md5(concat_ws('|', rm_code, month_idx, '{q.SPLIT_SEED}')), 1, 8) AS BIGINT) % 100
               < {q.TEST_PERCENT} AS is_test
      FROM panel""",
    "lasso_univariate": f"""WITH {ar_matrix('l_suppkey')}, {TEST_WINDOWS},{TRAIN_TEST}, scores AS ({LASSO_ONE})
      SELECT rm_code, horizon, test, n_train, n_test, {rnd('beta', 5)} AS beta, {rnd('mape_pct', 5)} AS mape_pct
      FROM scores""",
    "backtest_cells": f"""WITH {ar_matrix('l_suppkey')}, {TEST_WINDOWS},
      counts AS (
        SELECT c.rm_code, w.test,
               CAST(count(*) FILTER (f.ts < w.a) AS INTEGER) AS n_train,
               CAST(count(*) FILTER (f.ts >= w.a AND f.ts < w.b) AS INTEGER) AS n_test
        FROM (SELECT DISTINCT rm_code FROM ar_matrix) c CROSS JOIN windows w
        JOIN ar_matrix f ON f.rm_code = c.rm_code GROUP BY 1, 2)
      SELECT rm_code, horizon, test, n_train, n_test,
             CASE WHEN n_train < 10 THEN 'too few training rows' WHEN n_test = 0 THEN 'no test rows'
                  ELSE 'ok' END AS status
      FROM counts CROSS JOIN (VALUES {", ".join(f"(CAST({h} AS INTEGER))" for h in HORIZONS)}) h(horizon)""",
    "lasso_search_single_lag": f"""WITH {ar_matrix('l_suppkey')}, {TEST_WINDOWS}, {SEARCH}
      SELECT rm_code, horizon, test, n_train, n_test, status, {rnd('alpha', 5)} AS alpha, {rnd('cv_r2', 5)} AS cv_r2,
             {rnd('mape_pct', 4)} AS mape_pct, {rnd('coef', 5)} AS coef
      FROM models""",
    "coef_export_single_lag": f"""WITH {ar_matrix('l_suppkey')}, {TEST_WINDOWS}, {SEARCH}
      SELECT rm_code, horizon, test, {", ".join(
          f"CASE WHEN horizon = {h} THEN {rnd('coef', 5)} END AS AR_{h}" for h in HORIZONS)}
      FROM models WHERE status = 'ok'""",
    "backtest_matrix_single_lag": f"""WITH {ar_matrix('l_suppkey')}, {TEST_WINDOWS}, {SEARCH},
      scores AS (
        SELECT rm_code, s AS feature_set, horizon, mape_pct
        FROM models, (VALUES ('AR'), ('ALL')) v(s) WHERE status = 'ok' AND horizon = 1
        UNION ALL SELECT rm_code, 'NAIVE', horizon, mape_pct FROM ({PERSISTENCE}) WHERE horizon = 1)
      SELECT rm_code, feature_set, horizon, count(*) AS n_windows, {rnd('avg(mape_pct)', 3)} AS mape_pct
      FROM scores GROUP BY 1, 2, 3""",
    "lasso_search_two_lags": f"""WITH {ar_matrix('l_suppkey')}, {TEST_WINDOWS}, {search_two('ar_matrix', 'AR_{h}', 'AR_{next}')}
      SELECT {TWO_SHOWN} FROM models""",
    "lasso_search_with_driver": f"{WITH_DRIVER} SELECT {TWO_SHOWN} FROM models",
    "coef_export_with_driver": f"""{WITH_DRIVER}
      SELECT rm_code, horizon, test, {", ".join(
          f"CASE WHEN horizon = {h} THEN {rnd(f'coef_{k}', 5)} END AS {name}_{h}"
          for h in HORIZONS for k, name in ((1, q.PAIR_DRIVER), (2, 'AR')))}
      FROM models WHERE status = 'ok'""",
    "backtest_matrix_with_driver": f"""WITH {SUPPLIER_FEATURES}, {TEST_WINDOWS},
      {search_two('features', 'AR_{h}', '0', [1], 'ar_')}, {search_two('features', q.PAIR_DRIVER + '_{h}', 'AR_{h}', [1])},
      scores AS (
        SELECT rm_code, 'AR' AS feature_set, horizon, mape_pct FROM ar_models WHERE status = 'ok'
        UNION ALL SELECT rm_code, 'ALL', horizon, mape_pct FROM models WHERE status = 'ok'
        UNION ALL SELECT rm_code, 'NAIVE', horizon, mape_pct FROM (
          {PERSISTENCE.replace('ar_matrix f', 'features f')}) WHERE horizon = 1)
      SELECT rm_code, feature_set, horizon, count(*) AS n_windows, {rnd('avg(mape_pct)', 3)} AS mape_pct
      FROM scores GROUP BY 1, 2, 3""",
    "lasso_forecasts": f"""{WITH_DRIVER}
      SELECT rm_code, 'ALL' AS feature_set, horizon, test, month_idx, ts, actual, {rnd('predicted', 3)} AS predicted
      FROM forecasts""",
    "forecasts_by_code": f"""{WITH_DRIVER}
      SELECT rm_code, horizon, test, count(*) AS n_test, {rnd(f"100 * avg({ape('actual', 'predicted')})", 4)} AS mape_pct
      FROM forecasts GROUP BY 1, 2, 3""",
    "lasso_actual_vs_predicted": f"""{WITH_DRIVER}
      SELECT rm_code, horizon, test, month_idx, ts >= TIMESTAMP '{q.CUT}' AS is_forecast, 'ground_truth' AS kind,
             {rnd('actual', 3)} AS value FROM forecasts
      UNION ALL
      SELECT rm_code, horizon, test, month_idx, ts >= TIMESTAMP '{q.CUT}', 'prediction', {rnd('predicted', 3)} FROM forecasts""",
    "lasso_largest_errors": f"""{WITH_DRIVER}
      SELECT rm_code, horizon, test, month_idx, actual, {rnd('predicted', 3)} AS predicted,
             {rnd('abs(actual - predicted)', 3)} AS abs_error
      FROM forecasts ORDER BY {rnd('abs(actual - predicted)', 3)} DESC, rm_code, horizon, test, month_idx LIMIT {q.TOP_K}""",
    "lasso_optimality": f"""WITH {SUPPLIER_FEATURES}, {TEST_WINDOWS},
      counts AS (
        SELECT f.rm_code, w.test, count(*) FILTER (f.ts < w.a) AS n_train,
               count(*) FILTER (f.ts >= w.a AND f.ts < w.b) AS n_test
        FROM features f CROSS JOIN windows w GROUP BY 1, 2)
      SELECT rm_code, s AS feature_set, horizon, test, n_train, CAST(({LAGS.last} + 1 - horizon) * m AS INTEGER) AS n_columns,
             TRUE AS is_optimal, TRUE AS has_its_scales
      FROM counts CROSS JOIN (VALUES {", ".join(f"(CAST({h} AS INTEGER))" for h in HORIZONS)}) h(horizon)
      CROSS JOIN (VALUES ('AR', 1), ('ALL', {len(DRIVERS) + 1})) v(s, m)
      WHERE n_train >= 10 AND n_test > 0""",
    "pooled_lasso_two_features": f"""WITH {FEATURES.replace(ar_matrix(), ar_matrix('p_brand'))},
      split AS (
        SELECT rm_code, AR_1 AS u, {q.PAIR_DRIVER}_1 AS v, average_price AS y,
               {digest('rm_code', 'month_idx', f"'{q.SPLIT_SEED}'")} % 100 < {q.TEST_PERCENT} AS is_test,
               {digest('rm_code', 'month_idx', "'1'")} % 5 AS fold
        FROM features),
      scales AS (SELECT {", ".join(f"avg({x}) AS m{x}, stddev_pop({x}) AS s{x}" for x in "uvy")} FROM split WHERE NOT is_test),
      train AS (SELECT fold, {", ".join(f"({x} - m{x}) / s{x} AS {x}" for x in "uvy")} FROM split, scales WHERE NOT is_test),
      sides AS (
        SELECT k.fold, {", ".join(f"avg({x}) FILTER (t.fold <> k.fold) AS {x}m, avg({x}) FILTER (t.fold = k.fold) AS {x}h" for x in "uvy")},
               var_pop(u) FILTER (t.fold <> k.fold) AS g1, var_pop(v) FILTER (t.fold <> k.fold) AS g2,
               covar_pop(u, v) FILTER (t.fold <> k.fold) AS g12, covar_pop(u, y) FILTER (t.fold <> k.fold) AS c1,
               covar_pop(v, y) FILTER (t.fold <> k.fold) AS c2, var_pop(u) FILTER (t.fold = k.fold) AS h1,
               var_pop(v) FILTER (t.fold = k.fold) AS h2, covar_pop(u, v) FILTER (t.fold = k.fold) AS h12,
               covar_pop(u, y) FILTER (t.fold = k.fold) AS r1, covar_pop(v, y) FILTER (t.fold = k.fold) AS r2,
               var_pop(y) FILTER (t.fold = k.fold) AS vy
        FROM train t CROSS JOIN (SELECT unnest(range(5)) AS fold) k GROUP BY k.fold),
      {ALPHAS},
      fits AS (SELECT s.*, i, alpha, {two_weights()} AS w FROM sides s CROSS JOIN alphas),
      chosen AS (
        SELECT i, any_value(alpha) AS alpha, avg(1 - (vy - 2 * (w[1] * r1 + w[2] * r2) + w[1] * w[1] * h1 + 2 * w[1] * w[2] * h12
               + w[2] * w[2] * h2 + (yh - ym - w[1] * (uh - um) - w[2] * (vh - vm)) ** 2) / vy) AS cv_r2
        FROM fits GROUP BY i ORDER BY round(cv_r2, 9) DESC, i LIMIT 1),
      products AS (
        SELECT any_value(alpha) AS alpha, var_pop(u) AS g1, var_pop(v) AS g2, covar_pop(u, v) AS g12,
               covar_pop(u, y) AS c1, covar_pop(v, y) AS c2
        FROM train, chosen),
      model AS (SELECT {two_weights()} AS w FROM products),
      scored AS (
        SELECT rm_code, is_test, y, my + sy * (w[1] * (u - mu) / su + w[2] * (v - mv) / sv) AS p
        FROM split, scales, model)
      SELECT rm_code, is_test, count(*) AS n, {rnd(f"avg({ape('y', 'p')})", 4)} AS mape,
             {rnd(f"100 * avg({ape('y', 'p')})", 2)} AS mape_pct, {rnd('avg((y - p) * (y - p))', -4)} AS mse,
             {rnd('avg(abs(y - p))', 1)} AS mae, {rnd('1 - avg((y - p) * (y - p)) / nullif(var_pop(y), 0)', 4)} AS r2
      FROM scored GROUP BY 1, 2""",
    "request_features": f"""WITH {ar_matrix('p_brand', range(1, 5))},{SERIES},
      asked AS (SELECT month_idx, URGENT, HIGH FROM wide WHERE URGENT IS NOT NULL)
      SELECT a.rm_code, 'goods' AS group_desc, a.month_idx, a.ts, a.average_price,
             {", ".join(f"a.AR_{i}, l{i}.URGENT AS URGENT_{i}, l{i}.HIGH AS HIGH_{i}" for i in range(1, 5))},
             {flagged('a.rm_code')}
      FROM ar_matrix a {" ".join(f"JOIN asked l{i} ON l{i}.month_idx = a.month_idx - {i}" for i in range(1, 5))}
      WHERE {" AND ".join(f"l{i}.HIGH IS NOT NULL" for i in range(1, 5))}""",
    "feature_sink_scan": f"""WITH {FEATURES}
      SELECT rm_code, lower(p_type) AS group_desc, month_idx, ts, {", ".join(["average_price", *AR_COLUMNS])},
             {", ".join(DRIVER_COLUMNS)}
      FROM features JOIN part ON rm_code = p_partkey""",
    "feature_scan_of_a_group": f"""WITH {ar_matrix(lags=q.SHORT_LAGS.lags)}
      SELECT rm_code, lower(p_type) AS group_desc, month_idx, ts, average_price,
             {", ".join(f"AR_{i}" for i in q.SHORT_LAGS.lags)}
      FROM ar_matrix JOIN part ON rm_code = p_partkey WHERE lower(p_type) = '{q.TARGET}'""",
    "model_reload": f"""WITH {ar_matrix('l_suppkey')},{DRIVER_LAGS},
      split AS (
        SELECT a.rm_code, CAST('0x' || substr(md5(concat_ws('|', a.rm_code, a.month_idx, '{q.SPLIT_SEED}')), 1, 8) AS BIGINT)
               % 100 < {q.TEST_PERCENT} AS is_test
        FROM ar_matrix a JOIN driver_lags d ON a.month_idx = d.month_idx
        WHERE {" AND ".join(f"{c} IS NOT NULL" for c in DRIVER_COLUMNS)})
      SELECT rm_code, is_test, count(*) AS n, count(*) AS n_finite, CAST(0 AS BIGINT) AS n_changed FROM split GROUP BY 1, 2""",
    "quality_findings": f"""WITH odd AS (
        SELECT l_suppkey AS rm_code, lower(p_type) AS group_desc,
               CASE WHEN l_quantity > 1 THEN l_shipdate END AS ts,
               CASE WHEN l_quantity < 50 THEN floor(100 * l_extendedprice / l_quantity + 0.5) - 100000 END AS price
        FROM lineitem JOIN part ON l_partkey = p_partkey),
      codes AS (SELECT rm_code, max(group_desc) AS g FROM odd GROUP BY 1)
      SELECT 'is_empty' AS check, CAST(count(*) = 0 AS BIGINT) AS violations FROM odd
      UNION ALL SELECT 'null_ts', count(*) FROM odd WHERE ts IS NULL
      UNION ALL SELECT 'null_price', count(*) FROM odd WHERE price IS NULL
      UNION ALL SELECT 'null_group_desc', count(*) FROM odd WHERE group_desc IS NULL
      UNION ALL SELECT 'null_rm_code', count(*) FROM odd WHERE rm_code IS NULL
      UNION ALL SELECT 'price_not_positive', count(*) FROM odd WHERE price <= 0
      UNION ALL SELECT 'code_in_several_groups', count(*) FROM (
        SELECT rm_code FROM odd GROUP BY 1 HAVING count(DISTINCT group_desc) > 1)
      UNION ALL SELECT 'code_not_found', {len(q.REQUESTED)} - count(*) FROM codes WHERE rm_code IN {tuple(q.REQUESTED)}
      UNION ALL SELECT 'code_outside_target', count(*) FROM codes
        WHERE rm_code IN {tuple(q.REQUESTED)} AND g IS DISTINCT FROM '{q.TARGET}'""",
    "quality_report": f"""WITH {FEATURES},
      clean AS (
        SELECT l_shipdate AS ts, lower(p_type) AS group_desc, l_partkey AS rm_code,
               floor(100 * l_extendedprice / l_quantity + 0.5) AS price
        FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)
      SELECT 'ledger' AS stage, 'is_empty' AS check, CAST(count(*) = 0 AS BIGINT) AS violations FROM clean
      UNION ALL SELECT 'ledger', 'null_ts', count(*) FROM clean WHERE ts IS NULL
      UNION ALL SELECT 'ledger', 'null_price', count(*) FROM clean WHERE price IS NULL
      UNION ALL SELECT 'ledger', 'null_group_desc', count(*) FROM clean WHERE group_desc IS NULL
      UNION ALL SELECT 'ledger', 'null_rm_code', count(*) FROM clean WHERE rm_code IS NULL
      UNION ALL SELECT 'ledger', 'price_not_positive', count(*) FROM clean WHERE price <= 0
      UNION ALL SELECT 'ledger', 'code_in_several_groups', count(*) FROM (
        SELECT rm_code FROM clean GROUP BY 1 HAVING count(DISTINCT group_desc) > 1)
      UNION ALL SELECT 'drivers', 'is_empty', CAST(count(*) = 0 AS BIGINT) FROM series
      UNION ALL SELECT 'drivers', 'null_driver_value', count(*) FROM series WHERE value IS NULL
      UNION ALL SELECT 'drivers', 'driver_not_found', {len(DRIVERS)} - count(DISTINCT driver) FROM series
      UNION ALL SELECT 'matrix_of_panel', 'rows_added',
        greatest((SELECT count(*) FROM features) - (SELECT count(*) FROM panel), 0)
      UNION ALL SELECT 'interactions_of_matrix', 'rows_changed', CAST(0 AS BIGINT)
      UNION ALL SELECT 'features', 'is_empty', CAST(count(*) = 0 AS BIGINT) FROM features
      UNION ALL SELECT 'features', 'null_average_price', count(*) FROM features WHERE average_price IS NULL
      {" ".join(f"UNION ALL SELECT 'features', 'null_{c}', count(*) FROM features WHERE {c} IS NULL"
                for c in [*DRIVER_COLUMNS, *AR_COLUMNS])}
      UNION ALL SELECT 'features', 'imputed_target', count(*) FROM features f
        JOIN panel p ON p.rm_code = f.rm_code AND p.month_idx = f.month_idx WHERE p.is_imputed""",
}
