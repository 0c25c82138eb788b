"""Pieces of the queries' DuckDB SQL."""

TICKS = """ticks AS (SELECT event_type AS symbol, CAST(floor(epoch(ts)) AS BIGINT) AS time, event_id AS tick_id, value + 1.0 AS price,
CAST(regexp_extract(props, '\"k\": *(\\d+)', 1) AS BIGINT) AS volume FROM events)"""


def tick_bars(seconds: int, source: str = "ticks", out: str = "bars") -> str:
    t = f"time - time % {seconds}"
    return f"{out} AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS bar_seq FROM (SELECT symbol, {t} AS time, first(price ORDER BY time, tick_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY time, tick_id) AS close, CAST(sum(volume) AS BIGINT) AS tick_volume, count(*) AS n FROM {source} GROUP BY symbol, {t}))"


BARS = f"{TICKS}, {tick_bars(3600)}"
DAILY_TICKS = """daily_ticks AS (SELECT o_orderpriority AS symbol, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS time, o_orderkey AS tick_id,
o_totalprice / 1000.0 + 1.0 AS price, 1 AS volume FROM orders)"""
DAILY = f"{DAILY_TICKS}, {tick_bars(86400, 'daily_ticks', 'daily')}"
SERIES = "OVER (PARTITION BY symbol ORDER BY bar_seq"


def day(t: str) -> str:
    return f"(DATE '1970-01-01' + CAST(({t}) // 86400 AS INTEGER))"


def hour(t: str) -> str:
    return f"CAST(({t}) % 86400 // 3600 AS INTEGER)"


def sunday(d: str, month: int, n: int) -> str:
    first = f"make_date(year({d}), {month}, 1)"
    return f"({first} + CAST((7 - dayofweek({first})) % 7 + {7 * (n - 1)} AS INTEGER))"


def last_sunday(d: str, month: int) -> str:
    end = f"make_date(year({d}), {month}, 31)"
    return f"({end} - CAST(dayofweek({end}) AS INTEGER))"


def eu(d: str) -> str:
    return f"({d} >= {last_sunday(d, 3)} AND {d} < {last_sunday(d, 10)})"


def us(d: str) -> str:
    return f"({d} >= {sunday(d, 3, 2)} AND {d} < {sunday(d, 11, 1)})"


def offset(d: str) -> str:
    return f"(CASE WHEN {eu(d)} THEN 3 ELSE 2 END)"


def break_hour(d: str) -> str:
    return f"(CASE WHEN {us(d)} AND NOT {eu(d)} THEN 23 ELSE 0 END)"


HOLIDAYS = """years AS (SELECT CAST(y AS INTEGER) AS y FROM range(1994, 2026) t(y)),
golden AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM years),
moon AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM golden),
week AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM moon),
easter AS (SELECT y, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS n FROM week),
holidays AS (
  SELECT make_date(y, 1, 1) AS day, 'New Year' AS name FROM years
  UNION ALL SELECT make_date(y, 1, 1) + CAST((8 - dayofweek(make_date(y, 1, 1))) % 7 + 14 AS INTEGER), 'Martin Luther King' FROM years
  UNION ALL SELECT make_date(y, 2, 1) + CAST((8 - dayofweek(make_date(y, 2, 1))) % 7 + 14 AS INTEGER), 'Presidents' FROM years
  UNION ALL SELECT make_date(y, n // 31, n % 31 + 1) - 2, 'Good Friday' FROM easter
  UNION ALL SELECT make_date(y, 5, 31) - CAST((dayofweek(make_date(y, 5, 31)) + 6) % 7 AS INTEGER), 'Memorial' FROM years
  UNION ALL SELECT make_date(y, 6, 19), 'Juneteenth' FROM years WHERE y >= 2022
  UNION ALL SELECT make_date(y, 7, 4), 'Independence' FROM years
  UNION ALL SELECT make_date(y, 9, 1) + CAST((8 - dayofweek(make_date(y, 9, 1))) % 7 AS INTEGER), 'Labor' FROM years
  UNION ALL SELECT make_date(y, 11, 1) + CAST((11 - dayofweek(make_date(y, 11, 1))) % 7 + 21 AS INTEGER), 'Thanksgiving' FROM years
  UNION ALL SELECT make_date(y, 12, 25), 'Christmas' FROM years)"""


def near(tolerance: int, out: str = "near") -> str:
    return f"{out} AS (SELECT h.day + CAST(s AS INTEGER) AS day, arg_min(h.name, (h.day, h.name)) AS holiday FROM holidays h, range(-{tolerance}, {tolerance + 1}) t(s) GROUP BY 1)"


GAPS = f"""{HOLIDAYS}, {near(2)},
found AS (SELECT symbol, time AS before, after, (after - time) // 3600 - 1 AS missing FROM (SELECT *, lead(time) {SERIES}) AS after FROM bars) WHERE after - time > 3600),
gaps AS (SELECT g.symbol, g.before, g.after, g.missing, CASE
  WHEN {day("g.before")} < DATE '2015-09-11' THEN 'out_of_window'
  WHEN floor((g.after // 86400 - 2) / 7.0) > floor((g.before // 86400 - 3) / 7.0) THEN 'weekend'
  WHEN g.missing = 1 AND {hour("g.before")} = ({break_hour(day("g.before"))} + 23) % 24 THEN 'daily_break'
  WHEN coalesce(hb.holiday, ha.holiday) IS NOT NULL AND g.missing >= 20 THEN 'holiday'
  WHEN coalesce(hb.holiday, ha.holiday) IS NOT NULL AND (({break_hour(day("g.before"))} - {hour("g.before")} - 1 + 24) % 24 < g.missing OR {hour("g.after")} = {break_hour(day("g.before"))} OR {hour("g.after")} = ({break_hour(day("g.before"))} + 1) % 24) THEN 'early_close'
  ELSE 'unknown' END AS cause
  FROM found g LEFT JOIN near hb ON hb.day = {day("g.before")} LEFT JOIN near ha ON ha.day = {day("g.after")})"""
VALID = f"""{BARS}, {GAPS},
bad AS (SELECT symbol, before AS time FROM gaps WHERE cause = 'unknown' UNION SELECT symbol, after FROM gaps WHERE cause = 'unknown'),
checked AS (SELECT b.*, x.time IS NULL AS valid FROM bars b LEFT JOIN bad x USING (symbol, time))"""


def whole(a: int, b: int) -> str:
    frame = f"ROWS BETWEEN {abs(a)} PRECEDING AND {b} FOLLOWING" if a else f"ROWS BETWEEN CURRENT ROW AND {b} FOLLOWING"
    return f"(sum(CASE WHEN valid THEN 0 ELSE 1 END) {SERIES} {frame}) = 0 AND count(*) {SERIES} {frame}) = {b - a + 1})"


def trailing(expr: str, n: int) -> str:
    return f"{expr} {SERIES} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


STEPS = f"steps AS (SELECT *, ln(close / lag(close) {SERIES})) AS step FROM bars)"
ATR = f"""ranges AS (SELECT *, greatest(high - low, abs(high - lag(close) {SERIES})), abs(low - lag(close) {SERIES}))) AS tr FROM bars),
seeds AS (SELECT symbol, avg(tr) AS seed FROM ranges WHERE bar_seq BETWEEN 1 AND 14 GROUP BY symbol HAVING count(tr) = 14),
walk(symbol, bar_seq, atr) AS (SELECT symbol, CAST(14 AS BIGINT), seed FROM seeds
  UNION ALL SELECT r.symbol, r.bar_seq, w.atr * 13 / 14 + r.tr / 14 FROM walk w JOIN ranges r ON r.symbol = w.symbol AND r.bar_seq = w.bar_seq + 1),
with_atr AS (SELECT b.*, w.atr FROM bars b LEFT JOIN walk w USING (symbol, bar_seq))"""
