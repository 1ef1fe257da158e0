"""SQL for the queries whose result SQL can state; folds become recursive queries."""

from __future__ import annotations


def bars(name: str, table: str, symbol: str, ts: str, price: str, size: str, tie: str, seconds: int, interval: str) -> str:
    return f"""{name} AS (
  SELECT symbol, '{interval}' AS interval, open_time, open_time + INTERVAL {seconds * 1000 - 1} MILLISECONDS AS close_time,
         arg_min(price, ord) AS open, max(price) AS high, min(price) AS low, arg_max(price, ord) AS close,
         round(sum(size), 4) AS volume, round(sum(price * size), 4) AS quote_volume, count(*) AS trade_count
  FROM (SELECT {symbol} AS symbol, CAST({price} AS DOUBLE) AS price, CAST({size} AS DOUBLE) AS size,
               row_number() OVER (ORDER BY {ts}, {tie}) AS ord,
               make_timestamp(CAST(floor(epoch(CAST({ts} AS TIMESTAMP)) / {seconds}) AS BIGINT) * {seconds} * 1000000) AS open_time
        FROM {table})
  GROUP BY symbol, open_time
)"""


HOURLY = bars("hourly", "events", "'ALL'", "ts", "value", "1", "event_id", 3600, "1h")
BY_TYPE = bars("by_type", "events", "event_type", "ts", "value", "1", "event_id", 14400, "4h")
BY_USER = bars("by_user", "events", "CAST(user_id AS VARCHAR)", "ts", "value", "1", "event_id", 3600, "1h")
LINES = bars("lines", "lineitem", "l_returnflag || '/' || l_linestatus", "l_shipdate", "l_extendedprice", "l_quantity", "l_orderkey, l_linenumber", 604800, "1w")
DAILY = bars("daily", "orders", "o_orderpriority", "o_orderdate", "o_totalprice", "1", "o_orderkey", 86400, "1d")

WALK = bars(
    "walk", "(SELECT *, CAST(100000 + sum(CAST(round(value * 100) AS BIGINT) % 201 - 100) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS price FROM events)",
    "'walk/' || event_type", "ts", "price", "1", "event_id", 3600, "1h",
)

# Inclusion removal: a row per raw bar with the state after it; the last state of a merged bar is it.
MERGED = """b AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, interval ORDER BY open_time) - 1 AS pos FROM src
), inc(symbol, interval, pos, mpos, h1, h2, l2, o2, c2, d2, n2, f2, e2) AS (
  SELECT symbol, interval, pos, CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), high, low, open, close, open_time, CAST(1 AS BIGINT), open_time, open_time FROM b WHERE pos = 0
  UNION ALL
  SELECT symbol, interval, pos, mpos + CASE WHEN m THEN 0 ELSE 1 END, CASE WHEN m THEN h1 ELSE h2 END,
         CASE WHEN m THEN nh ELSE high END, CASE WHEN m THEN nl ELSE low END,
         CASE WHEN NOT m THEN open WHEN open > close THEN nh ELSE nl END, CASE WHEN NOT m THEN close WHEN open > close THEN nl ELSE nh END,
         CASE WHEN m AND keep THEN d2 ELSE open_time END, CASE WHEN m THEN n2 + 1 ELSE 1 END, CASE WHEN m THEN f2 ELSE open_time END, open_time
  FROM (
    SELECT b.symbol, b.interval, b.pos, i.mpos, i.h1, i.h2, i.d2, i.n2, i.f2, b.open, b.close, b.high, b.low, b.open_time,
           i.h1 IS NOT NULL AND i.h1 <> i.h2 AND ((b.high <= i.h2 AND b.low >= i.l2) OR (b.high >= i.h2 AND b.low <= i.l2)) AS m,
           CASE WHEN i.h1 < i.h2 THEN greatest(i.h2, b.high) ELSE least(i.h2, b.high) END AS nh,
           CASE WHEN i.h1 < i.h2 THEN greatest(i.l2, b.low) ELSE least(i.l2, b.low) END AS nl,
           CASE WHEN i.h1 < i.h2 THEN i.h2 > b.high ELSE i.l2 < b.low END AS keep
    FROM inc i JOIN b ON b.symbol = i.symbol AND b.interval = i.interval AND b.pos = i.pos + 1
  )
), merged AS (
  SELECT symbol, interval, mpos, arg_max(d2, pos) AS dt, arg_max(o2, pos) AS open, arg_max(h2, pos) AS high, arg_max(l2, pos) AS low, arg_max(c2, pos) AS close,
         max(n2) AS raw_count, arg_max(f2, pos) AS first_dt, max(e2) AS last_dt
  FROM inc GROUP BY symbol, interval, mpos
), sides AS (
  SELECT *, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lead(high) OVER w AS nh, lead(low) OVER w AS nl FROM merged
  WINDOW w AS (PARTITION BY symbol, interval ORDER BY mpos)
), fractal AS (
  SELECT symbol, interval, mpos, dt, high, low, CASE WHEN high > ph THEN 'G' ELSE 'D' END AS mark, CASE WHEN high > ph THEN high ELSE low END AS value
  FROM sides WHERE (high > ph AND high > nh AND low > pl AND low > nl) OR (high < ph AND high < nh AND low < pl AND low < nl)
)"""

CHAIN = """runs AS (
  SELECT *, sum(CASE WHEN p <> mark THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, interval ORDER BY mpos) AS run
  FROM (SELECT *, lag(mark) OVER (PARTITION BY symbol, interval ORDER BY mpos) AS p FROM fractal)
), ends AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, interval, run ORDER BY CASE WHEN mark = 'G' THEN value ELSE -value END DESC, mpos DESC) AS rn FROM runs) WHERE rn = 1
), unit AS (
  SELECT symbol, interval, row_number() OVER (PARTITION BY symbol, interval ORDER BY mpos) - 1 AS pos, CASE WHEN mark = 'D' THEN 'up' ELSE 'down' END AS direction,
         dt AS start_dt, value AS start_value, end_dt, end_value, greatest(value, end_value) AS high, least(value, end_value) AS low, end_mpos - mpos + 3 AS length
  FROM (SELECT *, lead(dt) OVER w AS end_dt, lead(value) OVER w AS end_value, lead(mpos) OVER w AS end_mpos FROM ends WINDOW w AS (PARTITION BY symbol, interval ORDER BY mpos)) WHERE end_dt IS NOT NULL
)"""

MACD = """macd(symbol, interval, pos, open_time, f, s, dea, hist) AS (
  SELECT symbol, interval, pos, open_time, close, close, 0e0, 0e0 FROM b WHERE pos = 0
  UNION ALL
  SELECT symbol, interval, pos, open_time, f, s, 2e0 / 10e0 * (f - s) + (1e0 - 2e0 / 10e0) * dea, 2e0 * ((f - s) - (2e0 / 10e0 * (f - s) + (1e0 - 2e0 / 10e0) * dea))
  FROM (SELECT b.symbol, b.interval, b.pos, b.open_time, m.dea, 2e0 / 13e0 * b.close + (1e0 - 2e0 / 13e0) * m.f AS f, 2e0 / 27e0 * b.close + (1e0 - 2e0 / 27e0) * m.s AS s
        FROM macd m JOIN b ON b.symbol = m.symbol AND b.interval = m.interval AND b.pos = m.pos + 1)
)"""

AREA = """area AS (
  SELECT u.symbol, u.interval, u.pos,
         coalesce(sum(CASE WHEN u.direction = 'down' AND m.hist < 0 THEN -m.hist WHEN u.direction = 'up' AND m.hist > 0 THEN m.hist ELSE 0 END), 0) AS area
  FROM unit u LEFT JOIN macd m ON m.symbol = u.symbol AND m.interval = u.interval AND m.open_time BETWEEN u.start_dt AND u.end_dt
  GROUP BY u.symbol, u.interval, u.pos
)"""

# Stroke-zone groups: state is the group, its rank and its range.
GROUPS = """grp(symbol, interval, pos, g, r, zg, zd) AS (
  SELECT symbol, interval, pos, CAST(0 AS BIGINT), CAST(1 AS BIGINT), high, low FROM unit WHERE pos = 0
  UNION ALL
  SELECT symbol, interval, pos, CASE WHEN apart THEN g + 1 ELSE g END, CASE WHEN apart THEN 1 ELSE r + 1 END,
         CASE WHEN apart THEN high WHEN r < 3 THEN least(zg, high) ELSE zg END, CASE WHEN apart THEN low WHEN r < 3 THEN greatest(zd, low) ELSE zd END
  FROM (SELECT u.*, x.g, x.r, x.zg, x.zd, CASE WHEN u.direction = 'up' THEN u.high < x.zd ELSE u.low > x.zg END AS apart
        FROM grp x JOIN unit u ON u.symbol = x.symbol AND u.interval = x.interval AND u.pos = x.pos + 1)
)"""

# Segment zones: s is the start of an open zone or null, k counts units since the last close.
SPANS = """sz(symbol, interval, pos, s, zone, zg, zd, h1, l1, h2, l2, k) AS (
  SELECT symbol, interval, pos, CAST(NULL AS BIGINT), CAST(-1 AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), high, low, CAST(1 AS BIGINT) FROM unit WHERE pos = 0
  UNION ALL
  SELECT symbol, interval, pos, CASE WHEN stay THEN s WHEN opens THEN pos - 2 END, CASE WHEN opens THEN zone + 1 ELSE zone END,
         CASE WHEN stay THEN zg WHEN opens THEN nzg END, CASE WHEN stay THEN zd WHEN opens THEN nzd END, h2, l2, high, low,
         CASE WHEN stay OR opens THEN 0 WHEN s IS NOT NULL THEN 1 ELSE k + 1 END
  FROM (SELECT *, NOT stay AND s IS NULL AND k >= 2 AND nzg >= nzd AS opens FROM (
    SELECT u.symbol, u.interval, u.pos, u.high, u.low, x.s, x.zone, x.zg, x.zd, x.h2, x.l2, x.k, x.s IS NOT NULL AND u.high >= x.zd AND u.low <= x.zg AS stay,
           least(u.high, x.h1, x.h2) AS nzg, greatest(u.low, x.l1, x.l2) AS nzd
    FROM sz x JOIN unit u ON u.symbol = x.symbol AND u.interval = x.interval AND u.pos = x.pos + 1))
), span AS (
  SELECT symbol, interval, zone, s AS start_pos, max(pos) AS end_pos, max(zg) AS zg, max(zd) AS zd FROM sz WHERE s IS NOT NULL GROUP BY symbol, interval, zone, s
), zone AS (
  SELECT *, CASE WHEN out THEN bgg ELSE gg END AS trend_gg, CASE WHEN out THEN bdd ELSE dd END AS trend_dd, end_pos - start_pos + CASE WHEN out THEN 0 ELSE 1 END AS trend_size FROM (
    SELECT p.symbol, p.interval, p.zone, p.start_pos, p.end_pos, p.zg, p.zd, max(u.high) AS gg, min(u.low) AS dd, max(CASE WHEN u.pos < p.end_pos THEN u.high END) AS bgg,
           min(CASE WHEN u.pos < p.end_pos THEN u.low END) AS bdd, arg_max(u.end_value, u.pos) < p.zd OR arg_max(u.end_value, u.pos) > p.zg AS out
    FROM span p JOIN unit u ON u.symbol = p.symbol AND u.interval = p.interval AND u.pos BETWEEN p.start_pos AND p.end_pos
    GROUP BY p.symbol, p.interval, p.zone, p.start_pos, p.end_pos, p.zg, p.zd)
)"""

PAIRS = """pair AS (
  SELECT *, CASE WHEN gg < pdd - 1e-9 THEN 'down' WHEN dd > pgg + 1e-9 THEN 'up' END AS strict, CASE WHEN zg < pzd - 1e-9 THEN 'down' WHEN zd > pzg + 1e-9 THEN 'up' END AS core
  FROM (SELECT symbol, interval, zone, start_pos, end_pos, zg, zd, trend_gg AS gg, trend_dd AS dd, lag(zone) OVER w AS pzone, lag(end_pos) OVER w AS pend, lag(zg) OVER w AS pzg, lag(zd) OVER w AS pzd,
               lag(trend_gg) OVER w AS pgg, lag(trend_dd) OVER w AS pdd
        FROM zone WHERE trend_size >= 3 WINDOW w AS (PARTITION BY symbol, interval ORDER BY zone)) WHERE pzone IS NOT NULL
)"""

FIRST = """entry AS (
  SELECT p.symbol, p.interval, p.zone, max(u.pos) AS b FROM pair p JOIN unit u ON u.symbol = p.symbol AND u.interval = p.interval AND u.pos BETWEEN p.pend AND p.start_pos - 1 AND u.direction = p.strict
  WHERE CASE WHEN p.strict = 'down' THEN u.start_value > p.zg + 1e-9 AND u.end_value <= p.zg + 1e-9 ELSE u.start_value < p.zd - 1e-9 AND u.end_value >= p.zd - 1e-9 END
  GROUP BY p.symbol, p.interval, p.zone
), leave AS (
  SELECT p.symbol, p.interval, p.zone, u.pos AS c, u.end_value AS price FROM pair p JOIN unit u ON u.symbol = p.symbol AND u.interval = p.interval AND u.pos = p.end_pos AND u.direction = p.strict
  WHERE CASE WHEN p.strict = 'down' THEN u.start_value >= p.zd - 1e-9 AND u.end_value < p.zd - 1e-9 ELSE u.start_value <= p.zg + 1e-9 AND u.end_value > p.zg + 1e-9 END
), legs AS (
  SELECT p.symbol, p.interval, p.zone, p.strict, e.b, l.c, l.price, coalesce(l.c > e.b, FALSE) AS has,
         (SELECT min(u.low) FROM unit u WHERE u.symbol = p.symbol AND u.interval = p.interval AND u.pos >= e.b AND u.pos < l.c) AS least_low,
         (SELECT max(u.high) FROM unit u WHERE u.symbol = p.symbol AND u.interval = p.interval AND u.pos >= e.b AND u.pos < l.c) AS most_high,
         (SELECT round(max(a.area), 9) FROM area a WHERE a.symbol = p.symbol AND a.interval = p.interval AND a.pos = e.b) AS area_b,
         (SELECT round(max(a.area), 9) FROM area a WHERE a.symbol = p.symbol AND a.interval = p.interval AND a.pos = l.c) AS area_c
  FROM pair p LEFT JOIN entry e ON e.symbol = p.symbol AND e.interval = p.interval AND e.zone = p.zone LEFT JOIN leave l ON l.symbol = p.symbol AND l.interval = p.interval AND l.zone = p.zone
  WHERE p.strict IS NOT NULL
), first AS (
  SELECT symbol, interval, CASE WHEN core = 'down' THEN 'B1' ELSE 'S1' END AS point_type, 'rejected' AS status, 'RANGES_OVERLAP' AS reason, zone, CAST(NULL AS BIGINT) AS segment_pos, CAST(NULL AS DOUBLE) AS price
  FROM pair WHERE strict IS NULL AND core IS NOT NULL
  UNION ALL
  SELECT symbol, interval, CASE WHEN strict = 'down' THEN 'B1' ELSE 'S1' END,
         CASE reason WHEN 'LEGS_INCOMPLETE' THEN 'pending' WHEN 'TREND_DIVERGENCE' THEN 'confirmed' ELSE 'rejected' END, reason, zone, CASE WHEN has THEN c END, CASE WHEN has THEN price END
  FROM (SELECT *, CASE WHEN NOT has THEN 'LEGS_INCOMPLETE' WHEN NOT (CASE WHEN strict = 'down' THEN price < least_low - 1e-9 ELSE price > most_high + 1e-9 END) THEN 'NO_NEW_EXTREME'
                       WHEN NOT (area_b > 1e-9 AND area_c < area_b - 1e-9) THEN 'NO_DIVERGENCE' ELSE 'TREND_DIVERGENCE' END AS reason FROM legs)
)"""

SECOND = """second AS (
  SELECT f.symbol, f.interval, CASE WHEN f.point_type = 'B1' THEN 'B2' ELSE 'S2' END AS point_type,
         CASE WHEN r.pos IS NULL THEN 'pending' WHEN ok THEN 'confirmed' ELSE 'rejected' END AS status,
         CASE WHEN r.pos IS NULL THEN 'PULLBACK_INCOMPLETE' WHEN ok THEN 'FIRST_PULLBACK_HOLDS' ELSE 'FIRST_POINT_BROKEN' END AS reason,
         CAST(NULL AS BIGINT) AS zone, r.pos AS segment_pos, r.end_value AS price
  FROM (SELECT DISTINCT symbol, interval, point_type, segment_pos, price FROM first WHERE status = 'confirmed') f
  LEFT JOIN (SELECT *, lag(direction) OVER (PARTITION BY symbol, interval ORDER BY pos) AS before FROM unit) r ON r.symbol = f.symbol AND r.interval = f.interval AND r.pos = f.segment_pos + 2
  CROSS JOIN LATERAL (SELECT CASE WHEN f.point_type = 'B1' THEN r.before = 'up' AND r.direction = 'down' AND r.end_value >= f.price - 1e-9
                                  ELSE r.before = 'down' AND r.direction = 'up' AND r.end_value <= f.price + 1e-9 END AS ok)
)"""

THIRD = """gone AS (
  SELECT z.symbol, z.interval, z.zone, z.zg, z.zd, min(u.pos) AS dp FROM zone z JOIN unit u ON u.symbol = z.symbol AND u.interval = z.interval AND u.pos BETWEEN z.start_pos + 2 AND z.end_pos + 1
  WHERE (u.direction = 'up' AND u.end_value > z.zg + 1e-9) OR (u.direction = 'down' AND u.end_value < z.zd - 1e-9) GROUP BY ALL
), third AS (
  SELECT g.symbol, g.interval, CASE WHEN d.direction = 'up' THEN 'B3' ELSE 'S3' END AS point_type,
         CASE WHEN p.pos IS NULL THEN 'pending' WHEN (CASE WHEN d.direction = 'up' THEN p.direction = 'down' AND p.low >= g.zg - 1e-9 ELSE p.direction = 'up' AND p.high <= g.zd + 1e-9 END) THEN 'confirmed' ELSE 'rejected' END AS status,
         CASE WHEN p.pos IS NULL THEN 'PULLBACK_INCOMPLETE' WHEN (CASE WHEN d.direction = 'up' THEN p.direction = 'down' AND p.low >= g.zg - 1e-9 ELSE p.direction = 'up' AND p.high <= g.zd + 1e-9 END) THEN 'PULLBACK_STAYS_OUT' ELSE 'PULLBACK_REENTERS' END AS reason,
         g.zone, coalesce(p.pos, d.pos) AS segment_pos, coalesce(p.end_value, d.end_value) AS price
  FROM gone g JOIN unit d ON d.symbol = g.symbol AND d.interval = g.interval AND d.pos = g.dp LEFT JOIN unit p ON p.symbol = g.symbol AND p.interval = g.interval AND p.pos = g.dp + 1
)"""


# A chain with faults, each unit with the one before it that is still there.
DAMAGED = """faulty AS (
  SELECT *, lag(direction) OVER w AS pd, lag(end_dt) OVER w AS pe, lag(end_value) OVER w AS pv, row_number() OVER w AS nr
  FROM (SELECT * EXCLUDE (end_value), CASE WHEN pos % 13 = 3 THEN start_value - (end_value - start_value) ELSE end_value END AS end_value FROM unit WHERE pos % 11 <> 5)
  WINDOW w AS (PARTITION BY symbol, interval ORDER BY pos)
)"""

POINTS = """point AS (
  SELECT symbol, interval, pos, start_dt AS dt, start_value AS value, CASE WHEN direction = 'up' THEN 'D' ELSE 'G' END AS mark FROM unit
  UNION ALL
  SELECT symbol, interval, max(pos) + 1, arg_max(end_dt, pos), arg_max(end_value, pos), CASE WHEN arg_max(direction, pos) = 'up' THEN 'G' ELSE 'D' END FROM unit GROUP BY symbol, interval
)"""

SEEDS = """seed AS (
  SELECT symbol, interval, pos AS start_pos, zg, zd FROM (
    SELECT *, least(high, lead(high, 1) OVER w, lead(high, 2) OVER w) AS zg, greatest(low, lead(low, 1) OVER w, lead(low, 2) OVER w) AS zd, lead(pos, 2) OVER w AS last FROM unit WINDOW w AS (PARTITION BY symbol, interval ORDER BY pos))
  WHERE last IS NOT NULL AND zg >= zd
)"""

# The same grouping over the units behind the first group.
TAIL_GROUPS = """head AS (
  SELECT symbol, interval, max(pos) AS cut FROM grp WHERE g = 0 GROUP BY symbol, interval
), grp2(symbol, interval, pos, g, r, zg, zd) AS (
  SELECT u.symbol, u.interval, u.pos, CAST(0 AS BIGINT), CAST(1 AS BIGINT), high, low FROM unit u JOIN head h ON h.symbol = u.symbol AND h.interval = u.interval AND u.pos = h.cut + 1
  UNION ALL
  SELECT symbol, interval, pos, CASE WHEN apart THEN g + 1 ELSE g END, CASE WHEN apart THEN 1 ELSE r + 1 END,
         CASE WHEN apart THEN high WHEN r < 3 THEN least(zg, high) ELSE zg END, CASE WHEN apart THEN low WHEN r < 3 THEN greatest(zd, low) ELSE zd END
  FROM (SELECT u.*, x.g, x.r, x.zg, x.zd, CASE WHEN u.direction = 'up' THEN u.high < x.zd ELSE u.low > x.zg END AS apart
        FROM grp2 x JOIN unit u ON u.symbol = x.symbol AND u.interval = x.interval AND u.pos = x.pos + 1)
)"""


def point_rows(name: str) -> str:
    return f"""SELECT p.symbol, p.interval, p.point_type, p.status, p.reason, p.zone, p.segment_pos, u.end_dt AS dt, p.price
FROM {name} p LEFT JOIN unit u ON u.symbol = p.symbol AND u.interval = p.interval AND u.pos = p.segment_pos"""


def query(ctes: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes) + " " + select


BOTH = [HOURLY, WALK, "src AS (SELECT * FROM hourly UNION ALL SELECT * FROM walk)", MERGED, CHAIN]
ONE = [HOURLY, "src AS (SELECT * FROM hourly)", MERGED]
_Z = [*BOTH, SPANS]
_F = [*_Z, MACD, AREA, PAIRS, FIRST]

SEGMENT_FAULTS = [
    """three AS (SELECT symbol, interval, pos, greatest(low, lead(low, 1) OVER w, lead(low, 2) OVER w) <= least(high, lead(high, 1) OVER w, lead(high, 2) OVER w) + 1e-12 AND lead(low, 2) OVER w IS NOT NULL AS overlap
  FROM unit WINDOW w AS (PARTITION BY symbol, interval ORDER BY pos))""",
    """base AS (SELECT symbol, interval, pos // 3 AS k, pos AS first, direction AS d0, start_dt, start_value, e_dt, e_value FROM (
  SELECT *, lead(end_dt, 2) OVER w AS e_dt, lead(end_value, 2) OVER w AS e_value FROM unit WINDOW w AS (PARTITION BY symbol, interval ORDER BY pos)) WHERE pos % 3 = 0 AND e_value IS NOT NULL)""",
    """given AS (SELECT *, CASE WHEN k % 13 <> 6 THEN d0 WHEN d0 = 'up' THEN 'down' ELSE 'up' END AS direction, e_dt AS end_dt, e_value + CASE WHEN k % 11 = 4 THEN 1 ELSE 0 END AS end_value,
         CASE WHEN k % 17 = 4 THEN 2 ELSE 3 END AS size FROM base)""",
    """shown AS (SELECT symbol, interval, k, true AS there, first AS v_start, first + 3 + CASE WHEN k % 23 = 5 THEN 3 ELSE 0 END AS v_end, k % 2 = 0 AS at_once, (k % 2 = 1) <> (k % 29 = 3) AS gap, k % 31 <> 8 AS broken,
         k % 37 <> 9 AS reverse, first + 3 AS origin, first + 3 + CASE WHEN k % 5 = 0 THEN 6 ELSE 2 END AS seen, CASE WHEN k % 59 <> 13 THEN e_dt END AS available,
         CASE WHEN k % 41 <> 11 THEN e_dt + CASE WHEN k % 43 = 12 THEN INTERVAL (-120) HOUR ELSE INTERVAL 1 HOUR END END AS committed, CASE WHEN k % 47 = 2 THEN 0 ELSE first END AS cpos,
         first + CASE WHEN k % 53 = 20 THEN 1 ELSE 0 END AS print FROM base WHERE k % 19 <> 7)""",
    f"""placed AS (SELECT g.*, a.pos AS s, a.mark AS sm, b.pos AS e, b.mark AS em, v.* EXCLUDE (symbol, interval, k), t.overlap, u.n - 6 AS stable,
         lag(g.direction) OVER w AS pd, lag(g.end_dt) OVER w AS pe, lag(g.end_value) OVER w AS pv,
         last_value(v.committed IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c_at, last_value(v.cpos IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c_pos
  FROM given g LEFT JOIN shown v ON v.symbol = g.symbol AND v.interval = g.interval AND v.k = g.k
  LEFT JOIN point a ON a.symbol = g.symbol AND a.interval = g.interval AND a.dt = g.start_dt AND abs(a.value - g.start_value) <= 1e-12
  LEFT JOIN point b ON b.symbol = g.symbol AND b.interval = g.interval AND b.dt = g.end_dt AND abs(b.value - g.end_value) <= 1e-12
  LEFT JOIN three t ON t.symbol = g.symbol AND t.interval = g.interval AND t.pos = a.pos
  LEFT JOIN (SELECT symbol, interval, count(*) AS n FROM unit GROUP BY symbol, interval) u ON u.symbol = g.symbol AND u.interval = g.interval
  WINDOW w AS (PARTITION BY g.symbol, g.interval ORDER BY g.k))""",
    """waits AS (SELECT g.symbol, g.interval, g.k, g.direction, g.end_value, v.v_start, v.v_end, v.origin, v.seen, CASE WHEN g.direction = 'up' THEN 1 ELSE -1 END AS sign
  FROM given g JOIN shown v ON v.symbol = g.symbol AND v.interval = g.interval AND v.k = g.k WHERE NOT v.at_once)""",
    """fine AS (SELECT symbol, interval, k, endpoint, q FROM (
  SELECT symbol, interval, k, first + 5 AS endpoint, first + 6 AS q FROM base UNION ALL SELECT symbol, interval, k, first + 3, first + 5 FROM base) WHERE k % 7 <> 1 AND k % 3 <> 2)""",
    """best AS (SELECT w.symbol, w.interval, w.k, w.direction, w.sign, w.origin, c.q, max(w.sign * u.start_value) AS v, arg_max(c.endpoint, (w.sign * u.start_value, c.endpoint)) AS endpoint
  FROM waits w JOIN fine c ON c.symbol = w.symbol AND c.interval = w.interval AND c.k = w.k AND c.q > w.origin + 1 AND c.q <= w.seen AND (c.endpoint - w.v_start) % 2 = 1 AND c.endpoint - w.v_start >= 3
  JOIN unit u ON u.symbol = w.symbol AND u.interval = w.interval AND u.pos = c.endpoint
  JOIN three t ON t.symbol = w.symbol AND t.interval = w.interval AND t.pos = w.v_start AND t.overlap GROUP BY ALL)""",
    """active AS (SELECT b.symbol, b.interval, b.k, b.q, b.v, b.endpoint, max(b.sign * u.start_value) AS av, arg_max(u.pos, (b.sign * u.start_value, u.pos)) AS ap
  FROM best b JOIN unit u ON u.symbol = b.symbol AND u.interval = b.interval AND u.pos BETWEEN b.origin AND b.q AND u.direction <> b.direction GROUP BY ALL)""",
]
_SEGMENT_CODES = {
    "DIRECTION_MARK": "sm IS NOT NULL AND em IS NOT NULL AND NOT (sm = CASE WHEN direction = 'up' THEN 'D' ELSE 'G' END AND em = CASE WHEN direction = 'up' THEN 'G' ELSE 'D' END)",
    "STROKE_COUNT": "size < 3 OR size % 2 = 0", "ENDPOINT_NOT_IN_CHAIN": "NOT coalesce(e > s, false)", "STROKES_NOT_CONTIGUOUS": "e > s AND size <> e - s", "FIRST_THREE_APART": "e > s AND NOT coalesce(overlap, false)",
    "FIRST_EXTREME": """e > s AND k = 0 AND NOT coalesce(overlap AND e - s >= 3 AND (e - s) % 2 = 1 AND (SELECT CASE WHEN direction = 'up' THEN start_value <= min(p.value) FILTER (WHERE (p.pos - s) % 2 = 0) + 1e-12 AND end_value >= max(p.value) FILTER (WHERE (p.pos - s) % 2 = 1) - 1e-12
      ELSE start_value >= max(p.value) FILTER (WHERE (p.pos - s) % 2 = 0) - 1e-12 AND end_value <= min(p.value) FILTER (WHERE (p.pos - s) % 2 = 1) + 1e-12 END FROM point p WHERE p.symbol = placed.symbol AND p.interval = placed.interval AND p.pos BETWEEN s AND e), false)""",
    "OUTSIDE_STABLE_PREFIX": "e > s AND there AND v_end >= stable", "EVIDENCE_OF_ANOTHER": "e > s AND there AND print <> first", "COMMIT_MISSING": "e > s AND there AND committed IS NULL",
    "COMMIT_TIME_NOT_MONOTONIC": "e > s AND committed < c_at", "COMMIT_POSITION_NOT_MONOTONIC": "e > s AND committed IS NOT NULL AND cpos < c_pos", "CONFIRMATION_TIME_MISSING": "e > s AND committed IS NOT NULL AND available IS NULL",
    "COMMITTED_BEFORE_EVIDENCE": "e > s AND committed < available", "EVIDENCE_ENDPOINTS": "e > s AND there AND (v_start <> s OR v_end <> e)", "NO_ACTUAL_BREAK": "e > s AND there AND NOT broken",
    "NO_GAP_HAS_GAP": "e > s AND at_once AND gap", "GAP_EVIDENCE_MISSING": "e > s AND NOT at_once AND (NOT gap OR NOT reverse)", "NOT_ALTERNATING": "direction = pd", "ENDPOINT_NOT_SHARED": "start_dt <> pe OR abs(start_value - pv) > 1e-12",
}


# Two levels: the chain as strokes, every nine of them as a unit, and the strokes of each unit as a series of its own.
LEGS = [
    CHAIN.replace("unit AS (", "stroke AS ("),
    """unit AS (SELECT symbol, interval, pos // 9 AS pos, direction, start_dt, start_value, e_dt AS end_dt, e_value AS end_value, top AS high, bottom AS low, pos AS first FROM (
  SELECT *, lead(end_dt, 8) OVER w AS e_dt, lead(end_value, 8) OVER w AS e_value, max(high) OVER (w ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS top, min(low) OVER (w ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS bottom
  FROM stroke WINDOW w AS (PARTITION BY symbol, interval ORDER BY pos)) WHERE pos % 9 = 0 AND e_value IS NOT NULL)""",
]
INSIDE = [
    """piece AS (SELECT u.symbol || '#' || u.pos AS symbol, s.interval, s.pos - u.first AS pos, s.direction, s.high, s.low, u.symbol AS of, u.pos AS leg
  FROM unit u JOIN stroke s ON s.symbol = u.symbol AND s.interval = u.interval AND s.pos BETWEEN u.first AND u.first + 8)""",
    GROUPS.replace("grp", "igrp").replace("unit", "piece"),
    """inner_zone AS (SELECT of, interval, leg, count(*) AS n FROM (
  SELECT p.of, p.interval, p.leg, x.g FROM igrp x JOIN piece p ON p.symbol = x.symbol AND p.interval = x.interval AND p.pos = x.pos
  JOIN (SELECT symbol, interval, g, arg_max(zg, pos) AS zg, arg_max(zd, pos) AS zd FROM igrp GROUP BY symbol, interval, g) e ON e.symbol = x.symbol AND e.interval = x.interval AND e.g = x.g
  GROUP BY p.of, p.interval, p.leg, x.g, e.zg, e.zd
  HAVING count(*) >= 3 AND e.zg >= e.zd AND bool_and(p.high BETWEEN e.zd AND e.zg OR p.low BETWEEN e.zd AND e.zg OR (p.high >= e.zg AND p.low <= e.zd))) GROUP BY of, interval, leg)""",
    """inner_third AS (SELECT DISTINCT z.symbol, z.interval, z.zone FROM zone z JOIN unit s ON s.symbol = z.symbol AND s.interval = z.interval AND s.pos = z.end_pos
JOIN stroke a ON a.symbol = z.symbol AND a.interval = z.interval AND a.pos BETWEEN s.first AND s.first + 6 AND a.direction = s.direction
JOIN stroke b ON b.symbol = z.symbol AND b.interval = z.interval AND b.pos = a.pos + 1 AND b.direction <> s.direction
JOIN stroke c ON c.symbol = z.symbol AND c.interval = z.interval AND c.pos = a.pos + 2 AND c.direction = s.direction
WHERE CASE WHEN s.direction = 'down' THEN a.end_value < z.zd - 1e-9 AND b.high <= z.zd + 1e-9 AND c.end_value < b.start_value - 1e-9
           ELSE a.end_value > z.zg + 1e-9 AND b.low >= z.zg - 1e-9 AND c.end_value > b.start_value + 1e-9 END)""",
    """inside AS (SELECT z.symbol, z.interval, z.zone, t.zone IS NOT NULL AND coalesce(i.n, 0) >= 2 AS whole FROM zone z
  LEFT JOIN inner_third t ON t.symbol = z.symbol AND t.interval = z.interval AND t.zone = z.zone LEFT JOIN inner_zone i ON i.of = z.symbol AND i.interval = z.interval AND i.leg = z.end_pos)""",
]
OLDER_FIRST = (
    FIRST.replace("SELECT p.symbol, p.interval, p.zone, p.strict, e.b,", "SELECT p.symbol, p.interval, p.zone, p.strict, n.whole, e.b,")
    .replace("FROM pair p LEFT JOIN entry e", "FROM pair p JOIN inside n ON n.symbol = p.symbol AND n.interval = p.interval AND n.zone = p.zone LEFT JOIN entry e")
    .replace("THEN 'LEGS_INCOMPLETE' WHEN NOT (CASE", "THEN 'LEGS_INCOMPLETE' WHEN NOT whole THEN 'INSIDE_INCOMPLETE' WHEN NOT (CASE")
    .replace("CASE reason WHEN 'LEGS_INCOMPLETE' THEN 'pending'", "CASE reason WHEN 'LEGS_INCOMPLETE' THEN 'pending' WHEN 'INSIDE_INCOMPLETE' THEN 'pending'")
)


def segment_fault_rows() -> str:
    each = ", ".join(f"CASE WHEN {c} THEN '{name}' END" for name, c in _SEGMENT_CODES.items())
    return f"""SELECT symbol, interval, k AS pos, code FROM (SELECT symbol, interval, k, unnest([{each}]) AS code FROM placed) WHERE code IS NOT NULL
UNION ALL SELECT DISTINCT w.symbol, w.interval, w.k, 'GAP_ENDPOINT_SUPERSEDED' FROM waits w JOIN unit u ON u.symbol = w.symbol AND u.interval = w.interval AND u.pos BETWEEN w.v_end + 1 AND w.seen - 1
  AND u.direction <> w.direction AND w.sign * (u.start_value - w.end_value) > 1e-12
UNION ALL SELECT DISTINCT symbol, interval, k, 'SKIPPED_PRIMARY_WITHOUT_GAP' FROM active WHERE endpoint = ap OR v - av > 1e-12 OR (abs(v - av) <= 1e-12 AND endpoint > ap)
UNION ALL SELECT symbol, interval, -1, 'EVIDENCE_COUNT' FROM base GROUP BY symbol, interval HAVING count(*) FILTER (WHERE k % 19 = 7) > 0
UNION ALL SELECT symbol, interval, -1, 'CHAIN_MISMATCH' FROM base GROUP BY symbol, interval HAVING count(*) FILTER (WHERE k % 61 = 17) > 0"""


ORACLES: dict[str, str] = {
    "older_first_points": query([*BOTH[:4], *LEGS, SPANS, MACD, AREA, *INSIDE, PAIRS, OLDER_FIRST], point_rows("first")),
    "segment_faults": query([*BOTH, POINTS, *SEGMENT_FAULTS], segment_fault_rows()),
    "resample_hourly": query([HOURLY], "SELECT * FROM hourly"),
    "resample_by_type": query([BY_TYPE], "SELECT * FROM by_type"),
    "resample_weekly_lines": query([LINES], "SELECT symbol, interval, open_time, close_time, open, high, low, close, volume, trade_count FROM lines"),
    "bar_violations": """SELECT o_orderkey, code FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 7 - 1 < 0 THEN 'CLOSE_BEFORE_OPEN' WHEN high < low THEN 'HIGH_BELOW_LOW' WHEN high < p THEN 'HIGH_BELOW_BODY' WHEN low > p THEN 'LOW_ABOVE_BODY' END AS code
  FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS p, CAST(o_totalprice + o_orderkey % 5 - 1 AS DOUBLE) AS high, CAST(o_totalprice - o_orderkey % 3 + 1 AS DOUBLE) AS low FROM orders)
) WHERE code IS NOT NULL""",
    "stream_issues": query([BY_USER], """SELECT symbol, open_time, 'GAP' AS code FROM (
  SELECT symbol, open_time, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS p FROM by_user) WHERE open_time <> p + INTERVAL 1 HOUR"""),
    "continuity": query([DAILY], """SELECT symbol, interval, count(*) AS n_bars, count(*) FILTER (WHERE g) AS n_issues, count(*) FILTER (WHERE g) = 0 AS continuous,
  CASE WHEN count(*) FILTER (WHERE g) > 0 THEN 'GAP' END AS first_code, min(open_time) FILTER (WHERE g) AS first_open_time
  FROM (SELECT *, coalesce(open_time <> lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) + INTERVAL 1 DAY, FALSE) AS g FROM daily) GROUP BY symbol, interval"""),
    "bar_gaps": query([BY_USER], """SELECT symbol, interval, count(*) FILTER (WHERE s > 3600) AS gaps, count(*) FILTER (WHERE s < 3600) AS short_steps, count(*) AS n_bars
  FROM (SELECT *, epoch(open_time) - epoch(lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time)) AS s FROM by_user) GROUP BY symbol, interval"""),
    "next_open": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '5m' WHEN 1 THEN '4h' WHEN 2 THEN '3d' WHEN 3 THEN '2w' WHEN 4 THEN '1M' ELSE '7x' END AS interval,
  CASE event_id % 6 WHEN 0 THEN ts + INTERVAL 5 MINUTE WHEN 1 THEN ts + INTERVAL 4 HOUR WHEN 2 THEN ts + INTERVAL 3 DAY WHEN 3 THEN ts + INTERVAL 14 DAY WHEN 4 THEN ts + INTERVAL 1 MONTH END AS next_open,
  CAST(CASE event_id % 6 WHEN 0 THEN 300 WHEN 1 THEN 14400 WHEN 2 THEN 259200 WHEN 3 THEN 1209600 WHEN 4 THEN 2592000 END AS BIGINT) AS seconds FROM events""",
    "last_n_bars": query([BY_USER], "SELECT symbol, open_time, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS rn FROM by_user) WHERE rn <= 5"),
    "snapshot_merge": query([BY_TYPE, "e AS (SELECT max(open_time) AS end_ FROM by_type)"], """SELECT symbol, interval, open_time, close, is_closed FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, is_closed ORDER BY open_time DESC) AS rn, max(CASE WHEN is_closed THEN open_time END) OVER (PARTITION BY symbol) AS mx FROM (
    SELECT symbol, interval, open_time, CASE WHEN open_time >= end_ - INTERVAL 46 HOUR THEN close + 1 ELSE close END AS close, close_time <= end_ + INTERVAL 3 HOUR AS is_closed FROM by_type, e))
  WHERE (is_closed AND rn <= 40) OR (NOT is_closed AND rn = 1 AND (mx IS NULL OR open_time > mx))"""),
    "all_bars": query([BY_TYPE], """SELECT symbol, interval, open_time, close, is_closed FROM (
  SELECT *, max(CASE WHEN is_closed THEN open_time END) OVER (PARTITION BY symbol) AS mx FROM (
    SELECT *, CASE WHEN length(symbol) % 3 = 0 THEN n <> 2 ELSE n <> 1 END AS is_closed FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS n FROM by_type)))
  WHERE is_closed OR mx IS NULL OR open_time > mx"""),
    "revised_bars": query([BY_TYPE, """b AS (
  SELECT symbol, interval, open_time, close, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS n FROM by_type
), r AS (
  SELECT symbol, interval, open_time, close, n * 10 AS arrival FROM b UNION ALL SELECT symbol, interval, open_time, close + 1, n * 10 + 1 FROM b WHERE n % 7 = 0
  UNION ALL SELECT symbol, interval, open_time - INTERVAL 5 HOUR, close, n * 10 + 2 FROM b WHERE n % 9 = 0 AND n > 1
), f AS (
  SELECT *, coalesce(open_time < max(open_time) OVER (PARTITION BY symbol ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS late FROM r
)"""], """SELECT symbol, interval, open_time, close, arrival, CASE WHEN late THEN 'late' WHEN lead(arrival) OVER (PARTITION BY symbol, open_time, late ORDER BY arrival) IS NOT NULL THEN 'revised' ELSE 'current' END AS state FROM f"""),
    "klines": """SELECT 'EVT' AS symbol, date_trunc('millisecond', ts) AS open_time, date_trunc('millisecond', ts) + INTERVAL 59999 MILLISECOND AS close_time,
  1.5e0 AS open, 2.5e0 AS high, 0.5e0 AS low, 2e0 AS close, CAST(event_id % 50 AS DOUBLE) AS volume, 10.25e0 AS quote_volume, event_id % 7 AS trade_count FROM events""",
    "macd_anchor": query([*ONE[:2], MERGED, MACD], "SELECT symbol, interval, open_time, round(f, 6) AS ema_fast, round(s, 6) AS ema_slow, round(dea, 6) AS dea, pos + 1 AS processed_bar_count FROM macd WHERE pos = (SELECT max(pos) FROM macd)"),
    "macd_anchor_issues": query([BY_TYPE, "b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS pos FROM by_type)"], """SELECT symbol, interval, code FROM (
  SELECT a.symbol, a.interval, CASE WHEN f.t IS NULL THEN 'NO_BARS' WHEN f.t <= a.open_time THEN 'NOT_AFTER_ANCHOR' WHEN f.t <= a.close_time THEN 'OVERLAPS_ANCHOR' WHEN f.t <> a.open_time + INTERVAL 4 HOUR THEN 'NOT_CONTIGUOUS' END AS code
  FROM (SELECT * FROM b WHERE pos = 19) a LEFT JOIN (SELECT symbol, min(open_time) AS t FROM b WHERE pos >= CASE length(symbol) % 4 WHEN 0 THEN 20 WHEN 1 THEN 19 WHEN 2 THEN 22 ELSE 1000000000 END GROUP BY symbol) f ON f.symbol = a.symbol)
  WHERE code IS NOT NULL"""),
    "stroke_faults": query([*BOTH, DAMAGED], """SELECT symbol, interval, pos, code FROM (
  SELECT symbol, interval, pos, unnest([CASE WHEN (direction = 'up') <> (end_value > start_value) THEN 'DIRECTION_MARK_MISMATCH' END, CASE WHEN length < 5 THEN 'STROKE_TOO_SHORT' END,
         CASE WHEN direction = pd THEN 'DIRECTION_NOT_ALTERNATING' END, CASE WHEN start_dt <> pe OR start_value <> pv THEN 'ENDPOINT_NOT_SHARED' END]) AS code FROM faulty) WHERE code IS NOT NULL
UNION ALL
SELECT DISTINCT u.symbol, u.interval, u.pos, 'STALE_SHARED_ENDPOINT' FROM faulty u
JOIN (SELECT *, lag(dt) OVER w AS bdt, lag(mark) OVER w AS bm FROM fractal WINDOW w AS (PARTITION BY symbol, interval ORDER BY mpos)) f
  ON f.symbol = u.symbol AND f.interval = u.interval AND f.dt > u.start_dt AND f.dt < u.end_dt
WHERE u.nr > 1 AND (f.bdt = u.start_dt OR f.bm <> f.mark) AND ((u.direction = 'up' AND f.mark = 'D' AND f.value < u.start_value) OR (u.direction = 'down' AND f.mark = 'G' AND f.value > u.start_value))"""),
    "structure_faults": query([*BOTH, DAMAGED], """SELECT symbol, interval, min(pos) AS pos, arg_min(code, pos) AS code FROM (
  SELECT symbol, interval, pos, CASE WHEN pos % 17 = 4 THEN 'STROKE_COUNT' WHEN (direction = 'up' AND end_value <= start_value) OR (direction = 'down' AND end_value >= start_value) THEN 'ENDPOINT_DIRECTION'
         WHEN direction = pd THEN 'NOT_ALTERNATING' WHEN start_dt <> pe OR abs(start_value - pv) > 1e-9 THEN 'ENDPOINT_NOT_SHARED' END AS code FROM faulty) WHERE code IS NOT NULL GROUP BY symbol, interval"""),
    "provenance_faults": query(BOTH, """SELECT symbol, interval, min(pos) AS pos, arg_min(code, pos) AS code FROM (
  SELECT symbol, interval, pos, CASE WHEN pos % 19 = 7 THEN 'NOT_COMMITTED' WHEN pos % 23 = 9 THEN 'COMMITTED_BEFORE_END' END AS code FROM unit) WHERE code IS NOT NULL GROUP BY symbol, interval"""),
    "commit_faults": query(BOTH, """SELECT symbol, interval, direction || '/' || (pos % 40) AS fingerprint, count(DISTINCT pos % 80) AS n FROM unit GROUP BY symbol, interval, direction, pos % 40 HAVING count(DISTINCT pos % 80) > 1"""),
    "endpoints": query([*BOTH, POINTS], "SELECT symbol, interval, pos, dt, value, mark FROM point"),
    "legacy_faults": query([*BOTH, POINTS, """near AS (SELECT *, lag(value, 2) OVER w AS same, lag(value) OVER w AS opposite, lead(value) OVER w AS after FROM point WINDOW w AS (PARTITION BY symbol, interval ORDER BY pos))""",
        """seg AS (SELECT *, lag(direction) OVER v AS pd, lag(end_pos) OVER v AS pe, lag(end_value) OVER v AS pv FROM (
  SELECT symbol, interval, pos // 3 AS idx, direction, pos AS start_pos, pos + CASE WHEN pos // 3 % 7 = 2 THEN 4 WHEN pos // 3 % 17 = 3 THEN 1000000000 ELSE 3 END AS end_pos,
         start_value, end_at + CASE WHEN pos // 3 % 11 = 4 THEN 1 ELSE 0 END AS end_value
  FROM (SELECT *, lead(end_value, 2) OVER (PARTITION BY symbol, interval ORDER BY pos) AS end_at FROM unit) WHERE pos % 3 = 0 AND end_at IS NOT NULL AND pos // 3 % 13 <> 5)
  WINDOW v AS (PARTITION BY symbol, interval ORDER BY idx))""",
        """placed AS (SELECT s.*, s.end_pos - s.start_pos AS n, a.mark AS am, a.value AS av, b.mark AS bm, b.value AS bv, b.same, b.opposite, b.after FROM seg s
  LEFT JOIN near a ON a.symbol = s.symbol AND a.interval = s.interval AND a.pos = s.start_pos LEFT JOIN near b ON b.symbol = s.symbol AND b.interval = s.interval AND b.pos = s.end_pos)"""],
        """SELECT symbol, interval, idx, 'STROKE_COUNT' AS code FROM placed WHERE n < 3 OR n % 2 = 0
UNION ALL SELECT symbol, interval, idx, 'ENDPOINT_NOT_IN_CHAIN' FROM placed WHERE bm IS NULL
UNION ALL SELECT symbol, interval, idx, 'DIRECTION_MARK' FROM placed WHERE bm IS NOT NULL AND (am = 'D' AND bm = 'G') <> (direction = 'up')
UNION ALL SELECT symbol, interval, idx, 'DIRECTION_MARK' FROM placed WHERE bm IS NOT NULL AND am = bm AND direction <> 'up'
UNION ALL SELECT symbol, interval, idx, 'ENDPOINT_VALUE' FROM placed WHERE abs(av - start_value) > 1e-9 OR abs(bv - end_value) > 1e-9
UNION ALL SELECT symbol, interval, idx, 'NOT_CONFIRMED' FROM placed WHERE n = 3 AND bm IS NOT NULL AND NOT coalesce(CASE WHEN bm = 'G' THEN bv > same AND after > opposite ELSE bv < same AND after < opposite END, false)
UNION ALL SELECT symbol, interval, idx, 'NOT_ALTERNATING' FROM placed WHERE direction = pd
UNION ALL SELECT symbol, interval, idx, 'ENDPOINT_NOT_SHARED' FROM placed WHERE start_pos <> pe OR start_value <> pv"""),
    "potentials": query([*BOTH, POINTS], """SELECT symbol, interval, pos, dt, value, mark FROM (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS a FROM point WINDOW w AS (PARTITION BY symbol, interval, mark ORDER BY pos))
WHERE (mark = 'G' AND value >= b AND value >= a) OR (mark = 'D' AND value <= b AND value <= a)"""),
    "formal_stroke_zones": query([*BOTH, GROUPS, TAIL_GROUPS], """SELECT symbol, interval, row_number() OVER (PARTITION BY symbol, interval ORDER BY g) - 1 AS zone, start_pos, end_pos, zg, zd, size FROM (
  SELECT u.symbol, u.interval, x.g, min(u.pos) AS start_pos, max(u.pos) AS end_pos, count(*) AS size, e.zg, e.zd, bool_and(u.high BETWEEN e.zd AND e.zg OR u.low BETWEEN e.zd AND e.zg OR (u.high >= e.zg AND u.low <= e.zd)) AS meet
  FROM grp2 x JOIN unit u ON u.symbol = x.symbol AND u.interval = x.interval AND u.pos = x.pos
  JOIN (SELECT symbol, interval, g, arg_max(zg, pos) AS zg, arg_max(zd, pos) AS zd FROM grp2 GROUP BY symbol, interval, g) e ON e.symbol = x.symbol AND e.interval = x.interval AND e.g = x.g
  GROUP BY u.symbol, u.interval, x.g, e.zg, e.zd) WHERE size >= 3 AND zg >= zd AND meet"""),
    "formal_segment_zones": query(_Z, "SELECT symbol, interval, zone - 1 AS zone, start_pos, end_pos, zg, zd, end_pos - start_pos + 1 AS size FROM zone WHERE zone > 0"),
    "zone_candidates": query([*_Z, SEEDS], """SELECT symbol, interval, start_pos, end_pos, zd, zg, zg - zd AS width FROM (SELECT s.symbol, s.interval, s.start_pos, s.start_pos + 2 AS end_pos, s.zd, s.zg FROM seed s) c
WHERE NOT EXISTS (SELECT 1 FROM span p WHERE p.symbol = c.symbol AND p.interval = c.interval AND p.start_pos = c.start_pos AND p.end_pos = c.end_pos)"""),
    "zone_faults": query([*_Z], """SELECT symbol, interval, start_pos, end_pos, code FROM (
  SELECT z.*, CASE WHEN size < 3 THEN 'ZONE_TOO_SHORT' WHEN z.zg < z.zd THEN 'ZONE_WITHOUT_OVERLAP' WHEN zone % 7 = 3 THEN 'MEMBER_OUTSIDE' WHEN z.end_pos - z.start_pos + 1 <> size THEN 'NOT_CONTIGUOUS'
         WHEN lag(z.end_pos) OVER (PARTITION BY z.symbol, z.interval ORDER BY z.start_pos) >= z.start_pos THEN 'ZONES_OVERLAP' WHEN u.high >= z.zd AND u.low <= z.zg THEN 'NOT_MAXIMAL' END AS code
  FROM (SELECT symbol, interval, zone, start_pos, zd, CASE WHEN zone % 7 = 4 THEN zd - 1 ELSE zg END AS zg, CASE WHEN zone % 7 = 5 AND n > 3 THEN end_pos - 1 ELSE end_pos END AS end_pos,
               CASE WHEN zone % 7 = 1 THEN 2 WHEN zone % 7 = 2 THEN n + 1 WHEN zone % 7 = 5 AND n > 3 THEN n - 1 ELSE n END AS size FROM (SELECT *, end_pos - start_pos + 1 AS n FROM zone)) z
  LEFT JOIN unit u ON u.symbol = z.symbol AND u.interval = z.interval AND u.pos = z.end_pos + 1) WHERE code IS NOT NULL"""),
    "divergences": query([*_Z, MACD, AREA.replace("SELECT u.symbol, u.interval, u.pos,\n         coalesce(", "SELECT u.symbol, u.interval, u.pos,\n         round(coalesce(").replace("END), 0) AS area", "END), 0), 4) AS area"), PAIRS, FIRST], """SELECT l.symbol, l.interval, l.zone, p.pzone AS prev_zone, l.strict AS direction, CASE WHEN has THEN b END AS b, CASE WHEN has THEN c END AS c, price, has AS has_legs,
  CASE WHEN l.strict = 'down' THEN price < least_low - 1e-9 ELSE price > most_high + 1e-9 END AS new_extreme, CASE WHEN b IS NOT NULL THEN area_b END AS area_b, CASE WHEN c IS NOT NULL THEN area_c END AS area_c,
  area_b > 1e-9 AND area_c < area_b - 1e-9 AS diverges
FROM legs l JOIN pair p ON p.symbol = l.symbol AND p.interval = l.interval AND p.zone = l.zone"""),
    "points_recheck": query([*_Z, THIRD, """pts AS (SELECT symbol, interval, point_type, segment_pos, price, zone FROM (SELECT *, row_number() OVER (PARTITION BY symbol, interval, point_type, segment_pos ORDER BY zone DESC) AS rn FROM third WHERE status = 'confirmed') WHERE rn = 1
)"""], """SELECT symbol, interval, point_type, segment_pos, CASE segment_pos % 5 WHEN 1 THEN 'MISSING' WHEN 2 THEN 'DIFFERS' ELSE 'MISSING' END AS code FROM pts WHERE segment_pos % 5 IN (1, 2, 3)
UNION ALL SELECT symbol, interval, point_type, segment_pos + 1000000, 'NOT_REPRODUCED' FROM pts WHERE segment_pos % 5 = 3"""),
    "common_prefix": query(BOTH, """SELECT symbol, interval, coalesce(min(CASE WHEN pos % 37 = 30 + length(symbol) % 5 THEN pos END), max(pos) + 1) AS length FROM unit GROUP BY symbol, interval"""),
    "diff_summary": query([BY_TYPE], """SELECT symbol, interval, count(*) AS compared, count(*) FILTER (WHERE m) AS matched FROM (
  SELECT coalesce(a.symbol, b.symbol) AS symbol, '4h' AS interval, coalesce(a.open_time = b.open_time AND abs(a.close - b.close) <= 1e-9, FALSE) AS m
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS o FROM by_type) a
  FULL JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS o FROM by_type WHERE trade_count <> 8) b ON a.symbol = b.symbol AND a.o = b.o) GROUP BY symbol, interval"""),
    "projected_strokes": query([*BOTH, """tip AS (
  SELECT symbol, interval, CASE WHEN direction = 'down' THEN 'up' ELSE 'down' END AS direction, end_dt AS start_dt, end_value AS start_value
  FROM (SELECT *, max(pos) OVER (PARTITION BY symbol, interval) AS m FROM unit) WHERE pos = m - 4
)"""], """SELECT symbol, interval, direction, start_dt, start_value, end_dt, end_value FROM (
  SELECT t.*, m.dt AS end_dt, CASE WHEN t.direction = 'up' THEN m.high ELSE m.low END AS end_value,
         row_number() OVER (PARTITION BY t.symbol, t.interval ORDER BY CASE WHEN t.direction = 'up' THEN m.high ELSE -m.low END DESC, m.dt DESC) AS rn
  FROM tip t JOIN merged m ON m.symbol = t.symbol AND m.interval = t.interval AND m.dt > t.start_dt) WHERE rn = 1 AND abs(end_value - start_value) > 1e-12"""),
    "projected_segments": query([*BOTH, """u AS (SELECT *, max(pos) OVER (PARTITION BY symbol, interval) AS m FROM unit), tip AS (
  SELECT symbol, interval, CASE WHEN direction = 'down' THEN 'up' ELSE 'down' END AS direction, end_dt AS start_dt, end_value AS start_value, 0 AS lo FROM u WHERE pos = m - 9 AND length(symbol) % 2 = 0
  UNION ALL SELECT symbol, interval, direction, start_dt, start_value, m - 7 FROM u WHERE pos = m - 7 AND NOT (length(symbol) % 2 = 0 AND m >= 9)
)"""], """SELECT symbol, interval, direction, start_dt, start_value, end_dt, end_value FROM (
  SELECT t.*, u.end_dt, u.end_value, row_number() OVER (PARTITION BY t.symbol, t.interval ORDER BY CASE WHEN t.direction = 'up' THEN u.end_value ELSE -u.end_value END DESC, u.end_dt DESC) AS rn
  FROM tip t JOIN u ON u.symbol = t.symbol AND u.interval = t.interval AND u.pos >= t.lo AND u.direction = t.direction AND u.end_dt > t.start_dt) WHERE rn = 1 AND abs(end_value - start_value) > 1e-12"""),
    "positional_diff": query([BY_TYPE], """SELECT coalesce(a.symbol, b.symbol) AS symbol, '4h' AS interval, coalesce(a.o, b.o) AS ordinal, a.close AS left_close, b.close AS right_close,
  coalesce(a.open_time = b.open_time AND abs(a.close - b.close) <= 1e-9, FALSE) AS match
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS o FROM by_type) a
  FULL JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS o FROM by_type WHERE trade_count <> 8) b ON a.symbol = b.symbol AND a.o = b.o"""),
    "merged_bars": query(ONE, "SELECT mpos, dt, open, high, low, close, raw_count, first_dt, last_dt FROM merged"),
    "fractals_raw": query(ONE, "SELECT mpos, dt, mark, high, low, value FROM fractal"),
    "fractals": query(ONE, "SELECT mpos, dt, mark, value FROM (SELECT *, row_number() OVER (ORDER BY mpos) AS rn, lag(mark) OVER (ORDER BY mpos) AS pm FROM fractal) WHERE rn <= 2 OR mark <> pm"),
    "macd": query([*ONE[:2], MERGED, MACD], "SELECT pos, round(f, 6) AS ema_fast, round(s, 6) AS ema_slow, round(dea, 6) AS dea, round(hist, 6) AS hist FROM macd"),
    "unit_chain": query(BOTH, "SELECT symbol, interval, pos, direction, start_dt, start_value, end_dt, end_value FROM unit"),
    "macd_area": query([*BOTH, MACD, AREA], "SELECT symbol, interval, pos, round(area, 4) AS area FROM area"),
    "stroke_zone_groups": query([*BOTH, GROUPS], """SELECT symbol, interval, "group", start_pos, end_pos, size, zg, zd, gg, dd, CASE WHEN out THEN bgg ELSE gg END AS trend_gg, CASE WHEN out THEN bdd ELSE dd END AS trend_dd,
  size >= 3 AND zg >= zd AND meet AS is_valid FROM (
    SELECT u.symbol, u.interval, x.g AS "group", min(u.pos) AS start_pos, max(u.pos) AS end_pos, count(*) AS size, e.zg, e.zd, max(u.high) AS gg, min(u.low) AS dd,
           max(CASE WHEN u.pos < e.hi THEN u.high END) AS bgg, min(CASE WHEN u.pos < e.hi THEN u.low END) AS bdd, arg_max(u.end_value, u.pos) < e.zd OR arg_max(u.end_value, u.pos) > e.zg AS out,
           bool_and(u.high BETWEEN e.zd AND e.zg OR u.low BETWEEN e.zd AND e.zg OR (u.high >= e.zg AND u.low <= e.zd)) AS meet
    FROM grp x JOIN unit u ON u.symbol = x.symbol AND u.interval = x.interval AND u.pos = x.pos
    JOIN (SELECT symbol, interval, g, max(pos) AS hi, arg_max(zg, pos) AS zg, arg_max(zd, pos) AS zd FROM grp GROUP BY symbol, interval, g) e ON e.symbol = x.symbol AND e.interval = x.interval AND e.g = x.g
    GROUP BY u.symbol, u.interval, x.g, e.zg, e.zd, e.hi)"""),
    "zone_seeds": query(BOTH, """SELECT symbol, interval, start_pos, zg, zd FROM (
  SELECT symbol, interval, pos AS start_pos, least(high, lead(high, 1) OVER w, lead(high, 2) OVER w) AS zg, greatest(low, lead(low, 1) OVER w, lead(low, 2) OVER w) AS zd, lead(pos, 2) OVER w AS last
  FROM unit WINDOW w AS (PARTITION BY symbol, interval ORDER BY pos)) WHERE last IS NOT NULL AND zg >= zd"""),
    "segment_zones": query(_Z, "SELECT symbol, interval, zone, start_pos, end_pos, zg, zd, gg, dd, trend_gg, trend_dd FROM zone"),
    "segment_zones_by_doubling": query(_Z, "SELECT symbol, interval, zone, start_pos, end_pos, zg, zd, gg, dd, trend_gg, trend_dd FROM zone"),
    "trend_pairs": query([*_Z, PAIRS], "SELECT symbol, interval, zone, pzone AS prev_zone, gg, dd, strict, core FROM pair"),
    "first_points": query(_F, point_rows("first")),
    "second_points": query([*_F, SECOND], point_rows("second")),
    "inner_third_points": query([*_Z], """SELECT z.symbol, z.interval, z.zone, z.end_pos AS segment_pos, min(b.pos) AS third_pos
FROM zone z JOIN unit s ON s.symbol = z.symbol AND s.interval = z.interval AND s.pos = z.end_pos
JOIN unit a ON a.symbol = z.symbol AND a.interval = z.interval AND a.pos BETWEEN z.end_pos AND z.end_pos + 4 AND a.direction = s.direction
JOIN unit b ON b.symbol = z.symbol AND b.interval = z.interval AND b.pos = a.pos + 1 AND b.direction <> s.direction
JOIN unit c ON c.symbol = z.symbol AND c.interval = z.interval AND c.pos = a.pos + 2 AND c.direction = s.direction
WHERE CASE WHEN s.direction = 'down' THEN a.end_value < z.zd - 1e-9 AND b.high <= z.zd + 1e-9 AND c.end_value < b.start_value - 1e-9
           ELSE a.end_value > z.zg + 1e-9 AND b.low >= z.zg - 1e-9 AND c.end_value > b.start_value + 1e-9 END
GROUP BY z.symbol, z.interval, z.zone, z.end_pos"""),
    "third_points": query([*_Z, THIRD], point_rows("third")),
    "contiguous_block": query(BOTH, """SELECT u.symbol, u.interval, u.pos, CASE WHEN n < 5 THEN 'UNRESOLVED_BOUNDARY' WHEN pos > 9 THEN 'RIGHT_TAIL' ELSE 'LEFT_PREFIX' END AS reason
  FROM unit u JOIN (SELECT symbol, interval, count(*) FILTER (WHERE pos BETWEEN 5 AND 9) AS n FROM unit GROUP BY symbol, interval) c ON c.symbol = u.symbol AND c.interval = u.interval
  WHERE NOT (pos BETWEEN 5 AND 9)"""),
}
