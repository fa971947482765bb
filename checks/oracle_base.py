"""Shared pieces of the DuckDB check SQL: the flat event tables and the derived tables.

Written from the definitions, apart from the Spark code: first rows are picked with
DISTINCT ON, rates are divided and rounded as decimals.
"""

from __future__ import annotations

# --- expressions ------------------------------------------------------------------


def r(x: str, digits: int) -> str:
    """Round half up on the decimal value, as Spark does."""
    return f"round(CAST({x} AS DECIMAL(38, 9)), {digits})::DOUBLE"


def rm(amount: str, digits: int = 2) -> str:
    """Round an amount, which has four decimals; fewer digits keep large totals exact."""
    return f"round(CAST({amount} AS DECIMAL(38, 4)), {digits})::DOUBLE"


def q(a: str, b: str, digits: int | None = None) -> str:
    x = f"(({a}) / nullif({b}, 0))"
    return x if digits is None else r(x, digits)


def pc(a: str, b: str, digits: int | None = 2) -> str:
    return q(f"100 * ({a})", b, digits)


def m(x: str) -> str:
    """Exact sum of an amount."""
    return f"sum(CAST({x} AS DECIMAL(18, 4)))::DOUBLE"


def n(condition: str | None = None) -> str:
    return "count(*)" if condition is None else f"(count(*) FILTER (WHERE {condition}))"


def s(x: str) -> str:
    return f"sum({x})::BIGINT"


def share(x: str, digits: int = 2, by: str = "") -> str:
    return pc(x, f"sum({x}) OVER ({by})", digits)


# --- flat event tables ----------------------------------------------------------------

CLICKSTREAM = """
src AS (
  SELECT e.*, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, CAST(ts AS DATE) AS d,
         CAST(ts AS DATE) - DATE '2024-01-01' AS day, n_name
  FROM events e
  LEFT JOIN customer ON c_custkey = user_id
  LEFT JOIN nation ON n_nationkey = c_nationkey
),
ev AS (
  SELECT
    d, ts,
    CASE event_type
      WHEN 'purchase' THEN 'purchase'
      WHEN 'view' THEN CASE WHEN k < 80 THEN 'view_item' ELSE 'session_start' END
      WHEN 'click' THEN CASE WHEN k < 60 THEN 'add_to_cart' ELSE 'page_view' END
      WHEN 'signup' THEN CASE WHEN k < 70 THEN 'begin_checkout' ELSE 'add_shipping_info' END
      WHEN 'error' THEN CASE WHEN k < 50 THEN 'add_payment_info' ELSE 'page_view' END
    END AS name,
    CAST(user_id AS VARCHAR) AS uid,
    CASE WHEN event_id % 97 <> 0 THEN CAST(strftime(ts, '%Y%m%d') AS BIGINT) END AS sid,
    CASE WHEN event_id % 97 <> 0
         THEN CAST(greatest(1, day - 3) + (user_id % 10 = 0)::INTEGER AS BIGINT) END AS snum,
    ['desktop', 'mobile', 'tablet'][(user_id + day) % 3 + 1] AS device,
    n_name AS country,
    CASE WHEN user_id % 7 = 0 THEN ['<Other>', '(data deleted)'][k % 2 + 1]
         WHEN k % 8 <> 7 THEN ['<Other>', '(data deleted)', 'organic', 'cpc', 'referral', '(none)', 'organic'][k % 8 + 1]
    END AS medium,
    'src' || (k % 5) AS source,
    CASE WHEN event_type = 'purchase' AND k BETWEEN 10 AND 14 THEN '(not set)'
         WHEN event_type = 'purchase' AND k >= 15 THEN user_id || '-' || k END AS tx,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN k < 15 AND k % 2 = 0 THEN 0.0 ELSE value END END AS rev,
    ['Windows', 'Android', '<Other>', 'iOS'][k % 4 + 1] AS os,
    CASE WHEN k % 3 <> 0 THEN ['en-us', ''][k % 2 + 1] END AS lang,
    ['Chrome', 'Safari', '<Other>', 'Firefox', 'Edge'][k % 5 + 1] AS browser,
    ['(not set)', 'North', 'South', 'East', 'West', ''][k % 6 + 1] AS region,
    ['(not set)', '(not set)', '(data deleted)', 'A', 'B', 'C', 'D', 'E', 'F', '<Other>'][k % 10 + 1] AS city,
    CASE WHEN k % 2 = 0 THEN '(data deleted)' ELSE 'campaign' END AS campaign,
    CASE WHEN k % 5 <> 0 THEN '/page/' || k END AS page
  FROM src
)"""

# The clickstream of many visitors with few events each.
VISITORS = CLICKSTREAM
for old, new in (
    ("SELECT e.*,", "SELECT e.* REPLACE (user_id * 8 + event_id % 8 AS user_id),"),
    ("customer ON c_custkey = user_id", "customer ON c_custkey = e.user_id"),
    ("WHEN k < 60 THEN 'add_to_cart'", "WHEN k < 60 AND day NOT IN (9, 17) THEN 'add_to_cart'"),
    ("CAST(strftime(ts, '%Y%m%d') AS BIGINT)", "CAST(day // 7 AS BIGINT)"),
    ("CAST(greatest(1, day - 3) + (user_id % 10 = 0)::INTEGER AS BIGINT)",
     "CAST(CASE WHEN user_id % 10 = 3 THEN 40 - day ELSE greatest(1, day - 3) + (user_id % 10 = 0)::INTEGER END AS BIGINT)"),
    ("k BETWEEN 10 AND 14 THEN '(not set)'", "k BETWEEN 40 AND 44 THEN '(not set)'"),
    ("k >= 15 THEN user_id", "k >= 45 THEN user_id"),
    ("THEN 0.0 ELSE value END", "THEN 0.0 WHEN k < 40 THEN (k % 3) * 5.0::DOUBLE ELSE value END"),
):
    assert VISITORS.count(old) == 1, old
    VISITORS = VISITORS.replace(old, new)

ORDER_HISTORY = """
src AS (
  SELECT o.*, CAST(o_orderdate AS DATE) + CAST(o_custkey % 7 * 180 AS INTEGER) AS d, n_name, c_mktsegment
  FROM orders o
  LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN nation ON n_nationkey = c_nationkey
),
ev AS (
  SELECT
    d,
    CAST(d AS TIMESTAMP) + to_seconds(o_orderkey % 86400) + to_microseconds(o_orderkey) AS ts,
    CASE o_orderstatus WHEN 'F' THEN 'purchase' WHEN 'O' THEN 'begin_checkout' ELSE 'view_item' END AS name,
    CAST(o_custkey AS VARCHAR) AS uid,
    CAST(strftime(d, '%Y%m%d') AS BIGINT) AS sid,
    1 + o_orderkey % 5 + (o_custkey % 10 = 0)::INTEGER AS snum,
    ['desktop', 'mobile', 'tablet'][o_orderkey % 3 + 1] AS device,
    n_name AS country,
    ['organic', 'cpc', 'referral', '(none)', '<Other>', '(data deleted)'][o_custkey % 6 + 1] AS medium,
    c_mktsegment AS source,
    CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS VARCHAR) END AS tx,
    CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS rev
  FROM src
)"""

_ITEM = "{{'id': 'P' || p_partkey, 'name': {name}, 'qty': {qty}, 'amt': {amt}}}"
_NAME = """CASE WHEN p_size = 7 THEN '(not set)' WHEN p_size = 8 THEN ''
           WHEN p_size = 10 THEN '&quot;' || p_name || '&quot;' WHEN p_size <> 9 THEN p_name END"""


def _item(name: str, qty: str = "NULL::BIGINT", amt: str = "NULL::DOUBLE") -> str:
    return _ITEM.format(name=name, qty=qty, amt=amt)


_OTHER = _item("p_brand || ' ' || p_type")

ITEM_EVENTS = f"""
src AS (
  SELECT *, CAST(l_shipdate AS DATE) AS d, {_NAME} AS nm, CAST(l_quantity AS BIGINT) AS qty,
         l_extendedprice * (1 - l_discount) AS amt
  FROM lineitem
  JOIN part ON p_partkey = l_partkey
  JOIN orders ON o_orderkey = l_orderkey
),
streams AS (
  SELECT *, 'view_item' AS name,
         CASE WHEN p_size % 3 = 0 THEN []
              ELSE [{_item("nm")}, {_OTHER}, {_item("replace(nm, 'small gear', 'large gear')")}] END AS items
  FROM src
  UNION ALL
  SELECT *, 'add_to_cart',
         [{_item("nm", "CASE WHEN l_returnflag <> 'N' THEN qty END")}, {_OTHER}]
  FROM src WHERE l_linestatus = 'F'
  UNION ALL
  SELECT *, 'purchase', [{_item("nm", "qty", "amt")}] FROM src WHERE l_returnflag <> 'A'
),
ev AS (
  SELECT
    d, CAST(d AS TIMESTAMP) + to_seconds(l_partkey % 80000) + to_microseconds(l_suppkey) AS ts, name,
    CAST(o_custkey AS VARCHAR) AS uid, l_orderkey AS sid, CAST(l_linenumber AS BIGINT) AS snum,
    ['desktop', 'mobile', 'tablet'][p_partkey % 3 + 1] AS device,
    'Country ' || (o_custkey % 20) AS country,
    ['organic', 'cpc', 'referral', '(none)', '<Other>'][o_custkey % 5 + 1] AS medium,
    'src' AS source,
    CASE WHEN name = 'purchase' AND l_suppkey % 10 = 1 THEN '(not set)'
         WHEN name = 'purchase' AND l_suppkey % 10 <> 0 THEN CAST(l_orderkey AS VARCHAR) END AS tx,
    CASE WHEN name = 'purchase' THEN
      CASE WHEN l_linenumber = 3 AND l_suppkey % 10 < 2 THEN 0.0 ELSE amt END END AS rev,
    items
  FROM streams
)"""


# --- derived tables -----------------------------------------------------------------------

FLAGS = {
    "view_item": "f_view",
    "add_to_cart": "f_cart",
    "begin_checkout": "f_chk",
    "add_shipping_info": "f_ship",
    "add_payment_info": "f_pay",
}


def derived(cart_from: str, windows: tuple[int, int], items: bool = False) -> str:
    carried = ", items" if items else ""
    flags = ", ".join(f"bool_or(name = '{e}') AS {f}" for e, f in FLAGS.items())
    any_flags = ", ".join(f"bool_or({f}) AS {f}" for f in FLAGS.values())
    short, long = windows
    return f"""
ordr AS (
  (SELECT DISTINCT ON (tx) tx, ts, uid, sid, d, rev{carried} FROM ev
   WHERE name = 'purchase' AND tx <> '(not set)' ORDER BY tx, ts, uid, sid NULLS FIRST, rev NULLS FIRST)
  UNION ALL
  SELECT tx, ts, uid, sid, d, rev{carried} FROM ev
  WHERE name = 'purchase' AND coalesce(tx, '(not set)') = '(not set)' AND rev > 0
),
touch AS (
  SELECT DISTINCT ON (uid) uid, medium, source FROM ev
  ORDER BY uid, coalesce(medium, '<Other>') IN ('<Other>', '(data deleted)') , ts
),
labelled AS (
  SELECT t.*, coalesce(c.label, 'Other (obscured)') AS channel
  FROM touch t
  LEFT JOIN (VALUES ('organic', 'Organic'), ('cpc', 'Paid (cpc)'), ('referral', 'Referral'),
                    ('(none)', 'Direct'), ('(data deleted)', 'Data deleted')) c(medium, label) USING (medium)
),
sess AS (
  SELECT
    a.*, l.medium, l.source, l.channel, coalesce(o.orders, 0) AS orders,
    o.orders IS NOT NULL AS bought, coalesce(o.revenue, 0) AS revenue
  FROM (
    SELECT uid, sid, min(snum) AS snum, min(ts) AS st, min(d) AS d,
           first(device ORDER BY ts) FILTER (WHERE device IS NOT NULL) AS device,
           first(country ORDER BY ts) FILTER (WHERE country IS NOT NULL) AS country,
           count(*) AS events, {n("name = 'page_view'")} AS pages, bool_or(name = 'session_start') AS f_start,
           {flags}, {n("name = 'purchase'")} AS buys
    FROM ev GROUP BY uid, sid
  ) a
  JOIN labelled l ON l.uid = a.uid
  LEFT JOIN (SELECT uid, sid, count(*) AS orders, {m("rev")} AS revenue FROM ordr GROUP BY uid, sid) o
    ON o.uid = a.uid AND o.sid = a.sid
),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY st, sid NULLS FIRST) AS visit FROM sess
),
usr AS (
  SELECT
    f.uid, f.d AS fd, t.low, CASE WHEN t.low = 1 THEN 'new' ELSE 'returning' END AS utype,
    f.device AS fdev, f.country AS fcountry, f.channel, f.medium, f.source,
    t.* EXCLUDE (uid, low), t.orders > 0 AS bought,
    f.d + {short} <= e.last AS el1, f.d + {long} <= e.last AS el2
  FROM ordered f
  JOIN (
    SELECT x.uid, min(x.snum) AS low, count(*) AS sessions, count(DISTINCT x.d) AS days, {s("x.pages")} AS pages,
           {", ".join(f"bool_or(x.{f}) AS {f}" for f in FLAGS.values())},
           {s("x.orders")} AS orders, {m("x.revenue")} AS revenue,
           bool_or(x.d - y.d BETWEEN 1 AND {short}) AS rt1, bool_or(x.d - y.d BETWEEN 1 AND {long}) AS rt2
    FROM ordered x JOIN ordered y ON y.uid = x.uid AND y.visit = 1
    GROUP BY x.uid
  ) t ON t.uid = f.uid
  CROSS JOIN (SELECT max(d) AS last FROM sess) e
  WHERE f.visit = 1
),
cs AS (SELECT * FROM sess WHERE d >= DATE '{cart_from}'),
cu AS (
  SELECT uid, min(channel) AS channel,
         first(device ORDER BY st) FILTER (WHERE device IS NOT NULL) AS fdev,
         count(*) AS sessions, {any_flags}, bool_or(bought) AS bought, {s("orders")} AS orders, {m("revenue")} AS revenue
  FROM cs GROUP BY uid
)"""


def item_tables(cart_from: str, floor: int) -> str:
    """Item rows and products, for events that carry items."""
    words = (
        "CASE WHEN regexp_matches(upper(item), '\\bBOL') THEN 'Hardware' "
        "WHEN regexp_matches(upper(item), '\\b(RING|RINGS)\\b') THEN 'Rings' "
        "WHEN regexp_matches(upper(item), '\\b(ROD|GEAR)\\b') THEN 'Rods and gears' "
        "WHEN regexp_matches(upper(item), '\\b(GIZMO|WIDGET)\\b') THEN 'Gadgets' ELSE 'Other' END"
    )
    return f"""
alias(raw, canon) AS (VALUES ('small gear', 'large gear'), ('old rod', 'new rod')),
line AS (
  SELECT e.name AS event, e.uid, e.ts, e.d, i.id, i.name AS raw_name, i.qty, i.amt,
         coalesce(canon, replace(i.name, '&quot;', '"')) AS item
  FROM (SELECT name, uid, ts, d, unnest(items) AS i FROM ev WHERE name <> 'purchase'
        UNION ALL SELECT 'purchase', uid, ts, d, unnest(items) FROM ordr) e
  LEFT JOIN alias ON raw = replace(i.name, '&quot;', '"')
  WHERE i.name NOT IN ('(not set)', '')
),
imp AS (SELECT DISTINCT uid, ts, d, item FROM line WHERE event = 'view_item'),
crt AS (SELECT uid, d, item FROM line WHERE event = 'add_to_cart' AND qty IS NOT NULL),
pur AS (SELECT uid, d, item, qty, amt FROM line WHERE event = 'purchase'),
rated AS (
  SELECT *, {words} AS grp,
         {q("revenue", "units", 2)} AS price, {pc("adds", "imps_w", 3)} AS v2c, {pc("lines_w", "adds", 2)} AS c2p,
         {pc("lines", "imps", 3)} AS v2p, {q("revenue", "imps", 4)} AS rpv
  FROM (
    SELECT item,
           coalesce(imps, 0) AS imps, coalesce(imp_users, 0) AS imp_users, coalesce(imps_w, 0) AS imps_w,
           coalesce(adds, 0) AS adds, coalesce(add_users, 0) AS add_users,
           coalesce(lines, 0) AS lines, coalesce(lines_w, 0) AS lines_w, coalesce(buyers, 0) AS buyers,
           coalesce(units, 0) AS units, coalesce(revenue, 0) AS revenue
    FROM (SELECT DISTINCT item FROM line WHERE event <> 'add_to_cart' OR qty IS NOT NULL) k
    LEFT JOIN (SELECT item, count(*) AS imps, count(DISTINCT uid) AS imp_users,
                      {n(f"d >= DATE '{cart_from}'")} AS imps_w FROM imp GROUP BY item) USING (item)
    LEFT JOIN (SELECT item, count(*) AS adds, count(DISTINCT uid) AS add_users FROM crt GROUP BY item) USING (item)
    LEFT JOIN (SELECT item, count(*) AS lines, {n(f"d >= DATE '{cart_from}'")} AS lines_w,
                      count(DISTINCT uid) AS buyers, {s("qty")} AS units, {m("amt")} AS revenue
               FROM pur GROUP BY item) USING (item)
  )
),
prod AS (
  SELECT rated.*, imps >= {floor} AS meets, mi, mv,
         CASE WHEN imps < {floor} THEN NULL
              WHEN imps >= mi THEN CASE WHEN v2p >= mv THEN 'Strong products' ELSE 'High traffic, low conversion' END
              WHEN v2p >= mv THEN 'Hidden winners' ELSE 'Weak products' END AS quad
  FROM rated,
       (SELECT quantile_cont(imps, 0.5) AS mi, quantile_cont(v2p, 0.5) AS mv FROM rated WHERE imps >= {floor})
)"""


SOURCES = {
    "clicks": CLICKSTREAM + "," + derived("2024-01-08", (1, 3)),
    "visitors": VISITORS + "," + derived("2024-01-08", (1, 3)),
    "history": ORDER_HISTORY + "," + derived("1996-01-01", (30, 180)),
    "items": ITEM_EVENTS + "," + derived("1997-01-01", (30, 180), items=True) + "," + item_tables("1997-01-01", 600),
}

PERIODS = {
    "clicks": """period(ord, label, a, b, cmp) AS (VALUES
  (1, 'Early January (baseline)', DATE '2024-01-01', DATE '2024-01-07', true),
  (2, 'Second week', DATE '2024-01-12', DATE '2024-01-18', true),
  (3, 'Third week', DATE '2024-01-19', DATE '2024-01-27', true),
  (8, 'Last days (not compared)', DATE '2024-01-28', DATE '2024-01-30', false),
  (9, 'Between (not compared)', DATE '2024-01-08', DATE '2024-01-11', false))""",
    "history": """period(ord, label, a, b, cmp) AS (VALUES
  (1, '1997 (baseline)', DATE '1997-01-01', DATE '1997-12-31', true),
  (2, '1998-1999', DATE '1998-01-01', DATE '1999-12-31', true),
  (3, '2000', DATE '2000-01-01', DATE '2000-12-31', true))""",
    "items": """period(ord, label, a, b, cmp) AS (VALUES
  (1, '1995-1996 (baseline)', DATE '1995-01-01', DATE '1996-12-31', true),
  (2, '1997-1998', DATE '1997-01-01', DATE '1998-12-31', true),
  (9, '1999-2001 (not compared)', DATE '1999-01-01', DATE '2001-12-31', false))""",
}

PERIODS["visitors"] = PERIODS["clicks"]


def sql(source: str, body: str, **ctes: str) -> str:
    """A complete statement: the source's tables, any further CTEs, and the final SELECT."""
    extra = "".join(f",\n{name} AS ({text})" for name, text in ctes.items())
    return f"WITH {SOURCES[source]},\n{PERIODS[source]}{extra}\n{body}"
