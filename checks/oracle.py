"""DuckDB SQL that checks each registered query."""

from __future__ import annotations

from checks.oracle_base import m, n, pc, q, r, rm, s, share, sql

# Per source: cart window start, revenue cut-off, days in the cart window, return
# windows, and the floors for sources and countries.
SETTINGS = {
    "clicks": ("2024-01-08", "2024-01-28", 23, (1, 3), 3, 5),
    "visitors": ("2024-01-08", "2024-01-28", 23, (1, 3), 3, 5),
    "history": ("1996-01-01", "2003-01-01", 3288, (30, 180), 20, 60),
    "items": ("1997-01-01", "2001-06-01", 1826, (30, 180), 300, 60),
}

MAIN = (("product_view", "f_view"), ("add_to_cart", "f_cart"), ("begin_checkout", "f_chk"),
        ("add_payment_info", "f_pay"), ("purchase", "bought"))
MAIN_COUNTS = ", ".join(f"{n(f)} AS {c}" for c, f in MAIN)

STEPS = (
    (1, "Sessions", "true", None, False),
    (2, "Product view", "f_view", 1, False),
    (3, "Add to cart", "f_cart", 2, False),
    (4, "Begin checkout", "f_chk", 3, False),
    (5, "Add shipping info (diagnostic)", "f_ship", 4, True),
    (6, "Add payment info", "f_pay", 4, False),
    (7, "Purchase", "bought", 6, False),
)
WHOLE = (
    (1, "Sessions", "true", None),
    (2, "Product view", "f_view", 1),
    (3, "Add to cart", "f_cart", 2),
    (4, "Begin checkout", "f_chk", 3),
    (5, "Add payment info", "f_pay", 4),
    (6, "Purchase", "bought", 5),
)

INSPECTED = {
    "device_category": "device", "device_os": "os", "browser": "browser", "device_language": "lang",
    "country": "country", "region": "region", "city": "city", "acq_source": "source", "acq_medium": "medium",
    "acq_campaign": "campaign", "user_id": "NULL::VARCHAR", "ga_session_id": "sid::VARCHAR",
    "ga_session_number": "snum::VARCHAR", "page_location": "page",
}


def _stage_union(stages, table: str) -> str:
    return " UNION ALL ".join(f"SELECT {st[0]} AS o, {n(st[2])} AS c FROM {table}" for st in stages)


def _steps_sql() -> str:
    stage_list = ", ".join(
        f"({o}, '{label}', {str(diag).lower()}, {'NULL::INTEGER' if ref is None else ref})"
        for o, label, _, ref, diag in STEPS
    )

    def level(name: str, alias: str) -> str:
        lost = f"({alias}p.c - {alias}.c)"
        return f"""{pc(f"{alias}.c", f"{alias}p.c")} AS {name}_step_conversion_pct,
          {pc(f"{alias}.c", f"{alias}1.c")} AS {name}_overall_conversion_pct, {lost} AS {name}_drop_off,
          {pc(lost, f"{alias}p.c")} AS {name}_drop_off_pct"""

    return f"""
      SELECT * EXCLUDE (loss), CASE WHEN loss IS NOT NULL THEN
               1 + (SELECT count(*)::INTEGER FROM (VALUES {stage_list}) z(o, label, diag, ref)
                    JOIN uc a ON a.o = z.o JOIN uc b ON b.o = z.ref
                    WHERE NOT z.diag AND (b.c - a.c) / b.c > loss) END AS users_drop_off_rank
      FROM (
        SELECT st.o AS stage_order, st.label AS stage, st.diag AS is_diagnostic, u.c AS users, t.c AS sessions,
          {level("users", "u")},
          {level("sessions", "t")},
          CASE WHEN NOT st.diag THEN (up.c - u.c) / up.c END AS loss
        FROM (VALUES {stage_list}) st(o, label, diag, ref)
        JOIN uc u ON u.o = st.o JOIN sc t ON t.o = st.o
        LEFT JOIN uc up ON up.o = st.ref LEFT JOIN sc tp ON tp.o = st.ref
        JOIN uc u1 ON u1.o = 1 JOIN sc t1 ON t1.o = 1)"""


def reports(source: str) -> dict[str, str]:
    """The SELECT of every report, over the derived tables of a source."""
    cart, revenue_end, cart_days, (w1, w2), source_floor, country_floor = SETTINGS[source]
    named = {"d": "event_date", "name": "event_name"}
    out: dict[str, str] = {}

    # Data quality.
    out["dq_overview"] = f"""
      SELECT count(*) AS total_events, count(DISTINCT d) AS daily_tables, min(d) AS first_date, max(d) AS last_date,
             count(DISTINCT uid) AS users, count(DISTINCT (uid, sid)) FILTER (WHERE sid IS NOT NULL) AS sessions_with_id
      FROM ev"""
    out["dq_events_by_name"] = f"""
      SELECT event_name, events, {share("events")} AS pct_of_events, users
      FROM (SELECT name AS event_name, count(*) AS events, count(DISTINCT uid) AS users FROM ev GROUP BY name)"""
    out["dq_daily_events"] = f"""
      SELECT d AS {named["d"]}, count(*) AS events, count(DISTINCT uid) AS users FROM ev GROUP BY d"""
    if source == "clicks":
        longs = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {x} AS v FROM ev" for c, x in INSPECTED.items())
        out["dq_obscured_values"] = f"""
          SELECT column_name, rows_checked, null_rows, empty_rows, data_deleted_rows, other_rows, not_set_rows,
                 {", ".join(f"{pc(f'{k}_rows', 'rows_checked')} AS {k}_pct" for k in ("null", "data_deleted", "other", "not_set"))},
                 {pc("null_rows + empty_rows + data_deleted_rows + other_rows + not_set_rows", "rows_checked")} AS unusable_pct
          FROM (SELECT column_name, count(*) AS rows_checked, {n("v IS NULL")} AS null_rows, {n("v = ''")} AS empty_rows,
                       {n("v = '(data deleted)'")} AS data_deleted_rows, {n("v = '<Other>'")} AS other_rows,
                       {n("v = '(not set)'")} AS not_set_rows
                FROM ({longs}) GROUP BY column_name)"""
    out["dq_funnel_events"] = f"""
      SELECT *, {pc("events_missing_session_id", "events")} AS missing_session_id_pct
      FROM (SELECT name AS event_name, count(*) AS events, count(DISTINCT uid) AS users,
                   {n("uid IS NULL")} AS events_missing_user, {n("sid IS NULL")} AS events_missing_session_id
            FROM ev WHERE name <> 'add_shipping_info' GROUP BY name)"""
    out["dq_purchases"] = f"""
      SELECT count(*) AS purchase_events, count(DISTINCT tx) AS distinct_transactions,
             count(*) - count(DISTINCT tx) AS duplicate_or_null_id_events, {n("tx IS NULL")} AS null_transaction_id,
             {n("tx = '(not set)'")} AS not_set_transaction_id, {n("rev IS NULL")} AS null_revenue,
             {n("rev = 0")} AS zero_revenue, {rm(m("rev"))} AS total_revenue_usd, {r("min(rev)", 2)} AS min_revenue_usd,
             {q(m("rev"), "count(rev)", 2)} AS avg_revenue_usd, {r("max(rev)", 2)} AS max_revenue_usd
      FROM ev WHERE name = 'purchase'"""
    tracked = ("view_item", "add_to_cart", "begin_checkout", "add_payment_info", "purchase")
    out["dq_daily_tracking"] = f"""
      SELECT d AS event_date, {", ".join(f"{n(f"name = '{e}'")} AS {e}_events" for e in tracked)},
             {n("name = 'purchase' AND coalesce(tx, '(not set)') = '(not set)'")} AS purchase_events_without_id,
             {n("name = 'purchase' AND coalesce(rev, 0) = 0")} AS purchase_events_zero_revenue
      FROM ev GROUP BY d"""
    out["dq_new_vs_returning"] = f"""
      SELECT *, {pc("returning_at_first_sight", "users")} AS returning_at_first_sight_pct
      FROM (SELECT count(*) AS users, {n("x = 1")} AS new_in_period, {n("x > 1")} AS returning_at_first_sight,
                   {n("x IS NULL")} AS unknown_session_number
            FROM (SELECT min(snum) AS x FROM ev GROUP BY uid))"""

    # Clean tables.
    out["clean_events"] = """
      SELECT d AS event_date, ts AS event_ts, name AS event_name, uid AS user_pseudo_id, sid AS ga_session_id,
             snum AS ga_session_number, device AS device_category, country, medium AS acq_medium, source AS acq_source,
             tx AS transaction_id, rev AS purchase_revenue_usd FROM ev"""
    out["clean_orders"] = """
      SELECT tx AS transaction_id, ts AS event_ts, uid AS user_pseudo_id, sid AS ga_session_id, d AS event_date,
             rev AS purchase_revenue_usd FROM ordr"""
    out["first_touch"] = "SELECT uid AS user_pseudo_id, medium AS acq_medium, source AS acq_source FROM touch"
    out["channel_label"] = """
      SELECT medium AS acq_medium, channel AS acq_channel, count(*) AS users FROM labelled GROUP BY ALL"""
    out["sessions"] = """
      SELECT uid AS user_pseudo_id, sid AS ga_session_id, snum AS ga_session_number, st AS session_start_ts,
             d AS session_date, device AS device_category, country, medium AS acq_medium, source AS acq_source,
             channel AS acq_channel, events, pages AS page_views, f_start AS has_session_start_event,
             f_view AS reached_view_item, f_cart AS reached_add_to_cart, f_chk AS reached_begin_checkout,
             f_ship AS reached_add_shipping_info, f_pay AS reached_add_payment_info, buys AS purchase_events,
             orders, bought AS purchased, revenue AS revenue_usd FROM sess"""
    out["check_sessions"] = f"""
      SELECT e.*, x.* FROM
        (SELECT count(*) AS events_clean_rows, {n("name = 'page_view'")} AS page_views_in_events,
                {n("name = 'purchase'")} AS raw_purchase_events FROM ev) e,
        (SELECT count(*) AS sessions, count(DISTINCT (uid, sid)) FILTER (WHERE sid IS NOT NULL) AS distinct_sessions,
                count(DISTINCT uid) AS users, {s("pages")} AS page_views_in_sessions, {s("orders")} AS orders,
                {n("bought")} AS purchasing_sessions, {rm(m("revenue"))} AS revenue_usd FROM sess) x"""
    out["daily_sessions"] = out["sessions"]
    out["sessions_by_channel"] = f"""
      SELECT channel AS acq_channel, count(DISTINCT uid) AS users, count(*) AS sessions, {s("orders")} AS orders,
             {rm(m("revenue"))} AS revenue_usd FROM sess GROUP BY channel"""
    out["users"] = f"""
      SELECT uid AS user_pseudo_id, fd AS first_visit_date, low AS min_session_number, utype AS user_type,
             fdev AS first_device_category, fcountry AS first_country, channel AS acq_channel, medium AS acq_medium,
             source AS acq_source, sessions, sessions > 1 AS repeat_visitor, days AS active_days, pages AS page_views,
             f_view AS reached_view_item, f_cart AS reached_add_to_cart, f_chk AS reached_begin_checkout,
             f_ship AS reached_add_shipping_info, f_pay AS reached_add_payment_info, orders, bought AS purchased,
             revenue AS revenue_usd, rt1 AS returned_within_{w1}d, rt2 AS returned_within_{w2}d,
             el1 AS eligible_{w1}d, el2 AS eligible_{w2}d FROM usr"""
    out["check_users"] = f"""
      SELECT count(*) AS users, count(DISTINCT uid) AS distinct_users, {s("sessions")} AS total_sessions,
             {n("utype = 'new'")} AS new_users, {n("utype = 'returning'")} AS returning_users,
             {n("bought")} AS purchasing_users, {s("orders")} AS orders, {rm(m("revenue"))} AS revenue_usd,
             {n("el1")} AS eligible_{w1}d_users, {n("el2")} AS eligible_{w2}d_users,
             {pc(n("utype = 'new' AND el1 AND rt1"), n("utype = 'new' AND el1"))} AS new_user_return_{w1}d_pct,
             {pc(n("utype = 'new' AND el2 AND rt2"), n("utype = 'new' AND el2"))} AS new_user_return_{w2}d_pct
      FROM usr"""

    # Funnel.
    left = "NOT bought"
    out["user_days"] = f"""
      SELECT uid AS user_pseudo_id, d AS session_date, device AS device_category, country, count(*) AS sessions,
             {s("pages")} AS page_views, {n("f_view")} AS product_view_sessions, {n("f_cart")} AS add_to_cart_sessions,
             {n("f_chk")} AS begin_checkout_sessions, {n("f_ship")} AS add_shipping_sessions,
             {n("f_pay")} AS add_payment_sessions, {n("bought")} AS purchasing_sessions,
             {n(f"f_cart AND {left}")} AS cart_abandoned_sessions, {n(f"f_chk AND {left}")} AS checkout_abandoned_sessions,
             {s("orders")} AS orders, {m("revenue")} AS revenue
      FROM sess GROUP BY ALL"""
    out["active_days"] = f"""
      SELECT uid AS user_pseudo_id, count(DISTINCT d) AS active_days, any_value(fd) AS first_day,
             min(CASE WHEN d > fd AND d - fd <= 62 * ceil({w2} / 62.0) THEN d END) AS next_day
      FROM (SELECT uid, d, min(d) OVER (PARTITION BY uid) AS fd FROM sess) GROUP BY uid"""
    out["visit_numbers"] = """
      SELECT uid AS user_pseudo_id, st AS session_start_ts, sid AS ga_session_id, d AS session_date, bought AS purchased,
             orders, revenue, visit AS visit_number FROM ordered"""
    out["event_profile"] = f"""
      SELECT d AS event_date, name AS event_name, uid AS user_pseudo_id, count(*) AS events,
             {n("sid IS NULL")} AS missing_session_id, min(snum) AS min_session_number,
             {n("name = 'purchase' AND tx IS NULL")} AS null_transaction_id,
             {n("name = 'purchase' AND tx = '(not set)'")} AS not_set_transaction_id,
             {n("name = 'purchase' AND rev IS NULL")} AS null_revenue, {n("name = 'purchase' AND rev = 0")} AS zero_revenue,
             CASE WHEN bool_or(name = 'purchase' AND rev IS NOT NULL) THEN {m("CASE WHEN name = 'purchase' THEN rev END")} END AS revenue,
             count(CASE WHEN name = 'purchase' THEN rev END) AS with_revenue,
             min(CASE WHEN name = 'purchase' THEN rev END) AS min_revenue, max(CASE WHEN name = 'purchase' THEN rev END) AS max_revenue
      FROM ev GROUP BY d, name, uid"""
    out["cart_window_sessions"] = out["sessions"].replace("FROM sess", "FROM cs")
    out["cart_window_users"] = """
      SELECT uid AS user_pseudo_id, channel AS acq_channel, fdev AS first_device_category, sessions,
             f_view AS reached_view_item, f_cart AS reached_add_to_cart, f_chk AS reached_begin_checkout,
             f_ship AS reached_add_shipping_info, f_pay AS reached_add_payment_info, bought AS purchased, orders,
             revenue AS revenue_usd FROM cu"""
    out["funnel_steps"] = f"""
      SELECT * FROM (
        WITH uc AS ({_stage_union(STEPS, "cu")}), sc AS ({_stage_union(STEPS, "cs")}) {_steps_sql()})"""
    out["funnel_abandonment"] = " UNION ALL ".join(
        f"""SELECT '{level}' AS level, {n("f_cart")} AS added_to_cart, {n("f_cart AND NOT bought")} AS cart_abandoned,
              {pc(n("f_cart AND NOT bought"), n("f_cart"))} AS cart_abandonment_pct, {n("f_chk")} AS began_checkout,
              {n("f_chk AND NOT bought")} AS checkout_abandoned,
              {pc(n("f_chk AND NOT bought"), n("f_chk"))} AS checkout_abandonment_pct FROM {table}"""
        for level, table in (("users", "cu"), ("sessions", "cs"))
    )
    out["funnel_open_checks"] = f"""
      SELECT {n("bought")} AS purchasers, {n("bought AND NOT f_view")} AS purchasers_without_product_view,
             {n("bought AND NOT f_cart")} AS purchasers_without_add_to_cart,
             {n("bought AND NOT f_chk")} AS purchasers_without_begin_checkout,
             {n("bought AND NOT f_pay")} AS purchasers_without_add_payment_info,
             {pc(n("bought AND NOT f_cart"), n("bought"))} AS pct_purchasers_without_add_to_cart,
             {n("f_chk")} AS checkout_users, {n("f_chk AND NOT f_cart")} AS checkout_users_without_add_to_cart,
             {pc(n("f_chk AND NOT f_cart"), n("f_chk"))} AS pct_checkout_users_without_add_to_cart FROM cu"""
    out["funnel_strict"] = f"""
      SELECT *, {pc("add_to_cart", "product_view")} AS strict_view_to_cart_pct,
             {pc("begin_checkout", "add_to_cart")} AS strict_cart_to_checkout_pct,
             {pc("add_payment_info", "begin_checkout")} AS strict_checkout_to_payment_pct,
             {pc("purchase", "add_payment_info")} AS strict_payment_to_purchase_pct,
             {pc("purchase", "users_all")} AS strict_overall_conversion_pct
      FROM (SELECT count(*) AS users_all, {n("depth >= 1")} AS product_view, {n("depth >= 2")} AS add_to_cart,
                   {n("depth >= 3")} AS begin_checkout, {n("depth >= 4")} AS add_payment_info,
                   {n("depth >= 5")} AS purchase
            FROM (SELECT CASE WHEN NOT f_view THEN 0 WHEN NOT f_cart THEN 1 WHEN NOT f_chk THEN 2
                              WHEN NOT f_pay THEN 3 WHEN NOT bought THEN 4 ELSE 5 END AS depth FROM cu))"""
    whole = ", ".join(f"({o}, '{label}', {'NULL::INTEGER' if p is None else p})" for o, label, _, p in WHOLE)
    out["funnel_whole_period"] = f"""
      SELECT st.o AS stage_order, label AS stage, a.c AS users, {pc("a.c", "b.c")} AS users_step_conversion_pct,
             {pc("b.c - a.c", "b.c")} AS users_drop_off_pct
      FROM (VALUES {whole}) st(o, label, ref)
      JOIN ({_stage_union(WHOLE, "usr")}) a ON a.o = st.o
      LEFT JOIN ({_stage_union(WHOLE, "usr")}) b ON b.o = st.ref"""
    out["funnel_window_value"] = f"""
      SELECT count(*) AS users, {n("bought")} AS buyers, {s("orders")} AS orders, {rm(m("revenue"))} AS revenue_usd,
             {q(m("revenue"), n("bought"), 2)} AS revenue_per_buyer, {q(m("revenue"), s("orders"), 2)} AS aov,
             {cart_days} AS days_in_window FROM cu"""
    out["cart_tracking_daily"] = f"""
      SELECT d AS date, count(*) AS sessions, {n("f_view")} AS product_view_sessions, {n("f_cart")} AS add_to_cart_sessions,
             {n("f_chk")} AS begin_checkout_sessions, {pc(n("f_cart"), n("f_view"))} AS cart_pct_of_product_view_sessions,
             d >= DATE '{cart}' AS in_cart_window FROM sess GROUP BY d"""

    # Channels, devices, countries.
    out["channel_performance"] = f"""
      SELECT coalesce(channel, 'All users') AS acq_channel,
             coalesce(channel, '') IN ('Other (obscured)', 'Data deleted') AS is_obscured, u AS users,
             {pc("u", "(SELECT count(*) FROM usr)")} AS pct_of_users, ss AS sessions, {q("ss", "u", 2)} AS sessions_per_user,
             b AS purchasers, o AS orders, {pc("b", "u")} AS conversion_rate_pct, {rm("rv")} AS revenue_usd,
             {pc("rv", f"(SELECT {m('revenue')} FROM usr)")} AS pct_of_revenue, {q("rv", "u", 3)} AS revenue_per_user,
             {q("rv", "o", 2)} AS aov
      FROM (SELECT channel, count(*) AS u, {s("sessions")} AS ss, {n("bought")} AS b, {s("orders")} AS o,
                   {m("revenue")} AS rv FROM usr GROUP BY GROUPING SETS ((channel), ()))"""
    out["channel_funnel"] = f"""
      SELECT *, {pc("product_view", "users")} AS view_pct_of_users, {pc("add_to_cart", "product_view")} AS cart_pct_of_view,
             {pc("begin_checkout", "add_to_cart")} AS checkout_pct_of_cart,
             {pc("add_payment_info", "begin_checkout")} AS payment_pct_of_checkout,
             {pc("purchase", "add_payment_info")} AS purchase_pct_of_payment,
             {pc("purchase", "product_view")} AS purchase_pct_of_viewers
      FROM (SELECT channel AS acq_channel, count(*) AS users, {MAIN_COUNTS} FROM cu GROUP BY channel)"""
    out["channel_sources"] = f"""
      SELECT channel AS acq_channel, medium AS acq_medium, source AS acq_source, count(*) AS users,
             {n("bought")} AS purchasers, {s("orders")} AS orders, {pc(n("bought"), "count(*)")} AS conversion_rate_pct,
             {rm(m("revenue"))} AS revenue_usd, {q(m("revenue"), "count(*)", 3)} AS revenue_per_user
      FROM usr GROUP BY ALL HAVING count(*) >= {source_floor}"""
    out["device_performance"] = f"""
      SELECT device AS device_category, c AS sessions, u AS users, {share("c")} AS pct_of_sessions, b AS purchase,
             o AS orders, {rm("rv")} AS revenue_usd, {share("rv")} AS pct_of_revenue,
             {pc("b", "c")} AS conversion_rate_pct, {q("rv", "c", 3)} AS revenue_per_session, {q("rv", "o", 2)} AS aov
      FROM (SELECT device, count(*) AS c, count(DISTINCT uid) AS u, {n("bought")} AS b, {s("orders")} AS o,
                   {m("revenue")} AS rv FROM sess GROUP BY device)"""
    out["device_funnel_sessions"] = f"""
      SELECT *, {pc("product_view", "sessions")} AS view_pct_of_sessions,
             {pc("add_to_cart", "product_view")} AS cart_pct_of_view,
             {pc("begin_checkout", "add_to_cart")} AS checkout_pct_of_cart,
             {pc("add_payment_info", "begin_checkout")} AS payment_pct_of_checkout,
             {pc("purchase", "add_payment_info")} AS purchase_pct_of_payment,
             {pc("purchase", "sessions")} AS conversion_rate_pct
      FROM (SELECT device AS device_category, count(*) AS sessions, count(DISTINCT uid) AS users, {MAIN_COUNTS}
            FROM cs GROUP BY device)"""
    out["device_funnel_users"] = f"""
      SELECT fdev AS device_category, count(*) AS users, {n("bought")} AS purchase, {s("orders")} AS orders,
             {rm(m("revenue"))} AS revenue_usd, {pc(n("bought"), "count(*)")} AS conversion_rate_pct
      FROM usr GROUP BY fdev"""
    out["country_performance"] = f"""
      SELECT country, u AS users, {share("u")} AS pct_of_users, ss AS sessions, b AS purchasers, o AS orders,
             {pc("b", "u")} AS conversion_rate_pct, {rm("rv")} AS revenue_usd, {share("rv")} AS pct_of_revenue,
             {q("rv", "u", 3)} AS revenue_per_user, {q("rv", "o", 2)} AS aov
      FROM (SELECT fcountry AS country, count(*) AS u, {s("sessions")} AS ss, {n("bought")} AS b, {s("orders")} AS o,
                   {m("revenue")} AS rv FROM usr GROUP BY fcountry)"""

    # Retention.
    out["new_vs_returning"] = f"""
      SELECT utype AS user_type, u AS users, {share("u")} AS pct_of_users, ss AS sessions,
             {q("ss", "u", 3)} AS sessions_per_user, {q("dd", "u", 3)} AS active_days_per_user, rp AS repeat_visitors,
             {pc("rp", "u")} AS repeat_visit_rate_pct, b AS buyers, {pc("b", "u")} AS purchase_rate_pct, o AS orders,
             rb AS repeat_buyers, {rm("rv")} AS revenue_usd, {share("rv")} AS pct_of_revenue,
             {q("rv", "u", 3)} AS revenue_per_user, {q("rv", "o", 2)} AS aov
      FROM (SELECT utype, count(*) AS u, {s("sessions")} AS ss, {s("days")} AS dd, {n("sessions > 1")} AS rp,
                   {n("bought")} AS b, {s("orders")} AS o, {n("orders > 1")} AS rb, {m("revenue")} AS rv
            FROM usr GROUP BY utype)"""
    equal = f"""(SELECT u.uid, u.utype, u.rt2, count(*) AS c, {s("x.orders")} AS o, {m("x.revenue")} AS rv
                 FROM usr u JOIN sess x ON x.uid = u.uid AND x.d - u.fd BETWEEN 0 AND {w2}
                 WHERE u.el2 GROUP BY u.uid, u.utype, u.rt2)"""
    out["new_vs_returning_window"] = f"""
      SELECT utype AS user_type, count(*) AS users, {q(s("c"), "count(*)", 3)} AS sessions_per_user,
             {pc(n("c > 1"), "count(*)")} AS repeat_visit_rate_pct, {n("o > 0")} AS buyers,
             {pc(n("o > 0"), "count(*)")} AS purchase_rate_pct, {s("o")} AS orders, {rm(m("rv"))} AS revenue_usd,
             {q(m("rv"), "count(*)", 3)} AS revenue_per_user, {q(m("rv"), s("o"), 2)} AS aov
      FROM {equal} GROUP BY utype"""
    out["returner_value"] = f"""
      SELECT rt2 AS returned_within_{w2}d, count(*) AS users, {n("o > 0")} AS buyers,
             {pc(n("o > 0"), "count(*)")} AS purchase_rate_pct, {rm(m("rv"))} AS revenue_usd,
             {q(m("rv"), "count(*)", 3)} AS revenue_per_user
      FROM {equal} WHERE utype = 'new' GROUP BY rt2"""
    out["retention_summary"] = " UNION ALL ".join(
        f"""SELECT utype AS user_type, {w} AS window_days, {n(f"el{i}")} AS eligible_users,
                   {n(f"el{i} AND rt{i}")} AS returned, {pc(n(f"el{i} AND rt{i}"), n(f"el{i}"))} AS return_rate_pct
            FROM usr GROUP BY utype"""
        for i, w in ((1, w1), (2, w2))
    )
    both = f"""{n("el1")} AS eligible_{w1}d_users, {pc(n("el1 AND rt1"), n("el1"))} AS return_{w1}d_pct,
               {n("el2")} AS eligible_{w2}d_users, {pc(n("el2 AND rt2"), n("el2"))} AS return_{w2}d_pct,
               {pc(n("bought"), "count(*)")} AS purchase_rate_pct"""
    out["retention_by_channel"] = f"""
      SELECT channel AS acq_channel, count(*) AS new_users, {both}, {n("el2 AND rt2")} AS returned_{w2}d,
             {q(m("revenue"), "count(*)", 3)} AS revenue_per_user
      FROM usr WHERE utype = 'new' GROUP BY channel"""
    out["retention_by_cohort_week"] = f"""
      SELECT CAST(date_trunc('week', fd) AS DATE) AS cohort_week, count(*) AS new_users, {both}
      FROM usr WHERE utype = 'new' GROUP BY 1"""
    out["sessions_per_user"] = f"""
      SELECT bucket AS sessions_bucket, lo AS min_sessions, u AS users, {share("u")} AS pct_of_users, b AS buyers,
             {pc("b", "u")} AS purchase_rate_pct, {rm("rv")} AS revenue_usd, {share("rv")} AS pct_of_revenue,
             {q("rv", "u", 3)} AS revenue_per_user
      FROM (SELECT CASE WHEN sessions > 5 THEN '6+ sessions' WHEN sessions > 3 THEN '4-5 sessions'
                        WHEN sessions > 1 THEN sessions || ' sessions' ELSE '1 session' END AS bucket,
                   min(sessions) AS lo, count(*) AS u, {n("bought")} AS b, {m("revenue")} AS rv
            FROM usr GROUP BY 1)"""
    out["revenue_by_visit_number"] = f"""
      SELECT utype AS user_type, ['1st visit', '2nd visit', '3rd visit or later'][v] AS visit, lo AS min_visit_number,
             c AS sessions, b AS purchasing_sessions, {pc("b", "c")} AS conversion_rate_pct, o AS orders,
             {rm("rv")} AS revenue_usd, {share("rv", by="PARTITION BY utype")} AS pct_of_user_type_revenue
      FROM (SELECT u.utype, least(x.visit, 3) AS v, min(x.visit)::INTEGER AS lo, count(*) AS c, {n("x.bought")} AS b,
                   {s("x.orders")} AS o, {m("x.revenue")} AS rv
            FROM ordered x JOIN usr u USING (uid) GROUP BY 1, 2)"""
    out["first_purchase_timing"] = f"""
      SELECT utype AS user_type, ['First visit', 'Second visit', 'Third visit or later'][v] AS first_purchase_on,
             lo AS min_visit_number, c AS buyers, {share("c", by="PARTITION BY utype")} AS pct_of_buyers, b0 AS bought_on_first_day,
             md AS median_days_after_first_visit
      FROM (SELECT u.utype, least(f.fv, 3) AS v, min(f.fv) AS lo, count(*) AS c, {n("f.fb = u.fd")} AS b0,
                   quantile_disc(f.fb - u.fd, 0.5)::INTEGER AS md
            FROM (SELECT uid, min(visit) AS fv, min(d) AS fb FROM ordered WHERE bought GROUP BY uid) f
            JOIN usr u USING (uid) GROUP BY 1, 2)"""

    # Seasonality.
    facts = f"""SELECT p.ord, p.label, p.cmp, (p.b - p.a + 1)::INTEGER AS days, count(DISTINCT x.uid) AS u, count(x.d) AS c,
                       {n("x.bought")} AS ps, count(DISTINCT x.uid) FILTER (WHERE x.bought) AS b,
                       coalesce({s("x.orders")}, 0) AS o, coalesce({m("x.revenue")}, 0) AS rv
                FROM period p LEFT JOIN sess x ON x.d BETWEEN p.a AND p.b GROUP BY p.ord, p.label, p.cmp, p.a, p.b"""
    changes = (
        ("daily_users", "du"), ("sessions_per_day", "c / days"), ("orders_per_day", "o / days"),
        ("revenue_per_day", "rv / days"), ("conversion", "100 * ps / c"), ("aov", "rv / nullif(o, 0)"),
    )
    bases = ", ".join(f"max(CASE WHEN ord = 1 THEN {x} END) OVER () AS z{i}" for i, (_, x) in enumerate(changes))
    diffs = ", ".join(
        f"{r(f'100 * (({x}) / nullif(z{i}, 0) - 1)', 1)} AS {name}_vs_baseline_pct"
        for i, (name, x) in enumerate(changes)
    )
    out["period_summary"] = f"""
      SELECT ord AS period_order, label AS period, cmp AS is_comparison, days, u AS users, {r("du", 0)} AS avg_daily_users,
             c AS sessions, {q("c", "days", 0)} AS sessions_per_day, {pc("coalesce(nu, 0)", "u")} AS pct_users_new_in_period,
             ps AS purchasing_sessions, b AS buyers, o AS orders, {q("o", "days", 1)} AS orders_per_day,
             {rm("rv")} AS revenue_usd, {q("rv", "days", 0)} AS revenue_per_day,
             {pc("ps", "c", 3)} AS session_conversion_pct, {pc("b", "u", 3)} AS user_conversion_pct,
             {q("rv", "o", 2)} AS aov, {diffs}
      FROM (SELECT *, {bases}
            FROM ({facts})
            LEFT JOIN (SELECT p.ord, avg(y.u) AS du FROM (SELECT d, count(DISTINCT uid) AS u FROM sess GROUP BY d) y
                       JOIN period p ON y.d BETWEEN p.a AND p.b GROUP BY p.ord) USING (ord)
            LEFT JOIN (SELECT p.ord, {n("x.utype = 'new'")} AS nu FROM usr x
                       JOIN period p ON x.fd BETWEEN p.a AND p.b GROUP BY p.ord) USING (ord))"""
    out["weekly_trend"] = f"""
      SELECT CAST(date_trunc('week', d) AS DATE) AS week_start, count(DISTINCT d)::INTEGER AS days_in_data,
             count(DISTINCT uid) AS users, count(*) AS sessions, count(DISTINCT uid) FILTER (WHERE bought) AS buyers,
             {n("bought")} AS purchasing_sessions, {s("orders")} AS orders, {rm(m("revenue"))} AS revenue_usd,
             {pc(n("bought"), "count(*)", 3)} AS session_conversion_pct,
             {pc("count(DISTINCT uid) FILTER (WHERE bought)", "count(DISTINCT uid)", 3)} AS user_conversion_pct,
             {q(m("revenue"), s("orders"), 2)} AS aov, max(d) < DATE '{revenue_end}' AS purchase_data_reliable
      FROM sess GROUP BY 1"""
    out["daily_trend"] = f"""
      SELECT a.*, dayname(a.date) AS day_of_week, coalesce(nu, 0) AS new_users,
             {pc("purchasing_sessions", "sessions", 3)} AS session_conversion_pct, {q("revenue_usd", "orders", 2)} AS aov,
             a.date >= DATE '{cart}' AS add_to_cart_reliable, a.date < DATE '{revenue_end}' AS purchase_data_reliable
      FROM (SELECT d AS date, count(DISTINCT uid) AS users, count(*) AS sessions, {n("f_view")} AS product_view_sessions,
                   {n("f_cart")} AS add_to_cart_sessions, {n("f_chk")} AS begin_checkout_sessions,
                   {n("f_pay")} AS add_payment_sessions, {n("bought")} AS purchasing_sessions,
                   count(DISTINCT uid) FILTER (WHERE bought) AS buyers, {s("orders")} AS orders,
                   {rm(m("revenue"))} AS revenue_usd
            FROM sess GROUP BY d) a
      LEFT JOIN (SELECT fd, count(*) AS nu FROM usr WHERE utype = 'new' GROUP BY fd) u ON u.fd = a.date"""
    out["period_funnel"] = f"""
      SELECT ord AS period_order, label AS period, count(*) AS sessions,
             {pc(n("f_view"), "count(*)")} AS product_view_pct_of_sessions,
             {pc(n("f_chk"), "count(*)")} AS begin_checkout_pct_of_sessions,
             {pc(n("f_chk"), n("f_view"))} AS checkout_per_100_product_view_sessions,
             {pc(n("f_pay"), n("f_chk"))} AS payment_pct_of_checkout, {pc(n("bought"), n("f_pay"))} AS purchase_pct_of_payment,
             {pc(n("bought"), "count(*)", 3)} AS session_conversion_pct
      FROM sess JOIN period ON d BETWEEN a AND b AND cmp GROUP BY ord, label"""
    out["period_channel_mix"] = f"""
      SELECT ord AS period_order, label AS period, channel AS acq_channel, c AS sessions,
             {share("c", by="PARTITION BY ord")} AS pct_of_period_sessions, ps AS purchasing_sessions,
             {pc("ps", "c", 3)} AS session_conversion_pct, {rm("rv")} AS revenue_usd
      FROM (SELECT ord, label, channel, count(*) AS c, {n("bought")} AS ps, {m("revenue")} AS rv
            FROM sess JOIN period ON d BETWEEN a AND b AND cmp GROUP BY ALL)"""

    # Facts.
    first, last = {"clicks": ("2024-01-01", "2024-01-30"), "visitors": ("2024-01-01", "2024-01-30"), "history": ("1995-01-01", "2004-12-31"),
                   "items": ("1995-01-01", "2001-12-31")}[source]
    out["dim_date"] = f"""
      SELECT dt AS date, dayname(dt) AS day_of_week, CAST(date_trunc('week', dt) AS DATE) AS week_start,
             strftime(dt, '%b %Y') AS month_label, CAST(date_trunc('month', dt) AS DATE) AS month_start, label AS period,
             dt >= DATE '{cart}' AS add_to_cart_reliable, dt < DATE '{revenue_end}' AS purchase_data_reliable
      FROM (SELECT CAST(unnest(generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 DAY)) AS DATE) AS dt)
      LEFT JOIN period ON dt BETWEEN a AND b"""
    out["fact_sessions"] = f"""
      SELECT date, acq_channel, device_category, bucket AS country, user_type, count(*) AS sessions,
             {n("visit = 1")} AS first_seen_users, {n("f_view")} AS product_view_sessions, {n("f_cart")} AS cart_sessions,
             {n("f_cart AND NOT bought")} AS cart_abandoned_sessions, {n("f_chk")} AS checkout_sessions,
             {n("f_chk AND NOT bought")} AS checkout_abandoned_sessions, {n("f_pay")} AS payment_sessions,
             {n("bought")} AS purchasing_sessions, {s("orders")} AS orders, {rm(m("revenue"))} AS revenue_usd
      FROM (SELECT x.d AS date, x.channel AS acq_channel, x.device AS device_category, u.utype AS user_type, x.visit,
                   x.f_view, x.f_cart, x.f_chk, x.f_pay, x.bought, x.orders, x.revenue,
                   CASE WHEN g.fcountry IS NULL THEN 'Other (under {country_floor} users)' ELSE x.country END AS bucket
            FROM ordered x JOIN usr u USING (uid)
            LEFT JOIN (SELECT fcountry FROM usr GROUP BY fcountry HAVING count(*) >= {country_floor}) g
              ON g.fcountry = x.country)
      GROUP BY ALL"""
    out["fact_cohort_daily"] = f"""
      SELECT fd AS first_visit_date, utype AS user_type, count(*) AS users, {n("sessions > 1")} AS repeat_visitors,
             {n("el1")} AS eligible_{w1}d_users, {n("el1 AND rt1")} AS returned_{w1}d,
             {n("el2")} AS eligible_{w2}d_users, {n("el2 AND rt2")} AS returned_{w2}d,
             {n("bought")} AS buyers, {rm(m("revenue"))} AS revenue_usd FROM usr GROUP BY fd, utype"""

    # Products.
    if source == "items":
        out["item_impressions"] = """
          SELECT uid AS user_pseudo_id, epoch_us(ts) AS event_timestamp, d AS event_date, item AS item_name FROM imp"""
        out["item_cart_adds"] = "SELECT uid AS user_pseudo_id, d AS event_date, item AS item_name FROM crt"
        out["item_purchases"] = """
          SELECT uid AS user_pseudo_id, d AS event_date, item AS item_name, qty AS quantity, amt AS revenue FROM pur"""
        out["product_group"] = "SELECT item AS item_name, grp AS product_group FROM rated"
        columns = """item AS item_name, grp AS product_group, imps AS impressions, imp_users AS impression_users,
             imps_w AS impressions_cart_window, adds AS cart_adds, add_users AS cart_users, lines AS order_lines,
             lines_w AS order_lines_cart_window, buyers, units, revenue AS revenue_usd, price AS avg_unit_price,
             v2c AS view_to_cart_pct, c2p AS cart_to_purchase_pct, v2p AS view_to_purchase_pct, rpv AS revenue_per_view"""
        out["products"] = f"""
          SELECT {columns}, meets AS meets_view_floor, quad AS quadrant, mi AS median_impressions,
                 mv AS median_view_to_purchase_pct FROM prod"""
        out["products_export"] = out["products"]
        out["product_quadrants"] = """
          SELECT item AS item_name, quad AS quadrant, mi AS median_impressions, mv AS median_view_to_purchase_pct
          FROM prod WHERE meets"""
        out["product_groups"] = f"""
          SELECT grp AS product_group, p AS products, i AS impressions, a AS cart_adds, l AS order_lines, u AS units,
                 {rm("rv")} AS revenue_usd, {share("rv")} AS pct_of_revenue, {pc("a", "i", 3)} AS view_to_cart_pct,
                 {pc("l", "i", 3)} AS view_to_purchase_pct
          FROM (SELECT grp, count(*) AS p, {s("imps")} AS i, {s("adds")} AS a, {s("lines")} AS l, {s("units")} AS u,
                       {m("revenue")} AS rv FROM prod GROUP BY grp)"""
        out["product_quadrant_summary"] = f"""
          SELECT quad AS quadrant, p AS products, i AS impressions, {share("i")} AS pct_of_impressions, l AS order_lines,
                 {rm("rv")} AS revenue_usd, {share("rv")} AS pct_of_revenue, {q("pr", "np", 2)} AS avg_unit_price
          FROM (SELECT quad, count(*) AS p, {s("imps")} AS i, {s("lines")} AS l, {m("revenue")} AS rv, {m("price")} AS pr,
                       count(price) AS np FROM prod WHERE meets GROUP BY quad)"""
        out["check_products"] = f"""
          SELECT count(*) AS products, {n("meets")} AS products_meeting_view_floor, {n("lines > 0")} AS products_sold,
                 {s("imps")} AS total_impressions, {s("adds")} AS identified_cart_adds, {s("lines")} AS order_lines,
                 {s("units")} AS units, {rm(m("revenue"))} AS item_revenue_usd,
                 {r(f"{m('revenue')} - (SELECT {m('revenue')} FROM sess)", 2)} AS item_minus_order_revenue_usd,
                 {n("grp = 'Other'")} AS products_in_other_group,
                 {pc(m("CASE WHEN grp = 'Other' THEN revenue ELSE 0 END"), m("revenue"))} AS pct_revenue_in_other_group
          FROM prod"""
        out["fact_product_daily"] = f"""
          SELECT d AS date, item AS item_name, coalesce(grp, 'Other') AS product_group,
                 coalesce(quad, 'Below 600 impressions') AS quadrant, {n("kind = 1")} AS impressions,
                 {n("kind = 2")} AS cart_adds, {n("kind = 3")} AS order_lines, coalesce({s("qty")}, 0) AS units,
                 coalesce({rm(m("amt"))}, 0) AS revenue_usd
          FROM (SELECT d, item, 1 AS kind, NULL::BIGINT AS qty, NULL::DOUBLE AS amt FROM imp
                UNION ALL SELECT d, item, 2, NULL, NULL FROM crt
                UNION ALL SELECT d, item, 3, qty, amt FROM pur)
          LEFT JOIN prod USING (item) GROUP BY d, item, grp, quad"""
    return out


REPORTS = {source: reports(source) for source in SETTINGS}


def report(source: str, name: str) -> str:
    return sql(source, REPORTS[source][name])


def on_reports(source: str, body: str, *names: str, **ctes: str) -> str:
    """A statement over the results of reports, each available as a CTE of its name."""
    return sql(source, body, **{name: REPORTS[source][name] for name in names}, **ctes)
