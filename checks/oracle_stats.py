"""DuckDB SQL for the statistics, sizing and dashboard-measure queries."""

from __future__ import annotations

from checks.oracle import SETTINGS, on_reports, report
from checks.oracle_base import CLICKSTREAM, VISITORS, m, n, pc, q, r, rm, s, sql

# Complementary error function, Numerical Recipes 6.2 (fixed values).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587,
        -0.82215223, 0.17087277)


def _p(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {x} / 2.0::DOUBLE))"
    poly = " + ".join(f"({c}::DOUBLE) * pow({t}, {i})" for i, c in enumerate(ERFC))
    return f"({t} * exp({poly} - {x} * {x}))"


def _ztest(rows: str, keep: str) -> str:
    """Adds diff, z and p to rows that have x1, n1, x2, n2."""
    return f"""(SELECT {keep}, diff, z, {_p("z")} AS p FROM (
      SELECT *, CASE WHEN pool > 0 AND pool < 1 THEN diff / sqrt(pool * (1 - pool) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) END AS z
      FROM (SELECT *, x1 / n1 - x2 / n2 AS diff, (x1 + x2) / (n1 + n2) AS pool
            FROM (SELECT * REPLACE (x1::DOUBLE AS x1, n1::DOUBLE AS n1, x2::DOUBLE AS x2, n2::DOUBLE AS n2)
                  FROM ({rows})))))"""


def _wilson(x: str, size: str) -> tuple[str, str]:
    p, zz = f"({x}::DOUBLE / {size})", "(1.96::DOUBLE * 1.96)"
    centre = f"({p} + {zz} / (2.0::DOUBLE * {size}))"
    half = f"(1.96::DOUBLE * sqrt({p} * (1 - {p}) / {size} + {zz} / (4.0::DOUBLE * {size} * {size})))"
    below = f"(1 + {zz} / {size})"
    return f"(({centre} - {half}) / {below})", f"(({centre} + {half}) / {below})"


def _r6(x: str) -> str:
    return r(x, 6)


def statistics() -> dict[str, str]:
    out: dict[str, str] = {}
    lo, hi = _wilson("purchasers", "users")
    out["channel_intervals"] = on_reports(
        "history",
        f"""SELECT acq_channel, users, purchasers, {_r6(pc("purchasers", "users", None))} AS conversion_pct,
                   {_r6(f"100 * {lo}")} AS lo_pct, {_r6(f"100 * {hi}")} AS hi_pct
            FROM channel_performance WHERE acq_channel <> 'All users'""",
        "channel_performance",
    )
    rows = """SELECT a.acq_channel || ' vs Organic' AS comparison, a.purchasers AS x1, a.users AS n1,
                     b.purchasers AS x2, b.users AS n2
              FROM channel_performance a, channel_performance b
              WHERE b.acq_channel = 'Organic' AND a.acq_channel IN ('Referral', 'Paid (cpc)', 'Direct')"""
    out["channel_tests"] = on_reports(
        "history",
        f"""SELECT comparison, {_r6("100 * diff")} AS difference_pp, {_r6("z")} AS z, {_r6("p")} AS p_value,
                   coalesce(p < 0.05, false) AS significant FROM {_ztest(rows, "comparison")}""",
        "channel_performance",
    )
    checks = (
        (1, "Product view (of sessions)", "mobile", "device_funnel_sessions", "product_view", "sessions"),
        (2, "Add to cart (of viewers)", "mobile", "device_funnel_sessions", "add_to_cart", "product_view"),
        (3, "Begin checkout (of cart)", "mobile", "device_funnel_sessions", "begin_checkout", "add_to_cart"),
        (4, "Add payment (of checkout)", "mobile", "device_funnel_sessions", "add_payment_info", "begin_checkout"),
        (5, "Purchase (of payment)", "mobile", "device_funnel_sessions", "purchase", "add_payment_info"),
        (6, "Overall conversion (of sessions, whole period)", "mobile", "device_performance", "purchase", "sessions"),
        (7, "Purchase (of payment), tablet", "tablet", "device_funnel_sessions", "purchase", "add_payment_info"),
        (8, "Overall conversion (of users, first device)", "mobile", "device_funnel_users", "purchase", "users"),
    )
    rows = " UNION ALL ".join(
        f"""SELECT {i} AS o, '{label}' AS label, '{device}' AS device, a.{x} AS x1, a.{size} AS n1, b.{x} AS x2, b.{size} AS n2
            FROM {t} a, {t} b WHERE a.device_category = '{device}' AND b.device_category = 'desktop'"""
        for i, label, device, t, x, size in checks
    )
    out["device_tests"] = on_reports(
        "clicks",
        f"""SELECT o AS check_order, label AS check, device, {_r6("100 * x1 / n1")} AS device_pct,
                   {_r6("100 * x2 / n2")} AS desktop_pct, {_r6("100 * diff")} AS gap_pp, {_r6("z")} AS z, {_r6("p")} AS p_value,
                   coalesce(p < 0.05, false) AS significant,
                   o <= 6 AND abs(diff) = max(CASE WHEN o <= 6 THEN abs(diff) END) OVER () AS largest_gap
            FROM {_ztest(rows, "o, label, device, x1, n1, x2, n2")}""",
        "device_funnel_sessions",
        "device_performance",
        "device_funnel_users",
    )
    lo, hi = _wilson("purchasers", "users")
    floor = SETTINGS["history"][5]
    rows = f"""SELECT c.*, purchasers AS x1, users AS n1, sum(purchasers) OVER () - purchasers AS x2,
                      sum(users) OVER () - users AS n2 FROM country_performance c"""
    tested = f"""
      SELECT country, users, purchasers, {_r6(pc("purchasers", "users", None))} AS conversion_pct,
             {_r6(f"100 * {lo}")} AS lo_pct, {_r6(f"100 * {hi}")} AS hi_pct, {_r6("100 * diff")} AS diff_vs_rest_pp,
             {_r6("p")} AS p_value, coalesce(p < 0.05, false) AS significant, coalesce(p < 0.05 / count(*) OVER (), false) AS significant_corrected,
             revenue_usd, pct_of_users, pct_of_revenue
      FROM {_ztest(rows, "* EXCLUDE (diff, z)")} WHERE users >= {floor} AND country <> '(not set)'"""
    tested = tested.replace("* EXCLUDE (diff, z)", "country, users, purchasers, revenue_usd, pct_of_users, pct_of_revenue")
    out["segment_vs_rest"] = on_reports("history", tested, "country_performance")
    out["lowest_segments"] = on_reports(
        "history",
        """SELECT country, users, purchasers, conversion_pct, diff_vs_rest_pp, p_value FROM tested
           ORDER BY conversion_pct, country LIMIT 5""",
        "country_performance",
        tested=tested,
    )
    out["small_segment_illusion"] = on_reports(
        "history",
        f"""SELECT country, users, purchasers, conversion_rate_pct FROM country_performance WHERE users < {floor}
            ORDER BY conversion_rate_pct DESC, country LIMIT 5""",
        "country_performance",
    )
    out["pareto"] = on_reports(
        "history",
        """SELECT a.country, a.revenue_usd, a.pct_of_revenue,
                  (SELECT sum(CAST(b.pct_of_revenue AS DECIMAL(18, 4)))::DOUBLE FROM country_performance b
                   WHERE (b.revenue_usd, a.country) >= (a.revenue_usd, b.country)) AS cum_pct
           FROM country_performance a ORDER BY revenue_usd DESC, country LIMIT 10""",
        "country_performance",
    )
    late = SETTINGS["clicks"][1]
    out["tracking_gaps"] = on_reports(
        "clicks",
        f"""SELECT *, {pc("late_zero_revenue", "late_purchase_events")} AS late_zero_revenue_pct
            FROM (SELECT {n("add_to_cart_events = 0")} AS days_without_add_to_cart,
                         coalesce(sum(purchase_events) FILTER (WHERE event_date >= DATE '{late}'), 0)::BIGINT
                           AS late_purchase_events,
                         coalesce(sum(purchase_events_zero_revenue) FILTER (WHERE event_date >= DATE '{late}'), 0)::BIGINT
                           AS late_zero_revenue FROM dq_daily_tracking)""",
        "dq_daily_tracking",
    )
    out["tracking_daily_shares"] = on_reports(
        "clicks",
        f"""SELECT event_date, purchase_events, {pc("purchase_events_without_id", "purchase_events")} AS without_id_pct,
                   {pc("purchase_events_zero_revenue", "purchase_events")} AS zero_revenue_pct FROM dq_daily_tracking""",
        "dq_daily_tracking",
    )
    stages = (("Product view", "product_view", 2), ("Add to cart", "add_to_cart", 3), ("Begin checkout", "begin_checkout", 4),
              ("Add payment info", "add_payment_info", 6), ("Purchase", "purchase", 7))
    strict = " UNION ALL ".join(f"SELECT '{label}' AS stage, {c} AS c FROM funnel_strict" for label, c, _ in stages)
    out["open_vs_strict"] = on_reports(
        "clicks",
        f"""SELECT stage_order, stage, users AS open_users, c AS strict_users,
                   {pc("users", "lag(users) OVER (ORDER BY stage_order)", 1)} AS open_step_pct,
                   {pc("c", "lag(c) OVER (ORDER BY stage_order)", 1)} AS strict_step_pct
            FROM funnel_steps JOIN ({strict}) USING (stage)""",
        "funnel_steps",
        "funnel_strict",
    )
    out["whole_vs_window"] = on_reports(
        "clicks",
        """SELECT w.stage_order, w.stage, w.users AS users_whole_period,
                  w.users_step_conversion_pct AS step_conversion_whole_pct,
                  f.users_step_conversion_pct AS step_conversion_window_pct
           FROM funnel_whole_period w LEFT JOIN funnel_steps f USING (stage)""",
        "funnel_whole_period",
        "funnel_steps",
    )
    out["quadrant_yield"] = on_reports(
        "items",
        f"""SELECT quadrant, products, pct_of_impressions, pct_of_revenue, revenue_usd,
                   {r("revenue_usd / nullif(impressions, 0) * 1000", 4)} AS revenue_per_1k_impressions, avg_unit_price
            FROM product_quadrant_summary""",
        "product_quadrant_summary",
    )
    out["quadrant_leaders"] = on_reports(
        "items",
        f"""SELECT quadrant, position::INTEGER AS position, item_name, product_group, impressions, order_lines, view_to_purchase_pct,
                   {rm("revenue_usd")} AS revenue_usd
            FROM (SELECT *, row_number() OVER (PARTITION BY quadrant ORDER BY
                    CASE WHEN quadrant LIKE 'High%' THEN impressions ELSE revenue_usd END DESC, item_name) AS position
                  FROM products WHERE meets_view_floor) WHERE position <= 8""",
        "products",
    )
    out["revenue_concentration"] = on_reports(
        "items",
        f"""SELECT t.sold AS sold_products, floor(t.sold * 0.2)::BIGINT AS top_products,
                   {pc("(SELECT " + m("revenue_usd") + " FROM (SELECT revenue_usd FROM products ORDER BY revenue_usd DESC LIMIT 10))", "t.rv")}
                     AS top_10_pct_of_revenue,
                   {pc("(SELECT " + m("revenue_usd") + " FROM ranked WHERE rk <= floor(t.sold * 0.2))", "t.rv")}
                     AS top_fraction_pct_of_revenue
            FROM (SELECT {n("order_lines > 0")} AS sold, {m("revenue_usd")} AS rv FROM products) t""",
        "products",
        ranked="""SELECT revenue_usd, row_number() OVER (ORDER BY revenue_usd DESC) AS rk
                  FROM products WHERE order_lines > 0""",
    )
    out["unmatched_products"] = on_reports(
        "items",
        "SELECT item_name, impressions, cart_adds FROM products WHERE impressions >= 5 AND order_lines = 0",
        "products",
    )
    out["impressions_conversion_corr"] = on_reports(
        "items",
        f"""SELECT count(*) AS products, {_r6("corr(ln(impressions), ln(view_to_purchase_pct))")} AS log_log_correlation
            FROM products WHERE meets_view_floor AND view_to_purchase_pct > 0""",
        "products",
    )
    out["impression_reallocation"] = on_reports(
        "items",
        f"""SELECT {r("ly", 4)} AS low_yield_per_1k, {r("hy", 4)} AS hidden_yield_per_1k, {r("li * 0.1::DOUBLE", 4)} AS moved_impressions,
                   {r("li * 0.1::DOUBLE / 1000 * (hy * 0.5::DOUBLE - ly) * 30 / 2557", 2)} AS monthly_gain
            FROM (SELECT max(impressions) FILTER (WHERE quadrant LIKE 'High%') AS li,
                         max(revenue_usd * 1000 / impressions) FILTER (WHERE quadrant LIKE 'High%') AS ly,
                         max(revenue_usd * 1000 / impressions) FILTER (WHERE quadrant LIKE 'Hidden%') AS hy
                  FROM product_quadrant_summary)""",
        "product_quadrant_summary",
    )
    lo, hi = _wilson("returned", "eligible_users")
    out["retention_ci"] = on_reports(
        "history",
        f"""SELECT user_type, window_days, eligible_users, returned, {_r6(pc("returned", "eligible_users", None))} AS rate_pct,
                   {_r6(f"100 * {lo}")} AS lo_pct, {_r6(f"100 * {hi}")} AS hi_pct FROM retention_summary""",
        "retention_summary",
    )
    rows = """SELECT a.buyers AS x1, a.users AS n1, b.buyers AS x2, b.users AS n2
              FROM new_vs_returning_window a, new_vs_returning_window b
              WHERE a.user_type = 'returning' AND b.user_type = 'new'"""
    out["window_purchase_test"] = on_reports(
        "history",
        f"""SELECT {_r6("100 * x1 / n1")} AS returning_pct, {_r6("100 * x2 / n2")} AS new_pct, {_r6("100 * diff")} AS gap_pp,
                   {_r6("z")} AS z, {_r6("p")} AS p_value FROM {_ztest(rows, "x1, n1, x2, n2")}""",
        "new_vs_returning_window",
    )
    out["multi_session_share"] = on_reports(
        "history",
        f"""SELECT {m("pct_of_users")} AS pct_of_users, {m("pct_of_revenue")} AS pct_of_revenue
            FROM sessions_per_user WHERE min_sessions > 1""",
        "sessions_per_user",
    )
    out["early_return_ratio"] = on_reports(
        "history",
        f"""SELECT count(*) AS cohorts, {_r6("min(x)")} AS lowest_pct, {_r6("max(x)")} AS highest_pct
            FROM (SELECT 100 * return_30d_pct / nullif(return_180d_pct, 0) AS x FROM retention_by_cohort_week
                  WHERE eligible_180d_users = new_users AND cohort_week >= DATE '1995-01-01')""",
        "retention_by_cohort_week",
    )
    repeats = """
      SELECT coalesce(sum(c), 0)::BIGINT AS idless_paid_purchases, coalesce(sum(c - 1), 0)::BIGINT AS idless_repeats
      FROM (SELECT count(*) AS c FROM ev WHERE name = 'purchase' AND coalesce(tx, '(not set)') = '(not set)' AND rev > 0
            {where} GROUP BY uid, sid, rev)"""
    out["repeat_orders"] = sql(
        "clicks",
        f"""SELECT a.*, b.* FROM ({repeats.format(where="")}) a,
             (SELECT {n("c > 1")} AS repeated_ids, coalesce(sum(c - 1), 0)::BIGINT AS repeated_id_events
              FROM (SELECT count(*) AS c FROM ev WHERE name = 'purchase' AND tx <> '(not set)' GROUP BY tx)) b""",
    )
    adjusted = "((b.orders - k.idless_repeats) / b.days)"
    for name, source, first, last, per_day in (
        ("baseline_sensitivity", "history", "1997-01-01", "1997-12-31", "a.orders_per_day"),
        ("baseline_sensitivity__visitors", "visitors", "2024-01-01", "2024-01-07", "a.orders_per_day"),
        ("baseline_sensitivity_exact", "visitors", "2024-01-01", "2024-01-07", "(a.orders / a.days)"),
    ):
        baseline = repeats.format(where=f"AND d BETWEEN DATE '{first}' AND DATE '{last}'")
        out[name] = on_reports(
            source,
            f"""SELECT a.period_order, a.period, a.orders_per_day_vs_baseline_pct, {_r6(adjusted)} AS adjusted_baseline_per_day,
                       {r(f"100 * ({per_day} / {adjusted} - 1)", 2)} AS adjusted_vs_baseline_pct
                FROM period_summary a, period_summary b, ({baseline}) k
                WHERE b.period_order = 1 AND a.period_order <> 1 AND a.is_comparison""",
            "period_summary",
        )
    cells = ", ".join(f"max(session_conversion_pct) FILTER (WHERE period_order = {p}) AS conversion_{p}_pct" for p in (1, 2, 3))
    out["period_conversion_pivot"] = on_reports(
        "clicks",
        f"""SELECT *, {", ".join(f"{r(f'100 * (conversion_{p}_pct / nullif(conversion_1_pct, 0) - 1)', 1)} AS change_{p}_pct" for p in (2, 3))}
            FROM (SELECT acq_channel, {cells} FROM period_channel_mix GROUP BY acq_channel)""",
        "period_channel_mix",
    )
    out["full_weeks"] = on_reports("clicks", "SELECT * FROM weekly_trend WHERE days_in_data = 7", "weekly_trend")
    users_at = {label: f"(SELECT users FROM funnel_steps WHERE stage = '{label}')" for label in
                ("Product view", "Add to cart", "Begin checkout", "Add payment info", "Purchase")}
    out["opportunity_sizing"] = on_reports(
        "clicks",
        f"""
        SELECT o AS scenario_order, label AS scenario, {r("extra", 4)} AS extra_users, {r("upper", 4)} AS upper_bound_per_month,
               {r("upper * 0.5::DOUBLE", 4)} AS estimate_per_month, {r("100 * upper * 0.5::DOUBLE / monthly", 4)} AS pct_of_monthly_revenue
        FROM (
          SELECT 1 AS o, 'Win back first-time visitors' AS label, back AS extra, back * gain * 30 / 27 AS upper, monthly FROM inputs
          UNION ALL SELECT 2, 'Fix cart, checkout and payment', path, path * per_buyer, monthly FROM inputs
          UNION ALL SELECT 3, 'Improve product discovery', found, found * per_buyer, monthly FROM inputs)""",
        "funnel_steps",
        "funnel_abandonment",
        "funnel_window_value",
        "channel_funnel",
        "retention_by_channel",
        "returner_value",
        inputs=f"""
          SELECT e.el * (e.goal / 100.0::DOUBLE - e.rt / e.el) AS back, w.hi - w.lo AS gain,
                 {users_at["Add to cart"]} * (c.checkout_pct_of_cart / 100.0::DOUBLE * c.payment_pct_of_checkout / 100.0::DOUBLE)
                   * ({users_at["Purchase"]} / {users_at["Add payment info"]}) - {users_at["Purchase"]} AS path,
                 {users_at["Product view"]} * (c.cart_pct_of_view / 100.0::DOUBLE - {users_at["Add to cart"]} / {users_at["Product view"]})
                   * (1 - a.cart_abandonment_pct / 100.0::DOUBLE) AS found,
                 v.revenue_per_buyer * (30.0::DOUBLE / v.days_in_window) AS per_buyer,
                 v.revenue_usd * (30.0::DOUBLE / v.days_in_window) AS monthly
          FROM funnel_window_value v,
               (SELECT * FROM funnel_abandonment WHERE level = 'users') a,
               (SELECT * FROM channel_funnel WHERE acq_channel = 'Referral') c,
               (SELECT sum(eligible_3d_users)::BIGINT AS el, sum(returned_3d)::BIGINT AS rt,
                       max(return_3d_pct) FILTER (WHERE acq_channel = 'Referral') AS goal FROM retention_by_channel) e,
               (SELECT max(revenue_per_user) FILTER (WHERE returned_within_3d) AS hi,
                       max(revenue_per_user) FILTER (WHERE NOT returned_within_3d) AS lo FROM returner_value) w""",
    )
    out["profile_users"] = sql(
        "clicks",
        f"""SELECT *, {pc("users_with_several_mediums", "users")} AS several_mediums_pct
            FROM (SELECT count(*) AS users, {n("k > 1")} AS users_with_several_mediums
                  FROM (SELECT count(DISTINCT medium) FILTER (WHERE medium NOT IN ('<Other>', '(data deleted)')) AS k
                        FROM ev GROUP BY uid)),
                 (SELECT {n("o.snum > u.low")} AS users_out_of_order FROM ordered o JOIN usr u USING (uid) WHERE o.visit = 1)""",
    )
    out["profile_items"] = sql(
        "items",
        f"""SELECT *, {pc("view_events_without_items", "view_events")} AS view_without_items_pct,
                   {pc("cart_events_naming_the_item", "cart_events")} AS cart_naming_the_item_pct
            FROM (SELECT count(*) AS names, {n("k > 1")} AS names_with_several_ids
                  FROM (SELECT count(DISTINCT i.id) AS k FROM things GROUP BY i.name)),
                 (SELECT count(*) AS ids, {n("k > 1")} AS ids_with_several_names
                  FROM (SELECT count(DISTINCT i.name) AS k FROM things GROUP BY i.id)),
                 (SELECT {n("name = 'view_item'")} AS view_events,
                         {n("name = 'view_item' AND len(items) = 0")} AS view_events_without_items,
                         {n("name = 'add_to_cart'")} AS cart_events,
                         {n("name = 'add_to_cart' AND len(list_filter(items, lambda x: x.qty IS NOT NULL)) > 0")}
                           AS cart_events_naming_the_item FROM ev)""",
        things="SELECT i FROM (SELECT unnest(items) AS i FROM ev) WHERE i.name NOT IN ('(not set)', '')",
    )
    # Where the clickstream says nothing, or 0, a second source speaks.
    for name in ("tracking_gaps", "opportunity_sizing", "repeat_orders", "profile_users"):
        out[f"{name}__visitors"] = out[name].replace(CLICKSTREAM, VISITORS)
    return out


def measures() -> dict[str, str]:
    out: dict[str, str] = {}
    dated = "SELECT f.*, d.* EXCLUDE (date) FROM {facts} f LEFT JOIN dim_date d ON d.date = f.{day}"
    by_day = dated.format(facts="fact_sessions", day="date")
    out["measures_core"] = on_reports(
        "clicks",
        f"""SELECT acq_channel, {s("sessions")} AS "Total Sessions", {s("first_seen_users")} AS "Total Users",
                   {s("orders")} AS "Total Orders", {m("revenue_usd")} AS "Total Revenue",
                   {s("purchasing_sessions")} AS "Purchasing Sessions"
            FROM ({by_day}) GROUP BY acq_channel""",
        "fact_sessions",
        "dim_date",
    )
    out["measures_ratios"] = on_reports(
        "clicks",
        f"""SELECT device_category, {_r6(q(s("purchasing_sessions"), s("sessions")))} AS "Conversion Rate",
                   {_r6(q(m("revenue_usd"), s("orders")))} AS "AOV",
                   {_r6(q(m("revenue_usd"), s("first_seen_users")))} AS "Revenue per User",
                   {_r6(q(m("revenue_usd"), s("sessions")))} AS "Revenue per Session"
            FROM ({by_day}) WHERE user_type = 'new' GROUP BY device_category""",
        "fact_sessions",
        "dim_date",
    )
    kept = "FILTER (WHERE add_to_cart_reliable)"
    funnel = {"Funnel Sessions": "sessions", "Funnel Product View": "product_view_sessions", "Funnel Cart": "cart_sessions",
              "Funnel Checkout": "checkout_sessions", "Funnel Payment": "payment_sessions",
              "Funnel Purchase": "purchasing_sessions"}

    def total(c: str) -> str:
        return f"(sum({c}) {kept})::BIGINT"

    for source, suffix in (("clicks", ""), ("history", "__history")):
        out[f"measures_funnel{suffix}"] = on_reports(
            source,
            f"""SELECT period, {", ".join(f'{total(c)} AS "{name}"' for name, c in funnel.items())}
                FROM ({by_day}) GROUP BY period""",
            "fact_sessions",
            "dim_date",
        )
        out[f"measures_abandonment{suffix}"] = on_reports(
            source,
            f"""SELECT country, {_r6(q(total("purchasing_sessions"), total("sessions")))} AS "Funnel Conversion",
                       {_r6(q(total("cart_abandoned_sessions"), total("cart_sessions")))} AS "Cart Abandonment",
                       {_r6(q(total("checkout_abandoned_sessions"), total("checkout_sessions")))} AS "Checkout Abandonment"
                FROM ({by_day}) GROUP BY country""",
            "fact_sessions",
            "dim_date",
        )
    labels = ("Sessions", "Product view", "Add to cart", "Begin checkout", "Add payment info", "Purchase")
    columns = list(funnel.values())
    rows = " UNION ALL ".join(
        f"""SELECT device_category, {i + 1} AS o, '{label}' AS label, {total(columns[i])} AS v,
                   {total(columns[i - 1]) if i else "NULL::BIGINT"} AS pv FROM ({by_day}) GROUP BY device_category"""
        for i, label in enumerate(labels)
    )
    out["measures_funnel_stages"] = on_reports(
        "clicks",
        f"""SELECT device_category, o AS stage_order, label AS stage, v AS "Funnel Value", pv AS "Funnel Previous",
                   {_r6("v / nullif(pv, 0)")} AS "Step Conversion", {_r6("1 - v / nullif(pv, 0)")} AS "Step Drop-off"
            FROM ({rows})""",
        "fact_sessions",
        "dim_date",
    )
    out["measures_product"] = on_reports(
        "items",
        f"""SELECT product_group, quadrant, {m("revenue_usd")} AS "Product Revenue", {s("impressions")} AS "Product Impressions",
                   {s("order_lines")} AS "Product Orders" FROM fact_product_daily GROUP BY product_group, quadrant""",
        "fact_product_daily",
    )
    cohorts = dated.format(facts="fact_cohort_daily", day="first_visit_date")
    out["measures_repeat_visits"] = on_reports(
        "history",
        f"""SELECT month_label, {_r6(q(s("repeat_visitors"), s("users")))} AS "Repeat-visit Rate"
            FROM ({cohorts}) GROUP BY month_label""",
        "fact_cohort_daily",
        "dim_date",
    )
    short, long = SETTINGS["history"][3]
    out["measures_return_rates"] = on_reports(
        "history",
        f"""SELECT y.period, y.user_type, {_r6("a")} AS "{short}-day Return Rate", {_r6("b")} AS "{long}-day Return Rate"
            FROM (SELECT DISTINCT period, user_type FROM dated) y
            LEFT JOIN (SELECT period, {q(s(f"returned_{short}d"), s(f"eligible_{short}d_users"))} AS a,
                              {q(s(f"returned_{long}d"), s(f"eligible_{long}d_users"))} AS b
                       FROM dated WHERE user_type = 'new' GROUP BY period) z
              ON z.period IS NOT DISTINCT FROM y.period""",
        "fact_cohort_daily",
        "dim_date",
        dated=cohorts,
    )
    return out


def inputs_on_data() -> dict[str, str]:
    """Sources and sinks, and configured tables (aliases, periods, stages, dates) set against the data."""
    out = {
        "events_in_range": sql(
            "clicks",
            """SELECT strftime(d, '%Y%m%d') AS event_date, name AS event_name, count(*) AS events FROM ev
               WHERE d BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY ALL""",
        ),
        "csv_export": report("history", "fact_cohort_daily"),
        **{
            f"csv_export__{name}": report(source, name)
            for name, source in {"fact_sessions": "clicks", "fact_product_daily": "items", "products_export": "items"}.items()
        },
        "users_from_sketches": sql(
            "clicks",
            """SELECT name AS event_name, count(*) AS events, count(DISTINCT uid) AS users, true AS within_error
               FROM ev WHERE d >= DATE '2024-01-08' GROUP BY name""",
        ),
        "wait_from_sketches": on_reports(
            "history",
            """SELECT user_type, first_purchase_on, buyers, true AS all_counted, true AS within_error
               FROM first_purchase_timing""",
            "first_purchase_timing",
        ),
        "item_aliases": sql(
            "items",
            """SELECT raw, canon AS canonical, count(i.name) AS items
               FROM alias LEFT JOIN (SELECT unnest(items) AS i FROM ev) ON i.name = raw GROUP BY raw, canon""",
        ),
        "season_periods": sql(
            "clicks",
            """SELECT ord AS period_order, label AS period, a AS start_date, b AS end_date, cmp AS is_comparison,
                      count(d) AS events
               FROM period LEFT JOIN ev ON d BETWEEN a AND b GROUP BY ALL""",
        ),
        "dim_date": on_reports(
            "clicks",
            """SELECT x.*, coalesce(c, 0) AS events FROM dim_date x
               LEFT JOIN (SELECT d, count(*) AS c FROM ev GROUP BY d) y ON y.d = x.date""",
            "dim_date",
        ),
        "funnel_stages": sql(
            "history",
            f"""SELECT o AS stage_order, label AS stage, c AS sessions FROM (
                  SELECT 1 AS o, 'Sessions' AS label, count(*) AS c FROM sess
                  UNION ALL SELECT 2, 'Product view', {n("f_view")} FROM sess
                  UNION ALL SELECT 3, 'Add to cart', {n("f_cart")} FROM sess
                  UNION ALL SELECT 4, 'Begin checkout', {n("f_chk")} FROM sess
                  UNION ALL SELECT 5, 'Add payment info', {n("f_pay")} FROM sess
                  UNION ALL SELECT 6, 'Purchase', {n("bought")} FROM sess)""",
        ),
    }
    return out | {f"csv_export__{name}": out[name] for name in ("dim_date", "funnel_stages")}
