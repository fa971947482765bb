"""Orders, sessions, users and product counts against a plain Python version on random events."""

from __future__ import annotations

import random
from collections import defaultdict
from dataclasses import replace
from datetime import UTC, datetime, timedelta

import pytest

from clickloom.config import CHANNEL_BY_MEDIUM, DEFAULT_CHANNEL, OBSCURED_MEDIUMS, AnalyticsConfig
from clickloom.operators import product, retention
from clickloom.plans.workspace import Workspace
from tests.conftest import event

NAMES = ("session_start", "page_view", "view_item", "add_to_cart", "begin_checkout", "add_payment_info", "purchase")
ITEMS = ("Mug", "Cap", "Old Tee", "New Tee", "(not set)", "", None, "Pen &quot;X&quot;")
START = datetime(2020, 11, 1, tzinfo=UTC)
CFG = replace(
    AnalyticsConfig(), item_aliases=(("Old Tee", "New Tee"),), impression_floor=3, country_min_users=3
)


def random_events(seed: int) -> list[dict]:
    rng = random.Random(seed)
    out = []
    for _ in range(900):
        name = rng.choice(NAMES)
        buys = name == "purchase"
        tx = rng.choice([None, "(not set)", *[f"T{i}" for i in range(12)]]) if buys else None
        out.append(
            {
                "user": f"u{rng.randint(0, 25)}",
                "when": START + timedelta(minutes=rng.randint(0, 55 * 24 * 60)),
                "name": name,
                "session": rng.choice([None, *range(1, 6)]),
                "number": rng.choice([None, 1, 2, 3]),
                "device": rng.choice([None, "desktop", "mobile"]),
                "country": rng.choice([None, "Chile", "Peru", "Cuba"]),
                "medium": rng.choice([None, "organic", "cpc", "<Other>", "(data deleted)", "weird"]),
                "source": rng.choice(["a", "b"]),
                "transaction_id": tx,
                "revenue": rng.choice([None, 0.0, 12.34, 5.5, 0.07]) if buys else None,
                "items": [
                    {"name": rng.choice(ITEMS), "quantity": rng.choice([None, 1, 2]), "revenue": 1.25}
                    for _ in range(rng.randint(0, 4))
                ],
            }
        )
    # No two events of a user at the same time, so that there is one right answer.
    seen, unique = set(), []
    for e in out:
        if (e["user"], e["when"]) not in seen:
            seen.add((e["user"], e["when"]))
            unique.append(e)
    return unique


def expected_orders(events: list[dict]) -> list[dict]:
    best: dict[str, dict] = {}
    orders = []
    for e in events:
        if e["name"] != "purchase":
            continue
        if e["transaction_id"] in (None, "(not set)"):
            if e["revenue"] is not None and e["revenue"] > 0:
                orders.append(e)
            continue
        now = best.get(e["transaction_id"])
        if now is None or (e["when"], e["user"]) < (now["when"], now["user"]):
            best[e["transaction_id"]] = e
    return orders + list(best.values())


def expected_channel(events: list[dict]) -> str:
    ordered = sorted(events, key=lambda e: e["when"])
    named = [e for e in ordered if e["medium"] is not None and e["medium"] not in OBSCURED_MEDIUMS]
    return CHANNEL_BY_MEDIUM.get((named or ordered)[0]["medium"], DEFAULT_CHANNEL)


@pytest.fixture(scope="module", params=[1, 2, 3])
def case(request, spark, raw):
    events = random_events(request.param)
    table = raw(
        *[
            event(e["user"], e["when"].replace(tzinfo=None).isoformat(), e["name"], e["session"], e["number"],
                  **{k: e[k] for k in ("device", "country", "medium", "source", "transaction_id", "revenue", "items")})
            for e in events
        ]
    )
    return events, Workspace(spark, table, CFG)


def by(events: list[dict], *keys: str) -> dict:
    groups = defaultdict(list)
    for e in events:
        groups[tuple(e[k] for k in keys)].append(e)
    return groups


def expected_sessions(events: list[dict]) -> dict:
    orders = by([o for o in expected_orders(events) if o["session"] is not None], "user", "session")
    channels = {user: expected_channel(group) for (user,), group in by(events, "user").items()}
    out = {}
    for key, group in by(events, "user", "session").items():
        group.sort(key=lambda e: e["when"])

        def first(field, rows=group):
            return next((e[field] for e in rows if e[field] is not None), None)

        bought = orders.get(key, [])
        out[key] = (
            min((e["number"] for e in group if e["number"] is not None), default=None),
            group[0]["when"].date(),
            first("device"),
            first("country"),
            channels[key[0]],
            len(group),
            any(e["name"] == "add_to_cart" for e in group),
            len(bought),
            round(sum(o["revenue"] or 0 for o in bought), 4),
        )
    return out


def test_sessions(case):
    events, ws = case
    got = {
        (r.user_pseudo_id, r.ga_session_id): (
            r.ga_session_number, r.session_date, r.device_category, r.country, r.acq_channel, r.events,
            r.reached_add_to_cart, r.orders, r.revenue_usd,
        )
        for r in ws.sessions.collect()
    }
    assert got == expected_sessions(events)


def visits(events: list[dict]) -> dict:
    """Sessions of each user in order of time, an id-less session before others at the same time."""
    sessions = expected_sessions(events)
    starts = {key: min(e["when"] for e in group) for key, group in by(events, "user", "session").items()}
    ordered = defaultdict(list)
    for key in sorted(starts, key=lambda k: (k[0], starts[k], k[1] is not None, k[1] or 0)):
        ordered[key[0]].append(sessions[key])
    return ordered


def test_users(case):
    events, ws = case
    last = max(s[1] for group in visits(events).values() for s in group)
    expected = {}
    for user, group in visits(events).items():
        first = group[0]
        ages = [(s[1] - first[1]).days for s in group]
        lowest = min((s[0] for s in group if s[0] is not None), default=None)
        expected[user] = (
            first[1], "new" if lowest == 1 else "returning", first[2], first[3], len(group), len({s[1] for s in group}),
            sum(s[7] for s in group), round(sum(s[8] for s in group), 4),
            any(1 <= a <= 7 for a in ages), any(1 <= a <= 30 for a in ages),
            first[1] <= last - timedelta(days=7), first[1] <= last - timedelta(days=30),
        )
    got = {
        r.user_pseudo_id: (
            r.first_visit_date, r.user_type, r.first_device_category, r.first_country, r.sessions, r.active_days,
            r.orders, r.revenue_usd, r.returned_within_7d, r.returned_within_30d, r.eligible_7d, r.eligible_30d,
        )
        for r in ws.users.collect()
    }
    assert got == expected


def test_first_purchases_and_visit_numbers(case):
    events, ws = case
    ordered = visits(events)
    expected = {
        user: (
            next(i for i, s in enumerate(group, 1) if s[7] > 0),
            min(s[1] for s in group if s[7] > 0),
        )
        for user, group in ordered.items()
        if any(s[7] > 0 for s in group)
    }
    got = {r.user_pseudo_id: (r.first_buy_visit, r.first_buy_date) for r in retention.first_purchases(ws.sessions).collect()}
    assert got == expected

    counts = defaultdict(lambda: [0, 0])
    for group in ordered.values():
        lowest = min((s[0] for s in group if s[0] is not None), default=None)
        for i, s in enumerate(group, 1):
            cell = counts["new" if lowest == 1 else "returning", min(i, 3)]
            cell[0] += 1
            cell[1] += s[7]
    rows = retention.revenue_by_visit_number(ws.sessions, ws.users).collect()
    assert {(r.user_type, r.min_visit_number): [r.sessions, r.orders] for r in rows} == dict(counts)


def test_products(case):
    events, ws = case

    def name_of(item):
        if item["name"] in (None, "", "(not set)"):
            return None
        name = item["name"].replace("&quot;", '"')
        return dict(CFG.item_aliases).get(name, name)

    shown, added, bought = set(), defaultdict(int), defaultdict(lambda: [0, 0, 0.0])
    for e in events:
        for item in e["items"]:
            if e["name"] == "view_item" and name_of(item):
                shown.add((e["user"], e["when"], name_of(item)))
            if e["name"] == "add_to_cart" and name_of(item) and item["quantity"] is not None:
                added[name_of(item)] += 1
    for o in expected_orders(events):
        for item in o["items"]:
            if name_of(item):
                cell = bought[name_of(item)]
                cell[0] += 1
                cell[1] += item["quantity"] or 0
                cell[2] += item["revenue"]
    names = {n for _, _, n in shown} | set(added) | set(bought)
    expected = {
        n: (
            sum(1 for s in shown if s[2] == n), len({s[0] for s in shown if s[2] == n}), added[n],
            bought[n][0], bought[n][1], round(bought[n][2], 4),
        )
        for n in names
    }
    totals = product.product_totals(product.item_activity(ws.raw, ws.aliases, CFG), CFG)
    got = {
        r.item_name: (r.impressions, r.impression_users, r.cart_adds, r.order_lines, r.units, r.revenue_usd)
        for r in totals.collect()
    }
    assert got == expected
