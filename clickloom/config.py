"""One configuration object drives every operator.

Dates, labels, floors and windows that a site owner would change live here, so
that no operator carries a literal of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# --- Fixed values -----------------------------------------------------------
# Labels, lists and dates that results depend on.  They are data, not logic.

MISSING_TRANSACTION_ID = "(not set)"
UNUSABLE_VALUES = ("", "(data deleted)", "<Other>", "(not set)")
UNUSABLE_ITEM_NAMES = ("(not set)", "")
OBSCURED_MEDIUMS = ("<Other>", "(data deleted)")

CHANNEL_BY_MEDIUM = {
    "organic": "Organic",
    "cpc": "Paid (cpc)",
    "referral": "Referral",
    "(none)": "Direct",
    "(data deleted)": "Data deleted",
}
DEFAULT_CHANNEL = "Other (obscured)"
OBSCURED_CHANNELS = ("Other (obscured)", "Data deleted")
ALL_USERS_LABEL = "All users"
UNKNOWN_COUNTRY = "(not set)"

FUNNEL_EVENTS = (
    "session_start",
    "page_view",
    "view_item",
    "add_to_cart",
    "begin_checkout",
    "add_payment_info",
    "purchase",
)

# Ordered product groups; the first group with a matching word wins.  A word
# matches whole, except for the open-ended ones, which match as a word start.
PRODUCT_GROUP_WORD_STARTS = (("Gift cards", "GIFT CARD"),)
PRODUCT_GROUP_WORDS = (
    (
        "Drinkware and kitchen",
        "MUG|TUMBLER|BOTTLE|CUP|KEEPCUP|GLASS|FLASK|THERMOS|STEIN|COASTER|STRAW|COOLER|WATER|LUNCH|KOOZIE|CONTAINER|"
        "UTENSIL|BOWL",
    ),
    ("Headwear", "HAT|CAP|BEANIE|VISOR|BUCKET"),
    (
        "Bags",
        "BAG|BACKPACK|TOTE|SACK|POUCH|DUFFEL|FANNY|LUGGAGE|BRIEFCASE|WALLET|TECHPACK|DOPP|FLAP PACK",
    ),
    (
        "Apparel",
        "TEE|TEES|T-SHIRT|SHIRT|HOODIE|SWEATSHIRT|PULLOVER|JACKET|SWEATER|CREW|CREWNECK|TANK|ZIP|POLO|VEST|ONESIE|"
        "ROMPER|HENLEY|LONGSLEEVE|LS|SOCKS|LEGGINGS|SHORTS|PANTS|JOGGER|JOGGERS|BODYSUIT|SCARF|GLOVES|BANDANA|BIB|"
        "FLEECE|PARKA|WINDBREAKER|CARDIGAN|HERO|RAGLAN|TWILL|SOFTSHELL|RAINCOAT|SHELL",
    ),
    (
        "Tech and accessories",
        "PHONE|CHARGER|CABLE|MOUSE|WATCH|SPEAKER|EARBUDS|HEADPHONES|CASE|LAPTOP|SLEEVE|USB|POWER|LANYARD|KEYCHAIN|PIN|"
        "PATCH|MAGNET|SUNGLASSES|SHADES|LIGHT|LAMP|BATTERY|STAND|ADAPTER|SPEAKERS|WIRELESS|HOLDER|LOVEHANDLE",
    ),
    (
        "Stationery and office",
        "NOTEBOOK|JOURNAL|PEN|PENCIL|PENS|MARKER|HIGHLIGHTER|STICKER|STICKERS|DECAL|NOTEPAD|STICKY|DESK|PAD|PLANNER|"
        "CLIPBOARD|CALENDAR|BINDER|ERASER|RULER|FOLDER|STATIONERY|WRITING|BOOK",
    ),
    (
        "Fun and gifts",
        "TOY|PLUSH|STUFFED|FRISBEE|BALL|PUZZLE|GAME|DOG|PET|CAT|MASK|BLANKET|PILLOW|TOWEL|UMBRELLA|CANDLE|ORNAMENT|"
        "CARD|FIDGET|SPINNER|FIGURE|COLLECTIBLE|BIKE|SCULPTURE|ART|BOT|DINOSAUR|SET",
    ),
)
DEFAULT_PRODUCT_GROUP = "Other"

ITEM_ALIASES = (
    ("Womens Google Striped LS", "Google Women's Striped L/S"),
    ("Google F/C Longsleeve Charcoal", "Google F/C Long Sleeve Tee Charcoal"),
    ("Google F/C Longsleeve Ash", "Google F/C Long Sleeve Tee Ash"),
    ("Google Unisex Eco Tee Black", "Google Eco Tee Black"),
    ("Unisex Google Pocket Tee Grey", "Google Pocket Tee Grey"),
    ("Unisex Google Jumbo Print Tee White", "Google Jumbo Print Tee White"),
    ("Youth Jumbo Print Tee White", "Google Youth Jumbo Print Tee White"),
    ("Google Cloud  Unisex Zip Hoodie", "Google Black Cloud Zip Hoodie"),
    ("White Google Shoreline Bottle", "Google Shoreline Water Bottle"),
)

QUADRANTS = ("Strong products", "High traffic, low conversion", "Hidden winners", "Weak products")

# --- Funnel and calendar (stage labels and periods are fixed values too) ---------


@dataclass(frozen=True)
class FunnelStage:
    """A funnel step.  ``flag`` is None for the entry stage, which counts every row."""

    order: int
    label: str
    flag: str | None
    previous: int | None
    diagnostic: bool = False


@dataclass(frozen=True)
class SeasonPeriod:
    order: int
    label: str
    start: date
    end: date
    compared: bool


DETAILED_STAGES = (
    FunnelStage(1, "Sessions", None, None),
    FunnelStage(2, "Product view", "reached_view_item", 1),
    FunnelStage(3, "Add to cart", "reached_add_to_cart", 2),
    FunnelStage(4, "Begin checkout", "reached_begin_checkout", 3),
    FunnelStage(5, "Add shipping info (diagnostic)", "reached_add_shipping_info", 4, diagnostic=True),
    FunnelStage(6, "Add payment info", "reached_add_payment_info", 4),
    FunnelStage(7, "Purchase", "purchased", 6),
)

MAIN_STAGES = (
    FunnelStage(1, "Sessions", None, None),
    FunnelStage(2, "Product view", "reached_view_item", 1),
    FunnelStage(3, "Add to cart", "reached_add_to_cart", 2),
    FunnelStage(4, "Begin checkout", "reached_begin_checkout", 3),
    FunnelStage(5, "Add payment info", "reached_add_payment_info", 4),
    FunnelStage(6, "Purchase", "purchased", 5),
)

SEASON_PERIODS = (
    SeasonPeriod(1, "Early November (baseline)", date(2020, 11, 1), date(2020, 11, 14), True),
    SeasonPeriod(2, "Black Friday / Cyber Monday week", date(2020, 11, 24), date(2020, 11, 30), True),
    SeasonPeriod(3, "December", date(2020, 12, 1), date(2020, 12, 31), True),
    SeasonPeriod(4, "January (1-25)", date(2021, 1, 1), date(2021, 1, 25), True),
    SeasonPeriod(8, "Late January (revenue missing, not compared)", date(2021, 1, 26), date(2021, 1, 31), False),
    SeasonPeriod(9, "Mid-November (not compared)", date(2020, 11, 15), date(2020, 11, 23), False),
)


@dataclass(frozen=True)
class AnalyticsConfig:
    """Every date, label, floor and window used by the operators."""

    # The dates covered by the data, and the dates on which tracking can be trusted.
    first_date: date = date(2020, 11, 1)
    last_date: date = date(2021, 1, 31)
    cart_reliable_from: date = date(2020, 11, 26)
    revenue_reliable_until: date = date(2021, 1, 26)  # exclusive

    # Return windows in days; the last one is the equal comparison window.
    return_windows: tuple[int, ...] = (7, 30)

    # Labels.
    missing_transaction_id: str = MISSING_TRANSACTION_ID
    unusable_values: tuple[str, ...] = UNUSABLE_VALUES
    unusable_item_names: tuple[str, ...] = UNUSABLE_ITEM_NAMES
    obscured_mediums: tuple[str, ...] = OBSCURED_MEDIUMS
    channel_by_medium: dict[str, str] = field(default_factory=lambda: dict(CHANNEL_BY_MEDIUM))
    default_channel: str = DEFAULT_CHANNEL
    obscured_channels: tuple[str, ...] = OBSCURED_CHANNELS
    all_users_label: str = ALL_USERS_LABEL
    unknown_country: str = UNKNOWN_COUNTRY

    # Funnel.
    funnel_events: tuple[str, ...] = FUNNEL_EVENTS
    detailed_stages: tuple[FunnelStage, ...] = DETAILED_STAGES
    main_stages: tuple[FunnelStage, ...] = MAIN_STAGES

    # Seasonality.
    season_periods: tuple[SeasonPeriod, ...] = SEASON_PERIODS
    baseline_period: int = 1

    # Floors.
    source_min_users: int = 300
    country_min_users: int = 1000
    impression_floor: int = 1000

    # Products.
    item_aliases: tuple[tuple[str, str], ...] = ITEM_ALIASES
    product_group_word_starts: tuple[tuple[str, str], ...] = PRODUCT_GROUP_WORD_STARTS
    product_group_words: tuple[tuple[str, str], ...] = PRODUCT_GROUP_WORDS
    default_product_group: str = DEFAULT_PRODUCT_GROUP

    # Statistics and sizing.
    alpha: float = 0.05
    z95: float = 1.96
    reference_channel: str = "Organic"
    tested_channels: tuple[str, ...] = ("Referral", "Paid (cpc)", "Direct")
    benchmark_channel: str = "Referral"
    haircut: float = 0.5

    # Orders of events without a session id match no session, as in any equi-join.
    # Switch on to attach them to the user's id-less session instead.
    null_safe_sessions: bool = False

    @property
    def long_window(self) -> int:
        return max(self.return_windows)

    @property
    def small_country_label(self) -> str:
        return f"Other (under {self.country_min_users:,} users)"

    @property
    def below_floor_label(self) -> str:
        return f"Below {self.impression_floor:,} impressions"
