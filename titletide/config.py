"""Every tunable number in one place. All operators take a ``Settings`` (or one of its fields)."""

from __future__ import annotations

from dataclasses import dataclass, field


# Thresholds, windows and weights that results depend on.
@dataclass(frozen=True)
class Settings:
    # Title matching
    headline_threshold: int = 88
    body_threshold: int = 93
    short_title_chars: int = 8
    gram_words: int = 6  # longest run that is tried at least; longer titles raise it
    gram_chars: int = 8
    dictionary_gram_words: int | None = None  # None: as long as the entries are
    common_token_share: float = 0.01
    common_token_floor: int = 30
    library_min_titles: int = 500

    # Snapshot
    retention_days: int = 14
    row_ceiling: int | None = None  # None: no trim; a ceiling is raised in steps up to the maximum
    ceiling_step: int = 5000
    ceiling_max: int = 80000
    entries_per_feed: int | None = None  # None: all
    entries_per_reddit_feed: int | None = None

    # Demand
    demand_titles: int | None = None  # None: every title
    recent_days: int = 3
    baseline_days: int = 11
    trend_days: int = 7
    market_min_copies: int = 3
    weights: dict[str, float] = field(
        default_factory=lambda: {
            "momentum": 0.30,
            "breadth": 0.15,
            "youtube": 0.20,
            "ebay": 0.20,
            "wikipedia": 0.15,
        }
    )

    # Levels
    window_days: int = 14
    staple_days: int = 5
    surge_hours: int = 24
    surge_sources: int = 2
    surge_quiet_mentions: int = 1
    surge_hold_hours: int = 48

    # Steady prices
    steady_every_hours: int = 48
    steady_min_copies: int = 20
    steady_price_range: float = 0.15
    steady_copies_range: float = 0.40
    steady_look_days: int = 6
    steady_span_days: int = 4
    steady_min_rows: int = 3

    # Week change
    change_days: int = 7
    change_slack_days: int = 2
    change_min_days: int = 3

    # Listings
    confirmed_min: int = 3
    listings_kept: int = 10
    skipped_examples: int = 5

    # Price index
    index_min_copies: int = 3
    index_max_gap: int = 3
    index_max_move: float = 2.0
    index_min_titles: int = 10
    series_days: int = 90

    # Rare index and market cap
    rare_min_copies: int = 2
    rare_min_titles: int = 10
    cap_carry: int = 7
    cap_survival: float = 0.65
    cap_core_below: int = 100000
    cap_start_share: float = 0.8

    # Crowd figures
    min_reporters: int = 5
    crowd_band: int = 3
    max_price: float = 20000.0
    max_copies: int = 99
    months_back: int = 24
    wanted_limit: int | None = None  # None: every title

    # Spelling audit
    audit_more_copies: int = 3
    audit_more_ratio: float = 1.5

    # Recheck queue (minutes unless named otherwise)
    early_minutes: int = 30
    watch_recheck_minutes: int = 60
    quiet_every_hours: int = 48
    dormant_extra_every_hours: int = 168
    cheap_min_copies: int = 20
    sealed_every_hours: int = 24
    daily_searches: int = 4950
    searches_per_run: int = 500
    search_log_titles: int | None = None  # None: every title, and every day
    search_log_level_titles: int | None = None
    search_log_days: int | None = None
    rare_extra_top: int = 50


DEFAULTS = Settings()

# Hours between two checks of a title, by level.
CHECK_EVERY_HOURS = {
    "surging": 0,
    "normal": 18,
    "staple": 18,
    "dormant": 24,
    "underrated": 24,
    "collection": 24,
    "rare": 12,
}

# Median under which a common copy counts as cheap, by site.
CHEAP_MEDIAN = {"US": 10.0, "UK": 8.0}

# The marketplaces, as (site, host, currency, extra, minimum hours between checks, keyword search only).
SITES = (
    ("US", "www.ebay.com", "USD", False, 0, False),
    ("UK", "www.ebay.co.uk", "GBP", False, 0, False),
    ("DE", "www.ebay.de", "EUR", True, 72, True),
    ("FR", "www.ebay.fr", "EUR", True, 72, True),
    ("IT", "www.ebay.it", "EUR", True, 72, True),
    ("ES", "www.ebay.es", "EUR", True, 96, True),
)
MAIN_SITES = tuple(row[0] for row in SITES if not row[3])
POOLED_SITES = tuple(row[0] for row in SITES if row[0] != "US")
POOLED_NAME = "PAL"
RARE_SITES = {"PAL": "UK", "US": "US"}
