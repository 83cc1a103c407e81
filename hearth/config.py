"""The brief: weights, bands and limits. Every operator takes a Brief; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# The default weights, in their natural order.
WEIGHTS = {
    "living_open": 3,
    "airy": 7,
    "pool": 6,
    "garden": 12,
    "view": 14,
    "land": 14,
    "style": 12,
    "price": 10,
    "beach": 8,
    "kitchen_full": 12,
    "aircon": 10,
    "furniture": 3,
    "workspace": 3,
    "joglo": 14,
}
# Enumerations.
STATUSES = ["new", "shortlist", "contacted", "viewing_booked", "viewed", "offer", "rejected", "gone"]
ACTIVE_STATUSES = ["shortlist", "contacted", "viewing_booked", "viewed", "offer"]
REMOVAL_REASONS = ["delisted", "archived", "unlisted", "taken", "merged"]
PRICE_BANDS = ["<30", "30-40", "40-50", "50+"]
BEACH_BANDS = ["0-1", "1-2", "2-4", "4+", "unknown"]
BR_GROUPS = ["1", "2", "3", "4+"]
LEAD_BUCKETS = ["now", "within_1m", "in_1_3m", "later", "unknown"]
PREMIUM_FEATURES = ["pool", "garden", "furnished", "aircon", "kitchen_full", "workspace", "living_open", "joglo"]


@dataclass(frozen=True)
class Brief:
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    flag_threshold: int = 65
    budget_min: int = 20_000_000
    budget_max: int = 80_000_000
    beach_km_max: float = 4
    band_bedrooms: tuple[int, int] = (1, 4)
    band_price: tuple[int, int] = (15_000_000, 80_000_000)
    areas: tuple[str, ...] = tuple(f"NATION_{i}" for i in range(24))
    pockets: tuple[str, ...] = ()
    today: str = "2001-08-01"


BRIEF = Brief()
