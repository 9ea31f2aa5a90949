"""Building use from map tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: map tag vocabularies --------------------------------------
RESIDENTIAL = [
    "residential", "house", "detached", "semidetached_house", "terrace",
    "apartments", "bungalow", "dormitory", "cabin", "houseboat",
    "static_caravan", "farm", "annexe",
]
COMMERCIAL = [
    "commercial", "retail", "office", "industrial", "warehouse", "supermarket",
    "kiosk", "hotel", "motel", "shop", "mall", "restaurant", "bank",
]
OTHER = [
    "garage", "garages", "shed", "carport", "roof", "greenhouse", "hut",
    "barn", "stable", "silo", "storage_tank", "service", "hangar", "bunker",
    "ruins", "construction", "school", "university", "college", "kindergarten",
    "hospital", "church", "cathedral", "chapel", "mosque", "synagogue",
    "temple", "civic", "government", "public", "fire_station", "museum",
    "stadium", "sports_hall", "sports_centre", "train_station",
    "transportation", "parking", "toilets",
]
# ---- end of fixed values -------------------------------------------------------


def osm_use_class(building: Column, shop: Column, office: Column) -> Column:
    """Residential, commercial, other or unknown; a business tag lifts other and unknown."""
    b = F.lower(F.coalesce(building, F.lit("")))
    business = shop.isNotNull() | office.isNotNull()
    return (F.when(b.isin(COMMERCIAL), "commercial").when(b.isin(RESIDENTIAL), "residential")
             .when(business, "commercial").when(b.isin(OTHER), "other").otherwise("unknown"))
