"""What a listing is: classes, unit types, room types and policies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import found, strip

LIVABLE = ("residential", "room")
# What a listing can be.
KINDS = ("residential", "room", "parking", "storage", "commercial", "application")

# Words in address and title that tell the kind.
APPLICATION = r"(?iU)rental\s+application|roommate\s+(change|switch|add-?on)|sublet\s+application|application\s+only|waitlist\s+application|co-?signer\s+add-?on|\bnot\s+on\s+(the\s+)?market\b"
NO_APARTMENT = r"(?iU)not\s+an?\s+apartment"
PARKING = r"(?iU)\bparking\b|\bnon-?res(idential)?\b|\bcarport\b|\bgarage\s+(space|spot|stall)\b"
STORAGE = r"(?iU)\bstorage\b|\blocker\b"
COMMERCIAL = r"(?iU)\bcommercial\b|\bretail\b|\boffice\b|\bwarehouse\b|\bfor\s+lease\b|\bmedical\s+(use|suite)|\bsalon\b"
ROOM = (
    r"(?iU)\bSRO\b|\b(private|shared|standard|select|deluxe|premium)\s+(room|bedroom)\b|\broom\s+in\s+(a|an|the)\b"
    r"|\bshared\s+(apartment|house|unit|flat|suite)\b|\bco-?living\b|\broommate\s+matching\b|\bby\s+the\s+bed\b|\bBTB\b|\broom\s+\d+\s*bed\b"
)
SPECS = r"(?iU)^\s*(private|shared)\s+room\s+in\b"
OCCUPANCY = r"(?iU)(\d+)\s*tenants?\s*max\s*per\s*room"
NO_PETS, CATS, DOGS = r"(?iU)\bno\s+pets?\b", r"(?iU)\bcats?\b", r"(?iU)\bdogs?\b"

# Vocabularies and bounds of a valid unit.
VOCABULARY = {
    "unit_type": ("studio", "1_bedroom", "2_bedroom", "3plus_bedroom"),
    "room_type": ("entire_place", "private_room", "shared_room"),
    "pets": ("allowed", "cats_only", "dogs_only", "none"),
    "furnished": ("furnished", "partial", "unfurnished"),
    "parking": ("garage", "off_street", "street", "none"),
    "laundry": ("in_unit", "shared", "hookups", "none"),
}
POLICY = "array<struct<catalogName:string,type:array<string>>>"


def classify(address: Column, title: Column, bedrooms: Column) -> Column:
    """Applications and non-apartments always; stalls, lockers and shops only without bedrooms; then rooms; else residential."""
    text = F.concat(F.coalesce(address, F.lit("")), F.lit(" | "), F.coalesce(title, F.lit("")))
    bare = bedrooms.isNull() | (bedrooms == 0)
    return (
        F.when(text.rlike(APPLICATION), "application")
        .when(text.rlike(NO_APARTMENT), "storage")
        .when(bare & text.rlike(PARKING), "parking")
        .when(bare & text.rlike(STORAGE), "storage")
        .when(bare & text.rlike(COMMERCIAL), "commercial")
        .when(text.rlike(ROOM), "room")
        .otherwise("residential")
    )


def unit_type(bedrooms: Column) -> Column:
    return F.when(bedrooms < 1, "studio").when(bedrooms >= 3, "3plus_bedroom").when(bedrooms.isNotNull(), F.concat(F.floor(bedrooms).cast("string"), F.lit("_bedroom")))


def room_type_of_specs(specs: Column) -> Column:
    return F.concat(F.lower(found(specs, SPECS)), F.lit("_room"))


def _entries(policy: Column, name: str) -> Column:
    return F.filter(F.coalesce(policy, F.array().cast(POLICY)), lambda p: F.lower(strip(p["catalogName"])) == name)


def room_type_of_occupancy(policy: Column, is_room: Column) -> Column:
    """private_room where a room's first stated cap is one tenant; a higher cap says nothing."""
    every = F.flatten(F.transform(_entries(policy, "occupancy policy"), lambda p: F.coalesce(p["type"], F.array().cast("array<string>"))))
    caps = F.filter(F.transform(every, lambda t: found(t, OCCUPANCY).try_cast("int")), lambda n: n.isNotNull())
    return F.when(is_room & (F.try_element_at(caps, F.lit(1)) == 1), "private_room")


def pets_of_policy(policy: Column) -> Column:
    """What the first entry that says something about pets says."""
    texts = F.transform(_entries(policy, "pet policy"), lambda p: F.array_join(F.coalesce(p["type"], F.array().cast("array<string>")), " "))
    says = lambda t: F.when(t.rlike(NO_PETS), "none").when(t.rlike(CATS) & t.rlike(DOGS), "allowed").when(t.rlike(CATS), "cats_only").when(t.rlike(DOGS), "dogs_only")
    return F.try_element_at(F.filter(F.transform(texts, says), lambda v: v.isNotNull()), F.lit(1))


def bed_label(bedrooms: Column) -> Column:
    """Label of a bedroom facet."""
    return F.when(bedrooms.isNull(), "Unknown").when(bedrooms == 0, "Studio").when(bedrooms == F.floor(bedrooms), F.concat(bedrooms.cast("long").cast("string"), F.lit(" bed"))).otherwise(F.concat(bedrooms.cast("string"), F.lit(" bed")))


def page_bed_label(bedrooms: Column, room_type: Column) -> Column:
    """Label of a row: a room says so and what it is in; a whole unit its size."""
    n = F.when(bedrooms == F.floor(bedrooms), bedrooms.cast("long").cast("string")).otherwise(bedrooms.cast("string"))
    room = F.when(room_type == "shared_room", "Shared room").when(room_type == "private_room", "Private room").otherwise("Room")
    whole = F.when(bedrooms.isNull(), "—").when(bedrooms == 0, "Studio").otherwise(F.concat(n, F.lit(" bd")))
    return F.when(room_type.eqNullSafe(F.lit("entire_place")), whole).when(bedrooms != 0, F.concat(room, F.lit(" in "), n, F.lit(" bd"))).otherwise(room)


# Labels of amenities.
AMENITIES = {
    "laundry": {"in_unit": "In-unit laundry", "shared": "Shared laundry", "hookups": "Laundry hookups", "none": "No laundry"},
    "parking": {"garage": "Garage", "off_street": "Off-street parking", "street": "Street parking", "none": "No parking"},
    "furnished": {"furnished": "Furnished", "partial": "Part furnished", "unfurnished": "Unfurnished"},
    "pets": {"allowed": "Pets OK", "cats_only": "Cats OK", "dogs_only": "Dogs OK", "none": "No pets"},
}


def amenity_tags() -> Column:
    """Labels of what a unit states, over its amenity columns."""
    from .text import literal_map

    return F.array_compact(F.array(*[F.try_element_at(literal_map(labels), F.col(c)) for c, labels in AMENITIES.items()]))


def violations() -> Column:
    """array of what is wrong with a unit, over its columns; empty for a valid one."""
    c = F.col
    rules = {
        "address": F.coalesce(strip(c("address")), F.lit("")) == "",
        "source": F.coalesce(c("source"), F.lit("")) == "",
        "rent": ~c("rent").between(100.0, 100_000.0),
        "bedrooms": ~c("bedrooms").between(0.0, 20.0),
        "available_date": c("available_date").isNotNull() & (~c("available_date").rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") | c("available_date").try_cast("date").isNull()),
        "square_feet": c("square_feet") <= 0,
        "room_type_of_room": (c("kind") == "room") & (c("room_type") == "entire_place"),
        **{name: ~c(name).isin(*values) for name, values in VOCABULARY.items()},
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules.items()]))
