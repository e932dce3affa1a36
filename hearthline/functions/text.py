"""Text to values, as Column functions: all take nullable text and give null where nothing parses.

Patterns run with (?U), so that spaces, word characters and digits are Unicode's, as listings need (a no-break space is a space).
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sanity bounds.
LEAST_RENT, MOST_RENT, MOST_ROOMS, MOST_SQFT = 100.0, 100_000.0, 20.0, 100_000

# What counts as a price, a number of bedrooms, of bathrooms, an area.
PRICE = r"(?U)\$\s*([\d,]+(?:\.\d{1,2})?)"
BARE_PRICE = r"(?U)^\s*([\d,]+(?:\.\d{1,2})?)\s*$"
STUDIO = r"(?iU)\b(studio|efficiency|bachelor)\b"
TITLE_STUDIO = r"(?iU)\bstudio\b"
BEDS = r"(?iU)(\d+(?:\.\d+)?)\s*(?:bd|bed|bedroom|br|b/r)s?\b"
BATHS = r"(?iU)(\d+(?:\.\d+)?)\s*(?:ba|bath|bathroom)s?\b"
BARE_NUMBER = r"(?U)^\s*(\d+(?:\.\d+)?)\s*$"
AREA = r"(?iU)([\d,]{2,7})\s*(?:sq\.?\s*(?:ft|feet)|sqft|square\s*feet)"
BARE_AREA = r"(?U)^[\d,]{2,7}$"

# Words of addresses that mean the same; those for "unit" and "number" are dropped.
STREET_WORDS = {
    "street": "st", "avenue": "ave", "boulevard": "blvd", "drive": "dr", "road": "rd", "court": "ct", "lane": "ln", "place": "pl",
    "terrace": "ter", "parkway": "pkwy", "circle": "cir", "highway": "hwy", "square": "sq", "apartment": "apt", "suite": "ste",
    "unit": "", "number": "", "north": "n", "south": "s", "east": "e", "west": "w",
}


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A pattern's group in text, null where the pattern isn't found or the group is empty."""
    return let(F.regexp_extract(text, pattern, group), lambda v: F.nullif(v, F.lit("")))


def literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def entities(bare: bool = True) -> Column:
    """HTML 5's names, as the standard library has them, by their first character: name (with & and, where it has one, semicolon) to text. bare: those without
    semicolon too."""
    by_first: dict[str, dict[str, str]] = {}
    for name, chars in ((n, c) for n, c in html.entities.html5.items() if bare or n.endswith(";")):
        by_first.setdefault(name[0], {})[f"&{name}"] = chars
    return F.from_json(F.lit(json.dumps(by_first)), "map<string,map<string,string>>")


#: Names that count without a semicolon, and then also where more letters follow; a longer one goes first.
BARE_NAMES = "|".join(sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


def unescape(text: Column, bare: bool = True) -> Column:
    """HTML 5 entities decoded in one pass: numbers and names. A name that is none counts by the longest name without semicolon that it begins with; unless bare, only
    names with their semicolon count.

    Numbers that are no characters give U+FFFD, those that are controls or no characters of text nothing, and 128 to 159 what Windows code page 1252 has there, as
    browsers do.
    """
    high = bytes(range(128, 160)).decode("cp1252", "replace")
    point = lambda t: F.coalesce(F.conv(found(t, r"^&#[xX]([0-9a-fA-F]+);?$"), 16, 10), found(t, r"^&#([0-9]+);?$")).try_cast("long")

    def char(n: Column) -> Column:
        bad = (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
        own = F.when(F.substring(F.lit(high), (n - 127).cast("int"), F.lit(1)) == "\ufffd", F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(F.substring(F.lit(high), (n - 127).cast("int"), F.lit(1)))
        unseen = n.between(1, 8) | (n == 11) | n.between(14, 31) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFF)) >= 0xFFFE) | (n == 127)
        known = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.when(bad, "\ufffd").when(n.between(128, 159), own).when(unseen, "").otherwise(known)

    def named(t: Column) -> Column:
        name = lambda x: F.try_element_at(F.try_element_at(entities(bare), F.substring(x, 2, 1)), x)
        if not bare:
            return F.coalesce(name(t), t)
        start = F.concat(F.lit("&"), F.regexp_extract(t, f"^&({BARE_NAMES})", 1))
        return F.coalesce(name(t), F.concat(name(start), F.substring(t, F.length(start) + 1, F.length(t))), t)

    def of(t: Column) -> Column:
        return F.when(t.rlike(r"^&#(?:[0-9]+|[xX][0-9a-fA-F]+);?$"), F.coalesce(let(point(t), char), F.lit("\ufffd"))).when(F.length(t) > 1, F.when(F.startswith(t, F.lit("&")), named(t)).otherwise(t)).otherwise(t)

    parts = lambda s: F.regexp_extract_all(s, F.lit(r"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[^\t\n\f <&#;]{1,32};?|[^&]+|&"), 0)
    return let(text, lambda s: F.when(F.contains(s, F.lit("&")), F.array_join(F.transform(parts(s), of), "")).otherwise(s))


def clean_text(markup: Column) -> Column:
    """Tags to spaces, entities decoded, white space collapsed and trimmed; null gives an empty text."""
    return cleaned(markup, True)


def cleaned(markup: Column, bare: bool) -> Column:
    """clean_text, with or without entities that lack their semicolon; bare: as in unescape."""
    text = unescape(F.regexp_replace(F.coalesce(markup, F.lit("")), "<[^>]+>", " "), bare)
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))  # all white space is spaces by then


def plain(text: Column) -> Column:
    """text cleaned if it has a `<`, else trimmed."""
    return let(text, lambda s: F.when(F.contains(s, F.lit("<")), clean_text(s)).otherwise(strip(s)))


def within(value: Column, lo, hi) -> Column:
    return F.when(value.between(lo, hi), value)


def number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def parse_rent(text: Column) -> Column:
    """The least price in bounds: of the prices with a `$`, or of a text that is nothing but a number."""

    def best(s: Column) -> Column:
        prices = F.regexp_extract_all(s, F.lit(PRICE), 1)
        prices = F.when(F.size(prices) > 0, prices).otherwise(F.regexp_extract_all(s, F.lit(BARE_PRICE), 1))
        return F.array_min(F.filter(F.transform(prices, number), lambda v: v.between(LEAST_RENT, MOST_RENT)))

    return let(plain(text), best)


def _count(s: Column, pattern: str) -> Column:
    """What the pattern finds, or else a text that is only a number; no second try where the first is out of bounds."""
    return within(F.coalesce(found(s, pattern), F.when(~s.rlike(pattern), found(s, BARE_NUMBER))).try_cast("double"), 0.0, MOST_ROOMS)


def parse_bedrooms(text: Column) -> Column:
    return let(plain(text), lambda s: F.when(s.rlike(STUDIO), 0.0).otherwise(_count(s, BEDS)))


def parse_bathrooms(text: Column) -> Column:
    return let(plain(text), lambda s: _count(s, BATHS))


def parse_square_feet(text: Column) -> Column:
    def area(s: Column) -> Column:
        v = F.regexp_replace(F.coalesce(found(s, AREA), F.when(s.rlike(BARE_AREA), s)), ",", "").try_cast("int")
        return F.when((v > 0) & (v < MOST_SQFT), v)

    return let(plain(text), area)


def bedrooms_from_title(title: Column) -> Column:
    """Only what a title states in words; a number alone is none."""
    return F.when(title.rlike(TITLE_STUDIO), 0.0).otherwise(within(found(title, BEDS).try_cast("double"), 0.0, MOST_ROOMS))


def normal_address(address: Column) -> Column:
    """Lower case, no punctuation, one word for all that mean the same; null gives an empty text."""
    tokens = F.split(F.regexp_replace(F.lower(F.coalesce(address, F.lit(""))), r"(?U)[^\w\s]", " "), r"(?U)\s+")
    known = literal_map(STREET_WORDS)
    return F.array_join(F.filter(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(known, t), t)), lambda t: t != ""), " ")


def money(value: Column) -> Column:
    """Rounded half up, with thousands separators; null gives a dash."""
    return F.coalesce(F.concat(F.lit("$"), F.format_number(F.floor(value + 0.5), 0)), F.lit("—"))


def reading(value: Column) -> Column:
    """A stated value: empty and "unknown" are null."""
    return F.nullif(F.nullif(value, F.lit("unknown")), F.lit(""))


# Contacts.
HIDDEN = r"(?is)<(script|style|noscript)\b.*?</\1>"
COMMENT = r"(?s)<!--.*?-->"
MAILTO = r"(?iU)mailto:([\w.+-]+@[\w-]+\.[\w.]{2,})"
EMAIL = r"(?iU)\b[\w.+-]+@[\w-]+\.[a-z]{2,}\b"
PHONE = r"(?U)\(?\b(\d{3})\)?[-.\s]?(\d{3})[-.\s]?(\d{4})\b"
NO_CONTACT = r"(?i)@(example|sentry|snowplow|googlemail|localhost)|(noreply|no-reply|donotreply|support@wordpress|webmaster)@|\.(png|jpg|gif|css|js)$"


def visible(markup: Column) -> Column:
    """markup without scripts, styles and comments."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(markup, F.lit("")), HIDDEN, " "), COMMENT, " ")


def extract_contact(markup: Column) -> Column:
    """struct<phone,emails>: mailto links come first, each address once."""

    def contact(body: Column) -> Column:
        def of(text: Column) -> Column:
            every = F.concat(F.regexp_extract_all(body, F.lit(MAILTO), 1), F.regexp_extract_all(text, F.lit(EMAIL), 0))
            every = F.transform(every, lambda e: F.regexp_replace(F.lower(strip(unescape(e))), r"\.+$", ""))
            phone = F.when(text.rlike(PHONE), F.format_string("(%s) %s-%s", F.regexp_extract(text, PHONE, 1), F.regexp_extract(text, PHONE, 2), F.regexp_extract(text, PHONE, 3)))
            return F.struct(phone.alias("phone"), F.array_distinct(F.filter(every, lambda e: ~e.rlike(NO_CONTACT))).alias("emails"))

        return let(clean_text(body), of)

    return let(visible(markup), contact)


def detail_text(markup: Column, most: int = 20_000, bare: bool = True) -> Column:
    """What a reader of a page gets: visible text, at most so many characters. bare: as in unescape."""
    return F.substring(cleaned(visible(markup), bare), 1, most)


def joined_address(*parts: Column) -> Column:
    """The parts that there are, with commas between."""
    return F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts])


def label_values(block: Column, pattern: str) -> Column:
    """map of lower-cased labels to values, from a pattern with both as groups; of equal labels the last counts."""
    labels = F.transform(F.regexp_extract_all(block, F.lit(pattern), 1), lambda x: F.regexp_replace(F.lower(clean_text(x)), "^[: ]+|[: ]+$", ""))
    values = F.transform(F.regexp_extract_all(block, F.lit(pattern), 2), clean_text)
    pairs = F.arrays_zip(labels.alias("k"), values.alias("v"))
    last = let(pairs, lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"])))
    return F.map_from_entries(last)
