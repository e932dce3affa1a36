"""Cities, states, ZIP codes and the covered areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import found, let, plain, strip

# Forms of a location, and endings of a street that is no city.
PIPED = r"(?U)^\s*([^,|]+?)\s*,\s*([A-Za-z]{2})\s*(?:\|\s*(\d{5}))?\s*$"
TAIL = r"(?U),\s*([A-Za-z][A-Za-z.\-' ]+?)\s*,\s*([A-Z]{2})\b(?:\s*(\d{5})(?:-\d{4})?)?\s*$"
WHOLE = r"(?U)^\s*([A-Za-z][A-Za-z.\-' ]+?)\s*,\s*([A-Z]{2})\b(?:\s*(\d{5})(?:-\d{4})?)?\s*$"
STREET_END = r"(?iU)\b(st|street|ave|avenue|blvd|boulevard|rd|road|dr|drive|ln|lane|ct|court|pl|place|way|ter|terrace|pkwy|parkway|cir|circle|hwy|highway)\.?\s*$"

# Cities by state that count as covered.
CITIES = {
    "CA": (
        "san francisco", "oakland", "berkeley", "fremont", "hayward", "san leandro", "alameda", "emeryville", "albany", "piedmont",
        "san lorenzo", "castro valley", "cherryland", "ashland", "union city", "newark", "dublin", "pleasanton", "livermore", "sunol",
        "richmond", "concord", "walnut creek", "antioch", "pittsburg", "martinez", "san pablo", "el cerrito", "el sobrante", "pinole",
        "hercules", "brentwood", "oakley", "danville", "san ramon", "lafayette", "orinda", "moraga", "pleasant hill", "clayton",
        "kensington", "rodeo", "crockett", "bay point", "san rafael", "novato", "mill valley", "sausalito", "larkspur", "corte madera",
        "tiburon", "san anselmo", "fairfax", "ross", "belvedere", "greenbrae", "napa", "american canyon", "st helena", "calistoga",
        "yountville", "san mateo", "redwood city", "daly city", "south san francisco", "san bruno", "pacifica", "burlingame", "millbrae",
        "foster city", "san carlos", "belmont", "menlo park", "east palo alto", "half moon bay", "brisbane", "colma", "hillsborough",
        "atherton", "woodside", "portola valley", "la honda", "san jose", "santa clara", "sunnyvale", "mountain view", "palo alto",
        "cupertino", "milpitas", "campbell", "los gatos", "saratoga", "gilroy", "morgan hill", "los altos", "los altos hills",
        "monte sereno", "vallejo", "fairfield", "vacaville", "benicia", "suisun city", "dixon", "rio vista", "santa rosa", "petaluma",
        "rohnert park", "windsor", "healdsburg", "sonoma", "sebastopol", "cotati", "cloverdale",
    ),
    "MA": (
        "boston", "cambridge", "somerville", "brookline", "newton", "quincy", "medford", "malden", "everett", "chelsea", "revere",
        "watertown", "waltham", "arlington", "belmont", "winthrop", "milton", "dedham", "needham", "framingham", "natick",
        "brookline village", "dorchester", "roxbury", "jamaica plain", "brighton", "allston", "roslindale", "west roxbury", "hyde park",
        "mattapan", "east boston", "south boston", "charlestown", "back bay", "beacon hill", "south end", "fenway", "mission hill",
        "north end",
    ),
}


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))


def _word(w: Column) -> Column:
    rest = lambda n: _capital(F.substring(w, n, 1_000_000))
    mc = w.rlike("(?i)^(mc|mac)[a-z]") & (F.length(w) > 3)
    quote = F.instr(w, "'")
    return (
        F.when(mc & w.rlike("(?i)^mc"), F.concat(_capital(F.substring(w, 1, 2)), rest(3)))
        .when(mc, F.concat(_capital(F.substring(w, 1, 3)), rest(4)))
        .when(quote > 0, F.concat(_capital(F.substring(w, F.lit(1), quote - 1)), F.lit("'"), _capital(F.substring(w, quote + 1, F.length(w)))))
        .when(F.contains(w, F.lit("-")), F.array_join(F.transform(F.split(w, "-"), _capital), "-"))
        .otherwise(_capital(w))
    )


def normal_city(city: Column) -> Column:
    """Words capitalised; null for what has digits or ends like a street."""
    trimmed = F.regexp_replace(F.regexp_replace(city, r"(?U)\s+", " "), r"^[ ,.\-]+|[ ,.\-]+$", "")
    cased = lambda c: F.array_join(F.transform(F.filter(F.split(c, " "), lambda w: w != ""), _word), " ")
    return let(trimmed, lambda c: F.when((c != "") & ~c.rlike(r"(?U)\d") & ~c.rlike(STREET_END), cased(c)))


def parse_location(text: Column) -> Column:
    """struct<city,state,zip>: the first form that fits decides, even where its city is none."""

    def of(s: Column) -> Column:
        out = F.lit(None).cast("struct<city:string,state:string,zip:string>")
        for pattern in (WHOLE, TAIL, PIPED):
            here = F.struct(normal_city(found(s, pattern, 1)).alias("city"), F.upper(found(s, pattern, 2)).alias("state"), found(s, pattern, 3).alias("zip"))
            out = F.when(s.rlike(pattern), here).otherwise(out)
        return out

    return let(plain(text), of)


def city_of_address(address: Column) -> Column:
    return parse_location(address)["city"]


def covered_areas(spark: SparkSession) -> DataFrame:
    """area_state, area_city: about 150 rows, whatever the data."""
    return spark.createDataFrame([(s, c) for s in CITIES for c in CITIES[s]], "area_state string, area_city string")


def with_area(units: DataFrame, areas: DataFrame | None) -> DataFrame:
    """units with area_city, null outside of the covered ones. The built-in list is broadcast, a given one is joined as any table."""
    areas = F.broadcast(covered_areas(units.sparkSession)) if areas is None else areas
    return units.join(areas, (F.upper("state") == F.col("area_state")) & (F.lower(strip(F.col("city"))) == F.col("area_city")), "left")


def is_covered() -> Column:
    """Of rows of with_area: in a covered city, or without a city."""
    return F.col("area_city").isNotNull() | (F.coalesce("city", F.lit("")) == "")


def keep_covered(units: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """Units in a covered city, and those without a city; an unknown state is not covered."""
    return with_area(units, areas).where(is_covered()).drop("area_state", "area_city")


def outside(units: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """place, n: how many units are in no covered city, by city and state."""
    place = F.concat(F.coalesce(F.nullif("city", F.lit("")), F.lit("(unknown)")), F.lit(", "), F.coalesce("state", F.lit("(unknown)")))
    return with_area(units, areas).where(~is_covered()).groupBy(place.alias("place")).agg(F.count("*").alias("n"))
