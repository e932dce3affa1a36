"""Parsers on texts as sources write them."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from hearthline.functions import dates, kinds, places, text

TODAY = date(2027, 3, 9)


def each(spark, inputs, f):
    rows = [(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(inputs)]
    width = len(rows[0]) - 1
    names = ["i", *[f"c{k}" for k in range(width)]]
    types = ["long"]
    for k in range(width):
        values = [r[k + 1] for r in rows if r[k + 1] is not None]
        types.append("double" if values and isinstance(values[0], float) else "string")
    df = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))
    return [r["v"] for r in df.select("i", f(*[F.col(n) for n in names[1:]]).alias("v")).orderBy("i").collect()]


def check(spark, f, cases):
    got = each(spark, [c[0] for c in cases], f)
    assert [(c[0], g) for c, g in zip(cases, got, strict=True)] == list(cases)


def test_rent(spark):
    check(spark, text.parse_rent, [
        ("$4,175", 4175.0), ("$4175.00", 4175.0), ("1310.00", 1310.0), ("$1,610 - $2,480", 1610.0), ("Ask us", None), ("", None), (None, None),
        ("$50", None), ("$1,200,000", None), ("<b>$1,850</b>/mo", 1850.0), ("$,", None), ("  975 ", 975.0), ("$99 deposit, $1,400 rent", 1400.0),
    ])


def test_rooms(spark):
    check(spark, text.parse_bedrooms, [
        ("5 bd / 3 ba", 5.0), ("4 Bed | 2 Bath", 4.0), ("3 bedrooms", 3.0), ("Studio, 1 ba", 0.0), ("2", 2.0), ("1.5 bd", 1.5), ("Efficiency", 0.0), ("none", None),
        ("", None), (None, None), ("35 bd", None), ("4BR house", 4.0), ("2 bd", 2.0),
    ])
    check(spark, text.parse_bathrooms, [("3 bd / 2.5 ba", 2.5), ("2 baths", 2.0), ("1", 1.0), ("x", None), (None, None)])
    check(spark, text.bedrooms_from_title, [("Corner Studio", 0.0), ("Sunny 2BR", 2.0), ("2", None), ("Nice", None), (None, None)])


def test_square_feet(spark):
    check(spark, text.parse_square_feet, [("615 sqft", 615), ("1,480 sq. ft.", 1480), ("930", 930), ("640.0", None), ("big", None), (None, None), (",,", None)])


AVAILABLE = [
    ("vacant", None, True), ("Ready immediately", None, True), ("4/18/27", "2027-04-18", False), ("04-18-2027", "2027-04-18", False), ("open from October 3rd", "2027-10-03", False),
    ("Dec. 24, 2027", "2027-12-24", False), ("since 2027-02-01", "2027-02-01", False), ("February 20", "2027-02-20", False), ("January 2", "2028-01-02", False), ("  ", None, False),
    ("4/31/27", None, False), ("2027-00-10", None, False), ("today or 5/6/27", "2027-05-06", False), ("Mayfair 12", "2027-05-12", False), ("June 2029", "2027-06-20", False), (None, None, False),
]


def test_available(spark):
    got = each(spark, [a[0] for a in AVAILABLE], lambda c: dates.parse_available(c, TODAY))
    assert [(g["date"], g["now"]) if g else (None, False) for g in got] == [a[1:] for a in AVAILABLE]


def test_places(spark):
    check(spark, places.normal_city, [
        ("san francisco", "San Francisco"), ("SAN  JOSE ,", "San Jose"), ("mcallen", "McAllen"), ("macdoel", "MacDoel"), ("o'brien", "O'Brien"), ("winston-salem", "Winston-Salem"),
        ("Linden St", None), ("Apt 4", None), ("", None), (None, None),
    ])
    got = each(spark, ["6 Cedar Way #2, Albany, CA 94706", "Daly City, CA 94015", "Quincy,MA|02169", "no place", None, "9 Low Rd, Salem, MA"], places.parse_location)
    want = [("Albany", "CA", "94706"), ("Daly City", "CA", "94015"), ("Quincy", "MA", "02169"), None, None, ("Salem", "MA", None)]
    assert [tuple(g) if g else None for g in got] == want


def test_classify(spark):
    cases = [
        (("12 Oak St", "Rental application form", 2.0), "application"), (("Parking stall 4", None, None), "parking"), (("12 Oak", "Sunny 2BR with Parking", 2.0), "residential"),
        (("Storage locker", "", 0.0), "storage"), (("12 Oak", "Retail space for lease", None), "commercial"), (("12 Oak", "Private Room near campus", 1.0), "room"),
        (("#88 Room 2 Bed C", None, 3.0), "room"), (("12 Oak", None, None), "residential"), (("Not an apartment", None, 3.0), "storage"), (("12 Oak", "Roommate switch only", 3.0), "application"),
    ]
    check(spark, kinds.classify, cases)


def test_unit_type(spark):
    check(spark, kinds.unit_type, [(None, None), (0.0, "studio"), (0.5, "studio"), (1.0, "1_bedroom"), (1.5, "1_bedroom"), (2.0, "2_bedroom"), (3.0, "3plus_bedroom"), (7.0, "3plus_bedroom")])


def test_clean_text(spark):
    check(spark, text.clean_text, [
        ("<b>a</b>&nbsp;b", "a b"), ("&amp;lt;", "&lt;"), ("1 &#8211; 2", "1 – 2"), ("caf&eacute; &bull; x", "café • x"), (None, ""), ("&#x1F600;", "😀"), ("&#150;", "–"), ("&nosuch; &", "&nosuch; &"), ("&#0;", "�"),
    ])


def test_contact(spark):
    page = "<script>a@evil.com</script><!-- b@evil.com --><a href='mailto:Lease@Firm.com'>x</a> noreply@firm.com other@firm.org (510) 555-1234"
    [got, none] = each(spark, [page, None], text.extract_contact)
    assert got["phone"] == "(510) 555-1234" and got["emails"] == ["lease@firm.com", "other@firm.org"]
    assert none["phone"] is None and none["emails"] == []


def test_address(spark):
    check(spark, text.normal_address, [("81 Juniper Street, Unit #7", "81 juniper st 7"), ("81 Juniper St 7", "81 juniper st 7"), (None, ""), ("North Oak Avenue", "n oak ave")])


def test_policies(spark):
    rows = [
        (1, [("Occupancy Policy", ["1 tenant max per room"])], "private_room", None),
        (2, [("Occupancy Policy", ["2 tenants max per room", "1 tenant max per room"])], None, None),
        (3, [("Pet Policy", [" "]), ("pet policy", ["Cats Allowed"])], None, "cats_only"),
        (4, [("Pet Policy", ["Cats and dogs"])], None, "allowed"),
        (5, [("Pet Policy", ["No Pets"]), ("Pet Policy", ["Dogs"])], None, "none"),
        (6, None, None, None),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], f"i int, p {kinds.POLICY}")
    got = df.select("i", kinds.room_type_of_occupancy(F.col("p"), F.lit(True)), kinds.pets_of_policy(F.col("p"))).orderBy("i").collect()
    assert [tuple(g)[1:] for g in got] == [r[2:] for r in rows]


@pytest.mark.parametrize(("beds", "room", "label"), [(2.0, "entire_place", "2 bd"), (0.0, "entire_place", "Studio"), (None, "entire_place", "—"), (3.0, "private_room", "Private room in 3 bd"), (0.0, None, "Room"), (None, "shared_room", "Shared room")])
def test_page_label(spark, beds, room, label):
    df = spark.createDataFrame([(beds, room)], "b double, r string")
    assert df.select(kinds.page_bed_label(F.col("b"), F.col("r"))).first()[0] == label


def test_metro(spark):
    rows = [("Berkeley", "CA", True), ("Belmont", "MA", True), ("Belmont", "CA", True), ("Boston", "CA", False), (None, "TX", True), ("", None, True), ("Austin", "TX", False), ("  OAKLAND ", "ca", True), ("St. Helena", "CA", False)]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, city string, state string")
    assert {r["i"] for r in places.keep_covered(df).collect()} == {i for i, r in enumerate(rows) if r[2]}
