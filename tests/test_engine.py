"""End to end over a folder of raw documents; portals on made-up cards; the stream."""

import json
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from hearthline.functions import text
from hearthline.operators import dashboard, units as ops
from hearthline.sources import portals, raw
from hearthline.streaming import ingest

TODAY = date(2026, 7, 22)


def unit(address, **more):
    return {"address": address, "source": "a", "manager": "A", "city": "Berkeley", "state": "CA", "kind": "residential", "bedrooms": 1, "rent": 2000.0, "available_now": False, "url": None} | more


@pytest.fixture
def folder(tmp_path):
    docs = {
        "a.json": [unit("1 Oak Street", rent=1000.0), unit("1 Oak St", rent=1000.0), unit("2 Oak St", kind="parking"), unit("3 Oak St", bedrooms=2.5, rent=3000.0, url="u3"), unit("9 Elm", city="Austin", state="TX")],
        "b.json": [unit("2 Oak St", source="b"), unit("1 oak street", source="b", rent=1000.0), unit("5 Oak", source="b", city=None, kind=None, room_type=None), unit("3 Oak St", source="b", kind="room", room_type="private_room", bedrooms=2.5, rent=900.0, url="u3", conflicts=[{"field": "bedrooms", "parsed": 2.5, "observed": 3}])],
    }
    for name, units in docs.items():
        (tmp_path / name).write_text(json.dumps({"schema_version": 1, "source": name[0], "manager": name[0].upper(), "source_url": "x", "scraped_at": "2026-07-22T01:00:00-07:00", "unit_count": len(units), "units": units}))
    (tmp_path / "broken.json").write_text("{not json")
    (tmp_path / "_status.json").write_text("{}")
    return str(tmp_path)


def test_merge(spark, folder):
    docs = raw.read_raw(spark, folder)
    assert docs.count() == 3 and docs.where("source is null").count() == 1
    units = raw.units_of(docs)
    assert units.count() == 9
    assert units.where("conflicts is not null").select(F.col("conflicts")[0]["observed"]).first()[0] == "3"
    merged = ops.merge_units(units)
    got = {(r["address"], r["file_name"], r["unit_type"], r["room_type"]) for r in merged.collect()}
    assert got == {
        ("1 Oak Street", "a.json", "1_bedroom", "entire_place"), ("3 Oak St", "a.json", "2_bedroom", "entire_place"), ("2 Oak St", "b.json", "1_bedroom", "entire_place"),
        ("5 Oak", "b.json", "1_bedroom", None), ("3 Oak St", "b.json", "2_bedroom", "private_room"),
    }
    assert ops.merge_units(merged.withColumn("kind", F.lit("residential"))).count() == merged.count()
    cells = dashboard.facets(merged, ["room_type", "pets"], ["file_name", "pos"])
    assert {(r["value"], r["n"]) for r in cells.where("facet = 'room_type'").collect()} == {("entire_place", 3), ("private_room", 1), ("unknown", 1)}
    assert {r["facet"]: r["n"] for r in cells.groupBy("facet").agg(F.sum("n").alias("n")).collect()} == {"room_type": 5, "pets": 5}


def test_enrich_and_reconcile(spark, folder):
    units = raw.units_of(raw.read_raw(spark, folder))
    observed = {"describes_one_unit": True, "bedrooms": 3.0, "rent": 3000.5, "available_date": "8/10/26", "listing_kind": "unknown", "city": "berkeley"}
    cache = spark.createDataFrame([("u3", "private_room", "allowed", None, None, None, "Nice.", "llm", None, tuple(observed.get(k) for k in ("describes_one_unit", "bedrooms", "bathrooms", "rent", "square_feet", "available_date", "available_now", "city", "listing_kind")))], raw.CACHE)
    filled = ops.fill(units, cache)
    assert {(r["pets"], r["room_type"]) for r in filled.where("url = 'u3'").collect()} == {("allowed", "private_room")}
    rows = ops.cross_check(units, cache, F.lit(TODAY)).collect()
    assert {(r["manager"], r["field"], r["page"], r["type"]) for r in rows} == {("A", "bedrooms", "3.0", "conflict"), ("A", "available_date", "8/10/26", "parser_missing"), ("A", "rent", "3000.5", "conflict")}  # the room of source b has a rent of its own
    conflicts = spark.createDataFrame([("u3", "bedrooms", "4", "conflict", 1), ("u3", "bedrooms", "3", "conflict", 2), ("u3", "rent", "1", "conflict", 3), ("u3", "bathrooms", "2", "parser_missing", 4)], "url string, field string, page string, type string, ord int")
    done = ops.reconcile(units, conflicts).where("url = 'u3'").collect()
    assert {(r["bedrooms"], r["unit_type"], r["bathrooms"]) for r in done} == {(3.0, "3plus_bedroom", None)} and {r["rent"] for r in done} == {3000.0, 900.0}
    queue = ops.numbered_pages(ops.pages_to_read(units, cache.limit(0), ["file_name", "pos"]))
    assert [(r["page_id"], r["url"], r["members"]) for r in queue.collect()] == [("p00000", "u3", 2)]


def page(spark, html, platform):
    df = spark.createDataFrame([("s", "M", "https://x.org/", html)], "source string, manager string, base_url string, html string")
    return [r.asDict() for r in portals.extract(df, platform, F.lit(TODAY)).collect()]


def test_appfolio(spark):
    card = """<p>top</p><div class="x js-listing-item"><span class="js-listing-address">12 Oak St, Berkeley, CA 94709</span><h2 class="js-listing-title"><a href="#">Private Room</a></h2>
      <dl><dt class="detail-box__label">RENT</dt><dd class="detail-box__value">$1,200</dd><dt class="detail-box__label">Bed / Bath</dt><dd class="detail-box__value">Private Room in 3 bd / 2 ba</dd>
      <dt class="detail-box__label">Available</dt><dd class="detail-box__value">8/1/26</dd></dl><a href="/listings/detail/abc">x</a></div><div class="js-listing-item">no address</div>"""
    [u] = page(spark, card, "appfolio")
    assert (u["city"], u["postal_code"], u["rent"], u["bedrooms"], u["bathrooms"], u["kind"], u["room_type"], u["available_date"], u["url"]) == ("Berkeley", "94709", 1200.0, 3.0, 2.0, "room", "private_room", "2026-08-01", "https://x.org/listings/detail/abc")


def test_buildium(spark):
    card = """<a class="featured-listing" data-bedrooms="0" data-rent="1200.00" data-location="Fresno,CA|93726" href="/Resident/public/rentals/9"><h3 class="featured-listing__title">77 Heron Court, 3</h3>
      <p class="featured-listing__address">Fresno, CA 93726</p><p class="featured-listing__features">2 Bed | 1 Bath | 729 sqft</p><p class="featured-listing__availability">Available now</p></a>"""
    [u] = page(spark, card, "buildium")
    assert (u["bedrooms"], u["bathrooms"], u["square_feet"], u["rent"], u["city"], u["available_now"], u["unit_type"]) == (0.0, 1.0, 729, 1200.0, "Fresno", True, "studio")


def test_showmojo_eri_mmg(spark):
    [u] = page(spark, "<div class='js-listing-info'><div class='listing-address-header'>5 Elm</div><p class='listing-city-state-zip'>Oakland, CA 94601</p><div class='rent-info'><span class='price'>$1,900</span> Available 9/1/26</div></div><div class='listing-icon-wrap'><img src='icons/bed.png'>2 bd</div><div class='listing-icon-wrap'><img src='icons/bath.png'>1 ba</div>", "showmojo")
    assert (u["address"], u["bedrooms"], u["bathrooms"], u["rent"], u["available_date"]) == ("5 Elm, Oakland, CA 94601", 2.0, 1.0, 1900.0, "2026-09-01")
    [u] = page(spark, '<div class="rental3"><p class="rraddr"><a href="unit.php?id=7">9 Pine</a></p><p class="rrunitid">#2</p><p class="rrcity">Albany</p><p class="rr">1 bd / 1 ba $1,700</p><p class="rr">Available: now</p></div>', "eri")
    assert (u["address"], u["rent"], u["available_now"], u["url"]) == ("9 Pine, #2, Albany, CA", 1700.0, True, "https://x.org/unit.php?id=7")
    [u] = page(spark, '<div class="wpl_prp_cont"><h3 class="wpl_prp_title">Flat</h3><h4 class="wpl_prp_listing_location">31 Larch Street, San Francisco, California, United States 94103</h4><div class="bathroom"><span class="value">1</span></div><div class="price_box"><span>$2,100</span></div></div>', "mmg")
    assert (u["city"], u["postal_code"], u["bedrooms"], u["bathrooms"], u["rent"]) == ("San Francisco", "94103", 0.0, 1.0, 2100.0)


def test_boston(spark):
    """A hyphen is part of the street, so a card of the bare street stays without city; an en dash is not."""
    cards = [("12 Main St - Quincy", "/resident_listings/12-main-st-quincy"), ("3 Elm Ave", "/resident_listings/3-elm-ave-quincy-2"), ("12 Main St", "/x"), ("8 Oak Rd", None), ("40 Pond Way – Quincy", None), ("40 Pond Way", "/y"), ("5 Low Ln - Unit", None)]
    html = "".join(f'<div class="ym_listing"><h4><a href="{h or ""}">{t}</a></h4><h5>$2,000 / 2 bd / 1 ba</h5><h5>Availability: Now</h5></div>' for t, h in cards)
    assert [(u["title"], u["city"]) for u in sorted(page(spark, html, "boston_pm"), key=lambda u: u["pos"])] == [
        ("12 Main St", "Quincy"), ("3 Elm Ave", "Quincy"), ("12 Main St", None), ("8 Oak Rd", None), ("40 Pond Way", "Quincy"), ("40 Pond Way", "Quincy"), ("5 Low Ln - Unit", None),
    ]


def test_json_portals(spark):
    record = {"id": 1, "link": "https://l", "title": {"rendered": "Sunny 2BR"}, "meta": {"property_status": "Current", "city": "Oakland", "state": "CA", "zip_code": "94601", "street_number": "5", "street_name": "Elm", "unit": "3", "price": "2500", "availability_date": "2026/08/01"}}
    prop = {"address": "1 Way", "id": 4, "leasePolicy": [{"catalogName": "Pet Policy", "type": ["No Pets"]}, {"catalogName": "Occupancy Policy", "type": ["1 tenant max per room"]}], "availableUnits": [{"name": "2A", "floorPlanBedroomNum": 3, "minPrice": 900, "rooms": [{"id": 1}], "availableStartTime": 1785567600000}]}
    df = spark.createDataFrame([("s", "M", "https://x.org", json.dumps([record]), json.dumps(prop)), ("s", "M", "https://x.org", "broken", "broken")], "source string, manager string, base_url string, r string, t string")
    [u] = portals.relisto(df.withColumn("payload", F.col("r")), F.lit(TODAY)).collect()
    assert (u["address"], u["bedrooms"], u["rent"], u["available_date"]) == ("5 Elm #3, Oakland, CA 94601", 2.0, 2500.0, "2026-08-01")
    [u] = portals.tripalink(df.withColumn("payload", F.col("t")), F.lit(TODAY)).collect()
    assert (u["address"], u["kind"], u["room_type"], u["pets"], u["available_date"], u["rent"]) == ("1 Way #2A", "room", "private_room", "none", "2026-08-01", 900.0)


def put(folder, name, *units, **doc):
    """A document of units, each an address and what differs from the usual."""
    (folder / name).parent.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps({"source": "a", "units": [unit(x, **more) for x, more in units]} | doc))


def as_batch(spark, folder):
    """What batch reading of the files gives, deduped by source: source, address and the file's name."""
    units = raw.units_of(raw.read_raw(spark, str(folder)))
    first = ops.keep_first(units, ["doc_source", text.normal_address(F.col("address")), "bedrooms", "rent"], ["file_name", "pos"])
    return sorted((r["doc_source"], r["address"], r["file_name"]) for r in first.collect())


def test_stream_equals_batch_reading(spark, tmp_path_factory):
    """Three batches and a file without source; then one is replaced, one emptied and one broken where they lie."""
    inbox, out = tmp_path_factory.mktemp("inbox"), tmp_path_factory.mktemp("stream")
    table = str(out / "units")

    def state():
        rows = ingest.deduped(ingest.current(spark.read.parquet(table)), ["file_name", "pos"])
        return sorted((r["doc_source"], r["address"], r["file_name"]) for r in rows.collect())

    def run():
        ingest.ingest(ingest.stream_raw(spark, str(inbox), 1), table, str(out / "at")).awaitTermination(120)
        return state()

    put(inbox, "1.json", ("1 A St", {}), ("2 B St", {})), put(inbox, "2.json", ("2 B Street", {}), ("3 C St", {})), put(inbox, "3.json", ("4 D St", {}), source=None)
    assert run() == as_batch(spark, inbox) == [("3", "4 D St", "3.json"), ("a", "1 A St", "1.json"), ("a", "2 B St", "1.json"), ("a", "3 C St", "2.json")]
    assert run() == as_batch(spark, inbox) and ingest.catch_up(spark, str(inbox), table) == 0
    later = os.stat(inbox / "1.json").st_mtime + 10
    put(inbox, "1.json", ("1 A St", {"rent": 1.0}))  # the second file's unit at 2 B comes back
    os.utime(inbox / "1.json", (later, later))
    assert ingest.catch_up(spark, str(inbox), table) == 1
    assert state() == as_batch(spark, inbox) and ("a", "2 B Street", "2.json") in state()
    put(inbox, "2.json"), (inbox / "3.json").write_text("{broken")
    for name in ("2.json", "3.json"):
        os.utime(inbox / name, (later + 10, later + 10))
    put(inbox, "4.json", ("9 Z St", {}))
    assert ingest.catch_up(spark, str(inbox), table) == 2
    assert run() == as_batch(spark, inbox) == [("a", "1 A St", "1.json"), ("a", "9 Z St", "4.json")]


def test_stream_tells_files_of_equal_names_apart(spark, tmp_path_factory):
    inbox, out = tmp_path_factory.mktemp("inbox"), tmp_path_factory.mktemp("stream")
    put(inbox, "one/x.json", ("1 A St", {})), put(inbox, "two/x.json", ("2 B St", {}))
    ingest.ingest(ingest.stream_raw(spark, f"{inbox}/*", 1), str(out / "units"), str(out / "at")).awaitTermination(120)
    table = spark.read.parquet(str(out / "units"))
    assert sorted(r["address"] for r in ingest.current(table).collect()) == ["1 A St", "2 B St"]
    assert ingest.current(table, ["doc_source"]).count() == 1


def test_costs_and_queue(spark):
    pages = spark.createDataFrame([(400,), (800,), (1200,), (4000,)], "n int")
    row = ops.token_costs(pages, F.col("n")).first()
    assert (row["pages"], row["tokens_in"], row["tokens_out"], row["least"], row["median"], row["most"]) == (4, 4400.0, 880, 400, 1200, 4000)
    uneven = spark.createDataFrame([(403,), (801,), (1203,), (4001,)], "n int")
    row = ops.token_costs(uneven, F.col("n")).first()
    assert (row["tokens_in"], row["least"], row["median"], row["most"]) == (4402.0, 403, 1203, 4001)
    prices = ops.price_table(ops.token_costs(uneven, F.col("n")), [("x", 1000.0, 2000.0)]).first()
    assert (prices["at_once"], prices["in_batch"]) == (round(4.402 + 1.76, 2), round((4.402 + 1.76) / 2, 2))
    none = ops.token_costs(pages.limit(0), F.col("n")).first()
    assert (none["pages"], none["tokens_in"], none["median"]) == (0, 0.0, None)
    queue = spark.createDataFrame([("b", 1), ("a", 2), ("c", 4)], "url string, members int")
    first, over = ops.queue_limit(queue, 2)
    assert sorted(r["url"] for r in first.collect()) == ["a", "b"] and [r["url"] for r in over.collect()] == ["c"]
    first, over = ops.queue_limit(queue.limit(0), 2)
    assert first.count() == over.count() == 0


def test_fill_of_units_without_url(spark):
    units = spark.createDataFrame([(None, None), ("", None), ("u", None), ("v", "none")], "url string, pets string")
    for cache, want in (([("u", "allowed"), ("", "cats_only")], ["allowed", "cats_only", "cats_only", "none"]), ([("u", "allowed")], ["allowed", "none", None, None])):
        got = ops.fill(units, spark.createDataFrame(cache, "url string, pets string"), ("pets",))
        assert sorted((r["pets"] for r in got.collect()), key=lambda v: (v is None, v or "")) == want


def test_read_table_hides_no_fault(spark, tmp_path):
    assert raw.read_table(spark, str(tmp_path / "none"), raw.CONTACT).count() == 0
    with pytest.raises(Exception):
        raw.read_table(spark, "nosuchscheme://x/y", raw.CONTACT).count()


def test_command_line(spark, folder, tmp_path_factory, capsys):
    from hearthline.__main__ import main

    tmp_path = tmp_path_factory.mktemp("merged")
    assert main([folder, str(tmp_path / "out"), "--only", "a,nowhere"]) == 0
    assert "unknown source: nowhere" in capsys.readouterr().err
    assert {r["source"] for r in spark.read.parquet(str(tmp_path / "out/units")).select("source").distinct().collect()} == {"a"}
    assert spark.read.parquet(str(tmp_path / "out/facets")).where("facet = 'unit_type'").count() > 0
    assert main([folder, str(tmp_path / "none"), "--estimate", "--limit", "1"]) == 0
    assert "queued 1 pages" in capsys.readouterr().out and not (tmp_path / "none").exists()


def test_publish_on_the_command_line(spark, folder, tmp_path_factory, capsys):
    from hearthline.__main__ import main
    from hearthline.sources.published import Published, part_of_source

    out = str(tmp_path_factory.mktemp("published") / "t")
    assert main([folder, out, "--publish"]) == 0
    said = capsys.readouterr().out
    assert "a: 4 units\n" in said and "b: 4 units\n" in said and "2 sources ok, 0 failed, 8 units; version 1" in said
    with open(f"{folder}/a.json", "w") as f:
        json.dump({"source": "a", "manager": "A", "units": []}, f)
    with open(f"{folder}/b.json", "w") as f:
        json.dump({"source": "b", "manager": "B", "units": [unit("7 Oak", source="b", rent=3.0)]}, f)
    assert main([folder, out, "--publish"]) == 1
    assert "a: 4 units preserved\nb: invalid: rent\n" in capsys.readouterr().out
    assert main([folder, out, "--publish", "--allow-empty", "--only", "a"]) == 0
    table = Published(spark, out, f"{raw.UNIT}, pos int", part_of_source(F.col("source")))
    assert table.latest() == 3 and {r["source"] for r in table.read().collect()} == {"b"}


def test_sinks(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sink"))
    units = raw.units_of(raw.read_raw(spark, folder)).drop("conflicts")
    raw.write_partitioned(units, out)
    raw.write_partitioned(units.where("source = 'b' and kind = 'room'"), out)
    assert {r["source"]: r["count"] for r in spark.read.parquet(out).groupBy("source").count().collect()} == {"a": 5, "b": 1}
    assert raw.read_table(spark, out + "/none", raw.CONTACT).count() == 0
    good, bad = ops.quarantine(units.withColumn("rent", F.when(F.col("address") == "2 Oak St", 5.0).otherwise(F.col("rent"))))
    assert {r["address"] for r in bad.collect()} == {"2 Oak St"} and good.count() == 7
