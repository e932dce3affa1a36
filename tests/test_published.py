"""Versions: whole or not at all, whatever happens to the writer."""

import pytest
from pyspark.sql import functions as F

from hearthline.operators.publishing import publish_units
from hearthline.sources.published import Conflict, Published, PublishedByKey, folder_of, part_of_source
from hearthline.sources import raw

SCHEMA = "source string, address string, pos int"


def table(spark, path):
    return Published(spark, str(path), SCHEMA, part_of_source(F.col("source")))


def rows(spark, *of):
    return spark.createDataFrame([(s, f"{i} Oak", i) for i, s in enumerate(of)], SCHEMA)


def content(t, version=None):
    return sorted((r["source"], r["pos"]) for r in t.read(version).collect())


def test_versions(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert t.latest() == 0 and content(t) == []
    assert t.replace(rows(spark, "a", "a", "b/ ?=")) == 1
    pinned = t.read()
    assert t.replace(rows(spark, "a")) == 2
    assert content(t) == [("a", 0), ("b/ ?=", 2)] and content(t, 1) == [("a", 0), ("a", 1), ("b/ ?=", 2)]
    assert pinned.count() == 3
    assert t.replace(rows(spark), gone=[folder_of("a")]) == 3 and content(t) == [("b/ ?=", 2)]
    assert len(t.clean(keep=1)) >= 1 and content(t) == [("b/ ?=", 2)] and t.latest() == 3
    assert t.replace(rows(spark, None, "c")) == 4 and t.read().where("source is null").count() == 1


def test_writer_killed_between_files(spark, tmp_path, monkeypatch):
    """Half of its files are there, or all but the manifest: readers see the old version, and the next writer goes on."""
    t = table(spark, tmp_path / "t")
    t.replace(rows(spark, "a", "b"))

    @F.udf("int")
    def dies(pos):
        if pos == 3:
            raise RuntimeError("killed")
        return pos

    broken = rows(spark, "a", "a", "b", "b").repartition(4).withColumn("pos", dies("pos"))
    with pytest.raises(Exception, match="killed"):
        t.replace(broken)
    assert t.latest() == 1 and content(t) == [("a", 0), ("b", 1)]
    with monkeypatch.context() as m:
        m.setattr(Published, "publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            t.replace(rows(spark, "a", "c"))
    assert content(t) == [("a", 0), ("b", 1)]
    assert t.replace(rows(spark, "c")) == 2 and content(t) == [("a", 0), ("b", 1), ("c", 0)]
    assert len(t.clean()) == 2  # what the killed writers left


def test_two_writers(spark, tmp_path):
    one, two = table(spark, tmp_path / "t"), table(spark, tmp_path / "t")
    parts = one.write(rows(spark, "a"))
    two.replace(rows(spark, "b"))
    with pytest.raises(Conflict):
        one.publish(parts, 0)
    assert content(one) == [("b", 0)]


def test_upsert_writes_touched_buckets_only(spark, tmp_path):
    t = PublishedByKey(spark, str(tmp_path / "c"), "url string, v int", "url", buckets=8)
    first = spark.createDataFrame([(f"u{i}", i) for i in range(100)] + [(None, -1)], "url string, v int")
    assert t.upsert(first) == 1 and t.upsert(first.limit(0)) == 1
    before = t.parts(1)
    assert t.upsert(spark.createDataFrame([("u5", 500), ("new", 1), (None, -2)], "url string, v int")) == 2
    got = {r["url"]: r["v"] for r in t.read().collect()}
    assert got == {f"u{i}": i for i in range(100)} | {"u5": 500, "new": 1, None: -2}
    assert 1 <= sum(before.get(p) != f for p, f in t.parts(2).items()) <= 3


def test_publish_units(spark, tmp_path):
    unit = "source string, manager string, address string, city string, state string, kind string, room_type string, bedrooms double, rent double, available_date string, square_feet int, pets string, furnished string, parking string, laundry string, pos int"
    t = Published(spark, str(tmp_path / "u"), unit + ", unit_type string", part_of_source(F.col("source")))
    sources = spark.createDataFrame([(s, s.upper(), "eri") for s in "abcd"], "slug string, manager string, platform string")

    def of(*rows):
        return spark.createDataFrame([(s, "M", a, city, "CA", "residential", None, 1.0, rent, None, None, None, None, None, None, i) for i, (s, a, city, rent) in enumerate(rows)], unit)

    def run(units, **more):
        status = {r["slug"]: (r["ok"], r["units"], r["error"], r["preserved"]) for r in publish_units(t, sources, units, **more).collect()}
        return status, sorted((r["source"], r["address"], r["unit_type"]) for r in t.read().collect())

    status, got = run(of(("a", "1 Oak Street", "x", 900.0), ("a", "1 Oak St", "x", 900.0), ("b", "2 Elm", None, 800.0), ("c", "3 Fir", "y", 700.0)))
    assert status == {"a": (True, 1, None, False), "b": (True, 1, None, False), "c": (True, 1, None, False), "d": (True, 0, None, False)}
    assert got == [("a", "1 Oak Street", "1_bedroom"), ("b", "2 Elm", "1_bedroom"), ("c", "3 Fir", "1_bedroom")]
    status, got = run(of(("a", "9 New", "x", 900.0), ("b", "4 Bad", None, 5.0), ("b", "5 Good", None, 800.0)))
    assert status == {"a": (True, 1, None, False), "b": (False, 0, "invalid: rent", False), "c": (True, 1, None, True), "d": (True, 0, None, False)}
    assert got == [("a", "9 New", "1_bedroom"), ("b", "2 Elm", "1_bedroom"), ("c", "3 Fir", "1_bedroom")]
    status, got = run(of(("a", "9 New", "x", 900.0)), allow_empty=True)
    assert status["c"] == (True, 0, None, False) and got == [("a", "9 New", "1_bedroom")]
    assert raw.status_totals(publish_units(t, sources, of())).first().asDict() == {"sources_ok": 4, "sources_failed": 0, "total_units": 1}
    run(of(("a", "1 Z", "b", 900.0), ("a", "2 Z", "", 100.0), ("a", "3 Z", "a", 200.0), ("a", "4 Z", "a", 150.0)))
    assert [r["address"] for r in t.read(only=[folder_of("a")]).coalesce(1).collect()] == ["4 Z", "3 Z", "1 Z", "2 Z"]
