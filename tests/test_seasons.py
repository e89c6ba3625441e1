"""Season aggregates on hand cases, and their sources."""

import gzip

import pytest
from pyspark.sql import functions as F

from harvestlens.operators import joins, season, windows
from harvestlens.plans import stages
from harvestlens.sources import files, payloads, tables
from harvestlens.streaming import landing


def observations(spark, station, days, rain_days=None, tmax=30.0):
    rows = []
    for i in range(days):
        rows += [(station, f"2012-05-{i + 1:02}" if i < 31 else f"2012-06-{i - 30:02}", "TMAX", tmax),
                 (station, f"2012-05-{i + 1:02}" if i < 31 else f"2012-06-{i - 30:02}", "TMIN", 16.0)]
    for i in range(rain_days or days):
        rows.append((station, f"2012-07-{i + 1:02}", "PRCP", 0.4 if i % 2 else 2.0))
    df = spark.createDataFrame(rows, "station_id string, date string, element string, data_value double")
    return df.withColumns({"date": F.to_date("date"), "year": F.lit(2012)})


def test_thirty_common_days(spark):
    obs = observations(spark, "A", 30, 10).unionByName(observations(spark, "B", 29))
    rows = season.station_seasons(obs).collect()
    assert [r.station_id for r in rows] == ["A"]
    r = rows[0]
    assert (r.tmax_mean_c, r.tmin_mean_c, r.tavg_mean_c, r.gdd_base10) == (30.0, 16.0, 23.0, 390.0)
    assert (r.precip_total_mm, r.drought_days, r.heat_stress_days, r.wind_mean_ms) == (12.0, 5, 0, None)


def test_county_mean_keeps_fractions(spark):
    df = spark.createDataFrame([("a", 2012, "x", 3), ("b", 2012, "x", 4)], "station_id string, year int, fips string, heat_stress_days int")
    assert season.county_seasons(df).first()["heat_stress_days"] == 3.5


def test_pooled_counts_missing_rain_as_dry(spark):
    schema = "fips string, year int, tmax_c double, tmin_c double, prcp_mm double, wdsp_ms double"
    df = spark.createDataFrame([("x", 2012, 36.0, 20.0, None, 1.0), ("x", 2012, None, 10.0, 5.0, None), ("y", 2012, 30.0, None, 1.0, 1.0)], schema)
    rows = season.season_pooled(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.tmax_mean_c, r.tmin_mean_c, r.tavg_mean_c, r.gdd_base10, r.drought_days, r.precip_total_mm) == (36.0, 15.0, 28.0, 18.0, 1, 5.0)


def test_array_season_defaults(spark):
    df = spark.createDataFrame([("x", 2012, 36.0, 20.0, None), ("x", 2012, 20.0, 10.0, 0.2)],
                               "fips string, year int, temperature_2m_max double, temperature_2m_min double, precipitation_sum double")
    r = season.season_from_arrays(df).first()
    assert (r.et0_total_mm, r.solar_total_mj, r.wind_max_mean_ms, r.drought_days, r.gdd_base10) == (0.0, 0.0, 0.0, 1, 23.0)


def test_payloads(spark):
    maps = '{"properties":{"parameter":{"T2M_MAX":{"20120501":30.5,"20120502":-999.0},"WS2M":{"20120501":2.0}}}}'
    rows = payloads.daily_from_maps(spark.createDataFrame([(1, maps), (2, "{}")], "k int, b string"), "b", ["k"]).orderBy("date").collect()
    assert [(str(r.date), r.T2M_MAX, r.WS2M) for r in rows] == [("2012-05-01", 30.5, 2.0), ("2012-05-02", None, None)]
    arrays = '{"daily":{"time":["2012-05-01","2012-05-02"],"temperature_2m_max":[1.5,null]}}'
    rows = payloads.daily_from_arrays(spark.createDataFrame([(1, arrays), (2, '{"daily":{}}')], "k int, b string"), "b", ["k"]).collect()
    assert [(str(r.date), r.temperature_2m_max, r.temperature_2m_min) for r in rows] == [("2012-05-01", 1.5, None), ("2012-05-02", None, None)]


def test_station_lines(spark):
    def line(station, lat, lon, state, name):
        return f"{station:<11} {lat:>8} {lon:>9} {'10.0':>6} {state:<2} {name:<30}"

    lines = [line("US1", "41.5", "-93.6", "IA", "AMES"), line("CA1", "41.5", "-93.6", "IA", "X"), line("US2", "bad", "-93.6", "IA", "Y"),
             line("US3", "41.5", "-93.6", "CA", "Z"), "US4 short"]
    rows = files.parse_stations(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.station_id, r.lat, r.lon, r.state, r.name) for r in rows] == [("US1", 41.5, -93.6, "IA", "AMES")]


def write_year(path, rows, compress):
    text = "\n".join(",".join(r) for r in rows) + "\n"
    if compress:
        with gzip.open(path, "wt") as f:
            f.write(text)
    else:
        path.write_text(text)


def test_year_files(spark, tmp_path):
    good = [("US1", "20120501", "TMAX", "300", "", "", "0", ""), ("US1", "20120502", "TMAX", "300", "", "X", "0", ""),
            ("US1", "20120115", "TMAX", "300", "", "", "0", ""), ("US1", "2012050x", "TMAX", "300", "", "", "0", ""),
            ("US1", "20120503", "TMAX", "700", "", "", "0", ""), ("US1", "20120503", "SNOW", "7", "", "", "0", "")]
    write_year(tmp_path / "2012.csv.gz", good, True)
    write_year(tmp_path / "2012.csv", good * 2, False)
    write_year(tmp_path / "2013.csv", [("US1", "20130601", "PRCP", "15", "", "", "0", "700")], False)
    found, missing = files.find_year_files(spark, str(tmp_path), [2012, 2013, 2014])
    assert found[2012].endswith(".gz") and missing == [2014]
    rows = season.clean_observations(files.read_daily(spark, str(tmp_path), [2012, 2013, 2014])).orderBy("date").collect()
    assert [(str(r.date), r.element, r.data_value, r.year) for r in rows] == [
        ("2012-05-01", "TMAX", 30.0, 2012), ("2013-06-01", "PRCP", 1.5, 2013)]
    assert files.read_daily(spark, str(tmp_path), [2030]).count() == 0
    files.land_daily(spark, str(tmp_path), [2012, 2013], str(tmp_path / "landed"))
    assert spark.read.parquet(str(tmp_path / "landed")).count() == 2


def test_centroid_file(spark, tmp_path):
    (tmp_path / "c.txt").write_bytes("﻿STATEFP,COUNTYFP,COUNAME,STNAME,POPULATION,LATITUDE,LONGITUDE\n1,5, Bo ,Ala,9,+32.5,-086.5\n".encode())
    r = files.read_centroids(spark, str(tmp_path / "c.txt")).first()
    assert (r.fips, r.lat, r.lon, r.county_name) == ("01005", 32.5, -86.5, "Bo")
    assert files.fallback_centroids(spark).count() == 10


def test_resume(spark, tmp_path):
    asked = []

    def compute(years):
        asked.append(list(years))
        return spark.createDataFrame([("a", y, float(y)) for y in years], "fips string, year int, v double")

    path = str(tmp_path / "cache")
    tables.extend_by_year(spark, path, [2010, 2011], compute)
    out = tables.extend_by_year(spark, path, [2010, 2011, 2012], compute)
    assert asked == [[2010, 2011], [2012]]
    assert sorted((r.fips, r.year) for r in out.collect()) == [("a", 2010), ("a", 2011), ("a", 2012)]


def test_year_cache_is_read_as_it_lies(spark, tmp_path):
    path, asked = str(tmp_path / "cache"), []

    def compute(years):
        asked.append(years)
        rows = [(f, y, float(v)) for y in years for f in "ab" for v in (2, 1)]  # every key twice
        return spark.createDataFrame([*rows, ("x", 1900, 0.0)], "fips string, year int, v double")

    def files():
        return {f: f.stat().st_mtime_ns for f in (tmp_path / "cache").rglob("*.parquet")}

    def rows(table):
        return sorted(map(tuple, table.select("fips", "year", "v").collect()))

    first = tables.extend_by_year(spark, path, [2010, 2011], compute)
    expected = [(f, y, 1.0) for f in "ab" for y in (2010, 2011)]
    assert rows(first) == expected and asked == [[2010, 2011]]
    before = files()
    again = tables.extend_by_year(spark, path, [2011], compute)
    assert rows(again) == expected and len(asked) == 1 and files() == before
    plan = again.where("year = 2011")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "PartitionFilters: [isnotnull(year" in plan
    # Rows that somebody else adds to a year are found by their file; the other year is left alone.
    foreign = spark.createDataFrame([("a", 2011, 0.5), ("c", 2011, 7.0)], "fips string, year int, v double")
    tables.write_table(foreign, path, partition_by=["year"], mode="append")
    before = files()
    mended = tables.extend_by_year(spark, path, [2010, 2012], compute)
    assert asked[1:] == [[2012]]
    assert rows(mended) == sorted([("a", 2010, 1.0), ("b", 2010, 1.0), ("a", 2011, 0.5), ("b", 2011, 1.0), ("c", 2011, 7.0),
                                   ("a", 2012, 1.0), ("b", 2012, 1.0)])
    assert all(files().get(f) == t for f, t in before.items() if "year=2010" in str(f))
    before = files()
    tables.extend_by_year(spark, path, [2010, 2011, 2012], compute)
    assert files() == before


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("Corn", 2010, 1.0), ("Corn", 2011, 2.0)], "commodity_name string, year int, v double")
    tables.write_table(df, str(tmp_path / "t"), partition_by=["commodity_name", "year"])
    tables.register(spark, "cropdb.t1", str(tmp_path / "t"))
    assert spark.table("cropdb.t1").count() == 2
    assert tables.first_existing(spark, ["cropdb.none", "cropdb.t1"]) == "cropdb.t1"
    tables.require_tables(spark, ["cropdb.t1"])
    with pytest.raises(RuntimeError, match="none"):
        tables.require_tables(spark, ["cropdb.t1", "cropdb.none"])
    with pytest.raises(LookupError):
        tables.scan_first(spark, ["cropdb.none"])


def test_landing_stream_is_incremental(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    mapping = spark.createDataFrame([("US1", "19001")], "station_id string, fips string")

    def year_rows(y):
        return [("US1", f"{y}05{d:02}", e, v, "", "", "0", "") for d in range(1, 32) for e, v in (("TMAX", "300"), ("TMIN", "160"))]

    write_year(folder / "2012.csv", year_rows(2012), False)
    args = (spark, str(folder), mapping, str(tmp_path / "cache"), str(tmp_path / "cp"))
    landing.follow_year_files(*args)
    write_year(folder / "2013.csv.gz", year_rows(2013), True)
    landing.follow_year_files(*args)
    rows = spark.read.parquet(str(tmp_path / "cache")).orderBy("year").collect()
    assert [(r.fips, r.year, r.tmax_mean_c) for r in rows] == [("19001", 2012, 30.0), ("19001", 2013, 30.0)]


def test_landing_stream_with_both_names_and_a_late_delivery(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    mapping = spark.createDataFrame([("US1", "19001")], "station_id string, fips string")

    def days(month):
        return [("US1", f"2012{month:02}{d:02}", e, v, "", "", "0", "") for d in range(1, 32 if month == 5 else 31)
                for e, v in (("TMAX", "300"), ("TMIN", "160"), ("PRCP", "10"))]

    def rain():
        landing.follow_year_files(spark, str(folder), mapping, str(tmp_path / "cache"), str(tmp_path / "cp"))
        return [r.precip_total_mm for r in spark.read.parquet(str(tmp_path / "cache")).collect()]

    write_year(folder / "2012.csv", days(5), False)
    write_year(folder / "2012.csv.gz", days(5), True)
    assert rain() == [31.0]
    (folder / "second").mkdir()
    write_year(folder / "second" / "2012.csv", days(6) + days(5)[:30], False)  # June, and ten days of May once more
    assert rain() == [61.0]
    assert rain() == [61.0]


def test_derived_indices(spark):
    schema = ("fips string, year int, tmax_mean_c double, tmin_mean_c double, tavg_mean_c double, precip_total_mm double, "
              "gdd_base10 double, heat_stress_days double, drought_days double")
    df = spark.createDataFrame([("x", 2010, 30.0, 16.0, 23.0, 500.0, 1000.0, 5.0, 9.0), ("x", 2011, None, None, None, None, None, None, None),
                                ("x", 2012, 32.0, 18.0, 25.0, 700.0, 1200.0, 7.0, 11.0)], schema)
    rows = {r.year: r for r in stages.derive_indices(df).collect()}
    assert rows[2011].precip_total_mm == 600.0 and rows[2011].precip_z == pytest.approx(0.0)
    assert rows[2010].cwsi == 4.508 and rows[2010].heat_fraction == round(5 / 1200, 4)


def test_mapped_stations(spark):
    obs = spark.createDataFrame([("a", 1), ("b", 2)], "station_id string, v int")
    mapping = spark.createDataFrame([("a", "x")], "station_id string, fips string")
    assert [tuple(r) for r in joins.map_rows(obs, mapping, ["station_id"]).collect()] == [("a", 1, "x")]
    assert windows.first_per_key(mapping, ["fips"], [F.col("station_id")]).count() == 1


def test_seasons_from_answers(spark):
    arrays = '{"daily":{"time":["2012-05-01","2012-05-02"],"temperature_2m_max":[36.0,20.0],"temperature_2m_min":[20.0,10.0]}}'
    maps = '{"properties":{"parameter":{"T2M_MAX":{"20120501":36.0,"20120502":20.0},"T2M_MIN":{"20120501":20.0,"20120502":-999.0}}}}'
    df = spark.createDataFrame([("x", 2012, arrays, maps)], "fips string, year int, a string, m string")
    first = stages.weather_from_answers(df, "a").first()
    assert (first.tmax_mean_c, first.gdd_base10, first.precip_total_mm, first.heat_stress_days) == (28.0, 23.0, 0.0, 1)
    second = stages.weather_from_answers(df, "m", maps=True).first()
    assert (second.tmax_mean_c, second.tmin_mean_c, second.tavg_mean_c, second.gdd_base10) == (28.0, 20.0, 28.0, 18.0)
