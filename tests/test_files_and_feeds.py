"""Sources, layouts, and streams against their batch twins."""

import datetime as dt
import json

from pyspark.sql import functions as F

from freshet.sources import files
from freshet.streaming import feeds


def test_series_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"site_id": "1", "dates": ["2000-01-01", "2000-01-02"], "q_cms": [1.0, None], "approval_codes": ["A", "P"], "qualifier_codes": ["e"]}))
    rows = files.read_series(spark, str(tmp_path)).orderBy("date").collect()
    assert [(r.value, r.units, r.approval, r.qualifier) for r in rows] == [(1.0, "m3/s", "A", None), (None, "m3/s", "P", None)]


def test_features_attributes_texts(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"id": "USGS-1", "properties": {"n": "x"}, "geometry": {"type": "Point", "coordinates": [-70.5, 45.0]}}]}))
    assert files.read_features(spark, str(tmp_path / "f.json")).first().lon == -70.5
    (tmp_path / "h.csv").write_text("gauge_id;area\n1013500;10.5\n")
    (tmp_path / "c.csv").write_text("gauge_id;aridity\n01013500;0.6\n01031500;0.7\n")
    got = files.read_attributes(spark, {str(tmp_path / "h.csv"): "gauge_id string, area double", str(tmp_path / "c.csv"): "gauge_id string, aridity double"})
    assert {(r.gauge_id, r.area, r.aridity) for r in got.collect()} == {("01013500", 10.5, 0.6), ("01031500", None, 0.7)}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_bytes(b"caf\xe9 ok")
    (tmp_path / "t" / "b.bin").write_bytes(b"no")
    assert [(r.doc_name, r.text) for r in files.read_texts(spark, str(tmp_path / "t")).collect()] == [("a.txt", "caf� ok")]


def test_layouts(spark, tmp_path):
    rows = [("s", dt.date(2000, 1, d), 1.0 * d, 2.0, 0.5, 1.25, 3.0) for d in (2, 1)]
    forcing = spark.createDataFrame(rows, "site_id string, date date, prcp_mm double, tmax_C double, tmin_C double, tavg_C double, wind_ms double")
    files.write_layout(files.vic_layout(forcing), str(tmp_path / "vic"), header=False)
    (part,) = (tmp_path / "vic" / "site_id=s").glob("*.csv")
    assert part.read_text() == "1.000\t2.000\t0.500\t3.000\n2.000\t2.000\t0.500\t3.000\n"
    files.write_layout(files.summa_layout(forcing), str(tmp_path / "summa"), header=True)
    (part,) = (tmp_path / "summa" / "site_id=s").glob("*.csv")
    assert part.read_text().splitlines()[:2] == ["year\tmonth\tday\thour\tprcp_mm\ttavg_C\twind_ms", "2000\t1\t1\t12\t1.000\t1.250\t3.000"]
    files.write_served_csv(spark.createDataFrame([("s", dt.date(2000, 1, 1), None), ("s", dt.date(2000, 1, 2), 1.5)], "site_id string, date date, value double"), str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv" / "site_id=s").glob("*.csv")
    assert part.read_text() == "date,q_cms\n2000-01-01,\n2000-01-02,1.5\n"


def test_streams_equal_batches(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"s{i % 2}", t0 + dt.timedelta(minutes=15 * i), float(i % 40), "A" if i % 3 == 0 else "P") for i in range(500)]
    schema = "site_id string, ts timestamp, value double, approval string"
    batch = spark.createDataFrame(rows, schema)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    # a later reading moves the watermark past all windows, so that append mode gives them out
    spark.createDataFrame([("s0", t0 + dt.timedelta(days=30), 100.0, "P")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for n, f in enumerate((feeds.daily_means, lambda d: feeds.episodes(d, 30.0))):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = str(tmp_path / f"out{n}")
        f(stream).writeStream.format("parquet").option("checkpointLocation", f"{out}-ck").outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
        want = f(batch).collect()
        got = [r for r in spark.read.parquet(out).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_upsert_prefers_approved(spark, tmp_path):
    schema = "site_id string, ts timestamp, value double, approval string"
    write = feeds.upsert(str(tmp_path / "table"))
    t = dt.datetime(2024, 1, 1)
    write(spark.createDataFrame([("s", t, 1.0, "P")], schema), 0)
    write(spark.createDataFrame([("s", t, 2.0, "A"), ("s", t, 3.0, "P")], schema), 1)
    assert [(r.value, r.approval) for r in spark.read.parquet(str(tmp_path / "table/v=1")).collect()] == [(2.0, "A")]
    once = feeds.distinct_readings(spark.createDataFrame([("s", t, 1.0, "P")] * 3, schema))
    assert once.count() == 1 and once.select(F.max("value")).first()[0] == 1.0
