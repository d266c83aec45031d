import datetime as dt

from millrace.streaming import online

SCHEMA = "event_id int, ts timestamp, unit int, value double, service boolean"


def run(spark, tmp_path, batches, build, name, mode):
    source = str(tmp_path / "in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source + "/*")
    query = None
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{source}/b{i}")
        if query is None:
            stream = spark.readStream.schema(SCHEMA).parquet(source + "/*")
            query = (build(stream).writeStream.format("memory").queryName(name).outputMode(mode)
                     .option("checkpointLocation", str(tmp_path / "ck")).start())
        query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_alarms(spark, tmp_path):
    rules = [{"alarm": "hot", "kind": "above", "column": "value", "limit": 5}]
    out = run(spark, tmp_path, [[(1, at(0), 1, 9.0, False), (2, at(1), 1, 1.0, False)]],
              lambda s: online.alarm_stream(s, rules), "alarms", "append")
    assert [r.event_id for r in out] == [1]


def test_range_counts_drop_late_rows(spark, tmp_path):
    contract = spark.createDataFrame([("value", "0-5")], "field_name string, typical_range string")
    batches = [[(1, at(0), 1, 9.0, False), (2, at(1), 1, 1.0, False)], [(3, at(600), 1, 1.0, False)],
               [(4, at(2), 1, 9.0, False)], [(5, at(1200), 1, 1.0, False)]]
    out = run(spark, tmp_path, batches, lambda s: online.range_counts(s, contract, "ts"), "counts", "append")
    assert (2, 1) in {(r.n, r.outside) for r in out}  # the late row 4 is not counted
    assert sum(r.n for r in out) == 3


def test_wear_follows_batches(spark, tmp_path):
    batches = [[(1, at(0), 1, 0.4, False), (2, at(1), 1, 0.3, False), (3, at(1), 2, 0.9, False)],
               [(4, at(3), 1, 0.0, True), (5, at(4), 1, 0.2, False), (6, at(4), 2, 0.9, False)]]
    out = run(spark, tmp_path, batches, lambda s: online.wear_stream(s, "unit", "ts", "value", "service"),
              "wear", "update")
    levels = {}
    for r in out:
        levels.setdefault(r.unit, []).append(round(r.wear, 6))
    assert levels == {1: [0.7, 0.2], 2: [0.9, 1.0]}


def test_wear_drops_late_rows(spark, tmp_path):
    batches = [[(1, at(0), 1, 0.2, False)], [(2, at(600), 1, 0.1, False)],
               [(3, at(5), 1, 0.5, False), (4, None, 1, 0.3, False)],  # ten hours late; no time
               [(5, at(595), 1, 0.1, False)]]  # older than the last row, but in time
    out = run(spark, tmp_path, batches, lambda s: online.wear_stream(s, "unit", "ts", "value", "service"),
              "late_wear", "update")
    assert [(r.ts, round(r.wear, 6)) for r in sorted(out, key=lambda r: r.wear)] == [
        (at(0), 0.2), (at(600), 0.3), (at(600), 0.4)]
