"""Streams that stop and go on, newest-wins state, derived tables under late rows, and pruned scans."""

from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark.sources import manifest, tables
from tidemark.streaming import derived, jobs, newest

EVENTS = "k string, ts timestamp, n int, v string"


def land(spark, folder, number, rows, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/part{number}")


def follow(spark, folder, schema=EVENTS):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_newest_wins_across_batches_and_restarts(spark, tmp_path):
    at = lambda day, hour=0: datetime(2024, 1, day, hour)
    source, out, offsets = (f"file://{tmp_path}/{x}" for x in ("in", "out", "offsets"))
    run = lambda: newest.keep_newest(newest.newest_wins(follow(spark, source), ["k"], "ts", ["n"], "2 days"), out, offsets, ["k"])
    state = lambda: {r.k: r.v for r in newest.read_newest(spark, out, ["k"], "ts", ["n"]).collect()}
    land(spark, source, 1, [("a", at(1), 1, "first"), ("b", at(1), 1, "b1"), ("c", at(1, 5), None, "null order"), ("c", at(1, 5), 0, "zero"), (None, at(1), 1, "nobody")])
    run()
    assert state() == {"a": "first", "b": "b1", "c": "zero", None: "nobody"}
    # the job ended; what lands later goes on from its state: a newer row wins, an older one does not, ties go by order
    land(spark, source, 2, [("a", at(2), 1, "newer"), ("b", at(1), 0, "older"), ("c", at(1, 5), 7, "greater order")])
    run()
    assert state() == {"a": "newer", "b": "b1", "c": "greater order", None: "nobody"}
    land(spark, source, 3, [("z", at(20), 1, "moves the watermark")])
    run()
    land(spark, source, 4, [("a", at(3), 9, "behind the watermark"), ("z", at(19), 1, "older, not late")])
    run()
    assert state() == {"a": "newer", "b": "b1", "c": "greater order", None: "nobody", "z": "moves the watermark"}
    land(spark, source, 5, [("a", at(21), 1, "again")])
    run()
    assert state()["a"] == "again"


def test_timers_drop_keys_behind_the_watermark(spark, tmp_path):
    source, out, offsets = (f"file://{tmp_path}/{x}" for x in ("in", "out", "offsets"))
    held = []
    for number, day in enumerate((1, 10, 20, 30), 1):
        land(spark, source, number, [(f"k{number}", datetime(2024, 1, day), 1, "v")])
        query = newest.keep_newest(newest.newest_wins(follow(spark, source), ["k"], "ts", ["n"], "1 day"), out, offsets, ["k"])
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert held[-1] <= 2 and len(newest.read_newest(spark, out, ["k"], "ts", ["n"]).collect()) == 4


def test_a_merge_stream_goes_on_where_it_stopped(spark, tmp_path):
    """A batch that fails after its write is run again under its number: rows count once, and nothing is skipped."""
    source, out, offsets = (f"file://{tmp_path}/{x}" for x in ("in", "out", "offsets"))
    rows = lambda batch: batch.select(F.col("k").alias("entity_id"), F.to_date("ts").alias("effective_date"), F.to_date("ts").alias("availability_date"), F.col("n").cast("string").alias("source_ref"), "v")
    calls = []

    def fail_once(batch):
        calls.append(batch.count())
        if len(calls) == 2:
            raise RuntimeError("stopped between batches")

    for number in range(1, 4):
        land(spark, source, number, [(f"k{i}", datetime(2024, 1, number), number, f"v{number}") for i in range(3)])
    try:
        jobs.merge_into(follow(spark, source), out, offsets, rows, fail_once)
        raise AssertionError("the stream should have failed")
    except Exception as error:
        assert "stopped between batches" in str(error)
    assert tables.read(spark, out, ["v"]).count() == 6  # two batches are written, the second is not committed
    jobs.merge_into(follow(spark, source), out, offsets, rows, fail_once)
    assert len(calls) == 4 and tables.read(spark, out, ["v"]).count() == 9


FACT = "entity_id string, effective_date date, availability_date date, restated_at date, source_ref string, concept string, value double"


def test_late_rows_recompute_their_partitions_only(spark, tmp_path):
    log, view = f"file://{tmp_path}/log", f"file://{tmp_path}/view"
    ends = [date(2024, m, d) for m, d in ((3, 31), (6, 30), (9, 30))]
    fact = lambda i, m, ref, v: (f"e{i}", date(2023, 12, 31), date(2024, m, 10), None, ref, "c", v)
    summarise = lambda states: states.groupBy("t", "entity_id").agg(F.sum("value").alias("total"))

    def load(rows, number):
        batch = spark.createDataFrame(rows, FACT)
        tables.append(batch, log, number, 4)
        return derived.refresh(spark, log, view, batch, number, ends, ["concept"], summarise, 4)

    def full():
        facts = tables.merged(spark.read.option("basePath", log).parquet(log), ["concept"])
        spine = facts.select("entity_id").distinct().join(spark.createDataFrame([(d,) for d in ends], "t date"), F.lit(True))
        from tidemark.operators import pit

        return sorted(map(tuple, summarise(pit.as_of_join(spine, facts.drop("bucket"), ["concept"])).select("t", "entity_id", "total").collect()))

    now = lambda: sorted(map(tuple, derived.read(spark, view).select("t", "entity_id", "total").collect()))
    files = lambda: {f.rsplit("/", 1)[1]: f for f in derived.read(spark, view).inputFiles()}
    load([fact(i, 1, "r1", float(i)) for i in range(12)], 1)
    assert now() == full() and len(now()) == 36
    before = files()
    changed = load([fact(3, 5, "r2", 300.0), fact(3, 8, "r3", 301.0)], 2)
    assert now() == full()
    bucket = spark.createDataFrame([("e3",)], "entity_id string").select(tables.bucket_of(buckets=4)).first()[0]
    assert changed == [("2024-06-30", bucket), ("2024-09-30", bucket)]  # March and the other buckets stay
    kept = {n: f for n, f in files().items() if n in before}
    assert kept == {n: f for n, f in before.items() if not any(f"day={d}/bucket={b}/" in f for d, b in changed)}
    assert load([], 3) == [] and now() == full()
    assert load([fact(3, 5, "r2", 300.0), fact(3, 8, "r3", 301.0)], 2) == changed and now() == full()


def test_a_scan_of_named_entities_reads_their_files(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    make = lambda ids, v: spark.createDataFrame([(f"e{i}", date(2024, 1, 1), date(2024, 1, 2), None, f"r{i}", "c", v) for i in ids], FACT)
    for number, (ids, v) in enumerate(((range(400), 1.0), (range(50), 2.0), (range(600, 700), 3.0))):
        tables.append(make(ids, v), path, number, 8)
        manifest.index_batch(spark, path, number)
    total = len(spark.read.parquet(path).inputFiles())
    rows, files = manifest.read_entities(spark, path, ["concept"], ["e7", "e650"], 8)
    assert {r.entity_id: r.value for r in rows.collect()} == {"e7": 2.0, "e650": 3.0}
    assert len(files) == 3 < total
    assert set(files) == {f for f in files if any(f"batch=00000000000{n}" in f for n in range(3))}
    none, files = manifest.read_entities(spark, path, ["concept"], ["absent", "zz"], 8)
    assert none.count() == 0 and set(none.columns) == set(rows.columns) and not files
    tables.append(make([7], 9.0), path, 3, 8)  # not indexed yet: read by bucket
    late, _ = manifest.read_entities(spark, path, ["concept"], ["e7"], 8)
    assert [r.value for r in late.collect()] == [9.0]
    for e in (0, 123, 399, 649):  # no false negative
        assert manifest.read_entities(spark, path, ["concept"], [f"e{e}"], 8)[0].count() == 1
