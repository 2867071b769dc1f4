"""Tables that change together: a crash between files and manifest changes nothing, a rerun gives the same tables."""

import datetime as dt

import pytest

from fluxloom.operators import events
from fluxloom.session import staging_path
from fluxloom.sources.store import CommittedTables

BASE = dt.datetime(2024, 3, 1)


def archive(spark, days, peak=9e-6):
    rows = []
    for i in range(days * 48):
        high = peak if i % 24 == 12 else 2e-6 if i % 24 in (11, 13) else 3e-7
        rows.append((BASE + dt.timedelta(minutes=30 * i), 1e-8, high, "goes16"))
    return spark.createDataFrame(rows, events.FLUX_SCHEMA)


def contents(store):
    return [sorted(map(tuple, store.read(n, schema).collect())) for n, schema in (("flux", events.FLUX_SCHEMA), ("events", events.EVENT_SCHEMA))]


def run(store, rows, days):
    return events.backfill_tables(store, rows, start="2024-03-01 00:00:00", end=f"2024-03-{days:02d} 23:59:59").first()


def test_backfill_is_all_or_nothing(spark, monkeypatch):
    rows = archive(spark, 3)
    clean = CommittedTables(spark, staging_path(spark, "store"))
    first = run(clean, rows, 3)
    assert (first.rows, first.events, first.missing_days) == (144, 6, 0) and clean.version() == 1
    want = contents(clean)
    assert len(want[0]) == 144 and len(want[1]) == 6

    torn = CommittedTables(spark, staging_path(spark, "store"))
    with monkeypatch.context() as patch:
        patch.setattr(CommittedTables, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost the driver")))
        with pytest.raises(OSError):
            run(torn, rows, 3)
    assert torn.version() == 0 and contents(torn) == [[], []]
    # a manifest without its success marker does not count either
    spark.createDataFrame([("flux", "x", "nowhere")], "name string, day string, path string").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{torn.folder}/commits/9")
    assert torn.version() == 0
    run(torn, rows, 3)
    assert contents(torn) == want


def test_backfill_reads_its_archive_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = archive(spark, 3)
    store = CommittedTables(spark, staging_path(spark, "store"))
    total = run(store, rows.mapInArrow(counted, rows.schema), 3)
    assert (total.rows, total.events, total.missing_days) == (144, 6, 0) and read.value == 144
    assert run(store, rows.mapInArrow(counted, rows.schema), 3).events == 0 and read.value == 288


def test_days_are_replaced_or_added_to(spark):
    store = CommittedTables(spark, staging_path(spark, "store"))
    put = lambda rows: store.stage("flux", rows, "timestamp", staging_path(spark, "flux"))
    store.commit({"flux": put(archive(spark, 2))})
    before = dict((d, p) for _, d, p in store._manifest(1))
    assert sorted(before) == ["2024-03-01", "2024-03-02"]
    store.commit({"flux": put(archive(spark, 1, peak=5e-6))})
    after = dict((d, p) for _, d, p in store._manifest(2))
    assert after["2024-03-02"] == before["2024-03-02"] and after["2024-03-01"] != before["2024-03-01"]
    rows = store.read("flux", events.FLUX_SCHEMA).collect()
    assert len(rows) == 96 and max(r.flux_long for r in rows if r.timestamp.day == 1) == 5e-6
    assert store.read("flux", events.FLUX_SCHEMA, ["2024-03-02"]).count() == 48 and store.read("other", events.FLUX_SCHEMA).count() == 0
    assert store.commit(added={"flux": put(archive(spark, 1))}) == 3 and store.read("flux", events.FLUX_SCHEMA).count() == 144
    store.version = lambda: 2
    with pytest.raises(RuntimeError):  # another writer was first
        store.commit()
