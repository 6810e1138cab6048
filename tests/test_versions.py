"""Tables in versions: what a change writes, what readers see, and change feeds on top of them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from docloom.operators import index
from docloom.sources.versions import VersionedTable
from docloom.streaming import changes

SCHEMA = "id long, v string"


def table_of(spark, tmp_path, buckets=8):
    return VersionedTable(spark, f"{tmp_path}/t", SCHEMA, "id", buckets)


def put(old, new):
    return index.upsert(old, new, "id", [F.desc("v")])


def rows(df):
    return sorted(map(tuple, df.collect()))


def frame(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def written(tmp_path, version):
    return sorted(p.name for p in Path(f"{tmp_path}/t/data/v={version}").glob("bucket=*"))


def test_one_changed_key_rewrites_one_bucket(spark, tmp_path):
    t = table_of(spark, tmp_path)
    assert t.last() == -1 and t.read().count() == 0
    assert t.commit(frame(spark, *((k, "a") for k in range(50))), put) == 0
    assert t.commit(frame(spark, (7, "b"), (7, "c")), put) == 1
    assert len(written(tmp_path, 0)) == 8 and len(written(tmp_path, 1)) == 1
    assert rows(t.read()) == sorted((k, "c" if k == 7 else "a") for k in range(50))
    assert rows(t.read(0)) == [(k, "a") for k in range(50)]  # older versions stay


def test_no_changes_make_no_version(spark, tmp_path):
    t = table_of(spark, tmp_path)
    t.commit(frame(spark, (1, "a")), put)
    assert t.commit(frame(spark), put) == 0 and t.last() == 0


def test_a_version_that_is_committed_twice_is_the_same(spark, tmp_path):
    t = table_of(spark, tmp_path)
    t.commit(frame(spark, (1, "a"), (2, "a")), put, 0)
    t.commit(frame(spark, (1, "b")), put, 1)
    first = rows(t.read())
    assert t.commit(frame(spark, (1, "b")), put, 1) == 1 and rows(t.read()) == first == [(1, "b"), (2, "a")]


def test_rows_that_go_and_compaction(spark, tmp_path):
    t = table_of(spark, tmp_path)
    t.commit(frame(spark, *((k, "a") for k in range(20))), put)
    t.commit(frame(spark, (3, "x")), lambda old, new: old.join(new.select("id"), "id", "left_anti"))
    assert rows(t.read()) == [(k, "a") for k in range(20) if k != 3]
    assert t.compact() == 2 and rows(t.read()) == [(k, "a") for k in range(20) if k != 3]
    assert set(t.manifest(2).values()) == {2}
    only = table_of(spark, tmp_path / "one")
    only.commit(frame(spark, (1, "a")), put)
    only.commit(frame(spark, (1, "a")), lambda old, new: old.where("false"))
    assert only.read().count() == 0


EVENTS = "event_id long, ts timestamp, path string, kind string, new_path string, mtime_us long"


def test_following_without_news_returns_the_last_version(spark, tmp_path):
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(k, day, f"/f{k}", "create", None, 1) for k in range(40)], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    follow = lambda: changes.follow(spark, f"{tmp_path}/in", EVENTS, f"{tmp_path}/t", f"{tmp_path}/c")
    assert changes.follow(spark, f"{tmp_path}/in", EVENTS, f"{tmp_path}/t", f"{tmp_path}/c") == 0
    assert follow() == 0 and changes.version(spark, f"{tmp_path}/t", 0).count() == 40
    spark.createDataFrame([(99, day + dt.timedelta(days=1), "/f3", "delete", None, 2)], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    last = follow()
    assert last == 1 and len(written(tmp_path, 1)) == 1  # one bucket of the state
    assert changes.version(spark, f"{tmp_path}/t", last).count() == 39
    assert follow() == 1
