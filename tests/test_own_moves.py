"""Own moves that are recorded before or after the changes that they explain."""

from __future__ import annotations

import datetime as dt
import random

from docloom.streaming import own_moves

EVENTS = "event_id long, ts timestamp, path string, kind string, new_path string, mtime_us long"
DAY = dt.datetime(2024, 1, 1)


def at(seconds):
    return DAY + dt.timedelta(seconds=seconds)


def feed(spark, place, *batches, keep=3600, run_each=True):
    """Each batch is (events, records); one run of the stream after each, or one for all."""
    for name, schema in (("e", EVENTS), ("m", own_moves.RECORD)):
        spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(f"{place}/{name}")
    last = -1
    for k, (events, records) in enumerate(batches):
        if events:
            spark.createDataFrame(events, EVENTS).coalesce(1).write.mode("append").parquet(f"{place}/e")
        if records:
            spark.createDataFrame(records, own_moves.RECORD).coalesce(1).write.mode("append").parquet(f"{place}/m")
        if run_each or k == len(batches) - 1:
            last = own_moves.follow(spark, f"{place}/e", EVENTS, f"{place}/m", f"{place}/t", f"{place}/c", keep=keep)
    return last, sorted((r.path, r.event_id) for r in own_moves.version(spark, f"{place}/t", last).collect())


def truth(events, records, seconds=10):
    said = {}
    for event_id, ts, path, kind, new_path, _ in events:
        for p, gone in [(path, True), (new_path, False)] if kind == "move" else [(path, kind == "delete")]:
            if not any(q == p and abs((ts - a).total_seconds()) <= seconds for q, a in records):
                said[p] = max(said.get(p, (DAY - dt.timedelta(days=9), -1, False)), (ts, event_id, gone))
    return sorted((p, s[1]) for p, s in said.items() if not s[2])


def test_both_orders_give_the_same_table(spark, tmp_path):
    before = [(1, at(0), "/a", "create", None, 1), (2, at(0), "/x", "create", None, 1)]
    moved = [(3, at(100), "/a", "move", "/b", 2)]
    records = [("/a", at(104)), ("/b", at(104))]
    late = feed(spark, tmp_path / "late", (before, []), (moved, []), ([], records))[1]
    early = feed(spark, tmp_path / "early", (before, []), ([], records), (moved, []))[1]
    assert late == early == truth(before + moved, records) == [("/a", 1), ("/x", 2)]


def test_an_event_counts_until_its_record_comes(spark, tmp_path):
    before, gone = [(1, at(0), "/a", "create", None, 1)], [(2, at(50), "/a", "delete", None, 2)]
    assert feed(spark, tmp_path, (before, []), (gone, []))[1] == []
    assert feed(spark, tmp_path, ([], [("/a", at(60))]))[1] == [("/a", 1)]  # the band holds its ends
    assert feed(spark, tmp_path, (gone, []))[1] == [("/a", 1)]  # told again
    assert feed(spark, tmp_path, ([(3, at(71), "/a", "delete", None, 3)], []))[1] == []  # beyond the band


def test_nothing_new_and_rows_that_say_nothing(spark, tmp_path):
    events = [(1, at(0), "/a", "create", None, 1), (2, None, "/a", "delete", None, 1), (3, at(1), None, "create", None, 1), (None, at(1), "/c", "create", None, 1)]
    first = feed(spark, tmp_path, (events, [(None, at(0)), ("/a", None)]))
    assert first == feed(spark, tmp_path, ([], [])) and first[1] == [("/a", 1)]


def test_old_events_are_settled_by_timers(spark, tmp_path):
    """Nothing is kept here, so a record that comes some batches later explains nothing, and late events still count."""
    delete, other = [(2, at(50), "/a", "delete", None, 2)], lambda k: [(k, at(0), "/o", "create", None, 1)]
    batches = [([(1, at(0), "/a", "create", None, 1)], []), (delete, []), (other(7), []), (other(8), []), (other(9), []), ([], [("/a", at(50))])]
    assert feed(spark, tmp_path, *batches, keep=0)[1] == [("/o", 9)]
    assert feed(spark, tmp_path, ([(3, at(40), "/a", "create", None, 3)], []), keep=0)[1] == [("/o", 9)]  # older than the delete
    assert feed(spark, tmp_path, ([(4, at(90), "/a", "create", None, 3)], []), keep=0)[1] == [("/a", 4), ("/o", 9)]


def test_any_order_of_files_gives_what_a_plain_loop_gives(spark, tmp_path):
    draw = random.Random(3)
    paths = [f"/p{k}" for k in range(6)]
    events = []
    for k in range(120):
        kind = draw.choice(["create", "modify", "delete", "move"])
        events.append((k, at(draw.randrange(400)), draw.choice(paths), kind, draw.choice(paths) if kind == "move" else None, k))
    records = [(draw.choice(paths), at(draw.randrange(400))) for _ in range(8)]
    mixed = [("e", e) for e in events] + [("m", m) for m in records] + [("e", e) for e in events[:20]]
    draw.shuffle(mixed)
    batches = [([r for s, r in mixed[k::4] if s == "e"], [r for s, r in mixed[k::4] if s == "m"]) for k in range(4)]
    assert feed(spark, tmp_path, *batches)[1] == truth(events, records)


def test_records_meet_events_at_the_ends_of_the_band(spark):
    draw = random.Random(5)
    for seconds in (0, 1, 3):
        band = seconds * 1_000_000
        events = [("event", f"/p{draw.randrange(3)}", draw.choice((0, 1_704_067_200_000_000)) + draw.randrange(-9, 9) * 500_000 + draw.randrange(-1, 2), k) for k in range(300)]
        records = [("record", p, us + draw.choice((-band - 1, -band, 0, band, band + 1)), None) for _, p, us, _ in draw.sample(events, 12)]
        rows = spark.createDataFrame([(p, kind, us, k, False, 0, 0) for kind, p, us, k in events + records] + [("/p0", "settled", events[0][2], 999, False, 0, None)], own_moves.STATE)
        got = sorted(r.event_id for r in own_moves.unexplained(rows, seconds).where("kind <> 'record'").collect())
        assert got == [k for _, p, us, k in events if not any(p == q and abs(us - at) <= band for _, q, at, _ in records)] + [999]


def test_state_is_a_table_that_holds_what_arrived_in_the_while(spark, tmp_path):
    batches = [([(k, at(k), "/hot", "modify", None, k) for k in range(10 * b, 10 * b + 10)], [("/hot", at(9000))]) for b in range(3)]
    last = feed(spark, tmp_path, *batches, keep=0)[0]
    held = sorted((r.kind, r.event_id) for r in own_moves.table_of(spark, f"{tmp_path}/t").read(last).collect())
    assert held == [("event", k) for k in range(20, 30)] + [("record", None), ("settled", 19)]
