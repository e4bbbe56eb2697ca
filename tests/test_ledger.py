from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from metascope.operators.ledger import StaleWriter, WorkLedger, build_ledger, newest_versions, pending_files, read_outputs, run_work
from metascope.sources.deltas import DeltaLog

T = datetime(2025, 1, 1)
D = lambda n: T + timedelta(days=n)
FILES = "file_id bigint, config_id string, file_path string, rel_path string, mtime timestamp_ntz, scanned_at timestamp_ntz, state string"
STATE = "state_id bigint, config_id string, cache_file string, rel_path string, mtime timestamp_ntz, schema_version int, run_id bigint, written_at timestamp_ntz"
RUNS = "run_id bigint, run_status string, started_at timestamp_ntz"
CONFIGS = "config_id string, cache_file string"


def world(spark, files, state, runs=((1, "success"), (2, "failed"), (3, "running"))):
    return (
        spark.createDataFrame([(*f, "x") for f in files], FILES), spark.createDataFrame(state, STATE), spark.createDataFrame([("a", "c1")], CONFIGS), spark.createDataFrame([(r, s, D(0)) for r, s in runs], RUNS),
    )


def pending(spark, files, state):
    return sorted(r.file_id for r in pending_files(*world(spark, files, state)).collect())


def test_what_counts_as_done(spark):
    f = [(1, "a", "p", "x/y", D(1), D(2)), (2, "a", "p", "new", D(1), D(2)), (3, "a", "p", "back", D(1), D(2)), (4, "a", "p", "v2", D(5), D(3)), (5, "a", "p", "v2", D(6), D(4)), (6, "zz", "p", "x/y", D(1), D(2)), (7, "a", "p", "nomt", None, D(2))]
    s = [(1, "a", "c1", "x\\y", D(1), 4, 1, D(2)), (2, "a", "c1", "back", D(2), 4, 1, D(2)), (3, "a", "c1", "v2", D(5), 4, 1, D(3)), (4, "zz", "c1", "x/y", D(1), 4, 1, D(2)), (5, "a", "c1", "nomt", None, 4, 1, D(2))]
    assert pending(spark, f, s) == [2, 3, 5, 6]


@pytest.mark.parametrize("row", [("a", "old", "x", D(1), 4, 1, D(9)), ("a", "c1", "x", D(1), 3, 1, D(9)), ("a", "c1", "x", D(1), None, 1, D(9)), ("a", "c1", "x", D(1), 4, 2, D(9)), ("a", "c1", "x", D(1), 4, 3, D(9)), ("a", "c1", "x", D(1), 4, 99, D(9)), (None, "c1", "x", D(1), 4, 1, D(9))])
def test_rows_that_do_not_count(spark, row):
    files = [(1, "a", "p", "x", D(1), D(2))]
    assert pending(spark, files, [(1, *row)]) == [1]
    assert pending(spark, files, [(1, *row), (2, "a", "c1", "x", D(1), 4, 1, D(5))]) == []
    assert pending(spark, files, [(1, *row), (2, "a", "c1", "x", D(2), 4, 1, D(5))]) == [1]


def test_leases_of_running_runs(spark):
    w = world(spark, [(1, "a", "p", "x", D(1), D(2))], [(1, "a", "c1", "x", D(1), 4, 3, D(0))])
    at = lambda now: build_ledger(*w, now=now, lease=timedelta(hours=6)).first().state
    assert [at(D(0) + timedelta(hours=1)), at(D(0) + timedelta(hours=7)), at(None)] == ["leased", "pending", "pending"]


def test_ties_repeats_and_empty(spark):
    f = [(1, "a", "p", "x", D(1), D(2)), (2, "a", "p", "x", D(3), D(2)), (2, "a", "p", "x", D(3), D(2))]
    w = world(spark, f, [])
    assert [r.file_id for r in newest_versions(w[0]).collect()] == [2]
    assert pending(spark, [], []) == []


def items(spark, n, mtime=D(0), version=0):
    rows = [(f"i{k}" + f"v{version}" * bool(version), "a", f"p{k}", k + 100 * version, mtime, D(version), "pending") for k in range(n)]
    return spark.createDataFrame(rows, "item string, config_id string, rel_path string, file_id bigint, mtime timestamp_ntz, scanned_at timestamp_ntz, state string")


HOUR = timedelta(hours=1)


def names(df):
    return sorted(r.item for r in df.collect())


def test_ledger_survives_failures(spark, tmp_path):
    led = WorkLedger(spark, str(tmp_path / "ledger"), every=3)
    led.add(items(spark, 4))
    assert led.add(items(spark, 4)) and led.items().count() == 4
    t1 = led.lease(D(0), HOUR, limit=3)
    assert led.leased(t1).count() == 3
    led.complete(t1, led.leased(t1).filter("item = 'i0'"))
    t2 = led.lease(D(0) + 2 * HOUR, HOUR, limit=1)  # i1 comes back after its lease, i2 stays with the first writer
    assert t2 > t1 and names(led.leased(t2)) == ["i1"] and names(led.leased(t1)) == ["i2"]
    for step in (lambda: led.complete(t1), lambda: led.complete(t1, spark.createDataFrame([("i1",)], "item string")), lambda: led.write(t1, led.items(), str(tmp_path / "out"))):
        with pytest.raises(StaleWriter):
            step()
    t3 = led.lease(D(0) + 4 * HOUR, HOUR)  # all that is not done
    out = led.leased(t3).select("item", F.length("item").alias("n"))
    assert names(out) == ["i1", "i2", "i3"]
    for _ in range(2):  # a repeated attempt writes to the same place
        led.write(t3, out, str(tmp_path / "out"))
    led.complete(t3)
    assert led.items().filter("state = 'done'").count() == 4
    assert names(read_outputs(spark, led, str(tmp_path / "out"))) == ["i1", "i2", "i3"]


def test_a_reverted_mtime_is_work_again(spark, tmp_path):
    led = WorkLedger(spark, str(tmp_path / "ledger"))
    for version, mtime in ((1, D(1)), (2, D(2)), (3, D(1))):
        led.add(items(spark, 1, mtime, version))
        token = led.lease(D(version), HOUR)
        assert names(led.leased(token)) == [f"i0v{version}"]
        led.complete(token)
    led.add(items(spark, 1, D(1), 4))  # scanned again, unchanged
    led.add(items(spark, 1, D(9), 2))  # an old version that comes late
    assert led.leased(led.lease(D(9), HOUR)).isEmpty()


def test_newer_versions_retire_older_work(spark, tmp_path):
    led = WorkLedger(spark, str(tmp_path / "ledger"))
    led.add(items(spark, 2, D(1), 1))
    token = led.lease(D(1), HOUR, limit=1)
    led.add(items(spark, 2, D(2), 2))
    assert {(r.item, r.state) for r in led.items().collect()} == {("i0v1", "leased"), ("i1v1", "retired"), ("i0v2", "pending"), ("i1v2", "pending")}
    again = led.lease(D(2), HOUR)
    assert names(led.leased(again)) == ["i0v2", "i1v2"] and led.leased(token).isEmpty()


def test_a_run_over_notes(spark, tmp_path):
    f = [(1, "a", "p", "x", D(1), D(2)), (2, "a", "p", "new", D(1), D(2)), (3, "a", "p", "held", D(1), D(2))]
    s = [(1, "a", "c1", "x", D(1), 4, 1, D(2)), (2, "a", "c1", "held", D(1), 4, 3, D(2))]
    led, token = run_work(spark, str(tmp_path / "l"), *world(spark, f, s))
    assert {r.rel_path: r.state for r in led.items(1).collect()} == {"x": "done", "new": "pending", "held": "leased"}
    assert sorted(r.file_id for r in led.leased(token).collect()) == [2, 3]
    assert led.complete(token) and led.items().filter("state <> 'done'").isEmpty()
    led, token = run_work(spark, str(tmp_path / "empty"), *world(spark, [], [], ()))
    assert led.leased(token).isEmpty()


def test_two_writers_from_one_version(spark, tmp_path):
    a, b = (WorkLedger(spark, str(tmp_path / "l")) for _ in range(2))
    a.add(items(spark, 2))
    real, raced = a.log.version, []

    def slow():
        v = real()
        if not raced:
            raced.append(1)
            b.lease(D(0), HOUR, limit=1)
        return v

    a.log.version = slow
    a.lease(D(0), HOUR)
    assert a.items().count() == 2 and a.items().select("token").distinct().count() == 2


def test_delta_log(spark, tmp_path):
    log = DeltaLog(spark, str(tmp_path / "t"), ["c", "f"], every=4)
    df = lambda *rows: spark.createDataFrame(list(rows), "c string, f string, x int")
    read = lambda: sorted(((r.c, r.f, r.x) for r in log.read().collect()), key=str)
    assert log.read() is None
    log.commit(lambda old, v: (df(("a", "1", 1), ("a", "2", 2), ("b", "1", 3), (None, None, 4)), None))
    log.commit(lambda old, v: (df(("a", "2", 5), ("a", "2", 6)), df(("a", "2", 0), (None, None, 0))))
    assert read() == [("a", "1", 1), ("a", "2", 5), ("a", "2", 6), ("b", "1", 3)]
    log.commit(lambda old, v: (df(("a", "9", 7)), df(("a", "", 0))), 1)
    assert read() == [("a", "9", 7), ("b", "1", 3)]
    for n in range(4, 14):
        log.commit(lambda old, v: (df(("b", "1", n)), None))
    assert read() == [("a", "9", 7), ("b", "1", 13)] and log.version() == 13
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v=")]) <= 9
    log.commit(lambda old, v: (df(), df()), 0)
    assert read() == []
