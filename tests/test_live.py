"""Standing queries: exact sequences of diffs, and maintained results against computed ones."""

from datetime import datetime, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from factlake.db import Database
from factlake.plans import ast
from factlake.streaming.live import LiveView, Log
from factlake.streaming.micro_batch import maintain
from factlake.streaming.zset import ZSet


def run(spark, query, script, **options):
    db, seen = Database(spark), []
    sub = db.subscribe(query, callback=lambda d: seen.append((set(d.additions), set(d.retractions))), **options)
    for tx in script:
        db.transact(tx) if isinstance(tx, (list, str)) else db.transact(tx[":data"], time_dimensions=tx[":dims"])
    return db, sub, seen


def test_names(spark):
    _, sub, seen = run(spark, "[:find ?e ?name :where [?e :user/name ?name]]", [[{":db/id": 1, ":user/name": "Alice"}], [{":db/id": 2, ":user/name": "Bob"}], [[":db/add", 1, ":user/name", "Alice Smith"]], [[":db/add", 1, ":other", 1]]])
    assert seen == [(set(), set()), ({(1, "Alice")}, set()), ({(2, "Bob")}, set()), ({(1, "Alice Smith")}, {(1, "Alice")})]
    assert sub.results() == {(1, "Alice Smith"), (2, "Bob")}


def test_filter_aggregate_and_closure(spark):
    _, _, seen = run(spark, "[:find ?c (sum ?t) :where [?o :c ?c] [?o :t ?t]]", [[{":c": 1, ":t": 100}], [{":c": 1, ":t": 50}]])
    assert seen[1:] == [({(1, 100)}, set()), ({(1, 150)}, {(1, 100)})]
    _, _, seen = run(spark, "[:find ?o ?t :where [?o :t ?t] [(> ?t 1000)]]", [[{":db/id": 1, ":t": 50}], [{":db/id": 1, ":t": 5000}], [{":db/id": 1, ":t": 500}]])
    assert seen[1:] == [({(1, 5000)}, set()), (set(), {(1, 5000)})]
    _, _, seen = run(spark, "[:find ?x :where [?x :boss+ 1]]", [[[":db/add", 2, ":boss", 1], [":db/add", 3, ":boss", 2]], [[":db/add", 3, ":boss", 1]]])
    assert seen[1:] == [({(2,), (3,)}, set())]


def test_watch_transform_and_queue(spark):
    db, seen = Database(spark), []
    db.transact("[{:dimension/name :time/shipped :dimension/type :instant} {:dimension/name :time/delivered :dimension/type :instant}]")
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    sub = db.subscribe("[:find ?s :where [?o :s ?s]]", delivery="queue", watch_dimensions=[":time/shipped"], transform=lambda d: (sorted(d.additions), sorted(d.retractions)))
    db.transact([{":db/id": 9, ":s": 1}], time_dimensions={":time/shipped": now})
    db.transact([{":db/id": 9, ":s": 2}], time_dimensions={":time/delivered": now})
    db.transact([{":db/id": 9, ":z": 2}], time_dimensions={":time/shipped": now})
    while not sub.queue.empty():
        seen.append(sub.queue.get())
    assert seen == [([], []), ([(1,)], []), ([], [])] and sub.results() == {(2,)}
    sub.stop()
    db.transact([{":db/id": 9, ":s": 3}], time_dimensions={":time/shipped": now})
    assert sub.queue.empty()


QUERY = "[:find ?g (count ?x) (sum ?v) (median ?v) (max ?v) :where [?x :g ?g] [?x :v ?v] [(> ?v 2)]]"


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 1), st.integers(0, 9)), min_size=1, max_size=5), min_size=1, max_size=3))
def test_maintained_equals_computed(spark, script):
    view, held = LiveView(ast.parse(QUERY)), {}
    shape = "e long, v long, mult long"
    for batch in script:
        g, v = [], []
        for e, grp, val in batch:
            if e in held:
                g.append((e, held[e][0], -1)), v.append((e, held[e][1], -1))
            held[e] = (grp, val)
            g.append((e, grp, 1)), v.append((e, val, 1))
        view.apply({":g": spark.createDataFrame(g, shape), ":v": spark.createDataFrame(v, shape)})
        db = Database(spark)
        db.map_table("t", spark.createDataFrame([(e, a, b) for e, (a, b) in held.items()], "id long, g long, v long"), "id")
        want = db.query(QUERY.replace(":g", ":t/g").replace(":v ", ":t/v "))
        assert {tuple(r) for r in view.result().collect()} == {tuple(r) for r in want.collect()}


def test_zset(spark):
    a = ZSet.of(spark.createDataFrame([(1,), (1,), (2,)], "x long"))
    b = ZSet.of(spark.createDataFrame([(1,), (3,)], "x long"), -1)
    assert {tuple(r) for r in (a + b).consolidate().df.collect()} == {(1, 1), (2, 1), (3, -1)}
    assert {tuple(r) for r in (a + b).distinct().df.collect()} == {(1, 1), (2, 1)}
    assert sorted(r[0] for r in a.values().collect()) == [1, 1, 2]
    add, gone = (a + b).diff()
    assert {r[0] for r in add.collect()} == {1, 2} and {r[0] for r in gone.collect()} == {3}
    assert (a - a).consolidate().df.isEmpty()


def test_micro_batches(spark, tmp_path):
    shape = "e long, a string, s string, n double, mult long"
    for i, data in enumerate([[(1, ":k", "x", None, 1), (1, ":n", None, 5.0, 1)], [(2, ":k", "x", None, 1), (2, ":n", None, 7.0, 1)], [(1, ":n", None, 5.0, -1)]]):
        spark.createDataFrame(data, shape).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{i}")
    seen = []
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    q, view = maintain(stream, "[:find ?k (sum ?n) :where [?e :k ?k] [?e :n ?n]]", {":k": "s", ":n": "n"}, lambda z, i: seen.append({tuple(r) for r in z.df.collect()}), f"{tmp_path}/checkpoint", ["k", "n"])
    q.awaitTermination(120)
    assert {tuple(r) for r in view.result().collect()} == {("x", 7.0)} and len(seen) == 3


@pytest.mark.parametrize("delivery", ["manifold", "callback"])
def test_bad_delivery(spark, delivery):
    with pytest.raises(ValueError):
        Database(spark).subscribe("[:find ?e :where [?e :a 1]]", delivery=delivery)


def test_restart_goes_on_from_written_state(spark, tmp_path):
    shape, seen = "e long, a string, s string, n double, mult long", []
    for data in ([(1, ":k", "x", None, 1), (1, ":n", None, 5.0, 1)], [(2, ":k", "x", None, 1), (2, ":n", None, 7.0, 1), (1, ":n", None, 5.0, -1), (1, ":n", None, 6.0, 1)]):
        spark.createDataFrame(data, shape).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema(shape).json(f"{tmp_path}/in")
        q, view = maintain(stream, "[:find ?k (sum ?n) (max ?n) :where [?e :k ?k] [?e :n ?n]]", {":k": "s", ":n": "n"}, lambda z, i: seen.append((i, {tuple(r) for r in z.df.collect()})), f"{tmp_path}/checkpoint", ["k", "n", "m"])
        q.awaitTermination(120)
    assert seen == [(0, {("x", 5.0, 5.0, 1)}), (1, {("x", 5.0, 5.0, -1), ("x", 13.0, 7.0, 1)})]
    assert {tuple(r) for r in view.result().collect()} == {("x", 13.0, 7.0)}


@pytest.mark.parametrize("query", ["[:find ?g (count ?x) (sum ?v) :where [?x :g ?g] [?x :v ?v]]", "[:find ?g (median ?v) (max ?v) :where [?x :g ?g] [?x :v ?v]]", "[:find ?g ?v :where [?x :g ?g] [?x :v ?v]]"])
def test_large_changes_look_nothing_up_row_by_row(spark, monkeypatch, query):
    shape = "e long, v long, mult long"
    script = [[(e, 1) for e in range(0, 30)], [(e, 1) for e in range(20, 50)], [(e, -1) for e in range(10, 40)] + [(99, 1)]]
    own, seen = Log.near, []
    monkeypatch.setattr(Log, "near", lambda self, keys, cols, table=None: seen.append(keys.count()) or own(self, keys, cols, table))

    def told(small):
        monkeypatch.setattr("factlake.streaming.live.SMALL", small)
        view, out = LiveView(ast.parse(query)), []
        for batch in script:
            z = view.apply({a: spark.createDataFrame([(e, f(e), m) for e, m in batch], shape) for a, f in ((":g", lambda e: e % 3), (":v", lambda e: None if e == 99 else e % 5))})
            out.append({tuple(r) for r in z.df.collect() if r["mult"]})
        return out, {tuple(r) for r in view.result().collect()}

    few = told(5_000)
    seen.clear()
    assert told(4) == few
    assert max(seen, default=0) <= 4
