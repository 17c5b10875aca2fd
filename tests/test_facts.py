"""Transactions, points in time, dimensions and pull, on small logs."""

from datetime import datetime, timezone

import pytest

from factlake.db import Database, contains_delta, entity_id_by
from factlake.operators.temporal import TimeError
from factlake.operators.transact import TransactionError
from factlake.plans.ast import QueryError
from factlake.sources.store import MemoryStore, ParquetStore


def rows(df):
    return {tuple(r) for r in df.collect()}


def day(n, month=1):
    return datetime(2024, month, n, tzinfo=timezone.utc)


@pytest.fixture
def db(spark):
    return Database(spark)


def test_maps_tempids_and_refs(db):
    out = db.transact([{":db/id": -1, ":user/name": "Alice"}, {":user/name": "Bob", ":user/boss": -1}, [":db/add", -2, ":user/name", "Carol"], [":db/add", -2, ":user/boss", -1]])
    assert out[":tx-id"] == 1 and len(out[":deltas"]) == 5
    assert contains_delta(out[":deltas"], attribute=":user/name", new_value="Alice", operation=":assert", old_value=None)
    alice = entity_id_by(db, ":user/name", "Alice")
    assert rows(db.query("[:find ?n :where [?e :user/boss ?b] [?b :user/name \"Alice\"] [?e :user/name ?n]]")) == {("Bob",), ("Carol",)}
    db.transact([[":db/add", [":user/name", "Bob"], ":user/age", 41], {":user/name": "Dan", ":user/boss": [":user/name", "Bob"]}])
    assert db.entity_by(":user/name", "Bob") == {":db/id": 2, ":user/name": "Bob", ":user/boss": alice, ":user/age": 41}
    with pytest.raises(TransactionError, match="Lookup ref not found"):
        db.transact([[":db/add", [":user/name", "Nobody"], ":user/age", 1]])
    assert db.last_tx == 2


def test_latest_value_and_travel(db):
    for age in (30, 31, 32):
        db.transact([[":db/add", 1, ":user/age", age]])
    assert [db.entity(1, t)[":user/age"] for t in (1, 2, 3)] == [30, 31, 32]
    assert rows(db.query("[:find ?v :where [1 :user/age ?v]]")) == {(32,)}
    assert rows(db.query("[:find ?e :where [?e :user/age 30]]")) == set()
    assert rows(db.query("[:find ?v :where [1 :user/age ?v]]", as_of={":tx": 2})) == {(31,)}
    db.transact([[":db/retract", 1, ":user/age", 32]])
    assert db.entity(1) is None and rows(db.query("[:find ?e ?v :where [?e :user/age ?v]]")) == set()
    assert db.entity(1, 3)[":user/age"] == 32


def test_collections(db):
    db.transact([{":db/id": 1, ":user/roles": {":admin", ":dev"}, ":list/items": ["a"], ":config": {":x": 1}}])
    db.transact([[":db/add", 1, ":user/roles", ":ops"], [":db/conj", 1, ":list/items", "b"], [":db/assoc", 1, ":config", ":y", 2]])
    assert db.entity(1) == {":db/id": 1, ":user/roles": frozenset({":admin", ":dev", ":ops"}), ":list/items": ["a", "b"], ":config": {":x": 1, ":y": 2}}
    out = db.transact([[":db/retract", 1, ":user/roles", ":dev"]])
    assert out[":deltas"][0].retracted == (":dev",)
    assert rows(db.query("[:find ?r :where [1 :user/roles ?r]]")) == {(":admin",), (":ops",)}


def test_several_values_in_one_transaction(db):
    db.transact([[":db/add", 1, ":friend", 2000], [":db/add", 1, ":friend", 3000]])
    assert rows(db.query("[:find ?f :where [1 :friend ?f]]")) == {(2000,), (3000,)}
    assert db.entity(1)[":friend"] == frozenset({2000, 3000})


def test_a_later_many_does_not_revive_replaced_values(db):
    db.transact([[":db/add", 1, ":status", ":new"]])
    db.transact([[":db/add", 1, ":status", ":old"]])
    db.transact([[":db/add", 2, ":status", ":a"], [":db/add", 2, ":status", ":b"]])
    assert rows(db.query("[:find ?s :where [1 :status ?s]]")) == {(":old",)}


def test_metadata_and_listeners(db):
    seen = []
    db.add_listener(lambda d, deltas: seen.append(len(deltas)))
    db.add_listener(lambda d, deltas: 1 / 0)
    out = db.transact({":tx-data": [{":a": 1}], ":tx-meta": {":by": "me"}})
    assert seen == [1] and out[":deltas"][0].tx[":by"] == "me"


DIMENSIONS = '[{:dimension/name :time/ordered :dimension/type :instant} {:dimension/name :time/shipped :dimension/type :instant :dimension/constraints [{:type :ordering :after :time/ordered}]}]'


def test_dimensions(db):
    db.transact(DIMENSIONS)
    db.transact([{":order/id": "A"}], time_dimensions={":time/ordered": day(1)})
    db.transact([[":db/add", [":order/id", "A"], ":order/status", ":shipped"]], time_dimensions={":time/shipped": day(3)})
    with pytest.raises(TimeError):
        db.transact([[":db/add", [":order/id", "A"], ":order/status", ":lost"]], time_dimensions={":time/shipped": day(1).replace(year=2023)})
    with pytest.raises(TimeError, match="unknown"):
        db.transact([{":a": 1}], time_dimensions={":time/none": day(1)})
    with pytest.raises(TimeError, match="cannot be set"):
        db.transact([{":a": 1}], time_dimensions={":time/system": day(1)})
    q = "[:find ?s :where [?o :order/id \"A\"] [?o :order/status ?s]]"
    assert rows(db.query(q, as_of={":time/shipped": day(2)})) == set()
    assert rows(db.query(q, as_of={":time/shipped": day(4)})) == {(":shipped",)}
    late = '[:find ?ms :where [?o :order/id _ :at/ordered ?t1] [?o :order/status _ :at/shipped ?t2] [(- ?t2 ?t1) ?ms]]'
    assert rows(db.query(late)) == {(2 * 86_400_000,)}
    with pytest.raises(TimeError):
        db.query(q, as_of={":time/none": day(1)})


def test_series_and_derived(db):
    db.transact('[{:dimension/name :time/a :dimension/type :instant} {:dimension/name :time/b :dimension/type :instant} {:dimension/name :time/ab :dimension/type :duration :dimension/derived-from {:op :minus :operands [:time/b :time/a]}}]')
    out = db.transact([{":db/id": 9, ":x": 1.5}], time_dimensions={":time/a": day(1), ":time/b": day(5)})
    assert out[":deltas"][0].dims[":time/ab"] == 345_600_000
    db.transact([{":db/id": 9, ":x": 2.5}], time_dimensions={":time/a": day(2)})
    assert {r[0] for r in db.query("[:find ?v ?t :where [9 :x ?v :at/a ?t]]").collect()} == {1.5, 2.5}
    assert rows(db.query("[:find ?v :where [9 :x ?v]]", as_of={":time/a": day(1)})) == {(1.5,)}


def test_pull(db):
    db.transact([{":db/id": 1, ":user/name": "Alice"}, {":db/id": 2, ":user/name": "Bob", ":user/manager": 1}, {":db/id": 3, ":user/name": "Carol", ":user/manager": 1}, {":db/id": 4, ":post/title": "x"}, {":db/id": 5, ":post/title": "y"}])
    db.transact([[":db/add", 2, ":user/posts", [4, 5]]])
    got = db.pull(2, "[:user/name {:user/manager [:user/name :user/_manager]} {:user/posts [:post/title] :limit 1} :user/none]").first()["pulled"].asDict(True)
    assert got == {":db/id": 2, ":user/name": "Bob", ":user/manager": {":db/id": 1, ":user/name": "Alice", ":user/_manager": [2, 3]}, ":user/posts": [{":db/id": 4, ":post/title": "x"}], ":user/none": None}
    assert db.pull(1, "[*]").first()["pulled"]["*"] == {":user/name": "Alice"}
    back = db.pull([1, 7], "[{:user/_manager [:user/name]}]").collect()
    assert {r["id"]: [x[":user/name"] for x in r["pulled"][":user/_manager"] or []] for r in back} == {1: ["Bob", "Carol"], 7: []}
    found = db.query("[:find ?n (pull ?e [:user/name]) :where [?e :user/manager 1] [?e :user/name ?n]]").collect()
    assert {(r[0], r[1][":user/name"]) for r in found} == {("Bob", "Bob"), ("Carol", "Carol")}


@pytest.mark.parametrize("compression", ["none", "zstd"])
def test_parquet_store(spark, tmp_path, compression):
    db = Database(spark, ParquetStore(spark, f"file://{tmp_path}/db", compression=compression))
    db.transact([{":db/id": 7, ":name": "a", ":tags": {"x", "y"}}])
    snap = db.store.snapshot()
    db.transact([{":db/id": 7, ":name": "b"}, {":name": "c"}])
    again = Database(spark, ParquetStore(spark, f"file://{tmp_path}/db"))
    assert (again.last_tx, again.last_entity) == (2, 8)
    assert again.entity(7) == {":db/id": 7, ":name": "b", ":tags": frozenset({"x", "y"})}
    again.store.compact()
    assert rows(again.query("[:find ?e ?n :where [?e :name ?n]]")) == {(7, "b"), (8, "c")}
    assert [f.v for f in again.store.stream(":name")] == ["a", "a", "b", "c"]
    again.store.restore(snap)
    assert rows(again.query("[:find ?e ?n :where [?e :name ?n]]")) == {(7, "a")}


def test_memory_snapshot(spark):
    db = Database(spark, MemoryStore(spark))
    db.transact([{":db/id": 1, ":n": 1}])
    s = db.store.snapshot()
    db.transact([{":db/id": 1, ":n": 2}])
    db.store.restore(s)
    assert db.entity(1) == {":db/id": 1, ":n": 1}


def test_string_entities(spark):
    db = Database(spark, entity="string")
    db.transact([[":db/add", "ord-1", ":total", 5], {":total": 7}])
    assert rows(db.query("[:find ?e :where [?e :total 5]]")) == {("ord-1",)}
    with pytest.raises(TransactionError):
        Database(spark).transact([[":db/add", "ord-1", ":total", 5]])


def test_unlike_types_and_unknown_functions(db):
    db.transact([{":name": "Ivan", ":age": 15}, {":name": "Petr", ":age": 37}])
    assert rows(db.query('[:find ?n :where [?e :name ?n] [(> ?n 3)]]')) == set()
    assert rows(db.query('[:find ?n :where [?e :name ?n] [?e :age "x"]]')) == set()
    for bad in ("[:find ?n :where [?e :name ?n] [(nope ?n)]]", "[:find ?x :where [?e :name ?n]]", "[:find ?n :where [?e :name ?n] [(> ?m 1)]]"):
        with pytest.raises(QueryError):
            db.query(bad)


def test_a_streaming_scan_is_numbered_without_the_driver(spark, tmp_path, monkeypatch):
    from factlake.sources.frames import facts
    from factlake.sources.store import Store

    store = ParquetStore(spark, f"{tmp_path}/s")
    own = spark.range(0, 500, 1, 7).selectExpr("id", "(id * 37) % 500 AS at")
    for part in (own.where("id < 300"), own.where("id >= 300")):
        store.append_frame(facts(part, "id", "concat(':x/', at % 2)", "double", "double(at)", "at + 1"))
    got = {r["i"]: (r["e"], r["v_double"]) for r in store.numbered(":x/1").collect()}
    assert got == {i: (f.e, f.v) for i, f in enumerate(store.stream(":x/1"), 1)} and len(got) == 250
    assert [store.numbered(a).count() for a in (None, ":x/2")] == [500, 0]
    # the registered query takes it so
    monkeypatch.setattr(Store, "stream", lambda *_: pytest.fail("rows pass the driver"))
    from factlake import fact_queries, queries  # noqa: F401

    found = queries.QUERIES["store_stream_scan"](spark, "/root/testdata/sf0.001")
    assert sorted(r["i"] for r in found.select("i").collect()) == list(range(1, found.count() + 1))
