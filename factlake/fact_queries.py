"""Registered queries of the fact log: transactions, stores, time, pull and standing queries, over whole tables, each with its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .db import Database, contains_delta
from .operators.temporal import TimeError
from .operators.transact import TransactionError
from .plans.ast import QueryError
from .queries import EVENT_TYPES, datalog, log, register, star
from .sources.frames import facts
from .sources.store import MemoryStore, ParquetStore
from .storage import shared_dir



def wide(sql: str) -> str:
    """SQL over nations and regions whose keys are numbers as the log has them."""
    nation = "(SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation)"
    region = "(SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region)"
    found = re.sub(r"(FROM|JOIN) nation( [ab]\b)?", lambda m: f"{m[1]} {nation}{m[2] or ' nation'}", sql)
    return re.sub(r"(FROM|JOIN) region\b", rf"\1 {region} region", found)


def nations(spark: SparkSession, sf_dir: str) -> tuple[list, list]:
    """All regions and nations; both tables have a fixed size."""
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c).orderBy(c[0]).collect()]
    return read("region", "r_regionkey", "r_name"), read("nation", "n_nationkey", "n_name", "n_regionkey")


def world(spark: SparkSession, sf_dir: str, store: object = None) -> Database:
    """Regions and nations as facts, by maps, temporary ids and lookup references: a region has its name, a nation a key, a name and a region."""
    db = Database(spark, store)
    regions, own = nations(spark, sf_dir)
    db.transact([{":db/id": -1 - k, ":region/key": k, ":region/name": n} for k, n in regions])
    db.transact([{":nation/key": k, ":nation/name": n, ":nation/region": [":region/key", r]} for k, n, r in own])
    return db


def rows(spark: SparkSession, found: Iterable[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(found), schema)


def over(name: str, sql: str, query: str, columns: str, change: Callable[[Database, SparkSession, str], object] = lambda *_: None, **options: object) -> None:
    """Register a query over :func:`world`, after ``change``."""

    def source(spark: SparkSession, sf_dir: str) -> Database:
        db = world(spark, sf_dir)
        change(db, spark, sf_dir)
        return db

    datalog(name, wide(sql), query, columns, source=source, **options)


def made(name: str, sql: str, schema: str, make: Callable[[SparkSession, str], Iterable[tuple]]) -> None:
    """Register what a function over the tables returns as rows."""
    register(name, wide(sql), lambda spark, sf_dir: rows(spark, make(spark, sf_dir), schema))


BY_KEY = "[:find ?k ?n :where [?e :nation/key ?k] [?e :nation/name ?n]]"

# Transactions
over("tx_map", "SELECT n_nationkey AS k, n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey", "[:find ?k ?n ?r :where [?e :nation/key ?k] [?e :nation/name ?n] [?e :nation/region ?g] [?g :region/name ?r]]", "k n r")
over("tx_list_form", "SELECT n_nationkey AS k, concat(n_name, '!') AS n FROM nation", BY_KEY, "k n", lambda db, s, d: db.transact([[":db/add", [":nation/key", k], ":nation/name", n + "!"] for k, n, _ in nations(s, d)[1]]))
over("tx_tempids", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1", "[:find ?a ?b :where [?x :chain/next ?y] [?x :chain/name ?a] [?y :chain/name ?b]]", "a b",
     lambda db, s, d: db.transact([{":db/id": -100 - k, ":chain/name": n, **({":chain/next": -101 - k} if k + 1 < len(nations(s, d)[1]) else {})} for k, n, _ in nations(s, d)[1]]))
over("tx_lookup_refs", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON r_regionkey = (n_regionkey + 1) % 5", "[:find ?n ?r :where [?e :nation/name ?n] [?e :nation/next ?g] [?g :region/name ?r]]", "n r",
     lambda db, s, d: db.transact([[":db/add", [":nation/key", k], ":nation/next", [":region/key", (r + 1) % 5]] for k, _, r in nations(s, d)[1]]))
over("tx_many", "SELECT r_name AS r, n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey", "[:find ?r ?n :where [?g :region/member ?n] [?g :region/name ?r]]", "r n", lambda db, s, d: db.transact([[":db/add", [":region/key", r], ":region/member", n] for _, n, r in nations(s, d)[1]]))
over("tx_set_explode", "SELECT r_name AS r, n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey", "[:find ?r ?n :where [?g :region/set ?n] [?g :region/name ?r]]", "r n", lambda db, s, d: db.transact([{":db/id": [":region/key", k], ":region/set": {n for _, n, r in nations(s, d)[1] if r == k}} for k, _ in nations(s, d)[0]]))
over("tx_retract", "SELECT n_nationkey AS k, n_name AS n FROM nation WHERE n_regionkey <> 0", BY_KEY, "k n", lambda db, s, d: db.transact([[":db/retract", [":nation/key", k], ":nation/name", n] for k, n, r in nations(s, d)[1] if r == 0]))
over("tx_declared_many", "SELECT n_nationkey AS k, n_name AS n FROM nation UNION ALL SELECT n_nationkey, lower(n_name) FROM nation WHERE n_regionkey <> 0", "[:find ?k ?n :where [?e :nation/key ?k] [?e :nation/alias ?n]]", "k n",
     lambda db, s, d: (db.declare(":nation/alias", True), db.transact([[":db/add", [":nation/key", k], ":nation/alias", n] for k, n, _ in nations(s, d)[1]]), db.transact([[":db/add", [":nation/key", k], ":nation/alias", n.lower()] for k, n, _ in nations(s, d)[1]]), db.transact([[":db/retract", [":nation/key", k], ":nation/alias", n.lower()] for k, n, r in nations(s, d)[1] if r == 0])))


def _assoc(spark: SparkSession, sf_dir: str) -> Iterable[tuple]:
    db = world(spark, sf_dir)
    for k, n, _ in nations(spark, sf_dir)[1]:
        db.transact([[":db/assoc", [":nation/key", k], ":nation/info", ":name", n], [":db/assoc", [":nation/key", k], ":nation/extra", ":size", len(n)]])
        db.transact([[":db/assoc", [":nation/key", k], ":nation/info", ":size", len(n)]])
        m = db.entity_by(":nation/key", k)
        yield k, m[":nation/info"][":name"], m[":nation/info"][":size"], m[":nation/extra"][":size"]


made("tx_assoc", "SELECT n_nationkey AS k, n_name AS n, length(n_name) AS size, length(n_name) AS extra FROM nation", "k long, n string, size long, extra long", _assoc)


def _conj(spark: SparkSession, sf_dir: str) -> Iterable[tuple]:
    db = world(spark, sf_dir)
    db.transact([{":db/id": [":region/key", r], ":region/names": []} for r, _ in nations(spark, sf_dir)[0]])
    for _, n, r in nations(spark, sf_dir)[1]:
        db.transact([[":db/conj", [":region/key", r], ":region/names", n]])
    for r, _ in nations(spark, sf_dir)[0]:
        yield r, ",".join(db.entity_by(":region/key", r)[":region/names"])


made("tx_conj", "SELECT n_regionkey AS r, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1", "r long, names string", _conj)


def _deltas(spark: SparkSession, sf_dir: str) -> Iterable[tuple]:
    """Deltas of changed names (one stays as it is), of retractions and their transaction's metadata."""
    db = world(spark, sf_dir)
    out = db.transact({":tx-data": [[":db/add", [":nation/key", k], ":nation/name", n.lower()] if k else [":db/retract", [":nation/key", 0], ":nation/name", n] for k, n, _ in nations(spark, sf_dir)[1]], ":tx-meta": {":tx/user": "u"}})
    for d in out[":deltas"]:
        yield d.entity - 5, d.attribute, d.old_value, d.new_value, d.operation, d.tx[":tx/user"], d.tx[":tx/id"]


made("tx_deltas", "SELECT n_nationkey + 1 AS e, ':nation/name' AS a, n_name AS o, CASE WHEN n_nationkey > 0 THEN lower(n_name) END AS n, CASE WHEN n_nationkey > 0 THEN ':assert' ELSE ':retract' END AS op, 'u' AS by, CAST(3 AS BIGINT) AS tx FROM nation",
     "e long, a string, o string, n string, op string, by string, tx long", _deltas)


def _atomic(spark: SparkSession, sf_dir: str) -> Iterable[tuple]:
    """A transaction with one bad reference changes nothing."""
    db = world(spark, sf_dir)
    try:
        db.transact([{":nation/key": 100, ":nation/name": "NEW"}, [":db/add", [":region/key", 99], ":region/name", "X"]])
    except TransactionError:
        pass
    return [(db.query("[:find ?e :where [?e :nation/key _]]").count(), db.last_tx)]


made("tx_atomic", "SELECT count(*) AS n, CAST(2 AS BIGINT) AS tx FROM nation", "n long, tx long", _atomic)


def _read(spark: SparkSession, sf_dir: str) -> Iterable[tuple]:
    """Entities by id and by value, before and after a change, and the helpers."""
    db = world(spark, sf_dir)
    own = nations(spark, sf_dir)[1]
    out = db.transact([[":db/add", [":nation/key", k], ":nation/name", n.lower()] for k, n, _ in own])
    for k, n, _ in own:
        e = db.entity_by(":nation/name", n.lower())[":db/id"]
        yield k, db.entity(e)[":nation/name"], db.entity(e, 2)[":nation/name"], db.exists(e, ":nation/name", n.lower()), db.exists(e, ":nation/name", n), contains_delta(out[":deltas"], entity=e, old_value=n), db.entity_by(":nation/name", n) is None


made("entity_reads", "SELECT n_nationkey AS k, lower(n_name) AS now, n_name AS old, true AS has, false AS had, true AS told, true AS gone FROM nation", "k long, now string, old string, has boolean, had boolean, told boolean, gone boolean", _read)


# Stores: the event log as Parquet files
def stored(spark: SparkSession, sf_dir: str) -> ParquetStore:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    store = ParquetStore(spark, shared_dir(spark))
    half = events.agg(F.max("event_id")).first()[0] // 2
    for part in (events.where(F.col("event_id") < half), events.where(F.col("event_id") >= half)):
        store.append_frame(facts(part, "user_id", "concat(':user/', event_type)", "double", "value", "event_id + 1", {":time/occurred": "ts"}, "ts"))
    return store


EACH = "SELECT concat(':user/', event_type) AS a, count(*) AS n, round(sum(value), 2) AS s FROM events{} GROUP BY 1"
_each = lambda df: df.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v_double"), 2).alias("s"))


def _changed(change: Callable[[ParquetStore], object], condition: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = stored(spark, sf_dir)
        change(store)
        again = ParquetStore(spark, store.path).scan()
        return _each(again.where(condition) if condition else again)

    return make


register("store_batch_write", EACH.format(""), _changed(lambda s: None))
register("store_range_scan", EACH.format(" WHERE user_id BETWEEN 10 AND 60 AND event_type = 'click'"), _changed(lambda s: None, "a = ':user/click' AND e BETWEEN 10 AND 60"))
register("store_compact", EACH.format(""), _changed(lambda s: s.compact()))
register("store_restore", EACH.format(" WHERE event_id + 1 <= 300"), _changed(lambda s: s.restore(300)))
register("store_delete", EACH.format(" WHERE user_id <> 7 AND NOT (user_id = 8 AND event_type = 'click')"), _changed(lambda s: (s.delete(7), s.delete(8, ":user/click"))))
made("store_point_get", "SELECT user_id AS e, event_type AS a, event_id + 1 AS tx, value AS v FROM events WHERE user_id IN (3, 5) AND event_type IN ('view', 'error')", "e long, a string, tx long, v double",
     lambda spark, d: [(f.e, f.a[6:], f.tx_id, f.v) for fs in stored(spark, d).of([(e, f":user/{a}") for e in (3, 5) for a in ("view", "error")]).values() for f in fs])
register("store_stream_scan", "SELECT row_number() OVER (ORDER BY event_id) AS i, user_id AS e, value AS v FROM events WHERE event_type = 'signup'", lambda spark, d: stored(spark, d).numbered(":user/signup").select("i", "e", F.col("v_double").alias("v")))
made("store_kinds", "SELECT DISTINCT concat(':user/', event_type) AS a, 'double' AS kind, false AS many FROM events", "a string, kind string, many boolean", lambda spark, d: [(a, *k, m) for a, (k, m) in stored(spark, d).attributes().items()])
register("store_query", "SELECT user_id AS e, value AS v FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1", lambda spark, d: Database(spark, stored(spark, d)).query("[:find ?e ?v :where [?e :user/error ?v]]", names=["e", "v"]))


def _listened(spark: SparkSession, sf_dir: str) -> Iterable[tuple]:
    got: list = []
    db = world(spark, sf_dir)
    db.add_listener(lambda _, deltas: got.extend(deltas))
    db.transact([[":db/add", [":nation/key", k], ":nation/code", 10 * k] for k, _, _ in nations(spark, sf_dir)[1]])
    return [(d.attribute, d.new_value) for d in got]


made("change_listener", "SELECT ':nation/code' AS a, CAST(10 * n_nationkey AS BIGINT) AS v FROM nation", "a string, v long", _listened)

# Time
START = datetime(2024, 1, 1, tzinfo=timezone.utc)
DIMS = [
    {":dimension/name": ":time/ordered", ":dimension/type": ":instant"},
    {":dimension/name": ":time/shipped", ":dimension/type": ":instant", ":dimension/constraints": [{":type": ":ordering", ":after": ":time/ordered"}]},
    {":dimension/name": ":time/lead", ":dimension/type": ":duration", ":dimension/derived-from": {":op": ":minus", ":operands": [":time/shipped", ":time/ordered"]}},
]


def shipped(spark: SparkSession, own: list, store: object, gap: Callable[[int], int] = lambda k: k) -> Database:
    """Row k is ordered on day k and, if its time allows, shipped ``gap(k)`` days later, by another database object over the same store."""
    db = Database(spark, store)
    db.transact(DIMS)
    for k, n, *_ in own:
        db.transact([{":db/id": 1000 + k, ":order/name": n}], {":time/ordered": START + timedelta(days=k)})
    db = Database(spark, store)
    for k, n, *_ in own:
        try:
            db.transact([{":db/id": 1000 + k, ":order/sent": n}], {":time/shipped": START + timedelta(days=k + gap(k))})
        except TimeError:
            pass
    return db


def _memory(spark: SparkSession, sf_dir: str) -> Database:
    return shipped(spark, nations(spark, sf_dir)[1], MemoryStore(spark))


datalog("dim_on_transaction", "SELECT n_name AS n, TIMESTAMP '2024-01-01' + to_days(CAST(n_nationkey AS INTEGER)) AS t FROM nation", "[:find ?n ?t :where [_ :order/name ?n :at/ordered ?t]]", "n t", source=_memory, finish=lambda df: df.withColumn("t", F.col("t").cast("timestamp_ntz")))
datalog("derived_dim", "SELECT n_name AS n, CAST(n_nationkey * 86400000 AS BIGINT) AS ms FROM nation", "[:find ?n ?t :where [_ :order/sent ?n :at/lead ?t]]", "n ms", source=_memory)
datalog("ordering_refused", "SELECT r_name AS n FROM region WHERE r_regionkey % 2 = 0", "[:find ?n :where [_ :order/sent ?n]]", "n", source=lambda s, d: shipped(s, nations(s, d)[0], ParquetStore(s, shared_dir(s)), lambda k: 1 if k % 2 == 0 else -1))
made("dimension_list", "SELECT unnest([':time/lead', ':time/ordered', ':time/shipped', ':time/system']) AS name", "name string", lambda s, d: [(x.name,) for x in _memory(s, d).list_dimensions()])


def _checked(spark: SparkSession, sf_dir: str) -> Database:
    """A transaction's own constraint refuses odd nations."""
    db = Database(spark)
    db.transact(DIMS[:1])
    for k, n, _ in nations(spark, sf_dir)[1]:
        try:
            db.transact([{":db/id": 1000 + k, ":order/name": n}], {":time/ordered": START + timedelta(days=k), ":fn": lambda m, k=k: k % 2 == 0 and m[":time/ordered"] >= START})
        except TimeError:
            pass
    return db


datalog("constraint_fn", "SELECT n_name AS n FROM nation WHERE n_nationkey % 2 = 0", "[:find ?n :where [_ :order/name ?n]]", "n", source=_checked)


def late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive in the reverse of the order in which they happened."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    own = events.crossJoin(F.broadcast(events.agg(F.max("event_id").alias("top"))))  # one row
    return facts(own, "user_id", "concat(':user/', event_type)", "double", "value", "top - event_id + 1", {":time/occurred": "ts"})


def _late(spark: SparkSession, sf_dir: str) -> Database:
    from .sources.frames import FrameStore

    db = Database(spark, FrameStore(spark, late(spark, sf_dir), {f":user/{t}": "double" for t in EVENT_TYPES}))
    db.dimensions.define({":dimension/name": ":time/occurred"})
    return db


datalog("late_event", "SELECT user_id AS e, value AS v FROM events WHERE event_type = 'purchase' AND ts <= TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1", '{:query [:find ?e ?v :where [?e :user/purchase ?v]] :as-of {:time/occurred #inst "2024-01-15"}}', "e v", source=_late)


def _corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known of each nation at each transaction, before and after all were corrected for the same day."""
    db = Database(spark)
    db.transact(DIMS[:1])
    own = nations(spark, sf_dir)[1]
    first = db.transact([{":db/id": 1000 + k, ":order/name": n} for k, n, _ in own], {":time/ordered": START})[":tx-id"]
    then = db.transact([{":db/id": 1000 + k, ":order/name": n.lower()} for k, n, _ in own], {":time/ordered": START})[":tx-id"]
    q = "[:find ?e ?n :where [?e :order/name ?n]]"
    was, now = (db.query(q, as_of={":tx": t, ":time/ordered": START}, names=["e", c]) for t, c in ((first, "was"), (then, "now")))
    return was.join(now, "e").select((F.col("e") - 1000).alias("k"), "was", "now")


register("bitemporal", wide("SELECT n_nationkey AS k, n_name AS was, lower(n_name) AS now FROM nation"), _corrected)
datalog("two_time_patterns", "SELECT p.user_id AS e, max(date_diff('millisecond', s.ts, p.ts)) AS ms FROM events p JOIN events s ON s.user_id = p.user_id AND s.event_type = 'signup' WHERE p.event_type = 'error' AND p.ts > s.ts GROUP BY 1",
        "[:find ?e (max ?ms) :where [?e :user/error ?x :at/occurred ?p] [?e :user/signup ?y :at/occurred ?s] [(> ?p ?s)] [(- ?p ?s) ?ms]]", "e ms", source=log)

# Patterns, predicates and rules that the other rows leave out
datalog("list_form_binding", "SELECT c_custkey AS c, true AS rich FROM customer WHERE c_acctbal >= 5000", "[:find ?c ?rich :where [?c :customer/c_acctbal ?a] (>= ?a 5000 ?rich)]", "c rich")
datalog("list_form_arith", "SELECT p_partkey AS p, CAST(p_size + 1 AS BIGINT) AS x FROM part", "[:find ?p ?x :where [?p :part/p_size ?s] (+ ?s 1 ?x)]", "p x")
datalog("not_equal", "SELECT o_orderkey AS o FROM orders WHERE o_orderstatus <> 'F'", '[:find ?o :where [?o :orders/o_orderstatus ?s] [(!= ?s "F")]]', "o")
datalog("at_most", "SELECT o_orderkey AS o FROM orders WHERE o_totalprice <= 50000", "[:find ?o :where [?o :orders/o_totalprice ?t] [(<= ?t 50000)]]", "o")
datalog("intersection", "SELECT o_orderkey AS o FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49", '[:find ?o :where [?o :orders/o_orderstatus "F"] [?l :lineitem/l_orderkey ?o] [?l :lineitem/l_quantity ?q] [(>= ?q 49)]]', "o")
datalog("true_triangle", "SELECT DISTINCT n_nationkey AS n, s_suppkey AS s, c_custkey AS c FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey AND l_suppkey = s_suppkey",
        "[:find ?n ?s ?c :where [?s :supplier/s_nationkey ?n] [?c :customer/c_nationkey ?n] [?o :orders/o_custkey ?c] [?l :lineitem/l_orderkey ?o] [?l :lineitem/l_suppkey ?s]]", "n s c")
RICH = "[[(rich ?x) [?x :customer/c_acctbal ?a] [(>= ?a 5000)]]]"
datalog("rule_in_or", "SELECT c_custkey AS c FROM customer WHERE c_acctbal >= 5000 OR c_mktsegment = 'MACHINERY'", '[:find ?c :in $ % :where (or (rich ?c) [?c :customer/c_mktsegment "MACHINERY"])]', "c", RICH)
datalog("rule_in_not", "SELECT c_custkey AS c FROM customer WHERE c_acctbal < 5000", "[:find ?c :in $ % :where [?c :customer/c_name _] (not (rich ?c))]", "c", RICH)
datalog("scalar_input", "SELECT c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING'", "[:find ?c :in $ ?seg :where [?c :customer/c_mktsegment ?seg]]", "c", inputs={"seg": "BUILDING"})


def _refused(spark: SparkSession, sf_dir: str) -> Iterable[tuple]:
    """Queries that must be refused, with the class of the refusal."""
    db = star(spark, sf_dir)
    for name, q in (("variable attribute", "[:find ?a :where [1 ?a _]]"), ("unbound variable", "[:find ?z :where [?c :customer/c_name ?n]]"), ("unknown function", "[:find ?c :where [?c :customer/c_name ?n] [(frobnicate ?n)]]"), ("no clause", "[:where [?c :customer/c_name _]]")):
        try:
            db.query(q).count()
            yield name, False
        except QueryError:
            yield name, True


made("refusals", "SELECT unnest(['variable attribute', 'unbound variable', 'unknown function', 'no clause']) AS q, true AS refused", "q string, refused boolean", _refused)

# Pull
datalog("pull_star", "SELECT n_nationkey AS k, n_name AS n, CAST(n_regionkey AS VARCHAR) AS r FROM nation", "[:find (pull ?e [*]) :where [?e :nation/n_name _]]", "p", source=lambda s, d: _one_table(s, d),
        finish=lambda df: df.select(F.col("p").getField(":db/id").alias("k"), F.col("p").getField("*")[":nation/n_name"].alias("n"), F.col("p").getField("*")[":nation/n_regionkey"].alias("r")))


def _one_table(spark: SparkSession, sf_dir: str) -> Database:
    db = Database(spark)
    db.map_table("nation", spark.read.parquet(f"{sf_dir}/nation.parquet"), "n_nationkey")
    return db


def pulled(name: str, sql: str, pattern: str, shape: Callable[[DataFrame], DataFrame], of: str = "[?r :region/r_name _]") -> None:
    register(name, sql, lambda spark, d: shape(star(spark, d).query(f"[:find (pull ?r {pattern}) :where {of}]", names=["p"]).select("p.*")))


_names = lambda a, b: F.array_join(F.sort_array(F.transform(F.col(f"`{a}`"), lambda x: x.getField(b))), ",")
pulled("pull_reverse_nested", "SELECT n_regionkey AS r, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1", "[{:nation/_n_regionkey [:nation/n_name]}]", lambda df: df.select(F.col("`:db/id`").alias("r"), _names(":nation/_n_regionkey", ":nation/n_name").alias("names")))
pulled("pull_limit", "SELECT n_regionkey AS r, CAST(least(2, count(*)) AS BIGINT) AS n FROM nation GROUP BY 1", "[{:nation/_n_regionkey [:nation/n_name] :limit 2}]", lambda df: df.select(F.col("`:db/id`").alias("r"), F.size("`:nation/_n_regionkey`").cast("long").alias("n")))
pulled("pull_three_deep", "SELECT o_orderkey AS o, r_name AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
       "[{:orders/o_custkey [{:customer/c_nationkey [{:nation/n_regionkey [:region/r_name]}]}]}]", lambda df: df.select(F.col("`:db/id`").alias("o"), F.col("`:orders/o_custkey`").getField(":customer/c_nationkey").getField(":nation/n_regionkey").getField(":region/r_name").alias("r")), "[?r :orders/o_custkey _]")


# Standing queries
def told(spark: SparkSession, sf_dir: str, query: str, **options: object) -> list[tuple]:
    """What a subscription delivers while nations are renamed region by region, then retracted: number, sign and values."""
    got: list = []
    db = world(spark, sf_dir)
    s = db.subscribe(query, callback=got.append, **options)
    for r, _ in nations(spark, sf_dir)[0]:
        db.transact([[":db/add", [":nation/key", k], ":nation/name", n.lower()] for k, n, g in nations(spark, sf_dir)[1] if g == r])
    db.transact([[":db/retract", [":nation/key", k], ":nation/name", n.lower()] for k, n, g in nations(spark, sf_dir)[1] if g == 0])
    s.stop()
    db.transact([[":db/add", [":nation/key", 0], ":nation/name", "unheard"]])
    return got


def _flat(diffs: list) -> list[tuple]:
    return [(i, sign, *row) for i, d in enumerate(diffs) for sign, own in ((1, d.additions), (-1, d.retractions)) for row in own]


TOLD = "SELECT CAST({0} AS BIGINT) AS i, CAST({1} AS BIGINT) AS sign, n_nationkey AS k, {2} AS n FROM nation"
DIFFS = " UNION ALL ".join([TOLD.format("0", "1", "n_name"), TOLD.format("n_regionkey + 1", "1", "lower(n_name)"), TOLD.format("n_regionkey + 1", "-1", "n_name"), TOLD.format("6", "-1", "lower(n_name)") + " WHERE n_regionkey = 0"])
made("subscribe_diffs", DIFFS, "i long, sign long, k long, n string", lambda s, d: _flat(told(s, d, BY_KEY)))
made("subscribe_transform", f"SELECT i, count(*) FILTER (WHERE sign > 0) AS plus, count(*) FILTER (WHERE sign < 0) AS minus FROM ({DIFFS}) x GROUP BY 1", "i long, plus long, minus long",
     lambda s, d: [(i, *x) for i, x in enumerate(told(s, d, BY_KEY, transform=lambda x: (len(x.additions), len(x.retractions))))])
made("subscribe_negation", "SELECT CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS sign, n_nationkey AS k FROM nation WHERE false UNION ALL SELECT 6, 1, n_nationkey FROM nation WHERE n_regionkey = 0", "i long, sign long, k long",
     lambda s, d: [(6, *x[1:]) for x in _flat(told(s, d, "[:find ?k :where [?e :nation/key ?k] (not [?e :nation/name _])]"))])


def _queued(spark: SparkSession, sf_dir: str) -> Iterable[tuple]:
    """Through a queue, with a watched dimension: only transactions that have it are delivered."""
    db = world(spark, sf_dir)
    db.transact(DIMS[:1])
    s = db.subscribe(BY_KEY, delivery="queue", watch_dimensions=[":time/ordered"])
    for k, n, r in nations(spark, sf_dir)[1]:
        db.transact([[":db/add", [":nation/key", k], ":nation/name", n.lower()]], {":time/ordered": START} if r == 0 else None)
    found = []
    while not s.queue.empty():
        found.append(s.queue.get())
    return [(k, n) for d in found[1:] for k, n in d.additions]


made("subscribe_queue_watch", "SELECT n_nationkey AS k, lower(n_name) AS n FROM nation WHERE n_regionkey = 0", "k long, n string", _queued)
