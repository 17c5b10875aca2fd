"""Registered queries: Datalog over the star schema and the event log, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .db import Database
from .sources.frames import FrameStore, facts
from .streaming.live import LiveView
from .plans import ast

#: Table and entity key; None: rows have no key.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None}
EVENT_TYPES = ("view", "click", "purchase", "signup", "error")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def star(spark: SparkSession, sf_dir: str) -> Database:
    """The star schema's tables as attributes, and ``:part/parent``, half a part's number."""
    db = Database(spark)
    for name, key in KEYS.items():
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "part":
            df = df.withColumn("parent", F.when(F.col("p_partkey") > 0, F.expr("p_partkey div 2")))
        db.map_table(name, df, key)
    return db


def log(spark: SparkSession, sf_dir: str) -> Database:
    """The events as a log: event n is transaction n + 1, in which user ``e`` gets ``:user/<type>``; ``:time/occurred`` is when."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    own = facts(events, "user_id", "concat(':user/', event_type)", "double", "value", "event_id + 1", {":time/occurred": "ts"})
    db = Database(spark, FrameStore(spark, own, {f":user/{t}": "double" for t in EVENT_TYPES}))
    db.dimensions.define({":dimension/name": ":time/occurred"})
    return db


def register(name: str, sql: str | None, make: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = make
    if sql is not None:
        ORACLE_SQL[name] = sql


def datalog(name: str, sql: str | None, query: str, columns: str, rules: str | None = None, source: Callable = star, finish: Callable[[DataFrame], DataFrame] | None = None, **options: object) -> None:
    """Register a query by its text; ``finish`` formats the result for comparison."""

    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = source(spark, sf_dir).query(query, rules, names=columns.split(), **options)
        return finish(df) if finish else df

    register(name, sql, make)


def rounded(**digits: int) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({c: F.round(c, n) for c, n in digits.items()})


# Patterns and projections
datalog("simple_find", "SELECT DISTINCT c_name AS name FROM customer", "[:find ?n :where [?c :customer/c_name ?n]]", "name")
datalog("const_value", "SELECT c_custkey AS c FROM customer WHERE c_mktsegment = 'MACHINERY'", '[:find ?c :where [?c :customer/c_mktsegment "MACHINERY"]]', "c")
datalog("const_entity", "SELECT c_name AS name FROM customer WHERE c_custkey = 7", "[:find ?n :where [7 :customer/c_name ?n]]", "name")
datalog("all_const", "SELECT DISTINCT 1 AS one FROM region WHERE r_regionkey = 0 AND r_name = 'AFRICA'", '[:find 1 :where [0 :region/r_name "AFRICA"]]', "one", finish=lambda df: df.select(F.col("one").cast("int").alias("one")))
datalog("wildcard", "SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderstatus IS NOT NULL", "[:find ?c :where [?o :orders/o_custkey ?c] [?o :orders/o_orderstatus _]]", "c")
datalog("set_projection", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders", "[:find ?s ?p :where [?o :orders/o_orderstatus ?s] [?o :orders/o_orderpriority ?p]]", "s p")

# Predicates and functions
datalog("pred_filter", "SELECT o_orderkey AS o, o_totalprice AS t FROM orders WHERE o_totalprice > 400000", "[:find ?o ?t :where [?o :orders/o_totalprice ?t] [(> ?t 400000)]]", "o t")
datalog("pred_two_vars", "SELECT DISTINCT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > s_acctbal", "[:find ?c ?s :where [?c :customer/c_nationkey ?n] [?s :supplier/s_nationkey ?n] [?c :customer/c_acctbal ?a] [?s :supplier/s_acctbal ?b] [(> ?a ?b)]]", "c s")
datalog("bind_arith", "SELECT o_orderkey AS o, round(o_totalprice * 2 + 1, 2) AS x FROM orders", "[:find ?o ?x :where [?o :orders/o_totalprice ?t] [(* ?t 2) ?d] [(+ ?d 1) ?x]]", "o x", finish=rounded(x=2))
datalog("bind_bool", "SELECT c_custkey AS c, c_acctbal >= 5000 AS rich FROM customer", "[:find ?c ?rich :where [?c :customer/c_acctbal ?a] [(>= ?a 5000) ?rich]]", "c rich")
datalog("bind_list_form", "SELECT c_custkey AS c, true AS rich FROM customer WHERE c_acctbal >= 5000", "[:find ?c ?rich :where [?c :customer/c_acctbal ?a] [(>= ?a 5000) ?rich] (true? ?rich)]", "c rich")
datalog("find_expr", "SELECT DISTINCT p_partkey AS p, CAST(p_size - 1 AS BIGINT) AS d FROM part", "[:find ?p (- ?s 1) :where [?p :part/p_size ?s]]", "p d")
datalog("int_math", "SELECT p_partkey AS p, CAST(((p_size % 7) + 7) % 7 AS BIGINT) AS m, CAST(p_size // 7 AS BIGINT) AS q, CAST(p_size % 7 AS BIGINT) AS r, CAST(p_size + 1 AS BIGINT) AS i, CAST(p_size - 1 AS BIGINT) AS d, CAST(greatest(p_size, 10) AS BIGINT) AS mx, CAST(least(p_size, 10) AS BIGINT) AS mn FROM part", "[:find ?p ?m ?q ?r ?i ?d ?mx ?mn :where [?p :part/p_size ?s] [(mod ?s 7) ?m] [(quot ?s 7) ?q] [(rem ?s 7) ?r] [(inc ?s) ?i] [(dec ?s) ?d] [(max ?s 10) ?mx] [(min ?s 10) ?mn]]", "p m q r i d mx mn")
datalog("divide", "SELECT p_partkey AS p, round(p_size / 7.0, 6) AS q FROM part WHERE p_size <> 0", "[:find ?p ?q :where [?p :part/p_size ?s] [(not= ?s 0)] [(/ ?s 7) ?q]]", "p q", finish=rounded(q=6))
datalog("str_fn", "SELECT p_partkey AS p, concat(p_brand, '-', CAST(p_size AS VARCHAR)) AS k FROM part", '[:find ?p ?k :where [?p :part/p_brand ?b] [?p :part/p_size ?s] [(str ?b "-" ?s) ?k]]', "p k")
datalog("count_empty_fn", "SELECT p_partkey AS p, CAST(length(p_name) AS BIGINT) AS n, length(p_name) = 0 AS e FROM part", "[:find ?p ?n ?e :where [?p :part/p_name ?x] [(count ?x) ?n] [(empty? ?x) ?e]]", "p n e")
datalog("logic_fn", "SELECT c_custkey AS c, (c_acctbal < 0 OR c_acctbal > 9000) AS o, (c_acctbal > 0 AND c_acctbal < 100) AS a, NOT (c_acctbal > 0) AS n, true AS b, false AS x, true AS s FROM customer", "[:find ?c ?o ?a ?n ?b ?x ?s :where [?c :customer/c_acctbal ?v] [(< ?v 0) ?l] [(> ?v 9000) ?h] [(or ?l ?h) ?o] [(> ?v 0) ?p] [(< ?v 100) ?q] [(and ?p ?q) ?a] [(not ?p) ?n] [(boolean ?v) ?b] [(nil? ?v) ?x] [(some? ?v) ?s]]", "c o a n b x s")
datalog("true_false_fn", "SELECT c_custkey AS c, c_acctbal > 0 AS t, c_acctbal <= 0 AS f, c_acctbal = 0 AS e FROM customer", "[:find ?c ?t ?f ?e :where [?c :customer/c_acctbal ?v] [(> ?v 0) ?p] [(true? ?p) ?t] [(false? ?p) ?f] [(= ?v 0) ?e]]", "c t f e")
datalog("date_diff_ms", "SELECT DISTINCT l_orderkey AS o, l_shipdate AS s, date_diff('millisecond', o_orderdate, l_shipdate) AS ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey", "[:find ?o ?s ?ms :where [?l :lineitem/l_orderkey ?o] [?l :lineitem/l_shipdate ?s] [?o :orders/o_orderdate ?d] [(- ?s ?d) ?ms]]", "o s ms")

# Joins
datalog("join_two", "SELECT DISTINCT c_name AS n, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey", "[:find ?n ?o :where [?o :orders/o_custkey ?c] [?c :customer/c_name ?n]]", "n o")
datalog("join_star", "SELECT DISTINCT r_name AS r, n_name AS n, c_custkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "[:find ?r ?n ?c :where [?c :customer/c_nationkey ?k] [?k :nation/n_name ?n] [?k :nation/n_regionkey ?g] [?g :region/r_name ?r]]", "r n c")
datalog("join_triangle", "SELECT DISTINCT c_custkey AS c, s_suppkey AS s, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE c_custkey = s_suppkey", "[:find ?c ?c2 ?n :where [?c :customer/c_nationkey ?k] [?c2 :supplier/s_nationkey ?k] [?k :nation/n_name ?n] [(= ?c ?c2)]]", "c s n")
datalog("self_join", "SELECT DISTINCT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey", "[:find ?a ?b :where [?a :supplier/s_nationkey ?n] [?b :supplier/s_nationkey ?n]]", "a b")
datalog("cross_join", "SELECT r_name AS r, s_suppkey AS s FROM region CROSS JOIN supplier", "[:find ?r ?s :where [?g :region/r_name ?r] [?s :supplier/s_name _]]", "r s")
datalog("semi_join", "SELECT DISTINCT c_custkey AS c FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')", '[:find ?c :where [?c :customer/c_name _] [?o :orders/o_custkey ?c] [?o :orders/o_orderstatus "F"]]', "c")
datalog("anti_not", "SELECT o_orderkey AS o FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)", "[:find ?o :where [?o :orders/o_custkey _] (not [_ :lineitem/l_orderkey ?o])]", "o")
datalog("not_join", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority = '5-LOW')", '[:find ?c :where [?c :customer/c_name _] (not-join [?c] [?o :orders/o_custkey ?c] [?o :orders/o_orderstatus "F"] [?o :orders/o_orderpriority "5-LOW"])]', "c")

# Disjunction, rules, recursion
datalog("or_clause", "SELECT DISTINCT o_orderkey AS o FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '5-LOW'", '[:find ?o :where (or [?o :orders/o_orderstatus "F"] [?o :orders/o_orderpriority "5-LOW"])]', "o")
datalog("or_and_branch", "SELECT DISTINCT o_orderkey AS o FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 300000) OR o_orderpriority = '5-LOW'", '[:find ?o :where (or [[?o :orders/o_orderstatus "F"] [?o :orders/o_totalprice ?t] [(> ?t 300000)]] [?o :orders/o_orderpriority "5-LOW"])]', "o")
datalog("or_join", "SELECT c_custkey AS c, n_name AS label FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT c_custkey, c_mktsegment FROM customer", "[:find ?c ?label :where [?c :customer/c_name _] (or-join [?c ?label] [[?c :customer/c_nationkey ?n] [?n :nation/n_name ?label]] [?c :customer/c_mktsegment ?label])]", "c label")
datalog("rule_simple", "SELECT c_name AS n FROM customer WHERE c_acctbal >= 5000", "[:find ?n :in $ % :where (rich ?c) [?c :customer/c_name ?n]]", "n", "[[(rich ?x) [?x :customer/c_acctbal ?a] [(>= ?a 5000)]]]")
datalog("rule_attribute", "SELECT c_custkey AS e, c_name AS v FROM customer", "[:find ?e ?v :in $ % :where (has ?e :customer/c_name ?v)]", "e v", "[[(has ?e ?attr ?v) [?e ?attr ?v]]]")
datalog("rule_multi_def", "SELECT o_orderkey AS o FROM orders WHERE o_totalprice > 400000 UNION SELECT l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 49", "[:find ?o :in $ % :where [?o :orders/o_custkey _] (big ?o)]", "o", "[[(big ?o) [?o :orders/o_totalprice ?t] [(> ?t 400000)]] [(big ?o) [?l :lineitem/l_orderkey ?o] [?l :lineitem/l_quantity ?q] [(>= ?q 49)]]]")
datalog("rule_recursive", "WITH RECURSIVE r(s, d) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey > 0 UNION SELECT r.s, p.p_partkey // 2 FROM r JOIN part p ON r.d = p.p_partkey WHERE p.p_partkey > 0) SELECT s, d FROM r", "[:find ?s ?d :in $ % :where (above ?s ?d)]", "s d", "[[(above ?s ?d) [?s :part/parent ?d]] [(above ?s ?d) (above ?s ?m) [?m :part/parent ?d]]]")
datalog("closure_fwd", "WITH RECURSIVE r(d) AS (SELECT p_partkey // 2 FROM part WHERE p_partkey = 100 UNION SELECT p_partkey // 2 FROM r JOIN part ON p_partkey = d WHERE p_partkey > 0) SELECT d AS a FROM r", "[:find ?a :where [100 :part/parent+ ?a]]", "a")
datalog("closure_inv", "WITH RECURSIVE r(s) AS (SELECT p_partkey FROM part WHERE p_partkey > 0 AND p_partkey // 2 = 5 UNION SELECT p_partkey FROM r JOIN part ON p_partkey // 2 = s WHERE p_partkey > 0) SELECT s AS x FROM r", "[:find ?x :where [?x :part/parent+ 5]]", "x")
datalog("closure_depth", "SELECT DISTINCT a FROM (SELECT p_partkey // 2 AS a FROM part WHERE p_partkey = 100 UNION SELECT q.p_partkey // 2 FROM part p JOIN part q ON q.p_partkey = p.p_partkey // 2 WHERE p.p_partkey = 100) x", "[:find ?a :where [100 :part/parent+ ?a :max-depth 2]]", "a")
datalog("closure_agg", "WITH RECURSIVE r(s) AS (SELECT p_partkey FROM part WHERE p_partkey > 0 AND p_partkey // 2 = 5 UNION SELECT p_partkey FROM r JOIN part ON p_partkey // 2 = s WHERE p_partkey > 0) SELECT count(*) AS n, round(sum(p_retailprice), 2) AS v FROM r JOIN part ON p_partkey = s", "[:find (count ?x) (sum ?v) :where [?x :part/parent+ 5] [?x :part/p_retailprice ?v]]", "n v", finish=rounded(v=2))

# Aggregates
datalog("agg_basic", "SELECT o_orderstatus AS s, count(*) AS n, round(sum(o_totalprice), 2) AS sm, round(avg(o_totalprice), 4) AS av, min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM orders GROUP BY 1", "[:find ?s (count ?o) (sum ?t) (avg ?t) (min ?t) (max ?t) :where [?o :orders/o_orderstatus ?s] [?o :orders/o_totalprice ?t]]", "s n sm av mn mx", finish=rounded(sm=2, av=4))
datalog("agg_advanced", "SELECT l_returnflag AS f, count(DISTINCT l_partkey) AS cd, round(var_pop(l_quantity), 6) AS vr, round(stddev_pop(l_quantity), 6) AS sd, median(l_quantity) AS md FROM lineitem GROUP BY 1", "[:find ?f (count-distinct ?p) (variance ?q) (stddev ?q) (median ?q) :where [?l :lineitem/l_returnflag ?f] [?l :lineitem/l_partkey ?p] [?l :lineitem/l_quantity ?q]]", "f cd vr sd md", finish=rounded(vr=6, sd=6))
datalog("agg_empty", "SELECT count(*) AS n, coalesce(sum(o_totalprice), 0) AS sm, coalesce(avg(o_totalprice), 0.0) AS av, median(o_totalprice) AS md FROM orders WHERE o_orderstatus = 'ZZ'", '[:find (count ?o) (sum ?t) (avg ?t) (median ?t) :where [?o :orders/o_orderstatus "ZZ"] [?o :orders/o_totalprice ?t]]', "n sm av md")
datalog("agg_collect", "SELECT n_regionkey AS r, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1", "[:find ?r (collect ?x) :where [?n :nation/n_regionkey ?r] [?n :nation/n_name ?x]]", "r names", finish=lambda df: df.withColumn("names", F.array_join("names", ",")))
datalog("agg_set_semantics", "SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1", "[:find ?seg (count ?c) :where [?c :customer/c_mktsegment ?seg]]", "seg n")
datalog("agg_group_expr", "SELECT CAST(p_size // 10 AS BIGINT) AS g, count(*) AS n FROM part GROUP BY 1", "[:find (quot ?s 10) (count ?p) :where [?p :part/p_size ?s]]", "g n")
datalog("agg_sample", None, "[:find ?r (sample 3 ?x) :where [?n :nation/n_regionkey ?r] [?n :nation/n_name ?x]]", "r names")
datalog("agg_rand", None, "[:find ?r (rand ?x) :where [?n :nation/n_regionkey ?r] [?n :nation/n_name ?x]]", "r name")
datalog("join_agg_sum", "SELECT c_mktsegment AS seg, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1", "[:find ?seg (sum ?t) :where [?o :orders/o_custkey ?c] [?c :customer/c_mktsegment ?seg] [?o :orders/o_totalprice ?t]]", "seg total", finish=rounded(total=2))
datalog("multi_join_agg", "SELECT n_name AS n, o_orderstatus AS s, count(*) AS c, round(sum(o_totalprice), 2) AS t FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2", "[:find ?n ?s (count ?o) (sum ?t) :where [?o :orders/o_custkey ?c] [?c :customer/c_nationkey ?k] [?k :nation/n_name ?n] [?o :orders/o_orderstatus ?s] [?o :orders/o_totalprice ?t]]", "n s c t", finish=rounded(t=2))

# Time
_LATEST = "SELECT user_id AS e, value AS v FROM events WHERE event_type = 'purchase'{} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"
_PURCHASE = "[:find ?e ?v :where [?e :user/purchase ?v]]"
datalog("latest_wins", _LATEST.format(""), _PURCHASE, "e v", source=log)
datalog("as_of_tx", _LATEST.format(" AND event_id + 1 <= 500"), _PURCHASE, "e v", source=log, as_of={":tx": 500})
datalog("as_of_dim", _LATEST.format(" AND ts <= TIMESTAMP '2024-01-15'"), '{:query [:find ?e ?v :where [?e :user/purchase ?v]] :as-of {:time/occurred #inst "2024-01-15"}}', "e v", source=log)
datalog("time_series", "SELECT DISTINCT user_id AS e, ts AS t, value AS v FROM events WHERE event_type = 'purchase'", "[:find ?e ?t ?v :where [?e :user/purchase ?v :at/occurred ?t]]", "e t v", source=log, finish=lambda df: df.withColumn("t", F.col("t").cast("timestamp_ntz")))
datalog("value_after_latest", f"SELECT e, v FROM ({_LATEST.format('')}) x WHERE v > 100", "[:find ?e ?v :where [?e :user/purchase ?v] [(> ?v 100)]]", "e v", source=log)
datalog("closure_none_bound", "WITH RECURSIVE r(s, d) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey > 0 UNION SELECT r.s, p.p_partkey // 2 FROM r JOIN part p ON r.d = p.p_partkey WHERE p.p_partkey > 0) SELECT count(*) AS n FROM r", "[:find (count ?s) :where [?s :part/parent+ ?d]]", "n")


def _cross_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose last purchase follows their last signup, in ms: both series by time, then the last of each."""
    db = log(spark, sf_dir)
    last = [db.query(f"[:find ?e (max ?t) :where [?e :user/{k} ?v :at/occurred ?t]]", names=["e", k]) for k in ("purchase", "signup")]
    both = Database(spark)
    both.map_table("last", last[0].join(last[1], "e"), "e")
    return both.query("[:find ?e ?ms :where [?e :last/purchase ?p] [?e :last/signup ?s] [(> ?p ?s)] [(- ?p ?s) ?ms]]", names=["e", "ms"])


register("cross_dim", "SELECT p.user_id AS e, date_diff('millisecond', s.ts, p.ts) AS ms FROM (SELECT user_id, max(ts) AS ts FROM events WHERE event_type = 'purchase' GROUP BY 1) p JOIN (SELECT user_id, max(ts) AS ts FROM events WHERE event_type = 'signup' GROUP BY 1) s USING (user_id) WHERE p.ts > s.ts", _cross_dim)

# Pull
register(
    "pull_nested", "SELECT o_orderkey AS o, o_totalprice AS t, c_name AS customer_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    lambda spark, d: star(spark, d).query("[:find (pull ?o [:orders/o_totalprice {:orders/o_custkey [:customer/c_name]}]) :where [?o :orders/o_custkey _]]", names=["p"]).select(
        F.col("p").getField(":db/id").alias("o"), F.col("p").getField(":orders/o_totalprice").alias("t"), F.col("p").getField(":orders/o_custkey").getField(":customer/c_name").alias("customer_name")),
)
register(
    "pull_reverse", "SELECT n_nationkey AS n, count(c_custkey) AS k, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS ids FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1",
    lambda spark, d: star(spark, d).query("[:find (pull ?n [:customer/_c_nationkey]) :where [?n :nation/n_name _]]", names=["p"]).select(
        F.col("p").getField(":db/id").alias("n"), F.coalesce(F.size(F.col("p").getField(":customer/_c_nationkey")), F.lit(0)).cast("long").alias("k"), F.array_join(F.col("p").getField(":customer/_c_nationkey").cast("array<string>"), ",").alias("ids")),
)


# Standing queries, over the events in batches
BATCHES = 5


def _replay(spark: SparkSession, sf_dir: str, query: str, names: list[str], retract: str | None) -> DataFrame:
    """The final state of a standing query after the events came in batches, and then, if given, some were retracted."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    top = events.agg(F.max("event_id")).first()[0] or 0
    view = LiveView(ast.parse(query), names)

    def changes(df: DataFrame, mult: int) -> dict[str, DataFrame]:
        return {f":event/{c}": df.select(F.col("event_id").alias("e"), F.col(f).alias("v"), F.lit(mult).cast("long").alias("mult")) for c, f in (("type", "event_type"), ("value", "value"))}

    for i in range(BATCHES):
        view.apply(changes(events.where((F.col("event_id") * BATCHES / (top + 1)).cast("int") == i), 1))
    if retract:
        view.apply(changes(events.where(retract), -1))
    return view.result()


_TYPED = ":where [?x :event/type ?k] [?x :event/value ?v]]"
register("live_join_agg", "SELECT event_type AS k, count(*) AS n, round(sum(value), 2) AS s, min(value) AS mn, max(value) AS mx FROM events GROUP BY 1", lambda spark, d: _replay(spark, d, f"[:find ?k (count ?x) (sum ?v) (min ?v) (max ?v) {_TYPED}", ["k", "n", "s", "mn", "mx"], None).withColumn("s", F.round("s", 2)))
register("live_retract", "SELECT event_type AS k, count(*) AS n, median(value) AS md FROM events WHERE value >= 50 GROUP BY 1", lambda spark, d: _replay(spark, d, f"[:find ?k (count ?x) (median ?v) {_TYPED}", ["k", "n", "md"], "value < 50"))
register("live_linear", "SELECT event_type AS k, count(*) AS n, round(sum(value), 2) AS s, round(avg(value), 6) AS av FROM events WHERE value >= 50 GROUP BY 1", lambda spark, d: _replay(spark, d, f"[:find ?k (count ?x) (sum ?v) (avg ?v) {_TYPED}", ["k", "n", "s", "av"], "value < 50").withColumns({"s": F.round("s", 2), "av": F.round("av", 6)}))
register("live_filter", "SELECT event_id AS x, value AS v FROM events WHERE event_type = 'purchase' AND value > 100", lambda spark, d: _replay(spark, d, '[:find ?x ?v :where [?x :event/type "purchase"] [?x :event/value ?v] [(> ?v 100)]]', ["x", "v"], None))

