"""The order and the form of joins."""

from factlake.db import Database
from factlake.plans.planner import Planner

TRIANGLE = "[:find ?n ?s ?c :where [?s :supplier/nation ?n] [?c :customer/nation ?n] [?o :orders/customer ?c] [?l :lineitem/order ?o] [?l :lineitem/supplier ?s]]"


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_joins_that_multiply_come_last(spark, monkeypatch):
    db, met = Database(spark), []
    db.map_table("supplier", spark.createDataFrame([(i, i % 2) for i in range(6)], "id long, nation long"), "id")
    db.map_table("customer", spark.createDataFrame([(i, i % 2) for i in range(8)], "id long, nation long"), "id")
    db.map_table("orders", spark.createDataFrame([(i, i % 8) for i in range(20)], "id long, customer long"), "id")
    db.map_table("lineitem", spark.createDataFrame([(i % 20, i % 6) for i in range(50)], "order long, supplier long"), None)
    own = Planner.join

    def join(self, a, b, *rest):
        if a is not None:
            shared = a.real & b.real
            met.append(a.key <= shared or b.key <= shared)
        return own(self, a, b, *rest)

    monkeypatch.setattr(Planner, "join", join)
    got = rows(db.query(TRIANGLE))
    assert met == [True, True, True]
    assert got == {(s % 2, s, c) for s, c in {(i % 6, i % 20 % 8) for i in range(50)} if s % 2 == c % 2}


def test_a_join_that_multiplies_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr("factlake.plans.planner.PIECE", 32, raising=False)
    db = Database(spark)
    # one value has nearly all rows, others few or none on one side
    a, b = [(i, 0 if i < 300 else i % 7) for i in range(330)], [(i, 0 if i < 200 else i % 9) for i in range(215)]
    db.map_table("a", spark.createDataFrame(a, "id long, n long"), "id")
    db.map_table("b", spark.createDataFrame(b, "id long, n long"), "id")
    got = db.query("[:find ?x ?y :where [?x :a/n ?n] [?y :b/n ?n] [(> ?x ?y)]]")
    parts = got.rdd.glom().map(lambda p: [tuple(r) for r in p]).collect()
    found = [r for p in parts for r in p]
    assert len(found) == len(set(found)) and set(found) == {(x, y) for x, n in a for y, m in b if n == m and x > y}
    assert max(map(len, parts)) < len(found) / 8
    assert rows(db.query("[:find ?x :where [?x :a/n ?n] [?y :b/n ?n] [(= ?x ?y)]]")) == {(x,) for x, n in a if (x, n) in b}


def test_tasks_of_a_distinct_join_follow_the_input(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("factlake.plans.planner.SHARE", 1_000, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = []
        for size in (2_000, 8_000):
            spark.range(size).selectExpr("id", "hash(id) AS day").coalesce(1).write.parquet(f"{tmp_path}/o{size}")
            spark.range(2 * size).selectExpr("id div 4 AS o", "id % 3 AS s").coalesce(1).write.parquet(f"{tmp_path}/l{size}")
            db = Database(spark)
            db.map_table("o", spark.read.parquet(f"{tmp_path}/o{size}"), "id")
            db.map_table("l", spark.read.parquet(f"{tmp_path}/l{size}"), None)
            got = db.query("[:find ?o ?s ?d :where [?l :l/o ?o] [?l :l/s ?s] [?o :o/day ?d]]")
            parts.append(got.rdd.getNumPartitions())
            assert got.count() == len({(i // 4, i % 3) for i in range(2 * size)})
        assert parts[0] > 8 and parts[1] > 2 * parts[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
