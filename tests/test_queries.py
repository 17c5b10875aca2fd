"""Patterns, joins, logic, rules, closure and aggregates on small facts."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from factlake.db import Database
from factlake.plans.ast import QueryError


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def people(spark):
    db = Database(spark)
    db.transact([{":name": "Ivan", ":age": 15}, {":name": "Petr", ":age": 37}, {":name": "Ivan", ":age": 37}, {":age": 15}])
    return db


def test_joins(people):
    assert rows(people.query("[:find ?e1 ?e2 :where [?e1 :name ?n] [?e2 :name ?n]]")) == {(1, 1), (2, 2), (3, 3), (1, 3), (3, 1)}
    assert rows(people.query('[:find ?e ?e2 ?n :where [?e :name "Ivan"] [?e :age ?a] [?e2 :age ?a] [?e2 :name ?n]]')) == {(1, 1, "Ivan"), (3, 3, "Ivan"), (3, 2, "Petr")}
    assert rows(people.query("[:find ?a :where [?e :age ?a]]")) == {(15,), (37,)}
    assert rows(people.query('[:find ?n ?x :where [?e :name ?n] [(str ?n "!") ?x] (not [?e :age 15])]')) == {("Petr", "Petr!"), ("Ivan", "Ivan!")}


def test_empty_stays_empty(people):
    assert rows(people.query('[:find ?a :where [?x :name "Nobody"] [?e :age ?a]]')) == set()


def test_negation_and_disjunction(people):
    assert rows(people.query("[:find ?e :where [?e :age _] (not [?e :name _])]")) == {(4,)}
    assert rows(people.query('[:find ?e :where [?e :age ?a] (not [?e :name "Ivan"] [(> ?a 20)])]')) == {(1,), (2,), (4,)}
    assert rows(people.query('[:find ?e :where [?e :age ?a] (or [?e :name "Petr"] [(< ?a 20)])]')) == {(1,), (2,), (4,)}
    assert rows(people.query('[:find ?e :where [?e :age ?a] (not-join [?e] [?e :name ?n] [?o :name ?n] [?o :age 15])]')) == {(2,), (4,)}
    assert rows(people.query('[:find ?e :where [?e :age _] (not [?x :name "Nobody"])]')) == {(1,), (2,), (3,), (4,)}
    with pytest.raises(QueryError):
        people.query('[:find ?e ?n :where (or [?e :name ?n] [?e :age 15])]')


def test_inputs_and_forms(people):
    assert rows(people.query("[:find ?e :in $ ?n :where [?e :name ?n]]", inputs={"n": "Petr"})) == {(2,)}
    assert rows(people.query("[:find ?e 1 (+ ?a 1) :where [?e :age ?a] [?e :name \"Petr\"]]")) == {(2, 1, 38)}


@pytest.fixture(scope="module")
def family(spark):
    db = Database(spark)
    db.transact([{":db/id": 1, ":name": "a"}, {":db/id": 2, ":name": "b", ":parent": 1}, {":db/id": 3, ":name": "c", ":parent": 2}, {":db/id": 4, ":name": "d", ":parent": 3}])
    return db


ALL = {(2, 1), (3, 2), (4, 3), (3, 1), (4, 2), (4, 1)}


def test_recursive_rule(family):
    rules = "[[(ancestor ?a ?d) [?d :parent ?a]] [(ancestor ?a ?d) [?d :parent ?p] (ancestor ?a ?p)]]"
    assert rows(family.query("[:find ?d ?a :in $ % :where (ancestor ?a ?d)]", rules)) == ALL
    assert rows(family.query("[:find ?d :in $ % :where (ancestor 2 ?d)]", rules)) == {(3,), (4,)}
    even = "[[(odd ?x ?y) [?x :parent ?y]] [(odd ?x ?y) [?x :parent ?z] (even ?z ?y)] [(even ?x ?y) [?x :parent ?z] (odd ?z ?y)]]"
    assert rows(family.query("[:find ?x ?y :in $ % :where (even ?x ?y)]", even)) == {(3, 1), (4, 2)}


def test_closure(family):
    assert rows(family.query("[:find ?d ?a :where [?d :parent+ ?a]]")) == ALL
    assert rows(family.query("[:find ?a :where [4 :parent+ ?a :max-depth 2]]")) == {(3,), (2,)}
    assert rows(family.query("[:find ?d :where [?d :parent+ 2]]")) == {(3,), (4,)}
    assert rows(family.query("[:find ?n (count ?d) :where [?a :name ?n] [?d :parent+ ?a]]")) == {("a", 3), ("b", 2), ("c", 1)}
    assert rows(family.query("[:find ?n :where [4 :parent+ 1] [4 :name ?n]]")) == {("d",)}
    assert rows(family.query("[:find ?n :where [1 :parent+ 4] [4 :name ?n]]")) == set()


def test_cycle_ends(spark):
    db = Database(spark)
    db.transact([[":db/add", 1, ":next", 2], [":db/add", 2, ":next", 3], [":db/add", 3, ":next", 1]])
    assert rows(db.query("[:find ?x :where [1 :next+ ?x]]")) == {(1,), (2,), (3,)}


def test_aggregates(spark):
    db = Database(spark)
    q = "[:find (count ?v) (sum ?v) (median ?v) (count-distinct ?v) :where [?e :v ?v]]"
    assert rows(db.query(q)) == {(0, 0, None, 0)}
    assert rows(db.query("[:find ?e (count ?v) :where [?e :v ?v]]")) == set()
    db.transact([{":v": 5, ":g": "a"} for _ in range(4)] + [{":v": 6, ":g": "b"}])
    assert rows(db.query(q)) == {(5, 26, 5.0, 2)}
    assert rows(db.query("[:find ?g (count ?v) (variance ?v) (avg ?v) :where [?e :g ?g] [?e :v ?v]]")) == {("a", 4, 0.0, 5.0), ("b", 1, 0.0, 6.0)}
    got = db.query("[:find (sample 3 ?v) (rand ?v) (collect ?v) :where [?e :v ?v]]").first()
    assert len(got[0]) == 3 and got[1] in (5, 6) and got[2] == [5, 5, 5, 5, 6]
    # without the entity in the bindings equal values are one
    assert rows(db.query("[:find (count ?v) :where [_ :v ?v]]")) == {(2,)}


def test_integer_functions(spark):
    db = Database(spark)
    db.transact([{":x": -7, ":y": 2}, {":x": 7, ":y": -3}, {":x": 1, ":y": 0}])
    got = rows(db.query("[:find ?x ?m ?q ?r :where [?e :x ?x] [?e :y ?y] [(mod ?x ?y) ?m] [(quot ?x ?y) ?q] [(rem ?x ?y) ?r]]"))
    assert got == {(-7, 1, -3, -1), (7, -2, -2, 1), (1, None, None, None)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=14))
def test_closure_equals_brute_force(spark, edges):
    db = Database(spark)
    db.map_table("g", spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(sorted(edges))], "id long, a long, b long"), "id")
    want = set(edges)
    while True:
        more = want | {(a, d) for a, b in want for c, d in want if b == c}
        if more == want:
            break
        want = more
    rules = "[[(path ?a ?b) [?g :g/a ?a] [?g :g/b ?b]] [(path ?a ?c) (path ?a ?b) (path ?b ?c)]]"
    assert rows(db.query("[:find ?a ?b :in $ % :where (path ?a ?b)]", rules)) == want
