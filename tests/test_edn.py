from datetime import datetime, timezone

import pytest

from factlake.plans import ast, edn


def test_values():
    got = edn.read('[1 -2.5 "a\\n\\"b" :k/w nil true #{1 2} {:a [1], :b (f ?x)} #inst "2024-01-15" 1/2 ; end\n]')
    assert got[:6] == [1, -2.5, 'a\n"b', ":k/w", None, True]
    assert got[6] == {1, 2} and got[7][":a"] == [1] and isinstance(got[7][":b"], edn.Form)
    assert got[8] == datetime(2024, 1, 15, tzinfo=timezone.utc) and got[9] == 0.5
    assert edn.read("[1 #_ 2 3]") == [1, 3]


@pytest.mark.parametrize("text", ["[1", "1 2", ")", "{:a}", '"open'])
def test_unreadable(text):
    with pytest.raises(edn.EdnError):
        edn.read(text)


@pytest.mark.parametrize("text", ["[:where [?e :a ?v]]", "[:find :where [?e :a ?v]]", "[:find ?a :where [?e ?a ?v]]", "[:find ?v :where [?e :a ?v :max-depth 2]]", "[:find (pull ?e [*]) (count ?v) :where [?e :a ?v]]", "[:find (sample ?v) :where [?e :a ?v]]", "[:find ?x :where [x :a ?x]]"])
def test_rejected(text):
    with pytest.raises(ast.QueryError):
        ast.parse(text)
