import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from factlake import fact_queries, queries

DATA = Path("/root/testdata/sf0.001")
NAMES = ["pred_two_vars", "int_math", "date_diff_ms", "join_star", "anti_not", "not_join", "or_and_branch", "rule_multi_def", "closure_inv", "agg_advanced", "join_agg_sum", "as_of_dim", "cross_dim", "pull_reverse"]
NAMES += ["tx_lookup_refs", "tx_declared_many", "tx_assoc", "tx_deltas", "tx_atomic", "entity_reads", "store_delete", "store_restore", "store_kinds", "ordering_refused", "derived_dim", "late_event", "two_time_patterns", "list_form_binding", "rule_in_not", "refusals", "pull_star", "pull_limit", "subscribe_diffs", "subscribe_negation"]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA / f}'")
    df = queries.QUERIES[name](spark, str(DATA))
    sql = con.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in sql.description]
    assert sorted(cols) == sorted(df.columns)
    near = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    assert sorted((tuple(near(r[c]) for c in cols) for r in df.collect()), key=repr) == sorted((tuple(map(near, r)) for r in sql.fetchall()), key=repr)


def test_registry():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(queries.QUERIES) >= 100 and fact_queries
