"""The registered queries against their SQL, on the smallest tables."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from semilog.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = sorted(set(ORACLES) & {"join_three", "underscore_join", "neg_two_layers", "neg_nullary", "union_rules", "agg_count_bindings", "agg_global_empty", "tc_bool", "mutual_even_odd", "trop_apsp", "tc_magic", "prob_noisy_or", "prob_negation", "grad_worlds", "soft_table", "prob_bound", "prov_negation", "provk_lower_bound", "terms_decompose", "asp_cardinality", "k4", "contract_count", "dred_delete", "incprov_insert", "intern_dense", "mnist_sum_conv", "incprov_regions", "source_files", "source_weights", "source_neural", "sink_relations", "neg_anti_rows", "neg_nullary_held", "asp_founded", "asp_filter", "terms_interned", "terms_maximal", "circuits_regions"})


def compare(spark, sf, name, query, sql):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    df = query(spark, sf)
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    rows = want.fetchall()
    order = sorted(columns)
    a = sorted((tuple(r[c] for c in order) for r in df.collect()), key=str)
    b = sorted((tuple(r[columns.index(c)] for c in order) for r in rows), key=str)
    assert a == b, name


@pytest.mark.parametrize("name", SOME)
def test_query(spark, sf, name):
    compare(spark, sf, name, QUERIES[name], ORACLES[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


WITHOUT = """
import sys
import __spark_entry__ as entry
if {missing!r}:
    sys.modules[{missing!r}] = None
names = set(entry.queries())
assert set(entry.oracle_sql()) <= names and 'tc_bool' in names
assert not [n for n in names if n.startswith('op') or n == 'pipeline'], names
"""


@pytest.mark.parametrize("gone, missing", [(("semilog/llm", "tests/llm"), ""), (("semilog/llm", "tests/llm", "corpus_pipeline.py"), ""), ((), "xxhash")])
def test_the_rest_works_without_the_corpus_operators(tmp_path, gone, missing):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = str(tmp_path / "repo")
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for path in gone:
        path = os.path.join(copy, path)
        shutil.rmtree(path, ignore_errors=True) if not path.endswith(".py") else os.path.exists(path) and os.remove(path)
    if missing and not os.path.isdir(os.path.join(copy, "semilog", "llm")):
        pytest.skip("the corpus operators are not there")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", WITHOUT.format(missing=missing)], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
