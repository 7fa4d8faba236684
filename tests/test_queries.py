"""Every registered query that SQL can express, against DuckDB on the smallest tables."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

from corvane.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.6f}"
    return str(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.queries()["page_titles"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "url" not in plan.split("ReadSchema")[1]
    plan = catalog.queries()["document_quality_gate"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(text)" in plan and "Exchange" not in plan


@pytest.mark.parametrize("module", ["xxhash", "corvane.llm", "corpus_pipeline"])
def test_the_rest_works_without_the_optional_parts(module):
    """A missing library or folder takes away the corpus operators only."""
    code = f"""
import sys
sys.modules[{module!r}] = None
import __spark_entry__ as entry
from corvane.plans import catalog
assert set(catalog.queries()) <= set(entry.queries()) and set(catalog.oracle_sql()) <= set(entry.oracle_sql())
assert "pipeline" not in entry.queries() and ({module!r} == "corpus_pipeline" or not any(k.startswith("op1_") for k in entry.queries()))
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_evidence_lines_of_far_times_equal_sql(spark, tmp_path):
    ids = [3, 2906, 2907, 6613, 6615, 46871, 64101]
    pages = spark.createDataFrame([(i, f"https://e.example/{i}", "<title>t</title><p>x</p>") for i in ids], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in catalog.queries()["evidence_lines"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted(con.execute(catalog.oracle_sql()["evidence_lines"]).fetchall())


@pytest.mark.parametrize("name", ["metadata_entries", "reddit_md"])
def test_long_rows_of_a_small_file_are_several_tasks(spark, name):
    assert catalog.queries()[name](spark, SF).rdd.getNumPartitions() >= 8


def test_batches_look_at_each_text_once_in_several_tasks(spark):
    plan = catalog.queries()["batch_combine"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("content too short") == 1 and "translate" not in plan and "RepartitionByExpression" in plan


@pytest.mark.parametrize("name", ["citations", "citation_context", "evidence_lines"])
def test_citations_are_found_once(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
