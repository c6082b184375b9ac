"""The driver's contract, and every query that has SQL against DuckDB on the smallest tables."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
SAMPLE = ["slice_rolling_mae", "cln_pipeline", "rsm_30min_right", "ev_global_regime", "es_points", "sq_page_hinkley", "ev_match", "ev_profile_apply", "rsh_pivot", "ad_accounting", "stream_detect", "rp_t4",
          "ev_local_regime", "sq_arm_loop", "ad_contract", "ux_adapt_runs", "ux_baselines", "ux_holdout", "ux_stage_plan", "src_cached_load", "src_winners", "src_group_b", "snk_lock", "src_ui_read", "rp_t2", "rp_t3", "rp_t6", "rp_fsel", "rp_audit", "rp_f5", "ux_rows", "ux_record_run", "sq_boa"]


def cell(v):
    if v is None or isinstance(v, bool | str):
        return repr(v)
    if isinstance(v, int | float) or type(v).__name__ == "Decimal":
        v = float(v)
        return repr(v) if math.isinf(v) or math.isnan(v) else repr(round(v, 6) + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 200


@needs_data
def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).columns == ["split", "k", "n", "mae", "worst"]


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(found.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in found.collect())
    result = db.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(cell(row[names.index(c)]) for c in columns) for row in result.fetchall())


@needs_data
def test_rp_t1_equals_its_sql(spark):
    test_query_equals_its_sql(spark, "rp_t1")


@needs_data
def test_rp_t1_year_equals_its_sql(spark):
    test_query_equals_its_sql(spark, "rp_t1_year")


def test_nothing_else_imports_the_training_data_operators():
    root = Path(__spark_entry__.__file__).parent
    users = [p for p in (root / "tidemark").rglob("*.py") if "llm" not in p.parts and "tidemark.llm" in p.read_text()]
    assert users == []


def test_imports_without_the_training_data_operators(tmp_path):
    """A copy without llm folders and pipeline, or with ones that can't be imported, still gives the other queries."""
    import shutil

    root = Path(__spark_entry__.__file__).parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'slice_rolling_mae' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    (tmp_path / "tidemark" / "llm").mkdir()
    (tmp_path / "tidemark" / "llm" / "queries.py").write_text("import nothing_of_this_name")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
