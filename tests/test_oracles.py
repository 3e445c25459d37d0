"""Every query of the catalogue against DuckDB, on the smallest tables."""

import duckdb
import pytest

from labelflow.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canon(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(f"{float(v):.6f}" if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" else str(v) for v in r) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLE_SQL:
        assert canon(got) == canon(duck.sql(catalogue.ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_registry_imports_without_the_llm_parts():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = f"import sys; sys.path.insert(0, {str(root)!r}); sys.modules['labelflow.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; assert 'classify' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0
