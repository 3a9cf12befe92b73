"""Every registered query that has SQL gives DuckDB's rows."""

import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tesseral.queries import QUERIES, SQL

from .conftest import ROOT, SMALL, rows_of


def test_entry(spark):
    assert entry.entry(spark).columns == ["result"]
    assert entry.entry(spark).count() > 0


def test_registries_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, SMALL)
    found = duck.execute(SQL[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in found.description], found.fetchall())


def test_json_goes_through_the_own_reader(spark, monkeypatch):
    import tesseral.queries as q

    seen = []
    own = q.read_json
    monkeypatch.setattr(q, "read_json", lambda *a: seen.append(a) or own(*a))
    assert q.QUERIES["source_json"](spark, SMALL).columns == q.PRICED and len(seen) == 1


def test_scratch_is_shared_on_a_cluster(monkeypatch):
    import tesseral.queries as q

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        q.scratch(Cluster)


def test_the_rest_works_without_a_library_of_the_llm_package():
    """A child process, in which one library can't be imported."""
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; print(len(set(e.queries()) - {'pipeline'}), any(x.startswith('op') for x in e.queries()), len(set(e.oracle_sql()) - {'pipeline'}))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    n, has, m = out.stdout.split()
    assert (int(n), has, int(m)) == (len(QUERIES), "False", len(SQL))
