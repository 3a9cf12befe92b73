"""Registered queries against their SQL; the pipeline's contract."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tesseral.llm.queries import QUERIES, SQL

from ..conftest import SMALL, rows_of


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_and_sql(name, spark, duck):
    df = QUERIES[name](spark, SMALL)
    found = duck.execute(SQL[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in found.description], found.fetchall())


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert [int(n[2:].split("_")[0]) for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 11))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = corpus_pipeline.cut(stage(spark, docs, SMALL))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert docs.count() <= before.count()
    assert docs.where("not round_trip").count() == 0
    assert docs.count() == corpus_pipeline.run(spark, SMALL).count()
    assert docs.count() > 0.9 * spark.read.parquet(f"{SMALL}/documents.parquet").count()


UNLEARNT = [
    "Nel mezzo del cammino di nostra vita mi ritrovai per una selva oscura, ché la diritta via era smarrita. Ahi quanto a dir qual era è cosa dura questa selva selvaggia e aspra e forte che nel pensier rinova la paura.",
    "De kat zit op de mat en kijkt naar buiten, waar het al de hele dag regent. Morgen gaan wij met de trein naar Utrecht om daar onze vrienden te bezoeken en samen een kop koffie te drinken.",
]


def test_language_stage_rejects_unlearnt_languages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    other = spark.createDataFrame([(10**6 + k, t, None, "s", len(t)) for k, t in enumerate(UNLEARNT)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.union(other), SMALL).collect()}
    assert kept == {r.doc_id for r in docs.collect()}
