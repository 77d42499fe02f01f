import corpus_pipeline
import pytest
from oracle import DATA, connection, same

from fluxtrace.llm.oracles import ORACLES
from fluxtrace.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    same(QUERIES[name](spark, DATA), connection(), ORACLES[name])


def test_stages_take_effect(spark, tmp_path):
    docs = before = spark.read.parquet(f"{DATA}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.dtypes == before.dtypes
        counts.append(docs.count())
    total = before.count()
    assert total > counts[0] == counts[1] >= counts[2] >= counts[3] > 0.5 * total
    assert corpus_pipeline.near_dedup(spark, before, DATA).count() < total > corpus_pipeline.decontamination(spark, before, DATA).count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == counts[3]
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, last.collect()))
