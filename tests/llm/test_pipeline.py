"""The pipeline's stages on small tables, and its result against its stages run by hand."""

import corpus_pipeline as P
from tessera.llm.common import stored, table
from tessera.llm.decontamination import decontaminate
from tessera.llm.quality_rules import quality_rules
from tessera.llm.toxicity import toxicity
from test_near_copies import slow_components

DATA = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns, labels = docs.columns, table(spark, DATA, "labels")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before = ids(docs)
    want = {
        "toxicity": lambda d: before - {r.doc_id for r in toxicity(d, labels).where("predicted = 1").collect()},
        "quality_rules": lambda d: {r.doc_id for r in quality_rules(d, labels).where("kept").collect()},
        "near_dedup": lambda d: set(slow_components([(r.doc_id, r.text) for r in d.collect()]).values()),
        "decontamination": lambda d: before - {r.doc_id for r in decontaminate(d, table(spark, DATA, "benchmark")).where("contaminated").collect()},
    }
    for name, stage in P.STAGES[:-1]:
        expected = want[name](docs)
        docs = stored(stage(spark, docs, DATA), name)
        now = ids(docs)
        assert docs.columns == columns and now <= before and now == expected & before
        assert docs.count() == len(now)
        before = now
    packed = P.STAGES[-1][1](spark, docs, DATA)
    assert ids(packed) == before and packed.count() == len(before)
    assert ids(P.run(spark, DATA)) == before
