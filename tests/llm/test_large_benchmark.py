"""Decontamination with a benchmark of several thousand passages."""

import random

from tessera.llm import decontamination as D
from tessera.llm.common import table


def test_recall_does_not_fall_as_the_benchmark_grows(spark):
    random.seed(12)
    texts = [r.text.split() for r in table(spark, "/root/testdata/sf0.1", "documents").where("doc_id % 2 = 0 and n_chars > 500").select("text").limit(2600).collect()]
    hosts, sources = texts[:450], texts[450:]
    items, made = [], []
    for k in range(4000):
        words = random.choice(sources)
        n = random.randint(15, 48)
        at = random.randrange(max(1, len(words) - n))
        items.append((k, " ".join(words[at : at + n])))
    for k, host in enumerate(hosts):
        words = items[k * 8][1].split()
        if k % 3 == 0:  # a paraphrase: every ninth word replaced
            words[::9] = ["other"] * len(words[::9])
        at = random.randrange(len(host) + 1)
        made.append((k, " ".join(host[:at] + words + host[at:])))
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.item_ids for r in D.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    found = [k * 8 in got[k] for k in range(len(hosts))]
    verbatim, other = [f for k, f in enumerate(found) if k % 3], found[::3]
    print("recall", sum(verbatim) / len(verbatim), sum(other) / len(other))
    assert all(verbatim) and sum(other) >= 0.9 * len(other)
