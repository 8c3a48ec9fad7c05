"""What of the search in Hamming space passes through the driver."""

import re

import numpy as np

from tallycast.llm import hamming_search


def test_values_are_not_sent_through_the_driver(spark, monkeypatch):
    """Rows made by explode stand below no broadcast: Spark takes them for as small as what they are made of."""
    plans, keep = [], hamming_search.written

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(hamming_search, "written", seen)
    monkeypatch.setattr(hamming_search, "segments_for", lambda n: 4)
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, int(c)) for i, c in enumerate(rng.integers(-(1 << 63), (1 << 63) - 1, 300))], "id long, code long")
    assert hamming_search.hamming_top_k(df, df.where("id % 7 = 0"), 6).count() == 43 * 6
    made = 0
    for plan in plans:
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            depth = re.search(r"\w", line)
            if not depth or "BroadcastExchange" not in line:
                continue
            for below in lines[i + 1 :]:
                if re.search(r"\w", below) and re.search(r"\w", below).start() <= depth.start():
                    break
                assert "Generate explode" not in below, plan
        made += plan.count("Generate explode")
    assert made > 4
