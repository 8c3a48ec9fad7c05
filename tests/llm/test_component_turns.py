"""Turns that components take."""

from tallycast.llm import graph


def test_a_star_ends_in_its_second_turn(spark, monkeypatch):
    steps, keep = [], graph.written

    def seen(df, name):
        steps.append(name)
        return keep(df, name)

    monkeypatch.setattr(graph, "written", seen)
    edges = spark.range(1, 3000).selectExpr("id + 10 as a", "5L as b")
    assert {(r.component, r["count"]) for r in graph.components(edges).groupBy("component").count().collect()} == {(5, 3000)}
    assert steps.count("step") <= 2
