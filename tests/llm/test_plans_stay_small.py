"""What the driver plans in each round of the components' loop, which it repeats many times."""

from cuewise.llm import simhash


def test_each_star_is_a_plan_of_its_own(spark, monkeypatch):
    joins, durable = [], simhash.durable

    def counted(df, replaced=None):
        joins.append(df._jdf.queryExecution().analyzed().toString().count("Join "))
        return durable(df, replaced)

    monkeypatch.setattr(simhash, "durable", counted)
    links = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(20, 21)], "a long, b long")
    found = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert found == {**dict.fromkeys(range(7), 0), 20: 20, 21: 20}
    assert max(joins) <= 3
