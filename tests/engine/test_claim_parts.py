"""Claims are judged in as many tasks as their links ask for, with the same results."""

from evidentia.operators import claims


def test_tasks_follow_the_links(spark, monkeypatch):
    c = spark.range(40).selectExpr("id AS claim", "id % 2 AS cluster", "'solution_gap' AS claim_type", "'s' AS statement")
    links = spark.range(120).selectExpr("id % 40 AS claim", "CASE WHEN id % 3 = 0 THEN 'commercial' ELSE 'evidence' END AS kind", "id % 30 AS target", "CASE WHEN id % 7 = 0 THEN 'refutes' ELSE 'supports' END AS direction")
    members = spark.range(25).selectExpr("id % 2 AS cluster", "id AS evidence")
    outcomes = spark.range(30).selectExpr("id % 2 AS cluster", "id AS outcome", "'sale' AS outcome_type", "'supports' AS direction")
    whole = sorted(map(tuple, claims.proposals(c, links, members, outcomes).collect()))
    monkeypatch.setattr(claims, "ROWS", 10)
    parts = claims.proposals(c, links, members, outcomes)
    assert sorted(map(tuple, parts.collect())) == whole and len(whole) == 40
    assert parts.rdd.getNumPartitions() == 13
