from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from evidentia.functions import values
from evidentia.operators import claims, reads
from evidentia.sources.searches import SearchError, checked_search


def test_values(spark):
    names = ["@scope/na me", "plain", "ü+x", "a/b@1"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(values.package_path(F.col("n")).alias("p")).collect()
    assert [r.p for r in got] == [quote(n, safe="@/") for n in names]
    r = spark.range(1).select(
        values.money(F.lit(2.345).cast("decimal(10,3)"), F.lit(" eur")).alias("m"), values.money(F.lit(None).cast("double"), F.lit(None).cast("string")).alias("none"),
        values.merged(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))).alias("map"), values.decimal_or_null(F.lit("x1")).alias("d"),
        values.count_or_error(F.lit("true"), "n")["error"].alias("e"), values.text_or_error(F.lit("  "), "title", 5)["error"].alias("t"), values.day_bounds(F.lit("1970-01-02").cast("date")).alias("b"),
    ).first()
    assert (float(r.m.amount), r.m.currency, r.m.error, r.none.error) == (2.34, "EUR", None, None)
    assert r.map == {"a": 1, "b": 3} and r.d is None and (r.e, r.t) == ("invalid_n", "missing_title") and tuple(r.b) == (86400, 172799)


def test_searches():
    assert checked_search("packages", {"text": " crm "}) == {"text": "crm", "size": 100}
    q = {"site": "so", "tags": ["B", "a", "a"], "from_date": "2026-01-01", "to_date": "2026-01-31"}
    assert checked_search("questions", q)["tags"] == ["a", "b"]
    bad = [("packages", {"text": ""}), ("packages", {"text": "x", "size": True}), ("packages", {"text": "x", "size": 251}), ("packages", {"text": "x", "more": 1}), ("repositories", {"q": "x" * 257}), ("repositories", {"q": "x", "sort": "created"}),
           ("questions", q | {"to_date": "2026-02-01"}), ("questions", q | {"to_date": "2025-01-01"}), ("questions", q | {"tags": []}), ("questions", q | {"tags": ["a;b"]}), ("nowhere", {})]
    for source, query in bad:
        with pytest.raises(SearchError):
            checked_search(source, query)


def test_lists_and_reports(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "i int, k string")
    assert [r.i for r in reads.listed(df, {"k": "a", "i": None}, order=[F.col("i").desc()], limit=1).collect()] == [3]
    with pytest.raises(ValueError):
        reads.listed(df, limit=1001)
    assert reads.report_json(df).first().value == '{"i":1,"k":"a"}'


def test_claim_fingerprint_follows_its_evidence(spark):
    c = spark.createDataFrame([(1, 5, "solution_gap", "s")], "claim long, cluster long, claim_type string, statement string")
    m = spark.createDataFrame([(5, 10), (5, 11)], "cluster long, evidence long")
    o = spark.createDataFrame([], "cluster long, outcome long, outcome_type string, direction string")
    link = lambda rows: spark.createDataFrame(rows, "claim long, kind string, target long, direction string")
    mark = lambda rows: claims.proposals(c, link(rows), m, o).first()
    a, b = (1, "evidence", 10, "supports"), (1, "evidence", 11, "supports")
    assert mark([a, b]).fingerprint == mark([b, a, a]).fingerprint != mark([a]).fingerprint
    assert mark([a]).action == "pending_review" and mark([(1, "evidence", 12, "supports")]).action == "evidence_outside_cluster"
    assert mark([a, (1, "evidence", 10, "refutes")]).action == "evidence_on_both_sides"
