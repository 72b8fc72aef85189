"""The normalisers over payloads made from the driver's tables, against SQL over the columns they were made from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.plans.registry import query, table
from evidentia.sources import normalize

us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
K = "o_orderkey"
DAY = f"'2026-01-0' || (1 + {K} % 9) || 'T00:00:00Z'"
DAY_US = f"epoch_us(TIMESTAMP '2026-01-01' + to_days(({K}%9)::int))::bigint"


def raw(spark: SparkSession, sf: str, payload: str) -> DataFrame:
    """A snapshot of every order with the payload that the expression makes."""
    return table(spark, sf, "orders").selectExpr(f"{K} AS snapshot_id", "cast(o_orderdate AS timestamp) AS observed_at", f"{payload} AS payload")


WORK = f"""'{{"id": ' || {K} || ', "number": ' || ({K} % 100) || ', "repository_url": "https://api.github.com/repos/Org/Repo' || ({K} % 20) || '", "title": "' || CASE WHEN {K} % 11 = 0 THEN '  ' ELSE ' T' || {K} || ' ' END
 || '", "state": "' || CASE WHEN {K} % 2 = 0 THEN 'open' ELSE 'closed' END || '", "labels": [{{"name": "Bug"}}, {{"name": "P' || ({K} % 3) || '"}}], "comments": ' || ({K} % 9 - 2) || ', "user": {{"login": "' || CASE WHEN {K} % 4 = 0 THEN 'dep[BOT]' ELSE 'ann' END
 || '", "type": "' || CASE WHEN {K} % 6 = 0 THEN 'Bot' ELSE 'User' END || '"}}, "created_at": "' || CASE WHEN {K} % 13 = 0 THEN 'nope' ELSE {DAY} END || '"' || CASE WHEN {K} % 5 = 0 THEN ', "pull_request": {{"url": "x"}}' ELSE '' END || '}}'"""


@query(f"""SELECT {K} AS external_id, {K}%100 AS number, 'org/repo'||({K}%20) AS repository, CASE WHEN {K}%11<>0 THEN 'T'||{K} END AS title, CASE WHEN {K}%2=0 THEN 'open' ELSE 'closed' END AS state, 'bug,p'||({K}%3) AS labels, greatest({K}%9-2,0)::int AS comments,
 {K}%4=0 OR {K}%6=0 AS is_bot, {K}%5=0 AS is_pull_request, CASE WHEN {K}%13<>0 THEN {DAY_US} END AS created_us, CASE WHEN {K}%11=0 THEN 'missing_title' WHEN {K}%13=0 THEN 'invalid_created_at' END AS error_class FROM orders""")
def work_items_normalised(spark: SparkSession, sf: str) -> DataFrame:
    w = normalize.work_items(raw(spark, sf, WORK))
    return w.select("external_id", "number", "repository", "title", "state", F.array_join("labels", ",").alias("labels"), "comments", "is_bot", "is_pull_request", us("created_at").alias("created_us"), "error_class")


REPO = f"""'{{"id": ' || CASE WHEN {K} % 17 = 0 THEN 'null' ELSE cast({K} AS varchar(20)) END || ', "full_name": "Org/Repo' || {K} || '", "owner": {{"login": "Org"}}, "description": "' || CASE WHEN {K} % 3 = 0 THEN '' ELSE ' d' || {K} END || '", "license": {{"spdx_id": "MIT"}}, "created_at": "' || {DAY}
 || '", "updated_at": "' || {DAY} || '", "archived": ' || CASE WHEN {K} % 7 = 0 THEN 'true' ELSE 'null' END || ', "stargazers_count": ' || ({K} % 50 - 5) || ', "open_issues_count": ' || ({K} % 8) || ', "topics": ["a", "t' || ({K} % 4) || '"]}}'"""


@query(f"""SELECT CASE WHEN {K}%17<>0 THEN {K} END AS external_id, 'Org/Repo'||{K} AS full_name, 'org/repo'||{K} AS match_name, 'Org' AS owner, CASE WHEN {K}%3<>0 THEN 'd'||{K} END AS description, 'MIT' AS license, {DAY_US} AS created_us, {K}%7=0 AS archived,
 greatest({K}%50-5,0)::int AS stars, ({K}%8)::int AS open_issues, 'a,t'||({K}%4) AS topics, CASE WHEN {K}%17=0 THEN 'missing_id' END AS error_class FROM orders""")
def repositories_normalised(spark: SparkSession, sf: str) -> DataFrame:
    r = normalize.repositories(raw(spark, sf, REPO))
    return r.select("external_id", "full_name", "match_name", "owner", "description", "license", us("created_at").alias("created_us"), "archived", "stars", "open_issues", "topics", "error_class")


PACKAGE = f"""'{{"name": "' || CASE WHEN {K} % 19 = 0 THEN ' ' ELSE 'p' || (o_custkey % 400) END || '", "description": "about", "license": "L' || ({K} % 3) || '", "repository": {{"url": "' || CASE WHEN {K} % 2 = 0 THEN 'git+https://github.com/Own/R' || ({K} % 30) || '.git' ELSE 'https://example.com/x' END
 || '"}}, "dist-tags": {{"latest": "1.' || ({K} % 6) || '"}}, "time": {{"1.0": "' || {DAY} || '"}}, "versions": {{"1.0": {{"license": "MIT"}}, "1.' || (1 + {K} % 5) || '": {{"license": "L' || ({K} % 3) || '"}}}}}}'"""


@query(f"""SELECT {K} AS snapshot_id, CASE WHEN {K}%19=0 THEN ' ' ELSE 'p'||(o_custkey%400) END AS name, 'L'||({K}%3) AS license, '1.'||({K}%6) AS latest_version, CASE WHEN {K}%2=0 THEN 'own/r'||({K}%30) END AS repository, CASE WHEN {K}%2=0 THEN 'github_https_url' END AS match_method,
 2::int AS n_versions, CASE WHEN {K}%19=0 THEN 'missing_name' END AS error_class FROM orders""")
def packages_normalised(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.packages(raw(spark, sf, PACKAGE)).select("snapshot_id", "name", "license", "latest_version", "repository", "match_method", "n_versions", "error_class")


@query(f"""WITH v AS (SELECT CASE WHEN {K}%19=0 THEN ' ' ELSE 'p'||(o_custkey%400) END AS name, unnest(['1.0', '1.'||(1+{K}%5)]) AS version, o_orderdate AS seen, {K} AS id FROM orders),
 x AS (SELECT name, version, CASE WHEN version='1.0' THEN 'MIT' ELSE 'L'||(id%3) END AS license, CASE WHEN version='1.0' THEN epoch_us(TIMESTAMP '2026-01-01' + to_days((id%9)::int))::bigint END AS p, seen, id FROM v)
 SELECT name, version, arg_min(license, struct_pack(a:=seen,i:=id)) AS license, CASE WHEN version='1.0' THEN arg_min(p, struct_pack(a:=seen,i:=id)) END AS published_us FROM x GROUP BY name, version""")
def package_versions_once(spark: SparkSession, sf: str) -> DataFrame:
    """Every version as it was first met."""
    return normalize.package_versions(raw(spark, sf, PACKAGE)).select("name", "version", "license", us("published_at").alias("published_us"))


QUESTION = f"""'{{"site": "so", "question_id": ' || {K} || ', "title": "A &lt; B' || {K} || '", "body": "<p>x &amp; y</p><br/>z' || ({K} % 5) || '", "tags": ["B", " a ", "a", "t' || ({K} % 7) || '"], "creation_date": ' || CASE WHEN {K} % 23 = 0 THEN 'null' ELSE cast(1700000000 + {K} AS varchar(20)) END
 || ', "answer_count": ' || ({K} % 4 - 1) || ', "is_answered": ' || CASE WHEN {K} % 2 = 0 THEN 'true' ELSE 'null' END || ', "score": ' || ({K} % 9 - 4) || '}}'"""


@query(f"""SELECT 'so:'||{K} AS external_id, 'A < B'||{K} AS title, 'x & y'||chr(10)||chr(10)||chr(10)||'z'||({K}%5) AS body, 'a,b,t'||({K}%7) AS tags, CASE WHEN {K}%23<>0 THEN (1700000000+{K})*1000000 END::bigint AS created_us, greatest({K}%4-1,0)::int AS answers,
 {K}%2=0 AS is_answered, ({K}%9-4)::int AS score, CASE WHEN {K}%23=0 THEN 'invalid_creation_date' END AS error_class FROM orders""")
def questions_normalised(spark: SparkSession, sf: str) -> DataFrame:
    q = normalize.questions(raw(spark, sf, QUESTION))
    return q.select("external_id", "title", "body", F.array_join("tags", ",").alias("tags"), us("created_at").alias("created_us"), "answers", "is_answered", "score", "error_class")


@query(f"""WITH d AS (SELECT o_custkey%400 AS k, arg_max(struct_pack(d:=CASE WHEN {K}%3<>0 THEN 'd'||{K} END, h:=CASE WHEN {K}%2=0 THEN 'h'||{K} END), struct_pack(t:=o_orderdate,i:={K})) AS x FROM orders WHERE o_orderstatus='O' GROUP BY 1),
 s AS (SELECT o_custkey%400 AS k, max('s'||lpad({K}::varchar,8,'0')) AS description FROM orders WHERE o_orderstatus='F' GROUP BY 1)
 SELECT coalesce(d.k,s.k) AS name, coalesce(x.d,s.description) AS description, x.h AS homepage FROM d FULL JOIN s ON d.k=s.k""")
def packages_filled(spark: SparkSession, sf: str) -> DataFrame:
    """Packages in detail, with gaps filled from what searches know."""
    o = table(spark, sf, "orders")
    d = o.where("o_orderstatus = 'O'").selectExpr("o_custkey % 400 AS name", f"CASE WHEN {K} % 3 <> 0 THEN 'd' || {K} END AS description", f"CASE WHEN {K} % 2 = 0 THEN 'h' || {K} END AS homepage", "cast(o_orderdate AS timestamp) AS updated", f"{K} AS arrival")
    detail = normalize.merge_late(d, ["name"], "updated", "arrival").select("name", "description", "homepage")
    search = o.where("o_orderstatus = 'F'").selectExpr("o_custkey % 400 AS name", f"'s' || lpad(cast({K} AS string), 8, '0') AS description").groupBy("name").agg(F.max("description").alias("description"))
    return normalize.fill_from(detail, search.withColumn("homepage", F.lit(None).cast("string")), "name", ["description", "homepage"])
