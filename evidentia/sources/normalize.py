"""Raw JSON of four sources to tables, and merges that late data can't undo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import html_text, repository_reference

REPOSITORY = "id bigint, name string, full_name string, owner struct<login:string>, html_url string, description string, homepage string, language string, license struct<spdx_id:string>, default_branch string, created_at string, updated_at string, pushed_at string, archived boolean, disabled boolean, stargazers_count int, forks_count int, open_issues_count int, topics array<string>"
WORK_ITEM = "id bigint, number bigint, repository_url string, html_url string, title string, body string, state string, labels array<struct<name:string>>, comments int, author_association string, user struct<login:string,type:string>, created_at string, updated_at string, closed_at string, pull_request struct<url:string>"
PACKAGE = "_id string, name string, description string, license string, repository struct<type:string,url:string,directory:string>, homepage string, `dist-tags` map<string,string>, time map<string,string>, versions map<string,struct<name:string,version:string,license:string>>"
QUESTION = "site string, question_id bigint, title string, body string, link string, tags array<string>, creation_date bigint, last_activity_date bigint, answer_count int, is_answered boolean, view_count int, score int, content_license string"


def clean(x: Column, most: int | None = None) -> Column:
    """Trimmed text, null if empty, cut to `most` characters."""
    t = F.nullif(F.trim(x), F.lit(""))
    return t if most is None else F.left(t, F.lit(most))


def non_negative(x: Column) -> Column:
    return F.when(x >= 0, x).otherwise(F.lit(0))


def when(x: Column) -> Column:
    return F.try_to_timestamp(x)


def is_bot(user: Column) -> Column:
    return F.coalesce((user["type"] == "Bot") | F.lower(user["login"]).endswith("[bot]"), F.lit(False))


def tags(x: Column, most: int = 35) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(x, lambda t: F.left(F.lower(F.trim(t)), F.lit(most))), lambda t: t != "")))


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    return raw.withColumn("j", F.from_json("payload", schema))


def repositories(raw: DataFrame) -> DataFrame:
    """From (snapshot_id, observed_at, payload): one row each, with error_class where what is required is missing."""
    j = _parsed(raw, REPOSITORY)
    error = F.when(F.col("j.id").isNull(), "missing_id").when(clean(F.col("j.full_name")).isNull(), "missing_full_name").when(when(F.col("j.created_at")).isNull(), "invalid_created_at")
    return j.select(
        "snapshot_id", "observed_at", F.col("j.id").alias("external_id"), clean(F.col("j.full_name")).alias("full_name"), F.lower("j.full_name").alias("match_name"),
        F.col("j.owner.login").alias("owner"), clean(F.col("j.description"), 2000).alias("description"), F.col("j.language").alias("language"), F.col("j.license.spdx_id").alias("license"),
        when(F.col("j.created_at")).alias("created_at"), when(F.col("j.updated_at")).alias("updated_at"), F.coalesce("j.archived", F.lit(False)).alias("archived"),
        non_negative(F.coalesce("j.stargazers_count", F.lit(0))).alias("stars"), non_negative(F.coalesce("j.open_issues_count", F.lit(0))).alias("open_issues"),
        F.array_join(F.coalesce("j.topics", F.array().cast("array<string>")), ",").alias("topics"), error.alias("error_class"),
    )


def work_items(raw: DataFrame) -> DataFrame:
    """Issues and pull requests, told apart by the presence of the latter's key."""
    j = _parsed(raw, WORK_ITEM)
    repo = F.lower(F.regexp_extract("j.repository_url", r"/repos/([^/]+/[^/]+)$", 1))
    error = F.when(F.col("j.id").isNull(), "missing_id").when(clean(F.col("j.title")).isNull(), "missing_title").when(when(F.col("j.created_at")).isNull(), "invalid_created_at").when(repo == "", "invalid_repository_url")
    return j.select(
        "snapshot_id", "observed_at", F.col("j.id").alias("external_id"), "j.number", repo.alias("repository"), clean(F.col("j.title"), 1000).alias("title"), clean(F.col("j.body")).alias("body"),
        F.col("j.state").alias("state"), F.transform("j.labels", lambda x: F.lower(x["name"])).alias("labels"), non_negative(F.coalesce("j.comments", F.lit(0))).alias("comments"),
        is_bot(F.col("j.user")).alias("is_bot"), F.col("j.pull_request").isNotNull().alias("is_pull_request"), when(F.col("j.created_at")).alias("created_at"),
        when(F.col("j.updated_at")).alias("updated_at"), when(F.col("j.closed_at")).alias("closed_at"), error.alias("error_class"),
    )


def packages(raw: DataFrame) -> DataFrame:
    j = _parsed(raw, PACKAGE)
    link = repository_reference(F.col("j.repository.url"))
    return j.select(
        "snapshot_id", "observed_at", F.col("j.name").alias("name"), clean(F.col("j.description"), 2000).alias("description"), F.col("j.license").alias("license"),
        F.try_element_at("j.dist-tags", F.lit("latest")).alias("latest_version"), link["full_name"].alias("repository"), link["method"].alias("match_method"),
        F.size(F.coalesce(F.map_keys("j.versions"), F.array().cast("array<string>"))).alias("n_versions"), F.when(clean(F.col("j.name")).isNull(), "missing_name").alias("error_class"),
    )


def package_versions(raw: DataFrame) -> DataFrame:
    """A row for each version; of one met again the first stays as it was."""
    j = _parsed(raw, PACKAGE).select("observed_at", "snapshot_id", F.col("j.name").alias("name"), F.col("j.time").alias("time"), F.explode("j.versions").alias("version", "v"))
    rows = j.select("name", "version", F.col("v.license").alias("license"), when(F.try_element_at("time", "version")).alias("published_at"), "observed_at", "snapshot_id")
    return rows.groupBy("name", "version").agg(F.min_by(F.struct("license", "published_at"), F.struct("observed_at", "snapshot_id")).alias("r")).select("name", "version", "r.*")


def questions(raw: DataFrame) -> DataFrame:
    j = _parsed(raw, QUESTION)
    error = F.when(F.col("j.question_id").isNull(), "missing_id").when(clean(F.col("j.title")).isNull(), "missing_title").when(F.col("j.creation_date").isNull(), "invalid_creation_date")
    return j.select(
        "snapshot_id", "observed_at", F.concat_ws(":", "j.site", F.col("j.question_id").cast("string")).alias("external_id"), clean(html_text(F.col("j.title")), 1000).alias("title"),
        clean(html_text(F.col("j.body"))).alias("body"), tags(F.col("j.tags")).alias("tags"), F.timestamp_seconds("j.creation_date").alias("created_at"), F.timestamp_seconds("j.last_activity_date").alias("updated_at"),
        non_negative(F.coalesce("j.answer_count", F.lit(0))).alias("answers"), F.coalesce("j.is_answered", F.lit(False)).alias("is_answered"), F.coalesce("j.score", F.lit(0)).alias("score"), error.alias("error_class"),
    )


def merge_late(rows: DataFrame, keys: list[str], updated: str, arrival: str) -> DataFrame:
    """The row that stands after all have arrived: a newer or equal one replaces, one without a time never does."""
    order = F.struct(F.coalesce(F.col(updated), F.timestamp_seconds(F.lit(-62135596800))), F.col(arrival))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("_r")).select(*keys, "_r.*")


def fill_from(detail: DataFrame, search: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Detail rows with their gaps filled from search rows; keys only searched keep what search knows."""
    d, s = detail.alias("d"), search.alias("s")
    return d.join(s, key, "full_outer").select(key, *[F.coalesce(F.col(f"d.{f}"), F.col(f"s.{f}")).alias(f) for f in fields])


def missing_repositories(items: DataFrame, known: DataFrame) -> DataFrame:
    """Repositories that work items name and no dimension has: what is to be fetched."""
    return items.where("repository <> ''").select("repository").distinct().join(known.select(F.col("match_name").alias("repository")), "repository", "left_anti")
