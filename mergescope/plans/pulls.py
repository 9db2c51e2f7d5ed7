"""Pull-request feature tables: from flat landed tables and from nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quality, scalar, sentiment, tables, text
from ..operators.joins import lookup_join
from ..session import materialise, task_count

PULL_COLUMNS = [
    "pr_id", "repository_name", "title_length", "description_length", "files_changed", "lines_added", "lines_deleted",
    "time_to_merge", "num_commits", "is_bug_fix", "num_comments", "num_reviewers", "merge_status",
    "author_experience", "author_tenure", "author_contributions", "review_time", "num_approvals",
    "review_sentiment_score", "security_issues", "code_quality_issues", "code_quality_rate",
]


def by_state(pulls: DataFrame, state: str = "all") -> DataFrame:
    return pulls if state == "all" else pulls.where(F.col("state") == state)


def zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


# --- one aggregate per child table ---------------------------------------------------------------
def review_totals(reviews: DataFrame) -> DataFrame:
    """Per pull: distinct reviewers, approvals, and the sum of submission times as whole seconds and micros.

    The time sums are kept apart from the pull's own creation time, so raw reviews are never joined to pulls:
    sum(submitted - created) = sum(submitted) - n * created.
    """
    at = scalar.micros(F.col("submitted_at"))
    return reviews.groupBy("pr_id").agg(
        F.countDistinct("reviewer").alias("num_reviewers"),
        F.count_if(F.col("state") == "APPROVED").alias("num_approvals"),
        F.count("submitted_at").alias("_submitted"),
        F.sum(F.floor(at / 1_000_000).cast("long")).alias("_seconds"),
        F.sum(F.pmod(at, F.lit(1_000_000))).alias("_micros"),
    )


def review_hours(created: Column) -> Column:
    at = scalar.micros(created)
    seconds = F.col("_seconds") - F.col("_submitted") * F.floor(at / 1_000_000).cast("long")
    micros = F.col("_micros") - F.col("_submitted") * F.pmod(at, F.lit(1_000_000))
    return F.coalesce((seconds + micros / F.lit(1_000_000)) / F.lit(3600), F.lit(0.0))


def file_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("pr_id").agg(
        F.count(F.lit(1)).alias("files_changed"), F.sum("additions").alias("lines_added"),
        F.sum("deletions").alias("lines_deleted"))


def joined_lines(rows: DataFrame, keys: list[str], position: str, texts: list[str], last: list[str] | None = None,
                 block_width: int | None = None, size: int = 0) -> DataFrame:
    """Newline-join texts per key in position order, nulls skipped; of the ``last`` columns keep the last value.

    Rows are range-sorted by key and position, so a key with very many rows is several partitions. Each partition strings
    its run of a key together; the last step only strings a key's runs together, one a partition. With ``block_width`` a
    run ends after so many numeric positions too. ``size`` is the number of rows of the largest table that ``rows`` come from.
    """
    last = last or []
    place = F.spark_partition_id()
    run = place if block_width is None else F.struct(place.alias("part"), F.floor(F.col(position) / block_width).alias("block"))

    def gather(text: str, place: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(F.col(place).alias("p"), F.col(text).alias("t")))))

    def string(text: str) -> Column:
        return F.array_join(F.transform(text, lambda s: s["t"]), "\n")

    # Written before the ranges are sampled, so that nothing upstream runs twice; and after, so that the cut stays.
    rows = materialise(rows.select(*keys, position, *texts, *last), "lines", size)
    tasks = task_count(rows.sparkSession, rows.count())
    order = [*keys, position]
    ranged = rows.repartitionByRange(tasks, *order) if tasks else rows.repartitionByRange(*order)
    ranged = materialise(ranged.withColumn("_run", run), "runs")
    latest = {c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(position).alias("p"), F.col(c).alias("v")))) for c in last}
    runs = ranged.groupBy(*keys, "_run").agg(*[gather(t, position).alias(t) for t in texts], *[value.alias(c) for c, value in latest.items()])
    joined = runs.select(*keys, "_run", *[F.when(F.size(t) > 0, string(t)).alias(t) for t in texts], *last)
    final = joined.groupBy(*keys).agg(*[gather(t, "_run").alias(t) for t in texts], *[F.max(c).alias(c) for c in last])
    return final.select(*keys, *[string(t).alias(t) for t in texts], *[F.col(c)["v"].alias(c) for c in last])


def last_value(rows: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """The value at the highest position; rows without one are skipped."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, position).alias(value))


def commit_counts(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repository_name", "author").agg(F.count(F.lit(1)).alias("author_experience"))


def bug_flags(labels: DataFrame, name: str = "bug") -> DataFrame:
    return labels.where(F.col("name") == name).select("pr_id").distinct().withColumn("is_bug_fix", F.lit(True))


def repository_facts(commits: DataFrame, repositories: DataFrame | None = None) -> DataFrame:
    """(repository_name, repo_activity_level[, repo_size in MB from size in KB])."""
    activity = commits.groupBy("repository_name").agg(F.count(F.lit(1)).alias("repo_activity_level"))
    if repositories is None:
        return activity
    return activity.join(repositories.select("repository_name", (F.col("size") / 1024).alias("repo_size")), "repository_name", "left")


def file_facts(code_files: DataFrame, findings: DataFrame, function_rows: DataFrame) -> DataFrame:
    """(file_id, issues, rating, security): what each file contributes to the pulls that touch it."""
    named = code_files.withColumn("language", text.language_of(F.col("path")))
    checked = quality.with_issues(named.where(F.col("language").isNotNull()))
    issues = checked.select("file_id", F.array_join("issues", "\n").alias("issues"), "language")
    sizes = quality.size_summary(function_rows, "file_id", "nloc", "ccn", "tokens")
    ratings = sizes.select("file_id", quality.rating().alias("rating"))
    hits = security_hits(findings)
    facts = issues.join(hits, "file_id", "left").join(ratings, "file_id", "left")
    security = F.when(F.col("language").isin(tables.SECURITY_LANGUAGES), F.col("security"))
    return facts.select("file_id", "issues", "rating", security.alias("security"))


def security_hits(findings: DataFrame) -> DataFrame:
    """(file_id, security): a one-line summary of a file's errors and warnings; files without any are absent."""
    counts = findings.where(F.col("type").isin("error", "warning")).groupBy("file_id").agg(
        F.count_if(F.col("type") == "error").alias("e"), F.count_if(F.col("type") == "warning").alias("w"))
    return counts.select("file_id", F.format_string("%d errors, %d warnings", "e", "w").alias("security"))


# --- flat job ------------------------------------------------------------------------------------
def basic_features(pulls: DataFrame, reviews: DataFrame) -> DataFrame:
    """Features of pulls and their reviews alone."""
    joined = pulls.join(review_totals(reviews), "pr_id", "left")
    return joined.select(
        "pr_id", "repository_name",
        text.text_length(F.col("title")).alias("title_length"), text.text_length(F.col("body")).alias("description_length"),
        scalar.hours_between(F.col("created_at"), F.col("merged_at")).alias("time_to_merge"),
        F.col("commits").alias("num_commits"),
        (F.col("comments") + F.col("review_comments")).alias("num_comments"),
        zero("num_reviewers").alias("num_reviewers"),
        F.col("merged").alias("merge_status"),
        review_hours(F.col("created_at")).alias("review_time"),
        zero("num_approvals").alias("num_approvals"),
    )


def pull_features(
    pulls: DataFrame, reviews: DataFrame, files: DataFrame, commits: DataFrame, authors: DataFrame, labels: DataFrame,
    comments: DataFrame, lexicon: DataFrame, facts: DataFrame, state: str = "all",
) -> DataFrame:
    """One row per pull with all feature columns.

    Every child table is aggregated to one row per pull before it is joined, so the joins are one-to-one on
    ``pr_id``; only authors and commits are looked up by keys that pulls share, and before the texts are there.
    """
    # Without a filter on state a pull's children are all wanted, so they are aggregated as they are.
    pulls = by_state(pulls, state)
    size = files.count()
    touched = lookup_join(files.select("pr_id", "position", "file_id"), facts, ["file_id"], how="inner")
    lines = joined_lines(touched, ["pr_id"], "position", ["security", "issues"], last=["rating"], size=size)
    moods = sentiment.pull_sentiment(comments, lexicon, ["pr_id"], ["position"])
    joined = lookup_join(pulls, commit_counts(commits), ["repository_name", "author"])
    joined = lookup_join(joined, authors, ["author"])
    # Each join sorts both sides in a task, so the pulls are dealt by the number of their children's rows.
    tasks = task_count(pulls.sparkSession, size)
    joined = joined.repartition(tasks, "pr_id") if tasks else joined
    for child in (review_totals(reviews), file_totals(files), bug_flags(labels), moods, lines):
        joined = joined.join(child, "pr_id", "left")
    return joined.select(
        "pr_id", "repository_name",
        text.text_length(F.col("title")).alias("title_length"), text.text_length(F.col("body")).alias("description_length"),
        zero("files_changed").alias("files_changed"), zero("lines_added").alias("lines_added"),
        zero("lines_deleted").alias("lines_deleted"),
        scalar.hours_between(F.col("created_at"), F.col("merged_at")).alias("time_to_merge"),
        F.col("commits").alias("num_commits"),
        F.coalesce("is_bug_fix", F.lit(False)).alias("is_bug_fix"),
        (F.col("comments") + F.col("review_comments")).alias("num_comments"),
        zero("num_reviewers").alias("num_reviewers"),
        F.col("merged").alias("merge_status"),
        zero("author_experience").alias("author_experience"),
        scalar.tenure_months(F.col("joined_at"), F.col("created_at")).alias("author_tenure"),
        F.col("contributions").alias("author_contributions"),
        review_hours(F.col("created_at")).alias("review_time"),
        zero("num_approvals").alias("num_approvals"),
        F.coalesce("review_sentiment_score", F.lit(0.0)).alias("review_sentiment_score"),
        F.coalesce("security", F.lit("")).alias("security_issues"),
        F.coalesce("issues", F.lit("")).alias("code_quality_issues"),
        F.col("rating").alias("code_quality_rate"),
    )


# --- nested job ----------------------------------------------------------------------------------
def nested_features(documents: DataFrame) -> DataFrame:
    """The features a nested document holds by itself; arrays are reduced in place, nothing is exploded."""
    reviewers = F.coalesce(F.size(F.array_distinct(F.transform("reviews", lambda r: r["user"]))), F.lit(0))
    hours = F.aggregate("reviews", F.lit(0.0), lambda total, r: total + F.coalesce(r["review_time"], F.lit(0.0)))
    approvals = F.size(F.filter("reviews", lambda r: r["state"] == "APPROVED"))
    has_reviews = F.col("reviews").isNotNull()
    return documents.select(
        F.col("number").alias("pr_id"), "repository_name",
        text.text_length(F.col("title")).alias("title_length"), text.text_length(F.col("body")).alias("description_length"),
        zero("changed_files").alias("files_changed"), zero("additions").alias("lines_added"), zero("deletions").alias("lines_deleted"),
        "time_to_merge", zero("commits").alias("num_commits"),
        scalar.has_label(F.col("labels")).alias("is_bug_fix"),
        (zero("comments") + zero("review_comments")).alias("num_comments"),
        F.when(has_reviews, reviewers).otherwise(0).alias("num_reviewers"),
        F.coalesce("merged", F.lit(False)).alias("merge_status"),
        zero("author_experience").alias("author_experience"),
        F.coalesce("author_tenure", F.lit(0.0)).alias("author_tenure"),
        zero("author_contributions").alias("author_contributions"),
        F.coalesce(hours, F.lit(0.0)).alias("review_time"),
        F.when(has_reviews, approvals).otherwise(0).alias("num_approvals"),
    )


def path_facts(code_files: DataFrame) -> DataFrame:
    """(path, issues, complexity) of source texts; complexity for Python only."""
    named = code_files.withColumn("language", text.language_of(F.col("path"))).where(F.col("language").isNotNull())
    checked = quality.with_issues(named, older=True)
    score = F.when(F.col("ext") == "py", text.cyclomatic_complexity(F.col("content")))
    return checked.select("path", F.array_join("issues", "\n").alias("issues"), score.alias("complexity"))


def document_features(documents: DataFrame, lexicon: DataFrame, facts: DataFrame) -> DataFrame:
    """Nested documents with their files' facts and their comments' polarity."""
    keys = ["repository_name", "number"]
    touched = documents.select(*keys, F.posexplode("files").alias("position", "f")).select(*keys, "position", F.col("f.filename").alias("path"))
    touched = lookup_join(touched, facts, ["path"], how="inner")
    lines = joined_lines(touched, keys, "position", ["issues"])
    scores = touched.groupBy(*keys).agg(F.avg("complexity").alias("complexity_score"))
    said = documents.select(*keys, F.posexplode("issue_comments").alias("position", "c")).select(*keys, "position", F.col("c.body").alias("body"))
    moods = sentiment.pull_sentiment(said, lexicon, keys, ["position"])
    rename = {"number": "pr_id"}
    result = nested_features(documents)
    for child in (lines, scores, moods):
        result = result.join(child.withColumnsRenamed(rename), ["repository_name", "pr_id"], "left")
    return result.select(
        *nested_features(documents).columns,
        F.coalesce("complexity_score", F.lit(0.0)).alias("complexity_score"),
        F.coalesce("review_sentiment_score", F.lit(0.0)).alias("review_sentiment_score"),
        F.coalesce("issues", F.lit("")).alias("code_quality_issues"),
    )
