"""Queries over pull requests, their children and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import lint, quality, scalar, sentiment, tables, text
from ..operators.joins import lookup_join
from ..plans import pulls as plans
from ..plans.cleaning import binarise_at_median
from .registry import query, rating_sql, sql_list
from .texts import COMPLEXITY, LANG, NAMED, NEWER, OLDER, SECURITY, issues_sql

HOURS = "(epoch_us({1}) - epoch_us({0})) / 3600000000::DOUBLE"


def hours(a: str, b: str) -> str:
    return HOURS.format(a, b)


TENURE = "floor((epoch_us(created_at) - epoch_us(joined_at)) / 86400000000::DOUBLE) / 30"

BASIC = f"""SELECT pr_id, repository_name, length(title) title_length, coalesce(length(body), 0) description_length,
  round({hours('created_at', 'merged_at')}, 6) time_to_merge, commits num_commits, comments + review_comments num_comments,
  coalesce(num_reviewers, 0) num_reviewers, merged merge_status, round(coalesce(review_time, 0), 6) review_time,
  coalesce(num_approvals, 0) num_approvals
FROM pulls LEFT JOIN (SELECT pr_id, count(DISTINCT reviewer) num_reviewers,
  sum({hours('created_at', 'submitted_at')}) review_time, count(*) FILTER (WHERE reviews.state = 'APPROVED') num_approvals
  FROM pulls JOIN reviews USING (pr_id) GROUP BY pr_id) USING (pr_id)"""


@query("basic_pull_features", "A1 A2 A3 F1 F24 J1 P13", BASIC, "pulls reviews")
def _(spark, sf):
    df = plans.basic_features(views.pulls(spark, sf), views.reviews(spark, sf))
    return df.withColumns({c: F.round(c, 6) for c in ("time_to_merge", "review_time")})


@query("slow_review_flags", "P11 A2", f"""
SELECT pr_id, review_time, (review_time >= median(review_time) OVER ())::INT slow FROM ({BASIC})""", "pulls reviews")
def _(spark, sf):
    df = plans.basic_features(views.pulls(spark, sf), views.reviews(spark, sf)).select("pr_id", F.round("review_time", 6).alias("review_time"))
    return binarise_at_median(df, "review_time", "slow")


@query("closed_pulls", "P5", "SELECT pr_id, repository_name, merged FROM pulls WHERE state = 'closed'", "pulls")
def _(spark, sf):
    return plans.by_state(views.pulls(spark, sf), "closed").select("pr_id", "repository_name", "merged")


@query("submitted_reviews", "P8", "SELECT pr_id, reviewer, state FROM reviews WHERE submitted_at IS NOT NULL", "reviews")
def _(spark, sf):
    return views.reviews(spark, sf).where(F.col("submitted_at").isNotNull()).select("pr_id", "reviewer", "state")


@query("merge_hours", "F24", f"SELECT pr_id, round({hours('created_at', 'merged_at')}, 6) h FROM pulls", "pulls")
def _(spark, sf):
    return views.pulls(spark, sf).select("pr_id", F.round(scalar.hours_between(F.col("created_at"), F.col("merged_at")), 6).alias("h"))


@query("author_profiles", "J6 F25", f"""
SELECT pr_id, round({TENURE}, 6) author_tenure, contributions FROM pulls LEFT JOIN authors USING (author)""", "pulls authors")
def _(spark, sf):
    joined = lookup_join(views.pulls(spark, sf).select("pr_id", "author", "created_at"), views.authors(spark, sf), ["author"])
    return joined.select("pr_id", F.round(scalar.tenure_months(F.col("joined_at"), F.col("created_at")), 6).alias("author_tenure"), "contributions")


@query("author_experience", "J5 A8", """
SELECT pr_id, coalesce(n, 0) author_experience FROM pulls LEFT JOIN
 (SELECT repository_name, author, count(*) n FROM commits GROUP BY ALL) USING (repository_name, author)""", "pulls commits")
def _(spark, sf):
    counts = plans.commit_counts(views.commits(spark, sf))
    joined = lookup_join(views.pulls(spark, sf).select("pr_id", "repository_name", "author"), counts, ["repository_name", "author"])
    return joined.select("pr_id", plans.zero("author_experience").alias("author_experience"))


@query("bug_fix_flags", "J3 F26", """
SELECT pr_id, pr_id IN (SELECT pr_id FROM pull_labels WHERE name = 'bug') is_bug_fix FROM pulls""", "pulls pull_labels")
def _(spark, sf):
    joined = views.pulls(spark, sf).join(plans.bug_flags(views.pull_labels(spark, sf)), "pr_id", "left")
    return joined.select("pr_id", F.coalesce("is_bug_fix", F.lit(False)).alias("is_bug_fix"))


@query("file_totals", "J2", """
SELECT pr_id, coalesce(n, 0) files_changed, coalesce(a, 0) lines_added, coalesce(d, 0) lines_deleted FROM pulls LEFT JOIN
 (SELECT pr_id, count(*) n, sum(additions)::BIGINT a, sum(deletions)::BIGINT d FROM files GROUP BY pr_id) USING (pr_id)""", "pulls files")
def _(spark, sf):
    joined = views.pulls(spark, sf).select("pr_id").join(plans.file_totals(views.files(spark, sf)), "pr_id", "left")
    return joined.select("pr_id", *[plans.zero(c).alias(c) for c in ("files_changed", "lines_added", "lines_deleted")])


@query("repository_facts", "A9 J7 P12", """
SELECT pr_id, repo_activity_level, repo_activity_level * 37 / 1024::DOUBLE repo_size, 'mergescope' AS dataset FROM pulls JOIN
 (SELECT repository_name, count(*) repo_activity_level FROM commits GROUP BY ALL) USING (repository_name)""", "pulls commits")
def _(spark, sf):
    commits = views.commits(spark, sf)
    # Repository sizes in KB: 37 for each commit.
    sizes = commits.groupBy("repository_name").agg((F.count(F.lit(1)) * 37).alias("size"))
    joined = lookup_join(views.pulls(spark, sf).select("pr_id", "repository_name"), plans.repository_facts(commits, sizes), ["repository_name"])
    return joined.select("pr_id", "repo_activity_level", "repo_size").withColumn("dataset", F.lit("mergescope"))


POLARITY = """SELECT pr_id, position, avg(polarity) polarity FROM
  (SELECT pr_id, position, unnest(regexp_extract_all(lower(body), '[a-z]+')) word FROM comments) JOIN lexicon USING (word)
  GROUP BY pr_id, position"""


@query("comment_polarity", "F18", f"SELECT pr_id, position, round(polarity, 8) polarity FROM ({POLARITY})", "comments lexicon")
def _(spark, sf):
    df = sentiment.comment_polarity(views.comments(spark, sf), views.lexicon(spark, sf), ["pr_id", "position"])
    return df.withColumn("polarity", F.round("polarity", 8))


@query("pull_sentiment", "A4 J4", f"""
SELECT pr_id, round(coalesce(s, 0), 8) review_sentiment_score FROM pulls LEFT JOIN
 (SELECT pr_id, sum(polarity) s FROM ({POLARITY}) GROUP BY pr_id) USING (pr_id)""", "pulls comments lexicon")
def _(spark, sf):
    moods = sentiment.pull_sentiment(views.comments(spark, sf), views.lexicon(spark, sf), ["pr_id"], ["position"])
    joined = views.pulls(spark, sf).select("pr_id").join(moods, "pr_id", "left")
    return joined.select("pr_id", F.round(F.coalesce("review_sentiment_score", F.lit(0.0)), 8).alias("review_sentiment_score"))


ISSUES = f"SELECT file_id, language, {issues_sql(NEWER)} AS issues FROM {NAMED} WHERE language IS NOT NULL"
FACTS = f"""SELECT file_id, issues, rating, CASE WHEN language IN ({', '.join(repr(x) for x in tables.SECURITY_LANGUAGES)}) THEN security END security
  FROM ({ISSUES}) LEFT JOIN ({SECURITY}) USING (file_id) LEFT JOIN ratings USING (file_id)"""
FACT_VIEWS = "code_files findings function_rows sizes ratings"


def _facts(spark, sf):
    return plans.file_facts(views.code_files(spark, sf), views.findings(spark, sf), views.function_rows(spark, sf))


@query("joined_file_issues", "A6", f"""
SELECT pr_id, string_agg(security, chr(10) ORDER BY position) security, string_agg(issues, chr(10) ORDER BY position) issues
FROM files JOIN ({FACTS}) USING (file_id) GROUP BY pr_id""", "files " + FACT_VIEWS)
def _(spark, sf):
    touched = lookup_join(views.files(spark, sf), _facts(spark, sf), ["file_id"], how="inner")
    lines = plans.joined_lines(touched, ["pr_id"], "position", ["security", "issues"])
    return lines.withColumns({c: F.nullif(c, F.lit("")) for c in ("security", "issues")})


@query("last_file_rating", "A7", f"""
SELECT pr_id, arg_max(rating, position) rating FROM files JOIN ratings USING (file_id) GROUP BY pr_id""", "files function_rows sizes ratings")
def _(spark, sf):
    sizes = quality.size_summary(views.function_rows(spark, sf), "file_id", "nloc", "ccn", "tokens")
    touched = lookup_join(views.files(spark, sf), sizes.select("file_id", quality.rating().alias("rating")), ["file_id"], how="inner")
    return plans.last_value(touched, ["pr_id"], "position", "rating")


@query("mean_complexity", "A5", f"""
SELECT pr_id, round(coalesce(c, 0), 8) complexity_score FROM pulls LEFT JOIN (SELECT pr_id, avg({COMPLEXITY}) c
 FROM files JOIN code_files USING (file_id) WHERE ext = 'py' GROUP BY pr_id) USING (pr_id)""", "pulls files code_files")
def _(spark, sf):
    python = views.code_files(spark, sf).where(F.col("ext") == "py")
    scores = python.select("file_id", text.cyclomatic_complexity(F.col("content")).alias("c"))
    touched = lookup_join(views.files(spark, sf).select("pr_id", "file_id"), scores, ["file_id"], how="inner")
    means = touched.groupBy("pr_id").agg(F.avg("c").alias("c"))
    return views.pulls(spark, sf).select("pr_id").join(means, "pr_id", "left").select("pr_id", F.round(F.coalesce("c", F.lit(0.0)), 8).alias("complexity_score"))


FEATURES = f"""SELECT pr_id, repository_name, title_length, description_length, coalesce(n, 0) files_changed, coalesce(a, 0) lines_added,
  coalesce(d, 0) lines_deleted, time_to_merge, num_commits, is_bug_fix, num_comments, num_reviewers, merge_status,
  coalesce(e, 0) author_experience, round({TENURE}, 6) author_tenure, contributions author_contributions, review_time,
  num_approvals, round(coalesce(s, 0), 8) review_sentiment_score, coalesce(security, '') security_issues,
  coalesce(issues, '') code_quality_issues, rating code_quality_rate
FROM ({BASIC}) JOIN (SELECT pr_id, author, created_at, pr_id IN (SELECT pr_id FROM pull_labels WHERE name = 'bug') is_bug_fix FROM pulls) USING (pr_id)
LEFT JOIN authors USING (author)
LEFT JOIN (SELECT repository_name, author, count(*) e FROM commits GROUP BY ALL) USING (repository_name, author)
LEFT JOIN (SELECT pr_id, count(*) n, sum(additions)::BIGINT a, sum(deletions)::BIGINT d FROM files GROUP BY pr_id) USING (pr_id)
LEFT JOIN (SELECT pr_id, sum(polarity) s FROM ({POLARITY}) GROUP BY pr_id) USING (pr_id)
LEFT JOIN (SELECT pr_id, string_agg(security, chr(10) ORDER BY position) security, string_agg(issues, chr(10) ORDER BY position) issues,
  arg_max(rating, position) rating FROM files JOIN ({FACTS}) USING (file_id) GROUP BY pr_id) USING (pr_id)"""
FEATURE_VIEWS = "pulls reviews files commits authors pull_labels comments lexicon " + FACT_VIEWS


@query("pull_features", "Q1 P13 J1 J2 J3 J4 J5 J6", FEATURES, FEATURE_VIEWS)
def pull_features(spark, sf):
    df = plans.pull_features(
        views.pulls(spark, sf), views.reviews(spark, sf), views.files(spark, sf), views.commits(spark, sf),
        views.authors(spark, sf), views.pull_labels(spark, sf), views.comments(spark, sf), views.lexicon(spark, sf),
        _facts(spark, sf))
    rounded = {c: F.round(c, 6) for c in ("time_to_merge", "review_time", "author_tenure")}
    return df.withColumns({**rounded, "review_sentiment_score": F.round("review_sentiment_score", 8)})


SERIES = "generate_series(1, n % 4 + 1)"
PATH = f"repository_name||'/file_'||((number + i) % 100)||'.'||{sql_list(views.EXTENSIONS)}[((number + i) % 100 % 10 + 1)::INT]"
NESTED = f"""SELECT number pr_id, repository_name, length(title) title_length, coalesce(length(body), 0) description_length,
  n % 7 files_changed, n % 101 lines_added, n % 53 lines_deleted, CASE WHEN number % 2 = 0 THEN n / 8::DOUBLE END time_to_merge,
  n % 6 num_commits, n % 3 = 0 is_bug_fix, n % 5 + n % 3 num_comments,
  CASE WHEN n % 9 = 0 THEN 0 ELSE len(list_distinct(list_transform({SERIES}, lambda i: CASE WHEN (n + i) % 4 = 0 THEN 'none' ELSE 'user'||((n + i) % 3) END))) END num_reviewers,
  number % 2 = 0 merge_status, n % 40 author_experience, n / 16::DOUBLE author_tenure, n % 900 author_contributions,
  CASE WHEN n % 9 = 0 THEN 0 ELSE list_sum(list_transform({SERIES}, lambda i: CASE WHEN (n + i) % 5 = 0 THEN 0 ELSE i / 2::DOUBLE END)) END review_time,
  CASE WHEN n % 9 = 0 THEN 0 ELSE len(list_filter({SERIES}, lambda i: (n + i) % 2 = 0)) END num_approvals FROM documents_nested"""


@query("nested_pull_features", "Q2 A1 A2 A3 F26", NESTED, "documents_nested")
def _(spark, sf):
    return plans.nested_features(views.pull_documents(spark, sf))


@query("document_features", "Q2 A4 A5 A6 F18", f"""
SELECT x.*, round(coalesce(complexity, 0), 8) complexity_score, round(coalesce(s, 0), 7) review_sentiment_score, coalesce(issues, '') code_quality_issues
FROM ({NESTED}) x
LEFT JOIN (SELECT number pr_id, avg(CASE WHEN ext = 'py' THEN {COMPLEXITY} END) complexity, string_agg(issues, chr(10) ORDER BY i) issues
  FROM (SELECT number, i, {PATH} AS path FROM (SELECT number, repository_name, unnest({SERIES}) i FROM documents_nested))
  JOIN (SELECT path, ext, content, {issues_sql(OLDER)} AS issues FROM {NAMED} WHERE language IS NOT NULL) USING (path) GROUP BY number) USING (pr_id)
LEFT JOIN (SELECT number pr_id, sum(p) s FROM (SELECT number, position, avg(polarity) p FROM
   (SELECT number, position, unnest(regexp_extract_all(lower(lines[position]), '[a-z]+')) word FROM
     (SELECT number, lines, unnest(generate_series(1, len(lines))) AS position FROM (SELECT number, string_split(text, chr(10)) lines FROM documents_nested)))
   JOIN lexicon USING (word) GROUP BY number, position) GROUP BY number) USING (pr_id)""", "documents_nested code_files lexicon")
def _(spark, sf):
    facts = plans.path_facts(views.code_files(spark, sf))
    df = plans.document_features(views.pull_documents(spark, sf), views.lexicon(spark, sf), facts)
    return df.withColumns({"complexity_score": F.round("complexity_score", 8), "review_sentiment_score": F.round("review_sentiment_score", 7)})


# --- sizes and ratings ---------------------------------------------------------------------------
@query("size_summaries", "F35", f"""
SELECT file_id, {', '.join(f'round({m}, 7) {m}' for m in tables.METRICS)} FROM sizes""", "function_rows sizes")
def _(spark, sf):
    df = quality.size_summary(views.function_rows(spark, sf), "file_id", "nloc", "ccn", "tokens")
    return df.withColumns({m: F.round(m, 7) for m in tables.METRICS})


@query("quality_ratings", "F23 J12 K1", f"""
SELECT file_id, rating, {rating_sql(True)} AS with_ccn,
  CASE rating WHEN 'not bad' THEN 'below average' WHEN 'medium' THEN 'average' ELSE rating END renamed
FROM sizes JOIN ratings USING (file_id)""", "function_rows sizes ratings")
def _(spark, sf):
    sizes = quality.size_summary(views.function_rows(spark, sf), "file_id", "nloc", "ccn", "tokens")
    return sizes.select("file_id", quality.rating().alias("rating"), quality.rating(use_ccn=True).alias("with_ccn"), quality.rating(renamed=True).alias("renamed"))


# --- findings ------------------------------------------------------------------------------------
@query("finding_type_counts", "A10", f"""
SELECT file_id, {', '.join(f"count(*) FILTER (WHERE type = '{t}') {c}" for t, c in
  [('error', 'num_errors'), ('warning', 'num_warnings'), ('refactor', 'num_refactors'), ('convention', 'num_convention_issues')])}
FROM findings GROUP BY file_id""", "findings")
def _(spark, sf):
    names = {"error": "num_errors", "warning": "num_warnings", "refactor": "num_refactors", "convention": "num_convention_issues"}
    return lint.type_counts(views.findings(spark, sf), "file_id", names)


@query("finding_severity_counts", "A11", """
SELECT file_id, sum((k % 3 = 2)::INT + (k // 3 % 3 = 2)::INT)::BIGINT num_errors,
  sum((k % 3 = 1)::INT + (k // 3 % 3 = 1)::INT)::BIGINT num_warnings FROM findings GROUP BY file_id""", "findings")
def _(spark, sf):
    messages = F.array(F.struct((F.col("k") % 3).alias("severity")), F.struct((F.floor(F.col("k") / 3) % 3).cast("int").alias("severity")))
    rows = views.findings(spark, sf).select("file_id", messages.alias("messages"))
    return lint.severity_counts(rows, "file_id", "messages")


def _lint_outputs(spark, sf):
    e = F.get(F.array(*[F.lit(x) for x in ("py", "java", "js", "go", "php", "cpp", "txt")]), (F.col("event_id") % 7).cast("int"))
    return views.findings(spark, sf).withColumn("ext", e).withColumn("lint_output", views.lint_output(F.col("ext"), F.col("k")))


@query("linter_output_counts", "A10 A11 A12 A13 A14 F37", """
SELECT event_id, ext, CASE WHEN ext IN ('go', 'txt') THEN NULL ELSE k % 4 END num_errors,
  CASE WHEN ext IN ('go', 'txt') THEN NULL WHEN ext = 'cpp' THEN 0 WHEN ext = 'js' THEN k % 3 + 1 ELSE k % 3 END num_warnings,
  CASE WHEN ext = 'go' THEN k % 4 END num_issues FROM
 (SELECT event_id, k, ['py', 'java', 'js', 'go', 'php', 'cpp', 'txt'][(event_id % 7 + 1)::INT] ext FROM findings)""", "findings")
def _(spark, sf):
    return lint.with_lint_counts(_lint_outputs(spark, sf)).select("event_id", "ext", "num_errors", "num_warnings", "num_issues")


@query("security_hits", "F36", SECURITY, "findings")
def _(spark, sf):
    return plans.security_hits(views.findings(spark, sf))


@query("report_numbers", "F27", """
SELECT event_id, try_cast(s AS DOUBLE) v FROM (SELECT event_id, CASE WHEN k % 5 = 0 THEN 'n/a' ELSE k||'.5' END s FROM findings)""", "findings")
def _(spark, sf):
    shown = F.when(F.col("k") % 5 == 0, "n/a").otherwise(F.concat(F.col("k").cast("string"), F.lit(".5")))
    return views.findings(spark, sf).select("event_id", scalar.report_number(shown).alias("v"))
