"""Queries over cleaning, encoding, scaling and feature tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import tables
from ..operators import prep
from ..operators.joins import lookup_join
from ..operators.unions import preview, union_tables
from ..plans import cleaning, issues as issue_plans, pulls as plans
from ..session import materialise
from .pulls import BASIC, FEATURE_VIEWS, FEATURES as FEATURE_SQL, pull_features
from .registry import query
from .texts import TOKEN_COUNTS, label_sql

NUMBERS = ["title_length", "description_length", "time_to_merge", "num_commits", "num_comments", "num_reviewers",
           "review_time", "num_approvals"]


def basic(spark, sf):
    df = plans.basic_features(views.pulls(spark, sf), views.reviews(spark, sf))
    return df.withColumns({c: F.round(c, 6) for c in ("time_to_merge", "review_time")})


def each(sql: str, columns: list[str], sep: str = ", ") -> str:
    return sep.join(sql.replace("{c}", c) for c in columns)


@query("dropped_columns", "P1", f"SELECT * EXCLUDE (title_length, num_commits) FROM ({BASIC})", "pulls reviews")
def _(spark, sf):
    return basic(spark, sf).drop("title_length", "num_commits")


@query("empty_columns_dropped", "P2", f"SELECT * FROM ({BASIC})", "pulls reviews")
def _(spark, sf):
    df = basic(spark, sf).withColumns({"nothing": F.lit(None).cast("double"), "nowhere": F.when(F.col("pr_id") < 0, "x")})
    return prep.drop_empty_columns(df)


@query("column_classes", "P3", f"""
SELECT c AS column_name, CASE WHEN c IN ('repository_name', 'merge_status') THEN 'categorical' ELSE 'numeric' END AS kind, n
FROM (SELECT {each("count({c}) {c}", ["pr_id", "repository_name", "merge_status"] + NUMBERS)} FROM ({BASIC}))
UNPIVOT (n FOR c IN (pr_id, repository_name, merge_status, {", ".join(NUMBERS)}))""", "pulls reviews")
def _(spark, sf):
    df = basic(spark, sf)
    kinds = {**{c: "numeric" for c in prep.numeric_columns(df)}, **{c: "categorical" for c in prep.categorical_columns(df)}}
    counts = df.agg(*[F.count(c).alias(c) for c in kinds])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("kind"), F.col(c).alias("n")) for c, k in kinds.items()]))
    return counts.select(rows.alias("r")).select("r.*")


@query("labelled_rows", "P4", "SELECT * FROM labelled WHERE quality IS NOT NULL", "labelled")
def _(spark, sf):
    return views.labelled(spark, sf).dropna(subset=["quality"])


@query("label_subset", "P7", """
SELECT event_id, type FROM findings WHERE type IN ('error', 'warning', 'refactor')""", "findings")
def _(spark, sf):
    return views.findings(spark, sf).where(F.col("type").isin("error", "warning", "refactor")).select("event_id", "type")


# --- statistics and filling ----------------------------------------------------------------------
@query("column_statistics", "A17 A18 A20 A21", f"""
SELECT c AS column_name, {each("{c}", ["lower_quartile", "middle", "upper_quartile", "mean", "deviation"])} FROM (
{each('''SELECT '{c}' c, round(quantile_cont({c}, 0.25), 6) lower_quartile, round(median({c}), 6) middle,
  round(quantile_cont({c}, 0.75), 6) upper_quartile, round(avg({c}), 5) mean, round(stddev_pop({c}), 5) deviation FROM basic''', NUMBERS, " UNION ALL ")})""".replace(
    "FROM basic", f"FROM ({BASIC})"), "pulls reviews")
def _(spark, sf):
    df = materialise(basic(spark, sf).select(*NUMBERS), "features")
    quartiles = prep.exact_quantiles(df, NUMBERS, [0.25, 0.5, 0.75])
    scale = prep.fit_standard(df, NUMBERS)
    rows = [(c, *[float(v) for v in quartiles[c]], scale.centre[c], scale.width[c]) for c in NUMBERS]
    out = spark.createDataFrame(rows, "column_name string, lower_quartile double, middle double, upper_quartile double, mean double, deviation double")
    return out.withColumns({**{c: F.round(c, 6) for c in out.columns[1:4]}, **{c: F.round(c, 5) for c in out.columns[4:]}})


@query("median_filled", "M1", f"""
SELECT pr_id, coalesce(time_to_merge, median(time_to_merge) OVER ()) time_to_merge FROM ({BASIC})""", "pulls reviews")
def _(spark, sf):
    df = materialise(basic(spark, sf).select("pr_id", "time_to_merge"), "features")
    return prep.fill(df, prep.medians(df, ["time_to_merge"]))


@query("mean_filled", "M2", f"""
SELECT pr_id, round(coalesce(time_to_merge, avg(time_to_merge) OVER ()), 5) time_to_merge FROM ({BASIC})""", "pulls reviews")
def _(spark, sf):
    df = basic(spark, sf).select("pr_id", "time_to_merge")
    return prep.fill(df, prep.means(df, ["time_to_merge"])).withColumn("time_to_merge", F.round("time_to_merge", 5))


@query("mode_filled", "M3 A19", """
SELECT doc_id, coalesce(quality, (SELECT quality FROM labels GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) quality,
  coalesce(toxic, (SELECT toxic FROM labels GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) toxic FROM labelled""", "labelled")
def _(spark, sf):
    df = views.labelled(spark, sf).select("doc_id", "quality", "toxic")
    return prep.fill(df, prep.modes(df, ["quality", "toxic"]))


@query("most_frequent_values", "A19", """
SELECT (SELECT source FROM documents GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS source,
  (SELECT lang FROM documents GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS lang,
  (SELECT n_chars FROM documents GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS n_chars""")
def _(spark, sf):
    best = prep.modes(views.table(spark, sf, "documents"), ["source", "lang", "n_chars"])
    return spark.createDataFrame([tuple(best.values())], "source string, lang string, n_chars long")


@query("zero_filled", "M4", f"SELECT * REPLACE (coalesce(time_to_merge, 0) AS time_to_merge) FROM ({BASIC})", "pulls reviews")
def _(spark, sf):
    return prep.fill_zero(basic(spark, sf))


# --- scaling -------------------------------------------------------------------------------------
STANDARD = "round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) {c}"
ROBUST = "round(({c} - median({c}) OVER ()) / (quantile_cont({c}, 0.75) OVER () - quantile_cont({c}, 0.25) OVER ()), 6) {c}"
SCALED = ["title_length", "num_commits", "num_reviewers", "review_time"]


@query("standard_scaled", "M5 A20", f"SELECT pr_id, {each(STANDARD, SCALED)} FROM ({BASIC})", "pulls reviews")
def _(spark, sf):
    df = basic(spark, sf).select("pr_id", *SCALED)
    return prep.fit_standard(df, SCALED).transform(df).withColumns({c: F.round(c, 6) for c in SCALED})


@query("deviation_scaled", "M6", f"SELECT pr_id, {each('round({c} / stddev_samp({c}) OVER (), 6) {c}', SCALED)} FROM ({BASIC})", "pulls reviews")
def _(spark, sf):
    df = basic(spark, sf).select("pr_id", *SCALED)
    return prep.fit_deviation(df, SCALED).transform(df).withColumns({c: F.round(c, 6) for c in SCALED})


ROBUST_SCALED = ["num_commits", "num_reviewers", "review_time"]


@query("robust_scaled", "M7 A21", f"SELECT pr_id, {each(ROBUST, ROBUST_SCALED)} FROM ({BASIC})", "pulls reviews")
def _(spark, sf):
    df = materialise(basic(spark, sf).select("pr_id", *ROBUST_SCALED), "features", views.reviews(spark, sf).count())
    return prep.fit_robust(df, ROBUST_SCALED).transform(df).withColumns({c: F.round(c, 6) for c in ROBUST_SCALED})


# --- encoding ------------------------------------------------------------------------------------
def code(c: str, text: str) -> str:
    return f"dense_rank() OVER (ORDER BY {text}) - 1 AS {c}"


@query("ordinal_codes", "W1 M8", f"""
SELECT pr_id, {code('repository_name', 'repository_name')}, {code('merge_status', "CASE WHEN merge_status THEN 'True' ELSE 'False' END")},
  {code('title', 'title')} FROM (SELECT pr_id, repository_name, merged merge_status, title FROM pulls)""", "pulls")
def _(spark, sf):
    df = views.pulls(spark, sf).select("pr_id", "repository_name", F.col("merged").alias("merge_status"), "title")
    return prep.ordinal_encode(df, ["repository_name", "merge_status", "title"])


@query("ordinal_codes_with_nulls", "W1", f"SELECT pr_id, {code('body', '''coalesce(body, 'nan')''')} FROM pulls", "pulls")
def _(spark, sf):
    return prep.ordinal_encode(views.pulls(spark, sf).select("pr_id", "body"), ["body"])


@query("category_codes", "W2", """
SELECT event_id, CASE WHEN name IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY name NULLS LAST) - 1 END AS name
FROM (SELECT pr_id event_id, nullif(name, 'view') AS name FROM pull_labels)""", "pull_labels")
def _(spark, sf):
    df = views.pull_labels(spark, sf).select(F.col("pr_id").alias("event_id"), F.nullif("name", F.lit("view")).alias("name"))
    return prep.category_codes(df, ["name"])


@query("mapped_labels", "W3", f"""
SELECT file_id, CASE label WHEN 'bug' THEN 0 WHEN 'enhancement' THEN 1 WHEN 'feature' THEN 2 WHEN 'documentation' THEN 3 END label
FROM (SELECT file_id, {label_sql({k: k for k in tables.LABEL_KEYWORDS}, 'NULL')} AS label FROM
 (SELECT file_id, {TOKEN_COUNTS} FROM (SELECT file_id, lower(path||' '||content) t FROM code_files)))""", "code_files")
def _(spark, sf):
    from ..functions import text

    df = text.with_label(views.code_files(spark, sf), "path", "content", contains=True)
    return df.select("file_id", prep.map_encode(F.col("label"), tables.LABEL_CODES).alias("label"))


@query("side_by_side", "J10", f"""
SELECT pr_id, repository_name, merge_status, {each(STANDARD, ['num_commits', 'num_reviewers'])} FROM ({BASIC})""", "pulls reviews")
def _(spark, sf):
    # Scaled and untouched columns stay in one row, so nothing is joined by position.
    df = basic(spark, sf).select("pr_id", "repository_name", "merge_status", "num_commits", "num_reviewers")
    return prep.fit_standard(df, ["num_commits", "num_reviewers"]).transform(df).withColumns(
        {c: F.round(c, 6) for c in ("num_commits", "num_reviewers")})


# --- unions --------------------------------------------------------------------------------------
@query("merged_tables", "U1 U2", f"""
SELECT pr_id, repository_name, num_commits, NULL::BOOLEAN merge_status, NULL::BIGINT num_reviewers FROM ({BASIC}) WHERE pr_id % 2 = 0
UNION ALL SELECT pr_id, repository_name, NULL, merge_status, NULL FROM ({BASIC})
UNION ALL SELECT pr_id, repository_name, NULL, NULL, num_reviewers FROM ({BASIC})""", "pulls reviews")
def _(spark, sf):
    df = basic(spark, sf)
    return union_tables([
        df.where(F.col("pr_id") % 2 == 0).select("pr_id", "repository_name", "num_commits"),
        df.select("merge_status", "pr_id", "repository_name"), df.select("repository_name", "pr_id", "num_reviewers")])


@query("first_rows", "K3", f"SELECT pr_id, repository_name, num_commits FROM ({BASIC}) ORDER BY pr_id LIMIT 5", "pulls reviews")
def _(spark, sf):
    return preview(basic(spark, sf).select("pr_id", "repository_name", "num_commits"), ["pr_id"])


# --- targets -------------------------------------------------------------------------------------
# The full table's columns, as they are scored: ratings and issue lists as codes in order, the rest as numbers.
CODED = f"""SELECT *, dense_rank() OVER (ORDER BY coalesce(code_quality_rate, 'nan')) - 1 rate_code, dense_rank() OVER (ORDER BY code_quality_issues) - 1 issue_code
  FROM ({FEATURE_SQL})"""


@query("classification_target", "P9 P11", f"""
SELECT pr_id, score, (score >= median(score) OVER ())::INT target FROM (SELECT pr_id,
  3.0::DOUBLE * is_bug_fix::INT + 2.0::DOUBLE * merge_status::INT + 4.0::DOUBLE * rate_code + 4.0::DOUBLE * issue_code score FROM ({CODED}))""", FEATURE_VIEWS)
def _(spark, sf):
    df = materialise(pull_features(spark, sf).select("pr_id", "is_bug_fix", "merge_status", "code_quality_rate", "code_quality_issues"), "features", views.files(spark, sf).count())
    coded = prep.ordinal_encode(df, ["code_quality_rate", "code_quality_issues"])
    return cleaning.binarise_at_median(coded.select("pr_id", cleaning.classification_score().alias("score")), "score", "target")


@query("regression_target", "P10 P11", f"""
SELECT pr_id, score, (score >= median(score) OVER ())::INT target FROM (SELECT pr_id, round(2.0::DOUBLE * files_changed
  + 2.0::DOUBLE * lines_added + 2.0::DOUBLE * lines_deleted + 2.0::DOUBLE * coalesce(time_to_merge, 0) + 2.0::DOUBLE * num_commits
  + 3.0::DOUBLE * num_comments + 3.0::DOUBLE * num_reviewers + 2.0::DOUBLE * author_experience + 3.0::DOUBLE * review_time
  + 3.0::DOUBLE * num_approvals + 3.0::DOUBLE * review_sentiment_score, 4) score FROM ({FEATURE_SQL}))""", FEATURE_VIEWS)
def _(spark, sf):
    df = materialise(pull_features(spark, sf).select("pr_id", *tables.REGRESSION_WEIGHTS), "features", views.files(spark, sf).count())
    scored = prep.fill_zero(df).select("pr_id", F.round(cleaning.regression_score(), 4).alias("score"))
    return cleaning.binarise_at_median(scored, "score", "target")


# --- feature tests -------------------------------------------------------------------------------
FEATURES = ["title_length", "description_length", "num_commits", "num_comments", "num_reviewers", "review_time", "num_approvals"]


def f_sql(c: str, table: str = "t", label: str = "repository_name") -> str:
    return f"""SELECT '{c}' feature, (sum(n * (m - g) ** 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) f_score
      FROM (SELECT count({c}) n, avg({c}) m, var_pop({c}) v, (SELECT avg({c}) FROM {table}) g FROM {table} GROUP BY {label})"""


@query("anova_scores", "A24 M11", f"SELECT feature, round(f_score, 6) f_score FROM (WITH t AS ({BASIC}) {' UNION ALL '.join(f_sql(c) for c in FEATURES)})", "pulls reviews")
def _(spark, sf):
    return prep.anova_f(basic(spark, sf), FEATURES, "repository_name").withColumn("f_score", F.round("f_score", 6))


@query("top_features", "K2 M11", f"""
SELECT feature, round(f_score, 6) f_score FROM (WITH t AS ({BASIC}) {' UNION ALL '.join(f_sql(c, label='merge_status') for c in FEATURES)})
ORDER BY f_score DESC, feature LIMIT 3""", "pulls reviews")
def _(spark, sf):
    scores = prep.anova_f(basic(spark, sf), FEATURES, "merge_status")
    return prep.top_features(scores, 3).withColumn("f_score", F.round("f_score", 6))


def chi_sql(c: str) -> str:
    return f"""SELECT '{c}' feature, sum((o - e) ** 2 / e) statistic, (count(DISTINCT v) - 1) * (count(DISTINCT l) - 1) degrees FROM
     (SELECT v, l, coalesce(o, 0) o, r * cc / (SELECT count(*) FROM lineitem)::DOUBLE e FROM
       (SELECT {c} v, count(*) r FROM lineitem GROUP BY 1) CROSS JOIN (SELECT l_returnflag l, count(*) cc FROM lineitem GROUP BY 1)
       LEFT JOIN (SELECT {c} v, l_returnflag l, count(*) o FROM lineitem GROUP BY 1, 2) USING (v, l))"""


@query("chi_square_scores", "A25 M12", f"SELECT feature, round(statistic, 5) statistic, degrees FROM ({chi_sql('l_linenumber')} UNION ALL {chi_sql('l_linestatus')} UNION ALL {chi_sql('l_suppkey')})")
def _(spark, sf):
    scores = prep.chi_square(views.table(spark, sf, "lineitem"), ["l_linenumber", "l_linestatus", "l_suppkey"], "l_returnflag")
    return scores.withColumn("statistic", F.round("statistic", 5))


# --- composite jobs ------------------------------------------------------------------------------
FULL_NUMBERS = ["title_length", "description_length", "files_changed", "lines_added", "lines_deleted", "time_to_merge", "num_commits", "num_comments",
                "num_reviewers", "author_experience", "author_tenure", "review_time", "num_approvals", "review_sentiment_score"]
# Columns that the tables of the two halves of the pulls lack.
LACKING = [["author_tenure", "code_quality_rate"], ["review_sentiment_score", "lines_deleted"]]
DRIFTED = ", ".join(f"CASE WHEN pr_id % 2 <> {half} THEN {c} END AS {c}" for half, columns in enumerate(LACKING) for c in columns)
FLAGS = "CASE WHEN {c} THEN 'True' ELSE 'False' END"


@query("standardised_table", "Q7", f"""
SELECT {code('repository_name', 'repository_name')}, {', '.join(code(c, FLAGS.format(c=c)) for c in ('is_bug_fix', 'merge_status'))},
  {code('code_quality_issues', 'code_quality_issues')}, {code('code_quality_rate', "coalesce(code_quality_rate, 'nan')")}, {each(STANDARD, FULL_NUMBERS)}
FROM (SELECT * REPLACE ({each("coalesce({c}, median({c}) OVER ()) AS {c}", FULL_NUMBERS)}) FROM (SELECT * REPLACE ({DRIFTED}) FROM ({FEATURE_SQL})))""", FEATURE_VIEWS)
def _(spark, sf):
    """Tables of two collections with different columns, merged, cleaned, coded and scaled."""
    whole = materialise(pull_features(spark, sf), "features", views.files(spark, sf).count())
    merged = union_tables([whole.where(F.col("pr_id") % 2 == half).drop(*columns) for half, columns in enumerate(LACKING)])
    return cleaning.standardise(merged).withColumns({c: F.round(c, 6) for c in FULL_NUMBERS})


@query("robust_scaled_table", "Q8", f"""
SELECT {code('repository_name', 'repository_name')}, merge_status, {each(ROBUST, ROBUST_SCALED)},
  round((time_to_merge - median(time_to_merge) OVER ()) / CASE WHEN q THEN 1 ELSE 0 END, 6) time_to_merge
FROM (SELECT *, (quantile_cont(time_to_merge, 0.75) OVER () - quantile_cont(time_to_merge, 0.25) OVER ()) = 0 q FROM
  (SELECT * REPLACE (coalesce(time_to_merge, median(time_to_merge) OVER ()) AS time_to_merge) FROM ({BASIC})))""", "pulls reviews")
def _(spark, sf):
    df = basic(spark, sf).select("pr_id", "repository_name", "merge_status", *ROBUST_SCALED, "time_to_merge").withColumn("nothing", F.lit(None).cast("double"))
    return cleaning.encode_strings(cleaning.robust_scale(df)).withColumns({c: F.round(c, 6) for c in [*ROBUST_SCALED, "time_to_merge"]})


@query("issue_code_features", "Q6 A23 F31 M2 P4 P7 W3", rf"""
SELECT issue_id, len(list_distinct(methods)) * w::DOUBLE complexity, len(methods)::DOUBLE num_methods,
  CASE label WHEN 'bug' THEN 0 WHEN 'enhancement' THEN 1 WHEN 'feature' THEN 2 END label
FROM (SELECT issue_id, label, regexp_extract_all(content, '\b(def|function|func|fun)[ \t]+(\w+)[ \t]*\(', 2) methods,
   1 + len(regexp_extract_all(content, '\b(if|for|while|return)\b')) w FROM
  (SELECT file_id issue_id, content, {label_sql({k: k for k in tables.LABEL_KEYWORDS}, 'NULL')} AS label FROM
   (SELECT file_id, content, {TOKEN_COUNTS} FROM (SELECT file_id, content, lower(path||' '||content) t FROM code_files))))
WHERE label IN ('bug', 'enhancement', 'feature')""", "code_files")
def _(spark, sf):
    issues = views.code_files(spark, sf).select(F.col("file_id").alias("issue_id"), F.col("path").alias("title"), F.col("content").alias("body"), "content")
    return issue_plans.issue_features(issue_plans.issue_code_metrics(issues))


@query("known_keys_skipped", "S14", "SELECT o_orderkey pr_id, o_orderstatus status FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber < 4)")
def _(spark, sf):
    from ..sources.sinks import only_new

    orders = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("pr_id"), F.col("o_orderstatus").alias("status"))
    known = views.table(spark, sf, "lineitem").where(F.col("l_linenumber") < 4).select(F.col("l_orderkey").alias("pr_id"))
    return only_new(orders, known, ["pr_id"])


@query("class_distribution", "A15 A16", "SELECT label, count(*) n, min(count(*)) OVER () smallest FROM embeddings GROUP BY label")
def _(spark, sf):
    from ..operators.balance import class_distribution, smallest_class

    df = views.embeddings(spark, sf)
    least = smallest_class(df, "label").first()["n"]
    return class_distribution(df, "label").withColumn("smallest", F.lit(least))
