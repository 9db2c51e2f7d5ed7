"""Golden rows for the rules on texts, files and pulls."""

import json

import pytest
from pyspark.sql import functions as F

from mergescope.functions import quality, scalar, tables, text
from mergescope.plans import pulls
from mergescope.sources import files, sinks
from mergescope.streaming.ingest import ingest_documents

CODE = "import os\nfrom a import b\n\n# if x: return\ndef one(a):\n    '''doc'''\n    if a and b:\n        print('x')\n    return a\n\ndef two ():\n    for i in a: pass"


def value(spark, column, content=CODE, **extra):
    df = spark.createDataFrame([(content, *extra.values())], ", ".join(["c string", *[f"{k} string" for k in extra]]))
    return df.select(column.alias("v")).first()["v"]


C = F.col("c")


@pytest.mark.parametrize("column,want", [
    (text.line_count(C), 12), (text.newline_count(C), 11), (text.split_line_count(C), 12),
    (text.function_count(C), 2), (text.function_line_count(text.lines_of(C)), 2), (text.comment_line_count(text.lines_of(C)), 1),
    (text.import_count(C), 2), (text.python_function_count(C), 2), (text.docstring_count(C), 1),
    (text.comment_count(C), 2), (text.cyclomatic_complexity(C), 1 + 3 / 2), (text.function_names(C), ["one", "two"]),
    (text.long_line_count(text.lines_of(C), F.lit(14)), 4),
])
def test_python_text(spark, column, want):
    assert value(spark, column) == want


@pytest.mark.parametrize("content,want", [("", 0), ("a", 1), ("a\n", 1), ("a\n\nb", 3), ("\n", 1)])
def test_line_counts(spark, content, want):
    assert value(spark, text.line_count(C), content) == want
    assert value(spark, text.split_line_count(C), content) == want


def test_split_lines_know_all_breaks(spark):
    odd = "a\r\nb\rc\x0bd\x0ce\x1cf\x85g\u2028h\u2029"
    assert value(spark, text.split_line_count(C), odd) == len(odd.splitlines())


def test_function_patterns_of_languages(spark):
    content = "function () {} function f(a) func g (x) fun h(y) void m(a) int x = 3; String name() undef z( definitely("
    assert value(spark, text.function_count(C), content) == 6


def test_keyword_counts(spark):
    words = F.array(F.lit("if"), F.lit("aa"))
    assert value(spark, text.substring_keyword_count(C, words), "if elif aaaa") == 4
    assert value(spark, text.token_keyword_count(C, words), "if elif aa  aa\nif") == 4
    assert value(spark, text.substring_keyword_count(C, text.keywords_of(F.lit("zz"))), "if") == 0


def label(spark, title, body, **options):
    df = spark.createDataFrame([(title, body)], "t string, b string")
    return text.with_label(df, "t", "b", "label", **options).first()["label"]


def test_labels(spark):
    example = ("Wrong total on the invoice page", "The total is wrong after a discount and the page shows an error. A fix is due before the sale.")
    assert label(spark, *example) == "bug"
    assert label(spark, "nothing", "here") == "other"
    assert label(spark, "nothing", None, contains=True) is None
    # One word and one sentence each: the first label wins.
    assert label(spark, "", "fix. add.") == "bug"
    assert label(spark, "", "prefixes", contains=True) == "bug"
    assert label(spark, "", "prefixes") == "bug"  # the sentence contains "fix"
    # Pieces of four characters: " fix" stays whole, "bu|g" is cut.
    assert label(spark, "", "fixxbug", size=4, contains=True) == "bug"
    assert label(spark, "", "bug", size=2, contains=True) is None


def test_multi_label(spark):
    assert value(spark, text.multi_label(F.col("t"), C), "cleanup of an attack", t="Fix") == "bug, code_smell, security"
    assert value(spark, text.multi_label(F.col("t"), C), "plain", t="Plain") == "other"


def test_chunks_cover_the_text(spark):
    assert value(spark, text.chunks(C, 4), "abcdefghij") == ["abcd", "efgh", "ij"]
    assert value(spark, text.chunks(C, 4), "") == []


@pytest.mark.parametrize("name,want", [("a/b.py", "Python"), ("x.ts", "JavaScript"), ("Makefile", None), ("x.css", None), ("x.go", "Go")])
def test_languages(spark, name, want):
    assert value(spark, text.language_of(C), name) == want


def issues(spark, content, language, **options):
    df = spark.createDataFrame([(content, language)], "content string, language string")
    return quality.with_issues(df, **options).first()["issues"]


def test_quality_issues(spark):
    assert issues(spark, CODE, "Python") == ["Print statements found.", "Commented-out code found."]
    assert issues(spark, "x" * 80 + "\n" + "y" * 79, "Python") == ["1 lines exceed 79 characters."]
    assert issues(spark, "x" * 100, "Java") == [tables.NO_ISSUES_MESSAGE]
    assert issues(spark, "a // b", "Java") == ["Commented-out code found."]
    assert issues(spark, "a // b", "Java", older=True) == [tables.NO_ISSUES_MESSAGE]


def test_ratings(spark):
    def rate(*metrics, **options):
        df = spark.createDataFrame([tuple(None if m is None else float(m) for m in metrics)], ", ".join(f"{m} double" for m in tables.METRICS))
        return df.select(quality.rating(**options).alias("r")).first()["r"]

    assert rate(100, 5, 1, 20, 3, 0, 0, 0) == "the best"
    assert rate(1e9, 1e9, 1e9, 1e9, 1e9, 1e9, 1e9, 1e9) == "the best"  # all scores are zero
    assert rate(250000, 70, 9, 450, 150, 5, 1.4, 1.1) == "not bad"
    assert rate(250000, 70, 9, 450, 150, 5, 1.4, 1.1, renamed=True) == "below average"
    assert rate(1, 1, None, 1, 1, 1, 1, 1) is None


def test_times(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 10:00:00' a, timestamp'2024-01-02 09:30:00' b, cast(NULL AS timestamp) n")
    got = df.select(scalar.hours_between(F.col("a"), F.col("b")).alias("h"), scalar.hours_between(F.col("a"), F.col("n")).alias("x"),
                    scalar.tenure_months(F.col("b"), F.col("a")).alias("t")).first()
    assert got["h"] == 23.5 and got["x"] is None and got["t"] == pytest.approx(-1 / 30)


def test_pull_without_children(spark):
    pulls_df = spark.sql("SELECT 1L pr_id, 'r' repository_name, 't' title, cast(NULL AS string) body, timestamp'2024-01-01' created_at, cast(NULL AS timestamp) merged_at, 2L commits, 1L comments, 0L review_comments, false merged")
    reviews = spark.createDataFrame([], "pr_id long, reviewer long, submitted_at timestamp, state string")
    row = pulls.basic_features(pulls_df, reviews).first()
    assert (row["description_length"], row["time_to_merge"], row["num_reviewers"], row["review_time"], row["num_approvals"]) == (0, None, 0, 0.0, 0)


def test_nested_documents_from_a_tree(spark, tmp_path):
    repo = tmp_path / "cache" / "my repo" / "deep"
    repo.mkdir(parents=True)
    full = {"number": 7, "title": "abc", "body": None, "labels": ["bug", "x"], "comments": 2, "review_comments": 1, "merged": True,
            "reviews": [{"user": None, "state": "APPROVED"}, {"user": "u", "review_time": 1.5, "state": "APPROVED"}, {"user": None, "state": "COMMENTED"}],
            "issue_comments": [], "files": []}
    (repo / "a.json").write_text(json.dumps(full, indent=1))
    (repo / "b.json").write_text('{"number": 8, "title": "only')
    (repo / "c.json").write_text('{"title": "no number"}')
    (repo / "d.txt").write_text(json.dumps(full))
    (repo / "e.json").write_text('{"number": 9, "title": ""}')
    got = {r["pr_id"]: r for r in pulls.nested_features(files.read_documents(spark, str(tmp_path / "cache"))).collect()}
    assert set(got) == {7, 9}
    a, e = got[7], got[9]
    assert a["repository_name"] == "my repo" and a["title_length"] == 3 and a["is_bug_fix"] and a["num_comments"] == 3
    assert a["num_reviewers"] == 2 and a["num_approvals"] == 2 and a["review_time"] == 1.5
    assert (e["num_reviewers"], e["num_approvals"], e["review_time"], e["is_bug_fix"], e["merge_status"]) == (0, 0, 0.0, False, False)


def test_source_tree_decodes(spark, tmp_path):
    repo = tmp_path / "root" / "r1"
    repo.mkdir(parents=True)
    (repo / "a.py").write_bytes("é\r\nx\r".encode())
    (repo / "b.py").write_bytes(b"ok\xff\xfe")
    (repo / "c.class").write_bytes(b"\x00\x01")
    (repo / "d.md").write_bytes(b"skip")
    tree = files.read_source_tree(spark, str(tmp_path / "root"), ["py", "class"])
    strict = {r["path"].rsplit("/", 1)[-1]: r for r in files.decode(tree).collect()}
    assert {n: r["content"] for n, r in strict.items()} == {"a.py": "é\nx\n", "b.py": None, "c.class": "AAE="}
    assert strict["a.py"]["repository"] == "r1" and strict["c.class"]["language"] == "Unknown"
    assert {r["content"] for r in files.decode(tree.where("ext = 'py'"), lenient=True).collect()} == {"é\nx\n", "ok"}


def test_metrics_csv_with_mark_and_blank_rows(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("\ufeff" + ",".join(files.METRICS_COLUMNS) + "\n26,7,2,47,3,0,0,0\n,,,,,,,\n46,4.7,1.7,22.8,9,0,0,0\n")
    got = files.read_metrics_csv(spark, str(path)).collect()
    assert [r[0] for r in got] == [26.0, 46.0] and got[1][1] == 4.7


def test_size_reports(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2 3 4 5 6 7 8\nTotal nloc Avg.NLOC\n----\n   10  5.0 1.5 20 2 0 0.00 0.00  \n9 9 9 9 9 9 9 9")
    (tmp_path / "b.txt").write_text("nothing")
    got = {r["path"][-5:]: list(r)[1:] for r in files.read_size_reports(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": [10, 5, 1.5, 20, 2, 0, 0, 0], "b.txt": [None] * 8}


def test_joined_lines_keep_order_and_skip_nulls(spark):
    df = spark.createDataFrame([(1, p, f"t{p}" if p % 4 else None) for p in range(30, 0, -1)] + [(2, 1, None)], "k int, p long, t string")
    got = {r["k"]: r["t"] for r in pulls.joined_lines(df, ["k"], "p", ["t"], block_width=7).collect()}
    assert got[1] == "\n".join(f"t{p}" for p in range(1, 31) if p % 4) and got[2] == ""


def test_stream_ingests_each_pull_once(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    folder = tmp_path / "in" / "repo"
    folder.mkdir(parents=True)
    for batch in ([1, 2], [2, 3], []):
        for n in batch:
            (folder / f"{n}-{len(batch)}-{batch[0]}.json").write_text(json.dumps({"number": n, "title": "t" * n}))
        ingest_documents(spark, source, target, state)
    got = spark.read.parquet(target)
    assert sorted((r["pr_id"], r["title_length"]) for r in got.collect()) == [(1, 1), (2, 2), (3, 3)]


def test_append_new_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    for ids in ([1, 2, 2], [2, 3]):
        sinks.append_new(spark.createDataFrame([(i,) for i in ids], "id long"), path, ["id"])
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_texts_of_a_pull_in_order_over_many_runs(spark):
    """A pull with most rows is cut into several runs; order is by a struct, ties and nulls included."""
    import random

    from mergescope.plans.pulls import joined_lines

    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3]), rng.randrange(40), rng.randrange(10 ** 7), rng.choice(["a", "b", "", None]), i) for i in range(400)] + [(4, 0, 0, None, 500)]
    df = spark.createDataFrame(rows, "k int, x int, y long, t string, n int").selectExpr("k", "struct(x, y) p", "t", "n")
    got = {r.k: (r.t, r.n) for r in joined_lines(df, ["k"], "p", ["t"], last=["n"]).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        mine = sorted((x, y, n, t) for q, x, y, t, n in rows if q == k)
        want[k] = ("\n".join(t for *_, t in mine if t is not None), mine[-1][2])
    assert got == want
