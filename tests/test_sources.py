"""Readers and the stream on the inputs that break simple ones: indented documents, odd roots, line breaks."""

import json

from pyspark.sql import functions as F

from mergescope.operators import evaluate
from mergescope.operators.prep import chi_square
from mergescope.sources import files, sinks
from mergescope.streaming.ingest import ingest_documents


def land(root, repository, number, indent=None, broken=False):
    folder = root / repository
    folder.mkdir(parents=True, exist_ok=True)
    text = json.dumps({"number": number, "title": f"t{number}", "body": "b", "labels": []}, indent=indent)
    (folder / f"{number}.json").write_text(text[:-5] if broken else text)


def test_stream_keeps_indented_documents_and_earlier_rows(spark, tmp_path):
    root = tmp_path / "my cache" / "x+y" / "cache"
    land(root, "cache", 1, indent=4)
    land(root, "cache", 2, indent=1)
    land(root, "repo one", 3)
    land(root, "repo one", 4, broken=True)
    target = str(tmp_path / "target")
    ingest_documents(spark, str(root), target, str(tmp_path / "state1"))
    seen = lambda: sorted((r.repository_name, r.pr_id) for r in spark.read.parquet(target).collect())
    want = [("cache", 1), ("cache", 2), ("repo one", 3)]
    assert seen() == want
    assert sorted((r.repository_name, r.number) for r in files.read_documents(spark, str(root)).collect()) == want
    # A lost checkpoint and a second source add rows and take none away.
    land(root, "cache", 5)
    ingest_documents(spark, str(root), target, str(tmp_path / "state2"))
    other = tmp_path / "other"
    land(other, "second", 1, indent=2)
    ingest_documents(spark, str(other), target, str(tmp_path / "state3"))
    assert seen() == sorted([*want, ("cache", 5), ("second", 1)])


def test_batches_read_what_is_new_only(spark, tmp_path):
    """However much has landed, a run reads the rows of its own landing; repeats are dropped by the kept keys."""
    root, target = tmp_path / "cache", str(tmp_path / "target")
    read = []
    for landing in range(4):
        for number in range(5):
            land(root, "repo", landing * 5 + number)
        read.append(sum(ingest_documents(spark, str(root), target, str(tmp_path / "state"))))
    assert read == [5, 5, 5, 5]
    assert sum(ingest_documents(spark, str(root), target, str(tmp_path / "state"))) == 0
    # All documents come again with a lost checkpoint.
    assert sum(ingest_documents(spark, str(root), target, str(tmp_path / "other"))) == 20
    assert sorted(r.pr_id for r in spark.read.parquet(target).collect()) == list(range(20))


def test_one_row_a_key_whatever_the_order(spark):
    rows = [(1, "b", 2), (1, "a", 9), (2, None, 1), (2, "z", 0), (None, "x", 1), (None, "x", 0)]
    df = spark.createDataFrame(rows, "k long, s string, n int")
    want = [(1, "a", 9), (2, None, 1), (None, "x", 0)]
    for table in (df, df.orderBy("n"), df.repartition(3)):
        assert sorted(map(tuple, sinks.one_per_key(table, ["k"]).collect()), key=str) == sorted(want, key=str)


def test_source_tree_reads_only_wanted_files(spark, tmp_path):
    root = tmp_path / "a b" / "tree"
    (root / "tree" / "src").mkdir(parents=True)
    (root / "tree" / "src" / "x.py").write_text("print(1)\n")
    (root / "tree" / "src" / "y%20z.go").write_text("package x\n")
    (root / "tree" / "src" / "big.bin").write_bytes(b"0" * 1000)
    tree = files.read_source_tree(spark, str(root), ["py", "go"])
    assert sorted((r.repository, r.ext) for r in tree.collect()) == [("tree", "go"), ("tree", "py")]
    assert files.read_source_tree(spark, str(root)).count() == 3


def test_csv_keeps_line_breaks(spark, tmp_path):
    rows = [(1, 'a\nb', 'x'), (2, 'say "hi",\r\n\\n', None), (3, "", "y")]
    path = str(tmp_path / "csv")
    df = spark.createDataFrame(rows, "id long, body string, tail string")
    sinks.write_csv(df, path)
    got = sorted(map(tuple, files.read_csv(spark, path, "id long, body string, tail string").collect()))
    # An empty string is written as a quoted one and stays apart from null.
    assert [(i, b and b.replace("\r\n", "\n"), t) for i, b, t in got] == [(i, b and b.replace("\r\n", "\n"), t) for i, b, t in rows]


def test_null_is_a_category_of_its_own(spark):
    text = [("a", 0), ("a", 1), ("b", 1), ("c", 0), ("c", 0), ("b", 1), ("c", 1)]
    with_null = [(None if v == "c" else v, y) for v, y in text]
    one = lambda rows: chi_square(spark.createDataFrame(rows, "v string, y int"), ["v"], "y").first()
    assert abs(one(text)["statistic"] - one(with_null)["statistic"]) < 1e-12
    assert one(text)["degrees"] == one(with_null)["degrees"] == 2


def test_ratios_over_nothing_are_null(spark):
    for y in (0, 1):
        df = spark.createDataFrame([(y, 0.2), (y, 0.7)], "y int, s double")
        steps = evaluate.score_steps(df, F.col("y") == 1, F.col("s"))
        assert evaluate.roc_points(steps).count() == 3 and evaluate.pr_points(steps).count() == 3
        assert evaluate.roc_auc(steps).first()["roc_auc"] is None
        evaluate.pr_auc(steps).collect()
    r = evaluate.regression_metrics(spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "y double, prediction double")).first()
    assert r["r2"] is None and r["adjusted_r2"] is None and r["mae"] == 0.5


def test_batches_are_bounded_by_bytes_not_files(spark, tmp_path):
    """Many small files are one batch; a bound in bytes or in files divides them."""
    root = tmp_path / "cache"
    for number in range(1100):
        land(root, "repo", number)
    read = {}
    for name, options in {"all": {}, "bytes": {"batch_bytes": 60_000}, "files": {"files_per_batch": 600}}.items():
        read[name] = len(ingest_documents(spark, str(root), str(tmp_path / name), str(tmp_path / f"state-{name}"), **options))
        batches = [n for n in (tmp_path / f"state-{name}" / "commits").iterdir() if not n.name.startswith(".")]
        assert (len(batches) == 1) == (name == "all")
        assert sorted(r.pr_id for r in spark.read.parquet(str(tmp_path / name)).collect()) == list(range(1100))


def test_one_row_a_file_is_written_by_many_tasks(spark, tmp_path):
    """Exact copies of one partition too; the files are where they belong, and every row is one."""
    from mergescope.catalog.storage import one_a_file

    df = spark.range(0, 200, 1, 1).select(F.lit("a").alias("lang"), F.lit("same").alias("text"))
    one_a_file(df, "lang").text(str(tmp_path / "tree"))
    written = [f.name for f in (tmp_path / "tree" / "lang=a").glob("part-*.txt")]
    assert len(written) == 200 and len({n.split("-")[1] for n in written}) == 4 * spark.sparkContext.defaultParallelism
    assert spark.read.text(str(tmp_path / "tree")).count() == 200


def test_row_files_are_those_of_sparks_writers_and_nothing_else(spark, tmp_path):
    """Odd folder names, nulls and line breaks; no checksums or marks stand beside the files, and a task names its own."""
    from mergescope.catalog.storage import one_a_file

    names = [None, "", "a b", "x+y", "%41", "q\"'*:=?\\{[]^#/\x7f\x01z", "é"]
    df = spark.createDataFrame([(f, t, n) for n, f in enumerate(names) for t in ("x\r\ny", None, "", "é ")], "f string, t string, n int")
    one_a_file(df.select("f", "t"), "f").text(str(tmp_path / "text"))
    one_a_file(df, "f").json(str(tmp_path / "json"))
    df.select("f", "t").write.partitionBy("f").option("maxRecordsPerFile", 1).text(str(tmp_path / "old text"))
    df.write.partitionBy("f").option("maxRecordsPerFile", 1).option("pretty", True).json(str(tmp_path / "old json"))
    for kind, extension in (("text", "txt"), ("json", "json")):
        mine, theirs = ([p for p in (tmp_path / name).rglob(pattern) if p.is_file()] for name, pattern in ((kind, "*"), (f"old {kind}", f"part-*.{extension}")))
        assert sorted((p.parent.name, p.read_bytes()) for p in mine) == sorted((p.parent.name, p.read_bytes()) for p in theirs)
        assert len(mine) == 28 and all(p.suffix == f".{extension}" for p in mine)


def test_small_source_files_are_read_by_few_tasks(spark, sf, monkeypatch):
    """A task reads hundreds of small files, not the few that Spark's cost of opening one allows."""
    import __spark_entry__ as entry
    from mergescope.catalog import storage

    tasks = []

    def watched(df, name):
        tasks.append(df.select("n").inputFiles() and df.sparkSession.conf.get("spark.sql.files.openCostInBytes"))
        return df

    monkeypatch.setattr(storage, "materialise", watched)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    entry.queries()["source_files"](spark, sf)
    assert tasks == ["64k"] and spark.conf.get("spark.sql.files.openCostInBytes") == before


def test_a_batch_of_small_documents_is_read_by_few_tasks(spark, tmp_path):
    from mergescope.streaming.ingest import _stream_settings

    for number in range(1100):
        land(tmp_path / "cache", "repo", number)
    tasks = lambda: files.read_documents(spark, str(tmp_path / "cache")).rdd.getNumPartitions()
    before = tasks()
    with _stream_settings(spark):
        assert tasks() <= spark.sparkContext.defaultParallelism < before
    assert tasks() == before
