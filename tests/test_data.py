import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import ingest as I
from siftline.operators import split as S
from siftline.sources import logs, postings as P


def test_names_are_normalised_and_clashes_raise(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Job ID` int, `Unnamed: 0` int, `__x__` int")
    assert P.normalize_columns(df).columns == ["job_id", "unnamed_0", "x"]
    with pytest.raises(ValueError):
        P.normalize_columns(df.toDF("a b", "a-b", "c"))


def test_csv_sources_merge(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Job_ID,Title,fraudulent\n1,"a ""q"",\nline",0\n2,NA,1\n')
    (tmp_path / "b.csv").write_text("job id,Industry,fraudulent\n3,IT,Fake\n")
    with pytest.warns(UserWarning):
        df = P.read_postings(spark, str(tmp_path), ["a.csv", "none.csv", "b.csv"])
    rows = {r.job_id: r for r in df.collect()}
    assert rows[1].title == 'a "q",\nline' and rows[2].title is None and rows[3].industry == "IT"
    assert rows[1]._source_file == "a.csv" and rows[3]._source_rank == 1 and rows[3].title is None
    with pytest.raises(FileNotFoundError):
        with pytest.warns(UserWarning):
            P.read_postings(spark, str(tmp_path), ["none.csv"])
    assert P.missing_columns(df, ["title", "salary"]) == ["salary"]


def test_labels(spark):
    raw = ["Real", " fake ", "1", "0", "x", None, "2.9", "nan"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, fraudulent string")
    got = {r.i: r.fraudulent for r in I.coerce_label(df).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0, 6: 2}
    with pytest.raises(KeyError):
        I.coerce_label(df.drop("fraudulent"))


def test_first_of_equal_keys_wins_even_when_hot(spark):
    rnd = random.Random(1)
    rows = [(r, i, "hot" if rnd.random() < 0.4 else f"t{rnd.randrange(50)}", None, f"d{r}{i}") for r in (0, 1) for i in range(400)]
    df = spark.createDataFrame(rows, "_source_rank int, job_id long, title string, industry string, description string")
    want = {}
    for row in sorted(rows):
        want.setdefault(row[2], row)
    got = {r.title: (r._source_rank, r.job_id, r.description) for r in I.dedup_key(df.repartition(7)).collect()}
    assert got == {k: (v[0], v[1], v[4]) for k, v in want.items()}
    stats = I.dedup_stats(df, I.joined_key(["title"])).first()
    assert tuple(stats) == (800, len(want), 800 - len(want))


def test_null_and_blank_key_parts_are_equal(spark):
    df = spark.createDataFrame([(0, 1, "a", None), (0, 2, "a", "")], "_source_rank int, job_id long, title string, industry string")
    assert [r.job_id for r in I.dedup_key(df).collect()] == [1]


def test_preprocess(spark):
    df = spark.createDataFrame([(None, "<b>X</b> y", "s", 1)], "title string, description string, location string, n int")
    row = I.preprocess(df).first()
    assert row.text_all == "x y" and "location" not in row.asDict() and row.title == ""


def test_observed_rows_and_alignment(spark):
    df, counter = I.observed_rows(spark.range(5), "rows")
    df.collect()
    assert counter.get["rows"] == 5
    out = I.align_columns(spark.range(1), {"id": None, "flag": 0, "x": None}, types={"x": "string"}).first()
    assert tuple(out) == (0, 0, None)


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_exact_split_equals_sorting(spark, n):
    rows = [(i, int(i % 10 == 0)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, y int")
    hashed = {r.id: r.h for r in df.select("id", S.seeded_hash("id").alias("h")).collect()}
    want = {}
    for y in (0, 1):
        ids = sorted((i for i, v in rows if v == y), key=lambda i: (hashed[i], i))
        a, b = int(len(ids) * 0.7 + 0.5), int(len(ids) * 0.85 + 0.5)
        want |= {i: "train" if k < a else "val" if k < b else "test" for k, i in enumerate(ids)}
    assert {r.id: r.split for r in S.stratified_split(df, "id", "y", buckets=16).collect()} == want


def test_split_moves_no_rows_and_is_whole(spark):
    df = spark.range(200_000).withColumn("y", (F.col("id") % 10 == 0).cast("int")).withColumn("wide", F.lit("w"))
    out = S.stratified_split(df, "id", "y")
    sizes = {(r.y, r.split): r["count"] for r in out.groupBy("y", "split").count().collect()}
    assert sizes == {(0, "train"): 126000, (0, "val"): 27000, (0, "test"): 27000, (1, "train"): 14000, (1, "val"): 3000, (1, "test"): 3000}
    plan = out._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "wide" in line]
    assert not moved


def test_batches_with_and_without_repeats(spark):
    df = spark.range(10)
    assert S.sample_batch(df, "id", 4).count() == 4
    many = S.sample_batch(df, "id", 25)
    assert many.count() == 25 and many.select("id").distinct().count() == 10
    again = S.sample_batch(df, "id", 4).select("id").collect()
    assert again == S.sample_batch(df, "id", 4).select("id").collect()


def test_logs(spark, tmp_path):
    root = str(tmp_path / "log")
    assert logs.read_log(spark, root).count() == 0
    with pytest.raises(ValueError):
        logs.append_log(logs.read_log(spark, root).drop("date"), root)
    row = spark.createDataFrame([("a", 0.5)], "request_id string, probability double")
    logs.append_log(row, root, "20240101")
    logs.append_log(row, root, "20240103")
    log = logs.read_log(spark, root, since="20240102")
    assert [r.date for r in log.collect()] == ["20240103"]
    plan = log._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    with pytest.raises(FileNotFoundError):
        logs.read_split_ids(spark, str(tmp_path / "none"))
    runs = str(tmp_path / "runs")
    logs.append_run(spark, {"model_name": "m", "test_f1": 0.5}, runs)
    logs.append_run(spark, {"model_name": "n"}, runs)
    assert logs.read_runs(spark, runs).count() == 2 and len(logs.read_runs(spark, runs).columns) == 12
    with pytest.raises(ValueError):
        logs.append_run(spark, {"colour": 1}, runs)


def test_active_sample_needs_its_columns(spark, tmp_path):
    path = tmp_path / "s.csv"
    assert logs.read_active_sample(spark, str(path)) is None
    path.write_text("request_id,other\na,1\n")
    assert logs.read_active_sample(spark, str(path)) is None
    path.write_text('request_id,probability,payload\na,0.5,"{""k"": 1}"\n')
    row = logs.read_active_sample(spark, str(path)).first()
    assert (row.request_id, row.probability, row.payload) == ("a", 0.5, '{"k": 1}')
