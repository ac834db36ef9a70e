import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from siftline.operators import monitor as MO
from siftline.operators import policy as D
from siftline.operators import review as R

T0 = dt.datetime(2024, 1, 1)
AS_OF = "2024-02-01 00:00:00"


def test_gray_zone_outcomes_and_edges(spark):
    df = spark.createDataFrame([(p,) for p in (0.9, 0.1, 0.58, 0.7, 0.5)], "p double")
    got = [r[0] for r in df.select(D.gray_zone("p", 0.6, 0.2)).collect()]
    assert got == ["fraud", "legit", "review", "fraud", "legit"]
    edges = [r[0] for r in df.select(D.in_band("p", 0.6, 0.2)).collect()]
    assert edges == [False, False, True, True, True]
    assert D.band(0.98) == (pytest.approx(0.93), 1.0) and D.band(0.01)[0] == 0.0
    row = D.decide(df.limit(1), "p", 0.5).first()
    assert (row.binary_label, row.decision, row.threshold) == (1, "fraud", 0.5)


def test_rule_score(spark):
    schema = "title string, description string, requirements string, company_profile string, benefits string, required_education string, required_experience string, industry string"
    bad = ("Earn big", "from home, urgent money, no experience", None, None, None, None, None, None)
    good = ("Engineer", "d", "r" * 101, "c" * 101, "b" * 51, "x", "y", "z")
    edge = ("t", "d", "r" * 50, "c" * 50, "", "x", None, "")
    rows = D.rule_score(spark.createDataFrame([bad, good, edge], schema)).collect()
    assert [(round(r.rule_probability, 6), r.rule_decision) for r in rows] == [(0.9, "fraud"), (0.1, "legit"), (0.4, "review")]


def log(spark, rows):
    full = [(i, T0 + dt.timedelta(minutes=m), "m", p, "h", "{}") for i, m, p in rows]
    return spark.createDataFrame(full, "request_id string, created_at timestamp, model_version string, probability double, text_hash string, payload string")


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "request_id string")


def test_queue_policies(spark):
    rows = [(f"r{k}", k, k / 20) for k in range(21)]
    preds = log(spark, rows)
    done = ids(spark, ["r10", "r10", "r3"])
    active = spark.createDataFrame([("r9", 0.1), ("z", 0.99), ("r3", 0.2)], "request_id string, probability double")
    queue = R.review_queue(preds, done, active, policy="gray-zone", threshold=0.5, width=0.2, as_of=AS_OF)
    got = {r.request_id: r.probability for r in queue.collect()}
    # band edges included, the log's own r9 wins, the reviewed ones are out
    assert got == {"r8": 0.4, "r9": 0.45, "r11": 0.55, "r12": 0.6, "z": 0.99}
    page = R.queue_page(queue, limit=2, offset=1).collect()
    assert [r.request_id for r in page] == ["r12", "r11"] and page[0].total_pending == 5
    none = R.review_queue(preds, done, policy="gray-zone", threshold=0.975, width=0.01, as_of=AS_OF)
    assert none.count() == 19
    every = R.review_queue(preds, done, policy="entropy", as_of=AS_OF)
    assert [r.request_id for r in R.queue_page(every, 3).collect()] == ["r20", "r19", "r18"]
    first = R.queue_page(every, 2, order="uncertainty").collect()
    assert {r.request_id for r in first} == {"r9", "r11"}
    p = 0.45
    assert first[1].entropy == pytest.approx(-(p * math.log2(p) + 0.55 * math.log2(0.55)), abs=1e-6)
    assert R.review_queue(preds.limit(0), done, as_of=AS_OF).count() == 0


def test_sampling(spark):
    preds = log(spark, [("a", 0, 0.5), ("b", 0, 0.4), ("c", 0, 0.7), ("d", 0, 0.5)])
    for policy in ("entropy", "margin"):
        got = R.sample_uncertain(preds, ids(spark, ["a"]), 2, policy).collect()
        assert [r.request_id for r in got] == ["d", "b"]
    with pytest.raises(ValueError):
        R.sample_uncertain(preds, ids(spark, []), 2, "other")


def feedback(spark, rows):
    return spark.createDataFrame(
        [(f"f{k}", h, label, T0 + dt.timedelta(hours=t)) for k, (h, label, t) in enumerate(rows)],
        "request_id string, text_hash string, reviewer_label string, created_at timestamp",
    )


def test_latest_answer_per_text_and_hot_text(spark):
    fb = feedback(spark, [("h1", "fraud", 1), ("h1", "legit", 2), ("h1", "unsure", 3), ("h2", "fraud", 1), ("h2", "legit", 1), ("h3", "unsure", 1)])
    latest = {r.text_hash: r.reviewer_label for r in R.latest_feedback(fb).collect()}
    assert latest == {"h1": "legit", "h2": "legit"}
    # a third of the rows share one text
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "h1").otherwise(F.concat(F.lit("h"), F.col("id") % 100)).alias("text_hash"),
        F.lit(1).alias("fraudulent"),
    )
    out = R.apply_feedback(rows.withColumn("text_hash", F.when(F.col("id") != 7, F.col("text_hash"))), fb, "id").collect()
    assert len(out) == 3000 and len({r.id for r in out}) == 3000
    for r in out:
        known = r.text_hash in latest
        assert r._feedback_applied == known and r._original_label == 1
        assert r.fraudulent == (0 if known else 1)
    parts = R.skewed_lookup(rows, R.latest_feedback(fb), "text_hash", "id")
    assert "_salt" in parts._jdf.queryExecution().executedPlan().toString()


def test_admission(spark):
    known = R.known_ids(ids(spark, ["a", "b", None]), ids(spark, ["c"]))
    assert R.admit_feedback(ids(spark, ["a", "c"]), known).count() == 2
    with pytest.raises(ValueError):
        R.admit_feedback(ids(spark, []), known)
    with pytest.raises(ValueError):
        R.admit_feedback(ids(spark, ["a"] * 101), known)
    with pytest.raises(LookupError):
        R.admit_feedback(ids(spark, ["a", "x"]), known)
    assert R.admit_feedback(ids(spark, ["x"]), known.limit(0)).count() == 1


def test_feedback_records_are_masked_and_checked(spark):
    df = spark.createDataFrame([("a", "fraud", "me@x.org 555-0100", None)], "request_id string, reviewer_label string, rationale string, notes string")
    row = R.feedback_records(df, AS_OF).first()
    assert row.rationale == "[REDACTED_EMAIL] [REDACTED_PHONE]" and row.created_at == dt.datetime(2024, 2, 1)
    with pytest.raises(Exception, match="unknown reviewer label"):
        R.feedback_records(df.withColumn("reviewer_label", F.lit("maybe")), AS_OF).collect()


def test_leaderboard(spark):
    rows = [
        (0, "a", "c1", None, "0.9"), (1, "a", "c1", "2024-01-02", "0.5"), (2, "a", "c1", "2024-01-02", "0.7"),
        (3, " ", "c1", "2024-01-02", "0.99"), (4, "b", None, "bad", "x"), (5, "b", None, None, "0.4"), (6, "c", "c2", "2024-01-01", ""),
    ]
    runs = spark.createDataFrame(rows, "pos int, model_name string, config_hash string, timestamp string, test_f1 string")
    got = [(r.model_name, r.pos, r.test_f1) for r in R.latest_runs(runs, "pos").collect()]
    assert got == [("a", 1, 0.5), ("b", 4, None), ("c", 6, None)]
    table = spark.createDataFrame([(0, 0.5), (1, None), (2, float("nan")), (3, 0.9), (4, 0.5)], "pos int, v double")
    assert [r.pos for r in R.sort_table(table, "v", "asc", "pos").collect()] == [0, 4, 3, 1, 2]
    assert [r.pos for r in R.sort_table(table, "v", "desc", "pos").collect()] == [1, 2, 3, 0, 4]


def test_last_turns_are_cut_before_the_exchange(spark):
    chat = spark.range(500).select(F.when(F.col("id") < 400, 1).otherwise(2).alias("conv_id"), F.col("id").alias("turn"),
                                   F.lit("assistant").alias("role"), F.lit("t").alias("text"))
    out = R.last_turns(chat)
    assert sorted(r.turn for r in out.collect()) == [*range(390, 400), *range(490, 500)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_triggers(spark):
    fb = feedback(spark, [("h", "fraud", 30 * 24 + k % 3) for k in range(50)])
    row = MO.retrain_due(fb, "2024-01-30 12:00:00", AS_OF).first()
    assert (row.new_rows, row.due) == (50, True) and row.days == 1.5
    assert not MO.retrain_due(fb.limit(9), "2024-01-30 12:00:00", AS_OF).first().due
    assert MO.retrain_due(fb.limit(9), "2024-01-20 00:00:00", AS_OF).first().due


def test_deep_pages_equal_whole_sorts(spark, tmp_path):
    # many equal times and entropies, so cuts fall inside ties
    queue = spark.range(230).select(
        F.concat(F.lit("r"), F.col("id")).alias("request_id"), (F.col("id") % 7 / 10).alias("entropy"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=(F.col("id") % 3).cast("int"))).alias("created_at"),
    )
    for order in ("newest", "uncertainty"):
        root = str(tmp_path / order)
        R.write_queue_index(queue, root, order, rows_per_bucket=25)
        assert len(list((tmp_path / order / "rows").glob("page_bucket=*"))) > 3
        whole = [tuple(r) for r in R.queue_page(queue, 0, 0, order).collect()]
        for limit, offset in ((25, 0), (10, 95), (60, 120), (25, 220), (25, 230), (25, 9999), (0, 200)):
            got = [tuple(r) for r in R.indexed_page(spark, root, limit, offset).collect()]
            assert got == whole[offset:offset + limit if limit else None], (order, limit, offset)
    page = R.indexed_page(spark, root, 5, 1)
    assert "(page_bucket" in page._jdf.queryExecution().executedPlan().toString() and page.count() == 5
    R.write_queue_index(queue.limit(0), str(tmp_path / "none"))
    assert R.indexed_page(spark, str(tmp_path / "none")).count() == 0
