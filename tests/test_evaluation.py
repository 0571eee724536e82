import pytest
from pyspark.sql import functions as F

from tallyloom.functions import replies
from tallyloom.operators import evaluation as ev


def preds(spark, rows):
    return spark.createDataFrame(
        [(i, m, p, g, int(p == g), n) for n, (i, m, p, g) in enumerate(rows)],
        "id string, method string, pred int, gold int, correct int, row_order bigint",
    )


def test_label_cases(spark):
    cases = {"0": 0, " 1\n": 1, "Label：1": 1, "answer 0.": 0, "it is 1 of 2": 1, "10": None, "": None, "INDEX:0": 0}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["l"] for r in df.select("t", replies.parse_label(F.col("t")).alias("l")).collect()}
    assert got == cases


def test_reply_fields(spark):
    texts = [
        '{"final_label": true, "score": 4, "reason": " ok "}', 'x {"score": "5", "label": 0} y', "score: 3 because", "2 / 5 is it",
        '{"score": 4.0}', '{"score": 9}', "reason: it\nis", "1", '{"reason": 3, "rationale": "r"}', '{"answer": "1"',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = {r["n"]: (r["reason"], r["score"], r["final_label"]) for r in replies.with_reply_fields(df, "t").collect()}
    assert got[0] == ("ok", 4, 1)
    assert got[1][1:] == (5, 0)
    assert got[2][1] == 3 and got[3][1] == 2
    assert got[4][1] is None and got[5][1] is None
    assert got[6][0] == "it\nis"
    assert got[7] == ("", None, 1)
    assert got[8][0] == "r"
    assert got[9][2] == 1


@pytest.mark.parametrize("votes,want", [([1, 0], 0), ([-1, 0], 0), ([-1, -1, 0], -1), ([1, 1, 0], 1)])
def test_majority_ties(spark, votes, want):
    r = ev.majority_vote(preds(spark, [("a", "m", v, 0) for v in votes])).first()
    assert r["pred"] == want and r["vote_share"] == max(votes.count(v) for v in votes) / len(votes)


def test_uncertainty_first_seen(spark):
    r = ev.uncertainty(preds(spark, [("a", "m", 1, 0), ("a", "m", -1, 0), ("a", "m", 0, 0)])).first()
    assert (r["pred"], r["confidence"]) == (1, 0.5)


def test_order_consistency(spark):
    own = preds(spark, [("a", "m", 0, 0), ("b", "m", -1, 0), ("c", "n", 1, 1)])
    swapped = preds(spark, [("a__swap", "m", 0, 1), ("a__swap", "m", 1, 1), ("b__swap", "m", -1, 1), ("c", "n", 0, 0)])
    assert [tuple(r) for r in ev.order_consistency(own, swapped).collect()] == [("m", 0.5, 2)]


def test_rerank_prefers_low_sample(spark):
    c = spark.createDataFrame([(f"c{i}", "q", 1, i, "1", i) for i in range(3)], "candidate_id string, id string, gold int, sample_index int, text string, row_order bigint")
    v = spark.createDataFrame([("c1", "score: 3", 0), ("c2", "score: 3", 1)], "candidate_id string, text string, row_order bigint")
    assert ev.rerank(c, v).first()["candidate_id"] == "c1"


def test_selective_and_empty(spark):
    v = spark.createDataFrame([(0.5, 1), (0.8, 0), (1.0, 1)], "confidence double, correct int")
    rows = {r["threshold"]: r for r in ev.selective_prediction(v, [0.8, 2.0]).collect()}
    assert rows[0.8]["coverage"] == pytest.approx(2 / 3) and rows[0.8]["accuracy"] == 0.5
    assert rows[2.0]["accuracy"] == 0.0
    with pytest.raises(Exception, match="no predictions"):
        ev.selective_prediction(v.limit(0), [0.5]).collect()


def test_prompt_fill_is_not_repeated(spark):
    e = spark.createDataFrame([("i", "see {sent1}", "B", 1)], "id string, sent0 string, sent1 string, gold int")
    assert ev.render_prompts(e, [("t", "{sent0}-{sent1}")], 1, "p").first()["prompt"] == "see {sent1}-B"


def test_method_parts(spark):
    df = spark.createDataFrame([("a:b:c:d",), ("a:b:c",), ("a:b",), ("a",)], "m string")
    got = {r["m"]: tuple(r["p"]) for r in df.select("m", ev.parse_method(F.col("m")).alias("p")).collect()}
    assert got == {"a:b:c:d": tuple("abcd"), "a:b:c": ("a", "b", "c", ""), "a:b": ("", "", "", ""), "a": ("a", "", "", "")}
