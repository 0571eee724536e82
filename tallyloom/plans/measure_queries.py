"""Classification, statistics and point-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stable import stable_hash_sql
from ..operators import classification as cv
from ..operators import points as pt
from ..operators import statistics as st
from .eval_queries import R6, r6
from .registry import register, table

# truth and prediction of every line item
LAB = "lb AS (SELECT l_linenumber - 1 AS truth, (l_partkey % 9 - 1)::INTEGER AS pred, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS id, l_extendedprice AS loss FROM lineitem)"
CLASSES = 8
CM = f"cm AS (SELECT truth::INTEGER AS truth, greatest(0, least(pred, {CLASSES - 1}))::INTEGER AS pred, count(*)::BIGINT AS n FROM lb WHERE truth BETWEEN 0 AND {CLASSES - 1} AND truth <> 5 GROUP BY ALL)"
SC = f"""cl AS (SELECT unnest(range({CLASSES}))::INTEGER AS class), sc AS (SELECT class, coalesce((SELECT sum(n) FROM cm WHERE truth = class), 0)::BIGINT AS support,
coalesce((SELECT sum(n) FROM cm WHERE pred = class), 0)::BIGINT AS predicted, coalesce((SELECT sum(n) FROM cm WHERE pred = class AND truth = class), 0)::BIGINT AS hit FROM cl)"""


def labels(spark, d):
    return table(spark, d, "lineitem").selectExpr(
        "l_linenumber - 1 AS truth", "cast(l_partkey % 9 - 1 as int) AS pred", "(l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS id", "l_extendedprice AS loss",
    )


def confusion(spark, d):
    return cv.confusion_matrix(labels(spark, d), "truth", "pred", CLASSES, ignore=5)


@register("cv_1_confusion_matrix", f"WITH {LAB}, {CM} SELECT a.class AS truth, b.class AS pred, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range({CLASSES}))::INTEGER AS class) a, (SELECT unnest(range({CLASSES}))::INTEGER AS class) b LEFT JOIN cm ON truth = a.class AND pred = b.class")
def cv_1(spark, d):
    return cv.dense_confusion(confusion(spark, d), CLASSES)


@register("cv_2_per_class_accuracy", f"WITH {LAB}, {CM}, {SC} SELECT class, support, round(CASE WHEN support > 0 THEN hit / support ELSE 0 END, 6)::DOUBLE AS accuracy FROM sc")
def cv_2(spark, d):
    return r6(cv.class_scores(confusion(spark, d), CLASSES, 0.0).select("class", "support", "accuracy"), "accuracy")


@register("cv_3_iou", f"WITH {LAB}, {CM}, {SC} SELECT class, predicted, hit, round(CASE WHEN support + predicted - hit > 0 THEN hit / (support + predicted - hit) END, 6)::DOUBLE AS iou FROM sc")
def cv_3(spark, d):
    return r6(cv.class_scores(confusion(spark, d), CLASSES).select("class", "predicted", "hit", "iou"), "iou")


@register("cv_3_miou_pixel_acc", f"WITH {LAB}, {CM}, {SC} SELECT round(avg(CASE WHEN support + predicted - hit > 0 THEN hit / (support + predicted - hit) END), 6)::DOUBLE AS miou, round(sum(hit) / sum(support), 6)::DOUBLE AS pixel_acc FROM sc")
def cv_3b(spark, d):
    return r6(cv.segmentation_summary(cv.class_scores(confusion(spark, d), CLASSES)), "miou", "pixel_acc")


@register("cv_4_weighted_loss", "SELECT round(sum(l * n) / greatest(sum(n), 1), 4)::DOUBLE AS loss FROM (SELECT l_orderkey, avg(l_extendedprice) AS l, count(*) AS n FROM lineitem GROUP BY 1)")
def cv_4(spark, d):
    b = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.avg("l_extendedprice").alias("l"), F.count(F.lit(1)).alias("n"))
    return cv.weighted_loss(b, "l", "n").withColumn("loss", F.round("loss", 4))


@register("cv_5_misclassified", f"WITH {LAB} SELECT id, truth::INTEGER AS truth, pred FROM lb WHERE truth <> pred ORDER BY id, pred LIMIT 25")
def cv_5(spark, d):
    return cv.misclassified(labels(spark, d), "truth", "pred", "id", 25).select("id", "truth", "pred")


def _weights_sql(raw: str) -> str:
    return f"""WITH {LAB}, c AS (SELECT unnest(range({CLASSES}))::INTEGER AS class), k AS (SELECT class, count(lb.truth)::BIGINT AS n FROM c LEFT JOIN lb ON truth = class GROUP BY 1),
f AS (SELECT class, n, n / sum(n) OVER () AS fr FROM k), g AS (SELECT *, greatest(fr, 1e-8) AS fl, (SELECT quantile_cont(fr, 0.5) FROM f WHERE fr > 0) AS med FROM f),
w AS (SELECT class, n, {raw} AS w FROM g), x AS (SELECT class, n, least(w / avg(w) OVER (), 2.5) AS w FROM w) SELECT class, n, round(w / avg(w) OVER (), 6)::DOUBLE AS weight FROM x"""


for _m, _raw in (("inverse", "1 / fl"), ("inverse_sqrt", "1 / sqrt(fl)"), ("median_frequency", "med / fl")):
    register(f"cv_6_class_weights_{_m}", _weights_sql(_raw))(
        lambda spark, d, m=_m: r6(cv.class_weights(labels(spark, d), "truth", CLASSES, m), "weight")
    )


@register("cv_7_rare_class_sampler", f"""WITH i AS (SELECT l_orderkey AS id, CASE WHEN max((l_linenumber = 7)::INTEGER) = 1 THEN 2.0 ELSE 1.0 END AS weight FROM lineitem GROUP BY 1),
e AS (SELECT id, weight, weight::DOUBLE * (SELECT count(*) FROM i) / (SELECT sum(weight::DOUBLE) FROM i) AS e FROM i)
SELECT id, weight::DOUBLE AS weight, (floor(e) + CASE WHEN {stable_hash_sql('id', 5)} / 4294967296.0::DOUBLE < e - floor(e) THEN 1 ELSE 0 END)::BIGINT AS copies FROM e""")
def cv_7(spark, d):
    return cv.rare_class_sampler(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "id"), "id", "l_linenumber", 7, seed=5)


@register("cv_8_stratified_split", f"""WITH r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {stable_hash_sql('o_orderkey', 2)}, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
q AS (SELECT *, greatest(1, round_even(n * 0.2, 0)::BIGINT) AS t, greatest(1, round_even(n * 0.1, 0)::BIGINT) AS v FROM r)
SELECT o_orderkey, CASE WHEN t + v >= n THEN (CASE WHEN r <= greatest(1, n // 6) THEN 'test' WHEN r <= 2 * greatest(1, n // 6) THEN 'val' ELSE 'train' END)
WHEN r <= t THEN 'test' WHEN r <= t + v THEN 'val' ELSE 'train' END AS split FROM q""")
def cv_8(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return cv.stratified_split(o, "o_orderkey", "o_orderpriority", 0.1, 0.2, 2).select("o_orderkey", "split")


@register("cv_9_random_split", f"SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {stable_hash_sql('o_orderkey', 4)}, o_orderkey) <= (SELECT round_even(count(*) * 0.8, 0) FROM orders) THEN 'train' ELSE 'val' END AS split FROM orders")
def cv_9(spark, d):
    return cv.random_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.8, 4).select("o_orderkey", "split")


@register("cv_10_limit_per_class", "SELECT p_brand, p_name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) <= 5")
def cv_10(spark, d):
    return cv.limit_per_class(table(spark, d, "part").select("p_brand", "p_name", "p_partkey"), "p_brand", ["p_name", "p_partkey"], 5)


_MS = "e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), ms AS (SELECT dim, avg(x) AS mean, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 1e-4)) AS std FROM e GROUP BY 1)"


@register("cv_11_mean_std", f"WITH {_MS} SELECT dim::INTEGER AS dim, {R6('mean')}, {R6('std')} FROM ms")
def cv_11(spark, d):
    return r6(cv.mean_std(table(spark, d, "embeddings"), "embedding"), "mean", "std")


@register("cv_11_normalize", f"WITH {_MS} SELECT vec_id, dim::INTEGER AS dim, round((x - mean) / std, 5) AS x FROM e JOIN ms USING (dim)")
def cv_11b(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    out = cv.normalize_features(e, "embedding", cv.mean_std(e, "embedding"))
    return out.select("vec_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.round("x", 5))


@register("cv_12_validate_splits", "SELECT l_returnflag, count(*)::BIGINT AS rows, min(l_linenumber) >= 0 AND max(l_linenumber) < 7 AS labels_ok, coalesce(l_returnflag = 'A' AND count(*) = 12345, false) AS size_ok FROM lineitem GROUP BY 1")
def cv_12(spark, d):
    return cv.validate_splits(table(spark, d, "lineitem"), "l_returnflag", "l_linenumber", 7, {"A": 12345, "R": -1})


@register("cv_12_matched_pairs", "SELECT count(DISTINCT o_custkey)::BIGINT AS left_keys, (SELECT count(*) FROM customer)::BIGINT AS right_keys, count(DISTINCT c_custkey)::BIGINT AS matched FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def cv_12b(spark, d):
    return cv.matched_pairs(table(spark, d, "orders").withColumnRenamed("o_custkey", "k"), table(spark, d, "customer").withColumnRenamed("c_custkey", "k"), "k")


@register("cv_13_best_row", """WITH t AS (SELECT l_suppkey AS run, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS epoch, l_discount AS score FROM lineitem WHERE l_discount > 0)
SELECT run, epoch, score AS best_score FROM t QUALIFY row_number() OVER (PARTITION BY run ORDER BY score DESC, epoch) = 1""")
def cv_13(spark, d):
    h = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("run"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")).alias("epoch"),
        F.when(F.col("l_discount") > 0, F.col("l_discount").cast("string")).otherwise("n/a").alias("score"),
    )
    return cv.best_row(h, ["run"], "score", "epoch", ["epoch"])


@register("cv_13_best_epoch", "SELECT o_orderkey::INTEGER AS epoch, o_totalprice AS score, o_custkey::DOUBLE AS also FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def cv_13b(spark, d):
    return cv.best_epoch(table(spark, d, "orders"), "o_totalprice", "o_orderkey", "o_custkey")


@register("cv_14_normalize_history", "SELECT o_orderkey::VARCHAR AS epoch, trim(o_orderpriority) AS note, '' AS lr FROM orders")
def cv_14(spark, d):
    raw = table(spark, d, "orders").select(F.col("o_orderkey").alias("  epoch "), F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")).alias(" a/note(B)"))
    return cv.normalize_history(raw, {"epoch": "epoch", "a/note(B)": "note", "lr/pg0": "lr"})


# frames: an order is an episode, its line items the frames
_FR = "fr AS (SELECT l_orderkey AS ep, (l_linenumber * 100000 + l_partkey) * 1000 + l_suppkey % 1000 AS frame, l_quantity AS a0, l_tax AS a1, (l_suppkey % 5)::BIGINT AS task FROM lineitem)"


def frames(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("ep"), ((F.col("l_linenumber") * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey") % 1000).alias("frame"),
        F.array("l_quantity", "l_tax").alias("actions"), (F.col("l_suppkey") % 5).alias("task"),
    )


_CK = f"""{_FR}, ck AS (SELECT ep, frame, task, a0, a1, list(a0) OVER w AS q, list(a1) OVER w AS t FROM fr WINDOW w AS (PARTITION BY ep ORDER BY frame ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))"""


@register("cv_16_action_chunks", f"""WITH {_CK} SELECT ep, frame, task,
array_to_string(list_transform(list_concat(q, list_transform(range(4 - len(q)), lambda x: 0.0::DOUBLE)), lambda v: v::BIGINT), ',') AS q0, len(q)::INTEGER AS n_valid FROM ck""")
def cv_16(spark, d):
    c = cv.action_chunks(frames(spark, d), "ep", "frame", "actions", 4, ["task"])
    return c.select(
        "ep", "frame", "task", F.array_join(F.transform("chunk", lambda a: a[0].cast("bigint")), ",").alias("q0"),
        F.size(F.filter("valid", lambda v: v)).alias("n_valid"),
    )


@register("cv_17_l1_breakdown", f"""WITH {_CK}, st AS (SELECT ep, task, a0, a1, unnest(q) AS t0, unnest(t) AS t1 FROM ck),
dm AS (SELECT ep, task, 0 AS dim, abs(a0 - t0) AS e FROM st UNION ALL SELECT ep, task, 1, abs(a1 - t1) FROM st)
SELECT 'task' AS granularity, task::BIGINT AS key, round(avg(e), 6) AS l1, count(*)::BIGINT AS elements FROM dm GROUP BY task UNION ALL SELECT 'episode', ep, round(avg(e), 6), count(*) FROM dm GROUP BY ep
UNION ALL SELECT 'dim', dim, round(avg(e), 6), count(*) FROM dm GROUP BY dim UNION ALL SELECT 'overall', NULL, round(avg(e), 6), count(*) FROM dm""")
def cv_17(spark, d):
    f = frames(spark, d)
    c = cv.action_chunks(f, "ep", "frame", "actions", 4, ["task"])
    guess = F.transform("chunk", lambda a: F.col("chunk")[0])
    return r6(cv.l1_breakdown(c.withColumn("guess", guess), "guess", "chunk", "valid", "task", "ep"), "l1")


_WIDE = "wd AS (SELECT 'r' || (o_custkey % 7) AS run, o_orderkey AS step, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS tl, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 2 END AS ev FROM orders)"


def phases(spark, d):
    w = table(spark, d, "orders").select(
        F.concat(F.lit("r"), F.col("o_custkey") % 7).alias("run"), F.concat("o_orderkey", F.lit(".0")).alias("step"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice").cast("string")).otherwise("").alias("train_loss"),
        F.col("o_totalprice").cast("string").alias("train_action_l1"), F.lit("0.1").alias("lr"),
        F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_totalprice") / 2).cast("string")).otherwise("").alias("eval_action_l1"),
    )
    return cv.split_long_metrics(w)


@register("cv_18_split_long_metrics", f"WITH {_WIDE} SELECT run, step::INTEGER AS step, 'train' AS phase, tl AS train_loss, NULL::DOUBLE AS eval_action_l1 FROM wd WHERE tl IS NOT NULL UNION ALL SELECT run, step::INTEGER, 'eval', NULL, ev FROM wd WHERE ev IS NOT NULL")
def cv_18(spark, d):
    return phases(spark, d).select("run", "step", "phase", "train_loss", "eval_action_l1")


@register("cv_18_legacy_metrics", """SELECT 'r' || (o_custkey % 7) AS run, o_orderkey::INTEGER AS step, (o_orderkey % 10)::INTEGER AS epoch, CASE WHEN o_orderkey % 3 <> 0 THEN 'train' ELSE 'eval' END AS phase,
CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS train_loss, CASE WHEN o_orderkey % 3 <> 0 THEN 0.5::DOUBLE END AS train_action_l1, CASE WHEN o_orderkey % 3 <> 0 THEN 0.1::DOUBLE END AS lr,
CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS eval_action_l1 FROM orders WHERE o_orderkey % 11 <> 0""")
def cv_18b(spark, d):
    """Rows without a header: five columns train, three columns eval, blank lines nothing."""
    o = table(spark, d, "orders")
    start = [F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 10).cast("string"), F.col("o_totalprice").cast("string")]
    row = F.when(F.col("o_orderkey") % 3 != 0, F.concat_ws(",", *start, F.lit("0.5"), F.lit("0.1"))).otherwise(F.concat_ws(",", *start))
    lines = o.select(F.concat(F.lit("r"), F.col("o_custkey") % 7).alias("run"), F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(row).alias("value"))
    return cv.parse_legacy_metrics(lines, "run", "value")


@register("cv_19_run_summary", f"""WITH {_WIDE} SELECT run, count(tl)::BIGINT AS train_points, count(ev)::BIGINT AS eval_points, arg_max(tl, step) FILTER (tl IS NOT NULL) AS last_train, min(ev) AS best_eval,
arg_max(ev, step) FILTER (ev IS NOT NULL) AS final_eval FROM wd GROUP BY 1""")
def cv_19(spark, d):
    return cv.run_summary(phases(spark, d))


@register("cv_20_compare_checkpoints", f"WITH {_WIDE}, s AS (SELECT run, min(ev) AS best, arg_max(ev, step) FILTER (ev IS NOT NULL) AS final FROM wd GROUP BY 1) SELECT run, best, final, {R6('final - best', 'absolute_delta')}, round((final - best) / best * 100, 4)::DOUBLE AS relative_delta_pct FROM s")
def cv_20(spark, d):
    s = cv.run_summary(phases(spark, d))
    c = cv.compare_checkpoints(s.select("run", F.col("best_eval").alias("v")), s.select("run", F.col("final_eval").alias("v")), "run", "v")
    return r6(c, "absolute_delta").withColumn("relative_delta_pct", F.round("relative_delta_pct", 4))


@register("cv_21_split_expectations", "SELECT s AS split, episodes, frames, CASE WHEN s = 'F' AND episodes > 0 AND false THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT unnest(['F', 'O', 'X']) AS s) LEFT JOIN (SELECT l_linestatus, count(DISTINCT l_orderkey)::BIGINT AS episodes, count(*)::BIGINT AS frames FROM lineitem GROUP BY 1) ON s = l_linestatus")
def cv_21(spark, d):
    a = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("split")).agg(
        F.countDistinct("l_orderkey").alias("episodes"), F.count(F.lit(1)).alias("frames")
    )
    return cv.split_expectations(a, {"F": (1, 1), "O": (2, 2), "X": (3, 3)})


@register("cv_22_dataset_summary", """WITH p AS (SELECT event_type, user_id, count(*) AS n, epoch(max(ts)) - epoch(min(ts)) AS s FROM events GROUP BY ALL)
SELECT event_type, count(*)::BIGINT AS episodes, sum(n)::BIGINT AS frames, round(sum(n - 1) / sum(s), 8)::DOUBLE AS fps FROM p GROUP BY 1""")
def cv_22(spark, d):
    s = cv.dataset_summary(table(spark, d, "events"), "event_type", "user_id", F.expr("unix_micros(cast(ts as timestamp)) / 1e6"))
    return s.withColumn("fps", F.round("fps", 8))


@register("cv_23_delta_vs_baseline", "WITH b AS (SELECT p_brand, avg(p_size) AS v FROM part GROUP BY 1), o AS (SELECT min(p_brand) AS k FROM part) SELECT p_brand, round(v, 6) AS v, round((v - (SELECT v FROM b WHERE p_brand = 'Brand#12')) * 100, 4) AS points FROM b")
def cv_23(spark, d):
    b = table(spark, d, "part").groupBy("p_brand").agg(F.avg("p_size").alias("v"))
    return r6(cv.delta_vs_baseline(b, "p_brand", "v", "Brand#12").withColumn("points", F.round("points", 4)), "v")


# ------------------------------------------------------------------ statistics
_PJ = """pa AS (SELECT l_partkey AS k, avg(l_extendedprice) AS v, nullif(count(*) % 4, 3)::DOUBLE AS w1, nullif(count(*) % 3, 2)::DOUBLE AS w2 FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
pb AS (SELECT l_partkey AS k, avg(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
pj AS (SELECT pa.k, pa.v AS a, pb.v AS b, pa.v - pb.v AS delta, coalesce(w1, w2, 1) AS weight FROM pa JOIN pb USING (k))"""


def pairs(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_extendedprice")
    n = F.count(F.lit(1))
    a = li.filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("k")).agg(
        F.avg("l_extendedprice").alias("v"), F.nullif(n % 4, F.lit(3)).alias("w1"), F.nullif(n % 3, F.lit(2)).alias("w2")
    )
    b = li.filter("l_returnflag = 'N'").groupBy(F.col("l_partkey").alias("k")).agg(F.avg("l_extendedprice").alias("v"))
    return st.paired_join(a, b, "k", "v", ["w1", "w2"])


@register("st_1_paired_join", f"WITH {_PJ} SELECT k, round(a, 7) AS a, round(b, 7) AS b, round(delta, 7) AS delta, weight FROM pj")
def st_1(spark, d):
    p = pairs(spark, d)
    return p.select("k", *[F.round(c, 7).alias(c) for c in ("a", "b", "delta")], "weight")


@register("st_2_paired_summary", f"""WITH {_PJ} SELECT count(*)::BIGINT AS paired_count, count(*) FILTER (delta > 0)::BIGINT AS better_count, round(count(*) FILTER (delta > 0) / count(*) * 100, 4)::DOUBLE AS better_pct,
round(avg(a), 4) AS mean_a, round(avg(b), 4) AS mean_b, round(avg(delta), 4) AS mean_delta, round(avg(delta) / avg(a) * 100, 4) AS relative_improvement_pct,
round(sum(a * weight) / sum(weight), 4) AS weighted_a, round(sum(b * weight) / sum(weight), 4) AS weighted_b, round(sum(delta * weight) / sum(weight), 4) AS weighted_delta FROM pj""")
def st_2(spark, d):
    s = st.paired_summary(pairs(spark, d))
    return s.select("paired_count", "better_count", *[F.round(c, 4).alias(c) for c in s.columns[2:]])


ROUNDS = 200
_CUTS = " + ".join(f"(h >= {c})::INTEGER" for c in st.poisson_cuts())


@register("st_3_bootstrap_ci", f"""WITH {_PJ}, x0 AS (SELECT delta, r, ((('0x' || substr(md5(k || ':9'), 1, 8))::BIGINT + r * {st.GOLDEN}) & 4294967295)::UBIGINT AS x FROM pj, (SELECT unnest(range({ROUNDS})) AS r)),
x1 AS (SELECT delta, r, (xor(x, x >> 16) * {st.MIX_1}::UBIGINT) & 4294967295 AS x FROM x0), x2 AS (SELECT delta, r, (xor(x, x >> 15) * {st.MIX_2}::UBIGINT) & 4294967295 AS x FROM x1),
dr AS (SELECT delta, r, xor(x, x >> 16) AS h FROM x2),
me AS (SELECT r, sum(({_CUTS}) * delta) / greatest(sum({_CUTS}), 1) AS m FROM dr GROUP BY 1), so AS (SELECT list(m ORDER BY m) AS s FROM me)
SELECT round(s[{int(0.025 * (ROUNDS - 1)) + 1}], 4) AS ci_low, round(s[{int(0.975 * (ROUNDS - 1)) + 1}], 4) AS ci_high FROM so""")
def st_3(spark, d):
    ci = st.bootstrap_ci(pairs(spark, d), "k", "delta", ROUNDS, 9)
    return ci.select(F.round("ci_low", 4).alias("ci_low"), F.round("ci_high", 4).alias("ci_high"))


@register("st_3_bootstrap_ci_exact", f"""WITH {_PJ}, rk AS (SELECT row_number() OVER (ORDER BY k) AS i, delta, count(*) OVER () AS n FROM pj),
dr AS (SELECT r, ('0x' || substr(md5(i || ':' || r || ':9'), 1, 8))::BIGINT % n + 1 AS j FROM rk, (SELECT unnest(range({ROUNDS})) AS r)),
me AS (SELECT r, avg(delta) AS m FROM dr JOIN rk ON i = j GROUP BY 1), so AS (SELECT list(m ORDER BY m) AS s FROM me)
SELECT round(s[{int(0.025 * (ROUNDS - 1)) + 1}], 4) AS ci_low, round(s[{int(0.975 * (ROUNDS - 1)) + 1}], 4) AS ci_high FROM so""")
def st_3b(spark, d):
    ci = st.bootstrap_ci_exact(pairs(spark, d), "k", "delta", ROUNDS, 9)
    return ci.select(F.round("ci_low", 4).alias("ci_low"), F.round("ci_high", 4).alias("ci_high"))


@register("st_3_bootstrap_ci_multinomial")
def st_3c(spark, d):
    """Exactly n draws a round; draws of a tree are not SQL, tests hold them against a plain version."""
    return st.bootstrap_ci_multinomial(pairs(spark, d), "k", "delta", ROUNDS, 9)



@register("st_4_pca")
def st_4(spark, d):
    projected, _, _ = st.pca(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 3)
    return projected.select("vec_id", *[F.round(F.col("projection")[j], 5).alias(f"p{j}") for j in range(3)])


def exposure(spark, d):
    return table(spark, d, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("double").alias("a"), F.col("l_quantity").alias("m"), F.col("l_discount").alias("c"), F.col("l_extendedprice").alias("y")
    )


@register("st_5_natural_effects")
def st_5(spark, d):
    e = st.natural_effects(exposure(spark, d), "y", "a", "m", ["c"])
    return spark.createDataFrame([(k, float(v)) for k, v in e.items()], "effect string, value double")


@register("st_6_trend_test", """WITH p AS (SELECT l_linenumber::DOUBLE AS x, count(*) AS n, sum((l_returnflag = 'R')::INTEGER) AS r FROM lineitem GROUP BY 1),
s AS (SELECT sum(n) AS N, sum(r) AS R, sum(x * r) AS xr, sum(x * n) AS xn, sum(x * x * n) AS xxn FROM p)
SELECT N::BIGINT AS n, R::BIGINT AS cases, round((xr - R / N * xn) / sqrt(R / N * (1 - R / N) * (xxn - xn * xn / N)), 6)::DOUBLE AS z FROM s""")
def st_6(spark, d):
    return r6(st.trend_test(table(spark, d, "lineitem"), "l_linenumber", F.col("l_returnflag") == "R"), "z")


@register("st_6_wald_test", """SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS coefficient FROM lineitem UNION ALL SELECT 'm', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem""")
def st_6b(spark, d):
    rows = st.wald_test(exposure(spark, d), "y", ["m"])
    return spark.createDataFrame([(r["term"], round(r["coefficient"], 4)) for r in rows], "term string, coefficient double")


@register("st_6_wald_test_logistic")
def st_6c(spark, d):
    rows = st.wald_test(exposure(spark, d).select("a", (F.col("m") / 10).alias("m")), "a", ["m"], family="binomial")
    return spark.createDataFrame([tuple(r.values()) for r in rows], "term string, coefficient double, se double, z double, p double")


# ---------------------------------------------------------------- point tables
_PT = "pt AS (SELECT vec_id AS id, e[1]::DOUBLE AS x, e[2]::DOUBLE AS y, e[3]::DOUBLE AS z, 0.3 + e[4]::DOUBLE AS r, 0.5 + e[5]::DOUBLE AS g, 0.3 + e[6]::DOUBLE AS b, 0.5 + e[7]::DOUBLE AS opacity FROM (SELECT vec_id, embedding AS e FROM embeddings))"


def cloud(spark, d):
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), e(0).alias("x"), e(1).alias("y"), e(2).alias("z"),
        (0.3 + e(3)).alias("r"), (0.5 + e(4)).alias("g"), (0.3 + e(5)).alias("b"), (0.5 + e(6)).alias("opacity"),
    )


def _q(t: str, ps: list[float], cols: str = "xyz") -> str:
    return ", ".join(f"quantile_cont({c}, {p}) AS {c}{i}" for c in cols for i, p in enumerate(ps)) + f" FROM {t}"


@register("geo_1_spatial_core_filter", f"""WITH {_PT}, an AS (SELECT * FROM pt WHERE opacity >= (SELECT quantile_cont(opacity, 0.35) FROM pt)), ce AS (SELECT {_q('an', [0.5])}),
di AS (SELECT an.*, sqrt(pow(x - x0, 2) + pow(y - y0, 2) + pow(z - z0, 2)) AS dist FROM an, ce), co AS (SELECT * FROM di WHERE dist <= (SELECT quantile_cont(dist, 0.82) FROM di)),
bx AS (SELECT {_q('co', [0.01, 0.99])})
SELECT id, x BETWEEN x0 - (x1 - x0) * 0.1 AND x1 + (x1 - x0) * 0.1 AND y BETWEEN y0 - (y1 - y0) * 0.1 AND y1 + (y1 - y0) * 0.1 AND z BETWEEN z0 - (z1 - z0) * 0.1 AND z1 + (z1 - z0) * 0.1 AS keep FROM pt, bx""")
def geo_1(spark, d):
    return pt.spatial_core_filter(cloud(spark, d), padding_ratio=0.1, min_keep=20)[0].select("id", "keep")


_RULE = "g > 0.18 AND g > r * 1.10 AND g > b * 1.04 AND greatest(r, g, b) - least(r, g, b) > 0.10 AND opacity > 0.25"


@register("geo_2_color_anchor_filter", f"""WITH RECURSIVE {_PT}, an AS (SELECT * FROM pt WHERE {_RULE}), sp AS (SELECT {_q('pt', [0.01, 0.99])}),
dg AS (SELECT *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2) + pow(z1 - z0, 2)) AS diag FROM sp),
ed AS MATERIALIZED (SELECT p.id AS a, q.id AS b FROM an p, an q, dg WHERE sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) <= diag * 0.08),
lb(id, c) AS (SELECT id, id FROM an UNION SELECT ed.b, lb.c FROM lb JOIN ed ON ed.a = lb.id WHERE lb.c < ed.b),
cp AS (SELECT id, min(c) AS c FROM lb GROUP BY 1), tp AS (SELECT c FROM cp GROUP BY 1 ORDER BY count(*) DESC, c LIMIT 1),
co AS (SELECT an.* FROM an JOIN cp USING (id) WHERE c = (SELECT c FROM tp)), bx AS (SELECT {_q('co', [0.01, 0.99])}),
lim AS (SELECT bx.x0 - (bx.x1 - bx.x0) * 0.3 - (dg.x1 - dg.x0) * 0.002 AS xa, bx.x1 + (bx.x1 - bx.x0) * 0.3 + (dg.x1 - dg.x0) * 0.002 AS xb,
 bx.y0 - (bx.y1 - bx.y0) * 0.3 - (dg.y1 - dg.y0) * 0.002 AS ya, bx.y1 + (bx.y1 - bx.y0) * 0.3 + (dg.y1 - dg.y0) * 0.002 AS yb,
 bx.z0 - (bx.z1 - bx.z0) * 0.3 - (dg.z1 - dg.z0) * 0.002 AS za, bx.z1 + (bx.z1 - bx.z0) * 0.3 + (dg.z1 - dg.z0) * 0.002 AS zb, diag FROM bx, dg)
SELECT id, x BETWEEN xa AND xb AND y BETWEEN ya AND yb AND z BETWEEN za AND zb AND
 EXISTS (SELECT 1 FROM co WHERE sqrt(pow(pt.x - co.x, 2) + pow(pt.y - co.y, 2) + pow(pt.z - co.z, 2)) <= diag * 0.05) AS keep FROM pt, lim""")
def geo_2(spark, d):
    return pt.color_anchor_filter(cloud(spark, d), min_anchors=20, min_keep=20, link_ratio=0.08, distance_ratio=0.05)[0].select("id", "keep")


@register("geo_3_dampen_luminance", f"""WITH {_PT}, l AS (SELECT *, r * 0.2126 + g * 0.7152 + b * 0.0722 AS lum FROM pt), t AS (SELECT quantile_cont(lum, 0.86) AS th FROM l),
h AS (SELECT id, r, g, b, lum >= th AND lum > 0.5 AS hi, least(1.0, 0.5 / greatest(lum, 1e-6)) AS sc FROM l, t)
SELECT id, {', '.join(f"round(greatest(0.0, least(1.0, CASE WHEN hi THEN {c} * sc * 0.75 + {c} * 0.25 ELSE {c} END)), 6)::DOUBLE AS {c}" for c in 'rgb')} FROM h""")
def geo_3(spark, d):
    return r6(pt.dampen_luminance(cloud(spark, d), target=0.5)[0].select("id", "r", "g", "b"), "r", "g", "b")


@register("geo_5_attach_masks", "SELECT page_id, 'masks/' || page_id || '.png' AS mask FROM pages")
def geo_5(spark, d):
    p = table(spark, d, "pages").select("page_id")
    f = p.select("page_id", F.concat(F.lit("frames/a.b/"), "page_id", F.lit(".jpg")).alias("frame"))
    m = p.select(F.concat(F.lit("masks/"), "page_id", F.lit(".png")).alias("path"))
    return pt.attach_masks(f, m, "frame", "path").select("page_id", "mask")


_OC = "(event_id % 100)::DOUBLE / 100"


@register("geo_6_registration_report", f"""WITH f AS (SELECT event_id, event_id % 5 <> 0 AS reg, CASE WHEN event_id % 5 <> 0 THEN {_OC} END AS occ FROM events)
SELECT count(*)::BIGINT AS extracted, count(*) FILTER (reg)::BIGINT AS registered, round(count(*) FILTER (reg) / count(*), 6)::DOUBLE AS ratio, min(occ) AS occupancy_min, max(occ) AS occupancy_max, round(avg(occ), 6) AS occupancy_mean,
count(*) FILTER (occ < 0.05 OR occ > 0.9)::BIGINT AS invalid, 'registration_ratio|mask_occupancy' AS failures, false AS passed FROM f""")
def geo_6(spark, d):
    reg = F.col("event_id") % 5 != 0
    f = table(spark, d, "events").select("event_id", reg.alias("reg"), F.when(reg, (F.col("event_id") % 100).cast("double") / 100).alias("occ"))
    r = pt.registration_report(f, F.col("reg"), F.col("occ"), "event_id", 0.9, 0.05, 0.9)
    return r6(r, "ratio", "occupancy_mean").select(
        "extracted", "registered", "ratio", "occupancy_min", "occupancy_max", "occupancy_mean", "invalid", F.array_join("failures", "|").alias("failures"), "passed"
    )


@register("geo_6_invalid_masks", f"SELECT event_id FROM events WHERE event_id % 5 <> 0 AND ({_OC} < 0.05 OR {_OC} > 0.9)")
def geo_6b(spark, d):
    f = table(spark, d, "events").filter("event_id % 5 <> 0").select("event_id", ((F.col("event_id") % 100).cast("double") / 100).alias("occ"))
    return pt.invalid_masks(f, F.col("occ"), "event_id", 0.05, 0.9)
