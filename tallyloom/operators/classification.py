"""Confusion tables, class weights, splits, action windows and run histories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import rank_by_hash, rank_by_order
from ..functions.stable import HASH_BITS, stable_hash


def confusion_matrix(rows: DataFrame, truth: str, pred: str, classes: int, ignore: int | None = None) -> DataFrame:
    """Sparse ``(truth, pred, n)``; ignored truths are left out, predictions clamped to the range."""
    t = F.col(truth)
    ok = (t >= 0) & (t < classes)
    if ignore is not None:
        ok = ok & (t != ignore)
    clamped = F.greatest(F.lit(0), F.least(F.col(pred), F.lit(classes - 1)))
    return rows.filter(ok).groupBy(t.cast("int").alias("truth"), clamped.cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def dense_confusion(confusion: DataFrame, classes: int) -> DataFrame:
    """All class pairs, zero counts included."""
    spark = confusion.sparkSession
    grid = spark.range(classes * classes).select(
        F.expr(f"cast(id div {classes} as int)").alias("truth"), F.expr(f"cast(id % {classes} as int)").alias("pred")
    )
    return grid.join(confusion, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def class_scores(confusion: DataFrame, classes: int, empty: float | None = None) -> DataFrame:
    """Per class support, accuracy (``empty`` for an absent class) and IoU (null for one)."""
    per = confusion.select(
        F.explode(
            F.array(
                F.struct(F.col("truth").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                         F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                         F.lit(0).cast("bigint").alias("hit")),
            )
        ).alias("c")
    ).select("c.*")
    sums = per.groupBy("class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    every = confusion.sparkSession.range(classes).select(F.col("id").cast("int").alias("class")).join(sums, "class", "left").na.fill(0)
    union = F.col("support") + F.col("predicted") - F.col("hit")
    absent = F.lit(empty).cast("double")
    return every.select(
        "class", "support", "predicted", "hit",
        F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(absent).alias("accuracy"),
        F.when(union > 0, F.col("hit") / union).alias("iou"),
    )


def segmentation_summary(scores: DataFrame) -> DataFrame:
    """Mean IoU over present classes and overall accuracy."""
    return scores.agg(
        F.coalesce(F.avg("iou"), F.lit(0.0)).alias("miou"),
        (F.sum("hit") / F.greatest(F.sum("support"), F.lit(1))).alias("pixel_acc"),
    )


def weighted_loss(batches: DataFrame, loss: str, n: str) -> DataFrame:
    return batches.agg((F.sum(F.col(loss) * F.col(n)) / F.greatest(F.sum(n), F.lit(1))).alias("loss"))


def misclassified(rows: DataFrame, truth: str, pred: str, id_col: str, limit: int) -> DataFrame:
    """The first ``limit`` wrong rows by id."""
    return rows.filter(F.col(truth) != F.col(pred)).orderBy(id_col).limit(limit)


def class_weights(labels: DataFrame, label: str, classes: int, method: str = "inverse_sqrt", cap: float = 2.5) -> DataFrame:
    """Class weights with mean 1, capped and normalised again."""
    spark = labels.sparkSession
    counts = labels.groupBy(F.col(label).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(classes).select(F.col("id").cast("int").alias("class")).join(counts, "class", "left").na.fill(0)
    all_classes = Window.partitionBy()  # one row per class
    freq = every.withColumn("freq", F.col("n") / F.greatest(F.sum("n").over(all_classes), F.lit(1)))
    floor = F.greatest("freq", F.lit(1e-8))
    if method == "inverse":
        raw = 1.0 / floor
    elif method == "inverse_sqrt":
        raw = 1.0 / F.sqrt(floor)
    elif method == "median_frequency":
        raw = F.percentile(F.when(F.col("freq") > 0, F.col("freq")), F.lit(0.5)).over(all_classes) / floor
    else:
        raise ValueError(f"unknown method {method}")
    level = lambda c: F.col(c) / F.greatest(F.avg(c).over(all_classes), F.lit(1e-8))
    out = freq.withColumn("w", raw).withColumn("w", level("w"))
    if cap > 0:
        out = out.withColumn("w", F.least("w", F.lit(float(cap)))).withColumn("w", level("w"))
    return out.select("class", "n", F.col("w").alias("weight"))


def rare_class_sampler(items: DataFrame, id_col: str, label: str, rare: object, weight: float = 2.0, multiplier: float = 1.0, seed: int = 0) -> DataFrame:
    """``(id, weight, copies)``: expected draws per item, the fraction settled by the item's hash."""
    per = items.groupBy(id_col).agg(F.max((F.col(label) == F.lit(rare)).cast("int")).alias("__has"))
    weighed = per.select(id_col, F.when(F.col("__has") == 1, float(weight)).otherwise(1.0).alias("weight"))
    total = weighed.agg(F.sum("weight").alias("__w"), F.count(F.lit(1)).alias("__n"))
    draws = F.greatest(F.col("__n"), F.bround(F.col("__n") * multiplier).cast("bigint"))
    # the totals are one row
    expected = weighed.join(F.broadcast(total.select("__w", draws.alias("__d"))), F.lit(True)).withColumn(
        "__e", F.col("weight") * F.col("__d") / F.col("__w")
    )
    u = stable_hash(F.col(id_col), seed) / float(2**HASH_BITS)
    return expected.select(id_col, "weight", (F.floor("__e") + (u < F.col("__e") - F.floor("__e")).cast("bigint")).alias("copies"))


def stratified_split(rows: DataFrame, id_col: str, label: str, val_ratio: float, test_ratio: float, seed: int) -> DataFrame:
    """Add ``split``: per class the first ranks by hash are test, the next val, the rest train."""
    hashed = rows.withColumn("__h", stable_hash(F.col(id_col), seed))
    ranked = rank_by_hash(hashed, [label], "__h", [id_col], rank="__r", total="__n")
    n = F.col("__n")
    want = lambda ratio: F.greatest(F.lit(1), F.bround(n * ratio).cast("bigint"))
    sixth = F.greatest(F.lit(1), F.expr("__n div 6"))
    eats = want(test_ratio) + want(val_ratio) >= n
    test, val = F.when(eats, sixth).otherwise(want(test_ratio)), F.when(eats, sixth).otherwise(want(val_ratio))
    split = F.when(F.col("__r") <= test, "test").when(F.col("__r") <= test + val, "val").otherwise("train")
    return ranked.withColumn("split", split).drop("__h", "__r", "__n")


def random_split(rows: DataFrame, id_col: str, train_ratio: float, seed: int) -> DataFrame:
    """Add ``split``: the first round(n * ratio) ids in hash order are train."""
    hashed = rows.withColumn("__h", stable_hash(F.col(id_col), seed))
    ranked = rank_by_hash(hashed, [], "__h", [id_col], rank="__r", total="__n")
    return ranked.withColumn("split", F.when(F.col("__r") <= F.bround(F.col("__n") * train_ratio), "train").otherwise("val")).drop("__h", "__r", "__n")


def limit_per_class(rows: DataFrame, label: str, order: Sequence[str], k: int) -> DataFrame:
    """The first k rows per class in name order (the rank is also cut before the shuffle)."""
    w = Window.partitionBy(label).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


def mean_std(rows: DataFrame, features: str, floor: float = 1e-4) -> DataFrame:
    """Per dimension mean and standard deviation from one pass of sums."""
    x = rows.select(F.posexplode(features).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    sums = x.groupBy("dim").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("x").alias("n"))
    mean = F.col("s") / F.col("n")
    return sums.select("dim", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(floor))).alias("std"))


def normalize_features(rows: DataFrame, features: str, stats: DataFrame) -> DataFrame:
    """Subtract the mean and divide by the deviation of each dimension."""
    # one row that holds one entry per dimension
    table = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("__s"))
    scaled = F.zip_with(F.col(features), F.col("__s"), lambda x, s: (x.cast("double") - s["mean"]) / s["std"])
    return rows.join(F.broadcast(table), F.lit(True)).withColumn(features, scaled).drop("__s")


def validate_splits(rows: DataFrame, split: str, label: str, classes: int, expected: Mapping[str, int]) -> DataFrame:
    """Per split: rows, label range check and size check."""
    wanted = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])
    return rows.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.min(label).alias("__lo"), F.max(label).alias("__hi")).select(
        split,
        "rows",
        ((F.col("__lo") >= 0) & (F.col("__hi") < classes)).alias("labels_ok"),
        F.coalesce(F.try_element_at(wanted, F.col(split)) == F.col("rows"), F.lit(False)).alias("size_ok"),
    )


def matched_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counts of keys on each side and on both."""
    a = left.select(key).distinct().withColumn("__a", F.lit(1))
    b = right.select(key).distinct().withColumn("__b", F.lit(1))
    return a.join(b, key, "full_outer").agg(
        F.count("__a").alias("left_keys"), F.count("__b").alias("right_keys"),
        F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("matched"),
    )


def best_row(rows: DataFrame, group: Sequence[str], score: str, order: str, keep: Sequence[str]) -> DataFrame:
    """First row with the greatest score above zero per group; unparsable scores are skipped."""
    parsed = rows.withColumn("__s", F.expr(f"try_cast({score} as double)")).filter("__s > 0 and not isnan(__s)")
    best = parsed.groupBy(*group).agg(F.max_by(F.struct(*keep, F.col("__s").alias("best_score")), F.struct(F.col("__s"), -F.col(order))).alias("b"))
    return best.select(*group, "b.*")


def best_epoch(history: DataFrame, score: str, epoch: str, also: str) -> DataFrame:
    """``(epoch, score, also)`` of the best row; zeros if no score is above zero."""
    parsed = history.select(
        F.col(epoch).cast("int").alias("epoch"), F.expr(f"try_cast({score} as double)").alias("score"), F.expr(f"try_cast({also} as double)").alias("also")
    ).filter("score > 0 and not isnan(score)")
    best = F.max_by(F.struct("epoch", "score", "also"), F.struct(F.col("score"), -F.col("epoch")))
    zero = F.struct(F.lit(0).alias("epoch"), F.lit(0.0).alias("score"), F.lit(0.0).alias("also"))
    return parsed.agg(F.coalesce(best, zero).alias("b")).select("b.*")


def normalize_history(raw: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Trim padded headers and values, rename and keep the listed columns ('' where missing)."""
    trimmed = raw.toDF(*[c.strip() for c in raw.columns])
    have = set(trimmed.columns)
    return trimmed.select(*[
        (F.coalesce(F.trim(F.col(f"`{old}`").cast("string")), F.lit("")) if old in have else F.lit("")).alias(new) for old, new in names.items()
    ])


def action_chunks(frames: DataFrame, episode: str, frame: str, actions: str, chunk: int, keep: Sequence[str] = ()) -> DataFrame:
    """Per frame the next ``chunk`` actions of its episode, zero-padded, with a valid mask.

    Each frame is sent to the at most ``chunk`` windows that hold it, so a very
    long episode is spread over all tasks.
    """
    ranked = rank_by_order(frames.select(episode, frame, actions, *keep), [episode], [frame], rank="__r")
    spread = ranked.select(
        "*", F.explode(F.sequence(F.greatest(F.col("__r") - chunk + 1, F.lit(1)), F.col("__r"))).alias("__w")
    )
    own = F.col("__w") == F.col("__r")
    windows = spread.groupBy(episode, "__w").agg(
        F.max(F.when(own, F.col(frame))).alias(frame),
        *[F.max(F.when(own, F.col(c))).alias(c) for c in keep],
        F.array_sort(F.collect_list(F.struct("__r", actions))).alias("__a"),  # at most chunk entries
    )
    taken = F.transform("__a", lambda s: s[actions])
    zeros = F.transform(F.element_at(taken, 1), lambda x: x * 0)
    return windows.select(
        episode, frame, *keep,
        F.concat(taken, F.array_repeat(zeros, chunk - F.size("__a"))).alias("chunk"),
        F.transform(F.sequence(F.lit(1), F.lit(chunk)), lambda i: i <= F.size("__a")).alias("valid"),
    )


def l1_breakdown(rows: DataFrame, pred: str, target: str, valid: str, task: str, episode: str) -> DataFrame:
    """Mean absolute error over valid steps by task, by episode, by dimension and overall.

    ``pred`` and ``target`` are arrays of arrays (step, dimension).  Errors are
    summed per (task, episode, dim) first; the four groupings read those sums.
    """
    steps = rows.select(task, episode, F.posexplode(F.arrays_zip(F.col(pred).alias("p"), F.col(target).alias("t"), F.col(valid).alias("v"))).alias("step", "z"))
    dims = steps.filter("z.v").select(task, episode, F.posexplode(F.arrays_zip(F.col("z.p").alias("p"), F.col("z.t").alias("t"))).alias("dim", "d"))
    base = dims.groupBy(task, episode, "dim").agg(F.sum(F.abs(F.col("d.p") - F.col("d.t"))).alias("s"), F.count(F.lit(1)).alias("c"))
    sets = base.groupingSets([[F.col(task)], [F.col(episode)], [F.col("dim")], []], task, episode, "dim").agg(
        F.grouping_id().alias("__g"), F.sum("s").alias("s"), F.sum("c").alias("c")
    )
    kind = F.when(F.col("__g") == 3, "task").when(F.col("__g") == 5, "episode").when(F.col("__g") == 6, "dim").otherwise("overall")
    return sets.select(
        kind.alias("granularity"), F.coalesce(F.col(task).cast("bigint"), F.col(episode).cast("bigint"), F.col("dim").cast("bigint")).alias("key"),
        (F.col("s") / F.greatest(F.col("c"), F.lit(1))).alias("l1"), F.col("c").alias("elements"),
    )


def split_long_metrics(wide: DataFrame) -> DataFrame:
    """Wide log rows to train rows and eval rows; one row may give both."""
    num = lambda c: F.expr(f"try_cast({c} as double)")
    train = F.struct(F.lit("train").alias("phase"), num("train_loss").alias("train_loss"), num("train_action_l1").alias("train_action_l1"), num("lr").alias("lr"), F.lit(None).cast("double").alias("eval_action_l1"))
    evals = F.struct(F.lit("eval").alias("phase"), F.lit(None).cast("double").alias("train_loss"), F.lit(None).cast("double").alias("train_action_l1"), F.lit(None).cast("double").alias("lr"), num("eval_action_l1").alias("eval_action_l1"))
    parts = F.array_compact(F.array(F.when(num("train_loss").isNotNull(), train), F.when(num("eval_action_l1").isNotNull(), evals)))
    return wide.select("run", F.expr("cast(try_cast(step as double) as int)").alias("step"), F.explode(parts).alias("m")).select("run", "step", "m.*")


def parse_legacy_metrics(lines: DataFrame, run: str, value: str) -> DataFrame:
    """Header-less rows by their number of columns: five or more train, three eval, else an error."""
    c = F.split(F.col(value), ",")
    n = F.size(c)
    kind = F.when(n >= 5, "train").when(n == 3, "eval").otherwise(
        F.raise_error(F.concat(F.lit("unexpected metrics row: "), F.col(value))).cast("string")
    )
    at = lambda i, ok: F.when(ok, F.get(c, F.lit(i)).cast("double"))
    return lines.filter(F.col(value) != "").select(
        run, F.get(c, F.lit(0)).cast("int").alias("step"), F.get(c, F.lit(1)).cast("int").alias("epoch"), kind.alias("phase"),
        at(2, n >= 5).alias("train_loss"), at(3, n >= 5).alias("train_action_l1"), at(4, n >= 5).alias("lr"), at(2, n == 3).alias("eval_action_l1"),
    )


def run_summary(phases: DataFrame) -> DataFrame:
    is_train, is_eval = F.col("phase") == "train", F.col("phase") == "eval"
    return phases.groupBy("run").agg(
        F.count_if(is_train).alias("train_points"),
        F.count_if(is_eval).alias("eval_points"),
        F.max_by(F.when(is_train, F.col("train_action_l1")), F.when(is_train, F.col("step"))).alias("last_train"),
        F.min("eval_action_l1").alias("best_eval"),
        F.max_by(F.when(is_eval, F.col("eval_action_l1")), F.when(is_eval, F.col("step"))).alias("final_eval"),
    )


def compare_checkpoints(best: DataFrame, final: DataFrame, key: str, value: str) -> DataFrame:
    b, f = best.select(key, F.col(value).alias("best")), final.select(key, F.col(value).alias("final"))
    delta = F.col("final") - F.col("best")
    return b.join(f, key).select(key, "best", "final", delta.alias("absolute_delta"), (delta / F.col("best") * 100.0).alias("relative_delta_pct"))


def split_expectations(actual: DataFrame, expected: Mapping[str, tuple[int, int]]) -> DataFrame:
    """``(split, episodes, frames)`` against expected numbers: PASS or FAIL, missing splits included."""
    rows = [(s, e, f) for s, (e, f) in expected.items()]
    want = actual.sparkSession.createDataFrame(rows, "split string, want_episodes bigint, want_frames bigint")
    same = (F.col("episodes") == F.col("want_episodes")) & (F.col("frames") == F.col("want_frames"))
    return want.join(actual, "split", "left").select(
        "split", "episodes", "frames", F.when(F.coalesce(same, F.lit(False)), "PASS").otherwise("FAIL").alias("status")
    )


def dataset_summary(frames: DataFrame, split: str, episode: str, stamp: Column, per_second: float = 1.0) -> DataFrame:
    """Episodes, frames and frame rate per split."""
    per = frames.groupBy(split, episode).agg(F.count(F.lit(1)).alias("n"), F.min(stamp).alias("a"), F.max(stamp).alias("b"))
    seconds = F.sum((F.col("b") - F.col("a")) / per_second)
    return per.groupBy(split).agg(
        F.count(F.lit(1)).alias("episodes"), F.sum("n").alias("frames"),
        F.when(seconds > 0, F.sum(F.col("n") - 1) / seconds).alias("fps"),
    )


def delta_vs_baseline(rows: DataFrame, key: str, value: str, base: str) -> DataFrame:
    """Improvement over the base row in percentage points."""
    one = rows.filter(F.col(key) == base).agg(F.max(value).alias("__b"))  # one row
    return rows.join(F.broadcast(one), F.lit(True)).select(key, value, ((F.col(value) - F.col("__b")) * 100).alias("points"))
