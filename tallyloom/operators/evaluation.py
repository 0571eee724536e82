"""Prediction tables: accuracy, consistency, votes, reranking, calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.replies import parse_label, with_reply_fields
from ..functions.stable import stable_hash

SWAP_MARK = "__swap"


def accuracy_by_method(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("method").agg(F.avg("correct").alias("accuracy"), F.count(F.lit(1)).alias("n"))


def metric_rows(table: DataFrame, method: Column, metric: str, value: Column, split: str, notes: Column | None = None) -> DataFrame:
    """The tidy metric form (method, metric, value, split, notes)."""
    notes = F.lit("") if notes is None else notes
    return table.select(
        method.alias("method"), F.lit(metric).alias("metric"), F.round(value.cast("double"), 6).alias("value"), F.lit(split).alias("split"), notes.alias("notes")
    )


def make_order_swapped(pairs: DataFrame, mark: str = SWAP_MARK) -> DataFrame:
    return pairs.select(
        F.concat("id", F.lit(mark)).alias("id"), F.col("sent1").alias("sent0"), F.col("sent0").alias("sent1"), (1 - F.col("gold")).cast("int").alias("gold")
    )


def order_augment(pairs: DataFrame, mark: str = "__train_swap") -> DataFrame:
    """Originals and swapped copies from one scan."""
    own = F.struct("id", "sent0", "sent1", "gold")
    swapped = F.struct(
        F.concat("id", F.lit(mark)).alias("id"), F.col("sent1").alias("sent0"), F.col("sent0").alias("sent1"), (1 - F.col("gold")).cast("int").alias("gold")
    )
    return pairs.select(F.explode(F.array(own, swapped)).alias("p")).select("p.*")


def _last(predictions: DataFrame, item: Column) -> DataFrame:
    return predictions.groupBy("method", item.alias("id")).agg(F.max_by("pred", "row_order").alias("pred"))


def order_consistency(original: DataFrame, swapped: DataFrame) -> DataFrame:
    """Per method the share of matched items whose swapped prediction is the mirror image."""
    own = _last(original, F.col("id"))
    ends = F.col("id").endswith(SWAP_MARK)
    other = _last(swapped.filter(ends), F.regexp_replace("id", SWAP_MARK + "$", "")).withColumnRenamed("pred", "pred_swap")
    return own.join(other, ["method", "id"]).groupBy("method").agg(
        F.avg((F.col("pred_swap") == 1 - F.col("pred")).cast("double")).alias("consistency"), F.count(F.lit(1)).alias("n")
    )


def family_of(method: Column) -> Column:
    """The method name without its last ``:`` part; null for a name without one."""
    return F.when(F.instr(method, ":") > 0, F.regexp_extract(method, r"^(.*):[^:]*$", 1))


def prompt_consistency(predictions: DataFrame) -> DataFrame:
    """Per method family the share of items, with two predictions or more, that all agree.

    Methods without a family are left out.
    """
    named = predictions.withColumn("family", family_of(F.col("method"))).filter("family is not null")
    items = named.groupBy("family", "id").agg(
        F.count(F.lit(1)).alias("__n"), F.min("pred").alias("__lo"), F.max("pred").alias("__hi")
    )
    return items.filter("__n > 1").groupBy("family").agg(
        F.avg((F.col("__lo") == F.col("__hi")).cast("double")).alias("consistency"), F.count(F.lit(1)).alias("n")
    )


def majority_vote(predictions: DataFrame, by_method: bool = True) -> DataFrame:
    """Most frequent prediction; ties prefer 0 and 1, then the smaller label.

    Votes are counted per label first, so a hot item reaches the second
    aggregation as one row per label.
    """
    keys = ["method", "id"] if by_method else ["id"]
    votes = predictions.groupBy(*keys, "pred").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row_order", "gold")).alias("__first")
    )
    best = F.struct(F.col("n"), F.col("pred").isin(0, 1), -F.col("pred"))
    voted = votes.groupBy(*keys).agg(
        F.max_by("pred", best).alias("pred"),
        F.min("__first").alias("__first"),
        F.max("n").alias("__top"),
        F.sum("n").alias("samples"),
        F.array_sort(F.collect_list(F.struct(F.col("pred").alias("label"), F.col("n")))).alias("__all"),  # one per label
    )
    entries = F.transform("__all", lambda s: F.struct(s["label"].cast("string"), s["n"]))
    gold = F.col("__first.gold")
    return voted.select(
        *keys,
        "pred",
        gold.alias("gold"),
        (F.col("pred") == gold).cast("int").alias("correct"),
        (F.col("__top") / F.col("samples")).alias("vote_share"),
        F.to_json(F.map_from_entries(entries)).alias("counts"),
    )


def sampling_consistency(predictions: DataFrame) -> DataFrame:
    votes = majority_vote(predictions)
    return votes.groupBy("method").agg(F.avg("vote_share").alias("consistency"), F.count(F.lit(1)).alias("n"))


def uncertainty(predictions: DataFrame) -> DataFrame:
    """Vote over valid labels per item, ties to the label seen first; confidence is its share."""
    votes = predictions.filter(F.col("pred").isin(0, 1)).groupBy("id", "pred").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row_order", "gold")).alias("__first")
    )
    best = F.struct(-F.col("n"), F.col("__first.row_order"))
    voted = votes.groupBy("id").agg(
        F.min_by("pred", best).alias("pred"), F.min("__first").alias("__first"), F.max("n").alias("__top"), F.sum("n").alias("samples")
    )
    gold = F.col("__first.gold")
    return voted.select(
        "id", "pred", gold.alias("gold"), (F.col("pred") == gold).cast("int").alias("correct"),
        (F.col("__top") / F.col("samples")).alias("confidence"), "samples",
    )


def mean_confidence(voted: DataFrame) -> DataFrame:
    return voted.agg(F.avg("confidence").alias("mean_confidence"), F.count(F.lit(1)).alias("items"))


def confidence_buckets(voted: DataFrame) -> DataFrame:
    # fixed values: the bucket edges
    c = F.col("confidence")
    bucket = F.when(c < 0.6, "low").when(c < 0.8, "mid").otherwise("high")
    return voted.groupBy(bucket.alias("bucket")).agg(F.avg("correct").alias("accuracy"), F.count(F.lit(1)).alias("items"))


def selective_prediction(voted: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Coverage and accuracy at confidence >= t, all thresholds in one aggregation."""
    sums = [F.count(F.lit(1)).alias("__n")]
    for i, t in enumerate(thresholds):
        inside = F.col("confidence") >= float(t)
        sums += [F.count_if(inside).alias(f"__c{i}"), F.sum(F.when(inside, F.col("correct")).otherwise(0)).alias(f"__a{i}")]
    one = voted.agg(*sums)
    some = F.when(F.col("__n") == 0, F.raise_error(F.lit("no predictions")).cast("bigint")).otherwise(F.col("__n"))
    rows = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            (F.col(f"__c{i}") / some).alias("coverage"),
            F.when(F.col(f"__c{i}") > 0, F.col(f"__a{i}") / F.col(f"__c{i}")).otherwise(0.0).alias("accuracy"),
        )
        for i, t in enumerate(thresholds)
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def parse_predictions(responses: DataFrame) -> DataFrame:
    """Replies to prediction rows; an unreadable label becomes -1 with a note."""
    rows = with_reply_fields(responses, "text", ["label", "reason"]).withColumn("pred", F.coalesce("label", F.lit(-1)))
    note = F.to_json(F.struct(F.when(F.col("pred") < 0, True).alias("invalid_label"), "sample_index", "reason"))
    return rows.select(
        "id", "method", "pred", "gold", (F.col("pred") == F.col("gold")).cast("int").alias("correct"), note.alias("notes"), "row_order"
    )


def candidate_id(given: Column, item: Column, method: Column, sample_index: Column, line_no: Column) -> Column:
    """The given id, else ``id::method::sample`` with the line number for a missing sample."""
    made = F.concat_ws(
        "::", item, F.coalesce(method, F.lit("candidate")), F.coalesce(sample_index.cast("string"), line_no.cast("string"))
    )
    return F.coalesce(F.nullif(given, F.lit("")), made)


def rerank(candidates: DataFrame, verifier: DataFrame, missing_score: int = 0) -> DataFrame:
    """Best candidate per item by verifier score, then by the lower sample index.

    candidates: candidate_id, id, gold, sample_index, text, row_order;
    verifier: candidate_id, text, row_order.  The last row per candidate_id wins.
    """
    own = (
        candidates.withColumn("label", parse_label(F.col("text"))).filter("label is not null")
        .groupBy("candidate_id").agg(F.max_by(F.struct("id", "gold", "label", "sample_index", "text", "row_order"), "row_order").alias("c"))
        .select("candidate_id", "c.*")
    )
    said = (
        with_reply_fields(
            verifier.groupBy("candidate_id").agg(F.max_by("text", "row_order").alias("vtext")), "vtext", ["score", "final_label"]
        ).select("candidate_id", "score", "final_label")
    )
    both = own.join(said, "candidate_id", "left").select(
        "candidate_id", "id", "gold", "label", "sample_index", "row_order",
        F.coalesce("score", F.lit(missing_score)).alias("rank_score"),
        F.coalesce("final_label", "label").alias("pred"),
    )
    order = F.struct(F.col("rank_score"), -F.col("sample_index"), -F.col("row_order"))
    best = both.groupBy("id").agg(F.max_by(F.struct("candidate_id", "gold", "label", "pred", "rank_score"), order).alias("b"))
    return best.select("id", "b.*", (F.col("b.pred") == F.col("b.gold")).cast("int").alias("correct"))


def combine_predictions(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def render_prompts(examples: DataFrame, templates: Sequence[tuple[str, str]], repeat: int, prefix: str) -> DataFrame:
    """Examples x templates x repeats from one scan; ``{sent0}`` and ``{sent1}`` are filled in.

    The templates are a short list in the caller's code, so they are unrolled as an array.
    """
    made = []
    for name, text in templates:
        # both fields are filled in one pass over the template's own text
        parts, rest = [], text
        while rest:
            hits = [(rest.find("{%s}" % f), f) for f in ("sent0", "sent1") if "{%s}" % f in rest]
            if not hits:
                parts.append(F.lit(rest))
                break
            at, field = min(hits)
            if at:
                parts.append(F.lit(rest[:at]))
            parts.append(F.col(field))
            rest = rest[at + len(field) + 2 :]
        made.append(F.struct(F.lit(f"{prefix}:{name}").alias("method"), F.concat(*parts).alias("prompt")))
    each = examples.select("*", F.explode(F.array(*made)).alias("__t"))
    return each.select(
        "id", "__t.method", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))).alias("sample_index"), "gold", "sent0", "sent1", "__t.prompt"
    )


def verifier_prompts(candidates: DataFrame, template: str) -> DataFrame:
    """Fill ``{sent0} {sent1} {label} {reason}`` of a verifier template per candidate."""
    text = F.lit(template)
    for field in ("sent0", "sent1", "label", "reason"):
        text = F.replace(text, F.lit("{%s}" % field), F.col(field).cast("string"))
    return candidates.withColumn("prompt", text)


def select_demonstrations(examples: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k rows balanced over labels 0 and 1, interleaved; an odd extra goes to label 0."""
    hashed = examples.filter(F.col("gold").isin(0, 1)).withColumn("__h", stable_hash(F.col("id"), seed))
    order = Window.partitionBy("gold").orderBy("__h", "id")
    quota = F.when(F.col("gold") == 0, k - k // 2).otherwise(k // 2)
    # the literal bound lets the rank filter run before the shuffle
    ranked = hashed.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k - k // 2).filter(F.col("rn") <= quota)
    picked = ranked.select("id", "sent0", "sent1", "gold", (2 * (F.col("rn") - 1) + F.col("gold")).cast("int").alias("position"))
    counted = picked.agg(F.count(F.lit(1)).alias("n")).first()["n"]  # at most k rows
    if counted < k:
        raise ValueError(f"not enough examples for {k} demonstrations")
    return picked


def resume_worklist(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work not done yet; null keys match null keys."""
    a, b = todo.alias("a"), done.select(*keys).distinct().alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, same, "left_anti")


def first_of_duplicates(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row per key."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r"))
    return best.select(*keys, "__r.*")


def label_balance(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("gold") == 0).alias("gold0"), F.count_if(F.col("gold") == 1).alias("gold1")
    )


def parse_method(method: Column) -> Column:
    """``model:mode:setting:template`` as a struct; two parts give blanks."""
    parts = F.split(method, ":")
    n = F.size(parts)
    part = lambda i, ok: F.when(ok, F.get(parts, F.lit(i))).otherwise("")
    return F.struct(
        part(0, n != 2).alias("model"), part(1, n >= 3).alias("mode"), part(2, n >= 3).alias("setting"), part(3, n >= 4).alias("template")
    )


def infer_experiment(source: Column) -> Column:
    return (
        F.when(source == "metrics.csv", "roberta_original")
        .when(source == "order_metrics.csv", "roberta_order")
        .when(source.contains("self_consistency"), "self_consistency_k5")
        .when(source.contains("few_shot_8"), "few_shot_8")
        .when(source.contains("order_metrics"), "order_consistency")
        .when(source.contains("swap_metrics"), "order_swap_accuracy")
        .when(source.endswith("test_metrics.csv"), "zero_shot")
        .otherwise("other")
    )


def _lookup(metrics: DataFrame, experiment: str, metric: str, keys: list[str], name: str) -> DataFrame:
    rows = metrics.filter((F.col("experiment") == experiment) & (F.col("metric") == metric))
    if "template" not in keys:
        rows = rows.withColumn(
            "model", F.when(F.col("model") == "", F.regexp_extract("source", r"^(.*?)(?:_non_thinking|_thinking|$)", 1)).otherwise(F.col("model"))
        ).withColumn(
            "mode", F.when(F.col("mode") == "", F.when(F.col("source").contains("non_thinking"), "non_thinking").otherwise("thinking")).otherwise(F.col("mode"))
        )
    return rows.groupBy(*keys).agg(F.max_by("value", F.struct("source", "row_order")).alias(name))


def with_method_parts(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("experiment", infer_experiment(F.col("source"))).withColumn("__m", parse_method(F.col("method"))).select(
        *metrics.columns, "experiment", "__m.*"
    )


def report_table(metrics: DataFrame, experiment: str, metric: str, extra: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """Rows of one experiment and metric with prompt consistency and other looked-up metrics.

    ``metrics`` is the output of :func:`with_method_parts`; ``extra`` lists
    (experiment, metric, column name) looked up by model, mode and template.
    """
    rows = metrics.filter((F.col("experiment") == experiment) & (F.col("metric") == metric)).select(
        "model", "mode", "template", F.round("value", 3).alias(metric), "source"
    )
    home = "zero_shot" if experiment == "order_consistency" else experiment
    rows = rows.join(_lookup(metrics, home, "prompt_consistency", ["model", "mode"], "prompt_consistency"), ["model", "mode"], "left")
    for exp, what, name in extra:
        rows = rows.join(_lookup(metrics, exp, what, ["model", "mode", "template"], name), ["model", "mode", "template"], "left")
    names = ["prompt_consistency", *[n for _, _, n in extra]]
    return rows.select(
        "model", "mode", "template", metric, *[F.round(n, 3).alias(n) for n in names], "source"
    ).orderBy(F.desc(metric), F.desc("model"), F.desc("mode"), F.desc("template"))


def best_of_table(metrics: DataFrame, metric: str = "accuracy", other: tuple[str, str] = ("order_consistency", "order_consistency")) -> DataFrame:
    """Top row per experiment with another metric of the same model, mode and template."""
    rows = metrics.filter(F.col("metric") == metric)
    order = F.struct("value", "model", "mode", "template")
    best = rows.groupBy("experiment").agg(F.max_by(F.struct("model", "mode", "template", "value"), order).alias("b")).select("experiment", "b.*")
    look = _lookup(metrics, other[0], other[1], ["model", "mode", "template"], "other")
    return best.join(look, ["model", "mode", "template"], "left").select("experiment", "model", "mode", "template", "value", "other")


def alternate_order(pairs: DataFrame, row_index: str) -> DataFrame:
    """Swap every odd row so that the right answer has no constant place."""
    odd = F.col(row_index) % 2 == 1
    return pairs.select(
        "id",
        F.when(odd, F.col("sent1")).otherwise(F.col("sent0")).alias("sent0"),
        F.when(odd, F.col("sent0")).otherwise(F.col("sent1")).alias("sent1"),
        F.when(odd, 1 - F.col("gold")).otherwise(F.col("gold")).cast("int").alias("gold"),
        row_index,
    )
