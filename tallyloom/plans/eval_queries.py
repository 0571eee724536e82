"""Evaluation queries: prediction rows are derived from lineitem and orders by fixed rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import replies
from ..functions.stable import stable_hash_sql
from ..operators import evaluation as ev
from .registry import register, table

# one prediction per line item; the same text runs in both engines
_P = """l_orderkey::VARCHAR AS id, 'm' || (l_suppkey % 2)::VARCHAR || ':think:zero:t' || (l_linenumber % 3)::VARCHAR AS method,
(CASE WHEN (l_partkey + l_linenumber) % 5 = 0 THEN -1 WHEN (l_partkey * 7 + l_suppkey) % 3 = 0 THEN 1 - l_orderkey % 2 ELSE l_orderkey % 2 END)::INTEGER AS pred,
(l_orderkey % 2)::INTEGER AS gold, (((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000)::BIGINT AS row_order, l_linenumber::INTEGER AS sample_index"""


def _spark(text: str) -> str:
    return text.replace("VARCHAR", "STRING").replace("INTEGER", "INT")


PRED = f"p AS (SELECT *, (pred = gold)::INTEGER AS correct FROM (SELECT {_P} FROM lineitem))"


def preds(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey")
    out = rows.selectExpr(*[x for x in _split(_spark(_P))])
    return out.withColumn("correct", (F.col("pred") == F.col("gold")).cast("int"))


def _split(text: str) -> list[str]:
    """Cut a select list at its top-level commas."""
    out, depth, start, quoted = [], 0, 0, False
    for i, ch in enumerate(text):
        quoted ^= ch == "'"
        depth += ch == "(" and not quoted
        depth -= ch == ")" and not quoted
        if ch == "," and depth == 0 and not quoted:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


_PAIR = "o_orderkey::VARCHAR AS id, 'a ' || o_orderpriority AS sent0, 'b ' || o_orderstatus || ' ' || o_custkey::VARCHAR AS sent1, (o_custkey % 2)::INTEGER AS gold, o_orderkey AS row_index, 's' || (o_orderkey % 3)::VARCHAR AS split"
PAIRS = f"pr AS (SELECT {_PAIR} FROM orders)"


def pairs(spark, d):
    return table(spark, d, "orders").selectExpr(*_split(_spark(_PAIR)))


R6 = lambda c, a=None: f"round({c}, 6)::DOUBLE AS {a or c}"


def r6(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@register("ev_1_accuracy_by_method", f"WITH {PRED} SELECT method, {R6('avg(correct)', 'accuracy')}, count(*)::BIGINT AS n FROM p GROUP BY 1")
def ev_1(spark, d):
    return r6(ev.accuracy_by_method(preds(spark, d)), "accuracy")


@register("ev_2_make_order_swapped", f"WITH {PAIRS} SELECT id || '__swap' AS id, sent1 AS sent0, sent0 AS sent1, (1 - gold)::INTEGER AS gold FROM pr")
def ev_2(spark, d):
    return ev.make_order_swapped(pairs(spark, d))


@register("ev_3_order_augment", f"WITH {PAIRS} SELECT id, sent0, sent1, gold FROM pr UNION ALL SELECT id || '__train_swap', sent1, sent0, (1 - gold)::INTEGER FROM pr")
def ev_3(spark, d):
    return ev.order_augment(pairs(spark, d))


@register("ev_4_order_consistency", f"""WITH {PRED}, o AS (SELECT method, id, arg_max(pred, row_order) AS pred FROM p GROUP BY ALL),
s0 AS (SELECT method, CASE WHEN id::BIGINT % 7 = 0 THEN id ELSE id || '__swap' END AS id, CASE WHEN id::BIGINT % 5 = 0 THEN pred ELSE 1 - pred END AS pred, row_order FROM p),
s AS (SELECT method, regexp_replace(id, '__swap$', '') AS id, arg_max(pred, row_order) AS ps FROM s0 WHERE id LIKE '%\\_\\_swap' ESCAPE '\\' GROUP BY ALL)
SELECT method, {R6('avg((ps = 1 - pred)::INTEGER)', 'consistency')}, count(*)::BIGINT AS n FROM o JOIN s USING (method, id) GROUP BY 1""")
def ev_4(spark, d):
    p = preds(spark, d)
    key = F.col("id").cast("bigint")
    s = p.withColumn("pred", F.when(key % 5 == 0, F.col("pred")).otherwise(1 - F.col("pred"))).withColumn(
        "id", F.when(key % 7 == 0, F.col("id")).otherwise(F.concat("id", F.lit("__swap")))
    )
    return r6(ev.order_consistency(p, s), "consistency")


@register("ev_5_prompt_consistency", f"""WITH {PRED}, m AS (SELECT CASE WHEN id::BIGINT % 3 = 0 THEN replace(method, ':', '_') ELSE method END AS method, id, pred FROM p),
i AS (SELECT regexp_extract(method, '^(.*):[^:]*$', 1) AS family, id, count(*) AS c, min(pred) AS lo, max(pred) AS hi FROM m WHERE contains(method, ':') GROUP BY ALL)
SELECT family, {R6('avg((lo = hi)::INTEGER)', 'consistency')}, count(*)::BIGINT AS n FROM i WHERE c > 1 GROUP BY 1""")
def ev_5(spark, d):
    """Every third item's methods have no family."""
    p = preds(spark, d)
    bare = F.when(F.col("id").cast("bigint") % 3 == 0, F.translate("method", ":", "_")).otherwise(F.col("method"))
    return r6(ev.prompt_consistency(p.withColumn("method", bare)), "consistency")


_VOTE = """v AS (SELECT {k}, pred, count(*) AS n FROM p GROUP BY ALL),
fg AS (SELECT {k}, arg_min(gold, row_order) AS gold FROM p GROUP BY ALL),
w AS (SELECT {k}, pred, n, sum(n) OVER (PARTITION BY {k}) AS s FROM v QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY n DESC, (pred IN (0, 1)) DESC, pred) = 1),
cj AS (SELECT {k}, '{{' || string_agg('"' || pred || '":' || n, ',' ORDER BY pred) || '}}' AS counts FROM v GROUP BY ALL)"""


@register("ev_6_majority_vote_by_method", f"WITH {PRED}, {_VOTE.format(k='method, id')} SELECT method, id, pred, gold, (pred = gold)::INTEGER AS correct, {R6('n / s', 'vote_share')}, counts FROM w JOIN fg USING (method, id) JOIN cj USING (method, id)")
def ev_6(spark, d):
    return r6(ev.majority_vote(preds(spark, d)), "vote_share")


@register("ev_6_majority_vote", f"WITH {PRED}, {_VOTE.format(k='id')} SELECT id, pred, gold, (pred = gold)::INTEGER AS correct, {R6('n / s', 'vote_share')}, counts FROM w JOIN fg USING (id) JOIN cj USING (id)")
def ev_6b(spark, d):
    return r6(ev.majority_vote(preds(spark, d), by_method=False), "vote_share")


@register("ev_7_sampling_consistency", f"WITH {PRED}, {_VOTE.format(k='method, id')} SELECT method, {R6('avg(n / s)', 'consistency')}, count(*)::BIGINT AS n FROM w GROUP BY 1")
def ev_7(spark, d):
    return r6(ev.sampling_consistency(preds(spark, d)), "consistency")


_UNC = """uv AS (SELECT id, pred, count(*) AS n, min(row_order) AS f, arg_min(gold, row_order) AS g FROM p WHERE pred IN (0, 1) GROUP BY ALL),
u AS (SELECT id, arg_max(pred, (n, -f)) AS pred, arg_min(g, f) AS gold, max(n) / sum(n) AS confidence, sum(n)::BIGINT AS samples FROM uv GROUP BY 1),
uc AS (SELECT *, (pred = gold)::INTEGER AS correct FROM u)"""


def voted(spark, d):
    return ev.uncertainty(preds(spark, d))


@register("ev_8_uncertainty", f"WITH {PRED}, {_UNC} SELECT id, pred, gold, correct, {R6('confidence')}, samples FROM uc")
def ev_8(spark, d):
    return r6(voted(spark, d), "confidence")


@register("ev_8_mean_confidence", f"WITH {PRED}, {_UNC} SELECT {R6('avg(confidence)', 'mean_confidence')}, count(*)::BIGINT AS items FROM uc")
def ev_8b(spark, d):
    return r6(ev.mean_confidence(voted(spark, d)), "mean_confidence")


@register("ev_9_confidence_buckets", f"WITH {PRED}, {_UNC} SELECT CASE WHEN confidence < 0.6 THEN 'low' WHEN confidence < 0.8 THEN 'mid' ELSE 'high' END AS bucket, {R6('avg(correct)', 'accuracy')}, count(*)::BIGINT AS items FROM uc GROUP BY 1")
def ev_9(spark, d):
    return r6(ev.confidence_buckets(voted(spark, d)), "accuracy")


@register("ev_10_selective_prediction", f"""WITH {PRED}, {_UNC} SELECT t::DOUBLE AS threshold, {R6('count(*) FILTER (confidence >= t) / count(*)', 'coverage')},
round(coalesce(avg(correct) FILTER (confidence >= t), 0), 6)::DOUBLE AS accuracy FROM uc, (SELECT unnest([0.5, 0.6, 0.8, 1.0, 1.1]) AS t) GROUP BY t""")
def ev_10(spark, d):
    return r6(ev.selective_prediction(voted(spark, d), [0.5, 0.6, 0.8, 1.0, 1.1]), "coverage", "accuracy")


# replies of many shapes, one per line item
_REPLY = r"""CASE l_linenumber % 7
WHEN 0 THEN (l_partkey % 2)::VARCHAR
WHEN 1 THEN ' ' || (l_partkey % 2)::VARCHAR || chr(10)
WHEN 2 THEN 'Label: ' || (l_partkey % 3)::VARCHAR || ' because ' || l_returnflag
WHEN 3 THEN '{"label": ' || (l_partkey % 2)::VARCHAR || ', "score": ' || (l_partkey % 6)::VARCHAR || ', "reason": "part ' || l_partkey::VARCHAR || '"}'
WHEN 4 THEN 'so ' || (l_partkey % 30)::VARCHAR || ' of 2, score: ' || (l_partkey % 5 + 1)::VARCHAR || ' reason: line ' || l_linenumber::VARCHAR
WHEN 5 THEN 'I give ' || (l_partkey % 5 + 1)::VARCHAR || ' / 5 to it' ELSE '{"final_label": true, "explanation": "x", "score": "4"' || CASE WHEN l_partkey % 2 = 0 THEN '}' ELSE '' END END"""
_RESP = f"{_P}, {_REPLY} AS text"
RESP = f"rs AS (SELECT {_RESP} FROM lineitem)"


def responses(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_returnflag")
    return rows.selectExpr(*_split(_spark(_RESP)))


_TRIM = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_LABEL = f"""(CASE WHEN {_TRIM} IN ('0', '1') THEN {_TRIM} ELSE coalesce(nullif(regexp_extract({_TRIM}, '(?i)(?:label|answer|index)\\s*[:：]?\\s*([01])\\b', 1), ''),
nullif(regexp_extract({_TRIM}, '\\b([01])\\b', 1), '')) END)::INTEGER"""
_OBJ = "CASE WHEN json_valid(regexp_extract(text, '(?s)(\\{.*\\})', 1)) THEN regexp_extract(text, '(?s)(\\{.*\\})', 1) END"


@register("ev_11_parse_label", f"WITH {RESP} SELECT row_order, {_LABEL} AS label FROM rs")
def ev_11(spark, d):
    return responses(spark, d).select("row_order", replies.parse_label(F.col("text")).alias("label"))


@register("ev_12_parse_reply_fields", f"""WITH {RESP}, b AS (SELECT *, ({_OBJ})::JSON AS j, {_TRIM} AS s, {_LABEL} AS lab FROM rs)
SELECT row_order, CASE WHEN s IN ('0', '1') THEN '' ELSE coalesce(j->>'reason', j->>'explanation', nullif(regexp_extract(s, '(?is)(?:reason|explanation|rationale)\\s*[:：]\\s*(.+)', 1), ''), s) END AS reason,
coalesce(CASE WHEN regexp_matches(j->>'score', '^[1-5]$') THEN j->>'score' END, nullif(regexp_extract(s, '(?i)score\\s*[:：]?\\s*([1-5])\\b', 1), ''), nullif(regexp_extract(s, '\\b([1-5])\\s*/\\s*5\\b', 1), ''))::INTEGER AS score,
coalesce(CASE WHEN j->>'final_label' = 'true' THEN 1 END, CASE WHEN j->>'label' IN ('0', '1') THEN (j->>'label')::INTEGER END, lab)::INTEGER AS final_label FROM b""")
def ev_12(spark, d):
    r = responses(spark, d).select("row_order", "text")
    return replies.with_reply_fields(r, "text", ["reason", "score", "final_label"]).drop("text")


@register("ev_13_parse_predictions", f"WITH {RESP} SELECT id, method, coalesce({_LABEL}, -1)::INTEGER AS pred, gold, (coalesce({_LABEL}, -1) = gold)::INTEGER AS correct, row_order FROM rs")
def ev_13(spark, d):
    return ev.parse_predictions(responses(spark, d)).select("id", "method", "pred", "gold", "correct", "row_order")


@register("ev_14_candidate_id", f"WITH {PRED} SELECT row_order, CASE WHEN pred = 1 THEN 'c' || row_order ELSE id || '::' || CASE WHEN pred = 0 THEN method ELSE 'candidate' END || '::' || CASE WHEN gold = 0 THEN sample_index ELSE row_order END END AS candidate_id FROM p")
def ev_14(spark, d):
    p = preds(spark, d)
    given = F.when(F.col("pred") == 1, F.concat(F.lit("c"), F.col("row_order"))).when(F.col("pred") == 0, "")
    c = ev.candidate_id(
        given, F.col("id"), F.when(F.col("pred") == 0, F.col("method")), F.when(F.col("gold") == 0, F.col("sample_index")), F.col("row_order")
    )
    return p.select("row_order", c.alias("candidate_id"))


_RERANK = f"""rc AS (SELECT id || '::' || method || '::' || sample_index AS candidate_id, id, gold, sample_index, row_order, {_LABEL} AS label FROM rs),
cl AS (SELECT candidate_id, arg_max(struct_pack(id := id, gold := gold, label := label, sample_index := sample_index, row_order := row_order), row_order) AS c FROM rc WHERE label IS NOT NULL GROUP BY 1),
rv AS (SELECT candidate_id, arg_max((row_order // 7) % 6, row_order) AS sc FROM rc WHERE row_order % 3 <> 0 GROUP BY 1),
j AS (SELECT cl.candidate_id, c.id AS id, c.gold AS gold, c.label AS label, c.sample_index AS si, c.row_order AS ro, CASE WHEN sc BETWEEN 1 AND 5 THEN sc ELSE 0 END AS rank_score,
  CASE WHEN sc IS NULL THEN c.label WHEN sc % 2 = 0 THEN 1 ELSE 0 END AS pred FROM cl LEFT JOIN rv USING (candidate_id))"""


@register("ev_15_rerank", f"""WITH {RESP}, {_RERANK} SELECT id, candidate_id, gold, label, pred::INTEGER AS pred, coalesce(rank_score, 0)::INTEGER AS rank_score, (pred = gold)::INTEGER AS correct FROM j
QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(rank_score, 0) DESC, si, ro) = 1""")
def ev_15(spark, d):
    r = responses(spark, d).withColumn("candidate_id", F.concat_ws("::", "id", "method", "sample_index"))
    score = F.expr("(row_order div 7) % 6")
    v = r.filter("row_order % 3 <> 0").select(
        "candidate_id", "row_order",
        F.concat(F.lit('{"score": '), score, F.lit(', "final_label": '), F.when(score % 2 == 0, "1").otherwise("0"), F.lit("}")).alias("text"),
    )
    return ev.rerank(r, v)


@register("ev_16_combine_predictions", f"WITH {PRED}, {_VOTE.format(k='id')} SELECT id, method, pred, gold FROM p UNION ALL SELECT id, 'vote', pred, gold FROM w JOIN fg USING (id)")
def ev_16(spark, d):
    cols = ["id", "method", "pred", "gold"]
    p = preds(spark, d)
    vote = ev.majority_vote(p, by_method=False).withColumn("method", F.lit("vote"))
    return ev.combine_predictions(p.select(cols), vote.select(cols))


TEMPLATES = [("direct", "Sentence 0: {sent0}\nSentence 1: {sent1}\nLabel:"), ("terse", "{sent1} | {sent0}?")]


@register("ev_17_render_prompts", f"""WITH {PAIRS}, t AS (SELECT * FROM (VALUES ('z:direct', 'Sentence 0: ' , chr(10) || 'Sentence 1: ', chr(10) || 'Label:'))  v(method, a, b, c))
SELECT id, method, si::INTEGER AS sample_index, gold, sent0, sent1, a || sent0 || b || sent1 || c AS prompt FROM pr, t, (SELECT unnest([0, 1]) AS si)
UNION ALL SELECT id, 'z:terse', si::INTEGER, gold, sent0, sent1, sent1 || ' | ' || sent0 || '?' FROM pr, (SELECT unnest([0, 1]) AS si)""")
def ev_17(spark, d):
    return ev.render_prompts(pairs(spark, d), TEMPLATES, 2, "z")


@register("ev_17_verifier_prompts", f"WITH {PAIRS} SELECT id, 'Which: ' || sent0 || ' / ' || sent1 || '? Label ' || gold || ' as {{x}} ' || sent1 AS prompt FROM pr")
def ev_17b(spark, d):
    candidates = pairs(spark, d).select("id", "sent0", "sent1", F.col("gold").alias("label"), F.col("sent1").alias("reason"))
    return ev.verifier_prompts(candidates, "Which: {sent0} / {sent1}? Label {label} as {x} {reason}").select("id", "prompt")


@register("ev_18_select_demonstrations", f"""WITH {PAIRS}, r AS (SELECT id, sent0, sent1, gold, row_number() OVER (PARTITION BY gold ORDER BY {stable_hash_sql('id', 3)}, id) AS rn FROM pr)
SELECT id, sent0, sent1, gold, (2 * (rn - 1) + gold)::INTEGER AS position FROM r WHERE rn <= CASE WHEN gold = 0 THEN 5 ELSE 4 END""")
def ev_18(spark, d):
    return ev.select_demonstrations(pairs(spark, d), 9, 3)


@register("ev_19_clean_output", f"WITH {RESP} SELECT row_order, {_TRIM} AS cleaned FROM rs")
def ev_19(spark, d):
    thought = F.concat(F.lit("<think>a\nb</think> "), F.col("text"), F.lit("<think></think>"))
    return responses(spark, d).select("row_order", replies.clean_output(thought).alias("cleaned"))


@register("ev_20_resume_worklist", f"WITH {PRED}, f AS (SELECT id, method, sample_index, arg_min(pred, row_order) AS pred, min(row_order) AS row_order FROM p GROUP BY ALL) SELECT * FROM f WHERE row_order % 4 <> 1")
def ev_20(spark, d):
    keys = ["id", "method", "sample_index"]
    todo = ev.first_of_duplicates(preds(spark, d).select(*keys, "pred", "row_order"), keys, "row_order")
    return ev.resume_worklist(todo, todo.filter("row_order % 4 = 1"), keys)


@register("ev_21_label_balance", f"WITH {PAIRS} SELECT split, count(*)::BIGINT AS rows, count(*) FILTER (gold = 0)::BIGINT AS gold0, count(*) FILTER (gold = 1)::BIGINT AS gold1 FROM pr GROUP BY 1")
def ev_21(spark, d):
    return ev.label_balance(pairs(spark, d))


@register("ev_22_parse_method", """WITH m AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_partkey, array_to_string((['m' || l_suppkey, 'think', 'zero', 't' || l_linenumber, 'x'])[1:(l_partkey % 5 + 1)::INTEGER], ':') AS method FROM lineitem),
s AS (SELECT *, string_split(method, ':') AS p FROM m)
SELECT k, l_partkey, CASE WHEN len(p) <> 2 THEN p[1] ELSE '' END AS model, CASE WHEN len(p) >= 3 THEN p[2] ELSE '' END AS mode, CASE WHEN len(p) >= 3 THEN p[3] ELSE '' END AS setting,
CASE WHEN len(p) >= 4 THEN p[4] ELSE '' END AS template FROM s""")
def ev_22(spark, d):
    parts = F.array(F.concat(F.lit("m"), "l_suppkey"), F.lit("think"), F.lit("zero"), F.concat(F.lit("t"), "l_linenumber"), F.lit("x"))
    m = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_partkey",
        F.array_join(F.slice(parts, F.lit(1), (F.col("l_partkey") % 5 + 1).cast("int")), ":").alias("method"),
    )
    return m.select("k", "l_partkey", ev.parse_method(F.col("method")).alias("p")).select("k", "l_partkey", "p.*")


# metric rows: values measured on the prediction table, tagged with report file names
_MET = f"""{PRED}, acc AS (SELECT method, avg(correct) AS value FROM p GROUP BY 1),
fam AS (SELECT family || ':all' AS method, avg((lo = hi)::INTEGER) AS value FROM (SELECT regexp_extract(method, '^(.*):[^:]*$', 1) AS family, id, count(*) AS c, min(pred) AS lo, max(pred) AS hi FROM p GROUP BY ALL) WHERE c > 1 GROUP BY 1),
{_VOTE.format(k='method, id')}, sam AS (SELECT method, avg(n / s) AS value FROM w GROUP BY 1),
met AS (SELECT 'm_test_metrics.csv' AS source, 'zero_shot' AS experiment, method, 'accuracy' AS metric, value FROM acc
 UNION ALL SELECT 'm_test_metrics.csv', 'zero_shot', method, 'prompt_consistency', value FROM fam
 UNION ALL SELECT 'm_swap_metrics.csv', 'order_swap_accuracy', method, 'accuracy', value / 2 FROM acc
 UNION ALL SELECT 'm_order_metrics.csv', 'order_consistency', method, 'order_consistency', value / 3 FROM acc
 UNION ALL SELECT 'm_self_consistency_k5_metrics.csv', 'self_consistency_k5', method, 'accuracy', value FROM acc
 UNION ALL SELECT 'm_self_consistency_k5_metrics.csv', 'self_consistency_k5', method, 'sampling_consistency', value FROM sam),
mp AS (SELECT *, string_split(method, ':')[1] AS model, string_split(method, ':')[2] AS mode, string_split(method, ':')[4] AS template FROM met)"""


def metrics(spark, d):
    p = preds(spark, d)
    acc = ev.accuracy_by_method(p).select("method", F.col("accuracy").alias("value"))
    fam = ev.prompt_consistency(p).select(F.concat("family", F.lit(":all")).alias("method"), F.col("consistency").alias("value"))
    sam = ev.sampling_consistency(p).select("method", F.col("consistency").alias("value"))

    def rows(df, source, metric, scale=1):
        return df.select(F.lit(source).alias("source"), "method", F.lit(metric).alias("metric"), (F.col("value") / scale).alias("value"), F.lit(0).alias("row_order"))

    every = ev.combine_predictions(
        rows(acc, "m_test_metrics.csv", "accuracy"),
        rows(fam, "m_test_metrics.csv", "prompt_consistency"),
        rows(acc, "m_swap_metrics.csv", "accuracy", 2),
        rows(acc, "m_order_metrics.csv", "order_consistency", 3),
        rows(acc, "m_self_consistency_k5_metrics.csv", "accuracy"),
        rows(sam, "m_self_consistency_k5_metrics.csv", "sampling_consistency"),
    )
    return ev.with_method_parts(every)


_R3 = lambda c, a: f"round({c}, 3)::DOUBLE AS {a}"
_PC = "LEFT JOIN mp q ON q.experiment = '{e}' AND q.metric = 'prompt_consistency' AND q.model = a.model AND q.mode = a.mode"


@register("ev_23_accuracy_table", f"WITH {_MET} SELECT a.model, a.mode, a.template, {_R3('a.value', 'accuracy')}, {_R3('q.value', 'prompt_consistency')}, a.source FROM mp a {_PC.format(e='zero_shot')} WHERE a.experiment = 'zero_shot' AND a.metric = 'accuracy'")
def ev_23(spark, d):
    return ev.report_table(metrics(spark, d), "zero_shot", "accuracy")


@register("ev_23_order_table", f"""WITH {_MET} SELECT a.model, a.mode, a.template, {_R3('a.value', 'order_consistency')}, {_R3('q.value', 'prompt_consistency')}, {_R3('z.value', 'original_accuracy')}, {_R3('s.value', 'swap_accuracy')}, a.source
FROM mp a {_PC.format(e='zero_shot')} LEFT JOIN mp z ON z.experiment = 'zero_shot' AND z.metric = 'accuracy' AND z.method = a.method
LEFT JOIN mp s ON s.experiment = 'order_swap_accuracy' AND s.metric = 'accuracy' AND s.method = a.method WHERE a.experiment = 'order_consistency'""")
def ev_23b(spark, d):
    return ev.report_table(
        metrics(spark, d), "order_consistency", "order_consistency",
        [("zero_shot", "accuracy", "original_accuracy"), ("order_swap_accuracy", "accuracy", "swap_accuracy")],
    )


@register("ev_23_self_consistency_table", f"""WITH {_MET} SELECT a.model, a.mode, a.template, {_R3('a.value', 'accuracy')}, NULL::DOUBLE AS prompt_consistency, {_R3('s.value', 'sampling_consistency')}, a.source
FROM mp a LEFT JOIN mp s ON s.experiment = 'self_consistency_k5' AND s.metric = 'sampling_consistency' AND s.method = a.method WHERE a.experiment = 'self_consistency_k5' AND a.metric = 'accuracy'""")
def ev_23c(spark, d):
    return ev.report_table(metrics(spark, d), "self_consistency_k5", "accuracy", [("self_consistency_k5", "sampling_consistency", "sampling_consistency")])


@register("ev_24_best_of_table", f"""WITH {_MET}, b AS (SELECT * FROM mp WHERE metric = 'accuracy' QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY value DESC, model DESC, mode DESC, template DESC) = 1)
SELECT b.experiment, b.model, b.mode, b.template, {R6('b.value', 'value')}, {R6('o.value', 'other')} FROM b LEFT JOIN mp o ON o.metric = 'order_consistency' AND o.method = b.method""")
def ev_24(spark, d):
    return r6(ev.best_of_table(metrics(spark, d)), "value", "other")


@register("ev_25_alternate_order", f"""WITH {PAIRS} SELECT id, CASE WHEN row_index % 2 = 1 THEN sent1 ELSE sent0 END AS sent0, CASE WHEN row_index % 2 = 1 THEN sent0 ELSE sent1 END AS sent1,
(CASE WHEN row_index % 2 = 1 THEN 1 - gold ELSE gold END)::INTEGER AS gold, row_index FROM pr""")
def ev_25(spark, d):
    return ev.alternate_order(pairs(spark, d), "row_index")
