"""Document, transcript, file-source and track queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordering import rank_by_order
from ..functions.tokens import tokens_of
from ..operators import documents as dc
from ..operators import evaluation as ev
from ..sources import tables as st
from ..sources.arpa import scratch_path
from ..sources.order import path_below
from ..streaming import append as ap
from ..streaming import tracks as tk
from .eval_queries import _REPLY, PAIRS, PRED, _split, _spark, pairs, preds
from .registry import register, table

SP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
TOK = "list_filter(regexp_split_to_array(text, '[\\t\\n\\r ]+'), lambda t: t <> '')"


@register("doc_1_html_paragraphs")
def doc_1(spark, d):
    return dc.html_paragraphs(table(spark, d, "pages"), "page_id", "html")


@register("doc_1_html_paragraphs_leaf_only")
def doc_1b(spark, d):
    return dc.html_paragraphs(table(spark, d, "pages"), "page_id", "html", leaf_only=True)


@register("doc_2_clean_text", "SELECT doc_id, " + SP.format(c="regexp_replace(regexp_replace(text || '--------', '\\n+', chr(10), 'g'), '-{6,}', '-----', 'g')") + " AS text FROM documents")
def doc_2(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", dc.clean_page_text(F.concat("text", F.lit("--------"))).alias("text"))


_LAY = "ly AS (SELECT l_orderkey AS doc, ((l_linenumber * 100000 + l_partkey) * 1000 + l_suppkey % 1000) AS o, l_partkey % 2 AS pg, l_returnflag || l_linenumber::VARCHAR AS c FROM lineitem)"
_RUN = f"""{_LAY}, s AS (SELECT *, CASE WHEN lag(pg) OVER w = pg THEN 0 ELSE 1 END AS st FROM ly WINDOW w AS (PARTITION BY doc ORDER BY o)),
r AS (SELECT *, sum(st) OVER (PARTITION BY doc ORDER BY o) AS run FROM s), pgs AS (SELECT doc, run, pg, string_agg(c, '~' ORDER BY o) AS content FROM r GROUP BY ALL)"""


def layout_pages(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc"), ((F.col("l_linenumber") * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey") % 1000).alias("o"),
        (F.col("l_partkey") % 2).alias("pg"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("c"),
    )
    return dc.group_layout_pages(rows, "doc", "o", "pg", "c")


@register("doc_3_group_layout_pages", f"WITH {_RUN} SELECT doc, run::BIGINT AS run, pg, content FROM pgs")
def doc_3(spark, d):
    return layout_pages(spark, d).withColumn("content", F.array_join("content", "~"))


@register("doc_4_plain_document", f"WITH {_LAY} SELECT doc, string_agg(c, chr(10) ORDER BY o) AS text FROM ly GROUP BY 1")
def doc_4(spark, d):
    return dc.plain_document(layout_pages(spark, d), "doc", "run", "content")


@register("doc_5_text_paragraphs", "SELECT doc_id, (generate_subscripts(string_split(text, '. '), 1) - 1)::INTEGER AS pos, unnest(string_split(text, '. ')) AS text FROM documents")
def doc_5(spark, d):
    return dc.text_paragraphs(table(spark, d, "documents"), "doc_id", "text", ". ")


@register("doc_6_profile_table", "SELECT 'customer' AS name, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS columns, count(*)::BIGINT AS num_rows, least(count(*), 3)::INTEGER AS shown FROM customer")
def doc_6(spark, d):
    p = dc.profile_table(table(spark, d, "customer"), "customer")
    return p.select("name", F.array_join("columns", ",").alias("columns"), "num_rows", F.size("rows").alias("shown"))


_FIT = "CASE WHEN bool_and({c} IS NULL OR TRY_CAST({c} AS BIGINT) IS NOT NULL AND NOT contains({c}, '.')) THEN 'bigint' WHEN bool_and({c} IS NULL OR TRY_CAST({c} AS DOUBLE) IS NOT NULL) THEN 'double' WHEN bool_and({c} IS NULL OR TRY_CAST({c} AS BOOLEAN) IS NOT NULL) THEN 'boolean' ELSE 'string' END"


@register("doc_6_infer_types", f"""WITH o AS (SELECT o_orderkey::VARCHAR AS k, o_custkey || '.5' AS v, o_orderpriority AS s, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS f,
CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'late' ELSE o_orderkey::VARCHAR END AS l FROM orders)
{" UNION ALL ".join(f"SELECT '{c}' AS " + '"column", ' + _FIT.format(c=c) + " AS type FROM o" for c in "kvsfl")}""")
def doc_6b(spark, d):
    """The last order breaks the type of column l."""
    orders = table(spark, d, "orders")
    last = orders.agg(F.max("o_orderkey").alias("last"))  # one row
    key = F.col("o_orderkey").cast("string")
    o = orders.join(F.broadcast(last), F.lit(True)).select(
        key.alias("k"), F.concat("o_custkey", F.lit(".5")).alias("v"), F.col("o_orderpriority").alias("s"),
        F.when(F.col("o_orderkey") % 2 == 0, "true").otherwise("false").alias("f"), F.when(F.col("o_orderkey") == F.col("last"), "late").otherwise(key).alias("l"),
    )
    return dc.infer_types(o, ["k", "v", "s", "f", "l"])


@register("doc_7_equal_token_budget", f"WITH t AS (SELECT doc_id, source, {TOK} AS tk, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, array_to_string(tk[1:(4000 // n)::INTEGER], ' ') AS kept FROM t")
def doc_7(spark, d):
    t = table(spark, d, "documents").select("doc_id", "source", tokens_of(F.col("text")).alias("tk"))
    return dc.equal_token_budget(t, "source", "tk", 4000).select("doc_id", F.array_join("tk", " ").alias("kept"))


@register("doc_8_truncate_tokens", f"SELECT doc_id, array_to_string(({TOK})[1:64], ' ') AS kept FROM documents")
def doc_8(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(dc.truncate_head(tokens_of(F.col("text")), 64), " ").alias("kept"))


@register("doc_9_extract_urls", "SELECT page_id, unnest(regexp_extract_all(html || ' ' || url, 'https?://\\S+')) AS url FROM pages")
def doc_9(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.explode(dc.extract_urls(F.concat_ws(" ", "html", "url"))).alias("url"))


@register("doc_9_extract_markdown_urls", "SELECT page_id, unnest([url, url || 'x']) AS url FROM pages")
def doc_9b(spark, d):
    text = F.concat(F.lit("see ![a]("), "url", F.lit(") and [b c]("), "url", F.lit("x) [none]"))
    return table(spark, d, "pages").select("page_id", F.explode(dc.extract_markdown_urls(text)).alias("url"))


@register("doc_10_extract_code", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text || chr(10) WHEN 1 THEN 'x = 1' ELSE text END AS code FROM conversations")
def doc_10(spark, d):
    c = table(spark, d, "conversations")
    fenced = F.concat(F.lit("note ```py\n"), "text", F.lit("\n``` and ```\nmore```"))
    body = F.when(F.col("turn") % 3 == 0, fenced).when(F.col("turn") % 3 == 1, '{"code": "x = 1"}').otherwise(F.col("text"))
    return c.select("conv_id", "turn", dc.extract_code(body).alias("code"))


@register("doc_11_has_chinese", "SELECT doc_id, doc_id % 3 = 0 AS chinese, CASE WHEN doc_id % 3 = 0 THEN 'China' ELSE 'United States' END AS location FROM documents")
def doc_11(spark, d):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("中"))).otherwise(F.concat("text", F.lit("ー")))
    return table(spark, d, "documents").select("doc_id", dc.has_chinese(t).alias("chinese"), dc.search_locale(t)["location"].alias("location"))


_PATH = "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '/data/a b/' || page_id || '.PDF' WHEN 2 THEN url || '/Pic.JPG' ELSE 'C:\\x\\' || page_id || '.txt' END"


@register("doc_12_file_type", """WITH p AS (SELECT page_id, page_id % 4 AS k, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '') AS path, url, html FROM pages)
SELECT page_id, CASE k WHEN 0 THEN coalesce(nullif(regexp_extract(path, '([^/]*)$', 1), ''), list_filter(string_split(url, '/'), lambda x: x <> '')[-1]) WHEN 1 THEN page_id || '.PDF' WHEN 2 THEN 'Pic.JPG' ELSE page_id || '.txt' END AS name,
CASE k WHEN 1 THEN 'pdf' WHEN 2 THEN 'image' WHEN 0 THEN 'html' ELSE 'html' END AS type, true AS html FROM p""")
def doc_12(spark, d):
    k = F.col("page_id") % 4
    bare = F.regexp_replace("url", r"[?#].*$", "")
    path = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("/data/a b/"), "page_id", F.lit(".PDF"))).when(k == 2, F.concat(bare, F.lit("/Pic.JPG"))).otherwise(
        F.concat(F.lit("C:\\x\\"), "page_id", F.lit(".txt"))
    )
    p = table(spark, d, "pages").select("page_id", "html", path.alias("path"))
    return p.select("page_id", dc.url_basename(F.col("path")).alias("name"), dc.file_type(F.col("path"), F.col("html")).alias("type"), dc.contains_html(F.col("html")).alias("html"))


@register("doc_13_content_hash", "SELECT doc_id, sha256(text) AS h FROM documents")
def doc_13(spark, d):
    return table(spark, d, "documents").select("doc_id", dc.content_hash(F.col("text")).alias("h"))


_MSG = """'think ' || conv_id || CASE WHEN turn % 3 = 0 THEN '<tool_call> {"name": "search", "arguments": {"q":' || turn || '}}</tool_call> mid' WHEN turn % 3 = 1 THEN '<tool_call>broken {</tool_call><tool_call>{"name": "visit"}</tool_call>' ELSE '' END || CASE WHEN turn % 2 = 0 THEN '<answer> ' || role || '
</answer> end' ELSE '' END"""


@register("doc_14_parse_transcript", """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'unknown|visit' ELSE '' END AS names, CASE turn % 3 WHEN 0 THEN '{"q":' || turn || '}' WHEN 1 THEN '{}|{}' ELSE '' END AS args,
CASE WHEN turn % 2 = 0 THEN role END AS answer, 'think ' || conv_id || CASE WHEN turn % 3 = 0 THEN ' mid' ELSE '' END || CASE WHEN turn % 2 = 0 THEN ' end' ELSE '' END AS thinking FROM conversations""")
def doc_14(spark, d):
    m = table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{_MSG} AS text")
    p = dc.parse_transcript(m, "text")
    return p.select(
        "conv_id", "turn", F.array_join(F.transform("tool_calls", lambda c: c["name"]), "|").alias("names"),
        F.array_join(F.transform("tool_calls", lambda c: c["arguments"]), "|").alias("args"), "answer", "thinking",
    )


@register("doc_15_termination_class", f"""WITH r AS (SELECT conv_id, count(*) AS calls, sum(len({TOK})) AS tokens, arg_max(role, turn) AS lr FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN tokens > 300 AND lr = 'assistant' THEN 'generate an answer as token limit reached' WHEN tokens > 300 THEN 'format error: generate an answer as token limit reached'
WHEN lr = 'assistant' THEN 'answer' WHEN calls >= 3 AND conv_id % 2 = 0 THEN 'forced_answer' WHEN calls >= 3 THEN 'exceed available llm calls' ELSE 'answer not found' END AS termination FROM r""")
def doc_15(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.size(tokens_of(F.col("text"))).alias("n"))
    r = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("calls"), F.sum("n").alias("tokens"), F.max_by("role", "turn").alias("lr"))
    r = r.select(
        "conv_id", "calls", "tokens", F.when(F.col("lr") == "assistant", "<answer>x</answer>").otherwise("none").alias("last_text"),
        F.when(F.col("conv_id") % 2 == 0, "<answer>").alias("forced_text"),
    )
    return dc.termination_class(r, 3, 300).select("conv_id", "termination")


@register("doc_16_shard_worklist", "SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) BETWEEN ceil((SELECT count(*) FROM documents) / 7) * 2 + 1 AND ceil((SELECT count(*) FROM documents) / 7) * 3")
def doc_16(spark, d):
    return dc.shard_worklist(table(spark, d, "documents").select("doc_id"), "doc_id", 7, 3)


_Q = "q AS (SELECT conv_id, 'q' || conv_id AS question FROM conversations GROUP BY 1)"


@register("doc_17_rollout_worklist", f"WITH {_Q} SELECT question, r::INTEGER AS rollout FROM q, (SELECT unnest([1, 2, 3]) AS r) WHERE NOT (conv_id % 2 = 0 AND r = 1)")
def doc_17(spark, d):
    q = table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", F.concat(F.lit("q"), "conv_id").alias("question"))
    done = q.select(F.concat(F.lit(" "), "question").alias("question"), F.lit(1).alias("rollout"), F.when(F.col("conv_id") % 2 == 1, "err").alias("error"))
    return dc.rollout_worklist(q, done, "question", 3).select("question", "rollout")


@register("doc_19_rollout_errors", "SELECT turn::BIGINT AS rollout, count(*) FILTER (conv_id % 3 = 0)::BIGINT AS done, count(*) FILTER (conv_id % 3 = 1)::BIGINT AS failed, count(*) FILTER (conv_id % 3 = 2)::BIGINT AS timeout FROM conversations GROUP BY 1")
def doc_19(spark, d):
    k = F.col("conv_id") % 3
    r = table(spark, d, "conversations").select(F.col("turn").alias("rollout"), F.when(k == 1, "bad").when(k == 2, "Timeout after 1").alias("error"))
    return dc.rollout_errors(r)


@register("doc_20_parse_search_results", """SELECT page_id, CASE WHEN page_id % 5 = 4 THEN 'No results found for ''q' || page_id || '''. Try with a more general query.' ELSE
'A Google search for ''q' || page_id || ''' found 2 results:' || chr(10) || chr(10) || '## Web Results' || chr(10) || '1. [t](' || url || ')' || chr(10) || 'Date published: d' || chr(10) || chr(10) || 's' || chr(10) || chr(10) || '2. [u](v)' || chr(10) END AS rendered FROM pages""")
def doc_20(spark, d):
    p = table(spark, d, "pages")
    one = F.struct(F.lit("t").alias("title"), F.col("url").alias("link"), F.lit("d").alias("date"), F.lit("s").alias("snippet"))
    two = F.struct(F.lit("u").alias("title"), F.lit("v").alias("link"), F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("snippet"))
    body = F.when(F.col("page_id") % 5 == 4, "{}").otherwise(F.to_json(F.struct(F.array(one, two).alias("organic"))))
    rows = p.select("page_id", F.concat(F.lit("q"), "page_id").alias("q"), body.alias("body"))
    return dc.parse_search_results(rows, "q", "body").select("page_id", "rendered")


# --------------------------------------------------------------- file sources


@register("src_5_read_pairs", f"WITH {PAIRS} SELECT id, sent0, sent1, gold FROM pr")
def src_5(spark, d):
    path = scratch_path(spark, "pairs")
    st.write_pairs(pairs(spark, d), path)
    return st.read_pairs(spark, path)


@register("src_6_read_predictions", f"""WITH {PRED} SELECT id, method, pred, gold, correct, '{{"a":"x,' || chr(10) || 'y"}}' AS notes,
row_number() OVER (ORDER BY id::BIGINT, method, pred, gold, correct)::BIGINT AS line FROM p""")
def src_6(spark, d):
    """Written sorted into several files of different sizes; ``line`` is the rank by the reader's order."""
    path = scratch_path(spark, "predictions")
    order = [F.col("id").cast("bigint"), *map(F.col, ("method", "pred", "gold", "correct"))]
    p = preds(spark, d).withColumn("notes", F.lit('{"a":"x,\ny"}')).repartitionByRange(5, *order).sortWithinPartitions(*order)
    st.write_predictions(p, path)
    return rank_by_order(st.read_predictions(spark, path), [], ["row_order"], rank="line").drop("row_order")


@register("src_7_read_responses", f"SELECT l_orderkey::VARCHAR AS id, l_linenumber::INTEGER AS sample_index, {_REPLY} AS text FROM lineitem")
def src_7(spark, d):
    li = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", *[f"{_spark(_REPLY)} AS reply"])
    path = scratch_path(spark, "replies")
    k = F.col("l_linenumber") % 3
    li.select(
        F.col("l_orderkey").cast("string").alias("id"), F.col("l_linenumber").alias("sample_index"), F.when(k == 0, F.col("reply")).when(k == 1, "").alias("response"),
        F.when(k == 1, F.col("reply")).alias("output_text"), F.when(k == 2, F.col("reply")).alias("text"),
    ).write.json(path)
    return st.read_responses(spark, path).select("id", "sample_index", "text")


@register("src_8_read_questions", "SELECT 'ask ' || conv_id AS question, 'a' AS answer FROM conversations WHERE turn <> 1")
def src_8(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn")
    path = scratch_path(spark, "questions")
    ask = F.concat(F.lit("ask "), "conv_id")
    msgs = F.array(F.struct(F.lit("system").alias("role"), F.lit("s").alias("content")), F.struct(F.lit("user").alias("role"), F.concat(F.lit("note User: "), ask, F.lit(" ")).alias("content")))
    c.select(F.when(F.col("turn") == 0, ask).when(F.col("turn") == 1, " ").alias("question"), F.lit("a").alias("answer"), F.when(F.col("turn") > 1, msgs).alias("messages")).write.json(path)
    return st.read_questions(spark, path)


@register("src_12_read_episodes", "SELECT 's' || (l_orderkey % 3) AS split, l_orderkey AS episode, count(*)::BIGINT AS frames FROM lineitem GROUP BY ALL")
def src_12(spark, d):
    path = scratch_path(spark, "episodes")
    li = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_orderkey") % 3).alias("split"), F.col("l_orderkey").alias("episode"), "l_linenumber", "l_tax")
    for s in ("s0", "s1", "s2"):
        li.filter(F.col("split") == s).drop("split").write.parquet(f"{path}/{s}")
    return st.read_episodes(spark, path, ["s0", "s1", "s2"], ["episode"]).groupBy("split", "episode").agg(F.count(F.lit(1)).alias("frames"))


@register("src_13_to_columnar", "SELECT event_id, event_type, value FROM events WHERE event_id % 9 <> 0")
def src_13(spark, d):
    src, out = scratch_path(spark, "raw.jsonl"), scratch_path(spark, "events")
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    whole = F.to_json(F.struct("event_id", "event_type", "value"))
    e.select(F.when(F.col("event_id") % 9 == 0, F.left(whole, F.lit(12))).otherwise(whole).alias("value")).write.text(src)
    st.to_columnar(spark, src, out, "event_id bigint, event_type string, value double", "event_type")
    return spark.read.schema("event_id bigint, value double, event_type string").parquet(out)


@register("src_14_read_metric_files", f"WITH {PRED} SELECT method, 'accuracy' AS metric, round(avg(correct), 6)::DOUBLE AS value FROM p GROUP BY 1")
def src_14(spark, d):
    path = scratch_path(spark, "metrics")
    acc = ev.accuracy_by_method(preds(spark, d))
    ev.metric_rows(acc, F.col("method"), "accuracy", F.col("accuracy"), "test").write.option("header", "true").csv(path)
    return st.read_metric_files(spark, path).select("method", "metric", "value")


@register("src_15_artifact_manifest", "SELECT event_type AS kind, count(*)::BIGINT AS lines, CASE WHEN event_type = 'click' THEN 'check' ELSE 'ok' END AS status FROM events GROUP BY 1")
def src_15(spark, d):
    path = scratch_path(spark, "artifacts")
    table(spark, d, "events").select("event_type", F.to_json(F.struct("event_id", "props")).alias("value")).write.partitionBy("event_type").text(path)
    kind = F.regexp_extract("file", r"event_type=([^/]*)/", 1)
    m = st.artifact_manifest(spark, path, F.when(kind == "click", -1))
    return m.groupBy(kind.alias("kind")).agg(F.sum("lines").alias("lines"), F.min("status").alias("status"))


@register("src_16_file_integrity", """SELECT event_type AS file, CASE event_type WHEN 'click' THEN 'missing' WHEN 'error' THEN 'hash mismatch' WHEN 'view' THEN 'too small' ELSE 'ok' END AS status FROM events GROUP BY 1""")
def src_16(spark, d):
    """Files per event type, checked against a manifest of their hashes."""
    path = scratch_path(spark, "files")
    e = table(spark, d, "events").select("event_type", "event_id")
    e.write.partitionBy("event_type").csv(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    kind = F.regexp_extract("path", r"event_type=([^/]*)/", 1)
    m = files.select(
        F.when(kind == "click", F.concat(path_below(spark, path, F.col("path")), F.lit(".gone"))).otherwise(path_below(spark, path, F.col("path"))).alias("file"),
        F.when(kind == "error", "0").otherwise(F.sha2("content", 256)).alias("sha256"),
        F.when(kind == "view", F.col("length") + 1).otherwise(F.col("length")).alias("min_size"),
    )
    checked = st.file_integrity(spark, path, m)
    return checked.select(F.regexp_extract("file", r"event_type=([^/]*)/", 1).alias("file"), "status").distinct()


# --------------------------------------------------------------------- tracks


def detections(spark, d):
    """Events as detections: a user is a video, a minute a frame, the value the x place."""
    e = table(spark, d, "events")
    minute = F.expr("cast(unix_seconds(cast(ts as timestamp)) div 600 as bigint)") - 2840112
    return e.select(
        F.col("user_id").cast("string").alias("video_id"), minute.alias("frame"), (F.col("event_id") % 7).alias("raw_track_id"),
        F.element_at(F.array(F.lit("car"), F.lit("taxi"), F.lit("bus"), F.lit("dog")), (F.col("event_id") % 4 + 1).cast("int")).alias("class_name"),
        F.col("value").alias("cx"), (F.col("event_id") % 300).cast("double").alias("cy"), F.lit(80.0).alias("width"), F.lit(60.0).alias("height"), "ts",
    )


RULES = tk.TrackRules(line=60.0, window=400, distance=120.0)


@register("trk_1_track_reconnect")
def trk_1(spark, d):
    return tk.track_reconnect(detections(spark, d), RULES)


_CR = """cr AS (SELECT user_id, event_type, ts, event_id, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS pv FROM events),
hit AS (SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM cr WHERE (pv < 60 AND value >= 60) OR (value <= 60 AND pv > 60) GROUP BY ALL)"""


@register("trk_2_line_crossings", f"WITH {_CR} SELECT user_id, event_type, event_id FROM hit")
def trk_2(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return tk.line_crossings(e, ["user_id", "event_type"], ["ts", "event_id"], "value", 60.0).select("user_id", "event_type", "event_id")


@register("trk_3_predict_missing")
def trk_3(spark, d):
    return tk.track_reconnect(detections(spark, d), RULES).filter("kind = 'predicted'")


@register("trk_4_class_family", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'car_like' WHEN 1 THEN 'car_like' WHEN 2 THEN 'large_vehicle' ELSE 'dog' END AS family FROM events")
def trk_4(spark, d):
    name = F.element_at(F.array(F.lit(" Car"), F.lit("taxi"), F.lit("BUS "), F.lit("dog")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", tk.class_family(name).alias("family"))


_FRM = "f AS (SELECT user_id::VARCHAR AS video_id, epoch(ts)::BIGINT // 86400 AS frame, event_id AS display_id, (event_id % 50)::BIGINT AS c FROM events)"


@register("trk_5_frame_records", f"WITH {_FRM} SELECT video_id, frame, string_agg(display_id::VARCHAR, ',' ORDER BY display_id) AS ids, max(c) AS count FROM f GROUP BY ALL")
def trk_5(spark, d):
    e = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("video_id"), F.expr("unix_seconds(cast(ts as timestamp)) div 86400").alias("frame"), F.col("event_id").alias("display_id"),
        F.col("event_type").alias("class_name"), F.col("value").alias("cx"), F.col("value").alias("cy"), F.lit("seen").alias("kind"), (F.col("event_id") % 50).alias("count"),
    )
    return tk.frame_records(e).select("video_id", "frame", F.array_join(F.transform("detections", lambda x: x["display_id"].cast("string")), ",").alias("ids"), "count")


@register("trk_5_track_summary")
def trk_5b(spark, d):
    return tk.track_summary(tk.track_reconnect(detections(spark, d), RULES))


@register("trk_6_track_reconnect_with_eviction")
def trk_6(spark, d):
    return tk.track_reconnect(detections(spark, d), tk.TrackRules(line=60.0, window=60, distance=120.0, evict=True))


@register("trk_6_streaming_tracks")
def trk_6b(spark, d):
    """The state machine on a file stream of the events."""
    src, out, mark = (scratch_path(spark, n) for n in ("det", "tracked", "mark"))
    rows = detections(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.unionByName(tk.closing_mark(rows, "ts", "1 minute")).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    tracked = tk.stream_track_reconnect(stream, RULES, "ts", "1 minute")
    tracked.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(tracked.schema).parquet(out)


@register("trk_7_incremental_append_dedup", "SELECT event_id, event_type FROM events")
def trk_7(spark, d):
    src, out, mark = (scratch_path(spark, n) for n in ("log", "merged", "mark"))
    e = table(spark, d, "events").select("event_id", "event_type")
    e.filter("event_id % 3 <> 0").write.parquet(src)
    stream = lambda: spark.readStream.schema(e.schema).parquet(src)
    ap.append_new(stream(), out, mark, ["event_id"]).awaitTermination()
    e.write.mode("append").parquet(src)  # a restart delivers everything again
    ap.append_new(stream(), out, mark, ["event_id"]).awaitTermination()
    return spark.read.schema(e.schema).parquet(f"{out}/batch=*")
