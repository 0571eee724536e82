"""Corpus-preparation queries over documents, events, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import minhash as mh
from ..functions.stable import stable_hash_sql
from ..functions.tokens import tokens_of
from ..operators import mixture as mx
from ..operators import near_dup as nd
from ..operators import prep
from ..session import materialise
from .registry import register, shared, table

SHINGLE = 5
TOK = "list_filter(regexp_split_to_array(text, '[\\t\\n\\r ]+'), lambda t: t <> '')"
DT = f"dt AS (SELECT doc_id, source, lang, text, {TOK} AS toks, len({TOK})::BIGINT AS nt FROM documents)"


def docs_tok(spark, d):
    toks = tokens_of(F.col("text"))
    return table(spark, d, "documents").select("doc_id", "source", "lang", "text", toks.alias("toks"), F.size(toks).cast("bigint").alias("nt"))


_RULES = "CASE WHEN NOT coalesce({c}, false) THEN '{n}' END"


@register("prep_1_validate_schema", """SELECT event_id, coalesce(array_to_string(list_filter([
CASE WHEN NOT coalesce(value > 0.05, false) THEN 'value low' END, CASE WHEN NOT coalesce(value < 100, false) THEN 'value high' END,
CASE WHEN NOT coalesce(event_type IN ('click', 'view', 'purchase', 'signup'), false) THEN 'event_type' END,
CASE WHEN NOT coalesce(user_id >= 10, false) THEN 'user_id' END], lambda x: x IS NOT NULL), '|'), '') AS errors FROM events""")
def prep_1(spark, d):
    v = F.col("value")
    rules = {
        "value low": v > 0.05,
        "value high": v < 100,
        "event_type": F.col("event_type").isin("click", "view", "purchase", "signup"),
        "user_id": F.col("user_id") >= 10,
    }
    checked = prep.validate_schema(table(spark, d, "events"), rules, {"value": F.when(F.isnan("value"), None).otherwise(F.col("value"))})
    return checked.select("event_id", F.array_join("errors", "|").alias("errors"))


_CUT = "CASE WHEN event_id % 7 = 0 THEN substr(props, 1, length(props) - 1) WHEN event_id % 11 = 0 THEN props || '}' WHEN event_id % 13 = 0 THEN '{\"k\" 1}' ELSE props END"


@register("prep_2_quarantine_bad_rows", f"""SELECT event_id, raw, reason, k FROM (SELECT event_id, raw,
CASE WHEN json_valid(raw) THEN NULL WHEN length(regexp_replace(raw, '[^{{\\[]', '', 'g')) > length(regexp_replace(raw, '[^}}\\]]', '', 'g')) THEN 'truncated'
WHEN length(regexp_replace(raw, '[^{{\\[]', '', 'g')) <> length(regexp_replace(raw, '[^}}\\]]', '', 'g')) THEN 'unbalanced brackets' ELSE 'syntax' END AS reason,
CASE WHEN json_valid(raw) THEN (raw::JSON->>'k')::BIGINT END AS k FROM (SELECT event_id, {_CUT} AS raw FROM events))""")
def prep_2(spark, d):
    raw = table(spark, d, "events").select("event_id", F.expr(_CUT).alias("raw"))
    good, bad = prep.quarantine_bad_json(raw, "raw", "k bigint")
    return good.select("event_id", "raw", F.lit(None).cast("string").alias("reason"), F.col("parsed.k").alias("k")).unionByName(
        bad.select("event_id", "raw", "reason", F.lit(None).cast("bigint").alias("k"))
    )


def _norm_sql(c: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), '[ \\t\\v\\f\\x{{00A0}}\\x{{3000}}]+', ' ', 'g'),"
        " ' *\\n *', chr(10), 'g'), '\\n+', chr(10), 'g'), '^\\n|\\n$', '', 'g'))"
    )


@register("prep_3_normalize_text_for_hash", f"SELECT doc_id, sha256({_norm_sql('text')}) AS h FROM documents")
def prep_3(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(prep.normalize_for_hash(F.col("text")), 256).alias("h"))


@register("prep_4_exact_dedup", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_norm_sql('text')}")
def prep_4(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return prep.exact_dedup(docs, "doc_id", prep.normalize_for_hash(F.col("text"))).select("doc_id")


@register("prep_4_exact_dedup_structured", "SELECT min(event_id) AS event_id FROM events GROUP BY user_id, event_type, value")
def prep_4b(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    key = F.to_json(F.struct("user_id", "event_type", "value"))
    return prep.exact_dedup(ev, "event_id", key).select("event_id")


def doc_sigs(spark, d):
    return shared(spark, d, "sigs", lambda: materialise(
        mh.minhash_signatures(docs_tok(spark, d), "doc_id", "toks", SHINGLE), "sigs"))


def _sig_sql(name: str, source: str, key: str, m: int = 128, n: int = SHINGLE) -> str:
    """CTE ``name(key, i, v)``: the minima of every text."""
    a0, a1 = mh.A_RULE
    b0, b1 = mh.B_RULE
    return f"""{name}_sh AS (SELECT DISTINCT {key}, array_to_string(toks[i:i + {n - 1}], ' ') AS s
  FROM (SELECT {key}, toks, unnest(range(1, greatest(len(toks) - {n} + 1, 1) + 1)) AS i FROM (SELECT {key}, {TOK} AS toks FROM {source}) WHERE len(toks) > 0)),
{name}_h AS MATERIALIZED (SELECT {key}, (('0x' || substr(md5(s), 1, 8))::BIGINT % {mh.PRIME}) AS h FROM {name}_sh),
{name} AS MATERIALIZED (SELECT {key}, i, min((h * (1 + ({a0} * (i + {a1})) % {mh.PRIME - 1}) + ({b0} * (i + {b1})) % {mh.PRIME}) % {mh.PRIME})::INTEGER AS v
  FROM {name}_h, (SELECT unnest(range({m}))::BIGINT AS i) GROUP BY ALL)"""


@register("prep_5_minhash_signature", f"WITH {_sig_sql('sg', 'documents', 'doc_id')} SELECT doc_id, string_agg(v::VARCHAR, ',' ORDER BY i) AS sig FROM sg GROUP BY 1")
def prep_5(spark, d):
    sigs = mh.minhash_signatures(docs_tok(spark, d), "doc_id", "toks", SHINGLE)
    return sigs.select("doc_id", F.array_join("sig", ",").alias("sig"))


# any true pair shares a value at one of the first seven places: it may differ in six
_GROUP_SQL = f"""WITH RECURSIVE {_sig_sql('sg', 'documents', 'doc_id')},
arr AS MATERIALIZED (SELECT doc_id, list(v ORDER BY i) AS sig FROM sg GROUP BY 1),
pr AS MATERIALIZED (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM sg a JOIN sg b ON a.i = b.i AND a.v = b.v AND a.i < 7 AND a.doc_id < b.doc_id),
ed AS MATERIALIZED (SELECT x, y FROM pr JOIN arr p ON p.doc_id = x JOIN arr q ON q.doc_id = y
  WHERE len(list_filter(list_zip(p.sig, q.sig), lambda z: z[1] = z[2])) >= 122),
both_e AS MATERIALIZED (SELECT x, y FROM ed UNION SELECT y, x FROM ed),
reach(x, y) AS (SELECT x, y FROM both_e UNION SELECT r.x, e.y FROM reach r JOIN both_e e ON r.y = e.x),
grp AS (SELECT x AS id, min(least(x, y)) AS group_id FROM reach GROUP BY 1),
siz AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS group_size FROM grp)"""


@register("prep_6_near_duplicates", _GROUP_SQL + " SELECT id, group_id, group_size::BIGINT AS group_size FROM siz")
def prep_6(spark, d):
    links = nd.near_duplicate_links(doc_sigs(spark, d), "doc_id")
    return nd.near_duplicate_groups(links)


def doc_groups(spark, d):
    return shared(spark, d, "groups", lambda: materialise(
        nd.near_duplicate_groups(nd.near_duplicate_links(doc_sigs(spark, d), "doc_id")), "groups"))


@register("prep_7_mark_or_downweight", _GROUP_SQL + """ SELECT doc_id, coalesce(group_id, doc_id) AS group_id, coalesce(group_id, doc_id) = doc_id AS keep,
round(1.0 / coalesce(group_size, 1), 6)::DOUBLE AS weight FROM documents LEFT JOIN siz ON id = doc_id""")
def prep_7(spark, d):
    marked = nd.mark_duplicates(table(spark, d, "documents").select("doc_id"), "doc_id", doc_groups(spark, d))
    return marked.withColumn("weight", F.round("weight", 6))


_STEP = "event_type || ':' || (CASE WHEN value < 10 THEN 'low' WHEN value < 100 THEN 'mid' ELSE 'high' END)"


def trajectory_runs(spark, d):
    ev = table(spark, d, "events").select("user_id", "ts", "event_id", F.expr(_STEP).alias("step"))
    return nd.trajectory_shingles(ev, "user_id", ["ts", "event_id"], "step", 4)


_TRJ = f"""st AS (SELECT user_id, {_STEP} AS step, row_number() OVER w AS r, count(*) OVER (PARTITION BY user_id) AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
rn AS (SELECT user_id, r, step, unnest(range(greatest(r - 3, 1), least(r, greatest(t - 3, 1)) + 1)) AS s FROM st),
sh AS (SELECT DISTINCT user_id, shingle FROM (SELECT user_id, s, string_agg(step, ' ' ORDER BY r) AS shingle FROM rn GROUP BY ALL))"""


@register("prep_8_shingle_trajectory", f"WITH {_TRJ} SELECT user_id, shingle FROM sh")
def prep_8(spark, d):
    return trajectory_runs(spark, d)


@register("prep_8_trajectory_signature", f"""WITH {_TRJ}, hh AS (SELECT user_id, ('0x' || substr(md5(shingle), 1, 8))::BIGINT % {mh.PRIME} AS h FROM sh),
sg AS (SELECT user_id, i, min((h * (1 + ({mh.A_RULE[0]} * (i + {mh.A_RULE[1]})) % {mh.PRIME - 1}) + ({mh.B_RULE[0]} * (i + {mh.B_RULE[1]})) % {mh.PRIME}) % {mh.PRIME}) AS v
  FROM hh, (SELECT unnest(range(128))::BIGINT AS i) GROUP BY ALL) SELECT user_id, string_agg(v::VARCHAR, ',' ORDER BY i) AS sig FROM sg GROUP BY 1""")
def prep_8b(spark, d):
    hashed = trajectory_runs(spark, d).select(
        "user_id", (F.conv(F.substring(F.md5("shingle"), 1, 8), 16, 10).cast("bigint") % mh.PRIME).alias("h")
    )
    return mh.minhash_of_rows(hashed, "user_id", "h").select("user_id", F.array_join("sig", ",").alias("sig"))


@register("prep_9_length_profile", f"""WITH {DT} SELECT source, count(*)::BIGINT AS n, round(avg(nt), 6) AS mean, round(quantile_cont(nt, 0.5), 6)::DOUBLE AS p50,
round(quantile_cont(nt, 0.9), 6)::DOUBLE AS p90, round(quantile_cont(nt, 0.99), 6)::DOUBLE AS p99, max(nt)::BIGINT AS longest FROM dt GROUP BY 1""")
def prep_9(spark, d):
    p = prep.length_profile(docs_tok(spark, d), "source", "nt")
    return p.select("source", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p90", "p99")], "longest")


@register("prep_9_length_histogram", f"""WITH {DT} SELECT (CASE WHEN nt < 0 THEN 0 WHEN nt >= 2000 THEN 21 ELSE floor(nt / 100.0) + 1 END)::INTEGER AS bucket, count(*)::BIGINT AS n FROM dt GROUP BY 1""")
def prep_9b(spark, d):
    return prep.length_histogram(docs_tok(spark, d), "nt", 0, 2000, 20)


@register("prep_10_truncate_rule", """WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[\\t\\n\\r ]+'), lambda t: t <> '') AS toks FROM conversations)
SELECT conv_id, turn, array_to_string(CASE WHEN len(toks) <= 40 THEN toks ELSE list_concat(toks[1:10], toks[len(toks) - 29:]) END, ' ') AS kept, len(toks) > 40 AS cut FROM t""")
def prep_10(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", tokens_of(F.col("text")).alias("toks"))
    return t.select(
        "conv_id", "turn", F.array_join(prep.truncate_tokens(F.col("toks"), 40, 10), " ").alias("kept"), (F.size("toks") > 40).alias("cut")
    )


@register("prep_10_truncation_rate", f"WITH {DT} SELECT source, count(*)::BIGINT AS n, count(*) FILTER (nt > 512)::BIGINT AS cut, round(avg((nt > 512)::INTEGER), 6)::DOUBLE AS rate FROM dt GROUP BY 1")
def prep_10b(spark, d):
    return prep.truncation_rate(docs_tok(spark, d), "source", "nt", 512).withColumn("rate", F.round("rate", 6))


@register("prep_11_sample_frame", "SELECT '2' AS data_version, 7::INTEGER AS seed, 25::INTEGER AS wanted, count(*)::BIGINT AS rows, 'by source,least hash' AS rules FROM documents")
def prep_11b(spark, d):
    frame = prep.sample_frame(table(spark, d, "documents"), 25, 7, "2", ["by source", "least hash"])
    return frame.select("data_version", "seed", "wanted", "rows", F.array_join("rules", ",").alias("rules"))


@register("prep_11_diagnostic_sample", f"""SELECT doc_id, source, sample_key FROM (SELECT doc_id, source, {stable_hash_sql('doc_id', 7)} AS sample_key FROM documents)
QUALIFY row_number() OVER (PARTITION BY source ORDER BY sample_key, doc_id) <= 25""")
def prep_11(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return prep.diagnostic_sample(docs, "doc_id", 25, 7, "source").select("doc_id", "source", "sample_key")


_STAT = f"{DT}, ss AS (SELECT source, count(*)::BIGINT AS n, sum(nt)::BIGINT AS tokens, quantile_cont(nt, 0.5)::DOUBLE AS p50 FROM dt GROUP BY 1)"
_MIX = "SELECT source, n, round(weight, 6)::DOUBLE AS weight, round(weight / sum(weight) OVER (), 6)::DOUBLE AS share FROM (SELECT *, {w} AS weight FROM ss)"


def stats(spark, d):
    return mx.source_stats(docs_tok(spark, d), "source", "nt")


def _mix_out(m):
    return m.select("source", "n", F.round("weight", 6).alias("weight"), F.round("share", 6).alias("share"))


@register("prep_12_mix_proportional", f"WITH {_STAT} " + _MIX.format(w="n::DOUBLE"))
def prep_12(spark, d):
    return _mix_out(mx.mix_proportional(stats(spark, d)))


@register("prep_13_mix_temperature", f"WITH {_STAT} " + _MIX.format(w="pow(n, 0.5)"))
def prep_13(spark, d):
    return _mix_out(mx.mix_temperature(stats(spark, d), 0.5))


_LADS = "pow(n, 0.7) * pow(ln(p50 + 1), 0.5)"


@register("prep_14_mix_lads", f"WITH {_STAT} " + _MIX.format(w=_LADS))
def prep_14(spark, d):
    return _mix_out(mx.mix_lads(stats(spark, d)))


BUDGET = 40000
_SAMPLE = f"""{_STAT}, w AS (SELECT *, {_LADS} AS weight FROM ss), sh AS (SELECT source, tokens, weight / sum(weight) OVER () AS share FROM w),
pl AS (SELECT source, floor(share * {BUDGET} / tokens)::BIGINT AS fl, share * {BUDGET} - floor(share * {BUDGET} / tokens) * tokens AS rest FROM sh),
hs AS (SELECT doc_id, source, nt, toks, {stable_hash_sql('doc_id', 11)} AS h FROM dt),
ru AS (SELECT doc_id, source, nt, toks, sum(nt) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS e FROM hs),
smp AS MATERIALIZED (SELECT doc_id, source, nt, toks, fl + CASE WHEN e - nt < rest THEN 1 ELSE 0 END AS copies FROM ru JOIN pl USING (source) WHERE fl + CASE WHEN e - nt < rest THEN 1 ELSE 0 END > 0)"""


def lads_sample(spark, d):
    docs = docs_tok(spark, d)
    shares = mx.mix_lads(mx.source_stats(docs, "source", "nt"))
    return mx.sample_to_token_budget(docs, shares.select("source", "tokens", "share"), "source", "doc_id", "nt", BUDGET, 11)


@register("prep_15_sample_to_token_budget", f"WITH {_SAMPLE} SELECT doc_id, source, copies::BIGINT AS copies FROM smp")
def prep_15(spark, d):
    return lads_sample(spark, d).select("doc_id", "source", "copies")


@register("prep_16_mixture_report", f"""WITH {_SAMPLE}, tk AS (SELECT source, sum(copies)::BIGINT AS samples, sum(copies * nt)::BIGINT AS tokens FROM smp GROUP BY 1),
al AS (SELECT ss.source, ss.tokens AS st, coalesce(tk.samples, 0) AS samples, coalesce(tk.tokens, 0) AS tokens FROM ss LEFT JOIN tk USING (source))
SELECT source, samples::BIGINT AS samples, tokens::BIGINT AS tokens, round(samples / sum(samples) OVER (), 6)::DOUBLE AS sample_share,
round(tokens / sum(tokens) OVER (), 6)::DOUBLE AS token_share, round(tokens / st, 6)::DOUBLE AS compression_ratio FROM al""")
def prep_16(spark, d):
    r = mx.mixture_report(lads_sample(spark, d), docs_tok(spark, d), "source", "nt")
    return r.select("source", "samples", "tokens", *[F.round(c, 6).alias(c) for c in ("sample_share", "token_share", "compression_ratio")])


@register("prep_16_token_type_coverage", f"""WITH {_SAMPLE}, k AS (SELECT DISTINCT unnest(toks) AS w FROM smp), a AS (SELECT DISTINCT unnest(toks) AS w FROM dt)
SELECT count(*)::BIGINT AS types, count(k.w)::BIGINT AS covered, round(count(k.w) / count(*), 6)::DOUBLE AS coverage FROM a LEFT JOIN k USING (w)""")
def prep_16b(spark, d):
    c = mx.token_type_coverage(lads_sample(spark, d), docs_tok(spark, d), "toks")
    return c.withColumn("coverage", F.round("coverage", 6))


@register("prep_16_effective_tokens", f"""{_GROUP_SQL}, {DT} SELECT sum(nt)::BIGINT AS tokens, sum(CASE WHEN ok THEN nt ELSE 0 END)::BIGINT AS effective,
round(sum(CASE WHEN ok THEN nt ELSE 0 END) / sum(nt), 6)::DOUBLE AS ratio FROM (SELECT nt, nt >= 5 AND coalesce(group_id, doc_id) = doc_id AS ok FROM dt LEFT JOIN siz ON id = doc_id)""")
def prep_16c(spark, d):
    marked = nd.mark_duplicates(docs_tok(spark, d).select("doc_id", "nt"), "doc_id", doc_groups(spark, d))
    r = mx.effective_token_ratio(marked, F.col("nt") >= 5, F.col("keep"), "nt")
    return r.withColumn("ratio", F.round("ratio", 6))


@register("prep_17_length_buckets", f"WITH {DT} SELECT doc_id, (CASE WHEN nt >= 1024 THEN 3 WHEN nt >= 256 THEN 2 WHEN nt >= 64 THEN 1 ELSE 0 END)::INTEGER AS bucket FROM dt")
def prep_17(spark, d):
    return prep.length_buckets(docs_tok(spark, d), "nt", [64, 256, 1024]).select("doc_id", "bucket")


@register("prep_17_length_ntiles", f"WITH {DT} SELECT doc_id, (ntile(16) OVER (ORDER BY nt, doc_id))::INTEGER AS bucket FROM dt")
def prep_17b(spark, d):
    return prep.length_ntiles(docs_tok(spark, d).select("doc_id", "nt"), "nt", "doc_id", 16).select("doc_id", "bucket")


@register("prep_18_dataset_profile", f"""WITH {DT} SELECT source, count(*)::BIGINT AS rows, sum(length(text))::BIGINT AS chars, sum(nt)::BIGINT AS tokens, round(avg(nt), 6) AS mean_tokens,
count(*) FILTER (nt = 0)::BIGINT AS empty FROM dt GROUP BY 1""")
def prep_18(spark, d):
    p = prep.dataset_profile(table(spark, d, "documents"), "source", "text")
    return p.withColumn("mean_tokens", F.round("mean_tokens", 6))


_SH = "SELECT DISTINCT {k} AS id, array_to_string(toks[i:i + 4], ' ') AS shingle FROM (SELECT {k}, toks, unnest(range(1, greatest(len(toks) - 4, 1) + 1)) AS i FROM (SELECT {k}, " + TOK + " AS toks FROM {t}) WHERE len(toks) > 0)"


@register("prep_19_decontaminate", f"""WITH a AS ({_SH.format(k='doc_id', t='documents')}), b AS ({_SH.format(k='item_id', t='benchmark')}),
sz AS (SELECT id, count(*) AS n FROM b GROUP BY 1),
hit AS (SELECT a.id FROM a JOIN b USING (shingle) JOIN sz ON sz.id = b.id GROUP BY a.id, b.id, n HAVING count(*) >= n * 0.5)
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT id FROM hit)""")
def prep_19(spark, d):
    def shingles(name, key):
        t = table(spark, d, name).select(F.col(key).alias("id"), tokens_of(F.col("text")).alias("t"))
        return t.select("id", F.explode(mh.word_shingles(F.col("t"), SHINGLE)).alias("shingle"))

    hits = nd.shared_shingles(shingles("documents", "doc_id"), shingles("benchmark", "item_id"), 0.5)
    return nd.decontaminate(table(spark, d, "documents").select("doc_id"), "doc_id", hits)


@register("prep_19_contaminated_signatures", f"""WITH {_sig_sql('sg', 'documents', 'doc_id')},
arr AS MATERIALIZED (SELECT doc_id, list(v ORDER BY i) AS sig FROM sg GROUP BY 1),
pr AS MATERIALIZED (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM sg a JOIN sg b ON a.i = b.i AND a.v = b.v AND a.i < 7 WHERE b.doc_id IN (SELECT doc_id FROM labels))
SELECT DISTINCT x AS doc_id FROM pr JOIN arr p ON p.doc_id = x JOIN arr q ON q.doc_id = y WHERE len(list_filter(list_zip(p.sig, q.sig), lambda z: z[1] = z[2])) >= 122""")
def prep_19b(spark, d):
    """Documents whose signature agrees with that of a labelled one, itself included."""
    sigs = doc_sigs(spark, d).select(F.col("doc_id").alias("id"), "sig")
    labelled = sigs.join(table(spark, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return nd.contaminated(sigs, labelled).select(F.col("train_id").alias("doc_id"))


@register("prep_20_reusable_stats", f"WITH {DT} SELECT doc_id, nt FROM dt")
def prep_20(spark, d):
    """Statistics stored in two runs; the second only computes what is missing."""
    docs = docs_tok(spark, d).select("doc_id", "nt")
    done = materialise(docs.filter("doc_id % 3 = 0"), "stats")
    more = materialise(prep.pending_ids(docs, done, "doc_id"), "stats")
    return done.unionByName(more)


_PACK = f"""WITH {DT}, st AS (SELECT source, doc_id, unnest(toks) AS w, generate_subscripts(toks, 1) AS i FROM dt),
nb AS (SELECT source, w, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS pos, count(*) OVER (PARTITION BY source) AS ln FROM st),
sp AS (SELECT source, pos // 512 AS block, pos % 512 AS k, w, ln FROM nb UNION ALL SELECT source, pos // 512 - 1, 512, w, ln FROM nb WHERE pos % 512 = 0 AND pos > 0),
bl AS (SELECT source, block, ln, list(w ORDER BY k) AS ws FROM sp GROUP BY ALL HAVING count(*) = 513)
SELECT source, block::BIGINT AS block, (block % 4)::INTEGER AS rank, array_to_string(ws[1:512], ' ') AS x, array_to_string(ws[2:513], ' ') AS y FROM bl WHERE block < 4 OR (block + 4) * 512 + 1 <= ln"""


@register("prep_21_pack_tokens", _PACK)
def prep_21(spark, d):
    packed = prep.pack_tokens(docs_tok(spark, d).select("source", "doc_id", "toks"), "source", "doc_id", "toks", 4, 128, 4)
    return packed.select("source", "block", "rank", F.array_join("x", " ").alias("x"), F.array_join("y", " ").alias("y"))


_CH = "c AS (SELECT conv_id, turn, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM conversations)"


@register("prep_22_char_labels_before", f"""WITH {_CH}, l AS (SELECT conv_id, turn, i, least(2, row_number() OVER (PARTITION BY conv_id, turn, ch ORDER BY i) - 1) AS d FROM c)
SELECT conv_id, turn, string_agg(d::VARCHAR, '' ORDER BY i) AS labels FROM l GROUP BY ALL""")
def prep_22(spark, d):
    return prep.char_occurrence_labels(table(spark, d, "conversations"), ["conv_id", "turn"], "text")


@register("prep_22_char_labels_both", f"""WITH {_CH}, l AS (SELECT conv_id, turn, i, least(2, count(*) OVER (PARTITION BY conv_id, turn, ch) - 1) AS d FROM c)
SELECT conv_id, turn, string_agg(d::VARCHAR, '' ORDER BY i) AS labels FROM l GROUP BY ALL""")
def prep_22b(spark, d):
    return prep.char_occurrence_labels(table(spark, d, "conversations"), ["conv_id", "turn"], "text", before_only=False)


@register("prep_23_build_index", f"""WITH {DT}, w AS (SELECT unnest(toks) AS word, (doc_id, generate_subscripts(toks, 1)) AS o FROM dt), f AS (SELECT word, min(o) AS o FROM w GROUP BY 1)
SELECT word, (row_number() OVER (ORDER BY o) - 1)::BIGINT AS id FROM f""")
def prep_23(spark, d):
    w = docs_tok(spark, d).select("doc_id", F.posexplode("toks").alias("i", "word"))
    return prep.build_index(w.select("word", F.struct("doc_id", "i").alias("o")), "word", "o")


@register("prep_23_look_up", f"""WITH {DT}, w AS (SELECT unnest(toks) AS word, (doc_id, generate_subscripts(toks, 1)) AS o FROM dt), f AS (SELECT word, min(o) AS o FROM w GROUP BY 1),
ix AS (SELECT word, (row_number() OVER (ORDER BY o) - 1)::BIGINT AS id FROM f), q AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[\\t\\n\\r ]+')) AS word FROM conversations)
SELECT word, coalesce(id, -1)::BIGINT AS id FROM q LEFT JOIN ix USING (word) WHERE word <> ''""")
def prep_23b(spark, d):
    q = table(spark, d, "conversations").select(F.explode(tokens_of(F.col("text"))).alias("word")).distinct()
    return prep.look_up(q, prep_23(spark, d), "word")


@register("prep_24_beam_topk", """SELECT l_returnflag, l_partkey, score FROM (SELECT l_returnflag, l_partkey, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY score DESC, l_partkey) <= 10""")
def prep_24(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_partkey", F.col("l_extendedprice").alias("score"))
    return prep.beam_topk(li, ["l_returnflag"], "l_partkey", "score", 10)
