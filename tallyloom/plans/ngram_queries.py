"""N-gram queries over documents, conversations and benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tokens import SPECIALS, last_word
from ..operators import ngram_filter as nf
from ..operators import ngram_mix as mix
from ..operators import ngram_model as nm
from ..operators import ngram_score as ns
from ..session import materialise, scratch
from ..sources import arpa, corpus
from ..sources.corpus import sentences
from .registry import register, shared, table

ORDER = 3
FALLBACK = nm.FALLBACK_DISCOUNTS

# ------------------------------------------------------------------ SQL texts


def sent_sql(name: str, source: str, id_col: str, extra: str = "") -> str:
    key = f"{id_col}{', ' + extra if extra else ''}"
    return f"""{name} AS (
  SELECT {key}, line_no, list_filter(regexp_split_to_array(line, '[\\t\\n\\r ]+'),
         lambda t: t <> '' AND t NOT IN ('<s>', '</s>', '<unk>')) AS tokens
  FROM (SELECT {key}, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS line_no
        FROM (SELECT {key}, string_split(text, chr(10)) AS parts FROM {source})))"""


def _list(items: list[str]) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


def counts_sql(p: str, sent: str, n: int) -> str:
    """Adjusted counts of all orders as CTEs prefixed by p."""
    bos = _list(["<s>"] * (n - 1)) if n > 1 else "[]"
    out = [f"""{p}top AS MATERIALIZED (
  SELECT words, count(*) AS raw FROM (
    SELECT array_to_string(list_slice(pd, i, i + {n - 1}), ' ') AS words
    FROM (SELECT pd, unnest(range(1, len(pd) - {n} + 2)) AS i
          FROM (SELECT list_concat(list_concat({bos}::VARCHAR[], tokens), ['</s>']) AS pd FROM {sent}))) GROUP BY 1)""",
           f"{p}l{n} AS (SELECT words, raw, raw AS adj FROM {p}top)"]
    for k in range(n - 1, 0, -1):
        out.append(f"""{p}l{k} AS MATERIALIZED (
  SELECT words, raw, CASE WHEN words LIKE '<s> %' OR words = '<s>' THEN raw ELSE lefts END AS adj
  FROM (SELECT substr(words, instr(words, ' ') + 1) AS words, sum(raw) AS raw, count(*) AS lefts
        FROM {p}l{k + 1} GROUP BY 1))""")
    parts = [f"SELECT {k} AS ord, words, raw, adj FROM {p}l{k} WHERE words NOT LIKE '<s> <s>%'" for k in range(n, 1, -1)]
    parts.append(f"SELECT 1 AS ord, words, raw, adj FROM {p}l1 WHERE words NOT IN ('<s>', '<unk>')")
    parts.append("SELECT 1, unnest(['<unk>', '<s>']), 0, 0")
    out.append(f"{p}adj AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")")
    return ",\n".join(out)


NO_PRUNE = "false"
CTX = "rtrim(substr(words, 1, length(words) - length(string_split(words, ' ')[-1])))"
SUFFIX = "substr(words, instr(words, ' ') + 1)"


def smooth_sql(p: str, n: int, pruned: str = NO_PRUNE) -> str:
    """Counts CTEs to model CTEs: {p}lm(ord, words, prob, backoff)."""
    f1, f2, f3 = FALLBACK
    out = [f"""{p}pr AS MATERIALIZED (SELECT ord, words, raw, adj, ({pruned}) AS pruned, CASE WHEN ord = 1 THEN '' ELSE {CTX} END AS ctx FROM {p}adj)""",
           f"""{p}coc AS (SELECT ord, count(*) FILTER (adj = 1) AS n1, count(*) FILTER (adj = 2) AS n2,
  count(*) FILTER (adj = 3) AS n3, count(*) FILTER (adj = 4) AS n4, count(*) AS total, count(*) FILTER (NOT pruned) AS kept FROM {p}pr GROUP BY 1)""",
           f"""{p}d0 AS (SELECT *, n1::DOUBLE / (n1 + 2 * n2) AS y FROM {p}coc)""",
           f"""{p}d1 AS (SELECT ord, 1 - 2 * y * n2 / nullif(n1, 0) AS d1, 2 - 3 * y * n3 / nullif(n2, 0) AS d2, 3 - 4 * y * n4 / nullif(n3, 0) AS d3 FROM {p}d0)""",
           f"""{p}disc AS (SELECT ord, CASE WHEN good THEN d1 ELSE {f1} END AS d1, CASE WHEN good THEN d2 ELSE {f2} END AS d2,
  CASE WHEN good THEN d3 ELSE {f3} END AS d3
  FROM (SELECT *, coalesce(d1 BETWEEN 0 AND 1 AND d2 BETWEEN 0 AND 2 AND d3 BETWEEN 0 AND 3, false) AS good FROM {p}d1))""",
           f"""{p}rows AS MATERIALIZED (SELECT ord, words, ctx, adj, pruned, CASE WHEN pruned OR adj = 0 THEN 0.0::DOUBLE WHEN adj = 1 THEN d1 WHEN adj = 2 THEN d2 ELSE d3 END AS dd
  FROM {p}pr JOIN {p}disc USING (ord))""",
           f"""{p}ctx AS MATERIALIZED (SELECT ord, ctx, sum(adj) AS den, sum(CASE WHEN pruned THEN adj::DOUBLE ELSE dd END) / sum(adj) AS gamma FROM {p}rows GROUP BY ALL)""",
           f"""{p}u AS MATERIALIZED (SELECT r.ord, words, r.ctx,
  CASE WHEN r.ord = 1 AND words = '<s>' THEN 1.0::DOUBLE WHEN r.ord = 1 AND words = '<unk>' THEN 0.0::DOUBLE ELSE (adj - dd) / den END AS u,
  CASE WHEN r.ord = 1 AND words = '<s>' THEN 0.0::DOUBLE ELSE gamma END AS gamma
  FROM {p}rows r JOIN {p}ctx c ON r.ord = c.ord AND r.ctx = c.ctx WHERE NOT pruned)""",
           f"""{p}p1 AS MATERIALIZED (SELECT words, u + gamma / (SELECT count(*) - 1 FROM {p}u WHERE ord = 1) AS p FROM {p}u WHERE ord = 1)"""]
    for k in range(2, n + 1):
        out.append(f"""{p}p{k} AS MATERIALIZED (SELECT a.words, a.u + a.gamma * b.p AS p FROM (SELECT words, u, gamma, {SUFFIX} AS sfx FROM {p}u WHERE ord = {k}) a
  JOIN {p}p{k - 1} b ON a.sfx = b.words)""")
    parts = []
    for k in range(1, n + 1):
        if k < n:
            parts.append(f"""SELECT {k} AS ord, a.words, least(log10(p), 0) AS prob,
  CASE WHEN string_split(a.words, ' ')[-1] IN ('<unk>', '</s>') THEN 0.0::DOUBLE ELSE log10(coalesce(c.gamma, 1.0)) END AS backoff
  FROM {p}p{k} a LEFT JOIN {p}ctx c ON c.ord = {k + 1} AND c.ctx = a.words""")
        else:
            parts.append(f"SELECT {k} AS ord, words, least(log10(p), 0) AS prob, 0.0::DOUBLE AS backoff FROM {p}p{k}")
    out.append(f"{p}lm AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")")
    return ",\n".join(out)


def score_sql(p: str, windows: str, n: int, lm: str) -> str:
    """Score the distinct windows of CTE ``windows(words)``: {p}sc(words, prob, len, oov)."""
    out = [f"{p}w{n} AS (SELECT DISTINCT words FROM {windows} WHERE len(string_split(words, ' ')) = {n})"]
    for k in range(n - 1, 0, -1):
        out.append(f"""{p}w{k} AS (SELECT words FROM {windows} WHERE len(string_split(words, ' ')) = {k}
  UNION SELECT {SUFFIX} FROM {p}w{k + 1})""")
    out.append(f"""{p}s1 AS MATERIALIZED (SELECT w.words, coalesce(m.prob, (SELECT prob FROM {lm} WHERE ord = 1 AND words = '<unk>')) AS prob, 1 AS len,
  (m.prob IS NULL OR w.words = '<unk>') AS oov FROM {p}w1 w LEFT JOIN {lm} m ON m.ord = 1 AND m.words = w.words)""")
    for k in range(2, n + 1):
        out.append(f"""{p}s{k} AS MATERIALIZED (SELECT w.words, coalesce(m.prob, s.prob + coalesce(c.backoff, 0)) AS prob,
  CASE WHEN m.prob IS NOT NULL THEN {k} ELSE s.len END AS len, s.oov
  FROM (SELECT words, {SUFFIX} AS sfx, {CTX} AS ctx FROM {p}w{k}) w JOIN {p}s{k - 1} s ON s.words = w.sfx
  LEFT JOIN {lm} m ON m.ord = {k} AND m.words = w.words LEFT JOIN {lm} c ON c.ord = {k - 1} AND c.words = w.ctx)""")
    out.append(f"{p}sc AS (" + " UNION ALL ".join(f"SELECT * FROM {p}s{k}" for k in range(1, n + 1)) + ")")
    return ",\n".join(out)


def windows_sql(name: str, sent: str, keys: str, n: int) -> str:
    return f"""{name} AS MATERIALIZED (SELECT {keys}, i - 2 AS pos, array_to_string(list_slice(pd, greatest(1, i - {n - 1}), i), ' ') AS words, pd[i] AS word
  FROM (SELECT {keys}, pd, unnest(range(2, len(pd) + 1)) AS i FROM (SELECT {keys}, list_concat(list_concat(['<s>'], tokens), ['</s>']) AS pd FROM {sent})))"""


DOC = sent_sql("ds", "documents", "doc_id")
CONV = sent_sql("cs", "conversations", "conv_id", "turn")
BENCH = sent_sql("bs", "benchmark", "item_id")
COUNTS = counts_sql("", "ds", ORDER)
MODEL = COUNTS + ",\n" + smooth_sql("", ORDER)
CMODEL = counts_sql("c", "cs", ORDER) + ",\n" + smooth_sql("c", ORDER)
D6 = lambda c: f"round({c}, 6) AS {c}"

# ------------------------------------------------------------- shared inputs


def docs(spark, d):
    return sentences(table(spark, d, "documents"))


def convs(spark, d):
    rows = table(spark, d, "conversations").withColumn("__id", F.struct("conv_id", "turn"))
    return sentences(rows, "__id").select("__id.conv_id", "__id.turn", "line_no", "tokens")


def bench_lines(spark, d):
    return sentences(table(spark, d, "benchmark"), "item_id")


def doc_counts(spark, d):
    return shared(spark, d, "counts", lambda: nm.adjusted_counts(nm.ngram_counts(docs(spark, d), ORDER), ORDER))


def doc_discounts(spark, d):
    return shared(spark, d, "discounts", lambda: materialise(nm.kn_discounts(nm.count_of_counts(doc_counts(spark, d)), FALLBACK), "discounts"))


def doc_contexts(spark, d):
    return shared(spark, d, "contexts", lambda: nm.write_contexts(doc_counts(spark, d), doc_discounts(spark, d)))


def doc_lm(spark, d):
    """The model, with the tables of its steps beside it, which other queries share."""
    def build():
        counts, discounts, contexts = doc_counts(spark, d), doc_discounts(spark, d), doc_contexts(spark, d)
        return nm.interpolate_orders(nm.uninterpolated_part(counts, discounts, contexts), contexts, ORDER)

    return shared(spark, d, "lm", build)


def doc_model(spark, d):
    """The model alone, for queries that read nothing else of it: the tables of its steps are removed."""
    return shared(spark, d, "model", lambda: nm.train(docs(spark, d), ORDER, FALLBACK))


def conv_lm(spark, d):
    return shared(spark, d, "clm", lambda: nm.train(convs(spark, d), ORDER, FALLBACK))


def bench_vocab(spark, d):
    return bench_lines(spark, d).select(F.explode("tokens").alias("word")).distinct()


def bench_sent_vocab(spark, d):
    return bench_lines(spark, d).select(F.col("item_id").alias("sent_id"), F.explode("tokens").alias("word")).distinct()


def gram_table(spark, d):
    return doc_counts(spark, d).filter(F.col("order") == ORDER).select("words", "raw")


BV = "bv AS (SELECT DISTINCT unnest(tokens) AS word FROM bs)"
BSV = "bsv AS (SELECT DISTINCT item_id AS sent_id, unnest(tokens) AS word FROM bs)"
I = "::BIGINT"

# -------------------------------------------------------------------- queries


@register("src_1_read_corpus", f"WITH {DOC} SELECT doc_id, line_no::INTEGER AS line_no, len(tokens)::INTEGER AS n_tokens, array_to_string(tokens, ' ') AS line FROM ds")
def src_1(spark, d):
    return docs(spark, d).select("doc_id", "line_no", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("line"))


@register("src_1_read_corpus_files", f"WITH {DOC} SELECT array_to_string(tokens, ' ') AS line, count(*)::BIGINT AS n FROM ds GROUP BY 1")
def src_1b(spark, d):
    """The lines as files, plain and gz, read back."""
    path = arpa.scratch_path(spark, "corpus")
    t = table(spark, d, "documents")
    lines = t.select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    for odd, codec in ((0, "none"), (1, "gzip")):
        lines.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == odd).select("value").write.mode("append").option("compression", codec).text(path)
    return corpus.read_corpus(spark, path).groupBy(F.array_join("tokens", " ").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@register("src_2_read_arpa", f"WITH {DOC}, {MODEL} SELECT ord::INTEGER AS ord, words, {D6('prob')}, {D6('backoff')} FROM lm")
def src_2(spark, d):
    lm = arpa.read_arpa(spark, _arpa_file(spark, d))
    return _lm_out(lm, 6)


def _arpa_file(spark, d):
    def build():
        path = arpa.scratch_path(spark, "model.arpa")
        with scratch(spark):  # shared tables of the steps would stay on disk beside the model and its file
            arpa.write_arpa(nm.train(docs(spark, d), ORDER, FALLBACK), path, ORDER, "gzip")
        return path

    return shared(spark, d, "arpa", build)


def _lm_out(lm, digits=6):
    return lm.select(
        F.col("order").alias("ord"), "words", F.round("prob", digits).alias("prob"), F.round("backoff", digits).alias("backoff")
    )


@register("src_3_write_arpa", f"""WITH {DOC}, {MODEL}, sized AS (SELECT ord, count(*) AS n FROM lm GROUP BY 1)
SELECT kind, n::BIGINT AS n FROM (
  SELECT 'entry ' || ord AS kind, n FROM sized UNION ALL SELECT 'ngram ' || ord || '=' || n, 1 FROM sized
  UNION ALL SELECT 'section ' || ord, 1 FROM sized UNION ALL SELECT unnest(['data', 'end']), 1)""")
def src_3(spark, d):
    lines = spark.read.text(_arpa_file(spark, d)).select("value").filter("value <> ''")
    tabs = F.size(F.split("value", "\t"))
    section = F.regexp_extract("value", r"^\\(\d+)-grams:$", 1)
    kind = (
        F.when(tabs > 1, F.concat(F.lit("entry "), F.size(F.split(F.split("value", "\t")[1], " "))))
        .when(F.col("value") == "\\data\\", "data")
        .when(F.col("value") == "\\end\\", "end")
        .when(section != "", F.concat(F.lit("section "), section))
        .otherwise(F.col("value"))
    )
    return lines.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@register("src_4_counts_text", f"WITH {DOC}, {COUNTS} SELECT words, raw::BIGINT AS raw FROM top")
def src_4(spark, d):
    path = arpa.scratch_path(spark, "counts")
    arpa.write_counts(nm.ngram_counts(docs(spark, d), ORDER), path)
    return arpa.read_counts(spark, path).select("words", F.col("rest").cast("bigint").alias("raw"))


@register("lm_1_ngram_counts", f"WITH {DOC}, {COUNTS} SELECT words, raw::BIGINT AS raw FROM top")
def lm_1(spark, d):
    return nm.ngram_counts(docs(spark, d), ORDER)


@register("lm_1_corpus_totals", f"""WITH {DOC}, w AS (SELECT unnest(tokens) AS word FROM ds)
SELECT count(*)::BIGINT AS tokens, (count(DISTINCT word) + 3)::BIGINT AS types FROM w""")
def lm_1b(spark, d):
    return nm.corpus_totals(docs(spark, d))


@register("lm_2_count_ngrams", f"""WITH {CONV}, {BENCH}, {BV},
seen AS (SELECT conv_id, turn, line_no, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS i FROM cs),
mapped AS (SELECT conv_id, turn, line_no, list(coalesce(word, '<unk>') ORDER BY i) AS tokens FROM seen LEFT JOIN bv ON tok = word GROUP BY ALL),
full_s AS (SELECT cs.conv_id, cs.turn, cs.line_no, coalesce(m.tokens, []) AS tokens FROM cs LEFT JOIN mapped m USING (conv_id, turn, line_no)),
{counts_sql('', 'full_s', 2)} SELECT words, raw::BIGINT AS raw FROM top""")
def lm_2(spark, d):
    return nm.count_ngrams(convs(spark, d), 2, bench_vocab(spark, d), ["conv_id", "turn", "line_no"])


@register("lm_3_adjusted_counts", f"WITH {DOC}, {COUNTS} SELECT ord::INTEGER AS ord, words, raw::BIGINT AS raw, adj::BIGINT AS adj FROM adj")
def lm_3(spark, d):
    counts = nm.adjusted_counts(nm.ngram_counts(docs(spark, d), ORDER), ORDER)
    return counts.select(F.col("order").alias("ord"), "words", "raw", "adj")


@register("lm_4_count_of_counts", f"""WITH {DOC}, {MODEL} SELECT ord::INTEGER AS ord, n1::BIGINT AS n1, n2::BIGINT AS n2, n3::BIGINT AS n3,
n4::BIGINT AS n4, total::BIGINT AS total, kept::BIGINT AS kept FROM coc""")
def lm_4(spark, d):
    return nm.count_of_counts(doc_counts(spark, d)).withColumnRenamed("order", "ord")


@register("lm_5_kn_discounts", f"WITH {DOC}, {MODEL} SELECT ord::INTEGER AS ord, {D6('d1')}, {D6('d2')}, {D6('d3')} FROM disc")
def lm_5(spark, d):
    return doc_discounts(spark, d).select(F.col("order").alias("ord"), *[F.round(f"d{j}", 6).alias(f"d{j}") for j in (1, 2, 3)])


PRUNED = "(CASE ord WHEN 1 THEN raw <= 0 WHEN 2 THEN raw <= 1 ELSE raw <= 2 END) AND NOT (ord = 1 AND words IN ('<s>', '</s>', '<unk>'))"


@register("lm_6_prune", f"WITH {DOC}, {COUNTS}, {smooth_sql('', ORDER, PRUNED)} SELECT ord::INTEGER AS ord, words, {D6('prob')}, {D6('backoff')} FROM lm")
def lm_6(spark, d):
    return _lm_out(nm.smooth(nm.prune(doc_counts(spark, d), [0, 1, 2]), ORDER, FALLBACK))


@register("lm_7_limit_vocab", f"""WITH {DOC}, {COUNTS}, {BENCH}, {BV},
kv AS MATERIALIZED (SELECT word FROM bv UNION SELECT unnest(['', '<s>', '</s>', '<unk>']))
SELECT ord::INTEGER AS ord, words, (a.word IS NULL OR b.word IS NULL OR c.word IS NULL) AS pruned FROM adj
LEFT JOIN kv a ON a.word = split_part(words, ' ', 1) LEFT JOIN kv b ON b.word = split_part(words, ' ', 2) LEFT JOIN kv c ON c.word = split_part(words, ' ', 3)""")
def lm_7(spark, d):
    limited = nm.limit_vocabulary(doc_counts(spark, d), bench_vocab(spark, d))
    return limited.select(F.col("order").alias("ord"), "words", "pruned")


@register("lm_8_context_stats", f"WITH {DOC}, {MODEL} SELECT ord::INTEGER AS ord, ctx, den::BIGINT AS den, {D6('gamma')} FROM ctx")
def lm_8(spark, d):
    stats = nm.context_stats(doc_counts(spark, d), doc_discounts(spark, d))
    return stats.select(F.col("order").alias("ord"), F.col("context").alias("ctx"), F.col("denominator").alias("den"), F.round("gamma", 6).alias("gamma"))


@register("lm_9_uninterpolated", f"WITH {DOC}, {MODEL} SELECT ord::INTEGER AS ord, words, {D6('u')}, {D6('gamma')} FROM u")
def lm_9(spark, d):
    u = nm.write_uninterpolated(doc_counts(spark, d), doc_discounts(spark, d), doc_contexts(spark, d))
    return u.select(F.col("order").alias("ord"), "words", F.round("u", 6).alias("u"), F.round("gamma", 6).alias("gamma"))


@register("lm_10_interpolate_orders", f"WITH {DOC}, {MODEL} SELECT ord::INTEGER AS ord, words, {D6('prob')}, {D6('backoff')} FROM lm")
def lm_10(spark, d):
    return _lm_out(doc_lm(spark, d))


def _q_sql(n: int) -> str:
    out = ["q1 AS (SELECT words, prob, backoff AS s FROM lm WHERE ord = 1)"]
    for k in range(2, n + 1):
        out.append(f"""q{k} AS (SELECT a.words, a.prob, coalesce(b.s, 0) - coalesce(c.backoff, 0) + a.backoff AS s
  FROM (SELECT words, prob, backoff, {SUFFIX} AS sfx, {CTX} AS ctx FROM lm WHERE ord = {k}) a LEFT JOIN q{k - 1} b ON a.sfx = b.words
  LEFT JOIN lm c ON c.ord = {k - 1} AND c.words = a.ctx)""")
    union = " UNION ALL ".join(f"SELECT {k}::INTEGER AS ord, words, round(prob + s, 6) AS q FROM q{k}" for k in range(1, n + 1))
    return ",\n".join(out) + "\n" + union


@register("lm_11_collapse_q", f"WITH {DOC}, {MODEL}, {_q_sql(ORDER)}")
def lm_11(spark, d):
    return nm.collapse_q(doc_model(spark, d), ORDER).select(F.col("order").alias("ord"), "words", F.round("q", 6).alias("q"))


SCORED_CONV = f"""{DOC}, {MODEL}, {CONV}, {windows_sql('cw', 'cs', 'conv_id, turn, line_no', ORDER)}, {score_sql('', 'cw', ORDER, 'lm')},
tok AS (SELECT cw.*, sc.prob, sc.len, sc.oov FROM cw JOIN sc USING (words))"""


@register("lm_12_score_tokens", f"""WITH {SCORED_CONV} SELECT conv_id, turn, line_no::INTEGER AS line_no, pos::INTEGER AS pos, word,
{D6('prob')}, len::INTEGER AS ngram_length, oov FROM tok""")
def lm_12(spark, d):
    toks = ns.score_tokens(convs(spark, d), doc_model(spark, d), ORDER, ["conv_id", "turn", "line_no"])
    return toks.withColumn("prob", F.round("prob", 6))


@register("lm_13_score_sentences", f"""WITH {SCORED_CONV} SELECT conv_id, turn, line_no::INTEGER AS line_no, round(sum(prob), 6) AS score,
count(*) FILTER (oov)::BIGINT AS oovs, count(*)::BIGINT AS tokens, round(pow(10, -sum(prob) / count(*)), 4) AS perplexity FROM tok GROUP BY ALL""")
def lm_13(spark, d):
    keys = ["conv_id", "turn", "line_no"]
    s = ns.score_sentences(ns.score_tokens(convs(spark, d), doc_model(spark, d), ORDER, keys), keys)
    return s.withColumn("score", F.round("score", 6)).withColumn("perplexity", F.round("perplexity", 4))


@register("lm_14_corpus_perplexity", f"""WITH {SCORED_CONV} SELECT round(sum(prob), 4) AS total, count(*)::BIGINT AS tokens, count(*) FILTER (oov)::BIGINT AS oovs,
round(pow(10, -sum(prob) / count(*)), 4) AS ppl_with_oov,
round(pow(10, -(sum(prob) - coalesce(sum(prob) FILTER (oov), 0)) / (count(*) - count(*) FILTER (oov))), 4) AS ppl_without_oov FROM tok""")
def lm_14(spark, d):
    r = ns.corpus_perplexity(convs(spark, d), doc_model(spark, d), ORDER)
    return r.select(
        F.round("total", 4).alias("total"), F.col("tokens").cast("bigint").alias("tokens"), F.col("oovs").cast("bigint").alias("oovs"),
        F.round("ppl_with_oov", 4).alias("ppl_with_oov"), F.round("ppl_without_oov", 4).alias("ppl_without_oov"),
    )


GRAMS = "g AS (SELECT words, raw FROM adj WHERE ord = 3)"


def _plain(text: str = "words") -> str:
    return f"list_distinct(list_filter(string_split({text}, ' '), lambda w: w <> '' AND NOT (starts_with(w, '<') AND ends_with(w, '>'))))"


TAG = "(starts_with({w}, '<') AND ends_with({w}, '>'))"
_PART = [f"split_part(words, ' ', {i})" for i in (1, 2, 3)]


def _known_sql(vocab: str, source: str = "g", text: str = "words") -> str:
    """``gk``: the trigrams whose words are all tags or in the vocabulary; others can meet no sentence."""
    parts = [p.replace("(words,", f"({text},") for p in _PART]
    joins = "".join(f" LEFT JOIN kv k{i} ON k{i}.word = {p}" for i, p in enumerate(parts))
    return f"""kv AS MATERIALIZED (SELECT DISTINCT word FROM {vocab}),
gk AS MATERIALIZED (SELECT g.* FROM {source} g{joins} WHERE {" AND ".join(f"(k{i}.word IS NOT NULL OR {p} = '' OR {TAG.format(w=p)})" for i, p in enumerate(parts))})"""


def _set_sql(text: str) -> str:
    return f"""{_known_sql("bsv", text=text)},
gw AS (SELECT words, {_plain(text)} AS ws FROM gk),
ge AS (SELECT words, len(ws) AS n, unnest(ws) AS word FROM gw WHERE len(ws) > 0),
hit AS (SELECT words, sent_id FROM ge JOIN bsv USING (word) GROUP BY words, sent_id, n HAVING count(*) = n),
free AS (SELECT words FROM gw WHERE len(ws) = 0)"""


@register("lm_15_filter_single", f"""WITH {DOC}, {COUNTS}, {BENCH}, {BV}, {GRAMS},
{_known_sql("bv")}
SELECT words, raw::BIGINT AS raw FROM gk""")
def lm_15(spark, d):
    return nf.filter_single(gram_table(spark, d), bench_vocab(spark, d))


@register("lm_16_filter_union", f"""WITH {DOC}, {COUNTS}, {BENCH}, {BSV}, {GRAMS}, {_set_sql('words')}
SELECT words, raw::BIGINT AS raw FROM g WHERE words IN (SELECT words FROM hit UNION SELECT words FROM free)""")
def lm_16(spark, d):
    return nf.filter_union(gram_table(spark, d), bench_sent_vocab(spark, d))


@register("lm_17_filter_multiple", f"""WITH {DOC}, {COUNTS}, {BENCH}, {BSV}, {GRAMS}, {_set_sql('words')}
SELECT sent_id, words FROM hit UNION ALL SELECT NULL, words FROM free""")
def lm_17(spark, d):
    return nf.filter_multiple(gram_table(spark, d), bench_sent_vocab(spark, d))


@register("lm_18_filter_context", f"""WITH {DOC}, {COUNTS}, {BENCH}, {BSV}, {GRAMS}, {_set_sql(CTX)}
SELECT words, raw::BIGINT AS raw FROM g WHERE words IN (SELECT words FROM hit UNION SELECT words FROM free)""")
def lm_18(spark, d):
    return nf.filter_context(gram_table(spark, d), bench_sent_vocab(spark, d), "union")


def bench_phrases(spark, d):
    """Benchmark items as phrase lists, cut after commas and full stops."""
    text = F.regexp_replace("text", r"[\t\n\r ]+", " ")
    cut = table(spark, d, "benchmark").select(F.col("item_id").alias("sent_id"), F.explode(F.split(text, "[,.] ")).alias("phrase"))
    return cut.select("sent_id", F.trim("phrase").alias("phrase")).filter("phrase <> ''")


_PHR = """ph AS (SELECT item_id AS sent_id, trim(x) AS phrase FROM (SELECT item_id, unnest(regexp_split_to_array(regexp_replace(text, '[\\t\\n\\r ]+', ' ', 'g'), '[,.] ')) AS x FROM benchmark) WHERE trim(x) <> ''),
pw AS (SELECT sent_id, string_split(phrase, ' ') AS w FROM ph), pv AS (SELECT unnest(w) AS word FROM pw), """ + _known_sql("pv") + """,
pr0 AS (SELECT sent_id, w, unnest(range(1, len(w) + 1)) AS i FROM pw),
pr1 AS (SELECT sent_id, w, i, unnest(range(1, least(3, len(w) - i + 1) + 1)) AS n FROM pr0),
rel AS MATERIALIZED (SELECT DISTINCT sent_id, array_to_string(w[i:i + n - 1], ' ') AS seg, i = 1 AS st, i + n - 1 = len(w) AS en FROM pr1),
gb AS (SELECT words, CASE WHEN list_contains(b, '</s>') THEN b[1:list_position(b, '</s>') - 1] ELSE b END AS b
  FROM (SELECT words, CASE WHEN starts_with(words, '<') AND ends_with(string_split(words, ' ')[1], '>') THEN string_split(words, ' ')[2:] ELSE string_split(words, ' ') END AS b FROM gk)),
one AS (SELECT words, sent_id FROM gb JOIN rel ON seg = array_to_string(b, ' ') WHERE len(b) > 0),
two AS (SELECT gb.words, r1.sent_id FROM gb, (SELECT unnest([1, 2]) AS c) JOIN rel r1 ON r1.en AND r1.seg = array_to_string(b[1:c], ' ')
  JOIN rel r2 ON r2.sent_id = r1.sent_id AND r2.st AND r2.seg = array_to_string(b[c + 1:], ' ') WHERE c < len(b)),
three AS (SELECT gb.words, r1.sent_id FROM gb JOIN rel r1 ON r1.en AND r1.seg = b[1] JOIN rel r2 ON r2.sent_id = r1.sent_id AND r2.st AND r2.en AND r2.seg = b[2]
  JOIN rel r3 ON r3.sent_id = r1.sent_id AND r3.st AND r3.seg = b[3] WHERE len(b) = 3),
allh AS (SELECT * FROM one UNION SELECT * FROM two UNION SELECT * FROM three),
fr AS (SELECT words FROM gb WHERE len(b) = 0)"""


@register("lm_19_filter_phrase", f"""WITH {DOC}, {COUNTS}, {GRAMS}, {_PHR}
SELECT words, raw::BIGINT AS raw FROM g WHERE words IN (SELECT words FROM allh UNION SELECT words FROM fr)""")
def lm_19(spark, d):
    return nf.filter_phrase(gram_table(spark, d), bench_phrases(spark, d), "union", ORDER)


@register("lm_19_filter_phrase_multiple", f"WITH {DOC}, {COUNTS}, {GRAMS}, {_PHR} SELECT sent_id, words FROM allh UNION ALL SELECT NULL, words FROM fr")
def lm_19b(spark, d):
    return nf.filter_phrase(gram_table(spark, d), bench_phrases(spark, d), "multiple", ORDER)


@register("lm_20_phrase_table_vocab", f"""WITH {CONV}, {BENCH},
bt AS (SELECT tokens, unnest(range(1, len(tokens) - 1)) AS i FROM bs WHERE len(tokens) >= 3),
pt AS (SELECT DISTINCT tokens[i] || ' ' || tokens[i + 1] AS source, tokens[i + 2] AS word FROM bt),
cr AS (SELECT conv_id, turn, tokens, unnest(range(1, len(tokens))) AS i FROM cs WHERE len(tokens) >= 2)
SELECT DISTINCT conv_id, turn, word FROM (
  SELECT conv_id, turn, unnest(tokens) AS word FROM cs
  UNION ALL SELECT conv_id, turn, pt.word FROM cr JOIN pt ON pt.source = tokens[i] || ' ' || tokens[i + 1])""")
def lm_20(spark, d):
    b = bench_lines(spark, d).filter(F.size("tokens") >= 3)
    at = b.select("tokens", F.explode(F.sequence(F.lit(1), F.size("tokens") - 2)).alias("i"))
    pt = at.select(
        F.array_join(F.slice("tokens", F.col("i"), F.lit(2)), " ").alias("source"), F.element_at("tokens", F.col("i") + 2).alias("target")
    )
    s = convs(spark, d).select(F.struct("conv_id", "turn").alias("sent_id"), "tokens")
    return nf.phrase_table_vocab(s, pt).select("sent_id.*", "word")


@register("lm_21_copy", f"WITH {CONV}, {CMODEL} SELECT ord::INTEGER AS ord, words, {D6('prob')}, {D6('backoff')} FROM clm")
def lm_21(spark, d):
    first, second = arpa.scratch_path(spark, "a.arpa"), arpa.scratch_path(spark, "b.arpa")
    arpa.write_arpa(conv_lm(spark, d), first, ORDER)
    arpa.write_arpa(arpa.read_arpa(spark, first), second, ORDER)
    return _lm_out(arpa.read_arpa(spark, second))


TWO = f"{DOC}, {MODEL}, {CONV}, {CMODEL}"


@register("lm_22_merge_vocab", f"""WITH {TWO}, a AS (SELECT words FROM lm WHERE ord = 1), b AS (SELECT words FROM clm WHERE ord = 1)
SELECT coalesce(a.words, b.words) AS word, a.words IS NOT NULL AS in_0, b.words IS NOT NULL AS in_1 FROM a FULL JOIN b ON a.words = b.words""")
def lm_22(spark, d):
    return mix.merge_vocab([doc_model(spark, d), conv_lm(spark, d)])


W0, W1 = 0.6, 0.4


def _merge_sql(n: int) -> str:
    out = []
    for k in range(1, n + 1):
        joint = f"""j{k} AS (SELECT coalesce(a.words, b.words) AS words, a.prob AS p0, b.prob AS p1, a.backoff AS b0, b.backoff AS b1
  FROM (SELECT * FROM lm WHERE ord = {k}) a FULL JOIN (SELECT * FROM clm WHERE ord = {k}) b ON a.words = b.words)"""
        out.append(joint)
        if k == 1:
            out.append(f"""m1 AS MATERIALIZED (SELECT words, {W0} * coalesce(p0, u0) AS v0, {W1} * coalesce(p1, u1) AS v1, 0 AS f0, 0 AS f1, {W0} * u0 + {W1} * u1 AS lower
  FROM j1, (SELECT prob AS u0 FROM lm WHERE ord = 1 AND words = '<unk>'), (SELECT prob AS u1 FROM clm WHERE ord = 1 AND words = '<unk>'))""")
        else:
            out.append(f"""m{k} AS MATERIALIZED (SELECT j.words, coalesce({W0} * p0, s.v0) AS v0, coalesce({W1} * p1, s.v1) AS v1,
  CASE WHEN p0 IS NULL THEN s.f0 ELSE {k - 1} END AS f0, CASE WHEN p1 IS NULL THEN s.f1 ELSE {k - 1} END AS f1, s.v0 + s.v1 AS lower
  FROM (SELECT *, {SUFFIX} AS sfx FROM j{k}) j JOIN m{k - 1} s ON s.words = j.sfx)""")
    return ",\n".join(out)


@register("lm_23_merge_probabilities", f"WITH {TWO}, {_merge_sql(ORDER)} " + " UNION ALL ".join(
    f"SELECT {k}::INTEGER AS ord, words, round(v0 + v1, 6) AS prob, round(lower, 6) AS lower, f0::INTEGER AS from_0, f1::INTEGER AS from_1 FROM m{k}"
    for k in range(1, ORDER + 1)))
def lm_23(spark, d):
    m = mix.merge_probabilities([doc_model(spark, d), conv_lm(spark, d)], [W0, W1], ORDER)
    return m.select(F.col("order").alias("ord"), "words", F.round("prob", 6).alias("prob"), F.round("lower", 6).alias("lower"), "from_0", "from_1")


def _norm_sql(n: int) -> str:
    out = []
    for k in range(1, n + 1):
        out.append(f"""j{k} AS (SELECT coalesce(a.words, b.words) AS words, a.prob AS p0, b.prob AS p1, coalesce(a.backoff, 0) AS b0, coalesce(b.backoff, 0) AS b1
  FROM (SELECT * FROM lm WHERE ord = {k}) a FULL JOIN (SELECT * FROM clm WHERE ord = {k}) b ON a.words = b.words)""")
        if k == 1:
            out.append("""n1 AS MATERIALIZED (SELECT words, coalesce(p0, u0) AS s0, coalesce(p1, u1) AS s1, b0, b1, 0.0 AS lo, 0.0 AS cb, '' AS ctx, '' AS sfx
  FROM j1, (SELECT prob AS u0 FROM lm WHERE ord = 1 AND words = '<unk>'), (SELECT prob AS u1 FROM clm WHERE ord = 1 AND words = '<unk>'))""")
        else:
            out.append(f"""n{k} AS MATERIALIZED (SELECT j.words, coalesce(j.p0, s.s0 + c.b0) AS s0, coalesce(j.p1, s.s1 + c.b1) AS s1, j.b0, j.b1,
  {W0} * s.s0 + {W1} * s.s1 AS lo, {W0} * c.b0 + {W1} * c.b1 AS cb, j.ctx, j.sfx
  FROM (SELECT *, {SUFFIX} AS sfx, {CTX} AS ctx FROM j{k}) j JOIN n{k - 1} s ON s.words = j.sfx JOIN n{k - 1} c ON c.words = j.ctx)""")
    out.append(f"z0 AS (SELECT log10(sum(pow(10, {W0} * s0 + {W1} * s1))) AS lz FROM n1 WHERE words <> '<s>')")
    for k in range(1, n):
        prior = "z0 p ON true" if k == 1 else f"z{k - 1} p ON p.words = a.sfx"
        out.append(f"""z{k} AS MATERIALIZED (SELECT a.words, p.lz + {W0} * b0 + {W1} * b1 AS op, log10(pow(10, p.lz + {W0} * b0 + {W1} * b1) + coalesce(dl, 0)) AS lz
  FROM n{k} a JOIN {prior} LEFT JOIN (SELECT ctx, sum(pow(10, {W0} * s0 + {W1} * s1) - pow(10, lo + cb)) AS dl FROM n{k + 1} GROUP BY 1) d ON d.ctx = a.words)""")
    parts = []
    for k in range(1, n + 1):
        prior = "z0 p ON true" if k == 1 else f"z{k - 1} p ON p.words = a.ctx"
        own = f"LEFT JOIN z{k} q ON q.words = a.words" if k < n else ""
        bow = "q.op - q.lz" if k < n else "0.0::DOUBLE"
        parts.append(f"""SELECT {k}::INTEGER AS ord, a.words, round(least({W0} * s0 + {W1} * s1 - p.lz, 0), 5) AS prob, round({bow}, 5) AS backoff
  FROM n{k} a JOIN {prior} {own}""")
    return ",\n".join(out) + "\n" + " UNION ALL ".join(parts)


@register("lm_24_normalize_mixture", f"WITH {TWO}, {_norm_sql(ORDER)}")
def lm_24(spark, d):
    return _lm_out(mix.normalize_mixture([doc_model(spark, d), conv_lm(spark, d)], [W0, W1], ORDER), 5)


@register("lm_26_tune_weights")
def lm_26(spark, d):
    history = mix.tune_weights([doc_model(spark, d), conv_lm(spark, d)], bench_lines(spark, d), ORDER)
    rows = [(i, m, w, h["perplexity"]) for i, h in enumerate(history) for m, w in enumerate(h["weights"])]
    return spark.createDataFrame(rows, "round int, model int, weight double, perplexity double")


@register("lm_27_choose_completion", f"""WITH {SCORED_CONV},
own AS (SELECT conv_id, turn, line_no, sum(-prob) AS total, avg(-prob) AS mean FROM tok WHERE pos >= 1 GROUP BY ALL)
SELECT conv_id, turn, (arg_min(line_no, (round(total, 6), line_no)))::INTEGER AS by_sum, (arg_min(line_no, (round(mean, 6), line_no)))::INTEGER AS by_mean FROM own GROUP BY ALL""")
def lm_27(spark, d):
    toks = ns.score_tokens(convs(spark, d), doc_model(spark, d), ORDER, ["conv_id", "turn", "line_no"])
    losses = toks.select(
        F.struct("conv_id", "turn").alias("item"), F.col("line_no").alias("option"), "pos", F.lit(2).alias("ctx_len"), (-F.col("prob")).alias("loss")
    )
    return ns.choose_completion(losses).select("item.conv_id", "item.turn", "by_sum", "by_mean")
