"""Cleaning extracted triples: chapters, chunks, evidence, scores, decisions, rules with an audit."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import book_rules as br
from ..functions.book_rules import DEFAULT_CATEGORY, JOURNEY, BookRules
from ..functions.names import (
    clean_text, guess_type, infer_category, is_non_entity, lookup, names_of, normalize_category, normalize_entity, normalize_type, step,
    with_open_relation,
)
from ..functions.replies import strip
from ..session import materialise
from .graph import edge_ends

# fixed values: chapter headers and the digits and units of written numbers
CHAPTER_HEADER = r"^第(?:[一二三四五六七八九十百千0-9]+部分)?第?\s*([0-9]{1,4}|[一二三四五六七八九十百千]+)\s*回(?:\s+(.*))?$"
VOLUME_HEADER = r"^第[一二三四五六七八九十百千0-9]+卷\(\d+--\d+章\).+"
DIGITS = {"零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}
HANDED = 1 << 20  # characters of chapters whose chunks a task holds at once
UNTITLED = "第001回(无标题)"
MISSING_TITLE, UNTITLED_FIRST = "第一回(缺失标题)", "第一回(无标题)"
# fixed values: size estimate and sentence ends of the chunk rule
TOKENS_PER_CHAR = 0.66
SENTENCE_END = "。！？；"
EVIDENCE_LIMIT, EVIDENCE_MARGIN = 120, 20


def written_number(text: Column) -> Column:
    """Digits or a written Chinese number as INT; null if neither."""
    state = F.struct(F.lit(0).alias("total"), F.lit(0).alias("num"), F.lit(True).alias("ok"))
    digit = lambda c: lookup(DIGITS, c, F.lit(-1))
    unit = lambda c: lookup(UNITS, c, F.lit(0))

    def step(s: Column, c: Column) -> Column:
        d, u = digit(c), unit(c)
        return (
            F.when(d >= 0, F.struct(s["total"].alias("total"), d.alias("num"), s["ok"].alias("ok")))
            .when(u > 0, F.struct((s["total"] + F.greatest(s["num"], F.lit(1)) * u).alias("total"), F.lit(0).alias("num"), s["ok"].alias("ok")))
            .otherwise(F.struct(s["total"].alias("total"), s["num"].alias("num"), F.lit(False).alias("ok")))
        )

    spelled = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), state, step, lambda s: F.when(s["ok"], F.nullif(s["total"] + s["num"], F.lit(0))))
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("int")).otherwise(spelled)


def split_chapters(books: DataFrame, id_col: str, text: str, style: str = "numbered") -> DataFrame:
    """``(id, chapter_no, title, body, position)``.

    numbered: the header's own number; without a header the book is one chapter;
    text before the first header and empty bodies are dropped.
    ordered: volume headers; text before the first is chapter 1, the rest count on.
    One book is one row, so the window over its lines is bounded by that row.
    """
    lines = books.select(id_col, F.posexplode(F.split(text, "\n")).alias("line_no", "raw"))
    lines = lines.select(id_col, "line_no", "raw", strip(F.translate("raw", "　", " ")).alias("line"))
    if style == "numbered":
        number = F.when(F.col("line").rlike(CHAPTER_HEADER), written_number(F.regexp_extract("line", CHAPTER_HEADER, 1)))
        marked = lines.withColumn("number", number).withColumn("head", F.col("number").isNotNull())
    else:
        marked = lines.withColumn("number", F.lit(None).cast("int")).withColumn("head", F.col("line").rlike(VOLUME_HEADER))
    order = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumn("part", F.sum(F.col("head").cast("int")).over(order))
    body_line = F.col("line") if style == "numbered" else F.col("raw")
    parts = placed.groupBy(id_col, "part").agg(
        F.max(F.when(F.col("head"), F.col("number"))).alias("number"),
        F.max(F.when(F.col("head"), F.col("line"))).alias("title"),
        F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line_no", body_line.alias("t"))))).alias("ls"),
    )
    body = strip(F.array_join(F.transform("ls", lambda s: s["t"]), "\n"))
    parts = parts.select(id_col, "part", "number", "title", body.alias("body"), F.max("part").over(Window.partitionBy(id_col)).alias("last"))
    if style == "numbered":
        kept = parts.filter((F.col("last") == 0) | ((F.col("part") > 0) & (F.col("body") != "")))
        no, title = F.coalesce("number", F.lit(1)), F.coalesce("title", F.lit(UNTITLED))
    else:
        kept = parts
        no = (F.col("part") + 1).cast("int")
        title = F.coalesce("title", F.when(F.col("last") == 0, UNTITLED_FIRST).otherwise(MISSING_TITLE))
    return kept.select(id_col, no.alias("chapter_no"), title.alias("title"), "body", F.col("part").cast("int").alias("position"))


def _tokens(chars: int) -> int:
    return int(chars * TOKENS_PER_CHAR)


def _pieces(text: str, size: int) -> Iterator[str]:
    """Cut a long paragraph behind the last sentence end of each window, if that is far enough in."""
    while text:
        window = text[:size]
        last = max(window.rfind(c) for c in SENTENCE_END) + 1
        cut = last if last >= max(50, int(size * 0.5)) else len(window)
        if window[:cut].strip():
            yield window[:cut].strip()
        text = text[cut:]


def _long(text: str, size: int) -> list[str]:
    text = text.strip()
    return [text] if len(text) <= size else list(_pieces(text, size))


def chunk_chapter(body: str, limit: int, overlap: int, compat: bool) -> list[str]:
    """Chunks of one chapter; a small helper that runs inside tasks."""
    size = int((limit - 80) / TOKENS_PER_CHAR)
    paragraphs = ["".join(s.strip() for s in block.splitlines()).strip() for block in re.split(r"\n\s*\n", body)]
    units = [u for p in paragraphs if p for u in _long(p, size) if u]
    packed: list[list[str]] = []
    fill = 0
    for u in units:
        grown = fill + len(u) + (1 if packed and packed[-1] else 0)
        if not packed or _tokens(grown) > limit:
            packed.append([])
            # the compatible rule goes on from the old size, so later units stand alone
            grown = grown if compat and len(packed) > 1 else len(u)
        packed[-1].append(u)
        fill = grown
    joined = ["\n".join(group).strip() for group in packed]
    base = [c for j in joined for c in ([j] if _tokens(len(j)) <= limit else _long(j, size)) if c]
    if overlap <= 0:
        return base
    out: list[str] = []
    for c in base:
        if out:
            c = (out[-1][-overlap:] + "\n" + c).strip()
            c = c if _tokens(len(c)) <= limit else c[-size:].strip()
        out.append(c)
    return out


def chunk_lists(bodies: Iterator[pa.Array], limit: int, overlap: int, compat: bool) -> Iterator[pa.Array]:
    """The chunks of each chapter, handed on by ``HANDED`` characters: a batch of chapters has no such bound."""
    for column in bodies:
        made, held = [], 0
        for body in column:
            text = body.as_py() or ""
            made.append(chunk_chapter(text, limit, overlap, compat))
            held += len(text)
            if held >= HANDED:
                yield pa.array(made, pa.list_(pa.string()))
                made, held = [], 0
        if made:
            yield pa.array(made, pa.list_(pa.string()))


def chunk_text(chapters: DataFrame, limit: int = 6500, overlap: int = 350, compat: bool = False) -> DataFrame:
    """Chapters to ``chunk_idx, chunk_id, chunk``; row-wise, no shuffle."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cut(bodies: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return chunk_lists(bodies, limit, overlap, compat)

    keep = [c for c in chapters.columns if c != "body"]
    made = chapters.select(*keep, cut("body").alias("cs"))
    rows = made.select(*keep, F.posexplode("cs").alias("i", "chunk"))
    cid = F.format_string("%d-%04d", F.col("chapter_no"), F.col("i") + 1)
    return rows.select(*keep, (F.col("i") + 1).alias("chunk_idx"), cid.alias("chunk_id"), "chunk")


def _spots(text: str, name: str) -> list[int]:
    return [m.start() for m in re.finditer(re.escape(name), text)]


def shortest_evidence(chunk: str, head: str, tail: str) -> str | None:
    """Shortest span of the chunk with both names, widened to sentence ends."""
    hs, ts = _spots(chunk, head), _spots(chunk, tail)
    best = None
    for h in hs:
        at = bisect_left(ts, h)
        for t in ts[max(0, at - 1) : at + 1]:  # only the nearest tails can give the shortest span
            a, b = min(h, t), max(h + len(head), t + len(tail))
            if best is None or b - a < best[1] - best[0]:
                best = (a, b)
    if best is None:
        return None
    a, b = best
    ends = [m.start() for m in re.finditer(f"[{SENTENCE_END}\n]", chunk)]
    before, after = bisect_left(ends, a), bisect_left(ends, b)
    wide = chunk[ends[before - 1] + 1 if before else 0 : ends[after] + 1 if after < len(ends) else len(chunk)].strip()
    tight = chunk[a:b].strip()
    text = wide if head in wide and tail in wide and len(wide) <= EVIDENCE_LIMIT else tight
    if len(text) > EVIDENCE_LIMIT:
        text = chunk[max(0, a - EVIDENCE_MARGIN) : b + EVIDENCE_MARGIN].strip()
    return text[:EVIDENCE_LIMIT] if head in text and tail in text else None


def repair_evidence(rows: DataFrame, chunk: str, head: str, tail: str, evidence: str) -> DataFrame:
    """Replace ``evidence`` by a text of the chunk that holds both names, null if there is none.

    Good evidence is kept by expressions; the scan runs for the other rows only.
    """
    rows = step(rows, {"__h": clean_text(F.col(head)), "__t": clean_text(F.col(tail)), "__e": clean_text(F.col(evidence))})
    h, t, e, c = F.col("__h"), F.col("__t"), F.col("__e"), F.col(chunk)
    good = (e != "") & F.contains(c, e) & F.contains(e, h) & F.contains(e, t) & (F.length(e) <= EVIDENCE_LIMIT)
    able = (h != "") & (t != "") & F.contains(c, h) & F.contains(c, t)

    @F.pandas_udf(T.StringType())
    def scan(chunks: pd.Series, heads: pd.Series, tails: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else shortest_evidence(x, y, z) for x, y, z in zip(chunks, heads, tails)], dtype=object)

    marked = step(rows, {"__g": F.coalesce(good & able, F.lit(False)), "__a": F.coalesce(able, F.lit(False))})
    found = marked.withColumn("__f", scan(F.when(~F.col("__g") & F.col("__a"), c), h, t))
    return found.withColumn(evidence, F.when(F.col("__g"), F.col("__e")).otherwise(F.col("__f"))).drop("__g", "__a", "__h", "__t", "__e", "__f")


def align_to_evidence(raw: Column, norm: Column, evidence: Column, rules: BookRules = JOURNEY) -> Column:
    """The name as written if the evidence holds it, else the longest alias it holds (cleaned columns)."""
    alias = F.get(F.filter(names_of(norm, rules), lambda n: F.contains(evidence, n)), F.lit(0))
    return F.when((evidence == "") | ((raw != "") & F.contains(evidence, raw)), raw).otherwise(F.coalesce(alias, raw))


def normalized_records(rows: DataFrame, rules: BookRules = JOURNEY) -> DataFrame:
    """Clean the fields, add head_norm, relation_norm, tail_norm, make types and categories canonical."""
    texts = [c for c in ("head", "tail", "relation", "head_cate", "tail_cate", "head_type", "tail_type", "head_norm", "tail_norm", "evidence") if c in rows.columns]
    rows = step(rows, {c: clean_text(F.col(c)) for c in texts})
    made = {f"{s}_type": normalize_type(F.col(f"{s}_type"), rules) for s in ("head", "tail")}
    made |= {f"{s}_cate": normalize_category(F.col(f"{s}_cate"), rules) for s in ("head", "tail")}
    for s in ("head", "tail"):
        main = normalize_entity(F.col(s), rules)
        made[f"{s}_norm"] = F.coalesce(F.nullif(F.col(f"{s}_norm"), F.lit("")), main) if f"{s}_norm" in texts else main
    return with_open_relation(step(rows, made), "relation", "head_norm", "tail_norm", "relation_norm", rules)


def reject_non_entities(rows: DataFrame, rules: BookRules = JOURNEY) -> DataFrame:
    """Drop rows with an unusable head or tail and self-loops."""
    ready = step(rows, {"__h": clean_text(F.col("head")), "__t": clean_text(F.col("tail"))})
    h, t = F.col("__h"), F.col("__t")
    return ready.filter(~is_non_entity(h, rules) & ~is_non_entity(t, rules) & (h != t)).drop("__h", "__t")


RECORD_KEY = ["head_norm", "relation_norm", "tail_norm", "head_type", "tail_type"]


def score_records(records: DataFrame, rules: BookRules = JOURNEY) -> DataFrame:
    """Metadata score 0..8 of normalised records."""
    names = {s: F.coalesce(F.nullif(F.col(f"{s}_norm"), F.lit("")), F.col(s)) for s in ("head", "tail")}
    records = step(records, {f"__{s}": n for s, n in names.items()})
    records = step(records, {f"__{s}_cate": infer_category(F.col(f"__{s}"), F.col(f"{s}_type"), rules) for s in ("head", "tail")})
    e, h, t = F.col("evidence"), F.col("head"), F.col("tail")
    one = lambda c, n=1: F.when(c, n).otherwise(0)
    inferred = {s: F.col(f"__{s}_cate") for s in ("head", "tail")}
    score = one(F.col("head_cate") != DEFAULT_CATEGORY, 2) + one(F.col("tail_cate") != DEFAULT_CATEGORY, 2)
    score = score + one((e != "") & (h != "") & (t != "") & F.contains(e, h) & F.contains(e, t)) + one((e != "") & (F.length(e) <= 80))
    for s in ("head", "tail"):
        score = score + one((inferred[s] != DEFAULT_CATEGORY) & (F.col(f"{s}_cate") == inferred[s]))
    return step(records, {"score": score}).drop("__head", "__tail", "__head_cate", "__tail_cate")


def keep_best(records: DataFrame, arrival: str) -> DataFrame:
    """Per key the first record with the greatest score."""
    rest = [c for c in records.columns if c not in RECORD_KEY]
    order = F.struct(F.col("score"), -F.col(arrival))
    whole = records.filter("head_norm <> '' and tail_norm <> '' and relation_norm <> ''")
    return whole.groupBy(*RECORD_KEY).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*RECORD_KEY, "r.*")


def export_best(records: DataFrame, arrival: str) -> DataFrame:
    """Per key the record of the earliest chapter, then with more known categories, as 7-column lines."""
    known = (F.col("head_cate") != DEFAULT_CATEGORY).cast("int") + (F.col("tail_cate") != DEFAULT_CATEGORY).cast("int")
    chapter = F.coalesce(F.nullif(F.col("chapter_no"), F.lit(0)), F.lit(10**9))
    ready = records.filter("head_norm <> '' and tail_norm <> '' and relation_norm <> ''").withColumn("chapter_no", chapter)
    best = ready.groupBy(*RECORD_KEY).agg(
        F.min_by(F.struct("chapter_no", "head_cate", "tail_cate"), F.struct(F.col("chapter_no"), -known, F.col(arrival))).alias("r")
    ).select(*RECORD_KEY, "r.*")
    names = ["head_norm", "tail_norm", "relation_norm", "head_cate", "tail_cate", "head_type", "tail_type"]
    line = F.concat_ws(",", *[csv_safe(F.col(c)) for c in names])
    checked = F.when(F.size(F.split(line, ",")) == 7, line).otherwise(F.raise_error(F.concat(F.lit("not 7 columns: "), line)).cast("string"))
    return best.select("chapter_no", F.col("head_norm").alias("head"), F.col("relation_norm").alias("relation"), F.col("tail_norm").alias("tail"), checked.alias("line")).orderBy(
        "chapter_no", "head", "relation", "tail"
    )


def csv_safe(text: Column) -> Column:
    return strip(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), ",", "，"), "[\r\n]", " "))


_JSON_PART = re.compile(r'"(?:\\.|[^"\\])*(?:"|$)|[\[\]{}]', re.S)


def complete_objects(text: str) -> str | None:
    """The whole objects of a cut-off JSON array as one array text, null if there is none."""
    text = (text or "").strip()
    if not text.startswith("["):
        return None
    objects, depth, arrays, start = [], 0, 0, 0
    for m in _JSON_PART.finditer(text):
        ch = m.group()
        if ch == "[":
            arrays += 1
        elif ch == "]":
            arrays = max(0, arrays - 1)
        elif ch == "{" and arrays:
            start = m.start() if depth == 0 else start
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if depth == 0:
                objects.append(text[start : m.end()])
    try:
        return json.dumps(json.loads("[" + ",".join(objects) + "]"), ensure_ascii=False) if objects else None
    except ValueError:
        return None


def salvage(text: str) -> str | None:
    found = complete_objects(text)
    if found is None:
        key = (text or "").find('"relations"')
        start = text.find("[", key) if key >= 0 else -1
        found = complete_objects(text[start:]) if start >= 0 else None
    return found


def salvage_json(rows: DataFrame, column: str) -> DataFrame:
    """Add ``objects``, a JSON array text: the value itself, its relations array, or what can be saved.

    Only rows the parser rejects reach the Python scan.
    """
    body = F.col(column)
    v = F.try_parse_json(body)
    # the parser stops behind the first whole value; a cut-off text never gets that far
    fine = v.isNotNull()
    inner = F.get_json_object(body, "$.relations")
    whole = F.when(strip(body).startswith("["), strip(body)).when(F.coalesce(inner, F.lit("")).startswith("["), inner)

    @F.pandas_udf(T.StringType())
    def rescue(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else salvage(t) for t in texts], dtype=object)

    marked = rows.withColumn("__ok", fine)
    return marked.withColumn("__r", rescue(F.when(~F.col("__ok"), body))).withColumn(
        "objects", F.when(F.col("__ok"), whole).otherwise(F.col("__r"))
    ).drop("__ok", "__r")


def apply_decisions(candidates: DataFrame, decisions: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Kept candidates and a log of the dropped ones; no decision keeps, only ``keep = true`` does otherwise."""
    d = decisions.groupBy(id_col).agg(F.max_by(F.struct("keep", "reason"), "row_order").alias("d"))
    joined = candidates.join(d, id_col, "left").withColumn("__keep", F.when(F.col("d").isNull(), True).otherwise(F.coalesce("d.keep", F.lit(False))))
    kept = joined.filter("__keep").drop("d", "__keep")
    return kept, joined.filter("not __keep").select(id_col, F.col("d.reason").alias("reason"))


def canonical_direction(rows: DataFrame, base: DataFrame, relations: Sequence[str] = br.SERVANT_RELATIONS) -> DataFrame:
    """Turn servant edges to maid -> master by known edges first, then by the roles seen in ``base``."""
    key = ["head", "relation", "tail", "head_type", "tail_type"]
    served = base.filter(F.col("relation").isin(*relations))
    known = base.select(*key).distinct()
    maids = served.select(F.col("head").alias("n")).filter("n <> ''").distinct()
    masters = served.select(F.col("tail").alias("n")).filter("n <> ''").distinct()
    turned = known.select(F.col("tail").alias("head"), "relation", F.col("head").alias("tail"), F.col("tail_type").alias("head_type"), F.col("head_type").alias("tail_type"))
    out = rows.join(known.withColumn("__cur", F.lit(True)), key, "left").join(turned.withColumn("__rev", F.lit(True)), key, "left")
    for side in ("head", "tail"):
        for flag, names in (("maid", maids), ("master", masters)):
            out = out.join(names.select(F.col("n").alias(side), F.lit(True).alias(f"__{side}_{flag}")), side, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    by_key = yes("__rev") & ~yes("__cur")
    by_role = (yes("__tail_maid") & ~yes("__head_maid")) | (yes("__head_master") & ~yes("__tail_master") & ~yes("__head_maid"))
    swap = F.col("relation").isin(*relations) & (F.col("head") != "") & (F.col("tail") != "") & (by_key | by_role)
    other = {"head": "tail", "tail": "head"}
    cols = []
    for c in rows.columns:
        side = c.split("_")[0]
        cols.append(F.when(swap, F.col(c.replace(side, other[side], 1))).otherwise(F.col(c)).alias(c) if side in other else F.col(c))
    return out.select(*cols, swap.alias("swapped"))


def pending_chunks(chunks: DataFrame, log: DataFrame, signature: str) -> DataFrame:
    """Chunks without an ok entry of this run signature in the log."""
    done = log.filter((F.col("status") == "ok") & (F.col("run_signature") == signature)).select("chunk_id").distinct()
    return chunks.join(done, "chunk_id", "left_anti")


def entity_modes(edges: DataFrame) -> DataFrame:
    """``(name, type_mode, type_share, cate_mode)`` over both ends; ties go to the value seen first.

    The category prefers the best known one if it holds 60 % or three mentions.
    """
    ends = edge_ends(edges).filter("name <> ''").withColumn("at", F.struct("line_no", "side"))

    def counted(column: str) -> DataFrame:
        return ends.groupBy("name", column).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))

    rank = F.struct(-F.col("n"), F.col("first"))
    types = counted("etype").groupBy("name").agg(
        F.min_by("etype", rank).alias("type_mode"), (F.max("n") / F.sum("n")).alias("type_share")
    )
    known = F.col("cate") != DEFAULT_CATEGORY
    cates = counted("cate").groupBy("name").agg(
        F.min_by("cate", rank).alias("__any"),
        F.min_by(F.when(known, F.struct("cate", "n")), F.when(known, rank)).alias("__known"),
        F.sum("n").alias("__t"),
    )
    strong = (F.col("__known.n") / F.col("__t") >= 0.6) | (F.col("__known.n") >= 3)
    cates = cates.select("name", F.when(F.coalesce(strong, F.lit(False)), F.col("__known.cate")).otherwise(F.col("__any")).alias("cate_mode"))
    return types.join(cates, "name")


TRIPLE = ["head", "tail", "relation", "head_cate", "tail_cate", "head_type", "tail_type"]


def clean_triples(edges: DataFrame, rules: BookRules = JOURNEY) -> tuple[DataFrame, DataFrame]:
    """Cleaned distinct triples and one audit row per input line.

    Both come from one annotated table: each line carries the triples it turns
    into and the notes of the rules that fired.
    """
    plain = lambda c: F.translate(strip(F.coalesce(F.col(c), F.lit(""))), "　", " ")
    first = edges.select(
        "line_no", *[plain(c).alias(f"{c}_raw") for c in ("head", "tail", "relation")],
        *[normalize_category(plain(f"{s}_cate"), rules).alias(f"{s}_cate") for s in ("head", "tail")],
        *[normalize_type(plain(f"{s}_type"), rules).alias(f"{s}_type") for s in ("head", "tail")],
    )
    first = step(first, {
        "head": lookup(rules.aliases, F.col("head_raw")), "tail": lookup(rules.aliases, F.col("tail_raw")), "relation": lookup(rules.relations, F.col("relation_raw")),
    })
    first = materialise(first, "normalised")  # the modes and the rules read it
    modes = materialise(entity_modes(first), "modes")
    for s in ("head", "tail"):
        m = modes.select(F.col("name").alias(s), F.col("type_mode").alias(f"{s}_mode"), F.col("type_share").alias(f"{s}_share"), F.col("cate_mode").alias(f"{s}_cm"))
        first = first.join(m, s, "left")
    rows = first.withColumn("notes", F.array().cast("array<string>"))

    def fix(rows: DataFrame, when: Column, column: str, value: Column, note: str) -> DataFrame:
        """Set a column where a rule holds and note the rule."""
        rows = step(rows, {"__w": F.coalesce(when, F.lit(False))})
        return rows.withColumn(column, F.when(F.col("__w"), value).otherwise(F.col(column))).withColumn(
            "notes", F.when(F.col("__w"), F.array_append("notes", F.lit(note))).otherwise(F.col("notes"))
        )

    has = {s: F.col(s) != "" for s in ("head", "tail")}
    for s in ("head", "tail"):
        fill = has[s] & (F.col(f"{s}_cate") == DEFAULT_CATEGORY) & (F.col(f"{s}_cm") != DEFAULT_CATEGORY)
        rows = fix(rows, fill, f"{s}_cate", F.col(f"{s}_cm"), f"fill_{s}_cate")
    local = F.col("relation").isin(*rules.locative)
    rows = fix(rows, local & has["tail"] & (F.col("tail_type") != br.PLACE), "tail_type", F.lit(br.PLACE), "force_tail_place_by_relation")
    rows = fix(rows, (F.col("relation") == br.LOCATED_IN) & has["head"] & (F.col("head_type") != br.PLACE), "head_type", F.lit(br.PLACE), "force_head_place_by_rel_" + br.LOCATED_IN)
    for s in ("head", "tail"):
        sure = has[s] & (F.col(f"{s}_type") != br.PLACE) & (F.col(f"{s}_share") >= 0.8) & (F.col(f"{s}_mode") != F.col(f"{s}_type"))
        rows = fix(rows, sure, f"{s}_type", F.col(f"{s}_mode"), f"align_{s}_type_to_mode_hi_conf")
    looks = guess_type(F.col("head"), rules)
    rows = fix(rows, has["head"] & (looks != F.col("head_type")) & (F.col("head_mode") != F.col("head_type")), "head_type", F.col("head_mode"), "align_head_type_to_mode")
    looks = guess_type(F.col("tail"), rules)
    rows = fix(rows, has["tail"] & ~local & (looks == br.PERSON) & (F.col("tail_type") != br.PERSON), "tail_type", F.lit(br.PERSON), "guess_tail_person_by_suffix")

    pattern = "^(" + "|".join(br.HELD_DOWN_AT) + ")(.+)$"
    place = strip(F.regexp_extract("relation", pattern, 2))
    action = F.regexp_replace(F.regexp_extract("relation", pattern, 1), ".$", "")
    rows = rows.withColumn("place", place).withColumn("action", action)
    split = (F.col("place") != "") & (guess_type(F.col("place"), rules) == br.PLACE)
    rows = fix(rows, split, "relation", F.col("action"), "split_embedded_place_action").withColumn("split", F.coalesce(split, F.lit(False)))
    passive = F.col("split") & F.col("relation_raw").startswith(br.PASSIVE_HELD)
    active = F.col("split") & ~passive
    rows = rows.withColumn("passive", passive).withColumn("active", active)

    def triple(head: Column, tail: Column, relation: Column, hc: Column, tc: Column, ht: Column, tt: Column) -> Column:
        return F.struct(*[v.alias(n) for n, v in zip(TRIPLE, (head, tail, relation, hc, tc, ht, tt))])

    c = {n: F.col(n) for n in [*TRIPLE, "place"]}
    other, at = F.lit(DEFAULT_CATEGORY), F.lit(br.PLACE)
    held = F.lit(br.PASSIVE_HELD)
    loop = ~F.col("passive") & has["head"] & (F.col("head") == F.col("tail"))
    made = F.array_compact(F.array(
        F.when(F.col("passive"), triple(c["head"], c["place"], held, c["head_cate"], other, c["head_type"], at)),
        F.when(F.col("passive") & has["tail"], triple(c["tail"], c["head"], F.lit(br.HELD_BY), c["tail_cate"], c["head_cate"], c["tail_type"], c["head_type"])),
        F.when(F.col("active") & has["tail"], triple(c["tail"], c["place"], held, c["tail_cate"], other, c["tail_type"], at)),
        F.when(~F.col("passive") & ~F.coalesce(loop, F.lit(False)), triple(*[c[n] for n in TRIPLE])),
    ))
    late = [
        (F.col("passive"), "rewrite_passive_to_locative"), (F.col("passive") & has["tail"], "add_inferred_actor_action"),
        (F.col("active") & has["tail"], "add_target_locative"), (loop, "drop_self_loop"),
    ]
    notes = F.concat("notes", F.array_compact(F.array(*[F.when(w, F.lit(n)) for w, n in late])))
    done = rows.withColumn("made", made).withColumn("notes", notes)
    cleaned = done.select(F.explode("made").alias("t")).select("t.*").distinct()
    audit = done.select(
        "line_no", "head_raw", "tail_raw", "relation_raw", "head", "tail",
        lookup(rules.relations, F.col("relation_raw")).alias("relation"), F.array_join("notes", "|").alias("note"),
    )
    return cleaned, audit


def clean_by_relation(edges: DataFrame, aliases: dict, categories: dict, relations: dict) -> DataFrame:
    """Map names, categories and relations, derive the tail type from the relation, drop duplicates."""
    rows = edges.select(
        lookup(aliases, F.trim("head")).alias("head"), lookup(aliases, F.trim("tail")).alias("tail"), lookup(relations, F.trim("relation")).alias("relation"),
        *[lookup(categories, F.trim(f"{s}_cate")).alias(f"{s}_cate") for s in ("head", "tail")], F.trim("head_type").alias("head_type"), F.trim("tail_type").alias("tail_type"),
    )
    for pattern, person_only, kind in br.RELATION_TAIL_TYPES:
        hit = F.col("relation").rlike(pattern)
        hit = hit & (F.col("tail_type") == br.PERSON) if person_only else hit
        rows = rows.withColumn("tail_type", F.when(hit, kind).otherwise(F.col("tail_type")))
    return rows.distinct()
