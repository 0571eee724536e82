"""Pages, documents, transcripts and work lists."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import rank_by_order, runs_by_order
from ..functions.replies import first_match, strip

PARAGRAPH_BREAK = "\n"
# fixed values: line removed from pages, url patterns, file types
READING_LIST_NOTE = "Add to Qwen's Reading List"
URL = r"https?://\S+"
MARKDOWN_URL = r"!?\[[^\]]*\]\(([^\)]+)\)"
CODE_BLOCK = r"(?s)```[^\n]*\n(.+?)```"
HTML_TAG = r"(?s)<(p|span|div|li|html|script)[^>]*?"
IMAGE_TYPES = ("jpg", "jpeg", "png", "webp")
FILE_TYPES = ("pdf", "docx", "pptx", "csv", "tsv", "xlsx", "xls", "zip", "mp3", "jsonl", "pdb", "py", "xml")
VIDEO_NOTE = "Your browser can't play this video."
# fixed values: search locale by language
LOCALES = {True: ("China", "cn", "zh-cn"), False: ("United States", "us", "en")}


class _Blocks(HTMLParser):
    """Collects the text of every p and div in document order and the title."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int | None]] = []
        self.blocks: list[list[str]] = []
        self.nested: set[int] = set()
        self.title: str | None = None

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "div") and any(t == "p" for t, _ in self.open):
            self.handle_endtag("p")  # a paragraph cannot hold a block
        slot = None
        if tag in ("p", "div"):
            self.nested.update(s for _, s in self.open if s is not None)
            slot = len(self.blocks)
            self.blocks.append([])
        if tag not in self.VOID:
            self.open.append((tag, slot))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        tags = {t for t, _ in self.open}
        if "title" in tags and self.title is None:
            self.title = data
        if tags & {"script", "style"}:
            return
        for _, slot in self.open:
            if slot is not None:
                self.blocks[slot].append(data)


def html_blocks(page: str, leaf_only: bool = False) -> tuple[str, list[str]]:
    parser = _Blocks()
    parser.feed(page or "")
    parser.close()
    texts = ["".join(b) for i, b in enumerate(parser.blocks) if not (leaf_only and i in parser.nested)]
    return parser.title or "", [t for t in texts if t.strip()]


def html_paragraphs(pages: DataFrame, id_col: str, html: str, leaf_only: bool = False) -> DataFrame:
    """``(id, title, pos, text)``: text of every non-empty p and div; nested divs repeat inner text unless ``leaf_only``."""
    kind = T.StructType([T.StructField("title", T.StringType()), T.StructField("texts", T.ArrayType(T.StringType()))])

    @F.pandas_udf(kind)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            found = [html_blocks(x, leaf_only) for x in s]
            yield pd.DataFrame({"title": [t for t, _ in found], "texts": [x for _, x in found]})

    made = pages.select(id_col, cut(html).alias("d"))
    rows = made.select(id_col, F.col("d.title").alias("title"), F.posexplode("d.texts").alias("pos", "text"))
    return rows.withColumn("text", clean_page_text(F.col("text")))


def clean_page_text(text: Column) -> Column:
    """One newline for many, no reading-list note, short dashes, trimmed."""
    one = F.replace(F.regexp_replace(text, r"\n+", "\n"), F.lit(READING_LIST_NOTE), F.lit(""))
    return strip(F.regexp_replace(one, r"-{6,}", "-----"))


def group_layout_pages(layouts: DataFrame, doc: str, order: str, page: str, content: str) -> DataFrame:
    """Consecutive layout rows of one page number become one record, in order."""
    runs = runs_by_order(layouts.select(doc, order, page, content), [doc], [order], page, "run")
    parts = F.array_sort(F.collect_list(F.struct(order, content)))  # the layout rows of one page
    return runs.groupBy(doc, "run", page).agg(F.transform(parts, lambda s: s[content]).alias("content"))


def plain_document(pages: DataFrame, doc: str, order: str, content: str) -> DataFrame:
    """All paragraphs of a document's pages as one text."""
    parts = F.array_sort(F.collect_list(F.struct(order, content)))  # the pages of one document
    return pages.groupBy(doc).agg(F.array_join(F.flatten(F.transform(parts, lambda s: s[content])), PARAGRAPH_BREAK).alias("text"))


def text_paragraphs(docs: DataFrame, doc: str, text: str, separator: str = "\n\n") -> DataFrame:
    return docs.select(doc, F.posexplode(F.split(text, "\\Q" + separator + "\\E")).alias("pos", "text"))


def profile_table(table: DataFrame, name: str, sample: int = 3, order: list[str] | None = None) -> DataFrame:
    """One row: column names, types, the row count and the first rows by ``order`` (default: all columns) as markdown lines."""
    cols = table.columns
    line = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    rows = table.orderBy(*(order or cols)).limit(sample).select(line.alias("l")).agg(F.collect_list("l").alias("rows"))  # at most ``sample`` rows
    count = table.agg(F.count(F.lit(1)).alias("num_rows"))
    types = [t for _, t in table.dtypes]
    return count.join(F.broadcast(rows), F.lit(True)).select(
        F.lit(name).alias("name"), F.array(*[F.lit(c) for c in cols]).alias("columns"), F.array(*[F.lit(t) for t in types]).alias("types"), "num_rows", "rows"
    )


def infer_types(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Narrowest of bigint, double, boolean, string that fits every row of text columns."""
    fits = lambda c, t: F.every(F.col(c).isNull() | F.expr(f"try_cast(`{c}` as {t}) is not null"))
    pick = lambda c: F.when(fits(c, "bigint"), "bigint").when(fits(c, "double"), "double").when(fits(c, "boolean"), "boolean").otherwise("string")
    made = rows.agg(*[pick(c).alias(c) for c in columns])
    return made.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("type")) for c in columns])).alias("t")).select("t.*")


def equal_token_budget(results: DataFrame, query: str, tokens: str, limit: int) -> DataFrame:
    """Cut each result of a query to floor(limit / number of its results) tokens.

    The number of results comes from an aggregation that is joined back, so a
    query with very many results is not gathered in one task.
    """
    counts = results.groupBy(query).agg(F.count(F.lit(1)).alias("__n"))
    return results.join(counts, query).withColumn(tokens, F.slice(tokens, F.lit(1), F.floor(F.lit(limit) / F.col("__n")).cast("int"))).drop("__n")


def truncate_head(tokens: Column, limit: int) -> Column:
    return F.slice(tokens, 1, limit)


def extract_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(" + URL + ")"), F.lit(1))


def extract_markdown_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MARKDOWN_URL), F.lit(1))


def extract_code(text: Column) -> Column:
    """The first fenced block, else the ``code`` field of a JSON text, else the text."""
    return F.coalesce(first_match(text, CODE_BLOCK), F.get_json_object(text, "$.code"), text)


def has_chinese(text: Column) -> Column:
    return text.rlike("[\\u4e00-\\u9fff]")


def search_locale(text: Column) -> Column:
    pick = lambda i: F.when(has_chinese(text), LOCALES[True][i]).otherwise(LOCALES[False][i])
    return F.struct(pick(0).alias("location"), pick(1).alias("gl"), pick(2).alias("hl"))


def contains_html(text: Column) -> Column:
    return text.rlike(HTML_TAG)


def url_basename(path: Column) -> Column:
    """Last path part of a path or URL, decoded; the host of a bare URL."""
    plain = F.when(path.rlike(r"^[A-Za-z]:\\"), F.translate(path, "\\", "/")).otherwise(path)
    no_host = F.regexp_replace(F.regexp_replace(plain, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    name = strip(F.try_url_decode(F.replace(F.regexp_extract(no_host, r"([^/]*)$", 1), F.lit("+"), F.lit("%2B"))))
    last = F.element_at(F.filter(F.transform(F.split(plain, "/"), strip), lambda x: x != ""), -1)
    return F.coalesce(F.nullif(name, F.lit("")), last)


def file_type(path: Column, content: Column | None = None) -> Column:
    """Type by extension; other URLs are html, other files html or txt by their tags."""
    name = F.lower(url_basename(path))
    ext = F.substring_index(name, ".", -1)
    is_image = F.lit(False)
    for e in IMAGE_TYPES:
        is_image = is_image | name.endswith(e)
    local = F.lit("unk") if content is None else F.when(content.isNull(), "unk").when(contains_html(content), "html").otherwise("txt")
    return F.when(is_image, "image").when(ext.isin(*FILE_TYPES), ext).when(path.rlike("^https?://"), "html").otherwise(local)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


TOOL_CALL = r"(?s)<tool_call>(.*?)</tool_call>"
ANSWER = r"(?s)<answer>(.*?)</answer>"


def parse_transcript(messages: DataFrame, text: str) -> DataFrame:
    """Add ``tool_calls`` (name, arguments, raw), ``answer`` and ``thinking`` (the rest)."""
    raw = F.transform(F.regexp_extract_all(F.col(text), F.lit(TOOL_CALL), F.lit(1)), strip)
    name = lambda c: F.coalesce(F.nullif(F.get_json_object(c, "$.name"), F.lit("")), F.lit("unknown"))
    args = lambda c: F.coalesce(F.get_json_object(c, "$.arguments"), F.lit("{}"))
    calls = F.transform(raw, lambda c: F.when(
        F.try_parse_json(c).isNotNull(), F.struct(name(c).alias("name"), args(c).alias("arguments"), c.alias("raw"))
    ).otherwise(F.struct(F.lit("unknown").alias("name"), F.lit("{}").alias("arguments"), c.alias("raw"))))
    answer = F.when(F.col(text).rlike(ANSWER), strip(F.regexp_extract(text, ANSWER, 1)))
    without = F.regexp_replace(text, TOOL_CALL, "")
    rest = F.concat(F.substring_index(without, "<answer>", 1), F.regexp_replace(F.regexp_extract(without, r"(?s)<answer>.*?</answer>(.*)$", 1), "^$", ""))
    thinking = F.nullif(strip(F.when(without.rlike(ANSWER), rest).otherwise(without)), F.lit(""))
    return messages.withColumns({"tool_calls": calls, "answer": answer, "thinking": thinking})


def termination_class(runs: DataFrame, max_calls: int, max_tokens: int) -> DataFrame:
    """How each run ended, from its last message, its calls and its tokens.

    runs: calls, tokens, last_text, forced_text (null if no final answer was forced).
    """
    whole = F.col("last_text").contains("<answer>") & F.col("last_text").contains("</answer>")
    forced = F.coalesce(F.col("forced_text").contains("<answer>"), F.lit(False))
    kind = (
        F.when((F.col("tokens") > max_tokens) & whole, "generate an answer as token limit reached")
        .when(F.col("tokens") > max_tokens, "format error: generate an answer as token limit reached")
        .when(F.col("last_text").contains("<answer>"), "answer")
        .when((F.col("calls") >= max_calls) & forced, "forced_answer")
        .when(F.col("calls") >= max_calls, "exceed available llm calls")
        .otherwise("answer not found")
    )
    return runs.withColumn("termination", kind)


def shard_worklist(items: DataFrame, order: str, total: int, shard: int) -> DataFrame:
    """The shard-th (from 1) contiguous slice of ceil(n / total) items."""
    ranked = rank_by_order(items, [], [order], rank="__r", total="__n")
    per = F.ceil(F.col("__n") / total)
    return ranked.filter((F.col("__r") > (shard - 1) * per) & (F.col("__r") <= shard * per)).drop("__r", "__n")


def hash_shard(key: Column, total: int) -> Column:
    """Shard number from 1 without any ordering."""
    return (F.pmod(F.xxhash64(key), F.lit(total)) + 1).cast("int")


def rollout_worklist(items: DataFrame, done: DataFrame, question: str, rollouts: int) -> DataFrame:
    """Items x rollouts without those whose question finished without an error."""
    todo = items.withColumn("rollout", F.explode(F.sequence(F.lit(1), F.lit(rollouts))))
    ok = done.filter(F.col("error").isNull()).select(strip(F.col(question)).alias("__q"), "rollout").distinct()
    return todo.withColumn("__q", strip(F.col(question))).filter("__q <> ''").join(ok, ["__q", "rollout"], "left_anti").drop("__q")


def rollout_errors(results: DataFrame) -> DataFrame:
    """Done, failed and timed-out runs per rollout."""
    late = F.coalesce(F.lower("error").contains("timeout"), F.lit(False))
    return results.groupBy("rollout").agg(
        F.count_if(F.col("error").isNull()).alias("done"), F.count_if(F.col("error").isNotNull() & ~late).alias("failed"), F.count_if(late).alias("timeout")
    )


SEARCH_SCHEMA = "organic array<struct<title string, link string, date string, source string, snippet string>>"


def parse_search_results(rows: DataFrame, query: str, body: str) -> DataFrame:
    """Stored result JSON to numbered snippets and the rendered text per query."""
    found = F.from_json(body, SEARCH_SCHEMA)["organic"]
    part = lambda head, c: F.when(c.isNotNull(), F.concat(F.lit(head), c)).otherwise("")
    line = lambda p, i: F.replace(F.concat(
        (i + 1).cast("string"), F.lit(". ["), p["title"], F.lit("]("), p["link"], F.lit(")"),
        part("\nDate published: ", p["date"]), part("\nSource: ", p["source"]), F.lit("\n"), part("\n", p["snippet"]),
    ), F.lit(VIDEO_NOTE), F.lit(""))
    made = rows.withColumn("__f", found).withColumn("snippets", F.transform("__f", line))
    head = F.format_string("A Google search for '%s' found %d results:\n\n## Web Results\n", F.col(query), F.size("snippets"))
    none = F.format_string("No results found for '%s'. Try with a more general query.", F.col(query))
    return made.withColumn("rendered", F.when(F.col("__f").isNull(), none).otherwise(F.concat(head, F.array_join("snippets", "\n\n")))).drop("__f")
