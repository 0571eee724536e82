"""Entities and edges: upserts, neighbours, path questions, merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.book_rules import DEFAULT_CATEGORY, QUESTION_WORDS, TYPE_MAP
from ..functions.names import lookup
from ..functions.ordering import rank_by_order
from ..session import materialise

EDGE = ["head", "relation", "tail"]
SIDES = ["head", "tail"]


def edge_ends(edges: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Both ends of every edge from one scan: ``(keep, name, cate, etype, line_no, side)``."""
    ends = [
        F.struct(
            F.col(s).alias("name"), F.col(f"{s}_cate").alias("cate"), F.col(f"{s}_type").alias("etype"), F.lit(i).alias("side")
        )
        for i, s in enumerate(SIDES)
    ]
    return edges.select(*keep, "line_no", F.explode(F.array(*ends)).alias("e")).select(*keep, "line_no", "e.*")


def upsert_entities(edges: DataFrame, key: str | None = None) -> DataFrame:
    """One vertex per name, or per (name, ``key``); the last line wins.

    ``key`` may be a column such as the book, or 'label' for one vertex per name
    and type label.
    """
    keep = [key] if key and key != "label" else []
    ends = edge_ends(edges, keep).withColumn("label", lookup(TYPE_MAP, F.col("etype"), F.lit("Entity")))
    keys = ["name", *([key] if key else [])]
    rest = [c for c in ("cate", "etype", "label") if c not in keys]
    last = ends.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("line_no", "side")).alias("v"))
    return last.select(*keys, "v.*")


def upsert_edges(edges: DataFrame, book: str | None = None) -> DataFrame:
    """One edge per (head, relation, tail[, book])."""
    return edges.select(*EDGE, *([book] if book else [])).distinct()


#: The characters that a partition folder's name holds escaped.
UNSAFE = "\"#%'*/:=?\\\x7f{[]^"


def replace_book(edges: DataFrame, path: str, book: str) -> None:
    """Overwrite one book's partition folder only; an empty slice empties it."""
    folder = "".join(f"%{ord(c):02X}" if c in UNSAFE or ord(c) < 32 else c for c in book)
    edges.drop("book").write.mode("overwrite").parquet(f"{path}/book={folder}")


def neighbors(edges: DataFrame, name: str | None, book: str | None = None, sample: int = 10) -> DataFrame:
    """Edges into the name, then edges out of it; a self-loop appears twice."""
    if book is not None:
        edges = edges.filter(F.col("book") == book)
    if not name or not name.strip():
        return edges.orderBy(*edges.columns).limit(sample).withColumn("direction", F.lit("sample"))
    into = edges.filter(F.col("tail") == name).withColumn("direction", F.lit("in"))
    return into.unionByName(edges.filter(F.col("head") == name).withColumn("direction", F.lit("out")))


def graph_payload(edges: DataFrame, categories: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes numbered from 0 by name with a category index, and links by node number."""
    ends = edge_ends(edges)
    nodes = ends.groupBy("name").agg(F.max_by("cate", F.struct("line_no", "side")).alias("cate"))
    index = {c: i for i, c in enumerate(categories)}
    other = index.get(DEFAULT_CATEGORY, 0)
    numbered = rank_by_order(nodes, [], ["name"], rank="__r").select(
        (F.col("__r") - 1).alias("id"), "name", lookup(index, F.col("cate"), F.lit(other)).alias("category")
    )
    numbered = materialise(numbered, "nodes")
    a = numbered.select(F.col("name").alias("head"), F.col("id").alias("source"))
    b = numbered.select(F.col("name").alias("tail"), F.col("id").alias("target"))
    links = edges.join(a, "head").join(b, "tail").select("source", "target", F.col("relation").alias("value"))
    return numbered, links


def follow_relations(edges: DataFrame, starts: DataFrame, steps: DataFrame, hops: int, mode: str = "all") -> DataFrame:
    """Walk x -[relation]-> current hop by hop for many questions at once.

    starts ``(qid, name)``, steps ``(qid, hop, relation)`` with hops from 1.  A hop
    without a match is skipped.  ``mode='last'`` goes on from the last matched edge
    only; ``'all'`` keeps the whole frontier.  Returns ``(qid, name, hop)`` of the
    last hop that matched.
    """
    frontier = starts.select("qid", "name", F.lit(0).alias("hop"))
    links = edges.select(F.col("head").alias("next"), "relation", F.col("tail").alias("name"), "line_no")
    for i in range(1, hops + 1):
        wanted = steps.filter(F.col("hop") == i).select("qid", "relation")
        found = frontier.select("qid", "name").join(wanted, "qid").join(links, ["name", "relation"])
        if mode == "last":
            moved = found.groupBy("qid").agg(F.max_by("next", "line_no").alias("name"))
        else:
            moved = found.select("qid", F.col("next").alias("name")).distinct()
        moved = materialise(moved.withColumn("hop", F.lit(i)), "hop")
        stuck = frontier.join(moved.select("qid").distinct(), "qid", "left_anti")
        frontier = materialise(moved.unionByName(stuck), "frontier")
    return frontier


def bidirectional_lookup(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """Edges of the asked (qid, name, relation) into the name, then out of it."""
    e = edges.select(*EDGE, "line_no")
    into = e.join(asked.withColumnRenamed("name", "tail"), ["tail", "relation"]).select("qid", *EDGE, "line_no", F.lit(0).alias("direction"))
    out = e.join(asked.withColumnRenamed("name", "head"), ["head", "relation"]).select("qid", *EDGE, "line_no", F.lit(1).alias("direction"))
    return into.unionByName(out)


def first_answer(found: DataFrame) -> DataFrame:
    """The other end of the first edge by (direction, order) per question."""
    other = F.when(F.col("direction") == 0, F.col("head")).otherwise(F.col("tail"))
    return found.groupBy("qid").agg(F.min_by(other, F.struct("direction", "line_no")).alias("answer"))


def link_subject(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """``(qid, subject)``: the longest entity name inside each question, ties by name.

    Substrings of the name lengths that occur are joined with the names, so the
    work grows with the text and not with questions x entities.
    """
    names = entities.select(F.col("name").alias("subject")).filter("subject <> ''").distinct()
    lengths = [r[0] for r in names.select(F.length("subject").alias("n")).distinct().collect()]  # at most one per name length
    if not lengths:
        return questions.select("qid", F.lit(None).cast("string").alias("subject")).limit(0)
    at = questions.select("qid", "question", F.explode(F.array(*[F.lit(n) for n in sorted(lengths)])).alias("n"))
    at = at.filter(F.length("question") >= F.col("n"))
    starts = at.select("qid", "question", "n", F.explode(F.sequence(F.lit(1), F.length("question") - F.col("n") + 1)).alias("i"))
    parts = starts.select("qid", F.substr("question", F.col("i"), F.col("n")).alias("subject")).distinct()
    hit = parts.join(names, "subject")
    return hit.groupBy("qid").agg(F.min_by("subject", F.struct(-F.length("subject"), F.col("subject"))).alias("subject"))


def extract_relations(questions: DataFrame, words: dict[str, str] = QUESTION_WORDS) -> DataFrame:
    """``(qid, hop, word, relation)``: relation words of a question by first position."""
    found = [
        F.when(F.instr("question", w) > 0, F.struct(F.instr("question", w).alias("pos"), F.lit(i).alias("i"), F.lit(w).alias("word"), F.lit(r).alias("relation")))
        for i, (w, r) in enumerate(words.items())
    ]
    listed = F.array_sort(F.array_compact(F.array(*found)))
    return questions.select("qid", F.posexplode(listed).alias("k", "s")).select("qid", (F.col("k") + 1).alias("hop"), "s.word", "s.relation")


def answer_questions(questions: DataFrame, edges: DataFrame, words: dict[str, str] = QUESTION_WORDS, mode: str = "all") -> DataFrame:
    """``(qid, subject, answer)``; unanswerable questions keep a null answer.

    Questions with the same subject and the same relations are one walk.
    """
    ends = edge_ends(edges).select("name").distinct()
    subjects = link_subject(questions, ends)
    found = extract_relations(questions, words)
    paths = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("hop", "relation"))).alias("path"))  # one question's words
    asked = materialise(subjects.join(paths, "qid", "left"), "asked")
    walks = asked.filter("path is not null").select("subject", "path").distinct()
    walks = materialise(walks.withColumn("qid", F.struct("subject", F.to_json("path").alias("steps"))), "walks")
    steps = walks.select("qid", F.explode("path").alias("s")).select("qid", "s.hop", "s.relation")
    hops = steps.agg(F.max("hop")).first()[0] or 0  # at most the number of relation words
    reached = follow_relations(edges, walks.select("qid", F.col("subject").alias("name")), steps, hops, mode)
    answers = reached.filter("hop > 0").groupBy("qid").agg(F.min("name").alias("answer"))
    by_walk = walks.join(answers, "qid").select("subject", "path", "answer")
    done = asked.join(by_walk, ["subject", "path"], "left").select("qid", "subject", "answer")
    return questions.select("qid").join(done, "qid", "left")


MERGE_KEY = ["head", "relation", "tail", "head_type", "tail_type"]


def merge_new_relations(base: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All base rows plus the first new row per unseen key, and the counts of both."""
    unseen = new.join(base.select(*MERGE_KEY).distinct(), MERGE_KEY, "left_anti")
    rest = [c for c in new.columns if c not in MERGE_KEY]
    first = unseen.groupBy(*MERGE_KEY).agg(F.min_by(F.struct(*rest), "line_no").alias("r")).select(*MERGE_KEY, "r.*")
    merged = base.select(*new.columns).withColumn("origin", F.lit("base")).unionByName(first.select(*new.columns).withColumn("origin", F.lit("new")))
    counts = merged.groupBy("origin").agg(F.count(F.lit(1)).alias("rows"))
    return merged, counts


def triple_summary(edges: DataFrame, default: str = DEFAULT_CATEGORY) -> DataFrame:
    """Rows, entities, relations and shares of the default category."""
    n = F.count(F.lit(1))
    base = edges.agg(
        n.alias("rows"), F.countDistinct("relation").alias("relations"),
        (F.count_if(F.col("head_cate") == default) / n).alias("head_default_share"),
        (F.count_if(F.col("tail_cate") == default) / n).alias("tail_default_share"),
    )
    names = edge_ends(edges).agg(F.countDistinct("name").alias("entities"))  # both sides are one row
    return base.join(F.broadcast(names), F.lit(True))


def top_relations(edges: DataFrame, k: int = 10) -> DataFrame:
    return edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "relation").limit(k)
