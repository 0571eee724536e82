"""Column expressions that clean entity names, relations, types and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .book_rules import DEFAULT_CATEGORY, DEFAULT_TYPE, JOURNEY, BookRules
from .replies import strip

# fixed values: one wrapping pair of these is taken off
PAIRS = ("“”", '""', "''", "《》", "「」", "『』", "()", "（）", "[]", "【】")
RELATION_PUNCTUATION = "[，,。：:]"
ASPECT_TAIL = "(了|着|过|起来|下去|出来|回去|进去)$"
EDGE_PUNCTUATION = r"^[，。！？；:：、】【\-]+|[，。！？；:：、】【\-]+$"
RELATION_LIMIT = 12
NAME_LIMIT = 40


def lookup(table: dict, key: Column, default: Column | None = None) -> Column:
    """Value of a small fixed table, else the default or the key itself."""
    default = key if default is None else default
    if not table:
        return default
    items = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*items), key), default)


_WRAPPED = "(?s)^(?:" + "|".join(f"\\Q{l}\\E(.*)\\Q{r}\\E" for l, r in PAIRS) + ")$"
_INSIDE = "".join(f"${i + 1}" for i in range(len(PAIRS)))


def clean_text(text: Column) -> Column:
    """Plain spaces, one wrapping pair off, no control characters, single spaces."""
    s = strip(F.translate(F.coalesce(text, F.lit("")), "\u00a0\u3000", "  "))
    inner = strip(F.regexp_replace(s, _WRAPPED, _INSIDE))
    return strip(F.regexp_replace(F.regexp_replace(inner, r"[\x00-\x1f]", ""), r"(?U)\s+", " "))


def step(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Set columns behind a one-row generator.

    Later expressions and filters read the finished values; the optimizer cannot
    copy these expressions into them, which would multiply the work.
    """
    keep = [c for c in df.columns if c not in columns]
    made = F.struct(*[v.alias(k) for k, v in columns.items()])
    return df.select(*keep, F.explode(F.array(made)).alias("__step")).select(*keep, "__step.*")


def bare_relation(rel: Column) -> Column:
    """A cleaned relation without punctuation."""
    return strip(F.regexp_replace(rel, RELATION_PUNCTUATION, ""))


def normalize_relation(rel: Column, rules: BookRules = JOURNEY) -> Column:
    """Short standard relation word of a bare relation, '' for one that says nothing."""
    s = F.left(strip(F.regexp_replace(rel, ASPECT_TAIL, "")), F.lit(RELATION_LIMIT))
    empty = (F.length(s) < 2) | s.isin(*rules.stop_relations)
    return F.when(empty, "").otherwise(lookup(rules.relation_synonyms, s))


def names_of(name: Column, rules: BookRules = JOURNEY) -> Column:
    """The name and its aliases, the longest first."""
    by_main: dict[str, list[str]] = {}
    for alias, main in rules.aliases.items():
        by_main.setdefault(main, [main]).append(alias)
    sorted_names = {main: sorted(al, key=len, reverse=True) for main, al in by_main.items()}
    alone = F.filter(F.array(name), lambda x: x != "")
    if not sorted_names:
        return alone
    items = [x for main, al in sorted_names.items() for x in (F.lit(main), F.array(*[F.lit(a) for a in al]))]
    return F.coalesce(F.try_element_at(F.create_map(*items), name), alone)


def with_open_relation(df: DataFrame, relation: str, head: str, tail: str, out: str, rules: BookRules = JOURNEY) -> DataFrame:
    """Add ``out``: the relation without the names of its head and tail; '' if nothing is left or a name remains.

    The three columns must be cleaned already.
    """
    ready = step(df, {"__names": F.concat(names_of(F.col(head), rules), names_of(F.col(tail), rules)), "__bare": bare_relation(F.col(relation))})
    names = F.col("__names")
    cut = F.aggregate(names, F.col("__bare"), lambda acc, n: F.replace(acc, n, F.lit("")))
    ready = step(ready, {"__bare": bare_relation(strip(F.regexp_replace(cut, EDGE_PUNCTUATION, "")))})
    ready = step(ready, {"__bare": normalize_relation(F.col("__bare"), rules)})
    named = F.exists(names, lambda n: F.contains(F.col("__bare"), n))
    return step(ready, {out: F.when(named, "").otherwise(F.col("__bare"))}).drop("__names", "__bare")


def normalize_entity(name: Column, rules: BookRules = JOURNEY) -> Column:
    """Main name of a cleaned name."""
    return lookup(rules.aliases, name)


def normalize_type(kind: Column, rules: BookRules = JOURNEY) -> Column:
    return lookup(rules.types, kind, F.lit(DEFAULT_TYPE))


def normalize_category(cate: Column, rules: BookRules = JOURNEY) -> Column:
    return F.when(cate.isin(*rules.categories), cate).otherwise(DEFAULT_CATEGORY)


def infer_category(name: Column, kind: Column, rules: BookRules = JOURNEY) -> Column:
    """Category of a cleaned name and canonical type: known entities, then the keyword rules in order."""
    chain = F.when(name == "", DEFAULT_CATEGORY)
    for category, need, pattern in rules.category_rules:
        hit = name.rlike(pattern)
        chain = chain.when(hit if need is None else hit & (kind == need), category)
    return lookup(rules.fixed_category, name, chain.otherwise(DEFAULT_CATEGORY))


def is_non_entity(name: Column, rules: BookRules = JOURNEY) -> Column:
    """A cleaned name that is empty, too long, digits only, symbols only, or a generic title."""
    return (
        (name == "") | (F.length(name) > NAME_LIMIT) | name.rlike("^[0-9]+$") | name.rlike(r"(?U)^[\W_]+$") | name.isin(*rules.generic_titles)
    )


def guess_type(name: Column, rules: BookRules = JOURNEY) -> Column:
    """Type a name looks like, null if none."""
    chain = None
    for kind, pattern in rules.type_looks:
        hit = name.rlike(pattern)
        chain = F.when(hit, kind) if chain is None else chain.when(hit, kind)
    return chain
