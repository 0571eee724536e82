"""Only phrases of lengths that a table has are made, once per sentence row."""

import random

from tallyloom.operators import ngram_filter as nf


def test_phrases_of_the_lengths_of_the_table(spark):
    draw = random.Random(7)
    word = lambda: draw.choice("abcd")
    sents = [(i % 12, [word() for _ in range(i % 9)]) for i in range(40)] + [(90, None)]
    table = [(" ".join(word() for _ in range(n)), f"t{n} u{k}") for k, n in enumerate((2, 2, 5, 2, 8, 5, 2))]
    df = spark.createDataFrame(sents, "sent_id int, tokens array<string>")
    made = nf.phrase_table_vocab(df, spark.createDataFrame(table, "source string, target string"))
    want = {(s, w) for s, ts in sents for w in ts or []}
    for s, ts in sents:
        runs = {" ".join(ts[i:i + n]) for n in range(1, 8) for i in range(len(ts) - n + 1)} if ts else set()
        want |= {(s, w) for source, target in table if source in runs for w in target.split()}
    assert {tuple(r) for r in made.collect()} == want and made.count() == len(want)
    plan = nf.phrase_table_vocab(df, spark.createDataFrame(table, "source string, target string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "least(7" not in plan and plan.count("Aggregate") == 1  # before: runs of all seven lengths, made distinct by a shuffle of their own
