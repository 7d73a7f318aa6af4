"""Filter interaction audit: what each of five filters removes, repeats or alone decides, in every order of application.

A relational word pipeline: words are exploded, aggregated by (document, word) and then by document for totals and
distinct words; the other flags are joined to them from outside, and one aggregation by part makes 32 conditional
counts (one for each set of failed filters) of all, of good and of toxic documents. Every order and step is a sum over
those counts, so orders cost nothing that grows with the corpus.

A document is known by a number of its row, by which whole texts are dealt out once; explosion and both word
aggregations then work in place, without another shuffle. `documents` should be a table: numbers come from the places
of its rows in its files, which a task that runs again finds unchanged.

Null texts count as empty: they fail A (no words) and no other filter but E. Repeated rows are documents of their own; a
row with the same doc_id is none with a smaller one. Rows without doc_id have no smaller id, are no smaller id, and have
no labels. Of several labels of one doc_id the greatest counts. Very long texts are exploded like others. Tied ids do
not fail E. Empty tables give no rows, and columns besides doc_id, text and source are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import join_classes, saved, table

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
SPACES, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"


def word_totals(rows: DataFrame) -> DataFrame:
    """rows: mark, text (not null). mark, n_words and n_distinct of every row that has a word."""
    words = rows.select("mark", F.explode(F.split("text", SPACES)).alias("word")).where("word <> ''")
    by_word = words.groupBy("mark", "word").agg(F.count("*").alias("n"))
    return by_word.groupBy("mark").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def failures(documents: DataFrame) -> DataFrame:
    """doc_id, part and `mask` of every row: bit i is set where filter i of FILTERS fails."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.monotonically_increasing_id().alias("mark"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    dealt = rows.repartition("mark")
    capitals = F.regexp_count("text", F.lit("[A-Z]"))
    looks = dealt.select("mark", "doc_id", "part", F.sha2("text", 256).alias("same"), (100 * capitals > CAPITAL_PERCENT * F.length("text")).alias("c"), F.col("text").rlike(SYMBOLS).alias("d"))
    both = looks.join(word_totals(dealt), "mark", "left").fillna(0, ["n_words", "n_distinct"])
    a, b = F.col("n_words") < MIN_WORDS, 100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col("n_words")
    bits = reduce(Column.__add__, [F.when(x, 1 << i).otherwise(0) for i, x in enumerate((a, b, F.col("c"), F.col("d")))])
    own = saved(both.select("doc_id", "part", "same", bits.alias("mask")), "filters")
    first = own.groupBy("same").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    again = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return join_classes(own, first, "same").select("doc_id", "part", (F.col("mask") + F.when(again, 1 << 4).otherwise(0)).alias("mask"))


def interactions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part with the arrays n, good and toxic of MASKS counts each."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    found = failures(documents)
    # rows without an id meet no label and need not meet in one task
    labelled = found.where("doc_id IS NOT NULL").join(marks, F.col("doc_id") == F.col("l_id"), "left").select("part", "mask", F.col("quality").eqNullSafe(1).alias("good"), F.col("toxic").eqNullSafe(1).alias("bad"))
    labelled = labelled.unionByName(found.where("doc_id IS NULL").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("bad")))
    kinds = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("bad")}
    counts = labelled.groupBy("part").agg(*[F.count_if((F.col("mask") == m) & x).alias(f"{k}_{m}") for k, x in kinds.items() for m in range(MASKS)])
    return counts.select("part", *[F.array(*[f"{k}_{m}" for m in range(MASKS)]).alias(k) for k in kinds])


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(F.struct(F.lit("".join(FILTERS[i] for i in order)).alias("filter_order"), F.lit(step).alias("step"), F.lit(1 << f).alias("bit"), F.lit(before).alias("before")))
            before |= 1 << f
    each = interactions(documents, labels).select("*", F.explode(F.array(*steps)).alias("_")).select("part", "n", "good", "toxic", "_.*")

    def total(column: str, take, weigh=None) -> Column:
        """Sum over the masks that `take` accepts, weighed."""
        one = lambda c, m: F.when(take(m), c * weigh(m) if weigh else c).otherwise(0)
        return F.aggregate(F.transform(column, one), F.lit(0).cast("long"), lambda s, x: s + x)

    bit, before = F.col("bit"), F.col("before")
    fails = lambda m: m.bitwiseAND(bit) != 0
    gone = lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~gone(m)
    orders = len(list(permutations(FILTERS)))
    return each.select(
        "part", "filter_order", "step", total("n", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"), total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"), total("n", lambda m: m == bit).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        # a document that fails k filters goes by each of them in one order of k
        total("n", fails, lambda m: (F.lit(orders) / F.bit_count(m)).cast("long")).alias("shapley"),
    )


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
