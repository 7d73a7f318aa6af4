"""Quality rules with built-in functions only: base counts, and a hashed n-gram likelihood ratio.

Words and word pairs are hashed into buckets. One multinomial is estimated from a trusted target (rows labelled of
good quality, a bounded sample of them), another from the whole corpus. A document's verdict is its log-likelihood
ratio of target to corpus, divided by its number of n-grams, against a fixed threshold.

Null and empty texts have no words and fail the base rules. Without any trusted row the ratio is 0. Repeated rows
are judged alike.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import table

#: A power of two.
BUCKETS = 4096
#: Labelled rows in the trusted target, pseudo-count of a bucket, and the least ratio per n-gram of a kept document.
MAX_TARGET, PSEUDO, THRESHOLD = 20_000, 1.0, -0.08
WINDOW, MIN_WORDS, REPEAT_PERCENT = 5, 10, 20

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """Texts whose only white space is blanks and newlines, nearly all, are split at a single character, which needs no regular expression."""
    plain = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")
    some = F.when(text.rlike(r"[\x09\x0B-\x0D]"), F.split(text, r"[\x20\x09-\x0D]+")).otherwise(plain)
    return F.array_remove(F.coalesce(some, F.array().cast("array<string>")), "")


def with_hashes(df: DataFrame) -> DataFrame:
    """Adds _w, the words, _h, their 64-bit hashes, and _q, those of neighbouring pairs."""
    df = df.withColumn("_w", words(F.col("text"))).withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    return df.withColumn("_q", F.expr("zip_with(slice(_h, 1, greatest(size(_h) - 1, 0)), slice(_h, 2, greatest(size(_h) - 1, 0)), (x, y) -> xxhash64(x, y))"))


def bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def without(text: Column, characters: str) -> Column:
    """The text without the given ASCII characters. Plain replacement skips a text that has none of them."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def multinomials(documents: DataFrame, labels: DataFrame, max_target: int = MAX_TARGET) -> list[float]:
    """Log ratio of target to corpus probability of each bucket; BUCKETS numbers whatever the corpus."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target).withColumn("_good", F.lit(1))
    rows = with_hashes(documents.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left").select("text", F.coalesce("_good", F.lit(0)).alias("_good")))
    hashed = rows.select("_good", F.explode(F.concat("_h", "_q")).alias("h")).select("_good", bucket(F.col("h")).alias("b"))
    n, t = [0] * BUCKETS, [0] * BUCKETS
    for r in hashed.groupBy("b").agg(F.count("*").alias("n"), F.sum("_good").alias("t")).collect():  # BUCKETS rows at most
        n[r["b"]], t[r["b"]] = r["n"], r["t"]
    if not sum(t):
        return [0.0] * BUCKETS
    total, target = sum(n) + PSEUDO * BUCKETS, sum(t) + PSEUDO * BUCKETS
    return [log((b + PSEUDO) / target) - log((a + PSEUDO) / total) for a, b in zip(n, t)]


def base_counts(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to a table with_hashes().

    Equal windows have equal 64-bit hashes, so texts whose window hashes are all distinct are done. In the others the
    places of windows are sorted by hash, hash and place packed into one long, and neighbours are compared.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_g", F.expr(f"case when size(_h) < {WINDOW} then array() else transform(sequence(0, size(_h) - {WINDOW}), i -> xxhash64(_q[i], _q[i + 2], _h[i + 4])) end"))
    df = df.withColumn("_twice", F.expr(f"size(array_distinct(_g)) < size(_h) - {WINDOW - 1}"))
    df = df.withColumn("_s", F.expr("case when _twice and size(_g) <= 1048576 then sort_array(transform(_g, (x, i) -> (x & -1048576L) | i)) end"))
    packed = "_g[cast(v & 1048575L as int)] = get(_g, cast(get(_s, i {0} 1) & 1048575L as int))"
    df = df.withColumn("_z", F.expr("case when _twice and _s is null then sort_array(transform(_g, (x, i) -> struct(x as g, i as p))) end"))  # over a million windows
    df = df.withColumn("_p", F.expr(f"""sort_array(filter(case
        when _s is not null then transform(_s, (v, i) -> case when {packed.format('+')} or (i > 0 and {packed.format('-')}) then cast(v & 1048575L as int) end)
        when _z is not null then transform(_z, (v, i) -> case when v.g = get(_z, i + 1).g or (i > 0 and v.g = get(_z, i - 1).g) then v.p end) end, p -> p is not null))"""))
    covered = F.expr(f"case when _twice and size(_p) > 0 then aggregate(sequence(0, size(_p) - 1), 0L, (a, i) -> a + case when i = size(_p) - 1 then {WINDOW} else least({WINDOW}, _p[i + 1] - _p[i]) end) else 0L end")
    return df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.when(text.rlike("[#*$%&|<>]"), F.octet_length(text) - F.octet_length(without(text, SYMBOLS))).otherwise(0).cast("long"),
        "_l": lines,
        "n_repeat_words": covered,
    }).withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))


def judge(documents: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base counts, base_failed, llr (per n-gram) and kept of every row."""
    model = F.expr(f"cast(split('{','.join(map(repr, ratios))}', ',') as array<double>)")  # folded into one literal
    df = base_counts(with_hashes(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, h: a + F.get(model, bucket(h)))
    df = df.withColumn("llr", F.when(F.size("_h") > 0, (total("_h") + total("_q")) / (F.size("_h") + F.size("_q"))).otherwise(0.0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("llr") >= threshold)).alias("kept"), "llr")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, multinomials(docs, table(spark, sf_dir, "labels")))
