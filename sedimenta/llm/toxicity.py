"""Toxicity by a weighted lexicon that an Aho-Corasick automaton finds in folded text.

Folding lower-cases, maps look-alike letters to Latin ones, and reads digits and symbols inside words as
letters. Lexicon entries start at a word's start; an entry may be a whole word or a word's beginning. Phrases
that turn an entry harmless, learned around whole words and beginnings alike, cancel that entry's weight. The weight found is normalised by the text's length, and a
logistic curve fitted to the labelled training rows turns it into a score.

Null and empty texts have no hits and get the score of a text without hits; repeated rows are scored alike. A null id
is scored and teaches nothing. Very long texts are scanned whole. Ties among entries and phrases go by spelling. Empty
tables give no rows, and without labels of both kinds every text gets the labels' rate. Other columns are carried along.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import bounded_labels, dropped, hold_out, map_rows, saved, table, trimmed

FOLDS = 5
#: Bounds of the fitted model: labelled rows looked at, and lexicon entries.
MAX_TRAIN, MAX_TERMS, MAX_PHRASES = 12_000, 2_000, 500
MIN_DF, PREFIXES = 5, (4, 5, 6, 8)

# Look-alike letters of other scripts, and digits and symbols read as letters.
LOOK_ALIKES = "а a е e о o р p с c х x у y і i ј j ѕ s к k м m т t н h в b α a ο o ρ p ν v ι i κ k τ t υ u ε e ⅰ i ɑ a ɡ g ｏ o ａ a ｅ e ｉ i"
DIGITS = "0 o 1 i 3 e 4 a 5 s 7 t 8 b @ a $ s ! i"

GLYPHS = {ord(a): b for a, b in zip(LOOK_ALIKES.split()[::2], LOOK_ALIKES.split()[1::2])}
LEET = {ord(a): b for a, b in zip(DIGITS.split()[::2], DIGITS.split()[1::2])}
MIXED = re.compile(r"(?<![a-z0-9@$!])[a-z]*[0-9@$!][a-z0-9@$!]*")  # no two parts can take the same character, so it is linear
LETTERS = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Same length as the lower-cased text; numbers without letters stay as they are."""
    t = text.lower()
    if not t.isascii():
        t = t.translate(GLYPHS)

    def read(m: re.Match) -> str:
        w = m[0].rstrip("@$!")  # what ends a word is punctuation
        letters = sum("a" <= c <= "z" for c in w)
        return w.translate(LEET) + m[0][len(w) :] if letters >= 2 else m[0]

    return MIXED.sub(read, t)


def _terms(words: list[str]) -> set[str]:
    out = set()
    for w in words:
        out.add(f"{w}$")
        for n in PREFIXES:
            if len(w) > n:
                out.add(w[:n])
    return out


def learn_lexicon(sample: DataFrame, max_terms: int = MAX_TERMS, min_df: int = MIN_DF) -> dict:
    """sample: (text, label). Weights are log odds of document frequencies; whole words end in `$`."""

    def count():
        def f(row):
            words = LETTERS.findall(fold(row["text"] or ""))
            return [{"term": t, "label": row["label"]} for t in _terms(words)]

        return f

    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return {}
    min_df = max(min_df, n1 // 200)
    odds = F.log((F.col("d1") + 0.5) / (n1 + 1.0)) - F.log((F.col("d0") + 0.5) / (n0 + 1.0))
    rows = map_rows(sample, count, "term string, label int", rows=20_000).groupBy("term").agg(F.sum("label").alias("d1"), F.sum(1 - F.col("label")).alias("d0")).where(F.col("d1") >= min_df).withColumn("w", odds).where("w > 2").orderBy(F.desc(F.col("w") * F.log("d1")), "term").limit(max_terms).collect()
    found = {r["term"]: (r["w"], r["d1"]) for r in rows}
    kept: dict[str, float] = {}
    for term in sorted(found, key=lambda t: (len(t), t)):  # the shortest beginning that is nearly as telling stands for its longer forms
        shorter = [term[:n] for n in PREFIXES if len(term.rstrip("$")) > n and term[:n] in kept]
        if not any(kept[s] >= found[term][0] - 1.5 for s in shorter):
            kept[term] = found[term][0]
    return kept


def automaton(lexicon: dict[str, float], exceptions: dict[str, list[str]] | None = None):
    """exceptions: folded phrase -> the entries that it makes harmless."""
    import ahocorasick

    auto, at = ahocorasick.Automaton(), defaultdict(list)
    for term, w in lexicon.items():
        at[term.rstrip("$")].append((len(term.rstrip("$")), term.endswith("$"), w, term, False))
    for phrase, terms in (exceptions or {}).items():
        at[phrase] += [(len(phrase), True, 0.0, term, True) for term in terms]
    for key, entries in at.items():  # a word and a beginning may be spelled alike
        auto.add_word(key, entries)
    if len(auto):
        auto.make_automaton()
    return auto


def measure(auto, text: str | None) -> tuple[float, int, int]:
    """Weight of the entries found, their number, and the number of words. Of overlapping entries of a word, the heaviest
    counts. An exception phrase excuses its own entry where that stands inside it."""
    if not text:
        return 0.0, 0, 0
    t = fold(text)
    n_words, hits, exempt = t.count(" ") + t.count("\n") + 1, defaultdict(list), []
    if len(auto):
        size = len(t)
        for end, entries in auto.iter(t):
            for n, whole, w, term, excused in entries:
                start = end - n + 1
                if start and t[start - 1].isalpha() or whole and end + 1 < size and t[end + 1].isalpha():
                    continue
                if excused:
                    exempt.append((start, end, term))
                else:
                    hits[start].append((w, term))
    starts = sorted(hits) if exempt else []
    for a, b, term in exempt:  # each looks at what starts inside it only
        for s in starts[bisect_left(starts, a) : bisect_right(starts, b)]:
            hits[s] = [h for h in hits[s] if h[1] != term]
    weights = [max(h)[0] for h in hits.values() if h]
    return sum(weights), len(weights), n_words


def learn_exceptions(sample: DataFrame, lexicon: dict[str, float], limit: int = MAX_PHRASES, min_df: int = MIN_DF) -> dict[str, list[str]]:
    """Two-word phrases around an entry that occur in harmless rows at least min_df times and in none that is labelled toxic."""

    def entries(word: str) -> list[str]:
        return [t for t in (f"{word}$", *(word[:n] for n in PREFIXES if len(word) >= n)) if t in lexicon]

    def pairs():
        def f(row):
            got, toks = set(), LETTERS.findall(fold(row["text"] or ""))
            found = [entries(w) for w in toks]
            for k in range(len(toks) - 1):
                got.update((f"{toks[k]} {toks[k + 1]}", t) for t in (*found[k], *found[k + 1]))
            return [{"phrase": p, "term": t, "label": row["label"]} for p, t in got]

        return f

    rows = map_rows(sample, pairs, "phrase string, term string, label int", rows=20_000).groupBy("phrase", "term").agg(F.sum("label").alias("d1"), F.count("*").alias("d")).where((F.col("d1") == 0) & (F.col("d") >= min_df)).orderBy(F.desc("d"), "phrase", "term").limit(limit).collect()
    out: dict[str, list[str]] = defaultdict(list)
    for r in rows:
        out[r["phrase"]].append(r["term"])
    return dict(out)


def _features(weight: float, hits: int, n_words: int) -> list[float]:
    return [1.0, math.log1p(weight), math.log1p(100.0 * weight / (n_words + 10.0)), math.log1p(n_words), math.log1p(hits)]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> list[float]:
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in b]


def fit(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> dict:
    """Learns entries, exception phrases and the curve from at most max_train labelled training rows."""
    chosen = bounded_labels(labels, "toxic", max_train, FOLDS)
    # an id may stand on any number of rows; one of them, by the hash of its text, is looked at
    labelled = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = saved(labelled.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label")).drop("doc_id"), "toxic-sample")
    lexicon = learn_lexicon(sample)
    exceptions = learn_exceptions(sample, lexicon) if lexicon else {}

    def look():
        auto = automaton(lexicon, exceptions)

        def f(row):
            w, k, n = measure(auto, row["text"])
            return [{"w": w, "k": k, "n": n, "label": row["label"]}]

        return f

    rows = map_rows(sample, look, "w double, k int, n int, label int").toPandas()  # at most max_train rows
    dropped(sample)
    if rows.label.nunique() < 2:
        rate = float(rows.label.mean()) if len(rows) else 0.0
        curve = [math.log((rate + 1e-3) / (1 - rate + 1e-3)), 0.0, 0.0, 0.0, 0.0]
    else:
        curve = _logistic(np.array([_features(*r) for r in rows[["w", "k", "n"]].itertuples(index=False)]), rows.label.to_numpy(float))
    return {"lexicon": lexicon, "exceptions": exceptions, "curve": curve}


def score(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, n_hits, lexicon_weight of every row."""
    lexicon, exceptions, curve = model["lexicon"], model["exceptions"], model["curve"]

    def make():
        auto = automaton(lexicon, exceptions)

        def f(row):
            w, k, n = measure(auto, row["text"])
            z = sum(a * b for a, b in zip(curve, _features(w, k, n)))
            return [{"doc_id": row["doc_id"], "score": 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), "n_hits": k, "lexicon_weight": w}]

        return f

    return map_rows(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, score double, n_hits int, lexicon_weight double", rows=4096)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", hold_out(F.col("doc_id"), FOLDS).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits", "lexicon_weight")


def reject_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of documents, all columns, whose score is under the threshold."""
    model = fit(documents, labels)
    lexicon, exceptions, curve = model["lexicon"], model["exceptions"], model["curve"]

    def run(batches):
        import pyarrow as pa

        auto = automaton(lexicon, exceptions)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                z = [sum(a * b for a, b in zip(curve, _features(*measure(auto, t)))) for t in part.column("text").to_pylist()]
                yield part.filter(pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) < threshold for v in z]))

    return documents.mapInArrow(trimmed(run), documents.schema)
