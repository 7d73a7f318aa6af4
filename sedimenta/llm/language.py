"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters, of runs of letters with a blank at either side, are hashed into BUCKETS. Document
frequencies come from every training document. Weights are learned by follow-the-regularised-leader with
elastic-net penalties, per coordinate, on about MAX_TRAIN training documents, a uniform sample in which LEAST rows of
each language that it would have fewer of stand instead (all where there are fewer); a temperature fitted on a part of
them that the weights have not seen calibrates the probabilities.

A null text or one without a letter is `und` with score 0. Rows with null lang teach nothing. If nothing can be
learned every row is `und`. Repeated rows are predicted alike.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import held_out_py, hold_out, map_rows, table

FOLDS, ORDERS, BUCKETS = 5, 3, 1 << 13
#: Documents the weights are learned from, about, and how often they are gone through.
MAX_TRAIN, PASSES = 3_000, 3
#: Rows of a language that the sample would have fewer of.
LEAST = 30
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.5
NOT_LETTERS = re.compile(r"[\W\d_]+")
HASHING = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def grams(text: str | None) -> np.ndarray | None:
    """Buckets of all n-grams of a text, or None if it has no letter."""
    t = NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    if not t or not t.isalpha() and not any(map(str.isalpha, t)):  # some numbers, such as ½, are word characters but no letters
        return None
    c = np.frombuffer(f" {t} ".encode("utf-32-le"), np.uint32)
    out, h = [], np.zeros(len(c), np.uint32)
    for k in range(ORDERS):
        h = (h[: len(c) - k] ^ c[k:]) * HASHING[k]
        out.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 13))
    return np.concatenate(out).astype(np.int64)


def document_frequencies(documents: DataFrame, folds: int = FOLDS) -> tuple[np.ndarray, int]:
    """Training documents with each bucket, over all of them, and their number. A task sends its sums only."""

    def run(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for text in batch.slice(at, 512).column("text").to_pylist():
                    g = grams(text)
                    if g is not None:
                        df += np.bincount(g, minlength=BUCKETS) > 0
                        n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["b", "n"])

    rows = documents.where(~hold_out(F.col("doc_id"), folds) & F.col("lang").isNotNull()).select("text")
    out, n = np.zeros(BUCKETS, np.int64), 0
    for r in rows.mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():  # BUCKETS + 1 rows at most
        if r["b"] < 0:
            n = r["n"]
        else:
            out[r["b"]] = r["n"]
    return out, n


def weighed(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and TF-IDF weights of length 1, from the buckets' counts."""
    x = np.log1p(n) * idf[at]
    return at, x / max(float(np.sqrt(x @ x)), 1e-12)


def features(g: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    tf = np.bincount(g, minlength=BUCKETS)
    at = np.flatnonzero(tf)
    return weighed(at, tf[at], idf)


def within(h: Column, part: float) -> Column:
    """Whether a 64-bit hash lies in the lowest part of all hashes; as fine as the hash, so no table is too large for it."""
    return h < F.lit(min(2**63 - 1, int(part * 2**64) - 2**63))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, passes: int = PASSES) -> np.ndarray:
    """Weights (BUCKETS + 1 x k, the last row is the bias) by follow-the-regularised-leader, proximal form."""
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(at):
        zi, ni = z[at], n[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(passes):
        for at, x, y in rows:
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    return weights(np.arange(BUCKETS + 1))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    def loss(t):
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    lo, hi, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(documents: DataFrame, max_train: int = MAX_TRAIN, folds: int = FOLDS) -> dict | None:
    train = documents.where(~hold_out(F.col("doc_id"), folds) & F.col("lang").isNotNull())
    total = train.count()
    part = min(1.0, max_train / max(total, 1))
    chosen = train.select(F.xxhash64("doc_id", "text").alias("h"), "text", "lang")
    if part < 1:
        # few enough rows come to the driver, whatever the table's size: those whose hash lies in the lowest part of all hashes
        seldom = train.groupBy("lang").count().where(F.col("count") * part < LEAST).select("lang", F.lit(True).alias("seldom"))
        told = chosen.join(F.broadcast(seldom), "lang", "left")  # names only, of languages that each send rows to the driver anyway
        common = told.where("seldom is null").where(within(F.xxhash64("h"), part)).drop("seldom").orderBy("h", "lang").limit(2 * max_train)
        order = Window.partitionBy("lang").orderBy("h")
        few = told.where("seldom").withColumn("n", F.row_number().over(order)).where(F.col("n") <= LEAST).drop("seldom", "n")
        chosen = common.unionByName(few)

    def counted():
        def f(row):
            g = grams(row["text"])
            if g is None:
                return []
            at, n = np.unique(g, return_counts=True)
            return [{"h": row["h"], "lang": row["lang"], "at": at.tolist(), "n": n.tolist()}]

        return f

    # what comes to the driver is bounded by the buckets, not by the length of a text
    sample = map_rows(chosen, counted, "h long, lang string, at array<int>, n array<int>", rows=256).orderBy("lang", "h").collect()
    df, n = document_frequencies(documents, folds)
    idf = np.log((n + 1.0) / (df + 1.0)) + 1.0
    langs = sorted({r["lang"] for r in sample})
    if not langs:
        return None
    number = {lang: i for i, lang in enumerate(langs)}
    rows = [(*weighed(np.array(r["at"]), np.array(r["n"]), idf), number[r["lang"]]) for r in sample]
    np.random.default_rng(5).shuffle(rows)
    cut = len(rows) - len(rows) // 5
    w = ftrl(rows[:cut], len(langs))
    t = 1.0
    if rows[cut:]:
        t = temperature(np.array([x @ w[at] + w[-1] for at, x, _ in rows[cut:]]), np.array([y for *_, y in rows[cut:]]))
    return {"langs": langs, "weights": w / t, "idf": idf}


def predict(documents: DataFrame, model: dict | None, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers
    kind = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        m = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    g = grams(text) if m else None
                    if g is None:
                        out.append((doc_id, held_out_py(doc_id, folds), "und", 0.0))
                        continue
                    b, x = features(g, m["idf"])
                    p = _softmax(x @ m["weights"][b] + m["weights"][-1])
                    k = int(p.argmax())
                    out.append((doc_id, held_out_py(doc_id, folds), m["langs"][k], float(p[k])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
