"""Substring de-duplication by relative Lempel-Ziv factors against content-addressed reference blocks.

The reference of a document is every document with a smaller id. Comparing each document with each block of that
reference would grow with the square of the corpus, so blocks are addressed by content: a 50-word seed belongs to
the block of its anchor, the least of its 10-word hashes, and the seeds of one document that share an anchor form
one passage. Equal seeds have equal anchors, so a seed can only recur in the block of its own anchor, and all
blocks that can hold any factor of a document are asked.

1. Passages are indexed by (anchor, content); the least (doc_id, position) of each is its reference.
2. A passage met again is a factor as a whole. One representative of each distinct passage of an anchor that has
   several is resolved seed by seed, which covers what begins or ends within a passage.
3. Each document's known seeds are parsed greedily: a factor copies the same reference as long as positions
   advance together; where it ends, the seeds across the boundary have been asked for on their own, so a
   duplicate that straddles two factors is not lost. Factors of at least 50 words become the spans removed.

Hashes of content have 128 bits. Texts under 50 words, null and empty ones have no factor. A null id is no reference
and loses nothing. Rows that repeat an id are not references for each other, and each is parsed on its own.
"""

from __future__ import annotations

import hashlib
import random
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import SPACE_WORDS, SPACE_WORDS_B, dropped, saved, table, trimmed

FACTOR, GRAM = 50, 10
TABLE_ROWS = 150_000
_BASES = [random.Random(n).getrandbits(64) | 1 for n in (11, 12, 13)]


class Hasher:
    """128-bit hashes of word runs from two polynomial prefix sums over 64-bit word hashes."""

    def __init__(self):
        self.seen: dict[bytes, int] = {}
        self.powers, self.inverse = ([np.ones(1, np.uint64) for _ in _BASES] for _ in range(2))

    def words(self, text: str) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        words, seen = SPACE_WORDS_B.findall(text.encode()), self.seen
        try:
            return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(seen) > TABLE_ROWS:
                seen.clear()
            for w in words:
                if w not in seen:
                    seen[w] = xxh3_64_intdigest(w, 7)
            return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))

    def prefix(self, h: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(h) + 1
        if len(self.powers[which]) < n:
            for kept, base in ((self.powers, _BASES[which]), (self.inverse, pow(_BASES[which], -1, 1 << 64))):
                p = np.full(2 * n, base, np.uint64)
                p[0] = 1
                kept[which] = np.multiply.accumulate(p)
        p = self.powers[which]
        sums = np.zeros(n, np.uint64)
        np.cumsum(h * p[: n - 1], out=sums[1:])
        return sums, p

    def runs(self, h: np.ndarray, which: int, start: np.ndarray, length) -> np.ndarray:
        """Hash of h[start : start + length], brought to a common power and mixed."""
        sums, p = self.prefix(h, which)
        x = (sums[start + length] - sums[start]) * self.inverse[which][start]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def anchored(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` grams the position of its least hash, the leftmost of equal ones."""
    n = len(grams) - width + 1
    best, at, have = grams.copy(), np.arange(len(grams)), 1
    while have < width:  # doubling: best covers `have` grams
        step = min(have, width - have)
        m = len(best) - step
        right = best[step:] < best[:m]
        at = np.where(right, at[step:], at[:m])
        best = np.where(right, best[step:], best[:m])
        have += step
    return at[:n]


def passages_of(hasher: Hasher, text: str | None, factor: int = FACTOR, gram: int = GRAM):
    """(anchor hash, content hash 1, content hash 2, first seed, number of seeds) arrays, and the words' number."""
    h = hasher.words(text) if text else np.empty(0, np.uint64)
    if len(h) < factor:
        return None, len(h)
    grams = hasher.runs(h, 2, np.arange(len(h) - gram + 1), gram)
    at = anchored(grams, factor - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    seeds = np.diff(np.concatenate([first, [len(at)]]))
    return (grams[at[first]], hasher.runs(h, 0, first, seeds + factor - 1), hasher.runs(h, 1, first, seeds + factor - 1), first, seeds), len(h)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.uint64).view(np.int64))


def passages(documents: DataFrame, factor: int = FACTOR, gram: int = GRAM) -> DataFrame:
    """a, c1, c2, doc_id, tk (hash of the text), s (first seed), n (seeds) of every passage."""
    schema = "a long, c1 long, c2 long, doc_id long, tk long, s int, n int"

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                got, ids, tks = [], [], []
                for doc_id, tk, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    found, _ = passages_of(hasher, text, factor, gram)
                    if found:
                        got.append(found)
                        ids.append(np.full(len(found[0]), doc_id, np.int64))
                        tks.append(np.full(len(found[0]), tk, np.int64))
                if got:
                    a, c1, c2, s, n = (np.concatenate(x) for x in zip(*got))
                    yield pa.RecordBatch.from_arrays([_signed(a), _signed(c1), _signed(c2), pa.array(np.concatenate(ids)), pa.array(np.concatenate(tks)), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], names=["a", "c1", "c2", "doc_id", "tk", "s", "n"])

    rows = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), "text")
    return rows.mapInArrow(trimmed(run), schema)


def _seeds(wanted: DataFrame, documents: DataFrame, factor: int) -> DataFrame:
    """w1, w2, doc_id, tk, s of the seeds of the passages in wanted (doc_id, tk, p: array of (s, n))."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                got = []
                for doc_id, tk, text, p in zip(*(c.to_pylist() for c in batch.slice(at, 128).columns)):
                    h = hasher.words(text)
                    s = np.unique(np.concatenate([np.arange(q["s"], q["s"] + q["n"]) for q in p]))
                    got.append((hasher.runs(h, 0, s, factor), hasher.runs(h, 1, s, factor), np.full(len(s), doc_id, np.int64), np.full(len(s), tk, np.int64), s))
                if got:
                    w1, w2, ids, tks, s = (np.concatenate(x) for x in zip(*got))
                    yield pa.RecordBatch.from_arrays([_signed(w1), _signed(w2), pa.array(ids), pa.array(tks), pa.array(s.astype(np.int32))], names=["w1", "w2", "doc_id", "tk", "s"])

    text = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), "text")
    return text.join(wanted, ["doc_id", "tk"]).select("doc_id", "tk", "text", "p").mapInArrow(trimmed(run), "w1 long, w2 long, doc_id long, tk long, s int")


def factors(documents: DataFrame, factor: int = FACTOR, gram: int = GRAM) -> DataFrame:
    """doc_id, tk, f: the array of (s, n, d, r): n seeds from word s on recur in document d from word r on."""
    p = saved(passages(documents, factor, gram), "passages")
    ref = F.struct(F.col("doc_id").alias("d"), F.col("s").alias("r"))
    classes = p.groupBy("a", "c1", "c2").agg(F.min(ref).alias("ref"), F.max("doc_id").alias("last"))
    classes = saved(classes, "classes")
    several = classes.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").select("a", F.lit(True).alias("several"))
    known = classes.join(several, "a", "left").where("ref.d < last or several").select("a", "c1", "c2", "ref", "several")
    met = saved(p.join(known, ["a", "c1", "c2"]).where("doc_id > ref.d or several").select("doc_id", "tk", "s", "n", F.col("ref.d").alias("d"), F.col("ref.r").alias("r")), "met")
    dropped(p)
    dropped(classes)
    # passages met again
    whole = met.where("doc_id > d")
    # the first document of each distinct passage of an anchor that has several stands for the passage
    wanted = met.where("doc_id = d").groupBy("doc_id", "tk").agg(F.collect_set(F.struct("s", "n")).alias("p"))  # equal rows find the same
    seeds = saved(_seeds(wanted, documents, factor), "seeds")
    known = seeds.groupBy("w1", "w2").agg(F.min(F.struct(F.col("doc_id").alias("d"), F.col("s").alias("r"))).alias("ref"), F.max("doc_id").alias("last")).where("ref.d < last").select("w1", "w2", "ref")
    single = seeds.join(known, ["w1", "w2"]).where("doc_id > ref.d").select("doc_id", "tk", "s", F.lit(1).alias("n"), F.col("ref.d").alias("d"), F.col("ref.r").alias("r"))
    found = whole.unionByName(single)
    return found.groupBy("doc_id", "tk").agg(F.collect_set(F.struct("s", "n", "d", "r")).alias("f"))


def parse(hits: list[dict], factor: int = FACTOR) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start word, end word, reference document, reference word) from a document's known seeds."""
    if not hits:
        return []
    out: list[list[int]] = []
    for h in sorted(hits, key=lambda h: (h["s"], -h["n"])):
        s, n, d, r = h["s"], h["n"], h["d"], h["r"]
        last = out[-1] if out else None
        if last and s + n <= last[1]:
            continue  # inside the factor before it
        if last and d == last[2] and r - s == last[3] - last[0] and s <= last[1]:
            last[1] = s + n
            continue
        if last and s < last[1]:  # seeds across the boundary of two factors start the second
            n, r, s = n - (last[1] - s), r + last[1] - s, last[1]
        out.append([s, s + n, d, r])
    return [(s, e + factor - 1, d, r) for s, e, d, r in out]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [tuple(x) for x in out]


def _with_factors(documents: DataFrame, factor: int = FACTOR, gram: int = GRAM) -> tuple[DataFrame, str]:
    """documents with their factors in a column of a generated name, and that name."""
    mark = f"_{uuid.uuid4().hex[:12]}"
    found = factors(documents, factor, gram).select(F.col("doc_id").alias(f"{mark}d"), F.col("tk").alias(f"{mark}t"), F.col("f").alias(mark))
    keyed = documents.withColumn(f"{mark}k", F.xxhash64("text"))
    both = keyed.join(found, (F.col("doc_id").cast("long") == F.col(f"{mark}d")) & (F.col(f"{mark}k") == F.col(f"{mark}t")), "left")
    return both.select(*[F.col(f"`{c}`") for c in documents.columns], mark), mark


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def run(batches):
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 256):
                for doc_id, text, f in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    words = SPACE_WORDS_B.findall(text.encode()) if text else []
                    spans = merged([(s, e) for s, e, _, _ in parse(f or [])])
                    kept = words
                    if spans:
                        kept, done = [], 0
                        for b, e in spans:
                            kept += words[done:b]
                            done = e
                        kept += words[done:]
                    out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256"]) if out else pa.RecordBatch.from_pylist([], schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]))

    return _with_factors(docs)[0].mapInArrow(trimmed(run), schema)


def cut_repeats(documents: DataFrame) -> DataFrame:
    """documents, all columns, without the words that an earlier document has in a run of 50; n_chars follows where there is one."""

    def cut(text, f):
        at = [m.span() for m in SPACE_WORDS.finditer(text)]
        out, done = [], 0
        for b, e in merged([(s, e) for s, e, _, _ in parse(f)]):
            out.append(text[done : at[b][0]])
            done = at[e][0] if e < len(at) else len(text)
        return "".join([*out, text[done:]])

    schema, (rows, mark) = documents.schema, _with_factors(documents)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pylist()
                for row in part:
                    f = row.pop(mark)
                    if f:
                        row["text"] = cut(row["text"], f)
                        if "n_chars" in row:
                            row["n_chars"] = len(row["text"])
                yield pa.RecordBatch.from_pylist(part, schema=kind)

    return rows.mapInArrow(trimmed(run), schema)
