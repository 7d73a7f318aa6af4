"""Ranked lexical search by block-max pruning over a forward index.

Documents become rows of a forward index: length, query terms and their frequencies. Rows are put in order of the terms
that weigh most in them, and neighbouring rows form blocks; a block holds its documents' impacts (a term's part in the score) and, for each term, the greatest impact in the block.
The sum of those maxima over an item's terms bounds every score in the block. The blocks of the greatest bounds are
scored first and give each item a threshold, the least score that can still be among its best; then each task takes
its blocks in falling order of the bound, scores documents from the forward index, raises the threshold, and stops
where the bound falls below it. A bound equal to it is still scored, since a smaller id may win the tie. So nothing is
missed, and results do not depend on how blocks are cut.

The items are a stated query set: they are broadcast in blocks of bounded words (decontamination.blocks_of), and the
index holds only terms of the block's items. Tasks keep TOP documents for each item, and thresholds known to all keep
most of those from being sent.

Null and empty texts have no terms and are in no count. Items without a term that occurs give no rows. Repeated rows of
documents are documents of their own, repeated items are items of their own. Ties go to the smaller doc_id, null ids
last. A very long text is one row of the index with as many entries as it has distinct query terms. Empty tables give
no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import saved, slices, table, trimmed
from sedimenta.llm.decontamination import blocks_of

TOP = 10
#: Documents of a block, and blocks that are scored first for each item.
BLOCK_DOCS, SEEDS = 32, 4
#: Terms of greatest impact by which documents are put in order.
LEADING = 4
#: Bytes that separate terms become blanks, and A to Z become small.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class Items:
    """A block of items as numbers: terms of all items, and for each item with terms its terms and their frequencies."""

    def __init__(self, texts: list[str | None]):
        self.number: dict[bytes, int] = {}
        self.item, start, terms, times = [], [], [], []
        for i, text in enumerate(texts):
            counted = Counter(terms_of(text))
            if counted:
                self.item.append(i)
                start.append(len(terms))
                terms += [self.number.setdefault(t, len(self.number)) for t in counted]
                times += counted.values()
        self.start, self.terms, self.times = np.array(start, np.int64), np.array(terms, np.int64), np.array(times, np.int64)

    def bounds(self, terms: np.ndarray, best: np.ndarray) -> np.ndarray:
        """For each item with terms the sum of `best` over its terms; other terms of the items count nothing."""
        of = np.zeros(len(self.number), np.int64)
        of[terms] = best
        return np.add.reduceat(of[self.terms] * self.times, self.start)

    def scores(self, q: int, block: Block) -> np.ndarray:
        """The score of every document of a block for item number q."""
        end = self.start[q + 1] if q + 1 < len(self.start) else len(self.terms)
        times = np.zeros(len(self.number), np.int64)
        times[self.terms[self.start[q] : end]] = self.times[self.start[q] : end]
        return np.add.reduceat(block.impacts * times[block.terms], block.starts)


class Block:
    """Documents of a block: ids, where each one's entries start, and the entries' terms and impacts."""

    def __init__(self, row: dict):
        self.ids, self.starts = row["ids"], np.asarray(row["starts"], np.int64)
        self.terms, self.impacts = np.asarray(row["terms"], np.int64), np.asarray(row["impacts"], np.int64)


class Best:
    """The best documents of an item as they come, and what a score must reach to be among them."""

    def __init__(self, least: int, top: int = TOP):
        self.least, self.top, self.rows = max(1, least), top, []

    def add(self, scores: np.ndarray, ids: list) -> None:
        for i in np.flatnonzero(scores >= self.least).tolist():
            self.rows.append((-int(scores[i]), ids[i] is None, ids[i] or 0))
        self.rows.sort()
        del self.rows[self.top :]
        if len(self.rows) == self.top:
            self.least = max(self.least, -self.rows[-1][0])


def forward_index(documents: DataFrame, items: Items) -> DataFrame:
    """doc_id, n (terms of the text with repeats), and terms and times of the items' terms, of every row with a term."""
    shipped = documents.sparkSession.sparkContext.broadcast(items.number)
    kind = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])

    def run(batches):
        number = shipped.value
        for batch in slices(batches, 512):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = terms_of(text)
                if words:
                    known = [(number[t], c) for t, c in Counter(words).items() if t in number]
                    out.append((doc_id, len(words), [t for t, _ in known], [c for _, c in known]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, n long, terms array<int>, times array<int>")


def impact_index(forward: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """doc_id, terms and impacts of every row with a term of the items, and k0 to k3, the terms of its greatest impacts."""
    shipped = forward.sparkSession.sparkContext.broadcast(weights)
    kind = pa.schema([("doc_id", pa.int64()), ("terms", pa.list_(pa.int32())), ("impacts", pa.list_(pa.int64())), *((f"k{i}", pa.int32()) for i in range(LEADING))])

    def run(batches):
        weight = shipped.value
        for batch in slices(batches, 1024):
            out = []
            for doc_id, n, terms, times in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "terms", "times"))):
                if terms:
                    t, c = np.array(terms, np.int64), np.array(times, np.int64)
                    m = 25 + 75 * n * n_docs // n_terms  # 100 - 75 + ..., in whole numbers of any size
                    impacts = weight[t] * ((1_000_000_000 * c) // (1000 * c + 8 * m))
                    first = t[np.lexsort((t, -impacts))[:LEADING]].tolist()
                    out.append((doc_id, terms, impacts, *first, *[-1] * (LEADING - len(first))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)

    return forward.mapInArrow(trimmed(run), "doc_id long, terms array<int>, impacts array<long>, " + ", ".join(f"k{i} int" for i in range(LEADING)))


def block_index(impacts: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Blocks of neighbouring rows in the order of their leading terms: block, ids, starts, terms, impacts, and the greatest
    impact `best` of each term of the block in `all_terms`. Documents that are about the same lie together, so that the
    maxima of a block tell more of its documents; documents that lead alike are dealt out by hash, however many they are."""
    kind = pa.schema([("ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("terms", pa.list_(pa.int32())), ("impacts", pa.list_(pa.int64())), ("all_terms", pa.list_(pa.int32())), ("best", pa.list_(pa.int64()))])

    def run(batches):
        for batch in slices(batches, block_docs):
            at = batch.column("terms")
            terms, impacts = at.flatten().to_numpy().astype(np.int64), batch.column("impacts").flatten().to_numpy()
            counts = at.value_lengths().to_numpy()
            order = np.argsort(terms, kind="stable")
            all_terms, first = np.unique(terms[order], return_index=True)
            row = [batch.column("doc_id").to_pylist()], [np.cumsum(counts) - counts], [terms], [impacts], [all_terms], [np.maximum.reduceat(impacts[order], first)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, kind)], schema=kind)

    order = [*(f"k{i}" for i in range(LEADING)), F.xxhash64("doc_id"), "doc_id"]
    parts = int(impacts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = impacts.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "terms", "impacts")
    made = dealt.mapInArrow(trimmed(run), "ids array<long>, starts array<int>, terms array<int>, impacts array<long>, all_terms array<int>, best array<long>")
    return made.withColumn("block", F.monotonically_increasing_id())


def _first(found: DataFrame, top: int, *order) -> DataFrame:
    """The first `top` rows of each q; tasks cut down their own rows before any is moved."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= top)


def seed_thresholds(blocks: DataFrame, items: Items, top: int = TOP) -> dict[int, int]:
    """For each item the `top`-th score among the blocks of its greatest bounds, where these have so many documents."""
    sc = blocks.sparkSession.sparkContext
    shipped = sc.broadcast(items)

    def bounds(batches):
        own, leading = shipped.value, {}
        for batch in batches:
            for row in batch.to_pylist():
                found = own.bounds(np.asarray(row["all_terms"], np.int64), np.asarray(row["best"], np.int64))
                for q in np.flatnonzero(found).tolist():
                    leading[q] = sorted([*leading.get(q, ()), (-int(found[q]), row["block"])])[:SEEDS]
        rows = [(q, b, -n) for q, best in leading.items() for n, b in best]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["q", "block", "bound"])

    first = _first(blocks.select("block", "all_terms", "best").mapInArrow(trimmed(bounds), "q long, block long, bound long"), SEEDS, F.desc("bound"), "block")
    asked = first.groupBy("block").agg(F.collect_list("q").alias("asked"))  # of at most SEEDS blocks an item, bounded as the items are

    def score(batches):
        own = shipped.value
        for batch in slices(batches, 16):
            rows = []
            for row in batch.to_pylist():
                block = Block(row)
                for q in row["asked"]:
                    best = Best(1, top)
                    best.add(own.scores(q, block), block.ids)
                    rows += [(q, -s) for s, _, _ in best.rows]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["q", "score"])

    scored = blocks.select("block", "ids", "starts", "terms", "impacts").join(F.broadcast(asked), "block").mapInArrow(trimmed(score), "q long, score long")
    return {r["q"]: r["score"] for r in _first(scored, top, F.desc("score")).where(F.col("rank") == top).select("q", "score").collect()}


def search_blocks(blocks: DataFrame, items: Items, least: dict[int, int], top: int = TOP) -> DataFrame:
    """q, doc_id and score of the best documents of each task, and nothing that is surely not among the best of all."""
    shipped = blocks.sparkSession.sparkContext.broadcast((items, least))
    kind = pa.schema([("q", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        own, known = shipped.value
        best = [Best(known.get(q, 1), top) for q in range(len(own.start))]
        for batch in slices(batches, 256):
            rows = batch.to_pylist()
            found = np.stack([own.bounds(np.asarray(r["all_terms"], np.int64), np.asarray(r["best"], np.int64)) for r in rows])
            held = [Block(r) for r in rows]
            least = np.array([b.least for b in best], np.int64)
            for q in np.flatnonzero((found >= least).any(axis=0)).tolist():
                for b in np.argsort(-found[:, q], kind="stable").tolist():
                    if found[b, q] < best[q].least:
                        break
                    best[q].add(own.scores(q, held[b]), held[b].ids)
        out = [(q, None if null else i, -s) for q, b in enumerate(best) for s, null, i in b.rows]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)

    return blocks.mapInArrow(trimmed(run), "q long, doc_id long, score long")


def search(documents: DataFrame, queries: DataFrame, top: int = TOP, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """item_id, rank, doc_id and score of the `top` best documents of each row of `queries` (item_id, text)."""
    spark, parts = documents.sparkSession, []
    for part in blocks_of(queries):
        rows = [(r["item_id"], r["text"]) for r in part.collect()]  # bounded by blocks_of()
        items = Items([t for _, t in rows])
        if not items.item:
            continue
        forward = saved(forward_index(documents, items), "forward")
        n_docs, n_terms = forward.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        weights = np.zeros(len(items.number), np.int64)
        for r in forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the items
            weights[r["t"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
        blocks = saved(block_index(impact_index(forward, weights, n_docs, n_terms), block_docs), "blocks")
        found = _first(search_blocks(blocks, items, seed_thresholds(blocks, items, top), top), top, F.desc("score"), F.asc_nulls_last("doc_id"))
        ids = spark.createDataFrame([(q, rows[i][0]) for q, i in enumerate(items.item)], "q long, item_id long")
        parts.append(found.join(F.broadcast(ids), "q").select("item_id", "rank", "doc_id", "score"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for p in parts:
        out = out.unionByName(p)
    return out


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
