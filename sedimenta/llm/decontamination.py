"""Benchmark decontamination by an FM-index over each shard of the training text.

A shard is a bounded run of documents of one task. Its words become symbols (words that no benchmark item has
are breaks), its suffixes are sorted, and a wavelet matrix over the Burrows-Wheeler transform answers ranks.
All distinct test phrases are searched backward at once; occurrences are located by walking to sampled suffix
positions; and the occurrences of a document merge into removal spans.

The benchmark is broadcast only in blocks of at most BLOCK_WORDS words; a larger one is searched block by block.
Null and empty texts have no words. Items without words have no window. Repeated rows are searched alike. An
item with a null id is searched and removed, but no document lists it. A very long text is one shard of its own size.
Columns of any name are carried along; row numbers stand in columns of generated names. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import LOWER, saved, slices, table, trimmed

WINDOW = 10
#: Words of a shard before its index is built, benchmark words in a broadcast block, and the distance of suffix samples.
SHARD_WORDS, BLOCK_WORDS, SAMPLE = 600_000, 400_000, 8
#: Documents and characters of a shard.
SHARD_DOCS, SHARD_CHARS = 20_000, 16_000_000

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters A to Z and characters beyond ASCII, A to Z lower-cased."""
    return WORDS.findall(text.encode().translate(LOWER)) if text else []


class Phrases:
    """The distinct windows of a block of items, as symbols of the block's own words."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.symbol: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            s = [self.symbol.setdefault(w, len(self.symbol) + 1) for w in words_of(text)]
            for i in range(max(1, len(s) - window + 1) if s else 0):
                found.setdefault(tuple(s[i : i + window]), set()).update(() if item_id is None else (str(item_id),))
        self.of = [sorted(v) for v in found.values()]
        self.length = np.array([len(k) for k in found], np.int64)
        self.symbols = np.zeros((len(found), window), np.int64)
        for i, k in enumerate(found):
            self.symbols[i, : len(k)] = k


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Order of all suffixes of t. Each 0 counts as a symbol of its own, less than any other, a later 0 above an earlier one."""
    n, width = len(t), max(1, sigma.bit_length())
    span, pad = max(1, 62 // width), np.zeros(64, np.int64)
    ext, key, live = np.concatenate([t, pad]), np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(span):
        sym = ext[k : k + n]
        live &= sym > 0
        key = (key << width) | np.where(live, sym, 0)
    order = np.argsort(key, kind="stable")
    ended = ~live[order]  # its first symbols hold a 0: the order of positions decides, which a stable sort has kept
    new = np.ones(n, bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | ended[1:]
    rank = np.empty(n + 64, np.int64)
    rank[n:] = -1
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = start
    last = np.ones(n, bool)
    last[:-1] = new[1:]
    open_ = np.flatnonzero(~(new & last))
    h = span
    while len(open_):
        pos = order[open_]
        nxt = np.where(pos + h < n, rank[np.minimum(pos + h, n)], -1)
        by = np.lexsort((nxt, rank[pos]))
        pos, nxt, old = pos[by], nxt[by], rank[pos][by]
        order[open_] = pos
        first = np.ones(len(pos), bool)
        first[1:] = (old[1:] != old[:-1]) | (nxt[1:] != nxt[:-1])
        at = np.maximum.accumulate(np.where(first, open_, 0))
        rank[pos] = at
        tail = np.ones(len(pos), bool)
        tail[:-1] = first[1:]
        open_ = open_[~(first & tail)]
        h *= 2
    return order


class FMIndex:
    """Symbols 1 to sigma; 0 breaks phrases and is never part of one."""

    def __init__(self, t: np.ndarray, sigma: int, sample: int = SAMPLE):
        self.n = n = len(t)
        sa = suffix_array(t, sigma)
        bwt = t[sa - 1]  # before the first suffix stands the last symbol, a 0
        self.first = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=sigma + 1))])
        self.bits, self.zeros = max(1, sigma.bit_length()), []
        self.ones: list[np.ndarray] = []
        level = bwt
        for b in reversed(range(self.bits)):
            bit = (level >> b) & 1
            c = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=c[1:])
            self.ones.append(c)
            self.zeros.append(n - int(c[-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        # sampled: every sample-th position, and those after a 0, where walking back would leave the phrase symbols
        mark = (sa % sample == 0) | (bwt == 0)
        self.marked, self.sampled = np.concatenate([[0], np.cumsum(mark, dtype=np.int32)]).astype(np.int32), sa[mark].astype(np.int32)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c among the first i of the transform."""
        lo, hi = np.zeros_like(i), i
        for level, b in enumerate(reversed(range(self.bits))):
            ones, one = self.ones[level], ((c >> b) & 1).astype(bool)
            a, z = ones[lo], ones[hi]
            lo, hi = np.where(one, self.zeros[level] + a, lo - a), np.where(one, self.zeros[level] + z, hi - z)
        return hi - lo

    def step_back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix one symbol longer."""
        i, c, lo = row, np.zeros_like(row), np.zeros_like(row)
        for level in range(self.bits):
            ones = self.ones[level]
            a, z = ones[lo], ones[i]
            one = (ones[i + 1] - z).astype(bool)
            c = (c << 1) | one
            lo, i = np.where(one, self.zeros[level] + a, lo - a), np.where(one, self.zeros[level] + z, i - z)
        return self.first[c] + i - lo

    def search(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all phrases: the phrases that occur and their row ranges."""
        live = np.arange(len(length))
        lo, hi = np.zeros(len(length), np.int64), np.full(len(length), self.n, np.int64)
        for k in range(symbols.shape[1]):
            going = live[length[live] > k]
            c = symbols[going, length[going] - 1 - k]
            base = self.first[c]
            lo[going], hi[going] = base + self.rank(c, lo[going]), base + self.rank(c, hi[going])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return live, lo[live], hi[live]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, walked, live, row = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), rows.astype(np.int64)
        while len(live):
            m = self.marked[row]
            done = self.marked[row + 1] > m
            out[live[done]] = self.sampled[m[done]] + walked
            live, row = live[~done], self.step_back(row[~done])
            walked += 1
        return out


class Shard:
    """Gathers documents until it is full, then finds the occurrences of all phrases in them."""

    def __init__(self, phrases: Phrases):
        self.p, self.docs, self.words = phrases, [], 0

    def add(self, key: tuple, words: list[bytes]) -> None:
        self.docs.append((key, np.fromiter(map(self.p.symbol.get, words, repeat(0)), np.int32, len(words))))
        self.words += len(words)

    @property
    def full(self) -> bool:
        return self.words >= SHARD_WORDS or len(self.docs) >= SHARD_DOCS

    def flush(self):
        """For each document in order: its key, number of words, merged spans [start, end), and the items found."""
        docs, self.docs, self.words = self.docs, [], 0
        if not docs:
            return
        lengths = np.array([len(s) for _, s in docs], np.int64)
        total = int(lengths.sum())
        s = np.zeros(total + len(docs) + 1, np.int64)  # a 0 ahead of each document and one at the end
        begin = np.concatenate([[0], np.cumsum(lengths + 1)])
        for (_, a), b in zip(docs, begin):
            s[b + 1 : b + 1 + len(a)] = a
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] > 0) | (s[:-1] > 0)  # a run of breaks is one break
        keep[-1] = True
        at = np.flatnonzero(keep)
        t = s[at]
        spans: list[list] = [[] for _ in docs]
        items: list[set] = [set() for _ in docs]
        if len(self.p.length) and len(t) > 2:
            index = FMIndex(t, len(self.p.symbol))
            hit, lo, hi = index.search(self.p.symbols, self.p.length)
            count = hi - lo
            if len(hit):
                rows = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
                which, pos = np.repeat(hit, count), at[index.locate(rows)]
                doc = np.searchsorted(begin, pos, side="right") - 1
                for d, w in set(zip(doc.tolist(), which.tolist())):
                    items[d].update(self.p.of[w])
                by = np.lexsort((pos, doc))
                for d, b, e in zip(doc[by].tolist(), (pos - begin[doc] - 1)[by].tolist(), (pos - begin[doc] - 1 + self.p.length[which])[by].tolist()):
                    if spans[d] and b <= spans[d][-1][1]:
                        spans[d][-1][1] = max(spans[d][-1][1], e)
                    else:
                        spans[d].append([b, e])
        for i, (key, a) in enumerate(docs):
            yield key, len(a), spans[i], items[i]


def digest(n_words: int, spans: list, items: set) -> tuple[int, int, str]:
    return sum(e - b for b, e in spans), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def blocks_of(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> list[DataFrame]:
    """The items dealt into as many blocks as keep each within the bound on average; one block for a benchmark that fits."""
    items = benchmark.select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // (block_words * 4))
    return [items] if n <= 1 else [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def _marked(documents: DataFrame) -> tuple[DataFrame, str]:
    """documents with a number of each row, kept in a table so that it stays the same; and the name of its column."""
    mark = f"_{uuid.uuid4().hex[:12]}"
    return saved(documents.withColumn(mark, F.monotonically_increasing_id()), "rows"), mark


def find(documents: DataFrame, items: DataFrame, mark: str | None = None) -> DataFrame:
    """One block: mark (null if there is none), doc_id, n_words, spans (of word numbers) and items of every row."""
    phrases = Phrases([(r["item_id"], r["text"]) for r in items.collect()])  # bounded by blocks_of()
    shipped = documents.sparkSession.sparkContext.broadcast(phrases)
    kind = pa.schema([("mark", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string()))])

    def run(batches):
        shard = Shard(shipped.value)

        def out():
            rows = [(*k, n, s, sorted(i)) for k, n, s, i in shard.flush()]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

        for part in slices(batches, 256):
            for *key, text in zip(*(c.to_pylist() for c in part.columns)):
                shard.add(tuple(key), words_of(text))
                if shard.full:
                    yield out()
        if shard.docs:
            yield out()

    own = F.col(mark) if mark else F.lit(None).cast("long")
    rows = documents.select(own.alias("mark"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(trimmed(run), "mark long, doc_id long, n_words long, spans array<array<int>>, items array<string>")


def find_marked(documents: DataFrame, blocks: list[DataFrame], mark: str) -> DataFrame:
    """What the blocks found in each row, as one block would have found it. A row has one part from each block, so no group is large."""
    every = find(documents, blocks[0], mark)
    for b in blocks[1:]:
        every = every.unionByName(find(documents, b, mark))
    one = every.groupBy("mark").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.expr("""aggregate(s, cast(array() as array<array<int>>), (a, x) -> if(size(a) > 0 and element_at(a, -1)[1] >= x[0],
        concat(slice(a, 1, size(a) - 1), array(array(element_at(a, -1)[0], greatest(element_at(a, -1)[1], x[1])))), concat(a, array(x))))""")
    return one.select("mark", "doc_id", "n_words", joined.alias("spans"), "items")


def find_contamination(documents: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    blocks = blocks_of(benchmark, block_words)
    if len(blocks) == 1:
        return find(documents, blocks[0]).drop("mark")
    rows, mark = _marked(documents.select("doc_id", "text"))
    return find_marked(rows, blocks, mark).drop("mark")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    ids = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def cut_spans(text: str, spans: list) -> str:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in WORDS.finditer(text.encode().translate(LOWER))]
    raw, out, done = text.encode(), [], 0
    for b, e in spans:
        out.append(raw[done : at[b][0]])
        done = at[e - 1][1]
    return b"".join([*out, raw[done:]]).decode()


def _with_text(row: dict, spans: list) -> dict:
    if spans:
        row["text"] = cut_spans(row["text"], spans)
        if "n_chars" in row:
            row["n_chars"] = len(row["text"])
    return row


def remove_contamination(documents: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """documents, all columns, without the words of any window that occurs; n_chars follows where the table has it."""
    kind, blocks = documents.schema, blocks_of(benchmark, block_words)
    if len(blocks) == 1:
        return _removed(documents, blocks[0], kind)
    # judged on the input, so the blocks' findings are gathered before anything is cut
    rows, mark = _marked(documents)
    found = find_marked(rows, blocks, mark).where("size(spans) > 0").select(F.col("mark").alias(f"{mark}m"), F.col("spans").alias(f"{mark}s"))
    both = rows.join(found, F.col(mark) == F.col(f"{mark}m"), "left").select(*documents.columns, f"{mark}s")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        for part in slices(batches, 256):
            yield pa.RecordBatch.from_pylist([_with_text(row, row.pop(f"{mark}s")) for row in part.to_pylist()], schema=to_arrow_schema(kind))

    return both.mapInArrow(trimmed(run), kind)


def _removed(documents: DataFrame, items: DataFrame, kind) -> DataFrame:
    phrases = Phrases([(r["item_id"], r["text"]) for r in items.collect()])  # bounded by blocks_of()
    shipped = documents.sparkSession.sparkContext.broadcast(phrases)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, shard, rows, held = to_arrow_schema(kind), Shard(shipped.value), [], 0

        def out():
            return pa.RecordBatch.from_pylist([_with_text(rows[i], spans) for (i,), _, spans, _ in shard.flush()], schema=arrow)

        for part in slices(batches, 256):
            for row in part.to_pylist():
                shard.add((len(rows),), words_of(row["text"]))
                rows.append(row)
                held += len(row["text"] or "")
                if shard.full or held >= SHARD_CHARS:  # texts of few words are bounded by their characters
                    yield out()
                    rows, held = [], 0
        if rows:
            yield out()

    return documents.mapInArrow(trimmed(run), kind)
