"""Token ids in files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A file holds consecutive documents of ascending doc_id, FILE_IDS ids or the document that reaches them: tables, the
documents' ids and lengths, and the ids in blocks of BLOCK. Every block starts from the file's tables and from empty
statistics: an order-2 and an order-1 context each predict the id that followed them last in this block, with a
confidence. Whether the id is the first prediction, the second or neither is coded by a mixture of order-0, order-1 and
order-2 statistics of that event, whose weights follow their success; statistics move on every CHUNK ids. An id that
was not predicted is coded by the file's order-1 frequencies where they pay for their room in the file, and by its
order-0 frequencies elsewhere. The model is whole numbers only, so that any machine decodes what another has encoded.
LANES blocks are coded side by side with vector operations. Each block has a CRC-32 of its ids, checked when it is read.

Ids come from a table of distinct words with what touches them, made of a table of distinct pre-tokens, each encoded once
by the library; texts with characters
outside a range whose rules are known here go to the library whole. Null counts as empty: the end id only. Null ids
come first. Documents of equal id follow each other by a hash of their text; rows that are equal in both are
interchangeable. So neither many rows of one id nor repeated rows meet in one task. A very long text is encoded whole
and makes its file longer. An empty table has no files and no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import scratch_root, slices, table, trimmed
from sedimenta.llm.pieces import Generations

BLOCK, CHUNK, LANES, SLOTS = 4096, 512, 1024, 11
FILE_IDS = BLOCK * LANES
#: Bits of the totals that events and ids are coded by.
EVENT, ID = 12, 16
#: Bits that a row of order-1 frequencies must save for each of its ids.
ROOM = 18
MAGIC, END_ID, TABLE_ROWS = b"CMRC2\0", 1, 300_000

PLAIN = re.compile(r"[\t-\r\x20-\x7e\xc0-\xff]*")
PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+")
_held: dict[str, Encoder] = {}


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker, which outlives a task: what one task has met, the next need not encode."""
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids as little-endian unsigned 16-bit integers, the end id included."""

    def __init__(self, path: str, rows: int = TABLE_ROWS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib, self.end = Tokenizer.from_file(path), struct.pack("<H", END_ID)
        self.ids, self.parts = Generations(rows), Generations(rows)
        vocabulary = self.lib.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a pre-token
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _library(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _learn(self, words: set[str]) -> None:
        """Adds words from the table of their pre-tokens; new pre-tokens go to the library as one text."""
        split = [(w, PRE_TOKENS.findall(w)) for w in words]
        new = list(self.parts.absent(set(chain.from_iterable(p for _, p in split))))
        if new:
            ids = np.array(self.lib.encode(" ".join(new), add_special_tokens=False).ids, "<u2")
            at = 2 * np.flatnonzero(self.ends[ids]) + 2
            if len(at) == len(new):
                data = ids.tobytes()
                self.parts.update(zip(new, map(data.__getitem__, map(slice, [0, *at[:-1].tolist()], at.tolist()))))
            else:
                self.parts.update((p, self._library(p)) for p in new)
        find = self.parts.__getitem__
        self.ids.update((w, find(p[0]) if len(p) == 1 else b"".join(map(find, p))) for w, p in split)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        every = [t.lower().split() if t and PLAIN.fullmatch(t) and "<|" not in t else None for t in texts]
        new = self.ids.absent(set(chain.from_iterable(w for w in every if w)))
        if new:
            self._learn(new)
        find = self.ids.__getitem__
        return [(b"".join(map(find, w)) if w is not None else self._library(t) if t else b"") + self.end for w, t in zip(every, texts)]


# --- the file's tables ---


class Tables:
    """Rows of frequencies that sum to 2 ** ID: row 0 of order 0, and one for each context that pays for its room."""

    def __init__(self, contexts: np.ndarray, sizes: np.ndarray, symbols: np.ndarray, counts: np.ndarray):
        self.contexts, self.sizes, self.told = contexts, sizes, (symbols, counts)
        first, total = np.cumsum(sizes) - sizes, 1 << ID
        row = np.repeat(np.arange(len(sizes)), sizes)
        by_key = np.lexsort((symbols, row))
        order = np.lexsort((symbols, -counts, row))  # frequent ids first: few searches need more than their guess
        symbols, counts = symbols[order], counts[order]
        f = counts * (total - sizes[row]) // np.add.reduceat(counts, first)[row] + 1
        f[first] += total - np.add.reduceat(f, first)
        end = np.cumsum(f)
        stop = end - total * row
        self.symbols, self.freq, self.stop, self.start = symbols.astype(np.uint32), *(x.astype(np.uint64) for x in (f, stop, stop - f))
        self.row = np.zeros(1 << 16, np.int64)
        self.row[contexts] = np.arange(1, len(contexts) + 1)
        # for each 256th of a row the entry where the search for an entry starts; the next one's is where it ends
        self.guess = np.searchsorted(end, np.arange(0, total * len(sizes) + 1, 256), side="right")
        self.guess[-1] = len(end) - 1
        # entries by row and id; a search where the rows are too many for a square
        used, at = np.unique(symbols, return_inverse=True)
        self.square, place = None, np.empty_like(order)
        place[order] = np.arange(len(order))
        self.place = place[by_key]
        self.key = (row << 16 | self.symbols.astype(np.int64))[self.place]
        if len(sizes) * len(used) <= 1 << 24:
            self.rank = np.zeros(1 << 16, np.int64)
            self.rank[used] = np.arange(len(used))
            self.square = np.zeros((len(sizes), len(used)), np.int32)
            self.square[row, at] = np.arange(len(row))

    @classmethod
    def of(cls, ids: np.ndarray, length: int) -> Tables:
        """Tables of blocks of that length; before a block stands 0."""
        before = np.zeros(len(ids), np.uint32)
        before[1:] = ids[:-1]
        before[::length] = 0
        both = np.sort(before << np.uint32(16) | ids)
        at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        n = np.diff(np.append(at, len(both)))
        context, symbol = (both[at] >> np.uint32(16)).astype(np.int64), (both[at] & np.uint32(0xFFFF)).astype(np.int64)
        c0 = np.bincount(symbol, n, 1 << 16).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        sizes = np.diff(np.append(first, len(context)))
        saved = n * np.log2(n / np.repeat(np.add.reduceat(n, first), sizes) * len(ids) / c0[symbol])
        pays = np.add.reduceat(saved, first) > ROOM * sizes + 32
        keep, used = np.repeat(pays, sizes), np.flatnonzero(c0)
        return cls(context[first[pays]], np.concatenate([[len(used)], sizes[pays]]), np.concatenate([used, symbol[keep]]), np.concatenate([c0[used], n[keep]]))

    def dump(self) -> bytes:
        symbols, counts = self.told
        planes = counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
        head = struct.pack("<II", len(self.sizes), len(symbols))
        return zlib.compress(b"".join([head, self.contexts.astype("<u2").tobytes(), self.sizes.astype("<u4").tobytes(), symbols.astype("<u2").tobytes(), planes]))

    @classmethod
    def load(cls, data: bytes) -> Tables:
        data = zlib.decompress(data)
        rows, n = struct.unpack_from("<II", data)
        parts, at = [], 8
        for kind, k in (("<u2", rows - 1), ("<u4", rows), ("<u2", n)):
            parts.append(np.frombuffer(data, kind, k, at).astype(np.int64))
            at += k * int(kind[-1])
        counts = np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel()
        return cls(*parts, counts.astype(np.int64))

    def find(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The entries of symbols after contexts."""
        if self.square is not None:
            return self.square[self.row[context], self.rank[symbol]]
        return self.place[np.searchsorted(self.key, self.row[context] << 16 | symbol)]

    def at(self, context: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The entries whose intervals in the rows of contexts hold the values."""
        bucket = (self.row[context] << 8) + (value >> np.uint64(8)).view(np.int64)
        e = self.guess[bucket]
        far = np.flatnonzero(self.stop[e] <= value)
        if len(far):
            low, high, v = e[far] + 1, self.guess[bucket[far] + 1], value[far]
            while (open_ := low < high).any():
                middle = low + high >> 1
                past = self.stop[middle] <= v
                low = np.where(open_ & past, middle + 1, low)
                high = np.where(past, high, middle)
            e[far] = low
        return e


# --- the model: everything below works on `lanes` blocks at once ---


class Model:
    """Statistics of events (second-order prediction right, first-order prediction right, neither) up to the last chunk."""

    def __init__(self, lanes: int):
        self.lanes, self.lane = lanes, np.arange(lanes)
        self.events = [np.full((lanes, k, 3), 4) for k in (1, 3, 3)]  # by order: confidence, event
        self.weights = np.full((lanes, 3), 1 << EVENT)
        self.renew()

    def renew(self) -> None:
        total = 1 << EVENT
        self.parts = [(e * total) // e.sum(axis=2, keepdims=True) for e in self.events]
        w, (p0, p1, p2) = self.weights[:, :, None, None, None], self.parts
        mixed = (w[:, 0] * p0[:, :, None, :] + w[:, 1] * p1[:, None, :, :] + w[:, 2] * p2[:, :, None, :]).reshape(-1, 3)
        f = mixed * (total - 3) // mixed.sum(axis=1, keepdims=True) + 1
        f[np.arange(len(f)), f.argmax(axis=1)] += total - f.sum(axis=1)
        # where the second and the third event begin, at 9 * lane + 3 * confidence2 + confidence1
        self.second, self.third = (np.ascontiguousarray(x).view(np.uint64) for x in (f[:, 0], f[:, 0] + f[:, 1]))

    def advance(self, event: np.ndarray, context: np.ndarray) -> None:
        """Adds a chunk (ids x lanes)."""
        n, lane = len(event), np.broadcast_to(self.lane, event.shape).ravel()
        e, c = event.ravel().astype(np.int64), context.ravel().astype(np.int64)
        for order, k in ((0, 0), (1, c % 3), (2, c // 3)):
            width = self.events[order].shape[1]
            counts = np.bincount((lane * width + k) * 3 + e, minlength=self.lanes * width * 3).reshape(self.events[order].shape)
            self.weights[:, order] = (self.weights[:, order] >> 1) + (counts * self.parts[order]).sum(axis=(1, 2)) // n + 40
            self.events[order] += counts
        self.renew()


def _slots(prev2: np.ndarray, prev1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint32(32 - SLOTS)
    b = prev1 * np.uint32(0x85EBCA77)
    return (prev2 * np.uint32(0x9E3779B1) ^ b) * np.uint32(0xC2B2AE3D) >> shift, b * np.uint32(0x9E3779B1) >> shift


_LOW16, _BITS16, _ONE = np.uint32(0xFFFF), np.uint32(16), np.uint32(1)


class Recent:
    """What followed each context last (the low 16 bits) and its confidence (above them). An empty slot predicts 65535 without confidence."""

    def __init__(self, lanes: int):
        self.rows = np.full(lanes << SLOTS, _LOW16)
        self.base = (np.arange(lanes) << SLOTS).astype(np.uint32)

    def ask(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = self.base + slot
        x = self.rows[at]
        return at, x & _LOW16, x >> _BITS16

    def learn(self, at: np.ndarray, ids: np.ndarray, right: np.ndarray) -> None:
        """Confidence 1 after a new prediction, 2 once it was right."""
        self.rows[at] = ids | (right + _ONE) << _BITS16


# --- the range coder: an interval of 48 bits, moved on by 16 ---

_TOP, _LEAST, _REST = np.uint64(1 << 48), np.uint64(1 << 32), np.uint64((1 << 32) - 1)
_WORD, _HIGH, _EVENT, _ID = np.uint64(16), np.uint64(32), np.uint64(EVENT), np.uint64(ID)
_ALL_EVENTS, _ALL_IDS, _NONE = np.uint64(1 << EVENT), np.uint64(1 << ID), np.uint64(0)


class RangeEncoder:
    def __init__(self, lanes: int, room: int):
        self.low, self.range, self.n = np.zeros(lanes, np.uint64), np.full(lanes, _TOP), np.zeros(lanes, np.int64)
        self.out = np.zeros((lanes, room), np.uint32)

    def narrow(self, start: np.ndarray, size: np.ndarray, bits: np.uint64) -> None:
        r = self.range >> bits
        self.low += start * r
        r *= size
        self.range = r

    def move(self) -> None:
        """Writes out what is settled. A carry goes to the word written last; finish() carries it on."""
        if self.low.max() >= _TOP:
            over = np.flatnonzero(self.low >= _TOP)
            self.out[over, self.n[over] - 1] += _ONE
            self.low[over] -= _TOP
        at = np.flatnonzero(self.range < _LEAST)
        while len(at):
            low, r, n = self.low[at], self.range[at] << _WORD, self.n[at]
            self.out[at, n] = low >> _HIGH
            self.low[at], self.range[at], self.n[at] = (low & _REST) << _WORD, r, n + 1
            at = at[r < _LEAST]

    def finish(self) -> list[bytes]:
        every = np.arange(len(self.low))
        for shift in (32, 16, 0):
            self.out[every, self.n] = (self.low >> np.uint64(shift)) & np.uint64(0xFFFF)
            self.n += 1
        for k in range(int(self.n.max()) - 1, 0, -1):
            self.out[:, k - 1] += self.out[:, k] >> _BITS16
        words = self.out.astype("<u2")
        return [words[i, :k].tobytes() for i, k in enumerate(self.n.tolist())]


class RangeDecoder:
    """Keeps the code relative to where the interval starts."""

    def __init__(self, data: list[bytes]):
        sizes = np.array([len(d) // 2 for d in data], np.int64)
        self.words = np.frombuffer(b"".join(data) + bytes(16), "<u2").astype(np.uint64)
        at = np.cumsum(sizes) - sizes
        self.range, self.at = np.full(len(data), _TOP), at + 3
        self.code = self.words[at] << _HIGH | self.words[at + 1] << _WORD | self.words[at + 2]

    def value(self, bits: np.uint64) -> np.ndarray:
        self.range >>= bits
        return np.minimum(self.code // self.range, (np.uint64(1) << bits) - np.uint64(1))

    def narrow(self, start: np.ndarray, size: np.ndarray) -> None:
        """After value(), which has divided the interval."""
        self.code -= start * self.range
        self.range *= size

    def move(self) -> None:
        at = np.flatnonzero(self.range < _LEAST)
        while len(at):
            r, n = self.range[at] << _WORD, self.at[at]
            self.code[at] = self.code[at] << _WORD | self.words[np.minimum(n, len(self.words) - 1)]
            self.range[at], self.at[at] = r, n + 1
            at = at[r < _LEAST]


def encode_blocks(ids: np.ndarray, tables: Tables) -> list[bytes]:
    """Payloads of the rows of ids (blocks of one length)."""
    lanes, n = ids.shape
    ids = np.ascontiguousarray(ids.T).astype(np.uint32)
    past = np.concatenate([np.zeros((2, lanes), np.uint32), ids])
    model, coder = Model(lanes), RangeEncoder(lanes, 2 * n + 8)
    second, first, place = Recent(lanes), Recent(lanes), 9 * np.arange(lanes)
    for at in range(0, n, CHUNK):
        now, prev1, prev2 = (past[at + k : min(n, at + CHUNK) + k] for k in (2, 1, 0))
        event, context = np.empty(now.shape, np.uint8), np.empty(now.shape, np.uint32)
        for x, e, c, s2, s1 in zip(now, event, context, *_slots(prev2, prev1)):
            at2, p2, k2 = second.ask(s2)
            at1, p1, k1 = first.ask(s1)
            right2, right1 = p2 == x, p1 == x
            second.learn(at2, x, right2)
            first.learn(at1, x, right1)
            np.multiply(k2, np.uint32(3), out=c)
            c += k1
            e[:] = 2 - (right1 | right2)
            e[right2] = 0
        where = place + context
        a, b = model.second[where], model.third[where]
        start, end = np.where(event == 0, _NONE, np.where(event == 1, a, b)), np.where(event == 0, a, np.where(event == 1, b, _ALL_EVENTS))
        entry, told = tables.find(prev1, now), event < 2  # the whole interval stands for an id that its event tells
        begin, size = np.where(told, _NONE, tables.start[entry]), np.where(told, _ALL_IDS, tables.freq[entry])
        end -= start
        for s, f, i, g in zip(start, end, begin, size):
            coder.narrow(s, f, _EVENT)
            coder.narrow(i, g, _ID)
            coder.move()
        if at + CHUNK < n:
            model.advance(event, context)
    return coder.finish()


def decode_blocks(data: list[bytes], n: int, tables: Tables) -> np.ndarray:
    """The ids of blocks of n (blocks x n)."""
    lanes = len(data)
    model, coder = Model(lanes), RangeDecoder(data)
    ids = np.zeros((n, lanes), np.uint32)
    second, first, place = Recent(lanes), Recent(lanes), 9 * np.arange(lanes)
    prev2 = prev1 = np.zeros(lanes, np.uint32)
    for at in range(0, n, CHUNK):
        width = min(CHUNK, n - at)
        event, context = np.empty((width, lanes), np.uint8), np.empty((width, lanes), np.uint32)
        for t in range(width):
            s2, s1 = _slots(prev2, prev1)
            at2, p2, k2 = second.ask(s2)
            at1, p1, k1 = first.ask(s1)
            c = context[t]
            np.multiply(k2, np.uint32(3), out=c)
            c += k1
            where = place + c
            a, b = model.second[where], model.third[where]
            v = coder.value(_EVENT)
            past1, past2 = v >= a, v >= b
            np.add(past1, past2, out=event[t], dtype=np.uint8, casting="unsafe")
            start = np.where(past2, b, np.where(past1, a, _NONE))
            coder.narrow(start, np.where(past2, _ALL_EVENTS, np.where(past1, b, a)) - start)
            v = coder.value(_ID)
            e = tables.at(prev1, v)
            coder.narrow(np.where(past2, tables.start[e], _NONE), np.where(past2, tables.freq[e], _ALL_IDS))
            coder.move()
            x = ids[at + t]
            x[:] = np.where(past2, tables.symbols[e], np.where(past1, p1, p2))
            second.learn(at2, x, p2 == x)
            first.learn(at1, x, p1 == x)
            prev2, prev1 = prev1, x
        if at + width < n:
            model.advance(event, context)
    return np.ascontiguousarray(ids.T)


# --- files ---


def write_file(doc_ids: list, lengths: list[int], ids: np.ndarray, before: int = 0) -> bytes:
    """MAGIC; ids of the part before this file, numbers of documents, ids, blocks and their length; the tables; (present,
    doc_id, length) of each document; (payload length, crc) of each block; payloads. The last block is filled up with zeros."""
    n = len(ids)
    length = min(BLOCK, n)
    blocks = -(-n // length)
    full = np.zeros(blocks * length, np.uint16)
    full[:n] = ids
    tables, full = Tables.of(full, length), full.reshape(blocks, length)
    payloads = [p for b in range(0, blocks, LANES) for p in encode_blocks(full[b : b + LANES], tables)]
    crcs = [zlib.crc32(ids[i : i + length].astype("<u4").tobytes()) for i in range(0, n, length)]
    table_bytes = tables.dump()
    docs = zlib.compress(b"".join(struct.pack("<?qQ", d is not None, d or 0, k) for d, k in zip(doc_ids, lengths)))
    head = struct.pack("<QQQIIII", before, len(doc_ids), n, blocks, length, len(table_bytes), len(docs))
    return b"".join([MAGIC, head, table_bytes, docs, *(struct.pack("<II", len(p), c) for p, c in zip(payloads, crcs)), *payloads])


def read_file(data: bytes) -> tuple[int, list, np.ndarray, np.ndarray]:
    """Ids of the part before this file; doc_ids, lengths and all ids."""
    if data[:6] != MAGIC:
        raise ValueError("not a token file")
    before, _, n, blocks, length, table_size, docs_size = struct.unpack_from("<QQQIIII", data, 6)
    at = 6 + struct.calcsize("<QQQIIII")
    tables = Tables.load(data[at : at + table_size])
    docs = list(struct.iter_unpack("<?qQ", zlib.decompress(data[at + table_size : at + table_size + docs_size])))
    at += table_size + docs_size
    sizes = list(struct.iter_unpack("<II", data[at : at + 8 * blocks]))
    at += 8 * blocks
    ends = (at + np.cumsum([s for s, _ in sizes])).tolist()
    payloads = [data[a:b] for a, b in zip([at, *ends[:-1]], ends)]
    ids = np.concatenate([decode_blocks(payloads[b : b + LANES], length, tables).astype(np.uint16) for b in range(0, blocks, LANES)]).ravel()[:n]
    for i, (_, crc) in enumerate(sizes):
        if zlib.crc32(ids[i * length : (i + 1) * length].astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {i} does not match its checksum")
    return before, [d if has else None for has, d, _ in docs], np.array([k for *_, k in docs], np.int64), ids


def qualified(spark, path: str) -> str:
    """path with its scheme, the default file system's where it has none: a path that every executor resolves alike."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub(r"^file:/+", "file:///", p)


#: What Spark calls a scheme and what Arrow calls it.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def arrow_uri(path: str) -> str:
    scheme, colon, rest = path.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}{colon}{rest}"


def write_token_files(documents: DataFrame, path: str, tokenizer: str | None = None) -> dict[int, int]:
    """Writes path/part-NNNNNN-NNNNN.cmrc in ascending doc_id order; gives the ids of each part."""
    spark, tok = documents.sparkSession, tokenizer or default_tokenizer()
    path = qualified(spark, path)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("m"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("m")]  # the last for repeated rows, of which any order is the same

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(arrow_uri(path))
        task, t = TaskContext.get(), worker_encoder(tok)
        part, seq, before = task.partitionId(), 0, 0
        docs, lengths, ids, held = [], [], [], 0

        def close():
            nonlocal seq, before, held
            store.create_dir(base, recursive=True)
            name, mine = f"{base}/part-{part:06d}-{seq:05d}.cmrc", f"{base}/.part-{part:06d}-{seq:05d}-{task.taskAttemptId()}"
            with store.open_output_stream(mine) as f:
                f.write(write_file(docs, lengths, np.frombuffer(b"".join(ids), "<u2"), before))
            try:
                store.move(mine, name)  # a lost attempt leaves no file of this name
            except OSError:
                if store.get_file_info(name).type == fs.FileType.NotFound:
                    raise
                store.delete_file(mine)  # another attempt has written the same
            before, seq, held = before + held, seq + 1, 0
            for x in (docs, lengths, ids):
                x.clear()

        for rows in slices(batches, 128):
            for doc_id, b in zip(rows.column(0).to_pylist(), t.encode(rows.column(1).to_pylist())):
                docs.append(doc_id)
                lengths.append(len(b) // 2)
                ids.append(b)
                held += len(b) // 2
                if held >= FILE_IDS:
                    close()
        if held:
            close()
        if before:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64())], names=["part", "n"])

    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return {r["part"]: r["n"] for r in dealt.mapInArrow(trimmed(write), "part int, n long").collect()}


def read_token_files(spark, path: str, parts: dict[int, int]) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 16-bit) of every document."""
    starts, at = {}, 0
    for part in sorted(parts):
        starts[part] = at
        at += parts[part]

    def run(batches):
        for file in slices(batches, 1):
            before, docs, lengths, ids = read_file(file.column("content")[0].as_py())
            first = starts[int(re.search(r"part-(\d+)-\d+\.cmrc", file.column("path")[0].as_py())[1])] + before
            ends = np.cumsum(lengths)
            data = ids.astype("<u2").tobytes()
            for k in range(0, len(docs), 2048):
                part = slice(k, k + 2048)
                pieces = [data[2 * a : 2 * b] for a, b in zip((ends - lengths)[part].tolist(), ends[part].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs[part], pa.int64()), pa.array((ends - lengths)[part] + first), pa.array(lengths[part]), pa.array(pieces, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.cmrc").load(path).select("path", "content")
    return files.mapInArrow(trimmed(run), "doc_id long, start long, n_tokens long, ids binary")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex}"
    parts = write_token_files(table(spark, sf_dir, "documents"), path)

    def run(batches):
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(b, "<u2").astype("<u4").tobytes()) for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    if not parts:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, path, parts).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
