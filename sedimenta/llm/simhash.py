"""SimHash near-duplicates: fingerprints of three-word shingles, linked at two or fewer differing bits.

Equal fingerprints are one class, so copies cost a row each and no pair. Two fingerprints that differ in at most
two of 64 bits agree in at least two of four 16-bit blocks; each of the six pairs of blocks is a key, and only
classes under one key are compared. A key with many classes is split into parts and each pair of parts is a
group of its own, so that no task holds more than two parts. In a group the fingerprints stand as 64 bit planes;
carry-save counters add the differing planes for many pairs in one step, and a block of pairs is abandoned once all
its counters have passed the radius. A group emits links of a spanning forest, not its pairs, and components come
from alternating star steps over tables in the shared folder.

Texts without words have the fingerprint zero; they are linked like any other. Null ids keep their row and are
ignored when the smallest id of a component is chosen. keep_one knows rows by id, text and columns, not by id alone.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import LOWER, SPACE_WORDS_B, apart, dropped, saved, table, trimmed

RADIUS, SHINGLE, SEED = 2, 3, 42
BLOCKS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))
#: Classes of a key in one part, and fingerprints compared in one batch.
PART, BATCH = 1024, 512


def fingerprint(text: str | None) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes; a hash is XXH64 with seed 42."""
    from xxhash import xxh64_intdigest

    words = SPACE_WORDS_B.findall(text.encode().translate(LOWER)) if text else []
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    totals = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        end = min(n, at + 4096)
        part = words[at : end + SHINGLE - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(part)]
        h = np.array([xxh64_intdigest(g, SEED) for g in grams], np.uint64)
        totals += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(totals * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, text_key: Column | None = None, row_key: Column | None = None) -> DataFrame:
    """doc_id, text_key and row_key (null unless given), and fp, the fingerprint as a signed long, of every row."""

    def run(batches):
        kind = pa.schema([("doc_id", pa.int64()), ("text_key", pa.string()), ("row_key", pa.int64()), ("fp", pa.int64())])
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                fps = np.array([fingerprint(t) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(fps.view(np.int64))], schema=kind)

    keys = [F.lit(None).cast(k).alias(n) if c is None else c.alias(n) for c, k, n in ((text_key, "string", "text_key"), (row_key, "long", "row_key"))]
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), *keys, "text").mapInArrow(trimmed(run), "doc_id long, text_key string, row_key long, fp long")


def near_pairs(fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions i < j of fingerprints (unsigned 64-bit) that differ in at most `radius` bits (3 at most), by bit slices."""
    m = len(fp)
    words = -(-m // 64)
    bits = np.unpackbits(fp.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").astype(bool)
    padded = np.zeros((64, words * 64), bool)
    padded[:, :m] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)  # plane b: bit b of all fingerprints
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    ones, twos, past = (np.zeros((m, words), np.uint64) for _ in range(3))
    live = np.arange(m)
    for b in range(64):
        x = planes[b][None, :] ^ np.where(bits[live, b], full, np.uint64(0))[:, None]
        carry = ones & x
        ones ^= x
        past |= twos & carry
        twos ^= carry
        over = past | ((twos & ones) if radius == 2 else twos if radius == 1 else (twos | ones) if radius == 0 else np.uint64(0))
        if b % 8 == 7:  # rows whose every counter has passed the radius are abandoned; one's own counter never does
            over[np.arange(len(live)), live // 64] |= np.uint64(1) << (live % 64).astype(np.uint64)
            going = (over != full).any(axis=1)
            if not going.all():
                live, ones, twos, past, over = live[going], ones[going], twos[going], past[going], over[going]
                if not len(live):
                    break
    if not len(live):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    near = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")[:, :m]
    r, j = np.nonzero(near)
    i = live[r]
    return i[i < j], j[i < j]


def _forest(group: np.ndarray, fp: np.ndarray):
    """Links (larger, smaller) of a spanning forest of each group's near pairs."""
    i, j = near_pairs(fp)
    same = group[i] == group[j]
    root = list(range(len(fp)))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in zip(i[same].tolist(), j[same].tolist()):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    top = np.array([find(a) for a in range(len(fp))])
    own = np.flatnonzero(top != np.arange(len(fp)))
    return fp.view(np.int64)[own], fp.view(np.int64)[top[own]]


def links(classes: DataFrame, part: int = PART) -> DataFrame:
    """classes: distinct fp. Links (a, b) whose components are those of all pairs within the radius."""
    block = [F.expr(f"(fp >> {16 * k}) & 65535") for k in range(4)]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), (block[i] * 65536 + block[j]).alias("k")) for t, (i, j) in enumerate(BLOCKS)])
    keyed = classes.select("fp", F.explode(keys).alias("_")).select("fp", "_.t", "_.k")
    shared = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    many = keyed.join(apart(shared), ["t", "k"])
    parts = F.ceil(F.col("n") / part).cast("int")
    mine = F.pmod(F.xxhash64("fp", "t"), parts.cast("long")).cast("int")
    pairs = many.select("fp", "t", "k", parts.alias("p"), mine.alias("m")).select("fp", "t", "k", "m", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("o"))
    grouped = pairs.select("fp", "t", "k", F.least("m", "o").alias("g"), F.greatest("m", "o").alias("h"))

    def run(batches):
        kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        fps, groups, n = [], [], 0

        def out():
            a, b = _forest(np.array(groups), np.array(fps, np.int64).view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=kind)

        for _, members in groupby(rows(), key=lambda r: r[1:]):
            own = [r[0] for r in members]
            if len(own) > 1:
                fps, groups, n = fps + own, groups + [n] * len(own), n + 1
            if len(fps) >= BATCH:
                yield out()
                fps, groups = [], []
        if fps:
            yield out()

    dealt = grouped.repartition("t", "k", "g", "h").sortWithinPartitions("t", "k", "g", "h", "fp")
    return dealt.mapInArrow(trimmed(run), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label of every linked node; the label is the component's smallest node. Alternates large and small stars."""
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    while True:
        # large star: each node's larger neighbours go to its smallest neighbour or itself
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(apart(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: each node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(apart(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        new = saved(small, "links")
        changed = new.join(apart(now), ["u", "v"], "left_anti").limit(1).count() or now.join(apart(new), ["u", "v"], "left_anti").limit(1).count()
        dropped(now)
        now = new
        if not changed:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    own = saved(fingerprints(documents), "fingerprints")
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    label = saved(components(links(classes.select("fp"))), "labels")
    linked = label.join(apart(classes), label["node"] == classes["fp"]).select("fp", "label", "first_id")
    first = linked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    alone = classes.join(apart(label), classes["fp"] == label["node"], "left_anti").select("fp", F.col("first_id").alias("component_id"))
    of = alone.unionByName(linked.join(apart(first), "label").select("fp", "component_id"))
    return own.join(apart(of), "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """documents, all columns, with one row of each component: the one of the smallest id, null ids last. Of several
    such rows the one that comes first by fingerprint and by hashes of its text and its columns stays."""
    import uuid

    mark = f"_{uuid.uuid4().hex[:8]}"
    hashed = [f.name for f in documents.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    # rows equal in all three keys are repeats of one row, and any of them can stand for it
    keys = {f"{mark}i": F.col("doc_id").cast("long"), f"{mark}t": F.coalesce(F.md5("text"), F.lit("")), f"{mark}r": F.xxhash64(*hashed)}
    own = saved(fingerprints(documents, keys[f"{mark}t"], keys[f"{mark}r"]), "fingerprints")
    label = saved(components(links(own.select("fp").distinct())), "labels")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp", "text_key", "row_key")
    one = own.join(apart(label), own["fp"] == label["node"], "left").groupBy(F.coalesce("label", "fp").alias("label")).agg(F.min(row).alias("_"))
    one = one.select(F.col("_.doc_id").alias("i"), F.col("_.text_key").alias("t"), F.col("_.row_key").alias("r"))
    keyed = documents.withColumns(keys)
    once = keyed.join(apart(one), keyed[f"{mark}i"].eqNullSafe(one["i"]) & (keyed[f"{mark}t"] == one["t"]) & (keyed[f"{mark}r"] == one["r"]), "left_semi")
    return once.dropDuplicates(list(keys)).drop(*keys)
