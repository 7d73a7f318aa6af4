"""Embedding near-duplicates by PCA-ordered tiled comparison: every pair of equal label whose cosine reaches a threshold.

Equal vectors of a label are one class, so copies cost a row each and no pair. Unit vectors are turned into a basis of
principal directions, greatest first; turning changes no cosine, so the basis (fitted on at most SAMPLE_ROWS vectors)
decides how fast the search is and nothing else. Classes are put in order along the leading directions and cut into
tiles of bounded bytes. Two tiles meet only if their boxes are no further apart than two vectors that link can be. In
a pair of tiles the leading directions are multiplied first; what the rest can add is at most the product of the norms
that are left, and a block is given up, or a pair dropped, once the cosine cannot reach the threshold. What is left is
computed from the vectors as given, in doubles, and that decides.

A pair of tiles emits how many vectors each class links to, and a spanning forest of its links, never the pairs, so
a crowd of similar vectors costs rows in proportion to its size. Components come from alternating stars.

Vectors that are null, zero or empty or hold a null or non-finite component, and vectors without a label, link with
nothing. Vectors of different length do not link. Each row counts as a vector of its own, repeated ones too. Rows
without vec_id are linked and counted, but are no smallest id; a component of them alone has the id null and keeps
them. Links at exactly the threshold count. Empty tables give no rows; other columns are not read. A very long vector
makes a tile of few rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import join_classes, saved, table, trimmed
from sedimenta.llm.simhash import components

THRESHOLD = 0.93
#: Vectors that the basis is fitted on; bytes and rows of a tile; rows of a block within it.
SAMPLE_ROWS, TILE_BYTES, TILE_ROWS, INNER = 4096, 1 << 20, 2048, 256
#: Directions by which classes are ordered, by which boxes are compared, and by which tiles are looked up.
ORDERED, BOXED, LOOKED_UP = 4, 8, 2
#: Bounds are let pass by this much more than rounding can make of them.
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / norm[:, None]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows whose square would leave the range of doubles are divided by their greatest component."""
    with np.errstate(over="ignore", under="ignore"):
        square = np.einsum("ij,ij->i", x, x)
    odd = ~((square > 1e-250) & (square < 1e250))
    return np.where(odd[:, None], x / np.abs(x).max(axis=1, keepdims=True), x) if odd.any() else x


def principal(sample: np.ndarray) -> np.ndarray:
    """Orthogonal columns in falling order of the second moment of unit vectors along them."""
    u = unit(scaled(sample))
    return np.linalg.eigh(u.T @ u)[1][:, ::-1].copy()


def turned(x: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    """Unit vectors in the basis; a basis of another length is none."""
    u = unit(scaled(x))
    return u @ basis if basis is not None and len(basis) == x.shape[1] else u


def place(u: np.ndarray) -> np.ndarray:
    """A number by which vectors near each other in the leading directions mostly come together: bits in turn."""
    cell = np.clip(((u[:, :ORDERED] + 1) * 32).astype(np.int64), 0, 63)
    out = np.zeros(len(u), np.int64)
    for bit in range(5, -1, -1):
        for d in range(cell.shape[1]):
            out = out << 1 | cell[:, d] >> bit & 1
    return out


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root (each node's representative, smaller or itself) after joining the nodes i[k] and j[k]."""
    while True:
        while (root != root[root]).any():
            root = root[root]
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return root
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))


def near_pairs(x: np.ndarray, y: np.ndarray, basis: np.ndarray | None, threshold: float, same: bool):
    """Yields (i, j), row numbers of x and y whose cosine reaches the threshold; same: y is x, and only i < j."""
    u, v = turned(x, basis), turned(y, basis)
    x, y = scaled(x), scaled(y)
    dims = u.shape[1]
    ends = [e for e in (8, 16, 32, 64, 128, 256, 512) if e < dims] + [dims]
    left = lambda w: [np.sqrt(np.maximum(0, np.einsum("ij,ij->i", w[:, e:], w[:, e:]))) for e in ends]
    rest_u, rest_v = left(u), left(v)
    norm_x, norm_y = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y))
    need, apart = threshold - SLACK, 2 * (1 - threshold) + SLACK
    box = lambda w: [(w[a : a + INNER, :BOXED].min(axis=0), w[a : a + INNER, :BOXED].max(axis=0)) for a in range(0, len(w), INNER)]
    box_u, box_v = box(u), box(v)
    for p, (low, high) in enumerate(box_u):
        for q in range(p if same else 0, len(box_v)):
            gap = np.maximum(0, np.maximum(low - box_v[q][1], box_v[q][0] - high))
            if gap @ gap > apart:
                continue
            a, b = slice(p * INNER, (p + 1) * INNER), slice(q * INNER, (q + 1) * INNER)
            dot = u[a, : ends[0]] @ v[b, : ends[0]].T
            alive = dot + rest_u[0][a, None] * rest_v[0][None, b] >= need
            if same and p == q:
                alive = np.triu(alive, 1)
            k = 1
            while k < len(ends) and 8 * np.count_nonzero(alive) > alive.size:  # many are left: all of the block go on
                dot += u[a, ends[k - 1] : ends[k]] @ v[b, ends[k - 1] : ends[k]].T
                alive &= dot + rest_u[k][a, None] * rest_v[k][None, b] >= need
                k += 1
            i, j = np.nonzero(alive)
            s = dot[i, j]
            i, j = i + p * INNER, j + q * INNER
            while k < len(ends) and len(i):  # few are left: one by one
                s = s + np.einsum("ij,ij->i", u[i, ends[k - 1] : ends[k]], v[j, ends[k - 1] : ends[k]])
                go = s + rest_u[k][i] * rest_v[k][j] >= need
                i, j, s, k = i[go], j[go], s[go], k + 1
            for at in range(0, len(i), 8192):
                r, c = i[at : at + 8192], j[at : at + 8192]
                yes = np.einsum("ij,ij->i", x[r], y[c]) / (norm_x[r] * norm_y[c]) >= threshold
                if yes.any():
                    yield r[yes], c[yes]


def vector_classes(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can link (vec_id, label, embedding), and the others' vec_id."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    fit = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    return rows.where(fit), rows.where(~fit).select("vec_id")


def basis_of(classes: DataFrame) -> np.ndarray | None:
    """Principal directions of a sample, of its most common length."""
    sample = [r[0] for r in classes.select("embedding").orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE_ROWS).collect()]
    if not sample:
        return None
    lengths = [len(x) for x in sample]
    common = max(set(lengths), key=lambda n: (lengths.count(n), n))
    return principal(np.array([x for x in sample if len(x) == common], float))


def tiles_of(classes: DataFrame, basis: np.ndarray | None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """tile, label, dims, ids (classes), sizes, vectors (doubles, row by row), and the box (low, high) of the leading directions."""
    spark = classes.sparkSession
    shipped = spark.sparkContext.broadcast(basis)

    def with_place(batches):
        for batch in batches:
            out, at = np.zeros(batch.num_rows, np.int64), batch.column("embedding")
            lengths = at.value_lengths().to_numpy()
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                x = at.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
                out[rows] = place(turned(x, shipped.value))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "place"])

    kind = pa.schema([("label", pa.string()), ("dims", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("vectors", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])

    def cut(batches):
        key, ids, sizes, rows = None, [], [], []

        def out():
            x = np.concatenate(rows).reshape(-1, key[1])
            lead = turned(x, shipped.value)[:, :BOXED]
            row = [key[0]], [key[1]], [np.concatenate(ids)], [np.concatenate(sizes)], [x.tobytes()], [lead.min(axis=0)], [lead.max(axis=0)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, kind)], schema=kind)

        for batch in batches:
            labels, dims = batch.column("label").to_pylist(), batch.column("dims").to_pylist()
            at = 0
            while at < batch.num_rows:
                own = (labels[at], dims[at])
                if key is not None and (own != key or sum(map(len, ids)) >= bound):
                    yield out()
                    ids, sizes, rows = [], [], []
                key, bound = own, max(1, min(tile_rows, TILE_BYTES // (8 * own[1])))
                end, most = at + 1, at + bound - sum(map(len, ids))
                while end < min(batch.num_rows, most) and (labels[end], dims[end]) == key:
                    end += 1
                part = batch.slice(at, end - at)
                ids.append(part.column("cls").to_numpy())
                sizes.append(part.column("n").to_numpy())
                rows.append(part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float))
                at = end
        if ids:
            yield out()

    wide = "cls long, label string, dims int, n long, embedding array<double>, place long"
    placed = classes.select("cls", "label", F.size("embedding").alias("dims"), "n", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(trimmed(with_place), wide)
    order = ["label", "dims", "place", F.xxhash64("cls"), "cls"]  # one place may hold any number of classes
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    made = dealt.mapInArrow(trimmed(cut), "label string, dims int, ids array<long>, sizes array<long>, vectors binary, low array<double>, high array<double>")
    return made.withColumn("tile", F.monotonically_increasing_id())


def tile_pairs(tiles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a <= b, tiles of one label whose boxes are no further apart than two linked unit vectors can be.

    Tiles meet in cells of that width: one side in those that its box covers, the other in those that come near it; a
    pair counts in the first cell that both are in.
    """
    reach = (2 * (1 - threshold) + SLACK) ** 0.5
    looked_up = [F.least(F.lit(LOOKED_UP), F.size("low")) > d for d in range(LOOKED_UP)]

    def cells(low, high):
        sides = [F.when(looked_up[d], F.sequence(F.floor(F.get(low, d) / reach), F.floor(F.get(high, d) / reach))).otherwise(F.array(F.lit(0).cast("long"))) for d in range(LOOKED_UP)]
        return F.flatten(F.transform(sides[0], lambda c0: F.transform(sides[1], lambda c1: F.struct(c0.alias("c0"), c1.alias("c1")))))

    near = F.transform("low", lambda x: x - reach), F.transform("high", lambda x: x + reach)
    left = tiles.select("label", "dims", F.col("tile").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"), F.explode(cells(F.col("low"), F.col("high"))).alias("cell"))
    right = tiles.select("label", "dims", F.col("tile").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb"), F.explode(cells(*near)).alias("cell"))
    first = [F.coalesce(F.floor(F.greatest(F.get("la", d), F.get("lb", d) - reach) / reach), F.lit(0)) for d in range(LOOKED_UP)]
    gaps = F.zip_with(F.zip_with("la", "hb", lambda p, q: p - q), F.zip_with("lb", "ha", lambda p, q: p - q), lambda p, q: F.pow(F.greatest(F.lit(0.0), p, q), 2))
    far = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)
    met = left.join(right, ["label", "dims", "cell"]).where((F.col("a") <= F.col("b")) & (far <= reach**2 + SLACK))
    return met.where((F.col("cell.c0") == first[0]) & (F.col("cell.c1") == first[1])).select("a", "b")


def linked(tiles: DataFrame, basis: np.ndarray | None, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (cls, n): a class links to n vectors of other classes of a tile; and rows (cls, other) of a spanning forest."""
    spark = tiles.sparkSession
    shipped = spark.sparkContext.broadcast(basis)
    kind = pa.schema([("cls", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                of = lambda c: row.column(c)[0]
                same, dims = of("a").as_py() == of("b").as_py(), of("dims").as_py()
                x, y = (np.frombuffer(of(c).as_buffer(), float).reshape(-1, dims) for c in ("x", "y"))
                ids = [of(c).values.to_numpy() for c in ("ids", "ids_b")]
                sizes = [of(c).values.to_numpy() for c in ("sizes", "sizes_b")]
                shift = 0 if same else len(x)
                n, root = np.zeros(len(x) + (0 if same else len(y)), np.int64), np.arange(len(x) + (0 if same else len(y)))
                for i, j in near_pairs(x, y, shipped.value, threshold, same):
                    np.add.at(n, i, sizes[1][j])
                    np.add.at(n, j + shift, sizes[0][i])
                    root = joined(root, i, j + shift)
                own = ids[0] if same else np.concatenate(ids)
                some, inner = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(root)))
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(own[some]), pa.nulls(len(some), pa.int64()), pa.array(n[some])], schema=kind)
                    yield pa.RecordBatch.from_arrays([pa.array(own[inner]), pa.array(own[root[inner]]), pa.nulls(len(inner), pa.int64())], schema=kind)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = tile_pairs(tiles, threshold).repartition(parts, "a", "b")
    one = tiles.select(F.col("tile").alias("a"), "dims", "ids", "sizes", F.col("vectors").alias("x"))
    two = tiles.select(F.col("tile").alias("b"), F.col("ids").alias("ids_b"), F.col("sizes").alias("sizes_b"), F.col("vectors").alias("y"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(trimmed(run), "cls long, other long, n long")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links (other vectors of the label whose cosine reaches the threshold), component_id and kept of every row."""
    rows, alone = vector_classes(embeddings)
    grouped = rows.groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
    classes = saved(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    basis = basis_of(classes)
    tiles = saved(tiles_of(classes, basis), "tiles")
    found = saved(linked(tiles, basis, threshold), "linked")
    links = found.where("n IS NOT NULL").groupBy("cls").agg(F.sum("n").alias("others"))
    label = saved(components(found.where("other IS NOT NULL").select(F.col("cls").alias("a"), F.col("other").alias("b"))), "labels")
    small = classes.select("cls", "n", "first_id").join(links, "cls", "left").join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("top", F.coalesce("label", "cls"))
    first = small.groupBy("top").agg(F.min("first_id").alias("component_id"))
    of = small.join(first, "top").select("cls", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    known = classes.select("cls", "label", "embedding", "n").join(of, "cls").select("label", "embedding", "n", "n_links", "component_id")
    out = join_classes(rows, known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
