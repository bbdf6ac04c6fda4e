"""Operator 4: near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steelyard.llm.common import components, key_name, materialize, runs, table

COSINE = 0.98
#: Low-dimensional blocks of the rotated vector.
BLOCKS = 8
#: Leading coordinates of a block that make its grid for up to FEW vectors of a label, one more for each tripling
#: beyond, and the width of a cell in block radii.
GRID, FEW, WIDTH = 2, 10_000, 2.0
#: Rows of either side that one group compares, about.
CHUNK = 2048
#: Up to so many cells their counts are broadcast; more are joined by shuffle.
CELLS = 100_000
SLACK = 1e-9
#: Room for rounding where squared distances are taken in single precision.
LOOSE = 1e-5
#: Odd multiplier that names cells (fixed value).
MIX = np.int64(-7046029254386353131)
CELL = ["label", "block", "cell", "home", "id", "m", "vector"]
KEYS = ["label", "block", "cell", "i", "j"]


def rotation(n: int, seed: int) -> np.ndarray:
    """A random rotation, so that no block has more of the distance than its share on average."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def _unit(vectors: np.ndarray) -> np.ndarray:
    # by the largest part first: squares neither overflow nor vanish
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _stack(column: pd.Series | pa.Array, dim: int) -> np.ndarray:
    """Vectors in double precision from their bytes, which are single where the table has them so."""
    values = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    kind = np.float32 if values and len(values[0]) == 4 * dim else np.float64
    return np.frombuffer(b"".join(values), dtype=kind).reshape(len(values), dim).astype(np.float64)


def _blocks(n: int) -> list[np.ndarray]:
    return np.array_split(np.arange(n), max(1, min(BLOCKS, n // GRID)))


def _limit(radius2: float, block: np.ndarray, dim: int) -> float:
    """A block's share of the squared distance."""
    return radius2 * len(block) / dim + SLACK


def _within(y: np.ndarray, a: np.ndarray, b: np.ndarray, block: np.ndarray, limit: float) -> np.ndarray:
    """Whether a block admits the pairs: the one test of it, the same for either order of a pair."""
    d = y[a][:, block] - y[b][:, block]
    return (d * d).sum(axis=1) <= limit


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,kj->ik", a, b)


def _grid(n: float) -> int:
    """Coordinates of a block's grid where a vector has about ``n`` others of its label."""
    return GRID + max(0, math.ceil(math.log(n / FEW, 3))) if n > FEW else GRID


def _cells(z: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The home cells of points, and for each step ``(rows, cells)`` the cells that a ball of 1 / WIDTH reaches."""
    lo, reach = np.floor(z - 1 / WIDTH), (1 + SLACK) / WIDTH**2
    guests = []
    for step in np.indices((math.ceil(2 / WIDTH) + 1,) * z.shape[1]).reshape(z.shape[1], -1).T:
        gap = np.maximum(np.maximum(lo + step - z, z - lo - step - 1), 0)
        inside = np.flatnonzero((gap * gap).sum(axis=1) <= reach)
        guests.append((inside, (lo + step)[inside]))
    return np.floor(z), guests


def _name(cells: np.ndarray) -> np.ndarray:
    """One number for each cell. The cells that one vector reaches never share it (their coordinates differ by one
    at most, see the test); far cells that do are only compared in vain."""
    out = np.zeros(len(cells), dtype=np.int64)
    for column in cells.astype(np.int64).T:
        out = out * MIX + column
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    flat = pa.py_buffer(np.ascontiguousarray(rows).tobytes())
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, flat]).cast(pa.binary())


def dealt(vectors: DataFrame, dim: int, radius2: float, seed: int, grid: int, light: bool) -> DataFrame:
    """``(label, block, cell, home, id, m, vector)``: each vector of ``(id, label, m, mask, vector)`` at home in one cell
    of the grid of each block in its mask, and as a guest in all cells that its ball of the block's share of the squared
    distance reaches. ``light``: the block's coordinates in single precision stand for the vector."""
    turn, parts = rotation(dim, seed), _blocks(dim)
    size = max(32, 4096 >> grid)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                y = np.einsum("ij,jk->ik", _unit(_stack(part.column(4), dim)), turn)
                mask = part.column(3).to_numpy()
                for k, block in enumerate(parts):
                    own = np.flatnonzero(mask >> k & 1)
                    r = math.sqrt(_limit(radius2, block, dim)) * (1 + SLACK)
                    home, guests = _cells(y[own][:, block[:grid]] / (WIDTH * r))
                    rows = pa.array(np.concatenate([own, *(own[i] for i, _ in guests)]))
                    cell = pa.array(_name(np.concatenate([home, *(c for _, c in guests)])))
                    homes = pa.array(np.arange(len(rows)) < len(own))
                    payload = (_binary(y[:, block].astype(np.float32)) if light else part.column(4)).take(rows)
                    where = pa.array(np.full(len(rows), k, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([part.column(1).take(rows), where, cell, homes, *(part.column(c).take(rows) for c in (0, 2)), payload], CELL)

    kind = dict(vectors.dtypes)["label"]
    return vectors.select("id", "label", "m", "mask", "vector").mapInArrow(of, f"label {kind}, block int, cell long, home boolean, id long, m long, vector binary")


def _placed(cells: DataFrame) -> DataFrame:
    """The rows of each cell that someone is at home in, by cell and piece: homes and guests are cut into pieces of
    about CHUNK, and each piece of the ones meets each of the others in ``(i, j)``."""
    where = ["label", "block", "cell"]
    counts = materialize(cells.groupBy(*where).agg(F.count_if("home").alias("_h"), F.count_if(~F.col("home")).alias("_g")).where("_h > 0"), "vectors")
    few = counts.count() <= CELLS
    pieces = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
    counts = counts.select(*where, pieces("_h").alias("_hs"), pieces("_g").alias("_gs"))
    placed = cells.join(F.broadcast(counts) if few else counts, where)
    own = lambda n: F.array(F.pmod(F.xxhash64("id"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    placed = placed.withColumn("i", F.explode(F.when(F.col("home"), own("_hs")).otherwise(every("_hs"))))
    placed = placed.withColumn("j", F.explode(F.when(F.col("home"), every("_gs")).otherwise(own("_gs"))))
    return placed.select(*KEYS, "home", "id", "m", "vector").repartition(*KEYS).sortWithinPartitions(*KEYS)


def near_blocks(vectors: DataFrame, dim: int, radius2: float, seed: int, grid: int) -> DataFrame:
    """``(id, label, mask)``: the blocks, as bits, in which a vector has another one within the block's share, and some
    in which it is only nearly so; vectors without any are left out. Reads the block's coordinates alone."""
    limits = [_limit(radius2, b, dim) for b in _blocks(dim)]
    placed = _placed(dealt(vectors.withColumn("mask", F.lit((1 << len(limits)) - 1)), dim, radius2, seed, grid, True))

    def of(group: pd.DataFrame) -> pd.DataFrame:
        home, k = group["home"].to_numpy(), int(group["block"].iloc[0])
        y = np.frombuffer(b"".join(group["vector"]), dtype=np.float32).reshape(len(group), -1)
        ids, guests, hosts = group["id"].to_numpy()[home], y[~home], y[home]
        # one product for the squared distance: |u|2 + |v|2 - 2uv
        wide = np.column_stack([-2 * guests, np.ones(len(guests), np.float32), (guests * guests).sum(axis=1)]).T
        others = np.zeros(len(ids), dtype=np.int64)
        for at in range(0, len(ids), 256):
            u = hosts[at : at + 256]
            near = np.column_stack([u, (u * u).sum(axis=1), np.ones(len(u), np.float32)]) @ wide <= limits[k] + LOOSE
            others[at : at + 256] = np.bincount(np.flatnonzero(near) // max(1, len(guests)), minlength=len(u))
        found = others > np.isin(ids, group["id"].to_numpy()[~home])
        return pd.DataFrame({"id": ids[found], "label": group["label"].to_numpy()[home][found], "mask": np.int32(1 << k)})

    kind = dict(vectors.dtypes)["label"]
    found = placed.mapInPandas(lambda frames: (of(g) for g in runs(frames, KEYS)), f"id long, label {kind}, mask int")
    return found.groupBy("id", "label").agg(F.bit_or("mask").alias("mask"))


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest that links reach."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        np.minimum.at(new, root[u], least)
        np.minimum.at(new, root[v], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def linked(vectors: DataFrame, dim: int, cosine: float, seed: int) -> DataFrame:
    """``(id, m, to)``: in parts that sum up, with how many others a vector is linked (``m`` counts copies),
    and a vector ``to`` that the part's links reach from it."""
    radius2 = 2 - 2 * cosine + SLACK
    turn, parts = rotation(dim, seed), _blocks(dim)
    limits = [_limit(radius2, b, dim) for b in parts]
    grid = _grid(vectors.groupBy("label").count().agg((F.sum(F.col("count") * F.col("count").cast("double")) / F.sum("count"))).first()[0] or 1)
    masks = near_blocks(vectors, dim, radius2, seed, grid)
    placed = _placed(dealt(materialize(vectors.join(masks, ["id", "label"]), "vectors"), dim, radius2, seed, grid, False))

    def of(group: pd.DataFrame) -> pd.DataFrame:
        home, ids, m = (group[c].to_numpy() for c in ("home", "id", "m"))
        k = int(group["block"].iloc[0])
        x = _unit(_stack(group["vector"], dim))
        y = np.einsum("ij,jk->ik", x, turn)
        hs, gs = np.flatnonzero(home), np.flatnonzero(~home)
        guests = y[gs][:, parts[k]]
        norms, found = (guests * guests).sum(axis=1), []
        for at in range(0, len(hs), 256):
            some = hs[at : at + 256]
            u = y[some][:, parts[k]]
            # with room for rounding: what it lets through is tested again
            r, c = np.nonzero((u * u).sum(axis=1)[:, None] + norms - 2 * _product(u, guests) <= limits[k] + SLACK)
            for lo in range(0, len(r), 1 << 14):
                a, b = some[r[lo : lo + (1 << 14)]], gs[c[lo : lo + (1 << 14)]]
                # a pair counts in the first block that admits it, if the whole vectors do
                keep = (ids[a] != ids[b]) & _within(y, a, b, parts[k], limits[k])
                for q in range(k):
                    keep &= ~_within(y, a, b, parts[q], limits[q])
                keep &= (x[a] * x[b]).sum(axis=1) >= cosine
                found.append((a[keep], b[keep]))
        a, b = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (hs[:0], hs[:0])
        root = _roots(len(ids), a, b)
        n = np.bincount(a, weights=m[b], minlength=len(ids)).astype(np.int64)
        out = pd.DataFrame({"id": ids, "m": n, "to": ids[root]})
        return out[(n > 0) | (out["id"] != out["to"])]

    return placed.mapInPandas(lambda frames: (of(g) for g in runs(frames, KEYS)), "id long, m long, to long")


def near_vectors(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, seed: int = 3) -> DataFrame:
    """Link vectors of equal label with a cosine of ``cosine`` or more, in double precision: ``(key,
    n_links, component_id, kept)``, one row per input row.

    Unit vectors with that cosine have a squared distance of at most 2 - 2 cosine. The vectors are turned
    by one rotation and split into blocks; some block must have no more than its share of the squared
    distance, so each block is joined by range on a grid. A first pass over the blocks' own coordinates finds
    the vectors that have a neighbour in a block; only these go whole to that block's cells, where the union of
    what the blocks admit is verified, and a pair counts in the first block that admits it. The grid takes more
    coordinates the more vectors a label has. Full cells are compared chunk by chunk, and only counts and one
    row per vector leave a group, never its pairs. Equal vectors
    are compared once and count as often as they occur.

    Vectors that are null, empty, zero or hold a null or non-finite number link with nothing, nor do
    those without a label; vectors of different length are not compared. Repeated rows link with each
    other; rows without a key link with nothing; a very long vector is read whole; of equal vectors the
    smallest key is compared; an empty table gives no rows; other columns are not read.
    """
    single = np.float32 if dict(vectors.dtypes)[vector] == "array<float>" else np.float64
    x = F.transform(vector, lambda v: v.cast("float" if single is np.float32 else "double"))
    good = F.coalesce(F.col(label).isNotNull() & F.col(key).isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(key).alias("_key"), F.col(label).alias("label"), x.alias("_x"), good.alias("_good"))
    digest = [F.xxhash64("_x").alias("_d"), F.hash("_x").alias("_e"), F.size("_x").alias("_n")]
    named = materialize(rows.select("_key", F.when(F.col("_good"), F.col("label")).alias("label"), "_good", *digest), "vectors")
    by = ["label", "_d", "_e", "_n"]
    classes = materialize(named.where("_good").groupBy(*by).agg(F.min("_key").cast("long").alias("id"), F.count("*").alias("m")), "vectors")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=single)
            edges = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            binary = pa.array([flat[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), binary], ["id", "label", "m", "vector"])

    kind = dict(vectors.dtypes)[label]
    firsts = rows.where("_good").select("_key", "label", "_x", *digest).join(classes, by)
    firsts = firsts.where(F.col("_key") == F.col("id")).dropDuplicates(["id", *by])
    linked_ = None
    for (dim,) in classes.select("_n").distinct().collect():  # one length, as a rule
        part = firsts.where(F.col("_n") == dim).select("id", "label", "m", "_x").mapInArrow(packed, f"id long, label {kind}, m long, vector binary")
        part = linked(materialize(part, "vectors"), dim, cosine, seed)
        linked_ = part if linked_ is None else linked_.unionByName(part)
    if linked_ is None:
        linked_ = named.sparkSession.createDataFrame([], "id long, m long, to long")
    linked_ = materialize(linked_.groupBy("id", "to").agg(F.sum("m").alias("m")), "vectors")
    groups = components(linked_.select(F.col("id").alias("a"), F.col("to").alias("b")))
    classes = classes.join(linked_.groupBy("id").agg(F.sum("m").alias("_others")), "id", "left").join(groups, "id", "left")
    classes = classes.select(*by, (F.col("m") - 1 + F.coalesce("_others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = named.join(classes, by, "left")
    component = F.coalesce("component_id", "_key")
    return out.select(F.col("_key").alias(key_name(key, ("n_links", "component_id", "kept"))), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("_key"), F.lit(True)).alias("kept"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL_OP4 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      AND list_inner_product(a.x, b.x) / sqrt(list_inner_product(a.x, a.x) * list_inner_product(b.x, b.x)) >= 0.98),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.low, vec_id)) AS component_id,
       vec_id <= coalesce(c.low, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
