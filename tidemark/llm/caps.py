"""Embedding near-duplicates by spherical-cap filters."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import Forest, blocks, components
from .texts import small_batches

CODEWORDS = 64
# How far towards another codeword the difference of two near vectors may point, in standard
# deviations of a random direction. See ``decode_filters``.
SIGMAS = 5.5
BLOCK_VECTORS = 2048
_SEED = 20
_SLACK = 1e-7  # for rounding; a filter too many costs a look, one too few a link


@lru_cache(8)
def product_code(size: int, codewords: int) -> tuple[np.ndarray, tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(rotation, codes, distances) for vectors of ``size`` components.

    A filter direction is a pair of codewords, one for each half of a rotated vector, so
    ``2 * codewords`` random directions make ``codewords ** 2`` filters. The rotation spreads
    vectors whose weight sits in few components. ``distances`` are those between codewords.
    """
    random = np.random.default_rng((_SEED, size, codewords))
    rotation = np.linalg.qr(random.standard_normal((size, size)))[0]
    codes, distances = [], []
    for half in (size - size // 2, size // 2):
        code = random.standard_normal((codewords if half else 1, max(half, 1)))
        code = code / np.linalg.norm(code, axis=1, keepdims=True)
        codes.append(code[:, :half])
        distances.append(np.linalg.norm(code[:, None] - code[None], axis=2) + np.eye(len(code)))
    return rotation, tuple(codes), tuple(distances)


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that no square overflows
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def scores(vectors: np.ndarray, codewords: int) -> list[np.ndarray]:
    """Dot products of both halves of unit vectors with their codewords."""
    rotation, codes, _ = product_code(vectors.shape[1], codewords)
    rotated = vectors @ rotation
    first = codes[0].shape[1]
    return [rotated[:, :first] @ codes[0].T, rotated[:, first:] @ codes[1].T]


def decode_filters(vectors: np.ndarray, cosine: float, codewords: int, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter): all filters whose cap a unit vector may share with a neighbour.

    Let z be the middle of x and y, and f the filter that z scores best with. Both lie within
    ``sqrt((1 - cosine) / 2)`` of z, so in each half x falls short of its own best codeword b
    by at most the part of x - z that points from f to b, times |b - f|. At worst that is all of
    x - z: with ``sigmas`` at the root of the dimension or more, x and y always both list f
    and no pair can be missed. But x - z is orthogonal to z, and codewords are random and do
    not depend on the data, so in ``d`` dimensions the part is normal with a standard
    deviation of ``1 / sqrt(d)`` of the whole. Beyond 5.5 of those lie 2e-8 of all cases: with 128
    codewords a link is lost with a chance below 3e-6, whatever the data.
    """
    reach = (1 - cosine) / 2 * min(1.0, sigmas**2 / vectors.shape[1]) + _SLACK
    short = []
    for s, distance in zip(scores(vectors, codewords), product_code(vectors.shape[1], codewords)[2]):
        best = s.argmax(axis=1)
        short.append(((s[np.arange(len(s)), best][:, None] - s) / distance[best]) ** 2)
    row, i, j = np.nonzero(short[0][:, :, None] + short[1][:, None, :] <= reach)
    return row, i * short[1].shape[1] + j


def filter_postings(nodes: DataFrame, cosine: float, codewords: int, sigmas: float) -> DataFrame:
    """``nodes`` (label, node, n, vector) once for each filter of theirs, with ``size`` and ``filter``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                column = part.column("vector")
                sizes = pa.compute.list_value_length(column).to_numpy()
                for size in np.unique(sizes).tolist():
                    own = np.nonzero(sizes == size)[0]
                    some = part.take(pa.array(own))
                    vectors = some.column("vector").flatten().to_numpy().reshape(-1, size)
                    row, number = decode_filters(unit(vectors.astype(np.float64)), cosine, codewords, sigmas)
                    out = some.take(pa.array(row))
                    columns = [*out.columns, pa.array(np.full(len(row), size), pa.int32()), pa.array(number, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, [*out.schema.names, "size", "filter"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    return nodes.mapInArrow(run, f"{fields}, size int, filter int")


def _compare(members: dict[str, np.ndarray], vectors: np.ndarray, number: int, same: bool, cosine: float, codewords: int):
    """(forest, weights) of one block: links between its members whose own filter is this one."""
    n, halves = len(vectors), scores(vectors, codewords)
    wide = halves[1].shape[1]
    want = (number // wide, number % wide)
    forest, weight = Forest(n), np.zeros(n, np.int64)
    copies, chunk = members["n"], members["chunk"]
    tile = max(1, (1 << 21) // n)
    for start in range(0, n, tile):
        near = vectors[start : start + tile] @ vectors.T >= cosine
        i, j = np.nonzero(near)
        i = i + start
        kept = i < j
        if not same:
            kept &= chunk[i] != chunk[j]  # the others are met in the block of their chunk alone
        i, j = i[kept], j[kept]
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            # A pair is counted at the filter of its middle only, wherever else it meets.
            own = (halves[0][a] + halves[0][b]).argmax(axis=1) == want[0]
            own &= (halves[1][a] + halves[1][b]).argmax(axis=1) == want[1]
            a, b = a[own], b[own]
            np.add.at(weight, a, copies[b])
            np.add.at(weight, b, copies[a])
            for x, y in zip(a.tolist(), b.tolist()):
                forest.join(x, y)
    return forest, weight


def cap_links(
    nodes: DataFrame,
    *,
    cosine: float,
    codewords: int = CODEWORDS,
    sigmas: float = SIGMAS,
    block_vectors: int = BLOCK_VECTORS,
) -> DataFrame:
    """(node, root, weight): per block, the links of each node that has any.

    ``weight`` counts the vectors linked there; every pair is counted in one block only, so
    the sums over blocks are exact. ``root`` is a node it is connected with; of a block only
    a spanning forest comes out, never its pairs.
    """
    posted = filter_postings(nodes, cosine, codewords, sigmas)
    member = F.struct("node", "n", "chunk", "vector")
    lists = blocks(posted, ["label", "size", "filter"], F.xxhash64("node"), member, block_vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            column = batch.column("members")
            cuts, flat = column.offsets.to_numpy(), column.values
            names = {c: flat.field(i).to_numpy(zero_copy_only=False) for i, c in enumerate(("node", "n", "chunk"))}
            vectors = flat.field(3)
            keys = zip(*[batch.column(c).to_pylist() for c in ("size", "filter", "left", "right")])
            for (size, number, left, right), i, j in zip(keys, cuts[:-1].tolist(), cuts[1:].tolist()):
                members = {c: v[i:j] for c, v in names.items()}
                own = vectors.slice(i, j - i).flatten().to_numpy().reshape(-1, size).astype(np.float64)
                forest, weight = _compare(members, unit(own), number, left == right, cosine, codewords)
                linked = np.nonzero(weight)[0]
                roots = np.array([forest.find(k) for k in linked.tolist()], np.int64)
                out[0].append(members["node"][linked])
                out[1].append(members["node"][roots])
                out[2].append(weight[linked])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["node", "root", "weight"])

    wanted = lists.select("size", "filter", "left", "right", "members")
    return wanted.mapInArrow(run, "node bigint, root bigint, weight bigint")


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def embedding_groups(
    embeddings: DataFrame,
    *,
    cosine: float = 0.98,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    codewords: int = CODEWORDS,
    sigmas: float = SIGMAS,
    block_vectors: int = BLOCK_VECTORS,
) -> DataFrame:
    """Near-duplicate groups of vectors with equal labels: one row per input row.

    Two vectors link if their cosine, in double precision, is at least ``cosine`` and their
    labels are equal and not null. Columns: ``vec_id``, ``n_links`` (other vectors linked
    directly), ``component_id`` (smallest vec_id reachable, itself included), ``kept``
    (whether that is this row's id).

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do those of another length or with a null id. Equal vectors of one label are
    compared as one and counted as many; rows that repeat an id are vectors of their own. Other columns
    are not read.
    """
    small_batches(embeddings.sparkSession)
    found = embeddings.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector")
    )
    usable = _usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # Two hashes stand for label and vector, so that rows can be matched without the vectors.
    found = found.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumns(
        {"h1": F.xxhash64("label", "vector"), "h2": F.xxhash64(F.lit(1), "vector", "label")}
    )
    nodes = found.where("usable").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.any_value("label").alias("label"), F.any_value("vector").alias("vector")
    )
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    links = cap_links(
        nodes.select("label", "node", "n", "vector"),
        cosine=cosine,
        codewords=codewords,
        sigmas=sigmas,
        block_vectors=block_vectors,
    )
    links = materialise(links, "cap-links")
    weights = links.groupBy("node").agg(F.sum("weight").alias("weight"))
    groups = materialise(components(links, "node", "root").withColumnRenamed("component", "group"), "vector-groups")
    smallest = groups.join(nodes.select("node", "rep"), "node").groupBy("group").agg(F.min("rep").alias("least"))
    linked = groups.join(smallest, "group").select("node", "least")
    known = nodes.select("node", "h1", "h2", "rep", "n").join(weights, "node", "left").join(linked, "node", "left")
    known = known.select(
        "h1", "h2", (F.col("n") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("least")
    )
    plain = found.select("vec_id", F.when(F.col("usable"), F.col("h1")).alias("h1"), "h2")
    out = plain.join(known, ["h1", "h2"], "left")
    component = F.coalesce("least", "vec_id")
    return out.select(
        F.col("vec_id").alias(vec_id),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
