"""Embedding near-duplicates by an inverted multi-index.

Vectors are compared only within equal, non-null labels and equal length, by
cosine in double precision. Exact copies (label and components) collapse into one
node with a count first, a map-side combine, so a group of copies is one node.

Index: the two halves of the unit vectors have independent codebooks of K
centroids each (k-means on a bounded sample, ``SAMPLE`` nodes of the smallest
keys); their product is a grid of K x K cells, and every node stands in the cell of
its nearest centroids. K grows with the largest label, to about ``CELL_ROWS``
nodes of it a cell.

Search: for a half vector q and centroid i the bound (|q - c_i|^2 - |q - c_a|^2) /
(2 |c_i - c_a|), its largest value over all a, is the least distance at which a
point of i's region can lie. Multi-sequence traversal of the two sorted lists of
squared bounds visits the cells in the order of their sums, nearest first, until
the target recall is met: a neighbour at the distance r of the threshold, in a
random direction of d dimensions, moves by less than sum = 2 r^2 ln(1 / (1 -
recall)) / d along the two normals with probability ``recall``. The traversal never
needs more than sum = r^2, which holds every neighbour (recall 1.0 asks for that).
d is the effective dimension of the sample (participation ratio of its covariance).
Of two nodes in different cells the one in the smaller cell looks for the other.

Verification: the nodes of a cell meet its visitors in blocks of ``INDEX_ROWS`` x
``QUERY_ROWS``, so a cell that holds a third of all rows is spread over many tasks.
A block gives the number of links of each node and a spanning forest of the links
instead of the pairs. Components come from the forests.

Null, zero and empty vectors, and those with null or non-finite components, link
with nothing, like those of null label. Null ids take part, but name no component
unless all of it is null. Repeated rows are copies: each counts as another vector
of the other. Empty table: empty result. Other columns are not read, whatever
their names; the operator has no texts.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StringType, StructField, StructType

from triageflow.llm.common import bound_batches, components, stored

THRESHOLD = 0.98
RECALL = 0.999
SAMPLE = 8192
CELL_ROWS = 64
MOST_CENTROIDS = 256
INDEX_ROWS = 256
QUERY_ROWS = 1024


def as_bytes(batch: pa.RecordBatch, wide: str) -> pa.Array:
    """The vectors of a batch as bytes; null where they can link with nothing."""
    col = batch.column("embedding")
    flat = col.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype("f8")
    good = np.isfinite(values)  # a null component arrives as NaN
    lengths = pc.fill_null(pc.list_value_length(col), 0).to_numpy()
    ends = np.cumsum(lengths)
    bad, some = (np.concatenate([[0], np.cumsum(x)]) for x in (~good, values != 0))
    fine = (bad[ends] == bad[ends - lengths]) & (some[ends] > some[ends - lengths])
    data = values.astype(wide)
    return pa.array([data[e - n:e].tobytes() if ok else None for ok, n, e in zip(fine, lengths, ends)], pa.binary())


def unit(vectors: list[bytes], wide: str, dims: int) -> np.ndarray:
    """Unit vectors in double precision, padded with zeros to ``dims``."""
    out = np.zeros((len(vectors), dims))
    for k, v in enumerate(vectors):
        x = np.frombuffer(v, wide)
        out[k, :len(x)] = x
    if out.size:
        out /= np.abs(out).max(1, keepdims=True)
        out /= np.sqrt((out * out).sum(1, keepdims=True))
    return out


def k_means(x: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """Centroids of the rows of ``x``, from evenly spread rows on."""
    if not x.shape[1]:
        return np.zeros((1, 0))
    c = np.unique(x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)], axis=0)
    for _ in range(steps):
        own = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        c = np.stack([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
    return np.unique(c, axis=0)


class Codebook:
    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        self.apart = np.sqrt(((centroids[:, None] - centroids[None]) ** 2).sum(2))
        self.apart[self.apart == 0] = np.inf

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid of each row, and for every centroid the squared
        least distance at which its region can lie."""
        d = (self.c * self.c).sum(1) - 2 * x @ self.c.T
        low = np.stack([((d[:, i:i + 1] - d) / (2 * self.apart[i])).max(1) for i in range(len(self.c))], 1)
        low = np.maximum(low, 0.0) ** 2
        near = d.argmin(1)
        low[np.arange(len(x)), near] = 0.0
        return near, low


def multi_sequence(a: list[tuple[float, int]], b: list[tuple[float, int]], most: float):
    """Pairs (i, j) of two sorted lists of (bound, number) in the order of the
    sums of their bounds, as long as a sum is at most ``most``."""
    heap, seen = [(a[0][0] + b[0][0], 0, 0)], {(0, 0)}
    while heap and heap[0][0] <= most:
        _, x, y = heapq.heappop(heap)
        yield a[x][1], b[y][1]
        for u, v in ((x + 1, y), (x, y + 1)):
            if u < len(a) and v < len(b) and (u, v) not in seen:
                seen.add((u, v))
                heapq.heappush(heap, (a[u][0] + b[v][0], u, v))


class MultiIndex:
    """Two codebooks and how far a search goes."""

    def __init__(self, sample: np.ndarray, centroids: int, threshold: float, recall: float):
        self.half = -(-sample.shape[1] // 2)
        self.books = [Codebook(k_means(x, centroids)) for x in (sample[:, :self.half], sample[:, self.half:])]
        spread = np.linalg.eigvalsh(np.cov(sample.T).reshape(sample.shape[1], -1)) if len(sample) > 1 else np.zeros(1)
        total = float((spread ** 2).sum())
        wide = max(1.0, float(spread.sum()) ** 2 / total) if total > 0 else 1.0
        reach = 2 - 2 * threshold
        self.most = reach if recall >= 1 else min(reach, 2 * reach * math.log(1 / (1 - recall)) / wide)
        self.most += 1e-12

    def visits(self, x: np.ndarray) -> list[tuple[int, list[int]]]:
        """Home cell of each row, and the cells it visits: those at or after its
        home, which come nearest first."""
        (near1, low1), (near2, low2) = self.books[0].bounds(x[:, :self.half]), self.books[1].bounds(x[:, self.half:])
        wide, out = len(self.books[1].c), []
        for k in range(len(x)):
            a, b = (sorted((float(low[k, i]), int(i)) for i in np.nonzero(low[k] <= self.most)[0]) for low in (low1, low2))
            home = int(near1[k]) * wide + int(near2[k])
            out.append((home, [c for i, j in multi_sequence(a, b, self.most) if (c := i * wide + j) >= home]))
        return out


def links(spark: SparkSession, nodes: DataFrame, wide: str, threshold: float, recall: float) -> DataFrame:
    """``key, other, n`` of nodes ``key, grp, copies, vec``: rows without other
    count the vectors linked with a node, those with one join their components."""
    group = nodes.groupBy("grp").agg(F.count("*").alias("n"), F.max(F.length("vec")).alias("w")).agg(F.max("n").alias("n"), F.max("w").alias("w")).first()
    dims = (group.w or 0) // np.dtype(wide).itemsize
    k = min(MOST_CENTROIDS, max(2, round(math.sqrt((group.n or 0) / CELL_ROWS))))
    sample = nodes.select("key", "vec").orderBy("key").limit(SAMPLE).toArrow()["vec"].to_pylist()
    if not sample:
        return nodes.select("key", F.col("key").alias("other"), F.lit(0).cast("bigint").alias("n")).limit(0)
    index = MultiIndex(unit(sample, wide, dims), k, threshold, recall)

    def visited(batches):
        for batch in batches:
            found = index.visits(unit(batch.column("vec").to_pylist(), wide, dims))
            take = [k for k, (_, cells) in enumerate(found) for _ in cells]
            cells = [c for _, cells in found for c in cells]
            homes = [found[k][0] == c for k, c in zip(take, cells)]
            rows = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cells, pa.int32()), pa.array(homes, pa.bool_())], names=[*rows.schema.names, "cell", "home"])

    narrow = nodes.select("key", "grp", "copies", "vec")
    seen = stored(spark, narrow.mapInArrow(visited, "key string, grp string, copies bigint, vec binary, cell int, home boolean"), "visits")
    # blocks of cells: an index block holds nodes at home, a query block any visitors
    size = seen.groupBy("grp", "cell").agg(F.count_if("home").alias("own"), F.count("*").alias("all")).where("own > 0 and all > 1")
    blocks = stored(spark, size.select("grp", "cell", F.ceil(F.col("own") / INDEX_ROWS).cast("int").alias("as"),
                                       F.ceil(F.col("all") / QUERY_ROWS).cast("int").alias("bs")), "cells")
    # each visit knows its block from a join on the cell, which AQE splits where a cell is hot
    at = seen.join(blocks, ["grp", "cell"])
    deal = lambda n, salt: F.pmod(F.xxhash64("key", F.lit(salt)), F.col(n)).cast("int")
    asked = at.select("*", F.explode(F.sequence(F.lit(0), F.col("as") - 1)).alias("a"), deal("bs", 1).alias("b"), F.lit(True).alias("query"))
    held = at.where("home").select("*", deal("as", 0).alias("a"), F.explode(F.sequence(F.lit(0), F.col("bs") - 1)).alias("b"), F.lit(False).alias("query"))
    met = held.unionByName(asked).select("grp", "cell", "a", "b", "query", "home", "key", "copies", "vec")
    return met.groupBy("grp", "cell", "a", "b").applyInArrow(lambda t: _block(t, wide, dims, threshold), "key string, other string, n bigint")


def _block(rows: pa.Table, wide: str, dims: int, threshold: float) -> pa.Table:
    query = rows["query"].to_numpy()
    keys, copies, home = np.array(rows["key"].to_pylist(), object), rows["copies"].to_numpy(), rows["home"].to_numpy()
    x = unit(rows["vec"].to_pylist(), wide, dims)
    i, q = np.nonzero(~query)[0], np.nonzero(query)[0]
    near = x[i] @ x[q].T >= threshold
    at = {k: n for n, k in enumerate(keys[i])}
    for n, k in enumerate(keys[q]):
        if k in at:  # a node at home does not link with itself
            near[at[k], n] = False
    away = ~home[q]
    own = near @ (copies[q] * away)  # visitors look for nodes at home only from one side
    other = copies[i] @ near
    root, edges = np.arange(len(i)), []
    for n in np.nonzero(near.any(0))[0]:
        met = np.nonzero(near[:, n])[0]
        edges.append((keys[q[n]], keys[i[met[0]]]))
        roots = root[met]
        if (roots != roots[0]).any():
            root[np.isin(root, roots)] = roots.min()
    edges += [(keys[i[n]], keys[i[r]]) for n, r in enumerate(root) if r != n]
    counts = [(keys[i[n]], int(own[n])) for n in np.nonzero(own)[0]] + [(keys[q[n]], int(other[n])) for n in np.nonzero(other)[0]]
    return pa.table({"key": pa.array([c[0] for c in counts] + [e[0] for e in edges], pa.string()),
                     "other": pa.array([None] * len(counts) + [e[1] for e in edges], pa.string()),
                     "n": pa.array([c[1] for c in counts] + [0] * len(edges), pa.int64())})


def near_duplicates(spark: SparkSession, df: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL,
                    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of ``df``."""
    bound_batches(spark)
    kind = df.schema[embedding].dataType
    wide = "<f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "<f8"
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"),
                     F.col(embedding).cast("array<float>" if wide == "<f4" else "array<double>").alias("embedding"))

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), as_bytes(batch, wide)], names=["vec_id", "label", "vec"])

    rows = rows.mapInArrow(packed, StructType([StructField("vec_id", df.schema[vec_id].dataType), StructField("label", StringType()), StructField("vec", BinaryType())]))
    usable = F.col("label").isNotNull() & F.col("vec").isNotNull()
    group = F.when(usable, F.concat_ws(":", F.length("vec").cast("string"), "label"))
    key = F.when(usable, F.md5(F.concat(F.encode(F.concat("grp", F.lit("\0")), "utf-8"), F.col("vec"))))
    rows = stored(spark, rows.withColumn("grp", group).select("vec_id", "grp", key.alias("key"), "vec"), "vectors")
    nodes = stored(spark, rows.where("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("grp").alias("grp"), F.first("vec").alias("vec")), "nodes")
    found = stored(spark, links(spark, nodes, wide, threshold, recall), "links")
    linked = components(spark, found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    count = found.where("other is null").groupBy("key").agg(F.sum("n").alias("n"))
    member = stored(spark, nodes.select("key", "first", "copies").join(count, "key", "left").join(linked.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "key").alias("component")), "members")
    name = member.groupBy("component").agg(F.min("first").alias("component_id"))
    named = stored(spark, member.join(name, "component").select("key", "n_links", "component_id"), "named")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where("key is not null").select("vec_id", "key").join(named, "key").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
