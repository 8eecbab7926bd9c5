"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine c are sqrt(2 - 2c) apart. A seeded random rotation spreads that distance evenly over
the axes, which are cut into blocks; a block of d of the D axes gets d/D of the squared distance as its
budget. A pair within the whole distance is within budget in at least one block, so the union of one range
join for each block holds every link. A block's range join deals vectors into cells along the block's first
axis, as wide as the block's radius, and compares a cell with itself and the next one only. Large cells are
cut into chunks, and a unit of work is a pair of chunks: a matrix product filters its pairs by the block's
distance, and the cosine of the rest is verified in double precision. A pair that several blocks would find
counts in the first of them alone. Units return link counts and a spanning forest, never the pairs.

How much a block rules out depends on the vectors: for isotropic ones, cells exclude few pairs and the work
grows with the square of the number of different vectors, at a small constant.

Defined results: null, empty or all-zero vectors and ones with null or non-finite components link with nothing;
equal vectors are joined once and counted as often as they stand; vectors of different lengths never link;
repeated rows each keep a row; null ids never become a component id while another is reachable; other columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mapped, named, row_numbers, saved, spread_join
from tidemark.llm.components import components

#: Rows of a chunk, rows compared with a chunk at once, and pairs verified at once: these bound memory.
CHUNK_ROWS, TILE_ROWS, VERIFY_PAIRS = 16_384, 512, 65_536
#: Added to every budget, far above the rounding of the products.
SLACK = 1e-4


class Blocks:
    """The rotation for one vector length, and its blocks with their budgets."""

    def __init__(self, dim: int, cosine: float, block_dims: int, seed: int = 7):
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
        self.rotation = q * np.sign(np.diag(r))
        n = max(1, round(dim / block_dims))
        self.edges = [round(dim * k / n) for k in range(n + 1)]
        self.n = n
        whole = max(0.0, 2 - 2 * cosine)
        self.budgets = np.array([whole * (hi - lo) / dim for lo, hi in zip(self.edges, self.edges[1:])]) + SLACK

    def rotate(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors, rotated. Sums run in one order, so a vector's image doesn't depend on its neighbours."""
        unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
        out = np.zeros_like(unit)
        for k in range(unit.shape[1]):
            out += unit[:, k : k + 1] * self.rotation[k]
        return out

    def cells(self, rotated: np.ndarray) -> np.ndarray:
        """For each vector and block, the cell along the block's first axis."""
        return np.floor(rotated[:, self.edges[:-1]] / np.sqrt(self.budgets)).astype(np.int64)

    def squares(self, difference: np.ndarray) -> np.ndarray:
        """Squared distances in each block."""
        return np.add.reduceat(difference * difference, self.edges[:-1], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Vector lengths and the rows that have them."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths).tolist():
        yield int(dim), np.flatnonzero(lengths == dim)


def _pairs(a: np.ndarray, b: np.ndarray, block: int, blocks: Blocks, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of the rotated ``a`` and ``b`` that the block keeps and no earlier block would."""
    lo, hi = blocks.edges[block : block + 2]
    left, right = a[:, lo:hi].astype(np.float32), b[:, lo:hi].astype(np.float32)
    right_squares = (right * right).sum(axis=1)
    for top in range(0, len(a), TILE_ROWS):
        part = left[top : top + TILE_ROWS]
        near = (part * part).sum(axis=1)[:, None] + right_squares - 2 * (part @ right.T) <= blocks.budgets[block] + SLACK
        if same:
            near &= np.arange(len(b)) > np.arange(top, top + len(part))[:, None]
        i, j = np.nonzero(near)
        for k in range(0, len(i), VERIFY_PAIRS):
            x, y = i[k : k + VERIFY_PAIRS] + top, j[k : k + VERIFY_PAIRS]
            within = blocks.squares(a[x] - b[y]) <= blocks.budgets
            first = within.any(axis=1) & (within.argmax(axis=1) == block)
            yield x[first], y[first]


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the least row that the pairs reach."""
    low = np.arange(n)
    while len(x):
        least = np.minimum(low[x], low[y])
        if (least == low[x]).all() and (least == low[y]).all():
            break
        np.minimum.at(low, low[x], least)
        np.minimum.at(low, low[y], least)
        low = low[low]
    return low


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, block_dims: int = 16) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links`` (other vectors with at least this cosine), ``component_id`` (the least
    id reachable, its own included) and ``kept``."""
    spark = vectors.sparkSession
    vec_id, value = named([id_col, vector_col])
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) | ~F.exists("v", lambda c: c != 0)
    rows = vectors.select(vec_id.alias("vec_id"), value.cast("array<double>").alias("v"))
    rows = rows.select("vec_id", F.when(~F.coalesce(bad, F.lit(True)), F.col("v")).alias("v"))
    keyed = rows.select("vec_id", "v", *[F.when(F.col("v").isNotNull(), F.xxhash64("v", F.lit(k))).alias(f"k{k}") for k in (1, 2)])
    different = keyed.where("v is not null").groupBy("k1", "k2").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [0]
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, row_numbers(seen, b.num_rows)], [*b.schema.names, "node"])

    nodes = saved(mapped(different, number, "k1 long, k2 long, v array<double>, copies long, least long, node long".replace("least long", f"least {dict(different.dtypes)['least']}")), "vectors")
    # one rotation for each vector length: a table of embeddings has one or few
    plans = {r[0]: Blocks(r[0], cosine, block_dims) for r in nodes.select(F.size("v")).distinct().collect()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(0)
            for dim, at in _by_length(v):
                cells = plans[dim].cells(plans[dim].rotate(_matrix(v.take(pa.array(at)))))
                n = cells.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(cells.size, dim)), pa.array(np.tile(np.arange(n), len(at))), pa.array(cells.ravel())], ["dim", "block", "cell"])

    # a unit vector's coordinates are within [-1, 1]: the cells are bounded by the radius, not by the rows
    sizes = mapped(nodes.select("v"), place, "dim long, block long, cell long").groupBy("dim", "block", "cell").count().orderBy("dim", "block", "cell").collect()
    first_chunk: dict[tuple[int, int, int], tuple[int, int]] = {}
    chunks: list[tuple[int, int]] = []  # length and block of each chunk
    for dim, block, cell, n in sizes:
        count = math.ceil(n / CHUNK_ROWS)
        first_chunk[dim, block, cell] = (len(chunks), count)
        chunks += [(dim, block)] * count

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, node = batch.column(0), batch.column(2).to_numpy()
            for dim, at in _by_length(v):
                cells = plans[dim].cells(plans[dim].rotate(_matrix(v.take(pa.array(at)))))
                rows, units, own = [], [], []
                for block in range(cells.shape[1]):
                    for cell in np.unique(cells[:, block]).tolist():
                        here = at[cells[:, block] == cell]
                        base, count = first_chunk[dim, block, cell]
                        chunk = base + node[here] % count
                        for other in (cell - 1, cell, cell + 1):
                            start, many = first_chunk.get((dim, block, other), (0, 0))
                            for partner in range(start, start + many):
                                rows.append(here)
                                own.append(chunk)
                                units.append(np.minimum(chunk, partner) * len(chunks) + np.maximum(chunk, partner))
                if rows:
                    took = batch.take(pa.array(np.concatenate(rows)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(units)), pa.array(np.concatenate(own)), *took.columns], ["unit", "chunk", "v", "copies", "node"])

    def compare(unit: pa.Table) -> pa.Table:
        unit = unit.combine_chunks()
        number = unit["unit"][0].as_py()
        low, high = divmod(number, len(chunks))
        dim, block = chunks[low]
        blocks = plans[dim]
        chunk = unit["chunk"].to_numpy()
        order = np.argsort(chunk, kind="stable")
        cut = int((chunk == low).sum())
        x = _matrix(unit["v"].chunk(0))[order]
        node, copies = unit["node"].to_numpy()[order], unit["copies"].to_numpy()[order]
        rotated, norms = blocks.rotate(x), np.sqrt((x * x).sum(axis=1))
        shift = 0 if low == high else cut
        n = np.zeros(len(x), np.int64)
        heads, tails = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in _pairs(rotated[:cut], rotated[shift:], block, blocks, low == high):
            j = j + shift
            linked = np.einsum("ij,ij->i", x[i], x[j]) / (norms[i] * norms[j]) >= cosine
            i, j = i[linked], j[linked]
            np.add.at(n, i, copies[j])
            np.add.at(n, j, copies[i])
            root = _forest(len(x), np.concatenate([*heads, i]), np.concatenate([*tails, j]))
            tied = np.flatnonzero(root != np.arange(len(x)))
            heads, tails = [tied], [root[tied]]
        low_node = node.copy()
        low_node[heads[0]] = node[tails[0]]
        some = n > 0
        return pa.table({"node": node[some], "n": n[some], "low": low_node[some]})

    dealt = mapped(nodes.select("v", "copies", "node"), deal, "unit long, chunk long, v array<double>, copies long, node long")
    found = saved(dealt.groupBy("unit").applyInArrow(compare, "node long, n long, low long"), "vector-links")
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    linked = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    labelled = nodes.select("k1", "k2", "copies", "least", "node").join(linked, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    of = spread_join(labelled, least, "component", "node").select(F.struct("k1", "k2").alias("k"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    # vectors without a key pass by the join: their nulls would all meet in one task
    good = spread_join(keyed.where("v is not null").select("vec_id", F.struct("k1", "k2").alias("k")), of, "k", "vec_id").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = keyed.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
