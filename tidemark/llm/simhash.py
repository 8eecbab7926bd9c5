"""SimHash near-duplicate detection by multi-index hashing.

Documents become 64-bit fingerprints of their word shingles. Equal fingerprints are collapsed first, so a
group of copies is one row from there on. The bits are cut into segments, and a table is keyed by each segment's
value. One side enumerates the Hamming ball of a small radius around its own value, a join fetches the table's
matches, and the complete distance is verified in the join condition. Components of the links come last.

With one fingerprint, segments and radii follow from the pigeonhole principle: a pair within ``max_distance`` bits is
within the radius in some segment, so no link is lost. How many segments there are is chosen by the count of
different fingerprints: wide segments have larger balls, narrow ones more matches by chance. The links are the
same.

One fingerprint tells documents apart to a few bits only. ``alike`` takes ``count`` of them, of the different shingles,
and links pairs by their exact Jaccard similarity: a pair at 0.8 differs in 15 % of all bits on average, so in one of enough
segments it is within one bit with any wished probability. The join verifies the distance over all fingerprints, with a
bound that 95 % of such pairs keep; those far within it are links at once, and the shingles of the rest are compared.

Near copies by the thousand would still give all their pairs. So rows that share a segment's value are first linked
with the least of them alone, where the complete distance allows it. The balls then look only for links between the
components of that: the members of a large component meet the rows of other components in a slot, never one
another.

Defined results: a null or white text has fingerprint zero and links like any other; repeated rows each
keep a row; a null id is carried along and never becomes a component id while another id is reachable;
columns other than the id and the text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_map, column_bytes, mapped, named, row_numbers, saved, shuffles_end, spread_join
from tidemark.llm.components import components

#: Numbers whose bits a byte can count, and how many such blocks are counted at once: bounds memory on long texts.
_BLOCK, _BLOCKS = 255, 1024
_LANES = np.uint64(0x0101010101010101)
#: A component of so many nodes or more is kept apart from its own members when balls are looked up.
LARGE = 32
#: Rows a node may look up in one round on average: bounds what a round shuffles.
ROUND_ROWS = 24
#: How many table matches cost as much as a row that is shuffled.
_MATCHES_A_ROW = 50
#: Widths of segments that are chosen from, and the rows a slot may have by chance.
WIDTHS, SLOT_ROWS = (16, 20, 24, 28, 32), 32


def _shingles(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 with seed 42 of each word shingle of one UTF-8 text, in order."""
    # bytes.split() and bytes.lower() know ASCII only: exactly \x20 and \x09-\x0D, exactly A-Z
    words = text.lower().split()
    if not words:
        return np.array([], "<u8")
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
        hashes = [xxhash.xxh64_intdigest(line[s:e], 42) for s, e in spans]
    return np.array(hashes, "<u8")


def fingerprints_of(texts: list[bytes], shingle: int, count: int = 1, repeats: bool = True) -> np.ndarray:
    """The SimHashes of UTF-8 texts, ``(text, count)`` signed 64-bit numbers: of the shingles' hashes, then of hashes mixed
    from those. Without ``repeats``, each different shingle counts once.

    All texts are counted together: hashes stand in blocks of one text each, and eight bits of a number at a time are
    summed up in its eight bytes, block by block."""
    found = [_shingles(t, shingle) for t in texts]
    if not repeats:
        found = [np.unique(f) for f in found]
    sizes = np.array([len(f) for f in found], np.int64)
    hashes = np.concatenate([*found, np.zeros(0, "<u8")])
    blocks = -(-sizes // _BLOCK)
    text = np.repeat(np.arange(len(texts)), blocks)
    within = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = np.append((np.cumsum(sizes) - sizes)[text] + within * _BLOCK, len(hashes))
    total = np.zeros((count, len(texts), 8, 8), np.int64)
    for k in range(0, len(text), _BLOCKS):
        own, edges = text[k : k + _BLOCKS], starts[k : k + _BLOCKS + 1]
        part, at = hashes[edges[0] : edges[-1]], edges[:-1] - edges[0]
        for n in range(count):
            mixed = _mixed(part, n) if n else part
            for bit in range(8):
                sums = np.add.reduceat((mixed >> np.uint64(bit)) & _LANES, at)
                np.add.at(total[n, :, :, bit], own, sums.view(np.uint8).reshape(-1, 8))
    bits = 2 * total.reshape(count, len(texts), 64) > sizes[None, :, None]
    return np.packbits(bits, axis=2, bitorder="little").view("<i8").reshape(count, len(texts)).T


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Other hashes from these: a multiplicative mix with a constant of its own for each ``k``."""
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = 4, count: int = 1, repeats: bool = True) -> DataFrame:
    """``(keep, code, row)`` for every row of ``docs``: the named columns as one struct, the array of fingerprints,
    and a number of its own for the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [0]
        for batch in batches:
            found = np.ascontiguousarray(fingerprints_of(column_bytes(batch, 1), shingle, count, repeats)).ravel()
            codes = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * count), pa.array(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), codes, row_numbers(seen, batch.num_rows)], ["keep", "code", "row"])

    given = docs.select(F.struct(*named(keep)).alias("keep"), *[c.alias("text") for c in named([text_col])])
    more = [T.StructField("code", T.ArrayType(T.LongType())), T.StructField("row", T.LongType())]
    return mapped(given, run, T.StructType([given.schema["keep"], *more]))


class Segment(NamedTuple):
    """Bits of one fingerprint that a table is keyed by, and the radius of the balls around their value."""

    word: int
    low: int
    width: int
    radius: int

    @property
    def cover(self) -> int:
        return ((1 << self.width) - 1) << self.low

    def flips(self, radius: int) -> list[int]:
        """Every point of the ball, as what differs from its centre."""
        bits = [1 << i for i in range(self.low, self.low + self.width)]
        return [sum(c) for n in range(radius + 1) for c in itertools.combinations(bits, n)]

    @property
    def rows(self) -> float:
        """Rows that a value looks up on average: of two values that differ in a flip, one alone does."""
        return (1 + sum(math.comb(self.width, n) for n in range(self.radius + 1))) / 2


def _cost(plan: list[Segment], n: int) -> float:
    """What a value costs among ``n``: the rows it looks up, and the matches that chance gives them."""
    return sum(s.rows + n * s.rows / 2**s.width / _MATCHES_A_ROW for s in plan)


def segment_plan(max_distance: int, segments: int) -> list[Segment]:
    """The segments of one fingerprint that must be looked up. With ``max_distance = a * segments + b``, a pair that
    differs in more than ``a`` bits in each of the first ``b + 1`` segments and in more than ``a - 1`` in each of the rest
    differs in more than ``max_distance`` bits in all."""
    a, b = divmod(max_distance, segments)
    edges = [round(64 * k / segments) for k in range(segments + 1)]
    plan = [Segment(0, lo, hi - lo, a if k <= b else a - 1) for k, (lo, hi) in enumerate(itertools.pairwise(edges))]
    return [s for s in plan if s.radius >= 0]


def complete_plan(n: int, max_distance: int) -> list[Segment]:
    """The cheapest of the plans that lose no pair among ``n`` values."""
    return min((segment_plan(max_distance, k) for k in range(2, 17)), key=lambda plan: _cost(plan, n))


def differing(similarity: float) -> float:
    """The share of bits in which sets of this Jaccard similarity and equal size differ on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _at_most(k: int, n: int, q: float) -> float:
    """The probability that at most ``k`` of ``n`` bits differ."""
    return sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1))


def likely_plan(n: int, count: int, least: float, missed: float) -> list[Segment]:
    """Segments with a radius of one such that a pair of similarity ``least`` is within none of them with a probability of
    ``missed`` at most. They are so wide that chance gives a slot few of ``n`` rows; the wider they are, the more it takes.
    ValueError if ``count`` fingerprints have too few."""
    width = next((w for w in WIDTHS if n <= SLOT_ROWS << w), WIDTHS[-1])
    tables = math.ceil(math.log(missed) / math.log1p(-_at_most(1, width, differing(least))))
    if tables > count * (64 // width):
        raise ValueError(f"{tables} segments of {width} bits take more than {count} fingerprints")
    return [Segment(k % count, k // count * width, width, 1) for k in range(tables)]


def most_differing(count: int, least: float, kept: float) -> int:
    """The bits of ``count`` fingerprints in which a pair of similarity ``least`` differs at most, with probability ``kept``."""
    q = differing(least)
    return next(k for k in range(64 * count + 1) if _at_most(k, 64 * count, q) >= kept)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Lookups:
    """Tables and lookups of a plan over nodes ``(node, code, part, large)``: ``code`` is an array of ``count``
    fingerprints. A pair is near if it differs in at most ``max_bits`` bits of all of them."""

    def __init__(self, plan: list[Segment], count: int, max_bits: int):
        self.plan, self.count, self.max_bits = plan, count, max_bits

    def _rows(self, nodes: DataFrame, points: list[tuple[int, int]]) -> DataFrame:
        """``(slot, node, code, part, same)``: a row for each node and point ``(segment, flip)``, the lowest bit of the flip
        being 0 in the node."""
        made = []  # as SQL: a ball may have hundreds of points
        for k, flip in points:
            s = self.plan[k]
            made.append(f"struct({k} AS seg, {s.word} AS at, {s.low} AS low, {_signed(s.cover)}L AS cover, {_signed(flip)}L AS flip, {_signed(flip & -flip)}L AS lowest)")
        rows = nodes.select("node", "code", "part", F.explode(F.expr(f"array({', '.join(made)})")).alias("s")).withColumn("fp", F.get("code", F.col("s.at")))
        key = F.call_function("shiftrightunsigned", F.col("fp").bitwiseXOR(F.col("s.flip")).bitwiseAND(F.col("s.cover")), F.col("s.low"))
        slot = F.col("s.seg").cast("long") * F.lit(1 << 40) + key
        return rows.where(F.col("fp").bitwiseAND(F.col("s.lowest")) == 0).select(slot.alias("slot"), "node", "code", "part", (F.col("s.flip") == 0).alias("same"))

    def _tables(self, nodes: DataFrame, segments: range) -> DataFrame:
        """``(slot, b, code_b, of_b)``."""
        rows = self._rows(nodes, [(k, 0) for k in segments])
        return rows.select("slot", F.col("node").alias("b"), F.col("code").alias("code_b"), F.col("part").alias("of_b"))

    def _apart(self) -> Column:
        """The bits in which ``code`` and ``code_b`` differ; no function over arrays, so that the join compiles it."""
        bits = [F.bit_count(F.get("code", F.lit(k)).bitwiseXOR(F.get("code_b", F.lit(k)))) for k in range(self.count)]
        return sum(bits[1:], bits[0])

    def _once(self) -> Column:
        """Of a single fingerprint: whether this segment is the first that finds the pair."""
        first = F.lit(True)
        if self.count == 1:
            apart = F.get("code", F.lit(0)).bitwiseXOR(F.get("code_b", F.lit(0)))
            for k, s in enumerate(self.plan):
                first = first & ((F.col("slot") <= F.lit((k + 1 << 40) - 1)) | (F.bit_count(apart.bitwiseAND(F.lit(_signed(s.cover)))) > s.radius))
        return first

    def stars(self, nodes: DataFrame, segments: range) -> DataFrame:
        """Near pairs ``(a, b, total, part_a, part_b)`` of a node with the least node that has its value in some segment: no more than nodes
        and segments, however many rows a slot has. Spark splits a partition that has very many (adaptive skew join)."""
        table = self._tables(nodes, segments).select("slot", F.col("b").alias("node"), F.col("code_b").alias("code"))
        heads = table.groupBy("slot").agg(F.min(F.struct("node", "code")).alias("head")).select("slot", F.col("head.node").alias("b"), F.col("head.code").alias("code_b"))
        met = table.hint("merge").join(heads, "slot").where((F.col("node") > F.col("b")) & (self._apart() <= self.max_bits))
        return met.select(F.col("node").alias("a"), "b", self._apart().alias("total"), F.col("node").alias("part_a"), F.col("b").alias("part_b")).distinct()

    def rounds(self) -> Iterator[range]:
        """The segments of each round of lookups."""
        start, held = 0, 0.0
        for k, s in enumerate(self.plan):
            if k > start and held + s.rows > ROUND_ROWS:
                yield range(start, k)
                start, held = k, 0.0
            held += s.rows
        if self.plan:
            yield range(start, len(self.plan))

    def across(self, nodes: DataFrame, segments: range) -> DataFrame:
        """Near pairs ``(a, b, total, part_a, part_b)`` of nodes of different parts, by some segments. A slot's rows may be many where a large
        part has them; they are all of different texts, and Spark splits such a partition as it joins."""
        points = [(k, f) for k in segments for f in self.plan[k].flips(self.plan[k].radius)]
        table = self._tables(nodes, segments)
        near = (self._apart() <= self.max_bits) & (~F.col("same") | (F.col("node") < F.col("b"))) & self._once()
        # merged, never broadcast: a plan's guess of the sizes doesn't see what explode makes
        single = self._rows(nodes.where("not large"), points).hint("merge").join(table, "slot").where((F.col("part") != F.col("of_b")) & near)
        # a large part asks once for the rows of other parts in a slot, and its members meet those alone
        many = self._rows(nodes.where("large"), points)
        others = many.select("slot", "part").distinct().hint("merge").join(table, "slot").where(F.col("part") != F.col("of_b"))
        members = many.hint("merge").join(others, ["slot", "part"]).where(near)
        first = F.col("node") < F.col("b")
        parts = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(name) for x, y, name in (("part", "of_b", "part_a"), ("of_b", "part", "part_b"))]
        found = [x.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"), self._apart().alias("total"), *parts) for x in (single, members)]
        return found[0].union(found[1]) if self.count == 1 else found[0].union(found[1]).distinct()


class Alike:
    """Keeps pairs ``(a, b, total, part_a, part_b)`` whose texts have a Jaccard similarity of ``least`` or more by different shingles. ``held`` has the
    texts by row. Pairs that differ in fewer of ``64 * count`` bits than any below that similarity would by chance are some
    at once."""

    def __init__(self, held: DataFrame, text_col: str, shingle: int, count: int, least: float):
        self.held, self.text_col, self.shingle, self.least = held, text_col, shingle, least
        bits, q = 64 * count, differing(least)
        self.sure_total = round(bits * q - 3.3 * math.sqrt(bits * q * (1 - q)))

    def __call__(self, pairs: DataFrame) -> DataFrame:
        pairs = pairs.select("a", "b", "part_a", "part_b", "total")
        return pairs.where(F.col("total") <= self.sure_total).drop("total").union(self.compared(pairs.where(F.col("total") > self.sure_total).drop("total")))

    def compared(self, pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row"))).distinct()
        texts = self.held.join(ends, "row", "left_semi").select("row", F.col("keep").getField(self.text_col).alias("text"))
        shingle, least = self.shingle, self.least

        def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [np.unique(_shingles(t, shingle)).tobytes() for t in column_bytes(batch, 1)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["row", "set"])

        def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            return batch.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

        known = saved(arrow_map(texts, sets, "row long, set binary"), "simhash-sets")
        joined = pairs.join(known.select(F.col("row").alias("a"), F.col("set").alias("set_a")), "a")
        joined = spread_join(joined, known.select(F.col("row").alias("b"), F.col("set").alias("set_b")), "b", "a")
        return saved(arrow_map(joined.select("a", "b", "part_a", "part_b", "set_a", "set_b"), compare, "a long, b long, part_a long, part_b long"), "simhash-alike")


def groups(rows: DataFrame, make: Callable[[int], Lookups], verify: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(code, component, component_id)`` for each different ``code`` of ``rows(code, doc_id, row)``: ``make`` gives the lookups
    for a count of codes, and ``verify`` keeps the links among near pairs ``(a, b, total, part_a, part_b)`` of nodes."""
    nodes = saved(rows.groupBy("code").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "simhash-distinct")
    lookups = make(nodes.count())
    step = 4 * max(map(len, lookups.rounds()))  # of stars, a segment has one row a node

    def links(rounds: Iterable[DataFrame]) -> DataFrame:
        pairs = None
        for found in rounds:
            found = saved(found, "simhash-pairs")
            pairs = found if pairs is None else pairs.union(found)
            shuffles_end(found.sparkSession)
        if verify is None:
            return pairs
        return verify(saved(pairs.distinct(), "simhash-near"))

    def joined(found: DataFrame) -> DataFrame:
        """Components of the parts that links join: many links between two parts are one edge."""
        return components(found.select(F.col("part_a").alias("a"), F.col("part_b").alias("b")))

    alone = nodes.select("node", "code", F.col("node").alias("part"))
    close = joined(links(lookups.stars(alone, range(k, min(k + step, len(lookups.plan)))) for k in range(0, len(lookups.plan), step)))
    sizes = close.groupBy(F.col("component").alias("part")).count().where(F.col("count") >= LARGE).select("part", F.lit(True).alias("large"))
    parted = nodes.join(close, "node", "left").select("node", "code", "least", F.coalesce("component", "node").alias("part"))
    parted = saved(spread_join(parted, sizes, "part", "node", "left").withColumn("large", F.coalesce("large", F.lit(False))), "simhash-parts")
    whole = joined(links(lookups.across(parted, segments) for segments in lookups.rounds())).withColumnRenamed("node", "part")
    labelled = spread_join(parted.select("node", "code", "least", "part"), whole, "part", "node", "left").withColumn("component", F.coalesce("component", "part"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    return spread_join(labelled, least, "component", "node").select("code", "component", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """One row per document: ``doc_id``, ``code`` (an array of its fingerprint) and ``component_id``, the least id that links
    reach. Fingerprints link at ``max_distance`` or fewer differing bits; every such pair is found."""
    held = saved(fingerprints(docs, [id_col], text_col, shingle), "simhash")
    rows = held.select(F.col("keep").getField(id_col).alias("doc_id"), "code", "row")
    grouped = groups(rows, lambda n: Lookups(complete_plan(n, max_distance), 1, max_distance))
    return spread_join(rows, grouped, "code", "row").select("doc_id", "code", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, count: int = 12, missed: float = 0.03) -> DataFrame:
    """``docs`` with one row of each component: that with the least id, of equal ids the first saved. Documents link at a
    Jaccard similarity of ``least`` or more by their different shingles; of pairs at ``least``, the lookups miss a share of
    ``missed`` and the bound on all bits about one in twenty, of pairs above it few. Documents that agree in all ``count``
    fingerprints are copies."""
    held = saved(fingerprints(docs, docs.columns, text_col, shingle, count, repeats=False), "simhash")
    rows = held.select(F.col("keep").getField(id_col).alias("doc_id"), "code", "row")

    def make(n: int) -> Lookups:
        return Lookups(likely_plan(n, count, least, missed), count, most_differing(count, least, 0.95))

    grouped = spread_join(rows, groups(rows, make, Alike(held, text_col, shingle, count, least)), "code", "row")
    # the least id first, then the least row among those that have it; both are summed up before a shuffle
    first = grouped.where("doc_id <=> component_id").groupBy("component").agg(F.min("row").alias("row"))
    return held.join(first.select("row"), "row", "left_semi").select("keep.*")


def hex_fingerprint(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
