"""URL verdicts: host and path rules, and a blocklist of domains as a Bloom filter cascade.

The corpus's complete key universe is known: every host in it and every parent domain of one. Level 0 of the
cascade encodes the listed keys; level 1 the universe's keys that level 0 lets through though they are not
listed; level 2 the listed keys that level 1 lets through; and so on until nothing is let through wrongly.
Over that universe membership is then exact, and judging the pages needs no join: each row tests its own few
keys. The filters take a fixed number of bits for a listed key and a small share of that for a universe key;
their sum is checked against ``max_bytes`` before anything is sent to the executors. A longer list is to be
judged in several calls, whose blocks add up.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is allowed;
repeated rows each keep a row; other columns pass through untouched; null or empty listed keys are ignored;
an empty list allows everything that no rule blocks; an input column named like ``out_col`` gives way to it. An
empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_map, free_name, mapped, named, saved

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclasses.dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = ""

    @property
    def name(self) -> str:
        return self.host + self.path


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, UPPER.lower()), F.lit(""))


def path(url: Column) -> Column:
    """What stands after the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(rules: list[Rule], host_col: Column, path_col: Column) -> Column:
    """``(rule, verdict)`` of the longest rule that fits, or null. The rules are a short parameter list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is asked first
        fits = (host_col == r.host) | host_col.endswith("." + r.host)
        out = F.when(fits & path_col.startswith(r.path), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def domain_keys(host_col: Column) -> Column:
    """The host and its parent domains; none for an empty host."""
    labels = F.split(host_col, r"\.")
    return F.when(host_col == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))


def key_hashes(key: Column) -> list[Column]:
    """Two independent 64-bit hashes of a key."""
    return [F.xxhash64(key), F.xxhash64(key, F.lit(1))]


def _nth_hash(i: int) -> Callable[[Column], Column]:
    return lambda k: key_hashes(k)[i]


@dataclasses.dataclass
class Bloom:
    """One level: ``words`` holds ``n_bits`` bits. Places come from two 64-bit hashes of a key."""

    level: int
    n_bits: int
    hashes: int
    words: np.ndarray

    @staticmethod
    def places(level: int, n_bits: int, hashes: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        steps = np.arange(level * hashes, (level + 1) * hashes, dtype=np.uint64)
        with np.errstate(over="ignore"):
            mixed = h1[:, None] + steps * (h2 | np.uint64(1))[:, None]
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(8)) % np.uint64(n_bits)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self.places(self.level, self.n_bits, self.hashes, h1, h2)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


class Cascade:
    """Exact membership over the universe it was built for."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """A key is judged by the first level that hasn't got it: listed if that level is odd. One that all levels
        have is listed if the number of levels is odd."""
        inside = np.zeros(len(h1), bool)
        open_ = np.arange(len(h1))
        for b in self.levels:
            found = b.has(h1[open_], h2[open_])
            inside[open_[~found]] = b.level % 2 == 1
            open_ = open_[found]
        inside[open_] = len(self.levels) % 2 == 1
        return inside


def _hash_arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    h1, h2 = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("h1", "h2"))
    return h1, h2


def _filter(keys: DataFrame, n: int, level: int, bits_per_key: int, hashes: int) -> Bloom:
    """The level that has ``keys(h1, h2)``: words are joined by task and by word before they reach the driver,
    which gets ``n * bits_per_key / 64`` of them at most."""
    n_bits = max(64, n * bits_per_key)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(Bloom.places(level, n_bits, hashes, *_hash_arrays(batch)))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    found = mapped(keys.select("h1", "h2"), words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros((n_bits + 63) // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Bloom(level, n_bits, hashes, out)


def _through(keys: DataFrame, level: Bloom) -> DataFrame:
    """The keys that ``level`` has."""
    sent = keys.sparkSession.sparkContext.broadcast(level)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(sent.value.has(*_hash_arrays(batch))))

    return arrow_map(keys, make, keys.schema)


class TooLarge(ValueError):
    """Filters that would take more than their bound."""


def _hashed(keys: DataFrame) -> DataFrame:
    return keys.select("key").where("key <> ''").distinct().select("key", *[h.alias(n) for h, n in zip(key_hashes(F.col("key")), ("h1", "h2"))])


def cascade(inside: DataFrame, outside: DataFrame, bits_per_key: int = 12, hashes: int = 8, max_bytes: int = 64 << 20) -> Cascade:
    """The cascade of the listed keys ``inside(key, h1, h2)`` over the universe ``outside(key, h1, h2)``."""
    levels: list[Bloom] = []
    encode, other, held = inside, outside, 0
    while n := encode.count():
        held += n * bits_per_key // 8
        if held > max_bytes:
            raise TooLarge(f"the filters would take over {max_bytes} bytes")
        levels.append(_filter(encode, n, len(levels), bits_per_key, hashes))
        let = _through(other, levels[-1])
        if len(levels) == 1:  # the universe's own listed keys are no mistakes
            let = let.join(inside.select("key"), "key", "left_anti")
        # what was let through is encoded next; what this level encodes must then be told from it
        encode, other = saved(let, "let-through"), encode
    return Cascade(levels)


@dataclasses.dataclass
class Part:
    """The cascade of the keys whose first hash ends in the ``bits`` bits ``value``."""

    bits: int
    value: int
    cascade: Cascade

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        own = np.flatnonzero(h1 & np.uint64((1 << self.bits) - 1) == np.uint64(self.value))
        inside = np.zeros(len(h1), bool)
        inside[own] = self.cascade.has(h1[own], h2[own])
        return inside


def parts(universe: DataFrame, listed: DataFrame, max_bytes: int = 64 << 20) -> Iterator[Part]:
    """Cascades of ``listed(key)`` over ``universe(key)``, each within ``max_bytes``, that have every key among them."""
    inside, outside = saved(_hashed(listed), "listed"), saved(_hashed(universe), "universe")
    open_ = [(0, 0)]
    while open_:
        bits, value = open_.pop()
        own = [k.where(F.col("h1").bitwiseAND(F.lit((1 << bits) - 1)) == value) for k in (inside, outside)]
        try:
            yield Part(bits, value, cascade(*own, max_bytes=max_bytes))
        except TooLarge:
            if bits == 32:
                raise
            open_ += [(bits + 1, value), (bits + 1, value | 1 << bits)]


def _tested(hashed: DataFrame, part: Part) -> DataFrame:
    """``hashed(_, host, path, h1, h2, hit)``, ``hit`` also where one of the row's keys is listed in the part."""
    sent = hashed.sparkSession.sparkContext.broadcast(part)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(3)
        rows = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        flat = [batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in (3, 4)]
        hit = batch.column(5).to_numpy(zero_copy_only=False).copy()
        hit[rows[sent.value.has(*flat)]] = True
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(hit)], batch.schema.names)

    return arrow_map(hashed, make, hashed.schema)


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, url_col: str = "url", out_col: str = "judged", max_bytes: int = 64 << 20) -> DataFrame:
    """``pages`` with a struct ``out_col``: ``host``, ``path``, ``rule`` and ``verdict``. Each pass sends the executors filters of
    ``max_bytes`` at most."""
    url = named([url_col])[0]
    hosts = pages.select(host(url).alias("host")).distinct()
    universe = hosts.select(F.explode(domain_keys(F.col("host"))).alias("key"))
    own = [c for c in pages.columns if c.lower() != out_col.lower()]
    carried = free_name(pages, "_carried")
    # a struct can't be without a field
    split = pages.select(F.struct(*named(own), F.lit(None).cast("boolean").alias(free_name(pages, "_none"))).alias(carried), host(url).alias("host"), path(url).alias("path"))
    with_keys = split.select("*", domain_keys(F.col("host")).alias("keys"))
    tested = with_keys.select(carried, "host", "path", *[F.transform("keys", _nth_hash(i)).alias(f"h{i + 1}") for i in range(2)], F.lit(False).alias("hit"))
    written: list[DataFrame] = []
    for k, part in enumerate(parts(universe, listed, max_bytes)):
        if k:
            tested = saved(tested, "judged", instead_of=written)
            written = [tested]
        tested = _tested(tested, part)
    ruled = tested.select("*", matched_rule(rules, F.col("host"), F.col("path")).alias("fit"))
    method = F.when(F.col("hit"), "block").otherwise("allow")
    verdict = F.struct("host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"))
    return ruled.select(*[F.col(carried).getField(c).alias(c) for c in own], verdict.alias(out_col))
