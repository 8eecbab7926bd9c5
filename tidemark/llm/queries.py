"""The registered queries of this subpackage: each applies one operator with production parameters to its
whole table and derives the reported columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, html, packing, pii, quality, simhash, spm, sql, urlfilter, vectors, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def tokenizer_path() -> str:
    """The production vocabulary, where the public tokenizers' package keeps it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    found = warc.resolved(warc.read(warc.index(spark, archives), payloads=False))
    return found.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def listed(kinds: tuple[str, ...]) -> Column:
        return F.array_join(F.transform(of(*kinds), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(listed(pii.BASE_KINDS), 256).alias("base_sha256"),
        listed(pii.KINDS).alias("spans"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path())
    return packing.pack(cut.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it again."""
    import public_tokenizers

    path, docs = public_tokenizers.path("piece_bpe_32k.model"), table(spark, sf_dir, "documents")
    both = spm.encode_and_decode(docs, path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.length("decoded").cast("long").alias("n_decoded"), (F.col("text") == F.col("decoded")).alias("round_trip"))


RULES = [
    urlfilter.Rule("block", "com", "/en/"),
    urlfilter.Rule("allow", "example.com", "/en/7"),
    urlfilter.Rule("allow", "net", "/de/"),
    urlfilter.Rule("block", "example.net", "/de/8"),
    urlfilter.Rule("block", "org", "/es/"),
]
#: The listed domains: each of these names below each of these suffixes.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_SUFFIXES = ("example.com", "example.net", "example.org")
LISTED = [f"{n}.{s}" for n in LISTED_NAMES for s in LISTED_SUFFIXES]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(d,) for d in LISTED], "key string")
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, listed).select("page_id", "judged.*")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("code")[0]).alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    references = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, ["doc_id"], references).select("doc_id", "quality.*").withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_html_text, op3_pii, op4_packing, op5_chat_formatting, op6_sentencepiece, op7_url_filter, op8_simhash_near_dedup, op9_quality, op10_embedding_near_dedup)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": sql.warc(),
        "op5_chat_formatting": sql.chat(),
        "op7_url_filter": sql.url_filter(RULES, LISTED),
        "op9_quality": sql.quality(),
        "op10_embedding_near_dedup": sql.vectors(),
    }
