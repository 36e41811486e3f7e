"""Token counts through a cache of content digests.

A text's key is the SHA-256 of its normal form; a tokenizer's is that of its
library and file. Known counts are joined; each distinct text without one is
encoded once and appended to the cache, a Parquet folder partitioned by
tokenizer. Normal form: null becomes the empty text, else the text itself, as
counts must be those of the whole text byte for byte; pass `normal` for a
tokenizer that is blind to more.

Copies meet in a partial aggregate before the shuffle, so a text that a third of
the rows hold is one row a task. Where few texts are unknown, their digests are
broadcast (at most BROADCAST_ROWS of 32 bytes) and only their texts are moved.

Defined results: null text counts as empty, with 0 bytes and 0 tokens; rows with
null or repeated ids are counted one by one; an empty table gives an empty
result; input columns named n_bytes, n_tokens or over_limit give way to the result's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .given import Given
from .hashing import slices
from .scratch import Scratch
from .tokens import encoder, version_digest

BROADCAST_ROWS = 100_000
OUT = ("n_bytes", "n_tokens", "over_limit")


def _cached(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(content binary, n_tokens long) of one tokenizer version; empty where nothing was stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/tokenizer={tokenizer}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "content binary, n_tokens long")
    return spark.read.schema("content binary, n_tokens long").parquet(f"{cache}/tokenizer={tokenizer}")


def token_counts(
    spark: SparkSession, docs: DataFrame, tokenizer: str, *, text_col: str = "text", cache: str | None = None, limit: int = 512, normal: Callable[[Column], Column] = lambda text: F.coalesce(text, F.lit(""))
) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit). cache: a shared folder, kept between calls; without one, a folder of this call."""
    scratch = Scratch(spark, "token_counts")
    cache, version = cache or f"{scratch.root}/cache", version_digest(tokenizer)
    given = Given(docs, [c for c in docs.columns if c not in OUT])
    docs, text_col = given.df, given.name(text_col)
    digest = F.unhex(F.sha2(normal(F.col(text_col)), 256))
    texts = docs.select(digest.alias("content"), normal(F.col(text_col)).alias("text"))
    known = _cached(spark, cache, version)
    if not known.isEmpty():
        misses = texts.select("content").distinct().join(known, "content", "left_anti")
        few = misses.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        texts = texts.join(F.broadcast(misses), "content", "left_semi") if few else texts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids
        for batch in batches:
            for part in slices(batch, 1, 8 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(encode(t)) for t in part.column(1).to_pylist()], pa.int64())], ["content", "n_tokens"])

    distinct = texts.groupBy("content").agg(F.first("text").alias("text"))
    if not known.isEmpty():
        distinct = distinct.join(known, "content", "left_anti")
    distinct.mapInArrow(count, "content binary, n_tokens long").write.mode("append").parquet(f"{cache}/tokenizer={version}")
    # one row a digest even if two writers appended the same text at once
    counts = scratch.table(_cached(spark, cache, version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    keyed = docs.withColumns({"n_bytes": F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"), "_content": digest})
    # left: a row is never lost; if another process empties the cache meanwhile, that is an error and not a null
    joined = keyed.join(counts.withColumnRenamed("content", "_content"), "_content", "left")
    n = F.coalesce("n_tokens", F.raise_error(F.lit("the cache lost counts while they were read")).cast("long"))
    return joined.select(*given.back(), "n_bytes", n.alias("n_tokens"), (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document. The cache is new for each call, so every distinct text is encoded."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(spark, docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", *OUT)
