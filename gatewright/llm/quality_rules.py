"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio.

Each word and each pair of neighbouring words is hashed into one of BUCKETS. Two
multinomials over the buckets are counted: of all documents, and of trusted
ones. A document's score is the mean over its n-grams of log(trusted / all), in
nats; it is kept if it passes the base rules and its score is at least
-(rate + sampling / sqrt(n-grams of the target) + allowance / its n-grams): few
trusted documents give rougher weights, and the mean of a short text varies more.
All of it is DataFrame functions. Trusted documents are all that are labelled
quality 1. Up to BROADCAST_ROWS of their ids are broadcast; more are joined by a
shuffle of ids and texts into a hash table of ids (documents without an id stay
where they are). Scoring shuffles nothing. Bucket counts are partial aggregates of
BUCKETS rows a task, and reach expressions as one array through a scalar subquery.

Base rules, as columns: n_words; word_chars (code points in words); n_symbols
(characters of #*$%&|<>); n_dup_lines (lines with a word that equal an earlier
line of the text); n_repeat_words (words in windows of 8 that occur twice or
more in the text). base_failed: n_words under 20, or n_repeat_words over 30 % of them.

Defined results: null text has no words, fails the base rules and scores 0; rows
with null or repeated ids are judged one by one (a null id is never trusted);
without trusted documents every score is 0; an empty table gives an empty
result; input columns named like the result's give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .given import Given
from .scratch import Scratch

BUCKETS = 1 << 14
BROADCAST_ROWS = 10_000
RATE, ALLOWANCE, SAMPLING = 0.03, 2.2, 15.0
WINDOW = 8
SPACE = " \t\n\x0b\x0c\r"
OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept")


def bind(value: Column, use) -> Column:
    """use(value), with value computed once a row even where inner functions read it often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """Words of a text, [^\\x20\\x09-\\x0D]+, as an array; none for null."""
    bare = F.trim(text, F.lit(SPACE))
    return F.when(bare != "", F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows that occur twice or more among these words."""

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = F.filter(s, lambda x, k: (F.get(s, k - 1).h == x.h).eqNullSafe(True) | (F.get(s, k + 1).h == x.h).eqNullSafe(True))
            return F.array_sort(F.transform(same, lambda x: x.i))

        def total(p: Column) -> Column:
            step = lambda a, k: a + F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(window)))
            return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), step)

        return bind(bind(placed, places), total)

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(window))))
        return bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))

    return F.when(F.size(words) <= window, 0).otherwise(bind(words, of))


def bucket(*words: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(buckets)).cast("int")


def grams(words: Column, buckets: int) -> Column:
    """Buckets of all words and word pairs."""
    ones = F.transform(words, lambda w: bucket(w, buckets=buckets))
    twos = F.transform(words, lambda w, i: F.when(i > 0, bucket(F.get(words, i - 1), w, buckets=buckets)))
    return F.concat(ones, F.filter(twos, lambda x: x.isNotNull()))


def gram_weights(spark: SparkSession, scratch: Scratch, docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int) -> tuple[Column, int]:
    """A scalar: the array of log(trusted share / share among all) by bucket, each count one higher than it is. And the number of n-grams of the target."""
    ids = trusted.where(F.col(id_col).isNotNull()).select(id_col).distinct()
    ids = scratch.table(ids.withColumn("trusted", F.lit(1)), "trusted")
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        flagged = docs.join(F.broadcast(ids), id_col, "left")
    else:
        # null ids match nothing and would all meet in one task
        known = docs.where(F.col(id_col).isNotNull()).join(ids.hint("shuffle_hash"), id_col, "left")
        flagged = known.unionByName(docs.where(F.col(id_col).isNull()).withColumn("trusted", F.lit(None).cast("int")))
    words = flagged.select("trusted", words_of(F.col(text_col)).alias("words"))
    marked = words.select("trusted", F.explode(bind(F.col("words"), lambda w: grams(w, buckets))).alias("bucket"))
    counts = scratch.table(marked.groupBy("bucket").agg(F.count("*").alias("n"), F.count("trusted").alias("t")), "counts")
    sums = counts.agg(F.sum("n").alias("n"), F.sum("t").alias("t")).first()
    n, t = sums["n"] or 0, sums["t"] or 0
    ratio = F.log((F.coalesce("t", F.lit(0)) + 1) / F.lit(float(t + buckets))) - F.log((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(n + buckets)))
    weight = ratio if t else F.lit(0.0)
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").select("bucket", weight.alias("weight"))
    whole = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "weight"))).alias("all")).select(F.col("all.weight").alias("weights"))
    return scratch.table(whole, "weights").scalar(), t


def quality(
    spark: SparkSession,
    docs: DataFrame,
    trusted: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    rate: float = RATE,
    allowance: float = ALLOWANCE,
    sampling: float = SAMPLING,
    min_words: int = 20,
    max_repeat_percent: int = 30,
) -> DataFrame:
    """docs with the columns OUT. trusted: rows with the ids of documents to take as the target."""
    scratch = Scratch(spark, "quality")
    given = Given(docs, [c for c in docs.columns if c not in OUT])
    weights, target = gram_weights(spark, scratch, docs.select(id_col, text_col), trusted, id_col, text_col, buckets)
    docs, text_col = given.df, given.name(text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")

    def measure(w: Column, weights: Column) -> Column:
        def add(a: Column, i: Column) -> Column:
            pair = F.when(i > 0, F.get(weights, bucket(F.get(w, i - 1), F.get(w, i), buckets=buckets))).otherwise(0.0)
            return a + F.get(weights, bucket(F.get(w, i), buckets=buckets)) + pair

        total = F.aggregate(F.sequence(F.lit(0), F.size(w) - 1), F.lit(0.0), add)
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.when(F.size(w) > 0, total / (2 * F.size(w) - 1)).otherwise(0.0).alias("score"),
        )

    # the one use of the scalar: Catalyst folds it into the measure, so the array is never a column of a row
    measured = docs.withColumn("_weights", weights).withColumns(
        {
            "_m": bind(F.col("_weights"), lambda v: bind(words_of(F.col(text_col)), lambda w: measure(w, v))),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        }
    )
    columns = {k: F.col(f"_m.{k}") for k in ("n_words", "word_chars", "n_repeat_words", "score")}
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = measured.withColumns(columns).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= -(rate + sampling / max(1, target) ** 0.5 + allowance / (2 * F.col("n_words") - 1))))
    return out.select(*given.back(), *OUT)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; those labelled 1 are the trusted target."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return quality(spark, docs, trusted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
