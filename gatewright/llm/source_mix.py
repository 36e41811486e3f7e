"""Mixing sources to target weights by Sainte-Laguë apportionment.

Target words are cut into blocks of BLOCK words. Blocks go to sources by highest
quotients target / (2 k + 1), then each source's blocks to its shards by highest
quotients of their sizes; so every shard has an integer quota of blocks. In a shard
of about SHARD_ROWS rows, documents stand in a seeded order and their words form a
round of blocks; the quota takes whole rounds, and of the rest as many blocks from
a seeded one on, in a circle. So the selection cuts few documents, and no word is
taken more than twice, as no shard gets more than two rounds.

Apportionment is a search for the divisor at which rounded shares give out all
seats, in all groups at once: each pass tries 16 divisors in one partial aggregate,
until RANKED seats of a group at most are undecided; these are ranked by quotient. So
neither all sources nor all shards meet in one task: a group's row holds its bounds
only. Equal quotients are told apart by a seeded hash, worth a part in 10^9.

Targets: sources by code point, null last, have the weights in turn; `share` of
all sizes is divided by weight; where a target is above `most` times its
source's size it is cut to that, and the excess shared by weight again until none is above.

Defined results: a null text has size 0; such rows are kept and nothing of them
is taken; a null source is a source; rows with null or repeated ids, and repeated
rows, are placed one by one; an empty table gives an empty result; input columns
named size, source_size, target, taken or parts give way to the result's. The order
follows contents and the seed only, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .given import Given
from .scratch import Scratch

SHARD_ROWS, BLOCK = 512, 16
TRIED, PASSES, RANKED = 16, 18, 20_000
OUT = ("size", "source_size", "target", "taken")


def ranked(scratch: Scratch, df: DataFrame, key: str, name: str) -> DataFrame:
    """df with `rank`, from 0, by a key without repeats. Rows are range-sorted and numbered by partition; only a count a partition is gathered."""
    at = scratch.table(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return at.join(F.broadcast(parts), part == F.col("_part")).withColumn("rank", F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_base")


def targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """sources (size, weight, ...) with `target` in words."""
    total = share * float(sources.agg(F.sum("size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        above = F.col("size") * most < F.col("weight") * level
        row = sources.agg(F.sum(F.when(above, F.col("size") * most).otherwise(0.0)).alias("held"), F.sum(F.when(~above, F.col("weight")).otherwise(0.0)).alias("free"), F.count_if(above).alias("n")).first()
        if row["n"] == capped or not row["free"]:
            break
        level, capped = (total - row["held"]) / row["free"], row["n"]
    # where none is left free, all stop at their size
    return sources.withColumn("target", F.least(F.col("size") * most, F.col("weight") * level) if row["free"] else F.col("size") * most)


def apportion(scratch: Scratch, parties: DataFrame, seats: DataFrame, name: str, seed: int) -> DataFrame:
    """(group, party, given): seats by highest quotients votes / (2 k + 1), none above `most`, of equal quotients by a seeded hash. parties: group, party, votes, most; seats: group, seats."""
    luck = F.pmod(F.xxhash64(F.lit(seed), "group", "party"), F.lit(1 << 30)) / float(1 << 30)
    parties = parties.select("group", "party", F.col("votes").cast("double").alias("votes"), F.when(F.col("votes") > 0, F.col("most")).otherwise(0).cast("long").alias("most"))
    parties = scratch.table(parties.withColumn("votes", F.col("votes") * (1 + luck * 1e-9)), f"{name}-parties")
    totals = parties.groupBy("group").agg(F.sum("votes").alias("total"), F.max("votes").alias("top"), F.sum("most").alias("all"))
    state = totals.join(seats, "group").select("group", "total", "all", F.least("seats", "all").alias("seats"), F.lit(0.0).alias("low"), F.col("all").alias("low_n"), (F.col("top") * 3 + 1).alias("high"), F.lit(0).cast("long").alias("high_n"))
    given = lambda d: F.least(F.col("most"), F.when(d > 0, F.floor(F.col("votes") / F.greatest(d, F.lit(1e-300)) + 0.5)).otherwise(F.col("most"))).cast("long")
    # between the bounds of a group more seats change hands than are worth ranking one by one
    open_ = (F.col("high_n") < F.col("seats")) & (F.col("low_n") > F.col("seats")) & (F.col("low_n") - F.col("high_n") > RANKED) & (F.col("high") - F.col("low") > F.col("high") * 1e-15)
    state = scratch.table(state, f"{name}-0")
    for i in range(PASSES):
        if state.where(open_).isEmpty():
            break
        # first powers of two around the mean, then even steps between the bounds
        tried = [F.col("total") / F.greatest("seats", F.lit(1)) * 2.0 ** (j - TRIED // 2) if not i else F.col("low") + (F.col("high") - F.col("low")) * (j + 1) / (TRIED + 1) for j in range(TRIED)]
        asked = state.where(open_).select("group", *[d.alias(f"d{j}") for j, d in enumerate(tried)])
        sums = parties.join(asked, "group").groupBy("group").agg(*[F.first(f"d{j}").alias(f"d{j}") for j in range(TRIED)], *[F.sum(given(F.col(f"d{j}"))).alias(f"n{j}") for j in range(TRIED)])
        found = F.array(*[F.struct(F.col(f"d{j}").alias("d"), F.col(f"n{j}").alias("n")) for j in range(TRIED)])
        both = state.join(sums.select("group", found.alias("found")), "group", "left").withColumn("found", F.coalesce("found", F.array()))
        # the least divisor that gives out no more than all seats, and the greatest that gives more
        fits = F.array_min(F.filter("found", lambda x: (x.n <= F.col("seats")) & (x.d < F.col("high"))))
        over = F.array_max(F.filter("found", lambda x: (x.n > F.col("seats")) & (x.d > F.col("low"))))
        both = both.withColumns({"fits": fits, "over": over})
        bounds = {"low": ("over", "d"), "low_n": ("over", "n"), "high": ("fits", "d"), "high_n": ("fits", "n")}
        state = scratch.table(both.select("group", "total", "all", "seats", *[F.coalesce(F.col(c).getField(x), F.col(k)).alias(k) for k, (c, x) in bounds.items()]), f"{name}-{i + 1}")
        scratch.drop(f"{name}-{i}")
    out = parties.join(state, "group").withColumns({"sure": given(F.col("high")), "may": given(F.col("low")), "left": F.col("seats") - F.col("high_n")})
    # the seats left go by rank of their quotients
    next_ = out.where("left > 0 AND may > sure").select("group", "party", "left", "votes", F.explode(F.sequence("sure", F.col("may") - 1)).alias("k"))
    best = Window.partitionBy("group").orderBy(F.desc(F.col("votes") / (2 * F.col("k") + 1)), "party")
    more = next_.withColumn("place", F.row_number().over(best)).where(F.col("place") <= F.col("left")).groupBy("group", "party").agg(F.count("*").alias("more"))
    out = out.join(more, ["group", "party"], "left")
    return scratch.table(out.select("group", "party", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("given")), name)


def overlap(lo: Column, hi: Column, start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(hi, end) - F.greatest(lo, start))


def apart(scratch: Scratch, sized: DataFrame, most: int) -> DataFrame:
    """sized, where of rows alike in id and text no more than `most` have one order, so that a text that many rows repeat fills many shards. Alike rows are numbered by input partition, each in a task, from the counts of those before; which row has which number makes no difference."""
    hot = scratch.table(sized.groupBy("_order").agg(F.count("*").alias("n")).where(F.col("n") > most).select("_order"), "hot")
    if hot.isEmpty():
        return sized
    part = F.shiftright("_at", 33).alias("_part")
    alike = scratch.table(sized.select("_order", "_at", part).join(hot, "_order", "left_semi"), "alike")
    before = Window.partitionBy("_order").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = alike.groupBy("_order", "_part").agg(F.count("*").alias("n")).select("_order", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_order", "_part").orderBy("_at"))
    numbers = alike.withColumn("_own", own).join(bases, ["_order", "_part"]).select("_at", F.floor((F.col("_base") + F.col("_own") - 1) / most).alias("_pile"))
    order = F.when(F.col("_pile") > 0, F.xxhash64("_order", "_pile")).otherwise(F.col("_order"))
    return scratch.table(sized.join(numbers, "_at", "left").withColumn("_order", order).drop("_pile"), "apart")


def mix(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", columns: list[str] | None = None, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK, shard_rows: int = SHARD_ROWS, seed: int = 7) -> DataFrame:
    """docs (only `columns`, if given) with size (words), source_size, target (of the source), taken (words that the mix takes, repeats counted) and parts (array of start and length in words: what is taken beyond whole rounds)."""
    scratch = Scratch(spark, "source_mix")
    given_ = Given(docs, [c for c in columns or docs.columns if c not in (*OUT, "parts")])
    size = F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    # null sorts last
    key = F.when(F.col(source_col).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source_col)))
    content = F.xxhash64(F.coalesce(text_col, F.lit("")))
    sized = docs.select(*given_.columns, size.alias("size"), key.alias("_source"), content.alias("_content"), F.xxhash64(F.lit(seed), F.col(id_col), content).alias("_order"), F.monotonically_increasing_id().alias("_at"))
    sized = apart(scratch, scratch.table(sized, "sized"), shard_rows)
    sources = ranked(scratch, sized.groupBy("_source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "_source", "sources")
    sources = sources.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int")))
    sources = scratch.table(targets(sources, share, most), "targets")
    total = float(sources.agg(F.sum("target")).first()[0] or 0)
    seats = spark.range(1).select(F.lit("all").alias("group"), F.lit(round(total / block)).cast("long").alias("seats"))
    blocks = lambda n: F.ceil(F.col(n) * most / block)
    quotas = apportion(scratch, sources.select(F.lit("all").alias("group"), F.col("_source").alias("party"), F.col("target").alias("votes"), blocks("size").alias("most")), seats, "quotas", seed)

    shards = F.ceil(F.col("rows") / shard_rows)
    dealt = sized.join(sources.select("_source", F.col("size").alias("source_size"), "target", "rows"), "_source")
    dealt = dealt.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_order"), shards)).drop("rows")
    sums = scratch.table(dealt.groupBy("_source", "_shard").agg(F.sum("size").alias("shard_size")), "shards")
    given = apportion(scratch, sums.select(F.col("_source").alias("group"), F.col("_shard").alias("party"), F.col("shard_size").alias("votes"), blocks("shard_size").alias("most")), quotas.select(F.col("party").alias("group"), F.col("given").alias("seats")), "given", seed)
    given = sums.join(given.withColumnsRenamed({"group": "_source", "party": "_shard"}), ["_source", "_shard"])

    before = Window.partitionBy("_source", "_shard").orderBy("_order", "_content").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(given, ["_source", "_shard"]).withColumn("_lo", F.coalesce(F.sum("size").over(before), F.lit(0)))
    n = F.greatest(F.ceil(F.col("shard_size") / block), F.lit(1))
    placed = placed.withColumns({"_rounds": F.floor(F.col("given") / n), "_rest": F.col("given") % n, "_first": F.pmod(F.xxhash64(F.lit(seed + 2), "_source", "_shard"), n)})
    lo, hi, first = F.col("_lo"), F.col("_lo") + F.col("size"), F.col("_first") * block
    end = first + F.col("_rest") * block
    # the blocks from the first on, and those that lie at the front of the circle
    ahead, around = overlap(lo, hi, first, F.least(end, F.col("shard_size"))), overlap(lo, hi, F.lit(0), (F.col("_first") + F.col("_rest") - n) * block)
    parts = F.filter(F.array(F.struct(F.lit(0).cast("long").alias("start"), around.cast("long").alias("length")), F.struct(F.greatest(F.lit(0), first - lo).cast("long").alias("start"), ahead.cast("long").alias("length"))), lambda p: p.length > 0)
    return placed.select(*given_.back(), "size", "source_size", "target", (F.col("_rounds") * F.col("size") + ahead + around).cast("long").alias("taken"), parts.alias("parts"))


def taken_texts(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself: each row once for every time that it is taken whole, and once more with the words of its parts where it is taken in part."""
    part = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p.length)
    words = F.split(F.trim(text_col, F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")
    some = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(words, (p.start + 1).cast("int"), p.length.cast("int")))), " ")
    texts = F.concat(
        F.array_repeat(F.col(text_col), (F.floor((F.col("taken") - part) / F.greatest("size", F.lit(1))) + F.when(part == F.col("size"), 1).otherwise(0)).cast("int")),
        F.when((part > 0) & (part < F.col("size")), F.array(some)).otherwise(F.array().cast("array<string>")),
    )
    kept = [c for c in mixed.columns if c not in (*OUT, "parts")]
    return mixed.where("taken > 0").select(*[F.col(f"`{c}`") for c in kept if c != text_col], F.explode(texts).alias(text_col)).select(*[F.col(f"`{c}`") for c in kept])


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes from each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(spark, docs, columns=["doc_id"]).select("doc_id", *OUT)
