"""Mixing sources to target weights, in words, with DataFrame operations only.

Every source is a stream of its documents' words, cut into blocks of a fixed length. The mix is a row of output slots, cut into
output shards; a slot holds one block. Which source a slot belongs to is drawn by a pseudorandom permutation of all slots, so a
shard's counts of the sources are a multinomial draw, given that every source's total is its quota. A source's slots run
through a pseudorandom permutation of its block numbers, once per pass, and slots and blocks meet by block number.

The permutations are generalized Feistel networks with cycle walking (Black and Rogaway, 2002). A number below n is a pair (x div b, x mod b)
with a * b little above n; each round adds a hash of one half to the other, so eight rounds reach every place whatever n is, and
each is a column of its own that generated code computes. What ends at n or beyond, a few in the square root of n, goes through again until it does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyhouse.llm.storage import saved

BLOCK = 64  # words
SHARD = 4096  # slots of an output shard
WEIGHTS = (3, 1, 2)
SHARE = 1.5  # the mix's words as a share of all words
PASSES = 2  # no block is taken more often
SEED = 20240229
ROUNDS = 8  # of a permutation
FACTORS = 64  # pairs of factors to choose from
BUCKETS = 1024  # of a source's documents; a power of two
RUN = 1 << 13  # slots that one row is unfolded into

WORD = r"[^\x20\x09-\x0D]+"


WORD_AND_BLANKS = WORD + r"[\x20\x09-\x0D]*"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def factors(n: Column) -> Column:
    """(a, b) with a * b at or above n, by as little as the factors around its root allow."""
    root = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    every = F.transform(F.sequence(root, root + F.least(F.lit(FACTORS - 1), F.floor(root / 2))), lambda a: F.struct(a.alias("a"), F.ceil(n / a).cast("long").alias("b")))
    best = F.array_min(F.transform(every, lambda f: F.struct((f["a"] * f["b"] - n).alias("above"), f["a"].alias("a"), f["b"].alias("b"))))
    return F.struct(best["a"].alias("a"), best["b"].alias("b"))


def _added(half: Column, other: Column, key: Column, step: Column, size: Column, inverse: bool) -> Column:
    """One half of a pair after a round."""
    hashed = F.pmod(F.xxhash64(key, step, other), size)
    return F.pmod(half - hashed if inverse else half + hashed, size)


def permuted(frame: DataFrame, into: str, x: str, n: str, pair: str, key: str, inverse: bool = False) -> DataFrame:
    """The frame with `into`, the place of x under the pseudorandom permutation of 0 .. n-1 that `key` names.

    All are names of columns: x and n long, `pair` the `factors` of n, `key` long. No name may start with `_half`.
    """
    key_, a, b = F.col(key), F.col(pair)["a"], F.col(pair)["b"]
    steps = list(range(ROUNDS))[:: -1 if inverse else 1]
    held = frame.withColumns({"_half0": F.expr(f"`{x}` div `{pair}`.b"), "_half1": F.expr(f"`{x}` % `{pair}`.b")})
    for i in steps:  # a column each, so that no half is worked out twice
        held = held.withColumn(f"_half{i % 2}", _added(F.col(f"_half{i % 2}"), F.col(f"_half{1 - i % 2}"), key_, F.lit(i), b if i % 2 else a, inverse))
    held = held.withColumn(into, F.col("_half0") * b + F.col("_half1")).drop("_half0", "_half1")

    def again(at: Column) -> Column:
        first = F.floor((at - F.pmod(at, b)) / b)
        first = first + F.when(first * b > at, -1).when((first + 1) * b <= at, 1).otherwise(0)  # the quotient is rounded

        def step(state: Column, i: Column) -> Column:
            return F.when(i % 2 == 0, F.struct(_added(state["l"], state["r"], key_, i, a, inverse).alias("l"), state["r"].alias("r"))).otherwise(
                F.struct(state["l"].alias("l"), _added(state["r"], state["l"], key_, i, b, inverse).alias("r")))

        start = F.struct(first.alias("l"), F.pmod(at, b).alias("r"))
        return F.aggregate(F.array(*(F.lit(i) for i in steps)), start, step, lambda state: state["l"] * b + state["r"])

    walk = F.aggregate(F.sequence(F.lit(0).cast("long"), a * b - F.col(n)), F.col(into), lambda at, _: F.when(at < F.col(n), at).otherwise(again(at)))
    return held.withColumn(into, F.when(F.col(into) < F.col(n), F.col(into)).otherwise(walk))


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS,
                   share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(source, source_size, target): the words to take from each source.

    Sources by code point, null last, weigh `weights`, repeating, and share `share` of all words. A target stops at `passes` times its
    source's size; the excess goes to the others by weight until none is above. The level at which that ends is found in one pass
    over the sources by size per weight: those before some place are full, the others get the same words per weight.
    """
    total = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    everything = W.partitionBy()  # one row per source
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))
    ranked = total.withColumn("weight", weight).withColumn("most", passes * F.col("source_size").cast("double"))
    by_level = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / open_weight)
    open_ = F.col("most") / F.col("weight") > F.col("level")
    settled = level.withColumn("final", F.max(F.when(open_, F.col("level"))).over(everything))
    target = F.when(F.col("final").isNull(), F.col("most")).otherwise(F.least("most", F.col("final") * F.col("weight")))
    return settled.select("source", "source_size", target.alias("target"))


def _spans(documents: DataFrame, source: str, size: str, order: list[str]) -> DataFrame:
    """The documents with the place of their first word in their source's stream.

    The stream runs through hash buckets of the source, and by `order` inside a bucket, so no window holds a whole source.
    """
    bucketed = documents.withColumn("_bucket", F.xxhash64(*order).bitwiseAND(BUCKETS - 1))
    key = [F.col(source).alias("_source"), "_bucket"]
    totals = bucketed.groupBy(*key).agg(F.sum(size).alias("_words"))
    earlier = W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("_source", "_bucket", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_start"))
    inside = W.partitionBy(source, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = bucketed.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    same = F.col(source).eqNullSafe(F.col("_source")) & (placed["_bucket"] == starts["_bucket"])
    return placed.join(starts, same).withColumn("_first", F.col("_start") + F.col("_inside")).drop("_source", "_bucket", "_start", "_inside")


def block_parts(documents: DataFrame, source: str, size: str, order: list[str], block: int = BLOCK) -> DataFrame:
    """A row for each document and block that share words: `_block`, `_from` (the document's words before) and `_words`."""
    first, last = F.col("_first"), F.col("_first") + F.col(size) - 1
    spans = _spans(documents, source, size, order).where(F.col(size) > 0)
    cut = spans.withColumn("_block", F.explode(F.sequence(F.floor(first / block), F.floor(last / block))))
    begin = F.greatest(first, F.col("_block") * block)
    end = F.least(last + 1, (F.col("_block") + 1) * block)
    return cut.withColumn("_from", begin - first).withColumn("_words", end - begin).drop("_first")


def slots(targets: DataFrame, block: int = BLOCK, passes: int = PASSES, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """The mix's plan: (output_shard, slot, source, pass, block), one row per slot.

    A source's quota is its target in blocks of the source's mean block length, rounded, and `passes` times its blocks at most.
    """
    blocks = F.ceil(F.col("source_size") / block)
    quota = F.least(F.round(F.col("target") * blocks / F.col("source_size")).cast("long"), passes * blocks)
    order = W.orderBy(F.col("source").asc_nulls_last())
    dealt = targets.where("source_size > 0").select("source", blocks.cast("long").alias("blocks"), quota.alias("quota"))
    dealt = dealt.withColumn("first", F.coalesce(F.sum("quota").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    dealt = dealt.withColumn("all", F.sum("quota").over(W.partitionBy())).where("quota > 0")
    dealt = dealt.withColumns({"of_all": factors(F.col("all")), "of_blocks": factors(F.col("blocks"))})
    runs = dealt.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / RUN))))
    tasks = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = runs.repartition(tasks, "source", "run")  # a number that is not lowered: few rows unfold into many
    within = F.sequence(F.col("run") * RUN, F.least(F.col("quota"), (F.col("run") + 1) * RUN) - 1)
    numbered = runs.select("source", "blocks", "first", "all", "of_all", "of_blocks", F.explode(within).alias("n"))
    pass_ = F.expr("n div blocks").cast("int")
    numbered = numbered.select("source", "blocks", "all", "of_all", "of_blocks", (F.col("first") + F.col("n")).alias("at"), pass_.alias("pass"),
                               F.pmod("n", "blocks").alias("own"), F.lit(seed).cast("long").alias("seed"), F.xxhash64(F.lit(seed), "source", pass_).alias("own_seed"))
    placed = permuted(numbered, "place", "at", "all", "of_all", "seed", inverse=True)
    placed = permuted(placed, "block", "own", "blocks", "of_blocks", "own_seed")
    return placed.select(F.expr(f"place div {shard}").alias("output_shard"), F.pmod("place", F.lit(shard)).alias("slot"), "source", "pass", "block")


def shard_counts(plan: DataFrame) -> DataFrame:
    """The drawn number of slots per output shard and source."""
    return plan.groupBy("output_shard", "source").agg(F.count("*").alias("slots"))


def mixed_parts(documents: DataFrame, targets: DataFrame, source: str, size: str, order: list[str], block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """`block_parts` with `_uses`, how often the mix takes the part (0 to the number of passes), and `_shard`, the first output shard
    that does. Whole documents are covered.
    """
    parts = block_parts(documents, source, size, order, block)
    plan = slots(targets, block, seed=seed)
    uses = plan.groupBy(F.col("source").alias("_of"), F.col("block").alias("_at")).agg(F.count("*").alias("_uses"), F.min("output_shard").alias("_shard"))
    uses = uses.hint("merge")  # its size is unknown before it runs, so it must not be broadcast
    same = parts[source].eqNullSafe(uses["_of"]) & (parts["_block"] == uses["_at"])
    return parts.join(uses, same, "left").drop("_of", "_at").withColumn("_uses", F.coalesce("_uses", F.lit(0)))


def taken_words(documents: DataFrame, identity: list[str], source: str = "source", size: str = "size", block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """A row per document: identity, source, size, source_size, target, taken (the words the mix takes of it, repeats counted)
    and first_shard, the first output shard that holds some of them.

    `identity` orders a source's documents in its stream, whatever their partitions; rows equal in identity, source and size
    are interchangeable and are told apart by a number. Null sources are one source, null identities are values like any other. Documents
    without words take part with size 0 and taken 0. The same rows give the same mix.
    """
    same = documents.groupBy(*identity, source, size).agg(F.count("*").alias("_copies"))
    told = saved(same.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).drop("_copies"), "sizes")
    targets = source_targets(told, source, size)
    order = [*identity, size, "_copy"]
    parts = mixed_parts(told, targets, source, size, order, block, seed)
    taken = parts.groupBy(*order, source).agg(F.sum(F.col("_words") * F.col("_uses")).alias("taken"), F.min("_shard").alias("first_shard"))
    empty = told.where(F.col(size) == 0).withColumns({"taken": F.lit(0).cast("long"), "first_shard": F.lit(None).cast("long")})
    every = taken.unionByName(empty.select(taken.columns)).drop("_copy")
    of = targets.withColumnRenamed("source", "_of")
    return every.join(of, every[source].eqNullSafe(of["_of"])).drop("_of")


def mixed_documents(documents: DataFrame, identity: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix as documents: a row for each document and pass of the mix that takes words of it, with these words as its text.

    A text that a pass takes whole stays as it is; otherwise its words stand with the white space after them. The words add
    up to `taken_words`. Null texts and texts without words yield no row. Other columns are repeated.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_row")  # so that no column's name can clash
    keyed = documents.select(row, word_count(text).alias("_size"), F.xxhash64(text).alias("_digest"), F.xxhash64(identity).alias("_id"),
                             F.col(identity).isNull().alias("_none"), F.xxhash64(source).alias("_of"))
    keys = ["_digest", "_id", "_none", "_of"]  # never null, so joins and windows on them share one shuffle
    told = keyed.select(*keys, F.col("_row")[source].alias("_kind"), "_size").groupBy(*keys, "_kind", "_size").agg(F.count("*").alias("_copies"))
    told = saved(told.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).drop("_copies"), "sizes")
    targets = source_targets(told, "_kind", "_size")
    parts = mixed_parts(told.withColumnRenamed("_of", "_kind_hash"), targets, "_kind", "_size", ["_id", "_digest", "_none", "_size", "_copy"], block, seed)
    part = F.struct(F.col("_from").cast("int").alias("first"), F.col("_words").cast("int").alias("words"), F.col("_uses").cast("int").alias("uses"))
    plans = parts.withColumnRenamed("_kind_hash", "_of").groupBy(*keys, "_copy").agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    copy = F.row_number().over(W.partitionBy(*keys).orderBy(F.lit(1))).cast("long")  # rows equal in the keys are interchangeable
    joined = keyed.withColumn("_copy", copy).join(plans, [*keys, "_copy"])
    uses = F.transform("_parts", lambda p: p["uses"])
    words = F.regexp_extract_all(F.col("_row")[text], F.lit(WORD_AND_BLANKS), F.lit(0))
    # Below the explode, so that a text is cut into words once and not for every part taken of it.
    cut = joined.withColumns({"_most": F.array_max(uses), "_every": F.when(F.array_min(uses) < F.array_max(uses), words)}).where("_most > 0")
    passes = cut.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.col("_most"))))
    passes = passes.withColumn("_taken", F.filter("_parts", lambda p: p["uses"] >= F.col("_pass"))).where(F.size("_taken") > 0)
    some = F.array_join(F.flatten(F.transform("_taken", lambda p: F.slice(F.col("_every"), p["first"] + 1, p["words"]))), "")
    whole = F.size("_taken") == F.size("_parts")
    own = F.when(whole, F.col("_row")[text]).otherwise(some)
    return passes.select(*((own if c == text else F.col("_row")[c]).alias(c) for c in documents.columns))
