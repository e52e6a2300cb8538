"""Chat logs: snapshots of a growing conversation collapse into the longest one, which is then rendered.

A log often holds the same conversation several times, cut off after different turns. Every turn gets the rolling hash of the
turns up to it: 128 bits, the exclusive or of hashes that hold a turn's position, role and text. A conversation whose whole
hash is a prefix hash of a longer one is a snapshot; an anti-join drops it. Equal conversations keep the smallest id.

Turns are numbered and hashed by stored ranges with totals per range, so no task holds a whole conversation for it.

Turns are ordered by turn number, nulls first, then role and text. A null role or text counts as empty. A row without a
conversation id is a conversation of its own, of one turn; such rows are never pooled, and equal ones are one conversation, under the id of an
equal one that has one. Repeated rows of a conversation are turns like others. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from tallyhouse.llm.storage import saved

TEMPLATE = ("<|", "|>\n", "<|end|>\n")  # before the role, before the text, after the text
LEAD = 32  # characters of a role or text that turns are dealt by
SEGMENT = 1 << 24  # bytes of a segment, about

_HASHES = ["_a", "_b"]


def _turn_hashes() -> list[Column]:
    return [F.xxhash64("role", "text").alias("_u"), F.xxhash64("text", F.lit(1), "role").alias("_v")]


def _placed_hashes() -> list[Column]:
    """Two hashes of a turn at its position."""
    return [F.xxhash64("position", "_u", "_v").alias("_a"), F.xxhash64("_v", F.lit(1), "_u", "position").alias("_b")]


def lone_turns(turns: DataFrame) -> DataFrame:
    """(role, text, _a, _b): the different turns without a conversation, hashed as the first one of theirs."""
    alone = turns.where("conv_id is null").select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))).distinct()
    first = alone.select("role", "text", *_turn_hashes(), F.lit(1).cast("long").alias("position"))
    return first.select("role", "text", *_placed_hashes())


def stored_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, role, text, _u, _v, _range, _at) of the turns with a conversation, stored: nulls in role and text made empty, two hashes of
    them, the range a turn lies in and its place among all turns, which grows by one inside a range.

    Spark's range partitioner cuts all turns by conversation and order, so a long conversation lies in many ranges. The beginnings
    of role and text are enough to cut by, and keep the sampled bounds short; only turns that agree in them must share a range.
    """
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = turns.where("conv_id is not null").select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    short = F.when(F.length("role") <= LEAD, F.substring("text", 1, LEAD)).asc_nulls_last()  # longer roles come after their beginning
    cut = told.repartitionByRange(tasks, "conv_id", "turn", F.substring("role", 1, LEAD), short)
    cut = cut.sortWithinPartitions("conv_id", "turn", "role", "text")
    return saved(cut.select("conv_id", "role", "text", *_turn_hashes(),
                            F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")), "turns")


def _with_range(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows with the columns of their conversation's part of their range."""
    of = ranges.withColumnsRenamed({"conv_id": "_of", "_range": "_of_range"})
    same = rows["conv_id"].eqNullSafe(of["_of"]) & (rows["_range"] == of["_of_range"])
    return rows.join(of, same).drop("_of", "_of_range")


def _earlier() -> WindowSpec:
    """The ranges before this one, over a row per range and conversation."""
    return W.partitionBy("conv_id").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)


def _within() -> WindowSpec:
    return W.partitionBy("conv_id", "_range").orderBy("position")


def turn_ranges(stored: DataFrame) -> DataFrame:
    """(conv_id, _range, n_turns, _shift): a conversation's turns in all, and what takes `_at` to the position from 1 in it."""
    totals = stored.groupBy("conv_id", "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(_earlier()), F.lit(0))
    return totals.select("conv_id", "_range", F.sum("_n").over(W.partitionBy("conv_id")).alias("n_turns"), (before + 1 - F.col("_first")).alias("_shift"))


def prefix_hashes(stored: DataFrame, ranges: DataFrame) -> DataFrame:
    """(conv_id, position, n_turns, _a, _b): the hash of the conversation's turns up to this one."""
    placed = _with_range(stored.select("conv_id", "_range", "_at", "_u", "_v"), ranges).withColumn("position", F.col("_at") + F.col("_shift"))
    hashed = placed.select("conv_id", "_range", "position", "n_turns", *_placed_hashes())
    totals = hashed.groupBy("conv_id", "_range").agg(*(F.bit_xor(h).alias(h) for h in _HASHES))
    before = totals.select("conv_id", "_range", *(F.coalesce(F.bit_xor(h).over(_earlier()), F.lit(0)).alias(f"{h}_before") for h in _HASHES))
    so_far = _within().rowsBetween(W.unboundedPreceding, 0)
    within = hashed.select("conv_id", "_range", "position", "n_turns", *(F.bit_xor(h).over(so_far).alias(h) for h in _HASHES))
    return _with_range(within, before).select("conv_id", "position", "n_turns", *(F.col(h).bitwiseXOR(F.col(f"{h}_before")).alias(h) for h in _HASHES))


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, _a, _b) of the conversations that no longer one begins with, one of equal ones. An id is null if all equal ones are.

    Copies are merged and prefixes made distinct before the join, so a conversation or first turn with very many copies is one key.
    """
    whole = prefixes.where(F.col("position") == F.col("n_turns")).groupBy("n_turns", *_HASHES).agg(F.min("conv_id").alias("conv_id"))
    longer = prefixes.where(F.col("position") < F.col("n_turns")).select(F.col("position").alias("n_turns"), *_HASHES).distinct()
    return whole.join(longer, ["n_turns", *_HASHES], "left_anti").select("conv_id", "n_turns", *_HASHES)


def rendered_turn(template: tuple[str, str, str] = TEMPLATE) -> Column:
    return F.concat(F.lit(template[0]), "role", F.lit(template[1]), "text", F.lit(template[2]))


def kept_lines(turns: DataFrame, template: tuple[str, str, str] = TEMPLATE) -> tuple[DataFrame, DataFrame]:
    """The turns of maximal conversations, (conv_id, _range, n_turns, position, line), and the lines of those without an id."""
    stored, alone = stored_turns(turns), saved(lone_turns(turns), "lone-turns")
    ranges = saved(turn_ranges(stored), "turn-ranges")
    lone = alone.select(F.lit(None).cast(turns.schema["conv_id"].dataType).alias("conv_id"), *(F.lit(1).cast("long").alias(c) for c in ("position", "n_turns")), *_HASHES)
    prefixes = saved(prefix_hashes(stored, ranges).unionByName(lone), "turn-prefixes")
    kept = saved(maximal_conversations(prefixes), "maximal")
    own = ranges.join(kept.where("conv_id is not null").select("conv_id"), "conv_id")
    placed = _with_range(stored.select("conv_id", "_range", "_at", "role", "text"), own)
    lines = placed.select("conv_id", "_range", "n_turns", (F.col("_at") + F.col("_shift")).alias("position"), rendered_turn(template).alias("line"))
    return lines, alone.join(kept.where("conv_id is null").drop("conv_id"), _HASHES).select(rendered_turn(template).alias("text"))


def _joined(lines: DataFrame, keys: list[str]) -> DataFrame:
    texts = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("position", "line"))).alias("lines"))
    return texts.select(*keys, F.array_join(F.col("lines.line"), "").alias("text"))


def rendered_conversations(turns: DataFrame, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, text) of every maximal conversation. No turns: no rows.

    A conversation's text is one value and must fit a row (2 GB, and a task's memory); `rendered_segments` has no such limit.
    """
    lines, alone = kept_lines(turns, template)
    told = _joined(lines, ["conv_id", "n_turns"])
    return told.union(alone.select(F.lit(None).cast(turns.schema["conv_id"].dataType), F.lit(1).cast("long"), "text"))


def rendered_segments(turns: DataFrame, template: tuple[str, str, str] = TEMPLATE, most: int = SEGMENT) -> DataFrame:
    """(conv_id, n_turns, segment, text): `rendered_conversations` in segments numbered from 1, whose texts in order make the conversation's.

    A line belongs to the segment of `most` bytes it starts in, so a segment exceeds that by less than a line, and lines stay whole. A segment in
    which no line starts has no row.
    """
    lines, alone = kept_lines(turns, template)
    lines = saved(lines.withColumn("_size", F.octet_length("line").cast("long")), "lines")
    totals = lines.groupBy("conv_id", "_range").agg(F.sum("_size").alias("_sum"))
    before = totals.select("conv_id", "_range", F.coalesce(F.sum("_sum").over(_earlier()), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_size").over(_within().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = _with_range(lines.withColumn("_inside", inside), before)
    told = _joined(placed.withColumn("segment", F.floor((F.col("_before") + F.col("_inside")) / most) + 1), ["conv_id", "n_turns", "segment"])
    one = F.lit(1).cast("long")
    return told.union(alone.select(F.lit(None).cast(turns.schema["conv_id"].dataType), one, one, "text"))
