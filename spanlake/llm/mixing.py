"""Mixing sources to target weights with a low-discrepancy schedule.

Slot ``i`` of the schedule is the golden-ratio point ``frac((i + 1) * phi)``, in
integers of 61 bits so that points stay apart however many there are, mapped
through the cumulative block quotas of the sources. Slots are ranked per
source, and rank ``r`` takes block ``r mod n_blocks`` of the source, whose
shuffled documents lie end to end and are cut into blocks of equal word counts.
So the sources come interleaved as evenly as their targets allow, each pass over
a source is complete before the next begins, and reruns agree.

Nothing is gathered by source: offsets and ranks are sums over small hash or slot
ranges plus a running total over the range sums.

Rows: a null text has size 0 and takes nothing; null sources form one source,
ordered last; rows that repeat a ``doc_id`` count as documents of their own;
null ids are shuffled as an empty id; an empty table gives an empty mix; other
columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from spanlake.llm.shared import expanded, ordered, squeezed, stored

#: The unit interval in integers, and the golden ratio's fraction in it (odd, so that
#: no point comes twice).
UNIT_BITS = 61
UNIT = 1 << UNIT_BITS
PHI = (math.isqrt(5 << 2 * UNIT_BITS) - UNIT) // 2 | 1
WEIGHTS = (5, 2, 1)
#: No source gives more than this many times its words.
MAX_PASSES = 3
#: Words of a block, and the least number of blocks that a source is cut into
#: (sources of fewer words have one-word blocks).
BLOCK_WORDS = 2048
MIN_BLOCKS = 1024
#: Slots ranked together, and bits of a point that find the sources it may fall to.
SLOT_RANGE = 1 << 14
BIN_BITS = 10
#: Rows of an offset range, about; a range is a prefix of the shuffle key in hex digits.
RANGE_ROWS = 1 << 16
LEAST_KEY_DIGITS = 3

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass
class Mix:
    """``documents``: one row per document with its place; ``sources``: targets and
    quotas; ``schedule``: slot, sid, pass, block; ``taken``: one row per slot and document
    part (slot, sid, start, first_word, n_words)."""

    documents: DataFrame
    sources: DataFrame
    schedule: DataFrame
    taken: DataFrame


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per source: sid, source, source_size, weight, target, n_blocks, quota.

    Sources above their cap give the excess back by weight until none is above:
    the final targets are ``least(cap, weight * level)``, with the level read off
    a running sum over the sources in order of cap per weight.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).select(rank.alias("sid"), "source", "source_size", weight.alias("weight"))
    by_ratio = W.orderBy((F.col("cap") / F.col("weight")), "sid")
    src = src.withColumn("cap", F.col("source_size") * max_passes)
    src = src.withColumns({
        "total": F.sum("source_size").over(W.partitionBy()),
        "cap_before": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "weight_from": F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)),
    })
    level = (F.col("total") - F.col("cap_before")) / F.col("weight_from")
    # the level rises with each source taken as full and falls after the first that is not
    src = src.withColumn("level", F.max(level).over(W.partitionBy()))
    src = src.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
    blocks = F.least(F.col("source_size"), F.greatest(F.ceil(F.col("source_size") / BLOCK_WORDS), F.lit(MIN_BLOCKS)))
    src = src.withColumn("n_blocks", blocks.cast("long"))
    quota = F.least(
        F.floor(F.col("target") * F.col("n_blocks") / F.nullif(F.col("source_size"), F.lit(0)) + 0.5), F.col("n_blocks") * max_passes
    )
    src = src.withColumn("quota", F.coalesce(quota, F.lit(0)).cast("long"))
    return src.select("sid", "source", "source_size", "weight", "target", "n_blocks", "quota")


def _running(parts: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Sum of ``value`` over the earlier ranges of the same key."""
    over = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return parts.withColumn("before", F.coalesce(F.sum(value).over(over), F.lit(0).cast("long"))).drop(value)


def lay_out(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with ``sid`` and ``start``, their first word's place in the shuffled source."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    digits = max(LEAST_KEY_DIGITS, math.ceil(math.log(1 + sizes.count() / RANGE_ROWS, 16)))
    place = (
        sizes.join(sources.select("sid", F.col("source").alias("name"), "source_size", "target", "n_blocks", "quota"), F.col("source").eqNullSafe(F.col("name")))
        .withColumn("key", key)
        .withColumn("part", F.substring("key", 1, digits))
        .drop("name")
    )
    sums = stored(place.groupBy("sid", "part").agg(F.sum("size").alias("words")), "mix-parts")
    before = _running(sums, ["sid"], "part", "words").withColumnsRenamed({"sid": "s", "part": "p"})
    inside = W.partitionBy("sid", "part").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    place = place.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
    place = place.join(before, (F.col("sid") == F.col("s")) & (F.col("part") == F.col("p")))
    return place.withColumn("start", F.col("before") + F.col("inside")).drop("s", "p", "part", "key", "before", "inside")


def point(slot: str) -> Column:
    """The golden-ratio point of a slot, from 0 to ``UNIT``: exact for any slot."""
    return F.expr(f"cast((cast({slot} + 1 as decimal(18, 0)) * {PHI}) % {UNIT} as long)")


def _slots(sources: DataFrame, total: int, n: int) -> DataFrame:
    """The first ``n`` slots with the source that each falls to: slot, sid, quota, n_blocks, part."""
    upto = W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0)
    spans = sources.filter("quota > 0").withColumn("hi", F.sum("quota").over(upto)).withColumn("lo", F.col("hi") - F.col("quota"))
    edge = lambda c: F.expr(f"cast((cast({c} as decimal(18, 0)) * {UNIT}) div {max(total, 1)} as long)")
    spans = spans.select("sid", "quota", "n_blocks", edge("lo").alias("lo"), edge("hi").alias("hi"))
    shift = UNIT_BITS - BIN_BITS
    spans = spans.withColumn("bin", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))))
    slot = sources.sparkSession.range(n).select(F.col("id").alias("slot"), point("id").alias("u"))
    slot = slot.withColumn("bin", F.shiftright("u", shift))
    found = slot.join(spans, (slot.bin == spans.bin) & (slot.u >= spans.lo) & (slot.u < spans.hi))
    return found.select("slot", "sid", "quota", "n_blocks", F.floor(F.col("slot") / SLOT_RANGE).alias("part"))


def slot_sequence(sources: DataFrame) -> DataFrame:
    """The schedule: slot, sid, rank in the source, block and pass; ranks end at the source's quota.

    The sequence runs on past the sum of quotas until every source has its quota,
    since counts in a golden-ratio sequence stray by a few slots.
    """
    head = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.coalesce(F.min(F.expr("nullif(quota, 0)")), F.lit(1))).first()
    total, least = int(head[0]), int(head[1])
    n = total + -(-total * 8 // least) + 16 if total else 0
    while True:
        found = _slots(sources, total, n)
        sums = stored(found.groupBy("sid", "part").agg(F.count("*").alias("slots")), "mix-slots")
        have = sums.groupBy(F.col("sid").alias("s")).agg(F.sum("slots").alias("slots"))
        short = sources.filter("quota > 0").join(have, F.col("sid") == F.col("s"), "left").filter("coalesce(slots, 0) < quota")
        if short.isEmpty():
            break
        n *= 2
    before = _running(sums, ["sid"], "part", "slots").withColumnsRenamed({"sid": "s", "part": "p"})
    inside = F.row_number().over(W.partitionBy("sid", "part").orderBy("slot")) - 1
    ranked = found.withColumn("inside", inside).join(before, (F.col("sid") == F.col("s")) & (F.col("part") == F.col("p")))
    ranked = ranked.withColumn("rank", F.col("before") + F.col("inside")).filter("rank < quota")
    return ranked.select("slot", "sid", "rank", F.expr("rank % n_blocks").alias("block"), F.expr("rank div n_blocks").alias("pass"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> Mix:
    """Plan the mix of ``documents`` (doc_id, text, source)."""
    sizes = stored(documents.select(F.col("doc_id").cast("long"), F.col("source"), n_words(F.col("text")).alias("size")), "mix-sizes")
    sources = stored(source_targets(sizes, weights, max_passes), "mix-sources")
    placed = stored(lay_out(sizes, sources), "mix-documents")
    schedule = slot_sequence(sources)
    # block j of a source covers the words from floor(j * size / n_blocks) on
    edge = lambda j: f"(cast({j} as decimal(38, 0)) * source_size) div n_blocks"
    first = F.expr("cast((cast(start as decimal(38, 0)) * n_blocks) div source_size as long)")
    last = F.expr("cast((cast(start + size - 1 as decimal(38, 0)) * n_blocks) div source_size as long)")
    pieces = placed.filter("size > 0").withColumn("b", F.explode(F.sequence(first, last + 1)))
    pieces = pieces.withColumns({"w0": F.expr(f"greatest(start, {edge('b')})").cast("long"), "w1": F.expr(f"least(start + size, {edge('(b + 1)')})").cast("long")})
    pieces = pieces.filter("w1 > w0").select("sid", F.col("b").alias("block"), "start", (F.col("w0") - F.col("start")).alias("first_word"), (F.col("w1") - F.col("w0")).alias("n_words"))
    return Mix(placed, sources, schedule, schedule.join(pieces, ["sid", "block"]))


def words_taken(plan: Mix) -> DataFrame:
    """Documents with ``taken``: the words that the mix takes of each, repeats counted."""
    taken = plan.taken.groupBy("sid", "start").agg(F.sum("n_words").alias("taken")).withColumnsRenamed({"sid": "s", "start": "t"})
    on = (F.col("sid") == F.col("s")) & (F.col("start") == F.col("t")) & (F.col("size") > 0)
    return plan.documents.join(taken, on, "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast(T.LongType()))).drop("s", "t")


def mixed(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """The mix as documents: a row for each time that a document is taken whole, and
    its first words where the last block of a source ends within it. Documents of
    which nothing is taken, and those without words, are left out."""
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns if c != "text")).alias("row")
    docs = ordered(documents.select("doc_id", "text", "source", row))
    plan = mix(docs.select(F.col("oid").alias("doc_id"), "text", "source"), weights, max_passes)
    taken = stored(words_taken(plan).select(F.col("doc_id").alias("oid"), "size", "taken").filter("taken > 0"), "mix-taken")
    rows = expanded(squeezed(docs.select("oid", "row", "text")).join(taken.hint("merge"), "oid"))
    # each pass takes whole documents, the last one the first words of one document per source
    times = F.array_repeat(F.col("size"), F.expr("cast(taken div size as int)"))
    rest = F.when(F.col("taken") % F.col("size") > 0, F.array(F.col("taken") % F.col("size"))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("words", F.explode(F.concat(times, rest)))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    text = F.when(F.col("words") < F.col("size"), first).otherwise(F.col("text"))
    return rows.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in documents.columns))
