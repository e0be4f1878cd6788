"""Mixing sources to target weights by Pfair scheduling (native).

A source of weight w of a total W has its k-th block released at floor(k W / w) and due by ceil((k + 1) W / w); in each
slot the released block with the earliest deadline runs. The weights fill every slot, so every deadline is met and at any
slot each source has had its exact target number of blocks, give or take less than one. Windows repeat every W slots (W
over the weights' common divisor): one such period is scheduled, by a fold over its slots, and block b of a source of w
slots falls in period b div w at the place of block b mod w. The fold grows with the weights, never with the rows. Places
inside a source come from counts per slice of the hash order, so a source with a third of all rows is never in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depvital.llm.common import keep_table, named

#: Documents in a block; slices of a source's order; slots that the fold joins to one piece of its plan.
BLOCK_DOCS = 8
SLICE_DIGITS = 3
PLAN_PIECE = 1000

Weights = dict[str | None, int] | Callable[[Column, Column], Column]


def _key(source: Column) -> Column:
    """A name for each source, the null source included."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def source_shares(counts: DataFrame, weights: Weights | None) -> DataFrame:
    """(key, at, share, period): weight of each source and of all, over their greatest common divisor.

    `counts` has key, source, docs. One row for each source with a positive weight, numbered in the order of the names.
    """
    if weights is None:
        weight = F.ceil(F.sqrt("docs"))
    elif callable(weights):
        weight = weights(F.col("source"), F.col("docs"))
    else:
        named_weights = F.create_map(*[F.lit(x) for s, w in weights.items() for x in ("" if s is None else f"={s}", w)])
        weight = F.try_element_at(named_weights, F.col("key")) if weights else F.lit(None)
    table = counts.withColumn("weight", weight.cast("long")).where("weight > 0")
    # Euclid's steps: a remainder is under half of the number before last, so 128 steps do for any two long values
    euclid = "aggregate(sequence(1, 128), struct(a as x, w as y), (s, i) -> if(s.y = 0, s, struct(s.y as x, s.x % s.y as y)), s -> s.x)"
    whole = table.agg(F.sum("weight").alias("whole"), F.expr(f"aggregate(collect_list(weight), 0L, (a, w) -> {euclid})").alias("divisor"))
    at = F.row_number().over(Window.orderBy("key")) - 1
    return table.withColumn("at", at).join(F.broadcast(whole)).select(
        "key", "at", F.expr("weight div divisor").alias("share"), F.expr("whole div divisor").alias("period")
    )


def period_slots(shares: DataFrame) -> DataFrame:
    """(at, turn, slot): the slot in a period of each source's blocks, by earliest deadline first among released blocks."""
    one = shares.agg(F.sort_array(F.collect_list(F.struct("at", "share"))).alias("s"), F.max("period").alias("period"))
    one = one.where("period is not null").select(F.transform("s", lambda x: x["share"].cast("long")).alias("q"), "period")
    due = """array_min(transform(q, (n, i) -> if(
        (state.used[i] * period) div n <= t,
        named_struct('due', ((state.used[i] + 1) * period + n - 1) div n, 'at', i), null)))"""
    piece = f"""aggregate(
        sequence(c * {PLAN_PIECE}L, least(period, (c + 1) * {PLAN_PIECE}L) - 1),
        named_struct('used', whole.used, 'plan', cast(array() as array<int>)),
        (state, t) -> transform(array({due}), best -> named_struct(
            'used', transform(state.used, (u, i) -> if(i = best.at, u + 1L, u)),
            'plan', concat(state.plan, array(best.at))))[0])"""
    fold = f"""aggregate(
        sequence(0L, (period - 1) div {PLAN_PIECE}),
        named_struct('used', transform(q, n -> 0L), 'plan', cast(array() as array<array<int>>)),
        (whole, c) -> transform(array({piece}), done -> named_struct(
            'used', done.used, 'plan', concat(whole.plan, array(done.plan))))[0],
        whole -> whole.plan)"""
    pieces = one.select(F.posexplode(F.expr(fold)).alias("c", "plan"))
    plan = pieces.select(F.posexplode("plan").alias("i", "at"), "c").select("at", (F.col("c") * F.lit(PLAN_PIECE).cast("long") + F.col("i")).alias("slot"))
    return plan.withColumn("turn", F.row_number().over(Window.partitionBy("at").orderBy("slot")) - 1)


def mix_sources(
    docs: DataFrame,
    weights: Weights | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    block_docs: int = BLOCK_DOCS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(doc_id, source, block, slot, place) for each row; the mix is the order by slot, then place.

    With `carry`, these columns of the input stand in place of doc_id and source. A source's documents follow each other by
    the MD5 of their identifier, `block_docs` to a block. `weights` are whole numbers by source, or a column made of source
    and number of documents; without them a source weighs the root of its documents. Every document is in the mix once: the
    slots of a source that has run out stay empty, and the deviation of less than one block holds up to there. Documents
    of sources without a positive weight have a block but no slot and come last. The null source is a source of its own;
    null identifiers come last in their source, by the MD5 of their text (null: empty) where the input has one; repeated
    rows take places of their own. Other columns are not read. An empty table gives an empty result.
    """
    kept = [named(c) for c in carry] if carry else [named(id_col).cast("long").alias("doc_id"), named(source_col).cast("string").alias("source")]
    ids, source = named(id_col).cast("long"), named(source_col).cast("string")
    text = F.coalesce(named(text_col).cast("string"), F.lit("")) if text_col in docs.columns else F.lit("")
    # rows without an identifier, and only they, are told apart by their text
    by_text = F.concat(F.lit("g"), F.md5(text.cast("binary")))
    rows = [
        docs.where(condition).select(F.struct(*kept).alias("row"), _key(source).alias("key"), source.alias("source"), digest.alias("digest"))
        for condition, digest in ((ids.isNotNull(), F.md5(ids.cast("string").cast("binary"))), (ids.isNull(), by_text))
    ]
    rows = rows[0].unionAll(rows[1]).withColumn("slice", F.substring("digest", 1, SLICE_DIGITS))
    rows = rows.withColumn("slice", F.when(F.col("digest").startswith("g"), F.substring("digest", 1, SLICE_DIGITS + 1)).otherwise(F.col("slice")))
    slices = keep_table(rows.groupBy("key", "slice").agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("docs")), "mix-slices")
    counts = slices.groupBy("key").agg(F.first("source").alias("source"), F.sum("docs").alias("docs"))
    shares = keep_table(source_shares(counts, weights), "mix-shares")
    slots = keep_table(period_slots(shares).join(shares, "at").select("key", "turn", F.col("slot").alias("in_period")), "mix-slots")

    behind = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.withColumn("offset", F.coalesce(F.sum("docs").over(behind), F.lit(0))).join(shares, "key", "left")
    inside = Window.partitionBy("key", "slice").orderBy("digest")
    placed = rows.drop("source").withColumn("n", F.row_number().over(inside) - 1).join(
        offsets.select("key", "slice", "offset", "share", "period"), ["key", "slice"]
    )
    rank = F.col("offset") + F.col("n")
    placed = placed.withColumns({"block": F.floor(rank / block_docs).cast("long"), "place": (rank % block_docs).cast("long")})
    placed = placed.withColumn("turn", F.col("block") % F.col("share"))
    slot = F.expr("(block div share) * period + in_period")
    return placed.join(slots, ["key", "turn"], "left").select("row.*", "block", slot.alias("slot"), "place")
