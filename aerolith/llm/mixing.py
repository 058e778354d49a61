"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Documents of a source, in a seeded random order, fill blocks of equal size. Weights become fractions q / d (d: the sum of
all q, about 2**30). Block i of a source may not run before slot floor(i * d / q) and must have run by slot
ceil((i + 1) * d / q); earliest deadline first fills every slot, so that no source ever strays a whole block from q / d (n slots differ from the given weight by some n / 2**30 blocks).

The slots are dealt into stretches, each planned by itself. At a border T a source has run floor(T * q / d) blocks, and one
more if its open block (released before T, due after T) belongs before T. Up to any slot v behind the border, the open
blocks put before it and due after v can be no more than E(v), the sum of the parts of T .. v that all sources leave
over: sum((v * q) mod d) / d. These limits are nested, so that taking open blocks by release, the earliest first,
wherever the limits allow it, leaves the fewest early ones for the other side: if any schedule keeps all windows, as
Pfair proves, one keeps them with these borders. A stretch is as long as the longest window, so that no block spans two borders.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize

BLOCK_CHARS = 20_000
#: weights are whole multiples of about this part of their sum, and one at least
RESOLUTION = 1 << 30
#: slots of a stretch at least, and of the inner runs by which a stretch is put together
STRETCH, RUN = 1024, 64
EXPONENT = 0.5

# The open blocks at border t as (due, release, source number), by due; h: the number of all slots.
OPEN = """
array_sort(filter(transform(q, (w, s) -> if((t * w) % d = 0, null, named_struct(
  'due', least((((t * w) div d + 1) * d + w - 1) div w, h), 'rel', ((t * w) div d * d) div w, 's', s))), x -> x is not null))
"""
# For each open block: the least E(v) from the due slot of the one before (or t) to its own.
ROOM = """
transform(open, (x, j) -> if(x.due <= if(j = 0, t, open[j - 1].due), 9223372036854775807L, array_min(transform(
  sequence(if(j = 0, t, open[j - 1].due), x.due - 1), v -> aggregate(q, 0L, (e, w) -> e + (v * w) % d) div d))))
"""
# The sources whose open block runs before the border.
TAKEN = """
aggregate(
  array_sort(transform(open, (x, j) -> named_struct('rel', x.rel, 'j', j, 's', x.s))),
  named_struct('room', room, 'took', cast(array() as array<int>)),
  (a, x) -> if(array_min(slice(a.room, 1, x.j + 1)) >= 1,
    named_struct('room', transform(a.room, (r, j) -> if(j <= x.j, r - 1, r)), 'took', concat(a.took, array(x.s))), a),
  a -> a.took)
"""
DONE = "transform(q, (w, s) -> (t * w) div d + if(array_contains(taken, s), 1L, 0L))"
# One stretch, t to t_end: the (source number, block) of each slot, in runs; goal: the blocks done at its end, which are
# due by due_end (the last stretch has neither).
PICKS = f"""
aggregate(
  sequence(t, t_end - 1, {RUN}L),
  named_struct('done', done, 'pick', cast(array() as array<array<struct<s:int,block:bigint>>>)),
  (o, t0) -> element_at(transform(array(aggregate(
    sequence(t0, least(t0 + {RUN - 1}L, t_end - 1)),
    named_struct('done', o.done, 'pick', cast(array() as array<struct<s:int,block:bigint>>)),
    (a, u) -> element_at(transform(
      array(array_min(filter(
        transform(q, (w, i) -> if(a.done[i] < goal[i] and (a.done[i] * d) div w <= u, named_struct('due', least(((a.done[i] + 1) * d + w - 1) div w, due_end), 's', i), null)),
        x -> x is not null))),
      best -> named_struct('done', transform(a.done, (x, i) -> if(i = best.s, x + 1, x)), 'pick', concat(a.pick, array(named_struct('s', best.s, 'block', a.done[best.s]))))), 1))),
    r -> named_struct('done', r.done, 'pick', concat(o.pick, array(r.pick)))), 1),
  o -> flatten(o.pick))
"""


def plan_sources(totals: DataFrame, weights: dict[str, float] | None, resolution: int, block_chars: int) -> DataFrame:
    """One row (or none) from totals (src, chars): `all` (src, q, n_blocks for each source), q, d, h, the slots that
    hold all blocks, and stretch, the slots of a stretch."""
    if weights is None:
        raw: Column = F.pow(F.col("chars").cast("double"), EXPONENT)
    else:
        raw = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in weights.items() for x in ("s" + k, float(v))]), F.col("src")), F.lit(0.0)) if weights else F.lit(0.0)
    w = totals.withColumn("w", raw).filter("w > 0").withColumn("n_blocks", F.ceil(F.col("chars") / block_chars))
    one = w.agg(F.array_sort(F.collect_list(F.struct("src", "w", "n_blocks"))).alias("all")).filter(F.size("all") > 0)
    one = one.withColumn("sum", F.aggregate("all", F.lit(0.0), lambda a, x: a + x["w"]))
    one = one.withColumn("q", F.transform("all", lambda x: F.greatest(F.lit(1), F.round(x["w"] / F.col("sum") * resolution)).cast("long")))
    one = one.withColumn("d", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x))
    one = one.withColumn("h", F.expr("array_max(transform(all, (x, i) -> cast(ceil(cast(x.n_blocks as decimal(20,0)) * d / q[i]) as bigint)))"))
    return one.withColumn("stretch", F.expr(f"least(h, greatest({STRETCH}L, (d + array_min(q) - 1) div array_min(q) + 2))"))


def schedule(plan: DataFrame, h: int, stretch: int, d: int) -> DataFrame:
    """(src, block, slot) of the first h slots from the plan's one row; blocks beyond a source's last count on."""
    spark, n = plan.sparkSession, -(-h // stretch)
    one = F.broadcast(plan.select(F.lit(0).cast("bigint").alias("one"), "all", "q", "d", "h"))  # one row: some bytes a source
    at = spark.range(n, numPartitions=min(n, 4096)).select(F.col("id").alias("k"), (F.col("id") * stretch).alias("t"), F.lit(0).cast("bigint").alias("one"))
    border = at.join(one, "one").withColumn("open", F.expr(OPEN)).withColumn("room", F.expr(ROOM)).withColumn("taken", F.expr(TAKEN))
    border = materialize(border.select("k", F.expr(DONE).alias("done")), "mix-borders")
    goals = border.select((F.col("k") - 1).alias("k"), F.col("done").alias("goal"))
    each = at.join(one, "one").join(border, "k").join(goals, "k", "left").withColumn("t_end", F.least(F.col("t") + stretch, F.col("h")))
    far = F.lit((1 << 63) - 1)
    each = each.withColumn("due_end", F.when(F.col("goal").isNotNull(), F.col("t_end")).otherwise(far)).withColumn("goal", F.coalesce("goal", F.transform("q", lambda _: far)))
    each = each.withColumn("pick", F.expr(PICKS))
    picked = each.select("t", "all", F.posexplode("pick").alias("i", "x"))
    return picked.select(F.element_at("all", F.col("x.s") + 1)["src"].alias("src"), F.element_at("all", F.col("x.s") + 1)["n_blocks"].alias("n_blocks"), F.col("x.block").alias("block"), (F.col("t") + F.col("i")).alias("slot"))


def mix_order(df: DataFrame, keep: list[str], **options: object) -> DataFrame:
    """The kept columns of all documents with a weight, as rows sorted by slot; options as of mix_sources.

    No source ends the mixture: the slots of one that has run out fall to the others, which move up and keep their
    shares among each other. A document that spans blocks stands where it begins.
    """
    mixed, names = mix_sources(df, keep, **options, begins=True)
    return mixed.filter(F.col(names["slot"]).isNotNull()).orderBy(names["slot"], names["begins"]).select(*[F.col(f"`{c}`") for c in keep])


def mix_sources(df: DataFrame, keep: list[str], id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS, resolution: int = RESOLUTION, seed: int = 7, begins: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """The kept columns with block, slot, last_slot and in_mix (names are returned by key, as kept columns may clash).

    With begins=True also the place in its source at which each document begins.

    Without weights a source's share is the square root of its characters. A document lies in the block in which it
    begins and ends in last_slot (a long one spans the slots of several blocks, which are counted as its own); within a
    slot documents follow their order in the source. Weights are taken as whole parts of 2**30 of their sum. in_mix holds up to the first slot whose source
    has run out, as the mixture can't be held beyond. A source without weight gets no slot and isn't in the mix. A null
    source is one of its own; null and empty texts count as one character; repeated rows keep separate places. An empty
    table gives no rows.
    """
    spark = df.sparkSession
    names = {x: free_name(df, x) for x in ("block", "slot", "last_slot", "in_mix", *(["begins"] if begins else []))}
    src, key, tie, size, bucket = (free_name(df, x) for x in ("src_", "key_", "tie_", "size_", "bucket_"))
    bits = max(1, math.ceil(math.log2(max(2, df.count())) / 2))  # about the root of the rows: buckets of a source
    cols = [F.col(f"`{c}`") for c in keep]
    rows = df.select(
        *cols,
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("n")).alias(src),
        F.xxhash64(F.lit(seed), F.col(f"`{id_col}`")).alias(key),
        F.xxhash64(F.col(f"`{text_col}`")).alias(tie),
        F.greatest(F.lit(1), F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(1))).cast("long").alias(size),
    ).withColumn(bucket, F.shiftright(F.col(key), 64 - bits))
    part = materialize(rows.groupBy(F.col(src).alias("src"), F.col(bucket).alias("bucket")).agg(F.sum(size).alias("n")), "mix-sums")
    plan = materialize(plan_sources(part.groupBy("src").agg(F.sum("n").alias("chars")), weights, resolution, block_chars), "mix-plan")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = part.select("src", "bucket", before.alias("base"), "n")
    sized = plan.select("h", "stretch", "d").first()
    start, slots = free_name(df, "start_"), free_name(df, "slots_")
    if sized is None:
        horizon, held = 0, base.select("src", "bucket", "base", F.lit(None).cast("array<bigint>").alias("slots"))
    else:
        table = materialize(schedule(plan, *sized), "mix-slots")
        horizon = table.agg(F.min(F.when(F.col("block") >= F.col("n_blocks"), F.col("slot")))).first()[0]
        horizon = sized["h"] if horizon is None else horizon
        # a bucket of documents holds the slots of the blocks that it touches
        touched = base.withColumn("block", F.explode(F.expr(f"sequence(base div {block_chars}, (base + n - 1) div {block_chars})")))
        by_block = F.array_sort(F.collect_list(F.struct("block", "slot")))
        held = touched.join(table.filter("block < n_blocks").select("src", "block", "slot"), ["src", "block"]).groupBy("src", "bucket").agg(F.first("base").alias("base"), by_block["slot"].alias("slots"))
        held = base.select("src", "bucket", "base").join(held.drop("base"), ["src", "bucket"], "left")
    placed = rows.join(held.select(F.col("src").alias(src), F.col("bucket").alias(bucket), F.col("base").alias(start), F.col("slots").alias(slots)), [src, bucket])
    inner = Window.partitionBy(src, bucket).orderBy(key, tie).rowsBetween(Window.unboundedPreceding, -1)
    at = free_name(df, "at_")
    placed = placed.withColumn(at, F.col(start) + F.coalesce(F.sum(size).over(inner), F.lit(0)))
    block = F.floor(F.col(at) / block_chars)
    of = lambda b: F.get(F.col(slots), (b - F.floor(F.col(start) / block_chars)).cast("int"))
    slot = of(block)
    place = [F.col(at).alias(names["begins"])] if begins else []
    return placed.select(*cols, block.alias(names["block"]), slot.alias(names["slot"]), of(F.floor((F.col(at) + F.col(size) - 1) / block_chars)).alias(names["last_slot"]), F.coalesce(slot < F.lit(horizon), F.lit(False)).alias(names["in_mix"]), *place), names
