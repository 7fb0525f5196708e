"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source gets a target number of tokens (words here): the sources share the corpus by weight, none above ``most``
times its own size, and what a capped source leaves is shared again by weight (``targets``).

Method. Documents of a source are dealt to shards by hash, and each shard lays its documents out on a line of tokens in
seeded order, cut into blocks of ``block`` tokens (the last one of a line may be shorter). Blocks are seats: the sources
win them by the highest quotients weight / (2k + 1), k being the seats already won, where a source's weight is its target
in blocks of its own mean length; then each source's seats are apportioned among its shards in the same way, by their
numbers of blocks. So every shard has an integer quota. It takes its whole line quota div blocks times, and quota mod
blocks more blocks in a ring from a seeded first block; as documents lie in seeded order, this is a random choice of
mostly whole documents. No quota exceeds ``most`` times a shard's blocks, so no document is taken more often than that.

``apportion`` never lists all quotients: seats that any divisor near the average must give are given at once, and only
the next few quotients of each party are ranked.

Scale. Texts are read once, for their sizes, which are written; all else moves rows of a few numbers. A shard has about
``shard_docs`` documents of all sources, so a window over one source in one shard is bounded however large the source.
Repeated rows are one row with a count until the end. Sources are ranked by sorted ranges; only the quotients of the last
seats, about four narrow rows a source, meet in one task.

Odd rows: a null text has size 0; null and repeated ids are documents of their own; a null source is a source, the last.
Sources without a word have target 0. Ties between quotients go to the earlier source or shard, and equal rows are
interchangeable, so reruns give the same rows. An empty table gives an empty result. Further columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm.common import materialised, pick, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK = 8
SHARD_DOCS = 10_000
PARTS = 1000  # a source's weight is counted in thousandths of a block, so that sums are exact


def digits(value: Column, first: int, n: int) -> Column:
    """n hexadecimal digits of a value's MD5 as a number; equal in Spark and DuckDB."""
    return F.conv(F.substring(F.md5(value), first, n), 16, 10).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size``: the words of every whole text."""
    return pick(docs, doc_id=id_col, source=source_col, text=text_col).select(
        "doc_id", F.col("source").cast("string"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def ranked_sources(measured: DataFrame) -> DataFrame:
    """``source, source_size, place`` (from 0 by code point, null last), numbered within sorted ranges."""
    order = [F.col("source").isNull(), F.col("source")]
    totals = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    held = materialised(totals.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn(
        "id", F.monotonically_increasing_id()).withColumn("part", F.shiftright("id", 33))
    # One row per sorted range.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return held.join(F.broadcast(offsets), "part").select(
        "source", "source_size", (F.col("offset") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


def targets(measured: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, place, weight, target``: tokens by weight, none above ``most`` times the source's size.

    One small aggregate a round finds the level that the uncapped sources share; a source once capped stays capped."""
    sources = materialised(ranked_sources(measured).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("long")))
    size, weight = F.col("source_size"), F.col("weight")
    total = sources.agg(F.sum(size)).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = weight * F.lit(level) > size * most if capped >= 0 else F.lit(False)
        row = sources.agg(F.sum(F.when(over, size * most)).alias("full"), F.sum(F.when(~over, weight)).alias("shared"),
                          F.count(F.when(over, 1)).alias("n")).first()
        if row.n == capped or not row.shared:
            break
        level, capped = (total - (row.full or 0)) / row.shared, row.n
    return sources.withColumn("target", F.least(weight * F.lit(level), (size * most).cast("double")))


def apportion(parties: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Sainte-Laguë: ``seats`` of each group go to its parties by the highest quotients weight / (2k + 1), at most ``cap``
    each, ties by ``order``. Adds ``quota``. A group's seats must not exceed the caps of its parties of positive weight."""
    whole = Window.partitionBy(group)
    weight, seats = F.col("weight").cast("double"), F.col("seats")
    stats = parties.withColumns({"all_weight": F.sum(weight).over(whole), "n_parties": F.count(F.lit(1)).over(whole)})

    def seats_at(divisor: Column) -> Column:
        return F.when(weight > 0, F.floor(weight / divisor + 0.5)).otherwise(0).cast("long")

    # No divisor in question is above the first one or, unless caps bind, below the second.
    n = seats.cast("double")
    above = F.col("all_weight") / (n - F.col("n_parties") / 2)
    sure = F.when(n > F.col("n_parties") / 2, F.greatest(F.lit(0), seats_at(above) - 1)).otherwise(0)
    share, short = 1.0, True
    while short:
        below = F.lit(share) * F.col("all_weight") / (n + F.col("n_parties") / 2)
        held = materialised(stats.withColumns({"sure": F.least(sure, F.col("cap")), "last": F.least(seats_at(below) + 1, F.col("cap"))}))
        lacking = held.groupBy(group).agg((F.sum("last") < F.first("seats")).alias("lacking"))
        short, share = bool(lacking.where("lacking").limit(1).count()), share / 2
    names = parties.columns
    quotients = held.where(F.col("last") > F.col("sure")).withColumn(
        "_seat", F.explode(F.sequence("sure", F.col("last") - 1))).withColumn("quotient", weight / (2 * F.col("_seat") + 1))
    by_quotient = Window.partitionBy(group).orderBy(F.col("quotient").desc(), *order)
    left = seats - F.col("all_sure")
    won = quotients.join(held.groupBy(F.col(group).alias("_g")).agg(F.sum("sure").alias("all_sure")), F.col(group) == F.col("_g")) \
        .withColumn("rank", F.row_number().over(by_quotient)).where(F.col("rank") <= left) \
        .groupBy(*[F.col(c).alias(f"_{c}") for c in (group, *order)]).agg(F.count(F.lit(1)).alias("won"))
    match = [F.col(c) == F.col(f"_{c}") for c in dict.fromkeys((group, *order))]
    return held.join(won, match, "left").select(*names, (F.col("sure") + F.coalesce("won", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, block: int = BLOCK,
        shard_docs: int = SHARD_DOCS, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken`` (words of it that the mix takes, repeats counted)."""
    measured = written(sizes(docs, id_col, text_col, source_col), "mixing")
    shards = -(-measured.count() // shard_docs) or 1
    sources = materialised(targets(measured, weights, most))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = measured.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")).withColumns({
        "shard": digits(named, 1, 8) % shards, "lot": digits(named, 9, 15)})
    line = Window.partitionBy("source", "shard").orderBy("lot", "doc_id", "size")
    lines = materialised(rows.withColumn("end", F.sum(F.col("size") * F.col("copies")).over(line)))

    size = F.col("source_size")
    parts = lines.groupBy("source", "shard").agg(F.max("end").alias("length")).withColumn(
        "cap", F.ceil(F.col("length") / block))
    parts = materialised(parts.alias("p").join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select(
        "place", "shard", "length", F.col("cap").alias("blocks")))
    by_source = parts.groupBy("place").agg(F.sum("blocks").alias("all_blocks"))
    wanted = sources.join(by_source, "place").select(
        "place", F.lit(0).alias("all"), (F.col("all_blocks") * most).alias("cap"),
        F.when(size > 0, F.least(F.floor(F.col("target") * PARTS * F.col("all_blocks") / size), F.col("all_blocks") * most * PARTS))
        .otherwise(0).cast("long").alias("weight"))
    seats = wanted.withColumn("seats", F.floor(F.sum("weight").over(Window.partitionBy("all")) / PARTS))
    won = apportion(seats, "all", ["place"]).select("place", F.col("quota").alias("seats"))
    quotas = apportion(parts.join(won, "place").withColumns({"weight": F.col("blocks"), "cap": F.col("blocks") * most}),
                       "place", ["shard"])

    blocks, quota = F.col("blocks"), F.col("quota")
    first = digits(F.concat_ws(":", F.lit(seed), "place", "shard"), 1, 8)
    ring = quotas.where(blocks > 0).withColumns({"first": first % blocks, "rounds": F.floor(quota / blocks), "more": quota % blocks})
    per_source = sources.select(F.col("source").alias("of"), "place", "source_size", "target")
    chosen = lines.join(per_source, F.col("source").eqNullSafe(F.col("of"))).join(
        ring.select("place", "shard", "first", "rounds", "more", "blocks"), ["place", "shard"], "left")
    each = chosen.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).withColumn(
        "stop", F.col("end") - (F.col("copies") - F.col("copy")) * F.col("size")).withColumn("start", F.col("stop") - F.col("size"))

    def inside(first_block: Column, last_block: Column) -> Column:
        """Words of the document within the blocks from the first to before the last."""
        return F.greatest(F.lit(0), F.least("stop", last_block * block) - F.greatest("start", first_block * block))

    ring_end = F.col("first") + F.col("more")
    taken = F.col("rounds") * F.col("size") + inside(F.col("first"), F.least(ring_end, F.col("blocks"))) \
        + inside(F.lit(0).cast("long"), F.greatest(ring_end - F.col("blocks"), F.lit(0)))
    return each.select("doc_id", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"))


def mix_sql(weights: Sequence[int] = WEIGHTS, most: int = MOST, block: int = BLOCK, shard_docs: int = SHARD_DOCS,
            seed: str = "mix") -> str:
    """``mix`` of ``documents`` in DuckDB: every quotient of a source or shard is listed and ranked."""
    weight = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(weights))
    hexa = lambda text, first, n: f"CAST('0x' || substr(md5({text}), {first}, {n}) AS BIGINT)"
    named = f"'{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')"

    def quotas(parties: str, group: str, key: str) -> str:
        return f"""
  SELECT p.{group} AS g, p.{key} AS k, count(r) AS quota FROM {parties} p LEFT JOIN (
    SELECT * FROM (SELECT {group} AS g, {key} AS k, seats, row_number() OVER (PARTITION BY {group} ORDER BY weight / (2 * n + 1) DESC, {key}) AS r
                   FROM (SELECT *, unnest(range(cap)) AS n FROM {parties} WHERE weight > 0)) WHERE r <= seats) w
  ON w.g = p.{group} AND w.k = p.{key} GROUP BY ALL"""

    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT *, CASE place % {len(weights)} {weight} END::BIGINT AS weight FROM (
  SELECT source, size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM (SELECT source, sum(size)::BIGINT AS size FROM d GROUP BY source))),
levels AS (
  SELECT 0 AS n, 0::BIGINT AS capped, (sum(size) / sum(weight))::DOUBLE AS level, false AS done FROM s
  UNION ALL
  SELECT n + 1, x.n_over, CASE WHEN x.n_over = capped OR shared IS NULL THEN level ELSE (total - full_size) / shared END,
         x.n_over = capped OR shared IS NULL
  FROM (SELECT l.n, l.capped, l.level, count(CASE WHEN s.weight * l.level > s.size * {most} THEN 1 END) AS n_over,
               coalesce(sum(CASE WHEN s.weight * l.level > s.size * {most} THEN s.size * {most} END), 0)::DOUBLE AS full_size,
               sum(CASE WHEN NOT s.weight * l.level > s.size * {most} THEN s.weight END)::DOUBLE AS shared,
               sum(s.size)::DOUBLE AS total
        FROM levels l, s WHERE NOT l.done GROUP BY l.n, l.capped, l.level) x),
t AS (SELECT s.*, least(weight * level, (size * {most})::DOUBLE) AS target FROM s, (SELECT level FROM levels ORDER BY n DESC LIMIT 1)),
c AS (SELECT greatest(1, (count(*) + {shard_docs - 1}) // {shard_docs}) AS shards FROM d),
l AS (SELECT doc_id, d.size, place, t.size AS source_size, target, {hexa(named, 1, 8)} % shards AS shard, {hexa(named, 9, 15)} AS lot
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, c),
o AS (SELECT *, sum(size) OVER (PARTITION BY place, shard ORDER BY lot, doc_id NULLS FIRST, size
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS stop FROM l),
p AS (SELECT place, shard, (max(stop) + {block - 1}) // {block} AS blocks FROM o GROUP BY ALL),
b AS (SELECT place, sum(blocks)::BIGINT AS blocks FROM p GROUP BY place),
w AS (SELECT 0 AS everyone, place, blocks * {most} AS cap,
             CASE WHEN size > 0 THEN least(floor(target * {PARTS} * blocks / size), blocks * {most * PARTS})::BIGINT ELSE 0 END AS weight
      FROM t JOIN b USING (place)),
v AS (SELECT *, (sum(weight) OVER () // {PARTS})::BIGINT AS seats FROM w),
q1 AS ({quotas('v', 'everyone', 'place')}),
u AS (SELECT place, shard, blocks AS weight, blocks * {most} AS cap, quota AS seats FROM p JOIN q1 ON q1.k = p.place),
q2 AS ({quotas('u', 'place', 'shard')}),
r AS (SELECT place, shard, blocks, quota // blocks AS rounds, quota % blocks AS more,
             {hexa(f"'{seed}:' || place || ':' || shard", 1, 8)} % blocks AS head
      FROM p JOIN q2 ON q2.g = p.place AND q2.k = p.shard WHERE blocks > 0)
SELECT doc_id, o.size, source_size, target, coalesce(
  rounds * o.size + greatest(0, least(stop, least(head + more, blocks) * {block}) - greatest(stop - o.size, head * {block}))
  + greatest(0, least(stop, greatest(head + more - blocks, 0) * {block}) - (stop - o.size)), 0)::BIGINT AS taken
FROM o LEFT JOIN r USING (place, shard)
"""
