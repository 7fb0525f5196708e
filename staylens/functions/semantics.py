"""Column-level building blocks shared by every operator.

These keep the pandas semantics the analytics were written against (null keys dropped by grouping, NaN skipped by
aggregates, left-open bands, bias-corrected skew, linear-interpolated quantiles) while staying inside native Spark
expressions so Catalyst can push, prune and code-generate around them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.session import ensure_checkpoint_dir

# Groups whose sketches (a few dozen numbers each) are broadcast, and the salts that spread rows of more groups.
MAX_BROADCAST_GROUPS = 20_000
SALTS = 32

# Relative rank error of the sketch used to bracket exact quantiles, and how many values a bracket may still hold when
# they are ranked in one window (see ``quantiles``).
DEFAULT_ACCURACY = 10000
LAST_VALUES = 50_000

# A number as pandas.to_numeric accepts it, after the caller has stripped currency marks. Spark's own cast is more
# lenient ('12d' -> 12.0, 'nan' -> NaN), so the text is tested first.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Unicode-aware whitespace class understood by both Java regexes and RE2 (plain \s is ASCII-only in both).
UNICODE_SPACE = r"[\s\p{Z}]"


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN is a value in Spark (it poisons avg); pandas skips it. Turn it into null once, at ingest."""
    c = col_of(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def parse_number(c: str | Column) -> Column:
    """pandas ``to_numeric(errors='coerce')``: a well-formed number or null."""
    s = F.trim(col_of(c).cast("string"))
    return F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))


def unicode_strip(c: str | Column) -> Column:
    """Python ``str.strip()``: remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(col_of(c), rf"^{UNICODE_SPACE}+|{UNICODE_SPACE}+$", "")


def cut(c: str | Column, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = False) -> Column:
    """``pd.cut(x, edges, labels)``: right-closed bands (a, b]; values outside every band become null.

    ``include_lowest`` closes the first band on the left as well, which pandas does only when asked.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("cut needs len(edges) == len(labels) + 1")
    if any(b <= a for a, b in zip(edges, edges[1:])):
        raise ValueError("cut edges must increase monotonically")
    x = col_of(c)
    expr = None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        lower = (x >= F.lit(lo)) if (include_lowest and i == 0) else (x > F.lit(lo))
        cond = lower & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def sample_skew(x: str | Column) -> Column:
    """Bias-corrected sample skewness G1 (pandas ``Series.skew``); Spark's ``skewness`` is the population g1."""
    x = col_of(x)
    n = F.count(x).cast("double")
    factor = F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, F.skewness(x) * factor)


def round_half_up(c: str | Column, digits: int) -> Column:
    """Half-up rounding written the same way in both engines: floor(x * 10^d + 0.5) / 10^d."""
    scale = float(10**digits)
    return F.floor(col_of(c) * scale + 0.5) / scale


def r4(c: str | Column) -> Column:
    """Round a computed double to 4 places for comparison output.

    Half-up by the explicit formula (see ``round_half_up``) so both engines produce the same bits from the same
    input; built-in ``round`` differs between engines on ties. Valid for |x| < 9e14."""
    x = col_of(c).cast("double")
    return F.when(F.isnan(x), x).otherwise(round_half_up(x, 4))


def r4_decimal(c: str | Column) -> Column:
    """``r4`` for a value that is an exact decimal (a mean of money amounts): rounds in decimal arithmetic, so the
    result does not depend on how a double happened to land near a tie."""
    x = col_of(c).cast("decimal(38,6)")
    return F.floor(x * 10000 + F.lit(0.5).cast("decimal(2,1)")).cast("double") / 10000.0


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """pandas ``groupby`` drops rows whose key is null."""
    cond = None
    for k in keys:
        cond = F.col(k).isNotNull() if cond is None else cond & F.col(k).isNotNull()
    return df if cond is None else df.where(cond)


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row statistics frame to every row.

    The statistics frame is the result of a global aggregate, so it has exactly one row: broadcasting it is
    bounded regardless of the input size, and no value passes through the driver.
    """
    return df.crossJoin(F.broadcast(one_row))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the session names (``spark.checkpoint.dir``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def evaluated_once(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` persisted for a few passes, unless it already is. What is built inside must be computed inside."""
    level = df.storageLevel
    if level.useMemory or level.useDisk:
        yield df
        return
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


def join_group_stats(rows: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner", groups: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``stats`` (one row per group) by equal keys, never shuffling a hot group whole.

    The statistics are computed once and counted (unless the caller has: ``groups``): up to ``MAX_BROADCAST_GROUPS`` rows are
    broadcast, so the rows stay where they are. More groups hold few rows each on average, but any may be hot, so rows are
    spread over salts."""
    keys = list(keys)
    if groups is None:
        stats = checkpointed(stats)
        groups = stats.count()
    if groups <= MAX_BROADCAST_GROUPS:
        return rows.join(F.broadcast(stats), keys, how)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    each = stats.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.withColumn("_salt", salt).join(each, [*keys, "_salt"], how).drop("_salt")


def hash_order(id_col: str | Column, seed: int) -> Column:
    """Deterministic pseudo-random order: md5 of 'id|seed'. Equal in Spark and DuckDB."""
    return F.md5(F.concat_ws("|", col_of(id_col).cast("string"), F.lit(str(seed))))


SAMPLE_BUCKET_HEX = 5  # hash prefix digits that bucket rows for sampling: 16^5 = 1,048,576 buckets


def hash_sample(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """Exact-n seeded sample (pandas ``sample(n, random_state)`` semantics: exactly min(n, rows) rows): the n rows
    with the smallest hash order, ties by id.

    A plain ``orderBy().limit(n)`` sends up to n rows from every input partition to one task, which on a large
    input is partitions x n rows. Instead rows are bucketed by a prefix of their hash: a pass over the id column
    counts rows per bucket (at most ~1 M buckets), a running sum over that small frame finds the bucket holding
    the n-th row, and only rows in buckets up to it (about n + rows / 1 M) reach the final top-n."""
    h = hash_order(id_col, seed)
    bucket = F.conv(F.substring(h, 1, SAMPLE_BUCKET_HEX), 16, 10).cast("long")
    tagged = df.withColumn("_sh", h).withColumn("_sb", bucket)
    counts = df.select(bucket.alias("_sb")).groupBy("_sb").agg(F.count(F.lit(1)).alias("_sc"))
    # At most 16^5 rows: the single ordered window below is bounded.
    before = F.coalesce(F.sum("_sc").over(Window.orderBy("_sb").rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(0))
    cut = counts.withColumn("_before", before).where(F.col("_before") < n).agg(F.max("_sb").alias("_smax"))
    cand = tagged.join(F.broadcast(cut), F.col("_sb") <= F.col("_smax"))
    return cand.orderBy("_sh", F.col(id_col)).limit(n).drop("_sh", "_sb", "_smax")


def quantiles(
    df: DataFrame,
    value: str | Column,
    probs: Sequence[float],
    keys: Sequence[str] = (),
    names: Sequence[str] | None = None,
    accuracy: int = DEFAULT_ACCURACY,
    method: str = "bracket",
    last_values: int = LAST_VALUES,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Exact linear-interpolated quantiles per group (pandas ``quantile``, DuckDB ``quantile_cont``).

    Returns one row per non-null key (one row in total when ``keys`` is empty) with one column per probability, and the
    named aggregates ``extra`` over the group's values that aren't null (column ``_v``), taken in the first pass.

    ``method="direct"`` uses Spark's ``percentile``: one pass, but its buffer holds every distinct value of a
    group in one task. ``method="bracket"`` (default) is exact and bounded for hot groups. The keys and values are
    persisted while it runs, so their source is evaluated once, and the result (a row per group) is computed at once:

    1. one partial-aggregated pass counts each group and builds a mergeable rank sketch; for every probability
       it brackets the target rank between two sketch values (only for groups of at least ``accuracy`` rows;
       smaller groups keep every value);
    2. while a bracket may hold more than ``last_values`` values, a pass over these groups counts the rows up to its lower
       end and sketches the rows strictly inside; the target ranks then lie between two neighbouring points of that
       finer grid. Each pass leaves about one in ``accuracy / 40`` of the rows, all columns and groups together;
    3. every row outside the brackets is folded into one gap marker per gap, and rows are counted per
       (group, value) with map-side combine, so ties and the bulk of a hot group collapse before the shuffle;
    4. a window per group over these at most ``len(probs) * (last_values + 3)`` distinct values, however large the group,
       accumulates counts and picks the values at the two ranks around ``p·(n-1)``, then interpolates.
    """
    keys = list(keys)
    names = list(names) if names is not None else [f"q{i}" for i in range(len(probs))]
    v = nan_to_null(col_of(value)).cast("double")
    base = drop_null_keys(df.select(*[F.col(k) for k in keys], v.alias("_v")), keys).where(F.col("_v").isNotNull())
    if not keys:
        base = base.withColumn("_g", F.lit(0))
    kcols = keys or ["_g"]
    more = [c for c in extra]

    if method == "direct":
        agg = base.groupBy(*kcols).agg(F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs])).alias("_q"), *more)
        out = agg.select(*kcols, *[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)],
                         *[c for c in agg.columns if c not in (*kcols, "_q")])
    elif method == "bracket":
        cached = df.storageLevel.useMemory or df.storageLevel.useDisk
        with evaluated_once(df if cached else base):
            out = checkpointed(_bracket_quantiles(base, kcols, probs, names, accuracy, last_values, more))
    else:
        raise ValueError(f"unknown quantile method {method!r}")

    if keys:
        return out
    # A global quantile is always one row, null on empty input, as pandas / SQL give.
    return out.groupBy().agg(*[F.max(c).alias(c) for c in out.columns if c not in kcols])


def column_quantiles(df: DataFrame, wanted: Mapping[str, tuple[str | Column, float]], **qkw) -> DataFrame:
    """One row with a quantile of several columns, all found in the same passes: name -> (column, probability)."""
    probs = sorted({p for _, p in wanted.values()})
    pairs = F.explode(F.array(*[F.struct(F.lit(nm).alias("_column"), nan_to_null(col_of(c)).cast("double").alias("_x"))
                                for nm, (c, _) in wanted.items()])).alias("_pair")
    long = df.select(pairs).select("_pair.*")
    q = quantiles(long, "_x", probs, ["_column"], [f"q{i}" for i in range(len(probs))], **qkw)
    return q.groupBy().agg(*[F.max(F.when(F.col("_column") == nm, F.col(f"q{probs.index(p)}"))).alias(nm)
                             for nm, (_, p) in wanted.items()])


def _ranks(p: float) -> tuple[Column, Column]:
    """The two ranks (from 0) around p * (n - 1)."""
    pos = F.lit(float(p)) * (F.col("_n") - 1)
    return F.floor(pos), F.ceil(pos)


def _brackets(base: DataFrame, kcols: list[str], probs, accuracy: int, last_values: int, extra: Sequence[Column]) -> tuple[DataFrame, int]:
    """The number of groups, and per group ``_n``, and arrays over the probabilities of the bracket's ends (``_lo``, ``_hi``, equal to ranked values or
    beyond them) and of how many values may lie strictly inside (``_in``); groups under ``accuracy`` rows have null brackets."""
    eps, k = 1.0 / accuracy, len(probs)
    ends = [max(0.0, p - 3 * eps) for p in probs] + [min(1.0, p + 3 * eps) for p in probs]
    stats = base.groupBy(*kcols).agg(
        F.count("_v").alias("_n"), F.percentile_approx("_v", F.array(*[F.lit(float(p)) for p in ends]), accuracy).alias("_sk"), *extra)
    more = [c for c in stats.columns if c not in (*kcols, "_n", "_sk")]
    large = F.col("_n") >= accuracy
    # The sketch's ranks may be off by one in ``accuracy`` at either end.
    inside = F.when(large, F.col("_n") * (8 * eps)).otherwise(0.0)
    state = checkpointed(stats.select(
        *kcols, *more, "_n", F.when(large, F.slice("_sk", 1, k)).alias("_lo"), F.when(large, F.slice("_sk", k + 1, k)).alias("_hi"),
        F.array(*[inside] * k).alias("_in")))
    grid = max(4, accuracy // 10)
    points = F.array(*[F.lit(j / grid) for j in range(grid + 1)])
    wide = F.exists("_in", lambda x: x > last_values)
    while True:
        seen = state.agg(F.count(F.lit(1)).alias("groups"), F.max(wide).alias("wide")).first()
        if not seen.wide:
            return state, seen.groups
        hot = state.where(wide)
        # Only the few ends are sent to the rows.
        rows = join_group_stats(base, hot, kcols, groups=seen.groups)
        aggs = [F.first(c).alias(c) for c in (*more, "_n", "_lo", "_hi")]
        for i in range(k):
            low, high = F.col("_lo")[i], F.col("_hi")[i]
            strictly = (F.col("_v") > low) & (F.col("_v") < high)
            aggs += [F.count(F.when(F.col("_v") <= low, 1)).alias(f"_b{i}"), F.count(F.when(strictly, 1)).alias(f"_s{i}"),
                     F.percentile_approx(F.when(strictly, F.col("_v")), points, accuracy).alias(f"_g{i}")]
        looked = rows.groupBy(*kcols).agg(*aggs)
        lows, highs, lefts = [], [], []
        for i, p in enumerate(probs):
            low, high, below, strict, at = F.col("_lo")[i], F.col("_hi")[i], F.col(f"_b{i}"), F.col(f"_s{i}"), F.col(f"_g{i}")
            first, last = _ranks(p)
            # One grid cell of slack on either side, which is ten times the sketch's error.
            a = F.floor((first - below) / strict * grid) - 1
            z = F.ceil((last - below + 1) / strict * grid) + 1
            lows.append(F.when(first >= below + strict, high).when((strict == 0) | (first < below) | (a <= 0), low).otherwise(at[a.cast("int")]))
            highs.append(F.when(last < below, low).when((strict == 0) | (last >= below + strict) | (z >= grid), high).otherwise(at[z.cast("int")]))
            span = F.least(z, F.lit(grid)) - F.greatest(a, F.lit(0)) + 1
            lefts.append(F.when((strict == 0) | (first >= below + strict) | (last < below), 0.0).otherwise(
                F.least(strict * 1.0, strict * span / grid)))
        narrower = looked.select(*kcols, *more, "_n", F.array(*lows).alias("_nlo"), F.array(*highs).alias("_nhi"), F.array(*lefts).alias("_in"), "_lo", "_hi")
        # A bracket that no longer shrinks holds few distinct values: its ends are as close as the grid can tell.
        still = (F.col("_nlo") == F.col("_lo")) & (F.col("_nhi") == F.col("_hi"))
        narrower = narrower.select(*kcols, *more, "_n", F.col("_nlo").alias("_lo"), F.col("_nhi").alias("_hi"),
                                   F.when(still, F.array(*[F.lit(0.0)] * k)).otherwise(F.col("_in")).alias("_in"))
        state = checkpointed(state.where(~wide).unionByName(narrower))


def _bracket_quantiles(base: DataFrame, kcols: list[str], probs, names, accuracy: int, last_values: int = LAST_VALUES,
                       extra: Sequence[Column] = ()) -> DataFrame:
    stats, groups = _brackets(base, kcols, probs, accuracy, last_values, extra)
    more = [c for c in stats.columns if c not in (*kcols, "_n", "_lo", "_hi", "_in")]
    counted = folded_values(base, kcols, stats.select(*kcols, "_n", "_lo", "_hi"), len(probs), groups)
    w = Window.partitionBy(*kcols).orderBy("_kv", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = counted.withColumn("_end", F.sum("_c").over(w)).withColumn("_start", F.col("_end") - F.col("_c"))
    aggs = [F.first("_n").alias("_n")]
    for i, p in enumerate(probs):
        for side, r in zip(("lo", "hi"), _ranks(p)):
            hit = (F.col("_kind") == 1) & (F.col("_start") <= r) & (r < F.col("_end"))
            aggs.append(F.max(F.when(hit, F.col("_kv"))).alias(f"_{side}{i}"))
    picked = cum.groupBy(*kcols).agg(*aggs)
    outs = []
    for i, (p, nm) in enumerate(zip(probs, names)):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        frac = pos - F.floor(pos)
        a, b = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        missed = F.raise_error(F.lit(f"quantile {p} fell outside its bracket; use method='direct'"))
        outs.append(F.when(a.isNull() | b.isNull(), missed.cast("double")).otherwise(a + (b - a) * frac).alias(nm))
    out = picked.select(*kcols, *outs)
    return out.join(stats.select(*kcols, *more), kcols) if more else out


def folded_values(base: DataFrame, kcols: list[str], stats: DataFrame, k: int, groups: int | None = None) -> DataFrame:
    """What the last window ranks: rows counted per (group, value) inside the brackets, and one marker per gap (kind 0)."""
    # Rows fold into their brackets before any shuffle wherever the brackets can be broadcast.
    joined = join_group_stats(base, stats, kcols, groups=groups)
    v = F.col("_v")
    los, his = [F.col("_lo")[i] for i in range(k)], [F.col("_hi")[i] for i in range(k)]
    inside = None
    for lo, hi in zip(los, his):
        c = (v >= lo) & (v <= hi)
        inside = c if inside is None else inside | c
    inside = F.when(F.col("_lo").isNull(), F.lit(True)).otherwise(inside)
    nexts = [F.when(lo > v, lo) for lo in los]
    next_lo = nexts[0] if k == 1 else F.least(*nexts)
    key_v = F.when(inside, v).otherwise(F.coalesce(next_lo, F.lit(math.inf)))
    kind = F.when(inside, F.lit(1)).otherwise(F.lit(0))
    return joined.groupBy(*kcols, "_n", key_v.alias("_kv"), kind.alias("_kind")).agg(F.count(F.lit(1)).alias("_c"))


def median(df: DataFrame, value: str | Column, keys: Sequence[str] = (), name: str = "median", **kw) -> DataFrame:
    return quantiles(df, value, [0.5], keys, [name], **kw)
