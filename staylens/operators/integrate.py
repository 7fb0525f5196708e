"""External-table integration: profile, key hints, fuzzy key map, column mapping, merge and report (J-1 .. J-7).

Profiles and containment scores are computed on an unpivoted (column, value) long form, so any number of columns
costs one job. The merge keeps the first row per key by an explicit order column with a ``min_by`` aggregate
(partial-aggregated, so a hot key is combined map-side) and joins null keys to null keys as pandas ``merge`` does.
"""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens.functions.semantics import nan_to_null, with_scalars

# Names that hint at a join key when contained in a column name (fixed list).
KNOWN_KEYS = ["neighbourhood", "neighbourhood_cleansed", "id", "host_id", "latitude", "longitude", "name", "price"]
FUZZY_CUTOFF = 0.55
SAMPLE_SEPARATOR = " | "
SKETCH_SIZE = 1024  # smallest hashes kept of a column


def _normalise(c) -> F.Column:
    """Lower-case; '_' and '-' become spaces (the reference's name normalisation)."""
    return F.translate(F.lower(c), "_-", "  ")


def _normalise_name(s: str) -> str:
    return s.lower().replace("_", " ").replace("-", " ")


def _value(df: DataFrame, c: str) -> F.Column:
    """The column, with NaN as null in floating-point columns (pandas' missing value)."""
    return nan_to_null(F.col(f"`{c}`")) if dict(df.dtypes)[c] in ("double", "float") else F.col(f"`{c}`")


def _long_text(df: DataFrame) -> DataFrame:
    cols = df.columns
    cast = df.select(*[_value(df, c).cast("string").alias(f"c{i}") for i, c in enumerate(cols)])
    long = cast.unpivot([], [f"c{i}" for i in range(len(cols))], "_ci", "value")
    names = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(f"c{i}"), F.lit(c))])
    return long.select(names[F.col("_ci")].alias("column_name"), "value")


def join_hint(name: str, keys: Sequence[str] = KNOWN_KEYS) -> bool:
    """J-2: a column is a join candidate when its lower-cased name contains a known key name (so 'width' hits
    'id', as in the reference); ``token_hints`` is the stricter word-level variant."""
    low = name.lower()
    return any(k in low for k in keys)


def token_hint(name: str, keys: Sequence[str] = KNOWN_KEYS) -> bool:
    return _normalise_name(name).replace(" ", "_") in keys or any(t in keys for t in _normalise_name(name).split())


def profile_table(df: DataFrame, samples: int = 3, approx: bool = False) -> DataFrame:
    """J-1: one row per column: type, distinct non-null values, missing % (1 dp, half-even), up to three sample
    values (the smallest distinct values as text), the join-key hint, and the table shape (rows, columns)."""
    cols = df.columns
    types = dict(df.dtypes)
    meta = df.sparkSession.createDataFrame(
        [(i, c, types[c], join_hint(c)) for i, c in enumerate(cols)],
        "position int, column_name string, type string, join_hint boolean")
    wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.avg(_value(df, c).isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(cols)])
    miss = wide.unpivot(["_rows"], [f"m{i}" for i in range(len(cols))], "_mi", "_share").select(
        F.expr("cast(substring(_mi, 2) as int)").alias("position"), "_rows", "_share")
    long = _long_text(df).where(F.col("value").isNotNull())
    if approx:
        uniq = long.groupBy("column_name").agg(F.approx_count_distinct("value").alias("unique"))
        dist = long.distinct()
    else:
        dist = long.distinct()
        uniq = dist.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique"))
    # Top-n per column: Spark plans this row_number filter as a WindowGroupLimit (partial top-n before the shuffle).
    w = Window.partitionBy("column_name").orderBy("value")
    top = dist.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= samples)
    samp = top.groupBy("column_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "value"))), lambda s: s["value"]),
                     SAMPLE_SEPARATOR).alias("samples"))
    out = (meta.join(F.broadcast(miss), "position")
           .join(uniq, "column_name", "left").join(samp, "column_name", "left"))
    return out.select(
        "position", "column_name", "type", F.coalesce("unique", F.lit(0)).cast("long").alias("unique"),
        (F.col("_share") * 100).alias("missing_exact"), F.bround(F.col("_share") * 100, 1).alias("missing_pct"),
        F.coalesce("samples", F.lit("")).alias("samples"), "join_hint",
        F.col("_rows").alias("n_rows"), F.lit(len(cols)).cast("long").alias("n_cols"))


def _edits(la: F.Column, lb: F.Column, cutoff: float) -> F.Column:
    """The most edits between strings of these lengths whose similarity reaches the cutoff."""
    return F.floor(F.lit(1 - cutoff) * F.greatest(la, lb) + 1e-9).cast("int")


def _segments(keys: DataFrame, norm: str, own: str, other: str, cutoff: float, other_lengths: DataFrame) -> DataFrame:
    """Each key once per length that a partner may have, as (own length, other length, edits)."""
    length = F.length(norm)
    lengths = F.filter("_lengths", lambda x: F.abs(x - length) <= _edits(x, length, cutoff))
    return with_scalars(keys, other_lengths).withColumn(own, length).withColumn(other, F.explode(lengths)).drop("_lengths").withColumn(
        "_d", _edits(F.col(own), F.col(other), cutoff))


def _segment(i: F.Column, length: F.Column, edits: F.Column) -> tuple[F.Column, F.Column]:
    """Start (from 1) and length of segment i (from 1) of edits + 1 even ones; the longer ones come last."""
    parts = edits + 1
    base, longer = F.floor(length / parts).cast("int"), length % parts
    return (i - 1) * base + F.greatest(F.lit(0), i - 1 - (parts - longer)) + 1, base + (i > parts - longer).cast("int")


def fuzzy_candidates(a: DataFrame, b: DataFrame, cutoff: float) -> DataFrame:
    """Distinct (new_key, known_key) that share a segment at a fitting place; ``a`` holds ``new_key, _na``, ``b`` ``known_key, _nb``.

    A known key is cut into one segment more than a partner of the given length may have edits, so at least one segment is
    left whole. Counting edits from the left and from the right, segment i of a pair within the cutoff occurs in the new key at most i - 1
    places from its own place and at most edits + 1 - i from that place shifted by the difference of lengths: only these substrings are
    looked up. Tokens carry both lengths and the segment's number."""
    lengths = lambda keys, norm: keys.agg(F.collect_set(F.length(norm)).alias("_lengths"))  # noqa: E731 - one small row
    la, lb, d, i = F.col("_la"), F.col("_lb"), F.col("_d"), F.col("_i")
    start, size = _segment(i, lb, d)
    every = F.explode(F.sequence(F.lit(1), d + 1)).alias("_i")
    known = _segments(b, "_nb", "_lb", "_la", cutoff, lengths(a, "_na")).select("*", every).select(
        "known_key", "_la", "_lb", "_i", F.substring(F.col("_nb"), start, size).alias("_text"))
    low = F.greatest(F.lit(1), start - (i - 1), start + (la - lb) - (d + 1 - i))
    high = F.least(la - size + 1, start + (i - 1), start + (la - lb) + (d + 1 - i))
    places = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    new = _segments(a, "_na", "_la", "_lb", cutoff, lengths(b, "_nb")).select("*", every).select(
        "new_key", "_na", "_la", "_lb", "_i", size.alias("_size"), F.explode(places).alias("_at")).select(
        "new_key", "_la", "_lb", "_i", F.substring(F.col("_na"), F.col("_at"), F.col("_size")).alias("_text")).distinct()
    return new.join(known, ["_la", "_lb", "_i", "_text"]).select("new_key", "known_key").distinct()


def fuzzy_key_map(new_keys: DataFrame, known_keys: DataFrame, new_col: str, known_col: str,
                  cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """J-3: for each distinct new key, the most similar known key after normalisation, if its similarity
    1 - levenshtein / max(len) reaches ``cutoff`` (ties: the smaller known key).

    Candidates share a whole segment at a fitting place (``fuzzy_candidates``), which loses no pair for any cutoff above
    0.5; each is then verified with the exact distance. Pairs are of distinct keys, never of rows."""
    if cutoff <= 0.5:
        raise ValueError("segments are exact only for a cutoff above 0.5")
    a = new_keys.select(F.col(new_col).alias("new_key")).where(F.col("new_key").isNotNull()).distinct()
    b = known_keys.select(F.col(known_col).alias("known_key")).where(F.col("known_key").isNotNull()).distinct()
    a = a.withColumn("_na", _normalise(F.col("new_key")))
    b = b.withColumn("_nb", _normalise(F.col("known_key")))
    pairs = fuzzy_candidates(a, b, cutoff).join(a, "new_key").join(b, "known_key")
    longer = F.greatest(F.length("_na"), F.length("_nb"))
    sim = F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein("_na", "_nb") / longer)
    scored = pairs.withColumn("similarity", sim).where(F.col("similarity") >= cutoff)
    best = scored.groupBy("new_key").agg(
        F.min_by(F.struct("known_key", "similarity"),
                 F.struct((-F.col("similarity")).alias("s"), F.col("known_key").alias("k"))).alias("_b"))
    return a.select("new_key").join(best, "new_key", "left").select(
        "new_key", F.col("_b.known_key").alias("known_key"), F.col("_b.similarity").alias("similarity"))


def fuzzy_column_name(new_col: str, known_cols: Sequence[str], cutoff: float = FUZZY_CUTOFF) -> str | None:
    """Name-level fallback of the column mapper (schema only, plan time): difflib's closest match."""
    norm = [_normalise_name(c) for c in known_cols]
    m = difflib.get_close_matches(_normalise_name(new_col), norm, n=1, cutoff=cutoff)
    return known_cols[norm.index(m[0])] if m else None


def value_containment(new_df: DataFrame, known_df: DataFrame, new_cols: Sequence[str] | None = None,
                      known_cols: Sequence[str] | None = None) -> DataFrame:
    """J-4 (data part): for every (new column, known column), the share of the new column's distinct non-null
    values that occur in the known column (``containment``), and the share of the known column's that occur in the
    new one (``coverage``). One distinct long form per side, one equi-join on the value."""
    a = _long_text(new_df.select(*(new_cols or new_df.columns))).where(F.col("value").isNotNull()).distinct()
    b = _long_text(known_df.select(*(known_cols or known_df.columns))).where(F.col("value").isNotNull()).distinct()
    sizes = a.groupBy("column_name").agg(F.count(F.lit(1)).alias("_distinct"))
    hits = (a.join(b.withColumnRenamed("column_name", "known_column"), "value")
            .groupBy("column_name", "known_column").agg(F.count(F.lit(1)).alias("_hits")))
    known = b.groupBy(F.col("column_name").alias("known_column")).agg(F.count(F.lit(1)).alias("_known"))
    return hits.join(sizes, "column_name").join(known, "known_column").select(
        F.col("column_name").alias("new_column"), "known_column",
        (F.col("_hits") / F.col("_distinct")).alias("containment"), (F.col("_hits") / F.col("_known")).alias("coverage"))


def column_sketches(df: DataFrame, size: int = SKETCH_SIZE) -> DataFrame:
    """``column_name, hashes``: the ``size`` smallest distinct hashes of each column's values as text, ascending.

    One pass: a task keeps the smallest hashes of each column, and these few meet per column. Sketches of parts of a table
    merge into the sketch of the whole."""
    cols = df.columns

    def run(batches):
        kept = [np.zeros(0, "u8") for _ in cols]
        for batch in batches:
            for i in range(len(cols)):
                some = batch.column(i).drop_null().to_numpy(zero_copy_only=False).view("u8")
                kept[i] = np.unique(np.concatenate([kept[i], some]))[:size]
        for i, c in enumerate(cols):
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(kept[i]), pa.string()), pa.array(kept[i].view("i8"))], names=["column_name", "h"])

    hashed = df.select(*[F.when(_value(df, c).isNotNull(), F.xxhash64(_value(df, c).cast("string"))).alias(f"c{i}") for i, c in enumerate(cols)])
    # Unsigned order: the sign bit is turned for comparing signed numbers.
    order = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    place = Window.partitionBy("column_name").orderBy(order)
    few = hashed.mapInArrow(run, "column_name string, h long").distinct().withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= size)
    return few.groupBy("column_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "h"))), lambda s: s["h"]).alias("hashes"))


def sketch_jaccard(a: Sequence[int], b: Sequence[int], size: int = SKETCH_SIZE) -> tuple[float, float]:
    """The share of common values among all values of two columns by their sketches, and its standard error (0 if exact)."""
    x, y = (np.array(v, "i8").view("u8") for v in (a, b))
    union = np.union1d(x, y)
    exact = len(x) < size and len(y) < size
    if not exact:
        union = union[:size]
    if not len(union):
        return 0.0, 0.0
    share = np.isin(union, np.intersect1d(x, y)).mean()
    return float(share), 0.0 if exact else float((max(share * (1 - share), 1 / len(union)) / len(union)) ** 0.5)


def containment_candidates(new_df: DataFrame, known_df: DataFrame, least: float, size: int = SKETCH_SIZE) -> list[tuple[str, str]]:
    """Pairs of columns whose containment and coverage may both reach ``least``. Then at least least / (2 - least) of their values are
    common; a pair stays unless its sketches' estimate is six standard errors below. The driver holds one sketch a column."""
    new, known = ({r.column_name: r.hashes for r in column_sketches(df, size).collect()} for df in (new_df, known_df))
    bound = least / (2 - least) if least > 0 else 0.0
    out = []
    for c, a in new.items():
        for k, b in known.items():
            share, error = sketch_jaccard(a, b, size)
            if share + 6 * error >= bound and (share > 0 or error > 0):
                out.append((c, k))
    return out


def exact_containment(new_df: DataFrame, known_df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``value_containment`` of the given pairs of columns alone: other columns' values are not shuffled."""
    spark = new_df.sparkSession
    lut = spark.createDataFrame(list(pairs), "column_name string, known_column string")  # pairs of column names
    new_cols, known_cols = sorted({a for a, _ in pairs}), sorted({b for _, b in pairs})
    if not pairs:
        return spark.createDataFrame([], "new_column string, known_column string, containment double, coverage double")
    a = _long_text(new_df.select(*[f"`{c}`" for c in new_cols])).where(F.col("value").isNotNull()).distinct()
    b = _long_text(known_df.select(*[f"`{c}`" for c in known_cols])).where(F.col("value").isNotNull()).distinct()
    hits = a.join(F.broadcast(lut), "column_name").join(b.withColumnRenamed("column_name", "known_column"), ["known_column", "value"]) \
        .groupBy("column_name", "known_column").agg(F.count(F.lit(1)).alias("_hits"))
    sizes = a.groupBy("column_name").agg(F.count(F.lit(1)).alias("_distinct"))
    known = b.groupBy(F.col("column_name").alias("known_column")).agg(F.count(F.lit(1)).alias("_known"))
    return hits.join(sizes, "column_name").join(known, "known_column").select(
        F.col("column_name").alias("new_column"), "known_column",
        (F.col("_hits") / F.col("_distinct")).alias("containment"), (F.col("_hits") / F.col("_known")).alias("coverage"))


def value_mapping(new_df: DataFrame, known_df: DataFrame, min_containment: float = 0.5) -> DataFrame:
    """J-4 (data part): the known column that agrees best with each new column. Agreement is the harmonic mean of containment
    and coverage, both at least ``min_containment``: a few small integers are contained in any id column but cover little of
    it. Sketches rule out most pairs of columns; the others are compared exactly."""
    both = F.least("containment", "coverage")
    agree = 2 * F.col("containment") * F.col("coverage") / (F.col("containment") + F.col("coverage"))
    pairs = containment_candidates(new_df, known_df, min_containment)
    cont = exact_containment(new_df, known_df, pairs).where(both >= min_containment)
    return cont.groupBy("new_column").agg(
        F.min_by(F.struct("known_column", "containment"),
                 F.struct((-agree).alias("c"), F.col("known_column").alias("k"))).alias("_b")).select("new_column", "_b.*")


def suggest_column_mapping(new_df: DataFrame, known_df: DataFrame, min_containment: float = 0.5,
                           district: str = "neighbourhood_cleansed") -> DataFrame:
    """J-4: {new column → known column or null}: the best agreement of values (``value_mapping``), else the closest column
    name. Plus ``is_default_key`` (the column mapped to the district, else the first hinted column, else the first column)."""
    spark = new_df.sparkSession
    names = spark.createDataFrame(
        [(i, c, fuzzy_column_name(c, known_df.columns), join_hint(c)) for i, c in enumerate(new_df.columns)],
        "position int, new_column string, name_match string, join_hint boolean")
    best = value_mapping(new_df, known_df, min_containment)
    m = names.join(best, "new_column", "left").select(
        "position", "new_column", F.coalesce(F.col("known_column"), F.col("name_match")).alias("known_column"),
        "containment", "join_hint")
    rank = (F.when(F.col("known_column") == district, F.lit(0)).when(F.col("join_hint"), F.lit(1))
            .otherwise(F.lit(2)))
    first = m.agg(F.min_by("position", F.struct(rank.alias("r"), F.col("position").alias("p"))).alias("_key_pos"))
    return with_scalars(m, first).withColumn("is_default_key", F.col("position") == F.col("_key_pos")).drop(
        "_key_pos")


class MergeError(ValueError):
    pass


def merge_external(listings: DataFrame, new_df: DataFrame, key_new: str, key_known: str,
                   import_cols: Sequence[str], order_col: str | None = None, how: str = "left",
                   prefix: str | None = None) -> DataFrame:
    """J-5: bring ``import_cols`` of ``new_df`` into ``listings`` by key.

    Keys are validated first. Duplicate keys on the new side keep the first row by ``order_col`` (the smallest
    imported row when none is given, so duplicates resolve deterministically). Null keys match null keys. A clash with an
    existing column is refused unless ``prefix`` renames the imported columns."""
    if key_new not in new_df.columns:
        raise MergeError(f"The external table has no column {key_new!r} to join on.")
    if key_known not in listings.columns:
        raise MergeError(f"The listings have no column {key_known!r} to join on.")
    cols = [c for c in import_cols if c in new_df.columns and c != key_new]
    out_names = {c: f"{prefix}{c}" if prefix else c for c in cols}
    clash = [n for n in out_names.values() if n in listings.columns]
    if clash:
        raise MergeError(f"Imported columns already exist: {clash}; pass a prefix.")
    # The ordering value is never null (min_by skips null orderings): rows without an order value come last;
    # with no order column the smallest imported row wins, so duplicates resolve the same way on every run.
    if order_col:
        order = F.struct(F.col(order_col).isNull().alias("n"), F.col(order_col).alias("o"))
    else:
        order = F.struct(*[F.col(c) for c in cols]) if cols else F.lit(0)
    sub = new_df.select(F.col(key_new).alias("_k"), order.alias("_o"), *[F.col(c) for c in cols])
    first = sub.groupBy("_k").agg(F.min_by(F.struct(*cols), "_o").alias("_s")) if cols else sub.select("_k").distinct()
    first = first.select("_k", F.lit(True).alias("_key_matched"),
                         *[F.col(f"_s.{c}").alias(out_names[c]) for c in cols])
    joined = listings.withColumn("_listed", F.lit(True)).join(first, listings[key_known].eqNullSafe(first["_k"]), how)
    # A row without a listing (outer and right joins) carries the external key; it found no listing's key either.
    key = F.when(F.col("_listed"), F.col(key_known)).otherwise(F.col("_k"))
    both = F.coalesce(F.col("_key_matched"), F.lit(False)) & F.coalesce(F.col("_listed"), F.lit(False))
    return joined.select(*[key.alias(c) if c == key_known else F.col(c) for c in listings.columns],
                         *[F.col(out_names[c]) for c in cols], both.alias("_key_matched"))


def merge_report(listings: DataFrame, enriched: DataFrame, key: str, import_cols: Sequence[str]) -> DataFrame:
    """J-6: one row: status, key, original and merged rows, new columns (as they are named in ``enriched``), match
    rate (share of rows whose first new column is non-null, 1 dp) and key match rate (share of rows whose key found a partner)."""
    orig = listings.agg(F.count(F.lit(1)).alias("original_rows"))
    first = import_cols[0] if import_cols else None
    agg = enriched.agg(
        F.count(F.lit(1)).alias("merged_rows"),
        (F.avg(F.col(first).isNotNull().cast("double")) * 100 if first else F.lit(0.0)).alias("match_exact"),
        (F.avg(F.col("_key_matched").cast("double")) * 100).alias("key_match_exact"))
    return orig.crossJoin(agg).select(
        F.lit("success").alias("status"), F.lit(key).alias("join_key"), "original_rows", "merged_rows",
        F.lit(", ".join(import_cols)).alias("new_columns"), "match_exact",
        F.bround("match_exact", 1).alias("match_rate"), "key_match_exact",
        F.bround("key_match_exact", 1).alias("key_match_rate"))


def merge_with_report(listings: DataFrame, new_df: DataFrame, key_new: str, key_known: str,
                      import_cols: Sequence[str], **kw) -> tuple[DataFrame, DataFrame]:
    """J-5 + J-6; a validation failure returns the listings unchanged and an error report row."""
    try:
        enriched = merge_external(listings, new_df, key_new, key_known, import_cols, **kw)
    except MergeError as exc:
        err = listings.sparkSession.createDataFrame([("error", str(exc))], "status string, reason string")
        return listings, err
    new = [c for c in enriched.columns if c not in listings.columns and c != "_key_matched"]
    return enriched.drop("_key_matched"), merge_report(listings, enriched, key_known, new)
