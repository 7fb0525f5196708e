"""Batch jobs over raw files (S-15, S-16): load, clean, derive features, write Parquet; and refresh what changed.

Each table stays one lazy plan from CSV scan to Parquet write; the only eager step is the sparse-column check of
cleaning (C-7), whose answer decides the output schema.

A run ends by writing a manifest of its inputs (path, length and time of every raw file, and the months that each calendar file holds).
``refresh_processed`` compares it with the files now there. Listings and reviews, whose features depend on all their rows,
are written anew if one of their files changed; of the calendar only the months are rewritten that a new, changed or removed file
holds or held, from the files that hold them, by dynamic partition overwrite. The manifest is replaced last, so a run
that failed is simply repeated.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.operators.cleaning import clean_all
from staylens.operators.features import engineer_all
from staylens.sources.files import SAMPLE_ROWS, load_all, load_calendar, write_processed

TABLES = ("listings", "calendar", "reviews")
MANIFEST = "inputs.json"
NO_DATE = "none"


def process_raw(spark: SparkSession, raw_dir: str, out_dir: str, as_of: dt.date | str,
                recent_years: int | None = 2, sample_calendar: bool = False, sample_reviews: bool = False,
                tables: tuple[str, ...] = TABLES, **qkw) -> dict[str, str]:
    """S-16: raw CSV / GeoJSON in ``raw_dir`` -> cleaned, feature-enriched Parquet in ``out_dir`` (all or some tables)."""
    data = load_all(spark, raw_dir, as_of=as_of, recent_years=recent_years)
    data = {name: df for name, df in data.items() if name in tables}
    data = clean_all(data, sample_calendar=sample_calendar, sample_reviews=sample_reviews, **qkw)
    data = engineer_all(data, as_of, **qkw)
    return write_processed(data, out_dir)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _marks(out_dir: str, table: str) -> list[str]:
    paths = [f"{out_dir}/{table}_processed.parquet"]
    return paths + [f"{out_dir}/listings_sample_{SAMPLE_ROWS}.parquet"] if table == "listings" else paths


def _written(spark: SparkSession, out_dir: str, table: str) -> bool:
    """Whether a table was written to the end: its ``_SUCCESS`` marks are there. Works on any file system Spark reads."""
    found = [_file_system(spark, f"{path}/_SUCCESS") for path in _marks(out_dir, table)]
    return all(fs.exists(path) for fs, path in found)


def processed_exists(spark: SparkSession, out_dir: str, tables=TABLES) -> bool:
    """True when every processed table and the listings sample were written to the end."""
    return all(_written(spark, out_dir, t) for t in tables)


def input_files(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Length and modification time of every data file at ``path`` (a file or a folder), by path."""
    fs, target = _file_system(spark, path)
    if not fs.exists(target):
        return {}
    files, out = fs.listFiles(target, True), {}
    while files.hasNext():
        f = files.next()
        if not f.getPath().getName().startswith(("_", ".")):
            out[f.getPath().toUri().getPath()] = [f.getLen(), f.getModificationTime()]
    return out


def read_manifest(spark: SparkSession, out_dir: str) -> dict:
    fs, path = _file_system(spark, f"{out_dir}/{MANIFEST}")
    if not fs.exists(path):
        return {}
    return json.loads("".join(r.value for r in spark.read.text(str(path), wholetext=True).collect()))


def write_manifest(spark: SparkSession, out_dir: str, manifest: dict) -> None:
    """Written beside its place and then moved there."""
    fs, path = _file_system(spark, f"{out_dir}/{MANIFEST}")
    _, aside = _file_system(spark, f"{out_dir}/.{MANIFEST}-{uuid.uuid4().hex}")
    stream = fs.create(aside, True)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    if fs.exists(path):
        fs.delete(path, False)
    if not fs.rename(aside, path):
        raise OSError(f"could not replace {path}")


def _month(date: F.Column) -> F.Column:
    return F.coalesce(F.date_format(F.to_date(date), "yyyy-MM"), F.lit(NO_DATE))


def _calendar(spark: SparkSession, paths: list[str]) -> DataFrame:
    return load_calendar(spark, paths)


def months_of(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """The months that each calendar file holds: a row per file and month comes back."""
    if not paths:
        return {}
    rows = _calendar(spark, paths).select(F.col("_metadata.file_path").alias("f"), _month(F.col("date")).alias("m")).groupBy("f").agg(
        F.sort_array(F.collect_set("m")).alias("m")).collect()
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    found = {jpath(jpath(r.f).toUri()).toUri().getPath(): list(r.m) for r in rows}
    return {p: found.get(p, []) for p in paths}


def _snapshot(spark: SparkSession, raw_dir: str, as_of) -> dict:
    return {"as_of": str(as_of), "files": {t: input_files(spark, f"{raw_dir}/{t}.csv") for t in TABLES}}


def _rewrite_months(spark: SparkSession, out_dir: str, paths: list[str], months: list[str]) -> None:
    """Replace the partitions of these months by what the given files hold of them."""
    target = f"{out_dir}/calendar_processed.parquet"
    if paths:
        rows = _calendar(spark, paths).where(_month(F.col("date")).isin(months))
        cleaned = engineer_all(clean_all({"calendar": rows}), dt.date(1970, 1, 1))["calendar"]
        left = {r.m for r in rows.select(_month(F.col("date")).alias("m")).distinct().collect()}
        cleaned.hint("rebalance", "year", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "year", "month").parquet(target)
    else:
        left = set()
    # A month without rows leaves nothing to overwrite it with.
    for month in set(months) - left:
        year, number = ("__HIVE_DEFAULT_PARTITION__",) * 2 if month == NO_DATE else (int(month[:4]), int(month[5:]))
        fs, path = _file_system(spark, f"{target}/year={year}/month={number}")
        if fs.exists(path):
            fs.delete(path, True)


def refresh_processed(spark: SparkSession, raw_dir: str, out_dir: str, as_of: dt.date | str, **kw) -> dict[str, list[str]]:
    """S-15 / S-16: bring the processed tables up to date with the raw files. Returns what was written: table -> months for the
    calendar (all of them after a full write), an empty list for the others."""
    old, new = read_manifest(spark, out_dir), _snapshot(spark, raw_dir, as_of)
    before, now = old.get("files", {}), new["files"]
    done: dict[str, list[str]] = {}
    whole = [t for t in TABLES if not _written(spark, out_dir, t) or t not in before]
    whole += [t for t in ("listings", "reviews") if t not in whole and (before[t] != now[t] or old["as_of"] != new["as_of"])]
    # Samples are drawn from all rows, so a sampled calendar has no months of its own.
    if kw.get("sample_calendar") and "calendar" not in whole and before["calendar"] != now["calendar"]:
        whole.append("calendar")
    if whole:
        process_raw(spark, raw_dir, out_dir, as_of, tables=tuple(whole), **kw)
        done |= {t: [] for t in whole}
    if "calendar" in whole:
        new["months"] = months_of(spark, sorted(now["calendar"]))
        done["calendar"] = sorted({m for ms in new["months"].values() for m in ms})
    else:
        was, files = old["months"], now["calendar"]
        changed = [p for p in files if before["calendar"].get(p) != files[p]]
        gone = [p for p in before["calendar"] if p not in files]
        new["months"] = {p: was[p] for p in files if p not in changed} | months_of(spark, sorted(changed))
        touched = sorted({m for p in changed for m in new["months"][p]} | {m for p in (*changed, *gone) for m in was.get(p, [])})
        if touched:
            _rewrite_months(spark, out_dir, sorted(p for p in files if set(new["months"][p]) & set(touched)), touched)
            done["calendar"] = touched
    if done:
        write_manifest(spark, out_dir, new)
    return done


def ensure_processed(spark: SparkSession, raw_dir: str, out_dir: str, as_of: dt.date | str, **kw) -> bool:
    """S-15: write what is missing or out of date; returns True when anything was. A run that failed midway leaves a
    table without its mark or the old manifest, so the next call writes that part anew."""
    return bool(refresh_processed(spark, raw_dir, out_dir, as_of, **kw))
