"""Query registry: name -> (Spark callable, DuckDB oracle SQL or None).

Each callable takes (spark, sf_dir) and returns a DataFrame over the whole role tables. The oracle SQL runs on the
same parquet tables registered as views; computed doubles are rounded to 4 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from staylens.sources.roles import with_roles

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    headline: bool = False


REGISTRY: dict[str, Query] = {}


def expand_round4(sql: str) -> str:
    """Rewrite every ``round(expr, 4)`` into ``(floor((expr) * 10000 + 0.5) / 10000)``, the half-up formula the
    Spark side uses (``semantics.r4``), so both engines round identical doubles to identical doubles."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while True:
            ch = sql[k]
            depth += ch == "("
            depth -= ch == ")"
            if depth == 0:
                break
            k += 1
        inner = sql[j + 6:k]
        head, _, tail = inner.rpartition(",")
        if tail.strip() == "4" and head:
            out.append(sql[i:j])
            out.append(f"(floor(CAST(({expand_round4(head)}) AS DOUBLE) * 10000 + 0.5) / 10000)")
        else:
            out.append(sql[i:j + 6])
            out.append(expand_round4(inner))
            out.append(")")
        i = k + 1


def register(name: str, sql: str | None = None, roles: tuple[str, ...] = (), headline: bool = False):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        full = with_roles(sql, *roles) if (sql and roles) else sql
        full = expand_round4(full) if full else full
        REGISTRY[name] = Query(name, fn, full, headline)
        return fn

    return deco


def load_all() -> dict[str, Query]:
    """Import every catalog module (registration happens at import)."""
    from staylens.plans import catalog  # noqa: F401

    return REGISTRY
