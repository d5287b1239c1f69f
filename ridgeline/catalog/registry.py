"""Registry of queries and of the SQL that must give the same rows.

A query is registered with a column list: ``name`` passes as is, ``name:i``
is a 64-bit integer, ``name*`` a double rounded to six places.  Both engines
get the same casts, so results compare by value.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline import fixtures
from ridgeline.session import importable_in_tasks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, tuple] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    name: ((), fixtures.shape_sql(name)) for name in fixtures.PROJECTIONS}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (needs, f"{name} AS ({sql})")


def _ordered(names, seen=None):
    seen = [] if seen is None else seen
    for n in names:
        if n not in seen:
            _ordered(CTES[n][0], seen)
            if n not in seen:
                seen.append(n)
    return seen


def _columns(spec: str):
    for item in spec.split():
        if item.endswith("*"):
            yield item[:-1], "double"
        elif item.endswith(":i"):
            yield item[:-2], "int"
        else:
            yield item, "plain"


def shaped(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _columns(spec):
        c = F.col(name)
        if kind == "double":
            c = F.round(c.cast("double"), 6)
        elif kind == "int":
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)


def _shaped_sql(body: str, spec: str) -> str:
    out = []
    for name, kind in _columns(spec):
        c = f'"{name}"'
        if kind == "double":
            c = f'round(CAST({c} AS DOUBLE), 6) + 0e0'
        elif kind == "int":
            c = f"CAST({c} AS BIGINT)"
        out.append(f'{c} AS "{name}"')
    return f"SELECT {', '.join(out)} FROM ({body}) AS result"


def query(spec: str, sql: str | None = None, needs=()):
    """Register ``fn(spark, sf_dir)`` under its name, with its SQL if it has one."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable_in_tasks(spark)
            return shaped(fn(spark, sf_dir), spec)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = (spec, sql, tuple(needs))
        return fn
    return register


def oracle_sql() -> dict[str, str]:
    """Full statement per query: the expressions it needs, then its body."""
    out = {}
    for name, (spec, sql, needs) in ORACLES.items():
        parts = [CTES[n][1] for n in _ordered(needs)]
        out[name] = (f"WITH {', '.join(parts)} " if parts else "") + _shaped_sql(sql, spec)
    return out


# ------------------------------------------------------------- SQL fragments
def hav(lat1, lon1, lat2, lon2) -> str:
    return (f"(12742000e0 * atan2(sqrt(pow(sin(radians({lat2} - {lat1}) / 2e0), 2) + cos(radians({lat1})) * "
            f"cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2e0), 2)), "
            f"sqrt(1e0 - (pow(sin(radians({lat2} - {lat1}) / 2e0), 2) + cos(radians({lat1})) * "
            f"cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2e0), 2)))))")


def planar(lat1, lon1, lat2, lon2) -> str:
    return (f"sqrt(pow(({lat2} - {lat1}) * 111000e0, 2) + "
            f"pow(({lon2} - {lon1}) * 111000e0 * cos(radians({lat1})), 2))")


def mod360(x) -> str:
    return f"(CASE WHEN ({x}) % 360e0 < 0 THEN ({x}) % 360e0 + 360e0 ELSE ({x}) % 360e0 END)"


def band(x, edges, results, above) -> str:
    whens = " ".join(f"WHEN {x} < {e} THEN {r}" for e, r in zip(edges, results))
    return f"(CASE {whens} ELSE {above} END)"


def clip(x) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest(0e0, least(1e0, {x})) END)"


def angle_score(diff) -> str:
    d = mod360(f"abs({diff})")
    return f"(CASE WHEN {d} < 45 OR {d} >= 315 THEN 1e0 WHEN {d} >= 135 AND {d} < 225 THEN 0e0 ELSE 5e-1 END)"


def label(score) -> str:
    return f"(CASE WHEN round({score}, 9) >= 8e-1 THEN 0 WHEN round({score}, 9) >= 55e-2 THEN 1 ELSE 2 END)"
