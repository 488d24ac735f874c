"""Scopes, conditions and permissions as predicates and semi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PATHS, MAX_PATH = 50, 1024
#: What a manual filter without any condition selects: no document has this id.
NOTHING = -999

# Other spellings of the metadata operators.
OPERATOR_NAMES = {"is": "=", "==": "=", "not is": "≠", "is not": "≠", "!=": "≠", "<>": "≠", ">=": "≥", "<=": "≤"}


def condition(fields: dict) -> Column:
    """Scalars as equality, lists as membership; empty values (None, "", 0, []) are skipped, availability is special."""
    parts = []
    for name, value in fields.items():
        if name == "available_int":
            parts.append(available(F.col(name)) if value else ~available(F.col(name)))
        elif value:
            parts.append(F.col(name).isin(*value) if isinstance(value, list | tuple) else F.col(name) == value)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def available(c: Column) -> Column:
    """Null counts as available."""
    return F.coalesce(c, F.lit(1)) >= 1


def metadata_predicate(value: Column, op: str, operand: str | None = None) -> Column:
    """One metadata comparison on a text value; numbers compare as decimals, missing values match nothing but emptiness."""
    op = OPERATOR_NAMES.get(op, op)
    low = F.lower(value)
    want = (operand or "").lower()
    number, bound = value.try_cast("decimal(20,10)"), F.lit(operand).try_cast("decimal(20,10)")
    tests = {
        "=": low == want,
        "≠": low != want,
        "contains": low.contains(want),
        "not contains": ~low.contains(want),
        "start with": low.startswith(want),
        "end with": low.endswith(want),
        "empty": value.isNull() | (value == ""),
        "not empty": value.isNotNull() & (value != ""),
        ">": number > bound,
        "<": number < bound,
        "≥": number >= bound,
        "≤": number <= bound,
        "before": F.try_to_timestamp(value) < F.lit(operand).cast("timestamp"),
        "after": F.try_to_timestamp(value) > F.lit(operand).cast("timestamp"),
    }
    return F.coalesce(tests[op], F.lit(False))


def metadata_filter(df: DataFrame, json_col: str, filters: list[tuple], logic: str = "and", manual: bool = False) -> DataFrame:
    """Rows whose JSON metadata meet (key, operator, operand) filters, all or any of them."""
    tests = [metadata_predicate(F.get_json_object(json_col, f"$.{key}"), op, *rest) for key, op, *rest in filters]
    if not tests:
        return df.filter(F.lit(not manual))
    return df.filter(reduce((lambda a, b: a & b) if logic == "and" else (lambda a, b: a | b), tests))


def path_scope(df: DataFrame, column: str, paths: list[str] | None) -> DataFrame:
    """Rows at or below the paths; None or "/" is everything, an empty list nothing."""
    if paths is None or "/" in paths:
        return df
    if len(paths) > MAX_PATHS or any(len(p) > MAX_PATH or ".." in p.split("/") for p in paths):
        raise ValueError("bad path scope")
    tests = [(F.col(column) == p.rstrip("/")) | F.col(column).startswith(p.rstrip("/") + "/") for p in paths]
    return df.filter(reduce(lambda a, b: a | b, tests, F.lit(False)))


def compact_paths(paths: DataFrame, column: str) -> DataFrame:
    """Paths that no other path contains: each path looks its own ancestors up, an equi-join."""
    distinct = paths.select(F.regexp_replace(column, "/+$", "").alias("p")).distinct()
    parts = F.split("p", "/")
    above = distinct.select("p", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("up")).filter("up <> p and up <> ''")
    held = above.join(distinct.select(F.col("p").alias("up")), "up", "left_semi").select("p").distinct()
    return distinct.join(held, "p", "left_anti").select(F.col("p").alias(column))


def ancestors(path: Column) -> Column:
    """All folders above a path, outermost first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def like_literal(text: str) -> str:
    """Text with the wildcards of LIKE escaped."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def name_contains(c: Column, text: str) -> Column:
    return c.ilike(f"%{like_literal(text)}%")


def permitted(users: DataFrame, members: DataFrame, grants: DataFrame, admins: DataFrame, permission: str) -> DataFrame:
    """Distinct (user, workspace, via): administrators everywhere, members by role, active grants; write includes read."""
    wanted = ["write"] if permission == "write" else ["read", "write"]
    by_role = members.filter(F.col("role").isin(*wanted)).select("user", "workspace")
    by_grant = grants.filter(F.col("active") & F.col("permission").isin(*wanted)).select("user", "workspace")
    everywhere = users.join(admins, "user", "left_semi").select("user", "workspace")
    return everywhere.union(by_role).union(by_grant).distinct()
