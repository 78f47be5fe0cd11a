"""Shape checks of untrusted JSON in variant columns: each gives a problem or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL")


def json_value(column: str) -> Column:
    """The text as a variant; null where it is not JSON."""
    return F.try_parse_json(F.col(column))


def kind_of(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def has_kind(v: Column, path: str, *kinds: str) -> Column:
    found = kind_of(v, path)
    out = F.lit(False)
    for k in kinds:
        out = out | found.startswith(k)
    return F.coalesce(out, F.lit(False))


def present(v: Column, path: str) -> Column:
    return kind_of(v, path).isNotNull()


def blank(v: Column, name: str) -> Column:
    """A required text that is missing or empty."""
    path = f"$.{name}"
    return F.when(~has_kind(v, path, "STRING") | (F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")) == ""), f"{name} is missing or blank")


def no_text(v: Column, name: str, optional: bool = True, nullable: bool = False) -> Column:
    path = f"$.{name}"
    ok = has_kind(v, path, "STRING", *(["VOID"] if nullable else []))
    return F.when(~(ok | ~present(v, path)) if optional else ~ok, f"{name} is no text")


def no_number(v: Column, name: str, optional: bool = False) -> Column:
    path = f"$.{name}"
    ok = has_kind(v, path, *NUMBER)
    return F.when(~(ok | ~present(v, path)) if optional else ~ok, f"{name} is no number")


def no_object(v: Column, name: str) -> Column:
    return F.when(~has_kind(v, f"$.{name}", "OBJECT"), f"{name} is no object")


def no_flag(v: Column, name: str, optional: bool = False) -> Column:
    path = f"$.{name}"
    ok = has_kind(v, path, "BOOLEAN")
    return F.when(~(ok | ~present(v, path)) if optional else ~ok, f"{name} is no boolean")


def no_time(v: Column, name: str) -> Column:
    path = f"$.{name}"
    return F.when(~has_kind(v, path, "STRING") | F.try_variant_get(v, path, "string").try_cast("timestamp").isNull(), f"{name} is no time")


def one_of(v: Column, name: str, values: tuple[str, ...]) -> Column:
    path = f"$.{name}"
    return F.when(~has_kind(v, path, "STRING") | ~F.coalesce(F.try_variant_get(v, path, "string").isin(*values), F.lit(False)), f"{name} is unknown")


def not_an_object(v: Column) -> Column:
    return F.when(v.isNull(), "not JSON").when(~F.schema_of_variant(v).startswith("OBJECT"), "not an object")


def whole_or_nothing(rows: DataFrame, problem: str = "problem") -> DataFrame:
    """All rows if none has a problem, else none: a broken file is never half believed."""
    bad = rows.where(F.col(problem).isNotNull()).limit(1).select(F.lit(True).alias("_bad"))
    return rows.join(F.broadcast(bad), F.lit(True), "left_anti")  # one row at most on the right
