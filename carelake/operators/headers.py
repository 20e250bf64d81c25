"""Header / schema shaping of raw extracts (H-01..H-05).

Header names are metadata, so they are computed on the driver; the data is
only re-projected (no job is run).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake import schema as S
from carelake.functions.expr import null_if_token


def canonical_names(names, aliases: dict[str, str] | None = None) -> dict[str, str]:
    """Raw header -> canonical column, for all headers of a sheet."""
    spelled = lambda text: "_".join(re.split(r"[\s_]+", text.strip().lower()))
    table = {spelled(k): v for k, v in (aliases or S.COLUMN_ALIASES).items()}
    return {name: table.get(spelled(name), spelled(name)) for name in names}


def normalize_headers(df: DataFrame, aliases: dict[str, str] | None = None,
                      keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Rename columns to canonical names. Of columns that map to one name the first value
    that is no placeholder counts, left to right."""
    names = canonical_names([c for c in df.columns if c not in keep], aliases)
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(names.get(c, c), []).append(c)
    text = {c for c, t in df.dtypes if t == "string"}
    quoted = lambda c: F.col(f"`{c}`")
    given = lambda c: null_if_token(quoted(c)) if c in text else quoted(c)
    return df.select(*[
        (quoted(cs[0]) if len(cs) == 1 else F.coalesce(*[given(c) for c in cs])).alias(name)
        for name, cs in groups.items()])


def inject_missing(df: DataFrame, columns, dtype: str = "string") -> DataFrame:
    missing = {c: F.lit(None).cast(dtype) for c in columns if c not in df.columns}
    return df.withColumns(missing) if missing else df


def require_columns(df: DataFrame, columns, what: str = "input") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns in {what}: {missing}")


def unknown_columns(df: DataFrame, expected=None, keep: tuple[str, ...] = ("row_id",)) -> list[str]:
    expected = set(expected or S.EXPECTED_PATIENT_COLUMNS)
    return [c for c in df.columns if c not in expected and c not in keep]
