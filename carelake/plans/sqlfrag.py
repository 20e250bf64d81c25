"""DuckDB SQL fragments that mirror the cleaning rules (oracle side only)."""

from __future__ import annotations

from carelake import schema as S


def strip(x: str) -> str:
    chars = S.WHITESPACE.replace("'", "''")
    return f"trim({x}, '{chars}')"


def clean(x: str) -> str:
    tokens = ", ".join(f"'{t}'" for t in S.NULL_TOKENS)
    return f"(CASE WHEN lower({strip(x)}) IN ({tokens}) THEN NULL ELSE {strip(x)} END)"


def null_token(x: str) -> str:
    tokens = ", ".join(f"'{t}'" for t in S.NULL_TOKENS)
    return f"(CASE WHEN lower({strip(x)}) IN ({tokens}) THEN NULL ELSE {x} END)"


def title(x: str) -> str:
    """Upper-case letters that follow a non-letter, lower-case the rest."""
    low = f"lower({x})"
    return (f"array_to_string(list_transform(string_split({low}, ''), lambda ch, i: "
            f"CASE WHEN i = 1 OR NOT regexp_full_match(substr({low}, i - 1, 1), '\\p{{L}}') "
            f"THEN upper(ch) ELSE ch END), '')")


def digits(x: str) -> str:
    return f"nullif(regexp_replace({x}, '\\D', '', 'g'), '')"


def parse_date(x: str) -> str:
    fmts = ["%d/%m/%y", "%d-%m-%Y", "%Y-%m-%d", "%d/%m/%Y", "%Y/%m/%d", "%d.%m.%Y", "%Y.%m.%d",
            "%Y-%m-%d %H:%M:%S", "%d-%m-%Y %H:%M:%S", "%Y%m%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M",
            "%Y-%m-%d %H:%M:%S.%f", "%d %b %Y", "%d-%b-%Y", "%d %B %Y"]
    lst = ", ".join(f"'{f}'" for f in fmts)
    return f"CAST(try_strptime({strip(x)}, [{lst}]) AS DATE)"


def first_word(x: str) -> str:
    return f"nullif(regexp_extract({clean(x)}, '^(\\S+)', 1), '')"


def rest_words(x: str) -> str:
    return f"nullif(regexp_extract({clean(x)}, '(?s)^\\S+\\s+(.*)$', 1), '')"


def gender(x: str) -> str:
    v = f"lower({clean(x)})"
    return (f"(CASE {v} WHEN 'm' THEN 'Male' WHEN 'f' THEN 'Female' WHEN 'o' THEN 'Other' "
            f"ELSE {title(v)} END)")
