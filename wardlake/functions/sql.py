"""The text rules as SQL, for the checks."""

from __future__ import annotations

from wardlake.functions.scalars import WHITESPACE


def sql_strip(expr: str) -> str:
    return f"trim({expr}, '{WHITESPACE}')"


def sql_clean(expr: str) -> str:
    lines = f"replace(coalesce({expr}, ''), chr(13), chr(10))"
    return sql_strip(f"regexp_replace(regexp_replace({lines}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")
