"""Where queries register, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import KEYED, MASK, SECRETS
from ..sources import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DAY = 86_400_000
NOW = 1_706_745_600_000  # 2024-02-01 UTC, a fixed "now"


def query(sql: str | None = None):
    """Registers a function under its name; SQL that starts with ! stands without the base views."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = f"with {V.SQL_VIEWS} {sql}" if sql.lstrip()[0] != "!" else sql.lstrip()[1:]
        return function

    return register


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def word_sql(words: list[str], column: str = "text") -> str:
    return f"regexp_matches({column}, '(^|[^0-9A-Za-z_])(?i:{'|'.join(words)})([^0-9A-Za-z_]|$)')"


def redact_sql(column: str) -> str:
    """The fixed patterns one after the other."""
    for pattern in SECRETS:
        column = f"regexp_replace({column}, {quoted(pattern)}, '{MASK}', 'g')"
    for pattern in KEYED:
        column = f"regexp_replace({column}, {quoted(pattern)}, '\\1{MASK}', 'g')"
    return column
