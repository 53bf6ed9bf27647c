"""Registration of a query beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import small_batches


def registry() -> tuple[dict, dict, Callable]:
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    twins: dict[str, str] = {}

    def query(sql: str | None = None, name: str | None = None):
        def add(f):
            queries[name or f.__name__] = f
            if sql is not None:
                twins[name or f.__name__] = sql
            return f

        return add

    return queries, twins, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL fragments that mirror the column functions.
def sql_collapse(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '[\s\p{{Z}}]+', ' ', 'g'))"


def sql_fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def sql_normal(x: str) -> str:
    bare = rf"regexp_replace(nfc_normalize(coalesce({x}, '')), '[\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2060}}\x{{fe0e}}\x{{fe0f}}\x{{feff}}]', '', 'g')"
    spaced = rf"regexp_replace({bare}, '[\s\p{{Z}}\x0b]', ' ', 'g')"
    return sql_collapse(rf"regexp_replace({spaced}, '\p{{Cc}}', '', 'g')")


def sql_canonical(x: str) -> str:
    return sql_fold(sql_normal(x))


def sql_compact(x: str) -> str:
    return rf"regexp_replace({sql_canonical(x)}, '[^\p{{L}}\p{{N}}]', '', 'g')"


def sql_key(x: str) -> str:
    return sql_fold(sql_collapse(f"nfc_normalize(coalesce({x}, ''))"))


def sql_alpha(x: str) -> str:
    return rf"regexp_extract_all({sql_fold(f"coalesce({x}, '')")}, '[\p{{L}}\p{{M}}]+(?:[-’''][\p{{L}}\p{{M}}]+)*')"


def sql_usable(x: str) -> str:
    bare = rf"trim(regexp_replace(coalesce({x}, ''), '(?i)(?:https?://|www\.)\S+', '', 'g'))"
    return rf"length({bare}) >= 8 AND length(regexp_replace({bare}, '\P{{L}}', '', 'g')) >= 5 AND len(regexp_extract_all({bare}, '\S+')) >= 2"
