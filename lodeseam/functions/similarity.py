"""Likeness of two chunks, as columns."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def set_ratio(matched: Column, of: Column) -> Column:
    """Share of a set (an array of distinct values) that is matched; 0 of an empty one."""
    return F.when(F.size(of) > 0, F.size(matched) / F.size(of)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def counter_jaccard(a: Column, b: Column) -> Column:
    """Sum of the lesser counts by that of the greater ones, of two maps to counts; 0 if both are empty."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    count = lambda m, k: F.coalesce(F.element_at(m, k), F.lit(0))
    total = lambda pick: F.aggregate(keys, F.lit(0).cast("long"), lambda t, k: t + pick(count(a, k), count(b, k)).cast("long"))
    return F.when(F.size(keys) > 0, total(F.least) / total(F.greatest)).otherwise(0.0)


def structure(a_type: Column, b_type: Column, shape: Column, a_arity: Column, b_arity: Column, a_calls: Column, b_calls: Column) -> Column:
    """Likeness of two signatures: type, shape (a number from 0 to 1), arity and calls."""
    kin = ("function", "method")
    kind = F.when(a_type == b_type, 1.0).when(a_type.isin(*kin) & b_type.isin(*kin), 0.5).otherwise(0.0)
    near = lambda x, y: 1 - F.abs(x - y) / F.greatest(x, y, F.lit(1))
    arity = F.when(a_arity.isNull() | b_arity.isNull(), 0.5).otherwise(near(a_arity, b_arity))
    return 0.45 * kind + 0.30 * shape + 0.15 * arity + 0.10 * near(a_calls, b_calls)


def git_likeness(same_repository: Column, adjacent: Column, renamed: Column, same_path: Column) -> Column:
    """What the commits say: renames between parent and child count most, then the same path."""
    return (
        F.when(~same_repository, 0.0)
        .when(adjacent, F.when(renamed, 1.0).when(same_path, 0.75).otherwise(0.25))
        .otherwise(F.when(same_path, 0.4).otherwise(0.0))
    )


def change_label(a_code: Column, b_code: Column, same_symbol: Column, same_path: Column) -> Column:
    """What became of a chunk: equal code comes first, even if it moved."""
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.when(bare(a_code) == bare(b_code), "likely_unchanged").when(~same_symbol | ~same_path, "likely_renamed_or_moved").otherwise("likely_modified")


def unit_cosine(dot: Column) -> Column:
    """Cosine mapped from [-1, 1] to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot + 1) / 2))


@F.pandas_udf(T.DoubleType())
def path_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two paths in lower case; the order of the arguments matters."""
    plain = lambda p: (p or "").casefold().replace("\\", "/")
    memo: dict[tuple[str, str], float] = {}

    def ratio(x, y):
        key = (plain(x), plain(y))
        if key not in memo:
            memo[key] = SequenceMatcher(None, *key).ratio()
        return memo[key]

    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")
