"""Field similarities as columns: native where Spark has the parts, Arrow UDFs for the string kernels."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions import batch, kernels
from concord.functions.text import col, digits, present
from concord.settings import ADDRESS_STOPS, DEFAULT


def _udf(kernel: Callable[[str, str], float], strip: bool) -> Callable:
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        clean = (lambda s: s.upper().strip()) if strip else (lambda s: s)
        # equal pairs of strings of a batch are scored once
        once = cache(lambda x, y: kernel(clean(x), clean(y)) if x and y else None)
        return pd.Series([once(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


name_jw = _udf(kernels.jaro_winkler, True)
name_tsr = _udf(kernels.token_sort_ratio, False)
name_pho = _udf(kernels.phonetic, False)
name_abr = _udf(kernels.abbreviation, False)
name_ngr = _udf(kernels.trigram_cosine, False)
addr_cmp = _udf(kernels.address_components, False)
addr_nrm = _udf(kernels.address_postal, False)


_ROUTED = T.StructType([T.StructField(f"{f}_{k}", t) for f in ("name", "addr") for k, t in (("score", T.DoubleType()), ("strategy", T.StringType()), ("selected", T.ArrayType(T.StringType())))])


def _where_both(a: pd.Series, b: pd.Series, many: Callable[[list, list], list]) -> tuple[list[int], list]:
    """The places where both values are there, and ``many`` of them."""
    x, y = a.tolist(), b.tolist()
    at = [i for i, (s, t) in enumerate(zip(x, y, strict=True)) if s and t]
    return at, many([x[i] for i in at], [y[i] for i in at])


@F.pandas_udf(_ROUTED)
def routed(name_a: pd.Series, name_b: pd.Series, addr_a: pd.Series, addr_b: pd.Series) -> pd.DataFrame:
    out = {}
    for kind, found in (("name", _where_both(name_a, name_b, batch.route_names)), ("addr", _where_both(addr_a, addr_b, batch.route_addresses))):
        score, strategy, selected = [None] * len(name_a), [None] * len(name_a), [()] * len(name_a)
        for i, row in zip(*found, strict=True):
            score[i], strategy[i], selected[i] = row
        out |= {f"{kind}_score": pd.Series(score, dtype="float64"), f"{kind}_strategy": pd.Series(strategy, dtype="object"), f"{kind}_selected": pd.Series(selected, dtype="object")}
    return pd.DataFrame(out)


@F.pandas_udf(T.StructType([T.StructField("name_score", T.DoubleType()), T.StructField("addr_score", T.DoubleType())]))
def routed_scores(name_a: pd.Series, name_b: pd.Series, addr_a: pd.Series, addr_b: pd.Series) -> pd.DataFrame:
    """The scores of ``routed`` alone."""
    out = {}
    for kind, (at, rows) in (("name", _where_both(name_a, name_b, batch.route_names)), ("addr", _where_both(addr_a, addr_b, batch.route_addresses))):
        score = np.full(len(name_a), np.nan)
        score[at] = [r[0] for r in rows]
        out[f"{kind}_score"] = score
    return pd.DataFrame(out)


def both(a: str | Column, b: str | Column, score: Column) -> Column:
    """``score`` where both values are there, else null."""
    return F.when(present(a) & present(b), score)


def _address_tokens(c: str | Column) -> Column:
    words = F.transform(F.filter(F.split(F.upper(F.trim(col(c))), r"\s+"), lambda t: t != ""), lambda t: F.rtrim(t, F.lit(".,")))
    return F.array_distinct(F.array_except(words, F.array(*map(F.lit, ADDRESS_STOPS))))


def addr_jac(a: str | Column, b: str | Column) -> Column:
    x, y = _address_tokens(a), _address_tokens(b)
    union = F.size(F.array_union(x, y))
    return both(a, b, F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0)))


def addr_zip(a: str | Column, b: str | Column, zip_a: str | Column, zip_b: str | Column) -> Column:
    z = F.when(col(zip_a) == col(zip_b), 1.0).when(F.left(col(zip_a), F.lit(3)) == F.left(col(zip_b), F.lit(3)), 0.5).otherwise(0.0)
    return both(zip_a, zip_b, 0.5 * z + 0.5 * F.coalesce(addr_jac(a, b), F.lit(0.0)))


def phone_e164(a: str | Column, b: str | Column) -> Column:
    x, y = digits(a), digits(b)
    both10 = (F.length(x) >= 10) & (F.length(y) >= 10)
    both7 = (F.length(x) >= 7) & (F.length(y) >= 7)
    score = F.when(both10, F.right(x, F.lit(10)) == F.right(y, F.lit(10))).when(both7, F.right(x, F.lit(7)) == F.right(y, F.lit(7))).otherwise(F.lit(False))
    return both(a, b, score.cast("double"))


def phone_l7(a: str | Column, b: str | Column) -> Column:
    return both(a, b, digits_l7(digits(a), digits(b)))


def digits_l7(x: Column, y: Column) -> Column:
    """``phone_l7`` of phones that are digits already."""
    return ((F.length(x) >= 7) & (F.length(y) >= 7) & (F.right(x, F.lit(7)) == F.right(y, F.lit(7)))).cast("double")


def phone_ac(a: str | Column, b: str | Column) -> Column:
    x, y = (F.right(digits(c), F.lit(10)) for c in (a, b))
    area = (F.length(x) >= 10) & (F.length(y) >= 10) & (F.left(x, F.lit(3)) == F.left(y, F.lit(3)))
    return both(a, b, F.when(area & (F.right(x, F.lit(4)) == F.right(y, F.lit(4))), 0.8).when(area, 0.3).otherwise(0.0))


def tin_exact(a: str | Column, b: str | Column) -> Column:
    x, y = digits(a), digits(b)
    return both(a, b, ((x != "") & (x == y)).cast("double"))


def _differing(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: (p != q).cast("int")), F.lit(0), lambda n, v: n + v)


def tin_trans(a: str | Column, b: str | Column) -> Column:
    x, y = digits(a), digits(b)
    return both(a, b, F.when((x != "") & (y != ""), digits_trans(x, y)))


def digits_trans(x: Column, y: Column) -> Column:
    """``tin_trans`` of ids that are digits already."""
    d = _differing(x, y)
    return F.when(x == y, 1.0).when(F.length(x) != F.length(y), 0.0).when(d <= 1, 0.9).when(d == 2, 0.7).otherwise(0.0)


def tin_pfx(a: str | Column, b: str | Column) -> Column:
    x, y = digits(a), digits(b)
    tail = F.aggregate(
        F.zip_with(F.split(F.substr(x, F.lit(3)), ""), F.split(F.substr(y, F.lit(3)), ""), lambda p, q: F.coalesce((p == q).cast("int"), F.lit(0))), F.lit(0), lambda n, v: n + v
    )
    score = F.when(F.left(x, F.lit(2)) != F.left(y, F.lit(2)), 0.0).when(tail >= 5, 0.6).otherwise(0.3)
    return both(a, b, F.when((F.length(x) >= 5) & (F.length(y) >= 5), score))


def cms_exact(a: str | Column, b: str | Column) -> Column:
    return both(a, b, (F.upper(F.trim(col(a))) == F.upper(F.trim(col(b)))).cast("double"))


def cms_pfx(a: str | Column, b: str | Column) -> Column:
    x, y = F.upper(F.trim(col(a))), F.upper(F.trim(col(b)))
    return both(a, b, F.when((F.length(x) >= 5) & (F.length(y) >= 5) & (F.left(x, F.lit(5)) == F.left(y, F.lit(5))), 0.85).otherwise(0.0))


def composite(scores: dict[str, Column], weights: dict[str, float] = DEFAULT.weights) -> Column:
    """Weighted mean over the fields that have a score, rounded to four digits; null without any."""
    total = sum((F.when(s.isNotNull(), F.lit(weights[k])).otherwise(0.0) for k, s in scores.items()), F.lit(0.0))
    value = sum((F.coalesce(s * weights[k], F.lit(0.0)) for k, s in scores.items()), F.lit(0.0))
    return F.when(total > 0, F.round(value / total, 4))
