"""Arrow UDFs over the string kernels: one crossing to Python for all scores of a pair."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels, near

SCORES = {
    "tset": kernels.token_set_ratio,
    "tsort": kernels.token_sort_ratio,
    "part": kernels.partial_ratio,
    "ratio": kernels.ratio,
    "wr": kernels.weighted_ratio,
}


def similarity(a: Column, b: Column, *names: str, scorers=None) -> Column:
    """struct of the named scores of two texts, from 0 to 1; also "jw", "soft_min" and "soft_max". Nulls count as empty.

    ``scorers`` replaces or adds scorers by name (callables on two strings, in percent).
    """
    known = SCORES | (scorers or {})

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows, seen = [], {}
        for p, q in zip(x.fillna(""), y.fillna(""), strict=True):
            got = seen.get((p, q))
            if got is None:
                soft = kernels.soft_token_similarity(p, q) if "soft_min" in names or "soft_max" in names else (None, None)
                own = {"soft_min": soft[0], "soft_max": soft[1]}
                got = seen[p, q] = [own[n] if n in own else kernels.jaro_winkler(p, q) if n == "jw" else known[n](p, q) / 100 for n in names]
            rows.append(got)
        return pd.DataFrame(rows, columns=list(names), dtype=float)

    return run(a, b)


@F.pandas_udf(T.StringType())
def to_latin(x: pd.Series) -> pd.Series:
    """Romanise every script."""
    return x.map(kernels.to_latin)


@F.pandas_udf(T.DoubleType())
def best_trade_name(x: pd.Series, y: pd.Series) -> pd.Series:
    """The best token-set score of any two trade names, if either side has several; else null."""
    out = []
    for p, q in zip(x, y, strict=True):
        scores = [kernels.token_set_ratio(s, t) / 100 for s in p for t in q if s and t] if len(p) > 1 or len(q) > 1 else []
        out.append(max(scores, default=None))
    return pd.Series(out, dtype=float)


NEAREST = "form string, other string, first string, score double"


def nearest_in_cell(most: int):
    """Of a table of forms (form) and one of others (other, first) each form's ``most`` most similar by ratio among those that share
    a 3-gram, ties to the smaller ``first``: what ``applyInArrow`` takes, with the columns of ``NEAREST``."""

    def run(forms: pa.Table, others: pa.Table) -> pa.Table:
        words = forms.column("form").to_pylist()
        known = sorted(zip(others.column("first").to_pylist(), others.column("other").to_pylist(), strict=True), key=lambda x: x[0].encode())  # as Spark sorts
        f, o, score = near.Others([x[1] for x in known]).nearest(words, most)
        take = lambda values, at: pa.array(values, pa.string()).take(pa.array(at))
        return pa.table({"form": take(words, f), "other": take([x[1] for x in known], o), "first": take([x[0] for x in known], o), "score": score})

    return run
