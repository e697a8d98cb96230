"""Extension points: user functions over texts and bytes, run in batches in the workers.

A hook is a module-level function named by "module:function", so that it is imported in the worker and not pickled; it gets a list of
values and gives a list of as many results. A failing value does not fail the job if the hook is told to keep errors: its result is
null and its error's class stands beside it.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import prepare_workers, worker


def find(name: str) -> Callable[[list], list]:
    """The function that "module:function" names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def hook_batches(batches: Iterator[pd.DataFrame], name: str, value: str, to: str, keep_errors: bool) -> Iterator[pd.DataFrame]:
    """For mapInPandas: the batch with the hook's results in to and, if errors are kept, their classes in <to>_error."""
    f = find(name)
    for b in batches:
        values = b[value].tolist()
        if not keep_errors:
            yield b.assign(**{to: f(values)})
            continue
        try:
            results, errors = f(values), [None] * len(values)
        except Exception:  # one of them fails: each alone
            results, errors = [], []
            for v in values:
                try:
                    results += f([v])
                    errors.append(None)
                except Exception as e:
                    results.append(None)
                    errors.append(type(e).__name__)
        yield b.assign(**{to: results, f"{to}_error": errors})


def apply(df: DataFrame, name: str, value: str, to: str, kind: str, keep_errors: bool = False) -> DataFrame:
    """df with the results of a hook (of SQL type kind) over a column: parsers, detectors, embedding or answer providers."""
    prepare_workers(df.sparkSession)
    df = df.drop(to, f"{to}_error")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    more = f", `{to}` {kind}" + (f", `{to}_error` string" if keep_errors else "")
    return df.mapInPandas(worker(__name__, "hook_batches", name, value, to, keep_errors), fields + more)


def pending(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of df that done lacks: what an incremental run of a hook still has to do."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def backoff_seconds(attempt: Column, base: float, most: float, jitter: float = 0.0, u: Column | None = None) -> Column:
    """min(most, base * 2**(attempt - 1)) for attempts from 1, times 1 - jitter to 1 + jitter as u goes from 0 to 1."""
    wait = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(1000))))
    return wait if u is None else wait * (1 + F.lit(jitter) * (2 * u - 1))


def sum_or_null(c: Column) -> Column:
    """The sum, or null if any value is unknown: an unknown is not zero."""
    return F.when(F.count(F.lit(1)) == F.count(c), F.sum(c))
