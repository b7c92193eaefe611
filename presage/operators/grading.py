"""A place for an outside grader of texts, with keyword rules as the one at hand."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presage.functions.text import keyword_signals
from presage.operators.lift import mode


def by_keywords(docs: DataFrame, text: str) -> DataFrame:
    """docs with a column for each keyword signal."""
    return docs.select("*", *[c.alias(k) for k, c in keyword_signals(F.col(text)).items()])


def graded(docs: DataFrame, grader: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """docs passed batch by batch through an outside grader (a service client, a model)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from (grader(b) for b in batches)

    return docs.mapInPandas(run, schema)


def modal(runs: DataFrame, keys: list[str], field: str, run: str) -> DataFrame:
    """The grade that most runs gave; of equals, the one given first."""
    return mode(runs, keys, field, run)
