"""Many small groups in one call of Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_groups(rows: DataFrame, keys: list[str], function: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """function(rows, bounds) -> rows of the schema: whole groups by keys, group i being the rows from bounds[i] up to bounds[i + 1].

    A call takes the groups that end in one batch of rows, so small groups cost
    little more than their rows, and a task holds a batch and one group. Groups
    are told by two 64-bit hashes of their keys.
    """
    dealt = rows.withColumns({"__g": F.xxhash64(*keys), "__h": F.xxhash64(F.lit(1), *keys[::-1])})
    dealt = dealt.repartition("__g", "__h").sortWithinPartitions("__g", "__h")

    def called(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: list[pd.DataFrame] = []

        def whole() -> pd.DataFrame:
            x = (pd.concat(open_, ignore_index=True) if len(open_) > 1 else open_[0]).reset_index(drop=True)
            return function(x.drop(columns=["__g", "__h"]), np.concatenate([[0], changes(x), [len(x)]]))

        for batch in batches:
            if not len(batch):
                continue
            if open_ and (batch[["__g", "__h"]].iloc[0] != open_[-1][["__g", "__h"]].iloc[0]).any():
                yield whole()
                open_ = []
            at = changes(batch)
            if len(at):
                open_.append(batch.iloc[: at[-1]])
                yield whole()
                open_ = [batch.iloc[at[-1] :]]
            else:
                open_.append(batch)
        if open_:
            yield whole()

    def changes(x: pd.DataFrame) -> np.ndarray:
        g, h = x["__g"].to_numpy(), x["__h"].to_numpy()
        return np.flatnonzero((g[1:] != g[:-1]) | (h[1:] != h[:-1])) + 1

    return dealt.mapInPandas(called, schema)
