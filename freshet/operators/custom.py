"""Functions of the caller, applied site by site."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .series import K


def declared(schema: str, key_field: str) -> StructType:
    """The result's fields, the key among them."""
    fields = StructType.fromDDL(schema)
    if key_field not in fields.names:
        raise ValueError(f"the schema must declare the key {key_field}")
    return fields


def checked(names: list[str], wanted: list[str], site: Any) -> None:
    if sorted(names) != sorted(wanted):
        raise ValueError(f"site {site}: the function gave {sorted(names)}, declared are {sorted(wanted)}")


def per_site(rows: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: str = "date", key: str = K) -> DataFrame:
    """function(frame) of each site's rows in order; schema: the result's columns, the key among them.

    A site's rows are held in one task: for what needs them all at once. Columns other than the declared ones, or missing
    ones, stop the job with the site's name. NULL keys are one site.
    """
    names = declared(schema, key).names

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = function(frame.sort_values(order, kind="stable").reset_index(drop=True))
        checked(list(out.columns), names, frame[key].iloc[0])
        return out[names]

    return rows.groupBy(key).applyInPandas(run, schema)


def fold_sites(rows: DataFrame, columns: list[str], start: Callable[[], Any], step: Callable[[Any, dict[str, np.ndarray]], Any], finish: Callable[[Any], dict[str, Any]], schema: str, order: str = "date", key: str = K) -> DataFrame:
    """A fold over each site's rows in order: state = start(), then state = step(state, columns of the next rows), at last
    finish(state) gives one row (without the key). schema: the result's columns, the key among them.

    Rows come in pieces of arrays, cut at any place, so a site of any length is never held whole: only its state is. NULLs
    of number columns come as NaN. Sites with rows have one row each; NULL keys are one site.
    """
    fields = declared(schema, key)
    arrow = to_arrow_schema(fields)
    names = [n for n in fields.names if n != key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        site, state, begun, done = None, None, False, []

        def closed() -> None:
            result = finish(state)
            checked(list(result), names, site)
            done.append({key: site, **result})

        for batch in batches:
            keys = batch.column(0).to_pylist()
            values = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if begun and keys[a] != site:
                    closed()
                    begun = False
                if not begun:
                    site, state, begun = keys[a], start(), True
                state = step(state, {c: v[a:b] for c, v in values.items()})
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, arrow)
                done.clear()
        if begun:
            closed()
        if done:
            yield pa.RecordBatch.from_pylist(done, arrow)

    dealt = rows.select(key, *dict.fromkeys([order, *columns])).repartition(key).sortWithinPartitions(key, order)
    return dealt.mapInArrow(run, fields)
