"""Rows told apart by their place, and values dealt to rows by place without moving them.

A row of a table of files is known by its file and its number in it.  Values for
some rows are written as one small sorted array for each file (or for each
million of its rows); a scan then reads the arrays of its own file only, and the
texts stay where they are: neither a shuffle of whole rows nor a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, get_array, put_array, saved, shared_path

ROWS = 20  # 2^20 rows of a file share an array
HELD = 8  # arrays that a task keeps at hand


def _scans_files(docs: DataFrame) -> bool:
    """Whether the frame reads files and only picks columns and rows of them."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.children().size() == 1:
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation"


def placed(docs: DataFrame, name: str = "rows") -> tuple[DataFrame, Column, Column]:
    """The rows, and the columns (long) of their file and their number in it.

    What isn't a plain scan of files, so that places could repeat or shift, is
    written to the shared folder first.
    """
    if _scans_files(docs):
        try:
            meta = docs.metadataColumn("_metadata")
            docs.select(meta["file_path"], meta["row_index"])  # not every format numbers its rows
            return docs, F.xxhash64(meta["file_path"]), meta["row_index"]
        except Exception as e:  # noqa: BLE001
            if "UNRESOLVED" not in str(e) and "FIELD_NOT_FOUND" not in str(e):
                raise
    docs = saved(docs, name)
    meta = docs.metadataColumn("_metadata")
    return docs, F.xxhash64(meta["file_path"]), meta["row_index"]


def write_marks(marks: DataFrame, name: str) -> str:
    """Write (file, row, value), all long and one row a place; the folder of the arrays."""
    out = shared_path(marks.sparkSession, name)

    def put(group: pd.DataFrame) -> pd.DataFrame:
        rows, values = group["row"].to_numpy(np.int64), group["value"].to_numpy(np.int64)
        order = np.argsort(rows)
        put_array(f"{out}/{group['file'].iloc[0]}_{group['part'].iloc[0]}.npy", np.stack([rows[order], values[order]]))
        return pd.DataFrame({"n": [len(rows)]})

    parts = marks.withColumn("part", F.shiftright("row", ROWS))
    parts.groupBy("file", "part").applyInPandas(put, "n long").agg(F.sum("n")).collect()
    return out


def mark_column(folder: str, file: Column, row: Column, default: int = 0) -> Column:
    """The value of each row, ``default`` where it has none."""

    def look(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        claim("positions")
        held: dict[tuple[int, int], np.ndarray] = {}

        def array(key: tuple[int, int]) -> np.ndarray:
            if key not in held:
                while len(held) >= HELD:
                    del held[next(iter(held))]
                try:
                    held[key] = np.asarray(get_array(f"{folder}/{key[0]}_{key[1]}.npy"))
                except FileNotFoundError:
                    held[key] = np.zeros((2, 0), np.int64)
            return held[key]

        for files, rows in batches:
            f, r = files.to_numpy(np.int64), rows.to_numpy(np.int64)
            out = np.full(len(r), default, np.int64)
            starts = np.flatnonzero(np.append(True, (f[1:] != f[:-1]) | (r[1:] >> ROWS != r[:-1] >> ROWS))) if len(r) else []
            for a, b in zip(starts, [*starts[1:], len(r)], strict=True):
                known, values = array((int(f[a]), int(r[a]) >> ROWS))
                at = np.searchsorted(known, r[a:b])
                hit = at < len(known)
                hit[hit] = known[at[hit]] == r[a:b][hit]
                out[a:b][hit] = values[at[hit]]
            yield pd.Series(out)

    return F.pandas_udf(look, "long", F.PandasUDFType.SCALAR_ITER)(file, row)
