"""Running offsets and sequential packing without one task per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.operators.running import running
from siltworks.session import stored

#: Shards' lengths that make a chunk.
CHUNK = 64


def offsets(df: DataFrame, group: str, order: list[str], size: str, name: str) -> DataFrame:
    """df with `name`: the sum of `size` over the rows before this one in its group."""
    x = running(df, group, order, **{name: ("sum", size)})
    return x.withColumn(name, F.coalesce(name, F.lit(0)))


def _jumps(start: np.ndarray, end: np.ndarray, target: int) -> np.ndarray:
    """For every row, as the first of a shard, the row that begins the next one; the number of rows for none."""
    n = np.maximum(np.searchsorted(end, start + target, "right"), np.searchsorted(start, start, "right"))
    return np.maximum(n, np.arange(1, len(start) + 1))


def _chunk_map(key: tuple, pdf: pd.DataFrame, target: int, span: int) -> pd.DataFrame:
    """For every row of a chunk that can be the first to begin a shard in it: where the last shard begun in the
    chunk leads to, how many are begun and where the last one is."""
    pdf = pdf.sort_values(["_s", "_e"])
    start, end = pdf["_s"].to_numpy(), pdf["_e"].to_numpy()
    nxt, n = _jumps(start, end, target), len(pdf)
    many, last = np.ones(n, dtype=np.int64), start.copy()
    for i in range(n - 1, -1, -1):
        j = nxt[i]
        if j < n:
            many[i], last[i] = many[j] + 1, last[j]
    first = start < key[1] * span + target
    first[0] = True
    return pd.DataFrame({"_k": key[0], "_c": key[1], "i": np.flatnonzero(first), "_e": end[first], "many": many[first], "last": last[first]})


def _entries(batches: Iterator[pd.DataFrame], target: int) -> Iterator[pd.DataFrame]:
    """Chunk maps, sorted by group, chunk and row -> per chunk the row with which its first shard begins (null
    for none), the shards before it and where the one before begins. Three numbers are kept."""
    group, chunk, taken = None, None, True
    reach, shards, before = -1, 0, 0
    for pdf in batches:
        rows = []
        for k, c, i, e, many, last in pdf[["_k", "_c", "i", "_e", "many", "last"]].itertuples(index=False):
            if (k, c) != (group, chunk):
                if not taken:
                    rows.append((group, chunk, None, shards, before))
                if k != group:
                    reach, shards, before = -1, 0, 0
                group, chunk, taken = k, c, False
            if not taken and e > reach:
                rows.append((k, c, i, shards, before))
                reach, shards, before, taken = last + target, shards + many, last, True
        yield pd.DataFrame(rows, columns=["_k", "_c", "entry", "shards", "before"]).astype({"entry": "Int64"})
    if not taken:
        yield pd.DataFrame([(group, chunk, None, shards, before)], columns=["_k", "_c", "entry", "shards", "before"]).astype({"entry": "Int64"})


def _assigned(pdf: pd.DataFrame, order: list[str], target: int) -> pd.DataFrame:
    """Shard and offset of the rows of one chunk, from its entry."""
    pdf = pdf.sort_values(["_s", "_e", *order])
    start, end = pdf["_s"].to_numpy(), pdf["_e"].to_numpy()
    nxt, n = _jumps(start, end, target), len(pdf)
    at, begins = pdf["entry"].iat[0], []
    i = n if pd.isna(at) else int(at)
    while i < n:
        begins.append(i)
        i = int(nxt[i])
    own = np.searchsorted(np.array(begins, dtype=np.int64), np.arange(n), "right")
    base = np.concatenate([[int(pdf["before"].iat[0])], start[begins]]) if begins else np.array([int(pdf["before"].iat[0])])
    return pdf.assign(shard=int(pdf["shards"].iat[0]) - 1 + own, shard_offset=start - base[own]).drop(columns=["_k", "_c", "_s", "_e", "entry", "shards", "before"])


def next_fit(df: DataFrame, group: str, order: list[str], size: str, target: int) -> DataFrame:
    """df with `shard` and `shard_offset` of greedy next-fit packing in order: a row that would take a shard
    past `target` begins a new one.

    Which row begins the shard after one that begins at a given row is told by running sums alone. So each
    chunk of CHUNK shards' length is folded on its own, from the end, for every row at which the first shard
    of the chunk could begin; one pass over these maps, a few rows per chunk, finds where it does begin; and
    every chunk is then numbered on its own. No group is one task but in the pass over the maps. Sizes are
    zero or more; ties in `order` may fall either way.
    """
    span = target * CHUNK
    x = offsets(df, group, order, size, "_s")
    k = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    x = stored(x.withColumns({"_k": k, "_c": F.floor(F.col("_s") / span).cast("long"), "_e": F.col("_s") + F.col(size)}), "placed")
    m = x.select("_k", "_c", "_s", "_e").groupBy("_k", "_c").applyInPandas(lambda key, p: _chunk_map(key, p, target, span), "_k string, _c long, i long, _e long, many long, last long")
    m = m.repartition("_k").sortWithinPartitions("_k", "_c", "i").mapInPandas(lambda it: _entries(it, target), "_k string, _c long, entry long, shards long, before long")
    cols = [*df.columns, "shard", "shard_offset"]
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", shard long, shard_offset long"
    return x.join(m, ["_k", "_c"]).groupBy("_k", "_c").applyInPandas(lambda p: _assigned(p, order, target)[cols], schema)
