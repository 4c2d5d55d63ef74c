"""Globally ordered tables of packed counts: reduction by runs, without a shuffle of the records.

A table is globally ordered if each partition's rows ascend and no partition begins before the one before it ends: after
``sort_packed``, or when sorted parts are read back. Equal keys are then neighbours, in one partition or in those next to it.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import shared_folder
from ..sources.packed_format import changes
from .extract import WINDOWS, tasks_of
from .packed import count_packed, order_of, task_counts, word_names


def sort_packed(rows: DataFrame, k: int) -> DataFrame:
    """Packed rows in the order of their letters, by one range exchange."""
    return rows.orderBy(*order_of(k))


def count_sorted(df: DataFrame, seq: str, k: int) -> DataFrame:
    """``count_packed`` in the order of the letters. Many keys are summed and sorted in the ranges of one exchange, as many as the windows need."""
    tasks = 1 if 4**k <= WINDOWS else tasks_of(df, seq, k)
    if tasks == 1:
        return sort_packed(count_packed(df, seq, k), k)
    names = word_names(k)
    # The keys of the exchange and of the sums are the same columns, so that a range holds its keys whole.
    turned = task_counts(df, seq, k, tasks).select(*[o.alias(c) for c, o in zip(names, order_of(k), strict=True)], "cnt")
    sums = turned.repartitionByRange(tasks, *names).groupBy(*names).agg(F.sum("cnt").cast("bigint").alias("cnt"))
    return sums.sortWithinPartitions(*names).select(*[o.alias(c) for c, o in zip(names, order_of(k), strict=True)], "cnt")


def reduce_sorted(rows: DataFrame, k: int) -> DataFrame:
    """``w0, w1, ..., cnt`` of a globally ordered table of the same columns, equal keys summed.

    Runs are reduced in Arrow batches as they pass. A run inside a partition is whole; the first and the last one of each
    partition may go on in the next and are summed by key, two rows a partition. The reduced table is written once, since the
    edges are read from it, too.
    """
    names = word_names(k)
    kinds = [pa.int64()] * len(names) + [pa.int64(), pa.bool_()]
    schema = pa.schema(list(zip([*names, "cnt", "edge"], kinds, strict=True)))

    def reduced(batches):
        held, begun = None, False  # the open run, and whether one has ended before it

        def batch(words, sums, edge):
            return pa.RecordBatch.from_arrays([*[pa.array(words[:, i]) for i in range(words.shape[1])], pa.array(sums), pa.array(edge)], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            words, counts = np.stack(columns[:-1], axis=1), columns[-1]
            if held is not None:
                words, counts = np.concatenate([held[0], words]), np.concatenate([held[1], counts])
            starts = np.flatnonzero(changes(words))
            keys, sums = words[starts], np.add.reduceat(counts, starts)
            if len(keys) > 1:
                edge = np.zeros(len(keys) - 1, bool)
                edge[0] = not begun
                yield batch(keys[:-1], sums[:-1], edge)
                begun = True
            held = keys[-1:], sums[-1:]
        if held is not None:
            yield batch(*held, np.ones(1, bool))

    ddl = ", ".join(f"{c} bigint" for c in [*names, "cnt"]) + ", edge boolean"
    at = f"{shared_folder(rows.sparkSession).rstrip('/')}/runs-{uuid.uuid4().hex}"
    rows.select(*names, "cnt").mapInArrow(reduced, ddl).write.parquet(at)
    found = rows.sparkSession.read.schema(ddl).parquet(at)
    edges = found.where("edge").groupBy(*names).agg(F.sum("cnt").cast("bigint").alias("cnt"))
    return found.where("not edge").select(*names, "cnt").unionByName(edges)
