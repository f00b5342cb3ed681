"""Running sums over a total order, whatever its keys: sorted ranges, and one row for each range."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readspan.llm.common import cut, freed

#: Rows up to which a table of keys is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if it is counted to hold at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def changes(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Whether each row but the first differs from the one before it in one of ``keys``."""
    out = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in keys:
        a, b = batch.column(k).slice(1), batch.column(k).slice(0, max(batch.num_rows - 1, 0))
        differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        out |= differs | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return out


def wrapped(x: int) -> int:
    """``x`` as a 64-bit number with a sign."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def running(df: DataFrame, order: Sequence[Column], values: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``<value>_before`` and ``<value>_upto`` for each of ``values``: its sum over the rows that come earlier in ``order``, without and with the row itself.

    ``within`` names the columns that ``order`` sorts by first; sums begin anew where they change. Sampled ranges of
    ``order`` are sorted and summed up by their tasks, so a key that holds a third of the rows takes as many ranges as its
    rows need; what a range goes on from is known from one row for each range, on the driver. Rows that are equal in
    ``order`` come in any sequence, so it should name every column that matters. Values are 64-bit numbers, not null, and
    sums wrap around; keys may be null. An empty table gives no rows.
    """
    keys, kept = list(within), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, last, n, run_of = TaskContext.get().partitionId(), dict.fromkeys(values, 0), None, 0, 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            new = np.concatenate(([False], changes(batch, keys)))
            first = tuple(batch.column(k)[0].as_py() for k in keys)
            new[0] = last is not None and first != last
            last = tuple(batch.column(k)[rows - 1].as_py() for k in keys)
            starts = np.flatnonzero(new)
            group = np.cumsum(new)
            columns, names = [*batch.columns], [*batch.schema.names]
            for v in values:
                own = batch.column(v).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.cumsum(own)
                base = np.concatenate((np.array([wrapped(-seen[v])]), upto[starts] - own[starts]))
                upto = upto - base[group]
                columns += [pa.array(upto - own), pa.array(upto)]
                names += [f"{v}_before", f"{v}_upto"]
                seen[v] = int(upto[-1])
            columns += [pa.array(np.full(rows, part, np.int32)), pa.array(np.arange(n, n + rows)), pa.array(run_of + group == 0)]
            n, run_of = n + rows, run_of + int(group[-1])
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "__range", "__row", "__open"])

    sums = [f"{v}_{x}" for v in values for x in ("before", "upto")]
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + "".join(f", `{c}` long" for c in sums)
    held = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(freed(run), schema + ", __range int, __row long, __open boolean"))
    ends = F.max_by(F.struct(*keys, *(f"{v}_upto" for v in values), "__open"), "__row")
    begins = F.min_by(F.struct(F.lit(0), *keys), "__row")
    carry, carries, before = [0] * len(values), {}, None
    for part, begin, end in sorted(held.groupBy("__range").agg(begins, ends).collect(), key=lambda r: r[0]):
        carry = carry if before == tuple(begin[1:]) else [0] * len(values)
        carries[part] = carry
        before, upto = tuple(end[: len(keys)]), end[len(keys) : -1]
        carry = [wrapped(c + u) for c, u in zip(carry, upto, strict=True)] if end[-1] else list(upto)

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            opens = batch.column("__open").to_numpy(zero_copy_only=False).astype(np.int64)
            columns = [batch.column(c) for c in kept]
            for v, c in zip(values, carries[batch.column("__range")[0].as_py()], strict=True):
                columns += [pa.array(batch.column(f"{v}_{x}").to_numpy(zero_copy_only=False) + opens * np.int64(c)) for x in ("before", "upto")]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *sums])

    return held.mapInArrow(freed(carried), schema)
