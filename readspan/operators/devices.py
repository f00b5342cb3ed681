"""Records of several devices side by side: positions and keys moved apart by device, and read back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Positions that one device can use, and the sign between a key and its device's number.
SPACE, MARK = 1 << 40, "@"


def moved(position: Column, n: Column) -> Column:
    """A position in the space of device ``n``; none (null, 0 or under) stays."""
    return F.when(position > 0, position + (n + 1).cast("long") * SPACE).otherwise(position)


def marked(key: Column, n: Column) -> Column:
    """A key of device ``n``; an empty one stays."""
    return F.when(key != "", F.concat(key, F.lit(MARK), n.cast("string"))).otherwise(key)


def origin(position: Column) -> Column:
    """``struct<device,position>`` as the device states it; a null device if it wasn't moved."""
    is_moved = position > SPACE
    device = F.when(is_moved, F.floor(position / SPACE).cast("int") - 1)
    return F.struct(device.alias("device"), F.when(is_moved, position % SPACE).otherwise(position).alias("position"))


def key_origin(key: Column) -> Column:
    """``struct<device,key>`` as the device states it; a null device if it wasn't marked."""
    n = F.regexp_extract(key, rf"(?s)^.*{MARK}([0-9]+)$", 1)
    device = F.when(n != "", n.try_cast("int"))
    own = F.when(device.isNotNull(), F.left(key, F.length(key) - F.length(n) - 1)).otherwise(key)
    return F.struct(device.alias("device"), own.alias("key"))


def apart(rows: DataFrame, device: str, positions: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """``rows`` with the ``positions`` and ``keys`` of each in the space of its ``device`` (a number from 0), so that rows of several devices never share one by chance."""
    n = F.col(device)
    return rows.withColumns({**{c: moved(F.col(c), n) for c in positions}, **{c: marked(F.col(c), n) for c in keys}})


def read_back(rows: DataFrame, device: str, positions: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """``apart`` undone; ``device`` is null where nothing tells it."""
    told = F.coalesce(*(origin(F.col(c))["device"] for c in positions), *(key_origin(F.col(c))["device"] for c in keys), F.lit(None).cast("int"))
    return rows.withColumns({device: told, **{c: origin(F.col(c))["position"] for c in positions}, **{c: key_origin(F.col(c))["key"] for c in keys}})
