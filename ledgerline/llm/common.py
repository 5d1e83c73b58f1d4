"""What the training-data operators share: names, skewed joins and Arrow text helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.tables import dropped_after, materialize, shared_folder, shuffled, table  # noqa: F401

WORD_SPACE = np.zeros(256, dtype=bool)
WORD_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that one vectorised step takes at a time (a single longer text is taken whole).
CHUNK_BYTES = 1 << 20


def fresh(df: DataFrame, base: str, *more: str) -> str:
    """A column name that starts with ``base`` and that neither ``df`` nor ``more`` has."""
    taken = {c.lower() for c in (*df.columns, *more)}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def same(left: DataFrame, right: DataFrame, *columns: str):
    """Null-safe equality on ``columns``."""
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[c])
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges (first, past) whose texts together take about ``most`` bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        past = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, min(past, n)
        first = past


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, for sums that give the hash of any slice in two look-ups."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << max(16, (n - 1).bit_length())
            steps = np.full(n, self.base, np.uint64), np.full(n, self.inverse, np.uint64)
            steps[0][0] = steps[1][0] = 1
            self.up, self.down = np.cumprod(steps[0], dtype=np.uint64), np.cumprod(steps[1], dtype=np.uint64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        self._reach(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def slices(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        self._reach(len(sums))
        return mix((sums[stop] - sums[start]) * self.down[start])


BYTE_POWERS, WORD_POWERS = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of consecutive texts: byte start, byte end and hash of each, and the first word of each text (one more at the end)."""
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~WORD_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    sums = BYTE_POWERS.sums(raw.astype(np.uint64) + np.uint64(1))
    hashes = BYTE_POWERS.slices(sums, starts, ends)
    return starts, ends, hashes, np.searchsorted(starts, offsets)


#: A key with more than one in so many rows is hot, so there are fewer hot keys than this. It grows with the rows,
#: so that a key that isn't hot has HOT_ROWS at most, up to MOST_HOT keys.
HOT_SHARE, HOT_ROWS, MOST_HOT = 500, 2_000_000, 10_000


def hot_share(total: int) -> int:
    """A key of ``total`` rows is hot if it has more than one in so many of them."""
    return max(HOT_SHARE, min(total // HOT_ROWS, MOST_HOT))


def skewed_lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined to ``table``, which has each ``key`` once, with hot keys kept from gathering in one task.

    The entries of hot keys (fewer than ``hot_share``, so a bounded table) are
    broadcast; all other rows meet theirs by a shuffle on the key.
    """
    counts = rows.groupBy(F.col(key).alias("hot_key")).agg(F.count(F.lit(1)).alias("hot_rows"))
    total = counts.agg(F.sum("hot_rows")).first()[0] or 0
    hot = [r[0] for r in counts.where((F.col("hot_rows") > total / hot_share(total)) & F.col("hot_key").isNotNull()).select("hot_key").collect()]
    names = [F.col(f"`{c}`") for c in (*rows.columns, *(c for c in table.columns if c != key))]
    if not hot:
        return rows.join(table, key, "left").select(*names)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = rows.where(~is_hot).join(table.where(~F.col(key).isin(hot)), key, "left")
    warm = rows.where(is_hot).join(F.broadcast(table.where(F.col(key).isin(hot))), key, "left")
    return cold.select(*names).unionByName(warm.select(*names))


def split_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (``how``: inner or left) to ``table``, which has each combination of ``keys`` once and, in ``count``, the number of rows that meet it.

    Combinations that over one in ``hot_share`` of these rows meet, so fewer than
    that, are broadcast; all others meet by a shuffle on the keys.
    ``table`` is read more than once and should be materialized.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    both = F.xxhash64(*keys)
    hot = [r[0] for r in table.where(F.col(count) > total / hot_share(total)).select(both).collect()]
    if not hot:
        return rows.join(shuffled(table), keys, how)
    cold = rows.where(~both.isin(hot)).join(shuffled(table.where(~both.isin(hot))), keys, how)
    return cold.unionByName(rows.where(both.isin(hot)).join(F.broadcast(table.where(both.isin(hot))), keys, how))


def heavy_keys(rows: DataFrame, key: str) -> tuple[list, int]:
    """All keys that over one in ``hot_share`` rows have, from partial sketches of frequent items, and that share; a key just below may be among them.

    The sketch holds 20 times as many items, so no such key is missed, and at most
    twice as many come back. They say where to split work, not what to leave out.
    """
    total = rows.count()
    share = hot_share(total)
    found = rows.agg(F.expr(f"approx_top_k(`{key}`, {min(2 * share, 20_000)}, {min(20 * share, 200_000)})")).first()[0]
    return [r["item"] for r in found or [] if r["count"] > total / share], share


def global_ranks(rows: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """``rows`` with a long column ``name``: 1, 2, 3... in ``order`` over all rows; and the number of rows.

    One sort over ranges writes each row's range and its place in it; the sizes of the
    ranges, one row each, then give every range its first rank. Rows that are equal in
    ``order`` are dealt over ranges as they stand in ``rows``, which should be a table.
    """
    salt, place, part = (fresh(rows, base, name) for base in ("salt", "place", "part"))
    placed = rows.withColumn(salt, F.monotonically_increasing_id()).orderBy(*order, salt).drop(salt)
    placed = materialize(placed.withColumn(place, F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright(F.col(place), 33).alias(part)).agg(F.count(F.lit(1)).alias("rows")).collect()  # one row a range
    firsts, total = [], 0
    for at, n in sorted(tuple(r) for r in sizes):
        firsts.append((at, total))
        total += n
    first = rows.sparkSession.createDataFrame(firsts, f"`{part}` long, ranks_before long")
    ranked = placed.withColumn(part, F.shiftright(F.col(place), 33)).join(F.broadcast(first), part)
    rank = F.col("ranks_before") + F.col(place).bitwiseAND((1 << 33) - 1) + 1
    return ranked.select(*(F.col(f"`{c}`") for c in rows.columns), rank.alias(name)), total
