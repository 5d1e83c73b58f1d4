"""Packing of token sequences by a grouping genetic algorithm on islands.

Documents longer than a sequence are cut into full sequences and a shorter first
piece. Full pieces are sequences of their own; the others are dealt by hash into
blocks of about ``BLOCK`` pieces, and every block is evolved on ``ISLANDS``
islands. A chromosome is a packing. Crossover injects a part of the well-filled
bins of one parent whole into the other, removes the bins that hold the same
pieces, and puts the displaced pieces back by best fit. An island keeps its whole
population from epoch to epoch, and after each epoch it sends its elites to the
next island of its block; in the end the best packing of each block counts. An
island that has reached the lower bound (all tokens over the capacity) rests, and
where the emptiest bins are packed again anyway, one within a bin of it does. An
island is one row of arrays, so memory is bounded however many documents there
are, and any lost task is redone alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import chunks, materialize, shuffled, utf8
from ledgerline.llm.tokens import byte_bpe, ragged

CAPACITY = 2048
END_ID = 0
BLOCK = 4096
#: One in so many of a block's bins, the emptiest, is packed again with those of other blocks.
POOLED = 4
ISLANDS, EPOCHS, CROSSOVERS, POPULATION, ELITES = 3, 4, 150, 16, 2
#: About so many islands, of up to BLOCK pieces each, share a task.
TASK_ROWS = 32


# --- pieces --------------------------------------------------------------------


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for a, b in chunks(offsets):
                low = offsets[a]
                ids, first = bpe.encode(raw[low : offsets[b]], offsets[a : b + 1] - low, END_ID)
                total = np.diff(first)
                n = -(-total // capacity)
                doc = np.repeat(np.arange(b - a), n)
                piece = ragged(np.zeros(len(n), np.int64), n)
                head = total - (n - 1) * capacity
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                at = first[doc] + start
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = np.array([zlib.crc32(data[4 * s : 4 * (s + k)]) for s, k in zip(at.tolist(), length.tolist(), strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc + a)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                    names=["doc", "piece", "start", "length", "ids_crc32"],
                )

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, piece, start, length, ids_crc32) of every document's ids, with END_ID after them; the first piece of a cut document is the shorter one."""
    schema = T.StructType([
        T.StructField("doc", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(_cut(tokenizer, capacity), schema)


# --- the genetic algorithm -----------------------------------------------------


def best_fit(sizes: list[int], items: list[int], bins: np.ndarray, loads: list[int], capacity: int) -> None:
    """Put ``items``, in this order, each into the fullest bin that has room; writes their bins into ``bins`` and extends ``loads``."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for b, load in enumerate(loads):
        by_room[capacity - load].append(b)
        rooms |= 1 << (capacity - load)
    for i in items:
        size = sizes[i]
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            held = by_room[room]
            b = held.pop()
            if not held:
                rooms ^= 1 << room
            loads[b] += size
        else:
            room, b = capacity, len(loads)
            loads.append(size)
        by_room[room - size].append(b)
        rooms |= 1 << (room - size)
        bins[i] = b


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then emptier last bins: the mean of squared fills."""
    fill = np.bincount(bins, sizes) / capacity
    return -len(fill), float(np.mean(fill * fill)) if len(fill) else 0.0


def _packed(sizes: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    bins = np.zeros(len(sizes), np.int64)
    best_fit(sizes.tolist(), order.tolist(), bins, [], capacity)
    return bins


def _rebuilt(kept: np.ndarray, sizes: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """A packing that keeps the bins in ``kept`` (-1: displaced) and puts the displaced pieces back in the order given."""
    placed = kept >= 0
    bins = np.full(len(kept), -1)
    names, bins[placed] = np.unique(kept[placed], return_inverse=True)
    loads = np.bincount(bins[placed], sizes[placed], len(names)).astype(np.int64).tolist()
    best_fit(sizes.tolist(), order[~placed[order]].tolist(), bins, loads, capacity)
    return bins


def crossover(into: np.ndarray, donor: np.ndarray, sizes: np.ndarray, capacity: int, order: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Half of the donor's well-filled bins go whole into the other parent; its bins with the same pieces are dissolved, and so is its emptiest tenth.

    The displaced pieces go back by best fit, large ones first but for chance: sizes are blurred by up to a third.
    """
    order = order[np.argsort(-(sizes * (1 - rng.random() * rng.random(len(sizes)) / 3))[order], kind="stable")]
    fill = np.bincount(donor, sizes)
    well = np.flatnonzero(fill >= max(np.median(fill), 0.9 * capacity))
    injected = np.isin(donor, rng.permutation(well)[: -(-len(well) // 2)])
    own = np.bincount(into, sizes)
    hit = np.zeros(len(own), bool)
    hit[into[injected]] = True
    hit[np.argsort(own, kind="stable")[: -(-len(own) // 10)]] = True
    kept = np.where(hit[into], -1, into)
    kept[injected] = len(own) + donor[injected]
    return _rebuilt(kept, sizes, order, capacity)


def generations(sizes: np.ndarray, population: list[np.ndarray], capacity: int, seed: int, crossovers: int = CROSSOVERS, size: int = POPULATION, spare: int = 0) -> list[np.ndarray]:
    """A population after ``crossovers`` children, best first; it is filled up to ``size`` with best-fit decreasing and blurred orders of it.

    A child takes the place of the last but one if it is better and no twin of another; the last stays, for the
    material that only it still has.
    Nothing is done once the best has as few bins as the sum of sizes allows, and ``spare`` more.
    """
    rng = np.random.default_rng(seed)
    order = np.argsort(-sizes, kind="stable")
    least = -(-int(sizes.sum()) // capacity) + spare
    scored = [(fitness(p, sizes, capacity), k, p) for k, p in enumerate(population)]
    if not scored:
        first = _packed(sizes, order, capacity)
        scored.append((fitness(first, sizes, capacity), 0, first))
    top = max(scored)[0][0]
    while len(scored) < size and top < -least:
        blurred = np.argsort(-sizes * (1 + 0.1 * rng.random(len(sizes))), kind="stable")
        one = _packed(sizes, blurred, capacity)
        scored.append((fitness(one, sizes, capacity), len(scored), one))
    scored.sort(key=lambda x: (x[0], -x[1]), reverse=True)
    del scored[size:]
    for k in range(crossovers):
        if scored[0][0][0] >= -least or len(scored) < 2:
            break
        a, b = sorted(rng.choice(len(scored), 2, replace=False))
        child = crossover(scored[b][2], scored[a][2], sizes, capacity, order, rng)
        score = fitness(child, sizes, capacity)
        if score > scored[-2][0] and all(score != other for other, _, _ in scored):
            scored[-2] = (score, size + k, child)
            scored.sort(key=lambda x: (x[0], -x[1]), reverse=True)
    return [p for _, _, p in scored]


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, seed: int, crossovers: int = CROSSOVERS, size: int = POPULATION) -> np.ndarray:
    """The best packing of a population after ``crossovers`` children."""
    return generations(sizes, population, capacity, seed, crossovers, size)[0]


_STATE = "block long, island int, uids array<long>, sizes array<int>, population array<array<int>>, moved array<array<int>>, count int, spread double"


def _evolve_rows(capacity: int, epoch: int, spare: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one island at a time is turned into lists
                r = batch.slice(i, 1).to_pylist()[0]
                sizes = np.array(r["sizes"], np.int64)
                population = [np.array(p, np.int64) for p in (r["population"] or []) + (r["moved"] or [])]
                kept = generations(sizes, population, capacity, (int(r["block"]) * ISLANDS + r["island"]) * 64 + epoch, spare=spare)
                (count, spread) = fitness(kept[0], sizes, capacity)
                r |= {"population": [p.tolist() for p in kept], "moved": None, "count": -count, "spread": spread}
                yield pa.RecordBatch.from_pylist([r], schema=batch.schema)

    return run


def _placed_rows(capacity: int, level: int, last: bool):
    """A row per piece; unless this is the last level, pieces of a block's emptiest bins have no place yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, uids, sizes, bins = (batch.column(c)[i].as_py() for c in ("block", "uids", "sizes", "bins"))
                uid, size, b = np.array(uids, np.int64), np.array(sizes, np.int64), np.array(bins, np.int64)
                order = np.lexsort((uid, b))
                uid, size, b = uid[order], size[order], b[order]
                before = np.cumsum(size) - size
                first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
                offset = before - np.repeat(before[first], np.diff(np.r_[first, len(b)]))
                fill = np.bincount(b, size)
                loose = np.zeros(len(fill), bool)
                if not last:
                    loose[np.argsort(fill, kind="stable")[: -(-len(fill) // POOLED)]] = True
                    loose &= fill < capacity
                sequence = pa.array((level << 56) + (block << 24) + b, mask=loose[b])
                yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(size), sequence, pa.array(offset)], names=["uid_p", "length", "sequence_id", "offset"])

    return run


def _best_of_islands(items: DataFrame, capacity: int, blocks: int) -> DataFrame:
    dealt = items.groupBy(F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"))
    # a block holds about BLOCK rows by construction: uids are unique and hashed
    state = dealt.agg(F.array_sort(F.collect_list(F.struct("uid", F.col("length").cast("int").alias("size")))).alias("x"))
    state = state.select(
        "block", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), F.col("x.uid").alias("uids"), F.col("x.size").alias("sizes"),
        *(F.lit(None).cast(t).alias(c) for c, t in (("population", "array<array<int>>"), ("moved", "array<array<int>>"), ("count", "int"), ("spread", "double"))),
    )
    rows, parts = blocks * ISLANDS, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(rows, 4 * parts), rows // TASK_ROWS)
    for epoch in range(EPOCHS):
        state = materialize(state.repartition(tasks, "block", "island").mapInArrow(_evolve_rows(capacity, epoch, int(blocks > 1)), _STATE))
        if epoch + 1 < EPOCHS:
            elite = state.select(F.col("block").alias("from"), F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("to"), F.slice("population", 1, ELITES).alias("sent"))
            state = state.join(elite, (F.col("block") == F.col("from")) & (F.col("island") == F.col("to"))).select(
                "block", "island", "uids", "sizes", "population", F.col("sent").alias("moved"), "count", "spread"
            )
    best = state.groupBy("block").agg(F.min(F.struct("count", -F.col("spread"), "island")).alias("best"))
    best = best.select(F.col("block").alias("best_block"), F.col("best.island").alias("best_island"))
    best = state.join(best, (F.col("block") == F.col("best_block")) & (F.col("island") == F.col("best_island")))
    return best.select("block", "uids", "sizes", F.col("population")[0].alias("bins"))


def pack_sizes(items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """(uid_p, sequence_id, offset) for rows (uid, length), uids unique and lengths from 1 to ``capacity - 1``.

    The emptiest bins of each block are dissolved and their pieces packed again
    in fewer blocks, until one block is left: blocks leave no partly filled bins behind.
    """
    placed, level, blocks = None, 0, max(1, round(items.count() / block))
    while True:
        best = _best_of_islands(items, capacity, blocks)
        here = materialize(best.mapInArrow(_placed_rows(capacity, level, blocks == 1), "uid_p long, length long, sequence_id long, offset long"))
        done = here.where("sequence_id is not null").select("uid_p", "sequence_id", "offset")
        placed = done if placed is None else placed.unionByName(done)
        if blocks == 1:
            return placed
        items = here.where("sequence_id is null").select(F.col("uid_p").alias("uid"), "length")
        level, blocks = level + 1, max(1, min(blocks // 2, round(items.count() / block)))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Places of all documents in sequences of at most ``capacity`` tokens.

    A row per piece: the id column, piece, start, length, ids_crc32,
    sequence_id, offset. ``tokenizer`` is the path of a byte-level BPE file on
    every executor. A document is its ids and END_ID after them; a null text
    counts as empty and so is one token. Only documents longer than a sequence
    are cut. Null ids pass through, and repeated rows are packed as often as
    they occur. Other columns are left out. An empty table gives no rows.
    """
    pieces = materialize(token_pieces(docs, tokenizer, capacity, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()))
    packed = pack_sizes(pieces.where(F.col("length") < capacity).select("uid", "length"), capacity, block)
    full = F.col("length") == capacity
    out = pieces.join(shuffled(packed), F.col("uid") == F.col("uid_p"), "left")
    return out.select(
        F.col("doc").alias(id_col), "piece", "start", "length", "ids_crc32",
        F.when(full, -1 - F.col("uid")).otherwise(F.col("sequence_id")).alias("sequence_id"), F.when(full, F.lit(0)).otherwise(F.col("offset")).cast("long").alias("offset"),
    )
