"""SimHash near-duplicate detection with a Gray-order hierarchical index.

A text's 64-bit fingerprint sums the hashes of its 3-word shingles. Two
fingerprints that differ in at most ``radius`` bits agree entirely on one of
``radius + 1`` bit blocks, so the block masks are the index's top nodes and the
keys that Spark shuffles on. Below them each task sorts its fingerprints by
Gray rank and builds levels of nodes over runs of neighbours. A node keeps the
bits that all its members share (mask and pattern); searches descend pairs of
nodes and drop a pair as soon as the shared patterns differ in more than
``radius`` bits. Equal fingerprints are one row before any of this, and a group
under one block value that is larger than ``group_rows`` is divided by further
blocks of the bits still free, which loses no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import WORD_POWERS, chunks, fresh, materialize, shuffled, split_join, utf8, words_of
from ledgerline.operators.graph import connected_components

BITS = 64
SEED = 42
RADIUS = 2
#: Above this many distinct fingerprints under one mask value, further blocks divide the group.
GROUP_ROWS = 20_000
FANOUT = 8
#: Pairs of nodes that one vectorised step looks at.
FRONTIER = 1 << 20


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the 3-word shingles (fewer words: one shingle of all; none: 0)."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < 4:
        hashes = [digest(line, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends - [len(w) + 1 for w in words]).tolist()
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, (ends - 1)[2:].tolist(), strict=False)]
    return _majority(np.array(hashes, dtype=np.uint64))


def _majority(hashes: np.ndarray) -> int:
    n, counts = len(hashes), np.zeros(BITS, np.int64)
    for first in range(0, n, 1 << 15):
        part = np.ascontiguousarray(hashes[first : first + (1 << 15)]).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, fp): the fingerprint of every row's whole text as a signed 64-bit integer."""
    schema = T.StructType([T.StructField("doc", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(_fingerprints, schema)


# --- the index ---------------------------------------------------------------


def blocks(radius: int, free: int = (1 << BITS) - 1) -> list[int]:
    """``radius + 1`` masks that share out the free bits."""
    bits = [i for i in range(BITS) if free >> i & 1]
    return [sum(1 << int(i) for i in part) for part in np.array_split(bits, radius + 1)]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _levels(codes: np.ndarray, group: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From the leaves up, (all bits set, any bit set, first child, past the last child) of the nodes; no node spans two groups."""
    levels = [(codes, codes, np.arange(len(codes)), np.arange(1, len(codes) + 1))]
    while True:
        n = len(group)
        first_of_group = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        place = np.arange(n) - np.repeat(first_of_group, np.diff(np.r_[first_of_group, n]))
        heads = np.flatnonzero(place % FANOUT == 0)
        if len(heads) == n:
            return levels
        both, some = levels[-1][0], levels[-1][1]
        levels.append((np.bitwise_and.reduceat(both, heads), np.bitwise_or.reduceat(some, heads), heads, np.r_[heads[1:], n]))
        group = group[heads]


def near_pairs(codes: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) within a group whose codes differ in at most ``radius`` bits; both inputs sorted by group, then Gray rank."""
    if not len(codes):
        return
    levels = _levels(codes, group)
    top = np.arange(len(levels[-1][0]))
    stack = [(len(levels) - 1, top, top)]
    while stack:
        depth, left, right = stack.pop()
        if len(left) > FRONTIER:
            half = len(left) // 2
            stack += [(depth, left[:half], right[:half]), (depth, left[half:], right[half:])]
            continue
        both, some, first, past = levels[depth]
        settled = ~(some[left] ^ both[left]) & ~(some[right] ^ both[right])
        keep = np.bitwise_count((both[left] ^ both[right]) & settled) <= radius
        left, right = left[keep], right[keep]
        if depth == 0:
            apart = left < right
            if apart.any():
                yield left[apart], right[apart]
            continue
        wide_l, wide_r = past[left] - first[left], past[right] - first[right]
        each = wide_l * wide_r
        at = np.repeat(np.arange(len(left)), each)
        place = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
        a, b = first[left][at] + place // wide_r[at], first[right][at] + place % wide_r[at]
        ahead = a <= b
        stack.append((depth - 1, a[ahead], b[ahead]))


def _forest(codes: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the near pairs: at most one link fewer than there are codes."""
    parent = list(range(len(codes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, right = [], []
    for a, b in near_pairs(codes, group, radius):
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            ri, rj = root(i), root(j)
            if ri != rj:
                parent[max(ri, rj)] = min(ri, rj)
                left.append(i)
                right.append(j)
    return np.array(left, np.int64), np.array(right, np.int64)


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks()
            mask, value = t["mask"].to_numpy(), t["value"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])])
            done = len(mask) if final else int(starts[-1])  # the last group may go on in the next batch
            held = [] if final else t.slice(done).to_batches()
            rows = len(mask) - done
            if not done:
                return
            codes = t["fp"].to_numpy()[:done].view(np.uint64)
            group = np.searchsorted(starts, np.arange(done), side="right")
            order = np.lexsort((gray_rank(codes), group))
            a, b = _forest(codes[order], group[order], radius)
            if len(a):
                rep = t["rep"].slice(0, done).combine_chunks().take(pa.array(order))
                yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (rep.take(pa.array(a)), rep.take(pa.array(b)))], names=["a", "b"])

        wait = GROUP_ROWS
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= wait:
                yield from flush(False)
                wait = max(GROUP_ROWS, 2 * rows)
        yield from flush(True)

    return run


def _keyed(codes: DataFrame, masks: list[int]) -> DataFrame:
    """A row per code and mask, keyed by the mask and the code's bits under it."""
    signed = [int(np.uint64(m).view(np.int64)) for m in masks]
    keys = F.array(*[F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for m in signed])
    return codes.select("fp", "rep", F.explode(keys).alias("k")).select("fp", "rep", "k.mask", "k.value")


def links(codes: DataFrame, radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) between the ``rep`` of distinct fingerprints ``fp``: enough of the pairs within ``radius`` to connect all that are connected."""
    ready, masks = None, [0]
    rest = codes.select("fp", "rep")
    while rest is not None:
        keyed = None
        for mask in masks:
            part = rest if mask == 0 else rest.where(F.col("mask") == int(np.uint64(mask).view(np.int64)))
            free = ~mask & ((1 << BITS) - 1)
            part = _keyed(part, [mask | block for block in blocks(radius, free) if block] or [mask])
            keyed = part if keyed is None else keyed.unionByName(part)
        masks = [mask | block for mask in masks for block in blocks(radius, ~mask & ((1 << BITS) - 1)) if block]
        sizes = keyed.groupBy("mask", "value").count()
        large = sizes.where(F.col("count") > group_rows).select("mask", "value")
        final = max((bin(m).count("1") for m in masks), default=BITS) >= BITS - 3 * (radius + 1)
        if final or not large.take(1):
            here, rest = keyed, None
        else:
            large = materialize(large)
            here = keyed.join(large, ["mask", "value"], "left_anti")
            rest = materialize(keyed.join(large, ["mask", "value"], "left_semi"))
        ready = here if ready is None else ready.unionByName(here.select(ready.columns))
    rep = codes.schema["rep"].dataType
    schema = T.StructType([T.StructField("a", rep), T.StructField("b", rep)])
    n = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ready.repartition(n, "mask", "value").sortWithinPartitions("mask", "value").select("mask", "value", "fp", "rep").mapInArrow(_links(radius), schema).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of ``docs``.

    A null text counts as empty; texts without words have fingerprint zero and
    link like any other. ``component_id`` is the smallest id of the rows
    reachable by links of at most ``radius`` bits, the row's own included. Rows
    whose id is null keep a null id, take part in linking only through rows of
    the same fingerprint, and take that component (null if no row there has an
    id). Repeated rows are returned as often as they occur. Other columns are
    left out; an empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, id_col, text_col))
    codes = materialize(rows.groupBy("fp").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("held")))
    parts = connected_components(links(codes.where("rep is not null"), radius, group_rows))
    classes = codes.join(parts, codes["rep"] == parts["node"], "left").select("fp", "held", F.coalesce("component", "rep").alias("component_id"))
    # every fingerprint has a class; one that a third of all rows have is broadcast
    return split_join(rows, materialize(classes), ["fp"], "held").select(F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (of rows that repeat it, that of the smallest hash). Columns stay as they are.

    Rows without an id are kept as they are. Extra columns of any name and type pass through, maps too.
    """
    kept = simhash_components(docs, id_col, text_col, radius).where(f"`{id_col}` = component_id").select(id_col).distinct()
    return _one_row_each(docs, id_col, kept)


def _one_row_each(docs: DataFrame, id_col: str, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in the only column of ``kept``, one of each id (that of the smallest hash), and all without an id."""
    key, mark = fresh(docs, "kept"), fresh(docs, "row_hash")
    kept = kept.toDF(key)
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]  # maps have no hash
    hashed = docs.where(F.col(id_col).isNotNull()).withColumn(mark, F.xxhash64(*plain))
    least = hashed.groupBy(F.col(id_col).alias(key)).agg(F.min(mark).alias(mark)).join(kept, key, "left_semi")
    least = least.withColumnRenamed(mark, key + "_hash")
    # equal rows are one before they are joined, however many there are
    one = hashed.dropDuplicates([id_col, mark])
    one = one.join(least, (one[id_col] == least[key]) & (one[mark] == least[key + "_hash"]), "left_semi").drop(mark)
    return one.unionByName(docs.where(F.col(id_col).isNull()))


# --- near copies by the similarity of shingle sets ---------------------------------

#: Texts are near copies when the sets of their 5-word shingles have this Jaccard similarity or more.
WORDS, SIMILARITY = 5, 0.8
#: Texts of similarity 0.8 share none of BANDS keys of ROWS least hashes each with probability (1 - 0.8**5)**40, about 1e-7.
BANDS, ROWS = 40, 5
#: Fingerprints at similarity 0.8 differ in about 10 of 64 bits, with a deviation of 3.
WIDE_RADIUS = 24
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TURNS = np.random.default_rng(SEED).integers(0, 1 << 63, (1, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted, distinct hashes of each text's shingles (fewer words: one shingle of all; none: an empty set)."""
    raw, offsets = utf8(column)
    for a, b in chunks(offsets):
        low = offsets[a]
        _, _, hashes, first = words_of(_LOWER[raw[low : offsets[b]]], offsets[a : b + 1] - low)
        sums = WORD_POWERS.sums(hashes)
        for f, past in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            width = min(words, past - f)
            start = np.arange(f, past - width + 1) if width else np.zeros(0, np.int64)
            yield np.unique(WORD_POWERS.slices(sums, start, start + width))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key per band, of the least hashes of a set under ROWS orders."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for first in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[first : first + 4096, None] * _TURNS).min(axis=0), out=least)
    rows = least.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64)


def parity_sketch(hashes: np.ndarray) -> bytes:
    """A bit per class of hashes modulo its width, set where an odd number of the set's hashes fall; two to four bits a shingle, 64 at least.

    A hash in only one of two sets turns one bit of the sketches' difference, so
    that difference never has more bits than hashes are in only one set.
    """
    width = 1 << max(6, (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def sketch_distances(sketches: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bits in which the sketches of pairs differ, each pair at the smaller width of its two; a sketch folds to a smaller width by XOR of its parts."""
    wide = np.array([len(x) for x in sketches], np.int64)
    least = np.minimum(wide[left], wide[right])
    out = np.zeros(len(left), np.int64)
    for width in np.unique(least).tolist():
        at = np.flatnonzero(least == width)
        used, place = np.unique(np.concatenate([left[at], right[at]]), return_inverse=True)
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(sketches[k], "<u8").reshape(-1, width // 8), axis=0) for k in used.tolist()])
        step = max(1, (1 << 24) // width)
        for first in range(0, len(at), step):
            past = min(first + step, len(at))
            out[at[first:past]] = np.bitwise_count(folded[place[first:past]] ^ folded[place[len(at) + first : len(at) + past]]).sum(axis=1, dtype=np.int64)
    return out


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, codes, sizes, keys, odd = [], [], [], [], []
        for h in shingle_sets(batch.column(2)):
            node.append(xxhash.xxh64_intdigest(h.astype("<u8").tobytes(), SEED))
            codes.append(_majority(h) if len(h) else 0)
            sizes.append(len(h))
            keys.append(band_keys(h) if len(h) else [])
            odd.append(parity_sketch(h))
        signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, codes)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *signed, pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(odd, pa.binary())], names=["doc", "text_key", "node", "fp", "size", "keys", "odd"])


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of different labels under one key; rows come sorted by key.

    Pairs within the largest label are never looked at, so that a large group which is connected already costs no square.
    Sets of sizes m and n are 0.8 alike only if at most (m + n) / 9 shingles are in just one of them; pairs whose parity
    sketches differ in more bits than that are left out, which loses none.
    """

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        node, label, size = (t[c].to_numpy() for c in ("node", "label", "size"))
        codes, odd = t["fp"].to_numpy().view(np.uint64), t["odd"].to_pylist()
        names, back, counts = np.unique(label, return_inverse=True, return_counts=True)
        large = back == counts.argmax()
        rest, most = np.flatnonzero(~large), np.flatnonzero(large)
        rest = rest[np.argsort(gray_rank(codes[rest]), kind="stable")]
        found = ((rest[i], rest[j]) for i, j in near_pairs(codes[rest], np.zeros(len(rest), np.int64), WIDE_RADIUS))
        across = ((np.full(len(hit), i), hit) for i in rest.tolist() if len(hit := most[np.bitwise_count(codes[most] ^ codes[i]) <= WIDE_RADIUS]))
        for group in (found, across):
            for i, j in group:
                fits = (label[i] != label[j]) & (np.minimum(size[i], size[j]) >= SIMILARITY * np.maximum(size[i], size[j]))
                i, j = i[fits], j[fits]
                if len(i):
                    fits = 9 * sketch_distances(odd, i, j) <= size[i] + size[j]
                    i, j = i[fits], j[fits]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(batch.schema.get_field_index("key")).to_numpy()
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).tolist() if len(key) else []
        for a, b in zip(edges, [*edges[1:], len(key)], strict=True):
            part = batch.slice(a, b - a)
            if held and held[-1]["key"][0] != part["key"][0]:
                yield from pairs(pa.Table.from_batches(held))
                held = []
            held.append(part)
    if held:
        yield from pairs(pa.Table.from_batches(held))


def _alike(pairs: DataFrame, where: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of sets whose similarity, computed from the whole texts, is SIMILARITY or more."""

    @F.arrow_udf("boolean")
    def alike(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(shingle_sets(left), shingle_sets(right), strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both * 5 >= (len(x) + len(y) - both) * 4)  # SIMILARITY in whole numbers
        return pa.array(out, pa.bool_())

    wanted = where.join(shuffled(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "node", "left_semi").select("node", "at.doc", "at.text_key")
    body = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col).cast("string")).alias("text_key"), F.col(text_col).cast("string").alias("body"))
    texts = materialize(body.join(wanted, ["doc", "text_key"]).groupBy("node").agg(F.min("body").alias("body")))
    met = pairs.join(shuffled(texts.select(F.col("node").alias("a"), F.col("body").alias("x"))), "a").join(shuffled(texts.select(F.col("node").alias("b"), F.col("body").alias("y"))), "b")
    return materialize(met.where(alike("x", "y")).select("a", "b"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the smallest id. Columns stay as they are.

    Two texts are near copies when the sets of their 5-word shingles (ASCII
    letters in lower case) have a Jaccard similarity of 0.8 or more; groups are
    the components of these links. Equal sets are one before anything is
    compared. Sets that share a key of least hashes meet; those whose SimHash
    fingerprints are within WIDE_RADIUS bits, found in Gray order, are candidates, and
    each candidate pair is verified with the whole texts. At first every set is
    compared with one of its key; then only pairs which that left apart are, and
    of these only pairs whose parity sketches leave room for the similarity.
    Texts without words are one group; rows of one id are one row, and rows
    without an id are kept as they are, as in ``simhash_dedup``.
    """
    schema = T.StructType([T.StructField("doc", docs.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in ("text_key", "node", "fp", "size")] + [T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("odd", T.BinaryType())])
    text = F.col(text_col).cast("string")
    rows = materialize(docs.where(F.col(id_col).isNotNull()).select(id_col, F.xxhash64(text), text).mapInArrow(_set_rows, schema))
    sets = materialize(rows.groupBy("node").agg(F.min(F.struct("doc", "text_key")).alias("at"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("odd").alias("odd")))
    member = F.struct("node", "fp", "size")
    every = sets.select("node", "fp", "size", F.explode("keys").alias("key"))
    groups = every.groupBy("key").agg(F.min(member).alias("least"), F.max("node").alias("last")).where("least.node <> last").select("key", "least")
    keyed = materialize(every.join(shuffled(groups), "key"))
    fits = (F.bit_count(F.col("fp").bitwiseXOR(F.col("least.fp"))) <= WIDE_RADIUS) & (F.least("size", "least.size") >= SIMILARITY * F.greatest("size", "least.size"))
    tried = materialize(keyed.where((F.col("node") != F.col("least.node")) & fits).select(F.col("least.node").alias("a"), F.col("node").alias("b")).distinct())
    found = _alike(tried, sets, docs, id_col, text_col)
    ids = rows.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a <> last").select("doc", "a")
    found = materialize(found.unionByName(rows.join(ids, "doc").select("a", F.col("node").alias("b")).where("a <> b").distinct()))

    parts = materialize(connected_components(found))
    labelled = keyed.select("key", "node", "fp", "size").join(shuffled(parts), "node", "left").select("key", "node", "fp", "size", F.coalesce("component", "node").alias("label"))
    labelled = materialize(labelled)
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = labelled.join(shuffled(open_keys), "key", "left_semi").join(shuffled(sets.select("node", "odd")), "node")
    left = left.repartition(n, "key").sortWithinPartitions("key").select("key", "node", "fp", "size", "label", "odd")
    pair = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    more = materialize(left.mapInArrow(_apart, pair).distinct().join(shuffled(tried), ["a", "b"], "left_anti"))
    parts = connected_components(found.unionByName(_alike(more, sets, docs, id_col, text_col)))
    classes = sets.join(shuffled(parts), "node", "left").groupBy(F.coalesce("component", "node").alias("part")).agg(F.min("at.doc").alias("doc"))
    return _one_row_each(docs, id_col, classes.select("doc"))
