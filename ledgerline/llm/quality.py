"""Quality classifier: an additive model of feature tables and pairwise interaction tables.

The model is a sum of look-up tables over binned features of a text. It is fitted
by cyclic boosting: the features take turns, each turn fits a tree of at most
three cuts to the gradients of that one feature's bins and adds the tree's leaf
values to the feature's table. The pairs of features whose joint bins explain
most of what is left then take turns in the same way, with trees that cut each
of the two features once. A text is scored by looking up one entry per table and
adding them.

Features are shares and counts that numpy takes over the bytes of whole batches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import chunks, fresh, mix, utf8, words_of

#: At most so many labelled rows are learnt from: those whose ids have the smallest hashes.
SAMPLE_ROWS = 20_000
BINS = 32
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 60, 6
RATE, SMOOTH = 0.15, 1.0
#: Scores from here on count as good.
THRESHOLD = 0.3

FEATURES = [
    "log_words", "log_lines", "word_bytes", "upper_share", "mark_share", "odd_mark_share", "digit_share", "wide_share", "space_share",
    "title_words", "lone_marks", "mark_ended", "again_share", "distinct_share", "short_words", "longest_word",
]

_UPPER, _LOWER, _DIGIT, _MARK, _ODD = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_ODD[:] = _MARK
_ODD[[ord(c) for c in ".,;:'\"-?()"]] = False


def _per_text(sums: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return (sums[edges[1:]] - sums[edges[:-1]]).astype(np.float64)


def _running(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros_like(part, dtype=np.float64), where=whole > 0)


def features(column: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` per text; null and empty texts have zeros."""
    raw, offsets = utf8(column)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for a, b in chunks(offsets):
        low, edges = offsets[a], offsets[a : b + 1] - offsets[a]
        part = raw[low : offsets[b]]
        starts, ends, hashes, first = words_of(part, edges)
        size, words = np.diff(edges).astype(np.float64), np.diff(first).astype(np.float64)
        upper, lower, marks = (_per_text(_running(t[part]), edges) for t in (_UPPER, _LOWER, _MARK))
        long = ends - starts
        head, tail = part[starts], part[ends - 1]
        text = np.repeat(np.arange(b - a), np.diff(first))
        again = np.zeros(len(starts), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
        own = mix(hashes ^ mix(text.astype(np.uint64)))
        order = np.argsort(own, kind="stable")
        new = np.zeros(len(own), bool)
        new[order[:1]] = True
        new[order[1:]] = own[order[1:]] != own[order[:-1]]
        longest = np.zeros(b - a)
        if len(long):
            np.maximum.at(longest, text, long)
        of_words = lambda flags: _share(_per_text(_running(flags), first), words)  # noqa: B023, E731
        out[a:b] = np.column_stack([
            np.log1p(words), np.log1p(_per_text(_running(part == 10), edges)), _share(_per_text(_running(long), first), words), _share(upper, upper + lower),
            _share(marks, size), _share(_per_text(_running(_ODD[part]), edges), size), _share(_per_text(_running(_DIGIT[part]), edges), size),
            _share(_per_text(_running(part >= 128), edges), size), _share(size - _per_text(_running(long), first), size),
            of_words(_UPPER[head]), of_words((long == 1) & _MARK[head]), of_words(_ODD[tail]), of_words(again), of_words(new), of_words(long <= 3), np.log1p(longest),
        ])
    return out


@dataclass
class Model:
    """Cut points per feature, a table of bin values per feature and per pair, and a constant."""

    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: one addition per table."""
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[b[:, j]]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SMOOTH)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of consecutive bins (0: none)."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    best = int(np.argmax(gains))
    return float(gains[best]), best + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values over the bins of a tree of ``depth`` levels."""
    gain, cut = _best_cut(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), -g.sum() / (h.sum() + SMOOTH))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best pair of cuts, one along each axis: its gain and the values of the four quarters."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    quarter = lambda c: (a := c[:-1, :-1], c[:-1, -1:] - a, c[-1:, :-1] - a, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + a)
    gains = sum(_gain(x, y) for x, y in zip(quarter(cg), quarter(ch), strict=True)) - _gain(cg[-1, -1], ch[-1, -1])
    r, c = np.unravel_index(int(np.argmax(gains)), gains.shape)
    out = np.zeros_like(g)
    for rows in (slice(0, r + 1), slice(r + 1, None)):
        for cols in (slice(0, c + 1), slice(c + 1, None)):
            out[rows, cols] = -g[rows, cols].sum() / (h[rows, cols].sum() + SMOOTH)
    return float(gains[r, c]), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> Model:
    """Fit to rows ``x`` with labels ``y`` (0 or 1). No rows give a model that scores 0.5; one class gives its smoothed share."""
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        if len(values) > bins:
            values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]))
            cuts.append(values)
        else:
            cuts.append((values[1:] + values[:-1]) / 2)
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(cuts, [np.zeros(len(c) + 1) for c in cuts], base=float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    b = model.bins(x)
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b[:, j], g, len(table)), np.bincount(b[:, j], h, len(table)))
            table += step
            total += step[b[:, j]]
    joint = lambda i, j, w: np.bincount(b[:, i] * len(model.tables[j]) + b[:, j], w, len(model.tables[i]) * len(model.tables[j])).reshape(len(model.tables[i]), -1)
    g, h = slopes()
    found = [(_quadrants(joint(i, j, g), joint(i, j, h))[0], i, j) for i in range(x.shape[1]) for j in range(i + 1, x.shape[1])]
    model.pairs = [(i, j) for gain, i, j in sorted(found, key=lambda f: (-f[0], f[1:]))[:pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step = RATE * _quadrants(joint(i, j, g), joint(i, j, h))[1]
            table += step
            total += step[b[:, i], b[:, j]]
    return model


def held_out(doc_id: Column) -> Column:
    """True for rows that nothing is learnt from: crc32 of the id as text is divisible by 5 (null ids too)."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit the model to labelled rows that are not held out.

    Only the text is an input. At most ``sample_rows`` rows are learnt from,
    chosen by a hash of the id. Labels that are null are skipped; an id with
    several labels counts by their mean. Repeated documents count as often as
    they occur, within the bound.
    """
    by = F.xxhash64(F.col("label_id").cast("string"))
    chosen = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("label")).where(F.col("label").isNotNull() & ~held_out(F.col("label_id")))
    chosen = chosen.groupBy("label_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    n = chosen.count()
    if n > 8 * sample_rows:  # the smallest hashes are among the lowest share of all hashes, so few rows need be ordered
        chosen = chosen.where(by < F.lit(int(-(1 << 63) + 4 * sample_rows / n * (1 << 64))))
    chosen = chosen.orderBy(by, "label_id").limit(sample_rows)

    @F.arrow_udf("array<double>")
    def measured(text: pa.Array) -> pa.Array:
        x = features(text)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))

    rows = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).cast("string").alias("body"))
    rows = rows.join(F.broadcast(chosen), F.col("own_id") == F.col("label_id"))  # at most sample_rows rows
    rows = rows.select("label_id", "label", measured("body").alias("x")).orderBy(by, "label_id", "x").limit(sample_rows)
    got = rows.select("label", "x").toArrow()
    x = got["x"].combine_chunks()
    x = np.asarray(x.flatten()).reshape(-1, len(FEATURES)) if len(x) else np.zeros((0, len(FEATURES)))
    return fit(x, np.asarray(got["label"].to_numpy(), dtype=np.float64))


def scorer(model: Model):
    """The model as a column function of a text column."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.score(features(text)))

    return score


def score_quality(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``quality_score`` (an underscore appended to a name already taken): 0 to 1, higher for likelier good.

    Null and empty texts are scored as texts without words. Every row stays;
    equal texts get equal scores. An empty table gives an empty one.
    """
    return docs.withColumn(fresh(docs, "quality_score"), scorer(model)(F.col(text_col).cast("string")))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; columns stay as they are."""
    model = train(docs, labels, id_col, text_col)
    return docs.where(scorer(model)(F.col(text_col).cast("string")) >= threshold)
