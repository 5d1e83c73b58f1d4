"""Periodic runs of words: every maximal stretch that repeats with a small period.

A run is a stretch of consecutive words with smallest period q, at least ``LEAST`` words and
``TIMES`` periods long, that no neighbouring word extends. Every run contains a Lyndon word of
length q that is the longest one at its place in one of the two orders of the words, so a scan
from right to left with a stack of Lyndon words, done under both orders, meets every run.
Suffixes are compared, and runs extended to both sides, by the longest common extension:
the first words directly, then a binary search over rolling hashes modulo 2**61 - 1. Every run
found is verified word by word; should hashes have collided, the stretch is done again with
another base.

Only words that can belong to a run are scanned: in a run every ``GRAM`` consecutive words occur
once more, so stretches of repeated GRAM-grams contain all runs, whole and with the word on either
side. The rest of a text costs one sort of its GRAM-grams. Each text is one row; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import fresh, mix

LEAST, TIMES, GRAM = 24, 3, 8
SPACES = r"[\x20\x09-\x0D]+"
PRIME = (1 << 61) - 1
BASES = [1_000_000_007 * 1_000_003 % PRIME, 998_244_353 * 7_368_787 % PRIME, 0x9E3779B97F4A7C15 % PRIME]
_FACTORS = mix(np.arange(1, GRAM + 1, dtype=np.uint64)) | np.uint64(1)

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
FACTS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])


class Collision(Exception):
    """Different words had the same hash."""


class Extensions:
    """Longest common extensions of a sequence of numbered words."""

    def __init__(self, ids: list[int], base: int):
        self.ids, self.n = ids, len(ids)
        sums, powers, h, p = [0], [1], 0, 1
        for x in ids:
            h = (h * base + x + 1) % PRIME
            p = p * base % PRIME
            sums.append(h)
            powers.append(p)
        self.sums, self.powers = sums, powers

    def same(self, i: int, j: int, size: int) -> bool:
        s = self.sums
        return (s[i + size] - s[j + size] - (s[i] - s[j]) * self.powers[size]) % PRIME == 0

    def right(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on, i < j."""
        ids, most = self.ids, self.n - j
        near = min(most, GRAM)
        for k in range(near):
            if ids[i + k] != ids[j + k]:
                return k
        low, step = near, GRAM
        while low + step <= most and self.same(i + low, j + low, step):
            low, step = low + step, 2 * step
        past = min(most, low + step - 1)
        while low < past:
            mid = (low + past + 1) // 2
            low, past = (mid, past) if self.same(i, j, mid) else (low, mid - 1)
        if low < most and ids[i + low] == ids[j + low]:
            raise Collision
        return low

    def left(self, i: int, j: int) -> int:
        """How many words before i equal those before j, i < j."""
        ids, most = self.ids, i
        near = min(most, GRAM)
        for k in range(1, near + 1):
            if ids[i - k] != ids[j - k]:
                return k - 1
        low, step = near, GRAM
        while low + step <= most and self.same(i - low - step, j - low - step, step):
            low, step = low + step, 2 * step
        past = min(most, low + step - 1)
        while low < past:
            mid = (low + past + 1) // 2
            low, past = (mid, past) if self.same(i - mid, j - mid, mid) else (low, mid - 1)
        if low < most and ids[i - low - 1] == ids[j - low - 1]:
            raise Collision
        return low


def lyndon_ends(words: Extensions, falling: bool) -> list[int]:
    """Where the longest Lyndon word that starts at each place ends; ``falling`` reverses the order of the words, not that a prefix comes first."""
    ids, n = words.ids, words.n
    ends = [0] * n
    for i in range(n - 1, -1, -1):
        a, j = ids[i], i + 1
        while j < n:  # the stack: Lyndon words that follow one another from j on
            b = ids[j]
            if a == b:
                same = words.right(i, j)
                if j + same == n:
                    break
                if (ids[j + same] < ids[i + same]) != falling:
                    break
            elif (b < a) != falling:
                break
            j = ends[j]
        ends[i] = j
    return ends


def _runs(ids: list[int], base: int, least: int, times: int) -> set[tuple[int, int, int]]:
    words, found = Extensions(ids, base), set()
    n = words.n
    for falling in (False, True):
        latest: dict[int, tuple[int, int]] = {}
        for i, end in reversed(list(enumerate(lyndon_ends(words, falling)))):
            q = end - i
            if end + q > n or ids[i] != ids[end] or ids[end - 1] != ids[end + q - 1]:
                continue
            start, past = latest.get(q, (n, n))
            if start <= i and end + q <= past:
                continue  # the run just found
            after = words.right(i, end)
            if after < q:
                continue
            start, past = i - words.left(i, end), end + after
            latest[q] = start, past
            if past - start >= max(least, times * q):
                found.add((start, past - start, q))
    for start, length, q in found:
        past = start + length
        if ids[start : past - q] != ids[start + q : past] or start and ids[start - 1] == ids[start + q - 1] or past < n and ids[past] == ids[past - q]:
            raise Collision
    return found


def runs_of(ids: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a sequence of numbered words, by start, then period. ``least`` must be 3 * GRAM or more and ``times`` 3 or more."""
    found: list[tuple[int, int, int]] = []
    for first, past in repeated_stretches(ids):
        for base in BASES:
            try:
                found += [(first + s, n, q) for s, n, q in _runs(ids[first:past], base, least, times)]
                break
            except Collision:
                continue
        else:
            raise Collision(f"words {first} to {past} collide under every base")
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated_stretches(ids: list[int]) -> Iterator[tuple[int, int]]:
    """Stretches (first, past) of words in which every GRAM-gram occurs elsewhere in the text, with one word more on either side; none that is too short for a run."""
    n = len(ids) - GRAM + 1
    if n < 2 * GRAM:
        return
    numbers = np.array(ids, dtype=np.uint64) + np.uint64(1)
    grams = np.zeros(n, np.uint64)
    for k in range(GRAM):
        grams += numbers[k : k + n] * _FACTORS[k]
    order = np.argsort(grams)
    equal = grams[order[1:]] == grams[order[:-1]]
    if not equal.any():
        return
    again = np.zeros(n + 2, np.int8)
    again[order[1:][equal] + 1] = again[order[:-1][equal] + 1] = 1
    edges = np.diff(again)
    for x, y in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):  # grams x to y - 1
        if y - x >= 3 * GRAM - GRAM + 1:
            yield max(0, x - 1), min(len(ids), y + GRAM)


def facts_of(text: str | None) -> tuple[int, list[tuple[int, int, int]], str]:
    words = (text or "").encode("utf-8").split()  # at bytes 9 to 13 and 32
    numbers: dict[bytes, int] = {}
    runs = runs_of([numbers.setdefault(w, len(numbers)) for w in words]) if len(words) >= LEAST else []
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        left = [words[i] for i in np.flatnonzero(kept).tolist()]
    else:
        left = words
    return len(words), runs, b" ".join(left).decode("utf-8")


@F.arrow_udf(FACTS)
def period_facts(text: pa.Array) -> pa.Array:
    """n_words; runs: all runs by start, then period; collapsed: the words that no run repeats, joined by one space. A null text counts as empty and has no words."""
    counts, sizes, runs, left = [], [0], [], []
    for one in text:
        n, found, collapsed = facts_of(one.as_py())
        counts.append(n)
        runs += found
        sizes.append(len(runs))
        left.append(collapsed)
    columns = np.array(runs, dtype=np.int64).reshape(-1, 3).T
    listed = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=RUN.names))
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), listed, pa.array(left, pa.string())], names=FACTS.names)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared without division; ties go to the smallest start, then period. Null without runs."""

    def order(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        ranks = [(x > y, -1), (x < y, 1), (a["start"] < b["start"], -1), (a["start"] > b["start"], 1), (a["period"] < b["period"], -1), (a["period"] > b["period"], 1)]
        out = F.lit(0)
        for when, sign in reversed(ranks):
            out = F.when(when, sign).otherwise(out)
        return out

    return F.get(F.array_sort(runs, order), F.lit(0))


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, runs and collapsed; columns of these names are replaced. Repeated rows stay and have equal values; an empty table gives no rows."""
    facts = fresh(docs, "facts")
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_words", "runs", "collapsed")]
    return docs.withColumn(facts, period_facts(F.col(f"`{text}`").cast("string"))).select(*own, f"{facts}.*")


def made_periodic(doc_id: Column, words: str) -> Column:
    """The text of a row of op12 whose id is chosen for it: from word a on, word i becomes word a + (i - a) % p. ``words`` names the column of words."""
    h = F.crc32(doc_id.cast("string"))
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = g % n
    p = F.lit(1).cast("long") + F.floor((n - a) / (3 + g % 8))
    return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at(words, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int"))), " ")


def run_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The contract of op12: texts of every tenth hash of ``key`` made periodic, then per row the strongest run and digests of all runs and of the collapsed text.

    Null texts have no words, hence no runs, and the digests of nothing; texts with a null key stay as they are.
    """
    rows = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    chosen = F.crc32(F.col("doc").cast("string")) % 10 == 0
    rows = rows.withColumn("words", F.when(chosen, F.array_remove(F.split("text", SPACES), "")))
    rows = rows.select("doc", F.when(F.size("words") > 0, made_periodic(F.col("doc"), "words")).otherwise(F.col("text")).alias("text"))
    found = find_runs(rows).withColumn("best", strongest(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        F.col("doc").alias(key), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
