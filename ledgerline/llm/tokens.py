"""Token ids of whole texts for byte-level BPE vocabularies.

Texts are cut where white space follows other characters. The vocabulary's
pattern always parts pieces there, so every chunk has the same ids wherever it
stands, and each distinct chunk of a batch is encoded once.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import tiktoken

from ledgerline.llm.common import BYTE_POWERS, WORD_SPACE

#: Fixed value: the pattern that byte-level BPE files with ``use_regex`` part texts by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunks that a Python worker remembers at a time; beyond it the memory starts anew.
REMEMBERED = 1_000_000


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such files: printable Latin-1 characters are themselves, others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class ByteBPE:
    """Encoder of a ``tokenizers`` file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in piece): rank for piece, rank in spec["model"]["vocab"].items() if piece not in special}
        self.core = tiktoken.Encoding("from_file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            self.width[rank] = len(piece)
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[int, int] = {}
        self.first, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def _remember(self, keys: list[int], ids: np.ndarray, counts: np.ndarray) -> None:
        a, n = len(self.rows), len(self.rows) + len(keys)
        while n > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[a:n] = self.used + np.cumsum(counts) - counts
        self.count[a:n] = counts
        self.used += len(ids)
        self.rows.update(zip(keys, range(a, n), strict=True))

    def encode(self, raw: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive UTF-8 texts, ``end_id`` after each if given, and the first id's place of each text (one more at the end)."""
        n, texts = len(raw), len(offsets) - 1
        if len(self.rows) > REMEMBERED:
            self._forget()
        space = WORD_SPACE[raw]
        # part[i]: a text that ends before byte i, or goes on there with white space, can be parted there
        part = np.zeros(n + 1, bool)
        part[1:] = ~space
        part[2:] &= raw[:-1] != 0xC2  # the byte before may end a wide white space
        part[3:] &= (raw[:-2] < 0xE1) | (raw[:-2] > 0xE3)
        cut = np.zeros(n + 1, bool)
        cut[1:n] = part[1:n] & space[1:]
        cut[offsets] = True
        cut[n] = False
        starts = np.flatnonzero(cut)
        ends = np.r_[starts[1:], n]
        sums = BYTE_POWERS.sums(raw.astype(np.uint64) + np.uint64(1))
        keys, where, back = np.unique(BYTE_POWERS.slices(sums, starts, ends), return_index=True, return_inverse=True)
        names = keys.tolist()
        new = np.array([i for i, k in enumerate(names) if k not in self.rows], np.int64)
        if len(new):
            a, b = starts[where[new]], ends[where[new]]
            plain = space[a] & part[b]
            for i, s, e in zip(new[~plain].tolist(), a[~plain].tolist(), b[~plain].tolist(), strict=True):
                ids = np.array(self.core.encode_ordinary(raw[s:e].tobytes().decode("utf-8")), np.uint32)
                self._remember([names[i]], ids, np.array([len(ids)]))
            new, a, b = new[plain], a[plain], b[plain]
            if len(new):
                ids = np.array(self.core.encode_ordinary(raw[ragged(a, b - a)].tobytes().decode("utf-8")), np.uint32)
                upto = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(b - a), side="left") + 1
                self._remember([names[i] for i in new.tolist()], ids, np.diff(upto, prepend=0))
        row = np.fromiter(map(self.rows.__getitem__, names), np.int64, len(names))[back]
        counts = self.count[row]
        ids = self.flat[ragged(self.first[row], counts)]
        before = np.r_[0, np.cumsum(counts)][np.searchsorted(starts, offsets)]
        if end_id is None:
            return ids, before
        out = np.full(len(ids) + texts, end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(texts), np.diff(before))] = ids
        return out, before + np.arange(texts + 1)


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)
