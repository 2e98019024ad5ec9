"""Maximal periodic runs of words, found while a text is read, and texts with the repeats collapsed.

A run is a stretch of words with smallest period q and at least ``min_exponent`` periods that no
neighbouring word extends. Squares are caught online over dyadic blocks:

* Whenever words are appended, the aligned blocks of 2^j words that they complete become catchers, one
  level for every j. A catcher waits for its block to come again at one of the distances of its level.
  The distances of a level follow from the exponent: a repetition of period q repeats (e - 1) q words at
  distance q, which hold an aligned block of b words whole if (e - 1) q >= 2 b - 1. So every period has
  one level, and a word has at most two open catchers at each level (one for an exponent of 4).
* A caught block is extended by comparing words at distance q on both sides. A square whose repeat
  reaches the end of the text stays open, and the words appended next continue the comparison.
* Squares that overlap with one period merge into one stretch, the run. A catch inside a known run at a
  multiple of its period is not extended again (by the theorem of Fine and Wilf it cannot belong to
  another run), so wholly periodic texts cost no more than others: O(n log n) words of work in all.

Blocks meet by 64-bit hashes that double from level to level; equal hashes are only candidates, and
the comparison of words decides, so results are exact.

Words are appended in slices, short texts together, so the working memory beyond the words of the text is that of a slice and
of the open catchers. Documents are independent: nothing is shuffled, and a lost task is one batch.

Defined cases: a null or empty text has no run and collapses to an empty text; texts of any length (one
text must fit a task); rows repeated or with null ids are judged each; an empty table gives an empty
result; other columns are left behind, whatever their names are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import id_and_text, sliced

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SLICE = 1 << 16
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class SquareCatcher:
    """Runs of a growing sequence of word numbers."""

    def __init__(self, min_exponent: int = 2, min_length: int = 2, longest: int | None = None):
        """``longest``: a bound for the length of all runs, if one is known."""
        if min_exponent < 2:
            raise ValueError("a run has two periods at least")
        self.exponent, self.min_length, self.longest = min_exponent, min_length, longest
        self.n = 0
        self.words = np.zeros(64, dtype=np.int64)
        # Of each position: end and period of a run that covers it, the one that reaches furthest.
        self.cover_end = np.full(64, -1, dtype=np.int64)
        self.cover_period = np.ones(64, dtype=np.int64)
        # Of each level: hashes of the blocks at the last positions, as far as catchers are open.
        self.tails: list[np.ndarray] = []
        self.open: dict[int, int] = {}  # period: start of the stretch that reaches the end
        self.seen: dict[int, int] = {}  # period: last position that is equal at this distance
        self.found: dict[tuple[int, int], int] = {}  # (start, last word): smallest period

    def _distances(self, block: int) -> tuple[int, int]:
        e = self.exponent - 1
        return -(-(2 * block - 1) // e), -(-(4 * block - 1) // e) - 1

    def _grow(self, size: int) -> None:
        if size > len(self.words):
            more = max(size, 2 * len(self.words)) - len(self.words)
            self.words = np.concatenate([self.words, np.zeros(more, dtype=np.int64)])
            self.cover_end = np.concatenate([self.cover_end, np.full(more, -1, dtype=np.int64)])
            self.cover_period = np.concatenate([self.cover_period, np.ones(more, dtype=np.int64)])

    def _differs_at(self, i: int, q: int) -> int:
        """First position from ``i`` on that is not equal to the one ``q`` words later."""
        limit, size, w = self.n - q, 32, self.words
        while i < limit:
            stop = min(i + size, limit)
            differ = w[i:stop] != w[i + q : stop + q]
            k = int(differ.argmax())
            if differ[k]:
                return i + k
            i, size = stop, min(2 * size, _SLICE)
        return max(i, limit)

    def _equal_from(self, i: int, q: int) -> int:
        """First position of the stretch before ``i`` in which words are equal at distance ``q``."""
        size, w = 32, self.words
        while i > 0:
            start = max(0, i - size)
            differ = w[start:i][::-1] != w[start + q : i + q][::-1]
            k = int(differ.argmax())
            if differ[k]:
                return i - k
            i, size = start, min(2 * size, _SLICE)
        return 0

    def _note(self, start: int, stop: int, q: int) -> None:
        """Words at ``start`` to ``stop`` (excluded) are equal at distance ``q``, those around are not."""
        self.seen[q] = stop - 1
        if stop + q == self.n:
            self.open[q] = start
        length = stop + q - start
        if length < max(self.exponent * q, self.min_length):
            return
        last = stop + q - 1
        self.found[start, last] = min(q, self.found.get((start, last), q))
        ends = self.cover_end[start : last + 1]
        further = ends < last
        ends[further] = last
        self.cover_period[start : last + 1][further] = q

    def append(self, ids: np.ndarray) -> None:
        """The next words; numbers may be any integers."""
        if not len(ids):
            return
        before, self.n = self.n, self.n + len(ids)
        self._grow(self.n)
        self.words[before : self.n] = ids
        # Open squares: the comparison goes on where the text ended.
        going, self.open = self.open, {}
        for start in going.values():
            self.found.pop((start, before - 1), None)
        for q, start in sorted(going.items()):
            self._note(start, self._differs_at(before - q, q), q)
        left = (self.words[before : self.n].view(np.uint64) + np.uint64(1)) * _MIX[0]
        first, block, level = before, 1, 0
        while block <= self.n:
            low, high = self._distances(block)
            if self.longest is not None and low * self.exponent > self.longest:
                break
            if level == len(self.tails):
                self.tails.append(np.zeros(0, dtype=np.uint64))
            tail = self.tails[level]
            hashes = np.concatenate([tail, left]) if len(tail) else left
            if low <= high and self.n - block >= low:
                self._catch(hashes, first - len(tail), first, block, low, high)
            keep = max(high, block)
            self.tails[level] = hashes[-keep:].copy() if len(hashes) > keep else hashes
            # Hashes of blocks of twice the size: they end with the new words too.
            start, offset = max(0, before - 2 * block + 1), first - len(tail)
            stop = self.n - 2 * block + 1
            if stop > start:
                a = hashes[start - offset : stop - offset]
                b = hashes[start - offset + block : stop - offset + block]
                left = ((a ^ (a >> np.uint64(29))) * _MIX[0]) + ((b ^ (b >> np.uint64(32))) * _MIX[1])
            first, block, level = start, 2 * block, level + 1

    def _catch(self, hashes, offset: int, first: int, block: int, low: int, high: int) -> None:
        """Blocks that end with the appended words, against the open catchers of a level."""
        at = np.arange(first, offset + len(hashes), dtype=np.int64)
        new = hashes[first - offset :]
        caught = []
        for back in range(0, high - low + 1, block):
            catcher = ((at - low) & -block) - back
            valid = (catcher >= 0) & (at - catcher <= high)
            # Positions that have no catcher look at themselves and are left out.
            other = hashes[np.where(valid, catcher, at) - offset]
            hit = np.flatnonzero(valid & (other == new))
            if len(hit):
                caught.append(np.stack([catcher[hit], at[hit] - catcher[hit]]))
        if not caught:
            return
        hits = np.concatenate(caught, axis=1)
        if len(caught) > 1:
            hits = hits[:, np.lexsort((hits[1], hits[0]))]
        c, q = hits
        known = (self.cover_end[c] >= c + q + block - 1) & (q % self.cover_period[c] == 0)
        for start, period in hits[:, ~known].T.tolist():
            if start <= self.seen.get(period, -1):
                continue
            inside = self.cover_end[start] >= start + period + block - 1
            if inside and period % self.cover_period[start] == 0:
                continue
            stop = self._differs_at(start, period)
            if stop - start >= block:
                self._note(self._equal_from(start, period), stop, period)

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs of the words so far, by start, then period."""
        return sorted(
            ((start, last - start + 1, q) for (start, last), q in self.found.items()),
            key=lambda r: (r[0], r[2]),
        )


def word_runs(
    texts: list[list[str]], min_exponent: int, min_length: int
) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text.

    The texts are appended one after the other, each followed by a number that comes once: no repeat
    holds it, so none crosses from one text to the next.
    """
    index = {w: i for i, w in enumerate(dict.fromkeys(w for words in texts for w in words))}
    ends = np.cumsum([len(words) + 1 for words in texts])
    ids = np.empty(int(ends[-1]) if len(texts) else 0, dtype=np.int64)
    for n, (words, end) in enumerate(zip(texts, ends.tolist())):
        ids[end - 1 - len(words) : end - 1] = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        ids[end - 1] = -1 - n
    catcher = SquareCatcher(min_exponent, min_length, max(map(len, texts), default=0))
    for start in range(0, len(ids), _SLICE):
        catcher.append(ids[start : start + _SLICE])
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in catcher.runs():
        n = int(np.searchsorted(ends, start, side="right"))
        runs[n].append((start - (int(ends[n - 1]) if n else 0), length, period))
    return runs


def _groups(texts: list[str | None]):
    """Words of the texts, in groups of about a slice."""
    group, size = [], 0
    for text in texts:
        group.append(_WORD.findall(text or ""))
        size += len(group[-1]) + 1
        if size >= _SLICE:
            yield group
            group, size = [], 0
    yield group


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words without those that a run holds after its first period."""
    if runs:
        kept = np.ones(len(words), dtype=bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return " ".join(words)


RUNS = "array<struct<start: long, length: long, period: long>>"
_ARROW_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def periodic_runs(
    docs: DataFrame,
    min_exponent: int = 4,
    min_length: int = 6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, runs (by start, then period), text (collapsed, words joined by one space)."""

    def rows(batches):
        for batch in sliced(batches):
            all_runs, texts = [], []
            for group in _groups(batch.column("text").to_pylist()):
                for words, runs in zip(group, word_runs(group, min_exponent, min_length)):
                    texts.append(collapsed(words, runs))
                    all_runs.append([dict(zip(("start", "length", "period"), r)) for r in runs])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(all_runs, type=_ARROW_RUNS), pa.array(texts, type=pa.string())],
                names=["doc_id", "runs", "text"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(rows, f"doc_id long, runs {RUNS}, text string")
