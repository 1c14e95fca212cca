"""Periodic runs of words, and texts with their repetitions collapsed.

A run is a maximal stretch of words with smallest period q that holds it at least twice. Its
Lyndon root under one of the two orders of the words, the given or the opposite one, is the
longest Lyndon word from its first word on, so that the next smaller suffixes under both orders
name every run (Ellert and Fischer, 2021). `next_smaller` finds them from left to right on any ordered
alphabet: a stack of previous smaller suffixes, whose matched lengths decide most comparisons
without looking at words; the pair of suffixes matched furthest right is kept, and while the
scan is inside that stretch, what was found in its earlier copy holds again. Words are
compared only beyond the furthest place matched so far, so their number grows with the text alone.
No suffix array, suffix tree or fingerprint is made.

Words become numbers by sorting their bytes, exactly. Before that scan a text is cut at words that occur
once: every word of a run occurs in it twice, so no run holds such a word; pieces are cut again
until nothing changes. That drops no run and leaves little of ordinary prose.

One pass over the rows, no shuffle; memory is bound by a batch's piece or the longest text.

Defined results: a null or empty text has no words, no runs and an empty collapsed text; repeated
rows are each answered; rows without an id are kept; an empty table gives an empty table; of the
input only the columns to keep are returned, and an output column replaces one of its name.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.common import SPACES, arrow_map, text_bytes, word_spans

#: Words of the shortest run that counts.
LEAST_WORDS = 12
#: Blocks of 8 bytes by which words are sorted at once; longer words are sorted as byte strings.
BLOCKS = 16

RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])

# ------------------------------------------------------------------ Lyndon array


def next_smaller(s: list[int]) -> tuple[list[int], list[int], int]:
    """For every suffix the next smaller one (len(s) if none), how many symbols the two share, and how many symbols
    were compared in all. The end is smaller than any symbol."""
    n, looked = len(s), 0
    nss, nlce = [n] * n, [0] * n
    pss, plce, most = [-1] * n, [0] * n, [0] * n
    a = b = end = 0  # s[a : a + end - b] equals s[b : end], and no match reached further right
    for r in range(1, n):
        shift, inside = b - a, r < end
        if inside:
            q = r - shift
            if r + most[q] < end and pss[q] >= a:  # all comparisons of q ended inside the copy: those of r end alike
                p = pss[q] + shift
                l = r - 1
                while l != p:
                    nss[l], nlce[l] = r, nlce[l - shift]
                    l = pss[l]
                pss[r], plce[r], most[r] = p, plce[q], most[q]
                continue
        l, e, top = r - 1, 0, 0
        while True:
            if inside and r + e < end and l >= b:  # the copies of l and r were compared
                k = l - shift
                known = nlce[k] if nss[k] == q else plce[q] if pss[q] == k else 0
                e = max(e, min(known, end - r))
            begun = e
            while r + e < n and s[l + e] == s[r + e]:
                e += 1
            looked += e - begun + 1
            if r + e > end:
                a, b, end = l, r, r + e
                inside = False
            if e > top:
                top = e
            if r + e < n and s[l + e] < s[r + e]:
                pss[r], plce[r] = l, e
                break
            # the suffix at r is smaller, and so than every one that shares more with l
            nss[l], nlce[l] = r, e
            while plce[l] > e:
                l = pss[l]
                nss[l], nlce[l] = r, e
            before = pss[l]
            if before < 0:
                break
            if plce[l] < e:
                pss[r], plce[r] = before, plce[l]
                break
            l = before
        most[r] = top
    return nss, nlce, looked


def _shared_before(s: np.ndarray, i: int, j: int, limit: int) -> int:
    """How many symbols before i equal those before j, up to limit; i < j."""
    total, step, limit = 0, 16, min(limit, i)
    while total < limit:
        m = min(step, limit - total)
        other = np.flatnonzero(s[i - total - m : i - total] != s[j - total - m : j - total])
        if len(other):
            return total + m - 1 - int(other[-1])
        total, step = total + m, step * 2
    return total


def runs_of(symbols: np.ndarray, least: int = LEAST_WORDS) -> set[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least so many symbols."""
    n, out = len(symbols), set()
    if n < max(least, 2):
        return out
    for sign in (1, -1):
        nss, nlce, _ = next_smaller((symbols * sign).tolist())
        after, e = np.array(nss), np.array(nlce)
        i = np.flatnonzero(after < n)
        p, e_i = after[i] - i, e[i]
        need = np.maximum(np.maximum(least - p, p) - e_i, 0)
        possible = (need <= np.minimum(i, p - 1)) & (e_i + 2 * p > least)
        # the first and the last of the symbols that must match before
        for back in (np.ones(len(i), int), need):
            at = np.maximum(i - back, 0)
            possible &= (need == 0) | (symbols[at] == symbols[np.minimum(at + p, n - 1)])
        # the root one period before names the same run
        j = np.maximum(i - p, 0)
        possible &= ~((i >= p) & (after[j] == i) & (e[j] >= p))
        for k in np.flatnonzero(possible):
            at, period, ahead = int(i[k]), int(p[k]), int(e_i[k])
            behind = _shared_before(symbols, at, at + period, period)
            length = behind + period + ahead
            if length >= max(least, 2 * period):
                out.add((at - behind, length, period))
    return out


# ------------------------------------------------------------------ words of texts


def numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words only: words are sorted 8 bytes at a time."""
    n, lengths = len(starts), ends - starts
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))

    def block(which: np.ndarray, k: int) -> np.ndarray:
        rest = np.minimum(lengths[which] - 8 * k, 8).astype(np.uint64)
        return eight[starts[which] + 8 * k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - rest * np.uint64(8)))

    ids, count = _ranks(block(np.arange(n), 0))
    active = np.flatnonzero(lengths > 8)
    for k in range(1, BLOCKS):
        if not len(active):
            break
        value, _ = _ranks(block(active, k))
        pair, more = _ranks(ids[active] * np.int64(len(active)) + value)
        ids[active] = count + pair
        count += more
        active = active[lengths[active] > 8 * (k + 1)]
    if len(active):
        last, number = None, count - 1
        for text, w in sorted((data[starts[w] : ends[w]].tobytes(), w) for w in active.tolist()):
            number += text != last
            ids[w], last = number, text
        count = number + 1
    if not data.all():  # a zero byte at a word's end looks like the block's filling
        ids, _ = _ranks(ids * np.int64(int(lengths.max()) + 1) + lengths)
    return ids


def _ranks(values: np.ndarray) -> tuple[np.ndarray, int]:
    distinct, place = np.unique(values, return_inverse=True)
    return place.astype(np.int64), len(distinct)


def pieces_with_repeats(ids: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first, end) word places of the stretches that can hold runs: no word of one is the only one of its kind in it.
    ids: the words' numbers; text: the text of each."""
    if not len(ids):
        return []
    at, part = np.arange(len(ids)), text.astype(np.int64)
    kinds = int(ids.max()) + 1
    while True:
        key = part * kinds + ids[at]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1], [True]])
        single = np.zeros(len(at), bool)
        single[order] = new[:-1] & new[1:]
        kept, part = at[~single], part[~single]
        cut = np.concatenate([[True], (np.diff(kept) != 1) | (part[1:] != part[:-1])])[: len(kept)]
        piece = np.cumsum(cut) - 1
        sizes = np.bincount(piece) if len(kept) else np.zeros(0, int)
        long = sizes[piece] >= least if len(kept) else np.zeros(0, bool)
        before, at, part = len(at), kept[long], piece[long]
        if not len(at):
            return []
        if len(at) == before:
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            ends = np.concatenate([first[1:], [len(at)]])
            return [(int(at[f]), int(at[e - 1]) + 1) for f, e in zip(first, ends, strict=True)]


def text_runs(data: np.ndarray, offsets: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, dict[int, list[tuple[int, int, int]]]]:
    """The number of words of each text, and by text its runs by start and period, starts counted in its words."""
    starts, ends, first = word_spans(_INSIDE[data], offsets)
    counts = np.diff(first)
    ids = numbers(data, starts, ends)
    found: dict[int, list[tuple[int, int, int]]] = {}
    bounds = first.tolist()
    for a, b in pieces_with_repeats(ids, np.repeat(np.arange(len(counts)), counts), least):
        _, symbols = np.unique(ids[a:b], return_inverse=True)
        doc = bisect_right(bounds, a) - 1
        found.setdefault(doc, []).extend((s + a - bounds[doc], length, q) for s, length, q in runs_of(symbols.astype(np.int64), least))
    return counts, {d: sorted(r, key=lambda x: (x[0], x[2])) for d, r in found.items()}


_INSIDE = np.ones(256, bool)
_INSIDE[SPACES] = False


def collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> str:
    """The words joined by spaces, without those that follow the first period of some run."""
    words = text.split()  # at the same bytes as SPACES
    if runs:
        dropped = bytearray(len(words))
        for start, length, q in runs:
            dropped[start + q : start + length] = b"\x01" * (length - q)
        words = [w for w, d in zip(words, dropped, strict=True) if not d]
    return b" ".join(words).decode("utf-8")


def find(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, least: int = LEAST_WORDS) -> DataFrame:
    """The kept columns (all), and n_words, runs (start, length, period; by start, then period) and collapsed."""
    new = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

    def make() -> Callable[[pa.RecordBatch], list]:
        def work(batch: pa.RecordBatch) -> list:
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            counts, found = text_runs(data, offsets, least)
            listed = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found.get(d, [])] for d in range(len(counts))]
            whole = data.tobytes()
            kept = [collapsed(whole[offsets[d] : offsets[d + 1]], found.get(d, [])) for d in range(len(counts))]
            return [counts, listed, kept]

        return work

    return arrow_map(docs, text_col, docs.columns if keep is None else keep, new, make)
