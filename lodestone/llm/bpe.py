"""BPE encoding and decoding by a pair occurrence index.

Each piece of a partition collects its distinct pre-tokens, lays their symbols
out in one array with left/right links, and indexes every adjacent pair that has
a merge rank by all its positions. A heap holds the active ranks; the lowest is
taken, all its occurrences are merged, and only the lists of pairs next to a
merge are updated. Results are kept in a cache per worker, bounded in bytes, of two
generations: words not met for a generation go, so a frequent word's
merges run about once a worker, not once an occurrence.

Defined results: a null text encodes as the empty text (no ids, decoded "");
texts are handled whole, whatever their length; rows with equal texts get equal
results; an empty table gives an empty table; extra columns are kept if named in
`keep`, and a new column replaces an input column of the same name. Special
tokens' strings in a text become their ids, as the library does by default.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.common import arrow_map

#: Bytes of chunks (runs without white space) and their ids in one generation of a worker's cache, with
#: `ENTRY_BYTES` for each entry; chunks longer than `LONG_CHUNK` characters are not kept.
CACHE_BYTES, ENTRY_BYTES, LONG_CHUNK = 60_000_000, 200, 1000

#: Rows decoded at once.
DECODE_ROWS = 500

# Unicode White_Space, as the vocabulary's normalizer reads \s.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANKS = regex.compile(f"[{WHITE}]+")
#: str.split() would also split at these, which are not white space here.
_NOT_WHITE = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A tokenizer file of the kind: normalizer, one split pattern, byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        named = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.tokens = [named.get(i) for i in range(max(named) + 1)]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.split = regex.compile(split.replace(r"\s", WHITE))
        self.split_lines = regex.compile(f"(?:{self.split.pattern})|\n")
        self.by_lines = not any("\n" in t for t in self.split.findall("a\n1\n.\n\n b"))  # no pre-token crosses a line
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.merges: dict[tuple[int, int], int] = {}
        self.made: list[tuple[int, int, int]] = []  # by rank: left, right, result
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((self.ids[a], self.ids[b]), len(self.made))
            self.made.append((self.ids[a], self.ids[b], self.ids[a + b]))
        codes = np.array([(a << 32) | b for a, b in self.merges], np.int64)
        order = np.argsort(codes)
        self.pair_codes, self.pair_ranks = codes[order], np.array(list(self.merges.values()), np.int64)[order]
        last = {ab: rank for rank, (_, _, ab) in enumerate(self.made)}
        self.ordered = all(max(last.get(a, -1), last.get(b, -1)) < rank for (a, b), rank in self.merges.items())
        bytes_as = byte_symbols()
        self.inner = np.array([self.ids.get(s, -1) for s in bytes_as], np.int32)
        self.final = np.array([self.ids.get(s + self.suffix, -1) for s in bytes_as], np.int32)
        self.young: dict[str, bytes] = {}  # the cache's two generations
        self.old: dict[str, bytes] = {}
        self.young_bytes = 0

    def split_chunks(self, chunks: list[str]) -> list[list[str]]:
        """Normalised pre-tokens of each chunk."""
        lines = "\n".join(chunks)
        unknown = set() if lines.isascii() else {c for c in set(lines) if unicodedata.category(c) == "Cn"}
        if unknown or not self.by_lines:  # few have any
            return [self.pre_tokens(c) if unknown & set(c) else self.split.findall(self.normalize(c)) for c in chunks]
        out: list[list[str]] = [[]]
        for token in self.split_lines.findall(self.normalize(lines)):
            if token == "\n":
                out.append([])
            else:
                out[-1].append(token)
        return out

    def pre_tokens(self, chunk: str) -> list[str]:
        """Normalised pre-tokens of a chunk with letters that Python's tables don't know."""
        from tokenizers.normalizers import Lowercase  # its tables know letters that Python's do not

        text = Lowercase().normalize_str(unicodedata.normalize("NFC", chunk))
        masked = "".join("\ue000" if c in later_letters() else c for c in text)
        return [text[m.start() : m.end()] for m in self.split.finditer(masked)]

    def normalize(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each capital alone: no final sigma
        return text.lower()

    def chunks(self, text: str) -> list[str | int]:
        """Runs without white space, in order (no pre-token crosses white space); an int is a special token's id."""
        if _NOT_WHITE.search(text):
            text = _BLANKS.sub(" ", text)
            whole = lambda t: [c for c in t.split(" ") if c]
        else:
            whole = str.split
        if "<|" not in text or self.special_at is None:
            return whole(text)
        out: list[str | int] = []
        for k, part in enumerate(self.special_at.split(text)):
            if k % 2:
                out.append(self.special[part])
            else:
                out.extend(whole(part))
        return out

    def learn_chunks(self, chunks: list[str]) -> dict[str, bytes]:
        """The packed ids of chunks."""
        split = self.split_chunks(chunks) if chunks else []
        words = list({w for s in split for w in s})
        learned = dict(zip(words, self.merge_words(words) if self.ordered else self.merge_in_turn(words), strict=True))
        return {c: learned[s[0]] if len(s) == 1 else b"".join([learned[w] for w in s]) for c, s in zip(chunks, split, strict=True)}

    def lay_out(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First symbols of all words on end, and where each word begins."""
        raw = [w.encode("utf-8") for w in words]
        ends = np.cumsum([len(x) for x in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.inner[data]
        symbol[ends - 1] = self.final[data[ends - 1]]
        return symbol, np.concatenate([[0], ends])

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of symbols, -1 without one."""
        code = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[at] == code, self.pair_ranks[at], -1)

    def merge_words(self, words: list[str]) -> list[bytes]:
        """The pair occurrence index, a rank's occurrences at once. For merge
        lists in which no merge makes a pair of a lower rank (self.ordered)."""
        if not words:
            return []
        symbol, at = self.lay_out(words)
        n = len(symbol)
        spots = np.arange(n, dtype=np.int32)
        left, right = spots - 1, spots + 1
        left[at[:-1]] = -1
        right[at[1:] - 1] = -1
        index: dict[int, list[np.ndarray]] = {}  # rank of a pair -> positions of its left symbols
        active: list[int] = []

        def note(where: np.ndarray) -> None:
            """Index the pairs that begin at these positions."""
            ranks = self.ranks_of(symbol[where], symbol[right[where]])
            if len(where) > 1:
                order = np.argsort(ranks, kind="stable")
                ranks, where = ranks[order], where[order]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                groups = zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(where, cuts), strict=True)
            else:
                groups = [(int(ranks[0]), where)] if len(where) else []
            for rank, group in groups:
                if rank >= 0:
                    if rank in index:
                        index[rank].append(group)
                    else:
                        index[rank] = [group]
                        heapq.heappush(active, rank)

        note(spots[right >= 0])
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            where = lists[0] if len(lists) == 1 else np.sort(np.concatenate(lists))
            a, b, ab = self.made[rank]
            where = where[(symbol[where] == a) & (right[where] >= 0)]
            where = where[symbol[right[where]] == b]
            if a == b and len(where) > 1:  # occurrences may overlap: the leftmost goes first
                taken, last = [], -1
                for p, q in zip(where.tolist(), right[where].tolist(), strict=True):
                    if p != last:
                        taken.append(p)
                        last = q
                where = np.array(taken, np.int32)
            if not len(where):
                continue
            second = right[where]
            after = right[second]
            symbol[where] = ab
            symbol[second] = -1
            right[where] = after
            more = after >= 0
            left[after[more]] = where[more]
            before = left[where]
            note(np.unique(np.concatenate([where[more], before[before >= 0]])))
        used = symbol >= 0
        packed = symbol[used].astype("<u4").tobytes()
        cuts = np.concatenate([[0], np.cumsum(used)])[at] * 4
        return [packed[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def merge_in_turn(self, words: list[str]) -> list[bytes]:
        """The same index for any merge list, an occurrence at a time."""
        if not words:
            return []
        first, at = self.lay_out(words)
        symbol, n = first.tolist(), len(first)
        left, right = [*range(-1, n - 1)], [*range(1, n + 1)]
        for p, q in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            left[p], right[q - 1] = -1, -1
        index: dict[int, list[int]] = {}
        active: list[int] = []

        def note(p: int) -> int:
            rank = self.merges.get((symbol[p], symbol[right[p]]), -1)
            if rank >= 0:
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(active, rank)
                index[rank].append(p)
            return rank

        for p in range(n):
            if right[p] >= 0:
                note(p)
        while active:
            rank = heapq.heappop(active)
            spots = sorted(index.pop(rank))
            a, b, ab = self.made[rank]
            for k, p in enumerate(spots):
                q = right[p]
                if symbol[p] != a or q < 0 or symbol[q] != b:
                    continue
                symbol[p], symbol[q], right[p] = ab, -1, right[q]
                new = []
                if right[q] >= 0:
                    left[right[q]] = p
                    new.append(note(p))
                if left[p] >= 0:
                    new.append(note(left[p]))
                if any(0 <= x < rank for x in new) and spots[k + 1 :]:  # a lower rank came up: it goes first
                    if rank not in index:
                        index[rank] = []
                        heapq.heappush(active, rank)
                    index[rank] += spots[k + 1 :]
                    break
        ends = at.tolist()
        return [np.array([s for s in symbol[x:y] if s >= 0], "<u4").tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Packed little-endian ids of each text."""
        split = [self.chunks(t) if t else [] for t in texts]
        fresh = set().union(*split)
        known: dict[str | int, bytes] = {i: int(i).to_bytes(4, "little") for i in self.special.values()}
        missed = []
        for c in fresh.difference(known):
            found = self.young.get(c)
            if found is None:
                found = self.old.get(c)
                if found is None:
                    missed.append(c)
                    continue
                self.keep(c, found)
            known[c] = found
        learned = self.learn_chunks(missed)
        for c, found in learned.items():
            self.keep(c, found)
        known |= learned
        get = known.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def keep(self, chunk: str, packed: bytes) -> None:
        if len(chunk) > LONG_CHUNK:
            return
        if self.young_bytes > CACHE_BYTES:
            self.old, self.young, self.young_bytes = self.young, {}, 0
        self.young[chunk] = packed
        self.young_bytes += len(chunk) + len(packed) + ENTRY_BYTES

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as the library does for a file without a decoder; unknown ids are left out."""
        try:
            return " ".join(map(self.tokens.__getitem__, ids))
        except (IndexError, TypeError):
            return " ".join([t for i in ids if 0 <= i < len(self.tokens) and (t := self.tokens[i]) is not None])


@lru_cache(maxsize=1)
def later_letters() -> frozenset[str]:
    """Letters and numbers that the regex package knows and the library's older
    Unicode tables do not; the library is asked about those that Python's do not have."""
    from tokenizers import Regex, pre_tokenizers

    known = regex.compile(r"[\p{L}\p{N}]")
    young = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn" and known.match(c)]
    rest = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed").pre_tokenize_str("-" + "-".join(young))
    return frozenset("".join(part for part, _ in rest).replace("-", ""))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, ids_col: str = "ids", packed: bool = False, decoded_col: str | None = None) -> DataFrame:
    """Add the ids of each whole text: array<int>, or if packed one binary of
    little-endian unsigned 32-bit integers; and if decoded_col is given the text that the ids
    stand for, in the same pass. path is the tokenizer's file, present
    on every machine (it comes with an installed package)."""

    def make():
        v = vocabulary(path)

        def work(part: pa.RecordBatch) -> list:
            ids = v.encode_batch(part.column(part.schema.get_field_index(text_col)).to_pylist())
            texts = [] if decoded_col is None else [pa.array([v.decode(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.string())]
            if packed:
                return [pa.array(ids, pa.binary()), *texts]
            sizes = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            return [pa.ListArray.from_arrays(sizes, pa.array(np.frombuffer(b"".join(ids), "<i4"))), *texts]

        return work

    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    new = [T.StructField(ids_col, kind), *([] if decoded_col is None else [T.StructField(decoded_col, T.StringType())])]
    return arrow_map(df, text_col, df.columns if keep is None else keep, T.StructType(new), make, 3_000_000)


def decode(df: DataFrame, path: str, ids_col: str = "ids", keep: list[str] | None = None, out_col: str = "decoded") -> DataFrame:
    """Add the text that ids (array<int> or packed) stand for; null ids give ""."""
    keep = df.columns if keep is None else keep
    schema = T.StructType([*(df.schema[c] for c in keep if c.lower() != out_col.lower()), T.StructField(out_col, T.StringType())])
    kept = [f.name for f in schema][:-1]
    inputs = list(dict.fromkeys([*kept, ids_col]))

    def run(batches):
        v = vocabulary(path)
        for batch in (b.slice(i, DECODE_ROWS) for b in batches for i in range(0, b.num_rows, DECODE_ROWS)):
            ids = batch.column(batch.schema.get_field_index(ids_col))
            if not pa.types.is_list(ids.type) and not pa.types.is_large_list(ids.type):
                texts = [v.decode(np.frombuffer(x.as_buffer(), "<u4").tolist()) if x.is_valid else "" for x in ids]
            else:
                texts = [v.decode(x or []) for x in ids.to_pylist()]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string())], names=[*kept, out_col])

    return df.select(*[f"`{c}`" for c in inputs]).mapInArrow(run, schema)
