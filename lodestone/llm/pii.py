"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Base patterns (email, ip, card, phone) always yield spans. Beside them every looser form
is a candidate: spelt-out addresses, IPv6, national phone numbers, card numbers with
other separators; and every near miss: matches of the base patterns that fail their
checks, addresses without a dot, dotted numbers of three parts, bare runs of digits. On each
candidate four labelers vote yes, no or nothing: strict pattern (nothing on the looser
forms), shape, gazetteer (top-level domains, issuer and country prefixes, address blocks)
and context (words nearby, and whether the candidate stands free). Near misses are mostly
false, so the labelers disagree. Expectation-maximisation (Dawid-Skene) over the whole
corpus' votes estimates each labeler's reliability, strict included, by kind, with the labeler's rates
over all kinds as the prior; a logistic span classifier is trained on the
posteriors with surface features, and accepts or rejects the candidates beyond the base.

One pass counts (kind, votes, features) patterns: at most a few thousand distinct
rows whatever the corpus, summed before the shuffle and collected. A second pass
applies the model. All patterns run in time linear in the text. Positions are code points, ends
exclusive.

Defined results: null and empty texts have no spans; spans of one kind never
overlap, an added span overlaps no base span; without candidates the model accepts
nothing beyond the base; equal texts get equal spans; an empty table gives an empty
table; extra columns are kept if named in `keep`, and a result column replaces a
kept column of the same name.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import arrow_map, pieces, text_bytes

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
EMAIL_END = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")  # the ip pattern takes its parts four by four
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

SPELT = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{2,63})+", re.I)
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")
NATIONAL = re.compile(r"(?<![\w+.-])(?:\([0-9]{2,4}\)[\x20-]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![\w-]|\.[0-9])")
DOTTED_CARD = re.compile(r"(?<![\w.])[0-9]{4}([./])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![\w]|\.[0-9])")

# The gazetteers.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io dev app co ai me tv de fr es it uk us ca au nz ie nl be ch at se no dk fi pl cz pt br mx ar jp cn in kr ru eu".split())
ISSUERS = re.compile(r"(4|5[1-5]|2[2-7]|3[0468]|35|6011|64|65|62)")
CALLING = re.compile(r"(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-8]|2[2-69]\d|3[578]\d|42[0-9]|[5689]\d\d)")
# Words nearby that speak for a kind, and words that speak for something else.
FOR = {
    "email": re.compile(r"mail|contact|write|reach|kontakt|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|adresse|serveur|servidor", re.I),
    "card": re.compile(r"card|visa|credit|debit|karte|carte|tarjeta|amex|payment", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|cell|fax|ruf|appel|llam", re.I),
}
AGAINST = re.compile(r"version|order|invoice|isbn|issn|serial|chapter|section|page|figure|build|release|revision|rechnung|bestell|facture|pedido|token|key|secret|hash|commit|id\b", re.I)
DATE = re.compile(r"(?:[12][0-9]{3}[-. ][0-9]{1,2}[-. ][0-9]{1,2}|[0-9]{1,2}[-. ][0-9]{1,2}[-. ][12][0-9]{3})")
HANDLE = re.compile(r"[A-Za-z0-9-]++")
NEAR = 30


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from
    each @: the local part's class excludes @, so a match is the run before it, cut
    at the last match's end."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := EMAIL_END.match(text, at + 1)):
            end = done = m.end()
            yield start, end
        at = text.find("@", end)


def dotted(text: str) -> Iterator[tuple[list[tuple[int, int]], int, int]]:
    """Runs of numbers joined by dots, cut in matches of four parts as the base pattern
    `[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)` finds them, and a rest of three at most."""
    for m in DOTTED.finditer(text):
        parts, at = [], m.start()
        for p in m[0].split("."):
            parts.append((at, at + len(p)))
            at += len(p) + 1
        for k in range(0, len(parts), 4):
            four = parts[k : k + 4]
            yield four, four[0][0], four[-1][1]


def octet(digits: str) -> bool:
    small = digits.lstrip("0")
    return len(small) <= 3 and int(small or 0) <= 255


def found_spans(text: str, has_at: bool = True, has_digit: bool = True) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int, int]]]:
    """Base spans by kind, and near misses (kind, start, end, form 2)."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    near: list[tuple[str, int, int, int]] = []
    if has_at:
        out["email"] = list(emails(text))
        ends = {e for _, e in out["email"]}
        for at in range(len(text)) if text.count("@") > len(ends) else ():
            if text[at] == "@" and at and text[at - 1] in LOCAL and (m := HANDLE.match(text, at + 1)) and not text.startswith(".", m.end()):
                start = at
                while start and at - start < 64 and text[start - 1] in LOCAL:
                    start -= 1
                near.append(("email", start, m.end(), 2))
    if has_digit:
        for parts, s, e in dotted(text):
            if len(parts) == 4 and all(octet(text[a:b]) for a, b in parts):
                out["ip"].append((s, e))
            elif len(parts) > 2:
                near.append(("ip", s, e, 2))
        for m in CARD.finditer(text):
            if m.end() - m.start() < 7:
                continue
            n = len(d := _digits(m[0]))
            if 13 <= n <= 19 and luhn(d):
                out["card"].append(m.span())
            elif 12 <= n <= 20:
                near.append(("card", *m.span(), 2))
            elif 7 <= n <= 11:
                near.append(("phone", *m.span(), 2))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    out["phone"].append(m.span())
                else:
                    near.append(("phone", *m.span(), 2))
    return out, near


def base_spans(text: str, has_at: bool = True, has_digit: bool = True) -> dict[str, list[tuple[int, int]]]:
    return found_spans(text, has_at, has_digit)[0]


def loose_spans(text: str, has_digit: bool) -> list[tuple[str, int, int, int]]:
    out = []
    if "at)" in (low := text.lower()) or "at]" in low or "at}" in low:
        out += [("email", *m.span(), 1) for m in SPELT.finditer(text)]
    if has_digit:
        if text.count(":") >= 7:
            out += [("ip", *m.span(), 1) for m in IPV6.finditer(text)]
        out += [("card", *m.span(), 1) for m in DOTTED_CARD.finditer(text)]
        out += [("phone", *m.span(), 1) for m in NATIONAL.finditer(text)]
    return out


@dataclass
class Candidate:
    kind: str
    start: int
    end: int
    form: int  # 0: base, 1: a looser form, 2: a near miss
    votes: tuple[int, ...] = field(default=())  # 1 yes, 0 no, -1 nothing: strict, shape, gazetteer, context
    features: tuple[int, ...] = field(default=())  # form, length bucket, separators

    @property
    def base(self) -> bool:
        return self.form == 0

    def key(self) -> str:
        return f"{self.kind}|{','.join(map(str, self.votes))}|{','.join(map(str, self.features))}"


def _context(text: str, c: Candidate) -> int:
    """1 or 0 by the words in front; else 0 if it is glued to a word or assigned to a name, 1 if it stands free."""
    near = text[max(0, c.start - NEAR) : c.start]
    if FOR[c.kind].search(near):
        return 1
    if AGAINST.search(near):
        return 0
    front, behind = text[c.start - 1 : c.start] if c.start else " ", text[c.end : c.end + 1] or " "
    glued = front.isalnum() or behind.isalnum() or front in "_=#/\\-\"'" or behind in "_=/\\"
    return int(not glued)


def _describe(text: str, c: Candidate) -> Candidate:
    s, digits = text[c.start : c.end], _digits(text[c.start : c.end])
    if c.kind == "email":
        tail = re.split(r"[^A-Za-z0-9-]+", s)[-1].lower()
        shape, known = int(c.form < 2 and 2 <= len(tail) <= 24), int(c.form < 2 and tail in TOP_LEVEL)
    elif c.kind == "ip" and ":" in s:
        shape, known = 1, int(bool(re.match(r"[23]|f[cde]", s.lower())))
    elif c.kind == "ip":
        parts = s.split(".")
        shape = int(len(parts) == 4 and not any(len(p) > 1 and p[0] == "0" for p in parts) and all(octet(p) for p in parts))
        known = int(octet(parts[0]) and 0 < int(parts[0].lstrip("0") or 0) < 224)
    elif c.kind == "card":
        shape = int(13 <= len(digits) <= 16 and luhn(digits))
        known = int(bool(ISSUERS.match(digits)))
    else:
        shape = int((9 if c.base else 7) <= len(digits) <= 13 and len(digits) < len(s) and not DATE.fullmatch(s))
        known = int(bool(CALLING.match(digits))) if s[0] == "+" else 1 if s[0] in "(0" else 0 if c.form == 2 else -1
    strict = 1 if c.base else -1 if c.form == 1 else 0
    c.votes = (strict, shape, known, _context(text, c))
    c.features = (c.form, min(5, len(s) // 6), min(2, len(set(s) & set(" -.()/"))))
    return c


def candidates(text: str, has_at: bool = True, has_digit: bool = True) -> list[Candidate]:
    """All candidates, by kind as listed, then start. Those beyond the base overlap no base span, nor
    one of their kind; a looser form goes before a near miss."""
    base, near = found_spans(text, has_at, has_digit)
    out = [Candidate(k, s, e, 0) for k in KINDS for s, e in base[k]]
    taken = {kind: Cover() for kind in KINDS}
    all_base = Cover((c.start, c.end) for c in out)
    for kind, s, e, form in [*loose_spans(text, has_digit), *sorted(near, key=lambda x: (x[1], -x[2]))]:
        if not all_base.meets(s, e) and taken[kind].add(s, e):
            out.append(Candidate(kind, s, e, form))
    out.sort(key=lambda c: (KINDS.index(c.kind), c.start))
    return [_describe(text, c) for c in out]


class Cover:
    """Spans by start, asked whether one meets another. Spans of a kind come in order, or a few forms of them."""

    def __init__(self, spans=()):
        self.spans: list[tuple[int, int]] = []
        reach = 0
        for s, e in sorted(spans):
            reach = max(reach, e)  # the farthest end up to each
            self.spans.append((s, reach))

    def meets(self, s: int, e: int) -> bool:
        k = bisect_left(self.spans, (e, -1))
        return k > 0 and self.spans[k - 1][1] > s

    def add(self, s: int, e: int) -> bool:
        if self.meets(s, e):
            return False
        insort(self.spans, (s, e))
        return True


def _flags(part: pa.RecordBatch, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Which texts hold an @ or an (at), and which a digit."""
    data, offsets = text_bytes(part.column(part.schema.get_field_index(text_col)))
    digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    at = np.concatenate([[0], np.cumsum(data == 64)])
    return np.diff(at[offsets]) > 0, np.diff(digit[offsets]) > 0


def _texts(part: pa.RecordBatch, text_col: str) -> Iterator[list[Candidate]]:
    has_at, has_digit = _flags(part, text_col)
    for t, a, d in zip(part.column(part.schema.get_field_index(text_col)).to_pylist(), has_at.tolist(), has_digit.tolist(), strict=True):
        yield candidates(t, a, d) if t else []


@dataclass(frozen=True)
class Model:
    reliability: dict  # (kind, labeler) -> probability of yes given true and given false
    weights: dict  # feature -> weight

    def accepts(self, c: Candidate) -> bool:
        return c.base or self.score(c) >= 0.5

    def score(self, c: Candidate) -> float:
        if not self.weights:
            return float(c.base)
        return float(1 / (1 + np.exp(-np.clip(sum(self.weights.get(f, 0.0) for f in _inputs(c.kind, c.votes, c.features)), -50, 50))))


def _inputs(kind: str, votes: tuple[int, ...], features: tuple[int, ...]) -> list[str]:
    return ["", kind, *(f"vote{k}={v}" for k, v in enumerate(votes)), *(f"{kind}:vote{k}={v}" for k, v in enumerate(votes)), *(f"{kind}:feature{k}={v}" for k, v in enumerate(features))]


def _rates(yes: np.ndarray, no: np.ndarray, weight: np.ndarray, prior: np.ndarray, strength: float) -> np.ndarray:
    """Probability of a yes for each labeler, pulled towards the prior."""
    return np.clip((weight @ yes + strength * prior) / (weight @ (yes | no) + strength), 1e-3, 1 - 1e-3)


def expectation_maximisation(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, dict]:
    """Dawid-Skene with two classes over vote patterns: posterior of each pattern, and for
    each kind the labelers' probabilities of a yes, given true and given false, (2, labelers)."""
    yes, no = votes == 1, votes == 0
    voted = (yes | no).sum(axis=1)
    posterior = np.clip(np.where(voted > 0, yes.sum(axis=1) / np.maximum(voted, 1), 0.5), 0.05, 0.95)
    rate: dict = {}
    for _ in range(rounds):
        rate, new = {}, posterior.copy()
        # labelers are somewhat better than chance until the votes say otherwise
        over_all = [_rates(yes, no, counts * p, np.full(votes.shape[1], start), 2.0) for p, start in ((posterior, 0.7), (1 - posterior, 0.3))]
        for kind in np.unique(kinds):
            of = kinds == kind
            y, n, c, p = yes[of], no[of], counts[of], posterior[of]
            rate[kind] = np.stack([_rates(y, n, c * q, pooled, 5.0) for q, pooled in zip((p, 1 - p), over_all, strict=True)])
            prior = np.clip((c @ p + 1) / (c.sum() + 2), 0.02, 0.98)
            ll = [y @ np.log(r) + n @ np.log(1 - r) for r in rate[kind]]
            new[of] = 1 / (1 + np.exp(np.clip(np.log((1 - prior) / prior) + ll[1] - ll[0], -50, 50)))
        done = np.abs(new - posterior).max() < 1e-9
        posterior = new
        if done:
            break
    return posterior, rate


def fit(patterns: Counter) -> Model:
    """patterns: Candidate.key() -> count over the corpus."""
    if not patterns:
        return Model({}, {})
    keys = sorted(patterns)
    parsed = [(k.split("|")[0], *(tuple(map(int, x.split(","))) for x in k.split("|")[1:])) for k in keys]
    counts = np.array([patterns[k] for k in keys], float)
    target, rate = expectation_maximisation(np.array([p[0] for p in parsed]), np.array([p[1] for p in parsed]), counts)
    reliability = {(str(kind), k): (float(r[0, k]), float(r[1, k])) for kind, r in rate.items() for k in range(r.shape[1])}
    names = sorted({f for p in parsed for f in _inputs(*p)})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(keys), len(names)))
    for i, p in enumerate(parsed):
        x[i, [at[f] for f in _inputs(*p)]] = 1
    weight = np.sqrt(counts)  # frequent patterns count more, rare ones are not lost
    beta = np.zeros(len(names))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (target - p)) - 0.1 * beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(names)), grad)
        step = np.clip(step, -2, 2)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(reliability, dict(zip(names, beta.tolist(), strict=True)))


def vote_patterns(documents: DataFrame, text_col: str) -> DataFrame:
    """(pattern, n): how often each vote and feature pattern occurs in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for part in pieces(batch, text_col, 4_000_000):
                for found in _texts(part, text_col):
                    seen.update(c.key() for c in found)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    counted = documents.select(f"`{text_col}`").mapInArrow(run, "pattern string, n long")
    return counted.groupBy("pattern").agg(F.sum("n").alias("n"))


def train(documents: DataFrame, text_col: str = "text") -> Model:
    return fit(Counter({r["pattern"]: r["n"] for r in vote_patterns(documents, text_col).toLocalIterator()}))


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType()), T.StructField("score", T.DoubleType())])
)


def find(documents: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, spans_col: str = "spans") -> DataFrame:
    """Add the accepted spans of each whole text, by kind as listed, then start."""

    def make():
        def work(part: pa.RecordBatch) -> list:
            return [[[{"kind": c.kind, "start": c.start, "end": c.end, "base": c.base, "score": model.score(c)} for c in found if model.accepts(c)] for found in _texts(part, text_col)]]

        return work

    return arrow_map(documents, text_col, documents.columns if keep is None else keep, T.StructType([T.StructField(spans_col, SPANS)]), make, 4_000_000)


def redact(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """documents with each accepted span replaced by its kind in brackets; overlapping spans become one."""
    new = T.StructType([T.StructField(text_col, T.StringType())])

    def make():
        def work(part: pa.RecordBatch) -> list:
            texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
            return [[_redacted(t, [c for c in found if model.accepts(c)]) for t, found in zip(texts, _texts(part, text_col), strict=True)]]

        return work

    return arrow_map(documents, text_col, documents.columns, new, make, 4_000_000).select(*[f"`{c}`" for c in documents.columns])


def _redacted(text: str | None, spans: list[Candidate]) -> str | None:
    if not spans:
        return text
    out, done = [], 0
    for c in sorted(spans, key=lambda c: (c.start, -c.end)):
        if c.start >= done:
            out += [text[done : c.start], f"[{c.kind}]"]
        done = max(done, c.end)
    return "".join([*out, text[done:]])
