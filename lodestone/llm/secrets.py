"""Secrets and the parts of credentials that only count together, in DataFrame functions only.

Strong spans (`BASE`) are reported wherever they stand. Weak candidates (`PARTS`) are identifiers (a
user, a client id), secrets (a mixed run of characters, a weakly named value) and endpoints; alone each
is commonplace, together they are a credential. A weak identifier is reported only where a secret,
strong or weak, stands in the same scope within `REACH` code points, a weak secret where an
identifier does, an endpoint where a secret that is linked so does. A scope is a paragraph: text between blank lines. A
weak candidate that overlaps a strong span is that span's text and not reported again, but
strong spans link like weak ones: an access key is an identifier, an assigned value and a hex run are secrets.

One projection finds all matches: matches and the pieces between them, whose lengths sum up to the
places. It is written once, with a number for each row. Matches then are rows of their own: places are running
sums in a row's matches, scopes running counts of blank lines, and links an interval join: an
identifier's reach covers cells of the text, a secret meets those of its own cells, by row,
scope and cell, as a semi join, so that nothing has a row for each pair and a text full of
candidates is many cells. Only rows that hold both an identifier and a secret get there.

Defined results: a null text is empty; a row without spans has an empty list; repeated rows and null ids are each
answered; equal candidates are equal spans of their own places; an empty table gives an empty table; extra columns
are kept if named in `keep`, whatever their names, and the result column replaces a kept column of its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialize

#: Code points between two parts of one credential.
REACH = 300


def either_case(words: str) -> str:
    """A pattern's letters in either case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in words)


_ASSIGNED = "[\"']?\\x20*[:=]\\x20*[\"']?"
# The strong patterns by kind, in the order of kinds; what a match must be is in `_enough`.
BASE: dict[str, str] = {
    "assign": f"({either_case('password|passwd|secret|token|api_?key')}){_ASSIGNED}([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]{16,}",  # of AKIA[A-Z0-9]+ those of 20 characters: a shorter match holds no other
    "hex": "[0-9a-f]{24,}",  # of whole runs those of 24 characters
}
#: The weak patterns by kind.
PARTS: dict[str, str] = {
    "identifier": f"({either_case('user(name)?|login|(client|account|key)_?id|account|access_?key(_?id)?')}){_ASSIGNED}([A-Za-z0-9@._-]+)",
    "secret": f"({either_case('pass|pwd|passphrase|credential|private_?key')}){_ASSIGNED}[A-Za-z0-9+/_.=!#$%&*@^~-]+|[A-Za-z0-9+/_-]{{16,}}",
    "endpoint": f"(https?|ftp|ssh|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/@?&=%+-]+|({either_case('host|hostname|endpoint|server')}){_ASSIGNED}[A-Za-z0-9][A-Za-z0-9._:/-]+",
}
BREAK = "\\n[\\x20\\t\\r]*\\n"
KINDS = [*BASE, *PARTS]
#: What a text must hold to hold a kind at all: one of these strings.
HOLDS: dict[str, list[str]] = {"assign": [":", "="], "access": ["AKIA"], "identifier": [":", "="], "endpoint": [":", "="], "break": ["\n"]}
#: What a secret without a name holds, each.
MIXED = ["[0-9]", "[a-z]", "[A-Z]"]


def _enough(kind: str, m: Column) -> Column:
    """Whether a match counts. One that does not is passed over whole."""
    if kind == "assign":
        return F.char_length(F.regexp_extract(m, BASE["assign"], 2)) >= 6
    if kind == "identifier":
        return F.char_length(F.regexp_extract(m, f"{_ASSIGNED}([A-Za-z0-9@._-]+)$", 1)) >= 3
    if kind == "secret":
        named = m.rlike("[:=]")
        mixed = m.rlike(MIXED[0]) & m.rlike(MIXED[1]) & m.rlike(MIXED[2])
        return F.when(named, F.char_length(F.regexp_extract(m, "[:=]\\x20*[\"']?(.*)$", 1)) >= 4).otherwise(mixed)
    return F.lit(True)


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """All matches of one kind in order: kind, number, code points before it since the last match, its code points, whether it counts."""
    holds = [F.contains(text, F.lit(x)) for x in HOLDS.get(kind, [])]
    some = text.isNotNull()
    if holds:
        some &= holds[0] if len(holds) == 1 else holds[0] | holds[1]
    found = F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    # the pieces are cut only where there are matches
    both = lambda m: F.when(F.size(m) > 0, F.arrays_zip(m.alias("m"), F.transform(F.split(text, pattern, -1), F.char_length).alias("gap")))
    zipped = F.element_at(F.transform(F.array(found), both), 1)
    listed = F.transform(
        F.filter(zipped, lambda z: z["m"].isNotNull()),
        lambda z, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), z["gap"].cast("long").alias("gap"), F.char_length(z["m"]).cast("long").alias("len"), _enough(kind, z["m"]).alias("ok")),
    )
    return F.coalesce(listed, F.array().cast("array<struct<kind:string,k:int,gap:bigint,len:bigint,ok:boolean>>"))


def matched(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """(row, kept, matches, linkable): written, each row with its number; linkable rows may hold both an identifier and a secret."""
    text = F.col(f"`{text_col}`")
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(0)
    patterns = BASE | PARTS | {"break": BREAK}
    each = docs.select(kept.alias("kept"), *[_matches(text, kind, p).alias(kind) for kind, p in patterns.items()])
    some = lambda *kinds: F.greatest(*[F.size(k) for k in kinds]) > 0
    linkable = some("access", "identifier") & some("assign", "hex", "secret")
    strong, weak = F.concat(*BASE), F.concat(*PARTS, "break")
    matches = F.when(linkable, F.concat(strong, weak)).otherwise(strong)
    return materialize(each.select(F.monotonically_increasing_id().alias("row"), "kept", matches.alias("matches"), linkable.alias("linkable")), "secret_parts")[0]


def placed(found: DataFrame) -> DataFrame:
    """(row, linkable, kind, start, end) of the matches that count, from running sums over a row's matches of one kind."""
    each = found.select("row", "linkable", F.explode("matches").alias("m")).select("row", "linkable", "m.*")
    upto = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("end", upto).where("ok").select("row", "linkable", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def scoped(spans: DataFrame) -> DataFrame:
    """(row, scope, kind, start, end): the linkable rows' spans, each with the number of blank lines before it, without
    weak ones that overlap strong ones."""
    before, after = (Window.partitionBy("row").orderBy("start").rangeBetween(*r) for r in ((Window.unboundedPreceding, 0), (0, Window.unboundedFollowing)))
    strong = F.col("kind").isin(*BASE)
    seen = spans.where("linkable").withColumn("scope", F.count(F.when(F.col("kind") == "break", 1)).over(before))
    seen = seen.withColumn("reached", F.max(F.when(strong, F.col("end"))).over(before)).withColumn("next", F.min(F.when(strong, F.col("start"))).over(after))
    covered = (F.col("reached") > F.col("start")) | (F.col("next") < F.col("end"))
    return seen.where((F.col("kind") != "break") & (strong | ~F.coalesce(covered, F.lit(False)))).select("row", "scope", "kind", "start", "end")


def in_reach(spans: DataFrame, others: DataFrame, reach: int = REACH) -> DataFrame:
    """The spans that have one of the others in their scope, no more than reach code points away: an interval join by cells."""
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / reach), F.floor(high / reach))).alias("cell")
    left = spans.select("*", cells(F.col("start"), F.col("end")))
    right = others.select(
        F.col("row").alias("o_row"), F.col("scope").alias("o_scope"), (F.col("start") - reach).alias("low"), (F.col("end") + reach).alias("high"),
        cells(F.col("start") - reach, F.col("end") + reach).alias("o_cell"),
    )
    meets = (F.col("row") == F.col("o_row")) & (F.col("scope") == F.col("o_scope")) & (F.col("cell") == F.col("o_cell")) & (F.col("low") <= F.col("end")) & (F.col("start") <= F.col("high"))
    return left.join(right, meets, "left_semi").drop("cell").distinct()


def linked(spans: DataFrame, reach: int = REACH) -> DataFrame:
    """(row, kind, start, end) of the weak candidates that are parts of credentials."""
    parts, _ = materialize(scoped(spans), "secret_scopes")
    identifiers, secrets = parts.where(F.col("kind").isin("identifier", "access")), parts.where(F.col("kind").isin("secret", "assign", "hex"))
    held = in_reach(secrets, identifiers, reach)
    named = in_reach(identifiers.where("kind = 'identifier'"), secrets, reach)
    reached = in_reach(parts.where("kind = 'endpoint'"), held, reach)
    return held.where("kind = 'secret'").unionByName(named).unionByName(reached).select("row", "kind", "start", "end")


SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, reach: int = REACH) -> DataFrame:
    """The kept columns (all) and spans: kind, start and end in code points, base; by start, then kind as listed in KINDS."""
    if reach < 1:
        raise ValueError("reach must be positive")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "spans"]
    found = matched(docs, text_col, keep)
    spans = placed(found)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    every = spans.where(F.col("kind").isin(*BASE)).select("row", "kind", "start", "end").unionByName(linked(spans, reach))
    one = F.struct("start", rank.alias("rank"), "kind", "end")
    listed = every.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("s"))
    shown = F.transform("s", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (s["rank"] <= len(BASE)).alias("base")))
    out = found.select("row", "kept").join(listed, "row", "left").select("kept", F.coalesce(shown, F.array().cast(SPANS)).alias("spans"))
    return out.select(*[F.col("kept")[c].alias(c) for c in keep], "spans")
