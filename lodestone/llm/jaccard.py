"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

A document is its set of 5-word shingles (a text of one to four words has one
shingle, all its words). Documents with equal sets form a class, known by its own
number from then on; one document of each goes on.

The forest has `trees` prefix tries. A class has a label of `max_depth` hashes in
each; a trie is the sorted list of its labels, and a node at some depth is a run of
labels with an equal prefix of that length. One sorted pass compares each label with its
neighbours and keeps those that match one for `min_depth` hashes or more: all others
are alone in their nodes at every depth. Matching starts with whole labels, and the
prefixes are shortened one hash at a time until the target recall. The recall that a
depth reaches is measured on all pairs of neighbours, whichever documents they are: their
whole signatures give each pair's similarity, and a pair of similarity s shares a prefix of depth d in some tree with
probability 1 - (1 - s^d)^trees. One more pair exactly at the threshold is counted
with them, so few pairs mean short prefixes. Corpora of close copies are
matched by long prefixes, those of pairs near the threshold by short ones.

Classes that share a node at the chosen depth are chained through the node's least
member, so a node of any size costs one row a member; connected nodes give candidate
groups. A group beyond a block's size is cut in blocks of like prefixes in the first
tree, and a pair of blocks is verified only if some node has members in both, so a
long chain of weak candidates costs in proportion to its length. Each pair of blocks
is one bounded task, by exact intersection counts of all pairs in it. A task
returns a row per class, never pairs: how many documents it links to, and the least
class it reaches there. Components come from verified links alone.

Defined results: null or empty texts, and rows with a null id, link with nothing
(class_id null); ties and repeated rows: every row counts as a document, rows with
equal sets are linked, rows that share a doc_id but not the text are documents of their
own; an empty table gives an empty table; extra columns are ignored (the result has
its own columns only).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import SPACES, Words, arrow_map, byte_table, gram_hashes, materialize, mix, redealt, text_bytes
from lodestone.llm.components import connected_components

SHINGLE, THRESHOLD = 5, 0.8
TREES, MAX_DEPTH, MIN_DEPTH, RECALL = 24, 8, 4, 0.99999
#: Classes of a block.
LEAST_BLOCK, MOST_BLOCK = 128, 2048

TABLE = byte_table(SPACES)


def recall_at(similarity: float, trees: int, depth: int) -> float:
    """Probability that two sets of this similarity share a prefix in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def choose_depth(agreed: dict[int, int], hashes: int, threshold: float, trees: int, max_depth: int, min_depth: int, recall: float) -> int:
    """The longest prefix that reaches the recall on the pairs measured.

    agreed: number of equal hashes of the pair's signatures -> number of such pairs.
    """
    linked = {k / hashes: n for k, n in agreed.items() if k / hashes >= threshold}
    total = sum(linked.values()) + 1
    depth = max_depth
    while depth > min_depth and (recall_at(threshold, trees, depth) + sum(n * recall_at(s, trees, depth) for s, n in linked.items())) / total < recall:
        depth -= 1
    return depth


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts on end, and where each text's begin."""
    w = Words(data, offsets, TABLE)
    base = 0x9FB21C651E98DF25
    grams, whole = gram_hashes(w, size, base)
    sh, doc = grams[whole], w.doc[: len(grams)][whole]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            some = w.counts[short] > k
            own[some] = own[some] * np.uint64(base) + w.hashes[w.first[short[some]] + k]
        sh, doc = np.concatenate([sh, mix(own ^ np.uint64(size))]), np.concatenate([doc, short])
    order = np.lexsort((sh, doc))
    sh, doc = sh[order], doc[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
    return sh[new], np.searchsorted(doc[new], np.arange(len(offsets)))


def signatures(sh: np.ndarray, begins: np.ndarray, trees: int, depth: int) -> list[bytes | None]:
    """Each non-empty set's labels: for each tree, depth hashes of 16 bits."""
    sizes = np.diff(begins)
    some = np.flatnonzero(sizes)
    out: list[bytes | None] = [None] * len(sizes)
    if not len(some):
        return out
    at = begins[:-1][some]
    rng = np.random.default_rng(20240229)
    xor = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2)
    mul = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    labels = np.zeros((len(some), trees * depth), ">u2")
    for k in range(trees * depth):
        labels[:, k] = (mix(np.minimum.reduceat((sh ^ xor[k]) * mul[k], at)) >> np.uint64(48)).astype(np.uint16)
    for i, d in enumerate(some.tolist()):
        out[d] = labels[i].tobytes()
    return out


def _digest(sh: np.ndarray) -> bytes:
    return hashlib.blake2b(sh.tobytes(), digest_size=16).digest()


def signed(documents: DataFrame, doc_col: str, text_col: str, size: int, trees: int, depth: int) -> DataFrame:
    """(doc, tkey, digest, labels) of each row; digest and labels are null for texts without words."""
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("labels", T.BinaryType())])

    def make():
        def work(part: pa.RecordBatch) -> list:
            sh, begins = shingle_sets(*text_bytes(part.column(part.schema.get_field_index("text"))), size)
            labels = signatures(sh, begins, trees, depth)
            return [[_digest(sh[a:b]) if b > a else None for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)], labels]

        return work

    docs = documents.select(F.col(f"`{doc_col}`").cast("long").alias("doc"), F.xxhash64(f"`{text_col}`").alias("tkey"), F.col(f"`{text_col}`").alias("text"))
    return arrow_map(docs, "text", ["doc", "tkey"], schema, make)


def forest(classes: DataFrame, trees: int, max_depth: int, min_depth: int) -> DataFrame:
    """(tree, label, cls, doc, before, matched): the sorted labels of all trees that share a prefix of
    min_depth hashes with a neighbour. before and matched: the neighbour in front, and how
    many hashes it shares. Rows at a partition's ends stay, as one neighbour is not seen."""
    width = 2 * max_depth
    tree = classes.select("cls", F.col("rep").alias("doc"), "labels", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    rows = tree.select("tree", F.substring("labels", 1 + F.col("tree") * width, F.lit(width)).alias("label"), "cls", "doc")
    # the class's hash as last key: equal labels may be dealt to several tasks
    keys = ["tree", "label", F.xxhash64("cls")]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the row whose neighbour behind is not seen yet
        first = True  # the partition's first row is not out yet
        for batch in batches:
            fresh = [pa.nulls(batch.num_rows, pa.int64()), pa.array(np.zeros(batch.num_rows, np.int32))]
            batch = pa.RecordBatch.from_arrays([*batch.columns, *fresh], names=["tree", "label", "cls", "doc", "before", "matched"])
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            if batch.num_rows > 1:
                keep, batch = _matched(batch, 2 * max_depth)
                keep = keep >= min_depth
                keep[0] |= first
                first = False
                yield batch.slice(0, len(keep)).filter(pa.array(keep))
            last = batch.slice(batch.num_rows - 1) if batch.num_rows else last
        if last is not None:
            yield last

    return ordered.mapInArrow(run, "tree int, label binary, cls long, doc long, before long, matched int")


def _matched(rows: pa.RecordBatch, width: int) -> tuple[np.ndarray, pa.RecordBatch]:
    """The longest prefix that each row but the last shares with a neighbour, and the rows with the one
    in front filled in (the first row has its own already)."""
    n = rows.num_rows
    tree, cls = rows.column(0).to_numpy(), rows.column(2).to_numpy()
    label = binary_rows(rows.column(1)).reshape(n, width).view(">u2")
    shared = np.cumprod((label[1:] == label[:-1]) & (tree[1:] == tree[:-1])[:, None], axis=1).sum(axis=1)
    front = np.concatenate([[rows.column(5)[0].as_py()], shared]).astype(np.int32)
    before = pa.concat_arrays([rows.column(4).slice(0, 1), pa.array(cls[:-1])])
    filled = pa.RecordBatch.from_arrays([*rows.columns[:4], before, pa.array(front)], names=rows.schema.names)
    return np.maximum(front[:-1], shared), filled


def binary_rows(col: pa.Array) -> np.ndarray:
    """The bytes of binary values of one length, on end."""
    raw = col.cast(pa.large_binary()).buffers()
    offsets = np.frombuffer(raw[1], np.int64)
    return np.frombuffer(raw[2], np.uint8)[offsets[col.offset] : offsets[col.offset + len(col)]]


def agreement(sorted_labels: DataFrame, classes: DataFrame, min_depth: int) -> dict[int, int]:
    """Equal hashes of the signatures of all neighbours that share a prefix -> number of pairs: a row a count."""
    near = sorted_labels.where(F.col("before").isNotNull() & (F.col("matched") >= min_depth))
    pairs = near.select(F.least("cls", "before").alias("a"), F.greatest("cls", "before").alias("b")).distinct()
    labels = classes.select("cls", "labels")
    both = pairs.join(labels.toDF("a", "x"), "a").join(labels.toDF("b", "y"), "b").select("x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (binary_rows(batch.column(k)).reshape(batch.num_rows, -1).view(np.uint16) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array((x == y).sum(axis=1).astype(np.int32))], names=["agreed"])

    return {r["agreed"]: r["count"] for r in both.mapInArrow(run, "agreed int").groupBy("agreed").count().collect()}


def nodes_at(sorted_labels: DataFrame, depth: int) -> DataFrame:
    """(node, cls) of the nodes at one depth; a collision of the node's hash only adds a candidate."""
    return sorted_labels.select(F.xxhash64("tree", F.substring("label", 1, 2 * depth)).alias("node"), "cls")


def candidates(nodes: DataFrame) -> DataFrame:
    """(cls, hub) for classes that share a node with a smaller one."""
    shared = nodes.groupBy("node").agg(F.min("cls").alias("hub"), F.max("cls").alias("other")).where("hub < other").select("node", "hub")
    return nodes.join(redealt(shared), "node").where("cls > hub").select("cls", "hub").distinct()


def blocked(members: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (cls, comp, members, first) with their block, and the pairs of blocks (comp, block, i, j) to verify.

    first: the class's prefix in the first tree. Classes of equal prefix share a
    block unless they are too many for one; a group of one block has the pair (0, 0).
    """
    width = F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(MOST_BLOCK), F.ceil(F.col("members") / 64)))
    sized = members.withColumn("width", width.cast("int"))
    small = sized.where("members <= width").select("cls", "comp", F.lit(0).cast("long").alias("block"))
    large = sized.where("members > width")
    alike = redealt(large.groupBy("comp", "first").agg(F.count("*").alias("alike")))
    large = large.join(alike, ["comp", "first"])
    own = F.xxhash64("first", F.pmod(F.xxhash64("cls"), F.ceil(F.col("alike") / F.col("width"))))
    dealt = F.pmod(F.xxhash64("first"), F.ceil(F.col("members") / F.col("width")))
    large = large.select("cls", "comp", F.when(F.col("alike") > F.col("width"), own).otherwise(dealt).cast("long").alias("block"))
    placed, _ = materialize(small.union(large), "blocks")
    several = placed.join(redealt(placed.groupBy("comp").agg(F.min("block").alias("x"), F.max("block").alias("y")).where("x < y").select("comp")), "comp", "left_semi")
    met = nodes.join(several, "cls").groupBy("node", "comp").agg(F.array_sort(F.collect_set("block")).alias("blocks")).where("size(blocks) > 1")
    # a node's blocks are at most its members over a block's size, and each pair is a task of its own
    left = met.select("comp", "blocks", F.posexplode("blocks").alias("k", "i"))
    across = left.select("comp", "i", F.explode(F.slice("blocks", F.col("k") + 2, F.size("blocks"))).alias("j")).distinct()
    across = across.select("comp", F.explode(F.array(F.struct(F.col("i").alias("block"), "i", "j"), F.struct(F.col("j").alias("block"), "i", "j"))).alias("p")).select("comp", "p.*")
    within = placed.select("comp", "block").distinct().select("comp", "block", F.col("block").alias("i"), F.col("block").alias("j"))
    return placed, within.union(across)


def by_key(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Rows of equal first n_keys columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = keys[a].tolist()
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Counts of common members of all pairs. Rare members add to their few pairs
    one by one; frequent ones by products of slices of the membership matrix."""
    g = len(sets)
    doc = np.repeat(np.arange(g), [len(s) for s in sets])
    sh = np.concatenate(sets)
    order = np.argsort(sh, kind="stable")
    sh, doc = sh[order], doc[order]
    at = np.flatnonzero(np.concatenate([[True], sh[1:] != sh[:-1]]))
    df = np.diff(np.concatenate([at, [len(sh)]]))
    out = np.zeros(g * g, np.int64)
    for k in range(2, 7):
        if len(first := at[df == k]):
            m = doc[first[:, None] + np.arange(k)]
            i, j = np.triu_indices(k, 1)
            out += np.bincount((m[:, i] * g + m[:, j]).ravel(), minlength=g * g)
    many = np.flatnonzero(df >= 7)
    counts = out.reshape(g, g)
    counts = counts + counts.T
    for a in range(0, len(many), 4096):
        chosen = many[a : a + 4096]
        member = np.zeros((g, len(chosen)), np.float32)
        rows = np.arange(df[chosen].sum()) + np.repeat(at[chosen] - (np.cumsum(df[chosen]) - df[chosen]), df[chosen])
        member[doc[rows], np.repeat(np.arange(len(chosen)), df[chosen])] = 1
        counts += np.rint(member @ member.T).astype(np.int64)
    return counts


def least_reached(linked: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix, the least label that links reach."""
    label = label.copy()
    while True:
        near = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(label, near)
        if (new == label).all():
            return label
        label = new


def verified(placed: DataFrame, block_pairs: DataFrame, classes: DataFrame, documents: DataFrame, doc_col: str, text_col: str, size: int, threshold: float) -> DataFrame:
    """(cls, links, root): links to documents of other classes and the least class reached, in each pair of blocks."""
    docs = documents.select(F.col(f"`{doc_col}`").cast("long").alias("rep"), F.xxhash64(f"`{text_col}`").alias("tkey"), F.col(f"`{text_col}`").alias("text"))
    chosen = placed.join(classes.select("cls", "rep", "tkey", "digest", "copies"), "cls").join(docs, ["rep", "tkey"])

    def make():
        def work(part: pa.RecordBatch) -> list:
            sh, begins = shingle_sets(*text_bytes(part.column(part.schema.get_field_index("text"))), size)
            sets = [sh[a:b] for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
            want = part.column(part.schema.get_field_index("digest")).to_pylist()
            # texts whose hashes collide: only the one with the class's set is its member
            return [[s.tobytes() if len(s) and _digest(s) == d else None for s, d in zip(sets, want, strict=True)]]

        return work

    sets = arrow_map(chosen, "text", ["comp", "block", "cls", "copies", "digest"], T.StructType([T.StructField("shingles", T.BinaryType())]), make)
    sets = sets.where("shingles IS NOT NULL")
    pairs = sets.join(redealt(block_pairs), ["comp", "block"]).select("comp", "i", "j", "cls", "copies", "block", "shingles")
    pairs = pairs.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for group in by_key(batches, 3):
            held.append(_verify(group, threshold))
            n += held[-1].num_rows
            if n >= 4096:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return pairs.mapInArrow(run, "cls long, links long, root long")


def _verify(group: pa.Table, threshold: float) -> pa.RecordBatch:
    cls, first = np.unique(group.column("cls").to_numpy(), return_index=True)  # repeated rows count once here
    copies = group.column("copies").to_numpy()[first]
    block = group.column("block").to_numpy()[first]
    raw = group.column("shingles").combine_chunks()
    sets = [np.frombuffer(raw[k].as_buffer(), np.uint64) for k in first.tolist()]
    if len(sets) > 1:
        sizes = np.array([len(s) for s in sets])
        common = intersections(sets)
        linked = common / (sizes[:, None] + sizes[None, :] - common) >= threshold
        np.fill_diagonal(linked, False)
        if group.column("i")[0].as_py() != group.column("j")[0].as_py():
            linked &= block[:, None] != block[None, :]
    else:
        linked = np.zeros((len(sets), len(sets)), bool)
    root = least_reached(linked, cls)
    links = linked @ copies
    some = links > 0
    return pa.RecordBatch.from_arrays([pa.array(cls[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], names=["cls", "links", "root"])


def join(
    documents: DataFrame,
    doc_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    max_depth: int = MAX_DEPTH,
    min_depth: int = MIN_DEPTH,
    recall: float = RECALL,
) -> DataFrame:
    """A row per document: (doc_id, tkey, class_id, component_id, n_links, kept).

    class_id: smallest doc_id with an equal shingle set; n_links: other documents
    of similarity >= threshold; component_id: smallest doc_id reached by links,
    itself included; kept: it is that one. tkey is xxhash64 of the text, to join
    the result with rows that repeat a doc_id; of a component's texts with the
    smallest doc_id, the one of the least tkey is kept.
    """
    rows, _ = materialize(signed(documents, doc_col, text_col, size, trees, max_depth), "signatures")
    usable = rows.where("digest IS NOT NULL AND doc IS NOT NULL")
    grouped = usable.groupBy("digest").agg(F.min(F.struct("doc", "tkey")).alias("least"), F.count("*").alias("copies"), F.first("labels").alias("labels"))
    # numbers hold from the write on: a class is known by its own, not by a doc_id that others may share
    numbered = grouped.select(F.monotonically_increasing_id().alias("cls"), "digest", F.col("least.doc").alias("rep"), F.col("least.tkey").alias("tkey"), "copies", "labels")
    classes, _ = materialize(numbered, "classes")
    tries, _ = materialize(forest(classes, trees, max_depth, min_depth), "forest")
    depth = choose_depth(agreement(tries, classes, min_depth), trees * max_depth, threshold, trees, max_depth, min_depth, recall)
    nodes = nodes_at(tries, depth)
    comps, _ = materialize(connected_components(candidates(nodes).toDF("a", "b")), "candidates")
    grown = comps.groupBy("component").agg(F.count("*").alias("members"))
    first = classes.select(F.col("cls").alias("node"), F.xxhash64(F.substring("labels", 1, 2 * depth)).alias("first"))
    members = comps.join(redealt(grown), "component").join(first, "node").select(F.col("node").alias("cls"), F.col("component").alias("comp"), "members", "first")
    placed, block_pairs = blocked(members, nodes)
    found, _ = materialize(verified(placed, block_pairs, classes, documents, doc_col, text_col, size, threshold), "links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    across, _ = materialize(connected_components(found.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b"))), "linked")
    least = across.withColumnRenamed("node", "cls").join(classes.select("cls", "rep", "tkey"), "cls").groupBy("component").agg(F.min(F.struct("rep", "tkey")).alias("root"))
    reached = across.join(redealt(least), "component").select(F.col("node").alias("cls"), "root")
    described = classes.select("cls", "digest", "rep", "tkey", "copies").join(links, "cls", "left").join(reached, "cls", "left")
    root = F.coalesce("root", F.struct("rep", "tkey"))
    described = described.select("digest", "rep", root.alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = rows.select("doc", "tkey", F.when(F.col("doc").isNotNull(), F.col("digest")).alias("digest")).join(described, "digest", "left")
    component = F.coalesce("root.rep", "doc")
    return out.select(
        F.col("doc").alias("doc_id"), "tkey", F.col("rep").alias("class_id"), component.alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce((F.col("root.rep") == F.col("doc")) & (F.col("root.tkey") == F.col("tkey")), F.lit(True)).alias("kept"),
    )
