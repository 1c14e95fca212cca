"""Resharding by minimum-cost flow.

The rows lie in files, each of one old shard. From the old shards' bytes and the new
shards' capacities a minimum-cost flow says how many bytes go from which old shard to
which new one: keeping costs nothing, moving costs its bytes, so the fewest bytes move. An old
shard's files are laid end to end; the flow cuts that line in stretches, and files and
blocks of rows inside a stretch move (or stay) whole. Only in the few blocks that a cut
meets are rows looked at one by one. Files of shards that nothing leaves or enters are kept
as they are; the others are rewritten.

The law is `bytes`: a shard's size differs from its capacity by less than the rows
that the cuts fall into. A row is known by its file and its place there, so repeated rows, ids
and texts are nothing special, and nothing is grouped by them. What reaches the driver is one
row a file, and for each file that a cut meets one row for each `BLOCK` rows; each
cut is placed in a window of one block.

Defined results: a null text has size 1 and the checksum of the empty text; null ids are allowed;
repeated rows each get their own slot; an empty table gives an empty table; extra columns are
kept in rewritten files, but for `shard` and `slot`, which are the new ones.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialize

#: Rows of a block.
BLOCK = 4096
#: The most files whose table is sent to all tasks, some 20 MB; with more it is joined by file.
MOST_SENT = 100_000


def fewest_bytes(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """The flow of least moved bytes. What fits stays; any way of dealing the surplus to the room
    left is optimal then, as every shard must lose its surplus at least. Linear in the shards."""
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities hold less than the supplies")
    flow = {(i, i): min(s, capacity[i]) for i, s in enumerate(supply) if i < len(capacity) and min(s, capacity[i])}
    room = [c - flow.get((j, j), 0) for j, c in enumerate(capacity)]
    j = 0
    for i, s in enumerate(supply):
        left = s - flow.get((i, i), 0)
        while left:
            if room[j]:
                push = min(left, room[j])
                flow[i, j] = flow.get((i, j), 0) + push
                left, room[j] = left - push, room[j] - push
            else:
                j += 1
    return flow


def minimum_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow from each source to each sink of least total cost, by successive
    shortest paths. The supplies must fit in the capacities; costs are not negative."""
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities hold less than the supplies")
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    for s in range(n):
        while left[s]:
            # Bellman-Ford in the residual graph from source s; node n + j is sink j
            far = [float("inf")] * (n + m)
            back = [-1] * (n + m)
            far[s] = 0
            changed = True
            while changed:
                changed = False
                for i in range(n):
                    for j in range(m):
                        if far[i] + cost[i][j] < far[n + j]:
                            far[n + j], back[n + j], changed = far[i] + cost[i][j], i, True
                        if flow[i][j] and far[n + j] - cost[i][j] < far[i]:
                            far[i], back[i], changed = far[n + j] - cost[i][j], n + j, True
            end = min((j for j in range(m) if room[j]), key=lambda j: far[n + j])
            path, v = [], n + end
            while v != s:
                path.append((back[v], v))
                v = back[v]
            push = min([left[s], room[end], *(flow[v][u - n] for u, v in path if u >= n)])
            for u, v in path:
                if u < n:
                    flow[u][v - n] += push
                else:
                    flow[v][u - n] -= push
            left[s] -= push
            room[end] -= push
    return flow


@dataclass(frozen=True)
class Plan:
    flow: dict[tuple[int, int], int]  # bytes from an old shard to a new one
    segments: dict[str, list[tuple[int, int, int]]] = field(default_factory=dict)  # of each file: (end row, new shard, first slot less first row)

    @property
    def moved(self) -> int:
        return sum(f for (i, j), f in self.flow.items() if i != j)

    @property
    def affected(self) -> set[int]:
        """Shards that something leaves or enters."""
        return {x for i, j in self.flow if i != j for x in (i, j)}


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def plan(old_bytes: list[int], capacities: list[int], cost: list[list[int]] | None = None) -> Plan:
    """cost: of moving a byte from an old shard to a new one; 1 for every move by default."""
    if cost is None:
        return Plan(fewest_bytes(old_bytes, capacities))
    flow = minimum_cost_flow(old_bytes, capacities, cost)
    return Plan({(i, j): f for i, row in enumerate(flow) for j, f in enumerate(row) if f})


def stretches(made: Plan) -> dict[int, list[tuple[int, int]]]:
    """Of each old shard: (end offset, new shard), in order; what stays comes first."""
    out: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for (i, j), f in sorted(made.flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        out[i].append(((out[i][-1][0] if out[i] else 0) + f, j))
    return out


def measures(id_col: str, text_col: str) -> list[Column]:
    """doc_id, size and text_crc32 of a row; size is the text's UTF-8 bytes and 1."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return [F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")]


def in_files(documents: DataFrame) -> DataFrame:
    """documents as rows of Parquet files, which know their place, under the plain names c0, c1, ...; written out if they are not."""
    hidden = any(c.lower() == "_metadata" for c in documents.columns)  # a column hides the files' own
    documents = documents.toDF(*[f"c{k}" for k in range(len(documents.columns))])
    try:
        if not hidden:
            documents.select("_metadata.file_path", "_metadata.row_index").schema
            return documents
    except AnalysisException:
        pass
    return materialize(documents, "resharded")[0]


def _places(old_shards: int, old_col: str | None) -> list[Column]:
    file = F.col("_metadata.file_path")
    old = F.coalesce(F.col(f"`{old_col}`").try_cast("int"), F.lit(-1)) if old_col else F.pmod(F.xxhash64(F.element_at(F.split(file, "/"), -1)), F.lit(old_shards)).cast("int")
    return [file.alias("__file"), F.col("_metadata.row_index").alias("__row"), old.alias("__old")]


def reshard(
    documents: DataFrame,
    shards: int,
    old_shards: int | None = None,
    old_col: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacities: list[int] | None = None,
    cost: list[list[int]] | None = None,
    block: int = BLOCK,
) -> tuple[DataFrame, Plan]:
    """documents with __old, shard and slot, which replace columns of these names, and the plan.

    The old shard (0 to old_shards - 1) is old_col, the same for all rows of a file, or else a
    hash of the file's name. Slots of a shard run from 0 without gaps. capacities: bytes by
    new shard, equal by default.
    """
    spark = documents.sparkSession
    old_shards = old_shards or shards
    names = documents.columns
    plain = {c: f"c{k}" for k, c in enumerate(names)}
    documents = in_files(documents)
    size = measures(plain[id_col], plain[text_col])[1]
    old_col = plain[old_col] if old_col else None
    rows = documents.select(*_places(old_shards, old_col), size)
    files = sorted((r["old"], r["__file"], r["bytes"], r["n"], r["last"]) for r in rows.groupBy("__file").agg(F.min("__old").alias("old"), F.max("__old").alias("last"), F.sum("size").alias("bytes"), F.count("*").alias("n")).collect())
    if bad := [f for f in files if f[0] != f[4] or not 0 <= f[0] < old_shards]:
        raise ValueError(f"files of several old shards, or outside 0 to {old_shards - 1}: {bad[:3]}")
    totals = [0] * old_shards
    for old, _, n_bytes, _, _ in files:
        totals[old] += n_bytes
    made = plan(totals, capacities or equal_capacities(sum(totals), shards), cost)

    line = stretches(made)
    at, met = [0] * old_shards, {}  # of each file: the shards it goes to, and the cuts between them in bytes from its start
    for old, file, n_bytes, _, _ in files:
        begin, at[old] = at[old], at[old] + n_bytes
        over = [(end, j) for k, (end, j) in enumerate(line[old]) if end > begin and (k == 0 or line[old][k - 1][0] < at[old])]
        met[file] = ([j for _, j in over], [end - begin for end, _ in over[:-1]])
    split = _split_rows(spark, rows, {f: cuts for f, (_, cuts) in met.items() if cuts}, block)
    filled = [0] * shards
    for _, file, _, n, _ in files:
        first = 0
        for j, end in zip(met[file][0], [*split.get(file, []), n], strict=True):
            if end > first:
                made.segments.setdefault(file, []).append((end, j, filled[j] - first))
                filled[j] += end - first
                first = end
    return placed(documents, names, made, old_shards, old_col), made


def _split_rows(spark: SparkSession, rows: DataFrame, cuts: dict[str, list[int]], block: int) -> dict[str, list[int]]:
    """For each cut of a file, the first row whose middle lies behind it."""
    if not cuts:
        return {}
    wanted = spark.createDataFrame([(f, n, c) for f, cs in cuts.items() for n, c in enumerate(cs)], "__file string, n int, cut long")
    inside = rows.join(F.broadcast(wanted.select("__file").distinct()), "__file").withColumn("block", F.floor(F.col("__row") / block))  # one row a cut
    sizes = sorted((r["__file"], r["block"], r["bytes"]) for r in inside.groupBy("__file", "block").agg(F.sum("size").alias("bytes")).collect())
    begin, hit = dict.fromkeys(cuts, 0), []
    for file, k, n_bytes in sizes:
        end = begin[file] + n_bytes
        hit += [(file, k, n, c - begin[file]) for n, c in enumerate(cuts[file]) if begin[file] < c <= end]
        begin[file] = end
    where = spark.createDataFrame(hit, "__file string, block long, n int, cut long")
    near = inside.join(F.broadcast(where.select("__file", "block").distinct()), ["__file", "block"])
    upto = F.sum("size").over(Window.partitionBy("__file", "block").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0))
    middles = near.withColumn("upto", upto).select("__file", "block", "__row", (F.col("upto") - F.ceil(F.col("size") / 2)).alias("middle"))
    # a block whose rows all lie in front of the cut ends there
    found = middles.join(F.broadcast(where), ["__file", "block"]).groupBy("__file", "n").agg(F.min(F.when(F.col("middle") >= F.col("cut"), F.col("__row"))).alias("first"), (F.max("__row") + 1).alias("end"))
    out: dict[str, list[int]] = {f: [0] * len(c) for f, c in cuts.items()}
    for r in found.collect():
        out[r["__file"]][r["n"]] = r["end"] if r["first"] is None else r["first"]
    return {f: sorted(rows) for f, rows in out.items()}


def placed(documents: DataFrame, names: list[str], made: Plan, old_shards: int, old_col: str | None) -> DataFrame:
    """documents (in_files) under their names, with __old, shard and slot: a projection, given one row a file."""
    spark = documents.sparkSession
    rows = documents.select("*", *_places(old_shards, old_col))
    table = spark.createDataFrame(list(made.segments.items()), "__file string, segments array<struct<end:long,shard:int,shift:long>>")
    table = F.broadcast(table) if len(made.segments) <= MOST_SENT else table
    own = F.element_at(F.filter("segments", lambda s: F.col("__row") < s["end"]), 1)
    kept = [F.col(f"c{k}").alias(c) for k, c in enumerate(names) if c.lower() not in ("shard", "slot", "__old")]
    return rows.join(table, "__file").withColumn("__s", own).select(*kept, "__old", F.col("__s.shard").alias("shard"), (F.col("__row") + F.col("__s.shift")).alias("slot"))


def rewrite_affected(rows: DataFrame, made: Plan, new_root: str) -> DataFrame:
    """Write the rows of affected shards to new_root/shard=K and return all rows, affected ones as
    they were written. Shards that nothing leaves or enters stay where they are. The old
    files must be kept until the result is in use, so that a failed run can be repeated."""
    spark = rows.sparkSession
    touched = sorted(made.affected)
    if not touched:
        return rows.drop("__old")
    rows.where(F.col("shard").isin(touched)).drop("__old").write.mode("overwrite").partitionBy("shard").parquet(new_root)
    schema = rows.drop("__old").schema
    written = spark.read.schema(schema).parquet(new_root)
    return written.select(*[f"`{c}`" for c in schema.names]).unionByName(rows.where(~F.col("shard").isin(touched)).drop("__old"))
