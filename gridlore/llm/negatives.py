"""Hard negatives by a vantage-point tree over norm-augmented integer vectors.

With M the greatest length of any row, a row y is augmented by sqrt(M^2 - |y|^2) and a query q by 0, so that
|q' - y'|^2 = |q|^2 + M^2 - 2 q.y: a higher score is a smaller distance, and a window of scores is an annulus.

The upper levels of the tree are fitted on a bounded sample (PER_LEAF rows a leaf, MOST_LEAVES leaves at most) and
broadcast; every row descends them to its leaf. Leaves are dealt by hash into blocks of bounded rows, so a leaf
of many copies is many blocks, and each block carries the lower levels as a tree of its own. A search takes
its queries in two steps. Each query first goes to the leaf of its annulus that is nearest by the triangle inequality,
and then, with the k-th score found there as a bound, to all other leaves that may still hold better. In a block it
takes the subtrees nearest first, each in its annulus, until the next is further than its k-th row. No bound is a
guess: results are those of comparing all rows. Queries travel packed, and a block is held once a task.

Rows with a null id, label or vector, or with a null or non-finite component, take no part, nor do those whose
squared integer length exceeds 2^62, as their scores would not fit a long. Shorter vectors count as padded with
zeros. Rows equal in id, label and vector count once; rows that share only an id are rows each, and never partners.
Ties go to the smaller id. An anchor without other rows of its label, and a positive without a row in its window, give
no rows; a negative positive score has an empty window. An empty table gives an empty result; other columns are
ignored. Labels are integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlore.llm import common

MOST_LEAVES, PER_LEAF = 4096, 16
#: Rows of a block (more where the table would have over MANY blocks), rows of a block's own leaf, queries packed in a row.
BLOCK, LARGEST_BLOCK, MANY, LEAF, PACK = 2048, 65_536, 512, 64, 512
LONGEST = float(2**62)


@dataclass
class Space:
    """The greatest squared length of the rows, and what distances may be wrong by."""

    top: float

    @property
    def slack(self) -> float:
        return 1e-6 * np.sqrt(self.top)

    def extra(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.top - np.einsum("ij,ij->i", x, x)))

    def between(self, x: np.ndarray, own: np.ndarray, v: np.ndarray, other: float) -> np.ndarray:
        """Distances of augmented rows from an augmented vantage point."""
        return np.sqrt(np.maximum(0, 2 * self.top - 2 * (x @ v + own * other)))

    def at(self, length2: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distances of queries of those squared lengths from rows of those scores; of no finite score, none or all."""
        return np.sqrt(np.maximum(0, length2 + self.top - 2 * score))


def vantage(space: Space, x: np.ndarray, own: np.ndarray) -> tuple[int, np.ndarray]:
    """The row that spreads the others most, of a few at fixed places, and all distances from it."""
    tried = [(i, space.between(x, own, x[i], own[i])) for i in np.unique(np.linspace(0, len(x) - 1, 5).astype(int))]
    return max(tried, key=lambda t: t[1].std())


class Upper:
    """The tree's upper levels: `depth` levels of vantage points in heap order, inner child first."""

    def __init__(self, sample: np.ndarray, space: Space, depth: int):
        self.space, self.depth, width = space, depth, sample.shape[1]
        self.points, self.own, self.radius = np.zeros((2**depth - 1, width)), np.zeros(2**depth - 1), np.zeros(2**depth - 1)
        extra, parts = space.extra(sample), {0: np.arange(len(sample))}
        for node in range(2**depth - 1):
            rows = parts.pop(node)
            if len(rows):
                i, d = vantage(space, sample[rows], extra[rows])
                self.points[node], self.own[node], self.radius[node] = sample[rows[i]], extra[rows[i]], np.median(d)
                inner = d <= self.radius[node]
            else:
                inner = np.zeros(0, bool)
            parts[2 * node + 1], parts[2 * node + 2] = rows[inner], rows[~inner]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        node, own = np.zeros(len(x), np.int64), self.space.extra(x)
        for _ in range(self.depth):
            d = np.sqrt(np.maximum(0, 2 * self.space.top - 2 * (np.einsum("ij,ij->i", x, self.points[node]) + own * self.own[node])))
            node = 2 * node + np.where(d <= self.radius[node], 1, 2)
        return node - (2**self.depth - 1)

    def bounds(self, q: np.ndarray, length2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance (query, leaf) that the triangle inequality allows."""
        low, high = np.zeros((len(q), 1)), np.full((len(q), 1), np.inf)
        d = self.space.at(length2[:, None], q @ self.points.T)
        for level in range(self.depth):
            nodes = slice(2**level - 1, 2 ** (level + 1) - 1)
            near, r = d[:, nodes], self.radius[nodes]
            low = np.stack([np.maximum(low, near - r), np.maximum(low, r - near)], axis=2).reshape(len(q), -1)
            high = np.stack([np.minimum(high, near + r), high], axis=2).reshape(len(q), -1)
        return low, high


class Block:
    """A block's rows in the order of its own tree, with the ranges of distances of every subtree from its vantage point."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, space: Space, nodes: np.ndarray | None = None):
        self.ids, self.labels, self.x, self.space = ids, labels, x, space
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / LEAF))))
        self.nodes = self.build() if nodes is None else nodes.reshape(-1, 5)
        self.exact = x if space.top < 2**52 else x.astype(np.int64)

    def spans(self, level: int) -> np.ndarray:
        """Where the segments of a level begin and end: halves of halves."""
        ends = np.array([0, len(self.ids)])
        for _ in range(level):
            middle = (ends[:-1] + ends[1:]) // 2
            ends = np.sort(np.concatenate([ends, middle]))
        return ends

    def build(self) -> np.ndarray:
        """Order the rows; (vantage row, least and greatest distance in the inner half, and in the outer) a node."""
        order, extra, nodes = np.arange(len(self.ids)), self.space.extra(self.x), []
        for level in range(self.depth):
            ends = self.spans(level)
            for s, e in zip(ends[:-1], ends[1:], strict=True):
                rows = order[s:e].copy()
                i, d = vantage(self.space, self.x[rows], extra[rows])
                by = np.argsort(d, kind="stable")
                m = (s + e) // 2 - s
                order[s:e] = rows[by]
                nodes.append([rows[i], *(v for part in (d[by[:m]], d[by[m:]]) for v in (part.min(initial=np.inf), part.max(initial=-np.inf)))])
        self.ids, self.labels, self.x = self.ids[order], self.labels[order], self.x[order]
        place, out = np.argsort(order), np.array(nodes, np.float64).reshape(-1, 5)
        out[:, 0] = place[out[:, 0].astype(int)]
        return out

    def bounds(self, q: np.ndarray, length2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As Upper.bounds, by the ranges of this block's subtrees."""
        low, high = np.zeros((len(q), 1)), np.full((len(q), 1), np.inf)
        points = self.nodes[:, 0].astype(int)
        d = self.space.at(length2[:, None], q @ self.x[points].T)
        for level in range(self.depth):
            nodes = slice(2**level - 1, 2 ** (level + 1) - 1)
            near, r = d[:, nodes], self.nodes[nodes, 1:]
            low = np.stack([np.maximum(low, np.maximum(near - r[:, b], r[:, a] - near)) for a, b in ((0, 1), (2, 3))], axis=2).reshape(len(q), -1)
            high = np.stack([np.minimum(high, near + r[:, b]) for b in (1, 3)], axis=2).reshape(len(q), -1)
        return low, high

    def search(self, asked: Asked, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query, id, score: each query's best k rows of its annulus, of its own label or of others."""
        width = max(self.x.shape[1], asked.q.shape[1])
        x, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (self.exact, asked.q.astype(self.exact.dtype)))
        plain = np.pad(self.x, ((0, 0), (0, width - self.x.shape[1]))) if x is not self.x else x
        self_x, self.x = self.x, plain
        low, high = self.bounds(asked.q if asked.q.shape[1] == width else np.pad(asked.q, ((0, 0), (0, width - asked.q.shape[1]))), asked.length2)
        self.x = self_x
        slack, ends = self.space.slack, self.spans(self.depth)
        low = np.where(high < (asked.inner - slack)[:, None], np.inf, low)
        order, n = np.argsort(low, axis=1, kind="stable"), len(q)
        none = np.iinfo(np.int64).min
        score, ids = np.full((n, k), none, np.int64), np.full((n, k), np.iinfo(np.int64).max, np.int64)
        limit = asked.outer + slack
        for step in range(low.shape[1]):
            leaf = order[:, step]
            active = np.flatnonzero(low[np.arange(n), leaf] <= limit)
            if not len(active):
                break
            for own in np.unique(leaf[active]):
                some, rows = active[leaf[active] == own], slice(ends[own], ends[own + 1])
                s = (q[some] @ x[rows].T).astype(np.int64)
                alike = self.labels[rows][None] == asked.label[some, None]
                ok = (alike == same) & (self.ids[rows][None] != asked.anchor[some, None]) & (s >= asked.least[some, None]) & (s <= asked.most[some, None])
                all_s = np.concatenate([score[some], np.where(ok, s, none)], axis=1)
                all_i = np.concatenate([ids[some], np.where(ok, self.ids[rows][None], np.iinfo(np.int64).max)], axis=1)
                best = np.lexsort((all_i, ~all_s), axis=1)[:, :k]  # the complement turns the order without overflow
                score[some], ids[some] = np.take_along_axis(all_s, best, 1), np.take_along_axis(all_i, best, 1)
            full = score[:, -1] != none
            limit = np.where(full, np.minimum(asked.outer, self.space.at(asked.length2, np.where(full, score[:, -1], 0).astype(float))) + slack, limit)
        found, column = np.nonzero(score != none)
        return found, ids[found, column], score[found, column]


@dataclass
class Asked:
    """Queries: their vectors, anchors, labels, windows of scores, and the annuli that follow."""

    q: np.ndarray
    anchor: np.ndarray
    label: np.ndarray
    least: np.ndarray
    most: np.ndarray
    space: Space

    def __post_init__(self):
        self.length2 = np.einsum("ij,ij->i", self.q, self.q)
        any_, all_ = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        self.outer = np.where(self.least == any_, np.inf, self.space.at(self.length2, np.where(self.least == any_, 0, self.least).astype(float)))
        self.inner = np.where(self.most == all_, 0, self.space.at(self.length2, np.where(self.most == all_, 0, self.most).astype(float)))


def matrix(vectors: list[bytes]) -> np.ndarray:
    """Rows of 32-bit integers as doubles, zero-padded to the longest."""
    flat = [np.frombuffer(v, "<i4") for v in vectors]
    out = np.zeros((len(flat), max((len(v) for v in flat), default=0)))
    for row, v in zip(out, flat, strict=True):
        row[: len(v)] = v
    return out


LONGS = ("anchor", "copy", "slot", "label", "least", "most")
PACKED = "leaf int, block int, role int, width int, " + ", ".join(f"{c} binary" for c in LONGS) + ", vectors binary, nodes binary"


def packed(leaf: int, block: int, role: int, x: np.ndarray, nodes: bytes | None, **longs: np.ndarray) -> dict:
    return {"leaf": leaf, "block": block, "role": role, "width": x.shape[1], "vectors": x.astype("<i4").tobytes(), "nodes": nodes} | {c: longs[c].astype("<i8").tobytes() if c in longs else None for c in LONGS}


class Forest:
    """The rows of a table behind the tree: its upper levels, and a written table of blocks."""

    def __init__(self, rows: DataFrame):
        """rows: a written table of id, label (long), v (32-bit integers, binary), length2 (double)."""
        self.spark, self.tables = rows.sparkSession, common.Tables()
        n, top, width = rows.agg(F.count(F.lit(1)), F.max("length2"), F.max(F.octet_length("v") / 4)).first()
        self.empty = not n
        self.space = space = Space(top or 0.0)
        rows_a_block = max(BLOCK, min(LARGEST_BLOCK, (n or 0) // MANY))
        depth = int(np.ceil(np.log2(min(MOST_LEAVES, max(1, (n or 0) / rows_a_block)))))
        share = min(1.0, max(1024, PER_LEAF * 2**depth) / max(1, n))
        drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(2**40)) <= int(share * 2**40)).select("id", "v").orderBy("id", "v").toArrow()
        sample = np.zeros((drawn.num_rows, int(width or 0)))
        some = matrix(drawn["v"].to_pylist())
        sample[:, : some.shape[1]] = some
        self.upper = self.spark.sparkContext.broadcast(upper := Upper(sample, space, depth))
        self.width, shared = upper.points.shape[1], self.upper

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 4096):
                    part = batch.slice(i, 4096)
                    x = matrix(part["v"].to_pylist())
                    leaf = shared.value.leaf(np.pad(x, ((0, 0), (0, shared.value.points.shape[1] - x.shape[1]))))
                    yield pa.RecordBatch.from_arrays([part["id"], part["label"], part["v"], pa.array(leaf.astype(np.int32))], names=["id", "label", "v", "leaf"])

        dealt = self.tables(rows.select("id", "label", "v").mapInArrow(assign, "id long, label long, v binary, leaf int"), "leaves")
        sizes = dealt.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / rows_a_block).cast("int").alias("blocks"))  # MOST_LEAVES rows at most
        self.counts = {r.leaf: r.blocks for r in sizes.collect()}
        self.tasks = min(8192, max(1, 2 * sum(self.counts.values())))

        def pack(table: pa.Table) -> pa.Table:
            rows = sorted(set(zip(table["id"].to_pylist(), table["label"].to_pylist(), table["v"].to_pylist(), strict=True)))
            ids, labels, v = zip(*rows, strict=True)
            block = Block(np.array(ids, np.int64), np.array(labels, np.int64), matrix(v), space)
            return pa.Table.from_pylist([packed(table["leaf"][0].as_py(), table["block"][0].as_py(), 0, block.x, block.nodes.tobytes(), anchor=block.ids, label=block.labels)], schema=schema)

        schema = pa.schema([(c, pa.int32() if c in ("leaf", "block", "role", "width") else pa.binary()) for c in ("leaf", "block", "role", "width", *LONGS, "vectors", "nodes")])
        self.schema = schema
        dealt = dealt.join(F.broadcast(sizes), "leaf").withColumn("block", F.pmod(F.xxhash64("id", F.lit(6)), F.col("blocks")).cast("int")).drop("blocks")
        self.blocks = self.tables(dealt.repartition(self.tasks, "leaf", "block").groupBy("leaf", "block").applyInArrow(pack, PACKED), "blocks")

    def routed(self, queries: DataFrame, first: bool) -> DataFrame:
        """Packed queries for each block they must see: those of the nearest leaf of the annulus, or of all others within the bound (kth)."""
        shared, space, counts, schema = self.upper, self.space, self.counts, self.schema

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filled = np.array(sorted(counts))
            for batch in batches:
                for i in range(0, batch.num_rows, PACK):
                    part = batch.slice(i, PACK)
                    longs = {c: np.asarray(part[c]) for c in LONGS}
                    q = matrix(part["v"].to_pylist())
                    asked = Asked(q, *(longs[c] for c in ("anchor", "label", "least", "most")), space)
                    low, high = shared.value.bounds(np.pad(q, ((0, 0), (0, shared.value.points.shape[1] - q.shape[1]))), asked.length2)
                    low, high = low[:, filled], high[:, filled]
                    may = (low <= asked.outer[:, None] + space.slack) & (high >= asked.inner[:, None] - space.slack)
                    home = np.where(may, low, np.inf).argmin(axis=1)
                    at_home = np.arange(len(filled)) == home[:, None]
                    if first:
                        may &= at_home
                    else:
                        kth = part["kth"].to_numpy(zero_copy_only=False).astype(float)  # nan: fewer than k so far
                        reach = np.where(np.isnan(kth), np.inf, space.at(asked.length2, np.nan_to_num(kth)))
                        may &= ~at_home & (low <= reach[:, None] + space.slack)
                        longs["least"] = np.where(np.isnan(kth), longs["least"], np.maximum(longs["least"], part["kth"].fill_null(0).to_numpy(zero_copy_only=False)))
                    out = []
                    for column in np.flatnonzero(may.any(axis=0)):
                        some = may[:, column]
                        out += [packed(int(filled[column]), b, 1, q[some], None, **{c: v[some] for c, v in longs.items()}) for b in range(counts[int(filled[column])])]
                        if len(out) >= 64:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)

        return queries.mapInArrow(each, PACKED)

    def visit(self, routed: DataFrame, same: bool, k: int) -> DataFrame:
        """anchor, copy, slot, id, score: the best k rows of every query in every block it was sent to."""
        space, schema = self.space, pa.schema([(c, pa.int64()) for c in ("anchor", "copy", "slot", "id", "score")])

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = None
            for batch in batches:
                for i in range(batch.num_rows):
                    (row,) = batch.slice(i, 1).to_pylist()
                    x = np.frombuffer(row["vectors"], "<i4").reshape(-1, row["width"]) if row["width"] else np.zeros((len(row["anchor"]) // 8, 0))
                    longs = {c: np.frombuffer(row[c], "<i8") for c in LONGS if row[c] is not None}
                    if row["role"] == 0:
                        block = Block(longs["anchor"], longs["label"], x.astype(float), space, np.frombuffer(row["nodes"]))
                        continue
                    asked = Asked(x.astype(float), longs["anchor"], longs["label"], longs["least"], longs["most"], space)
                    at, ids, score = block.search(asked, same, k)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (longs["anchor"][at], longs["copy"][at], longs["slot"][at], ids, score)], schema=schema)

        rows = self.blocks.unionByName(routed).repartition(self.tasks, "leaf", "block").sortWithinPartitions("leaf", "block", "role")
        return rows.mapInArrow(each, "anchor long, copy long, slot long, id long, score long")

    def search(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """anchor, copy, slot, id, score, rank: the best k rows of each query, a written table.

        queries: anchor, copy, slot (together a key), label, least, most (scores; the extremes of a long for none), v."""
        best = Window.partitionBy("anchor", "copy", "slot").orderBy(F.desc("score"), "id")
        ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        near = self.tables(ranked(self.visit(self.routed(queries, True), same, k)), "near")
        bound = near.where(F.col("rank") == k).select("anchor", "copy", "slot", F.col("score").alias("kth"))
        rest = self.visit(self.routed(queries.join(bound, ["anchor", "copy", "slot"], "left"), False), same, k)
        return self.tables(ranked(near.drop("rank").unionByName(rest)), "found")


def windows(score: Column, low: int, high: int) -> list[Column]:
    """Least and greatest integer n with low * score <= 100 n <= high * score."""
    down = lambda x: F.floor(x / F.lit(100).cast("decimal(3,0)")).cast("long")
    wide = score.cast("decimal(20,0)")
    return [(-down(-wide * low)).alias("least"), down(wide * high).alias("most")]


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label (integers) and vector (array<bigint>). Anchors are the rows where `anchors` holds."""
    tables = common.Tables()
    length2 = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    some = rows.where("vec_id is not null and label is not null and vector is not null and forall(vector, x -> x is not null)")
    some = some.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector", length2.alias("length2"), anchors.alias("anchor")).where(F.col("length2") < LONGEST)

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch["vector"]
            flat, ends = np.asarray(column.values).astype("<i4"), np.asarray(column.offsets)
            v = pa.array([flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], v, batch["length2"], batch["anchor"]], names=["id", "label", "v", "length2", "anchor"])

    own = tables(some.select("id", "label", "vector", "length2", "anchor").mapInArrow(bytes_of, "id long, label long, v binary, length2 double, anchor boolean"), "rows")
    forest = Forest(own)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if forest.empty:
        tables.drop_but()
        forest.tables.drop_but()
        return rows.sparkSession.createDataFrame([], out)
    asked = own.where("anchor").select(F.col("id").alias("anchor"), F.xxhash64("id", "label", "v").alias("copy"), "label", "v").distinct()
    asked = tables(asked, "anchors")
    any_, all_ = F.lit(-(2**63)).cast("long"), F.lit(2**63 - 1)
    found = forest.search(asked.select("anchor", "copy", F.lit(0).cast("long").alias("slot"), "label", any_.alias("least"), all_.alias("most"), "v"), True, positives)
    kept = found.select("anchor", "copy", F.col("rank").cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    queries = asked.join(kept, ["anchor", "copy"]).select("anchor", "copy", "slot", "label", *windows(F.col("positive_score"), low, high), "v").where("least <= most")
    hard = forest.search(tables(queries, "windows"), False, negatives)
    result = tables(hard.join(kept, ["anchor", "copy", "slot"]).select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    tables.drop_but(result)
    forest.tables.drop_but()
    return result


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = common.table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.when(finite, F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))))
    return mine(v.select("vec_id", moved.alias("label"), whole.alias("vector")), F.col("vec_id") % 50 == 0)


ORACLE = """
    WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.id AS a, a.l AS la, b.id AS b, b.l AS lb, list_dot_product(a.e, b.e)::BIGINT AS s FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
    p AS (SELECT * FROM s WHERE la = lb QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
    n AS (SELECT p.a, p.b, p.s, n.b AS nb, n.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS r FROM p JOIN s n ON n.a = p.a AND n.la <> n.lb AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s)
    SELECT a AS anchor_id, b AS positive_id, r::INT AS rank, nb AS negative_id, s AS positive_score, ns AS negative_score FROM n WHERE r <= 3"""
