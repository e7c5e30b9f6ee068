"""Near-duplicates of embeddings by product quantisation over coarse inverted lists.

Equal vectors of a label are one class, with its count. A coarse quantiser and residual subspace codebooks
are fitted on a bounded sample (SAMPLE vectors, more only as PER_CENTRE a list up to MOST_LISTS lists); every class
is indexed. Beyond TOP lists the quantiser is fitted in two levels: about the root of the number of lists as cells, in the
driver on SAMPLE vectors, and then each cell's own lists in a Spark task on its part of the larger sample, which never
leaves the executors. Only centres come back, and the index is broadcast once. A class stands in the list of its nearest centroid as that list's residual codes, and its list
meets the PROBES lists nearest to the class, so two lists meet if any class of either probes the other. Where the plane between
two centres is further from a class than the threshold's distance, no member of the other list can link with it.

Lists are packed into chunks of at most CHUNK classes. A chunk meets the codes of the chunks of its own and of
the lists it probes: its classes' tables of distances to the codewords of each subspace give asymmetric distances
by lookup, corrected by the members' own quantisation errors. Only codes travel to other lists; classes with
a partner within SLACK of the threshold are named, their vectors fetched, and the two chunks' survivors
reranked by exact cosine in double precision. Every pair of chunks is met once, so a link counts for both sides.

A hot label or list is many chunks, so no one task's work. A pair of chunks returns counts of links and a
spanning forest of them, never the pairs themselves: a group of near copies costs comparisons but no rows.

Vectors that are null, zero, or hold null or non-finite components, and those with a null label or id, link
with nothing: no links, their own component, kept. Vectors of different lengths do not compare. Repeated
rows are vectors each, and vectors that share an id are one node of the components. Ties do not matter. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm import common

SAMPLE, PER_LIST, MOST_LISTS, PROBES = 16_384, 128, 32_768, 10
#: Lists that the driver fits on its own, and sample vectors a list.
TOP, PER_CENTRE = 256, 16
SUBSPACES, WORDS = 8, 64
SLACK = 0.12
CHUNK = 1024


def nearest(x: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """Indices of the k nearest centres of each row, nearest first."""
    k = min(k, len(centres))
    out, norms = np.empty((len(x), k), np.int32), (centres * centres).sum(axis=1)
    for i in range(0, len(x), 2048):
        d = norms - 2 * x[i : i + 2048] @ centres.T
        if k == 1:
            out[i : i + 2048] = d.argmin(axis=1)[:, None]
        else:
            some = np.argpartition(d, k - 1, axis=1)[:, :k]
            out[i : i + 2048] = np.take_along_axis(some, np.take_along_axis(d, some, 1).argsort(axis=1, kind="stable"), 1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    r = np.random.default_rng(seed)
    centres = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)[:, 0]
        sums, n = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
        np.add.at(sums, at, x)
        some = n > 0
        centres[some] = sums[some] / n[some, None]
        if (~some).any():
            centres[~some] = x[r.choice(len(x), int((~some).sum()))]
    return centres


def refined(sample: DataFrame, lists: int, width: int) -> np.ndarray:
    """Centres of all lists: those of each cell are fitted in a task of its own, in proportion to its share of the sample.

    sample: cell and unit (half-precision vectors, binary). A cell's share is bounded by its part of the sample, PER_CENTRE * lists
    vectors in all; a hot cell is one task of at most that many rows, with as many more centres."""
    total = sample.count()

    def each(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(sorted(table["unit"].to_pylist())), "<f2").astype(np.float32).reshape(-1, width)
        k = max(1, round(lists * len(x) / total))
        # A large cell is parted again, so that no step compares all its rows with all its centres.
        if k > TOP:
            top = kmeans(x[:: max(1, len(x) // SAMPLE)], int(np.sqrt(k)))
            at = nearest(x, top)[:, 0]
            found = np.concatenate([kmeans(x[at == i], max(1, round(k * (at == i).sum() / len(x)))) for i in np.unique(at)])
        else:
            found = kmeans(x, k)
        return pa.table({"centre": pa.array([c.astype("<f4").tobytes() for c in found], pa.binary())})

    rows = sample.groupBy("cell").applyInArrow(each, "centre binary").toArrow()  # at most MOST_LISTS centres, but for rounding
    return np.frombuffer(b"".join(sorted(rows["centre"].to_pylist())), "<f4").reshape(-1, width).copy()


class Index:
    def __init__(self, sample: np.ndarray, lists: int, centres: np.ndarray | None = None):
        """From a sample in the driver; centres, if given, are those of all lists."""
        pad = -sample.shape[1] % SUBSPACES
        self.width = sample.shape[1] + pad
        x = self.unit(sample)
        self.centres = kmeans(x, lists) if centres is None else centres
        rest = (x - self.centres[nearest(x, self.centres)[:, 0]])[:SAMPLE].reshape(min(len(x), SAMPLE), SUBSPACES, -1)
        self.words = np.stack([self.full(kmeans(rest[:, m], WORDS, seed=m)) for m in range(SUBSPACES)])

    @staticmethod
    def full(words: np.ndarray) -> np.ndarray:
        return np.concatenate([words, np.repeat(words[-1:], WORDS - len(words), axis=0)])

    def unit(self, x: np.ndarray) -> np.ndarray:
        """Rows of length one, zero-padded to the index's width."""
        out = np.zeros((len(x), self.width), np.float32)
        out[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
        return out

    def reach(self, x: np.ndarray, home: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How far rows of x are from the plane between two centres; what is nearer to `other` is no closer."""
        a, b = self.centres[home], self.centres[other]
        gap = np.linalg.norm(b - a, axis=-1)
        far = np.einsum("...j,...j->...", x - (a + b) / 2, a - b)
        return np.divide(far, gap, out=np.zeros_like(far), where=gap > 0)

    def encode(self, x: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists by nearness (the first is home), residual codes, squared quantisation error.

        A list whose members are all further than `far` is home instead."""
        probes = nearest(x, self.centres, PROBES)
        for k in range(1, probes.shape[1]):
            out = self.reach(x, probes[:, 0], probes[:, k]) > far
            probes[out, k] = probes[out, 0]
        rest = (x - self.centres[probes[:, 0]]).reshape(len(x), SUBSPACES, -1)
        codes = np.stack([nearest(rest[:, m], self.words[m])[:, 0] for m in range(SUBSPACES)], axis=1)
        error = sum(((rest[:, m] - self.words[m][codes[:, m]]) ** 2).sum(axis=1) for m in range(SUBSPACES))
        return probes, codes.astype(np.uint8), error.astype(np.float32)

    def offsets(self, home: np.ndarray, codes: np.ndarray, error: np.ndarray) -> np.ndarray:
        """What of a member's squared distance no query changes: |y|^2 + 2cy, less its quantisation error."""
        y = np.concatenate([self.words[m][codes[:, m]] for m in range(SUBSPACES)], axis=1)
        return np.einsum("ij,ij->i", y, y + 2 * self.centres[home]) - error

    def table(self, q: np.ndarray) -> np.ndarray:
        """(subspace, word, query): -2 times the products of queries with codewords."""
        return -2 * np.einsum("mwd,qmd->mwq", self.words, q.reshape(len(q), SUBSPACES, -1))

    def distances(self, table: np.ndarray, q: np.ndarray, home: int, codes: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances (member, query) by table lookup: |q - c|^2 + |y|^2 + 2cy - 2qy."""
        out = table[0].take(codes[:, 0], 0)
        for m in range(1, SUBSPACES):
            out += table[m].take(codes[:, m], 0)
        out += offset[:, None]
        rest = q - self.centres[home]
        out += np.einsum("ij,ij->i", rest, rest)
        return out


def apart(least: float) -> float:
    """The distance of unit vectors at that cosine, with room for half-precision rounding."""
    return float(np.sqrt(2 - 2 * least)) + 0.005


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers without nulls as rows of doubles, shorter ones zero-padded."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.asarray(column.offsets)
    flat, sizes = np.asarray(column.values)[ends[0] : ends[-1]].astype(np.float64), np.diff(ends)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def once(table: pa.Table, *keys: str) -> pa.Table:
    """Rows in the order of the keys, repeated ones once."""
    columns = [np.asarray(table[k]) for k in reversed(keys)]
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    return table.take(pa.array(order[new]))


PACKED = "label {label}, dim int, home int, chunk int, ids binary, hashes binary, codes binary, offsets binary, vectors binary, probes array<int>"
SURVIVORS = "task long, side int, rep long, h long"


def packed(indexed: DataFrame, shared: Broadcast, label_type: str) -> DataFrame:
    """One row a chunk of a list: its classes' ids, hashes, codes, offsets and rough vectors end to end, and the lists it meets."""

    def pack(table: pa.Table) -> pa.Table:
        table = once(table, "rep", "h")
        at = np.asarray(table["home"])
        codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(len(at), SUBSPACES)
        offsets = shared.value.offsets(at, codes, np.asarray(table["error"])).astype("<f4").tobytes()
        first = {k: table[k][:1] for k in ("label", "dim", "home", "chunk")}
        met = np.unique(np.asarray(table["probes"].combine_chunks().flatten())).astype(np.int32)
        numbers = lambda name, kind: pa.array([np.asarray(table[name]).astype(kind).tobytes()], pa.binary())
        rest = {"ids": numbers("rep", "<i8"), "hashes": numbers("h", "<i8"), "codes": pa.array([codes.tobytes()], pa.binary()), "offsets": pa.array([offsets], pa.binary())}
        return pa.table({**{k: v.combine_chunks() for k, v in first.items()}, **rest, "vectors": pa.array([b"".join(table["rough"].to_pylist())], pa.binary()), "probes": pa.array([met.tolist()], pa.list_(pa.int32()))})

    sizes = indexed.groupBy("label", "dim", "home").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    dealt = indexed.join(sizes, ["label", "dim", "home"]).withColumn("chunk", F.pmod(F.xxhash64("rep", "h", F.lit(3)), F.col("chunks")).cast("int")).drop("chunks")
    return dealt.groupBy("label", "dim", "home", "chunk").applyInArrow(pack, PACKED.format(label=label_type))


def survivors(chunks: DataFrame, shared: Broadcast, least: float) -> DataFrame:
    """task, side, rep, h: classes of two chunks that may link across them. A task is a pair of chunks."""
    spot = ["label", "dim", "home", "chunk"]
    ends = chunks.select("label", "dim", "home", F.explode("probes").alias("other"))
    meets = ends.select("label", "dim", F.least("home", "other").alias("low"), F.greatest("home", "other").alias("high")).distinct()
    codes = chunks.select("label", "dim", F.col("home").alias("high"), F.col("chunk").alias("other"), "ids", "hashes", "codes", "offsets")
    lows = chunks.select("label", "dim", F.col("home").alias("low"), "chunk")
    asked = lows.join(meets, ["label", "dim", "low"]).join(codes, ["label", "dim", "high"]).where("low <> high or chunk <= other")
    task = F.xxhash64("label", "dim", "low", "chunk", "high", "other").alias("task")
    blank = lambda kind, name: F.lit(None).cast(kind).alias(name)
    own = chunks.select("label", "dim", F.col("home").alias("low"), "chunk", F.lit(0).alias("role"), F.col("home").alias("high"), F.col("chunk").alias("other"), F.lit(0).cast("long").alias("task"), "ids", "hashes", blank("binary", "codes"), blank("binary", "offsets"), "vectors")
    other = asked.select("label", "dim", "low", "chunk", F.lit(1).alias("role"), "high", "other", task, "ids", "hashes", "codes", "offsets", blank("binary", "vectors"))
    place = ["label", "dim", "low", "chunk"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = hashes = vectors = table = None
        index, far = shared.value, apart(least)
        spent = lambda rows: pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[i] for r in rows]), t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["task", "side", "rep", "h"])
        for batch in batches:
            out = []
            for row in batch.select(["low", "chunk", "role", "high", "other", "task", "ids", "hashes", "codes", "offsets", "vectors"]).to_pylist():
                if row["role"] == 0:
                    ids, hashes = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["hashes"], "<i8")
                    vectors = np.frombuffer(row["vectors"], "<f2").astype(np.float32).reshape(len(ids), -1)
                    table = index.table(vectors)
                    continue
                rep, h = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["hashes"], "<i8")
                use = np.flatnonzero(index.reach(vectors, row["low"], row["high"]) <= far)
                if not len(use):
                    continue
                d = index.distances(table[:, :, use], vectors[use], row["high"], np.frombuffer(row["codes"], np.uint8).reshape(len(rep), SUBSPACES), np.frombuffer(row["offsets"], "<f4"))
                near = (d <= 2 * (1 - least + SLACK)).T
                if row["low"] == row["high"] and row["chunk"] == row["other"]:
                    np.fill_diagonal(near, False)
                    near |= near.T
                for side, some, i, j in ((0, near.any(axis=1), ids[use], hashes[use]), (1, near.any(axis=0), rep, h)):
                    k = int(some.sum())
                    if k:
                        out.append((np.full(k, row["task"]), np.full(k, side, np.int32), i[some], j[some]))
            if out:
                yield spent(out)

    rows = own.unionByName(other).repartition(*place).sortWithinPartitions(*place, "role")
    return rows.mapInArrow(each, SURVIVORS)


def rerank(side: np.ndarray, ids: np.ndarray, hashes: np.ndarray, n: np.ndarray, x: np.ndarray, least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each class by exact cosine, and a spanning forest of the links, in one pair of chunks."""
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    norm, count, root, forest = np.sqrt(np.einsum("ij,ij->i", x, x)), np.zeros(len(side), np.int64), np.arange(len(b)), []
    within = len(np.intersect1d(hashes[a], hashes[b])) > 0  # a chunk with itself: a class is on both sides, and pairs come twice
    for begin in range(0, len(a), 512):
        part = a[begin : begin + 512]
        # A matrix product picks the pairs near the threshold; each is decided by its own sum of products, as SQL would.
        rough = (x[part] @ x[b].T) / (norm[part, None] * norm[b][None])
        i, j = np.nonzero(rough >= least - 1e-9)
        i, j = part[i], b[j]
        ok = (hashes[i] != hashes[j]) | (ids[i] != ids[j])
        ok &= np.concatenate([np.einsum("ij,ij->i", x[i[s : s + 65_536]], x[j[s : s + 65_536]]) / (norm[i[s : s + 65_536]] * norm[j[s : s + 65_536]]) for s in range(0, len(i), 65_536)] or [np.zeros(0)]) >= least
        i, j = i[ok], j[ok]
        np.add.at(count, i, n[j])
        if not within:
            np.add.at(count, j, n[i])
        at = np.searchsorted(b, j)
        for k, start in zip(*np.unique(i, return_index=True), strict=True):
            own = at[start : np.searchsorted(i, k, side="right")]
            roots, first = np.unique(root[own], return_index=True)
            forest += [(int(ids[k]), int(ids[b[own[f]]])) for f in first]
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
    return count, forest


def linked(found: DataFrame, width: int, least: float) -> DataFrame:
    """rep, h, links and edges (a, b) of survivors with their vectors (embedding) and counts (n)."""
    kind = "rep long, h long, links long, a long, b long"

    def each(table: pa.Table) -> pa.Table:
        table = once(table, "side", "rep", "h")
        ids, hashes, side, n = (np.asarray(table[c]) for c in ("rep", "h", "side", "n"))
        count, forest = rerank(side, ids, hashes, n, matrix(table["embedding"], width), least)
        some, m = np.flatnonzero(count), len(forest)
        none = lambda k: pa.nulls(k, pa.int64())
        both = lambda x, y: pa.concat_arrays([x, y])
        values = lambda v: pa.array(v, pa.int64())
        return pa.table({"rep": both(values(ids[some]), none(m)), "h": both(values(hashes[some]), none(m)), "links": both(values(count[some]), none(m)),
                         "a": both(none(len(some)), values([e[0] for e in forest])), "b": both(none(len(some)), values([e[1] for e in forest]))})

    return found.groupBy("task").applyInArrow(each, kind)


def near(vectors: DataFrame, least: float = 0.93, per_list: int = PER_LIST) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors."""
    tables = common.Tables()
    cast = dict(vectors.dtypes)["embedding"] if dict(vectors.dtypes)["embedding"] in ("array<float>", "array<double>") else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast(cast).alias("embedding"))
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("fit", F.coalesce(fit & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    v = v.withColumns({"dim": F.coalesce(F.size("embedding"), F.lit(0)), "h": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    keys, label_type = ["label", "dim", "h", "h2"], dict(v.dtypes)["label"]
    ids = tables(v.select("vec_id", *keys, "fit"), "ids")
    classes = tables(ids.where("fit").groupBy(*keys).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    total, most, width = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n"), F.max("dim")).first()
    if not total:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # One row a class: where a class has several, copies are looked up in the small table of those.
    copies = tables(classes.where("n > 1").select(*keys, F.col("rep").alias("first")), "copies")
    firsts = v.where("fit").join(copies, keys, "left").where("first is null or first = vec_id").drop("first", "fit")
    # The sample is thinned by hash where the vectors are read, to its bound in expectation.
    lists = int(min(MOST_LISTS, max(1, most // per_list)))
    drawn_by = lambda share, seed: F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(2**40)) <= int(min(1.0, share) * 2**40)
    drawn = firsts.where(drawn_by(SAMPLE / total, 2)).select("h", "vec_id", "embedding").toArrow().sort_by([("h", "ascending"), ("vec_id", "ascending")])
    first = matrix(drawn["embedding"], width) if drawn.num_rows else np.eye(1, width)
    index = Index(first, 1 if not drawn.num_rows else min(lists, TOP))
    if lists > TOP and drawn.num_rows:
        cells = kmeans(index.unit(first), int(np.sqrt(lists)))
        coarse = v.sparkSession.sparkContext.broadcast((index, cells))

        def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, tops = coarse.value
            for batch in batches:
                x = own.unit(matrix(batch["embedding"], width))
                yield pa.RecordBatch.from_arrays([pa.array(nearest(x, tops)[:, 0]), pa.array([r.tobytes() for r in x.astype("<f2")], pa.binary())], names=["cell", "unit"])

        sample = tables(firsts.where(drawn_by(PER_CENTRE * lists / total, 4)).select("embedding").mapInArrow(cell, "cell int, unit binary"), "sample")
        index = Index(first, lists, refined(sample, lists, index.width))
    shared = v.sparkSession.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                x = index.unit(matrix(part["embedding"], width))
                probes, codes, error = index.encode(x, apart(least))
                lists_of = pa.ListArray.from_arrays(np.arange(0, probes.size + 1, probes.shape[1], dtype=np.int32), pa.array(probes.ravel(), pa.int32()))
                blobs = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([part["label"], part["dim"], part["vec_id"], part["h"], pa.array(probes[:, 0], pa.int32()), lists_of, blobs(codes), pa.array(error), blobs(x.astype("<f2"))], names=["label", "dim", "rep", "h", "home", "probes", "codes", "error", "rough"])

    indexed = tables(firsts.select("label", "dim", "vec_id", "h", "embedding").mapInArrow(assign, f"label {label_type}, dim int, rep long, h long, home int, probes array<int>, codes binary, error float, rough binary"), "index")
    chunks = tables(packed(indexed, shared, label_type), "chunks")
    some = tables(survivors(chunks, shared, least), "survivors")
    wanted = firsts.join(tables(some.select(F.col("rep").alias("vec_id"), "h").distinct(), "wanted"), ["vec_id", "h"], "left_semi")
    sized = wanted.join(classes.where("n > 1").select(*keys, "n"), keys, "left").select(F.col("vec_id").alias("rep"), "h", "embedding", F.coalesce("n", F.lit(1)).cast("long").alias("n"))
    found = tables(linked(some.join(sized, ["rep", "h"]), width, least), "links")
    counts = tables(found.where("links is not null").groupBy("rep", "h").agg(F.sum("links").alias("links")), "counts")
    comps = tables(common.connected_components(found.where("b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst"))), "components")
    # Few classes have links or copies; the rest are alone.
    known = classes.join(counts, ["rep", "h"], "left").join(comps, F.col("rep") == F.col("id"), "left").where("n > 1 or links is not null or component is not null")
    known = known.select(*keys, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), F.lit(True).alias("fit"))
    known = tables(known, "known")
    tables.drop_but(ids, known)
    out = ids.join(known, [*keys, "fit"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(common.table(spark, sf_dir, "embeddings"))
