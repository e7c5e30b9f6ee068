"""Near-duplicates by SetSketch registers.

A document's set holds its distinct word shingles, as 64-bit hashes. Register i of the sketch of a set is
floor(1 - log_b(x)) of the least exponential draw x that any shingle makes under seed i, truncated to
0..Q + 1; registers of two sets merge by max. Bands of ROWS registers are keys; documents that share a key
are candidates. Candidates' similarity is estimated jointly with the sets' sizes by maximum likelihood over
the counts of registers that are greater, less and equal; those that may reach the threshold are confirmed
on their full sets.

Only connectivity is asked for, so pairs are never listed. A key's documents meet its least and its greatest one;
pairs that may reach the threshold by estimate are loose links, and their components loose groups. Where the other
documents of a key are of several groups, those of the lesser groups meet all others in bounded blocks of registers, and
a forest of the pairs that may reach the threshold joins their groups. So two documents that share a key and may
reach the threshold are in one loose group. A group's documents share a task, which confirms pairs by falling
estimate and passes over those already connected. Groups of over BLOCK documents are dealt into blocks; blocks
are joined through a bounded sample of one block. Documents of such groups that are not connected then meet once
more, in blocks of registers (by key where the group is very large), and the texts of those that an estimate asks
for are fetched and confirmed. So every pair that shares a key and may reach the threshold ends up connected or
compared, no task holds more than two blocks, and a group of near copies costs few comparisons a document. Sets
that are equal as a whole are one class beforehand.

A null text, and one without words, has an empty set and links with nothing. Very long texts are read whole, one
at a time. Rows with a null id link with nothing and have no component; they are kept. Rows that share an id are
one document, whose set is that of the text with the least hash. Ties do not matter: the component is the
smallest id. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridlore.llm import common

BANDS, ROWS = 32, 6
BASE, RATE, Q = 1.02, 20.0, 2046
#: Estimates this far below the threshold are still confirmed: four standard errors of BANDS * ROWS registers.
SLACK = 0.12

_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 2**64)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_SEEDS = np.random.default_rng(7)
_XOR = _SEEDS.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)[:, None]
_MUL = (_SEEDS.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_FOLD = _SEEDS.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_STEPS = _SEEDS.integers(0, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64 bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Texts to sorted distinct hashes of their k-word shingles; powers are kept between texts."""

    def __init__(self, k: int):
        self.k = k
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            up, down = np.full(size, _P, np.uint64), np.full(size, _INV, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def words(self, data: np.ndarray) -> np.ndarray:
        """A hash of each word: a polynomial of its bytes from prefix sums, shifted to start at power 0."""
        return self.found(data)[1]

    def found(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word begins, and its hash, which does not depend on that place."""
        blank = np.ones(len(data) + 2, bool)
        blank[1:-1] = _BLANK[data]
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        begin, end = edge[0::2], edge[1::2]
        self.powers(len(data))
        terms, sums = np.add(data, 1, dtype=np.uint64), np.zeros(len(data) + 1, np.uint64)
        terms *= self.up[: len(data)]
        np.cumsum(terms, out=sums[1:])
        return begin, mix((sums[end] - sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))

    def __call__(self, text: str | None) -> np.ndarray:
        data = np.frombuffer((text or "").encode().lower(), np.uint8)
        w = self.words(data) if len(data) else np.zeros(0, np.uint64)
        if not len(w):
            return w
        k = min(self.k, len(w))
        h = np.zeros(len(w) - k + 1, np.uint64)
        for j in range(k):
            h += w[j : len(w) - k + 1 + j] * _STEPS[j]
        return np.unique(mix(h + np.uint64(k)))


def registers(s: np.ndarray) -> np.ndarray:
    """Truncated, exponentially spaced minima of a set of hashes."""
    low = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    h = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(h), 1024):
        np.minimum(low, ((h[i : i + 1024] ^ _XOR) * _MUL).min(axis=1), out=low)
    x = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, Q + 1).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys; a key names its band too."""
    folded = (regs.reshape(-1, BANDS, ROWS).astype(np.uint64) * _FOLD).sum(axis=2, dtype=np.uint64)
    return mix(folded + np.arange(BANDS, dtype=np.uint64) * np.uint64(_P)).view(np.int64)


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, grid: int = 60) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from rows of registers and set sizes."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, grid)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
    value = more * np.log(up) + less * np.log(down) + (a.shape[1] - more - less) * np.log(np.maximum(1 - up - down, 1e-12))
    return np.take_along_axis(j, value.argmax(axis=1)[:, None], 1)[:, 0]


SKETCH = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("h", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("f1", T.LongType()),
        T.StructField("f2", T.LongType()),
        T.StructField("regs", T.BinaryType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
    ]
)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the whole set, registers and band keys."""

    def start():
        shingles = Shingler(k)

        def work(doc_ids: list, texts: list, hashes: list) -> list:
            regs, sizes, prints = np.empty((len(texts), BANDS * ROWS), np.uint16), [], np.zeros((2, len(texts)), np.uint64)
            for j, text in enumerate(texts):
                s = shingles(text)
                regs[j] = registers(s)
                sizes.append(len(s))
                prints[:, j] = s.sum(dtype=np.uint64), mix(s + np.uint64(1)).sum(dtype=np.uint64)
            return [doc_ids, hashes, sizes, *prints.view(np.int64), [r.tobytes() for r in regs], list(band_keys(regs))]

        return work

    return common.map_columns(docs.select("doc_id", "text", "h"), SKETCH, start)


def estimate(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose estimated similarity is at least `least`."""
    side = lambda x: sketches.select(*(F.col(c).alias(x if c == "doc_id" else f"{c}_{x}") for c in ("doc_id", "n_shingles", "regs")))

    def work(a: list, b: list, na: list, nb: list, ra: list, rb: list) -> list:
        x, y = (np.frombuffer(b"".join(r), np.uint16).reshape(len(r), -1) for r in (ra, rb))
        near = likely(x, y, np.array(na, float), np.array(nb, float)) >= least
        return [[i for i, ok in zip(c, near, strict=True) if ok] for c in (a, b)]

    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return common.map_columns(both.select("a", "b", "n_shingles_a", "n_shingles_b", "regs_a", "regs_b"), "a long, b long", lambda: work, rows=4000)


def meetings(keyed: DataFrame, tables: common.Tables) -> DataFrame:
    """key, a, b: the key's least and greatest documents, each as a beside every other document b. Keys of one document go early."""
    shared = keyed.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high")
    rows = keyed.join(tables(shared, "keys"), "key").select("key", F.explode(F.array("low", "high")).alias("a"), F.col("doc_id").alias("b"), "low")
    return rows.where("a <> b and (a = low or b <> low)").drop("low")


def gathered(rooted: DataFrame, most: int, tables: common.Tables) -> DataFrame:
    """rooted without the keys of one root, and with a key's largest root in place of the key: keys that the same
    documents share become one, which holds every pair of theirs. Of over `most` documents, the keys stay apart."""
    sizes = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    rows = tables(rooted.join(sizes.where("roots > 1").drop("roots"), "key"), "rooted")
    one = tables(rows.select(F.col("main").alias("key"), "doc_id", "root").distinct(), "gathered")
    large = tables(one.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key"), "large")
    if large.isEmpty():
        return one
    return one.join(large, "key", "left_anti").unionByName(rows.join(large.withColumnRenamed("key", "main"), "main", "left_semi").select("key", "doc_id", "root"))


def dealt(rooted: DataFrame, block: int) -> DataFrame:
    """key, i, j, part, doc_id, root: documents of the keys that hold several roots, dealt so that each of a lesser
    root of its key shares a task with every other document of the key.

    The documents of the key's largest root are dealt into blocks i, those of lesser roots into blocks j. Each of these
    visits all i with its own j; with i below zero, they meet one another, in pairs of blocks. part is their own j, or -1."""
    sizes = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("roots"))
    open_ = sizes.where("roots > 1").select("key", "main", F.ceil(F.col("most") / block).cast("int").alias("ni"), F.ceil((F.col("all") - F.col("most")) / block).cast("int").alias("nj"), (F.col("roots") - 1).alias("lesser"))
    rows = rooted.join(open_, "key").withColumns({"minor": F.col("root") != F.col("main"), "spot": F.xxhash64("doc_id", F.lit(4))})
    main = rows.where("not minor").select("key", F.expr("cast(pmod(spot, ni) as int)").alias("i"), F.explode(F.expr("sequence(0, nj - 1)")).alias("j"), F.lit(-1).alias("part"), "doc_id", "root")
    lesser = rows.where("minor").withColumn("part", F.expr("cast(pmod(spot, nj) as int)"))
    across = lesser.select("key", F.explode(F.expr("sequence(0, ni - 1)")).alias("i"), F.col("part").alias("j"), "part", "doc_id", "root")
    within = lesser.where("lesser > 1").withColumn("other", F.explode(F.expr("sequence(0, nj - 1)")))
    within = within.select("key", (-1 - F.least("part", "other")).alias("i"), F.greatest("part", "other").alias("j"), "part", "doc_id", "root")
    return main.unionByName(across).unionByName(within)


def close(r: np.ndarray, n: np.ndarray, x: int, y: np.ndarray, percent: int) -> np.ndarray:
    """Those of y that may be linked with x, by sizes and by estimate."""
    y = y[100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])]
    y = y[(r[y] == r[x]).mean(axis=1) >= percent / 100 - 2 * SLACK]
    return y[likely(np.broadcast_to(r[x], r[y].shape), r[y], np.full(len(y), n[x]), n[y]) >= percent / 100 - SLACK] if len(y) else y


def partners(i: int, j: int, part: np.ndarray, x: int) -> np.ndarray:
    """The documents that x meets in a task of `dealt`, so that every pair meets in one task of its key."""
    if i >= 0:
        return np.flatnonzero(part < 0) if part[x] >= 0 else np.zeros(0, np.int64)
    if -1 - i == j:
        return np.arange(x + 1, len(part))
    return np.flatnonzero(part == j) if part[x] == -1 - i else np.zeros(0, np.int64)


def sharers(rooted: DataFrame, sketches: DataFrame, percent: int, block: int) -> DataFrame:
    """Loose edges (a, b) among rooted (key, doc_id, root): a task returns a forest of its pairs that may be linked."""

    def start():
        def work(i: int, j: int, part: list, ids: list, roots: list, sizes: list, regs: list) -> list:
            r, n, at = np.frombuffer(b"".join(regs), np.uint16).reshape(len(ids), -1), np.array(sizes, float), np.array(part)
            label, out = np.unique(np.array(roots), return_inverse=True)[1], []
            for x in range(len(ids)):
                y = partners(i, j, at, x)
                for k in close(r, n, x, y[label[y] != label[x]], percent):
                    if label[k] != label[x]:
                        label[label == label[k]] = label[x]
                        out.append((ids[x], ids[int(k)]))
            return [[e[0] for e in out], [e[1] for e in out]]

        return lambda key, i, j, *columns: work(i[0], j[0], *columns)

    rows = dealt(rooted, block).join(sketches, "doc_id").select("key", "i", "j", "part", "doc_id", "root", "n_shingles", "regs")
    return common.map_groups(rows, ["key", "i", "j"], "a long, b long", start)


def loosely(keyed: DataFrame, firsts: DataFrame, percent: int, block: int, most: int, tables: common.Tables) -> tuple[DataFrame, DataFrame]:
    """Loose groups (id, component) that hold any two documents of a key which may be linked, and the sketches of their documents."""
    met = tables(meetings(keyed, tables), "met")
    pairs = tables(met.select("a", "b").distinct(), "pairs")
    ids = tables(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    sketches = tables(firsts.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "h", "n_shingles", "regs", "keys"), "near")
    edges = tables(estimate(pairs, sketches, percent / 100 - SLACK), "loose")
    ends = [F.col("a").alias("src"), F.col("b").alias("dst")]
    groups = tables(common.connected_components(edges.select(*ends)), "groups")
    # Every pair with a hub is estimated. Other pairs of a key are left only where its other documents are of several groups.
    rooted = met.groupBy("key", "b").agg(F.count(F.lit(1)).alias("n")).where("n = 2").join(groups, F.col("b") == F.col("id"), "left").select("key", F.col("b").alias("doc_id"), F.coalesce("component", "b").alias("root"))
    more = tables(sharers(gathered(rooted, most * block, tables), sketches, percent, block), "loose")
    return groups if more.isEmpty() else tables(common.merge_components(groups, more.select(*ends)), "groups"), sketches


class Linker:
    """Forest of the links among some documents, confirmed on their full sets."""

    def __init__(self, k: int, percent: int):
        self.shingles, self.percent = Shingler(k), percent

    def __call__(self, ids: list, texts: list, sizes: list, regs: list, roots: list, meet: Callable[[int], np.ndarray], wanted: Callable[[int, np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int]]:
        """Pairs of x with meet(x) whose roots differ, by falling estimate; those that are connected by then are
        passed over, the others confirmed. wanted(x, y) may leave out pairs that another task confirms."""
        r, n = np.frombuffer(b"".join(regs), np.uint16).reshape(len(ids), -1), np.array(sizes, float)
        sets: dict[int, np.ndarray] = {}
        parent: dict = {}

        def root(x):
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        def own(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = self.shingles(texts[i])
            return sets[i]

        label, found, out = np.unique(np.array(roots), return_inverse=True)[1], [], []
        for x in range(len(ids)):
            y = meet(x)
            y = close(r, n, x, y[label[y] != label[x]], self.percent)
            if wanted is not None and len(y):
                y = wanted(x, y)
            if len(y):
                found.append(((r[y] == r[x]).mean(axis=1), np.full(len(y), x), y))
        if found:
            e, a, b = (np.concatenate(c) for c in zip(*found, strict=True))
            for at in np.argsort(-e, kind="stable"):
                x, y = int(a[at]), int(b[at])
                if root(roots[x]) == root(roots[y]):
                    continue
                s, t = own(x), own(y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= self.percent * (len(s) + len(t) - both):
                    parent[root(roots[x])] = root(roots[y])
                    out.append((ids[x], ids[y]))
        return out


EDGES = "src long, dst long"


def forests(groups: DataFrame, keys: list[str], k: int, percent: int) -> DataFrame:
    """Confirmed forest edges in each group of doc_id, text, n_shingles, regs, extra; two extra documents do not meet."""
    columns = [*keys, "doc_id", "text", "n_shingles", "regs", "extra"]

    def start():
        link = Linker(k, percent)

        def work(*c: list) -> list:
            ids, texts, sizes, regs, extra = c[len(keys) :]
            more = np.array(extra)
            meet = lambda x: np.flatnonzero(~more[x + 1 :] | ~more[x]) + x + 1
            edges = link(ids, texts, sizes, regs, ids, meet)
            return [[e[0] for e in edges], [e[1] for e in edges]]

        return work

    return common.map_groups(groups.select(*columns), keys, EDGES, start)


def first_key(keys: list, here: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """A filter of the partners y of x: those whose first key in common with x is `here`."""
    all_ = np.array(keys, np.int64)

    def only(x: int, y: np.ndarray) -> np.ndarray:
        same = all_[y] == all_[x]
        return y[all_[x][same.argmax(axis=1)] == here]

    return only


def apart(rooted: DataFrame, sketches: DataFrame, percent: int, block: int, banded: bool) -> DataFrame:
    """key, i, j, part, doc_id, root: documents that in this task meet one of another root to which they may be linked; of several band keys, for the first one.

    Only registers come here, so that texts move only where an estimate asks for them."""

    def start():
        def work(key: int, i: int, j: int, part: list, ids: list, roots: list, sizes: list, regs: list, keys: list) -> list:
            r, n, at = np.frombuffer(b"".join(regs), np.uint16).reshape(len(ids), -1), np.array(sizes, float), np.array(part)
            label, only, use = np.unique(np.array(roots), return_inverse=True)[1], first_key(keys, key) if banded else lambda x, y: y, np.zeros(len(ids), bool)
            for x in range(len(ids)):
                y = partners(i, j, at, x)
                y = close(r, n, x, y[label[y] != label[x]], percent)
                if len(y) and len(y := only(x, y)):
                    use[x] = use[y] = True
            some = np.flatnonzero(use).tolist()
            return [[key] * len(some), [i] * len(some), [j] * len(some), *([c[x] for x in some] for c in (part, ids, roots))]

        return lambda key, i, j, *columns: work(key[0], i[0], j[0], *columns)

    rows = dealt(rooted, block).join(sketches, "doc_id").select("key", "i", "j", "part", "doc_id", "root", "n_shingles", "regs", "keys")
    return common.map_groups(rows, ["key", "i", "j"], "key long, i int, j int, part int, doc_id long, root long", start)


def confirmed(groups: DataFrame, k: int, percent: int, banded: bool) -> DataFrame:
    """Confirmed forest edges of what `apart` found, with texts."""

    def start():
        link = Linker(k, percent)

        def work(key: list, i: list, j: list, part: list, ids: list, roots: list, texts: list, sizes: list, regs: list, keys: list) -> list:
            at = np.array(part)
            edges = link(ids, texts, sizes, regs, roots, lambda x: partners(i[0], j[0], at, x), first_key(keys, key[0]) if banded else None)
            return [[e[0] for e in edges], [e[1] for e in edges]]

        return work

    return common.map_groups(groups.select("key", "i", "j", "part", "doc_id", "root", "text", "n_shingles", "regs", "keys"), ["key", "i", "j"], EDGES, start)


def components(docs: DataFrame, k: int = 5, percent: int = 80, block: int = 500, hubs: int = 48, most: int = 40) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    tables = common.Tables()
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    sk = tables(sketch(docs, k), "sketches")
    own = sk.where("doc_id is not null and n_shingles > 0")
    # Of texts under one id, the one with the least hash stands for it.
    again = tables(own.groupBy("doc_id").agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least <> most").select("doc_id", "least"), "again")
    if not again.isEmpty():
        own = own.join(again, "doc_id", "left").where("least is null or h = least").drop("least")
    same = ["f1", "f2", "n_shingles"]
    classes = own.groupBy(*same).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    many = tables(classes.where("first <> last").drop("last"), "classes")
    copies = own.select("doc_id", *same).join(many, same).where("doc_id <> first").select(F.col("first").alias("src"), F.col("doc_id").alias("dst"))
    copies = tables(copies.distinct(), "copies")
    firsts = own.join(copies.select(F.col("dst").alias("doc_id")), "doc_id", "left_anti")
    keyed = firsts.select("doc_id", F.explode("keys").alias("key"))
    groups, sketches = loosely(keyed, firsts, percent, block, most, tables)

    # Documents of a group share tasks: groups of over `block` documents are dealt into several.
    sizes = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = groups.join(sizes, "component").select(F.col("id").alias("doc_id"), F.col("component").alias("c"), "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("i"))
    held = tables(sketches.join(placed, "doc_id"), "placed")
    held = tables(docs.join(held, ["doc_id", "h"]).dropDuplicates(["doc_id"]), "held")
    # A block's documents meet one another and a bounded sample of block 0, where most of a large group joins.
    at = held.withColumn("extra", F.lit(False))
    order = Window.partitionBy("c").orderBy(F.xxhash64("doc_id", F.lit(2)))
    hub = held.where("blocks > 1 and i = 0").withColumn("k", F.row_number().over(order)).where(F.col("k") <= hubs).drop("k")
    hub = hub.withColumns({"i": F.explode(F.expr("sequence(1, blocks - 1)")), "extra": F.lit(True)}).select(*at.columns)
    links = tables(forests(at.unionByName(hub), ["c", "i"], k, percent), "links").unionByName(copies)
    found = tables(common.connected_components(links), "components")
    # Documents of a large group that are not connected yet meet, by estimate and then by their texts: in a group of
    # up to `most` blocks each with each of another component, in a larger one those that share a key.
    large = held.where("blocks > 1").select("doc_id", "c", "blocks")
    if not large.isEmpty():
        rooted = large.join(found, F.col("doc_id") == F.col("id"), "left").select("doc_id", "c", "blocks", F.coalesce("component", "doc_id").alias("root"))
        rooted = tables(rooted, "rooted")
        for banded, rows in ((False, rooted.where(F.col("blocks") <= most)), (True, rooted.where(F.col("blocks") > most))):
            if rows.isEmpty():
                continue
            rows = tables(keyed.distinct().join(rows, "doc_id").select("key", "doc_id", "root"), "rooted") if banded else rows.select(F.col("c").alias("key"), "doc_id", "root")
            some = tables(apart(rows, sketches, percent, block, banded), "apart")
            if some.isEmpty():
                continue
            more = tables(confirmed(some.join(held.select("doc_id", "text", "n_shingles", "regs", "keys"), "doc_id"), k, percent, banded), "links")
            found = found if more.isEmpty() else tables(common.merge_components(found, more), "components")
    tables.drop_but(sk, found)
    out = sk.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def unique(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns."""
    gone = common.scratch(components(docs, k, percent).where(~F.col("kept")).select("doc_id"), "gone")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(common.table(spark, sf_dir, "documents"), k=2)
