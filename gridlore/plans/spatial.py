"""Queries on joins, windows, sets, sorts, splits and sampling, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlore.functions.numeric import prefix_sums, r6, ranked
from gridlore.plans.registry import Registry
from gridlore.plans.views import sql

reg = Registry()
n_ = lambda name="n": F.count(F.lit(1)).alias(name)


def files(v) -> tuple[DataFrame, DataFrame]:
    """File names of images and labels; some of either have no partner."""
    t = v.tiles().select("tile_id")
    image = t.where("tile_id % 11 <> 0").select(F.concat(F.lit("AOI_img"), F.col("tile_id"), F.lit(".tif")).alias("name"))
    label = t.where("tile_id % 13 <> 0").select(F.concat(F.lit("labels_img"), F.col("tile_id"), F.lit(".geojson")).alias("name"))
    return image, label


FILES = {"image": "SELECT 'AOI_img' || tile_id || '.tif' AS name FROM tiles WHERE tile_id % 11 <> 0", "label": "SELECT 'labels_img' || tile_id || '.geojson' AS name FROM tiles WHERE tile_id % 13 <> 0",
         "paired": "SELECT coalesce(i.k, l.k) AS key, i.name AS image, l.name AS label, CASE WHEN l.k IS NULL THEN 'image_only' WHEN i.k IS NULL THEN 'label_only' ELSE 'both' END AS side FROM (SELECT regexp_extract(name, '(img\\d+)', 1) AS k, name FROM image) i FULL JOIN (SELECT regexp_extract(name, '(img\\d+)', 1) AS k, name FROM label) l ON i.k = l.k"}


def paired(v) -> DataFrame:
    image, label = files(v)
    key = lambda df, n: df.select(F.regexp_extract("name", r"(img\d+)", 1).alias("key"), F.col("name").alias(n))
    side = F.when(F.col("label").isNull(), "image_only").when(F.col("image").isNull(), "label_only").otherwise("both")
    return key(image, "image").join(key(label, "label"), "key", "full_outer").withColumn("side", side)


@reg("j1_pair_by_key", sql("SELECT * FROM paired", "tiles", extra=FILES))
def j1(v):
    return paired(v)


@reg("u1_key_sets", sql("SELECT side, count(*) AS n FROM paired GROUP BY side", "tiles", extra=FILES))
def u1(v):
    image, label = files(v)
    a, b = (df.select(F.regexp_extract("name", r"(img\d+)", 1).alias("key")) for df in (image, label))
    part = lambda df, s: df.agg(n_()).select(F.lit(s).alias("side"), "n")
    return part(a.intersect(b), "both").unionByName(part(a.exceptAll(b), "image_only")).unionByName(part(b.exceptAll(a), "label_only"))


@reg("o1_numeric_suffix_sort", sql("SELECT key, row_number() OVER (ORDER BY CAST(regexp_replace(key, '\\D', '', 'g') AS BIGINT)) AS rank FROM paired", "tiles", extra=FILES))
def o1(v):
    """Every key with its rank by number."""
    rows = paired(v).select("key", F.regexp_replace("key", r"\D", "").cast("long").alias("number"))
    return ranked(rows, "number", "rank").select("key", (F.col("rank") + 1).alias("rank"))


@reg("j3_broadcast_lookup", sql("SELECT gt_id, CASE cls WHEN 1 THEN 'building' WHEN 2 THEN 'platform' ELSE 'basin' END AS name FROM gt", "gt"))
def j3(v):
    names = v.spark.createDataFrame([(1, "building"), (2, "platform"), (3, "basin")], "cls int, name string")
    return v.gt().join(F.broadcast(names), "cls").select("gt_id", "name")


@reg("j4_group_lookup", sql("SELECT tile_id, count(gt_id) AS n, coalesce(string_agg(CAST(gt_id AS VARCHAR), ',' ORDER BY gt_id), '') AS ids FROM tiles LEFT JOIN gt USING (tile_id) GROUP BY tile_id", "tiles"))
def j4(v):
    g = v.gt().groupBy("tile_id").agg(n_(), F.array_join(F.transform(F.sort_array(F.collect_list("gt_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return v.tiles().join(g, "tile_id", "left").select("tile_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ids", F.lit("")).alias("ids"))


NEAR = {"ctr": "SELECT det_id, cls, (x0 + x1) / 2.0::DOUBLE AS x, (y0 + y1) / 2.0::DOUBLE AS y FROM map_pred WHERE score >= 0.7", "ref": "SELECT det_id, cls, (x0 + x1) / 2.0::DOUBLE AS x, (y0 + y1) / 2.0::DOUBLE AS y FROM map_gt",
        "hit": "SELECT c.det_id AS a, r.det_id AS b FROM (SELECT *, floor(x / 20) AS cx, floor(y / 20) AS cy FROM ctr) c JOIN (SELECT *, floor(x / 20) + i AS cx, floor(y / 20) + j AS cy FROM ref, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)) r ON c.cx = r.cx AND c.cy = r.cy WHERE (c.x - r.x) * (c.x - r.x) + (c.y - r.y) * (c.y - r.y) <= 400"}


def centres(df: DataFrame) -> DataFrame:
    return df.select("det_id", "cls", ((F.col("x0") + F.col("x1")) / 2.0).alias("x"), ((F.col("y0") + F.col("y1")) / 2.0).alias("y"))


def within(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Pairs (a, b) of det_id at most `radius` apart: an equi-join on cells of that size and their neighbours.

    The side that stands in nine cells is shuffled: Spark's estimate of it leaves the nine out, and would broadcast it whole."""
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = a.select(F.col("det_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.struct(cell("x").alias("cx"), cell("y").alias("cy")).alias("cell"))
    right = b.select(F.col("det_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("yb"), F.explode(around).alias("cell"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("yb")
    return left.join(right.hint("merge"), "cell").where(dx * dx + dy * dy <= radius * radius).select("a", "b")


def sides(v):
    """Centres of the scored predictions and of the ground truth."""
    return centres(v.map_pred().where("score >= 0.7")), centres(v.map_gt())


def near(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(within(a, b, 20).select(F.col("a").alias("det_id")), "det_id", "left_semi").select("det_id")


def concordance(a: DataFrame, b: DataFrame) -> DataFrame:
    hits = within(a, b, 20)
    found = hits.select("a").distinct().agg(n_("fa")).crossJoin(hits.select("b").distinct().agg(n_("fb"))).crossJoin(a.agg(n_("na"))).crossJoin(b.agg(n_("nb")))
    pct = lambda x, y, n: r6(F.try_divide(100.0 * F.col(x), F.col(y))).alias(n)
    return found.select(pct("fa", "na", "concordance"), pct("fb", "nb", "recovery"))



@reg("j8_distance_semi_join", sql("SELECT DISTINCT a AS det_id FROM hit", "map_pred", "map_gt", extra=NEAR))
def j8(v):
    return near(*sides(v))


@reg("m19_concordance", sql("SELECT round(100 * (SELECT count(DISTINCT a) FROM hit) / (SELECT count(*) FROM ctr)::DOUBLE, 6) AS concordance, round(100 * (SELECT count(DISTINCT b) FROM hit) / (SELECT count(*) FROM ref)::DOUBLE, 6) AS recovery", "map_pred", "map_gt", extra=NEAR))
def m19(v):
    return concordance(*sides(v))


# Splits. Order comes from a digest of seed and key, which every engine computes alike.
SPLIT = {"sp": "SELECT tile_id, aoi, k <= round_even(n * 0.2::DOUBLE, 0) AS val FROM (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY md5('7:' || tile_id), tile_id) AS k, count(*) OVER (PARTITION BY aoi) AS n FROM grid)"}


def ordered(df: DataFrame, keys: list[str], key: str, seed: int, rank: str = "k") -> DataFrame:
    """Rank by digest within keys, counted over the digest's first two characters."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))
    rows = df.withColumns({"__d": digest, "__one": F.lit(1)})
    return prefix_sums(rows, keys, F.conv(F.substring("__d", 1, 2), 16, 10).cast("int"), [F.col("__d"), F.col(key)], {rank: "__one"}).drop("__d", "__one")


def split(v, frac: float = 0.2) -> DataFrame:
    n = v.grid().groupBy("aoi").agg(n_())
    return ordered(v.grid(), ["aoi"], "tile_id", 7).join(F.broadcast(n), "aoi").select("tile_id", "aoi", "col", "row", (F.col("k") <= F.rint(F.col("n") * frac)).alias("val"))


@reg("c1_stratified_split", sql("SELECT tile_id, aoi, val FROM sp", "grid", extra=SPLIT))
def c1(v):
    return split(v).select("tile_id", "aoi", "val")


ADJ = SPLIT | {"vt": "SELECT g.tile_id, col, row, val FROM sp JOIN grid g USING (tile_id)", "touch": "SELECT DISTINCT a.tile_id FROM vt a JOIN vt b ON a.val AND NOT b.val AND abs(a.col - b.col) <= 1 AND abs(a.row - b.row) <= 1"}


def touching(tiles: DataFrame) -> DataFrame:
    """Validation tiles with a training tile among their eight neighbours."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    around = tiles.where("val").select("tile_id", F.explode(steps).alias("s"), "col", "row").select("tile_id", (F.col("col") + F.col("s.i")).alias("col"), (F.col("row") + F.col("s.j")).alias("row"))
    return around.join(tiles.where("not val").select("col", "row"), ["col", "row"], "left_semi").select("tile_id").distinct()


@reg("j9_neighbour_semi_join", sql("SELECT tile_id FROM touch", "grid", extra=ADJ))
def j9(v):
    return touching(split(v))


@reg("c4_adjacency_rate", sql("SELECT round((SELECT count(*) FROM touch) / count(*)::DOUBLE, 6) AS rate FROM vt WHERE val", "grid", extra=ADJ))
def c4(v):
    s = split(v)
    return s.where("val").agg(n_()).crossJoin(touching(s).agg(n_("t"))).select(r6(F.try_divide("t", "n")).alias("rate"))


BLOCK = {"blk": "SELECT aoi, col // 4 AS bx, row // 4 AS yb, count(*) AS n FROM grid GROUP BY ALL", "fill": "SELECT *, sum(n) OVER (PARTITION BY aoi ORDER BY md5('3:' || bx || ',' || yb), bx, yb ROWS UNBOUNDED PRECEDING) - n AS before, 0.2::DOUBLE * sum(n) OVER (PARTITION BY aoi) AS target FROM blk"}


@reg("c2_blocked_split", sql("SELECT aoi, bx, yb, n, before < target AS val FROM fill", "grid", extra=BLOCK))
def c2(v):
    """Blocks in digest order until the target is reached; the block that crosses it is included."""
    return filled(v).select("aoi", "bx", "yb", "n", (F.col("upto") - F.col("n") < F.col("target")).alias("val"))


def filled(v):
    b = v.grid().groupBy("aoi", F.floor(F.col("col") / 4).alias("bx"), F.floor(F.col("row") / 4).alias("yb")).agg(n_())
    digest = F.md5(F.concat(F.lit("3:"), "bx", F.lit(","), "yb"))
    run = prefix_sums(b.withColumn("d", digest), ["aoi"], F.conv(F.substring("d", 1, 2), 16, 10).cast("int"), [F.col("d"), F.col("bx"), F.col("yb")], {"upto": "n"})
    target = b.groupBy("aoi").agg((0.2 * F.sum("n")).alias("target"))
    return run.join(F.broadcast(target), "aoi")


@reg("w8_prefix_fill", sql("SELECT aoi, bx, yb, CAST(before AS BIGINT) AS before FROM fill WHERE before < target", "grid", extra=BLOCK))
def w8(v):
    before = F.col("upto") - F.col("n")
    return filled(v).where(before < F.col("target")).select("aoi", "bx", "yb", before.alias("before"))


@reg("j16_membership_join", sql("SELECT tile_id, val FROM grid g JOIN fill f ON g.aoi = f.aoi AND g.col // 4 = f.bx AND g.row // 4 = f.yb CROSS JOIN LATERAL (SELECT before < target AS val)", "grid", extra=BLOCK))
def j16(v):
    m = filled(v).select("aoi", "bx", "yb", (F.col("upto") - F.col("n") < F.col("target")).alias("val"))
    return v.grid().withColumns({"bx": F.floor(F.col("col") / 4), "yb": F.floor(F.col("row") / 4)}).join(m, ["aoi", "bx", "yb"]).select("tile_id", "val")


@reg("c3_grid_index", sql("SELECT tile_id, CAST(round_even((col * 0.001755 + 0.0004)::DOUBLE / 0.001755::DOUBLE, 0) AS BIGINT) AS gx, CAST(round_even((row * 0.001755 - 0.0004)::DOUBLE / 0.001755::DOUBLE, 0) AS BIGINT) AS gy FROM grid", "grid"))
def c3(v, pitch: float = 0.001755):
    return v.grid().select("tile_id", F.rint((F.col("col") * pitch + 0.0004) / pitch).cast("long").alias("gx"), F.rint((F.col("row") * pitch - 0.0004) / pitch).cast("long").alias("gy"))


@reg("w7_min_gap", sql("SELECT coalesce(min(g), 0.001755::DOUBLE) AS pitch FROM (SELECT x - lag(x) OVER (ORDER BY x) AS g FROM (SELECT DISTINCT col * 0.5::DOUBLE AS x FROM grid)) WHERE g > 1e-9", "grid"))
def w7(v):
    """Distinct coordinates are few: a grid's columns."""
    x = v.grid().select((F.col("col") * 0.5).alias("x")).distinct()
    gap = x.withColumn("g", F.col("x") - F.lag("x").over(Window.orderBy("x")))
    return gap.where("g > 1e-9").agg(F.coalesce(F.min("g"), F.lit(0.001755)).alias("pitch"))


@reg("c13_index_split", sql("SELECT tile_id, CASE WHEN tile_id < 300 THEN 0 ELSE 1 END AS fold FROM tiles", "tiles"))
def c13(v):
    return v.tiles().select("tile_id", F.when(F.col("tile_id") < 300, 0).otherwise(1).alias("fold"))


@reg("c11_hash_sample", sql("SELECT tile_id FROM tiles ORDER BY md5('5:' || tile_id), tile_id LIMIT 100", "tiles"))
def c11(v):
    return v.tiles().orderBy(F.md5(F.concat(F.lit("5:"), F.col("tile_id"))), "tile_id").limit(100).select("tile_id")


#: Rows of a block that meets other blocks in one task.
BLOCK = 4000


def blocks(rows: DataFrame) -> int:
    """How many blocks these rows are dealt into, by their number."""
    return 1 + rows.count() // BLOCK


DOT = "list_aggregate(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE), 'sum')"
SIM = {"e": "SELECT vec_id, embedding, vec_id % 5 = 0 AS val, sqrt(list_aggregate(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE), 'sum')) AS norm FROM embeddings",
       "best": f"SELECT a.vec_id, max({DOT} / (a.norm * b.norm)) AS sim FROM e a JOIN e b ON a.val AND NOT b.val GROUP BY a.vec_id"}


def nearest_train(v) -> DataFrame:
    """Greatest cosine of each validation vector to a training one, blocks of vectors against blocks."""
    import numpy as np
    import pandas as pd

    e = v.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), (F.col("vec_id") % 5 == 0).alias("val"))
    ni, nj = blocks(e.where("val")), blocks(e.where("not val"))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = e.where("val").withColumns({"i": part(ni), "j": every(nj)})
    t = e.where("not val").withColumns({"j": part(nj), "i": every(ni)})

    def block(f: pd.DataFrame) -> pd.DataFrame:
        a, b = f[f["val"]], f[~f["val"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"vec_id": pd.Series(dtype="int64"), "sim": pd.Series(dtype="float64")})
        x, y = np.stack(a["embedding"]), np.stack(b["embedding"])
        x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
        # A few rows of x at a time: a task holds no block of all products.
        top = [(x[k : k + 250] @ y.T).max(axis=1) for k in range(0, len(x), 250)]
        return pd.DataFrame({"vec_id": a["vec_id"].to_numpy(), "sim": np.concatenate(top)})

    return q.unionByName(t).groupBy("i", "j").applyInPandas(block, "vec_id long, sim double").groupBy("vec_id").agg(F.max("sim").alias("sim"))


@reg("j10_nearest_similarity", sql("SELECT vec_id, round(sim, 6) AS sim FROM best", extra=SIM))
def j10(v):
    return nearest_train(v).select("vec_id", r6(F.col("sim")).alias("sim"))


@reg("c10_leak_statistic", sql("SELECT round(avg(sim), 6) AS mean, round(quantile_cont(sim, 0.95), 6) AS p95, round(max(sim), 6) AS top FROM best", extra=SIM))
def c10(v):
    return nearest_train(v).agg(r6(F.avg("sim")).alias("mean"), r6(F.percentile("sim", 0.95)).alias("p95"), r6(F.max("sim")).alias("top"))


SEAM = {"st": "SELECT tile, c, r, v FROM pixels WHERE c IN (0, 7)", "un": "SELECT tile, c, list((v - m) / s ORDER BY r) AS u FROM (SELECT *, avg(v) OVER w AS m, sqrt(sum(v * v) OVER w - count(*) OVER w * (avg(v) OVER w) ** 2) AS s FROM st WINDOW w AS (PARTITION BY tile, c)) GROUP BY tile, c",
        "pr": "SELECT a.tile AS a, b.tile AS b, list_dot_product(a.u, b.u) AS rho FROM un a JOIN un b ON a.c = 7 AND b.c = 0 AND a.tile <> b.tile"}


#: Correlations that a product of matrices brings nearer than this may be equal, and are added up anew.
NEAR = 1e-12


def units(strips):
    """Strips, one a row, without their mean and of length 1; a constant one is 0."""
    import numpy as np

    x = np.stack(strips)
    x = x - x.mean(axis=1, keepdims=True)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def strips(v) -> DataFrame:
    """tile, c (7: right edge, 0: left edge), x: its pixels by row."""
    return v.pixels().where("c in (0, 7)").groupBy("tile", "c").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]).alias("x"))


def tops(x, y, same):
    """By row of x, its greatest correlation to a row of y and the first row that has it; `same` are pairs (rows, rows) that do not meet.

    A product of matrices finds the rows that may be it, and these are added up term by term, so that equal strips have equal
    correlations wherever they are."""
    import numpy as np

    best, at, size = np.full(len(x), -np.inf), np.zeros(len(x), "int64"), 50  # products that stay in a core's cache
    for k in range(0, len(x), size):
        rho = x[k : k + size] @ y.T
        own = (same[0] >= k) & (same[0] < k + size)
        rho[same[0][own] - k, same[1][own]] = -np.inf
        i, j = np.divmod(np.flatnonzero(rho >= (rho.max(axis=1) - NEAR)[:, None]), len(y))
        exact = sum(x[k + i, d] * y[j, d] for d in range(x.shape[1]))
        exact[np.isneginf(rho[i, j])] = -np.inf
        order = np.lexsort((j, -exact, i))
        first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
        best[k + i[first]], at[k + i[first]] = exact[first], j[first]
    return best, at


def edges(v, sides: str = "ab") -> DataFrame:
    """Every right edge against every other left edge, blocks against blocks; pairs are never listed.

    side 'a' (of a right edge) and 'b' (of a left one), those asked for: tile, its greatest correlation rho and the least tile that has it.
    A constant strip correlates at 0."""
    import numpy as np
    import pandas as pd

    s = strips(v)
    n = blocks(v.pixels().select("tile").distinct())
    part, every = F.pmod(F.xxhash64("tile"), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = s.where("c = 7").withColumns({"i": part, "j": every}).unionByName(s.where("c = 0").withColumns({"j": part, "i": every}))
    empty = pd.DataFrame({"side": pd.Series(dtype="str"), "tile": pd.Series(dtype="int64"), "rho": pd.Series(dtype="float64"), "other": pd.Series(dtype="int64")})

    def block(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("tile")
        right, left = f[f["c"] == 7], f[f["c"] == 0]
        if not len(right) or not len(left):
            return empty
        a, b, x, y = right["tile"].to_numpy(), left["tile"].to_numpy(), units(right["x"]), units(left["x"])
        same = np.intersect1d(a, b, assume_unique=True, return_indices=True)[1:]
        out = []
        for side, own, others, p, q, pairs in (("a", a, b, x, y, same), ("b", b, a, y, x, same[::-1])):
            if side in sides:
                rho, at = tops(p, q, pairs)
                out.append(pd.DataFrame({"side": side, "tile": own, "rho": rho, "other": others[at]})[rho > -np.inf])
        return pd.concat(out)

    got = both.groupBy("i", "j").applyInPandas(block, "side string, tile long, rho double, other long")
    return got.groupBy("side", "tile").agg(F.max("rho").alias("rho"), F.max_by("other", F.struct("rho", -F.col("other"))).alias("other"))


def seam_moments(v) -> tuple[float, float]:
    """Mean and standard deviation of the correlations of all right edges with all other left edges, in one pass over the strips.

    Sums of products over all pairs are products of sums: of the strips for the correlations, of their outer products for the squares.
    A tile's own pair is taken off."""
    import numpy as np
    import pandas as pd

    one = strips(v).groupBy("tile").agg(*(F.max(F.when(F.col("c") == c, F.col("x"))).alias(n) for c, n in ((7, "a"), (0, "b"))))

    def each(frames):
        for f in frames:
            sums = {}
            for n in ("a", "b"):
                has = f[n].notna()
                if has.any():
                    x = units(f[n][has])
                    sums |= {f"n{n}": [len(x)], f"s{n}": x.sum(axis=0), f"q{n}": (x.T @ x).ravel()}
            two = f[f["a"].notna() & f["b"].notna()]
            if len(two):
                rho = (units(two["a"]) * units(two["b"])).sum(axis=1)
                sums["own"] = [len(rho), rho.sum(), (rho**2).sum()]
            yield pd.DataFrame([(k, i, float(t)) for k, row in sums.items() for i, t in enumerate(row)], columns=["name", "i", "t"])

    found: dict[str, list] = {}
    for r in one.mapInPandas(each, "name string, i int, t double").groupBy("name", "i").agg(F.sum("t").alias("t")).orderBy("name", "i").collect():  # some 150 rows
        found.setdefault(r["name"], []).append(r["t"])
    get = lambda k: np.array(found.get(k, [0.0]))
    own = found.get("own", [0.0, 0.0, 0.0])
    n = float(get("na")[0] * get("nb")[0] - own[0])
    if n < 1:
        return float("nan"), float("nan")
    mean, square = (get("sa") @ get("sb") - own[1]) / n, (get("qa") @ get("qb") - own[2]) / n
    return float(mean), float(np.sqrt(max(square - mean * mean, 0.0)))


@reg("w14_best_match_z", sql("SELECT a, round((max(rho) - (SELECT avg(rho) FROM pr)) / (SELECT stddev_pop(rho) FROM pr), 6) AS z FROM pr GROUP BY a", "pixels", extra=SEAM))
def w14(v):
    mean, deviation = seam_moments(v)
    return edges(v, "a").select(F.col("tile").alias("a"), r6((F.col("rho") - F.lit(mean)) / F.lit(deviation)).alias("z"))


@reg("w15_reciprocal_best", sql("SELECT a, b, round(rho, 6) AS rho FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY rho DESC, b) AS ka, row_number() OVER (PARTITION BY b ORDER BY rho DESC, a) AS kb FROM pr) WHERE ka = 1 AND kb = 1", "pixels", extra=SEAM))
def w15(v):
    e = edges(v)
    a, b = e.where("side = 'a'").select(F.col("tile").alias("a"), F.col("other").alias("b"), "rho"), e.where("side = 'b'").select(F.col("other").alias("a"), F.col("tile").alias("b"))
    return a.join(b, ["a", "b"]).select("a", "b", r6(F.col("rho")).alias("rho"))


@reg("j11_offset_self_join", sql("SELECT o AS width, count(*) AS n, round(avg(abs(a.m - b.m)), 6) AS gap FROM (SELECT unnest(range(2, 40)) AS o), (SELECT tile, avg(v) AS m FROM pixels GROUP BY tile) a JOIN (SELECT tile, avg(v) AS m FROM pixels GROUP BY tile) b ON b.tile = a.tile + o GROUP BY o HAVING count(*) >= 100", "pixels"))
def j11(v):
    m = v.pixels().groupBy("tile").agg(F.avg("v").alias("m"))
    a = m.select("tile", F.col("m").alias("ma"), F.explode(F.sequence(F.lit(2), F.lit(39))).alias("width")).withColumn("to", F.col("tile") + F.col("width"))
    j = a.drop("tile").join(m.select(F.col("tile").alias("to"), F.col("m").alias("mb")), "to")
    return j.groupBy(F.col("width").cast("long").alias("width")).agg(n_(), r6(F.avg(F.abs(F.col("ma") - F.col("mb")))).alias("gap")).where("n >= 100")


@reg("c12_random_pairs", sql("SELECT round(quantile_cont(abs(a.m - b.m), 0.99), 6) AS p99 FROM (SELECT i, CAST(('0x' || substr(md5('a' || i), 1, 8)) AS BIGINT) % n AS x, CAST(('0x' || substr(md5('b' || i), 1, 8)) AS BIGINT) % n AS y FROM (SELECT unnest(range(0, 4000)) AS i), (SELECT count(*) AS n FROM ti)) JOIN ti a ON a.k = x JOIN ti b ON b.k = y WHERE x <> y", "pixels", extra={"ti": "SELECT tile, avg(v) AS m, row_number() OVER (ORDER BY tile) - 1 AS k FROM pixels GROUP BY tile"}))
def c12(v, pairs: int = 4000):
    """Both ends are drawn from all tiles, by their gapless rank."""
    m = ranked(v.pixels().groupBy("tile").agg(F.avg("v").alias("m")), "tile")
    h = lambda s: F.conv(F.substring(F.md5(F.concat(F.lit(s), F.col("id"))), 1, 8), 16, 10).cast("long") % F.col("n")
    p = v.spark.range(pairs).crossJoin(F.broadcast(m.agg(n_()))).select(h("a").alias("x"), h("b").alias("y")).where("x <> y")
    a, b = m.select(F.col("k").alias("x"), F.col("m").alias("ma")), m.select(F.col("k").alias("y"), F.col("m").alias("mb"))
    return p.join(a, "x").join(b, "y").agg(r6(F.percentile(F.abs(F.col("ma") - F.col("mb")), 0.99)).alias("p99"))


CLUSTER = {"cc": "SELECT label, count(*) AS n, count(*) FILTER (vec_id % 3 = 0) AS k0, count(*) FILTER (vec_id % 3 = 1) AS k1, count(*) FILTER (vec_id % 3 = 2) AS k2 FROM embeddings GROUP BY label",
           "rs": "SELECT *, unnest(range(0, 32)) AS restart FROM cc",
           "ru": "SELECT *, sum(n) OVER (PARTITION BY restart ORDER BY md5(restart || ':' || label), label ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER (PARTITION BY restart) AS total, sum(k0) OVER (PARTITION BY restart) AS t0, sum(k1) OVER (PARTITION BY restart) AS t1, sum(k2) OVER (PARTITION BY restart) AS t2 FROM rs",
           "ob": "SELECT restart, greatest(abs(sum(k0) / max(t0)::DOUBLE - 0.2), abs(sum(k1) / max(t1)::DOUBLE - 0.2), abs(sum(k2) / max(t2)::DOUBLE - 0.2)) + abs(sum(n) / max(total)::DOUBLE - 0.2) AS objective, string_agg(CAST(label AS VARCHAR), ',' ORDER BY label) AS labels FROM ru WHERE before < 0.2 * total GROUP BY restart"}


def clusters(v) -> DataFrame:
    k = lambda i: F.count_if(F.col("vec_id") % 3 == i).alias(f"k{i}")
    return v.table("embeddings").groupBy("label").agg(n_(), k(0), k(1), k(2))


@reg("c8_cluster_val_search", sql("SELECT restart, round(objective, 6) AS objective, labels FROM ob ORDER BY objective, restart LIMIT 1", extra=CLUSTER))
def c8(v, restarts: int = 32, frac: float = 0.2):
    """Restarts are rows: each orders the clusters by digest and fills up to the target."""
    c = clusters(v)
    t = c.agg(F.sum("n").alias("total"), *[F.sum(f"k{i}").alias(f"t{i}") for i in range(3)])
    r = c.crossJoin(F.broadcast(t)).withColumn("restart", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(restarts - 1).cast("long"))))
    w = Window.partitionBy("restart").orderBy(F.md5(F.concat("restart", F.lit(":"), "label")), "label").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("before", F.sum("n").over(w) - F.col("n")).where(F.col("before") < frac * F.col("total"))
    off = lambda a, b: F.abs(F.sum(a) / F.max(b) - frac)
    o = r.groupBy("restart").agg((F.greatest(*[off(f"k{i}", f"t{i}") for i in range(3)]) + off("n", "total")).alias("objective"), F.array_join(F.transform(F.sort_array(F.collect_list("label")), lambda x: x.cast("string")), ",").alias("labels"))
    return o.orderBy("objective", "restart").limit(1).select("restart", r6(F.col("objective")).alias("objective"), "labels")


EMPTY = "struct_pack(n := 0::BIGINT, k0 := 0::BIGINT, k1 := 0::BIGINT, k2 := 0::BIGINT)"
FOLDS = f"""WITH RECURSIVE cl AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS o FROM (
        SELECT label, count(*) AS n, count(*) FILTER (vec_id % 3 = 0) AS k0, count(*) FILTER (vec_id % 3 = 1) AS k1, count(*) FILTER (vec_id % 3 = 2) AS k2 FROM embeddings GROUP BY label)),
    run AS (SELECT 0::BIGINT AS o, [{", ".join([EMPTY] * 5)}] AS fill, NULL::INTEGER AS label, NULL::INTEGER AS fold
        UNION ALL SELECT o, list_transform(fill, lambda s, i: CASE WHEN i = b THEN struct_pack(n := s.n + cn, k0 := s.k0 + c0, k1 := s.k1 + c1, k2 := s.k2 + c2) ELSE s END), label, CAST(b - 1 AS INTEGER)
        FROM (SELECT *, list_position(ds, list_min(ds)) AS b FROM (
            SELECT c.o, c.label, c.n AS cn, c.k0 AS c0, c.k1 AS c1, c.k2 AS c2, r.fill,
                list_transform(r.fill, lambda s: 2 * s.n * c.n + c.n * c.n + 2 * s.k0 * c.k0 + c.k0 * c.k0 + 2 * s.k1 * c.k1 + c.k1 * c.k1 + 2 * s.k2 * c.k2 + c.k2 * c.k2) AS ds
            FROM run r JOIN cl c ON c.o = r.o + 1)))
    SELECT label, fold FROM run WHERE o > 0"""


@reg("c9_balanced_folds", FOLDS)
def c9(v, folds: int = 5):
    """Largest cluster first into the fold it unbalances least; the first fold on ties."""
    c = clusters(v).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "label", "n", "k0", "k1", "k2"))).alias("cs"))
    zero = F.array(*[F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0).cast("long").alias(f"k{j}") for j in range(3)]) for _ in range(folds)])
    start = F.struct(zero.alias("fill"), F.array().cast("array<struct<label:int,fold:int>>").alias("out"))
    size = lambda s, x: (s["n"] + x["n"]) * (s["n"] + x["n"]) - s["n"] * s["n"] + sum(((s[f"k{j}"] + x[f"k{j}"]) * (s[f"k{j}"] + x[f"k{j}"]) - s[f"k{j}"] * s[f"k{j}"] for j in range(3)), F.lit(0))

    def step(state: Column, x: Column) -> Column:
        best = F.array_min(F.transform(state["fill"], lambda s, i: F.struct(size(s, x).alias("d"), i.alias("i"))))["i"]
        more = F.transform(state["fill"], lambda s, i: F.when(i == best, F.struct((s["n"] + x["n"]).alias("n"), *[(s[f"k{j}"] + x[f"k{j}"]).alias(f"k{j}") for j in range(3)])).otherwise(s))
        return F.struct(more.alias("fill"), F.array_append(state["out"], F.struct(x["label"].alias("label"), best.alias("fold"))).alias("out"))

    return c.select(F.inline(F.aggregate("cs", start, step)["out"]))


@reg("w3_stride_sample", sql("SELECT aoi, tile_id FROM (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY tile_id) - 1 AS k, count(*) OVER (PARTITION BY aoi) AS n FROM tiles) WHERE k % greatest(1, n // 10) = 0 AND k // greatest(1, n // 10) < 10", "tiles"))
def w3(v, k: int = 10):
    t, n = numbered(v), v.tiles().groupBy("aoi").agg(n_())
    step = F.greatest(F.lit(1), F.floor(F.col("n") / k))
    at = F.col("k") - 1
    return t.join(F.broadcast(n), "aoi").where((at % step == 0) & (F.floor(at / step) < k)).select("aoi", "tile_id")


def numbered(v) -> DataFrame:
    return prefix_sums(v.tiles().withColumn("one", F.lit(1)), ["aoi"], F.floor(F.col("tile_id") / 1000), [F.col("tile_id")], {"k": "one"}).drop("one")


@reg("w4_even_ranks", sql("SELECT aoi, tile_id FROM (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY tile_id) - 1 AS k, count(*) OVER (PARTITION BY aoi) AS n FROM tiles) JOIN (SELECT unnest(range(0, 5)) AS i) ON k = round_even(i * (n - 1) / 4.0::DOUBLE, 0)", "tiles"))
def w4(v, k: int = 5):
    n = v.tiles().groupBy("aoi").agg(n_())
    want = n.select("aoi", F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (F.col("n") - 1) / (k - 1)).cast("long") + 1)).alias("k"))
    return numbered(v).join(F.broadcast(want), ["aoi", "k"]).select("aoi", "tile_id")


@reg("w5_rank_picks", sql("SELECT aoi, pick, tile_id FROM (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY tile_id) - 1 AS k, count(*) OVER (PARTITION BY aoi) AS n FROM tiles) CROSS JOIN LATERAL (SELECT unnest(['best', 'q1', 'median', 'q3', 'worst']) AS pick, unnest([0, n // 4, n // 2, 3 * n // 4, n - 1]) AS pos) WHERE k = pos", "tiles"))
def w5(v):
    n = v.tiles().groupBy("aoi").agg(n_())
    q = lambda e: F.floor(e).cast("long")
    at = {"best": F.lit(0).cast("long"), "q1": q(F.col("n") / 4), "median": q(F.col("n") / 2), "q3": q(3 * F.col("n") / 4), "worst": F.col("n") - 1}
    want = n.select("aoi", F.inline(F.array(*[F.struct(F.lit(p).alias("pick"), (e + 1).alias("k")) for p, e in at.items()])))
    return numbered(v).join(F.broadcast(want), ["aoi", "k"]).select("aoi", "pick", "tile_id")


@reg("w11_first_per_tile_top_n", sql("SELECT tile_id, gt_id, area FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY area DESC, gt_id) AS k FROM gt WHERE cls = 2) WHERE k = 1 ORDER BY area DESC, gt_id LIMIT 12", "gt"))
def w11(v):
    top = v.gt().where("cls = 2").groupBy("tile_id").agg(F.max(F.struct("area", (-F.col("gt_id")).alias("g"))).alias("b")).select("tile_id", (-F.col("b.g")).alias("gt_id"), F.col("b.area").alias("area"))
    return top.orderBy(F.col("area").desc(), "gt_id").limit(12)


@reg("w12_median_smoothing", sql("SELECT arm, fold, iteration, round(quantile_cont(metric, 0.5) OVER (PARTITION BY arm, fold ORDER BY iteration ROWS 19 PRECEDING), 6) AS smooth FROM runs", "runs"))
def w12(v):
    w = Window.partitionBy("arm", "fold").orderBy("iteration").rowsBetween(-19, 0)
    return v.runs().select("arm", "fold", "iteration", r6(F.percentile("metric", 0.5).over(w)).alias("smooth"))


@reg("o3_top_k", sql("SELECT arm, iteration, metric FROM runs ORDER BY metric DESC, iteration LIMIT 25", "runs"))
def o3(v):
    return v.runs().orderBy(F.col("metric").desc(), "iteration").limit(25).select("arm", "iteration", "metric")


@reg("o4_largest_group", sql("SELECT arg_max(arm, (n, arm)) AS arm, max(n) AS n FROM (SELECT arm, count(*) AS n FROM runs GROUP BY arm)", "runs"))
def o4(v):
    return v.runs().groupBy("arm").agg(n_()).agg(F.max_by("arm", F.struct("n", "arm")).alias("arm"), F.max("n").alias("n"))


@reg("o6_first_n", sql("SELECT tile_id FROM tiles ORDER BY tile_id LIMIT 20", "tiles"))
def o6(v):
    return v.tiles().orderBy("tile_id").limit(20).select("tile_id")


@reg("o7_first_maximum", sql("SELECT arm, arg_min(iteration, (-metric, iteration)) AS iteration, max(metric) AS metric FROM runs GROUP BY arm", "runs"))
def o7(v):
    return v.runs().groupBy("arm").agg(F.max_by("iteration", F.struct("metric", -F.col("iteration"))).alias("iteration"), F.max("metric").alias("metric"))


@reg("o8_most_common", sql("SELECT get_k, count(*) AS n FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS get_k FROM runs) GROUP BY get_k ORDER BY n DESC, get_k LIMIT 10", "runs"))
def o8(v):
    k = F.get_json_object("props", "$.k").cast("long").alias("get_k")
    return v.runs().groupBy(k).agg(n_()).orderBy(F.col("n").desc(), "get_k").limit(10)


@reg("u2_disjoint_assertion", sql("SELECT count(*) = 0 AS disjoint FROM (SELECT tile_id FROM sp WHERE val INTERSECT SELECT tile_id FROM sp WHERE NOT val)", "grid", extra=SPLIT))
def u2(v):
    s = split(v)
    return s.where("val").select("tile_id").intersect(s.where("not val").select("tile_id")).agg((F.count(F.lit(1)) == 0).alias("disjoint"))


@reg("u2_overlap_found", sql("SELECT count(*) AS shared, count(*) = 0 AS disjoint FROM (SELECT tile_id FROM sp WHERE val INTERSECT SELECT tile_id FROM sp WHERE NOT val OR tile_id % 7 = 5)", "grid", extra=SPLIT))
def u2_overlap(v):
    """The same assertion on a split that lets tiles into both sides."""
    s = split(v)
    both = s.where("val").select("tile_id").intersect(s.where("not val or tile_id % 7 = 5").select("tile_id"))
    return both.agg(n_("shared")).withColumn("disjoint", F.col("shared") == 0)


@reg("u3_fold_complement", sql("SELECT f.fold, count(*) AS n_train FROM (SELECT unnest(range(0, 5)) AS fold) f JOIN runs r ON r.fold <> f.fold GROUP BY f.fold", "runs"))
def u3(v):
    by = v.runs().groupBy("fold").agg(n_())
    return by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("all")))).select("fold", (F.col("all") - F.col("n")).alias("n_train"))


@reg("u4_bag_union", sql("SELECT cls, count(*) AS n FROM (SELECT cls FROM gt UNION ALL SELECT cls FROM pred) GROUP BY cls", "pred"))
def u4(v):
    return v.gt().select("cls", "tile_id").unionByName(v.pred().select("cls", "tile_id")).groupBy("cls").agg(n_())


@reg("u5_mask_union_intersection", sql("SELECT tile, count(*) FILTER (v > 0 OR v < -0.3) AS u, count(*) FILTER (v > 0.1 AND c < 4) AS i FROM pixels GROUP BY tile", "pixels"))
def u5(v):
    p = v.pixels().select("tile", "r", "c", "v")
    key = ["tile", "r", "c"]
    u = p.where("v > 0").select(key).union(p.where("v < -0.3").select(key)).distinct().groupBy("tile").agg(n_("u"))
    i = p.where("v > 0.1").select(key).intersect(p.where("c < 4").select(key)).groupBy("tile").agg(n_("i"))
    return p.select("tile").distinct().join(u, "tile", "left").join(i, "tile", "left").select("tile", F.coalesce("u", F.lit(0)).alias("u"), F.coalesce("i", F.lit(0)).alias("i"))


@reg("u6_shared_valid_box", sql("SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM (SELECT r, c FROM dn WHERE tile < 3 AND dn > 8 GROUP BY r, c HAVING count(*) = 3)", "dn"))
def u6(v, panels: int = 3):
    ok = v.dn().where((F.col("tile") < panels) & (F.col("dn") > 8)).groupBy("r", "c").agg(n_()).where(F.col("n") == panels)
    return ok.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))


@reg("u7_set_equality", sql("SELECT NOT EXISTS (FROM (SELECT tile_id FROM gt EXCEPT SELECT tile_id FROM tiles)) AS gt_in_tiles, NOT EXISTS (FROM (SELECT tile_id FROM tiles EXCEPT SELECT tile_id FROM gt)) AS tiles_in_gt", "tiles"))
def u7(v):
    a, b = v.gt().select("tile_id").distinct(), v.tiles().select("tile_id")
    left = lambda x, y, n: x.join(y, "tile_id", "left_anti").agg((F.count(F.lit(1)) == 0).alias(n))
    return left(a, b, "gt_in_tiles").crossJoin(left(b, a, "tiles_in_gt"))


@reg("u8_sorted_distinct", sql("SELECT DISTINCT area FROM gt ORDER BY area", "gt"))
def u8(v):
    return v.gt().select("area").distinct().orderBy("area")


