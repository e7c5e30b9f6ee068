"""Detection tables derived from the star schema, as DataFrames and as SQL for the oracle.

Integer arithmetic throughout, so that both sides agree bit for bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



class Views:
    """Lazily built; every method is a plan over the parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def gt(self) -> DataFrame:
        o = self.table("orders")
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        base = o.select(k.alias("gt_id"), F.floor(k / 40).alias("tile_id"), (k % 3 + 1).cast("int").alias("cls"), ((k * 37) % 440).alias("x0"), ((k * 61 + c) % 440).alias("y0"), (c % 29 + 12).alias("w"), (k % 23 + 12).alias("h"))
        return base.select("gt_id", "tile_id", "cls", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"), "w", "h", (F.col("w") * F.col("h")).alias("area"))

    def pred(self) -> DataFrame:
        # Dealt by order first, so that the lines' aggregate and their join with orders need one shuffle.
        lines = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.max("l_extendedprice").alias("e"))
        j = lines.join(self.gt(), F.col("l_orderkey") == F.col("gt_id"))
        x0, y0 = F.col("x0") + F.col("p") % 9 - 4, F.col("y0") + F.col("s") % 7 - 3
        w, h = F.col("w") + F.col("l_linenumber") % 3 - 1, F.col("h") + F.col("p") % 4 - 1
        cls = F.when(F.col("p") % 5 == 0, F.col("cls") % 3 + 1).otherwise(F.col("cls")).cast("int")
        row = j.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pred_id"), "tile_id", cls.alias("cls"), (F.col("e") / 105000.0).alias("score"), x0.alias("x0"), y0.alias("y0"), w.alias("w"), h.alias("h"))
        return row.select("pred_id", "tile_id", "cls", "score", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"), (F.col("w") * F.col("h")).alias("area"))

    def tiles(self) -> DataFrame:
        """Tiles of the ground truth and five without any row, each in an area."""
        used = self.gt().select("tile_id").distinct()
        extra = used.agg(F.max("tile_id").alias("m")).select(F.explode(F.expr("sequence(m + 1, m + 5)")).alias("tile_id"))
        region = self.table("region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("aoi"))
        return used.unionByName(extra).join(F.broadcast(region), F.col("tile_id") % 5 == F.col("k")).select("tile_id", "aoi")

    def grid(self) -> DataFrame:
        return self.tiles().select("tile_id", "aoi", (F.col("tile_id") % 20).alias("col"), F.floor(F.col("tile_id") / 20).alias("row"))

    def pixels(self) -> DataFrame:
        e = self.table("embeddings").select(F.col("vec_id").alias("tile"), "label", F.posexplode("embedding").alias("pos", "v"))
        return e.select("tile", "label", F.floor(F.col("pos") / 8).cast("int").alias("r"), (F.col("pos") % 8).alias("c"), F.col("v").cast("double").alias("v"))

    def dn(self) -> DataFrame:
        return self.pixels().withColumn("dn", F.floor(F.abs(F.col("v")) * 2047).cast("int"))

    def map_pred(self) -> DataFrame:
        return self.on_map(self.pred(), "pred_id")

    def map_gt(self) -> DataFrame:
        return self.on_map(self.gt(), "gt_id").withColumn("score", F.lit(1.0))

    @staticmethod
    def on_map(df: DataFrame, key: str) -> DataFrame:
        dx, dy = (F.col("tile_id") % 20) * 480, F.floor(F.col("tile_id") / 20) * 480
        return df.withColumnRenamed(key, "det_id").withColumns({"x0": F.col("x0") + dx, "x1": F.col("x1") + dx, "y0": F.col("y0") + dy, "y1": F.col("y1") + dy})

    def runs(self) -> DataFrame:
        """Metric log: one row an event."""
        e = self.table("events")
        return e.select(F.col("event_type").alias("arm"), (F.col("user_id") % 5).alias("fold"), F.col("event_id").alias("iteration"), F.col("value").alias("metric"), "props", "ts")

    def cand(self, same_class: bool = False) -> DataFrame:
        from gridlore.operators import matching

        return matching.candidates(self.gt(), self.pred(), same_class)

    def matches(self, least: float = 0.5) -> DataFrame:
        from gridlore.operators import matching

        return matching.greedy(self.cand(), ["tile_id"], least)

    def records(self, least: float = 0.5) -> DataFrame:
        from gridlore.operators import matching

        return matching.records(self.pred(), self.matches(least))



SQL = {
    "gt": """SELECT o_orderkey AS gt_id, o_orderkey // 40 AS tile_id, CAST(o_orderkey % 3 + 1 AS INTEGER) AS cls, (o_orderkey * 37) % 440 AS x0, (o_orderkey * 61 + o_custkey) % 440 AS y0,
        (o_orderkey * 37) % 440 + o_custkey % 29 + 12 AS x1, (o_orderkey * 61 + o_custkey) % 440 + o_orderkey % 23 + 12 AS y1,
        o_custkey % 29 + 12 AS w, o_orderkey % 23 + 12 AS h, (o_custkey % 29 + 12) * (o_orderkey % 23 + 12) AS area FROM orders""",
    "pred": """SELECT l_orderkey * 8 + l_linenumber AS pred_id, tile_id, CAST(CASE WHEN p % 5 = 0 THEN cls % 3 + 1 ELSE cls END AS INTEGER) AS cls, e / 105000.0::DOUBLE AS score,
        x0 + p % 9 - 4 AS x0, y0 + s % 7 - 3 AS y0, x0 + p % 9 - 4 + w + l_linenumber % 3 - 1 AS x1, y0 + s % 7 - 3 + h + p % 4 - 1 AS y1, (w + l_linenumber % 3 - 1) * (h + p % 4 - 1) AS area
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s, max(l_extendedprice) AS e FROM lineitem GROUP BY ALL) JOIN gt ON l_orderkey = gt_id""",
    "tiles": """SELECT tile_id, r_name AS aoi FROM (SELECT DISTINCT tile_id FROM gt UNION ALL SELECT m + unnest(range(1, 6)) FROM (SELECT max(tile_id) AS m FROM gt)) JOIN region ON tile_id % 5 = r_regionkey""",
    "grid": "SELECT tile_id, aoi, tile_id % 20 AS col, tile_id // 20 AS row FROM tiles",
    "pixels": "SELECT vec_id AS tile, label, CAST((i - 1) // 8 AS INTEGER) AS r, CAST((i - 1) % 8 AS INTEGER) AS c, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
    "dn": "SELECT *, CAST(floor(abs(v) * 2047) AS INTEGER) AS dn FROM pixels",
    "map_pred": "SELECT pred_id AS det_id, tile_id, cls, score, x0 + tile_id % 20 * 480 AS x0, y0 + tile_id // 20 * 480 AS y0, x1 + tile_id % 20 * 480 AS x1, y1 + tile_id // 20 * 480 AS y1, area FROM pred",
    "map_gt": "SELECT gt_id AS det_id, tile_id, cls, 1.0::DOUBLE AS score, x0 + tile_id % 20 * 480 AS x0, y0 + tile_id // 20 * 480 AS y0, x1 + tile_id % 20 * 480 AS x1, y1 + tile_id // 20 * 480 AS y1, area FROM gt",
    "runs": "SELECT event_type AS arm, user_id % 5 AS fold, event_id AS iteration, value AS metric, props, ts FROM events",
    "cand": """SELECT *, inter / (p_area + gt_area - inter)::DOUBLE AS iou FROM (SELECT p.tile_id, pred_id, score, p.cls AS pred_cls, gt_id, g.cls AS gt_cls, g.area AS gt_area, p.area AS p_area,
        (least(p.x1, g.x1) - greatest(p.x0, g.x0)) * (least(p.y1, g.y1) - greatest(p.y0, g.y0)) AS inter
        FROM pred p JOIN gt g ON p.tile_id = g.tile_id AND p.x0 < g.x1 AND g.x0 < p.x1 AND p.y0 < g.y1 AND g.y0 < p.y1)""",
}
NEEDS = {"pred": ["gt"], "tiles": ["gt"], "grid": ["tiles"], "dn": ["pixels"], "map_pred": ["pred"], "map_gt": ["gt"], "cand": ["gt", "pred"]}


def greedy_sql(name: str = "m", least: str = "0.5", thresholds: str = "", where: str = "TRUE", cls: bool = False) -> tuple[list[str], dict[str, str]]:
    """Common table expressions for greedy matching: a recursion over each tile's predictions by score.

    With `thresholds` (a list of numbers) a match is made for each, in a column thr."""
    t, k = ("thr, ", "thr") if thresholds else ("", "")
    keys = ["tile_id", *(["pred_cls"] if cls else []), *([k] if k else [])]
    by, on = ", ".join(keys), " AND ".join(f"r.{x} = s.{x}" for x in keys)
    source = f"(SELECT *, unnest([{thresholds}])::DOUBLE AS thr FROM cand)" if thresholds else "cand"
    limit = "thr" if thresholds else least
    parts = {
        f"{name}_opt": f"SELECT {by}, pred_id, max(score) AS score, list(struct_pack(g := gt_id, iou := iou) ORDER BY iou DESC, gt_id) AS c FROM {source} WHERE iou >= {limit} AND {where} GROUP BY {by}, pred_id",
        f"{name}_rank": f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, pred_id) AS k FROM {name}_opt",
        f"{name}_run": f"""SELECT {by}, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS pred_id, NULL::BIGINT AS gt_id, NULL::DOUBLE AS iou FROM {name}_rank WHERE k = 1
            UNION ALL SELECT {", ".join("r." + x for x in keys)}, r.k, CASE WHEN b IS NULL THEN taken ELSE list_append(taken, b.g) END, r.pred_id, b.g, b.iou
            FROM (SELECT s.*, r.k AS rk, r.pred_id AS rp, list_filter(r.c, lambda x: NOT list_contains(s.taken, x.g))[1] AS b FROM {name}_run s JOIN {name}_rank r ON {on} AND r.k = s.k + 1) q
            JOIN {name}_rank r ON r.pred_id = q.rp AND r.k = q.rk AND {" AND ".join(f"r.{x} = q.{x}" for x in keys)}""",
        name: f"SELECT {by}, pred_id, gt_id, iou FROM {name}_run WHERE gt_id IS NOT NULL",
    }
    return ["cand"], parts


def sql(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """`body` with the views it needs, and those they need, in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    parts = [f"{v} AS MATERIALIZED ({SQL[v]})" for v in order] + [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
