"""Mixing to target weights by iterative proportional fitting.

Tokens, as the tokenizer counts them with one to end a document, are summed by cell (source, language, topic). Cell
weights are raked: scaled to the target total of every source, then language, then topic, again and again until
all marginals hold. A document of a cell is kept with probability min(1, scale * weight), scale calibrated so
that the expected tokens kept are the share asked for; its draw is a hash of its id, so a run repeats and a
document's draw does not depend on others.

Targets are shares by name, or by default each value's share of tokens to the power ALPHA, which brings a hot
source down and rare ones up. The cell table has a row a combination that occurs; up to MOST_CELLS rows are
raked in numpy and broadcast, more of them are raked and joined in Spark, by the same rounds, test and steps. Where
ROUNDS leave a marginal further off than CLOSE, a warning tells how far.

Topics are TOPICS clusters of hashed, weighted words, found by spherical k-means on the whole texts of all documents, a pass of
Spark a round, after the mean of a document's language is taken off, so that a topic is none of the languages. Words are
counted once and written; rarities, means and centres are sums of whole numbers over all of these rows, so that neither
order nor partitions change them. Only the first centres are single documents, by a hash. Means of the MOST_LANGS
commonest languages travel with a task, those of all others are joined to their documents.

Null sources and languages are values of their own; a null or empty text is one token of topic -1; very long texts are
read whole, one at a time; null ids share one draw; repeated rows are drawn alike; of equally near topics the first
counts; an empty table gives an empty result; other columns are ignored, or kept whatever their names by `sample`.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.llm import common
from gridlore.llm.dedup import Shingler
from gridlore.llm.packing import Tokens

ALPHA, KEEP, ROUNDS, CLOSE, STEPS, MOST_CELLS = 0.7, 0.85, 200, 1e-9, 100, 100_000
DIMENSIONS = ("source", "lang", "topic")
TOPICS, WIDTH, FITS, SEEDS, MOST_LANGS = 8, 1024, 12, 64, 1000
#: Sums are of whole multiples of 1 / UNIT; of a document this near to its language's mean no direction is left.
UNIT, LEAST = 2.0**28, 1e-3
#: Scores further apart than this are told apart by a matrix product, whose error is below 1e-12.
SURE = 1e-9
#: Rows of a batch that are worked on at once.
SLICE = 500


class Words:
    """Hashed words of texts, distinct, and how often each is there."""

    #: Texts and bytes of them that are hashed at once, a longer text alone.
    TEXTS, BYTES = 64, 1 << 16

    def __init__(self):
        self.found = Shingler(1).found

    def __call__(self, text: str | None) -> tuple[bytes, bytes]:
        return self.all([text])[0]

    def all(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        out, held, size = [], [], 0
        for text in texts:
            data = (text or "").encode(errors="replace").lower()
            if held and (len(held) == self.TEXTS or size + len(data) > self.BYTES):
                out += self.counts(held)
                held, size = [], 0
            held.append(data)
            size += len(data) + 1
        return out + self.counts(held)

    def counts(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Texts are put together with a blank between them, so that no word spans two."""
        begin, words = self.found(np.frombuffer(b" ".join(texts), np.uint8))
        row = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, side="right")
        counts = np.bincount(row * WIDTH + (words % np.uint64(WIDTH)).astype(np.int64), minlength=len(texts) * WIDTH)
        at = np.flatnonzero(counts)
        word, times = (at % WIDTH).astype(np.uint16).tobytes(), counts[at].astype(np.uint32).tobytes()
        ends = np.searchsorted(at, np.arange(len(texts) + 1) * WIDTH).tolist()
        return [(word[2 * a : 2 * b], times[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])]


class Bags:
    """The words of some rows, one after another: the row each is of, its place, how often it is there."""

    def __init__(self, words: list[bytes], times: list[bytes]):
        self.sizes = np.array([len(w) // 2 for w in words], np.int64)
        self.row = np.repeat(np.arange(len(words)), self.sizes)
        self.word = np.frombuffer(b"".join(words), np.uint16).astype(np.int64)
        self.times = np.frombuffer(b"".join(times), np.uint32)

    def weigh(self, rarity: np.ndarray) -> np.ndarray:
        w = np.sqrt(self.times) * rarity[self.word]
        return w / np.maximum(np.sqrt(self.sums(w * w)), 1e-12)[self.row]

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, values, len(self.sizes))


class Topics:
    """Clusters of hashed words, weighted by rarity, with each language's mean taken off.

    means has the mean of all documents, then those of the languages in `places`; a row may bring its own."""

    def __init__(self, rarity: np.ndarray, means: np.ndarray, places: dict[str, int], centres: np.ndarray):
        self.rarity, self.means, self.places, self.centres = rarity, means, places, centres
        self.square, self.taken = self.of(means)

    def of(self, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The square of each mean's length, and what taking it off takes from the score of each centre."""
        return np.array([(m * m).sum() for m in means]), np.array([[(m * c).sum() for c in self.centres] for m in means])

    def near(self, words: list, times: list, langs: list, own: list) -> tuple:
        """Of rows: words, their weights, the mean of each row, the length left without it, and the nearest centre."""
        bags = Bags(words, times)
        w, extra = bags.weigh(self.rarity), [i for i, m in enumerate(own) if m is not None]
        at = np.array([self.places.get(one, 0) for one in langs], np.int64)
        means, square, taken = self.means, self.square, self.taken
        if extra:
            at[extra] = len(means) + np.arange(len(extra))
            more = np.frombuffer(b"".join(own[i] for i in extra)).reshape(-1, WIDTH)
            means, square, taken = (np.concatenate(pair) for pair in zip((means, square, taken), (more, *self.of(more)), strict=True))
        left = np.sqrt(np.maximum(bags.sums(w * w) + square[at] - 2 * bags.sums(w * means[at[bags.row], bags.word]), 0))
        return bags, w, means, at, left, self.nearest(bags, w, taken[at])

    def nearest(self, bags: Bags, w: np.ndarray, taken: np.ndarray) -> np.ndarray:
        """The centre of the greatest score, the first of equal ones.

        A matrix product finds it; where the next one is within SURE, far more than the product's rounding, sums word by word
        decide, so that which rows are worked on together changes nothing."""
        whole = np.zeros(len(bags.sizes) * WIDTH)
        whole[bags.row * WIDTH + bags.word] = w
        score = whole.reshape(-1, WIDTH) @ self.centres.T - taken
        close = (score >= score.max(axis=1, keepdims=True) - SURE).sum(axis=1) > 1
        if close.any():
            some = close[bags.row]
            row, word, w = bags.row[some], bags.word[some], w[some]
            score[close] = (np.stack([np.bincount(row, w * c[word], len(close)) for c in self.centres], axis=1) - taken)[close]
        return score.argmax(axis=1)

    def __call__(self, words: list, times: list, langs: list, own: list) -> np.ndarray:
        bags, *_, best = self.near(words, times, langs, own)
        return np.where(bags.sizes > 0, best, -1)

    def moments(self, words: list, times: list, langs: list, own: list) -> np.ndarray:
        """By centre, the sum of its rows' directions before the means in self.means are taken off, and how much of each of those to take off."""
        bags, w, means, at, left, best = self.near(words, times, langs, own)
        used = (bags.sizes > 0) & (left > LEAST)
        length = np.where(used, left, np.inf)
        n, k = len(self.means), len(self.centres)
        sums = np.bincount(best[bags.row] * WIDTH + bags.word, np.rint(w / length[bags.row] * UNIT), k * WIDTH).astype(np.int64)
        off, kept = np.rint(UNIT / length), at < n
        for i in np.flatnonzero(~kept & used):
            sums[best[i] * WIDTH : (best[i] + 1) * WIDTH] -= np.rint(off[i] * means[at[i]]).astype(np.int64)
        return np.concatenate([sums, np.bincount(best[kept] * n + at[kept], off[kept], k * n).astype(np.int64)])

    @staticmethod
    def unit(v: np.ndarray) -> np.ndarray:
        return v / max(float(np.sqrt((v * v).sum())), 1e-12)


def total(rows: DataFrame, size: int, work: Callable[..., np.ndarray]) -> np.ndarray:
    """The sum of vectors of `size` whole numbers that work gives for slices of rows, as lists of the columns: by task, then in eight tasks, then here."""

    def add(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(size, np.int64)
        for part in parts:
            got += part
        yield pa.RecordBatch.from_pydict({"sum": pa.array([got.tobytes()], pa.binary())})
        common.give_back()

    def each(batches):
        return add(work(*(c.to_pylist() for c in b.slice(i, SLICE).columns)) for b in batches for i in range(0, b.num_rows, SLICE))

    def again(batches):
        return add(np.frombuffer(x, np.int64) for b in batches for x in b.column(0).to_pylist())

    got = rows.mapInArrow(each, "sum binary").repartition(8).mapInArrow(again, "sum binary").collect()
    return sum((np.frombuffer(r["sum"], np.int64) for r in got), np.zeros(size, np.int64))


def presence(words: list) -> np.ndarray:
    """In how many rows each word is, then how many rows have words."""
    have = np.bincount(np.frombuffer(b"".join(words), np.uint16), minlength=WIDTH)
    return np.append(have, sum(len(w) > 0 for w in words)).astype(np.int64)


def means_of(rarity: np.ndarray, places: dict[str, int]) -> Callable[..., np.ndarray]:
    """Sums of weighted words of all rows and by language, then numbers of rows, for `total`."""

    def work(words: list, times: list, langs: list) -> np.ndarray:
        n, bags = len(places) + 1, Bags(words, times)
        w = np.rint(bags.weigh(rarity) * UNIT)
        at, full = np.array([places.get(one, 0) for one in langs], np.int64), bags.sizes > 0
        sums = np.bincount(at[bags.row] * WIDTH + bags.word, w, n * WIDTH).astype(np.int64)
        sums[:WIDTH] = np.bincount(bags.word, w, WIDTH)
        count = np.bincount(at[full], minlength=n)
        count[0] = full.sum()
        return np.concatenate([sums, count])

    return work


def own_means(rarity: np.ndarray) -> Callable[[], Callable[..., list]]:
    """The mean of a group of one language, for map_groups."""

    def start():
        work = means_of(rarity, {})

        def run(langs: list, words: list, times: list) -> list:
            got = np.zeros(WIDTH + 1, np.int64)
            for i in range(0, len(langs), SLICE):
                got += work(words[i : i + SLICE], times[i : i + SLICE], langs[i : i + SLICE])
            return [[langs[0]], [(got[:-1] / (max(got[-1], 1) * UNIT)).tobytes()]]

        return run

    return start


def fit(rows: DataFrame, topics: int = TOPICS, rounds: int = FITS, most_langs: int = MOST_LANGS) -> tuple[DataFrame, Topics]:
    """Topics of all rows (key, lang, words, times, others; written), and the rows with `own`, a mean that only they need, or null."""
    full = rows.where(F.length("words") > 0)
    have = total(full.select("words"), WIDTH + 1, presence)
    rarity = np.log((1 + have[-1]) / (1 + have[:-1]))
    common_langs = full.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs + 1).collect()
    places = {r["lang"]: i + 1 for i, r in enumerate(common_langs[:most_langs])}
    n = len(places) + 1
    got = total(full.select("words", "times", "lang"), n * WIDTH + n, means_of(rarity, places))
    means = got[: n * WIDTH].reshape(n, WIDTH) / (np.maximum(got[n * WIDTH :, None], 1) * UNIT)
    if len(common_langs) > most_langs:
        known = F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in places], "lang string"))
        rest = full.where("lang is not null").join(known, "lang", "left_anti").select("lang", "words", "times")
        own = common.scratch(common.map_groups(rest, ["lang"], "one string, own binary", own_means(rarity)), "means")
        rows = common.scratch(common.look_up(rows, own, "lang", "one", ["key", "words"], "left").drop("one"), "owned")
    else:
        rows = rows.withColumn("own", F.lit(None).cast("binary"))
    full = rows.where(F.length("words") > 0).select("words", "times", "lang", "own")
    first = rows.where(F.length("words") > 0).orderBy(F.xxhash64("key", F.lit(9)), F.xxhash64("words", "times")).limit(SEEDS).select("words", "times", "lang", "own").collect()
    model = Topics(rarity, means, places, np.zeros((1, WIDTH)))
    centres = []
    for r in list({(r["words"], r["times"]): r for r in first}.values())[:topics]:
        bags, w, all_means, at, *_ = model.near(*([r[c]] for c in ("words", "times", "lang", "own")))
        x = -all_means[at[0]]
        x[bags.word] += w
        centres.append(Topics.unit(x))
    if not centres:
        return rows, model
    last = None
    for _ in range(rounds):
        model = Topics(rarity, means, places, np.array(centres))
        got = total(full, len(centres) * (WIDTH + n), model.moments)
        if last is not None and (got == last).all():
            break
        last = got
        sums = got[: len(centres) * WIDTH].reshape(-1, WIDTH) - got[len(centres) * WIDTH :].reshape(-1, n) @ means
        taken = got[len(centres) * WIDTH :].reshape(-1, n).any(axis=1) | got[: len(centres) * WIDTH].reshape(-1, WIDTH).any(axis=1)
        centres = [Topics.unit(s) if t else c for s, t, c in zip(sums, taken, centres, strict=True)]
    return rows, Topics(rarity, means, places, np.array(centres))


def assigned(model: Topics) -> Column:
    """The topic of a row of `fit`, as text."""

    def topic(words: pa.Array, times: pa.Array, langs: pa.Array, own: pa.Array) -> pa.Array:
        out = []
        for i in range(0, len(words), SLICE):
            out.extend(model(*(c.slice(i, SLICE).to_pylist() for c in (words, times, langs, own))).tolist())
        return pa.array([str(t) for t in out], pa.string())

    return F.arrow_udf(topic, T.StringType())("words", "times", "lang", "own")


def counted(docs: DataFrame, names: dict[str, str], keep: list[str], path: str | None) -> DataFrame:
    """Columns `keep` of docs, then key, lang, tokens, words and times; `names` has the columns of the id, language and text. Written."""
    fields = [*[docs.schema[c] for c in keep], T.StructField("tokens", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("times", T.BinaryType())]
    kind, text = T.StructType(fields), docs.columns.index(names["text"])
    kept = [docs.columns.index(c) for c in keep]

    def each(batches):
        from public_tokenizers import path as place

        tokens, count = Tokens(path or place("byte_bpe_50k.json")), Words()
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                texts = part.column(text).to_pylist()
                words, times = zip(*count.all(texts), strict=True)
                new = [pa.array([len(tokens.encode(t)) + 1 if t else 1 for t in texts], pa.int64()), pa.array(words, pa.binary()), pa.array(times, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), *new], names=kind.names)
        tokens = batch = part = texts = words = times = new = None
        common.give_back()

    rows = docs.mapInArrow(each, kind)
    return common.scratch(rows.withColumns({"key": F.col(names["doc_id"]).cast("long"), "lang": F.col(names["lang"]).cast("string")}), "counted")


def draw(doc_id: Column, seed: int = 11) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(doc_id, F.lit(-1)), F.lit(seed)), F.lit(2**53)) / F.lit(float(2**53))


def shares(totals: dict, wanted: dict | None) -> dict:
    """Target shares that sum to one over the values that have tokens."""
    base = {k: wanted.get(k, 0.0) if wanted else v**ALPHA for k, v in totals.items()}
    whole = sum(base.values()) or 1.0
    return {k: v / whole for k, v in base.items()}


def open_marginals(off: float) -> None:
    warnings.warn(f"raking has not converged: after {ROUNDS} rounds a marginal is off by a factor of {off:.3g}", RuntimeWarning, stacklevel=3)


def rake(cells: list[tuple], targets: list[dict]) -> np.ndarray:
    """Weights of cells (a value of each dimension, then tokens) with the targets as marginal shares."""
    mass = np.array([c[-1] for c in cells], float)
    total, weight = mass.sum(), np.ones(len(cells))
    places = [{k: i for i, k in enumerate(t)} for t in targets]
    at = [np.array([p[c[d]] for c in cells], np.int64) for d, p in enumerate(places)]
    goal = [np.array(list(t.values())) * total for t in targets]
    for _ in range(ROUNDS):
        off = 0.0
        for where, want in zip(at, goal, strict=True):
            have = np.bincount(where, weight * mass, len(want))
            factor = np.divide(want, have, out=np.zeros_like(want), where=have > 0)
            off = max(off, float(np.abs(factor[want > 0] - 1).max(initial=0)))
            weight *= factor[where]
        if off < CLOSE:
            break
    else:
        open_marginals(off)
    return weight


def scale(mass: np.ndarray, weight: np.ndarray, keep: float) -> float:
    """The factor at which the expected tokens kept are that share, or all that have weight."""
    low, high = 0.0, 1.0 / max(weight[weight > 0].min(initial=1.0), 1e-12)
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (low, mid) if (mass * np.minimum(1, mid * weight)).sum() > keep * mass.sum() else (mid, high)
    return high


def rake_in_spark(cells: DataFrame, targets: list[DataFrame], total: float) -> DataFrame:
    """As rake, for more cells than the driver should hold; a table in the shared folder a round."""
    now, path, off = cells.withColumn("weight", F.lit(1.0)), None, 0.0
    for _ in range(ROUNDS):
        now = now.withColumn("off", F.lit(0.0))
        for d, t in zip(DIMENSIONS, targets, strict=True):
            have = now.groupBy(F.col(d).alias("__d")).agg(F.sum(F.col("weight") * F.col("tokens")).alias("__have"))
            factor = F.when(F.col("__have") > 0, F.try_divide(F.col("__share") * total, "__have")).otherwise(0.0)
            have = have.join(t, F.col("__d").eqNullSafe(F.col("__value"))).select("__d", factor.alias("__factor"), F.when(F.col("__share") > 0, F.abs(factor - 1)).otherwise(0.0).alias("__off"))
            now = now.join(have, F.col(d).eqNullSafe(F.col("__d"))).select(*cells.columns, (F.col("weight") * F.col("__factor")).alias("weight"), F.greatest("off", "__off").alias("off"))
        new, new_path = common.write_scratch(now, "raked")
        if path:
            common.drop_scratch(cells.sparkSession, path)
        off, path = new.agg(F.max("off")).first()[0] or 0.0, new_path
        now = new.drop("off")
        if off < CLOSE:
            break
    else:
        open_marginals(off)
    return now


def probabilities(rows: DataFrame, wanted: dict[str, dict] | None = None, keep: float = KEEP, most_cells: int = MOST_CELLS) -> DataFrame:
    """source, lang, topic, tokens, weight, probability: one row a cell of rows (those and doc tokens)."""
    spark = rows.sparkSession
    cells, path = common.write_scratch(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    n, total = cells.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    schema = ", ".join(f"{c} {t}" for c, t in cells.dtypes) + ", weight double, probability double"
    if n <= most_cells:
        got = [tuple(r) for r in cells.orderBy(*DIMENSIONS).collect()]
        totals: list[dict] = [{} for _ in DIMENSIONS]
        for c in got:
            for d in range(len(DIMENSIONS)):
                totals[d][c[d]] = totals[d].get(c[d], 0) + c[-1]
        weight = rake(got, [shares(t, (wanted or {}).get(d)) for d, t in zip(DIMENSIONS, totals, strict=True)])
        factor = scale(np.array([c[-1] for c in got], float), weight, keep) if got else 0.0
        # At most most_cells rows: small enough for every task, and so no document moves for its probability.
        common.drop_scratch(spark, path)
        return F.broadcast(spark.createDataFrame([(*c, float(w), float(min(1, factor * w))) for c, w in zip(got, weight, strict=True)], schema))
    targets = []
    for d in DIMENSIONS:
        base = cells.groupBy(F.col(d).alias("__value")).agg(F.sum("tokens").cast("double").alias("__t"))
        given = (wanted or {}).get(d)
        goal = base.select("__value", (F.coalesce(F.create_map(*[F.lit(x) for kv in given.items() for x in kv])[F.col("__value")], F.lit(0.0)) if given else F.pow("__t", F.lit(ALPHA))).alias("__g"))
        targets.append(goal.crossJoin(F.broadcast(goal.agg(F.sum("__g").alias("__all")))).select("__value", (F.col("__g") / F.col("__all")).alias("__share")))
    raked = rake_in_spark(cells, targets, float(total))
    low, high = 0.0, 1.0 / max(raked.where("weight > 0").agg(F.min("weight")).first()[0] or 1.0, 1e-12)
    for _ in range(STEPS):
        mid = (low + high) / 2
        over = raked.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * mid))).first()[0] > keep * total
        low, high = (low, mid) if over else (mid, high)
    return raked.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * high))


def facts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), "text")
    held, model = fit(counted(rows, {c: c for c in ("doc_id", "lang", "text")}, ["doc_id", "source", "lang"], path))
    return held.select("doc_id", "source", "lang", assigned(model).alias("topic"), "tokens")


def same_cell(cells: DataFrame) -> tuple[DataFrame, list[str]]:
    """cells with the dimensions under names of their own."""
    names = [f"cell {d}" for d in DIMENSIONS]
    return cells.withColumnsRenamed(dict(zip(DIMENSIONS, names, strict=True))), names


def mix(docs: DataFrame, wanted: dict[str, dict] | None = None, keep: float = KEEP, path: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability, kept."""
    mark = len(common.MADE)
    rows, place = common.write_scratch(facts(docs, path), "facts")
    common.drop_since(docs.sparkSession, mark, place)
    cells, names = same_cell(probabilities(rows, wanted, keep))
    same = F.lit(True)
    for d, n in zip(DIMENSIONS, names, strict=True):
        same &= F.col(d).eqNullSafe(F.col(n))
    return rows.join(cells.drop("tokens"), same).select(*rows.columns, "weight", "probability", (draw(F.col("doc_id")) < F.col("probability")).alias("kept"))


def sample(docs: DataFrame, wanted: dict[str, dict] | None = None, keep: float = KEEP, path: str | None = None) -> DataFrame:
    """The documents that are drawn, with all their columns. Words and tokens are counted once and written beside them."""
    own = [f"own {i}" for i in range(len(docs.columns))]
    at = {name: own[i] for i, name in enumerate(docs.columns)}
    held, model = fit(counted(docs.toDF(*own), {c: at[c] for c in ("doc_id", "lang", "text")}, own, path))
    held = held.select(*own, "key", "lang", F.col(at["source"]).cast("string").alias("source"), assigned(model).alias("topic"), "tokens")
    cells, names = same_cell(probabilities(held.select(*DIMENSIONS, "tokens"), wanted, keep).drop("tokens"))
    same = F.lit(True)
    for d, n in zip(DIMENSIONS, names, strict=True):
        same &= F.col(d).eqNullSafe(F.col(n))
    kept = held.join(cells, same).where(draw(F.col("key")) < F.col("probability"))
    return kept.select(*own).toDF(*docs.columns)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))
