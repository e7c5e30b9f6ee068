"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in both directions, labels every position with a softmax over the learned
languages, and a document's probabilities are the mean over its positions in letters. It is trained in numpy
by backpropagation through time on windows of a bounded sample: at most PER_LANGUAGE labelled documents of
each language, SAMPLE_CHARS characters of each. Texts are labelled whole, in segments of SEGMENT bytes.

A null text or one without a letter is `und` with score 0, as is every text where no language could be
learned. Rows with a null id are predicted, not learned from, and not held out. Ties go to the language
that sorts first; repeated rows are predicted each; an empty table gives an empty result. The MOST_LANGUAGES languages
with most labelled documents are learned, part of the sample's bound. Very long texts are read whole in bounded
segments. Other columns are ignored by `predict`; `accept` keeps them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlore.llm import common

PER_LANGUAGE, SAMPLE_CHARS, MOST_LANGUAGES = 400, 600, 1000
HIDDEN, WINDOW, BATCH, STEPS, RATE = 8, 48, 192, 350, 0.02
SEGMENT, ROWS = 256, 512

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def squash(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights have the direction (forward, backward) as first axis; gates are update, reset, candidate."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 0):
        r, n = np.random.default_rng(seed), len(languages)
        f = lambda *shape: (r.standard_normal(shape) / np.sqrt(hidden)).astype(np.float32)
        self.languages, self.hidden = languages, hidden
        self.w = {"x": f(2, 256, 3 * hidden), "u": f(2, hidden, 3 * hidden), "o": f(2, hidden, n), "b": np.zeros(n, np.float32)}

    def steps(self, data: np.ndarray, live: np.ndarray | None = None, keep: list | None = None) -> np.ndarray:
        """States (time, direction, row, hidden) over bytes (row, time); live masks padding out."""
        h, (rows, time), u, k = np.zeros((2, len(data), self.hidden), np.float32), data.shape, self.w["u"], self.hidden
        out, x = np.empty((time, 2, rows, k), np.float32), np.empty((2, rows, 3 * k), np.float32)
        byte, (ahead, behind) = np.ascontiguousarray(data.T), self.w["x"]
        for t in range(time):
            ahead.take(byte[t], 0, out=x[0], mode="clip")
            behind.take(byte[time - 1 - t], 0, out=x[1], mode="clip")
            a = h @ u
            zr = squash(x[..., : 2 * k] + a[..., : 2 * k])
            z, r = zr[..., :k], zr[..., k:]
            n = np.tanh(x[..., 2 * k :] + r * a[..., 2 * k :])
            new = n + z * (h - n)
            if live is not None:
                new *= np.stack([live[:, t], live[:, time - 1 - t]])[..., None]
            if keep is not None:
                keep.append((h, z, r, n, a[..., 2 * k :]))
            out[t] = h = new
        return out

    def label(self, states: np.ndarray) -> np.ndarray:
        """Probabilities (time, row, language) of every position."""
        logits = states[:, 0] @ self.w["o"][0] + states[::-1, 1] @ self.w["o"][1] + self.w["b"]
        each = np.ascontiguousarray(np.moveaxis(logits, -1, 0))  # short last axes are slow to reduce
        each -= each.max(axis=0)
        np.exp(each, out=each)
        each /= each.sum(axis=0)
        return np.moveaxis(each, 0, -1)

    def gradients(self, data: np.ndarray, want: np.ndarray) -> dict[str, np.ndarray]:
        keep: list = []
        states, k = self.steps(data, keep=keep), self.hidden
        d = self.label(states)
        d[:, np.arange(len(want)), want] -= 1
        d /= d.shape[0] * d.shape[1]
        g = {name: np.zeros_like(w) for name, w in self.w.items()}
        back = d[::-1]
        g["o"][0], g["o"][1] = np.einsum("tbh,tbl->hl", states[:, 0], d), np.einsum("tbh,tbl->hl", states[:, 1], back)
        g["b"] = d.sum(axis=(0, 1))
        carry, time = np.zeros_like(states[0]), len(states)
        for t in range(time - 1, -1, -1):
            h, z, r, n, a = keep[t]
            dh = carry + np.stack([d[t] @ self.w["o"][0].T, back[t] @ self.w["o"][1].T])
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * a * r * (1 - r)
            dx = np.concatenate([dz, dr, dn], axis=-1)
            da = np.concatenate([dz, dr, dn * r], axis=-1)
            g["u"] += h.transpose(0, 2, 1) @ da
            np.add.at(g["x"][0], data[:, t], dx[0])
            np.add.at(g["x"][1], data[:, time - 1 - t], dx[1])
            carry = dh * z + da @ self.w["u"].transpose(0, 2, 1)
        return g

    def train(self, texts: list[bytes], labels: list[int], seed: int = 1) -> Network:
        """Adam over windows drawn from the texts, every language as often."""
        r, by = np.random.default_rng(seed), {}
        for text, label in zip(texts, labels, strict=True):
            by.setdefault(label, []).append(np.frombuffer(text + b" " * max(0, WINDOW - len(text)), np.uint8))
        known = sorted(by)
        m, v = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2))
        for step in range(1, STEPS + 1):
            want, rows = r.choice(known, BATCH), []
            for label in want:
                text = by[label][r.integers(len(by[label]))]
                at = r.integers(len(text) - WINDOW + 1)
                rows.append(text[at : at + WINDOW])
            rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
            for k, g in self.gradients(np.array(rows), np.array(want)).items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def pooled(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each whole text."""
        name, score = ["und"] * len(texts), [0.0] * len(texts)
        parts, owners = [], []
        for i, text in enumerate(texts):
            if self.languages and text and any(map(str.isalpha, text)):
                data = text.encode(errors="replace")
                parts += [data[k : k + SEGMENT] for k in range(0, len(data), SEGMENT)]
                owners += [i] * (len(parts) - len(owners))
        sums, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        order = sorted(range(len(parts)), key=lambda k: -len(parts[k]))
        for begin in range(0, len(order), ROWS):
            at = order[begin : begin + ROWS]
            sizes = np.array([len(parts[k]) for k in at])
            time = int(sizes[0])
            data = np.frombuffer(b"".join(parts[k].ljust(time, b" ") for k in at), np.uint8).reshape(len(at), time)
            live = np.arange(time) < sizes[:, None]
            p = self.label(self.steps(data, live.astype(np.float32) if sizes[-1] < time else None))
            use = LETTER[data] & live
            who = np.array([owners[k] for k in at])
            np.add.at(sums, who, np.einsum("tbl,bt->bl", p, use.astype(np.float32)))
            np.add.at(count, who, use.sum(axis=1))
        for i in np.flatnonzero(count):
            best = int(sums[i].argmax())
            name[i], score[i] = self.languages[best], float(min(1.0, max(0.0, sums[i, best] / count[i])))
        return name, score


def learn(docs: DataFrame) -> Network:
    """Train on documents with a language whose crc32 of the id leaves 0 or 2 of 3.

    The sample is thinned by a hash of the id to about twice its bound before documents are ranked, so no
    language is sorted whole; the documents with a language's least hash always stay."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    order = F.xxhash64("doc_id", F.lit(5))
    rows = docs.select("doc_id", "text", "lang").where((rest != 1) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("least")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return Network([])
    of = lambda value: F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], value(r))])[F.col("lang")]
    share, least = of(lambda r: min(1.0, 2 * PER_LANGUAGE / r["n"])), of(lambda r: r["least"])
    thin = rows.where((F.pmod(order, F.lit(1_000_000)) < share * 1_000_000) | (order == least))
    some = thin.withColumn("__k", F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id", "text"))).where(F.col("__k") <= PER_LANGUAGE)
    begin = F.pmod(order, F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))).cast("int") + 1
    got = some.select("lang", F.substring("text", begin, F.lit(SAMPLE_CHARS)).alias("t"), order.alias("o")).collect()
    got.sort(key=lambda r: (r["lang"], r["o"], r["t"]))
    return Network(languages).train([r["t"].encode() for r in got], [languages.index(r["lang"]) for r in got])


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Only text is read for a prediction."""
    model = learn(docs)
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), out.alias("held_out"), "text")
    work = lambda ids, held, texts: [ids, held, *model.pooled(texts)]
    return common.map_columns(rows, "doc_id long, held_out boolean, lang_pred string, score double", lambda: work, rows=500)


def accept(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents in which a language is found with at least that score, with all their columns."""
    model, at = learn(docs), docs.columns.index("text")

    def each(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                _, score = model.pooled(part.column(at).to_pylist())
                yield part.filter(pa.array([s >= least for s in score]))
        batch = part = None
        common.give_back()

    return common.map_whole(docs, each)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(common.table(spark, sf_dir, "documents"))
