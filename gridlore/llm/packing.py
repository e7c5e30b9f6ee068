"""Best-two-fit packing of token sequences.

Every text becomes token ids plus an end id. Pieces of at most `capacity` tokens are planned from the
histogram of piece lengths, which has `capacity` rows however many documents there are: bins are filled
greedily with the longest length that fits, then the smallest member of a bin is replaced by the two
unpacked lengths that fill its expanded gap most tightly. A pattern found is used for as many bins as the
counts allow. Each piece then looks its place up by its rank among the pieces of its length, so packing is
global but no task holds more than a slice of one length.

Nulls and empty texts are one piece that holds the end id alone; null ids are kept; repeated rows are packed
once each; pieces of one length are interchangeable, and take their places in any order. Very long texts are encoded
whole, one at a time, and cut into as many pieces as they need. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.llm import common

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)
WITH_IDS = T.StructType([*PIECES.fields, T.StructField("ids", T.BinaryType())])


class Tokens:
    """Texts to token ids, as the tokenizer's JSON file gives them.

    `path` is that file; the ranks file beside it holds the same vocabulary for a faster encoder with the same
    ids. Tokens that the JSON file adds to the vocabulary are found first, in the text as it stands. The vocabulary's
    own pattern needs a look-ahead, and so a backtracking matcher, only where two white-space characters meet; other
    texts are encoded with the rest of it.
    """

    PAIRS = re.compile(r"\s\s")

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as file:
            more = json.load(file).get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in more):
            raise ValueError("an added token that takes in its surroundings")
        self.added = {t["content"]: t["id"] for t in more}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(k): int(v) for k, v in (line.split() for line in lines)}
        plain = PATTERN.replace(r"|\s+(?!\S)", "")
        self.whole, self.plain = (tiktoken.Encoding("bpe", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (PATTERN, plain))

    def encode(self, text: str) -> list[int]:
        for word in self.added:
            if word in text:
                return [i for part in self.split.split(text) if part for i in ([self.added[part]] if part in self.added else self.ordinary(part))]
        return self.ordinary(text)

    def ordinary(self, text: str) -> list[int]:
        if text.replace("\n", "").isprintable():  # no white space but spaces and line ends
            pairs = "  " in text or "\n\n" in text or " \n" in text or "\n " in text
        else:
            pairs = self.PAIRS.search(text)
        return (self.whole if pairs else self.plain).encode_ordinary(text)


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids.

    The remainder of a long document is its first piece, so that all later pieces fill a sequence."""
    end = np.array([end_id], "<u4").tobytes()

    def start():
        tokens = Tokens(path)

        def cut(doc_ids: list, texts: list) -> list:
            out = [[] for _ in (WITH_IDS if ids else PIECES)]
            for doc_id, text in zip(doc_ids, texts, strict=True):
                data = array("I", tokens.encode(text or "")).tobytes() + end
                place, piece, size = 0, 0, len(data) // 4 % capacity or capacity
                while place * 4 < len(data):
                    own = data[place * 4 : (place + size) * 4]
                    for column, value in zip(out, (doc_id, piece, place, size, zlib.crc32(own), own), strict=False):
                        column.append(value)
                    place, piece, size = place + size, piece + 1, capacity
            return out

        return cut

    return common.map_columns(docs.select(F.col("doc_id").cast("long"), "text"), WITH_IDS if ids else PIECES, start)


def plan(counts: dict[int, int], capacity: int = 1024) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how many bins use each, by best-two-fit over the counts of lengths."""
    left = np.zeros(capacity + 2, np.int64)
    for length, n in counts.items():
        left[length] += n
    out: list[tuple[list[int], int]] = []

    def largest() -> np.ndarray:
        """For every room, the longest length left that fits it (0: none)."""
        at = np.where(left[: capacity + 1] > 0, np.arange(capacity + 1), 0)
        at[0] = 0
        return np.maximum.accumulate(at)

    while True:
        fits = largest()
        top = int(fits[capacity])
        if not top:
            return out
        members, room = [], capacity
        taken: dict[int, int] = {}

        def take(length: int, n: int = 1) -> None:
            left[length] -= n
            taken[length] = taken.get(length, 0) + n

        while room:
            pick = int(largest()[room])
            if not pick:
                break
            n = min(int(left[pick]), room // pick)
            take(pick, n)
            members += [pick] * n
            room -= pick * n
        while room and len(members) > 1:
            small = min(members)
            gap = room + small
            fits = largest()
            a = np.flatnonzero(left[: gap]) if gap <= capacity else np.flatnonzero(left[:capacity])
            a = a[a > 0]
            if not a.size:
                break
            b = fits[gap - a]
            same = (b == a) & (left[a] < 2)
            b[same] = fits[np.maximum(np.minimum(gap - a[same], a[same] - 1), 0)]
            sums = np.where(b > 0, a + b, 0)
            best = int(sums.argmax())
            if sums[best] <= small:
                break
            take(small, -1)
            members.remove(small)
            for length in (int(a[best]), int(b[best])):
                take(length)
                members.append(length)
            room = gap - int(sums[best])
        times = 1 + min(int(left[k]) // n for k, n in taken.items() if n)
        for k, n in taken.items():
            left[k] -= n * (times - 1)
        out.append((sorted(members, reverse=True), times))


def places(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, low, high, first, at): the pieces of that length with ranks low..high-1 go to the
    sequences first, first + 1, ... at that offset."""
    rows, ranks, sequence = [], {}, 0
    for members, times in patterns:
        offset = 0
        for length in members:
            low = ranks.get(length, 0)
            rows.append((length, low, low + times, sequence, offset))
            ranks[length] = low + times
            offset += length
        sequence += times
    return rows


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, part_rows: int = 200_000, ids: bool = False, most_places: int = 200_000) -> DataFrame:
    """Pieces with sequence_id and offset.

    Pieces that fill a sequence get one of their own, numbered below zero; the others are planned. The
    table of places has at most a few rows a pattern and the patterns are about as many as there are
    lengths, whatever the input; it is broadcast if it has at most `most_places` rows, else joined."""
    spark = docs.sparkSession
    cut = common.scratch(pieces(docs, path, capacity, end_id, ids), "pieces")
    part = cut.where(F.col("length") < capacity)  # still a scan of the written table
    counts = {r[0]: r[1] for r in part.groupBy("length").agg(F.count(F.lit(1))).collect()}
    rows = places(plan(counts, capacity))
    at = spark.createDataFrame(rows, "p_length long, low long, high long, first long, at long")
    at = F.broadcast(at) if len(rows) <= most_places else at
    keys = [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    ranked = common.rank_within(part, ["length"], keys, "rank", part_rows)
    found = ranked.join(at, (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    found = found.select(*cut.columns, (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), F.col("at").alias("offset"))
    full = cut.where(F.col("length") == capacity)
    full = full.select(*cut.columns, (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return found.unionByName(full)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return pack(common.table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))
