"""Quality rules with adaptive thresholds.

Features of a text are exact counts. Each rule's share, (numerator + 1) / (denominator + 1) in thousand-millionths, goes
into a mergeable quantile sketch: a log-linear histogram whose buckets keep the leading `BITS` binary digits of
the value (relative error under 2 ** (1 - BITS)). Adding one keeps a share of nothing apart by the text's length, so
that quartiles carry a spread even where most texts have none. Sketches add bucket by bucket, so they merge
exactly in any order, and one language and source needs a bounded number of buckets however many documents it has.

Fences are ratios, for shares vary by factors: above, q75 * (q75 / q50) ** reach, and below, for rules with two tails,
q25 * (q25 / q50) ** reach, of the document's own language and source. No cutoff is fixed: a group whose texts vary
more has wider fences. Where most texts have none of what a rule counts, quartiles say more of the texts' lengths than of
the rule, so parts of a whole have a second sketch, of the texts that have any: no fence above is further than
halfway, by factors, from the upper quartile of those (or of all, if that is larger) to the whole, and so none is out of
reach. A sketch of under `LEAST` documents gives way to the merged one of its language, then to that of the
corpus. The verdict is a join of the documents' features with the thresholds.

A null text is an empty one: no words, so base_failed. Very long texts are read whole; counts are 64-bit. Null
languages and sources are groups of their own. Repeated rows and ties are judged each, a share on a fence is kept;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlore.llm import common

BITS = 10
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rule: (numerator, denominator, reach above, reach below or none).
RULES = {
    "symbols": ("n_symbols", "word_chars", 4, None),
    "dup_lines": ("n_dup_lines", "n_lines", 3, None),
    "repeats": ("n_repeat_words", "n_words", 5, None),
    "capitals": ("n_capitals", "word_chars", 6, None),
    "word_length": ("word_chars", "n_words", 6, 6),
}
#: Rules whose share is part of a whole, which no share exceeds.
PARTS = [k for k in RULES if k != "word_length"]
SCALE, LEAST = 1_000_000_000, 30


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated(words: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more in the array. A word is hashed once, a window by its words' hashes."""

    def count(pairs: Column) -> Column:
        same = F.filter(pairs, lambda e, j: F.coalesce((e["h"] == F.get(pairs, j - 1)["h"]) | (e["h"] == F.get(pairs, j + 1)["h"]), F.get(pairs, j - 1)["h"] == e["h"], F.lit(False)))
        at = F.flatten(F.transform(same, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))
        return F.size(F.array_distinct(at))

    def windows(own: Column) -> Column:
        return F.transform(F.slice(own, 1, F.greatest(F.size(own) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(own, i + 1), F.get(own, i + 2)))

    some = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), count))
    found = let(F.transform(words, lambda w: F.xxhash64(w)), lambda own: let(windows(own), some))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(found)


def features(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    words = F.array_remove(F.split(text, GAP, -1), "")
    row = docs.select(F.col("doc_id").cast("long"), "lang", "source", text.alias("__text"), words.alias("__words"), lines.alias("__lines"))
    without = lambda pattern: F.length(F.regexp_replace("__text", pattern, "")).cast("long")
    size = F.length("__text").cast("long")
    return row.select(
        "doc_id",
        "lang",
        "source",
        F.size("__words").cast("long").alias("n_words"),
        without(GAP).alias("word_chars"),
        (size - without(f"[{SYMBOLS}]+")).alias("n_symbols"),
        (size - without("[A-Z]+")).alias("n_capitals"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        let(F.col("__words"), repeated).cast("long").alias("n_repeat_words"),
    )


def bucket(value: Column) -> Column:
    """Lower end of the value's bucket: its leading BITS binary digits."""
    shift = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def share(n: str, d: str) -> str:
    """SQL of a rule's value, at least 1; the same in both engines, `//` and `div` aside."""
    return f"greatest(({n} + 1) * CAST({SCALE} AS BIGINT) // ({d} + 1), 1)"


def fine(rule: str) -> str:
    """SQL of the test of a text's values against its fences. A fence lies within a bucket, and one count is forgiven."""
    n, d, _, down = RULES[rule]
    least = share(n, d).replace(f"({n} + 1)", n)
    below = "" if down is None else f" AND {share(n, d)} >= below_{rule}"
    return f"{least} - ({least} >> {BITS - 1}) <= above_{rule}{below}"


def native(sql: str) -> Column:
    return F.expr(sql.replace("//", "div"))


def some(n: str, d: str) -> str:
    """SQL of a rule's value where it is not zero, null elsewhere."""
    return f"CASE WHEN {n} > 0 THEN {n} * CAST({SCALE} AS BIGINT) // greatest({d}, 1) END"


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, rule, bucket, n: one mergeable sketch a language, source and rule, and of a part's texts that have any (rule+)."""
    values = [(k, share(n, d)) for k, (n, d, *_) in RULES.items()] + [(f"{k}+", some(*RULES[k][:2])) for k in PARTS]
    each = rows.select("lang", "source", F.inline(F.array(*(F.struct(F.lit(k).alias("rule"), native(v).alias("v")) for k, v in values)))).where("v is not null")
    return each.groupBy("lang", "source", "rule", bucket(F.col("v")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def fence(quartile, middle, reach: int):
    """quartile * (quartile / middle) ** reach by products in this order, so that engines agree."""
    out = quartile
    for _ in range(reach):
        out = out * (quartile / middle)
    return out


def fences(sketch: DataFrame) -> DataFrame:
    """lang, source and a fence a rule, from the finest sketch with LEAST documents."""
    levels = {"own": ["lang", "source"], "language": ["lang"], "corpus": []}
    found = sketch.select("lang", "source").distinct().withColumn("rule", F.explode(F.array(*map(F.lit, [*RULES, *(f"{k}+" for k in PARTS)]))))
    for level, keys in levels.items():
        merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys, "rule")
        run = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
        quartile = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bucket"))).cast("double")
        at = run.groupBy(*[F.col(k).alias(f"__{k}") for k in keys], F.col("rule").alias("__rule")).agg(*(quartile(k).alias(f"{level}_{25 * k}") for k in (1, 2, 3)), F.max("total").alias(f"{level}_n"))
        same = F.col("rule") == F.col("__rule")
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
        found = found.join(at, same, "left").drop("__rule", *[f"__{k}" for k in keys])
    pick = lambda q: F.when(F.col("own_n") >= LEAST, F.col(f"own_{q}")).when(F.col("language_n") >= LEAST, F.col(f"language_{q}")).otherwise(F.col(f"corpus_{q}"))
    one = found.select("lang", "source", "rule", *(pick(q).alias(f"q{q}") for q in (25, 50, 75)))
    of = lambda k, c: F.max(F.when(F.col("rule") == k, c))
    half = lambda k: F.sqrt(F.greatest(of(k, F.col("q75")), F.coalesce(of(f"{k}+", F.col("q75")), F.lit(0.0))) * F.lit(float(SCALE)))
    limit = lambda k, up: F.least(of(k, fence(F.col("q75"), F.col("q50"), up)), *([half(k)] if k in PARTS else []), F.lit(float("inf")))
    above = [limit(k, up).alias(f"above_{k}") for k, (_, _, up, _) in RULES.items()]
    below = [of(k, fence(F.col("q25"), F.col("q50"), down)).alias(f"below_{k}") for k, (_, _, _, down) in RULES.items() if down is not None]
    return one.groupBy("lang", "source").agg(*above, *below)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, kept. Features are written once; sketches and verdicts read them."""
    tables = common.Tables()
    rows = tables(features(docs), "features")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    limits = fences(tables(sketches(rows.where(~failed)), "sketches"))  # of the texts that the verdict is about
    limits = tables(limits.withColumnsRenamed({"lang": "__lang", "source": "__source"}), "fences")
    tables.drop_but(rows, limits)
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return joined.select(*columns, failed.alias("base_failed"), (~failed & native(" AND ".join(map(fine, RULES)))).alias("kept"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"))


def oracle() -> str:
    values = [(k, share(n, d)) for k, (n, d, *_) in RULES.items()] + [(f"{k}+", some(*RULES[k][:2])) for k in PARTS]
    rules = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS rule, {v} AS v FROM f WHERE NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)" for k, v in values)
    quartiles = ", ".join(f"min(bucket) FILTER (upto * 4 >= total * {k})::DOUBLE AS q{25 * k}" for k in (1, 2, 3))
    level = lambda name, keys: f"""{name} AS (SELECT {keys} rule, max(total) AS n, {quartiles} FROM (
        SELECT {keys} rule, bucket, sum(n) OVER (PARTITION BY {keys} rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys} rule) AS total
        FROM (SELECT {keys} rule, bucket, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL)"""  # noqa: E731
    limit = lambda q, reach: " * ".join([q, *[f"({q} / q50)"] * reach])
    half = lambda k: f", sqrt(greatest(max(q75) FILTER (rule = '{k}'), coalesce(max(q75) FILTER (rule = '{k}+'), 0)) * {SCALE}::DOUBLE)" if k in PARTS else ""
    limits = ", ".join(f"least(max({limit('q75', up)}) FILTER (rule = '{k}'){half(k)}, 'inf'::DOUBLE) AS above_{k}" + (f", max({limit('q25', down)}) FILTER (rule = '{k}') AS below_{k}" if down is not None else "") for k, (_, _, up, down) in RULES.items())
    return f"""
    WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
    t AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
    r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM t) WHERE k > 1) GROUP BY doc_id),
    f AS (SELECT d.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                 CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
                 CAST(length(text) - length(translate(text, '{CAPITALS}', '')) AS BIGINT) AS n_capitals, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
          FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
    sketch AS (SELECT lang, source, rule, (v >> greatest(length(bin(v)) - {BITS}, 0)) << greatest(length(bin(v)) - {BITS}, 0) AS bucket, count(*) AS n FROM (
          {rules}) WHERE v IS NOT NULL GROUP BY ALL),
    {level("own", "lang, source,")}, {level("language", "lang,")}, {level("corpus", "")},
    base AS (SELECT * FROM (SELECT DISTINCT lang, source FROM sketch), (SELECT DISTINCT rule FROM sketch)),
    picked AS (SELECT e.lang, e.source, e.rule, {", ".join(f"CASE WHEN o.n >= {LEAST} THEN o.q{q} WHEN g.n >= {LEAST} THEN g.q{q} ELSE c.q{q} END AS q{q}" for q in (25, 50, 75))}
               FROM base e LEFT JOIN own o ON e.lang IS NOT DISTINCT FROM o.lang AND e.source IS NOT DISTINCT FROM o.source AND e.rule = o.rule
               LEFT JOIN language g ON e.lang IS NOT DISTINCT FROM g.lang AND e.rule = g.rule LEFT JOIN corpus c ON e.rule = c.rule),
    fences AS (SELECT lang, source, {limits} FROM picked GROUP BY ALL)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {" AND ".join(map(fine, RULES))} AS kept
    FROM f LEFT JOIN fences ON f.lang IS NOT DISTINCT FROM fences.lang AND f.source IS NOT DISTINCT FROM fences.source"""
