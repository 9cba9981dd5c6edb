"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Each rule is a ratio (per mille) and rejects a document whose ratio is above a cutoff. Cutoffs are not set by hand:
on labelled good documents (the holdout) each stratum and rule tests its cutoffs from the most lenient on, with the
exact binomial tail P(Bin(n, alpha) <= k) for k false rejections among n; it keeps the strictest cutoff before the
first that fails. That fixed order needs no correction within a stratum and rule; over all strata and rules the level
is divided by their number (Bonferroni), and the rules of a stratum share its alpha. So with probability 1 - delta
at once for all strata, the rules reject at most the share alpha of good documents. The most frequent values are strata:
as many as have so many labels each that some cutoff could be certified at the level that so many strata (and the pool)
leave. All others are pooled in one stratum, whose guarantee holds for them together.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, columns_of, materialise

SYMBOLS = "#*$%&|<>"
RULES = ("symbols", "dup_lines", "repeats")
CUTOFFS = (900, 800, 700, 600, 500, 450, 400, 350, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20, 10)
#: How the pool is shown; a value of this name is a stratum or in the pool like any other.
OTHER = "other"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text."""
    n = F.size(words)
    windows = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    )

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            again = F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]))
            start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total"))
            step = lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(3), p - a["last"])).alias("total"))
            return F.aggregate(F.array_sort(F.transform(again, lambda e: e["i"])), start, step)["total"]

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, places))

    return let(windows, covered)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the struct column `_q`: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long)."""
    value = F.coalesce(F.col(text), F.lit(""))
    core = F.btrim(value, F.lit(SPACES))
    words = F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, SPACE_CLASS + "+"))
    lines = F.filter(F.split(value, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    bare = F.translate(value, SPACES, "")
    q = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    # an exploded array of one: filters and columns that use the measures afterwards do not take them anew
    out = docs.withColumns({"_w": q, "_l": by_line, "_c": F.length(bare).cast("long"), "_s": (F.length(value) - F.length(F.translate(value, SYMBOLS, ""))).cast("long")})
    measures = F.struct(F.col("_w.n_words"), F.col("_c").alias("word_chars"), F.col("_s").alias("n_symbols"), F.col("_l.n_lines"), F.col("_l.n_dup_lines"), F.col("_w.n_repeat_words"))
    return out.withColumn("_q", F.explode(F.array(measures))).drop("_w", "_l", "_c", "_s")


def base_failed(q: str = "_q") -> Column:
    return (F.col(f"{q}.n_words") < 50) | (100 * F.col(f"{q}.n_repeat_words") > 50 * F.col(f"{q}.n_words"))


def ratios(q: str = "_q") -> dict[str, Column]:
    """Per mille of each rule, whole numbers."""
    part = lambda a, b: F.expr(f"{q}.{a} * 1000 div greatest({q}.{b}, 1L)")
    return {"symbols": part("n_symbols", "word_chars"), "dup_lines": part("n_dup_lines", "n_lines"), "repeats": part("n_repeat_words", "n_words")}


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) by summing the terms in logarithms; 1 where k > n * p, which no test needs."""
    odds = math.log(p / (1 - p))
    first = n * F.lit(math.log1p(-p))
    start = F.struct(first.alias("term"), first.alias("sum"))

    def step(a: Column, j: Column) -> Column:
        term = a["term"] + F.log((n - j + 1) / j) + F.lit(odds)
        return F.struct(term.alias("term"), (F.greatest(a["sum"], term) + F.log1p(F.exp(-F.abs(a["sum"] - term)))).alias("sum"))

    summed = F.aggregate(F.when(k > 0, F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>")), start, step)["sum"]
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(summed))


def least_holdout(alpha: float, delta: float) -> int:
    """Good documents without which no cutoff of a stratum can be certified, even with no false rejection."""
    return math.ceil(math.log(delta / len(RULES)) / math.log1p(-alpha / len(RULES)))


def thresholds(holdout: DataFrame, alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """stratum and a cutoff column for each rule (null: no cutoff is certified, the rule rejects nothing there).

    holdout: stratum and a per-mille column for each rule, one row for each good labelled document."""
    count = holdout.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col(r) > c).cast("long")).alias(f"{r}_{c}") for r in RULES for c in CUTOFFS])
    rows = count.select("stratum", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.array(*[F.col(f"{r}_{c}") for c in CUTOFFS]).alias("ks")) for r in RULES])).alias("t"))
    rows = rows.crossJoin(F.broadcast(count.agg(F.count(F.lit(1)).alias("strata"))))  # one row
    level, grid = F.lit(delta) / (F.col("strata") * len(RULES)), F.array(*[F.lit(c) for c in CUTOFFS])
    passes = F.transform(F.col("t.ks"), lambda k: binomial_tail(F.col("n"), k, alpha / len(RULES)) <= level)
    certified = F.when(F.array_position(passes, F.lit(False)) == 0, F.lit(len(CUTOFFS))).otherwise(F.array_position(passes, F.lit(False)) - 1)
    rows = rows.select("stratum", F.col("t.rule").alias("rule"), F.when(certified > 0, F.element_at(grid, F.greatest(certified, F.lit(1)).cast("int"))).alias("cutoff"))
    return rows.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"{r}_cutoff") for r in RULES])


def fit(measured: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(strata, thresholds) from measured documents (doc_id, stratum_value, _q) and labels (doc_id, quality). An id
    labelled more than once counts as good only if all its labels say so; documents that fail the base rules take no
    part. Strata are chosen by the sizes of their holdouts alone, so the choice does not touch the guarantee; the pool has
    a null stratum in thresholds."""
    held = measured.where(~base_failed()).join(good_ids(labels), "doc_id").select("stratum_value", *[c.alias(r) for r, c in ratios().items()])
    held = materialise(held, "holdout")
    strata = materialise(chosen_strata(held, alpha, delta), "strata")
    named = held.join(strata, F.col("stratum_value") == F.col("stratum"), "left")
    return strata, materialise(thresholds(named, alpha, delta), "thresholds")


def chosen_strata(held: DataFrame, alpha: float, delta: float) -> DataFrame:
    """stratum: the values (stratum_value) that are strata of their own. Of the values in order of their holdouts, the
    first s are, for the largest s for which each has the labels that some cutoff takes at the level delta / strata; the
    pool, if it has rows, is one of these strata.

    Only values with the labels that a single stratum takes are put in order: at most one for each so many labels."""
    needed = lambda strata: F.ceil(F.log(F.lit(delta / len(RULES)) / strata) / math.log1p(-alpha / len(RULES)))
    sizes = held.where("stratum_value is not null").groupBy(F.col("stratum_value").alias("stratum")).count().where(F.col("count") >= least_holdout(alpha, delta))
    ordered = Window.orderBy(F.desc("count"), "stratum")
    ranked = sizes.select("stratum", "count", F.row_number().over(ordered).alias("nth"), F.sum("count").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("sofar"))
    ranked = ranked.crossJoin(F.broadcast(held.agg(F.count(F.lit(1)).alias("total"))))  # one row
    enough = F.col("count") >= needed(F.col("nth") + (F.col("total") > F.col("sofar")).cast("int"))
    last = F.max(F.when(enough, F.col("nth"))).over(Window.partitionBy(F.lit(0)))
    return ranked.withColumn("last", last).where(F.col("nth") <= F.col("last")).select("stratum")


def good_ids(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where(F.col("quality") == 1).select("doc_id")


def judge(measured: DataFrame, strata: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """measured with stratum, pooled, base_failed and kept. Strata and cutoffs are written tables, whose sizes are known:
    they are broadcast if small, and joined by sorting otherwise."""
    named = measured.join(strata, F.col("stratum_value") == F.col("stratum"), "left")
    # the pool is the null key, in a column that holds no value as it is
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    own = cutoffs.select(key(F.col("stratum")).alias("key"), *[F.col(f"{r}_cutoff") for r in RULES])
    named = named.withColumn("key", key(F.col("stratum"))).join(own, "key", "left").drop("key")
    named = named.withColumns({"pooled": F.col("stratum").isNull(), "stratum": F.coalesce("stratum", F.lit(OTHER))})
    rejected = F.lit(False)
    for rule, ratio in ratios().items():
        rejected = rejected | F.coalesce(ratio > F.col(f"{rule}_cutoff"), F.lit(False))
    return named.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~rejected)


def assess(docs: DataFrame, labels: DataFrame, stratum: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, stratum, pooled for each row.

    Null text counts as empty and fails the base rules; null strata are in the pool, which is shown as 'other'; equal rows
    and null ids each give a row; without labels or with few, no cutoff is certified and kept is the base rules' verdict.
    """
    measured = features(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(stratum).cast("string").alias("stratum_value"))).drop("text")
    measured = materialise(measured, "quality")
    found = judge(measured, *fit(measured, labels))
    return found.select("doc_id", *[F.col(f"_q.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept", "stratum", "pooled")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that assess() keeps, with their own columns. Only documents labelled good are measured for the
    cutoffs, and then every document once for its verdict. Null, empty and short texts go; equal rows stay or go together,
    rows of one id are judged each by its text; a ratio equal to a cutoff stays; an empty table gives an empty one."""
    key, value, own_stratum = columns_of([doc_id, text, stratum])
    thin = docs.select(key.alias("doc_id"), value.alias("text"), own_stratum.cast("string").alias("stratum_value"))
    strata, cutoffs = fit(features(thin.join(materialise(good_ids(labels), "good-ids"), "doc_id", "left_semi")).drop("text"), labels)
    # under names of our own, whatever the columns of docs are called
    own = {c: f"_doc{k}" for k, c in enumerate(docs.columns)}
    every = features(docs.toDF(*own.values()).withColumn("stratum_value", F.col(own[stratum]).cast("string")), own[text])
    return judge(every, strata, cutoffs).where("kept").select(*[F.col(n).alias(c) for c, n in own.items()])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') AS text, CAST(lang AS VARCHAR) AS lang FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
f AS (SELECT rid, doc_id, lang, len(ws)::BIGINT n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols, len(ls)::BIGINT n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT n_dup_lines, ws FROM w),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM f WHERE len(ws) >= 3)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
c AS (SELECT rid, count(DISTINCT i + k)::BIGINT n_repeat_words FROM r, (VALUES (0), (1), (2)) o(k) GROUP BY rid),
m AS (SELECT f.* EXCLUDE ws, coalesce(n_repeat_words, 0) n_repeat_words FROM f LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols * 1000 // greatest(word_chars, 1) AS symbols,
  n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines, n_repeat_words * 1000 // greatest(n_words, 1) AS repeats FROM m),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT lang FROM b JOIN good USING (doc_id) WHERE NOT base_failed),
z AS (SELECT lang, count(*) n, row_number() OVER (ORDER BY count(*) DESC, lang) nth, sum(count(*)) OVER (ORDER BY count(*) DESC, lang ROWS UNBOUNDED PRECEDING) sofar FROM held WHERE lang IS NOT NULL GROUP BY lang),
s AS (SELECT lang AS stratum FROM z WHERE nth <= (SELECT max(nth) FROM z WHERE n >= ceil(ln(0.05 / 3 / (nth + CASE WHEN (SELECT count(*) FROM held) > sofar THEN 1 ELSE 0 END)) / ln(1 - 0.01/3)))),
t AS (SELECT b.*, CASE WHEN s.stratum IS NULL THEN '' ELSE '=' || s.stratum END stratum FROM b LEFT JOIN s ON b.lang = s.stratum),
h AS (UNPIVOT (SELECT t.stratum, t.symbols, t.dup_lines, t.repeats FROM t JOIN good USING (doc_id) WHERE NOT base_failed) ON symbols, dup_lines, repeats INTO NAME rule VALUE ratio),
cut AS (SELECT unnest([900,800,700,600,500,450,400,350,300,250,200,150,120,100,80,60,50,40,30,20,10]) AS cutoff),
k AS (SELECT stratum, rule, cutoff, count(*) n, sum(CASE WHEN ratio > cutoff THEN 1 ELSE 0 END)::BIGINT k FROM h, cut GROUP BY ALL),
p AS (SELECT *, CASE WHEN k > n * (0.01/3) THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - (CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END) - lgamma(n - j + 1) + j * ln(0.01/3) + (n - j) * ln(1 - 0.01/3)))) END AS tail,
  (SELECT count(DISTINCT stratum) FROM h) AS strata FROM k),
q AS (SELECT *, bool_and(tail <= 0.05 / (strata * 3)) OVER (PARTITION BY stratum, rule ORDER BY cutoff DESC) AS ok FROM p),
x AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM q WHERE ok GROUP BY ALL),
y AS (SELECT stratum, max(CASE WHEN rule = 'symbols' THEN cutoff END) a, max(CASE WHEN rule = 'dup_lines' THEN cutoff END) b, max(CASE WHEN rule = 'repeats' THEN cutoff END) c FROM x GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(symbols > y.a, false) OR coalesce(dup_lines > y.b, false) OR coalesce(repeats > y.c, false)) AS kept, CASE t.stratum WHEN '' THEN 'other' ELSE substr(t.stratum, 2) END AS stratum, t.stratum = '' AS pooled
FROM t LEFT JOIN y ON t.stratum = y.stratum
"""
