"""Operator 8, quality rules: native features, cutoffs selected with a bound on false rejection.

Each rule rejects a document whose statistic exceeds the cutoff of its stratum. Cutoffs come from
a labelled holdout. Within a stratum the fixed grid of cutoffs is tested from the loosest to the
strictest; cutoff c passes while the exact binomial tail P[Bin(n, alpha) <= k] <= delta / m holds,
where n counts the stratum's good documents, k those that c rejects, and m = strata x rules (a
Bonferroni correction; within one rule the order of tests is fixed, so none is needed there). This
is the one-sided Clopper-Pearson bound: with probability 1 - delta no selected cutoff rejects more
than alpha of the good documents of its stratum. Among passing cutoffs the one with the greatest
`bad rejected - cost x good rejected` is taken, the loosest of equals; none if that isn't positive.
A stratum with too few labels certifies nothing and so keeps its documents; none rejected, it takes
ln(m / delta) / -ln(1 - alpha) good labels to certify a cutoff, 349 at four rules in one stratum. All
rules together reject at most rules x alpha, 5 %, of a stratum's good documents (a union bound).

Edge cases: null text has no words and fails the base rule; a null stratum is a stratum of its own;
labels that are null, or of absent documents, are ignored; of contradicting labels the lowest
counts; repeated rows are judged one by one; very long texts
are counted whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from folia.llm.common import WORD_BREAKS, count_chars, cut, table, words

#: Looked-up cutoffs go to the executors as literals up to so many strata; beyond, by a join.
STRATA_INLINE = 1000
LONGEST = 1 << 30


@dataclass(frozen=True)
class Policy:
    """alpha: bound on the share of good documents that one rule rejects in one stratum. delta:
    probability that any bound fails. cost: bad documents that weigh as much as one good one."""

    alpha: float = 0.0125
    delta: float = 0.05
    cost: float = 4.0
    grid: tuple[float, ...] = field(default=tuple(round(0.02 * i, 2) for i in range(50)))
    rules: tuple[str, ...] = ("symbol_ratio", "bang_ratio", "dup_line_ratio", "repeat_ratio")


def near(a: Column, b: Column, place: int) -> Column:
    """Two packed windows with the same bits of hash; false if one is absent."""
    return F.coalesce(a.bitwiseXOR(b).bitwiseAND(F.lit(~place)) == 0, F.lit(False))


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text, with the counts n_words, word_chars, n_symbols, n_dup_lines and
    n_repeat_words, and the rules' ratios. One narrow pass; no shuffle, no Python."""
    d = F.coalesce(F.col(text), F.lit(""))
    keep = [c for c in df.columns if c != text]
    x = df.select(
        *keep,
        words(F.col(text)).alias("_w"),
        F.filter(F.split(d, "\n"), lambda s: F.btrim(s, F.lit(WORD_BREAKS)) != "").alias("_lines"),
        count_chars(d, "#*$%&|<>").alias("n_symbols"),
        count_chars(d, "!").alias("n_bang"),
    )
    x = x.select(
        *keep, "n_symbols", "n_bang", "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_1"),
    )
    pairs = F.zip_with("_1", F.slice("_1", 2, LONGEST), lambda a, b: F.xxhash64(a, b))
    threes = F.zip_with(pairs, F.slice("_1", 3, LONGEST), lambda a, b: F.xxhash64(a, b))
    x = x.withColumn("_h", F.when(F.size("_1") >= 3, F.slice(threes, F.lit(1), F.size("_1") - 2)).otherwise(F.array().cast("array<bigint>")))
    # 44 bits of the hash and 20 of the place in one long: a primitive sort brings equal windows together.
    place, ints = (1 << 20) - 1, F.array().cast("array<int>")
    repeats, short = F.size(F.array_distinct("_h")) < F.size("_h"), F.size("_h") <= place
    x = x.withColumn("_s", F.when(repeats & short, F.sort_array(F.transform("_h", lambda h, i: h.bitwiseAND(F.lit(~place)).bitwiseOR(i.cast("long"))))).otherwise(F.array().cast("array<bigint>")))
    left = F.array_compact(F.zip_with("_s", F.slice("_s", 2, LONGEST), lambda a, b: F.when(a.bitwiseXOR(b).bitwiseAND(F.lit(~place)) == 0, F.array(a, b))))
    x = x.withColumn("_c", F.sort_array(F.array_distinct(F.flatten(left))))
    three = lambda s: F.slice("_w", s.bitwiseAND(F.lit(place)).cast("int") + 1, 3)
    x = x.withColumn("_clash", F.exists(F.transform("_c", lambda s, j: F.coalesce(near(s, F.get("_c", j + 1), place) & (three(s) != three(F.get("_c", j + 1))), F.lit(False))), lambda b: b))
    # Texts of over a million words, or whose 44 bits clash, are sorted by the words themselves.
    exact = F.when(F.col("_clash") | (repeats & ~short), F.sort_array(F.transform("_h", lambda h, i: F.struct(F.slice("_w", i + 1, 3).alias("w"), i.alias("i")))))
    x = x.withColumn("_e", exact)
    twin = lambda s, j: F.coalesce(F.get("_e", j)["w"] == s["w"], F.lit(False))
    slow = F.transform(F.filter("_e", lambda s, j: twin(s, j + 1) | F.when(j > 0, twin(s, j - 1)).otherwise(F.lit(False))), lambda s: s["i"])
    fast = F.transform("_c", lambda s: s.bitwiseAND(F.lit(place)).cast("int"))
    x = x.withColumn("_r", F.sort_array(F.when(F.col("_e").isNotNull(), slow).when(F.size("_c") > 0, fast).otherwise(ints)))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    x = x.withColumn("n_repeat_words", F.aggregate("_r", start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"]))
    share = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    return x.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbol_ratio"), share("n_bang", "n_words").alias("bang_ratio"),
        share("n_dup_lines", "n_lines").alias("dup_line_ratio"), share("n_repeat_words", "n_words").alias("repeat_ratio"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P[Bin(n, p) <= k], summed exactly in logarithms; 1 where k/n >= p."""
    step = lambda a, i: F.struct(
        (a["t"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))).alias("t"), a["s"].alias("s")
    )
    first = n * F.log(F.lit(1 - p))
    init = F.struct(first.cast("double").alias("t"), first.cast("double").alias("s"))

    def add(a: Column, i: Column) -> Column:
        t = step(a, i)["t"]
        return F.struct(t.alias("t"), (F.greatest(t, a["s"]) + F.log1p(F.exp(-F.abs(t - a["s"])))).alias("s"))

    tail = F.exp(F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>")), init, add, lambda a: a["s"]))
    return F.when((n == 0) | (k >= p * n), F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail))


def cutoffs(scored: DataFrame, labels: DataFrame, policy: Policy, key: str = "doc_id", stratum: str = "lang", label: str = "quality") -> DataFrame:
    """(stratum, rule, cutoff, n, k, bad): at most strata x rules rows, from counts per grid cell."""
    g, m = policy.grid, len(policy.grid)
    y = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_y"))
    held = scored.where(~F.col("base_failed")).join(y, F.col(key) == F.col("_key"))
    grid = F.array(*[F.lit(v) for v in g])
    # cell: how many cutoffs of the grid the value exceeds, so cutoffs 0..cell-1 reject it.
    cell = lambda c: F.size(F.filter(grid, lambda v: F.col(c) > v))
    cells = held.select(F.col(stratum).alias("stratum"), "_y", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), cell(r).alias("cell")) for r in policy.rules])).alias("c"))
    cells = cells.groupBy("stratum", F.col("c.rule").alias("rule"), F.col("c.cell").alias("cell")).agg(F.sum(F.when(F.col("_y") >= 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("_y") < 1, 1).otherwise(0)).alias("bad"))
    per = cells.groupBy("stratum", "rule").agg(F.sum("good").alias("n"), F.collect_list(F.struct("cell", "good", "bad")).alias("_c"))  # at most a grid of cells
    strata = per.select(F.coalesce(F.col("stratum").cast("string"), F.lit("\0")).alias("s")).agg(F.count_distinct("s").alias("strata"))
    tests = (int(strata.collect()[0]["strata"]) or 1) * len(policy.rules)
    tried = per.select("stratum", "rule", "n", "_c", F.explode(F.sequence(F.lit(m - 1), F.lit(0), F.lit(-1))).alias("i"))
    above = lambda f: F.aggregate(F.filter("_c", lambda c: c["cell"] > F.col("i")), F.lit(0).cast("long"), lambda a, c: a + c[f])
    tried = tried.select("stratum", "rule", "n", "i", above("good").alias("k"), above("bad").alias("bad"))
    tried = tried.withColumn("ok", binomial_tail(F.col("k"), F.col("n"), policy.alpha) <= policy.delta / tests)
    w = W.partitionBy("stratum", "rule").orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)
    tried = tried.withColumn("ok", F.min("ok").over(w)).where("ok").withColumn("gain", F.col("bad") - policy.cost * F.col("k")).where("gain > 0")
    best = tried.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "i", "n", "k", "bad")).alias("b"))
    return best.select("stratum", "rule", F.get(grid, F.col("b.i")).alias("cutoff"), F.col("b.n").alias("n"), F.col("b.k").alias("k"), F.col("b.bad").alias("bad"))


def judge(scored: DataFrame, chosen: DataFrame, policy: Policy, stratum: str = "lang") -> DataFrame:
    """scored with `kept`. The chosen cutoffs are a literal table while they are few (checked)."""
    spark = scored.sparkSession
    wide = chosen.groupBy(F.col("stratum").alias("_stratum")).pivot("rule", list(policy.rules)).agg(F.first("cutoff"))
    rows = wide.limit(STRATA_INLINE + 1).collect()
    if len(rows) <= STRATA_INLINE:
        schema = T.StructType([T.StructField("_stratum", scored.schema[stratum].dataType), *[T.StructField(f"_{r}", T.DoubleType()) for r in policy.rules]])
        right = F.broadcast(spark.createDataFrame([tuple(r) for r in rows], schema))
    else:
        right = wide.toDF("_stratum", *[f"_{r}" for r in policy.rules])
    out = scored.join(right, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    hit = F.lit(False)
    for r in policy.rules:
        hit = hit | F.coalesce(F.col(r) > F.col(f"_{r}"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~hit).drop("_stratum", *[f"_{r}" for r in policy.rules])


def quality(docs: DataFrame, labels: DataFrame, policy: Policy = Policy(), stratum: str = "lang") -> DataFrame:
    """One row per document: counts, ratios, base_failed, kept."""
    scored = cut(features(docs.select("doc_id", "text", stratum)), "quality")
    return judge(scored, cutoffs(scored, labels, policy, stratum=stratum), policy, stratum)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = """
WITH a AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(list_slice(w, s, s + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM a WHERE len(w) >= 3)
), twice AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT s + i) AS n FROM (SELECT doc_id, s, unnest(range(0, 3)) AS i FROM twice) GROUP BY doc_id),
f AS (
  SELECT a.doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, length(regexp_replace(t, '[^!]', '', 'g')) AS n_bang
  FROM a LEFT JOIN covered ON a.doc_id = covered.doc_id
), x AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    coalesce(n_symbols / nullif(word_chars, 0), 0.0) AS r0, coalesce(n_bang / nullif(n_words, 0), 0.0) AS r1, coalesce(n_dup_lines / nullif(n_lines, 0), 0.0) AS r2, coalesce(n_repeat_words / nullif(n_words, 0), 0.0) AS r3 FROM f
), y AS (SELECT doc_id, min(quality) AS y FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT lang, y, r0, r1, r2, r3 FROM x JOIN y ON x.doc_id = y.doc_id WHERE NOT base_failed),
v AS (SELECT lang, y, 0 AS r, r0 AS v FROM held UNION ALL SELECT lang, y, 1, r1 FROM held UNION ALL SELECT lang, y, 2, r2 FROM held UNION ALL SELECT lang, y, 3, r3 FROM held),
g AS (SELECT unnest(range(0, 50)) AS i),
t AS (
  SELECT lang, r, i, sum(CASE WHEN y >= 1 THEN 1 ELSE 0 END) AS n, sum(CASE WHEN y >= 1 AND v > i / 50.0 THEN 1 ELSE 0 END) AS k, sum(CASE WHEN y < 1 AND v > i / 50.0 THEN 1 ELSE 0 END) AS bad
  FROM v, g GROUP BY lang, r, i
), tail AS (
  SELECT *, CASE WHEN n = 0 OR k >= 0.0125 * n THEN 1.0 ELSE list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.0125) + (n - j) * ln(0.9875)))) END AS p FROM t
), ok AS (SELECT *, max(p) OVER (PARTITION BY lang, r ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 0.05 / (4 * (SELECT count(DISTINCT coalesce(lang, chr(0))) FROM held)) AS ok FROM tail),
best AS (SELECT lang, r, i, row_number() OVER (PARTITION BY lang, r ORDER BY bad - 4 * k DESC, i DESC) AS q FROM ok WHERE ok AND bad - 4 * k > 0),
cuts AS (SELECT lang, max(CASE WHEN r = 0 THEN i END) AS c0, max(CASE WHEN r = 1 THEN i END) AS c1, max(CASE WHEN r = 2 THEN i END) AS c2, max(CASE WHEN r = 3 THEN i END) AS c3 FROM best WHERE q = 1 GROUP BY lang)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(r0 > c0 / 50.0, false) OR coalesce(r1 > c1 / 50.0, false) OR coalesce(r2 > c2 / 50.0, false) OR coalesce(r3 > c3 / 50.0, false)) AS kept
FROM x LEFT JOIN cuts ON x.lang IS NOT DISTINCT FROM cuts.lang
"""
