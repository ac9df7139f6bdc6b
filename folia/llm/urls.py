"""Operator 9, URL filters: path rules, then gradient-boosted trees on lexical features.

A rule fits its host and all subdomains where the url's path starts with the rule's; of those that
fit, the longest (characters of host and path) wins. What no rule fits is judged by boosted trees
(logistic loss, depth-limited, histogram splits) on features of the URL's form only: lengths,
depth, digit ratio, entropy, parameter counts, hyphens, labels, and statistics of the host's suffix
(how many labelled URLs, and which smoothed share of them is to be blocked). Names and paths aren't
features, so a host that was never seen is judged by its shape.

Training is on a bounded sample of labelled URLs, TRAIN_ROWS at most (the lowest hashes of the URL).
Each kind's rows weigh as much as all labelled URLs of the kind, so the prior is the table's own at any
size. The suffixes' statistics are counts over all labelled URLs, a table that is joined.
The query's labels are by seed: hosts with a name of SEED_BLOCK are to be blocked, the others not;
urls whose hash falls in the held-out quarter aren't learned from.

Edge cases: null url, or one without `://`, has an empty host and path, fits no rule and is allowed;
without labels of both kinds the model allows everything; repeated rows are judged each; very long
urls are read whole; of splits with equal gains the first feature's lowest cutoff is taken; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.batches import in_python
from folia.llm.common import cut, table

# The contract's rules.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
# Names of hosts that the seed labels as to be blocked.
SEED_BLOCK = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
TRAIN_ROWS, TREES, DEPTH, RATE, BINS, LEAF = 20_000, 40, 3, 0.2, 32, 20.0


def host(url: Column) -> Column:
    """Between the first :// and the next /, ? or #; A-Z in lower case, other characters as they are."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    found = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule(h: Column, p: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(the rule's text, its verdict) of the longest rule that fits; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((h == domain) | h.endswith("." + domain)) & p.startswith(start)
        text, verdict = F.when(fits, F.lit(domain + start)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def lexical(url: str, h: str, p: str, seen: float, share: float) -> list[float]:
    query = url.partition("?")[2].partition("#")[0]
    parts = [x for x in p.split("/") if x]
    labels = h.split(".")
    digits = sum(c.isdigit() for c in url)
    return [
        len(url), len(h), len(p), len(query), len(parts), digits / max(1, len(url)), sum(c.isdigit() for c in h) / max(1, len(h)),
        _entropy(h), _entropy(p), query.count("=") if query else 0, h.count("-"), p.count("-"), len(labels), max(map(len, labels)),
        len(labels[-3]) if len(labels) > 2 else 0, sum(c in "aeiou" for c in h) / max(1, len(h)), float("#" in url), math.log1p(seen), share,
    ]


@dataclass
class Trees:
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # features, thresholds, leaves; by level

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(int(math.log2(len(leaf)))):
                f = feature[node]
                node = 2 * node + 1 + (x[rows, f] > threshold[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


@dataclass
class Model:
    trees: Trees
    suffixes: DataFrame  # _suffix, _n, _bad: over all labelled urls
    mean: float  # share of labelled urls to be blocked

    def stats(self, df: DataFrame) -> DataFrame:
        """df (with host) and _seen, _share of the host's suffix."""
        x = df.withColumn("_suffix", F.substring_index("host", ".", -1)).join(self.suffixes, "_suffix", "left")
        n, bad = F.coalesce("_n", F.lit(0)), F.coalesce("_bad", F.lit(0))
        return x.withColumns({"_seen": n.cast("double"), "_share": (bad + 20 * self.mean) / (n + 20)}).drop("_suffix", "_n", "_bad")


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Newton boosting of complete binary trees on weighted rows; splits at quantiles of each feature."""
    share = min(max(float((y * weight).sum() / weight.sum()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
    out = Trees(math.log(share / (1 - share)), [])
    if len(y) == 0 or y.min() == y.max():
        out.base = -10.0 if len(y) == 0 or y.max() == 0 else 10.0
        return out
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    margin = np.full(len(y), out.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-9)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            best = np.zeros(many)
            local = node - first
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                cell = local * BINS + binned[:, j]
                gs = np.bincount(cell, g, many * BINS).reshape(many, BINS).cumsum(1)
                hs = np.bincount(cell, h, many * BINS).reshape(many, BINS).cumsum(1)
                ns = np.bincount(cell, minlength=many * BINS).reshape(many, BINS).cumsum(1)
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain = np.where((ns >= LEAF) & (nt - ns >= LEAF), gain, 0)[:, : len(e)]
                at = gain.argmax(1)
                better = gain[np.arange(many), at] > best + 1e-9
                best[better] = gain[np.arange(many), at][better]
                feature[first + np.flatnonzero(better)] = j
                threshold[first + np.flatnonzero(better)] = e[at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf_of, n = node - (2**depth - 1), 2**depth
        leaf = -rate * np.bincount(leaf_of, g, n) / (np.bincount(leaf_of, h, n) + 1)
        margin += leaf[leaf_of]
        out.trees.append((feature, threshold, leaf))
    return out


def fit(labelled: DataFrame, limit: int = TRAIN_ROWS) -> Model:
    """labelled: url, label (1: block). The sample is bounded by limit; equal urls count once."""
    both = labelled.where(F.col("url").isNotNull() & F.col("label").isin(0, 1)).groupBy("url").agg(F.max("label").alias("label"))
    both = cut(both.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}), "labelled")
    suffixes = cut(both.groupBy(F.substring_index("host", ".", -1).alias("_suffix")).agg(F.count("*").alias("_n"), F.sum("label").alias("_bad")), "suffixes")
    n, bad = suffixes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_bad"), F.lit(0))).first()
    model = Model(Trees(-10.0, []), suffixes, bad / max(1, n))
    # Both kinds are drawn alike, by hash, up to half of the limit each.
    sample = both.withColumn("_h", F.xxhash64("url"))
    half = [model.stats(sample.where(F.col("label") == k).orderBy("_h", "url").limit(limit // 2)).orderBy("_h", "url").collect() for k in (0, 1)]
    rows = [r for part in half for r in part]
    weight = np.repeat([(n - bad) / max(1, len(half[0])), bad / max(1, len(half[1]))], [len(part) for part in half])
    x = np.array([lexical(r["url"], r["host"], r["path"], r["_seen"], r["_share"]) for r in rows], float)
    model.trees = boost(x, np.array([float(r["label"]) for r in rows]), weight)
    return model


def judge(urls: DataFrame, model: Model, rules: tuple = RULES) -> DataFrame:
    """urls (with a column url) and host, path, rule, verdict and block_score."""
    text, said = rule(F.col("host"), F.col("path"), rules)
    x = urls.drop("block_score", "verdict", "_said").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}).withColumns({"rule": text, "_said": said})
    x, trees = model.stats(x.drop("_suffix", "_n", "_bad", "_seen", "_share")), model.trees
    names, schema = x.columns, ", ".join(f"`{c}` {t}" for c, t in x.dtypes)

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            parts = [b.column(c).to_pylist() for c in ("url", "host", "path", "_seen", "_share")]
            rows = [lexical(*r) if r[1] else None for r in zip(*parts, strict=True)]
            score = np.zeros(len(rows))
            if known := [i for i, r in enumerate(rows) if r]:
                score[known] = 1 / (1 + np.exp(-trees.margin(np.array([rows[i] for i in known], float))))
            return pa.record_batch([*(b.column(c) for c in names), pa.array(score)], [*names, "block_score"])

        return work

    scored = in_python(x, make, f"{schema}, block_score double", rows=8192)
    return scored.withColumn("verdict", F.coalesce("_said", F.when(F.col("block_score") > 0.5, "block").otherwise("allow"))).drop("_said", "_seen", "_share")


def seeded(pages: DataFrame) -> DataFrame:
    """Labels by seed, without the held-out quarter of urls."""
    h = host(F.col("url"))
    bad = F.lit(False)
    for name in SEED_BLOCK:
        bad = bad | h.contains(name)
    return pages.where(F.pmod(F.xxhash64(F.col("url"), F.lit(9)), F.lit(4)) != 2).select("url", bad.cast("int").alias("label"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, fit(seeded(pages))).select("page_id", "host", "path", "rule", "verdict", F.round("block_score", 6).alias("block_score"))
