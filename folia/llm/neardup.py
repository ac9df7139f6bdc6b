"""Operator 5, n-gram Jaccard join by MinHash banding.

Documents are sets of hashed windows of five words (64 bits). Bands and rows follow from the target
recall at the similarity. Equal sets collapse to one node before anything is joined, so a group of
copies costs one row; a set is known by its 128-bit name, never by a key, which several texts may
share. Nodes that share a band meet by that band's hash: the shuffle carries ids alone, and each joins
its bucket's lowest node, never all others. The connected candidates are then verified in full, as
whole n-gram sets, in tasks' worths of bounded size:

* a component of at most BLOCK nodes is read once;
* a larger one is dealt out as pairs of blocks, or bucket by bucket where that ships fewer rows (long
  chains of small buckets); there a pair counts in the first bucket that it shares.

Links are counted and united inside the task, as matrix products of presence rows; pairs are never
emitted. Nothing is capped.

Result, one row per row of docs: key, class_id (lowest key that links lead to), representative
(lowest key with the same set), n_links (other rows at the similarity or above, copies included).

Edge cases: a text of one to four words is one window of all its words, so it links with equal ones
only; null text, or one without words, is a class of its own with no links; a null key sorts after
all others, so a class of null keys alone has a null class_id; several texts under one key are
documents of their own, each in its own class; repeated rows count as copies of each other; very long
texts are whole sets; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folia.llm.batches import in_python, ship
from folia.llm.common import cut, drop, lookup, split_words, table
from folia.llm.shingles import MinHash, WordHashes, bands_for, constants, windows

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9999
#: Documents of one block; window hashes of one strip of the presence matrix.
BLOCK, STRIP = 256, 4096
#: Rows of a broadcast at most.
BROADCAST = 1 << 20


def shingles(words: list[str], hashes: WordHashes, n: int, factors: np.ndarray) -> np.ndarray:
    """The set of windows, sorted; one window of all words if there are fewer than n."""
    h = hashes.of(words)
    return np.unique(windows(h, min(n, len(h)), factors)) if len(h) else h


def identified(docs: DataFrame, text: str, key: str) -> DataFrame:
    """docs with i1, i2: 128 bits of key and text together, which tell rows apart that differ in either."""
    both = [F.col(key).cast("long"), F.col(text)]
    return docs.withColumns({"i1": F.xxhash64(F.lit(1), *both), "i2": F.xxhash64(F.lit(2), *both)})


def signatures(docs: DataFrame, n: int, similarity: float, recall: float, text: str, key: str) -> DataFrame:
    """(key, i1, i2, s1, s2, size, bands): the row, a 128-bit name of its set, the set's size and band hashes."""

    def make():
        hashes, factors, name, hasher = WordHashes(), constants(n, 0), constants(1, 9), MinHash(*bands_for(similarity, recall))

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(split_words(t), hashes, n, factors) for t in b.column(3).to_pylist()]
            s1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            s2 = np.array([np.bitwise_xor.reduce((s ^ (s >> np.uint64(29))) * name) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            bands = [hasher.bands_of(s).view(np.int64) if len(s) else None for s in sets]
            cols = [pa.array(s1), pa.array(s2), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            return pa.record_batch([b.column(0), b.column(1), b.column(2), *cols], [key, "i1", "i2", "s1", "s2", "size", "bands"])

        return work

    return in_python(docs.select(key, "i1", "i2", text), make, f"`{key}` bigint, i1 bigint, i2 bigint, s1 bigint, s2 bigint, size bigint, bands array<bigint>", rows=256)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, comp): the lowest node of each connected component of edges (a, b). Each round every
    node takes its lowest neighbour, chains are shortened, and the edges contract; a round's result
    is a written table, that of the round before is deleted. Only counts reach the driver."""
    left = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    known = None
    while left.limit(1).count():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        step = cut(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("comp")), name)
        while True:  # comp of comp, until nothing moves
            up = step.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
            next_ = cut(step.join(up, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"), (F.col("top") != F.col("comp")).alias("moved")), name)
            moved = next_.where("moved").limit(1).count()
            drop(step)
            step = next_
            if not moved:
                break
        a, b = (step.select(F.col("node").alias(c), F.col("comp").alias(f"_{c}")) for c in "ab")
        rest = cut(left.join(a, "a").join(b, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).where("a <> b").distinct(), name)
        drop(left)
        left = rest
        if known is None:
            known = step
        else:
            up = step.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
            longer = cut(known.join(up, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), name)
            drop(known, step)
            known = longer
    return known.select("node", "comp") if known is not None else left.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Which of sets[left] x sets[right] reach the similarity: presence matrices, strip by strip."""
    sizes = np.array([len(s) for s in sets], np.int64)
    vocabulary, where = np.unique(np.concatenate(sets), return_inverse=True)
    counts = np.bincount(where, minlength=len(vocabulary))
    doc = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[where] > 1  # a window of one document alone is shared with none
    number = np.cumsum(counts > 1) - 1
    doc, where = doc[shared], number[where[shared]]
    order = np.argsort(where, kind="stable")
    doc, where = doc[order], where[order]
    total = int(counts[counts > 1].size)
    common = np.zeros((len(left), len(right)), np.float32)
    for i in range(0, total, STRIP):
        a, b = np.searchsorted(where, [i, i + STRIP])
        present = np.zeros((len(sets), min(STRIP, total - i)), np.float32)
        present[doc[a:b], where[a:b] - i] = 1
        common += present[left] @ present[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    return common >= similarity * union - 1e-6 * union


def verify(members: DataFrame, n: int, similarity: float, text: str) -> DataFrame:
    """members: (node, copies, group, bucket, i, j, block, bands, text), rows of a block pair together
    and in order. Returns (node, links, root): links to the rows of the other block (each copy counts)
    and one verified neighbour that leads to the lowest node of the part. In a bucket (whose band hash
    is the group) a pair counts if no earlier band is shared."""

    def run(batches):
        hashes, factors = WordHashes(), constants(n, 0)
        held, at = [], None

        def done():
            node = np.array([r[0] for r in held], np.int64)
            copies, block = np.array([r[1] for r in held], np.int64), np.array([r[2] for r in held], np.int64)
            sets, (group, bucket, i, j) = [r[4] for r in held], at
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            near = linked(sets, left, right, similarity)
            if bucket:
                bands = np.array([r[3] for r in held], np.int64)
                for t in range(int(np.flatnonzero(bands[0] == group)[0])):
                    near &= bands[left, t][:, None] != bands[right, t][None, :]
            if i == j:
                near[np.arange(len(left)), np.arange(len(left))] = False
            links = np.zeros(len(node), np.int64)
            links[left] += near @ copies[right]
            if i != j:
                links[right] += near.T @ copies[left]
            order = np.argsort(node, kind="stable")
            rank = np.empty(len(node), np.int64)
            rank[order] = np.arange(len(node))
            low = rank.copy()
            while True:  # the lowest rank spreads along links
                new = low.copy()
                reach = np.where(near, low[right][None, :], len(node))
                new[left] = np.minimum(new[left], reach.min(1, initial=len(node)))
                reach = np.where(near, new[left][:, None], len(node))
                new[right] = np.minimum(new[right], reach.min(0, initial=len(node)))
                if (new == low).all():
                    break
                low = new
            return pa.record_batch([pa.array(node), pa.array(links), pa.array(node[order[low]])], ["node", "links", "root"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("group", "bucket", "i", "j", "node", "copies", "block", "bands", text)]
            for group, bucket, i, j, node, copies, block, bands, t in zip(*cols, strict=True):
                if (group, bucket, i, j) != at:
                    if held:
                        yield done()
                    held, at = [], (group, bucket, i, j)
                held.append((node, copies, block, bands, shingles(split_words(t), hashes, n, factors)))
        if held:
            yield done()

    ship(members.sparkSession)
    return members.mapInArrow(run, "node bigint, links bigint, root bigint")


def dealt(same: DataFrame, candidates: DataFrame, block: int) -> DataFrame:
    """(node, group, bucket, blocks): the groups in which each candidate is verified. A component is
    one group; if it has more than one block's nodes and its buckets would ship fewer rows than its
    pairs of blocks, its buckets of two nodes or more are. same: (node, bands, ...)."""
    sized = cut(candidates.groupBy("comp").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "sized")

    def in_buckets(which: DataFrame) -> DataFrame:
        """(node, comp, band) of the components."""
        nodes = lookup(candidates, which.select("comp"), "comp", "large")
        return nodes.join(same.select("node", "bands"), "node").select("node", "comp", F.explode("bands").alias("band"))

    sum_up = lambda x: x.groupBy("comp", "band").agg(F.count("*").alias("c")).where("c > 1")
    shipped = sum_up(in_buckets(sized.where("blocks > 1"))).groupBy("comp").agg(F.sum(F.col("c") * F.ceil(F.col("c") / block)).alias("rows"))
    split = sized.join(shipped, "comp", "left").select("comp", "blocks", F.coalesce(F.col("rows") < F.col("n") * F.col("blocks"), F.lit(False)).alias("split"))
    whole = lookup(candidates, split.where("NOT split"), "comp", "whole").select("node", F.col("comp").alias("group"), F.lit(False).alias("bucket"), "blocks")
    parts = in_buckets(split.where("split"))
    parts = parts.join(sum_up(parts), ["comp", "band"]).select("node", F.col("band").alias("group"), F.lit(True).alias("bucket"), F.ceil(F.col("c") / block).cast("int").alias("blocks"))
    return whole.unionByName(parts)


def classes(docs: DataFrame, words: int, similarity: float, recall: float, block: int, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows, sets). rows: (key, i1, i2, s1, s2, size) of all rows of docs. sets: (s1, s2, size, low,
    pick, n_links, class_id, lead): the lowest key and row (pick) with the set, those of its class
    (class_id, lead)."""
    docs = identified(docs.select(F.col(key).cast("long").alias(key), text), text, key)
    rows = cut(signatures(docs, words, similarity, recall, text, key), "signatures")
    pick = F.min(F.struct(F.col(key).isNull().alias("none"), key, "i1", "i2"))
    same = rows.where("size > 0").groupBy("s1", "s2", "size").agg(pick.alias("pick"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"))
    same = cut(same.withColumn("node", F.monotonically_increasing_id()), "sets")
    bands = cut(same.select("node", F.explode("bands").alias("band")), "bands")
    buckets = bands.groupBy("band").agg(F.min("node").alias("b"), F.count("*").alias("c")).where("c > 1").select("band", "b")
    candidates = components(bands.join(buckets, "band").select(F.col("node").alias("a"), "b"), "candidates")
    groups = cut(dealt(same, candidates, block), "groups")
    drop(bands)
    # Each text once per block pair of its group: once for a group of one block.
    found = groups.select("node").distinct().join(same, "node").select("node", "copies", "bands", F.col("pick.i1").alias("i1"), F.col("pick.i2").alias("i2"))
    found = cut(found, "members")
    rest = docs.select("i1", "i2", text)
    if found.count() <= BROADCAST:
        rest = rest.join(F.broadcast(found.select("i1")), "i1", "left_semi")
    texts = rest.join(found, ["i1", "i2"]).dropDuplicates(["node"]).drop("i1", "i2")
    pairs = texts.join(groups, "node").withColumn("block", F.pmod(F.xxhash64("node", "group"), F.col("blocks")).cast("int"))
    pairs = pairs.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("node", "copies", "group", "bucket", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", F.when(F.col("bucket"), F.col("bands")).alias("bands"), text)
    in_order = pairs.repartition("group", "bucket", "i", "j").sortWithinPartitions("group", "bucket", "i", "j", "node")
    checked = cut(verify(in_order, words, similarity, text), "checked")
    drop(found)
    links = checked.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.count("*").alias("parts"))
    # Groups of one part are settled; roots of several parts are united.
    several = checked.join(links.where("parts > 1").select("node"), "node", "left_semi")
    united = components(several.select(F.col("node").alias("a"), F.col("root").alias("b")), "united")
    top = united.select(F.col("node").alias("root"), F.col("comp").alias("top"))
    settled = links.join(united, "node", "left").select("node", "links", F.coalesce("comp", "root").alias("root")).join(top, "root", "left")
    settled = settled.select("node", "links", F.coalesce("top", "root").alias("class"))
    sets = same.drop("bands").join(settled, "node", "left").withColumn("class", F.coalesce("class", "node"))
    lead = sets.groupBy("class").agg(F.min("pick").alias("lead"))
    sets = sets.join(lead, "class").select("s1", "s2", "size", F.col(f"pick.{key}").alias("low"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col(f"lead.{key}").alias("class_id"), "pick", "lead")
    return rows.drop("bands"), sets


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK, text: str = "text", key: str = "doc_id") -> DataFrame:
    rows, sets = classes(docs, words, similarity, recall, block, text, key)
    out = rows.where("size > 0").join(sets, ["s1", "s2", "size"]).select(key, "class_id", F.col("low").alias("representative"), "n_links")
    alone = rows.where("size = 0").select(key, F.col(key).alias("class_id"), F.col(key).alias("representative"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def first_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs, unchanged: of each class the one with the lowest key (of several rows with
    that key the one with the lowest hash of its text, of equal ones the lowest in the other columns);
    all texts without words stay."""
    rows, sets = classes(docs, words, similarity, recall, block, text, key)
    stay = sets.select("lead").where("pick = lead").select("lead.i1", "lead.i2")
    stay = stay.withColumn("alone", F.lit(False)).union(rows.where("size = 0").select("i1", "i2", F.lit(True)).distinct())
    packed = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.struct("*").alias("doc"))
    first = F.row_number().over(W.partitionBy("i1", "i2").orderBy(*[F.col("doc")[c] for c in docs.columns if c not in (text, key)] or ["k"])) == 1
    kept = identified(packed, "t", "k").join(stay, ["i1", "i2"]).withColumn("first", first)
    return kept.where("first OR alone").select("doc.*")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, s, s + 4), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM words WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n, md5(string_agg(h, ',' ORDER BY h)) AS sig FROM sh GROUP BY doc_id),
first AS (SELECT sig, min(doc_id) AS representative FROM n GROUP BY sig),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.h = b.h WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b AS node, reach.root FROM reach JOIN l ON l.a = reach.node),
cls AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node),
links AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT documents.doc_id, class_id, coalesce(representative, documents.doc_id) AS representative, coalesce(n_links, 0) AS n_links
FROM documents JOIN cls ON documents.doc_id = node LEFT JOIN links ON documents.doc_id = a LEFT JOIN n ON documents.doc_id = n.doc_id LEFT JOIN first ON n.sig = first.sig
"""
