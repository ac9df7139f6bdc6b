"""Operator 4, removal of repeated passages by recompression.

Texts are sequences of words. Rounds of recompression name runs (equal neighbours) and pairs (a
symbol of the left half of the alphabet before one of the right half), so each round shortens the
sequence by about a quarter. Names and halves are hashes of content, hence global: equal passages
get equal symbols wherever they stand, but for their ends. How far the ends reach is tracked exactly:
each symbol carries the span of words on which its making depended, neighbours that were consulted
included (a document's edge counts as outside). A symbol whose span lies inside a window of n words
appears in every equal window at the same place.

1. Copies of whole texts under a smaller doc_id are set aside: all their windows are repeats.
2. Every window picks its anchor: of the symbols certain in it, the longest, ties by hash. Anchors
   are shuffled by name; names with two occurrences or more are the shared high-level symbols.
3. Windows with a shared anchor (or none) are candidates. A window with an earlier twin always is
   one, so nothing is lost. They are verified by 96-bit hashes of all their n words: after a shuffle
   by hash, all but the first in order of (doc_id, start) are repeats.
4. Words covered by a repeat are removed.

Streams over sorted partitions find the runs of equal names, so no group is held in memory, however
often a passage occurs. A common name doesn't meet in one task either: of the rows that a slab of
documents has of it, the first alone is shuffled by name; the others are known to be shared, or to be
repeats, and go straight to their documents. No table of symbols is collected.

Edge cases: null text has no words; texts of fewer than n words are kept as they are; null doc_ids
sort first, each text under one as a document of its own, in order of a 48-bit hash; rows that share
doc_id and start don't precede each other, so repeated rows keep what their first occurrence keeps, at
a cost that grows with their number and no faster; very long texts are read whole; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.batches import in_python, ship
from folia.llm.common import cut, split_words, table
from folia.llm.shingles import WordHashes, constants, mix

WINDOW, ROUNDS, FROM = 20, 4, 2
_RUN, _TIMES, _LEFT, _RIGHT, _SIDE, _ROUND = constants(6, 40)


def of_round(level: int, factor: np.uint64) -> np.uint64:
    return np.uint64(level * int(factor) & (1 << 64) - 1)


class Slab:
    """Some texts as one array of hashed words, with the windows of each."""

    def __init__(self, texts: list[str | None], hashes: WordHashes, n: int):
        self.words = [split_words(t) for t in texts]
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.h = hashes.of([w for ws in self.words for w in ws])
        self.lo, self.hi = self.first[:-1][self.doc], self.first[1:][self.doc]
        at = np.arange(len(self.h))
        self.starts = at[at + n <= self.hi]  # of windows
        self.n = n

    def salt(self, doc: np.ndarray) -> np.ndarray:
        return mix(doc.astype(np.uint64) + _SIDE)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per word: the anchor of the window that starts there (0: none). And name and document of
        all symbols that may have been picked. The first level that counts stands in only where no
        symbol of a later one is certain."""
        n, rounds = self.n, list(enumerate(recompress(self.h, self.doc, ROUNDS), 1))
        best, names, docs = np.zeros(len(self.h), np.int64), [], []
        for level, (sym, doc, a, b, left, right) in [*rounds[FROM:], rounds[FROM - 1]]:
            low, high = np.maximum(right - n, self.lo[a]), np.minimum(left, self.hi[a] - n)
            some = low <= high
            if level == FROM:
                bare = np.concatenate(([0], np.cumsum(best == 0)))
                some[some] = bare[high[some] + 1] > bare[low[some]]
                held = best != 0
            low, high = low[some], high[some]
            key = (np.minimum(b - a, 31)[some] << 58) | (mix(sym[some] + of_round(level, _ROUND)) >> np.uint64(6)).astype(np.int64)
            names.append(key)
            docs.append(doc[some])
            into = np.zeros(len(self.h), np.int64) if level == FROM else best
            left_over = np.arange(len(key))
            for t in range(n):
                left_over = left_over[low[left_over] + t <= high[left_over]]
                if not len(left_over):
                    break
                np.maximum.at(into, low[left_over] + t, key[left_over])
            if level == FROM:
                best = np.where(held, best, into)
        return best, np.concatenate(names), np.concatenate(docs)

    def window_hashes(self, seed: int) -> np.ndarray:
        factors = constants(self.n, seed)
        out = np.zeros(len(self.starts), np.uint64)
        for i in range(self.n):
            out += self.h[self.starts + i] * factors[i]
        return mix(out)


def recompress(h: np.ndarray, doc: np.ndarray, rounds: int):
    """After each round: symbols, their documents, first word, end, and the span they depend on."""
    sym, a = h, np.arange(len(h))
    b, left, right, first, last = a + 1, a.copy(), a + 1, h, h
    for level in range(1, rounds + 1):
        if not len(sym):
            yield sym, doc, a, b, left, right
            continue
        salt, side = of_round(level, _ROUND), of_round(level, _SIDE)
        # Runs. A neighbour is known to differ by one word where the words that meet differ.
        same = (sym[1:] == sym[:-1]) & (doc[1:] == doc[:-1])
        i = np.flatnonzero(np.concatenate(([True], ~same)))
        j = np.concatenate((i[1:], [len(sym)]))
        times, before, after = j - i, np.maximum(i - 1, 0), np.minimum(j, len(sym) - 1)
        near = (i > 0) & (doc[before] == doc[i]) & (last[before] == last[i])
        l2 = np.minimum(np.minimum.reduceat(left, i), np.where(near, left[before], a[i] - 1))
        near = (j < len(sym)) & (doc[after] == doc[i]) & (first[after] == first[i])
        r2 = np.maximum(np.maximum.reduceat(right, i), np.where(near, right[after], b[j - 1] + 1))
        run = mix(sym[i] * _RUN + times.astype(np.uint64) * _TIMES + salt)
        sym, doc, a, b = np.where(times > 1, run, sym[i]), doc[i], a[i], b[j - 1]
        first, last, left, right = first[i], last[j - 1], l2, r2
        # Pairs. The left half asks the next symbol, the right half the one before.
        is_left = (mix(sym + side) & np.uint64(1)) == 0
        joined = doc[1:] == doc[:-1]
        l2, r2 = np.concatenate(([a[0] - 1], np.where(joined, left[:-1], a[1:] - 1))), np.concatenate((np.where(joined, right[1:], b[:-1] + 1), [b[-1] + 1]))
        left, right = np.where(is_left, left, np.minimum(left, l2)), np.where(is_left, np.maximum(right, r2), right)
        pair = np.concatenate((is_left[:-1] & ~is_left[1:] & joined, [False]))
        keep = np.concatenate(([True], ~pair[:-1]))
        nxt = np.minimum(np.arange(len(sym)) + 1, len(sym) - 1)
        named = mix(sym * _LEFT + sym[nxt] * _RIGHT + salt)
        sym = np.where(pair, named, sym)[keep]
        b, last = np.where(pair, b[nxt], b)[keep], np.where(pair, last[nxt], last)[keep]
        left, right = np.where(pair, np.minimum(left, left[nxt]), left)[keep], np.where(pair, np.maximum(right, right[nxt]), right)[keep]
        doc, a, first = doc[keep], a[keep], first[keep]
        yield sym, doc, a, b, left, right


def anchor_rows(docs: DataFrame, n: int) -> DataFrame:
    """(route, name, j, many): the anchors of each document; many: the name occurs twice for certain.
    Names are routed by themselves; of several documents of a slab with the same name the first
    alone, the others by document. Windows without an anchor count as an anchor 0 that always is shared."""

    def make():
        hashes = WordHashes()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = Slab(batch.column("text").to_pylist(), hashes, n)
            best, names, owners = s.anchors()
            own, at = np.unique(mix(best[s.starts].view(np.uint64)) ^ s.salt(s.doc[s.starts]), return_index=True)
            at = s.starts[at]
            all_of, times = np.unique(mix(names.view(np.uint64)) ^ s.salt(owners), return_counts=True)
            place = np.minimum(np.searchsorted(all_of, own), max(0, len(all_of) - 1))
            name, j = best[at], batch.column("j").to_numpy()[s.doc[at]]
            many = (name == 0) | (times[place] > 1) if len(all_of) else name == 0
            order = np.lexsort((j, name))
            name, j, many = name[order], j[order], many[order]
            head = np.concatenate(([True], name[1:] != name[:-1])) if len(name) else np.zeros(0, bool)
            again = head | np.concatenate((j[1:] != j[:-1], [True])) if len(name) else head
            first = np.flatnonzero(head)
            shared = np.add.reduceat(again.astype(np.int64), first) > 1 if len(first) else np.zeros(0, bool)
            many |= shared[np.cumsum(head) - 1] if len(name) else many
            route = np.where(head & (name != 0), name, mix(j.view(np.uint64)).view(np.int64))
            return pa.record_batch([pa.array(c) for c in (route, name, j, many)], ["route", "name", "j", "many"])

        return work

    return in_python(docs, make, "route bigint, name bigint, j bigint, many boolean", rows=256)


def shared_names(anchors: DataFrame) -> DataFrame:
    """(j, names): each document's anchors that occur twice or more. Sorted streams; one row waits.
    Two documents' numbers or routes that agree by chance make more candidates, never fewer."""

    def run(batches):
        held = None  # the last row and whether its twin came before it
        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("route", "name", "j", "many")]
            if held:
                cols = [np.append(h, c) for h, c in zip(held, cols, strict=True)]
            route, name, j, many = cols
            if not len(route):
                continue
            same = route[1:] == route[:-1]
            many = many.astype(bool)
            many[1:] |= same
            many[:-1] |= same
            held = tuple(c[-1] for c in (route, name, j, many))
            repeated = same & (name[1:] == name[:-1]) & (j[1:] == j[:-1])
            out = np.flatnonzero(many[:-1] & ~repeated)
            yield pa.record_batch([pa.array(j[out]), pa.array(name[out])], ["j", "name"])
        if held and held[3]:
            yield pa.record_batch([pa.array([held[2]], pa.int64()), pa.array([held[1]], pa.int64())], ["j", "name"])

    ship(anchors.sparkSession)
    dealt = anchors.repartition("route").sortWithinPartitions("route", "name", "j")
    return dealt.mapInArrow(run, "j bigint, name bigint").groupBy("j").agg(F.collect_list("name").alias("names"))


def later_twins(h1: np.ndarray, h2: np.ndarray, k: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which windows have a twin among these that starts earlier."""
    out = np.zeros(len(h1), bool)
    order = np.argsort(h1)
    same = h1[order][1:] == h1[order][:-1]
    some = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(h1) else order
    if len(some):
        some = some[np.lexsort((place[some], k[some], h2[some], h1[some]))]
        a, b = h1[some], h2[some]
        head = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        first = some[head][np.cumsum(head) - 1]
        out[some] = (k[some] != k[first]) | (place[some] != place[first])
    return out


def candidates(docs: DataFrame, shared: DataFrame, n: int) -> DataFrame:
    """(h1, h2, k, place, known): windows that may have a twin. h2: 32 more bits of hash before 32 of
    the text's; place: start; known: an earlier twin was found in the slab (h1 then is the route)."""

    def make():
        hashes = WordHashes()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column("names").to_pylist()
            s = Slab([t if x else None for t, x in zip(batch.column("text").to_pylist(), lists, strict=True)], hashes, n)
            best = s.anchors()[0][s.starts]
            doc = s.doc[s.starts]
            shown = [mix(np.array(x, np.int64).view(np.uint64)) ^ s.salt(np.array([i])) for i, x in enumerate(lists) if x]
            mine = mix(best.view(np.uint64)) ^ s.salt(doc)
            s.starts = s.starts[np.isin(mine, np.concatenate(shown) if shown else np.zeros(0, np.uint64))]
            doc = s.doc[s.starts]
            h1, high = s.window_hashes(41).view(np.int64), s.window_hashes(42) & np.uint64(0xFFFFFFFF00000000)
            k, t, place = batch.column("k").to_numpy()[doc], batch.column("t").to_numpy()[doc], (s.starts - s.first[doc]).astype(np.int32)
            known = later_twins(h1, high, k, place)
            route = np.where(known, mix((k ^ t).view(np.uint64)).view(np.int64), h1)
            return pa.record_batch([pa.array(c) for c in (route, high.view(np.int64) | t, k, place, known)], ["h1", "h2", "k", "place", "known"])

        return work

    # All columns, as in removed(): both joins then share one shuffle of the texts.
    joined = docs.join(shared, "j").select(*docs.columns, "names")
    return in_python(joined, make, "h1 bigint, h2 bigint, k bigint, place int, known boolean", rows=256)


def repeats(windows: DataFrame) -> DataFrame:
    """(j, places): each document's windows that start earlier elsewhere."""

    def run(batches):
        lead = last = None  # the first and the last row of the current run
        for b in batches:
            if not b.num_rows:
                continue
            h1, h2, k, place = rows = [b.column(c).to_numpy() for c in ("h1", "h2", "k", "place")]
            known = b.column("known").to_numpy(zero_copy_only=False)
            before = [np.concatenate(([x], c[:-1])) for x, c in zip(last or (c[0] for c in rows), rows, strict=True)]
            repeated = np.logical_and.reduce([x == c for x, c in zip(before, rows, strict=True)])
            repeated[0] &= last is not None
            last = [c[-1] for c in rows]
            if lead:
                h1, h2, k, place = (np.append(x, c) for x, c in zip(lead, rows, strict=True))
            high = h2 >> 32
            new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (high[1:] != high[:-1])))
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (k != k[head]) | (place != place[head])
            lead = tuple(x[head[-1]] for x in (h1, h2, k, place))
            out = np.flatnonzero((later[len(k) - b.num_rows :] | known) & ~repeated)
            yield pa.record_batch([pa.array(rows[2][out]), pa.array(rows[1][out] & 0xFFFFFFFF), pa.array(rows[3][out])], ["k", "t", "place"])

    ship(windows.sparkSession)
    dealt = windows.repartition("h1").sortWithinPartitions("h1", F.shiftright("h2", 32), "k", "place", "h2")
    found = dealt.mapInArrow(run, "k bigint, t bigint, place int")
    return found.groupBy(F.xxhash64("k", "t").alias("j")).agg(F.collect_list("place").alias("places"))


def copies(docs: DataFrame) -> DataFrame:
    """(j): documents of which the whole text stands under a smaller doc_id. Narrow rows alone."""
    x = docs.where("text IS NOT NULL").select("j", "k", F.md5(F.encode("text", "UTF-8")).alias("m"))
    first = x.groupBy("m").agg(F.min("k").alias("first"), F.count("*").alias("c")).where("c > 1").select("m", "first")
    return x.join(first, "m").where("k > first").select("j").distinct()


def removed(docs: DataFrame, found: DataFrame, whole: DataFrame, n: int, carry: tuple[str, ...] = (), original: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): texts without the words that a repeat covers; of a copy
    (whole), which has a repeat at every place, none stays if it has n words or more."""
    kinds = dict(docs.dtypes)
    extra = [*carry, *(["text"] if original else [])]
    names = ["doc_id", "n_words", "n_removed", "kept", *carry, *(["original"] if original else [])]

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            size, gone, kept = [], [], []
            for t, places, copy in zip(*(batch.column(c).to_pylist() for c in ("text", "places", "copy")), strict=True):
                words, out = split_words(t), None
                size.append(len(words))
                if copy and len(words) >= n:
                    gone.append(len(words))
                    kept.append("")
                    continue
                if places:
                    starts = np.array(places, np.int64)
                    edge = np.zeros(len(words) + n + 1, np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + n, -1)
                    out = np.cumsum(edge)[: len(words)] > 0
                gone.append(int(out.sum()) if out is not None else 0)
                kept.append(" ".join(words if out is None else [words[i] for i in np.flatnonzero(~out)]))
            cols = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]
            return pa.record_batch([*cols, *(batch.column(c) for c in extra)], names)

        return work

    joined = docs.join(found, "j", "left").join(whole.withColumn("copy", F.lit(True)), "j", "left").select(*docs.columns, "places", "copy")
    kept = [f"`{c}` {kinds[c]}" for c in carry] + (["original string"] if original else [])
    return in_python(joined, make, ", ".join(["doc_id bigint, n_words bigint, n_removed bigint, kept string", *kept]), rows=256)


def substring_dedup(docs: DataFrame, n: int = WINDOW, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = (), original: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of docs; also the columns to carry along
    and, if asked for, the original text."""
    tag = F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))
    unkeyed = F.xxhash64(F.lit(1), F.col(text)).bitwiseAND(F.lit((1 << 48) - 1)) + F.lit(-(2**63))
    k = F.coalesce(F.col(key).cast("long"), unkeyed)
    docs = docs.select(F.xxhash64(k, tag).alias("j"), k.alias("k"), tag.alias("t"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *carry)
    # A copy's windows all start earlier elsewhere, so it is nobody's first occurrence.
    whole = cut(copies(docs), "copies")
    shared = shared_names(anchor_rows(docs.select("j", "text").join(whole, "j", "left_anti"), n))
    return removed(docs, repeats(candidates(docs, shared, n)), whole, n, carry, original)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, s - 1 AS s, md5(array_to_string(list_slice(w, s, s + 19), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM words WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS r FROM windows) WHERE r > 1
), gone AS (
  SELECT doc_id, list(DISTINCT s + i) AS g FROM (SELECT doc_id, s, unnest(range(0, 20)) AS i FROM later) GROUP BY doc_id
), kept AS (
  SELECT words.doc_id, w, coalesce(g, []) AS g FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id
), rest AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(g) AS BIGINT) AS n_removed,
         list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(g, i - 1)) AS k, w FROM kept
)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(list_transform(k, lambda i: w[i]), ' '), '')) AS kept_sha256 FROM rest
"""
