"""Operator 1, bulk-synchronous best-fit packing of token sequences.

Pieces are range-sorted by length and numbered in it, so a class of pieces is a length and a run of
ranks, and a class of gaps (the free space of open sequences) a size and a run of sequence ids.
Lengths are integers up to the capacity, so a round's state is bounded by the capacity, however many
pieces there are. Rounds go through bands of lengths, the longest first; lengths of a band differ by a
small factor. A round is a Spark job over the band's pieces and the gaps that could hold them:

1. both are range-sorted by size; every range sweeps its own part in parallel: pieces, the longest
   first, meet their successor, the tightest gap that holds them;
2. conflicts are resolved by rank: the i-th piece of a class takes the i-th place in the gap's run,
   pieces beyond its end go on to the next gap;
3. pieces without a gap in their range and gaps without a piece meet in one more sweep, the leftover
   of all ranges, which opens as many sequences as the pieces need that no gap holds;
4. gaps shrink, and the next round starts with them.

The rounds yield a table of flows (length, first rank, first sequence, offset, pieces a sequence) of at
most FLOWS rows, which is checked; executors place every piece by its rank in it.

Ranks come from row numbers inside (length, salt) plus the counts of smaller salts; a length has a
salt for every RUN pieces, so one that a third of all pieces share is numbered by many tasks.

Edge cases: null text is an empty document, one piece with the terminating id; longer documents are
cut into pieces of the capacity, the last may be shorter; a special token's string in a text is that
token, as in the library; repeated rows are packed each; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from contextlib import contextmanager
from functools import cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from tokenizers import Tokenizer

from folia.llm.batches import in_python, ship
from folia.llm.common import cut, table

VOCABULARY, CAPACITY, END = "word_bpe_49k.json", 2048, 0
#: Remembered words, and chunks, per task at most; their length.
WORDS, LONG = 1 << 19, 64
#: Pieces that one task numbers; rows of a round that one range sweeps; flows at most.
RUN, RANGE, FLOWS = 1 << 20, 256, 1 << 20

# Characters that str.split() takes for white space and the vocabulary doesn't.
NO_SPACE = re.compile("[\x1c-\x1f]")
BLANKS = re.compile(r"[ \n]+")
# The vocabulary's own splitting, for texts of Latin letters (up to U+024F, without U+0130, whose
# lower case has two characters), lower-cased before: these need no normalisation.
_N = r"\d\xb2\xb3\xb9\xbc-\xbe"
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W{_N}_]+|[{_N}]|\n|(?:[^\w\t-\r \x85\xa0]|_)+")
# Stands between chunks; ids are below 2^16, so it is in no run of their bytes.
BREAK = b"\xff" * 4


def byte_signs() -> dict[int, int]:
    """The sign that byte-level vocabularies write for each byte: printable ones for themselves, the
    others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*plain}))}


@cache
def load(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class Words:
    """Ids of texts. Those of chunks between blanks, and of the words in them, are remembered, up to
    a bound; unknown chunks are split many at a time, as one text. One for each task: a worker that
    waits between tasks keeps the tokenizer alone."""

    def __init__(self, path: str):
        self.model = load(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.signs = byte_signs()

    def ids(self, text: str) -> bytes:
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[str | None], many: int = 1 << 20) -> list[bytes]:
        """Little-endian unsigned 32-bit ids. Chunks are encoded apart: nothing in this vocabulary
        crosses a space or line break. Special tokens do, so a text with one goes to the library whole."""
        out: list[bytes] = []
        parts: list[list[str] | None] = []
        size = 0
        for text in texts:
            if text and any(s in text for s in self.special):
                parts.append(None)
            elif not text:
                parts.append([])
            else:
                parts.append(text.split() if text.isascii() and not NO_SPACE.search(text) else [p for p in BLANKS.split(text) if p])
            size += len(text or "")
            if size > many:
                out += self.joined(texts[len(out) :], parts)
                parts, size = [], 0
        return out + self.joined(texts[len(out) :], parts)

    def joined(self, texts: list[str | None], parts: list[list[str] | None]) -> list[bytes]:
        whole = lambda t: np.array(self.model.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        with self.known(self.chunks, {c for p in parts if p for c in p}, self.in_words) as found:
            return [whole(t) if p is None else b"".join(map(found.__getitem__, p)) for t, p in zip(texts, parts, strict=False)]

    @staticmethod
    @contextmanager
    def known(memory: dict[str, bytes], wanted: set[str], make):
        """A mapping that has all that is wanted: the memory, which forgets long ones afterwards."""
        new = list(wanted.difference(memory))
        if len(memory) + len(new) > WORDS:
            memory.clear()
            new = list(wanted)
        memory.update(zip(new, make(new), strict=True))
        yield memory
        if len(memory) > WORDS:
            memory.clear()
        for w in [w for w in new if len(w) > LONG]:
            memory.pop(w, None)

    def in_words(self, chunks: list[str]) -> list[bytes]:
        if not chunks:
            return []
        text = "\n".join(chunks)
        if not text.isascii() and (max(text) > "ɏ" or "İ" in text):  # the library itself for other scripts
            plain = [c.isascii() or (max(c) <= "ɏ" and "İ" not in c) for c in chunks]
            other = iter(self.model.encode_batch_fast([c for c, p in zip(chunks, plain, strict=True) if not p], add_special_tokens=False))
            own = iter(self.in_words([c for c, p in zip(chunks, plain, strict=True) if p]))
            return [next(own) if p else np.array(next(other).ids, "<u4").tobytes() for p in plain]
        words = SPLIT.findall(text.lower())
        with self.known(self.words, {*words}, self.encode) as found:
            return b"".join(map(found.__getitem__, words)).split(BREAK)

    def encode(self, words: list[str]) -> list[bytes]:
        """Of words, as SPLIT has them; that pattern and lower case are all that precedes the merges."""
        signs, merge = self.signs, self.model.model.tokenize
        spelt = (w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(signs) for w in words)
        return [BREAK if w == "\n" else b"".join([t.id.to_bytes(4, "little") for t in merge(s)]) for w, s in zip(words, spelt, strict=True)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids): each document's ids and END, cut at the capacity."""
    kind = docs.schema[key].dataType.simpleString()

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model, end = Words(path), np.array([END], "<u4").tobytes()

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            row, piece, start, ids = [], [], [], []
            for r, x in enumerate(model.ids_of(b.column(1).to_pylist())):
                x += end
                for i, at in enumerate(range(0, len(x), 4 * capacity)):
                    row.append(r)
                    piece.append(i)
                    start.append(at // 4)
                    ids.append(x[at : at + 4 * capacity])
            cols = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            return pa.record_batch([b.column(0).take(pa.array(row, pa.int64())), *cols], [key, "piece", "start", "length", "ids"])

        return work

    return in_python(docs.select(key, text), make, f"`{key}` {kind}, piece int, start bigint, length bigint, ids binary")


def best_fit(pieces: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], capacity: int, opened: int | None) -> tuple[list, list, list, int | None]:
    """One sweep. pieces: (length, first rank, how many); gaps: (size, first sequence, how many). Longest
    pieces first, each takes the tightest gap, and so do those of the same length that still fit beside
    it. What no gap holds opens sequences from `opened` on, or is left over if that is None.
    Returns flows (length, first rank, first sequence, offset, pieces a sequence), pieces left, gaps."""
    sizes: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    flows, left_over = [], []

    def put(size: int, first: int, many: int) -> None:
        if size and many:
            if size not in runs:
                insort(sizes, size)
                runs[size] = []
            runs[size].append((first, many))

    for gap in sorted(gaps, reverse=True):
        put(*gap)
    for length, rank, left in sorted(pieces, key=lambda p: (-p[0], p[1])):
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                size = sizes[at]
                first, many = runs[size].pop()
                if not runs[size]:
                    del runs[size], sizes[at]
            elif opened is None:
                left_over.append((length, rank, left))
                break
            else:
                size, first, many = capacity, opened, -(-left // (capacity // length))
                opened += many
            each = size // length
            used = min(many, -(-left // each))
            placed = min(left, used * each)
            flows.append((length, rank, first, capacity - size, each))
            in_last = placed - (used - 1) * each
            put(size, first + used, many - used)
            put(size - each * length, first, used - 1)
            put(size - in_last * length, first + used - 1, 1)
            rank, left = rank + placed, left - placed
    return flows, left_over, [(size, *run) for size in sizes for run in runs[size]], opened


ROW = pa.schema([("kind", pa.int32()), ("size", pa.int64()), ("first", pa.int64()), ("many", pa.int64()), ("offset", pa.int64()), ("each", pa.int64())])
_PIECE, _GAP, _FLOW, _OPENED = range(4)


def _rows(kind: int, rows: list) -> list[tuple]:
    return [(kind, *r, *(0,) * (5 - len(r))) for r in rows]


def _sweep(batches, capacity: int, opened: int | None):
    """A partition of ROWs through one sweep."""
    rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    if not rows:
        return
    pieces, gaps = ([r[1:4] for r in rows if r[0] == k] for k in (_PIECE, _GAP))
    flows, left, gaps, opened = best_fit(pieces, gaps, capacity, opened)
    out = [r for r in rows if r[0] == _FLOW] + _rows(_PIECE, left) + _rows(_GAP, gaps) + _rows(_FLOW, flows)
    out += _rows(_OPENED, [(opened,)]) if opened is not None else []
    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), ROW, strict=True)], schema=ROW)


def bands(capacity: int) -> list[int]:
    """Bounds of the rounds' bands of lengths, descending: at most k pieces of the k-th fit together,
    from the eighth on lengths differ by less than half."""
    out = [capacity // k for k in range(1, 9)]
    while out[-1] > 0:
        out.append(out[-1] * 2 // 3)
    return sorted(set(out), reverse=True)


def flows(spark: SparkSession, counts: np.ndarray) -> np.ndarray:
    """The rounds. counts[n]: pieces of length n; len(counts) - 1: the capacity. Rows (length, first rank,
    first sequence, offset, pieces a sequence), ordered by length and rank."""
    ship(spark)
    capacity, opened, found = len(counts) - 1, 0, []
    gaps: list[tuple[int, int, int]] = []
    for high, low in zip(bands(capacity), [*bands(capacity)[1:], 0], strict=True):
        pieces = [(n, 0, int(counts[n])) for n in range(high, low, -1) if counts[n]]
        if not pieces:
            continue
        least = pieces[-1][0]
        state = _rows(_PIECE, pieces) + _rows(_GAP, [g for g in gaps if g[0] >= least])
        df = spark.createDataFrame(pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*state, strict=True), ROW, strict=True)], schema=ROW))
        schema = df.schema
        if len(state) > RANGE:  # below, one range holds all
            df = df.repartitionByRange(min(8, len(state) // RANGE + 1), "size").mapInArrow(partial(_sweep, capacity=capacity, opened=None), schema)
        done = [tuple(r) for r in df.repartition(1).mapInArrow(partial(_sweep, capacity=capacity, opened=opened), schema).collect()]
        shortest = next((n for n in range(1, capacity + 1) if counts[n]), 1)
        gaps = [g for g in gaps if g[0] < least] + [r[1:4] for r in done if r[0] == _GAP and r[1] >= shortest]
        found += [r[1:] for r in done if r[0] == _FLOW]
        opened = next(r[1] for r in done if r[0] == _OPENED)
        if len(found) > FLOWS:
            raise ValueError(f"more than {FLOWS} flows at capacity {capacity}")
    return np.array(sorted(found), np.int64).reshape(-1, 5)


def pack(items: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """items (with a column length, 1 to the capacity) and their sequence_id and offset."""
    spark = items.sparkSession
    items = items.drop("sequence_id", "offset")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in items.groupBy("length").agg(F.count("*")).collect():  # at most capacity rows
        counts[length] = n
    many = F.get(F.array(*[F.lit(int(1 + n // RUN)) for n in counts]), F.col("length").cast("int"))
    salts = many if counts.max() > RUN else F.lit(1)
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*order), salts).cast("int"))
    by_length = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    before = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).select("length", "_salt", F.coalesce(F.sum("_n").over(by_length), F.lit(0)).alias("_before"))
    in_salt = F.row_number().over(W.partitionBy("length", "_salt").orderBy(*order)) - 1
    numbered = salted.repartitionByRange("length", "_salt").withColumn("_rank", in_salt).join(before, ["length", "_salt"])
    numbered = numbered.select(*items.columns, (F.col("_rank") + F.col("_before")).alias("_rank"))
    found = flows(spark, counts)
    shared = spark.sparkContext.broadcast((found, (found[:, 0] << 40) + found[:, 1]))  # FLOWS rows at most
    names, schema = items.columns, ", ".join(f"`{c}` {t}" for c, t in items.dtypes)

    def make():
        plan, keys = shared.value

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            _, start, first, offset, each = plan[np.searchsorted(keys, (length << 40) + rank, "right") - 1].T
            cols = [pa.array(first + (rank - start) // each), pa.array(offset + (rank - start) % each * length)]
            return pa.record_batch([*(b.column(c) for c in names), *cols], [*names, "sequence_id", "offset"])

        return work

    return in_python(numbered, make, f"{schema}, sequence_id bigint, offset bigint", rows=1 << 16)


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The documents' pieces, ids by their CRC, each with its sequence and place."""
    cut_up = pieces(docs, path, capacity)
    return pack(cut(cut_up.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces"), capacity)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
