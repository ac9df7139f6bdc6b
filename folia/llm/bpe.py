"""Operator 10, byte-level BPE by prefix dynamic programming.

For each prefix of a piece of bytes exactly one token can end its encoding: token t that ends at i
is it if t stands there and the last token of the prefix before t may stand next to t, that is, if
merging their joined bytes gives these two tokens again. last[i] stores it; following last from the
end yields the encoding. Appending computes the new entries alone. After an edit the entries after
it are computed only until as many as the longest token agree with the old ones, since an entry
depends on no more than those before it and on its bytes; the rest is taken over.

Text is split by the tokenizer's pattern and each match is encoded by itself; a match that is a
token as a whole is that token. Encodings of short matches are remembered, up to a bound.

Edge cases: null text counts as empty and has no tokens; very long texts are split match by match,
so memory beyond the text and its ids doesn't grow; repeated rows and other columns make no
difference; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from functools import cache, cached_property
from itertools import islice

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.batches import in_python
from folia.llm.common import table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Remembered matches and token pairs per worker at most; longer matches aren't remembered.
WORDS, PAIRS, LONG = 1 << 19, 1 << 19, 64
#: Texts over so many characters are split by an iterator, not into a list.
HUGE = 1 << 20


class Prefixes:
    """The last tokens of all prefixes of some bytes."""

    def __init__(self, bpe: Bpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        done = len(self.data)
        self.data += more
        if not done:
            self.last = self.bpe.all_last(more)
            return
        self.last += [-1] * len(more)
        for i in range(done, len(self.data)):
            self.last[i] = self.bpe.last(self.data, self.last, i + 1)

    def edit(self, at: int, removed: int, inserted: bytes) -> int:
        """Replace data[at : at + removed]; how many entries were computed anew."""
        old, tail = self.last, self.data[at + removed :]
        self.data = self.data[:at] + inserted + tail
        self.last = old[:at] + [-1] * (len(inserted) + len(tail))
        moved, same, i = at + removed - (at + len(inserted)), 0, at
        while i < len(self.data):
            self.last[i] = self.bpe.last(self.data, self.last, i + 1)
            same = same + 1 if i >= at + len(inserted) and self.last[i] == old[i + moved] else 0
            i += 1
            # The windows of all later entries then lie after the edit and hold the old entries.
            if same >= self.bpe.longest and i - self.bpe.longest >= at + len(inserted):
                break
        self.last[i:] = old[i + moved :]
        return i - at

    def tokens(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(t := self.last[i - 1])
            i -= len(self.bpe.bytes[t])
        return out[::-1]


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.bytes, self.longest = ranks, {i: b for b, i in ranks.items()}, max(map(len, ranks))
        self.pattern, self.latin = regex.compile(pattern), latin(pattern)
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.alone: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int]] = {}

    @cached_property
    def ends(self) -> ahocorasick.Automaton:
        """All tokens; built where text is encoded, not where ids are decoded."""
        out = ahocorasick.Automaton()
        for b, i in self.ranks.items():
            out.add_word(b.decode("latin-1"), (i, len(b)))
        out.make_automaton()
        return out

    def merged(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first; for the few bytes of a pair of tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if best == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def reached(self, t: int) -> bool:
        """Does merging the token's bytes give the token?"""
        if (known := self.alone.get(t)) is None:
            known = self.alone[t] = self.merged(self.bytes[t]) == [t]
        return known

    def halves(self, t: int) -> tuple[int, int]:
        """The two tokens whose merge makes t; (t, t) for a single byte."""
        if (known := self.split.get(t)) is None:
            parts = [self.bytes[t][i : i + 1] for i in range(len(self.bytes[t]))]
            while len(parts) > 2:
                at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))[1]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = self.split[t] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 and self.reached(t) else (t, t)
        return known

    def meet(self, a: int, b: int) -> bool:
        """May token a stand before token b?"""
        key = a << 32 | b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._meet(a, b)
        return known

    def _meet(self, a: int, b: int) -> bool:
        """Undo the merges of both, the latest first; they may not stand together if at some moment
        the parts that touched would have merged before the merge that is being undone."""
        before = 1 << 40  # merges of lower rank were made by then
        while True:
            joint = self.ranks.get(self.bytes[a] + self.bytes[b])
            if joint is not None and joint < before:
                return False
            left, right = self.halves(a)[1], self.halves(b)[0]
            if left == a and right == b:
                return True
            if right == b or (left != a and a > b):
                before, a = a, left
            else:  # of equal ranks the left merge was made first
                before, b = b + 1, right

    def all_last(self, data: bytes) -> list[int]:
        """last of every prefix; an automaton yields the tokens that end at each byte."""
        out, meet = [-1] * len(data), self.meet
        for end, (t, n) in self.ends.iter(data.decode("latin-1")):
            if out[end] < 0:
                start = end + 1 - n
                if meet(out[start - 1], t) if start else self.reached(t):
                    out[end] = t
        return out

    def last(self, data: bytes, last: list[int], end: int) -> int:
        """The last token of data[:end], given those of the shorter prefixes."""
        get = self.ranks.get
        for start in range(max(0, end - self.longest), end):
            t = get(data[start:end])
            if t is not None and (self.meet(last[start - 1], t) if start else self.reached(t)):
                return t
        raise ValueError("a byte has no token")

    def piece(self, match: str) -> bytes:
        """Ids of one match of the pattern, as little-endian unsigned 32-bit numbers."""
        data = match.encode()
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else Prefixes(self, data).tokens()
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        pattern = self.latin if text.isascii() or (self.latin and max(text) <= LAST_LATIN) else self.pattern
        if len(text) <= HUGE:
            return self.joined(pattern.findall(text))
        found, out = (m.group() for m in pattern.finditer(text)), []
        while part := list(islice(found, HUGE)):
            out.append(self.joined(part))
        return b"".join(out)

    def joined(self, matches: list[str]) -> bytes:
        words = self.words
        try:
            return b"".join(map(words.__getitem__, matches))
        except KeyError:
            pass
        out = []
        for m in matches:
            if (ids := words.get(m)) is None:
                ids = self.piece(m)
                if len(m) <= LONG:
                    if len(words) >= WORDS:
                        words.clear()
                    words[m] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


LAST_LATIN = "\u024f"


def latin(pattern: str) -> re.Pattern | None:
    """The pattern for texts without characters beyond LAST_LATIN, in the faster of the two
    libraries: properties and white space are spelled out."""
    n, s = r"\d\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
    known = {r"[^\s\p{L}\p{N}]": rf"(?:[^\w{s}]|_)", r"\p{L}": rf"[^\W{n}_]", r"\p{N}": rf"[{n}]", r"(?!\S)": rf"(?![^{s}])", r"\s": rf"[{s}]"}
    for a, b in known.items():
        pattern = pattern.replace(a, b)
    return re.compile(pattern) if r"\p" not in pattern else None


@cache
def load(path: str, pattern: str) -> Bpe:
    with open(path, "rb") as f:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, tokens): tokens holds little-endian unsigned 32-bit ids."""
    kind = docs.schema[key].dataType.simpleString()

    def make():
        bpe = load(path, pattern)

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([b.column(0), pa.array([bpe.encode(t or "") for t in b.column(1).to_pylist()], pa.binary())], [key, "tokens"])

        return work

    return in_python(docs.select(key, text), make, f"`{key}` {kind}, tokens binary")


def digest(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids, decoded): ids in decimal, joined by commas; decoded bytes."""
    kind = encoded.schema[key].dataType.simpleString()

    def make():
        bpe = load(path, pattern)
        decimal = {i: str(i) for i in bpe.bytes}

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = [np.frombuffer(x, "<u4").tolist() for x in b.column(1).to_pylist()]
            cols = [pa.array(map(len, ids), pa.int64()), pa.array([",".join(map(decimal.__getitem__, x)) for x in ids], pa.string()), pa.array(map(bpe.decode, ids), pa.binary())]
            return pa.record_batch([b.column(0), *cols], [key, "n_tokens", "ids", "decoded"])

        return work

    return in_python(encoded, make, f"`{key}` {kind}, n_tokens bigint, ids string, decoded binary")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    out = digest(encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
