"""Encoding of texts with a public byte-level BPE, by a pair occurrence index.

The texts are cut into pre-tokens by the JVM's regex engine.  A Python worker sees them
as Arrow lists, finds the distinct ones with Arrow's dictionary encoding, and merges all
new ones of a batch together: an index maps each active pair to all its positions, ranks
are applied in ascending order over all positions at once, and only the lists that a merge
touches are updated.  A merge can only create pairs of higher rank than its own, since
a vocabulary's parts always come before their union, so one ascending sweep is exact.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The public pre-tokenisation pattern in Java's spelling: white space is Unicode's property,
#: and the repetitions that can never give back are possessive.
PRETOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\p{IsWhite_Space}\p{L}\p{N}]++"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}++"
)

#: Distinct pre-tokens that a worker remembers before it starts over.
CACHE_LIMIT = 1_000_000


def default_vocabulary() -> str:
    """Path of the public vocabulary byte_bpe_50k as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class PairIndex:
    """The merges of a vocabulary and the pair occurrence index over a set of words."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        merges: dict[int, int] = {}
        for token, rank in ranks.items():
            if len(token) < 2:
                continue
            # the one split whose halves are joined last: merge the token's bytes below its rank
            parts = [bytes([b]) for b in token]
            while len(parts) > 2:
                best = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
                if best[0] >= rank:
                    break
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 2:
                merges[ranks[parts[0]] << 20 | ranks[parts[1]]] = rank
        self.merges = merges
        keys = np.fromiter(merges.keys(), np.int64, len(merges))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.fromiter(merges.values(), np.int64, len(merges))[order]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and where each word's ids start in it."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        n = len(text)
        ends = np.cumsum(lengths)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        ids = self.byte_id[text]
        inner = np.ones(n, bool)
        inner[ends[lengths > 0] - 1] = False  # no pair reaches over a word's end
        first = np.flatnonzero(inner)
        key = ids[first] << 20 | ids[first + 1]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        rank, first = self.ranks[at[known]], first[known]
        order = np.argsort(rank, kind="stable")
        rank, first = rank[order], first[order]
        cuts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else np.zeros(0, np.int64)
        lists = np.split(first, cuts[1:]) if len(cuts) else []
        positions: dict[int, list[int]] = {int(r): p.tolist() for r, p in zip(rank[cuts], lists)}
        del key, at, known, order

        token = ids.tolist()
        starts = np.zeros(n + 1, bool)
        starts[0] = True
        starts[ends] = True
        nxt = [*range(1, n + 1)]
        prv = [*range(-1, n - 1)]
        for e in ends.tolist():
            if 0 < e:
                nxt[e - 1] = -1
                if e < n:
                    prv[e] = -1
        pair_of = {v: (k >> 20, k & 0xFFFFF) for k, v in self.merges.items()} if len(positions) > 1000 else None
        active = [*positions]
        heapq.heapify(active)
        get = self.merges.get
        while active:
            r = heapq.heappop(active)
            left, right = (pair_of or self._pairs())[r]
            for i in sorted(positions.pop(r)):
                if token[i] != left:
                    continue
                j = nxt[i]
                if j < 0 or token[j] != right:
                    continue
                token[i] = r
                token[j] = -1
                k = nxt[j]
                nxt[i] = k
                if k >= 0:
                    prv[k] = i
                    new = get(r << 20 | token[k])
                    if new is not None:
                        if new in positions:
                            positions[new].append(i)
                        else:
                            positions[new] = [i]
                            heapq.heappush(active, new)
                h = prv[i]
                if h >= 0:
                    new = get(token[h] << 20 | r)
                    if new is not None:
                        if new in positions:
                            positions[new].append(h)
                        else:
                            positions[new] = [h]
                            heapq.heappush(active, new)
        out = np.array(token, np.int64)
        live = out >= 0
        return out[live].astype(np.int32), np.r_[0, np.cumsum(live)[ends - 1] * (ends > 0)]

    def _pairs(self) -> dict[int, tuple[int, int]]:
        if not hasattr(self, "_by_rank"):
            self._by_rank = {v: (k >> 20, k & 0xFFFFF) for k, v in self.merges.items()}
        return self._by_rank


@lru_cache(maxsize=2)
def load(path: str) -> PairIndex:
    with open(path, "rb") as lines:
        return PairIndex({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


class Encoder:
    """Encodes Arrow lists of pre-tokens; remembers the pre-tokens it has seen."""

    def __init__(self, path: str):
        self.index, self.flat, self.start, self.known = load(path), np.zeros(0, np.int32), np.zeros(1, np.int64), {}

    def rows(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch and the row offsets into them."""
        import pyarrow as pa

        offsets = column.offsets.to_numpy().astype(np.int64)
        values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        if not len(values):
            return np.zeros(0, np.int32), np.zeros(len(column) + 1, np.int64)
        coded = values.dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE_LIMIT:
            self.flat, self.start, self.known = np.zeros(0, np.int32), np.zeros(1, np.int64), {}
            new = words
        if new:
            ids, starts = self.index.encode(new)
            base = len(self.known)
            self.known.update(zip(new, range(base, base + len(new))))
            self.start = np.r_[self.start, starts[1:] + self.start[-1]]
            self.flat = np.r_[self.flat, ids]
        number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        code = number[coded.indices.to_numpy()]
        begin, size = self.start[code], self.start[code + 1] - self.start[code]
        done = np.cumsum(size)
        total = int(done[-1])
        ids = self.flat[np.repeat(begin - (done - size), size) + np.arange(total)]
        return ids, np.r_[0, done][offsets]


def pretokens(text: str | Column) -> Column:
    """The pre-tokens of a text; none for an empty or null text."""
    return F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(PRETOKEN), F.lit(0))


def _mapped(df: DataFrame, keep: list[str], text: str, kind: T.DataType, out: str, count: bool, vocabulary: str | None) -> DataFrame:
    path = vocabulary or default_vocabulary()
    df.sparkSession.sparkContext.addFile(path)  # executors need not have it where the driver has
    shipped = os.path.basename(path)
    chosen = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], pretokens(text).alias("pre"))
    schema = T.StructType([*chosen.schema.fields[:-1], T.StructField("out", kind)])
    names = schema.names

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import SparkFiles

        encoder = Encoder(SparkFiles.get(shipped))
        for batch in batches:
            ids, offsets = encoder.rows(batch.column(batch.num_columns - 1))
            if count:
                made = pa.array(np.diff(offsets), pa.int64())
            else:
                made = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=names)

    return chosen.mapInArrow(encode, schema).toDF(*keep, out)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``key`` and the token ids of ``text`` of every row, without special tokens.

    One row per input row; repeated rows stay.  Empty and null texts have an empty list;
    white space is text; strings that look like special tokens are ordinary text.  Other
    columns are ignored, whatever they are called.
    """
    return _mapped(df, [key], text, T.ArrayType(T.IntegerType()), out, False, vocabulary)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", out: str = "n_tokens", vocabulary: str | None = None) -> DataFrame:
    """The columns ``keep`` and the number of tokens of ``text``; 0 for empty and null texts."""
    return _mapped(df, keep, text, T.LongType(), out, True, vocabulary)
