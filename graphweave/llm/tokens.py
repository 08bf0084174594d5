"""Encoding a corpus with a public byte-level BPE vocabulary.

Texts are cut into pieces by the vocabulary's pattern. The distinct new pieces of a block of texts
are merged together: their bytes lie in one chain, an index maps each pair of neighbours that has a
rank to all its positions, and the active ranks are applied in ascending order. A merge changes
only the pairs at its two ends, so only their lists are updated. As a merged pair always outranks
its parts, no rank comes back once it is done.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_FOLDER = os.environ.get("GRAPHWEAVE_TOKENIZERS", "/opt/tokenizers")
#: Characters of text handled at once, and pieces remembered: bounds of memory, without effect on results.
BLOCK_CHARS = 2_000_000
KEPT_PIECES = 400_000
KEPT_LENGTH = 48
#: Fixed value: the published cutting pattern of the byte_bpe_50k vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class PairIndexEncoder:
    """Byte-level BPE over a vocabulary of ranks: bytes -> id, where the id is the rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.cut = regex.compile(pattern).findall
        self.single = [ranks[bytes([b])] for b in range(256)]
        token = {i: t for t, i in ranks.items()}
        self.token, self.ranks = token, ranks
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.kept: dict[str, tuple[int, ...]] = {}

    def rank(self, left: int, right: int) -> int:
        """The rank of a pair of neighbours, -1 if they never merge."""
        key = (left, right)
        found = self.pair_rank.get(key)
        if found is None:
            found = self.pair_rank[key] = self.ranks.get(self.token[left] + self.token[right], -1)
        return found

    def merge(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """The ids of each piece, all pieces merged at once through the pair occurrence index."""
        raw = [p.encode() for p in pieces]
        ids: list[int] = []
        for r in raw:  # -1 keeps the pieces apart
            ids += [self.single[b] for b in r]
            ids.append(-1)
        size = len(ids)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        where: dict[int, list[int]] = {}
        rank, pair_rank = self.rank, self.pair_rank
        for i in range(size - 1):
            a, b = ids[i], ids[i + 1]
            if a >= 0 and b >= 0:
                r = pair_rank.get((a, b))
                if r is None:
                    r = rank(a, b)
                if r >= 0:
                    if r in where:
                        where[r].append(i)
                    else:
                        where[r] = [i]
        active = list(where)
        heapq.heapify(active)
        gone = bytearray(size)
        while active:
            now = heapq.heappop(active)
            spots = where.pop(now)
            spots.sort()
            for i in spots:
                j = after[i]
                if gone[i] or j >= size or ids[j] < 0 or rank(ids[i], ids[j]) != now:
                    continue  # an earlier merge took one of the two
                ids[i] = now
                gone[j] = 1
                k = after[j]
                after[i] = k
                before[k] = i
                for left in (before[i], i):
                    if left < 0 or ids[left] < 0:
                        continue
                    right = after[left]
                    if ids[right] < 0:
                        continue
                    r = rank(ids[left], ids[right])
                    if r >= 0:
                        if r in where:
                            where[r].append(left)
                        else:
                            where[r] = [left]
                            heapq.heappush(active, r)
        out: list[tuple[int, ...]] = []
        at = 0
        for r in raw:
            end = at + len(r)
            one = []
            while at < end:
                one.append(ids[at])
                at = after[at]
            out.append(tuple(one))
            at = end + 1
        return out

    def encode_block(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        cut = [self.cut(t) for t in texts]
        kept = self.kept
        if len(kept) > KEPT_PIECES:
            kept.clear()
        new = list(set(chain.from_iterable(cut)).difference(kept))
        kept.update(zip(new, self.merge(new), strict=True))
        ids = [list(chain.from_iterable(map(kept.__getitem__, c))) for c in cut]
        for p in new:
            if len(p) > KEPT_LENGTH:
                del kept[p]
        return ids


_encoders: dict[str, PairIndexEncoder] = {}


def encoder(vocabulary: str) -> PairIndexEncoder:
    """The encoder of a vocabulary file (base64 token and rank on each line), one a worker."""
    if vocabulary not in _encoders:
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[vocabulary] = PairIndexEncoder(ranks)
    return _encoders[vocabulary]


def _blocks(texts: list[str | None]) -> Iterator[list[str]]:
    block: list[str] = []
    chars = 0
    for t in texts:
        block.append(t or "")
        chars += len(block[-1])
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def encode_all(vocabulary: str, texts: list[str | None]) -> Iterator[list[list[int]]]:
    enc = encoder(vocabulary)
    for block in _blocks(texts):
        yield enc.encode_block(block)


def _vocabulary(folder: str | None, name: str) -> str:
    return os.path.join(folder or DEFAULT_FOLDER, f"{name}.tiktoken")


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids array<int>) of every row; empty and null texts give an empty list.

    Strings that look like special tokens are ordinary text. A repeated key gives a row each. Other
    columns are not read. folder: where the vocabulary files lie on each machine.
    """
    path = _vocabulary(folder, name)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = batch.column(0), 0
            for block in encode_all(path, batch.column(1).to_pylist()):
                ends = np.cumsum([0, *map(len, block)], dtype=np.int32)
                values = np.fromiter(chain.from_iterable(block), dtype=np.int32, count=int(ends[-1]))
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(block)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["k", "ids"])
                at += len(block)

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, n_tokens int) of every row by the same encoder, without sending the ids back; 0 for empty and null texts."""
    path = _vocabulary(folder, name)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(ids) for block in encode_all(path, batch.column(1).to_pylist()) for ids in block]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32())], names=["k", "n_tokens"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n_tokens int").withColumnRenamed("k", key)
