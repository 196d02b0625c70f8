"""Byte-level BPE by monoid tree reduction.

The elements are (bytes, tokens) pairs under an associative join; the tokens of
a whole are reduced from those of its halves.  The join re-encodes a window at
the boundary and widens it until the tokens outside provably stay: a token
sequence is the BPE encoding of its bytes exactly when every adjacent pair is
the encoding of the pair's own bytes.  So once the pairs where the window meets
the kept tokens are stable, nothing outside can change.  The pattern's matches
are encoded apart, hence between matches the join is concatenation.

On Spark this is a map over rows: vocabulary ranks are broadcast (a table of
fixed size), the merges of short matches are memoised in each Python worker.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Longest piece that is merged directly; longer ones are halved.
LEAF = 24
#: Above every rank.
NEVER = 1 << 60
#: Memoised matches of a worker; beyond that it starts afresh.
MEMO = 200_000
#: Rows that a worker holds at once as Python objects and as results.
ROWS = 128


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Bpe:
    """Encoder and decoder over one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.vocab = {r: t for t, r in ranks.items()}
        self._memo: dict[str, bytes] = {}
        self._stable: dict[tuple[int, int], bool] = {}

    def _leaf(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 64:
            return self._by_heap(parts)
        while len(parts) > 1:
            found = [ranks.get(parts[i] + parts[i + 1], NEVER) for i in range(len(parts) - 1)]
            least = min(found)
            if least == NEVER:
                break
            i = found.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    def _by_heap(self, parts: list[bytes]) -> list[int]:
        """The same merges for a long window, in n log n: a heap of pairs over a linked list."""
        ranks, n = self.ranks, len(parts)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] is not a or j >= n or parts[j] is not b:
                continue  # one of the two has merged meanwhile
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] < n:
                ahead[after[j]] = i
            for k in (ahead[i], i):
                if k >= 0 and after[k] < n and (r := ranks.get(parts[k] + parts[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[after[k]]))
        return [ranks[p] for p in parts if p is not None]

    def _pair_stays(self, a: int, b: int) -> bool:
        key = (a, b)
        if (known := self._stable.get(key)) is None:
            if len(self._stable) > MEMO:
                self._stable.clear()
            known = self._stable[key] = self._leaf(self.vocab[a] + self.vocab[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two neighbours' bytes together, given the tokens of each."""
        if not left or not right or self._pair_stays(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = left[len(left) - i :] + right[:j]
            middle = self._leaf(b"".join(self.vocab[t] for t in window))
            left_ok = i == len(left) or self._pair_stays(left[len(left) - i - 1], middle[0])
            right_ok = j == len(right) or self._pair_stays(middle[-1], right[j])
            if left_ok and right_ok:
                return left[: len(left) - i] + middle + right[j:]
            i, j = (i if left_ok else min(2 * i, len(left))), (j if right_ok else min(2 * j, len(right)))

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tree reduction of one match: halve, encode, join."""
        if len(piece) <= LEAF:
            return self._leaf(piece)
        half = len(piece) // 2
        return self.join(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))

    def encode_packed(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        memo, out = self._memo, []
        for m in self.split.findall(text):
            packed = memo.get(m)
            if packed is None:
                packed = np.array(self.encode_piece(m.encode()), dtype="<u4").tobytes()
                if len(m) <= 64:
                    if len(memo) > MEMO:
                        memo.clear()
                    memo[m] = packed
            out.append(packed)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids: halves are decoded and concatenated up the tree."""
        if len(ids) <= 4096:
            return b"".join(map(self.vocab.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def encode_documents(spark: SparkSession, docs: DataFrame, rank_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, then n_tokens, ids (packed little-endian u32), ids_sha256, decoded_sha256 for each row.

    Null and empty texts have no tokens; their hashes are those of no bytes.
    Rows keep their multiplicity; other columns may have any names and are not
    read.  Text is encoded whole, whatever its length.
    """
    shared = spark.sparkContext.broadcast((load_ranks(rank_path), pattern))
    kinds = {f.name: f for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(*shared.value)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            n, ids, ids_sha, dec_sha = [], [], [], []
            for text in batch.column(len(keep)).to_pylist():
                packed = bpe.encode_packed(text or "")
                back = bpe.decode(np.frombuffer(packed, dtype="<u4").tolist())
                n.append(len(packed) // 4)
                ids.append(packed)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                dec_sha.append(hashlib.sha256(back).hexdigest())
            made = [pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(ids_sha, pa.string()), pa.array(dec_sha, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + made, names=[*keep, "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    from pyspark.sql import types as T

    schema = T.StructType([kinds[c] for c in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.select(*keep, "text").mapInArrow(run, schema)
