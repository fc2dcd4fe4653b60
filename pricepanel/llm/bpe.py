"""Byte-level BPE encoding and decoding on length-bucketed numpy matrices.

Pre-tokens of a batch are made distinct, grouped by their length and laid out as the rows of a
padded matrix of token ids. In every round each row merges its leftmost pair of minimum rank; a
pair's rank comes from a vectorised hash table; finished rows leave the matrix and merged rows are
compacted. A pre-token longer than ``LONG`` bytes is merged on its own in the same order, by a queue of
its pairs, so that one unbroken line of a megabyte takes seconds.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Bytes beyond which a pre-token is merged on its own.
LONG = 128
#: Distinct pre-tokens a worker remembers between batches.
MEMO = 400_000
#: Cells of one padded matrix; bounds the memory of a round.
CELLS = 1_000_000
NONE = np.int32(2**31 - 1)

# Texts of these characters alone (no control characters 1C-1F, digits only 0-9) may be split by
# the standard library's engine: there the two patterns agree, and it is several times faster.
_OTHER = re.compile("[^\x00-\x1b\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-ƿЀ-ҁ]")
_PLAIN = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d"
    "| ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ƿЀ-ҁ]+| ?[0-9]+"
    "| ?[^\x09-\x0d 0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ƿЀ-ҁ]+"
    "|[\x09-\x0d ]+(?![^\x09-\x0d ])|[\x09-\x0d ]+"
)


class PairTable:
    """Open-addressing hash table from a pair of ids to the id (rank) of their union."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, NONE, dtype=np.int32)
        left = np.arange(len(keys))
        at = self._home(keys)
        while len(left):
            free = self.keys[at[left]] == np.uint64(2**64 - 1)
            slots, first = np.unique(at[left][free], return_index=True)
            winners = left[free][first]
            self.keys[slots], self.values[slots] = keys[winners], values[winners]
            left = np.setdiff1d(left, winners, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shape = a.shape
        keys = ((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)).ravel()
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(2**64 - 1))]
        return out.reshape(shape)


class ByteBPE:
    """Encoder and decoder for one rank table (token bytes -> rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split_any = regex.compile(pattern)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.pairs = PairTable(np.array(keys, dtype=np.uint64), np.array(values, dtype=np.int32))
        first, second = np.divmod(np.arange(65536), 256)
        self.byte_pair = self.pairs.get(self.byte_id[first], self.byte_id[second])
        size = max(ranks.values()) + 1
        self.lengths = np.zeros(size, dtype=np.int64)
        parts = [b""] * size
        for token, rank in ranks.items():
            parts[rank], self.lengths[rank] = token, len(token)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def split(self, text: str) -> list[str]:
        import public_tokenizers

        if self.split_any.pattern == public_tokenizers.PATTERN and not _OTHER.search(text):
            return _PLAIN.findall(text)
        return self.split_any.findall(text)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(pieces)
        rest = []
        for i, p in enumerate(pieces):
            if (rank := self.ranks.get(p)) is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(p) > LONG:
                out[i] = self._encode_long(p)
            else:
                rest.append(i)
        rest.sort(key=lambda i: len(pieces[i]))
        at = 0
        while at < len(rest):  # a bucket: about the same length, at most CELLS cells
            shortest = len(pieces[rest[at]])
            end, most = at, max(1, CELLS // (shortest + shortest // 4 + 1))
            while end < len(rest) and end - at < most and len(pieces[rest[end]]) <= shortest + shortest // 4:
                end += 1
            bucket = rest[at:end]
            for i, ids in zip(bucket, self._encode_matrix([pieces[i] for i in bucket]), strict=True):
                out[i] = ids
            at = end
        return out

    def _encode_matrix(self, rows: list[bytes]) -> list[bytes]:
        """One column per pre-token, one matrix row per place, so that a step is a few whole-matrix operations."""
        width = max(map(len, rows))
        if width < 2:
            return [self.byte_id[r[0]].astype("<u4").tobytes() for r in rows]
        padded = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), dtype=np.uint8).reshape(len(rows), width).T
        n = np.array([len(r) for r in rows])
        pair = self.byte_pair[padded[:-1].astype(np.int32) << 8 | padded[1:]]
        pair[np.arange(width - 1)[:, None] >= n - 1] = NONE
        ids = self.byte_id[padded]
        result: list[bytes] = [b""] * len(rows)
        row = np.arange(len(rows))
        while True:
            best = pair.min(axis=0) if len(pair) else np.full(len(row), NONE)
            open_ = best != NONE
            if not open_.all():
                done = np.flatnonzero(~open_)
                for r, k, cells in zip(row[done].tolist(), n[done].tolist(), np.ascontiguousarray(ids[:, done].T).astype("<u4"), strict=True):
                    result[r] = cells[:k].tobytes()
                if len(done) == len(row):
                    return result
                row, n, best = row[open_], n[open_], best[open_]
                width = int(n.max())
                ids, pair = ids[:width, open_], pair[: width - 1, open_]
            place = np.zeros(len(row), dtype=np.int16)
            for c in range(len(pair) - 1, -1, -1):
                place[pair[c] == best] = c
            # compaction: what stands right of the merged pair moves one place to the left
            at = np.arange(len(ids) - 1, dtype=np.int16)[:, None]
            ids = np.where(at > place, ids[1:], ids[:-1])
            pair = np.where(at[:-1] >= place, pair[1:], pair[:-1])
            k, n = np.arange(len(row)), n - 1
            ids[place, k] = best
            left = np.flatnonzero(place > 0)
            pair[place[left] - 1, left] = self.pairs.get(ids[place[left] - 1, left], best[left])
            right = np.flatnonzero(place < n - 1)
            pair[place[right], right] = self.pairs.get(best[right], ids[place[right] + 1, right])

    @cached_property
    def pair_ranks(self) -> dict[int, int]:
        there = self.pairs.values != NONE
        return dict(zip(self.pairs.keys[there].tolist(), self.pairs.values[there].tolist(), strict=True))

    def _encode_long(self, piece: bytes) -> bytes:
        """One long pre-token: a queue of its pairs by rank, then place, and links between what is left; n log n steps."""
        ids = self.byte_id[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n, rank_of = len(ids), self.pair_ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [rank << 40 | i for i in range(n - 1) if (rank := rank_of(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(queue)
        while queue:
            rank, i = divmod(heappop(queue), 1 << 40)
            j = after[i]
            if ids[i] < 0 or j >= n or rank_of(ids[i] << 32 | ids[j]) != rank:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (next_rank := rank_of(rank << 32 | ids[k])) is not None:
                    heappush(queue, next_rank << 40 | i)
            h = before[i]
            if h >= 0 and (next_rank := rank_of(ids[h] << 32 | rank)) is not None:
                heappush(queue, next_rank << 40 | h)
        return np.array([x for x in ids if x >= 0], dtype="<u4").tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a document's ids."""
        if not len(ids):
            return b""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        index = np.arange(ends[-1]) - np.repeat(ends - n - self.starts[ids], n)
        return self.bytes[index].tobytes()


class Encoder:
    """Encodes documents with a memo of pre-tokens that lasts as long as the worker's task."""

    def __init__(self, bpe: ByteBPE):
        self.bpe, self.memo = bpe, {}

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        at = 0
        while at < len(texts):  # a few MB of text at a time
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= 4_000_000):
                size += len(texts[end])
                end += 1
            split = [self.bpe.split(t) for t in texts[at:end]]
            if len(self.memo) > MEMO:
                self.memo.clear()
            new = {w for words in split for w in words if w not in self.memo}
            new = list(new)
            self.memo.update(zip(new, self.bpe.encode_pieces([w.encode("utf-8") for w in new]), strict=True))
            for words in split:
                yield b"".join(map(self.memo.__getitem__, words))
            at = end


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``, an array of long, on
    request). A null or empty text has 0 tokens and the digests of no bytes. Repeated rows give
    repeated results; other columns of ``docs`` are ignored; an empty table gives no rows.
    ``ranks_path`` is a file that every executor finds at the same place.
    """
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>" if with_ids else "")
    if with_ids:
        fields.append(pa.field("ids", pa.list_(pa.int64())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ByteBPE.from_file(ranks_path, pattern))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts, hashes, decoded, lists = [], [], [], []
            for raw in encoder.encode_batch(texts):
                ids = np.frombuffer(raw, dtype="<u4")
                counts.append(len(ids))
                hashes.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(encoder.bpe.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(ids.astype(np.int64))
            columns = [batch.column("id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field("id", batch.column("id").type), *fields]))

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
