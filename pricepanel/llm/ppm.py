"""Language-model scoring by prediction by partial matching over bytes, beside a word unigram base.

The model is a trie of byte contexts up to ``ORDER`` bytes, kept level by level as sorted arrays of
(context, symbol) counts. A symbol is coded in the longest known context; if it never followed there,
an escape (method C: as likely as the context has different symbols) leads to the next shorter
context, where all symbols of the longer one are excluded, down to a uniform choice among the bytes
that are left. The code length of a document is the sum over its bytes and its end.

One pass over the texts cuts them into blocks and writes, besides the blocks, the different grams (a
byte with its ``ORDER`` predecessors) of each block with their counts in training, packed and dealt to
buckets by the context's last three bytes. In a bucket the counts of all blocks are merged, which gives
the bucket's part of the trie, and every gram that some block asks for is scored once per block; the
answers go back to the blocks, which add them up. So a task holds the trie of one bucket or the grams
of one block, the model never passes through the driver, and work and shuffle grow with the texts
alone. Contexts of up to two bytes are common to all buckets: their counts, at most 2 ** 24, are sent
to all tasks. Of the word counts only the frequent head is held by tasks; the other words of a document
are looked up by a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Bytes of the longest context.
ORDER = 5
#: Bytes of a context that decide on its bucket; shorter contexts are held by every task.
SUFFIX = 3
#: Most words whose counts a task holds.
HEAD = 100_000
#: Marks before the first byte and after the last; neither occurs in UTF-8.
START, END = 0xFE, 0xFF
#: Bytes of text of a block; a longer text is a block of its own and its grams are worked on in pieces of this size.
BLOCK = 6 << 20
#: Grams merged or looked up at once.
PIECE = 1 << 20


def _grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The code of each byte with its ORDER predecessors, for all texts and their ends, and the texts' lengths.

    One long text comes in several pieces, several texts in one.
    """
    glued = np.frombuffer(b"".join(bytes([START]) * ORDER + t + bytes([END]) for t in texts), dtype=np.uint8)
    lengths = np.array([len(t) + 1 for t in texts])
    step = BLOCK if len(texts) == 1 else len(glued)
    for at in range(0, max(1, len(glued) - ORDER), step):
        part = glued[at : at + step + ORDER]
        codes = np.zeros(len(part) - ORDER, dtype=np.uint64)
        for k in range(ORDER + 1):
            codes <<= np.uint64(8)
            codes |= part[k : len(part) - ORDER + k]
        if len(texts) > 1:
            # the ORDER codes that run from one text into the next text's marks are no events
            keep = np.ones(len(codes), dtype=bool)
            ends = np.cumsum(lengths + ORDER)[:-1] - ORDER
            for k in range(ORDER):
                keep[ends + k] = False
            codes = codes[keep]
        yield codes, lengths if len(texts) > 1 else np.array([len(codes)])


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in order and the sums of their ``n``."""
    if not len(codes):
        return codes, n
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], np.add.reduceat(n, first)


def _block_counts(texts: list[bytes], train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different grams of the texts and how often each occurs in those that train."""
    found = []
    for codes, lengths in _grams(texts):
        codes <<= np.uint64(1)
        codes |= np.repeat(train, lengths).astype(np.uint64)
        codes.sort()
        own = codes >> np.uint64(1)
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        found.append((own[first], np.add.reduceat((codes & np.uint64(1)).astype(np.int64), first)))
    return found[0] if len(found) == 1 else _summed(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _pack(values: np.ndarray, width: int) -> bytes:
    """Whole numbers below ``256 ** width``, byte by byte in planes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, size: int, width: int) -> np.ndarray:
    out = np.zeros((size, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(data, size * width, "zstd"), dtype=np.uint8).reshape(width, size).T
    return out.reshape(-1).view("<u8")


def _pack_codes(codes: np.ndarray) -> bytes:
    """Codes in order, as differences."""
    return _pack(np.diff(codes, prepend=np.uint64(0)), ORDER + 1)


def _unpack_codes(data: bytes, size: int) -> np.ndarray:
    return np.cumsum(_unpack(data, size, ORDER + 1), dtype=np.uint64)


def _bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    suffix = (codes >> np.uint64(8)) & np.uint64((1 << 8 * SUFFIX) - 1)
    return ((((suffix * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _cut(rows: DataFrame, buckets: int) -> DataFrame:
    """One pass over rows of ``id, text, train, wanted``, written to the shared folder.

    Rows of four kinds: a block's texts (``block, texts, lengths, rows, ids``; only wanted rows), a
    block's grams in a bucket (``block, bucket, size, codes, counts``), training counts of short grams
    (``gram, n``) and of words (``word, n``; the end of a text counts as the word of no bytes).
    """
    kind = rows.schema["id"].dataType
    ids = pa.list_(rows.select("id").limit(0).toArrow().schema.field("id").type)
    fields = [("kind", pa.string()), ("block", pa.int64()), ("bucket", pa.int32()), ("size", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary()), ("texts", pa.binary()), ("bytes", pa.int64()), ("lengths", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("ids", ids), ("gram", pa.int64()), ("word", pa.binary()), ("n", pa.int64())]

    def made(count: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[name], t) if name in columns else pa.nulls(count, t) for name, t in fields], names=[name for name, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        count = 0
        words: Counter = Counter()
        short, short_n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        held: list[tuple] = []
        size = 0

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal short, short_n
            texts, name = [h[1] for h in held], first + held[0][2]
            codes, n = _block_counts(texts, np.array([h[3] for h in held]))
            three = codes & np.uint64(0xFFFFFF)
            short, short_n = _summed(np.concatenate([short, three[n > 0]]), np.concatenate([short_n, n[n > 0]]))
            dealt = _bucket(codes, buckets)
            order = np.argsort(dealt.astype(np.uint16) if buckets <= 65536 else dealt, kind="stable")
            codes, n, dealt = codes[order], n[order], dealt[order]
            starts = np.flatnonzero(np.r_[True, dealt[1:] != dealt[:-1]])
            ends = np.r_[starts[1:], len(dealt)]
            yield made(
                len(starts), kind=["grams"] * len(starts), block=[name] * len(starts), bucket=dealt[starts], size=ends - starts,
                codes=[_pack_codes(codes[a:b]) for a, b in zip(starts, ends, strict=True)], counts=[_pack(n[a:b], 4) for a, b in zip(starts, ends, strict=True)],
            )
            mine = [h for h in held if h[4]]
            if mine:
                glued = b"".join(h[1] for h in mine)
                yield made(
                    1, kind=["texts"], block=[name], texts=[pa.compress(glued, "zstd", asbytes=True)], bytes=[len(glued)], lengths=[[len(h[1]) for h in mine]],
                    rows=[[first + h[2] for h in mine]], ids=[[h[0] for h in mine]],
                )
            held.clear()

        for batch in batches:
            for i, text, train, wanted in zip(*(batch.column(c) for c in ("id", "text", "train", "wanted")), strict=True):
                t = (text.as_py() or "").encode("utf-8").lower()
                if held and size + len(t) > BLOCK:
                    yield from block()
                    size = 0
                train = bool(train.as_py())
                held.append((i.as_py(), t, count, train, wanted.as_py()))
                count, size = count + 1, size + len(t)
                if train:
                    words.update(t.split())
                    words[b""] += 1
                    if len(words) > 200_000:
                        yield made(len(words), kind=["words"] * len(words), word=list(words), n=list(words.values()))
                        words = Counter()
        if held:
            yield from block()
        if words:
            yield made(len(words), kind=["words"] * len(words), word=list(words), n=list(words.values()))
        if len(short):
            yield made(len(short), kind=["short"] * len(short), gram=short.view(np.int64), n=short_n)

    schema = f"kind string, block long, bucket int, size int, codes binary, counts binary, texts binary, bytes long, lengths array<long>, rows array<long>, ids array<{kind.simpleString()}>, gram long, word binary, n long"
    return materialize(rows.mapInArrow(run, schema), "ppm-cut")


class Level:
    """One level of the trie: contexts of ``k`` bytes with their symbols' counts."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        self.codes, self.n = codes, n
        self.contexts, self.first, self.kinds = np.unique(codes >> np.uint64(8), return_index=True, return_counts=True)
        self.total = np.add.reduceat(n, self.first) if len(n) else np.zeros(0, dtype=np.int64)

    def context(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each code's context, and whether it is known."""
        return _find(self.contexts, codes >> np.uint64(8))

    def count(self, codes: np.ndarray) -> np.ndarray:
        at, known = _find(self.codes, codes)
        return np.where(known, self.n[at] if len(self.n) else 0, 0)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.searchsorted(keys, wanted).clip(max=len(keys) - 1)
    return at, keys[at] == wanted


def _mask(k: int) -> np.uint64:
    return np.uint64((1 << 8 * (k + 1)) - 1)


class Trie:
    """Scores codes of ORDER + 1 bytes whose contexts end in one bucket's suffixes; ``short``: the codes of SUFFIX bytes of all buckets."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, short: np.ndarray, short_n: np.ndarray):
        self.levels: list[Level] = []
        for k in range(ORDER + 1):
            part, times = (codes, n) if k >= SUFFIX else (short, short_n)
            self.levels.append(Level(*_summed(part & _mask(k), times)))
        # what is left of a context's shorter one when the context's own symbols are excluded
        self.left_total, self.left_kinds = [np.zeros(0)], [np.zeros(0)]
        for k in range(1, ORDER + 1):
            own, shorter = self.levels[k], self.levels[k - 1]
            at, _ = shorter.context((own.contexts << np.uint64(8)) & _mask(k - 1))
            seen = shorter.count(own.codes & _mask(k - 1))
            self.left_total.append(shorter.total[at] - np.add.reduceat(seen, own.first) if len(seen) else np.zeros(0))
            self.left_kinds.append(shorter.kinds[at] - own.kinds)
        top = self.levels[ORDER]
        self.top_whole = np.repeat(top.total + top.kinds, top.kinds)

    def answers(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether the longest context has each code; count and whole of those that it has; log10 of the others."""
        top = self.levels[ORDER]
        at, known = _find(top.codes, codes)
        at = at[known]
        return known, top.n[at] if len(top.n) else at, self.top_whole[at] if len(top.n) else at, self._escaped(codes[~known])

    def _escaped(self, codes: np.ndarray) -> np.ndarray:
        """Codes that the top level may not have: down the levels, with escapes and exclusion."""
        out = np.zeros(len(codes))
        inside = np.zeros(len(codes), dtype=bool)  # a known context was met
        above = np.full(len(codes), -1, dtype=np.int64)  # its place on the level above
        open_ = np.ones(len(codes), dtype=bool)
        for k in range(ORDER, -1, -1):
            level, part = self.levels[k], codes & _mask(k)
            at, known = level.context(part)
            now = open_ & known
            total, kinds = np.zeros(len(codes)), np.zeros(len(codes))
            fresh, later = now & ~inside, now & inside
            total[fresh], kinds[fresh] = level.total[at[fresh]], level.kinds[at[fresh]]
            if k < ORDER and later.any():
                total[later], kinds[later] = self.left_total[k + 1][above[later]], self.left_kinds[k + 1][above[later]]
            n = level.count(part)
            found = now & (n > 0)
            out[found] += np.log10(n[found] / (total + kinds)[found])
            escape = now & (n == 0) & (kinds > 0)
            out[escape] += np.log10(kinds[escape] / (total + kinds)[escape])
            inside |= now
            above = np.where(known, at, -1)
            open_ &= ~found
        seen = self.levels[0].kinds[0] if len(self.levels[0].kinds) else 0
        out[open_] -= math.log10(256 - seen) if seen < 256 else 0.0
        return out


def _head(words: DataFrame) -> tuple[int, dict[bytes, int], int, int]:
    """Least count of the held words, their counts, number of all words and of different ones."""
    sizes = words.groupBy(F.floor(F.log2("n") * 8).alias("size")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.min("n").alias("least")).orderBy(F.desc("size")).collect()  # a few hundred rows
    held, least = 0, None
    for r in sizes:
        held += r["kinds"]
        if held > HEAD:
            break
        least = r["least"]
    total, kinds = sum(r["n"] for r in sizes), sum(r["kinds"] for r in sizes)
    least = least or (max((r["n"] for r in sizes), default=0) + 1)
    held = words.where(F.col("n") >= least).select("word", "n").toArrow()
    return least, dict(zip(held["word"].to_pylist(), held["n"].to_pylist(), strict=True)), total, kinds


class _Table:
    """Hashed look-up of the scores of a block's grams."""

    def __init__(self, codes: np.ndarray, logs: np.ndarray):
        self.codes, self.logs = codes, logs
        bits = max(4, math.ceil(math.log2(max(1, len(codes)) * 2)))
        self.shift, self.slots = np.uint64(64 - bits), np.full(1 << bits, -1, dtype=np.int32)
        left = np.arange(len(codes), dtype=np.int32)
        at = self._home(codes)
        while len(left):
            free = self.slots[at[left]] < 0
            places, winner = np.unique(at[left][free], return_index=True)
            self.slots[places] = left[free][winner]
            left = left[self.slots[at[left]] != left]
            at[left] = (at[left] + 1) & (len(self.slots) - 1)

    def _home(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, codes: np.ndarray) -> np.ndarray:
        at = self._home(codes)
        slot = self.slots[at]
        open_ = np.flatnonzero(self.codes[slot] != codes)
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            slot[open_] = self.slots[at[open_]]
            open_ = open_[self.codes[slot[open_]] != codes[open_]]
        return self.logs[slot]


_ANSWER = ["codes", "known", "times", "whole", "logs"]


def _read_answer(size: int, codes: bytes, known: bytes, times: bytes, whole: bytes, logs: bytes) -> tuple[np.ndarray, np.ndarray]:
    hit = np.unpackbits(np.frombuffer(known, dtype=np.uint8), count=size).astype(bool)
    n, out = int(hit.sum()), np.empty(size)
    out[hit] = np.log10(_unpack(times, n, ORDER + 1).astype(np.int64)) - np.log10(_unpack(whole, n, ORDER + 1).astype(np.int64))
    out[~hit] = np.frombuffer(pa.decompress(logs, (size - n) * 8, "zstd"))
    return _unpack_codes(codes, size), out


def _answer(short_sent):
    """Rows sorted by bucket, counts before questions -> the scores of each question's grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, short_n = short_sent.value
        none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        bucket, merged, waiting, size, trie = None, none, [], 0, None

        def merge() -> None:
            nonlocal merged, size
            merged = _summed(*(np.concatenate(x) for x in zip(merged, *waiting, strict=True)))
            waiting.clear()
            size = 0

        for batch in batches:
            out = []
            for b, asks, block, n, codes, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "asks", "block", "size", "codes", "counts")), strict=True):
                if b != bucket:
                    bucket, merged, trie, size = b, none, None, 0
                    waiting.clear()
                own = _unpack_codes(codes, n)
                if not asks:
                    times = _unpack(counts, n, 4).astype(np.int64)
                    waiting.append((own[times > 0], times[times > 0]))
                    size += len(waiting[-1][0])
                    if size > PIECE:
                        merge()
                    continue
                if trie is None:
                    merge()
                    trie = Trie(*merged, short, short_n)
                known, times, whole, logs = trie.answers(own)
                # counts are small and pack well, logarithms do not: only codes beyond the longest context have one
                out.append((block, n, codes, np.packbits(known).tobytes(), _pack(times, ORDER + 1), _pack(whole, ORDER + 1), pa.compress(logs.tobytes(), "zstd", asbytes=True)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), *[pa.binary()] * 5), strict=True)], names=["block", "size", *_ANSWER])

    return run


def score_rows(rows: DataFrame) -> DataFrame:
    """``id, n_tokens, n_known, train_tokens, base_score, score`` of the rows of ``id, text, train, wanted`` that are wanted."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = _cut(rows, buckets)
    words = materialize(cut.where("kind = 'words'").groupBy("word").agg(F.sum("n").alias("n")), "ppm-words")
    least, head, total, kinds = _head(words)
    norm = math.log10(total + 0.5 * (kinds + 1))
    head_sent = sc.broadcast(head)
    short = cut.where("kind = 'short'").groupBy("gram").agg(F.sum("n").alias("n")).orderBy("gram").toArrow()  # at most 2 ** 24 rows
    short_sent = sc.broadcast((short["gram"].to_numpy().view(np.uint64), short["n"].to_numpy()))

    grams = cut.where("kind = 'grams'").select("bucket", "block", "size", "codes", "counts")
    asked = grams.select("bucket", F.lit(False).alias("asks"), "block", "size", "codes", "counts").union(grams.select("bucket", F.lit(True), "block", "size", "codes", F.lit(None).cast("binary")))
    dealt = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "asks")
    answers = dealt.mapInArrow(_answer(short_sent), "block long, size int, " + ", ".join(f"{c} binary" for c in _ANSWER))
    kind = cut.schema["ids"].dataType.simpleString()
    none = lambda t: F.lit(None).cast(t)
    texts = cut.where("kind = 'texts'").select("block", F.lit(True).alias("is_text"), none("int").alias("size"), *[none("binary").alias(c) for c in _ANSWER], "texts", "bytes", "lengths", "rows", "ids")
    both = answers.select("block", F.lit(False).alias("is_text"), "size", *_ANSWER, none("binary").alias("texts"), none("long").alias("bytes"), none("array<long>").alias("lengths"), none("array<long>").alias("rows"), none(kind).alias("ids")).unionByName(texts)
    met = both.repartition("block").sortWithinPartitions("block", "is_text")
    done = materialize(met.mapInArrow(_scorer(head_sent, norm), f"row long, id {rows.schema['id'].dataType.simpleString()}, n_tokens long, n_known long, base double, score double, word binary, times long"), "ppm-scored")

    tail = words.where(F.col("n") < least).select("word", F.col("n").alias("c"))
    looked_up = done.where("word IS NOT NULL").select("row", "word", "times").join(tail, "word", "left")
    looked_up = looked_up.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("more_known"), F.sum(F.col("times") * (F.log10(F.coalesce("c", F.lit(0)) + 0.5) - norm)).alias("more_base"))
    out = done.where("word IS NULL").select("row", "id", "n_tokens", "n_known", "base", "score").join(looked_up, "row", "left")
    return out.select(
        "id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score",
    )


def _scorer(head_sent, norm: float):
    """Rows sorted by block, answers before the block's texts -> a row per text, and its words beyond the head."""
    names = ["row", "id", "n_tokens", "n_known", "base", "score", "word", "times"]

    def scores(texts: list[bytes], known: _Table) -> np.ndarray:
        parts = []
        for codes, lengths in _grams(texts):
            logs = np.concatenate([known.get(codes[at : at + PIECE]) for at in range(0, len(codes), PIECE)])
            parts.append(np.add.reduceat(logs, np.cumsum(lengths) - lengths))
        return parts[0] if len(texts) > 1 else np.sum(parts, axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = {w: (c, math.log10(c + 0.5) - norm) for w, c in head_sent.value.items()}
        block, answers = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                cell = lambda name, batch=batch, at=at: batch.column(name)[at].as_py()
                if cell("block") != block:
                    block, answers = cell("block"), []
                if not cell("is_text"):
                    answers.append(_read_answer(cell("size"), *map(cell, _ANSWER)))
                    continue
                known = _Table(*(np.concatenate(x) for x in zip(*answers, strict=True)))
                answers = []
                glued, texts, start = pa.decompress(cell("texts"), cell("bytes"), "zstd", asbytes=True), [], 0
                for n in cell("lengths"):
                    texts.append(glued[start : start + n])
                    start += n
                rows, ids = cell("rows"), batch.column("ids")[at].values
                n_tokens, n_known, base, tail = [], [], [], ([], [], [])
                for row, t in zip(rows, texts, strict=True):
                    words = t.split()
                    words.append(b"")
                    seen, worth = 0, 0.0
                    for w, n in Counter(words).items():
                        if (held := head.get(w)) is not None:
                            seen += n
                            worth += n * held[1]
                        else:
                            tail[0].append(row)
                            tail[1].append(w)
                            tail[2].append(n)
                    n_tokens.append(len(words))
                    n_known.append(seen)
                    base.append(worth)
                n, m = len(texts), len(tail[0])
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), ids, pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores(texts, known)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names=names)
                if m:
                    yield pa.RecordBatch.from_arrays([pa.array(tail[0], pa.int64()), pa.nulls(m, ids.type), *[pa.nulls(m, pa.int64())] * 2, *[pa.nulls(m, pa.float64())] * 2, pa.array(tail[1], pa.binary()), pa.array(tail[2], pa.int64())], names=names)

    return run


def score_documents(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    Both models learn from the texts of ``training``. A null or empty text is its end alone. Repeated
    rows give repeated results, a null id is kept, other columns are ignored, an empty table gives no
    rows; without training documents every word is unknown and every byte equally likely.
    """
    asked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(False).alias("train"), F.lit(True).alias("wanted"))
    learnt = training.select(F.lit(None).cast(asked.schema["id"].dataType).alias("id"), F.col(text_col).alias("text"), F.lit(True).alias("train"), F.lit(False).alias("wanted"))
    return score_rows(asked.union(learnt)).withColumnRenamed("id", id_col)


def op6_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    scored = score_rows(docs.select(F.col("doc_id").alias("id"), "text", (~held_out).alias("train"), F.lit(True).alias("wanted")))
    return scored.withColumnRenamed("id", "doc_id").withColumn("held_out", held_out)
