"""Alignment of two tokenizers' tokens by the bytes they cover, and how usual each linked pair of ids is.

Both tokenizers are applied to a text's segments (cut where a space follows a character that is no
white space, which no token of either crosses), with a memo of segments, so a word is encoded once.
The end arrays of the two token sequences are then walked together: while they agree at the current
index shift, probes of doubling length jump over whole one-to-one stretches; where they stop to agree
the irregular group is closed at the next common end and the shift is updated.

Documents are worked on in blocks of bounded size. A block leaves a row per document, with its figures
and which of the block's different linked id pairs it holds and how often, and a row per pair. Counts by
pair are sums over the blocks; a block's documents meet the counts of its pairs in one group, so links
never leave a block one by one, and no task holds more than a block, however many it is dealt.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Bytes of text of a block; a longer text is a block of its own.
BLOCK = 12 << 20
#: Characters of text aligned at once; a longer text is aligned alone.
CHUNK = 1 << 20
#: Segments whose tokens a worker remembers, and their mean length in bytes beyond which new ones are forgotten.
MEMO, MEMO_BYTES = 400_000, 64
#: Tokens compared one by one before probes double.
HEAD = 8
#: Characters below this one have had their classes since long before either library.
SETTLED = "\u0250"
#: Bits of an id of either tokenizer.
ID_BITS = 20
#: Links of a group above which its repeated ids are counted instead of written out.
WIDE = 1024

#: A space that a token of either kind may have inside: one that does not follow a letter, digit or mark of ASCII.
_ODD = re.compile(r"[^\w!-~] ")


def byte_level_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """Tokenizer A: byte-level BPE from a ``tokenizers`` file; a segment is encoded as it stands.

    Where the file's merges are in the order of their ids, segments of characters below ``SETTLED`` go
    through tiktoken with the file's own vocabulary, which gives the same ids in less time; for characters
    whose classes may differ between versions of Unicode the file's tokenizer itself is asked.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        of = byte_level_bytes()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes[i] = bytes(of[c] for c in piece)
        with open(path, encoding="utf-8") as file:
            merges = json.load(file)["model"]["merges"]
        joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
        self.fast = None
        if [vocabulary.get(m) for m in joined] == list(range(256, 256 + len(joined))):
            self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in enumerate(self.bytes) if b}, special_tokens={})

    def encode(self, segments: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]
        encode = self.fast.encode_ordinary
        out = [encode(s) if s.isascii() or max(s) < SETTLED else None for s in segments]
        left = [k for k, ids in enumerate(out) if ids is None]
        for k, e in zip(left, self.tokenizer.encode_batch_fast([segments[k] for k in left], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out


class Pieces:
    """Tokenizer B: a ``sentencepiece`` model, which adds a space before what it is given."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.bytes = [bytes([int(self.model.id_to_piece(i)[3:-1], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode("utf-8") for i in range(n)]
        self.space = self.model.piece_to_id("▁")

    def encode(self, segments: list[str]) -> list[list[int]]:
        """Each segment begins with the space that the model adds; a lone space can't be asked for."""
        found = self.model.encode([s[1:] for s in segments], num_threads=1)
        return [[self.space] if s == " " else ids for s, ids in zip(segments, found, strict=True)]


class _Kind:
    """Tokens of remembered segments, end to end."""

    def __init__(self, tokenizer: ByteLevel | Pieces):
        self.tokenizer = tokenizer
        self.lengths = np.array([len(b) for b in tokenizer.bytes], dtype=np.int64)
        self.clear()

    def clear(self) -> None:
        self.ids, self.starts, self.used, self.n = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64), 0, 0

    def add(self, segments: list[str], raw: list[bytes]) -> np.ndarray:
        """Remember the segments' tokens; which of them the tokens give back byte by byte."""
        found = self.tokenizer.encode(segments)
        piece = self.tokenizer.bytes
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        total = int(sizes.sum())
        for name, least in (("ids", self.used + total), ("starts", self.n + len(found) + 1)):
            if least > len(getattr(self, name)):
                setattr(self, name, np.resize(getattr(self, name), 2 * least))
        self.ids[self.used : self.used + total] = [i for x in found for i in x]
        self.starts[self.n + 1 : self.n + 1 + len(found)] = self.used + np.cumsum(sizes)
        self.used, self.n = self.used + total, self.n + len(found)
        return np.array([b"".join(map(piece.__getitem__, ids)) == r for ids, r in zip(found, raw, strict=True)], dtype=bool)

    def tokens(self, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these segments, and how many each has."""
        size = self.starts[segments + 1] - self.starts[segments]
        ends = np.cumsum(size)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - self.starts[segments], size)], size


def segments_of(text: str) -> list[str]:
    """The text after a space, cut before each space that no token crosses; the segments' first spaces are left out."""
    words = text.split(" ")
    if not _ODD.search(" " + text):
        return words
    out, held = [], []
    for word in words:
        if held and (last := held[-1]) and (last[-1].isalnum() or "!" <= last[-1] <= "~"):
            out.append(" ".join(held))
            held = []
        held.append(word)
    return [*out, " ".join(held)]


class Aligner:
    """Aligns texts, several at a time; the memo of segments lasts as long as the worker."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = _Kind(a), _Kind(b)
        if max(len(a.bytes), len(b.bytes)) > 1 << ID_BITS:
            raise ValueError(f"ids beyond {ID_BITS} bits")
        self.names = [_written(len(k.lengths), *ends) for k, ends in ((self.a, b",|"), (self.b, b",;"))]
        self.clear()

    def clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.same = np.zeros(0, dtype=bool)
        self.a.clear()
        self.b.clear()

    def _segments(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the segments of the texts, and how many each has; none for a text that a tokenizer changes."""
        if len(self.memo) > MEMO:
            self.clear()
        memo, split = self.memo, [segments_of(t) if t else [] for t in texts]
        if new := list(dict.fromkeys(s for words in split for s in words if s not in memo)):
            spaced = [" " + s for s in new]
            raw = [s.encode("utf-8") for s in spaced]
            self.same = np.concatenate([self.same, self.a.add(spaced, raw) & self.b.add(spaced, raw)])
            memo.update(zip(new, range(len(memo), len(memo) + len(new)), strict=True))
        numbers = [np.fromiter(map(memo.__getitem__, words), np.int64, len(words)) for words in split]
        numbers = [x if self.same[x].all() else x[:0] for x in numbers]
        out = np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64)
        if sum(map(len, new)) > MEMO_BYTES * MEMO // 8:  # very long segments aren't kept
            found = [k.tokens(out) for k in (self.a, self.b)]
            self.clear()
            return (*found, np.array([len(x) for x in numbers]))
        return (self.a.tokens(out), self.b.tokens(out), np.array([len(x) for x in numbers], dtype=np.int64))

    def align(self, texts: list[str]) -> dict[str, np.ndarray | list[str]]:
        """Figures and digests by text; ``pairs`` (in order, by text) with ``times``, ``n_pairs`` of each text."""
        (ids_a, size_a), (ids_b, size_b), n_segments = self._segments(texts)
        upto = np.concatenate([[0], np.cumsum(n_segments)])
        last_a, last_b = (np.concatenate([[0], np.cumsum(size)])[upto] for size in (size_a, size_b))  # tokens up to each text's end
        ends_a, ends_b = common_ends(np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.b.lengths[ids_b]))
        last = np.searchsorted(ends_a, last_a, side="right")  # groups up to each text's end
        out = {"n_a": np.diff(last_a), "n_b": np.diff(last_b), "n_groups": np.diff(last)}
        of = np.repeat(np.arange(len(texts)), out["n_groups"])
        n, pairs, times = linked_pairs(of, ids_a, ids_b, ends_a, ends_b)
        n_links = np.zeros(len(texts), dtype=np.int64)
        np.add.at(n_links, n, times)
        written = self._written(ids_a, ids_b, ends_a, ends_b)
        digests = []
        for k in range(len(texts)):
            part = written(last_a[k], last_b[k], last_a[k + 1], last_b[k + 1])
            digests.append(hashlib.sha256(part).hexdigest() if part else "")
        return out | {"n_links": n_links, "n_pairs": np.bincount(n, minlength=len(texts)), "pairs": pairs, "times": times, "digests": digests}

    def _written(self, ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray):
        """A function that gives ``a1,a2|b1;a3|b2,b3`` for the groups between two places."""
        n_a, n_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        (signs_a, width_a), (signs_b, width_b) = self.names
        signs = np.zeros((len(ids_a) + len(ids_b), max(signs_a.shape[2], signs_b.shape[2])), dtype=np.uint8)
        widths = np.zeros(len(signs), dtype=np.int64)
        for ids, ends, place, table, width in (
            (ids_a, ends_a, np.arange(len(ids_a)) + np.repeat(ends_b - n_b, n_a), signs_a, width_a),
            (ids_b, ends_b, np.arange(len(ids_b)) + np.repeat(ends_a, n_b), signs_b, width_b),
        ):
            final = np.zeros(len(ids), dtype=np.int64)
            final[ends - 1] = 1
            signs[place, : table.shape[2]] = table[final, ids]
            widths[place] = width[ids]
        text, upto = signs[signs > 0].tobytes(), np.concatenate([[0], np.cumsum(widths)])
        return lambda a0, b0, a1, b1: text[upto[a0 + b0] : max(upto[a0 + b0], upto[a1 + b1] - 1)]


def _written(n: int, inside: int, final: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal signs of 0..n-1, each with the sign that follows it inside a list and at its end, and their widths."""
    numbers = [str(i).encode("ascii") for i in range(n)]
    width = max(map(len, numbers)) + 1
    table = [np.frombuffer(b"".join((x + bytes([sign])).ljust(width, b"\0") for x in numbers), dtype=np.uint8).reshape(n, width) for sign in (inside, final)]
    return np.stack(table), np.array([len(x) + 1 for x in numbers])


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two rising arrays with the same last number -> for each group, how many tokens of ``a`` and of ``b`` are over at its end.

    ``a[i:]`` and ``b[j:]`` are compared at the current shift ``j - i`` by probes that double while they
    agree (the first ones token by token), and halve to the first token that differs; then the token
    that ends first is passed over until the ends meet, and the shift is the new ``j - i``.
    """
    n = len(ends_a)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    raw_a, raw_b = ends_a.tobytes(), ends_b.tobytes()
    a, b = memoryview(raw_a).cast("q"), memoryview(raw_b).cast("q")
    run_a, run_b, run_end = [0], [0], []  # one-to-one stretches
    i = j = 0
    while i < n:
        x, y = a[i], b[j]
        if x == y:
            head = i + HEAD
            i, j = i + 1, j + 1
            while i < n and i < head and a[i] == b[j]:
                i, j = i + 1, j + 1
            if i == head:
                step = HEAD
                while i + step <= n and raw_a[8 * i : 8 * (i + step)] == raw_b[8 * j : 8 * (j + step)]:
                    i, j, step = i + step, j + step, 2 * step
                while step > 1:
                    step //= 2
                    if i + step <= n and raw_a[8 * i : 8 * (i + step)] == raw_b[8 * j : 8 * (j + step)]:
                        i, j = i + step, j + step
            continue
        run_end.append(i)
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i, j = i + 1, j + 1
        run_a.append(i)
        run_b.append(j)
    run_end.append(n)
    # each stretch ends a group with each of its tokens; each but the first has an irregular group before it
    start_a, start_b = np.array(run_a), np.array(run_b)
    size = np.array(run_end) - start_a + 1
    size[0] -= 1
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    within[: size[0]] += 1
    return np.repeat(start_a, size) + within, np.repeat(start_b, size) + within


def linked_pairs(of: np.ndarray, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, pair ``a << 32 | b`` of ids that share a group and number of links, for groups of the texts ``of``; in order."""
    n_a, n_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    links = n_a * n_b
    narrow = np.flatnonzero(links <= WIDE)
    size = links[narrow]
    upto = np.cumsum(size)
    k = np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - size, size)
    width = np.repeat(n_b[narrow], size)
    at_a = np.repeat((ends_a - n_a)[narrow], size) + k // width
    at_b = np.repeat((ends_b - n_b)[narrow], size) + k % width
    code = lambda text, x, y: (text << 2 * ID_BITS) | (x << ID_BITS) | y
    codes, times = np.unique(code(np.repeat(of[narrow], size), a[at_a], b[at_b]), return_counts=True)
    if len(narrow) < len(links):  # groups of many tokens and few different ids
        found, counts = [codes], [times]
        for g in np.flatnonzero(links > WIDE).tolist():
            ids_a, c_a = np.unique(a[ends_a[g] - n_a[g] : ends_a[g]], return_counts=True)
            ids_b, c_b = np.unique(b[ends_b[g] - n_b[g] : ends_b[g]], return_counts=True)
            found.append(code(of[g], ids_a[:, None], ids_b).reshape(-1))
            counts.append((c_a[:, None] * c_b).reshape(-1))
        codes, inverse = np.unique(np.concatenate(found), return_inverse=True)
        times = np.zeros(len(codes), dtype=np.int64)
        np.add.at(times, inverse, np.concatenate(counts))
    mask = (1 << ID_BITS) - 1
    return codes >> 2 * ID_BITS, ((codes >> ID_BITS) & mask) << 32 | (codes & mask), times


_FIGURES = ("n_a", "n_b", "n_groups", "n_links")


@functools.lru_cache(maxsize=1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(ByteLevel(a_path), Pieces(b_path))


def _aligned(a_path: str, b_path: str):
    """Texts -> a row per document, in ``held`` the places of its pairs among its block's, and a row per pair of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, found, size, kind = TaskContext.get().partitionId() << 32, [], [], 0, None

        def rows() -> Iterator[pa.RecordBatch]:
            joined = {c: np.concatenate([f[c] for f in found]) for c in (*_FIGURES, "n_pairs", "pairs", "times")}
            pairs, held = np.unique(joined["pairs"], return_inverse=True)
            upto = pa.array(np.concatenate([[0], np.cumsum(joined["n_pairs"])]), pa.int32())
            lists = {c: pa.ListArray.from_arrays(upto, pa.array(v, pa.int32())) for c, v in (("held", held), ("times", joined["times"]))}
            docs = {"id": pa.concat_arrays(ids), "groups_sha256": pa.array([d for f in found for d in f["digests"]], pa.string()), **{c: pa.array(joined[c], pa.int64()) for c in _FIGURES}, **lists}
            places = {"place": pa.array(np.arange(len(pairs)), pa.int32()), "pair": pa.array(pairs, pa.int64()), "docs": pa.array(np.bincount(held, minlength=len(pairs)), pa.int32())}
            types = {c: v.type for c, v in (docs | places).items()}
            for part in (docs, places):
                n = len(next(iter(part.values())))
                columns = {"block": pa.array(np.full(n, block), pa.int64())} | {c: part[c] if c in part else pa.nulls(n, t) for c, t in types.items()}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        for batch in batches:
            kind = batch.column("id").type
            at = 0
            while at < batch.num_rows:
                texts, length = [], 0
                while at + len(texts) < batch.num_rows and (not texts or (length < CHUNK and len(texts) < 1 << 62 - 2 * ID_BITS)):
                    texts.append(batch.column("text")[at + len(texts)].as_py() or "")
                    length += len(texts[-1])
                if found and size + length > BLOCK:
                    yield from rows()
                    block, ids, found, size = block + 1, [], [], 0
                ids.append(batch.column("id").slice(at, len(texts)))
                found.append(_aligner(a_path, b_path).align(texts))
                at, size = at + len(texts), size + length
        if found:
            yield from rows()

    return run


def _summed(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of a block and the counts of its pairs -> a row per document."""
    place = answers.column("place").to_numpy()
    counts, is_best = np.empty(len(place), dtype=np.int64), np.empty(len(place), dtype=bool)
    counts[place], is_best[place] = answers.column("n").to_numpy(), answers.column("is_best").to_numpy()
    lists = docs.column("held").combine_chunks()
    held, times = lists.flatten().to_numpy(), docs.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    total = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[upto]), pa.int64())
    values = {"id": docs.column("id"), **{c: docs.column(c) for c in _FIGURES}, "n_best": total(np.where(is_best[held], times, 0)), "count_sum": total(times * counts[held])}
    return pa.table(values | {"groups_sha256": docs.column("groups_sha256")})


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs``.

    ``a_path`` (byte-level BPE) and ``b_path`` (sentencepiece) are files that every executor finds at the
    same place. A null or empty text, and one that a tokenizer changes, has no tokens: zeros and an empty
    digest. A pair's count is the number of rows that hold it, so repeated rows count each; a null id is
    kept; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    figures = ", ".join(f"{c} long" for c in _FIGURES)
    blocks = rows.mapInArrow(_aligned(a_path, b_path), f"block long, id {kind}, groups_sha256 string, {figures}, held array<int>, times array<int>, place int, pair long, docs int")
    blocks = materialize(blocks, "aligned-blocks")
    asked = blocks.where("place IS NOT NULL").select("block", "place", "pair", "docs")
    counts = asked.groupBy("pair").agg(F.sum("docs").alias("n"))
    counts = counts.withColumn("is_best", F.col("n") == F.max("n").over(Window.partitionBy(F.shiftright("pair", 32))))
    answers = asked.join(counts, "pair").select(F.col("block").alias("of"), "place", "n", "is_best")
    met = blocks.where("place IS NULL").select("block", "id", *_FIGURES, "groups_sha256", "held", "times")
    out = met.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_summed, f"id {kind}, {', '.join(f'{c} long' for c in (*_FIGURES, 'n_best', 'count_sum'))}, groups_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
