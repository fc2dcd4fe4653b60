"""Document fingerprints of improbable features.

A feature is a window of ``WINDOW`` bytes. Its entropy, scaled to levels 0..``LEVELS``, is the more
telling the fewer windows of the whole corpus have that level; the level counts of all documents give
the ranks. Sliding over ``WINDOW`` neighbouring features, the rarest (leftmost) scores a point; features
with at least ``POPULAR`` points are selected, hashed, and put into Bloom filters of ``BITS`` bits, a new
filter being chained on after ``PER_FILTER`` features. Two fingerprints are compared filter by filter:
bits in common beyond what chance gives, relative to the most there could be.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW = 64
LEVELS = 1000
POPULAR = 16
BITS, HASHES, PER_FILTER = 2048, 5, 160
#: Below this level a window is too uniform to tell anything.
WEAK = 100
#: Bytes of text that are worked on together.
BLOCK = 1 << 18

_COUNT = np.arange(WINDOW + 2, dtype=np.float64)
#: c log2 c in whole numbers, so that sums are exact; and its steps.
_TERM = np.rint(np.where(_COUNT > 0, _COUNT * np.log2(np.maximum(_COUNT, 1)), 0) * 4096).astype(np.int32)
_STEP = np.r_[0, np.diff(_TERM)].astype(np.int32)
_FULL = int(_TERM[WINDOW])


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """The entropy level of the window that starts at each place (len(data) - WINDOW + 1 of them)."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, dtype=np.int32)
    # how often a byte occurs among the WINDOW bytes that end, or that start, with it
    back, fwd = np.ones(n, dtype=np.uint8), np.ones(n, dtype=np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        back[d:] += same
        fwd[:-d] += same
    first = int(_TERM[np.bincount(data[:WINDOW], minlength=256)].sum())
    m = n - WINDOW
    # the byte that leaves has count fwd in the old window, the byte that enters count back in the new
    total = np.empty(m + 1, dtype=np.int64)
    total[0] = first
    np.cumsum(_STEP[back[WINDOW:]] - _STEP[fwd[:m]], out=total[1:])
    total[1:] += first
    return (((_FULL - total) * LEVELS) // _FULL).astype(np.int32)


def _joined(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts glued in blocks of about ``BLOCK`` bytes: number of the first, all bytes, bounds of each."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
            size += len(texts[end])
            end += 1
        yield at, np.frombuffer(b"".join(texts[at:end]), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts[at:end]])])
        at = end


def _owners(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window start of the glued bytes its text, and whether the window stays inside it."""
    n = int(bounds[-1])
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: max(0, n - WINDOW + 1)]
    return owner, np.arange(len(owner)) + WINDOW <= bounds[owner + 1]


def level_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``level, n``: how many windows of all documents have each entropy level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LEVELS + 1, dtype=np.int64)
        for batch in batches:
            for _, data, bounds in _joined([(t.as_py() or "").encode("utf-8") for t in batch.column("text")]):
                _, whole = _owners(bounds)
                counts += np.bincount(entropy_levels(data)[whole], minlength=LEVELS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS + 1), pa.int32()), pa.array(counts)], names=["level", "n"])

    return docs.select(docs[text_col].alias("text")).mapInArrow(run, "level int, n long").groupBy("level").agg(F.sum("n").alias("n"))


def rarity_ranks(docs: DataFrame, text_col: str = "text") -> list[int]:
    """Rank by level (0 is rarest); a level below ``WEAK`` or never seen ranks last. A row per level goes to the driver."""
    n = np.zeros(LEVELS + 1, dtype=np.int64)
    for level, count in level_counts(docs, text_col).collect():
        n[level] = count
    order = np.lexsort((-np.arange(LEVELS + 1), np.where((n == 0) | (np.arange(LEVELS + 1) < WEAK), np.iinfo(np.int64).max, n)))
    ranks = np.empty(LEVELS + 1, dtype=np.int64)
    ranks[order] = np.arange(LEVELS + 1)
    ranks[:WEAK] = LEVELS + 1
    return ranks.tolist()


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the window at each start."""
    windows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[starts]
    lanes = np.ascontiguousarray(windows).view("<u8")
    out = np.full(len(starts), np.uint64(0x9E3779B97F4A7C15))
    for k in range(lanes.shape[1]):
        with np.errstate(over="ignore"):
            out = _mix(out * np.uint64(0x100000001B3) ^ lanes[:, k])
    return out


def digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The chained Bloom filters of each text: a matrix of bytes, ``BITS // 8`` per filter.

    A text shorter than a window, or without a selected feature, has the hash of the whole text as
    its one feature; the empty text has no filter.
    """
    out: list[np.ndarray] = []
    for at, data, bounds in _joined(texts):
        count = len(bounds) - 1
        owner, whole = _owners(bounds)
        picked = np.zeros(0, dtype=np.int64)
        if len(owner):
            rank = ranks[entropy_levels(data)]
            worst = LEVELS + 1
            rank = np.where(whole, rank, worst)
            # leftmost rarest of WINDOW neighbouring features, by doubling; windows of features stay inside a text
            key = rank << np.int64(32) | np.arange(len(rank))
            width = 1
            while width < WINDOW:
                key = np.minimum(key[: len(key) - width], key[width:]) if len(key) > width else key[:0]
                width *= 2
            inside = np.arange(len(key))
            inside = (owner[inside] == owner[inside + WINDOW - 1]) & whole[inside + WINDOW - 1]
            key = key[inside]
            best = key & np.int64(0xFFFFFFFF)
            points = np.bincount(best[(key >> np.int64(32)) < worst], minlength=len(rank))
            picked = np.flatnonzero(points >= POPULAR)
            # texts too short for many neighbours keep their rarest feature
        text = owner[picked] if len(picked) else np.zeros(0, dtype=np.int64)
        hashes = _hashes(data, picked) if len(picked) else np.zeros(0, dtype=np.uint64)
        missing = np.flatnonzero((np.bincount(text, minlength=count) == 0) & (np.diff(bounds) > 0))
        if len(missing):
            extra = [int.from_bytes(hashlib.sha1(texts[at + i]).digest()[:8], "little") for i in missing]
            text, hashes = np.concatenate([text, missing]), np.concatenate([hashes, np.array(extra, dtype=np.uint64)])
            order = np.argsort(text, kind="stable")
            text, hashes = text[order], hashes[order]
        number = np.bincount(text, minlength=count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
        filters = -(-number // PER_FILTER)
        base = np.concatenate([[0], np.cumsum(filters)])
        row = base[text] + nth // PER_FILTER
        bits = np.zeros((int(base[-1]), BITS), dtype=bool)
        for k in range(HASHES):
            bits[row, ((hashes >> np.uint64(11 * k)) % np.uint64(BITS)).astype(np.int64)] = True
        packed = np.packbits(bits, axis=1)
        out += [packed[base[i] : base[i + 1]] for i in range(count)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of the fingerprint with fewer filters, its best overlap with the other, averaged.

    An overlap counts from what two unrelated filters of those sizes share by chance (and three
    standard deviations more) up to what the smaller could share. Two empty fingerprints are alike.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if (len(a), a.tobytes()) > (len(b), b.tobytes()):
        a, b = b, a
    if a.shape == b.shape and (a == b).all():
        return 1.0
    ones_a, ones_b = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    scores = np.zeros(len(a))
    for i in range(len(a)):
        common = np.bitwise_count(a[i] & b).sum(axis=1, dtype=np.int64)
        most = np.minimum(ones_a[i], ones_b)
        chance = ones_a[i] * ones_b / BITS
        floor = chance + 3 * np.sqrt(chance)
        # a filter that is not full (the last) may have all its few bits in the other by chance
        scores[i] = np.max(np.where(most > floor, np.clip((common - floor) / np.maximum(most - floor, 1e-9), 0, 1), 0))
    return float(np.average(scores, weights=ones_a))


def encode(filters: np.ndarray) -> str:
    """Number of filters, then their bytes in base64."""
    return f"{len(filters)}:{base64.b64encode(filters.tobytes()).decode()}"


def decode(fingerprint: str) -> np.ndarray:
    count, _, body = fingerprint.partition(":")
    return np.frombuffer(base64.b64decode(body), dtype=np.uint8).reshape(int(count), BITS // 8)


def fingerprint_documents(docs: DataFrame, ranks: list[int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, n_features_filters`` of every row, by ranks that default to those of ``docs``.

    A null text is empty; equal texts have equal fingerprints under the same ranks.
    """
    ranks = rarity_ranks(docs, text_col) if ranks is None else ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.array(ranks, dtype=np.int64)
        for batch in batches:
            found = digests([(t.as_py() or "").encode("utf-8") for t in batch.column("text")], rank)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([encode(f) for f in found]), pa.array([len(f) for f in found], pa.int64())], names=["id", "fingerprint", "n_filters"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string, n_filters long").withColumnRenamed("id", id_col)


def with_neighbours(docs: DataFrame, slices: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt to slices by id, so that each slice, read in order, has every row's next row.

    Columns ``slice, late, id, text``, sorted by them with ids descending. The first row of a slice
    also ends the slice before it, and the first of all ends the last, both with ``late`` true. Ids are
    numbers. Only ids are looked at to find the slices, which have about equally many rows; ranges of
    slices go to tasks, and each text moves once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = rows.select("id").agg(F.percentile_approx("id", [k / slices for k in range(1, slices)] or [0.5], F.lit(max(1000, 20 * slices)))).first()[0] or []
    cuts = sorted(set(cuts)) if slices > 1 else []
    # slice 0 has the largest ids; a null id stands last
    above = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: F.col("id") >= c)) if cuts else F.lit(0)
    own = F.coalesce(F.when(F.col("id").isNotNull(), F.lit(len(cuts)) - above), F.lit(len(cuts))).cast("int")
    ids = rows.select("id").withColumn("slice", own).groupBy("slice").agg(F.max("id").alias("first")).orderBy("slice").collect()  # a row per slice
    before = {r["first"]: ids[k - 1]["slice"] for k, r in enumerate(ids)}  # the first slice's row goes to the last
    known = [x for pair in before.items() if pair[0] is not None for x in pair]
    extra = F.try_element_at(F.create_map(*map(F.lit, known)), F.col("id")) if known else F.lit(None).cast("int")
    if None in before:
        extra = F.when(F.col("id").isNull(), before[None]).otherwise(extra)
    both = F.filter(F.array(F.struct(own.alias("slice"), F.lit(False).alias("late")), F.struct(extra.cast("int").alias("slice"), F.lit(True).alias("late"))), lambda x: x["slice"].isNotNull())
    dealt = rows.select("id", "text", F.explode(both).alias("to")).select("to.slice", "to.late", "id", "text")
    return dealt.repartitionByRange(slices, "slice").sortWithinPartitions("slice", "late", F.desc("id"), "text")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: list[int] | None = None) -> DataFrame:
    """Fingerprint every text and its edited text, and compare them and the next document.

    The edited text has its last ``floor(n_chars / 3)`` code points replaced by the first as many (or
    all) of the next document in descending id order (rows of one id: by text; after the last: the
    first). A null text is empty; a null id stands last; other columns are ignored; an empty table
    gives no rows; a table of one row is its own next. Ids are numbers.
    """
    ranks = rarity_ranks(docs, text_col) if ranks is None else ranks
    slices = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.array(ranks, dtype=np.int64)
        held: tuple | None = None  # the last row, which waits for its next: slice, id, text, filters

        def done(rows: list[tuple]) -> pa.RecordBatch:
            """rows: (id, text, filters, next text, next filters)"""
            edited = [t[: len(t) - len(t) // 3] + (nxt[: len(t) // 3]) for _, t, _, nxt, _ in rows]
            raw = [e.encode("utf-8") for e in edited]
            changed = digests(raw, rank)
            columns = [
                [r[0] for r in rows], [len(r[1]) for r in rows], [hashlib.sha256(e).hexdigest() for e in raw], [encode(r[2]) for r in rows], [encode(c) for c in changed],
                [likeness(r[2], c) for r, c in zip(rows, changed, strict=True)], [likeness(r[2], r[4]) for r in rows],
            ]
            types = [("id", pa.int64()), *kinds]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True)], names=[n for n, _ in types])

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                slices_, late, ids, texts = (part.column(c).to_pylist() for c in ("slice", "late", "id", "text"))
                found = digests([t.encode("utf-8") for t in texts], rank)
                rows = []
                for s, is_late, i, t, f in zip(slices_, late, ids, texts, found, strict=True):
                    if held is not None and held[0] == s:
                        rows.append((held[1], held[2], held[3], t, f))
                    held = None if is_late else (s, i, t, f)
                if rows:
                    yield done(rows)

    out = with_neighbours(docs, slices, id_col, text_col).mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)


def op5_rare_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(table(spark, sf_dir, "documents"))
