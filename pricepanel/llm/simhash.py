"""SimHash near-duplicates by a binary trie self-join.

Distinct 64-bit fingerprints are the leaves of a binary trie. Node pairs are traversed together from
the top: a pair carries the number of bits in which its paths differ and goes once that exceeds the
error budget. Of three parts of the bits, one differs in at most ``MAX_BITS // 3`` bits where two
fingerprints differ in at most ``MAX_BITS``; so three tries are traversed, each with another part
leading, with that smaller budget for the leading part. The top levels of a trie are dealt to tasks
by prefix: a fingerprint goes to its own prefix and, as a guest, to the prefixes that lack one of
its set bits. What a task finds leaves it as a forest, so the links are linear in the fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import materialize, table
from .components import connected_components

MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: Leading bits and width of the three parts, each leading in one trie.
PARTS = ((0, 21), (21, 21), (42, 22))
LEAD_BUDGET = MAX_BITS // len(PARTS)
#: Fingerprints aimed at per prefix.
BUCKET = 1024
#: Fingerprints a task traverses together; whole prefixes, so more only where one prefix has more.
BLOCK = 200_000
#: Node pairs traversed at once.
FRONTIER = 1_000_000


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-SHINGLE]]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # long texts in pieces
        part = np.array(hashes[at : at + 65536], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp`` (fp as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest element that each of 0..n-1 is linked with."""
    label = np.arange(n)
    while len(u):
        np.minimum.at(label, u, label[v])
        np.minimum.at(label, v, label[u])
        while (label[label] != label).any():
            label = label[label]
        open_ = label[u] != label[v]
        u, v = label[u[open_]], label[v[open_]]
    return label


def trie_links(values: np.ndarray, homes: np.ndarray, guests: np.ndarray, depth: int, width: int, budget: int = MAX_BITS, lead_budget: int = LEAD_BUDGET) -> np.ndarray:
    """The smallest element that each element of ``values`` is linked with, directly or by others.

    ``values``: unsigned, sorted within each range; ``homes``: ranges [lo, hi) of values with one
    prefix of ``depth`` bits; ``guests``: a home range and a range of values with one other prefix,
    which differs in one bit, in each row (a range of several prefixes is not sorted by its lower
    bits and cannot be split). ``width``: bits of the leading part.
    """
    n = len(values)
    bit = lambda d: ((values >> np.uint64(63 - d)) & np.uint64(1)).astype(np.int64)
    edge = np.zeros(n, dtype=bool)  # a range begins here
    edge[homes[homes[:, 0] < n, 0]] = edge[guests[guests[:, 2] < n, 2]] = True
    near = np.flatnonzero((np.bitwise_count(values[1:] ^ values[:-1]) <= budget) & ~edge[1:])
    found = [(near, near + 1)]
    # neighbours in order are linked first: a node pair inside one component need not be opened
    group = _components(n, near, near + 1)
    changes = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])])
    ones: dict[int, np.ndarray] = {}
    start = np.concatenate([np.column_stack([homes, homes, np.zeros(len(homes), dtype=np.int64)]), np.column_stack([guests, np.ones(len(guests), dtype=np.int64)])])
    stack = [(depth, start)]
    while stack:
        d, pairs = stack.pop()
        a, a_end, b, b_end, off = pairs.T
        live = (a_end > a) & (b_end > b) & ~((a == b) & (a_end - a < 2)) & (off <= (lead_budget if d <= width else budget))
        last_a, last_b = np.maximum(a_end - 1, 0), np.maximum(b_end - 1, 0)
        live[live] &= ~((changes[last_a] == changes[a.clip(max=n - 1)]) & (changes[last_b] == changes[b.clip(max=n - 1)]) & (group[a.clip(max=n - 1)] == group[b.clip(max=n - 1)]))[live]
        pairs = pairs[live]
        if not len(pairs):
            continue
        if len(pairs) > FRONTIER:
            stack += [(d, x) for x in np.array_split(pairs, math.ceil(len(pairs) / FRONTIER))]
            continue
        a, a_end, b, b_end, off = pairs.T
        size = (a_end - a) * (b_end - b)
        leaf = (size <= 8) | (d == 64)
        if leaf.any():
            # leaves: the rest of the bits is compared at once
            la, lb, nb, s = a[leaf], b[leaf], (b_end - b)[leaf], size[leaf]
            cum = np.cumsum(s)
            for k in range(0, len(s), 200_000):
                part = slice(k, k + 200_000)
                base = cum[part] - s[part]
                index = np.arange(int(s[part].sum())) - np.repeat(base - base[0], s[part])
                i = np.repeat(la[part], s[part]) + index // np.repeat(nb[part], s[part])
                j = np.repeat(lb[part], s[part]) + index % np.repeat(nb[part], s[part])
                hit = (np.bitwise_count(values[i] ^ values[j]) <= budget) & (i != j)
                found.append((i[hit], j[hit]))
            pairs = pairs[~leaf]
            if not len(pairs):
                continue
            a, a_end, b, b_end, off = pairs.T
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum(bit(d))])
        c = ones[d]
        a_mid, b_mid = a_end - (c[a_end] - c[a]), b_end - (c[b_end] - c[b])
        same = (a == b) & (a_end == b_end)
        children = [
            np.column_stack([a, a_mid, b, b_mid, off]), np.column_stack([a_mid, a_end, b_mid, b_end, off]),
            np.column_stack([a, a_mid, b_mid, b_end, off + 1]), np.column_stack([a_mid, a_end, b, b_mid, off + 1])[~same],
        ]
        stack.append((d + 1, np.concatenate(children)))
    return _components(n, np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))


def _join_prefixes(depth: int):
    def block(trie: np.ndarray, prefix: np.ndarray, guest: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        us, vs = [], []
        for r, (lead, width) in enumerate(PARTS):
            mine = trie == r
            if not mine.any():
                continue
            key, away, v = prefix[mine], guest[mine], value[mine].view(np.uint64)
            order = np.lexsort((v, away, key))
            key, away, v = key[order], away[order], v[order]
            # a range for each prefix at home (bit -1) and for each bit in which its guests differ
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (away[1:] != away[:-1])])
            ranges = np.column_stack([starts, np.r_[starts[1:], len(key)]])
            at_home = away[starts] < 0
            host = np.maximum.accumulate(np.where(at_home, np.arange(len(starts)), -1))
            visits = np.flatnonzero(~at_home & (host >= 0))
            visits = visits[key[starts[visits]] == key[starts[host[visits]]]]  # the prefix has values of its own
            label = trie_links(v, ranges[at_home], np.column_stack([ranges[host[visits]], ranges[visits]]), depth, width)
            linked = np.flatnonzero(label != np.arange(len(label)))
            back = np.uint64(lead)  # turn the leading part back to its place
            turn = lambda x: (x >> back) | (x << (np.uint64(64) - back)) if back else x
            us.append(turn(v[linked]))
            vs.append(turn(v[label[linked]]))
        none = np.zeros(0, dtype=np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *x]).view(np.int64)) for x in (us, vs)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("trie", "prefix", "guest", "value")])
            size += batch.num_rows
            if size >= BLOCK:
                trie, prefix, guest, value = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = np.flatnonzero((prefix != prefix[-1]) | (trie != trie[-1]))  # the last prefix may go on
                cut = int(cut[-1]) + 1 if len(cut) else 0
                if cut:
                    yield block(trie[:cut], prefix[:cut], guest[:cut], value[:cut])
                held, size = [[x[cut:] for x in (trie, prefix, guest, value)]], size - cut
        if size:
            yield block(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def trie_self_join(fps: DataFrame, count: int) -> DataFrame:
    """``u, v`` edges whose components are those of all pairs of ``fps.fp`` within ``MAX_BITS`` bits."""
    depth = min(PARTS[0][1], max(0, math.ceil(math.log2(max(1, count) / BUCKET))))
    tries = F.explode(F.array(*[F.struct(F.lit(r).alias("trie"), (F.expr(f"shiftleft(fp, {lead}) | shiftrightunsigned(fp, {64 - lead})") if lead else F.col("fp")).alias("value")) for r, (lead, _) in enumerate(PARTS)]))
    rows = fps.select(tries.alias("t")).select("t.trie", "t.value")
    rows = rows.withColumn("own", F.expr(f"shiftrightunsigned(value, {64 - depth})") if depth else F.lit(0).cast("long"))
    rows = rows.select("trie", "value", "own", F.explode(F.sequence(F.lit(-1), F.lit(depth - 1))).alias("bit"))
    rows = rows.where("bit < 0 OR (shiftright(own, bit) & 1) = 1")
    prefix = F.expr("CASE WHEN bit < 0 THEN own ELSE own ^ shiftleft(CAST(1 AS BIGINT), bit) END")
    rows = rows.select("trie", prefix.alias("prefix"), F.col("bit").alias("guest"), "value")
    dealt = rows.repartition("trie", "prefix").sortWithinPartitions("trie", "prefix")
    return dealt.mapInArrow(_join_prefixes(depth), "u long, v long")


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, fp, root, component_id`` of every row; ``root`` tells components apart."""
    marked = materialize(fingerprints(docs, id_col, text_col), "simhash")
    fps = materialize(marked.groupBy("fp").agg(F.min("id").alias("least")), "simhash-fps")
    roots = connected_components(trie_self_join(fps.select("fp"), fps.count()))
    placed = fps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = materialize(placed, "simhash-roots")
    # written, so that the join's partitions are the join's own and a large component's can be split
    smallest = materialize(placed.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-smallest")
    by_fp = placed.join(smallest, "root").select("fp", "root", "component_id")
    return marked.join(by_fp, "fp").select("id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    A null or empty text has fingerprint zero, which is linked like any other. Repeated rows give
    repeated results of one component; a null id takes part and is never a component's id unless it
    has no other; other columns are ignored; an empty table gives no rows.
    """
    placed = _placed(docs, id_col, text_col)
    return placed.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _with_fingerprint(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` of ``row, own`` with the fingerprint of the row's text as ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column("row").field(text_col)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], names=[*batch.schema.names, "fp"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("fp", LongType())]))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate component, one of its smallest id, with the columns of ``docs``, whatever their names.

    An id whose rows have different texts is kept once for each component that it is the smallest of;
    of equal rows one stays; of rows of one id and fingerprint that differ elsewhere, any one. A null or
    empty text has fingerprint zero; an empty table gives no rows.
    """
    placed = materialize(_placed(docs, id_col, text_col), "simhash-placed")
    stay = placed.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("component_id").alias("stay"), F.min("fp").alias("stay_fp"))
    stay = materialize(stay.select("stay", "stay_fp"), "simhash-stay")
    # the id tells the row, save where rows of one id have several fingerprints
    several = placed.groupBy("id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select(F.col("id").alias("several"))
    several = materialize(several, "simhash-several")
    is_several = F.col("stay").eqNullSafe(F.col("several"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("own"))
    mine = F.col("own").eqNullSafe(F.col("stay"))
    single = rows.join(stay.join(several, is_several, "left_anti"), mine, "left_semi").dropDuplicates(["own"])
    shared = _with_fingerprint(rows.join(stay.join(several, is_several, "left_semi"), mine, "left_semi"), text_col)
    shared = shared.join(stay, mine & (F.col("fp") == F.col("stay_fp")), "left_semi").dropDuplicates(["own", "fp"]).drop("fp")
    return single.unionByName(shared).select("row.*")


def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
