"""Ranked lexical search without an index: one Aho-Corasick automaton of all item terms reads the texts.

The terms of the items (the queries) stand between guards in the automaton, so a term is found only as
a whole run of letters and digits, and one pass over a text counts all of them at once. The automaton
is sent to all tasks, together with the lists of items that hold each term; those turn the counts of a
document into its scores for all items. The corpus is read twice: for the statistics (documents, length,
document frequencies), which are sums over the tasks, and for the scores, of which a task keeps the best
per item. Items are taken in blocks of bounded size, so what is broadcast does not grow with them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Results per item.
TOP = 10
#: Bytes of item texts searched together; an item beyond it is a block of its own.
BLOCK = 4 << 20
#: Length normalisation in hundredths, and the scale of weights and of term frequencies (fixed values).
B_PERCENT, WEIGHT_SCALE, TF_SCALE = 90, 1000, 1_000_000_000
#: Candidates per item, in multiples of the results, that a task holds before it drops the lesser ones.
SLACK = 8

#: Everything that is no letter or digit of ASCII and no byte of a longer character becomes a guard.
_GUARDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def guarded(text: bytes | None) -> bytes:
    """The text in lower case (A-Z only) with a guard at either end and for each byte that is in no term."""
    return b" " + (text or b"").translate(_GUARDED) + b" "


def n_terms(text: bytes) -> int:
    """Terms with repeats of a guarded text."""
    gap = np.frombuffer(text, dtype=np.uint8) == 32
    return int(np.count_nonzero(gap[:-1] & ~gap[1:]))


class TermAutomaton:
    """The different terms of some items, found in guarded texts."""

    def __init__(self, items: list[tuple[object, list[bytes]]]):
        self.ids = [i for i, _ in items]
        held = [set(b" ".join(map(guarded, texts)).split()) for _, texts in items]
        self.terms = sorted(set().union(*held))
        number = {t: k for k, t in enumerate(self.terms)}
        pairs = np.array(sorted((number[t], k) for k, terms in enumerate(held) for t in terms), dtype=np.int64).reshape(-1, 2)
        self.items = pairs[:, 1]
        self.starts = np.searchsorted(pairs[:, 0], np.arange(len(self.terms) + 1))
        self.automaton = ahocorasick.Automaton()
        for k, t in enumerate(self.terms):
            self.automaton.add_word(f" {t.decode('latin-1')} ", k)
        self.automaton.make_automaton()

    def count(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The terms that a guarded text holds, by number, and how often each occurs."""
        if not self.terms:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        found = Counter(map(itemgetter(1), self.automaton.iter(text.decode("latin-1"))))
        return np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))

    def scores(self, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The sum per item of the values of the terms that it holds."""
        size = self.starts[terms + 1] - self.starts[terms]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - self.starts[terms], size)
        out = np.zeros(len(self.ids), dtype=np.int64)
        np.add.at(out, self.items[at], np.repeat(values, size))
        return out


def term_values(tf: np.ndarray, weights: np.ndarray, n: int, documents: int, length: int) -> np.ndarray:
    """What each term adds to the score of a document of ``n`` terms; whole numbers throughout."""
    m = 100 - B_PERCENT + (B_PERCENT * n * documents) // length
    return weights * ((TF_SCALE * tf) // (1000 * tf + 8 * m))


def _statistics(sent: Broadcast):
    """Texts -> per task: documents with a term (-1), terms with repeats (-2), documents by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = sent.value
        documents, length, df = 0, 0, np.zeros(len(search.terms), dtype=np.int64)
        for batch in batches:
            for text in batch.column("text"):
                text = guarded(text.as_py())
                n = n_terms(text)
                if n:
                    documents += 1
                    length += n
                    df[search.count(text)[0]] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, some]), pa.array(np.r_[documents, length, df[some]])], names=["term", "n"])

    return run


class _Best:
    """The best documents of each item so far."""

    def __init__(self, n: int, top: int):
        self.top, self.found, self.least = top, [[] for _ in range(n)], np.ones(n, dtype=np.int64)

    def add(self, scores: np.ndarray, doc: object) -> None:
        for k in np.flatnonzero(scores >= self.least).tolist():
            self.found[k].append((int(scores[k]), doc))
            if len(self.found[k]) >= SLACK * self.top:
                self.cut(k)
                self.least[k] = self.found[k][-1][0]

    def cut(self, k: int) -> None:
        self.found[k].sort(key=lambda x: (-x[0], x[1] is not None, x[1]))
        del self.found[k][self.top :]


def _scored(sent: Broadcast, weights: np.ndarray, documents: int, length: int, top: int, kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = sent.value
        best = _Best(len(search.ids), top)
        for batch in batches:
            for doc, text in zip(batch.column("id"), batch.column("text"), strict=True):
                text = guarded(text.as_py())
                terms, tf = search.count(text)
                if len(terms):
                    best.add(search.scores(terms, term_values(tf, weights[terms], n_terms(text), documents, length)), doc.as_py())
        for k, item in enumerate(search.ids):
            best.cut(k)
            if rows := best.found[k]:
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(rows), kinds[0]), pa.array([d for _, d in rows], kinds[1]), pa.array([s for s, _ in rows], pa.int64())], names=["item", "id", "score"])

    return run


def _blocks(items: DataFrame, size: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items of ``id, text`` in blocks of at most ``size`` bytes or one item; equal ids are one item."""
    of: Column
    parts = 1
    while True:
        of = F.pmod(F.xxhash64("id"), F.lit(parts))
        held = items.groupBy(of.alias("part"), "id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"))
        held = held.groupBy("part").agg(F.sum("n").alias("n"), F.count("*").alias("ids"))
        if held.where((F.col("n") > size) & (F.col("ids") > 1)).isEmpty():
            break
        parts *= 2
    for part in range(parts):
        block: dict[object, list[bytes]] = {}
        for row in items.where(of == part).select("id", F.col("text").cast("binary").alias("text")).toLocalIterator():
            block.setdefault(row["id"], []).append(bytes(row["text"] or b""))
        if block:
            yield list(block.items())


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best documents of every item, of those that score above 0.

    A null or empty text has no terms: as a document it is never found and counts in no statistic, as
    an item it finds nothing. Rows of ``items`` with one id (a null id too) are one item with the terms
    of all; every row of ``docs`` is a document, so repeated rows are repeated results, each with its
    own rank. Equal scores stand by ascending id, a null id first. Other columns are ignored; without
    documents or items there are no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))
    asked = items.select(items[item_col].alias("id"), items[item_text_col].alias("text"))
    item_kind, doc_kind = asked.schema["id"].dataType, texts.schema["id"].dataType
    schema = f"item {item_kind.simpleString()}, id {doc_kind.simpleString()}, score long"
    found = spark.createDataFrame([], schema)
    arrow_kinds = [f.type for f in found.select("item", "id").toArrow().schema]
    for part in _blocks(asked, block):
        automaton = TermAutomaton(part)
        sent = spark.sparkContext.broadcast(automaton)
        counts = dict(texts.select("text").mapInArrow(_statistics(sent), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect())  # a row per term of the block
        documents, length = counts.get(-1, 0), counts.get(-2, 0)
        if documents:
            weights = np.array([math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * counts.get(k, 0) + 1))) for k in range(len(automaton.terms))], dtype=np.int64)
            found = found.union(texts.mapInArrow(_scored(sent, weights, documents, length, top, arrow_kinds), schema))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_first())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def op13_aho_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
),
size AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n FROM doc WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM size),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM doc) GROUP BY r, term),
item AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
part AS (
    SELECT item_id, r, doc_id, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // length))) AS v
    FROM item JOIN weight USING (term) JOIN tf USING (term) JOIN size USING (r), total
),
scored AS (SELECT item_id, r, doc_id, CAST(sum(v) AS BIGINT) AS score FROM part GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""
