"""Quality classifier by co-training of a text view and a metadata view.

The text view sees what characters and words of the text do (pair frequencies of character classes,
repetition, word shapes) but not how long it is; the metadata view sees the rest of the row (language,
source and size). No feature is in both. Each view has a logistic model. Over some rounds each model
labels all unlabelled rows and hands its most confident ones, as pseudo-labels, to the other view's
training set. A quarter of the labelled rows is held out from that: one half of it calibrates each
view's scores and weighs the views by how well they do there, the other half sets the cutoff. A
document's score is the weighed sum of both views' calibrated log odds (the prior counted once).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_materialized, materialize, table

#: Most labelled rows that the models are fitted on (smallest hashes of the id).
MAX_LABELLED = 20_000
#: Rounds of exchange, and rows of each class that a view hands over in a round.
ROUNDS, HANDED = 4, 250
#: Confidence that a pseudo-label needs.
CONFIDENT = 0.95
#: Share of held-out good documents that the cutoff may reject.
FALSE_REJECTION = 0.005
#: Buckets of hashed metadata values.
META_BUCKETS = 64

# Character classes of bytes: control, newline, space, digit, upper, lower, marks at a sentence's end, comma-like,
# other ASCII marks each in one of three groups, bytes of multi-byte characters.
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[10], _CLASS[32] = 1, 2
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 3, 4, 5, 6
for _i, _marks in enumerate((b".?", b"!", b",;:'\"-()", b"#$%&*@^~", b"|<>[]{}/\\_=+`")):
    _CLASS[list(_marks)] = 7 + _i
CLASSES = 12
TEXT_FEATURES = CLASSES * CLASSES + 7
META_FEATURES = META_BUCKETS + 3


def _compressed(raw: bytes) -> int:
    """Size of the whole of ``raw`` when compressed, piece by piece."""
    packer = zlib.compressobj(1)
    return sum(len(packer.compress(raw[at : at + 65536])) for at in range(0, len(raw), 65536)) + len(packer.flush())


def text_features(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode("utf-8"), dtype=np.uint8)
    out = np.zeros(TEXT_FEATURES)
    if not len(data):
        return out
    classes = _CLASS[data]
    pairs = np.bincount(classes[:-1] * CLASSES + classes[1:], minlength=CLASSES * CLASSES)
    out[: CLASSES * CLASSES] = np.sqrt(pairs / len(data))
    raw = data.tobytes()
    words = raw.split()
    n = max(1, len(words))
    lines = raw.split(b"\n")
    out[CLASSES * CLASSES :] = (
        len(set(words)) / n, len(set(zip(words, words[1:], strict=False))) / n, len(raw) / n / 10, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(set(lines)) / len(lines), _compressed(raw) / len(raw), max(map(len, words), default=0) ** 0.5 / 10,
    )
    return out


def meta_features(lang: str | None, source: str | None, text: str | None) -> np.ndarray:
    out = np.zeros(META_FEATURES)
    for name, value in (("lang", lang), ("source", source)):
        out[zlib.crc32(f"{name}={value}".encode()) % META_BUCKETS] += 1
    size = len(text or "")
    out[META_BUCKETS:] = np.log1p(size) / 10, (np.log1p(size) / 10) ** 2, float(size == 0)
    return out


@dataclass
class View:
    """A logistic model on standardised features, with its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weight: np.ndarray | None = None) -> np.ndarray:
    """Ridge-penalised logistic weights (intercept last, unpenalised) by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x), dtype=x.dtype)])
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    w = np.zeros(x.shape[1])
    loss = lambda v: float((weight * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ v))).sum() + (penalty * v * v).sum() / 2)
    now = loss(w)
    for _ in range(40):
        p = _sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + penalty * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        now, before = loss(w), now
        if before - now < 1e-7 * max(1.0, before):
            break
    return w


def fit_view(x: np.ndarray, y: np.ndarray) -> View:
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    return View(mean, scale, fit_logistic(np.clip((x - mean) / scale, -8, 8), y))


@dataclass
class CoTrained:
    text: View
    meta: View
    text_share: float
    meta_share: float
    prior: float
    cutoff: float

    def score(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good: by the text, by the metadata, by both."""
        t, m = self.text.log_odds(xt), self.meta.log_odds(xm)
        both = self.prior + self.text_share * (t - self.prior) + self.meta_share * (m - self.prior)
        return _sigmoid(t), _sigmoid(m), _sigmoid(both)


def cotrain(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, held: np.ndarray, choose: Callable[[View, View], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> CoTrained:
    """Fit both views. ``y``: labels of the labelled rows; ``held``: rows kept for calibration (every other one) and cutoff.

    ``choose(text, meta)``: for each of the two views ``xt, xm, label`` of the unlabelled rows that it
    is surest of and that were not chosen before.
    """
    fit = ~held
    if len(np.unique(y[fit])) < 2 or len(np.unique(y[held])) < 2:
        held = np.zeros(len(y), dtype=bool) if len(np.unique(y[fit])) < 2 else held
        fit = np.ones(len(y), dtype=bool)
    sets = {"t": [xt[fit], y[fit]], "m": [xm[fit], y[fit]]}
    text, meta = fit_view(*sets["t"]), fit_view(*sets["m"])
    for _ in range(ROUNDS):
        by_text, by_meta = choose(text, meta)
        if not len(by_text[2]) and not len(by_meta[2]):
            break
        sets["m"] = [np.concatenate([sets["m"][0], by_text[1]]), np.concatenate([sets["m"][1], by_text[2]])]
        sets["t"] = [np.concatenate([sets["t"][0], by_meta[0]]), np.concatenate([sets["t"][1], by_meta[2]])]
        text, meta = fit_view(*sets["t"]), fit_view(*sets["m"])
    where = held if held.any() else fit
    judge = where
    turn = np.cumsum(held) % 2 == 0
    if held.any() and min(len(np.unique(y[held & turn])), len(np.unique(y[held & ~turn]))) == 2:
        where, judge = held & turn, held & ~turn
    prior = float(np.log((y[where].sum() + 1) / ((1 - y[where]).sum() + 1)))
    gains = []
    flat = np.logaddexp(0, np.where(y[where] > 0, -1, 1) * prior).mean()
    for view, x in ((text, xt), (meta, xm)):
        z = view.raw(x[where])
        view.slope, view.shift = (float(v) for v in fit_logistic(z[:, None], y[where], ridge=1e-2))
        view.slope = max(0.0, view.slope)
        loss = np.logaddexp(0, np.where(y[where] > 0, -1, 1) * view.log_odds(x[where])).mean()
        gains.append(max(0.0, flat - loss))
    most = max(*gains, 1e-12)
    model = CoTrained(text, meta, gains[0] / most, gains[1] / most, prior, 0.5)
    good = np.sort(model.score(xt[judge], xm[judge])[2][y[judge] > 0])
    bad = np.sort(model.score(xt[judge], xm[judge])[2][y[judge] == 0])
    # at most FALSE_REJECTION of the held-out good fall below the cutoff; halfway to the bad ones (in log odds) if those are lower still
    limit = good[int(FALSE_REJECTION * len(good))] if len(good) else 0.0
    if len(bad) and bad[-1] < limit:
        odds = lambda p: float(np.log(np.clip(p, 1e-9, 1 - 1e-9) / (1 - np.clip(p, 1e-9, 1 - 1e-9))))
        limit = _sigmoid(np.float64((odds(bad[-1]) + odds(limit)) / 2))
    model.cutoff = float(min(limit, 0.5))
    return model


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few hundred rows, so that their texts and features don't pile up in a worker."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _featured(docs: DataFrame, extra: list[str]) -> DataFrame:
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            t, m = [], []
            for text, lang, source in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True):
                t.append(text_features(text).astype(np.float32))
                m.append(meta_features(lang, source, text).astype(np.float32))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in extra], pa.array(t, pa.list_(pa.float32())), pa.array(m, pa.list_(pa.float32()))], names=[*extra, "xt", "xm"])

    return docs.select(*extra, "text", "lang", "source").mapInArrow(run, f"{kinds}, xt array<float>, xm array<float>")


def _matrix(found: pa.Table | pa.RecordBatch, name: str, width: int) -> np.ndarray:
    column = found[name].combine_chunks() if isinstance(found, pa.Table) else found.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _surest(text: View, meta: View, taken: list):
    """Of each partition, the ``HANDED`` rows of each view and label that the view is surest of."""
    least = float(np.log(CONFIDENT / (1 - CONFIDENT)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], pa.Table] = {}
        for batch in batches:
            batch = batch.filter(pc.invert(pc.is_in(batch.column("id"), value_set=pa.array(taken, batch.schema.field("id").type))))
            if not batch.num_rows:
                continue
            for v, (view, x) in enumerate(((text, _matrix(batch, "xt", TEXT_FEATURES)), (meta, _matrix(batch, "xm", META_FEATURES)))):
                z = view.raw(x).astype(np.float64)
                for label in (0, 1):
                    sure = z if label else -z
                    at = np.flatnonzero(sure >= least)
                    if not len(at):
                        continue
                    rows = pa.Table.from_batches([batch.take(pa.array(at))]).append_column("sure", pa.array(sure[at]))
                    rows = pa.concat_tables([kept[v, label], rows]) if (v, label) in kept else rows
                    best = pc.sort_indices(rows, [("sure", "descending"), ("h", "ascending"), ("id", "ascending")])
                    kept[v, label] = rows.take(best[:HANDED]).combine_chunks()
        for (v, label), rows in kept.items():
            rows = rows.append_column("view", pa.array(np.full(rows.num_rows, v, np.int32))).append_column("label", pa.array(np.full(rows.num_rows, label, np.int32)))
            yield from rows.to_batches()

    return run


def _named(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))


def train(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> CoTrained | None:
    """Fit on ``id, xt, xm`` of all rows: at most ``MAX_LABELLED`` labelled ones and the surest of all others; None if one class has no label."""
    one = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.min(label_col).alias("y"))
    # features move and not texts; rows of one id count once
    featured = rows.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("xt", "xm")).alias("x")).select("id", "x.xt", "x.xm")
    featured = featured.join(one, F.col("id") == F.col("label_id"), "left")
    featured = materialize(featured.select("id", F.xxhash64(F.col("id"), F.lit(11)).alias("h"), F.col("y").cast("int").alias("y"), "xt", "xm"), "cotrain-features")
    chosen = materialize(featured.where("y IS NOT NULL").select("id", "h").orderBy("h", "id").limit(MAX_LABELLED).select(F.col("id").alias("chosen_id")), "cotrain-chosen")
    found = featured.where("y IS NOT NULL").join(F.broadcast(chosen), F.col("id") == F.col("chosen_id")).drop("chosen_id").toArrow().sort_by([("h", "ascending"), ("id", "ascending")])
    y = (found["y"].to_numpy() >= 1).astype(float)
    if len(np.unique(y)) < 2:
        return None
    xt, xm = _matrix(found, "xt", TEXT_FEATURES), _matrix(found, "xm", META_FEATURES)
    del found
    pool = featured.where("y IS NULL").select("id", "h", "xt", "xm")
    kind = featured.schema["id"].dataType.simpleString()
    taken: list = []

    def choose(text: View, meta: View) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        sure = materialize(pool.mapInArrow(_surest(text, meta, list(taken)), f"id {kind}, h long, xt array<float>, xm array<float>, sure double, view int, label int"), "cotrain-surest")
        best = [sure.where(f"view = {v} AND label = {label}").orderBy(F.desc("sure"), "h", "id").limit(HANDED) for v in (0, 1) for label in (1, 0)]
        found = reduce(DataFrame.unionByName, best).toArrow()
        drop_materialized(sure)
        taken.extend(found["id"].to_pylist())
        out = []
        for v in (0, 1):
            mine = found.filter(pc.equal(found["view"], v))
            out.append((_matrix(mine, "xt", TEXT_FEATURES), _matrix(mine, "xm", META_FEATURES), mine["label"].to_numpy().astype(float)))
        return out

    model = cotrain(xt, xm, y, np.arange(len(y)) % 4 == 0, choose)
    drop_materialized(featured)
    return model


def _scores(batch: pa.RecordBatch, model: CoTrained, text_col: str, lang_col: str, source_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    texts, langs, sources = (batch.column(c).to_pylist() for c in (text_col, lang_col, source_col))
    xt = np.array([text_features(t) for t in texts], dtype=np.float32).reshape(-1, TEXT_FEATURES)
    xm = np.array([meta_features(a, b, t) for a, b, t in zip(langs, sources, texts, strict=True)], dtype=np.float32).reshape(-1, META_FEATURES)
    return model.score(xt, xm)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``doc_id, text_score, meta_score, score, accepted`` of every row (probabilities of good quality).

    A null or empty text has no text features and is scored; null language and source are values of
    their own; labels of one id that disagree count as bad, null labels as none; repeated rows give
    repeated results; ties at the cutoff are accepted; without labels of both classes the scores are
    null and all rows are accepted; an empty table gives no rows; other columns are ignored. The
    features of every row are computed once and written; training and scoring both read them.
    """
    rows = materialize(_featured(_named(docs, id_col, text_col, lang_col, source_col), ["id"]), "cotrain-rows")
    model = train(rows, labels, id_col)
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select(F.col("id").alias(id_col), none.alias("text_score"), none.alias("meta_score"), none.alias("score"), F.lit(True).alias("accepted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, m, both = model.score(_matrix(batch, "xt", TEXT_FEATURES), _matrix(batch, "xm", META_FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.float64()) for x in (t, m, both)), pa.array(both >= model.cutoff)], names=["id", "text_score", "meta_score", "score", "accepted"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text_score double, meta_score double, score double, accepted boolean").withColumnRenamed("id", id_col)


def keep_accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``classify`` accepts, with the columns of ``docs``, whatever their names.

    Rows stay as they are, repeated ones as often as they come; all else as for ``classify``.
    """
    model = train(_featured(_named(docs, id_col, text_col, lang_col, source_col), ["id"]), labels, id_col)
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            yield batch.filter(pa.array(_scores(batch, model, text_col, lang_col, source_col)[2] >= model.cutoff))

    return docs.mapInArrow(run, docs.schema)


def op10_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
