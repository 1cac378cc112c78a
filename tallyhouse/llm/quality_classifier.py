"""Quality classifier (4) by co-training of two views.

One classifier sees what a text holds, the other what is known about it (source, language, length). Both learn from
labelled documents. In each round, each marks all documents that have no label, and those it is surest of, in the
proportion of the classes, become labels for the other one. At the end each view's score is calibrated on labelled rows held
back, the calibrated scores are weighed against each other on the same rows, and all documents are scored.

Only the labelled rows are a bounded sample (about ``LABELLED``, by the hash of the id). Features of all documents are written
once by the tasks, some hundred bytes a row. A round is two passes over them: tasks count the margins of rows without a label,
which gives the margin above which a view is among its surest ``HANDED_PERCENT``; then tasks write the rows that pass it. How
sure a view may be is read off the rows held back: one that does not tell good from bad there (``APART``) hands over
nothing, and no margin counts as sure above which less than ``SURE`` of them are right. The views are fitted by Newton steps
on the labelled rows and on the sums of gradients and Hessians that tasks make of the rows handed over; such sums, counts
and the labelled rows are all that comes to the driver. Rows handed over weigh together as much as the labelled ones at
most, so a fit means the same at every size.

Which rows have a label follows from the models and margins of the rounds before, so tasks keep nothing between passes. Of rows
in the last margin step that a view may hand over, a share is taken by the hash of the features, so equal rows go together.

Scoring is one pass over all documents without a shuffle.

Defined results: a null text counts as empty; a null source or language is a value of its own, and unlike ones may share an
indicator (``SOURCES``, ``LANGUAGES``); labels that are null or contradict each other for a document are left out; with labels of
fewer than two classes nothing is learned, every score is 0.5 and every document stays. Of rows that share a labelled doc_id, one
teaches. Repeated rows are each answered. Columns other than doc_id, text, source, lang and n_chars are not looked at; those
three may be missing.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.tasks import bounded, free_name, ship, texts
from tallyhouse.sources.store import Store

LABELLED = 8000
ROUNDS = 3
#: Rows that a view hands over in a round, of each hundred documents, if it is as sure as this.
HANDED_PERCENT = 5
SURE = 0.95
#: Standard deviations by which a view has to rank good rows held back above bad ones, to be believed.
APART = 2.33
#: A document stays if its score, the probability of good quality, is at least this.
THRESHOLD = 0.5
#: Margins are counted in steps of 1 / STEPS, from -MOST to MOST.
STEPS, MOST = 50, 30
#: No margin is as high as this one.
NEVER = MOST * STEPS + 1
#: Tasks that add up what the others have summed.
GATHER = 4

PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SOURCES, LANGUAGES = 32, 16


def content_view(text: str) -> list[float]:
    """Shares of kinds of characters, and how much of a text repeats."""
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    words = text.split()
    lines = [line for line in text.split("\n") if line]
    n_words = max(1, len(words))
    return [
        counts[65:91].sum() / letters,
        counts[48:58].sum() / n,
        counts[32] / n,
        counts[10] / n,
        counts[128:].sum() / n,
        *np.log1p(1000 * counts[list(PUNCTUATION)] / n).tolist(),
        len(set(words)) / n_words,
        sum(map(eq, words, words[1:])) / n_words,
        np.log1p(n / n_words),
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(words)),
    ]


def metadata_view(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    """Source and language as hashed indicators, and the length."""
    out = [0.0] * (SOURCES + LANGUAGES)
    out[zlib.crc32(f"={source}".encode() if source is not None else b"") % SOURCES] = 1.0
    out[SOURCES + zlib.crc32(f"={lang}".encode() if lang is not None else b"") % LANGUAGES] = 1.0
    size = float(np.log1p(max(0, n_chars or 0)))
    return [*out, size, size * size / 10]


@dataclass
class Logistic:
    """Regularised logistic regression on standardised features."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def blank(cls, x: np.ndarray) -> "Logistic":
        """Nothing learned yet; features are standardised as in these rows."""
        scale = x.std(0)
        return cls(x.mean(0), np.where(scale > 1e-12, scale, 1.0), np.zeros(x.shape[1] + 1))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> "Logistic":
        model = cls.blank(x)
        for _ in range(30):
            if model.step(model.sums(x, y)) < 1e-6:
                break
        return model

    def step(self, sums: np.ndarray, ridge: float = 1.0) -> float:
        """One of Newton's steps, by the sums over all rows; how far it goes."""
        size = len(self.weights)
        penalty = np.r_[np.full(size - 1, ridge), 1e-6]
        step = np.linalg.solve(sums[size:].reshape(size, size) + np.diag(penalty), sums[:size] + penalty * self.weights)
        step *= min(1.0, 5 / max(1e-9, np.abs(step).max()))
        self.weights = self.weights - step
        return float(np.abs(step).max())

    def _spread(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -20, 20)

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The gradient and the Hessian that rows add."""
        z = np.c_[self._spread(x), np.ones(len(x))]
        p = 1 / (1 + np.exp(-self.margin(x)))
        return np.r_[z.T @ (p - y), ((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z).ravel()]

    def margin(self, x: np.ndarray) -> np.ndarray:
        # Summed row by row: a row's margin does not depend on the rows beside it.
        return np.clip((self._spread(x) * self.weights[:-1]).sum(1) + self.weights[-1], -MOST, MOST)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


@dataclass
class CoTrained:
    """Two views, their calibration, and how they are weighed."""

    views: list[Logistic] = field(default_factory=list)
    calibrations: list[Logistic] = field(default_factory=list)
    together: Logistic | None = None
    handed: list[tuple[int, int]] = field(default_factory=list)
    held_back: dict[str, float] = field(default_factory=dict)

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined, content and metadata scores."""
        if self.together is None:
            half = np.full(len(content), 0.5)
            return half, half, half
        margins = [
            calibration.margin(view.margin(x)[:, None])
            for view, calibration, x in zip(self.views, self.calibrations, (content, metadata))
        ]
        both = self.together.probability(np.stack(margins, 1))
        return both, *(1 / (1 + np.exp(-m)) for m in margins)


Views = tuple[np.ndarray, np.ndarray]
#: For good and bad: the margin step from which a view hands over all rows, and the share it takes of the step before.
Cuts = tuple[tuple[int, float], tuple[int, float]]


def steps_of(margin: np.ndarray) -> np.ndarray:
    """How sure a view is of the good class, in steps; negated for the bad class."""
    return np.floor(margin * STEPS).astype(int)


def taken(model: Logistic, cuts: Cuts, x: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """What a view says of rows: 1 and 0 where it is sure enough, else -1."""
    out, margin = np.full(len(x), -1), model.margin(x)
    for mark, (least, share), steps in ((1, cuts[0], steps_of(margin)), (0, cuts[1], steps_of(-margin))):
        out[(steps >= least) | ((steps == least - 1) & (chance < share))] = mark
    return out


@dataclass
class Round:
    """The views as they were fitted, and what they handed over."""

    models: tuple[Logistic, Logistic]
    cuts: tuple[Cuts, Cuts]


def labels_so_far(rounds: list[Round], views: Views, chance: np.ndarray) -> list[np.ndarray]:
    """The labels that each view has been handed by the other one; -1 for none. The first one stays."""
    given = [np.full(len(chance), -1) for _ in views]
    for one_round in rounds:
        for one, other in ((0, 1), (1, 0)):
            new = taken(one_round.models[one], one_round.cuts[one], views[one], chance)
            given[other] = np.where(given[other] < 0, new, given[other])
    return given


def counted(rounds: list[Round], models: list[Logistic], views: Views, chance: np.ndarray) -> np.ndarray:
    """How many rows, without a label for the other view, each view is how sure of, for good and for bad."""
    out = np.zeros((2, 2, 2 * MOST * STEPS + 1))
    given = labels_so_far(rounds, views, chance)
    for one, other in ((0, 1), (1, 0)):
        margin = models[one].margin(views[one][given[other] < 0])
        for side, steps in enumerate((steps_of(margin), steps_of(-margin))):
            out[one, side] += np.bincount(np.clip(steps + MOST * STEPS, 0, 2 * MOST * STEPS), minlength=out.shape[2])
    return out


def cut_of(counts: np.ndarray, quota: float, sure: int) -> tuple[int, float]:
    """The step from which the surest ``quota`` rows begin, none below ``sure``, and the share of the one before."""
    least = NEVER
    while least > sure and counts[least - 1 + MOST * STEPS] <= quota:
        least -= 1
        quota -= counts[least + MOST * STEPS]
    return least, float(quota / counts[least - 1 + MOST * STEPS]) if least > sure else 0.0


def sure_from(margin: np.ndarray, good: np.ndarray) -> tuple[int, int]:
    """The steps from which a view is sure of good and of bad, by its margins of rows held back."""
    above = margin[good][:, None] - margin[~good][None, :]
    n = good.sum(), (~good).sum()
    ranked = (above > 0).mean() + (above == 0).mean() / 2
    if ranked - 0.5 < APART * np.sqrt((n[0] + n[1] + 1) / (12 * n[0] * n[1])):
        return NEVER, NEVER
    out = []
    for sign, right in ((1, good), (-1, ~good)):
        order = np.argsort(-sign * margin, kind="stable")
        enough = np.flatnonzero(np.cumsum(right[order]) >= SURE * np.arange(1, len(order) + 1))
        own = int(np.ceil(np.log(SURE / (1 - SURE)) * STEPS))
        out.append(max(own, int(steps_of(sign * margin[order[enough[-1]]]))) if len(enough) else NEVER)
    return out[0], out[1]


def fitted_anew(
    models: list[Logistic], x: list[np.ndarray], y: np.ndarray, handed: np.ndarray, sums: Callable[[list[Logistic]], list[np.ndarray]]
) -> list[Logistic]:
    """Both views by Newton's steps on labelled rows and on sums over rows handed over, in one pass for a step."""
    models = [Logistic(m.centre, m.scale, m.weights.copy()) for m in models]
    for _ in range(20):
        far = sums(models)
        weight = [min(1.0, len(y) / max(1, n)) for n in handed]
        steps = [m.step(m.sums(a, y) + w * more) for m, a, w, more in zip(models, x, weight, far)]
        if max(steps) < 1e-4:
            break
    return models


def co_train(
    views: Views,
    labels: np.ndarray,
    unlabelled: int,
    count: Callable[[list[Round], list[Logistic]], np.ndarray],
    hand_over: Callable[[list[Round]], tuple[int, int]],
    sums: Callable[[list[Logistic]], list[np.ndarray]],
    rounds: int = ROUNDS,
) -> CoTrained:
    """Train on labelled rows (every fourth held back) and on ``unlabelled`` rows that are elsewhere.

    ``count`` gives the counts of ``counted`` over them, ``hand_over`` keeps those that the last round labels and gives
    their number for each view, ``sums`` adds up gradients and Hessians over the rows kept for each view.
    """
    model = CoTrained()
    held = np.arange(len(labels)) % 4 == 3
    if len(np.unique(labels[~held])) < 2 or len(np.unique(labels[held])) < 2:
        return model
    x, y = [view[~held] for view in views], labels[~held].astype(float)
    good, done, handed = y.mean(), [], np.zeros(2)
    fitted = [Logistic.fit(a, y) for a in x]
    for _ in range(rounds if unlabelled else 0):
        sure = [sure_from(m.margin(v[held]), labels[held] == 1) for m, v in zip(fitted, views)]
        if all(floor == NEVER for pair in sure for floor in pair):
            break
        quota = unlabelled * HANDED_PERCENT / 100
        counts = count(done, fitted)
        cuts = tuple(
            (cut_of(side[0], quota * good, floor[0]), cut_of(side[1], quota * (1 - good), floor[1])) for side, floor in zip(counts, sure)
        )
        done.append(Round(tuple(fitted), cuts))
        new = hand_over(done)
        model.handed.append(tuple(int(n) for n in new))
        handed += new
        if handed.any():
            fitted = fitted_anew(fitted, x, y, handed, sums)
    model.views = list(fitted)
    truth = labels[held].astype(float)
    raw = [view.margin(v[held]) for view, v in zip(model.views, views)]
    model.calibrations = [Logistic.fit(m[:, None], truth) for m in raw]
    margins = np.stack([c.margin(m[:, None]) for c, m in zip(model.calibrations, raw)], 1)
    model.together = Logistic.fit(margins, truth)
    both, *single = model.scores(views[0][held], views[1][held])
    model.held_back = {
        name: float(((p >= 0.5) == (truth > 0.5)).mean()) for name, p in zip(("both", "content", "metadata"), (both, *single))
    }
    return model


def _columns(docs: DataFrame) -> list:
    """The columns that are looked at, in place of missing ones nulls."""
    have = set(docs.columns)
    optional = {"source": "string", "lang": "string", "n_chars": "long"}
    return [F.col(c).cast(kind).alias(c) if c in have else F.lit(None).cast(kind).alias(c) for c, kind in optional.items()]


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    content = np.array([content_view(text) for text in texts(batch)])
    known = zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
    return content, np.array([metadata_view(*row) for row in known])


def _chosen(rows: int, total: int):
    """About ``rows`` of ``total`` rows, by the hash of ``doc_id``."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < min(1 << 30, int(rows / max(1, total) * (1 << 30)) + 1)


FEATURES = "id string, quality int, content binary, metadata binary, chance double"
WIDTHS = (len(content_view("")), SOURCES + LANGUAGES + 2)


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width).astype(np.float64)


def _read(batch: pa.RecordBatch) -> tuple[Views, np.ndarray]:
    views = tuple(_numbers(batch.column(name), width) for name, width in zip(("content", "metadata"), WIDTHS))
    return views, batch.column("chance").to_numpy()


def _totals(frame: DataFrame, summed: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches; each task makes one array of its own, a few tasks add those up."""

    def added(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for part in parts:
            total += part
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added(summed(batch) for batch in batches if batch.num_rows)

    def second(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added(np.frombuffer(one) for batch in batches for one in batch.column(0).to_pylist())

    rows = frame.mapInArrow(first, "total binary").repartition(GATHER).mapInArrow(second, "total binary").collect()
    return sum((np.frombuffer(row.total) for row in rows), np.zeros(size))


def features(docs: DataFrame, labels: DataFrame, labelled: int) -> DataFrame:
    """Both views of each document, with the quality of about ``labelled`` of those whose label is clear."""
    clear = (
        labels.where("quality IN (0, 1) AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .where("quality = most")
    )
    marks = clear.where(_chosen(labelled, clear.count())).select("doc_id", F.col("quality").cast("int").alias("quality"))
    rows = docs.select("doc_id", "text", *_columns(docs)).join(F.broadcast(marks), "doc_id", "left")  # about ``labelled`` rows

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            packed = [[row.astype(np.float32).tobytes() for row in view] for view in _views(batch)]
            chance = [zlib.crc32(a + b) / 2**32 for a, b in zip(*packed)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("quality"), *(pa.array(p, pa.binary()) for p in packed), pa.array(chance)],
                [part.split()[0] for part in FEATURES.split(", ")],
            )

    return rows.mapInArrow(run, FEATURES)


def train(docs: DataFrame, labels: DataFrame, store: Store, labelled: int = LABELLED, rounds: int = ROUNDS) -> CoTrained:
    """Co-train on a bounded sample of ``labels`` (doc_id, quality 0 or 1) and on all of ``docs``."""
    ship(docs.sparkSession)
    known = store.write("features", features(docs, labels, labelled))
    free = known.where("quality IS NULL")
    least = F.min(F.struct("content", "metadata", "quality")).alias("row")
    rows = known.where("quality IS NOT NULL").groupBy("id").agg(least).collect()
    rows.sort(key=lambda r: (zlib.crc32(r.id.encode()), r.id))
    views = tuple(
        np.array([np.frombuffer(r.row[name], np.float32) for r in rows], np.float64).reshape(-1, width)
        for name, width in zip(("content", "metadata"), WIDTHS)
    )
    handed: list[DataFrame] = []

    def count(done: list[Round], models: list[Logistic]) -> np.ndarray:
        shape = (2, 2, 2 * MOST * STEPS + 1)
        return _totals(free, lambda batch: counted(done, models, *_read(batch)).ravel(), int(np.prod(shape))).reshape(shape)

    def hand_over(done: list[Round]) -> tuple[int, int]:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, chance = _read(batch)
                before, after = (labels_so_far(some, own, chance) for some in (done[:-1], done))
                for view, name in enumerate(("content", "metadata")):
                    new = np.flatnonzero((before[view] < 0) & (after[view] >= 0))
                    if len(new):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(new), view, np.int32)), pa.array(after[view][new].astype(np.int32)), batch.column(name).take(pa.array(new))],
                            ["view", "mark", "features"],
                        )

        handed.append(store.write(f"handed_{len(done)}", free.mapInArrow(run, "view int, mark int, features binary")))
        found = {row.view: row["count"] for row in handed[-1].groupBy("view").count().collect()}
        return found.get(0, 0), found.get(1, 0)

    sizes = [(width + 1) * (width + 2) for width in WIDTHS]

    def sums(models: list[Logistic]) -> list[np.ndarray]:
        def summed(batch: pa.RecordBatch) -> np.ndarray:
            own, marks, out = batch.column("view").to_numpy(), batch.column("mark").to_numpy(), []
            for view, model in enumerate(models):
                at = np.flatnonzero(own == view)
                out.append(model.sums(_numbers(batch.column("features").take(pa.array(at)), WIDTHS[view]), marks[at]))
            return np.concatenate(out)

        some = handed[0]
        for more in handed[1:]:
            some = some.unionByName(more)
        return np.split(_totals(some, summed, sum(sizes)), [sizes[0]])

    labels_at_hand = np.array([r.row.quality for r in rows], int)
    return co_train(views, labels_at_hand, free.count() if rounds else 0, count, hand_over, sums, rounds)


def score(docs: DataFrame, model: CoTrained, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``score``, ``content_score``, ``metadata_score`` and ``kept`` for each document."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            scores = model.scores(*_views(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, scores), pa.array(scores[0] >= threshold)],
                ["doc_id", "score", "content_score", "metadata_score", "kept"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *_columns(docs)).mapInArrow(
        run, f"doc_id {kind}, score double, content_score double, metadata_score double, kept boolean"
    )


def good_documents(docs: DataFrame, model: CoTrained, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier keeps, with all their columns."""
    ship(docs.sparkSession)
    helpers = [free_name(docs, f"{name}_seen") for name in ("source", "lang", "n_chars")]
    widened = docs.select("*", *[column.alias(name) for column, name in zip(_columns(docs), helpers)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            seen = pa.RecordBatch.from_arrays(
                [batch.column("text"), *(batch.column(name) for name in helpers)], ["text", "source", "lang", "n_chars"]
            )
            stays = model.scores(*_views(seen))[0] >= threshold
            yield batch.select(docs_columns).filter(pa.array(stays))

    docs_columns = docs.columns
    return widened.mapInArrow(run, docs.schema)
