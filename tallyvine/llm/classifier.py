"""Quality by compression: which of two dictionaries, of good or of bad texts, fits a text better.

Zstandard dictionaries are built from labelled good and bad texts. A text is cut into blocks,
each compressed with either dictionary; the difference of the sizes, over the length, is the
evidence, which a logistic curve fitted to labelled texts turns into the probability of a good
label. Short blocks keep a text from becoming its own dictionary.

The fit uses at most ``sample_rows`` labelled ids (those of the smallest hashes; a parameter), and
whole texts of them: half give pieces from all over each to the dictionaries, of the other half the
evidence is computed where the texts are, and only pieces and numbers come to the driver. Scoring
reads whole texts of any length. Labels are used for the fit alone. Null and empty texts get the
share of good labels in the sample. Rows are scored one by one, so repeats agree; in the fit equal
rows count once. With fewer than two texts of either label nothing tells good from bad, and every
text gets that share, or ``UNLABELLED`` without labels. Columns other than those named are not read
by the fit and the scores, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvine.llm.common import map_batches, slices, utf8
from tallyvine.sources.scratch import store

SAMPLE_ROWS = 3000
BLOCK = 1024
DICTIONARY = 48_000
LEVEL = 3
#: The score of all texts if no text is labelled.
UNLABELLED = 0.5


def blocks(text: bytes, size: int = BLOCK) -> list[bytes]:
    return [text[at : at + size] for at in range(0, len(text), size)]


#: Bytes of a piece of a dictionary.
PIECE = 64


def _share(texts: int) -> int:
    """Bytes that each of so many texts gives to a dictionary."""
    return max(PIECE, DICTIONARY // max(1, texts))


def _excerpt(text: bytes, share: int) -> bytes:
    """Pieces from all over the text, ``share`` bytes at most."""
    if len(text) <= share:
        return text
    count = share // PIECE
    step = (len(text) - PIECE) / count
    return b"".join([text[at : at + PIECE] for at in (int(step * (i + 0.5)) for i in range(count))])


def _dictionary(excerpts: list[bytes]) -> bytes:
    """A raw-content dictionary of excerpts, as much as fits."""
    return b"\n".join(excerpts)[-DICTIONARY:].ljust(8, b"\n")


class Sizes:
    """Compressed sizes of a text under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.compressors = []
        for data in (good, bad):
            dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False
                )
            )

    def evidence(self, text: bytes) -> tuple[float, float]:
        """Bad minus good size, and the good size, each over the length."""
        if not text:
            return 0.0, 0.0
        good, bad = ([len(c.compress(part)) for part in blocks(text)] for c in self.compressors)
        return (sum(bad) - sum(good)) / len(text), sum(good) / len(text)


@dataclass(frozen=True)
class QualityModel:
    """Without weights it gives every text the prior."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float


def features(difference: float, size: float) -> list[float]:
    """Evidence for the curve: the difference, and how far the text shrinks at all."""
    return [1.0, 10 * difference, 10 * size]


def _curve(rows: np.ndarray, labels: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a weak ridge, by Newton's method."""
    weights = np.zeros(rows.shape[1])
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (labels - chance) - 0.01 * weights
        bend = (rows * (chance * (1 - chance))[:, None]).T @ rows + 0.01 * np.eye(len(weights))
        weights += (step := np.linalg.solve(bend, slope))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(weights.tolist())


def _halves(labels: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Places that teach the good and the bad dictionary, and those that teach the curve."""
    sides = [[at for at, label in enumerate(labels) if label == value] for value in (1, 0)]
    return sides[0][0::2], sides[1][0::2], sides[0][1::2] + sides[1][1::2]


def fit_texts(texts: list[bytes], labels: list[int]) -> QualityModel:
    """Dictionaries from one half of the texts, the curve from the other."""
    if min(labels.count(0), labels.count(1)) < 2:
        raise ValueError("the fit needs at least two texts of either label")
    good, bad, held = _halves(labels)
    dictionaries = [_dictionary([_excerpt(texts[at], _share(len(side))) for at in side]) for side in (good, bad)]
    sizes = Sizes(*dictionaries)
    rows = np.array([features(*sizes.evidence(texts[at])) for at in held])
    return QualityModel(*dictionaries, _curve(rows, np.array([float(labels[at]) for at in held])), float(np.mean(labels)))


def _measure(places: dict, shares: tuple[int, int] | None, dictionaries: tuple[bytes, bytes] | None):
    """Of the texts at the places: their excerpts, or their evidence under both dictionaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(*dictionaries) if dictionaries else None
        names = ["place", "excerpt", "difference", "size"]
        for batch in slices(batches):
            rows = []
            columns = [batch.column(name).to_pylist() for name in ("k", "y", "h")]
            for *key, text in zip(*columns, utf8(batch.column("t")), strict=True):
                place = places.get(tuple(key))
                if place is None:
                    continue
                excerpt = _excerpt(text, shares[1 - key[1]]) if shares else b""
                rows.append((place, excerpt, *(sizes.evidence(text) if sizes else (0.0, 0.0))))
            types = [pa.int64(), pa.binary(), pa.float64(), pa.float64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)

    return run


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> QualityModel:
    """Fit on labelled documents; ``labels`` holds only rows that may be learnt from."""
    marked = labels.where(F.col(label_column).isin(0, 1)).select(F.col(id_column).alias("k"), F.col(label_column).cast("int").alias("y"))
    order = [F.xxhash64("k"), "k", "y"]
    # As many rows of either label at most, so that a rare label is learnt too.
    chosen = marked.where("y = 1").orderBy(*order).limit(sample_rows // 2)
    chosen = chosen.unionByName(marked.where("y = 0").orderBy(*order).limit(sample_rows // 2)).distinct()
    slim = docs.select(F.col(id_column).alias("k"), F.col(text_column).alias("t"), F.xxhash64(text_column).alias("h"))
    # At most sample_rows pairs of numbers on the broadcast side.
    picked = store(slim.where("t <> ''").join(F.broadcast(chosen), "k"))
    rows = picked.select("k", "y", "h").distinct().orderBy(*order, "h").limit(2 * sample_rows).collect()
    found = [row.y for row in rows]
    if min(found.count(0), found.count(1)) < 2:
        return QualityModel(b"", b"", (), float(np.mean(found)) if found else UNLABELLED)
    good, bad, held = _halves(found)

    def measured(places: list[int], *how) -> dict[int, tuple]:
        """At most 2 x sample_rows small rows; equal texts give equal ones."""
        kernel = _measure({(rows[at].k, rows[at].y, rows[at].h): at for at in places}, *how)
        told = map_batches(picked, kernel, "place bigint, excerpt binary, difference double, size double").distinct()
        return {row.place: row for row in told.collect()}

    excerpts = measured(good + bad, (_share(len(good)), _share(len(bad))), None)
    dictionaries = tuple(_dictionary([bytes(excerpts[at].excerpt) for at in side]) for side in (good, bad))
    evidence = measured(held, None, dictionaries)
    curve = np.array([features(evidence[at].difference, evidence[at].size) for at in held])
    return QualityModel(*dictionaries, _curve(curve, np.array([float(found[at]) for at in held])), float(np.mean(found)))


def scorer(model: QualityModel):
    """Scores of texts, made once per task."""
    if not model.weights:
        return lambda texts: np.full(len(texts), model.prior)
    sizes, weights = Sizes(model.good, model.bad), np.array(model.weights)

    def score(texts: list[bytes]) -> np.ndarray:
        rows = np.array([features(*sizes.evidence(text)) for text in texts]).reshape(-1, len(weights))
        found = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        return np.where([bool(text) for text in texts], found, model.prior)

    return score


def _score(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for batch in slices(batches):
            found = score(utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=[batch.schema.names[0], "score"])

    return run


def score_quality(docs: DataFrame, model: QualityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id and score, the probability of a good label."""
    slim = docs.select(F.col(id_column), F.col(text_column).alias("text"))
    schema = T.StructType([slim.schema[id_column], T.StructField("score", T.DoubleType())])
    return map_batches(slim, _score(model), schema)


def _keep(model: QualityModel, text_at: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for batch in slices(batches):
            yield batch.filter(pa.array(score(utf8(batch.column(text_at))) >= threshold))

    return run


def keep_good(docs: DataFrame, model: QualityModel, threshold: float, text_column: str = "text") -> DataFrame:
    """The rows that score at least the threshold, with all columns."""
    return map_batches(docs, _keep(model, docs.columns.index(text_column), threshold), docs.schema)
