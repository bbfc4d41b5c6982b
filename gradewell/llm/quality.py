"""Quality scores from dictionary compression (operator 4).

Two zstandard dictionaries are built, one from texts labelled good and one from
texts labelled bad. A text is cut into blocks, each block is compressed with
either dictionary, and the difference of the summed sizes, divided by the
text's length, says which dictionary knows its wording better. A logistic curve
of this one number, bent so that extreme texts don't rule it, is fitted on
labelled texts that the dictionaries haven't seen and turns it into a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.llm.samples import sample_ids, sample_texts
from gradewell.llm.shared import sheltered

#: The model is fitted on at most so many labelled texts a class, of at most so many characters together.
SAMPLE_PER_LABEL = 3000
SAMPLE_CHARS = 24_000_000
DICTIONARY_BYTES = 65_536
#: A dictionary is trained on a random sample of at most so many blocks of its class's texts.
DICTIONARY_BLOCKS = 20_000
BLOCK_BYTES = 512
LEVEL = 3
#: The calibration's curve bends here: differences (bytes saved for each byte) far beyond it are all alike.
BEND = 1 / 30
THRESHOLD = 0.3


def _blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    raw: tuple[bool, bool]  # a dictionary of too few samples is plain content
    slope: float = 0.0
    intercept: float = 0.0

    def compressors(self) -> list[Callable[[bytes], bytes]]:
        import zstandard

        out = []
        for data, raw in zip((self.good, self.bad), self.raw, strict=True):
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_AUTO)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        return out

    def differences(self, texts: Sequence[str | None], compressors: list | None = None) -> np.ndarray:
        """Bytes that the good dictionary saves against the bad one, for each byte of text; 0 for no text."""
        good, bad = compressors or self.compressors()
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            data = (t or "").encode("utf-8", "surrogatepass")
            if data:
                out[i] = sum(len(bad(block)) - len(good(block)) for block in _blocks(data)) / len(data)
        return out

    def score(self, differences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.tanh(differences / BEND) + self.intercept, -30, 30)))


def _dictionary(texts: list[str]) -> tuple[bytes, bool]:
    import zstandard

    samples = [b for t in texts for b in _blocks(t.encode("utf-8", "surrogatepass"))]
    chosen = np.random.default_rng(0).permutation(len(samples))[:DICTIONARY_BLOCKS]
    samples = [samples[i] for i in chosen]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes(), False
    except zstandard.ZstdError:
        return b"\n".join(samples)[-DICTIONARY_BYTES:], True


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve of one number, by Newton's method with a slight ridge."""
    center, scale = float(x.mean()), max(float(x.std()), 1e-6)
    z, w, ridge = np.column_stack([(x - center) / scale, np.ones(len(x))]), np.zeros(2), np.diag([1.0, 1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
    return float(w[0] / scale), float(w[1] - w[0] * center / scale)


def fit(labelled: list[tuple[int, str, str]]) -> CompressionModel | float:
    """From (doc_id, "0" or "1", text); without both classes a constant, the labelled share of good ones (0.5 if none)."""
    good = [t for _, q, t in labelled if q == "1"]
    bad = [t for _, q, t in labelled if q == "0"]
    if min(len(good), len(bad)) < 2:
        return (len(good) + 0.5) / (len(good) + len(bad) + 1)
    (g, g_raw), (b, b_raw) = _dictionary(good[::2]), _dictionary(bad[::2])
    model = CompressionModel(g, b, (g_raw, b_raw))
    rest = good[1::2] + bad[1::2]
    y = np.repeat([1.0, 0.0], [len(good[1::2]), len(bad[1::2])])
    model.slope, model.intercept = calibrate(np.tanh(model.differences(rest) / BEND), y)
    return model


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> CompressionModel | float:
    """Fitted on a bounded sample of the labelled rows that aren't held out."""
    rows = labels.where(~held_out() & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    return fit(sample_texts(docs, sample_ids(rows, per_label), SAMPLE_CHARS))


def score_column(model: CompressionModel | float, text: str = "text") -> Column:
    """The score of each text; null and empty ones get the score of no difference."""
    if isinstance(model, float):
        return F.lit(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressors = model.compressors()
        for texts in batches:
            yield pd.Series(model.score(model.differences([None if pd.isna(t) else t for t in texts], compressors)))

    return score(F.col(text))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are not read): doc_id, held_out, score, predicted.

    Texts of any length are scored whole. Null and empty texts get the score of
    no difference, repeated rows the same score each; a null doc_id isn't held
    out. Without labels of both classes every score is the labelled share of
    good rows. An empty table gives an empty result.
    """
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(train(docs, labels)).alias("score"))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns.

    Nulls, empty and long texts, repeated rows and empty tables as in
    ``classify``; no column of ``docs`` is touched, whatever its name.
    """
    inner, named = sheltered(docs)
    return named(inner.withColumn("score", score_column(train(inner, labels))).where(F.col("score") >= THRESHOLD))
