"""Quality by compression: a text is held against zstandard dictionaries of good and of bad texts.

Two dictionaries are trained on labelled rows. A text's compressed sizes with either, and nothing else, make
its score: their difference over the smaller of them goes through an isotonic map (Spark ML) from difference
to probability, fitted on labelled rows that the dictionaries haven't seen. Whole texts are compressed, and
whole labelled texts are trained on, a piece at a time where they are long.

Bounds: FIT_ROWS labelled rows at most, half for the dictionaries and half for the map, drawn by a hash of the
id; of the dictionaries' half, a class's pieces are bounded by FIT_PIECES, drawn by a hash of id and place, so
that every part of a long text has the same chance. Scoring has no bound.

Defined results: a null or empty text has difference 0, and gets the score of that; rows are scored alone, so
ties and repeated rows change nothing; repeated labels of a row count each; labels that are null are left out;
labels of one class only give a constant score, that class's share (0 without any); an empty table gives an
empty result; other columns come through, but for one named score, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import added, packed, table
from .labelled import FIT_ROWS, calibrated, fit_sample, fold, isotonic

#: Bytes of a dictionary, and of the segments and their parts that its training counts.
DICT_BYTES, SEGMENT, PART = 64 << 10, 1000, 8
LEVEL = 3
#: Bytes compressed, or trained on, at a time, so that the dictionary counts throughout a long text.
PIECE = 4 << 10
#: Most pieces of a class that its dictionary is trained on.
FIT_PIECES = 5_000
#: Bytes of a frame that hold no content.
FRAME = 7


def train(pieces: list[bytes]) -> bytes:
    """A dictionary; of pieces too few or too alike for training, each different one as it is."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces, k=SEGMENT, d=PART, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(pieces))


def difference(text: str | None, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """How much smaller a text gets with good than with bad, over the smaller size."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return 0.0
    pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
    g, b = (sum(max(1, len(c.compress(x)) - FRAME) for x in pieces) for c in (good, bad))
    return (b - g) / min(b, g)


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))


def differences(text: Column, good: bytes, bad: bytes) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tools = compressor(good), compressor(bad)
        for batch in batches:
            yield batch.map(lambda t: difference(t, *tools)).astype("float64")

    return run(text)


class Model:
    """The two dictionaries and the isotonic map; or a constant."""

    def __init__(self, good, bad, steps, constant=0.0):
        self.good, self.bad, self.steps, self.constant = good, bad, steps, constant

    def score(self, docs: DataFrame) -> DataFrame:
        """docs with a column score; docs has a column text."""
        rows = docs.select(packed(docs), F.col("text").alias("text"))
        if self.steps is None:
            return added(rows, {"score": F.lit(float(self.constant))}, docs.columns)
        x = rows.select("row", differences(F.col("text"), self.good, self.bad).alias("x"))
        return added(calibrated(x, self.steps), {"score": F.col("calibrated")}, docs.columns)


def _pieces(sample: DataFrame, most: int) -> list[bytes]:
    """The pieces of whole texts, each once, at most about `most` of them drawn by a hash of id and place."""
    raw = F.col("text").cast("binary")
    places = F.sequence(F.lit(0), (F.octet_length("text") - 1).cast("int"), F.lit(PIECE))
    cut = sample.where(F.octet_length("text") > 0).select("doc_id", raw.alias("raw"), F.explode(places).alias("at"))
    n = cut.count()
    draw = F.xxhash64(F.lit(11), "doc_id", "at")
    if n > most:
        cut = cut.where(F.shiftrightunsigned(draw, 11) / F.lit(float(1 << 53)) < most / n)
    cut = cut.select(F.substring("raw", F.col("at") + 1, F.lit(PIECE)).alias("piece"), draw.alias("draw"))
    return [bytes(r["piece"]) for r in cut.orderBy("draw", "piece").select("piece").toLocalIterator()]


def fit(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", rows: int = FIT_ROWS, pieces: int = FIT_PIECES) -> Model:
    """Fitted on at most `rows` labelled rows: half for the dictionaries (about `pieces` pieces a class at most), half for calibration."""
    sample = fit_sample(docs, labels, label, keep, rows).withColumn("half", fold(F.col("doc_id"), 2)).cache()
    try:
        halves = {(r["half"], r["label"]): r["n"] for r in sample.groupBy("half", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
        good, bad = (sum(n for (_, c), n in halves.items() if c == which) for which in (1, 0))
        dicts = [_pieces(sample.where((F.col("half") == 0) & (F.col("label") == which)), pieces) for which in (1, 0)]
        if not all(dicts) or not (halves.get((1, 0)) and halves.get((1, 1))):
            return Model(None, None, None, good / max(1, good + bad))
        dicts = [train(d) for d in dicts]
        x = sample.where("half = 1").select(F.col("label").cast("double").alias("label"), differences(F.col("text"), *dicts).alias("x"))
        return Model(*dicts, isotonic(x))
    finally:
        sample.unpersist()


def op5_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return model.score(docs).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
