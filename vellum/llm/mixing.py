"""Mixing sources to target weights: iterative proportional fitting, then sampling.

Documents are added up into cells (one for each combination of source, language and topic); from there on
only the table of cells is worked on. Each sweep scales the cells' token weights to one marginal after the
other until every marginal is met. A cell's rate (weight over tokens) gives its documents' inclusion
probability min(1, c * rate), with c calibrated so that the expected tokens meet the budget; a document is
drawn by a hash of its id, so a run that is repeated draws the same ones.

Raking goes on until every marginal is met to TOLERANCE. Targets that contradict one another (a source that
only comes in a language with another share) never are: when STALL sweeps have not taken a tenth off what is
missing, the weights are as near as they get, and the share by which the worst marginal is missed is given as
mixed.off; strict=True raises instead.

Defined results: a null or missing category counts as the category NONE; a document without words (null or
empty text) has no tokens and gets its cell's probability, 1 in a cell without tokens; rows that repeat an
id are drawn together; an empty table gives an empty result; other columns pass through unchanged, but for
one named mixed, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import added, broadcast_if_small, packed, shared_dir, table, written

NONE = "(none)"
#: Marginals are met when none is off by more than this share.
TOLERANCE = 1e-6
#: Sweeps that must take a tenth off the greatest deviation.
STALL = 10


def topic_of(text: Column) -> Column:
    """A stand-in for a topic column, where a table has none: a coarse class by the text's form.

    mix() takes any column as a dimension; this one only gives it a third marginal to rake to.
    """
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(F.length(text) == 0, "empty")
        .when(text.contains(" | "), "table")
        .when(text.rlike(r"[#$%&*]{3}"), "marked")
        .when(text.contains("!!"), "shouting")
        .when(text.contains("Licen"), "notice")
        .when(F.length(text) > 6000, "long prose")
        .otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("double")


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target shares of dim's categories: their tokens to a power under 1, which lifts the rare ones."""
    return cells.groupBy(dim).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("share")).where("share > 0")


def fit(cells: DataFrame, targets: dict[str, DataFrame], folder: str) -> tuple[DataFrame, float]:
    """cells: the columns of targets and tokens. Adds w, the raked weight, which adds up to 1; and what is missing.

    targets: for each dimension its categories' shares (dim, share), of any sum; categories without a
    share, or with no tokens, get no weight.
    """
    dims = list(targets)
    want = {}
    for d, t in targets.items():
        present = cells.where("tokens > 0").select(d).distinct()
        t = t.join(present, d, "left_semi")
        total = t.agg(F.sum("share")).first()[0]
        want[d] = written(t.select(d, (F.col("share") / F.lit(total)).alias("target")), f"{folder}/target-{d}")
    now, offs = cells.withColumn("w", F.col("tokens")), []
    while True:
        for d in dims:
            sums = now.groupBy(d).agg(F.sum("w").alias("have"))
            scale = sums.join(want[d], d, "left").select(d, F.when(F.col("have") > 0, F.coalesce("target", F.lit(0.0)) / F.col("have")).otherwise(0.0).alias("scale"))
            now = now.join(scale, d).withColumn("w", F.col("w") * F.col("scale")).drop("scale")
        now = written(now, f"{folder}/sweep-{len(offs)}")
        off = 0.0
        for d in dims[:-1]:  # the last one has just been met
            have = now.groupBy(d).agg(F.sum("w").alias("have"))
            off = max(off, have.join(want[d], d).agg(F.max(F.abs(F.col("have") / F.col("target") - 1))).first()[0] or 0.0)
        offs.append(off)
        if off <= TOLERANCE or len(offs) > STALL and off > 0.9 * offs[-1 - STALL]:
            return now, off


def calibrate(cells: DataFrame, share: float, folder: str) -> DataFrame:
    """Adds probability = min(1, c * rate), c such that share of all tokens is expected."""
    cells = written(cells.withColumn("rate", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens"))), f"{folder}/rates")
    total, fitted = cells.agg(F.sum("tokens"), F.sum(F.when(F.col("w") > 0, F.col("tokens")))).first()
    budget = min(share * (total or 0.0), fitted or 0.0)
    c, certain = 0.0, -1
    while True:
        # cells whose probability has reached 1 give all their tokens; c shares out the rest
        sure = F.col("rate") * c >= 1 if c else F.lit(False)
        n, full, rest = cells.where("rate > 0").agg(F.count_if(sure), F.sum(F.when(sure, F.col("tokens")).otherwise(0.0)), F.sum(F.when(sure, 0.0).otherwise(F.col("w")))).first()
        if n == certain or not rest:
            break
        certain, c = n, (budget - full) / rest
    return cells.withColumn("probability", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("rate") * F.lit(float(c)))).otherwise(1.0))


def drawn(ids: Column, probability: Column, seed: int) -> Column:
    """Whether a uniform number made from the id by hash lies under the probability."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), ids), 11) / F.lit(float(1 << 53))
    return u < probability


def mix(docs: DataFrame, share: float, dims: tuple[str, ...] = ("source", "lang", "topic"), targets: dict[str, DataFrame] | None = None, power: float = 0.7, seed: int = 42, id_col: str = "doc_id", tokens_col: str = "tokens", strict: bool = False) -> DataFrame:
    """docs (with the columns dims and tokens) and a struct mixed: the cell's weight w, rate and probability; sampled; off."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "mixing")
    named = {d: F.coalesce(F.col(f"`{d}`").cast("string"), F.lit(NONE)) for d in dims}
    cells = written(docs.groupBy(*[c.alias(d) for d, c in named.items()]).agg(F.sum(f"`{tokens_col}`").alias("tokens")), f"{folder}/cells")
    targets = {d: (targets or {}).get(d) or tempered(cells, d, power) for d in dims}
    raked, off = fit(cells, targets, folder)
    if strict and off > TOLERANCE:
        raise ValueError(f"targets contradict one another: a marginal is missed by {off:.3g} of its share")
    cells = calibrate(raked, share, folder)
    cells = written(cells.select(F.struct(*dims).alias("cell"), "w", "rate", "probability"), f"{folder}/mixed")
    keyed = docs.select(packed(docs), F.struct(*[c.alias(d) for d, c in named.items()]).alias("cell"))
    joined = keyed.join(broadcast_if_small(cells), "cell")
    mixed = F.struct("w", "rate", "probability", drawn(F.col("row")[id_col], F.col("probability"), seed).alias("sampled"), F.lit(float(off)).alias("off"))
    return added(joined, {"mixed": mixed}, docs.columns)


def with_topic(docs: DataFrame) -> DataFrame:
    """docs with tokens and the stand-in topic; columns of these names are replaced."""
    return docs.withColumn("topic", topic_of(F.col("text"))).withColumn("tokens", tokens_of(F.col("text")))


def sample(docs: DataFrame, share: float) -> DataFrame:
    """The documents drawn, with the columns they came with."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "source", "lang", topic_of(F.col("text")).alias("topic"), tokens_of(F.col("text")).alias("tokens"))
    return mix(row, share).where("mixed.sampled").select("doc.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens, raked to tempered marginals of source, language and topic."""
    docs = with_topic(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).drop("text")
    return mix(docs, share=0.5).select("doc_id", "source", "lang", "topic", F.col("tokens").cast("long").alias("n_tokens"), F.round("mixed.probability", 6).alias("probability"), F.col("mixed.sampled").alias("sampled"))
