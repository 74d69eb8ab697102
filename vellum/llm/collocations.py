"""Collocations: frequent phrases of each language, scored by how much oftener their parts meet than by chance.

Phrases are mined by pivot partitioning (as MG-FSM does). Every phrase is owned by its rarest word, its pivot (the first of equally
rare ones). A first pass counts words. A second one rewrites the text around each word to the part that its phrases can lie in: words
rarer than it, rare ones and those beyond the longest phrase are cut away, equal fragments of a task are folded into one with a
weight, and fragments go to their pivot. There phrases are counted alone, and only those that the pivot owns are put out, so
each phrase is counted in one place. Frequent words have few words at least as frequent around them, so their fragments fold well;
a pivot with more than one of SHARES of all words is dealt over several parts all the same, and one with more than MINED fragments
is counted piece by piece; such partial counts are added up afterwards.

To tell which of two words is rarer every task needs frequencies. They come from a table of COUNTERS sums by a hash of the word,
4 MB whatever the vocabulary, so words of one counter count as equally rare. Any order that all tasks share gives the same counts.

Defined results: null text counts as empty; null language as `und`; rows count alone, repeated ones and those without an id too; an
empty table gives an empty result; columns other than text and language are ignored, whatever their names. Scores are exact while
1,000,000 * a * a stays under 10^38 (beyond, an error).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, give_back, join_counted, shared_dir, table, written

MIN_COUNT, MAX_WORDS, TOP = 10, 3, 2000
#: A phrase goes if a longer candidate around it has this share of its occurrences.
COVERED = (50, 100)
#: Counters of the table of frequencies.
COUNTERS = 1 << 20
#: A pivot that holds one of so many shares of all words, or more, is dealt over several parts.
SHARES = 4096
#: Bytes of texts rewritten together; different words that a task counts before it puts them out.
CHUNK, WORDS = 4 << 20, 300_000
#: Fragments mined together, about; of one pivot at most.
MINED = 1 << 19
#: Parts that a language's candidates are ranked in before the last ranking.
RANKED = 64

#: A-Z in lower case; what ends a piece becomes a point, which no word holds; tabs become spaces.
_TABLE = bytearray(range(256))
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _TABLE[_c] = _c + 32
for _c in b",;:!?\n\x0b\x0c\r":
    _TABLE[_c] = ord(".")
_TABLE[9] = 32


def tokens_of(texts: list[bytes]) -> list[bytes]:
    """Words of all texts in order, with a point where a piece ends."""
    return b".".join(texts).translate(_TABLE).replace(b".", b" . ").split()


class Numbers(dict):
    """Numbers of words in the order they are met; the point is 0."""

    def __init__(self):
        super().__init__({b".": 0})
        self.words = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


def chunks(batches, size: int) -> Iterator[tuple[str, list[bytes]]]:
    """(language, tokens) of texts of `size` bytes or more at a time; batches hold (lang, text)."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_py()
            if not raw:
                continue
            held.setdefault(lang, []).append(raw)
            sizes[lang] = sizes.get(lang, 0) + len(raw)
            if sizes[lang] >= size:
                sizes.pop(lang)
                yield lang, tokens_of(held.pop(lang))
        if sum(sizes.values()) > 8 * size:
            yield from ((x, tokens_of(t)) for x, t in held.items())
            held, sizes = {}, {}
    yield from ((x, tokens_of(t)) for x, t in held.items())


def word_counts(texts: DataFrame, folder: str) -> DataFrame:
    """(lang, word, f) of texts (lang, text as bytes)."""

    def run(batches):
        seen: dict[str, tuple[Numbers, np.ndarray]] = {}

        def told():
            for lang, (numbers, n) in seen.items():
                some = np.flatnonzero(n[1:]) + 1
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([numbers.words[i] for i in some], pa.binary()), pa.array(n[some], pa.int64())], names=["lang", "word", "f"])

        for lang, tokens in chunks(batches, CHUNK):
            numbers, n = seen.get(lang) or (Numbers(), np.zeros(0, np.int64))
            more = np.bincount(numbers.of(tokens), minlength=len(numbers.words))
            more[: len(n)] += n
            seen[lang] = (numbers, more)
            if sum(len(x.words) for x, _ in seen.values()) > WORDS:
                yield from told()
                seen = {}
        yield from told()
        give_back()

    counted = texts.mapInArrow(run, "lang string, word binary, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    return written(counted.select("lang", F.col("word").cast("string").alias("word"), "f"), f"{folder}/words")


def counters_of(words: DataFrame) -> np.ndarray:
    """Frequencies added up by the counter of each word: COUNTERS numbers, of which the driver reads those that aren't 0."""
    key = F.crc32(F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), F.col("word").cast("binary"))) % COUNTERS
    sums = words.groupBy(key.cast("int").alias("counter")).agg(F.sum("f").cast("float").alias("f")).toArrow()
    out = np.zeros(COUNTERS, np.float32)
    out[sums["counter"].to_numpy()] = sums["f"].to_numpy()
    return out


def fragments_of(ids: np.ndarray, often: np.ndarray, longest: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(fragments, times): rows of numbers, the pivot first, then its left neighbours from the farthest, then the right ones; 0: none.

    often: the frequency of each number; ids are the words in order, 0 between pieces.
    """
    f = often[ids]
    fine = (ids != 0) & (f >= least)
    columns, has = {}, None
    for side, more in ((-1, np.greater), (1, np.greater_equal)):
        reach = fine.copy()
        for d in range(1, longest):
            near, f_near = np.zeros_like(ids), np.zeros_like(f)
            if side < 0:
                near[d:], f_near[d:] = np.where(fine, ids, 0)[:-d], f[:-d]
            else:
                near[:-d], f_near[:-d] = np.where(fine, ids, 0)[d:], f[d:]
            reach = reach & (near != 0) & more(f_near, f)
            columns[side * d] = np.where(reach, near, 0)
            if d == 1:
                has = reach if has is None else has | reach
    at = np.flatnonzero(has)
    made = np.stack([ids[at], *[columns[d][at] for d in sorted(columns)]])
    made = made[:, np.lexsort(made[::-1])]
    new = np.ones(made.shape[1], bool)
    new[1:] = (made[:, 1:] != made[:, :-1]).any(axis=0)
    starts = np.flatnonzero(new)
    return made[:, starts], np.diff(np.append(starts, made.shape[1]))


def fragments(texts: DataFrame, counters: np.ndarray, longest: int, least: int) -> DataFrame:
    """(lang, pivot, part, split, fragments): fragments of a task's texts for a pivot, one a line: neighbours and weight, divided by spaces."""
    total = float(counters.sum(dtype=np.float64)) or 1.0
    sent = texts.sparkSession.sparkContext.broadcast(counters)

    def run(batches):
        seen: dict[str, tuple[Numbers, np.ndarray]] = {}
        task, k = TaskContext.get().partitionId(), 0
        for lang, tokens in chunks(batches, CHUNK):
            k += 1
            numbers, often = seen.get(lang) or (Numbers(), np.zeros(1, np.float32))
            ids = numbers.of(tokens)
            prefix = lang.encode() + b"\0"
            places = [zlib.crc32(prefix + w) % COUNTERS for w in numbers.words[len(often) :]]
            often = np.concatenate((often, sent.value[np.array(places, np.int64)]))
            made, times = fragments_of(ids, often, longest, least)
            seen[lang] = (numbers, often)
            if made.shape[1]:
                words = pa.array(numbers.words, pa.binary())
                lines = pc.binary_join_element_wise(*[words.take(pa.array(c)) for c in made[1:]], pc.cast(pc.cast(pa.array(times), pa.string()), pa.binary()), pa.scalar(b" ", pa.binary()))
                pivots = np.flatnonzero(np.append(True, made[0, 1:] != made[0, :-1]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(pivots, made.shape[1]), pa.int32()), lines)
                pivot = made[0, pivots]
                parts = 1 + (often[pivot] * (SHARES / total)).astype(np.int64)
                columns = [pa.array([lang] * len(pivot), pa.string()), words.take(pa.array(pivot)), pa.array((task * 7919 + k) % parts, pa.int64()), pa.array(parts > 1), pc.binary_join(lists, pa.scalar(b"\n", pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "pivot", "part", "split", "fragments"])
            if sum(len(x.words) for x, _ in seen.values()) > WORDS:
                seen = {}
        give_back()

    return texts.mapInArrow(run, "lang string, pivot binary, part long, split boolean, fragments binary")


def phrases_of(rows: list[tuple[bytes, bytes]], longest: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(number of words, phrases, counts) of (pivot, fragments) rows: all phrases that hold the pivot."""
    numbers = Numbers()
    width = 2 * longest - 1
    parts = [f.split(b"\n") for _, f in rows]
    pivot = np.repeat(numbers.of([p for p, _ in rows]), [len(x) for x in parts])
    numbers[b""] = 0
    fields = numbers.of(b" ".join(b" ".join(x) for x in parts).split(b" ")).reshape(-1, width)
    weights = fields[:, -1]
    known = np.unique(weights)
    times = np.array([int(numbers.words[i]) for i in known], np.int64)[np.searchsorted(known, weights)]
    words = pa.array(numbers.words, pa.binary())
    line = [*(fields[:, i] for i in range(longest - 1)), pivot, *(fields[:, i] for i in range(longest - 1, width - 1))]
    for size in range(2, longest + 1):
        found, n = [], []
        for start in range(longest - size, longest):
            columns = line[start : start + size]
            whole = np.logical_and.reduce([c != 0 for c in columns])
            found.append(np.stack([c[whole] for c in columns])), n.append(times[whole])
        found, n = np.concatenate(found, axis=1), np.concatenate(n)
        order = np.lexsort(found[::-1])
        found, n = found[:, order], n[order]
        if not len(n):
            continue
        starts = np.flatnonzero(np.append(True, (found[:, 1:] != found[:, :-1]).any(axis=0)))
        yield size, words, found[:, starts], np.add.reduceat(n, starts)


def mined(routed: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, phrase, size, n): phrases counted at their pivots; below `least` only those of pivots that were counted in parts."""

    def run(batches):
        lang, last, broken, held, of_last = None, None, False, ([], []), 0
        now: list[tuple[bytes, bytes]] = []

        def told():
            for rows, bar in zip(held, (least, 1), strict=True):
                for size, numbers, found, n in phrases_of(rows, longest) if rows else ():
                    some = np.flatnonzero(n >= bar)
                    phrases = pc.binary_join_element_wise(*[numbers.take(pa.array(c[some])) for c in found], pa.scalar(b" ", pa.binary()))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), phrases, pa.array([size] * len(some), pa.int32()), pa.array(n[some], pa.int64())], names=["lang", "phrase", "size", "n"])
                rows.clear()

        size = 0
        for batch in batches:
            columns = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)
            for row_lang, pivot, part, split, made in zip(*columns, strict=True):
                key = (row_lang, pivot.as_py(), part)
                if key != last:
                    held[broken].extend(now)
                    now, of_last = [], 0
                    if row_lang != lang or size >= MINED:
                        yield from told()
                        size = 0
                    lang, last, broken = row_lang, key, split
                now.append((pivot.as_py(), made.as_py()))
                n = now[-1][1].count(b"\n") + 1
                size, of_last = size + n, of_last + n
                if of_last >= MINED:  # a pivot with so many fragments is counted piece by piece
                    broken = True
                    held[1].extend(now)
                    yield from told()
                    now, size, of_last = [], 0, 0
        held[broken].extend(now)
        yield from told()
        give_back()

    near = routed.repartition("lang", "pivot", "part").sortWithinPartitions("lang", "pivot", "part")
    return near.select("lang", "pivot", "part", "split", "fragments").mapInArrow(run, "lang string, phrase binary, size int, n long")


def candidates(texts: DataFrame, words: DataFrame, folder: str, longest: int = MAX_WORDS, least: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, size, a): all phrases of 2 to `longest` words with `least` occurrences or more. words: word_counts(texts)."""
    routed = fragments(texts, counters_of(words), longest, least)
    found = mined(routed, longest, least).groupBy("lang", "phrase", "size").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    return written(found.select("lang", F.col("phrase").cast("string").alias("phrase"), "size", "a"), f"{folder}/candidates")


def scored(found: DataFrame, words: DataFrame, folder: str, least: int = MIN_COUNT) -> DataFrame:
    """found with k, l, r and score of the lowest-scoring cut."""
    parts = words.where(F.col("f") >= least).select("lang", F.col("word").alias("phrase"), "f").unionByName(found.select("lang", "phrase", F.col("a").alias("f")))
    parts = written(parts, f"{folder}/parts")
    total = parts.agg(F.sum("f")).first()[0] or 0
    split = F.split("phrase", " ")
    told = lambda a, n: F.array_join(F.slice(split, a, n), " ")
    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("*", told(F.lit(1), F.col("k")).alias("first"), told(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    # a part of n occurrences stands in n / least candidates at most
    cuts = join_counted(cuts, parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"], "l", total)
    cuts = join_counted(cuts, parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"], "r", total)
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("over", F.lit(1_000_000).cast("decimal(7,0)") * exact("a") * exact("a")).withColumn("under", exact("l") * exact("r"))
    best = cuts.select("lang", "phrase", "size", "a", F.struct(F.expr("over div under").alias("score"), "k", "l", "r").alias("cut"))
    return best.groupBy("lang", "phrase", "size", "a").agg(F.min("cut").alias("cut")).select("lang", "phrase", "size", "a", "cut.*")


def uncovered(found: DataFrame) -> DataFrame:
    """Candidates that no longer candidate holds with COVERED of their occurrences."""
    split = F.split("phrase", " ")
    inner = found.where("size > 2").select("lang", "a", "size", split.alias("w"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("n"))
    inner = inner.select("lang", "a", "w", "n", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)).alias("from"))
    inner = inner.groupBy("lang", F.array_join(F.slice("w", F.col("from"), F.col("n")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    goes = F.coalesce(F.col("longer") * COVERED[1] >= F.col("a") * COVERED[0], F.lit(False))
    return found.join(inner, ["lang", "phrase"], "left").where(~goes).drop("longer")


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` of each language; ranked in parts first, so that no task ranks all of a language's candidates."""
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANKED))
    near = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    near = near.where(F.col("rank") <= top).drop("part", "rank")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = MAX_WORDS, least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    folder = shared_dir(docs.sparkSession, "collocations")
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    words = word_counts(texts, folder)
    found = candidates(texts, words, folder, longest, least)
    best = ranked(uncovered(scored(found, words, folder, least)), top)
    sizes = written(words.groupBy("lang").agg(F.sum("f").alias("n")), f"{folder}/sizes")
    return best.join(broadcast_if_small(sizes), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
