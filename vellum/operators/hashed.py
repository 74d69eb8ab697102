"""Hashed vectors of texts: runs of one to four characters and words, told apart inside a batch and hashed once a worker."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Characters that are counted at once, about, and tokens whose hashes a worker remembers; neither changes what comes out.
CHARS, REMEMBERED = 1 << 19, 1 << 18
#: Characters of the longest run.
GRAM = 4
_WORDS = re.compile("[a-z0-9_]+")


class Slots:
    """token -> 2 * slot + 1 if its sign is negative, as text.token_slot has them."""

    def __init__(self, dim: int):
        self.dim, self.known = dim, {}

    def of(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, out = self.known, []
        for t in tokens:
            v = known.get(t)
            if v is None:
                d = hashlib.md5(t.encode(), usedforsecurity=False).digest()
                v = known[t] = int.from_bytes(d[:4], "big") % self.dim * 2 + d[4] % 2
            out.append(v)
        return np.array(out, np.int64)


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Texts by CHARS characters: rows, pieces, and of each piece how many of its first places start runs; the last pieces lend their starts to those before."""
    rows, found, starts, size = [], [], [], 0
    for row, t in enumerate(texts):
        for at in range(0, len(t), CHARS):
            rows.append(row)
            found.append(t[at : at + CHARS + GRAM - 1])
            starts.append(min(CHARS, len(t) - at))
            size += starts[-1]
            if size >= CHARS:
                yield rows, found, starts
                rows, found, starts, size = [], [], [], 0
    if rows:
        yield rows, found, starts


def weights(lowered: list[str], flat: list[str], slots: Slots) -> np.ndarray:
    """Texts in lower case, and these without white space: signs of their tokens added up, by text and slot."""
    out = np.zeros(len(flat) * slots.dim, np.int64)

    def add(rows: np.ndarray, packed: np.ndarray) -> None:
        at = rows * slots.dim + (packed >> 1)
        low = int(at.min()) if len(at) else 0
        got = np.bincount(at - low, 1 - 2 * (packed & 1)).astype(np.int64)
        out[low : low + len(got)] += got

    for row, t in enumerate(lowered):
        if words := _WORDS.findall(t):
            packed = slots.of(words)
            add(np.full(len(packed), row), packed)
    for rows, pieces, starts in _pieces(flat):
        whole, lengths = "".join(pieces), np.array([len(p) for p in pieces])
        row = np.repeat(np.array(rows), lengths)
        place = np.arange(len(whole)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        own, left = place < np.repeat(np.array(starts), lengths), np.repeat(lengths, lengths) - place
        one, _ = pd.factorize(np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.int64))
        kinds, run = int(one.max()) + 1, one
        for n in range(1, GRAM + 1):
            if n > 1:  # a run is the run before it and one more character
                run, _ = pd.factorize(run[:-1] * kinds + one[n - 1 :])
            at = np.flatnonzero(own[: len(run)] & (left[: len(run)] >= n))
            if not len(at):
                break
            met = run[at]
            first = np.full(int(met.max()) + 1, -1)
            first[met[::-1]] = at[::-1]
            there = np.flatnonzero(first >= 0)
            packed = np.zeros(len(first), np.int64)
            packed[there] = slots.of([whole[i : i + n] for i in first[there].tolist()])
            add(row[at], packed[met])
    return out.reshape(len(flat), slots.dim)


def vectors(docs: DataFrame, id_col: str, text: Column, dim: int) -> DataFrame:
    """Rows (id, slot, weight, value) of each id's unit vector; an id's texts are added up, null ones left out.

    Whole vectors move, one for each text, and are taken apart behind the shuffle.
    """

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _added(batch.column(1), dim)
                at, slot = np.nonzero(v)
                w = v[at, slot]
                value = w / np.sqrt((v * v).sum(axis=1))[at]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(slot.astype(np.int32)), pa.array(w), pa.array(value)], names=[id_col, "slot", "weight", "value"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return _counted(docs, id_col, text, dim).mapInArrow(apart, f"`{id_col}` {kind}, slot int, weight long, value double")


def whole(docs: DataFrame, id_col: str, text: Column, dim: int) -> DataFrame:
    """Rows (id, v) of each id's weights by slot, dim of them; those of vectors, not taken apart."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _added(batch.column(1), dim)
                lists = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * dim, v.ravel().astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "v"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return _counted(docs, id_col, text, dim).mapInArrow(added, f"`{id_col}` {kind}, v array<int>")


def _added(vs: pa.ListArray, dim: int) -> np.ndarray:
    """Lists of vectors added up, one row for each list."""
    each = vs.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    ends = np.cumsum(vs.value_lengths().to_numpy(zero_copy_only=False))
    return np.add.reduceat(each, np.r_[0, ends[:-1]], axis=0, dtype=np.int64)


def _counted(docs: DataFrame, id_col: str, text: Column, dim: int) -> DataFrame:
    """Rows (id, vs) of the weights of each of an id's texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(dim)
        for batch in batches:
            w = weights(batch.column(1).to_pylist(), batch.column(2).to_pylist(), slots)
            lists = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * dim, w.ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "v"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    asked = docs.where(text.isNotNull()).select(id_col, F.lower(text).alias("lowered"), T.flat(text).alias("flat"))
    return asked.mapInArrow(counted, f"`{id_col}` {kind}, v array<int>").groupBy(id_col).agg(F.collect_list("v").alias("vs"))
