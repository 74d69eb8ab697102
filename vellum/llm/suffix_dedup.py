"""Removal of long repeated passages, by interval expansion on a Burrows-Wheeler transform.

1. Every window of `length` bytes is given to the leftmost least k-byte hash inside it, its anchor. Equal
   windows have equal anchors, and every window has one, so windows fall into segments around anchors.
   Segments whose anchor is met once hold no repeat.
2. The segments of every anchor met several times are cut from their texts and folded: segments with the same
   bytes are one piece with a number of copies. (Bytes are compared; segments go by 64-bit hashes afterwards,
   and if two different ones of an anchor share a hash, all is hashed anew.) All pieces of an anchor go to one
   task, in blocks of bounded size; a piece counts there for its number of copies. A piece is first cut down to the windows
   whose common bytes another one of its anchor shares.
3. In a block the suffixes are put in order up to `length` bytes and their Burrows-Wheeler transform is
   taken. Breadth-first backward extension starts from the intervals of single bytes; an interval is
   extended only if its right end is a boundary not seen before, so the step at which a boundary is first
   met is its common prefix plus one. Steps stop at `length`: neighbours without a boundary between them
   share a window.
4. The pieces of an anchor with more than GROUP of them are cut into shorter runs of windows, each keyed by the
   bytes that all its windows share, and folded again; where a key still has too many, so are these, down to
   single windows, of which a key has one. They all go through step 3.

Spans are half-open byte ranges. Defined results: a null or empty text has no bytes; matches never cross
documents; a text shorter than `length` keeps all bytes; rows that repeat a text lose every byte that a
window covers, also when they repeat the id; rows with a null id are treated like any other; an empty
table gives an empty result; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, give_back, shared_dir, table, written
from .shingles import mix

ANCHOR = 64
#: Bytes hashed at a time; positions in it must fit the low bits of a hash.
CHUNK = 1 << 20
#: Distinct segments of one anchor that one block may hold.
GROUP = 256
#: Bytes of segments after which a block is closed.
BLOCK_BYTES = 128 << 10
#: Windows in a run, step by step, for keys with more than GROUP pieces.
RUNS = (48, 8, 1)
#: Bytes of pieces that one task holds to fold copies before they are shuffled.
FOLD_BYTES = 16 << 20

_BASE = 0x9E3779B97F4A7C15


# --- anchors --------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _powers(inverse: bool) -> np.ndarray:
    step = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    out = np.ones(CHUNK + 1, np.uint64)
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([out[:1], np.full(CHUNK, step, np.uint64)]))


def anchors(data: np.ndarray, ends: np.ndarray, length: int, k: int = ANCHOR):
    """Runs of windows with one anchor in data, texts laid end to end; no window crosses an end.

    Returns the first window's start, the last one's, the anchor's place and its hash.
    """
    n, w = len(data), length - k + 1
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(False)[:n], out=sums[1:])
    h = mix((sums[k:] - sums[:-k]) * _powers(True)[: n - k + 1])
    least = (h & np.uint64(-CHUNK & (1 << 64) - 1)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: span - w], least[w - span :])
    inside = np.zeros(n + 1, np.int8)
    starts = np.concatenate([[0], ends[:-1]])
    fits = ends - starts >= length
    inside[starts[fits]] += 1
    inside[ends[fits] - length + 1] -= 1
    first = np.flatnonzero(np.cumsum(inside)[: len(least)])
    if not len(first):
        return none, none, none, np.empty(0, np.uint64)
    place = (least[first] & np.uint64(CHUNK - 1)).astype(np.int64)
    new = np.r_[True, (place[1:] != place[:-1]) | (first[1:] != first[:-1] + 1)]
    lo = first[new]
    hi = np.r_[first[np.flatnonzero(new)[1:] - 1], first[-1]]
    at = place[new]
    return lo, hi, at, h[at]


SEGMENT = "anchor long, seg long, id long, text_key long, lo long, windows int, at int"


def segment_digest(raw: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(raw, seed=seed)


def _segments(length: int, seed: int, digest):
    """(id, text_key, bytes) -> a row for each run of windows with one anchor."""
    names = [x.split()[0] for x in SEGMENT.split(", ")]

    def chunks(batches):
        """Texts laid end to end up to CHUNK bytes; a longer text in pieces that share length - 1 bytes."""
        held, size = [], 0
        for batch in batches:
            for id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.as_py()
                if len(raw) < length:
                    continue
                for from_ in range(0, len(raw) - length + 1, CHUNK - length + 1):
                    piece = raw[from_ : from_ + CHUNK]
                    if size + len(piece) > CHUNK:
                        yield held
                        held, size = [], 0
                    held.append((id, key, from_, piece))
                    size += len(piece)
        if held:
            yield held

    def run(batches):
        for held in chunks(batches):
            raw = b"".join(x[3] for x in held)
            ends = np.cumsum([len(x[3]) for x in held])
            lo, hi, at, h = anchors(np.frombuffer(raw, np.uint8), ends, length)
            if not len(lo):
                continue
            seg = np.array([digest(raw[a:b], seed) for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)], np.uint64)
            of = np.searchsorted(ends, lo, "right")
            shift = (np.concatenate([[0], ends[:-1]]) - np.array([x[2] for x in held]))[of]
            cols = [h.view(np.int64), seg.view(np.int64), np.array([x[0] for x in held], np.int64)[of], np.array([x[1] for x in held], np.int64)[of], lo - shift, (hi - lo + 1).astype(np.int32), (at - lo).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    return run


# --- blocks ---------------------------------------------------------------------------------------


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first depth symbols (of 9 bits), by prefix doubling."""
    n = len(symbols)
    key, h = np.zeros(n, np.uint64), 7
    wide = np.concatenate([symbols, np.zeros(h, symbols.dtype)]).astype(np.uint64)
    for j in range(h):
        key |= wide[j : n + j] << np.uint64(9 * (h - 1 - j))
    while True:
        order = np.argsort(key)
        if h >= depth:
            return order
        ordered = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]])
        step = min(h, depth - h)
        key = rank * np.uint64(n + 1)
        key[: n - step] += rank[step:]
        h += step


def long_prefix_groups(symbols: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place of order a number, equal for neighbours that share depth symbols without a 0."""
    n = len(symbols)
    bwt = symbols[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    front = bwt[by_symbol]
    lf = np.empty(n, np.int64)
    lf[by_symbol] = np.arange(n)
    met = np.zeros(n + 1, bool)
    met[0] = met[n] = True
    cuts = np.flatnonzero(np.r_[True, front[1:] != front[:-1]])
    low, high = cuts, np.r_[cuts[1:], n]
    met[high] = True
    low, high = low[front[low] > 0], high[front[low] > 0]
    for _ in range(depth - 1):
        if not len(low):
            break
        sizes = high - low
        owner = np.repeat(np.arange(len(low)), sizes)
        places = np.arange(len(owner)) + np.repeat(low - np.cumsum(sizes) + sizes, sizes)
        real = bwt[places] > 0
        x, owner = lf[places[real]], owner[real]
        if not len(x):
            break
        by_place = np.argsort(x)
        x, owner = x[by_place], owner[by_place]
        cut = (x[1:] != x[:-1] + 1) | (owner[1:] != owner[:-1]) | (front[x[1:]] != front[x[:-1]])
        low, high = x[np.r_[True, cut]], x[np.r_[cut, True]] + 1
        new = ~met[high]
        low, high = low[new], high[new]
        met[high] = True
    return np.cumsum(met[:n])


def repeated_windows(segments: list[bytes], copies: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each of distinct segments the half-open runs of starts of windows met elsewhere among them.

    A segment stands in the transform once, and its places in an interval count for its number of copies.
    """
    raw = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes + 1) - 1
    symbols = raw.astype(np.uint16) + np.uint16(1)
    symbols[ends] = 0
    order = suffix_order(symbols, length)
    group = long_prefix_groups(symbols, order, length)
    of = np.searchsorted(ends, order)
    window = order + length <= ends[np.minimum(of, len(ends) - 1)]
    weight = np.minimum(np.array(copies), 2)[of[window]]
    many = np.bincount(group[window], weight, minlength=group[-1] + 1) > 1
    starts = np.sort(order[window & many[group]])
    of = np.searchsorted(ends, starts)
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    if len(starts):
        cut = np.flatnonzero(np.r_[True, starts[1:] != starts[:-1] + 1])
        last = np.r_[cut[1:], len(starts)] - 1
        begin = ends - sizes
        for i, a, b in zip(of[cut].tolist(), starts[cut].tolist(), starts[last].tolist(), strict=True):
            out[i].append((a - int(begin[i]), b - int(begin[i]) + 1))
    return out


def places(at: int, windows: int, run: int):
    """(place, first, last) of the runs that a segment's windows fall into by their distance to the anchor."""
    for p in range(max(0, at - windows + 1) // run, at // run + 1):
        yield p, max(0, at - (p + 1) * run + 1), min(windows - 1, at - p * run)


def core(raw: bytes, at: int, p: int, run: int, length: int) -> bytes:
    """The bytes that all windows of a place have in common, whatever segment they are of."""
    return raw[at - p * run : at - (p + 1) * run + 1 + length]


def _with_company(rows, length: int, run: int = RUNS[0]):
    """(n1, n2, first, copies, bytes) of rows (key, n1, n2, copies, at, bytes), cut down to the places whose core the key has again."""
    met = Counter()
    cores = []
    for key, _, _, copies, at, raw in rows:
        own = [((key, p, xxhash.xxh3_64_intdigest(core(raw, at, p, run, length))), a, b) for p, a, b in places(at, len(raw) - length + 1, run)]
        for c, _, _ in own:
            met[c] += copies
        cores.append(own)
    for (_, n1, n2, copies, _, raw), own in zip(rows, cores, strict=True):
        kept = sorted((a, b) for c, a, b in own if met[c] > 1)
        while kept:
            a, b = kept.pop(0)
            while kept and kept[0][0] == b + 1:
                b = kept.pop(0)[1]
            yield n1, n2, a, copies, raw[a : b + length]


PIECE = "key long, n1 long, n2 long, copies long, at int, bytes binary"
FOUND = "n1 long, n2 long, first int, past int"


def _batch(rows, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _solve(length: int):
    """Rows of PIECE, sorted by key -> runs of windows of a piece that are met elsewhere."""

    def block(rows):
        out = []
        cut = list(_with_company(rows, length))
        if cut:
            runs = repeated_windows([raw for *_, raw in cut], [copies for *_, copies, _ in cut], length)
            for (n1, n2, first, _, _), of_piece in zip(cut, runs, strict=True):
                out += [(n1, n2, first + a, first + b) for a, b in of_piece]
        return _batch(out, FOUND)

    def run(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            for key, *row in zip(*[batch.column(c).to_pylist() for c in ("key", "n1", "n2", "copies", "at", "bytes")], strict=True):
                if key != last and size >= BLOCK_BYTES:
                    yield block(rows)
                    rows, size = [], 0
                rows.append((key, *row))
                size += len(row[4])
                last = key
        yield block(rows)
        rows = None
        give_back()

    return run


def solve(pieces: DataFrame, length: int) -> DataFrame:
    rows = pieces.select("key", "n1", "n2", "copies", "at", "bytes")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_solve(length), FOUND)


CUT_PIECE = PIECE + ", of1 long, of2 long, first int"


def _cut(run: int, length: int):
    """Pieces -> runs of at most `run` windows, keyed by place and the bytes that all windows of the place share.

    of1, of2 and first: the piece that a run is of, and its place there.
    """
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def cut(batches):
        for batch in batches:
            out = []
            for n1, n2, copies, at, raw in zip(*[batch.column(c).to_pylist() for c in ("n1", "n2", "copies", "at", "bytes")], strict=True):
                for p, a, b in places(at, len(raw) - length + 1, run):
                    piece = raw[a : b + length]
                    key = xxhash.xxh3_64_intdigest(core(raw, at, p, run, length), seed=p)
                    name = xxhash.xxh3_128_intdigest(piece, seed=key)
                    out.append((signed(key), signed(name >> 64), signed(name & (1 << 64) - 1), copies, at - a, piece, n1, n2, a))
            yield _batch(out, CUT_PIECE)

    return cut


def fold(pieces: DataFrame, path: str) -> DataFrame:
    """Pieces with the same bytes as one, with their copies added up."""
    return written(pieces.groupBy("key", "n1", "n2", "bytes").agg(F.sum("copies").alias("copies"), F.min("at").alias("at")), path)


def ambiguous(pieces: DataFrame) -> bool:
    """Whether two different pieces have one name."""
    return not pieces.groupBy("n1", "n2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def repeated(pieces: DataFrame, length: int, folder: str, group: int = GROUP, step: int = 0) -> DataFrame:
    """pieces: PIECE, folded. Runs of repeated windows of each, as FOUND."""
    counts = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    large = written(counts.where(F.col("n") > group).select("key"), f"{folder}/large-{step}")
    if large.isEmpty():
        return solve(pieces, length)
    large = broadcast_if_small(large)
    found = written(solve(pieces.join(large, "key", "left_anti"), length), f"{folder}/found-{step}")
    rows = written(pieces.join(large, "key", "left_semi").mapInArrow(_cut(RUNS[step], length), CUT_PIECE), f"{folder}/cut-{step}")
    runs = fold(rows, f"{folder}/folded-{step}")
    if ambiguous(runs):
        raise RuntimeError("two different runs of windows have one 128-bit hash")
    inner = written(repeated(runs, length, folder, group, step + 1), f"{folder}/inner-{step}")
    back = rows.select("n1", "n2", "of1", "of2", F.col("first").alias("at")).join(inner, ["n1", "n2"])
    return found.unionByName(back.select(F.col("of1").alias("n1"), F.col("of2").alias("n2"), (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("past")).alias("past")))


# --- the operator ---------------------------------------------------------------------------------


def _keys(id: Column, text: Column) -> tuple[Column, Column]:
    """A row's name: its id, and a hash of its text for rows whose id is null or repeated."""
    return F.coalesce(id.cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("text_key")


def _pieces(length: int):
    """Texts with their segments -> pieces, copies in one task folded."""

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            for raw, wanted in zip(batch.column("bytes").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                for s in wanted:
                    piece = raw[s["lo"] : s["lo"] + s["windows"] - 1 + length]
                    one = held.get(k := (s["anchor"], s["seg"], piece))
                    if one is None:
                        held[k] = [1, s["at"]]
                        size += len(piece)
                    else:
                        one[0] += 1
                if size >= FOLD_BYTES:
                    yield _batch([(a, a, g, c, at, x) for (a, g, x), (c, at) in held.items()], PIECE)
                    held, size = {}, 0
        yield _batch([(a, a, g, c, at, x) for (a, g, x), (c, at) in held.items()], PIECE)
        held = None
        give_back()

    return run


def repeated_spans(docs: DataFrame, length: int, folder: str, group: int = GROUP, digest=segment_digest) -> DataFrame:
    """docs: (id, text_key, bytes). (id, text_key, spans): byte ranges of windows met elsewhere, as found."""
    seed, top = 0, folder
    while True:
        segs = written(docs.select("id", "text_key", "bytes").mapInArrow(_segments(length, seed, digest), SEGMENT), f"{folder}/segments")
        met = written(segs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), f"{folder}/met")
        hits = written(segs.join(met, "anchor"), f"{folder}/hits")
        # rows that repeat id and text ask once, and each of them then gives its own copies
        asked = written(hits.groupBy("id", "text_key").agg(F.collect_set(F.struct("anchor", "seg", "lo", "windows", "at")).alias("asked")), f"{folder}/asked")
        texts = docs.select("id", "text_key", "bytes").join(asked, ["id", "text_key"])
        pieces = fold(texts.mapInArrow(_pieces(length), PIECE), f"{folder}/pieces")
        if not ambiguous(pieces):
            break
        seed += 1
        folder = f"{top}/{seed}"
    found = repeated(pieces, length, folder, group)
    found = written(found.groupBy("n1", "n2").agg(F.collect_set(F.struct("first", "past")).alias("runs")), f"{folder}/found")
    part = hits.join(found, (F.col("anchor") == F.col("n1")) & (F.col("seg") == F.col("n2"))).select("id", "text_key", "lo", F.explode("runs").alias("r"))
    spans = part.select("id", "text_key", (F.col("lo") + F.col("r.first")).alias("start"), (F.col("lo") + F.col("r.past") - 1 + length).alias("end"))
    return spans.groupBy("id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"


def _remove(batches):
    """Spans are merged where they touch; the bytes outside them are kept."""
    for batch in batches:
        out = []
        for id, raw, spans in zip(batch.column("doc_id").to_pylist(), batch.column("bytes").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            runs: list[list[int]] = []
            for s in sorted((s["start"], s["end"]) for s in spans or ()):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append(list(s))
            kept, at = [], 0
            for a, b in runs:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            out.append((id, len(raw), sum(b - a for a, b in runs), len(runs), [{"start": a, "end": b} for a, b in runs], b"".join(kept)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        cols = list(zip(*out, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])


def suffix_dedup(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, digest=segment_digest) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, spans, kept (the bytes left)."""
    folder = shared_dir(docs.sparkSession, "suffix")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    id, key = _keys(F.col(f"`{id_col}`"), text)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), id, key, text.cast("binary").alias("bytes"))
    spans = written(repeated_spans(docs, length, folder, group, digest), f"{folder}/spans")
    return docs.join(spans, ["id", "text_key"], "left").select("doc_id", "bytes", "spans").mapInArrow(_remove, CUT)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
