"""Byte-level BPE: encoding with a hierarchical-bitmap rank queue, and decoding.

A pre-token's bytes form a doubly linked list. Every adjacent pair whose joined bytes have a rank is
filed in that rank's bucket, a heap of list positions; a two-level bitmap over the ranks marks the
buckets in use, so find-first-set gives the next rank in two steps whatever the pre-token's length.
An entry whose pair has changed meanwhile is stale and skipped. A pre-token of n bytes costs n log n.

Ids are bytes of little-endian unsigned 32-bit integers. Defined results: a null or empty text has no
ids; a null or empty list of ids decodes to no bytes; rows are encoded alone, so ties and repeated
rows change nothing; an empty table gives an empty result; the other columns come through unchanged, but for
one that has the name of a column that is made, which is replaced.
A very long text is split into pre-tokens a piece at a time.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, table

#: Pre-tokens that one Python worker remembers as met lately; as many met before these are remembered beside them.
CACHE_ENTRIES = 250_000
#: Longer pre-tokens are not remembered.
CACHE_BYTES = 64
#: Pre-tokens of a text held at once.
PIECE = 1 << 16
#: Rows of a batch that is sent back.
ROWS = 1024

BIT = [1 << i for i in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class RankQueue:
    """Buckets of positions by rank: the least position of each in head (-1: empty), the others in a heap in rest.

    low: a bitmap of the ranks in use, in words of 256 bits; above it, while a pre-token is merged, stands one
    bitmap of the words in use.
    """

    def __init__(self, n_ranks: int):
        self.head = [-1] * n_ranks
        self.low = [0] * ((n_ranks >> 8) + 1)
        self.rest: dict[int, list[int]] = {}

    def more(self, rank: int, place: int) -> None:
        """Add to a bucket that isn't empty."""
        first = self.head[rank]
        if place < first:
            self.head[rank], place = place, first
        heappush(self.rest.setdefault(rank, []), place)


def merge(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """Ids of one pre-token. queue is empty before and after; most of its pushes and pops stand inline, for speed."""
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    head, low, rest, more, top = queue.head, queue.low, queue.rest, queue.more, 0
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))  # start of the part before
    of_pair = [get(piece[i : i + 2], -1) for i in range(n - 1)]  # rank of this part with the next
    of_pair.append(-1)
    i = 0
    for rank in of_pair:
        if rank >= 0:
            if head[rank] < 0:
                head[rank] = i
                h = rank >> 8
                if low[h]:
                    low[h] |= BIT[rank & 255]
                else:
                    low[h] = BIT[rank & 255]
                    top |= 1 << h
            else:
                more(rank, i)
        i += 1
    while top:
        # find-first-set, level by level
        h = (top & -top).bit_length() - 1
        w = low[h]
        bit = w & -w
        rank = (h << 8) + bit.bit_length() - 1
        i = head[rank]
        if rest and rank in rest:
            others = rest[rank]
            head[rank] = heappop(others)
            if not others:
                del rest[rank]
        else:
            head[rank] = -1
            low[h] = w = w ^ bit
            if not w:
                top ^= 1 << h
        if of_pair[i] != rank:
            continue  # stale
        j = end[i]
        e = end[i] = end[j]
        of_pair[j] = -1
        if e < n:
            before[e] = i
            of_pair[i] = rank = get(piece[i : end[e]], -1)
            if rank >= 0:
                if head[rank] < 0:
                    head[rank] = i
                    h = rank >> 8
                    if low[h]:
                        low[h] |= BIT[rank & 255]
                    else:
                        low[h] = BIT[rank & 255]
                        top |= 1 << h
                else:
                    more(rank, i)
        else:
            of_pair[i] = -1
        p = before[i]
        if p >= 0:
            of_pair[p] = rank = get(piece[p:e], -1)
            if rank >= 0:
                if head[rank] < 0:
                    head[rank] = p
                    h = rank >> 8
                    if low[h]:
                        low[h] |= BIT[rank & 255]
                    else:
                        low[h] = BIT[rank & 255]
                        top |= 1 << h
                else:
                    more(rank, p)
    ids, i = [], 0
    while i < n:
        e = end[i]
        ids.append(ranks[piece[i:e]])
        i = e
    return ids


class Encoder(dict):
    """Pre-token -> its ids as bytes; encodes what it hasn't met.

    When it is full its entries become the older half of the memory, and those that are met again come back.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)

    def __missing__(self, token: str) -> bytes:
        packed = self.older.get(token)
        if packed is None:
            piece = token.encode()
            ids = merge(piece, self.ranks, self.queue)
            packed = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) > CACHE_BYTES:
                return packed
        if len(self) >= CACHE_ENTRIES:
            self.older = self.copy()
            self.clear()
        self[token] = packed
        return packed

    def encode(self, text: str) -> bytes:
        if len(text) <= PIECE:
            return b"".join(map(self.__getitem__, self.pattern.findall(text)))
        tokens = (m.group() for m in self.pattern.finditer(text))
        out = bytearray()
        while part := list(islice(tokens, PIECE)):
            out += b"".join(map(self.__getitem__, part))
        return bytes(out)


_MADE: dict = {}  # of this Python worker: one encoder and one decoding table for each vocabulary


def _once(key: tuple, make):
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def _with_columns(docs: DataFrame, *steps) -> DataFrame:
    """docs and the binary columns of steps (source, out_col, job), in one pass: job makes out_col from source's values.

    A column of docs that has the name of one that is made is replaced.
    """
    made = [out_col for _, out_col, _ in steps]
    lower = {x.lower() for x in made}
    kept = [i for i, f in enumerate(docs.schema.fields) if f.name.lower() not in lower]
    schema = T.StructType([*[docs.schema.fields[i] for i in kept], *[T.StructField(x, T.BinaryType()) for x in made]])

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                at = dict(zip(batch.schema.names, batch.columns, strict=True))
                for source, out_col, job in steps:
                    at[out_col] = pa.array(job(at[source]), pa.binary())
                columns = [*[batch.column(i) for i in kept], *[at[x] for x in made]]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])
        give_back()

    return docs.mapInArrow(run, schema)


def _encoding(spark: SparkSession, ranks_path: str, pattern: str):
    with open(ranks_path, "rb") as f:
        data = f.read()
    sent = spark.sparkContext.broadcast(data)
    key = hashlib.sha256(data + pattern.encode()).hexdigest()

    def job(texts):
        encoder = _once(("encode", key), lambda: Encoder(read_ranks(sent.value), pattern))
        return [encoder.encode(t.as_py() or "") for t in texts]

    return job


def _decoding(spark: SparkSession, ranks_path: str):
    with open(ranks_path, "rb") as f:
        data = f.read()
    sent = spark.sparkContext.broadcast(data)
    key = hashlib.sha256(data).hexdigest()

    def by_id() -> np.ndarray:
        ranks = read_ranks(sent.value)
        tokens = np.full(max(ranks.values(), default=0) + 1, None, object)
        tokens[list(ranks.values())] = list(ranks)
        return tokens

    def job(ids):
        tokens = _once(("decode", key), by_id)
        return [b"".join(tokens[np.frombuffer(x.as_py() or b"", "<u4")].tolist()) for x in ids]

    return job


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with the ids of each whole text. The vocabulary file is read once by the driver and sent along."""
    return _with_columns(docs, (text_col, out_col, _encoding(docs.sparkSession, ranks_path, pattern)))


def decode(docs: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """docs with the bytes that the ids stand for."""
    return _with_columns(docs, (ids_col, out_col, _decoding(docs.sparkSession, ranks_path)))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """decode(encode(docs)) in one pass, by one Python worker a task."""
    spark = docs.sparkSession
    return _with_columns(docs, (text_col, ids_col, _encoding(spark, ranks_path, pattern)), (ids_col, out_col, _decoding(spark, ranks_path)))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, path, public_tokenizers.PATTERN).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
