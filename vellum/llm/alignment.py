"""Alignment of two tokenizers' tokens over the same bytes.

Each text is encoded twice. The tokens of both sides are the nodes of a bipartite graph; a token of A and one of B that
overlap in the text's bytes are joined by an edge. Union-find over the edges gives components, and those are just the least groups
of tokens of A and of B that cover the same bytes. A group's members are then expanded into links (pairs of a token of A and one
of B that end together), links of equal ids are counted over all documents, and each document is told how common its links are.

Texts are encoded and aligned within tasks, many at a time in arrays. Links of a document are folded by their ids before they
leave the task; pairs are counted by a shuffle that adds up within tasks first; the counts come back by a broadcast where they are
small, else the hottest (a bounded number) by broadcast and the rest by a shuffle. Whole corpora of links never meet in one place.

Side A is a byte-level BPE (a tokenizer file of its vocabulary and merges, encoded by its ranks), side B a piece model with
bytes as a last resort that puts a space in front; both read a space and the text. Defined results: a text that is null or empty,
or that either side doesn't give back byte for byte, has no tokens; rows are counted alone, repeated ones and those without an id
too; an empty table gives an empty result; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, join_counted, shared_dir, table, written

#: Characters of texts aligned together.
CHARS = 1 << 20

ALIGNED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    *[T.StructField(x, T.LongType()) for x in ("n_a", "n_b", "n_groups", "n_links")],
    T.StructField("groups", T.StringType()),
    T.StructField("pairs", T.ArrayType(T.LongType(), False)),
    T.StructField("times", T.ArrayType(T.LongType(), False)),
])


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printing ones for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class SideA:
    """Byte-level BPE of a tokenizer file, whose ids are its ranks."""

    def __init__(self, data: bytes, pattern: str):
        import tiktoken

        chars = byte_of_char()
        model = json.loads(data)["model"]
        ranks = {bytes(chars[c] for c in entry): i for entry, i in model["vocab"].items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        made = [model["vocab"][a + b] for a, b in pairs]
        if made != sorted(made):
            raise ValueError("side A's ids don't follow the order of its merges")
        self.bytes = np.full(max(ranks.values()) + 1, b"", object)
        self.bytes[list(ranks.values())] = list(ranks)
        self._encoding = tiktoken.Encoding("side-a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self._encoding.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64) for t in texts]


class SideB:
    """A piece model; it puts the space in front itself."""

    def __init__(self, data: bytes):
        import sentencepiece

        self._model = m = sentencepiece.SentencePieceProcessor(model_proto=data)
        as_bytes = lambda i: bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
        self.bytes = np.array([as_bytes(i) for i in range(m.get_piece_size())], object)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self._model.encode(texts, num_threads=1)]


def union_find(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of the component of each of n nodes, by edges (u, v): roots are hooked to lesser roots, then paths halved."""
    root = np.arange(n)
    while len(u):
        ru, rv = root[u], root[v]
        apart = ru != rv
        u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


class Aligned:
    """Groups and links of texts laid one after the other: a, b: ids of all tokens; end_a, end_b: where they end."""

    def __init__(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray):
        n = len(a)
        cuts = np.union1d(end_a, end_b)  # between two cuts just one token of each side stands
        over_a, over_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
        root = union_find(over_a, over_b + n, n + len(b))
        first = np.flatnonzero(root[:n] == np.arange(n))  # a component's least node is its first token of A
        self.group_a, self.group_b = np.searchsorted(first, root[:n]), np.searchsorted(first, root[n:])
        self.n_groups = len(first)
        self.first = first
        # members of a component that end together; ends ascend, so each is looked for once
        at = np.searchsorted(end_b, end_a)
        meet = end_b[np.minimum(at, len(end_b) - 1)] == end_a
        meet &= self.group_a == self.group_b[np.minimum(at, len(end_b) - 1)]
        self.link_a, self.link_b = np.flatnonzero(meet), at[meet]

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each token of A and of B stands if groups follow one another, A's tokens before B's in each."""
        count_a, count_b = np.bincount(self.group_a, minlength=self.n_groups), np.bincount(self.group_b, minlength=self.n_groups)
        before_b, through_a = np.cumsum(count_b) - count_b, np.cumsum(count_a)
        return np.arange(len(self.group_a)) + before_b[self.group_a], np.arange(len(self.group_b)) + through_a[self.group_b]


class Aligner:
    def __init__(self, side_a: SideA, side_b: SideB):
        self.a, self.b = side_a, side_b
        self.len_a, self.len_b = (np.fromiter(map(len, s.bytes), np.int64, len(s.bytes)) for s in (side_a, side_b))
        na, nb = len(self.len_a), len(self.len_b)
        told = [f"{i}{s}" for n, ends in ((na, ",|"), (nb, ",;")) for s in ends for i in range(n)]
        self.told = np.array(told, object)  # each id with what follows it inside a group, and at its side's end

    def __call__(self, ids: list, texts: list[str | None]) -> pa.RecordBatch:
        rows = len(texts)
        given = [i for i, t in enumerate(texts) if t]
        some = [texts[i] for i in given]
        kept, in_a, in_b = [], [], []
        for i, t, x, y in zip(given, some, self.a.encode(some), self.b.encode(some), strict=True):
            raw = b" " + t.encode()
            if b"".join(self.a.bytes[x].tolist()) == raw == b"".join(self.b.bytes[y].tolist()):
                kept.append(i), in_a.append(x), in_b.append(y)
        counts = np.zeros((4, rows), np.int64)
        groups, sizes = [""] * rows, np.zeros(rows, np.int64)
        pairs = times = np.empty(0, np.int64)
        if kept:
            counts[0, kept], counts[1, kept] = list(map(len, in_a)), list(map(len, in_b))
            a, b = np.concatenate(in_a), np.concatenate(in_b)
            found = Aligned(a, b, np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b]))
            row_of_a = np.repeat(np.arange(rows), counts[0])
            counts[2], counts[3] = np.bincount(row_of_a[found.first], minlength=rows), np.bincount(row_of_a[found.link_a], minlength=rows)
            # links of one row and equal ids are folded
            ids_of_row = np.int64(len(self.len_a)) * len(self.len_b)
            linked = row_of_a[found.link_a] * ids_of_row + a[found.link_a] * len(self.len_b) + b[found.link_b]
            linked, times = np.unique(linked, return_counts=True)
            sizes, pairs = np.bincount(linked // ids_of_row, minlength=rows), linked % ids_of_row
            # what each token adds to its row's list of groups
            na, nb = len(self.len_a), len(self.len_b)
            last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (found.group_a, found.group_b))
            place_a, place_b = found.places()
            token = np.empty(len(a) + len(b), np.int64)
            token[place_a], token[place_b] = a + na * last_a, 2 * na + b + nb * last_b
            ends = np.cumsum(counts[0] + counts[1])
            for i in kept:
                groups[i] = "".join(self.told[token[ends[i] - counts[0, i] - counts[1, i] : ends[i]]].tolist())[:-1]
        starts = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        lists = [pa.ListArray.from_arrays(starts, pa.array(x, pa.int64())) for x in (pairs, times)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, counts), pa.array(groups, pa.string()), *lists], names=ALIGNED.names)


_ALIGNERS: dict[str, Aligner] = {}


def aligned(docs: DataFrame, a_path: str, a_pattern: str, b_path: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times.

    groups: ids of each group, as `a1,a2|b1;a3|b2,b3`, or with digest the SHA-256 of that in hex (empty without tokens); pairs: the
    different links, as id of A times size of B's vocabulary plus id of B; times: how often each stands in the text. The two
    vocabulary files are read once by the driver and sent along.
    """
    with open(a_path, "rb") as f, open(b_path, "rb") as g:
        a_data, b_data = f.read(), g.read()
    sent = docs.sparkSession.sparkContext.broadcast((a_data, b_data))
    key = hashlib.sha256(a_data + b_data + a_pattern.encode()).hexdigest()

    def run(batches):
        if key not in _ALIGNERS:
            _ALIGNERS.clear()
            _ALIGNERS[key] = Aligner(SideA(sent.value[0], a_pattern), SideB(sent.value[1]))

        def made(ids, texts):
            out = _ALIGNERS[key](ids, texts)
            if digest:
                hashed = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in out.column("groups").to_pylist()]
                out = out.set_column(5, "groups", pa.array(hashed, pa.string()))
            return out

        for batch in batches:
            ids, texts, chars = [], [], 0
            for id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(id), texts.append(text.as_py())
                chars += len(texts[-1] or "")
                if chars >= CHARS:
                    yield made(ids, texts)
                    ids, texts, chars = [], [], 0
            if ids:
                yield made(ids, texts)
        give_back()

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(run, ALIGNED)


def pair_counts(links: DataFrame, b_size: int, folder: str) -> DataFrame:
    """(pair, n, best) over links (pair, k): how often each pair of ids is linked, and whether that is the most for its id of B."""
    counted = written(links.groupBy("pair").agg(F.sum("k").alias("n")), f"{folder}/counted")
    most = counted.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("n").alias("most"))
    judged = counted.withColumn("b", F.col("pair") % b_size).join(most, "b")
    return written(judged.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), f"{folder}/judged")


def alignment(docs: DataFrame, a_path: str, a_pattern: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best: links whose pair is its id of B's most common; count_sum: how common each link is, summed up.
    """
    import sentencepiece

    folder = shared_dir(docs.sparkSession, "alignment")
    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    made = aligned(docs, a_path, a_pattern, b_path, True, id_col, text_col).withColumn("at", F.monotonically_increasing_id())
    made = written(made, f"{folder}/aligned")
    told = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")
    links = made.select("at", *told, F.inline(F.arrays_zip("pairs", "times"))).select("at", *told, F.col("pairs").alias("pair"), F.col("times").alias("k"))
    judged = pair_counts(links.select("pair", "k"), b_size, folder)
    total = made.agg(F.sum("n_links")).first()[0] or 0
    common = join_counted(links, judged, ["pair"], "n", total)
    summed = common.groupBy("at").agg(
        *[F.first(x).alias(x) for x in told], F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum")
    )
    none = made.where("n_links = 0").select(*told, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    out = summed.select(*told, "n_best", "count_sum").unionByName(none)
    return out.select(*told[:-1], "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment(table(spark, sf_dir, "documents"), paths[0], public_tokenizers.PATTERN, paths[1])
