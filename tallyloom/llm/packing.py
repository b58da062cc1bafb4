"""Best-fit packing by exact-complement hashing over the histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import pretokens
from tallyloom.llm.common import by_bytes, stored, table, texts

SLICE_BYTES = 4 << 20
#: Words whose ids a task keeps; they go with the task.
CACHE_WORDS = 400_000
SHARD_ROWS = 4096


class WordIds:
    """Token ids of pre-tokens as the tokenizer library gives them, kept in one flat pool."""

    def __init__(self, path: str):
        self.path = path
        self.index: dict[str, int] = {}
        self.pool = np.zeros(0, np.uint32)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, words: list[str]) -> None:
        if len(self.index) > CACHE_WORDS:
            self.__init__(self.path)
        words = [w for w in words if w not in self.index]
        if not words:
            return
        tok = pretokens.library(self.path)
        ids, sizes = [], []
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            got = tok.encode(" ".join(part), add_special_tokens=False)
            size = np.bincount(np.array(got.word_ids, np.int64), minlength=len(part))
            if len(size) != len(part):  # a word that the library splits when it stands beside others
                each = [tok.encode(w, add_special_tokens=False).ids for w in part]
                ids.append(np.array([x for e in each for x in e], np.uint32))
                size = np.array([len(e) for e in each])
            else:
                ids.append(np.array(got.ids, np.uint32))
            sizes.append(size)
        size = np.concatenate(sizes).astype(np.int64)
        self.index.update(zip(words, range(len(self.start), len(self.start) + len(words)), strict=True))
        self.start = np.r_[self.start, len(self.pool) + np.cumsum(size) - size]
        self.size = np.r_[self.size, size]
        self.pool = np.concatenate([self.pool, *ids])

    def ids(self, words: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.start[at] - ends + size, size) + np.arange(total)]


def token_ids(docs: list[str], path: str, pool: WordIds | None = None) -> list[np.ndarray]:
    """Ids of each whole text, without added special tokens, as the library gives them; ``pool`` keeps those of words."""
    pool, tok = pool or WordIds(path), pretokens.library(path)
    special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
    # Texts with special strings are rare: the library takes them whole.
    split = [None if "<|" in x and any(s in x for s in special) else pretokens.words(x, path) for x in docs]
    fresh: set[str] = set()
    for found in split:
        fresh.update(found or ())
    pool.add(sorted(fresh))
    return [np.array(tok.encode(x, add_special_tokens=False).ids, np.uint32) if found is None else pool.ids(found) for x, found in zip(docs, split, strict=True)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Token pieces of at most ``capacity``: doc_id, piece, start, length, ids_crc32."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = WordIds(tokenizer)
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(token_ids(texts(batch), tokenizer, pool)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    row.append(i), piece.append(k), start.append(at), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
            doc = batch.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([doc, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=schema.names)

    return src.mapInArrow(run, schema)


class ComplementIndex:
    """Finds one, two or three available lengths that sum to a gap, under the counts still available.

    ``pair`` maps a sum to the pair last found for it. Counts only fall, so a sum without a pair never gets one again
    and drops out of ``has_pair``; a triple is a length whose complement is still a pair sum.
    """

    def __init__(self, count: np.ndarray):
        self.count = count
        there = (count > 0).astype(np.float64)
        size = 1 << int(np.ceil(np.log2(2 * len(count))))
        sums = np.fft.irfft(np.fft.rfft(there, size) ** 2, size)[: len(count)]
        self.has_pair = sums > 0.5
        self.pair: dict[int, tuple[int, int]] = {}

    def fits(self, lengths: tuple[int, ...]) -> int:
        """How often the lengths can be taken together."""
        return min(int(self.count[x]) // lengths.count(x) for x in set(lengths))

    def find_pair(self, total: int) -> tuple[int, int] | None:
        held = self.pair.get(total)
        if held and self.fits(held):
            return held
        if total < 2 or not self.has_pair[total]:
            return None
        low = np.arange(1, total // 2 + 1)
        often = np.minimum(self.count[low], self.count[total - low])
        if total % 2 == 0:
            often[-1] = self.count[total // 2] // 2
        best = int(np.argmax(often))
        if often[best] <= 0:
            self.has_pair[total] = False
            return None
        self.pair[total] = (int(low[best]), int(total - low[best]))
        return self.pair[total]

    def find(self, first: int, gap: int) -> tuple[int, ...] | None:
        """Lengths that fill ``gap`` exactly beside one of ``first``."""
        if self.count[gap] and self.fits((first, gap)):
            return (gap,)
        pair = self.find_pair(gap)
        if pair and self.fits((first, *pair)):
            return pair
        third = np.arange(1, gap - 1)
        for x in third[(self.count[third] > 0) & self.has_pair[gap - third]][::-1].tolist():
            pair = self.find_pair(gap - x)
            if pair and self.fits((first, x, *pair)):
                return (x, *pair)
        return None


def plan(lengths: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (how many sequences, [(length, times)]) that use up every piece.

    Every pattern is taken as often as the counts allow, which leaves some length short of a further one; so there are
    a few patterns per length, whatever the number of pieces.
    """
    count = np.zeros(capacity + 1, np.int64)
    for length, n in lengths.items():
        count[length] = n
    out: list[tuple[int, list[tuple[int, int]]]] = []

    def take(parts: tuple[int, ...], times: int) -> None:
        used = {x: parts.count(x) for x in sorted(set(parts), reverse=True)}
        for x, n in used.items():
            count[x] -= n * times
        out.append((times, list(used.items())))

    if count[capacity]:
        take((capacity,), int(count[capacity]))
    index = ComplementIndex(count)
    for length in range(capacity - 1, 0, -1):
        while count[length] and (rest := index.find(length, capacity - length)):
            take((length, *rest), index.fits((length, *rest)))
    for length in range(capacity - 1, 0, -1):
        while count[length]:
            parts, gap = {length: 1}, capacity - length
            while gap:
                there = np.flatnonzero(count[: gap + 1] > 0)
                there = there[[parts.get(int(x), 0) < count[x] for x in there]] if len(there) else there
                if not len(there):
                    break
                best = int(there[-1])
                n = min(gap // best, int(count[best]) - parts.get(best, 0))
                parts[best] = parts.get(best, 0) + n
                gap -= n * best
            times = min(int(count[x]) // n for x, n in parts.items())
            for x, n in parts.items():
                count[x] -= n * times
            out.append((times, sorted(parts.items(), reverse=True)))
    return out


def _slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, times, first sequence, offset), sorted: which ranks of a length go where."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for many, parts in patterns:
        offset = 0
        for length, times in parts:
            rows.append((length, used.get(length, 0), times, sequence, offset))
            used[length] = used.get(length, 0) + many * times
            offset += length * times
        sequence += many
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only the histogram of lengths (at most ``capacity`` counts) and the patterns made from it reach the driver; pieces
    take their place by their rank among those of equal length, in the order in which they were written. A null or empty
    text is one piece, the end id alone. Repeated rows are packed each by itself. An empty table gives no rows. Other
    columns are not read.
    """
    made = pieces(docs, tokenizer, capacity, end_id, id_col, text_col)
    # A number for each piece as it is written parts even equal rows evenly.
    held = stored(spark, made.withColumn("row", F.monotonically_increasing_id()), "pieces")
    lengths = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(plan(lengths, capacity))
    shards = max(1, -(-sum(lengths.values()) // SHARD_ROWS))
    # Hot lengths are ranked in shards; a shard starts after all rows of the shards before it.
    ranked = held.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    before = ranked.groupBy("length", "shard").agg(F.count("*").alias("n")).select("length", "shard", (F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("length", "shard").orderBy("row")).cast("long") - 1)
    ranked = ranked.join(before, ["length", "shard"]).withColumn("rank", F.col("rank") + F.col("before")).select(*made.columns, "rank")
    schema = T.StructType([*made.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    keys = slots[:, 0] << 44 | slots[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            slot = slots[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            nth = rank - slot[:, 1]
            sequence, offset = slot[:, 3] + nth // slot[:, 2], slot[:, 4] + nth % slot[:, 2] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(place, schema)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
