"""LM scoring by deleted interpolation: bigram, unigram and uniform estimates mixed by buckets of context frequency.

Counts never meet in one place. Documents are dealt into chunks of bounded size; a chunk asks for the counts of its
distinct unigrams and bigrams in one packed array for each of a fixed number of key ranges. What up to ``GROUP`` chunks
ask of a range is added up together; where there are more chunks, the sums of each group ask on in the same way, by
finer ranges, up a tree (see ``_answers``). So messages and their sizes grow with the input alone, and a hot n-gram is one
entry per chunk. The mixture weights come from expectation-maximisation on a fold of the training documents, predicted
by the counts of all other training documents; the fold goes by the text, so copies are on one side.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallyloom.llm.common import HOT_SHARE, stored, table, text_bytes
from tallyloom.llm.hashing import mix64, packed, unpacked, word_hashes

FOLDS, HELD = 7, 2
CHUNK_BYTES = 10 << 20
MAX_ROUNDS, ENOUGH = 25, 1e-4
END = np.uint64(0x5851F42D4C957F2D)
BUCKETS = 64
#: Key ranges that a chunk asks, chunks whose questions on a range are added up at once, and ranges that a range is parted in.
RANGES, GROUP, FAN = 1024, 1024, 64
#: One in so many training texts, by their content, teaches the weights.
DEV = 8
_KIND, _TRAIN, _DEV = np.uint64(4), np.uint64(2), np.uint64(1)
_BARE = ~(_TRAIN | _DEV)


def is_held_out(doc_id: object) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD


def is_dev(text: bytes) -> bool:
    """Copies of a text are on one side of the fold; texts without words, which say nothing of words, are never in it."""
    return bool(text.strip()) and zlib.crc32(text) % DEV == 0


def tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's words (A-Z lowered, split at white space), then the end."""
    return np.append(word_hashes((text or "").encode().lower().split()), END)


def _packed_texts(src: DataFrame) -> DataFrame:
    """Texts compressed one by one, so that dealing them out moves less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data = [pack.compress((x or "").encode()) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("times"), pa.array(data, pa.binary())], names=["doc_id", "times", "data"])

    return src.mapInArrow(run, T.StructType([src.schema["doc_id"], src.schema["times"], T.StructField("data", T.BinaryType())]))


class Chunk:
    """A chunk's documents as tokens, and of each token whether it trains, whether it teaches the weights, and how often."""

    def __init__(self, group: pa.Table):
        unpack = zstandard.ZstdDecompressor()
        raw = [unpack.decompress(x) for x in group.column("data").to_pylist()]
        docs = [tokens(x.decode()) for x in raw]
        self.ids, self.doc_times = group.column("doc_id").to_pylist(), group.column("times").to_numpy()
        train = np.array([not is_held_out(i) for i in self.ids])
        self.sizes = np.array([len(d) for d in docs], np.int64)
        self.train = np.repeat(train, self.sizes)
        self.dev = np.repeat(train & np.array([is_dev(x) for x in raw]), self.sizes)
        self.times = np.repeat(self.doc_times, self.sizes)
        # A key for each token and for each token after its predecessor (at first: the end). One bit tells them apart.
        flat = np.concatenate(docs)
        previous = np.concatenate([[END], flat[:-1]])
        keep = _BARE & ~_KIND
        self.keys = np.concatenate([mix64(flat ^ np.uint64(0xA0761D6478BD642F)) & keep | _KIND, mix64(mix64(previous) * np.uint64(3) + flat) & keep])

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, and how often each stands in training documents and in those that teach the weights."""
        train, dev = np.tile(self.train, 2), np.tile(self.dev, 2)
        if (self.doc_times > 1).any():
            keys, at = np.unique(self.keys, return_inverse=True)
            times = np.tile(self.times, 2)
            return keys, *(np.bincount(at, times * x, len(keys)).astype(np.int64) for x in (train, dev))
        both = self.keys | np.where(train, _TRAIN, np.uint64(0)) | np.where(dev, _DEV, np.uint64(0))
        both.sort()
        bare = both & _BARE
        first = np.flatnonzero(np.r_[True, bare[1:] != bare[:-1]])
        return bare[first], *(np.add.reduceat((both & x > 0).astype(np.int64), first) for x in (_TRAIN, _DEV))


def range_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _questions(keys: np.ndarray, counts: list[np.ndarray], ranges: int, group: int, sender: int) -> pa.Table:
    """One row per range that the sorted keys touch."""
    at = range_of(keys, ranges)
    cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    parts = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True))
    columns = [pa.array([packed(x[a:b]) for a, b in parts], pa.binary()) for x in (keys, *counts)]
    return pa.table([pa.array(at[cuts]), *(pa.array([x] * len(cuts), pa.int64()) for x in (group, sender)), *columns], names=["range", "group", "sender", "keys", "train", "dev"])


def _merged(group: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct keys of a group of questions, where each question's keys are among them, their sums, and the questions' bounds."""
    keys = [unpacked(x, np.uint64) for x in group.column("keys").to_pylist()]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(at, np.concatenate([unpacked(x, np.int64) for x in group.column(c).to_pylist()]), len(distinct)).astype(np.int64) for c in ("train", "dev")]
    return distinct, at, sums, np.cumsum([len(k) for k in keys])[:-1]


_ASKED = "range long, group long, sender long, keys binary, train binary, dev binary"
_REPLY = "sender long, range long, train binary, dev binary, types long, n long, dev_n long"


def _reply(group: pa.Table, at: np.ndarray, sums: list[np.ndarray], bounds: np.ndarray, totals: tuple[int, int, int] | None) -> pa.Table:
    """Each sender's counts in the order of its keys; ``totals`` go along in a row whose sender is below 0."""
    here, senders = group.column("range")[0].as_py(), group.column("sender").to_pylist()
    counts = [[packed(x) for x in np.split(s[at], bounds)] for s in sums]
    more = [totals] if totals else []
    none = [0] * len(senders)
    columns = [[*senders, *(-1 - here for _ in more)], [here] * (len(senders) + len(more)), *([*c, *(b"" for _ in more)] for c in counts), *([*none, *(t[k] for t in more)] for k in range(3))]
    return pa.table([pa.array(c, pa.binary() if k in (2, 3) else pa.int64()) for k, c in enumerate(columns)], names=["sender", "range", "train", "dev", "types", "n", "dev_n"])


def _answers(asked: DataFrame, groups: int, ranges: int) -> DataFrame:
    """Replies to questions: for each sender and range the total counts of its keys.

    A (range, group) adds up what its senders ask. If there is one group that is the total; else each sum asks on, by
    ranges ``FAN`` times finer and groups as much fewer, and hands the totals down to its senders. Rows with a sender
    below 0 carry a finest range's number of distinct training tokens, of training tokens and of those that teach the
    weights.
    """

    def total(group: pa.Table) -> pa.Table:
        distinct, at, sums, bounds = _merged(group)
        unigram = distinct & _KIND > 0
        totals = (int((unigram & (sums[0] > 0)).sum()), int(sums[0][unigram].sum()), int(sums[1][unigram].sum()))
        return _reply(group, at, sums, bounds, totals)

    if groups == 1:
        return asked.groupBy("range").applyInArrow(total, _REPLY)
    fan = min(FAN, groups)

    def ask_on(group: pa.Table) -> pa.Table:
        distinct, _, sums, _ = _merged(group)
        here = group.column("group")[0].as_py()
        return _questions(distinct, sums, ranges * fan, here // fan, here)

    def hand_down(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not group.num_rows:
            return replies.select(["sender", "range", "train", "dev", "types", "n", "dev_n"])
        _, at, _, bounds = _merged(group)
        order = np.argsort(replies.column("range").to_numpy())
        sums = [np.concatenate([unpacked(replies.column(c)[int(i)].as_py(), np.int64) for i in order]) for c in ("train", "dev")]
        return _reply(group, at, sums, bounds, None)

    finer = asked.groupBy("range", "group").applyInArrow(ask_on, _ASKED)
    replies = _answers(finer, -(-groups // fan), ranges * fan).withColumn("wide", F.expr(f"range div {fan}"))
    return asked.groupBy("range", "group").cogroup(replies.groupBy(F.col("wide"), F.col("sender"))).applyInArrow(hand_down, _REPLY)


def frequency_bucket(count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + the number of binary digits after the first of the count."""
    return np.where(count > 0, 1 + np.log2(np.maximum(count, 1)).astype(np.int64), 0)


def _weighted(spark: SparkSession, src: DataFrame) -> DataFrame:
    """``src`` with ``times``: rows that share id and text and make up over a 1/1024 of the input become one row of that many."""
    src = src.withColumn("row_key", F.xxhash64("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 32
    sizes = stored(spark, src.groupBy("row_key").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).where("n > 1"), "repeated")
    total = src.agg(F.sum(size).alias("n")).first()["n"] or 0
    hot = sizes.where(F.col("bytes") * HOT_SHARE > total).select("row_key")
    plain = src.withColumn("times", F.lit(1).cast("long"))
    if hot.isEmpty():
        return plain.drop("row_key")
    once = src.join(F.broadcast(hot), "row_key", "left_semi").groupBy("row_key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("times"))
    return plain.join(F.broadcast(hot), "row_key", "left_anti").select("doc_id", "text", "times").unionByName(once.select("doc_id", "text", "times"))


def _counted(spark: SparkSession, src: DataFrame) -> DataFrame:
    """One row per chunk, packed: ids and token numbers of its documents, each token's count and bigram count, and the
    distinct cases of predicting a token that teaches the weights, with their frequency."""
    n = text_bytes(src, "text") // CHUNK_BYTES + 1
    dealt = _packed_texts(_weighted(spark, src)).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "data"), F.lit(n))).repartition(n, "chunk")
    numbers = ["sizes", "times", "single", "double", "cases"]
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(src.schema["doc_id"].dataType)), *(T.StructField(c, T.BinaryType()) for c in numbers), *(T.StructField(c, T.LongType()) for c in ("types", "n", "dev_n"))])

    def ask(group: pa.Table) -> pa.Table:
        number = group.column("chunk")[0].as_py()
        keys, *counts = Chunk(group).counts()
        return _questions(keys, counts, RANGES, number // GROUP, number)

    def count(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not group.num_rows:
            row = [[replies.column("sender")[0].as_py()], [[]], *([b""] for _ in numbers), *([sum(replies.column(c).to_pylist())] for c in ("types", "n", "dev_n"))]
        else:
            chunk = Chunk(group)
            at = np.unique(chunk.keys, return_inverse=True)[1]
            order = np.argsort(replies.column("range").to_numpy())
            train, dev = (np.concatenate([unpacked(replies.column(c)[int(i)].as_py(), np.int64) for i in order])[at] for c in ("train", "dev"))
            m = len(train) // 2
            cases = deleted_cases(chunk, train - dev)
            row = [[group.column("chunk")[0].as_py()], [chunk.ids], *([packed(x)] for x in (chunk.sizes, chunk.doc_times.astype(np.int64), train[:m], train[m:], cases.ravel())), [0], [0], [0]]
        return pa.table([pa.array(x, pa.list_(group.schema.field("doc_id").type) if f.name == "ids" else pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.int64()) for x, f in zip(row, schema.fields, strict=True)], names=schema.names)

    asked = dealt.groupBy("chunk").applyInArrow(ask, _ASKED)
    replies = _answers(asked, -(-n // GROUP), RANGES)
    return stored(spark, dealt.groupBy("chunk").cogroup(replies.groupBy("sender")).applyInArrow(count, schema), "counted")


def contexts(sizes: np.ndarray, single: np.ndarray) -> np.ndarray:
    """The count of each token's predecessor; a text's first token follows an end, and every text closes with one."""
    context = np.concatenate([[0], single[:-1]])
    context[np.cumsum(sizes) - sizes] = single[-1]
    return context


def deleted_cases(chunk: Chunk, counts: np.ndarray) -> np.ndarray:
    """Columns (context, token and bigram counts, how often) over the tokens that teach the weights.

    ``counts`` are those of all other training documents, of tokens and then of bigrams. Where the bigram occurs nowhere
    in them only the context's frequency bucket matters; its lowest count stands for it.
    """
    single, double = np.split(counts, 2)
    context = contexts(chunk.sizes, single)[chunk.dev]
    single, double, often = single[chunk.dev], double[chunk.dev], chunk.times[chunk.dev]
    bucket = frequency_bucket(context)
    context = np.where(double > 0, context, np.where(bucket > 0, np.int64(1) << np.maximum(bucket - 1, 0), 0))
    name = mix64(mix64(mix64(context.view(np.uint64)) + single.view(np.uint64)) + double.view(np.uint64))
    first, at = np.unique(name, return_index=True, return_inverse=True)[1:]
    return np.stack([context[first], single[first], double[first], np.bincount(at, often, len(first)).astype(np.int64)])


def mixture_weights(counted: DataFrame, n: int, dev_n: int, types: int) -> np.ndarray:
    """Weights (bigram, unigram, uniform) by frequency bucket of the context, from the tokens of the fold that teaches them.

    ``n`` counts the training tokens outside the fold. Without any, or without a fold, unigram and uniform share equally.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    uniform = 1 / (types + 1)
    if not n or not dev_n:
        return np.tile([0.0, 0.5, 0.5] if n + dev_n else [0.0, 0.0, 1.0], (BUCKETS, 1))

    def expectation(now: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for data in (x for batch in batches for x in batch.column("cases").to_pylist()):
                if not len(data):
                    continue
                context, single, double, times = unpacked(data, np.int64).reshape(4, -1)
                bucket = frequency_bucket(context)
                share = now[bucket] * np.stack([double / np.maximum(context, 1), single / n, np.full(len(single), uniform)], axis=1)
                total = share.sum(axis=1)
                share *= (times / total)[:, None]
                sums = [np.bincount(bucket, share[:, i], BUCKETS) for i in range(3)]
                gain = np.bincount(bucket, np.log(total) * times, BUCKETS)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), *(pa.array(x.astype(np.float64)) for x in (*sums, gain))], names=["bucket", "g2", "g1", "g0", "gain"])

        return run

    before = -np.inf
    for _ in range(MAX_ROUNDS):
        sums = counted.select("cases").mapInArrow(expectation(weights), "bucket long, g2 double, g1 double, g0 double, gain double").groupBy("bucket").agg(*(F.sum(x).alias(x) for x in ("g2", "g1", "g0", "gain"))).collect()
        gathered = np.zeros((BUCKETS, 3))
        for r in sums:
            gathered[r["bucket"]] = r["g2"], r["g1"], r["g0"]
        mass = gathered.sum(axis=1)
        weights = np.where(mass[:, None] > 0, gathered / np.maximum(mass, 1e-300)[:, None], np.nan)
        seen = np.flatnonzero(mass > 0)
        # Buckets without training contexts take the weights of the nearest lower one that has some.
        fill = seen[np.maximum(np.searchsorted(seen, np.arange(BUCKETS), side="right") - 1, 0)]
        weights = weights[fill]
        if fill[0] != 0:
            weights[: seen[0]] = [0.0, 0.5, 0.5]
        gain = sum(r["gain"] for r in sums) / mass.sum()
        if gain - before < ENOUGH:
            break
        before = gain
    return weights


def score_documents(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32 of the id as text leaves 2 modulo 7 are held out; all others train (a null id counts as an
    empty text). A null or empty text is the end token alone. base_score uses add-one unigrams, score the interpolated
    model: log10 probability of the whole text, its end included. Repeated rows count each time and get a row each; an
    empty table gives no rows; other columns are not read.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = _counted(spark, src)
    totals = counted.agg(*(F.sum(c).alias(c) for c in ("n", "types", "dev_n"))).first()
    n, types, dev_n = (int(totals[c] or 0) for c in ("n", "types", "dev_n"))
    weights = mixture_weights(counted.where("chunk >= 0"), n - dev_n, dev_n, types)
    schema = T.StructType([src.schema["doc_id"], T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("times", T.LongType())])
    id_type = to_arrow_type(src.schema["doc_id"].dataType)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (x for batch in batches for x in batch.to_pylist()):
            ids, (sizes, times, single, double) = row["ids"], (unpacked(row[x], np.int64) for x in ("sizes", "times", "single", "double"))
            context, starts = contexts(sizes, single), np.cumsum(sizes) - sizes
            base = np.log10((single + 1) / (n + types + 1))
            w = weights[frequency_bucket(context)]
            mixed = w[:, 0] * double / np.maximum(context, 1) + w[:, 1] * single / max(n, 1) + w[:, 2] / (types + 1)
            sums = [np.add.reduceat(x, starts) for x in (np.ones(len(single), np.int64), (single > 0).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array([is_held_out(i) for i in ids]), *(pa.array(x) for x in sums), pa.array(np.full(len(ids), n, np.int64)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(np.log10(mixed), starts)), pa.array(times)], names=schema.names)

    scored = counted.where("chunk >= 0").select("ids", "sizes", "times", "single", "double").mapInArrow(score, schema)
    return scored.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("nth", "times")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark, table(spark, sf_dir, "documents"))
