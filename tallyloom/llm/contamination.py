"""Benchmark decontamination: an FM-index per training shard, searched backwards for test phrases.

A shard's text is a sequence of word symbols. Words that no phrase contains cannot be part of an occurrence, so they
and document ends become separators, each unlike any other. Suffixes are sorted by prefix doubling; the
Burrows-Wheeler transform is kept as a wavelet matrix of bit vectors with block ranks, every 16th suffix position and
the start of each run are sampled, and occurrences are located by stepping backwards to a sample.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import discard, gathered, stored, table, unused

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
SHARD_BYTES = 8 << 20
#: Text of a block of benchmark items, all that the driver and a task hold of the benchmark at once; its index takes about 30 x.
BLOCK_BYTES = 4 << 20
STEP = 16


class Bits:
    """A bit vector with the number of set bits before each position."""

    def __init__(self, bits: np.ndarray):
        self.words = np.frombuffer(np.packbits(np.append(bits, np.zeros(-len(bits) % 64 + 64, bool)), bitorder="little").tobytes(), "<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)][:-1]

    def rank(self, at: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Rank and access over a symbol sequence, one bit vector for each bit of a symbol from the highest."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for shift in range(self.depth - 1, -1, -1):
            bit = (symbols >> shift & 1).astype(bool)
            self.levels.append((Bits(bit), int((~bit).sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.n = len(symbols)
        every = np.arange(n_symbols)
        self.first = self._down(every, np.zeros(n_symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(self.levels):
            ones = bits.rank(at)
            at = np.where(symbol >> (self.depth - 1 - level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._down(symbol, at) - self.first[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its occurrences before it."""
        symbol = np.zeros(len(at), np.int64)
        for bits, zeros in self.levels:
            bit, ones = bits.get(at).astype(np.int64), bits.rank(at)
            symbol = symbol << 1 | bit
            at = np.where(bit, zeros + ones, at - ones)
        return symbol, at - self.first[symbol]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; symbol 0 is a separator, lower than any other and ordered by position."""
    n = len(symbols)
    separator = symbols == 0
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + int(separator.sum())
    rank[separator] = np.arange(int(separator.sum()))
    width = 1
    while True:
        next_rank = np.zeros(n, np.int64)
        next_rank[:-width] = rank[width:] + 1
        key = rank * np.int64(n + int(separator.sum()) + 2) + next_rank
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank[order] = new
        width *= 2
        if new[-1] == n - 1 or width >= n:
            return order


class FmIndex:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        order = suffix_array(symbols)
        transform = symbols[order - 1]
        self.matrix = WaveletMatrix(transform, n_symbols)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols))])
        # A run's first symbol is sampled too, so that no backward step crosses a separator.
        sampled = (order % STEP == 0) | (symbols[order - 1] == 0)
        self.sampled, self.positions = Bits(sampled), order[sampled]

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases: rows of symbols, right-aligned."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.matrix.n, np.int64)
        width = phrases.shape[1]
        live = np.arange(len(phrases))
        for step in range(width):
            live = live[(high[live] > low[live]) & (length[live] > step)]
            if not len(live):
                break
            symbol = phrases[live, width - 1 - step]
            low[live] = self.starts[symbol] + self.matrix.rank(symbol, low[live])
            high[live] = self.starts[symbol] + self.matrix.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, at = np.arange(len(rows)), rows.copy()
        while len(live):
            done = self.sampled.get(at).astype(bool)
            out[live[done]] = self.positions[self.sampled.rank(at[done])] + steps[live[done]]
            live, at = live[~done], at[~done]
            if len(live):
                symbol, before = self.matrix.access(at)
                at = self.starts[symbol] + before
                steps[live] += 1
        return out


class Phrases:
    """Windows of one block of benchmark items: a vocabulary, distinct windows, and the items of each window."""

    def __init__(self, rows: list[tuple[str, str]], window: int):
        self.vocab: dict[bytes, int] = {}
        ids: dict[str, int] = {}
        tables, owners, lengths = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for item, text in rows:
            symbols = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in WORD.findall(text.encode().lower())], np.int32)
            if not len(symbols):
                continue
            size = min(window, len(symbols))
            part = np.zeros((len(symbols) - size + 1, window), np.int32)
            part[:, window - size :] = np.lib.stride_tricks.sliding_window_view(symbols, size)
            tables.append(part), owners.append(np.full(len(part), ids.setdefault(item, len(ids)))), lengths.append(np.full(len(part), size))
        self.items = list(ids)
        # Rows of symbols as single values, so that equal windows are found by sorting.
        whole = np.ascontiguousarray(np.concatenate(tables))
        first, at = np.unique(whole.view(np.dtype((np.void, 4 * window))).ravel(), return_index=True, return_inverse=True)[1:]
        self.table, self.length = whole[first].astype(np.int64), np.concatenate(lengths)[first]
        pair = np.unique(np.stack([at.ravel(), np.concatenate(owners)]), axis=1)
        self.item_of, self.item_start = pair[1], np.searchsorted(pair[0], np.arange(len(first) + 1))
        self.shortest = int(self.length.min()) if len(first) else 1


_LAST: dict[str, Phrases] = {}


def phrases_of(name: str, rows: list[tuple[str, str]], window: int) -> Phrases:
    """The windows of a block; a worker keeps those of the last block it met."""
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Phrases(rows, window)
    return _LAST[name]


def search_shard(docs: list[bytes], phrases: Phrases) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For each text: words, an array of hit word spans (start, end) merged, and an array of item numbers."""
    get, zero = phrases.vocab.get, np.int32(0)
    parts, n_words = [], np.zeros(len(docs), np.int64)
    for i, text in enumerate(docs):
        found = WORD.findall(text.lower())
        n_words[i] = len(found)
        parts.append(np.fromiter((get(w, 0) for w in found), np.int32, len(found)))
        parts.append(np.array([zero]))
    none = np.zeros((0, 2), np.int64)
    spans, items = [none] * len(docs), [none[:, 0]] * len(docs)
    if not docs or not len(phrases.length):
        return n_words, spans, items
    symbols = np.concatenate(parts).astype(np.int64)
    first = np.cumsum(n_words + 1) - n_words - 1
    # Runs of phrase words between separators; those shorter than the shortest window hold no occurrence.
    inside = np.r_[False, symbols > 0, False]
    edges = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
    edges = edges[edges[:, 1] - edges[:, 0] >= phrases.shortest]
    if not len(edges):
        return n_words, spans, items
    size = edges[:, 1] - edges[:, 0] + 1  # with one separator after the run
    place = np.repeat(edges[:, 0] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    place = np.concatenate([[-1], place])
    text = np.concatenate([[0], symbols[np.minimum(place[1:], len(symbols) - 1)]])
    index = FmIndex(text, len(phrases.vocab) + 1)
    low, high = index.search(phrases.table, phrases.length)
    many = high - low
    window = np.repeat(np.arange(len(many)), many)
    if not len(window):
        return n_words, spans, items
    rows = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(window))
    at = place[index.locate(rows)]
    cover = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + phrases.length[window], -1)
    hit = np.r_[False, np.cumsum(cover)[:-1] > 0, False]
    merged = np.flatnonzero(hit[1:] != hit[:-1]).reshape(-1, 2)
    owner = np.searchsorted(first, merged[:, 0], side="right") - 1
    cuts = np.flatnonzero(np.diff(owner)) + 1
    for i, part in zip(owner[np.r_[0, cuts]].tolist(), np.split(merged, cuts), strict=True):
        spans[i] = part - first[i]
    pair = np.unique(np.stack([np.searchsorted(first, at, side="right") - 1, window]), axis=1)
    cuts = np.flatnonzero(np.diff(pair[0])) + 1
    for i, windows in zip(pair[0][np.r_[0, cuts]].tolist(), np.split(pair[1], cuts), strict=True):
        items[i] = np.unique(np.concatenate([phrases.item_of[phrases.item_start[w] : phrases.item_start[w + 1]] for w in windows.tolist()]))
    return n_words, spans, items


class Blocks:
    """The benchmark's distinct items in blocks, dealt by their hash and written as a table; one block at a time is read."""

    def __init__(self, spark: SparkSession, benchmark: DataFrame, item_col: str, text_col: str):
        items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
        items = stored(spark, items, "items")
        self.n = (items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // BLOCK_BYTES + 1
        self.dealt = stored(spark, items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(self.n))), "blocks")
        self.name = uuid.uuid4().hex
        discard(spark, items)

    def read(self, k: int) -> tuple[str, list[tuple[str, str]]]:
        return f"{self.name}-{k}", [(r["item"], r["text"]) for r in self.dealt.where(F.col("block") == k).select("item", "text").collect()]


def find_contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, spans (word ranges hit, merged), item_ids (sorted as strings).

    Null and empty texts have no words. Items with a null id or no words are passed over; an item of fewer words than
    the window is one window. Repeated document rows give a row each; rows that share an item id are one item. Empty
    tables give no rows, or rows without hits. Other columns are not read. Rows are written once with a number; every
    block of items is searched for in all of them, and only hits are shuffled, by that number.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = stored(spark, src.withColumn("row", F.monotonically_increasing_id()), "texts")

    def searcher(name: str, rows: list[tuple[str, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = phrases_of(name, rows, window)
            for shard in gathered(batches, "text", SHARD_BYTES):
                _, spans, items = search_shard([x.encode() for x in shard.column("text").to_pylist()], phrases)
                hit = [i for i, x in enumerate(spans) if len(x)]
                ids = [[phrases.items[k] for k in items[i].tolist()] for i in hit]
                yield pa.RecordBatch.from_arrays([shard.column("row").combine_chunks().take(pa.array(hit, pa.int64())), pa.array([spans[i].tolist() for i in hit], pa.list_(pa.list_(pa.int32()))), pa.array(ids, pa.list_(pa.string()))], names=["row", "spans", "items"])

        return run

    texts = held.where("text is not null").select("row", "text")
    blocks, found = Blocks(spark, benchmark, item_col, item_text_col), None
    for k in range(blocks.n):
        part = stored(spark, texts.mapInArrow(searcher(*blocks.read(k)), "row long, spans array<array<int>>, items array<string>"), "hits")
        found = part if found is None else found.unionByName(part)
    # Spans that touch are one: a span opens where all before it, by their starts, end further left.
    each = found.select("row", F.explode("spans").alias("span")).select("row", F.col("span")[0].alias("start"), F.col("span")[1].alias("end"))
    order = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = each.withColumn("opens", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).withColumn("nth", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = opened.groupBy("row", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy("row").agg(F.array_sort(F.collect_list(F.array("start", "end"))).alias("spans"))
    items = found.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("item_ids"))
    words = F.coalesce(F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")), F.lit(0)).cast("long")
    out = held.select("doc_id", "row", words.alias("n_words")).join(merged, "row", "left").join(items, "row", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return out.select("doc_id", "n_words", empty("spans", "array<array<int>>"), empty("item_ids", "array<string>"))


def strip_spans(text: str, phrases: Phrases) -> str:
    """The text without the spans that phrases hit, again until none is left; a span goes from its first to its last word."""
    while True:
        raw = text.encode()
        spans = search_shard([raw], phrases)[1][0]
        if not len(spans):
            return text
        words = [m.span() for m in WORD.finditer(raw.lower())]
        out, at = [], 0
        for start, end in spans.tolist():
            out.append(raw[at : words[start][0]])
            at = words[end - 1][1]
        text = b"".join([*out, raw[at:]]).decode()


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with the same rows and columns, benchmark passages cut out of ``text_col``; other texts stay as they are.

    Null texts stay null; repeated rows are cut alike; empty tables give no rows, or texts as they are; columns may have
    any names. Every block of items makes a pass over the texts. A cut can bring words together that are a passage of
    another block, so passes go on, over the texts cut since that block's last pass, until every block has seen every
    text as it stays; no passage of any block is left.
    """
    at, touched = docs.columns.index(text_col), unused(docs, "touched")[0]
    blocks = Blocks(spark, benchmark, item_col, item_text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(touched, T.LongType())])

    def clean(name: str, rows: list[tuple[str, str]], nth: int, since: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = phrases_of(name, rows, window)
            for shard in gathered(batches, text_col, SHARD_BYTES):
                old, marks = shard.column(at).to_pylist(), shard.column(len(schema) - 1).to_pylist()
                due = [i for i, (x, m) in enumerate(zip(old, marks, strict=True)) if x and m >= since]
                spans = search_shard([old[i].encode() for i in due], phrases)[1]
                for i, found in zip(due, spans, strict=True):
                    if len(found):
                        old[i], marks[i] = strip_spans(old[i], phrases), nth
                shard = shard.set_column(at, shard.field(at), pa.array(old, shard.field(at).type)).set_column(len(schema) - 1, touched, pa.array(marks, pa.int64()))
                yield from shard.combine_chunks().to_batches()

        return run

    now = docs.withColumn(touched, F.lit(0).cast("long"))
    quiet, nth, before = 0, 0, None
    while True:
        # Pass ``nth`` (from 1 on) looks at what was cut from this block's last pass on; the first round looks at all.
        nth += 1
        made = now.mapInArrow(clean(*blocks.read((nth - 1) % blocks.n), nth, 0 if nth <= blocks.n else nth - blocks.n + 1), schema)
        if blocks.n == 1:
            return made.drop(touched)
        made = stored(spark, made, "pass")
        if before is not None:
            discard(spark, before)
        now = before = made
        quiet = quiet + 1 if made.where(F.col(touched) == nth).isEmpty() else 0
        if nth >= blocks.n and quiet >= blocks.n - 1:
            return now.drop(touched)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
