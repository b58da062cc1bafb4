"""Token counts by rank-synchronous merging of batched pre-tokens held as ragged numpy arrays."""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import pretokens
from tallyloom.llm.common import by_bytes, table, texts

SLICE_BYTES = 4 << 20
CACHE_WORDS = 100_000
#: Words from this many bytes on keep their pairs by rank, so that a round costs what it merges and not their length.
LONG_WORD = 1024


class RankMerger:
    """Counts BPE symbols of many words at once.

    All words' symbols stand in one flat array. In a round each unfinished word finds its lowest-ranked adjacent pair
    and merges every occurrence of it, left to right, at the same time as all other words. Every merge of the
    vocabulary makes a symbol of its own, so a later pair never outranks the one that made its parts, and the rounds
    reach what merging one occurrence at a time would.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        plain, final = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for char, byte in pretokens.BYTE_OF.items():
            plain[byte], final[byte] = vocab[char], vocab[char + suffix]
        self.plain, self.final = plain, final
        self.base = np.int64(max(vocab.values()) + 1)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        if len(np.unique(made)) != len(made):
            raise ValueError("two merges make one symbol: rounds could differ from single merges")
        keys = left * self.base + right
        self.order = np.argsort(keys)
        self.keys, self.made, self.none = keys[self.order], made, np.int64(len(merges))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], self.none)

    def long_count(self, raw: bytes) -> int:
        """Symbols of one long word: the positions of its pairs are kept by rank, the lowest rank is merged everywhere at once."""
        n = len(raw)
        flat = np.frombuffer(raw, np.uint8)
        symbol = self.plain[flat]
        symbol[-1] = self.final[flat[-1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # n and -1: no neighbour
        rank = np.append(self._ranks(symbol[:-1], symbol[1:]), self.none)
        held: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        count = n

        def keep(at: np.ndarray) -> None:
            at = at[rank[at] < self.none]
            at = at[np.argsort(rank[at], kind="stable")]
            for part in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1) if len(at) else ():
                r = int(rank[part[0]])
                if r not in held:
                    held[r] = []
                    heapq.heappush(heap, r)
                held[r].append(part)

        keep(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            hit = np.unique(np.concatenate(held.pop(r)))
            hit = hit[rank[hit] == r]
            if not len(hit):
                continue
            # In a run of overlapping occurrences (a a a) every other one is merged, from the left.
            opens = np.r_[True, after[hit[:-1]] != hit[1:]]
            run = np.maximum.accumulate(np.where(opens, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            gone = after[hit]
            symbol[hit], rank[gone] = self.made[r], self.none
            after[hit] = after[gone]
            inner = after[hit] < n
            before[after[hit][inner]] = hit[inner]
            left = before[hit]
            changed = np.unique(np.concatenate([left[left >= 0], hit]))
            has = after[changed] < n
            rank[changed] = self.none
            pairs = changed[has]
            rank[pairs] = self._ranks(symbol[pairs], symbol[after[pairs]])
            keep(pairs)
            count -= len(gone)
        return count

    def counts(self, words: list[str]) -> np.ndarray:
        raw = [w.encode("utf-8", "surrogateescape") for w in words]
        result = np.zeros(len(raw), np.int64)
        short = [i for i, w in enumerate(raw) if len(w) < LONG_WORD]
        for i, w in enumerate(raw):
            if len(w) >= LONG_WORD:
                result[i] = self.long_count(w)
        if short:
            result[short] = self._short_counts([raw[i] for i in short])
        return result

    def _short_counts(self, raw: list[bytes]) -> np.ndarray:
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        result = length.copy()
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(length)
        symbol = self.plain[flat]
        symbol[ends - 1] = self.final[flat[ends - 1]]
        word = np.arange(len(raw))
        while len(word):
            last = np.cumsum(length) - 1
            rank = np.full(len(symbol), self.none)
            rank[:-1] = self._ranks(symbol[:-1], symbol[1:])
            rank[last] = self.none
            best = np.minimum.reduceat(rank, last - length + 1)
            hit = np.flatnonzero((rank == np.repeat(best, length)) & (rank < self.none))
            # In a run of overlapping occurrences (a a a) every other one is merged, from the left.
            opens = np.r_[True, np.diff(hit) != 1] if len(hit) else np.zeros(0, bool)
            run = np.maximum.accumulate(np.where(opens, np.arange(len(hit)), 0)) if len(hit) else hit
            hit = hit[(hit - hit[run]) % 2 == 0] if len(hit) else hit
            symbol[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            owner = np.repeat(np.arange(len(word)), length)
            length = np.bincount(owner[keep], minlength=len(word))
            going = (best < self.none) & (length > 1)
            result[word] = length
            keep &= going[owner]
            symbol, word, length = symbol[keep], word[going], length[going]
        return result


@functools.lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


@functools.lru_cache(maxsize=2)
def _known(path: str) -> dict[str, int]:
    return {}


def count_batch(docs: list[str], path: str) -> tuple[list[int], list[int]]:
    """Tokens and pre-tokens of each text. Counts of words met before are kept, up to ``CACHE_WORDS`` of them."""
    known = _known(path)
    tokens, pre = [], []
    split = [pretokens.segments(x, path) for x in docs]
    fresh: set[str] = set()
    for found, _ in split:
        fresh.update(found)
    if len(known) > CACHE_WORDS:
        known.clear()
    new = [w for w in fresh if w not in known]
    if new:
        known.update(zip(new, merger(path).counts(new).tolist(), strict=True))
    for found, specials in split:
        tokens.append(sum(map(known.__getitem__, found)) + specials)
        pre.append(len(found) + specials)
    return tokens, pre


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, n_pretokens, over_limit (n_tokens > limit).

    A null text counts as an empty one (0 tokens). Repeated rows and ids give a row each, an empty table gives none,
    other columns are not read. A text may be of any length; it is counted whole.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_pretokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            tokens, pre = count_batch(texts(batch), tokenizer)
            n_bytes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, pa.array(tokens, pa.int64()), pa.array(pre, pa.int64()), pa.array([n > limit for n in tokens])], names=schema.names)

    return src.mapInArrow(run, schema)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
