"""Quotes found whole in texts: keys of windows of characters meet by equality, then containment is confirmed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.text import plain, slices

LARGEST = 64
#: Bits of the filter for each key of an item, and at most this many in all (32 MB); beyond, more passes in vain.
BITS_PER_KEY, MOST_BITS = 16, 1 << 28


def window_keys(text: str, size: int) -> np.ndarray:
    """The keys of all windows of ``size`` characters: of each, the least hash of its pieces of half the size.

    A text that holds another whole has all the keys of that other one, wherever it stands. ``size`` is a power of two.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(code) < size:
        return np.zeros(0, np.int64)
    h, width, piece = (code + np.uint64(size << 32)) * np.uint64(0x9E3779B97F4A7C15), 1, max(1, size // 2)
    h ^= h >> np.uint64(29)
    while width < piece:
        h = (h[:-width] * np.uint64(0xBF58476D1CE4E5B9) + h[width:]) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        width *= 2
    many, span = size - piece + 1, 1
    while span < many:
        step = min(span, many - span)
        h = np.minimum(h[: len(h) - step], h[step:])
        span += step
    return np.unique(h).view(np.int64)


def _keyed(texts: DataFrame, id_col: str, sizes: list[int] | None, wanted: np.ndarray | None = None) -> DataFrame:
    """(id, key) of plain texts in column ``plain_``; ``sizes`` of None: each text's own size."""
    out = T.StructType([texts.schema[id_col], T.StructField("key_", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, s in enumerate(batch.column("plain_").to_pylist()):
                own = sizes if sizes is not None else [min(LARGEST, 1 << (len(s).bit_length() - 1))] if s else []
                for size in own if s else []:
                    k = window_keys(s, size)
                    if wanted is not None:
                        at = k & (8 * len(wanted) - 1)
                        k = k[(wanted[at >> 3] >> (at & 7) & 1).astype(bool)]
                    row.append(np.full(len(k), i)), keys.append(k)
            at = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(at), pa.array(np.concatenate(keys))], names=out.names)

    return texts.select(id_col, "plain_").mapInArrow(each, out)


def contained(spark: SparkSession, docs: DataFrame, items: DataFrame, stored: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, item) of every item that stands whole in a document, character references and white space aside.

    An item meets documents on the rarest of its keys, one for each window of up to ``LARGEST`` characters (shorter
    items have keys by their own length). A bitmap, as large as the items ask for, keeps other keys of documents out of the shuffle.
    Nulls and items without characters are in no document; the reference asks quotes for content.
    """
    items = items.select(item_col, plain(F.col(text_col)).alias("plain_")).where(F.length("plain_") > 0)
    item_keys = stored(_keyed(items, item_col, None).distinct())
    length = F.least(F.lit(LARGEST), F.length("plain_"))
    sizes = sorted(1 << r["n"] for r in items.select(F.floor(F.log2(length) + 1e-9).cast("int").alias("n")).distinct().collect())
    size = min(MOST_BITS, 1 << max(16, (BITS_PER_KEY * item_keys.count()).bit_length()))
    place = F.col("key_").bitwiseAND(F.lit(size - 1))
    bits = item_keys.groupBy(F.shiftright(place, 3).alias("byte")).agg(F.bit_or(F.lit(1).cast("long") * F.pow(F.lit(2), place.bitwiseAND(F.lit(7))).cast("long")).alias("bits")).toPandas()
    wanted = np.zeros(size >> 3, np.uint8)
    wanted[bits["byte"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64).astype(np.uint8)
    found = stored(_keyed(docs.select(id_col, plain(F.col(text_col)).alias("plain_")), id_col, sizes, wanted).distinct())
    # A key that no document has settles its item: it counts as the rarest, and meets nothing.
    counts = item_keys.join(found.groupBy("key_").agg(F.count("*").alias("n_")), "key_", "left")
    rarest = counts.groupBy(item_col).agg(F.min(F.struct(F.coalesce("n_", F.lit(0)).alias("n"), F.col("key_"))).alias("least_")).select(item_col, F.col("least_.key_").alias("key_"))
    pairs = stored(rarest.join(found, "key_").select(id_col, item_col).distinct())
    some = pairs.select(F.col(id_col).alias("id_")).distinct()
    texts = docs.join(some, F.col(id_col).eqNullSafe(F.col("id_")), "left_semi").select(F.col(id_col).alias("id_"), plain(F.col(text_col)).alias("text_"))
    quotes = items.select(F.col(item_col).alias("item_"), F.col("plain_").alias("quote_"))
    both = pairs.join(quotes, F.col(item_col).eqNullSafe(F.col("item_"))).join(texts, F.col(id_col).eqNullSafe(F.col("id_")))
    return both.where(F.contains("text_", F.col("quote_"))).select(id_col, item_col).distinct()
