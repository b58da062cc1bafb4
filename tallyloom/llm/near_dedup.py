"""MinHash near-dedup: circulant signatures, banding, leaders, and exact Jaccard verification.

Documents with equal shingle sets become one node first. A signature's coordinates all come from two permutations of
the 32-bit universe: the first scatters the items, the second is applied after a circular shift by the coordinate's
number. Nodes that share a band key are candidates; only pairs that can still join two components are formed, so a
group of copies costs about its size and not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import by_bytes, discard, spread_join, stored, table, unused
from tallyloom.llm.components import components
from tallyloom.llm.hashing import mix64, packed, unpacked, word_hashes

SHINGLE = 5
BANDS, ROWS = 32, 4
#: Signatures that agree in less than this share are not compared as sets. At a similarity of 0.75 the share lies under
#: it with a probability of about 1e-7 (128 coordinates), less than that of sharing no band (5e-6).
AGREE = 0.55
SLICE_ROWS = 1024
BIN_ROWS = 4096
SLICE_BYTES = 4 << 20
_U32 = np.uint32


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; fewer words than ``size`` are one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : len(words) - size + 1 + i]
    return np.unique(mix64(total))


def _permute(x: np.ndarray, m1: int, m2: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place: shifts and odd factors can be undone."""
    x ^= x >> _U32(16)
    x *= _U32(m1)
    x ^= x >> _U32(15)
    x *= _U32(m2)
    x ^= x >> _U32(16)
    return x


def signature(items: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash: coordinate j is the least of pi(sigma(x) + j mod 2**32) over the set."""
    scattered = _permute((items >> np.uint64(32)).astype(_U32), 0x7FEB352D, 0x846CA68B)
    shifts = np.arange(1, k + 1, dtype=_U32)[:, None]
    least = np.full(k, 0xFFFFFFFF, _U32)
    for i in range(0, len(scattered), 1024):
        least = np.minimum(least, _permute(scattered[None, i : i + 1024] + shifts, 0xD168AAAD, 0xAF723597).min(axis=1))
    return least


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    total = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for column in sig.reshape(bands, rows).astype(np.uint64).T:
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + column)
    return total.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * shared >= 75 * (len(a) + len(b) - shared)


def fingerprint(items: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None


def _described(src: DataFrame) -> DataFrame:
    """Per row: size of its shingle set, 128-bit fingerprint of the set, band keys and the low byte of each coordinate."""
    schema = T.StructType([*src.drop("text").schema.fields, T.StructField("n_shingles", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            size, fp, bands, sketch = [], [], [], []
            for text in batch.column("text").to_pylist():
                items = shingle_set(text)
                sig = signature(items)
                size.append(len(items)), fp.append(fingerprint(items))
                bands.append(band_keys(sig) if len(items) else None), sketch.append((sig & _U32(255)).astype(np.uint8).tobytes() if len(items) else None)
            rest = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(size, pa.int64()), pa.array(fp, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=schema.names)

    return src.mapInArrow(run, schema)


def _sets(src: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, items, short) of each wanted node; ``wanted`` has the key of one row that holds it.

    Texts meet the wanted keys by a shuffle at any size, and only those of one row per node get any further. ``short``
    has 48 bits of each item, packed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            items = [shingle_set(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(x) for x in items], pa.binary()), pa.array([x.tobytes() for x in items], pa.binary()), pa.array([packed(x >> np.uint64(16)) for x in items], pa.binary())], names=["fp", "items", "short"])

    texts = src.where("text is not null").select("row_key", "text").join(wanted.select("row_key").hint("merge"), "row_key", "left_semi")
    found = texts.select("text").mapInArrow(run, "fp binary, items binary, short binary")
    # Rows that share an id and a text share a key; their sets are one.
    return found.groupBy("fp").agg(F.first("items").alias("items"), F.first("short").alias("short"))


def _confirm(spark: SparkSession, pairs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar: sizes and sketches first, then the whole sets."""
    side = lambda df, x, cols: df.select(F.col("fp").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in cols))
    sized = pairs.join(side(nodes, "a", ["n_shingles", "sketch"]), "a").join(side(nodes, "b", ["n_shingles", "sketch"]), "b")
    sized = sized.where("100 * least(n_shingles_a, n_shingles_b) >= 75 * greatest(n_shingles_a, n_shingles_b)").select("a", "b", "sketch_a", "sketch_b")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= AGREE))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "items_b", SLICE_BYTES):
            x, y = (batch.column(c).to_pylist() for c in ("items_a", "items_b"))
            keep = [linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    likely = sized.mapInArrow(alike, "a binary, b binary")
    whole = likely.join(side(sets, "a", ["items"]), "a").join(side(sets, "b", ["items"]), "b")
    return stored(spark, whole.select("a", "b", "items_a", "items_b").mapInArrow(exact, "a binary, b binary"), "links")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, as products of membership matrices."""
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)))
    out = np.zeros((len(left), len(right)), np.float32)
    for i in range(0, len(common), width):
        part = common[i : i + width]
        marks = []
        for side in (left, right):
            flat, size = np.concatenate(side), np.array([len(x) for x in side])
            at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            there = part[at] == flat
            mark = np.zeros((len(side), len(part)), np.float32)
            mark[np.repeat(np.arange(len(side)), size)[there], at[there]] = 1
            marks.append(mark)
        out += marks[0] @ marks[1].T
    return out


def _across(spark: SparkSession, member: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame, places: int) -> DataFrame:
    """Pairs (a, b) of labels whose components link within a bucket, enough of them to join all that links join.

    A bucket's nodes outside its largest component are sliced, and so are all its nodes; every two slices meet in a
    block of bounded size, where sketches and then whole sets are compared as matrices. Pairs don't leave their block:
    only what joins components does, so the result is smaller than the blocks' rows. (Items have 48 bits here: two sets
    of 300 meet a false match once in 10**9 times.)
    """
    known = member.select("key", "fp").join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", F.coalesce("label", "fp").alias("label"))
    mixed = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low <> high").select("key", "n")
    known = stored(spark, spread_join(known, mixed, "key", "n", places, "inner"), "mixed")
    sizes = known.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.sum("n").alias("total"), F.max("n").alias("most"))
    sizes = sizes.withColumn("parts", F.ceil(F.col("total") / SLICE_ROWS)).withColumn("minor_parts", F.ceil((F.col("total") - F.col("most")) / SLICE_ROWS))
    sizes = stored(spark, sizes, "sizes")
    work = sizes.agg(F.sum(F.expr("total * minor_parts + (total - most) * parts")).alias("n")).first()["n"] or 0
    rows = spread_join(known, sizes.withColumn("n", F.col("total")), "key", "n", places, "inner").join(nodes.select("fp", "sketch", "n_shingles"), "fp").join(sets.select("fp", "short"), "fp")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    common = ["key", "fp", "label", "sketch", "n_shingles", "short"]
    every = rows.select(*common, F.pmod(F.xxhash64("fp"), F.col("parts")).alias("i"), upto("minor_parts").alias("j"), F.lit(False).alias("minor"))
    minor = rows.where("label <> major").select(*common, F.pmod(F.xxhash64("fp", F.lit(1)), F.col("minor_parts")).alias("j"), upto("parts").alias("i"), F.lit(True).alias("minor"))
    blocks = every.unionByName(minor).withColumn("bin", F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(1, work // BIN_ROWS))))

    def compare(group: pa.Table) -> pa.Table:
        keys = np.stack([group.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j", "minor")])
        order = np.lexsort(keys[::-1])
        keys = keys[:, order]
        group = group.take(pa.array(order))
        cuts = np.flatnonzero(np.r_[True, (keys[:3, 1:] != keys[:3, :-1]).any(axis=0)]).tolist()
        label, sketch, short = (group.column(c).to_pylist() for c in ("label", "sketch", "short"))
        size = group.column("n_shingles").to_numpy()
        text, code = np.unique(np.array(label, object), return_inverse=True)
        pairs = set()
        for a, b in zip(cuts, [*cuts[1:], keys.shape[1]], strict=True):
            split = a + int((keys[3, a:b] == 0).sum())
            if split in (a, b):
                continue
            x, y = (np.frombuffer(b"".join(sketch[p:q]), np.uint8).reshape(q - p, -1) for p, q in ((split, b), (a, split)))
            likely = np.stack([(y == row).mean(axis=1) >= AGREE for row in x]) & (code[split:b, None] != code[None, a:split])
            rows, columns = np.flatnonzero(likely.any(axis=1)), np.flatnonzero(likely.any(axis=0))
            if not len(rows):
                continue
            n, m = size[split + rows].astype(np.int64)[:, None], size[a + columns].astype(np.int64)[None, :]
            both = shared_counts(*([unpacked(short[k], np.uint64) for k in at.tolist()] for at in (split + rows, a + columns))).astype(np.int64)
            linked_ = likely[np.ix_(rows, columns)] & (100 * both >= 75 * (n + m - both))
            # Of the links only those that join components not yet joined in this block leave it, as pairs of labels,
            # those with frequent components first: blocks of other buckets then mostly name the same pairs.
            names, often = np.unique(code[a:b], return_counts=True)
            root, often = {c: c for c in names.tolist()}, dict(zip(names.tolist(), often.tolist(), strict=True))

            def find(c: int) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            for i, row in enumerate(linked_):
                own = int(code[split + rows[i]])
                for c in sorted(np.unique(code[a + columns[np.flatnonzero(row)]]).tolist(), key=lambda c: (-often[c], c)):
                    if find(own) != find(c):
                        root[find(own)] = find(c)
                        pairs.add((min(text[own], text[c]), max(text[own], text[c])))
        return pa.table([pa.array([p for p, _ in pairs], pa.binary()), pa.array([q for _, q in pairs], pa.binary())], names=["a", "b"])

    pairs = stored(spark, blocks.groupBy("bin").applyInArrow(compare, "a binary, b binary").distinct(), "pairs")
    discard(spark, known, sizes)
    return pairs


def groups(spark: SparkSession, rows: DataFrame, src: DataFrame, total: int) -> DataFrame:
    """(node, label) of the nodes that link with another: equal labels for nodes that links connect. ``total``: the number of rows."""
    nodes = rows.where("fp is not null").groupBy("fp").agg(F.min("row_key").alias("row_key"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"))
    member = nodes.select("fp", F.explode("bands").alias("key"))
    shared = member.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("leader")).where("n > 1")
    member = stored(spark, spread_join(member, shared, "key", "n", BANDS * total, "inner").select("key", "fp", "leader"), "members")
    candidates = member.select("fp").distinct()
    nodes = stored(spark, nodes.drop("bands").join(candidates, "fp", "left_semi"), "nodes")
    sets = stored(spark, _sets(src, nodes), "sets")
    # First every node against the least of its buckets' leaders.
    pairs = member.groupBy("fp").agg(F.min("leader").alias("a")).where("a <> fp").select("a", F.col("fp").alias("b"))
    labels = components(spark, _confirm(spark, pairs, nodes, sets))
    # Then, in buckets that still hold several components, every node of the rarer ones against all nodes there that
    # lie in another. Pairs within a component need no test, so after this none is left that could join two.
    links = _across(spark, member, labels, nodes, sets, BANDS * total)
    discard(spark, member, nodes, sets)
    joined = components(spark, links).select(F.col("node").alias("from"), F.col("label").alias("to"))
    old = labels.select("node", "label").union(joined.join(labels, F.col("from") == F.col("node"), "left_anti").select(F.col("from"), F.col("from")))
    return old.join(joined, F.col("label") == F.col("from"), "left").select("node", F.coalesce("to", "label").alias("label"))


def _row_key(id_col: str, text_col: str) -> Column:
    """Equal for rows that share an id and a text only; so copies under other ids don't crowd one key."""
    return F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, row_key, n_shingles, component_id, kept, first.

    Documents link when the Jaccard similarity of their sets of distinct five-word shingles is 0.75 or more; fewer than
    five words are one shingle. Null, empty and wordless texts link with nothing. component_id is the smallest doc_id
    reachable, kept says that it is the row's own. Where no row reachable has an id, component_id is null and one of
    them is kept. ``first`` marks the one row of each group that stays in a corpus: of the smallest id, and of rows
    with that id one text. Rows that share an id and a text get equal results. An empty table gives no rows. Other
    columns are not read.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("row_key", _row_key("doc_id", "text"))
    rows = stored(spark, _described(src), "described")
    total = rows.count()
    labels = groups(spark, rows, src, total)
    rows = rows.drop("bands", "sketch")
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")
    nodes = rows.where("fp is not null").groupBy("fp").agg(F.min(own).alias("own"), F.count("*").alias("n"))
    nodes = stored(spark, nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("label", "fp")).drop("label"), "named")
    least = stored(spark, nodes.groupBy("comp").agg(F.min("own").alias("least"), F.count("*").alias("members")), "least")
    named = stored(spark, spread_join(nodes, least, "comp", "members", total).select("fp", "least", "n"), "components")
    found = spread_join(rows, named, "fp", "n", total)
    alone = F.col("least").isNull()
    first = alone | (F.col("least.row_key") == F.col("row_key"))
    kept = F.when(F.col("doc_id").isNull(), first & (alone | F.col("least.unnamed"))).otherwise(alone | F.col("doc_id").eqNullSafe(F.col("least.doc_id")))
    return found.select("doc_id", "row_key", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), kept.alias("kept"), first.alias("first"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` to keep, one of each group, with the same columns; repeated rows count as copies.

    Rows without words link with nothing and all stay. Of rows that share an id and a text but not the other columns,
    the one whose hash over all columns is least stays. Columns may have any names.
    """
    key, many, every, rank = unused(docs, "row_key", "many", "every", "rank")
    marks = near_duplicates(spark, docs, id_col, text_col).where("first and n_shingles > 0")
    marks = stored(spark, marks.groupBy(F.col("row_key").alias(key)).agg(F.count("*").alias(many)), "kept")
    total = marks.agg(F.sum(many).alias("n")).first()["n"] or 0
    blank = ~F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    worded = docs.where(~blank).withColumn(key, _row_key(id_col, text_col))
    kept = worded.join(marks.where(F.col(many) == 1).select(key), key, "left_semi")
    again = marks.where(F.col(many) > 1)
    if not again.isEmpty():
        times = again.withColumn(rank, F.lit(1))
        picked = spread_join(worded, times, key, many, total, "inner").drop(rank)
        picked = picked.groupBy(key).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(every)).select(f"{every}.*")
        kept = kept.select(*docs.columns).unionByName(picked)
    return kept.select(*docs.columns).unionByName(docs.where(blank))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents")).drop("row_key", "first")
