"""Quality classifier from weak labels: expectation-maximisation over overlapping labellers, then a hashed linear scorer.

Two questions are asked of each document: is it junk, and is it toxic. For each, several heuristic labellers vote good,
bad or nothing; given labels are one more voter, whose errors are estimated like those of the others. EM estimates every
voter's accuracy from how often the votes of all documents coincide (only the counts of vote patterns are gathered). The
posteriors, of documents with and without given labels alike, train a logistic scorer over the votes and hashed words,
which decides about every document.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import by_bytes, stored, table
from tallyloom.llm.hashing import word_hashes
from tallyloom.llm.pages import STOP_WORDS

#: The word lists are learned from about this many rows with given labels, the scorer from these and as many others, taken
#: by a hash; of fewer rows where texts are so long that more would be over ``SAMPLE_BYTES`` of text.
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 64 << 20
HASH_BITS = 16
SLICE_BYTES = 2 << 20
GOOD, BAD, NONE = 0, 1, 2
PREFIX = 4
N_JUNK, N_TOXIC = 8, 3
# Words that insult.
INSULTS = frozenset("asshole bastard bitch clown disgusting dumbass idiot idiots imbecile loser losers moron morons pathetic scum scumbag stupid trash worthless".split())
_CORE = re.compile(r"[^\W\d_]+")
_PLAIN = ".,;:!?'\"()-’“”«»¿¡。，、"


@dataclass
class Lexicon:
    """What known labels teach the toxicity labellers: telling words, and by language telling beginnings of words.

    ``stems``: beginning -> (gain of each occurrence, cost of each word of the text), a Poisson likelihood ratio.
    """

    words: frozenset[str] = frozenset()
    stems: dict[str, dict[str, tuple[float, float]]] = field(default_factory=dict)
    heads: dict[str, frozenset[str]] = field(default_factory=dict)


def ratio_vote(value: float, good: float, bad: float) -> int:
    """Bad from ``bad`` on, good up to ``good``, else no vote."""
    if good < bad:
        return BAD if value >= bad else GOOD if value <= good else NONE
    return BAD if value <= bad else GOOD if value >= good else NONE


def votes(text: str, lang: str | None, lexicon: Lexicon) -> tuple[list[int], list[int], list[str]]:
    """Votes on junk, votes on toxicity, and the text's words in lower case, letters only."""
    words = text.split()
    cores = _CORE.findall(text.lower())
    n, chars = len(words), sum(map(len, words))
    if not n:
        return [NONE] * N_JUNK, [NONE] * N_TOXIC, cores
    letters, known = sum(map(len, cores)), set(cores)
    digits, plain = sum(map(text.count, "0123456789")), sum(map(text.count, _PLAIN))
    latin = letters and max(map(len, cores)) < 40
    junk = [
        ratio_vote(1 - (letters + digits + plain) / chars, 0.02, 0.08),
        ratio_vote(sum(map(eq, words, words[1:])) / n, 0.03, 0.2) if n >= 10 else NONE,
        ratio_vote(sum(map(str.isupper, words)) / n, 0.2, 0.5) if n >= 10 else NONE,
        ratio_vote((text.count("|") + text.count("\t")) / n, 0.02, 0.15) if n >= 10 else NONE,
        ratio_vote(sum(map(STOP_WORDS.__contains__, cores)) / max(1, len(cores)), 0.12, 0.02) if n >= 20 and latin else NONE,
        ratio_vote(text.count("!") / n, 0.05, 0.3) if n >= 10 else NONE,
        ratio_vote(letters / chars, 0.8, 0.6),
        ratio_vote(len(known) / len(cores), 0.3, 0.1) if 50 <= len(cores) <= 3000 else NONE,
    ]
    score = 0.0
    language = lang or ""
    if heads := lexicon.heads.get(language):
        stems, counts = lexicon.stems[language], Counter()
        for w in cores:
            if w[:PREFIX] in heads:
                counts.update(w[:k] for k in range(PREFIX, min(PREFIX + 3, len(w)) + 1))
        score = max((c * stems[s][0] - len(cores) * stems[s][1] for s, c in counts.items() if s in stems), default=0.0)
    toxic = [
        GOOD if INSULTS.isdisjoint(known) else BAD,
        NONE if not lexicon.words else GOOD if lexicon.words.isdisjoint(known) else BAD,
        NONE if not heads else ratio_vote(score, 0.0, 2.5),
    ]
    return junk, toxic, cores


def _word_counts(sample: DataFrame) -> DataFrame:
    """Per kind (w a word, s a beginning of words, n all words) and language: documents and occurrences among clean and toxic rows.

    ``reach`` counts the words of the toxic documents that have it. Words are counted over all languages.
    """
    schema = "kind string, lang string, name string, clean long, toxic long, clean_n long, toxic_n long, reach long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE_BYTES // 4):
            found: dict[tuple[str, str, str], list[int]] = defaultdict(lambda: [0] * 5)
            for text, lang, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "toxic")), strict=True):
                cores = _CORE.findall(text.lower())

                def add(kind: str, language: str, name: str, n: int) -> None:
                    row = found[kind, language, name]
                    row[toxic] += 1
                    row[2 + toxic] += n
                    row[4] += len(cores) * toxic

                for w in set(cores):
                    add("w", "", w, 1)
                for stem, n in Counter(w[:k] for w in cores for k in range(PREFIX, min(PREFIX + 3, len(w)) + 1)).items():
                    add("s", lang or "", stem, n)
                add("n", lang or "", "", len(cores))
            names, rows = list(zip(*found.keys(), strict=True)) or [[]] * 3, list(zip(*found.values(), strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in names), *(pa.array(c, pa.int64()) for c in rows)], names=["kind", "lang", "name", "clean", "toxic", "clean_n", "toxic_n", "reach"])

    sums = ["clean", "toxic", "clean_n", "toxic_n", "reach"]
    return sample.where("toxic is not null").select("text", "lang", "toxic").mapInArrow(count, schema).groupBy("kind", "lang", "name").agg(*(F.sum(c).alias(c) for c in sums))


def learn_lexicon(sample: DataFrame, least: int = 5, precision: float = 0.9) -> Lexicon:
    """Telling words, and by language telling beginnings of words, from rows (text, lang, toxic); only they are gathered."""
    counts = stored(sample.sparkSession, _word_counts(sample), "words")
    languages = {r["lang"]: r for r in counts.where("kind = 'n'").collect()}
    words = counts.where(f"kind = 'w' and toxic >= {least} and toxic >= {precision} * (toxic + clean)").select("name").collect()
    lexicon = Lexicon(frozenset(r["name"] for r in words))
    # A beginning that most toxic documents of the language share, far more often than clean ones have it.
    all_words = counts.where("kind = 'n'").select("lang", F.col("toxic").alias("docs"), F.col("clean_n").alias("clean_words"))
    often = F.col("toxic_n") / F.greatest("reach", F.lit(1))
    seldom = (F.col("clean_n") + 0.5) / F.greatest("clean_words", F.lit(1))
    stems = counts.where("kind = 's'").join(all_words, "lang").where(f"docs >= {least} and toxic >= 0.4 * docs").where(often >= 8 * seldom)
    found: dict[str, dict[str, tuple[float, float]]] = {lang: {} for lang in languages}
    for r in stems.select("lang", "name", F.log(often / seldom).alias("gain"), (often - seldom).alias("cost")).collect():
        found[r["lang"]][r["name"]] = (r["gain"], r["cost"])
    lexicon.stems = {lang: stems for lang, stems in found.items() if stems}
    lexicon.heads = {lang: frozenset(s[:PREFIX] for s in stems) for lang, stems in lexicon.stems.items()}
    return lexicon


#: What EM adds to the counts of right and wrong votes: given labels are taken to be right at first, others may be anything.
GIVEN, OTHERS = (3.0, 0.5), (0.5, 0.5)


def label_model(patterns: dict[tuple[int, ...], int], given: int, rounds: int = 100) -> dict[tuple[int, ...], float]:
    """Posterior chance of bad for each vote pattern; the voter at place ``given`` starts out as the most trusted.

    Each voter has a chance of either vote under either answer (Dawid-Skene), voters are independent given the answer.
    All chances, those of given labels too, are learned from the votes.
    """
    keys = list(patterns)
    if not keys:
        return {}
    seen, times = np.array(keys), np.array([patterns[k] for k in keys], float)
    trust = np.full(seen.shape[1], 0.7)
    trust[given] = 4.0
    belief = 1 / (1 + np.exp(-((seen == BAD) * 2.0 * trust - (seen == GOOD) * 0.5 * trust).sum(axis=1)))
    belief = np.clip(belief, 0.02, 0.98)
    for _ in range(rounds):
        mass = np.stack([times * (1 - belief), times * belief])
        prior = (mass.sum(axis=1) + 1) / (times.sum() + 2)
        log = np.log(prior)[:, None] + np.zeros((2, len(keys)))
        for voter in range(seen.shape[1]):
            right, wrong = GIVEN if voter == given else OTHERS
            # Accuracy is that of votes given: a voter that keeps silent says nothing.
            chance = np.stack([np.bincount(seen[:, voter], m, 3)[:2] for m in mass]) + np.array([[right, wrong], [wrong, right]])
            chance = chance / chance.sum(axis=1, keepdims=True)
            log += np.hstack([np.log(chance), np.zeros((2, 1))])[:, seen[:, voter]]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - belief).max() < 1e-6:
            break
        belief = new
    return dict(zip(keys, belief.tolist(), strict=True))


def features(junk: list[int], toxic: list[int], cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features: a bias, each vote given, and distinct hashed words that share a length of one."""
    fixed = [0, *(1 + 3 * i + v for i, v in enumerate([*junk, *toxic]) if v != NONE)]
    hashed = np.unique(word_hashes([w.encode() for w in set(cores)]) >> np.uint64(64 - HASH_BITS)).astype(np.int64) + 1 + 3 * (len(junk) + len(toxic))
    return np.concatenate([fixed, hashed]), np.concatenate([np.ones(len(fixed)), np.full(len(hashed), max(1, len(hashed)) ** -0.5)])


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, width: int, rounds: int = 150, ridge: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft targets (one column per question) by Adam over the whole sample."""
    weights = np.zeros((width, targets.shape[1]))
    if not rows:
        return weights
    at, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    size = np.array([len(r[0]) for r in rows])
    start, owner = np.cumsum(size) - size, np.repeat(np.arange(len(rows)), size)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        for k in range(targets.shape[1]):
            margin = np.add.reduceat(weights[at, k] * value, start)
            error = 1 / (1 + np.exp(-margin)) - targets[:, k]
            gradient = np.bincount(at, value * error[owner], width) / len(rows) + ridge * weights[:, k]
            m[:, k], v[:, k] = 0.9 * m[:, k] + 0.1 * gradient, 0.99 * v[:, k] + 0.01 * gradient**2
            weights[:, k] -= 0.1 * (m[:, k] / (1 - 0.9**step)) / (np.sqrt(v[:, k] / (1 - 0.99**step)) + 1e-8)
    return weights


def _source(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), lang.alias("lang"))


def _sample(spark: SparkSession, src: DataFrame, gold: DataFrame) -> DataFrame:
    """The rows to fit on: with given labels (quality, toxic) and, with nulls there, without; rows that share id and text once."""
    size = src.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    labelled = gold.count()
    rows = min(SAMPLE_ROWS, SAMPLE_BYTES * size["n"] // (2 * max(1, size["bytes"] or 0)))
    share = lambda column, n: F.pmod(F.xxhash64(column), F.lit(1_000_003)) < int(1_000_003 * min(1.0, rows / max(1, n)))
    keyed = src.withColumn("row_key", F.xxhash64("doc_id", "text"))
    given = keyed.join(gold.where(share("doc_id", labelled)), "doc_id")
    others = keyed.where(share("row_key", size["n"])).join(gold.select("doc_id"), "doc_id", "left_anti")
    both = given.select("row_key", "text", "lang", "quality", "toxic").unionByName(others.select("row_key", "text", "lang"), allowMissingColumns=True)
    return stored(spark, both.groupBy("row_key").agg(*(F.first(c).alias(c) for c in ("text", "lang", "quality", "toxic"))), "sample")


def _patterns(src: DataFrame, gold: DataFrame, lexicon: Lexicon) -> tuple[Counter, Counter]:
    """How often each pattern of votes, the given label last, occurs over all documents: on junk, on toxicity."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            both = [votes(x, y, lexicon)[:2] for x, y in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(["".join(map(str, v[k])) for v in both], pa.string()) for k in (0, 1))], names=["doc_id", "junk", "ugly"])

    voted = src.mapInArrow(vote, T.StructType([src.schema["doc_id"], T.StructField("junk", T.StringType()), T.StructField("ugly", T.StringType())]))
    # Written, so that the texts are read once for both kinds of ids.
    voted = stored(src.sparkSession, voted.groupBy("doc_id", "junk", "ugly").agg(F.count("*").alias("n")), "votes")
    none = F.lit(None).cast("int")
    known = voted.where("doc_id is not null").join(gold, "doc_id", "left").unionByName(voted.where("doc_id is null").withColumn("quality", none).withColumn("toxic", none))
    out: tuple[Counter, Counter] = Counter(), Counter()
    for r in known.groupBy("junk", "ugly", "quality", "toxic").agg(F.sum("n").alias("n")).collect():
        out[0][(*map(int, r["junk"]), NONE if r["quality"] is None else 1 - r["quality"])] += r["n"]
        out[1][(*map(int, r["ugly"]), NONE if r["toxic"] is None else r["toxic"])] += r["n"]
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quality_col: str = "quality", toxic_col: str = "toxic"):
    """The fitted (lexicon, weights). Vote patterns are counted over all documents, lists and weights come from the sample."""
    spark = docs.sparkSession
    src = _source(docs, id_col, text_col, lang_col)
    gold = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(quality_col).cast("int").alias("quality"), F.max(toxic_col).cast("int").alias("toxic"))
    sample = _sample(spark, src, gold)
    lexicon = learn_lexicon(sample)
    patterns = _patterns(src, gold, lexicon)
    models = [label_model(p, given) for p, given in zip(patterns, (N_JUNK, N_TOXIC), strict=True)]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            at, value, targets = [], [], []
            for text, lang, quality, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "quality", "toxic")), strict=True):
                junk, ugly, cores = votes(text, lang, lexicon)
                where, weight = features(junk, ugly, cores)
                keys = (*junk, NONE if quality is None else 1 - quality), (*ugly, NONE if toxic is None else toxic)
                at.append(where.astype(np.int32)), value.append(weight.astype(np.float32)), targets.append([models[k].get(keys[k], 0.5) for k in (0, 1)])
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in at], pa.binary()), pa.array([x.tobytes() for x in value], pa.binary()), pa.array(targets, pa.list_(pa.float64()))], names=["at", "value", "target"])

    taught = sample.orderBy("row_key").select("text", "lang", "quality", "toxic").mapInArrow(describe, "at binary, value binary, target array<double>").collect()
    rows = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32)) for r in taught]
    targets = np.array([r["target"] for r in taught], float).reshape(-1, 2)
    return lexicon, fit_scorer(rows, targets, 1 + 3 * (N_JUNK + N_TOXIC) + (1 << HASH_BITS))


def _scores(batch: pa.RecordBatch, at: int, lang: int | None, lexicon: Lexicon, weights: np.ndarray) -> np.ndarray:
    langs = batch.column(lang).to_pylist() if lang is not None else [None] * batch.num_rows
    out = np.zeros((batch.num_rows, 2))
    for i, (text, language) in enumerate(zip(batch.column(at).to_pylist(), langs, strict=True)):
        where, value = features(*votes(text or "", language, lexicon))
        out[i] = value @ weights[where]
    return 1 / (1 + np.exp(-out))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bar: float = 0.5) -> DataFrame:
    """One row per document row: doc_id, p_junk, p_toxic, kept (both under ``bar``).

    A null text counts as an empty one; no labeller votes on it, and it is kept or not by the scorer's bias. Null ids
    have no known label. Repeated label rows of a document count as bad if one is. Repeated document rows get equal
    results; empty documents give no rows, empty labels a label model of heuristics alone. Of other columns only
    ``lang_col``, if there, is read.
    """
    lexicon, weights = fit(docs, labels, id_col, text_col, lang_col)
    src = _source(docs, id_col, text_col, lang_col)
    schema = T.StructType([src.schema["doc_id"], T.StructField("p_junk", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            p = _scores(batch, 1, 2, lexicon, weights)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array((p < bar).all(axis=1))], names=schema.names)

    return src.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bar: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with the same columns."""
    lexicon, weights = fit(docs, labels, id_col, text_col, lang_col)
    at, lang = docs.columns.index(text_col), docs.columns.index(lang_col) if lang_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_col, SLICE_BYTES):
            yield batch.filter(pa.array((_scores(batch, at, lang, lexicon, weights) < bar).all(axis=1)))

    return docs.mapInArrow(run, docs.schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
