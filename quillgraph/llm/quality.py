"""Op 5: a quality classifier by importance resampling.

Two generative models over hashed n-grams, a bag of buckets each: one of target text (documents labelled good: quality
1 and not toxic), one of raw text (all documents, counted in full). A document's score is the log ratio of the two
models' probabilities, the sum over its n-grams of log p_target / p_raw, brought to one length so that long documents
don't outweigh all others: LENGTH * sum / (n-grams + PRIOR). It is the log importance at a temperature that is the
document's length in units of LENGTH; PRIOR draws short documents, whose mean is noisy, to 0. Documents are ranked by
score plus Gumbel noise, and the top k stay: sampling without replacement in proportion to importance. k is the
caller's, or else the number of documents that the calibrated cut-off on the score accepts.

Toxic documents differ in single words, which a mean dilutes. So labelled documents are also counted by the words they
hold (letters lowered, hashed into WORD_BUCKETS); a document's toxic evidence is its largest log ratio of toxic to
other documents that hold a word, and one over a calibrated cut-off of its own loses TOXIC_LOSS of its score.

N-grams are words, pairs of words, and pairs of word shapes (letters to a or A, digits to 0, runs collapsed, a mark for
a word that repeats the one before), each hashed into BUCKETS buckets.

The target model is fitted on at most MAX_LABELLED labelled rows, the ones with the least hash of their id; half of
them fit the model and the other half calibrate the cut-off. The raw model, the scores and the selection cover all
rows. The driver gets one count each bucket and the labelled sample's scores, both bounded.

Defined cases: null, empty and blank texts have no n-grams, log importance 0 and are kept as undecided only if 0 is
over the cut-off; labels with a null id are ignored, and those with a null quality unless toxic;
of repeated labels the largest counts, of each kind; without labels of both kinds
every document is kept with log importance 0; null ids share their noise; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.cutoff import kth_smallest
from quillgraph.llm.tables import table
from quillgraph.session import cut, text_batches

BUCKETS = 1 << 16
MAX_LABELLED = 20_000
LENGTH, PRIOR = 200, 50
WORD_BUCKETS = 1 << 18
TOXIC_LOSS = 1e6
SEED = 7
_CACHE = 200_000
_SLICE = 1 << 17


_CLASSES = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
_REPEATS = re.compile(rb"(.)\1+", re.S)


def shape(word: bytes) -> bytes:
    return _REPEATS.sub(rb"\1", word.translate(_CLASSES))


class _Known(dict):
    """The place of each word in `words` and `forms`, the hashes of words and of their shapes."""

    def __init__(self) -> None:
        self.words, self.forms, self.shapes = array("I"), array("I"), {}

    def __missing__(self, word: bytes) -> int:
        classes = word.translate(_CLASSES)
        form = self.shapes.get(classes)
        if form is None:
            self.shapes[classes] = form = zlib.crc32(shape(word))
        self[word] = at = len(self.words)
        self.words.append(zlib.crc32(word))
        self.forms.append(form)
        return at


class Buckets:
    """The hashed n-grams of texts; hashes of words are cached, and the cache is emptied when full."""

    def __init__(self) -> None:
        self.known = _Known()

    def of(self, text: str | None) -> Iterator[np.ndarray]:
        """Arrays of bucket numbers, three kinds of n-grams over slices of the words."""
        words = (text or "").encode("utf-8", "replace").split()
        for start in range(0, len(words), _SLICE):
            if len(self.known) >= _CACHE:
                self.known = _Known()
            part = words[max(0, start - 1) : start + _SLICE]
            at = np.fromiter(map(self.known.__getitem__, part), np.int64, len(part))
            word, form = (np.frombuffer(x, np.uint32)[at].astype(np.uint64) for x in (self.known.words, self.known.forms))
            first, many = 1 if start else 0, len(part) - 1
            spread = np.empty(len(part) - first + 2 * many, np.uint64)
            spread[: len(part) - first] = word[first:] + np.uint64(77)
            spread[len(part) - first :][:many] = word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:]
            spread[len(part) - first + many :] = form[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + form[1:] + (at[:-1] == at[1:]) * np.uint64(0x165667B19E3779F9) + np.uint64(1)
            spread *= np.uint64(0xD6E8FEB86659FD93)
            yield (spread >> np.uint64(48)).view(np.int64)


_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def held_words(text: str | None) -> np.ndarray:
    """The buckets of the distinct words of a text, without case and marks."""
    words = set((text or "").encode("utf-8", "replace").translate(_PLAIN).split())
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & (WORD_BUCKETS - 1)


class Model(NamedTuple):
    """Log ratios by bucket, toxic evidence by word bucket, and the evidence over which a document is toxic."""

    ratios: np.ndarray
    evidence: np.ndarray
    most: float


def _counted(labelled: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of n-grams in all and in good documents; from BUCKETS on, other and toxic documents that hold a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, raw, target = Buckets(), np.zeros(BUCKETS + WORD_BUCKETS, np.int64), np.zeros(BUCKETS + WORD_BUCKETS, np.int64)
        waiting: dict[bool, list[np.ndarray]] = {False: [], True: []}

        def add(good: bool) -> None:
            counts = np.bincount(np.concatenate([np.empty(0, np.int64), *waiting[good]]), minlength=BUCKETS)
            raw[:BUCKETS] += counts
            if good:
                target[:BUCKETS] += counts
            waiting[good].clear()

        for batch in batches:
            for id_, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                kind = labelled.get(id_)
                good = kind == GOOD
                for found in buckets.of(text):
                    waiting[good].append(found)
                    if len(found) >= _SLICE or len(waiting[good]) >= 500:
                        add(good)
                if kind is not None:
                    (target if kind == TOXIC else raw)[BUCKETS + np.unique(held_words(text))] += 1
        add(False)
        add(True)
        at = np.flatnonzero(raw + target)
        yield pa.RecordBatch.from_pydict({"bucket": at, "raw": raw[at], "target": target[at]})

    return run


def _scored(model: Model, apart: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the score; with `apart`, the score without the loss and the toxic evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            scores, evidence = [], []
            for text in batch["text"].to_pylist():
                total, n = 0.0, 0
                for found in buckets.of(text):
                    total, n = total + float(model.ratios[found].sum()), n + len(found)
                scores.append(LENGTH * total / (n + PRIOR))
                evidence.append(float(model.evidence[held_words(text)].max(initial=-TOXIC_LOSS)) if apart or model.most < np.inf else -TOXIC_LOSS)
            if not apart:
                scores = [s - TOXIC_LOSS * (e > model.most) for s, e in zip(scores, evidence)]
            more = [pa.array(x, pa.float64()) for x in ((scores, evidence) if apart else (scores,))]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names), *more], [*batch.schema.names, "score", "evidence"][: len(batch.schema.names) + len(more)])

    return run


BAD, GOOD, TOXIC = 0, 1, 2


def labelled_sample(labels: DataFrame, limit: int = MAX_LABELLED) -> dict[int, int]:
    """id -> TOXIC, GOOD or BAD of at most `limit` labelled rows, in the order of a hash of the id.

    A document is good if a label gives it quality 1 and none calls it toxic.
    """
    toxic = F.coalesce(F.max("toxic"), F.lit(0)) == 1
    rows = labels.where("doc_id is not null").groupBy("doc_id").agg(F.when(toxic, TOXIC).otherwise(F.max("quality")).alias("kind"))
    rows = rows.where("kind is not null")
    return {r.doc_id: int(r.kind) for r in rows.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(limit).collect()}


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[Model, float]:
    """The model and the cut-off of scores, from docs(id, text)."""
    text_batches(docs.sparkSession)
    sample = labelled_sample(labels, limit)
    if len(set(sample.values())) < 2:
        return Model(np.zeros(BUCKETS), np.zeros(WORD_BUCKETS), np.inf), -1.0
    halves: tuple[dict[int, int], dict[int, int]] = ({}, {})
    for n, (id_, kind) in enumerate(sample.items()):
        halves[n % 2][id_] = kind
    raw, target = np.zeros(BUCKETS + WORD_BUCKETS), np.zeros(BUCKETS + WORD_BUCKETS)
    parts = docs.mapInArrow(_counted(halves[0]), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    for bucket, r, t in parts.collect():
        raw[bucket] += r
        target[bucket] += t
    others, toxic = raw[BUCKETS:], target[BUCKETS:]
    raw, target = raw[:BUCKETS] + 1, target[:BUCKETS] + 1
    ratios = np.log(target / target.sum()) - np.log(raw / raw.sum())
    kinds = list(halves[0].values())
    n_toxic = kinds.count(TOXIC)
    evidence = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((others + 0.5) / (len(kinds) - n_toxic + 1))
    held = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in halves[1]], "of long"))
    scored = docs.join(held, F.col("id") == F.col("of"), "left_semi").mapInArrow(_scored(Model(ratios, evidence, np.inf), apart=True), "id long, text string, score double, evidence double")
    found = [(s, e, halves[1][i]) for i, s, e in scored.select("id", "score", "evidence").collect()]
    most = -best_cutoff([(-e, int(kind != TOXIC)) for _, e, kind in found]) if n_toxic and any(kind == TOXIC for *_, kind in found) else np.inf
    return Model(ratios, evidence, most), best_cutoff([(s, int(kind == GOOD)) for s, e, kind in found if e <= most])


def best_cutoff(scored: list[tuple[float, int]]) -> float:
    """The middle between the neighbours where the mean of both classes' accuracies is best."""
    scored = sorted(scored)
    good, bad = sum(q for _, q in scored), sum(1 - q for _, q in scored)
    if not good or not bad:
        return scored[0][0] - 1.0 if scored else -1.0
    best, at, kept_good, gone_bad = 0.0, scored[0][0] - 1.0, good, 0
    for (score, quality), (after, _) in zip(scored, [*scored[1:], (scored[-1][0] + 1.0, 0)]):
        kept_good, gone_bad = kept_good - quality, gone_bad + 1 - quality
        # a good document lost weighs twice
        value = 2 * kept_good / good + gone_bad / bad
        if value > best and after > score:
            best, at = value, (score + after) / 2
    return at if best > 2.0 else scored[0][0] - 1.0


def gumbel(key: Column, seed: int = SEED) -> Column:
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return -F.log(-F.log((F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)))


def _floor(rows: DataFrame, at: float, k: int | None) -> float:
    """The least rank key that stays, of rows(score, rank_key)."""
    if k is None:
        k = rows.where(F.col("score") >= at).count()
    least = kth_smallest(rows.select((-F.col("rank_key")).alias("x")), "x", k)
    if least is None:
        # k is over the number of rows, or nothing stays
        return float("-inf") if k > 0 else float("inf")
    return -least


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED, k: int | None = None) -> tuple[DataFrame, Model, float]:
    """(id, score, rank_key, keep) of every row; the model; the least rank key kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    model, at = fit(texts, labels, limit)
    rows = texts.mapInArrow(_scored(model), "id long, text string, score double").select("id", "score")
    rows = cut(rows.withColumn("rank_key", F.col("score") + gumbel(F.col("id"))))
    floor = _floor(rows, at, k)
    return rows.withColumn("keep", F.col("rank_key") >= floor), model, floor


def op5_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows, _, _ = resample(docs, labels)
    return rows.select(F.col("id").alias("doc_id"), "score", "rank_key", "keep")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the resampling keeps; texts are scored once, and travel with their score."""
    model, at = fit(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), table(spark, sf_dir, "labels"))
    packed = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"))
    schema = f"id long, text string, rest {packed.schema['rest'].dataType.simpleString()}, score double"
    rows = cut(packed.mapInArrow(_scored(model), schema).withColumn("rank_key", F.col("score") + gumbel(F.col("id"))))
    rows = rows.where(F.col("rank_key") >= _floor(rows, at, None))
    return rows.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns])
