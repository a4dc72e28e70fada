"""Toxicity (6): multiple-instance learning. Sentence scores join by noisy-or and learn from labels of documents."""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, fresh, spread, table

#: Labelled documents to learn from at most; hashed features; a feature of fewer documents is ignored; words remembered.
SAMPLE, DIMS, LEAST_DOCS, WORDS = 5000, 1 << 19, 4, 200_000
#: Bytes of a text to learn from at most (of a longer one, sentences drawn by their digests); words remembered while learning.
MOST, KNOWN = 64_000, 150_000
#: One in so many labelled documents says where the bias should be; shifts that are tried.
HELD, SHIFTS = 4, np.arange(-40, 41) / 10
#: What a toxic document counts in the loss beside a clean one; there are few of them.
GAIN = 1.5
SENTENCE = regex.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
THRESHOLD = 0.3


def features(word: str) -> list[int]:
    """Slots of a word: itself and its first four and five letters, in lower case, without punctuation at its ends."""
    w = word.lower().strip(".,;:!?\"'()[]{}*#&$%-_")
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % DIMS for f in (w, w[:4] + "*", w[:5] + "*")] if len(w) > 2 else []


class Slots(dict):
    """Slots of a word, remembered for the first KNOWN words."""

    def __missing__(self, word: str) -> array:
        got = array("i", features(word))
        if len(self) < KNOWN:
            self[word] = got
        return got


def train(texts: list[str], toxic: np.ndarray, rounds: int = 60, rate: float = 0.15, decay: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of the sentence score, by Adam on the loss of the noisy-or of each document."""
    slots_of, every, sizes, doc = Slots(), array("i"), [], []
    n, bad = np.zeros(DIMS, np.int64), np.zeros(DIMS, np.int64)
    for d, (text, y) in enumerate(zip(texts, toxic, strict=True)):
        whole: set[int] = set()
        for s in SENTENCE.findall(text):
            own: set[int] = set().union(*map(slots_of.__getitem__, s.split()))
            every.extend(own)
            whole |= own
            sizes.append(len(own))
            doc.append(d)
        own_slots = np.fromiter(whole, np.int64, len(whole))
        n[own_slots] += 1
        bad[own_slots] += int(y > 0)
    used = np.flatnonzero(n >= LEAST_DOCS)
    index = np.full(DIMS, -1, np.int32)
    index[used] = np.arange(len(used))
    slots = index[np.frombuffer(every, np.int32)]
    sent = np.repeat(np.arange(len(doc), dtype=np.int32), sizes)[slots >= 0]
    slots, doc = slots[slots >= 0], np.array(doc, np.int32)
    del every, slots_of, sizes
    w, b = np.append(log_odds(bad[used], n[used], float((toxic > 0).sum()), len(texts)), 0.0), -7.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for k in range(1, rounds + 1):
        z = np.bincount(sent, w[slots], len(doc)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(texts)))
        step = np.where(toxic > 0, -GAIN * clean / np.maximum(1 - clean, 1e-6), 1.0)[doc] * p / max(1, len(texts))
        g = np.append(np.bincount(slots, step[sent], len(w)) + decay * w, step.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        d = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        # words only speak for toxicity: a long clean sentence does not outweigh an offence in it
        w, b = np.maximum(w - d[:-1], 0), b - d[-1]
    out = np.zeros(DIMS, np.float32)
    out[used] = w[:-1]
    return out, float(b)


def log_odds(bad: np.ndarray, n: np.ndarray, toxic: float, total: int) -> np.ndarray:
    """A start for the weights: smoothed log odds of features far likelier in toxic documents than chance allows, else 0."""
    rate = max(toxic, 1e-9) / max(total, 1)
    far = bad - n * rate > 3 * np.sqrt(n * rate * (1 - rate) + 0.1)
    return np.where(far, np.log((bad + 0.5) / (n - bad + 0.5) * (1 - rate) / rate), 0.0)


class Weights(dict):
    """Slots of a word that weigh anything, remembered: a sentence's logit is the sum over its distinct slots, as in training."""

    def __init__(self, w: np.ndarray, bias: float):
        self.w, self.bias = w, bias

    def __missing__(self, word: str) -> tuple[int, ...]:
        got = tuple(i for i in features(word) if self.w[i])
        if len(self) < WORDS:
            self[word] = got
        return got

    def logit(self, sentence: str) -> float:
        return float(sum(self.w[i] for i in set().union(*map(self.__getitem__, set(sentence.split()))))) + self.bias


def noisy_or(z: np.ndarray) -> tuple[np.ndarray, float]:
    """Scores of sentences and of their document: one less the chance that no sentence is toxic."""
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return p, float(-np.expm1(np.log1p(-p).sum()))


def score(text: str, weights: Weights) -> tuple[float, list[dict]]:
    """The document's score and the sentences at or over THRESHOLD."""
    spans, z, at = [], [], 0
    for s in SENTENCE.findall(text):
        z.append(weights.logit(s))
        spans.append((at, len(s)))
        at += len(s)
    if not z:
        return 0.0, []
    p, whole = noisy_or(np.array(z))
    bad = [{"start": spans[i][0], "length": spans[i][1], "score": float(p[i])} for i in np.flatnonzero(p >= THRESHOLD)]
    return whole, bad


def excerpt(text: str, most: int = MOST) -> str:
    """A text of up to `most` bytes as it is; of a longer one the sentences of the least digests that fit, in their order."""
    if len(text.encode()) <= most:
        return text
    own = [(zlib.crc32(s.encode()), i, s) for i, s in enumerate(SENTENCE.findall(text))]
    kept, size = [], 0
    for _, i, s in sorted(own):
        size += len(s.encode())
        if size > most:
            break
        kept.append((i, s))
    return "".join(s for _, s in sorted(kept))


def shift(texts: list[str], toxic: np.ndarray, weights: Weights) -> float:
    """What to add to the bias so that documents not learned from get the best F1 at THRESHOLD; of equal shifts the one nearest to 0."""
    logits = [np.array([weights.logit(s) for s in SENTENCE.findall(t)]) for t in texts]

    def f1(d: float) -> float:
        said = np.array([len(z) > 0 and noisy_or(z + d)[1] >= THRESHOLD for z in logits])
        return 2 * (said & (toxic > 0)).sum() / max(1, said.sum() + (toxic > 0).sum())

    return float(min(SHIFTS, key=lambda d: (-f1(d), abs(d)))) if (toxic > 0).any() else 0.0


def learn(texts: list[str], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights from all texts; the bias is trained and then moved by what one in HELD of them, left out of a first training, asks for."""
    held = np.arange(len(texts)) % HELD == 0
    pick = lambda on: ([texts[i] for i in np.flatnonzero(on)], toxic[on])
    moved = shift(*pick(held), Weights(*train(*pick(~held)))) if held.any() and not held.all() else 0.0
    w, b = train(texts, toxic)
    return w, b + moved


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Learn from `sample` labelled documents at most, the least by a hash of the id, none of them held out; of a text over MOST bytes an excerpt."""

    def cut_long(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([excerpt(t.as_py()) for t in b.column("text")], pa.string()), b.column("toxic")], ["text", "toxic"])

    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(~held_out())
    picked = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = doc_rows(docs).join(F.broadcast(picked), "doc_id").select("text", "toxic").mapInArrow(cut_long, "text string, toxic int").toArrow()
    order = np.lexsort((np.arange(rows.num_rows), [zlib.crc32(t.as_py().encode()) for t in rows["text"]])) if rows.num_rows else []
    return learn([rows["text"][int(i)].as_py() for i in order], rows["toxic"].to_numpy()[order] if rows.num_rows else np.empty(0))


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, offending (start, length in characters, score), one row per input row.

    Scores read the whole text and nothing else. A null or empty text has no sentence and scores 0. Texts of any length are
    scored whole and learned from, long ones by an excerpt. A null id is not held out. Labels that are null are ignored, of repeated ones the largest counts. Without labels every score is near 0.
    """
    w, bias = fit(docs, labels, sample)

    def run(batches):
        fresh()
        weights = Weights(w, bias)
        for b in batches:
            out = [score(t.as_py(), weights) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], kind)], ["doc_id", "score", "offending"])

    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))
    scored = spread(docs.sparkSession, doc_rows(docs)).mapInArrow(run, "doc_id long, score double, offending array<struct<start: int, length: int, score: double>>")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, that score under THRESHOLD."""
    w, bias = fit(docs, labels, sample)

    def run(batches):
        fresh()
        weights = Weights(w, bias)
        for b in batches:
            yield b.filter(pa.array([score(t.as_py() or "", weights)[0] < THRESHOLD for t in b.column("text")], pa.bool_()))

    return spread(docs.sparkSession, docs).mapInArrow(run, docs.schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("offending")
