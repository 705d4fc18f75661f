"""Toxicity by bags of subwords: character n-gram vectors, averaged, into a linear softmax.

Every word stands between two marks and is the mean of the vectors of its character n-grams, so a misspelling that was
never seen shares most of its vector with the word it comes from. A stretch of words is the mean of its words, and a
linear softmax over that mean gives the chance of label 1. Vectors and softmax are trained jointly in numpy on a bounded
sample of labelled texts. A text is cut into stretches of equal size and scores as its most toxic one, so a short insult counts in a
long text as well; training takes the same stretch of each text.

With trained weights a word's share in the log odds is a number, so scoring a text needs one number per n-gram bucket.
No row meets another: scoring moves no text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialise

#: Shortest and longest n-grams, marks included.
GRAMS = (3, 5)
#: Buckets of the n-gram hash (a power of two) and numbers in a vector.
BUCKET_BITS = 17
SIZE = 8
#: Words of a stretch, at most.
STRETCH = 12
#: Bound on the learning sample: texts of labels 0 and 1, and characters of a text that may be among them.
SAMPLE_TEXTS = (3000, 1500)
SAMPLE_CHARS = 4000
#: Passes over the sample, step size, and pull of all vectors to zero.
PASSES, RATE, DECAY = 60, 0.3, 5e-5
#: Code points scored at once.
SPAN = 1 << 20

_MARK = 0x20
#: Characters that end a word, besides all up to the space.
_ENDS = '.,;:!?"()[]{}|<>/\\   　…“”«»'
_TABLE = np.arange(0x3100, dtype=np.uint32)
_TABLE[: _MARK + 1] = _MARK
_TABLE[[ord(c) for c in _ENDS]] = _MARK
_STEP, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """Share in the log odds of each n-gram bucket, and the log odds of a text without words."""

    shares: np.ndarray
    bias: float


def code_points(text: str) -> np.ndarray:
    """Lower case code points, every character that ends a word as a mark, with a mark at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = points < len(_TABLE)
    points = np.where(known, _TABLE[np.where(known, points, 0)], points)
    return np.concatenate([[_MARK], points, [_MARK]]).astype(np.uint32)


def subwords(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each n-gram, the number of its word and its bucket; also how many words there are.

    An n-gram may begin and end with a mark but holds none inside.
    """
    mark = points == _MARK
    word = np.cumsum(mark[:-1] & ~mark[1:])  # of the character after each place
    words = int(word[-1]) if len(word) else 0
    marks = np.concatenate([[0], np.cumsum(mark)])
    values = points.astype(np.uint64)
    numbers, buckets = [], []
    total, factor = np.zeros(len(points), np.uint64), np.ones(1, np.uint64)
    for n in range(1, GRAMS[1] + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        total = total[:m] + factor * values[n - 1 :]
        factor = factor * _STEP
        if n >= GRAMS[0]:
            inside = np.flatnonzero(marks[n - 1 : n - 1 + m] == marks[1 : 1 + m])
            numbers.append(word[inside] - 1)
            mixed = (total[inside] + np.uint64(n)) * _MIX
            buckets.append((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *numbers]), np.concatenate([none, *buckets]), words


def stretches_of(words: int) -> np.ndarray:
    """Number of the stretch of each word; stretches are as equal as can be."""
    return np.arange(words) * -(-words // STRETCH) // max(words, 1)


def _spans(points: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts that end at a mark where there is one in reach; parts share that mark."""
    at = 0
    while len(points) - at > SPAN:
        marks = np.flatnonzero(points[at + SPAN // 2 : at + SPAN] == _MARK)
        end = at + SPAN // 2 + int(marks[-1]) if len(marks) else at + SPAN - 1
        yield points[at : end + 1]
        at = end
    yield points[at:]


def log_odds(model: Model, text: str | None) -> float:
    """Of the most toxic stretch of a whole text; a text without words has the bias."""
    best = None
    for part in _spans(code_points(text or "")):
        number, bucket, words = subwords(part)
        if not words:
            continue
        of_word = np.bincount(number, model.shares[bucket], words) / np.maximum(np.bincount(number, minlength=words), 1)
        stretch = stretches_of(words)
        most = float((np.bincount(stretch, of_word) / np.bincount(stretch)).max())
        best = most if best is None else max(best, most)
    return model.bias + (best or 0.0)


def chance(odds: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(odds, -50, 50))))


class _Sums:
    """Sums by group of the rows that ``index`` picks from a table, for many passes over the same groups."""

    def __init__(self, groups: np.ndarray, index: np.ndarray, n: int):
        order = np.argsort(groups, kind="stable")
        ordered = groups[order]
        self.index, self.starts = index[order], np.flatnonzero(np.diff(ordered, prepend=-1))
        self.present, self.n = ordered[self.starts], n

    def __call__(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, table.shape[1]), table.dtype)
        if len(self.starts):
            for j in range(table.shape[1]):
                out[self.present, j] = np.add.reduceat(table[:, j][self.index], self.starts)
        return out


class _Adam:
    def __init__(self, shape: tuple[int, ...]):
        self.first, self.second, self.t = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0

    def __call__(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.first += np.float32(0.1) * (gradient - self.first)
        self.second += np.float32(0.001) * (gradient**2 - self.second)
        size = np.sqrt(self.second / (1 - 0.999**self.t)) + 1e-9
        return (RATE * self.first / (1 - 0.9**self.t) / size).astype(np.float32)


def train(texts: list[str], labels: list[int], weights: list[float]) -> Model:
    """Vectors and softmax together, by Adam over the whole sample; the same sample gives the same model."""
    shares = np.zeros(1 << BUCKET_BITS, np.float32)
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return Model(shares, 0.0 if not len(y) else 50.0 * (2 * int(y[0]) - 1))
    known: dict[str, int] = {}
    tokens, stretch, first = [], [], [0]
    for text in texts:
        points = code_points(text)
        found = points.tobytes().decode("utf-32-le", "surrogatepass").split(" ")
        found = [known.setdefault(w, len(known)) for w in found if w] or [known.setdefault("", len(known))]
        tokens.append(np.array(found))
        stretch.append(stretches_of(len(found)) + first[-1])
        first.append(int(stretch[-1][-1]) + 1)
    token, of_stretch, starts = np.concatenate(tokens), np.concatenate(stretch), np.array(first[:-1])
    # All different words in one string; only the empty one, of a text without words, has no n-grams.
    listed = np.array([number for word, number in known.items() if word], np.int64)
    number, bucket, _ = subwords(np.frombuffer(f" {' '.join(w for w in known if w)} ".encode("utf-32-le", "surrogatepass"), np.uint32))
    number, (used, gram) = listed[number], np.unique(bucket, return_inverse=True)
    by_word, by_gram = _Sums(number, gram, len(known)), _Sums(gram, number, len(used))
    by_stretch = _Sums(of_stretch, token, first[-1])
    grams = np.maximum(np.bincount(number, minlength=len(known)), 1).astype(np.float32)[:, None]
    sizes = np.bincount(of_stretch).astype(np.float32)[:, None]
    weight = (np.array(weights) / np.sum(weights)).astype(np.float32)[:, None]

    rng = np.random.default_rng(0)
    vectors = rng.normal(0, 0.1, (len(used), SIZE)).astype(np.float32)
    softmax, bias = rng.normal(0, 0.5, (SIZE, 2)).astype(np.float32), np.zeros(2, np.float32)
    steps = _Adam(vectors.shape), _Adam(softmax.shape), _Adam(bias.shape)
    target = np.eye(2, dtype=np.float32)[y]
    counts = np.diff(np.append(starts, first[-1]))
    for _ in range(PASSES):
        of_words = by_word(vectors) / grams
        mean = by_stretch(of_words) / sizes
        odds = mean @ (softmax[:, 1] - softmax[:, 0])
        most = np.maximum.reduceat(odds, starts)
        at_most = np.flatnonzero(odds == np.repeat(most, counts))
        doc = np.repeat(np.arange(len(y)), counts)[at_most]
        chosen = at_most[np.unique(doc, return_index=True)[1]]
        logits = mean[chosen] @ softmax + bias
        odd = np.exp(logits - logits.max(1, keepdims=True))
        error = (odd / odd.sum(1, keepdims=True) - target) * weight
        back = np.zeros_like(mean)
        back[chosen] = error @ softmax.T / sizes[chosen]
        place = np.zeros(len(sizes), bool)
        place[chosen] = True
        live = np.flatnonzero(place[of_stretch])
        on_words = np.stack([np.bincount(token[live], back[of_stretch[live], j], len(known)) for j in range(SIZE)], 1).astype(np.float32) / grams
        vectors -= steps[0](by_gram(on_words) + DECAY * vectors)
        softmax -= steps[1](mean[chosen].T @ error + DECAY * softmax)
        bias -= steps[2](error.sum(0))
    shares[used] = vectors @ (softmax[:, 1] - softmax[:, 0])
    return Model(shares, float(bias[1] - bias[0]))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, label), of which a bounded sample is read.

    The sample holds, for each label, up to SAMPLE_TEXTS different texts of at most SAMPLE_CHARS characters, those with the
    least hashes, so copies count once; each label weighs as many different texts as it has. Texts stay where they are but for
    the sample's. Rows with a null doc_id or text and labels other than 0 and 1 are left out; a text with both labels may be
    drawn for both. With one label only, all texts get that label; without rows every score is 0.5.
    """
    texts = docs.filter(F.length("text") <= SAMPLE_CHARS).select("doc_id", F.xxhash64("text").alias("h"), "text")
    named = labels.filter(F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("label"))
    hashes = materialise(texts.drop("text").join(named, "doc_id").groupBy("label", "h").agg(F.min("doc_id").alias("doc_id")), "label-hashes")
    sample, labels_, weights = [], [], []
    for label in (0, 1):
        own = hashes.filter(F.col("label") == label)
        drawn = F.broadcast(own.orderBy("h").limit(SAMPLE_TEXTS[label]).select("doc_id", "h"))  # the limit is the sample's bound
        found = [r["text"] for r in texts.join(drawn, ["doc_id", "h"]).groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect()]
        sample += found
        labels_ += [label] * len(found)
        weights += [own.count() / max(len(found), 1)] * len(found)
    return train(sample, labels_, weights)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``score``, the chance of label 1 for each whole text.

    Map-only; the model is BUCKETS small numbers. Null texts, empty ones and those without words score by the bias alone. Long texts are
    scored a part at a time and long words are cut only where a part ends. Repeated rows are scored each; an empty table
    gives no rows. Columns of any other names may be there; they are not read.
    """
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [chance(log_odds(model, value.as_py())) for value in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.float64())], [*keep, "score"])

    return docs.select(*keep, docs[text].alias("_text")).mapInArrow(run, f"{fields}score double")
