"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams and itself, hashed into buckets, each
with a vector. A word's vector is the mean of its bag, a window's the mean of its
words; a linear softmax over two classes scores the window, and a document takes
the smooth maximum of its windows. Unseen spellings share n-gram vectors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.row_types import with_id

BUCKET_BITS, GRAMS, WINDOW, SMOOTH = 18, (3, 4, 5), 12, 4.0
#: Labelled documents that training sees at most, of class 0 and of class 1, by the order of a hash of the id, one text an id, and the bytes of their texts at most: a bounded sample.
TRAIN_DOCS, TRAIN_BYTES = (1600, 800), (1 << 24, 1 << 23)
#: Bytes of text held in arrays at once (some 150 bytes of memory each); longer texts are scored a part at a time.
BATCH_BYTES = 1 << 18
#: Rows given back at once.
BATCH_ROWS = 1024
#: ASCII letters and digits stay, other ASCII becomes a space; bytes of other characters stay.
KEPT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


@dataclass
class Bags:
    """Features of some texts: bucket and word of each, words of each window, windows of each text."""

    bucket: np.ndarray
    word: np.ndarray
    n_words: int
    window_words: np.ndarray  # word of each place in a window
    window: np.ndarray  # window of each such place
    n_windows: int
    window_text: np.ndarray
    n_texts: int
    whole: np.ndarray  # hash of each word

    def distinct(self) -> "Bags":
        """The same with each different word's features once."""
        _, first, of = np.unique(self.whole, return_index=True, return_inverse=True)
        keep = np.zeros(self.n_words, bool)
        keep[first] = True
        own = keep[self.word]
        return Bags(self.bucket[own], of[self.word[own]], len(first), of[self.window_words], self.window, self.n_windows, self.window_text, self.n_texts, self.whole[first])


def cleaned(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(KEPT)


def bags(texts: list[bytes]) -> Bags:
    data = np.frombuffer(b"  ".join([b"", *texts, b""]), np.uint8)
    inner = data != 32
    start = np.flatnonzero(inner[1:] & ~inner[:-1]) + 1
    end = np.flatnonzero(inner[:-1] & ~inner[1:]) + 1
    word_at = np.cumsum(np.concatenate([[False], inner[1:] & ~inner[:-1]])) - 1  # word of each byte inside one
    wide = data.astype(np.uint64) + np.uint64(1)
    buckets, words = [], []
    with np.errstate(over="ignore"):
        mark = wide.copy()
        clear = np.ones(len(data), bool)  # no space strictly inside the n-gram that starts here
        for n in range(2, max(GRAMS) + 1):
            mark = mark[: len(data) - n + 1] * _BASE + wide[n - 1 :]
            if n > 2:
                clear = clear[: len(data) - n + 1] & inner[n - 2 : len(data) - 1]
            else:
                clear = clear[: len(data) - 1]
            if n in GRAMS:
                at = np.flatnonzero(clear)
                buckets.append((mark[at] * _BASE) >> np.uint64(64 - BUCKET_BITS))
                words.append(word_at[at + 1])
        power = np.full(len(data) + 1, _BASE, np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        inverse = np.full(len(data) + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
        inverse[0] = 1
        inverse = np.cumprod(inverse)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wide * power[:-1])])
        whole = (sums[end] - sums[start]) * inverse[start]
        buckets.append((whole * _BASE) >> np.uint64(64 - BUCKET_BITS))
        words.append(np.arange(len(start)))
    sizes = np.array([len(t) + 2 for t in texts])
    text_of_word = np.searchsorted(np.cumsum(sizes), start - 1, "right") if len(texts) else np.zeros(0, np.int64)
    per_text = np.bincount(text_of_word, minlength=len(texts))
    first = np.cumsum(per_text) - per_text
    n_win = np.maximum(1, -(-per_text // WINDOW))
    win_text = np.repeat(np.arange(len(texts)), n_win)
    number = np.arange(len(win_text)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    begin = np.maximum(0, np.minimum(number * WINDOW, per_text[win_text] - WINDOW))  # the last window reaches back
    size = np.minimum(WINDOW, per_text[win_text])
    window = np.repeat(np.arange(len(win_text)), size)
    place = np.arange(len(window)) - np.repeat(np.cumsum(size) - size, size)
    window_words = first[win_text[window]] + begin[window] + place
    return Bags(np.concatenate(buckets).astype(np.int64), np.concatenate(words), len(start), window_words, window, len(win_text), win_text, len(texts), whole)


def gathered(texts: list[bytes]) -> Bags:
    """The bags of many texts, made a part at a time; features of each different word are kept once, in small integers."""
    buckets, words, spots, windows, of_text, known = [], [], [], [], [], np.zeros(0, np.uint64)
    number = np.zeros(0, np.int64)  # of each known hash, both in the hashes' order
    n_windows = n_texts = 0
    part: list[bytes] = []
    for i, text in enumerate(texts):
        part.append(text)
        if sum(map(len, part)) < BATCH_BYTES and i + 1 < len(texts):
            continue
        b = bags(part).distinct()
        fresh = ~np.isin(b.whole, known)
        ids = np.zeros(b.n_words, np.int64)
        ids[~fresh] = number[np.searchsorted(known, b.whole[~fresh])]
        ids[fresh] = len(known) + np.arange(fresh.sum())
        own = fresh[b.word]
        buckets.append(b.bucket[own].astype(np.int32))
        words.append(ids[b.word[own]].astype(np.int32))
        spots.append(ids[b.window_words].astype(np.int32))
        windows.append((b.window + n_windows).astype(np.int32))
        of_text.append((b.window_text + n_texts).astype(np.int32))
        n_windows, n_texts = n_windows + b.n_windows, n_texts + b.n_texts
        known, number = np.concatenate([known, b.whole[fresh]]), np.concatenate([number, ids[fresh]])
        order = np.argsort(known)
        known, number = known[order], number[order]
        part = []
    return Bags(np.concatenate(buckets), np.concatenate(words), len(known), np.concatenate(spots), np.concatenate(windows), n_windows, np.concatenate(of_text), n_texts, known)


def _mean(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(group, values, n) / np.maximum(1, np.bincount(group, minlength=n))


def _pooled(logit: np.ndarray, b: Bags) -> tuple[np.ndarray, np.ndarray]:
    """Smooth maximum over each text's windows, and each window's part in its gradient."""
    top = np.full(b.n_texts, -np.inf)
    np.maximum.at(top, b.window_text, logit)
    weight = np.exp(SMOOTH * (logit - top[b.window_text]))
    total = np.bincount(b.window_text, weight, b.n_texts)
    n = np.bincount(b.window_text, minlength=b.n_texts)
    return top + np.log(total / n) / SMOOTH, weight / total[b.window_text]


@dataclass
class Model:
    """What scoring needs: each bucket's part in the difference of the two classes' logits, and the bias."""

    bucket: np.ndarray
    bias: float

    def pooled(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's smooth maximum, and how many windows it is of."""
        b = bags(texts)
        word = _mean(self.bucket[b.bucket], b.word, b.n_words)
        logit = _mean(word[b.window_words], b.window, b.n_windows) + self.bias
        return _pooled(logit, b)[0], np.bincount(b.window_text, minlength=b.n_texts)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return _probability(self.pooled(texts)[0])

    def long_score(self, text: bytes) -> float:
        """The score of a text of any length, its windows taken some at a time."""
        words, tops, sizes = (m[0] for m in re.finditer(rb"[^ ]+", text)), [], []
        part, ahead = _take(words), None
        while part:
            ahead = _take(words)
            if ahead and len(ahead) < WINDOW:  # the last window reaches back over a whole one
                part, ahead = part + ahead, []
            top, n = self.pooled([b" ".join(part)])
            tops.append(top[0])
            sizes.append(n[0])
            part = ahead
        if not tops:
            return float(self.scores([b""])[0])
        tops, sizes = np.array(tops), np.array(sizes)
        high = tops.max()
        return float(_probability(high + np.log((sizes * np.exp(SMOOTH * (tops - high))).sum() / sizes.sum()) / SMOOTH))


def _probability(logit: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _take(words: Iterator[bytes]) -> list[bytes]:
    """The next words: a multiple of the window in number, unless they end."""
    part: list[bytes] = []
    size = 0
    while size < BATCH_BYTES and (some := list(islice(words, WINDOW))):
        part += some
        size += sum(map(len, some))
    return part


def train(texts: list[bytes], labels: np.ndarray, *, size: int = 8, rounds: int = 70, rate: float = 3.0, decay: float = 1e-6, seed: int = 42) -> Model:
    """Bucket vectors and softmax weights, learned together by full-batch normalised gradient steps with momentum. Without both classes the model is its prior alone."""
    y = np.asarray(labels, float)
    prior = (y.sum() + 0.5) / (len(y) + 2)
    bias = float(np.log(prior / (1 - prior)))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BUCKET_BITS), bias)
    b = gathered(texts)
    here = np.zeros(1 << BUCKET_BITS, bool)
    here[b.bucket] = True
    used = np.flatnonzero(here)
    local = (np.cumsum(here) - 1).astype(np.int32)[b.bucket]
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (len(used), size)), rng.normal(0, 1, (size, 2)), np.array([-bias / 2, bias / 2])]
    moments = [np.zeros_like(p) for p in params]
    per_word, per_window = np.maximum(1, np.bincount(b.word, minlength=b.n_words)), np.maximum(1, np.bincount(b.window, minlength=b.n_windows))
    for step in range(1, rounds + 1):
        vectors, weights, offset = params
        lean = weights[:, 1] - weights[:, 0]  # of two classes, the softmax is the logistic of the logits' difference
        word = np.bincount(b.word, (vectors @ lean)[local], b.n_words) / per_word
        logit = np.bincount(b.window, word[b.window_words], b.n_windows) / per_window + offset[1] - offset[0]
        pooled, part = _pooled(logit, b)
        wrong = (1 / (1 + np.exp(-np.clip(pooled, -500, 500))) - y) / len(y)
        at_window = wrong[b.window_text] * part
        at_word = np.bincount(b.window_words, (at_window / per_window)[b.window], b.n_words) / per_word
        at_bucket = np.bincount(local, at_word[b.word], len(used))
        pull = vectors.T @ at_bucket
        grads = [np.outer(at_bucket, lean) + decay * vectors, np.stack([-pull, pull], 1), np.array([-1.0, 1.0]) * wrong.sum()]
        # Steps of one length for each array as a whole, so that a rare bucket doesn't move as fast as a telling one.
        for p, g, m in zip(params, grads, moments, strict=True):
            m += 0.2 * (g / (np.sqrt((g * g).sum()) + 1e-12) - m)
            p -= rate * (1 - step / (rounds + 1)) * m
    vectors, weights, offset = params
    bucket = np.zeros(1 << BUCKET_BITS)
    bucket[used] = vectors @ (weights[:, 1] - weights[:, 0])
    return Model(bucket, float(offset[1] - offset[0]))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: tuple[int, int] = TRAIN_DOCS, most_bytes: tuple[int, int] = TRAIN_BYTES) -> Model:
    """A model from labelled documents whose crc32(id as text) mod 5 isn't 0; ``most`` of each class.

    Null labels and ids are left out; an id labelled both ways counts as 1. Of
    several texts of an id the smallest is taken, so repeated rows change nothing.
    The texts of a class are taken by the order of a hash of the id as long as they
    fit ``most_bytes`` together; one that doesn't is passed over.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1) AND crc32(cast(_id AS string)) % 5 != 0")
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    some = [known.where(f"_y = {y}").orderBy(F.xxhash64("_id"), "_id").limit(most[y]) for y in (0, 1)]
    chosen = some[0].unionByName(some[1])  # of a bounded number of rows: small enough to broadcast
    texts = docs.select(F.col(f"`{id_col}`").alias("_d"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
    texts = texts.where(F.octet_length("_t") <= max(most_bytes)).join(F.broadcast(chosen), F.col("_d") == F.col("_id")).groupBy("_d", "_y").agg(F.min("_t").alias("_t"))
    order = Window.partitionBy("_y").orderBy(F.xxhash64("_d"), "_d").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as were chosen
    rows = texts.withColumn("_sum", F.sum(F.octet_length("_t")).over(order)).where(F.expr(f"_sum <= CASE WHEN _y = 0 THEN {most_bytes[0]}L ELSE {most_bytes[1]}L END")).select("_d", "_y", "_t").collect()
    rows.sort(key=lambda r: (str(r[0]), r[1]))
    marks = np.array([r[1] for r in rows])
    return train([cleaned(r[2]) for r in rows], marks)


def toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``(id, held_out, score, predicted)`` of every row, by its whole text, and with ``with_text`` that too.

    Null and empty texts get the score of a window without words. Rows that repeat
    get the same score each; a null id is never held out. Of a long text some windows
    are held at a time. Other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.bucket.astype(np.float32), model.bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(at, BATCH_ROWS)
                texts = b.column(1)
                out: list[np.ndarray] = []
                part, size = [], 0
                for i in range(b.num_rows):
                    text = cleaned(texts[i].as_py())
                    alone = len(text) > BATCH_BYTES
                    if part and (alone or size >= BATCH_BYTES):
                        out.append(own.scores(part))
                        part, size = [], 0
                    if alone:
                        out.append(np.array([own.long_score(text)]))
                    else:
                        part.append(text)
                        size += len(text)
                if part:
                    out.append(own.scores(part))
                score = pa.array(np.concatenate(out) if out else np.zeros(0))
                yield pa.RecordBatch.from_arrays([b.column(0), score, *([texts] if with_text else [])], names=[id_col, "score", *([text_col] if with_text else [])])

    scored = docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(score, with_id(docs, id_col, f"score double, `{text_col}` string" if with_text else "score double"))
    return scored.select(f"`{id_col}`", *([f"`{text_col}`"] if with_text else []), F.expr(f"coalesce(crc32(cast(`{id_col}` AS string)) % 5 = 0, false)").alias("held_out"), "score", F.expr("cast(score >= 0.5 AS int)").alias("predicted"))
