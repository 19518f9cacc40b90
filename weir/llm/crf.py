"""Language identification by a linear-chain conditional random field.

A text's words (runs of letters) are labelled one by one. A word's emission
score for a language is the sum of the weights of its features: affixes (its
n-grams at a boundary), inner character n-grams of one to four letters, and
the word itself as a lexicon entry; transitions between labels are learned.
Forward-backward gives each word's posterior over languages, so a text that
switches languages is labelled piece by piece; the text's language is the one
with the greatest sum of posteriors, its score their mean.

Training takes at most ``docs_per_language`` labelled documents of each
language, those with the smallest hash of their id and text, cuts their words
into sequences, and splices half of the sequences from two documents so that
switches are seen. The objective is the conditional log-likelihood, climbed by
Adam over expected counts. Features are hashed, so the model's size is
``3 * BUCKETS`` weights for each language and can be broadcast.

Emissions are computed once for each distinct word of a batch. Long texts are
cut into blocks whose transfer matrices are multiplied to give exact messages
at the cuts, so the chain of a text of any length is summed in vector steps.

Defined cases: text null or without a letter: ``und``, score 0; no labelled
rows: everything is ``und``, score 0; runs of over ``LONGEST`` letters count as
several words; labelled texts of any length teach, short ones filled up from
others; of languages with one sum the first in order of bytes is taken; repeated
rows are labelled alike; very long texts are labelled whole; a column ``_lang``
is replaced; empty table: empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, text_batches

LONGEST = 24
WORD = re.compile(r"[^\W\d_]{1,%d}" % LONGEST)
BUCKETS = 1 << 16
NONE = "und"
SPAN = 48
BLOCK = 1024
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """The text's words in lower case; what has no letter is left out."""
    found = WORD.findall(text.lower())
    return found if all(map(str.isalpha, found)) else [w for w in found if any(map(str.isalpha, w))]


def features(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index of the word, bucket), one for each feature of each distinct word."""
    n = len(words)
    letters = np.zeros((n, LONGEST + 2), dtype=np.uint64)
    text = np.array(words.tolist(), dtype=f"U{LONGEST}").view(np.uint32).reshape(n, LONGEST) if n else np.zeros((0, LONGEST), np.uint32)
    letters[:, 1:-1] = text
    size = (text != 0).sum(1)
    letters[:, 0] = 94
    letters[np.arange(n), size + 1] = 36
    size = size + 2
    rows, buckets = [], []
    rolled = np.zeros_like(letters)
    for width in range(1, 5):
        rolled = rolled * np.uint64(1_000_003) + np.pad(letters[:, width - 1 :], ((0, 0), (0, width - 1)))
        mixed = (rolled + np.uint64(width)) * _MIX >> np.uint64(48)
        for at in range(LONGEST + 3 - width):
            has = np.flatnonzero(size >= at + width)
            if not len(has):
                break
            rows.append(has)
            affix = (at == 0) | (size[has] == at + width)
            buckets.append((mixed[has, at] + np.where(affix, np.uint64(BUCKETS), np.uint64(0))).astype(np.int64))
    whole = np.zeros(n, dtype=np.uint64)
    for at in range(LONGEST):
        whole = (whole + letters[:, at + 1]) * _MIX
        whole ^= whole >> np.uint64(29)
    rows.append(np.arange(n))
    buckets.append((2 * BUCKETS + (whole >> np.uint64(48)).astype(np.int64)))
    row, bucket = np.concatenate(rows), np.concatenate(buckets)
    order = np.argsort(row, kind="stable")
    return row[order], bucket[order]


def emissions(weights: np.ndarray, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, weights.shape[1]), dtype=np.float32)
    if len(row):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[first]] = np.add.reduceat(weights[bucket], first, axis=0)
    return out


def _soft(e: np.ndarray) -> np.ndarray:
    """Emissions as positive factors, the greatest of each word 1."""
    return np.exp(np.maximum(e - e.max(axis=-1, keepdims=True), -60.0))


def forward_backward(e: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences of one length, factors e (sequence, word, label): posteriors, expected transitions, log of the normaliser."""
    s, n, k = e.shape
    alpha, scale = np.empty_like(e), np.empty((s, n))
    now = start * e[:, 0]
    for t in range(n):
        if t:
            now = now @ step * e[:, t]
        scale[:, t] = now.sum(1)
        now = now / scale[:, t, None]
        alpha[:, t] = now
    post, pairs, back = np.empty_like(e), np.zeros((k, k)), np.ones((s, k))
    for t in range(n - 1, -1, -1):
        post[:, t] = alpha[:, t] * back
        if t:
            onto = e[:, t] * back / scale[:, t, None]
            pairs += step * (alpha[:, t - 1].T @ onto)
            back = onto @ step.T
    return post, pairs, np.log(scale).sum(1)


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, step: np.ndarray, start: np.ndarray) -> None:
        self.labels, self.weights, self.step, self.start = labels, weights, step, start

    def _chains(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums of word posteriors for each text; e holds the factors of all words, texts after one another."""
        k = len(self.labels)
        begins = np.cumsum(lengths) - lengths
        n_blocks = -(-lengths // BLOCK)
        text_of = np.repeat(np.arange(len(lengths)), n_blocks)
        nth = np.arange(len(text_of)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        at = begins[text_of] + nth * BLOCK
        size = np.minimum(lengths[text_of] - nth * BLOCK, BLOCK)
        into = np.where((nth == 0)[:, None], self.start, 0.0)  # the factor of labels before the block's first word's own
        after = np.ones((len(text_of), k))
        long = np.flatnonzero(n_blocks[text_of] > 1)
        if len(long):
            product = self._products(e, at[long], size[long])
            of = dict(zip(long.tolist(), product))
            for b in long:
                if nth[b]:
                    before = into[b - 1] if nth[b - 1] else self.start
                    # the message out of the block before; its product begins with a factor, not a step
                    m = before @ of[b - 1]
                    into[b] = m / m.sum() @ self.step
            for b in long[::-1]:
                if nth[b] + 1 < n_blocks[text_of[b]]:
                    m = self.step @ (of[b + 1] @ after[b + 1])
                    after[b] = m / m.sum()
        order = np.argsort(-size, kind="stable")
        at, size, into, after, text_of = at[order], size[order], into[order], after[order], text_of[order]
        most = int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(most), side="left")  # how many blocks reach past each word
        kept, now = [], into
        for t in range(most):
            m = live[t]
            now = now[:m] if not t else now[:m] @ self.step
            now = now * e[at[:m] + t]
            now /= now.sum(1, keepdims=True)
            kept.append(now)
        sums, back = np.zeros((len(at), k)), after.copy()
        for t in range(most - 1, -1, -1):
            m = live[t]
            post = kept[t] * back[:m]
            sums[:m] += post / post.sum(1, keepdims=True)
            if t:
                onto = e[at[:m] + t] * back[:m] @ self.step.T
                back[:m] = onto / onto.sum(1, keepdims=True)
        out = np.zeros((len(lengths), k))
        np.add.at(out, text_of, sums)
        return out

    def _products(self, e: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each block the product of its factors and the steps between them, scaled."""
        k = len(self.labels)
        out = np.broadcast_to(np.eye(k), (len(at), k, k)).copy()
        for t in range(int(size.max())):
            on = np.flatnonzero(size > t)
            m = out[on] @ self.step if t else out[on]
            m = m * e[at[on] + t][:, None, :]
            out[on] = m / m.sum(axis=(1, 2), keepdims=True)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """For each text its language and score."""
        words = [words_of(t) if t else [] for t in texts]
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        langs, score = np.full(len(texts), NONE, dtype=object), np.zeros(len(texts))
        has = np.flatnonzero(lengths)
        if len(has) and self.labels:
            codes, distinct = pd.factorize(np.array([w for x in words for w in x], dtype=object))
            e = _soft(emissions(self.weights, *features(distinct), len(distinct)))[codes]
            sums = self._chains(e.astype(np.float64), lengths[has])
            best = sums.argmax(1)
            langs[has] = np.array(self.labels, dtype=object)[best]
            score[has] = np.clip(sums[np.arange(len(has)), best] / lengths[has], 0, 1)
        return langs.tolist(), score


def train(samples: list[tuple[str, str]], *, rounds: int = 60, rate: float = 0.15, decay: float = 1e-6, seed: int = 5) -> Model:
    """A model of (text, language) samples."""
    labels = sorted({y for _, y in samples}, key=str.encode)
    k, rng = len(labels), np.random.default_rng(seed)
    spans: list[tuple[list[str], int]] = []
    for text, y in samples:
        words = words_of(text)
        spans += [(words[i : i + SPAN], labels.index(y)) for i in range(0, len(words), SPAN)]
    if not spans:
        return Model([], np.zeros((3 * BUCKETS, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    # whole sequences: short spans are filled up from other spans, and half of all switch at a random word
    seqs, ys = [], []
    for words, y in spans:
        cut = int(rng.integers(4, SPAN - 4)) if rng.random() < 0.5 else SPAN
        words, tags = words[:cut], [y] * min(cut, len(words))
        while len(words) < SPAN:
            more, z = spans[int(rng.integers(len(spans)))]
            more = more[: SPAN - len(words)]
            words, tags = words + more, tags + [z] * len(more)
        seqs.append(words)
        ys.append(tags)
    codes, distinct = pd.factorize(np.array([w for x in seqs for w in x], dtype=object))
    codes, gold = codes.reshape(-1, SPAN), np.array(ys)
    row, bucket = features(distinct)
    used, bucket = np.unique(bucket, return_inverse=True)
    weights, trans, first = np.zeros((len(used), k)), np.zeros((k, k)), np.zeros(k)
    aim = np.zeros((len(distinct), k))
    np.add.at(aim, (codes.ravel(), gold.ravel()), 1.0)
    pairs = np.zeros((k, k))
    np.add.at(pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1.0)
    starts = np.bincount(gold[:, 0], minlength=k)
    params, n = [weights, trans, first], codes.size
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for r in range(1, rounds + 1):
        e = emissions(weights.astype(np.float32), row, bucket, len(distinct)).astype(np.float64)
        post, seen, _ = forward_backward(_soft(e)[codes], np.exp(trans), np.exp(first))
        miss = aim.copy()
        for y in range(k):
            miss[:, y] -= np.bincount(codes.ravel(), weights=post[..., y].ravel(), minlength=len(distinct))
        grads = [np.stack([np.bincount(bucket, weights=miss[row, y], minlength=len(used)) for y in range(k)], axis=1), pairs - seen, starts - post[:, 0].sum(0)]
        for p, g, a, b in zip(params, grads, m1, m2):
            g = g / n - decay * p
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += rate * (a / (1 - 0.9**r)) / (np.sqrt(b / (1 - 0.99**r)) + 1e-7)
    full = np.zeros((3 * BUCKETS, k), dtype=np.float32)
    full[used] = weights
    return Model(labels, full, np.exp(trans), np.exp(first))


def sample(docs: DataFrame, where: "F.Column", *, docs_per_language: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """At most ``docs_per_language`` labelled texts of each language, by the smallest hash."""
    known = docs.where(where & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("y"), F.col(text_col).alias("t"), F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), F.length(text_col)), 33).alias("h"))
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if not counts:
        return []
    # twice the share that is wanted, so that the sort after it is small
    bound = docs.sparkSession.createDataFrame([(y, float(2.0**31 * min(1.0, 2.0 * docs_per_language / n + 50.0 / n))) for y, n in counts.items()], "y string, most double")
    near = known.join(F.broadcast(bound), "y").where("h < most").select("y", "t", "h").collect()
    out, taken = [], dict.fromkeys(counts, 0)
    for r in sorted(near, key=lambda r: (r["h"], r["y"], r["t"])):
        if taken[r["y"]] < docs_per_language:
            taken[r["y"]] += 1
            out.append((r["t"], r["y"]))
    return out


def identify(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct _lang: lang_pred and score."""
    spark = docs.sparkSession
    text_batches(spark, 1000)
    held = spark.sparkContext.broadcast(model)  # 3 * BUCKETS weights of four bytes for each language: 0.8 MB each

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def run(text: pa.Array) -> pa.Array:
        langs, score = held.value.predict(text.to_pylist())
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

    return docs.withColumn("_lang", run(text_col))


def op2_crf(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = fold(docs, 4, 2)
    model = train(sample(docs, ~held_out))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "_lang.lang_pred", "_lang.score")
