"""Language-model scores by context-tree weighting, beside a unigram base score.

The model. A text is the bytes of its UTF-8 form and one end byte, led by
``depth`` bytes of padding; both are 255, which no UTF-8 text holds. Each byte
is decomposed into eight binary decisions; the decision at bit k, given the
bits before it, has a node for each context of 0 to ``depth`` preceding bytes.
A node's Krichevsky-Trofimov estimate P_e has counts of zeros and ones from all
training texts; the weighted probability is P_w = P_e / 2 + (product of the
children's P_w) / 2, and P_w = P_e at the deepest level. A decision is then
predicted by the mixture of all depths' KT predictions, depth d having the
posterior weight that the tree ends there; the share that passes below the
deepest context seen predicts one half.

The depth is the same at every size, and no table of grams is held whole. Every
task adds up the (depth + 1)-byte grams of its texts, a shuffle adds those up:
what is gathered follows the corpus. Nodes of all depths are sums over grams.
Grams are dealt by the last ``TOP + 1`` bytes of their context, so all nodes of
longer contexts are made where their grams lie, in pieces of at most 2^24 + 2^19
grams. First their weights are added up to the nodes of ``TOP`` bytes and fewer,
of which there are at most 256^TOP * 256 a bit whatever the corpus (about a
hundredth of that in text): these go to the driver, which weights them, and back.
Then every gram of the corpus gets its score beside its piece's nodes.

Scoring. The grams and words that occur most often, at most ``frequent`` of
them, are held by the tasks; all others are joined with the tables by a shuffle
and summed per document. Thus no vocabulary and no model needs to fit in
memory, and nothing that is frequent meets in the join.

Defined cases: null text is empty: one token, the end; documents with a null id
are in no fold, so they train; repeated rows are scored alike; an empty table
gives an empty result; with no training text N and V are 0; texts of over
``PIECE`` bytes are taken in pieces; a NUL is a byte like any other; columns
beside id and text are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, fold, partitions, stage, text_batches

DEPTH = 5
#: Grams of contexts that differ in their last TOP + 1 bytes never share a piece's nodes.
TOP = 2
FREQUENT_WORDS, FREQUENT_GRAMS = 150_000, 1_500_000
#: Bytes of text that are taken at once: their grams need some forty times as much.
PIECE = 4 << 20
#: No word holds this byte, which is a word's end, so it can stand for the token that ends a text.
END = b"\n"
_EDGE = b"\xff"
_LN2 = math.log(2.0)


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text but its first ``depth``, the gram of it and the ``depth`` bytes before it; where each text's grams end."""
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = max(len(flat) - depth, 0)
    out = np.zeros(n, dtype=np.int64)
    for j in range(depth + 1):
        out <<= 8
        out |= flat[j : j + n]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    # the grams that begin in one text and end in the next one's first bytes are left out
    begins = np.cumsum(sizes)[:-1]
    keep = np.ones(n, dtype=bool)
    for j in range(1, depth + 1):
        keep[begins - j] = False
    return out[keep], np.cumsum(sizes - depth)


def pieces(texts: list[bytes], depth: int, size: int = PIECE) -> Iterator[tuple[list[int], list[bytes]]]:
    """The texts between padding and end in lots of about ``size`` bytes: which text each piece is of, and the piece led by the ``depth`` bytes before it."""
    of, held, n = [], [], 0
    for i, t in enumerate(texts):
        whole = _EDGE * depth + t + _EDGE
        for a in range(0, len(whole) - depth, size):
            own = whole[a : a + size + depth]
            of.append(i), held.append(own)
            n += len(own)
            if n >= size:
                yield of, held
                of, held, n = [], [], 0
    if of:
        yield of, held


def tally(keys: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """Distinct keys with the sums of their counts, or with how often each occurs."""
    codes, distinct = pd.factorize(keys)
    return [distinct, *(np.bincount(codes, weights=c, minlength=len(distinct)).astype(np.int64) for c in counts or [None])]


_LGAMMA = np.array([math.lgamma(x) for x in np.arange(0, 200) / 2 + 0.5])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma at positive multiples of one half."""
    small = x < 100
    y = np.where(small, 100.0, x)
    big = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3)
    return np.where(small, _LGAMMA[np.clip(np.rint(2 * x - 1), 0, 199).astype(np.int64)], big)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the KT probability of a sequence with these counts."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - math.log(math.pi)


def node_keys(gram: np.ndarray, depth: int, bit: int) -> np.ndarray:
    """The node that decides ``bit`` in the context of the last ``depth`` bytes: that context, then the bits before it."""
    return (gram & ((1 << 8 * (depth + 1)) - 1)) >> (8 - bit)


def _sums(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, ascending, and the sums of each of ``values`` over equal keys."""
    if not len(keys):
        return [keys, *values]
    if not (keys[1:] >= keys[:-1]).all():
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], tuple(v[order] for v in values)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[first], *(np.add.reduceat(v, first) for v in values)]


class Nodes:
    """The nodes of one bit at depths ``least`` to ``most``, from sums at the deepest.

    ``below`` has, after the keys and counts, the sum of ln P_w of each deepest
    node's children; it is None where the tree ends there.
    """

    def __init__(self, bit: int, least: int, most: int, keys: np.ndarray, n: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> None:
        self.least = least
        #: By depth from ``most``: keys, probability of a one by KT, share of the posterior that ends here.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for d in range(most, least - 1, -1):
            if d < most:
                keys, n, n1, below = _sums(keys & ((1 << 8 * d + bit) - 1), n, n1, weighted)  # noqa: F821
            own = log_kt(n - n1, n1)
            if below is None:
                weighted, ends = own, np.ones(len(keys))
            else:
                weighted = np.logaddexp(own, below) - _LN2
                ends = np.exp(own - _LN2 - weighted)
            self.levels.append((keys, (n1 + 0.5) / (n + 1.0), ends))
        self.top = keys, n, n1, weighted

    def settle(self, bit: int, above: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By depth from ``least``: keys, the mixture's mass up to and with this depth, and the share that passes below.

        ``above`` is the same of the depth over ``least``; None at the root.
        """
        out = []
        for d, (keys, one, ends) in enumerate(self.levels[::-1], self.least):
            mass, rest = np.zeros(len(keys)), np.ones(len(keys))
            if above is not None:
                at = np.searchsorted(above[0], keys & ((1 << 8 * (d - 1) + bit) - 1))
                mass, rest = above[1][at], above[2][at]
            above = keys, mass + rest * ends * one, rest * (1 - ends)
            out.append(above)
        return out


class Upper:
    """The nodes of contexts of up to ``top`` bytes, settled."""

    def __init__(self, depth: int, sums: dict[int, tuple[np.ndarray, ...]]) -> None:
        """``sums`` has for each bit the ascending nodes of ``top`` bytes: keys, counts, counts of ones, and the sum of ln P_w of their children."""
        self.depth, self.top = depth, min(TOP, depth - 1)
        none = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0)
        self.bits = [Nodes(k, 0, self.top, *sums.get(k, none)).settle(k, None) for k in range(8)]


def _deepest(keys: np.ndarray, counts: np.ndarray, depth: int, bit: int) -> Nodes:
    """The nodes below ``TOP`` of ascending grams and their counts."""
    node, n, n1 = _sums(node_keys(keys, depth, bit), counts, counts * (keys >> (7 - bit) & 1))
    return Nodes(bit, min(TOP, depth - 1) + 1, depth, node, n, n1, None)


def top_sums(keys: np.ndarray, counts: np.ndarray, depth: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each bit, what these grams add to the nodes of ``TOP`` bytes."""
    out = {}
    for k in range(8):
        node, n, n1, weighted = _deepest(keys, counts, depth, k).top
        out[k] = tuple(_sums(node & ((1 << 8 * min(TOP, depth - 1) + k) - 1), n, n1, weighted))
    return out


def gram_scores(upper: Upper, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 of each ascending gram's last byte given the others; counts of 0 are grams that no training text has."""
    total, seen = np.zeros(len(keys)), counts > 0
    known, known_counts = keys[seen], counts[seen].astype(float)
    for k in range(8):
        lower = _deepest(known, known_counts, upper.depth, k).settle(k, upper.bits[k][-1])
        p, todo = np.full(len(keys), 0.5), np.arange(len(keys))
        for d, (node, mass, rest) in reversed(list(enumerate([*upper.bits[k], *lower]))):
            if not len(node) or not len(todo):
                continue
            want = node_keys(keys[todo], d, k)
            at = np.minimum(np.searchsorted(node, want), len(node) - 1)
            hit = node[at] == want
            p[todo[hit]] = (mass + rest / 2)[at[hit]]
            todo = todo[~hit]
        total += np.log10(np.where(keys >> (7 - k) & 1 == 1, p, 1 - p))
    return total


def gather(docs: DataFrame, train: Column, *, depth: int = DEPTH, text_col: str = "text") -> DataFrame:
    """Rows (word, gram, n, m), one per word or gram: how often it occurs in training texts, and in all."""
    text_batches(docs.sparkSession)
    names = ["word", "gram", "n", "m"]

    def run(batches):
        words: tuple[Counter[bytes], Counter[bytes]] = Counter(), Counter()
        held: list[list[np.ndarray]] = []

        def word_rows():
            own = list(words[0] | words[1])
            n, rest = ([x[w] for w in own] for x in words)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.nulls(len(own), pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(n, np.int64) + np.array(rest, np.int64))], names=names)
            words[0].clear(), words[1].clear()

        def merge():
            held[:] = [tally(*(np.concatenate([x[i] for x in held]) for i in range(3)))]

        def gram_rows():
            merge()
            keys, n, m = held.pop()
            yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.binary()), pa.array(keys), pa.array(n), pa.array(m)], names=names)

        for b in batches:
            texts, teaches = as_bytes(b.column(0)), b.column(1).to_pylist()
            for t, own in zip(texts, teaches):
                count = words[not own]
                count.update(t.lower().split())
                count[END] += 1
            for own in (True, False):
                for _, lot in pieces([t for t, x in zip(texts, teaches) if x == own], depth):
                    keys, m = tally(grams(lot, depth)[0])
                    held.append([keys, m if own else np.zeros(len(m), np.int64), m])
                    if sum(len(x[0]) for x in held) > 1_000_000:
                        merge()
                        if len(held[0][0]) > 700_000:
                            yield from gram_rows()
            if len(words[0]) + len(words[1]) > 400_000:
                yield from word_rows()
        if words[0] or words[1]:
            yield from word_rows()
        if held:
            yield from gram_rows()

    found = docs.select(F.col(text_col).alias("text"), train.alias("train")).mapInArrow(run, "word binary, gram long, n long, m long")
    return found.groupBy("word", "gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _in_pieces(batches, depth: int, size: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Grams dealt and sorted by the last bytes of their context, in pieces of whole such groups: (ascending grams, n, m)."""
    keep = (1 << 8 * (min(TOP, depth - 1) + 1)) - 1
    held: list[list[np.ndarray]] = []

    def ranked(x):
        order = np.argsort(x[0])
        return x[0][order], x[1][order], x[2][order]

    for b in batches:
        held.append([c.to_numpy() for c in b.columns])
        if sum(len(x[0]) for x in held) < size:
            continue
        whole = [np.concatenate([x[i] for x in held]) for i in range(3)]
        group = whole[0] >> 8 & keep
        cut = int(np.flatnonzero(group != group[-1])[-1]) + 1 if (group != group[-1]).any() else 0
        held = [[x[cut:] for x in whole]]
        if cut:
            yield ranked([x[:cut] for x in whole])
    if held:
        yield ranked([np.concatenate([x[i] for x in held]) for i in range(3)])


def _dealt(found: DataFrame, depth: int) -> DataFrame:
    """Rows (gram, n, m), each group of ``_in_pieces`` in one partition."""
    group = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * (min(TOP, depth - 1) + 1)) - 1))
    rows = found.select("gram", "n", "m", group.alias("g"))
    return rows.repartition(partitions(found.sparkSession), "g").sortWithinPartitions("g").select("gram", "n", "m")


def fit(found: DataFrame, *, depth: int = DEPTH) -> Upper:
    """The upper nodes of the gathered grams (gram, n, m)."""
    text_batches(found.sparkSession, 100_000)

    def run(batches):
        for keys, n, _ in _in_pieces(batches, depth):
            for k, own in top_sums(keys, n.astype(float), depth).items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own[0]), k, np.int32)), *map(pa.array, own)], names=["bit", "node", "n", "n1", "below"])

    rows = _dealt(found.where("n > 0"), depth).mapInArrow(run, "bit int, node long, n double, n1 double, below double")
    # at most 256^TOP contexts with 255 decisions each
    sums = rows.groupBy("bit", "node").agg(*(F.sum(c).alias(c) for c in ("n", "n1", "below"))).toArrow()
    bit, *rest = (c.to_numpy() for c in sums.columns)
    out = {}
    for k in range(8):
        own = [x[bit == k] for x in rest]
        order = np.argsort(own[0])
        out[k] = tuple(x[order] for x in own)
    return Upper(depth, out)


def scored_grams(found: DataFrame, upper: Upper) -> DataFrame:
    """Rows (gram, m, log): every gathered gram with the log10 of its last byte given the others."""
    spark = found.sparkSession
    held = spark.sparkContext.broadcast(upper)  # at most 256^TOP contexts with 255 decisions each

    def run(batches):
        for keys, n, m in _in_pieces(batches, held.value.depth):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(m), pa.array(gram_scores(held.value, keys, n))], names=["gram", "m", "log"])

    text_batches(spark, 100_000)
    return stage(_dealt(found, upper.depth).mapInArrow(run, "gram long, m long, log double"), "grams")


def _most(rows: DataFrame, most: int) -> DataFrame | None:
    """The rows with the greatest ``m``, at most ``most`` of them, from a histogram of it by powers of the fourth root of two."""
    size = F.floor(F.log2("m") * 4)
    floor, had = None, 0
    for r in rows.groupBy(size.alias("s")).count().orderBy(F.desc("s")).collect():
        if had + r["count"] > most:
            break
        had, floor = had + r["count"], r["s"]
    return None if floor is None else rows.where(size >= floor)


def score(docs: DataFrame, train: Column, *, depth: int = DEPTH, frequent_words: int = FREQUENT_WORDS, frequent_grams: int = FREQUENT_GRAMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, n_known, train_tokens, base_score, score), one per document; ``train`` says which rows teach."""
    spark = docs.sparkSession
    counts = stage(gather(docs, train, depth=depth, text_col=text_col), "counts")
    found = counts.where("gram is not null").select("gram", "n", "m")
    known = scored_grams(found, fit(found, depth=depth))
    words = counts.where("word is not null").select("word", "n", "m")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    # log10 of n + 1; null for words that no training text has
    worth = F.when(F.col("n") > 0, F.log10(F.col("n") + 1))
    top_words, top_grams = _most(words, frequent_words), _most(known, frequent_grams)
    common = dict(zip(*(c.to_pylist() for c in top_words.select("word", worth).toArrow().columns))) if top_words is not None else {}
    keys, logs = (c.to_numpy() for c in top_grams.select("gram", "log").toArrow().columns) if top_grams is not None else (np.zeros(0, np.int64), np.zeros(0))
    order = np.argsort(keys)
    held = spark.sparkContext.broadcast((common, keys[order], logs[order]))  # at most ``frequent_words`` and ``frequent_grams``
    text_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["row", "is_first", "id", "n_tokens", "known", "logs", "score", "tail_words", "tail_grams"]

    def run(batches):
        common, keys, logs = held.value
        next_id = TaskContext.get().partitionId() << 40
        unknown = object()

        def lists(parts, kind):
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            flat = np.concatenate(parts) if kind == pa.int64() else [w for x in parts for w in x]
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))

        for b in batches:
            texts = as_bytes(b.column(1))
            first = 0
            n_tokens, n_known, base, tails = [], [], [], []
            for t in texts:
                tokens = t.lower().split()
                tokens.append(END)
                vals = [common.get(w, unknown) for w in tokens]
                rare = [w for w, v in zip(tokens, vals) if v is unknown]
                vals = [v for v in vals if v is not unknown and v is not None] if rare or None in vals else vals
                n_tokens.append(len(tokens)), n_known.append(len(vals)), base.append(math.fsum(vals)), tails.append(rare)
            done = set()
            for of, lot in pieces(texts, depth):
                gram, ends = grams(lot, depth)
                codes, distinct = pd.factorize(gram)
                rank = np.argsort(distinct)
                at = np.minimum(np.searchsorted(keys, distinct[rank]), max(len(keys) - 1, 0))
                hit = keys[at] == distinct[rank] if len(keys) else np.zeros(len(rank), bool)
                value = np.full(len(distinct), np.nan)
                value[rank[hit]] = logs[at[hit]]
                value = value[codes]
                rare = np.isnan(value)
                begins = np.concatenate([[0], ends[:-1]])
                sums = np.add.reduceat(np.where(rare, 0.0, value), begins)
                is_first = [i not in done for i in of]
                done.update(of)
                # a text's first piece has what holds for the whole text
                mine = lambda values, none: [values[i] if x else none for i, x in zip(of, is_first)]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([
                    pa.array(next_id + np.array(of)), pa.array(is_first), b.column(0).take(pa.array(of)), pa.array(mine(n_tokens, 0), pa.int64()), pa.array(mine(n_known, 0), pa.int64()), pa.array(mine(base, 0.0), pa.float64()), pa.array(sums),
                    lists(mine(tails, []), pa.binary()), lists([gram[a:z][rare[a:z]] for a, z in zip(begins, ends)], pa.int64()),
                ], names=names)
            next_id += len(texts)

    schema = f"row long, is_first boolean, id {kind}, n_tokens long, known long, logs double, score double, tail_words array<binary>, tail_grams array<long>"
    rows = stage(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema), "scored")
    zero = F.lit(0.0)
    more = (
        rows.select("row", F.explode("tail_words").alias("word")).join(words.where("n > 0"), "word")
        .groupBy("row").agg(F.count("*").alias("more_known"), F.sum(worth).alias("more_logs"))
    )
    rest = rows.where("not is_first").select("row", F.col("score").alias("log"))
    rest = rows.select("row", F.explode("tail_grams").alias("gram")).join(known.select("gram", "log"), "gram").select("row", "log").union(rest)
    rest = rest.groupBy("row").agg(F.sum("log").alias("more_score"))
    norm = math.log10(total + distinct + 1)
    out = rows.where("is_first").drop("tail_words", "tail_grams").join(more, "row", "left").join(rest, "row", "left")
    return out.select(
        "id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", zero) - F.col("n_tokens") * norm).alias("base_score"), (F.col("score") + F.coalesce("more_score", zero)).alias("score"),
    )


def op10_ctw(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, ~fold(docs, 7, 2))
    return out.withColumnRenamed("id", "doc_id").select("doc_id", fold(docs, 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
