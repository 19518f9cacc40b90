"""Quality rules as weak supervision.

Every rule looks at one statistic of a text and votes good, bad, or abstains.
Documents with one pattern of votes are alike to the model, so the whole table
is reduced to a count per pattern (at most 3^rules of them, whatever the input)
by a map-side aggregation, and expectation-maximisation runs on those counts.
The hidden class is good or bad in the way that one of the rules looks for. EM
estimates how many documents are of each class, how often each rule casts each
vote on good documents, and how often on those that are bad in its own way; on
documents that are bad in another way a rule votes as on all. That gives each
rule's accuracy, and a document's posterior of being good, which replaces
passing all rules: a rule that votes bad on documents that are good otherwise
loses its say.

Where a table of labels is given, at most ``LABELLED`` documents of each label
are used, the first by a hash of their ids. Half of them teach the one rule that
has a vocabulary, abuse: words whose odds of standing in toxic documents are
high in any language. The other half hold EM to their labels, with the weight
of as many documents as there are without one. All documents are measured and
counted; without labels that rule abstains and EM has votes alone.

Defined cases: null or wordless text has zero counts, and only the length rule
votes; repeated rows are judged alike; very long texts are measured whole; a
posterior of just ``least`` is kept; labels with null or unknown ids teach
nothing, ids labelled twice count twice; an empty table gives an empty result;
columns named ``_q`` or ``_q_*`` are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, read_if_there, stage, text_batches

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Labelled documents that teach, of each label.
LABELLED = 4000
#: Of a word of abuse: the least number of toxic documents that have it, and its least weight (the logarithm of how many times likelier it is there); of a document, the least sum of its words' weights.
LEAST_SEEN, LEAST_WEIGHT, LEAST_SUM = 3, 2.5, 6.0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marks", "n_shouts", "n_lines", "n_bytes", "n_packed", "n_abuse")
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_STRIP = b".,;:!?\"'()"


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


_IS_SYMBOL, _IS_SHOUT = _table(SYMBOLS), _table(b"!")
_IS_UPPER = _table(bytes(range(65, 91)))
_IS_LETTER = _table(bytes([*range(65, 91), *range(97, 123)]))
#: Signs and digits: whatever is neither space, letter, nor part of a character beyond ASCII.
_IS_MARK = ~_SPACE & ~_IS_LETTER & (np.arange(256) < 128)


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """How many words stand in a window of ``width`` words that the text holds twice or more."""
    windows = list(zip(*(words[j:] for j in range(width))))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    again = np.fromiter((seen[w] > 1 for w in windows), dtype=bool, count=len(windows))
    covered = np.zeros(len(words), dtype=bool)
    for j in range(width):
        covered[j : j + len(windows)] |= again
    return int(covered.sum())


def terms(text: bytes) -> set[bytes]:
    """The distinct words of a text, without case and marks around them."""
    return {w.strip(_STRIP) for w in set(text.lower().split())}


def measure(texts: list[bytes], lexicon: dict[bytes, float]) -> dict[str, np.ndarray]:
    """The counts of ``COUNTS`` for each text; n_abuse is a thousand times the sum of weights of ``lexicon``."""
    n = len(texts)
    out = {k: np.zeros(n, dtype=np.int64) for k in COUNTS}
    for i, t in enumerate(texts):
        words = t.split()
        out["n_words"][i] = len(words)
        out["n_repeat_words"][i] = repeat_words(words)
        lines = [x for x in t.split(b"\n") if x.strip()]
        out["n_lines"][i], out["n_dup_lines"][i] = len(lines), len(lines) - len(set(lines))
        out["n_bytes"][i], out["n_packed"][i] = len(t), len(zlib.compress(t, 1))
        if lexicon:
            out["n_abuse"][i] = round(1000 * math.fsum(lexicon[w] for w in terms(t) & lexicon.keys()))
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]

    def per_text(mask: np.ndarray) -> np.ndarray:
        up = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return up[ends] - up[begins]

    out["word_chars"] = per_text(((flat & 0xC0) != 0x80) & ~_SPACE[flat])
    for name, table in (("n_symbols", _IS_SYMBOL), ("n_upper", _IS_UPPER), ("n_letters", _IS_LETTER), ("n_marks", _IS_MARK), ("n_shouts", _IS_SHOUT)):
        out[name] = per_text(table[flat])
    return out


def _vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """0 abstain, 1 good, 2 bad."""
    return np.where(bad, 2, np.where(good, 1, 0)).astype(np.int64)


def votes(m: dict[str, np.ndarray]) -> list[np.ndarray]:
    """One array of votes for each rule."""
    n = m["n_words"]
    per_word = lambda k: m[k] / np.maximum(n, 1)
    upper = m["n_upper"] / np.maximum(m["n_letters"], 1)
    lines = m["n_dup_lines"] / np.maximum(m["n_lines"], 1)
    marks = m["n_marks"] / np.maximum(m["word_chars"], 1)
    packed = m["n_packed"] / np.maximum(m["n_bytes"], 1)
    length, symbols, repeats, shouts = (per_word(k) for k in ("word_chars", "n_symbols", "n_repeat_words", "n_shouts"))
    some = n >= 20
    return [
        _vote(n >= 100, n < 20),
        _vote(some & (symbols < 0.05), symbols > 0.25),
        _vote(some & (length >= 3) & (length <= 10), some & ((length < 2.2) | (length > 16))),
        _vote((m["n_lines"] > 3) & (lines < 0.1), (m["n_lines"] > 3) & (lines > 0.4)),
        _vote(some & (repeats < 0.2), some & (repeats > 0.45)),
        _vote(some & (marks < 0.15), some & (marks > 0.4)),
        _vote((m["n_letters"] > 20) & (upper < 0.2), (m["n_letters"] > 20) & (upper > 0.5)),
        _vote(some & (shouts < 0.05), some & (shouts > 0.3)),
        _vote((m["n_bytes"] >= 200) & (packed > 0.3) & (packed < 0.75), (m["n_bytes"] >= 200) & ((packed < 0.15) | (packed > 0.9))),
        _vote(np.zeros(len(n), dtype=bool), m["n_abuse"] >= 1000 * LEAST_SUM),
    ]


N_RULES = 10
#: No rule is taken to be infallible: good documents have this share of all documents' votes beside their own.
DOUBT = 0.1


def fit(patterns: np.ndarray, counts: np.ndarray, known: np.ndarray | None = None, rounds: int = 200, weight: float = 4.0) -> np.ndarray:
    """The posterior of good for each pattern (rows of votes 0, 1, 2).

    ``counts`` are the documents of each pattern, ``known`` (good, bad) those
    labelled, whose classes are held to. ``weight`` pseudo-counts of a rule
    that is mostly right keep the classes' names and the estimates of rules
    that hardly vote. The start is what labels say, or else the sum of votes,
    each the heavier the rarer it is.
    """
    rules, bad = patterns.shape[1], patterns == 2
    hit = np.stack([patterns == v for v in range(3)]).astype(float)  # vote, pattern, rule

    def rates(mass: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """How often each rule casts each vote; ``mass`` by pattern, or by pattern and rule."""
        seen = np.einsum("vpr,pr->vr", hit, np.broadcast_to(mass.reshape(len(patterns), -1), patterns.shape)) + prior
        return seen / seen.sum(0)

    def prior(*votes: float) -> np.ndarray:
        return weight * np.array(votes)[:, None]

    usual = rates(counts, prior(0.4, 0.4, 0.2))
    score = ((patterns == 1) * -np.log(usual[1]) - bad * -np.log(usual[2])).sum(1)
    good = 1 / (1 + np.exp(-score))
    held = known * (counts.sum() / known.sum()) if known is not None and known.sum() else np.zeros((len(patterns), 2))
    total = counts.sum() + held.sum()
    good = np.where(held.sum(1) > 0, held[:, 0] / np.maximum(held.sum(1), 1e-300), good)
    kinds = np.where(bad.any(1)[:, None], bad / np.maximum(bad.sum(1), 1)[:, None], 1 / rules)
    for _ in range(rounds):
        fine = good * counts + held[:, 0]
        poor = kinds * ((1 - good) * counts + held[:, 1])[:, None]
        shares = np.concatenate([[fine.sum()], poor.sum(0)]) + weight / (rules + 1)
        usually = np.log(usual[patterns, np.arange(rules)])
        own = np.log(rates(poor, prior(0.1, 0.1, 0.8))[patterns, np.arange(rules)])
        as_good = np.log(rates(fine, prior(0.5, 0.4, 0.1) + DOUBT * total * usual)[patterns, np.arange(rules)]).sum(1)
        logs = np.concatenate([as_good[:, None], usually.sum(1)[:, None] - usually + own], axis=1) + np.log(shares / shares.sum())
        post = np.exp(logs - logs.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        settled = np.abs(post[:, 0] - good).max(initial=0) < 1e-9
        good, kinds = post[:, 0], post[:, 1:] / np.maximum(post[:, 1:].sum(1), 1e-300)[:, None]
        if settled:
            break
    return good


def labelled(labels: DataFrame, most: int = LABELLED, id_col: str = "doc_id") -> DataFrame:
    """Rows (_q_id, toxic, bad, half): at most ``most`` documents of each label, the first by a hash of their ids."""
    rows = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_q_id"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"), (F.coalesce("quality", F.lit(1)) == 0).alias("poor"))
    rows = rows.select("_q_id", "toxic", (F.col("toxic") | F.col("poor")).alias("bad"))
    order = F.xxhash64("_q_id")
    kinds = [rows.where(F.col("toxic")), rows.where(F.col("bad") & ~F.col("toxic")), rows.where(~F.col("bad"))]
    found = kinds[0].orderBy(order).limit(most)
    for k in kinds[1:]:
        found = found.union(k.orderBy(order).limit(most))
    return found.withColumn("half", F.pmod(F.crc32(F.col("_q_id").cast("string").cast("binary")), F.lit(2)))


def abuse(docs: DataFrame, sample: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> dict[bytes, float]:
    """The words of abuse with their weights, from the texts of the ``sample``'s first half."""
    text_batches(docs.sparkSession)
    few = F.broadcast(sample.where("half = 0").select("_q_id", "toxic"))  # at most 3 * ``LABELLED`` rows
    texts = docs.select(F.col(id_col).alias("_q_id"), F.col(text_col).alias("text")).join(few, "_q_id").select("text", "toxic")

    def run(batches):
        for b in batches:
            for text, toxic in zip(as_bytes(b.column(0)), b.column(1).to_pylist()):
                own = list(terms(text))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([int(toxic)] * len(own), pa.int64())], names=["word", "toxic"])

    seen = texts.mapInArrow(run, "word binary, toxic long").groupBy("word").agg(F.sum("toxic").alias("n"), F.sum(1 - F.col("toxic")).alias("others"))
    of = texts.agg(F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0)), F.count("*")).first()
    found = {}
    # words of the sample's toxic documents: bounded as the sample is
    for word, n, others in seen.where(F.col("n") >= LEAST_SEEN).collect():
        weight = math.log((n + 0.5) / (of[0] + 1)) - math.log((others + 0.5) / (of[1] - of[0] + 1))
        if weight >= LEAST_WEIGHT and word:
            found[bytes(word)] = weight
    return found


def rate(docs: DataFrame, labels: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, least: float = 0.5, most: int = LABELLED) -> DataFrame:
    """``docs`` with _q (a struct of COUNTS and pattern), _q_quality (the posterior), _q_failed and _q_kept.

    With ``keep_text`` texts are measured twice, for the counts of patterns and
    for the verdicts, so that no copy of them is written; without it, the
    measures are staged and read twice.
    """
    spark = docs.sparkSession
    docs = docs.drop(*(c for c in docs.columns if c == "_q" or c.startswith("_q_")))
    sample = stage(labelled(labels, most), "labelled") if labels is not None else None
    lexicon = abuse(docs, sample, id_col=id_col, text_col=text_col) if sample is not None else {}
    text_batches(spark)
    schema = "struct<" + ",".join(f"{k}:bigint" for k in COUNTS) + ",pattern:bigint>"

    @F.arrow_udf(schema)
    def judge(text: pa.Array) -> pa.Array:
        m = measure(as_bytes(text), lexicon)
        v = votes(m)
        code = sum((x * 3**j for j, x in enumerate(v)), np.zeros(len(text), dtype=np.int64))
        return pa.StructArray.from_arrays([pa.array(m[k]) for k in COUNTS] + [pa.array(code)], names=[*COUNTS, "pattern"])

    rows = docs.withColumn("_q", judge(text_col))
    rows = rows if keep_text else stage(rows.drop(text_col), "quality")
    ask = sample.where("half = 1").select(F.col("_q_id").alias(id_col), "bad", "toxic") if sample is not None else None
    counted = rows.select(F.col("_q.pattern").alias("p"), id_col)
    # at most 3 * ``LABELLED`` rows; ids labelled twice must not count documents twice
    by_kind = counted.join(F.broadcast(ask.groupBy(id_col).agg(F.collect_list(F.struct("bad", "toxic")).alias("kinds"))), id_col, "left") if ask is not None else counted.withColumn("kinds", F.lit(None))
    by_kind = by_kind.groupBy("p", "kinds").count().collect()
    seen: dict[int, int] = {}
    for r in by_kind:
        seen[r["p"]] = seen.get(r["p"], 0) + r["count"]
    codes = np.array(sorted(seen), dtype=np.int64)
    patterns = codes[:, None] // 3 ** np.arange(N_RULES) % 3
    known = np.zeros((len(codes), 2))
    if sample is not None:
        # a sampled document stands for as many as its label has beyond the sample
        poor = F.coalesce("quality", F.lit(1)) == 0
        toxic = F.coalesce("toxic", F.lit(0)) == 1
        all_ = {(r[0], r[1]): r[2] for r in labels.groupBy((toxic | poor).alias("b"), toxic.alias("t")).count().collect()}
        drawn = {(r[0], r[1]): r[2] for r in sample.where("half = 1").groupBy("bad", "toxic").count().collect()}
        place = {int(c): i for i, c in enumerate(codes)}
        for r in by_kind:
            for k in r["kinds"] or []:
                known[place[r["p"]], int(k["bad"])] += r["count"] * all_[k["bad"], k["toxic"]] / drawn[k["bad"], k["toxic"]]
    good = fit(patterns, np.array([seen[c] for c in codes.tolist()], dtype=float), known) if seen else np.zeros(0)
    table = spark.createDataFrame([(int(c), float(g)) for c, g in zip(codes, good)], "_q_code long, _q_quality double")
    failed = (F.col("_q.n_words") < 50) | (100 * F.col("_q.n_repeat_words") > 50 * F.col("_q.n_words"))
    # at most 3^rules rows
    out = rows.join(F.broadcast(table), rows["_q.pattern"] == F.col("_q_code")).drop("_q_code")
    return out.withColumns({"_q_failed": failed, "_q_kept": ~failed & (F.col("_q_quality") >= least)})


def filter_quality(docs: DataFrame, labels: DataFrame | None = None, **options) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    return rate(docs, labels, **options).where("_q_kept").select(*docs.columns)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    own = [F.col(f"_q.{k}").alias(k) for k in COUNTS[:5]]
    found = rate(docs, read_if_there(spark, f"{sf_dir}/labels.parquet"), keep_text=False)
    return found.select("doc_id", *own, F.col("_q_failed").alias("base_failed"), F.col("_q_kept").alias("kept"), F.col("_q_quality").alias("quality"))
