import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd

from weir.llm import quality
from weir.llm.common import read_if_there
from weir.llm.quality import fit, op5_quality, rate


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    c = Counter(wins)
    cover = {i + j for i, w in enumerate(wins) if c[w] > 1 for j in range(3)}
    n, rep = len(words), len(cover)
    return [n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), rep, n < 50 or 100 * rep > 50 * n]


def check(got, texts):
    assert len(got) == len(texts)
    want = Counter(map(str, (brute(t) for t in texts)))
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter(str([*map(int, r[:5]), bool(r[5])]) for r in got[cols].itertuples(index=False)) == want
    assert not (got.base_failed & got.kept).any()


def test_counts(spark, sf, docs):
    check(op5_quality(spark, sf).toPandas(), list(docs.text))


def test_awkward(awkward, nothing, on_table):
    check(on_table(op5_quality, awkward), [r.text for r in awkward.collect()])
    assert rate(nothing).count() == 0
    assert set(awkward.columns) <= set(rate(awkward).columns)


def test_em_finds_accurate_rules():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.7
    acc = [0.95, 0.9, 0.6]
    v = np.stack([np.where(rng.random(4000) < 0.3, 0, np.where((rng.random(4000) < a) == y, 1, 2)) for a in acc], axis=1)
    pats, inv, n = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    good = fit(pats, n.astype(float))[inv.ravel()] > 0.5
    assert (good == y).mean() > 0.88


def brute_votes(text, lexicon):
    t = text or ""
    raw = t.encode()
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    n, chars, symbols, dups, repeats, _ = brute(t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    letters, upper = len(re.findall("[A-Za-z]", t)), len(re.findall("[A-Z]", t))
    marks = len([c for c in t if c < "\x80" and not re.match(r"[A-Za-z\x20\x09-\x0D]", c)])
    packed = len(zlib.compress(raw, 1)) / max(len(raw), 1)
    own = {w.encode().lower().strip(b".,;:!?\"'()") for w in words}
    per, some, many = max(n, 1), n >= 20, len(lines) > 3
    cap, line, mark, shout = upper / max(letters, 1), dups / max(len(lines), 1), marks / max(chars, 1), t.count("!") / per
    vote = lambda good, bad: 2 if bad else 1 if good else 0
    return (
        vote(n >= 100, n < 20), vote(some and symbols / per < 0.05, symbols / per > 0.25), vote(some and 3 <= chars / per <= 10, some and (chars / per < 2.2 or chars / per > 16)),
        vote(many and line < 0.1, many and line > 0.4), vote(some and repeats / per < 0.2, some and repeats / per > 0.45), vote(some and mark < 0.15, some and mark > 0.4),
        vote(letters > 20 and cap < 0.2, letters > 20 and cap > 0.5), vote(some and shout < 0.05, some and shout > 0.3),
        vote(len(raw) >= 200 and 0.3 < packed < 0.75, len(raw) >= 200 and (packed < 0.15 or packed > 0.9)), vote(False, round(1000 * math.fsum(lexicon[w] for w in own & lexicon.keys())) >= 6000),
    )


def brute_posterior(votes, classes, rounds=200, weight=4.0, doubt=0.1):
    """EM document by document in plain loops; ``classes`` has the good and bad weight of each document whose label is held to."""
    rules, n = len(votes[0]), len(votes)
    total = sum(map(sum, classes))
    held = [[x * n / total if total else 0.0 for x in c] for c in classes]

    def rates(rows, prior):
        """For each rule the shares of its votes; rows of (votes, weight by rule)."""
        out = []
        for r in range(rules):
            seen = [weight * p for p in prior]
            for v, w in rows:
                seen[v[r]] += w[r]
            out.append(seen)
        return out

    share = lambda table: [[x / sum(row) for x in row] for row in table]
    usual = share(rates([(v, [1.0] * rules) for v in votes], (0.4, 0.4, 0.2)))
    of = {}
    for v, h in zip(votes, held):
        k, g, b = of.get(v, (0, 0.0, 0.0))
        of[v] = k + 1, g + h[0], b + h[1]
    good, kinds = {}, {}
    for v, (_, g, b) in of.items():
        score = sum(-math.log(usual[r][1]) if x == 1 else math.log(usual[r][2]) if x == 2 else 0.0 for r, x in enumerate(v))
        good[v] = g / (g + b) if g + b else 1 / (1 + math.exp(-score))
        kinds[v] = [(x == 2) / v.count(2) for x in v] if 2 in v else [1 / rules] * rules
    for _ in range(rounds):
        fine = {v: good[v] * k + g for v, (k, g, _) in of.items()}
        poor = {v: [q * ((1 - good[v]) * k + b) for q in kinds[v]] for v, (k, _, b) in of.items()}
        sizes = [sum(fine.values()), *(sum(poor[v][r] for v in of) for r in range(rules))]
        sizes = [x + weight / (rules + 1) for x in sizes]
        as_good = rates([(v, [fine[v]] * rules) for v in of], (0.5, 0.4, 0.1))
        as_good = share([[x + doubt * (n + sum(map(sum, held))) * u for x, u in zip(row, usual[r])] for r, row in enumerate(as_good)])
        own = share(rates([(v, poor[v]) for v in of], (0.1, 0.1, 0.8)))
        gap = 0.0
        for v in of:
            logs = [math.log(sizes[0] / sum(sizes)) + sum(math.log(as_good[r][x]) for r, x in enumerate(v))]
            for c in range(rules):
                logs.append(math.log(sizes[c + 1] / sum(sizes)) + sum(math.log((own if r == c else usual)[r][x]) for r, x in enumerate(v)))
            e = [math.exp(x - max(logs)) for x in logs]
            gap = max(gap, abs(e[0] / sum(e) - good[v]))
            good[v], kinds[v] = e[0] / sum(e), [x / sum(e[1:]) for x in e[1:]]
        if gap < 1e-9:
            break
    return [good[v] for v in votes]


def lexicon_of(docs, labels, most):
    """Words of abuse and the held labels, by plain loops over the rows of pandas tables."""
    text, kinds = dict(zip(docs.doc_id, docs.text)), {}
    for i, q, x in zip(labels.doc_id, labels.quality, labels.toxic):
        kinds.setdefault((bool(x == 1 or q == 0), bool(x == 1)), []).append(i)
    assert all(len(v) <= most for v in kinds.values())
    half = {k: [[i for i in v if zlib.crc32(str(i).encode()) % 2 == h] for h in (0, 1)] for k, v in kinds.items()}
    words = lambda i: {w.strip(b".,;:!?\"'()") for w in (text[i] or "").encode().lower().split()}
    toxic = Counter(w for (_, x), v in half.items() if x for i in v[0] if i in text for w in words(i))
    other = Counter(w for (_, x), v in half.items() if not x for i in v[0] if i in text for w in words(i))
    n = [sum(i in text for (_, x), v in half.items() if x == k for i in v[0]) for k in (True, False)]
    lexicon = {}
    for w, c in toxic.items():
        weight = math.log((c + 0.5) / (n[0] + 1)) - math.log((other[w] + 0.5) / (n[1] + 1))
        if w and c >= 3 and weight >= 2.5:
            lexicon[w] = weight
    held = {i: (bad, len(kinds[bad, x]) / len(v[1])) for (bad, x), v in half.items() for i in v[1]}
    return lexicon, held


def test_kept_against_brute_force(spark, sf):
    got = op5_quality(spark, sf).toPandas().set_index("doc_id").sort_index()
    docs, labels = pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id"), pd.read_parquet(f"{sf}/labels.parquet")
    lexicon, held = lexicon_of(docs, labels, quality.LABELLED)
    votes = [brute_votes(t, lexicon) for t in docs.text]
    classes = [((0.0, held[i][1]) if held[i][0] else (held[i][1], 0.0)) if i in held else (0.0, 0.0) for i in docs.doc_id]
    want = brute_posterior(votes, classes)
    assert np.allclose(got.quality, want, atol=1e-6)
    assert list(got.kept) == [p >= 0.5 and not brute(t)[-1] for p, t in zip(want, docs.text)]


def test_abuse_in_any_language_is_caught_and_clean_text_left(spark):
    sf = "/root/testdata/sf0.1"
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.createDataFrame(labels[["doc_id"]]), "doc_id")
    got = rate(docs, read_if_there(spark, f"{sf}/labels.parquet")).select("doc_id", "lang", "_q_kept", "_q_failed").toPandas().merge(labels, on="doc_id")
    # documents whose labels were not seen by what judges words
    unseen = got[got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 2 == 1) & ~got._q_failed]
    toxic, clean = unseen[unseen.toxic == 1], unseen[(unseen.toxic == 0) & (unseen.quality == 1)]
    assert (~toxic[toxic.lang == "en"]._q_kept).mean() > 0.85 and (~toxic[toxic.lang != "en"]._q_kept).mean() > 0.6
    assert clean._q_kept.mean() > 0.98


def test_a_rule_that_labels_contradict_loses_its_say():
    rng = np.random.default_rng(2)
    good = rng.random(4000) < 0.8
    v = np.zeros((4000, 3), dtype=int)
    v[:, 0] = np.where(good, 1, np.where(rng.random(4000) < 0.7, 2, 0))
    v[:, 1] = np.where(rng.random(4000) < 0.1, 2, 1)  # whatever the document
    v[:, 2] = np.where(~good & (rng.random(4000) < 0.5), 2, 0)
    pats, inv, n = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    known = np.zeros((len(pats), 2))
    np.add.at(known, (inv.ravel()[:400], (~good[:400]).astype(int)), 1)
    kept = fit(pats, n.astype(float), known)[inv.ravel()] >= 0.5
    noisy = (v[:, 1] == 2) & good
    assert kept[noisy].mean() > 0.95 and (kept == good).mean() > 0.95


def test_labels_awkward(awkward, nothing, spark):
    rows = [(3, None, None), (None, 0, 1), (99, 1, 1), (8, 0, 0), (8, 1, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert rate(awkward, labels).count() == awkward.count()
    assert rate(nothing, labels).count() == 0 and rate(awkward, labels.limit(0)).count() == awkward.count()
    assert rate(awkward.selectExpr("*", "1 as _q", "2 as _q_kept"), labels).where("_q_kept").count() >= 0
