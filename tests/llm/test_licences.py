import random
import re

import pytest

from weir.llm.licences import PHRASES, TEMPLATES, Scanner, op4_licences, read_templates, scan, words_of


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return [len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))]


def check(got, rows):
    want = sorted(str([d, *brute(t)]) for d, t in rows)
    num = lambda x: None if x is None or x != x else int(x)
    have = sorted(str([num(r.doc_id), num(r.n_words), num(r.n_base), num(r.first_word), num(r.last_word), r.base_labels]) for r in got.itertuples())
    assert have == want
    for r in got.itertuples():
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_query(spark, sf, docs):
    check(op4_licences(spark, sf).toPandas(), list(zip(docs.doc_id, docs.text)))


def test_awkward(awkward, nothing, on_table):
    check(on_table(op4_licences, awkward), [(r.doc_id, r.text) for r in awkward.collect()])


def test_empty(nothing, on_table):
    assert len(on_table(op4_licences, nothing)) == 0


def test_matching_statistics_against_brute_force():
    s = Scanner(TEMPLATES, PHRASES)
    coded = [[s.vocab[w] for w in words_of(t.encode())] for texts in TEMPLATES.values() for t in texts]
    coded += [[s.vocab[w] for w in p.encode().split()] for p in PHRASES]
    text = (coded[0][:3] + coded[2][10:25] + [9, 9] + coded[-2] + coded[5][4:9]) * 2
    subs = {tuple(c[i:j]) for c in coded for i in range(len(c)) for j in range(i + 1, len(c) + 1)}
    for j, (_, n) in enumerate(s.automaton.stream(text)):
        assert n == max((m for m in range(1, j + 2) if tuple(text[j + 1 - m : j + 1]) in subs), default=0)


@pytest.mark.parametrize("label", TEMPLATES)
def test_templates_found_with_small_changes(label):
    s = Scanner(TEMPLATES, PHRASES)
    text = TEMPLATES[label][0].replace("licensed under", "is licensed under", 1).upper()
    got = s.texts([b"word " * 50 + text.encode() + b" more words here"])[0]
    assert label in {s.labels[t] for t, own in got["found"].items() for share, _, _ in own if share >= s.least}


def brute_spans(text, templates, shortest=3, gap=6, least=0.75):
    """All matches by comparing all substrings, all chains by trying every pair of matches."""
    words = [w.decode() for w in words_of(text.encode())]
    coded = [(label, [w.decode() for w in words_of(t.encode())]) for label, texts in templates.items() for t in texts]
    out, scores = [], [0.0]
    pieces = {tuple(c[i:j]) for _, c in coded for i in range(len(c)) for j in range(i + 1, len(c) + 1)}
    stat = [max((n for n in range(1, j + 2) if tuple(words[j + 1 - n : j + 1]) in pieces), default=0) for j in range(len(words))]
    ends = [(j - n + 1, n) for j, n in enumerate(stat) if n >= shortest and (j + 1 == len(words) or stat[j + 1] <= n)]
    for label, c in coded:
        found = sorted((s, n, k) for s, n in ends for k in range(len(c) - n + 1) if c[k : k + n] == words[s : s + n])
        chains = []
        for s, n, k in found:
            before = [(x[0], x[1]) for x in chains if 0 <= s - x[2] <= gap and 0 <= k - x[3] <= gap]
            cover, begin = max(before, default=(0, s))
            chains.append((cover + n, begin, s + n, k + n))
        taken = []
        for cover, begin, stop, _ in sorted(chains, key=lambda x: (-x[0], x[2], -x[1])):
            if cover >= least * len(c) and all(stop <= a or z < begin for a, z in taken):
                taken.append((begin, stop - 1))
                out.append((label, round(cover / len(c), 9), begin, stop - 1))
        scores.append(max((x[0] / len(c) for x in chains), default=0.0))
    return sorted(out), max(scores)


def test_spans_labels_and_scores_against_brute_force(spark):
    rng = random.Random(5)
    notices = [t for texts in TEMPLATES.values() for t in texts if len(t) < 260]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            words = rng.choice(notices).split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(["the", "licensed", "x", "and y"])
            parts.append(" ".join(words[rng.randrange(2) :]))
            parts.append(" ".join(rng.choice(["the", "of", "under", "zebra"]) for _ in range(rng.randrange(12))))
        rows.append((i, " ".join(parts)))
    rows += [(100, f"{notices[0]} . {notices[0]} and then {notices[0]}"), (101, " ".join([notices[1]] * 40))]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "_l.*").toPandas()
    texts = dict(rows)
    for r in got.itertuples():
        spans, score = brute_spans(texts[r.doc_id], TEMPLATES)
        assert sorted((x["label"], round(x["share"], 9), x["first_word"], x["last_word"]) for x in r.spans) == spans
        base = set(filter(None, r.base_labels.split(",")))
        assert r.labels == ",".join(sorted(base | {x[0] for x in spans}))
        assert r.score == (1.0 if base else pytest.approx(min(1.0, score)))


def test_every_standing_of_a_notice_is_a_span():
    s = Scanner(TEMPLATES, PHRASES)
    notice = TEMPLATES["mit"][2].encode()
    found = s.texts([b" so it is said here. ".join([notice] * 30)])[0]["found"]
    (own,) = [x for t, x in found.items() if s.labels[t] == "mit" and x[0][0] == 1.0]
    assert len(own) == 30


def test_phrases_of_one_word_and_whole_texts(tmp_path, awkward):
    s = Scanner({}, {"zlib": "zlib", "public domain": "pd"})
    assert s.texts([b"the zlib, the ZLIB of public domain"])[0]["bases"] == [(0, 1), (0, 3), (1, 5)]
    (tmp_path / "Own-1.0").write_text("You may do what you like with this but never say that it was yours")
    templates = read_templates(str(tmp_path))
    got = Scanner(templates, {}).texts([b"Note: you may do what you like with this but never say it was yours."])[0]
    assert list(templates) == ["own-1.0"] and got["found"][0][0][0] > 0.9
    assert scan(awkward.selectExpr("*", "1 as _l")).select("_l.labels").count() == awkward.count()
