import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weir.llm import tokens
from weir.llm.tokens import Encoder, frame, op6_tokens, pack, read_frame, read_from, read_tokens, unpack, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODER, TOKENIZER = Encoder(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**60 - 1), st.integers(2**60, 2**64 - 1)), max_size=700))
def test_round_trip(values):
    ids = np.array(values, dtype=np.uint64)
    words, offsets = pack(ids)
    assert (unpack(words, offsets, len(ids)) == ids).all()
    docs, lengths, back = read_frame(frame([5, None], [len(ids), 0], ids))
    assert docs == [5, None] and list(lengths) == [len(ids), 0] and (back == ids).all()
    for place, count in ((0, 1), (len(ids) // 2, 200), (len(ids), 3), (max(len(ids) - 5, 0), 99)):
        assert (read_from(frame([5, None], [len(ids), 0], ids), place, count) == ids[place : place + count]).all()


def test_packs_densely():
    assert len(pack(np.ones(1280, dtype=np.uint64))[0]) <= 30
    assert len(pack(np.zeros(1280, dtype=np.uint64))[0]) == 10


def plain(texts):
    """By a tokenizer of the test's own, as the library has it."""
    return [TOKENIZER.encode(t or "", add_special_tokens=False).ids for t in texts]


def encoded(encoder, texts):
    ids, sizes = encoder.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abcdé漢ñ'.,!?x9\n\n\t\u0301²", max_size=9), max_size=12).map(" ".join))
def test_words_equal_whole(text):
    assert ENCODER.by_chunks and encoded(ENCODER, [text]) == plain([text])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t  \x85\x1cab'sé1.!<|endoftext>", max_size=40), min_size=1, max_size=5))
def test_chunks_equal_whole(texts):
    texts = [*texts, texts[0] + " x", None, "", " ", "a <|endoftext|> b", "x<|endoftext|>", "<|endoftext|>y <|endoftext|><|endoftext|>. z"]
    e = Encoder(PATH)
    assert encoded(e, texts) == plain(texts) == encoded(e, texts)
    sliced, sizes = e.encode(pa.array(texts, pa.string()).slice(1))
    assert sliced.tolist() == [x for own in plain(texts[1:]) for x in own]


def test_special_tokens_and_forgetting(monkeypatch):
    monkeypatch.setattr(Encoder, "KEEP", 3)
    e, rows = Encoder(PATH), ["one two three four", "two five  six", "a <|endoftext|> b", "one\ntwo seven"]
    assert 50256 in encoded(e, rows)[2]
    for _ in range(3):
        assert encoded(e, rows) == plain(rows)
    assert 50256 not in encoded(Encoder(PATH, special_as_text=True), rows)[2]


def test_files_where_the_caller_wants_them(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * i) for i in range(20)], "doc_id long, text string")
    frames = write_tokens(docs, PATH, str(tmp_path / "out"))
    got = read_tokens(spark.read.parquet(str(tmp_path / "out"))).toPandas()
    assert frames.count() and dict(zip(got.doc_id, got.n_tokens)) == {i: len(plain(["word " * i])[0]) + 1 for i in range(20)}


def brute(rows):
    start, out = 0, {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*plain([text])[0], 0]
        out.setdefault(doc, []).append((start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def check(got, rows):
    have = {}
    for r in got.itertuples():
        have.setdefault(None if r.doc_id != r.doc_id else int(r.doc_id), []).append((r.start, r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == brute(rows)


def test_query(spark, sf, docs):
    check(op6_tokens(spark, sf).toPandas(), list(zip(docs.doc_id, docs.text)))


def test_awkward(awkward, on_table):
    check(on_table(op6_tokens, awkward), [(r.doc_id, r.text) for r in awkward.collect()])


def test_empty(nothing, on_table):
    assert len(on_table(op6_tokens, nothing)) == 0


def held(run):
    """What ``run`` returns, and the most bytes that Python and NumPy held meanwhile."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


#: Some 8 MB in texts of 4 kB: few distinct chunks, so what is held is arrays over the batch.
LARGE = [f"{i} " + "some words, and more of them. " * 140 for i in range(2000)]


def test_encoding_holds_few_arrays_over_its_texts():
    e, column = Encoder(PATH), pa.array(LARGE)
    (ids, sizes), most = held(lambda: e.encode(column))
    n_bytes = sum(map(len, LARGE))
    assert most < 16 * n_bytes, most / n_bytes
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])][::400] == plain(LARGE[::400])


def test_large_batches_are_framed_a_span_at_a_time(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(len(LARGE)), pa.int64()), "text": pa.array(LARGE)})
    monkeypatch.setattr(tokens, "FRAME", 100_000)
    whole = list(tokens.frames_of([batch.slice(i, 300) for i in range(0, len(LARGE), 300)], Encoder(PATH), 0, 0))
    monkeypatch.setattr(tokens, "SPAN", 1 << 18)
    e, rows = Encoder(PATH), []

    def run():
        for r in tokens.frames_of([batch], e, 0, 0):
            rows.append(r)

    _, most = held(run)
    assert most < 3 * batch.nbytes, most / batch.nbytes
    assert len(rows) > 10 and pa.Table.from_batches(rows) == pa.Table.from_batches(whole)


@pytest.mark.parametrize("most", [1, 4, 7, 100])
def test_spans_hold_every_row_once(most):
    texts = pa.array(["ab", None, "", "abcdefgh", "éé", "a", "abc", ""])
    cuts = list(tokens.spans(texts, most))
    assert [a for a, _ in cuts] == [0, *(z for _, z in cuts)][:-1] and cuts[-1][1] == len(texts)
    assert all(z - a == 1 or sum(len((x or "").encode()) for x in texts[a:z].to_pylist()) <= most for a, z in cuts)
    assert not list(tokens.spans(texts[:0], most))


def test_chunks_that_are_not_kept_leave_nothing():
    e, rows = Encoder(PATH), ["one two " + "x" * 90, "a\n\n\nb  \n c\n"]
    assert encoded(e, rows) == plain(rows)
    before = e.n_codes, e.n_ids
    for _ in range(3):
        assert encoded(e, rows) == plain(rows)
    assert (e.n_codes, e.n_ids) == before == (len(e.code), int(e.size[: e.n_codes].sum()))
