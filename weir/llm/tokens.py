"""Token ids in files of Simple-8b words.

Format. A file row holds one frame: a header, the frame's documents (id and
number of ids), the offset of each block's first word, and 64-bit words. A
word's top four bits select how many ids of how many bits the other sixty
hold (``WIDTHS``, ``COUNTS``); selector 1 is an escape: the next word is one id
of up to 64 bits. Blocks of ``BLOCK`` ids start on a word of their own, so a
reader can start at any block, and all words of one selector are decoded at
once. Frames are rows of a Parquet table: they split, and are committed whole,
like any of Spark's files.

Tokenising. A pretoken of the byte-level vocabulary never runs on from a
character that isn't white space into a space, nor from a letter into a mark or
a line's end, nor over a line's end between other characters and a letter. So a
text whose spaces all follow such a character is the concatenation of the
chunks that begin at these places. A span of texts, a few megabytes of a batch
or one longer text, is cut into chunks and these are numbered by Arrow over one
buffer; distinct chunks that are new are encoded, all others are known by
number, and the span's ids are gathered from the ids of the known chunks. So a
worker holds the known chunks and the arrays of one span, however large Spark's
batches are. Other texts go to the tokenizer whole, as do all texts of a
vocabulary by which a probe comes out otherwise. Special tokens in a text are what the tokenizer makes
of them; ``special_as_text`` makes them ordinary text.

Defined cases: null or empty text has only the end id; ids in ascending
order with null first; rows with one id in order of their texts; very long
texts are encoded whole, and a frame ends with the document that fills it;
columns beside id and text are not read, whatever their names; an empty table
gives empty files and results.
"""

from __future__ import annotations

import os
import string
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stage, text_batches

BLOCK = 128
#: Ids of a frame, after which the document at hand is its last.
FRAME = 1_000_000
#: Bytes of text whose chunks are numbered and gathered at once; a longer text goes alone.
SPAN = 4 << 20
WIDTHS = np.array([0, 64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
COUNTS = np.array([240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
ESCAPE = 1
_HEAD = struct.Struct("<4sIQII")
_MAGIC = b"S8B1"
_PAYLOAD = np.uint64((1 << 60) - 1)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of ``ids`` (uint64), and the first word of each block, with the end."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    n_blocks = -(-n // BLOCK)
    top = int(ids.max())
    best = np.full((n_blocks, BLOCK), ESCAPE, dtype=np.uint8)
    # from the widest to the narrowest, so that what holds most ids wins; past a block's end everything fits
    for s in range(15, -1, -1):
        if s == ESCAPE:
            continue
        if not top >> int(WIDTHS[s]):
            best[:] = s
            continue
        count = int(min(COUNTS[s], BLOCK))
        fits = np.ones((n_blocks, BLOCK + count - 1), dtype=bool)
        inside = ids < np.uint64(1 << int(WIDTHS[s]))
        if not inside.any():
            continue
        full = n // BLOCK
        fits[:full, :BLOCK] = inside[: full * BLOCK].reshape(full, BLOCK)
        fits[full:, : n - full * BLOCK] = inside[full * BLOCK :]
        size = 1
        while 2 * size <= count:
            fits = fits[:, :-size] & fits[:, size:]
            size *= 2
        if count > size:
            fits = fits[:, : BLOCK] & fits[:, count - size : count - size + BLOCK]
        best[fits[:, :BLOCK]] = s
    best = best.ravel()
    # all blocks step from word to word together
    pos = np.arange(0, n, BLOCK)
    stop = np.minimum(pos + BLOCK, n)
    is_start = np.zeros(n, dtype=bool)
    while len(pos):
        is_start[pos] = True
        pos = pos + COUNTS[best[pos]]
        on = pos < stop
        pos, stop = pos[on], stop[on]
    start = np.flatnonzero(is_start)
    sel = best[start]
    held = np.diff(np.concatenate([start, [n]]))
    place = np.arange(n) - np.repeat(start, held)
    escaped = sel == ESCAPE
    shift = place * np.repeat(np.where(escaped, 0, WIDTHS[sel]), held)
    packed = np.bitwise_or.reduceat(ids << shift.astype(np.uint64), start)
    word_at = np.concatenate([[0], np.cumsum(1 + escaped)])
    words = np.zeros(word_at[-1], dtype=np.uint64)
    words[word_at[:-1]] = sel.astype(np.uint64) << np.uint64(60) | np.where(escaped, np.uint64(0), packed)
    words[word_at[:-1][escaped] + 1] = packed[escaped]
    offsets = word_at[np.searchsorted(start, np.arange(0, n, BLOCK))]
    return words, np.concatenate([offsets, word_at[-1:]]).astype(np.uint32)


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids (uint64) that ``pack`` gave these words and offsets."""
    out = np.zeros(n, dtype=np.uint64)
    if not n:
        return out
    sel = (words >> np.uint64(60)).astype(np.int64)
    # the word after an escape is an id: its own top bits select nothing; an escape that is such an id escapes nothing
    raw = np.zeros(len(words), dtype=bool)
    for i in np.flatnonzero(sel == ESCAPE):
        if not raw[i]:
            raw[i + 1] = True
    count = np.where(raw, 0, COUNTS[sel])
    block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets.astype(np.int64)))
    up = np.cumsum(count) - count
    first = block * BLOCK + up - up[offsets[:-1].astype(np.int64)][block]
    ends = np.minimum(block * BLOCK + BLOCK, n)
    for s in np.unique(sel[~raw]):
        mine = np.flatnonzero((sel == s) & ~raw)
        if s == ESCAPE:
            out[first[mine]] = words[mine + 1]
        elif WIDTHS[s]:
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            for k in range(COUNTS[s]):
                to = first[mine] + k
                on = to < ends[mine]
                out[to[on]] = (words[mine[on]] & _PAYLOAD) >> np.uint64(k * WIDTHS[s]) & mask
    return out


def frame(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One frame's bytes."""
    words, offsets = pack(ids)
    null = np.array([x is None for x in doc_ids], dtype=np.uint8)
    known = np.array([x or 0 for x in doc_ids], dtype="<i8")
    head = _HEAD.pack(_MAGIC, len(doc_ids), len(ids), len(offsets), len(words))
    return b"".join([head, known.tobytes(), null.tobytes(), np.array(lengths, dtype="<u4").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes()])


def read_from(data: bytes, place: int, count: int) -> np.ndarray:
    """``count`` of a frame's ids from ``place`` on, decoding just the blocks that hold them."""
    _, docs, n, n_off, n_words = _HEAD.unpack_from(data)
    offsets_at = _HEAD.size + docs * 13
    offsets = np.frombuffer(data, "<u4", n_off, offsets_at)
    count = max(min(count, n - place), 0)
    lo, hi = place // BLOCK, -(-(place + count) // BLOCK)
    a, z = (int(offsets[k]) for k in (lo, hi)) if count else (0, 0)
    words = np.frombuffer(data, "<u8", z - a, offsets_at + offsets.nbytes + 8 * a)
    own = unpack(words, offsets[lo : hi + 1] - np.uint32(a), min(hi * BLOCK, n) - lo * BLOCK) if count else np.zeros(0, np.uint64)
    return own[place - lo * BLOCK :][:count]


def read_frame(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The documents' ids, their numbers of token ids, and all token ids."""
    magic, docs, n, n_off, n_words = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a frame")
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(data, dtype=kind, count=count, offset=at)
        at += x.nbytes
        return x

    known, null, lengths, offsets, words = take("<i8", docs), take("u1", docs), take("<u4", docs), take("<u4", n_off), take("<u8", n_words)
    return [None if z else int(x) for x, z in zip(known, null)], lengths, unpack(words, offsets, n)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


_IS_LETTER, _IS_MARK = _table(string.ascii_letters), _table(string.punctuation)
_IS_SHOWN = _IS_LETTER | _IS_MARK | _table(string.digits)
#: What the places at which chunks begin rest on.
_PROBE = "It's a word, don't.\nNext (line)\nand so on!\n\nX 12.5\n a  b\tc Éöß, 漢字.\nEnd 'sabc o'sabc x1y2,3.\r\nz <a>b\n"


class Encoder:
    """Texts to their ids, by way of distinct chunks.

    New chunks are encoded side by side, many in one text, and told apart by
    the bytes that each id stands for.
    """

    #: Known chunks, and their ids, after which a worker begins anew.
    KEEP, KEEP_IDS = 900_000, 8_000_000
    LONGEST = 48
    #: Chunks that are encoded as one text, and texts that the library holds the tokens of at once.
    LOT, TEXTS = 256, 64
    #: Chunks whose ids are gathered at once.
    GATHER = 1 << 17

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [] if special_as_text else list(self.tokenizer.get_added_tokens_decoder().values())
        self.forget()
        #: By id the number of bytes it stands for: a byte-level vocabulary writes each byte as one sign.
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token)
        for t in added:
            self.bytes_of[self.tokenizer.token_to_id(t.content)] = len(t.content.encode())
        self.special = [t.content.encode() for t in added]
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.by_chunks = not any(" " in t.content or t.lstrip or t.rstrip or t.single_word or t.normalized for t in added) and len(self.line) == 1
        if self.by_chunks:
            found = self.encode(pa.array([_PROBE]))[0].tolist()
            self.by_chunks = found == self.plain([_PROBE])[0]
            self.forget()

    def forget(self) -> None:
        self.code: dict[bytes, int] = {}
        #: By code: where a chunk's ids start, how many it has, and whether no space may follow it: it is empty or ends with white space.
        self.start, self.size, self.open = (np.zeros(1 << 16, k) for k in (np.int64, np.int64, bool))
        self.ids, self.n_codes, self.n_ids = np.zeros(1 << 18, np.uint32), 0, 0

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for i in range(0, len(texts), self.TEXTS) for x in self.tokenizer.encode_batch_fast(texts[i : i + self.TEXTS], add_special_tokens=False)]

    def _side_by_side(self, chunks: list[bytes], line: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """How many ids each chunk has, and the ids, of chunks encoded as one text, each followed by ``line``."""
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        lots = [chunks[i : i + self.LOT] for i in range(0, len(chunks), self.LOT)]
        for lot, own in zip(lots, self.plain([(line.join(x) + line).decode() for x in lots])):
            own = np.array(own, np.int64)
            reach = np.cumsum(self.bytes_of[own])
            ends = np.cumsum(np.fromiter(map(len, lot), np.int64, len(lot)) + len(line))
            cut = np.searchsorted(reach, ends)
            if cut[-1] + 1 != len(own) or (reach[cut] != ends).any() or (line and (own[cut] != self.line[0]).any()):
                # ids that don't fall apart at the chunks: each by itself
                apart = self.plain([x.decode() for x in lot])
                own, count = np.array([i for x in apart for i in x], np.int64), np.array(list(map(len, apart)), np.int64)
            else:
                count = np.diff(cut, prepend=-1)
                if line:
                    keep = np.ones(len(own), dtype=bool)
                    keep[cut] = False
                    own, count = own[keep], count - 1
            sizes.append(count), ids.append(own)
        return np.concatenate(sizes), np.concatenate(ids)

    def _learn(self, chunks: list[bytes]) -> list[int]:
        """New codes of ``chunks``."""
        n = len(chunks)
        # text that a space may follow
        shut = np.array([x[-1] > 32 and (x[-1] < 128 or not x.decode()[-1].isspace()) for x in chunks], dtype=bool)
        head = np.array([x[0] for x in chunks], dtype=np.uint8)
        led, word = shut & (head == 32), shut & _IS_LETTER[head]
        kinds = [np.flatnonzero(k) for k in (led, word, ~(led | word))]
        found = [self._side_by_side([chunks[i] for i in kinds[0].tolist()]), self._side_by_side([chunks[i] for i in kinds[1].tolist()], b"\n")]
        rest = self.plain([chunks[i].decode() for i in kinds[2].tolist()])
        found.append((np.array(list(map(len, rest)), np.int64), np.array([i for x in rest for i in x], np.int64)))
        # codes follow the order of kinds
        order, sizes, flat = (np.concatenate(x) for x in (kinds, [f[0] for f in found], [f[1] for f in found]))
        first, total = self.n_codes, len(flat)
        while len(self.start) < first + n:
            self.start, self.size, self.open = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.open))
        while len(self.ids) < self.n_ids + total:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.start[first : first + n] = self.n_ids + np.cumsum(sizes) - sizes
        self.size[first : first + n] = sizes
        self.open[first : first + n] = ~shut[order]
        self.ids[self.n_ids : self.n_ids + total] = flat
        self.n_codes, self.n_ids = first + n, self.n_ids + total
        codes = np.empty(n, np.int64)
        codes[order] = first + np.arange(n)
        return codes.tolist()

    def _begins(self, flat: np.ndarray, data: bytes, at: np.ndarray) -> np.ndarray:
        """The bytes of ``flat`` that a chunk begins at, and its end: every text (from ``at``) and space, where a letter meets a mark or a line's end, and about a line's end amid text."""
        begins = flat == 32
        if not any(x in data for x in self.special):
            line, letter, shown = flat == 10, _IS_LETTER[flat], _IS_SHOWN[flat]
            begins[1:] |= letter[:-1] & (_IS_MARK[flat[1:]] | line[1:])
            amid = line[1:-1] & shown[:-2] & letter[2:]
            begins[1:-1] |= amid
            begins[2:] |= amid
        begins[at] = True
        return np.append(np.flatnonzero(begins), len(flat))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts (UTF-8 in a string or binary array; null is empty), and how many each text has."""
        n = len(texts)
        if not self.by_chunks:
            found = self.plain([x or "" for x in texts.cast(pa.large_string()).to_pylist()])
            sizes = np.fromiter(map(len, found), np.int64, n)
            return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes
        column = texts.cast(pa.large_binary()).fill_null(b"")
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        at, flat = at - at[0], np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        full, data = np.flatnonzero(np.diff(at)), flat.tobytes()
        if not len(full):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        edges = self._begins(flat, data, at[full])
        begins = edges[:-1]
        first = np.searchsorted(begins, at[full])
        chunks = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        del data
        held, known = chunks.dictionary.buffers()[1:]
        held = np.frombuffer(held, np.int64)[: len(chunks.dictionary) + 1].tolist()
        known = known.to_pybytes()
        distinct = [known[a:z] for a, z in zip(held, held[1:])]
        if len(self.code) > self.KEEP or self.n_ids > self.KEEP_IDS:
            self.forget()
        new = [x for x in distinct if x not in self.code]
        passing = [x for x in new if len(x) > self.LONGEST or b"\n" in x]
        if passing:
            new = [x for x in new if not (len(x) > self.LONGEST or b"\n" in x)]
        self.code.update(zip(new, self._learn(new)))
        # behind the known chunks stand, for this call, those that are not kept
        n_codes, n_ids = self.n_codes, self.n_ids
        self.code.update(zip(passing, self._learn(passing)))
        codes = np.fromiter(map(self.code.__getitem__, distinct), np.int64, len(distinct))[chunks.indices.to_numpy()]
        for x in passing:
            del self.code[x]
        del chunks, held, known, distinct, new, passing
        # a text goes whole if what must not be followed by a space is
        amid = self.open[codes]
        amid[:-1] &= flat[begins[1:]] == 32
        amid[np.concatenate([first[1:], [len(codes)]]) - 1] = False
        start, size = self.start[codes], self.size[codes]
        if amid.any():
            bad = np.unique(np.searchsorted(first, np.flatnonzero(amid), side="right") - 1)
            whole = self._whole([flat[at[t] : at[t + 1]].tobytes().decode() for t in full[bad].tolist()])
            last = np.concatenate([first[1:], [len(codes)]])
            for t, (s, k) in zip(bad.tolist(), whole):
                size[first[t] : last[t]] = 0
                start[first[t]], size[first[t]] = s, k
        sizes = np.zeros(n, np.int64)
        sizes[full] = np.add.reduceat(size, first)
        out, done = np.empty(int(sizes.sum()), np.uint32), 0
        for i in range(0, len(codes), self.GATHER):
            s, k = start[i : i + self.GATHER], size[i : i + self.GATHER]
            upto = np.cumsum(k)
            own = np.repeat(s - (upto - k), k)
            own += np.arange(len(own))
            out[done : done + len(own)] = self.ids[own]
            done += len(own)
        self.n_codes, self.n_ids = n_codes, n_ids
        return out, sizes

    def _whole(self, texts: list[str]) -> list[tuple[int, int]]:
        """Where the ids of whole texts are put for this batch, and how many they are."""
        found = self.plain(texts)
        flat = np.fromiter(chain.from_iterable(found), np.uint32)
        self.ids = np.concatenate([self.ids[: self.n_ids], flat, np.zeros(1 << 18, np.uint32)])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        starts = self.n_ids + np.cumsum(sizes) - sizes
        return list(zip(starts.tolist(), sizes.tolist()))


_HELD: dict[tuple[str, bool], Encoder] = {}


def encoder_for(path: str, special_as_text: bool) -> Encoder:
    """The process's encoder: its chunks serve all tasks of a worker."""
    key = path, special_as_text
    if key not in _HELD:
        _HELD[key] = Encoder(*key)
    return _HELD[key]


def spans(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold up to ``most`` bytes, or one longer text; together all rows."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(ends):
        before = int(ends[a - 1]) if a else 0
        z = max(a + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield a, z
        a = z


def frames_of(batches: Iterable[pa.RecordBatch], encoder: Encoder, part: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, frame, first, ids, data) of the documents (id, text) of ``batches``, in their order."""
    first, no, ids, lengths, data, held = 0, 0, [], [], [], 0

    def flush():
        nonlocal first, no, held
        flat = np.concatenate(data).astype(np.uint64)
        data.clear()
        row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "frame": pa.array([no], pa.int32()), "first": pa.array([first], pa.int64()), "ids": pa.array([len(flat)], pa.int64()), "data": pa.array([frame(ids, lengths, flat)], pa.binary())})
        first, no, held = first + len(flat), no + 1, 0
        ids.clear(), lengths.clear()
        return row

    for b in batches:
        for low, high in spans(b.column(1), SPAN):
            found, sizes = encoder.encode(b.column(1).slice(low, high - low))
            n, own, sizes = len(sizes), b.column(0).slice(low, high - low).to_pylist(), sizes + 1
            # every document's ids, then its end
            ends = np.cumsum(sizes)
            flat, is_end = np.full(len(found) + n, end_id, dtype=np.uint32), np.zeros(len(found) + n, dtype=bool)
            is_end[ends - 1] = True
            flat[~is_end] = found
            del found, is_end
            a = 0
            while a < n:
                # the documents up to the one that fills the frame
                before = int(ends[a - 1]) if a else 0
                z = min(n, int(np.searchsorted(ends, before + FRAME - held)) + 1)
                ids += own[a:z]
                lengths += sizes[a:z].tolist()
                data.append(flat[before : ends[z - 1]])
                held += int(ends[z - 1]) - before
                a = z
                if held >= FRAME:
                    yield flush()
        del b
    if ids:
        yield flush()


def write_tokens(docs: DataFrame, tokenizer: str, to: str | None = None, *, end_id: int = 0, special_as_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise ``docs`` by the file ``tokenizer`` into frames in ascending id order, in Parquet files under ``to`` or in the scratch folder; the table of frames, read back."""
    spark = docs.sparkSession
    # rows enough to fill a span with short texts; Spark bounds a batch's bytes
    text_batches(spark, 6000)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(partitions(spark), "id").sortWithinPartitions("id", "text")

    def run(batches):
        yield from frames_of(batches, encoder_for(tokenizer, special_as_text), TaskContext.get().partitionId(), end_id)

    frames = rows.mapInArrow(run, "part int, frame int, first long, ids long, data binary")
    if to is None:
        return stage(frames, "tokens")
    frames.write.parquet(to)
    return spark.read.schema(frames.schema).parquet(to)


def read_tokens(frames: DataFrame) -> DataFrame:
    """Rows (doc_id, part, start, n_tokens, ids_crc32, n_bytes) of a table of frames; start counts from the part's beginning."""

    def run(batches):
        for b in batches:
            # a frame at a time
            for part, first, data in zip(*(b.column(i) for i in range(3))):
                part, first = part.as_py(), first.as_py()
                docs, lengths, ids = read_frame(data.as_py())
                flat, ends = ids.astype("<u4"), np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                crc = [zlib.crc32(flat[a:z]) for a, z in zip(starts, ends)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "part": pa.array([part] * len(docs), pa.int32()), "start": pa.array(first + starts), "n_tokens": pa.array(lengths.astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})

    return frames.select("part", "first", "data").mapInArrow(run, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")


def op6_tokens(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    frames = write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    # one row per part of the range partitioning, as many as shuffle partitions
    totals = sorted((r[0], r[1]) for r in frames.groupBy("part").agg(F.sum("ids")).collect())
    before = np.cumsum([0, *(n for _, n in totals)])
    base = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(totals, before)], "part int, base long")
    got = read_tokens(frames).join(F.broadcast(base), "part")
    return got.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
