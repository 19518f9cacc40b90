"""Removing repeated passages with a run-length index of the texts that may repeat.

A byte goes if a string of ``width`` bytes that also starts earlier covers it.
Which strings repeat is read off run-compressed Burrows-Wheeler transforms of
the parts of texts that can hold a repeat at all; four steps keep the work in
proportion to the input.

1. Anchors. Every window of ``width`` bytes picks the 32-byte gram with the
   least hash in it, the leftmost of equals. The pick depends on the window's
   bytes alone, so equal windows pick equal grams at equal places. Successive
   windows with one pick form a piece: some 35 windows, known by the pick's hash
   (its anchor) and a hash of its bytes.
2. Equal pieces. All but the first of equal pieces are repeats as they stand.
   Each task settles its own before anything is dealt, so of a passage that
   stands everywhere a task sends one piece. What is left is dealt by anchor, as
   packed arrays. An anchor with one distinct piece has no further repeats; of
   the others the first piece of each kind is asked for.
3. Index. The pieces asked for are cut out of their texts and dealt by anchor.
   Each deal becomes a ``RunIndex``, which keeps the runs of the transform and
   the suffixes at their ends, not the suffix array. Matching statistics with the
   lexicographic predecessor are streamed from those samples and mark matches of
   ``width`` bytes and more; which suffix the predecessor is (the map phi) is
   read off the same samples. Windows chained by such matches are equal; all but
   the earliest of a chain are repeats.
4. Texts. The repeats' spans are gathered for each text and cut out.

An anchor of more than ``HOT`` distinct pieces would land in one task, so its
pieces are cut into single windows, dealt by the hash of the window.

Defined cases: null text is empty; a null id comes before all others; rows with
one id and text are one document, rows with one id and other texts are ordered
by their hash; texts shorter than ``width`` lose nothing; texts of over
``SLICE`` bytes are taken slice by slice; an empty table gives an empty result;
columns beside id and text are not read, whatever their names. An id must cast
to a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, partitions, stage, text_batches

WIDTH = 100
GRAM = 32
HOT = 20_000
#: Indexes that a part's pieces are divided among, so that each is small.
SUBS = 16
SLICE = 6_000_000
_POS = np.uint64((1 << 30) - 1)
_FIRST = -(1 << 63)
_RNG = np.random.default_rng(11)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _RNG.integers(0, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every run of GRAM bytes, by doubling."""
    h, size, i = _BYTE[data], 1, 0
    while size < GRAM:
        h = h[:-size] * _ODD[i] + h[size:]
        h ^= h >> np.uint64(31)
        size, i = 2 * size, i + 1
    return h * _ODD[7]


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` successive keys."""
    size = 1
    while 2 * size <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    rest = width - size
    return np.minimum(key[: len(key) - rest], key[rest:]) if rest else key


def pieces(data: np.ndarray, lengths: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """Pieces of texts laid end to end: (anchor, text, start in the text, number of windows)."""
    none = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    if len(data) < width:
        return none
    h = gram_hashes(data)
    pick = _least(h & ~_POS | np.arange(len(h), dtype=np.uint64), width - GRAM + 1) & _POS
    begins = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(lengths)), np.maximum(lengths - width + 1, 0))
    if not len(text):
        return none
    counts = np.maximum(lengths - width + 1, 0)
    at = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[text]
    own = pick[at].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])]))
    n = np.diff(np.concatenate([first, [len(own)]]))
    return h[own[first]], text[first], at[first] - begins[text[first]], n


def slices(lengths: list[int], width: int = WIDTH):
    """Runs of texts, or of a text's windows, of about SLICE bytes: lists of (text, from, to)."""
    run, held = [], 0
    for i, n in enumerate(lengths):
        for a in range(0, max(n - width + 1, 0), SLICE):
            b = min(n, a + SLICE + width - 1)
            run.append((i, a, b))
            held += b - a
            if held >= SLICE:
                yield run
                run, held = [], 0
    if run:
        yield run


class RunIndex:
    """The run-compressed Burrows-Wheeler transform of strings, each ended by a sign of its own, with the suffixes at run ends sampled."""

    def __init__(self, strings: list[bytes]) -> None:
        sizes = np.array([len(s) for s in strings], dtype=np.int64)
        text = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8).astype(np.int64) + 1
        self.end = np.repeat(np.cumsum(sizes + 1) - 1, sizes + 1)  # the place of each position's end sign
        at = np.arange(len(text))
        text[np.cumsum(sizes + 1) - 1] = 0
        self.text, self.left = text, self.end - at
        order = self._suffixes(int(sizes.max(initial=0)) + 1)
        before = np.where(order > 0, text[order - 1], 0)
        head = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == 0)])
        #: A run's symbol, its first row, and the suffixes sampled at its two ends.
        self.starts = np.flatnonzero(head)
        self.symbols = before[self.starts]
        self.first = order[self.starts]
        self.last = order[np.concatenate([self.starts[1:], [len(order)]]) - 1]
        self.rows = len(order)

    def _suffixes(self, longest: int) -> np.ndarray:
        """Suffixes in order; a suffix ends with its string, and equal ones keep the strings' order."""
        n = len(self.text)
        key = np.zeros(n, dtype=np.int64)
        at = np.arange(n)
        for j in range(7):
            key = key << 9 | self.text[np.minimum(at + j, self.end)]
        reach, rank = 7, None
        while True:
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
            if reach >= longest:
                return order
            key = rank * n + rank[np.minimum(at + reach, self.end)]
            reach *= 2

    def statistics(self) -> np.ndarray:
        """For each position the length of its match with the suffix before it in order.

        Within a run the match shrinks by one from a position to the next, so
        only the suffixes sampled at run heads are compared, each with the
        sample at the end of the run before it; the rest is streamed.
        """
        mine, other = self.first[1:], self.last[:-1]
        known = np.full(len(self.text), -1, dtype=np.int64)
        known[self.first[:1]] = 0
        match, on = np.zeros(len(mine), dtype=np.int64), np.arange(len(mine))
        bound = np.minimum(self.left[mine], self.left[other])
        while len(on):
            a, b = mine[on] + match[on], other[on] + match[on]
            go = (match[on] < bound[on]) & (self.text[a] == self.text[b])
            on = on[go]
            match[on] += 1
        known[mine] = match
        at = np.arange(len(known))
        last = np.maximum.accumulate(np.where(known >= 0, at, -1))
        return np.where(last >= 0, known[last] - (at - last), 0)

    def before(self, at: np.ndarray) -> np.ndarray:
        """The suffix before each of the suffixes ``at`` in order (-1 before the first): as far from it as the samples at the nearest run head to its left and the end of the run above that."""
        rank = np.argsort(self.first)
        run = rank[np.searchsorted(self.first[rank], at, side="right") - 1]
        return np.where(run > 0, self.last[run - 1] + (at - self.first[run]), -1)

    def chains(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in chains of successive matches of ``width`` bytes and more, and the first suffix of each one's chain."""
        long = np.flatnonzero(self.statistics() >= width)
        up = self.before(long)
        # a chain begins where a match is short; every round halves the way to there
        while len(long):
            at = np.minimum(np.searchsorted(long, up), len(long) - 1)
            on = long[at] == up
            if not on.any():
                break
            up = np.where(on, up[at], up)
        heads = np.unique(up)
        return np.concatenate([heads, long]), np.concatenate([heads, up])

    def count(self, pattern: bytes) -> int:
        """Occurrences of ``pattern`` by backward search over the runs."""
        lo, hi = 0, self.rows
        lengths = np.diff(np.concatenate([self.starts, [hi]]))
        for c in pattern[::-1]:
            c += 1
            own = np.flatnonzero(self.symbols == c)
            starts, up = self.starts[own], np.concatenate([[0], np.cumsum(lengths[own])])

            def rank(row: int) -> int:
                i = np.searchsorted(starts, row, side="right") - 1
                return 0 if i < 0 else int(up[i] + min(row - starts[i], lengths[own[i]]))

            base = int((self.text < c).sum())
            lo, hi = base + rank(lo), base + rank(hi)
            if lo >= hi:
                return 0
        return hi - lo


def repeats(strings: list[bytes], place: tuple[np.ndarray, ...], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(string, window) for every window that an earlier window equals; ``place`` orders windows: keys by string, the last the start."""
    at, chain = RunIndex(strings).chains(width)
    sizes = np.array([len(s) + 1 for s in strings], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    string = np.searchsorted(begins, at, side="right") - 1
    offset = at - begins[string]
    keys = [p[string] for p in place]
    keys[-1] = keys[-1] + offset
    order = np.lexsort([*keys[::-1], chain])
    first = np.concatenate([[True], chain[order][1:] != chain[order][:-1]])[: len(order)]
    # a window may be there twice if its document is; it isn't earlier than itself
    lead = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)
    same = np.ones(len(order), dtype=bool)
    for k in keys:
        same &= k[order] == k[order][lead]
    late = order[~same]
    return string[late], offset[late]


# packed arrays: little-endian columns of one length, compressed together

_Z, _D = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(*columns: np.ndarray) -> bytes:
    return _Z.compress(b"".join([len(columns[0]).to_bytes(8, "little"), *(np.ascontiguousarray(c).tobytes() for c in columns)]))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = _D.decompress(blob)
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for k in kinds:
        out.append(np.frombuffer(data, dtype=k, count=n, offset=at))
        at += out[-1].nbytes
    return out


def _by_part(part: np.ndarray, *columns: np.ndarray):
    """(part, its rows of the columns) for each part."""
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order])) + 1
    for rows in np.split(order, cut):
        if len(rows):
            yield int(part[rows[0]]), [c[rows] for c in columns]


def _groups(batches, key: int = 0):
    """(key, rows) for successive Arrow rows with one key."""
    now, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[key] != now and held:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


_PIECE = ("<u8", "<u8", "<i8", "<i8", "<u4", "<u2")
_SPAN = ("<i8", "<i8", "<u4", "<u4")
#: Of a piece asked for: its start and windows, the part and index it goes to, and whether its anchor is hot.
_ASK = ("<u4", "<u2", "<i4", "u1", "u1")


def _doc_part(d: np.ndarray, th: np.ndarray, parts: int) -> np.ndarray:
    return ((d.astype(np.uint64) + th.astype(np.uint64)) * _ODD[0] >> np.uint64(33)).astype(np.int64) % parts


def _rows(kind: str, found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(found), pa.string()), "part": pa.array([p for p, _ in found], pa.int32()), "data": pa.array([x for _, x in found], pa.binary())})


def _settled(held: list) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Columns of pieces in order; which are the first of equal ones; which are later than that one and so repeats."""
    a, h, d, th, s, n = (np.concatenate([x[i] for x in held]) for i in range(6))
    order = np.lexsort((s, th, d, h, a))
    a, h, d, th, s, n = cols = [c[order] for c in (a, h, d, th, s, n)]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (h[1:] != h[:-1])])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    # a piece may be there twice if its document is; it isn't later than itself
    return cols, new, ~new & ((d != d[lead]) | (th != th[lead]) | (s != s[lead]))


def _late_rows(cols: list[np.ndarray], late: np.ndarray, parts: int, width: int):
    if late.any():
        d, th, s, n = (c[late] for c in cols[2:])
        span = d, th, s, (s + n + (width - 1)).astype("<u4")
        yield _rows("span", [(p, _pack(*c)) for p, c in _by_part(_doc_part(*span[:2], parts), *span)])


def _anchor_rows(batches, parts: int, width: int):
    held: list[tuple[np.ndarray, ...]] = []

    def flush():
        cols, new, late = _settled(held)
        held.clear()
        yield from _late_rows(cols, late, parts, width)
        a, h, d, th, s, n = (c[new] for c in cols)
        yield _rows("piece", [(p, _pack(*c)) for p, c in _by_part((a >> np.uint64(20)).astype(np.int64) % parts, a, h, d, th, s, n)])

    for b in batches:
        ids, ties, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), as_bytes(b.column(2))
        for run in slices([len(t) for t in texts], width):
            of, skip = np.array([i for i, _, _ in run]), np.array([a for _, a, _ in run])
            data = b"".join([texts[i][a:z] for i, a, z in run])
            lengths = np.array([z - a for _, a, z in run], dtype=np.int64)
            anchor, text, start, n = pieces(np.frombuffer(data, dtype=np.uint8), lengths, width)
            low = (np.cumsum(lengths) - lengths)[text] + start
            own = np.fromiter((xxhash.xxh3_64_intdigest(data[x:z]) for x, z in zip(low.tolist(), (low + n + width - 1).tolist())), dtype=np.uint64, count=len(low))
            held.append((anchor, own, ids[of[text]], ties[of[text]], (start + skip[text]).astype("<u4"), n.astype("<u2")))
            if sum(len(x[0]) for x in held) > 400_000:
                yield from flush()
    if held:
        yield from flush()


def _equal_rows(batches, parts: int, width: int, hot_at: int):
    """From pieces dealt by anchor: spans of those that repeat whole, and the pieces asked for."""
    for part, rows in _groups(batches):
        cols, new, late = _settled([_unpack(r[1], *_PIECE) for r in rows])
        yield from _late_rows(cols, late, parts, width)
        a, _, d, th, s, n = cols
        group = np.cumsum(np.concatenate([[True], a[1:] != a[:-1]])) - 1
        kinds = np.bincount(group, weights=new).astype(np.int64)[group]
        ask = new & (kinds > 1)
        if ask.any():
            hot = (kinds[ask] > hot_at).astype("u1")
            sub = (a[ask] >> np.uint64(8) & np.uint64(SUBS - 1)).astype("u1")
            want = d[ask], th[ask], s[ask], n[ask], np.full(int(ask.sum()), part, dtype="<i4"), sub, hot
            yield _rows("ask", [(p, _pack(*c)) for p, c in _by_part(_doc_part(*want[:2], parts), *want)])


def _ask_rows(batches):
    """Asked-for pieces, gathered for each document: (d, th, packed)."""
    for _, rows in _groups(batches):
        cols = [_unpack(r[1], "<i8", "<i8", *_ASK) for r in rows]
        yield _per_doc(*(np.concatenate([c[i] for c in cols]) for i in range(2 + len(_ASK))))


def _per_doc(d: np.ndarray, th: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((columns[0], th, d))
    d, th = d[order], th[order]
    cut = np.flatnonzero((d[1:] != d[:-1]) | (th[1:] != th[:-1])) + 1
    blobs = [_pack(*(c[rows] for c in columns)) for rows in np.split(order, cut)]
    lead = np.concatenate([[0], cut])
    return pa.RecordBatch.from_pydict({"d": pa.array(d[lead]), "th": pa.array(th[lead]), "data": pa.array(blobs, pa.binary())})


def _cut_rows(batches, parts: int, width: int):
    """From documents and what is asked of them: the pieces' bytes, dealt by anchor, hot ones window by window."""
    for b in batches:
        found: dict[int, list[tuple[int, int, int, int, bytes]]] = {}
        for d, th, text, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3).to_pylist()):
            for s, n, part, sub, hot in zip(*(x.tolist() for x in _unpack(blob, *_ASK))):
                if not hot:
                    found.setdefault(part, []).append((d, th, s, sub, text[s : s + n + width - 1]))
                    continue
                for at in range(s, s + n):
                    own = text[at : at + width]
                    to = xxhash.xxh3_64_intdigest(own)
                    found.setdefault(to % parts, []).append((d, th, at, to >> 40 & SUBS - 1, own))
        rows = []
        for part, mine in found.items():
            cols = [np.array([m[i] for m in mine], dtype=k) for i, k in enumerate(("<i8", "<i8", "<u4", "u1"))]
            texts = [m[4] for m in mine]
            head = _pack(*cols, np.array([len(t) for t in texts], dtype="<u4"))
            rows.append((part, len(head).to_bytes(8, "little") + head + _Z.compress(b"".join(texts))))
        if rows:
            yield _rows("cut", rows)


def _index_rows(batches, parts: int, width: int):
    """From pieces' bytes dealt by anchor: spans of the windows that repeat."""
    for _, rows in _groups(batches):
        cols, strings = [], []
        for r in rows:
            blob = r[1]
            n = int.from_bytes(blob[:8], "little")
            cols.append(_unpack(blob[8 : 8 + n], "<i8", "<i8", "<u4", "u1", "<u4"))
            data, at = _D.decompress(blob[8 + n :]), 0
            for size in cols[-1][4].tolist():
                strings.append(data[at : at + size])
                at += size
        d, th, s, sub = (np.concatenate([c[i] for c in cols]) for i in range(4))
        # equal windows have one anchor and so one index; a part's indexes are built one at a time
        late = []
        for _, (mine,) in _by_part(sub, np.arange(len(sub))):
            own, at = repeats([strings[i] for i in mine.tolist()], (d[mine], th[mine], s[mine].astype(np.int64)), width)
            late.append((mine[own], at))
        string, offset = (np.concatenate([x[i] for x in late]) for i in range(2))
        if not len(string):
            continue
        # successive windows of a piece make one span
        order = np.lexsort((offset, string))
        string, offset = string[order], offset[order]
        first = np.concatenate([[True], (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1)])
        last = np.concatenate([first[1:], [True]])
        k = string[first]
        span = d[k], th[k], (s[k] + offset[first]).astype("<u4"), (s[k] + offset[last] + width).astype("<u4")
        yield _rows("span", [(p, _pack(*c)) for p, c in _by_part(_doc_part(*span[:2], parts), *span)])


def merge(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes in [start, stop)."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    first = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[first], reach[np.concatenate([first[1:], [True]])]


def _span_rows(batches):
    """Spans gathered and merged for each document: (d, th, packed)."""
    for _, rows in _groups(batches):
        cols = [_unpack(r[1], *_SPAN) for r in rows]
        d, th, a, z = (np.concatenate([c[i] for c in cols]) for i in range(4))
        yield _per_doc(d, th, a, z)


def _deal(rows: DataFrame, kind: str) -> DataFrame:
    few = rows.where(F.col("kind") == kind).select("part", "data")
    return few.repartitionById(partitions(rows.sparkSession), F.col("part")).sortWithinPartitions("part")


def spans(docs: DataFrame, *, width: int = WIDTH, hot_at: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents as (d, th, id, text), and (d, th, data): for each that has repeats the packed starts and ends of merged spans."""
    spark = docs.sparkSession
    parts = partitions(spark)
    tied = docs.groupBy(id_col).count().where("count > 1").limit(1).count() > 0
    keyed = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("d"), (F.xxhash64(text_col) if tied else F.lit(0).cast("long")).alias("th"),
        F.col(id_col).alias("id"), F.col(text_col).alias("text"),
    )
    blob = "kind string, part int, data binary"
    text_batches(spark, 1000)
    anchors = stage(keyed.select("d", "th", "text").mapInArrow(lambda it: _anchor_rows(it, parts, width), blob), "anchors")
    equal = stage(_deal(anchors, "piece").mapInArrow(lambda it: _equal_rows(it, parts, width, hot_at), blob), "equal")
    asked = _deal(equal, "ask").mapInArrow(_ask_rows, "d long, th long, data binary")
    asked = stage(asked, "asked")
    text_batches(spark, 1000)
    wanted = keyed.select("d", "th", "text").dropDuplicates(["d", "th"]) if tied else keyed.select("d", "th", "text")
    cut = stage(wanted.join(asked, ["d", "th"]).select("d", "th", "text", "data").mapInArrow(lambda it: _cut_rows(it, parts, width), blob), "cut")
    late = stage(_deal(cut, "cut").mapInArrow(lambda it: _index_rows(it, parts, width), blob), "late")
    found = stage(_deal(anchors.union(equal).union(late), "span").mapInArrow(_span_rows, "d long, th long, data binary"), "spans")
    return keyed, found


def remove(docs: DataFrame, *, width: int = WIDTH, hot_at: int = HOT, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every document; ``kept`` is the remaining bytes."""
    keyed, found = spans(docs, width=width, hot_at=hot_at, id_col=id_col, text_col=text_col)
    text_batches(docs.sparkSession, 1000)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = []
            for text, blob in zip(as_bytes(b.column(1)), b.column(2).to_pylist()):
                if blob is None:
                    out.append((len(text), 0, 0, text))
                    continue
                a, z = merge(*_unpack(blob, "<u4", "<u4"))
                edges = [0, *np.stack([a, z], axis=1).ravel().tolist(), len(text)]
                left = b"".join([text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)])
                out.append((len(text), len(text) - len(left), len(a), left))
            cols = [b.column(0), *(pa.array([x[i] for x in out], pa.int64()) for i in range(3)), pa.array([hashlib.sha256(x[3]).hexdigest() for x in out], pa.string())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([x[3] for x in out], pa.binary())] if keep else cols, names=[*names, "kept"] if keep else names)

    joined = keyed.join(found, ["d", "th"], "left").select("id", "text", "data")
    return joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep)


def op3_rindex(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove(docs, keep=False).withColumnRenamed("id", "doc_id")
