"""Byte-level BPE encoding and decoding by recursive DuckDB queries per partition (operator 4).

Encoding: a text is cut by the tokenizer's pattern.  A piece that is a token
is that token.  Other pieces become token-position rows, one row per byte; a
recursive query joins neighbours with the merge table and contracts each
piece's leftmost pair of least rank, until no pair of a piece merges.

Decoding: ids join the vocabulary and an ordered aggregation concatenates the
tokens' bytes.

Each distinct piece is encoded once per task, and decoded and compared with
its bytes (a bounded cache keeps the ids, ``CACHE`` entries per worker); texts only
look pieces up.  A text's decoded bytes are its tokens' bytes in the order of its ids.  Pieces
longer than ``LONG`` bytes would need as many recursion steps over as many
rows; they merge in a small heap-driven loop with the same rule instead.

The vocabulary's path is a parameter and is read by the driver (a file of
tiktoken ranks; refused beyond ``VOCABULARY_BYTES``, so what is broadcast is bounded).
"""
from __future__ import annotations

import array
import base64
import ctypes
import heapq
import itertools
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from seqlab.llm import wordscan
from seqlab.llm.scratch import bounded_batches, with_text

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pieces up to this many bytes go through the recursive query.
LONG = 256
#: Pieces that a worker keeps.  Beyond, the later half goes: frequent pieces come early.  This changes no result.
CACHE = 300_000
#: Pieces that one recursive query contracts together.
PIECES = 10_000
VOCABULARY_BYTES = 64 << 20

#: Contracts the leftmost least-ranked pair of every piece, until none merges; the last step of a piece is its result.
CONTRACT = """
create or replace temp table done as
with recursive step(n, piece, pos, tok) as (
  select 0, piece, pos, tok from start
  union all
  (with best as (
     select l.piece, min(m.rank << 16 | l.pos) as pick
     from step l join step r on r.piece = l.piece and r.pos = l.pos + 1
     join merges m on m.pair = (l.tok << 20 | r.tok)
     group by l.piece)
   select n + 1, piece,
          case when pos > (pick & 65535) then pos - 1 else pos end,
          case when pos = (pick & 65535) then pick >> 16 else tok end
   from step join best using (piece)
   where pos <> (pick & 65535) + 1)
)
select piece, pos, tok from step join (select piece, max(n) as n from step group by piece) using (piece, n)
"""
#: Ordered aggregation of (sequence, pos, tok) rows: the ids as text and the decoded bytes as hex.
GATHER = """
select {seq} as seq, list(tok order by pos) as ids, string_agg(v.hex, '' order by pos) as bytes
from {rows} join vocab v using (tok) group by {seq} order by {seq}
"""


def read_ranks(path: str) -> bytes:
    """The content of a rank file, if it is no larger than a vocabulary can be."""
    with open(path, "rb") as f:
        content = f.read(VOCABULARY_BYTES + 1)
    if len(content) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    return content


class Codec:
    """One worker's vocabulary and cache of pieces, and one task's DuckDB connection with merge table and vocabulary."""

    def __init__(self, content: bytes, pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, content.splitlines()) if t}
        self.tokens = {r: t for t, r in self.ranks.items()}
        if max(self.tokens, default=0) >= 1 << 20:
            raise ValueError("ranks must be below 2 ** 20")
        self.byte = [self.ranks.get(bytes([i])) for i in range(256)]
        pair, rank = array.array("q"), array.array("q")  # compact: what building leaves behind stays with the worker
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                if t[:i] in self.ranks and t[i:] in self.ranks:
                    pair.append(self.ranks[t[:i]] << 20 | self.ranks[t[i:]])
                    rank.append(r)
        self.merges = {"pair": pa.array(np.asarray(pair)), "rank": pa.array(np.asarray(rank))}
        self.connection = None
        self.pieces: dict[bytes, bytes] = {}
        size = np.zeros(max(self.tokens, default=0) + 1, np.int64)  # bytes of each token, and where they start
        for r, t in self.tokens.items():
            size[r] = len(t)
        self.size, self.start = size, np.cumsum(size) - size
        self.flat = np.frombuffer(b"".join(self.tokens[r] for r in sorted(self.tokens)), np.uint8)

    @property
    def db(self):
        """The connection, opened with merge table and vocabulary when it is needed."""
        if self.connection is None:
            import duckdb
            self.connection = duckdb.connect(config={"threads": 1, "memory_limit": "128MB"})
            self._table("merges", **self.merges)
            self._table("vocab", tok=pa.array(self.tokens, pa.int64()), hex=pa.array([t.hex() for t in self.tokens.values()]))
        return self.connection

    def rest(self) -> None:
        """After a task: vocabulary and cache stay with the worker, the connection's memory would weigh on whatever runs there next."""
        if self.connection is not None:
            self.connection.close()
        self.connection = None

    def _table(self, name: str, **columns) -> None:
        self.db.register("arrow_rows", pa.table(columns))
        self.db.execute(f"create or replace temp table {name} as select * from arrow_rows")
        self.db.unregister("arrow_rows")

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same contraction for one long piece: neighbours in linked lists, pairs in a heap."""
        part = [bytes([b]) for b in piece]
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap = [(self.ranks[p + q], i, p + q) for i, (p, q) in enumerate(zip(part, part[1:], strict=False))
                if p + q in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= len(part) or part[i] + part[j] != both:
                continue
            part[i], part[j], after[i] = both, None, after[j]
            if after[i] < len(part):
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else len(part)
                if right < len(part) and (pair := part[left] + part[right]) in self.ranks:
                    heapq.heappush(heap, (self.ranks[pair], left, pair))
        return [self.ranks[p] for p in part if p is not None]

    def _encode_pieces(self, pieces: list[bytes]) -> None:
        """Put the ids of new pieces into the cache, as int32 bytes, and check that they decode to the piece."""
        for lo in range(0, len(pieces), PIECES):
            part = pieces[lo:lo + PIECES]
            ids: list[list[int] | None] = [None] * len(part)
            queued = []
            for i, b in enumerate(part):
                if b in self.ranks:
                    ids[i] = [self.ranks[b]]
                elif len(b) > LONG:
                    ids[i] = self._merge_long(b)
                else:
                    queued.append(i)
            if queued:
                n = np.array([len(part[i]) for i in queued])
                piece = np.repeat(np.array(queued), n)
                pos = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
                flat = np.frombuffer(b"".join(part[i] for i in queued), np.uint8)
                self._table("start", piece=pa.array(piece.astype(np.int32)), pos=pa.array(pos.astype(np.int32)),
                            tok=pa.array(np.array(self.byte, np.int64)[flat]))
                self.db.execute(CONTRACT)
                for i, found, text in self.db.execute(GATHER.format(seq="piece", rows="done")).fetchall():
                    self._keep(part[i], found, bytes.fromhex(text))
            whole = [i for i in range(len(part)) if ids[i] is not None]
            for i, decoded in zip(whole, self.decode([ids[i] for i in whole]), strict=True):
                self._keep(part[i], ids[i], decoded)

    def _keep(self, piece: bytes, ids: list[int], decoded: bytes) -> None:
        if decoded != piece:
            raise ValueError(f"{piece!r} decodes to {decoded!r}")
        self.pieces[piece] = array.array("i", ids).tobytes()

    def decode(self, sequences: list[list[int]]) -> list[bytes]:
        """Bytes of every id sequence, by ordered aggregation; an id outside the vocabulary is an error."""
        out = [b""] * len(sequences)
        rows = [(i, j, t) for i, s in enumerate(sequences) for j, t in enumerate(s)]
        if rows:
            if missing := {t for _, _, t in rows} - self.tokens.keys():
                raise ValueError(f"ids outside the vocabulary: {sorted(missing)[:5]}")
            a, b, c = zip(*rows, strict=True)
            self._table("given", seq=pa.array(a, pa.int64()), pos=pa.array(b, pa.int64()), tok=pa.array(c, pa.int64()))
            for i, _, text in self.db.execute(GATHER.format(seq="seq", rows="given")).fetchall():
                out[i] = bytes.fromhex(text)
        return out

    def _cut(self, segment: bytes) -> list[bytes]:
        return [p.encode("utf-8") for p in self.pattern.findall(segment.decode("utf-8"))]

    def _segments(self, segments: list[bytes]) -> list[bytes]:
        """Ids (as int32 bytes) of every segment, cut by the pattern."""
        cuts = {s: self._cut(s) for s in segments if s not in self.pieces}
        new = {p for c in cuts.values() for p in c} - self.pieces.keys()
        if len(self.pieces) + len(new) > CACHE:
            self.pieces = dict(itertools.islice(self.pieces.items(), CACHE // 2))
            cuts = {s: cuts.get(s) or self._cut(s) for s in segments if s not in self.pieces}
            new = {p for c in cuts.values() for p in c} - self.pieces.keys()
        self._encode_pieces(list(new))
        get = self.pieces.__getitem__
        return [b"".join(map(get, cuts[s])) if s in cuts else get(s) for s in segments]

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids one after the other, and the offset of each id and of the end."""
        return _runs(self.flat, self.start, self.size, ids)

    def texts(self, raw: np.ndarray, offsets: np.ndarray):
        """Flat ids with offsets and flat decoded bytes with offsets, of all texts of a buffer.

        The texts are cut into segments (``segment_starts``), each distinct segment
        is looked up once, and the ids are put together in text order; the decoded
        bytes are those of the ids so put together.
        """
        at = segment_starts(raw, offsets)
        end = np.r_[at[1:], len(raw)]
        first = np.searchsorted(at, offsets, "left")
        _, example, which = np.unique(wordscan.span_hash(raw, at, end), return_index=True, return_inverse=True)
        body = raw.tobytes()
        flat, flat_at = _gather(self._segments([body[at[i]:end[i]] for i in example]), which, 4)
        flat = flat.view(np.int32)
        text, text_at = self.bytes_of(flat)
        if not np.array_equal(text, raw):  # two segments with one hash: look up each for itself
            flat, flat_at = _gather(self._segments([body[a:e] for a, e in zip(at, end, strict=True)]), np.arange(len(at)), 4)
            flat = flat.view(np.int32)
            text, text_at = self.bytes_of(flat)
        ids_at = flat_at[first] // 4
        return flat, ids_at, text, text_at[ids_at]


#: Bytes of one group of texts that a task handles together.
GROUP = 2 << 20
#: First bytes of white space beyond ASCII, each with what may follow (fixed values of Unicode's White_Space).
WIDE_BLANKS = [
    (b"\xc2", [b"\x85", b"\xa0"]),
    (b"\xe1", [b"\x9a\x80"]),
    (b"\xe2", [*(bytes([0x80, x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\x81\x9f"]),
    (b"\xe3", [b"\x80\x80"]),
]


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a:b + 1] = True
    return table


#: Bytes that may be white space to the pattern, those that surely are, ASCII letters and digits, and punctuation.
_BLANK, _SURE_BLANK = _bytes((0x09, 0x0D), (0x1C, 0x20)), _bytes((0x09, 0x0D), (0x20, 0x20))
_ALNUM = _bytes((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
_MARK = _bytes((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


def segment_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of segments, at places where the pattern has a boundary whatever stands further off.

    These are every text's start, a white-space character that stands alone
    (a token holds white space only at its front or among more of it), what
    follows such a character if it is no space, and ASCII punctuation after an
    ASCII letter or digit.
    """
    blank = np.zeros(len(raw) + 2, bool)
    blank[1:-1] = _BLANK[raw]
    for lead, tails in WIDE_BLANKS:
        for i in np.flatnonzero(raw == lead[0]) if lead in raw.tobytes() else ():
            tail = raw[i + 1:i + 3].tobytes()
            for t in tails:
                if tail.startswith(t):
                    blank[i + 1:i + 2 + len(t)] = True
    before, here, after = blank[:-2], _SURE_BLANK[raw] & blank[1:-1], blank[2:]
    alone = here & ~before & ~after
    cut = alone.copy()
    cut[1:] |= alone[:-1] & (raw[:-1] != 0x20)
    cut[1:] |= _MARK[raw[1:]] & _ALNUM[raw[:-1]]
    inside = offsets[(offsets > 0) & (offsets < len(raw))]
    cut[inside] = True
    if len(raw):
        cut[0] = True
    return np.flatnonzero(cut)


#: Runs that are copied at one time: an index holds eight bytes for each byte of text, so it covers a part only.
RUNS = 1 << 15


def _runs(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``flat`` one after the other, and the offset of each and of the end."""
    at = np.zeros(len(which) + 1, np.int64)
    np.cumsum(size[which], out=at[1:])
    out = np.empty(at[-1], flat.dtype)
    for lo in range(0, len(which), RUNS):
        part, here = which[lo:lo + RUNS], at[lo:lo + RUNS + 1]
        index = np.repeat(start[part] - here[:-1], np.diff(here))
        index += np.arange(here[0], here[-1])
        out[here[0]:here[-1]] = flat[index]
    return out, at


def _gather(values: list[bytes], which: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ``values[which]`` one after the other, in units of ``width``, and the offset of each and of the end."""
    size = np.fromiter(map(len, values), np.int64, len(values)) // width
    flat = np.frombuffer(b"".join(values), np.dtype(f"u{width}"))
    out, at = _runs(flat, np.cumsum(size) - size, size, which)
    return out, at * width


def _codec(content: bytes, pattern: str) -> Codec:
    """This worker's codec; it stays between tasks."""
    held = sys.__dict__.setdefault("_seqlab_llm_codecs", {})
    key = (hash(content), pattern)
    if key not in held:
        held.clear()
        held[key] = Codec(content, pattern)
    return held[key]


#: glibc's names of two settings; blocks from ``BLOCK`` bytes on go back to the system when they are freed.
#: ``USUAL`` is what the library comes to by itself, as blocks are freed; other operators run faster with it.
M_TRIM_THRESHOLD, M_MMAP_THRESHOLD, BLOCK, USUAL = -1, -3, 1 << 20, 32 << 20


def _freed_at(size: int) -> None:
    """Let this process give freed blocks of ``size`` bytes or more back, where the C library has the settings."""
    setting = getattr(ctypes.CDLL(None), "mallopt", None)
    if setting:
        setting(M_MMAP_THRESHOLD, size)
        setting(M_TRIM_THRESHOLD, 2 * size)


def _groups(offsets: np.ndarray, most: int):
    """Ranges of rows with about ``most`` units each, at least one row."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def encode(df: DataFrame, ranks_path: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns with ``ids`` (array<int>) and ``decoded`` (binary, the ids' bytes) of whole texts.

    Special tokens are ordinary text.  A null text counts as empty: no ids.
    Columns of ``df`` that are not kept are ignored; a kept column named
    ``ids`` or ``decoded`` gives way to the result.
    """
    keep = [c for c in keep if c not in ("ids", "decoded")]
    rows, place = with_text(df, keep, text)
    held = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        codec = _codec(held.value, pattern)
        _freed_at(BLOCK)
        try:
            for batch in batches:
                raw, offsets, _ = wordscan.text_buffer(batch.column(place))
                for lo, hi in _groups(offsets, GROUP):
                    ids, ids_at, decoded, decoded_at = codec.texts(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(i).slice(lo, hi - lo) for i in range(len(keep))),
                         pa.ListArray.from_arrays(pa.array(ids_at, pa.int32()), pa.array(ids)),
                         pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [
                             None, pa.py_buffer(decoded_at.astype(np.int32)), pa.py_buffer(decoded.tobytes())])],
                        [*keep, "ids", "decoded"])
        finally:
            codec.rest()
            _freed_at(USUAL)

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "ids array<int>", "decoded binary"])
    return rows.mapInArrow(wordscan.trimmed(run), schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """The ``keep`` columns with ``decoded``: the bytes of each row's id array; null or empty ids give empty bytes."""
    bounded_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        codec = _codec(held.value, pattern)
        try:
            for batch in batches:
                rows = batch.column(len(keep)).to_pylist()
                for lo, hi in _groups(np.cumsum([0, *(len(r or ()) for r in rows)]), 200_000):
                    done = codec.decode([r or [] for r in rows[lo:hi]])
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(i).slice(lo, hi - lo) for i in range(len(keep))), pa.array(done, pa.binary())],
                        [*keep, "decoded"])
        finally:
            codec.rest()

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "decoded binary"])
    return df.select(*keep, df[ids].alias("__ids")).mapInArrow(wordscan.trimmed(run), schema)
