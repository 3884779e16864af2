"""Encoding of the whole corpus with a public byte-level BPE vocabulary (problem 6).

Pre-tokenisation is vectorised over a whole Arrow batch and uses no regular expression. A table gives each
code point its class. What a character does to the state of the reader (in letters, in numbers, after a
blank, after an apostrophe that began a token, ...) is a transition function, a row of ten states; such
functions compose associatively, so the states at all positions come from a scan: functions are composed
within blocks side by side, then over the blocks, then applied within them. A text's first character has
a constant function, so texts laid end to end are scanned as one. Boundaries follow from the states left and
right of a position:

* a token goes on while its kind does; a run of white space before something else ends one character early,
  and that last character joins the next token if it is a blank, else stands alone;
* an apostrophe that begins a token takes s, t, m, d, re, ve or ll with it, after which a new one begins.

The slices between boundaries feed a cache of merged pieces; only pieces not seen before are merged.
Every token's byte offset is kept on demand, and decoding restores the text exactly. Tables and cache are kept
by the worker from task to task.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.sources.worker import kept

#: Where the rank file of the vocabulary lies.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Classes of code points: blanks, apostrophes and the letters that may follow one stand apart.
OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE, ONE, RV, L, E = range(10)
_LETTERS = (LETTER, ONE, RV, L, E)
#: States of the reader: at the start, in a token of a kind, after white space or a blank, after an apostrophe that began a token,
#: after r or v, or l, behind one, and after all that it takes.
START, WORD, DIGITS, WHITE, LED, SIGNS, QUOTED, QUOTED_RV, QUOTED_L, TAKEN = range(10)
#: Positions whose functions are composed one after another; blocks go side by side.
BLOCK = 64
#: Pieces remembered in a task, and code points handled at once.
CACHE = 400_000
CHUNK = 2_000_000

# Fixed values of the split pattern: white space, and what an apostrophe may take with it.
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_AFTER_QUOTE = {ONE: "stmd", RV: "rv", L: "l", E: "e"}


def class_table() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    table[_SPACES] = SPACE
    table[[32, 39]] = BLANK, QUOTE
    for kind, letters in _AFTER_QUOTE.items():
        table[[ord(c) for c in letters]] = kind
    return table


def step(state: int, kind: int) -> int:
    """The reader's next state."""
    if kind in _LETTERS:
        if state == QUOTED:
            return {ONE: TAKEN, RV: QUOTED_RV, L: QUOTED_L}.get(kind, WORD)
        return TAKEN if (state, kind) in ((QUOTED_RV, E), (QUOTED_L, L)) else WORD
    if kind == QUOTE:
        return SIGNS if state in (SIGNS, LED, QUOTED) else QUOTED
    return {NUMBER: DIGITS, SPACE: WHITE, BLANK: LED, OTHER: SIGNS}[kind]


#: The transition function of each class, and of a class at the start of a text.
FUNCTIONS = np.array([[step(s, k) for s in range(10)] for k in range(10)] + [[step(START, k)] * 10 for k in range(10)], np.uint8)


def states(functions: np.ndarray) -> np.ndarray:
    """The state after each position: the scan of transition functions (n, 10), from ``START``."""
    n, width = functions.shape
    if n <= BLOCK:
        out, s = np.empty(n, np.uint8), START
        for k in range(n):
            s = out[k] = functions[k, s]
        return out
    rows = -(-n // BLOCK)
    padded = np.concatenate([functions, np.tile(np.arange(width, dtype=np.uint8), (rows * BLOCK - n, 1))]) if rows * BLOCK > n else functions
    flat = padded.reshape(rows, BLOCK * width)
    base = np.arange(rows)[:, None] * (BLOCK * width)
    line, whole = flat.ravel(), flat[:, :width]
    for k in range(1, BLOCK):
        whole = line[base + k * width + whole]
    before = np.concatenate([[np.uint8(START)], states(whole)[:-1]])
    out = np.empty((rows, BLOCK), np.uint8)
    base = base.ravel()
    for k in range(BLOCK):
        before = out[:, k] = line[base + k * width + before]
    return out.ravel()[:n]


#: Whether a character of a class goes on with the token that a state is in.
_GOES_ON = np.zeros((10, 10), bool)
for _k in _LETTERS:
    _GOES_ON[[WORD, LED, QUOTED_RV, QUOTED_L], _k] = True
_GOES_ON[[DIGITS, LED], NUMBER] = True
for _k in (OTHER, QUOTE):
    _GOES_ON[[SIGNS, QUOTED, LED], _k] = True
for _k in (SPACE, BLANK):
    _GOES_ON[[WHITE, LED], _k] = True


def boundaries(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Start positions of the pieces of texts laid end to end; ``first`` marks each text's first code point."""
    kind = classes[points]
    state = states(FUNCTIONS[kind + 10 * first.astype(np.uint8)])
    left = np.empty_like(state)
    left[0], left[1:] = START, state[:-1]
    start = first | ~_GOES_ON[left, kind]
    inner = np.zeros(len(kind), bool)  # followed by a character of the same text
    inner[:-1] = ~first[1:]
    after = np.append(state[1:], np.uint8(START))
    white = (kind == SPACE) | (kind == BLANK)
    start |= white & inner & ~np.append(white[1:], True)
    # what an apostrophe takes: at once, or with the letter after it
    quoted = left == QUOTED
    start &= ~(quoted & ~first & ((state == TAKEN) | ((state == QUOTED_RV) | (state == QUOTED_L)) & inner & (after == TAKEN)))
    return np.flatnonzero(start)


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merging, lowest rank first and leftmost among equals, in O(n log n)."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    part = [piece[i : i + 1] for i in range(n)]
    nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or len(part[i]) + len(part[j]) != size:
            continue
        part[i] += part[j]
        alive[j] = False
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        for a, b in ((i, nxt[i]), (prv[i], i)):
            if a >= 0 and b < n and (r := ranks.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (r, a, len(part[a]) + len(part[b])))
    return [ranks[part[i]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes batches of texts with a cache of merged pieces."""

    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray):
        self.ranks, self.classes = ranks, classes
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat: list[int] = []
        self.sizes: list[int] = []

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each text); null and empty texts have none."""
        lengths = np.array([len(t) if t else 0 for t in texts], np.int64)
        big = "".join(t for t in texts if t)
        if not big:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.concatenate([[0], np.cumsum(lengths)])
        first = np.zeros(len(points), bool)
        first[begin[:-1][lengths > 0]] = True
        starts = boundaries(points, first, self.classes)
        edges = [*starts.tolist(), len(big)]
        pieces = [big[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        if len(self.index) > CACHE:
            self.clear()
        for p in set(pieces).difference(self.index):
            ids = merge(p.encode("utf-8", "surrogatepass"), self.ranks)
            self.index[p] = len(self.sizes)
            self.flat.extend(ids)
            self.sizes.append(len(ids))
        which = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        sizes = np.array(self.sizes, np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        count = sizes[which]
        total = np.cumsum(count)
        ids = np.array(self.flat, np.int32)[np.repeat(at[which] - (total - count), count) + np.arange(total[-1])]
        # pieces never cross texts, so a text's ids end where its last piece's do
        ahead = np.concatenate([[0], total])
        per_text = np.diff(ahead[np.searchsorted(starts, begin)])
        return ids, per_text


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for k, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= CHUNK:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS, offsets: bool = False) -> DataFrame:
    """(id, ids[, offsets]) of every row; empty and null texts give empty lists.

    What looks like a special token is plain text. With ``offsets`` each token's byte offset in the
    UTF-8 text is added. Whole texts, no shuffle: work and memory follow the partitions of the scan.
    """
    sc = documents.sparkSession.sparkContext
    with open(path, "rb") as f:
        shipped = sc.broadcast(f.read())  # one vocabulary, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = shipped.value
        encoder = kept(("encoder", len(data), zlib.crc32(data)), lambda: Encoder(read_ranks(data), class_table()))
        ranks = encoder.ranks
        widths = None
        if offsets:
            widths = np.zeros(max(ranks.values()) + 1, np.int32)
            for b, r in ranks.items():
                widths[r] = len(b)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _chunks(texts):
                ids, count = encoder(texts[lo:hi])
                ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                cols = [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
                if offsets:
                    through = np.cumsum(widths[ids], dtype=np.int64) if len(ids) else np.empty(0, np.int64)
                    before = through - widths[ids]
                    base = np.repeat(np.concatenate([before, [0]])[ends[:-1]], count)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array((before - base).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "ids", "offsets"][: len(cols)])

    kind = dict(documents.dtypes)[id_col]
    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + (", offsets array<int>" if offsets else ""))


def decode(encoded: DataFrame, id_col: str = "doc_id", path: str = RANKS) -> DataFrame:
    """(id, text): the inverse of ``encode``; empty lists give empty texts, null lists null."""
    sc = encoded.sparkSession.sparkContext
    with open(path, "rb") as f:
        shipped = sc.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {r: b for b, r in read_ranks(shipped.value).items()}
        for batch in batches:
            texts = [None if x is None else b"".join(names[i] for i in x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")


def token_counts(documents: DataFrame, by: str, path: str = RANKS) -> DataFrame:
    """(by, documents, tokens): the corpus's size in tokens by a column of ``documents``."""
    encoded = encode(documents, path=path).select("doc_id", F.size("ids").cast("bigint").alias("n"))
    return documents.select("doc_id", by).join(encoded, "doc_id").groupBy(by).agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"))
