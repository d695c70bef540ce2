"""Operator 3: packing documents into sequences by Karmarkar-Karp multiway differencing.

A document's tokens are cut into full windows, which are sequences of their own, and a tail, which is cut again into
pieces of at most PIECE tokens. Tails are gathered in groups of about GROUP pieces; each group is divided into w windows
by multiway differencing: every piece starts as a partial partition of w windows, and the two partitions with the largest
imbalance are merged again and again, the fullest window of one with the emptiest of the other, until one is left, with
near-equal windows. w starts at the least number that could hold the group and rises whenever a window exceeds the
capacity. Pieces of one document that meet in a window are kept in order.

All of this happens in the task that read the documents, so packing moves no data: groups are local to a partition, at the
price of one part-filled window for each. Reruns over the same files give the same sequences.

Null and empty texts hold the end token alone. Very long texts need memory for their own ids only. Repeated rows are packed
as often as they come; only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import ship, tokenizer_path

WINDOW, END, PIECE, GROUP = 2048, 1, 512, 768
VOCABULARY = "word_bpe_49k.json"
#: Distinct chunks whose ids a worker keeps; the memory then starts anew.
CACHE = 1_200_000
#: Marks that often end a chunk of letters and are pre-tokens of their own there.
ENDINGS = b".,!?;:"
#: Documents whose new chunks are learned together.
TOGETHER = 64
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class ChunkTokenizer:
    """Ids as little-endian unsigned 32-bit bytes, chunk by chunk.

    The tokenizer never looks across ASCII white space, so the ids of a text are those of its chunks, and those of a plain
    chunk (lower-case, composed, without marks of special tokens) are those of its pre-tokens. Each distinct one is encoded
    once; new ones go through the tokenizer in one call, whose ids are cut after each token that ends a word.
    """

    #: The tokenizer's fixed pre-token pattern.
    PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks: dict[bytes, bytes] = {}
        self.split = regex.compile(self.PRETOKEN).findall
        self.odd = regex.compile(r"[^\p{L}\p{N}\p{P}\p{S}]|<\|").search
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def ids(self, text: str | None) -> bytes:
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[str | None]) -> list[bytes]:
        """Of several texts, whose new chunks are learned together."""
        known = self.chunks
        if len(known) > CACHE:
            known.clear()
        get, rows, plain, odd = known.get, [], set(), set()
        for text in texts:
            if not text:
                rows.append(([], [], []))
                continue
            folded = "Σ" not in text and is_normalized("NFC", text) and is_normalized("NFC", low := text.lower())
            parts = (low if folded else text).encode("utf-8", "replace").split()
            found = list(map(get, parts))
            missing = [i for i, x in enumerate(found) if x is None]
            (plain if folded else odd).update(parts[i] for i in missing)
            rows.append((parts, found, missing))
        if plain or odd:
            self._learn(plain, odd)
        out = []
        for parts, found, missing in rows:
            for i in missing:
                found[i] = known[parts[i]]
            out.append(b"".join(found))
        return out

    def _learn(self, plain: set[bytes], odd: set[bytes]) -> None:
        """plain: chunks of texts that are folded and composed. Pre-tokens are chunks too."""
        known = self.chunks
        for c in odd - plain:
            known[c] = self._encode(c.decode())
        new: dict[bytes, None] = {}
        cut: list[tuple[bytes, list[bytes]]] = []
        for c in plain:
            if c.isalpha():  # ASCII letters
                new[c] = None
                continue
            if c[:-1].isalpha() and c[-1] in ENDINGS:
                pieces = [c[:-1], c[-1:]]
            else:
                s = c.decode()
                if s.isalpha():
                    new[c] = None
                    continue
                if self.odd(s):
                    known[c] = self._encode(s)
                    continue
                pieces = [x.encode() for x in self.split(s)]
                if len(pieces) == 1:
                    new[c] = None
                    continue
            cut.append((c, pieces))
            for w in pieces:
                if w not in known:
                    new[w] = None
        if new:
            ids = np.asarray(self.tokenizer.encode_batch_fast([b" ".join(new).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(new) and ends[-1] == len(ids):
                raw, at = ids.tobytes(), 0
                for w, e in zip(new, (4 * ends).tolist(), strict=True):
                    known[w], at = raw[at:e], e
            else:
                known.update((w, self._encode(w.decode())) for w in new)
        for c, pieces in cut:
            known[c] = b"".join([known[w] for w in pieces])

    def _encode(self, s: str) -> bytes:
        return np.asarray(self.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()


_LOADED: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _LOADED:
        _LOADED[path] = ChunkTokenizer(path)
    return _LOADED[path]


def differencing(sizes: list[int], windows: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each piece and the windows' sums, by largest differencing over partitions of that many windows.

    A partition is kept as its sums in falling order; how its parts' windows were matched is kept in a tree of merges,
    which is walked from its root to label the pieces.
    """
    n = len(sizes)
    if windows == 1 or not n:
        return np.zeros(n, np.int64), np.array([sum(sizes)])
    sums: list[np.ndarray | None] = []
    for s in sizes:
        v = np.zeros(windows, np.int64)
        v[0] = s
        sums.append(v)
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tree: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        merged = sums[a] + sums[b][::-1]
        order = np.argsort(-merged, kind="stable")
        merged = merged[order]
        sums[a] = sums[b] = None
        sums.append(merged)
        tree.append((a, b, order))
        heapq.heappush(heap, (int(merged[-1] - merged[0]), n + len(tree) - 1))
    labels: list[np.ndarray | None] = [None] * (n + len(tree))
    root = n + len(tree) - 1
    labels[root] = np.arange(windows)
    for i in range(len(tree) - 1, -1, -1):
        a, b, order = tree[i]
        own = np.empty(windows, np.int64)
        own[order] = labels[n + i]  # by the place in the sum before sorting
        labels[a], labels[b], labels[n + i] = own, own[::-1], None
    return np.array([labels[i][0] for i in range(n)]), sums[root]


def partition(sizes: list[int], capacity: int) -> np.ndarray:
    """Windows of pieces so that none exceeds the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        place, sums = differencing(sizes, windows)
        if sums.max(initial=0) <= capacity:
            return place
        windows += max(1, int(windows * (sums.max() - capacity) // (4 * capacity)))


class Packer:
    """Rows of SCHEMA for the documents of one task."""

    def __init__(self, task: int, tok: ChunkTokenizer, window: int = WINDOW):
        self.tok, self.window, self.next, self.tails = tok, window, task << 40, []
        self.piece = max(1, min(PIECE, window // 4))

    def add(self, key, ids: bytes) -> Iterator[tuple]:
        raw = ids + END.to_bytes(4, "little")
        n, at = len(raw) // 4, 0
        while n - at >= self.window:
            yield key, at, self.window, zlib.crc32(raw[4 * at : 4 * (at + self.window)]), n, self.next, 0
            self.next, at = self.next + 1, at + self.window
        parts = -(-(n - at) // self.piece)
        for i in range(parts):
            a, b = at + (n - at) * i // parts, at + (n - at) * (i + 1) // parts
            self.tails.append((key, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), n))
        if len(self.tails) >= GROUP:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        place = partition([t[2] for t in self.tails], self.window)
        offsets: dict[int, int] = {}
        numbers: dict[int, int] = {}
        for w, t in zip(place.tolist(), self.tails, strict=True):
            number = numbers.setdefault(w, len(numbers))
            yield *t, self.next + number, offsets.get(w, 0)
            offsets[w] = offsets.get(w, 0) + t[2]
        self.next, self.tails = self.next + len(numbers), []


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset. path: a tokenizers file that all workers can read; by default the public one installed with them."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId(), tokenizer(path or tokenizer_path(VOCABULARY)), window)
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        rows: list[tuple] = []
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                for key, ids in zip(part.column(0).to_pylist(), packer.tok.ids_of(part.column(1).to_pylist()), strict=True):
                    rows += packer.add(key, ids)
                if len(rows) >= 20_000:
                    yield out(rows)
                    rows = []
        rows += packer.flush()
        if rows:
            yield out(rows)
        packer.tok.chunks.clear()  # a worker that is used again by other operators doesn't hold what this task learned

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
