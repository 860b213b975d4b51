"""Sum-of-squares online packing of tokenised documents into fixed windows.

A document goes to the fill level whose choice gives the least sum of squared counts of
partly filled windows; the counts are kept in a level array. Only a document longer than a
window is cut on arrival.

Each scan partition is tokenised and packed on its own, in one pass. What is in windows that
are still open at its end, a few hundred of them, is not closed there: those pieces go to a
second packing by the same level array, over groups of ``GROUP_IDS`` ids from many
partitions, so the part of all ids that meets an end does not grow with the number of
partitions. At the end of a group the fullest windows are filled up with pieces, cut where
need be, of the emptiest, and the last window is cut into power-of-two lengths, so nothing
is padded.

Memory: tokens are held only for pieces in open windows. With ``max_open`` windows open, the
first packing passes the pieces of the fullest level on to the second, and the second fills
its fullest window from the emptiest; the method goes on, and nothing is dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import durable, map_batches, worker_cache

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_length long"
)
WINDOW = 2048
END_ID = 1
MAX_OPEN = 4096
#: Entries of the tokenizer's caches, about 200 bytes each. They stay in a Python worker
#: for its later tasks.
CACHED_RUNS = 400_000
CACHED_CHUNKS = 150_000
#: Ids that a task of the second packing gets, about.
GROUP_IDS = 1 << 22
#: Sequence ids of partition p are p * 2**SEQUENCE_BITS and up, those of the second packing's
#: partition p (SECOND + p) * 2**SEQUENCE_BITS and up.
SEQUENCE_BITS = 36
SECOND = 1 << 26


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Little-endian uint32 ids of whole texts, equal to the tokenizer's own encoding.

    The tokenizer drops white space and never joins across it, so a text's ids are its
    blank-separated chunks' ids. Chunks and their letter, digit and symbol runs are kept
    in caches that take no more entries once full; a chunk with anything but common Latin characters, or with part of
    a special token, is given to the tokenizer whole."""

    def __init__(self, path: str, cached_runs: int = CACHED_RUNS, cached_chunks: int = CACHED_CHUNKS):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cached_runs, self.cached_chunks = cached_runs, cached_chunks
        self.chunks: dict[str, bytes] = {"": b""}
        self.runs: dict[str, bytes] = {}
        self.plain = regex.compile(r"[\x21-\x7e\xa1-ɏ]+").fullmatch
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}

    def _run(self, run: str) -> bytes:
        text = run if run.isascii() else "".join([self.letters[b] for b in run.encode()])
        ids = np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()
        if len(self.runs) < self.cached_runs:
            self.runs[run] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        if self.plain(chunk) and "<|" not in chunk:
            lower = chunk.lower() if chunk.isascii() else "".join(map(str.lower, chunk))
            runs = self.runs
            ids = b"".join([runs.get(r) or self._run(r) for r in self.split(lower)])
        else:
            ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.chunks) < self.cached_chunks:
            self.chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        chunks = self.chunks
        try:
            return b"".join([chunks[p] for p in parts])
        except KeyError:
            return b"".join([ids if (ids := self.chunks.get(p)) is not None else self._chunk(p) for p in parts])


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer with its caches for each Python worker."""
    kept = worker_cache(__name__)
    if path not in kept:
        kept[path] = WordTokenizer(path)
    return kept[path]


class LevelPacker:
    """Windows by fill level. ``add`` yields the rows of every window it closes. With
    ``passing``, pieces of windows that cannot stay open are put into ``passed`` instead."""

    def __init__(self, window: int = WINDOW, first_id: int = 0, max_open: int = MAX_OPEN, passing: bool = False):
        self.window, self.next_id, self.max_open = window, first_id, max_open
        self.counts = np.zeros(window + 1, np.int64)
        self.levels: dict[int, list[list[tuple]]] = {}
        self.open = 0
        self.passed: list[tuple] | None = [] if passing else None
        #: Ids that were moved from an emptier window to fill a fuller one.
        self.moved = 0

    def choose(self, size: int) -> int:
        """Level (0: a new window) whose choice gives the least sum of squared counts;
        among equals the fullest."""
        last = self.window - size
        n = self.counts
        grow = 2 * n[size : last + size + 1] + 1
        grow[last] = 0  # a full window is no longer counted
        change = grow + 1 - 2 * n[: last + 1]
        change[0] = grow[0]
        usable = n[: last + 1] > 0
        usable[0] = True
        change = np.where(usable, change, np.iinfo(np.int64).max)
        return last - int(np.argmin(change[::-1]))

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        """Piece: (doc_id, start, id bytes, doc_tokens)."""
        at, total = 0, sum(len(p[2]) for p in pieces) // 4
        for doc_id, start, ids, doc_tokens in pieces:
            n = len(ids) // 4
            yield doc_id, start, n, zlib.crc32(ids), doc_tokens, self.next_id, at, total
            at += n
        self.next_id += 1

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        size = self.window * 4
        doc_tokens, cut = len(ids) // 4, len(ids) - len(ids) % size
        for i in range(0, cut, size):
            yield from self._emit([(doc_id, i // 4, ids[i : i + size], doc_tokens)])
        if cut == len(ids):
            return
        yield from self.put((doc_id, cut // 4, ids[cut:], doc_tokens))

    def put(self, piece: tuple) -> Iterator[tuple]:
        """Place a piece of fewer ids than a window."""
        n = len(piece[2]) // 4
        level = self.choose(n)
        pieces = self._pop(level) if level else []
        pieces.append(piece)
        if level + n == self.window:
            yield from self._emit(pieces)
            return
        self.levels.setdefault(level + n, []).append(pieces)
        self.counts[level + n] += 1
        self.open += 1
        if self.open >= self.max_open:
            if self.passed is None:
                yield from self._fill_fullest()
            else:
                fullest = max(self.levels)
                while fullest in self.levels:
                    self.passed += self._pop(fullest)

    def _pop(self, level: int) -> list[tuple]:
        pieces = self.levels[level].pop()
        if not self.levels[level]:
            del self.levels[level]
        self.counts[level] -= 1
        self.open -= 1
        return pieces

    def _fill_fullest(self) -> Iterator[tuple]:
        """Fill the fullest window from the emptiest ones, cutting the last piece, and close
        it; without another window it is cut into power-of-two lengths."""
        level = max(self.levels)
        pieces = self._pop(level)
        while level < self.window and self.open:
            least = min(self.levels)
            donor = self._pop(least)
            while donor and level < self.window:
                doc_id, start, ids, doc_tokens = donor.pop()
                room = (self.window - level) * 4
                # the end of the piece goes, so that the rest keeps its start
                cut = max(len(ids) - room, 0)
                if cut:
                    donor.append((doc_id, start, ids[:cut], doc_tokens))
                pieces.append((doc_id, start + cut // 4, ids[cut:], doc_tokens))
                n = (len(ids) - cut) // 4
                level, least, self.moved = level + n, least - n, self.moved + n
            if donor:
                self.levels.setdefault(least, []).append(donor)
                self.counts[least] += 1
                self.open += 1
        while level:
            length = min(self.window, 1 << level.bit_length() - 1)
            level -= length
            part, rest = [], []
            for doc_id, start, ids, doc_tokens in pieces:
                here = min(len(ids), length * 4)
                length -= here // 4
                if here:
                    part.append((doc_id, start, ids[:here], doc_tokens))
                if here < len(ids):
                    rest.append((doc_id, start + here // 4, ids[here:], doc_tokens))
            yield from self._emit(part)
            pieces = rest

    def close(self) -> Iterator[tuple]:
        """Close all windows, the fullest first."""
        while self.open:
            yield from self._fill_fullest()

    def take(self) -> list[tuple]:
        """The pieces of all open windows, and those passed before; none stay."""
        while self.levels:
            self.passed += self._pop(next(iter(self.levels)))
        out, self.passed = self.passed, []
        return out


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [part.split() for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _partition() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


_FIRST = f"{SCHEMA}, ids binary"


def _packed(batches: Iterable[pa.RecordBatch], path: str, window: int, max_open: int) -> Iterator[pa.RecordBatch]:
    """Pieces in closed windows; the others' sequence is null, their place a number of their
    own, and they bring their ids."""
    words = tokenizer(path)
    end = np.array([END_ID], "<u4").tobytes()
    packer = LevelPacker(window, _partition() << SEQUENCE_BITS, max_open, passing=True)
    passed = 0
    rows: list[tuple] = []

    def leave(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
        nonlocal passed
        for lo in range(0, len(pieces), 1000):
            out = []
            for doc_id, start, ids, doc_tokens in pieces[lo : lo + 1000]:
                out.append((doc_id, start, len(ids) // 4, None, doc_tokens, None, (_partition() << SEQUENCE_BITS) + passed, None, ids))
                passed += 1
            yield _rows(out, _FIRST)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows.extend((*r, None) for r in packer.add(doc_id, words.encode(text.as_py() or "") + end))
            if len(rows) >= 20_000:
                yield _rows(rows, _FIRST)
                rows = []
            if len(packer.passed) >= 1000:
                some, packer.passed = packer.passed, []
                yield from leave(some)
    if rows:
        yield _rows(rows, _FIRST)
    yield from leave(packer.take())


def _repacked(batches: Iterable[pa.RecordBatch], window: int, max_open: int) -> Iterator[pa.RecordBatch]:
    packer = LevelPacker(window, (SECOND + _partition()) << SEQUENCE_BITS, max_open)
    rows: list[tuple] = []
    for batch in batches:
        for piece in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            rows.extend(packer.put(piece))
        if len(rows) >= 20_000:
            yield _rows(rows, SCHEMA)
            rows = []
    rows.extend(packer.close())
    if rows:
        yield _rows(rows, SCHEMA)


def pack(
    docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, max_open: int = MAX_OPEN, group_ids: int = GROUP_IDS
) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``window`` ids.

    A null text is empty (its end id alone); a null doc_id is kept as null; repeated rows
    are packed as often as they come; an empty table gives no rows. Columns other than
    ``doc_id`` and ``text`` are ignored, whatever their names."""
    path = tokenizer_path or default_tokenizer()
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    first = durable(map_batches(narrow, lambda it: _packed(it, path, window, max_open), _FIRST))
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    left = first.where("sequence_id is null")
    total = left.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group_ids))
    # pieces are dealt by their own numbers, and their order in a group is fixed by them
    dealt = left.select("doc_id", "start", "ids", "doc_tokens", "offset").repartition(groups, F.xxhash64("offset")).sortWithinPartitions("offset")
    second = map_batches(dealt, lambda it: _repacked(it, window, max_open), SCHEMA)
    return first.where("sequence_id is not null").select(*names).unionByName(second)
