"""Alignment of two tokenizers by the bytes at which their tokens end.

A text is encoded by a byte-level BPE (A) and a piece BPE with byte fallback (B),
both of space + text. The ends of each one's tokens are bits of a packed bitset
over the bytes of many texts; the AND of the two bitsets is the cuts they share.
Cuts divide both token sequences into groups: the popcount rank of a cut in
either bitset says how many tokens have ended there, which gives the group's range
of tokens and, as its last tokens end together, the link of the two. Every token has
a byte at least (checked when a vocabulary is loaded), so one token of each
side ends at a cut, and a cut is one link.

Counts of id pairs are over the whole corpus. A task deals with chunks of about
CHUNK_BYTES of text: it numbers a chunk's distinct pairs, keeps of each text its
pairs' numbers and how often each is linked, and only a chunk's distinct pairs are
shuffled and counted, so a frequent pair is one row of a chunk. The counts come
back to the chunk, whose texts then look their pairs up. A task holds one chunk's
distinct pairs at a time, whatever the number of texts.

Both tokenizers are the libraries' own. A token or piece goes across a space only at its start
(of the pieces that is checked; the byte-level rule says so), so a text is cut before each
space that stands between two other characters, and a task remembers the ids of the
words it has met (at most CACHE).

Texts that are null or empty, or whose tokens' bytes are not those of space + text (a U+2581
in the text, which decodes as a space), have no tokens: zeros and '' for the digest.
Repeated rows each get their row and count in the corpus. Rows without id keep a null id.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfin.llm.shared import staged, tuned
from quillfin.llm.words import pieces as cut_batches
from quillfin.llm.words import ranges

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_BYTES = 4_000_000
#: Distinct pairs of a chunk in a row of the staged table.
PAIRS_OF_ROW = 4_096
CACHE = 400_000
SPACE = "▁"
U = np.uint64
#: In front of a space that stands between two characters other than white space.
_CUT = re.compile(r"(?<=\S)(?= \S)")


def _byte_letters() -> dict[str, int]:
    """The letter of each byte in a byte-level vocabulary: printable Latin-1 characters stand for themselves, the others, in order, for U+0100 and on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@dataclass
class Bytes:
    """The bytes of every id of a vocabulary in one array."""

    begin: np.ndarray
    size: np.ndarray
    letters: np.ndarray

    @classmethod
    def of(cls, entries: list[bytes]) -> Bytes:
        size = np.array([len(e) for e in entries], np.int64)
        return cls(np.cumsum(size) - size, size, np.frombuffer(b"".join(entries), np.uint8))

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        end = np.cumsum(size)
        return self.letters[np.arange(end[-1] if len(end) else 0) + np.repeat(self.begin[ids] - (end - size), size)]


class Ids:
    """The ids of words by their number, in one array that grows."""

    def __init__(self):
        self.flat, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, lists: list) -> None:
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(lists), np.int32)])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(x) for x in lists])])

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each word has."""
        at, _ = ranges(self.begin[numbers], self.begin[numbers + 1])
        return self.flat[at], self.begin[numbers + 1] - self.begin[numbers]


class Pair:
    """Two tokenizers made from the contents of their files, the bytes of their ids and the words met so far."""

    def __init__(self, byte_level: str, pieces: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True  # their strings in a text are text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        byte_of = _byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        special = {t["id"] for t in json.loads(byte_level).get("added_tokens", [])}
        entries = [b""] * (max(vocabulary.values()) + 1)
        for letters, i in vocabulary.items():
            entries[i] = letters.encode() if i in special else bytes(byte_of[c] for c in letters)
        piece = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in piece):
            raise ValueError("a piece goes across a space")
        self.bytes_a = Bytes.of(entries)
        self.bytes_b = Bytes.of([bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(piece)])
        if not all(entries[i] for i in vocabulary.values()) or not self.bytes_b.size.all():
            raise ValueError("a token without bytes")
        # Ids as written in groups: inside a list, at the end of A's list, at the end of a group.
        self.ids = max(len(entries), len(piece))
        self.written = [f"{i}{mark}" for mark in ",|;" for i in range(self.ids)]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids_a, self.ids_b = Ids(), Ids()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids by A of all texts one after the other, how many each text has, and the same by B."""
        words = [_CUT.split(" " + t) for t in texts]
        if len(self.known) > CACHE or len(self.ids_a.flat) > 16 * CACHE:
            self._forget()
        known = self.known
        every = list(chain.from_iterable(words))
        numbers = list(map(known.get, every))
        if None in numbers:
            new = list(dict.fromkeys(w for w, k in zip(every, numbers) if k is None))
            self.ids_a.add([x.ids for x in self.a.encode_batch_fast(new, add_special_tokens=False)])
            self.ids_b.add(self.b.encode([w[1:] for w in new], num_threads=1))
            known.update(zip(new, range(len(known), len(known) + len(new))))
            numbers = list(map(known.__getitem__, every))
        numbers = np.array(numbers, np.int64)
        first = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
        out = []
        for side in (self.ids_a, self.ids_b):
            flat, size = side.of(numbers)
            out += [flat, _spans(size, first)]
        return tuple(out)


class Bitset:
    """Packed marks of positions, with the count of marks before each word of 64."""

    def __init__(self, words: np.ndarray):
        self.words = words
        count = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(count) - count

    @classmethod
    def marking(cls, positions: np.ndarray, n: int) -> Bitset:
        flags = np.zeros(-(-n // 64) * 64, bool)
        flags[positions] = True
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def __and__(self, other: Bitset) -> Bitset:
        return Bitset(self.words & other.words)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many marks stand at or before each position."""
        word = at >> 6
        upto = U(0xFFFFFFFFFFFFFFFF) >> (63 - (at & 63)).astype(U)
        return self.before[word] + np.bitwise_count(self.words[word] & upto)

    def select(self) -> np.ndarray:
        """The positions of all marks."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n bytes and the last bytes of the tokens of both sides: the last bytes they share, and the number of tokens of A and of B that have ended at each."""
    a, b = Bitset.marking(ends_a, n), Bitset.marking(ends_b, n)
    cuts = (a & b).select()
    return cuts, a.rank(cuts), b.rank(cuts)


@dataclass
class Aligned:
    """What a run of texts has: of each text its tokens, groups and digest; of each link the text and the key a << 32 | b."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]
    cuts: np.ndarray
    keys: np.ndarray


def _spans(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def align_texts(pair: Pair, texts: list[str | None]) -> Aligned:
    some = np.array([bool(t) for t in texts], bool)
    spaced = [b" " + t.encode() for t in texts if t]
    want = np.zeros(len(texts), np.int64)
    want[some] = [len(x) for x in spaced]
    flat_a, n_a, flat_b, n_b = pair.encode([t for t in texts if t])
    flat, number = [flat_a, flat_b], [np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)]
    number[0][some], number[1][some] = n_a, n_b
    books = (pair.bytes_a, pair.bytes_b)
    first = [np.concatenate([[0], np.cumsum(n)]) for n in number]
    size = [book.size[f] for book, f in zip(books, flat)]
    good = some & (_spans(size[0], first[0]) == want) & (_spans(size[1], first[1]) == want)
    # Texts of right lengths are compared byte by byte.
    text = np.frombuffer(b"".join([x for x, g in zip(spaced, good[some]) if g]), np.uint8)
    last = np.cumsum(np.where(good, want, 0))
    for book, f, n in zip(books, flat, number):
        differ = np.flatnonzero(book.joined(f[np.repeat(good, n)]) != text)
        if len(differ):
            good = good.copy()
            good[np.unique(np.searchsorted(last, differ, side="right"))] = False
            return align_texts(pair, [t if g else None for t, g in zip(texts, good)])
    flat = [f[np.repeat(good, n)] for f, n in zip(flat, number)]
    number = [np.where(good, n, 0) for n in number]
    size = [book.size[f] for book, f in zip(books, flat)]
    cuts, ended_a, ended_b = shared_cuts(np.cumsum(size[0]) - 1, np.cumsum(size[1]) - 1, int(last[-1]) if len(last) else 0)
    at = np.concatenate([[0], np.searchsorted(cuts, last)])  # first cut of each text
    n_groups = np.diff(at)
    began_a, began_b = ended_a - np.diff(ended_a, prepend=0), ended_b - np.diff(ended_b, prepend=0)
    group_a, group_b = np.repeat(np.arange(len(cuts)), ended_a - began_a), np.repeat(np.arange(len(cuts)), ended_b - began_b)
    # In a1,a2|b1;a3|b2,b3 an A token comes after the B tokens of the groups before, a B token after the A tokens of its own group too.
    written = np.zeros(len(flat[0]) + len(flat[1]), np.int32)
    closed_a, closed_b = flat[0].copy(), flat[1].copy()
    closed_a[ended_a - 1] += pair.ids
    closed_b[ended_b - 1] += 2 * pair.ids
    written[np.arange(len(flat[0])) + began_b[group_a]] = closed_a
    written[np.arange(len(flat[1])) + ended_a[group_b]] = closed_b
    edge = np.concatenate([[0], np.cumsum(number[0] + number[1])]).tolist()
    parts = list(map(pair.written.__getitem__, written.tolist()))
    groups = ["".join(parts[x:y])[:-1] for x, y in zip(edge, edge[1:])]
    start = last - np.where(good, want, 0)
    offsets = cuts + 1 - np.repeat(start, n_groups)
    keys = flat[0][ended_a - 1].astype(np.int64) << 32 | flat[1][ended_b - 1]
    return Aligned(number[0], number[1], n_groups, groups, offsets, keys)


_pair: list = []


def _pair_of(files_) -> Pair:
    """The worker's tokenizers for a broadcast pair of files, kept from task to task."""
    if not _pair or _pair[0] is not files_.value:
        _pair[:] = [files_.value, Pair(*files_.value)]
    return _pair[1]


def _lists(values: np.ndarray, sizes, kind=pa.int32()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


STAGED = "chunk long, place int, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, a array<int>, b array<int>, at array<int>, n array<int>"


def _numbered(files_):
    """Rows of texts (place 1: at, the numbers of the chunk's pairs that it has, and n, how often) and rows of a chunk's distinct pairs (place 0: at, their numbers; a, b; n)."""

    def flush(chunk: int, ids: list, parts: list[Aligned]) -> Iterator[pa.RecordBatch]:
        keys, inverse, count = np.unique(np.concatenate([p.keys for p in parts]), return_inverse=True, return_counts=True)
        links = np.concatenate([p.n_groups for p in parts])
        of = np.repeat(np.arange(len(links)), links)
        mine, n = np.unique(of * max(1, len(keys)) + inverse, return_counts=True)
        doc, at = np.divmod(mine, max(1, len(keys)))
        col = lambda name: pa.array(np.concatenate([getattr(p, name) for p in parts]), pa.int64())
        k, empty = len(links), pa.nulls(len(links), pa.list_(pa.int32()))
        sha = pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for p in parts for g in p.groups], pa.string())
        sizes = np.bincount(doc, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, chunk)), pa.array(np.ones(k, np.int32)), pa.chunked_array(ids).combine_chunks(), col("n_a"), col("n_b"), col("n_groups"), sha, empty, empty, _lists(at, sizes), _lists(n, sizes)], schema=schema)
        for lo in range(0, len(keys), PAIRS_OF_ROW):
            part = slice(lo, lo + PAIRS_OF_ROW)
            size = [len(keys[part])]
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([0], pa.int32()), *none, _lists(keys[part] >> 32, size), _lists(keys[part] & 0xFFFFFFFF, size), _lists(np.arange(lo, lo + size[0]), size), _lists(count[part], size)], schema=schema)

    lists = pa.list_(pa.int32())
    schema = pa.schema([("chunk", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("a", lists), ("b", lists), ("at", lists), ("n", lists)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair_of(files_)
        chunk = TaskContext.get().partitionId() << 32
        ids, parts, held = [], [], 0
        for b in cut_batches(batches, "text"):
            parts.append(align_texts(pair, b.column("text").to_pylist()))
            ids.append(b.column("doc_id"))
            held += b.column("text").nbytes
            if held >= CHUNK_BYTES:
                yield from flush(chunk, ids, parts)
                chunk, ids, parts, held = chunk + 1, [], [], 0
        if parts:
            yield from flush(chunk, ids, parts)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by chunk: its pairs with their counts in order of their numbers, then its texts."""
    chunk, counts, best, sealed = None, [], [], None
    for b in batches:
        if not b.num_rows:
            continue
        chunks, place = b.column("chunk").to_numpy(), b.column("place").to_numpy()
        turn = (np.flatnonzero((np.diff(chunks) != 0) | (np.diff(place) != 0)) + 1).tolist()
        for lo, hi in zip([0, *turn], [*turn, b.num_rows]):
            part = b.slice(lo, hi - lo)
            if chunk != chunks[lo]:
                chunk, counts, best, sealed = chunks[lo], [], [], None
            if place[lo] == 0:
                counts.append(part.column("pair_count").to_numpy())
                best.append(part.column("is_best").to_numpy(zero_copy_only=False))
                continue
            if sealed is None:
                sealed = (np.concatenate(counts), np.concatenate(best)) if counts else (np.zeros(0, np.int64), np.zeros(0, bool))
            at, n = part.column("at"), part.column("n")
            edge = at.offsets.to_numpy().astype(np.int64)
            number, times = at.values.to_numpy()[edge[0] : edge[-1]], n.values.to_numpy()[edge[0] : edge[-1]].astype(np.int64)
            sums = [pa.array(_spans(v, edge - edge[0])) for v in (times, times * sealed[1][number], times * sealed[0][number])]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")), *sums, part.column("groups_sha256")], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def _files(docs: DataFrame, byte_level: str, pieces: str):
    """The contents of both files, a few MB, which executors need not have."""
    with open(byte_level, encoding="utf-8") as a, open(pieces, "rb") as b:
        return docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def alignments(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, groups (`a1,a2|b1;a3|b2,b3`, ids of A and B), cuts (bytes of space + text at which each group ends)."""
    sent = _files(docs, byte_level, pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut_batches(batches, "text"):
            x = align_texts(_pair_of(sent), b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x.groups, pa.string()), _lists(x.cuts, x.n_groups, pa.int64())], ["doc_id", "groups", "cuts"])

    return _texts(docs).mapInArrow(run, "doc_id long, groups string, cuts array<long>")


def aligned(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair's count is the highest of its B id), count_sum (of the links' pairs), groups_sha256. Pairs are counted over all rows."""
    tuned(docs.sparkSession)
    rows = staged(_texts(docs).mapInArrow(_numbered(_files(docs, byte_level, pieces)), STAGED), "alignment")
    pairs = rows.filter("place = 0").select("chunk", F.explode(F.arrays_zip("at", "a", "b", "n")).alias("p")).select("chunk", "p.*")
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("pair_count"))
    # A B id has at most as many rows here as A has ids.
    marked = counts.withColumn("is_best", F.col("pair_count") == F.max("pair_count").over(Window.partitionBy("b")))
    known = pairs.join(marked, ["a", "b"]).select("chunk", F.lit(0).alias("place"), F.col("at").alias("number"), "pair_count", "is_best")
    texts = rows.filter("place = 1").drop("a", "b")
    both = known.unionByName(texts, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", "place", "number")
    return both.mapInArrow(_summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
