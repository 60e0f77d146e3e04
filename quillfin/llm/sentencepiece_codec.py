"""SentencePiece encoding and decoding with a Viterbi search over an Aho-Corasick automaton.

The automaton over all pieces reads a text once. At each character its output
links list the pieces that end there, and each relaxes the best score of that
position. The path of greatest total score, by the model's own piece scores,
is the encoding. On equal totals the longer last piece wins. A character that no
piece covers becomes its UTF-8 byte pieces, at the lowest score of all less
UNKNOWN_PENALTY a byte.

White space: a space is written as U+2581, and one is put in front. No piece of
the vocabulary holds U+2581 after another character, a line feed, or a
punctuation mark after a letter (checked when it is loaded), so the best path of
a text is that of its words, marks and line feeds one after the other, and a task
remembers the paths of words that it has met (at most CACHE).
A U+2581 of the text itself goes to bytes. So decoding gives every text back.

Null texts give null ids and null text; empty ones give no ids. Repeated rows
are encoded each. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import string
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfin.llm.words import pieces as cut_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 160_000
DECODED = "doc_id long, ids array<int>, text_sha256 string, decoded string, decoded_sha256 string"


@dataclass(frozen=True)
class Vocabulary:
    """pieces[i] and scores[i] of id i; None for control and unknown pieces, bytes for byte pieces."""

    pieces: tuple
    scores: tuple
    _made: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_made": {}}

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        out = []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            out.append(bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else None if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else p)
        return cls(tuple(out), tuple(sp.get_score(i) for i in range(len(out))))


class Decoder:
    """The texts of all pieces in one array."""

    def __init__(self, vocabulary: Vocabulary):
        text_of = [p if isinstance(p, bytes) else (p or "").replace(SPACE, " ").encode() for p in vocabulary.pieces]
        self.size = np.array([len(t) for t in text_of])
        self.begin = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer(b"".join(text_of), np.uint8)

    def decode(self, ids) -> str:
        """The text of a list of ids, without the space put in front."""
        ids = np.asarray(ids)
        if len(ids) == 0:
            return ""
        size = self.size[ids]
        end = np.cumsum(size)
        at = np.arange(end[-1]) + np.repeat(self.begin[ids] - (end - size), size)
        return self.letters[at].tobytes().decode("utf-8", "replace")[1:]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.byte_id = {p[0]: i for i, p in enumerate(vocabulary.pieces) if isinstance(p, bytes)}
        words = [(i, p) for i, p in enumerate(vocabulary.pieces) if isinstance(p, str)]
        if any("\n" in p or SPACE in p.lstrip(SPACE) for _, p in words):
            raise ValueError("a piece spans words or lines")
        marks = _marks([p for _, p in words])
        self.chunks = re.compile(f"\n|{SPACE}*[^{SPACE}\n{marks}]+|{SPACE}*[{marks}]+[^{SPACE}\n{marks}]*|{SPACE}+" if marks else f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
        self.automaton = ahocorasick.Automaton()
        for i, p in words:
            self.automaton.add_word(p, (len(p), vocabulary.scores[i], i))
        self.automaton.make_automaton()
        self.unknown = min(vocabulary.scores[i] for i, _ in words) - UNKNOWN_PENALTY
        # Paths of words met, as bytes of int32, in two generations: the older is dropped when the younger is full.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def best_path(self, chunk: str) -> tuple[int, ...]:
        """The best segmentation of a string, by one pass of the automaton."""
        n = len(chunk)
        best = [0.0] + [None] * n
        back: list = [None] * (n + 1)
        filled = 0  # positions up to here are settled

        def settle(upto: int) -> None:
            """Positions that no piece ends at are reached by the bytes of their character."""
            nonlocal filled
            while filled < upto:
                filled += 1
                if best[filled] is None:
                    raw = chunk[filled - 1].encode()
                    best[filled] = best[filled - 1] + self.unknown * len(raw)
                    back[filled] = (filled - 1, tuple(self.byte_id[x] for x in raw))

        for last, (size, score, i) in self.automaton.iter(chunk):
            settle(last)
            total = best[last + 1 - size] + score
            if best[last + 1] is None or total > best[last + 1]:
                best[last + 1] = total
                back[last + 1] = (last + 1 - size, (i,))
        settle(n)
        path = []
        while n:
            n, ids = back[n]
            path.append(ids)
        return tuple(x for ids in reversed(path) for x in ids)

    def _path(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = array("i", self.best_path(chunk)).tobytes()
        if len(chunk) <= 64:
            if len(self.young) >= CACHE // 2:
                self.old, self.young = self.young, {}
            self.young[chunk] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The ids (int32) of a text."""
        if not text:
            return np.zeros(0, np.int32)
        out: list[bytes] = []
        for part_no, part in enumerate(text.split(SPACE)):
            if part_no:
                out.append(np.array([self.byte_id[x] for x in SPACE.encode()], np.int32).tobytes())
            part = part.replace(" ", SPACE)
            known = self.young
            for chunk in self.chunks.findall(part if part_no else SPACE + part):
                ids = known.get(chunk)
                if ids is None:
                    ids = self._path(chunk)
                    known = self.young
                out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)


def _marks(pieces: list[str]) -> str:
    """The characters, as a class of a regular expression, in front of which a word may be cut: ASCII punctuation and all that stands before such a mark in a piece. None if that takes in letters."""
    marks = set(string.punctuation)
    while True:
        more = {a for p in pieces for a, b in zip(p, p[1:]) if b in marks and a not in marks and a != SPACE}
        if any(c.isalnum() and c.isascii() for c in more):
            return ""
        if not more:
            return re.escape("".join(sorted(marks)))
        marks |= more


def _of(kind: type, vocabulary_):
    """The worker's encoder or decoder for a broadcast vocabulary, kept from task to task. The vocabulary holds it, so that both go once a worker's next task has another broadcast or none."""
    made = vocabulary_.value._made
    if kind not in made:
        made[kind] = kind(vocabulary_.value)
    return made[kind]


def _id_lists(lists: list) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([0 if x is None else len(x) for x in lists], out=offsets[1:])
    flat = np.concatenate([x for x in lists if x is not None] or [np.zeros(0, np.int32)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([x is None for x in lists]))


def _encode(vocabulary_):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _of(Encoder, vocabulary_)
        for b in cut_batches(batches, "text"):
            texts = b.column("text").to_pylist()
            ids = [None if t is None else codec.encode(t) for t in texts]
            sha = [None if t is None else hashlib.sha256(t.encode()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _id_lists(ids), pa.array(sha, pa.string())], ["doc_id", "ids", "text_sha256"])

    return run


def _decode(vocabulary_, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _of(Decoder, vocabulary_)
        for b in batches:
            lists = b.column("ids")
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            null = lists.is_null().to_pylist()
            text, sha = [], []
            for i in range(b.num_rows):
                t = None if null[i] else codec.decode(flat[offsets[i] : offsets[i + 1]])
                sha.append(None if t is None else hashlib.sha256(t.encode()).hexdigest())
                text.append(t if keep_text else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, b.column("text_sha256"), pa.array(text, pa.string()), pa.array(sha, pa.string())], ["doc_id", "ids", "text_sha256", "decoded", "decoded_sha256"])

    return run


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, ids, text_sha256."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(sent), "doc_id long, ids array<int>, text_sha256 string")


def decode(encoded: DataFrame, model: str = MODEL, keep_text: bool = True) -> DataFrame:
    """Per row of encoded (doc_id, ids, text_sha256): those, decoded (null unless keep_text) and decoded_sha256."""
    sent = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    return encoded.mapInArrow(_decode(sent, keep_text), DECODED)


def encode_and_check(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids and round_trip, whether decoding the ids gave the text back (null for a null text).

    A task encodes and decodes in one Python worker: two operators in a row would hold two, each with a vocabulary, and Spark keeps idle workers for the stages that follow.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    encoded, decoded = _encode(sent), _decode(sent, keep_text=False)
    back = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: decoded(encoded(batches)), DECODED)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("text_sha256") == F.col("decoded_sha256")).alias("round_trip"))
