"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-case runs of letters and digits with one
space between. An item
of n characters may differ by e = floor(n * error_rate) edits. Cut into e + 1
pieces, an occurrence within e edits holds one piece unchanged, so exact piece
hits (an Aho-Corasick automaton over all pieces) find every occurrence. Each
hit names a window of the text, and Myers' bit-parallel distance decides there
whether the item occurs with at most e edits. Items too short for any edit (under 13
characters at 8 %) count only where they stand as whole words, as letters inside
longer words say nothing.

Items go to the tasks in blocks of at most BLOCK_CHARS characters, one pass over
the documents for each block: the bound holds whatever the benchmark's size.

Null and empty texts hold nothing; null items and those without letters or
digits match nothing. Repeated
rows and repeated items give a row each. Null ids are carried. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfin.llm.shared import KEY, with_row_key
from quillfin.llm.words import pieces

ERROR_RATE = 0.08
BLOCK_CHARS = 4_000_000
_WORD = re.compile(r"[^\W_]+")


def normalise(text: str | None) -> str:
    return " ".join(_WORD.findall((text or "").lower()))


def cut(n: int, parts: int) -> list[tuple[int, int]]:
    """parts ranges that cover n characters, of lengths that differ by one at most."""
    return [(n * i // parts, n * (i + 1) // parts) for i in range(parts)]


def masks(pattern: str) -> dict[str, int]:
    """For each character, the bits of the places where the pattern has it."""
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_match(peq: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of a pattern of m characters anywhere in text, first on ties, if within most edits."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    left = len(text)
    for end, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = score, end
        elif score - (left - end) > most and best is None:
            return None
    return best


class Matcher:
    """The pieces of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float):
        self.items = [(i, t, int(len(t) * error_rate)) for i, t in items]
        self.peq = [masks(t) for _, t, _ in self.items]
        spots: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, e) in enumerate(self.items):
            for a, b in cut(len(t), e + 1):
                spots.setdefault(t[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in spots.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item's place, distance, end) of the best occurrence of each item in a normalised text."""
        found: dict[int, tuple[int, int]] = {}
        padded = f" {text} "
        windows: dict[int, list[list[int]]] = {}
        for last, (n, where) in self.automaton.iter(text):
            for k, a in where:
                _, t, e = self.items[k]
                if not e:
                    # The one piece is the whole item: it counts where it stands as words of its own.
                    if padded[last + 1 - n] == " " and padded[last + 2] == " ":
                        found.setdefault(k, (0, last + 1))
                    continue
                begin = last + 1 - n - a
                lo, hi = max(0, begin - e), min(len(text), begin + len(t) + e)
                mine = windows.setdefault(k, [])
                if mine and lo <= mine[-1][0] + 2 * e and lo >= mine[-1][0]:
                    mine[-1][1] = max(mine[-1][1], hi)
                elif not any(x <= lo and hi <= y for x, y in mine[-3:]):
                    mine.append([lo, hi])
        for k, spans in windows.items():
            _, t, e = self.items[k]
            for lo, hi in spans:
                got = best_match(self.peq[k], len(t), text[lo:hi], e)
                if got and (k not in found or got[0] < found[k][0]):
                    found[k] = got[0], lo + got[1]
                if got and got[0] == 0:
                    break
        return [(k, d, end) for k, (d, end) in sorted(found.items())]


_matchers: list[tuple[list, float, Matcher]] = []


def _matcher(items_, error_rate: float) -> Matcher:
    """The worker's matcher for a broadcast block of items, kept from task to task."""
    if not _matchers or _matchers[0][0] is not items_.value or _matchers[0][1] != error_rate:
        _matchers[:] = [(items_.value, error_rate, Matcher(items_.value, error_rate))]
    return _matchers[0][2]


def _search(items_, error_rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(items_, error_rate)
        for b in pieces(batches, "text"):
            row, item, distance, end = [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                for k, d, e in m.find(normalise(text)) if text else ():
                    row.append(i)
                    item.append(m.items[k][0])
                    distance.append(d)
                    end.append(e)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("doc_id", *KEY)), pa.array(item, pa.int64()), pa.array(distance, pa.int32()), pa.array(end, pa.int64())], ["doc_id", *KEY, "item_id", "distance", "end"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document row and item that occurs in it: doc_id, the row's key (KEY), item_id, distance (edits), end (its end in the normalised text). docs: doc_id, text; benchmark: item_id, text."""
    spark = docs.sparkSession
    docs = with_row_key(docs)
    result = "doc_id long, doc_key long, doc_key2 long, item_id long, distance int, end long"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-chars // block_chars))
    out = None
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        held = [(r["item_id"], t) for r in part.collect() if (t := normalise(r["text"]))]
        if not held:
            continue
        found = docs.mapInArrow(_search(spark.sparkContext.broadcast(held), error_rate), result)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], result)
