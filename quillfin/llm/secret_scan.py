"""Secret scan over a trigram inverted index, in DataFrame functions alone.

From each rule's regular expression a Boolean query over trigrams is derived:
every match must satisfy it. The postings (trigram, row) of the trigrams that
the rules ask for are intersected row by row into candidates, and only a
candidate's text meets the rule's expression. A rule without a mandatory
trigram scans every text. Texts are indexed in lower case, which can only add
candidates.

Matches are leftmost and do not overlap within a rule; their places come from
the gaps between them (split) and their lengths, in code points.

Null texts are as empty ones and have no spans. Repeated rows are scanned each;
those of equal doc_id and text share one entry of the index. A null doc_id is
carried. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfin.llm.shared import KEY, staged, with_row_key


@dataclass(frozen=True)
class Rule:
    """pattern: of Java and Python alike. A match counts if the group has least_chars or more. before: characters (as of a class) none of which may stand in front of a match.

    A repeated group of several characters is refused: Java's matcher goes one frame deeper with each repeat, and a long text ends the whole executor.
    """

    kind: str
    pattern: str
    group: int = 0
    least_chars: int = 0
    before: str = ""

    def __post_init__(self):
        if _repeats_a_group(sre_parse.parse(self.regex)):
            raise ValueError(f"the rule {self.kind} repeats a group")

    @property
    def regex(self) -> str:
        return f"(?<![{self.before}]){self.pattern}" if self.before else self.pattern


def _repeats_a_group(nodes) -> bool:
    """Whether anything but a single character is repeated more than once."""
    one = (sre.LITERAL, sre.NOT_LITERAL, sre.IN, sre.ANY)
    for op, arg in nodes:
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            if arg[1] > 1 and not (len(arg[2]) == 1 and arg[2][0][0] in one) or _repeats_a_group(arg[2]):
                return True
        elif op is sre.BRANCH:
            if any(map(_repeats_a_group, arg[1])):
                return True
        elif op in (sre.SUBPATTERN, sre.ASSERT, sre.ASSERT_NOT, sre.ATOMIC_GROUP):
            if _repeats_a_group(arg if op is sre.ATOMIC_GROUP else arg[-1]):
                return True
    return False


#: In the order in which spans of equal start are listed.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", before="A-Za-z0-9_-"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = 3
_MOST_STRINGS = 16
#: Matches whose spans are gathered in one list before lists are joined.
GROUP = 128


# ---- trigram queries: None (anything), a trigram, ("and", parts) or ("or", parts) ----


def _both(parts: list):
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _either(parts: list):
    parts = list(dict.fromkeys(parts))
    return None if None in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _strings(strings: set[str]):
    """The query of a set of alternatives."""
    return _either([_both([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _exact(node) -> set[str] | None:
    """The few strings that an element of an expression can be, in lower case, or None."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                out.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < _MOST_STRINGS:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is sre.SUBPATTERN:
        return _exact_all(arg[-1])
    if op is sre.BRANCH:
        sets = [_exact_all(x) for x in arg[1]]
        return None if None in sets or sum(map(len, sets)) > _MOST_STRINGS else set().union(*sets)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1 and (one := _exact_all(arg[2])) is not None:
        return one | ({""} if arg[0] == 0 else set())
    return None


def _exact_all(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        one = _exact(node)
        if one is None or len(out) * len(one) > _MOST_STRINGS:
            return None
        out = {a + b for a in out for b in one}
    return out


def _query(nodes):
    """What every match of a sequence holds."""
    parts, run = [], {""}
    for node in nodes:
        one = _exact(node)
        if one is not None and len(run) * len(one) <= _MOST_STRINGS:
            run = {a + b for a in run for b in one}
            continue
        parts.append(_strings(run))
        run = one or {""}
        if one is None:
            op, arg = node
            if op is sre.SUBPATTERN:
                parts.append(_query(arg[-1]))
            elif op is sre.BRANCH:
                parts.append(_either([_query(x) for x in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                parts.append(_query(arg[2]))
    return _both([*parts, _strings(run)])


def trigram_query(pattern: str):
    return _query(sre_parse.parse(pattern))


def trigrams(query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams(x) for x in query[1]))


def _holds(query, have: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(have, query)
    out = None
    for part in query[1]:
        x = _holds(part, have)
        out = x if out is None else (out & x if query[0] == "and" else out | x)
    return out


# ---- index, candidates, verification ----


def postings(docs: DataFrame, wanted: set[str]) -> DataFrame:
    """(trigram, KEY) of the wanted trigrams. docs: KEY, text."""
    low = docs.select(*KEY, F.lower("text").alias("low"))
    have = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in sorted(wanted)]))
    return low.select(*KEY, F.explode(have).alias("trigram"))


def candidates(index: DataFrame, rules: dict[str, object]) -> DataFrame:
    """(KEY, kinds): the rules whose queries a row's postings satisfy."""
    rows = index.groupBy(*KEY).agg(F.collect_set("trigram").alias("have"))
    kinds = F.array_compact(F.array(*[F.when(_holds(q, F.col("have")), F.lit(k)) for k, q in rules.items()]))
    return rows.select(*KEY, kinds.alias("kinds")).filter(F.size("kinds") > 0)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, order, kind, end>> of a rule's matches in a text."""
    pattern = F.lit(rule.regex)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, rule.regex, -1)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("m")))
    span = "struct<start:int,order:int,kind:string,end:int>"

    def step(acc, x):
        start = acc["at"] + x["gap"]
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), (start + x["size"]).alias("end")))
        ok = F.length(F.regexp_extract(x["m"], rule.regex, rule.group)) >= rule.least_chars
        return F.struct((start + x["size"]).alias("at"), F.when(ok, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    # A list that grows is copied at each step, so matches go GROUP at a time: a group's list starts empty, and groups are put together once.
    none = F.array().cast(f"array<{span}>")

    def group(done, part):
        at = F.coalesce(F.try_element_at(done, F.lit(-1))["at"], F.lit(0))
        return F.concat(done, F.array(F.aggregate(part, F.struct(at.alias("at"), none.alias("spans")), step)))

    parts = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)), F.lit(GROUP)), lambda i: F.slice(s, i + 1, F.lit(GROUP)))
    # The one-element array binds the matches, which the groups would find anew otherwise.
    bound = F.element_at(F.transform(F.array(steps), parts), 1)
    return F.aggregate(bound, F.array().cast(f"array<struct<at:int,spans:array<{span}>>>"), group, lambda done: F.flatten(F.transform(done, lambda d: d["spans"])))


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, spans array<struct<start, order, kind, end>> in order of start, then rule."""
    docs = with_row_key(docs.withColumn("text", F.coalesce("text", F.lit(""))))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not None}
    index = staged(postings(docs, set().union(*map(trigrams, indexed.values()))), "postings")
    found = docs.join(candidates(index, indexed), list(KEY), "left")
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    parts = []
    for i, r in enumerate(rules):
        spans = _spans(F.col("text"), r, i)
        parts.append(F.when(F.array_contains("kinds", r.kind), spans).otherwise(none) if r.kind in indexed else spans)
    return found.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
