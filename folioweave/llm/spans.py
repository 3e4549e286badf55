"""Spans of patterns in texts, in SQL functions: places in code points, end exclusive.

A pattern's matches and the pieces between them, laid end to end, give every match its place. The
patterns are written so that Java's engine neither recurses on long matches nor rescans a run of
characters from each of its positions; they match the same strings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

PART = 512
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: SQL over ``m``, the matched string: whether it counts.
    valid: str
    #: SQL over ``text``: false only where nothing can match.
    possible: str


def literal(text: str) -> str:
    return "r'" + text + "'" if "'" not in text else 'r"' + text + '"' if '"' not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def find(kind: Kind, rank: int, text: str = "text") -> Column:
    """The array of a kind's valid matches in a column of texts that aren't null."""
    p = literal(kind.pattern)
    start = "a.pos + length(x.p)"
    end = "a.pos + length(x.p) + length(x.m)"
    span = f"named_struct('start', {start}, 'rank', {rank}, 'end', {end}, 'kind', '{kind.name}', 'value', x.m)"
    valid = kind.valid.replace("{m}", "x.m")
    # arrays grow by a part of ``PART`` matches at a time, so that a text may have a million of them
    part = (
        f"aggregate(slice(pairs, j + 1, {PART}), named_struct('pos', 0, 'out', cast(array() as {SPANS})), "
        f"(a, x) -> if(x.m is null, a, named_struct('pos', {end}, 'out', if({valid}, concat(a.out, array({span})), a.out))))"
    )
    moved = "transform(c.out, s -> named_struct('start', s.start + b.pos, 'rank', s.rank, 'end', s.end + b.pos, 'kind', s.kind, 'value', s.value))"
    fold = (
        f"element_at(transform(array(zip_with(regexp_extract_all({text}, {p}, 0), split({text}, {p}, -1), (m, p) -> named_struct('m', m, 'p', p))), pairs -> "
        f"aggregate(transform(sequence(0, size(pairs) - 1, {PART}), j -> {part}), named_struct('pos', 0, 'out', cast(array() as array<{SPANS}>)), "
        f"(b, c) -> named_struct('pos', b.pos + c.pos, 'out', concat(b.out, array({moved}))), b -> flatten(b.out))), 1)"
    )
    return F.expr(f"if({kind.possible.replace('{text}', text)}, {fold}, cast(array() as {SPANS}))")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, by start, then kind as listed, comma-joined."""
    parts = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
