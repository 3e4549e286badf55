"""Secrets: fixed patterns, and sliding-window entropy over candidate strings for what they miss.

A candidate is a run of at least ``WINDOW`` characters of the base64 and identifier alphabets. A
window slides over it; its Shannon entropy follows from the counts of the character that enters
and the one that leaves. The candidate's character class sets the least entropy that makes it a
secret. What is on the allow list (ids, placeholders, plain words) and what touches a fixed match is
left out. DataFrame and SQL operations only, and no row moves.

Twenty random characters of any class reach the class's threshold in at least nine of ten cases. A hit
of the allow list takes away the windows that overlap it and no others, and letters are allowed if they
look like words; so long made-up compounds without digits may be taken for secrets.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.llm import spans
from folioweave.llm.spans import Kind

WINDOW = 20
#: Characters of a candidate that one fold runs over; chunks overlap so that no window is lost.
CHUNK = 512

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: The kinds in their order.
KINDS = [
    Kind("assign", _ASSIGN, f"length(regexp_extract({{m}}, {spans.literal(_ASSIGN)}, 1)) >= 6", "{text} rlike '[:=]'"),
    Kind("access", r"AKIA[A-Z0-9]+", "length({m}) >= 20", "contains({text}, 'AKIA')"),
    Kind("hex", r"[0-9a-f]{24,}", "true", "{text} rlike '[0-9a-f]{24}'"),
]
_CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW

#: Least entropy in bits of a window, by class: the first class whose pattern holds for the whole string.
CLASSES = [("digits", "^[0-9]+$", 2.65), ("hex", "^[0-9a-fA-F]+$", 2.95), ("letters", "^([A-Za-z][a-z]*|[A-Z]+)$", 3.35), ("one case", "^([a-z0-9]+|[A-Z0-9]+)$", 3.45), ("mixed", "", 3.7)]

#: What is no secret within a candidate: a UUID, repeated or running characters, placeholders.
COVERED = "|".join([
    "[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    "(.)\\1{7,}",
    "(?i:example|sample|dummy|placeholder|changeme|your[_-]?|redacted|xxxx|lorem|0123456789|abcdefghij)",
])

_LETTERS = "^[A-Za-z]+([/_=+-]+[A-Za-z]+)*[/_=+-]*$"
_PART = "[A-Z]?[a-z]+|[A-Z]+"
#: SQL over ``m`` without digits: parts of 4 letters or more on average, a share of vowels and runs of consonants as in words.
WORDS = (
    f"({{m}} rlike '{_LETTERS}' and length(regexp_replace({{m}}, '[^A-Za-z]', '')) >= 4 * size(regexp_extract_all({{m}}, '{_PART}', 0)) "
    "and length(regexp_replace({m}, '[^aeiouAEIOU]', '')) between 0.28 * length(regexp_replace({m}, '[^A-Za-z]', '')) and 0.6 * length(regexp_replace({m}, '[^A-Za-z]', '')) "
    "and not {m} rlike '(?i)[b-df-hj-np-tv-xz]{6}|[b-df-hj-np-tv-xz]{5}.*[b-df-hj-np-tv-xz]{5}|[jqvxz][bcdfghjkmnpqtvwxz]|[aeiouy]{4}')"
)


#: Characters of candidates, and the signs of 0 to ``WINDOW`` occurrences of one.
_ALPHABET = string.ascii_letters + string.digits + "+/_=-"
_COUNTS = string.digits + string.ascii_letters


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def entropy(value: str) -> str:
    """SQL: the largest entropy of a window of ``WINDOW`` characters in a string at least as long.

    A string with a sign for each character of the alphabet carries the window's counts: at each step
    one sign goes down and one goes up.
    """
    f = lambda n: f"if({n} > 1, ({n}) * log2({n}), 0D)"
    place = lambda c: f"instr('{_ALPHABET}', {c})"
    count = lambda counts, at: f"instr('{_COUNTS}', substr({counts}, {at}, 1)) - 1"
    sign = lambda n: f"substr('{_COUNTS}', {n} + 1, 1)"
    # s is the sum of n log2 n over the counts n of the window's characters
    left = _let("p", place(f"substr(v, i - {WINDOW}, 1)"), _let("n", count("a.counts", "p"), f"named_struct('s', a.s - ({f('n')} - {f('(n - 1)')}), 'counts', overlay(a.counts placing {sign('n - 1')} from p for 1))"))
    after = f"if(i > {WINDOW}, {left}, named_struct('s', a.s, 'counts', a.counts))"
    entered = _let("p", place("substr(v, i, 1)"), _let("n", count("b.counts", "p"), f"named_struct('s', b.s + {f('(n + 1)')} - {f('n')}, 'counts', overlay(b.counts placing {sign('n + 1')} from p for 1))"))
    step = _let("b", after, _let("c", entered, f"named_struct('s', c.s, 'counts', c.counts, 'least', if(i >= {WINDOW}, least(a.least, c.s), a.least))"))
    fold = f"aggregate(sequence(1, length(v)), named_struct('s', 0D, 'counts', repeat('0', {len(_ALPHABET)}), 'least', 1e9D), (a, i) -> {step}, a -> log2({WINDOW}) - a.least / {WINDOW})"
    chunk = CHUNK - WINDOW + 1
    chunks = f"transform(sequence(0, greatest(0, length({value}) - {WINDOW}) div {chunk}), j -> substr({value}, j * {chunk} + 1, {CHUNK}))"
    return f"array_max(transform({chunks}, v -> {fold}))"


def entropy_kind() -> Kind:
    least = "case " + " ".join(f"when p rlike '{x}' then {v}D" for _, x, v in CLASSES[:-1]) + f" else {CLASSES[-1][2]}D end"
    open_ = f"filter(split({{m}}, '{COVERED}', -1), p -> length(p) >= {WINDOW})"
    return Kind("entropy", _CANDIDATE, f"not {WORDS} and exists({open_}, p -> {entropy('p')} >= {least})", "{text} rlike '[A-Za-z0-9+/_=-]{%d}'" % WINDOW)


def base_spans(text: str = "text") -> Column:
    return F.concat(*[spans.find(kind, i, text) for i, kind in enumerate(KINDS)])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of start, rank, end, kind, value) of every row of ``docs``.

    Null texts count as empty and have none; repeated rows each get theirs; an empty table gives no
    rows.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.select("doc_id", base_spans().alias("base"), spans.find(entropy_kind(), len(KINDS)).alias("found"))
    added = F.filter("found", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
    return own.select("doc_id", "base", F.concat("base", added).alias("spans"))
