"""Canonical keys, references, metadata and tags of German and English technical texts."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: prefixes, patterns and word lists that results depend on -------------------------
NORM_PREFIX = "(?:ÖNORM|OENORM|ONORM|DIN|EN|ISO|IEC)"
NORM = rf"(?iU)\b{NORM_PREFIX}(?:\s+{NORM_PREFIX})*\s+[A-Z]?\s*\d{{2,}}(?:\s*[-–]\s*\d+)*(?:\s*[:(]\s*\d{{4}}\)?)?"
LEGAL = r"(?iU)(?:§§?\s*\d+[a-z]?|\bArt(?:ikel|\.)?\s*\d+[a-z]?)"
EDITION_WORDS = "(?:Ausgabe|Edition|Fassung|Ed\\.?)"
HEAD_DATE = r"\b((?:19|20)\d{2})-(\d{2})-(\d{2})\b"
HEAD_EDITION = r"(?iU)(?:Ausgabe|Ausgabedatum|Edition|Fassung|Stand|gültig\s+ab)\b[^\d]{0,12}((?:19|20)\d{2})"
HYPHENATED, SOFT_END = "-\n(?=[a-zäöüA-ZÄÖÜ])", "(?<!\n)\n(?!\n)(?=[a-zäöü(])"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-ZÄÖÜ])"
ISSUERS = {"önorm": "Austrian Standards", "oenorm": "Austrian Standards", "onorm": "Austrian Standards", "oib": "OIB", "din": "DIN", "en": "CEN", "iso": "ISO", "iec": "IEC"}
FAMILIES = {"önorm": "önorm", "oenorm": "önorm", "onorm": "önorm", "din": "din", "en": "en", "iso": "iso", "iec": "iec"}
DOC_TYPES = [
    ("richtlinie", ["richtlinie", "oib-richtlinie", "leitlinie", "guideline"]),
    ("vertrag", ["vertrag", "vereinbarung", "contract", "agb"]),
    ("protokoll", ["protokoll", "besprechung", "sitzung", "minutes"]),
    ("angebot", ["angebot", "offerte", "kostenvoranschlag", "leistungsverzeichnis"]),
    ("anleitung", ["anleitung", "handbuch", "manual", "bedienungsanleitung"]),
    ("bericht", ["bericht", "gutachten", "report", "prüfbericht", "pruefbericht"]),
]
GERMAN = ["der", "die", "das", "und", "ist", "für", "mit", "den", "von", "nicht", "eine", "auch", "dem", "sich", "auf", "werden", "bei", "önorm"]
ENGLISH = ["the", "and", "for", "with", "that", "this", "are", "from", "which", "shall", "have", "been", "not", "requirements"]
STOP = (
    "der die das und ist für mit den von nicht eine auch dem sich auf werden bei als aus sind wird einer einem eines oder zum zur über nach durch kann "
    "muss sowie diese dieser dieses wenn aber nur wie vor the and for with that this are from which shall have been not all any may such per into than "
    "bgbl bundesgesetz bundesgesetzblatt bundesrecht gesetz gesetze artikel absatz paragraph paragraf fassung gemäß gemaess nummer ziffer litera abschnitt "
    "hauptstück hauptstueck anlage inkrafttreten verordnung novelle änderung aenderung geändert geaendert aufgehoben sinne jeweils geltenden erster zweiter "
    "dritter vierter fünfter beziehungsweise insbesondere gilt gelten welche welcher welches haben worden wurde wurden jahr jahre monat monate person "
    "personen fall fälle faelle teil teile republik österreich oesterreich"
).split()
# ------------------------------------------------------------------------------------------------------


def plain_key(text: str) -> str:
    """NFKC, runs of other than word characters as one underscore, none at the ends, case folded."""
    return re.sub(r"[\W_]+", "_", unicodedata.normalize("NFKC", text)).strip("_").casefold()


def normalize_key(text: Column) -> Column:
    """``plain_key`` of a column: Spark has no NFKC, so this is an Arrow UDF."""

    @F.pandas_udf("string")
    def run(part: pd.Series) -> pd.Series:
        return part.map(lambda x: None if x is None else plain_key(x))

    return run(text)


def nfkc(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(part: pd.Series) -> pd.Series:
        return part.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return run(text)


def fast_key(text: Column) -> Column:
    """The key of a text that is in NFKC already, without leaving the JVM."""
    return F.replace(F.lower(F.regexp_replace(F.regexp_replace(text, r"(?U)[\W_]+", "_"), "^_|_$", "")), F.lit("ß"), F.lit("ss"))


def norm_version(raw: Column) -> Column:
    """The edition year of a norm: after a colon or bracket, else after an edition word."""
    marked = F.regexp_extract(F.trim(raw), r"[:(](\d{4})\)?\s*$", 1)
    worded = F.regexp_extract(F.trim(raw), rf"(?iU)\b{EDITION_WORDS}\s+(\d{{4}})\s*$", 1)
    return F.coalesce(F.nullif(marked, F.lit("")), F.nullif(worded, F.lit("")))


def _norm_text(raw: Column) -> Column:
    """A norm without its year, letters and first digits one space apart, prefixes unified."""
    text = F.trim(raw)
    bare = F.when(text.rlike(r"[:(]\d{4}\)?\s*$"), F.regexp_replace(text, r"[:(]\d{4}\)?\s*$", "")).otherwise(F.regexp_replace(text, rf"(?iU)\b{EDITION_WORDS}\s+\d{{4}}\s*$", ""))
    spaced = F.trim(F.regexp_replace(F.regexp_replace(bare, r"([A-Za-zÄÖÜäöü]+)\s*(\d)", "$1 $2"), r"\s+", " "))
    return F.regexp_replace(spaced, r"(?iU)^(oenorm|onorm)(?= |$)", "önorm")


def norm_key(raw: Column, composed: bool = True) -> Column:
    """Canonical key of a norm; ``composed`` promises text in NFKC."""
    return fast_key(_norm_text(raw)) if composed else normalize_key(_norm_text(nfkc(raw)))


def legal_key(raw: Column) -> Column:
    """Canonical key of a paragraph or article."""
    text = F.replace(F.lower(F.trim(raw)), F.lit("ß"), F.lit("ss"))
    for symbol, word in [("§§", "par"), ("§", "par"), ("artikel", "art"), ("art.", "art"), ("abs.", "abs")][::-1]:
        text = F.when(F.startswith(F.replace(F.lower(F.trim(raw)), F.lit("ß"), F.lit("ss")), F.lit(symbol)), F.concat(F.lit(word + " "), F.substring(F.lower(F.trim(raw)), len(symbol) + 1, 1 << 20))).otherwise(text)
    return fast_key(text)


def norm_matches(text: Column) -> Column:
    """All norms in a text, in order: array of key, raw, version."""
    return F.filter(
        F.transform(F.regexp_extract_all(text, F.lit(NORM), F.lit(0)), lambda m: F.struct(norm_key(m).alias("key"), F.trim(m).alias("raw"), norm_version(m).alias("version"))),
        lambda m: m["key"] != "",
    )


def references(text: Column) -> Column:
    """Distinct references of a text as kind:key, norms before paragraphs, by first occurrence."""
    norms = F.transform(norm_matches(text), lambda m: F.concat(F.lit("norm:"), m["key"]))
    legal = F.transform(F.regexp_extract_all(text, F.lit(LEGAL), F.lit(0)), lambda m: F.concat(F.lit("legal:"), legal_key(m)))
    return F.array_distinct(F.concat(norms, F.filter(legal, lambda x: x != "legal:")))


def own_norm(head: Column) -> Column:
    """The most frequent norm of a head, the earliest of equals: struct of key, raw, version."""
    count = lambda found: F.transform(found, lambda m, i: F.struct(F.size(F.filter(found, lambda o: o["key"] == m["key"])).alias("n"), (-i).alias("first"), m.alias("m")))
    return F.array_max(F.get(F.transform(F.array(norm_matches(head)), count), F.lit(0)))["m"]


def display_norm(raw: Column) -> Column:
    text = F.regexp_replace(F.trim(raw), r"[:(]\s*\d{4}\)?\s*$", "")
    text = F.regexp_replace(text, rf"(?iU)\b{EDITION_WORDS}\s+\d{{4}}\s*$", "")
    text = F.upper(F.trim(F.regexp_replace(text, r"\s+", " ")))
    text = F.regexp_replace(text, r"(?U)^(OENORM|ONORM)\b", "ÖNORM")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, r"([A-ZÄÖÜ]+)\s*(\d)", "$1 $2"), r"\s+", " ")), 1, 128)


def issuer(head: Column, norm: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ISSUERS.items() for x in pair])
    first = F.lower(F.substring_index(norm, " ", 1))
    word = F.lower(F.regexp_extract(head, r"(?iU)\b(ÖNORM|OENORM|ONORM|OIB|DIN|EN|ISO|IEC)\b", 1))
    return F.coalesce(F.element_at(known, first), F.element_at(known, F.nullif(word, F.lit(""))))


def doc_type(head: Column) -> Column:
    """The first group of keywords that a head contains."""
    low, out = F.lower(head), F.lit("sonstiges")
    for name, words in reversed(DOC_TYPES):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def language(text: Column, chars: int = 4000) -> Column:
    """de or en by distinct stop words of a head of at least 20 words; equal: de if it has umlauts, else null."""
    head = F.substring(text, 1, chars)
    words = F.regexp_extract_all(F.lower(head), F.lit("[A-Za-zÄÖÜäöüß]+"), F.lit(0))
    hits = lambda listed: F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in listed])))
    de, en = hits(GERMAN), hits(ENGLISH)
    guess = F.when(de > en, "de").when(en > de, "en").when(head.rlike("[äöüß]"), "de")
    return F.when(F.size(words) >= 20, guess)


def version_year(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, r"(19|20)\d{2}", 0), F.lit("")).cast("int")


def metadata(text: Column, head_chars: int = 1500) -> Column:
    """norm_id, doc_type, doc_version, issued_date, issuer and language of a text."""
    head = F.substring(text, 1, head_chars)
    own = own_norm(head)
    norm = display_norm(own["raw"])
    date, edition = F.nullif(F.regexp_extract(head, HEAD_DATE, 0), F.lit("")), F.nullif(F.regexp_extract(head, HEAD_EDITION, 1), F.lit(""))
    version = F.coalesce(own["version"], F.substring(date, 1, 4), edition)
    has_norm = norm.isNotNull()
    return F.struct(
        norm.alias("norm_id"),
        F.when(has_norm, F.lit("norm")).otherwise(doc_type(head)).alias("doc_type"),
        F.when(has_norm, version).alias("doc_version"),
        F.when(has_norm & version.isNotNull(), F.coalesce(date, edition, version)).alias("issued_date"),
        issuer(head, norm).alias("issuer"),
        language(text).alias("language"),
    )


def keyword_candidates(text: Column, chars: int = 200_000) -> Column:
    """The words of a text, in order, as they may become keywords."""
    return F.regexp_extract_all(F.substring(text, 1, chars), F.lit(r"[A-Za-zÄÖÜäöüß][A-Za-zÄÖÜäöüß\-]{4,}"), F.lit(0))


def keyword(word: Column) -> Column:
    """A candidate in lower case without hyphens at its ends; null if it is short, a stop word or a Roman number."""
    bare = F.regexp_replace(F.lower(word), "^-+|-+$", "")
    return F.when((F.length(bare) >= 5) & ~bare.isin(STOP) & ~bare.rlike("^[ivxlcdm]+$"), bare)


def keyword_score(word: Column, n: Column) -> Column:
    return n * (1 + F.least(F.length(word), F.lit(16)) / 20)


def family_tags(text: Column) -> Column:
    """Tags of the norm families in a head, then oib."""
    head = F.substring(text, 1, 1500)
    known = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    norms = F.filter(F.transform(norm_matches(head), lambda m: F.element_at(known, F.substring_index(m["key"], "_", 1))), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(norms, F.when(head.rlike(r"(?iU)\bOIB\b"), F.array(F.lit("oib"))).otherwise(F.array().cast("array<string>"))))


def suggest_folder(file_name: Column, snippet: Column, tags: Column, current: Column) -> Column:
    """A folder by norm family, else by the first tag, else the current one."""
    from folioweave.functions.folders import transliterate

    text = F.concat(file_name, F.lit("\n"), F.coalesce(snippet, F.lit("")))
    families = F.filter(family_tags(text), lambda t: t != "oib")
    tag = F.get(F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != ""), F.lit(0))
    family = F.upper(F.regexp_replace(F.get(families, F.lit(0)), "önorm", "oenorm"))
    target = F.coalesce(F.concat(F.lit("/Normen/"), family), F.when(text.rlike(r"(?iU)\bOIB\b"), F.lit("/Normen/OIB")), tag, current, F.lit("/"))
    return transliterate(target)


def numbering_level(title: Column) -> Column:
    number = F.regexp_extract(title, r"^\s*(\d+(?:\.\d+)*)(?:\s|\)|\.)", 1)
    return F.when(number != "", F.size(F.split(number, r"\.")))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def repair_layout(text: Column) -> Column:
    """Hyphens at line ends joined, soft line ends and runs of spaces made one space."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, HYPHENATED, ""), SOFT_END, " "), " {2,}", " ")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n{2,}"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), SENTENCE_END), lambda s: s.rlike(r"(?U)\S"))


def hard_split(text: Column, chars: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(text) - 1) / chars))), lambda i: F.substring(text, (i * chars + 1).cast("int"), F.lit(chars)))


def units(text: Column, chars: int) -> Column:
    """The paragraphs of a repaired text, long ones as sentences, long sentences cut."""
    parts = lambda p: F.when(F.length(p) <= chars, F.array(p)).otherwise(sentences(p))
    return F.flatten(F.flatten(F.transform(paragraphs(repair_layout(text)), lambda p: F.transform(parts(p), lambda s: hard_split(s, chars)))))


def replace_tag(tags: Column, old: str, new: str) -> Column:
    return F.array_distinct(F.transform(tags, lambda t: F.when(t == old, F.lit(new)).otherwise(t)))


def merge_tags(manual: Column, automatic: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(manual, none), F.coalesce(automatic, none)))


def mask_argument(key: Column, value: Column) -> Column:
    """Secrets hidden, long texts cut at 100 characters with the count of the rest."""
    long = key.isin("body", "text", "content", "query") & (F.length(value) > 100)
    return F.when(key.isin("token", "password", "secret", "api_key", "confirm_token"), F.lit("***REDACTED***")).when(long, F.concat(F.substring(value, 1, 100), F.lit("...<+"), (F.length(value) - 100).cast("string"), F.lit("ch>"))).otherwise(value)


def citation(file_name: Column, page: Column, path: Column, title: Column) -> Column:
    return F.concat_ws(", ", F.nullif(file_name, F.lit("")), F.concat(F.lit("S. "), page.cast("string")), F.coalesce(F.nullif(path, F.lit("")), F.nullif(title, F.lit(""))))


def chunk_id(doc_id: Column, section_path: Column, text: Column) -> Column:
    return F.sha1(F.concat_ws("\x1f", doc_id.cast("string"), F.coalesce(section_path, F.lit("")), text))


def layout_chunk_id(doc_hash: Column, sections: Column, text: Column) -> Column:
    return F.sha1(F.concat_ws("\x1f", doc_hash, F.array_join(sections, "/"), F.concat(F.lit("sha256:"), F.sha2(text, 256))))
