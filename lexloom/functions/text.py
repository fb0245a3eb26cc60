"""Column builders for literal text: Unicode classes, slices, hashes and terms.

Offsets are code points from 0, half open. Spark's length and substring count code points; regular
expression positions do not, so offsets always come from cumulative lengths of a total partition.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as str.isspace has it: U+001C to U+001F included.
WS = r"\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Version 1 of the token specification. It matches everything: the last alternative takes any character.
TOKEN_PATTERN = (
    r"(?s)https?://[^" + WS + r"]+"
    r"|[\p{L}\p{N}][\p{L}\p{N}._%+\-]*@[\p{L}\p{N}][\p{L}\p{N}.\-]*[\p{L}\p{N}]"
    r"|\p{N}+(?:[.,:/]\p{N}+)*"
    r"|[Ee][Tt][Cc]\."
    r"|[\p{L}\p{M}\p{N}_]+(?:['\-’][\p{L}\p{M}\p{N}_]+)*"
    r"|[.!?]+"
    r"|[" + WS + r"]+"
    r"|."
)
PARAGRAPH_BREAK = r"(\r\n|\n)[ \t]*(\r\n|\n)"
# Sentence closers, openers and protected titles.
CLOSERS = ("\"", "'", "”", "’", ")", "]", "}", "»", "›", "」", "』")
OPENERS = ("\"", "'", "“", "‘", "(", "[", "{", "«")
TITLES = ("dr", "dra", "sr", "sra")


def crlf_to_lf(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def slice_text(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def is_blank(text: Column) -> Column:
    """Not empty and only white space."""
    return text.rlike("^[" + WS + "]+$")


def starts_upper(text: Column) -> Column:
    """The first letter is upper case."""
    return F.regexp_extract(text, r"\p{L}", 0).rlike(r"^\p{Lu}")


def terminal_punct(text: Column) -> Column:
    return text.rlike(r"^[.!?]+$")


def dep_base(dep: Column) -> Column:
    return F.substring_index(F.lower(dep), ":", 1)


def unit_id(run: Column, kind: str, order: Column) -> Column:
    return F.concat_ws(":", run, F.lit(kind), order.cast("string"))


def iso_with_offset(value: Column) -> Column:
    """An ISO-8601 date and time with an explicit offset that is a real instant."""
    shape = value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$")
    return F.coalesce(shape & F.try_to_timestamp(value).isNotNull(), F.lit(False))


def revision_pin(value: Column) -> Column:
    return value.rlike("^([0-9a-f]{40}|[0-9a-f]{64})$")


def strip_fence(answer: Column) -> Column:
    """The inside of one fence around the whole answer, else the trimmed answer."""
    inside = F.regexp_extract(F.trim(answer), r"(?s)^```(?:json)?\s*\n(.*)\n```$", 1)
    return F.when(inside != "", inside).otherwise(F.trim(answer))


def title_strip(header: Column, section: Column) -> Column:
    tail = F.concat(F.lit(" — "), section)
    return F.when(header.endswith(tail), F.substring(header, F.lit(1), F.length(header) - F.length(tail))).otherwise(header)


def interval_clip(start: Column, end: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    return F.greatest(start, lo), F.least(end, hi)


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with keys in order and nulls kept; for texts, integers, booleans and nested structs of them."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())]), {"ignoreNullFields": "false"})


def canonical_hash(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


# Terms too common to tell texts apart. Negations stay searchable.
STOP_TERMS = (
    "a ao aos as ate com da das de do dos e em entre essa esse esta este eu ela ele "
    "elas eles isso isto ja lhe lhes mais me meu meus minha minhas muito na nas no nos "
    "num numa o os ou para pela pelas pelo pelos por qual quando que quem se ser seu "
    "seus sobre sua suas tambem ter um uma umas uns"
).split()
_ACCENTED = "áàâãäåçéèêëíìîïñóòôõöúùûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def fold_terms(text: Column) -> Column:
    """Search terms: lower case, Latin accents dropped, runs of letters longer than one, no stop terms.

    ß stands for ss, as case folding has it.
    """
    folded = F.replace(F.translate(F.lower(text), _ACCENTED, _PLAIN), F.lit("ß"), F.lit("ss"))
    terms = F.regexp_extract_all(folded, F.lit(r"[\p{L}]+"), F.lit(0))
    return F.filter(terms, lambda t: (F.length(t) > 1) & ~t.isin(STOP_TERMS))
