"""Text column expressions.

Everything here compiles to JVM string/regex expressions inside whole-stage
codegen; no Python runs per row.
"""

from __future__ import annotations

import json
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as FV
from .numeric import col_

# Whitespace as Python's str.split() sees it.
WS_CLASS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")

# Markup removed by clean_html, as one leftmost-first alternation scanned in
# a single pass: script/style/template elements with their bodies, comments,
# declarations, processing instructions, then any other tag.  At each
# position the first listed form wins, as in an HTML tokenizer (a comment
# hides the tags inside it).  A quoted attribute value may hold ``>``; the
# possessive quantifiers keep the match linear.  The last form takes a tag
# whose quotes do not close.
HTML_DROP_PATTERNS = (
    r"(?is)<script\b[^>]*>.*?</script\s*>"
    r"|<style\b[^>]*>.*?</style\s*>"
    r"|<template\b[^>]*>.*?</template\s*>"
    r"|<!--.*?-->"
    r"|<![^>]*>"
    r"|<\?[^>]*>"
    r"""|</?[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
    r"|</?[A-Za-z][^>]*>",
)

# Character references: decimal, hexadecimal, named.
REFERENCE = r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]{1,31});?"


def first_nonempty(*cols) -> Column:
    """B1: first argument that is neither NULL nor the empty string."""
    return F.coalesce(*[F.nullif(col_(c), F.lit("")) for c in cols])


def strip_ws(c) -> Column:
    """Python str.strip() for the whitespace class above."""
    return F.regexp_replace(col_(c), rf"^{WS_CLASS}+|{WS_CLASS}+$", "")


def collapse_ws(c) -> Column:
    """' '.join(s.split()): runs of whitespace to one space, ends trimmed."""
    return strip_ws(F.regexp_replace(col_(c), rf"{WS_CLASS}+", " "))


@lru_cache(maxsize=1)
def _named_references() -> str:
    """The HTML names (from the standard library's table) as a JSON object."""
    return json.dumps(html5)


@lru_cache(maxsize=1)
def _c1_references() -> str:
    """128..159 mean Windows-1252 characters, as browsers read them."""
    return json.dumps({str(n): bytes([n]).decode("cp1252", "replace") for n in range(128, 160)})


def _reference_text(ref: Column) -> Column:
    """Text of one character reference; an unknown one stays as it is."""
    name = F.substring(ref, 2, 40)
    digits = F.regexp_replace(name, "[#xX;]", "")
    code = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits)
    code = code.try_cast("int")
    bad = F.coalesce((code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit(True))
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(bad, F.lit(0xFFFD)).otherwise(code)), 8, "0")), "UTF-32")
    c1 = F.element_at(F.from_json(F.lit(_c1_references()), "map<string,string>"), code.cast("string"))
    number = F.when(code.between(128, 159), c1).otherwise(char)
    known = F.from_json(F.lit(_named_references()), "map<string,string>")
    common = (F.when(name == "amp;", "&").when(name == "lt;", "<").when(name == "gt;", ">")
              .when(name == "quot;", '"').when(name == "nbsp;", "\u00a0"))
    named = F.coalesce(common, F.try_element_at(known, name))
    return F.when(F.substring(name, 1, 1) == "#", number).otherwise(F.coalesce(named, ref))


def decode_entities(c) -> Column:
    """Every HTML character reference, named and numeric, decoded once (so
    ``&amp;lt;`` gives the text ``&lt;``)."""
    x = col_(c)
    refs = F.regexp_extract_all(x, F.lit(REFERENCE), F.lit(0))
    parts = F.split(x, REFERENCE)
    pairs = F.zip_with(refs, F.slice(parts, 2, F.size(refs)),
                       lambda r, p: F.concat(_reference_text(r), p))
    decoded = F.concat(F.element_at(parts, 1), F.array_join(pairs, ""))
    return F.when(F.instr(x, "&") > 0, decoded).otherwise(x)


def clean_html(c) -> Column:
    """Visible text of an HTML fragment; NULL stays NULL.

    Script/style/template bodies, comments and declarations are dropped, every
    tag becomes a space, entities are decoded, whitespace is collapsed.
    """
    x = col_(c)
    for p in HTML_DROP_PATTERNS:
        x = F.regexp_replace(x, p, " ")
    return collapse_ws(decode_entities(x))


def _limited(x: Column, limit: int | None) -> Column:
    return x if limit is None else F.substring(x, 1, limit)


def short_scorer_text(summary, headline, limit: int | None = None) -> Column:
    """Summary, else headline; first ``limit`` characters if given (a model
    with a bounded input passes ``FV.SHORT_TEXT_LIMIT``)."""
    return _limited(first_nonempty(summary, headline), limit)


def long_scorer_text(summary, headline, content,
                     limit: int | None = None) -> Column:
    """(summary or headline) + blank line + content, stripped; first
    ``limit`` characters if given (``FV.LONG_TEXT_LIMIT`` for a bounded model)."""
    lead = F.coalesce(first_nonempty(summary, headline), F.lit(""))
    body = F.coalesce(F.nullif(col_(content), F.lit("")), F.lit(""))
    return _limited(strip_ws(F.concat(lead, F.lit("\n\n"), body)), limit)


def render_prompt(asset, text) -> Column:
    """Asset-specific instruction block + input text.

    The cascade tests substrings of the asset tag in a fixed order.
    """
    a = col_(asset)
    system = None
    for needles, template in FV.PROMPT_CASCADE:
        cond = None
        for n in needles:
            c = a.contains(n)
            cond = c if cond is None else (cond | c)
        cond = F.coalesce(cond, F.lit(False))
        system = F.when(cond, F.lit(template)) if system is None \
            else system.when(cond, F.lit(template))
    system = system.otherwise(F.lit(FV.PROMPT_FALLBACK))
    return F.concat(system, F.lit(FV.PROMPT_INPUT_SEPARATOR), col_(text))


def embedded_json(c) -> Column:
    """B11 step 1: greedy outermost ``{...}`` span, across newlines."""
    return F.regexp_extract(col_(c), r"(?s)\{.*\}", 0)


REPLY_TYPE = ("array<struct<asset: string, reasoning: string, impact_type: string,"
              " sentiment_score: string, confidence_score: string>>")


def reply_object(c) -> Column:
    """B11 step 2: the embedded object (the whole text when it has no braces);
    NULL when that is not one JSON object.  A repeated key keeps its last value.

    Read as the only element of an array, so text after the object is an error
    as it is for a strict parser."""
    x = col_(c)
    body = F.coalesce(F.nullif(embedded_json(x), F.lit("")), x)
    # the end mark survives only if the parser read the text to its end
    arr = F.from_json(F.concat(F.lit("["), body, F.lit(', {"asset": "~end~"}]')), REPLY_TYPE,
                      {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    whole = (F.size(arr) == 2) & (F.get(arr, F.lit(1))["asset"] == "~end~")
    return F.when(whole & F.trim(body).startswith("{"), F.get(arr, F.lit(0)))


def reply_fields(v) -> dict[str, Column]:
    """B11 step 3: typed fields of a parsed reply (``reply_object``).

    Project the object once as a column and read the fields from it, so the
    JSON is parsed once per row, not once per field."""
    v = col_(v)
    text = {n: v[n] for n in ("asset", "reasoning", "impact_type")}
    return text | {n: v[n].try_cast("double") for n in ("sentiment_score", "confidence_score")}


def polar_score(label, prob) -> Column:
    """Positive -> +p, negative -> -p, anything else -> 0."""
    lab, p = col_(label), col_(prob)
    return (F.when(lab == "positive", p)
            .when(lab == "negative", -p)
            .otherwise(F.lit(0.0)))


def lexicon_counts(w, positive=FV.POSITIVE_WORDS, negative=FV.NEGATIVE_WORDS):
    """Occurrences of lexicon words in a word array.

    ``arrays_overlap`` (hash based) rules out most texts at once; only texts
    that contain a lexicon word are scanned word by word."""
    w = col_(w)

    def count(lex):
        arr = F.lit(list(lex))
        return F.when(F.arrays_overlap(w, arr),
                      F.size(F.filter(w, lambda t: F.array_contains(arr, t)))).otherwise(F.lit(0))

    return count(positive), count(negative)


def tags_flatten(c) -> Column:
    """List -> pipe-joined, missing -> ''."""
    return F.coalesce(F.array_join(col_(c), "|"), F.lit(""))
