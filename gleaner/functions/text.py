"""String columns: normalisers, validity, model-input assembly, shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three dash characters that are unified with the hyphen.
DASHES = "–—‐"

# Letters, digits and underscore of any script, spelled out because Java's \w
# is ASCII unless told otherwise and its Unicode form also takes in marks.
WORD = r"\p{L}\p{N}_"
# The characters that count as white space, as a class and one by one.
BLANK = r"\s\p{Z}\x1c-\x1f\x85"
BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
          "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip_blank(text: Column) -> Column:
    """Remove leading and trailing white space of any kind, not only blanks."""
    return F.btrim(text, F.lit(BLANKS))


def clean_or_null(text: Column) -> Column:
    """Stripped string, or NULL when nothing is left."""
    return F.nullif(strip_blank(text.cast("string")), F.lit(""))


def collapse_blank(text: Column) -> Column:
    return strip_blank(F.regexp_replace(text, f"[{BLANK}]+", " "))


def normalize_title(text: Column) -> Column:
    """Comparison form of a title; NULL stays NULL so that it never matches.

    Lower case, markup tags removed, dashes unified, punctuation other than the
    hyphen turned into a blank, white space collapsed.
    """
    lowered = F.regexp_replace(F.lower(text), r"<[^>]+>", "")
    dashed = F.translate(lowered, DASHES, "-" * len(DASHES))
    return collapse_blank(F.regexp_replace(dashed, f"[^{WORD}{BLANK}-]", " "))


def normalize_doi(text: Column) -> Column:
    """Lower case without resolver address or ``doi:`` prefix."""
    out = strip_blank(F.lower(text))
    for prefix in ("https://doi.org/", "http://doi.org/", "doi:"):
        out = F.replace(out, F.lit(prefix), F.lit(""))
    return strip_blank(out)


def id_key(value: Column) -> Column:
    """Identifier as a join key: stripped, lower case, never blank."""
    return clean_or_null(F.lower(value.cast("string")))


def match_key(value: Column, kind: str) -> Column:
    """Join key for a column of ``kind`` ``title``, ``doi``, ``id`` or ``raw``."""
    if kind == "title":
        return F.nullif(normalize_title(value), F.lit(""))
    if kind == "doi":
        return F.nullif(normalize_doi(value), F.lit(""))
    if kind == "id":
        return id_key(value)
    if kind == "raw":
        return value.cast("string")
    raise ValueError(f"unknown key kind: {kind}")


def one_line(text: Column) -> Column:
    """Line feeds become blanks, the ends are stripped."""
    return strip_blank(F.translate(text, "\n", " "))


def ensure_terminated(text: Column) -> Column:
    """Stripped text that ends a sentence, with a full stop added if it does not."""
    stripped = strip_blank(text)
    closed = stripped.rlike(r"""[.?!…]["')\]]?$""")
    return F.when((stripped == "") | closed, stripped).otherwise(F.concat(stripped, F.lit(".")))


def is_specific_header(text: Column) -> Column:
    """True for a header that says more than "title" or "abstract"."""
    shown = F.coalesce(text, F.lit(""))
    return (shown != "") & ~strip_blank(F.lower(shown)).isin("title", "abstract")


def scorable(abstract: Column, title: Column | None = None) -> Column:
    """Whether a record can be scored: an abstract, and a title where that column exists."""
    ok = clean_or_null(abstract).isNotNull()
    return ok if title is None else ok & clean_or_null(title).isNotNull()


def joined_input(title: Column, abstract: Column, keywords: Column,
                 with_title: bool, with_keywords: bool) -> Column:
    """One model input; an absent part counts as empty."""
    parts = [title] if with_title else []
    parts.append(abstract)
    if with_keywords:
        parts.append(keywords)
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def paired_input(title: Column, abstract: Column, keywords: Column,
                 with_title: bool, with_keywords: bool, separator: str = "[SEP]") -> Column:
    """Model input as a struct of two texts, the second NULL when only one is used."""
    title, abstract, keywords = (F.coalesce(c, F.lit("")) for c in (title, abstract, keywords))
    if with_title and with_keywords:
        first, second = F.concat(title, F.lit(separator), keywords), abstract
    elif with_title:
        first, second = title, abstract
    elif with_keywords:
        first, second = abstract, keywords
    else:
        first, second = abstract, F.lit(None).cast("string")
    return F.struct(first.alias("first"), second.alias("second"))


def input_length(title: Column, abstract: Column) -> Column:
    """Characters of title and abstract together."""
    return F.length(F.coalesce(title, F.lit(""))) + F.length(F.coalesce(abstract, F.lit("")))


def blank_tokens(text: Column) -> Column:
    """Tokens between runs of white space."""
    return F.filter(F.split(text, f"[{BLANK}]+"), lambda t: t != "")


def word_tokens(text: Column) -> Column:
    """Lower-case runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]{{2,}}"), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` neighbouring tokens, joined by a blank.

    The token array is bound to a lambda variable, so it is built once per row and
    not once per run.
    """
    def runs(held: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(held) - F.lit(n - 1))
        grams = F.transform(starts, lambda i: F.array_join(F.slice(held, i, n), " "))
        return F.when(F.size(held) >= n, grams).otherwise(F.array().cast("array<string>"))
    return F.get(F.transform(F.array(tokens), runs), F.lit(0))


def content_signature(*parts: Column) -> Column:
    """Digest that changes when any part of a record does."""
    marked = [F.coalesce(F.concat(F.lit("v"), p.cast("string")), F.lit("n")) for p in parts]
    return F.md5(F.concat_ws("\x1f", *marked))


def shorten(text: Column, limit: int = 60) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)
