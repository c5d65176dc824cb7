"""Flat text of a nested article body, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import ensure_terminated, is_specific_header, strip_blank

BODY_SCHEMA = ("array<struct<label:string,caption:string,title:string,"
               "contents:array<struct<tag:string,text:string>>>>")


def _text(value: Column) -> Column:
    return strip_blank(F.coalesce(value, F.lit("")))


def _contents(section: Column) -> Column:
    """Non-blank content items of a section, each with its text ending a sentence."""
    items = F.coalesce(section.contents, F.array().cast("array<struct<tag:string,text:string>>"))
    shaped = F.transform(items, lambda c: F.struct(
        F.coalesce(c.tag, F.lit("")).alias("tag"), ensure_terminated(_text(c.text)).alias("text")))
    return F.filter(shaped, lambda c: c.text != "")


def _header(value: Column, boxes: bool) -> Column:
    keep = is_specific_header(value)
    if boxes:
        keep = keep & (F.lower(value) != "box")
    return F.when(keep, ensure_terminated(value))


def _section(section: Column) -> Column:
    box = F.when(F.lower(_text(section.label)) == "box", F.lit("Box:"))
    headers = F.array(box, _header(_text(section.label), True), _header(_text(section.caption), True),
                      _header(_text(section.title), False))
    body = F.transform(
        F.filter(_contents(section), lambda c: c.tag != "fn"),
        lambda c: F.when(c.tag == "list-item", F.concat(F.lit("- "), c.text)).otherwise(c.text))
    return F.array_join(F.concat(F.array_compact(headers), body), " ")


def flat_text(sections: Column) -> Column:
    """Headers, boxes and bullets in reading order, footnotes collected at the end."""
    sections = F.coalesce(sections, F.array().cast(BODY_SCHEMA))
    main = F.array_join(F.filter(F.transform(sections, _section), lambda s: s != ""), " ")
    notes = F.flatten(F.transform(sections, lambda s: F.transform(
        F.filter(_contents(s), lambda c: c.tag == "fn"), lambda c: F.concat(F.lit("- "), c.text))))
    tail = F.when(F.size(notes) > 0, F.concat(F.lit("\n\nFootnotes:\n"), F.array_join(notes, "\n")))
    return F.concat(main, F.coalesce(tail, F.lit("")))
