"""Columns that turn scores, statistics and names into labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def banded(value: Column, bands: Sequence[tuple[float, str]], lowest: str) -> Column:
    """Name of the first band whose lower edge ``value`` reaches; NULL for NULL."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, name in bands:
        out = out.when(value >= edge, F.lit(name))
    return out.otherwise(F.lit(lowest))


# Names and lower edges of the score and agreement scales.
RELEVANCE = [(0.8, "High Relevance"), (0.6, "Medium-High Relevance"),
             (0.4, "Medium Relevance"), (0.2, "Low Relevance")]
RELEVANCE_LOWEST = "Very Low Relevance"
KAPPA = [(0.81, "Almost Perfect"), (0.61, "Substantial"), (0.41, "Moderate"), (0.21, "Fair")]
KAPPA_LOWEST = "Slight/Poor"
RANKING_BANDS = [(0.9, "high"), (0.5, "medium")]
RELEVANCE_BANDS = [(0.6, "high"), (0.4, "medium")]


def relevance_level(score: Column) -> Column:
    return banded(score, RELEVANCE, RELEVANCE_LOWEST)


def kappa_level(kappa: Column) -> Column:
    return F.coalesce(banded(kappa, KAPPA, KAPPA_LOWEST), F.lit("N/A"))


def ranking_band(score: Column) -> Column:
    return banded(score, RANKING_BANDS, "low")


def relevance_band(score: Column) -> Column:
    return banded(score, RELEVANCE_BANDS, "low")


def decision(score: Column, threshold: Column | float = 0.5) -> Column:
    """1 strictly above the threshold, else 0."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (score > limit).cast("int")


def error_type(label: Column, prediction: Column) -> Column:
    """``False Positive``, ``False Negative`` or NULL for a right decision."""
    return (F.when((label == 0) & (prediction == 1), F.lit("False Positive"))
            .when((label == 1) & (prediction == 0), F.lit("False Negative")))


def recode_optional(label: Column, sentinel: int = -1) -> Column:
    """Optional negatives count as negatives once the folds are drawn."""
    return F.when(label == sentinel, F.lit(0)).otherwise(label).cast("int")


# Levels and names of significance and effect size.
def significance(p: Column) -> Column:
    return (F.when(p < 0.001, "highly significant").when(p < 0.01, "very significant")
            .when(p < 0.05, "significant").when(p.isNotNull(), "not significant"))


def effect_size(d: Column) -> Column:
    size = F.abs(d)
    return (F.when(size < 0.2, "small").when(size < 0.5, "small to medium")
            .when(size < 0.8, "medium to large").when(d.isNotNull(), "large"))


# Short names of published checkpoints.
SHORT_NAMES = {
    "microsoft/BiomedNLP-BiomedBERT-base-uncased-abstract": "BiomedBERT-abs",
    "microsoft/BiomedNLP-BiomedBERT-base-uncased-abstract-fulltext": "BiomedBERT-abs-ft",
    "FacebookAI/roberta-base": "roberta-base",
    "dmis-lab/biobert-v1.1": "biobert-v1",
    "google-bert/bert-base-uncased": "bert-base",
}

# Fixed values, in the order they are tried: the full-text variant contains the
# name of the abstract variant.
FAMILIES = [("ensemble", "Ensemble"), ("roberta", "RoBERTa"),
            ("biomedbert-base-uncased-abstract-fulltext", "BiomedBERT-AF"),
            ("biomedbert", "BiomedBERT-A"), ("biobert", "BioBERT"), ("bert-base-uncased", "BERT")]
DOMAINS = [("biobert", "In-Domain"), ("biomed", "In-Domain"), ("bert-base", "Out-of-Domain"),
           ("roberta", "Out-of-Domain"), ("ensemble", "Ensemble")]


def short_model_name(name: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in SHORT_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, name), name)


def _first_contained(name: Column, table: Sequence[tuple[str, str]]) -> Column:
    lowered = F.lower(name)
    out = F.when(name.isNull(), F.lit(None).cast("string"))
    for part, label in table:
        out = out.when(lowered.contains(part), F.lit(label))
    return out.otherwise(F.lit("Other"))


def model_family(name: Column) -> Column:
    return _first_contained(name, FAMILIES)


def model_domain(name: Column) -> Column:
    return _first_contained(name, DOMAINS)


# Marks of a short run label.
def abbreviated_run(name: Column) -> Column:
    """Short label of a run name: family, loss, title flag, added negatives."""
    none = F.lit("")
    loss = F.when(name.contains("BCE"), " +BCE").when(name.contains("focal"), " +FL").otherwise(none)
    title = F.when(name.contains("with_title"), " +T").otherwise(none)
    added = (F.when(name.contains("opt_neg-1000"), " (N1k)")
             .when(name.contains("opt_neg-500"), " (N500)").otherwise(none))
    return F.concat(model_family(name), loss, title, added)


# Parts of names that the compact form replaces.
def compact_model_name(name: Column) -> Column:
    out = name
    for old, new in (("BiomedNLP-", ""), ("BiomedBERT-abs", "BiomedBERT"), ("-ft", "-FT")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def config_label(loss: Column, with_title: Column, added: Column) -> Column:
    title = F.when(with_title, "with_title").otherwise("no_title")
    return F.concat_ws("_", loss, title, added.cast("int").cast("string"))


def title_keyword_label(with_title: Column, with_keywords: Column) -> Column:
    def flag(c: Column) -> Column:
        return F.when(c, "True").otherwise("False")
    return F.concat_ws(" / ", flag(with_title), flag(with_keywords))


def _fixed(value: Column, digits: int) -> Column:
    """Text with so many decimals; an exact half goes to the even digit, as in C and Python."""
    value = value.cast("double")
    steps = value * float(2 ** (digits + 1))
    even = F.when(steps == F.floor(steps), F.bround(value, digits)).otherwise(value)
    return F.format_string(f"%.{digits}f", even)


def shown_number(value: Column, digits: int) -> Column:
    """Fixed number of decimals, ``N/A`` for NULL."""
    return F.when(value.isNull(), F.lit("N/A")).otherwise(_fixed(value, digits))


def shown_percent(value: Column, digits: int = 1) -> Column:
    return F.when(value.isNull(), F.lit("N/A")).otherwise(F.concat(_fixed(value * 100, digits), F.lit("%")))


def shown_range(low: Column, high: Column, digits: int = 3) -> Column:
    return F.when(low.isNull(), F.lit("N/A")).otherwise(
        F.concat(_fixed(low, digits), F.lit("-"), _fixed(high, digits)))
