from pyspark.sql import functions as F

from gleaner.functions import fulltext, labels, text


def test_title_key_keeps_accents_and_drops_markup(value):
    raw = F.lit(" <i>Mamíferos</i>—of the  Islands: a_b “Review” ")
    assert value(text.normalize_title(raw)) == "mamíferos-of the islands a_b review"
    assert value(text.normalize_title(F.lit(None).cast("string"))) is None
    assert value(text.match_key(F.lit(" <b></b> !"), "title")) is None


def test_doi_key(value):
    for raw in (" HTTPS://doi.org/10.1/AbC ", "doi: 10.1/abc", "http://doi.org/10.1/ABC"):
        assert value(text.normalize_doi(F.lit(raw))) == "10.1/abc"


def test_blank_is_null_and_validity(value):
    assert value(text.clean_or_null(F.lit("\t \n"))) is None
    assert value(text.scorable(F.lit("a"), F.lit(" "))) is False
    assert value(text.scorable(F.lit("a"))) is True
    assert value(text.scorable(F.lit(None).cast("string"), F.lit("t"))) is False


def test_sentence_end(value):
    ends = {"a": "a.", "a.": "a.", "a?)": "a?)", 'a."': 'a."', "a…": "a…", " ": ""}
    for raw, want in ends.items():
        assert value(text.ensure_terminated(F.lit(raw))) == want


def test_ngrams_and_tokens(value):
    assert value(text.word_tokens(F.lit("A Día of x2 i"))) == ["día", "of", "x2"]
    tokens = F.array(*[F.lit(w) for w in "abcd"])
    assert value(text.ngrams(tokens, 3)) == ["a b c", "b c d"]
    assert value(text.ngrams(tokens, 5)) == []


def test_inputs(value):
    cells = (F.lit("t"), F.lit("a"), F.lit(None).cast("string"))
    assert value(text.joined_input(*cells, True, True)) == "t a "
    assert tuple(value(text.paired_input(*cells, True, True))) == ("t[SEP]", "a")
    assert tuple(value(text.paired_input(*cells, False, False))) == ("a", None)


def test_levels_include_their_lower_edge(value):
    want = {0.8: "High Relevance", 0.79: "Medium-High Relevance", 0.6: "Medium-High Relevance",
            0.4: "Medium Relevance", 0.2: "Low Relevance", 0.19: "Very Low Relevance"}
    for score, level in want.items():
        assert value(labels.relevance_level(F.lit(score))) == level
    assert value(labels.relevance_level(F.lit(None).cast("double"))) is None


def test_kappa_levels(value):
    want = {0.755: "Substantial", 0.813: "Almost Perfect", 0.441: "Moderate", 0.3: "Fair", -0.1: "Slight/Poor"}
    for kappa, level in want.items():
        assert value(labels.kappa_level(F.lit(kappa))) == level


def test_decision_is_strict(value):
    assert value(labels.decision(F.lit(0.5)), labels.decision(F.lit(0.51))) == (0, 1)


def test_families_try_the_longer_name_first(value):
    full = F.lit("BiomedNLP-BiomedBERT-base-uncased-abstract-fulltext_BCE_with_title_run-0_opt_neg-500")
    assert value(labels.model_family(full)) == "BiomedBERT-AF"
    assert value(labels.abbreviated_run(full)) == "BiomedBERT-AF +BCE +T (N500)"
    assert value(labels.model_domain(F.lit("FacebookAI/roberta-base"))) == "Out-of-Domain"
    assert value(labels.short_model_name(F.lit("dmis-lab/biobert-v1.1"))) == "biobert-v1"
    assert value(labels.short_model_name(F.lit("other"))) == "other"


def test_shown_values_round_like_python(value):
    for x in (0.0625, 0.1875, 0.5, 0.12345, 1.0):
        assert value(labels.shown_number(F.lit(x), 3)) == f"{x:.3f}"
    assert value(labels.shown_percent(F.lit(0.8))) == "80.0%"
    assert value(labels.shown_number(F.lit(None).cast("double"), 3)) == "N/A"


def test_flat_text(value):
    body = """[
      {"label": "Box", "caption": "A note", "title": "Title", "contents": [{"tag": "p", "text": " one "}]},
      {"label": "1", "caption": "", "title": "Methods", "contents": [
         {"tag": "list-item", "text": "two!"}, {"tag": "fn", "text": "see there"}, {"tag": "p", "text": "  "},
         {"text": "three"}]},
      {"title": "Abstract", "contents": []}]"""
    got = value(fulltext.flat_text(F.from_json(F.lit(body), fulltext.BODY_SCHEMA)))
    assert got == "Box: A note. one. 1. Methods. - two! three.\n\nFootnotes:\n- see there."
    assert value(fulltext.flat_text(F.lit(None).cast(fulltext.BODY_SCHEMA))) == ""
