from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import contacts, keys, numerics, text
from probatio.functions.rounding import round_tenth
from probatio.operators import passages


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("t"))).collect()]


def test_normalise_equals_unicode_folding(spark):
    rng = random.Random(7)
    letters = ("abcXYZ 0129.,;'’-–€ \t\n   éèêëàâçôöûüÉÈÀÇÑñßœæıİªº²³½…™"
               "ﬁﬂĳœŁłØøČčŠšŽžΑάέΩωςабвЁё")
    samples = ["".join(rng.choices(letters, k=40)) for _ in range(300)]
    assert column(spark, samples, text.normalise) == [
        text.local_normalise(s) for s in samples]


@pytest.mark.parametrize("word, stemmed", [
    ("panneaux", "panneau"), ("chevaux", "cheval"), ("solaires", "solaire"),
    ("prix", "prix"), ("eaux", "eaux"), ("choix", "choi")])
def test_stem_order(spark, word, stemmed):
    assert column(spark, [word], text.stem) == [stemmed] == [text.local_stem(word)]


def test_slugs_keep_the_whole_title(spark):
    long = "mot " * 100
    slug = column(spark, [long, long + "x", "", "É à ç!"], text.slug)
    assert slug == ["-".join(["mot"] * 100), "-".join(["mot"] * 100) + "-x", "untitled", "e-a-c"]
    assert column(spark, ["", "Prix 2026"], text.page_slug) == ["page", "prix-2026"]
    assert len(column(spark, [long], text.page_slug)[0]) == 399


def test_quantities_are_typed_once(spark):
    got = column(spark, ["1,5 € par Wc", "5 ans", "20 %", "le 12/03/2026", "5 000 €",
                         "tranche 3 5 ans", "2026 5 000 €", None], numerics.quantities)
    kinds = [[(q["type"], q["digits"]) for q in row] for row in got]
    assert kinds == [
        [("RATE", "15")], [("DURATION", "5")], [("PERCENT", "20")],
        [("DATE", "12032026")], [("MONEY", "5000")], [("DURATION", "5")],
        [("MONEY", "20265000")], []]


def test_word_boundaries_know_accents(spark):
    hit = column(spark, ["prix élevé", "lev", "un lev!", "élev"],
                 lambda c: text.has_term(c, ["lev"]))
    assert hit == [False, True, True, False]


def test_timestamps_are_never_invented(spark):
    values = ["2026-08-12 09:00:00 +00:00", "2024-05-01", "2024-05-01T10:00:00Z", "soon",
              "12", None]
    got = column(spark, values, lambda c: keys.timestamp_or_null(c).isNotNull())
    assert got == [True, True, True, False, False, False]


def test_contact_fields(spark):
    assert column(spark, ["0032 2/123.45.67", "12", "+32 475 11 22 33", None],
                  contacts.phone) == ["+3221234567", None, "+32475112233", None]
    assert column(spark, [" A@B.be ", "a@b", "x y@z.be"], contacts.email) == [
        "a@b.be", None, None]
    assert column(spark, ["jean@x.be", "a@x.be", "nope"], contacts.mask_email) == [
        "je***@x.be", "a***@x.be", "***"]
    redacted = column(spark, ['{"api_key": "abc", "x": 1} sk-abcdefgh12'], contacts.redact)
    assert "abc" not in redacted[0].replace("***", "") and '"x": 1' in redacted[0]


def test_rounding_follows_the_binary_value(spark):
    values = [10.45, 14.15, 0.1415 * 100, 86.25, 86.75, 1.95, 0.05, 100.0, 53.45, 0.0]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in rows.orderBy("i").select(round_tenth(F.col("v"))).collect()]
    assert got == [round(v, 1) for v in values]


def test_sentences_split_before_capitals(spark):
    rng = random.Random(3)
    samples = ["".join(rng.choices("aB. !?é1É\n", k=60)) for _ in range(200)]
    expected = [re.split(r"(?<=[.!?])\s+(?=[A-ZÀ-ÿ0-9])", s) for s in samples]
    assert column(spark, samples, text.split_sentences) == expected


def test_claims_keep_the_digits_they_begin_with(spark):
    kept = spark.createDataFrame([(
        "Les panneaux neufs coûtent cher en hiver. 148 foyers sur la côte est reçoivent une aide. "
        "2024 est une année sans aucune aide publique; 3 kWc coûtent 100 €, 5 kWc coûtent 200 €; "
        "les onduleurs durent 10 ans au moins selon eux.",)], "passage string")
    said = [r.claim for r in passages.claims(kept).orderBy("claim_ord").collect()]
    assert said[1:3] == ["148 foyers sur la côte est reçoivent une aide.",
                         "2024 est une année sans aucune aide publique"]
    assert said[3].startswith("3 kWc coûtent")


def test_white_space_is_squeezed_as_before(spark):
    rng = random.Random(11)
    samples = ["".join(rng.choices("ab É   \t\n\r\x0b\x0c\x1c.", k=30)) for _ in range(300)]
    whole = column(spark, samples, lambda c: F.trim(F.regexp_replace(text.fold(c), r"\s+", " ")))
    assert column(spark, samples, text.normalise) == whole
    assert column(spark, samples, text.squeeze) == column(spark, samples, lambda c: F.trim(
        F.regexp_replace(F.translate(c, text._WIDE_SPACES, " " * len(text._WIDE_SPACES)),
                         r"\s+", " ")))


def test_single_spaces_are_no_match_to_replace():
    assert not re.search(text._UNEVEN, "one space between words")
    assert re.sub(text._UNEVEN, " ", "a \t b\nc  d") == "a b c d"


def test_figure_pieces_stand_in_every_match(monkeypatch):
    samples = ["1,5 € par Wc", "2 EUROS/KWH", "3 eur par m²", "20 %", "$ 5", "7 Cents", "9 KWc", "1 MW",
               "3 watt-crête", "4 GWh", "5 ans", "6 Années", "7 MOIS", "2 jaar", "3 Years", "9 jours",
               "1/2/2024", "2024-01-02", "1.2.24", "en 2024", "tranche 3", "5 Kwh", "1 MẄ", "x"]
    with_pieces = [numerics.read_quantities(s, numerics.compiled_patterns()) for s in samples]
    monkeypatch.setattr(fv, "NUMERIC_PIECES", {})
    assert with_pieces == [numerics.read_quantities(s, numerics.compiled_patterns()) for s in samples]


def test_figures_skip_patterns_without_a_piece():
    class Never:
        def finditer(self, _):
            raise AssertionError("a text without the piece is not searched")

    assert numerics.read_quantities("en 2024", [("PERCENT", Never(), ("%",))]) == []


def test_terms_that_hold_another_term_are_not_searched(spark):
    terms = ["entre", "varie entre", "compris entre", "tarif"]
    assert str(text.contains_any(F.col("t"), terms)).count("contains") == 2
    assert column(spark, ["il varie entre", "rentre", "x", "tarifs"],
                  lambda c: text.contains_any(c, terms)) == [True, True, False, True]


def test_price_pieces_stand_in_every_match():
    texts = ["10 € par kWc", "par KWp", "/ watt-crête", "par m²", "/m2", "par KWH", "par An", "le panneau seul",
             "panneau solaire revient", "installation", "BUDGET", "au total", "investissement", "TVAC", "ttc",
             "btw inbegrepen", "incl. TVA", "hors taxes", "exclusief BTW", "5 kWc", "3-6 kwp", "avec batterie",
             "met batterij", "batterie en option", "pose comprise", "CLÉ EN MAIN", "tout compris", "hors pose",
             "matériel seul", "panneau seul", "hors installation"]
    named = [*[(p, fv.BASIS_PIECES[n]) for n, p in fv.BASIS_PATTERNS],
             (fv.TOTAL_WORDS_PATTERN, fv.TOTAL_WORDS_PIECES), (fv.VAT_INCLUDED_PATTERN, fv.VAT_INCLUDED_PIECES),
             (fv.VAT_EXCLUDED_PATTERN, fv.VAT_EXCLUDED_PIECES), (fv.SYSTEM_SIZE_PATTERN, fv.SYSTEM_SIZE_PIECES),
             (fv.BATTERY_IN_PATTERN, fv.BATTERY_PIECES), (fv.BATTERY_OUT_PATTERN, fv.BATTERY_PIECES),
             (fv.INSTALLATION_IN_PATTERN, fv.INSTALLATION_IN_PIECES),
             (fv.INSTALLATION_OUT_PATTERN, fv.INSTALLATION_OUT_PIECES)]
    for pattern, pieces in named:
        # Python has no flag U inside a pattern that turns classes to Unicode; they are already.
        found = [t for t in texts if re.search(pattern.replace("(?iU)", "(?i)"), t)]
        assert found and all(any(p in t.lower() for p in pieces) for t in found)
