"""Known inputs and what must be found in them."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from probatio import dims
from probatio.flags import FLAGS
from probatio.functions import checks, entities, text
from probatio.operators import content, external, fonts, images, metadata, scoring, summary, visual

AS_OF = "2024-06-01"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def codes(spark, column):
    return [(f["code"], f["severity"]) for f in one(spark, column)]


# --- scalars and extractors -------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "shown, dates",
    [
        ("1er février 2024", ["2024-02-01"]), ("15 sept. 2024", ["2024-09-15"]), ("30 février 2024", []), ("Date: 15/01/2024", ["2024-01-15"]), ("15-01-2024", ["2024-01-15"]),
        ("15/01/24", ["2024-01-15"]), ("15/13/2024", []), ("32/01/2024", []), ("Du 01/01/2024 au 31/01/2024", ["2024-01-01", "2024-01-31"]),
        ("Jan 23  Fév 23  Mar 23  Avr 23", ["2023-01-01", "2023-02-01", "2023-03-01", "2023-04-01"]), ("", []),
        ("15/01/2024 et 15/01/2024", ["2024-01-15"]), ("15/01/2024 et 15/01/24", ["2024-01-15"]),
    ],
)
def test_dates(shown, dates):
    assert [x[0].strftime("%Y-%m-%d") for x in entities.dates(shown)] == dates


def test_time_of_day_and_kind():
    assert entities.dates("29/06/2022 0:10")[0][0] == datetime(2022, 6, 29, 0, 10)
    assert entities.dates("29/06/2022 25:10") == [] or entities.dates("29/06/2022 25:10")[0][0].day == 29
    assert [x[3] for x in entities.dates("Date de commande: 05/01/2024")] == ["order"]
    assert entities.dates("Total\nÉmise le 5 mars 2024")[0][2] == "Émise le 5 mars 2024"


def test_every_month_has_its_number():
    for name, number in dims.MONTHS.items():
        assert [x[0].month for x in entities.french_dates(f"3 {name} 2020")] == [number], name


@pytest.mark.parametrize("number, valid", [("55208131766522", True), ("55208131766523", False), ("5520813176", False), ("5520813176652a", False), ("", False)])
def test_siret(spark, number, valid):
    assert one(spark, checks.luhn_siret(F.lit(number))) is valid


@pytest.mark.parametrize("number, valid", [("FR03552081317", True), ("fr 03 552081317", True), ("FR99552081317", False), ("DE03552081317", False)])
def test_vat(spark, number, valid):
    assert one(spark, F.coalesce(checks.french_vat(F.lit(number)), F.lit(False))) is valid


@pytest.mark.parametrize("ref, pattern", [("20240115-042", "YYYYMMDD"), ("FAC-202401-0023", "YYYYMM"), ("2024-001", "YYYY"), ("ABC-001", None)])
def test_reference_dates(spark, ref, pattern):
    found = one(spark, checks.reference_date(F.lit(ref)))
    assert (found["pattern"] if found else None) == pattern


def test_identifiers():
    assert entities.FINDERS["sirets"]("SIRET: 552 081 317 66522")[0][0] == "55208131766522"
    assert len(entities.FINDERS["sirets"]("SIRET: 55208131766522\nSIRET: 552 081 317 66522")) == 1
    assert any("Créteil" in value for value, _ in entities.rcs("383 960 135 RCS Créteil"))
    assert entities.rcs("RCS Saint-Denis 552 081 317")[0][0] == "RCS Saint-Denis 552081317"


@pytest.mark.parametrize("shown", ["Total: 1234,56€", "€1234.56", "1 234,56"])
def test_amounts(spark, shown):
    assert 1234.56 in [a["amount"] for a in one(spark, content.amounts(F.lit(shown)))]


@pytest.mark.parametrize(
    "shown, value",
    [("1 234,56 €", 1234.56), ("1,234.56", 1234.56), ("1.234,56", 1234.56), ("12d", None), ("12f", None), ("1234", 1234.0), ("-5,5", -5.5), ("abc", None), ("", None), (".5", 0.5), ("1e3", 1000.0), ("0x1p3", None)],
)
def test_amount_normalised(spark, shown, value):
    assert one(spark, text.amount(F.lit(shown))) == value


@pytest.mark.parametrize("shown, plain", [("Šimek", "SIMEK"), ("Şahin  Öz", "SAHIN OZ"), ("Jérôme\nLefèvre", "JEROME LEFEVRE"), ("été", "ETE"), ("Nguyễn Đình", "NGUYEN ĐINH"), ("Ångström", "ANGSTROM")])
def test_text_normalised(spark, shown, plain):
    assert one(spark, text.normalise(F.lit(shown))) == plain


def test_hex_dates_and_income(spark):
    assert str(one(spark, checks.hex_date(F.lit("2A5F")))) == "2029-09-12" and one(spark, checks.hex_date(F.lit("FFFF"))) is None
    low, high = one(spark, checks.income_range(F.lit(7530.0), F.lit(1.0)))
    assert low == pytest.approx(35911.3, abs=0.1) and high == pytest.approx(59852.1667, abs=0.1)
    assert tuple(one(spark, checks.income_range(F.lit(0.0), F.lit(2.0)))) == (0, 22994)


def test_font_names(spark):
    name = F.lit("BCDFGH+Helvetica-Bold")
    assert one(spark, fonts.base_name(name)) == "Helvetica-Bold" and one(spark, fonts.is_subset(name)) is True
    assert one(spark, fonts.is_subset(F.lit("BCDFG+Helvetica"))) is False


def test_senders(spark):
    shown = F.lit("Email: info@edf.fr, https://www.edf.fr et https://facebook.com/edf")
    found = one(spark, visual.sender_domains(shown))
    assert "edf.fr" in found and not any("facebook" in d for d in found)


# --- rules ------------------------------------------------------------------------------------------------------------


def flags_of(spark, shown):
    rows = content.analyse(spark.createDataFrame([(1, shown)], "doc_id long, text string"), AS_OF).first()
    return {f["code"]: f["severity"] for f in rows["flags"]}, rows


@pytest.mark.parametrize(
    "shown, code, severity",
    [
        ("Date de facture: 15/01/2024\nDate de livraison: 15/02/2024", "CONTENT_ANACHRONISM_SERVICE", "high"),
        ("Date de facture: 15/01/2024\nDate de livraison: 16/01/2024", "CONTENT_ANACHRONISM_SERVICE", None),
        ("le 06/07/2025", "CONTENT_FAR_FUTURE_DATE", "critical"), ("le 31/12/1999", "CONTENT_VERY_OLD_DATE", "medium"), ("le 02/05/2024", "CONTENT_FAR_FUTURE_DATE", None),
        ("SIRET: 55208131766522\nTVA: FR82383960135", "CONTENT_SIREN_VAT_MISMATCH", "critical"),
        ("Facture n° 2024-001\nTVA: 20%", "CONTENT_MISSING_COMPANY_ID", "medium"), ("Invoice #2024-001 Total: $100.00", "CONTENT_MISSING_COMPANY_ID", None),
        ("SIRET: 55208131766523", "CONTENT_INVALID_SIRET", "high"),
    ],
)
def test_content_rules(spark, shown, code, severity):
    assert flags_of(spark, shown)[0].get(code) == severity


def test_clean_invoice(spark):
    shown = "Facture n° 20240115-042\nDate de facture: 15/01/2024\nDate d'échéance: 15/02/2024\nSIRET: 552 081 317 66522\nTVA: FR03552081317\nTotal TTC: 120,00 €"
    found, row = flags_of(spark, shown)
    assert found == {}
    bad, row = flags_of(spark, shown.replace("66522", "66523"))
    assert one(spark, F.lit(100)) - sum({"high": 30}[s] for s in bad.values()) == 70 and set(bad) == {"CONTENT_INVALID_SIRET"}


def test_blank_text(spark):
    for shown in (None, "", " \n"):
        found, row = flags_of(spark, shown)
        assert found == {} and float(row["confidence"]) == 0.1


@pytest.mark.parametrize(
    "producer, found",
    [
        ("iLovePDF Online PDF Editor v2.1", [("META_ONLINE_CONVERTER", "high")]), ("Nitro Pro 13", [("META_SUSPICIOUS_PRODUCER", "medium")]), ("chatgpt", [("META_AI_GENERATED", "critical")]),
        ("canva", [("META_IMAGE_EDITOR", "high")]), ("SAP Crystal Reports", []),
    ],
)
def test_producers(spark, producer, found):
    assert codes(spark, metadata.producer_rules(F.lit(producer), F.lit(""))) == found


@pytest.mark.parametrize(
    "seconds, code, message",
    [(30 * 86400, "META_DOCUMENT_MODIFIED", "30 days"), (3 * 3600, "META_DOCUMENT_MODIFIED", "3h"), (600, "META_DOCUMENT_MODIFIED", "10 minute"), (1, None, None), (-60, "META_IMPOSSIBLE_DATES", "before")],
)
def test_metadata_dates(spark, seconds, code, message):
    created = F.lit("2024-01-15 10:00:00").cast("timestamp_ntz")
    later = F.timestamp_add("SECOND", F.lit(seconds), created)
    found = one(spark, metadata.date_rules(created, later, F.lit(AS_OF).cast("timestamp_ntz")))
    assert [f["code"] for f in found] == ([code] if code else []) and all(message in f["message"] for f in found)


def test_font_rules(spark):
    def column(names):
        made = [F.struct(F.lit(n).alias("name"), F.lit(n.split("+")[-1]).alias("base_name"), F.lit("+" in n).alias("is_subset"), F.lit(True).alias("is_embedded")) for n in names]
        return F.array(*made)

    families = "Arial Calibri Georgia Verdana Futura Optima Univers Lato Roboto Garamond Cambria".split()
    assert [codes(spark, fonts.diversity(column(families[:n]))) for n in (6, 8, 11)] == [[], [("FONTS_HIGH_DIVERSITY", "medium")], [("FONTS_EXCESSIVE_DIVERSITY", "high")]]
    assert codes(spark, fonts.diversity(column(["Arial", "Arial-Bold", "Arial-Italic", "Arial,BoldItalic"]))) == []
    assert codes(spark, fonts.mixed_subsets(column(["ABCDEF+Arial", "Arial"]))) == [("FONTS_MIXED_SUBSETS", "low")]


def test_image_rules(spark):
    def column(*sizes, filter_="DCTDecode"):
        return F.array(*(F.struct(F.lit(1).alias("page"), F.lit(w).alias("width"), F.lit(h).alias("height"), F.lit(filter_).alias("filter"), F.lit(n).alias("size_bytes"), F.lit(d).alias("dpi_x"), F.lit(d).alias("dpi_y")) for w, h, n, d in sizes))

    assert codes(spark, images.resolution_mismatch(column((9, 9, 1, 72.0), (9, 9, 1, 300.0)))) == [("IMAGES_RESOLUTION_MISMATCH", "medium")]
    assert codes(spark, images.resolution_mismatch(column((9, 9, 1, 0.0), (9, 9, 1, 150.0)))) == []
    assert codes(spark, images.heavy_compression(column((1000, 1000, 50_000, 72.0)))) == [("IMAGES_HEAVY_COMPRESSION", "medium")]
    assert codes(spark, images.heavy_compression(column((1000, 1000, 300_000, 72.0)))) == []
    assert codes(spark, images.heavy_compression(column((1000, 1000, 100, 72.0), filter_="FlateDecode"))) == []


@pytest.mark.parametrize("words, kind, severity", dims.WATERMARKS)
def test_watermarks(spark, words, kind, severity):
    word = words.split("|")[0].replace("\\s+", " ").replace("\\s*", " ").replace("(?:", "").replace(")", "").replace("?", "")
    found = one(spark, visual.watermarks(F.lit(f"texte {word.lower()} fin")))
    assert (f"VISUAL_WATERMARK_{kind.replace(' ', '_')}", severity) in [(f["code"], f["severity"]) for f in found]
    assert one(spark, visual.watermarks(F.lit("facture ordinaire"))) == []


@pytest.mark.parametrize("data, code", [("https://bit.ly/x", "VISUAL_QR_URL_SHORTENER"), ("https://pay.xyz/a", "VISUAL_QR_SUSPICIOUS_TLD"), ("https://other.org", "VISUAL_QR_DOMAIN_MISMATCH"), ("plain text", None)])
def test_qr_codes(spark, data, code):
    found = one(spark, visual.qr_rules(F.array(F.struct(F.lit(data).alias("data"), F.lit(1).alias("page"))), F.array(F.lit("client.fr"))))
    assert (code in [f["code"] for f in found]) if code else found == []


def test_registry_prefers_the_seat(spark):
    asked = spark.createDataFrame([(1, 0, "siren", "552081317", None), (2, 0, "siret", "55208131700099", None), (3, 0, "siret", "55208131700001", None)], "doc_id long, ord int, kind string, number string, company string")
    offices = [("552081317", "55208131700001", "branch", "active", None, False), ("552081317", "55208131766522", "seat", "closed", None, True)]
    rows = external.lookups(asked, spark.createDataFrame(offices, "siren string, siret string, name string, status string, error string, is_seat boolean")).collect()
    assert {r["doc_id"]: r["name"] for r in rows} == {1: "seat", 2: "seat", 3: "branch"}


# --- scoring and summary ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rows, score", [([("content", 40, 1.0), ("visual", 100, 1.0)], 64), ([("metadata", 30, 0.1), ("content", 90, 1.0)], 85), ([("metadata", 80, 1.0), ("unknown", 60, 1.0)], 70), ([("content", 0, 0.0)], 100)])
def test_weighted_scores(spark, rows, score):
    table = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, module string, score int, confidence double")
    assert table.groupBy("doc_id").agg(scoring.weighted_score().alias("s")).first()["s"] == score


@pytest.mark.parametrize("score, level", [(100, "LOW"), (80, "LOW"), (79, "MEDIUM"), (50, "MEDIUM"), (49, "HIGH"), (20, "HIGH"), (19, "CRITICAL"), (0, "CRITICAL")])
def test_risk_levels(spark, score, level):
    assert one(spark, scoring.risk_level(F.lit(score))) == level


def judged(spark, flags):
    rows = [(1, m, [(s, c, c.title(), d) for mm, s, c, d in flags if mm == m], 1.0) for m in ("metadata", "content", "fonts")]
    return summary.summaries(spark.createDataFrame(rows, f"doc_id long, module string, flags {FLAGS}, confidence double")).first()


def test_summaries(spark):
    row = judged(spark, [
        ("content", "high", "CONTENT_INVALID_SIRET", {"siret": "123"}), ("content", "high", "CONTENT_INVALID_SIRET", {"siret": "456"}),
        ("content", "critical", "CONTENT_FAR_FUTURE_DATE", {"date": "2030-01-01", "context": "le 01/01/2030"}),
        ("metadata", "high", "META_ONLINE_CONVERTER", {"producer": "Some Producer"}), ("fonts", "low", "FONTS_SYSTEM_FONTS", {}),
    ])
    assert row["theme"] == "identity" and row["risk_level"] == "HIGH"
    assert row["bullets"] == [
        "A date far in the future was found (2030-01-01) near: le 01/01/2030.",
        "The SIRET number (123) has an invalid checksum.",
        "The document was processed through Some Producer, an online converter commonly used to modify documents.",
    ]
    assert row["summary"] == " ".join([row["verdict"], *row["bullets"]]) and row["verdict"] == dims.VERDICTS["HIGH"]["identity"]


def test_sentences_of_changed_documents(spark):
    said = lambda hours: judged(spark, [("metadata", "critical", "META_DOCUMENT_MODIFIED", {"time_difference_hours": hours})])["bullets"]
    assert said("49.5") == ["The document was modified 2 days after creation."]
    assert said("3.25") == ["The document was modified 3.2h after creation."]
    assert judged(spark, [("metadata", "high", "META_ONLINE_CONVERTER", {})])["bullets"] == ["The document was processed through an unknown tool, an online converter commonly used to modify documents."]


def test_equal_themes_go_by_the_order_of_flags(spark):
    row = judged(spark, [("content", "high", "CONTENT_INVALID_SIRET", {"siret": "1"}), ("metadata", "high", "META_ONLINE_CONVERTER", {"detected_tool": "x"})])
    assert row["theme"] == "origin"
    assert judged(spark, [])["theme"] is None and judged(spark, [])["bullets"] == []


def test_summaries_read_the_modules_once_and_bullets_are_those_of_plain_rules(spark):
    """One aggregation and no join; at most two sentences a theme, no code and no sentence twice, most severe first."""
    draw, ranks = random.Random(5), {s: i for i, s in enumerate(dims.SEVERITY_RANK)}
    codes, order = sorted(set(dims.THEME_OF) - set(dims.SENTENCES) - {"META_DOCUMENT_MODIFIED", "CONTENT_FAR_FUTURE_DATE"}) + ["UNKNOWN"], {m: i for i, m in enumerate(dims.MODULE_ORDER)}
    rows = [(d, m, [(draw.choice(list(ranks)), draw.choice(codes), draw.choice("abcdefgh"), {}) for _ in range(draw.choice([0, 1, 4]))], 1.0) for d in range(30) for m in order]
    said = summary.summaries(spark.createDataFrame(rows, f"doc_id long, module string, flags {FLAGS}, confidence double"))
    plan = said._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate [") == 1
    found = {r["doc_id"]: r["bullets"] for r in said.collect()}
    for d in range(30):
        mine = sorted((ranks[s], order[m], i, c, text) for doc, m, flags, _ in rows if doc == d for i, (s, c, text, _) in enumerate(flags) if s != "low")
        codes_, texts, by_theme = set(), set(), {name: [] for name in dims.THEME_ORDER}
        for _, _, _, code, text in mine:
            if code not in codes_ and text not in texts:
                by_theme.get(dims.THEME_OF.get(code, "other"), []).append(text)
                texts.add(text)
            codes_.add(code)
        assert found[d] == [text for name in dims.THEME_ORDER for text in by_theme[name][:2]]
