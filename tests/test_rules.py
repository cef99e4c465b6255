"""Rule tables: hand-written inputs and the rows they must give."""

import datetime as dt

import pytest

from forecourt import lexicon as lx
from forecourt.functions import issues, rules
from forecourt.functions import keywords as found
from forecourt.functions import sentiment as st
from forecourt.functions import text as tx


def test_table_sizes():
    assert len(lx.ISSUE_KEYWORDS) == 17
    assert sum(map(len, lx.ISSUE_KEYWORDS.values())) == 234
    assert sum(map(len, lx.ASPECT_KEYWORDS.values())) == 80
    assert len(set(lx.MINING_STOP_WORDS)) == 214
    assert len(set(lx.KEYWORD_STOP_WORDS)) == 166


def test_lexicon_from_json():
    lexi = lx.Lexicon.from_json('{"issues": {"Price": ["dear"]}, "brands": [["acme", "Acme"]]}')
    assert lexi.issues == {"Price": ["dear"]} and lexi.brands == [("acme", "Acme")]
    assert lexi.aspects == lx.ASPECT_KEYWORDS


def test_brand(values):
    got = values(lambda F: rules.brand(F.col("x")), [
        "Bharat Petroleum - Shell Road", "City HP", "HP Fuel", None, "SHELL", "Ramesh Fuels"])
    assert got == ["BPCL", "Other", "HP", "Other", "Shell", "Other"]


def test_zone(values):
    nan = float("nan")
    got = values(lambda F: rules.zone(F.col("a"), F.col("b")), [
        (18.969, 72.8), (18.970, 72.880), (19.050, 72.880), (19.050, 72.879), (19.150, 72.880),
        (None, 72.8), (nan, 72.8), (19.1, nan)], "a double, b double")
    assert got == ["South Mumbai", "Central Mumbai", "Eastern Suburbs", "Western Suburbs",
                   "North Suburbs", "Unknown", "Unknown", "Unknown"]
    assert values(lambda F: rules.zone(F.col("a"), F.col("b"), missing_label="Mumbai"),
                  [(None, None)], "a double, b double") == ["Mumbai"]


def test_category_and_fuel(values):
    inputs = ["Compressed natural gas station", "Gas station", None]
    assert values(lambda F: rules.station_category(F.col("x")), inputs) == [
        "CNG Station", "Petrol Pump", "Petrol Pump"]
    assert values(lambda F: rules.fuel_type(F.col("x")), inputs) == [
        "CNG", "Petrol / Diesel", "Petrol / Diesel"]


def test_rating_sentiment(values):
    got = values(lambda F: rules.rating_sentiment(F.col("x")),
                 [2.5, 2.51, 3.5, 3.51, None, float("nan")], "double")
    assert got == ["Negative", "Neutral", "Neutral", "Positive", "Unknown", "Unknown"]


def test_star_sentiment(values):
    assert values(lambda F: rules.star_sentiment(F.col("x")), [1, 2, 3, 4, 5], "int") == [
        "Negative", "Negative", "Neutral", "Positive", "Positive"]


def test_distribution(values):
    got = values(lambda F: st.result(F.col("x")),
                 [([0.3, 0.1, 0.3, 0.2, 0.1],), ([0.0, 0.1, 0.2, 0.3, 0.4],)], "x array<double>")
    assert got[0]["star"] == 1 and got[0]["sentiment"] == "Negative"
    assert got[0]["prob_negative"] == pytest.approx(0.4) and got[0]["confidence"] == 0.3
    assert got[1]["star"] == 5 and got[1]["prob_positive"] == pytest.approx(0.7)


def test_softmax(values):
    (got,) = values(lambda F: st.softmax(F.col("x")), [([1000.0, 1000.0],)], "x array<double>")
    assert got == [0.5, 0.5]


@pytest.mark.parametrize("text,sentiment,flips", [
    ("Fake bill", "Positive", True), ("no CNG", "Positive", True), ("scammed", "Positive", False),
    ("no CNG here", "Positive", True), ("they overcharged", "Positive", True),
    ("fraud", "Neutral", False), ("fine", "Positive", False), (None, "Positive", False),
    ("éfraud", "Positive", False), ("rip \t off!", "Positive", True)])
def test_override(spark, text, sentiment, flips):
    from pyspark.sql import functions as F
    res = F.struct(F.lit(sentiment).alias("sentiment"), F.lit(0.5).alias("confidence"),
                   F.lit(4).alias("star"), F.lit(0.1).alias("prob_negative"),
                   F.lit(0.1).alias("prob_neutral"), F.lit(0.8).alias("prob_positive"))
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(st.apply_override(F.col("t"), res).alias("r")).first()["r"]
    if flips:
        assert tuple(r) == ("Negative", 0.5, 2, 0.6, 0.1, 0.2)
    else:
        assert tuple(r) == (sentiment, 0.5, 4, 0.1, 0.1, 0.8)


def test_override_searches_a_text_once(spark):
    from pyspark.sql import functions as F
    row = spark.createDataFrame([("rude staff", 5)], "t string, star int").withColumn("p", F.array(*[F.col("star") * 0.04] * 5))
    rows = row.select(tx.let(st.result(F.col("p")), lambda r: st.apply_override(F.col("t"), r)).alias("r"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("(?iu)") == 1
    assert rows.selectExpr("r.*").columns == [
        "sentiment", "confidence", "star", "prob_negative", "prob_neutral", "prob_positive"]


def test_override_rejects_inner_edges():
    with pytest.raises(ValueError):
        st.override_pattern([r"a\bb"])


def brute_issue(text, table=lx.ISSUE_KEYWORDS):
    low = (text or "").lower()
    scores = [(sum(k in low for k in kws), -i, n) for i, (n, kws) in enumerate(table.items())]
    return [n for s, _, n in sorted(scores, reverse=True) if s > 0] or ["Other"]


SAMPLES = ["a fair chair", "long queue", "rude receipt", "", None, "   ", "Clean toilet, polite staff",
           "meter reset scam at night", "no cng, cng closed, long queue, rude staff", "xyz"]


def test_issue(values):
    got = values(lambda F: issues.classify_issue(F.col("x")), SAMPLES)
    assert got == [brute_issue(t)[0] for t in SAMPLES]
    assert got[0] == "Air, Tyre & Nitrogen" and got[1] == "Waiting Time & Queue"
    assert got[2] == "Staff Behaviour"


@pytest.mark.parametrize("n", [2, 3])
def test_issue_tags(values, n):
    got = values(lambda F: issues.classify_issues(F.col("x"), n), SAMPLES)
    assert got == [brute_issue(t)[:n] for t in SAMPLES]


def test_aspects(values):
    got = values(lambda F: issues.aspect_sentiment(F.col("x")), ["unavailable", "rude staff", "q", None])
    assert got[0] == {"CNG Availability": "Neutral"}
    assert got[1] == {"Staff & Service": "Negative"} and got[2] == {} and got[3] == {}


def test_quality(values):
    got = values(lambda F: issues.quality_score(F.col("x")), [
        "ok ok", "", None, "good good good", "meter receipt upi gpay " + "w " * 30, "Good good bad"])
    assert got == [5, 0, 0, 16, 40 + int(5 / 34 * 30) + 30, 6 + 30]


def test_relative_month(values):
    got = values(lambda F: rules.relative_month(F.col("x")), [
        "Edited a year ago", "3 weeks ago", "a week ago", "2 days ago", "", None, "a month ago",
        "11 months ago", "2 years ago", "Edited 14 months ago"])
    d = dt.date
    assert got == [d(2025, 6, 1), d(2026, 6, 1), d(2026, 6, 1), None, None, None, d(2026, 5, 1),
                   d(2025, 7, 1), d(2024, 6, 1), d(2025, 4, 1)]


def test_star_label(values):
    got = values(lambda F: rules.star_from_label(F.col("x")),
                 ["4.5 stars", "Rated 3", None, "none", "2 of 5 Stars", ""])
    assert got == [4.5, 3.0, None, None, 5.0, None]


def test_numbers(values):
    assert values(lambda F: rules.to_number(F.col("x")), ["4.5", "n/a", "NaN", None, " 7 "]) == [
        4.5, None, None, None, 7.0]
    assert values(lambda F: rules.floor_count(F.col("x")), [None, "0", "7", "NaN"]) == [1, 1, 7, 1]


def test_keys(values):
    got = values(lambda F: rules.station_key(F.col("t"), F.col("n")),
                 [("HP Fuel, Stn.", 7), ("x" * 60, 1234)], "t string, n int")
    assert got == ["007_hp_fuel__stn_", "1234_" + "x" * 40]


def test_record_id(values):
    import hashlib
    got = values(lambda F: rules.record_id(F.col("n"), F.col("a"), F.col("b"), F.col("u"), F.col("t")),
                 [("S", 19.0, 72.5, "me", "hi"), ("S", None, 72.5, None, "hi")],
                 "n string, a double, b double, u string, t string")
    assert got[0] == hashlib.md5(b"S|19.0|72.5|me|hi").hexdigest()
    assert got[1] != got[0]


def test_record_id_reads_plain_numbers_once(values):
    """Searches for an exponent run only where a number's text has one."""
    import hashlib
    import math

    from pyspark.sql import functions as F
    rid = rules.record_id(F.col("n"), F.col("a"), F.col("b"), F.col("u"), F.col("t"))
    assert str(rid).count("CASE WHEN contains(") == 2
    numbers = [1e-05, -2.5e-07, 0.0005, 1e16, 123456789.25, -1e300, math.inf, math.nan, None]
    got = values(lambda F: rid, [("S", x, 72.5, "me", "hi") for x in numbers],
                 "n string, a double, b double, u string, t string")
    shown = ["1e-05", "-2.5e-07", "0.0005", "1e+16", "123456789.25", "-1e+300", "Infinity", "NaN", "None"]
    assert got == [hashlib.md5(f"S|{x}|72.5|me|hi".encode()).hexdigest() for x in shown]


def test_address(values):
    assert values(lambda F: rules.clean_address(F.col("x")), ["   A road\nB  ", None]) == [
        "A road B", None]


def test_severity_and_bands(values):
    assert values(lambda F: rules.severity(F.col("x"), lx.SEVERITY_NETWORK), [45.0, 45.1, 30.0, 30.1],
                  "double") == ["moderate", "high", "low", "moderate"]
    assert values(lambda F: rules.city_band(F.col("x")), [2.9, 3.0, 3.6], "double") == [
        "below", "at", "above"]


def test_topic_label(values):
    got = values(lambda F: rules.topic_label(F.col("x")), [
        (["cng", "pressure", "rude"],), (["rude", "bill"],), (["zzz"],), ([],)], "x array<string>")
    assert got == ["CNG Availability", "Staff Conduct", "General Experience", "General Experience"]


def test_cleaning(values):
    texts = ["See http://x.y/z now! ★ Ça va?", None, " hi_you ", "नमस्ते दुनिया"]
    assert values(lambda F: tx.model_text(F.col("x")), texts[:3]) == ["See  now!   Ça va?", "", "hi_you"]
    assert values(lambda F: tx.mining_text(F.col("x")), ["don't-stop_it"]) == ["don t stop_it"]
    assert values(lambda F: tx.mining_text(F.col("x")), texts[:3]) == ["see  now    ça va", "", "hi_you"]
    assert values(lambda F: F.length(tx.model_text(F.col("x"))), ["a" * 900]) == [900]
    assert values(lambda F: F.length(tx.model_text(F.col("x"), 512)), ["a" * 900]) == [512]


def test_tokens(values):
    got = values(lambda F: tx.tokenize(F.col("x")), [
        "The rude-attendant's meter reads 24/7 http://a.b", "été CAFÉ naïve co_op", "", None,
        "a\x1cbcd\u3000efg xyz"])
    assert got == [["rude", "attendant", "meter", "reads"], ["été", "café", "naïve", "co_op"], [], [],
                   ["bcd", "efg", "xyz"]]


def test_keyword_tokens(values):
    import re
    texts = ["Café abcd abcdé x-ray the_end HELLO", "a1b abc"]
    got = values(lambda F: tx.keyword_tokens(F.col("x")), texts)
    assert got == [re.findall(r"\b[a-z]{3,}\b", t.lower()) for t in texts]


def test_ngrams_and_fill(values):
    arrays = [(["a", "b", "c"],), (["a"],), ([],)]
    assert values(lambda F: tx.ngrams(F.col("x"), 2), arrays, "x array<string>") == [
        ["a b", "b c"], [], []]
    assert values(lambda F: tx.fill_empty(F.col("x"), "general service"), arrays, "x array<string>")[2] == [
        "general", "service"]


KEYWORDS = ["pump", "pum", "ump", "staff", "rude staff", "é", "pump", "a", " ", "漢字", "x.y", "(", ""]


@pytest.mark.parametrize("library", [True, False])
@pytest.mark.parametrize("keywords", [KEYWORDS, ["only"], [""], []])
def test_found_keywords_are_those_that_the_text_contains(values, monkeypatch, keywords, library):
    if not library:
        monkeypatch.setattr(found.importlib.util, "find_spec", lambda name: None)
    texts = ["pumps and rude staff", "", None, "PUMP", "uump", "caf\u00e9 漢字(x.y", "a" * 10_000 + "pu", "xzy"]
    got = values(lambda F: found.found_keywords(F.col("x"), keywords), texts)
    assert got == [[i for i, k in enumerate(keywords) if k in (t or "")] for t in texts]


def test_override_patterns_that_start_with_a_choice(values):
    patterns = [r"\bx?cheat\b", r"\bscam|fraud\b", r"over\s+charge", r"\bNO\s+CNG\b"]
    texts = ["cheat", "xcheat!", "a fraud", "scams", "moreover charge", "no  Cng.", "uno cng", "cheater"]
    got = values(lambda F: st.hard_negative(F.col("x"), patterns), texts)
    assert got == [True, True, True, True, True, True, False, False]


def test_keywords_of_more_rows_than_a_piece(values, monkeypatch):
    from forecourt.functions import keywords as found
    monkeypatch.setattr(found, "PIECE_ROWS", 2)
    texts = ["queue", "", None, "pump queue", "none", "pump", "queue"]
    assert values(lambda F: found.found_keywords(F.col("x"), ["pump", "queue"]), texts) == [
        [1], [], [], [0, 1], [], [0], [1]]
