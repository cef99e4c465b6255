"""Key phrases against a second computation, and how much of them leaves a task."""

import math
import random
from collections import Counter

import pytest

from forecourt.catalog.tables import text_fact, text_rows
from forecourt.operators import textmining as tm

STOP = ["the", "and", "general", "red fox"]


def made(kind):
    rng = random.Random(len(kind))
    pick = {"skewed": lambda: f"w{int(rng.paretovariate(0.7)) % 400}x", "flat": lambda: f"w{rng.randrange(250)}x",
            "few": lambda: rng.choice(["red", "fox", "the", "hen"])}[kind]
    texts = [" ".join(pick() for _ in range(rng.randint(1, 30))) for _ in range(120)]
    return [*texts, *texts[:7], None, "", "a 1", "once only words", "again again " * 40, "the red fox", "Äpfel äpfel ÄPFEL"]


def brute(texts, top_k, min_df, max_features=None):
    per = []
    for text in texts:
        ts = [w for w in (text or "").lower().split() if len(w) > 2 and w not in STOP] or ["general"]
        per.append(Counter(x for x in ts + [" ".join(p) for p in zip(ts, ts[1:])] if x not in STOP))
    tf, df = Counter(), Counter()
    for c in per:
        tf.update(c)
        df.update(c.keys())
    vocab = sorted((t for t in tf if df[t] >= min_df), key=lambda t: (-tf[t], t))[:max_features]
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in vocab}
    score = Counter()
    for c in per:
        w = {t: c[t] * idf[t] for t in c if t in idf}
        for t, x in w.items():
            score[t] += x / math.sqrt(sum(y * y for y in w.values())) / len(texts)
    return sorted(((t, x) for t, x in score.items()), key=lambda x: (-round(x[1], 12), x[0]))[:top_k]


def same(got, want):
    assert [r["score"] for r in got] == pytest.approx([x for _, x in want], rel=1e-9)
    assert {r["term"] for r in got[:-3]} <= {t for t, _ in want} or len(want) < 4
    return True


@pytest.mark.parametrize("kind", ["skewed", "flat", "few"])
@pytest.mark.parametrize("first", [3, 60, 20_000])
def test_scores_of_whole_vectors(spark, monkeypatch, kind, first):
    """Whatever terms are added up first, and however the texts lie in blocks."""
    monkeypatch.setattr(tm, "FIRST_TERMS", first)
    texts = made(kind)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    for top_k, min_df, tasks in ((20, 2, 5), (4, 1, 1)):
        got = tm.keyphrases(df.repartition(tasks), "id", top_k=top_k, min_df=min_df, stop_words=STOP).collect()
        assert same(got, brute(texts, top_k, min_df))


def test_stated_vocabulary(spark):
    texts = made("skewed")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    for most in (1, 30):
        got = tm.keyphrases(df, "id", top_k=20, stop_words=STOP, max_features=most).collect()
        want = brute(texts, 20, 2, most)
        assert len(got) == len(want) == min(20, most) and same(got, want)


def test_a_block_sends_a_term_once(spark, monkeypatch):
    """300 equal documents in a block send what one does, in few bytes; each document's term was a row that was shuffled twice."""
    staged = {}
    monkeypatch.setattr(tm, "stage", lambda df, name, stage=tm.stage: staged.setdefault(name, stage(df, name)))
    text = " ".join(f"word{i}x" for i in range(80))
    df = spark.createDataFrame([(i, text) for i in range(300)], "id long, text string").coalesce(1)
    assert len(tm.keyphrases(df, "id", stop_words=STOP).collect()) == 20
    met = staged["term-counts"]
    blocks = met.where("slot < 0")
    assert blocks.selectExpr("sum(n)").first()[0] == 300
    sent = met.where("slot >= 0 and block is not null").selectExpr("sum(n)").first()[0]
    assert sent == blocks.count() * (80 + 79)
    assert met.selectExpr("sum(length(data))").first()[0] < 300 * 159


def test_texts_come_as_often_as_with_their_labels(spark, tmp_path):
    """Ids with several labels, with none, without a document, and null ones; no text is shuffled where none has several."""
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in [*range(40), 3, 3, None]],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, ids in (("one", [1, 2, 3, 90, None, None]), ("many", [1, 1, 2, 3, 3, 3, 39, 39, 90, 90, None, None])):
        d = tmp_path / name
        d.mkdir()
        (d / "documents.parquet").symlink_to(tmp_path / "documents.parquet")
        spark.createDataFrame([(i, k % 2, k % 3 // 2) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int").write.parquet(
            str(d / "labels.parquet"))
        rows = text_rows(spark, str(d))
        want = text_fact(spark, str(d)).select("doc_id", "text")
        assert Counter(map(tuple, rows.collect())) == Counter(map(tuple, want.collect()))
        if name == "one":
            assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()
