"""Term counting, key phrases and topics against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from forecourt.operators import scoring, textmining as tm, topics

WORDS = ["queue", "pump", "meter", "staff", "rude", "upi", "card", "clean", "the", "good", "toilet"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 12))) for _ in range(200)]
    out += ["queue queue staff rude"] * 100  # a third of the rows are copies
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["Positive", "Negative"][i % 2], "z" + str(i % 3)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id int, text string, sentiment string, zone string").repartition(8).cache()


def brute_grams(texts, n, stop=("the", "good", "pump")):
    tf, df = Counter(), Counter()
    for t in texts:
        ts = [w for w in t.split() if w not in stop]
        grams = [" ".join(ts[i:i + n]) for i in range(len(ts) - n + 1)]
        tf.update(grams)
        df.update(set(grams))
    kept = [(g, c) for g, c in tf.items() if df[g] >= 2]
    return sorted(kept, key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ngrams(docs, texts, n):
    got = [tuple(r) for r in tm.top_ngrams(docs, n=n, top_k=15).collect()]
    assert got == brute_grams(texts, n)[:15]


def test_no_vocabulary(spark):
    df = spark.createDataFrame([("unique words only",), ("",)], "text string")
    df = df.withColumn("id", F.monotonically_increasing_id())
    assert tm.top_ngrams(df, n=2).collect() == [] and tm.keyphrases(df, "id").collect() == []


def test_keyphrases(docs, texts):
    stop = {"the", "good", "pump"}
    per = []
    for t in texts:
        ts = [w for w in t.split() if len(w) > 2 and w not in stop]
        per.append(Counter(ts + [" ".join(p) for p in zip(ts, ts[1:])]))
    tf, df = Counter(), Counter()
    for c in per:
        tf.update(c)
        df.update(c.keys())
    vocab = sorted((t for t in tf if df[t] >= 2), key=lambda t: (-tf[t], t))[:300]
    n = len(texts)
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocab}
    score = Counter()
    for c in per:
        w = {t: c[t] * idf[t] for t in c if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for t, x in w.items():
            score[t] += x / norm / n
    expected = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:20]
    got = [tuple(r) for r in tm.keyphrases(docs, "id", top_k=20).collect()]
    assert [g[1] for g in got] == pytest.approx([e[1] for e in expected])
    assert {g[0] for g in got[:10]} == {e[0] for e in expected[:10]}


def test_zone_summary(docs):
    rows = {r["zone"]: r for r in tm.zone_text_summary(docs).collect()}
    assert len(rows) == 3 and all(len(r["top_pain_points"].split(", ")) == 3 for r in rows.values())
    none = tm.zone_text_summary(docs.where("sentiment = 'Positive'")).collect()
    assert {r["top_pain_points"] for r in none} == {"—"}


def dense_digamma(x):
    """By the recurrence far out, where the series needs one term."""
    below = sum(1 / (x + i) for i in range(2000))
    return np.log(x + 2000) - 0.5 / (x + 2000) - 1 / (12 * (x + 2000) ** 2) - below


dense_log_gamma = np.vectorize(math.lgamma)


def dense_fit(counts, terms, n_topics, passes, turns):
    """The same ascent with every share written out: (topics, gamma, bounds)."""
    prior = 1 / n_topics
    of_terms = topics.start(terms, counts.sum(axis=0), n_topics)
    gamma = prior + np.repeat(counts.sum(axis=1)[:, None] / n_topics, n_topics, axis=1)
    bounds = []

    def logs(x):
        return dense_digamma(x) - dense_digamma(x.sum(axis=1, keepdims=True))

    def dirichlet(x, e):
        k = x.shape[1]
        prior_part = len(x) * (math.lgamma(k * prior) - k * math.lgamma(prior)) + ((prior - 1) * e).sum()
        own = dense_log_gamma(x.sum(axis=1)).sum() - dense_log_gamma(x).sum() + ((x - 1) * e).sum()
        return prior_part - own
    for _ in range(passes):
        beta = logs(of_terms)
        for turn in range(turns):
            theta = logs(gamma)
            joint = np.exp(theta[:, None, :] + beta.T[None, :, :])  # document, term, topic
            share = joint / joint.sum(axis=2, keepdims=True)
            if turn == 0:
                inside = counts[:, :, None] * share * (theta[:, None, :] + beta.T[None, :, :] - np.log(share))
                bounds.append(inside.sum() + dirichlet(gamma, theta) + dirichlet(of_terms, beta))
            gamma = prior + (counts[:, :, None] * share).sum(axis=1)
        of_terms = prior + (counts[:, :, None] * share).sum(axis=0).T
    return of_terms, gamma, bounds


TOPIC_WORDS = [["rude", "staff", "attendant", "polite", "attitude"], ["upi", "card", "gpay", "cash", "terminal"],
               ["tyre", "nozzle", "puncture"]]


def topic_docs(spark, n=60):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(TOPIC_WORDS[i % 3]) if rng.random() < 0.8 else rng.choice(TOPIC_WORDS[(i + 1) % 3])
                         for _ in range(rng.randint(0, 25)))) for i in range(n)]
    rows += [(None, "staff card tyre"), (7, "staff card tyre"), (7, None), (99, "zebra")]
    return spark.createDataFrame(rows, "id int, text string")


@pytest.mark.parametrize("passes, turns, n_topics", [(1, 1, 2), (1, 3, 3), (4, 2, 3), (9, 3, 2)])
def test_topic_passes_equal_a_dense_fit(spark, passes, turns, n_topics):
    df = topic_docs(spark).repartition(5)
    fitted = topics.fit_topics(df, "id", n_topics=n_topics, max_features=30, passes=passes, turns=turns)
    rows = topics.term_counts(df, "id", 30)[0].collect()
    counts = np.zeros((len(rows), len(fitted.terms)))
    for d, r in enumerate(rows):
        counts[d, r["terms"]] = r["counts"]
    want, gamma, bounds = dense_fit(counts, fitted.terms, n_topics, passes, turns)
    assert fitted.topics == pytest.approx(want, rel=1e-9)
    assert fitted.bounds == pytest.approx(bounds, rel=1e-9)
    got = sorted([str(r["id"]), *np.round(r["gamma"], 7)] for r in fitted.documents.collect())
    assert got == sorted([str(r["id"]), *np.round(g, 7)] for r, g in zip(rows, gamma, strict=True))


def test_no_pass_lowers_the_bound_and_weights_are_complete(spark):
    fitted = topics.fit_topics(topic_docs(spark), "id", n_topics=3, max_features=30, passes=25)
    assert all(b >= a - 1e-9 for a, b in zip(fitted.bounds, fitted.bounds[1:]))
    assert fitted.bounds[-1] > fitted.bounds[0] + 10
    rows = topics.distributions(fitted).collect()
    assert len(rows) == 64 and all(sum(r["weights"]) == pytest.approx(1) for r in rows)
    # A text without a term of the vocabulary leans to no topic and goes to the first.
    lone = [r["weights"] for r in rows if r["id"] == 99][0]
    assert lone == pytest.approx([1 / 3] * 3)
    words = topics.topic_words(fitted, 3)
    assert {r["id"]: r["topic"] for r in topics.dominant_topics(topics.distributions(fitted), "id", words).collect()}[99] == 0


def test_passes_copy_documents_many_in_a_row(spark, monkeypatch):
    staged, stage = [], topics.stage
    monkeypatch.setattr(topics, "stage", lambda df, name: staged.append((name, stage(df, name))) or staged[-1][1])
    fitted = topics.fit_topics(topic_docs(spark).coalesce(1), "id", n_topics=2, max_features=30, passes=1)
    assert [df.where("given is null").count() for name, df in staged if name == "topic-pass"] == [1]
    assert fitted.documents.count() == 64


def test_packed_rows_end_where_they_are_full(monkeypatch):
    import pyarrow as pa
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("keys", T.ArrayType(T.StringType())), *(T.StructField(c, T.BinaryType()) for c in (
        "found", "sizes", "gamma")), T.StructField("given", T.ArrayType(T.DoubleType()))])
    ints = pa.list_(pa.int32())
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["x", "a", None, "c", "d"]), pa.array([[9], [0, 1, 2], [], [1], [2]], ints),
         pa.array([[9], [5, 1, 1], [], [2], [3]], ints)], ["k", "terms", "counts"])
    monkeypatch.setattr(topics, "ROW_TERMS", 4)
    made = next(topics._packed(0.5, 2, schema)(iter([batch.slice(0, 0), batch.slice(1)])))
    assert made.column(0).to_pylist() == [["a"], [None, "c"], ["d"]]
    found, numbers = topics._unpack(made.column(1), np.int32)
    assert (found.tolist(), numbers.tolist()) == ([0, 5, 1, 1, 2, 1, 1, 2, 2, 3], [6, 2, 2])
    assert [x.tolist() for x in topics._unpack(made.column(2), np.int32)] == [[3, 0, 1, 1], [1, 2, 1]]
    assert topics._unpack(made.column(3).slice(1), np.float64)[0].tolist() == [0.5, 0.5, 1.5, 1.5, 2.0, 2.0]


def test_topic_names_by_words(spark):
    words = spark.createDataFrame([(0, ["alpha", "beta", "gamma"]), (1, ["staff", "rude"])], "topic int, words array<string>")
    assert [r["label"] for r in topics.labelled_topics(words).orderBy("topic").collect()] == [
        "General Experience", "Staff Conduct"]
    assert [r["label"] for r in topics.labelled_topics(words, by_words=True).orderBy("topic").collect()] == [
        "alpha / beta / gamma", "Staff Conduct"]


def test_digamma_and_log_gamma():
    x = np.array([1e-3, 0.125, 0.5, 1.0, 3.7, 50.0, 1e6])
    assert topics.digamma(x) == pytest.approx(dense_digamma(x), rel=1e-9, abs=1e-9)
    assert topics.log_gamma(x) == pytest.approx(dense_log_gamma(x), rel=1e-9, abs=1e-9)


def test_topics_separate_disjoint_vocabularies(spark):
    rng = random.Random(1)
    groups = [["rude", "staff", "attendant", "polite", "attitude"],
              ["upi", "card", "gpay", "cash", "terminal"]]
    rows = [(i, " ".join(rng.choice(groups[i % 2]) for _ in range(20))) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, text string")
    def dominant(fitted):
        return topics.dominant_topics(topics.distributions(fitted), "id", topics.topic_words(fitted))
    fitted = topics.fit_topics(df, "id", n_topics=2, max_features=50, passes=30)
    found = {r["id"]: (r["topic"], r["label"]) for r in dominant(fitted).collect()}
    assert len(found) == 120
    majority = Counter((i % 2, found[i][0]) for i in found).most_common(2)
    assert sum(n for _, n in majority) >= 110 and majority[0][0][1] != majority[1][0][1]
    assert {label for _, label in found.values()} == {"Staff Conduct", "Payment & Digital"}
    table = topics.topic_table(topics.topic_words(fitted)).collect()
    assert len(table) == 16 and all(r["term"] == r["term"].title() for r in table)
    again = topics.fit_topics(df, "id", n_topics=2, max_features=50, passes=30)
    assert found == {r["id"]: (r["topic"], r["label"]) for r in dominant(again).collect()}


def test_trained_scorer_learns(spark):
    rows = [("bad rude dirty", 1), ("great clean helpful", 5), ("average plain", 3)] * 20
    df = spark.createDataFrame(rows, "text string, star int")
    model = scoring.ModelScorer.train(df, "text", "star", features=256)
    out = scoring.predict(spark.createDataFrame([("rude and dirty",), ("clean, helpful",)], "text string"),
                          scorer=model)
    assert [r["sentiment"] for r in out.collect()] == ["Negative", "Positive"]
    total = out.select((F.col("prob_positive") + F.col("prob_neutral") + F.col("prob_negative")).alias("t"))
    assert [round(r["t"], 9) for r in total.collect()] == [1.0, 1.0]


def test_scorer_reads_whole_texts(spark):
    df = spark.createDataFrame([("plain " * 400 + "rude worst terrible",)], "text string")
    assert scoring.predict(df).first()["sentiment"] == "Negative"
    assert scoring.predict(df, max_chars=512).first()["sentiment"] == "Neutral"


def test_gradients_of_a_trained_scorer(spark):
    """Against the loss itself, one weight moved at a time; near zero once the fit has converged."""
    rng = random.Random(5)
    words = ["rude", "clean", "slow", "good", "pump", "queue"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(1, 8))), rng.choice([1, 3, 5])) for _ in range(80)]
    df = spark.createDataFrame([*rows, ("no star", None), ("star out of range", 9)], "text string, star int")
    early = scoring.ModelScorer.train(df, "text", "star", features=32, max_iter=2, reg=0.05)
    late = scoring.ModelScorer.train(df, "text", "star", features=32, max_iter=300, reg=0.05, tol=1e-12)
    told = early.model.transform(scoring.ModelScorer.rows(df, "text", "star")).select("_features", "_label").collect()
    x = np.array([r["_features"].toArray() for r in told])
    label = np.array([int(r["_label"]) for r in told])
    assert len(x) == 80
    fitted = early.model.stages[-1]
    weights, intercept = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()

    def loss(w, b):
        z = x @ w.T + b
        z = z - z.max(axis=1, keepdims=True)
        fit = -(z[np.arange(len(x)), label] - np.log(np.exp(z).sum(axis=1))).mean()
        return fit + 0.05 / 2 * (w**2 * x.var(axis=0, ddof=1)).sum()
    got = {(r["feature"], r["star"]): r["gradient"] for r in early.gradient(df, "text", "star").collect()}
    assert {f for f, _ in got} == {-1, *np.flatnonzero(x.any(axis=0)).tolist()} and {k for _, k in got} == {1, 2, 3, 4, 5}
    for (f, star), value in got.items():
        up, down, b_up, b_down = weights.copy(), weights.copy(), intercept.copy(), intercept.copy()
        (b_up if f < 0 else up[:, f])[star - 1] += 1e-5
        (b_down if f < 0 else down[:, f])[star - 1] -= 1e-5
        assert value == pytest.approx((loss(up, b_up) - loss(down, b_down)) / 2e-5, abs=1e-6)
    assert max(map(abs, got.values())) > 1e-3
    assert max(abs(r["gradient"]) for r in late.gradient(df, "text", "star").collect()) < 1e-5


@pytest.mark.parametrize("bits", [4, 14, 24])
def test_terms_of_two_rows_are_never_left_out(spark, bits):
    """Whatever the size of the slot table; a small one lets more terms of one row through."""
    rng = random.Random(bits)
    rows = [(d, f"t{t}") for d in range(200) for t in set(rng.choices(range(2000), k=12))]
    df = spark.createDataFrame(rows, "doc int, term string")
    times = Counter(t for _, t in rows)
    kept = Counter(r["term"] for r in tm.maybe_repeated(df, bits).collect())
    assert {t: n for t, n in times.items() if n > 1} == {t: n for t, n in kept.items() if n > 1}
    once = sum(n == 1 for n in times.values())
    left = sum(n == 1 for n in kept.values())
    assert left == once if bits == 4 else left < once / 2 if bits == 14 else left == 0


def test_phrase_counts(values):
    got = values(lambda F: tm.phrase_counts(F.split("x", " "), ["b", "a b"]), ["a b a b", "c", "", None])
    assert [sorted((r["term"], r["n"]) for r in rows) for rows in got] == [
        [("a", 2), ("b a", 1)], [("c", 1)], [("", 1)], []]


def test_phrase_counts_count_no_text_by_itself(values, monkeypatch):
    monkeypatch.setattr(tm, "Counter", None)
    rng = random.Random(4)
    made = [" ".join(rng.choices(["a", "b", "c", "dd", "é"], k=rng.randint(1, 12))) for _ in range(200)]
    got = values(lambda F: tm.phrase_counts(F.split("x", " "), ["b", "a b", "c a"]), [*made, None])
    for text, rows in zip(made, got):
        ts = text.split()
        want = Counter(ts + [" ".join(p) for p in zip(ts, ts[1:])])
        assert sorted((r["term"], r["n"]) for r in rows) == sorted((t, n) for t, n in want.items() if t not in ("b", "a b", "c a"))
    assert got[-1] == []


@pytest.mark.parametrize("size", [5, 40, 400, 100_000])
@pytest.mark.parametrize("words", ["skewed", "flat", "few"])
def test_heavy_terms_are_the_top_terms(spark, monkeypatch, size, words):
    """Whatever the summaries can hold: a flat vocabulary, or too small ones, is counted in full."""
    rng = random.Random(size)
    pick = {"skewed": lambda: f"w{int(rng.paretovariate(0.8)) % 3000}x", "flat": lambda: f"w{rng.randrange(600)}x",
            "few": lambda: rng.choice(["one", "two", "three"])}[words]
    rows = [(i, " ".join(pick() for _ in range(40))) for i in range(150)] + [(900, None), (901, ""), (902, "lone lone " * 300)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(4)
    full = []
    plain = tm.top_ngrams
    for n in (1, 2):
        want = [tuple(r) for r in plain(df, n=n, top_k=8, stop_words=[]).collect()]
        monkeypatch.setattr(tm, "top_ngrams", lambda *a: full.append(n) or plain(*a))
        assert [tuple(r) for r in tm.heavy_ngrams(df, n=n, top_k=8, stop_words=[], size=size).collect()] == want
    assert "lone" not in dict(want)
    if words == "skewed" and size >= 400 or size == 100_000:
        assert full == []  # no shuffle of the vocabulary
    if words == "flat" and size == 5:
        assert full == [1, 2]
    empty = tm.heavy_ngrams(df.limit(0), n=2)
    assert empty.collect() == [] and empty.columns == ["term", "n"]


def test_summaries_bound_every_count(spark):
    rng = random.Random(9)
    rows = [(" ".join(f"w{int(rng.paretovariate(0.7)) % 500}x" for _ in range(60)),) for _ in range(100)]
    df = spark.createDataFrame(rows, "text string").coalesce(2)
    found = tm._summaries(df, F.split("text", " "), 1, 20).collect()
    lost = sum(r["lost"] for r in found)
    low = Counter()
    for r in found:
        if r["term"] is not None:
            low[r["term"]] += r["low"]
    true = Counter(t for (text,) in rows for t in text.split())
    assert 0 < lost <= 6000 / 20 and all(low[t] <= n <= low[t] + lost for t, n in true.items()) and set(low) <= set(true)


@pytest.mark.parametrize("features", [1, 7, 40, 500])
@pytest.mark.parametrize("most_words", [0, 20_000])
def test_frequent_phrases_are_the_first_of_all_terms(spark, features, most_words):
    rng = random.Random(features)
    made = [[rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(rng.randrange(6))] for _ in range(80)]
    made += [["x", "y"]] * 30 + [["x"], ["once", "alone"], [], None]
    tf, df = Counter(), Counter()
    for ts in made:
        terms = (ts or []) + [" ".join(p) for p in zip(ts or [], (ts or [])[1:])]
        tf.update(terms)
        df.update(set(terms))
    expected = sorted((t for t in tf if 2 <= df[t] <= 40), key=lambda t: (-tf[t], t))[:features]
    docs = spark.createDataFrame([(i, ts) for i, ts in enumerate(made)], "id int, tokens array<string>").repartition(3)
    got = tm.frequent_phrases(docs, features, 2, 40, most_words=most_words)
    assert got == (expected, [tf[t] for t in expected])


def test_topic_vocabulary_does_not_count_every_bigram(spark, docs, texts, monkeypatch):
    """The rows of a large table are never exploded to all their bigrams."""
    monkeypatch.setattr(tm, "term_stats", None)
    monkeypatch.setattr(topics, "term_stats", None, raising=False)
    rows, names, frequency = topics.term_counts(docs, "id", 4)
    per = []
    for t in texts:
        ts = [w for w in t.split() if w not in ("the", "good", "pump")] or ["general", "service"]
        per.append(Counter(ts + [" ".join(p) for p in zip(ts, ts[1:])]))
    assert frequency.tolist() == [sum(c[t] for c in per) for t in names]
    for r in rows.collect():
        own = [(i, per[r["id"]][t]) for i, t in enumerate(names) if per[r["id"]][t]]
        assert list(zip(r["terms"], r["counts"])) == own


def test_word_pieces(spark, monkeypatch):
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([["a", "b"], None, ["c"], ["d"] * 5])], ["k", "t"])
    got = [(rows.column(0).to_pylist(), row.tolist(), ts.to_pylist()) for rows, row, ts in tm._pieces(batch.slice(0, 4), 3)]
    assert got == [([1, 2, 3], [0, 0, 2], ["a", "b", "c"]), ([4], [0] * 5, ["d"] * 5)]
    got = [rows.column(0).to_pylist() for rows, _, _ in tm._pieces(batch.slice(1, 3), 1)]
    assert got == [[2, 3], [4]]


def test_blocks_of_a_pass_equal_single_terms(monkeypatch):
    rng = np.random.default_rng(1)
    sizes = np.array([3, 0, 1, 5, 0])
    terms = np.concatenate([np.sort(rng.choice(9, n, replace=False)) for n in sizes])
    counts, gamma = rng.integers(1, 5, len(terms)).astype(float), rng.random((5, 2)) + 0.5
    steps = [topics.Step(rng.random((2, 9)) + 1, 0.5, 3)]
    steps.append(topics.Step(np.ones((2, 9)), 0.5, 3))
    steps[1].expected = steps[0].expected
    out = []
    for step, most, block in zip(steps, (0, 1000), (1 << 18, 18)):
        monkeypatch.setattr(topics, "MOST_EMPTY", most)
        monkeypatch.setattr(topics, "BLOCK", block)
        out.append(step.of(terms, counts, sizes, gamma))
    assert np.allclose(*out, rtol=1e-12) and np.allclose(steps[0].given, steps[1].given, rtol=1e-12)
    assert steps[0].bound == pytest.approx(steps[1].bound, rel=1e-12)


def test_mining_tokens_are_the_words_of_the_mining_text(values):
    from forecourt.functions import text as tx
    odd = ["İa İİ ΣΑΣ-ΑΣ. ΑΣ'Σ", "see http://x.y/z?q tail", "a_b ___ ٣٤٥ x yyy\u0085zzz", None, "", "é́é ÀB́CD ﬁﬁﬁ ǅǅǅ"]
    both = values(lambda F: F.struct(tx.tokenize(F.col("x"), ["tail"]).alias("a"),
                                     tx._keep(tx.split_words(tx.mining_text(F.col("x"))), ["tail"], 3).alias("b")), odd)
    assert [r["a"] for r in both] == [r["b"] for r in both] and any(r["a"] for r in both)


@pytest.mark.parametrize("first_words,most_words", [(1, 0), (2, 100), (1000, 20_000)])
@pytest.mark.parametrize("top_k", [1, 5, 1000])
def test_likely_bigrams_hold_the_first_ones(spark, first_words, most_words, top_k):
    rng = random.Random(top_k)
    made = [" ".join(rng.choices("abcdefgh", range(1, 9), k=rng.randrange(8))) for _ in range(60)]
    # The most frequent words are in no bigram.
    made += ["z"] * 500 + ["p q"] * 40 + ["r s r s"]
    docs = spark.createDataFrame([(t.split(),) for t in made], "tokens array<string>").repartition(3)
    found = tm.likely_bigrams(docs, top_k, 2, first_words, most_words)
    got = [(r["term"], r["tf"]) for r in tm.vocabulary(found, top_k, 2).collect()]
    assert got == brute_grams(made, 2, ())[:top_k]


def test_bigrams_of_a_table_are_not_all_counted(docs, texts, monkeypatch):
    monkeypatch.setattr(tm, "term_stats", None)
    assert [tuple(r) for r in tm.top_ngrams(docs, n=2, top_k=15).collect()] == brute_grams(texts, 2)[:15]
