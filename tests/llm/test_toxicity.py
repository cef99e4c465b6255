"""The letter models against a second computation: every gram counts, however many there are and however rare."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from forecourt.llm import toxicity


def grams(word):
    """(context, letter) of each symbol but the start, as tuples of codes."""
    symbols = [toxicity.START, *word.encode(), toxicity.END]
    return [(tuple(symbols[max(0, i - 7):i]), symbols[i]) for i in range(1, len(symbols))]


def key(symbols):
    out = 0
    for s in symbols:
        out = out << 8 | s
    return out


def discount(counts):
    one, two = (sum(n == k for n in counts) for k in (1, 2))
    return min(0.9, max(0.1, one / (one + 2 * two) if one else 0.5))


def brute(toxic, ordinary):
    """({gram: ratio}, {context: ratio of the back-offs}), from counts of words by class."""
    t, o = Counter(), Counter()
    for counts, texts in ((t, toxic), (o, ordinary)):
        for text in texts:
            for word in text.split():
                counts.update(grams(word))
    seen = set(t) | set(o)
    low = Counter((c + (x,))[-3:] for c, x in seen)
    d_low, d = discount(low.values()), [discount(n.values()) for n in (t, o)]
    ends, history = Counter(g[-1] for g in low), defaultdict(list)
    for g, n in low.items():
        history[g[:-1]].append(n)

    def shared(g):
        h = history[g[:-1]]
        last = (max(ends[g[-1]] - 0.5, 0) + 0.5 * len(ends) / 256) / sum(ends.values())
        return max(low[g] - d_low, 0) / sum(h) + d_low * len(h) / sum(h) * last

    of = defaultdict(list)
    for c, x in seen:
        of[c].append(x)
    ratio, back = {}, {}
    for c, letters in of.items():
        total = [sum(n[c, x] for x in letters) for n in (t, o)]
        rest = [d[k] * sum(n[c, x] > 0 for x in letters) / total[k] if total[k] else 1.0 for k, n in enumerate((t, o))]
        back[key(c)] = math.log(rest[0] / rest[1])
        for x in letters:
            p = [(max(n[c, x] - d[k], 0) / total[k] if total[k] else 0) + rest[k] * shared((c + (x,))[-3:])
                 for k, n in enumerate((t, o))]
            ratio[key((*c, x))] = math.log(p[0] / p[1])
    return ratio, back


@pytest.fixture(scope="module")
def made(spark):
    """Texts of random words, most of them unlike any other: 20,000 grams, so that some meet in one of 2^22 places."""
    rng = random.Random(5)
    few = ["".join(rng.choices("abcde", k=rng.randint(1, 9))) for _ in range(50)]

    def text():
        return " ".join([*rng.choices(few, k=10), *("".join(rng.choices("fghijklmnop", k=rng.randint(3, 12))) for _ in range(20))])
    rows = [(i, text(), int(rng.random() < 0.4)) for i in range(210)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return rows, df.select("doc_id", "text"), df.select("doc_id", "toxic")


def counts(df):
    return toxicity.gram_counts(df.select("text", F.lit(0).alias("part"), F.col("toxic").alias("label")), "text")


def test_every_gram_has_its_ratio(made):
    rows, docs, labels = made
    ratio, back = brute([x for _, x, k in rows if k], [x for _, x, k in rows if not k])
    assert len(ratio) > 15_000
    model = toxicity.Model(counts(docs.join(labels, "doc_id")), "t0 + t2", "o0 + o2")
    for table, want in ((model.ratio, ratio), (model.back, back)):
        got = table(np.array([*want], np.uint64))
        assert not np.isnan(got).any()
        assert got == pytest.approx(np.array([*want.values()]), rel=1e-4, abs=1e-5)
        assert np.isnan(table(np.array([0, 3, 2 ** 63 + 5], np.uint64))).all()
    model.destroy()


def test_shards_and_partial_sums_change_nothing(made, monkeypatch):
    _, docs, labels = made

    def scores():
        detector = toxicity.fit(docs, labels)
        return detector, {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, detector).collect()}
    one, want = scores()
    assert len(one.model.ratio.shards) == 1 and one.model.piece() == (toxicity.PIECE_BYTES, toxicity.PIECE_ROWS)
    monkeypatch.setattr(toxicity, "SHARD_KEYS", 900)
    many, got = scores()
    assert len(many.model.ratio.shards) > toxicity.RESIDENT and many.model.piece() > one.model.piece()
    assert sum(len(x.value[0]) for x in many.model.ratio.shards) == len(one.model.ratio.shards[0].value[0])
    assert got == pytest.approx(want, rel=1e-6, abs=1e-9)
    whole = {r["gram"]: tuple(r) for r in counts(docs.join(labels, "doc_id")).collect()}
    monkeypatch.setattr(toxicity, "TASK_GRAMS", 50)
    assert {r["gram"]: tuple(r) for r in counts(docs.join(labels, "doc_id")).collect()} == whole


def test_the_pipeline_rejects_by_words_seen_once(spark, tmp_path):
    """Each toxic text has a word of its own and shares no other; its copy without a label has nothing else to go by."""
    rng = random.Random(8)
    plain = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(30)]
    rows, told = [], []
    for i in range(240):
        toxic = i % 2
        words = ["".join(rng.choices("stuvwxyz", k=7)) for _ in range(4)] if toxic else rng.choices(plain, k=8)
        rows += [(i, " ".join(words)), (1000 + i, " ".join(words))]
        told.append((i, 1, toxic))
    spark.createDataFrame(told, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).model
    text = next(x for i, x in rows if i % 2 and i < 240 and not bool(docs.select(
        F.crc32(F.lit(str(i)).cast("binary")) % 3 == 1).first()[0]))
    own = np.array([key((*c, x)) for c, x in grams(text.split()[0])], np.uint64)
    assert not np.isnan(model.ratio(own)).any()
    kept = {r["doc_id"] for r in corpus_pipeline.ordinary(spark, docs, str(tmp_path)).collect()}
    assert kept == {i for i, _ in rows if i % 2 == 0}
