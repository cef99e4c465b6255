"""Each operator against brute force, an exact round trip or planted cases, on small data."""

import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from forecourt.llm import (
    bpe,
    components,
    language,
    lmscore,
    mixing,
    quality,
    simhash,
    sketches,
    token_counts,
    topk,
    toxicity,
)
from forecourt.llm.pretokens import vocabulary
from forecourt.llm.queries import byte_bpe

tokenizers = pytest.importorskip("tokenizers")

DOCS = "doc_id long, text string, lang string, source string"
# A null text, an empty one, white space only, a tie (equal rows), special strings, a long text.
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"),
    (4, "It's  the end<|endoftext|>of 12 lines\n\n  x", "en", None),
    (5, "naïve façade — “quotes” \U0001f600", "fr", "b"),
    (5, "naïve façade — “quotes” \U0001f600", "fr", "b"),
    (6, "word " * 3000, "en", "b"), (7, "x" * 700, None, "c"), (None, "no id here", "en", "c"),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(byte_bpe())


def by_text(rows, *names):
    return {r["text"]: tuple(r[n] for n in names) for r in rows}


# --- 2 and 4: BPE -----------------------------------------------------------------

def test_round_trip_equals_the_library(odd, library):
    got = by_text(bpe.round_trip(odd, byte_bpe()).collect(), "n_tokens", "ids_sha256", "decoded_sha256")
    assert len(got) == len({t for _, t, _, _ in ODD})
    for text, row in got.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert row == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                       hashlib.sha256(back.encode()).hexdigest())


def test_encode_then_decode_gives_the_text(odd):
    rows = bpe.decode(bpe.encode(odd, byte_bpe()), byte_bpe()).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in rows) and len(rows) == len(ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=8))
def test_any_text_has_the_library_s_ids_and_count(library, texts):
    vocab = vocabulary(byte_bpe())
    ids, counts = bpe.Encoder(vocab).encode(texts)
    own = [x.tolist() for x in np.split(ids, counts.cumsum()[:-1])]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert own == expected
    assert token_counts.Counter(vocab).count(texts).tolist() == [len(x) for x in expected]


@pytest.mark.parametrize("word", ["a" * 500, "ab" * 300, "=" * 2000, "é" * 200, "xyzzy" * 90])
def test_long_words(library, word):
    vocab = vocabulary(byte_bpe())
    expected = library.encode(word, add_special_tokens=False).ids
    assert bpe.Encoder(vocab).encode([word])[0].tolist() == expected
    assert token_counts.Counter(vocab).count([word]).tolist() == [len(expected)]


def test_forgetting_words_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "KNOWN_CHUNKS", 2)
    tool = bpe.Encoder(vocabulary(byte_bpe()))
    for text in ["one two three", "two three four", "one two three"]:
        assert tool.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_counts(odd, library):
    rows = token_counts.token_counts(odd, byte_bpe(), limit=50).collect()
    for r in rows:
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), n, n > 50)


def test_taken_names_and_empty_tables(odd, empty):
    clash = odd.withColumn("n_tokens", F.lit("mine")).withColumn("N_BYTES", F.lit(1))
    out = token_counts.token_counts(clash, byte_bpe())
    assert {"n_tokens", "N_BYTES", "n_tokens_", "n_bytes_"} <= set(out.columns)
    assert {r["n_tokens"] for r in out.collect()} == {"mine"}
    assert bpe.round_trip(empty, byte_bpe()).count() == 0
    assert token_counts.token_counts(empty, byte_bpe()).count() == 0


# --- 8: SimHash -------------------------------------------------------------------

def brute_simhash(text):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(prints):
    """{id: smallest id} over (id, fingerprint)."""
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for (a, x), (b, y) in combinations(prints, 2):
        if (x ^ y).bit_count() <= 2:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i, _ in prints}


def test_fingerprints(odd):
    for r in simhash.near_duplicates(odd, keep=["doc_id", "text"]).collect():
        assert r["fingerprint"] == f"{brute_simhash(r['text']):016x}"


def test_components_of_fingerprints(spark):
    rng = np.random.default_rng(3)
    prints = []
    for c in range(25):  # chains in which the ends differ in many bits, and loners
        x = int(rng.integers(0, 1 << 63)) * 2
        for _ in range(int(rng.integers(1, 12))):
            prints.append(x)
            for b in rng.choice(64, int(rng.integers(0, 4)), replace=False):
                x ^= 1 << int(b)
    prints += [0, 0, 1, 3, 15, (1 << 64) - 1]
    rng.shuffle(prints)
    rows = list(enumerate(map(int, prints), 10))
    distinct = sorted(set(prints))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in distinct], "p long")
    tree = {r["node"] % (1 << 64): r["root"] % (1 << 64)
            for r in components.components(simhash.links(df, "p")).collect()}
    expected = brute_components(rows)
    groups = {}
    for i, p in rows:
        groups.setdefault(tree.get(p, p), set()).add(expected[i])
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len(set(expected.values()))


def test_a_posting_joins_what_all_pairs_join():
    rng = np.random.default_rng(0)
    rest = np.unique(rng.integers(0, 1 << 16, 400) & 0x0F3F)
    a, b = simhash.posting_links(rest)
    got = brute_components([(i, int(i)) for i in rest])
    root = {int(i): int(i) for i in rest}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        old, new = root[y], root[x]
        root = {k: new if v == old else v for k, v in root.items()}
    assert len(a) == len(rest) - len(set(got.values()))
    assert len(set(root.values())) == len(set(got.values()))


def test_near_duplicates_and_one_of_each(spark, odd, empty):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(20, base, "en", "a"), (21, base, "en", "a"), (22, base + " tail", "en", "a"),
            (22, base + " tail", "en", "a"), (30, "quite another text", "en", "a")]
    docs = odd.unionByName(spark.createDataFrame(rows, DOCS))
    found = simhash.near_duplicates(docs, keep=["doc_id", "text"]).collect()
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in found if r["doc_id"] is not None}
    expected = brute_components(sorted(prints.items()))
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == expected
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(expected.values()))
    assert ids.count(None) == 1
    assert simhash.one_of_each(empty).count() == 0


# --- 6: sketches ------------------------------------------------------------------

def test_sketches_of_edited_texts(odd, empty):
    rows = sketches.edited_fingerprints(odd).collect()
    ordered = sorted(((d, t or "") for d, t, _, _ in ODD), key=lambda x: (x[0] is None, -(x[0] or 0)))
    texts = [t for _, t in ordered]
    expected = []
    for k, (d, t) in enumerate(ordered):
        h, after = len(t) // 2, texts[(k + 1) % len(texts)]
        expected.append((str(d), len(t), hashlib.sha256((t[:len(t) - h] + after[:h]).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(expected)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(x) == 1 for x in by_id.values())
    assert by_id[1] == by_id[2] == by_id[3] == {""}
    assert sketches.edited_fingerprints(empty).count() == 0


def test_next_row_over_many_ranges(spark):
    ids = sorted({int(i) for i in np.random.default_rng(1).integers(-500, 5000, 700)})
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in sketches.with_next(df, "doc_id", "text", "text").collect()}
    assert got == {i: str(ids[k - 1]) for k, i in enumerate(ids)}


def test_sketches_merge_and_estimate(spark):
    words = [f"w{i}" for i in range(6000)]
    whole, part = " ".join(words), " ".join(words[:600])
    df = spark.createDataFrame([(whole, part, " ".join(words[600:]))], "a string, b string, c string")
    a, b, c = (sketches.sketch(F.col(x)) for x in "abc")
    row = df.select(sketches.containment(b, a).alias("in_a"), sketches.containment(a, b).alias("in_b"),
                    sketches.resemblance(a, b).alias("r"), sketches.merge(F.array(b, c)).alias("m"),
                    a.alias("a")).first()
    assert row["in_a"] == 1.0 and row["in_b"] == pytest.approx(0.1, abs=0.03)
    assert row["r"] == pytest.approx(0.1, abs=0.03)
    assert len(set(row["a"]) ^ set(row["m"])) <= 4  # only shingles over the seam differ


# --- 3: mixing --------------------------------------------------------------------

def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


@pytest.fixture
def sources(spark, odd):
    rng = np.random.default_rng(5)
    rows = [(100 + i, "w " * int(rng.integers(0, 60)), "en", ["hot", "hot", "b", "é", "z"][int(rng.integers(5))])
            for i in range(800)]
    return odd.unionByName(spark.createDataFrame(rows, DOCS))


def test_mix_meets_its_targets(sources, empty):
    rows = mixing.takings(sources).collect()
    sizes, taken, target = {}, {}, {}
    source = {(r["doc_id"], len((r["text"] or "").split())): r["source"] for r in sources.collect()}
    for r in rows:
        s = source[r["doc_id"], r["size"]]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    expected = brute_targets(sizes)
    assert target == pytest.approx(expected)
    assert all(abs(taken[s] - expected[s]) <= 2 for s in expected)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.takings(sources).collect()))
    assert mixing.takings(empty).count() == 0


def test_mixed_texts_have_the_words_taken(sources):
    plan = mixing.takings(sources).collect()
    mixed = mixing.mix(sources, shard="shard").collect()
    want, got = {}, {}
    for r in plan:
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    for r in mixed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len((r["text"] or "").split())
        assert 0 <= r["shard"] < 16
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in got.items() if v}


def test_splitting_keeps_quotas_and_shard_sizes(spark):
    quotas = {0: 100, 1: 0, 2: 57, 3: 1, 4: 2000}
    df = spark.createDataFrame(list(quotas.items()), "number int, blocks long")
    ends = {r["number"]: r["ends"] for r in mixing.split_quotas(df, 8).collect()}
    assert {k: v[-1] for k, v in ends.items()} == quotas
    per_shard = sum(np.diff([0, *v]) for v in ends.values())
    assert per_shard.max() - per_shard.min() <= 3  # each level halves, to one block
    with pytest.raises(ValueError):
        mixing.split_quotas(df, 6)


def test_draws_are_hypergeometric(spark):
    expr = mixing.draw("30L", "40L", "100L", "(pmod(xxhash64(id), 1048576L) + 0.5D) / 1048576D")
    k = np.array([r[0] for r in spark.range(4000).selectExpr(expr).collect()])
    assert k.mean() == pytest.approx(12, abs=0.2)
    assert k.var() == pytest.approx(30 * .4 * .6 * 70 / 99, rel=0.1)


# --- 7: top-k ---------------------------------------------------------------------

@pytest.mark.parametrize("block", [1, 1024])
def test_exact_top_k(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)]) for i in range(300)]
    rows += [(300 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(200)]  # many ties
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0]), (1000, [float("nan")] * 4),
           (1001, [float("inf")] * 4), (None, [9.0] * 4), (1100, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    whole = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in rows}
    expected = []
    for q in (i for i in whole if i % 100 == 0):
        found = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i)
                       for i, v in whole.items() if i != q)[:10]
        expected += [(q, k, i, -s) for k, (s, i) in enumerate(found, 1)]
    got = topk.top_k(df, block=block).collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_top_k_counts_no_score_above_the_chosen_bin_twice(spark):
    # Bins of 4097, 17 and 1: those of the third round reach from S over S + 100.
    top = 1 << 20
    scored = [top] * 5 + [top - 100] * 1000 + [0]
    rows = [(0, [1 / 1024])] + [(i + i // 99 + 1, [s / 1024]) for i, s in enumerate(scored)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df).orderBy("rank").collect()
    expected = sorted((-s, i + i // 99 + 1) for i, s in enumerate(scored))[:10]
    assert [(-r["score"], r["vec_id"]) for r in got] == expected


def test_top_k_of_huge_components_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    big = spark.createDataFrame([(0, [3e38]), (1, [2e38]), (2, [-3e38]), (3, [1.0])], schema)
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(big).orderBy("rank").collect()]
    assert got[0] == (1, 2**63 - 1) and got[-1] == (2, -2**63) and len(got) == 3
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0


# --- 1: cross-entropy difference ---------------------------------------------------

def brute_losses(texts, scored):
    """Witten-Bell, order 4 over bytes, counted with dictionaries."""
    counts = [{} for _ in range(4)]
    for t in texts:
        raw = b"\0\0\0" + (t or "").encode()
        for i in range(3, len(raw)):
            for m in range(4):
                h, c = raw[i - m:i], raw[i]
                counts[m].setdefault(h, {}).setdefault(c, 0)
                counts[m][h][c] += 1

    def chance(h, c):
        low = 1 / 256 if not h else chance(h[1:], c)
        seen = counts[len(h)].get(h)
        return low if not seen else (seen.get(c, 0) + len(seen) * low) / (sum(seen.values()) + len(seen))
    out = {}
    for t in scored:
        raw = b"\0\0\0" + (t or "").encode()
        bits = [-np.log2(chance(raw[i - 3:i], raw[i])) for i in range(3, len(raw))]
        out[t] = sum(bits) / max(1, len(bits))
    return out


def test_cross_entropy_difference(odd, empty):
    wanted = odd.where("doc_id in (4, 6)")
    losses = lmscore.fit(odd, wanted)
    texts = [t for _, t, _, _ in ODD]
    background = brute_losses(texts, texts)
    target = brute_losses([ODD[3][1], ODD[6][1]], texts)
    for r in lmscore.cross_entropy_difference(odd, losses).collect():
        assert r["n_tokens"] == len((r["text"] or "").encode())
        assert r["ce_background"] == pytest.approx(background[r["text"]], rel=1e-4)
        assert r["ce_target"] == pytest.approx(target[r["text"]], rel=1e-4)
        assert r["ce_difference"] == pytest.approx(r["ce_target"] - r["ce_background"])
    assert lmscore.cross_entropy_difference(empty, lmscore.fit(empty, empty)).count() == 0


def test_no_gram_is_dropped_among_very_many(spark):
    # About 0.9 M different grams: in 2 ** 22 places a tenth of them would lose its place.
    rng = np.random.default_rng(4)
    texts = ["".join(map(chr, rng.integers(32, 127, 1000))) for _ in range(900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    losses = lmscore.fit(docs, docs.where("doc_id < 300"))
    background, target = brute_losses(texts, texts[:20]), brute_losses(texts[:300], texts[:20])
    rows = lmscore.cross_entropy_difference(docs, losses).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(900))
    for r in rows:
        if r["doc_id"] < 20:
            assert r["ce_background"] == pytest.approx(background[r["text"]], rel=1e-6)
            assert r["ce_target"] == pytest.approx(target[r["text"]], rel=1e-6)


# --- 5, 9, 10: classifiers ----------------------------------------------------------

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def told(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def area(rows, score, label):
    good = np.array([r[score] for r in rows if r[label] == 1])
    bad = np.array([r[score] for r in rows if r[label] == 0])
    return (good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2


def test_toxicity_on_held_out_rows(told, odd, empty, spark):
    docs, labels = told
    detector = toxicity.fit(docs, labels)
    rows = (toxicity.toxicity(docs, detector).join(labels, "doc_id")
            .where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").collect())
    assert area(rows, "score", "toxic") > 0.9
    clean = [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in clean) <= 0.05 * len(clean)
    out = toxicity.toxicity(odd.withColumn("score", F.lit(1)), detector).collect()
    assert len(out) == len(ODD) and all(0 <= r["score_"] <= 1 for r in out)
    assert toxicity.toxicity(empty, detector).count() == 0
    none = toxicity.fit(docs, spark.createDataFrame([], LABELS))
    assert {r["score"] for r in toxicity.toxicity(odd, none).collect()} == {0.0}


def test_held_out_labels_change_nothing(told):
    docs, labels = told
    other = labels.withColumn("toxic", F.when(F.expr(
        "crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, other)
    assert a.weights == b.weights and a.constant == b.constant


def test_language_on_held_out_rows(told, odd, empty):
    docs, _ = told
    part = F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, false)")
    model = language.fit(docs.where(~part))
    assert max(model.language.count(x) for x in set(model.language)) > 1
    rows = language.languages(docs.where(part), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert not any(r["rejected"] for r in rows)
    got = by_text(language.languages(odd, model).collect(), "lang_pred", "score", "rejected")
    for text in (None, "", " \t\n "):
        assert got[text] == ("und", 0.0, True)
    digits = odd.withColumn("text", F.lit("12 34 ..."))
    assert {r["lang_pred"] for r in language.languages(digits, model).collect()} == {"und"}
    assert language.languages(empty, model).count() == 0
    nothing = language.languages(odd, language.fit(empty)).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_quality_on_held_out_rows(told, odd, empty, spark):
    docs, labels = told
    evidence = quality.fit(docs, labels)
    sites = dict(host=F.col("source"), path=F.col("lang"))
    rows = (quality.quality(docs, labels, evidence, **sites).join(labels, "doc_id")
            .where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").collect())
    assert area(rows, "score", "quality") > 0.95
    out = quality.quality(odd, spark.createDataFrame([], LABELS), evidence, **sites).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert quality.quality(empty, labels, evidence, **sites).count() == 0


def test_sparse_sites_shrink_to_what_is_above_them(spark):
    rows, labels, i = [], [], 0
    for host, n, good in (("big", 300, 270), ("bad", 300, 60), ("tiny", 3, 0)):
        for k in range(n):
            while zlib.crc32(str(i).encode()) % 3 == 1:
                i += 1
            rows.append((i, "same text", "en", host))
            labels.append((i, int(k < good), 0))
            i += 1
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    none = quality.Evidence(np.zeros(quality.WIDTH), 0.0, 0.0)
    out = quality.quality(docs, known, none, F.col("source"), F.col("lang")).join(
        docs.select("doc_id", "source"), "doc_id").select("source", "host_prior").distinct().collect()
    prior = {r["source"]: r["host_prior"] for r in out}
    assert prior["bad"] == pytest.approx(0.2, abs=0.02) and prior["big"] == pytest.approx(0.9, abs=0.02)
    assert prior["tiny"] > 0.1  # three bad documents do not make it zero


def test_every_label_counts_in_its_site_however_many_there_are(spark):
    part = F.expr("crc32(cast(cast(id as string) as binary)) % 3 <> 1")
    ids = spark.range(330_000).where(part)  # about 220,000, a site each
    docs = ids.select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"),
                      F.col("id").cast("string").alias("source"))
    known = ids.select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    assert known.count() > 200_000
    none = quality.Evidence(np.zeros(quality.WIDTH), 0.0, 0.0)
    out = quality.quality(docs, known, none, F.col("source"), F.col("lang"))
    priors = out.groupBy((F.col("doc_id") % 2).alias("good"), "host_prior").count().collect()
    assert sorted(r["good"] for r in priors) == [0, 1]  # no site without its label
