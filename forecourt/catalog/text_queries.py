"""Text mining (T) and the zone text summary (A10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt import lexicon as lx
from forecourt.catalog import query
from forecourt.catalog.rule_queries import SQL_TOKENS
from forecourt.catalog.tables import TF, sql_list, text_fact, text_rows
from forecourt.functions import text as tx
from forecourt.operators import textmining as tm
from forecourt.operators import topics

STOP = sql_list(lx.DEFAULT.mining_stop_words)
RUNS = rf"""list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'),
  lambda w: w NOT IN ({STOP}))"""


@query("t01_keywords", TF + rf"""
SELECT sentiment, term, n, rank FROM (
  SELECT sentiment, term, count(*) AS n,
    row_number() OVER (PARTITION BY sentiment ORDER BY count(*) DESC, term) AS rank
  FROM (SELECT sentiment, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM tf)
  WHERE regexp_full_match(term, '[a-z]{{3,}}')
    AND term NOT IN ({sql_list(lx.DEFAULT.keyword_stop_words)})
  GROUP BY sentiment, term) WHERE rank <= 12""")
def t01(spark, d):
    return tm.top_keywords(text_fact(spark, d))


def _grams_sql(n, limit, where=""):
    term = " || ' ' || ".join(f"ts[i + {k}]" for k in range(n))
    return TF + f"""
, tok AS (SELECT doc_id, {RUNS} AS ts FROM tf {where}),
g AS (SELECT doc_id, {term} AS term FROM (
  SELECT doc_id, ts, unnest(range(1, len(ts) - {n} + 2)) AS i FROM tok))
SELECT term, count(*) AS n FROM g GROUP BY term HAVING count(DISTINCT doc_id) >= 2
ORDER BY n DESC, term LIMIT {limit}"""


@query("t02_bigrams", _grams_sql(2, 15))
def t02(spark, d):
    return tm.top_ngrams(text_fact(spark, d), n=2, top_k=15)


@query("t02_negative_bigrams", _grams_sql(2, 12, "WHERE sentiment = 'Negative'"))
def t02b(spark, d):
    df = text_fact(spark, d).where(F.col("sentiment") == lx.NEGATIVE)
    return tm.top_ngrams(df, n=2, top_k=12)


@query("t02_heavy_bigrams", _grams_sql(2, 15))
def t02_heavy(spark, d):
    """The same bigrams from summaries of each task and an exact count of the likely ones."""
    return tm.heavy_ngrams(text_fact(spark, d), n=2, top_k=15)


@query("t02_unigram_vocabulary", _grams_sql(1, 200))
def t02c(spark, d):
    return tm.top_ngrams(text_fact(spark, d), n=1, top_k=200)


@query("o06_top_terms", _grams_sql(1, 20))
def o06(spark, d):
    return tm.top_ngrams(text_fact(spark, d), n=1, top_k=20)


@query("t03_keyphrases", TF + f"""
, tok AS (SELECT doc_id, {SQL_TOKENS} AS ts FROM tf),
g AS (
  SELECT doc_id, unnest(ts) AS term FROM tok UNION ALL
  SELECT doc_id, ts[i] || ' ' || ts[i + 1] FROM (
    SELECT doc_id, ts, unnest(range(1, len(ts))) AS i FROM tok)),
dt AS (SELECT doc_id, term, count(*) AS n FROM g GROUP BY doc_id, term),
vocab AS (SELECT term, sum(n) AS tf, count(*) AS df FROM dt GROUP BY term HAVING count(*) >= 2),
nd AS (SELECT count(*) AS n_docs FROM tf),
w AS (SELECT doc_id, dt.term, n * (ln((1.0 + n_docs) / (1.0 + df)) + 1) AS w
  FROM dt JOIN vocab ON dt.term = vocab.term, nd),
norm AS (SELECT doc_id, sqrt(sum(w * w)) AS l2 FROM w GROUP BY doc_id)
SELECT term, round(sum(w / l2) / any_value(n_docs), 6) AS score
FROM w JOIN norm USING (doc_id), nd GROUP BY term ORDER BY sum(w / l2) DESC, term LIMIT 20""")
def t03(spark, d):
    return tm.keyphrases(text_rows(spark, d), "doc_id").withColumn("score", F.round("score", 6))


@query("a10_zone_text_summary", TF + f"""
, tok AS (SELECT zone, doc_id, unnest({RUNS}) AS term FROM tf WHERE sentiment = 'Negative'),
top AS (SELECT zone, term, count(*) AS n,
    row_number() OVER (PARTITION BY zone ORDER BY count(*) DESC, term) AS r
  FROM tok GROUP BY zone, term HAVING count(DISTINCT doc_id) >= 2)
SELECT a.zone, a.total_reviews, a.negative_pct, coalesce(p, '—') AS top_pain_points FROM (
  SELECT zone, count(*) AS total_reviews,
    round(100.0 * count(*) FILTER (sentiment = 'Negative') / count(*), 1) AS negative_pct
  FROM tf GROUP BY zone) a
LEFT JOIN (SELECT zone, string_agg(term, ', ' ORDER BY r) AS p FROM top WHERE r <= 3 GROUP BY zone) b
  ON a.zone = b.zone""")
def a10(spark, d):
    return tm.zone_text_summary(text_fact(spark, d))


TOPICS, PASSES, TURNS, FEATURES = 8, 20, 3, 500
KS = range(TOPICS)


def _fit(spark, d):
    return topics.fit_topics(text_fact(spark, d), "doc_id", FEATURES, n_topics=TOPICS, passes=PASSES, turns=TURNS)


_DOC_TERMS = TF + f"""
, tok AS (SELECT doc_id, {SQL_TOKENS} AS ts FROM tf),
filled AS (SELECT doc_id, CASE WHEN len(ts) = 0 THEN [{sql_list(lx.EMPTY_TOPIC_DOCUMENT.split())}] ELSE ts END AS ts FROM tok),
g AS (
  SELECT doc_id, unnest(ts) AS term FROM filled UNION ALL
  SELECT doc_id, ts[i] || ' ' || ts[i + 1] FROM (
    SELECT doc_id, ts, unnest(range(1, len(ts))) AS i FROM filled)),
dt AS (SELECT doc_id, term, count(*) AS n FROM g GROUP BY doc_id, term),
vocab AS (SELECT term, sum(n) AS tf FROM dt GROUP BY term
  HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT count(*) FROM tf)
  ORDER BY sum(n) DESC, term LIMIT {FEATURES})
"""


@query("t04_term_counts", _DOC_TERMS + """
SELECT doc_id, sum(n) AS occurrences, count(*) AS terms FROM dt JOIN vocab USING (term)
GROUP BY doc_id""")
def t04_terms(spark, d):
    """What the fit reads: the vocabulary's terms of each document."""
    out = topics.term_counts(text_fact(spark, d), "doc_id", FEATURES)[0].select(
        "doc_id", F.aggregate("counts", F.lit(0), lambda a, x: a + x).cast("long").alias("occurrences"),
        F.size("terms").cast("long").alias("terms"))
    return out.where("terms > 0")


def _psi(x):
    """Digamma of a column by the same recurrence and series as the fit."""
    y = f"({x} + 6)"
    series = "".join(f" {sign} 1.0 / ({c} * {y} ** {p})" for sign, c, p in [
        ("-", 12, 2), ("+", 120, 4), ("-", 252, 6), ("+", 240, 8), ("-", 132, 10)])
    below = "".join(f" - 1.0 / ({x} + {i})" for i in range(6))
    return f"(ln({y}) - 0.5 / {y}{series}{below})"


def _row(template, glue=", "):
    return glue.join(template.format(k=k) for k in KS)


def _fit_sql():
    """The whole fit in SQL: one row per document, one per term, a column per topic.

    b: weights of terms, t: of documents; s: what a term of a document adds up to over the topics.
    """
    prior = 1 / TOPICS
    sql = _DOC_TERMS + f"""
, x AS MATERIALIZED (SELECT doc_id, term, CAST(n AS DOUBLE) AS n FROM dt JOIN vocab USING (term)),
l_0 AS MATERIALIZED (SELECT term, {_row(f"tf / {TOPICS}.0 * (0.5 + CAST('0x' || md5('{{k}}:' || term)[1:8] AS BIGINT) / 4294967296.0) AS l{{k}}")}
  FROM vocab),
g_0 AS MATERIALIZED (SELECT doc_id, {_row(f"{prior} + coalesce(sum(n), 0) / {TOPICS} AS g{{k}}")}
  FROM tf LEFT JOIN x USING (doc_id) GROUP BY doc_id)"""
    for p in range(PASSES):
        sql += f""",
b_{p} AS MATERIALIZED (SELECT term, {_row("exp(p[{k} + 1] - q[{k} + 1]) AS b{k}")}
  FROM (SELECT term, list_transform([{_row("l{k}")}], lambda v: {_psi("v")}) AS p FROM l_{p}),
    (SELECT list_transform([{_row("sum(l{k})")}], lambda v: {_psi("v")}) AS q FROM l_{p}))"""
        for i in range(TURNS):
            sql += f""",
t_{p}_{i} AS MATERIALIZED (SELECT doc_id, {_row(f"exp(p[{{k}} + 1] - p[{TOPICS + 1}]) AS t{{k}}")}
  FROM (SELECT doc_id, list_transform([{_row("g{k}")}, {_row("g{k}", " + ")}], lambda v: {_psi("v")}) AS p
    FROM g_{p * TURNS + i})),
e_{p}_{i} AS MATERIALIZED (SELECT *, n / ({_row("t{k} * b{k}", " + ")}) AS r FROM x JOIN t_{p}_{i} USING (doc_id) JOIN b_{p} USING (term)),
g_{p * TURNS + i + 1} AS MATERIALIZED (SELECT doc_id, {_row(f"{prior} + coalesce(v{{k}}, 0) AS g{{k}}")} FROM t_{p}_{i} LEFT JOIN (
  SELECT doc_id, {_row("sum(t{k} * b{k} * r) AS v{k}")} FROM e_{p}_{i} GROUP BY doc_id) USING (doc_id))"""
        sql += f""",
l_{p + 1} AS MATERIALIZED (SELECT term, {_row(f"{prior} + sum(t{{k}} * b{{k}} * r) AS l{{k}}")}
  FROM e_{p}_{TURNS - 1} GROUP BY term)"""
    return sql + f""",
dist AS MATERIALIZED (SELECT doc_id, list_transform([{_row("g{k}")}], lambda v: v / ({_row("g{k}", " + ")})) AS weights
  FROM g_{PASSES * TURNS}),
"""


_FIT = _fit_sql()
_WORDS = _FIT + f"""
shares AS (SELECT k AS topic, term, round(l[k + 1] / sum(l[k + 1]) OVER (PARTITION BY k), 6) AS share
  FROM (SELECT term, [{_row("l{k}")}] AS l, unnest(range({TOPICS})) AS k FROM l_{PASSES})),
words AS (SELECT CAST(topic AS INTEGER) AS topic, list(term ORDER BY r) AS words FROM (
  SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY share DESC, term) AS r FROM shares)
  WHERE r <= 10 GROUP BY topic),
hits AS (SELECT topic, words, [{", ".join(
    f"len(list_intersect(words, [{sql_list(ws)}]))" for ws in lx.TOPIC_WORDS.values())}] AS h FROM words),
named AS (SELECT topic, words, CASE WHEN list_max(h) > 0
    THEN [{sql_list(list(lx.TOPIC_WORDS))}][list_position(h, list_max(h))]
    ELSE words[1] || ' / ' || words[2] || ' / ' || words[3] END AS label FROM hits)
"""
_DOMINANT = _WORDS + """
, rounded AS (SELECT doc_id, list_transform(weights, lambda w: round(w, 6)) AS w FROM dist),
best AS (SELECT doc_id, CAST(list_position(w, list_max(w)) - 1 AS INTEGER) AS topic FROM rounded)
"""


def _dominant(spark, d):
    fitted = _fit(spark, d)
    return topics.dominant_topics(topics.distributions(fitted), "doc_id", topics.topic_words(fitted), by_words=True)


@query("t04_topic_model", _FIT + f"""
longer AS (SELECT doc_id, unnest(range({TOPICS})) AS k, weights FROM dist)
SELECT doc_id, CAST(k AS INTEGER) AS topic, round(weights[k + 1], 4) AS weight FROM longer""")
def t04(spark, d):
    """The weight of every topic in every document."""
    rows = topics.distributions(_fit(spark, d)).select("doc_id", F.posexplode("weights").alias("topic", "weight"))
    return rows.withColumn("weight", F.round("weight", 4))


@query("t04_weights_complete", _FIT + """
sums AS (SELECT doc_id, len(weights) AS topics, round(list_sum(weights), 6) AS total FROM dist)
SELECT doc_id, CAST(topics AS INTEGER) AS topics, total FROM sums""")
def t04_complete(spark, d):
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    return topics.distributions(_fit(spark, d)).select(
        "doc_id", F.size("weights").alias("topics"), F.round(total, 6).alias("total"))


def _bound_sql():
    """The bound before each pass; a Dirichlet's part as in the fit, with the engine's own log gamma."""
    def part(source, rows, width, letter, p):
        own = " + ".join(f"sum(({1 / TOPICS} - {letter}{k}) * ln({'t' if letter == 'g' else 'b'}{k}) + lgamma({letter}{k}))" for k in KS)
        constant = f"lgamma({width} * {1 / TOPICS}) - {width} * lgamma({1 / TOPICS})"
        return own, constant
    sql = ""
    for p in range(PASSES):
        of_docs, c = part("g", "t", TOPICS, "g", p)
        of_terms, _ = part("l", "b", None, "l", p)
        sql += f"""{', ' if p else ''}
bound_{p} AS (SELECT {p + 1} AS pass,
  (SELECT sum(n * ln(n / r)) FROM e_{p}_0)
  + (SELECT {of_docs} - sum(lgamma({_row("g{k}", " + ")})) + count(*) * ({c}) FROM g_{p * TURNS} JOIN t_{p}_0 USING (doc_id))
  + (SELECT {of_terms} - {_row("lgamma(sum(l{k}))", " - ")}
      + {TOPICS} * (lgamma(count(*) * {1 / TOPICS}) - count(*) * lgamma({1 / TOPICS})) FROM l_{p} JOIN b_{p} USING (term)) AS bound)"""
    return sql + f""",
bounds AS ({" UNION ALL ".join(f"SELECT * FROM bound_{p}" for p in range(PASSES))})"""


@query("t04_bound", _FIT + _bound_sql() + """
SELECT CAST(pass AS INTEGER) AS pass, round(bound, 2) AS bound,
  coalesce(bound >= lag(bound) OVER (ORDER BY pass), true) AS rises FROM bounds""")
def t04_bound(spark, d):
    """The variational bound before each pass of the fit, and that no pass lowers it."""
    bounds = _fit(spark, d).bounds
    rows = [(i + 1, b, i == 0 or b >= bounds[i - 1]) for i, b in enumerate(bounds)]  # one per pass
    return spark.createDataFrame(rows, "pass int, bound double, rises boolean").withColumn("bound", F.round("bound", 2))


@query("t06_fitted_complete", _DOMINANT + f"""
SELECT doc_id, topic BETWEEN 0 AND {TOPICS - 1} AS has_topic, label IS NOT NULL AS has_label
FROM best LEFT JOIN named USING (topic)""")
def t06_fitted(spark, d):
    return _dominant(spark, d).select("doc_id", F.col("topic").between(0, TOPICS - 1).alias("has_topic"),
                                      F.col("label").isNotNull().alias("has_label"))


@query("t05_topic_words", _WORDS + """
SELECT topic, label, CAST(i - 1 AS INTEGER) AS place, words[i] AS term
FROM (SELECT topic, label, words, unnest(range(1, len(words) + 1)) AS i FROM named)""")
def t05(spark, d):
    words = topics.labelled_topics(topics.topic_words(_fit(spark, d)), by_words=True)
    return words.select("topic", "label", F.posexplode("words").alias("place", "term"))


@query("t06_dominant_topics", _DOMINANT + """
SELECT doc_id, topic, label FROM best JOIN named USING (topic)""")
def t06(spark, d):
    return _dominant(spark, d)


@query("t07_topic_table", _WORDS + f"""
, shown AS (SELECT topic, label, list_transform(list_filter(words,
    lambda w: length(w) > 3 AND w NOT IN ({sql_list(lx.TOPIC_NOISE_WORDS)})),
    lambda w: array_to_string(list_transform(string_split(w, ' '), lambda v: upper(v[1]) || v[2:]), ' ')) AS s FROM named)
SELECT topic, label, CAST(i AS INTEGER) AS place, coalesce(s[i], '') AS term
FROM (SELECT topic, label, s, unnest(range(1, 9)) AS i FROM shown)""")
def t07(spark, d):
    return topics.topic_table(topics.topic_words(_fit(spark, d)), by_words=True)


@query("a12_topic_sentiment", _DOMINANT + """
SELECT label, count(*) FILTER (sentiment = 'Positive') AS positive,
  count(*) FILTER (sentiment = 'Neutral') AS neutral,
  count(*) FILTER (sentiment = 'Negative') AS negative
FROM best JOIN named USING (topic) JOIN tf USING (doc_id) GROUP BY label""")
def a12c(spark, d):
    return topics.topic_sentiment(_dominant(spark, d), text_fact(spark, d), "doc_id")


@query("a20_topic_labels", _DOMINANT + """
SELECT label, count(*) AS reviews FROM best JOIN named USING (topic) GROUP BY label""")
def a20(spark, d):
    return topics.topic_frequency(_dominant(spark, d))


@query("j06_topic_labels", _DOMINANT + """
SELECT doc_id, station_name, topic, label FROM best JOIN named USING (topic) JOIN tf USING (doc_id)""")
def j06(spark, d):
    return text_fact(spark, d).select("doc_id", "station_name").join(_dominant(spark, d), "doc_id")
