"""Registered text-analytics queries (T1-T16, A13, K1) over ``documents``, ``labels``, ``pages``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from voltaic.functions import scalar as X
from voltaic.operators import text as T
from voltaic.operators.relational import top_n
from voltaic.plans.registry import register
from voltaic.session import spread
from voltaic.sources.tables import Tables

TOK = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+')"
SENT = r"regexp_extract_all({c}, '[^.!?\n]+[.!?]*')"

# Word glossary (English to Italian and German, Italian to English and German) for T7.
GLOSSARY = [
    ("en", "it", "the", "il"), ("en", "it", "and", "e"), ("en", "it", "of", "di"), ("en", "it", "is", "è"),
    ("en", "it", "with", "con"), ("en", "it", "for", "per"), ("en", "it", "this", "questo"),
    ("en", "it", "that", "che"), ("en", "it", "from", "da"), ("en", "it", "on", "su"),
    ("en", "it", "as", "come"), ("en", "it", "are", "sono"), ("en", "it", "was", "era"),
    ("en", "it", "it", "esso"), ("en", "it", "to", "a"), ("en", "it", "in", "in"), ("en", "it", "a", "un"),
    ("en", "it", "by", "da"), ("en", "it", "be", "essere"), ("en", "it", "at", "a"),
    ("en", "de", "the", "die"), ("en", "de", "and", "und"), ("en", "de", "of", "von"), ("en", "de", "is", "ist"),
    ("en", "de", "with", "mit"), ("en", "de", "for", "für"), ("en", "de", "this", "dies"),
    ("en", "de", "that", "dass"), ("en", "de", "from", "aus"), ("en", "de", "on", "auf"),
    ("en", "de", "as", "als"), ("en", "de", "are", "sind"), ("en", "de", "was", "war"),
    ("en", "de", "it", "es"), ("en", "de", "to", "zu"), ("en", "de", "in", "in"), ("en", "de", "a", "ein"),
    ("en", "de", "by", "durch"), ("en", "de", "be", "sein"), ("en", "de", "at", "bei"),
    ("it", "en", "il", "the"), ("it", "en", "la", "the"), ("it", "en", "di", "of"), ("it", "en", "e", "and"),
    ("it", "en", "non", "not"), ("it", "en", "bolletta", "bill"), ("it", "en", "contatore", "meter"),
    ("it", "en", "guasto", "fault"), ("it", "en", "servizio", "service"), ("it", "en", "contratto", "contract"),
    ("it", "en", "grazie", "thanks"), ("it", "en", "corrente", "power"), ("it", "en", "mese", "month"),
    ("it", "en", "consumi", "consumption"), ("it", "en", "per", "for"), ("it", "en", "con", "with"),
    ("it", "en", "in", "in"), ("it", "en", "un", "a"), ("it", "en", "una", "a"), ("it", "en", "ho", "have"),
    ("it", "de", "il", "der"), ("it", "de", "la", "die"), ("it", "de", "di", "von"), ("it", "de", "e", "und"),
    ("it", "de", "non", "nicht"), ("it", "de", "bolletta", "Rechnung"), ("it", "de", "contatore", "Zähler"),
    ("it", "de", "guasto", "Störung"), ("it", "de", "servizio", "Service"), ("it", "de", "contratto", "Vertrag"),
    ("it", "de", "grazie", "danke"), ("it", "de", "corrente", "Strom"), ("it", "de", "mese", "Monat"),
    ("it", "de", "consumi", "Verbrauch"), ("it", "de", "per", "für"), ("it", "de", "con", "mit"),
    ("it", "de", "in", "in"), ("it", "de", "un", "ein"), ("it", "de", "una", "eine"), ("it", "de", "ho", "habe"),
    # phrases: the longest entry that begins at a place wins, "of the" over "of", "la pompa di calore" over "la"
    ("en", "it", "of the", "del"), ("en", "it", "to the", "al"), ("en", "it", "in the", "nel"), ("en", "it", "is the", "è il"),
    ("en", "it", "of the and", "del e anche"), ("en", "it", "and the", "e il"),
    ("en", "de", "of the", "des"), ("en", "de", "to the", "zum"), ("en", "de", "in the", "im"), ("en", "de", "and of the", "und des"),
    ("it", "en", "pompa di calore", "heat pump"), ("it", "en", "la pompa di calore", "the heat pump"),
    ("it", "en", "la pompa", "the pump"), ("it", "en", "conto", "account"), ("it", "en", "sul conto", "on the account"),
    ("it", "en", "problema tecnico", "technical problem"), ("it", "en", "problema", "problem"),
    ("it", "de", "pompa di calore", "Wärmepumpe"), ("it", "de", "problema tecnico urgente", "dringendes technisches Problem"),
    ("it", "de", "problema tecnico", "technisches Problem"),
]
QUALITY_LABELS = ["high", "low"]
# Our own questions for T12 and our own instruction for T8.
QUESTIONS = [(1, "Which device, meter or line needs attention?"),
             (2, "By when should the work be finished and where?")]
PROMPT_INSTRUCTION = ("Read the message below and answer in two lines. First line: when someone has to act (now, today, "
                      "this week, no hurry). Second line: which team takes it and why. ")


def _sql_values(rows) -> str:
    def lit(v):
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def segmented_sql(text: str, phrases: str, match: str | None = None) -> str:
    """DuckDB list of a text's pieces: tokens written as ``<token>``, cut from left to right by an alternation of phrases (in
    the same writing, longest first), which is the longest-match segmentation; a token of no phrase is a piece of its own."""
    tokens = f"array_to_string(list_transform({text}, lambda x: '<' || x || '>'), '')"
    return f"regexp_extract_all({tokens}, {phrases}{match or ''})"


def phrases_sql(table: str, phrase: str, tokens: str) -> str:
    """The alternation of a table's phrases, longest first."""
    return (f"(SELECT string_agg(p, '|' ORDER BY n DESC, p) FROM (SELECT DISTINCT array_to_string(list_transform(t, lambda x: '<' || x || '>'), '') AS p, "
            f"len(t) AS n FROM (SELECT {tokens.format(c=phrase)} AS t FROM {table}) WHERE len(t) > 0))")


def translation_ctes(src: str, dst: str, name: str, texts: str, key: str) -> str:
    """CTEs that translate ``texts(key, text)`` into ``name(key, t)`` by the glossary ``g``."""
    return f"""
{name}_g AS (SELECT array_to_string(list_transform({TOK.format(c='word')}, lambda x: '<' || x || '>'), '') AS p, MIN(target) AS target,
             len({TOK.format(c='word')}) AS n FROM g WHERE src = '{src}' AND dst = '{dst}' GROUP BY ALL),
{name}_p AS (SELECT string_agg(p, '|' ORDER BY n DESC, p) || '|<[^>]*>' AS alt, map_from_entries(list((p, target))) AS m FROM {name}_g),
{name} AS (SELECT {key}, array_to_string(list_transform({segmented_sql(TOK.format(c="COALESCE(text, '')"), 'alt')},
             lambda x: COALESCE(m[x], x[2:len(x) - 1])), ' ') AS t FROM {texts}, {name}_p)"""


def _quality_scores(spark: SparkSession, d: str):
    t = Tables(spark, d)
    lex = T.learn_lexicon(t.documents, t.labels, "doc_id", "text", "quality")
    return T.sentiment(t.documents, "doc_id", "text", lex)


LEXICON_SQL = rf"""
tok AS (SELECT doc_id, unnest({TOK.format(c='text')}) AS token FROM documents),
cnt AS (SELECT token, SUM(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END) AS c1,
               SUM(CASE WHEN l.quality = 0 THEN 1 ELSE 0 END) AS c0
        FROM tok JOIN labels l USING (doc_id) GROUP BY token),
tot AS (SELECT SUM(c1) AS n1, SUM(c0) AS n0, COUNT(*) AS v FROM cnt),
lex AS (SELECT token, ln((c1 + 1) / (n1 + v)) - ln((c0 + 1) / (n0 + v)) AS weight FROM cnt, tot),
tf AS (SELECT doc_id, token, COUNT(*) AS tf FROM tok GROUP BY ALL),
agg AS (SELECT doc_id, SUM(tf * COALESCE(weight, 0)) AS s, SUM(CASE WHEN weight IS NOT NULL THEN tf END) AS n
        FROM tf LEFT JOIN lex USING (token)
        GROUP BY doc_id),
sc AS (SELECT d.doc_id, COALESCE(tanh(agg.s / agg.n), 0) AS score FROM documents d LEFT JOIN agg USING (doc_id))"""

BAND_SQL = "CASE WHEN {s} > 0.3 THEN 'POSITIVO' WHEN {s} < -0.3 THEN 'NEGATIVO' ELSE 'NEUTRO' END"


@register("t1_tokens", rf"""
SELECT doc_id, len({TOK.format(c='text')}) AS n_tokens, len(list_distinct({TOK.format(c='text')})) AS n_distinct
FROM documents""")
def t1(spark, d):
    """Tokenisation (letters/digits runs of the lower-cased text): token and distinct counts."""
    docs = Tables(spark, d).documents
    arr = F.regexp_extract_all(F.lower("text"), F.lit(T.TOKEN_PATTERN), 0)
    return docs.select("doc_id", F.size(arr).cast("long").alias("n_tokens"),
                       F.size(F.array_distinct(arr)).cast("long").alias("n_distinct"))


@register("t2_t3_quality_score", f"""
WITH {LEXICON_SQL}
SELECT doc_id, ROUND(score, 3) AS score, {BAND_SQL.format(s='score')} AS band FROM sc""")
def t2_t3(spark, d):
    """T2 lexicon score in [-1, 1] (lexicon learned as log-odds of ``labels.quality``), T3 band.

    ``quality`` stands in for a sentiment label, hence the neutral column name ``score``.
    """
    s = _quality_scores(spark, d)
    return s.select("doc_id", F.round("score", 3).alias("score"), T.sentiment_band(F.col("score")).alias("band"))


@register("t4_a13_score_stats_by_source", f"""
WITH {LEXICON_SQL}
SELECT d.source, COUNT(*) AS n_docs, ROUND(AVG(score), 3) AS avg_score, ROUND(MIN(score), 3) AS min_score,
       ROUND(MAX(score), 3) AS max_score, CAST(SUM(CASE WHEN score < -0.3 THEN 1 ELSE 0 END) AS BIGINT) AS negatives,
       CAST(SUM(CASE WHEN score > 0.3 THEN 1 ELSE 0 END) AS BIGINT) AS positives
FROM documents d JOIN sc USING (doc_id) GROUP BY d.source""")
def t4(spark, d):
    """Score statistics per category; the score is computed once, upstream."""
    t = Tables(spark, d)
    s = t.documents.select("doc_id", "source").join(_quality_scores(spark, d), "doc_id")
    return s.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("score"), 3).alias("avg_score"),
        F.round(F.min("score"), 3).alias("min_score"), F.round(F.max("score"), 3).alias("max_score"),
        F.count_if(F.col("score") < -0.3).alias("negatives"), F.count_if(F.col("score") > 0.3).alias("positives"))


@register("t5_k1_worst_distinct_texts", rf"""
WITH u AS (SELECT DISTINCT text, lang, source FROM documents),
ut AS (SELECT DISTINCT text FROM u),
tok AS (SELECT text AS k, unnest({TOK.format(c='text')}) AS token FROM ut),
dtok AS (SELECT doc_id, unnest({TOK.format(c='text')}) AS token FROM documents),
cnt AS (SELECT token, SUM(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END) AS c1,
               SUM(CASE WHEN l.quality = 0 THEN 1 ELSE 0 END) AS c0
        FROM dtok JOIN labels l USING (doc_id) GROUP BY token),
tot AS (SELECT SUM(c1) AS n1, SUM(c0) AS n0, COUNT(*) AS v FROM cnt),
lex AS (SELECT token, ln((c1 + 1) / (n1 + v)) - ln((c0 + 1) / (n0 + v)) AS weight FROM cnt, tot),
tf AS (SELECT k, token, COUNT(*) AS tf FROM tok GROUP BY ALL),
agg AS (SELECT k, SUM(tf * COALESCE(weight, 0)) AS s, SUM(CASE WHEN weight IS NOT NULL THEN tf END) AS n
        FROM tf LEFT JOIN lex USING (token) GROUP BY k),
sc AS (SELECT u.lang, u.source, u.text, ROUND(COALESCE(tanh(agg.s / agg.n), 0), 3) AS score,
              COALESCE(tanh(agg.s / agg.n), 0) AS raw FROM u LEFT JOIN agg ON agg.k = u.text)
SELECT lang, source, substr(text, 1, 80) || '...' AS preview, score, {BAND_SQL.format(s='raw')} AS band
FROM sc ORDER BY score, preview, lang, source LIMIT 20""")
def t5(spark, d):
    """De-duplicate (text, lang, source), score each distinct text once, worst 20."""
    t = Tables(spark, d)
    lex = T.learn_lexicon(t.documents, t.labels, "doc_id", "text", "quality")
    u = (t.documents.groupBy(F.sha2("text", 256).alias("_k"), "lang", "source")
         .agg(F.first("text").alias("text"), F.first(X.preview("text", 80)).alias("preview")).drop("_k"))
    scored = T.score_distinct(u, "text", lambda df, i, c: T.sentiment(df, i, c, lex))
    # the whole texts end at their scores: the join back carries previews
    out = scored.select("lang", "source", "preview",
                        F.round("score", 3).alias("score"), T.sentiment_band(F.col("score")).alias("band"))
    return top_n(out, ["score", "preview", "lang", "source"], 20)


@register("t6_summaries", rf"""
WITH s AS (SELECT doc_id, trim(unnest({SENT.format(c='text')})) AS sentence,
                  generate_subscripts({SENT.format(c='text')}, 1) - 1 AS spos FROM documents),
s2 AS (SELECT * FROM s WHERE sentence <> ''),
st AS (SELECT doc_id, spos, unnest({TOK.format(c='sentence')}) AS token FROM s2),
dtf AS (SELECT doc_id, token, COUNT(*) AS dtf FROM st GROUP BY ALL),
sc AS (SELECT st.doc_id, st.spos, CAST(SUM(dtf) AS DOUBLE) / COUNT(*) AS score
       FROM st JOIN dtf USING (doc_id, token) GROUP BY ALL),
top AS (SELECT doc_id, spos, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, spos) AS r FROM sc)
SELECT doc_id, string_agg(sentence, ' ' ORDER BY spos) AS summary
FROM top JOIN s2 USING (doc_id, spos) WHERE r <= 3 GROUP BY doc_id""")
def t6(spark, d):
    """Extractive 3-sentence summary per document (whole text, all sentences scored)."""
    return T.summarize(Tables(spark, d).documents, "doc_id", "text", 3)


@register("t7_translate_en", rf"""
WITH g(src, dst, word, target) AS (VALUES {_sql_values(GLOSSARY)}),
src AS (SELECT doc_id, text FROM documents WHERE lang = 'en'),
{translation_ctes('en', 'it', 'it', 'src', 'doc_id')},
{translation_ctes('en', 'de', 'de', 'src', 'doc_id')}
SELECT it.doc_id, it.t AS translation_it, de.t AS translation_de FROM it JOIN de USING (doc_id)""")
def t7(spark, d):
    """Glossary translation (words and phrases, longest first) of English texts into two languages (two passes)."""
    docs = Tables(spark, d).documents.where(F.col("lang") == "en")
    g = spark.createDataFrame(GLOSSARY, "src string, dst string, word string, target string")
    it = T.translate(docs, "doc_id", "text", g, "en", "it", "translation_it")
    de = T.translate(docs, "doc_id", "text", g, "en", "de", "translation_de")
    return it.join(de, "doc_id")


@register("t8_prompts", f"""
SELECT doc_id, '{PROMPT_INSTRUCTION}' || 'Source: ' || COALESCE(source, '') || '. Feedback: ' || COALESCE(text, '')
       AS prompt
FROM documents""")
def t8(spark, d):
    """One prompt per row (instruction + columns, null -> '') of every document."""
    docs = Tables(spark, d).documents
    return docs.select("doc_id", T.build_prompt(PROMPT_INSTRUCTION, [("Source: ", F.col("source")),
                                                                       (". Feedback: ", F.col("text"))]).alias("prompt"))


@register("t9_kpi_report_prompt", """
WITH s AS (SELECT CAST(date_trunc('month', max(o_orderdate)) - INTERVAL 3 MONTH AS DATE) AS lo FROM orders),
k AS (SELECT CAST(ROUND(CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100, 0) AS BIGINT) AS tot,
             CAST(ROUND(CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / COUNT(*)) AS BIGINT) AS avg_cents,
             COUNT(DISTINCT o_custkey) AS n
      FROM orders WHERE CAST(date_trunc('month', o_orderdate) AS DATE) >= (SELECT lo FROM s))
SELECT 'Write a short report (max 200 words) on the last 3 months. Data: total cost = ' || CAST(tot AS VARCHAR)
       || ' EUR, average bill = ' || CAST(avg_cents // 100 AS VARCHAR) || '.' || lpad(CAST(avg_cents % 100 AS VARCHAR), 2, '0')
       || ' EUR, active customers = ' || CAST(n AS VARCHAR) || '. Include trends and recommendations.' AS prompt
FROM k""")
def t9(spark, d):
    """Aggregate to one KPI row, render the numbers into a report prompt."""
    o = Tables(spark, d).orders
    lo = F.add_months(o.select(F.trunc(F.max("o_orderdate").cast("date"), "MM")).scalar(), -3)
    c = X.cents("o_totalprice")
    k = o.where(X.month_start("o_orderdate") >= lo).agg(
        F.round(F.sum(c).cast("double") / 100, 0).cast("long").alias("tot"),
        F.round(F.sum(c).cast("double") / F.count(F.lit(1))).cast("long").alias("avg_cents"),
        F.count_distinct("o_custkey").alias("n"))
    return k.select(F.concat(
        F.lit("Write a short report (max 200 words) on the last 3 months. Data: total cost = "),
        F.col("tot").cast("string"), F.lit(" EUR, average bill = "),
        F.floor(F.col("avg_cents") / 100).cast("long").cast("string"), F.lit("."),
        F.lpad(F.pmod("avg_cents", F.lit(100)).cast("string"), 2, "0"),
        F.lit(" EUR, active customers = "), F.col("n").cast("string"),
        F.lit(". Include trends and recommendations.")).alias("prompt"))


def nb_sql(labelled: str, labels: list[str]) -> str:
    """CTEs of multinomial naive Bayes learned from ``labelled`` (a query for doc_id, label); the last, ``cls``, has the answer
    for every document."""
    values = ", ".join(f"('{x}')" for x in labels)
    return rf"""
tok AS (SELECT doc_id, unnest({TOK.format(c='text')}) AS token FROM documents),
lab AS ({labelled}),
cnt AS (SELECT token, label, COUNT(*) AS c FROM tok JOIN lab USING (doc_id) GROUP BY ALL),
v AS (SELECT COUNT(DISTINCT token) AS v FROM cnt),
tot AS (SELECT label, SUM(c) AS n FROM cnt GROUP BY label),
grid AS (SELECT token, label FROM (SELECT DISTINCT token FROM cnt), (VALUES {values}) x(label)),
word AS (SELECT g.token, g.label, ln((COALESCE(c, 0) + 1) / (COALESCE(n, 0) + v)) AS logp
         FROM grid g LEFT JOIN cnt USING (token, label) LEFT JOIN tot USING (label), v),
prior AS (SELECT label, ln(COUNT(*) / (SELECT COUNT(*) FROM lab)) AS logprior FROM lab GROUP BY label),
tf AS (SELECT doc_id, token, COUNT(*) AS tf FROM tok GROUP BY ALL),
ll AS (SELECT doc_id, label, SUM(tf * logp) AS ll FROM tf JOIN word USING (token) GROUP BY ALL),
dg AS (SELECT doc_id, label FROM documents, (VALUES {values}) x(label)),
s AS (SELECT dg.doc_id, dg.label, COALESCE(logprior, '-inf'::DOUBLE) + COALESCE(ll, 0) AS s
      FROM dg LEFT JOIN ll USING (doc_id, label) LEFT JOIN prior USING (label)),
m AS (SELECT doc_id, MAX(s) AS m FROM s GROUP BY doc_id),
z AS (SELECT doc_id, SUM(exp(s - m)) AS z FROM s JOIN m USING (doc_id) GROUP BY doc_id),
best AS (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, label) AS r FROM s),
cls AS (SELECT doc_id, label, 1.0 / z AS p FROM best JOIN z USING (doc_id) WHERE r = 1)"""


NB_SQL = nb_sql("SELECT doc_id, CASE WHEN l.quality = 1 THEN 'high' ELSE 'low' END AS label FROM documents JOIN labels l USING (doc_id)",
                QUALITY_LABELS)


def _classified(spark, d):
    t = Tables(spark, d)
    lab = t.labels.select("doc_id", F.when(F.col("quality") == 1, "high").otherwise("low").alias("label"))
    word, prior = T.naive_bayes_tables(t.documents, lab, "doc_id", "text", "label", QUALITY_LABELS)
    return T.classify(t.documents, "doc_id", "text", word, prior, QUALITY_LABELS)


@register("t11_classify_quality", f"""
WITH {NB_SQL}
SELECT doc_id, label, ROUND(p, 3) AS score FROM cls""")
def t11(spark, d):
    """Multinomial naive Bayes from labelled rows; label + softmax score rounded to 3."""
    c = _classified(spark, d)
    return c.select("doc_id", "label", F.round("score", 3).alias("score"))


# Our own conditions for T14 (the driver's texts are invented words, so they name what such a text is made of).
CONDITIONS = [(1, "the text is of the kind that is written for an English reader"), (2, "ein Text, der nicht auf Englisch ist und der Sätze mit der, die und das hat"),
              (3, "un texte pour les lecteurs de la France, dans une langue que je lis"), (4, "el texto que se escribe para los lectores de la lengua en la que hablo"),
              (5, "all rights reserved, licensed under the Apache License")]


def ai_filter_ctes(texts: str, key: str, conditions) -> str:
    """CTEs of the free-condition filter over ``texts(key, text)``: the last, ``answer``, has a row per text and condition."""
    return rf"""
cond(condition_id, condition) AS (VALUES {_sql_values(conditions)}),
doc_t AS (SELECT DISTINCT {key}, unnest({TOK.format(c='text')}) AS token FROM {texts}),
ct AS (SELECT DISTINCT condition_id, unnest({TOK.format(c='condition')}) AS token FROM cond),
cond_hit AS (SELECT * FROM doc_t WHERE token IN (SELECT token FROM ct)),
cond_idf AS (SELECT token, ln(1 + (SELECT COUNT(*) FROM {texts}) / COUNT(*)) AS idf FROM cond_hit GROUP BY token),
weighed AS (SELECT condition_id, token, idf FROM ct JOIN cond_idf USING (token)),
total AS (SELECT condition_id, SUM(idf) AS total FROM weighed GROUP BY condition_id),
met AS (SELECT {key}, condition_id, CAST(ROUND(ROUND(SUM(idf) / ANY_VALUE(total), 6) * 1000) AS BIGINT) AS score
        FROM cond_hit JOIN weighed USING (token) JOIN total USING (condition_id) GROUP BY ALL),
scores AS (SELECT x.{key}, c.condition_id, COALESCE(met.score, 0) AS score FROM {texts} x CROSS JOIN cond c
           LEFT JOIN met ON met.{key} = x.{key} AND met.condition_id = c.condition_id),
steps AS (SELECT condition_id, score, COUNT(*) AS n FROM scores GROUP BY ALL),
parts AS (SELECT condition_id, score,
                 CAST(SUM(n) OVER below AS DOUBLE) AS n0, SUM(CAST(n * score AS DOUBLE)) OVER below AS s0,
                 CAST(SUM(n) OVER whole AS DOUBLE) AS n, SUM(CAST(n * score AS DOUBLE)) OVER whole AS s FROM steps
          WINDOW whole AS (PARTITION BY condition_id),
                 below AS (PARTITION BY condition_id ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
gaps AS (SELECT condition_id, score, ROUND(n0 / n * ((n - n0) / n) * (s0 / n0 - (s - s0) / (n - n0)) * (s0 / n0 - (s - s0) / (n - n0)), 6) AS gap
         FROM parts WHERE n0 IS NOT NULL),
cuts AS (SELECT condition_id, score AS threshold FROM gaps
         QUALIFY row_number() OVER (PARTITION BY condition_id ORDER BY gap DESC, score) = 1),
answer AS (SELECT scores.*, COALESCE(score >= threshold, FALSE) AS holds FROM scores LEFT JOIN cuts USING (condition_id))"""


@register("t14_semantic_filter", f"""
WITH {ai_filter_ctes('documents', 'doc_id', CONDITIONS)}
SELECT doc_id, condition_id, score, holds FROM answer""")
def t14(spark, d):
    """Five free conditions asked of every document in one pass, each with the natural cut of its scores."""
    c = spark.createDataFrame(CONDITIONS, "condition_id int, condition string")
    return T.ai_filter(Tables(spark, d).documents, "doc_id", "text", c)


@register("t14_filtered_by_source", f"""
WITH {ai_filter_ctes('documents', 'doc_id', CONDITIONS)}
SELECT source, condition_id, COUNT(*) AS n_docs FROM answer JOIN documents USING (doc_id) WHERE holds GROUP BY ALL""")
def t14_by_source(spark, d):
    """T14 as a ``where``: documents per source for which each condition holds."""
    docs = Tables(spark, d).documents
    c = spark.createDataFrame(CONDITIONS, "condition_id int, condition string")
    a = T.ai_filter(docs, "doc_id", "text", c).where("holds")
    return docs.select("doc_id", "source").join(a, "doc_id").groupBy("source", "condition_id").agg(F.count(F.lit(1)).alias("n_docs"))


# A label with several outcomes: the language of a text. One of five folds is held out of training.
LANGUAGES = ["de", "en", "es", "fr"]
_FOLD = X.fold_sql("doc_id", 5)


@register("t11_classify_held_out", f"""
WITH {nb_sql(f"SELECT doc_id, lang AS label FROM documents WHERE lang IN ({', '.join(repr(x) for x in LANGUAGES)}) AND {_FOLD} <> 0", LANGUAGES)}
SELECT cls.doc_id, cls.label, ROUND(p, 3) AS score, d.lang AS truth
FROM cls JOIN documents d USING (doc_id) WHERE {_FOLD} = 0 AND d.lang IN ({", ".join(repr(x) for x in LANGUAGES)})""")
def t11_held_out(spark, d):
    """Naive Bayes learned from four folds of the documents with a language, answers and truth for the fifth."""
    docs = Tables(spark, d).documents.where(F.col("lang").isin(LANGUAGES))
    lab = docs.where(X.fold_of("doc_id", 5) != 0).select("doc_id", F.col("lang").alias("label"))
    word, prior = T.naive_bayes_tables(docs.select("doc_id", "text"), lab, "doc_id", "text", "label", LANGUAGES)
    held = docs.where(X.fold_of("doc_id", 5) == 0)
    c = T.classify(held, "doc_id", "text", word, prior, LANGUAGES)
    return c.join(held.select("doc_id", F.col("lang").alias("truth")), "doc_id").select(
        "doc_id", "label", F.round("score", 3).alias("score"), "truth")


@register("t12_extract_answer", rf"""
WITH q(question_id, question) AS (VALUES {_sql_values(QUESTIONS)}),
s AS (SELECT doc_id, trim(unnest({SENT.format(c='text')})) AS sentence,
             generate_subscripts({SENT.format(c='text')}, 1) - 1 AS spos FROM documents),
s2 AS (SELECT * FROM s WHERE sentence <> ''),
st AS (SELECT DISTINCT doc_id, spos, unnest({TOK.format(c='sentence')}) AS token FROM s2),
dfq AS (SELECT token, COUNT(DISTINCT doc_id) AS df FROM st GROUP BY token),
qt AS (SELECT DISTINCT question_id, unnest({TOK.format(c='question')}) AS token FROM q),
qw AS (SELECT question_id, token, ln((SELECT COUNT(*) FROM documents) / df) AS idf FROM qt JOIN dfq USING (token)),
sc AS (SELECT doc_id, question_id, spos, ROUND(SUM(idf), 9) AS score FROM st JOIN qw USING (token) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, question_id ORDER BY score DESC, spos) AS r FROM sc)
SELECT d.doc_id, q.question_id, s2.sentence AS answer, ROUND(b.score, 3) AS score
FROM documents d CROSS JOIN (SELECT question_id FROM q) q
LEFT JOIN best b ON b.doc_id = d.doc_id AND b.question_id = q.question_id AND b.r = 1
LEFT JOIN s2 ON s2.doc_id = b.doc_id AND s2.spos = b.spos""")
def t12(spark, d):
    """Answer extraction, two questions in one pass (best IDF-weighted sentence per text)."""
    docs = Tables(spark, d).documents
    q = spark.createDataFrame(QUESTIONS, "question_id int, question string")
    a = T.extract_answer(docs, "doc_id", "text", q)
    return a.select("doc_id", "question_id", "answer", F.round("score", 3).alias("score"))


def _ent_sql(p: str, group: int = 0) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(text, '{p}', {group})))"


def _ent_cols(name: str, arr: str) -> str:
    return f"array_to_string({arr}, ';') AS {name}, len({arr}) AS n_{name}"


AS_WRITTEN = r"regexp_extract_all({c}, '[\p{{L}}\p{{N}}]+')"


def entities_sql(texts: str, key: str, places: str) -> str:
    """DuckDB entities of ``texts(key, text)`` with the place names of ``places(place)``."""
    enc = "array_to_string(list_transform({t}, lambda x: '<' || x || '>'), '')"
    return rf"""
place_p AS (SELECT {enc.format(t=AS_WRITTEN.format(c='place'))} AS p, MIN(place) AS place, len({AS_WRITTEN.format(c='place')}) AS n
            FROM {places} GROUP BY ALL),
place_alt AS (SELECT string_agg(p, '|' ORDER BY n DESC, p) AS alt, map_from_entries(list((p, place))) AS m FROM place_p WHERE n > 0),
ents AS (SELECT {key}, {_ent_cols('emails', _ent_sql(T.EMAIL_PATTERN))}, {_ent_cols('phones', _ent_sql(T.PHONE_PATTERN))},
       {_ent_cols('links', _ent_sql(T.URL_PATTERN))}, {_ent_cols('streets', _ent_sql(T.STREET_PATTERN))},
       {_ent_cols('places', f"list_sort(list_distinct(list_transform({segmented_sql(AS_WRITTEN.format(c='text'), 'alt')}, lambda x: m[x])))")}
       FROM {texts}, place_alt)"""


_SLOT = "CAST('0x' || substr(md5(token), {a}, {n}) AS BIGINT)"


@register("t15_embed", rf"""
WITH tok AS (SELECT doc_id, unnest({TOK.format(c='text')}) AS token FROM documents),
tf AS (SELECT doc_id, token, COUNT(*) AS tf FROM tok GROUP BY ALL),
w AS (SELECT token, CAST({_SLOT.format(a=1, n=12)} % 64 AS INTEGER) AS slot,
             CASE WHEN {_SLOT.format(a=13, n=4)} % 2 = 0 THEN 1 ELSE -1 END * ln(((SELECT COUNT(*) FROM documents) + 1) / (COUNT(*) + 1)) AS w
      FROM tf GROUP BY token),
cells AS (SELECT doc_id, slot, SUM(tf * w) AS x FROM tf JOIN w USING (token) GROUP BY ALL),
norm AS (SELECT doc_id, sqrt(SUM(x * x)) AS norm FROM cells GROUP BY doc_id),
dense AS (SELECT d.doc_id, s.slot, CASE WHEN norm > 0 THEN ROUND(COALESCE(x, 0) / norm, 6) + 0.0 ELSE 0.0 END AS v
          FROM documents d CROSS JOIN (SELECT unnest(range(64)) AS slot) s LEFT JOIN norm USING (doc_id)
          LEFT JOIN cells ON cells.doc_id = d.doc_id AND cells.slot = s.slot)
SELECT doc_id, CAST(slot AS INTEGER) AS slot, CAST(v AS DOUBLE) AS value FROM dense""")
def t15(spark, d):
    """Signed hashed TF x IDF embedding in 64 dimensions, L2-normalised, one row per component."""
    e = T.embed(Tables(spark, d).documents, "doc_id", "text", 64)
    return e.select("doc_id", F.posexplode("embedding").alias("slot", "value"))


@register("t10_bigram_completion", rf"""
WITH RECURSIVE t AS (SELECT doc_id, {TOK.format(c='text')} AS t FROM documents),
pairs AS (SELECT unnest(t[1:len(t) - 1]) AS token, unnest(t[2:len(t)]) AS next FROM t WHERE len(t) > 1),
model AS (SELECT token, next FROM (SELECT token, next, COUNT(*) AS n FROM pairs GROUP BY ALL)
          QUALIFY row_number() OVER (PARTITION BY token ORDER BY n DESC, next) = 1),
asked AS (SELECT item_id, {TOK.format(c='text')} AS t FROM benchmark),
chain(item_id, k, token, said) AS (
  SELECT item_id, 0, t[len(t)], '' FROM asked
  UNION ALL
  SELECT c.item_id, k + 1, m.next, CASE WHEN said = '' THEN m.next ELSE said || ' ' || m.next END
  FROM chain c JOIN model m USING (token) WHERE k < 5)
SELECT item_id, said AS completion FROM chain QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY k DESC) = 1""")
def t10_bigrams(spark, d):
    """Every benchmark text as a prompt, continued by five words of a bigram model trained on all documents."""
    t = Tables(spark, d)
    model = T.next_words(t.documents, "doc_id", "text")
    return T.complete_by_bigrams(t.benchmark, "item_id", "text", model, 5)


def _html_sql() -> str:
    x = "html"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    x = f"regexp_replace({x}, '(?is)<script\\b.*?</script>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?is)<style\\b.*?</style>', ' ', 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for k, v in T.ENTITIES:
        x = f"replace({x}, '{k}', '{v.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({x}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


@register("t16_html_to_text", f"""
SELECT page_id, url, {_html_sql()} AS text, length({_html_sql()}) AS n_chars FROM pages""")
def t16(spark, d):
    """Markup to text over the whole ``pages.html`` column (reading order kept)."""
    p = Tables(spark, d).pages
    txt = T.html_to_text(F.col("html"))
    return p.select("page_id", "url", txt.alias("text"), F.length(txt).cast("long").alias("n_chars"))


# The label list of the domain's classification call (each label is its own descriptor).
FEEDBACK_LABELS = ["Problema tecnico urgente", "Richiesta informazioni", "Reclamo commerciale", "Complimento",
                   "Richiesta modifica contratto"]


@register("t11b_classify_by_label_names", rf"""
WITH lab(ord, label) AS (VALUES {_sql_values(list(enumerate(FEEDBACK_LABELS, 1)))}),
dt AS (SELECT DISTINCT label, unnest({TOK.format(c='label')}) AS token FROM lab),
doc_t AS (SELECT DISTINCT doc_id, unnest({TOK.format(c='text')}) AS token FROM documents),
hit AS (SELECT * FROM doc_t WHERE token IN (SELECT token FROM dt)),
idf AS (SELECT token, ln((SELECT COUNT(*) FROM documents) / COUNT(*)) AS idf FROM hit GROUP BY token),
s AS (SELECT doc_id, label, SUM(idf) AS s FROM hit JOIN dt USING (token) JOIN idf USING (token) GROUP BY ALL),
g AS (SELECT d.doc_id, lab.label, lab.ord, COALESCE(s.s, 0) AS s FROM documents d CROSS JOIN lab
      LEFT JOIN s ON s.doc_id = d.doc_id AND s.label = lab.label),
m AS (SELECT doc_id, MAX(s) AS m FROM g GROUP BY doc_id),
z AS (SELECT doc_id, SUM(exp(s - m)) AS z FROM g JOIN m USING (doc_id) GROUP BY doc_id),
b AS (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, ord) AS r FROM g)
SELECT doc_id, label, ROUND(1.0 / z, 3) AS score FROM b JOIN z USING (doc_id) WHERE r = 1""")
def t11b(spark, d):
    """T11 (label-list form): classify every text into the given label names by IDF-weighted token
    overlap with each label; argmax label and softmax score rounded to 3."""
    docs = Tables(spark, d).documents
    desc = spark.createDataFrame([(x, x) for x in FEEDBACK_LABELS], "label string, descriptor string")
    c = T.classify_by_descriptors(docs, "doc_id", "text", desc)
    return c.select("doc_id", "label", F.round("score", 3).alias("score"))


@register("t1b_word_document_frequency", rf"""
SELECT token, COUNT(DISTINCT doc_id) AS df
FROM (SELECT doc_id, unnest({TOK.format(c='text')}) AS token FROM documents) GROUP BY token""")
def t1b(spark, d):
    """Document frequency of every word over whole documents: a document's words are made distinct before they are
    exploded (``doc_id`` is the key), so only partial counts per word are shuffled."""
    docs = Tables(spark, d).documents.where("doc_id is not null")
    arr = F.regexp_extract_all(F.lower("text"), F.lit(T.TOKEN_PATTERN), 0)
    return spread(docs.select("text")).select(F.explode(F.array_distinct(arr)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


@register("t6_t7_summary_translated", rf"""
WITH g(src, dst, word, target) AS (VALUES {_sql_values(GLOSSARY)}),
s AS (SELECT doc_id, trim(unnest({SENT.format(c='text')})) AS sentence,
             generate_subscripts({SENT.format(c='text')}, 1) - 1 AS spos FROM documents WHERE lang = 'en'),
s2 AS (SELECT * FROM s WHERE sentence <> ''),
st AS (SELECT doc_id, spos, unnest({TOK.format(c='sentence')}) AS token FROM s2),
dtf AS (SELECT doc_id, token, COUNT(*) AS dtf FROM st GROUP BY ALL),
sc AS (SELECT st.doc_id, st.spos, CAST(SUM(dtf) AS DOUBLE) / COUNT(*) AS score
       FROM st JOIN dtf USING (doc_id, token) GROUP BY ALL),
top AS (SELECT doc_id, spos, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, spos) AS r FROM sc),
summ AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY spos) AS summary
         FROM top JOIN s2 USING (doc_id, spos) WHERE r <= 3 GROUP BY doc_id),
src AS (SELECT doc_id, summary AS text FROM summ),
{translation_ctes('en', 'it', 'it', 'src', 'doc_id')}
SELECT summ.doc_id, summ.summary, it.t AS summary_it FROM summ JOIN it USING (doc_id)""")
def t6_t7(spark, d):
    """T6 then T7 (nested calls): extractive summary of each English text, translated to Italian."""
    docs = Tables(spark, d).documents.where(F.col("lang") == "en")
    summ = T.summarize(docs, "doc_id", "text", 3)
    g = spark.createDataFrame(GLOSSARY, "src string, dst string, word string, target string")
    it = T.translate(summ, "doc_id", "summary", g, "en", "it", "summary_it")
    return summ.join(it, "doc_id").select("doc_id", "summary", "summary_it")
