"""Text functions, tabular and text features, explanations of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline import constants as C
from siftline.functions import scalars as N
from siftline.functions import text as X
from siftline.operators import explain as E
from siftline.operators import features as FT
from siftline.plans import sql_parts as Q
from siftline.plans.catalog import query, r6, rounded
from siftline.sources import views as V


def _docs(spark, sf):
    return V.table(spark, sf, "documents")


# --- cleaning ------------------------------------------------------------------------


@query("strip_html", f"SELECT page_id, {Q.strip_html('html')} AS text FROM pages")
def strip_html(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", X.strip_html("html").alias("text"))


@query("strip_html_exact", f"SELECT page_id, {Q.strip_html('html')} AS text FROM pages")
def strip_html_exact(spark, sf):
    return X.strip_html_exact(V.table(spark, sf, "pages"), "html", "text").select("page_id", "text")


_LINKS = "url || ' and ' || url || chr(10) || 'HTTP://kept.example ' || html"


@query("strip_urls", f"SELECT page_id, {Q.strip_urls(_LINKS)} AS text FROM pages")
def strip_urls(spark, sf):
    pages = V.table(spark, sf, "pages")
    linked = F.concat(
        "url", F.lit(" and "), "url", F.lit("\nHTTP://kept.example "), "html"
    )
    return pages.select("page_id", X.strip_urls(linked).alias("text"))


@query(
    "clean_text",
    f"""SELECT page_id AS id, 'page' AS kind, substr({Q.clean('html')}, 1, {C.MAX_FIELD_CHARS}) AS text FROM pages
    UNION ALL SELECT doc_id, 'document', substr({Q.clean('text')}, 1, {C.MAX_FIELD_CHARS}) FROM documents""",
)
def clean_text(spark, sf):
    """With the optional cut of a field."""
    pages = V.table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), F.lit("page").alias("kind"), X.clean_text("html", max_chars=C.MAX_FIELD_CHARS).alias("text")
    )
    docs = _docs(spark, sf).select(
        F.col("doc_id").alias("id"), F.lit("document").alias("kind"), X.clean_text("text", max_chars=C.MAX_FIELD_CHARS).alias("text")
    )
    return pages.unionByName(docs)


@query("text_all", f"WITH {Q.CLEAN} SELECT doc_id, text_all FROM clean")
def text_all(spark, sf):
    return V.cleaned(spark, sf).select("doc_id", "text_all")


@query("text_hash", f"WITH {Q.CLEAN} SELECT doc_id, sha256(text_all) AS text_hash FROM clean")
def text_hash(spark, sf):
    return V.cleaned(spark, sf).select("doc_id", X.text_hash("text_all").alias("text_hash"))


@query("features_hash")
def features_hash(spark, sf):
    df = V.featured(spark, sf)
    names = list(FT.tabular_columns(V.postings(spark, sf).columns))
    return df.select("doc_id", N.features_hash({n: n for n in names}).alias("features_hash"))


@query("mask_pii", f"SELECT doc_id, {Q.mask('text')} AS masked FROM documents")
def mask_pii(spark, sf):
    return _docs(spark, sf).select("doc_id", X.mask_pii("text").alias("masked"))


@query(
    "sanitize_payload",
    f"""SELECT doc_id, {Q.shorten('masked')} AS text, {Q.shorten('masked_source')} AS source, n_chars
    FROM (SELECT *, {Q.mask('text')} AS masked, {Q.mask('source')} AS masked_source FROM documents)""",
)
def sanitize_payload(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", X.sanitize("text").alias("text"), X.sanitize("source").alias("source"), "n_chars"
    )


@query(
    "payload_json",
    """SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"nothing":null,"type":"'
      || event_type || '","user":' || user_id || '}' AS payload FROM events""",
)
def payload_json(spark, sf):
    """Stored text parsed, then written again with sorted keys and explicit nulls."""
    events = V.table(spark, sf, "events")
    parsed = N.parse_json("props", "k bigint")
    fields = {
        "user": "user_id", "type": "event_type", "k": parsed["k"], "nothing": F.lit(None).cast("string"),
    }
    return events.select("event_id", N.sorted_json(fields).alias("payload"))


@query(
    "coerce_created_at",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-06-01 00:00:00'
      ELSE CAST(ts AS TIMESTAMP) END AS created_at FROM events""",
)
def coerce_created_at(spark, sf):
    raw = F.when(F.col("event_id") % 6 == 0, "not a time").when(F.col("event_id") % 3 > 0, F.col("ts").cast("string"))
    return V.table(spark, sf, "events").select(
        "event_id", N.coerce_time(raw, "2024-06-01 00:00:00").alias("created_at")
    )


_LENIENT = """CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN ' ' || CAST(user_id AS VARCHAR) || ' '
  WHEN 3 THEN CAST(user_id AS VARCHAR) || '.5' END"""


@query(
    "lenient_parse",
    f"SELECT event_id, TRY_CAST(trim({_LENIENT}) AS DOUBLE) AS number FROM events",
)
def lenient_parse(spark, sf):
    raw = F.expr(_LENIENT.replace("VARCHAR", "STRING"))
    return V.table(spark, sf, "events").select("event_id", N.lenient_double(raw).alias("number"))


@query(
    "entropy",
    f"""WITH {Q.PREDICTIONS}
    SELECT request_id, {Q.r6('-(p * log2(p + 1e-9) + (1 - p) * log2(1 - p + 1e-9))')} AS queue_entropy,
      {Q.r6('-(c * log2(c) + (1 - c) * log2(1 - c))')} AS sample_entropy
    FROM (SELECT request_id, probability AS p, greatest(least(probability, 1 - 1e-6), 1e-6) AS c FROM predictions)""",
)
def entropy(spark, sf):
    return rounded(V.predictions(spark, sf).select(
        "request_id", N.queue_entropy("probability").alias("queue_entropy"),
        N.sample_entropy("probability").alias("sample_entropy"),
    ))


@query(
    "sigmoid_logit",
    f"""SELECT event_id, {Q.r6('1.0 / (1.0 + exp(-(value / 100 - 2)))')} AS sigmoid, {Q.r6('ln(p / (1 - p))')} AS logit
    FROM (SELECT *, greatest(least(value / 400, 1 - 1e-6), 1e-6) AS p FROM events)""",
)
def sigmoid_logit(spark, sf):
    return rounded(V.table(spark, sf, "events").select(
        "event_id", N.sigmoid(F.col("value") / 100 - 2).alias("sigmoid"),
        N.logit(F.col("value") / 400).alias("logit"),
    ))


@query(
    "softmax",
    f"""SELECT event_id, {Q.r6('exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b)))')} AS probability
    FROM (SELECT event_id, value / 50 - 3 AS a, (user_id % 7) / 2.0 AS b FROM events)""",
)
def softmax(spark, sf):
    logits = F.array(F.col("value") / 50 - 3, (F.col("user_id") % 7) / 2.0)
    return rounded(V.table(spark, sf, "events").select("event_id", N.softmax_last(logits).alias("probability")))


@query("config_key")
def config_key(spark, sf):
    """Run keys of the event settings; equal settings have equal keys."""
    events = V.table(spark, sf, "events")
    settings = N.sorted_json({"type": "event_type", "k": N.parse_json("props", "k bigint")["k"]})
    return events.select("event_id", N.config_key(settings).alias("config_key"))


@query(
    "tokens",
    f"""SELECT doc_id, token, count(*) AS n FROM (
      SELECT doc_id, unnest(string_split_regex(text, '{C.WS}+')) AS token FROM documents)
    WHERE token <> '' GROUP BY doc_id, token""",
)
def tokens(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.explode(X.split_tokens("text")).alias("token"))
    return rows.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


_VERDICTS = """CASE conv_id % 5
  WHEN 0 THEN '{"is_job_posting": true, "confidence": ' || CAST(turn AS VARCHAR) || '.25, "reason": " r "}'
  WHEN 1 THEN 'Sure:' || chr(10) || '```json' || chr(10) || 'x' || chr(10) || '```' || chr(10) || '``` {"is_job_posting": "yes", "confidence": "0.5"} ``` bye'
  WHEN 2 THEN 'Answer {"is_job_posting": "no", "confidence": null} end'
  WHEN 3 THEN 'no object here'
  ELSE '{"is_job_posting": tru' END"""


@query(
    "extract_verdict_json",
    """SELECT conv_id, turn,
      CASE conv_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false END AS is_job_posting,
      CASE conv_id % 5 WHEN 0 THEN turn + 0.25 WHEN 1 THEN 0.5 END::DOUBLE AS confidence,
      CASE WHEN conv_id % 5 = 0 THEN ' r ' END AS reason FROM conversations""",
)
def extract_verdict_json(spark, sf):
    """Answers of every shape, built per chat turn, read back into fields."""
    raw = F.expr(_VERDICTS.replace("VARCHAR", "STRING"))
    v = V.table(spark, sf, "conversations").select("conv_id", "turn", N.extract_verdict(raw).alias("v"))
    return v.select("conv_id", "turn", "v.is_job_posting", "v.confidence", "v.reason")


_KEYWORDS = (*C.POSTING_KEYWORDS, "tion", "the ")


@query(
    "detect_posting",
    "SELECT conv_id, turn, (" + " OR ".join(f"contains(lower(text), {Q.quote(k)})" for k in C.POSTING_KEYWORDS)
    + ") AND length(text) > 200 AS is_posting, ("
    + " OR ".join(f"contains(lower(text), {Q.quote(k)})" for k in _KEYWORDS)
    + ") AND length(text) > 200 AS is_long_prose FROM conversations",
)
def detect_posting(spark, sf):
    return V.table(spark, sf, "conversations").select(
        "conv_id", "turn", X.looks_like_posting("text").alias("is_posting"),
        X.looks_like_posting("text", _KEYWORDS).alias("is_long_prose"),
    )


# --- tabular features ------------------------------------------------------------------

_RAW_FEATURES = Q.features_sql(Q.FEATURES).replace("text_all", "text")


@query(
    "tabular_features",
    f"""WITH {Q.FEATURED}
    SELECT doc_id, 'clean' AS kind, {', '.join(f'round({n}, 6) AS {n}' for n in Q.FEATURES)} FROM featured
    UNION ALL SELECT doc_id, 'raw', {', '.join(f'round({n}, 6)' for n in Q.FEATURES)}
    FROM (SELECT doc_id, {_RAW_FEATURES} FROM documents)""",
)
def tabular_features(spark, sf):
    """Features of the cleaned text, and of the raw text where case still counts."""
    clean = V.featured(spark, sf).select("doc_id", F.lit("clean").alias("kind"), *Q.FEATURES)
    raw = FT.tabular_features(_docs(spark, sf), text="text", terms=())
    raw = raw.select("doc_id", F.lit("raw").alias("kind"), *Q.FEATURES)
    return rounded(clean.unionByName(raw))


_TERM_SQL = Q.term_features(V.VIEW_PHRASES)


@query(
    "scam_term_counts",
    f"WITH {Q.CLEAN} SELECT doc_id, {Q.features_sql(_TERM_SQL)} FROM clean",
)
def scam_term_counts(spark, sf):
    df = FT.tabular_features(V.cleaned(spark, sf), terms=V.VIEW_PHRASES)
    return df.select("doc_id", *_TERM_SQL)


@query(
    "binary_flags",
    f"""WITH {Q.POSTINGS}
    SELECT doc_id, coalesce(TRY_CAST(telecommuting AS DOUBLE), 0.0) AS telecommuting,
      CAST(has_company_logo AS DOUBLE) AS has_company_logo, CAST(has_questions AS DOUBLE) AS has_questions FROM postings""",
)
def binary_flags(spark, sf):
    df = V.postings(spark, sf)
    return FT.tabular_features(df, text="title").select("doc_id", *C.FLAG_FIELDS)


def _q(name: str) -> str:
    return f'"{name}"'


@query(
    "missing_flags",
    f"""WITH {Q.POSTINGS}
    SELECT doc_id, {', '.join(
        f"CASE WHEN {_q(c)} IS NULL OR lower({_q(c)}) = '<missing>' THEN 1.0 ELSE 0.0 END::DOUBLE AS {c}_is_missing" for c in C.CATEGORY_FIELDS)}
    FROM postings""",
)
def missing_flags(spark, sf):
    df = FT.tabular_features(V.postings(spark, sf), text="title")
    return df.select("doc_id", *[f"{c}_is_missing" for c in C.CATEGORY_FIELDS])


_STD = ("text_length", "digit_count", "exclamation_count", "currency_token_count")


@query(
    "standardize",
    f"""WITH {Q.FEATURED}, m AS (SELECT {', '.join(
        f'avg({n}) AS m_{n}, CASE WHEN stddev_pop({n}) = 0 THEN 1.0 ELSE stddev_pop({n}) END AS s_{n}' for n in _STD)}
      FROM featured WHERE doc_id % 2 = 0)
    SELECT doc_id, {', '.join(f'{Q.r6(f"({n} - m_{n}) / s_{n}")} AS {n}' for n in _STD)} FROM featured, m""",
)
def standardize(spark, sf):
    """Moments of the even documents, applied to all."""
    df = V.featured(spark, sf).select("doc_id", *_STD)
    return rounded(FT.standardize(df, _STD, fit=df.filter("doc_id % 2 = 0")))


# --- text features ---------------------------------------------------------------------


@query(
    "word_tokens",
    f"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '{C.WORD_PATTERN}'), ' ') AS words FROM documents",
)
def word_tokens(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(X.word_tokens("text"), " ").alias("words"))


@query("ngrams", f"WITH {Q.grams('documents', 'text')} SELECT doc_id, term, tf FROM tf")
def ngrams(spark, sf):
    rows = FT.ngram_rows(_docs(spark, sf), "text", "doc_id")
    return rows.withColumn("tf", F.col("tf").cast("bigint"))


_VOCAB = f"""{Q.grams('documents', 'text')},
vocab AS (
  SELECT term, df, cf, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM (
    SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term), (SELECT count(*) AS n FROM documents)
  WHERE df >= 3 AND df <= 0.9 * n ORDER BY cf DESC, term LIMIT 100000)"""
_TFIDF = f"""{_VOCAB},
weighed AS (SELECT doc_id, term, (1.0 + ln(tf)) * idf AS w FROM tf JOIN vocab USING (term)),
weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM weighed)"""


def _vocab(spark, sf):
    docs = _docs(spark, sf)
    return FT.vocabulary(FT.ngram_rows(docs, "text", "doc_id"), docs)


def _weights(spark, sf):
    return FT.tfidf(_docs(spark, sf), "text", "doc_id", _vocab(spark, sf))


@query("vocabulary", f"WITH {_VOCAB} SELECT term, df, cf, round(idf, 6) AS idf FROM vocab")
def vocabulary(spark, sf):
    return rounded(_vocab(spark, sf))


@query("tfidf_weights", f"WITH {_TFIDF} SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def tfidf_weights(spark, sf):
    return rounded(_weights(spark, sf).select("doc_id", "term", "weight"))


@query(
    "tfidf_top_sum",
    f"""WITH {_TFIDF}
    SELECT term, round(tfidf_sum, 6) AS tfidf_sum FROM (SELECT term, sum(weight) AS tfidf_sum FROM weights GROUP BY term)
    ORDER BY round(tfidf_sum, 9) DESC, term LIMIT 20""",
)
def tfidf_top_sum(spark, sf):
    return rounded(FT.tfidf_top_terms(_weights(spark, sf)))


# --- linear score and explanations -------------------------------------------------------


@query("linear_score", f"WITH {Q.SCORED} SELECT doc_id, probability FROM scored")
def linear_score(spark, sf):
    return V.scored(spark, sf).select("doc_id", "probability")


_CONTRIBUTIONS = f"""{Q.SCORED},
parts AS (
  SELECT doc_id, term AS feature, 'token' AS source, (1.0 + ln(tf)) * idf / sqrt(sq) * coef AS contribution
  FROM tf_scored JOIN coef_scored USING (term) JOIN sums_scored USING (doc_id)
  UNION ALL
  """ + " UNION ALL ".join(
    f"SELECT doc_id, '{n}', 'tabular', {c!r} * (({n} - {m!r}) / {s!r}) FROM featured"
    for n, (m, s, c) in V.MODEL_TABULAR.items()
) + """),
ranked AS (
  SELECT *, CASE WHEN contribution > 0 THEN 'positive' ELSE 'negative' END AS sign,
    row_number() OVER (PARTITION BY doc_id, contribution > 0 ORDER BY round(abs(contribution), 9) DESC, feature, source) AS rank
  FROM parts WHERE contribution <> 0),
named AS (
  SELECT doc_id, sign, list(replace(feature, '_', ' ') ORDER BY rank) AS f FROM ranked WHERE rank <= 3 GROUP BY ALL),
clauses AS (
  SELECT doc_id, sign, CASE WHEN len(f) <= 2 THEN array_to_string(f, ' and ')
    ELSE array_to_string(f[1:len(f) - 1], ', ') || ', and ' || f[len(f)] END AS s FROM named),
sentences AS (
  SELECT doc_id, array_to_string(list(upper(left(s, 1)) || lower(substr(s, 2)) ||
    CASE sign WHEN 'positive' THEN ' pushed the score toward fraud' ELSE ' reinforced the legit decision' END
    ORDER BY sign DESC), '; ') || '.' AS summary FROM clauses GROUP BY doc_id)"""


def _contributions(spark, sf):
    return E.contribution_rows(V.featured(spark, sf), "text_all", "doc_id", V.model(spark))


@query(
    "contributions",
    f"""WITH {_CONTRIBUTIONS}
    SELECT doc_id, sign, CAST(rank AS INTEGER) AS rank, feature, source, {Q.r6('contribution')} AS contribution FROM ranked WHERE rank <= 5""",
)
def contributions(spark, sf):
    return rounded(E.top_contributions(_contributions(spark, sf), "doc_id"))


@query(
    "explanation_summary",
    f"""WITH {_CONTRIBUTIONS}
    SELECT doc_id, coalesce(summary, 'No strong drivers were found for this decision.') AS summary
    FROM featured LEFT JOIN sentences USING (doc_id)""",
)
def explanation_summary(spark, sf):
    explained = E.explanations(_contributions(spark, sf), "doc_id", V.MODEL_INTERCEPT)
    ids = _docs(spark, sf).select("doc_id")
    return E.with_explanations(ids, explained, "doc_id").select("doc_id", "summary")


# Coefficients learnt from the labels: log odds of a term among toxic documents.
_ODDS = f"""{Q.grams('labelled_docs', 'text')},
odds AS (
  SELECT term, round(ln((count(*) FILTER (WHERE toxic = 1) + 1.0) / (count(*) FILTER (WHERE toxic = 0) + 1.0)), 6) AS coef
  FROM tf JOIN labelled_docs USING (doc_id) GROUP BY term HAVING count(*) >= 3)"""


def _odds(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "text").join(V.labels(spark, sf), "doc_id")
    rows = FT.explode_terms(FT.term_counts(docs, "text", ["doc_id", "fraudulent"]), ["doc_id", "fraudulent"])
    counts = rows.groupBy("term").agg(
        F.count_if(F.col("fraudulent") == 1).alias("p"), F.count_if(F.col("fraudulent") == 0).alias("n")
    ).filter("p + n >= 3")
    return counts.select("term", r6(F.log((F.col("p") + 1.0) / (F.col("n") + 1.0))).alias("coef"))


@query(
    "top_terms",
    f"""WITH labelled_docs AS (SELECT doc_id, text, toxic FROM documents JOIN labels USING (doc_id)),{_ODDS}
    SELECT 'positive' AS sign, CAST(row_number() OVER (ORDER BY coef DESC, term) AS INTEGER) AS rank, term, coef AS weight
    FROM (SELECT * FROM odds ORDER BY coef DESC, term LIMIT 25)
    UNION ALL SELECT 'negative', CAST(row_number() OVER (ORDER BY coef, term) AS INTEGER), term, coef
    FROM (SELECT * FROM odds ORDER BY coef, term LIMIT 25)""",
)
def top_terms(spark, sf):
    return E.top_terms(_odds(spark, sf))


@query(
    "linear_shap",
    f"""WITH {Q.FEATURED}, means AS (SELECT {', '.join(f'avg({n}) AS {n}' for n in V.MODEL_TABULAR)} FROM featured)
    """ + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, round(avg(abs({c!r} * (f.{n} - m.{n}))), 6) AS mean_abs_shap FROM featured f, means m"
        for n, (_, _, c) in V.MODEL_TABULAR.items()
    ),
)
def linear_shap(spark, sf):
    coefs = {n: c for n, (_, _, c) in V.MODEL_TABULAR.items()}
    return rounded(E.linear_shap(V.featured(spark, sf).select(*coefs), coefs)).orderBy(F.desc("mean_abs_shap"))


@query(
    "linear_shap_terms",
    f"""WITH {Q.SCORED},
    w AS (SELECT doc_id, term, coef, (1.0 + ln(tf)) * idf / sqrt(sq) AS weight
      FROM tf_scored JOIN coef_scored USING (term) JOIN sums_scored USING (doc_id)),
    grid AS (SELECT d.doc_id, c.term, c.coef, coalesce(w.weight, 0.0) AS weight
      FROM (SELECT doc_id FROM documents) d CROSS JOIN coef_scored c LEFT JOIN w ON w.doc_id = d.doc_id AND w.term = c.term),
    means AS (SELECT term, avg(weight) AS mean FROM grid GROUP BY term)
    SELECT grid.term AS feature, round(avg(abs(coef * (weight - mean))), 6) AS mean_abs_shap
    FROM grid JOIN means USING (term) GROUP BY grid.term HAVING max(weight) > 0""",
)
def linear_shap_terms(spark, sf):
    model = V.model(spark)
    docs = V.cleaned(spark, sf)
    weights = FT.tfidf(docs, "text_all", "doc_id", model.terms, only=model.only())
    return rounded(E.linear_shap_terms(weights, docs))


@query(
    "token_frequency",
    f"""WITH {Q.SCORED},
    t AS (SELECT token, count(*) FILTER (WHERE probability >= 0.5) AS p, count(*) FILTER (WHERE probability < 0.5) AS n FROM (
      SELECT probability, unnest(string_split_regex(text_all, '{C.WS}+')) AS token FROM clean JOIN scored USING (doc_id))
      WHERE token <> '' GROUP BY token)
    SELECT token, p AS positive_count, n AS negative_count, p - n AS difference FROM (
      (SELECT * FROM t WHERE p > 0 ORDER BY p DESC, token LIMIT 30)
      UNION (SELECT * FROM t WHERE n > 0 ORDER BY n DESC, token LIMIT 30))""",
)
def token_frequency(spark, sf):
    df = V.scored_text(spark, sf)
    return E.token_frequency(df, "text_all", "probability", V.THRESHOLD).orderBy(F.desc("difference"), "token")


@query("local_surrogate")
def local_surrogate(spark, sf):
    return E.local_surrogate(V.featured(spark, sf), "text_all", "doc_id", V.model(spark))


_PIECES = """
tokens0 AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]{2,}')) AS word,
    generate_subscripts(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]{2,}'), 1) AS place FROM documents)"""


@query(
    "merge_subwords",
    f"""WITH {_PIECES}
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS word_no, word AS feature,
      CASE WHEN length(word) > 4 THEN {Q.r6('length(word) / 100.0')} ELSE {Q.r6('length(word) / 100.0')} END AS contribution
    FROM tokens0 WHERE word <> 'the'""",
)
def merge_subwords(spark, sf):
    """Words cut into four-letter pieces, `##` on continuations, put together again."""
    words = _docs(spark, sf).select("doc_id", F.posexplode(X.word_tokens("text")).alias("w", "word"))
    cuts = F.transform(
        F.sequence(F.lit(1), F.length("word"), F.lit(4)),
        lambda at: F.concat(F.when(at > 1, "##").otherwise(""), F.substring("word", at, F.lit(4))),
    )
    whole = F.when(F.col("word") == "the", F.array(F.lit("[CLS]"))).otherwise(cuts)
    pieces = words.select("doc_id", "w", F.posexplode(whole).alias("p", "piece"))
    chars = F.length(F.regexp_replace("piece", "^##", "")) / 100.0
    pieces = pieces.select("doc_id", F.struct("w", "p").alias("position"), "piece", chars.alias("score"))
    return rounded(E.merge_subwords(pieces, "doc_id", "position", "piece", "score", special=["[CLS]"]))
