"""SQL of the canonical views, for checking queries with another engine."""

from __future__ import annotations

from siftline import constants as C
from siftline.sources import views as V

_BREAK = "\u0001"
_HIDDEN = (
    r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
    r"|<template\b.*?</template\s*>|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</?[A-Za-z][^>]*>"
)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def r6(x: str) -> str:
    """Six decimals, without a negative zero."""
    return f"(CASE WHEN abs({x}) < 0.0000005 THEN 0.0 ELSE round({x}, 6) END)"


def ratio(top: str, bottom: str) -> str:
    return f"(CASE WHEN ({bottom}) = 0 THEN 0.0 ELSE CAST({top} AS DOUBLE) / ({bottom}) END)"


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{C.WS}+|{C.WS}+$', '', 'g')"


def strip_html(x: str) -> str:
    body = f"regexp_replace({x}, '{_HIDDEN}', '{_BREAK}', 'g')"
    for name, char in C.HTML_ENTITIES.items():
        body = f"replace({body}, '&{name};', {quote(char)})"
    around = f"{C.WS}*{_BREAK}[{_BREAK}{C.WS[1:-1]}]*"
    return trim_ws(f"regexp_replace({body}, '{around}', ' ', 'g')")


def strip_urls(x: str) -> str:
    return f"regexp_replace({x}, 'https?://{C.NOT_WS}+', ' ', 'g')"


def clean(x: str) -> str:
    body = f"lower({strip_urls(strip_html(x))})"
    return trim_ws(f"regexp_replace({body}, {quote(C.WS + chr(43))}, {quote(chr(32))}, {quote(chr(103))})")


def mask(x: str) -> str:
    inner = f"regexp_replace({x}, '{C.EMAIL_PATTERN}', '{C.EMAIL_MASK}', 'g')"
    return f"regexp_replace({inner}, '{C.PHONE_PATTERN}', '{C.PHONE_MASK}', 'g')"


def shorten(x: str) -> str:
    return f"CASE WHEN length({x}) > 800 THEN substr({x}, 1, 797) || '...' ELSE {x} END"


POSTINGS = """
postings AS (
  SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS description, lang, source,
    CASE WHEN doc_id % 5 = 0 THEN '<missing>' WHEN doc_id % 7 = 0 THEN 'x'
         ELSE CAST(doc_id % 2 AS VARCHAR) END AS telecommuting,
    CAST(doc_id % 2 AS INTEGER) AS has_company_logo,
    CAST(contains(text, '?') AS INTEGER) AS has_questions,
    lang AS employment_type,
    CASE WHEN doc_id % 3 = 1 THEN '<missing>' WHEN doc_id % 3 = 2 THEN 'Not Mentioned' END
      AS required_experience,
    CASE WHEN doc_id % 4 = 1 THEN '<missing>' WHEN doc_id % 4 = 2 THEN 'degree' END AS required_education,
    source AS industry, 'f' || CAST(doc_id % 4 AS VARCHAR) AS "function"
  FROM documents)"""

CLEAN = f"""{POSTINGS},
clean0 AS (
  SELECT postings.* REPLACE ({clean('title')} AS title, {clean('description')} AS description)
  FROM postings),
clean AS (
  SELECT clean0.*, CASE WHEN t <> '' AND d <> '' THEN t || chr(10) || chr(10) || d ELSE t || d END
    AS text_all
  FROM (SELECT clean0.*, {trim_ws('title')} AS t, {trim_ws('description')} AS d FROM clean0) clean0)"""


def _count(x: str, word: str) -> str:
    w = quote(word)
    return f"CAST((length({x}) - length(replace({x}, {w}, ''))) // {len(word)} AS DOUBLE)"


def _class(x: str, chars: str) -> str:
    return f"length(regexp_replace({x}, '[^{chars}]+', '', 'g'))"


FEATURES = {
    "text_length": "CAST(length(text_all) AS DOUBLE)",
    "uppercase_ratio": "CASE WHEN length(text_all) = 0 THEN 0.0 ELSE "
    + f"CAST({_class('text_all', chr(92) + 'p{Lu}')} AS DOUBLE) / length(text_all) END",
    "digit_count": f"CAST({_class('text_all', chr(92) + 'p{Nd}')} AS DOUBLE)",
    "currency_token_count": f"CAST({_class('text_all', '$€£')} AS DOUBLE)",
    "exclamation_count": _count("text_all", "!"),
    "question_count": _count("text_all", "?"),
    "url_count": f"{_count('text_all', 'http://')} + {_count('text_all', 'https://')}",
}


def term_features(terms) -> dict[str, str]:
    return {f"scam_term_{t.replace(' ', '_')}": _count("lower(text_all)", t) for t in terms}


def features_sql(names: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in names.items())


FEATURED = f"{CLEAN}, featured AS (SELECT clean.*, {features_sql(FEATURES)} FROM clean)"


def grams(source: str, text: str = "text_all", key: str = "doc_id", only: str | None = None) -> str:
    """CTEs `words` and `tf` (key, term, tf) with unigrams and bigrams of a table."""
    where = f"WHERE term IN (SELECT term FROM {only})" if only else ""
    return f"""
words AS (
  SELECT {key}, regexp_extract_all(lower({text}), '{C.WORD_PATTERN}') AS w FROM {source}),
tf AS (
  SELECT {key}, term, count(*) AS tf FROM (
    SELECT {key}, unnest(w) AS term FROM words
    UNION ALL
    SELECT {key}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
  ) {where} GROUP BY {key}, term)"""


def values(rows) -> str:
    return ", ".join(
        "(" + ", ".join(quote(v) if isinstance(v, str) else repr(v) for v in row) + ")" for row in rows
    )


def _scored(name: str, terms, intercept: float, column: str = "probability") -> str:
    tab = " + ".join(
        f"({coef!r} * (({f} - {mean!r}) / {scale!r}))" for f, (mean, scale, coef) in V.MODEL_TABULAR.items()
    )
    tfs = grams("featured", only=f"coef_{name}").replace("words AS", f"words_{name} AS").replace(
        "FROM words", f"FROM words_{name}").replace("tf AS (", f"tf_{name} AS (")
    return f"""
coef_{name}(term, idf, coef) AS (VALUES {values(terms)}),{tfs},
sums_{name} AS (
  SELECT doc_id, sum(w * coef) AS dot, sum(w * w) AS sq FROM (
    SELECT doc_id, (1.0 + ln(tf)) * idf AS w, coef FROM tf_{name} JOIN coef_{name} USING (term)) GROUP BY doc_id),
{name} AS (
  SELECT f.doc_id, f.lang, f.source, f.employment_type, f.required_experience, f.required_education, f.industry, f."function", f.text_length,
    round(1.0 / (1.0 + exp(-({intercept!r} + coalesce(dot / sqrt(sq), 0.0) + ({tab})))), 6) AS {column}
  FROM featured f LEFT JOIN sums_{name} s ON f.doc_id = s.doc_id)"""


SCORED = FEATURED + "," + _scored("scored", V.MODEL_TERMS, V.MODEL_INTERCEPT)
LABELLED = f"""{SCORED},
labelled AS (
  SELECT scored.*, toxic AS fraudulent, quality FROM scored JOIN labels USING (doc_id))"""
SPLIT_RUNS = f"""{LABELLED},{_scored("second", V.SHADOW_TERMS, V.SHADOW_INTERCEPT, "shadow")},
split_runs AS (
  SELECT labelled.*, second.shadow, CASE WHEN doc_id % 2 = 0 THEN 'validation' ELSE 'test' END AS split
  FROM labelled JOIN second USING (doc_id))"""

PREDICTIONS = """
predictions AS (
  SELECT CAST(event_id AS VARCHAR) AS request_id, CAST(ts AS TIMESTAMP) AS created_at,
    event_type AS model_version, p AS probability,
    CASE WHEN p >= 0.55 THEN 'fraud' WHEN p <= 0.45 THEN 'legit' ELSE 'review' END AS predicted_label,
    CAST(0.5 AS DOUBLE) AS threshold, sha256(CAST(user_id AS VARCHAR)) AS text_hash, props AS payload
  FROM (SELECT *, round(value / (value + 50), 6) AS p FROM events))"""

FEEDBACK = """
feedback AS (
  SELECT CAST(event_id AS VARCHAR) AS request_id,
    CASE user_id % 3 WHEN 0 THEN 'fraud' WHEN 1 THEN 'legit' ELSE 'unsure' END AS reviewer_label,
    sha256(CAST(user_id AS VARCHAR)) AS text_hash,
    CAST(ts AS TIMESTAMP) + INTERVAL 1 HOUR AS created_at,
    'mail u' || user_id || '@x.org or 555-0' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || '-12345'
      AS rationale,
    props AS notes
  FROM events WHERE event_id % 5 = 0)"""

#: All events answered.
ANSWERS = FEEDBACK.replace(" WHERE event_id % 5 = 0", "")

ACTIVE = """
active AS (
  SELECT * EXCLUDE (created_at) FROM predictions WHERE CAST(request_id AS BIGINT) % 97 = 0
  UNION ALL
  SELECT * EXCLUDE (created_at) REPLACE ('-' || request_id || 'x' AS request_id) FROM predictions
  WHERE CAST(request_id AS BIGINT) % 97 = 0)"""

LOGS = f"{PREDICTIONS},{FEEDBACK},{ACTIVE}"
PENDING = f"""{LOGS},
pending AS (SELECT * FROM predictions WHERE request_id NOT IN (SELECT request_id FROM feedback)),
pending_active AS (SELECT * FROM active WHERE request_id NOT IN (SELECT request_id FROM feedback))"""

RUNS = """
runs AS (
  SELECT o_orderkey AS "position", o_orderpriority AS model_name, o_orderstatus AS config_hash,
    CASE WHEN o_orderkey % 11 > 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS "timestamp",
    o_totalprice / 1000000 AS test_f1,
    CASE WHEN o_orderkey % 13 > 0 THEN o_totalprice / 900000 END AS val_f1,
    CASE WHEN o_custkey % 2 = 0 THEN 'platt' ELSE 'isotonic' END AS calibration_method,
    CAST(0.5 AS DOUBLE) AS threshold
  FROM orders)"""


def cumulative(source: str, label: str, score: str, by: str = "") -> str:
    """CTE `cum`: distinct scores with class counts, running counts and totals."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""
counts AS (
  SELECT {keys}{score} AS score, count(*) FILTER (WHERE {label} = 1) AS pos,
    count(*) FILTER (WHERE {label} = 0) AS neg FROM {source} GROUP BY {keys}{score}),
cum AS (
  SELECT *, sum(pos) OVER ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_pos,
    sum(neg) OVER ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_neg,
    sum(pos) OVER ({part}) AS all_pos, sum(neg) OVER ({part}) AS all_neg FROM counts)"""


def prf(tp: str, predicted: str, actual: str) -> str:
    return (
        f"{r6(ratio(tp, predicted))} AS precision, {r6(ratio(tp, actual))} AS recall, "
        f"{r6(ratio(f'2 * {tp}', f'{predicted} + {actual}'))} AS f1"
    )


AUC = "sum(CAST(neg AS DOUBLE) * (cum_pos - pos + pos / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg))"
AP = "sum(pos * (CAST(cum_pos AS DOUBLE) / (cum_pos + cum_neg))) / sum(pos)"
BRIER = "sum(pos * (score - 1) * (score - 1) + neg * score * score) / sum(pos + neg)"


def metrics(threshold: str, by: str = "") -> str:
    """Select list over `cum` for all metrics."""
    keys = f"{by}, " if by else ""
    tp = f"coalesce(sum(pos) FILTER (WHERE score >= {threshold}), 0)"
    fp = f"coalesce(sum(neg) FILTER (WHERE score >= {threshold}), 0)"
    one = "(sum(pos) = 0 OR sum(neg) = 0)"
    return (
        f"{keys}CAST(sum(pos + neg) AS BIGINT) AS count, {prf(tp, f'({tp} + {fp})', 'sum(pos)')}, "
        f"CASE WHEN {one} THEN NULL ELSE {r6(AUC)} END AS roc_auc, "
        f"CASE WHEN {one} THEN 0.0 ELSE {r6(AP)} END AS pr_auc, {r6(BRIER)} AS brier"
    )
