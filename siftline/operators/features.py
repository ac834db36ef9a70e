"""Tabular and text features, and the linear score over both.

Text features stay in long form `(id, term, tf)`. Term counts are taken inside each row
(sorted tokens, run lengths), so counting words never shuffles text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import constants as C
from siftline.functions import text as X
from siftline.functions.scalars import lenient_double, sigmoid
from siftline.session import small_or_shuffle

# In-row filters with a literal word set are used up to this many words.
LITERAL_WORDS = 2000
# Models of up to this many words are one literal and scored inside the row; larger ones are
# joined. Either way gives the same score.
ROW_WORDS = 256
# Blocks of a term table that is probed inside the row: a few terms each at `MAX_VOCABULARY`.
TERM_BLOCKS = 1 << 15


# --- tabular ---------------------------------------------------------------------


def literal_count(x: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal text."""
    return (F.length(x) - F.length(F.replace(x, F.lit(literal), F.lit("")))) / len(literal)


def class_count(x: Column, chars: str) -> Column:
    """Characters of a class."""
    return F.length(F.regexp_replace(x, f"[^{chars}]+", ""))


def term_name(term: str) -> str:
    return f"scam_term_{term.replace(' ', '_')}"


def tabular_columns(
    columns: Sequence[str],
    text: str = "text_all",
    terms: Sequence[str] = C.SCAM_TERMS,
    raw_text: str | None = None,
) -> dict[str, Column]:
    """Feature name to expression, in model order, for the columns a frame has.

    Text is lower-cased before features by default, which leaves the upper-case share at
    zero; `raw_text` names an uncleaned column to take case and URLs from instead.
    """
    x = F.coalesce(F.col(text), F.lit(""))
    raw = F.coalesce(F.col(raw_text), F.lit("")) if raw_text else x
    low = F.lower(x)
    out: dict[str, Column] = {
        "text_length": F.length(x),
        "uppercase_ratio": F.when(F.length(raw) == 0, 0.0).otherwise(
            class_count(raw, r"\p{Lu}") / F.length(raw)
        ),
        "digit_count": class_count(x, r"\p{Nd}"),
        "currency_token_count": class_count(x, "$€£"),
        "exclamation_count": literal_count(x, "!"),
        "question_count": literal_count(x, "?"),
        "url_count": literal_count(raw, "http://") + literal_count(raw, "https://"),
    }
    out |= {term_name(t): literal_count(low, t.lower()) for t in terms}
    out |= {c: F.coalesce(lenient_double(c), F.lit(0.0)) for c in C.FLAG_FIELDS if c in columns}
    out |= {
        f"{c}_is_missing": F.coalesce(F.lower(F.col(c)) == C.MISSING, F.lit(True)).cast("int")
        for c in C.CATEGORY_FIELDS
        if c in columns
    }
    return {name: c.cast("double") for name, c in out.items()}


def tabular_features(df: DataFrame, **options) -> DataFrame:
    """The frame with every tabular feature as a double column, in one projection."""
    return df.withColumns(tabular_columns(df.columns, **options))


def standardize(df: DataFrame, names: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """Centre and scale by the moments of `fit` (population deviation, zero -> 1).

    The moments are one row, read as a scalar subquery.
    """
    fit = df if fit is None else fit
    moments = fit.agg(
        F.struct(
            *[F.avg(n).alias(f"m_{n}") for n in names],
            *[F.stddev_pop(n).alias(f"s_{n}") for n in names],
        )
    ).scalar()
    scaled = {
        n: (F.col(n) - moments[f"m_{n}"])
        / F.when(moments[f"s_{n}"] == 0, 1.0).otherwise(moments[f"s_{n}"])
        for n in names
    }
    return df.withColumns(scaled)


# --- text ------------------------------------------------------------------------


def term_counts(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    ngrams: Sequence[int] = C.NGRAM_RANGE,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """`keep` columns and `terms`: array of (term, tf) per row, without a shuffle.

    Tokens are sorted inside the row and read off as runs. `only` keeps a small literal
    set of terms and drops the rest before the sort.
    """
    grams = [F.col("_words")] if 1 in range(ngrams[0], ngrams[1] + 1) else []
    if ngrams[1] > 1:
        grams.append(X.bigrams("_words"))
    tokens = df.select(*keep, X.word_tokens(text).alias("_words"))
    tokens = tokens.select(*keep, F.concat(*grams).alias("_all"))
    if only is not None:
        tokens = tokens.select(*keep, F.filter("_all", lambda t: t.isin(*only)).alias("_all"))
    # each step is a column of its own: an expression inlined into a lambda would be
    # evaluated once per element
    ordered = tokens.select(*keep, F.sort_array("_all").alias("_s"))
    n = F.size("_s")
    ends = F.filter(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: (i == n) | (F.get("_s", i - 1) != F.get("_s", i)),
    )
    runs = ordered.select(*keep, "_s", ends.alias("_ends"))
    terms = F.transform(
        "_ends",
        lambda end, i: F.struct(
            F.get("_s", end - 1).alias("term"),
            (end - F.when(i == 0, 0).otherwise(F.get("_ends", i - 1))).alias("tf"),
        ),
    )
    return runs.select(*keep, terms.alias("terms"))


def explode_terms(counted: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per (row, term). `explode_outer`, since `explode` infers a filter on the
    array that would be pushed down and evaluate the counting a second time."""
    rows = counted.select(*keep, F.explode_outer("terms").alias("_t"))
    return rows.select(*keep, "_t.term", "_t.tf").filter(F.col("term").isNotNull())


def ngram_rows(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, term, tf) for every unigram and bigram."""
    return explode_terms(term_counts(df, text, [key]), [key])


def vocabulary(
    terms: DataFrame,
    documents: DataFrame,
    min_df: int = C.MIN_DF,
    max_df: float = C.MAX_DF,
    max_terms: int = C.MAX_VOCABULARY,
) -> DataFrame:
    """(term, df, cf, idf): frequent enough, not too common, top by corpus frequency.

    The result has at most `max_terms` rows, which is what makes it safe to broadcast.
    """
    n = documents.agg(F.count("*")).scalar()
    stats = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    kept = stats.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n))
    top = kept.orderBy(F.col("cf").desc(), "term").limit(max_terms)
    return top.withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)


def raw_weight() -> Column:
    return (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")


def _block(term: str | Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BLOCKS)).cast("int")


def term_blocks(table: DataFrame, values: Sequence[str]) -> Column:
    """A table of distinct terms as one value: for every block of term hashes, in order, a map
    from its terms to a struct of `values`.

    It is read as a scalar subquery, so the table must have a proven size
    (`C.MAX_VOCABULARY` rows at most). A lookup reads one block of a few terms.
    """
    cell = F.struct(F.col("term"), F.struct(*values))
    blocks = table.groupBy(_block("term").alias("_b")).agg(F.collect_list(cell).alias("_cells"))
    numbers = table.sparkSession.range(TERM_BLOCKS).select(F.col("id").cast("int").alias("_b"))
    placed = numbers.join(blocks, "_b", "left").agg(
        F.sort_array(F.collect_list(F.struct("_b", "_cells"))).alias("_all")
    )
    return placed.select(F.transform("_all", lambda x: F.map_from_entries(x["_cells"]))).scalar()


def weighed_terms(
    counted: DataFrame, keep: Sequence[str], table: DataFrame, values: Sequence[str]
) -> DataFrame:
    """`keep`, `_weighed`: array of (term, tf, w, entry) of the row's terms that the table
    holds, and `_norm`, the root of the sum of their squared weights; nothing is exchanged.

    `counted` comes from `term_counts`, `values` include `idf`.
    """
    blocks = term_blocks(table, values)
    found = counted.withColumn("_blocks", blocks).select(
        *keep,
        F.transform(
            "terms",
            lambda t: F.struct(
                t["term"].alias("term"),
                t["tf"].alias("tf"),
                F.get(F.col("_blocks"), _block(t["term"]))[t["term"]].alias("entry"),
            ),
        ).alias("_found"),
    )
    known = F.filter("_found", lambda t: t["entry"].isNotNull())
    weighed = F.transform(
        known,
        lambda t: F.struct(
            t["term"].alias("term"),
            t["tf"].alias("tf"),
            ((F.lit(1.0) + F.log(t["tf"].cast("double"))) * t["entry"]["idf"]).alias("w"),
            t["entry"].alias("entry"),
        ),
    )
    rows = found.select(*keep, weighed.alias("_weighed"))
    return rows.select(*keep, "_weighed", F.sqrt(row_norm("_weighed")).alias("_norm"))


def tfidf(
    df: DataFrame,
    text: str,
    key: str,
    vocab: DataFrame,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """(key, term, tf, weight): sublinear tf times idf, rows of unit length.

    Counting, the vocabulary lookup and the norm all happen inside the row, so no text and no
    term is exchanged, and a repeated key is two rows of unit length. `vocab` holds distinct
    terms, at most `C.MAX_VOCABULARY`, as `vocabulary` returns them.
    """
    extra = [c for c in vocab.columns if c != "term"]
    rows = weighed_terms(term_counts(df, text, [key], only=only), [key], vocab, extra)
    long = rows.select(key, "_norm", F.explode_outer("_weighed").alias("_t"))
    return long.filter(F.col("_t").isNotNull()).select(
        key,
        "_t.term",
        "_t.tf",
        (F.col("_t.w") / F.col("_norm")).alias("weight"),
        *[F.col(f"_t.entry.{c}").alias(c) for c in extra],
    )


def tfidf_top_terms(weights: DataFrame, limit: int = 20) -> DataFrame:
    """Terms with the largest summed weight."""
    return (
        weights.groupBy("term")
        .agg(F.sum("weight").alias("tfidf_sum"))
        .orderBy(F.round("tfidf_sum", 9).desc(), "term")
        .limit(limit)
    )


# --- linear model ----------------------------------------------------------------


@dataclass(frozen=True)
class LinearModel:
    """Coefficients over unit-length TF-IDF terms and standardised tabular features.

    `terms` holds (term, idf, coef); `words` and `entries` list them when they are few, else their
    number is counted before they are broadcast. `tabular` maps a feature to (mean, scale,
    coef), in model order.
    """

    terms: DataFrame
    intercept: float
    tabular: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    words: tuple[str, ...] | None = None
    entries: tuple[tuple[str, float, float], ...] | None = None

    def in_row(self) -> bool:
        return self.entries is not None and len(self.entries) <= ROW_WORDS

    def row_weights(self, terms: str | Column) -> Column:
        """Array of (term, w, coef) for the model's words among an array of (term, tf)."""
        words = [F.struct(F.lit(t), F.struct(F.lit(i).alias("idf"), F.lit(c).alias("coef"))) for t, i, c in self.entries]
        table = F.map_from_entries(F.array(*words))  # folded into one constant
        mine = F.filter(terms, lambda t: t["term"].isin(*[t for t, _, _ in self.entries]))
        return F.transform(
            mine,
            lambda t: F.struct(
                t["term"].alias("term"),
                ((F.lit(1.0) + F.log(t["tf"].cast("double"))) * table[t["term"]]["idf"]).alias("w"),
                table[t["term"]]["coef"].alias("coef"),
            ),
        )

    def only(self):
        small = self.words is not None and len(self.words) <= LITERAL_WORDS
        return list(self.words) if small else None

    def bounded(self) -> bool:
        """Whether the model has at most `C.MAX_VOCABULARY` terms, counted where it is not known."""
        if self.words is not None:
            return len(self.words) <= C.MAX_VOCABULARY
        return self.terms.limit(C.MAX_VOCABULARY + 1).count() <= C.MAX_VOCABULARY

    def table(self) -> DataFrame:
        """Terms with idf and coefficient, broadcast once their number is known to be small."""
        terms = self.terms.select("term", "idf", "coef")
        if self.words is not None and len(self.words) <= C.MAX_VOCABULARY:
            return F.broadcast(terms)
        return small_or_shuffle(terms, C.MAX_VOCABULARY)

    def lookup(self, rows: DataFrame, how: str = "inner") -> DataFrame:
        """Rows with the idf and coefficient of their term."""
        return rows.join(self.table(), "term", how)

    def tabular_sum(self) -> Column:
        total = F.lit(0.0)
        for name, (mean, scale, coef) in self.tabular.items():
            total = total + F.lit(coef) * ((F.col(name) - F.lit(mean)) / F.lit(scale))
        return total


def literal_model(spark, terms, intercept, tabular=None) -> LinearModel:
    """Model from Python values: terms is a list of (term, idf, coef)."""
    frame = spark.createDataFrame(terms, "term string, idf double, coef double")
    entries = tuple((t, float(i), float(c)) for t, i, c in terms)
    return LinearModel(frame, intercept, dict(tabular or {}), tuple(t[0] for t in terms), entries)


def row_norm(weights: str) -> Column:
    """Sum of squared weights of an array made by `row_weights`."""
    return F.aggregate(weights, F.lit(0.0), lambda a, x: a + x["w"] * x["w"])


def row_margins(
    df: DataFrame, text: str, key: str, models: dict[str, LinearModel], keep: Sequence[str] = ()
) -> DataFrame:
    """(key, keep..., a margin per name): several literal models over one count of words.

    Each row is scored where it is read; nothing is exchanged.
    """
    ids = [key, *keep]
    sums = {f"_tabular_{n}": m.tabular_sum() for n, m in models.items()}
    words = sorted({w for m in models.values() for w in m.words})
    counted = term_counts(df.withColumns(sums), text, [*ids, *sums], only=words)
    weights = {f"_weights_{n}": m.row_weights("terms") for n, m in models.items()}
    rows = counted.select(*ids, *sums, *[w.alias(n) for n, w in weights.items()])
    out = []
    for n, m in models.items():
        dot = F.aggregate(f"_weights_{n}", F.lit(0.0), lambda a, x: a + x["w"] * x["coef"])
        square = row_norm(f"_weights_{n}")
        part = F.when(F.size(f"_weights_{n}") > 0, dot / F.sqrt(square)).otherwise(0.0)
        out.append((F.lit(m.intercept) + part + F.col(f"_tabular_{n}")).alias(n))
    # Out of a generator, so that no later filter on a margin is pushed into the word counting.
    told = rows.select(*ids, F.explode_outer(F.array(F.struct(*out))).alias("_m"))
    return told.select(*ids, *[F.col(f"_m.{n}").alias(n) for n in models])


def linear_margin(
    df: DataFrame, text: str, key: str, model: LinearModel, keep: Sequence[str] = ()
) -> DataFrame:
    """(key, keep..., margin): intercept + text part + tabular part.

    Numerator and norm of the text part are summed per key in one aggregation. All terms
    of a record sit in one task, so the map-side combine leaves one narrow row per
    record: the text is never shuffled and nothing is joined back. A small literal model is
    scored inside the row. `df` must hold the tabular features of the model.
    """
    if model.in_row():
        return row_margins(df, text, key, {"margin": model}, keep)
    ids = [key, *keep, "_tabular"]
    placed = df.withColumn("_tabular", model.tabular_sum())
    counted = term_counts(placed, text, ids, only=model.only())
    rows = counted.select(*ids, F.explode_outer("terms").alias("_t")).select(*ids, "_t.term", "_t.tf")
    weighed = model.lookup(rows, "left").withColumn("_w", raw_weight())
    sums = weighed.groupBy(*ids).agg(
        F.sum(F.col("_w") * F.col("coef")).alias("_dot"),
        F.sum(F.col("_w") * F.col("_w")).alias("_sq"),
    )
    text_part = F.coalesce(F.col("_dot") / F.sqrt("_sq"), F.lit(0.0))
    margin = F.lit(model.intercept) + text_part + F.col("_tabular")
    return sums.select(key, *keep, margin.alias("margin"))


def linear_score(
    df: DataFrame, text: str, key: str, model: LinearModel, keep: Sequence[str] = ()
) -> DataFrame:
    """(key, keep..., margin, probability)."""
    scored = linear_margin(df, text, key, model, keep)
    return scored.withColumn("probability", sigmoid("margin"))


def linear_scores(
    df: DataFrame, text: str, key: str, models: dict[str, LinearModel], keep: Sequence[str] = ()
) -> DataFrame:
    """(key, keep..., a probability per name): several models over the same records, read once
    where all are small literals, else joined by key."""
    if all(m.in_row() for m in models.values()):
        rows = row_margins(df, text, key, models, keep)
        return rows.select(key, *keep, *[sigmoid(n).alias(n) for n in models])
    out = None
    for name, model in models.items():
        one = linear_score(df, text, key, model, keep if out is None else ())
        one = one.withColumnRenamed("probability", name).drop("margin")
        out = one if out is None else out.join(one, key)
    return out
