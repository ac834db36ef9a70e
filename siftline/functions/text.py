"""Text columns: cleaning, masking, tokens. All run in the JVM unless named exact."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline import constants as C

# Markup whose content is not text, then any other tag; all become node breaks. Every
# alternative starts at "<", so that other characters are passed over at once.
_HIDDEN = (
    r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>"
    r"|template\b.*?</template\s*>|!\[CDATA\[.*?\]\]>|[!?][^>]*>|/?[A-Za-z][^>]*>)"
)
_BREAK = "\u0001"

# White space with the cheap test first: printable ASCII is ruled out by one comparison.
_SPACE = f"[[^!-~]&&{C.WS}]"
_BREAKING = f"[[^ -~]&&{C.WS}]"


def col_of(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_ws(x: str | Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.btrim(col_of(x), F.lit(C.WS_CHARS))


def strip_html(x: str | Column) -> Column:
    """Text nodes of an HTML fragment, each stripped, joined by one space; null -> ''.

    Covers tags, comments, declarations, hidden elements and the named references of
    `constants.HTML_ENTITIES`. `strip_html_exact` parses the rows this cannot.
    """
    # one pass after another with no branches: a repeated sub-expression would be planned,
    # compiled and evaluated as often as it is written
    body = F.regexp_replace(F.coalesce(col_of(x), F.lit("")), _HIDDEN, _BREAK)
    for name, char in C.HTML_ENTITIES.items():
        body = F.replace(body, F.lit(f"&{name};"), F.lit(char))
    nodes = F.transform(F.split(body, _BREAK), trim_ws)
    return F.array_join(F.filter(nodes, lambda n: n != ""), " ")


def needs_parser(x: str | Column) -> Column:
    """True for markup outside the native path: numeric or unknown references, stray '<'."""
    names = "|".join(C.HTML_ENTITIES)
    left = F.regexp_replace(F.coalesce(col_of(x), F.lit("")), _HIDDEN, " ")
    return left.rlike(rf"<[A-Za-z!/?]|&#|&(?!(?:{names});)[A-Za-z]")


def strip_html_exact(df: DataFrame, source: str, target: str) -> DataFrame:
    """`strip_html` with the standard-library parser for the rows that need it.

    The frame is split so that plain rows never leave the JVM.
    """
    hard = F.coalesce(needs_parser(source), F.lit(False))
    plain = df.filter(~hard).withColumn(target, strip_html(source))
    parsed = df.filter(hard).withColumn(target, _parse_html(F.col(source)))
    return plain.unionByName(parsed)


@F.pandas_udf(T.StringType())
def _parse_html(values: pd.Series) -> pd.Series:
    from html.parser import HTMLParser

    class TextNodes(HTMLParser):
        hidden = ("script", "style", "template")

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.nodes, self.depth = [""], 0

        def cut(self):
            self.nodes.append("")

        def handle_starttag(self, tag, attrs):
            self.cut()
            self.depth += tag in self.hidden

        def handle_endtag(self, tag):
            self.cut()
            self.depth -= tag in self.hidden and self.depth > 0

        def handle_comment(self, data):
            self.cut()

        handle_decl = handle_pi = unknown_decl = handle_comment

        def handle_data(self, data):
            if not self.depth:
                self.nodes[-1] += data

    def text(html):
        if not isinstance(html, str):
            return ""
        parser = TextNodes()
        parser.feed(html)
        parser.close()
        return " ".join(n.strip() for n in parser.nodes if n.strip())

    return values.map(text)


def strip_urls(x: str | Column) -> Column:
    """Every `http://` or `https://` run becomes one space; null -> ''."""
    return F.regexp_replace(F.coalesce(col_of(x), F.lit("")), f"https?://{C.NOT_WS}+", " ")


def clean_text(
    x: str | Column,
    *,
    html: bool = True,
    urls: bool = True,
    lowercase: bool = True,
    whitespace: bool = True,
    max_chars: int | None = None,
) -> Column:
    """HTML, URLs, case, white space, length: in that order, per field.

    Texts stay whole unless `max_chars` asks for a cut.
    """
    out = F.coalesce(col_of(x), F.lit(""))
    if html:
        out = strip_html(out)
    if urls:
        out = strip_urls(out)
    if lowercase:
        out = F.lower(out)
    if whitespace:
        # single spaces, the common case, do not match
        out = trim_ws(F.regexp_replace(out, f" {_SPACE}+|{_BREAKING}{_SPACE}*", " "))
    if max_chars:
        out = F.substring(out, 1, max_chars)
    return out


def concat_fields(fields: Sequence[str | Column]) -> Column:
    """Stripped non-blank fields joined by an empty line."""
    stripped = [trim_ws(f) for f in fields]
    return F.concat_ws("\n\n", *[F.when(s != "", s) for s in stripped])


def text_hash(x: str | Column) -> Column:
    """SHA-256 of the UTF-8 text, null as ''."""
    return F.sha2(F.coalesce(col_of(x), F.lit("")), 256)


def mask_pii(x: str | Column) -> Column:
    """E-mail addresses first, then telephone-like digit runs."""
    masked = F.regexp_replace(col_of(x), C.EMAIL_PATTERN, C.EMAIL_MASK)
    return F.regexp_replace(masked, C.PHONE_PATTERN, C.PHONE_MASK)


def shorten(x: str | Column, max_chars: int = C.PAYLOAD_CHARS) -> Column:
    """Cut longer text to `max_chars` characters, the last three being dots."""
    c = col_of(x)
    return F.when(
        F.length(c) > max_chars,
        F.concat(F.substring(c, 1, max_chars - 3), F.lit("...")),
    ).otherwise(c)


def sanitize(x: str | Column, max_chars: int = C.PAYLOAD_CHARS) -> Column:
    return shorten(mask_pii(x), max_chars)


def split_tokens(x: str | Column) -> Column:
    """White-space tokens, no empty ones."""
    return F.filter(F.split(F.coalesce(col_of(x), F.lit("")), f"{_SPACE}+"), lambda t: t != "")


def word_tokens(x: str | Column) -> Column:
    """Lower-case words of two or more word characters."""
    text = F.lower(F.coalesce(col_of(x), F.lit("")))
    return F.regexp_extract_all(text, F.lit(C.WORD_PATTERN), F.lit(0))


def bigrams(tokens: str | Column) -> Column:
    """Adjacent pairs of a token array."""
    t = col_of(tokens)
    pairs = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(
        F.slice(t, 1, pairs), F.slice(t, 2, pairs), lambda a, b: F.concat_ws(" ", a, b)
    )


def humanize(x: str | Column) -> Column:
    """Feature name as words: no term prefix, no underscores."""
    out = F.replace(col_of(x), F.lit("scam_term_"), F.lit(""))
    out = F.replace(out, F.lit("_"), F.lit(" "))
    return trim_ws(F.replace(out, F.lit("  "), F.lit(" ")))


def sentence_list(names: Column) -> Column:
    """`a`, `a and b`, `a, b, and c`; empty array -> ''."""
    n = F.size(names)
    return (
        F.when(n <= 2, F.array_join(names, " and "))
        .otherwise(
            F.concat(
                F.array_join(F.slice(names, F.lit(1), n - 1), ", "),
                F.lit(", and "),
                F.element_at(names, -1),
            )
        )
    )


def capitalize(x: str | Column) -> Column:
    """First character upper case, the rest lower case."""
    c = col_of(x)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**31 - 1)))


def driver_sentence(positive: Column, negative: Column) -> Column:
    """Summary of an explanation from the leading names of each sign."""
    def clause(names, ending):
        return F.when(F.size(names) > 0, F.concat(capitalize(sentence_list(names)), F.lit(ending)))

    parts = F.concat_ws(
        "; ", clause(positive, C.FRAUD_CLAUSE), clause(negative, C.LEGIT_CLAUSE)
    )
    return F.when(parts == "", F.lit(C.NO_DRIVERS)).otherwise(F.concat(parts, F.lit(".")))


def looks_like_posting(
    x: str | Column,
    keywords: Iterable[str] = C.POSTING_KEYWORDS,
    min_chars: int = C.POSTING_MIN_CHARS,
) -> Column:
    """Any keyword present and more than `min_chars` characters."""
    c = col_of(x)
    found = F.lit(False)
    for word in keywords:
        found = found | F.contains(F.lower(c), F.lit(word))
    return found & (F.length(c) > min_chars)
