import hashlib
import re

import pytest
from pyspark.sql import functions as F

from siftline import constants as C
from siftline.functions import scalars as N
from siftline.functions import text as X


def values(spark, texts, *columns):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string").orderBy("i")
    out = df.select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").collect()
    return [r[1] if len(columns) == 1 else tuple(r[1:]) for r in out]


def test_html_and_urls_leave_words_only(spark):
    raw = "<p>Hello <a href='https://example.com'>World</a>!</p>"
    (out,) = values(spark, [raw], X.clean_text("t"))
    assert out == "hello world !"


def test_html_hard_cases_match_the_parser(spark):
    texts = [
        None, "", "   ", "<missing>", "<b></b>", "plain & simple", "a<!-- x -->b", "<!DOCTYPE html><p>q</p>",
        "<script>var a='<b>';</script>after", "<STYLE>p{}</STYLE > z", "<template><i>t</i></template>u",
        "x &amp; y &lt;i&gt; &quot;q&quot; &copy;", "a<br/>b<br>c", "one <b> two </b>  three", "&nbsp;x&nbsp;",
        "tail <b", "a < b and c > d", "&#65;&#x42;", "&hearts; &unknown;", "<p> wide　</p>", "<ul><li>1<li>2</ul>",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.o for r in X.strip_html_exact(df, "t", "o").collect()}
    parsed = {r.i: r.o for r in df.withColumn("o", X._parse_html(F.col("t"))).collect()}
    assert got == parsed
    assert got[3] == "" and got[0] == "" and got[6] == "a b" and got[11] == 'x & y <i> "q" ©'
    assert got[17] == "AB"


def test_clean_text_order_and_options(spark):
    raw = "  See HTTP://x.y and http://a.b/c?d\tNOW  <i>É</i> "
    full, kept, cut = values(
        spark, [raw], X.clean_text("t"), X.clean_text("t", html=False, urls=False, lowercase=False, whitespace=False, max_chars=None),
        X.clean_text("t", max_chars=5),
    )[0]
    assert full == "see http://x.y and now é"
    assert kept == raw
    assert cut == "see h"


def test_white_space_equals_python(spark):
    texts = ["a b \x1c c\x85d", "\t\n x 　", "", "  ", "one  two   three", "é è"]
    assert values(spark, texts, X.clean_text("t", html=False, urls=False)) == [
        re.sub(r"\s+", " ", t.lower()).strip() for t in texts
    ]
    assert [list(v) for v in values(spark, texts, X.split_tokens("t"))] == [t.split() for t in texts]


def test_concat_skips_blank_fields(spark):
    df = spark.createDataFrame([("Engineer", None, " Python "), (" ", "", None)], "a string, b string, c string")
    out = [r[0] for r in df.select(X.concat_fields(["a", "b", "c"])).collect()]
    assert sorted(out) == ["", "Engineer\n\nPython"]


def test_masking_equals_python(spark):
    texts = [
        "mail a.b+c@x-y.org now", "call 555-0123 or (212) 555 0100", "+1 212.555.0100", "id 1234567", "12-34", "", None,
        "a@b and c@d.e",
    ]
    def mask(t):
        if not t:
            return t
        return re.sub(C.PHONE_PATTERN, C.PHONE_MASK, re.sub(C.EMAIL_PATTERN, C.EMAIL_MASK, t))
    assert values(spark, texts, X.mask_pii("t")) == [mask(t) for t in texts]


@pytest.mark.parametrize("n,expected", [(799, 799), (800, 800), (801, 800)])
def test_long_payload_is_cut(spark, n, expected):
    (out,) = values(spark, ["x" * n], X.sanitize("t"))
    assert len(out) == expected and out.endswith("...") == (n > 800)


def test_tokens_bigrams_and_hash(spark):
    text = "The éclair_9 a bc  bc!"
    words, pairs, digest = values(spark, [text], X.word_tokens("t"), X.bigrams(X.word_tokens("t")), X.text_hash("t"))[0]
    assert words == re.findall(r"\b\w\w+\b", text.lower())
    assert pairs == ["the éclair_9", "éclair_9 bc", "bc bc"]
    assert digest == hashlib.sha256(text.encode()).hexdigest()
    assert values(spark, ["", "x", "one"], X.bigrams(X.word_tokens("t"))) == [[], [], []]


def test_sentences(spark):
    def sentence(p, n):
        df = spark.createDataFrame([(p, n)], "p array<string>, n array<string>")
        return df.select(X.driver_sentence(F.col("p"), F.col("n"))).first()[0]

    assert sentence(["data entry", "CLERK", "logo"], []) == "Data entry, clerk, and logo pushed the score toward fraud."
    assert sentence(["a"], ["b", "c"]) == "A pushed the score toward fraud; B and c reinforced the legit decision."
    assert sentence([], []) == C.NO_DRIVERS
    assert values(spark, ["scam_term_wire_transfer", "has_logo"], X.humanize("t")) == ["wire transfer", "has logo"]


def test_posting_heuristic_needs_keyword_and_length(spark):
    texts = ["salary " + "x" * 200, "salary", "y" * 300, "WE'RE HIRING " + "z" * 200]
    assert values(spark, texts, X.looks_like_posting("t")) == [True, False, False, True]


def test_verdicts(spark):
    texts = [
        '{"is_job_posting": true, "confidence": 0.9, "reason": "r"}',
        'Sure\n```json\nx\n```\n``` {"is_job_posting": "Yes"} ```',
        'so {"is_job_posting": 0, "confidence": "high"} ok',
        "nothing", '{"broken', None, "[1, 2]",
    ]
    out = values(spark, texts, N.extract_verdict("t"))
    assert tuple(out[0]) == (True, 0.9, "r")
    assert tuple(out[1]) == (True, None, None)
    assert tuple(out[2]) == (False, None, None)
    assert out[3:] == [None] * 4


def test_numbers(spark):
    import math

    texts = ["0.2", " 1e-9 ", "x", "", "1", None]
    lenient = values(spark, texts, N.lenient_double("t"))
    assert lenient == [0.2, 1e-9, None, None, 1.0, None]
    p = 0.3
    df = spark.range(1).select(
        N.queue_entropy(F.lit(p)), N.sample_entropy(F.lit(1.0)), N.sigmoid(F.lit(0.0)), N.logit(F.lit(0.0)),
        N.softmax_last(F.array(F.lit(1.0), F.lit(3.0))), N.weighted_mean([F.lit(0.2), F.lit(0.8)], [1, 3]),
        N.fixed(F.lit(0.5115), 3), N.fixed(F.lit(-2.0), 1), N.apply_calibration("none", F.lit(0.4), F.lit(9.0)),
    ).first()
    assert df[0] == pytest.approx(-(p * math.log2(p + 1e-9) + 0.7 * math.log2(0.7 + 1e-9)))
    assert 0 < df[1] < 1e-4 and df[2] == 0.5
    assert df[3] == pytest.approx(math.log(1e-6 / (1 - 1e-6)))
    assert df[4] == pytest.approx(math.exp(3) / (math.exp(1) + math.exp(3)))
    assert df[5] == pytest.approx(0.65)
    assert (df[6], df[7], df[8]) == ("0.512", "-2.0", 0.4)
    for bad in ([0.0, 0.0], [float("nan"), 1.0]):
        with pytest.raises(ValueError):
            N.weighted_mean(["a", "b"], bad)
