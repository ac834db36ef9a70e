"""The operators against plain versions, over awkward rows."""

import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.llm import (
    chat,
    decontaminate,
    hmm,
    jaccard,
    language,
    packing,
    permutation,
    quality,
    secrets,
    site_lines,
)
from siftline.llm import words as wd
from siftline.llm.components import components
from tests.llm import plain

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep string, row string, score string"
LONG = " ".join(f"w{i % 9973}" for i in range(60_000))
AWKWARD = [
    None, "", " ", "\n\n", "one", "One two\tthree\x0bfour\x0cfive six", "A" * 5000, "é É ß \U0001f600  x", "a.b,c!d",
    "\x00nul\x00", "repeat " * 3000, LONG, LONG, "same text again", "same text again", "<|im_end|>", "it's 2024!! U.S.A",
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else "h", 1, "k", "r", "s") for i, t in enumerate(AWKWARD)]
    rows += [(None, "text without a key", None, None, None, None, None, None), rows[5], rows[5]]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def by_repr(rows):
    return sorted(map(repr, map(tuple, rows)))


# --- Words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBé \n\t\x0bxyz \U0001f600", max_size=40)), max_size=12), st.integers(1, 40))
def test_words_do_not_depend_on_the_window(texts, window):
    old = wd.WINDOW_BYTES
    try:
        wd.WINDOW_BYTES = window
        wd._TABLES.clear()
        got = dict(wd.doc_hashes(pa.array(texts, pa.string())))
    finally:
        wd.WINDOW_BYTES = old
        wd._TABLES.clear()
    whole = dict(wd.doc_hashes(pa.array(texts, pa.string())))
    assert sorted(got) == list(range(len(texts)))
    known = {}
    for i, t in enumerate(texts):
        assert got[i].tolist() == whole[i].tolist()
        for h, w in zip(got[i].tolist(), plain.words(t), strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


# --- 1 Packing


def test_word_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    enc, plain = packing.encoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    texts = [t or "" for t in AWKWARD] + ["Ça va? naïve ﬁ İ ſt <|endoftext|>'s 12,5€ x'll", "ÀÉ...!? z;"]
    texts += ["a<|ENDOFTEXT|> b<|endoftext|>C <|startoftext|><|endoftext|>", "<|ENDOFTEXT|><|endoftext|> <|endoftext|><|ENDOFTEXT|>"]
    assert 49407 in plain.encode(texts[-1], add_special_tokens=False).ids
    for i, ids in packing.doc_ids(pa.array(texts), enc):
        assert ids.tolist() == plain.encode(texts[i], add_special_tokens=False).ids, texts[i]


@pytest.mark.parametrize("name", ["words", "whole"])
def test_encoder_forgets_and_other_files_are_encoded_whole(monkeypatch, name):
    enc = packing.WordEncoder(packing.tokenizer_path())
    assert enc.by_words and not packing._by_words(json.loads(enc.tokenizer.to_str()) | {"normalizer": None})
    enc.by_words = name == "words"
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    texts = ["one two, two three", None, "four one two", "", "two <|endoftext|>", "five, one"]
    for _ in range(2):
        for i, text in enumerate(texts):
            ((_, ids),) = packing.doc_ids(pa.array([text], pa.string()), enc)
            assert ids.tolist() == enc.tokenizer.encode(text or "", add_special_tokens=False).ids, i


def test_patterns_use_every_piece_and_few_sequences():
    rng = random.Random(3)
    for _ in range(20):
        counts = {rng.randint(1, 64): rng.randint(1, 30) for _ in range(rng.randint(1, 40))}
        used = {}
        for lengths, times in packing.plan_patterns(counts, 64):
            assert sum(lengths) <= 64 and times > 0
            for x in lengths:
                used[x] = used.get(x, 0) + times
        assert used == counts
    even = {64 - 3 * i: 10 for i in range(1, 20)} | {i: 10 for i in (3, 6, 9, 12, 15, 18)} | {1: 500}
    total = sum(k * v for k, v in even.items())
    assert sum(n for _, n in packing.plan_patterns(even, 64)) <= -(-total // 64) + 1
    stock = packing._Stock({10: 1, 20: 2, 34: 1}, 64)
    assert stock.pair(40) == [20, 20] and stock.pair(68 - 24) == [34, 10] and stock.triple(64) == [34, 20, 10]
    assert packing._Stock({20: 1}, 64).pair(40) is None


def test_packing(spark, awkward, nothing):
    out = packing.pack(awkward, packing.tokenizer_path(), with_ids=True).collect()
    tok = packing.encoder(packing.tokenizer_path()).tokenizer
    want = []
    for key, text in pairs(awkward):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        want += [
            (key, i, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()), ids[a : a + 4096])
            for i, a in enumerate(range(0, len(ids), 4096))
        ]
    assert by_repr([r[:6] for r in out]) == by_repr(want)
    spans = {}
    for r in out:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(spans) <= -(-sum(r.length for r in out) // 4096) + 1
    assert packing.pack(nothing, packing.tokenizer_path()).count() == 0
    whole = packing.sequences(spark.createDataFrame(out, packing.PIECES + ", ids array<int>, sequence_id long, offset long"))
    assert sum(len(r.ids) for r in whole.collect()) == sum(r.length for r in out)


# --- 2 Language model


def test_forward_recursion_is_the_sum_over_paths():
    rng = np.random.default_rng(1)
    model = hmm.random_model(np.full(4, 0.25), 5)
    emit = model.emissions(np.full(4, 0.25))
    lengths = np.array([3, 1, 4])
    classes = rng.integers(0, 4, lengths.sum())
    got, at = hmm.log_likelihood(model, emit, classes, lengths), 0
    for i, n in enumerate(lengths):
        x, total = classes[at : at + n], 0.0
        for path in np.ndindex(*[hmm.STATES] * int(n)):
            p = model.start[path[0]] * emit[x[0], path[0]]
            for t in range(1, n):
                p *= model.step[path[t - 1], path[t]] * emit[x[t], path[t]]
            total += p
        assert np.isclose(got[i], np.log10(total))
        at += n


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(2)
    classes = np.concatenate([rng.choice(6, 30, p=p) for p in ([0.5, 0.5, 0, 0, 0, 0], [0, 0, 0.5, 0.5, 0, 0]) * 20])
    lengths, base = np.full(40, 30), np.bincount(classes, minlength=6) / len(classes)
    model, scores = hmm.random_model(base), []
    for _ in range(8):
        emit = model.emissions(base)
        scores.append(hmm.log_likelihood(model, emit, classes, lengths).sum())
        counts = hmm.expected_counts(model, emit, classes, lengths)
        assert np.isclose(counts.own.sum(), len(classes), rtol=1e-3) and np.isclose(counts.step.sum(), 40 * 29, rtol=1e-3)
        model = counts.model()
    assert scores[-1] > scores[0] + 50


def test_lm_scores(spark, awkward, nothing, monkeypatch):
    docs = awkward.filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in hmm.hmm_scores(docs).collect()}
    want = plain.base_scores(pairs(docs))
    assert got.keys() == want.keys()
    for k, (held, n, known, train, base) in want.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert np.isclose(r.base_score, base) and np.isfinite(r.score)
    assert hmm.hmm_scores(awkward).count() == awkward.count()
    assert hmm.hmm_scores(nothing).count() == 0
    only_held = spark.createDataFrame([(k, "a b") for k in range(40) if zlib.crc32(str(k).encode()) % 10 == 0], "doc_id long, text string")
    assert all(r.n_known == 0 and np.isclose(r.score, r.base_score) for r in hmm.hmm_scores(only_held).collect())


def test_lm_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = hmm.hmm_scores(docs).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


# --- 3 Secrets


def test_base_spans():
    rng = random.Random(5)
    bits = ["password", "PassWd", "token", "api_key", "ApiKey", "ſecret", "toKen", '"', "'", " ", ":", "=", "AKIA", "ABCDEF012345", "deadbeef" * 4, "x", "K", "abc12345", "é"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert secrets.base_spans(text) == plain.secret_spans(text), text


def test_battery_tells_random_from_written():
    rng = random.Random(8)
    kind = [n for n, _ in secrets.ENCODINGS].index("base62")
    alphabet = secrets.ENCODINGS[kind][1]
    chance = [secrets.battery("".join(rng.choice(alphabet) for _ in range(40)), kind) for _ in range(200)]
    assert np.mean(np.array(chance) < 0.05) < 0.12
    assert secrets.battery("thisisnotrandomatallbutwrittenbysomebody", kind) < 1e-6


def test_secrets(spark, awkward, nothing):
    rng = random.Random(9)
    key = "".join(rng.choice(secrets.ENCODINGS[-2][1]) for _ in range(40))
    prose = ["".join(rng.choice("etaoin shrdlu eee ") for _ in range(400)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(prose)] + [(900, f"look {key} here"), (901, "token = abcdefgh"), (902, None)]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[901] == [(0, 0, 16)] and got[902] == []
    assert got[900] == [(5, 3, 45)]
    assert sum(map(len, got.values())) == 2
    assert secrets.find_secrets(awkward).count() == awkward.count()
    assert secrets.find_secrets(nothing).count() == 0


def test_candidates_after_any_delimiter():
    key = "q7Zt0XbW4mRk9LhV2sNd8PyJ5cFg1TaU6eQi3oBx"
    found = lambda text: [m[0] for m in secrets.CANDIDATE.finditer(text)]
    for before in ("sig=", "private_key=", "https://a.b/c?key=", "x: ", "x:", "'", '"', "?a=1&key=", "=="):
        for after, padding in (("", ""), ("&b=2", ""), ("'", ""), (" x", ""), ("=", "="), ("==", "==")):
            assert found(before + key + after) == [key + padding], (before, after)
    name = "AWS_SECRET_ACCESS_KEY"
    for between in ("=", "==", "===", " = "):
        assert found(name + between + key) == [name, key], between


def test_secret_after_equals(spark):
    rng = random.Random(9)
    keys = ["".join(rng.choice(secrets.ENCODINGS[-2][1]) for _ in range(40)) for _ in range(3)]
    prose = ["".join(rng.choice("etaoin shrdlu eee ") for _ in range(400)) for _ in range(300)]
    before = ["sig=", "AWS_SECRET_ACCESS_KEY=", "https://a.b/c?key="]
    rows = [(i, t) for i, t in enumerate(prose)] + [(900 + i, f"look {b}{k} here") for i, (b, k) in enumerate(zip(before, keys, strict=True))]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, b in enumerate(before):
        assert (5 + len(b), 3, 45 + len(b)) in got[900 + i], b


def test_decoys_are_the_batterys_of_the_whole_text():
    rng = random.Random(12)
    texts = ["", "é" * 30] + ["".join(rng.choice("etaoin shrdlu 0123456789 ABCDEF+/") for _ in range(n)) for n in (19, 700, 9000)]
    texts += ["a" * 100, "".join(rng.choice(secrets.ENCODINGS[-1][1]) for _ in range(5000))]
    spans = [[], [], [], [(5, 40)], [(0, 3), (8990, 9000)], [], [(7, 30)]]
    want = np.zeros((len(secrets.ENCODINGS) * len(secrets.BANDS), secrets.BINS), np.int64)
    for text, cut in zip(texts, spans, strict=True):
        for a, b in cut:
            text = text[:a] + " " * (b - a) + text[b:]
        for kind, (_, alphabet) in enumerate(secrets.ENCODINGS):
            kept = "".join(c for c in text if c in alphabet)
            for n in secrets.BANDS:
                for i in range(0, len(kept) - n + 1, n):
                    want[secrets._stratum(kind, n), secrets._bin(secrets.battery(kept[i : i + n], kind))] += 1
    got = secrets._decoys(texts, spans)
    assert (got.sum(axis=1) == want.sum(axis=1)).all() and got.sum() > 3000
    # A result at the edge of a bin may fall to either side.
    assert np.abs(np.cumsum(got - want, axis=1)).sum() <= 3


def test_encodings_rare_in_prose_have_a_null(spark):
    rng = random.Random(13)
    names = [n for n, _ in secrets.ENCODINGS]
    picks = [("decimal", 25), ("decimal", 31), *[(k, n) for k in ("HEX", "base32", "BASE36") for n in (40, 70)]]
    keys = ["".join(rng.choice(secrets.ENCODINGS[names.index(k)][1]) for _ in range(n)) for k, n in picks]
    prose = ["".join(rng.choice("etaoin shrdlu eee ") for _ in range(900)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(prose)] + [(900 + i, f"look {k} here") for i, k in enumerate(keys)]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[900 + i] for i in range(len(keys))] == [[(5, 3, 5 + n)] for _, n in picks]


# --- 4 Quality


def test_quality(spark, awkward, nothing):
    rng = random.Random(4)
    good, bad = ["tree", "river", "stone", "cloud", "field"], ["foul", "vile"]
    rows = []
    for i in range(400):
        text = [rng.choice(good) for _ in range(rng.randint(5, 200))]
        if i % 4 == 0:
            text[rng.randrange(len(text))] = rng.choice(bad) + rng.choice(["ly", "ness", "er"])
        rows.append((i, " ".join(text), 0 if i % 4 == 0 else 2 if i % 8 else 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = quality.train(df.select("doc_id", "text"), df.select("doc_id", "grade"))
    assert (np.diff(model.cuts) > 0).all()
    got = quality.score(df, model).collect()
    assert np.mean([r.expected_grade for r in got if r.grade == 0]) < np.mean([r.expected_grade for r in got if r.grade == 2])
    assert not any(r.keep for r in got if r.grade == 0)
    assert all(0 <= r.p_best <= 1 for r in got)
    out = quality.score(awkward, model)
    assert out.count() == awkward.count() and "score" in out.columns
    assert quality.keep_good(awkward, model).columns == awkward.columns
    assert quality.score(nothing, model).count() == 0
    none = quality.train(awkward, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, grade int"))
    assert all(r.keep for r in quality.score(awkward, none).collect())


@pytest.mark.parametrize("theta", [[0.3], [-0.5, 0.2], [-1.0, -0.3, 0.4]])
def test_quality_slopes_are_differences_of_the_likelihood(theta):
    rng = np.random.default_rng(len(theta))
    theta, score = np.array(theta), rng.normal(size=40) * 2
    grades = rng.integers(0, len(theta) + 1, 40)

    def likelihood(score, theta):
        cuts = [theta[0] + sum(np.exp(g) for g in theta[1 : k + 1]) for k in range(len(theta))]
        tail = [np.ones(40), *[1 / (1 + np.exp(c - score)) for c in cuts], np.zeros(40)]
        return np.array([np.log(tail[g][i] - tail[g + 1][i]) for i, g in enumerate(grades)])

    by_row, by_theta = quality.slopes(score, grades, theta)
    h = 1e-6
    assert np.allclose(by_row, (likelihood(score + h, theta) - likelihood(score - h, theta)) / (2 * h), atol=1e-6)
    for k, slope in enumerate(by_theta):
        step = h * (np.arange(len(theta)) == k)
        assert np.isclose(slope, (likelihood(score, theta + step) - likelihood(score, theta - step)).sum() / (2 * h), atol=1e-5)


def test_quality_counts_a_repeated_key_once(spark):
    rows = [(i, f"tree river {'foul' if i % 3 == 0 else 'good'} {i % 5}", 0 if i % 3 == 0 else 2 - i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    docs, grades = df.select("doc_id", "text"), df.select("doc_id", "grade")
    many = docs.unionByName(docs.filter("doc_id < 3").crossJoin(spark.range(500)).select("doc_id", "text"))
    one, other = quality.train(docs, grades), quality.train(many, grades)
    assert np.array_equal(one.weights, other.weights) and np.array_equal(one.cuts, other.cuts)


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    grades = quality.graded(labels)
    train = F.crc32(F.col("doc_id").cast("string")) % 4 != 0
    model = quality.train(docs, grades.filter(train))
    got = quality.score(docs.select("doc_id", "text"), model).join(grades.filter(~train), "doc_id")
    rates = {r.grade: r.kept for r in got.groupBy("grade").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    assert rates[2] > 0.98 and rates[0] < 0.25


# --- 5 Languages


def test_kneser_ney_sums_to_one():
    word, codes = language.grams([b"banana", b"band", b"nab", "été".encode(), "мама".encode()])
    found, n = np.unique(codes, return_counts=True)
    model = language.Model(["x"], [language._kneser_ney(found, n.astype(np.int64))])
    every = np.arange(1 << 16, dtype=np.uint64)
    for history in [np.uint64(0), *(found >> np.uint64(16))[:5], np.uint64(12345)]:
        assert np.isclose((2.0 ** -model.bits(every + (history << np.uint64(16)))[:, 0]).sum(), 1, atol=1e-3)


def plain_grams(word):
    """(history, symbol) as tuples of units, the end being 0."""
    raw = word.lower().encode("utf-16-le")
    units = [int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2)]
    out = []
    for i, u in enumerate([*units, 0]):
        wide = u >= language.WIDE or (i > 0 and units[i - 1] >= language.WIDE)
        out.append((tuple(([0, 0, 0] + units[:i])[-3:]) if not wide else (0, 0, units[i - 1] if i else 0), u))
    return [(*h, u) for h, u in out]


def plain_kneser_ney(words):
    """Probability of a gram by the textbook's recursion over dictionaries."""
    counts = {4: {}}
    for g in (g for w in words for g in plain_grams(w)):
        counts[4][g] = counts[4].get(g, 0) + 1
    for k in (3, 2, 1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    cut = {k: language._discount(np.array(list(c.values()))) for k, c in counts.items()}

    def p(gram):
        k = len(gram)
        if not k:
            return 2.0**-16
        after = [c for g, c in counts[k].items() if g[:-1] == gram[:-1]]
        if not after:
            return p(gram[1:])
        own = max(counts[k].get(gram, 0) - cut[k], 0) / sum(after)
        return own + cut[k] * len(after) / sum(after) * p(gram[1:])

    return p


def test_kneser_ney_equals_the_plain_recursion():
    words = ["banana", "Band", "nab", "été", "ete", "мама", "іаіа", "漢字漢", "字", "\U00010400a", "bananas"]
    told = words + ["ban", "xyz", "мамі", "漢漢", "\U00010401"]
    _, codes = language.grams([w.encode() for w in words])
    found, n = np.unique(codes, return_counts=True)
    tables, p = language._kneser_ney(found, n.astype(np.int64)), plain_kneser_ney(words)
    place, wanted = language.grams([w.encode() for w in told])
    want = [g for w in told for g in plain_grams(w)]
    assert len(want) == len(wanted) and place.tolist() == [i for i, w in enumerate(told) for _ in plain_grams(w)]
    assert np.allclose(tables.log2(wanted), [np.log2(p(g)) for g in want], atol=1e-5)


def test_languages_of_one_script(spark):
    # Letters that tell such neighbours apart are letters of their own.
    uk, ru = "мій кіт їсть рибу і спить біля вікна її дім", "мой кот ест рыбу и спит около окна её дом"
    zh, ja = "我們的貓吃魚在窗邊睡覺", "わたしのねこはさかなをたべてまどでねる"
    rng = random.Random(5)
    rows = []
    for i in range(200):
        lang, text = (("uk", uk), ("ru", ru), ("zh", zh), ("ja", ja))[i % 4]
        parts = text.split() if " " in text else list(text)
        rows.append((i, lang, (" " if " " in text else "").join(rng.choices(parts, k=12))))
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language.train(docs.filter("doc_id % 5 != 0"))
    got = language.identify(docs, model).collect()
    assert all(r.lang_pred == r.lang for r in got)
    word, codes = language.grams(["мама".encode(), "іаіа".encode()])
    assert not set(codes[word == 0][:-1]) & set(codes[word == 1][:-1])


def test_languages(spark, awkward, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language.train(docs.filter(~held))
    got = language.identify(docs.filter(held), model).collect()
    right = [r.lang_pred == r.lang for r in got]
    assert np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in got)
    out = {r.doc_id: r for r in language.identify(awkward, model).collect()}
    assert out[0].lang_pred == out[1].lang_pred == out[3].lang_pred == "und" and out[0].score == 0
    assert out[10].lang_pred != "und" and language.identify(awkward, model).count() == awkward.count()
    assert language.identify(nothing, model).count() == 0
    empty = language.train(nothing)
    assert {r.lang_pred for r in language.identify(awkward, empty).collect()} == {"und"}
    assert language.train(awkward).langs == ["en"]


# --- 6 Lines


def test_site_lines(spark, awkward, nothing):
    rows = [(i, f"menu\nown line {i}\n\nfoot {i % 2}", "a") for i in range(20)]
    rows += [(100 + i, "copied page\nof two lines", "a") for i in range(30)] + [(200, "menu\nx", "b"), (201, None, "a"), (202, "menu", None)]
    got = {r.doc_id: r for r in site_lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].text == "own line 0\n" and (got[0].n_lines, got[0].n_dropped) == (4, 2)
    assert got[100].text == "copied page\nof two lines" and got[200].text == "menu\nx" and got[202].text == "menu"
    assert got[201].text is None and got[201].n_lines == 0
    out = site_lines.drop_boilerplate(awkward)
    assert by_repr(out.select("doc_id", "text").collect()) == by_repr(awkward.select("doc_id", "text").collect())
    assert out.columns == [*awkward.columns, "n_lines", "n_dropped"]
    assert site_lines.drop_boilerplate(awkward, counts=False).columns == awkward.columns
    assert site_lines.drop_boilerplate(nothing).count() == 0


def test_site_lines_with_columns_of_any_name(spark, monkeypatch):
    rows = [(i, f"menu\nown line {i}", "a", "mine", "mine", "mine") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _site string, _bad string, _LEFT string, bad string")
    for limit in (site_lines.MAX_BROADCAST_BYTES, 0):  # broadcast, then shuffled
        monkeypatch.setattr(site_lines, "MAX_BROADCAST_BYTES", limit)
        out = site_lines.drop_boilerplate(docs, host="_site")
        assert ("strategy=broadcast" in out._jdf.queryExecution().optimizedPlan().toString()) == (limit > 0)
        assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
        got = {tuple(r) for r in out.collect()}
        assert got == {(i, f"own line {i}", "a", "mine", "mine", "mine", 2, 1) for i in range(20)}


# --- 7 Neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    x[100:160] = x[7]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None, *[1.0] * 15]), (None, rows[1][1]), (5005, []), (5006, [1.0])]
    df = permutation.usable(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>"))
    assert df.count() == 3001
    got = {}
    for r in permutation.nearest(df, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        want = [i for i in np.lexsort((np.arange(3000), -s)).tolist() if i != q][:20]
        found = [v for _, v, _ in sorted(got[q])]
        assert len(found) == 20 and [k for k, _, _ in sorted(got[q])] == list(range(1, 21))
        assert all(np.isclose(s[v], score) for _, v, score in got[q])
        hits += len(set(want) & set(found))
        if q == 100:
            assert found == want
    assert hits / (150 * 20) >= 0.9
    few = df.filter("vec_id < 5")
    assert permutation.nearest(few, few.filter("vec_id = 0")).count() == 4
    assert permutation.nearest(df.limit(0), df.limit(0)).count() == 0


def test_more_neighbours_than_the_query_asks_for(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, v) for i, v in enumerate(rng.standard_normal((200, 8)).tolist())]
    df = spark.createDataFrame(vectors, "vec_id long, v array<double>")
    got = permutation.nearest(df, df.filter("vec_id < 3"), 50).collect()
    v = np.array([x for _, x in vectors])
    for q in range(3):
        want = [i for i in np.argsort(-(v @ v[q]), kind="stable").tolist() if i != q][:50]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_neighbours_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = permutation.nearest(permutation.usable(rows), permutation.usable(rows).filter("vec_id % 20 = 0"))
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    table = rows.toPandas()
    x, ids = np.array(table.embedding.tolist(), float), table.vec_id.to_numpy()
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        hits, total = hits + len(got[ids[q]] & set(ids[best].tolist())), total + 20
    assert hits / total >= 0.9


# --- 8 Benchmark


BENCH = "item_id long, text string, row string"


def told8(df):
    named = F.sort_array(F.transform("items", lambda i: i.cast("string")))
    return df.select(
        "key", "n_words", decontaminate.n_hit(F.col("hits")), F.size("items"), F.sha2(F.array_join(named, ","), 256), F.size("hits") > 0
    )


def test_decontamination(spark, awkward, nothing):
    rng = random.Random(6)
    vocabulary = ["a", "b", "C", "é", "Él", "x1"]
    text = lambda n: rng.choice([" ", "-", ", "]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(10, 14)), "r") for i in range(6)] + [(7, "One two three", "r"), (8, None, "r"), (9, "!!", "r"), (9, text(10), "r"), (None, "same text again", "r")]
    rows = [(i, text(rng.randint(0, 60)) + " " + (items[rng.randrange(6)][1] if i % 3 else "")) for i in range(150)]
    for few in (True, False):
        if not few:
            decontaminate.MAX_BROADCAST_WINDOWS = 1
        try:
            bench, docs = spark.createDataFrame(items, BENCH), spark.createDataFrame(rows, "doc_id long, text string")
            got = told8(decontaminate.find_hits(docs, bench)).collect()
            assert by_repr(got) == by_repr(plain.decontaminated(rows, [i[:2] for i in items]))
        finally:
            decontaminate.MAX_BROADCAST_WINDOWS = 200_000
    got = told8(decontaminate.find_hits(awkward, bench)).collect()
    assert by_repr(got) == by_repr(plain.decontaminated(pairs(awkward), [i[:2] for i in items]))
    assert decontaminate.find_hits(nothing, bench).count() == 0
    assert told8(decontaminate.find_hits(awkward, bench.limit(0))).filter("n_words > 0").count() > 5
    assert decontaminate.decontaminate(awkward, bench).columns == awkward.columns


def test_decontaminate_decides_by_row(spark):
    bench = spark.createDataFrame([(1, "One two three", "r")], BENCH)
    rows = [(1, "say one two three", "x", "x"), (1, "say nothing", "x", "x"), (None, "one two three", "x", "x"), (None, "clean", "x", "x"), (2, None, "x", "x"), (2, "one, TWO three!", "x", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _digest string")
    out = decontaminate.decontaminate(docs, bench)
    assert out.columns == docs.columns
    assert by_repr(out.collect()) == by_repr([rows[1], rows[3], rows[4]])


def test_no_python_in_native_plans(spark):
    folder = "/root/testdata/sf0.001"
    for query in (decontaminate.op8, chat.op9):
        plan = query(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# --- 9 Chat


@settings(max_examples=40, deadline=None)
@given(text=st.lists(st.sampled_from(["<", "|", "\\", "im_start", "|>", "<|im_end|>", "\n", "a", "<\\|"]), max_size=10).map("".join))
def test_escape_is_reversible(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e")).select("e", chat.unescape(F.col("e")).alias("t")).first()
    assert row.t == text and "<|" not in row.e


def test_events(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "He"), (1, 2, 1, "delta", None, "llo"),
        (1, 3, 1, "regenerate", None, None), (1, 4, 1, "delta", None, "Hey"), (1, 5, 1, "delta", None, "!"),
        (1, 6, 0, "edit", None, "hi there"), (1, 7, 2, "message", "user", "x"), (1, 8, 2, "delete", None, None),
        (2, 0, 5, "delta", "assistant", "orphan"), (None, None, None, "message", None, None),
    ]
    rows = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string")
    out = {r.conv_id: r for r in chat.format_chats(rows).collect()}
    assert out[1].formatted == "<|im_start|>user\nhi there<|im_end|>\n<|im_start|>assistant\nHey!<|im_end|>\n"
    assert [out[1].formatted[a:b] for a, b in out[1].loss_spans] == ["Hey!"]
    assert out[2].formatted == "<|im_start|>assistant\norphan<|im_end|>\n" and out[None].n_turns == 1


def test_formatting(spark):
    rng = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>assistant\n", "<\\|", "é", "\U0001f600", "\n", "ok", None]
    rows = [
        (rng.choice([None, 1, 2, 3]), rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "sys\ntem", None]), rng.choice(bits))
        for _ in range(120)
    ] + [(9, t, "assistant", f"t{t}") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(chat.turn_events(df))
    out = out.select("*", chat.read_back(F.col("formatted")).alias("back"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    none_first = lambda x: (x is not None, x if x is not None else 0)
    for r in out.collect():
        want = sorted(groups[r.conv_id], key=lambda x: (none_first(x[1]), x[2] is not None, x[2] or "", x[3] is not None, (x[3] or "").encode()))
        want = [(x[2] or "", x[3] or "") for x in want]
        assert [tuple(t) for t in r.back] == want and r.n_turns == len(want)
        assert r.loss == "".join(t for role, t in want if role == "assistant")
    assert chat.format_chats(chat.turn_events(df.limit(0))).count() == 0


# --- 10 Jaccard join


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join(spark, seed):
    rng = random.Random(seed)
    rows = []
    for g in range(30):
        base = [f"w{rng.randrange(40 if g % 2 else 4000)}" for _ in range(rng.randint(3, 90))]
        for _ in range(rng.choice([1, 2, 12])):
            own = [w if rng.random() > rng.choice([0, 0.01, 0.03]) else f"z{rng.randrange(9)}" for w in base]
            rows.append((rng.randrange(10**6), " ".join(own[: rng.choice([len(own), len(own) - 2, 10])] )))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert by_repr(got) == by_repr(plain.near(rows))


def test_keep_one_decides_by_row(spark):
    a, b = "a b c d e f g h", "x y z u v w q r"
    rows = [(1, a), (2, a), (2, b), (1, a.upper()), (3, b), (4, None), (4, None), (5, ""), (None, a)]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, digest int, low int")
    got = sorted(((r.doc_id, r.text) for r in jaccard.keep_one(df).collect()), key=repr)
    assert len([r for r in got if r[0] == 1]) == 1 and got[0][1] in (a, a.upper())
    assert [r for r in got if r[0] != 1] == [(2, b), (4, None), (5, ""), (None, a)]


def test_passages_shared_by_many_texts_meet_once(spark):
    """Texts that share a passage but little else, and among them pairs that do link."""
    import random

    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10_000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(60):
        own = [word() for _ in range(rng.randrange(60, 90))]
        rows.append((2 * i, " ".join(own + passage)))
        if i % 3 == 0:
            rows.append((2 * i + 1, " ".join([word()] + own + passage[:-1])))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(plain.near(rows))
    assert len({r[2] for r in got}) == 60


def test_jaccard_join_of_awkward_rows(spark, awkward, nothing):
    got = jaccard.near_duplicates(awkward).collect()
    assert by_repr(got) == by_repr(plain.near(pairs(awkward)))
    kept = jaccard.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect()) == sorted(
        (k is None, k) for k in {k for k, _, c in plain.near(pairs(awkward)) if k == c}  | {None}
    )
    assert jaccard.near_duplicates(nothing).count() == 0 and jaccard.keep_one(nothing).count() == 0


def test_prefixes_hold_what_linked_sets_share():
    rng = random.Random(7)
    for _ in range(300):
        a = {rng.randrange(200) for _ in range(rng.randint(1, 120))}
        b = {x if rng.random() > 0.08 else rng.randrange(200) for x in a} | {rng.randrange(200) for _ in range(rng.randint(0, 4))}
        if 100 * len(a & b) >= 80 * len(a | b):
            first = [set(sorted(s)[: jaccard.prefix(len(s))]) for s in (a, b)]
            assert len(first[0] & first[1]) > min(len(a), len(b)) // jaccard.MORE


