"""Benchmark decontamination by winnowing, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import words as wd
from siftline.session import scratch_path, small_or_shuffle

#: ASCII but digits and letters, one by one: the JVM tests such a class by one bit look-up.
SEPARATORS = "[" + "".join(f"\\x{i:02X}" for i in range(128) if not chr(i).isalnum()) + "]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a window that must agree, and of a k-gram. The smallest hash of every
#: `SPAN - GRAM + 1` k-grams in a row is a fingerprint, so two texts that share `SPAN`
#: words share a fingerprint inside them.
SPAN, GRAM = 10, 5
#: Longs of the bit map that fingerprints of documents meet first: 128 KB at any size.
BITMAP_LONGS = 1 << 14
#: Largest table of windows that is broadcast; a larger one is joined by a shuffle.
MAX_BROADCAST_WINDOWS = 200_000


def words_of(text: Column) -> Column:
    """Words as they stand; null and wordless texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def _phrase(words: Column) -> Column:
    """Words as one string with A-Z lower-cased, to compare."""
    return F.translate(F.array_join(words, " "), UPPER, LOWER)


def _gram(hashes: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(hashes, at + j) for j in range(width)])


def _positions(count: Column, width: int) -> Column:
    """0 .. count - width, or an empty array."""
    last = count - width
    empty = F.array().cast("array<int>")
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(empty)


def _smallest(hashes: Column, at: Column) -> Column:
    """Smallest of the k-gram hashes in the window of `SPAN` words that starts at `at`."""
    return F.least(*[_gram(hashes, at + j, GRAM) for j in range(SPAN - GRAM + 1)])


def _kept(hashes: Column, at: Column) -> Column:
    """Whether winnowing keeps the k-gram at `at`: it is the smallest of some window."""
    first = F.greatest(at - (SPAN - GRAM), F.lit(0))
    starts = F.sequence(first, F.least(at, F.size(hashes) - SPAN))
    found = F.exists(starts, lambda j: _smallest(hashes, j) == _gram(hashes, at, GRAM))
    return F.when(F.size(hashes) >= SPAN, found).otherwise(False)


def _hashed(df: DataFrame) -> DataFrame:
    """Add word hashes. They are of words in lower case: words that differ in the case of
    A-Z share one, and whatever else does is told apart later."""
    return df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(F.lower(w))))


def _bit(x: Column) -> tuple[Column, Column]:
    """Word and bit of a hash in the bit map."""
    one = F.lit(1).cast("long")
    bit = F.call_function("shiftleft", one, x.bitwiseAND(63).cast("int"))
    return (F.shiftrightunsigned(x, 6) % BITMAP_LONGS).cast("int"), bit


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(window, n_words, print, items, words): each distinct window with its fingerprint, the
    ids of its items and the hashes of its words. Items without words have no window."""
    df = benchmark.select(F.col(item).alias("_item"), words_of(F.col(text)).alias("_words"))
    n = F.size("_words")
    wide = F.when(n >= SPAN, F.lit(SPAN)).otherwise(n)
    df = _hashed(df.filter(n > 0)).withColumn("n_words", wide)
    # A window of SPAN words is found by the smallest of its k-grams, a short item by all its words.
    short = F.array(*[F.when(n == m, _gram(F.col("_h"), F.lit(0), m)) for m in range(1, SPAN)])
    short = F.array(F.array_max(short))
    winnowed = F.transform(_positions(F.size("_h"), SPAN), lambda i: _smallest(F.col("_h"), i))
    prints = F.when(n >= SPAN, winnowed).otherwise(short)
    at = F.sequence(F.lit(0), n - F.col("n_words"))
    both = F.arrays_zip(at.alias("at"), prints.alias("print"))
    df = df.select("_item", "_words", "_h", "n_words", F.explode(both).alias("w"))
    place = F.col("w.at") + 1
    df = df.select(
        "_item",
        "n_words",
        F.col("w.print").alias("print"),
        _phrase(F.slice("_words", place, F.col("n_words"))).alias("window"),
        F.slice("_h", place, F.col("n_words")).alias("words"),
    )
    return df.groupBy("window", "n_words", "print").agg(
        F.sort_array(F.collect_set("_item")).alias("items"), F.first("words").alias("words")
    )


def _bitmap(windows: DataFrame) -> Column:
    """The bit map of all words and fingerprints as one literal; its size never grows."""
    place, bit = _bit(F.col("x"))
    marks = windows.select(F.explode(F.array_append("words", F.col("print"))).alias("x"))
    rows = marks.groupBy(place.alias("place")).agg(F.bit_or(bit).alias("bits")).collect()
    longs = [0] * BITMAP_LONGS
    for row in rows:  # BITMAP_LONGS rows at most
        longs[row.place] = row.bits
    # One string that the optimiser folds: a list of literals would be one expression for each.
    return F.split(F.lit(",".join(map(str, longs))), ",").cast("array<bigint>")


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per row of `docs`: `key`, `row` (its place), `n_words`, `hits`, `items`.

    `hits` holds (start, length) of every benchmark window that occurs among the words
    (counted from 0), `items` the sorted ids of the items they belong to. A window is `SPAN`
    words of an item, or a whole item of fewer. Null and empty texts have no words and
    no hits; null item ids count for hits and are left out of `items`; repeated rows are each
    reported; other columns are ignored. `docs` must be a table or a repeatable scan.

    Documents are read once. Every k-gram meets a bit map of the benchmark's
    words and fingerprints inside the row; what passes and is the smallest of a window goes on with the few words around it, is
    joined on the fingerprint's windows, and each window that holds it is compared word
    for word. Texts are never shuffled.
    """
    windows = benchmark_windows(benchmark, item, item_text).persist()
    try:
        lengths = [r.n_words for r in windows.select("n_words").distinct().collect()]  # 1 to SPAN
        bits = _bitmap(windows)
        few = windows.select("window").limit(MAX_BROADCAST_WINDOWS + 1).count() <= MAX_BROADCAST_WINDOWS
    finally:
        windows.unpersist()
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).alias("key"),
        words_of(F.col(text)).alias("_words"),
    )
    rows = _hashed(rows).withColumn("n_words", F.size("_words").cast("long"))
    rows = rows.withColumn("_in", F.transform("_h", lambda x: _known(bits, x)))
    seeds = [_seeds(bits, m) for m in sorted(lengths)]
    if not seeds:
        none = F.array().cast("array<struct<start:int,length:int>>")
        return rows.select("row", "key", "n_words", none.alias("hits"), F.array().cast("array<bigint>").alias("items"))
    empty = F.array().cast("array<struct<print:bigint,first:int,width:int,words:array<string>>>")
    rows = rows.select(
        "row", "key", "n_words", F.explode_outer(F.concat(*[F.coalesce(s, empty) for s in seeds])).alias("seed")
    )
    rows = _extend(rows, windows, few)
    found = F.collect_set(F.when(F.col("items").isNotNull(), F.struct("start", "length")))
    return rows.groupBy("row").agg(
        F.first("key").alias("key"),
        F.first("n_words").alias("n_words"),
        F.sort_array(found).alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def _seeds(bits: Column, width: int) -> Column:
    """Where windows of `width` words may lie: all words of a gram are words of the benchmark,
    the gram is a fingerprint of it and, in windows of `SPAN` words, one that winnowing keeps."""
    gram = GRAM if width == SPAN else width

    def may(i: Column) -> Column:
        known = F.get("_in", i)
        for j in range(1, gram):
            known = known & F.get("_in", i + j)
        found = F.when(known, _known(bits, _gram(F.col("_h"), i, gram))).otherwise(False)
        return F.when(found, _kept(F.col("_h"), i)).otherwise(False) if width == SPAN else found

    places = F.filter(_positions(F.size("_h"), gram), may)
    return F.transform(places, lambda i: _seed(_gram(F.col("_h"), i, gram), i, width - gram, width))


def _known(bits: Column, x: Column) -> Column:
    place, bit = _bit(x)
    return F.get(bits, place).bitwiseAND(bit) != 0


def _seed(value: Column, at: Column, around: int, width: int) -> Column:
    """A fingerprint with the words of every window that could hold it."""
    first = F.greatest(at - around, F.lit(0))
    take = at + width - first
    return F.struct(
        value.alias("print"),
        first.cast("int").alias("first"),
        F.lit(width).alias("width"),
        F.slice("_words", first + 1, take).alias("words"),
    )


def _extend(rows: DataFrame, windows: DataFrame, few: bool) -> DataFrame:
    """Join the fingerprints, then compare the windows around each hit word for word."""
    prints = windows.select(F.col("print").alias("_print"), F.lit(True).alias("_both")).distinct()
    shared = F.col("seed.print") == F.col("_print")
    rows = rows.join(F.broadcast(prints) if few else prints, shared, "left")
    width, words = F.col("seed.width"), F.col("seed.words")
    fits = F.col("_both") & (F.size(words) >= width)
    starts = F.when(fits, F.sequence(F.lit(0), F.size(words) - width))
    tried = F.transform(
        starts,
        lambda i: F.struct(
            (F.col("seed.first") + i).cast("int").alias("start"),
            _phrase(F.slice(words, i + 1, width)).alias("window"),
        ),
    )
    rows = rows.select("row", "key", "n_words", width.alias("length"), F.explode_outer(tried).alias("w"))
    rows = rows.select("row", "key", "n_words", "length", "w.start", "w.window")
    known = windows.groupBy("window").agg(F.flatten(F.collect_set("items")).alias("items"))
    return rows.join(F.broadcast(known) if few else known, "window", "left")


def n_hit(hits: Column) -> Column:
    """Words inside any hit."""
    spread = F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))
    return F.size(F.array_distinct(F.flatten(spread))).cast("long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.0, key: str = "doc_id") -> DataFrame:
    """Rows of `docs` of whose words at most `max_share` lie in benchmark windows.

    Each row is judged by its own text, also where a key repeats or is null; columns pass through
    whatever their names. The rows to drop are worked out here, once, into a table of the shared folder.
    """
    named = F.struct(F.col(key).alias("id"), F.md5("text").alias("digest"))
    hits = find_hits(docs.select(named.alias("named"), "text"), benchmark, key="named")
    bad = hits.filter(F.size("hits") > 0).filter(n_hit(F.col("hits")) > F.col("n_words") * max_share)
    path = scratch_path(docs.sparkSession, "contaminated")
    bad.select("key.id", "key.digest").distinct().write.parquet(path)
    its_id, its_digest = (wd.free_name(docs.columns, n) for n in ("_id", "_digest"))
    bad = docs.sparkSession.read.parquet(path).withColumnsRenamed({"id": its_id, "digest": its_digest})
    same = docs[key].eqNullSafe(F.col(its_id)) & F.md5(docs["text"]).eqNullSafe(F.col(its_digest))
    return docs.join(small_or_shuffle(bad, MAX_BROADCAST_WINDOWS), same, "left_anti")


def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text")
    found = find_hits(docs, benchmark)
    named = F.sort_array(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        F.col("key").alias("doc_id"),
        "n_words",
        n_hit(F.col("hits")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(named, ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


SQL = rf"""
WITH b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
bw AS (
    SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS win
    FROM (SELECT item_id, w, least({SPAN}, len(w)) AS m, unnest(range(1, len(w) - least({SPAN}, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
d AS (
    SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
dw AS (
    SELECT rid, m, s, array_to_string(w[s:s + m - 1], ' ') AS win
    FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d CROSS JOIN (SELECT DISTINCT m FROM bw))),
h AS (SELECT rid, s, m, item_id FROM dw JOIN bw USING (win, m)),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(s, s + m)) AS p FROM h) GROUP BY rid),
i AS (
    SELECT rid, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids
    FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN i USING (rid)
"""
