"""Best-fit packing of token pieces into sequences, by exact complements."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline.llm import words as wd
from siftline.session import scratch_path

CAPACITY = 4096
END_ID = 1
#: Pieces of one length are numbered in buckets of about so many, each bucket in a task.
BUCKET_ROWS = 50_000
#: Words whose ids a Python worker remembers before it starts anew.
CACHE_WORDS = 2_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# --- Tokens -----------------------------------------------------------------------------


def _byte_letters() -> list[str]:
    """Characters that stand for bytes in a byte-level vocabulary: printable bytes stand for
    themselves, the others for the characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


#: Line ends stay, they stand between words.
_LETTERS = {b: c for b, c in enumerate(_byte_letters()) if b != 10}
#: Letters and a tail of common marks: such a word is two pre-tokens, whatever stands around it.
_MARKS = ".,!?;:"
_PLAIN = re.compile(f"[a-zß-öø-ÿ]+[{_MARKS}]*")
# What a tokenizer file says if its texts can be encoded word by word.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _by_words(told: dict) -> bool:
    """Whether a tokenizer's ids of a text are those of its words in a row, as `WordEncoder` takes them."""
    normalizer, before = told["normalizer"] or {}, (told["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        normalizer.get("normalizers") == _NORMALIZER
        and [x["type"] for x in before] == ["Split", "ByteLevel"]
        and (before[0]["pattern"], before[0]["behavior"], before[0]["invert"]) == ({"Regex": _SPLIT}, "Removed", True)
        and not (before[1]["add_prefix_space"] or before[1]["use_regex"])
        and not any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in told["added_tokens"])
    )


class WordEncoder:
    """Ids of white-space separated words, remembered by hash.

    The tokenizer ends its pre-tokens at white space, and composing and lower-casing do
    not look across it either, so a text's ids are those of its words in a row. Plain words go
    to the model at once, all others through the whole tokenizer. Its control strings have ids of
    their own only as they stand, so words that hold one are told apart by their very bytes. Files of
    other kinds (`by_words` is false) are left to the tokenizer, a whole text at a time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.by_words = _by_words(told)
        control = [x["content"].encode() for x in told["added_tokens"]]
        self.control = re.compile(b"|".join(map(re.escape, control))) if control else None
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)  # hashes of the known words, sorted
        self.slot = np.empty(0, np.int64)  # the word's place in `first` and `size`
        self.tails: dict[str, list[int]] = {"": []}
        self.ids = np.empty(1 << 20, np.uint32)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.used = 0

    def _tail(self, marks: str) -> list[int]:
        found = self.tails.get(marks)
        if found is None:
            found = self.tails[marks] = [t.id for t in self.tokenizer.model.tokenize(marks)]
        return found

    def _encode(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """(ids of all words in a row, number of ids of each)."""
        raw = b"\n".join(words).decode("utf-8", "replace")
        low = raw.lower()
        seen = low.encode().decode("latin-1").translate(_LETTERS)
        ids: list[int] = []
        ends = []
        tokenize, plain = self.tokenizer.model.tokenize, _PLAIN.fullmatch
        for text, lower, shown in zip(raw.split("\n"), low.split("\n"), seen.split("\n"), strict=True):
            if plain(lower):
                stem = shown.rstrip(_MARKS)
                ids += [t.id for t in tokenize(stem)]
                ids += self._tail(shown[len(stem) :])
            else:
                ids += self.tokenizer.encode(text, add_special_tokens=False).ids
            ends.append(len(ids))
        return ids, ends

    def _hashes(self, data: np.ndarray, words: wd.Words) -> np.ndarray:
        """Hashes of the words; capitals count in those that hold a control string."""
        if self.control is None or not len(words.start):
            return words.hash
        low = int(words.start[0])
        raw = memoryview(data)[low : int(words.end[-1])]
        at = {int(np.searchsorted(words.start, low + m.start(), side="right")) - 1 for m in self.control.finditer(raw)}
        if not at:
            return words.hash
        out = words.hash.copy()
        for i in at:
            text = bytes(data[int(words.start[i]) : int(words.end[i])])
            out[i] = int.from_bytes(hashlib.blake2b(text, digest_size=8, key=b"control").digest(), "little")
        return out

    def window(self, data: np.ndarray, words: wd.Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        unique, first, place = np.unique(self._hashes(data, words), return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > max(CACHE_WORDS, len(unique)):
            self.clear()
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        slots = np.empty(len(unique), np.int64)
        slots[known] = self.slot[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            slots[new] = self._add(wd.word_texts(data, words.start[first[new]], words.end[first[new]]))
            self.keys = np.insert(self.keys, at[new], unique[new])
            self.slot = np.insert(self.slot, at[new], slots[new])
        mine = slots[place]
        size = self.size[mine]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.first[mine] - (ends - size), size)
        return self.ids[at], size

    def _add(self, texts: list[bytes]) -> np.ndarray:
        """Places of words that are new."""
        ids, ends = self._encode(texts)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        starts = np.array([0, *ends], np.int64)
        base = len(self.size)
        self.first = np.concatenate([self.first, self.used + starts[:-1]])
        self.size = np.concatenate([self.size, np.diff(starts)])
        self.used += len(ids)
        return np.arange(base, base + len(texts))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def doc_ids(column: pa.Array, enc: WordEncoder) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids without the end id) for every row of a batch."""
    if not enc.by_words:
        for row, text in enumerate(column):
            yield row, np.array(enc.tokenizer.encode(text.as_py() or "", add_special_tokens=False).ids, np.uint32)
        return
    offsets, data = wd.text_buffers(column)
    row, held = 0, []
    for words in wd.word_windows(offsets, data):
        if not len(words.doc):
            continue
        ids, size = enc.window(data, words)
        cuts = np.flatnonzero(np.diff(words.doc)) + 1
        parts = np.split(ids, np.cumsum(size)[cuts - 1])
        for part, doc in zip(parts, words.doc[np.r_[0, cuts]].tolist(), strict=True):
            while row < doc:
                yield row, np.concatenate(held) if held else ids[:0]
                row, held = row + 1, []
            held.append(part)
    while row < len(column):
        yield row, np.concatenate(held) if held else np.empty(0, np.uint32)
        row, held = row + 1, []


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of `capacity`; only the last is shorter.

    Columns as in `PIECES`, and `ids` (array of int) if asked for. A null or empty text is
    one piece of the end id alone; repeated rows are each cut; other columns are ignored. A control
    string of the tokenizer in a text has the id that a plain call gives it.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in wd.few(batches):
            keys = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for row, ids in doc_ids(batch.column(1), enc):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    out = (keys[row], piece, at, len(part), zlib.crc32(part.tobytes()))
                    rows.append((*out, part.astype(np.int32)) if with_ids else out)
            columns = list(zip(*rows, strict=True)) or [[] for _ in range(5 + with_ids)]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names=names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, schema)


# --- Plan -------------------------------------------------------------------------------


class _Stock:
    """Counts of pieces by length, and the lengths in stock as bits forwards and backwards."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.count = [0] * (capacity + 1)
        self.capacity, self.have, self.back = capacity, 0, 0
        for length, n in counts.items():
            self.put(length, n)

    def put(self, length: int, n: int) -> None:
        if not n:
            return
        before = self.count[length]
        self.count[length] += n
        if (before > 0) != (self.count[length] > 0):
            self.have ^= 1 << length
            self.back ^= 1 << (self.capacity - length)

    def largest(self, upto: int) -> int:
        """Largest length in stock of at most `upto`; 0 if there is none."""
        return max((self.have & ((2 << upto) - 1)).bit_length() - 1, 0) if upto > 0 else 0

    def single(self, gap: int) -> list[int] | None:
        return [gap] if self.count[gap] else None

    def pair(self, gap: int) -> list[int] | None:
        """Two lengths in stock that sum to `gap`, the longer as long as can be."""
        both = self.have & (self.back >> (self.capacity - gap)) & ((1 << gap) - 1)
        while both:
            a = both.bit_length() - 1
            if a < gap - a:
                return None
            if a != gap - a or self.count[a] > 1:
                return [a, gap - a]
            both ^= 1 << a
        return None

    def triple(self, gap: int) -> list[int] | None:
        a = self.largest(gap - 2)
        while 3 * a >= gap:
            self.put(a, -1)
            rest = self.pair(gap - a)
            self.put(a, 1)
            if rest:
                return [a, *rest]
            a = self.largest(a - 1)
        return None


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, number of such sequences), using up all counts.

    The longest piece in stock opens a sequence. The gap it leaves is looked up among single
    lengths, then sums of two, then of three; what fills it exactly is used, as often as stock
    allows. Where nothing does, the longest piece that fits goes in (best fit) and the smaller
    gap is looked up again. A pattern uses up some length, so there are at most `capacity`
    patterns, whatever the number of pieces.
    """
    stock, patterns = _Stock(counts, capacity), []
    while longest := stock.largest(capacity):
        used, gap = [], capacity
        add = [longest]
        while add:
            for length in add:
                stock.put(length, -1)
            used += add
            gap -= sum(add)
            if not gap:
                break
            add = stock.single(gap) or stock.pair(gap) or stock.triple(gap)
            if not add and (next_best := stock.largest(gap)):
                add = [next_best]
        for length in used:
            stock.put(length, 1)
        times = min(stock.count[x] // used.count(x) for x in set(used))
        for length in used:
            stock.put(length, -times)
        patterns.append((used, times))
    return patterns


def _slots(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Ranges of the numbers of pieces of a length, each with its sequences and its place there."""
    taken: dict[int, int] = {}
    rows, first = [], 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            low = taken.get(length, 0)
            taken[length] = low + times
            rows.append((length, low, first, offset))
            offset += length
        first += times
    rows.sort()
    names = ("length", "low", "sequence", "offset")
    return {k: np.array(v, np.int64) for k, v in zip(names, zip(*rows, strict=True), strict=True)} if rows else {}


# --- Placing ----------------------------------------------------------------------------


def _numbered(pieces: DataFrame, rows: int) -> DataFrame:
    """Number the pieces of each length from 0, with no task that sees a whole length."""
    buckets = max(1, -(-rows // BUCKET_ROWS))
    where = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")
    pieces = pieces.withColumn("_bucket", where)
    sums = pieces.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    upto = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("length", "_bucket", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    within = W.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    pieces = pieces.withColumn("_at", F.row_number().over(within) - 1)
    return pieces.join(sums, ["length", "_bucket"]).withColumn("number", F.col("_before") + F.col("_at"))


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add `sequence_id` and `offset` to a written table of pieces.

    Only the counts by length (at most `capacity` of them) come to the driver. The plan made of
    them says which numbers of each length go to which sequences; every piece looks its number up.
    """
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(plan_patterns(counts, capacity))
    columns = pieces.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    wide = max(counts.values(), default=0) + 1
    shared = pieces.sparkSession.sparkContext.broadcast(slots)

    def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot = shared.value
        keys = slot["length"] * wide + slot["low"] if slot else None
        for frame in frames:
            number = frame.pop("number").to_numpy()
            if len(frame):
                at = np.searchsorted(keys, frame["length"].to_numpy() * wide + number, side="right") - 1
                frame["sequence_id"] = slot["sequence"][at] + number - slot["low"][at]
                frame["offset"] = slot["offset"][at]
            else:
                frame["sequence_id"] = frame["offset"] = pd.Series(dtype="int64")
            yield frame

    numbered = _numbered(pieces, sum(counts.values())).select(*columns, "number")
    return numbered.mapInPandas(look_up, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Pack all documents into as few sequences of at most `capacity` tokens as it can.

    Columns of `token_pieces`, `sequence_id` (from 0) and `offset`. The pieces are written once
    to the shared folder, so no text is encoded twice and a lost executor costs its part.
    """
    spark = docs.sparkSession
    at = scratch_path(spark, "pieces")
    token_pieces(docs, path, capacity, key, with_ids).write.parquet(at)
    return place(spark.read.parquet(at), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): pieces with `ids` put together, one row per sequence."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    df = packed.groupBy("sequence_id").agg(parts.alias("p"))
    return df.select(
        "sequence_id",
        F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"),
        F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"),
    )


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file on this machine; every machine has its own copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return pack(docs, tokenizer_path())
