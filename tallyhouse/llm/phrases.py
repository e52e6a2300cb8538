"""Phrase collocations per language: frequent n-grams by mergeable Misra-Gries summaries, counted exactly in a second pass, scored by their weakest cut.

1. `segments`: texts, A-Z lowered and blanks made single, are stored in chunks of about CHUNK bytes; a text above SEGMENT is cut between
   words and the next segment repeats the last words, so a chunk is bounded whatever the texts are.
2. First pass. Words and phrases of up to LONGEST words are hashed with their language. A chunk's n-grams go, as sorted hashes with counts, to the hash
   partition that the hash names; there are as many partitions as the corpus has MASS bytes, so a partition's mass is bounded, however large the corpus. There they merge into a
   Misra-Gries summary (Agarwal et al., 2012): entries beyond its capacity make every count fall by the next highest one. The capacity exceeds
   the partition's mass divided by the threshold, so an n-gram that occurs `threshold` times is never lost; what fell is known, so entries
   that cannot reach the threshold any more go. Hashes that collide only let more through.
3. The partition then tells each chunk which of its own hashes are left.
4. Second pass. Chunks meet these answers, and only what passed is counted, by its real language and words, and summed over chunks. No set of
   n-grams is broadcast or held whole anywhere.

Cuts, scores and the test of longer candidates are joins of the counts with themselves, in exact decimals. Per language n counts all word
occurrences. Null texts are empty, a null language is `und` (together with that label). Texts without words and empty tables give no rows. Repeated
rows count as often as they are there. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyhouse.llm.storage import saved

LONGEST = 3  # words of a phrase
THRESHOLD = 10  # occurrences of a candidate
SHARE = 50  # percent of a candidate's occurrences within one longer candidate that drop it
TOP = 2000  # of a language
SCALE = 1_000_000
CHUNK = 8 << 20  # bytes
SEGMENT = 4 << 20  # bytes of text handled at once
MASS = 1 << 24  # bytes of text for each hash partition; an n-gram takes two thirds of a byte of it at least
ROOM = 4  # the capacity of a summary, in units of mass / threshold
UNKNOWN = "und"
_WITHIN = (1 << 32) - 1  # the part of a chunk's number that counts within its writing task

# Fixed by the task: what ends a piece, what parts words, what is lowered.
ENDS = re.compile(rb"[.,;:!?\x0A-\x0D]")
PARTS = b" \t"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

_KIND = np.zeros(256, dtype=np.uint8)  # 0 in a word, 1 between words, 2 ends a piece
_KIND[[i for i in range(256) if ENDS.match(bytes([i]))]] = 2
_KIND[list(PARTS)] = 1
_BYTES = np.random.default_rng(13).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE, _ODD = 0x9E3779B97F4A7C15, [np.uint64(k) for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def normalized(text: bytes) -> bytes:
    """A-Z lowered; tabs and runs of blanks are one blank, so a phrase's words lie one blank apart."""
    text = text.translate(LOWER).replace(b"\t", b" ")
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


def cut(text: bytes, size: int = SEGMENT) -> Iterator[tuple[int, bytes]]:
    """(repeated, segment): a text in segments of about `size` bytes that end with a word. Each starts with the last LONGEST - 1 words
    of the one before, and `repeated` says how many these are, so that every phrase lies whole in a segment and ends anew in one only.
    """
    lo, repeated = 0, 0
    while len(text) - lo > size:
        starts, ends, _ = words_of(text[lo : lo + size])
        whole = len(ends) - (len(ends) > 0 and int(ends[-1]) == size)  # the last one may go on
        if whole <= LONGEST:  # very long words: nothing would be gained
            size *= 2
            continue
        yield repeated, text[lo : lo + int(ends[whole - 1])]
        lo, repeated = lo + int(starts[whole - LONGEST + 1]), LONGEST - 1
    yield repeated, text[lo:]


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word starts and ends, and the number of its piece."""
    kind = _KIND[np.frombuffer(raw, dtype=np.uint8)]
    edges = np.diff(np.concatenate([[1], kind != 0, [1]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    return starts, ends, np.cumsum(kind == 2, dtype=np.int32)[starts] if len(raw) else starts


_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]  # of the base and of its inverse, as far as needed so far


def _power(which: int, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        base = np.uint64(_BASE if which == 0 else pow(_BASE, -1, 1 << 64))
        _powers[which] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, SEGMENT), base)]))
    return _powers[which]


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits per word: a polynomial of its bytes, from sums over the text so far."""
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[np.frombuffer(raw, dtype=np.uint8)] * _power(0, len(raw))[: len(raw)], out=sums[1:])
    return (sums[ends] - sums[starts]) * _power(1, len(raw))[starts]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


class Buffer:
    """Segments of one language, one after the other: the places of their n-grams, and their keys."""

    def __init__(self, lang: str, segments: list[tuple[int, bytes]]):
        self.raw = b"\n".join(s for _, s in segments)
        self.starts, self.ends, self.piece = words_of(self.raw)
        offsets = np.cumsum([0] + [len(s) + 1 for _, s in segments])[:-1]
        first = np.searchsorted(self.starts, offsets)
        self.fresh = np.ones(len(self.starts), dtype=bool)
        for at, (repeated, _) in zip(first.tolist(), segments, strict=True):
            self.fresh[at : at + repeated] = False
        self.lang, self.seed = lang, np.uint64(xxhash.xxh64_intdigest(lang))

    def words(self) -> int:
        return int(self.fresh.sum())

    def grams(self, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, first, keys) for each size: the first words of the n-grams that end anew here, and their hash partitions and hashes."""
        single = word_hashes(self.raw, self.starts, self.ends)
        running = np.full(len(single), self.seed)
        for size in range(1, LONGEST + 1):
            n = len(single) - size + 1
            if n <= 0:
                return
            running = _mixed(running[:n] * _ODD[2] + single[size - 1 :])
            first = np.flatnonzero((self.piece[:n] == self.piece[size - 1 :]) & self.fresh[size - 1 :])
            found = running[first]
            part = ((found >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            yield size, first, part << np.uint64(32) | (found & np.uint64(0xFFFFFFFF))

    def phrases(self, first: np.ndarray, size: int) -> pa.Array:
        lo, hi = self.starts[first], self.ends[first + size - 1]
        offsets = np.concatenate([[0], np.cumsum(hi - lo)])
        places = np.arange(offsets[-1]) + np.repeat(lo - offsets[:-1], hi - lo)
        data = np.frombuffer(self.raw, dtype=np.uint8)[places]
        return pa.Array.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def _buffers(segments: list[tuple[str, int, bytes]]) -> Iterator[Buffer]:
    """The segments by language, in buffers of about SEGMENT bytes."""
    waiting: dict[str, list[tuple[int, bytes]]] = {}
    size: dict[str, int] = {}
    for lang, repeated, text in segments:
        waiting.setdefault(lang, []).append((repeated, text))
        size[lang] = size.get(lang, 0) + len(text)
        if size[lang] >= SEGMENT:
            yield Buffer(lang, waiting.pop(lang))
            del size[lang]
    for lang, own in waiting.items():
        yield Buffer(lang, own)


def totals(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the sum of the counts (one each by default) of each."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    if counts is None:
        return keys[at], np.diff(np.append(at, len(keys)))
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


class Summary:
    """A Misra-Gries summary: keys with counts that are too low by `lost` at most. Merging summaries adds what each has lost."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._waiting.append((keys, counts.astype(np.int64)))
        if sum(len(k) for k, _ in self._waiting) >= self.capacity:
            self.settle()

    def merge(self, other: Summary) -> None:
        other.settle()
        self.lost += other.lost
        self.add(other.keys, other.counts)

    def settle(self) -> None:
        """Bring what waits into the summary; beyond the capacity all counts fall by the highest that has no place."""
        if not self._waiting:
            return
        parts = [(self.keys, self.counts), *self._waiting]
        self.keys, self.counts = totals(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        self._waiting = []
        if len(self.keys) > self.capacity:
            fall = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            kept = self.counts > fall
            self.keys, self.counts, self.lost = self.keys[kept], self.counts[kept] - fall, self.lost + fall

    def reaching(self, threshold: int) -> np.ndarray:
        """The keys whose true count may be the threshold or more."""
        self.settle()
        return self.keys[self.counts + self.lost >= threshold]


def _among(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which keys are in `ordered`. A small table of their last bits rules most of the others out."""
    if not len(ordered):
        return np.zeros(len(keys), dtype=bool)
    table = np.zeros(1 << 20, dtype=bool)
    table[ordered.astype(np.uint64) & np.uint64((1 << 20) - 1)] = True
    found = table[keys.astype(np.uint64) & np.uint64((1 << 20) - 1)]
    at = np.flatnonzero(found)
    place = np.minimum(np.searchsorted(ordered, keys[at]), len(ordered) - 1)
    found[at] = ordered[place] == keys[at]
    return found


def segments(documents: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(chunk, lang, repeated, text, size) of all texts that have a byte, stored. A chunk is what one task wrote in a row, of about CHUNK bytes."""
    told = documents.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text")).where(F.octet_length("text") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            rows, held = [], 0
            for of, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                for repeated, segment in cut(normalized(value.as_buffer().to_pybytes())):
                    if size >= CHUNK:
                        chunk, size = chunk + 1, 0
                    rows.append((chunk, of, repeated, segment, len(segment)))
                    size, held = size + len(segment), held + len(segment)
                    if held >= CHUNK:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)

    return saved(told.mapInArrow(run, "chunk long, lang string, repeated int, text binary, size long"), "segments")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    chunk, lang, repeated, text, size = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(lang, pa.string()), pa.array(repeated, pa.int32()), pa.array(text, pa.binary()), pa.array(size, pa.int64())],
                                      ["chunk", "lang", "repeated", "text", "size"])


def gram_counts(stored: DataFrame, parts: int) -> DataFrame:
    """(part, chunk, keys, counts): the n-grams of each chunk, by hash partition, as sorted 32-bit hashes and counts of 32 bits."""

    def told(chunk: int, found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not found:
            return
        keys, counts = totals(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]))
        which = (keys >> np.uint64(32)).astype(np.int64)
        own = np.unique(which)
        edges = np.append(np.searchsorted(which, own), len(keys))
        low, counts = keys.astype(np.uint32), counts.astype(np.uint32)
        cells = [[a[lo:hi].tobytes() for lo, hi in zip(edges[:-1], edges[1:], strict=True)] for a in (low, counts)]
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.full(len(own), chunk)), pa.array(cells[0], pa.binary()), pa.array(cells[1], pa.binary())],
                                         ["part", "chunk", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _chunks(batches, lambda row: (row[1], row[2], row[3])):
            found = [totals(np.concatenate(keys)) for buffer in _buffers(rows) if (keys := [k for _, _, k in buffer.grams(parts)])]
            yield from told(chunk, found)

    return stored.select("chunk", "lang", "repeated", "text").mapInArrow(run, "part int, chunk long, keys binary, counts binary")


def _chunks(batches: Iterator[pa.RecordBatch], kept) -> Iterator[tuple[int, list]]:
    """The rows of each chunk; those of one chunk follow each other."""
    chunk, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != chunk and rows:
                yield chunk, rows
                rows = []
            chunk = row[0]
            rows.append(kept(row))
    if rows:
        yield chunk, rows


def surviving_keys(counted: DataFrame, parts: int, threshold: int = THRESHOLD, room: int = ROOM) -> DataFrame:
    """(chunk, keys): for every chunk its n-grams, as 64-bit keys, that may occur `threshold` times in all."""
    dealt = counted.repartition(parts, "part").sortWithinPartitions("part", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _chunks(batches, lambda row: (row[1], np.frombuffer(row[2], dtype=np.uint32), np.frombuffer(row[3], dtype=np.uint32))):
            mass = sum(int(counts.sum(dtype=np.int64)) for _, _, counts in rows)
            summary = Summary(room * mass // threshold + 1)
            for _, keys, counts in rows:
                summary.add(keys, counts)
            left = summary.reaching(threshold)
            told = [(chunk, keys[_among(keys, left)].astype(np.uint64) | np.uint64(part << 32)) for chunk, keys, _ in rows]
            told = [(chunk, keys.tobytes()) for chunk, keys in told if len(keys)]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in told], pa.int64()), pa.array([k for _, k in told], pa.binary())], ["chunk", "keys"])

    return dealt.select("part", "chunk", "keys", "counts").mapInArrow(run, "chunk long, keys binary")


def exact_counts(stored: DataFrame, answers: DataFrame, parts: int, threshold: int = THRESHOLD) -> DataFrame:
    """(lang, size, phrase, f), stored: every n-gram of up to LONGEST words that occurs `threshold` times, and size 0 with all word occurrences."""
    both = stored.select("chunk", F.lit(1).alias("kind"), "lang", "repeated", "text").unionByName(
        answers.select("chunk", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("lang"), F.lit(0).alias("repeated"), F.col("keys").alias("text")))
    tasks = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = (stored.agg(F.max(F.col("chunk").bitwiseAND(_WITHIN))).first()[0] or 0) + 1  # chunks of a writing task at most
    number = F.shiftright("chunk", 32) * each + F.col("chunk").bitwiseAND(_WITHIN)  # so that tasks get chunks in equal numbers
    dealt = both.repartitionById(tasks, F.pmod(number, F.lit(tasks)).cast("int")).sortWithinPartitions("chunk", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _chunks(batches, lambda row: row[1:]):
            wanted = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *(np.frombuffer(r[3], dtype=np.uint64) for r in rows if r[0] == 0)]))
            by_language: dict[str, list[Buffer]] = {}
            for buffer in _buffers([r[1:] for r in rows if r[0] == 1]):
                by_language.setdefault(buffer.lang, []).append(buffer)
            for lang, own in by_language.items():
                found: list[list[pa.Array]] = [[] for _ in range(LONGEST + 1)]
                words = 0
                for buffer in own:
                    words += buffer.words()
                    for size, first, keys in buffer.grams(parts):
                        found[size].append(buffer.phrases(first[_among(keys, wanted)], size))
                yield _counted(lang, 0, pa.array([b""]), pa.array([words], pa.int64()))
                for size, arrays in enumerate(found):
                    if arrays:
                        values = pc.value_counts(pa.chunked_array(arrays))
                        yield _counted(lang, size, values.field(0), values.field(1))

    each = dealt.mapInArrow(run, "lang string, size int, phrase binary, f long")
    summed = each.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where(F.expr(f"f >= {threshold} or size = 0"))
    return saved(summed.withColumn("phrase", F.col("phrase").cast("string")), "phrase-counts")


def _counted(lang: str, size: int, phrases: pa.Array, counts: pa.Array) -> pa.RecordBatch:
    n = len(phrases)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, size, dtype=np.int32)), phrases.cast(pa.binary()), counts.cast(pa.int64())],
                                      ["lang", "size", "phrase", "f"])


def _wide(column: str) -> Column:
    return F.col(column).cast("decimal(18,0)")


def scored(counts: DataFrame, share: int = SHARE, scale: int = SCALE) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates of 2 words or more that no longer one takes too large a part of."""
    phrases = counts.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"), "w").select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"))
    known = counts.where("size > 0")
    joined = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(
        known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    joined = joined.withColumn("_square", F.lit(scale).cast("decimal(7,0)") * (_wide("a") * _wide("a"))).withColumn("_product", _wide("l") * _wide("r"))
    worst = joined.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("_square div _product").alias("score"), "k", "l", "r")).alias("cut"))
    runs = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")))))
    inside = phrases.where(F.size("w") > 2).select("lang", "a", runs.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    found = worst.join(inside, ["lang", "phrase"], "left").where(F.expr(f"_longer is null or cast(100 as decimal(9,0)) * _longer < cast({share} as decimal(9,0)) * a"))
    return found.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(documents: DataFrame, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, top: int = TOP, mass: int = MASS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases by score, number of occurrences, and the phrase itself."""
    stored = segments(documents, text, lang)
    parts = max(1, -(-(stored.agg(F.sum("size")).first()[0] or 0) // mass))
    answers = saved(surviving_keys(gram_counts(stored, parts), parts, threshold), "phrase-keys")
    counts = exact_counts(stored, answers, parts, threshold)
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    first = scored(counts).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    words = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return first.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
