"""Repeated byte strings across documents, found with a sorted array of sampled suffixes.

A byte is removed if a string of LENGTH bytes that covers it also starts anywhere else. Suffixes are sampled by content: of the
suffixes that start in a string of LENGTH bytes and have GRAM bytes left in it, the one whose first GRAM bytes hash lowest. Equal strings
sample the same suffix, so no repeat is lost and about one suffix in 180 is left.

1. Spark's sampled splitters range-partition the suffixes by their leading bytes (with tie-breakers, so that equal ones can be split). A
   bucket sorts by multikey quicksort; a suffix stays if its leading bytes equal a neighbour's, also across a bucket's boundary.
2. A suffix's context is what a repeated string through it can touch: up to LENGTH - GRAM bytes before it, LENGTH bytes from it on. Equal
   contexts are merged and counted. Those that occur twice are repeats as a whole.
3. Different contexts with equal leading bytes are a class. A class is sorted both ways by multikey quicksort. Going down the tree of
   common beginnings, the neighbours in the other order give the longest common left part; left and right part of LENGTH bytes together
   are a repeat. That is exact, and each step touches a class's rows once.
4. A class above CLASS rows is split: the places a string can start at (relative to the suffix) are cut into ranges, and rows are
   classed anew by the bytes that all strings of a range share, merged by all bytes they touch. Passages that very many documents share
   merge there; a range of one place is a plain count. So no group is held whole by a task, and none is cut off.

The documents' texts travel twice: to cut the contexts out, and to remove the spans. Hashes are 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.rows import beside, spread, with_row
from tallyhouse.llm.storage import saved

LENGTH = 400
GRAM = 32
CLASS = 1024
SPLIT = (2, 8)  # parts of a range of starts, at first and later
GROUP = 1 << 19  # bytes of text whose suffixes are sampled at once
SMALL = 32
END = 0xFF  # no byte of UTF-8

_MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _gram_hashes(raw: bytes, n: int) -> np.ndarray:
    """32 bits for the GRAM bytes at each of the first n places; raw has GRAM + 8 bytes more."""
    words = np.empty(n + GRAM, dtype=np.uint64)
    for i in range(8):
        words[i::8] = np.frombuffer(raw, dtype="<u8", count=len(words[i::8]), offset=i)
    words *= _MIX[0]
    words ^= words >> np.uint64(32)
    out = words[:n].copy()
    for i in range(1, GRAM // 8):
        out *= _MIX[1]
        out += words[8 * i : 8 * i + n] * _MIX[2]
        out ^= out >> np.uint64(29)
    out *= _MIX[3]
    return out >> np.uint64(32)


def _lowest(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of `width` keys."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    forth = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], forth[width - 1 : width - 1 + n])


def sampled_places(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of the sampled suffixes: for each string of `length` bytes the first place of the lowest hash in it."""
    ends = np.cumsum([len(t) for t in texts])
    n = int(ends[-1]) if len(ends) else 0
    if n < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    raw = b"".join(texts) + bytes(GRAM + 8)
    keys = _gram_hashes(raw, n) << np.uint64(32) | np.arange(n, dtype=np.uint64)
    width = length - GRAM + 1
    first = _lowest(keys, width) & np.uint64(0xFFFFFFFF)
    change = np.zeros(n + 1, dtype=np.int8)
    for end, size in zip(ends.tolist(), map(len, texts), strict=True):
        if size >= length:
            change[end - size] += 1
            change[end - length + 1] -= 1
    inside = np.cumsum(change[: len(first)]).astype(bool)
    chosen = first[inside].astype(np.int64)
    chosen = chosen[np.append(True, chosen[1:] != chosen[:-1])] if len(chosen) else chosen
    text = np.searchsorted(ends, chosen, side="right")
    return text, chosen - (ends - [len(t) for t in texts])[text]


def _context(text: bytes, place: int, length: int = LENGTH) -> tuple[int, int]:
    return max(0, place - length + GRAM), min(len(text), place + length)


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= GROUP:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def sampled_suffixes(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, digest, place, lead, whole, before, after) of every sampled suffix; `keyed` has doc, digest and text.

    `lead` is its first GRAM bytes, `whole` a hash of its context, before and after the context's bytes on either side of the place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() for t in batch.column(2).cast(pa.binary())]
            for lo, hi in _groups(texts):
                own = texts[lo:hi]
                which, places = sampled_places(own, length)
                lead, whole, before, after = [], [], [], []
                for i, place in zip(which.tolist(), places.tolist(), strict=True):
                    text = own[i]
                    a, b = _context(text, place, length)
                    lead.append(text[place : place + GRAM])
                    whole.append(xxhash.xxh3_128_digest(text[a:b], seed=place - a))
                    before.append(place - a), after.append(b - place)
                rows = pa.array(which + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(places), pa.array(lead, pa.binary()), pa.array(whole, pa.binary()),
                     pa.array(before, pa.int32()), pa.array(after, pa.int32())], ["doc", "digest", "place", "lead", "whole", "before", "after"])

    return keyed.select("doc", "digest", "text").mapInArrow(run, "doc long, digest long, place long, lead binary, whole binary, before int, after int")


def multikey_quicksort(keys: np.ndarray) -> np.ndarray:
    """The order of the rows of `keys` (row, character) from the first character on.

    A range is parted by one character into lower, equal and higher rows; the equal ones go on with the next character.
    """
    order = np.arange(len(keys))
    todo = [(0, len(keys), 0)]
    while todo:
        lo, hi, at = todo.pop()
        while hi - lo > 1 and at < keys.shape[1]:
            own = order[lo:hi]
            if hi - lo <= SMALL:
                order[lo:hi] = own[np.lexsort(keys[own, at:].T[::-1])]
                break
            column = keys[own, at]
            pivot = np.sort(column[[0, len(column) // 2, -1]])[1]
            lower, equal = column < pivot, column == pivot
            higher = ~(lower | equal)
            order[lo:hi] = np.concatenate([own[lower], own[equal], own[higher]])
            a, b = lo + int(lower.sum()), hi - int(higher.sum())
            todo += [(lo, a, at), (b, hi, at)]
            lo, hi, at = a, b, at + 1
    return order


def _characters(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows of bytes, filled with END, and as rows of big-endian 8-byte characters."""
    rows = np.frombuffer(b"".join(s.ljust(width, bytes([END])) for s in strings), dtype=np.uint8).reshape(len(strings), width)
    return rows, rows.view(">u8").astype(np.uint64)


def repeated_leads(suffixes: DataFrame) -> DataFrame:
    """The suffixes whose leading bytes occur more than once."""
    tasks = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = suffixes.repartitionByRange(tasks, "lead", "whole", "digest", "place")
    names = suffixes.columns
    lead = names.index("lead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = [b for b in batches if b.num_rows]
        if not bucket:
            return
        table = pa.Table.from_batches(bucket)
        _, keys = _characters(table.column(lead).to_pylist(), GRAM)
        order = multikey_quicksort(keys)
        keys = keys[order]
        same = (keys[1:] == keys[:-1]).all(axis=1)
        sure = np.append(same, False) | np.append(False, same)
        edge = np.zeros(len(order), dtype=bool)
        edge[[0, -1]] = True
        kept = sure | edge
        out = table.take(pa.array(order[kept])).append_column("sure", pa.array(sure[kept])).append_column("edge", pa.array(edge[kept]))
        yield from out.combine_chunks().to_batches()

    types = ", ".join(f"{name} {kind}" for name, kind in suffixes.dtypes)
    found = saved(dealt.mapInArrow(run, f"{types}, sure boolean, edge boolean"), "suffixes")
    across = found.where("edge").groupBy("lead").agg(F.count("*").alias("_edges")).where("_edges > 1").select("lead")  # two rows a bucket at most
    return found.where("sure").drop("sure", "edge").union(found.where("edge and not sure").join(across, "lead", "left_semi").select(*names))


def _common(rows: np.ndarray, sizes: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Bytes that pairs of rows have in common from their beginning."""
    out = np.empty(len(one), dtype=np.int64)
    for lo in range(0, len(one), 4096):
        a, b = one[lo : lo + 4096], other[lo : lo + 4096]
        differ = rows[a] != rows[b]
        out[lo : lo + 4096] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(out, np.minimum(sizes[one], sizes[other]))


def shared_spans(classes: np.ndarray, before: list[bytes], after: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, left, right): row's context holds a repeat of `left` bytes before the place and `right` bytes from it on.

    Rows of one class have different contexts. Every string of `length` bytes through a row's place that another row of its class has at the
    same place lies in one of the row's spans, and spans hold no others.
    """
    width = -(-length // 8) * 8
    right, right_keys = _characters(after, width)
    left, left_keys = _characters([b[::-1] for b in before], width)
    right_size, left_size = np.array(list(map(len, after))), np.array(list(map(len, before)))
    left_rank = np.empty(len(classes), dtype=np.int64)
    left_rank[multikey_quicksort(left_keys)] = np.arange(len(classes))
    order = multikey_quicksort(np.column_stack([classes.astype(np.uint64), right_keys]))
    together = classes[order[1:]] == classes[order[:-1]]
    common = np.where(together, _common(right, right_size, order[1:], order[:-1]), -1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    cut = np.append(True, ~together)  # whether a node begins at a place of the order
    at = np.arange(len(order))
    while len(at):
        node = np.cumsum(cut[at]) - 1
        size = np.bincount(node)
        keep = size[node] > 1
        at, node = at[keep], node[keep]
        if not len(at):
            break
        begins = np.append(True, node[1:] != node[:-1])
        starts = np.flatnonzero(begins)
        node = np.cumsum(begins) - 1
        inner = np.where(begins, np.iinfo(np.int64).max, common[at - 1])  # with the place before, in the node
        depth = np.minimum.reduceat(inner, starts)[node]
        rows = order[at]
        by_left = np.lexsort((left_rank[rows], node))
        beside = node[by_left[1:]] == node[by_left[:-1]]
        pairs = np.where(beside, _common(left, left_size, rows[by_left[1:]], rows[by_left[:-1]]), -1)
        longest = np.empty(len(rows), dtype=np.int64)
        longest[by_left] = np.maximum(np.append(pairs, -1), np.append(-1, pairs))
        hit = longest + depth >= length
        found.append((rows[hit], longest[hit], depth[hit]))
        cut[at[~begins & (inner == depth)]] = True
        whole = depth >= width
        at = at[~whole]
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def class_spans(contexts: DataFrame, length: int = LENGTH) -> DataFrame:
    """The spans (whole, left, right) of contexts (class, whole, prior, rest) in classes that a task can hold.

    A context that is there twice counts once. A class lies in one range of Spark's range partitioner.
    """
    tasks = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = contexts.select("class", "whole", "prior", "rest").repartitionByRange(tasks, "class").sortWithinPartitions("class", "whole")

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        number = {c: i for i, c in enumerate(dict.fromkeys(r[0] for r in rows))}
        row, left, right = shared_spans(np.array([number[r[0]] for r in rows]), [r[2] for r in rows], [r[3] for r in rows], length)
        whole = pa.array([rows[i][1] for i in row.tolist()], pa.binary())
        return pa.RecordBatch.from_arrays([whole, pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))], ["whole", "left", "right"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(waiting) >= 4 * CLASS and row[0] != waiting[-1][0]:
                    yield solve(waiting)
                    waiting = []
                if not waiting or waiting[-1][:2] != row[:2]:
                    waiting.append(row)
        if waiting:
            yield solve(waiting)

    return dealt.mapInArrow(run, "whole binary, left int, right int")


def _solved(contexts: DataFrame, most: int, length: int) -> DataFrame:
    """`class_spans` of the classes of up to `most` rows, and the rows of larger ones as they are, with class, n, prior and rest filled instead
    of left and right. These are told by their size before the shuffle by class, so none of its tasks gets them.
    """
    some = class_spans(contexts.where(F.col("size") <= most), length)
    return some.unionByName(contexts.where(F.col("size") > most).select("whole", "class", "n", "prior", "rest"), allowMissingColumns=True)


def _ranges(rows: DataFrame, split: int, length: int) -> DataFrame:
    """Rows (whole, n, low, high, prior, rest) for each part of their range of starts: class, part and the bytes its strings touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for whole, n, low, high, prior, rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                step = -(-(high - low + 1) // split)
                for a in range(low, high + 1, step):
                    b = min(high, a + step - 1)
                    if len(prior) < a or len(rest) < length - b:  # no string of this range fits
                        continue
                    left, right = prior[max(0, len(prior) - b) :], rest[: length - a]
                    core = xxhash.xxh3_128_digest(left[len(left) - a :] + right[: length - b], seed=a * 4096 + b)
                    made.append((whole, n, a, b, core, xxhash.xxh3_128_digest(core + left + right, seed=len(left)), left, right))
                if len(made) >= 4096:
                    yield _batch(made)
                    made = []
            yield _batch(made)

    def _batch(made: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)],
                                          ["whole", "n", "low", "high", "class", "part", "prior", "rest"])

    chosen = rows.select("whole", "n", "low", "high", "prior", "rest")
    return chosen.mapInArrow(run, "whole binary, n long, low int, high int, class binary, part binary, prior binary, rest binary")


def _apart(rows: DataFrame, key: str) -> DataFrame:
    """Aggregated rows with their binary key as an expression: it is shuffled anew, so Spark can split the other side's hot keys in a join."""
    return rows.withColumn(key, F.concat(key, F.lit(b"")))


def _hot_spans(rows: DataFrame, most: int, length: int) -> DataFrame:
    """(whole, left, right) for rows (whole, n, prior, rest) of classes above `most`, by ranges of starts.

    The first cut in two tells lines that are merely common from long passages: strings of either half share half of `length`.
    """
    level, every, split = rows.withColumns({"low": F.lit(0), "high": F.lit(length - GRAM)}), None, SPLIT[0]
    while True:
        ranged = saved(_ranges(level, split, length), "ranges")
        split = SPLIT[1]
        parts = ranged.groupBy("class", "part", "low", "high").agg(
            F.sum("n").alias("n"), F.first("whole").alias("whole"), F.first("prior").alias("prior"), F.first("rest").alias("rest"))
        sizes = ranged.select("class", "part").distinct().groupBy("class").agg(F.count("*").alias("size"))
        parts = saved(parts.join(_apart(sizes, "class"), "class"), "parts")
        full = parts.where("n > 1").select("part", F.octet_length("prior").alias("left"), F.octet_length("rest").alias("right"))
        some = class_spans(parts.where((F.col("size") > 1) & (F.col("size") <= most)).withColumn("whole", F.col("part")), length)
        spans = full.unionByName(some.select(F.col("whole").alias("part"), "left", "right")).where(F.col("left") + F.col("right") >= length)
        mine = ranged.where("whole is not null").select("whole", "part").join(spans, "part").select("whole", "left", "right")
        every = mine if every is None else every.union(mine)
        # A part that occurs more than once is a repeat as a whole: one row of it goes on, without a name, for the others to meet.
        left = parts.where((F.col("size") > most) & (F.col("high") > F.col("low"))).withColumn("whole", F.when(F.col("n") == 1, F.col("whole")))
        level = saved(left.repartition("part"), "levels")  # a class is in one task here, its rows go on in many
        if level.isEmpty():
            return every


def repeated_spans(keyed: DataFrame, length: int = LENGTH, most: int = CLASS) -> DataFrame:
    """(digest, doc, spans): for the texts with repeats, unmerged (start, end) of strings that occur elsewhere too.

    `keyed` has digest (a hash of the text), doc (one of the document's id) and text. Neither is null, so that joins and groupings on
    them share a shuffle. Rows equal in both count as two texts and share one result.
    """
    suffixes = saved(sampled_suffixes(keyed, length), "sampled")
    places = saved(repeated_leads(suffixes), "repeated")
    first = F.min(F.struct("digest", "doc", "place")).alias("at")
    merged = places.groupBy("lead", "whole", "before", "after").agg(F.count("*").alias("n"), first)
    sizes = merged.groupBy("lead").agg(F.count("*").alias("size"))
    merged = saved(merged.join(_apart(sizes, "lead"), "lead"), "contexts")
    full = merged.where((F.col("n") > 1) & (F.col("before") + F.col("after") >= length)).select("whole", F.col("before").alias("left"), F.col("after").alias("right"))
    asked = merged.where("size > 1").select("at.digest", "at.doc", F.struct("at.place", "lead", "whole", "n", "size").alias("cut"))
    asked = asked.groupBy("digest", "doc").agg(F.collect_list("cut").alias("cuts"))
    once = keyed.join(asked, ["digest", "doc"]).select("text", "cuts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, cuts in zip(batch.column(0).cast(pa.binary()), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes()
                for c in cuts.as_py():
                    a, b = _context(data, c["place"], length)
                    made.append((c["lead"], c["whole"], c["n"], c["size"], data[a : c["place"]], data[c["place"] : b]))
                if len(made) >= 4096:
                    yield batch_of(made)
                    made = []
            yield batch_of(made)

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)], ["class", "whole", "n", "size", "prior", "rest"])

    contexts = once.mapInArrow(cut, "class binary, whole binary, n long, size long, prior binary, rest binary")
    solved = saved(_solved(contexts, most, length), "spans")
    spans = full.union(solved.where("left is not null").select("whole", "left", "right"))
    hot = solved.where("left is null").select("whole", "class", "n", "prior", "rest").dropDuplicates(["class", "whole"])
    if not hot.isEmpty():
        spans = spans.union(_hot_spans(hot, most, length))
    # Spans of one context all hold its place, so together they are one span.
    by_context = spans.groupBy("whole").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    own = F.struct((F.col("place") - F.col("left")).cast("int").alias("start"), (F.col("place") + F.col("right")).cast("int").alias("end"))
    reached = places.select("doc", "digest", "place", "whole").join(_apart(by_context, "whole"), "whole").select("digest", "doc", own.alias("span"))
    return reached.groupBy("digest", "doc").agg(F.collect_list("span").alias("spans"))


def without_repeats(documents: DataFrame, columns: list[str], doc: str = "doc_id", text: str = "text", length: int = LENGTH, most: int = CLASS,
                    as_text: bool = False) -> DataFrame:
    """The given columns of every document with kept (binary), the text's bytes less the removed ones, and spans, the maximal
    removed runs as (start, end), in order. With `as_text`, kept is a string without the rest of characters that were cut through.

    A null text counts as empty. Texts below `length` bytes lose nothing. All copies of a text lose the same; none is spared.
    Documents may share an id or have none.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    keys = {"digest": F.xxhash64(content), "doc": F.xxhash64(doc, F.col(doc).isNull())}
    found = repeated_spans(documents.select(*(h.alias(name) for name, h in keys.items()), content.alias("text")), length, most)
    told = beside(documents, columns, **keys, text=content)
    joined = told.join(found, ["digest", "doc"], "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans = [], []
            for content, found in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                data, runs = content.as_buffer().to_pybytes(), []
                if found.is_valid:
                    flat = found.values
                    start, end = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                    order = np.lexsort((end, start))
                    start, end = start[order], np.maximum.accumulate(end[order])
                    new = np.append(True, start[1:] > end[:-1])
                    runs = list(zip(start[new].tolist(), end[np.append(new[1:], True)].tolist(), strict=True))
                edges = [0, *(x for run in runs for x in run), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"start": a, "end": b} for a, b in runs])
            whole = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            made = [whole, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["row", "kept", "spans"])

    return spread(joined.mapInArrow(run, with_row(joined, f"kept {'string' if as_text else 'binary'}, spans array<struct<start:long,end:long>>")))
