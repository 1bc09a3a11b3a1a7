"""Substring deduplication with prefix-partitioned suffix trees.

Suffixes are the windows of WINDOW words. They are split into groups by prefix keys of variable length: the key of a window is the
smallest hash among its sequences of P words, so neighbouring windows share a key and travel together as one segment of a
document's words, and equal windows have equal keys. P is the first of PREFIXES; a key that more than GROUP_SEGMENTS distinct
segments have is too large for memory and its windows are keyed again by the next longer P. At last P is the window itself, where
segments of one key are runs of one word and at most SEGMENT of them differ. So every group fits in memory and every suffix goes
through a tree. Keys met in one document only cannot repeat across documents and are dropped.

Equal segments (128-bit digest of the words themselves) are one entry, however many documents hold them: the document with the
smallest id stands for all, and the others lose the whole segment; where that document has it again, what its first place loses
goes there too. The entries of a group make a suffix tree, kept as a suffix
array with the lengths of shared prefixes, over exact words. Its deep internal nodes, those of WINDOW words or more, are
the maximal repeats (`maximal_repeats`); below the shallowest deep node above a suffix are all suffixes with its window, and
the smallest doc_id among them is the document that keeps the passage.

A word is removed if a window over it also starts in a document with a smaller doc_id, judged on the input. Null and empty
texts have no words; texts of fewer than WINDOW words lose none; repeats inside one document stay. Rows with the same doc_id
count as one document; a null doc_id has no order, so such documents neither lose words nor take any. Very long texts are
read whole, a slice of their own. An empty table gives no rows; other columns are not read.

Memory of a task: a block of groups has at most GROUP_SEGMENTS entries and the largest group, so 2 * GROUP_SEGMENTS segments of at
most SEGMENT + WINDOW - 1 words; with 8 bytes a word for each of some ten arrays about 80 MB.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import PLAIN, grams, in_arrow, joined, signed, sliding_min, split_by_ids, word_slices, written

WINDOW = 50
#: Words of the prefix that a key is made of; each longer one for the keys that are too large with the one before.
PREFIXES = (16, 32, WINDOW)
#: Windows in one segment at most.
SEGMENT = 64
#: Distinct segments in a group at most.
GROUP_SEGMENTS = 4_000

_CONTENT = ["content_a", "content_b"]
_SEGMENTS = "doc_id long, key long, content_a long, content_b long, start int, n int"


def _within(n_words: int, ranges: list[dict]) -> np.ndarray:
    """Which windows of a document are in the ranges."""
    change = np.zeros(n_words + 1, dtype=np.int64)
    for r in ranges:
        change[r["start"]] += 1
        change[r["start"] + r["n"]] -= 1
    return np.cumsum(change[:-1]) > 0


def segments(docs: DataFrame, prefix: int) -> DataFrame:
    """Every segment of every document, without its words; where docs has a list of `ranges`, those of the windows in them."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            ranges = batch.column(2).to_pylist() if batch.num_columns > 2 else None
            for a, b, _, words in word_slices(batch.column(1), PLAIN):
                wanted = np.arange(len(words)) + WINDOW <= words.limit()
                if ranges is not None:
                    for d in range(a, b):
                        own = slice(words.bounds[d - a], words.bounds[d - a + 1])
                        wanted[own] &= _within(own.stop - own.start, ranges[d])
                at = np.flatnonzero(wanted)
                if not len(at):
                    continue
                key, doc = sliding_min(grams(words.hash, prefix), WINDOW - prefix + 1)[at], words.doc()[at]
                new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (np.diff(at) != 1))
                first = np.flatnonzero(new)
                within = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
                first = np.flatnonzero(within % SEGMENT == 0)
                n = np.diff(np.append(first, len(at)))
                begin = at[first]
                raw, word_begin, word_end = words.normal()
                digests = b"".join(hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(word_begin[begin].tolist(), word_end[begin + n + WINDOW - 2].tolist(), strict=True))
                content = np.frombuffer(digests, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[a + doc[first]], pa.int64()), pa.array(signed(key[first]), pa.int64()), pa.array(np.ascontiguousarray(content[:, 0])), pa.array(np.ascontiguousarray(content[:, 1])),
                        pa.array(begin - words.bounds[doc[first]], pa.int32()), pa.array(n, pa.int32()),
                    ],
                    names=["doc_id", "key", *_CONTENT, "start", "n"],
                )

    return in_arrow(docs, run, _SEGMENTS)


def _with_ranges(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, text and the list of (key, start, n) that rows have of each document."""
    lists = written(rows.groupBy("doc_id").agg(F.collect_list(F.struct("key", "start", "n")).alias("ranges")))
    # lists grow with the corpus, so they are never broadcast; only texts that may have one are shuffled
    likely, _ = split_by_ids(docs, lists.select("doc_id"))
    return likely.join(lists.hint("merge"), "doc_id").select("doc_id", "text", "ranges")


def entries(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Words of the wanted segments (doc_id, key, start, n), joined by single spaces."""

    def run(batches):
        for batch in batches:
            ids, ranges = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out: list[tuple] = []
            for a, b, _, words in word_slices(batch.column(1), PLAIN):
                raw, begin, end = words.normal()
                for d in range(a, b):
                    base, most = int(words.bounds[d - a]), int(words.bounds[d - a + 1])
                    for r in ranges[d]:
                        last = base + r["start"] + r["n"] + WINDOW - 2
                        if last < most:  # rows with one doc_id may have other texts
                            out.append((r["key"], ids[d], r["start"], r["n"], raw[begin[base + r["start"]] : end[last]]))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "doc_id", "start", "n", "words"])

    return in_arrow(_with_ranges(docs, wanted), run, "key long, doc_id long, start int, n int, words binary")


@dataclass
class Trees:
    """Suffix trees of some groups: ranks of all word positions by doubling prefix lengths, and the suffixes that begin a window."""

    ranks: dict[int, np.ndarray]
    #: For each suffix: its place in the words, its entry and its window there.
    place: np.ndarray
    entry: np.ndarray
    window: np.ndarray
    #: Words left to each suffix in its entry.
    room: np.ndarray

    def shared(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Length of the prefix that two places share, as far as either's entry goes."""
        out = np.zeros(len(left), np.int64)
        size = len(self.ranks[1])
        for length in sorted((k for k in self.ranks if not k & (k - 1)), reverse=True):
            own = self.ranks[length]
            a, b = np.minimum(left + out, size - 1), np.minimum(right + out, size - 1)
            out += np.where(own[a] == own[b], length, 0)
        return out


def grown(segments_: list[tuple[int, int, int, bytes]]) -> Trees:
    """Trees over (doc_id, start, n, words): exact words are numbered, 0 ends an entry, and ranks double in length up to all that an entry can have."""
    number: dict[bytes, int] = {}
    ids, sizes = [], []
    for _, _, _, words in segments_:
        own = words.split(b" ")
        sizes.append(len(own))
        ids += [number.setdefault(w, len(number) + 1) for w in own]
        ids.append(0)
    sizes, n = np.array(sizes), np.array([x[2] for x in segments_])
    ranks, length = {1: np.array(ids, np.int64)}, 1

    def joint(left: np.ndarray, right: np.ndarray, by: int) -> np.ndarray:
        follow = np.zeros(len(left), np.int64)
        follow[:-by] = right[by:]
        key = left * (int(right.max()) + 1) + follow
        order = np.argsort(key)
        out = np.empty(len(key), np.int64)
        out[order] = np.cumsum(np.append(0, key[order[1:]] != key[order[:-1]]))
        return out

    while 2 * length < SEGMENT + WINDOW and 2 * length < len(ids):
        ranks[2 * length] = joint(ranks[length], ranks[length], length)
        length *= 2
    if WINDOW not in ranks:
        whole = max(k for k in ranks if k <= WINDOW)
        ranks[WINDOW] = joint(ranks[whole], ranks[whole], WINDOW - whole)
    first = np.cumsum(sizes + 1) - sizes - 1
    entry = np.repeat(np.arange(len(n)), n)
    window = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
    return Trees(ranks, first[entry] + window, entry, window, sizes[entry] - window)


def least_documents(segments_: list[tuple[int, int, int, bytes]], trees: Trees) -> np.ndarray:
    """For each suffix, the smallest document below the shallowest deep node above it: of all suffixes that share its WINDOW words."""
    docs = np.array([x[0] for x in segments_], np.int64)[trees.entry]
    node = trees.ranks[WINDOW][trees.place]
    order = np.lexsort((docs, node))
    first = np.append(True, node[order[1:]] != node[order[:-1]])
    out = np.empty(len(docs), np.int64)
    out[order] = docs[order[first]][np.cumsum(first) - 1]
    return out


def deep_nodes(segments_: list[tuple[int, int, int, bytes]], trees: Trees):
    """(depth, suffixes, first suffix) of every internal node of WINDOW words or more whose suffixes are not all preceded by one word: the maximal repeats."""
    by = max(k for k in trees.ranks if not k & (k - 1))
    further = np.minimum(trees.place + by, len(trees.ranks[1]) - 1)
    order = np.lexsort((trees.ranks[by][further], trees.ranks[by][trees.place], trees.ranks[WINDOW][trees.place]))
    place, room = trees.place[order], trees.room[order]
    depth = np.minimum(trees.shared(place[:-1], place[1:]), np.minimum(room[:-1], room[1:]))
    before = np.where(trees.window[order] > 0, trees.ranks[1][place - 1], -1 - np.arange(len(place)))  # what precedes an entry is not known: different
    open_nodes: list[list] = []  # depth, first suffix, and the one word before all suffixes so far (None if they differ)
    for k in range(len(place)):
        d = int(depth[k]) if k < len(depth) else 0
        start, word = k, int(before[k])
        while open_nodes and open_nodes[-1][0] > d:
            level, start, own = open_nodes.pop()
            word = own if own == word else None
            if word is None:
                yield level, order[start : k + 1]
        if open_nodes and open_nodes[-1][0] == d:
            if open_nodes[-1][2] != word:
                open_nodes[-1][2] = None
        elif d >= WINDOW:
            open_nodes.append([d, start, word])


def _blocks(batches):
    """Entries of whole groups, at least GROUP_SEGMENTS of them but for the last."""
    key, block = None, []
    for batch in batches:
        for k, doc_id, start, n, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key and len(block) >= GROUP_SEGMENTS:
                yield block
                block = []
            key = k
            block.append((doc_id, start, n, words))
    if block:
        yield block


def _grouped(entries_: DataFrame) -> DataFrame:
    n = int(entries_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return entries_.repartition(n, "key").sortWithinPartitions("key")


def _found(entries_: DataFrame) -> DataFrame:
    """Windows of the entries' documents that an earlier document has too: doc_id, start, windows."""

    def run(batches):
        for block in _blocks(batches):
            trees = grown(block)
            least = least_documents(block, trees)
            own = np.array([x[0] for x in block], np.int64)[trees.entry]
            gone = np.flatnonzero(least < own)
            new = np.append(True, (np.diff(gone) != 1) | (np.diff(trees.entry[gone]) != 0)) if len(gone) else np.zeros(0, bool)
            first = gone[new]
            windows = np.diff(np.append(np.flatnonzero(new), len(gone)))
            start = np.array([x[1] for x in block], np.int64)[trees.entry[first]] + trees.window[first]
            yield pa.RecordBatch.from_arrays([pa.array(own[first], pa.int64()), pa.array(start, pa.int32()), pa.array(windows, pa.int32())], names=["doc_id", "start", "windows"])

    return in_arrow(_grouped(entries_), run, "doc_id long, start int, windows int")


def partitioned(docs: DataFrame, group_segments: int = GROUP_SEGMENTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(copies, again, groups): segments that repeat a whole segment of an earlier document, as doc_id, start and windows; those that their own
    document has before, as doc_id, level, place, start and n; and the distinct segments of all groups, as doc_id, key, start and n."""
    copies = again = groups = None
    active = docs
    for level, prefix in enumerate(PREFIXES):
        every = written(segments(active, prefix))
        keys = written(every.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key"))
        shared = written(joined(every, keys, "key", "left_semi"))
        distinct = written(shared.groupBy("key", *_CONTENT).agg(F.min(F.struct("doc_id", "start", "n")).alias("x"), F.count("*").alias("rows")).select("key", *_CONTENT, "x.*", "rows"))
        # only contents that several rows have can have copies
        heads = written(distinct.where("rows > 1").select("key", *_CONTENT, F.col("doc_id").alias("head"), F.col("start").alias("place")))
        met = written(joined(shared, heads, ["key", *_CONTENT], "inner").where("doc_id > head or start > place").select("doc_id", "start", "n", "head", "place"))
        own = met.where("doc_id > head").select("doc_id", "start", F.col("n").alias("windows"))
        same = met.where("doc_id = head").select("doc_id", F.lit(level).alias("level"), "place", "start", "n").distinct()
        copies, again = (own, same) if copies is None else (copies.unionByName(own), again.unionByName(same))
        crowded = written(distinct.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > group_segments).select("key"))
        if prefix == PREFIXES[-1] or crowded.isEmpty():
            crowded = None
        fits = distinct if crowded is None else joined(distinct, crowded, "key", "left_anti")
        fits = fits.select("doc_id", "key", "start", "n")
        groups = fits if groups is None else groups.unionByName(fits)
        if crowded is None:
            return copies, again, groups
        active = _with_ranges(docs, joined(distinct, crowded, "key", "left_semi"))
    raise AssertionError("the last prefix is the window")


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")


def repeats(docs: DataFrame, group_segments: int = GROUP_SEGMENTS) -> DataFrame:
    """Windows that also start in an earlier document: doc_id, a list of (start, windows), and a list of (level, place, start, n): what the n windows from place on lose is lost from start on too (see lost)."""
    docs = _identified(docs)
    copies, again, groups = partitioned(docs, group_segments)
    none = F.lit(None).cast("struct<level:int,place:int,start:int,n:int>")
    found = _found(entries(docs, groups)).unionByName(copies).select("doc_id", F.struct("start", "windows").alias("run"), none.alias("again"))
    found = found.unionByName(again.select("doc_id", F.lit(None).cast("struct<start:int,windows:int>").alias("run"), F.struct("level", "place", "start", "n").alias("again")))
    # nulls are not collected; a document that has passages again but loses none needs no list
    return found.groupBy("doc_id").agg(F.collect_list("run").alias("windows"), F.collect_list("again").alias("again")).where("size(windows) > 0")


def maximal_repeats(docs: DataFrame, group_segments: int = GROUP_SEGMENTS) -> DataFrame:
    """The deep internal nodes of all trees that no word before extends: doc_id and start of the earliest place, n_words, and the distinct segments that hold it (copies of a segment count once).

    A repeat longer than a segment is met once for each segment that it crosses, cut where the segments end.
    """
    docs = _identified(docs)

    def run(batches):
        for block in _blocks(batches):
            trees, out = grown(block), []
            for depth, suffixes in deep_nodes(block, trees):
                doc, start = min((block[e][0], block[e][1] + int(w)) for e, w in zip(trees.entry[suffixes].tolist(), trees.window[suffixes], strict=True))
                out.append((doc, start, depth, len(set(trees.entry[suffixes].tolist()))))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int32(), pa.int64()], strict=True)], names=["doc_id", "start", "n_words", "n_segments"])

    return in_arrow(_grouped(entries(docs, partitioned(docs, group_segments)[2])), run, "doc_id long, start int, n_words int, n_segments long")


def lost(n: int, windows: list[dict], again: list[dict]) -> np.ndarray:
    """Which of a document's n words are removed."""
    change = np.zeros(n + 1, dtype=np.int64)
    for w in windows:
        change[min(n, w["start"])] += 1
        change[min(n, w["start"] + w["windows"])] -= 1
    gone = np.cumsum(change[:-1]) > 0
    for x in sorted(again, key=lambda x: -x["level"]):
        own = gone[x["start"] : x["start"] + x["n"]]
        own |= gone[x["place"] : x["place"] + x["n"]][: len(own)]
    at = np.flatnonzero(gone)
    cover = np.zeros(n + 1, dtype=np.int64)
    cover[at] += 1
    np.add.at(cover, np.minimum(at + WINDOW, n), -1)
    return np.cumsum(cover[:-1]) > 0


def deduplicated(docs: DataFrame, group_segments: int = GROUP_SEGMENTS) -> DataFrame:
    """doc_id, the number of words, of removed words, the digest and the text of what is kept (words joined by one space)."""
    found = written(repeats(docs, group_segments))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def run(batches):
        for batch in batches:
            n_words, n_removed, digests, texts = [], [], [], []
            for text, own, again in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                words = (text or "").encode().split()
                kept = words if not own else [w for w, out in zip(words, lost(len(words), own, again).tolist(), strict=True) if not out]
                joint = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(joint).hexdigest())
                texts.append(joint.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    likely, others = split_by_ids(docs, found.select("doc_id"))
    marked = likely.join(found.hint("merge"), "doc_id", "left").select("doc_id", "text", "windows", "again")
    none = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("windows", "again")]
    return in_arrow(marked.unionByName(others.select("doc_id", "text", *none)), run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: what each document keeps once passages of earlier documents are removed."""
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")


ORACLE = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ')) AS g FROM docs, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS t(i) WHERE len(w) >= {WINDOW}
), earliest AS (
  SELECT g, min(doc_id) AS low FROM windows GROUP BY g
), removed AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + {WINDOW - 1})) AS p FROM windows JOIN earliest ON windows.g = earliest.g WHERE low < doc_id
), placed AS (
  SELECT doc_id, p, w[p] AS word FROM docs, unnest(generate_series(1, len(w))) AS t(p) WHERE len(w) > 0
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM placed ANTI JOIN removed USING (doc_id, p) GROUP BY doc_id
), gone AS (
  SELECT doc_id, count(*) AS n FROM removed GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN gone g ON d.doc_id = g.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
