"""Benchmark decontamination with suffix arrays over shards of the training documents.

Each slice of an Arrow batch is a shard. Its suffix array lists all word positions that a benchmark word begins, in the order
of the words that follow (sorted by prefix doubling, as deep as the longest item). Every suffix of every benchmark item is
binary-searched in it, one word deeper at a time, so the interval of suffixes that share its first words narrows until no
more follow: the last interval is where the longest verbatim matches stand, and the interval at the window's length holds
the window's occurrences. Words are numbered by the benchmark's vocabulary; those of every hit are compared byte by byte.

One pass over the documents and no shuffle. A benchmark of more than BLOCK_WORDS words comes in blocks, each one
broadcast (bounded by its words) for a pass of its own that adds its hits to those of the passes before.

Null and empty texts have no words and are never hit. Repeated rows are judged alike. An item with fewer than WINDOW words is
one window; an item without words never occurs; items of one id are one item. Very long texts are a shard of their own. Without
documents there are no rows, without items no hits. Other columns are not read by `contamination`; `without_contaminated`
carries them along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import ALNUM, Words, in_arrow, word_slices, written

WINDOW = 10
#: Benchmark words in one block: about 100 bytes a word. More words make more blocks.
BLOCK_WORDS = 500_000
#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20

_MATCH = "struct<item_id:string, doc_word:long, item_word:long, length:long>"
REPORT = f"doc_id long, n_words long, n_hit long, n_items long, items array<string>, longest array<{_MATCH}>"
#: What passes before the last one hand on: the words hit so far, as begin and end of each run, and the longest matches.
_CARRIED = f"doc_id long, text string, runs array<long>, longest array<{_MATCH}>"
_ARROW_MATCH = pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("length", pa.int64())])


@dataclass
class Hits:
    """Occurrences of windows in a shard: first word there, window length, item, its first word, and length of the match from there on."""

    at: np.ndarray
    window: np.ndarray
    item: np.ndarray
    word: np.ndarray
    length: np.ndarray


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of numbers above 1, ordered by what follows (0 ends a document): by at least `depth` numbers."""
    rank, known = text, 1
    while known < depth:
        follow = np.zeros(len(rank), np.int64)
        follow[:-known] = rank[known:]
        key = rank * (int(rank.max(initial=0)) + 1) + follow
        order = np.argsort(key)
        step = np.append(False, key[order[1:]] != key[order[:-1]])
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(step) if len(key) else 0
        known *= 2
        if step[1:].all():
            break
    own = np.flatnonzero(text > 1)
    return own[np.argsort(rank[own])]


def _bisect(column, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """For each range [low, high) of a sorted column, the first place whose value is not below (right: above) the wanted one."""
    low, high = low.copy(), high.copy()
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        value = column(middle, open_)
        before = value <= wanted[open_] if right else value < wanted[open_]
        low[open_[before]] = middle[before] + 1
        high[open_[~before]] = middle[~before]
    return low


class Block:
    """Some benchmark items: their vocabulary and all their suffixes."""

    def __init__(self, items: list[tuple[str, list[bytes], np.ndarray]], window: int = WINDOW):
        """items: name, words and word hashes."""
        self.names = [name for name, _, _ in items]
        every = np.concatenate([h for _, _, h in items]) if items else np.zeros(0, np.uint64)
        self.hashes, first, number = np.unique(every, return_index=True, return_inverse=True)
        flat = [w for _, words, _ in items for w in words]
        #: The words by number, from 2 on; 1 stands for all other words.
        self.words = [b"", b"", *(flat[k] for k in first)]
        sizes = np.array([len(words) for _, words, _ in items], dtype=np.int64)
        self.depth = int(sizes.max(initial=0))
        self.item = np.repeat(np.arange(len(items)), sizes)
        self.word = np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.room = np.repeat(sizes, sizes) - self.word
        #: Length of the window that a suffix begins, 0 if none.
        self.window = np.where(self.room >= window, window, np.where(self.word == 0, self.room, 0))
        self.ids = np.append(number + 2, 0)

    def search(self, words: Words) -> Hits:
        """All occurrences of windows in a shard, each with the length of its match."""
        where = np.minimum(np.searchsorted(self.hashes, words.hash), max(0, len(self.hashes) - 1))
        ids = np.where(self.hashes[where] == words.hash, where + 2, 1) if len(self.hashes) else np.ones(len(words), np.int64)
        # a 0 after each document, which no item holds
        own = np.arange(len(words)) + words.doc()
        text = np.zeros(len(words) + len(words.bounds) - 1 + 1, np.int64)
        text[own] = ids
        order = suffix_array(text, self.depth)
        column = lambda depth: lambda middle, _: text[order[middle] + depth]
        patterns = np.arange(len(self.item))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(order), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for depth in range(self.depth):
            wanted = self.ids[patterns + depth]
            low, high = _bisect(column(depth), low, high, wanted, False), _bisect(column(depth), low, high, wanted, True)
            live = low < high
            patterns, low, high = patterns[live], low[live], high[live]
            if len(whole := np.flatnonzero(self.window[patterns] == depth + 1)):
                found.append((patterns[whole], low[whole], high[whole]))
            going = self.room[patterns] > depth + 1
            patterns, low, high = patterns[going], low[going], high[going]
            if not len(patterns):
                break
        pattern, first, size = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*((p, a, b - a) for p, a, b in found), strict=True) if found else ((), (), ())))
        number = np.repeat(np.arange(len(pattern)), size)
        at = order[np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
        pattern = pattern[number]
        length = self.window[pattern].copy()
        going = np.flatnonzero(self.room[pattern] > length)
        while len(going):
            going = going[text[at[going] + length[going]] == self.ids[pattern[going] + length[going]]]
            length[going] += 1
            going = going[self.room[pattern[going]] > length[going]]
        place = np.cumsum(text > 0) - 1  # from positions with the zeros back to words
        hits = Hits(place[at], self.window[pattern], self.item[pattern], self.word[pattern], length)
        return self._confirmed(words, ids, hits)

    def _confirmed(self, words: Words, ids: np.ndarray, hits: Hits) -> Hits:
        """The hits whose words are the item's, byte by byte; matches that run on end before a word that is another."""
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, hits.at, 1)
        np.add.at(cover, hits.at + hits.length, -1)
        used = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        wrong = np.array([k for k in used.tolist() if words.data[words.begin[k] : words.end[k]].tobytes() != self.words[ids[k]]], dtype=np.int64)
        if len(wrong):
            stop = np.append(wrong, len(words))[np.searchsorted(wrong, hits.at)]
            hits.length = np.minimum(hits.length, stop - hits.at)
            good = hits.length >= hits.window
            hits = Hits(*(x[good] for x in (hits.at, hits.window, hits.item, hits.word, hits.length)))
        return hits


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The items with words, as blocks of at least block_words words (the last one fewer); item by item, never the whole table at once."""
    items: list[tuple[str, list[bytes], np.ndarray]] = []
    held = 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        for _, _, _, words in word_slices(pa.array([row.text], pa.string()), ALNUM):
            if len(words):
                raw, begin, end = words.normal()
                items.append((row.item_id or "", [raw[i:j] for i, j in zip(begin, end, strict=True)], words.hash))
                held += len(words)
        if held >= block_words:
            yield Block(items, window)
            items, held = [], 0
    if items:
        yield Block(items, window)


def _longest(block: Block, words: Words, hits: Hits) -> list[list[dict]]:
    """For each document of a shard, the longest match of each item: the first of the longest."""
    doc = words.doc()[hits.at]
    order = np.lexsort((hits.at, -hits.length, hits.item, doc))
    head = order[np.append(True, (np.diff(doc[order]) != 0) | (np.diff(hits.item[order]) != 0))] if len(order) else order
    out: list[list[dict]] = [[] for _ in range(len(words.bounds) - 1)]
    for k in head.tolist():
        d = int(doc[k])
        out[d].append({"item_id": block.names[hits.item[k]], "doc_word": int(hits.at[k] - words.bounds[d]), "item_word": int(hits.word[k]), "length": int(hits.length[k])})
    return out


def _merged(found: list[dict]) -> list[dict]:
    """One match for each item id, by id."""
    best: dict[str, dict] = {}
    for x in found:
        y = best.get(x["item_id"])
        if y is None or (-x["length"], x["doc_word"], x["item_word"]) < (-y["length"], y["doc_word"], y["item_word"]):
            best[x["item_id"]] = x
    return [best[k] for k in sorted(best)]


def _runs(hit: np.ndarray) -> list[int]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge.tolist()


def _pass(frame: DataFrame, shared, last: bool) -> DataFrame:
    """One block's hits, added to the runs and matches of the passes before; the last pass gives the report."""

    def shards(batches):
        block = shared.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            before, matches = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for a, b, _, words in word_slices(texts, ALNUM, SHARD_BYTES):
                hits = block.search(words)
                cover = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(cover, hits.at, 1)
                np.add.at(cover, hits.at + hits.window, -1)
                for d in range(a, b):
                    for begin, end in zip(before[d][::2], before[d][1::2], strict=True):
                        cover[words.bounds[d - a] + begin] += 1
                        cover[words.bounds[d - a] + end] -= 1
                hit = np.cumsum(cover[:-1]) > 0
                longest = [_merged(matches[a + d] + own) for d, own in enumerate(_longest(block, words, hits))]
                match_list = pa.array(longest, pa.list_(_ARROW_MATCH))
                if not last:
                    runs = [_runs(hit[words.bounds[d] : words.bounds[d + 1]]) for d in range(b - a)]
                    yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), texts.slice(a, b - a), pa.array(runs, pa.list_(pa.int64())), match_list], names=["doc_id", "text", "runs", "longest"])
                    continue
                total = np.append(0, np.cumsum(hit))
                items = [[x["item_id"] for x in own] for own in longest]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a), pa.array(np.diff(words.bounds), pa.int64()), pa.array(total[words.bounds[1:]] - total[words.bounds[:-1]], pa.int64()),
                        pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())), match_list,
                    ],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items", "longest"],
                )

    return in_arrow(frame, shards, REPORT if last else _CARRIED)


def _passes(benchmark: DataFrame, frame: DataFrame, one, **options) -> DataFrame:
    """one(frame, broadcast block, whether it is the last) for block after block; before a block is let go, its pass is written."""
    context = benchmark.sparkSession.sparkContext
    block = None
    for block_after in benchmark_blocks(benchmark, **options):
        if block is not None:
            shared = context.broadcast(block)
            frame = written(one(frame, shared, False))
            shared.destroy()
        block = block_after
    return one(frame, context.broadcast(block if block is not None else Block([])), True)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: words, words inside an occurrence of a benchmark window, items that occur, and each such item's longest verbatim match."""
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.array().cast("array<long>").alias("runs"), F.array().cast(f"array<{_MATCH}>").alias("longest"))
    return _passes(benchmark, frame, _pass, window=window, block_words=block_words)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents in which no benchmark window occurs, with their own columns, judged in the same pass that reads them."""

    def one(frame: DataFrame, shared, last: bool) -> DataFrame:
        def clean(batches):
            block = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for a, _, _, words in word_slices(batch.column(batch.schema.get_field_index("text")), ALNUM, SHARD_BYTES):
                    keep[a + words.doc()[block.search(words).at]] = False
                yield batch.filter(pa.array(keep))

        return in_arrow(frame, clean, frame.schema)

    return _passes(benchmark, docs, one, window=window, block_words=block_words)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: contamination of every document by the benchmark table, as digests."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    report = contamination(read("documents"), read("benchmark"))
    return report.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark
), sized AS (
  SELECT item, w, least({WINDOW}, len(w)) AS n FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM sized, unnest(generate_series(1, len(w) - n + 1)) AS t(i)
), docs AS (
  SELECT doc_id, {_SQL_WORDS} AS w FROM documents
), doc_windows AS (
  SELECT doc_id, i AS p, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM docs, (SELECT DISTINCT n FROM windows) AS s, unnest(generate_series(1, len(w) - n + 1)) AS t(i) WHERE len(w) >= n
), hits AS (
  SELECT DISTINCT doc_id, p, doc_windows.n, item FROM doc_windows JOIN windows ON doc_windows.n = windows.n AND doc_windows.g = windows.g
), hit_words AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS x FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hits GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN hit_items i ON d.doc_id = i.doc_id
"""
