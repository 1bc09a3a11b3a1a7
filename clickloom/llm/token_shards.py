"""Token ids in compressed binary shards.

File format (all numbers little-endian): magic `LOOMZID1`, 32 bytes SHA-256 of the zstandard dictionary, then one
zstandard frame per document (its ids as unsigned 32-bit integers, compressed alone with the shared dictionary), then the
index, three columns of 64-bit integers: doc_id, byte offset of the frame, number of ids; then the number of documents and
the offset of the index. So a reader of one short document reads the tail, the index and one frame. The dictionary stands
beside the shards, named by its hash. It is trained on serialized id arrays of a bounded sample of documents.

Shards follow ascending doc_id: documents are range-partitioned once and each range is cut into files of bounded size. A
shard is written under a name of its own attempt and renamed when whole; only shards that a finished task reported are read,
so repeated or lost tasks do no harm. Null and empty texts hold the end id alone. A null doc_id sorts first; repeated rows
are separate documents in text order. Very long texts are encoded whole and are one frame; other columns are not read; an empty
table gives no shard.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.llm.common import gaps, held, in_arrow, shared_dir, without_gc

MAGIC = b"LOOMZID1"
END_ID = 2
#: Stands for a null doc_id in an index.
NULL_ID = -(1 << 63)
#: The dictionary is trained on at most so many documents, and on at most so many ids of each, in runs of RUN_IDS spread evenly over the whole document.
SAMPLE_DOCS, SAMPLE_IDS, RUN_IDS = 2_000, 2_000, 250
DICTIONARY_BYTES = 64 << 10
LEVEL = 1
#: A shard is closed when it has this many bytes.
SHARD_BYTES = 32 << 20
#: Words, and runs of letters, in a Python worker's table. A full table becomes the old one, in the place of the one before, and what is met
#: again moves to the new one, so frequent words stay. A word whose letters are known costs no call of the library.
TABLE_WORDS, TABLE_RUNS = 220_000, 220_000

SHARDS = "shard_key long, part long, path string, n_docs long, n_ids long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A run of letters that the tokenizer keeps whole and lower-cases as Python does, then marks that it keeps whole too.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:|$%&*#]*)")


class Encoder(dict):
    """Ids of a text as bytes. The tokenizer drops white space, so words between ASCII white space are encoded apart, each distinct one once by the library.

    Most words are letters and closing marks; the tokenizer cuts between the two. New runs of letters go to the library in one
    call, where each is one pre-token, so the ids' pre-token numbers tell the runs apart.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        #: Matched in a text before case is folded.
        self.added = tuple(x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        self.end = struct.pack("<I", END_ID)
        self.runs: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.old_runs: dict[str, bytes] = {}

    def _apart(self, words: list[str]) -> Iterator[bytes]:
        for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False):
            ids = x.ids
            yield struct.pack(f"<{len(ids)}I", *ids)

    def _letters(self, runs: list[str]) -> None:
        for at in range(0, len(runs), 20_000):
            own = runs[at : at + 20_000]
            x = self.tokenizer.encode(" ".join(own), add_special_tokens=False)
            number = np.array(x.word_ids, dtype=np.int64)
            if len(number) and number[-1] != len(own) - 1:
                raise ValueError("the tokenizer cuts runs of letters")
            raw, bounds = np.array(x.ids, "<u4").tobytes(), (4 * np.searchsorted(number, np.arange(len(own) + 1))).tolist()
            self.runs.update((run, raw[bounds[k] : bounds[k + 1]]) for k, run in enumerate(own))

    def _make_room(self) -> None:
        """Before a batch looks anything up, so that what it finds stays."""
        if len(self) > TABLE_WORDS:
            self.old = dict(self)
            self.clear()
        if len(self.runs) > TABLE_RUNS:
            self.old_runs, self.runs = self.runs, {"": b""}

    def learn(self, new: set[str]) -> None:
        plain, other, runs, old = [], [], self.runs, self.old
        for word in new:
            if (known := old.get(word)) is not None:
                self[word] = known
                continue
            if (m := _PLAIN.fullmatch(word)) is not None:
                low = m[1].lower()
                plain.append((word, word if low == word else low, m[2]))  # one object for both tables
            else:
                other.append(word)
        self.update(zip(other, self._apart(other), strict=True))
        marks = list({x[2] for x in plain}.difference(runs))
        runs.update(zip(marks, self._apart(marks), strict=True))
        lacking = {x[1] for x in plain}.difference(runs)
        if self.old_runs:
            met = lacking.intersection(self.old_runs)
            runs.update((x, self.old_runs[x]) for x in met)
            lacking -= met
        self._letters(list(lacking))
        self.update((word, runs[letters] + runs[mark]) for word, letters, mark in plain)

    def count(self, texts: list[str | None]) -> list[int]:
        """Number of ids of each text, without the end id."""
        words = [words_of(t, self.added) for t in texts]
        with without_gc():
            self._make_room()
            if new := set().union(*words).difference(self):
                self.learn(new)
            return [sum(map(len, map(self.__getitem__, own))) // 4 for own in words]

    def encode(self, texts: list[list[str]]) -> list[bytes]:
        """Ids of each text, the end id last; what the table lacks is learned together."""
        with without_gc():
            return self._encoded(texts)

    def _encoded(self, texts: list[list[str]]) -> list[bytes]:
        self._make_room()
        found = [list(map(self.get, words)) for words in texts]
        holes = [list(gaps(own)) for own in found]
        if new := {words[k] for words, own in zip(texts, holes, strict=True) for k in own}:
            self.learn(new)
            for words, own, at in zip(texts, found, holes, strict=True):
                for k in at:
                    own[k] = self[words[k]]
        return [b"".join(own) + self.end for own in found]


def encoder_for(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return held("tokenizer", path, lambda: Encoder(path))


_SEPARATORS = tuple("\x1c\x1d\x1e\x1f")


def words_of(text: str | None, added: tuple[str, ...] = ()) -> list[str]:
    """Words between white space, all of which the tokenizer drops; Python's split also drops four control characters that the tokenizer keeps.

    added: the tokenizer's added tokens, which it matches before it folds case: a text keeps its case if folding it shows one.
    """
    if not text:
        return []
    if any(c in text for c in _SEPARATORS):
        return [x for x in re.split("[ \t\n\r]+", text) if x]
    if text.isascii() or _latin(text):
        low = text.lower()  # as the tokenizer does; capital and small spellings are looked up once
        if not any(x in low for x in added):
            text = low
    return text.split()


def _latin(text: str) -> bool:
    """Whether all characters are Latin-1, which Python and the tokenizer lower-case alike."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _files(uri: str):
    """(file system, path) of a folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _spread(ids: bytes) -> bytes:
    """At most SAMPLE_IDS of a document's serialized ids: all, or runs from its whole length."""
    n = len(ids) // 4
    if n <= SAMPLE_IDS:
        return ids
    runs = SAMPLE_IDS // RUN_IDS
    starts = [k * (n - RUN_IDS) // (runs - 1) for k in range(runs)]
    return b"".join(ids[4 * at : 4 * (at + RUN_IDS)] for at in starts)


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """A dictionary from the documents with the smallest hashes of their ids; empty where there is too little to train on."""
    import zstandard

    # the smallest hashes are found on the ids alone; texts are read for these few
    smallest = F.broadcast(docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS))
    sample = docs.join(smallest, "doc_id", "left_semi").limit(SAMPLE_DOCS)

    def ids(batches):
        encoder = encoder_for(tokenizer)
        for batch in batches:
            words = [words_of(x, encoder.added) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_spread(x) for x in encoder.encode(words)], pa.binary())], names=["ids"])

    arrays = [bytes(r.ids) for r in in_arrow(sample.select("text"), ids, "ids binary", "tokenizer").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


class _Writer:
    """One shard: frames go straight to the file, the index follows."""

    def __init__(self, folder: str, dictionary: bytes):
        import zstandard

        self.files, self.folder = _files(folder)
        self.name = f"{self.folder}/{uuid.uuid4().hex}"
        self.out = self.files.open_output_stream(self.name + ".tmp")
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared is not None:
            shared.precompute_compress(level=LEVEL)  # else every frame digests the dictionary
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=False)
        self.out.write(MAGIC + hashlib.sha256(dictionary).digest())
        self.at, self.ids, self.offsets, self.counts = len(MAGIC) + 32, [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.pack.compress(ids)
        self.out.write(frame)
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.offsets.append(self.at)
        self.counts.append(len(ids) // 4)
        self.at += len(frame)

    def close(self) -> tuple[str, int, int]:
        for column in (self.ids, self.offsets, self.counts):
            self.out.write(np.array(column, "<i8").tobytes())
        self.out.write(struct.pack("<QQ", len(self.ids), self.at))
        self.out.close()
        self.files.move(self.name + ".tmp", self.name + ".zid")
        return self.name + ".zid", len(self.ids), sum(self.counts)


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, partitions: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode the documents into shards under folder; one row per shard, in doc_id order by (shard_key, part)."""
    tokenizer = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    files, path = _files(folder)
    files.create_dir(path, recursive=True)
    dictionary = train_dictionary(docs, tokenizer)
    with files.open_output_stream(f"{path}/{hashlib.sha256(dictionary).hexdigest()}.dict") as out:
        out.write(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)  # at most DICTIONARY_BYTES

    def write(batches):
        encoder, writer, done, key = encoder_for(tokenizer), None, [], None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for first in range(0, len(ids), 256):
                words = [words_of(x, encoder.added) for x in texts.slice(first, 256).to_pylist()]
                for doc_id, own in zip(ids[first : first + 256], encoder.encode(words), strict=True):
                    if writer is None:
                        writer = _Writer(folder, shared.value)
                        key = (NULL_ID if doc_id is None else doc_id) if key is None else key
                    writer.add(doc_id, own)
                    if writer.at >= shard_bytes:
                        done.append(writer.close())
                        writer = None
        if writer is not None:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(done), pa.int64()), pa.array(range(len(done)), pa.int64()), pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())],
                names=["shard_key", "part", "path", "n_docs", "n_ids"],
            )

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return in_arrow(docs.repartitionByRange(n, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text"), write, SHARDS, "tokenizer")


def _index(source, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    tail = source.read_at(16, size - 16)
    n, at = struct.unpack("<QQ", tail)
    columns = np.frombuffer(source.read_at(24 * n, at), "<i8").reshape(3, n)
    head = source.read_at(len(MAGIC) + 32, 0)
    if head[: len(MAGIC)] != MAGIC:
        raise ValueError("not a shard of token ids")
    return columns[0], np.append(columns[1], at), columns[2], head[len(MAGIC) :]


def _open(path: str, folder: str):
    import zstandard

    files, own = _files(folder)
    source = files.open_input_file(path)
    ids, offsets, counts, digest = _index(source, source.size())
    with files.open_input_stream(f"{own}/{digest.hex()}.dict") as x:
        dictionary = x.read()
    if hashlib.sha256(dictionary).digest() != digest:
        raise ValueError(f"the dictionary of {path} has another hash")
    return source, ids, offsets, counts, zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def read_document(path: str, folder: str, doc_id: int) -> list[np.ndarray]:
    """The id arrays of one document, by the index alone."""
    source, ids, offsets, _, unpack = _open(path, folder)
    return [np.frombuffer(unpack.decompress(source.read_at(offsets[k + 1] - offsets[k], offsets[k])), "<u4") for k in np.flatnonzero(ids == doc_id)]


def _frames(path: str, folder: str) -> Iterator[tuple[int, int, bytes]]:
    source, ids, offsets, counts, unpack = _open(path, folder)
    with source:
        for first in range(0, len(ids), 512):
            last = min(first + 512, len(ids))
            block = source.read_at(offsets[last] - offsets[first], offsets[first])
            for k in range(first, last):
                yield int(ids[k]), int(counts[k]), unpack.decompress(block[offsets[k] - offsets[first] : offsets[k + 1] - offsets[first]])


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """Every document of the listed shards, read back: its place among all ids, its number of ids and their checksum. The list has a row per file."""
    order = Window.partitionBy("shard_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range partition goes through the window without a key; the shards of a range have a window of their own
    ranges = shards.groupBy("shard_key").agg(F.sum("n_ids").alias("own"))
    before = F.coalesce(F.sum("own").over(Window.orderBy("shard_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("shard_key", before.alias("range_base"))
    placed = shards.join(starts, "shard_key").withColumn("base", F.col("range_base") + F.coalesce(F.sum("n_ids").over(order), F.lit(0)))

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple[int | None, int, int, int]] = []
                for doc_id, n, raw in _frames(path, folder):
                    if len(raw) != 4 * n:
                        raise ValueError(f"{path} has a frame of another length than its index says")
                    rows.append((None if doc_id == NULL_ID else doc_id, base, n, zlib.crc32(raw)))
                    base += n
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_arrow(placed.select("path", "base").repartition(n), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def committed(shards: DataFrame, folder: str) -> DataFrame:
    """The list of shards, written once: reading it again does not encode again."""
    spark: SparkSession = shards.sparkSession
    # a shuffle of a row per shard: the shards are written with full parallelism, their list to a few files
    few = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 64)
    shards.repartition(few).write.parquet(f"{folder}/manifest")
    return spark.read.schema(shards.schema).parquet(f"{folder}/manifest")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: write all documents as id shards, read them back."""
    folder = shared_dir(spark)
    shards = committed(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder), folder)
    return read_shards(shards, folder)
