"""What the text operators share: word hashing over Arrow buffers, rolling n-gram hashes, shared folders.

Words are found and hashed over whole byte buffers with numpy, so no Python object is made per word. A word's hash is
chained over its bytes, eight at a time, and a sequence's hash over the hashes of its halves, each step through a bit mixer
that is no linear map: there is no family of words or sequences that collides whatever the constants, as there is for
polynomials modulo 2**64. Still, hashes only route and look up here; operators confirm equality on bytes or words.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import hashlib
import shutil
import sys
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text hashed at once; a longer document is a slice of its own.
SLICE_BYTES = 512 << 10

#: Fixed keys of the word and sequence hashes.
_WORD_KEY, _LANE_KEY, _LEFT_KEY = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95), np.uint64(0xA0761D6478BD642F)
#: Words of more bytes are hashed one by one.
_LONG_WORD = 64


def _separator_table(separators: set[int], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    word = np.ones(256, dtype=bool)
    word[sorted(separators)] = False
    value = np.arange(256, dtype=np.uint8)
    if lower:
        value[65:91] += 32
    return word, value


SPACES = {0x20, *range(0x09, 0x0E)}
#: Words `[^\x20\x09-\x0D]+`, unchanged.
PLAIN = _separator_table(SPACES, lower=False)
#: The same words after A-Z are lower-cased.
FOLDED = _separator_table(SPACES, lower=True)
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased (A-Z are word bytes before that).
ALNUM = _separator_table({*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}, lower=True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[begin:end] for each word, eight bytes at a time."""
    size = (end - begin).astype(np.uint64)
    out = mix(size * _WORD_KEY + _LANE_KEY)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.sliding_window_view(padded, 8)
    at, left = np.flatnonzero(size <= _LONG_WORD), None
    for first in range(0, _LONG_WORD, 8):
        at = at[size[at] > first]
        if not len(at):
            break
        lane = np.ascontiguousarray(lanes[begin[at] + first]).view("<u8").ravel()
        left = np.minimum(size[at] - np.uint64(first), np.uint64(8))
        lane &= ~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * left)
        out[at] = mix(out[at] ^ (lane * _LANE_KEY))
    if len(long := np.flatnonzero(size > _LONG_WORD)):
        raw = data.tobytes()
        out[long] = [int.from_bytes(hashlib.blake2b(raw[begin[k] : end[k]], digest_size=8).digest(), "little") for k in long]
    return out


class Words:
    """Words of consecutive documents: hashes, byte spans in the slice, and each document's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: tuple[np.ndarray, np.ndarray]):
        is_word, value = kind
        inside = is_word[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.begin, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: The bytes as they count, with case folded where the kind says so.
        self.data = value[data]
        self.hash = _word_hashes(self.data, self.begin, self.end)
        self.bounds = np.searchsorted(self.begin, offsets)

    def normal(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words joined by one space each, and where each begins and ends there."""
        size = self.end - self.begin
        begin = np.cumsum(size + 1) - size - 1
        raw = np.full(int(size.sum()) + len(size), 32, np.uint8)
        at = np.repeat(self.begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        raw[at + np.repeat(begin - self.begin, size)] = self.data[at]
        return raw.tobytes(), begin, begin + size

    def __len__(self) -> int:
        return len(self.hash)

    def limit(self) -> np.ndarray:
        """For each word, the index after its document's last word."""
        return np.repeat(self.bounds[1:], np.diff(self.bounds))

    def doc(self) -> np.ndarray:
        """For each word, its document's index in the slice."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on, for the positions that have n, joined from runs of doubling lengths; documents are not told apart."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out, have, run, length = None, 0, words, 1
    while True:
        if n & length:
            out = run if out is None else mix(out[: len(words) - have - length + 1] * _LEFT_KEY + run[have:])
            have += length
        if have == n:
            return out if n > 1 else mix(out)
        run = mix(run[:-length] * _LEFT_KEY + run[length:])
        length *= 2


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes; no document is cut."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to
        at = to


def word_slices(column: pa.Array, kind: tuple[np.ndarray, np.ndarray], most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, Words]]:
    """(first document, end, bytes, words) for consecutive documents of a text column."""
    data, offsets = text_buffers(column)
    for a, b in slices(offsets, most):
        own = data[offsets[a] : offsets[b]]
        yield a, b, own, Words(own, offsets[a : b + 1] - offsets[a], kind)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark's long."""
    return x.view(np.int64)


def gaps(values: list) -> Iterator[int]:
    """Where a list has None."""
    at = -1
    try:
        while True:
            at = values.index(None, at + 1)
            yield at
    except ValueError:
        return


@contextlib.contextmanager
def without_gc():
    """No cyclic garbage collection meanwhile, for code that makes very many small objects and no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


#: Documents in an Arrow batch at most; with Spark's 10,000 a batch of long texts takes much of a worker's memory, twice.
BATCH_ROWS = 1_000


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package's source to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="loom-source-")  # the driver serves the file from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/{root.name}-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, f"{root.name}/{source.relative_to(root)}")
    context.addPyFile(path)
    sys.path[:] = [x for x in sys.path if not x.endswith(Path(path).name)]


def _trimmed() -> None:
    """Return this Python process's freed memory to the system, where libc can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_held: dict[tuple[str, str], object] = {}


def held(kind: str, name: str, make):
    """A table that a Python worker keeps between tasks; see in_arrow for when it goes."""
    if (kind, name) not in _held:
        _held[kind, name] = make()
    return _held[kind, name]


def _keep_only(kind: str) -> None:
    if others := [k for k in _held if k[0] != kind]:
        for k in others:
            del _held[k]
        gc.collect()


def in_arrow(df: DataFrame, function, schema, holds: str = "") -> DataFrame:
    """df.mapInArrow over batches of at most BATCH_ROWS rows: the session's limit is lowered where it is higher.

    Workers are used again for other functions; before this one runs, they give up the tables of every kind but `holds`.
    """
    ship(df.sparkSession)
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)

    def run(batches):
        _keep_only(holds)
        try:
            yield from function(batches)
        finally:
            _trimmed()  # an idle worker keeps what its task has freed beside the next tasks' memory

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir; a temporary folder where that is unset and Spark runs in one local process, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.getCheckpointDir():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loom-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Seconds between two rounds of given_back that written tables ask for.
GIVE_BACK_S = 2.0
_last_given = -GIVE_BACK_S


def given_back(spark: SparkSession) -> None:
    """Return freed memory that the driver's allocators still hold, in Python and in the JVM, to the system; nothing that is in use goes.

    Training's arrays, compilers' scratch and plans' buffers come and go in many sizes and threads, and glibc keeps what was freed, so a driver that runs
    many queries grows though little is alive. Where libc or the JVM knows no such call nothing happens.
    """
    global _last_given
    gc.collect()
    _trimmed()
    context = spark.sparkContext
    with contextlib.suppress(Exception):
        jvm = context._jvm
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # the server's own class is not exported, its interface is
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        args = context._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(beans, args)
    _last_given = time.monotonic()


def written(df: DataFrame, narrow: int = 1) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: lineage ends here and a lost executor costs nothing.

    narrow: for small results of a shuffle, so many of its partitions go to one file (a file costs more than its few rows).
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    if narrow > 1:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // narrow))
    df.write.parquet(path)
    if time.monotonic() - _last_given >= GIVE_BACK_S:
        given_back(spark)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = hadoop(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The most that is broadcast; a larger side is joined by a shuffle.
BROADCAST_BYTES = 24 << 20
#: Bytes that a fixed-width value, or the head of a text or list, takes at most in a hashed relation.
_VALUE_BYTES = 16


def _bytes_of(kind: T.DataType, value: Column) -> Column:
    """Size of a value in memory, the lengths of texts and lists included."""
    if isinstance(kind, T.StringType):
        return F.lit(_VALUE_BYTES) + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, T.StructType):
        return sum((_bytes_of(f.dataType, value[f.name]) for f in kind.fields), F.lit(_VALUE_BYTES))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.StructType, T.ArrayType)):
            return F.lit(_VALUE_BYTES) + F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + _bytes_of(kind.elementType, x)), F.lit(0))
        return F.lit(_VALUE_BYTES) + _VALUE_BYTES * F.greatest(F.size(value), F.lit(0))
    return F.lit(_VALUE_BYTES)


def table_bytes(df: DataFrame) -> int:
    """What a written table takes in memory, summed over its rows."""
    row = sum((_bytes_of(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(_VALUE_BYTES))
    return df.agg(F.coalesce(F.sum(row.cast("long")), F.lit(0))).first()[0]


def joined(left: DataFrame, right: DataFrame, on, how: str) -> DataFrame:
    """left joined with a written table: broadcast if its summed bytes fit the bound, else by a shuffle that Spark may split."""
    small = table_bytes(right) <= BROADCAST_BYTES
    return left.join(F.broadcast(right) if small else right, on, how)


#: Bits of a filter at most: 16 MB, whatever the number of ids.
FILTER_BITS = 1 << 27


def split_by_ids(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be among ids, rows whose id surely is not), told apart by a broadcast bitmap of hashed ids.

    So joins with a part of the documents shuffle the texts of hardly more than that part. ids is a written table; the bitmap has 16 bits an id,
    FILTER_BITS at most: past that more rows are only likely. A null id is surely not among them.
    """
    bits = min(FILTER_BITS, max(1 << 15, 1 << (16 * ids.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(bits))
    held = ids.select(place(F.col(column)).alias("at"))
    maps = held.groupBy(F.bitmap_bucket_number("at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("_bitmap"))
    maps = F.broadcast(written(maps))  # bits / 32,768 rows of 4 KB
    own = place(F.col(column))
    position = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substring("_bitmap", (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False)) & F.col(column).isNotNull()
    marked = docs.join(maps, F.bitmap_bucket_number(own) == F.col("_bucket"), "left")
    return marked.where(met).select(*docs.columns), marked.where(~met).select(*docs.columns)
