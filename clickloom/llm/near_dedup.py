"""MinHash near-duplicates with b-bit signatures.

Each document's set of word shingles gives HASHES minima. Bands of full minima make candidates; of each minimum only the low
BITS bits are kept, packed into longs, and the share of equal lanes, corrected for chance collisions, estimates similarity by
bit counts inside the JVM. Estimates only discard pairs far below the threshold; every link is confirmed on full sets of the words
themselves, not of hashes. A bitmap of
the parity of shingles in each of PARITY bins goes along: bits in which two bitmaps differ are at most the shingles that only
one set has, so a pair with too many such bits is surely no link, and families of copies that fall just short of each other need
no confirmation pair by pair.

Documents with the same set are one class first. Then (1) every bucket links its members to its smallest class: as many pairs
as bucket rows; confirmed ones are joined into components. (2) Buckets that still hold several components are searched for
pairs across components whose sizes allow a link and whose estimate reaches the floor; a pair is confirmed unless its ends have met
meanwhile. A bucket of many classes is searched by many tasks, BLOCK of its classes against all in each; only pairs that may be links
leave the join. Components come out exact, though pairs inside a component are never expanded. A link at the threshold shares no band with a probability
of (1 - 0.75**3)**42 = 1e-10, and falls below the floor of the estimate with one of about 1e-8.

Documents without words (null, empty, white space) are linked with nothing; a null doc_id is a document of its own class
if no other has its set. Repeated rows share a class. Ties: of equal sets the smallest doc_id stands for all. Very long texts are
hashed and compared whole. An empty table gives no rows; `near_duplicates` reads no other columns, `deduplicated` carries them along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import FOLDED, dropped, grams, in_arrow, joined, mix, signed, word_slices, written

SHINGLE = 5
#: A link has 100 * intersection >= PERCENT * union.
PERCENT = 75
HASHES, ROWS, BITS = 128, 3, 4
BANDS = HASHES // ROWS
#: A pair is not confirmed if its estimated similarity is more than six deviations below the threshold (see estimated_similarity).
DEVIATIONS = 6
#: Classes of a bucket that one task compares with all of the bucket.
BLOCK = 4096
#: Members compared with one copy of a leader's text.
STAR = 64
#: Shuffle partitions in a file of a small table.
_FEW = 8

#: Bins of the parity bitmap.
PARITY = 2048

_PARITY = [f"p{i}" for i in range(PARITY // 64)]
_SIGNATURE = [f"s{i}" for i in range(HASHES * BITS // 64)]
_constants = np.random.default_rng(20240229).integers(0, 1 << 32, (2, HASHES), dtype=np.uint64).astype(np.uint32)
_A, _B = _constants[0] | np.uint32(1), _constants[1]
_BAND_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingle_sets(column: pa.Array):
    """Sorted distinct shingle hashes of each document of a text column, in order."""
    for a, b, _, words in word_slices(column, FOLDED):
        whole = grams(words.hash, SHINGLE)
        first, last = words.bounds[:-1], words.bounds[1:]
        alone = [mix(grams(words.hash, n) ^ np.uint64(n)) for n in range(1, SHINGLE)]
        for k in range(b - a):
            if 0 < (n := last[k] - first[k]) < SHINGLE:
                yield alone[n - 1][first[k] : first[k] + 1]
            elif last[k] == first[k]:
                yield whole[:0]
            else:
                yield np.unique(whole[first[k] : last[k] - SHINGLE + 1])


def minima(own: np.ndarray, block: int = 4096) -> np.ndarray:
    """The HASHES minima of a non-empty set."""
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    short = (own >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(own), block):
        x = _A[:, None] * short[None, at : at + block]
        x += _B[:, None]
        np.minimum(low, x.min(axis=1), out=low)
    return low


def _packed(low: np.ndarray) -> np.ndarray:
    lanes = 64 // BITS
    own = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, lanes)
    return (own << (np.arange(lanes, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set (null if empty), the packed low bits, and the band keys."""
    names = ["doc_id", "n_shingles", "set_a", "set_b", *_SIGNATURE, *_PARITY, "bands"]
    schema = "doc_id long, n_shingles long, set_a long, set_b long, " + "".join(f"{s} long, " for s in (*_SIGNATURE, *_PARITY)) + "bands array<long>"

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            size, a, b = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            packed, bands = np.zeros((n, len(_SIGNATURE) + len(_PARITY)), np.uint64), np.zeros((n, BANDS), np.uint64)
            for k, own in enumerate(shingle_sets(batch.column(1))):
                size[k] = len(own)
                if len(own):
                    a[k], b[k] = own.sum(dtype=np.uint64), mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                    low = minima(own)
                    packed[k, : len(_SIGNATURE)] = _packed(low)
                    odd = np.bincount((own & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
                    packed[k, len(_SIGNATURE) :] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
                    rows = low[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
                    key = _BAND_SEEDS
                    for j in range(ROWS):
                        key = mix(key ^ rows[:, j])
                    bands[k] = key
            none = size == 0
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(signed(bands.ravel()), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(signed(a), mask=none), pa.array(signed(b), mask=none), *(pa.array(signed(np.ascontiguousarray(packed[:, j]))) for j in range(packed.shape[1])), flat],
                names=names,
            )

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


def equal_lanes(left: str, right: str):
    """Number of equal lanes of two packed signatures, by bit counts."""
    ones = F.lit(int("1" * (64 // BITS), 16))
    differ = F.lit(0)
    for s in _SIGNATURE:
        x = F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))
        folded = x
        for shift in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, shift))
        differ = differ + F.bit_count(folded.bitwiseAND(ones))
    return F.lit(HASHES) - differ


def estimated_similarity(lanes):
    """Similarity from equal lanes, without the lanes that are equal by chance."""
    chance = 1 / (1 << BITS)
    return (lanes / HASHES - chance) / (1 - chance)


def least_estimate() -> float:
    """DEVIATIONS below the threshold: a lane of a pair at the threshold is equal with probability s + (1 - s) * chance."""
    chance = 1 / (1 << BITS)
    equal = PERCENT / 100 + (1 - PERCENT / 100) * chance
    return PERCENT / 100 - DEVIATIONS * (equal * (1 - equal) / HASHES) ** 0.5 / (1 - chance)


def may_link(left: str, right: str):
    """False for pairs that are no link: their sizes or the estimate are too far off, or the parity bitmaps differ in too many bits."""
    bits = F.lit(0)
    for p in _PARITY:
        bits = bits + F.bit_count(F.col(f"{left}.{p}").bitwiseXOR(F.col(f"{right}.{p}")))
    a, b = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
    sizes = (100 * a >= PERCENT * b) & (100 * b >= PERCENT * a)
    return sizes & (estimated_similarity(equal_lanes(left, right)) >= least_estimate()) & ((100 + PERCENT) * bits <= (100 - PERCENT) * (a + b))


def word_shingles(text: str | None) -> set[tuple[bytes, ...]]:
    """The set of a text's shingles, as words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space alone
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(SHINGLE)), strict=False))


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the written pairs (a, b) whose full sets reach the threshold; a leader's text is read once for each STAR partners, so no task gathers a hot leader's."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("stars"))
    salted = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("stars")).alias("star"))
    wanted = written(salted.select("a", "star", F.lit(1).alias("role"), F.col("b").alias("doc_id")).unionByName(salted.select("a", "star", F.lit(0).alias("role"), F.col("a").alias("doc_id")).distinct()))
    texts = joined(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), wanted, "doc_id", "inner")

    def run(batches):
        leader, own = None, set()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            roles, ids = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            a, b = [], []
            for k, x in enumerate(map(word_shingles, batch.column(4).to_pylist())):
                if roles[k] == 0:
                    leader, own = keys[k], x
                elif leader == keys[k]:
                    both = len(own & x)
                    if 100 * both >= PERCENT * (len(own) + len(x) - both):
                        a.append(keys[k][0])
                        b.append(ids[k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.select("a", "star", "role", "doc_id", "text").repartition(n, "a", "star").sortWithinPartitions("a", "star", "role", "doc_id")
    return in_arrow(dealt, run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge (a, b); component is its smallest node.

    Alternating large and small stars, each round a written table; rounds grow with the logarithm of the longest chain. It ends when every node
    has one edge and none leads to a node that has an edge itself: each component is a star around its smallest node then.
    """
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), _FEW)
    while True:
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not sums.agg(F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0))).first()[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        after = written(small, _FEW)
        dropped(edges.sparkSession, now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (class_id, ...) with their component so far."""
    found = written(components(edges), _FEW)
    return joined(nodes, found.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))


def near_duplicates(docs: DataFrame, sets: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept (whether it is that document); with sets also the hash of its set, set_a and set_b."""
    extra = ["set_a", "set_b"] if sets else []
    signed_docs = written(signatures(docs))
    small = signed_docs.select("doc_id", "n_shingles", "set_a", "set_b")
    classes = written(small.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("class_id")), _FEW)
    alone = small.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), *extra)
    members = written(joined(small.where("n_shingles > 0"), classes, ["set_a", "set_b"], "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), *extra).unionByName(alone))
    heads = written(signed_docs.where("n_shingles > 0").join(members.where("doc_id = class_id and n_shingles > 0").select("doc_id", *extra).distinct(), ["doc_id", *extra], "left_semi").withColumnRenamed("doc_id", "class_id"))
    lanes = heads.select("class_id", "n_shingles", *_SIGNATURE, *_PARITY)
    buckets = heads.select("class_id", F.explode("bands").alias("band"))
    crowded = written(buckets.groupBy("band").agg(F.min("class_id").alias("a"), F.max("class_id").alias("last")).where("a < last").select("band", "a"), _FEW)
    rows = written(joined(buckets, crowded, "band", "inner"))

    stars = rows.where("a != class_id").select("a", F.col("class_id").alias("b")).distinct()
    first = written(_likely(stars, lanes))
    links = written(confirmed(docs, first))
    nodes = rows.select("class_id").distinct()
    labels = written(_labels(nodes, links), _FEW)

    placed = joined(rows.select("band", "class_id"), labels, "class_id", "inner")
    mixed = placed.groupBy("band").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p < q").select("band")
    open_rows = written(joined(placed, written(mixed, _FEW), "band", "left_semi"))
    open_rows = written(joined(open_rows, lanes, "class_id", "inner"))
    x, y = (side.alias(name) for side, name in zip(_blocked(open_rows), "xy", strict=True))
    across = (
        x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.class_id") < F.col("y.class_id")) & (F.col("x.component") != F.col("y.component")) & may_link("x", "y"))
        .select(F.col("x.class_id").alias("a"), F.col("y.class_id").alias("b"), equal_lanes("x", "y").alias("lanes"))
        .distinct()
        .join(first, ["a", "b"], "left_anti")
    )
    left = written(across)
    if not left.isEmpty():
        ends = left.select(F.col("a").alias("end"), "a", "b", "lanes").unionByName(left.select(F.col("b").alias("end"), "a", "b", "lanes"))
        best = written(ends.groupBy("end").agg(F.max(F.struct("lanes", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("x")).select((-F.col("x.a")).alias("a"), (-F.col("x.b")).alias("b")).distinct(), _FEW)
        links = written(links.unionByName(confirmed(docs, best)))
        labels = written(_labels(nodes, links), _FEW)
        label = lambda end: labels.select(F.col("class_id").alias(end), F.col("component").alias(f"{end}_is"))
        rest = written(left.join(best, ["a", "b"], "left_anti").join(label("a"), "a").join(label("b"), "b").where("a_is != b_is").select("a", "b"), _FEW)
        if not rest.isEmpty():
            links = written(links.unionByName(confirmed(docs, rest)))
            labels = written(_labels(nodes, links), _FEW)
    out = joined(members, labels, "class_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"), *extra)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _blocked(rows: DataFrame, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Two sides of a bucket's comparison with itself: each class in one of the bucket's blocks, and each class in all of them. Most buckets have one block."""
    most = BLOCK if block is None else block
    sizes = rows.groupBy("band").agg(F.count("*").alias("n"))
    large = written(sizes.where(F.col("n") > most).select("band", F.ceil(F.col("n") / most).alias("blocks")), _FEW)
    counted = joined(rows, large, "band", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    one = counted.withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks"))).drop("blocks")
    every = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    return one, every


def _likely(pairs: DataFrame, lanes: DataFrame) -> DataFrame:
    """Those pairs (a, b) that may be links."""
    own = F.struct("n_shingles", *_SIGNATURE, *_PARITY)
    x, y = lanes.select(F.col("class_id").alias("a"), own.alias("x")), lanes.select(F.col("class_id").alias("b"), own.alias("y"))
    return pairs.join(x, "a").join(y, "b").where(may_link("x", "y")).select("a", "b")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns: of rows with one doc_id and one set a single one, and of rows without doc_id one for each set that no doc_id has. Rows without words all stay. Sets of one doc_id that is the smallest of several sets count as linked."""
    found = written(near_duplicates(docs, sets=True))
    repeated = written(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("repeated_id")), _FEW)
    kept = found.where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id"))
    own_id = docs["doc_id"].cast("long")
    if repeated.isEmpty():
        kept = written(kept)
        return joined(docs, kept, own_id == kept["kept_id"], "left_semi")
    kept = written(joined(kept, repeated, F.col("kept_id") == F.col("repeated_id"), "left_anti"))
    once = joined(docs, kept, own_id == kept["kept_id"], "left_semi")
    # only rows of these ids are hashed again, each under a number of its own
    rows = written(joined(docs, repeated, own_id.eqNullSafe(repeated["repeated_id"]), "left_semi").withColumn("_row__number", F.monotonically_increasing_id()))
    hashed = signatures(rows.select(F.col("_row__number").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "n_shingles", "set_a", "set_b")
    marked = written(hashed.join(rows.select(F.col("_row__number").alias("row"), F.col("doc_id").cast("long").alias("id")), "row"))
    first = marked.where("n_shingles > 0").groupBy("id", "set_a", "set_b").agg(F.min("row").alias("row")).alias("x")
    right = written(joined(found.where("kept and n_shingles > 0"), repeated, F.col("doc_id").eqNullSafe(F.col("repeated_id")), "left_semi").select("doc_id", "set_a", "set_b").distinct()).alias("y")
    same = F.col("x.id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.set_a") == F.col("y.set_a")) & (F.col("x.set_b") == F.col("y.set_b"))
    stay = written(first.join(right, same, "left_semi").select("row").unionByName(marked.where("n_shingles = 0").select("row")).withColumnRenamed("row", "stay"))
    return once.unionByName(joined(rows, stay, rows["_row__number"] == stay["stay"], "left_semi").drop("_row__number"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: near-duplicate components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ')) AS g FROM docs, unnest(generate_series(1, greatest(1, len(w) - {SHINGLE - 1}))) AS t(i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * shared >= {PERCENT} * (x.n + y.n - shared)
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM docs
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, low AS component_id, d.doc_id = low AS kept
FROM docs d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN (SELECT a, min(b) AS low FROM reached GROUP BY a) c ON d.doc_id = c.a
"""
