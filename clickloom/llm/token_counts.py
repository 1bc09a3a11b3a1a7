"""Token totals by source, language and tokenizer version, maintained from signed deltas.

A batch is a set of signed counts: +1 and a document's tokens for an insert, -1 and the same tokens for a delete, both for a
revision (the old count out, the new one in). A commit sums the batch by key, aggregated before its shuffle, and writes the sums
as one delta, renamed into place when whole. Its name is the batch's id and one of its own, and of several deltas with
one batch id the first name counts, so that a batch committed again, by two writers at once, or half written by a lost job, changes
nothing. Totals are the sum of all deltas; compact() folds deltas into one and remembers whose.

Tokens are those of the tokenizers of op1 and op10 (VERSIONS), counted in Arrow batches, a pass for each. `word_counts` counts words and
runs of letters and digits in SQL functions alone; its query has a SQL twin that checks the rollup.

Null keys are keys of their own; null counts are zero; null and empty texts have no tokens. A key whose documents all went stays out of the
totals. Very long texts are counted whole. Repeated rows count each; labels that contradict each other count as toxic and as of low quality.
Empty tables give no totals. Other columns are not read.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import sentencepiece_bpe, token_shards
from clickloom.llm.common import held, in_arrow, shared_dir, written

KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class Rollup:
    """Totals in one shared folder: deltas/<batch id>~<name>, deltas/fold-<name>, and folds/fold-<name>, the batch ids and names that the fold stands for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._files = jvm.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path(f"{folder}/deltas"))

    def _listed(self) -> tuple[set[str], list[str]]:
        """Names of the deltas that count, and of all folds."""
        names = {x.getPath().getName() for x in self._files.listStatus(self._path(f"{self.folder}/deltas"))}
        folds = sorted(n for n in names if n.startswith("fold-"))
        batches = {n.split("~")[0] for n in names} - set(folds)
        # folded deltas count no more, nor do others of their batch
        gone = self._among(folds, sorted(names | batches))
        first = {b: min(n for n in names if n.split("~")[0] == b) for b in batches - gone}
        return set(first.values()) | (set(folds) - gone), folds

    def _among(self, folds: list[str], wanted: list[str]) -> set[str]:
        """Which of the wanted ids and names the folds stand for; no more than these come to the driver."""
        if not folds or not wanted:
            return set()
        return {r.value for r in self.spark.read.text([f"{self.folder}/folds/{n}" for n in folds]).where(F.col("value").isin(wanted)).distinct().collect()}

    def known(self, batch_id: str) -> bool:
        """Whether a batch was committed."""
        live, folds = self._listed()
        return any(n.split("~")[0] == batch_id for n in live) or bool(self._among(folds, [batch_id]))

    def batches(self) -> DataFrame:
        """Ids of the committed batches."""
        live, folds = self._listed()
        out = self.spark.createDataFrame([(n.split("~")[0],) for n in sorted(live) if not n.startswith("fold-")], "batch string")
        if folds:
            out = out.unionByName(self.spark.read.text([f"{self.folder}/folds/{n}" for n in folds]).where(~F.col("value").contains("~") & ~F.col("value").startswith("fold-")).select(F.col("value").alias("batch")))
        return out.distinct()

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add signed counts (source, lang, tokenizer, sign, n_tokens); False if the batch was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch_id) or batch_id.startswith("fold-"):
            raise ValueError("a batch id has letters, digits, points, hyphens and underscores, and doesn't begin with fold-")
        if self.known(batch_id):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.coalesce("n_tokens", F.lit(0))).cast("long").alias("n_tokens"))
        own = f"{self.folder}/tmp/{uuid.uuid4().hex}"
        sums.where("n_docs != 0 or n_tokens != 0").write.parquet(own)
        return bool(self._files.rename(self._path(own), self._path(f"{self.folder}/deltas/{batch_id}~{uuid.uuid4().hex}")))

    def totals(self) -> DataFrame:
        paths = [f"{self.folder}/deltas/{n}" for n in sorted(self._listed()[0])]
        every = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        return every.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs != 0 or n_tokens != 0")

    def compact(self) -> None:
        """Fold all deltas into one; for a time when no batch is being committed."""
        live, folds = self._listed()
        if len(live) < 2:
            return
        name = f"fold-{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{self.folder}/tmp/{name}")
        own = self.spark.createDataFrame([(x,) for x in sorted(live | {n.split("~")[0] for n in live})], "value string")
        if folds:
            own = own.unionByName(self.spark.read.text([f"{self.folder}/folds/{n}" for n in folds])).distinct()
        own.write.text(f"{self.folder}/folds/{name}")
        if self._files.rename(self._path(f"{self.folder}/tmp/{name}"), self._path(f"{self.folder}/deltas/{name}")):
            for old in live:
                self._files.delete(self._path(f"{self.folder}/deltas/{old}"), True)


class Pieces:
    """Numbers of ids by the sentencepiece library, which counts whole texts faster than op1's tables, where no ids are asked for."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, texts: list[str | None]) -> list[int]:
        return [len(ids) for ids in self.library.encode([t or "" for t in texts], num_threads=1)]


#: Tokenizer versions: what counts a batch of texts, from the tokenizer's file, and the kind of table that it holds.
VERSIONS = {
    "piece_bpe_32k": ("pieces", lambda: sentencepiece_bpe.default_model(), lambda path: held("pieces", path, lambda: Pieces(path))),
    "word_bpe_49k": ("tokenizer", lambda: token_shards.default_tokenizer(), lambda path: token_shards.encoder_for(path)),
}


def counted(docs: DataFrame, version: str) -> DataFrame:
    """doc_id, source, lang, tokenizer, and each text's number of tokens under a version."""
    holds, path_of, table_of = VERSIONS[version]
    path = path_of()

    def run(batches):
        table = table_of(path)
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for at in range(0, len(texts), 256):
                own = texts[at : at + 256]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, 256) for k in range(3)), pa.array([version] * len(own)), pa.array(table.count(own), pa.int64())], names=["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    text_docs = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"))
    return in_arrow(text_docs, run, "doc_id long, source string, lang string, tokenizer string, n_tokens long", holds)


def signed_rows(counts: DataFrame, sign: int) -> DataFrame:
    """Counts (source, lang, tokenizer, n_tokens) to add (+1) or take away (-1)."""
    return counts.select("source", "lang", "tokenizer", F.lit(sign).alias("sign"), "n_tokens")


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))


TOXIC, POOR = "toxic = 1", "coalesce(toxic, 0) != 1 and quality = 0"


def query(spark, sf_dir: str) -> DataFrame:
    """op5: all documents come in under both tokenizers; those labelled toxic go; those labelled of low quality get a revised count: under piece_bpe_32k what word_bpe_49k counts. Each batch is sent twice."""
    docs, marks = spark.read.parquet(f"{sf_dir}/documents.parquet"), _marks(spark, sf_dir)
    by = {version: written(counted(docs, version)) for version in VERSIONS}
    counts = by["piece_bpe_32k"].unionByName(by["word_bpe_49k"])
    poor = by["piece_bpe_32k"].join(marks.where(POOR), "doc_id", "left_semi")
    revised = by["word_bpe_49k"].join(marks.where(POOR), "doc_id", "left_semi").withColumn("tokenizer", F.lit("piece_bpe_32k"))
    rollup = Rollup(spark, shared_dir(spark))
    for _ in range(2):
        rollup.commit("1-insert", signed_rows(counts, 1))
        rollup.commit("2-delete", signed_rows(counts.join(marks.where(TOXIC), "doc_id", "left_semi"), -1))
        rollup.commit("3-revise", signed_rows(poor, -1).unionByName(signed_rows(revised, 1)))
    return rollup.totals()


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang and each text's words under two versions: words between white space, and runs of ASCII letters and digits."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", "source", "lang", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.regexp_count(text, F.lit(r"[0-9A-Za-z]+")).cast("long").alias("alnum"))


def signed_counts(counts: DataFrame, sign: int) -> DataFrame:
    """A document's counts as rows to add (+1) or take away (-1)."""
    each = F.explode(F.array(F.struct(F.lit("words-1").alias("tokenizer"), F.col("words").alias("n_tokens")), F.struct(F.lit("alnum-1").alias("tokenizer"), F.col("alnum").alias("n_tokens"))))
    return counts.select("source", "lang", each.alias("x")).select("source", "lang", "x.tokenizer", F.lit(sign).alias("sign"), "x.n_tokens")


def word_query(spark, sf_dir: str) -> DataFrame:
    """The same changes over word counts, so that SQL can tell the totals: those of low quality are revised to what alnum-1 counts."""
    counts, marks = written(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))), _marks(spark, sf_dir)
    toxic, poor = (counts.join(marks.where(which), "doc_id", "left_semi") for which in (TOXIC, POOR))
    rollup = Rollup(spark, shared_dir(spark))
    for _ in range(2):
        rollup.commit("1-insert", signed_counts(counts, 1))
        rollup.commit("2-delete", signed_counts(toxic, -1))
        rollup.commit("3-revise", signed_counts(poor, -1).unionByName(signed_counts(poor.withColumn("words", F.col("alnum")), 1)))
    return rollup.totals()


ORACLE = r"""
WITH counts AS (
  SELECT doc_id, source, lang,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z]+')) AS alnum
  FROM documents
), marks AS (
  SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id
), kept AS (
  SELECT c.*, coalesce(m.quality = 0, false) AS poor
  FROM counts c LEFT JOIN marks m ON c.doc_id = m.doc_id
  WHERE coalesce(m.toxic, 0) <> 1
)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM (
  SELECT source, lang, 'words-1' AS tokenizer, CASE WHEN poor THEN alnum ELSE words END AS n FROM kept
  UNION ALL
  SELECT source, lang, 'alnum-1' AS tokenizer, alnum AS n FROM kept
)
GROUP BY source, lang, tokenizer
"""
