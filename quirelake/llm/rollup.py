"""Token counts: delta-maintained rollups of documents and tokens by source, language and tokenizer version.

Every change is a row with signs: an insert adds a document's counts, a delete takes them off, a revision does both. A batch
is summed by group (combined before the shuffle, so a hot source is a row from each task), added to the totals so far, and
written to a folder of its own. It counts once the file of its version's number is made, which only one writer can: it
names the folder and the batch. A writer that finds the number taken starts again from the new totals, so no commit is lost.
A batch whose id was committed before changes nothing, so that it may be sent again after any failure. Ids are names of
files, listed and never written again. The totals have a row for each group, however many documents there are.

Defined results for odd input: a null or empty text has no token and counts as a document; null sources and languages are
groups of their own; rows that repeat a doc_id count each; further columns are ignored; an empty batch commits its id
only; groups without documents are left out of the totals."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import lean
from .tokens import default_paths, encoder, texts

GROUP = ["source", "lang", "version"]
SUMS = ["docs", "chars", "tokens"]
SCHEMA = "source string, lang string, version string, docs long, chars long, tokens long"


def counted(docs: DataFrame, version: str, paths: tuple[str, str | None] | None = None) -> DataFrame:
    """(source, lang, version, docs, chars, tokens) of each document, docs being 1."""
    paths = paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*paths)
        for b in batches:
            n = pa.array([len(enc.encode(t)) // 4 for t in texts(b.column(3))], pa.int64())
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), n], ["source", "lang", "chars", "tokens"])

    own = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(lean(run), "source string, lang string, chars long, tokens long").select("source", "lang", F.lit(version).alias("version"), F.lit(1).cast("long").alias("docs"), "chars", "tokens")


def estimated(docs: DataFrame, version: str = "estimate", chars: int = 4) -> DataFrame:
    """The same, with a token for so many characters begun."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(version).alias("version"), F.lit(1).cast("long").alias("docs"), n.alias("chars"), F.expr(f"cast(ceil({'coalesce(length(text), 0)'} / {chars}) as long)").alias("tokens"))


def inserted(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, *SUMS)


def deleted(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, *(-F.col(c) for c in SUMS)).toDF(*GROUP, *SUMS)


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    return deleted(old).unionByName(inserted(new))


class Rollup:
    """The totals under a folder that all machines share. commits/N names the folder and the batch of version N; ids/X stands
    for a batch whose digest is X."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, of: str) -> list[str]:
        at = self._path(f"{self.folder}/{of}")
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _make(self, name: str, text: str) -> bool:
        """Makes a file with a text, whole or not at all; False if there is one. A rename that doesn't write over decides between
        writers, as far as the file system does that in one step (HDFS does)."""
        draft = self._path(f"{self.folder}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        to = self._path(f"{self.folder}/{name}")
        self._fs.mkdirs(to.getParent())
        jvm = self._jvm.org.apache.hadoop.fs
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 0)
        files = jvm.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.rename(self._fs.makeQualified(draft), self._fs.makeQualified(to), plain)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            self._fs.delete(draft, False)
            return False
        return True

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def version(self) -> int:
        """The last version that was committed; 0 if there is none."""
        return max((int(n) for n in self._names("commits") if n.isdigit()), default=0)

    def _commit(self, v: int) -> tuple[str, str]:
        folder, _, batch = self._read(f"commits/{v}").partition("\n")
        return folder, batch

    def _at(self, v: int) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/{self._commit(v)[0]}") if v else self.spark.createDataFrame([], SCHEMA)

    def batches(self) -> list[str]:
        """Ids of the batches that are in the totals."""
        return sorted(self._commit(v)[1] for v in range(1, self.version() + 1))

    def _known(self, batch: str) -> bool:
        """Whether a batch is in the totals; an id whose mark a failure left out is marked now."""
        marked = set(self._names("ids"))
        v = self.version()
        if len(marked) < v:
            for k in range(v, 0, -1):
                own = _digest(self._commit(k)[1])
                if own in marked:
                    break  # marks are made in order
                self._touch(own)
                marked.add(own)
        return _digest(batch) in marked

    def _touch(self, name: str) -> None:
        self._fs.create(self._path(f"{self.folder}/ids/{name}"), True).close()

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Adds the signed changes, unless the batch is in the totals already."""
        while not self._known(batch):
            v = self.version()
            sums = self._at(v).unionByName(changes.select(*GROUP, *SUMS)).groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in SUMS))
            name = f"totals-{v + 1}-{uuid.uuid4().hex}"
            sums.where("docs <> 0 or chars <> 0 or tokens <> 0").write.parquet(f"{self.folder}/{name}")
            if self._make(f"commits/{v + 1}", f"{name}\n{batch}"):
                self._touch(_digest(batch))
                return True
            self._fs.delete(self._path(f"{self.folder}/{name}"), True)  # another writer was first
        return False

    def totals(self) -> DataFrame:
        return self._at(self.version()).select(*GROUP, *SUMS)


def _digest(batch: str) -> str:
    return hashlib.sha256(batch.encode()).hexdigest()


def token_totals(docs: DataFrame, folder: str, version: str = "byte_bpe_50k") -> DataFrame:
    """Totals of docs after two batches: all documents are inserted with estimated counts, then revised to the tokenizer's."""
    rollup = Rollup(docs.sparkSession, folder)
    first = estimated(docs)
    rollup.apply("insert", inserted(first))
    rollup.apply("revise", revised(first, counted(docs, version)))
    rollup.apply("insert", inserted(first))  # sent again: nothing changes
    return rollup.totals()
