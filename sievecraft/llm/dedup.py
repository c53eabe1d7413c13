"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 digest of the text. A batch of documents comes in parts of falling
keys. Each part is reduced to one row per digest, what the index holds already, from earlier batches or earlier parts, is
removed by a sort-merge anti-join, and the rest is appended; then each document learns from the index which row stays.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.llm.common import fresh_name, join_hot, materialise


def digest(text: str = "text"):
    """Binary SHA-256 of the whole text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


#: Rows of a bucket about, and least and most buckets of an index whose number of buckets is not given.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 1 << 21, 8, 1 << 14
#: Keys of the sample that says where parts end; the result is the same wherever they do.
CUT_SAMPLE = 1000


class DigestIndex:
    """Persistent table (digest, keep_id, batch), bucketed and sorted by digest; each digest stands there once.

    The number of buckets is fixed when the index is made, by default from the rows of its first batch: an index that
    shall grow far beyond them should be given its own.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark, self.name, self.buckets = spark, name or f"digest_index_{uuid.uuid4().hex}", buckets
        if name is None:  # an index of this run alone goes when the run ends
            atexit.register(self._forget)

    def _exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self, kind: str = "bigint", rows: int = 0) -> DataFrame:
        """The index; made empty, for keys of this kind and about so many rows, where there is none yet."""
        if not self._exists():
            if not self.buckets:
                self.buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (rows // BUCKET_ROWS).bit_length()))
            self._write(self.spark.createDataFrame([], f"digest binary, keep_id {kind}, batch string"))
        elif not self.buckets:
            found = self.spark.sql(f"DESCRIBE EXTENDED {self.name}").where("col_name = 'Num Buckets'").first()
            self.buckets = int(found["data_type"])
        return self.spark.table(self.name)

    def _write(self, rows: DataFrame) -> None:
        rows = rows.repartition(self.buckets, "digest")
        rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _forget(self) -> None:
        try:
            self.drop()
        except Exception:  # the session has ended
            pass

    def add(self, groups: DataFrame, batch: str, repeated: bool = True) -> None:
        """Appends the rows (digest, keep_id) of a batch whose digests the index does not hold.

        A batch that is already in the index is not added again, so that a run that was cut off later can be repeated; the
        look for it is saved where `repeated` says that its name is new.
        """
        index = self.read(groups.schema["keep_id"].dataType.simpleString())
        if repeated and not index.where(F.col("batch") == batch).isEmpty():
            return
        fresh = groups.join(index.select("digest").hint("merge"), "digest", "left_anti")
        self._write(fresh.select("digest", "keep_id", F.lit(batch).alias("batch")))

    def dedup(self, docs: DataFrame, text: str = "text", key: str = "doc_id", batch: str | None = None, parts: int = 1) -> DataFrame:
        """Adds a batch; one row per document: key, digest, keep_id, group_size (in the batch), kept.

        Of equal texts in a batch the row with the largest key stays, unless an earlier batch holds the text;
        then none does and keep_id is the earlier row's. Repeating a batch under its name gives the same rows again.
        With `parts` the batch comes in so many steps of falling keys, each grouped by itself: the anti-join drops what an
        earlier step has brought, whose key is the larger one. Null text counts as empty; a null key ranks below every
        other, and keep_id is null where all keys of a group are. Rows that repeat key and text share their fate
        (`kept_rows` leaves one of them). An empty batch gives no rows and adds none.
        """
        repeated, batch = batch is not None, batch or uuid.uuid4().hex
        keyed = materialise(docs.select(F.col(key).alias("key"), digest(text).alias("digest")), "digests")
        kind = keyed.schema["key"].dataType.simpleString()
        self.read(kind, 0 if self.buckets or self._exists() else keyed.count())
        cuts: list = []
        if parts > 1:
            some = keyed.where("key IS NOT NULL").orderBy(F.xxhash64("key", "digest")).limit(CUT_SAMPLE)
            some = sorted(r["key"] for r in some.select("key").collect())
            cuts = [some[len(some) * k // parts] for k in range(1, parts)] if some else []
        part = F.lit(0)
        for cut in cuts:
            part = part + F.when(F.col("key") >= F.lit(cut), 0).otherwise(1)
        for p in range(len(cuts) + 1):
            own = keyed.where(part == p) if cuts else keyed
            self.add(own.groupBy("digest").agg(F.max("key").alias("keep_id")), batch if p == 0 else f"{batch}/{p}", repeated)
        sizes = keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("c"))
        known = sizes.join(self.read().hint("merge"), "digest")
        own = (F.col("batch") == batch) | F.col("batch").startswith(f"{batch}/")
        known = materialise(known.select("digest", "keep_id", F.col("c").alias("group_size"), own.alias("own"), "c"), "known")
        out = join_hot(keyed, known, "digest")
        return out.select(F.col("key").alias(key), "digest", "keep_id", "group_size", (F.col("own") & F.col("key").eqNullSafe(F.col("keep_id"))).alias("kept"))

    def kept_rows(self, docs: DataFrame, text: str = "text", key: str = "doc_id", batch: str | None = None, parts: int = 2) -> DataFrame:
        """The documents of a batch that stay, with all their columns; of repeated rows one stays."""
        kept = self.dedup(docs, text, key, batch, parts).where("kept").select(F.col(key).alias("key"), "digest")
        repeats = kept.groupBy("key", "digest").count().where("count > 1").limit(1).count() > 0
        own, id_, of = fresh_name("digest", docs), fresh_name("id", docs), fresh_name("of", docs)
        kept = kept.select(F.col("key").alias(id_), F.col("digest").alias(of))
        rows = docs.withColumn(own, digest(text))
        out = rows.join(kept, (F.col(own) == F.col(of)) & F.col(key).eqNullSafe(F.col(id_)), "left_semi")
        out = out.dropDuplicates([key, own]) if repeats else out
        return out.select(*docs.columns)
