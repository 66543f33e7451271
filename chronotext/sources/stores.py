"""Tables that are kept by key and changed in batches: keywords, lyrics, profiles.

A store is a folder: ``data`` holds row files by version and bucket of the key, ``versions`` a small file for each version that says which
data folder holds each bucket. A batch is merged into the buckets that its keys fall in; these are written anew, all others stay
where they are. The new version counts once its file is renamed into place, so readers see the old table or the new one, a write
that dies leaves the old one, and every version stays readable. One writer at a time: a second one that publishes the same
version number gets an error and can merge again.

Batches are Spark joins of the batch with the touched buckets; the driver sees bucket numbers alone.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import normal_key
from .folders import placed


class KeyedStore:
    """Rows of ``schema`` under a text key; ``added`` is the place of the batch and row by which a key first came."""

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.schema = StructType.fromDDL(schema)
        self.columns = self.schema.fieldNames()
        self.stored = StructType.fromDDL(f"k string, added array<long>, {schema}")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # versions

    def version(self) -> int:
        """The last published version; 0 is the empty store."""
        folder = self._path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _manifest(self, version: int) -> dict[str, str]:
        if version == 0:
            return {}
        rows = self.spark.read.text(f"{self.path}/versions/{version}.json", wholetext=True).collect()
        return json.loads(rows[0].value)

    def _publish(self, version: int, manifest: dict[str, str]) -> None:
        folder = f"{self.path}/versions"
        self._fs.mkdirs(self._path(folder))
        draft, final = self._path(f"{folder}/_{uuid.uuid4().hex}"), self._path(f"{folder}/{version}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {version} was published by another writer")

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.stored).parquet(*paths) if paths else self.spark.createDataFrame([], self.stored)

    def keyed(self, version: int | None = None) -> DataFrame:
        """All rows of a version (the last) with ``k`` and ``added``."""
        return self._read(sorted(self._manifest(self.version() if version is None else version).values()))

    def read(self, version: int | None = None) -> DataFrame:
        return self.keyed(version).select(*self.columns)

    # changes

    def _bucket(self, k: Column) -> Column:
        return F.pmod(F.xxhash64(k), F.lit(self.buckets))

    def merge(self, changes: DataFrame) -> int:
        """Apply a batch of ``k, seq, op, row, change`` and publish it; the new version.

        In order of ``seq``: ``put`` sets a key's row (its place stays where the key was there), ``remove`` takes the key away, and ``set`` gives a present
        row the fields of ``change`` (of the row's schema) that are not null. Only the last put or remove of a key and the last value of each field after it
        count, and these are aggregates, so a key with very many changes is combined before the shuffle.
        """
        number = self.version()
        manifest = self._manifest(number)
        base = changes.where(F.col("op") != "set").groupBy("k").agg(F.max_by(F.struct("op", "row"), "seq").alias("b"), F.max("seq").alias("at"), F.max(F.when(F.col("op") == "remove", F.col("seq"))).alias("gone"), F.min("seq").alias("first"))
        puts = changes.where(F.col("op") == "put").select("k", F.col("seq").alias("put"))
        # a key that was removed within the batch comes anew, behind the others
        again = puts.join(base.select("k", "gone"), "k").where(F.col("gone").isNull() | (F.col("put") > F.col("gone"))).groupBy("k").agg(F.min("put").alias("came"))
        sets = changes.where(F.col("op") == "set").join(base.select("k", "at"), "k", "left").where(F.col("at").isNull() | (F.col("seq") > F.col("at")))
        last = [F.max_by(F.col(f"change.{c}"), F.when(F.col(f"change.{c}").isNotNull(), F.col("seq"))).alias(c) for c in self.columns]
        sets = sets.groupBy("k").agg(*last).select("k", F.struct(*self.columns).alias("s"))
        keys = base.select("k", "b", "gone").join(again, "k", "left").join(sets, "k", "full_outer").withColumn("bucket", self._bucket(F.col("k")))
        keys = keys.where(F.col("k").isNotNull())
        touched = [str(r.bucket) for r in keys.select("bucket").distinct().collect()]
        if not touched:
            return number
        old = self._read([manifest[b] for b in sorted(touched) if b in manifest])
        old = old.select(F.col("k").alias("k0"), F.col("added").alias("added0"), F.struct(*self.columns).alias("old"))
        both = old.join(keys, F.col("k0") == F.col("k"), "full_outer")
        row = F.when(F.col("b.op") == "put", F.col("b.row")).when(F.col("b").isNull(), F.col("old"))
        stays = F.col("added0").isNotNull() & F.col("gone").isNull()
        added = F.when(stays, F.col("added0")).otherwise(F.array(F.lit(number + 1).cast("long"), F.col("came")))
        out = both.withColumn("__r", row).where(F.col("__r").isNotNull()).select(
            F.coalesce("k", "k0").alias("k"), added.alias("added"), *[F.coalesce(F.col(f"s.{c}"), F.col(f"__r.{c}")).alias(c) for c in self.columns]
        )
        folder = f"{self.path}/data/{number + 1}-{uuid.uuid4().hex}"
        out.withColumn("bucket", self._bucket(F.col("k"))).repartition("bucket").write.partitionBy("bucket").parquet(folder)
        there = {s.getPath().getName().removeprefix("bucket="): s.getPath().toString() for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("bucket=")}
        manifest = {b: p for b, p in manifest.items() if b not in touched} | there
        self._publish(number + 1, manifest)
        return number + 1

    def _changes(self, rows: DataFrame, key: Column, op: str, seq: str) -> DataFrame:
        kind = self.schema.simpleString()
        row = F.struct(*self.columns) if op == "put" else F.lit(None).cast(kind)
        change = F.struct(*[F.col(c) if c in rows.columns else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.columns]) if op == "set" else F.lit(None).cast(kind)
        return rows.select(key.alias("k"), F.col(seq).cast("long").alias("seq"), F.lit(op).alias("op"), row.alias("row"), change.alias("change"))


class KeywordStore(KeyedStore):
    """``word, alias, note, category, enabled`` by the word's letters and digits; shorter words than two of these are refused."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        super().__init__(spark, path, "word string, alias array<string>, note string, category string, enabled boolean", buckets)

    @staticmethod
    def key(word: Column) -> Column:
        return F.lower(normal_key(F.trim(word)))

    def add(self, rows: DataFrame) -> int:
        """Words of ``seq, word`` and what else there is (``alias, note, category``), enabled; a word that is there is replaced."""
        have = lambda c, kind, default: F.coalesce(F.col(c), default).cast(kind).alias(c) if c in rows.columns else default.cast(kind).alias(c)
        alias = F.filter(F.transform(F.col("alias"), lambda a: F.trim(a)), lambda a: a != "") if "alias" in rows.columns else F.lit(None)
        t = rows.select("seq", F.trim("word").alias("word"), F.coalesce(alias.cast("array<string>"), F.array().cast("array<string>")).alias("alias"), have("note", "string", F.lit("")), have("category", "string", F.lit("")), F.lit(True).alias("enabled"))
        t = t.where(F.length(self.key(F.col("word"))) >= 2)
        return self.merge(self._changes(t, self.key(F.col("word")), "put", "seq"))

    def remove(self, words: DataFrame) -> int:
        return self.merge(self._changes(words, self.key(F.col("word")), "remove", "seq"))

    def set_enabled(self, words: DataFrame) -> int:
        """``seq, word, enabled``; words that are not there stay away."""
        return self.merge(self._changes(words.select("seq", "enabled", F.col("word").alias("__w")), self.key(F.col("__w")), "set", "seq"))

    def ordered(self, version: int | None = None) -> DataFrame:
        """With ``place`` from 1 by category and word."""
        return placed(self.read(version), ["category", "word"])


class LyricStore(KeyedStore):
    """``title, artist, source, synced, lines`` by title and artist; documents without lines are refused."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        super().__init__(spark, path, "title string, artist string, source string, synced boolean, lines array<struct<text: string, t_ms: bigint>>", buckets)

    @staticmethod
    def key(title: Column, artist: Column) -> Column:
        return F.concat(F.lower(normal_key(title)), F.lit("\t"), F.lower(normal_key(artist)))

    def add(self, rows: DataFrame, overwrite: bool = True) -> int:
        """Documents of ``seq`` and the store's columns; one that is there is replaced, or left where ``overwrite`` is off."""
        t = rows.where(F.size("lines") > 0).withColumn("artist", F.trim(F.coalesce("artist", F.lit("")))).withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("未命名")))
        changes = self._changes(t, self.key(F.col("title"), F.col("artist")), "put", "seq")
        if not overwrite:
            changes = changes.join(self.keyed().select("k"), "k", "left_anti")
            first = changes.groupBy("k").agg(F.min("seq").alias("seq"))
            changes = changes.join(first, ["k", "seq"])
        return self.merge(changes)

    def remove(self, wanted: DataFrame) -> int:
        """``seq, title, artist``: the document of that title and artist; for those that have none, the title's first one by when it came.

        Requests are matched against the version before the batch, exact ones first; of several loose ones for a title each takes the next.
        """
        w = wanted.select("seq", "title", F.coalesce("artist", F.lit("")).alias("artist"))
        docs = self.keyed().select("k", "title", "added")
        w = w.withColumn("k", self.key(F.col("title"), F.col("artist")))
        exact = w.join(docs.select("k"), "k", "left_semi")
        nth = F.row_number().over(Window.partitionBy("title").orderBy("seq"))
        rest = w.join(docs.select("k"), "k", "left_anti").select("seq", "title", nth.alias("nth"))
        place = F.row_number().over(Window.partitionBy("title").orderBy("added", "k"))
        left = docs.join(exact.select("k").distinct(), "k", "left_anti").join(rest.select("title").distinct(), "title", "left_semi").select("k", "title", place.alias("nth"))
        loose = rest.join(left, ["title", "nth"]).select("k", "seq")
        gone = exact.select("k", "seq").unionByName(loose)
        return self.merge(self._changes(gone.withColumn("__k", F.col("k")), F.col("__k"), "remove", "seq"))

    def ordered(self, version: int | None = None) -> DataFrame:
        """With ``place`` from 1 by artist and title."""
        return placed(self.keyed(version).select("k", *self.columns), ["artist", "title", "k"]).drop("k")
