"""An append-only log of entries as tables: replay, insert if absent, retention, compaction."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = 1
LOG = "v int, id string, del boolean, id_source string, title string, link string, content string, summary string, author string, published timestamp, updated timestamp, published_raw string, categories array<string>, source_title string, source_url string, stored_at timestamp"
COMPACT_RECORDS, COMPACT_GARBAGE = 64, 0.5


def live(log: DataFrame, pos: str = "pos") -> DataFrame:
    """The last record of each id, unless it deletes; rows combine before the shuffle."""
    best = log.groupBy("id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "id"]), pos).alias("r"))
    return best.select("id", "r.*").where(~F.coalesce(F.col("del"), F.lit(False)))


def absent(log: DataFrame, entries: DataFrame, now: Column, pos: str = "pos") -> DataFrame:
    """What ``put`` appends: of each new id the first entry, with stored_at; known ids keep their first time."""
    known = live(log, pos).select("id")
    fresh = entries.where(F.coalesce(F.col("id"), F.lit("")) != "").join(known, "id", "left_anti")
    first = fresh.groupBy("id").agg(F.min_by(F.struct(*[c for c in fresh.columns if c != "id"]), "seq").alias("e")).select("id", "e.*")
    return first.withColumns({"v": F.lit(VERSION), "del": F.lit(False), "stored_at": now})


def purged(log: DataFrame, cutoff: Column, pos: str = "pos") -> DataFrame:
    """Tombstones of live records stored strictly before ``cutoff``."""
    return live(log, pos).where(F.col("stored_at") < cutoff).select("id", F.lit(VERSION).alias("v"), F.lit(True).alias("del"))


def stats(log: DataFrame, pos: str = "pos") -> DataFrame:
    per = log.groupBy("id").agg(F.count("*").alias("n"), F.max_by("del", pos).alias("gone"))
    out = per.agg(F.count_if(~F.coalesce(F.col("gone"), F.lit(False))).alias("live"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"))
    return out.select("live", "records", (F.col("records") - F.col("live")).alias("garbage"))


def needs_compaction(records: int, garbage: int) -> bool:
    return records >= COMPACT_RECORDS and garbage >= COMPACT_GARBAGE * records


def replayed(spark, *paths: str) -> DataFrame:
    """The live records of a JSONL log; a damaged line is an error unless it is the torn last one.

    Several files are one log in the order of their paths.  Lines are ordered by file and by split,
    and by their place within a split, however Spark deals splits to tasks.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(list(paths)).withColumn("pos", place)
    parsed = lines.where("trim(value) <> ''").select("pos", F.from_json("value", LOG).alias("r"))
    last = parsed.agg(F.max("pos")).first()[0]
    at = F.struct(F.lit(last["file"]).alias("file"), F.lit(last["block"]).cast("long").alias("block"), F.lit(last["n"]).cast("long").alias("n")) if last is not None else None
    bad = parsed.where((F.col("r").isNull() | F.col("r.id").isNull()) & (F.col("pos") != at)).count() if last is not None else 0
    if bad:
        raise ValueError(f"{bad} damaged lines in the log")
    rows = parsed.where("r.id is not null").select("pos", "r.*")
    if last is not None and rows.where(F.col("v") != VERSION).limit(1).count():
        raise ValueError("unknown log version")
    zero = lambda c: F.when(F.year(c) > 1, F.col(c))
    return live(rows.withColumns({c: zero(c) for c in ("published", "updated")}))


class Store:
    """An append-only log below a folder: parts of Parquet, and numbered manifests that list them.

    A change writes its own rows as one part and then a manifest with one more name, so it costs
    what it adds; readers see whole manifests only, and two writers cannot take the same number.
    Compaction writes the live records as one part and deletes what only older manifests name.
    """

    MOST_PARTS = 256
    SCHEMA = LOG + ", seq bigint, pos bigint"

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self._hadoop.Path("/".join((self.path, *names)))

    def _manifests(self) -> list[int]:
        folder = self._at("manifests")
        if not self._files.exists(folder):
            return []
        return sorted(int(n) for s in self._files.listStatus(folder) if (n := s.getPath().getName()).isdigit())

    def parts(self) -> list[str]:
        have = self._manifests()
        if not have:
            return []
        stream = self._files.open(self._at("manifests", str(have[-1])))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, number: int, parts: list[str]) -> None:
        draft = self._at("manifests", f"draft-{uuid.uuid4().hex}")
        stream = self._files.create(draft, False)
        stream.write(bytearray(json.dumps(parts).encode()))
        stream.close()
        target = self._at("manifests", str(number))
        if self._files.exists(target) or not self._files.rename(draft, target):
            raise RuntimeError(f"another writer has committed version {number}")

    def read(self) -> DataFrame:
        parts = self.parts()
        if not parts:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*(f"{self.path}/parts/{x}" for x in parts))

    def _written(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        have = set(rows.columns)
        empty = self.spark.createDataFrame([], self.SCHEMA).schema
        rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty)).write.parquet(f"{self.path}/parts/{name}")
        return name

    def _append(self, rows: DataFrame) -> None:
        number = (self._manifests() or [0])[-1] + 1
        parts = [*self.parts(), self._written(rows.withColumn("pos", F.lit(number).cast("long")))]
        self._commit(number, parts)
        if len(parts) > self.MOST_PARTS:
            self.compact()

    def put(self, entries: DataFrame, now: Column | None = None) -> None:
        self._append(absent(self.read(), entries, now if now is not None else F.current_timestamp()))

    def get(self, key: str) -> dict | None:
        """The live record of one id; parts are read by that id only."""
        row = live(self.read().where(F.col("id") == key)).first()
        return row.asDict() if row else None

    def purge_before(self, cutoff: Column) -> None:
        self._append(purged(self.read(), cutoff))
        row = stats(self.read()).first()
        if needs_compaction(row["records"], row["garbage"]):
            self.compact()

    def compact(self) -> None:
        """Only live records stay, under one new part; superseded parts and manifests are deleted."""
        old = self._manifests()
        number = (old or [0])[-1] + 1
        part = self._written(live(self.read()))
        self._commit(number, [part])
        for n in old:
            self._files.delete(self._at("manifests", str(n)), True)
        for s in self._files.listStatus(self._at("parts")):
            if s.getPath().getName() != part:
                self._files.delete(s.getPath(), True)

    def stats(self) -> dict:
        """live, records and garbage of the log, and the bytes of its parts."""
        size = sum(self._files.getContentSummary(self._at("parts", x)).getLength() for x in self.parts())
        return stats(self.read()).first().asDict() | {"bytes": size}

    def all(self) -> DataFrame:
        return live(self.read()).orderBy(F.coalesce("published", "updated").desc_nulls_last(), "id")
