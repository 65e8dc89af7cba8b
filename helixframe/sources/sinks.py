"""Writers (K1-K8). Keyed tables are kept as versions: a write makes new folders and then adds a commit, so readers and lost executors never see half a table."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder's name below spark.checkpoint.dir. Where that is unset, a temporary folder serves a local master; on a cluster it is an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that they share with the driver")
        base = f"file://{tempfile.mkdtemp(prefix='helixframe-')}"
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


class KeyedTable:
    """A table of rows with a key; upserts replace all rows of their keys, tombstones delete them.

    Rows lie in buckets by key hash. A merge reads and rewrites the buckets of its own keys alone; its commit names the
    folder of every bucket, and appears whole or not at all: it is written elsewhere and renamed. vacuum() removes the
    folders that no recent commit names.

    order: columns by which rows of a key are compared, those stored before included. Then a key has one row, its
    greatest, whatever the sequence in which rows come: an older row never replaces a newer one, and a delete keeps its
    place in the order as a tombstone, so nothing older comes back. Of equal order a delete wins, then the greater hash
    of the row; null order columns are smallest. Deletes then need the order columns beside the key.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "key", buckets: int = 32, order: tuple[str, ...] = ()):
        self.spark, self.path, self.schema, self.key, self.buckets, self.order = spark, path.rstrip("/"), schema, key, buckets, order
        self.stored = f"{schema}, _gone boolean" if order else schema

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _commit(self, name: str) -> dict[str, str] | None:
        """Bucket -> folder of its rows; None for a file that isn't a whole commit."""
        fs, p = self._fs(f"commits/{name}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def _last(self) -> tuple[int, dict[str, str]]:
        """Number and places of the last whole commit."""
        for name in reversed(self._names("commits")):
            places = self._commit(name)
            if places is not None:
                return int(name), places
        return -1, {}

    def _put(self, number: int, places: dict[str, str]) -> bool:
        """The commit, renamed into place; False where there is a whole one of that number."""
        fs, staged = self._fs(f"staged/{uuid.uuid4().hex}")
        out = fs.create(staged, True)
        out.write(json.dumps(places).encode())
        out.close()
        name = f"{number:09d}"
        _, p = self._fs(f"commits/{name}")
        fs.mkdirs(p.getParent())
        if fs.exists(p) and self._commit(name) is None:
            fs.delete(p, False)
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)  # none: a file that is there stays
        try:
            context.rename(staged, p, options)
        except Exception as e:
            if fs.exists(p):
                fs.delete(staged, False)
                return False
            raise e
        return True

    def _read(self, places: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in sorted(places.items())]
        return self.spark.read.schema(self.stored).parquet(*paths) if paths else self.spark.createDataFrame([], self.stored)

    def read(self) -> DataFrame:
        rows = self._read(self._last()[1])
        return rows.where("not _gone").drop("_gone") if self.order else rows

    def batches(self) -> int:
        return sum(self._commit(name) is not None for name in self._names("commits"))

    def last_batch(self) -> int:
        """The number of the last whole commit; -1 before the first."""
        return self._last()[0]

    def merge(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, batch: int | None = None) -> bool:
        """Applies upserts (full rows) and deletes (keys) as one commit; a batch number that was committed before changes nothing."""
        last, places = self._last()
        if batch is not None and last >= batch:
            return False
        number = last + 1 if batch is None else batch
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        columns = self.spark.createDataFrame([], self.schema).columns
        gone = None
        for df in (upserts, deletes):
            if df is not None:
                keys = df.select(self.key)
                gone = keys if gone is None else gone.unionByName(keys)
        if gone is not None:
            name, gone = uuid.uuid4().hex, gone.distinct()
            touched = {str(r[0]) for r in gone.select(bucket).distinct().collect()}  # at most `buckets` numbers
            old = self._read({b: f for b, f in places.items() if b in touched})
            if self.order:
                new = self._greatest(old, upserts, deletes)
            else:
                new = old.join(gone, self.key, "left_anti").select(*columns)
                if upserts is not None:
                    new = new.unionByName(upserts.select(*columns))
            new.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
            places = {b: f for b, f in places.items() if b not in touched} | {x.removeprefix("bucket="): name for x in self._names(f"data/{name}") if x.startswith("bucket=")}
        return self._put(number, places)

    def _greatest(self, old: DataFrame, upserts: DataFrame | None, deletes: DataFrame | None) -> DataFrame:
        """The greatest row per key of those stored and those that come, tombstones included; aggregated per task first."""
        rows = old
        if upserts is not None:
            rows = rows.unionByName(upserts.select(*[c for c in old.columns if c != "_gone"], F.lit(False).alias("_gone")))
        if deletes is not None:
            known = [F.col(f.name) if f.name in (self.key, *self.order) else F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema.fields if f.name != "_gone"]
            rows = rows.unionByName(deletes.select(*known, F.lit(True).alias("_gone")))
        return greatest_per_key(rows, self.key, *self.order, "_gone")

    def vacuum(self, keep: int = 2) -> int:
        """Removes the data folders that none of the last `keep` commits names; how many went."""
        whole = [c for c in map(self._commit, self._names("commits")) if c is not None]
        used = {f for c in whole[-keep:] for f in c.values()}
        old = [x for x in self._names("data") if x not in used]
        for x in old:
            fs, p = self._fs(f"data/{x}")
            fs.delete(p, True)
        return len(old)


def greatest_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that is greatest by the order columns; of equal ones that of the greater hash, so that no sequence of rows or batches matters."""
    row = F.struct(*df.columns)
    picked = df.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.struct(*order, F.xxhash64(F.to_json(row)))).alias("_row"))
    return picked.select("_row.*")


def write_report(df: DataFrame, path: str, sep: str = ",", single_rows: int = 100_000) -> None:
    """CSV or TSV with a header (K3): one file up to single_rows rows, beyond that one for each partition."""
    small = df.limit(single_rows + 1).count() <= single_rows
    (df.coalesce(1) if small else df).write.csv(path, header=True, sep=sep)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line (K4)."""
    df.write.json(path)


def json_array(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """All rows as one JSON array, for submission files of bounded size, which is checked (K4)."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows: write lines instead")
    return df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("json"))


def bed_rows(df: DataFrame, chrom: str = "chrom", name: str = "variant") -> DataFrame:
    """BED lines coloured by direction (K5); rows without a start or end are left out."""
    s, e = F.least("start_outer", "start_inner"), F.greatest("end_inner", "end_outer")
    return df.where(s.isNotNull() & e.isNotNull()).select(F.concat_ws("\t", chrom, s.cast("string"), e.cast("string"), name, F.lit("500"), F.lit("."), s.cast("string"), e.cast("string"), S.colour("direction")).alias("value"))


def write_bed(df: DataFrame, path: str, position: str | None = None) -> None:
    """A browser track: the position line, then the rows in order; its files, in the order of their names, are the track."""
    lines = bed_rows(df).withColumn("o", F.lit(1))
    if position:
        lines = lines.unionByName(df.sparkSession.createDataFrame([(f"browser position {position}", 0)], "value string, o int"))
    lines.orderBy("o", "value").select("value").write.text(path)


def log_records(df: DataFrame, key: str) -> DataFrame:
    """(key, value) as publish() writes them: the key as text, the other columns as one JSON object; a null column is left out of it (K6)."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("value"))


def publish(df: DataFrame, servers: str, topic: str, stream: bool = False):
    """key and value columns to a topic (K6)."""
    writer = df.writeStream if stream else df.write
    writer = writer.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return writer.start() if stream else writer.save()
