"""Small helpers that the numbered operators share: reading, shared folders, Arrow maps, string tables."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Where that is unset, a temporary folder serves a local master; on a cluster it is an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that they share with the driver")
        base = f"file://{tempfile.mkdtemp(prefix='helixframe-')}"
        sc.setCheckpointDir(base)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends here, and lost executors cost nothing."""
    path = work_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; what has no scheme, or file:, is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), unquote(urlparse(uri).path)
    return pafs.FileSystem.from_uri(uri)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most so many rows from now on, unless the session already has smaller ones: what a task and its worker hold of long texts is in proportion."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if not 0 < now <= rows:
        spark.conf.set(name, str(rows))


def learn_bucket(key: str, modulus: int):
    """crc32 of the key as text, modulo; null keys count as bucket 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus, F.lit(0))


def arrow_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """mapInArrow with one output batch per input batch, as a function of the batch alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield fn(b)

    return df.mapInArrow(run, schema)


def with_text_columns(df: DataFrame, text: str, make: Callable[[], Callable[[list], list]], fields: list[T.StructField], max_chars: int = 250_000) -> DataFrame:
    """df with columns computed from its text column in Arrow batches.

    make() is called once per task and returns a function from a list of texts (None stays None) to one list per field.
    Texts are taken from a batch, and results handed on, about max_chars bytes at a time (a single longer text comes
    alone), so a task never holds the Python objects of a whole batch.
    An input column that bears the name of an output field is replaced by it.
    """
    kept = [f for f in df.schema.fields if f.name not in {x.name for x in fields} or f.name == text]
    names = [f.name for f in kept]
    clash = text in {x.name for x in fields}
    outer = [f for f in kept if not (clash and f.name == text)]
    schema = T.StructType(outer + fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            texts = b.column(names.index(text))
            own = [b.column(names.index(f.name)).cast(arrow.field(i).type) for i, f in enumerate(outer)]
            for a, z in slices(item_sizes(texts), max_chars):
                made = [pa.array(c, arrow.field(len(outer) + i).type) for i, c in enumerate(fn(texts.slice(a, z - a).to_pylist()))]
                yield pa.RecordBatch.from_arrays([x.slice(a, z - a) for x in own] + made, schema=arrow)
            del b, texts, own
            give_back()

    return df.select(*names).mapInArrow(run, schema)


def item_sizes(column: pa.Array) -> list[int]:
    """Bytes of each string, or items of each list; 0 for null."""
    nested = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
    return pc.fill_null(pc.list_value_length(column) if nested else pc.binary_length(column), 0).to_pylist()


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items whose sizes sum to `most` at most (a larger item has a range of its own)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


#: Tables that a Python worker keeps between tasks: name -> how to empty them.
_TABLES: dict[str, Callable[[], None]] = {}
_in_use = ""


def keep_table(name: str, clear: Callable[[], None]) -> None:
    _TABLES[name] = clear


def use_table(name: str) -> None:
    """Before a task uses a kept table, those of other operators are emptied: a reused worker holds one at a time."""
    global _in_use
    if _in_use != name:
        for other, clear in _TABLES.items():
            if other != name:
                clear()
        gc.collect()
        give_back()
        _in_use = name


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # not glibc
    _trim = None


def give_back() -> None:
    """Returns memory that Arrow and the C library keep for later to the system: a reused worker's share stays small."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


#: Characters that Python's str.split() takes for white space and Unicode's White_Space property does not.
_NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
_SPACE = re.compile(r"[\t-\r \x85\xa0  -     　]+")


def white_split(text: str) -> list[str]:
    """Pieces between Unicode white space."""
    if any(c in text for c in _NOT_SPACE):
        return [x for x in _SPACE.split(text) if x]
    return text.split()


class Offsets:
    """Variable-length items in one flat array with an offset table; take() concatenates chosen items without a Python loop."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray):
        self.flat, self.offsets = flat, offsets

    @classmethod
    def of_bytes(cls, items: list[bytes]) -> Offsets:
        return cls(np.frombuffer(b"".join(items), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in items], dtype=np.int64))))

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen items' values one after another, and the bounds of each (length + 1)."""
        n = self.offsets[which + 1] - self.offsets[which]
        ends = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(self.offsets[which] - ends[:-1], n)
        at += np.arange(ends[-1])
        return self.flat[at], ends


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray | pa.Array]]:
    """Record batches sorted by their first `keys` integer columns, given out as one RecordBatch for each run of equal keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:], strict=False):
            key = tuple(k[:, a].tolist())
            if held and key != last:
                yield _joined(held)
                held = []
            held.append(b.slice(a, z - a))
            last = key
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def forest_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For items 0..n-1 the smallest item that links (left[i], right[i]) reach, by repeated minimum and pointer jumping."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        if np.array_equal(before, root):
            return root
