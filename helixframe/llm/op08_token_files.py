"""Operator 8: token-id shard files with a minimal perfect hash index from document key to offset.

Texts are range-partitioned by key, sorted, encoded and written as files of at most about max_file_bytes of ids, so the
files in order hold the documents in ascending key order. A file is: the ids of all documents, one after another and
unframed (unsigned 16 or 32 bits, little endian); then the index, plain arrays one after another; then a fixed-size
footer. The index places the n distinct keys of the file on the numbers 0..n-1 by a cascade of bit levels (a key settles
at the first level where no other key shares its bit; its number is the count of set bits before it), and holds per
number a 32-bit fingerprint and the key's first record, and per record its key code and where its ids end.

A lookup reads one word and one count per level (under two on average), a fingerprint, a record number, the record's key
code, which confirms the key, and two offsets: a constant number of small range reads, whatever the file's size.

A file is written under a name of its own per attempt, and only attempts that Spark commits appear in the manifest, so
lost executors and repeated tasks leave no half files in the result.

Defined results: a null text counts as empty (its record holds the end id alone); a null key's record is written first
and can be read in order but not looked up; repeated keys keep one record per row, next to each other in one file,
ordered by text (a lookup gives the first); keys of text are known by their 64-bit hash; an empty table gives no files;
other columns are not read.
"""

from __future__ import annotations

import math
import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, item_sizes, keep_table, open_fs, runs, slices, stored, use_table, white_split, work_dir
from .op10_bpe import WORD_END, LetterClasses, Normalizer, PieceTable, letter_classes

MAGIC = b"HXTOKS03"
_FOOTER = np.dtype([("ids", "<u8"), ("docs", "<u8"), ("keys", "<u8"), ("words", "<u8"), ("levels", "<u8"), ("nulls", "<u8"), ("width", "<u8"), ("magic", "S8")])
MANIFEST = "shard int, part int, path string, n_docs long, n_ids long, n_bytes long, first_key long, last_key long"
_NO_KEY = -(2**63)  # stands in for a null key, whose records are the first of a file: the file holds their number


# ---- minimal perfect hashing -------------------------------------------------------------------------------------


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of keys and a seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys by levels of bits: words of bits, set bits before each word, first bit of each level."""

    def __init__(self, bits, before, starts: np.ndarray):
        self.bits, self.before, self.starts = bits, before, starts

    @classmethod
    def build(cls, keys: np.ndarray, room: float = 2.0) -> PerfectHash:
        left, level, words, starts = keys, 0, [], [0]
        while len(left):
            size = max(64, int(len(left) * room) // 64 * 64 + 64)
            at = (mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            starts.append(starts[-1] + size)
            left, level = left[~alone[at]], level + 1
        bits = np.concatenate(words) if words else np.zeros(0, "<u8")
        return cls(bits, np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits), np.array(starts, np.int64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for a key that surely isn't one of those built in (others need to be confirmed)."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level in range(len(self.starts) - 1):
            if not len(open_):
                break
            size = int(self.starts[level + 1] - self.starts[level])
            bit = self.starts[level] + (mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, within = bit >> 6, (bit & 63).astype(np.uint64)
            value = self.bits[word]
            hit = (value >> within) & np.uint64(1) == 1
            below = np.bitwise_count(value & ((np.uint64(1) << within) - np.uint64(1)))
            out[open_[hit]] = self.before[word[hit]] + below[hit]
            open_ = open_[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 977) >> np.uint64(32)).astype("<u4")


def key_codes(keys) -> np.ndarray:
    """64-bit codes of document keys: whole numbers as they are, text by xxhash."""
    return np.array([_NO_KEY if k is None else k if isinstance(k, int) else xxhash.xxh3_64_intdigest(str(k)) - 2**63 for k in keys], np.int64)


# ---- one file ----------------------------------------------------------------------------------------------------


class ShardWriter:
    def __init__(self, uri: str, width: int):
        self.fs, path = open_fs(uri)
        self.fs.create_dir(os.path.dirname(path), recursive=True)
        self.out, self.width = self.fs.open_output_stream(path), width
        self.codes: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.n_ids = self.nulls = 0

    def add(self, codes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, nulls: int = 0) -> None:
        """Records in order of their keys; the first `nulls` of them have none."""
        self.nulls += nulls
        self.out.write(ids.astype("<u2" if self.width == 2 else "<u4").tobytes())
        self.codes.append(codes)
        self.lengths.append(lengths)
        self.n_ids += len(ids)

    def close(self) -> tuple[int, int, int, int | None, int | None]:
        """Writes index and footer; documents, ids, bytes, and the smallest and largest key code."""
        codes = np.concatenate(self.codes) if self.codes else np.zeros(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(np.concatenate(self.lengths) if self.lengths else np.zeros(0, np.int64))))
        keys, first = np.unique(codes[self.nulls :], return_index=True)
        first = first + self.nulls
        table = PerfectHash.build(keys.view(np.uint64))
        slots = table.slots(keys.view(np.uint64))
        prints, records = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u4")
        prints[slots], records[slots] = fingerprints(keys.view(np.uint64)), first
        index = (ends.astype("<i8"), codes.astype("<i8"), table.bits, table.before.astype("<i8"), table.starts.astype("<i8"), prints, records)
        for a in index:
            self.out.write(a.tobytes())
        self.out.write(np.array([(self.n_ids, len(codes), len(keys), len(table.bits), len(table.starts), self.nulls, self.width, MAGIC)], _FOOTER).tobytes())
        self.out.close()
        size = self.n_ids * self.width + sum(a.nbytes for a in index) + _FOOTER.itemsize
        return len(codes), self.n_ids, size, *((int(keys[0]), int(keys[-1])) if len(keys) else (None, None))


class _Range:
    """An array inside a file: chosen items are read one by one, a slice by one range read."""

    def __init__(self, file, at: int, n: int, dtype: str):
        self.file, self.at, self.n, self.dtype = file, at, n, np.dtype(dtype)

    def __len__(self) -> int:
        return self.n

    def slice(self, first: int, last: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((last - first) * self.dtype.itemsize, self.at + first * self.dtype.itemsize), self.dtype)

    def __getitem__(self, which: np.ndarray) -> np.ndarray:
        return np.array([self.slice(i, i + 1)[0] for i in which.tolist()], self.dtype)


class ShardReader:
    """Random and ordered access to one file. The index is read item by item, or at once with whole=True (for many keys)."""

    def __init__(self, uri: str, whole: bool = False):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        foot = np.frombuffer(self.file.read_at(_FOOTER.itemsize, size - _FOOTER.itemsize), _FOOTER)[0]
        if foot["magic"] != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self.width, self.n_ids, self.n_docs, self.nulls = int(foot["width"]), int(foot["ids"]), int(foot["docs"]), int(foot["nulls"])
        keys, words = int(foot["keys"]), int(foot["words"])
        at, arrays = self.n_ids * self.width, []
        for n, dtype in ((self.n_docs + 1, "<i8"), (self.n_docs, "<i8"), (words, "<u8"), (words, "<i8"), (int(foot["levels"]), "<i8"), (keys, "<u4"), (keys, "<u4")):
            arrays.append(_Range(self.file, at, n, dtype))
            at += n * arrays[-1].dtype.itemsize
        if whole:
            arrays = [a.slice(0, len(a)) for a in arrays]
        self.ends, self.codes, bits, before, starts, self.prints, self.records = arrays
        self.table = PerfectHash(bits, before, starts if whole else starts.slice(0, len(starts)))

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> ShardReader:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def find(self, keys) -> np.ndarray:
        """The first record of each key, -1 if the file has no such key. The fingerprint rules out most strange keys, the key code the rest."""
        codes = keys if isinstance(keys, np.ndarray) else key_codes(keys)
        known = np.ones(len(codes), bool) if isinstance(keys, np.ndarray) else np.array([k is not None for k in keys], bool)
        out = np.full(len(codes), -1, np.int64)
        slots = self.table.slots(codes.view(np.uint64))
        at = np.flatnonzero((slots >= 0) & known)
        at = at[self.prints[slots[at]] == fingerprints(codes[at].view(np.uint64))]
        records = self.records[slots[at]].astype(np.int64)
        same = self.codes[records] == codes[at]
        out[at[same]] = records[same]
        return out

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids of records first to last - 1."""
        a, z = self.ends[np.array([first, last])].tolist()
        return np.frombuffer(self.file.read_at((z - a) * self.width, a * self.width), "<u2" if self.width == 2 else "<u4")

    def get(self, key) -> np.ndarray | None:
        """Ids of the (first) document with this key."""
        record = int(self.find([key])[0])
        return None if record < 0 else self.ids(record, record + 1)


# ---- encoding with the tokenizers library ------------------------------------------------------------------------

_LIBRARY: dict[str, LibraryWords] = {}
keep_table("library", _LIBRARY.clear)


class LibraryWords:
    """Pieces and their words in one bounded table; every word is encoded by the tokenizers library once while the table holds it.

    Unknown words are handed to the library many at a time, spaced in one text; the ids are cut behind tokens that end
    a word. A piece of several words is put together from theirs.
    """

    def __init__(self, path: str, max_pieces: int = 400_000, joined: int = 64, classes: LetterClasses | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True
        self.known = PieceTable(None, max_pieces)
        classes = classes or letter_classes(path)
        self.normal, self.find_pieces = Normalizer(classes), classes.pieces().findall
        self.joined = joined

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[str]) -> None:
        groups = [words[i : i + self.joined] for i in range(0, len(words), self.joined)]
        for group, ids in zip(groups, self.encode([" ".join(g) for g in groups]), strict=True):
            ids = np.array(ids, np.uint32)
            cuts = np.flatnonzero(self.ends_word[ids]) + 1
            if len(cuts) == len(group):
                self.known.add_all(group, ids, cuts)
            else:  # not words of this family: one by one
                for w, own in zip(group, self.encode(group), strict=True):
                    self.known.add(w, own)

    def learn(self, new: set) -> None:
        """Adds pieces that aren't known: normalised text, or one-element tuples of text as it came."""
        known = self.known
        words, parts, several, raw = [], set(), [], []
        for p in new:
            if not isinstance(p, str):
                raw.append(p)
            elif p.isascii() and p.isalpha():
                words.append(p)
            else:
                found = self.find_pieces(p)
                if len(found) == 1 and found[0] == p:
                    words.append(p)
                else:
                    several.append((p, found))
                    parts.update(found)
        for p, ids in zip(raw, self.encode([p[0] for p in raw]), strict=True):
            known.add(p, ids)
        words += [w for w in parts if w not in known and w not in new]
        self._learn_words(words)
        ids, ends = known.ids, known.ends
        for p, found in several:
            if p not in known:
                known.add(p, [i for w in found for i in ids[ends[known[w]] : ends[known[w] + 1]]])

    def encode_all(self, pieces: list[list]) -> tuple[np.ndarray, np.ndarray]:
        return self.known.encode_all(pieces, self.learn)


    def split(self, text: str) -> list:
        """White-space pieces: normalised ones where that surely leaves the library's ids as they are, else one-element tuples."""
        if text.isascii():
            low = text.lower()
            plain = "<|" not in low
        else:
            low = None if any(map(self.normal.__getitem__, set(text))) else self.normal(text)
            plain = low is not None and "<|" not in low and unicodedata.is_normalized("NFC", low)
        return white_split(low) if plain else [(p,) for p in white_split(text)]


def library_encoder(path: str, classes: LetterClasses | None = None):
    """From a list of texts to (ids, bounds): every distinct word goes through the tokenizers library, once while it is remembered.

    Fit for vocabularies whose pre-tokens do not cross white space and whose white space makes no tokens.
    """
    use_table("library")
    if path not in _LIBRARY:
        _LIBRARY[path] = LibraryWords(path, classes=classes)
    words = _LIBRARY[path]
    return lambda texts: words.encode_all(list(map(words.split, texts)))


# ---- Spark -------------------------------------------------------------------------------------------------------


def write(
    docs: DataFrame, path: str, vocabulary: str, vocab_size: int, end_id: int, key: str = "doc_id", text: str = "text", docs_per_task: int = 200_000, max_file_bytes: int = 1 << 30
) -> DataFrame:
    """Writes docs as shard files below path; returns the manifest with each file's first global id position (`base`).

    There is a task per docs_per_task documents (spark.sql.shuffle.partitions at least), and a task begins a new file
    when one holds max_file_bytes of ids. The manifest (one row per file) is stored beside the files.
    """
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(docs.count() / docs_per_task))
    width = 2 if max(vocab_size, end_id + 1) <= 65536 else 4
    classes = letter_classes(vocabulary)

    def row(shard: int, part: int, uri: str, done: tuple) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 5)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((shard, part, uri, *done), kinds, strict=True)], [x.split()[0] for x in MANIFEST.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, uri, shard, part, last = library_encoder(vocabulary, classes), None, "", TaskContext.get().partitionId(), 0, None
        for b in batches:
            keys, none = key_codes(b.column(0).to_pylist()), b.column(0).is_null().to_numpy(zero_copy_only=False)
            for a, z in slices(item_sizes(b.column(1)), min(1_000_000, max_file_bytes)):
                ids, ends = encode([t or "" for t in b.column(1).slice(a, z - a).to_pylist()])
                ids, lengths = np.insert(ids, ends[1:], end_id), np.diff(ends) + 1
                if out is not None and out.n_ids * width >= max_file_bytes:
                    same = int(np.argmin(np.append(keys[a:z] == last, False)))  # rows of the last key stay in its file
                    out.add(keys[a : a + same], ids[: lengths[:same].sum()], lengths[:same], int(none[a : a + same].sum()))
                    ids, lengths, a = ids[lengths[:same].sum() :], lengths[same:], a + same
                    if a < z:
                        yield row(shard, part, uri, out.close())
                        out, part = None, part + 1
                if a < z:
                    if out is None:
                        uri = f"{path}/shard-{shard:06d}-{part:04d}-{uuid.uuid4().hex}.tok"
                        out = ShardWriter(uri, width)
                    out.add(keys[a:z], ids, lengths, int(none[a:z].sum()))
                    last = keys[z - 1]
            del b
            give_back()
        if out is not None:
            yield row(shard, part, uri, out.close())

    # rows of a hot key (null among them) are split by a hash of their texts, and stay in the order of keys
    ordered = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h")).repartitionByRange(n, "k", "h").sortWithinPartitions("k", "h", "t").select("k", "t")
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    # one row per file: a window over all of them is small
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_back(manifest: DataFrame, chunk_ids: int = 4_000_000) -> DataFrame:
    """Per document of the files (whole-number keys): where it starts among all ids, how many it has, and their CRC-32.

    Each record is found by its key through the index (the first of a repeated key; the others follow it) and read by
    range; payload is held chunk_ids at a time.
    """
    spark = manifest.sparkSession
    rows = manifest.select("path", "base").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with ShardReader(path, whole=True) as f:
                    records = f.find(f.codes)
                    own = f.codes[f.nulls :]
                    again = np.arange(len(own)) - np.searchsorted(own, own)  # which of a repeated key's records
                    records = np.concatenate((np.arange(f.nulls), records[f.nulls :] + again))
                    at = 0
                    while at < len(records):
                        to = max(at + 1, int(np.searchsorted(f.ends, f.ends[at] + chunk_ids, "right")) - 1)
                        ids, origin = f.ids(at, to), int(f.ends[at])
                        raw = memoryview(ids.astype("<u4").tobytes())
                        starts, stops = f.ends[records[at:to]], f.ends[records[at:to] + 1]
                        crcs = [zlib.crc32(raw[4 * (a - origin) : 4 * (z - origin)]) for a, z in zip(starts.tolist(), stops.tolist(), strict=True)]
                        codes = f.codes[at:to]
                        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64(), mask=np.arange(at, to) < f.nulls), pa.array(starts + base, pa.int64()), pa.array(stops - starts, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        at = to

    return rows.mapInArrow(run, READ)


def lookup(keys: DataFrame, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids of the (first) documents with the given whole-number keys: (key, ids); keys that no file has are left out.

    Files hold key ranges that meet at most in a key whose records go on in the next file, so each key goes to the first
    file whose range it may lie in; every file is opened once and asked for its own keys alone. Both tables may be of any size: only the files' first and last keys (16
    bytes a file) are sent to all tasks.
    """
    files = manifest.where("first_key is not null").select("first_key", "last_key", "path").orderBy("first_key", "last_key").toArrow()  # a row per file
    first, last, paths = (files.column(i).to_numpy() for i in (0, 1, 2))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(0).to_numpy()
            at = np.searchsorted(last, k)
            good = np.flatnonzero(np.append(first, 2**63 - 1)[at] <= k) if len(first) else np.zeros(0, int)
            good = good[at[good] < len(first)]
            yield pa.RecordBatch.from_arrays([pa.array(at[good], pa.int64()), pa.array(k[good], pa.int64())], ["f", "k"])

    places = manifest.sparkSession.createDataFrame([(i, str(p)) for i, p in enumerate(paths.tolist())], "f long, path string")
    routed = keys.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k")).distinct().mapInArrow(route, "f long, k long")
    asked = routed.join(places, "f").select("f", "k", "path").repartition("f").sortWithinPartitions("f", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, 1):
            codes = b.column(1).to_numpy()
            with ShardReader(b.column(2)[0].as_py(), whole=len(codes) > 64) as f:
                found = f.find(codes)
                for code, r in zip(codes[found >= 0].tolist(), found[found >= 0].tolist(), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([code], pa.int64()), pa.array([f.ids(r, r + 1).astype(np.int64)], pa.list_(pa.int64()))], [key, "ids"])

    return asked.mapInArrow(run, f"{key} long, ids array<long>")


def token_files(spark: SparkSession, docs: DataFrame, vocabulary: str, vocab_size: int, end_id: int) -> DataFrame:
    """Writes docs in a new shared folder and reads the files back."""
    manifest = write(docs, work_dir(spark, "tokens"), vocabulary, vocab_size, end_id)
    return read_back(stored(manifest, "manifest"))
