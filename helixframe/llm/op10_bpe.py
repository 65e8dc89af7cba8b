"""Operator 10: exact BPE encoding by backtracking, decoding by an offset table.

Encoding finds, by an Aho-Corasick automaton over all tokens, the longest token at each place of a word, and goes from
left to right: a token is accepted if the pair it forms with the token before it is compatible (merging the two tokens'
text would give exactly these two); otherwise a shorter token is tried, and if none is left the last token is taken
back. A place proved dead is not entered again, so the work is linear in the word's length. Verdicts on pairs are kept.

Tokens never cross white space in this tokenizer family, so results are kept by white-space piece (a bounded table that
is emptied when full); joining the ids of a batch of texts is one NumPy gather.

Which characters are letters, numbers or white space, and how they are normalised, is what the tokenizers library says
of each code point: LetterClasses asks it once, on the driver, as Unicode tables differ from library to library.

Defined results: a null text counts as empty; an empty text has no ids; texts of any length are encoded whole; repeated
rows give repeated results; an empty table gives an empty result; other columns pass through, except those that bear the
name of a result column, which are replaced.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from bisect import bisect_right
from functools import lru_cache
from itertools import repeat

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Offsets, keep_table, use_table, white_split, with_text_columns

#: Fixed values of this tokenizer family: endings that are pieces of their own, and the mark of a word's end.
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
WORD_END = "</w>"

_PRIVATE = 0xF0000  # code points for base symbols inside the automaton


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


Ranges = list[tuple[int, int]]  # first and last code point


def _merged(ranges: Ranges) -> Ranges:
    out: Ranges = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(z, out[-1][1])
        else:
            out.append((a, z))
    return out


def _class(ranges: Ranges) -> str:
    """The inside of a regular expression's brackets."""
    return "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in ranges)


_CODE_POINTS = [(0, 0xD7FF), (0xE000, 0x10FFFF)]  # without surrogates


def _probe_kinds(pre, first: int, last: int, found: dict[str, Ranges]) -> None:
    """Sorts a range of code points into letter, number, space and other by how the library cuts them between a letter and a mark."""
    n = last - first + 1
    points = [chr(c) for c in range(first, last + 1)]

    def cut(text: str) -> list[tuple[int, int]]:
        return [x[1] for x in pre.pre_tokenize_str("a" + text + "!")]

    spans = cut("".join(points))
    for kind, want in (("letter", [(0, n + 1), (n + 1, n + 2)]), ("other", [(0, 1), (1, n + 2)]), ("space", [(0, 1), (n + 1, n + 2)])):
        if spans == want:
            found[kind].append((first, last))
            return
    # letters and marks in turn are cut like numbers, twice each they are not
    if spans == [(i, i + 1) for i in range(n + 2)] and (n == 1 or len(cut("".join(c + c for c in points))) == 2 * n + 2):
        found["number"].append((first, last))
        return
    if n == 1:
        raise ValueError(f"the pre-tokenizer cuts U+{first:04X} in a way of its own")
    middle = (first + last) // 2
    _probe_kinds(pre, first, middle, found)
    _probe_kinds(pre, middle + 1, last, found)


def _probe_normal(normalizer, points: list[int], differing: list[int]) -> None:
    """Adds the code points that the library normalises otherwise than _normal()."""
    if normalizer.normalize_str(" ".join(map(chr, points))) == " ".join(_normal(chr(c)) for c in points):
        return
    if len(points) == 1:
        differing.append(points[0])
        return
    _probe_normal(normalizer, points[: len(points) // 2], differing)
    _probe_normal(normalizer, points[len(points) // 2 :], differing)


class LetterClasses:
    """How the tokenizers library sorts and normalises code points, as ranges.

    odd: code points whose normalisation may differ between Unicode versions: those that the library treats otherwise by
    themselves, those not assigned here, and those assigned after version 3.2 that combine or are part of a composition.
    Texts with any of them are normalised by the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        found: dict[str, Ranges] = {"letter": [], "number": [], "space": [], "other": []}
        for first, last in _CODE_POINTS:
            for at in range(first, last + 1, 4096):
                _probe_kinds(tokenizer.pre_tokenizer, at, min(at + 4095, last), found)
        self.path, self.kinds = path, {k: _merged(v) for k, v in found.items()}
        spaces = {c for a, z in self.kinds["space"] for c in range(a, z + 1)}
        odd: list[int] = []
        known = [c for a, z in _CODE_POINTS for c in range(a, z + 1) if c not in spaces and unicodedata.category(chr(c)) != "Cn"]
        for i in range(0, len(known), 1024):
            _probe_normal(tokenizer.normalizer, known[i : i + 1024], odd)
        assigned = set(known)
        for c in known:
            if unicodedata.ucd_3_2_0.category(chr(c)) == "Cn":
                parts = unicodedata.decomposition(chr(c))
                if unicodedata.combining(chr(c)):
                    odd.append(c)
                if parts and not parts.startswith("<"):
                    odd += [c, *(int(x, 16) for x in parts.split())]
        unknown = [(c, c) for a, z in _CODE_POINTS for c in range(a, z + 1) if c not in assigned and c not in spaces]
        self.odd = _merged([(c, c) for c in odd] + unknown)

    def pieces(self) -> re.Pattern:
        """Pieces of normalised text that are merged separately."""
        letter, number, space = (_class(self.kinds[k]) for k in ("letter", "number", "space"))
        return re.compile(f"{ENDINGS}|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")


@lru_cache(maxsize=4)
def letter_classes(path: str) -> LetterClasses:
    return LetterClasses(path)


class Normalizer(dict):
    """Texts normalised as the library does; the dictionary holds for each character met whether it is odd."""

    def __init__(self, classes: LetterClasses):
        super().__init__()
        self.path, self.library = classes.path, None
        self.starts, self.lasts = [a for a, _ in classes.odd], [z for _, z in classes.odd]

    def __missing__(self, c: str) -> bool:
        i = bisect_right(self.starts, ord(c)) - 1
        found = self[c] = i >= 0 and ord(c) <= self.lasts[i]
        return found

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if not any(map(self.__getitem__, set(text))):
            return _normal(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).normalizer
        return self.library.normalize_str(text)


class BacktrackingBpe:
    """Encoder for a vocabulary file with word ends whose merged tokens are numbered in merge order."""

    def __init__(self, path: str, classes: LetterClasses | None = None):
        classes = classes or letter_classes(path)
        self.normal, self.find_pieces = Normalizer(classes), classes.pieces().findall
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        letters = byte_letters()
        base = [ids[c] for c in letters] + [ids[c + WORD_END] for c in letters]
        self.inner = "".join(chr(_PRIVATE + ids[c]) for c in letters)
        self.final = "".join(chr(_PRIVATE + ids[c + WORD_END]) for c in letters)
        size = max(ids.values()) + 1
        symbols = [""] * size
        for i in base:
            symbols[i] = chr(_PRIVATE + i)
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[tuple[int, int], int] = {}
        previous = -1
        for a, b in merges:
            x, y, z = ids[a], ids[b], ids[a + b]
            if z <= previous:
                raise ValueError("the vocabulary does not number its tokens in merge order")
            previous = z
            self.left[z], self.right[z], self.merged[x, y] = x, y, z
            symbols[z] = symbols[x] + symbols[y]
        self.width = [len(s) for s in symbols]
        self.by_symbols = {s: i for i, s in enumerate(symbols) if s}
        self.symbols = symbols
        self.automaton = ahocorasick.Automaton()
        for s, i in self.by_symbols.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}  # first id << 20 | second id -> do they hold
        self.shorter: dict[int, int] = {}
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.special = special
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        names = dict(sorted([(i, s) for s, i in ids.items()] + [(i, s) for s, i in special.items()]))
        count = max(names) + 1
        self.names = Offsets.of_bytes([(names.get(i, "") + " ").encode() for i in range(count)])
        self.decimals = Offsets.of_bytes([b"%d " % i for i in range(count)])

    def compatible(self, a: int, b: int) -> bool:
        """Would merging the text of a and b give a, b? Undo merges from the latest back; a merge across the seam that comes earlier breaks the pair."""
        known = self.pairs.get(a << 20 | b)
        if known is None:
            if len(self.pairs) > 150_000:
                self.pairs.clear()
            known = self.pairs[a << 20 | b] = self._seam_holds(a, b)
        return known

    def _seam_holds(self, a: int, b: int) -> bool:
        bound = 1 << 60
        while True:
            if self.merged.get((a, b), bound) < bound:
                return False
            if a > b:
                bound, a = a, self.right[a]
                if a != bound:
                    continue
                bound, b0 = b + 1, b
                b = self.left[b]
                if b == b0:
                    return True
            else:
                bound, b0 = b + 1, b
                b = self.left[b]
                if b != b0:
                    continue
                bound, a0 = a, a
                a = self.right[a]
                if a == a0:
                    return True

    def prefix_token(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 if there is none."""
        found = self.shorter.get(token)
        if found is None:
            s, found = self.symbols[token], -1
            for n in range(len(s) - 1, 0, -1):
                found = self.by_symbols.get(s[:n], -1)
                if found >= 0:
                    break
            self.shorter[token] = found
        return found

    def encode_symbols(self, s: str) -> list[int]:
        whole = self.by_symbols.get(s)
        if whole is not None:
            return [whole]
        n = len(s)
        longest = [0] * n
        span = [0] * n
        width = self.width
        for end, token in self.automaton.iter(s):
            start = end + 1 - width[token]
            if width[token] > span[start]:
                span[start], longest[start] = width[token], token
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token, last, pairs = 0, longest[0], -1, self.pairs
        while at < n:
            end = at + width[token]
            if not dead[end]:
                fits = last < 0 or pairs.get(last << 20 | token)
                if fits is None:
                    fits = self.compatible(last, token)
                if fits:
                    out.append(token)
                    at, last = end, token
                    if at < n:
                        token = longest[at]
                    continue
            token = self.prefix_token(token)
            if token < 0:
                dead[at] = 1
                token = out.pop()
                at -= width[token]
                last = out[-1] if out else -1
        return out

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of text between white space, already split from special tokens and normalised."""
        out: list[int] = []
        for word in self.find_pieces(piece):
            raw = word.encode()
            out += self.encode_symbols(codecs.charmap_decode(raw[:-1], "strict", self.inner)[0] + self.final[raw[-1]])
        return out

    def pieces(self, text: str) -> list:
        """White-space pieces of the normalised text; a special token is a one-element tuple of its id."""
        if self.special_split is not None and "<|" in text and self.special_split.search(text):
            out: list = []
            for part in self.special_split.split(text):
                out += [(self.special[part],)] if part in self.special else white_split(self.normal(part))
            return out
        return white_split(self.normal(text))

    def names_of(self, ids: np.ndarray) -> bytes:
        """Decoded text of ids: token strings from the offset table, joined by a space."""
        return self.names.take(ids)[0].tobytes()[:-1]


def _normal(text: str) -> str:
    """NFC, then lower case of each character by itself."""
    text = unicodedata.normalize("NFC", text)
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


class PieceTable(dict):
    """Piece -> row of a flat id store; misses are encoded, and the table is emptied when it holds max_pieces."""

    def __init__(self, encode, max_pieces: int = 300_000):
        super().__init__()
        self.encode, self.max_pieces = encode, max_pieces
        self.ids, self.ends = array("I"), array("q", [0])

    def __missing__(self, piece):
        self.add(piece, piece if isinstance(piece, tuple) else self.encode(piece))
        return self[piece]

    def reset(self) -> None:
        self.clear()
        self.ids, self.ends = array("I"), array("q", [0])

    def add(self, piece, ids) -> None:
        self[piece] = len(self.ends) - 1
        self.ids.extend(ids)
        self.ends.append(len(self.ids))

    def add_all(self, pieces: list, ids: np.ndarray, ends: np.ndarray) -> None:
        """Adds pieces whose ids stand one after another in ids; ends: where each one's stop."""
        n, at = len(self.ends) - 1, len(self.ids)
        self.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.ids.frombytes(ids.astype(np.uint32).tobytes())
        self.ends.frombytes((ends + at).astype(np.int64).tobytes())

    def encode_all(self, pieces: list[list], learn=None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's bounds. learn, if given, adds a set of unknown pieces at once."""
        if len(self) > self.max_pieces:
            self.reset()
        flat = [p for x in pieces for p in x]
        if learn is None:
            rows = np.fromiter(map(self.__getitem__, flat), np.int64, len(flat))
        else:
            rows = np.fromiter(map(self.get, flat, repeat(-1)), np.int64, len(flat))
            holes = np.flatnonzero(rows < 0)
            missing = [flat[i] for i in holes.tolist()]
            learn(set(missing))
            rows[holes] = np.fromiter(map(self.__getitem__, missing), np.int64, len(missing))
        store = Offsets(np.frombuffer(self.ids, np.uint32) if len(self.ids) else np.zeros(0, np.uint32), np.frombuffer(self.ends, np.int64))
        ids, ends = store.take(rows)
        return ids, ends[np.concatenate(([0], np.cumsum([len(x) for x in pieces], dtype=np.int64)))]


_ENCODERS: dict[str, tuple[BacktrackingBpe, PieceTable]] = {}
keep_table("bpe", _ENCODERS.clear)


def encoder(path: str, classes: LetterClasses | None = None) -> tuple[BacktrackingBpe, PieceTable]:
    """The encoder of a vocabulary file and its piece table, once per Python worker."""
    use_table("bpe")
    if path not in _ENCODERS:
        bpe = BacktrackingBpe(path, classes)
        _ENCODERS[path] = bpe, PieceTable(bpe.encode_piece)
    return _ENCODERS[path]


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the array of token ids of each text (null: empty)."""
    classes = letter_classes(vocabulary)

    def make():
        bpe, known = encoder(vocabulary, classes)

        def run(texts):
            flat, ends = known.encode_all([bpe.pieces(t or "") for t in texts])
            return [[flat[a:z].astype(np.int32) for a, z in zip(ends, ends[1:], strict=False)]]

        return run

    return with_text_columns(docs, text, make, [T.StructField(ids, T.ArrayType(T.IntegerType()))])


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of each id array (null stays null), as token strings joined by a space."""
    classes = letter_classes(vocabulary)

    def make():
        bpe, _ = encoder(vocabulary, classes)
        return lambda rows: [[None if r is None else bpe.names_of(np.asarray(r, np.int64)).decode() for r in rows]]

    return with_text_columns(df, ids, make, [T.StructField(text, T.StringType())])


def round_trip_digests(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """docs (text dropped) with n_tokens, SHA-256 of the decimal ids and SHA-256 of the text decoded from them: encode and decode in one pass."""
    classes = letter_classes(vocabulary)

    def make():
        bpe, known = encoder(vocabulary, classes)

        def run(texts):
            flat, ends = known.encode_all([bpe.pieces(t or "") for t in texts])
            digests = []
            for strings in (bpe.decimals, bpe.names):
                raw, bounds = strings.take(flat)
                raw, cuts = raw.tobytes(), bounds[ends].tolist()
                digests.append([hashlib.sha256(raw[a : max(a, z - 1)]).hexdigest() for a, z in zip(cuts, cuts[1:], strict=False)])
            return [np.diff(ends).tolist(), *digests]

        return run

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return with_text_columns(docs, text, make, fields).drop(text)
