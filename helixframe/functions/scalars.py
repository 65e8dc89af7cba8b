"""Scalar functions as Spark columns: identifiers, parsing, coordinates, dates, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- identifiers (C1-C7, C23, C24, C29) --------------------------------------------------------------------------


def curie_to_iri(c: Column | str, prefixes: dict[str, str] = vocab.PREFIXES) -> Column:
    """prefix:rest to a full IRI (prefix in any case); what has no known prefix stays as it is."""
    c = _c(c)
    root = vocab.lookup(prefixes, F.lower(F.substring_index(c, ":", 1)))
    return F.when(F.contains(c, F.lit(":")) & root.isNotNull(), F.concat(root, F.substring(c, F.instr(c, ":") + 1, F.length(c)))).otherwise(c)


def iri_to_curie(c: Column | str, prefixes: dict[str, str] = vocab.PREFIXES) -> Column:
    """Full IRI to prefix:rest by the longest root that fits; others stay."""
    c, out = _c(c), _c(c)
    for name, root in sorted(prefixes.items(), key=lambda x: len(x[1])):
        out = F.when(F.startswith(c, F.lit(root)), F.concat(F.lit(f"{name}:"), F.substring(c, F.lit(len(root) + 1), F.length(c)))).otherwise(out)
    return out


def keyword_to_iri(c: Column | str) -> Column:
    """:prefix/Name to a full IRI."""
    return curie_to_iri(F.regexp_replace(F.regexp_replace(_c(c), "^:", ""), "^([^/:]+)/", "$1:"))


def normal_hgnc(c: Column | str) -> Column:
    """Upper-cases what is one to five digits with an HGNC: prefix or none."""
    return F.when(_c(c).rlike(r"^((HGNC|hgnc):)?\d{1,5}$"), F.upper(_c(c))).otherwise(_c(c))


def field_to_iri(c: Column | str) -> Column:
    return curie_to_iri(F.upper(F.trim(_c(c))))


def replace_root(c: Column | str, old: str, new: str) -> Column:
    return F.replace(_c(c), F.lit(old), F.lit(new))


def id_tail(c: Column | str, pattern: str) -> Column:
    """The part that fits the pattern, null if none does."""
    return F.nullif(F.regexp_extract(_c(c), pattern, 0), F.lit(""))


def hpo_iri(c: Column | str) -> Column:
    n = F.regexp_extract(_c(c), r"\(HP:(\d+)\)", 1)
    return F.when(n != "", F.concat(F.lit(vocab.PREFIXES["hp"]), n))


def without_spaces(c: Column | str) -> Column:
    return F.replace(_c(c), F.lit(" "), F.lit(""))


def content_id(kind: str, **attributes: Column | str) -> Column:
    """Identifier from a type and its defining attributes, whatever their order."""
    body = F.struct(*[_c(v).alias(k) for k, v in sorted(attributes.items())])
    return F.concat(F.lit(f"{vocab.PREFIXES['gg']}{kind}/"), F.sha2(F.to_json(body), 256))


def feature_hash(*columns: Column | str) -> Column:
    return F.xxhash64(*map(_c, columns))


def set_hash(hashes: Column | str) -> Column:
    """One hash for a set, whatever its order."""
    return F.xxhash64(F.sort_array(F.array_distinct(_c(hashes))))


# ---- numbers (C8, C18-C22) ---------------------------------------------------------------------------------------


def digits(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"\D", "").try_cast("bigint")


def double_or(c: Column | str, default: float | None = -1.0) -> Column:
    """Parsed double; default (None: null) where it can't be parsed."""
    got = _c(c).try_cast("double")
    return got if default is None else F.coalesce(got, F.lit(default))


def long_or_null(c: Column | str) -> Column:
    return _c(c).try_cast("bigint")


def log_odds(p: Column | str) -> Column:
    """ln((1 - p) / p), with infinities at 0 and 1."""
    p = _c(p)
    return F.when(p == 0, F.lit(float("inf"))).when(p == 1, F.lit(float("-inf"))).otherwise(F.log((1 - p) / p))


def round_half_up(x: Column | str) -> Column:
    return F.floor(_c(x) + 0.5)


# ---- locations (C9-C13, C32) -------------------------------------------------------------------------------------


def locus_parts(c: Column | str) -> Column:
    """chr:start-end (or _ or en dash) to struct(chrom, start, end); null if it doesn't fit."""
    pattern = r"(\w+):(.+)[-_–](.+)$"
    part = lambda i: F.regexp_extract(_c(c), pattern, i)
    return F.when(_c(c).rlike(pattern), F.struct(part(1).alias("chrom"), digits(part(2)).alias("start"), digits(part(3)).alias("end")))


#: Groups: build, chromosome, band, start, end, copy number, inheritance. Build is empty for later variants of a line.
ISCN = r"(?:arr\[([^\]]+)\]\s*)?([XY\d]+)([pq][\dpq.]+)\s*\(\s*([\d,]+)[-_]([\d,]+)\s*\)\s*x(\d+)(?:\[[\d.]+\])?\s*(mat|pat|dn)"


def iscn_variants(c: Column | str) -> Column:
    """All copy-number variants of an ISCN line: array of struct(build, chrom, band, start, end, copies, inheritance)."""
    whole = F.regexp_extract_all(_c(c), F.lit(ISCN), 0)
    part = lambda x, i: F.regexp_extract(x, ISCN, i)
    number = lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("bigint")
    return F.transform(whole, lambda x: F.struct(
        F.nullif(part(x, 1), F.lit("")).alias("build"), part(x, 2).alias("chrom"), part(x, 3).alias("band"),
        number(part(x, 4)).alias("start"), number(part(x, 5)).alias("end"), part(x, 6).try_cast("int").alias("copies"), part(x, 7).alias("inheritance"),
    ))


def build_name(c: Column | str) -> Column:
    """grch37 or grch38 for the usual spellings, in any case; others stay."""
    return F.coalesce(vocab.lookup(vocab.BUILDS, F.lower(_c(c))), _c(c))


def refseq(chrom: Column | str, build: Column | str) -> Column:
    """RefSeq IRI of a chromosome (chr prefix or not) on a build; null if unknown."""
    plain = F.regexp_replace(_c(chrom), "^.*chr", "")
    return vocab.lookup(vocab.refseq_table(), F.concat_ws("|", build_name(build), plain))


def attributes(c: Column | str, pair: str = ";", key: str = "=") -> Column:
    """k=v;k=v to a map; a key without a value maps to 'true', of repeated keys the last counts."""
    entries = F.filter(F.split(_c(c), pair), lambda x: F.trim(x) != "")
    return F.map_from_entries(F.transform(_last_of_key(entries, key), lambda x: F.struct(F.trim(F.substring_index(x, key, 1)), F.when(F.contains(x, F.lit(key)), F.substring(x, F.instr(x, key) + 1, F.length(x))).otherwise("true"))))


def _last_of_key(entries: Column, key: str) -> Column:
    name = lambda x: F.trim(F.substring_index(x, key, 1))
    n = F.size(entries)
    return F.filter(entries, lambda x, i: F.forall(F.slice(entries, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda y: name(y) != name(x)))


def gene_id(dbxref: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(dbxref), r"GeneID:(\d+)", 1), F.lit(""))


def location_size(start: Column | str, end: Column | str) -> Column:
    return _c(end) - _c(start)


def extent(start_min, start_max, end_min, end_max) -> Column:
    """struct(min, max) over the coordinates that there are."""
    cs = [_c(x) for x in (start_min, start_max, end_min, end_max)]
    return F.struct(F.least(*cs).alias("min"), F.greatest(*cs).alias("max"))


# ---- dates (C14-C17) ---------------------------------------------------------------------------------------------


def offset_instant(c: Column | str) -> Column:
    """2018-03-27T09:55:41.000-0400 to a timestamp."""
    return F.try_to_timestamp(_c(c), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSZ"))


def date_part(c: Column | str, n: int = 10) -> Column:
    return F.substring(_c(c), 1, n)


def millis_date(c: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(_c(c)), "yyyy-MM-dd")


def instant_text(fixed: str | None = None) -> Column:
    """The current instant as text, or the fixed one, for runs that must repeat."""
    return F.lit(fixed) if fixed else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSX")


# ---- labels and texts (C25-C28, C30-C35) -------------------------------------------------------------------------


def citation(author: Column | str, date: Column | str) -> Column:
    """First author and year."""
    year = F.nullif(F.regexp_extract(_c(date), r"\d{4}", 0), F.lit(""))
    return F.nullif(F.concat_ws(", ", _c(author), year), F.lit(""))


def first_of(*columns: Column | str) -> Column:
    """Fallback chain for labels and descriptions."""
    return F.coalesce(*map(_c, columns))


def list_text(items: Column | str, one: str, many: str, n: int = 10) -> Column:
    """The first n items, spaced, behind the singular or plural wording."""
    items = _c(items)
    return F.concat(F.when(F.size(items) == 1, F.lit(one)).otherwise(F.lit(many)), F.lit(" "), F.array_join(F.slice(items, 1, n), " "))


def colour(direction: Column | str) -> Column:
    return vocab.lookup(vocab.DIRECTION_COLOUR, direction, vocab.OTHER_COLOUR)


def yes_no(c: Column | str) -> Column:
    return F.when(F.upper(_c(c)) == "YES", True).when(F.upper(_c(c)) == "NO", False)


def path_or(c: Column | str, default: str) -> Column:
    return F.coalesce(_c(c).cast("string"), F.lit(default))


def inner_json(c: Column | str, schema: str) -> Column:
    """A JSON text held inside a field, by schema."""
    return F.from_json(_c(c), schema)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
