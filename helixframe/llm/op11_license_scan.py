"""Operator 11 [native]: license scan by ordered signature rules, gated by keywords, with interval-containment suppression.

A text becomes its words: A-Z lower-cased, split at ASCII characters that are neither digits nor letters. The rules are
regular expressions over words. They are written once per license family and spelt out over its versions and forms (the
notice, the name with a version, the bare name, an SPDX line, the address of the text), some hundreds in all. A rule is
tried where all its keywords stand among the words; one hash set of a text's words tells which of the keywords (about a
hundred) do.

Rules have a priority: 1 notices and license texts, 2 names with versions, 3 bare names, 4 hints and the base phrases.
A detection goes if one of a higher priority, or an earlier or longer one of its own, spans all its words. Containment is
decided in one fold over detections in order of their starts.

Everything is built-in functions inside one projection: no Python worker, no shuffle, no join; a row needs nothing but
itself, so skew in any column doesn't matter and a lost task costs its own rows alone. Rules are a literal of the plan
(about 100 KB).

Defined results: a null text counts as empty: no words, no detections, score 0. Repeated rows and rows with null keys
are scanned like others; an empty table gives an empty result. Very long texts are scanned whole. All columns of the
input pass through, but one of the result's name, which is replaced.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BEGIN, _END = "\x01", "\x02"

#: Score of the strongest detection that is left, by priority.
WEIGHTS = (1.0, 0.9, 0.7, 0.4)
TIERS = len(WEIGHTS)


@dataclass(frozen=True)
class Rule:
    """A pattern over words (single spaces between them), tried where all keywords are words of the text."""

    tier: int
    label: str
    keywords: tuple[str, ...]
    pattern: str
    base: bool = False

    @property
    def regex(self) -> str:
        """The pattern over padded text, in which every word has a space of its own on either side; group 1 holds the words."""
        return " (" + self.pattern.replace(" ", "  ") + ") "


#: The base phrases; they are counted wherever they stand.
BASE = (
    Rule(4, "cc-by", ("cc", "by"), "cc by", True),
    Rule(4, "gpl", ("general", "public", "license"), "general public license", True),
    Rule(4, "reserved", ("all", "rights", "reserved"), "all rights reserved", True),
)


@dataclass(frozen=True)
class Family:
    """A license with its versions; names are (keywords, pattern). site: the words of its text's address before the version."""

    stem: str
    names: tuple[tuple[str, str], ...]
    versions: tuple[str, ...] = ()
    site: str = ""
    later: bool = False  # "or any later version" is a license of its own


_L = "licen[cs]e"

FAMILIES = (
    Family("apache", (("apache", f"apache(?: software)?(?: foundation)? {_L}"), ("apache", "apache"), ("asl", "asl")), ("1.0", "1.1", "2.0"), "apache org licenses license"),
    Family("gpl", (("general public", f"(?:gnu )?general public {_L}"), ("gpl", "(?:gnu )?gpl"), ("gplv", "(?:gnu )?gplv")), ("1.0", "2.0", "3.0"), "gnu org licenses gpl", True),
    Family("lgpl", (("lesser", f"(?:gnu )?lesser general public {_L}"), ("library public", f"(?:gnu )?library general public {_L}"), ("lgpl", "(?:gnu )?lgpl")), ("2.0", "2.1", "3.0"), "gnu org licenses lgpl", True),
    Family("agpl", (("affero", f"(?:gnu )?affero general public {_L}"), ("agpl", "(?:gnu )?agpl")), ("1.0", "3.0"), "gnu org licenses agpl", True),
    Family("gfdl", (("documentation", f"(?:gnu )?free documentation {_L}"), ("gfdl", "(?:gnu )?gfdl")), ("1.1", "1.2", "1.3"), "gnu org licenses fdl", True),
    Family("mpl", (("mozilla", f"mozilla public {_L}"), ("mpl", "mpl")), ("1.0", "1.1", "2.0"), "mozilla org mpl"),
    Family("epl", (("eclipse", f"eclipse public {_L}"), ("epl", "epl")), ("1.0", "2.0"), "eclipse org legal epl"),
    Family("edl", (("eclipse", f"eclipse distribution {_L}"),), ("1.0",), "eclipse org org documents edl"),
    Family("cddl", (("cddl", "cddl"), ("distribution", f"common development and distribution {_L}")), ("1.0", "1.1"), "opensource org licenses cddl"),
    Family("cpl", (("common", f"common public {_L}"),), ("1.0",), "opensource org licenses cpl"),
    Family("eupl", (("eupl", "eupl"), ("european", f"european union public {_L}")), ("1.0", "1.1", "1.2"), "joinup ec europa eu eupl"),
    Family("osl", (("open", f"open software {_L}"),), ("1.0", "2.0", "2.1", "3.0"), "opensource org licenses osl"),
    Family("afl", (("academic", f"academic free {_L}"),), ("1.1", "2.0", "2.1", "3.0"), "opensource org licenses afl"),
    Family("artistic", (("artistic", f"artistic {_L}"),), ("1.0", "2.0"), "opensource org licenses artistic"),
    Family("ms-pl", (("microsoft", f"microsoft public {_L}"),)),
    Family("ms-rl", (("microsoft", f"microsoft reciprocal {_L}"),)),
    Family("bsl", (("boost", f"boost software {_L}"),), ("1.0",), "boost org license"),
    Family("busl", (("business", f"business source {_L}"),), ("1.1",), "mariadb com bsl"),
    Family("sspl", (("server", f"server side public {_L}"), ("sspl", "sspl")), ("1.0",), "mongodb com licensing sspl"),
    Family("elastic", (("elastic", f"elastic {_L}"),), ("1.0", "2.0"), "elastic co licensing elastic license"),
    Family("ofl", (("font", f"(?:sil )?open font {_L}"), ("ofl", "(?:sil )?ofl")), ("1.0", "1.1"), "scripts sil org ofl"),
    Family("psf", (("python", f"python software foundation {_L}"), ("psf", f"psf {_L}")), ("2.0",), "docs python org license"),
    Family("php", (("php", f"php {_L}"),), ("3.0", "3.01"), "php net license"),
    Family("zope", (("zope", f"zope public {_L}"), ("zpl", "zpl")), ("1.1", "2.0", "2.1"), "zope org resources zpl"),
    Family("w3c", (("w3c", f"w3c (?:software )?(?:notice and )?{_L}"),), (), "w3 org consortium legal"),
    Family("lppl", (("latex", f"latex project public {_L}"), ("lppl", "lppl")), ("1.0", "1.2", "1.3"), "latex project org lppl"),
    Family("qpl", (("q", f"q public {_L}"),), ("1.0",)),
    Family("upl", (("universal", f"universal permissive {_L}"),), ("1.0",), "opensource org licenses upl"),
    Family("ncsa", (("ncsa", f"(?:university of illinois )?ncsa open source {_L}"),)),
    Family("mulan", (("mulan", f"mulan (?:permissive software|psl) {_L}"), ("mulan", "mulan psl")), ("1.0", "2.0"), "license coscl org cn mulanpsl"),
    Family("odbl", (("database", f"open database {_L}"), ("odbl", "odbl")), ("1.0",), "opendatacommons org licenses odbl"),
    Family("odc-by", (("commons", f"open data commons attribution {_L}"),), ("1.0",), "opendatacommons org licenses by"),
    Family("pddl", (("domain", f"public domain dedication and {_L}"), ("pddl", "pddl")), ("1.0",), "opendatacommons org licenses pddl"),
    Family("ogl", (("government", f"open government {_L}"),), ("1.0", "2.0", "3.0"), "nationalarchives gov uk open government licence"),
    Family("cecill", (("cecill", f"cecill(?: free software)?(?: {_L})?"),), ("1.0", "2.0", "2.1"), "cecill info licences"),
    Family("mit", (("mit", f"mit(?: x11)? {_L}"), ("expat", f"expat {_L}"), ("x11", f"x11 {_L}")), (), "opensource org licenses mit"),
    Family("isc", (("isc", f"isc {_L}"),), (), "opensource org licenses isc"),
    Family("zlib", (("zlib", f"zlib(?: libpng)? {_L}"),), (), "opensource org licenses zlib"),
    Family("unlicense", (("unlicense", "(?:the )?unlicense"),), (), "unlicense org"),
    Family("wtfpl", (("wtfpl", "wtfpl"),), (), "wtfpl net"),
    Family("bsd-2-clause", (("bsd", f"(?:simplified|freebsd|2 clause|two clause) bsd {_L}"), ("bsd", f"bsd (?:2|two) clause(?: {_L})?")), (), "opensource org licenses bsd 2 clause"),
    Family("bsd-3-clause", (("bsd", f"(?:new|modified|revised|3 clause|three clause) bsd {_L}"), ("bsd", f"bsd (?:3|three) clause(?: {_L})?")), (), "opensource org licenses bsd 3 clause"),
    Family("bsd-4-clause", (("bsd", f"(?:original|old|4 clause|four clause) bsd {_L}"), ("bsd", f"bsd (?:4|four) clause(?: {_L})?")), ()),
    Family("0bsd", (("0bsd", "0bsd"), ("bsd", f"(?:zero clause|0 clause|free public) bsd {_L}")), (), "opensource org licenses 0bsd"),
    Family("bsd", (("bsd", f"bsd(?: style)? {_L}"),)),
)

#: The kinds of Creative Commons licenses: SPDX words -> the long names of their elements.
COMMONS = {
    "by": "attribution",
    "by sa": "attribution share ?alike",
    "by nd": "attribution no ?deriv(?:atives?|s)?",
    "by nc": "attribution non ?commercial",
    "by nc sa": "attribution non ?commercial share ?alike",
    "by nc nd": "attribution non ?commercial no ?deriv(?:atives?|s)?",
}
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Sentences of license texts and hints: priority, label, keywords, pattern.
SENTENCES = (
    (1, "mit", "hereby charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (1, "isc", "granted fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    (1, "bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    (1, "bsd-3-clause", "endorse", "neither the name of (?:the )?(?:[^ ]+ ){1,8}may be used to endorse or promote products"),
    (1, "bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    (1, "zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    (1, "unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    (1, "bsl-1.0", "accompanying", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    (1, "wtfpl", "fuck", "do what the fuck you want to public license"),
    (1, "public-domain", "domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain"),
    (1, "cc0-1.0", "cc0", "(?:under )?(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    (1, "cc0-1.0", "publicdomain", "creativecommons org publicdomain zero 1 0"),
    (2, "cc-pdm-1.0", "publicdomain", "creativecommons org publicdomain mark 1 0"),
    (3, "creative-commons", "creative", f"creative commons(?: {_L})?"),
    (3, "proprietary", "proprietary", "proprietary and confidential"),
    (3, "proprietary", "prohibited", "unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: [^ ]+){0,8} (?:is )?(?:strictly )?prohibited"),
    (3, "proprietary", "reproduced", "no part of this (?:publication|book|work|document) may be reproduced"),
    (4, "copyright-notice", "copyright", "copyright(?: c)?(?: by)? (?:19|20)[0-9][0-9]"),
    (4, "copyright-notice", "copyright", "(?:19|20)[0-9][0-9] copyright"),
    (4, "license-mention", "licensed", "(?:is|are|was|were) licensed under"),
    (4, "see-license", "see", f"see (?:the )?{_L}(?: file)? for (?:details|more information|license information)"),
)

_UNDER = "(?:licensed|released|distributed|available|published|provided|offered|shared|covered|governed|redistribute it|use this file)(?: [^ ]+){0,6} (?:under|by)(?: the)?(?: terms of)?(?: the)? "
_LATER = "(?: only)?(?: or)?(?: at your option)?(?: any)? later(?: version)?"


def version_words(version: str) -> str:
    """1.0 is written 1 or 1 0; 2.1 is written 2 1."""
    major, minor = version.split(".")
    return f"{major} {minor}" if minor != "0" else f"{major}(?: 0)?"


def _versioned(name: str, version: str) -> str:
    words = version_words(version)
    return f"{name}(?: version| v)? {words}" if not name.endswith("v") else f"{name}{words}"


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in their order."""
    out: list[Rule] = list(BASE)
    for f in FAMILIES:
        for words, name in f.names:
            keys = tuple(words.split())
            if name.endswith("v"):  # gplv3: one word with its version
                for v in f.versions:
                    out.append(Rule(2, f"{f.stem}-{v}", (f"gplv{v[0]}",), _versioned(name, v)))
                continue
            mixed = name != keys[0]  # a bare short form is no license without more
            for v in f.versions:
                id_, full = f"{f.stem}-{v}", f"(?:{_versioned(name, v)}|version {version_words(v)} of the {name}|{name} v{v.split('.')[0]}(?: {v.split('.')[1]})?)"
                out.append(Rule(1, id_, (*keys,), _UNDER + full))
                out.append(Rule(2, id_, (*keys,), full))
                if f.later:
                    out.append(Rule(1, f"{id_}-or-later", (*keys, "later"), full + _LATER))
            if mixed:
                out.append(Rule(2 if not f.versions else 3, f.stem, keys, _UNDER + name))
                out.append(Rule(3, f.stem, keys, name))
            if f.versions and f.later:
                for v in f.versions:
                    out.append(Rule(1, f"{f.stem}-{v}-or-later", ("later", *keys), f"{name}(?: as published by the free software foundation)? either version {version_words(v)}(?: of the {_L})?{_LATER}"))
        stem = f.stem.replace("-", " ")
        for v in f.versions or ("",):
            id_ = f"{f.stem}-{v}" if v else f.stem
            out.append(Rule(1, id_, ("spdx",), f"spdx {_L} identifier {stem}" + (f" {v.replace('.', ' ')}" if v else "")))
            if f.site:
                out.append(Rule(2, id_, (f.site.split()[0],), f.site + (f"(?: v)? v?{version_words(v)}" if v else "")))
    for kind, long in COMMONS.items():
        for v in COMMONS_VERSIONS:
            id_, n = f"cc-{kind.replace(' ', '-')}-{v}", v.replace(".", " ")
            out.append(Rule(1, id_, ("cc", "by"), f"{_UNDER}(?:a )?cc {kind} {n}(?: international| unported| generic)?"))
            out.append(Rule(2, id_, ("cc", "by"), f"cc {kind} {n}(?: international| unported| generic)?"))
            out.append(Rule(2, id_, ("attribution",), f"(?:creative commons )?{long} {n}(?: international| unported| generic)?(?: {_L})?"))
            out.append(Rule(2, id_, ("creativecommons",), f"creativecommons org licenses {kind} {n}"))
        out.append(Rule(3, f"cc-{kind.replace(' ', '-')}", ("cc", "by"), f"cc {kind}"))
        out.append(Rule(3, f"cc-{kind.replace(' ', '-')}", ("creative", "attribution"), f"creative commons {long}(?: {_L})?"))
    out += [Rule(tier, label, tuple(keys.split()), pattern) for tier, label, keys, pattern in SENTENCES]
    return tuple(out)


def _let(value: Column, fn) -> Column:
    """fn of the value, which is computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def padded(text: Column) -> Column:
    """The words of a text, each with a space of its own on either side; two spaces where there is none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, _NO_WORD, "  ")), F.lit(" "))


def _places(words: Column, mark: str) -> Column:
    return F.filter(F.transform(words, lambda w, i: F.when(F.contains(w, F.lit(mark)), i)), lambda i: i.isNotNull())


def _found(p: Column, r: Column) -> Column:
    """Detections of one rule: structs in the order of their start, the longer first, then by priority and rule."""
    marked = F.regexp_replace(p, r["regex"], F.lit(f" {_BEGIN}$1{_END} "))
    return _let(
        F.split(marked, "  "),
        lambda ws: F.zip_with(
            _places(ws, _BEGIN), _places(ws, _END),
            lambda s, e: F.struct(s.alias("start"), (-e).alias("minus_last"), r["tier"].alias("tier"), r["rule"].alias("rule"), r["label"].alias("label"), r["base"].alias("base")),
        ),
    )


_CHUNK = 512


def _unsuppressed(found: Column) -> Column:
    """Of sorted detections those that no earlier one of the same or a higher priority contains: those that contain a detection all stand before it."""
    kind = "array<struct<start:int,minus_last:int,tier:int,rule:int,label:string,base:boolean>>"
    none = F.array().cast(kind)
    start = F.struct(*[F.lit(-1).alias(f"m{t}") for t in range(1, TIERS + 1)], none.alias("now"), F.array().cast(f"array<{kind}>").alias("done"))

    def step(s: Column, d: Column) -> Column:
        last = -d["minus_last"]
        covered = F.greatest(*[F.when(d["tier"] >= t, s[f"m{t}"]).otherwise(F.lit(-1)) for t in range(1, TIERS + 1)])
        tops = [F.when(d["tier"] == t, F.greatest(s[f"m{t}"], last)).otherwise(s[f"m{t}"]).alias(f"m{t}") for t in range(1, TIERS + 1)]
        one = F.when(covered >= last, none).otherwise(F.array(d).cast(kind))
        full = F.size(s["now"]) >= _CHUNK  # arrays are copied as they grow: in pieces, so that the work stays linear
        return F.struct(*tops, F.when(full, one).otherwise(F.concat(s["now"], one)).alias("now"), F.when(full, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"))

    return F.aggregate(found, start, step, lambda s: F.flatten(F.concat(s["done"], F.array(s["now"]))))


def scan(docs: DataFrame, text: str = "text", out: str = "licenses", signatures: tuple[Rule, ...] | None = None) -> DataFrame:
    """docs with a struct column: n_words; base: the base phrases' places (start, last, label), all of them; detections: what is
    left after suppression (start, last, priority, rule, label; words from 0, last included), in order; score (0 to 1)."""
    chosen = rules() if signatures is None else signatures
    listed = [{"rule": i, "tier": r.tier, "label": r.label, "base": r.base, "keys": list(r.keywords), "regex": r.regex} for i, r in enumerate(chosen)]
    all_rules = F.from_json(F.lit(json.dumps(listed)), "array<struct<rule:int,tier:int,label:string,base:boolean,keys:array<string>,regex:string>>")
    keywords = F.lit(sorted({k for r in chosen for k in r.keywords})) if chosen else F.array().cast("array<string>")

    def detections(p: Column) -> Column:
        def by_rule(there: Column) -> Column:
            tried = F.filter(all_rules, lambda r: F.forall(r["keys"], lambda k: F.array_contains(there, k)) & F.rlike(p, r["regex"]))
            return F.array_sort(F.flatten(F.transform(tried, lambda r: _found(p, r))))

        return _let(F.array_intersect(keywords, F.split(F.trim(p), "  ")), by_rule)

    def result(p: Column) -> Column:
        spaces = F.octet_length(p) - F.octet_length(F.replace(p, F.lit(" "), F.lit("")))
        n_words = F.when(p == "  ", F.lit(0)).otherwise(spaces / 2).cast("long")

        def told(found: Column) -> Column:
            base = F.transform(F.filter(found, lambda d: d["base"]), lambda d: F.struct(d["start"].alias("start"), (-d["minus_last"]).alias("last"), d["label"].alias("label")))
            left = F.transform(_unsuppressed(found), lambda d: F.struct(d["start"].alias("start"), (-d["minus_last"]).alias("last"), d["tier"].alias("priority"), d["rule"].alias("rule"), d["label"].alias("label")))

            def with_score(kept: Column) -> Column:
                top = F.array_min(F.transform(kept, lambda d: d["priority"]))
                score = F.coalesce(F.element_at(F.lit(list(WEIGHTS)), top), F.lit(0.0))
                return F.struct(n_words.alias("n_words"), base.alias("base"), kept.alias("detections"), score.alias("score"))

            return _let(left, with_score)

        return _let(detections(p), told)

    return docs.withColumn(out, _let(padded(F.col(text)), result))


def labels(column: Column) -> Column:
    """The distinct labels of an array of detections, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(column["label"])), ",")


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = scan(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "t", "found").select("k", "found.*")
    starts = F.col("base")["start"].cast("array<long>")
    every = F.concat(F.col("base")["label"], F.col("detections")["label"])
    return found.select(
        F.col("k").alias(key), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(F.col("base")).alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(every)), ",").alias("labels"), "score",
    )


def oracle(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """DuckDB SQL for digest(), by another way: places from what stands between matches, containment by windows."""
    quoted = ", ".join(f"({i}, {r.tier}, '{r.label}', {str(r.base).lower()}, [{', '.join(repr(k) for k in r.keywords)}], '{r.regex}')" for i, r in enumerate(rules()))
    weights = " ".join(f"WHEN {i + 1} THEN {w}" for i, w in enumerate(WEIGHTS))
    earlier = " OR ".join(f"(tier >= {t} AND coalesce(max(CASE WHEN tier = {t} THEN last END) OVER w, -1) >= last)" for t in range(1, TIERS + 1))
    return rf"""
WITH rules(rule, tier, label, base, keys, regex) AS (VALUES {quoted}
), p AS (
  SELECT row_number() OVER () AS n, {key} AS k, ' ' || trim(regexp_replace(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{_NO_WORD}', '  ', 'g'), ' ') || ' ' AS t FROM {table}
), tried AS (
  SELECT n, t, r.* FROM p JOIN rules r ON contains(t, ' ' || r.keys[1] || ' ') AND len(list_filter(r.keys, lambda x: NOT contains(t, ' ' || x || ' '))) = 0
), cut AS (
  SELECT n, rule, tier, label, base, regexp_extract_all(t, regex) AS found, regexp_split_to_array(t, regex) AS pieces FROM tried
), spans AS (
  SELECT n, rule, tier, label, base, found, pieces, unnest(range(1, len(found) + 1)) AS i FROM cut WHERE len(found) > 0
), places AS (
  SELECT n, rule, tier, label, base, len(string_split(found[i], ' ')) - 1 AS own,
         list_sum(list_transform(pieces[1:i], lambda x: len(string_split(x, ' ')) - 1)) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: len(string_split(x, ' ')) - 1)), 0) AS before
  FROM spans
), d AS (
  SELECT n, rule, tier, label, base, before // 2 AS start, before // 2 + own // 2 - 1 AS last FROM places
), j AS (
  SELECT *, {earlier} AS gone FROM d
  WINDOW w AS (PARTITION BY n ORDER BY start, last DESC, tier, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), by_doc AS (
  SELECT n, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base OR NOT gone) AS labels, min(tier) FILTER (WHERE NOT gone) AS top
  FROM j GROUP BY n
)
SELECT k AS {key}, CASE WHEN t = '  ' THEN 0 ELSE (len(string_split(t, ' ')) - 1) // 2 END AS n_words, coalesce(n_base, 0) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CAST(CASE top {weights} ELSE 0 END AS DOUBLE) AS score
FROM p LEFT JOIN by_doc USING (n)
"""
