"""License scans by ordered signature rules, in DataFrame operations only.

A text's words, in lower case and with single spaces, are matched by some three hundred regular
expressions. A rule is tried only where its keyword occurs, and no rule where none of the
trigger words does. Each rule has a priority (1 is the surest: whole notices, then names with a
version, then identifiers, then bare names); a detection inside another one that is at
least as sure is suppressed, and of equal detections the surer one stays.

Defined cases: null and empty texts have no words and no detections; null and repeated ids and
repeated rows give one row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.columns import let, lowered, raw_words


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    pattern: str


#: The plain phrases that always count, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Families with versions: label, names, short names, web place, versions.
FAMILIES = (
    ("gpl", ("gnu general public licen[sc]e", "gnu gpl"), ("gpl", "gplv"), "gnu org licenses gpl", ("1.0", "2.0", "3.0")),
    ("lgpl", ("gnu lesser general public licen[sc]e", "gnu library general public licen[sc]e", "gnu lgpl"), ("lgpl", "lgplv"), "gnu org licenses lgpl", ("2.0", "2.1", "3.0")),
    ("agpl", ("gnu affero general public licen[sc]e", "affero general public licen[sc]e"), ("agpl", "agplv"), "gnu org licenses agpl", ("1.0", "3.0")),
    ("gfdl", ("gnu free documentation licen[sc]e",), ("gfdl",), "gnu org licenses fdl", ("1.1", "1.2", "1.3")),
    ("apache", ("apache licen[sc]e", "apache software licen[sc]e"), ("apache",), "apache org licenses license", ("1.0", "1.1", "2.0")),
    ("mpl", ("mozilla public licen[sc]e",), ("mpl",), "mozilla org mpl", ("1.0", "1.1", "2.0")),
    ("epl", ("eclipse public licen[sc]e",), ("epl",), "eclipse org legal epl", ("1.0", "2.0")),
    ("cddl", ("common development and distribution licen[sc]e",), ("cddl",), "opensource org licenses cddl", ("1.0", "1.1")),
    ("cpl", ("common public licen[sc]e",), ("cpl",), "opensource org licenses cpl", ("1.0",)),
    ("eupl", ("european union public licen[sc]e",), ("eupl",), "joinup ec europa eu licence eupl", ("1.0", "1.1", "1.2")),
    ("osl", ("open software licen[sc]e",), ("osl",), "opensource org licenses osl", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", ("academic free licen[sc]e",), ("afl",), "opensource org licenses afl", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("artistic", ("artistic licen[sc]e",), ("artistic",), "opensource org licenses artistic license", ("1.0", "2.0")),
    ("lppl", ("latex project public licen[sc]e",), ("lppl",), "latex project org lppl", ("1.0", "1.1", "1.2", "1.3")),
    ("boost", ("boost software licen[sc]e",), ("bsl",), "boost org license", ("1.0",)),
    ("php", ("php licen[sc]e",), ("php",), "php net license", ("3.0", "3.01")),
    ("zpl", ("zope public licen[sc]e",), ("zpl",), "zope org resources zpl", ("1.1", "2.0", "2.1")),
    ("odbl", ("open database licen[sc]e",), ("odbl",), "opendatacommons org licenses odbl", ("1.0",)),
    ("ofl", ("sil open font licen[sc]e", "open font licen[sc]e"), ("ofl",), "scripts sil org ofl", ("1.0", "1.1")),
    ("cecill", ("cecill free software licen[sc]e",), ("cecill",), "cecill info licences", ("1.0", "1.1", "2.0", "2.1")),
)
#: The parts and versions of the attribution family.
CC_PARTS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative|ativework|ativework|)s?"}
CC_TYPES = (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd"))
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Licenses without versions, and the openings of their notices.
SINGLES = (
    ("mit", 2, "mit", "(?:the )?(?:mit|expat) licen[sc]e(?: mit)?"),
    ("mit", 3, "spdx", "spdx license identifier mit"),
    ("mit", 1, "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?"),
    ("mit", 2, "released under the mit", "released under the mit licen[sc]e"),
    ("bsd", 1, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2-clause", 2, "bsd", "(?:2|two) clause bsd licen[sc]e"),
    ("bsd-3-clause", 2, "bsd", "(?:3|three) clause bsd licen[sc]e"),
    ("bsd-4-clause", 2, "bsd", "(?:4|four) clause bsd licen[sc]e"),
    ("bsd-2-clause", 3, "bsd", "bsd 2 clause"),
    ("bsd-3-clause", 3, "bsd", "bsd 3 clause"),
    ("bsd-4-clause", 3, "bsd", "bsd 4 clause"),
    ("bsd", 4, "bsd", "bsd(?: style)? licen[sc]e"),
    ("isc", 2, "isc", "isc licen[sc]e"),
    ("isc", 1, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", 2, "zlib", "zlib(?: libpng)? licen[sc]e"),
    ("unlicense", 2, "unlicense", "(?:the )?unlicense"),
    ("unlicense", 1, "public domain", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", 2, "wtfpl", "wtfpl"),
    ("cc0", 2, "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0", 2, "creative commons", "creative commons zero(?: v?1 0)?"),
    ("public-domain", 2, "public domain", "(?:released into|dedicated to|placed in) the public domain"),
    ("public-domain", 4, "public domain", "public domain"),
    ("proprietary", 3, "rights reserved", "all rights reserved"),
    ("python", 2, "python software foundation", "python software foundation licen[sc]e(?: version 2)?"),
    ("ruby", 2, "ruby", "ruby licen[sc]e"),
    ("ncsa", 2, "ncsa", "(?:university of illinois )?ncsa open source licen[sc]e"),
    ("postgresql", 2, "postgresql", "postgresql licen[sc]e"),
    ("openssl", 2, "openssl", "openssl licen[sc]e"),
    ("beerware", 2, "beer", "beer ?ware licen[sc]e"),
    ("license-reference", 4, "licen", "licen[sc]ed under"),
)
#: Words that start or mark what the rules look for; short names, with and without a version number, and web places are added below.
WORDS = (
    "license", "licence", "licenses", "licences", "licensed", "licenced", "unlicense", "gnu", "artistic", "boost", "cc", "cc0", "creative", "creativecommons",
    "attribution", "bsd", "wtfpl", "apache", "spdx", "permission", "redistribution", "domain", "reserved",
)
#: How sure a detection of each priority is.
SURE = {1: 1.0, 2: 0.9, 3: 0.8, 4: 0.5}


def _spoken(version: str) -> str:
    """A version as words: a last 0 may be missing."""
    major, minor = version.split(".")
    return f"{major}(?: {minor})?" if minor == "0" else f"{major} {minor}"


def rules() -> list[Rule]:
    """All rules in order: by family, version and form."""
    out = []
    for label, names, shorts, place, versions in FAMILIES:
        for version in versions:
            spoken, full = _spoken(version), f"{label}-{version}"
            for name in names:
                # the longest plain run of words before a pattern sign gates the rule
                key = name.split(" licen")[0].split("[")[0]
                out.append(Rule(full, 2, key, f"{name}(?: version| v)? v?{spoken}(?: or| only)?"))
                out.append(Rule(f"{full}-or-later", 1, key, f"{name}(?: version| v)? v?{spoken} or (?:at your option )?(?:any )?later(?: version)?"))
            for short in shorts:
                glue = "" if short.endswith("v") else " ?v?"
                out.append(Rule(full, 3, short, f"{short}{glue}{spoken}(?: only)?"))
                out.append(Rule(f"{full}-or-later", 2, short, f"{short}{glue}{spoken} or later"))
            out.append(Rule(full, 3, place, f"{place}[a-z]? v?{spoken}"))
        for name in names:
            out.append(Rule(label, 4, name.split(" licen")[0], name))
    for kind in CC_TYPES:
        short, long = " ".join(kind), " ".join(CC_PARTS[k] for k in kind)
        for version in CC_VERSIONS:
            spoken, full = _spoken(version), f"cc-{'-'.join(kind)}-{version}"
            tail = "(?: (?:international|unported|generic))?"
            out.append(Rule(full, 3, f" cc {kind[0]}", f"cc {short} {spoken}{tail}"))
            out.append(Rule(full, 2, "attribution", f"(?:creative commons )?{long} {spoken}{tail}(?: licen[sc]e)?"))
            out.append(Rule(full, 3, "creativecommons org", f"creativecommons org licenses {short} {spoken}"))
        out.append(Rule(f"cc-{'-'.join(kind)}", 4, f" cc {kind[0]}", f"cc {short}"))
        out.append(Rule(f"cc-{'-'.join(kind)}", 4, "creative commons", f"creative commons {long}"))
    out += [Rule(*single) for single in SINGLES]
    return out


def triggers() -> list[str]:
    """A text without any of these words meets no rule."""
    out = set(WORDS)
    for _, _, shorts, place, versions in FAMILIES:
        out.add(place.split()[0])
        for short in shorts:
            out.add(short)
            for major in {v.split(".")[0] for v in versions}:
                out |= {f"{short}{major}", f"{short}v{major}"}
    return sorted(out)


def _table(entries: list[Rule]) -> Column:
    """The rules as one constant array."""
    return F.array(
        *[
            F.struct(
                F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.keyword).alias("keyword"),
                F.lit(f"(?<= )(?:{r.pattern})(?= )").alias("pattern"),
            )
            for r in entries
        ]
    )


def _spaces(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def _spans(norm: Column, table: Column) -> Column:
    """All places of the rules of ``table`` whose keyword occurs: start, -end, priority, label; words from 0, end exclusive."""

    def places(rule: Column) -> Column:
        pieces, found = F.split(norm, rule["pattern"], F.lit(-1)), F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
        # The text begins with a space and each word ends with one, so spaces count words.
        zipped = F.transform(found, lambda m, i: F.struct(m.alias("m"), i.alias("i")))

        def step(acc: Column, x: Column, parts: Column) -> Column:
            start = acc["at"] + _spaces(F.get(parts, x["i"]))
            end = start + _spaces(x["m"])
            place = F.struct((start - 1).alias("start"), (-end).alias("to"), rule["priority"].alias("priority"), rule["label"].alias("label"))
            return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(place)).alias("spans"))

        none = F.array().cast("array<struct<start:int,to:int,priority:int,label:string>>")
        return let(
            pieces,
            lambda parts: F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("spans")), lambda acc, x: step(acc, x, parts), lambda acc: acc["spans"]),
        )

    return F.array_sort(F.flatten(F.transform(F.filter(table, lambda r: F.contains(norm, r["keyword"])), places)))


def _suppressed(spans: Column) -> Column:
    """Sorted spans without those inside one that is as sure or surer: any container comes earlier in the order."""
    none = F.array().cast("array<struct<start:int,to:int,priority:int,label:string>>")
    levels = sorted(SURE)
    begin = F.struct(none.alias("kept"), *[F.lit(-1).alias(f"p{p}") for p in levels])

    def step(acc: Column, x: Column) -> Column:
        reach = F.greatest(*[F.when(x["priority"] >= p, acc[f"p{p}"]).otherwise(F.lit(-1)) for p in levels])
        end = -x["to"]
        return F.struct(
            F.when(reach >= end, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x))).alias("kept"),
            *[F.when(x["priority"] == p, F.greatest(acc[f"p{p}"], end)).otherwise(acc[f"p{p}"]).alias(f"p{p}") for p in levels],
        )

    return F.aggregate(spans, begin, step, lambda acc: acc["kept"])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", entries: list[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, base, found) of every document.

    ``base`` has all places of the plain phrases, ``found`` the detections that no other suppresses;
    both are arrays of start, to (minus the end), priority and label, by start.
    """
    table = _table(rules() if entries is None else entries)
    base = _table([Rule(label, 4, phrase, phrase) for phrase, label in PHRASES])
    marks = F.array(*map(F.lit, triggers()))

    def scan(words: Column) -> Column:
        def detect(norm: Column) -> Column:
            return F.struct(_spans(norm, base).alias("base"), let(_spans(norm, table), _suppressed).alias("found"))

        norm = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        return F.struct(F.size(words).cast("long").alias("n_words"), F.when(F.arrays_overlap(words, marks), let(norm, detect)).alias("seen"))

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), let(F.transform(raw_words(F.col(f"`{text_col}`")), lowered), scan).alias("scan"))
    none = F.array().cast("array<struct<start:int,to:int,priority:int,label:string>>")
    return rows.select(
        "doc_id", "scan.n_words", F.coalesce("scan.seen.base", none).alias("base"), F.coalesce("scan.seen.found", none).alias("found")
    )


def sureness(found: Column) -> Column:
    """The surest detection's certainty; 0 without any."""
    levels = F.transform(found, lambda x: F.element_at(F.create_map(*[F.lit(v) for pair in SURE.items() for v in pair]), x["priority"]))
    return F.coalesce(F.array_max(levels), F.lit(0.0))
