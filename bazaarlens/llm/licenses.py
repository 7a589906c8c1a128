"""License scans by ordered signature rules.

A text is read as words between single spaces. Each rule is a regular expression over such words with a keyword that any
match must hold; only texts that hold the keyword are searched. Rules have a priority, and a detection that lies within one
of the same or a higher priority is suppressed, so that "gpl" goes where "gnu lesser general public license version 2 1"
stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bazaarlens.llm.arrays import LOWER, PLAIN, Words, slices, text_buffers
from bazaarlens.llm.naming import names_apart

#: How sure a detection of each priority is: 1 a hint, 2 a name, 3 a name with its version or a notice, 4 a tag or a link.
CERTAINTY = {1: 0.4, 2: 0.8, 3: 0.95, 4: 0.99}


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    pattern: re.Pattern
    priority: int
    base: bool = False


def rule(label: str, keyword: str, pattern: str, priority: int, base: bool = False) -> Rule:
    """``pattern`` and ``keyword`` in words: a match starts and ends at word borders; a keyword may end inside a word."""
    return Rule(label, b" " + keyword.encode(), re.compile(rf" (?:{pattern})(?= )".encode()), priority, base)


_LICENSE = "(?:public )?licen[cs]e"
#: Label, keyword of the name, name, short name, versions ("" for none).
FAMILIES = [
    ("gpl", "general public", "(?:gnu )?general public licen[cs]e", "(?:gnu )?gpl", "1.0 2.0 3.0"),
    ("lgpl", "general public", "(?:gnu )?(?:lesser|library) general public licen[cs]e", "(?:gnu )?lgpl", "2.0 2.1 3.0"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e", "(?:gnu )?agpl", "1.0 3.0"),
    ("gfdl", "free documentation", "(?:gnu )?free documentation licen[cs]e", "(?:gnu )?gfdl", "1.1 1.2 1.3"),
    ("apache", "apache", "apache(?: software)? licen[cs]e", "apache", "1.0 1.1 2.0"),
    ("mpl", "mozilla", f"mozilla {_LICENSE}", "mpl", "1.0 1.1 2.0"),
    ("epl", "eclipse", f"eclipse {_LICENSE}", "epl", "1.0 2.0"),
    ("edl", "eclipse", "eclipse distribution licen[cs]e", "edl", "1.0"),
    ("cpl", "common", f"common {_LICENSE}", "cpl", "0.5 1.0"),
    ("ipl", "ibm", f"ibm {_LICENSE}", "ipl", "1.0"),
    ("cddl", "common development", "common development and distribution licen[cs]e", "cddl", "1.0 1.1"),
    ("eupl", "european union", f"european union {_LICENSE}", "eupl", "1.0 1.1 1.2"),
    ("afl", "academic free", "academic free licen[cs]e", "afl", "1.1 1.2 2.0 2.1 3.0"),
    ("osl", "open software", "open software licen[cs]e", "osl", "1.0 1.1 2.0 2.1 3.0"),
    ("artistic", "artistic", "(?:perl )?artistic licen[cs]e", "artistic", "1.0 2.0"),
    ("lppl", "latex project", f"latex project {_LICENSE}", "lppl", "1.0 1.1 1.2 1.3"),
    ("ofl", "open font", "(?:sil )?open font licen[cs]e", "(?:sil )?ofl", "1.0 1.1"),
    ("psf", "python", "python(?: software foundation)? licen[cs]e", "psf", "2.0"),
    ("php", "php", "php licen[cs]e", "php", "3.0 3.01"),
    ("zpl", "zope", f"zope {_LICENSE}", "zpl", "1.1 2.0 2.1"),
    ("bsl", "boost", "boost software licen[cs]e", "bsl", "1.0"),
    ("busl", "business source", "business source licen[cs]e", "busl", "1.1"),
    ("sspl", "server side", f"server side {_LICENSE}", "sspl", "1.0"),
    ("apsl", "apple public", "apple public source licen[cs]e", "apsl", "1.0 1.1 1.2 2.0"),
    ("rpl", "reciprocal", f"reciprocal {_LICENSE}", "rpl", "1.1 1.5"),
    ("cecill", "cecill", "cecill(?: free software)? licen[cs]e", "cecill", "1.0 1.1 2.0 2.1"),
    ("qpl", "q ", f"q {_LICENSE}", "qpl", "1.0"),
    ("npl", "netscape", f"netscape {_LICENSE}", "npl", "1.0 1.1"),
    ("sissl", "sun industry", "sun industry standards source licen[cs]e", "sissl", "1.1 1.2"),
    ("spl", "sun ", f"sun {_LICENSE}", "spl", "1.0"),
    ("ecl", "educational community", "educational community licen[cs]e", "ecl", "1.0 2.0"),
    ("efl", "eiffel", "eiffel forum licen[cs]e", "efl", "1.0 2.0"),
    ("w3c", "w3c", "w3c(?: software)?(?: notice and)? licen[cs]e", "", ""),
    ("ms-pl", "microsoft", f"microsoft {_LICENSE}", "ms pl", ""),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e", "ms rl", ""),
    ("upl", "universal permissive", "universal permissive licen[cs]e", "upl", "1.0"),
    ("odbl", "open database", "open database licen[cs]e", "odbl", "1.0"),
    ("odc-by", "open data", "open data commons attribution licen[cs]e", "odc by", "1.0"),
    ("pddl", "public domain", "public domain dedication and licen[cs]e", "pddl", "1.0"),
    ("mulanpsl", "mulan", "mulan permissive software licen[cs]e", "mulanpsl", "1.0 2.0"),
    ("wtfpl", "do what", "do what the fuck you want to public licen[cs]e", "wtfpl", "1.0 2.0"),
    ("vsl", "vovida", "vovida software licen[cs]e", "vsl", "1.0"),
    ("bittorrent", "bittorrent", "bittorrent open source licen[cs]e", "", "1.0 1.1"),
    ("openldap", "openldap", f"openldap {_LICENSE}", "", "1.2 2.0 2.8"),
    ("openssl", "openssl", "openssl licen[cs]e", "", ""),
    ("mit", "licen", "(?:mit|expat)(?: x11)? licen[cs]e", "", ""),
    ("isc", "isc", "isc licen[cs]e", "", ""),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", "", ""),
    ("ncsa", "university of illinois", "university of illinois ncsa(?: open source)? licen[cs]e", "", ""),
    ("postgresql", "postgresql", "postgresql licen[cs]e", "", ""),
    ("unlicense", "unlicense", "the unlicense", "", ""),
    ("beerware", "beer", "beer ?ware licen[cs]e", "", ""),
    ("json", "json", "json licen[cs]e", "", ""),
    ("ruby", "ruby", "ruby licen[cs]e", "", ""),
    ("vim", "vim", "vim licen[cs]e", "", ""),
    ("curl", "curl", "curl licen[cs]e", "", ""),
    ("bsd-0-clause", "bsd", "(?:bsd (?:0|zero)|(?:0|zero) clause bsd)(?: clause)?(?: licen[cs]e)?", "", ""),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd (?:2|two) clause|(?:2|two) clause bsd)(?: licen[cs]e)?", "", ""),
    ("bsd-3-clause", "bsd", "(?:(?:new|modified|revised) bsd|bsd (?:3|three) clause|(?:3|three) clause bsd)(?: licen[cs]e)?", "", ""),
    ("bsd-4-clause", "bsd", "(?:(?:original|old) bsd|bsd (?:4|four) clause|(?:4|four) clause bsd)(?: licen[cs]e)?", "", ""),
    ("bsd", "licen", "(?:berkeley software distribution|bsd)(?: style)? licen[cs]e", "", ""),
]

_LATER = " (?:or (?:at your option |any )*(?:any )?(?:later|newer|greater)(?: versions?)?|and (?:later|newer)(?: versions?)?)"
_COMMONS = {
    "by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative)?s?(?: works)?",
    "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike",
    "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?",
}

#: Phrases that every scan reports, with the places of their words.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

#: Label, keyword, pattern, priority of notices and hints.
NOTICES = [
    ("mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software", 3),
    ("mit-0", "mit no", "mit no attribution(?: licen[cs]e)?", 2),
    ("isc", "permission to use", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee", 3),
    ("bsd", "redistribution and", "redistribution and use in source and binary forms with or without modification are permitted", 2),
    ("bsd-3-clause", "neither the", "neither the names? of (?:[^ ]+ ){1,12}may be used to endorse or promote products", 3),
    ("bsd-4-clause", "all advertising", "all advertising materials mentioning features or use of this software must display", 3),
    ("zlib", "this software is provided", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 3),
    ("gpl", "this program is free", "this program is free software you can redistribute it and or modify it", 2),
    ("lgpl", "this library is free", "this library is free software you can redistribute it and or modify it", 2),
    ("unlicense", "this is free and", "this is free and unencumbered software released into the public domain", 3),
    ("wtfpl", "everyone is permitted", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", 3),
    ("beerware", "if we meet", "if we meet some day and you think this stuff is worth it you can buy me a beer", 3),
    ("bsl-1.0", "permission is hereby", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", 3),
    ("proprietary", "proprietary and", "proprietary and confidential", 2),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|material)", 2),
    ("proprietary", "may not be", "may not be (?:copied|reproduced|redistributed)(?: or (?:copied|reproduced|redistributed))* without (?:prior |express )*(?:written )?permission", 2),
    ("public-domain", "public domain", "(?:in|into|to) the public domain", 2),
    ("public-domain", "public domain", "public domain", 1),
    ("copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9][0-9]", 1),
    ("copyright", "copyright", "copyright by", 1),
    ("license-mention", "under", "(?:licen[cs]ed|released|distributed|available|published) under(?: the)?(?: terms of)?", 1),
    ("license-mention", "see the", "see the license for", 1),
    ("license-mention", "subject to the", "subject to the terms (?:and conditions )?of", 1),
    ("copyleft", "copyleft", "copyleft", 1),
    ("no-license", "no license", "no license is granted", 2),
    ("free-for-personal-use", "free for", "free for (?:personal|private|non ?commercial) use", 2),
    ("crown", "crown copyright", "crown copyright", 2),
    ("ogl", "open government", "open government licen[cs]e(?: v(?:ersion)? ?[0-9](?: [0-9])?)?", 2),
    ("kopimi", "kopimi", "kopimi", 2),
]


def _version(version: str) -> str:
    whole, part = version.split(".")
    return rf"v?{whole}" + (r"(?: 0)?" if part == "0" else rf" {part}")


def _of_family(label: str, keyword: str, name: str, short: str, versions: str) -> Iterator[Rule]:
    tag, own = label.replace("-", " "), short.rsplit(")?", 1)[-1]
    yield rule(label, keyword, name, 2)
    yield rule(label, keyword, f"(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of the )?{name}", 2)
    yield rule(label, "spdx", f"spdx licen[cs]e identifier {tag}", 4)
    if short:
        yield rule(label, own, rf"{short} licen[cs]ed?", 2)
    for version in versions.split():
        number, versioned = _version(version), f"{label}-{version}"
        after = rf"(?: as published by the [a-z]+ [a-z]+ [a-z]+)?(?: (?:either )?version| ver| v| release)? {number}"
        yield rule(versioned, keyword, name + after, 3)
        yield rule(versioned, "spdx", rf"spdx licen[cs]e identifier {tag} {number}(?: only)?", 4)
        if short:
            yield rule(versioned, own, rf"{short}(?: licen[cs]e)?(?: version| v)? ?{number}", 3)
        if label in ("gpl", "lgpl", "agpl", "gfdl"):
            yield rule(f"{versioned}-or-later", keyword, name + after + _LATER, 3)
            yield rule(f"{versioned}-or-later", "spdx", rf"spdx licen[cs]e identifier {tag} {number} or later", 4)
            yield rule(f"{versioned}-or-later", own, rf"{short}(?: version| v)? ?{number}{_LATER}", 3)
            yield rule(versioned, "www gnu", rf"www gnu org licen[cs]es (?:old licen[cs]es )?{tag} {number}", 4)
    if label in ("apache", "mpl", "epl"):
        host = {"apache": "apache org", "mpl": "mozilla org", "epl": "eclipse org"}[label]
        for version in versions.split():
            yield rule(f"{label}-{version}", keyword, rf"{host} (?:licen[cs]es|legal|mpl) (?:licen[cs]e |{tag} )?{_version(version)}", 4)


def _of_commons() -> Iterator[Rule]:
    for kind, name in _COMMONS.items():
        short = kind.replace("-", " ")
        yield rule(f"cc-{kind}", "cc by", f"cc {short}", 2)
        yield rule(f"cc-{kind}", "creative commons", f"creative commons {name}(?: licen[cs]e)?", 2)
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            number, label = _version(version), f"cc-{kind}-{version}"
            yield rule(label, "cc by", rf"cc {short}(?: licen[cs]e)?(?: version)? {number}", 3)
            yield rule(label, "creative commons", rf"creative commons {name} {number}(?: (?:international|unported|generic))?(?: licen[cs]e)?", 3)
            yield rule(label, "creativecommons", rf"creativecommons org licen[cs]es {short} {number}", 4)
            yield rule(label, "spdx", rf"spdx licen[cs]e identifier cc {short} {number}", 4)
    yield rule("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", 3)
    yield rule("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0", 4)
    yield rule("cc", "creative commons", "creative commons(?: licen[cs]e)?", 1)


def all_rules() -> list[Rule]:
    """All rules; where two match the same words with the same priority, the first stands."""
    found = [r for family in FAMILIES for r in _of_family(*family)] + list(_of_commons())
    found += [rule(*notice) for notice in NOTICES]
    return found + [rule(label, words, words, 1, base=True) for label, words in BASE]


def _inside(start: np.ndarray, end: np.ndarray, outer_start: np.ndarray, outer_end: np.ndarray) -> np.ndarray:
    """Which intervals lie within one of some others."""
    order = np.argsort(outer_start, kind="stable")
    reach = np.maximum.accumulate(np.r_[-1, outer_end[order]])
    return reach[np.searchsorted(outer_start[order], start, "right")] >= end


def resolve(start: np.ndarray, end: np.ndarray, priority: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which detections stand: by falling priority, those not within a standing one; among equals the longer one stands, of
    the same interval that of the first rule (``order``)."""
    kept = np.zeros(len(start), bool)
    for level in np.unique(priority)[::-1]:
        at = np.flatnonzero(priority == level)
        at = at[~_inside(start[at], end[at], start[kept], end[kept])]
        at = at[np.lexsort((order[at], -end[at], start[at]))]
        reach = np.maximum.accumulate(np.r_[-1, end[at]])[:-1]
        kept[at[end[at] > reach]] = True
    return kept


class Scanner:
    """Rules by keyword, made once a task."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.gated: dict[bytes, list[int]] = {}
        for i, r in enumerate(rules):
            self.gated.setdefault(r.keyword, []).append(i)

    def detections(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Rule numbers and byte ranges of all matches, in a text of words with one space before and after each."""
        found = [
            (i, *match.span())
            for keyword, rules in self.gated.items()
            if keyword in text
            for i in rules
            for match in self.rules[i].pattern.finditer(text)
        ]
        table = np.array(found, np.int64).reshape(-1, 3)
        return table[:, 0], table[:, 1:]


def _spaced(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' lower-cased words, each text with one space before and after each word; where texts and words begin."""
    lengths = words.ends - words.starts
    before = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=before[1:])
    at = before[:-1] + np.arange(len(lengths)) + words.doc + 1
    edges = before[words.first] + words.first + np.arange(len(words.first))
    body = np.full(edges[-1], 0x20, np.uint8)
    body[np.repeat(at - before[:-1], lengths) + np.arange(before[-1])] = LOWER[data[words.inside]]
    return body, edges, at


_FOUND = T.ArrayType(T.StructType([T.StructField(c, t) for c, t in (("label", T.StringType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("priority", T.IntegerType()))]))
_ADDED = T.StructType(
    [T.StructField(c, t) for c, t in (
        ("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()),
        ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()), ("detections", _FOUND))]
)
_NOTHING = (0, None, None, "", "", 0.0, [])


def _judge(scanner: Scanner, text: bytes, words: np.ndarray) -> tuple:
    rule, span = scanner.detections(text)
    if not len(rule):
        return _NOTHING
    rules = [scanner.rules[i] for i in rule.tolist()]
    priority = np.array([r.priority for r in rules])
    first = np.searchsorted(words, span[:, 0] + 1)
    last = np.searchsorted(words, span[:, 1]) - 1
    base = np.array([r.base for r in rules])
    stands = np.flatnonzero(resolve(span[:, 0], span[:, 1], priority, rule))
    stands = stands[np.lexsort((rule[stands], first[stands]))]
    base_labels = {rules[i].label for i in np.flatnonzero(base)}
    labels = base_labels | {rules[i].label for i in stands}
    detections = [
        {"label": rules[i].label, "first_word": int(first[i]), "last_word": int(last[i]), "priority": rules[i].priority} for i in stands
    ]
    n_base = int(base.sum())
    ends = (int(first[base].min()), int(first[base].max())) if n_base else (None, None)
    return n_base, *ends, ",".join(sorted(base_labels)), ",".join(sorted(labels)), CERTAINTY[int(priority.max())], detections


@names_apart
def license_scan(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """n_words; n_base, first_word, last_word, base_labels (places of the base phrases, the smallest and largest start, and
    their labels); labels (those and the ones of standing detections); score (how sure the strongest detection is, 0 without
    any) and the standing detections by place, beside the other columns of ``docs``.

    ``docs`` may have any columns; those with the name of a result are replaced. A null or empty text has no words, no
    places and the score 0. Repeated rows are each scanned. Detections of one interval and priority: the first rule's
    stands. Texts are read whole, a long one as a slice of its own.
    """
    keep = [c for c in docs.columns if c not in (text_col, *_ADDED.names)]
    schema = T.StructType([T.StructField("row", T.StructType([docs.schema[c] for c in keep])), *_ADDED.fields])
    target = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(all_rules() if rules is None else rules)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            rows = []
            for a, b in slices(offsets):
                part = data[offsets[a] : offsets[b]]
                words = Words(part, offsets[a : b + 1] - offsets[a], PLAIN)
                body, edges, at = _spaced(part, words)
                for i, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                    own = at[words.first[i] : words.first[i + 1]] - x
                    rows.append((int(words.counts[i]), *_judge(scanner, body[x:y].tobytes(), own)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(_ADDED)
            new = [pa.array(x, f.type) for f, x in zip(list(target)[1:], columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], schema=target)

    rows = docs.select(F.struct(*keep).alias("row"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, schema).select("row.*", *_ADDED.names)
