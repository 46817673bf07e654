"""Operator 5: license scans by ordered signature rules."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

#: Phrases whose every place is reported, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Licenses: label, the words their name is recognised by (a regex over words), the keywords of which every match holds one.
LICENSES = (
    ("apache-2.0", r"apache (?:software )?license(?: version)?(?: v)? ?2(?: 0)?", "apache"),
    ("apache-1.1", r"apache (?:software )?license(?: version)? 1 1", "apache"),
    ("apache", r"apache (?:software )?license", "apache"),
    ("mit", r"(?:mit|expat) license", "mit license|expat license"),
    ("bsd-2-clause", r"(?:simplified|2 clause|two clause) bsd license|bsd 2 clause(?: license)?", "bsd"),
    ("bsd-3-clause", r"(?:new|revised|modified|3 clause|three clause) bsd license|bsd 3 clause(?: license)?", "bsd"),
    ("bsd-4-clause", r"(?:original|4 clause|four clause) bsd license|bsd 4 clause(?: license)?", "bsd"),
    ("bsd", r"bsd(?: style)? license", "bsd"),
    ("isc", r"isc license", "isc"),
    ("agpl-3.0", r"(?:gnu )?affero general public license(?: version)?(?: v)? ?3(?: 0)?", "affero"),
    ("agpl", r"(?:gnu )?affero general public license", "affero"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser|library) general public license(?: version)?(?: v)? 2 1", "general public"),
    ("lgpl-3.0", r"(?:gnu )?lesser general public license(?: version)?(?: v)? ?3(?: 0)?", "general public"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public license", "general public"),
    ("gpl-2.0", r"(?:gnu )?general public license(?: version)?(?: v)? ?2(?: 0)?", "general public"),
    ("gpl-3.0", r"(?:gnu )?general public license(?: version)?(?: v)? ?3(?: 0)?", "general public"),
    ("gfdl", r"(?:gnu )?free documentation license(?: version)?(?: 1 [123])?", "documentation license"),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)(?: [1234] [05])?", "cc by|creative commons"),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1234] [05])?", "cc by|creative commons"),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)(?: [1234] [05])?", "cc by|creative commons"),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)(?: [1234] [05])?", "cc by|creative commons"),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)(?: [1234] [05])?", "cc by|creative commons"),
    ("cc-by", r"(?:cc by|creative commons attribution)(?: [1234] [05])?", "cc by|creative commons"),
    ("cc0", r"cc0(?: 1 0)?|creative commons zero", "cc0|creative commons"),
    ("mpl-2.0", r"mozilla public license(?: version)?(?: v)? ?2(?: 0)?", "mozilla"),
    ("mpl-1.1", r"mozilla public license(?: version)? 1 1", "mozilla"),
    ("mpl", r"mozilla public license", "mozilla"),
    ("epl-2.0", r"eclipse public license(?: version)?(?: v)? ?2(?: 0)?", "eclipse"),
    ("epl-1.0", r"eclipse public license(?: version)?(?: v)? ?1(?: 0)?", "eclipse"),
    ("cddl", r"common development and distribution license(?: 1 [01])?", "common development"),
    ("cpl-1.0", r"common public license(?: version)?(?: 1 0)?", "common public"),
    ("eupl", r"european union public licen[cs]e(?: v?1 [12])?", "european union"),
    ("artistic-2.0", r"artistic license(?: version)? 2(?: 0)?", "artistic"),
    ("artistic", r"artistic license", "artistic"),
    ("bsl-1.0", r"boost software license(?: version)?(?: 1 0)?", "boost"),
    ("zlib", r"zlib(?: libpng)? license", "zlib"),
    ("unlicense", r"unlicense", "unlicense"),
    ("wtfpl", r"do what the f\w+ you want to public license|wtfpl", "wtfpl|you want to public"),
    ("python-2.0", r"(?:python software foundation|psf) license(?: version)?(?: 2)?", "software foundation|psf license"),
    ("php", r"php license(?: version)?(?: 3 0[01]?)?", "php"),
    ("ofl-1.1", r"(?:sil )?open font license(?: version)?(?: 1 [01])?", "open font"),
    ("odbl", r"open (?:data commons )?database license", "database license"),
    ("odc-by", r"open data commons attribution license", "open data"),
    ("postgresql", r"postgresql license", "postgresql"),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)? license", "ncsa"),
    ("upl-1.0", r"universal permissive license", "universal permissive"),
    ("openrail", r"(?:creativeml |bigscience )?open ?rail(?: m)?(?: license)?", "rail"),
    ("public-domain", r"public domain", "public domain"),
    ("proprietary", r"proprietary (?:license|software|and confidential)", "proprietary"),
)

#: How a name stands in a text: rule, words around the name, priority, weight.
FORMS = (
    ("tag", r"spdx license identifier {}", 6, 1.0),
    ("grant", r"(?:is |are |been )?(?:released|licensed|distributed|published|made available|available|provided) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{}", 5, 0.95),
    ("subject", r"(?:is |are )?(?:subject to|governed by|covered by|under) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{}", 4, 0.85),
    ("dedication", r"(?:dedicated|placed|released) (?:in|to|into|in to) (?:the )?{}", 4, 0.85),
    ("copy", r"(?:a copy of|see|read) the {}", 3, 0.7),
    ("file", r"license {}", 2, 0.6),
    ("name", r"{}", 1, 0.5),
)

#: Signatures that are not a name in a form: label, regex, keyword, priority, weight.
TEXTS = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted", 6, 1.0),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission to use copy", 6, 1.0),
    ("bsd", r"redistribution and use in source and binary forms with or without modification", "redistribution and use", 6, 1.0),
    ("zlib", r"this software is provided as is without any express or implied warranty", "as is without any", 6, 0.9),
    ("apache-2.0", r"apache org licenses license 2 0", "apache org licenses", 6, 1.0),
    ("gpl", r"gnu org (?:licenses|copyleft)(?: gpl)?", "gnu org", 4, 0.7),
    ("gpl", r"(?:gnu )?gpl(?: ?v? ?[123])?(?: 0)?", "gpl", 1, 0.5),
    ("lgpl", r"lgpl(?: ?v? ?[123])?(?: [01])?", "lgpl", 1, 0.5),
    ("agpl", r"agpl(?: ?v? ?3)?(?: 0)?", "agpl", 1, 0.5),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 6, 1.0),
    ("cc", r"creativecommons org (?:licenses|publicdomain)(?: [a-z]+)*(?: [1234] [05])?", "creativecommons org", 5, 0.9),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d", "copyright", 1, 0.3),
    ("copyright", r"(?:19|20)\d\d copyright", "copyright", 1, 0.3),
    ("restricted", r"no part of this (?:work|publication|document|book) may be reproduced", "may be reproduced", 5, 0.8),
    ("restricted", r"(?:may not|must not) be (?:copied|reproduced|redistributed|republished) without", " be copied| be reproduced| be redistributed| be republished", 5, 0.8),
)

#: Every byte that is no part of a word becomes a blank; capital letters become small.
_WORD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    pattern: str
    keywords: tuple[bytes, ...]
    priority: int
    weight: float


def gates(keywords: str) -> tuple[bytes, ...]:
    return tuple(x.encode() for x in keywords.split("|"))


def rules() -> list[Rule]:
    """All signatures, highest priority first: every name in every form, the texts, and the base phrases."""
    out = [Rule("base", label, phrase, (f" {phrase} ".encode(),), 0, 0.5) for phrase, label in BASE]
    for label, name, keyword in LICENSES:
        for form, around, priority, weight in FORMS:
            out.append(Rule(form, label, around.format(f"(?:{name})"), gates(keyword), priority, weight))
    out += [Rule("text", label, pattern, gates(keyword), priority, weight) for label, pattern, keyword, priority, weight in TEXTS]
    return sorted(out, key=lambda r: -r.priority)


class Scanner:
    """Rules by their keywords: a regex only looks at texts that hold one of them."""

    def __init__(self) -> None:
        self.by_keywords: dict[tuple[bytes, ...], list[tuple[Rule, re.Pattern]]] = {}
        for rule in rules():
            if rule.name != "base":
                self.by_keywords.setdefault(rule.keywords, []).append((rule, re.compile(b" " + rule.pattern.encode() + b"(?= )")))
        self.base = [(f" {phrase} ".encode(), label, len(phrase.split())) for phrase, label in BASE]

    def words(self, text: bytes) -> list[bytes]:
        return text.translate(_WORD).split()

    def base_places(self, line: bytes) -> list[tuple[int, int, str]]:
        """(first word, word after the last, label) of every place of a base phrase."""
        out = []
        for phrase, label, size in self.base:
            at = line.find(phrase)
            while at >= 0:
                first = line.count(b" ", 0, at)
                out.append((first, first + size, label))
                at = line.find(phrase, at + 1)
        return out

    def detections(self, line: bytes) -> list[tuple[int, int, str, str, int, float]]:
        """(start, end, label, rule, priority, weight) left after suppression, in words.

        Found by descending priority, then length: a detection inside the interval of one that is
        kept already is suppressed.
        """
        found = []
        for keywords, some in self.by_keywords.items():
            if not any(x in line for x in keywords):
                continue
            for rule, pattern in some:
                for m in pattern.finditer(line):
                    start = line.count(b" ", 0, m.start())
                    found.append((start, start + line.count(b" ", m.start(), m.end()), rule))
        found.sort(key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].label))
        kept: list[tuple[int, int, str, str, int, float]] = []
        for start, end, rule in found:
            if not any(a <= start and end <= b for a, b, *_ in kept):
                kept.append((start, end, rule.label, rule.name, rule.priority, rule.weight))
        return sorted(kept)


def license_scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, the base phrases' places and the detections.

    ``base`` lists the places of the base phrases as (first, last, label), ``found`` the detections
    of the ordered rules after suppression, as (first, last, label, rule, priority, weight) in
    words from 0. Each text is scanned whole, in one task. Null and empty text have no words and
    no detections; repeated rows and null ids give a row each.
    """
    schema = (
        "doc_id long, n_words long, base array<struct<first: long, last: long, label: string>>, "
        "found array<struct<first: long, last: long, label: string, rule: string, priority: int, weight: double>>"
    )
    base_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string())]))
    found_type = pa.list_(
        pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("rule", pa.string()), ("priority", pa.int32()), ("weight", pa.float64())])
    )

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            size, base, found = [], [], []
            for text in text_bytes(batch.column(1)):
                words = scanner.words(text)
                size.append(len(words))
                line = b" " + b" ".join(words) + b" "
                base.append([{"first": a, "last": b - 1, "label": x} for a, b, x in scanner.base_places(line)])
                found.append(
                    [{"first": a, "last": b - 1, "label": x, "rule": r, "priority": p, "weight": w} for a, b, x, r, p, w in scanner.detections(line)]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(base, base_type), pa.array(found, found_type)], ["doc_id", "n_words", "base", "found"]
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def license_labels(docs: DataFrame) -> DataFrame:
    """The scan's digest: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the chance that a detection is a license notice, taking rules as independent:
    1 - product(1 - weight).
    """
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    some = F.concat("base.label", "found.label")
    miss = F.aggregate("found", F.when(F.size("base") > 0, 0.5).otherwise(1.0), lambda a, x: a * (1 - x["weight"]))
    return license_scan(docs).select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min("base.first").alias("first_word"),
        F.array_max("base.first").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(some).alias("labels"),
        (1 - miss).alias("score"),
    )
