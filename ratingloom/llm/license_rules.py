"""License detection by ordered signature rules.

A rule is a regular expression with a label, a priority and a keyword. One pass of a keyword
automaton over a text tells which rules can match at all; only those are tried. Detections are
then taken by priority, longer ones first: one that lies inside a detection already taken is
suppressed, so that the most specific name of a passage remains.

Texts have A-Z folded. The rules are built from a table of licenses and a few ways of naming one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ratingloom.llm.tables import documents, map_slices

# The base phrases and their labels.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Label, words of which every name of the license contains one, names (regular
# expressions; a blank stands for white space and comment marks), identifier and address.
LICENSES = (
    ("0bsd", "bsd", r"(?:zero[- ]clause|0[- ]clause) bsd(?: license)?|0bsd(?: license)?", "0bsd", "opensource.org/licenses/0bsd"),
    ("afl-3.0", "academic", r"academic free license(?: v(?:ersion)?\.? ?3\.0)?", "afl-3.0", "opensource.org/licenses/afl-3.0"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e(?:,? v(?:ersion)? ?3(?:\.0)?)?", "agpl-3.0", "gnu.org/licenses/agpl"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e,? v(?:ersion)?\.? ?1\.1", "apache-1.1", "apache.org/licenses/license-1.1"),
    ("apache-2.0", "apache", r"apache(?: software)? licen[cs]e,? (?:v(?:ersion)?\.? ?)?2(?:\.0)?", "apache-2.0", "apache.org/licenses/license-2.0"),
    ("apsl-2.0", "apple", r"apple public source licen[cs]e(?:,? v(?:ersion)? ?2(?:\.0)?)?", "apsl-2.0", "opensource.apple.com/license/apsl"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e(?:,? v?(?:ersion )?2(?:\.0)?)?", "artistic-2.0", "opensource.org/licenses/artistic-2.0"),
    ("bsd-2-clause", "bsd", r"(?:2[- ]clause|simplified|two[- ]clause) bsd(?: licen[cs]e)?|bsd[- ]2[- ]clause(?: licen[cs]e)?", "bsd-2-clause", "opensource.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:3[- ]clause|new|revised|modified|three[- ]clause) bsd(?: licen[cs]e)?|bsd[- ]3[- ]clause(?: licen[cs]e)?", "bsd-3-clause", "opensource.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:4[- ]clause|original|four[- ]clause) bsd(?: licen[cs]e)?|bsd[- ]4[- ]clause(?: licen[cs]e)?", "bsd-4-clause", "spdx.org/licenses/bsd-4-clause"),
    ("bsd", "bsd", r"bsd[- ](?:style )?licen[cs]e", "bsd", "opensource.org/licenses/bsd-license"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e(?:,? v(?:ersion)? ?1\.0)?", "bsl-1.0", "boost.org/license_1_0"),
    ("busl-1.1", "business", r"business source licen[cs]e(?: 1\.1)?", "busl-1.1", "mariadb.com/bsl11"),
    ("cc0-1.0", "cc0", r"cc0(?:[- ]1\.0)?(?: universal)?", "cc0-1.0", "creativecommons.org/publicdomain/zero/1.0"),
    ("cc-by", "cc", r"cc[- ]by(?![- ]?(?:nc|nd|sa))(?:[- ][1-4]\.0)?", "cc-by-4.0", "creativecommons.org/licenses/by/"),
    ("cc-by-nc", "cc", r"cc[- ]by[- ]nc(?![- ](?:nd|sa))(?:[- ][1-4]\.0)?", "cc-by-nc-4.0", "creativecommons.org/licenses/by-nc/"),
    ("cc-by-nc-nd", "cc", r"cc[- ]by[- ]nc[- ]nd(?:[- ][1-4]\.0)?", "cc-by-nc-nd-4.0", "creativecommons.org/licenses/by-nc-nd/"),
    ("cc-by-nc-sa", "cc", r"cc[- ]by[- ]nc[- ]sa(?:[- ][1-4]\.0)?", "cc-by-nc-sa-4.0", "creativecommons.org/licenses/by-nc-sa/"),
    ("cc-by-nd", "cc", r"cc[- ]by[- ]nd(?:[- ][1-4]\.0)?", "cc-by-nd-4.0", "creativecommons.org/licenses/by-nd/"),
    ("cc-by-sa", "cc", r"cc[- ]by[- ]sa(?:[- ][1-4]\.0)?", "cc-by-sa-4.0", "creativecommons.org/licenses/by-sa/"),
    ("cc-by", "commons", r"creative commons attribution(?![- ](?:non|no|share))(?: [1-4]\.0)?(?: international)?(?: licen[cs]e)?", "cc-by-3.0", "creativecommons.org/licenses/by/3.0"),
    ("cc-by-nc", "commons", r"creative commons attribution[- ]non-?commercial(?![- ](?:no|share))(?: [1-4]\.0)?(?: international)?(?: licen[cs]e)?", "cc-by-nc-3.0", "creativecommons.org/licenses/by-nc/3.0"),
    ("cc-by-sa", "commons", r"creative commons attribution[- ]share-?alike(?: [1-4]\.0)?(?: international)?(?: licen[cs]e)?", "cc-by-sa-3.0", "creativecommons.org/licenses/by-sa/3.0"),
    ("cddl-1.0", "development", r"common development and distribution licen[cs]e(?:,? v?(?:ersion )?1\.[01])?", "cddl-1.0", "opensource.org/licenses/cddl-1.0"),
    ("cecill-2.1", "cecill", r"cecill(?:[- ][abc])?(?: (?:free software )?licen[cs]e)?(?: v?2\.[01])?", "cecill-2.1", "cecill.info/licences"),
    ("cpl-1.0", "common", r"common public licen[cs]e(?:,? v(?:ersion)? ?1\.0)?", "cpl-1.0", "opensource.org/licenses/cpl1.0"),
    ("ecl-2.0", "educational", r"educational community licen[cs]e(?:,? v(?:ersion)? ?2\.0)?", "ecl-2.0", "opensource.org/licenses/ecl-2.0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e,? ?(?:-|v(?:ersion)?)? ?1\.0", "epl-1.0", "eclipse.org/legal/epl-v10"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e(?:,? ?(?:-|v(?:ersion)?)? ?2\.0)?", "epl-2.0", "eclipse.org/legal/epl-2.0"),
    ("eupl-1.2", "european", r"european union public licen[cs]e(?:,? v(?:ersion)?\.? ?1\.[12])?", "eupl-1.2", "joinup.ec.europa.eu/collection/eupl"),
    ("gfdl-1.3", "documentation", r"(?:gnu )?free documentation licen[cs]e(?:,? v(?:ersion)? ?1\.[123])?", "gfdl-1.3", "gnu.org/licenses/fdl"),
    ("gpl-2.0", "general|gpl", r"gnu (?:general public licen[cs]e|gpl),? v(?:ersion)?\.? ?2(?:\.0)?|gplv2", "gpl-2.0", "gnu.org/licenses/gpl-2.0"),
    ("gpl-3.0", "general|gpl", r"gnu (?:general public licen[cs]e|gpl),? v(?:ersion)?\.? ?3(?:\.0)?|gplv3", "gpl-3.0", "gnu.org/licenses/gpl-3.0"),
    ("gpl", "general", r"(?:gnu )?general public licen[cs]e", "gpl", "gnu.org/licenses/gpl.html"),
    ("isc", "isc", r"isc licen[cs]e", "isc", "opensource.org/licenses/isc"),
    ("lgpl-2.1", "lesser|library", r"(?:gnu )?(?:lesser|library) general public licen[cs]e,? v(?:ersion)?\.? ?2(?:\.[01])?", "lgpl-2.1", "gnu.org/licenses/lgpl-2.1"),
    ("lgpl-3.0", "lesser|library", r"(?:gnu )?lesser general public licen[cs]e(?:,? v(?:ersion)?\.? ?3(?:\.0)?)?", "lgpl-3.0", "gnu.org/licenses/lgpl-3.0"),
    ("lppl-1.3c", "latex", r"latex project public licen[cs]e(?:,? v(?:ersion)? ?1\.3[abc]?)?", "lppl-1.3c", "latex-project.org/lppl"),
    ("mit", "mit|expat", r"mit licen[cs]e|expat licen[cs]e", "mit", "opensource.org/licenses/mit"),
    ("mit-0", "mit", r"mit[- ](?:no attribution|0)(?: licen[cs]e)?", "mit-0", "github.com/aws/mit-0"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e,? v(?:ersion)?\.? ?1\.1", "mpl-1.1", "mozilla.org/mpl/1.1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e(?:,? v?(?:ersion)?\.? ?2\.0)?", "mpl-2.0", "mozilla.org/mpl/2.0"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e(?: \(ms-pl\))?", "ms-pl", "opensource.org/licenses/ms-pl"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa open source licen[cs]e", "ncsa", "opensource.org/licenses/ncsa"),
    ("odbl-1.0", "database", r"open (?:data commons open )?database licen[cs]e(?: v?1\.0)?", "odbl-1.0", "opendatacommons.org/licenses/odbl"),
    ("ofl-1.1", "font", r"(?:sil )?open font licen[cs]e(?:,? v?(?:ersion )?1\.1)?", "ofl-1.1", "scripts.sil.org/ofl"),
    ("openssl", "openssl", r"openssl licen[cs]e", "openssl", "openssl.org/source/license"),
    ("osl-3.0", "software", r"open software licen[cs]e(?:,? v(?:ersion)?\.? ?3\.0)?", "osl-3.0", "opensource.org/licenses/osl-3.0"),
    ("php-3.01", "php", r"php licen[cs]e(?:,? v(?:ersion)? ?3\.0?1)?", "php-3.01", "php.net/license"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", "postgresql", "opensource.org/licenses/postgresql"),
    ("psf-2.0", "python", r"python software foundation licen[cs]e(?:,? v(?:ersion)? ?2)?", "psf-2.0", "docs.python.org/3/license"),
    ("sspl-1.0", "server", r"server side public licen[cs]e(?:,? v(?:ersion)? ?1)?", "sspl-1.0", "mongodb.com/licensing/server-side-public-license"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense", "unlicense.org"),
    ("upl-1.0", "permissive", r"universal permissive licen[cs]e(?:,? v(?:ersion)? ?1\.0)?", "upl-1.0", "opensource.org/licenses/upl"),
    ("wtfpl", "wtfpl", r"wtfpl", "wtfpl", "wtfpl.net"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[cs]e", "zlib", "opensource.org/licenses/zlib"),
    ("zpl-2.1", "zope", r"zope public licen[cs]e(?:,? v?(?:ersion )?2\.[01])?", "zpl-2.1", "opensource.org/licenses/zpl-2.1"),
)

# Ways of naming a license: pattern, priority, score.
FORMS = (
    ("identifier", r"spdx-license-identifier: *\(?{id}(?![\w.-]*\w)", 90, 1.0),
    ("grant", r"(?:licen[cs]ed|released|distributed|available|published|provided|redistributed)(?: \w+){{0,2}}? under (?:the )?(?:terms of )?(?:the )?(?:{name})", 80, 0.95),
    ("reference", r"(?:subject to|see|accordance with|compliance with|copy of|covered by|governed by) (?:the )?(?:terms of )?(?:the )?(?:{name})", 70, 0.85),
    ("address", r"{url}", 60, 0.8),
    ("name", r"(?<!\w)(?:{name})(?!\w)", 50, 0.7),
)

# Notices that name no license of the table: label, keyword, pattern, priority, score.
NOTICES = (
    ("mit", "hereby", r"permission is hereby granted, free of charge, to any person obtaining a copy", 85, 1.0),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms, with or without modification", 85, 0.9),
    ("isc", "permission", r"permission to use, copy, modify, and/or distribute this software for any purpose", 85, 1.0),
    ("public-domain", "domain", r"(?:released|placed|dedicated|contributed) (?:in(?:to)?|to) the public domain|public domain dedication", 75, 0.8),
    ("proprietary", "reserved", r"all rights reserved", 20, 0.3),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)(?: information)?", 65, 0.8),
    ("copyright", "copyright", r"copyright (?:\(c\)|©)? ?(?:19|20)\d\d", 10, 0.2),
)


@dataclass(frozen=True)
class SignatureRule:
    """A detection rule; every match contains one of the ``|``-separated keywords."""

    label: str
    keyword: str
    pattern: str
    priority: int
    score: float


def _wrapped(pattern: str) -> str:
    """Let a blank stand for white space and comment marks, so that wrapped and commented headers match.

    A run is at most 40 long, which bounds the work on long stretches of white space. In a character
    class a blank is any white space.
    """
    def replaced(found: re.Match) -> str:
        if found[0][0] == "[":
            return found[0].replace(" ", r"\s")
        return r"[\s*#/]{0,40}" if len(found[0]) > 1 else r"[\s*#/]{1,40}"

    return re.sub(r"\[[^\]]*\]| [?*]?", replaced, pattern)


def default_rules() -> tuple[SignatureRule, ...]:
    """Every form of every license, and the notices: some three hundred rules in a fixed order."""
    rules = [SignatureRule(label, keyword, _wrapped(pattern), priority, score)
             for label, keyword, pattern, priority, score in NOTICES]
    for label, keyword, name, identifier, address in LICENSES:
        for form, pattern, priority, score in FORMS:
            gate = {"identifier": "spdx-license-identifier", "address": address}.get(form, keyword)
            filled = pattern.format(id=re.escape(identifier), name=name, url=re.escape(address))
            rules.append(SignatureRule(label, gate, _wrapped(filled), priority, score))
    return tuple(rules)


class Detector:
    """Compiled rules behind one keyword automaton."""

    def __init__(self, rules: tuple[SignatureRule, ...]):
        self.rules = rules
        self.patterns = [re.compile(rule.pattern) for rule in rules]
        gates: dict[str, list[int]] = {}
        for number, rule in enumerate(rules):
            for word in rule.keyword.split("|"):
                gates.setdefault(word, []).append(number)
        self.automaton = ahocorasick.Automaton()
        for word, numbers in gates.items():
            self.automaton.add_word(word, tuple(numbers))
        self.automaton.make_automaton()

    def detections(self, text: str) -> list[tuple[int, int, int]]:
        """``(start, end, rule)`` of what remains after suppression, by place; ``text`` is folded."""
        candidates = {n for _, numbers in self.automaton.iter(text) for n in numbers}
        found = [(self.rules[n].priority, m.end() - m.start(), -m.start(), -n, m.end())
                 for n in sorted(candidates) for m in self.patterns[n].finditer(text) if m.end() > m.start()]
        taken: list[tuple[int, int, int]] = []
        # Taken spans that no other one holds: starts and ends both rise.
        starts: list[int] = []
        ends: list[int] = []
        for priority, length, start, number, end in sorted(found, reverse=True):
            start = -start
            at = bisect_right(starts, start)
            if at and ends[at - 1] >= end:
                continue
            taken.append((start, end, -number))
            low = bisect_left(starts, start)
            high = bisect_right(ends, end)
            starts[low: max(low, high)] = [start]
            ends[low: max(low, high)] = [end]
        return sorted(taken)


@cache
def _detector(rules: tuple[SignatureRule, ...]) -> Detector:
    return Detector(rules)


# Bytes of words keep their folded value, all others become blanks.
_FOLDED = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))
_PHRASES = tuple((tuple(w.encode() for w in phrase.split()), label) for phrase, label in BASE_PHRASES)
_FIRSTS = {words[0] for words, _ in _PHRASES}


def base_places(text: str) -> tuple[int, list[tuple[int, str]]]:
    """Number of words, and ``(word, label)`` of each base phrase."""
    folded = text.encode().translate(_FOLDED)
    words = folded.split()
    places = []
    if any(b" ".join(phrase[:1]) in folded for phrase, _ in _PHRASES):
        for at, word in enumerate(words):
            if word in _FIRSTS:
                places += [(at, label) for phrase, label in _PHRASES if tuple(words[at: at + len(phrase)]) == phrase]
    return len(words), places


_UPPER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def scan_licenses(docs: DataFrame, rules: tuple[SignatureRule, ...] | None = None, doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """One row a document: base places, labels, score, and the detections themselves.

    ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``; spans are
    ``label:start:end`` in code points, comma-joined. ``score`` is that of the surest detection, at
    least 0.5 where a base phrase stands, else 0. A null or empty text has no words, no labels and
    score 0. Repeated rows are scanned as often as they come, null ids stay null, an empty table
    gives an empty table, other columns are not looked at.
    """
    rules = default_rules() if rules is None else rules
    kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(),
             "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(),
             "spans": pa.string()}

    def scan(part: pa.RecordBatch) -> pa.RecordBatch:
        detector = _detector(rules)
        rows = []
        for name, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
            count, places = base_places(text)
            found = [(a, b, rules[n]) for a, b, n in detector.detections(text.translate(_UPPER))]
            base = {label for _, label in places}
            rows.append((name, count, len(places), places[0][0] if places else None, places[-1][0] if places else None,
                         ",".join(sorted(base)), ",".join(sorted(base | {rule.label for *_, rule in found})),
                         max([0.5] * bool(places) + [rule.score for *_, rule in found] + [0.0]),
                         ",".join(f"{rule.label}:{a}:{b}" for a, b, rule in found)))
        return pa.record_batch({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), zip(*rows))})

    return map_slices(documents(docs, doc_id, text), scan,
                      "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
                      "labels string, score double, spans string")
