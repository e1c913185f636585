"""License scans: ordered signature rules over whole texts.

Signatures are regular expressions over a text's lower-cased words joined by
one space. A keyword search with an Aho-Corasick automaton decides which of
them run at all; the keywords are read off the patterns, so that no match is
lost. Detections carry a priority; one that lies inside another of the same or
a higher priority is suppressed. Base phrases are always counted.
"""

from __future__ import annotations

import re
import re._parser as sre
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_batches, table

#: Phrase and label.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Label and pattern of the licence's name, by which it is found alone (with "license") and in a grant.
NAMES = (
    ("apache", r"apache(?: software)?(?: foundation)?"),
    ("mit", r"(?:mit|expat|x11)(?: x11)?"),
    ("mit-0", r"mit no attribution|mit 0"),
    ("gpl", r"(?:gnu )?(?:gpl|general public)(?: ?v?[23](?: 0)?)?"),
    ("lgpl", r"(?:gnu )?(?:lgpl|(?:lesser|library) (?:gpl|general public))(?: ?v?[23](?: [01])?)?"),
    ("agpl", r"(?:gnu )?(?:agpl|affero (?:gpl|general public))(?: ?v?3(?: 0)?)?"),
    ("fdl", r"(?:gnu )?(?:fdl|free documentation)"),
    ("mpl", r"mozilla public|mpl(?: [12] [01])?"),
    ("epl", r"eclipse public|epl [12] 0"),
    ("edl", r"eclipse distribution"),
    ("cddl", r"common development and distribution|cddl"),
    ("cpl", r"common public"),
    ("cpal", r"common public attribution"),
    ("ipl", r"ibm public"),
    ("eupl", r"european union public|eupl(?: 1 [0-2])?"),
    ("bsd", r"bsd"),
    ("bsd-2-clause", r"simplified bsd|freebsd|(?:bsd )?(?:2|two) clause(?: bsd)?"),
    ("bsd-3-clause", r"(?:new|modified|revised) bsd|(?:bsd )?(?:3|three) clause(?: bsd)?"),
    ("bsd-4-clause", r"(?:original|old) bsd|(?:bsd )?(?:4|four) clause(?: bsd)?"),
    ("0bsd", r"0bsd|zero clause bsd|bsd zero clause|free public"),
    ("isc", r"isc|internet systems consortium"),
    ("zlib", r"zlib(?: libpng)?"),
    ("libpng", r"libpng|png reference library"),
    ("boost", r"boost software"),
    ("artistic", r"(?:clarified )?artistic"),
    ("python", r"python software foundation|psf|cnri python"),
    ("ruby", r"ruby"),
    ("php", r"php"),
    ("zend", r"zend engine"),
    ("openssl", r"openssl"),
    ("unlicense", r"unlicense"),
    ("wtfpl", r"wtfpl|do what the fuck you want to public"),
    ("beerware", r"beer ?ware"),
    ("ms-pl", r"microsoft public"),
    ("ms-rl", r"microsoft reciprocal"),
    ("osl", r"open software"),
    ("afl", r"academic free"),
    ("ecl", r"educational community"),
    ("upl", r"universal permissive"),
    ("ncsa", r"ncsa|university of illinois(?: ncsa)?(?: open source)?"),
    ("postgresql", r"postgresql"),
    ("odbl", r"odbl|open database|open data commons open database"),
    ("odc-by", r"open data commons attribution"),
    ("pddl", r"public domain dedication and"),
    ("ofl", r"(?:sil )?open font"),
    ("ufl", r"ubuntu font"),
    ("sspl", r"server side public|sspl"),
    ("busl", r"business source"),
    ("elastic", r"elastic"),
    ("commons-clause", r"commons clause"),
    ("polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter)"),
    ("vim", r"vim"),
    ("w3c", r"w3c(?: software)?(?: notice and)?"),
    ("qpl", r"q public"),
    ("sleepycat", r"sleepycat"),
    ("cecill", r"cecill(?: [abc])?"),
    ("mulan", r"mulan (?:permissive software|public)"),
    ("blueoak", r"blue oak model"),
    ("latex", r"latex project public"),
    ("sun-public", r"sun public"),
    ("sun-industry", r"sun industry standards source"),
    ("netscape", r"netscape public"),
    ("nokia", r"nokia open source"),
    ("apple", r"apple public source"),
    ("realnetworks", r"realnetworks public source"),
    ("intel", r"intel open source"),
    ("lucent", r"lucent public"),
    ("motosoto", r"motosoto open source"),
    ("reciprocal", r"reciprocal public"),
    ("simple-public", r"simple public"),
    ("hippocratic", r"hippocratic"),
    ("openrail", r"(?:bigscience )?(?:bloom )?(?:creativeml )?open ?rail(?: m)?"),
    ("llama", r"llama (?:[23] )?(?:[0-9] )?community"),
    ("gemma", r"gemma"),
    ("cdla-permissive", r"community data(?: license)? agreement permissive|cdla permissive"),
    ("cdla-sharing", r"community data(?: license)? agreement sharing|cdla sharing"),
    ("ogl", r"open government"),
    ("etalab", r"(?:etalab )?(?:open licence|licence ouverte)"),
    ("dl-de", r"datenlizenz deutschland"),
    ("pixabay", r"pixabay(?: content)?"),
    ("unsplash", r"unsplash"),
)

#: How a licence is granted, and how it is named; {n} is the name. Name of form, pattern, priority, score.
FORMS = (
    ("grant", r"(?:licen[sc]ed|released|distributed|available|covered|provided|governed|published|subject|redistributed|offered|made available|used) (?:under|by|to) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:conditions of (?:the )?)?(?:{n})(?: (?:public )?licen[sc]e)?(?: (?:version|v) ?\d+(?: \d+)*)?(?: or (?:any )?later(?: version)?)?", 3, 0.95),
    ("name", r"(?:{n}) (?:public )?licen[sc]e(?: (?:version|v) ?\d+(?: \d+)*)?(?: or (?:any )?later(?: version)?)?", 1, 0.8),
)

#: Label, pattern, priority, score; sentences of licence texts, notices, identifiers and addresses, by hand.
SIGNATURES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", 5, 1.0),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 5, 1.0),
    ("mit", r"to deal in the software without restriction", 4, 0.95),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", 4, 0.9),
    ("mit", r"opensource org licenses mit(?: license)?(?: php)?", 4, 1.0),
    ("mit", r"(?:mit|expat|x11) (?:version|v) ?\d+(?: \d+)*", 2, 0.8),
    ("mit", r"spdx license identifier mit", 5, 1.0),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 5, 1.0),
    ("isc", r"permission to use copy modify and or distribute this software", 4, 0.95),
    ("isc", r"isc disclaims all warranties with regard to this software", 4, 1.0),
    ("isc", r"spdx license identifier isc", 5, 1.0),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose", 4, 0.95),
    ("ntp", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee", 5, 0.95),
    ("bsd", r"redistribution and use in source and binary forms", 4, 0.95),
    ("bsd", r"redistributions of source code must retain the above copyright notice", 4, 0.95),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", 4, 0.95),
    ("bsd-3-clause", r"neither the name of .{1,80} nor the names of (?:its|their) contributors may be used to endorse or promote", 5, 1.0),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 5, 1.0),
    ("bsd-2-clause", r"opensource org licenses bsd 2 clause|spdx license identifier bsd 2 clause", 5, 1.0),
    ("bsd-3-clause", r"opensource org licenses bsd 3 clause|spdx license identifier bsd 3 clause", 5, 1.0),
    ("bsd-4-clause", r"spdx license identifier bsd 4 clause", 5, 1.0),
    ("bsd", r"this software is provided by the (?:regents|copyright holders?)(?: and contributors)? as is", 3, 0.9),
    ("bsd", r"bsd style license", 2, 0.8),
    ("0bsd", r"spdx license identifier 0bsd", 5, 1.0),
    ("zlib", r"this software is provided as is without any express or implied warranty", 3, 0.7),
    ("zlib", r"the origin of this software must not be misrepresented", 5, 1.0),
    ("zlib", r"altered source versions must be plainly marked as such", 5, 1.0),
    ("zlib", r"spdx license identifier zlib", 5, 1.0),
    ("boost", r"boost org license 1 0(?: txt)?", 5, 1.0),
    ("boost", r"spdx license identifier bsl 1 0", 5, 1.0),
    ("boost", r"to any person or organization obtaining a copy of the software and accompanying documentation", 5, 1.0),
    ("apache", r"www apache org licenses(?: license 2 0)?", 5, 1.0),
    ("apache", r"you may not use this file except in compliance with the license", 4, 0.9),
    ("apache", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 5, 0.95),
    ("apache", r"spdx license identifier apache(?: [12] [01])?", 5, 1.0),
    ("apache", r"licensed to the apache software foundation asf under one or more contributor license agreements", 5, 1.0),
    ("apache", r"apache (?:version|v) ?\d+(?: \d+)*", 2, 0.85),
    ("apache", r"this product includes software developed by the apache software foundation", 4, 0.9),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 6, 1.0),
    ("gpl", r"this program is free software you can redistribute it", 4, 0.95),
    ("gpl", r"you should have received a copy of the gnu general public license", 5, 1.0),
    ("gpl", r"gnu gpl", 2, 0.85),
    ("gpl", r"(?:gnu )?gpl ?v?[23](?: 0)?(?: or (?:any )?later| only| plus)?", 2, 0.9),
    ("gpl", r"gnu org licenses (?:old licenses )?gpl(?: [23] 0)?(?: html| txt)?", 5, 1.0),
    ("gpl", r"spdx license identifier gpl(?: [123] 0)?(?: only| or later)?", 5, 1.0),
    ("gpl", r"this program is distributed in the hope that it will be useful but without any warranty", 4, 0.9),
    ("gpl", r"the licenses for most software are designed to take away your freedom to share and change it", 5, 1.0),
    ("lgpl", r"this library is free software you can redistribute it", 5, 1.0),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license", 5, 1.0),
    ("lgpl", r"gnu org licenses (?:old licenses )?lgpl(?: [23] [01])?(?: html| txt)?", 5, 1.0),
    ("lgpl", r"spdx license identifier lgpl(?: [23] [01])?(?: only| or later)?", 5, 1.0),
    ("lgpl", r"(?:gnu )?lgpl ?v?[23](?: [01])?(?: or (?:any )?later| only| plus)?", 2, 0.9),
    ("agpl", r"you should have received a copy of the gnu affero general public license", 5, 1.0),
    ("agpl", r"gnu org licenses agpl(?: 3 0)?(?: html| txt)?", 5, 1.0),
    ("agpl", r"spdx license identifier agpl(?: [13] 0)?(?: only| or later)?", 5, 1.0),
    ("agpl", r"(?:gnu )?agpl ?v?3(?: 0)?(?: or (?:any )?later| only| plus)?", 2, 0.9),
    ("fdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 6, 1.0),
    ("fdl", r"gnu org (?:copyleft|licenses) fdl(?: 1 [123])?(?: html| txt)?", 5, 1.0),
    ("mpl", r"this source code form is subject to the terms of the mozilla public license", 6, 1.0),
    ("mpl", r"mozilla org mpl(?: [12] [01])?", 5, 1.0),
    ("mpl", r"the contents of this file are subject to the mozilla public license", 6, 1.0),
    ("mpl", r"spdx license identifier mpl(?: [12] [01])?", 5, 1.0),
    ("epl", r"eclipse org legal epl(?: v ?[12]0| 2 0)?", 5, 1.0),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license", 6, 1.0),
    ("epl", r"spdx license identifier epl [12] 0", 5, 1.0),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license", 6, 1.0),
    ("cddl", r"spdx license identifier cddl 1 [01]", 5, 1.0),
    ("eupl", r"spdx license identifier eupl 1 [0-2]", 5, 1.0),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied", 5, 1.0),
    ("artistic", r"(?:under the )?same terms as perl(?: itself)?", 3, 0.85),
    ("artistic", r"spdx license identifier artistic [12] 0", 5, 1.0),
    ("python", r"this license agreement is between the python software foundation", 5, 1.0),
    ("python", r"psf grants to licensee|python org psf license", 5, 0.95),
    ("openssl", r"this product includes software developed by the openssl project", 5, 1.0),
    ("openssl", r"this product includes cryptographic software written by eric young", 5, 0.95),
    ("unlicense", r"this is free and unencumbered software released into the public domain", 6, 1.0),
    ("unlicense", r"unlicense org|spdx license identifier unlicense", 5, 1.0),
    ("wtfpl", r"do what the fuck you want to", 4, 1.0),
    ("wtfpl", r"wtfpl", 1, 0.9),
    ("beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer", 5, 1.0),
    ("beerware", r"the beer ?ware license", 4, 1.0),
    ("ncsa", r"to deal with the software without restriction", 5, 0.95),
    ("ncsa", r"spdx license identifier ncsa", 5, 1.0),
    ("postgresql", r"in no event shall the university of california be liable to any party", 5, 0.9),
    ("ofl", r"scripts sil org ofl|openfontlicense org", 5, 1.0),
    ("ofl", r"with reserved font name", 4, 0.9),
    ("ofl", r"spdx license identifier ofl 1 [01]", 5, 1.0),
    ("sspl", r"spdx license identifier sspl 1 0", 5, 1.0),
    ("busl", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", 5, 1.0),
    ("busl", r"spdx license identifier busl 1 1", 5, 1.0),
    ("commons-clause", r"the license does not grant to you the right to sell the software", 5, 1.0),
    ("commons-clause", r"commons clause license condition", 4, 1.0),
    ("vim", r"vim license|vim is charityware", 3, 0.85),
    ("odbl", r"opendatacommons org licenses odbl", 5, 1.0),
    ("odc-by", r"opendatacommons org licenses by", 5, 1.0),
    ("pddl", r"opendatacommons org licenses pddl", 5, 1.0),
    ("cc0", r"cc0(?: 1 0)?(?: universal)?", 3, 0.9),
    ("cc0", r"creative ?commons zero(?: v ?1 0)?", 3, 0.95),
    ("cc0", r"creativecommons org publicdomain zero(?: 1 0)?", 5, 1.0),
    ("cc0", r"to the extent possible under law .{1,80} has waived all copyright", 5, 1.0),
    ("cc-by", r"cc by(?: [1-4] [05])?", 2, 0.9),
    ("cc-by-sa", r"cc by sa(?: [1-4] [05])?", 3, 0.95),
    ("cc-by-nd", r"cc by nd(?: [1-4] [05])?", 3, 0.95),
    ("cc-by-nc", r"cc by nc(?: [1-4] [05])?", 3, 0.95),
    ("cc-by-nc-sa", r"cc by nc sa(?: [1-4] [05])?", 4, 0.95),
    ("cc-by-nc-nd", r"cc by nc nd(?: [1-4] [05])?", 4, 0.95),
    ("cc-by", r"creativecommons org licenses by(?: [1-4] [05])?", 4, 1.0),
    ("cc-by-sa", r"creativecommons org licenses by sa(?: [1-4] [05])?", 5, 1.0),
    ("cc-by-nd", r"creativecommons org licenses by nd(?: [1-4] [05])?", 5, 1.0),
    ("cc-by-nc", r"creativecommons org licenses by nc(?: [1-4] [05])?", 5, 1.0),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa(?: [1-4] [05])?", 6, 1.0),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd(?: [1-4] [05])?", 6, 1.0),
    ("cc-by", r"creative commons attribution(?: [1-4] [05])?", 2, 0.9),
    ("cc-by-sa", r"creative commons attribution share ?alike(?: [1-4] [05])?", 3, 0.95),
    ("cc-by-nc", r"creative commons attribution non ?commercial(?: [1-4] [05])?", 3, 0.95),
    ("cc-by-nd", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?", 3, 0.95),
    ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", 4, 0.95),
    ("cc-by-nc-nd", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?", 4, 0.95),
    ("cc-by-sa", r"text is available under the creative commons attribution share ?alike license", 5, 1.0),
    ("public-domain", r"(?:placed|released|dedicated|put) (?:in|into|to) the public domain", 3, 0.9),
    ("public-domain", r"this (?:work|text|file|software|document|book|image) is in the public domain", 3, 0.9),
    ("public-domain", r"creativecommons org publicdomain mark", 5, 1.0),
    ("public-domain", r"no copyright (?:is claimed|restrictions apply)", 2, 0.7),
    ("gutenberg", r"this (?:ebook|etext) is for the use of anyone anywhere", 5, 1.0),
    ("gutenberg", r"project gutenberg license", 4, 1.0),
    ("ogl", r"contains public sector information licensed under the open government licence", 6, 1.0),
    ("ogl", r"nationalarchives gov uk doc open government licence", 5, 1.0),
    ("etalab", r"etalab gouv fr licence ouverte", 5, 1.0),
    ("dl-de", r"govdata de dl de (?:by|zero) 2 0", 5, 1.0),
    ("openrail", r"use based restrictions as referenced in paragraph 5", 4, 0.9),
    ("llama", r"llama (?:[23] )?(?:[0-9] )?is licensed under the llama", 5, 1.0),
    ("proprietary", r"all rights reserved", 1, 0.6),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", 2, 0.7),
    ("proprietary", r"may not be (?:reproduced|copied|distributed|republished) (?:in whole or in part )?without (?:the )?(?:express )?(?:prior )?(?:written )?(?:permission|consent)", 2, 0.7),
    ("proprietary", r"unauthori[sz]ed (?:copying|reproduction|use|distribution) (?:of this (?:file|work|document) )?(?:via any medium )?is (?:strictly )?prohibited", 2, 0.75),
    ("proprietary", r"no part of this (?:publication|book|work|document) may be reproduced", 2, 0.75),
    ("proprietary", r"(?:this is an unpublished work|trade secrets? of)", 2, 0.6),
    ("proprietary", r"end user licen[sc]e agreement", 2, 0.7),
    ("proprietary", r"by (?:installing|downloading|using) (?:this|the) (?:software|product) you (?:agree|accept)", 2, 0.6),
    ("non-commercial", r"(?:for )?non ?commercial (?:use|purposes) only", 2, 0.7),
    ("non-commercial", r"not (?:for|to be used for) commercial (?:use|purposes)", 2, 0.7),
    ("research-only", r"for (?:academic )?research (?:use|purposes) only", 2, 0.7),
)

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Word bytes stay (all above 0x7F among them), others become a space.
_WORDS = bytes(c if c >= 0x80 or chr(c).isdigit() or 97 <= c <= 122 else 32 for c in _LOWER)


def required(pattern: str) -> frozenset[str]:
    """Texts of which any match of ``pattern`` holds one, read off the pattern itself."""

    def of(parts) -> frozenset[str]:
        """The best of what each part, or run of letters, calls for: that whose shortest text is the longest."""
        found, run = [], ""
        for op, arg in parts:
            if op is sre.LITERAL:
                run += chr(arg)
                continue
            found.append(frozenset((run,)))
            run = ""
            if op is sre.SUBPATTERN:
                found.append(of(arg[3]))
            elif op is sre.BRANCH:
                each = [of(x) for x in arg[1]]
                found.append(frozenset().union(*each) if all(each) else frozenset())
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                found.append(of(arg[2]))
        found.append(frozenset((run,)))
        return max((x for x in found if x and all(x)), key=lambda x: (min(map(len, x)), -len(x)), default=frozenset())

    return of(sre.parse(pattern))


@cache
def rules() -> list[tuple[str, re.Pattern, frozenset[str], int, float]]:
    """(label, pattern over the joined words, texts of which a match holds one, priority, score): names in both forms, then the signatures."""
    made = [(label, pattern.format(n=name), q, s) for label, name in NAMES for _, pattern, q, s in FORMS] + list(SIGNATURES)
    return [(a, re.compile(rf"(?<![^ ])(?:{p})(?![^ ])".encode()), required(p), q, s) for a, p, q, s in made]


@cache
def _automaton() -> tuple[ahocorasick.Automaton, dict[str, list[int]], list[int]]:
    by: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        for k in r[2]:
            by.setdefault(k, []).append(i)
    a = ahocorasick.Automaton()
    for k in by:
        a.add_word(k, k)
    a.make_automaton()
    return a, by, [i for i, r in enumerate(rules()) if not r[2]]


def matches(words: bytes, gated: bool = True) -> list[tuple[int, int, int]]:
    """(begin, end, rule) of every match, by place and longest first; the gate leaves out only rules that cannot match."""
    run = range(len(rules()))
    if gated:
        automaton, by, always = _automaton()
        run = sorted({i for k in {k for _, k in automaton.iter(words.decode("ascii", "replace"))} for i in by[k]} | set(always))
    found = [(m.start(), m.end(), i) for i in run for m in rules()[i][1].finditer(words)]
    return sorted(found, key=lambda x: (x[0], -x[1], -rules()[x[2]][3], x[2]))


def detect(words: bytes, gated: bool = True) -> list[tuple[int, int, str, float]]:
    """Detections (begin, end in bytes, label, score) left after suppression, in order of place.

    One that lies inside another of the same or a higher priority goes; of equal
    places the higher priority stays, then the rule that stands first.
    """
    out, open_ = [], []
    for b, e, i in matches(words, gated):  # what contains this one stands before it
        open_ = [x for x in open_ if x[1] > b]
        if not any(x[1] >= e and x[2] >= rules()[i][3] for x in open_):
            out.append((b, e, rules()[i][0], rules()[i][4]))
        open_.append((b, e, rules()[i][3]))
    return out


def base_places(words: bytes) -> list[tuple[int, str]]:
    """(word number, label) of every place where a base phrase stands."""
    out = []
    for phrase, label in BASE:
        p = phrase.encode()
        at, seen, counted = words.find(p), 0, 0
        while at >= 0:
            seen, counted = seen + words.count(b" ", counted, at), at
            end = at + len(p)
            if (at == 0 or words[at - 1] == 32) and (end == len(words) or words[end] == 32):
                out.append((seen, label))
            at = words.find(p, at + 1)
    return out


def scan(text: bytes | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, detections) of a text; null and empty have none."""
    words = b" ".join((text or b"").translate(_WORDS).split())
    base = base_places(words)
    found = detect(words)
    labels = {x[1] for x in base}
    at = [x[0] for x in base]
    score = max([*(x[3] for x in found), 0.8 if base else 0.0])
    return words.count(b" ") + 1 if words else 0, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x[2] for x in found})), score, [{"begin": b, "end": e, "label": x} for b, e, x, _ in found]


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, detections array<struct<begin: bigint, end: bigint, label: string>>"
_TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))]


def _scans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    for b in batches:
        cols = list(zip(*(scan(t) for t in b.column("__text").to_pylist()))) or [()] * 8
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, _TYPES))], names)


def license_scan(docs: DataFrame) -> DataFrame:
    """Base places, labels, score and detections (bytes of the joined words) of every row of ``docs`` (doc_id, text).

    A null or empty text has no words and empty labels, a text of any length is
    scanned whole; rows that are repeated are scanned each, null ids too; of
    detections at one place the higher priority, then the earlier rule stays;
    other columns do not matter; an empty table gives no rows.
    """
    arrow_batches(docs.sparkSession)
    return docs.selectExpr("doc_id", "CAST(text AS BINARY) AS __text").mapInArrow(_scans, SCHEMA)


def op8_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


QUERIES = {"op8_license_signatures": op8_license_signatures}
ORACLES: dict[str, str] = {}
