"""License detection by ordered signature rules.

Rules are regexes with a keyword, a kind and a priority.  One Aho-Corasick pass
over the text, gaps folded, finds the keywords; only rules whose keyword occurs are run.
Their matches are intervals: taken in the order of priority, then length, a
match inside an accepted one is suppressed (the name inside its grant, the
grant inside the full notice, the plain name inside the longer one).

The rules come from two tables: license families with the patterns of their
names, each put into the templates of ``TEMPLATES``, and notices written out
sentence by sentence.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE, WORD_TABLE, bounded_batches, to_bytes

#: Fixed values of the base: phrases, their words consecutive, and labels.
BASE_PHRASES = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}

#: Between words of a notice: blanks, line breaks and comment marks.
MARKS = "*#/;:,.\"'()-_|"
GAP = rf"[\s{re.escape(MARKS)}]{{1,24}}"
VERSION = rf"(?:{GAP})?(?:v(?:er(?:sion)?)?{GAP})?v?\.?"

#: Fixed values: (label, SPDX pattern, keyword, name pattern; a blank in it stands for GAP).
FAMILIES = [
    ("mit", r"mit", "mit", r"mit licen[cs]e"),
    ("mit-0", r"mit-0", "mit", r"mit no attribution(?: licen[cs]e)?|mit-0"),
    ("x11", r"x11", "x11", r"x11 licen[cs]e"),
    ("apache-1.0", r"apache-1\.0", "apache", rf"apache(?: software)? licen[cs]e{VERSION}1\.0"),
    ("apache-1.1", r"apache-1\.1", "apache", rf"apache(?: software)? licen[cs]e{VERSION}1\.1"),
    ("apache-2.0", r"apache-2\.0", "apache", rf"apache(?: software)? licen[cs]e{VERSION}2(?:\.0)?|apache-2\.0"),
    ("bsd-0-clause", r"0bsd", "bsd", r"0bsd|zero clause bsd(?: licen[cs]e)?"),
    ("bsd-1-clause", r"bsd-1-clause", "bsd", r"(?:1|one) clause bsd(?: licen[cs]e)?|bsd-1-clause"),
    ("bsd-2-clause", r"bsd-2-clause", "bsd", r"(?:2|two) clause bsd(?: licen[cs]e)?|simplified bsd licen[cs]e|freebsd licen[cs]e|bsd-2-clause"),
    ("bsd-3-clause", r"bsd-3-clause", "bsd", r"(?:3|three) clause bsd(?: licen[cs]e)?|(?:new|modified|revised) bsd licen[cs]e|bsd-3-clause"),
    ("bsd-4-clause", r"bsd-4-clause", "bsd", r"(?:4|four) clause bsd(?: licen[cs]e)?|original bsd licen[cs]e|bsd-4-clause"),
    ("bsd", r"bsd", "bsd", r"bsd(?: style)? licen[cs]e"),
    ("isc", r"isc", "isc", r"isc licen[cs]e"),
    ("zlib", r"zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("bsl-1.0", r"bsl-1\.0", "boost", rf"boost software licen[cs]e(?:{VERSION}1\.0)?"),
    ("busl-1.1", r"busl-1\.1", "business source", rf"business source licen[cs]e(?:{VERSION}1\.1)?"),
    ("sspl-1.0", r"sspl-1\.0", "server side public", rf"server side public licen[cs]e(?:{VERSION}1)?"),
    ("elastic-2.0", r"elastic-2\.0", "elastic", rf"elastic licen[cs]e(?:{VERSION}2(?:\.0)?)?"),
    ("gpl-1.0", r"gpl-1\.0(?:-only|-or-later|\+)?", "gpl|general public", rf"(?:gnu )?(?:general public licen[cs]e|gpl){VERSION}1(?:\.0)?(?!\.?\d)"),
    ("gpl-2.0", r"gpl-2\.0(?:-only|-or-later|\+)?", "gpl|general public", rf"(?:gnu )?(?:general public licen[cs]e|gpl){VERSION}2(?:\.0)?(?!\.?\d)"),
    ("gpl-3.0", r"gpl-3\.0(?:-only|-or-later|\+)?", "gpl|general public", rf"(?:gnu )?(?:general public licen[cs]e|gpl){VERSION}3(?:\.0)?(?!\.?\d)"),
    ("gpl", r"gpl", "gpl|general public", r"gnu general public licen[cs]e|gnu gpl|general public licen[cs]e"),
    ("lgpl-2.0", r"lgpl-2\.0(?:-only|-or-later|\+)?", "lgpl|general public", rf"(?:gnu )?(?:library general public licen[cs]e|lgpl){VERSION}2(?:\.0)?(?!\.?\d)"),
    ("lgpl-2.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", "lgpl|general public", rf"(?:gnu )?(?:lesser general public licen[cs]e|lgpl){VERSION}2\.1"),
    ("lgpl-3.0", r"lgpl-3\.0(?:-only|-or-later|\+)?", "lgpl|general public", rf"(?:gnu )?(?:lesser general public licen[cs]e|lgpl){VERSION}3(?:\.0)?(?!\.?\d)"),
    ("lgpl", r"lgpl", "lgpl|general public", r"(?:gnu )?(?:lesser|library) general public licen[cs]e|gnu lgpl"),
    ("agpl-3.0", r"agpl-3\.0(?:-only|-or-later|\+)?", "agpl|affero", rf"(?:gnu )?(?:affero general public licen[cs]e|agpl){VERSION}3(?:\.0)?(?!\.?\d)"),
    ("agpl", r"agpl", "agpl|affero", r"(?:gnu )?affero general public licen[cs]e|gnu agpl"),
    ("gfdl-1.3", r"gfdl-1\.3(?:-only|-or-later)?", "free documentation", rf"(?:gnu )?free documentation licen[cs]e(?:{VERSION}1\.[123])?"),
    ("mpl-1.0", r"mpl-1\.0", "mozilla public|mpl", rf"(?:mozilla public licen[cs]e|mpl){VERSION}1\.0"),
    ("mpl-1.1", r"mpl-1\.1", "mozilla public|mpl", rf"(?:mozilla public licen[cs]e|mpl){VERSION}1\.1"),
    ("mpl-2.0", r"mpl-2\.0", "mozilla public|mpl", rf"(?:mozilla public licen[cs]e|mpl){VERSION}2(?:\.0)?"),
    ("mpl", r"mpl", "mozilla public", r"mozilla public licen[cs]e"),
    ("epl-1.0", r"epl-1\.0", "eclipse public|epl", rf"(?:eclipse public licen[cs]e|epl){VERSION}1(?:\.0)?"),
    ("epl-2.0", r"epl-2\.0", "eclipse public|epl", rf"(?:eclipse public licen[cs]e|epl){VERSION}2(?:\.0)?"),
    ("cddl-1.0", r"cddl-1\.0", "cddl|common development", rf"(?:common development and distribution licen[cs]e|cddl)(?:{VERSION}1\.0)?"),
    ("cpl-1.0", r"cpl-1\.0", "common public", rf"common public licen[cs]e(?:{VERSION}1\.0)?"),
    ("eupl-1.2", r"eupl-1\.2", "eupl|european union public", rf"(?:european union public licen[cs]e|eupl)(?:{VERSION}1\.[12])?"),
    ("artistic-1.0", r"artistic-1\.0", "artistic", rf"artistic licen[cs]e{VERSION}1\.0"),
    ("artistic-2.0", r"artistic-2\.0", "artistic", rf"artistic licen[cs]e(?:{VERSION}2\.0)?"),
    ("psf-2.0", r"psf-2\.0|python-2\.0", "python software|psf", r"python software foundation licen[cs]e|psf licen[cs]e"),
    ("php-3.01", r"php-3\.01", "php licen", rf"php licen[cs]e(?:{VERSION}3\.0?1)?"),
    ("ruby", r"ruby", "ruby licen", r"ruby licen[cs]e"),
    ("openssl", r"openssl", "openssl licen", r"openssl licen[cs]e"),
    ("postgresql", r"postgresql", "postgresql licen", r"postgresql licen[cs]e"),
    ("ncsa", r"ncsa", "ncsa", r"ncsa open source licen[cs]e|university of illinois ncsa"),
    ("ms-pl", r"ms-pl", "microsoft public", r"microsoft public licen[cs]e"),
    ("ms-rl", r"ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e"),
    ("wtfpl", r"wtfpl", "wtfpl|do what the", r"wtfpl|do what the f\w+ you want to public licen[cs]e"),
    ("unlicense", r"unlicense", "unlicense", r"the unlicense|unlicense\.org"),
    ("ofl-1.1", r"ofl-1\.1", "ofl|open font", rf"(?:sil )?open font licen[cs]e(?:{VERSION}1\.1)?"),
    ("odbl-1.0", r"odbl-1\.0", "odbl|open database", rf"open database licen[cs]e(?:{VERSION}1\.0)?|odbl"),
    ("odc-by-1.0", r"odc-by-1\.0", "open data commons", rf"open data commons attribution licen[cs]e(?:{VERSION}1\.0)?"),
    ("pddl-1.0", r"pddl-1\.0", "pddl|public domain dedication and", r"public domain dedication and licen[cs]e|pddl"),
    ("cc0-1.0", r"cc0-1\.0", "cc0|creative commons zero", rf"cc0(?:{VERSION}1\.0)?|creative commons zero"),
    ("upl-1.0", r"upl-1\.0", "universal permissive", rf"universal permissive licen[cs]e(?:{VERSION}1\.0)?"),
    ("afl-3.0", r"afl-3\.0", "academic free", rf"academic free licen[cs]e(?:{VERSION}[123]\.\d)?"),
    ("osl-3.0", r"osl-3\.0", "open software licen", rf"open software licen[cs]e(?:{VERSION}[123]\.\d)?"),
    ("ecl-2.0", r"ecl-2\.0", "educational community", rf"educational community licen[cs]e(?:{VERSION}2\.0)?"),
    ("blueoak-1.0.0", r"blueoak-1\.0\.0", "blue oak", rf"blue oak model licen[cs]e(?:{VERSION}1\.0\.0)?"),
    ("llama-community", r"llama-?[23](?:\.\d)?", "community licen", r"llama [23](?:\.\d)? community licen[cs]e(?: agreement)?"),
    ("openrail-m", r"openrail(?:\+\+)?(?:-m)?", "openrail|open rail", r"(?:creativeml )?open ?rail(?:\+\+)? ?m? licen[cs]e"),
]

#: Creative Commons: every element set in every version, by rule.
CC_SETS = {"by": "attribution", "by-sa": "attribution sharealike", "by-nd": "attribution noderiv(?:ative)?s", "by-nc": "attribution noncommercial", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderiv(?:ative)?s"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: kind: (priority, confidence, template of the name pattern)
TEMPLATES = {
    "tag": (100, 0.99, r"spdx[\s-]licen[cs]e[\s-]identifier\s*:\s*\(?(?:[\w.+-]+\s+(?:or|and|with)\s+)*(?:{spdx})(?![\w.+-])"),
    "grant": (80, 0.95, rf"(?:licen[cs]ed|released|distributed|redistributed|available|published|provided|covered|governed|offered)(?:{GAP}[^\W_]{{1,12}}){{0,3}}?{GAP}(?:under|by){GAP}(?:(?:the|an?|terms|of|and|conditions|free){GAP}){{0,7}}(?:{{name}})"),
    "header": (60, 0.9, rf"licen[cs]e\s*[:=]\s*[\"'(]*(?:the\s+)?(?:{{name}}|{{spdx}})(?![\w+-])"),
    "name": (40, 0.7, r"(?<![\w-])(?:{name})(?![\w-])"),
}

#: Fixed values: (label, keyword, sentence of the notice; a blank stands for GAP).
NOTICES = [
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "software is provided", r"the software is provided as is without warranty of any kind express or implied"),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-2.0", "apache.org/licenses", r"https?:\/\/www\.apache\.org\/licenses\/license-2\.0"),
    ("apache-2.0", "you may not use this file", r"you may not use this file except in compliance with the licen[cs]e"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name", r"neither the name of .{1,80}? nor the names of (?:its|the) contributors"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software"),
    ("gpl", "free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", "received a copy", r"you should have received a copy of the gnu general public licen[cs]e"),
    ("lgpl", "received a copy", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl", "received a copy", r"you should have received a copy of the gnu affero general public licen[cs]e"),
    ("gpl", "gnu.org/licenses", r"https?:\/\/www\.gnu\.org\/licenses\/(?:old-licenses\/)?gpl"),
    ("lgpl", "gnu.org/licenses", r"https?:\/\/www\.gnu\.org\/licenses\/(?:old-licenses\/)?lgpl"),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl-2.0", "mozilla.org/mpl", r"https?:\/\/(?:www\.)?mozilla\.org\/mpl\/2\.0"),
    ("mit", "opensource.org/licenses", r"https?:\/\/opensource\.org\/licenses\/mit"),
    ("bsl-1.0", "boost.org/license", r"https?:\/\/www\.boost\.org\/license_1_0"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", r"(?:placed|released|dedicated|is|are) (?:in|into|to) the public domain"),
    ("wtfpl", "wtfpl.net", r"https?:\/\/www\.wtfpl\.net"),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such"),
    ("mit", "substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "deal in the software", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("mit", "dealings in the software", r"out of or in connection with the software or the use or other dealings in the software"),
    ("x11", "promote the sale", r"shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("isc", "special direct indirect", r"in no event shall the author be liable for any special direct indirect or consequential damages"),
    ("isc", "disclaims all warranties", r"the author disclaims all warranties with regard to this software including all implied warranties"),
    ("bsd", "source code must retain", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "endorse or promote", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "substitute goods", r"procurement of substitute goods or services loss of use data or profits or business interruption"),
    ("bsd-4-clause", "product includes software", r"this product includes software developed by the university of california"),
    ("bsd-2-clause", "views and conclusions", r"the views and conclusions contained in the software and documentation are those of the authors"),
    ("apache-2.0", "as is basis", r"distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2.0", "limitations under the", r"see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e"),
    ("apache-2.0", "perpetual worldwide", r"perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e"),
    ("apache-2.0", "contributor license", r"licensed to the apache software foundation under one or more contributor license agreements"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("gpl", "hope that it will be useful", r"distributed in the hope that it will be useful but without any warranty without even the implied warranty"),
    ("gpl", "any later version", r"either version [123](?:\.0)? of the licen[cs]e or at your option any later version"),
    ("gpl-2.0", "temple place", r"59 temple place suite 330 boston ma"),
    ("gpl-2.0", "51 franklin", r"51 franklin st(?:reet)? fifth floor boston ma"),
    ("gpl", "guarantee your freedom", r"intended to guarantee your freedom to share and change"),
    ("gpl-3.0", "propagate or modify", r"you may not propagate or modify a covered work except as expressly provided"),
    ("gpl-2.0", "verbatim copies of the program", r"you may copy and distribute verbatim copies of the program s source code"),
    ("lgpl", "linking with the library|uses the library", r"work that uses the library|linking with the library"),
    ("lgpl", "free software", r"this library is free software you can redistribute it and or modify it under the terms of the gnu"),
    ("agpl-3.0", "remotely through a computer network", r"users interacting with it remotely through a computer network"),
    ("gfdl-1.3", "invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("gpl-exception-classpath", "special exception", r"as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("gpl-exception-gcc", "runtime library exception", r"gcc runtime library exception"),
    ("gpl-exception-font", "uses this font", r"as a special exception if you create a document which uses this font"),
    ("mpl-2.0", "incompatible with secondary", r"this source code form is incompatible with secondary licen[cs]es"),
    ("mpl-1.1", "initial developer of the original code", r"the initial developer of the original code is"),
    ("mpl-1.1", "contents of this file", r"the contents of this file are subject to the mozilla public licen[cs]e version 1\.1"),
    ("cddl-1.0", "contents of this file", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("cddl-1.0", "opensolaris.org", r"https?:\/\/(?:www\.)?opensolaris\.org\/os\/licensing"),
    ("epl-2.0", "eclipse.org/legal", r"https?:\/\/(?:www\.)?eclipse\.org\/legal\/epl-(?:2\.0|v20)"),
    ("epl-1.0", "eclipse.org/legal", r"https?:\/\/(?:www\.)?eclipse\.org\/legal\/epl-v10"),
    ("epl-1.0", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v1\.0"),
    ("epl-2.0", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e 2\.0"),
    ("bsl-1.0", "machine executable object code", r"machine executable object code generated by a source language processor"),
    ("zlib", "origin of this software", r"the origin of this software must not be misrepresented"),
    ("zlib", "as is without any express", r"provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", "unlicense.org", r"https?:\/\/unlicense\.org"),
    ("unlicense", "publish use compile", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0-1.0", "creativecommons.org/publicdomain", r"https?:\/\/creativecommons\.org\/publicdomain\/zero\/1\.0"),
    ("cc0-1.0", "neighboring rights", r"waived all copyright and related (?:or|and) neighboring rights"),
    ("cc-by-4.0", "creativecommons.org/licenses", r"https?:\/\/creativecommons\.org\/licenses\/by\/4\.0"),
    ("cc-by-sa-4.0", "creativecommons.org/licenses", r"https?:\/\/creativecommons\.org\/licenses\/by-sa\/4\.0"),
    ("cc-by-nc-4.0", "creativecommons.org/licenses", r"https?:\/\/creativecommons\.org\/licenses\/by-nc\/4\.0"),
    ("cc-by-nd-4.0", "creativecommons.org/licenses", r"https?:\/\/creativecommons\.org\/licenses\/by-nd\/4\.0"),
    ("cc-by-nc-sa-4.0", "creativecommons.org/licenses", r"https?:\/\/creativecommons\.org\/licenses\/by-nc-sa\/4\.0"),
    ("cc-by-nc-nd-4.0", "creativecommons.org/licenses", r"https?:\/\/creativecommons\.org\/licenses\/by-nc-nd\/4\.0"),
    ("cc-by-3.0", "creativecommons.org/licenses", r"https?:\/\/creativecommons\.org\/licenses\/by\/3\.0"),
    ("cc-by-sa-3.0", "creativecommons.org/licenses", r"https?:\/\/creativecommons\.org\/licenses\/by-sa\/3\.0"),
    ("ofl-1.1", "reserved font name", r"with reserved font names?"),
    ("ofl-1.1", "scripts.sil.org", r"https?:\/\/scripts\.sil\.org\/ofl"),
    ("openssl", "openssl project", r"this product includes software developed by the openssl project"),
    ("openssl", "ssleay|eric young", r"redistribution and use of ssleay|this product includes cryptographic software written by eric young"),
    ("php-3.01", "php software freely available", r"this product includes php software freely available from"),
    ("psf-2.0", "psf is making", r"psf is making python available to licensee on an as is basis"),
    ("postgresql", "university of california", r"in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("artistic-2.0", "perl foundation", r"the artistic licen[cs]e 2\.0 copyright the perl foundation"),
    ("artistic-1.0", "perl itself", r"under the same terms as perl itself"),
    ("ncsa", "deal with the software", r"to deal with the software without restriction"),
    ("eupl-1.2", "eupl", r"licensed under the eupl(?: version 1\.[12])?"),
    ("beerware", "buy me a beer|beer ware", r"you can buy me a beer in return|beer ware licen[cs]e"),
    ("json", "good, not evil", r"the software shall be used for good not evil"),
    ("vim", "vim licen", r"(?:the )?vim licen[cs]e"),
    ("fair", "usage of the works", r"usage of the works is permitted provided that this instrument is retained"),
    ("mulan-psl-2.0", "mulan", r"mulan psl v2|mulan permissive software licen[cs]e"),
    ("commercial", "without the express|without the prior", r"without the (?:express|prior) written (?:permission|consent) of"),
    ("freeware", "freeware", r"(?:this (?:software|program) is|distributed as) freeware"),
    ("non-commercial", "non commercial", r"(?:for|free for) non commercial (?:use|purposes) only"),
    ("research-only", "research purposes|academic purposes", r"for (?:academic|research) purposes only"),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved"),
    ("proprietary", "confidential", r"proprietary and confidential|confidential and proprietary"),
    ("copyright-notice", "copyright", r"copyright (?:\(c\)|©)? ?(?:19|20)\d\d"),
]


#: Labels of notices that say little about the terms.
WEAK = frozenset(("copyright-notice", "all-rights-reserved", "proprietary", "public-domain", "commercial", "freeware", "non-commercial", "research-only"))


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keywords: tuple[str, ...]
    priority: int
    confidence: float
    regex: re.Pattern


def _gaps(pattern: str) -> str:
    """Blanks as gaps; one that may be absent as a gap that may."""
    return pattern.replace(" ?", f"(?:{GAP})?").replace(" ", GAP)


_FOLDED = {ord(c): " " for c in MARKS}


def fold(text: str) -> str:
    """Every run of what GAP allows as one blank."""
    return " ".join(text.translate(_FOLDED).split())


def _spdx_keys(pattern: str) -> tuple[str, ...]:
    """What each alternative of an SPDX pattern begins with."""
    out = []
    for part in re.sub(r"\([^()]*\)\??", "", pattern).split("|"):
        plain = re.match(r"(?:[a-z0-9-](?!\?)|\\\.)+", part)
        out.append(fold(plain[0].replace("\\", "")))
    return tuple(out)


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first."""
    families = list(FAMILIES)
    for elements, words in CC_SETS.items():
        dashed = elements.replace("-", r"[\s-]+")
        for v in CC_VERSIONS:
            num = v.replace(".", r"\.")
            name = rf"cc[\s-]+{dashed}{VERSION}[\s-]*{num}|creative commons {words} {num}(?: international| unported| generic)?|creative commons {words}(?: international| unported| generic) {num}"
            families.append((f"cc-{elements}-{v}", rf"cc-{elements}-{num}", "cc|creative commons", name))
    out = []
    for label, spdx, keyword, name in families:
        for kind, (priority, confidence, template) in TEMPLATES.items():
            body = template.replace("{spdx}", spdx).replace("{name}", _gaps(name)).replace("{{", "{").replace("}}", "}")
            keys = ("spdx",) if kind == "tag" else tuple(keyword.split("|")) + (_spdx_keys(spdx) if kind == "header" else ())
            out.append(Rule(f"{label}/{kind}", label, keys, priority, confidence, re.compile(body)))
    for k, (label, keyword, sentence) in enumerate(NOTICES):
        weak = label in WEAK
        out.append(Rule(f"{label}/notice-{k}", label, tuple(keyword.split("|")), 30 if weak else 90, 0.3 if weak else 0.97, re.compile(_gaps(sentence))))
    return tuple(sorted(out, key=lambda r: (-r.priority, r.name)))


@functools.cache
def automaton():
    """Aho-Corasick automaton from keyword to the numbers of its rules."""
    import ahocorasick

    by_key: dict[str, list[int]] = {}
    for k, rule in enumerate(rules()):
        for key in {fold(key) for key in rule.keywords}:
            by_key.setdefault(key, []).append(k)
    a = ahocorasick.Automaton()
    for key, numbers in by_key.items():
        a.add_word(key, tuple(numbers))
    a.make_automaton()
    return a


def gate(text: str) -> set[int]:
    """Numbers of the rules whose keyword occurs; a blank in a keyword may be anything that GAP allows."""
    active: set[int] = set()
    for _, numbers in automaton().iter(fold(text)):
        active.update(numbers)
    return active


class Accepted:
    """Accepted intervals; tells in logarithmic time whether one of them holds another."""

    def __init__(self, starts: list[int]) -> None:
        self.starts = sorted(set(starts))
        self.far = [-1] * (len(self.starts) + 1)  # Fenwick tree: the farthest end over intervals that start up to here

    def hold(self, start: int, end: int) -> bool:
        k, far = bisect.bisect_right(self.starts, start), -1
        while k:
            far = max(far, self.far[k])
            k &= k - 1
        return far >= end

    def add(self, start: int, end: int) -> None:
        k = bisect.bisect_left(self.starts, start) + 1
        while k < len(self.far):
            self.far[k] = max(self.far[k], end)
            k += k & -k


def detect(text: str, active: Iterable[int] | None = None) -> list[tuple[int, int, Rule]]:
    """Accepted detections (start, end, rule) of a lower-cased text, in text order; by the gate's rules unless told by which."""
    found = []
    for k in sorted(gate(text) if active is None else active):
        rule = rules()[k]
        found += [(m.start(), m.end(), rule) for m in rule.regex.finditer(text) if m.end() > m.start()]
    found.sort(key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].name))
    accepted = Accepted([start for start, _, _ in found])
    kept: list[tuple[int, int, Rule]] = []
    for start, end, rule in found:
        if not accepted.hold(start, end):
            accepted.add(start, end)
            kept.append((start, end, rule))
    return sorted(kept, key=lambda d: (d[0], d[1], d[2].name))


def base_places(data: bytes) -> tuple[int, list[tuple[int, str]]]:
    """(number of words, places (word number, label)) of the base phrases."""
    words = data.split()
    if b"license" not in data:
        return len(words), []
    flat = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in BASE_PHRASES.items():
        needle = b" " + phrase + b" "
        at = flat.find(needle)
        seen = before = 0
        while at >= 0:
            seen += flat.count(b" ", before, at)
            before = at
            out.append((seen, label))
            at = flat.find(needle, at + 1)
    return len(words), sorted(out)


def scan_text(text: str | None) -> dict:
    data = to_bytes(text)
    n_words, base = base_places(data.translate(WORD_TABLE))
    low = data.translate(LOWER_TABLE).decode("utf-8", "replace")
    hits = detect(low)
    base_labels = sorted({x for _, x in base})
    labels = sorted({*base_labels, *(r.label for _, _, r in hits)})
    miss = 1.0
    for confidence in [0.7] * len(base_labels) + [r.confidence for _, _, r in hits]:
        miss *= 1 - confidence
    return {
        "n_words": n_words,
        "n_base": len(base),
        "first_word": base[0][0] if base else None,
        "last_word": base[-1][0] if base else None,
        "base_labels": ",".join(base_labels),
        "labels": ",".join(labels),
        "score": round(1 - miss, 6),
        "detections": [{"start": s, "end": e, "label": r.label, "rule": r.name} for s, e, r in hits],
    }


SCHEMA = "doc_id string, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:int,end:int,label:string,rule:string>>"


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: base places, labels, score and the detections (spans in code points).

    Null and empty texts have no words, no labels and score 0; ids keep their
    type, null ids and repeated rows are kept; an empty table gives no rows; very
    long texts are scanned whole; other columns are ignored.  Where detections
    overlap without one holding the other, both stand.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [scan_text(t) for t in batch["text"].tolist()]
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    bounded_batches(docs.sparkSession)
    out = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, SCHEMA)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.select(id_col).schema[0].dataType))
