"""License scan by ordered signature rules.

A text becomes its words (ASCII letters in lower case, digits and characters
beyond ASCII). Each rule is a regular expression over the words joined by one
space, with keywords of which every match contains one, so that the expression
is tried only where one is among the text's words, a priority (its place in the list) and a label. Of
overlapping detections, one that lies within a longer one's interval is
suppressed; of those that overlap in part, the one of higher priority stays.
Base phrases are counted on their own and stay.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import as_bytes, map_arrow

#: Bytes that separate words become spaces, A-Z become a-z.
_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))

BASE = (
    (b"under the mit license", "mit"),
    (b"apache license version 2", "apache-2"),
    (b"cc by nc", "cc-by-nc"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[bytes, ...]
    pattern: re.Pattern
    priority: int  # smaller wins
    weight: float


#: Signatures in order of priority within a label: label | keywords, of which every match has one | expression over words | weight of a detection.
#: Written by hand from the licences' own titles and grant sentences.
SIGNATURES = r"""
mit | mit | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?mit licen[sc]e | 1.0
mit | mit | the mit licen[sc]e(?: mit)? | 0.9
mit | mit | mit licen[sc]ed? | 0.8
mit | mit | spdx license identifier mit(?! \d) | 1.0
mit | permission | permission is hereby granted free of charge to any person obtaining a copy of this software | 1.0
mit | furnished | to permit persons to whom the software is furnished to do so | 0.9
mit | x11 | x11 licen[sc]e | 0.7
mit | expat | expat licen[sc]e | 0.9
mit | opensource | opensource org licen[sc]es mit(?: license)? | 1.0
mit-0 | attribution | mit no attribution(?: licen[sc]e)? | 1.0
mit-0 | mit | mit 0(?: licen[sc]e)? | 0.8
apache-2 | apache | (?:licensed|released|distributed) under (?:the )?apache licen[sc]e(?: version)? 2(?: 0)? | 1.0
apache-2 | apache | apache licen[sc]e version 2(?: 0)?(?: january 2004)? | 1.0
apache-2 | apache | apache (?:software )?licen[sc]e (?:v ?)?2(?: 0)? | 0.9
apache-2 | apache | apache 2(?: 0)?(?: licen[sc]ed?)? | 0.7
apache-2 | apache | spdx license identifier apache 2 0 | 1.0
apache-2 | apache | www apache org licen[sc]es license 2 0 | 1.0
apache-2 | asl | asl 2 0 | 0.6
apache-2 | warranties | distributed on an as is basis without warranties or conditions of any kind | 0.9
apache-1.1 | apache | apache (?:software )?licen[sc]e (?:version |v ?)?1 1 | 1.0
apache-1.0 | apache | apache (?:software )?licen[sc]e (?:version |v ?)?1 0 | 1.0
apache | apache | (?:the )?apache licen[sc]e | 0.6
gpl-1 | gnu | gnu general public licen[sc]e (?:as published by the free software foundation )?version 1 | 1.0
gpl-1 | gpl gplv1 gpl1 | gpl ?v?1(?: 0)?(?: only| or later)? | 0.8
gpl-2 | gnu | gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version|v) ?2 | 1.0
gpl-2 | gplv2 | gplv2(?: only| or later)? | 0.9
gpl-2 | gpl | gpl (?:version |v ?)?2(?: 0)?(?: only| or later)? | 0.9
gpl-2 | gpl | spdx license identifier gpl 2 0(?: only| or later)? | 1.0
gpl-2 | licenses | www gnu org licen[sc]es old licenses gpl 2 0 | 1.0
gpl-3 | gnu | gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version|v) ?3 | 1.0
gpl-3 | gplv3 | gplv3(?: only| or later)? | 0.9
gpl-3 | gpl | gpl (?:version |v ?)?3(?: 0)?(?: only| or later)? | 0.9
gpl-3 | gpl | spdx license identifier gpl 3 0(?: only| or later)? | 1.0
gpl-3 | gnu | www gnu org licen[sc]es gpl 3 0 | 1.0
gpl | gnu | gnu general public licen[sc]e | 0.8
gpl | gnu | gnu gpl | 0.8
gpl | gpl | (?:licensed|released|distributed) under (?:the )?(?:terms of the )?gpl | 0.7
gpl | redistribute | free software you can redistribute it and or modify it under the terms of the gnu general public | 0.9
gpl | gnu | www gnu org licen[sc]es gpl | 0.8
gpl-classpath | classpath | (?:gpl|general public licen[sc]e) (?:version |v ?)?2? ?(?:0 )?with (?:the )?classpath exception | 1.0
gpl-classpath | classpath | classpath exception 2 0 | 0.9
gpl-linking | linking | gpl linking exception | 0.8
lgpl-2 | library | gnu library general public licen[sc]e(?: version 2)? | 1.0
lgpl-2 | lgpl | lgpl (?:version |v ?)?2(?: 0)?(?! 1)(?: only| or later)? | 0.9
lgpl-2.1 | lesser | gnu lesser general public licen[sc]e (?:as published by the free software foundation )?(?:either )?version 2 1 | 1.0
lgpl-2.1 | lgpl | lgpl (?:version |v ?)?2 1(?: only| or later)? | 0.9
lgpl-2.1 | lgplv2 | lgplv2 1 | 0.9
lgpl-2.1 | lgpl | spdx license identifier lgpl 2 1(?: only| or later)? | 1.0
lgpl-3 | lesser | gnu lesser general public licen[sc]e (?:as published by the free software foundation )?(?:either )?version 3 | 1.0
lgpl-3 | lgplv3 | lgplv3 | 0.9
lgpl-3 | lgpl | lgpl (?:version |v ?)?3(?: 0)?(?: only| or later)? | 0.9
lgpl-3 | lgpl | spdx license identifier lgpl 3 0(?: only| or later)? | 1.0
lgpl | lesser | gnu lesser general public licen[sc]e | 0.8
lgpl | lgpl | (?:gnu |the )lgpl | 0.7
agpl-3 | affero | gnu affero general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version|v) ?3 | 1.0
agpl-3 | agplv3 | agplv3 | 0.9
agpl-3 | agpl | agpl (?:version |v ?)?3(?: 0)?(?: only| or later)? | 0.9
agpl-3 | agpl | spdx license identifier agpl 3 0(?: only| or later)? | 1.0
agpl-1 | affero | affero general public licen[sc]e version 1 | 0.9
agpl | affero | (?:gnu )?affero general public licen[sc]e | 0.8
agpl | agpl | gnu agpl | 0.8
bsd-2 | clause | bsd 2 clause(?: simplified)?(?: licen[sc]e)? | 1.0
bsd-2 | clause | (?:2|two) clause bsd(?: licen[sc]e)? | 1.0
bsd-2 | simplified | simplified bsd licen[sc]e | 0.9
bsd-2 | freebsd | freebsd licen[sc]e | 0.8
bsd-2 | spdx | spdx license identifier bsd 2 clause | 1.0
bsd-3 | clause | bsd 3 clause(?: new| revised)?(?: or revised)?(?: licen[sc]e)? | 1.0
bsd-3 | clause | (?:3|three) clause bsd(?: licen[sc]e)? | 1.0
bsd-3 | bsd | (?:new|modified|revised) bsd licen[sc]e | 0.9
bsd-3 | spdx | spdx license identifier bsd 3 clause | 1.0
bsd-3 | endorse | may be used to endorse or promote products derived from this software without specific prior written permission | 0.9
bsd-4 | clause | (?:bsd 4 clause|(?:4|four) clause bsd)(?: licen[sc]e)? | 1.0
bsd-4 | original | original bsd licen[sc]e | 0.9
bsd-4 | advertising | all advertising materials mentioning features or use of this software must display | 0.9
bsd-0 | clause | (?:bsd zero clause|zero clause bsd)(?: licen[sc]e)? | 1.0
bsd-0 | 0bsd | 0bsd | 0.9
bsd | bsd | bsd(?: style)? licen[sc]ed? | 0.7
bsd | bsd | (?:licensed|released|distributed) under (?:a |the )?bsd | 0.7
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted | 0.9
isc | isc | (?:the )?isc licen[sc]e | 0.9
isc | isc | spdx license identifier isc | 1.0
isc | purpose | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted | 0.9
zlib | zlib | zlib(?: libpng)? licen[sc]e | 0.9
zlib | misrepresented | the origin of this software must not be misrepresented | 0.9
libpng | libpng | libpng licen[sc]e(?: version 2)? | 0.9
unlicense | unlicense | (?:the )?unlicense | 0.9
unlicense | unencumbered | this is free and unencumbered software released into the public domain | 1.0
wtfpl | wtfpl | wtfpl(?: version 2)? | 0.9
wtfpl | public | do what the fuck you want to public licen[sc]e | 1.0
boost-1 | boost | boost software licen[sc]e(?: version 1(?: 0)?)? | 1.0
boost-1 | bsl | spdx license identifier bsl 1 0 | 1.0
mpl-1.0 | mozilla | mozilla public licen[sc]e (?:version |v ?)?1 0 | 1.0
mpl-1.1 | mozilla | mozilla public licen[sc]e (?:version |v ?)?1 1 | 1.0
mpl-1.1 | mpl | mpl (?:version |v ?)?1 1 | 0.9
mpl-2.0 | mozilla | mozilla public licen[sc]e (?:version |v ?)?2 0 | 1.0
mpl-2.0 | mpl | mpl (?:version |v ?)?2 0 | 0.9
mpl-2.0 | mozilla | mozilla org mpl 2 0 | 1.0
mpl | mozilla | mozilla public licen[sc]e | 0.8
epl-1.0 | eclipse | eclipse public licen[sc]e (?:version |v ?)?1 0 | 1.0
epl-1.0 | epl | epl (?:version |v ?)?1 0 | 0.9
epl-2.0 | eclipse | eclipse public licen[sc]e (?:version |v ?)?2 0 | 1.0
epl-2.0 | epl | epl (?:version |v ?)?2 0 | 0.9
epl | eclipse | eclipse public licen[sc]e | 0.8
edl-1.0 | eclipse | eclipse distribution licen[sc]e(?: v1 0|(?: v| version)?(?: 1 0)?) | 0.9
cddl-1.0 | cddl | cddl (?:version |v ?)?1 0 | 0.9
cddl-1.0 | distribution | common development and distribution licen[sc]e (?:version |v ?)?1 0 | 1.0
cddl-1.1 | distribution | common development and distribution licen[sc]e (?:version |v ?)?1 1 | 1.0
cddl | distribution | common development and distribution licen[sc]e | 0.8
cpl-1.0 | common | common public licen[sc]e(?: version 1 0)? | 0.9
cpal-1.0 | attribution | common public attribution licen[sc]e(?: version 1 0)? | 0.9
ipl-1.0 | ibm | ibm public licen[sc]e(?: version 1 0)? | 0.9
osl-3.0 | open | open software licen[sc]e (?:version |v ?)?3 0 | 0.9
osl-2.1 | open | open software licen[sc]e (?:version |v ?)?2 1 | 0.9
afl-3.0 | academic | academic free licen[sc]e (?:version |v ?)?3 0 | 0.9
afl-2.1 | academic | academic free licen[sc]e (?:version |v ?)?2 1 | 0.9
artistic-1.0 | artistic | artistic licen[sc]e (?:version |v ?)?1 0 | 0.9
artistic-2.0 | artistic | artistic licen[sc]e (?:version |v ?)?2 0 | 0.9
artistic | artistic | (?:the |perl )artistic licen[sc]e | 0.7
perl | perl | same terms as perl(?: itself)? | 0.9
psf-2.0 | python | python software foundation licen[sc]e(?: version 2)? | 0.9
psf-2.0 | psf | psf licen[sc]e(?: agreement)? | 0.8
python-cnri | cnri | cnri (?:open source )?licen[sc]e | 0.8
php-3.01 | php | php licen[sc]e(?: version)? 3 01 | 0.9
php | php | the php licen[sc]e | 0.8
ruby | ruby | (?:same terms as ruby|ruby licen[sc]e) | 0.8
zpl-2.1 | zope | zope public licen[sc]e(?: version)? 2 1 | 0.9
zpl | zope | zope public licen[sc]e | 0.8
w3c | w3c | w3c software (?:notice and |and document )?(?:notice and )?licen[sc]e | 0.9
openssl | openssl | openssl licen[sc]e | 0.8
ssleay | ssleay | (?:original )?ssleay licen[sc]e | 0.8
curl | curl | curl licen[sc]e | 0.7
icu | icu | icu licen[sc]e | 0.7
unicode | unicode | unicode (?:data files and software |inc )?licen[sc]e(?: agreement)? | 0.8
ncsa | illinois | university of illinois ncsa open source licen[sc]e | 1.0
ncsa | ncsa | ncsa licen[sc]e | 0.8
ofl-1.1 | sil | sil open font licen[sc]e(?: version 1 1)? | 1.0
ofl-1.1 | ofl | ofl (?:version |v ?)?1 1 | 0.9
ofl-1.0 | sil | sil open font licen[sc]e version 1 0 | 1.0
eupl-1.1 | union | european union public licen[sc]e (?:version |v ?)?1 1 | 1.0
eupl-1.1 | eupl | eupl (?:version |v ?)?1 1 | 0.9
eupl-1.2 | union | european union public licen[sc]e (?:version |v ?)?1 2 | 1.0
eupl-1.2 | eupl | eupl (?:version |v ?)?1 2 | 0.9
eupl | union | european union public licen[sc]e | 0.8
cecill-2.1 | cecill | cecill (?:free software licen[sc]e agreement )?(?:version |v ?)?2 1 | 0.9
cecill-b | cecill | cecill b | 0.9
cecill-c | cecill | cecill c | 0.9
cecill | cecill | (?:licence |license )cecill | 0.8
ms-pl | microsoft | microsoft public licen[sc]e | 0.9
ms-pl | ms | ms pl | 0.7
ms-rl | microsoft | microsoft reciprocal licen[sc]e | 0.9
ecl-2.0 | educational | educational community licen[sc]e(?: version 2 0)? | 0.9
upl-1.0 | universal | universal permissive licen[sc]e(?: v1 0|(?: v| version)?(?: 1 0)?) | 0.9
mulan-2.0 | mulan | mulan psl(?: v2| 2 0)? | 0.9
postgresql | postgresql | postgresql licen[sc]e | 0.9
vim | vim | vim licen[sc]e | 0.8
tcl | tcl | tcl(?: tk)? licen[sc]e | 0.7
json | evil | shall be used for good not evil | 1.0
beerware | beerware beer | beer ?ware licen[sc]e | 0.9
beerware | beer | the beer ware licen[sc]e(?: revision 42)? | 0.9
sleepycat | sleepycat | sleepycat licen[sc]e | 0.9
qpl-1.0 | q | q public licen[sc]e(?: version 1 0)? | 0.9
npl-1.1 | netscape | netscape public licen[sc]e(?: version 1 1)? | 0.9
spl-1.0 | sun | sun public licen[sc]e(?: version 1 0)? | 0.9
apsl-2.0 | apple | apple public source licen[sc]e(?: version)?(?: 2 0)? | 0.9
rpl-1.5 | reciprocal | reciprocal public licen[sc]e(?: version)?(?: 1 5)? | 0.9
sissl | sun | sun industry standards source licen[sc]e | 0.9
bsl-1.1 | business | business source licen[sc]e(?: version)?(?: 1 1)? | 0.9
sspl-1 | server | server side public licen[sc]e(?: version)?(?: 1)? | 1.0
sspl-1 | sspl | sspl(?: v?1)? | 0.8
elastic-2.0 | elastic | elastic licen[sc]e (?:version |v ?)?2(?: 0)? | 0.9
commons-clause | commons | commons clause(?: licen[sc]e)?(?: condition)? | 0.9
polyform-nc | polyform | polyform noncommercial licen[sc]e | 0.9
polyform-sb | polyform | polyform small business licen[sc]e | 0.9
parity | parity | parity public licen[sc]e | 0.9
hippocratic | hippocratic | hippocratic licen[sc]e | 0.9
blueoak-1.0.0 | oak | blue oak model licen[sc]e | 0.9
openrail | openrail rail | (?:creativeml |bigscience )?open ?rail(?: m)? | 0.8
rail | responsible | responsible ai licen[sc]e | 0.8
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)? | 1.0
cc0-1.0 | zero | creative commons zero(?: v1 0 universal)? | 1.0
cc0-1.0 | publicdomain | creativecommons org publicdomain zero 1 0 | 1.0
cc-pdm | publicdomain | creativecommons org publicdomain mark 1 0 | 1.0
cc-by-nc-nd | cc | cc by nc nd(?: [1-4] [05])? | 1.0
cc-by-nc-nd | noderivatives noderivative derivatives derivative | (?:creative commons )?attribution non ?commercial no ?derivatives?(?: works)?(?: [1-4] [05])? | 1.0
cc-by-nc-nd | noderivs derivs | (?:creative commons )?attribution non ?commercial no ?derivs(?: [1-4] [05])? | 1.0
cc-by-nc-nd | creativecommons | creativecommons org licen[sc]es by nc nd | 1.0
cc-by-nc-sa | cc | cc by nc sa(?: [1-4] [05])? | 1.0
cc-by-nc-sa | sharealike alike | (?:creative commons )?attribution non ?commercial share ?alike(?: [1-4] [05])? | 1.0
cc-by-nc-sa | creativecommons | creativecommons org licen[sc]es by nc sa | 1.0
cc-by-nc | cc | cc by nc(?: [1-4] [05])? | 1.0
cc-by-nc | noncommercial | (?:creative commons )?attribution noncommercial(?: [1-4] [05])?(?: international)? | 1.0
cc-by-nc | commercial | (?:creative commons )?attribution non commercial(?: [1-4] [05])?(?: international)? | 1.0
cc-by-nc | creativecommons | creativecommons org licen[sc]es by nc | 1.0
cc-by-nd | cc | cc by nd(?: [1-4] [05])? | 1.0
cc-by-nd | noderivatives noderivative derivatives derivative | (?:creative commons )?attribution no ?derivatives?(?: [1-4] [05])? | 1.0
cc-by-nd | creativecommons | creativecommons org licen[sc]es by nd | 1.0
cc-by-sa | cc | cc by sa(?: [1-4] [05])? | 1.0
cc-by-sa | sharealike alike | (?:creative commons )?attribution share ?alike(?: [1-4] [05])?(?: international)? | 1.0
cc-by-sa | creativecommons | creativecommons org licen[sc]es by sa | 1.0
cc-by | cc | cc by(?: [1-4] [05])? | 0.9
cc-by | creative | creative commons attribution(?: [1-4] [05])?(?: international)?(?: public)?(?: licen[sc]e)? | 0.9
cc-by | creativecommons | creativecommons org licen[sc]es by | 1.0
creative-commons | creative | creative commons(?: licen[sc]e)? | 0.5
gfdl-1.1 | documentation | gnu free documentation licen[sc]e version 1 1 | 1.0
gfdl-1.2 | documentation | gnu free documentation licen[sc]e version 1 2 | 1.0
gfdl-1.3 | documentation | gnu free documentation licen[sc]e version 1 3 | 1.0
gfdl | documentation | gnu free documentation licen[sc]e | 0.9
gfdl | gfdl | (?:gnu |the )?gfdl | 0.8
odbl-1.0 | odbl | odbl(?: 1 0)? | 0.9
odbl-1.0 | database | open (?:data commons open )?database licen[sc]e(?: v1 0|(?: v| version)?(?: 1 0)?) | 0.9
odc-by-1.0 | odc | odc by(?: 1 0)? | 0.9
odc-by-1.0 | commons | open data commons attribution licen[sc]e(?: v1 0|(?: v| version)?(?: 1 0)?) | 0.9
pddl-1.0 | dedication | (?:open data commons )?public domain dedication and licen[sc]e | 0.9
cdla-permissive | community | community data licen[sc]e agreement permissive(?: version)?(?: [12] 0)? | 0.9
cdla-sharing | community | community data licen[sc]e agreement sharing(?: version)?(?: 1 0)? | 0.9
ogl-uk-3.0 | government | open government licen[sc]e (?:v ?)?3(?: 0)? | 0.9
ogl-uk | government | open government licen[sc]e | 0.8
etalab-2.0 | etalab | etalab (?:open )?licen[sc]e(?: ouverte)?(?: 2 0)? | 0.9
dl-de-by-2.0 | datenlizenz | datenlizenz deutschland namensnennung(?: version)?(?: 2 0)? | 0.9
dl-de-zero-2.0 | datenlizenz | datenlizenz deutschland zero(?: version)?(?: 2 0)? | 0.9
fal-1.3 | libre | licence art libre(?: 1 3)? | 0.9
fal-1.3 | art | free art licen[sc]e(?: 1 3)? | 0.9
public-domain | domain | (?:released|dedicated|placed) (?:in)?to the public domain | 0.8
public-domain | domain | (?:is )?in the public domain | 0.6
public-domain | domain | public domain(?: dedication| mark)? | 0.5
all-rights-reserved | reserved | all rights reserved | 0.4
all-rights-reserved | réservés | tous droits réservés | 0.4
all-rights-reserved | vorbehalten | alle rechte vorbehalten | 0.4
all-rights-reserved | reservados | todos los derechos reservados | 0.4
proprietary | proprietary | proprietary (?:and confidential|licen[sc]e|software) | 0.7
proprietary | confidential | confidential and proprietary | 0.7
proprietary | eula | end user licen[sc]e agreement eula | 0.8
proprietary | agreement | end user licen[sc]e agreement | 0.7
proprietary | prohibited | unauthori[sz]ed (?:copying|reproduction|distribution) (?:of this (?:file|software|material) )?(?:via any medium )?is strictly prohibited | 0.9
non-commercial | commercial noncommercial | for non ?commercial (?:use|purposes) only | 0.7
non-commercial | noncommercial | noncommercial (?:use|purposes) only | 0.7
non-commercial | research | for research (?:use|purposes) only | 0.7
non-commercial | educational | for educational (?:use|purposes) only | 0.6
"""


def rules() -> list[Rule]:
    out = []
    for i, line in enumerate(x for x in SIGNATURES.strip().split("\n")):
        label, keywords, body, weight = (x.strip() for x in line.split(" | "))
        out.append(Rule(label, tuple(keywords.encode().split()), re.compile(rb"(?<= )(?:" + body.encode() + rb")(?= )"), i, float(weight)))
    return out


@dataclass(frozen=True)
class Found:
    label: str
    first: int  # words, from 0
    last: int  # after the last word
    priority: int
    weight: float


def words_of(text: bytes) -> bytes:
    """The text's words, each with a space before and after."""
    return b" " + b" ".join(text.translate(_TABLE).split()) + b" "


class Scanner:
    def __init__(self, known: list[Rule] | None = None) -> None:
        self.by_word: dict[bytes, list[Rule]] = {}
        for rule in rules() if known is None else known:
            for keyword in rule.keywords:
                self.by_word.setdefault(keyword, []).append(rule)
        alternatives = b"|".join(sorted((re.escape(w) for w in self.by_word), key=len, reverse=True))
        self.gate = re.compile(rb"(?<= )(?:" + alternatives + rb")(?= )")

    def detections(self, words: bytes) -> list[Found]:
        """Accepted detections by place; only rules of which a keyword is a word of the text are tried."""
        found: list[tuple[int, int, Rule]] = []
        for rule in {r.priority: r for k in set(self.gate.findall(words)) for r in self.by_word[k]}.values():
            found += [(*m.span(), rule) for m in rule.pattern.finditer(words)]
        if not found:
            return []
        # Containment, longest first: what lies within a longer interval goes; of equal ones the first rule stays.
        # The intervals left contain none of each other, so their ends rise with their starts and one look tells.
        found.sort(key=lambda x: (x[0] - x[1], x[2].priority, x[0]))
        starts: list[int] = []
        outer: list[tuple[int, int, Rule]] = []
        for start, end, rule in found:
            i = bisect_right(starts, start)
            if i and outer[i - 1][1] >= end:
                continue
            starts.insert(i, start)
            outer.insert(i, (start, end, rule))
        # Priority: of intervals that overlap in part, the one of the earlier rule stays.
        kept: list[tuple[int, int, Rule]] = []
        starts = []
        for start, end, rule in sorted(outer, key=lambda x: (x[2].priority, x[0])):
            i = bisect_right(starts, start)
            if (i and kept[i - 1][1] > start) or (i < len(kept) and kept[i][0] < end):
                continue
            starts.insert(i, start)
            kept.insert(i, (start, end, rule))
        out = []
        at = word = 0
        for start, end, rule in kept:
            word += words.count(b" ", at, start) if at < start else 0
            at = start
            out.append(Found(rule.label, word - 1, word + words.count(b" ", start, end), rule.priority, rule.weight))
        return out


def base_places(words: bytes) -> list[tuple[int, str]]:
    """(start word, label) of every place of a base phrase, in order."""
    out = []
    for phrase, label in BASE:
        needle = b" " + phrase + b" "
        at, word, i = 0, 0, words.find(needle)
        while i >= 0:
            word += words.count(b" ", at, i)
            at = i
            out.append((word, label))
            i = words.find(needle, i + 1)
    return sorted(out)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``, in one pass without a shuffle.

    score is the weight of the best detection, 0 without one, 1 with a base
    phrase. detections lists label:first:last in words. Null text is empty;
    repeated rows and null ids are scanned row by row; an empty table gives no
    rows. Columns other than the two named are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.string()]
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = words_of(text.as_py())
                base, found = base_places(words), scanner.detections(words)
                own = sorted({label for _, label in base})
                labels = sorted({*own, *(x.label for x in found)})
                rows.append((
                    doc_id, max(0, words.count(b" ") - 1) if len(words) > 2 else 0, len(base), base[0][0] if base else None, base[-1][0] if base else None,
                    ",".join(own), ",".join(labels), 1.0 if base else max((x.weight for x in found), default=0.0), ",".join(f"{x.label}:{x.first}:{x.last}" for x in found),
                ))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("t")).transform(map_arrow, run, SCHEMA)
