"""License scan: ordered signature rules over the words of a text.

A text becomes its words in lower case between single spaces.  Rules stand in order of priority; each has a
keyword that its signature cannot do without, and only rules whose keyword occurs in a text are run on it.  The
words that introduce a license name belong to its detection but not to its core, and only cores compete: in
'MIT License, ISC License' the first 'license' is not lost to 'license isc license'.  Of cores that overlap one
that lies within another that stays is dropped, of equal ones the rule of higher priority stays, and of those that
overlap in part the rule of higher priority.  What is dropped suppresses nothing.  Base phrases always stay.

Everything is a DataFrame expression: the scan is one projection, a window cuts one text's detections into groups
that overlap, and each group is settled in order of priority.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import ascii_lower, col, let, text_of

# What stands between words, but for lone spaces, by far the most: they stay as they are.
BETWEEN = r"[\x00-\x1F\x21-\x2F\x3A-\x60\x7B-\x7F][\x00-\x2F\x3A-\x60\x7B-\x7F]*|\x20[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` matches whole words of the text in lower case; every match holds one of the ``|``-separated
    keywords: one whole word, the beginning of one if ``*`` follows, or several words of which the last may go on.
    It also holds one of the words ``needs``, if there are any.  ``lead`` is the beginning of ``pattern`` that only
    introduces the rest."""

    label: str
    pattern: str
    keyword: str
    weight: float = 0.9
    base: bool = False
    lead: str = ""
    needs: str = ""


# The base phrases and their labels.
BASE = [Rule("cc-by", "cc by", "cc by", 0.5, True), Rule("gpl", "general public license", "general public license", 0.7, True),
        Rule("reserved", "all rights reserved", "all rights reserved", 0.3, True)]

# Names of licenses as words, most specific first: label, pattern of the name, keyword.
NAMES = [
    ("agpl-3.0", "(?:gnu )?affero general public license(?: agpl)?(?: as published by the free software foundation)?(?: either)? (?:version|v) ?3(?: 0)?", "affero"),
    ("agpl", "(?:gnu )?affero general public license|agpl(?: v?[0-9]+(?: 0)?)?", "agpl|affero"),
    ("lgpl-3.0", "(?:gnu )?lesser general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?3(?: 0)?", "lesser general"),
    ("lgpl-2.1", "(?:gnu )?lesser general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?2 1", "lesser general"),
    ("lgpl-2.0", "(?:gnu )?library general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?2(?: 0)?", "library general"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public license|lgpl(?: v?[0-9]+(?: [0-9])?)?", "lgpl|lesser general|library general"),
    ("gpl-3.0", "(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?3(?: 0)?|(?:gnu )?gpl ?(?:version |v ?)?3(?: 0)?", "gpl*|general public"),
    ("gpl-2.0", "(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?2(?: 0)?|(?:gnu )?gpl ?(?:version |v ?)?2(?: 0)?(?! clause)", "gpl*|general public"),
    ("gpl-1.0", "(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?1(?: 0)?", "general public"),
    ("apache-2.0", "apache (?:software )?(?:license|licence) (?:version |v ?)?2(?: 0)?(?! clause)|apache (?:version |v ?)?2(?: 0)?(?! clause)", "apache"),
    ("apache-1.1", "apache (?:software )?(?:license|licence) (?:version |v ?)?1 1", "apache"),
    ("apache-1.0", "apache (?:software )?(?:license|licence) (?:version |v ?)?1 0", "apache"),
    ("mit-0", "mit no attribution(?: license| licence)?|mit 0", "mit no|mit 0"),
    ("mit", "mit (?:x11 |expat )?(?:license|licence)|expat (?:license|licence)", "mit licen|mit x11|mit expat|expat"),
    ("x11", "x11 (?:license|licence)", "x11"),
    ("isc", "isc (?:license|licence)", "isc"),
    ("bsd-4-clause", "(?:bsd 4 clause|(?:4|four) clause bsd)(?: license| licence)?|original bsd (?:license|licence)", "bsd"),
    ("bsd-3-clause", "(?:bsd 3 clause|(?:3|three) clause bsd)(?: license| licence)?|(?:new|modified|revised) bsd (?:license|licence)", "bsd"),
    ("bsd-2-clause", "(?:bsd 2 clause|(?:2|two) clause bsd)(?: license| licence)?|(?:simplified|freebsd) bsd (?:license|licence)", "bsd"),
    ("bsd-1-clause", "(?:bsd 1 clause|1 clause bsd)(?: license| licence)?", "bsd"),
    ("0bsd", "(?:0bsd|bsd 0 clause|zero clause bsd)(?: license| licence)?", "0bsd|bsd 0|zero clause"),
    ("bsd", "bsd (?:style )?(?:license|licence)", "bsd"),
    ("mpl-2.0", "mozilla public (?:license|licence) (?:version |v ?)?2(?: 0)?|mpl 2(?: 0)?", "mozilla|mpl"),
    ("mpl-1.1", "mozilla public (?:license|licence) (?:version |v ?)?1 1|mpl 1 1", "mozilla|mpl"),
    ("mpl-1.0", "mozilla public (?:license|licence) (?:version |v ?)?1 0|mpl 1 0", "mozilla|mpl"),
    ("epl-2.0", "eclipse public (?:license|licence) (?:version |v ?)?2(?: 0)?|epl 2(?: 0)?", "eclipse|epl"),
    ("epl-1.0", "eclipse public (?:license|licence) (?:version |v ?)?1(?: 0)?|epl 1(?: 0)?", "eclipse|epl"),
    ("cpl-1.0", "common public (?:license|licence)(?: (?:version |v ?)?1 0)?", "common public"),
    ("cddl-1.1", "common development and distribution (?:license|licence) (?:version |v ?)?1 1", "common development"),
    ("cddl-1.0", "common development and distribution (?:license|licence)(?: (?:version |v ?)?1 0)?|cddl", "common development|cddl"),
    ("eupl-1.2", "european union public (?:license|licence) (?:version |v ?)?1 2|eupl 1 2", "european union|eupl"),
    ("eupl-1.1", "european union public (?:license|licence) (?:version |v ?)?1 1|eupl 1 1", "european union|eupl"),
    ("artistic-2.0", "artistic (?:license|licence) (?:version |v ?)?2(?: 0)?(?! clause)", "artistic"),
    ("artistic-1.0", "artistic (?:license|licence)(?: 1 0)?", "artistic"),
    ("zlib", "zlib(?: libpng)? (?:license|licence)", "zlib"),
    ("libpng", "libpng (?:license|licence)", "libpng"),
    ("bsl-1.0", "boost software (?:license|licence)(?: (?:version |v ?)?1 0)?", "boost"),
    ("unlicense", "the unlicense|unlicense (?:license|org)", "unlicense"),
    ("wtfpl", "wtfpl|do what the f[a-z]* you want to public (?:license|licence)", "wtfpl|do what the"),
    ("python-2.0", "python software foundation (?:license|licence)(?: (?:version |v ?)?2(?: 0)?)?|psf license", "python software|psf"),
    ("openssl", "openssl (?:license|licence)", "openssl"),
    ("postgresql", "postgresql (?:license|licence)", "postgresql"),
    ("ncsa", "(?:university of illinois )?ncsa open source (?:license|licence)", "ncsa"),
    ("ms-pl", "microsoft public (?:license|licence)|ms pl", "microsoft public|ms pl"),
    ("ms-rl", "microsoft reciprocal (?:license|licence)", "microsoft reciprocal"),
    ("ofl-1.1", "(?:sil )?open font (?:license|licence)(?: (?:version |v ?)?1 1)?", "open font"),
    ("osl-3.0", "open software (?:license|licence) (?:version |v ?)?3(?: 0)?", "open software"),
    ("afl-3.0", "academic free (?:license|licence) (?:version |v ?)?3(?: 0)?", "academic free"),
    ("odbl-1.0", "open database (?:license|licence)(?: 1 0)?|odbl", "open database|odbl"),
    ("odc-by-1.0", "open data commons attribution (?:license|licence)?", "open data commons"),
    ("pddl-1.0", "public domain dedication and (?:license|licence)", "public domain"),
    ("gfdl", "(?:gnu )?free documentation (?:license|licence)(?: (?:version |v ?)?1 [0-9])?", "free documentation"),
    ("upl-1.0", "universal permissive (?:license|licence)", "universal permissive"),
    ("ecl-2.0", "educational community (?:license|licence)", "educational community"),
    ("blueoak-1.0.0", "blue oak model (?:license|licence)", "blue oak"),
    ("busl-1.1", "business source (?:license|licence)", "business source"),
    ("sspl-1.0", "server side public (?:license|licence)", "server side public"),
    ("elastic-2.0", "elastic (?:license|licence)(?: 2 0)?", "elastic"),
    ("cc0-1.0", "cc0(?: 1 0)?(?: universal(?! permissive))?|creative commons zero", "cc0|creative commons"),
    ("cc-by-nc-sa", "cc by nc sa(?: [1-4] [05])?|creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", "cc by nc|creative commons"),
    ("cc-by-nc-nd", "cc by nc nd(?: [1-4] [05])?|creative commons attribution non ?commercial no ?derivatives?(?: [1-4] [05])?", "cc by nc|creative commons"),
    ("cc-by-nc", "cc by nc(?: [1-4] [05])?|creative commons attribution non ?commercial(?: [1-4] [05])?", "cc by nc|creative commons"),
    ("cc-by-nd", "cc by nd(?: [1-4] [05])?|creative commons attribution no ?derivatives?(?: [1-4] [05])?", "cc by nd|creative commons"),
    ("cc-by-sa", "cc by sa(?: [1-4] [05])?|creative commons attribution share ?alike(?: [1-4] [05])?", "cc by sa|creative commons"),
    ("cc-by-4.0", "cc by 4(?: 0)?|creative commons attribution 4(?: 0)?", "cc by 4|creative commons"),
    ("cc-by-3.0", "cc by 3(?: 0)?|creative commons attribution 3(?: 0)?", "cc by 3|creative commons"),
    ("cc-by-any", "creative commons attribution", "creative commons"),
    # Families without a version.
    ("gpl", "(?:gnu )?general public (?:license|licence)|(?:gnu )?gpl", "gpl|gnu gpl|general public"),
    ("apache", "apache (?:software )?(?:license|licence)", "apache"),
    ("mpl", "mozilla public (?:license|licence)", "mozilla"),
    ("epl", "eclipse public (?:license|licence)", "eclipse"),
    ("cddl", "common development and distribution (?:license|licence)", "common development"),
    ("eupl", "european union public (?:license|licence)|eupl", "european union|eupl"),
    ("osl", "open software (?:license|licence)", "open software"),
    ("afl", "academic free (?:license|licence)", "academic free"),
    # Less common licenses.
    ("php-3.0", "php (?:license|licence)(?: (?:version |v ?)?3(?: 0| 01)?)?", "php licen"),
    ("ruby", "ruby (?:license|licence)", "ruby licen"),
    ("vim", "vim (?:license|licence)", "vim licen"),
    ("curl", "curl (?:license|licence)", "curl licen"),
    ("w3c", "w3c software (?:notice and )?(?:license|licence)", "w3c software"),
    ("zpl-2.1", "zope public (?:license|licence)(?: (?:version |v ?)?2 [01])?", "zope public"),
    ("ipl-1.0", "ibm public (?:license|licence)(?: (?:version |v ?)?1 0)?", "ibm public"),
    ("npl-1.1", "netscape public (?:license|licence)(?: (?:version |v ?)?1 [01])?", "netscape public"),
    ("qpl-1.0", "q public (?:license|licence)(?: (?:version |v ?)?1 0)?", "q public"),
    ("apsl-2.0", "apple public source (?:license|licence)(?: (?:version |v ?)?2(?: 0)?)?", "apple public"),
    ("openldap", "openldap public (?:license|licence)", "openldap public"),
    ("sleepycat", "sleepycat (?:license|licence)", "sleepycat"),
    ("cecill", "cecill(?: [abc])?(?: (?:license|licence))?", "cecill"),
    ("beerware", "beer ?ware(?: (?:license|licence))?", "beerware|beer ware"),
    ("ftl", "freetype (?:project )?(?:license|licence)", "freetype"),
    ("rpl-1.5", "reciprocal public (?:license|licence)(?: (?:version |v ?)?1 [15])?", "reciprocal public"),
    ("ogl-uk-3.0", "open government (?:license|licence)(?: (?:version |v ?)?3(?: 0)?)?", "open government"),
    ("mulan-psl-2.0", "mulan permissive software (?:license|licence)(?: (?:version |v ?)?2)?", "mulan"),
    ("commons-clause", "commons clause(?: (?:license condition|licence condition|restriction))?", "commons clause"),
    ("polyform-noncommercial-1.0.0", "polyform noncommercial (?:license|licence)", "polyform"),
    ("lppl-1.3c", "latex project public (?:license|licence)(?: (?:version |v ?)?1 [0-3][ac]?)?", "latex project"),
]
# Names so short that they count only where a statement introduces them.
SHORT = [("mit", "mit|expat"), ("isc", "isc"), ("zlib", "zlib"), ("x11", "x11"), ("ncsa", "ncsa"), ("bsd", "bsd"), ("apache", "apache"),
         ("mpl", "mpl"), ("epl", "epl"), ("unlicense", "unlicense"), ("postgresql", "postgresql"), ("openssl", "openssl"), ("cc-by-any", "cc by"),
         ("ofl-1.1", "ofl(?: 1 1)?"), ("artistic-1.0", "artistic")]
# Identifiers of the SPDX list; "-only" and "-or-later" may follow those of the GNU family.
SPDX = """0BSD AAL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-3.0 Apache-1.0 Apache-1.1 Apache-2.0 APSL-1.0 APSL-2.0 Artistic-1.0
Artistic-1.0-Perl Artistic-2.0 Beerware BitTorrent-1.1 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause
BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-4-Clause BSD-4-Clause-UC BSD-Protection BSD-Source-Code BSL-1.0 BUSL-1.1 bzip2-1.0.6 CAL-1.0
CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-1.0 CC-BY-NC-2.0 CC-BY-NC-2.5 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-3.0
CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-PDDC
CC0-1.0 CDDL-1.0 CDDL-1.1 CDLA-Permissive-1.0 CDLA-Permissive-2.0 CDLA-Sharing-1.0 CECILL-1.0 CECILL-2.0 CECILL-2.1 CECILL-B CECILL-C
CERN-OHL-P-2.0 CERN-OHL-S-2.0 CERN-OHL-W-2.0 ClArtistic CNRI-Python CPAL-1.0 CPL-1.0 CUA-OPL-1.0 curl ECL-1.0 ECL-2.0 EFL-1.0 EFL-2.0
Elastic-2.0 Entessa EPL-1.0 EPL-2.0 EUDatagrid EUPL-1.0 EUPL-1.1 EUPL-1.2 Fair Frameworx-1.0 FSFAP FSFUL FTL GFDL-1.1 GFDL-1.2 GFDL-1.3
GPL-1.0 GPL-2.0 GPL-3.0 HPND ICU IJG ImageMagick Intel IPA IPL-1.0 ISC JasPer-2.0 JSON LAL-1.3 LGPL-2.0 LGPL-2.1 LGPL-3.0 Libpng
libpng-2.0 libtiff LiLiQ-P-1.1 LPL-1.0 LPL-1.02 LPPL-1.0 LPPL-1.2 LPPL-1.3a LPPL-1.3c MirOS MIT MIT-0 MIT-advertising MIT-CMU MIT-enna
MIT-feh MIT-Modern-Variant Motosoto MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL MulanPSL-1.0 MulanPSL-2.0 Multics
NASA-1.3 Naumen NCSA NetCDF NGPL NLOD-1.0 NLOD-2.0 Nokia NPL-1.0 NPL-1.1 NPOSL-3.0 NTP OCLC-2.0 ODbL-1.0 ODC-By-1.0 OFL-1.0 OFL-1.1
OGL-UK-1.0 OGL-UK-2.0 OGL-UK-3.0 OGTSL OLDAP-2.8 OpenSSL OSET-PL-2.1 OSL-1.0 OSL-2.0 OSL-2.1 OSL-3.0 Parity-7.0.0 PDDL-1.0 PHP-3.0
PHP-3.01 PolyForm-Noncommercial-1.0.0 PolyForm-Small-Business-1.0.0 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 RPL-1.1 RPL-1.5 RPSL-1.0 RSCPL
Ruby SimPL-2.0 SISSL Sleepycat SPL-1.0 SSPL-1.0 TCL Unicode-DFS-2015 Unicode-DFS-2016 Unlicense UPL-1.0 Vim VSL-1.0 W3C W3C-19980720
Watcom-1.0 WTFPL X11 Xnet XFree86-1.1 Xerox Zend-2.0 Zlib zlib-acknowledgement ZPL-2.0 ZPL-2.1""".split()
TAG = "spdx license identifier"
OPERAND_WORDS = 10      # what stands between two operators of an expression has at most so many words; operators are not counted


def spdx_lead(words: str) -> str:
    """What stands before an identifier: the tag, and operands with their operators up to the identifier's first place.

    An expression may have any number of operands.  Every repetition is possessive, so a text is walked once and Java
    needs no stack for it.
    """
    operand = rf"(?:(?!(?:or|and|with|spdx) )[^ ]+ ){{1,{OPERAND_WORDS}}}+"
    return rf"{TAG} (?:(?!{words} ){operand}(?:or|and|with) )*+"


# How a name is stated, strongest first: what stands before it, weight, words one of which it holds.
STATED = [
    (r"(?:spdx license identifier) ", 1.0, "spdx"),
    (r"(?:(?:re)?licensed|released|distributed|available|published|provided|covered) (?:under|by) (?:the |an? )?(?:terms (?:and conditions )?of (?:the )?)?", 0.95,
     "licensed|relicensed|released|distributed|available|published|provided|covered"),
    (r"(?:subject to|under|governed by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?", 0.9, "subject|under|governed"),
    (r"(?:license|licence) (?:type )?(?:is )?(?:the )?", 0.85, "license|licence"),
    ("", 0.8, ""),
]
SHORT_STATED = [
    (r"(?:(?:re)?licensed|released|distributed|available|published|provided|covered) under (?:the |an? )?(?:terms (?:and conditions )?of (?:the )?)?", 0.95,
     "licensed under|relicensed under|released under|distributed under|available under|published under|provided under|covered under"),
    (r"(?:license|licence) (?:type )?(?:is )?(?:the )?", 0.7, "license|licence"),
]
# Passages that licenses are known by, and statements without a license name.
PASSAGES = [
    Rule("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted", 1.0),
    Rule("mit", "the above copyright notice and this permission notice shall be included in all copies", "this permission notice", 0.9),
    Rule("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy", 1.0),
    Rule("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use", 0.95),
    Rule("bsd-3-clause", "nor the names of its contributors", "nor the names", 0.95),
    Rule("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "provided as is", 0.95),
    Rule("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 1.0),
    Rule("gpl", "this program is free software you can redistribute it and or modify it", "free software", 0.9),
    Rule("lgpl", "this library is free software you can redistribute it and or modify it", "free software", 0.9),
    Rule("gpl", "either version [0-9]+ of the license or (?:at your option )?any later version", "any later version", 0.8,
         lead="either version [0-9]+ of the license "),
    Rule("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy", "permission is hereby granted", 1.0),
    Rule("wtfpl", "you just do what the f[a-z]* you want to", "do what the", 1.0),
    Rule("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "unless required by", 0.95),
    Rule("apache-2.0", "you may not use this file except in compliance with the license", "you may not use", 0.9),
    Rule("mpl-2.0", "this source code form is subject to the terms of", "this source code form", 0.95),
    Rule("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", "mpl", 0.95),
    Rule("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment", "all advertising materials", 0.95),
    Rule("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of", 0.9),
    Rule("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions in", 0.9),
    Rule("zlib", "the origin of this software must not be misrepresented", "the origin of", 0.95),
    Rule("zlib", "altered source versions must be plainly marked as such", "altered source", 0.95),
    Rule("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free", 1.0),
    Rule("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "permission to use copy", 1.0),
    Rule("hpnd", "permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:and without fee is hereby granted|is hereby granted without fee)", "permission to use copy", 0.95),
    Rule("x11", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software", "shall not be used", 0.9),
    Rule("json", "the software shall be used for good not evil", "the software shall", 1.0),
    Rule("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer", "if we meet", 1.0),
    Rule("bsl-1.0", "the copyright notices in the software and this entire statement including the above license grant", "the copyright notices", 1.0),
    Rule("agpl-3.0", "your modified version must prominently offer all users interacting with it remotely through a computer network", "your modified version", 0.95),
    Rule("gpl-3.0", "is a free copyleft license for software and other kinds of works", "free copyleft|is a free", 0.95),
    Rule("gpl", "this program is distributed in the hope that it will be useful but without any warranty", "this program is", 0.8),
    Rule("lgpl", "this library is distributed in the hope that it will be useful but without any warranty", "this library is", 0.8),
    Rule("ofl-1.1", "the fonts including any derivative works can be bundled embedded redistributed and or sold with any software", "the fonts including", 1.0),
    Rule("public-domain", "(?:is |are )?(?:released|dedicated|placed) (?:in|into|to) the public domain", "public domain", 0.9),
    Rule("public-domain", "(?:this work|this file|this software) is (?:in )?the public domain", "public domain", 0.8),
    Rule("no-warranty", "(?:is )?provided as is without warrant(?:y|ies) of any kind", "provided as is", 0.4),
    Rule("proprietary", "(?:proprietary and confidential|confidential and proprietary)", "confidential", 0.7),
    Rule("proprietary", "(?:unauthorized|unauthorised) (?:copying|reproduction|distribution|use)(?: or distribution)? (?:of this [^ ]+ )?(?:is )?(?:strictly )?prohibited", "prohibited", 0.7),
    Rule("proprietary", "may not be (?:reproduced|copied|distributed)(?: (?!may |without )[^ ]+)*+ without (?:the )?(?:prior |express )?(?:written )?permission", "may not be", 0.6),
    Rule("copyright", "(?:copyright|copr)(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)?[0-9]{2})?", "copyright|copr", 0.3),
    Rule("copyright", "copyright (?:c )?by (?:the )?[^ ]+", "copyright", 0.3),
]


def signature_rules() -> list[Rule]:
    """All rules in order of priority: passages, identifiers, every license name in every way it is stated, short names."""
    ids = [(x.lower(), re.sub("[^a-z0-9]+", " ", x.lower())) for x in SPDX]
    tagged = [Rule(label, f"{spdx_lead(words)}(?:{words}{'(?: only| or later)?' if re.match('[al]?gpl|gfdl', words) else ''})", TAG, 1.0, lead=spdx_lead(words))
              for label, words in ids]
    named = [Rule(label, f"{lead}(?:{pattern})", keyword, weight, lead=lead, needs=needs)
             for lead, weight, needs in STATED for label, pattern, keyword in NAMES]
    # A short name is introduced by the keyword and needs its own first word beside it.
    short = [Rule(label, f"{lead}(?:{pattern})", keyword, weight, lead=lead, needs="|".join(re.findall(r"(?:^|\|)(\w+)", pattern)))
             for lead, weight, keyword in SHORT_STATED for label, pattern in SHORT]
    return [*PASSAGES, *tagged, *named, *short]


def word_text(text: Column) -> Column:
    """The words in lower case, one space before, between and after them; no word gives one space."""
    return F.concat(F.lit(" "), F.ltrim(F.concat(F.rtrim(F.regexp_replace(ascii_lower(text), BETWEEN, " ")), F.lit(" "))))


def _spaces(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


RULES = "array<struct<rank:bigint,label:string,regex:string,weight:double,base:boolean,keys:array<string>,needs:array<string>>>"
SPAN = "array<struct<start:bigint,core:bigint,end:bigint,rank:int,label:string,weight:double,base:boolean>>"


def _places(words: Column, rule: Column) -> Column:
    """Spans [start, end) in words of the matches of one rule and where their cores start, leftmost first and without overlap.

    Matches are marked at both ends and at the core, and the marked words' places are read off: linear in the text.
    """
    def spans(placed: Column) -> Column:
        starts = F.transform(F.filter(placed, lambda p: p["opens"]), lambda p: p["at"] - 1)
        cores = F.transform(F.filter(placed, lambda p: p["cored"]), lambda p: p["at"] - 1)
        ends = F.transform(F.filter(placed, lambda p: p["closes"]), lambda p: p["at"])
        return F.transform(F.arrays_zip(starts.alias("start"), cores.alias("core"), ends.alias("end")), lambda s: F.struct(
            s["start"].alias("start"), s["core"].alias("core"), s["end"].alias("end"), rule["rank"].alias("rank"), rule["label"].alias("label"),
            rule["weight"].alias("weight"), rule["base"].alias("base")))

    def read(marked: Column) -> Column:
        placed = F.filter(F.transform(F.split(marked, " "), lambda w, i: F.struct(
            i.cast("long").alias("at"), w.startswith("\x01").alias("opens"), w.contains("\x03").alias("cored"),
            w.endswith("\x02").alias("closes"))), lambda p: p["opens"] | p["cored"] | p["closes"])
        return F.when(marked.contains("\x01"), let(placed, spans)).otherwise(F.array().cast(SPAN))

    return let(F.regexp_replace(words, rule["regex"], F.lit("\x01$1\x03$2\x02")), read)


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _keywords_there(words: Column, present: Column, keywords: Sequence[str]) -> Column:
    """The keywords that a text holds, told from ``present``, its words among the rules' words.

    The text is searched only for keywords of several words whose first is there, and for beginnings of words.
    """
    several = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(k.split(" ")[0]).alias("first")) for k in keywords if " " in k])
    opening = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(k[:-1]).alias("stem")) for k in keywords if k.endswith("*")])
    parts = [F.array_intersect(present, _texts(k for k in keywords if " " not in k and not k.endswith("*")))]
    if any(" " in k for k in keywords):
        parts.append(F.filter(several, lambda k: F.array_contains(present, k["first"]) & words.contains(F.concat(F.lit(" "), k["key"])))["key"])
    if any(k.endswith("*") for k in keywords):
        parts.append(F.filter(opening, lambda k: words.contains(F.concat(F.lit(" "), k["stem"])))["key"])
    return F.concat(*parts)


def _found(words: Column, rules: Sequence[Rule]) -> Column:
    """All detections in a text.  Its words are looked up once among those of keywords; a text without any costs only that."""
    keywords = sorted({k for r in rules for k in r.keyword.split("|")})
    needed = {w for r in rules for w in r.needs.split("|") if w}
    # One literal, read once when the query is planned, instead of thousands of expressions.
    listed = F.from_json(F.lit(json.dumps([{
        "rank": i, "label": r.label, "regex": f"(?<= )({r.lead})({r.pattern.removeprefix(r.lead)})(?= )", "weight": r.weight, "base": r.base,
        "keys": r.keyword.split("|"), "needs": [w for w in r.needs.split("|") if w]} for i, r in enumerate(rules)])), RULES)
    known = sorted({k.split(" ")[0] for k in keywords if not k.endswith("*")} | needed)

    def run(present: Column, there: Column) -> Column:
        gated = F.filter(listed, lambda r: F.arrays_overlap(r["keys"], there) & ((F.size(r["needs"]) == 0) | F.arrays_overlap(r["needs"], present)))
        return F.when(F.size(there) > 0, F.flatten(F.transform(gated, lambda r: _places(words, r)))).otherwise(F.array().cast(SPAN))

    return let(F.array_intersect(F.split(words, " "), _texts(known)),
               lambda present: let(_keywords_there(words, present, keywords), lambda there: run(present, there)))


def _settled(members: Column) -> Column:
    """What stays of one group of detections whose cores overlap: in order of priority, each that overlaps nothing kept or
    holds all of the kept cores it overlaps, which it then replaces."""
    def step(kept: Column, x: Column) -> Column:
        def meets(k):
            return (k["core"] < x["end"]) & (x["core"] < k["end"])

        def holds(k):
            return (x["core"] <= k["core"]) & (k["end"] <= x["end"]) & ((x["core"] < k["core"]) | (k["end"] < x["end"]))

        return F.when(F.exists(kept, lambda k: meets(k) & ~holds(k)), kept).otherwise(
            F.concat(F.filter(kept, lambda k: ~meets(k)), F.array(x)))

    return F.aggregate(F.array_sort(members), F.filter(members, lambda _: F.lit(False)), step)


def detections(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """One row per detection and one (with null span) per text without any: row, id, n_words, start, core, end,
    rank, label, weight, base, stays.

    ``start``, ``core`` and ``end`` count words from 0, end exclusive.  ``stays`` tells what suppression leaves; base
    detections always stay.
    """
    rules = [*BASE, *(signature_rules() if rules is None else rules)]
    words = word_text(F.col("text"))
    scanned = (df.select(col(id_col).alias("id"), text_of(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
               .withColumn("words", words).select("row", "id", (_spaces(F.col("words")) - 1).alias("n_words"),
                                                  _found(F.col("words"), rules).alias("found")))
    # All that follows works within a row, so this is the only shuffle.
    each = scanned.select("row", "id", "n_words", F.inline_outer("found")).repartition("row")
    # Base detections stand apart: they neither suppress nor are suppressed.
    order = Window.partitionBy("row", "base").orderBy("core", "end", "rank")
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    # A group begins where no core before it reaches.
    cut = each.withColumn("cut", F.coalesce(F.max("end").over(before) <= F.col("core"), F.lit(True)).cast("long"))
    groups = (cut.withColumn("group", F.sum("cut").over(so_far)).groupBy("row", "id", "n_words", "base", "group")
              .agg(F.collect_list(F.struct("rank", "core", "start", "end", "label", "weight")).alias("members")))
    alone = F.col("base") | (F.size("members") == 1)
    told = let(_settled(F.col("members")), lambda kept: F.transform(F.col("members"), lambda m: m.withField("stays", m["start"].isNotNull() & F.exists(
        kept, lambda k: (k["rank"] == m["rank"]) & (k["core"] == m["core"])))))
    told = F.when(alone, F.transform(F.col("members"), lambda m: m.withField("stays", m["start"].isNotNull()))).otherwise(told)
    return (groups.select("row", "id", "n_words", "base", F.inline(told))
            .select("row", "id", "n_words", "start", "core", "end", "rank", "label", "weight", "base", "stays"))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """One row per input row: ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null counts as an empty text.  first_word and last_word are the smallest and largest start of a base
    detection, null without any.  labels joins base labels and those the suppression leaves, distinct and
    sorted.  score is the largest weight of a detection that stays, 0 without any.  Repeated rows and null
    identifiers come out as they went in; other columns are not touched; an empty table gives an empty result.
    """
    base, stays = F.col("base"), F.col("stays")

    def joined(cond: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")

    return (detections(df, id_col, text_col, rules).groupBy("row", "id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"), joined(base).alias("base_labels"), joined(stays).alias("labels"),
        F.coalesce(F.max(F.when(stays, F.col("weight"))), F.lit(0.0)).alias("score"))
        .select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"))
