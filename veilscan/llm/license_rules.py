"""Signature rules for licence texts, by hand, over words joined by single spaces.

Texts are matched as their words (letters, digits, anything beyond ASCII), so ``BY-NC 4.0`` reads
``by nc 4 0``. No pattern spans more than ``MAX_WORDS`` words; none has an unbounded repetition.
A rule is tried only where one of its keywords stands; each match holds one of them.
"""

from __future__ import annotations

from typing import NamedTuple

MAX_WORDS = 40

# Kinds of rules: priority (higher ones suppress what they contain) and confidence.
TAG, NOTICE, TEXT, TITLE, MENTION = (5, 1.0), (4, 0.95), (3, 0.9), (2, 0.7), (1, 0.4)

_L = "licen[sc]e"
_LIC = ("license", "licence")


class Rule(NamedTuple):
    name: str
    label: str
    keywords: tuple[str, ...]
    pattern: str
    priority: int
    confidence: float
    base: bool = False


# label, keywords, the licence's name as it stands in running text, its identifier in a tag.
LICENSES = [
    ("mit", _LIC, rf"mit(?: x11)? {_L}|expat {_L}", "mit"),
    ("mit-0", ("mit",), rf"mit (?:no attribution|0)(?: {_L})?", "mit 0"),
    ("apache-1.1", ("apache",), rf"apache(?: software)? {_L}(?: version| v)? 1 1", "apache 1 1"),
    ("apache-2", ("apache",), rf"apache(?: software)?(?: {_L})?(?: version| v)? ?2(?: 0)?|asl 2 0 apache", "apache 2 0"),
    ("bsd-2-clause", ("bsd", "freebsd"), rf"(?:simplified|2 clause|two clause) bsd(?: {_L})?|bsd (?:2|two) clause(?: {_L})?|freebsd {_L}", "bsd 2 clause"),
    ("bsd-3-clause", ("bsd",), rf"(?:new|revised|modified|3 clause|three clause) bsd(?: {_L})?|bsd (?:3|three) clause(?: {_L})?", "bsd 3 clause"),
    ("bsd-4-clause", ("bsd",), rf"(?:original|old|4 clause) bsd(?: {_L})?|bsd (?:4|four) clause(?: {_L})?", "bsd 4 clause"),
    ("0bsd", ("0bsd", "bsd"), rf"(?:zero clause|free public) bsd(?: {_L})?|0bsd(?: {_L})?|bsd zero clause(?: {_L})?", "0bsd"),
    ("gpl-1", ("gnu", "gpl", "gplv1"), r"gnu (?:general public licen[sc]e|gpl)(?: version| v)? 1(?: 0)?|gpl(?: version)? 1 0|gplv1", "gpl 1 0(?: only| or later)?"),
    ("gpl-2", ("gnu", "gpl", "gplv2"), r"gnu (?:general public licen[sc]e|gpl)(?: as published by the free software foundation)?(?: either)?(?: version| v|v) ?2(?: 0)?|gpl(?: version)? 2(?: 0)?|(?:gnu )?gplv2", "gpl 2 0(?: only| or later)?"),
    ("gpl-3", ("gnu", "gpl", "gplv3"), r"gnu (?:general public licen[sc]e|gpl)(?: as published by the free software foundation)?(?: either)?(?: version| v|v) ?3(?: 0)?|gpl(?: version)? 3(?: 0)?|(?:gnu )?gplv3", "gpl 3 0(?: only| or later)?"),
    ("lgpl-2", ("gnu", "lgpl", "lgplv2"), r"gnu library general public licen[sc]e(?: version| v)? 2(?: 0)?|(?:gnu )?lgpl(?: version)? 2 0|lgplv2", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", ("gnu", "lgpl", "lgplv2"), r"gnu lesser general public licen[sc]e(?: version| v)? 2 1|(?:gnu )?lgpl(?: version)? 2 1|lgplv2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", ("gnu", "lgpl", "lgplv3"), r"gnu lesser general public licen[sc]e(?: version| v)? 3(?: 0)?|(?:gnu )?lgpl(?: version)? 3(?: 0)?|lgplv3", "lgpl 3 0(?: only| or later)?"),
    ("agpl-3", ("affero", "agpl", "agplv3"), r"gnu affero general public licen[sc]e(?: version| v)? 3(?: 0)?|(?:gnu )?agpl(?: version)? 3(?: 0)?|agplv3", "agpl 3 0(?: only| or later)?"),
    ("gfdl", ("documentation", "gfdl"), r"gnu free documentation licen[sc]e(?: version 1 [1-3])?|gfdl(?: version)?(?: 1 [1-3])?", "gfdl 1 [1-3](?: only| or later)?"),
    ("mpl-1.1", ("mozilla", "mpl"), rf"mozilla public {_L}(?: version| v)? 1 [01]|mpl 1 [01]", "mpl 1 1"),
    ("mpl-2", ("mozilla", "mpl"), rf"mozilla public {_L}(?: version| v)? 2(?: 0)?|mpl 2(?: 0)?", "mpl 2 0"),
    ("epl-1", ("eclipse", "epl"), rf"eclipse public {_L}(?: version| v)? 1(?: 0)?|epl 1 0", "epl 1 0"),
    ("epl-2", ("eclipse", "epl"), rf"eclipse public {_L}(?: version| v)? 2(?: 0)?|epl 2 0", "epl 2 0"),
    ("edl-1", ("eclipse",), rf"eclipse distribution {_L}(?: version| v)?(?: 1 0)?", "edl 1 0 eclipse"),
    ("cddl", ("cddl", "distribution"), rf"common development and distribution {_L}(?: version)?(?: 1 [01])?|cddl(?: 1 [01])?", "cddl 1 [01]"),
    ("cpl-1", ("common",), rf"common public {_L}(?: version| v)?(?: 1 0)?", "cpl 1 0 common"),
    ("cpal-1", ("attribution", "cpal"), rf"common public attribution {_L}(?: version)?(?: 1 0)?|cpal 1 0", "cpal 1 0"),
    ("ipl-1", ("ibm",), rf"ibm public {_L}(?: version)?(?: 1 0)?", "ipl 1 0 ibm"),
    ("isc", _LIC, rf"isc {_L}|internet systems consortium {_L}", "isc license"),
    ("unlicense", ("unlicense",), r"(?:the )?unlicense(?: license)?", "unlicense"),
    ("wtfpl", ("wtfpl",), r"wtfpl(?: version 2| 2 0)?", "wtfpl"),
    ("zlib", ("zlib",), rf"zlib(?: libpng)? {_L}", "zlib"),
    ("libpng", ("libpng",), rf"(?:png reference library|libpng) {_L}(?: version 2)?", "libpng(?: 2 0)?"),
    ("boost-1", ("boost", "bsl"), rf"boost software {_L}(?: version)?(?: 1 0)?|boost {_L}|bsl 1 0", "bsl 1 0"),
    ("bsl-1.1", ("business", "busl"), rf"business source {_L}(?: version)?(?: 1 1)?|busl 1 1", "busl 1 1"),
    ("artistic-1", ("artistic",), rf"artistic {_L} 1 0|original artistic {_L}", "artistic 1 0"),
    ("artistic-2", ("artistic",), rf"artistic {_L} (?:version )?2(?: 0)?", "artistic 2 0"),
    ("python-2", ("python", "psf"), rf"python(?: software foundation)? {_L}(?: version 2)?|psf {_L}", "python 2 0|psf 2 0"),
    ("php-3", ("php",), rf"php {_L}(?: version)?(?: 3 0[01]?)?", "php 3 0[01]?"),
    ("ruby", ("ruby",), rf"ruby s? ?{_L}", "ruby"),
    ("perl", ("perl",), r"same terms as perl itself|perl 5 licen[sc]e", "artistic 1 0 perl"),
    ("tcl", ("tcl",), rf"tcl tk {_L}|tcl {_L}", "tcl"),
    ("vim", ("vim",), rf"vim {_L}", "vim"),
    ("curl", ("curl",), rf"curl {_L}", "curl"),
    ("openssl", ("openssl",), rf"openssl(?: project)? {_L}", "openssl"),
    ("x11", ("x11",), rf"x11 {_L}|mit x11 style {_L}", "x11"),
    ("ncsa", ("ncsa", "illinois"), rf"university of illinois(?: ncsa)? open source {_L}|ncsa {_L}", "ncsa"),
    ("ntp", ("ntp",), rf"ntp {_L}", "ntp"),
    ("postgresql", ("postgresql",), rf"postgresql {_L}", "postgresql"),
    ("odbl-1", ("odbl", "database"), rf"open database {_L}(?: version| v)?(?: 1 0)?|odbl(?: 1 0)?", "odbl 1 0"),
    ("odc-by", ("commons", "odc"), rf"open data commons attribution {_L}|odc by(?: 1 0)?", "odc by 1 0"),
    ("pddl-1", ("pddl", "dedication"), r"(?:open data commons )?public domain dedication and licen[sc]e|pddl(?: 1 0)?", "pddl 1 0"),
    ("cdla-permissive", ("cdla", "community"), r"community data licen[sc]e agreement permissive|cdla permissive(?: 1 0| 2 0)?", "cdla permissive [12] 0"),
    ("cdla-sharing", ("cdla", "community"), r"community data licen[sc]e agreement sharing|cdla sharing(?: 1 0)?", "cdla sharing 1 0"),
    ("ofl-1.1", ("ofl", "font"), rf"(?:sil )?open font {_L}(?: version)?(?: 1 [01])?|ofl 1 [01]", "ofl 1 [01]"),
    ("eupl", ("european", "eupl"), rf"european union public {_L}(?: version| v)?(?: 1 [12])?|eupl(?: v)?(?: 1 [12])?", "eupl 1 [12]"),
    ("cecill", ("cecill",), r"cecill(?: [bc])?(?: version)?(?: 2 [01])?(?: licen[sc]e)?", "cecill(?: [bc]| 2 [01])?"),
    ("afl-3", ("academic", "afl"), rf"academic free {_L}(?: version)?(?: 3 0)?|afl 3 0", "afl 3 0"),
    ("osl-3", ("open", "osl"), rf"open software {_L}(?: version)?(?: 3 0)?|osl 3 0", "osl 3 0"),
    ("ms-pl", ("microsoft",), rf"microsoft public {_L}|ms pl microsoft", "ms pl microsoft"),
    ("ms-rl", ("microsoft", "reciprocal"), rf"microsoft reciprocal {_L}", "ms rl reciprocal"),
    ("apsl-2", ("apple", "apsl"), rf"apple public source {_L}(?: version)?(?: 2 0)?|apsl 2 0", "apsl 2 0"),
    ("qpl-1", ("qpl", "public"), rf"q public {_L}(?: version)?(?: 1 0)?|qpl 1 0", "qpl 1 0"),
    ("sspl-1", ("sspl", "server"), rf"server side public {_L}(?: version| v)?(?: 1)?|sspl(?: v?1)?(?: 0)?", "sspl 1 0"),
    ("elastic-2", ("elastic",), rf"elastic {_L}(?: version)?(?: 2(?: 0)?)?", "elastic 2 0"),
    ("commons-clause", ("clause",), r"commons clause(?: licen[sc]e condition)?", "commons clause"),
    ("polyform-nc", ("polyform",), r"polyform noncommercial(?: licen[sc]e)?(?: 1 0 0)?", "polyform noncommercial 1 0 0"),
    ("unicode", ("unicode",), rf"unicode(?: inc)? {_L}(?: agreement)?", "unicode dfs 201[56]|unicode 3 0"),
    ("w3c", ("w3c",), rf"w3c software(?: notice)?(?: and)?(?: document)? {_L}", "w3c"),
    ("lppl-1.3", ("latex", "lppl"), rf"latex project public {_L}(?: version)?(?: 1 3c?)?|lppl(?: version)?(?: 1 3c?)?", "lppl 1 3c"),
    ("mulan-2", ("mulan",), rf"mulan permissive software {_L}(?: v2| version 2)?|mulan psl v2", "mulanpsl 2 0 mulan"),
    ("openrail", ("openrail", "rail"), rf"(?:creativeml |bigscience |bigcode )?open ?rail(?: m| plus plus m)?(?: {_L})?|responsible ai {_L} rail", "openrail"),
    ("llama-community", ("llama",), rf"llama (?:[23](?: [1-3])? )?community {_L}(?: agreement)?", "llama[23]"),
    ("cc0", ("cc0", "zero"), r"cc0(?: 1 0)?(?: universal)?|creative commons (?:cc )?zero(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-pdm", ("public",), r"public domain mark(?: 1 0)?", "cc pdm 1 0 public"),
    ("cc-by", ("cc", "creative"), r"cc by(?: [1-4] 0)?(?: licen[sc]e)?|creative commons attribution(?: [1-4] 0)?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?", "cc by [1-4] 0"),
    ("cc-by-sa", ("cc", "creative"), r"cc by sa(?: [1-4] 0)?(?: licen[sc]e)?|creative commons attribution share ?alike(?: [1-4] 0)?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?", "cc by sa [1-4] 0"),
    ("cc-by-nd", ("cc", "creative"), r"cc by nd(?: [1-4] 0)?(?: licen[sc]e)?|creative commons attribution no ?deriv(?:ative|ate)?s(?: works)?(?: [1-4] 0)?(?: international| unported)?(?: licen[sc]e)?", "cc by nd [1-4] 0"),
    ("cc-by-nc", ("cc", "creative"), r"cc by nc(?: [1-4] 0)?(?: licen[sc]e)?|creative commons attribution non ?commercial(?: [1-4] 0)?(?: international| unported)?(?: public)?(?: licen[sc]e)?", "cc by nc [1-4] 0"),
    ("cc-by-nc-sa", ("cc", "creative"), r"cc by nc sa(?: [1-4] 0)?(?: licen[sc]e)?|creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?(?: international| unported)?(?: public)?(?: licen[sc]e)?", "cc by nc sa [1-4] 0"),
    ("cc-by-nc-nd", ("cc", "creative"), r"cc by nc nd(?: [1-4] 0)?(?: licen[sc]e)?|creative commons attribution non ?commercial no ?deriv(?:ative|ate)?s(?: works)?(?: [1-4] 0)?(?: international| unported)?(?: licen[sc]e)?", "cc by nc nd [1-4] 0"),
]

# label, keywords, a telling passage or address, kind.
PASSAGES = [
    ("mit", ("granted",), "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", TEXT),
    ("mit", ("noninfringement",), "warranties of merchantability fitness for a particular purpose and noninfringement", TEXT),
    ("mit", ("permission",), "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", TEXT),
    ("mit", ("opensource",), "opensource org licenses mit", NOTICE),
    ("isc", ("hereby",), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", TEXT),
    ("isc", ("opensource",), "opensource org licenses isc", NOTICE),
    ("apache-2", ("compliance",), rf"you may not use this file except in compliance with the {_L}", TEXT),
    ("apache-2", ("apache",), r"(?:www )?apache org licenses(?: license 2 0)?(?: txt| html)?", NOTICE),
    ("apache-2", ("basis",), rf"software distributed under the {_L} is distributed on an as is basis", TEXT),
    ("apache-2", ("contributor",), r"licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements", TEXT),
    ("bsd", ("redistribution",), "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", TEXT),
    ("bsd", ("redistributions",), "redistributions of source code must retain the above copyright notice", TEXT),
    ("bsd", ("reproduce",), "redistributions in binary form must reproduce the above copyright notice", TEXT),
    ("bsd-3-clause", ("endorse",), r"may be used to endorse or promote products derived from this software without (?:specific )?prior written permission", TEXT),
    ("bsd-3-clause", ("opensource",), "opensource org licenses bsd 3 clause", NOTICE),
    ("bsd-2-clause", ("opensource",), "opensource org licenses bsd 2 clause", NOTICE),
    ("bsd-4-clause", ("advertising",), "all advertising materials mentioning features or use of this software must display the following acknowledgement", TEXT),
    ("zlib", ("misrepresented",), "the origin of this software must not be misrepresented", TEXT),
    ("boost-1", ("lgpl", "boost"), rf"boost org {_L} 1 0 txt", NOTICE),
    ("gpl", ("redistribute",), r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", TEXT),
    ("gpl-2", ("redistribute",), r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e(?: as published by the free software foundation)? (?:either )?version 2(?: of the licen[sc]e)?", TEXT),
    ("gpl-3", ("redistribute",), r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e(?: as published by the free software foundation)? (?:either )?version 3(?: of the licen[sc]e)?", TEXT),
    ("lgpl", ("redistribute",), r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e", TEXT),
    ("agpl", ("redistribute",), r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e", TEXT),
    ("gpl", ("gnu",), r"you should have received a copy of the gnu general public licen[sc]e", TEXT),
    ("lgpl", ("gnu",), r"you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", TEXT),
    ("agpl", ("affero",), r"you should have received a copy of the gnu affero general public licen[sc]e", TEXT),
    ("gpl", ("gnu",), r"(?:www )?gnu org licenses(?: gpl(?: 2 0| 3 0)?(?: html| txt)?)?", NOTICE),
    ("lgpl", ("gnu",), r"(?:www )?gnu org licenses lgpl(?: 2 1| 3 0)?(?: html| txt)?", NOTICE),
    ("agpl-3", ("gnu",), r"(?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?", NOTICE),
    ("mpl-2", ("mozilla",), rf"this source code form is subject to the terms of the mozilla public {_L} v(?:ersion)? ?2 0", TEXT),
    ("mpl-2", ("mozilla",), r"(?:www )?mozilla org (?:en us )?mpl 2 0", NOTICE),
    ("mpl-2", ("mpl",), "if a copy of the mpl was not distributed with this file you can obtain one at", TEXT),
    ("epl-2", ("eclipse",), r"(?:www )?eclipse org (?:legal )?epl(?: 2 0| v20)(?: html)?", NOTICE),
    ("epl-1", ("eclipse",), r"(?:www )?eclipse org legal epl v10(?: html)?", NOTICE),
    ("cc0", ("creativecommons",), r"creativecommons org publicdomain zero 1 0", NOTICE),
    ("cc-pdm", ("creativecommons",), r"creativecommons org publicdomain mark 1 0", NOTICE),
    ("cc-by", ("creativecommons",), r"creativecommons org licenses by [1-4] 0", NOTICE),
    ("cc-by-sa", ("creativecommons",), r"creativecommons org licenses by sa [1-4] 0", NOTICE),
    ("cc-by-nd", ("creativecommons",), r"creativecommons org licenses by nd [1-4] 0", NOTICE),
    ("cc-by-nc", ("creativecommons",), r"creativecommons org licenses by nc [1-4] 0", NOTICE),
    ("cc-by-nc-sa", ("creativecommons",), r"creativecommons org licenses by nc sa [1-4] 0", NOTICE),
    ("cc-by-nc-nd", ("creativecommons",), r"creativecommons org licenses by nc nd [1-4] 0", NOTICE),
    ("unlicense", ("unencumbered",), "this is free and unencumbered software released into the public domain", TEXT),
    ("unlicense", ("unlicense",), r"(?:www )?unlicense org", NOTICE),
    ("wtfpl", ("wtfpl",), r"(?:www )?wtfpl net", NOTICE),
    ("public-domain", ("domain",), r"(?:released|dedicated|placed|donated) (?:in|in ?to) the public domain", NOTICE),
    ("public-domain", ("domain",), r"(?:is|are) in the public domain", TITLE),
    ("ofl-1.1", ("scripts",), r"scripts sil org ofl", NOTICE),
    ("proprietary", ("reserved",), "all rights reserved", MENTION),
    ("proprietary", ("proprietary",), r"proprietary and confidential", TITLE),
    ("proprietary", ("prohibited",), r"unauthori[sz]ed (?:copying|reproduction|use)(?: or distribution)?(?: of this (?:file|work|document))?(?: via any medium)? is strictly prohibited", NOTICE),
    ("proprietary", ("consent",), r"may not be reproduced(?: or transmitted)?(?: in any form)? without(?: the)?(?: prior)?(?: written)? consent", NOTICE),
    ("non-commercial", ("commercial",), r"for non ?commercial (?:use|purposes)(?: only)?", TITLE),
    ("non-commercial", ("research",), r"for (?:academic|research)(?: and research| and academic)? (?:use|purposes) only research|for research (?:use|purposes) only", TITLE),
    ("gpl", ("gnu",), rf"gnu (?:general public {_L}|gpl)", MENTION),
    ("gpl", ("copyleft",), r"copyleft", MENTION),
    ("lgpl", ("gnu",), rf"gnu (?:lesser|library) general public {_L}", MENTION),
    ("agpl", ("affero",), rf"(?:gnu )?affero general public {_L}", MENTION),
    ("apache", ("apache",), rf"apache(?: software)? {_L}", MENTION),
    ("bsd", ("bsd",), rf"bsd(?: style)? {_L}", MENTION),
    ("mozilla", ("mozilla",), rf"mozilla public {_L}", MENTION),
    ("eclipse", ("eclipse",), rf"eclipse public {_L}", MENTION),
    ("creative-commons", ("creative",), rf"creative commons(?: {_L})?", MENTION),
    ("artistic", ("artistic",), rf"artistic {_L}", MENTION),
]

# Words of a document that always count, whatever else is found around them: phrase and label.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

_UNDER = (
    r"(?:licen[sc]ed|released|distributed|available|published|provided|offered|shared|dual licen[sc]ed|redistributed) "
    r"(?:under|subject to|according to|in accordance with)(?: the)?(?: terms(?: and conditions)? of)?(?: the| a| an)?"
)


def rules(base: list[tuple[str, str]] = BASE) -> list[Rule]:
    """All rules in order: base phrases, tags, notices, passages, titles."""
    made = [Rule(f"base:{label}", label, (max(phrase.split(" "), key=len),), phrase, 0, 0.95, True) for phrase, label in base]
    made += [Rule(f"tag:{label}", label, ("spdx",), f"spdx licen[sc]e identifier (?:{tag})", *TAG) for label, _, _, tag in LICENSES]
    made += [Rule(f"notice:{label}", label, keywords, f"{_UNDER} (?:{name})", *NOTICE) for label, keywords, name, _ in LICENSES]
    made += [Rule(f"text:{k}:{label}", label, keywords, pattern, *kind) for k, (label, keywords, pattern, kind) in enumerate(PASSAGES)]
    made += [Rule(f"title:{label}", label, keywords, name, *TITLE) for label, keywords, name, _ in LICENSES]
    return made
