"""Ordered signature rules for license detection.

Texts are matched after normalising: A-Z lower-cased, words parted by one space, nothing else kept. So patterns
are written over words; ``{v}`` stands for an optional "version"/"v" and ``~`` for a single space.

A rule is (pattern, label). Its keyword, the longest text that all matches of the pattern hold, must occur in a text
before the pattern is tried, and so must its anchor, a whole word; both are worked out from the pattern. Order is
priority: of overlapping detections the one of the earlier rule wins if it holds the other's interval.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

V = r"(?:version |v ?|ver )?"

# Phrases whose labels the contract names.
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# Hand-written signatures, most specific first.
SIGNATURES = (
    # full sentences of license grants and notices
    (r"licensed under the apache license {v}2 0", "apache-2.0"),
    (r"apache license {v}2 0", "apache-2.0"),
    (r"apache software license {v}2 0", "apache-2.0"),
    (r"asl {v}2 0", "apache-2.0"),
    (r"apache 2 0", "apache-2.0"),
    (r"apache license {v}1 1", "apache-1.1"),
    (r"apache software license {v}1 1", "apache-1.1"),
    (r"apache license {v}1 0", "apache-1.0"),
    (r"www apache org licenses license 2 0", "apache-2.0"),
    (r"www apache org licenses", "apache"),
    (r"licensed to the apache software foundation", "apache-2.0"),
    (r"apache (?:software )?license", "apache"),
    (r"permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    (r"permission to use copy modify and or distribute this software for any purpose", "isc"),
    (r"permission to use copy modify and distribute this software and its documentation", "hpnd"),
    (r"permission is granted to copy distribute and or modify this document", "gfdl"),
    (r"permission is granted to anyone to use this software for any purpose", "zlib"),
    (r"permission to reproduce", "permission"),
    (r"the software is provided as is without warranty of any kind express or implied", "mit-warranty"),
    (r"this software is provided by the copyright holders and contributors as is", "bsd-warranty"),
    (r"this software is provided as is without any express or implied warranty", "zlib-warranty"),
    (r"the above copyright notice and this permission notice shall be included", "mit"),
    (r"redistributions of source code must retain the above copyright notice", "bsd"),
    (r"redistributions in binary form must reproduce the above copyright notice", "bsd"),
    (r"redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    (r"neither the name of [0-9a-z ]{1,80} nor the names of its contributors", "bsd-3-clause"),
    (r"all advertising materials mentioning features or use of this software", "bsd-4-clause"),
    (r"(?:released|licensed|distributed|available) under the (?:terms of the )?mit license", "mit"),
    (r"the mit license mit", "mit"),
    (r"mit licen[sc]ed?", "mit"),
    (r"mit x11 license", "mit"),
    (r"mit no attribution", "mit-0"),
    (r"opensource org licenses mit", "mit"),
    (r"expat license", "mit"),
    (r"x11 license", "x11"),
    (r"isc license", "isc"),
    (r"opensource org licenses isc", "isc"),
    # BSD family
    (r"(?:bsd )?(?:3|three) clause bsd license", "bsd-3-clause"),
    (r"bsd (?:3|three) clause", "bsd-3-clause"),
    (r"(?:new|revised|modified) bsd license", "bsd-3-clause"),
    (r"(?:2|two) clause bsd license", "bsd-2-clause"),
    (r"bsd (?:2|two) clause", "bsd-2-clause"),
    (r"(?:simplified|freebsd) bsd license", "bsd-2-clause"),
    (r"bsd (?:4|four) clause", "bsd-4-clause"),
    (r"(?:original|old) bsd license", "bsd-4-clause"),
    (r"bsd (?:0|zero) clause", "0bsd"),
    (r"zero clause bsd", "0bsd"),
    (r"0bsd", "0bsd"),
    (r"opensource org licenses bsd license", "bsd"),
    (r"bsd style license", "bsd"),
    (r"(?:berkeley software distribution|bsd) licen[sc]ed?", "bsd"),
    # GNU family
    (r"gnu affero general public license {v}3 or later", "agpl-3.0-or-later"),
    (r"gnu affero general public license {v}3", "agpl-3.0"),
    (r"affero general public license {v}1", "agpl-1.0"),
    (r"(?:gnu )?affero general public license", "agpl"),
    (r"agpl ?{v}3 (?:0 )?or later", "agpl-3.0-or-later"),
    (r"agpl ?{v}3", "agpl-3.0"),
    (r"agpl", "agpl"),
    (r"gnu lesser general public license {v}2 1 or later", "lgpl-2.1-or-later"),
    (r"gnu lesser general public license {v}2 1", "lgpl-2.1"),
    (r"gnu lesser general public license {v}3", "lgpl-3.0"),
    (r"(?:gnu )?lesser general public license", "lgpl"),
    (r"gnu library general public license {v}2", "lgpl-2.0"),
    (r"(?:gnu )?library general public license", "lgpl-2.0"),
    (r"lgpl ?{v}2 1", "lgpl-2.1"),
    (r"lgpl ?{v}3", "lgpl-3.0"),
    (r"lgpl", "lgpl"),
    (r"gnu general public license as published by the free software foundation either {v}3", "gpl-3.0-or-later"),
    (r"gnu general public license as published by the free software foundation either {v}2", "gpl-2.0-or-later"),
    (r"gnu general public license {v}3 or (?:any )?later", "gpl-3.0-or-later"),
    (r"gnu general public license {v}2 or (?:any )?later", "gpl-2.0-or-later"),
    (r"gnu general public license {v}3", "gpl-3.0"),
    (r"gnu general public license {v}2", "gpl-2.0"),
    (r"gnu general public license {v}1", "gpl-1.0"),
    (r"gnu general public license", "gnu-gpl"),
    (r"general public license {v}3", "gpl-3.0"),
    (r"general public license {v}2", "gpl-2.0"),
    (r"gpl ?{v}3 (?:0 )?or later", "gpl-3.0-or-later"),
    (r"gpl ?{v}2 (?:0 )?or later", "gpl-2.0-or-later"),
    (r"gpl ?{v}3", "gpl-3.0"),
    (r"gpl ?{v}2", "gpl-2.0"),
    (r"gnu gpl", "gnu-gpl"),
    (r"(?:licensed|released|distributed) under (?:the )?gpl", "gnu-gpl"),
    (r"www gnu org (?:licenses|copyleft) (?:gpl|lgpl|agpl|fdl)", "gnu-link"),
    (r"gnu free documentation license {v}1 [123]", "gfdl"),
    (r"(?:gnu )?free documentation license", "gfdl"),
    (r"classpath exception", "classpath-exception"),
    (r"linking exception", "linking-exception"),
    (r"font exception", "font-exception"),
    (r"gcc runtime library exception", "gcc-exception"),
    # Creative Commons
    (r"attribution noncommercial noderiv(?:atives|s) {v}4 0", "cc-by-nc-nd-4.0"),
    (r"attribution noncommercial sharealike {v}4 0", "cc-by-nc-sa-4.0"),
    (r"attribution noncommercial {v}4 0", "cc-by-nc-4.0"),
    (r"attribution noderiv(?:atives|s) {v}4 0", "cc-by-nd-4.0"),
    (r"attribution share ?alike {v}4 0", "cc-by-sa-4.0"),
    (r"attribution share ?alike {v}3 0", "cc-by-sa-3.0"),
    (r"attribution share ?alike {v}2 [05]", "cc-by-sa-2"),
    (r"creative commons attribution noncommercial", "cc-by-nc"),
    (r"creative commons attribution share ?alike", "cc-by-sa"),
    (r"creative commons attribution noderiv(?:atives|s)", "cc-by-nd"),
    (r"creative commons attribution {v}4 0", "cc-by-4.0"),
    (r"creative commons attribution {v}3 0", "cc-by-3.0"),
    (r"creative commons attribution", "cc-attribution"),
    (r"cc by nc nd {v}4 0", "cc-by-nc-nd-4.0"),
    (r"cc by nc sa {v}4 0", "cc-by-nc-sa-4.0"),
    (r"cc by nc sa {v}3 0", "cc-by-nc-sa-3.0"),
    (r"cc by nc {v}4 0", "cc-by-nc-4.0"),
    (r"cc by nd {v}4 0", "cc-by-nd-4.0"),
    (r"cc by sa {v}4 0", "cc-by-sa-4.0"),
    (r"cc by sa {v}3 0", "cc-by-sa-3.0"),
    (r"cc by sa {v}2 [05]", "cc-by-sa-2"),
    (r"cc by {v}4 0", "cc-by-4.0"),
    (r"cc by {v}3 0", "cc-by-3.0"),
    (r"cc by {v}2 [05]", "cc-by-2"),
    (r"cc by nc nd", "cc-by-nc-nd"),
    (r"cc by nc sa", "cc-by-nc-sa"),
    (r"cc by nc", "cc-by-nc"),
    (r"cc by nd", "cc-by-nd"),
    (r"cc by sa", "cc-by-sa"),
    (r"cc0 1 0 universal", "cc0-1.0"),
    (r"cc0 {v}1 0", "cc0-1.0"),
    (r"cc0", "cc0-1.0"),
    (r"cc zero", "cc0-1.0"),
    (r"creativecommons org publicdomain zero 1 0", "cc0-1.0"),
    (r"creativecommons org publicdomain mark 1 0", "public-domain-mark"),
    (r"creativecommons org licenses by nc nd", "cc-by-nc-nd"),
    (r"creativecommons org licenses by nc sa", "cc-by-nc-sa"),
    (r"creativecommons org licenses by nc", "cc-by-nc"),
    (r"creativecommons org licenses by nd", "cc-by-nd"),
    (r"creativecommons org licenses by sa", "cc-by-sa"),
    (r"creativecommons org licenses by 4 0", "cc-by-4.0"),
    (r"creativecommons org licenses by", "cc-link"),
    (r"creative commons zero", "cc0-1.0"),
    (r"creative commons (?:licen[sc]ed?|lizenz)", "creative-commons"),
    (r"licence creative commons", "creative-commons"),
    (r"licencia creative commons", "creative-commons"),
    (r"creative commons", "creative-commons"),
    # Mozilla, Eclipse, Sun, IBM and other company licenses
    (r"mozilla public license {v}2 0 no copyleft exception", "mpl-2.0-no-copyleft"),
    (r"mozilla public license {v}2 0", "mpl-2.0"),
    (r"mozilla public license {v}1 1", "mpl-1.1"),
    (r"mozilla public license {v}1 0", "mpl-1.0"),
    (r"mozilla org mpl 2 0", "mpl-2.0"),
    (r"mozilla public license", "mpl"),
    (r"mpl ?{v}2 0", "mpl-2.0"),
    (r"mpl ?{v}1 1", "mpl-1.1"),
    (r"eclipse public license {v}2 0", "epl-2.0"),
    (r"eclipse public license {v}1 0", "epl-1.0"),
    (r"eclipse distribution license {v}1 0", "edl-1.0"),
    (r"eclipse public license", "epl"),
    (r"common public license {v}1 0", "cpl-1.0"),
    (r"common public attribution license", "cpal-1.0"),
    (r"common development and distribution license {v}1 1", "cddl-1.1"),
    (r"common development and distribution license {v}1 0", "cddl-1.0"),
    (r"common development and distribution license", "cddl"),
    (r"cddl ?{v}1 [01]", "cddl"),
    (r"ibm public license {v}1 0", "ipl-1.0"),
    (r"lucent public license {v}1 0[2]?", "lpl"),
    (r"nokia open source license", "nokia"),
    (r"apple public source license {v}2 0", "apsl-2.0"),
    (r"apple public source license", "apsl"),
    (r"microsoft public license", "ms-pl"),
    (r"microsoft reciprocal license", "ms-rl"),
    (r"ms pl", "ms-pl"),
    (r"ms rl", "ms-rl"),
    (r"intel open source license", "intel"),
    (r"sun public license {v}1 0", "spl-1.0"),
    (r"sun industry standards source license", "sissl"),
    (r"nasa open source agreement {v}1 3", "nasa-1.3"),
    (r"netscape public license {v}1 [01]", "npl"),
    (r"realnetworks public source license", "rpsl"),
    (r"sybase open watcom public license", "watcom-1.0"),
    (r"reciprocal public license {v}1 5", "rpl-1.5"),
    (r"reciprocal public license", "rpl"),
    (r"(?:the )?q public license", "qpl-1.0"),
    (r"q public license {v}1 0", "qpl-1.0"),
    # other families
    (r"artistic license {v}2 0", "artistic-2.0"),
    (r"(?:the )?clarified artistic license", "artistic-clarified"),
    (r"artistic license {v}1 0", "artistic-1.0"),
    (r"artistic license", "artistic"),
    (r"same terms as perl itself", "perl"),
    (r"academic free license {v}3 0", "afl-3.0"),
    (r"academic free license", "afl"),
    (r"open software license {v}3 0", "osl-3.0"),
    (r"open software license", "osl"),
    (r"boost software license {v}1 0", "bsl-1.0"),
    (r"boost software license", "bsl-1.0"),
    (r"business source license {v}1 1", "busl-1.1"),
    (r"business source license", "busl"),
    (r"elastic license {v}2 0", "elastic-2.0"),
    (r"elastic license", "elastic"),
    (r"server side public license {v}1", "sspl-1.0"),
    (r"server side public license", "sspl"),
    (r"zlib libpng license", "zlib"),
    (r"zlib license", "zlib"),
    (r"libpng license", "libpng"),
    (r"the unlicense", "unlicense"),
    (r"unlicense org", "unlicense"),
    (r"this is free and unencumbered software released into the public domain", "unlicense"),
    (r"(?:released|placed|dedicated) (?:in|into|to) the public domain", "public-domain"),
    (r"public domain dedication", "public-domain"),
    (r"in the public domain", "public-domain"),
    (r"wtfpl", "wtfpl"),
    (r"do what the fuck you want to public license", "wtfpl"),
    (r"beerware license", "beerware"),
    (r"the beer ware license", "beerware"),
    (r"python software foundation license {v}2", "psf-2.0"),
    (r"psf license agreement", "psf-2.0"),
    (r"python license 2 0", "python-2.0"),
    (r"php license {v}3 0[01]?", "php-3"),
    (r"php license", "php"),
    (r"ruby license", "ruby"),
    (r"openssl license", "openssl"),
    (r"openssl toolkit", "openssl"),
    (r"postgresql license", "postgresql"),
    (r"university of illinois ncsa open source license", "ncsa"),
    (r"ncsa open source license", "ncsa"),
    (r"apache license {v}2 0 with llvm exceptions", "apache-2.0-llvm"),
    (r"llvm exceptions", "llvm-exception"),
    (r"universal permissive license {v}1 0", "upl-1.0"),
    (r"universal permissive license", "upl-1.0"),
    (r"european union public licen[cs]e {v}1 2", "eupl-1.2"),
    (r"european union public licen[cs]e", "eupl"),
    (r"eupl ?{v}1 [12]", "eupl"),
    (r"cecill ?b", "cecill-b"),
    (r"cecill ?c", "cecill-c"),
    (r"cecill(?: 2 [01])?", "cecill"),
    (r"mulan psl ?{v}2", "mulanpsl-2.0"),
    (r"mulan permissive software license", "mulanpsl"),
    (r"sil open font license {v}1 1", "ofl-1.1"),
    (r"(?:sil )?open font license", "ofl"),
    (r"ofl 1 [01]", "ofl"),
    (r"open data commons attribution license", "odc-by-1.0"),
    (r"open data commons open database license", "odbl-1.0"),
    (r"open data commons public domain dedication", "pddl-1.0"),
    (r"open database license", "odbl-1.0"),
    (r"odbl", "odbl-1.0"),
    (r"open government licen[cs]e {v}3 0", "ogl-3.0"),
    (r"open government licen[cs]e", "ogl"),
    (r"community data license agreement permissive", "cdla-permissive"),
    (r"community data license agreement sharing", "cdla-sharing"),
    (r"vim license", "vim"),
    (r"w3c software (?:notice and )?license", "w3c"),
    (r"unicode license", "unicode"),
    (r"unicode terms of use", "unicode-tou"),
    (r"zope public license {v}2 [01]", "zpl-2"),
    (r"zope public license", "zpl"),
    (r"latex project public license", "lppl"),
    (r"lppl", "lppl"),
    (r"sleepycat license", "sleepycat"),
    (r"blue oak model license", "blueoak-1.0"),
    (r"hippocratic license", "hippocratic"),
    (r"the software shall be used for good not evil", "json"),
    (r"(?:bigscience |creativeml )?openrail m", "openrail"),
    (r"responsible ai license", "rail"),
    (r"llama [0-9]* ?community license", "llama-community"),
    (r"gemma terms of use", "gemma"),
    (r"commons clause", "commons-clause"),
    (r"polyform noncommercial license", "polyform-nc"),
    (r"polyform [a-z ]{1,30} license", "polyform"),
    (r"prosperity public license", "prosperity"),
    (r"parity public license", "parity"),
    (r"free art license", "free-art"),
    (r"licence ouverte", "etalab"),
    (r"etalab", "etalab"),
    # identifiers in source files
    (r"spdx license identifier apache 2 0", "apache-2.0"),
    (r"spdx license identifier mit", "mit"),
    (r"spdx license identifier bsd 3 clause", "bsd-3-clause"),
    (r"spdx license identifier bsd 2 clause", "bsd-2-clause"),
    (r"spdx license identifier gpl 3 0", "gpl-3.0"),
    (r"spdx license identifier gpl 2 0", "gpl-2.0"),
    (r"spdx license identifier lgpl [23] [01]", "lgpl"),
    (r"spdx license identifier mpl 2 0", "mpl-2.0"),
    (r"spdx license identifier isc", "isc"),
    (r"spdx license identifier", "spdx"),
    # ownership and restriction notices
    (r"tous droits réservés", "reserved-fr"),
    (r"alle rechte vorbehalten", "reserved-de"),
    (r"alle rechte vorbehalten", "reserved-de"),
    (r"tous droits réservés", "reserved-fr"),
    (r"todos los derechos reservados", "reserved-es"),
    (r"some rights reserved", "some-rights"),
    (r"no rights reserved", "no-rights"),
    (r"copyright c [0-9]{4}(?: [0-9]{4})*", "copyright-notice"),
    (r"copyright [0-9]{4}(?: [0-9]{4})*", "copyright-notice"),
    (r"copyright ©", "copyright-notice"),
    (r"copyrighted (?:material|work)", "copyright-notice"),
    (r"proprietary and confidential", "proprietary"),
    (r"strictly confidential", "proprietary"),
    (r"unauthorized (?:copying|use|reproduction|distribution)", "restricted"),
    (r"may not be reproduced", "restricted"),
    (r"may not be redistributed", "restricted"),
    (r"non commercial use only", "non-commercial"),
    (r"noncommercial use only", "non-commercial"),
    (r"for personal use only", "personal-use"),
    (r"for evaluation purposes only", "evaluation"),
    (r"trial license", "evaluation"),
    (r"end user license agreement", "eula"),
    (r"eula", "eula"),
    (r"terms of (?:service|use)", "terms"),
    (r"licen[sc]ed under (?:the )?(?:terms of )?(?:the )?[0-9a-z]+(?: [0-9a-z]+){0,3} licen[sc]e", "license-reference"),
    (r"see (?:the )?licen[sc]e (?:file )?for (?:more )?(?:details|information)", "license-reference"),
)


#: What may match more than one text: groups, classes and optional characters.
VARIABLE = re.compile(r"\([^()]*\)[?*+]?|\[[^\]]*\](?:\{[^}]*\}|[?*+])?|.\?")


@dataclass(frozen=True)
class Rule:
    priority: int
    keyword: str
    pattern: str
    label: str
    anchor: str


def anchor(pattern: str) -> str:
    """The longest word that every match of ``pattern`` holds as a whole word; empty if there is none."""
    fixed = [w for w in VARIABLE.sub("\0", pattern).split(" ") if w and "\0" not in w]
    return max(fixed, key=len, default="")


def keyword(pattern: str) -> str:
    """The longest text that every match of ``pattern`` holds; empty if there is none."""
    return max((t.strip() for t in re.split("\0(?:\\{[^}]*\\})?", VARIABLE.sub("\0", pattern))), key=len, default="")


def _rule(priority: int, pattern: str, label: str) -> Rule:
    return Rule(priority, keyword(pattern), f"(?<= ){pattern}(?= )", label, anchor(pattern))


def rules() -> list[Rule]:
    """Every rule in priority order. The word boundary is the space that normalising leaves around words."""
    return [_rule(i, p.replace("{v}", V), label) for i, (p, label) in enumerate(SIGNATURES)]


def base_rules() -> list[Rule]:
    """The contract's phrases; they are counted at every place and never suppressed."""
    return [_rule(-1, phrase, label) for phrase, label in BASE]
