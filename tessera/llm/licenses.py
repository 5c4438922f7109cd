"""License scans by ordered signature rules; DataFrame functions only, and no shuffle: all of it happens in the row.

A text that holds none of the STEMS goes no further. Of the rules, those run whose keyword, a literal that each of their
matches holds, occurs in the lower-cased text. Their matches become intervals. One that overlaps an interval of higher
priority is suppressed, and so is one that an interval of its own priority contains which starts earlier, or at the same
place and is longer or comes from an earlier rule. What survives gives the labels. Base phrases are found apart, by words,
and their labels always stay.

Defined results: a null text is empty; an empty text has no words and no labels; labels are distinct and sorted; score is
the weight of the strongest surviving detection or base label, else 0; repeated rows are scanned alike; a text of any length
is scanned whole, in time proportional to its length and its matches; other columns are ignored, whatever their names; no
rows give no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.support import columns

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
#: One of these occurs in whatever any rule or base phrase matches.
STEMS = ["licen", "copyright", "spdx", "public domain", "permission", "redistribut", "warrant", "all rights reserved", "creativecommons", "wtfpl", "mozilla.org/mpl", "eclipse.org/legal", "endorse or promote", "advertising material"]
WEIGHTS = {1: 0.95, 2: 0.8, 3: 0.5}

L = "licen[sc]e"
_CC = rf"(?: [\d.]+)?(?: international| unported| generic)? {L}"
#: Priority 2: how licenses are named, by label, as patterns over lower-cased text.
NAMES: dict[str, list[str]] = {
    "mit": [r"mit[ -]licen[sc]ed?", rf"mit/x11 {L}", rf"expat {L}", r"licen[sc]ed under (?:the )?(?:terms of the )?mit\b", rf"x11 {L}", rf"mit no attribution {L}"],
    "apache": [rf"apache(?: software)? {L}", rf"apache {L},? version [12](?:\.[01])?", r"licen[sc]ed under (?:the )?apache\b", r"apache-2(?:\.0)? licen[sc]ed?"],
    "gpl": [rf"(?:gnu )?general public {L}", rf"gnu gpl {L}", r"licen[sc]ed under (?:the )?(?:gnu )?gpl", r"gpl ?v?[123](?:\.0)? licen[sc]ed?"],
    "lgpl": [rf"(?:gnu )?(?:lesser|library) general public {L}", r"licen[sc]ed under (?:the )?(?:gnu )?lgpl", r"lgpl ?v?[23](?:\.\d)? licen[sc]ed?"],
    "agpl": [rf"(?:gnu )?affero general public {L}", r"licen[sc]ed under (?:the )?(?:gnu )?agpl", r"agpl ?v?3(?:\.0)? licen[sc]ed?"],
    "gfdl": [rf"(?:gnu )?free documentation {L}", r"licen[sc]ed under (?:the )?(?:gnu )?fdl\b"],
    "bsd": [r"bsd[ -](?:style )?licen[sc]ed?", rf"(?:new|modified|simplified|revised) bsd {L}", rf"(?:zero|two|three|four|[0234])[ -]clause bsd {L}", rf"berkeley software distribution {L}", r"licen[sc]ed under (?:the )?(?:terms of the )?bsd\b"],
    "isc": [r"isc licen[sc]ed?", rf"internet systems consortium {L}"],
    "mpl": [rf"mozilla public {L}", r"licen[sc]ed under (?:the )?mpl"],
    "epl": [rf"eclipse public {L}", r"licen[sc]ed under (?:the )?epl"],
    "edl": [rf"eclipse distribution {L}"],
    "eupl": [rf"european union public {L}", r"licen[sc]ed under (?:the )?eupl"],
    "cddl": [rf"common development and distribution {L}", r"licen[sc]ed under (?:the )?cddl"],
    "cpl": [rf"common public {L}"],
    "cpal": [rf"common public attribution {L}"],
    "ipl": [rf"ibm public {L}"],
    "spl": [rf"sun public {L}"],
    "sissl": [rf"sun industry standards source {L}"],
    "npl": [rf"netscape public {L}"],
    "apsl": [rf"apple public source {L}"],
    "rpsl": [rf"realnetworks public source {L}"],
    "watcom": [rf"sybase open watcom public {L}"],
    "artistic": [rf"(?:perl )?artistic {L}", rf"clarified artistic {L}"],
    "boost": [rf"boost software {L}"],
    "busl": [rf"business source {L}"],
    "fsl": [rf"functional source {L}"],
    "fair-source": [rf"fair source {L}"],
    "zlib": [rf"zlib(?:/libpng)? {L}"],
    "libpng": [rf"(?:png|libpng) (?:reference library )?{L}"],
    "libtiff": [rf"libtiff {L}"],
    "freetype": [rf"freetype (?:project )?{L}"],
    "imagemagick": [rf"imagemagick {L}"],
    "info-zip": [rf"info-zip {L}"],
    "bzip2": [rf"bzip2 (?:and libbzip2 )?{L}"],
    "tcl": [rf"tcl/tk {L}"],
    "ijg": [rf"independent jpeg group {L}"],
    "psf": [rf"python software foundation {L}", rf"psf {L}"],
    "php": [rf"php {L}"],
    "ruby": [rf"ruby {L}"],
    "erlang": [rf"erlang public {L}"],
    "openssl": [rf"openssl {L}", rf"ssleay {L}"],
    "postgresql": [rf"postgresql {L}"],
    "interbase": [rf"interbase public {L}"],
    "unicode": [rf"unicode(?:,? inc\.?)? {L}"],
    "icu": [rf"icu {L}"],
    "w3c": [rf"w3c (?:software )?(?:notice and )?{L}"],
    "ntp": [rf"ntp {L}"],
    "hpnd": [r"historical permission notice and disclaimer"],
    "wtfpl": [rf"do what the f\w+ you want to public {L}", r"\bwtfpl\b"],
    "unlicense": [r"\bthe unlicense\b"],
    "cc0": [rf"creative commons zero {L}", r"cc0 public domain dedication", rf"cc0 {L}"],
    "cc-by": [rf"creative commons attribution{_CC}", rf"cc[- ]by(?: [\d.]+)? {L}"],
    "cc-by-sa": [rf"creative commons attribution[- ]share[- ]?alike{_CC}", rf"cc[- ]by[- ]sa(?: [\d.]+)? {L}"],
    "cc-by-nc": [rf"creative commons attribution[- ]non-?commercial{_CC}", rf"cc[- ]by[- ]nc(?: [\d.]+)? {L}"],
    "cc-by-nd": [rf"creative commons attribution[- ]no[- ]?deriv\w*{_CC}", rf"cc[- ]by[- ]nd(?: [\d.]+)? {L}"],
    "cc-by-nc-sa": [rf"attribution[- ]non-?commercial[- ]share[- ]?alike{_CC}", rf"cc[- ]by[- ]nc[- ]sa(?: [\d.]+)? {L}"],
    "cc-by-nc-nd": [rf"attribution[- ]non-?commercial[- ]no[- ]?deriv\w*{_CC}", rf"cc[- ]by[- ]nc[- ]nd(?: [\d.]+)? {L}"],
    "odbl": [rf"open data(?:base| commons open database) {L}"],
    "odc-by": [rf"open data commons attribution {L}"],
    "pddl": [rf"public domain dedication and {L}"],
    "cdla": [rf"community data {L} agreement"],
    "ogl": [rf"open government {L}"],
    "etalab": [rf"etalab open {L}"],
    "talis": [rf"talis community {L}"],
    "ofl": [rf"(?:sil )?open font {L}"],
    "ubuntu-font": [rf"ubuntu font {L}"],
    "arphic": [rf"arphic public {L}"],
    "gust-font": [rf"gust font {L}"],
    "osl": [rf"open software {L}"],
    "nposl": [rf"non-profit open software {L}"],
    "afl": [rf"academic free {L}"],
    "ecl": [rf"educational community {L}"],
    "efl": [rf"eiffel forum {L}"],
    "ncsa": [rf"(?:university of illinois|uiuc)(?:/ncsa)? (?:open source )?{L}"],
    "ms-pl": [rf"microsoft public {L}"],
    "ms-rl": [rf"microsoft reciprocal {L}"],
    "rpl": [rf"reciprocal public {L}"],
    "sspl": [rf"server side public {L}"],
    "elastic": [rf"elastic {L}"],
    "polyform": [rf"polyform (?:noncommercial|small business|shield|perimeter|strict|free trial|internal use) {L}"],
    "commons-clause": [rf"commons clause {L}"],
    "hippocratic": [rf"hippocratic {L}"],
    "parity": [rf"parity public {L}"],
    "prosperity": [rf"prosperity public {L}"],
    "peer-production": [rf"peer production {L}"],
    "anti-capitalist": [rf"anti-capitalist software {L}"],
    "upl": [rf"universal permissive {L}"],
    "mulan": [rf"mulan (?:permissive software|psl) {L}"],
    "blueoak": [rf"blue oak model {L}"],
    "fair": [rf"\bthe fair {L}"],
    "simple-public": [rf"simple public {L}"],
    "adaptive-public": [rf"adaptive public {L}"],
    "attribution-assurance": [rf"attribution assurance {L}"],
    "catosl": [rf"computer associates trusted open source {L}"],
    "cua": [rf"cua office public {L}"],
    "entessa": [rf"entessa public {L}"],
    "frameworx": [rf"frameworx (?:open )?{L}"],
    "intel": [rf"intel open source {L}"],
    "jabber": [rf"jabber open source {L}"],
    "lucent": [rf"lucent public {L}"],
    "motosoto": [rf"motosoto open source {L}"],
    "nokia": [rf"nokia open source {L}"],
    "oclc": [rf"oclc research public {L}"],
    "open-group": [rf"open group test suite {L}"],
    "ricoh": [rf"ricoh source code public {L}"],
    "sugarcrm": [rf"sugarcrm public {L}"],
    "vovida": [rf"vovida software {L}"],
    "wxwindows": [rf"wxwindows library {L}"],
    "xnet": [rf"x\.net,? {L}"],
    "yahoo": [rf"yahoo!? public {L}"],
    "zimbra": [rf"zimbra public {L}"],
    "opl": [rf"open publication {L}", rf"open content {L}"],
    "ogl-game": [rf"open game {L}"],
    "dsl": [rf"design science {L}"],
    "lal": [rf"free art {L}", rf"{L} art libre"],
    "vim": [rf"vim {L}"],
    "beerware": [rf"beer-?ware {L}"],
    "json": [rf"json {L}"],
    "curl": [rf"curl {L}"],
    "latex": [rf"latex project public {L}"],
    "sleepycat": [rf"sleepycat {L}"],
    "qpl": [rf"q public {L}"],
    "zpl": [rf"zope public {L}"],
    "cecill": [rf"cecill(?:-[abc])? (?:free software )?{L}"],
    "nasa": [rf"nasa open source agreement {L}"],
    "openrail": [rf"(?:bigscience )?(?:open)?rail(?:-m)? {L}"],
    "llama": [rf"llama (?:\d(?:\.\d)? )?community {L}"],
    "gemma": [rf"gemma {L}"],
    "public-domain": [r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"],
    "proprietary": [r"all rights reserved", rf"proprietary {L}", rf"end[- ]user {L} agreement", rf"this is not an open source {L}", rf"commercial {L} agreement"],
}
_OSI, _SPDX_URL = r"opensource\.org/licenses?/", r"spdx\.org/licenses/"
#: Priority 1: sentences of license texts and notices, and addresses of the texts, by label.
TEXTS: dict[str, list[str]] = {
    "mit": [r"permission is hereby granted, free of charge,? to any person obtaining a copy of this software", r"the above copyright notice and this permission notice shall be included in all copies", r"without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense", rf"{_OSI}mit\b", rf"{_SPDX_URL}mit\b"],
    "apache": [rf"you may not use this file except in compliance with the {L}", r"apache\.org/licenses/license-2\.0", rf"{_OSI}apache-2\.0", rf"software distributed under the {L} is distributed on an \"?as is\"? basis", rf"grant of patent {L}\. subject to the terms and conditions of this {L}", rf"grant of copyright {L}\. subject to the terms and conditions of this {L}", rf"{_SPDX_URL}apache-2\.0"],
    "gpl": [rf"you can redistribute it and/or modify it under the terms of the gnu general public {L}", rf"you should have received a copy of the gnu general public {L}", rf"either version [123](?:\.0)? of the {L},? or \(at your option\) any later version", r"gnu\.org/licenses/(?:old-licenses/)?gpl", rf"{_OSI}gpl-[123]\.0", r"the licenses for most software are designed to take away your freedom", rf"this general public {L} does not permit incorporating", rf"{_SPDX_URL}gpl-[123]\.0"],
    "lgpl": [rf"you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public {L}", rf"you should have received a copy of the gnu (?:lesser|library) general public {L}", r"gnu\.org/licenses/(?:old-licenses/)?lgpl", rf"{_OSI}lgpl-[23]\.\d", rf"{_SPDX_URL}lgpl-[23]\.\d"],
    "agpl": [rf"you can redistribute it and/or modify it under the terms of the gnu affero general public {L}", rf"you should have received a copy of the gnu affero general public {L}", r"gnu\.org/licenses/agpl", rf"remote network interaction; use with the gnu general public {L}", rf"{_OSI}agpl-3\.0"],
    "gfdl": [rf"copy, distribute and/or modify this document under the terms of the gnu free documentation {L}", r"gnu\.org/licenses/fdl"],
    "bsd": [r"redistribution and use in source and binary forms,? with or without modification", r"redistributions of source code must retain the above copyright notice", r"redistributions in binary form must reproduce the above copyright notice", r"may be used to endorse or promote products derived from this software", r"all advertising materials? mentioning features or use of this software", rf"{_OSI}bsd-[234]-clause", rf"{_SPDX_URL}bsd-[234]-clause"],
    "isc": [r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose", rf"{_OSI}isc\b"],
    "hpnd": [r"permission to use, copy, modify,? and distribute this software and its documentation"],
    "mpl": [rf"this source code form is subject to the terms of the mozilla public {L}", rf"the contents of this file are subject to the mozilla public {L}", r"mozilla\.org/mpl", rf"{_OSI}mpl-[12]\.\d"],
    "epl": [rf"the accompanying materials are made available under the terms of the eclipse public {L}", r"eclipse\.org/legal/epl", rf"{_OSI}epl-[12]\.0"],
    "edl": [r"eclipse\.org/legal/edl"],
    "eupl": [rf"{_OSI}eupl-1\.[012]", rf"not use this work except in compliance with the {L}"],
    "cddl": [rf"the contents of this file are subject to the terms of the common development and distribution {L}", rf"{_OSI}cddl-1\.[01]"],
    "cpl": [rf"provided under the terms of this common public {L}", rf"{_OSI}cpl-?1\.0"],
    "artistic": [rf"{_OSI}artistic-licen[sc]e", r"perlfoundation\.org/artistic[-_]licen[sc]e"],
    "boost": [r"boost\.org/license_1_0", rf"distributed under the boost software {L}", rf"{_OSI}bsl-1\.0"],
    "zlib": [r"this software is provided 'as-is', without any express or implied warranty", r"zlib\.net/zlib_license", rf"{_OSI}zlib\b"],
    "openssl": [r"openssl\.org/source/license"],
    "psf": [rf"psf {L} agreement for python", r"docs\.python\.org/[\d./]*license"],
    "php": [r"php\.net/license", rf"this source file is subject to version [23]\.\d+ of the php {L}"],
    "unlicense": [r"unlicense\.org", r"free and unencumbered software released into the public domain"],
    "wtfpl": [r"wtfpl\.net", rf"everyone is permitted to copy and distribute verbatim or modified copies of this {L} document"],
    "cc0": [r"creativecommons\.org/publicdomain/zero", r"waived? all copyright and related (?:or|and) neighbou?ring rights"],
    "cc-by": [r"creativecommons\.org/licenses/by/"],
    "cc-by-sa": [r"creativecommons\.org/licenses/by-sa"],
    "cc-by-nc": [r"creativecommons\.org/licenses/by-nc/"],
    "cc-by-nd": [r"creativecommons\.org/licenses/by-nd"],
    "cc-by-nc-sa": [r"creativecommons\.org/licenses/by-nc-sa"],
    "cc-by-nc-nd": [r"creativecommons\.org/licenses/by-nc-nd"],
    "public-domain": [r"creativecommons\.org/publicdomain/mark"],
    "odbl": [r"opendatacommons\.org/licenses/odbl"],
    "pddl": [r"opendatacommons\.org/licenses/pddl"],
    "odc-by": [r"opendatacommons\.org/licenses/by\b"],
    "ofl": [rf"this font software is licensed under the sil open font {L}", rf"{_OSI}ofl-1\.1"],
    "osl": [rf"{_OSI}osl-[123]\.\d"],
    "afl": [rf"{_OSI}afl-[123]\.\d"],
    "ecl": [rf"{_OSI}ecl-[12]\.0"],
    "ncsa": [rf"{_OSI}(?:uoi-)?ncsa"],
    "ms-pl": [rf"{_OSI}ms-pl", rf"this {L} governs use of the accompanying software"],
    "ms-rl": [rf"{_OSI}ms-rl"],
    "sspl": [r"mongodb\.com/licensing/server-side-public-license"],
    "elastic": [r"elastic\.co/licensing/elastic-license"],
    "busl": [rf"use of this software is governed by the business source {L}"],
    "upl": [r"oss\.oracle\.com/licenses/upl", rf"{_OSI}upl\b"],
    "mulan": [r"license\.coscl\.org\.cn/mulan"],
    "blueoak": [r"blueoakcouncil\.org/license"],
    "json": [r"json\.org/license"],
    "latex": [rf"under the conditions of the latex project public {L}"],
    "sleepycat": [rf"{_OSI}sleepycat"],
    "qpl": [rf"{_OSI}qtpl", rf"{_OSI}qpl-1\.0"],
    "zpl": [rf"{_OSI}zpl-[12]\.\d"],
    "cecill": [r"cecill\.info/licen[sc]es"],
    "nasa": [rf"{_OSI}nasa-?1\.3"],
    "polyform": [r"polyformproject\.org/licenses"],
    "llama": [rf"llama \d(?:\.\d)? is licensed under the llama \d(?:\.\d)? community {L}"],
}
#: Priority 3: general mentions.
MENTIONS: dict[str, list[str]] = {
    "warranty-disclaimer": [r"without warrant(?:y|ies) (?:or conditions )?of any kind", r"warranties of merchantability"],
    "copyright-notice": [r"copyright (?:\(c\)|©)? ?(?:19|20)\d\d"],
    "generic-license": [r"licen[sc]ed? under (?:the )?[\w.+ -]{2,40}licen[sc]e", rf"see the {L} file", rf"under the terms of the [\w.+ -]{{2,40}}{L}"],
}
#: Identifiers behind an SPDX tag, by label: one rule of priority 1 each.
TAGS: dict[str, str] = {
    "mit": "mit mit-0 x11", "apache": "apache-1.0 apache-1.1 apache-2.0", "gpl": "gpl-1.0 gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later",
    "lgpl": "lgpl-2.0 lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later", "agpl": "agpl-1.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later", "gfdl": "gfdl-1.1 gfdl-1.2 gfdl-1.3",
    "bsd": "0bsd bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause", "isc": "isc", "mpl": "mpl-1.0 mpl-1.1 mpl-2.0", "epl": "epl-1.0 epl-2.0", "eupl": "eupl-1.0 eupl-1.1 eupl-1.2",
    "cddl": "cddl-1.0 cddl-1.1", "cpl": "cpl-1.0", "cpal": "cpal-1.0", "ipl": "ipl-1.0", "spl": "spl-1.0", "npl": "npl-1.0 npl-1.1", "apsl": "apsl-1.0 apsl-1.1 apsl-1.2 apsl-2.0",
    "artistic": "artistic-1.0 artistic-1.0-perl artistic-2.0 clartistic", "boost": "bsl-1.0", "busl": "busl-1.1", "zlib": "zlib zlib-acknowledgement", "libpng": "libpng libpng-2.0", "libtiff": "libtiff", "freetype": "ftl", "ijg": "ijg",
    "psf": "psf-2.0 python-2.0", "php": "php-3.0 php-3.01", "ruby": "ruby", "openssl": "openssl", "postgresql": "postgresql", "unicode": "unicode-dfs-2015 unicode-dfs-2016 unicode-3.0", "icu": "icu", "w3c": "w3c w3c-19980720 w3c-20150513",
    "ntp": "ntp", "hpnd": "hpnd", "wtfpl": "wtfpl", "unlicense": "unlicense", "cc0": "cc0-1.0", "cc-by": "cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0", "cc-by-sa": "cc-by-sa-1.0 cc-by-sa-2.0 cc-by-sa-2.5 cc-by-sa-3.0 cc-by-sa-4.0",
    "cc-by-nc": "cc-by-nc-1.0 cc-by-nc-2.0 cc-by-nc-2.5 cc-by-nc-3.0 cc-by-nc-4.0", "cc-by-nd": "cc-by-nd-1.0 cc-by-nd-2.0 cc-by-nd-2.5 cc-by-nd-3.0 cc-by-nd-4.0", "cc-by-nc-sa": "cc-by-nc-sa-2.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0",
    "cc-by-nc-nd": "cc-by-nc-nd-2.0 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0", "odbl": "odbl-1.0", "odc-by": "odc-by-1.0", "pddl": "pddl-1.0", "ofl": "ofl-1.0 ofl-1.1", "osl": "osl-1.0 osl-2.0 osl-2.1 osl-3.0", "afl": "afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0",
    "ecl": "ecl-1.0 ecl-2.0", "ncsa": "ncsa", "ms-pl": "ms-pl", "ms-rl": "ms-rl", "rpl": "rpl-1.1 rpl-1.5", "sspl": "sspl-1.0", "elastic": "elastic-2.0", "upl": "upl-1.0", "mulan": "mulanpsl-1.0 mulanpsl-2.0", "blueoak": "blueoak-1.0.0", "vim": "vim",
    "beerware": "beerware", "json": "json", "curl": "curl", "latex": "lppl-1.0 lppl-1.1 lppl-1.2 lppl-1.3a lppl-1.3c", "sleepycat": "sleepycat", "qpl": "qpl-1.0", "zpl": "zpl-1.1 zpl-2.0 zpl-2.1",
    "cecill": "cecill-1.0 cecill-2.0 cecill-2.1 cecill-b cecill-c", "nasa": "nasa-1.3",
}


def rules() -> list[dict]:
    """All rules in order: sentences and addresses, SPDX tags, names, mentions."""
    out = [(label, 1, p) for label, some in TEXTS.items() for p in some]
    out += [(label, 1, rf"spdx-license-identifier:\s*{re.escape(t)}(?![\w.+-])") for label, some in TAGS.items() for t in some.split()]
    out += [(label, 2, rf"(?<![\p{{L}}\p{{N}}])(?:{p})") for label, some in NAMES.items() for p in some]
    out += [(label, 3, p) for label, some in MENTIONS.items() for p in some]
    return [{"label": a, "priority": b, "keyword": keyword(p), "pattern": p} for a, b, p in out]


def literals(pattern: str) -> list[str]:
    """Runs of literal characters that every match of a pattern holds. Groups are skipped whole, and so is a character
    that a quantifier makes optional; the one group that a name is wrapped in is opened."""
    if m := re.fullmatch(r"\(\?<!\[[^]]*\]\)\(\?:(.*)\)", pattern):
        pattern = m[1]
    out, now, depth = [], "", 0
    for token in re.findall(r"\\.|\[[^]]*\]|\{[^}]*\}|.", pattern):
        if token in "()":
            depth += 1 if token == "(" else -1
        elif depth:
            continue
        elif len(token) == 1 and token not in "|?*+.^$":
            now += token
            continue
        elif len(token) == 2 and not token[1].isalnum():
            now += token[1]
            continue
        elif token == "|":
            raise ValueError(f"alternatives outside a group: {pattern}")
        elif token in "?*":
            now = now[:-1]
        out, now = [*out, now], ""
    return [x for x in [*out, now] if x]


def keyword(pattern: str) -> str:
    """The literal of a pattern that says most: the longest, where what mentions of any license share counts little."""
    return max(literals(pattern), key=lambda x: max(4.5, len(x) - 10) if "licen" in x else len(x))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, zero: Column, kind: str, step: Callable[[Column, Column], Column], block: int = 128) -> Column:
    """What step(state, value), a struct of the next state `s` and an output `o` of type kind, puts out along an array.

    Outputs are gathered in blocks: appending to one long array would copy it for each value.
    """
    none, nones = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda b: F.slice(values, b * block + 1, block))
    pair = lambda s, o: F.struct(s.alias("s"), o.alias("o"))
    inner = lambda s, some: F.aggregate(some, pair(s, none), lambda acc, v: _let(step(acc["s"], v), lambda x: pair(x["s"], F.concat(acc["o"], F.array(x["o"])))))
    whole = F.aggregate(blocks, pair(zero, nones), lambda acc, some: _let(inner(acc["s"], some), lambda x: pair(x["s"], F.concat(acc["o"], F.array(x["o"])))), lambda acc: F.flatten(acc["o"]))
    return F.when(F.size(values) > 0, whole).otherwise(none)


_HIT = "struct<start:int,less:int,priority:int,rank:int,label:string>"
_JUDGED = "struct<start:int,stop:int,priority:int,label:string,dead:boolean>"
_LABEL = "struct<label:string,priority:int,dead:boolean>"


def _intervals(low: Column, rule: Column) -> Column:
    """(start, less, priority, rank, label) of every match of one rule; less is the negative end, for sorting."""

    def step(at: Column, x: Column) -> Column:
        begin = at + F.length(x["gap"])
        stop = begin + F.length(x["hit"])
        own = F.struct(begin.alias("start"), (-stop).alias("less"), rule["priority"].alias("priority"), rule["rank"].alias("rank"), rule["label"].alias("label"))
        return F.struct(stop.alias("s"), own.alias("o"))

    hits = F.regexp_extract_all(low, rule["pattern"], F.lit(0))
    gaps = lambda found: F.slice(F.split(low, rule["pattern"], -1), F.lit(1), F.size(found))
    return _let(hits, lambda found: F.when(F.size(found) > 0, _running(F.arrays_zip(gaps(found).alias("gap"), found.alias("hit")), F.lit(0), _HIT, step)))


def _upto(priority: Column, state: Column, name: str, new: Callable[[Column], Column]) -> Column:
    """The state of priorities up to 1, 2 and 3, with new() applied to those that an interval of this priority concerns."""
    return F.struct(*(F.when(priority <= p, new(state[f"{name}{p}"])).otherwise(state[f"{name}{p}"]).alias(f"{name}{p}") for p in (1, 2, 3)))


def surviving(low: Column) -> Column:
    """Labels and priorities of the detections in a lower-cased text that are not suppressed: array<struct<label, priority, dead>>."""
    kind = "array<struct<label:string,priority:int,keyword:string,pattern:string,rank:int>>"
    known = F.from_json(F.lit(json.dumps([r | {"rank": i} for i, r in enumerate(rules())])), kind)
    active = F.filter(known, lambda r: F.contains(low, r["keyword"]))
    found = F.array_sort(F.flatten(F.filter(F.transform(active, lambda r: _intervals(low, r)), lambda x: x.isNotNull())))
    of = lambda priority, state, name: F.when(priority == 1, state[f"{name}1"]).when(priority == 2, state[f"{name}2"]).otherwise(state[f"{name}3"])

    def forward(state: Column, x: Column) -> Column:  # state: how far earlier intervals reach
        stop = -x["less"]
        above = F.when(x["priority"] == 1, 0).otherwise(of(x["priority"] - 1, state, "reach"))
        dead = (stop <= of(x["priority"], state, "reach")) | (above > x["start"])
        judged = F.struct(x["start"].alias("start"), stop.alias("stop"), x["priority"].alias("priority"), x["label"].alias("label"), dead.alias("dead"))
        return F.struct(_upto(x["priority"], state, "reach", lambda r: F.greatest(r, stop)).alias("s"), judged.alias("o"))

    def backward(state: Column, x: Column) -> Column:  # state: where the next interval starts
        above = F.when(x["priority"] == 1, F.lit(2147483647)).otherwise(of(x["priority"] - 1, state, "next"))
        judged = F.struct(x["label"].alias("label"), x["priority"].alias("priority"), (x["dead"] | (above < x["stop"])).alias("dead"))
        return F.struct(_upto(x["priority"], state, "next", lambda _: x["start"]).alias("s"), judged.alias("o"))

    start = F.struct(*(F.lit(0).alias(f"reach{p}") for p in (1, 2, 3)))
    stop = F.struct(*(F.lit(2147483647).alias(f"next{p}") for p in (1, 2, 3)))
    there = _let(found, lambda x: _running(x, start, _JUDGED, forward))
    back = _let(F.reverse(there), lambda x: _running(x, stop, _LABEL, backward))
    return F.array_distinct(F.filter(back, lambda x: ~x["dead"]))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row of docs (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    gated = low.rlike("|".join(map(re.escape, STEMS)))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.when(F.contains(low, F.lit("license")), F.regexp_extract_all(F.translate(text, upper, lower), F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>"))
    first = columns(docs, "doc_id", "text").select(
        "doc_id", F.regexp_count(text, F.lit(_ANY_WORD)).cast("long").alias("n_words"), words.alias("words"), F.when(gated, surviving(low)).otherwise(F.array().cast(f"array<{_LABEL}>")).alias("kept")
    )
    spots = {label: _spots(F.col("words"), phrase).alias(f"at_{label}") for label, phrase in BASE.items()}
    second = first.select("doc_id", "n_words", "kept", *spots.values())
    places = F.concat(*(F.col(f"at_{label}") for label in BASE))
    base = F.filter(F.array(*(F.when(F.size(f"at_{label}") > 0, F.lit(label)) for label in sorted(BASE))), lambda x: x.isNotNull())
    weight = F.array_max(F.transform("kept", lambda k: F.when(k["priority"] == 1, WEIGHTS[1]).when(k["priority"] == 2, WEIGHTS[2]).otherwise(WEIGHTS[3])))
    return second.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform("kept", lambda k: k["label"]))), ",").alias("labels"),
        F.greatest(F.coalesce(weight, F.lit(0.0)), F.when(F.size(base) > 0, WEIGHTS[2]).otherwise(0.0)).alias("score"),
    )


def _spots(words: Column, phrase: list[str]) -> Column:
    """Where the phrase's words stand one after another."""
    here = lambda i: F.get(words, i) == phrase[0]

    def whole(i: Column) -> Column:
        found = here(i)
        for k, w in enumerate(phrase[1:], 1):
            found = found & (F.get(words, i + k) == w)
        return found

    return F.when(F.size(words) >= len(phrase), F.filter(F.sequence(F.lit(0), F.size(words) - len(phrase)), whole)).otherwise(F.array().cast("array<int>"))
