"""License scans: ordered signature rules behind a keyword prefilter, with overlapping detections resolved.

A text's bytes are lower-cased in A-Z, every ASCII character that is no letter or digit becomes a space, and runs of spaces
shrink to one: the words of the text, joined by single spaces. Three base phrases are counted on every text as words that
stand consecutively.

The rules are regular expressions over that line. Each has a label, a priority and keywords; one Aho-Corasick pass over the
distinct keywords tells which rules can match at all, and only these run. A detection inside another one of the same or a
higher priority is dropped, and of two that overlap otherwise the one of higher priority, then the longer, then the earlier
rule stays. Base labels are never dropped.

Null texts are empty: no words, no labels, score 0. Repeated rows are scanned each. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passplane.llm.base import documents, texts_of

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Weight of one detection by the rule's priority, for the score.
WEIGHT = {3: 0.9, 2: 0.6, 1: 0.3}


@dataclass(frozen=True)
class Rule:
    """A signature: label, expression over the line of words, a keyword that each match contains, and a priority."""

    label: str
    pattern: str
    keyword: str
    priority: int


#: Signatures of single texts: label, expression, keyword, priority. Each is a sentence or name that the text itself has.
SIGNATURES = [
    ("apache-2.0", r"licensed under the apache license version 2 0 the license", "apache license", 3),
    ("apache-2.0", r"you may not use this file except in compliance with the license", "except in compliance", 2),
    ("apache-2.0", r"you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org", 3),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing", "agreed to in writing", 2),
    ("apache-2.0", r"distributed on an as is basis without warranties or conditions of any kind", "as is basis", 2),
    ("apache-2.0", r"www apache org licenses license 2 0(?: txt| html)?", "apache org", 3),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "apache software foundation", 3),
    ("apache-foundation", r"the apache software foundation", "apache software foundation", 1),
    ("mit", r"to deal in the software without restriction", "without restriction", 3),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies", "permission notice", 3),
    ("mit", r"opensource org licenses mit(?: license)?(?: php)?", "opensource org", 3),
    ("mit", r"dual licensed under (?:the )?mit", "dual licensed", 2),
    ("mit-0", r"mit no attribution", "no attribution", 3),
    ("mit-advertising", r"except as contained in this notice the name of", "except as contained", 2),
    ("warranty-disclaimer", r"the software is provided as is without warranty of any kind", "provided as is", 1),
    ("warranty-disclaimer", r"without even the implied warranty of merchantability or fitness for a particular purpose", "implied warranty", 2),
    ("warranty-disclaimer", r"in no event shall the (?:authors|copyright holders|copyright owner|regents)", "in no event", 1),
    ("warranty-disclaimer", r"any express or implied warranties including but not limited to", "implied warranties", 1),
    ("warranty-disclaimer", r"this software is provided by the (?:author|authors|regents|copyright holders)(?: and contributors)?", "this software is provided", 1),
    ("bsd", r"redistributions of source code must retain the above copyright notice", "redistributions of source", 2),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions in binary", 2),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software", "advertising materials", 3),
    ("bsd-2-clause", r"simplified bsd(?: licen[sc]e)?", "simplified bsd", 3),
    ("bsd-2-clause", r"freebsd licen[sc]e", "freebsd", 3),
    ("bsd-3-clause", r"(?:new|modified|revised) bsd(?: licen[sc]e)?", "bsd", 3),
    ("bsd-0-clause", r"(?:0bsd|zero clause bsd|bsd zero clause)(?: licen[sc]e)?", "bsd", 3),
    ("gpl", r"this program is free software you can redistribute it and or modify it", "this program is free", 2),
    ("gpl", r"you should have received a copy of the gnu general public license", "gnu general public", 2),
    ("lgpl", r"you should have received a copy of the gnu lesser general public license", "gnu lesser", 3),
    ("agpl", r"you should have received a copy of the gnu affero general public license", "gnu affero", 3),
    ("gpl", r"free software foundation inc 51 franklin", "free software foundation", 2),
    ("gpl", r"free software foundation inc 59 temple place", "free software foundation", 2),
    ("gpl", r"www gnu org licenses(?: gpl)?(?: \d 0)?(?: html| txt)?", "gnu org", 2),
    ("lgpl", r"www gnu org licenses lgpl(?: \d \d)?(?: html| txt)?", "gnu org", 3),
    ("agpl", r"www gnu org licenses agpl(?: \d 0)?(?: html| txt)?", "gnu org", 3),
    ("gpl-with-classpath-exception", r"(?:with (?:the )?)?classpath exception", "classpath exception", 3),
    ("gpl-with-linking-exception", r"(?:with (?:a |the )?)?(?:special )?linking exception", "linking exception", 3),
    ("gpl-with-gcc-exception", r"gcc runtime library exception", "gcc runtime", 3),
    ("gpl-with-autoconf-exception", r"autoconf (?:configure script )?exception", "autoconf", 3),
    ("gpl-with-font-exception", r"(?:with (?:the )?)?font exception", "font exception", 3),
    ("gfdl", r"permission is granted to copy distribute and or modify this document", "modify this document", 3),
    ("gfdl", r"no invariant sections", "invariant sections", 2),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license", "source code form", 3),
    ("mpl-2.0", r"(?:http|https) mozilla org mpl 2 0", "mozilla org", 3),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license", "contents of this file", 3),
    ("epl-1.0", r"www eclipse org legal epl v10(?: html)?", "eclipse org", 3),
    ("epl-2.0", r"www eclipse org legal epl (?:v20|2 0)(?: html)?", "eclipse org", 3),
    ("edl-1.0", r"eclipse distribution licen[sc]e(?: v(?:ersion)? ?1 0)?", "eclipse distribution", 3),
    ("cpl-1.0", r"common public licen[sc]e(?: (?:v|version )?1 0)?", "common public", 3),
    ("ipl-1.0", r"ibm public licen[sc]e(?: (?:v|version )?1 0)?", "ibm public", 3),
    ("npl-1.1", r"netscape public licen[sc]e(?: (?:v|version )?1 [01])?", "netscape public", 3),
    ("spl-1.0", r"sun public licen[sc]e(?: (?:v|version )?1 0)?", "sun public", 3),
    ("sissl", r"sun industry standards source licen[sc]e", "sun industry", 3),
    ("apsl", r"apple public source licen[sc]e(?: (?:v|version )?\d \d)?", "apple public", 3),
    ("qpl-1.0", r"q public licen[sc]e(?: (?:v|version )?1 0)?", "q public", 3),
    ("lpl-1.02", r"lucent public licen[sc]e(?: (?:v|version )?1 0 ?2?)?", "lucent public", 3),
    ("nokia", r"nokia open source licen[sc]e", "nokia open", 3),
    ("rpl", r"reciprocal public licen[sc]e(?: 1 [15])?", "reciprocal public", 3),
    ("rpsl", r"realnetworks public source licen[sc]e", "realnetworks", 3),
    ("watcom", r"sybase open watcom public licen[sc]e", "watcom", 3),
    ("intel", r"intel open source licen[sc]e", "intel open", 3),
    ("intel-simplified", r"intel simplified software licen[sc]e", "intel simplified", 3),
    ("oracle-bcl", r"oracle binary code licen[sc]e(?: agreement)?", "oracle binary", 3),
    ("oracle-nftc", r"oracle no fee terms and conditions", "no fee terms", 3),
    ("upl-1.0", r"universal permissive licen[sc]e(?: (?:v|version )?1 0)?", "universal permissive", 3),
    ("postgresql", r"postgresql licen[sc]e", "postgresql", 3),
    ("postgresql", r"without a written agreement is hereby granted", "written agreement", 2),
    ("ncsa", r"university of illinois (?:ncsa )?open source licen[sc]e", "university of illinois", 3),
    ("vim", r"vim licen[sc]e", "vim", 2),
    ("curl", r"curl licen[sc]e", "curl", 2),
    ("libpng", r"png reference library licen[sc]e(?: version 2)?", "png reference", 3),
    ("ijg", r"based in part on the work of the independent jpeg group", "independent jpeg", 3),
    ("freetype", r"freetype (?:project )?licen[sc]e", "freetype", 3),
    ("freetype", r"portions of this software are copyright (?:[^ ]+ ){0,6}the freetype project", "freetype", 3),
    ("imagemagick", r"imagemagick licen[sc]e", "imagemagick", 3),
    ("bzip2", r"bzip2 (?:and libbzip2 )?licen[sc]e", "bzip2", 3),
    ("info-zip", r"info zip licen[sc]e", "info zip", 3),
    ("sqlite-blessing", r"the author disclaims copyright to this source code", "disclaims copyright", 3),
    ("sqlite-blessing", r"may you do good and not evil", "not evil", 2),
    ("json", r"the software shall be used for good not evil", "good not evil", 3),
    ("beerware", r"the beer ware licen[sc]e", "beer ware", 3),
    ("beerware", r"you can buy me a beer in return", "buy me a beer", 3),
    ("x11", r"x11 licen[sc]e", "x11", 3),
    ("x-consortium", r"x consortium licen[sc]e", "x consortium", 3),
    ("hpnd", r"historical permission notice and disclaimer", "historical permission", 3),
    ("w3c", r"w3c software (?:and document )?notice and licen[sc]e", "w3c software", 3),
    ("w3c", r"w3c document licen[sc]e", "w3c document", 3),
    ("ogc", r"ogc software licen[sc]e", "ogc software", 3),
    ("tcl", r"tcl tk licen[sc]e", "tcl tk", 3),
    ("perl", r"under the same terms as perl itself", "perl itself", 3),
    ("lppl", r"latex project public licen[sc]e(?: (?:v|version )?1 \d ?[abc]?)?", "latex project", 3),
    ("naumen", r"naumen public licen[sc]e", "naumen", 3),
    ("zpl", r"zope public licen[sc]e(?: (?:v|version )?\d \d)?", "zope public", 3),
    ("cnri-python", r"cnri (?:open source )?licen[sc]e(?: agreement)?", "cnri", 3),
    ("psf", r"psf licen[sc]e(?: agreement)?", "psf", 2),
    ("unicode-dfs", r"unicode (?:data files and software|inc) licen[sc]e(?: agreement)?", "unicode", 3),
    ("icu", r"icu licen[sc]e", "icu", 2),
    ("blueoak-1.0.0", r"blue oak model licen[sc]e(?: 1 0 0)?", "blue oak", 3),
    ("mulan-psl", r"mulan permissive software licen[sc]e(?: (?:v|version )?\d)?", "mulan", 3),
    ("elastic-2.0", r"elastic licen[sc]e(?: (?:v|version )?2 0)?", "elastic licen", 3),
    ("sspl-1.0", r"server side public licen[sc]e(?: (?:v|version )?1)?", "server side public", 3),
    ("busl-1.1", r"business source licen[sc]e(?: 1 1)?", "business source", 3),
    ("commons-clause", r"commons clause(?: licen[sc]e condition)?(?: (?:v|version )?1 0)?", "commons clause", 3),
    ("confluent", r"confluent community licen[sc]e", "confluent", 3),
    ("polyform", r"polyform (?:noncommercial|small business|strict|shield|perimeter|internal use)(?: licen[sc]e)?", "polyform", 3),
    ("parity", r"parity public licen[sc]e", "parity public", 3),
    ("prosperity", r"prosperity public licen[sc]e", "prosperity public", 3),
    ("hippocratic", r"hippocratic licen[sc]e", "hippocratic", 3),
    ("openrail", r"(?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[sc]e)?", "rail", 2),
    ("llama-community", r"llama (?:\d )?community licen[sc]e(?: agreement)?", "community licen", 3),
    ("gemma", r"gemma terms of use", "gemma", 3),
    ("cc0-1.0", r"to the extent possible under law (?:the )?(?:author|authors|person)", "possible under law", 3),
    ("cc0-1.0", r"cc0 public domain dedication", "cc0", 3),
    ("cc", r"some rights reserved", "some rights", 2),
    ("cc", r"this work is licensed under a creative commons", "creative commons", 2),
    ("cc-sampling", r"creative commons sampling plus", "creative commons", 3),
    ("pddl-1.0", r"(?:open data commons )?public domain dedication and licen[sc]e", "domain dedication and", 3),
    ("odc-by-1.0", r"open data commons attribution licen[sc]e", "open data commons", 3),
    ("odbl-1.0", r"openstreetmap contributors", "openstreetmap", 2),
    ("dbcl", r"database contents licen[sc]e", "database contents", 3),
    ("cdla-permissive", r"community data licen[sc]e agreement permissive(?: version)?(?: [12] 0)?", "community data", 3),
    ("cdla-sharing", r"community data licen[sc]e agreement sharing(?: version)?(?: 1 0)?", "community data", 3),
    ("ogl-uk", r"open government licen[sc]e(?: (?:v|version )?[123] 0)?", "open government", 3),
    ("crown-copyright", r"crown copyright", "crown copyright", 2),
    ("us-government-work", r"(?:a )?work of the (?:united states|u s) government", "government", 2),
    ("etalab", r"licence ouverte(?: open licence)?", "licence ouverte", 3),
    ("dl-de-by", r"datenlizenz deutschland (?:namensnennung|zero)", "datenlizenz", 3),
    ("free-art", r"(?:free art licen[sc]e|licence art libre)(?: 1 3)?", "art", 3),
    ("gutenberg", r"project gutenberg(?: tm)? licen[sc]e", "project gutenberg", 3),
    ("gutenberg", r"this ebook is for the use of anyone anywhere", "this ebook", 3),
    ("ofl-1.1", r"this font software is licensed under the sil open font license", "font software", 3),
    ("bitstream-vera", r"bitstream vera fonts? copyright", "bitstream vera", 3),
    ("ubuntu-font", r"ubuntu font licen[sc]e(?: (?:v|version )?1 0)?", "ubuntu font", 3),
    ("gust-font", r"gust font licen[sc]e", "gust font", 3),
    ("adobe-glyph", r"adobe glyph list licen[sc]e", "adobe glyph", 3),
    ("cern-ohl", r"cern open hardware licen[sc]e(?: (?:v|version )?[12](?: [02])?)?(?: (?:permissive|weakly reciprocal|strongly reciprocal))?", "open hardware", 3),
    ("tapr-ohl", r"tapr open hardware licen[sc]e", "tapr", 3),
    ("solderpad", r"solderpad hardware licen[sc]e", "solderpad", 3),
    ("eula", r"end user licen[sc]e agreement", "end user", 2),
    ("eula", r"by (?:installing|using|downloading) (?:this|the) software you (?:agree|accept)", "software you", 2),
    ("trade-secret", r"contains (?:confidential )?trade secrets?", "trade secret", 2),
    ("confidential", r"strictly confidential", "strictly confidential", 2),
    ("confidential", r"do not distribute", "do not distribute", 1),
    ("no-derivatives", r"you may not (?:alter transform or build upon|create derivative works)", "you may not", 2),
    ("no-commercial", r"not for (?:commercial use|resale|sale)", "not for", 2),
    ("no-commercial", r"you may not use (?:this|the) (?:work|material) for commercial purposes", "commercial purposes", 2),
    ("no-commercial", r"commercial use (?:is )?(?:strictly )?prohibited", "commercial use", 2),
    ("no-training", r"may not be used (?:to train|for training) (?:[^ ]+ ){0,4}(?:models?|systems?)", "may not be used", 3),
    ("no-mining", r"text and data mining (?:[^ ]+ ){0,4}(?:reserved|prohibited)", "data mining", 3),
    ("reserved", r"all (?:other )?rights reserved worldwide", "rights reserved", 3),
    ("reserved", r"no part of this (?:publication|book|work) may be reproduced", "no part of this", 3),
    ("reserved", r"unauthori[sz]ed (?:copying|reproduction|use|distribution) (?:[^ ]+ ){0,5}prohibited", "unauthori", 2),
    ("reserved", r"tutti i diritti riservati", "tutti i diritti", 2),
    ("reserved", r"todos os direitos reservados", "todos os direitos", 2),
    ("reserved", r"alle rechten voorbehouden", "alle rechten", 2),
    ("reserved", r"reproduction interdite", "reproduction interdite", 2),
    ("reserved", r"prohibida (?:su|la) reproducción", "prohibida", 2),
    ("reserved", r"nachdruck (?:[^ ]+ ){0,4}verboten", "nachdruck", 2),
    ("press", r"(?:associated press|reuters|agence france presse) all rights reserved", "all rights reserved", 3),
    ("trademark", r"(?:is|are) (?:a )?(?:registered )?trademarks? of", "trademark", 1),
    ("patent", r"patents? pending", "pending", 1),
    ("contributor-agreement", r"contributor licen[sc]e agreement", "contributor licen", 2),
    ("developer-certificate", r"developer certificate of origin", "developer certificate", 2),
    ("public-domain", r"no known copyright restrictions", "no known copyright", 3),
    ("public-domain", r"domaine public", "domaine public", 2),
    ("public-domain", r"dominio público", "dominio", 2),
    ("public-domain", r"gemeinfrei(?:e|es|er)?", "gemeinfrei", 2),
    ("free-use", r"free for (?:any|personal and commercial) use", "free for", 2),
    ("free-use", r"royalty free", "royalty free", 1),
    ("copyleft", r"copyleft", "copyleft", 1),
    ("permission-required", r"with (?:the )?(?:kind )?permission of", "permission of", 1),
    ("permission-required", r"used (?:by|with) permission", "permission", 1),
    ("permission-required", r"reprinted with permission", "reprinted", 2),
    ("unspecified-license", r"see (?:the )?(?:accompanying )?licen[sc]e file(?: for details)?", "licen", 2),
    ("unspecified-license", r"see licen[sc]e (?:txt|md) for details", "licen", 2),
]


def rules() -> list[Rule]:
    """The signatures in order. Families with versions or clauses are written as one expression and expanded by rule."""
    out: list[Rule] = []

    def add(label: str, pattern: str, keyword: str, priority: int) -> None:
        out.append(Rule(label, pattern, keyword, priority))

    # GNU licenses: family, version, scope; in words, as a short name, as an SPDX identifier, and with a later-version clause
    families = [("gpl", r"(?:gnu )?general public licen[sc]e", "general public", ("1", "2", "3")), ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", "general public", ("2", "2 1", "3")), ("agpl", r"(?:gnu )?affero general public licen[sc]e", "affero general", ("1", "3")), ("gfdl", r"(?:gnu )?free documentation licen[sc]e", "free documentation", ("1 1", "1 2", "1 3"))]
    for short, words, keyword, versions in families:
        for version in versions:
            name = f"{short}-{version.replace(' ', '.')}"
            tail = rf"(?:v|version )?{version}(?: 0)?(?! \d)"
            add(f"{name}-or-later", rf"{words} (?:as published by the free software foundation )?(?:either )?{tail} (?:of the licen[sc]e )?or (?:at your option )?(?:any )?later", keyword, 3)
            add(name, rf"{words} (?:as published by the free software foundation )?(?:either )?{tail}", keyword, 3)
            add(f"{name}-or-later", rf"{short} ?{tail} (?:or later|plus)", short, 3)
            add(f"{name}-only", rf"{short} ?{tail} only", short, 3)
            add(name, rf"{short} ?{tail}", short, 2)
        add(short, rf"(?:under|by|with) (?:the )?(?:terms of )?(?:the )?{words}", keyword, 2)
        add(short, words, keyword, 1)
        add(short, rf"(?:under|licen[sc]e[ds]?|by) (?:the |a )?(?:gnu )?{short}", short, 1)
    # Creative Commons: the elements, in letters and in words, with and without a version
    elements = [("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:ative)?s?(?: works)?"), ("by-nc", "attribution non ?commercial"), ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?")]
    for code, words in elements:
        letters = code.replace("-", " ")
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            dotted = version.replace(" ", ".")
            add(f"cc-{code}-{dotted}", rf"cc {letters} {version}", "cc by", 3)
            add(f"cc-{code}-{dotted}", rf"creative commons {words} {version}", "creative commons", 3)
            add(f"cc-{code}-{dotted}", rf"creativecommons org licenses {letters} {version}", "creativecommons", 3)
        add(f"cc-{code}", rf"cc {letters}", "cc by", 2)
        add(f"cc-{code}", rf"creative commons {words}", "creative commons", 2)
    add("cc0-1.0", r"cc0(?: 1 0)?", "cc0", 3)
    add("cc0-1.0", r"creative commons zero", "creative commons", 3)
    add("cc0-1.0", r"creativecommons org publicdomain zero 1 0", "creativecommons", 3)
    add("cc", r"creative commons(?: licen[sc]e)?", "creative commons", 1)
    # Permissive and other licenses: versions after a family name
    for short, words, keyword, versions in [("apache", "apache (?:software )?licen[sc]e", "apache", ("1 0", "1 1", "2 0")), ("mpl", "mozilla public licen[sc]e", "mozilla public", ("1 0", "1 1", "2 0")), ("epl", "eclipse public licen[sc]e", "eclipse public", ("1 0", "2 0")), ("cddl", "common development and distribution licen[sc]e", "common development", ("1 0", "1 1")), ("eupl", "european union public licen[sc]e", "european union", ("1 1", "1 2")), ("artistic", "artistic licen[sc]e", "artistic", ("1 0", "2 0")), ("afl", "academic free licen[sc]e", "academic free", ("2 1", "3 0")), ("osl", "open software licen[sc]e", "open software", ("2 1", "3 0")), ("bsl", "boost software licen[sc]e", "boost software", ("1 0",)), ("odbl", "open database licen[sc]e", "open database", ("1 0",)), ("ofl", "sil open font licen[sc]e", "open font", ("1 0", "1 1")), ("cecill", "cecill", "cecill", ("2 0", "2 1"))]:
        for version in versions:
            dotted = version.replace(" ", ".")
            add(f"{short}-{dotted}", rf"{words} (?:v|version )?{version}", keyword, 3)
            add(f"{short}-{dotted}", rf"{short} ?(?:v|version )?{version}", short, 2)
        add(short, words, keyword, 2)
    for clauses, word in (("2", "two"), ("3", "three"), ("4", "four")):
        add(f"bsd-{clauses}-clause", rf"bsd (?:{clauses}|{word}) clause", "bsd", 3)
        add(f"bsd-{clauses}-clause", rf"(?:{clauses}|{word}) clause bsd", "bsd", 3)
    add("bsd-3-clause", r"neither the name of (?:\S+ ){1,12}may be used to endorse or promote products", "neither the name", 3)
    add("bsd", r"redistribution and use in source and binary forms with or without modification", "redistribution and use", 2)
    add("bsd", r"(?:new |modified |simplified |revised )?bsd (?:style )?licen[sc]e", "bsd", 2)
    add("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby", 3)
    add("mit", r"(?:the |under |x11 )?mit licen[sc]e", "mit", 3)
    add("mit", r"licen[sc]ed under (?:the )?mit", "mit", 2)
    add("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission to use", 3)
    add("isc", r"isc licen[sc]e", "isc", 2)
    add("zlib", r"(?:zlib|libpng) licen[sc]e", "licen", 2)
    add("zlib", r"altered source versions must be plainly marked", "altered source", 3)
    add("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 3)
    add("unlicense", r"the unlicen[sc]e", "unlicen", 2)
    add("wtfpl", r"do what the fuck you want to public licen[sc]e", "you want to public", 3)
    add("wtfpl", r"wtfpl", "wtfpl", 2)
    add("public-domain", r"(?:released |placed |dedicated |is )?(?:in|into|to) the public domain", "public domain", 2)
    add("python-2.0", r"python software foundation licen[sc]e", "python software", 3)
    add("php-3.01", r"php licen[sc]e(?: (?:v|version )?3 01)?", "php", 2)
    add("ruby", r"ruby licen[sc]e", "ruby", 2)
    add("openssl", r"openssl licen[sc]e", "openssl", 2)
    add("ms-pl", r"microsoft public licen[sc]e", "microsoft public", 3)
    add("ms-rl", r"microsoft reciprocal licen[sc]e", "microsoft reciprocal", 3)
    # Notices that reserve or restrict
    add("reserved", r"(?:copyright|c) (?:\S+ ){0,8}all rights reserved", "all rights reserved", 3)
    add("reserved", r"all rights (?:are )?reserved", "all rights", 2)
    for words in ("alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados"):
        add("reserved", words, words, 2)
    add("copyright", r"copyright (?:c )?(?:19|20)\d\d", "copyright", 2)
    add("copyright", r"c 19\d\d(?= [^ ])", "c 19", 1)
    add("copyright", r"c 20\d\d(?= [^ ])", "c 20", 1)
    add("no-reproduction", r"(?:may not|must not|no part of this [^ ]+ may) be (?:reproduced|copied|redistributed)", " be ", 2)
    add("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", "proprietary", 3)
    add("permission-required", r"without (?:the )?(?:prior |express )*(?:written )?(?:permission|consent)", "without", 2)
    add("restricted-use", r"(?:for )?(?:non ?commercial|personal|educational|research|internal) (?:use|purposes?) only", " only", 2)
    add("restricted-use", r"only for (?:non ?commercial|personal|educational|research|internal) (?:use|purposes?)", "only for", 2)
    add("spdx", r"spdx licen[sc]e identifier \S+", "spdx", 1)
    add("unspecified-license", r"(?:licen[sc]ed|released|distributed|available|published) under (?:the |a )?(?:terms of )?(?:\S+ ){0,4}?licen[sc]e", "licen", 1)
    add("unspecified-license", r"licen[sc]ed under", "licen", 1)
    for label, pattern, keyword, priority in SIGNATURES:
        add(label, pattern, keyword, priority)
    return out


_WORDS = bytes(x + 32 if 0x41 <= x <= 0x5A else x if x >= 0x80 or chr(x).isalnum() else 0x20 for x in range(256))


class Scanner:
    """The compiled rules and the automaton of their keywords."""

    def __init__(self) -> None:
        import ahocorasick

        self.rules = rules()
        # words are parted by spaces alone; other white space of Unicode belongs to a word
        self.compiled = [re.compile(rf"(?<![^ ]){r.pattern}(?![^ ])", re.ASCII) for r in self.rules]
        by: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            by.setdefault(r.keyword, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for keyword, own in by.items():
            self.automaton.add_word(keyword, own)
        self.automaton.make_automaton()

    def detections(self, line: str) -> list[tuple[int, int, Rule]]:
        """What stays of the rules' matches on a line of words, as (begin, end, rule), by place."""
        wanted: set[int] = set()
        for _, own in self.automaton.iter(line):
            wanted.update(own)
        return self.resolved(line, wanted) if wanted else []

    def resolved(self, line: str, wanted: Iterable[int]) -> list[tuple[int, int, Rule]]:
        """The matches of some of the rules, without those that overlap better ones."""
        found = [(m.start(), m.end(), i) for i in sorted(wanted) for m in self.compiled[i].finditer(line)]
        # higher priority first, then longer, then the earlier rule; what overlaps a detection that stands goes
        found.sort(key=lambda x: (-self.rules[x[2]].priority, x[0] - x[1], x[2], x[0]))
        # what stands is disjoint, so only the neighbours of a place can overlap it
        starts: list[int] = []
        stay: list[tuple[int, int, int]] = []
        for a, b, i in found:
            at = bisect.bisect_left(starts, a)
            if (at < len(starts) and starts[at] < b) or (at and stay[at - 1][1] > a):
                continue
            starts.insert(at, a)
            stay.insert(at, (a, b, i))
        return [(a, b, self.rules[i]) for a, b, i in stay]


def places(line: bytes, ends: Iterable[int]) -> list[int]:
    """How many spaces lie before each of ascending places; one pass over the line."""
    out, seen, last = [], 0, 0
    for at in ends:
        seen += line.count(b" ", last, at)
        last = at
        out.append(seen)
    return out


_SCANNER: list[Scanner] = []


def scan(docs: DataFrame, spans: bool = False) -> DataFrame:
    """Per row of doc_id, text: words, base places and labels; see op9. spans: also the method's detections by word position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNER:
            _SCANNER.append(Scanner())
        for batch in batches:
            out: dict[str, list] = {x: [] for x in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", *["spans"] * spans)}
            for text in texts_of(batch.column("text")):
                words = text.encode("utf-8", "replace").translate(_WORDS).split(b" ")
                line = b" ".join(filter(None, words))
                padded = b" " + line + b" "
                starts: list[int] = []
                base = set()
                for phrase, label in BASE.items():
                    wanted = b" " + phrase.encode() + b" "
                    found_at, at = [], padded.find(wanted)
                    while at >= 0:
                        found_at.append(at)
                        at = padded.find(wanted, at + 1)
                    if found_at:
                        base.add(label)
                        starts += places(padded, found_at)
                found = _SCANNER[0].detections(line.decode("utf-8"))
                own = {r.label for _, _, r in found}
                clear = 1.0
                for _, _, r in found:
                    clear *= 1 - WEIGHT[r.priority]
                out["n_words"].append(padded.count(b" ") - 1 if line else 0)
                out["n_base"].append(len(starts))
                out["first_word"].append(min(starts) if starts else None)
                out["last_word"].append(max(starts) if starts else None)
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(base | own)))
                out["score"].append(max(0.9 * bool(base), 1 - clear))
                if spans:
                    text_line = line.decode("utf-8")
                    cut = [x for a, b, _ in found for x in (a, b)]
                    at_word = [len(text_line[a:b].split(" ")) - 1 for a, b in zip([0, *cut], cut, strict=False)]
                    word = list(itertools.accumulate(at_word))
                    out["spans"].append([{"first": word[2 * k], "last": word[2 * k + 1], "label": r.label} for k, (_, _, r) in enumerate(found)])
            arrays = [pa.array(out[x], t) for x, t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *out])

    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string())]))
    kinds = [*((x, pa.int64()) for x in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), *[("spans", span)] * spans]
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    if spans:
        schema += ", spans array<struct<first:long,last:long,label:string>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and signatures in every document."""
    return scan(documents(spark, sf_dir))
