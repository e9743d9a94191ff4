"""License scan: ordered signature rules over the words of a text, in DataFrame functions only and without a shuffle.

A text becomes its lower-case words with one blank between them. A rule is a regular expression over those words with a
priority, a confidence and a gate and a key, text that every match holds; it runs only where both are found. Of overlapping
detections, one that lies within another of the same or a higher priority is suppressed (interval containment); what then
still overlaps goes by priority.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.arrays import fold_append, let
from pagequarry.llm.base import PLAIN_WORD, ascii_lower

#: The phrases of the contract: label, gate, phrase.
BASE = (("cc-by", " cc ", "cc by"), ("gpl", "licen", "general public license"), ("reserved", "reserv", "all rights reserved"))

#: Families: label, key word of the short name, short name, long name; regular expressions over words.
FAMILIES = (
    ("mit", "mit", "mit(?: x11| expat)?", "mit x11 license"),
    ("apache-1.1", "apache", "apache(?: software)?(?: version| v)? ?1 1", "apache software license version 1 1"),
    ("apache-2.0", "apache", "apache(?: 2| 2 0| v2| version 2| version 2 0)", "apache license version 2(?: 0)?"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|simplified bsd|freebsd)", "2 clause bsd license"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|new bsd|modified bsd)", "3 clause bsd license"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|original bsd)", "4 clause bsd license"),
    ("0bsd", "0bsd", "0bsd", "zero clause bsd license"),
    ("isc", "isc", "isc", "internet systems consortium license"),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib license"),
    ("boost-1.0", "bsl", "bsl 1 0", "boost software license(?: version)?(?: 1 0)?"),
    ("gpl-1.0", "gpl", "gpl ?v?1(?: 0)?(?: only| or later)?", "gnu general public license(?: version| v) ?1"),
    ("gpl-2.0", "gpl", "gpl ?v?2(?: 0)?(?: only| or later)?", "gnu general public license(?: version| v) ?2"),
    ("gpl-3.0", "gpl", "gpl ?v?3(?: 0)?(?: only| or later)?", "gnu general public license(?: version| v) ?3"),
    ("lgpl-2.0", "lgpl", "lgpl ?v?2(?: 0)?(?: only| or later)?", "gnu library general public license"),
    ("lgpl-2.1", "lgpl", "lgpl ?v?2 1(?: only| or later)?", "gnu lesser general public license(?: version| v) ?2 1"),
    ("lgpl-3.0", "lgpl", "lgpl ?v?3(?: 0)?(?: only| or later)?", "gnu lesser general public license(?: version| v) ?3"),
    ("agpl-3.0", "agpl", "agpl ?v?3?(?: 0)?(?: only| or later)?", "gnu affero general public license"),
    ("gfdl", "gfdl", "gfdl(?: 1 [123])?", "gnu free documentation license"),
    ("mpl-1.1", "mpl", "mpl ?v?1 1", "mozilla public license(?: version| v) ?1 1"),
    ("mpl-2.0", "mpl", "mpl ?v?2(?: 0)?", "mozilla public license(?: version| v) ?2(?: 0)?"),
    ("epl-1.0", "epl", "epl ?v?1(?: 0)?", "eclipse public license(?: version| v)? ?1(?: 0)?"),
    ("epl-2.0", "epl", "epl ?v?2(?: 0)?", "eclipse public license(?: version| v)? ?2(?: 0)?"),
    ("cddl-1.0", "cddl", "cddl(?: 1 0)?", "common development and distribution license"),
    ("cpl-1.0", "cpl", "cpl 1 0", "common public license"),
    ("eupl-1.2", "eupl", "eupl(?: v?1 [012])?", "european union public licence"),
    ("artistic-1.0", "artistic", "artistic 1 0", "artistic license 1 0"),
    ("artistic-2.0", "artistic", "artistic 2 0", "artistic license 2 0"),
    ("wtfpl", "wtfpl", "wtfpl", "do what the fuck you want to public license"),
    ("unlicense", "unlicense", "unlicense", "free and unencumbered software released into the public domain"),
    ("ofl-1.1", "ofl", "ofl 1 1", "sil open font license"),
    ("openssl", "openssl", "openssl", "openssl license"),
    ("python-2.0", "psf", "psf(?: 2 0)?", "python software foundation license"),
    ("php-3.01", "php", "php 3 0?1", "php license"),
    ("ruby", "ruby", "ruby license", "ruby license"),
    ("w3c", "w3c", "w3c", "w3c software notice and license"),
    ("ms-pl", "ms", "ms pl", "microsoft public license"),
    ("ms-rl", "ms", "ms rl", "microsoft reciprocal license"),
    ("odbl-1.0", "odbl", "odbl(?: 1 0)?", "open database license"),
    ("odc-by", "odc", "odc by", "open data commons attribution license"),
    ("pddl", "pddl", "pddl", "public domain dedication and license"),
    ("openrail", "openrail", "(?:bigscience )?openrail(?: m)?", "open responsible ai license"),
    ("bsl-1.1", "busl", "busl 1 1", "business source license 1 1"),
    ("sspl-1.0", "sspl", "sspl(?: v?1(?: 0)?)?", "server side public license"),
    ("ecl-2.0", "ecl", "ecl 2 0", "educational community license"),
    ("osl-3.0", "osl", "osl 3 0", "open software license(?: version)?(?: 3 0)?"),
    ("afl-3.0", "afl", "afl 3 0", "academic free license"),
    ("ncsa", "ncsa", "ncsa", "university of illinois ncsa open source license"),
    ("upl-1.0", "upl", "upl 1 0", "universal permissive license"),
    ("cecill-2.1", "cecill", "cecill(?: 2 1)?", "cecill free software license agreement"),
    ("mulan-2.0", "mulan", "mulan psl v?2(?: 0)?", "mulan permissive software license"),
)
#: Creative Commons: suffix of the label, short words, long words.
CC = (
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s?"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
)
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Sentences of license texts and notices: label, priority, text that every match holds, expression.
NOTICES = (
    ("mit", 3, "permission", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 2, "permission", "the above copyright notice and this permission notice shall be included"),
    ("isc", 3, "permission", "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", 3, "redistribut", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 2, "endorse", "may be used to endorse or promote products derived"),
    ("apache-2.0", 3, "licen", "licensed under the apache license"),
    ("apache-2.0", 2, "licen", "apache org licenses license 2 0"),
    ("gpl", 3, "redistribut", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", 2, "licen", "gnu general public license"),
    ("lgpl", 2, "licen", "gnu (?:lesser|library) general public license"),
    ("gpl", 2, "licen", "gnu org licenses"),
    ("warranty-disclaimer", 2, "warrant", "without (?:any )?warranty(?: of any kind)?"),
    ("warranty-disclaimer", 2, "warrant", "is distributed in the hope that it will be useful but without any warranty"),
    ("warranty-disclaimer", 2, "warrant", "without warranties or conditions of any kind"),
    ("cc", 2, "creative", "creative commons"),
    ("cc", 2, "creative", "creativecommons org licenses [a-z]+(?: [a-z]+){0,2}"),
    ("cc0-1.0", 3, " cc0 ", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", 3, "creative", "creativecommons org publicdomain zero"),
    ("public-domain", 2, "domain", "(?:in|into|to) the public domain"),
    ("public-domain", 2, "domain", "public domain dedication"),
    ("public-domain", 1, "domain", "public domain"),
    ("copyright", 1, "copyright", "copyright(?: c)? (?:19|20)[0-9]{2}"),
    ("copyright", 1, "copyright", "copyright (?:by|c)"),
    ("reserved", 2, "reserv", "(?:all|some|no) rights reserved"),
    ("reserved", 2, "reserv", "todos los derechos reservados"),
    ("reserved", 2, "réservés", "tous droits réservés"),
    ("reserved", 2, "vorbehalten", "alle rechte vorbehalten"),
    ("proprietary", 2, "proprietary", "proprietary and confidential"),
    ("proprietary", 2, "reproduced", "(?:may not|no part (?:of this [a-z]+ )?may) be (?:copied|reproduced)"),
    ("proprietary", 2, "permission", "without (?:the )?(?:prior )?written permission"),
    ("free-use", 1, "licen", "(?:free|open) (?:software|content|source) license"),
    ("licensed", 1, "licen", "(?:is|are) licensed under"),
    ("licensed", 1, "licen", "released under (?:the|a) (?:[a-z0-9]+ ){0,4}license"),
    ("copyleft", 1, "copyleft", "copyleft"),
    ("license-file", 1, "licen", "see (?:the )?license(?: file)? for (?:details|more information)"),
    ("spdx", 2, "spdx", "spdx license identifier"),
    ("mit", 3, "permission", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", 2, "warrant", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", 2, "copyright", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit-0", 3, "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction(?: [a-z]+){0,24} and to permit persons to whom the software is furnished to do so the software is provided"),
    ("mit-advertising", 2, "advertis", "the names? of (?:the )?(?:[a-z0-9]+ ){1,6}shall not be used in advertising or otherwise to promote the sale"),
    ("x11", 3, "advertis", "except as contained in this notice the names? of (?:the )?(?:[a-z0-9]+ ){1,6}shall not be used in advertising"),
    ("isc", 2, "warrant", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("isc", 2, "permission", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", 3, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("bsd", 2, "redistribut", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 2, "redistribut", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 3, "endorse", "neither the names? of (?:the )?(?:[a-z0-9]+ ){1,8}nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", 3, "advertis", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", 2, "warrant", "this software is provided by (?:the )?(?:[a-z0-9]+ ){1,8}as is and any express(?:ed)? or implied warranties"),
    ("bsd-clear", 3, "patent", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-style", 1, "license", "(?:use of this source code is )?governed by a bsd style license"),
    ("zlib", 3, "warrant", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", 2, "origin", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 2, "source", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("apache-2.0", 3, "license", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", 2, "license", "you may not use this file except in compliance with the license"),
    ("apache-2.0", 2, "license", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", 3, "patent", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:except as stated in this section )?patent license"),
    ("apache-2.0", 2, "license", "terms and conditions for use reproduction and distribution"),
    ("apache-1.1", 3, "apache", "this product includes software developed by the apache software foundation"),
    ("asf-cla", 2, "license", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("gpl-2.0-or-later", 3, "license", "as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", 3, "license", "as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0-only", 3, "license", "under the terms of the gnu general public license version 2 (?:only )?as published by the free software foundation"),
    ("lgpl-2.1-or-later", 3, "license", "as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl", 3, "redistribut", "redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl-3.0", 3, "redistribut", "redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", 2, "license", "you should have received a copy of the gnu general public license along with this"),
    ("lgpl", 2, "license", "you should have received a copy of the gnu lesser general public license along with this"),
    ("agpl-3.0", 2, "license", "you should have received a copy of the gnu affero general public license along with this"),
    ("gpl", 2, "license", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-3.0", 2, "license", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2.0", 2, "license", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-exception", 2, "exception", "as a special exception(?: [a-z]+){0,12} (?:permission to link|you may|give permission)"),
    ("classpath-exception", 3, "exception", "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gcc-exception", 3, "exception", "gcc runtime library exception"),
    ("gfdl", 3, "license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", 3, "license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", 2, "license", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", 3, "license", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.1", 2, "license", "software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights"),
    ("epl-1.0", 3, "program", "this program and the accompanying materials are made available under the terms of the eclipse public license v ?1 0"),
    ("epl-2.0", 3, "program", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0"),
    ("cddl-1.0", 3, "license", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("unlicense", 3, "software", "this is free and unencumbered software released into the public domain"),
    ("unlicense", 2, "domain", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", 3, "license", "everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("boost-1.0", 3, "license", "distributed under the boost software license version 1 0"),
    ("boost-1.0", 3, "permission", "to use reproduce display distribute execute and transmit the software and to prepare derivative works"),
    ("artistic-2.0", 3, "license", "everyone is permitted to copy and distribute verbatim copies of this license document(?: [a-z]+){0,8} this license establishes the terms under which a given free software package"),
    ("artistic-1.0", 3, "package", "the intent of this document is to state the conditions under which a package may be copied"),
    ("perl", 2, "perl", "under the same terms as perl itself"),
    ("python-2.0", 3, "python", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("openssl", 3, "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ofl-1.1", 3, "font", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", 2, "font", "the fonts and derivatives however cannot be released under any other type of license"),
    ("cc0-1.0", 3, "domain", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0-1.0", 3, "rights", "to the extent possible under law(?: [a-z0-9]+){0,12} (?:has|have) waived all copyright and related or neighbou?ring rights"),
    ("cc-by", 2, "credit", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", 2, "material", "if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("cc-by-nc", 2, "commercial", "you may not use the material for commercial purposes"),
    ("cc-by-nd", 2, "material", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc", 2, "license", "to view a copy of this license visit (?:https? )?(?:www )?creativecommons org"),
    ("wikipedia", 2, "wikipedia", "text is available under the creative commons attribution share ?alike license"),
    ("ms-pl", 3, "license", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("commons-clause", 3, "commons", "(?:the )?commons clause(?: license)? condition"),
    ("elastic-2.0", 3, "elastic", "elastic license(?: version)? 2 0"),
    ("bsl-1.1", 2, "license", "change date(?: [a-z0-9]+){0,6} change license"),
    ("sspl-1.0", 2, "service", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("llama", 3, "llama", "llama (?:[23](?: [0-9])? )?community license(?: agreement)?"),
    ("gemma", 2, "gemma", "gemma terms of use"),
    ("research-only", 2, "research", "for (?:non ?commercial )?research (?:purposes|use) only"),
    ("non-commercial", 2, "commercial", "(?:free )?for (?:personal and )?non ?commercial use(?: only)?"),
    ("evaluation", 2, "evaluation", "for evaluation purposes only"),
    ("proprietary", 3, "confidential", "this (?:software|document|file) (?:is|contains) (?:the )?(?:confidential and proprietary|proprietary and confidential)(?: information)?"),
    ("proprietary", 2, "unauthori", "unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: [a-z]+){0,8} (?:is )?(?:strictly )?prohibited"),
    ("proprietary", 2, "trade", "trade secrets? (?:of|and)"),
    ("eula", 2, "agreement", "end user licen[cs]e agreement"),
    ("eula", 1, "agreement", "by (?:installing|using|downloading)(?: [a-z]+){0,6} you agree to(?: be bound by)? the terms"),
    ("terms", 1, "terms", "terms (?:of (?:use|service)|and conditions) apply"),
    ("no-ai", 2, "training", "may not be used (?:for|in) (?:the )?training(?: of)? (?:[a-z]+ ){0,4}(?:ai|machine learning|language models?)"),
    ("no-mining", 2, "mining", "(?:all )?rights(?: [a-z]+){0,6} (?:text and )?data mining(?: [a-z]+){0,6} reserved"),
    ("reprint", 1, "permission", "reprinted (?:here )?(?:with|by) (?:kind )?permission"),
    ("us-government", 2, "government", "work of the (?:u s|united states) government"),
    ("crown", 2, "crown", "crown copyright"),
    ("ogl-uk", 3, "government", "open government licen[cs]e(?: v ?[123](?: 0)?)?"),
    ("etalab", 3, "licence", "licence ouverte(?: etalab| open licence)?"),
    ("dl-de", 3, "datenlizenz", "datenlizenz deutschland (?:namensnennung|zero)(?: version)?(?: 2 0)?"),
    ("licensed", 1, "lizen", "(?:steht|veröffentlicht) unter (?:der|einer) (?:[a-z0-9]+ ){0,4}lizenz"),
    ("licensed", 1, "licen", "(?:distribué|publié|diffusé) sous (?:la )?licence"),
    ("licensed", 1, "licen", "(?:publicado|distribuido) bajo (?:la )?licencia"),
)
_CONFIDENCE = {1: 0.5, 2: 0.8, 3: 0.95}


def rules() -> list[tuple[str, int, str, str, str]]:
    """All rules in order: label, priority, gate, key, expression.

    The gate and the key are both text that every match holds. Gates are few and looked for in every text; keys only in
    texts that hold the rule's gate; the expression is tried where the key is found too.
    """
    out = [(label, p, key, key, x) for label, p, key, x in NOTICES]
    for label, key, short, long in FAMILIES:
        out.append((label, 3, "spdx", key, f"spdx license identifier {short}"))
        out.append((label, 2, "licen", key, f"(?:the )?{short} licen[cs]ed?"))
        out.append((label, 2, "licen", key, f"licensed under (?:the )?(?:terms of (?:the )?)?{short}"))
        out.append((label, 2, "licen", key, f"license {short}"))
        gate = "licen" if "licen" in long else "domain"
        out.append((label, 3, gate, _literal(long), f"(?:the )?{long}"))
    for (label, short, long), version in product(CC, CC_VERSIONS):
        number = version.replace(" ", ".")
        out.append((f"{label}-{number}", 3, " cc ", f"cc {short} {version}", f"cc {short} {version}"))
        out.append((f"{label}-{number}", 3, "creative", "creative commons attribution", f"creative commons {long} {version}(?: [a-z]+)? licen[cs]e"))
    for label, short, long in CC:
        out.append((label, 2, " cc ", f"cc {short}", f"cc {short}(?: licen[cs]e)?"))
        out.append((label, 2, "creative", "creative commons attribution", f"creative commons {long}"))
        out.append((label, 2, "licen", f"licenses {short}", f"licenses {short}"))
    return out


def _literal(long: str) -> str:
    """The longest word that stands in every match of a long name."""
    return max((w for w in long.split() if w.isalnum()), key=len)


def normal_words(text: Column) -> Column:
    """' w1 w2 ... wn ': the words, with a blank before, between and after; a single blank if there are none."""
    lower = ascii_lower(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")))
    return F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++", " ")


def _rule_table(extra: list) -> Column:
    """An array of structs, one per rule; a constant."""
    rows = [(label, 0, gate, phrase, phrase, True, 0.0) for label, gate, phrase in BASE] + [(*r, False, _CONFIDENCE[r[1]]) for r in rules() + extra]
    return F.array(
        *[
            F.struct(F.lit(i).alias("no"), F.lit(a).alias("label"), F.lit(p).alias("priority"), F.lit(g).alias("gate"), F.lit(k).alias("key"), F.lit(f"(?<= )(?:{x})(?= )").alias("rx"), F.lit(base).alias("base"), F.lit(c).alias("confidence"))
            for i, (a, p, g, k, x, base, c) in enumerate(rows)
        ]
    )


_HIT = "struct<first:bigint,minus_last:bigint,minus_priority:int,no:int,label:string,base:boolean,confidence:double>"


def _blanks(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def _places(norm: Column, rule: Column) -> Column:
    """First and last word of each match: the blanks before it and in it are counted, stretch by stretch."""
    matches = F.regexp_extract_all(norm, rule["rx"], F.lit(0))
    gaps = F.split(norm, rule["rx"], -1)
    both = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(_blanks(g).alias("before"), _blanks(m).alias("inside")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        first = at + x["before"]  # blanks; one of them stands before the first word
        one = F.struct(
            (first - 1).alias("first"), (1 - first - x["inside"]).alias("minus_last"), (-rule["priority"]).alias("minus_priority"), rule["no"].alias("no"), rule["label"].alias("label"), rule["base"].alias("base"), rule["confidence"].alias("confidence")
        )
        return first + x["inside"], F.array(one)

    return let(both, lambda x: fold_append(x, F.lit(0).cast("long"), step, _HIT))


def _resolved(hits: Column) -> Column:
    """Detections in order of (first, -last, -priority, rule), without those that another resolves.

    Containment: whatever holds a detection comes before it in this order, so the largest last word so far of each priority
    decides. Priority: of two that overlap, the one of lower priority goes. Two sweeps: the furthest last word of a higher
    priority before, the next first word of a higher priority after.
    """
    far, none, nothing = F.lit(1 << 62).cast("long"), F.lit(-1).cast("long"), F.array().cast(f"array<{_HIT}>")

    def contained(reach: Column, x: Column) -> tuple[Column, Column]:
        last, rank = -x["minus_last"], -x["minus_priority"]
        own = F.when(rank == 1, reach["e1"]).when(rank == 2, reach["e2"]).otherwise(reach["e3"])
        grown = F.struct(*[F.when(rank >= k, F.greatest(reach[f"e{k}"], last)).otherwise(reach[f"e{k}"]).alias(f"e{k}") for k in (1, 2, 3)])
        return grown, F.when(own >= last, nothing).otherwise(F.array(x))

    def forth(ends: Column, x: Column) -> tuple[Column, Column]:
        last, rank = -x["minus_last"], -x["minus_priority"]
        above = F.when(rank == 1, ends["e2"]).when(rank == 2, ends["e3"]).otherwise(none)
        grown = F.struct(*[F.when(rank >= k, F.greatest(ends[f"e{k}"], last)).otherwise(ends[f"e{k}"]).alias(f"e{k}") for k in (2, 3)])
        return grown, F.array(F.struct(x.alias("x"), (above >= x["first"]).alias("lost")))

    def back(starts: Column, y: Column) -> tuple[Column, Column]:
        x, rank = y["x"], -y["x"]["minus_priority"]
        above = F.when(rank == 1, starts["s2"]).when(rank == 2, starts["s3"]).otherwise(far)
        grown = F.struct(*[F.when(rank >= k, F.least(starts[f"s{k}"], x["first"])).otherwise(starts[f"s{k}"]).alias(f"s{k}") for k in (2, 3)])
        return grown, F.when(y["lost"] | (above <= -x["minus_last"]), nothing).otherwise(F.array(x))

    ends = lambda *ks: F.struct(*[none.alias(f"e{k}") for k in ks])
    starts = F.struct(far.alias("s2"), far.alias("s3"))
    outer = let(F.array_sort(hits), lambda x: fold_append(x, ends(1, 2, 3), contained, _HIT))
    swept = let(outer, lambda x: fold_append(x, ends(2, 3), forth, f"struct<x:{_HIT},lost:boolean>"))
    return F.reverse(let(F.reverse(swept), lambda x: fold_append(x, starts, back, _HIT)))


def scan(docs: DataFrame, extra_rules: list | None = None) -> DataFrame:
    """doc_id, n_words, base (places of the contract's phrases), detections (after suppression); one row per input row.

    Null and empty texts have no words and no detections; repeated rows are scanned each by itself; other columns are
    ignored. extra_rules: more rules as rules() gives them. Whole texts are scanned, whatever their length.
    """
    gates = sorted({g for _, g, _ in BASE} | {r[2] for r in rules() + (extra_rules or [])})
    norm = docs.select("doc_id", normal_words(F.col("text")).alias("norm"))
    has = F.array_compact(F.array(*[F.when(F.contains(F.col("norm"), F.lit(g)), g) for g in gates]))
    found = norm.withColumn("gates", has)
    n_words = F.length("norm") - F.length(F.replace(F.col("norm"), F.lit(" "), F.lit(""))) - 1
    table = _rule_table(extra_rules or [])
    due = F.filter(table, lambda r: F.array_contains(F.col("gates"), r["gate"]) & F.contains(F.col("norm"), r["key"]) & F.regexp_like(F.col("norm"), r["rx"]))
    hits = F.flatten(F.transform(due, lambda r: _places(F.col("norm"), r)))
    found = found.select("doc_id", F.greatest(n_words, F.lit(0)).cast("long").alias("n_words"), F.when(F.size("gates") > 0, hits).alias("hits"))
    part = found.select("doc_id", "n_words", F.filter("hits", lambda x: x["base"]).alias("base"), F.filter("hits", lambda x: ~x["base"]).alias("own"))
    kept = F.transform(
        _resolved(F.col("own")),
        lambda x: F.struct(x["label"].alias("label"), (-x["minus_priority"]).alias("priority"), x["confidence"].alias("confidence"), x["first"].alias("first_word"), (-x["minus_last"]).alias("last_word")),
    )
    return part.select("doc_id", "n_words", "base", F.when(F.size("own") > 0, kept).alias("detections"))


def license_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns from scan(): places and labels of the base phrases, and the labels that the rules add."""
    s = scan(docs)
    none = F.array().cast("array<string>")
    base_labels = F.coalesce(F.array_distinct(F.transform("base", lambda x: x["label"])), none)
    added = F.coalesce(F.transform("detections", lambda x: x["label"]), none)
    starts = F.transform("base", lambda x: x["first"])
    return s.select(
        "doc_id",
        "n_words",
        F.greatest(F.size(F.coalesce("base", F.array().cast(s.schema["base"].dataType))), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, added))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda x: x["confidence"])), F.lit(0.0)).alias("score"),
    )
