"""License scan by ordered signature rules, in SQL functions only.

A text becomes its lower-case words with single spaces. Rules are regular
expressions over that: license names in grants, notices and addresses in their
own words. A rule is only tried where its keywords occur. Detections are intervals of words; one that lies in
an interval of higher priority, or in a longer one of the same, is suppressed.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.registry import query, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Base phrases, whose places are all counted. Fixed values.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Rule:
    priority: int  # larger suppresses smaller
    label: str
    keywords: tuple[str, str]  # both have to occur
    pattern: str  # over words with single spaces
    confidence: float
    name: str = ""  # what all matches hold, if that is less than the pattern


_V = r"(?: version| ver)? ?v? ?"
_CC = "(?:cc|creative commons)"
_GPL = "(?:gnu )?(?:gpl|general public licen[cs]e)"
_LGPL = "(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[cs]e)"
_AGPL = "(?:gnu )?(?:agpl|affero general public licen[cs]e)"
# Label, keyword, pattern of the name. All that a pattern matches holds its keyword.
# A name without a version has a label of its own; the longer match of a version holds it.
NAMES = (
    ("mit", "mit", r"(?:the )?mit(?: x11)? licen[cs]e"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?"),
    ("apache-1.0", "apache", rf"apache(?: software)? licen[cs]e{_V}1 0"),
    ("apache-1.1", "apache", rf"apache(?: software)? licen[cs]e{_V}1 1"),
    ("apache-2.0", "apache", rf"apache(?: software)? licen[cs]e{_V}2(?: 0)?"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e"),
    ("gpl-1.0", "1", rf"{_GPL}{_V}1(?: 0)?"),
    ("gpl-2.0", "2", rf"{_GPL}{_V}2(?: 0)?"),
    ("gpl-3.0", "3", rf"{_GPL}{_V}3(?: 0)?"),
    ("gpl", "g", _GPL),
    ("lgpl-2.0", "2", rf"{_LGPL}{_V}2(?: 0)?"),
    ("lgpl-2.1", "2 1", rf"{_LGPL}{_V}2 1"),
    ("lgpl-3.0", "3", rf"{_LGPL}{_V}3(?: 0)?"),
    ("lgpl", "l", _LGPL),
    ("agpl-3.0", "3", rf"{_AGPL}{_V}3(?: 0)?"),
    ("agpl", "a", _AGPL),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)?"),
    ("bsd", "bsd", r"(?:the )?bsd(?: style)? licen[cs]e"),
    ("mpl-1.0", "1 0", rf"(?:mpl|mozilla public licen[cs]e){_V}1 0"),
    ("mpl-1.1", "1 1", rf"(?:mpl|mozilla public licen[cs]e){_V}1 1"),
    ("mpl-2.0", "2", rf"(?:mpl|mozilla public licen[cs]e){_V}2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("epl-1.0", "eclipse", rf"eclipse public licen[cs]e{_V}1(?: 0)?"),
    ("epl-2.0", "eclipse", rf"eclipse public licen[cs]e{_V}2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public licen[cs]e"),
    ("cddl-1.0", "cddl", rf"cddl{_V}1 0"),
    ("cddl-1.1", "cddl", rf"cddl{_V}1 1"),
    ("cddl", "cddl", r"cddl"),
    ("isc", "isc", r"(?:the )?isc licen[cs]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("artistic-1.0", "artistic", rf"artistic licen[cs]e{_V}1(?: 0)?"),
    ("artistic-2.0", "artistic", rf"artistic licen[cs]e{_V}2(?: 0)?"),
    ("artistic", "artistic", r"artistic licen[cs]e"),
    ("bsl-1.0", "boost", rf"boost software licen[cs]e{_V}1(?: 0)?"),
    ("bsl", "boost", r"boost software licen[cs]e"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "by", rf"{_CC} by(?: \d 0)?"),
    ("cc-by", "attribution", rf"{_CC} attribution(?: \d 0)?"),
    ("cc-by-sa", "by sa", rf"{_CC} by sa(?: \d 0)?"),
    ("cc-by-sa", "attribution share", rf"{_CC} attribution share ?alike(?: \d 0)?"),
    ("cc-by-nc", "by nc", rf"{_CC} by nc(?: \d 0)?"),
    ("cc-by-nc", "attribution non", rf"{_CC} attribution non ?commercial(?: \d 0)?"),
    ("cc-by-nd", "by nd", rf"{_CC} by nd(?: \d 0)?"),
    ("cc-by-nd", "attribution no", rf"{_CC} attribution no ?deriv(?:ative)?s(?: \d 0)?"),
    ("cc-by-nc-sa", "by nc sa", rf"{_CC} by nc sa(?: \d 0)?"),
    ("cc-by-nc-sa", "commercial share", rf"{_CC} attribution non ?commercial share ?alike(?: \d 0)?"),
    ("cc-by-nc-nd", "by nc nd", rf"{_CC} by nc nd(?: \d 0)?"),
    ("cc-by-nc-nd", "commercial no", rf"{_CC} attribution non ?commercial no ?deriv(?:ative)?s(?: \d 0)?"),
    ("eupl-1.0", "eu", rf"(?:eupl|european union public licen[cs]e){_V}1 0"),
    ("eupl-1.1", "eu", rf"(?:eupl|european union public licen[cs]e){_V}1 1"),
    ("eupl-1.2", "eu", rf"(?:eupl|european union public licen[cs]e){_V}1 2"),
    ("eupl", "eu", r"(?:eupl|european union public licen[cs]e)"),
    ("ofl-1.0", "o", rf"(?:sil open font licen[cs]e|ofl){_V}1 0"),
    ("ofl-1.1", "o", rf"(?:sil open font licen[cs]e|ofl){_V}1 1"),
    ("ofl", "o", r"(?:sil open font licen[cs]e|ofl)"),
    ("psf-2.0", "p", rf"(?:psf|python software foundation) licen[cs]e{_V}2"),
    ("psf", "p", r"(?:psf|python software foundation) licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("ms-pl", "public", r"microsoft public licen[cs]e"),
    ("public-domain", "public domain", r"public domain"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
)
# Priority, keyword, what stands before and after the name, confidence.
WORDINGS = (
    (6, "spdx", "spdx license identifier ", "", 0.99),
    (5, "under the terms", r"(?:licen[cs]ed|released|distributed|published|available|made available) under the terms of (?:the )?", "", 0.97),
    (4, "licen", r"(?:dual |re)?licen[cs]ed under (?:the |a |an )?", "", 0.95),
    (4, "under", r"(?:released|distributed|published|available|provided|covered) under (?:the |a |an )?", "", 0.93),
    (3, "subject to", r"subject to (?:the terms of )?(?:the )?", "", 0.9),
    (2, "see", "", r" see(?: the)?(?: file)?(?: licen[cs]e)?", 0.8),
    (2, "found", "", r" (?:as found in|which can be found)(?: the)?(?: file)?(?: licen[cs]e)?", 0.8),
    (1, "", "", "", 0.6),
)
_FREE = "you can redistribute it and or modify it under the terms of the gnu"
_LATER = "as published by the free software foundation either version"
_OPTION = "of the license or at your option any later version"
# Confidence, label, pattern: grants, headers and exceptions in their own words.
TEXTS = (
    (0.98, "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (0.95, "isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    (0.96, "curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that"),
    (0.95, "hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted"),
    (0.97, "postgresql", "for any purpose without fee and without a written agreement is hereby granted"),
    (0.98, "bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    (0.97, "unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    (0.97, "unicode-3.0", "permission is hereby granted free of charge to any person obtaining a copy of data files and any associated documentation"),
    (0.97, "ofl-1.1", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    (0.9, "bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    (0.9, "bsd", "redistributions of source code must retain the above copyright notice"),
    (0.9, "bsd", "redistributions in binary form must reproduce the above copyright notice"),
    (0.95, "bsd-3-clause", "nor the names of (?:its|their|the) contributors may be used to endorse or promote products derived from this software"),
    (0.95, "bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    (0.95, "zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    (0.98, "apache-2.0", "you may not use this (?:file|work|software) except in compliance with the licen[cs]e you may obtain a copy of the licen[cs]e at https? www apache org"),
    (0.97, "apache-2.0", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    (0.85, "apache-1.1", "this product includes software developed by the apache (?:group|software foundation)"),
    (0.98, "gpl-2.0-or-later", f"{_FREE} general public license {_LATER} 2 {_OPTION}"),
    (0.98, "gpl-3.0-or-later", f"{_FREE} general public license {_LATER} 3 {_OPTION}"),
    (0.98, "lgpl-2.0-or-later", f"{_FREE} library general public license {_LATER} 2 {_OPTION}"),
    (0.98, "lgpl-2.1-or-later", f"{_FREE} lesser general public license {_LATER} 2 1 {_OPTION}"),
    (0.98, "lgpl-3.0-or-later", f"{_FREE} lesser general public license {_LATER} 3 {_OPTION}"),
    (0.98, "agpl-3.0-or-later", f"{_FREE} affero general public license {_LATER} 3 {_OPTION}"),
    (0.97, "gpl-2.0-only", f"{_FREE} general public license version 2 as published by the free software foundation"),
    (0.97, "gpl-3.0-only", f"{_FREE} general public license version 3 as published by the free software foundation"),
    (0.95, "gpl-2.0-or-later", f"{_GPL}{_V}2(?: 0)? or(?: at your option)?(?: any)? (?:later|newer)(?: version)?"),
    (0.95, "gpl-3.0-or-later", f"{_GPL}{_V}3(?: 0)? or(?: at your option)?(?: any)? (?:later|newer)(?: version)?"),
    (0.95, "lgpl-2.1-or-later", f"{_LGPL}{_V}2 1 or(?: at your option)?(?: any)? (?:later|newer)(?: version)?"),
    (0.95, "lgpl-3.0-or-later", f"{_LGPL}{_V}3(?: 0)? or(?: at your option)?(?: any)? (?:later|newer)(?: version)?"),
    (0.95, "agpl-3.0-or-later", f"{_AGPL}{_V}3(?: 0)? or(?: at your option)?(?: any)? (?:later|newer)(?: version)?"),
    (0.95, "gpl-2.0-only", f"{_GPL}{_V}2(?: 0)? only"),
    (0.95, "gpl-3.0-only", f"{_GPL}{_V}3(?: 0)? only"),
    (0.95, "lgpl-2.1-only", f"{_LGPL}{_V}2 1 only"),
    (0.95, "agpl-3.0-only", f"{_AGPL}{_V}3(?: 0)? only"),
    (0.96, "gpl-2.0-with-classpath-exception", f"{_GPL}{_V}2(?: 0)? with(?: the)? classpath exception"),
    (0.96, "gpl-3.0-with-gcc-exception", f"{_GPL}{_V}3(?: 0)? with(?: the)? gcc(?: runtime library)? exception"),
    (0.96, "gpl-2.0-with-font-exception", f"{_GPL}{_V}2(?: 0)? with(?: the)? font exception"),
    (0.96, "gpl-with-openssl-exception", f"{_GPL} with(?: the)? openssl(?: linking)? exception"),
    (0.96, "gpl-with-linking-exception", f"{_GPL} with(?: a| the)? linking exception"),
    (0.94, "gpl", "everyone is permitted to copy and distribute verbatim copies of this license document"),
    (0.97, "gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    (0.98, "mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (0.97, "mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    (0.97, "mpl-1.0", "the contents of this file are subject to the mozilla public license version 1 0"),
    (0.95, "mpl-2.0-no-copyleft-exception", "this source code form is incompatible with secondary licenses"),
    (0.97, "epl-1.0", "the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    (0.97, "epl-2.0", "the accompanying materials are made available under the terms of the eclipse public license(?: v)? ?2 0"),
    (0.96, "cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    (0.97, "unlicense", "this is free and unencumbered software released into the public domain"),
    (0.96, "unlicense", "dedicate any and all copyright interest in the software to the public domain"),
    (0.9, "public-domain", "(?:placed|released|put) (?:in|into|to) the public domain"),
    (0.9, "public-domain", "dedicated to the public domain"),
    (0.96, "wtfpl", "do what the fuck you want to public license"),
    (0.95, "beerware", "the beer ?ware license"),
    (0.95, "perl", "you can redistribute it and or modify it under the same terms as perl itself"),
    (0.9, "proprietary", "unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document|material) (?:is|via any medium is) strictly prohibited"),
    (0.9, "proprietary", "no part of this (?:publication|book|document|work|website) may be reproduced"),
    (0.9, "proprietary", "this software is the confidential and proprietary information of"),
    (0.85, "proprietary", "proprietary and confidential"),
)
# Label, words of an address; punctuation separates words.
ADDRESSES = (
    ("apache-2.0", "apache org licenses license 2 0"),
    ("apache-1.1", "apache org licenses license 1 1"),
    ("apache-1.0", "apache org licenses license 1 0"),
    ("gpl-2.0", "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", "gnu org licenses gpl 3 0"),
    ("lgpl-2.1", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", "gnu org licenses lgpl 3 0"),
    ("agpl-3.0", "gnu org licenses agpl 3 0"),
    ("gfdl-1.3", "gnu org licenses fdl 1 3"),
    ("mit", "opensource org licenses mit(?: license)?"),
    ("bsd-2-clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "opensource org licenses bsd 3 clause"),
    ("isc", "opensource org licenses isc"),
    ("epl-1.0", "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse org legal epl 2 0"),
    ("mpl-2.0", "mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla org mpl mpl 1 1"),
    ("cc-by", r"creativecommons org licenses by \d 0"),
    ("cc-by-sa", r"creativecommons org licenses by sa \d 0"),
    ("cc-by-nc", r"creativecommons org licenses by nc \d 0"),
    ("cc-by-nd", r"creativecommons org licenses by nd \d 0"),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa \d 0"),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd \d 0"),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons org publicdomain mark 1 0"),
)
# Label, pattern of rarer names, which need no wording around them.
RARE_NAMES = (
    ("gfdl-1.1", f"gnu free documentation licen[cs]e{_V}1 1"),
    ("gfdl-1.2", f"gnu free documentation licen[cs]e{_V}1 2"),
    ("gfdl-1.3", f"gnu free documentation licen[cs]e{_V}1 3"),
    ("gfdl", "gnu free documentation licen[cs]e"),
    ("cddl", "common development and distribution licen[cs]e"),
    ("cddl-1.0", f"common development and distribution licen[cs]e{_V}1 0"),
    ("cpl-1.0", f"common public licen[cs]e{_V}1 0"),
    ("cpl", "common public licen[cs]e"),
    ("cpal-1.0", "common public attribution licen[cs]e"),
    ("ipl-1.0", "ibm public licen[cs]e"),
    ("osl-3.0", f"open software licen[cs]e{_V}3(?: 0)?"),
    ("osl", "open software licen[cs]e"),
    ("afl-2.1", f"academic free licen[cs]e{_V}2 1"),
    ("afl-3.0", f"academic free licen[cs]e{_V}3(?: 0)?"),
    ("afl", "academic free licen[cs]e"),
    ("ecl-2.0", f"educational community licen[cs]e{_V}2(?: 0)?"),
    ("ecl", "educational community licen[cs]e"),
    ("ms-rl", "microsoft reciprocal licen[cs]e"),
    ("rpl", "reciprocal public licen[cs]e"),
    ("upl-1.0", "universal permissive licen[cs]e"),
    ("ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
    ("openssl", "openssl licen[cs]e"),
    ("openldap", "openldap public licen[cs]e"),
    ("php", "php licen[cs]e"),
    ("ruby", "ruby licen[cs]e"),
    ("vim", "vim licen[cs]e"),
    ("x11", "x11 licen[cs]e"),
    ("w3c", "w3c software(?: notice and)? licen[cs]e"),
    ("w3c-document", "w3c document licen[cs]e"),
    ("zpl", "zope public licen[cs]e"),
    ("sleepycat", "sleepycat licen[cs]e"),
    ("qpl-1.0", "q(?:t)? public licen[cs]e"),
    ("spl-1.0", "sun public licen[cs]e"),
    ("npl-1.1", f"netscape public licen[cs]e{_V}1 1"),
    ("npl", "netscape public licen[cs]e"),
    ("apsl", "apple public source licen[cs]e"),
    ("rpsl", "realnetworks public source licen[cs]e"),
    ("watcom", "open watcom public licen[cs]e"),
    ("lppl", "latex project public licen[cs]e"),
    ("clartistic", "clarified artistic licen[cs]e"),
    ("imagemagick", "imagemagick licen[cs]e"),
    ("libpng", "libpng licen[cs]e"),
    ("freetype", "freetype(?: project)? licen[cs]e"),
    ("info-zip", "info zip licen[cs]e"),
    ("json", "json licen[cs]e"),
    ("curl", "curl licen[cs]e"),
    ("blueoak", "blue oak model licen[cs]e"),
    ("elastic-2.0", f"elastic licen[cs]e{_V}2(?: 0)?"),
    ("elastic", "elastic licen[cs]e"),
    ("sspl-1.0", "server side public licen[cs]e"),
    ("busl-1.1", "business source licen[cs]e"),
    ("commons-clause", "commons clause licen[cs]e condition"),
    ("polyform-noncommercial", "polyform noncommercial licen[cs]e"),
    ("polyform-shield", "polyform shield licen[cs]e"),
    ("hippocratic", "hippocratic licen[cs]e"),
    ("odbl-1.0", "open (?:data commons open )?database licen[cs]e"),
    ("odc-by", "open data commons attribution licen[cs]e"),
    ("cdla-permissive", "community data licen[cs]e agreement permissive"),
    ("cdla-sharing", "community data licen[cs]e agreement sharing"),
    ("openrail", "open ?rail(?: m)? licen[cs]e"),
    ("llama-2", "llama 2 community licen[cs]e"),
    ("llama-3", "llama 3 community licen[cs]e"),
    ("cern-ohl", "cern open hardware licen[cs]e"),
    ("tapr-ohl", "tapr open hardware licen[cs]e"),
    ("solderpad", "solderpad hardware licen[cs]e"),
    ("ogl-uk", f"open government licen[cs]e(?:{_V}\\d(?: 0)?)?"),
    ("etalab", "etalab open licen[cs]e"),
    ("cecill-b", "cecill b licen[cs]e"),
    ("cecill-c", "cecill c licen[cs]e"),
    ("cecill", "cecill licen[cs]e"),
    ("eiffel", "eiffel forum licen[cs]e"),
    ("lucent", "lucent public licen[cs]e"),
    ("nokia", "nokia open source licen[cs]e"),
    ("intel", "intel open source licen[cs]e"),
    ("miros", "miros licen[cs]e"),
    ("wxwindows", "wxwindows library licen[cs]e"),
    ("nethack", "nethack general public licen[cs]e"),
    ("yahoo", "yahoo public licen[cs]e"),
    ("zimbra", "zimbra public licen[cs]e"),
    ("simple-public", "simple public licen[cs]e"),
    ("fair", "fair licen[cs]e"),
    ("nasa", "nasa open source(?: licen[cs]e)? agreement licen[cs]e"),
    ("eula", "end user licen[cs]e agreement"),
    ("eula", "software licen[cs]e agreement"),
    ("commercial", "(?:under a|requires a|purchase a) commercial licen[cs]e"),
    ("dual", "(?:dual|multi) ?licen[cs]ed"),
)
# What bare words mean after the wording of a grant only.
GRANTED = (
    (0.95, "apache-2.0", f"licen[cs]ed under (?:the )?apache{_V}2(?: 0)?"),
    (0.93, "apache-2.0", f"(?:released|distributed|available) under (?:the )?apache{_V}2(?: 0)?"),
    (0.99, "apache-2.0", "spdx license identifier apache 2 0"),
    (0.95, "mit", "licen[cs]ed under (?:the )?mit"),
    (0.99, "mit", "spdx license identifier mit"),
    (0.99, "isc", "spdx license identifier isc"),
    (0.99, "zlib", "spdx license identifier zlib"),
    (0.99, "epl-1.0", "spdx license identifier epl 1 0"),
    (0.99, "epl-2.0", "spdx license identifier epl 2 0"),
    (0.99, "bsl-1.0", "spdx license identifier bsl 1 0"),
    (0.95, "bsd", "licen[cs]ed under (?:the |a )?bsd"),
)


def keyword_of(pattern: str) -> str:
    """The longest plain text that all strings of a pattern hold, as far as it is outside of groups."""
    while "(" in pattern:
        pattern = re.sub(r"\([^()]*\)\??", "|", pattern)
    return max(re.sub(r"\[[^]]*\]\??|\\d|.\?", "|", pattern).split("|"), key=len)


RULES = (
    *(
        Rule(priority, label, (keyword, wording), before + name + after, confidence, name)
        for label, keyword, name in NAMES
        for priority, wording, before, after, confidence in WORDINGS
    ),
    *(Rule(7, label, (keyword_of(p), ""), p, confidence) for confidence, label, p in TEXTS),
    *(Rule(6 if "spdx" in p else 4, label, (keyword_of(p), ""), p, confidence) for confidence, label, p in GRANTED),
    *(Rule(3, label, (keyword_of(p), ""), p, 0.9) for label, p in ADDRESSES),
    *(Rule(1, label, (keyword_of(p), ""), p, 0.6) for label, p in RARE_NAMES),
)
# A text with none of these in it cannot match any rule. They are looked for in
# the raw text, so each lies within one word.
HINTS = ("licen", "gpl", "bsd", "mpl", "cddl", "wtfpl", "cc", "eupl", "ofl", "apache", "creative", "domain", "reserved", "attribution",
         "hereby", "redistribut", "endorse", "acknowledgement", "misrepresented", "eclipse", "proprietary", "unauthorized",
         "reproduced")
_TOP = max(r.priority for r in RULES)


def lower_ascii(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def _places(line: Column, pattern: Column) -> Column:
    """``array<struct<first, last>>`` of a pattern's matches, in words from 0.

    ``line`` has one space before, between and after its words. Matches do not
    overlap and end at word ends.
    """
    whole = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    empty = F.array().cast("array<struct<first:int,last:int>>")
    pairs = F.arrays_zip(
        F.split(line, whole, -1).alias("gap"), F.regexp_extract_all(line, whole, F.lit(0)).alias("hit")
    )
    walked = F.aggregate(
        F.filter(pairs, lambda p: p["hit"].isNotNull()),
        F.struct(F.lit(-1).alias("seen"), empty.alias("out")),
        lambda a, p: F.struct(
            (a["seen"] + _spaces(p["gap"]) + _spaces(p["hit"])).alias("seen"),
            F.concat(
                a["out"],
                F.array(
                    F.struct(
                        (a["seen"] + _spaces(p["gap"])).alias("first"),
                        (a["seen"] + _spaces(p["gap"]) + _spaces(p["hit"])).alias("last"),
                    )
                ),
            ).alias("out"),
        ),
    )
    return walked["out"]


def _rule_table(rules: tuple[Rule, ...]) -> Column:
    """``array<struct<word, name, rules>>``: the rules by keyword and name, as one constant."""
    groups: dict[tuple[str, str], list[dict]] = {}
    for r in rules:
        own = {"priority": r.priority, "label": r.label, "wording": r.keywords[1], "pattern": r.pattern, "confidence": r.confidence}
        groups.setdefault((r.keywords[0], r.name or r.pattern), []).append(own)
    text = json.dumps([{"word": word, "name": name, "rules": group} for (word, name), group in groups.items()])
    rule = "struct<priority:int,label:string,wording:string,pattern:string,confidence:double>"
    return F.from_json(F.lit(text), f"array<struct<word:string,name:string,rules:array<{rule}>>>")


def detections(line: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All matches of all rules whose keywords occur, in the order of places.

    The wordings of a name are tried where the name itself is found.
    """
    named = F.filter(_rule_table(rules), lambda g: F.contains(line, g["word"]) & F.rlike(line, g["name"]))
    tried = F.filter(F.flatten(F.transform(named, lambda g: g["rules"])), lambda r: F.contains(line, r["wording"]))
    found = F.transform(
        tried,
        lambda r: F.transform(
            _places(line, r["pattern"]),
            # Sorted by start, longest first, then highest priority.
            lambda p: F.struct(
                p["first"].alias("first"), (-p["last"]).alias("minus_last"), (-r["priority"]).alias("minus_priority"),
                r["label"].alias("label"), r["confidence"].alias("confidence"),
            ),
        ),
    )
    return F.array_sort(F.flatten(found))


def kept_labels(found: Column) -> Column:
    """``struct<labels, score>`` of the detections that are not suppressed.

    In this order, what contains a detection comes before it. So one pass that
    remembers the furthest end per priority finds all suppressed ones: those
    within the end of a higher or the same priority. Of equal intervals of the
    same priority all are kept, so ties do not depend on names.
    """
    ends = F.array(*[F.lit(-1)] * _TOP)
    first = F.array(*[F.lit(-1)] * _TOP)
    start = F.struct(
        ends.alias("ends"), first.alias("firsts"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score")
    )

    def step(a: Column, d: Column) -> Column:
        last, priority = -d["minus_last"], -d["minus_priority"]
        place = F.sequence(F.lit(1), F.lit(_TOP))
        covered = F.exists(
            place,
            lambda p: (F.element_at(a["ends"], p) >= last)
            & ((p > priority) | ((p == priority) & ((F.element_at(a["ends"], p) > last) | (F.element_at(a["firsts"], p) < d["first"])))),
        )
        further = F.element_at(a["ends"], priority) < last
        return F.struct(
            F.transform(a["ends"], lambda e, i: F.when((i + 1 == priority) & further, last).otherwise(e)).alias("ends"),
            F.transform(a["firsts"], lambda e, i: F.when((i + 1 == priority) & further, d["first"]).otherwise(e)).alias("firsts"),
            F.when(covered, a["labels"]).otherwise(F.array_union(a["labels"], F.array(d["label"]))).alias("labels"),
            F.when(covered, a["score"]).otherwise(F.greatest(a["score"], d["confidence"])).alias("score"),
        )

    return F.aggregate(found, start, step, lambda a: F.struct(a["labels"], a["score"]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    One row per row of ``docs``; null and empty texts have no words and empty
    labels. ``score`` is the confidence of the surest detection that is kept,
    0.9 for a base phrase, 0 without any.
    """
    low = lower_ascii(F.col("text"))
    likely = F.lit(False)
    for hint in HINTS:
        likely = likely | F.contains(F.col("low"), F.lit(hint))
    words = F.regexp_extract_all("low", F.lit(WORD), F.lit(0))
    line = F.when(likely, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    base = [
        F.when(F.contains("line", F.lit(f" {phrase} ")), _places(F.col("line"), F.lit(phrase))) for phrase, _ in BASE
    ]
    base_names = F.array_compact(F.array(*[F.when(F.size(f"base_{label}") > 0, label) for _, label in BASE]))
    none = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))
    counted = (
        docs.select("doc_id", low.alias("low"))
        .withColumn("words", words)
        .withColumn("line", line)
        .select("doc_id", F.size("words").cast("long").alias("n_words"), "line",
                *[b.alias(f"base_{label}") for b, (_, label) in zip(base, BASE)])
        .withColumn("rules", F.when(F.col("line").isNotNull(), kept_labels(detections(F.col("line"), rules))))
        .withColumn("rules", F.coalesce("rules", none))
        .withColumn("base_labels", base_names)
        .withColumn("starts", F.transform(
            F.flatten(F.array_compact(F.array(*[F.col(f"base_{label}") for _, label in BASE]))), lambda p: p["first"]))
    )
    return counted.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", "rules.labels")), ",").alias("labels"),
        F.greatest(F.col("rules.score"), F.when(F.size("starts") > 0, 0.9).otherwise(0.0)).alias("score"),
    )


@query()
def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents"))
