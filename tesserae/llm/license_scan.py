"""License scans: ordered signature rules gated by keywords, with priority and containment suppression.

Texts are first brought to single-spaced lower-case words. A document that holds none of the gate
words is done. In others the rules filed under each keyword found are tried, a pattern compiled once
for a task; a rule is filed under a keyword for each of its alternatives, so that every match holds
one. Detections become intervals; an interval is suppressed by a longer one that contains it, or by
an equal one of higher priority (listed earlier). It is all one projection: rows stay where they are.

Defined results: null and empty texts have no words and no detections; repeated rows are judged one
by one; an empty table gives an empty one; of equal intervals the rule listed first stays; very long
texts and texts with many thousand detections take time in proportion to their length; columns added
by `scan` are prefixed `lic_`, so others may have any other name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import CHUNK, MARKS, ascii_lower, count_words, let, match_spans

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Names as they read once a text is single-spaced lower-case words: (label, gate keywords, regex of the name, tag of a machine-readable notice)
V = r"(?: version| v)? ?"
FAMILIES = (
    ("mit", "mit", r"mit", r"mit"),
    ("mit-0", "mit", r"mit no attribution", r"mit 0"),
    ("x11", "x11", r"x11", r"x11"),
    ("isc", "isc", r"isc", r"isc"),
    ("apache-1.1", "apache", rf"apache(?: software)? license{V}1 1", r"apache 1 1"),
    ("apache-2.0", "apache", rf"apache(?: software)? (?:license|licence){V}2(?: 0)?", r"apache 2 0"),
    ("gpl-1.0", "gnu", rf"gnu general public (?:license|licence){V}1(?: 0)?", r"gpl 1 0"),
    ("gpl-2.0", "gnu", rf"gnu general public (?:license|licence){V}2(?: 0)?", r"gpl 2 0"),
    ("gpl-3.0", "gnu", rf"gnu general public (?:license|licence){V}3(?: 0)?", r"gpl 3 0"),
    ("lgpl-2.0", "lesser library", rf"gnu (?:lesser|library) general public (?:license|licence){V}2(?: 0)?", r"lgpl 2 0"),
    ("lgpl-2.1", "lesser", rf"gnu lesser general public (?:license|licence){V}2 1", r"lgpl 2 1"),
    ("lgpl-3.0", "lesser", rf"gnu lesser general public (?:license|licence){V}3(?: 0)?", r"lgpl 3 0"),
    ("agpl-1.0", "affero", rf"affero general public (?:license|licence){V}1(?: 0)?", r"agpl 1 0"),
    ("agpl-3.0", "affero", rf"(?:gnu )?affero general public (?:license|licence){V}3(?: 0)?", r"agpl 3 0"),
    ("fdl-1.3", "documentation", rf"gnu free documentation (?:license|licence){V}1 3", r"gfdl 1 3"),
    ("fdl-1.2", "documentation", rf"gnu free documentation (?:license|licence){V}1 2", r"gfdl 1 2"),
    ("bsd-0", "bsd 0bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)", r"0bsd"),
    ("bsd-2-clause", "bsd freebsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)", r"bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)", r"bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)", r"bsd 4 clause"),
    ("mpl-1.0", "mozilla", rf"mozilla public (?:license|licence){V}1 0", r"mpl 1 0"),
    ("mpl-1.1", "mozilla", rf"mozilla public (?:license|licence){V}1 1", r"mpl 1 1"),
    ("mpl-2.0", "mozilla", rf"mozilla public (?:license|licence){V}2(?: 0)?", r"mpl 2 0"),
    ("epl-1.0", "eclipse", rf"eclipse public (?:license|licence){V}1(?: 0)?", r"epl 1 0"),
    ("epl-2.0", "eclipse", rf"eclipse public (?:license|licence){V}2(?: 0)?", r"epl 2 0"),
    ("cddl-1.0", "cddl common", r"common development and distribution (?:license|licence)|cddl", r"cddl 1 0"),
    ("cpl-1.0", "common", rf"common public (?:license|licence){V}1(?: 0)?", r"cpl 1 0"),
    ("eupl-1.1", "union", rf"european union public (?:license|licence){V}1 1", r"eupl 1 1"),
    ("eupl-1.2", "union", rf"european union public (?:license|licence){V}1 2", r"eupl 1 2"),
    ("artistic-1.0", "artistic", rf"artistic (?:license|licence){V}1 0", r"artistic 1 0"),
    ("artistic-2.0", "artistic", rf"artistic (?:license|licence){V}2 0", r"artistic 2 0"),
    ("boost-1.0", "boost", r"boost software (?:license|licence)", r"bsl 1 0"),
    ("zlib", "zlib", r"zlib", r"zlib"),
    ("libpng", "libpng", r"libpng", r"libpng 2 0"),
    ("openssl", "openssl", r"openssl", r"openssl"),
    ("python-2.0", "python", r"python software foundation (?:license|licence)", r"psf 2 0"),
    ("php-3.01", "php", r"php (?:license|licence)", r"php 3 01"),
    ("ruby", "ruby", r"ruby (?:license|licence)", r"ruby"),
    ("unlicense", "unlicense", r"unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl", r"wtfpl"),
    ("postgresql", "postgresql", r"postgresql (?:license|licence)", r"postgresql"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source (?:license|licence)", r"ncsa"),
    ("ms-pl", "microsoft", r"microsoft public (?:license|licence)", r"ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal (?:license|licence)", r"ms rl"),
    ("afl-3.0", "academic", r"academic free (?:license|licence)", r"afl 3 0"),
    ("osl-3.0", "open", r"open software (?:license|licence)", r"osl 3 0"),
    ("ofl-1.1", "font", r"(?:sil )?open font (?:license|licence)", r"ofl 1 1"),
    ("odbl-1.0", "database", r"open database (?:license|licence)", r"odbl 1 0"),
    ("odc-by", "attribution", r"open data commons attribution (?:license|licence)", r"odc by 1 0"),
    ("pddl", "domain", r"public domain dedication (?:and|&) (?:license|licence)", r"pddl 1 0"),
    ("cc0-1.0", "cc0 commons", r"cc0(?: 1 0)?|creative commons zero", r"cc0 1 0"),
    ("bsl-1.1", "business", r"business source (?:license|licence)", r"busl 1 1"),
    ("elastic-2.0", "elastic", r"elastic (?:license|licence)", r"elastic 2 0"),
    ("sspl-1.0", "server", r"server side public (?:license|licence)", r"sspl 1 0"),
    ("upl-1.0", "universal", r"universal permissive (?:license|licence)", r"upl 1 0"),
    ("mulan-2.0", "mulan", r"mulan (?:psl|permissive software (?:license|licence))", r"mulanpsl 2 0"),
    ("vim", "vim", r"vim (?:license|licence)", r"vim"),
    ("zpl-2.1", "zope", r"zope public (?:license|licence)", r"zpl 2 1"),
    ("w3c", "w3c", r"w3c software notice and (?:license|licence)", r"w3c"),
    ("beerware", "beer beerware", r"beer ?ware (?:license|licence)", r"beerware"),
)
CC = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
# Wording of the texts themselves: (label, gate keyword, regex)
TEXTS = (
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("gpl", "redistribute", r"redistribute it and or modify it under the terms of the gnu general public (?:license|licence)"),
    ("lgpl", "redistribute", r"redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public (?:license|licence)"),
    ("agpl", "redistribute", r"redistribute it and or modify it under the terms of the gnu affero general public (?:license|licence)"),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license"),
    ("boost-1.0", "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "domain", r"(?:released|dedicated|placed) (?:in|into|to) the public domain"),
    ("proprietary", "reserved", r"all rights reserved"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public (?:license|licence)"),
    ("gpl-3.0", "gnu", r"gnu gpl ?v?3"),
    ("gpl-2.0", "gnu", r"gnu gpl ?v?2"),
    ("mit", "permission", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("ncsa", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("mit", "warranty", r"the software is provided as is without warranty of any kind express or implied"),
    ("isc", "permission", r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "warranties", r"the software is provided as is and the author disclaims all warranties"),
    ("isc", "permission", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("ntp", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("hpnd", "permission", r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("postgresql", "permission", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("tcl", "permission", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("fdl", "permission", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation (?:license|licence)"),
    ("fsf-all-permissive", "permission", r"copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this permission notice|copying with this permission notice"),
    ("gpl-exception", "permission", r"as a special exception the copyright holders of this (?:library|program) give you permission to link"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("sleepycat", "redistributions", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("bsd-3-clause", "copyright", r"neither the name of the copyright holder nor the names of its contributors"),
    ("bsd-3-clause", "regents", r"neither the name of the university nor the names of its contributors may be used by the regents|the regents of the university of california all rights"),
    ("bsd", "warranties", r"this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("x11", "advertising", r"shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("apache-2.0", "license", r"software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2.0", "apache", r"apache org licenses license 2 0"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation"),
    ("apache", "asf", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("gpl", "redistribute", r"this program is free software you can redistribute it"),
    ("lgpl", "redistribute", r"this library is free software you can redistribute it"),
    ("gpl-2.0-or-later", "license", r"either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "license", r"either version 3 of the license or at your option any later version"),
    ("lgpl-2.1-or-later", "license", r"either version 2 1 of the license or at your option any later version"),
    ("gpl", "gnu", r"you should have received a copy of the gnu general public (?:license|licence)"),
    ("lgpl", "gnu", r"you should have received a copy of the gnu (?:lesser|library) general public (?:license|licence)"),
    ("agpl", "gnu", r"you should have received a copy of the gnu affero general public (?:license|licence)"),
    ("gpl", "gnu", r"gnu org licenses (?:old licenses )?gpl"),
    ("lgpl", "gnu", r"gnu org licenses (?:old licenses )?lgpl"),
    ("agpl", "gnu", r"gnu org licenses agpl"),
    ("gpl-classpath", "gnu", r"gnu classpath exception|gpl with the gnu classpath"),
    ("mpl", "mozilla", r"the contents of this file are subject to the mozilla public (?:license|licence)"),
    ("mpl-2.0", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl", "eclipse", r"made available under the terms of the eclipse public (?:license|licence)"),
    ("cddl-1.0", "common", r"subject to the terms of the common development and distribution (?:license|licence)"),
    ("boost-1.0", "boost", r"distributed under the boost software (?:license|licence)"),
    ("zlib", "warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("unlicense", "compile", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "copyright", r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate"),
    ("wtfpl", "fuck", r"do what the fuck you want to"),
    ("cc0-1.0", "copyright", r"waived all copyright and related or neighboring rights"),
    ("cc-by", "commons", r"this work is licensed under a creative commons attribution"),
    ("commons-clause", "commons", r"commons clause (?:license|licence) condition"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font (?:license|licence)"),
    ("perl", "perl", r"(?:under )?the same terms as perl itself"),
    ("python-2.0", "python", r"psf license agreement for python"),
    ("php-3.01", "php", r"this product includes php software freely available from"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("ssleay", "cryptographic", r"this product includes cryptographic software written by eric young"),
    ("ijg", "jpeg", r"based in part on the work of the independent jpeg group"),
    ("ftl", "freetype", r"(?:copyright )?the freetype project"),
    ("ms-pl", "governs", r"this license governs use of the accompanying software"),
    ("bsl-1.1", "licensor", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2.0", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("sspl-1.0", "functionality", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("upl-1.0", "universal", r"the universal permissive (?:license|licence) upl"),
    ("beerware", "stuff", r"you can do whatever you want with this stuff"),
    ("json", "evil", r"shall be used for good not evil"),
    ("ruby", "redistribute", r"you can redistribute it and or modify it under either the terms of"),
    ("vim", "charityware", r"vim is charityware"),
    ("zpl-2.1", "zope", r"this software consists of contributions made by zope corporation"),
    ("eupl", "eupl", r"licensed under the eupl"),
    ("infozip", "zip", r"info zip (?:license|licence)"),
    ("icu", "icu", r"icu (?:license|licence)"),
    ("unicode", "unicode", r"unicode (?:inc )?(?:license|licence) agreement"),
    ("ipl-1.0", "ibm", r"ibm public (?:license|licence)"),
    ("spl-1.0", "sun", r"sun public (?:license|licence)"),
    ("npl-1.1", "netscape", r"netscape public (?:license|licence)"),
    ("nokia", "nokia", r"nokia open source (?:license|licence)"),
    ("intel", "intel", r"intel open source (?:license|licence)"),
    ("qpl-1.0", "q qt", r"q public (?:license|licence)|qt public (?:license|licence)"),
    ("lpl-1.02", "lucent", r"lucent public (?:license|licence)"),
    ("rpl-1.5", "reciprocal", r"reciprocal public (?:license|licence)"),
    ("apsl-2.0", "apple", r"apple public source (?:license|licence)"),
    ("cpal-1.0", "attribution", r"common public attribution (?:license|licence)"),
    ("ecl-2.0", "educational", r"educational community (?:license|licence)"),
    ("efl-2.0", "eiffel", r"eiffel forum (?:license|licence)"),
    ("fair", "fair", r"fair (?:license|licence)"),
    ("frameworx-1.0", "frameworx", r"frameworx (?:open )?(?:license|licence)"),
    ("nasa-1.3", "nasa", r"nasa open source agreement"),
    ("ngpl", "nethack", r"nethack general public (?:license|licence)"),
    ("naumen", "naumen", r"naumen public (?:license|licence)"),
    ("rscpl", "ricoh", r"ricoh source code public (?:license|licence)"),
    ("rpsl-1.0", "realnetworks", r"realnetworks public source (?:license|licence)"),
    ("simpl-2.0", "simple", r"simple public (?:license|licence)"),
    ("vsl-1.0", "vovida", r"vovida software (?:license|licence)"),
    ("wxwindows", "wxwindows", r"wxwindows (?:library )?(?:license|licence)"),
    ("watcom-1.0", "watcom", r"sybase open watcom public (?:license|licence)|watcom public (?:license|licence)"),
    ("xfree86-1.1", "xfree86", r"xfree86 (?:license|licence)"),
    ("zend-2.0", "zend", r"zend (?:engine )?(?:license|licence)"),
    ("cecill", "cecill", r"cecill(?: free software)? (?:license|licence)(?: agreement)?"),
    ("openldap", "openldap", r"openldap public (?:license|licence)"),
    ("proprietary", "confidential", r"confidential and proprietary|proprietary and confidential"),
    ("proprietary", "prohibited", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "eula", r"end user (?:license|licence) agreement eula"),
)

#: No rule can match a text without one of these words.
GATE = (
    r"(?i)(?<![A-Za-z0-9])(?:licen[cs]e(?:[ds]|[0-9]+)?|unlicense|cddl|mulan|spdx|cc|commons|permission|redistribut(?:e|ion)|endorse|advertising"
    r"|compliance|altered|apache|unencumbered|domain|reserved|gnu|redistributions|warrant(?:y|ies)|copyright|regents|asf|mpl|misrepresented|compile|fuck|perl|php|openssl"
    r"|cryptographic|jpeg|freetype|governs|licensor|hosted|functionality|stuff|evil|charityware|zope|eupl|nasa|confidential|prohibited|eula)(?![A-Za-z0-9])"
)

def rules() -> list[tuple[str, int, str, str, float]]:
    """(keywords, priority, label, regex, score), earlier rules first; several hundred from the tables above."""
    out: list[tuple[str, str, str, float]] = []
    out += [(kw, label, rf"spdx license identifier {tag}(?: only| or later)?", 1.0) for label, kw, _, tag in FAMILIES for kw in ("spdx",)]
    out += [("cc", f"cc-{kind.replace(' ', '-')}-{v.replace(' ', '.')}", rf"(?:spdx license identifier )?cc {kind} {v}", 0.95) for kind in reversed(CC) for v in CC_VERSIONS]
    out += [("commons", f"cc-{kind.replace(' ', '-')}", r"creative commons " + " ".join(CC_WORDS[x] for x in kind.split()), 0.9) for kind in reversed(CC)]
    out += [(kw, label, regex, 1.0) for label, kw, regex in TEXTS]
    out += [(kw, label, rf"(?:{name})(?: (?:license|licence))?", 0.9) for label, kw, name, _ in FAMILIES if re_names_license(name)]
    out += [(kw, label, rf"(?:{name}) (?:style |public )?(?:license|licence)", 0.9) for label, kw, name, _ in FAMILIES if not re_names_license(name)]
    tail = r"(?: (?:license|licence))"
    out += [("licensed", label, rf"licensed under (?:the )?(?:terms of (?:the )?)?(?:{name}){tail}?", 0.95) for label, _, name, _ in FAMILIES]
    out += [("under", label, rf"(?:released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?(?:{name})" + ("" if re_names_license(name) else tail), 0.95) for label, _, name, _ in FAMILIES]
    out += [("org", label, rf"(?:opensource org licenses|spdx org licenses) {tag}", 0.9) for label, _, _, tag in FAMILIES]
    out += [("org", f"cc-{kind.replace(' ', '-')}-{v.replace(' ', '.')}", rf"creativecommons org licenses {kind} {v}", 0.95) for kind in reversed(CC) for v in CC_VERSIONS]
    out += [(p.split()[0], label, p, 0.7) for p, label in PHRASES]
    return [(kw, i, label, rf" (?:{regex})(?= )", score) for i, (kw, label, regex, score) in enumerate(out)]


def re_names_license(name: str) -> bool:
    return "licen" in name


FOUND = "array<struct<start:int,end:int,rule:int,label:string,score:double>>"


def detections(norm: Column) -> Column:
    """What the rules find in ' w0 w1 ... ', gated by keyword and not yet suppressed."""
    table = rules()
    by: dict[str, list[tuple[int, str]]] = {}
    for kws, i, _, regex, _ in table:
        for kw in kws.split():
            by.setdefault(kw, []).append((i, regex))
    pick = lambda k, i: F.get(F.array(*[F.lit(r[k]) for r in table]), i)

    def tried(n: Column, words: Column) -> Column:
        none = F.expr("cast(array() as array<int>)")
        own = lambda rs: F.array(*[F.when(F.regexp_like(n, F.lit(regex)), F.lit(i)) for i, regex in rs])
        met = let(F.array_intersect(words, F.array(*[F.lit(k) for k in sorted(by)])), lambda keys: F.flatten(F.array(*[F.when(F.array_contains(keys, k), own(by[k])).otherwise(none) for k in sorted(by)])))
        return F.array_distinct(F.array_compact(met))

    def places(n: Column, i: Column) -> Column:
        row = lambda s: F.struct((s["start"] + 1).alias("start"), s["end"].alias("end"), i.alias("rule"), pick(2, i).alias("label"), pick(4, i).alias("score"))
        return F.transform(match_spans(n, pick(3, i)), row)

    # inside lambdas, so that hundreds of patterns don't become generated code
    return let(norm, lambda n: F.flatten(F.transform(tried(n, F.split(n, " ")), lambda i: places(n, i))))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs but the text, and lic_n_words, lic_base (sorted struct<start,label> of base phrases) and lic_found (struct<start,end,rule,label,score>, suppressed, by start)."""
    kept = [c for c in docs.columns if c != text]
    t = F.coalesce(F.col(text), F.lit(""))
    norm = F.when(F.regexp_like(t, F.lit(GATE)), F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(t), GAP, " ")), F.lit(" "))).otherwise(F.lit(" "))
    src = docs.select(*kept, count_words(t, MARKS).alias("lic_n_words"), norm.alias("lic_norm"))
    gated = F.length("lic_norm") > 1
    none = F.expr("cast(array() as array<struct<start:int,label:string>>)")
    base = F.when(F.contains("lic_norm", F.lit(" license ")), let(F.split(F.trim("lic_norm"), " "), phrases)).otherwise(none)
    return src.select(*kept, "lic_n_words", base.alias("lic_base"), F.when(gated, unsuppressed(detections(F.col("lic_norm")))).otherwise(F.expr(f"cast(array() as {FOUND})")).alias("lic_found"))


def phrases(words: Column) -> Column:
    """Word numbers, from 0, and labels of the base phrases, sorted."""

    def at(phrase: str, label: str) -> Column:
        def here(x: Column, i: Column) -> Column:
            ok = F.lit(True)
            for k, p in enumerate(phrase.split()):
                ok = ok & ((x if k == 0 else F.coalesce(F.get(words, i + k), F.lit(""))) == p)
            return F.when(ok, F.struct(i.alias("start"), F.lit(label).alias("label")))

        return F.array_compact(F.transform(words, here))

    return F.array_sort(F.flatten(F.array(*[at(p, label) for p, label in PHRASES])))


def unsuppressed(found: Column) -> Column:
    """Drop what an earlier interval of (start, end descending, rule) contains: it reaches as far or farther.

    In chunks, as appending to one array takes quadratic time.
    """
    order = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("neg"), x["rule"].alias("rule"), x["label"].alias("label"), x["score"].alias("score"))))
    split = lambda o: F.when(F.size(o) > 0, F.transform(F.sequence(F.lit(0), F.size(o) - 1, F.lit(CHUNK)), lambda i: F.slice(o, i + 1, F.lit(CHUNK))))

    def step(a: Column, x: Column) -> Column:
        one = F.struct(x["start"].alias("start"), (-x["neg"]).alias("end"), x["rule"].alias("rule"), x["label"].alias("label"), x["score"].alias("score"))
        new = -x["neg"] > a["far"]
        return F.struct(F.greatest(a["far"], -x["neg"]).alias("far"), F.when(new, F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

    def kept(chunk: Column, far: Column) -> Column:
        return F.aggregate(chunk, F.struct(far.alias("far"), F.expr(f"cast(array() as {FOUND})").alias("out")), step, lambda a: a["out"])

    def walk(chunks: Column) -> Column:
        tops = F.transform(chunks, lambda c: F.array_max(F.transform(c, lambda x: -x["neg"])))
        before = F.aggregate(tops, F.array(F.lit(-1)), lambda a, n: F.concat(a, F.array(F.greatest(F.element_at(a, -1), n))))
        return F.flatten(F.zip_with(chunks, F.slice(before, F.lit(1), F.size(chunks)), kept))

    return F.coalesce(let(order, lambda o: let(split(o), walk)), F.expr(f"cast(array() as {FOUND})"))


def report(docs: DataFrame) -> DataFrame:
    """The columns of op10."""
    s = scan(docs.select("doc_id", "text"))
    starts = F.transform("lic_base", lambda x: x["start"])
    base = F.transform("lic_base", lambda x: x["label"])
    join = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    return s.select(
        "doc_id", F.col("lic_n_words").alias("n_words"), F.size("lic_base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), join(base).alias("base_labels"),
        join(F.concat(base, F.transform("lic_found", lambda x: x["label"]))).alias("labels"),
        F.greatest(F.when(F.size("lic_base") > 0, F.lit(0.7)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform("lic_found", lambda x: x["score"])), F.lit(0.0))).alias("score"),
    )
