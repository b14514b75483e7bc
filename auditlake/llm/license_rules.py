"""The ordered signature rules of the licence scan.

Rules are written over lower-cased text.  ``FAMILIES`` names a licence once:
label, keyword that must occur, and a pattern of its name; every family gets the
same four phrasings from ``PHRASINGS``, strongest first.  ``NOTICES`` are whole
sentences that stand for themselves.  Priority 0 is a machine-readable tag or a
whole notice, 1 a grant ("licensed under ..."), 2 a mention.

A space in a pattern stands for white space of any length, line breaks and the
comment marks of the next lines included (``GAP``), as licence texts are wrapped.
"""

from __future__ import annotations

#: Fixed value: what a space in a pattern matches.
GAP = r"(?:\s[\s*#/;%!>|\"-]*)"

V = r"(?:,? ?\(?v(?:ersion|er\.?|\.)? ?|[- ]){n}(?:\.0)?"


def _v(name: str, n: str) -> str:
    return name + V.replace("{n}", n)


#: label, keyword, name
FAMILIES: list[tuple[str, str, str]] = [
    ("apache-1.1", "apache", _v(r"apache(?: software)?(?: licen[sc]e)?", r"1\.1")),
    ("apache-2.0", "apache", _v(r"apache(?: software)?(?: licen[sc]e)?", "2")),
    ("apache", "apache", r"apache(?: software)?"),
    ("mit", "mit", r"(?:the )?\bmit\b(?:[/ ]x11)?"),
    ("mit-0", "mit", r"\bmit(?:-0| no attribution)\b"),
    ("bsd-1-clause", "bsd", r"(?:bsd[- ]1|(?:1|one)[- ]clause bsd|bsd (?:1|one))(?:[- ]clause)?"),
    ("bsd-2-clause", "bsd", r"(?:(?:simplified|free)[- ]bsd|freebsd|bsd[- ]2|(?:2|two)[- ]clause bsd)(?:[- ]clause)?"),
    ("bsd-3-clause", "bsd", r"(?:(?:new|modified|revised)[- ]bsd|bsd[- ]3|(?:3|three)[- ]clause bsd)(?:[- ]clause)?"),
    ("bsd-4-clause", "bsd", r"(?:(?:original|old)[- ]bsd|bsd[- ]4|(?:4|four)[- ]clause bsd)(?:[- ]clause)?"),
    ("bsd", "bsd", r"\bbsd\b(?:[- ]style)?"),
    ("0bsd", "bsd", r"(?:\b0bsd\b|zero[- ]clause bsd)"),
    ("gpl-1.0", "g", _v(r"(?:gnu )?(?:\bgpl|general public licen[sc]e)", "1")),
    ("gpl-2.0", "g", _v(r"(?:gnu )?(?:\bgpl|general public licen[sc]e)", "2")),
    ("gpl-3.0", "g", _v(r"(?:gnu )?(?:\bgpl|general public licen[sc]e)", "3")),
    ("gpl", "g", r"(?:gnu )?(?:\bgpl\b|general public)"),
    ("lgpl-2.0", "l", _v(r"(?:gnu )?(?:\blgpl|(?:library|lesser) general public licen[sc]e)", "2")),
    ("lgpl-2.1", "l", _v(r"(?:gnu )?(?:\blgpl|lesser general public licen[sc]e)", r"2\.1")),
    ("lgpl-3.0", "l", _v(r"(?:gnu )?(?:\blgpl|lesser general public licen[sc]e)", "3")),
    ("lgpl", "l", r"(?:gnu )?(?:\blgpl\b|(?:library|lesser) general public)"),
    ("agpl-3.0", "a", _v(r"(?:gnu )?(?:\bagpl|affero general public licen[sc]e)", "3")),
    ("agpl", "a", r"(?:gnu )?(?:\bagpl\b|affero general public)"),
    ("gfdl-1.1", "free documentation", _v(r"(?:gnu )?free documentation licen[sc]e", r"1\.1")),
    ("gfdl-1.2", "free documentation", _v(r"(?:gnu )?free documentation licen[sc]e", r"1\.2")),
    ("gfdl-1.3", "free documentation", _v(r"(?:gnu )?free documentation licen[sc]e", r"1\.3")),
    ("mpl-1.0", "m", _v(r"(?:\bmpl|mozilla public licen[sc]e)", "1")),
    ("mpl-1.1", "m", _v(r"(?:\bmpl|mozilla public licen[sc]e)", r"1\.1")),
    ("mpl-2.0", "m", _v(r"(?:\bmpl|mozilla public licen[sc]e)", "2")),
    ("mpl", "m", r"(?:\bmpl\b|mozilla public)"),
    ("epl-1.0", "e", _v(r"(?:\bepl|eclipse public licen[sc]e)", "1")),
    ("epl-2.0", "e", _v(r"(?:\bepl|eclipse public licen[sc]e)", "2")),
    ("edl-1.0", "eclipse", r"eclipse distribution"),
    ("cddl-1.0", "cddl", _v(r"\bcddl", "1")),
    ("cddl-1.1", "cddl", _v(r"\bcddl", r"1\.1")),
    ("cddl", "common development", r"common development and distribution"),
    ("cpl-1.0", "common public", r"common public"),
    ("artistic-1.0", "artistic", _v(r"artistic(?: licen[sc]e)?", "1")),
    ("artistic-2.0", "artistic", _v(r"artistic(?: licen[sc]e)?", "2")),
    ("artistic", "artistic", r"(?:perl )?artistic"),
    ("bsl-1.0", "boost", r"boost(?: software)?"),
    ("busl-1.1", "business source", r"business source"),
    ("isc", "isc", r"\bisc\b"),
    ("zlib", "zlib", r"\bzlib(?:/libpng)?\b"),
    ("libpng", "libpng", r"\blibpng(?:-2\.0)?\b"),
    ("unlicense", "unlicense", r"\b(?:the )?unlicense\b"),
    ("wtfpl", "wtfpl", r"\bwtfpl\b"),
    ("psf-2.0", "python", r"python software foundation"),
    ("python-2.0", "python", _v(r"python(?: licen[sc]e)?", "2")),
    ("ruby", "ruby", r"\bruby(?:'s)?\b"),
    ("php-3.01", "php", _v(r"\bphp(?: licen[sc]e)?", r"3\.01")),
    ("php-3.0", "php", _v(r"\bphp(?: licen[sc]e)?", "3")),
    ("openssl", "openssl", r"\bopenssl\b"),
    ("ssleay", "ssleay", r"\bssleay\b"),
    ("curl", "curl", r"\bcurl\b"),
    ("ofl-1.1", "o", r"(?:\bofl|(?:sil )?open font)(?:[- ]1\.1)?"),
    ("eupl-1.1", "e", _v(r"(?:\beupl|european union public licen[sc]e)", r"1\.1")),
    ("eupl-1.2", "e", _v(r"(?:\beupl|european union public licen[sc]e)", r"1\.2")),
    ("cecill-2.1", "cecill", _v(r"\bcecill", r"2\.1")),
    ("cecill-b", "cecill", r"\bcecill-b\b"),
    ("cecill-c", "cecill", r"\bcecill-c\b"),
    ("ms-pl", "microsoft", r"(?:microsoft public|\bms-pl\b)"),
    ("ms-rl", "microsoft", r"(?:microsoft reciprocal|\bms-rl\b)"),
    ("osl-3.0", "open software", r"open software"),
    ("afl-3.0", "academic free", r"academic free"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa(?: open source)?"),
    ("postgresql", "postgresql", r"\bpostgresql\b"),
    ("vim", "vim", r"\bvim\b"),
    ("x11", "x11", r"\bx11\b"),
    ("zpl-2.1", "zope", r"zope public"),
    ("sspl-1.0", "server side", r"server side public"),
    ("elastic-2.0", "elastic", r"\belastic\b"),
    ("odbl-1.0", "o", r"(?:\bodbl\b|open (?:data commons open )?database)"),
    ("odc-by-1.0", "odc", r"\bodc-by\b"),
    ("pddl-1.0", "public domain dedication", r"public domain dedication"),
    ("cc0-1.0", "c", r"(?:\bcc0(?:[- ]1\.0)?\b|creative commons zero)"),
    ("cc-by-4.0", "c", r"(?:\bcc[- ]by|creative commons attribution)[- ]4\.0"),
    ("cc-by-3.0", "c", r"(?:\bcc[- ]by|creative commons attribution)[- ]3\.0"),
    ("cc-by-sa-4.0", "c", r"(?:\bcc[- ]by[- ]sa|creative commons attribution[- ]sharealike)[- ]4\.0"),
    ("cc-by-sa-3.0", "c", r"(?:\bcc[- ]by[- ]sa|creative commons attribution[- ]sharealike)[- ]3\.0"),
    ("cc-by-nc-4.0", "c", r"(?:\bcc[- ]by[- ]nc|creative commons attribution[- ]noncommercial)[- ]4\.0"),
    ("cc-by-nd-4.0", "c", r"(?:\bcc[- ]by[- ]nd|creative commons attribution[- ]noderivatives)[- ]4\.0"),
    ("cc-by-nc-sa-4.0", "c", r"(?:\bcc[- ]by[- ]nc[- ]sa|creative commons attribution[- ]noncommercial[- ]sharealike)[- ]4\.0"),
    ("cc-by-nc-nd-4.0", "c", r"(?:\bcc[- ]by[- ]nc[- ]nd|creative commons attribution[- ]noncommercial[- ]noderivatives)[- ]4\.0"),
    ("cc-by-sa", "c", r"(?:\bcc[- ]by[- ]sa|creative commons attribution[- ]sharealike)"),
    ("cc-by-nc", "c", r"(?:\bcc[- ]by[- ]nc|creative commons attribution[- ]noncommercial)"),
    ("creative-commons", "creative commons", r"creative commons"),
    ("proprietary", "proprietary", r"proprietary"),
    ("commercial", "commercial", r"commercial"),
]

#: name of the phrasing, priority, what stands before and after the name
PHRASINGS: list[tuple[str, int, str, str]] = [
    ("tag", 0, r"spdx-licen[sc]e-identifier:\s{0,4}", r"(?:-only|-or-later|\+)?"),
    ("grant", 1, r"(?:re)?licen[sc]ed (?:to you )?under (?:the terms of |the terms and conditions of )?(?:the |an? )?", r"(?:,? (?:public )?licen[sc]e)?(?:,? ?v(?:ersion)? ?[0-9.]{1,4})?"),
    ("release", 1, r"(?:released|distributed|available|published|provided|covered) (?:under|by) (?:the terms of )?(?:the |an? )?", r",? (?:public )?licen[sc]e(?:,? ?v(?:ersion)? ?[0-9.]{1,4})?"),
    ("mention", 2, r"", r"(?: public)? licen[sc]e[sd]?(?:,? ?v(?:ersion)? ?[0-9.]{1,4})?"),
]

#: label, gate, keyword, priority, pattern
NOTICES: list[tuple[str, str, str, int, str]] = [
    ("mit", "hereby granted", "free of charge", 0, r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("isc", "hereby granted", "fee", 0, r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "permitted", "source and binary", 0, r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd-3-clause", "endorse", "endorse or promote", 0, r"neither the names? of [\s\S]{1,160} may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", "advertising materials", 0, r"all advertising materials mentioning features or use of this software"),
    ("apache-2.0", "licen", "apache", 0, r"licensed under the apache license, version 2\.0"),
    ("gpl", "licen", "redistribute", 0, r"you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("lgpl", "licen", "lesser", 0, r"you can redistribute it and/or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "licen", "affero", 0, r"you can redistribute it and/or modify it under the terms of the gnu affero general public license"),
    ("mpl-2.0", "licen", "mozilla", 0, r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0"),
    ("bsl-1.0", "licen", "boost", 0, r"distributed under the boost software license, version 1\.0"),
    ("unlicense", "public domain", "unencumbered", 0, r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", "public domain", 1, r"(?:released|placed|dedicated|in) (?:in)?to the public domain"),
    ("public-domain", "public domain", "public domain", 2, r"\bpublic domain\b"),
    ("zlib", "warrant", "as-is", 0, r"this software is provided 'as-is', without any express or implied warranty"),
    ("wtfpl", "licen", "what the", 1, r"do what the f\S{1,4} you want to public license"),
    ("warranty-disclaimer", "warrant", "as is", 2, r"(?:provided|distributed) (?:on an )?.as is. (?:basis,? )?without warrant(?:y|ies)"),
    ("copyright", "copyright", "copyright", 2, r"copyright (?:\(c\)|©)? ?(?:19|20)[0-9]{2}(?:[-, ]{1,2}(?:19|20)?[0-9]{2}){0,8}"),
    ("copyright", "copyright", "copyright", 2, r"copyright (?:\(c\)|©)"),
    ("commercial", "licen", "end user", 1, r"end[- ]user licen[sc]e agreement"),
    ("proprietary", "confidential", "proprietary", 1, r"(?:confidential and proprietary|proprietary and confidential)"),
    ("generic-license", "licen", "licen", 2, r"\blicen[sc]ed under\b"),
    ("generic-license", "licen", "licen", 2, r"\bsee (?:the )?(?:file )?licen[sc]e\b"),
]


def spaced(pattern: str) -> str:
    """The pattern with its spaces, those in character classes too, as gaps."""
    for chars in ("[- ]", "[/ ]", "[-, ]"):
        pattern = pattern.replace(chars, f"(?:[{chars[1:-2]}]|{GAP})")
    return pattern.replace(" ", GAP)


def rules() -> list[tuple[int, int, str, str, str, str]]:
    """All rules in order: number, priority, gate, keyword, label, pattern."""
    out = [(p, gate, key, label, pattern) for label, gate, key, p, pattern in NOTICES]
    for _, priority, before, after in PHRASINGS:
        out += [(priority, "licen", key, label, before + name + after) for label, key, name in FAMILIES]
    return [(i, *r[:-1], spaced(r[-1])) for i, r in enumerate(out)]
