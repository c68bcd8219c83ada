"""The ordered signature rules of the licence scan.

A rule is (keyword, tier, label, pattern).  Patterns run over normalised
text: words of lower-case ASCII letters, digits and non-ASCII characters,
single spaces between them, so that "2.0" reads "2 0".  A rule is tried only
where its keyword occurs as a word.  Tiers: 3 a grant or notice, 2 a licence
named with its version or identifier, 1 a bare mention.  Earlier rules win
over later ones of the same tier on the same words.
"""

from __future__ import annotations

# Wording of grants and notices, written out one by one.
NOTICES = (
    ("permission", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("merge", "mit", "to use copy modify merge publish distribute sublicense and or sell copies"),
    ("noninfringement", "mit", "merchantability fitness for a particular purpose and noninfringement"),
    ("permission", "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("redistribution", "bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("redistributions", "bsd", "redistributions of source code must retain the above copyright notice"),
    ("redistributions", "bsd", "redistributions in binary form must reproduce the above copyright notice"),
    ("endorse", "bsd-3-clause", "neither the name of .{1,60}? nor the names of its contributors may be used to endorse"),
    ("advertising", "bsd-4-clause", "all advertising materials mentioning features or use of this software must display"),
    ("redistribute", "gpl-or-later", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("version", "gpl-2.0-or-later", "either version 2 of the license or at your option any later version"),
    ("version", "gpl-3.0-or-later", "either version 3 of the license or at your option any later version"),
    ("affero", "agpl-3.0", "under the terms of the gnu affero general public license"),
    ("lesser", "lgpl", "under the terms of the gnu lesser general public license"),
    ("library", "lgpl-2.0", "under the terms of the gnu library general public license"),
    ("warranty", "gpl", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("compliance", "apache-2.0", "you may not use this file except in compliance with the license"),
    ("contributor", "apache-2.0", "licensed to the .{1,40}? under one or more contributor license agreements"),
    ("basis", "apache-2.0", "distributed on an as is basis without warranties or conditions of any kind"),
    ("mozilla", "mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("incompatible", "mpl-2.0", "this source code form is incompatible with secondary licenses"),
    ("eclipse", "epl", "made available under the terms of the eclipse public license"),
    ("cddl", "cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("unencumbered", "unlicense", "this is free and unencumbered software released into the public domain"),
    ("dedicate", "unlicense", "we dedicate any and all copyright interest in the software to the public domain"),
    ("implied", "zlib", "this software is provided as is without any express or implied warranty"),
    ("misrepresented", "zlib", "the origin of this software must not be misrepresented"),
    ("boost", "bsl-1.0", "distributed under the boost software license"),
    ("organization", "bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("fuck", "wtfpl", "you just do what the fuck you want to"),
    ("font", "ofl-1.1", "this font software is licensed under the sil open font license"),
    ("waived", "cc0-1.0", "has waived all copyright and related or neighboring rights"),
    ("creative", "cc", "this work is licensed under (?:a|the) creative commons"),
    ("artistic", "artistic", "under the same terms as perl itself|under the artistic license"),
    ("python", "psf-2.0", "psf license agreement for python"),
    ("postgresql", "postgresql", "permission to use copy modify and distribute this software and its documentation .{1,80}? postgresql"),
    ("ruby", "ruby", "you can redistribute it under .{0,30}?the terms of ruby"),
    ("beerware", "beerware", "beer ?ware license"),
    ("domain", "public-domain", "(?:released|placed|is|dedicated) (?:into|in|to) the public domain"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("unauthorized", "proprietary", "unauthorized copying of this file"),
    ("prohibited", "proprietary", "(?:copying|reproduction|redistribution) .{0,40}?is strictly prohibited"),
    ("consent", "proprietary", "without (?:the )?(?:prior |express )?(?:prior )?written (?:consent|permission)"),
    ("commercial", "non-commercial", "(?:for )?non ?commercial use only|not for commercial use"),
    ("evaluation", "evaluation", "for evaluation purposes only"),
    ("reserved", "all-rights-reserved", "copyright (?:c )?(?:[0-9]{4} )?.{0,60}?all rights reserved"),
    ("reserved", "all-rights-reserved", "all rights (?:are )?reserved"),
    ("copyright", "copyright", "copyright (?:c )?[0-9]{4}(?: [0-9]{4})?"),
)

# Fixed values: (label, keyword, name of the licence, short names, versions).
FAMILIES = (
    ("gpl", "general", "(?:gnu )?general public licen[cs]e", "(?:gnu )?gpl", ("1 0", "2 0", "3 0")),
    ("lgpl", "lesser", "(?:gnu )?lesser general public licen[cs]e", "(?:gnu )?lgpl", ("2 0", "2 1", "3 0")),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e", "(?:gnu )?agpl", ("1 0", "3 0")),
    ("gfdl", "documentation", "(?:gnu )?free documentation licen[cs]e", "gfdl", ("1 1", "1 2", "1 3")),
    ("apache", "apache", "apache(?: software)?(?: licen[cs]e)?", "asl", ("1 0", "1 1", "2 0")),
    ("mpl", "mozilla", "mozilla public licen[cs]e", "mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", "eclipse public licen[cs]e", "epl", ("1 0", "2 0")),
    ("cddl", "development", "common development and distribution licen[cs]e", "cddl", ("1 0", "1 1")),
    ("cpl", "common", "common public licen[cs]e", "cpl", ("1 0",)),
    ("eupl", "european", "european union public licen[cs]e", "eupl", ("1 0", "1 1", "1 2")),
    ("osl", "open", "open software licen[cs]e", "osl", ("1 0", "1 1", "2 0", "2 1", "3 0")),
    ("afl", "academic", "academic free licen[cs]e", "afl", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("artistic", "artistic", "artistic licen[cs]e", "artistic", ("1 0", "2 0")),
    ("lppl", "latex", "latex project public licen[cs]e", "lppl", ("1 0", "1 1", "1 2", "1 3")),
    ("ofl", "font", "(?:sil )?open font licen[cs]e", "ofl", ("1 0", "1 1")),
    ("odbl", "database", "open (?:database|data commons open database) licen[cs]e", "odbl", ("1 0",)),
    ("bsl", "boost", "boost software licen[cs]e", "bsl", ("1 0",)),
    ("psf", "python", "python(?: software foundation)? licen[cs]e", "psf", ("2 0",)),
    ("php", "php", "php licen[cs]e", "php licen[cs]e", ("3 0", "3 01")),
    ("zpl", "zope", "zope public licen[cs]e", "zpl", ("1 1", "2 0", "2 1")),
    ("upl", "universal", "universal permissive licen[cs]e", "upl", ("1 0",)),
    ("cecill", "cecill", "cecill(?: free software licen[cs]e)?", "cecill", ("1 0", "1 1", "2 0", "2 1")),
    ("mit", "mit", "mit licen[cs]e", "mit", ()),
    ("isc", "isc", "isc licen[cs]e", "isc", ()),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", "zlib", ()),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd)(?: licen[cs]e)?", "bsd 2 clause", ()),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?", "bsd 3 clause", ()),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)?", "bsd 4 clause", ()),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e", "bsd licensed", ()),
    ("unlicense", "unlicense", "the unlicense", "unlicense", ()),
    ("wtfpl", "wtfpl", "do what the fuck you want to public licen[cs]e", "wtfpl", ()),
    ("cc0", "cc0", "creative commons zero", "cc0", ("1 0",)),
)
# The parts of Creative Commons names and their versions.
CC_PARTS = (("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:ative)?s?"),
            ("by-nc", "attribution non ?commercial"), ("by-nc-sa", "attribution non ?commercial share ?alike"),
            ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?"))
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")


def _versions(label: str, keyword: str, name: str, versions: tuple[str, ...]):
    for v in versions:
        dotted = v.replace(" ", ".")
        number = v if not v.endswith(" 0") else f"{v[:-2]}(?: 0)?"
        at = f"{name}(?: version| v)? ?v?{number}"
        yield keyword, 3, f"{label}-{dotted}-or-later", f"{at} (?:only )?or (?:at your option )?(?:any )?later(?: version)?"
        yield keyword, 3, f"{label}-{dotted}", f"licensed under (?:the )?(?:terms of the )?{at}"
        yield keyword, 2, f"{label}-{dotted}", at


def rules() -> list[tuple[str, int, str, str]]:
    out = [(keyword, 3, label, pattern) for keyword, label, pattern in NOTICES]
    for label, keyword, name, short, versions in FAMILIES:
        plain = short.split(" ")[0] if short.split(" ")[0].isalnum() else label
        out += _versions(label, keyword, name, versions)
        if short not in (keyword, name):
            out += _versions(label, plain, short, versions)
        out.append((keyword, 3, label, f"licensed under (?:the )?(?:terms of the )?{name}"))
        out.append((keyword, 1, label, name))
        if plain not in ("mit", "artistic", "asl"):  # ordinary words and names in themselves
            out.append((plain, 1, label, short))
        out.append(("spdx", 3, label, f"spdx license identifier {label.replace('-', ' ')}(?: [0-9]+ [0-9]+)?(?: only| or later)?"))
    for part, spelt in CC_PARTS:
        out += _versions(f"cc-{part}", "cc", f"cc {part.replace('-', ' ')}", CC_VERSIONS)
        out += _versions(f"cc-{part}", "creative", f"creative commons {spelt}(?: international| generic| unported| licen[cs]e)*", CC_VERSIONS)
        out.append(("cc", 1, f"cc-{part}", f"cc {part.replace('-', ' ')}"))
        out.append(("creative", 1, f"cc-{part}", f"creative commons {spelt}"))
    return out
