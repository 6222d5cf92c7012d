"""The signature rules of the licence scan, written by hand (the GNU families from hand-written forms), in order of priority.

A line of a family is ``label | confidence | regex``. A regex is over lower-case words with single
spaces between them, as ``scan_licenses`` joins them: "Apache-2.0" reads "apache 2 0", and a plus behind the version
of a GNU licence ends its last word: "GPL-2.0+" reads "gpl 2 0⁺". It matches whole words. Rules of one family are tried in their order at every place, so the longer and more
telling ones come first. A word that also is common English ("artistic", "apache", "boost", "epl")
counts only beside a version, a licence word or the rest of the name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: The GNU licences: short name, full name, versions from the newest, and what else names one without a version.
GNU = [
    ("gpl", "general public licen[sc]e", ["3.0", "2.0", "1.0"], ["0.8 | gnu general public licen[sc]e(?: gpl)?", "0.7 | gpl compatible"]),
    ("lgpl", "lesser general public licen[sc]e", ["3.0", "2.1", "2.0"], ["0.8 | (?:gnu )?lesser general public licen[sc]e"]),
    ("agpl", "affero general public licen[sc]e", ["3.0", "1.0"], ["0.8 | (?:gnu )?affero general public licen[sc]e"]),
    ("gfdl", "free documentation licen[sc]e", ["1.3", "1.2", "1.1"], ["0.8 | (?:gnu )?free documentation licen[sc]e", "0.8 | gnu fdl(?: licen[sc]e)?"]),
]
#: The forms of each version: a header's own words, identifiers, names in running text. NUMBER is the version in words.
#: Where a form may go on with "or later", a plus or "only", those come before the bare one.
HEADERS = """
-or-later | 1.0 | gnu FULL(?: as published by the free software foundation)?(?: either)? version NUMBER(?: of the licen[sc]e)? or at your option any later version
-or-later | 1.0 | under the terms of the gnu FULL version NUMBER or any later version published by the free software foundation
-only | 1.0 | gnu FULL(?: as published by the free software foundation)? version NUMBER of the licen[sc]e only
"""
NAMES = [("1.0", "spdx licen[sc]e identifier SHORT "), ("0.95", "(?:gnu )?FULL(?: SHORT)?(?: version| v)? (?:v)?"), ("0.9", "(?:gnu )?SHORT(?: version| v)? (?:v)?"), ("0.9", "SHORTv")]
TAILS = [("-or-later", " or(?: at your option)?(?: any)? later(?: version)?"), ("-or-later", "⁺"), ("-only", " only"), ("", "")]


def gnu_table() -> str:
    """The lines of the GNU families, from GNU, HEADERS, NAMES and TAILS."""
    lines = []
    for short, full, versions, bare in GNU:
        lines.append(f"# {short}")
        number = {v: v[0] + ("(?: 0)?" if v.endswith(".0") else " " + v[2:]) for v in versions}
        fill = lambda form, v: form.replace("FULL", full).replace("SHORT", short).replace("NUMBER", number[v])  # noqa: E731, B023
        for header in HEADERS.strip().splitlines():
            lines += [f"{short}-{v}{fill(header, v)}" for v in versions]
        for sure, name in NAMES:
            lines += [f"{short}-{v}{suffix} | {sure} | {fill(name, v)}{number[v]}{tail}" for v in versions for suffix, tail in TAILS]
        lines += [f"{short} | {line}" for line in [*bare, f"0.8 | gnu {short}(?: licen[sc]e)?", f"0.8 | {short} licen[sc]e"]]
    return "\n".join(lines)


TABLE = r"""
# lgpl
lgpl-2.0-or-later | 1.0 | gnu library general public licen[sc]e(?: as published by the free software foundation)?(?: either)? version 2(?: 0)?(?: of the licen[sc]e)? or at your option any later version
lgpl-2.0-or-later | 0.95 | (?:gnu )?library general public licen[sc]e(?: lgpl)?(?: version| v)? (?:v)?2(?: 0)? or(?: at your option)?(?: any)? later(?: version)?
lgpl-2.0-or-later | 0.95 | (?:gnu )?library general public licen[sc]e(?: lgpl)?(?: version| v)? (?:v)?2(?: 0)?⁺
lgpl-2.0-only | 0.95 | (?:gnu )?library general public licen[sc]e(?: lgpl)?(?: version| v)? (?:v)?2(?: 0)? only
lgpl-2.0 | 0.95 | (?:gnu )?library general public licen[sc]e(?: lgpl)?(?: version| v)? (?:v)?2(?: 0)?
lgpl | 0.8 | (?:gnu )?library general public licen[sc]e
# gpl grants
gpl | 0.9 | under(?: the)?(?: terms of)?(?: the)? (?:gnu )?gpl(?: licen[sc]e)?
# apache
apache-2.0 | 1.0 | licensed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file except in compliance with the licen[sc]e
apache-2.0 | 1.0 | (?:released|licensed|distributed|available|published) under(?: the)?(?: terms of)?(?: the)? apache(?: software)? licen[sc]e(?: version| v)? (?:v)?2(?: 0)?
apache-2.0 | 1.0 | spdx licen[sc]e identifier apache 2 0
apache-2.0 | 1.0 | www apache org licenses licen[sc]e 2 0
apache-2.0 | 0.95 | apache(?: software)? licen[sc]e(?: version| v)? (?:v)?2(?: 0)?
apache-1.1 | 0.95 | apache(?: software)? licen[sc]e(?: version| v)? (?:v)?1 1
apache-1.0 | 0.95 | apache(?: software)? licen[sc]e(?: version| v)? (?:v)?1 0
apache-2.0 | 0.9 | apache(?: version| v)? (?:v)?2 0(?: licen[sc]e)?
apache-2.0 | 0.9 | asl 2 0
apache | 0.9 | (?:released|licensed|distributed|available|published) under(?: the)?(?: terms of)?(?: the)? apache(?: software)? licen[sc]e
apache | 0.8 | apache software licen[sc]e
apache | 0.8 | apache licen[sc]e
# mit
mit | 1.0 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 0.95 | permission is hereby granted free of charge to any person obtaining a copy
mit | 0.9 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | 1.0 | spdx licen[sc]e identifier mit 0
mit | 1.0 | spdx licen[sc]e identifier mit
mit | 0.9 | (?:1 0|1 1|2 0|2 1|3 0|4 0|0⁺|1⁺|clause|only|later|exception|unlicense|cc0|isc|zlib|0bsd) (?:or|and) mit
mit | 0.9 | mit (?:or|and) (?:apache|bsd|gpl|lgpl|agpl|mpl|epl|bsl|cc0|artistic|isc|zlib)
mit | 0.8 | mit apache
mit | 0.9 | (?:released|licensed|distributed|available|published) under(?: the)?(?: terms of)?(?: the)? mit(?: x11)? licen[sc]e
mit-0 | 0.9 | mit no attribution(?: licen[sc]e)?
mit-0 | 0.9 | mit 0 licen[sc]e
mit-0 | 0.8 | (?:or|and) mit 0
x11 | 0.9 | mit x11 licen[sc]e
x11 | 0.8 | x11 licen[sc]e
mit | 0.8 | mit licen[sc]e
expat | 0.8 | expat licen[sc]e
# bsd
bsd | 1.0 | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | 0.95 | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 0.95 | neither the name of [^ ]+(?: [^ ]+)?(?: [^ ]+)?(?: [^ ]+)? nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-4-clause | 0.95 | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd-3-clause-clear | 0.95 | bsd 3 clause clear(?: licen[sc]e)?
bsd-2-clause-patent | 0.95 | bsd 2 clause(?: plus)? patent(?: licen[sc]e)?
bsd-3-clause | 0.95 | bsd 3 clause(?: licen[sc]e)?
bsd-2-clause | 0.95 | bsd 2 clause(?: licen[sc]e)?
bsd-4-clause | 0.95 | bsd 4 clause(?: licen[sc]e)?
bsd-3-clause | 0.9 | (?:3|three) clause bsd(?: licen[sc]e)?
bsd-2-clause | 0.9 | (?:2|two) clause bsd(?: licen[sc]e)?
bsd-4-clause | 0.9 | (?:4|four) clause bsd(?: licen[sc]e)?
bsd-3-clause | 0.9 | (?:new|modified|revised) bsd licen[sc]e
bsd-2-clause | 0.9 | simplified bsd(?: licen[sc]e)?
bsd-2-clause | 0.8 | freebsd(?: documentation)? licen[sc]e
bsd-2-clause | 0.7 | freebsd
bsd-4-clause | 0.9 | original bsd licen[sc]e
0bsd | 0.9 | zero clause bsd(?: licen[sc]e)?
0bsd | 0.9 | bsd zero clause(?: licen[sc]e)?
0bsd | 0.9 | 0bsd
bsd | 0.8 | bsd(?: style)? licen[sc]e
# mpl
mpl-2.0 | 1.0 | this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0
mpl-2.0 | 0.95 | mozilla public licen[sc]e(?: mpl)?(?: version| v)? (?:v)?2(?: 0)?
mpl-1.1 | 0.95 | mozilla public licen[sc]e(?: mpl)?(?: version| v)? (?:v)?1 1
mpl-1.0 | 0.95 | mozilla public licen[sc]e(?: mpl)?(?: version| v)? (?:v)?1 0
mpl-2.0 | 0.9 | mpl(?: version| v)? (?:v)?2 0
mpl-1.1 | 0.9 | mpl(?: version| v)? (?:v)?1 1
mpl-1.0 | 0.9 | mpl(?: version| v)? (?:v)?1 0
mpl-2.0 | 0.9 | mplv2(?: 0)?
mpl | 0.8 | mozilla public licen[sc]e
mpl | 0.8 | mpl licen[sc]e
# epl
epl-2.0 | 0.95 | eclipse public licen[sc]e(?: epl)?(?: version| v)? (?:v)?2(?: 0)?
epl-1.0 | 0.95 | eclipse public licen[sc]e(?: epl)?(?: version| v)? (?:v)?1(?: 0)?
epl-2.0 | 0.9 | epl(?: version| v)? (?:v)?2 0
epl-1.0 | 0.9 | epl(?: version| v)? (?:v)?1 0
edl-1.0 | 0.9 | eclipse distribution licen[sc]e(?: version| v)? 1 0
epl | 0.8 | eclipse public licen[sc]e
epl | 0.8 | epl licen[sc]e
# cddl
cddl-1.1 | 0.95 | common development and distribution licen[sc]e(?: cddl)?(?: version| v)? (?:v)?1 1
cddl-1.0 | 0.95 | common development and distribution licen[sc]e(?: cddl)?(?: version| v)? (?:v)?1 0
cddl-1.1 | 0.9 | cddl(?: version| v)? (?:v)?1 1
cddl-1.0 | 0.9 | cddl(?: version| v)? (?:v)?1 0
cddl | 0.8 | common development and distribution licen[sc]e
cddl | 0.8 | cddl(?: licen[sc]e)?
# eupl
eupl-1.2 | 0.95 | european union public licen[sc]e(?: eupl)?(?: version| v)? (?:v)?1 2
eupl-1.1 | 0.95 | european union public licen[sc]e(?: eupl)?(?: version| v)? (?:v)?1 1
eupl-1.0 | 0.95 | european union public licen[sc]e(?: eupl)?(?: version| v)? (?:v)?1 0
eupl-1.2 | 0.9 | eupl(?: version| v)? (?:v)?1 2
eupl-1.1 | 0.9 | eupl(?: version| v)? (?:v)?1 1
eupl-1.0 | 0.9 | eupl(?: version| v)? (?:v)?1 0
eupl | 0.8 | european union public licen[sc]e
eupl | 0.8 | eupl(?: licen[sc]e)?
# academic
afl-3.0 | 0.95 | academic free licen[sc]e(?: afl)?(?: version| v)? (?:v)?3 0
afl-2.1 | 0.95 | academic free licen[sc]e(?: afl)?(?: version| v)? (?:v)?2 1
afl-2.0 | 0.95 | academic free licen[sc]e(?: afl)?(?: version| v)? (?:v)?2 0
afl-3.0 | 0.9 | afl(?: version| v)? (?:v)?3 0
afl-2.1 | 0.9 | afl(?: version| v)? (?:v)?2 1
afl-2.0 | 0.9 | afl(?: version| v)? (?:v)?2 0
afl | 0.8 | academic free licen[sc]e
ecl-2.0 | 0.9 | educational community licen[sc]e(?: version| v)? (?:v)?2 0
ecl | 0.8 | educational community licen[sc]e
ncsa | 0.9 | university of illinois ncsa open source licen[sc]e
# osl
osl-3.0 | 0.95 | open software licen[sc]e(?: osl)?(?: version| v)? (?:v)?3 0
osl-2.1 | 0.95 | open software licen[sc]e(?: osl)?(?: version| v)? (?:v)?2 1
osl-2.0 | 0.95 | open software licen[sc]e(?: osl)?(?: version| v)? (?:v)?2 0
osl-1.0 | 0.95 | open software licen[sc]e(?: osl)?(?: version| v)? (?:v)?1 0
osl-3.0 | 0.9 | osl(?: version| v)? (?:v)?3 0
osl-2.1 | 0.9 | osl(?: version| v)? (?:v)?2 1
osl-2.0 | 0.9 | osl(?: version| v)? (?:v)?2 0
osl | 0.8 | open software licen[sc]e
# artistic
artistic-2.0 | 0.95 | artistic licen[sc]e(?: version| v)? (?:v)?2(?: 0)?
artistic-1.0 | 0.95 | artistic licen[sc]e(?: version| v)? (?:v)?1(?: 0)?
artistic-2.0 | 0.9 | artistic 2 0
artistic-1.0 | 0.9 | artistic 1 0
artistic | 0.8 | artistic licen[sc]e
artistic | 0.8 | same terms as perl(?: itself)?
# creative commons
cc-by-nc-nd-4.0 | 0.95 | (?:creative commons|cc) (?:by nc nd|attribution non(?: )?commercial no(?: )?deriv(?:ative)?s)(?: licen[sc]e| international| unported)? 4 0
cc-by-nc-nd-3.0 | 0.95 | (?:creative commons|cc) (?:by nc nd|attribution non(?: )?commercial no(?: )?deriv(?:ative)?s)(?: licen[sc]e| international| unported)? 3 0
cc-by-nc-sa-4.0 | 0.95 | (?:creative commons|cc) (?:by nc sa|attribution non(?: )?commercial share(?: )?alike)(?: licen[sc]e| international| unported)? 4 0
cc-by-nc-sa-3.0 | 0.95 | (?:creative commons|cc) (?:by nc sa|attribution non(?: )?commercial share(?: )?alike)(?: licen[sc]e| international| unported)? 3 0
cc-by-nc-nd | 0.9 | (?:creative commons|cc) (?:by nc nd|attribution non(?: )?commercial no(?: )?deriv(?:ative)?s)
cc-by-nc-sa | 0.9 | (?:creative commons|cc) (?:by nc sa|attribution non(?: )?commercial share(?: )?alike)
cc-by-sa-4.0 | 0.95 | (?:creative commons|cc) (?:by sa|attribution share(?: )?alike)(?: licen[sc]e| international| unported)? 4 0
cc-by-sa-3.0 | 0.95 | (?:creative commons|cc) (?:by sa|attribution share(?: )?alike)(?: licen[sc]e| international| unported)? 3 0
cc-by-sa-2.5 | 0.95 | (?:creative commons|cc) (?:by sa|attribution share(?: )?alike)(?: licen[sc]e| international| unported)? 2 5
cc-by-sa-2.0 | 0.95 | (?:creative commons|cc) (?:by sa|attribution share(?: )?alike)(?: licen[sc]e| international| unported)? 2 0
cc-by-sa | 0.9 | (?:creative commons|cc) (?:by sa|attribution share(?: )?alike)
cc-by-nc-4.0 | 0.95 | (?:creative commons|cc) (?:by nc|attribution non(?: )?commercial)(?: licen[sc]e| international| unported)? 4 0
cc-by-nc-3.0 | 0.95 | (?:creative commons|cc) (?:by nc|attribution non(?: )?commercial)(?: licen[sc]e| international| unported)? 3 0
cc-by-nc-2.0 | 0.95 | (?:creative commons|cc) (?:by nc|attribution non(?: )?commercial)(?: licen[sc]e| international| unported)? 2 0
cc-by-nc | 0.9 | (?:creative commons|cc) (?:by nc|attribution non(?: )?commercial)
cc-by-nd-4.0 | 0.95 | (?:creative commons|cc) (?:by nd|attribution no(?: )?deriv(?:ative)?s)(?: licen[sc]e| international| unported)? 4 0
cc-by-nd-3.0 | 0.95 | (?:creative commons|cc) (?:by nd|attribution no(?: )?deriv(?:ative)?s)(?: licen[sc]e| international| unported)? 3 0
cc-by-nd | 0.9 | (?:creative commons|cc) (?:by nd|attribution no(?: )?deriv(?:ative)?s)
cc-by-4.0 | 0.95 | (?:creative commons|cc) (?:by|attribution)(?: licen[sc]e| international| unported)? 4 0
cc-by-3.0 | 0.95 | (?:creative commons|cc) (?:by|attribution)(?: licen[sc]e| international| unported)? 3 0
cc-by-2.5 | 0.95 | (?:creative commons|cc) (?:by|attribution)(?: licen[sc]e| international| unported)? 2 5
cc-by-2.0 | 0.95 | (?:creative commons|cc) (?:by|attribution)(?: licen[sc]e| international| unported)? 2 0
cc-by-1.0 | 0.95 | (?:creative commons|cc) (?:by|attribution)(?: licen[sc]e| international| unported)? 1 0
cc0-1.0 | 0.95 | (?:creative commons|cc) zero(?: version| v)? 1 0
cc0 | 0.8 | (?:creative commons|cc) zero
cc-by | 0.8 | creative commons attribution(?: licen[sc]e)?
cc | 0.7 | creative commons licen[sc]e
# cc0
cc0-1.0 | 0.95 | cc0(?: version| v)? 1 0(?: universal)?
cc0 | 0.8 | cc0(?: licen[sc]e)?
# open data
odc-by-1.0 | 0.95 | (?:open data commons attribution licen[sc]e|odc by)(?: version| v)? (?:v)?1 0
odc-by | 0.9 | open data commons attribution licen[sc]e
odc-by | 0.8 | odc by
pddl-1.0 | 0.9 | open data commons public domain dedication(?: and)?(?: licen[sc]e)?
odbl-1.0 | 0.95 | open database licen[sc]e(?: odbl)?(?: version| v)? (?:v)?1 0
odbl-1.0 | 0.95 | odbl(?: version| v)? (?:v)?1 0
odbl | 0.8 | open database licen[sc]e
odbl | 0.8 | odbl(?: licen[sc]e)?
ogl-3.0 | 0.9 | open government licen[sc]e(?: version| v)? (?:v)?3 0
ogl | 0.8 | open government licen[sc]e
# boost
bsl-1.0 | 0.95 | boost software licen[sc]e(?: version| v)? (?:v)?1 0
bsl-1.0 | 0.9 | bsl(?: version| v)? 1 0
busl-1.1 | 0.9 | business source licen[sc]e(?: version| v)? (?:v)?1 1
busl | 0.8 | business source licen[sc]e
bsl | 0.8 | boost software licen[sc]e
# microsoft
ms-pl | 0.95 | microsoft public licen[sc]e(?: ms pl)?(?: 1 0)?
ms-rl | 0.95 | microsoft reciprocal licen[sc]e(?: ms rl)?(?: 1 0)?
ms-pl | 0.8 | ms pl(?: 1 0)?
ms-rl | 0.8 | ms rl(?: 1 0)?
# zope
zpl-2.1 | 0.95 | zope public licen[sc]e(?: zpl)?(?: version| v)? (?:v)?2 1
zpl-2.0 | 0.95 | zope public licen[sc]e(?: zpl)?(?: version| v)? (?:v)?2 0
zpl-1.1 | 0.95 | zope public licen[sc]e(?: zpl)?(?: version| v)? (?:v)?1 1
zpl-2.1 | 0.9 | zpl(?: version| v)? (?:v)?2 1
zpl-2.0 | 0.9 | zpl(?: version| v)? (?:v)?2 0
zpl | 0.8 | zope public licen[sc]e
# python
psf-2.0 | 0.95 | python software foundation licen[sc]e(?: version| v)? (?:v)?2(?: 0)?
psf-2.0 | 0.9 | psf(?: version| v)? (?:v)?2 0
psf | 0.8 | python software foundation licen[sc]e
psf | 0.8 | psf licen[sc]e
# fonts
ofl-1.1 | 1.0 | this font software is licensed under the sil open font licen[sc]e version 1 1
ofl-1.1 | 0.95 | (?:sil )?open font licen[sc]e(?: ofl)?(?: version| v)? (?:v)?1 1
ofl-1.0 | 0.95 | (?:sil )?open font licen[sc]e(?: ofl)?(?: version| v)? (?:v)?1 0
ofl-1.1 | 0.9 | ofl(?: version| v)? (?:v)?1 1
ofl-1.0 | 0.9 | ofl(?: version| v)? (?:v)?1 0
ofl | 0.8 | open font licen[sc]e
# small permissive
isc | 1.0 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 0.8 | isc licen[sc]e
isc | 0.9 | (?:1 0|2 0|3 0|clause|only|later|mit) (?:or|and) isc
zlib | 1.0 | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 0.8 | zlib(?: libpng)? licen[sc]e
zlib | 0.9 | (?:1 0|2 0|3 0|clause|only|later|mit) (?:or|and) zlib
libpng | 0.8 | libpng licen[sc]e
curl | 0.8 | curl licen[sc]e
postgresql | 0.8 | postgresql licen[sc]e
ruby | 0.8 | ruby licen[sc]e
php-3.01 | 0.9 | php licen[sc]e(?: version| v)? (?:v)?3 01
php | 0.8 | php licen[sc]e
vim | 0.8 | vim licen[sc]e
upl-1.0 | 0.9 | universal permissive licen[sc]e(?: version| v)? (?:v)?1 0
blueoak-1.0.0 | 0.9 | blue oak model licen[sc]e(?: 1 0 0)?
json | 0.9 | the software shall be used for good not evil
beerware | 0.8 | beer(?: )?ware licen[sc]e
cpl-1.0 | 0.9 | common public licen[sc]e(?: version| v)? (?:v)?1 0
ipl-1.0 | 0.9 | ibm public licen[sc]e(?: version| v)? (?:v)?1 0
sspl-1.0 | 0.9 | server side public licen[sc]e(?: sspl)?(?: version| v)? (?:v)?1(?: 0)?
sspl-1.0 | 0.9 | sspl(?: version| v)? (?:v)?1 0
sspl | 0.8 | server side public licen[sc]e
elastic-2.0 | 0.9 | elastic licen[sc]e(?: version| v)? (?:v)?2 0
unicode | 0.8 | unicode(?: data files and software)? licen[sc]e agreement
# public domain
wtfpl | 0.95 | do what the [^ ]+ you want to public licen[sc]e
wtfpl | 0.8 | wtfpl(?: licen[sc]e)?
unlicense | 1.0 | this is free and unencumbered software released into the public domain
unlicense | 0.8 | unlicense
public-domain | 0.9 | (?:dedicated|released|placed|put) (?:in|into|to) the public domain
public-domain | 0.8 | (?:in|into|to) the public domain
public-domain | 0.8 | public domain dedication
# identifiers
isc | 1.0 | spdx licen[sc]e identifier isc
zlib | 1.0 | spdx licen[sc]e identifier zlib
libpng | 1.0 | spdx licen[sc]e identifier libpng
curl | 1.0 | spdx licen[sc]e identifier curl
postgresql | 1.0 | spdx licen[sc]e identifier postgresql
ruby | 1.0 | spdx licen[sc]e identifier ruby
vim | 1.0 | spdx licen[sc]e identifier vim
ncsa | 1.0 | spdx licen[sc]e identifier ncsa
x11 | 1.0 | spdx licen[sc]e identifier x11
hpnd | 1.0 | spdx licen[sc]e identifier hpnd
beerware | 1.0 | spdx licen[sc]e identifier beerware
json | 1.0 | spdx licen[sc]e identifier json
upl-1.0 | 0.9 | upl 1 0
blueoak-1.0.0 | 0.9 | blueoak 1 0 0
cpl-1.0 | 0.9 | cpl 1 0
ipl-1.0 | 0.9 | ipl 1 0
elastic-2.0 | 0.9 | elastic 2 0
ecl-2.0 | 0.9 | ecl 2 0
pddl-1.0 | 0.9 | pddl 1 0
php-3.01 | 0.9 | php 3 01
mulanpsl-2.0 | 0.9 | mulanpsl 2 0
lppl-1.3c | 0.9 | lppl 1 3c
libpng-2.0 | 0.9 | libpng 2 0
unicode-dfs-2016 | 0.9 | unicode dfs 2016
apache-1.1 | 0.9 | apache 1 1
apache-1.0 | 0.9 | spdx licen[sc]e identifier apache 1 0
python-2.0 | 0.9 | python 2 0 licen[sc]e
python-2.0 | 0.9 | spdx licen[sc]e identifier python 2 0
busl-1.1 | 0.9 | busl 1 1
# exceptions
gcc-exception-2.0 | 0.9 | gcc exception 2 0
classpath-exception-2.0 | 0.9 | classpath exception(?: 2 0)?
gcc-exception-3.1 | 0.9 | gcc (?:runtime library )?exception(?: 3 1)?
llvm-exception | 0.9 | llvm exception
autoconf-exception-2.0 | 0.9 | autoconf exception 2 0
autoconf-exception-3.0 | 0.9 | autoconf exception 3 0
bison-exception-2.2 | 0.9 | bison exception(?: 2 2)?
font-exception-2.0 | 0.9 | font exception(?: 2 0)?
linux-syscall-note | 0.9 | linux syscall note
openssl-exception | 0.9 | openssl (?:linking )?exception
# restrictions
proprietary | 0.8 | all rights reserved
proprietary | 0.9 | unauthori[sz]ed (?:copying|reproduction|distribution) of this (?:file|software|document) is strictly prohibited
proprietary | 0.8 | may not be reproduced or (?:transmitted|distributed) in any form
no-warranty | 0.8 | without warranty of any kind
no-warranty | 0.8 | without warranties or conditions of any kind
"""


#: Stretches that are no use as keywords, because they are common words or bare versions, with or without their tails.
WEAK = {"under", "later", "licen", "licen ", "version", "1 0", "2 0", "e", "e version", "agreement", "e agreement"}


@dataclass(frozen=True)
class Rule:
    priority: int
    family: str
    label: str
    sure: float
    regex: str
    #: Stretches of the joined words, one of which every text of the rule holds.
    keywords: tuple[str, ...]


def _stretch(regex: str) -> tuple[int, str]:
    """(use, stretch): the most telling literal stretch that stands outside groups and sets."""
    depth, flat = 0, " "  # a match begins and ends beside a space
    for token in re.findall(r"\(\?:|\)\??|\[[^\]]*\][+*?]?|.", regex):
        depth += {"(": 1, ")": -1}.get(token[0], 0)
        if token[0] in "()[":
            flat += "\0"
        elif depth == 0:
            flat += token
    weak = lambda x: x in WEAK or re.fullmatch(r"[\d ⁺]*(?:only|or)?", x)
    told = [(0 if weak(x.strip()) else len(x.strip()), x) for x in (flat + " ").split("\0")]
    return max(told, key=lambda t: (t[0], len(t[1])))


def first_letters(regex: str) -> set[str]:
    """The characters that a match can begin with."""
    group = re.match(r"\(\?:([^()]*)\)(\??)", regex)
    if not group:
        return {regex[0]}
    return {branch[0] for branch in group[1].split("|")} | (first_letters(regex[group.end() :]) if group[2] else set())


def keywords_of(regex: str) -> tuple[str, ...]:
    """Stretches one of which every match of ``regex`` holds.

    A stretch outside all groups will do if it tells enough; else every branch of the first group that
    is not optional is looked at in its place.
    """
    use, stretch = _stretch(regex)
    group = re.search(r"\(\?:([^()]*\|[^()]*)\)(?!\?)", regex)
    if use >= 3 or not group:
        return (stretch,)
    return tuple(sorted({k for branch in group[1].split("|") for k in keywords_of(regex[: group.start()] + branch + regex[group.end() :])}))


def _read(table: str) -> list[Rule]:
    rules, family = [], ""
    for line in table.strip().splitlines():
        if line.startswith("# "):
            family = line[2:]
            continue
        label, sure, regex = (x.strip() for x in line.split("|", 2))
        rules.append(Rule(len(rules), family, label, float(sure), regex, keywords_of(regex)))
    return rules


RULES = _read(gnu_table() + TABLE)


def keywords(rules: list[Rule]) -> list[str]:
    """The keywords of ``rules`` without those that hold a shorter one: no rule fits words without any of them."""
    found: list[str] = []
    for k in sorted({k for r in rules for k in r.keywords}, key=lambda k: (len(k), k)):
        if not any(f in k for f in found):
            found.append(k)
    return found


def families(rules: list[Rule] = RULES) -> dict[str, list[Rule]]:
    """Rules by family, in order."""
    found: dict[str, list[Rule]] = {}
    for r in rules:
        found.setdefault(r.family, []).append(r)
    return found
