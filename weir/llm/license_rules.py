"""Signature rules of the license scan.

A rule is (label, priority, confidence in hundredths, keyword, pattern). The keyword is a
word that every match contains. A pattern is a sequence of elements with spaces between:
``abc`` a word, ``a|b`` one of several, ``[abc]`` a word that may be missing, ``*3`` up to
three words; an element may be a regular expression over word characters. Priorities:
3 a grant or a full-text passage, 2 a name or notice, 1 a hint.
"""

from __future__ import annotations

LIC = "licen[sc]es?"
#: The phrases that are labelled wherever they stand.
BASE = [("cc-by", 2, 60, "cc", "cc by"), ("gpl", 2, 60, "license", "general public license"), ("reserved", 1, 30, "reserved", "all rights reserved")]

_GRANTS = """
mit | permission | permission is hereby granted free of charge to any person obtaining a copy
mit | software | the software is provided as is without warranty of any kind
mit | copyright | the above copyright notice and this permission notice shall be included in all copies
isc | permission | permission to use copy modify and or distribute this software for any purpose
isc | permission | permission to use copy modify and distribute this software for any purpose
isc | author | the software is provided as is and the author disclaims all warranties
0bsd | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions | redistributions of source code must retain the above copyright notice
bsd | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | endorse | neither the name of *8 may be used to endorse or promote products
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display
bsd | warranties | this software is provided by the *6 as is and any express or implied warranties
apache-2.0 | apache | licensed under the apache LIC version 2 [0]
apache-2.0 | compliance | you may not use this file except in compliance with the LIC
apache-2.0 | law | unless required by applicable law or agreed to in writing software distributed under the LIC
apache-2.0 | perpetual | grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright LIC
apache-1.1 | apache | this product includes software developed by the apache software foundation
gpl | redistribute | you can redistribute it and or modify it under the terms of the gnu general public LIC
gpl | warranty | without even the implied warranty of merchantability or fitness for a particular purpose
gpl | copy | you should have received a copy of the gnu general public LIC
gpl | free | this program is free software you can redistribute it
lgpl | library | you can redistribute it and or modify it under the terms of the gnu lesser|library general public LIC
lgpl | copy | you should have received a copy of the gnu lesser|library general public LIC
lgpl | library | this library is free software you can redistribute it
agpl | affero | under the terms of the gnu affero general public LIC
agpl | affero | you should have received a copy of the gnu affero general public LIC
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public LIC
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public LIC
mpl-2.0 | incompatible | incompatible with secondary licenses as defined by the mozilla public LIC
epl | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public LIC
cddl | cddl|distribution | subject to the terms of the common development and distribution LIC
artistic | artistic | you may redistribute this *4 under the terms of the artistic LIC
boost | boost | distributed under the boost software LIC
boost | permission | permission is hereby granted free of charge to any person or organization obtaining a copy
zlib | warranty | this software is provided as is without any express or implied warranty
zlib | altered | altered source versions must be plainly marked as such
unlicense | public | this is free and unencumbered software released into the public domain
wtfpl | public | do what the fuck you want to public LIC
cc0 | waived | waived all copyright and related or neighboring rights
cc0 | cc0 | to the extent possible under law *12 cc0
public-domain | public | dedicated|released|placed [in]to the public domain
public-domain | public | this *3 is in the public domain
cc-by | attribution | licensed under a|the creative commons attribution *2 [international] LIC
cc-by-sa | sharealike | licensed under a|the creative commons attribution sharealike
cc-by-nc | noncommercial | licensed under a|the creative commons attribution noncommercial
cc-by-nd | noderivs|noderivatives | licensed under a|the creative commons attribution noderivs|noderivatives
ofl | open | this font software is licensed under the sil open font LIC
ofl | reserved | with reserved font name
postgresql | permission | permission to use copy modify and distribute this software and its documentation for any purpose
openssl | openssl | this product includes software developed by the openssl project
php | php | this product includes php software
python | python | python software foundation LIC agreement
ms-pl | microsoft | microsoft public LIC
afl | academic | licensed under the academic free LIC
osl | open | licensed under the open software LIC
eupl | eupl|union | licensed under the *2 european union public LIC
proprietary | permission | no part of this *4 may be reproduced
proprietary | permission | may not be reproduced *6 without [the] [prior] [express] [written] permission
proprietary | confidential | confidential and proprietary
proprietary | unauthorized | unauthorized copying of this file via any medium is strictly prohibited
proprietary | consent | without the prior written consent of the
proprietary | nda|disclosure | subject to a non disclosure agreement
commercial | commercial | for non commercial use only
commercial | commercial | commercial LIC is required
commercial | evaluation | for evaluation purposes only
no-derivatives | derivative | no derivative works may be
attribution | attribution | attribution is required
attribution | credit | with appropriate credit to the author
share-alike | distribute | distribute your contributions under the same LIC
"""

_NOTICES = """
mit | LIC | mit LIC
mit | LIC | LIC mit
mit | expat | expat LIC
mit-0 | attribution | mit no attribution
isc | LIC | isc LIC
bsd | bsd | bsd LIC
bsd | bsd | bsd style LIC
bsd | bsd | new|simplified|modified|original bsd
bsd-2-clause | bsd|clause | bsd 2 clause
bsd-2-clause | clause | 2 clause bsd
bsd-3-clause | clause | bsd 3 clause
bsd-3-clause | clause | 3 clause bsd
bsd-4-clause | clause | bsd 4 clause
apache | apache | apache LIC
apache | apache | apache software foundation
apache-2.0 | apache | apache 2 [0]
apache-2.0 | apache | apache LIC [version] 2 [0]
apache-1.1 | apache | apache LIC [version] 1 1
apache-2.0 | apache | apache org licenses LIC 2 0
mpl | mozilla | mozilla public LIC
mpl-2.0 | mpl|mozilla | mpl 2 0
mpl-1.1 | mpl|mozilla | mpl 1 1
epl | eclipse | eclipse public LIC
epl-1.0 | epl | epl 1 0
epl-2.0 | epl | epl 2 0
cddl | cddl | cddl 1 0|1
artistic | artistic | artistic LIC
perl | perl | same terms as perl [itself]
boost | boost | boost software LIC
bsl-1.0 | bsl | bsl 1 0
zlib | zlib | zlib LIC
libpng | libpng | libpng LIC
unlicense | unlicense | unlicense
wtfpl | wtfpl | wtfpl
cc0 | cc0 | cc0 [1] [0] [universal]
creative-commons | commons | creative commons
creative-commons | commons | creativecommons org licenses
public-domain | domain | public domain
ofl | ofl | sil ofl
postgresql | postgresql | postgresql LIC
openssl | openssl | openssl LIC
php | php | php LIC
python | psf | psf LIC
ruby | ruby | ruby LIC
vim | vim | vim LIC
w3c | w3c | w3c software *3 LIC
unicode | unicode | unicode LIC agreement
ijg | jpeg | independent jpeg group
curl | curl | curl LIC
ncsa | ncsa | university of illinois ncsa open source LIC
eupl | eupl | eupl
cecill | cecill | cecill
sspl | sspl | sspl
sspl | server | server side public LIC
busl | business | business source LIC
elastic | elastic | elastic LIC
ms-rl | microsoft | microsoft reciprocal LIC
proprietary | proprietary | proprietary LIC
proprietary | reserved | all rights reserved
proprietary | trade | trade secret
eula | end | end user LIC agreement
eula | eula | eula
copyright | copyright | copyright c [1-2][0-9]{3}
copyright | copyright | copyright [1-2][0-9]{3}
copyright | copyrighted | copyrighted material|work|by
spdx | spdx | spdx LIC identifier *4
odbl | odbl|database | open database LIC
odc-by | commons | open data commons attribution
pddl | pddl|domain | public domain dedication and LIC
ogl | government | open government LIC
gfdl | documentation | gnu free documentation LIC
gfdl | gfdl | gfdl
"""

_HINTS = """
license-text | LIC | under [the] LIC
license-text | licensed | licensed under
license-text | licensed | licensed to
license-text | LIC | see [the] LIC
license-text | LIC | LIC agreement
license-text | LIC | LIC file
license-text | LIC | open source LIC
license-text | LIC | free software LIC
license-text | LIC | terms of [the] LIC
license-text | LIC | LIC terms
license-text | relicensed | relicensed
license-text | sublicense | sublicense
license-text | redistribute | redistribute
warranty | warranty | without warranty
warranty | warranty | no warranty
warranty | warranties | disclaims *3 warranties
warranty | liable | in no event shall *8 liable
liability | liability | limitation of liability
patent | patent | patent LIC
patent | royalty | royalty free
terms | terms | terms of use
terms | terms | terms and conditions
terms | terms | terms of service
permission | permission | with permission of|from
permission | permission | reprinted|used with permission
copyright | copyright | copyright
copyright | copyrights | copyrights
copyleft | copyleft | copyleft
"""


def _listed(text: str, priority: int, confidence: int) -> list[tuple[str, int, int, str, str]]:
    found = []
    for line in filter(None, map(str.strip, text.splitlines())):
        label, keyword, pattern = (x.strip() for x in line.split(" | ", 2))
        for word in ("license", "licence", "licenses", "licences") if keyword == "LIC" else keyword.split("|"):
            found.append((label, priority, confidence, word, pattern.replace("LIC", LIC)))
    return found


def _families() -> list[tuple[str, int, int, str, str]]:
    """Families of versions, each spelled in several ways."""
    found = []
    for name, long, versions in (("gpl", "gnu general public", ("1", "2", "3")), ("lgpl", "gnu lesser general public", ("2", "2 1", "3")), ("agpl", "gnu affero general public", ("1", "3"))):
        for version in versions:
            label, dotted = f"{name}-{version.replace(' ', '.')}", f"{version}" if " " in version else f"{version} [0]"
            found += [(f"{label}-only", 3, 95, name, f"{name} [v] v?{dotted} only"), (f"{label}-or-later", 3, 95, name, f"{name} [v] v?{dotted} or later"), (label, 2, 85, name, f"{name} [v] v?{dotted}"), (label, 2, 85, name, f"{name} version {dotted}")]
            found += [(label, 3, 90, w, f"{long} {LIC} [as] [published] [by] [the] [free] [software] [foundation] [either] version {dotted}") for w in ("license", "licence")]
            found += [(label, 2, 85, w, f"{long} {LIC} v?{dotted}") for w in ("license", "licence")]
            if " " not in version:  # written as one word
                word = f"{name}v{version}"
                found += [(f"{label}-only", 3, 95, word, f"{word} [0] only"), (f"{label}-or-later", 3, 95, word, f"{word} [0] or later"), (f"{label}-or-later", 3, 95, f"{word}plus", f"{word}plus"), (label, 2, 85, word, f"{word} [0]")]
        found += [(name, 2, 70, w, f"{long} {LIC}") for w in ("license", "licence")]
        found.append((name, 1, 40, name, name))
    for suffix, words in (("", ""), ("-sa", " sa"), ("-nc", " nc"), ("-nd", " nd"), ("-nc-sa", " nc sa"), ("-nc-nd", " nc nd")):
        found.append((f"cc-by{suffix}", 2, 80, "cc", f"cc by{words}"))
        for version in ("2 0", "2 5", "3 0", "4 0"):
            found.append((f"cc-by{suffix}-{version.replace(' ', '.')}", 3, 92, "cc", f"cc by{words} {version}"))
    for suffix, words in (("", ""), ("-sa", " sharealike|sa"), ("-nc", " noncommercial|nc"), ("-nd", " noderivs|noderivatives|nd"), ("-nc-sa", " noncommercial sharealike"), ("-nc-nd", " noncommercial noderivs|noderivatives")):
        for version in ("2 0", "2 5", "3 0", "4 0"):
            found.append((f"cc-by{suffix}-{version.replace(' ', '.')}", 3, 92, "attribution", f"creative commons attribution{words} {version}"))
    return found


def compiled(pattern: str) -> str:
    """The pattern over marked words, each written as `` word#place;``; the same in Java's and RE2's syntax."""
    out = []
    for x in pattern.split():
        if x[0] == "*":
            out.append(r"(?: [^ #]+#\d+;){0,%s}?" % x[1:])
        elif x[0] == "[" and x[-1] == "]":
            out.append(r"(?: (?:%s)#\d+;)?" % x[1:-1])
        else:
            out.append(r" (?:%s)#\d+;" % x)
    return "".join(out)


#: (label, priority, confidence, keyword, regular expression), the more certain rule first among equals.
RULES = [(a, b, c, d, compiled(e)) for a, b, c, d, e in dict.fromkeys(sorted([*BASE, *_listed(_GRANTS, 3, 90), *_listed(_NOTICES, 2, 75), *_listed(_HINTS, 1, 30), *_families()], key=lambda r: (-r[1], -r[2], r[0], r[3], r[4])))]
BASE_RULES = [(label, keyword, compiled(phrase)) for label, _, _, keyword, phrase in BASE]
KEYWORDS = sorted({r[3] for r in RULES})
