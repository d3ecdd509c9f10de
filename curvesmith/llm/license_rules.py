"""Licence signatures, written over normalised words (lower case, one space between words, punctuation gone).

LICENCES: label; pattern of the full name; pattern of the short name; words of the SPDX identifier; keyword that any text
with one of them holds. FORMS says how a name becomes rules of falling strength. EXTRA are single signatures, NOTICES what
notices, headers and licence texts say, and FURTHER the other identifiers of SPDX expressions.
"""

from __future__ import annotations

#: label | full name | short name | SPDX words | keyword of the full name | keyword of the short name
LICENCES = """
mit | mit licen[sc]e | mit | mit | mit licen | mit
mit-0 | mit no attribution(?: licen[sc]e)? | mit 0 | mit 0 | mit no | mit 0
apache-2 | apache (?:software )?licen[sc]e (?:version |v )?2(?: 0)? | apache 2(?: 0)? | apache 2 0 | apache | apache 2
apache-1.1 | apache (?:software )?licen[sc]e (?:version |v )?1 1 | apache 1 1 | apache 1 1 | apache | apache 1
apache-1.0 | apache (?:software )?licen[sc]e (?:version |v )?1 0 | apache 1 0 | apache 1 0 | apache | apache 1
gpl-3 | gnu general public licen[sc]e (?:version |v )?3(?: 0)? | (?:gnu )?gpl ?(?:version |v ?)?3(?: 0)? | gpl 3 0(?: only| or later)? | general public | gpl
gpl-2 | gnu general public licen[sc]e (?:version |v )?2(?: 0)? | (?:gnu )?gpl ?(?:version |v ?)?2(?: 0)? | gpl 2 0(?: only| or later)? | general public | gpl
gpl-1 | gnu general public licen[sc]e (?:version |v )?1(?: 0)? | (?:gnu )?gpl ?(?:version |v ?)?1(?: 0)? | gpl 1 0(?: only| or later)? | general public | gpl
lgpl-3 | gnu lesser general public licen[sc]e (?:version |v )?3(?: 0)? | (?:gnu )?lgpl ?(?:version |v ?)?3(?: 0)? | lgpl 3 0(?: only| or later)? | lesser general | lgpl
lgpl-2.1 | gnu lesser general public licen[sc]e (?:version |v )?2 1 | (?:gnu )?lgpl ?(?:version |v ?)?2 1 | lgpl 2 1(?: only| or later)? | lesser general | lgpl
lgpl-2 | gnu library general public licen[sc]e (?:version |v )?2(?: 0)? | (?:gnu )?lgpl ?(?:version |v ?)?2 0 | lgpl 2 0(?: only| or later)? | library general | lgpl
agpl-3 | gnu affero general public licen[sc]e (?:version |v )?3(?: 0)? | (?:gnu )?agpl ?(?:version |v ?)?3(?: 0)? | agpl 3 0(?: only| or later)? | affero general | agpl
gfdl | gnu free documentation licen[sc]e | gfdl | gfdl 1 [123](?: only| or later)? | free documentation | gfdl
bsd-2 | (?:simplified|2 clause|two clause) bsd licen[sc]e | bsd 2 clause | bsd 2 clause | bsd | bsd 2
bsd-3 | (?:new|revised|modified|3 clause|three clause) bsd licen[sc]e | bsd 3 clause | bsd 3 clause | bsd | bsd 3
bsd-4 | (?:original|4 clause|four clause) bsd licen[sc]e | bsd 4 clause | bsd 4 clause | bsd | bsd 4
0bsd | (?:zero clause bsd|bsd zero clause) licen[sc]e | 0bsd | 0bsd | zero clause | 0bsd
mpl-2 | mozilla public licen[sc]e (?:version |v )?2(?: 0)? | mpl (?:version |v )?2(?: 0)? | mpl 2 0 | mozilla public | mpl
mpl-1.1 | mozilla public licen[sc]e (?:version |v )?1 1 | mpl (?:version |v )?1 1 | mpl 1 1 | mozilla public | mpl
epl-2 | eclipse public licen[sc]e (?:version |v )?2(?: 0)? | epl (?:version |v )?2(?: 0)? | epl 2 0 | eclipse public | epl
epl-1 | eclipse public licen[sc]e (?:version |v )?1(?: 0)? | epl (?:version |v )?1(?: 0)? | epl 1 0 | eclipse public | epl
cddl | common development and distribution licen[sc]e | cddl | cddl 1 [01] | common development | cddl
cpl-1 | common public licen[sc]e (?:version )?1 0 | cpl 1 0 | cpl 1 0 | common public | cpl
eupl | european union public licen[sc]e | eupl | eupl 1 [0-2] | european union public | eupl
isc | isc licen[sc]e | isc | isc | isc licen | isc
zlib | zlib licen[sc]e | zlib | zlib | zlib | zlib
unlicense | the unlicen[sc]e | unlicen[sc]e | unlicense | unlicen | unlicen
wtfpl | do what the fuck you want to public licen[sc]e | wtfpl | wtfpl | do what the | wtfpl
artistic-2 | artistic licen[sc]e (?:version )?2(?: 0)? | artistic 2(?: 0)? | artistic 2 0 | artistic licen | artistic 2
artistic-1 | artistic licen[sc]e (?:version )?1(?: 0)? | artistic 1(?: 0)? | artistic 1 0 | artistic licen | artistic 1
bsl-1 | boost software licen[sc]e(?: version)?(?: 1 0)? | bsl 1 0 | bsl 1 0 | boost software | bsl
psf | python software foundation licen[sc]e(?: version 2)? | psf licen[sc]e | python 2 0 | python software | psf
openssl | openssl licen[sc]e | openssl and ssleay | openssl | openssl | openssl
ofl | sil open font licen[sc]e(?: version)?(?: 1 1)? | ofl 1 1 | ofl 1 [01] | open font | ofl
ms-pl | microsoft public licen[sc]e | ms pl | ms pl | microsoft public | ms pl
ms-rl | microsoft reciprocal licen[sc]e | ms rl | ms rl | microsoft reciprocal | ms rl
afl-3 | academic free licen[sc]e(?: version)?(?: 3 0)? | afl 3 0 | afl 3 0 | academic free | afl
osl-3 | open software licen[sc]e(?: version)?(?: 3 0)? | osl 3 0 | osl 3 0 | open software | osl
ncsa | university of illinois ncsa open source licen[sc]e | ncsa open source | ncsa | ncsa | ncsa
postgresql | postgresql licen[sc]e | postgresql licen[sc]ed | postgresql | postgresql | postgresql
odbl | open database licen[sc]e | odbl | odbl 1 0 | open database | odbl
odc-by | open data commons attribution licen[sc]e | odc by | odc by 1 0 | open data commons | odc by
pddl | public domain dedication and licen[sc]e | pddl | pddl 1 0 | public domain dedication | pddl
cc0 | (?:creative commons zero|cc0 1 0 universal) | cc0 | cc0 1 0 | c | cc0
cc-by | creative commons attribution(?: [1234] [05])? (?:international|unported|licen[sc]e) | cc by(?: [1234] [05])? | cc by [1234] [05] | creative commons | cc by
cc-by-sa | creative commons attribution share ?alike | cc by sa(?: [1234] [05])? | cc by sa [1234] [05] | creative commons | cc by sa
cc-by-nd | creative commons attribution no ?deriv(?:ative)?s? | cc by nd(?: [1234] [05])? | cc by nd [1234] [05] | creative commons | cc by nd
cc-by-nc | creative commons attribution non ?commercial | cc by nc(?: [1234] [05])? | cc by nc [1234] [05] | creative commons | cc by nc
cc-by-nc-sa | creative commons attribution non ?commercial share ?alike | cc by nc sa(?: [1234] [05])? | cc by nc sa [1234] [05] | creative commons | cc by nc sa
cc-by-nc-nd | creative commons attribution non ?commercial no ?deriv(?:ative)?s? | cc by nc nd(?: [1234] [05])? | cc by nc nd [1234] [05] | creative commons | cc by nc nd
"""

#: strength (smaller is stronger), score, pattern with FULL, SHORT or SPDX in it
FORMS = """
1 | 1.0 | spdx license identifier SPDX
2 | 0.95 | (?:licen[sc]ed|released|distributed|published|available|provided|covered|governed) (?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?FULL
2 | 0.9 | (?:licen[sc]ed|released|distributed|published|available|provided|covered|governed) (?:under|by) (?:the )?(?:terms of )?(?:the )?SHORT(?: licen[sc]e)?
3 | 0.8 | FULL
4 | 0.6 | SHORT licen[sc]e[ds]?
4 | 0.6 | licen[sc]e (?:is )?(?:the )?SHORT
"""

#: label | strength | score | keyword | pattern
EXTRA = """
mit | 2 | 0.95 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy
isc | 2 | 0.95 | permission to use | permission to use copy modify and or distribute this software for any purpose
bsd | 2 | 0.9 | redistribution and use | redistribution and use in source and binary forms with or without modification
zlib | 2 | 0.9 | this software is provided | this software is provided as is without any express or implied warranty in no event will the authors
gpl | 4 | 0.5 | general public licen | (?:gnu )?general public licen[sc]e
lgpl | 4 | 0.5 | lesser general public | (?:gnu )?lesser general public licen[sc]e
agpl | 4 | 0.5 | affero general public | (?:gnu )?affero general public licen[sc]e
mpl | 4 | 0.5 | mozilla public | mozilla public licen[sc]e
apache | 4 | 0.5 | apache licen | apache licen[sc]e
bsd | 4 | 0.5 | bsd licen | bsd licen[sc]e
creative-commons | 4 | 0.4 | creative commons | creative commons
public-domain | 3 | 0.7 | public domain | (?:released|dedicated|placed) (?:in|into|to) the public domain
all-rights-reserved | 3 | 0.7 | all rights reserved | all rights reserved
proprietary | 3 | 0.7 | proprietary | proprietary and confidential
gpl-3 | 2 | 0.9 | general public licen | general public licen[sc]e version 3
gpl-2 | 2 | 0.9 | general public licen | general public licen[sc]e version 2
"""

#: Fixed wordings of notices, file headers, licence texts and addresses, one by one: label | strength | score | keyword | pattern
NOTICES = """
gpl-3 | 2 | 0.95 | published by the free software | general public licen[sc]e as published by the free software foundation (?:either )?version 3(?: 0)?
gpl-2 | 2 | 0.95 | published by the free software | general public licen[sc]e as published by the free software foundation (?:either )?version 2(?: 0)?
gpl-1 | 2 | 0.95 | published by the free software | general public licen[sc]e as published by the free software foundation (?:either )?version 1(?: 0)?
lgpl-3 | 2 | 0.95 | lesser general public | (?:gnu )?lesser general public licen[sc]e as published by the free software foundation (?:either )?version 3(?: 0)?
lgpl-2.1 | 2 | 0.95 | lesser general public | (?:gnu )?lesser general public licen[sc]e as published by the free software foundation (?:either )?version 2 1
lgpl-2 | 2 | 0.95 | library general public | (?:gnu )?library general public licen[sc]e as published by the free software foundation (?:either )?version 2(?: 0)?
agpl-3 | 2 | 0.95 | affero general public | (?:gnu )?affero general public licen[sc]e as published by the free software foundation (?:either )?version 3(?: 0)?
gpl | 3 | 0.7 | you should have received a copy | you should have received a copy of the gnu general public licen[sc]e
lgpl | 3 | 0.7 | you should have received a copy | you should have received a copy of the gnu lesser general public licen[sc]e
gpl | 3 | 0.7 | everyone is permitted | everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed
gfdl | 2 | 0.95 | permission is granted | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e
apache-2 | 2 | 0.95 | you may not use this file | licen[sc]ed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file except in compliance with the licen[sc]e
apache-2 | 3 | 0.8 | www apache org | www apache org licen[sc]es licen[sc]e 2 0
apache-1.1 | 3 | 0.8 | the apache group | the names apache and apache software foundation must not be used to endorse or promote products
mpl-2 | 2 | 0.95 | this source code form | this source code form is subject to the terms of the mozilla public licen[sc]e v ?2 0
mpl-1.1 | 2 | 0.95 | the contents of this file | the contents of this file are subject to the mozilla public licen[sc]e version 1 1
cddl | 2 | 0.95 | the contents of this file | the contents of this file are subject to the terms of the common development and distribution licen[sc]e
epl-2 | 2 | 0.95 | the accompanying materials | the accompanying materials are made available under the terms of the eclipse public licen[sc]e (?:v |version )?2 0
epl-1 | 2 | 0.95 | the accompanying materials | the accompanying materials are made available under the terms of the eclipse public licen[sc]e v(?:ersion )?1 0
cpl-1 | 2 | 0.95 | the accompanying materials | the accompanying materials are made available under the terms of the common public licen[sc]e v(?:ersion )?1 0
mit | 2 | 0.95 | substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 2 | 0.9 | use of this source code | use of this source code is governed by an mit style licen[sc]e
mit-0 | 2 | 0.95 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[sc]e and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is
bsd | 2 | 0.9 | use of this source code | use of this source code is governed by a bsd style licen[sc]e
bsd-2 | 3 | 0.7 | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided
bsd-3 | 2 | 0.95 | neither the name | neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
bsd-3 | 2 | 0.95 | neither the name | neither the name of the university nor the names of its contributors may be used to endorse or promote products
bsd-4 | 2 | 0.95 | all advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
isc | 2 | 0.9 | permission to use | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
postgresql | 2 | 0.95 | permission to use | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
zlib | 2 | 0.95 | altered source versions | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
bsl-1 | 2 | 0.95 | boost software licen | distributed under the boost software licen[sc]e version 1 0
bsl-1 | 3 | 0.8 | www boost org | www boost org licen[sc]e 1 0 txt
unlicense | 2 | 0.95 | free and unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 2 | 0.95 | everyone is permitted | everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document and changing it is allowed
openssl | 2 | 0.9 | openssl toolkit | software developed by the openssl project for use in the openssl toolkit
ofl | 2 | 0.95 | this font software | this font software is licen[sc]ed under the sil open font licen[sc]e version 1 1
eupl | 2 | 0.95 | under the eupl | licen[sc]ed under the eupl(?: version)? 1 [0-2]
artistic-2 | 2 | 0.9 | artistic licen | under the terms of the artistic licen[sc]e 2 0
ncsa | 2 | 0.9 | university of illinois | neither the names of the university of illinois nor the names of its contributors may be used to endorse or promote products
odbl | 3 | 0.8 | opendatacommons org | opendatacommons org licen[sc]es odbl
odc-by | 3 | 0.8 | opendatacommons org | opendatacommons org licen[sc]es by
pddl | 3 | 0.8 | opendatacommons org | opendatacommons org licen[sc]es pddl
cc0 | 2 | 0.9 | creativecommons org publicdomain | creativecommons org publicdomain zero 1 0
cc-by | 2 | 0.9 | creativecommons org licen | creativecommons org licen[sc]es by [1234] [05]
cc-by-sa | 2 | 0.9 | creativecommons org licen | creativecommons org licen[sc]es by sa [1234] [05]
cc-by-nd | 2 | 0.9 | creativecommons org licen | creativecommons org licen[sc]es by nd [1234] [05]
cc-by-nc | 2 | 0.9 | creativecommons org licen | creativecommons org licen[sc]es by nc [1234] [05]
cc-by-nc-sa | 2 | 0.9 | creativecommons org licen | creativecommons org licen[sc]es by nc sa [1234] [05]
cc-by-nc-nd | 2 | 0.9 | creativecommons org licen | creativecommons org licen[sc]es by nc nd [1234] [05]
proprietary | 3 | 0.7 | confidential | this software is the confidential and proprietary information of
"""
#: strength, score, keyword, pattern of the further identifiers of an SPDX expression, as in "MIT OR Apache-2.0"; weaker than
#: the first one, which stays beside them.
FURTHER = (3, 0.85, "spdx license identifier", "(?:or|and) SPDX")


def cells(text: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(" | ")] for line in text.strip().splitlines()]


def rules() -> list[dict]:
    """All signatures in order: {keyword, regex, label, level, score}."""
    out = []
    for label, full, short, spdx, has_full, has_short in cells(LICENCES):
        for level, score, form in cells(FORMS):
            if "SPDX" in form:
                keyword, regex = "spdx license identifier", form.replace("SPDX", spdx)
            elif "FULL" in form:
                keyword, regex = has_full, form.replace("FULL", full)
            else:
                keyword, regex = has_short, form.replace("SHORT", short)
            out.append((keyword, regex, label, int(level), float(score)))
        level, score, keyword, form = FURTHER
        out.append((keyword, form.replace("SPDX", spdx), label, level, score))
    for label, level, score, keyword, regex in cells(EXTRA) + cells(NOTICES):
        out.append((keyword, regex, label, int(level), float(score)))
    return [{"keyword": k, "regex": f"(?<= )(?:{r})(?= )", "label": n, "level": v, "score": s} for k, r, n, v, s in out]


#: Base phrases and labels of the contract, in order.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
