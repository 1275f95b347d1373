"""Signature rules of the license scan, written over words joined by single spaces.

One rule a line: label | priority | keyword | pattern. The keyword is a word that every match holds; a
rule runs only on texts with its keyword. Priorities: 5 an identifier, 4 a notice or a versioned name,
3 a name, 2 an address, 1 a bare mention. Patterns are matched between word borders, without regard to
the case of A-Z.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str


_TABLE = r"""
mit | 4 | mit | under the mit licen[cs]e
mit | 4 | mit | licensed under (?:the )?(?:terms of the )?mit
mit | 3 | mit | (?:the )?mit licen[cs]e
mit | 3 | expat | expat licen[cs]e
mit | 5 | spdx | spdx license identifier mit
mit | 2 | opensource | opensource org licenses mit
mit | 4 | granted | permission is hereby granted free of charge to any person obtaining a copy of this software
mit-0 | 5 | spdx | spdx license identifier mit 0
mit-0 | 4 | attribution | mit no attribution(?: licen[cs]e)?
apache-2 | 4 | apache | apache licen[cs]e version 2
apache-2 | 4 | apache | apache licen[cs]e (?:v ?)?2(?: 0)?
apache-2 | 4 | apache | apache (?:software )?licen[cs]e version 2 0
apache-2 | 4 | apache | licensed under the apache licen[cs]e version 2 0
apache-2 | 5 | spdx | spdx license identifier apache 2 0
apache-2 | 2 | apache | apache org licenses license 2 0(?: txt| html)?
apache-1.1 | 4 | apache | apache (?:software )?licen[cs]e (?:version )?1 1
apache-1.1 | 5 | spdx | spdx license identifier apache 1 1
apache-1.0 | 4 | apache | apache (?:software )?licen[cs]e (?:version )?1 0
apache | 3 | apache | (?:the )?apache (?:software )?licen[cs]e
gpl-3 | 4 | gnu | gnu general public licen[cs]e version 3
gpl-3 | 4 | gnu | gnu general public licen[cs]e v ?3(?: 0)?
gpl-3 | 4 | gnu | gnu gpl (?:version |v ?)?3(?: 0)?
gpl-3 | 4 | gpl | gpl (?:version |v ?)?3(?: 0)?
gpl-3 | 3 | gplv3 | gplv3
gpl-3 | 5 | spdx | spdx license identifier gpl 3 0(?: only| or later)?
gpl-3 | 4 | gnu | gnu general public licen[cs]e as published by the free software foundation either version 3
gpl-2 | 4 | gnu | gnu general public licen[cs]e version 2
gpl-2 | 4 | gnu | gnu general public licen[cs]e v ?2(?: 0)?
gpl-2 | 4 | gnu | gnu gpl (?:version |v ?)?2(?: 0)?
gpl-2 | 4 | gpl | gpl (?:version |v ?)?2(?: 0)?
gpl-2 | 3 | gplv2 | gplv2
gpl-2 | 5 | spdx | spdx license identifier gpl 2 0(?: only| or later)?
gpl-2 | 4 | gnu | gnu general public licen[cs]e as published by the free software foundation either version 2
gpl-1 | 4 | gnu | gnu general public licen[cs]e version 1
gpl-1 | 5 | spdx | spdx license identifier gpl 1 0(?: only| or later)?
gpl | 3 | gnu | gnu general public licen[cs]e
gpl | 3 | gnu | gnu gpl
gpl | 2 | gnu | gnu org licenses gpl(?: html| txt)?
lgpl-3 | 4 | lesser | gnu lesser general public licen[cs]e (?:version |v ?)3(?: 0)?
lgpl-3 | 4 | lgpl | lgpl (?:version |v ?)?3(?: 0)?
lgpl-3 | 3 | lgplv3 | lgplv3
lgpl-3 | 5 | spdx | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-2.1 | 4 | lesser | gnu lesser general public licen[cs]e (?:version |v ?)2 1
lgpl-2.1 | 4 | lgpl | lgpl (?:version |v ?)?2 1
lgpl-2.1 | 5 | spdx | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2 | 4 | library | gnu library general public licen[cs]e(?: version 2(?: 0)?)?
lgpl-2 | 5 | spdx | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl | 3 | lesser | (?:gnu )?lesser general public licen[cs]e
lgpl | 2 | gnu | gnu org licenses lgpl(?: html| txt)?
agpl-3 | 4 | affero | gnu affero general public licen[cs]e (?:version |v ?)3(?: 0)?
agpl-3 | 3 | agplv3 | agplv3
agpl-3 | 4 | agpl | agpl (?:version |v ?)?3(?: 0)?
agpl-3 | 5 | spdx | spdx license identifier agpl 3 0(?: only| or later)?
agpl | 3 | affero | (?:gnu )?affero general public licen[cs]e
gfdl-1.3 | 4 | documentation | gnu free documentation licen[cs]e version 1 3
gfdl-1.2 | 4 | documentation | gnu free documentation licen[cs]e version 1 2
gfdl-1.1 | 4 | documentation | gnu free documentation licen[cs]e version 1 1
gfdl | 3 | documentation | gnu free documentation licen[cs]e
gfdl | 5 | spdx | spdx license identifier gfdl 1 [123](?: only| or later)?
bsd-3 | 4 | bsd | bsd 3 clause(?: licen[cs]e)?
bsd-3 | 4 | bsd | (?:3|three) clause bsd(?: licen[cs]e)?
bsd-3 | 4 | bsd | (?:new|modified|revised) bsd licen[cs]e
bsd-3 | 5 | spdx | spdx license identifier bsd 3 clause
bsd-3 | 4 | endorse | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-2 | 4 | bsd | bsd 2 clause(?: licen[cs]e)?
bsd-2 | 4 | bsd | (?:2|two) clause bsd(?: licen[cs]e)?
bsd-2 | 4 | bsd | (?:simplified|freebsd) bsd licen[cs]e
bsd-2 | 5 | spdx | spdx license identifier bsd 2 clause
bsd-4 | 4 | bsd | bsd 4 clause(?: licen[cs]e)?
bsd-4 | 4 | bsd | (?:4|four) clause bsd(?: licen[cs]e)?
bsd-4 | 4 | acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-4 | 5 | spdx | spdx license identifier bsd 4 clause
bsd-0 | 4 | bsd | (?:zero|0) clause bsd(?: licen[cs]e)?
bsd-0 | 5 | spdx | spdx license identifier 0bsd
bsd | 3 | bsd | (?:the )?bsd(?: style)? licen[cs]e
bsd | 4 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
isc | 3 | isc | (?:the )?isc licen[cs]e
isc | 5 | spdx | spdx license identifier isc
isc | 4 | fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
mpl-2 | 4 | mozilla | mozilla public licen[cs]e (?:version |v ?)2(?: 0)?
mpl-2 | 4 | mpl | mpl (?:version |v ?)?2(?: 0)?
mpl-2 | 5 | spdx | spdx license identifier mpl 2 0
mpl-2 | 2 | mozilla | mozilla org mpl 2 0
mpl-1.1 | 4 | mozilla | mozilla public licen[cs]e (?:version |v ?)1 1
mpl-1.1 | 5 | spdx | spdx license identifier mpl 1 1
mpl-1.0 | 4 | mozilla | mozilla public licen[cs]e (?:version |v ?)1 0
mpl | 3 | mozilla | mozilla public licen[cs]e
epl-2 | 4 | eclipse | eclipse public licen[cs]e (?:version |v ?)?2(?: 0)?
epl-2 | 5 | spdx | spdx license identifier epl 2 0
epl-1 | 4 | eclipse | eclipse public licen[cs]e (?:version |v ?)?1(?: 0)?
epl-1 | 5 | spdx | spdx license identifier epl 1 0
epl | 3 | eclipse | eclipse public licen[cs]e
edl-1 | 3 | eclipse | eclipse distribution licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?
cddl-1.1 | 4 | cddl | cddl (?:version |v ?)?1 1
cddl-1.0 | 4 | cddl | cddl (?:version |v ?)?1 0
cddl | 3 | distribution | common development and distribution licen[cs]e
cddl | 5 | spdx | spdx license identifier cddl 1 [01]
cpl-1 | 3 | common | common public licen[cs]e(?: (?:version )?1(?: 0)?)?
cpl-1 | 5 | spdx | spdx license identifier cpl 1 0
cpal-1 | 3 | common | common public attribution licen[cs]e(?: (?:version )?1(?: 0)?)?
cpal-1 | 5 | spdx | spdx license identifier cpal 1 0
ipl-1 | 3 | ibm | ibm public licen[cs]e(?: (?:version )?1(?: 0)?)?
artistic-2 | 4 | artistic | artistic licen[cs]e (?:version |v ?)?2(?: 0)?
artistic-2 | 5 | spdx | spdx license identifier artistic 2 0
artistic-1 | 4 | artistic | artistic licen[cs]e (?:version |v ?)?1(?: 0)?
artistic-1 | 5 | spdx | spdx license identifier artistic 1 0
artistic | 3 | artistic | (?:the )?artistic licen[cs]e
perl | 3 | perl | same terms as perl(?: itself)?
psf-2 | 4 | python | python software foundation licen[cs]e (?:version |v ?)?2(?: 0)?
psf-2 | 3 | psf | psf licen[cs]e(?: agreement)?
psf-2 | 5 | spdx | spdx license identifier (?:psf 2 0|python 2 0)
python | 3 | python | python (?:software foundation )?licen[cs]e
php-3.01 | 4 | php | php licen[cs]e (?:version |v ?)?3 01
php-3.01 | 5 | spdx | spdx license identifier php 3 01
php | 3 | php | (?:the )?php licen[cs]e
ruby | 3 | ruby | (?:the )?ruby licen[cs]e
ruby | 5 | spdx | spdx license identifier ruby
zlib | 3 | zlib | (?:the )?zlib(?: libpng)? licen[cs]e
zlib | 5 | spdx | spdx license identifier zlib
zlib | 4 | misrepresented | the origin of this software must not be misrepresented
libpng | 3 | libpng | (?:the )?libpng licen[cs]e
boost-1 | 4 | boost | boost software licen[cs]e(?: version)? 1 0
boost-1 | 3 | boost | boost (?:software )?licen[cs]e
boost-1 | 5 | spdx | spdx license identifier bsl 1 0
boost-1 | 2 | boost | boost org license 1 0 txt
unlicense | 3 | unlicense | (?:the )?unlicense
unlicense | 2 | unlicense | unlicense org
unlicense | 4 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 5 | spdx | spdx license identifier unlicense
wtfpl | 3 | wtfpl | wtfpl
wtfpl | 5 | spdx | spdx license identifier wtfpl
cc0-1 | 4 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1 | 4 | creative | creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?
cc0-1 | 5 | spdx | spdx license identifier cc0 1 0
cc0-1 | 2 | creativecommons | creativecommons org publicdomain zero 1 0
public-domain | 3 | domain | (?:dedicated to|released (?:in)?to|placed in(?:to)?|is in) the public domain
public-domain | 1 | domain | public domain
public-domain | 2 | creativecommons | creativecommons org publicdomain mark 1 0
cc-by | 4 | cc | cc by(?: [1234] [05])?
cc-by | 4 | attribution | creative commons attribution(?: [1234] [05])?(?: international| unported)?(?: (?:public )?licen[cs]e)?
cc-by | 2 | creativecommons | creativecommons org licenses by(?: [1234] [05])?
cc-by | 5 | spdx | spdx license identifier cc by [1234] [05]
cc-by-sa | 4 | cc | cc by sa(?: [1234] [05])?
cc-by-sa | 4 | sharealike | creative commons attribution sharealike(?: [1234] [05])?(?: international| unported)?(?: (?:public )?licen[cs]e)?
cc-by-sa | 4 | alike | creative commons attribution share alike(?: [1234] [05])?(?: international| unported)?(?: (?:public )?licen[cs]e)?
cc-by-sa | 2 | creativecommons | creativecommons org licenses by sa(?: [1234] [05])?
cc-by-sa | 5 | spdx | spdx license identifier cc by sa [1234] [05]
cc-by-nc | 4 | cc | cc by nc
cc-by-nc | 4 | cc | cc by nc [1234] [05]
cc-by-nc | 4 | noncommercial | creative commons attribution noncommercial(?: [1234] [05])?(?: international| unported)?(?: (?:public )?licen[cs]e)?
cc-by-nc | 4 | commercial | creative commons attribution non commercial(?: [1234] [05])?(?: international| unported)?(?: (?:public )?licen[cs]e)?
cc-by-nc | 2 | creativecommons | creativecommons org licenses by nc(?: [1234] [05])?
cc-by-nc | 5 | spdx | spdx license identifier cc by nc [1234] [05]
cc-by-nd | 4 | cc | cc by nd(?: [1234] [05])?
cc-by-nd | 4 | noderivatives | creative commons attribution noderivatives(?: [1234] [05])?(?: international| unported)?
cc-by-nd | 4 | derivatives | creative commons attribution no derivatives(?: [1234] [05])?
cc-by-nd | 2 | creativecommons | creativecommons org licenses by nd(?: [1234] [05])?
cc-by-nd | 5 | spdx | spdx license identifier cc by nd [1234] [05]
cc-by-nc-sa | 4 | cc | cc by nc sa(?: [1234] [05])?
cc-by-nc-sa | 4 | noncommercial | creative commons attribution noncommercial share ?alike(?: [1234] [05])?(?: international| unported)?
cc-by-nc-sa | 2 | creativecommons | creativecommons org licenses by nc sa(?: [1234] [05])?
cc-by-nc-sa | 5 | spdx | spdx license identifier cc by nc sa [1234] [05]
cc-by-nc-nd | 4 | cc | cc by nc nd(?: [1234] [05])?
cc-by-nc-nd | 4 | noncommercial | creative commons attribution noncommercial no ?derivatives(?: [1234] [05])?(?: international| unported)?
cc-by-nc-nd | 2 | creativecommons | creativecommons org licenses by nc nd(?: [1234] [05])?
cc-by-nc-nd | 5 | spdx | spdx license identifier cc by nc nd [1234] [05]
cc | 3 | creative | creative commons(?: licen[cs]e)?
cc | 2 | creativecommons | creativecommons org
odbl-1 | 3 | database | open (?:data commons open )?database licen[cs]e(?: (?:v ?)?1(?: 0)?)?
odbl-1 | 3 | odbl | odbl(?: 1 0)?
odbl-1 | 5 | spdx | spdx license identifier odbl 1 0
odc-by-1 | 3 | commons | open data commons attribution licen[cs]e(?: (?:v ?)?1(?: 0)?)?
odc-by-1 | 5 | spdx | spdx license identifier odc by 1 0
pddl-1 | 3 | commons | open data commons public domain dedication(?: and)? licen[cs]e
pddl-1 | 5 | spdx | spdx license identifier pddl 1 0
ogl-uk-3 | 4 | government | open government licen[cs]e (?:version |v ?)3(?: 0)?
ogl-uk | 3 | government | open government licen[cs]e
etalab-2 | 3 | etalab | (?:etalab|licence ouverte)(?: open licen[cs]e)?(?: (?:version )?2(?: 0)?)?
cecill-2.1 | 4 | cecill | cecill(?: free software licen[cs]e)?(?: agreement)? (?:version |v ?)?2 1
cecill-b | 4 | cecill | cecill b
cecill-c | 4 | cecill | cecill c
cecill | 3 | cecill | cecill
eupl-1.2 | 4 | union | european union public licen[cs]e (?:version |v ?)?1 2
eupl-1.1 | 4 | union | european union public licen[cs]e (?:version |v ?)?1 1
eupl | 3 | union | european union public licen[cs]e
eupl | 5 | spdx | spdx license identifier eupl 1 [012]
ms-pl | 3 | microsoft | microsoft public licen[cs]e
ms-pl | 5 | spdx | spdx license identifier ms pl
ms-rl | 3 | microsoft | microsoft reciprocal licen[cs]e
ms-rl | 5 | spdx | spdx license identifier ms rl
osl-3 | 4 | open | open software licen[cs]e (?:version |v ?)?3(?: 0)?
osl-3 | 5 | spdx | spdx license identifier osl 3 0
osl | 3 | open | open software licen[cs]e
afl-3 | 4 | academic | academic free licen[cs]e (?:version |v ?)?3(?: 0)?
afl-3 | 5 | spdx | spdx license identifier afl 3 0
afl | 3 | academic | academic free licen[cs]e
ecl-2 | 3 | educational | educational community licen[cs]e(?: (?:version |v ?)?2(?: 0)?)?
ecl-2 | 5 | spdx | spdx license identifier ecl 2 0
qpl-1 | 3 | q | q public licen[cs]e(?: (?:version )?1(?: 0)?)?
ncsa | 3 | ncsa | (?:university of illinois )?ncsa open source licen[cs]e
ncsa | 5 | spdx | spdx license identifier ncsa
ofl-1.1 | 4 | sil | sil open font licen[cs]e (?:version |v ?)?1 1
ofl-1.1 | 5 | spdx | spdx license identifier ofl 1 1
ofl | 3 | font | (?:sil )?open font licen[cs]e
upl-1 | 3 | universal | universal permissive licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?
upl-1 | 5 | spdx | spdx license identifier upl 1 0
postgresql | 3 | postgresql | postgresql licen[cs]e
openssl | 3 | openssl | openssl licen[cs]e
w3c | 3 | w3c | w3c software (?:notice and )?licen[cs]e
x11 | 3 | x11 | x11 licen[cs]e
curl | 3 | curl | curl licen[cs]e
json | 4 | evil | shall be used for good not evil
vim | 3 | vim | vim licen[cs]e
latex-1.3c | 3 | latex | latex project public licen[cs]e(?: (?:version |v ?)?1 3c?)?
latex-1.3c | 5 | spdx | spdx license identifier lppl 1 3c
sspl-1 | 3 | server | server side public licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?
sspl-1 | 5 | spdx | spdx license identifier sspl 1 0
busl-1.1 | 3 | business | business source licen[cs]e(?: (?:version |v ?)?1 1)?
busl-1.1 | 5 | spdx | spdx license identifier busl 1 1
elastic-2 | 3 | elastic | elastic licen[cs]e(?: (?:version |v ?)?2(?: 0)?)?
elastic-2 | 5 | spdx | spdx license identifier elastic 2 0
commons-clause | 3 | clause | commons clause(?: licen[cs]e)?
polyform-nc-1 | 3 | polyform | polyform noncommercial licen[cs]e(?: 1 0 0)?
polyform-sb-1 | 3 | polyform | polyform small business licen[cs]e(?: 1 0 0)?
openrail-m | 3 | openrail | (?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[cs]e)?
proprietary | 3 | proprietary | proprietary (?:and confidential|licen[cs]e|software)
proprietary | 3 | reserved | all rights reserved
proprietary | 4 | unauthorized | unauthorized (?:copying|reproduction|distribution) .{0,60}?(?:strictly )?prohibited
unknown-license | 1 | license | (?:see|read) (?:the )?(?:file )?(?:license|copying)(?: txt| md)? for (?:details|more information)
unknown-license | 1 | terms | subject to the following (?:terms|conditions)
"""

RULES = [
    Rule(label, int(priority), keyword, pattern)
    for label, priority, keyword, pattern in (
        [x.strip() for x in line.split("|", 3)] for line in _TABLE.strip().splitlines()
    )
]

#: The base labels and their phrases: fixed values.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
