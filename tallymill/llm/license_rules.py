"""Licence signatures: hand-written rules over normalized words (lower case, single spaces, no punctuation).

A line is: label, priority (1 strongest), keyword, pattern. A rule runs only
where its keyword stands; patterns match whole words.
"""

from __future__ import annotations

import re
from typing import NamedTuple

RULES_TEXT = r"""
apache-2.0 1 spdx spdx license identifier apache 2 0
apache-2.0 2 apache apache license version 2 0(?: january 2004)?
apache-2.0 2 apache apache license 2 0
apache-2.0 2 apache apache 2 0 licen[sc]ed?
apache-2.0 2 apache licen[sc]ed under (?:the )?apache (?:license )?(?:version |v ?)?2(?: 0)?
apache-2.0 2 apache apache software license version 2 0
apache-2.0 3 www (?:http|https) www apache org licenses license 2 0
apache-2.0 4 asl asl 2 0
apache-1.1 1 spdx spdx license identifier apache 1 1
apache-1.1 2 apache apache (?:software )?license version 1 1
apache-1.0 1 spdx spdx license identifier apache 1 0
apache-1.0 2 apache apache (?:software )?license version 1 0
apache 4 apache apache (?:software )?licen[sc]e
mit 1 spdx spdx license identifier mit
mit 2 mit (?:the )?mit licen[sc]e
mit 2 mit licen[sc]ed under (?:the )?(?:terms of the )?mit(?: licen[sc]e)?
mit 2 mit released under (?:the )?mit licen[sc]e
mit 2 permission permission is hereby granted free of charge to any person obtaining a copy of this software
mit 3 permission the above copyright notice and this permission notice shall be included in all copies
mit 3 mit (?:http|https) opensource org licenses mit
mit 3 expat expat licen[sc]e
mit-0 1 spdx spdx license identifier mit 0
mit-0 2 mit mit no attribution
x11 1 spdx spdx license identifier x11
x11 2 x11 x11 licen[sc]e
bsd-3-clause 1 spdx spdx license identifier bsd 3 clause
bsd-3-clause 2 bsd bsd 3 clause(?: licen[sc]e)?
bsd-3-clause 2 bsd (?:3|three) clause bsd(?: licen[sc]e)?
bsd-3-clause 2 bsd (?:new|modified|revised) bsd licen[sc]e
bsd-3-clause 3 endorse may be used to endorse or promote products derived from this software without specific prior written permission
bsd-2-clause 1 spdx spdx license identifier bsd 2 clause
bsd-2-clause 2 bsd bsd 2 clause(?: licen[sc]e)?
bsd-2-clause 2 bsd (?:2|two) clause bsd(?: licen[sc]e)?
bsd-2-clause 2 bsd (?:simplified|freebsd) bsd licen[sc]e
bsd-2-clause 2 freebsd freebsd licen[sc]e
bsd-4-clause 1 spdx spdx license identifier bsd 4 clause
bsd-4-clause 2 bsd (?:4|four) clause bsd(?: licen[sc]e)?
bsd-4-clause 2 bsd (?:original|old) bsd licen[sc]e
bsd-4-clause 3 advertising all advertising materials mentioning features or use of this software
bsd-0-clause 1 spdx spdx license identifier 0bsd
bsd-0-clause 2 0bsd 0bsd licen[sc]e
bsd-0-clause 2 bsd (?:zero|0) clause bsd
bsd 3 redistribution redistribution and use in source and binary forms with or without modification are permitted
bsd 4 bsd bsd (?:style )?licen[sc]e
isc 1 spdx spdx license identifier isc
isc 2 isc (?:the )?isc licen[sc]e
isc 3 permission permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
zlib 1 spdx spdx license identifier zlib
zlib 2 zlib (?:zlib|zlib libpng) licen[sc]e
zlib 3 origin the origin of this software must not be misrepresented
libpng 1 spdx spdx license identifier libpng(?: 2 0)?
libpng 2 libpng libpng licen[sc]e
gpl-3.0-or-later 1 spdx spdx license identifier gpl 3 0 or later
gpl-3.0-or-later 2 gpl gpl v?3(?: 0)? or later
gpl-3.0-or-later 2 gplv3 gplv3(?: 0)? or later
gpl-3.0-or-later 2 gpl3 gpl3(?: 0)? or later
gpl-3.0-or-later 2 gnu gnu general public license (?:as published by the free software foundation )?(?:either )?version 3 (?:of the license )?or (?:at your option )?any later version
gpl-3.0 1 spdx spdx license identifier gpl 3 0(?: only)?
gpl-3.0 2 gnu gnu general public license (?:version |v ?)?3(?: 0)?
gpl-3.0 2 gnu gnu gpl (?:version |v ?)?3(?: 0)?
gpl-3.0 2 gplv3 gplv3
gpl-3.0 3 gpl gpl (?:version |v ?)?3(?: 0)?
gpl-2.0-or-later 1 spdx spdx license identifier gpl 2 0 or later
gpl-2.0-or-later 2 gpl gpl v?2(?: 0)? or later
gpl-2.0-or-later 2 gplv2 gplv2(?: 0)? or later
gpl-2.0-or-later 2 gpl2 gpl2(?: 0)? or later
gpl-2.0-or-later 2 gnu gnu general public license (?:as published by the free software foundation )?(?:either )?version 2 (?:of the license )?or (?:at your option )?any later version
gpl-2.0 1 spdx spdx license identifier gpl 2 0(?: only)?
gpl-2.0 2 gnu gnu general public license (?:version |v ?)?2(?: 0)?
gpl-2.0 2 gnu gnu gpl (?:version |v ?)?2(?: 0)?
gpl-2.0 2 gplv2 gplv2
gpl-2.0 3 gpl gpl (?:version |v ?)?2(?: 0)?
gpl-1.0 1 spdx spdx license identifier gpl 1 0(?: only)?
gpl-1.0 2 gnu gnu general public license (?:version |v ?)?1(?: 0)?
gpl 3 gnu gnu general public licen[sc]e
gpl 3 gnu you can redistribute it and or modify it under the terms of the gnu general public license
gpl 4 gnu gnu gpl
gpl 4 gpl (?:under|the) gpl(?: licen[sc]e)?
lgpl-3.0 1 spdx spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3.0 2 lesser gnu lesser general public license (?:version |v ?)?3(?: 0)?
lgpl-3.0 2 lgplv3 lgplv3
lgpl-3.0 3 lgpl lgpl (?:version |v ?)?3(?: 0)?
lgpl-2.1 1 spdx spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.1 2 lesser gnu lesser general public license (?:version |v ?)?2 1
lgpl-2.1 3 lgpl lgpl (?:version |v ?)?2 1
lgpl-2.0 1 spdx spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.0 2 library gnu library general public license(?: (?:version |v ?)?2(?: 0)?)?
lgpl 3 lesser gnu lesser general public licen[sc]e
lgpl 4 lgpl lgpl
agpl-3.0 1 spdx spdx license identifier agpl 3 0(?: only| or later)?
agpl-3.0 2 affero gnu affero general public license (?:version |v ?)?3(?: 0)?
agpl-3.0 2 agplv3 agplv3
agpl-3.0 3 agpl agpl (?:version |v ?)?3(?: 0)?
agpl-1.0 1 spdx spdx license identifier agpl 1 0
agpl 3 affero (?:gnu )?affero general public licen[sc]e
agpl 4 agpl agpl
gfdl-1.3 1 spdx spdx license identifier gfdl 1 3(?: only| or later)?
gfdl-1.3 2 documentation gnu free documentation license (?:version )?1 3
gfdl-1.2 1 spdx spdx license identifier gfdl 1 2(?: only| or later)?
gfdl-1.2 2 documentation gnu free documentation license (?:version )?1 2
gfdl-1.1 2 documentation gnu free documentation license (?:version )?1 1
gfdl 3 documentation gnu free documentation licen[sc]e
gfdl 4 gfdl gfdl
mpl-2.0 1 spdx spdx license identifier mpl 2 0
mpl-2.0 2 mozilla mozilla public license (?:version |v ?)?2 0
mpl-2.0 3 mpl mpl 2 0
mpl-1.1 1 spdx spdx license identifier mpl 1 1
mpl-1.1 2 mozilla mozilla public license (?:version |v ?)?1 1
mpl-1.1 3 mpl mpl 1 1
mpl-1.0 2 mozilla mozilla public license (?:version |v ?)?1 0
mpl 3 mozilla mozilla public licen[sc]e
epl-2.0 1 spdx spdx license identifier epl 2 0
epl-2.0 2 eclipse eclipse public license (?:version |v ?)?2 0
epl-1.0 1 spdx spdx license identifier epl 1 0
epl-1.0 2 eclipse eclipse public license (?:version |v ?)?1 0
epl 3 eclipse eclipse public licen[sc]e
edl-1.0 2 eclipse eclipse distribution license (?:version |v ?)?1 0
cddl-1.0 1 spdx spdx license identifier cddl 1 0
cddl-1.0 2 development common development and distribution license (?:version )?1 0
cddl-1.1 1 spdx spdx license identifier cddl 1 1
cddl-1.1 2 development common development and distribution license (?:version )?1 1
cddl 3 development common development and distribution licen[sc]e
cpl-1.0 1 spdx spdx license identifier cpl 1 0
cpl-1.0 2 common common public license(?: version)? 1 0
ipl-1.0 2 ibm ibm public license(?: version)? 1 0
eupl-1.2 1 spdx spdx license identifier eupl 1 2
eupl-1.2 2 eupl eupl (?:version |v ?)?1 2
eupl-1.1 2 eupl eupl (?:version |v ?)?1 1
eupl 3 european european union public licen[sc]e
cecill-2.1 1 spdx spdx license identifier cecill 2 1
cecill-b 2 cecill cecill b
cecill-c 2 cecill cecill c
cecill 3 cecill cecill(?: free software)?(?: licen[sc]e(?: agreement)?)?
artistic-2.0 1 spdx spdx license identifier artistic 2 0
artistic-2.0 2 artistic artistic license (?:version )?2 0
artistic-1.0 2 artistic artistic license (?:version )?1 0
artistic 3 artistic artistic licen[sc]e
perl 3 perl under the same terms as perl(?: itself)?
psf-2.0 1 spdx spdx license identifier (?:psf|python) 2 0
psf-2.0 2 python python software foundation licen[sc]e(?: version 2)?
python 3 python python licen[sc]e(?: 2 0)?
php-3.01 1 spdx spdx license identifier php 3 01
php-3.01 2 php php licen[sc]e (?:version )?3 01
php 3 php php licen[sc]e
ruby 2 ruby ruby licen[sc]e
boost-1.0 1 spdx spdx license identifier bsl 1 0
boost-1.0 2 boost boost software license (?:version )?1 0
boost 3 boost boost (?:software )?licen[sc]e
busl-1.1 1 spdx spdx license identifier busl 1 1
busl-1.1 2 business business source license (?:version )?1 1
busl 3 business business source licen[sc]e
sspl-1.0 1 spdx spdx license identifier sspl 1 0
sspl-1.0 2 server server side public license(?: (?:version |v ?)?1)?
elastic-2.0 1 spdx spdx license identifier elastic 2 0
elastic-2.0 2 elastic elastic license (?:version )?2 0
elastic 3 elastic elastic licen[sc]e
commons-clause 2 commons commons clause(?: license)?(?: condition)?
polyform-noncommercial 2 polyform polyform noncommercial(?: licen[sc]e)?(?: 1 0 0)?
polyform-shield 2 polyform polyform shield(?: licen[sc]e)?
unlicense 1 spdx spdx license identifier unlicense
unlicense 2 unlicense (?:the )?unlicense
unlicense 2 unencumbered this is free and unencumbered software released into the public domain
wtfpl 1 spdx spdx license identifier wtfpl
wtfpl 2 wtfpl wtfpl
wtfpl 3 want do what the fuck you want to public licen[sc]e
beerware 2 beer (?:the )?beer ware licen[sc]e
ms-pl 1 spdx spdx license identifier ms pl
ms-pl 2 microsoft microsoft public licen[sc]e
ms-rl 2 microsoft microsoft reciprocal licen[sc]e
nasa-1.3 2 nasa nasa open source agreement(?: (?:version )?1 3)?
ncsa 1 spdx spdx license identifier ncsa
ncsa 2 ncsa (?:university of illinois )?ncsa open source licen[sc]e
ofl-1.1 1 spdx spdx license identifier ofl 1 1
ofl-1.1 2 sil sil open font license(?: version)? 1 1
ofl 3 font (?:sil )?open font licen[sc]e
osl-3.0 1 spdx spdx license identifier osl 3 0
osl-3.0 2 open open software license(?: (?:version |v ?)?3 0)?
afl-3.0 1 spdx spdx license identifier afl 3 0
afl-3.0 2 academic academic free license(?: (?:version |v ?)?3 0)?
odbl-1.0 1 spdx spdx license identifier odbl 1 0
odbl-1.0 2 database open database licen[sc]e(?: (?:version |v ?)?1 0)?
odc-by-1.0 1 spdx spdx license identifier odc by 1 0
odc-by-1.0 2 odc odc (?:attribution|by)(?: licen[sc]e)?
pddl-1.0 2 public public domain dedication and licen[sc]e
cc0-1.0 1 spdx spdx license identifier cc0 1 0
cc0-1.0 2 cc0 cc0(?: 1 0)?(?: universal)?
cc0-1.0 2 creative creative commons zero(?: (?:v )?1 0)?(?: universal)?
cc-by-nc-nd-4.0 1 spdx spdx license identifier cc by nc nd 4 0
cc-by-nc-nd-4.0 2 nc cc by nc nd 4 0
cc-by-nc-nd-4.0 2 noderivatives creative commons attribution noncommercial noderivatives 4 0
cc-by-nc-nd-3.0 2 nc cc by nc nd 3 0
cc-by-nc-nd 3 nc cc by nc nd
cc-by-nc-nd 3 attribution creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by-nc-sa-4.0 1 spdx spdx license identifier cc by nc sa 4 0
cc-by-nc-sa-4.0 2 nc cc by nc sa 4 0
cc-by-nc-sa-4.0 2 noncommercial creative commons attribution noncommercial sharealike 4 0
cc-by-nc-sa-3.0 2 nc cc by nc sa 3 0
cc-by-nc-sa 3 nc cc by nc sa
cc-by-nc-sa 3 attribution creative commons attribution non ?commercial share ?alike
cc-by-nc-4.0 1 spdx spdx license identifier cc by nc 4 0
cc-by-nc-4.0 2 nc cc by nc 4 0
cc-by-nc-4.0 2 noncommercial creative commons attribution noncommercial 4 0
cc-by-nc-3.0 2 nc cc by nc 3 0
cc-by-nc 3 nc cc by nc
cc-by-nc 3 attribution creative commons attribution non ?commercial
cc-by-nd-4.0 1 spdx spdx license identifier cc by nd 4 0
cc-by-nd-4.0 2 nd cc by nd 4 0
cc-by-nd 3 nd cc by nd
cc-by-nd 3 creative creative commons attribution no ?deriv(?:ative)?s
cc-by-sa-4.0 1 spdx spdx license identifier cc by sa 4 0
cc-by-sa-4.0 2 sa cc by sa 4 0
cc-by-sa-4.0 2 creative creative commons attribution share ?alike 4 0
cc-by-sa-3.0 1 spdx spdx license identifier cc by sa 3 0
cc-by-sa-3.0 2 sa cc by sa 3 0
cc-by-sa-3.0 2 creative creative commons attribution share ?alike 3 0
cc-by-sa-2.5 2 sa cc by sa 2 5
cc-by-sa 3 sa cc by sa
cc-by-sa 3 creative creative commons attribution share ?alike
cc-by-4.0 1 spdx spdx license identifier cc by 4 0
cc-by-4.0 2 cc cc by 4 0
cc-by-4.0 2 creative creative commons attribution 4 0(?: international)?
cc-by-3.0 1 spdx spdx license identifier cc by 3 0
cc-by-3.0 2 cc cc by 3 0
cc-by-3.0 2 creative creative commons attribution 3 0(?: unported)?
cc-by-2.5 2 cc cc by 2 5
cc-by-2.0 2 cc cc by 2 0
cc-by 3 cc cc by
cc-by 3 creative creative commons attribution(?: licen[sc]e)?
cc 4 creative (?:under a )?creative commons licen[sc]e
cc-url 4 creativecommons creativecommons org licenses
public-domain 2 public (?:released|dedicated|placed|is) (?:in(?:to)? |to )?the public domain
public-domain 4 public public domain
copyleft 4 copyleft copyleft
proprietary 2 proprietary proprietary and confidential
proprietary 2 proprietary proprietary licen[sc]e
proprietary 2 confidential confidential and proprietary
proprietary 3 unauthorized unauthorized (?:copying|reproduction|distribution|use)(?: of this \w+)?(?: via any medium)? is (?:strictly )?prohibited
proprietary 3 permission (?:no part of this|may not be reproduced)(?: \w+){1,12} without (?:the )?(?:prior )?(?:written )?permission
proprietary 3 eula end user licen[sc]e agreement eula
proprietary 3 eula eula
proprietary 4 user end user licen[sc]e agreement
trial 3 evaluation for evaluation purposes only
noncommercial 4 non for non commercial (?:use|purposes)(?: only)?
noncommercial 4 noncommercial for noncommercial (?:use|purposes)(?: only)?
research-only 4 research for (?:research(?: and (?:academic|research))?|academic and research) (?:use|purposes) only
research-only 4 academic for academic(?: and academic)? (?:use|purposes) only
reserved 3 rights all rights reserved
reserved 4 rights some rights reserved
copyright 4 copyright copyright (?:c |©)?(?:19|20)\d\d(?: (?:19|20)?\d\d)?
openrail 2 openrail (?:creativeml |bigscience )?openrail(?: m)?(?: licen[sc]e)?
openrail 2 openrailm (?:creativeml |bigscience )?openrailm(?: licen[sc]e)?
rail 3 responsible responsible ai licen[sc]e
community 3 community community licen[sc]e agreement
upl-1.0 1 spdx spdx license identifier upl 1 0
upl-1.0 2 universal universal permissive license(?: (?:version |v ?)?1 0)?
vim 2 vim vim licen[sc]e
w3c 2 w3c w3c software (?:notice and )?licen[sc]e
zpl-2.1 2 zope zope public license(?: (?:version )?2 1)?
curl 2 curl curl licen[sc]e
openssl 2 openssl openssl licen[sc]e
ssleay 2 ssleay original ssleay licen[sc]e
jpeg 3 jpeg independent jpeg group
blueoak-1.0 1 spdx spdx license identifier blueoak 1 0 0
blueoak-1.0 2 blue blue oak model license(?: 1 0 0)?
hippocratic 2 hippocratic hippocratic licen[sc]e
json 2 good the software shall be used for good not evil
mulan-2.0 1 spdx spdx license identifier mulanpsl 2 0
mulan-2.0 2 mulan mulan psl v2
ogl-3.0 2 government open government licen[sc]e(?: v3 0| v 3 0| version 3 0)?
"""

PRIORITY_SCORE = {1: 0.99, 2: 0.9, 3: 0.7, 4: 0.4}


class Rule(NamedTuple):
    order: int
    label: str
    priority: int
    keyword: str
    pattern: re.Pattern


def rules() -> list[Rule]:
    """All rules in the order of the text, compiled."""
    out = []
    for i, line in enumerate(x for x in RULES_TEXT.splitlines() if x):
        label, priority, keyword, pattern = line.split(" ", 3)
        out.append(Rule(i, label, int(priority), keyword, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])")))
    return out
