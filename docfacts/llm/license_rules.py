"""Signature rules of licences and notices, written by hand, in order of priority.

A line holds label, confidence and the words of running text, lower-case and without
punctuation ("a|b": either; "x?": may be left out; digits as they stand). The words in
square brackets are the rule's keyword: a text without them is not matched against it.
Of equal intervals the first rule stands; an interval inside another is suppressed."""

from __future__ import annotations

SIGNATURES = r"""
apache-1.0 0.95 the [apache] software? license version? 1 0
apache-1.0 0.9 [apache software license] 1 0
apache-1.1 0.95 the [apache] software? license version? 1 1
apache-1.1 0.9 [apache software license] 1 1
apache-1.1 0.85 this product includes software developed by the [apache] software foundation
apache-2.0 1.0 spdx license identifier [apache] 2 0
apache-2.0 0.98 licensed under the? terms? of? the? [apache] software? license version? v2|2 0?
apache-2.0 0.97 released|distributed|available under the? terms? of? the? [apache] software? license version? v2|2 0?
apache-2.0 0.95 [apache license] version january 2004
apache-2.0 0.9 [apache] software? license version? v2|2 0?
apache-2.0 0.95 [apache org licenses] license 2 0 txt|html?
apache-2.0 0.95 opensource org licenses [apache] 2 0
apache-2.0 0.8 [apache] 2 0 license|licensed|licence
apache-2.0 0.8 you may not use this file except [in compliance with] the license
apache-2.0 0.8 you may obtain a copy of the license at http|https? www? [apache] org
apache-2.0 0.9 perpetual worldwide non exclusive no charge [royalty free irrevocable] copyright license to reproduce
apache-2.0 0.9 perpetual worldwide non exclusive no charge [royalty free irrevocable] except as stated in this section patent license
apache-2.0 0.75 see the license for the specific language governing [permissions and limitations] under the license
apache-2.0 0.75 distributed on an as is basis without [warranties or conditions] of any kind either express or implied
apache 0.85 licensed under the? terms? of? the? [apache] software? license
apache 0.7 [apache] software? license
mit-0 1.0 [spdx license] identifier mit 0
mit-0 0.95 mit [no attribution] license?
mit-0 0.9 opensource [org licenses] mit 0
mit-0 0.95 permission is [hereby granted] free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
mit 1.0 [spdx license] identifier mit
mit 0.98 [licensed under] the? terms? of? the? mit x11? open? source? license?
mit 0.98 [released under] the? terms? of? the? mit open? source? license?
mit 0.97 [distributed under] the? terms? of? the? mit open? source? license?
mit 0.95 available|provided|published under the? terms? of? the? mit open? source? [license]
mit 0.9 subject to the? terms? of? the? [mit license]
mit 0.9 [under the terms of] the? mit license?
mit 0.9 governed by the? [mit license]
mit 0.9 [dual licensed] under the? mit
mit 0.9 opensource [org licenses] mit license? php|html?
mit 0.9 [mit license] http|https
mit 0.85 the? [mit license] mit
mit 0.75 [mit licen]se|licence|licensed
mit 0.9 expat [license]
mit 0.9 licensed under the? terms? of? the? [expat]
mit 0.9 permission is [hereby granted] free of charge to any person obtaining a copy of this software and associated documentation files
mit 0.9 the above copyright notice and this permission notice shall be included in all copies or [substantial portions] of the software
mit 0.6 the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of [merchantability] fitness for a particular purpose and noninfringement
mit 0.7 in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise [arising from] out of or in connection with the software
0bsd 1.0 spdx license identifier [0bsd]
0bsd 0.95 bsd [zero clause] license
0bsd 0.9 licensed under the? terms? of? the? [0bsd]
0bsd 0.95 permission to use copy modify and or? distribute this software for any purpose with or without fee is [hereby granted] the software is provided
isc 1.0 spdx license identifier [isc]
isc 0.98 licensed|released|distributed|available under the? terms? of? the? [isc] license?
isc 0.75 [isc] license|licence
isc 0.9 opensource org licenses [isc] license? txt?
isc 0.95 permission to use copy modify and or? distribute this software for any purpose with or without fee is [hereby granted] provided that the above copyright notice
isc 0.7 the author disclaims all warranties [with regard to] this software including all implied warranties
bsd-2-clause 1.0 spdx license identifier [bsd] 2 clause
bsd-2-clause 0.95 licensed under the? terms? of? the? [bsd] 2 clause
bsd-2-clause 0.85 2|two clause [bsd] license?
bsd-2-clause 0.85 [bsd] 2|two clause license?
bsd-2-clause 0.85 [simplified bsd] license?
bsd-2-clause 0.85 [freebsd] license
bsd-2-clause 0.9 opensource org licenses [bsd] 2 clause
bsd-3-clause 1.0 spdx license identifier [bsd] 3 clause
bsd-3-clause 0.95 licensed under the? terms? of? the? [bsd] 3 clause
bsd-3-clause 0.95 use of this source code is governed by a [bsd] style license
bsd-3-clause 0.85 3|three clause [bsd] license?
bsd-3-clause 0.85 [bsd] 3|three clause license?
bsd-3-clause 0.85 new|modified|revised [bsd] license
bsd-3-clause 0.9 opensource org licenses [bsd] 3 clause
bsd-3-clause 0.9 contributors may be used to [endorse or promote] products derived from this software
bsd-3-clause-clear 0.95 no express or implied licenses to any partys? patent rights are granted by [this license]
bsd-4-clause 1.0 spdx license identifier [bsd] 4 clause
bsd-4-clause 0.85 4|four clause [bsd] license?
bsd-4-clause 0.85 original [bsd] license
bsd-4-clause 0.95 all [advertising materials] mentioning features or use of this software must display the following acknowledgement|acknowledgment
bsd 0.95 licensed|released|distributed|available under the? terms? of? the? a? [bsd] style? license?
bsd 0.75 [bsd] style? license|licence
bsd 0.9 redistribution and use in [source and binary] forms with or without modification are permitted
bsd 0.7 redistributions of source code [must retain] the above copyright notice
bsd 0.7 redistributions in binary form [must reproduce] the above copyright notice
bsd 0.7 this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of [merchantability]
agpl-3.0 1.0 spdx license identifier [agpl] 3 0 only|or? or? later?
agpl-3.0 0.95 [gnu affero general public license] as published by the free software foundation either version 3 of the license
agpl-3.0 0.95 licensed|released|distributed|available under the? terms? of? the? gnu? [agpl] version|v? v3|3 0?
agpl-3.0 0.9 gnu? [affero general public license] version|v? v3|3 0?
agpl-3.0 0.9 gnu? [agpl] version|v? v3|3 0?
agpl-3.0 0.9 gnu org licenses [agpl] 3 0
agpl-1.0 0.9 [affero general public license] version|v? 1
agpl 0.8 gnu? [affero general public license]
agpl 0.75 gnu [agpl]
lgpl-2.0 1.0 spdx license identifier [lgpl] 2 0
lgpl-2.0 0.9 gnu? [library general public license] version|v? v2|2 0?
lgpl-2.0 0.95 [library general public license] as published by the free software foundation either version 2 of the license
lgpl-2.1 1.0 spdx license identifier [lgpl] 2 1
lgpl-2.1 0.95 gnu [lesser general public license] as published by the free software foundation either version 2 1 of the license
lgpl-2.1 0.9 gnu? [lesser general public license] version|v? v2|2 1
lgpl-2.1 0.9 gnu? [lgpl] version|v? v2|2 1
lgpl-2.1 0.9 gnu org licenses [lgpl] 2 1
lgpl-3.0 1.0 spdx license identifier [lgpl] 3 0
lgpl-3.0 0.95 gnu [lesser general public license] as published by the free software foundation either version 3 of the license
lgpl-3.0 0.9 gnu? [lesser general public license] version|v? v3|3 0?
lgpl-3.0 0.9 gnu? [lgpl] version|v? v3|3 0?
lgpl-3.0 0.9 gnu org licenses [lgpl] 3 0
lgpl 0.8 gnu? [lesser general public license]
lgpl 0.8 gnu? [library general public license]
lgpl 0.75 gnu [lgpl]
lgpl 0.9 licensed|released|distributed|available under the? terms? of? the? gnu? [lgpl]
gpl-1.0 1.0 spdx license identifier [gpl] 1 0
gpl-1.0 0.9 gnu? [general public license] version|v? v1|1 0?
gpl-2.0 1.0 spdx license identifier [gpl] 2 0
gpl-2.0 0.95 gnu [general public license] as published by the free software foundation either version 2 of the license
gpl-2.0 0.95 [general public license] version 2 as published by the free software foundation
gpl-2.0 0.98 licensed under the? terms? of? the? gnu? [general public license] version|v? v2|2 0?
gpl-2.0 0.9 gnu? [general public license] version|v? v2|2 0?
gpl-2.0 0.9 [general public license] gpl version|v? v2|2 0?
gpl-2.0 0.9 licensed|released|distributed|available under the? terms? of? the? gnu? [gpl] version|v? v2|2 0?
gpl-2.0 0.85 gnu? [gpl] version|v v2|2 0?
gpl-2.0 0.85 [gplv2]
gpl-2.0 0.9 gnu org licenses old licenses [gpl] 2 0
gpl-3.0 1.0 spdx license identifier [gpl] 3 0
gpl-3.0 0.95 gnu [general public license] as published by the free software foundation either version 3 of the license
gpl-3.0 0.95 [general public license] version 3 as published by the free software foundation
gpl-3.0 0.98 licensed under the? terms? of? the? gnu? [general public license] version|v? v3|3 0?
gpl-3.0 0.9 gnu? [general public license] version|v? v3|3 0?
gpl-3.0 0.9 [general public license] gpl version|v? v3|3 0?
gpl-3.0 0.9 licensed|released|distributed|available under the? terms? of? the? gnu? [gpl] version|v? v3|3 0?
gpl-3.0 0.85 gnu? [gpl] version|v v3|3 0?
gpl-3.0 0.85 [gplv3]
gpl-3.0 0.9 gnu org licenses [gpl] 3 0
gpl 0.95 licensed|released|distributed|available under the? terms? of? the? gnu? [general public license]
gpl 0.85 gnu [general public license]
gpl 0.8 gnu [gpl]
gpl 0.9 licensed|released|distributed|available under the? terms? of? the? [gpl]
gpl 0.7 you should have received a copy of the gnu [general public license] along with this program
gpl 0.7 without even the implied warranty of [merchantability] or fitness for a particular purpose see the gnu
gpl 0.6 this program is distributed in the hope that [it will be useful]
gpl-classpath 0.95 linking this library statically or dynamically with other modules is making a [combined work] based on this library
gfdl-1.3 1.0 spdx license identifier [gfdl] 1 3
gfdl-1.3 0.9 gnu? [free documentation license] version 1 3
gfdl-1.2 0.9 gnu? [free documentation license] version 1 2
gfdl 0.85 gnu? [free documentation license]
gfdl 0.8 with no [invariant sections] no front cover texts and no back cover texts
mpl-1.0 0.9 [mozilla public license] version? 1 0
mpl-1.1 0.9 [mozilla public license] version? 1 1
mpl-1.1 0.9 the contents of this file are subject to the [mozilla public license] version 1 1
mpl-2.0 1.0 spdx license identifier [mpl] 2 0
mpl-2.0 0.95 this [source code form] is subject to the terms of the mozilla public license v 2 0
mpl-2.0 0.9 [mozilla public license] version|v? v2|2 0?
mpl-2.0 0.9 [mozilla org mpl] 2 0
mpl-2.0 0.9 licensed under the? terms? of? the? [mpl] 2 0
mpl-2.0 0.8 if a copy of the mpl was not [distributed with this file]
mpl 0.8 [mozilla public license]
epl-1.0 1.0 spdx license identifier [epl] 1 0
epl-1.0 0.9 [eclipse public license] version|v? v1|1 0?
epl-1.0 0.9 eclipse org [legal epl] v10
epl-2.0 1.0 spdx license identifier [epl] 2 0
epl-2.0 0.9 [eclipse public license] version|v? v2|2 0?
epl-2.0 0.9 eclipse org [legal epl] 2 0
epl 0.8 [eclipse public license]
cpl-1.0 0.9 [common public license] version|v? 1 0
cpl 0.8 [common public license]
eupl-1.1 0.9 [european union public] licence|license v|version? 1 1
eupl-1.2 1.0 spdx license identifier [eupl] 1 2
eupl-1.2 0.9 [european union public] licence|license v|version? 1 2
eupl 0.8 [european union public] licence|license
cddl-1.0 1.0 spdx license identifier [cddl] 1 0
cddl-1.0 0.9 common development and [distribution license] version? 1 0
cddl-1.1 0.9 common development and [distribution license] version? 1 1
cddl 0.8 common development and [distribution license]
cecill-2.1 0.9 [cecill] license? version|v? 2 1
cecill 0.8 [cecill] license|licence
osl-3.0 0.9 [open software license] version|v? 3 0
afl-3.0 0.9 [academic free license] version|v? 3 0
ms-pl 1.0 spdx license identifier [ms pl]
ms-pl 0.9 [microsoft public license]
ms-rl 0.9 [microsoft reciprocal license]
artistic-1.0 0.9 [artistic license] version? 1 0
artistic-2.0 1.0 spdx license identifier [artistic] 2 0
artistic-2.0 0.9 [artistic license] version? 2 0?
artistic 0.7 under the terms of the [artistic license]
perl 0.9 under the [same terms as perl] itself
python-2.0 1.0 spdx license identifier [python] 2 0
python-2.0 0.9 [python software foundation] license version|v? 2?
ruby 0.85 under the terms of the [ruby] license
php-3.01 0.9 this source file is subject to version 3 01 of the [php license]
php 0.8 [php license] version? 3 0?
zpl-2.1 0.9 [zope public license] version? 2 1
tcl 0.85 [tcl] tk license
curl 0.9 spdx license identifier [curl]
openssl 0.9 this product includes software developed by the [openssl] project
openssl 0.8 [openssl] license
sleepycat 0.85 [sleepycat] license
ntp 0.85 permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is [hereby granted] provided that the above copyright notice appears in all copies
hpnd 0.8 [historical permission notice] and disclaimer
x11 0.85 [x11 license]
ncsa 0.9 university of illinois [ncsa] open source license
w3c 0.9 [w3c] software notice and license
unicode 0.9 [unicode] inc? license agreement data files and software
ijg 0.85 based in part on the work of the [independent jpeg group]
libpng 0.85 [libpng] license
libtiff 0.85 permission to use copy modify distribute and sell this software and its documentation for any purpose is [hereby granted] without fee
bsl-1.0 1.0 spdx license identifier [bsl] 1 0
bsl-1.0 0.9 [boost software license] version? 1 0
bsl-1.0 0.9 boost org [license 1 0] txt?
bsl-1.0 0.95 permission is [hereby granted] free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
busl-1.1 0.9 [business source license] 1 1
sspl-1.0 0.9 [server side public license] version|v? 1?
elastic-2.0 0.9 [elastic license] version|v? 2 0
zlib 1.0 spdx license identifier [zlib]
zlib 0.95 licensed|released|distributed|available under the? terms? of? the? [zlib] libpng? license?
zlib 0.75 [zlib] libpng? license
zlib 0.9 in no event will the authors be [held liable] for any damages arising from the use of this software
zlib 0.85 this notice may not be removed or altered from any [source distribution]
unlicense 1.0 spdx license identifier [unlicense]
unlicense 0.9 licensed|released under the? terms? of? the? [unlicense]
unlicense 0.95 this is free and [unencumbered] software released into the public domain
unlicense 0.9 refer to http|https? [unlicense org]
wtfpl 1.0 spdx license identifier [wtfpl]
wtfpl 0.95 do what the fuck you want to [public license]
wtfpl 0.85 licensed|released under the? terms? of? the? [wtfpl]
beerware 0.9 the [beer ware] license
json 0.9 the software shall be used for [good not evil]
postgresql 0.9 spdx license identifier [postgresql]
postgresql 0.85 [postgresql] license|licence
vim 0.85 [vim license]
latex-1.3c 0.9 [latex project public license] version? 1 3c?
latex 0.8 [latex project public license]
ofl-1.1 1.0 spdx license identifier [ofl] 1 1
ofl-1.1 0.9 sil? [open font license] version? 1 1
ofl-1.1 0.95 permission is [hereby granted] free of charge to any person obtaining a copy of the font software
ofl 0.8 sil [open font license]
odbl-1.0 0.9 [open database license] version|v? 1 0?
odbl 0.8 [open database license]
odc-by-1.0 0.9 open data commons [attribution license] version|v? 1? 0?
pddl-1.0 0.9 [public domain dedication] and license version|v? 1? 0?
cdla-permissive-2.0 0.9 community data license agreement [permissive] version? 2 0
cdla-sharing-1.0 0.9 community data license agreement [sharing] version? 1 0
ogl-uk-3.0 0.9 [open government licence] version|v? v3|3 0
ogl 0.8 [open government licence]
etalab-2.0 0.9 [licence ouverte] version? 2 0
cc0-1.0 1.0 spdx license identifier [cc0] 1 0
cc0-1.0 0.9 [cc0] 1 0 universal?
cc0-1.0 0.9 [creativecommons org] publicdomain zero 1 0
cc0-1.0 0.9 dedicated to the public domain under the? [cc0]
cc-pdm-1.0 0.9 [public domain mark] 1 0
cc-by-nc-nd-4.0 0.95 [cc by] nc nd 4 0 international?
cc-by-nc-nd-3.0 0.95 [cc by] nc nd 3 0 unported?
cc-by-nc-nd-4.0 0.95 [creativecommons org] licenses by nc nd 4 0
cc-by-nc-nd-4.0 0.95 [creative commons] attribution noncommercial|non commercial? no derivatives|noderivatives|noderivs derivs? 4 0 international? license?
cc-by-nc-sa-4.0 0.95 [cc by] nc sa 4 0 international?
cc-by-nc-sa-3.0 0.95 [cc by] nc sa 3 0 unported?
cc-by-nc-sa-4.0 0.95 [creativecommons org] licenses by nc sa 4 0
cc-by-nc-sa-4.0 0.95 [creative commons] attribution noncommercial|non commercial? share|sharealike alike? 4 0 international? license?
cc-by-nc-4.0 0.95 [cc by] nc 4 0 international?
cc-by-nc-3.0 0.95 [cc by] nc 3 0 unported?
cc-by-nc-2.5 0.95 [cc by] nc 2 5
cc-by-nc-2.0 0.95 [cc by] nc 2 0
cc-by-nc-4.0 0.95 [creativecommons org] licenses by nc 4 0
cc-by-nc-4.0 0.95 [creative commons] attribution noncommercial|non commercial? 4 0 international? license?
cc-by-nd-4.0 0.95 [cc by] nd 4 0 international?
cc-by-nd-3.0 0.95 [cc by] nd 3 0 unported?
cc-by-nd-4.0 0.95 [creativecommons org] licenses by nd 4 0
cc-by-nd-4.0 0.95 [creative commons] attribution noderivatives|noderivs 4 0 international? license?
cc-by-sa-4.0 0.95 [cc by] sa 4 0 international?
cc-by-sa-3.0 0.95 [cc by] sa 3 0 unported?
cc-by-sa-2.5 0.95 [cc by] sa 2 5
cc-by-sa-2.0 0.95 [cc by] sa 2 0
cc-by-sa-4.0 0.95 [creativecommons org] licenses by sa 4 0
cc-by-sa-3.0 0.95 [creativecommons org] licenses by sa 3 0
cc-by-sa-4.0 0.95 [creative commons] attribution share|sharealike alike? 4 0 international? license?
cc-by-sa-3.0 0.95 [creative commons] attribution share|sharealike alike? 3 0 unported? license?
cc-by-4.0 0.95 [cc by] 4 0 international?
cc-by-3.0 0.95 [cc by] 3 0 unported?
cc-by-2.5 0.95 [cc by] 2 5
cc-by-2.0 0.95 [cc by] 2 0
cc-by-4.0 0.95 [creativecommons org] licenses by 4 0
cc-by-3.0 0.95 [creativecommons org] licenses by 3 0
cc-by-4.0 0.95 [creative commons] attribution 4 0 international? license?
cc-by-3.0 0.95 [creative commons] attribution 3 0 unported? license?
cc-by-nc-nd 0.85 [cc by] nc nd
cc-by-nc-sa 0.85 [cc by] nc sa
cc-by-nc 0.85 [cc by] nc
cc-by-nd 0.85 [cc by] nd
cc-by-sa 0.85 [cc by] sa
cc-by-nc 0.85 [creative commons] attribution noncommercial|non commercial?
cc-by-sa 0.85 [creative commons] attribution share|sharealike alike?
cc-by 0.8 [creative commons] attribution license|licence
cc 0.7 [creative commons] license|licence
reserved 0.9 all [rights reserved]
reserved 0.8 some [rights reserved]
reserved 0.85 alle [rechte vorbehalten]
reserved 0.85 tous [droits réservés]
reserved 0.85 todos los [derechos reservados]
copyright 0.85 [copyright] c? 19\d\d|20\d\d
copyright 0.8 [copyright] c? by
public-domain 0.95 released|dedicated|placed to|into|in the [public domain]
public-domain 0.8 in the [public domain]
public-domain 0.8 is a work of the [united states government]
proprietary 0.9 [proprietary] and confidential
proprietary 0.9 confidential and [proprietary]
proprietary 0.9 [redistribution] is? prohibited|forbidden
proprietary 0.9 unauthorized copying of this file via any medium is [strictly prohibited]
proprietary 0.85 may not be copied reproduced|distributed or? distributed? without? the? prior? [written permission]
proprietary 0.8 licensed not sold under this [end user license agreement]
commercial 0.8 a [commercial license] is required|available
evaluation 0.8 for [evaluation purposes] only
"""
