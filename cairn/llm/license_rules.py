"""The signature rules of the license scan: fixed values, written by hand, in order of trial.

A line is `label | keyword | words`, under a heading [n] that gives its class: 0 for tags and for sentences
of licenses themselves, 1 for statements that name a license and its version or say that it applies, 2 for
names.  In words, `x?` may be missing, `x/y` is either of them, and `x*` begins with x.  The keyword is a
word that every match holds, the rarest one."""

RULES = """
[0]
mit | spdx | spdx license identifier mit
mit | spdx | spdx license identifier mit 0
apache | spdx | spdx license identifier apache 1/2 0/1
gpl | spdx | spdx license identifier gpl 1/2/3 0 only?
gpl | spdx | spdx license identifier gpl 1/2/3 0 or later
lgpl | spdx | spdx license identifier lgpl 2/3 0/1 only?
lgpl | spdx | spdx license identifier lgpl 2/3 0/1 or later
agpl | spdx | spdx license identifier agpl 1/3 0 only?
agpl | spdx | spdx license identifier agpl 3 0 or later
gfdl | spdx | spdx license identifier gfdl 1 1/2/3
bsd | spdx | spdx license identifier bsd 1/2/3/4 clause
bsd | spdx | spdx license identifier 0bsd
isc | spdx | spdx license identifier isc
mpl | spdx | spdx license identifier mpl 1/2 0/1
epl | spdx | spdx license identifier epl 1/2 0
cddl | spdx | spdx license identifier cddl 1 0/1
cpl | spdx | spdx license identifier cpl 1 0
eupl | spdx | spdx license identifier eupl 1 1/2
unlicense | spdx | spdx license identifier unlicense
wtfpl | spdx | spdx license identifier wtfpl
zlib | spdx | spdx license identifier zlib
boost | spdx | spdx license identifier bsl 1 0
busl | spdx | spdx license identifier busl 1 1
artistic | spdx | spdx license identifier artistic 1/2 0
python | spdx | spdx license identifier psf 2 0
python | spdx | spdx license identifier python 2 0
php | spdx | spdx license identifier php 3 0/01
ruby | spdx | spdx license identifier ruby
openssl | spdx | spdx license identifier openssl
postgresql | spdx | spdx license identifier postgresql
x11 | spdx | spdx license identifier x11
curl | spdx | spdx license identifier curl
cc0 | spdx | spdx license identifier cc0 1 0
cc_by | spdx | spdx license identifier cc by 1/2/3/4 0/5
cc_by_sa | spdx | spdx license identifier cc by sa 1/2/3/4 0/5
cc_by_nc | spdx | spdx license identifier cc by nc 1/2/3/4 0/5
cc_by_nd | spdx | spdx license identifier cc by nd 1/2/3/4 0/5
cc_by_nc_sa | spdx | spdx license identifier cc by nc sa 1/2/3/4 0/5
cc_by_nc_nd | spdx | spdx license identifier cc by nc nd 1/2/3/4 0/5
ofl | spdx | spdx license identifier ofl 1 0/1
ms_pl | spdx | spdx license identifier ms pl
ms_rl | spdx | spdx license identifier ms rl
osl | spdx | spdx license identifier osl 1/2/3 0/1
afl | spdx | spdx license identifier afl 1/2/3 0/1/2
ncsa | spdx | spdx license identifier ncsa
libpng | spdx | spdx license identifier libpng 2? 0?
json | spdx | spdx license identifier json
vim | spdx | spdx license identifier vim
lppl | spdx | spdx license identifier lppl 1 0/1/2/3a/3c
qpl | spdx | spdx license identifier qpl 1 0
sleepycat | spdx | spdx license identifier sleepycat
w3c | spdx | spdx license identifier w3c
upl | spdx | spdx license identifier upl 1 0
blueoak | spdx | spdx license identifier blueoak 1 0 0
mulan | spdx | spdx license identifier mulanpsl 1/2 0
odbl | spdx | spdx license identifier odbl 1 0
odc_by | spdx | spdx license identifier odc by 1 0
pddl | spdx | spdx license identifier pddl 1 0
sspl | spdx | spdx license identifier sspl 1 0
elastic | spdx | spdx license identifier elastic 2 0
mit | obtaining | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | sublicense | rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | substantial | copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | noninfringement | warranties of merchantability fitness for a particular purpose and noninfringement
mit | dealings | out of or in connection with the software or the use or other dealings in the software
x11 | consortium | name of the x consortium shall not be used in advertising
apache | unless | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache | compliance | you may not use this file except in compliance with the license
apache | contributor | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright/patent license
apache | apache | you may obtain a copy of the license at http/https www apache org licenses license 2 0
apache | foundation | licensed to the apache software foundation asf? under one or more contributor license agreements
gpl | redistribute | this program/software/library/file is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | hope | this program/software/library/file is distributed in the hope that it will be useful but without any warranty
gpl | implied | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl | received | you should have received a copy of the gnu general public license along with this program/software/library/file
gpl | verbatim | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl | freedom | the licenses for most software are designed to take away your freedom to share and change it
gpl | copyleft | the gnu general public license is a free copyleft license for software and other kinds of works
gpl | copying | terms and conditions for copying distribution/conveying and? modification?
lgpl | lesser | redistribute it and or modify it under the terms of the gnu lesser general public license
lgpl | lesser | you should have received a copy of the gnu lesser general public license along with this program/software/library/file
lgpl | library | redistribute it and or modify it under the terms of the gnu library general public license
lgpl | lesser | this version of the gnu lesser general public license incorporates the terms and conditions
agpl | affero | redistribute it and or modify it under the terms of the gnu affero general public license
agpl | affero | you should have received a copy of the gnu affero general public license along with this program/software/library/file
agpl | remotely | all users interacting with it remotely through a computer network
gfdl | invariant | with no invariant sections no front cover texts and no back cover texts
gfdl | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | reproduce | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd | endorse | may be used to endorse or promote products derived from this software without specific prior written permission
bsd | holders | this software is provided by the copyright holders and contributors as is and any express or implied warranties
bsd | regents | this software is provided by the regents and contributors as is and any express or implied warranties
bsd | advertising | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd | exemplary | direct indirect incidental special exemplary or consequential damages
isc | hereby | permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted
isc | disclaims | the author disclaims all warranties with regard to this software including all implied warranties
isc | internet | internet systems consortium isc disclaims all warranties
mpl | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl | mozilla | the contents of this file are subject to the mozilla public license version 1 0/1
mpl | incompatible | incompatible with secondary licenses as defined by the mozilla public license
epl | accompanying | this program and the accompanying materials are made available under the terms of the eclipse public license
epl | accompanying | the accompanying program is provided under the terms of this eclipse public license
cddl | distribution | the contents of this file are subject to the terms of the common development and distribution license
cddl | cddl | include this cddl header in each file
cpl | accompanying | the accompanying program is provided under the terms of this common public license
eupl | eupl | licensed under the eupl
eupl | european | licence v? 1? 1/2? of the european union public licence
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | dedicate | the author or authors of this software dedicate any and all copyright interest in the software to the public domain
wtfpl | fuck | you just do what the fuck you want to
wtfpl | fuck | do what the fuck you want to public license
zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | held | in no event will the authors be held liable for any damages arising from the use of this software
boost | obtaining | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
boost | executable | solely in the form of machine executable object code generated by a source language processor
boost | boost | distributed under the boost software license version 1 0
artistic | artistic | you may distribute this package under the terms of the artistic license
artistic | artistic | under the same terms as perl itself or? the? artistic
artistic | perl | it under the same terms as perl itself
python | psf | psf is making python available to licensee on an as is basis
python | psf | psf hereby grants licensee a nonexclusive royalty free world wide license
python | beopen | beopen is making this? python? software? available to licensee on an as is basis
php | php | this product includes php software freely available from
php | php | the name php must not be used to endorse or promote products derived from this software
ruby | bsdl | you can redistribute it and or modify it under either the terms of the 2 clause bsdl
openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
openssl | cryptographic | this product includes cryptographic software written by eric young
postgresql | california | in no event shall the university of california be liable to any party for direct indirect special
x11 | x11 | permission is hereby granted to use copy modify and distribute this software for any purpose provided that the x11
curl | holder | except as contained in this notice the name of a copyright holder shall not be used in advertising
cc0 | waives | affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders
cc0 | dedicated | has dedicated the work to the public domain by waiving all of his or her rights
cc_by | credit | you must give appropriate credit provide a link to the license and indicate if changes were made
cc_by_sa | remix | if you remix transform or build upon the material you must distribute your contributions under the same license as the original
cc_by_nc | commercial | you may not use the material for commercial purposes
cc_by_nd | remix | if you remix transform or build upon the material you may not distribute the modified material
ofl | reserved | no modified version of the font software may use the reserved font name
ofl | bundled | original or modified versions of the font software may be bundled redistributed and or sold with any software
ofl | sil | this font software is licensed under the sil open font license version 1 1
ms_pl | infringed | if you bring a patent claim against any contributor over patents that you claim are infringed by the software
ms_rl | reciprocal | reciprocal grants for any file you distribute that contains code from the software
osl | open | licensed under the open software license version 1/2/3 0/1
afl | academic | licensed under the academic free license version 1/2/3 0/1/2
ncsa | illinois | developed by university of illinois
ncsa | ncsa | neither the names of ncsa nor the names of its contributors may be used to endorse
libpng | png | the png reference library is supplied as is
libpng | libpng | this copy of the libpng notices is provided for your convenience
json | evil | the software shall be used for good not evil
vim | vim | you are allowed to distribute unmodified copies of vim without restrictions
lppl | latex | it may be distributed and or modified under the conditions of the latex project public license
lppl | maintenance | this work has the lppl maintenance status
qpl | qt | this file is part of the qt toolkit and may be distributed under the terms of the q public license
sleepycat | accompanied | redistributions in any form must be accompanied by information on how to obtain complete source code
w3c | licensee | by obtaining using and or copying this work you the licensee agree that you have read understood and will comply
upl | upl | the above copyright notice and either this complete permission notice or at a minimum a reference to the upl
blueoak | rules | these rules allow you to do everything with this software that would otherwise infringe
mulan | mulan | you can use this software according to the terms and conditions of the mulan psl
odbl | database | this database is made available under the open database license
odc_by | commons | this database is made available under the open data commons attribution license
pddl | dedication | this data is made available under the public domain dedication and license
sspl | functionality | if you make the functionality of the program or a modified version available to third parties as a service
busl | licensor | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
busl | change | effective on the change date or the fourth anniversary of the first publicly available distribution
elastic | hosted | you may not provide the software to third parties as a hosted or managed service
commons_clause | sell | the grant of rights under the license will not include and the license does not grant to you the right to sell the software
beerware | beer | if we meet some day and you think this stuff is worth it you can buy me a beer in return
public_domain | domain | this work/software/file/code is hereby? released/placed into/in the public domain
public_domain | domain | the author/authors have/has? placed this work/software/file/code in the public domain
proprietary | proprietary | this software/file/document contains confidential and proprietary information
proprietary | unauthorized | unauthorized copying of this file via any medium is strictly prohibited
proprietary | rights | all rights reserved no part of this publication/document/book/work may be reproduced
[1]
mit | mit | licensed/released/distributed/available under the? terms? of? the? mit license
mit | mit | under the? terms? of? the? mit license/licence
mit | expat | under the? terms? of? the? expat license
mit | mit | license mit
mit | mit | mit style license
mit | opensource | opensource org licenses mit
apache | apache | licensed/released/distributed/available under the? terms? of? the? apache software? license
apache | apache | under the? terms? of? the? apache software? license/licence
apache | apache | apache software? license version 1/2 0/1
apache | apache | apache software? license v1/v2 0/1
apache | apache | apache software? license 1/2 0/1
apache | apache | license apache 2 0
apache | apache | www apache org licenses
apache | asl | asl 2 0
gpl | gnu | licensed/released/distributed/available under the? terms? of? the? gnu general public license
gpl | general | under the? terms? of? the? gnu? general public license/licence
gpl | gpl | licensed/released/distributed/available under the? terms? of? the? gnu? gpl license?
gpl | gpl | under the? terms? of? the? gnu? gpl license?
gpl | general | gnu? general public license version 1/2/3
gpl | general | gnu? general public license v1/v2/v3
gpl | general | general public license either version 1/2/3 of the license or at your option any later version
gpl | gpl | gpl version 1/2/3
gpl | gpl | gpl v1/v2/v3
gpl | gplv2 | gplv2
gpl | gplv3 | gplv3
gpl | gpl2 | gpl2
gpl | gpl3 | gpl3
gpl | gpl | gpl 2/3 0
gpl | gnu | www gnu org licenses gpl
lgpl | lesser | under the? terms? of? the? gnu? lesser general public license/licence
lgpl | lesser | gnu? lesser general public license version? 2/3/v2/v3 1?
lgpl | library | gnu library general public license version? 2?
lgpl | lgpl | under the? terms? of? the? gnu? lgpl license?
lgpl | lgpl | lgpl version? 2/3/v2/v3 0/1?
lgpl | lgplv2 | lgplv2 1?
lgpl | lgplv3 | lgplv3
agpl | affero | under the? terms? of? the? gnu? affero general public license/licence
agpl | affero | gnu? affero general public license version? 3/v3
agpl | agpl | under the? terms? of? the? gnu? agpl license?
agpl | agpl | agpl version? 3/v3 0?
agpl | agplv3 | agplv3
gfdl | documentation | under the? terms? of? the? gnu free documentation license/licence
gfdl | documentation | gnu free documentation license version 1 1/2/3
bsd | bsd | licensed/released/distributed/available under the? terms? of? the? bsd license
bsd | bsd | under the? terms? of? a/the? new/modified/simplified/revised? bsd license/licence
bsd | bsd | 2/3/4/two/three/four clause bsd license?
bsd | bsd | bsd 2/3/4 clause license?
bsd | bsd | bsd style license
bsd | freebsd | the freebsd copyright
isc | isc | under the? terms? of? the? isc license/licence
mpl | mozilla | under the? terms? of? the? mozilla public license/licence
mpl | mozilla | mozilla public license version? 1/2/v1/v2 0/1
mpl | mpl | under the? terms? of? the? mpl license?
mpl | mpl | mpl version? 1/2/v1/v2 0/1
epl | eclipse | under the? terms? of? the? eclipse public license/licence
epl | eclipse | eclipse public license version? 1/2/v1/v2 0
epl | eclipse | eclipse distribution license version? 1/v1 0
cddl | development | under the? terms? of? the? common development and distribution license
cddl | cddl | cddl version? 1/v1 0/1
cpl | common | common public license version? 1/v1 0
eupl | eupl | european union public licence/license v? 1? 1/2? eupl
unlicense | unlicense | under the? terms? of? the? unlicense
zlib | zlib | under the? terms? of? the? zlib libpng? license/licence
boost | boost | under the? terms? of? the? boost software? license/licence
boost | boost | boost software license version 1 0
artistic | artistic | under the? terms? of? the? perl? artistic license/licence
artistic | artistic | artistic license version? 1/2/v1/v2 0
python | python | python software foundation license version? 2?
python | psf | under the? terms? of? the? psf license
php | php | php license version? 3/v3 0/01
ruby | ruby | under the? terms? of? the? same? ruby license
openssl | openssl | dual? openssl and? ssleay license
postgresql | postgresql | under the? terms? of? the? postgresql license/licence
cc0 | cc0 | cc0 1 0 universal?
cc0 | zero | creative commons zero v1? 1? 0? universal
cc_by | attribution | creative commons attribution 1/2/3/4 0/5 international/unported/generic?
cc_by | creativecommons | creativecommons org licenses by 1/2/3/4 0/5
cc_by_sa | sharealike | creative commons attribution sharealike 1/2/3/4 0/5 international/unported/generic?
cc_by_sa | creativecommons | creativecommons org licenses by sa 1/2/3/4 0/5
cc_by_nc | noncommercial | creative commons attribution noncommercial 1/2/3/4 0/5 international/unported/generic?
cc_by_nc | creativecommons | creativecommons org licenses by nc 1/2/3/4 0/5
cc_by_nd | attribution | creative commons attribution noderivatives/noderivs 1/2/3/4 0/5 international/unported/generic?
cc_by_nd | creativecommons | creativecommons org licenses by nd 1/2/3/4 0/5
cc_by_nc_sa | noncommercial | creative commons attribution noncommercial sharealike 1/2/3/4 0/5 international/unported/generic?
cc_by_nc_nd | noncommercial | creative commons attribution noncommercial noderivatives/noderivs 1/2/3/4 0/5 international/unported/generic?
ofl | sil | under the? terms? of? the? sil open font license/licence
ofl | sil | sil open font license version? 1/v1 1
ms_pl | microsoft | microsoft public license ms pl
ms_rl | microsoft | microsoft reciprocal license ms rl
osl | open | open software license version? 1/2/3/v1/v2/v3 0/1
afl | academic | academic free license version? 1/2/3/v1/v2/v3 0/1/2
ncsa | illinois | university of illinois ncsa open source license
lppl | latex | latex project public license version? 1/v1 0/1/2/3/3a/3c
w3c | w3c | w3c software notice? and? document? license
nasa | nasa | nasa open source agreement version? 1? 3?
upl | permissive | universal permissive license version? 1/v1 0
blueoak | oak | blue oak model license version? 1 0 0
mulan | mulan | mulan permissive software license version? 1/2/v1/v2
odbl | database | open database license version? 1/v1 0
odc_by | commons | open data commons attribution license version? 1/v1 0
sspl | server | server side public license version? 1/v1
busl | business | business source license version? 1 1
elastic | elastic | elastic license version? 2/2/v2 0?
proprietary | proprietary | proprietary and confidential
proprietary | commercial | commercial license agreement
[2]
mit | expat | expat license
mit | massachusetts | massachusetts institute of technology license
apache | apache | apache software license
gpl | gpl | gnu? gpl license
gpl | general | gnu general public licence
lgpl | lesser | gnu? lesser general public license/licence
lgpl | lgpl | gnu? lgpl license?
agpl | affero | gnu? affero general public license/licence
agpl | agpl | gnu? agpl license?
gfdl | documentation | gnu? free documentation license/licence
bsd | bsd | new/modified/simplified/revised? bsd license/licence
bsd | berkeley | berkeley software distribution license?
isc | isc | isc license/licence
mpl | mozilla | mozilla public license/licence
epl | eclipse | eclipse public license/licence
cddl | development | common development and distribution license/licence
cpl | common | common public license/licence
eupl | european | european union public licence/license
unlicense | unlicense | the unlicense
wtfpl | wtfpl | wtfpl
zlib | zlib | zlib libpng? license/licence
boost | boost | boost software? license/licence
artistic | artistic | perl? artistic license/licence
python | python | python software foundation license/licence
php | php | php license/licence
ruby | ruby | ruby license/licence
openssl | openssl | openssl license/licence
postgresql | postgresql | postgresql license/licence
x11 | x11 | x11 license/licence
curl | curl | curl license/licence
cc0 | zero | creative commons zero
cc_by | creative | creative commons attribution license/licence?
cc_by_sa | sharealike | creative commons attribution sharealike license/licence?
cc_by_nc | noncommercial | creative commons attribution noncommercial license/licence?
cc_by_nd | noderivatives | creative commons attribution noderivatives license/licence?
ofl | font | sil? open font license/licence
ms_pl | microsoft | microsoft public license/licence
ms_rl | microsoft | microsoft reciprocal license/licence
osl | open | open software license/licence
afl | academic | academic free license/licence
ncsa | ncsa | university? of? illinois? ncsa license/licence
libpng | libpng | libpng license/licence
json | json | json license/licence
vim | vim | vim license/licence
lppl | latex | latex project public license/licence
qpl | q | q public license/licence
sleepycat | sleepycat | sleepycat license/licence
w3c | w3c | w3c software? license/licence
nasa | nasa | nasa open source agreement
upl | permissive | universal permissive license/licence
blueoak | oak | blue oak model license
mulan | mulan | mulan permissive software? license
odbl | database | open database license/licence
pddl | dedication | public domain dedication and license
sspl | server | server side public license
busl | business | business source license
elastic | elastic | elastic license
commons_clause | commons | commons clause license? condition?
beerware | beerware | beerware license?
public_domain | domain | public domain software/license/work
"""
