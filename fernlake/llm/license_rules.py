"""Signatures of licences: ``licence | priority | regular expression``.

Written by hand. A space stands for any run of white space and comment leaders.
Priorities: 5 identifier tag, 4 grant or notice, 3 full name or distinctive
sentence of the text, 2 address, 1 short name.
"""

TABLE = r"""
MIT | 5 | spdx-license-identifier: mit\b
MIT | 4 | (?:released|licensed|distributed|available) under the (?:terms of the )?mit licen[cs]e
MIT | 3 | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
MIT | 3 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
MIT | 2 | (?:www\.)?opensource\.org/licenses/mit(?:-license)?(?:\.php|\.html)?
MIT | 1 | \bmit licen[cs]e
MIT | 1 | licen[cs]e: mit\b
MIT-0 | 5 | spdx-license-identifier: mit-0
MIT-0 | 1 | \bmit no attribution
Expat | 1 | \bexpat licen[cs]e
Apache-2.0 | 5 | spdx-license-identifier: apache-2\.0
Apache-2.0 | 4 | licensed under the apache licen[cs]e,? version 2\.0(?: \(the .?license.?\))?
Apache-2.0 | 4 | (?:released|distributed|available) under the (?:terms of the )?apache licen[cs]e,? (?:version )?2(?:\.0)?
Apache-2.0 | 3 | apache licen[cs]e,? version 2\.0
Apache-2.0 | 3 | unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "as is" basis
Apache-2.0 | 2 | (?:www\.)?apache\.org/licenses/license-2\.0(?:\.txt|\.html)?
Apache-2.0 | 1 | \bapache(?:-| )2(?:\.0)?\b
Apache-1.1 | 5 | spdx-license-identifier: apache-1\.1
Apache-1.1 | 3 | apache software license,? version 1\.1
Apache-1.0 | 5 | spdx-license-identifier: apache-1\.0
Apache-1.0 | 3 | apache software license,? version 1\.0
Apache | 1 | \bapache licen[cs]e
GPL-3.0-or-later | 5 | spdx-license-identifier: gpl-3\.0(?:-or-later|\+)
GPL-3.0-only | 5 | spdx-license-identifier: gpl-3\.0(?:-only)?
GPL-2.0-or-later | 5 | spdx-license-identifier: gpl-2\.0(?:-or-later|\+)
GPL-2.0-only | 5 | spdx-license-identifier: gpl-2\.0(?:-only)?
GPL-3.0-only | 4 | licensed under (?:the terms of )?the gnu general public licen[cs]e,? version 3(?:\.0)?
GPL-2.0-only | 4 | licensed under (?:the terms of )?the gnu general public licen[cs]e,? version 2(?:\.0)?
GPL-3.0-or-later | 4 | gnu general public licen[cs]e as published by the free software foundation, either version 3 of the license, or \(at your option\) any later version
GPL-2.0-or-later | 4 | gnu general public licen[cs]e as published by the free software foundation; either version 2 of the license, or \(at your option\) any later version
GPL-3.0-only | 3 | gnu general public licen[cs]e,? (?:version |v\.? ?)3(?:\.0)?
GPL-2.0-only | 3 | gnu general public licen[cs]e,? (?:version |v\.? ?)2(?:\.0)?
GPL-1.0-only | 3 | gnu general public licen[cs]e,? (?:version |v\.? ?)1(?:\.0)?
GPL | 1 | gnu general public licen[cs]e
GPL | 1 | gnu gpl\b
GPL-3.0-only | 1 | \bgpl ?v?3(?:\.0)?\b
GPL-2.0-only | 1 | \bgpl ?v?2(?:\.0)?\b
GPL-3.0-only | 2 | (?:www\.)?gnu\.org/licenses/gpl-3\.0(?:\.txt|\.html|\.en\.html)?
GPL-2.0-only | 2 | (?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0(?:\.txt|\.html|\.en\.html)?
GPL | 2 | (?:www\.)?gnu\.org/(?:licenses|copyleft)/gpl(?:\.html|\.txt)?
GPL | 3 | you should have received a copy of the gnu general public license along with this program
LGPL-3.0-or-later | 5 | spdx-license-identifier: lgpl-3\.0(?:-or-later|\+)
LGPL-3.0-only | 5 | spdx-license-identifier: lgpl-3\.0(?:-only)?
LGPL-2.1-or-later | 5 | spdx-license-identifier: lgpl-2\.1(?:-or-later|\+)
LGPL-2.1-only | 5 | spdx-license-identifier: lgpl-2\.1(?:-only)?
LGPL-2.0-only | 5 | spdx-license-identifier: lgpl-2\.0(?:-only|-or-later|\+)?
LGPL-3.0-only | 3 | gnu lesser general public licen[cs]e,? (?:version |v\.? ?)3(?:\.0)?
LGPL-2.1-only | 3 | gnu lesser general public licen[cs]e,? (?:version |v\.? ?)2\.1
LGPL-2.0-only | 3 | gnu library general public licen[cs]e,? (?:version |v\.? ?)2(?:\.0)?
LGPL-2.1-or-later | 4 | gnu lesser general public licen[cs]e as published by the free software foundation; either version 2\.1 of the license, or \(at your option\) any later version
LGPL-3.0-or-later | 4 | gnu lesser general public licen[cs]e as published by the free software foundation, either version 3 of the license, or \(at your option\) any later version
LGPL | 1 | gnu lesser general public licen[cs]e
LGPL | 1 | gnu library general public licen[cs]e
LGPL-3.0-only | 1 | \blgpl ?v?3(?:\.0)?\b
LGPL-2.1-only | 1 | \blgpl ?v?2\.1\b
LGPL | 2 | (?:www\.)?gnu\.org/(?:licenses|copyleft)/lgpl(?:-\d\.\d)?(?:\.html|\.txt)?
AGPL-3.0-or-later | 5 | spdx-license-identifier: agpl-3\.0(?:-or-later|\+)
AGPL-3.0-only | 5 | spdx-license-identifier: agpl-3\.0(?:-only)?
AGPL-3.0-only | 3 | gnu affero general public licen[cs]e,? (?:version |v\.? ?)3(?:\.0)?
AGPL-3.0-or-later | 4 | gnu affero general public licen[cs]e as published by the free software foundation, either version 3 of the license, or \(at your option\) any later version
AGPL | 1 | gnu affero general public licen[cs]e
AGPL-1.0-only | 1 | affero general public licen[cs]e,? version 1
AGPL-3.0-only | 1 | \bagpl ?v?3(?:\.0)?\b
AGPL | 2 | (?:www\.)?gnu\.org/licenses/agpl(?:-3\.0)?(?:\.html|\.txt)?
GFDL-1.3 | 5 | spdx-license-identifier: gfdl-1\.3(?:-only|-or-later)?
GFDL-1.2 | 5 | spdx-license-identifier: gfdl-1\.2(?:-only|-or-later)?
GFDL-1.3 | 3 | gnu free documentation licen[cs]e,? version 1\.3
GFDL-1.2 | 3 | gnu free documentation licen[cs]e,? version 1\.2
GFDL | 1 | gnu free documentation licen[cs]e
BSD-2-Clause | 5 | spdx-license-identifier: bsd-2-clause
BSD-3-Clause | 5 | spdx-license-identifier: bsd-3-clause
BSD-4-Clause | 5 | spdx-license-identifier: bsd-4-clause
0BSD | 5 | spdx-license-identifier: 0bsd
BSD-2-Clause | 4 | under the (?:terms of the )?(?:simplified|2-clause|two-clause|freebsd) bsd licen[cs]e
BSD-3-Clause | 4 | under the (?:terms of the )?(?:new|revised|modified|3-clause|three-clause) bsd licen[cs]e
BSD-2-Clause | 1 | (?:simplified|2-clause|two-clause|freebsd) bsd licen[cs]e
BSD-3-Clause | 1 | (?:new|revised|modified|3-clause|three-clause) bsd licen[cs]e
BSD-4-Clause | 1 | (?:original|4-clause|four-clause) bsd licen[cs]e
BSD-4-Clause | 3 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
BSD-3-Clause | 3 | neither the name of [^\n]{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software
BSD | 3 | redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
BSD | 2 | (?:www\.)?opensource\.org/licenses/bsd-license(?:\.php)?
BSD-3-Clause | 2 | (?:www\.)?opensource\.org/licenses/bsd-3-clause
BSD-2-Clause | 2 | (?:www\.)?opensource\.org/licenses/bsd-2-clause
BSD | 1 | \bbsd(?:-style)? licen[cs]e
ISC | 5 | spdx-license-identifier: isc\b
ISC | 3 | permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted
ISC | 1 | \bisc licen[cs]e
ISC | 2 | (?:www\.)?opensource\.org/licenses/isc(?:-license)?
MPL-2.0 | 5 | spdx-license-identifier: mpl-2\.0
MPL-1.1 | 5 | spdx-license-identifier: mpl-1\.1
MPL-2.0 | 4 | this source code form is subject to the terms of the mozilla public license,? v\. ?2\.0
MPL-2.0 | 3 | mozilla public licen[cs]e,? (?:version |v\.? ?)2\.0
MPL-1.1 | 3 | mozilla public licen[cs]e,? (?:version |v\.? ?)1\.1
MPL-1.0 | 3 | mozilla public licen[cs]e,? (?:version |v\.? ?)1\.0
MPL-2.0 | 2 | (?:www\.)?mozilla\.org/(?:en-us/)?mpl/2\.0
MPL | 1 | mozilla public licen[cs]e
EPL-2.0 | 5 | spdx-license-identifier: epl-2\.0
EPL-1.0 | 5 | spdx-license-identifier: epl-1\.0
EPL-2.0 | 3 | eclipse public licen[cs]e,? (?:- )?(?:version |v\.? ?)2(?:\.0)?
EPL-1.0 | 3 | eclipse public licen[cs]e,? (?:- )?(?:version |v\.? ?)1(?:\.0)?
EPL | 1 | eclipse public licen[cs]e
EPL-2.0 | 2 | (?:www\.)?eclipse\.org/legal/epl-2\.0
EPL-1.0 | 2 | (?:www\.)?eclipse\.org/legal/epl-v10(?:\.html)?
EDL-1.0 | 1 | eclipse distribution licen[cs]e
CDDL-1.0 | 5 | spdx-license-identifier: cddl-1\.0
CDDL-1.1 | 5 | spdx-license-identifier: cddl-1\.1
CDDL-1.0 | 3 | common development and distribution licen[cs]e,? (?:\(cddl\) )?(?:version |v\.? ?)1\.0
CDDL-1.1 | 3 | common development and distribution licen[cs]e,? (?:\(cddl\) )?(?:version |v\.? ?)1\.1
CDDL | 1 | common development and distribution licen[cs]e
CPL-1.0 | 5 | spdx-license-identifier: cpl-1\.0
CPL-1.0 | 1 | common public licen[cs]e
CPAL-1.0 | 1 | common public attribution licen[cs]e
IPL-1.0 | 1 | ibm public licen[cs]e
EUPL-1.2 | 5 | spdx-license-identifier: eupl-1\.2
EUPL-1.1 | 5 | spdx-license-identifier: eupl-1\.1
EUPL-1.2 | 3 | european union public licen[cs]e,? (?:version |v\.? ?)1\.2
EUPL-1.1 | 3 | european union public licen[cs]e,? (?:version |v\.? ?)1\.1
EUPL | 1 | european union public licen[cs]e
CECILL-2.1 | 5 | spdx-license-identifier: cecill-2\.1
CECILL-B | 1 | \bcecill-b\b
CECILL-C | 1 | \bcecill-c\b
CECILL | 1 | \bcecill (?:free software )?licen[cs]e
OSL-3.0 | 5 | spdx-license-identifier: osl-3\.0
OSL-3.0 | 3 | open software licen[cs]e,? (?:version |v\.? ?)3\.0
AFL-3.0 | 5 | spdx-license-identifier: afl-3\.0
AFL-3.0 | 3 | academic free licen[cs]e,? (?:version |v\.? ?)3\.0
AFL | 1 | academic free licen[cs]e
Artistic-2.0 | 5 | spdx-license-identifier: artistic-2\.0
Artistic-1.0 | 5 | spdx-license-identifier: artistic-1\.0(?:-perl|-cl8)?
Artistic-2.0 | 3 | artistic licen[cs]e,? (?:version |v\.? ?)?2\.0
Artistic-1.0 | 3 | artistic licen[cs]e,? (?:version |v\.? ?)?1\.0
Artistic | 1 | \bartistic licen[cs]e
Artistic | 4 | under the same terms as perl itself
Zlib | 5 | spdx-license-identifier: zlib\b
Zlib | 1 | \bzlib(?:/libpng)? licen[cs]e
Zlib | 3 | altered source versions must be plainly marked as such, and must not be misrepresented as being the original software
Libpng | 5 | spdx-license-identifier: libpng(?:-2\.0)?
BSL-1.0 | 5 | spdx-license-identifier: bsl-1\.0
BSL-1.0 | 4 | distributed under the boost software licen[cs]e,? version 1\.0
BSL-1.0 | 1 | boost software licen[cs]e
BSL-1.0 | 2 | (?:www\.)?boost\.org/license_1_0\.txt
BUSL-1.1 | 5 | spdx-license-identifier: busl-1\.1
BUSL-1.1 | 1 | business source licen[cs]e(?: 1\.1)?
SSPL-1.0 | 5 | spdx-license-identifier: sspl-1\.0
SSPL-1.0 | 1 | server side public licen[cs]e
Elastic-2.0 | 5 | spdx-license-identifier: elastic-2\.0
Elastic-2.0 | 1 | elastic licen[cs]e(?: 2\.0)?
Unlicense | 5 | spdx-license-identifier: unlicense
Unlicense | 3 | this is free and unencumbered software released into the public domain
Unlicense | 2 | (?:www\.)?unlicense\.org
Unlicense | 1 | \bthe unlicense\b
WTFPL | 5 | spdx-license-identifier: wtfpl
WTFPL | 1 | do what the f[a-z*]{3} you want to public licen[cs]e
WTFPL | 1 | \bwtfpl\b
CC0-1.0 | 5 | spdx-license-identifier: cc0-1\.0
CC0-1.0 | 4 | (?:licensed|released|available) under (?:the )?cc0(?: 1\.0)?
CC0-1.0 | 1 | \bcc0(?: |-)1\.0
CC0-1.0 | 1 | creative commons zero
CC0-1.0 | 2 | creativecommons\.org/publicdomain/zero/1\.0
CC-PDM-1.0 | 2 | creativecommons\.org/publicdomain/mark/1\.0
CC-BY-4.0 | 5 | spdx-license-identifier: cc-by-4\.0
CC-BY-3.0 | 5 | spdx-license-identifier: cc-by-3\.0
CC-BY-SA-4.0 | 5 | spdx-license-identifier: cc-by-sa-4\.0
CC-BY-SA-3.0 | 5 | spdx-license-identifier: cc-by-sa-3\.0
CC-BY-NC-4.0 | 5 | spdx-license-identifier: cc-by-nc-4\.0
CC-BY-NC-SA-4.0 | 5 | spdx-license-identifier: cc-by-nc-sa-4\.0
CC-BY-ND-4.0 | 5 | spdx-license-identifier: cc-by-nd-4\.0
CC-BY-NC-ND-4.0 | 5 | spdx-license-identifier: cc-by-nc-nd-4\.0
CC-BY-NC-SA-4.0 | 4 | licensed under (?:a |the )?cc(?: |-)by(?: |-)nc(?: |-)sa(?: |-)4\.0
CC-BY-NC-ND-4.0 | 4 | licensed under (?:a |the )?cc(?: |-)by(?: |-)nc(?: |-)nd(?: |-)4\.0
CC-BY-NC-4.0 | 4 | licensed under (?:a |the )?cc(?: |-)by(?: |-)nc(?: |-)4\.0
CC-BY-SA-4.0 | 4 | licensed under (?:a |the )?cc(?: |-)by(?: |-)sa(?: |-)4\.0
CC-BY-ND-4.0 | 4 | licensed under (?:a |the )?cc(?: |-)by(?: |-)nd(?: |-)4\.0
CC-BY-4.0 | 4 | licensed under (?:a |the )?cc(?: |-)by(?: |-)4\.0
CC-BY-NC-SA-4.0 | 1 | \bcc(?: |-)by(?: |-)nc(?: |-)sa(?: |-)4\.0
CC-BY-NC-SA-3.0 | 1 | \bcc(?: |-)by(?: |-)nc(?: |-)sa(?: |-)3\.0
CC-BY-NC-ND-4.0 | 1 | \bcc(?: |-)by(?: |-)nc(?: |-)nd(?: |-)4\.0
CC-BY-NC-ND-3.0 | 1 | \bcc(?: |-)by(?: |-)nc(?: |-)nd(?: |-)3\.0
CC-BY-NC-4.0 | 1 | \bcc(?: |-)by(?: |-)nc(?: |-)4\.0
CC-BY-NC-3.0 | 1 | \bcc(?: |-)by(?: |-)nc(?: |-)3\.0
CC-BY-SA-4.0 | 1 | \bcc(?: |-)by(?: |-)sa(?: |-)4\.0
CC-BY-SA-3.0 | 1 | \bcc(?: |-)by(?: |-)sa(?: |-)3\.0
CC-BY-ND-4.0 | 1 | \bcc(?: |-)by(?: |-)nd(?: |-)4\.0
CC-BY-4.0 | 1 | \bcc(?: |-)by(?: |-)4\.0
CC-BY-3.0 | 1 | \bcc(?: |-)by(?: |-)3\.0
CC-BY-NC-SA | 3 | creative commons attribution-noncommercial-sharealike(?: \d\.\d)?
CC-BY-NC-ND | 3 | creative commons attribution-noncommercial-noderiv(?:ative)?s(?: \d\.\d)?
CC-BY-NC | 3 | creative commons attribution-noncommercial(?: \d\.\d)?
CC-BY-SA | 3 | creative commons attribution-sharealike(?: \d\.\d)?
CC-BY-ND | 3 | creative commons attribution-noderiv(?:ative)?s(?: \d\.\d)?
CC-BY | 3 | creative commons attribution(?: \d\.\d)? (?:international |unported |generic )?licen[cs]e
CC-BY-NC-SA-4.0 | 2 | creativecommons\.org/licenses/by-nc-sa/4\.0
CC-BY-NC-ND-4.0 | 2 | creativecommons\.org/licenses/by-nc-nd/4\.0
CC-BY-NC-4.0 | 2 | creativecommons\.org/licenses/by-nc/4\.0
CC-BY-SA-4.0 | 2 | creativecommons\.org/licenses/by-sa/4\.0
CC-BY-SA-3.0 | 2 | creativecommons\.org/licenses/by-sa/3\.0
CC-BY-ND-4.0 | 2 | creativecommons\.org/licenses/by-nd/4\.0
CC-BY-4.0 | 2 | creativecommons\.org/licenses/by/4\.0
CC-BY-3.0 | 2 | creativecommons\.org/licenses/by/3\.0
CC-BY-2.0 | 2 | creativecommons\.org/licenses/by/2\.0
ODbL-1.0 | 5 | spdx-license-identifier: odbl-1\.0
ODbL-1.0 | 1 | open (?:data commons open )?database licen[cs]e
ODC-By-1.0 | 5 | spdx-license-identifier: odc-by-1\.0
ODC-By-1.0 | 1 | open data commons attribution licen[cs]e
PDDL-1.0 | 5 | spdx-license-identifier: pddl-1\.0
PDDL-1.0 | 1 | public domain dedication and licen[cs]e
OGL-UK-3.0 | 3 | open government licen[cs]e v?3\.0
OGL-UK | 1 | open government licen[cs]e
PSF-2.0 | 5 | spdx-license-identifier: (?:psf|python)-2\.0
PSF-2.0 | 1 | python software foundation licen[cs]e
PHP-3.01 | 5 | spdx-license-identifier: php-3\.01
PHP-3.01 | 1 | the php licen[cs]e,? version 3\.01
Ruby | 5 | spdx-license-identifier: ruby\b
OFL-1.1 | 5 | spdx-license-identifier: ofl-1\.1
OFL-1.1 | 1 | sil open font licen[cs]e(?:,? version 1\.1)?
OFL-1.1 | 2 | scripts\.sil\.org/ofl
LPPL-1.3c | 5 | spdx-license-identifier: lppl-1\.3c
LPPL | 1 | latex project public licen[cs]e
MS-PL | 5 | spdx-license-identifier: ms-pl
MS-PL | 1 | microsoft public licen[cs]e
MS-RL | 5 | spdx-license-identifier: ms-rl
MS-RL | 1 | microsoft reciprocal licen[cs]e
NCSA | 5 | spdx-license-identifier: ncsa\b
NCSA | 1 | university of illinois/ncsa open source licen[cs]e
UPL-1.0 | 5 | spdx-license-identifier: upl-1\.0
UPL-1.0 | 1 | universal permissive licen[cs]e
Vim | 5 | spdx-license-identifier: vim\b
W3C | 5 | spdx-license-identifier: w3c\b
W3C | 1 | w3c software (?:notice and )?licen[cs]e
Unicode-DFS-2016 | 5 | spdx-license-identifier: unicode-dfs-2016
ICU | 5 | spdx-license-identifier: icu\b
OpenSSL | 5 | spdx-license-identifier: openssl\b
OpenSSL | 1 | openssl licen[cs]e
X11 | 5 | spdx-license-identifier: x11\b
X11 | 1 | \bx11 licen[cs]e
Beerware | 5 | spdx-license-identifier: beerware
Beerware | 1 | the beer-ware licen[cs]e
JSON | 3 | the software shall be used for good, not evil
Sleepycat | 5 | spdx-license-identifier: sleepycat
PostgreSQL | 5 | spdx-license-identifier: postgresql
PostgreSQL | 1 | postgresql licen[cs]e
QPL-1.0 | 1 | q public licen[cs]e
Blue Oak | 5 | spdx-license-identifier: blueoak-1\.0\.0
Blue Oak | 1 | blue oak model licen[cs]e
MulanPSL-2.0 | 5 | spdx-license-identifier: mulanpsl-2\.0
MulanPSL-2.0 | 1 | mulan permissive software licen[cs]e
RAIL | 1 | responsible ai licen[cs]e
OpenRAIL-M | 1 | openrail(?:\+\+)?-m\b
Proprietary | 4 | all rights reserved\. unauthori[sz]ed copying of this file
Proprietary | 4 | proprietary and confidential
Public-Domain | 4 | (?:released|placed|dedicated) (?:in)?to the public domain
Public-Domain | 1 | this (?:work|file|code|software) is in the public domain
"""
