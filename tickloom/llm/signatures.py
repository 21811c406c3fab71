"""Signature rules of licence statements, written by hand.

A line is ``kind keywords: pattern``. Patterns work on lower-case words joined by single spaces, and match whole words; version
"2.0" is the two words ``2 0``. ``<n>`` stands for up to n words of any kind. Every match holds all the keywords of its line,
which gates the pattern. Kinds, strongest first: ``t`` tag, ``x`` sentence of the licence text, ``n`` notice, ``m`` name or
address, ``c`` mere clue."""

from __future__ import annotations

RULES = """
[mit]
t spdx,mit: spdx license identifier mit
x sublicense,merge: to use copy modify merge publish distribute sublicense and or sell copies of the software
x hereby,persons: permission is hereby granted free of charge to any person obtaining a copy<14> persons
x substantial,portions: permission notice shall be included in all copies or substantial portions of the software
n released,mit: released under<2> mit licen[cs]e
n licensed,mit: (?:dual )?licensed under<3> mit(?: licen[cs]e)?
n distributed,mit: distributed under<4> mit licen[cs]e
n available,mit: available under<4> mit licen[cs]e
m expat: expat licen[cs]e
m mit,x11: mit x11(?: licen[cs]e)?
m mit: (?:the )?mit licen[cs]e
m opensource,mit: opensource org licenses mit
[mit-0]
t spdx,mit: spdx license identifier mit 0
m attribution,mit: mit no attribution(?: licen[cs]e)?
[apache-2.0]
t spdx,apache: spdx license identifier apache 2 0
x kind,warranties: on an as is basis without warranties or conditions of any kind
x apache,compliance: apache license<8> you may not use this file except in compliance with the license
x irrevocable,royalty: perpetual worldwide non exclusive no charge royalty free irrevocable<4> copyright license
n licensed,apache: licensed under the apache licen[cs]e(?: version)? 2(?: 0)?
n released,apache: released under<3> apache(?: licen[cs]e)?(?: version)? v?2(?: 0)?
m apache,version: apache licen[cs]e version 2(?: 0)?
m apache,2: apache(?: licen[cs]e| software licen[cs]e)? 2(?: 0)?
m apache,v2: apache(?: licen[cs]e)? v2(?: 0)?
m asl: asl (?:2|v2)(?: 0)?
m apache,licenses: apache org licenses license 2 0(?: txt| html)?
[apache-1.1]
t spdx,apache: spdx license identifier apache 1 1
x apache,developed: this product includes software developed by the apache software foundation
m apache,1: apache(?: software)? licen[cs]e(?: version)? 1 1
[apache-1.0]
t spdx,apache: spdx license identifier apache 1 0
m apache,1: apache(?: software)? licen[cs]e(?: version)? 1 0
[gpl-1.0]
t spdx,gpl: spdx license identifier gpl 1 0(?: only| or later)?
n gnu,1: gnu general public licen[cs]e<8> (?:either )?version 1(?: 0)?
m gpl: (?:gnu )?gpl (?:v|version )?1(?: 0)?
m gplv1: gplv1
[gpl-2.0]
t spdx,gpl: spdx license identifier gpl 2 0 only
x gnu,2: gnu general public license version 2 june 1991
x terms,conditions: terms and conditions for copying distribution and modification<12> this license applies to any program
n gnu,2: gnu general public licen[cs]e(?: as published by the free software foundation)?<2> version 2(?: 0)?
n licensed,gpl: licensed under<3> gpl (?:v|version )?2(?: 0)?
m gpl: (?:gnu )?gpl (?:v |version )?2(?: 0)?(?: only)?
m gplv2: (?:gnu )?gplv2
m gpl,v2: (?:gnu )?gpl v2(?: 0)?
m gnu,licenses: gnu org licenses (?:old licenses )?gpl 2 0(?: txt| html)?
[gpl-2.0-or-later]
t spdx,gpl: spdx license identifier gpl 2 0 or later
n gnu,2: gnu general public licen[cs]e<12> version 2(?: 0)? of the licen[cs]e or<4> any later version
m gpl,later: (?:gnu )?gpl (?:v|version )?2(?: 0)? or(?: any)? later
m gplv2,later: gplv2 or(?: any)? later
[gpl-3.0]
t spdx,gpl: spdx license identifier gpl 3 0 only
x gnu,29: gnu general public license version 3 29 june 2007
x copyleft,gnu: the gnu general public license is a free copyleft license for software
n gnu,3: gnu general public licen[cs]e(?: as published by the free software foundation)?<2> version 3(?: 0)?
n licensed,gpl: licensed under<3> gpl (?:v|version )?3(?: 0)?
m gpl: (?:gnu )?gpl (?:v |version )?3(?: 0)?(?: only)?
m gplv3: (?:gnu )?gplv3
m gpl,v3: (?:gnu )?gpl v3(?: 0)?
m gnu,licenses: gnu org licenses gpl 3 0(?: txt| html)?
[gpl-3.0-or-later]
t spdx,gpl: spdx license identifier gpl 3 0 or later
n gnu,3: gnu general public licen[cs]e<12> version 3(?: 0)? of the licen[cs]e or<4> any later version
m gpl,later: (?:gnu )?gpl (?:v|version )?3(?: 0)? or(?: any)? later
m gplv3,later: gplv3 or(?: any)? later
[gpl]
n redistribute,gnu: redistribute it and or modify it under the terms of the gnu general public licen[cs]e
n gnu,received: you should have received a copy of the gnu general public licen[cs]e
n licensed,gpl: licensed under<2> (?:gnu )?gpl
n released,gpl: released under<2> (?:gnu )?gpl
m gnu: gnu general public licen[cs]e
m gnu,gpl: gnu gpl
m gpl: gpl licen[cs]ed?
m gnu,copyleft: gnu org copyleft gpl(?: html)?
[lgpl-2.0]
t spdx,lgpl: spdx license identifier lgpl 2 0(?: only| or later)?
n library,2: gnu library general public licen[cs]e<8> version 2(?: 0)?
m lgpl: (?:gnu )?lgpl (?:v|version )?2 0
[lgpl-2.1]
t spdx,lgpl: spdx license identifier lgpl 2 1 only
x lesser,1999: gnu lesser general public license version 2 1 february 1999
n lesser,2: gnu lesser general public licen[cs]e<10> version 2 1
m lgpl: (?:gnu )?lgpl (?:v|version )?2 1
m lgplv2: lgplv2(?: 1)?
m lgpl,v2: lgpl v2(?: 1)?
[lgpl-2.1-or-later]
t spdx,lgpl: spdx license identifier lgpl 2 1 or later
n lesser,later: gnu lesser general public licen[cs]e<12> version 2 1 of the licen[cs]e or<4> any later version
m lgpl,later: lgpl (?:v|version )?2 1 or(?: any)? later
[lgpl-3.0]
t spdx,lgpl: spdx license identifier lgpl 3 0(?: only)?
x lesser,29: gnu lesser general public license version 3 29 june 2007
n lesser,3: gnu lesser general public licen[cs]e<10> version 3(?: 0)?
m lgpl: (?:gnu )?lgpl (?:v|version )?3(?: 0)?
m lgplv3: lgplv3
[lgpl]
m lesser: gnu lesser general public licen[cs]e
m library: gnu library general public licen[cs]e
m lgpl: (?:gnu )?lgpl(?: licen[cs]ed?)?
[agpl-3.0]
t spdx,agpl: spdx license identifier agpl 3 0(?: only| or later)?
x affero,remote: remote network interaction use with the gnu general public license<30> affero
x affero,2007: gnu affero general public license version 3 19 november 2007
n affero,3: gnu affero general public licen[cs]e<10> version 3(?: 0)?
m affero: (?:gnu )?affero general public licen[cs]e
m agpl: (?:gnu )?agpl(?: v3| 3(?: 0)?)?
m agplv3: agplv3
[gfdl]
t spdx,gfdl: spdx license identifier gfdl 1 [123](?: only| or later)?
x invariant,cover: with no invariant sections no front cover texts and no back cover texts
n documentation,gnu: terms of the gnu free documentation licen[cs]e
m documentation,gnu: gnu free documentation licen[cs]e(?: version)?(?: 1 [123])?
m gfdl: (?:gnu )?gfdl
[bsd-2-clause]
t spdx,bsd: spdx license identifier bsd 2 clause
n simplified,bsd: (?:released|licensed|distributed) under<3> simplified bsd licen[cs]e
m bsd,2: bsd 2 clause(?: licen[cs]e)?
m bsd,two: two clause bsd(?: licen[cs]e)?
m simplified,bsd: simplified bsd(?: licen[cs]e)?
m freebsd: freebsd licen[cs]e
[bsd-3-clause]
t spdx,bsd: spdx license identifier bsd 3 clause
x endorse,promote: names? of<8> contributors may be used to endorse or promote products derived from this software
m bsd,3: bsd 3 clause(?: licen[cs]e)?
m bsd,three: three clause bsd(?: licen[cs]e)?
m bsd,new: new bsd(?: licen[cs]e)?
m bsd,modified: modified bsd(?: licen[cs]e)?
m bsd,revised: revised bsd(?: licen[cs]e)?
[bsd-4-clause]
t spdx,bsd: spdx license identifier bsd 4 clause
x advertising,mentioning: all advertising materials mentioning features or use of this software must display the following acknowledge?ment
m bsd,original: original bsd(?: licen[cs]e)?
m bsd,4: bsd 4 clause(?: licen[cs]e)?
[0bsd]
t spdx,0bsd: spdx license identifier 0bsd
m bsd,zero: zero clause bsd(?: licen[cs]e)?
m 0bsd: 0bsd
[bsd]
x redistribution,binary: redistribution and use in source and binary forms with or without modification are permitted
x consequential,exemplary: liable for any direct indirect incidental special exemplary or consequential damages
n licensed,bsd: (?:dual )?licensed under<2> bsd(?: style)? licen[cs]e
m bsd: bsd(?: style)? licen[cs]ed?
[isc]
t spdx,isc: spdx license identifier isc
x hereby,granted: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
n licensed,isc: licensed under<2> isc licen[cs]e
n released,isc: released under<2> isc licen[cs]e
m isc: isc licen[cs]e
[zlib]
t spdx,zlib: spdx license identifier zlib
x misrepresented,origin: the origin of this software must not be misrepresented
x altered,versions: altered source versions must be plainly marked as such
m zlib: zlib(?: libpng)? licen[cs]e
[libpng]
t spdx,libpng: spdx license identifier libpng(?: 2 0)?
m libpng: libpng licen[cs]e
[bsl-1.0]
t spdx,bsl: spdx license identifier bsl 1 0
x boost,permission: permission is hereby granted<30> covered by this license<40> boost
n boost,distributed: distributed under the boost software licen[cs]e(?: version 1 0)?
m boost: boost software licen[cs]e(?: version)?(?: 1 0)?
[unlicense]
t spdx,unlicense: spdx license identifier unlicense
x unencumbered: free and unencumbered software released into the public domain
m unlicense: (?:the )?unlicense(?: org)?
[wtfpl]
t spdx,wtfpl: spdx license identifier wtfpl
x fuck: you just do what the fuck you want to
m fuck: do what the fuck you want to public licen[cs]e
m wtfpl: wtfpl
[mpl-1.0]
t spdx,mpl: spdx license identifier mpl 1 0
m mozilla,1: mozilla public licen[cs]e(?: version| v)? 1 0
[mpl-1.1]
t spdx,mpl: spdx license identifier mpl 1 1
x mozilla,subject: contents of this file are subject to the mozilla public license version 1 1
m mozilla,1: mozilla public licen[cs]e(?: version| v)? 1 1
m mpl: mpl 1 1
[mpl-2.0]
t spdx,mpl: spdx license identifier mpl 2 0(?: no copyleft exception)?
x source,mozilla: this source code form is subject to the terms of the mozilla public license v 2 0
m mozilla,2: mozilla public licen[cs]e(?: version| v)? 2 0
m mpl: mpl v?2(?: 0)?
m mozilla,mpl: mozilla org mpl 2 0(?: txt)?
[mpl]
m mozilla: mozilla public licen[cs]e
[epl-1.0]
t spdx,epl: spdx license identifier epl 1 0
n eclipse,v10: eclipse org legal epl v10(?: html)?
m eclipse,1: eclipse public licen[cs]e(?: version| v)? 1 0
m epl: epl(?: v)? 1 0
[epl-2.0]
t spdx,epl: spdx license identifier epl 2 0
n eclipse,program: this program and the accompanying materials are made available under<4> eclipse public licen[cs]e
m eclipse,2: eclipse public licen[cs]e(?: version| v)? 2 0
m epl: epl(?: v)? 2 0
[epl]
m eclipse: eclipse public licen[cs]e
[edl]
m eclipse,distribution: eclipse distribution licen[cs]e(?: v 1 0)?
[cddl-1.0]
t spdx,cddl: spdx license identifier cddl 1 [01]
n development,terms: terms of the common development and distribution licen[cs]e
m development,distribution: common development and distribution licen[cs]e(?: version)?(?: 1 [01])?
m cddl: cddl(?: v)?(?: 1 [01])?
[cpl-1.0]
t spdx,cpl: spdx license identifier cpl 1 0
m common,public: common public licen[cs]e(?: version| v)?(?: 1 0)?
[cpal-1.0]
m attribution,common: common public attribution licen[cs]e(?: version)?(?: 1 0)?
[ipl-1.0]
m ibm: ibm public licen[cs]e(?: version| v)?(?: 1 0)?
[eupl]
t spdx,eupl: spdx license identifier eupl 1 [012]
n licensed,eupl: licensed under the eupl
m european,union: european union public licen[cs]e(?: version| v)?(?: 1 [012])?
m eupl: eupl(?: v)?(?: 1 [012])?
[artistic-1.0]
t spdx,artistic: spdx license identifier artistic 1 0(?: perl| cl8)?
n perl,same: under the same terms as perl itself
m artistic,1: artistic licen[cs]e(?: version)? 1 0
[artistic-2.0]
t spdx,artistic: spdx license identifier artistic 2 0
m artistic,2: artistic licen[cs]e(?: version)? 2 0
[artistic]
m artistic: artistic licen[cs]e
[psf-2.0]
t spdx,psf: spdx license identifier psf 2 0
t spdx,python: spdx license identifier python 2 0(?: 1)?
x psf,grants: psf hereby grants licensee a nonexclusive royalty free world wide license
m python: python software foundation licen[cs]e(?: version)?(?: 2)?
m psf: psf licen[cs]e
[php-3.0]
t spdx,php: spdx license identifier php 3 0(?: 1)?
m php: php licen[cs]e(?: version| v)?(?: 3 0(?: 1)?)?
[ruby]
t spdx,ruby: spdx license identifier ruby
m ruby: ruby(?: s)? licen[cs]e
n ruby,same: same terms as ruby(?: itself)?
[openssl]
t spdx,openssl: spdx license identifier openssl
x openssl,toolkit: software developed by the openssl project for use in the openssl toolkit
m openssl: openssl licen[cs]e
[ssleay]
x cryptographic,eric: this product includes cryptographic software written by eric young
[ncsa]
t spdx,ncsa: spdx license identifier ncsa
m illinois: university of illinois<2> (?:ncsa )?open source licen[cs]e
[ofl-1.1]
t spdx,ofl: spdx license identifier ofl 1 [01]
x sil,font: this font software is licensed under the sil open font license version 1 1
m sil,font: sil open font licen[cs]e(?: version)?(?: 1 [01])?
m ofl: (?:sil )?ofl(?: 1 [01])?
[ms-pl]
t spdx,pl: spdx license identifier ms pl
m microsoft,public: microsoft public licen[cs]e(?: ms pl)?
[ms-rl]
t spdx,rl: spdx license identifier ms rl
m microsoft,reciprocal: microsoft reciprocal licen[cs]e(?: ms rl)?
[afl-3.0]
t spdx,afl: spdx license identifier afl [123] [0-9]
m academic: academic free licen[cs]e(?: version| v)?(?: [123] [0-9])?
[osl-3.0]
t spdx,osl: spdx license identifier osl [123] [0-9]
m open,osl: open software licen[cs]e<2> osl(?: [123] [0-9])?
m open,software: open software licen[cs]e(?: version| v)? [123] [0-9]
[ecl-2.0]
m educational,community: educational community licen[cs]e(?: version)?(?: 2 0)?
[qpl-1.0]
m q,public: q public licen[cs]e(?: version)?(?: 1 0)?
[rpl-1.5]
m reciprocal,public: reciprocal public licen[cs]e(?: version)?(?: 1 [15])?
[sspl-1.0]
t spdx,sspl: spdx license identifier sspl 1 0
m server,side: server side public licen[cs]e(?: version| v)?(?: 1)?
m sspl: sspl
[busl-1.1]
t spdx,busl: spdx license identifier busl 1 1
m business,source: business source licen[cs]e(?: version)?(?: 1 1)?
[elastic-2.0]
m elastic: elastic licen[cs]e(?: version)?(?: 2 0)?
[commons-clause]
x commons,clause: commons clause licen[cs]e condition
m commons,clause: commons clause
[polyform]
m polyform: polyform (?:noncommercial|shield|strict|perimeter|small business|free trial|internal use) licen[cs]e(?: 1 0 0)?
[vim]
t spdx,vim: spdx license identifier vim
m vim: vim licen[cs]e
[beerware]
x beer,retain: as long as you retain this notice<20> buy me a beer
m beer,ware: beer ware licen[cs]e
m beerware: beerware(?: licen[cs]e)?
[curl]
t spdx,curl: spdx license identifier curl
[icu]
t spdx,icu: spdx license identifier icu
m icu: icu licen[cs]e
[unicode]
m unicode: unicode(?: inc)? licen[cs]e agreement(?: data files and software)?
[w3c]
t spdx,w3c: spdx license identifier w3c
m w3c: w3c software(?: notice)?(?: and)?(?: document)? licen[cs]e
[x11]
t spdx,x11: spdx license identifier x11
x consortium,advertising: name of the x consortium shall not be used in advertising
[postgresql]
t spdx,postgresql: spdx license identifier postgresql
m postgresql: postgresql licen[cs]e
[upl-1.0]
m universal,permissive: universal permissive licen[cs]e(?: version| v)?(?: 1 0)?
[mulan-psl]
m mulan: mulan (?:psl|permissive software licen[cs]e)(?: v?[12])?
[hippocratic]
m hippocratic: hippocratic licen[cs]e(?: version)?(?: [123] [0-9])?
[odbl-1.0]
t spdx,odbl: spdx license identifier odbl 1 0
m database,open: open (?:data commons open )?database licen[cs]e(?: v 1 0)?
m odbl: odbl
[odc-by-1.0]
m commons,attribution: open data commons attribution licen[cs]e(?: v 1 0)?
m odc,by: odc by(?: 1 0)?
[pddl-1.0]
m public,dedication: public domain dedication and licen[cs]e
m pddl: pddl
[ogl-uk]
n government,contains: contains public sector information licensed under the open government licen[cs]e
m government,open: open government licen[cs]e(?: v(?:ersion)? ?[123](?: 0)?)?
[cdla]
m community,data: community data licen[cs]e agreement(?: permissive| sharing)?
[cc0-1.0]
t spdx,cc0: spdx license identifier cc0 1 0
x waived,related: has waived all copyright and related or neighbou?ring rights
n zero,commons: creative commons zero(?: v1 0| 1 0)?(?: universal)?
m cc0: cc0(?: 1 0)?(?: universal)?
m cc,zero: cc zero
m creativecommons,zero: creativecommons org publicdomain zero 1 0
[cc-pdm]
m public,mark: public domain mark(?: 1 0)?
[cc-by]
m attribution,commons: creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
m creativecommons,by: creativecommons org licenses by
m cc,attribution: cc attribution
[cc-by-1.0]
m cc,by: cc by 1 0
m creativecommons,by: creativecommons org licenses by 1 0
[cc-by-2.0]
m cc,by: cc by 2 0
m creativecommons,by: creativecommons org licenses by 2 0
[cc-by-2.5]
m cc,by: cc by 2 5
m creativecommons,by: creativecommons org licenses by 2 5
[cc-by-3.0]
m cc,by: cc by 3 0
m attribution,commons: creative commons attribution 3 0(?: unported)?(?: licen[cs]e)?
m creativecommons,by: creativecommons org licenses by 3 0
[cc-by-4.0]
t spdx,by: spdx license identifier cc by 4 0
m cc,by: cc by 4 0
m attribution,commons: creative commons attribution 4 0(?: international)?(?: public)?(?: licen[cs]e)?
m creativecommons,by: creativecommons org licenses by 4 0
[cc-by-sa]
m cc,sa: cc by sa
m sharealike,commons: creative commons attribution sharealike
m share,commons: creative commons attribution share alike
m creativecommons,sa: creativecommons org licenses by sa
[cc-by-sa-2.0]
m cc,sa: cc by sa 2 0
[cc-by-sa-3.0]
m cc,sa: cc by sa 3 0
m creativecommons,sa: creativecommons org licenses by sa 3 0
m sharealike,commons: creative commons attribution sharealike 3 0(?: unported)?(?: licen[cs]e)?
[cc-by-sa-4.0]
t spdx,sa: spdx license identifier cc by sa 4 0
m cc,sa: cc by sa 4 0
m creativecommons,sa: creativecommons org licenses by sa 4 0
m sharealike,commons: creative commons attribution sharealike 4 0(?: international)?(?: licen[cs]e)?
[cc-by-nc]
m cc,nc: cc by nc
m noncommercial,commons: creative commons attribution noncommercial
m commercial,commons: creative commons attribution non commercial
m creativecommons,nc: creativecommons org licenses by nc
[cc-by-nc-2.0]
m cc,nc: cc by nc 2 0
[cc-by-nc-3.0]
m cc,nc: cc by nc 3 0
m creativecommons,nc: creativecommons org licenses by nc 3 0
[cc-by-nc-4.0]
t spdx,nc: spdx license identifier cc by nc 4 0
n licensed,nc: licensed under<2> cc by nc 4 0
m cc,nc: cc by nc 4 0
m creativecommons,nc: creativecommons org licenses by nc 4 0
m noncommercial,commons: creative commons attribution noncommercial 4 0(?: international)?(?: licen[cs]e)?
[cc-by-nd]
m cc,nd: cc by nd(?: [1-4] [05])?
m noderivs,commons: creative commons attribution noderivs
m noderivatives,commons: creative commons attribution noderivatives(?: 4 0)?(?: international)?
m creativecommons,nd: creativecommons org licenses by nd(?: [1-4] [05])?
[cc-by-nc-sa]
m cc,nc,sa: cc by nc sa
m sharealike,noncommercial: creative commons attribution noncommercial sharealike
m creativecommons,nc,sa: creativecommons org licenses by nc sa
[cc-by-nc-sa-3.0]
m cc,nc,sa: cc by nc sa 3 0
m creativecommons,nc,sa: creativecommons org licenses by nc sa 3 0
[cc-by-nc-sa-4.0]
m cc,nc,sa: cc by nc sa 4 0
m creativecommons,nc,sa: creativecommons org licenses by nc sa 4 0
m sharealike,noncommercial: creative commons attribution noncommercial sharealike 4 0(?: international)?(?: licen[cs]e)?
[cc-by-nc-nd]
m cc,nc,nd: cc by nc nd
m noncommercial,noderivs: creative commons attribution noncommercial noderivs
m noncommercial,noderivatives: creative commons attribution noncommercial noderivatives
m creativecommons,nc,nd: creativecommons org licenses by nc nd
[cc-by-nc-nd-3.0]
m cc,nc,nd: cc by nc nd 3 0
[cc-by-nc-nd-4.0]
m cc,nc,nd: cc by nc nd 4 0
m creativecommons,nc,nd: creativecommons org licenses by nc nd 4 0
[cc]
c commons,licensed: licensed under<3> creative commons licen[cs]e
c creative,commons: creative commons licen[cs]e
[public-domain]
n public,dedicated: dedicated to the public domain
n public,placed: placed in(?:to)? the public domain
n public,released: released (?:in)?to the public domain
n public,copyright: (?:no copyright|not subject to copyright|copyright expired)<8> public domain
m public,domain: (?:is|are) in the public domain
[proprietary]
x confidential,proprietary: confidential and proprietary(?: information)?
x trade: (?:contains|constitutes?)<4> trade secrets? of
n unauthorized,copying: unauthorized copying of this<4> prohibited
n unauthorized,prohibited: unauthorized (?:copying|reproduction|duplication|use|distribution)<12> prohibited
n permission,not: not be (?:copied|reproduced|redistributed|republished)<12> (?:prior|express|written)<2> permission
n permission,written: without(?: the)?(?: express| prior)+ written permission
n reproduced,part: no part of this<4> may be reproduced
n personal,only: for personal(?: and)?(?: or)?(?: non ?commercial)? use only
n internal,only: for internal use only
m proprietary: proprietary licen[cs]e
m end,user: end user licen[cs]e agreement
m eula: eula
[non-commercial]
n commercial,only: for non commercial (?:use|purposes) only
n noncommercial,only: for noncommercial (?:use|purposes) only
n commercial,prohibited: commercial use<4> (?:is )?(?:strictly )?prohibited
n academic,only: for academic(?: and (?:research|educational))? (?:use|purposes) only
n research,only: for research(?: and (?:academic|educational))? (?:use|purposes) only
[copyright]
n copyright,c: copyright c (?:19|20)[0-9][0-9](?: (?:19|20)?[0-9][0-9])?
n copyright: copyright(?: by)? (?:19|20)[0-9][0-9](?: (?:19|20)?[0-9][0-9])?
c property,respective: property of<2> respective (?:owners?|holders?)
c copyright,holder: copyright holder
[permissive-notice]
c provided,warranty: provided as is without(?: any)?(?: express or implied)? warranty
c warranty,merchantability: warranty of merchantability
c freely,redistributed: may be freely redistributed
[unknown-reference]
c licensed,license: licensed under the<6> license
c licensed,licence: licensed under the<6> licence
c released,license: released under the<6> license
c license,terms: (?:see|read) the license<4> terms
c license,file: (?:see|in) the license file
c copying,file: see(?: the)?(?: file)? copying<2> file
c spdx: spdx license identifier
"""

#: Fixed by the operator's contract: phrase and label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
