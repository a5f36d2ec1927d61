"""The signatures of license scans: what grants, notices, headers, openings and addresses of licenses say, by hand.

Patterns are over words: small letters, one space between words, no punctuation. A row is (label, keyword, pattern,
priority, confidence); the keyword stands in every text that the pattern matches, and so does one of STEMS. Priority 0
is a machine-readable tag, 1 a grant, a whole notice or an address, 2 a mention. Names come in three forms beside that.
"""

from __future__ import annotations

import re

#: A document without any of these in lower case can't match a signature: every signature holds one of them.
STEMS = ("licen", "under", "spdx", "cc", "creative", "domain", "permission", "redistribut", "warrant", "copyleft", "mozilla", "dealings", "syscall", "software", "unauthorized")

#: What is looked for in a text's words before any keyword: a rule belongs to the first one that all its matches hold.
KIN = ("spdx", "syscall", "mozilla", "copyleft", "dealings", "creative", "warrant", "permission", "redistribut", "domain", "licen", "unauthorized", "software", "ed under", "available under", "cc by", "cc0", "under", "cc")

BASE = (
    ("mit", "under the mit license", "mit"),
    ("apache-2", "apache license version 2", "apache"),
    ("cc-by-nc", "cc by nc", "cc"),
)

#: Texts that licenses and their customary notices are made of.
SIGNATURES = (
    # MIT and its kin
    ("mit", "obtaining", "permission is hereby granted free of charge to any person obtaining a copy", 1, 0.9),
    ("mit", "obtaining", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1, 0.95),
    ("mit", "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 1, 0.9),
    ("mit", "sublicense", "to use copy modify merge publish distribute sublicense and or sell copies of the software", 1, 0.85),
    ("mit", "merchantability", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 1, 0.7),
    ("mit", "mit", "use of this source code is governed by an? mit(?: style)? license", 1, 0.95),
    ("mit", "mit", "(?:may be freely distributed|freely distributable) under the(?: terms of the)? mit license", 1, 0.95),
    ("mit", "mit", "(?:dual|double) licensed under(?: the)? mit(?: license)? (?:and|or)", 1, 0.9),
    ("mit", "opensource", "opensource org licenses? mit(?: license)?(?: php| html)?", 1, 0.95),
    ("mit", "license", "mit license copyright c", 1, 0.95),
    ("mit-0", "furnished", "to permit persons to whom the software is furnished to do so the software is provided as is without warranty", 1, 0.9),
    ("mit-0", "attribution", "mit no attribution license", 1, 0.95),
    ("x11", "consortium", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from the x consortium", 1, 0.9),
    ("x11", "advertising", "except as contained in this notice the names? of (?:[^ ]+ ){1,12}shall not be used in advertising or otherwise to promote the sale use or other dealings in (?:this|the) software without prior written (?:authorization|permission)", 1, 0.85),
    ("hpnd", "supporting", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appears? in all copies and that both that copyright notice and this permission notice appear in supporting documentation", 1, 0.9),
    ("ntp", "fee", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice", 1, 0.85),
    ("icu", "supporting", "provided that the above copyright notice s and this permission notice appear in all copies of the software and that both the above copyright notice s and this permission notice appear in supporting documentation", 1, 0.9),
    ("curl", "dealings", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is without warranty of any kind express or implied including (?:[^ ]+ ){1,40}dealings in the software", 1, 0.85),
    # Apache
    ("apache-2", "compliance", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 1, 1.0),
    ("apache-2", "compliance", "you may not use this file except in compliance with the license you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses license 2 0", 1, 0.95),
    ("apache-2", "contributor", "licensed to the apache software foundation asf under one or more contributor license agreements", 1, 0.95),
    ("apache-2", "basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 1, 0.8),
    ("apache-2", "january", "apache license version 2 0 january 2004", 1, 1.0),
    ("apache-2", "reproduction", "terms and conditions for use reproduction and distribution 1 definitions license shall mean", 1, 0.95),
    ("apache-2", "perpetual", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated in this section patent) license", 1, 0.85),
    ("apache-2", "apache", "apache org licenses license 2 0(?: txt| html)?", 1, 0.95),
    ("apache-2", "apache", "opensource org licenses? apache 2 0", 1, 0.95),
    ("apache-2", "apache", "use of this source code is governed by (?:an|the) apache(?: 2 0)? license", 1, 0.9),
    ("apache-1.1", "apache", "apache org licenses license 1 1", 1, 0.95),
    ("apache-1.1", "acknowledgment", "the end user documentation included with the redistribution if any must include the following acknowledgment", 1, 0.85),
    ("apache-1.1", "apache", "the apache software license version 1 1 copyright", 1, 1.0),
    ("apache-1.0", "apache", "apache org licenses license 1 0", 1, 0.95),
    # GNU General Public License
    ("gpl-3.0", "redistribute", "(?:you can|you may) redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3", 1, 1.0),
    ("gpl-2.0", "redistribute", "(?:you can|you may) redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2", 1, 1.0),
    ("gpl-1.0", "redistribute", "(?:you can|you may) redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 1", 1, 1.0),
    ("gpl-3.0", "redistribute", "(?:you can|you may) redistribute it and or modify it under the terms of the gnu general public license(?: version 3)? as published by the free software foundation version 3", 1, 1.0),
    ("gpl-2.0", "redistribute", "(?:you can|you may) redistribute it and or modify it under the terms of the gnu general public license(?: version 2)? as published by the free software foundation version 2", 1, 1.0),
    ("gpl-2.0", "general", "under the terms of version 2 of the gnu general public license", 1, 1.0),
    ("gpl-3.0", "general", "under the terms of version 3 of the gnu general public license", 1, 1.0),
    ("gpl", "general", "under the terms of the gnu general public license", 1, 0.8),
    ("gpl", "received", "you should have received a copy of the gnu general public license along with this (?:program|file|package|software|work)", 1, 0.8),
    ("gpl", "purpose", "this (?:program|software) is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", 1, 0.8),
    ("gpl-3.0", "june", "gnu general public license version 3 29 june 2007", 1, 1.0),
    ("gpl-2.0", "june", "gnu general public license version 2 june 1991", 1, 1.0),
    ("gpl-1.0", "february", "gnu general public license version 1 february 1989", 1, 1.0),
    ("gpl-3.0", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works", 1, 0.95),
    ("gpl-2.0", "freedom", "the licenses for most software are designed to take away your freedom to share and change it", 1, 0.9),
    ("gpl-3.0", "gnu", "gnu org licenses gpl 3 0(?: html| txt| en html)?", 1, 0.95),
    ("gpl-2.0", "gnu", "gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt| en html)?", 1, 0.95),
    ("gpl-1.0", "gnu", "gnu org licenses (?:old licenses )?gpl 1 0(?: html| txt| en html)?", 1, 0.95),
    ("gpl", "gnu", "gnu org licenses gpl(?: html| txt)?", 1, 0.7),
    ("gpl", "free", "this is free software see the source for copying conditions there is no warranty", 1, 0.6),
    ("gpl", "gpl", "released under(?: the)? gpl", 1, 0.8),
    ("gpl", "copyleft", "copyleft licen[cs]e", 2, 0.5),
    ("gpl-exception-linux-syscall", "syscall", "gpl 2 0(?: only| or later)? with linux syscall note", 0, 1.0),
    ("gpl-exception-classpath", "independent", "as a special exception the copyright holders of this library give you permission to link this library with independent modules to produce an executable", 1, 0.95),
    ("gpl-exception-classpath", "classpath", "licensed under the gnu general public license (?:[^ ]+ ){0,8}with (?:the )?classpath exception", 1, 0.95),
    ("gpl-exception-gcc", "runtime", "gcc runtime library exception(?: version 3 1)?(?: to the gnu general public license| 31 march 2009)? (?:as published|copyright|license|under)", 1, 0.9),
    ("gpl-exception-autoconf", "configuration", "as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script generated by autoconf", 1, 0.95),
    ("gpl-exception-openssl", "openssl", "permission to link the code of (?:portions of )?this program with (?:any version of )?the openssl (?:project s )?library", 1, 0.9),
    ("gpl-exception-bison", "skeleton", "you may create a larger work that contains part or all of the bison parser skeleton and distribute that work under terms of your choice", 1, 0.95),
    ("gpl-exception-font", "embed", "as a special exception if you create a document which uses this font and embed this font or unaltered portions of this font into the document this font does not by itself cause the resulting document to be covered by the gnu general public license", 1, 0.95),
    # GNU Lesser and Library
    ("lgpl-3.0", "lesser", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3", 1, 1.0),
    ("lgpl-2.1", "lesser", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1", 1, 1.0),
    ("lgpl-2.1", "lesser", "redistribute it and or modify it under the terms of the gnu lesser general public license version 2 1 as published by the free software foundation", 1, 1.0),
    ("lgpl-2.0", "library", "redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2", 1, 1.0),
    ("lgpl", "lesser", "you should have received a copy of the gnu lesser general public license along with this (?:library|program|software|package)", 1, 0.8),
    ("lgpl-2.0", "library", "you should have received a copy of the gnu library general public license along with this (?:library|program)", 1, 0.9),
    ("lgpl-2.1", "february", "gnu lesser general public license version 2 1 february 1999", 1, 1.0),
    ("lgpl-3.0", "june", "gnu lesser general public license version 3 29 june 2007", 1, 1.0),
    ("lgpl-2.0", "june", "gnu library general public license version 2 june 1991", 1, 1.0),
    ("lgpl-3.0", "gnu", "gnu org licenses lgpl 3 0(?: html| txt| en html)?", 1, 0.95),
    ("lgpl-2.1", "gnu", "gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt| en html)?", 1, 0.95),
    ("lgpl", "gnu", "gnu org licenses lgpl(?: html| txt)?", 1, 0.7),
    ("lgpl", "lgpl", "released under(?: the)? lgpl", 1, 0.8),
    # GNU Affero
    ("agpl-3.0", "affero", "redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3", 1, 1.0),
    ("agpl-3.0", "affero", "under the terms of the gnu affero general public license version 3", 1, 1.0),
    ("agpl", "affero", "you should have received a copy of the gnu affero general public license along with this program", 1, 0.8),
    ("agpl-3.0", "november", "gnu affero general public license version 3 19 november 2007", 1, 1.0),
    ("agpl-1.0", "march", "affero general public license version 1 march 2002", 1, 1.0),
    ("agpl-3.0", "gnu", "gnu org licenses agpl 3 0(?: html| txt| en html)?", 1, 0.95),
    ("agpl", "agpl", "released under(?: the)? agpl", 1, 0.8),
    # GNU Free Documentation
    ("gfdl-1.3", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3", 1, 1.0),
    ("gfdl-1.2", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2", 1, 1.0),
    ("gfdl-1.1", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 1", 1, 1.0),
    ("gfdl-1.3", "november", "gnu free documentation license version 1 3 3 november 2008", 1, 1.0),
    ("gfdl-1.2", "november", "gnu free documentation license version 1 2 november 2002", 1, 1.0),
    ("gfdl-1.1", "march", "gnu free documentation license version 1 1 march 2000", 1, 1.0),
    ("gfdl", "gnu", "gnu org licenses fdl(?: 1 3)?(?: html| txt)?", 1, 0.8),
    ("gfdl", "documentation", "available under the(?: terms of the)? gnu free documentation license", 1, 0.85),
    # BSD and what comes from it
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification", 1, 0.8),
    ("bsd", "permitted", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 1, 0.85),
    ("bsd", "retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 1, 0.8),
    ("bsd", "reproduce", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", 1, 0.8),
    ("bsd", "implied", "this software is provided by the (?:copyright holders?|regents|authors?)(?: and contributors)? as is and any express or implied warranties", 1, 0.7),
    ("bsd-3-clause", "endorse", "neither the names? of (?:[^ ]+ ){1,12}may be used to endorse or promote products derived from this software without specific prior written permission", 1, 0.95),
    ("bsd-3-clause", "endorse", "the name of the (?:author|copyright holder|company|university) may not be used to endorse or promote products derived from this software without specific prior written permission", 1, 0.9),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1, 0.9),
    ("bsd-2-clause-views", "policies", "the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies", 1, 0.85),
    ("bsd-3-clause", "opensource", "opensource org licenses? bsd 3 clause", 1, 0.95),
    ("bsd-2-clause", "opensource", "opensource org licenses? bsd 2 clause", 1, 0.95),
    ("bsd", "opensource", "opensource org licenses? bsd license(?: php)?", 1, 0.85),
    ("bsd", "bsd", "use of this source code is governed by an? bsd(?: style)? license", 1, 0.95),
    ("bsd", "bsd", "(?:is|are) bsd licensed|under an? bsd style license", 1, 0.8),
    ("bsd-3-clause-clear", "patent", "no express or implied licenses to any party s patent rights are granted by this license", 1, 0.9),
    ("bsd-3-clause-lbnl", "enhancements", "you are under no obligation whatsoever to provide any bug fixes patches or upgrades to the features functionality or performance of the source code enhancements", 1, 0.9),
    ("bsd-patent", "patent", "subject to the terms and conditions of this license each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide non exclusive no charge royalty free irrevocable except for failure to satisfy the conditions of this license patent license", 1, 0.95),
    ("isc", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 1, 0.95),
    ("isc", "fee", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 1, 0.9),
    ("isc", "purpose", "permission to use copy modify and or distribute this software for any purpose", 1, 0.8),
    ("0bsd", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", 1, 0.95),
    ("isc", "opensource", "opensource org licenses? isc(?: license)?(?: txt)?", 1, 0.95),
    # Mozilla, Eclipse and other file-level licenses
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0", 1, 1.0),
    ("mpl-2.0", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at (?:https? )?(?:www )?mozilla org mpl 2 0", 1, 0.95),
    ("mpl-2.0", "mozilla", "mozilla org (?:en us )?mpl 2 0", 1, 0.9),
    ("mpl-1.1", "mozilla", "mozilla org (?:en us )?mpl (?:mpl )?1 1(?: html| txt)?", 1, 0.9),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1", 1, 1.0),
    ("mpl-1.0", "mozilla", "the contents of this file are subject to the mozilla public license version 1 0", 1, 1.0),
    ("mpl-2.0", "definitions", "mozilla public license version 2 0 1 definitions", 1, 1.0),
    ("mpl-2.0-no-copyleft-exception", "incompatible", "this source code form is incompatible with secondary licenses as defined by the mozilla public license", 1, 0.95),
    ("gpl", "alternatively", "alternatively the contents of this file may be used under the terms of (?:either )?the gnu general public license", 1, 0.85),
    ("npl-1.1", "netscape", "the contents of this file are subject to the netscape public license version 1 1", 1, 1.0),
    ("npl-1.0", "netscape", "the contents of this file are subject to the netscape public license version 1 0", 1, 1.0),
    ("epl-2.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v|version) ?2 0", 1, 1.0),
    ("epl-1.0", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v|version) ?1 0", 1, 1.0),
    ("epl-2.0", "eclipse", "eclipse public license v 2 0 the accompanying program is provided under the terms", 1, 1.0),
    ("epl-1.0", "eclipse", "eclipse public license v 1 0 the accompanying program is provided under the terms", 1, 1.0),
    ("epl-2.0", "secondary", "this source code may also be made available under the following secondary licenses when the conditions for such availability set forth in the eclipse public license v 2 0 are satisfied", 1, 1.0),
    ("edl-1.0", "eclipse", "made available under the terms of the eclipse distribution license (?:v|version) ?1 0", 1, 1.0),
    ("cddl-1.0", "cddl", "common development and distribution license cddl version 1 0", 1, 1.0),
    ("cddl-1.1", "cddl", "common development and distribution license cddl version 1 1", 1, 1.0),
    ("cddl", "common", "the contents of this file are subject to the terms of the common development and distribution license", 1, 0.9),
    ("cpl-1.0", "common", "the accompanying program is provided under the terms of this common public license", 1, 0.95),
    ("ipl-1.0", "ibm", "the accompanying program is provided under the terms of this ibm public license", 1, 0.95),
    ("ms-pl", "microsoft", "this license governs use of the accompanying software (?:[^ ]+ ){1,30}microsoft public license", 1, 0.9),
    ("ms-pl", "microsoft", "this source is subject to the microsoft public license", 1, 0.95),
    ("ms-rl", "microsoft", "this source is subject to the microsoft reciprocal license", 1, 0.95),
    ("sleepycat", "redistributions", "redistributions in any form must be accompanied by information on how to obtain complete source code", 1, 0.9),
    ("openssl", "openssl", "redistributions of any form whatsoever must retain the following acknowledg?ment this product includes software developed by the openssl project", 1, 0.95),
    ("ssleay", "eric", "this product includes cryptographic software written by eric young", 1, 0.9),
    # short permissive ones
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", 1, 0.9),
    ("zlib", "implied", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", 1, 0.85),
    ("zlib", "permission", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", 1, 0.95),
    ("libpng-2.0", "png", "png reference library license version 2", 1, 1.0),
    ("libpng", "png", "this code is released under the libpng license", 1, 1.0),
    ("bsl-1.0", "boost", "distributed under the boost software license version 1 0", 1, 1.0),
    ("bsl-1.0", "boost", "boost org license 1 0(?: txt)?", 1, 0.95),
    ("bsl-1.0", "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 1, 0.95),
    ("wtfpl", "wtf", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed (?:[^ ]+ ){0,10}wtf(?:pl)?", 1, 0.9),
    ("wtfpl", "want", "do what the f[^ ]{1,5} you want to public license", 1, 1.0),
    ("beerware", "beer", "the beer ware license(?: revision 42)?", 1, 1.0),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 1, 1.0),
    ("unlicense", "unlicense", "unlicense org(?: unlicense)?", 1, 0.9),
    ("afl-3.0", "academic", "licensed under the academic free license version 3 0", 1, 1.0),
    ("afl-2.1", "academic", "licensed under the academic free license version 2 1", 1, 1.0),
    ("osl-3.0", "open", "licensed under the open software license version 3 0", 1, 1.0),
    ("osl-2.1", "open", "licensed under the open software license version 2 1", 1, 1.0),
    ("artistic-2.0", "artistic", "the artistic license 2 0 copyright c 2000 2006 the perl foundation", 1, 1.0),
    ("artistic-1.0", "artistic", "the artistic license preamble the intent of this document is to state the conditions under which a package may be copied", 1, 1.0),
    ("perl", "perl", "this (?:library|program|module|software|package) is free software you can redistribute it and or modify it under the same terms as perl itself", 1, 1.0),
    ("ruby", "ruby", "ruby is copyrighted free software by yukihiro matsumoto", 1, 0.9),
    ("psf-2.0", "psf", "psf license agreement for python|psf hereby grants licensee a nonexclusive royalty free world wide license", 1, 0.95),
    ("python-2.0", "python", "python software foundation license version 2", 1, 1.0),
    ("php-3.01", "php", "this source file is subject to version 3 01 of the php license", 1, 1.0),
    ("php-3.0", "php", "this source file is subject to version 3 0 of the php license", 1, 1.0),
    ("zpl-2.1", "zope", "subject to the provisions of the zope public license version 2 1", 1, 1.0),
    ("zpl-2.0", "zope", "subject to the provisions of the zope public license version 2 0", 1, 1.0),
    ("postgresql", "agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 1, 0.95),
    ("ncsa", "permission", "to deal with the software without restriction including without limitation the rights (?:[^ ]+ ){1,40}permission", 1, 0.85),
    ("tcl", "authors", "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose", 1, 0.95),
    ("vim", "vim", "the vim license applies to|vim is charityware (?:[^ ]+ ){0,20}licen[cs]e", 1, 0.9),
    ("w3c", "w3c", "w3c software notice and license|w3c software and document license", 1, 1.0),
    ("unicode", "unicode", "unicode inc license agreement data files and software", 1, 1.0),
    ("ijg", "independent", "permission is hereby granted to use copy modify and distribute this software or portions thereof for any purpose without fee subject to these conditions (?:[^ ]+ ){0,60}independent jpeg group", 1, 0.95),
    ("json", "evil", "the software shall be used for good not evil", 1, 0.95),
    ("cecill-2.1", "cecill", "this software is governed by the cecill license under french law", 1, 0.95),
    ("cecill-b", "cecill", "this software is governed by the cecill b license under french law", 1, 1.0),
    ("cecill-c", "cecill", "this software is governed by the cecill c license under french law", 1, 1.0),
    ("eupl-1.2", "eupl", "licensed under the eupl(?: version| v)? 1 2", 1, 1.0),
    ("eupl-1.1", "eupl", "licensed under the eupl(?: version| v)? 1 1", 1, 1.0),
    ("upl-1.0", "universal", "the universal permissive license upl version 1 0", 1, 1.0),
    ("blueoak-1.0.0", "oak", "blue oak model license(?: version)? 1 0 0", 1, 1.0),
    ("qpl-1.0", "public", "the q public license version 1 0", 1, 1.0),
    ("mulan-psl-2.0", "mulan", "you can use this software according to the terms and conditions of the mulan psl v2 (?:[^ ]+ ){0,20}licen[cs]e", 1, 0.95),
    # restrictive and source-available ones
    ("sspl-1.0", "server", "redistribute it and or modify it under the terms of the server side public license version 1", 1, 1.0),
    ("elastic-2.0", "elastic", "licensed under the elastic license 2 0", 1, 1.0),
    ("elastic-1.0", "elastic", "licensed under the elastic license(?: agreement)? (?:1 0|you may not use)", 1, 0.9),
    ("busl-1.1", "business", "business source license 1 1 parameters licensor", 1, 1.0),
    ("busl-1.1", "licensor", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", 1, 0.95),
    ("commons-clause", "commons", "commons clause license condition v1 0", 1, 1.0),
    ("commons-clause", "sell", "the grant of rights under the license will not include and the license does not grant to you the right to sell the software", 1, 0.95),
    ("polyform-nc-1.0", "polyform", "polyform noncommercial license 1 0 0", 1, 1.0),
    ("polyform-sb-1.0", "polyform", "polyform small business license 1 0 0", 1, 1.0),
    ("confluent-1.0", "confluent", "licensed under the confluent community license", 1, 1.0),
    ("timescale", "timescale", "licensed under the timescale license", 1, 1.0),
    ("openrail", "responsible", "responsible ai license|open responsible ai license", 1, 0.9),
    ("openrail", "referenced", "use restrictions as referenced in paragraph 5 (?:[^ ]+ ){0,20}licen[cs]e", 1, 0.8),
    ("llama-2", "llama", "llama 2 community license(?: agreement)?", 1, 1.0),
    ("llama-3", "llama", "(?:meta )?llama 3(?: [123])? community license(?: agreement)?", 1, 1.0),
    ("gemma", "gemma", "use of gemma is subject to the gemma terms of use (?:[^ ]+ ){0,20}licen[cs]e|gemma license", 1, 0.8),
    ("proprietary", "proprietary", "proprietary(?: and confidential)? licen[cs]e", 2, 0.6),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|reproduction|distribution)(?: or distribution)? of this (?:file|software|material|document) via any medium is strictly prohibited", 1, 0.85),
    ("proprietary", "reserved", "all rights reserved no part of this (?:publication|work|book|document|software) may be reproduced (?:[^ ]+ ){0,30}permission", 1, 0.85),
    ("proprietary", "sold", "this software is licensed not sold|the software is licensed not sold", 1, 0.8),
    ("proprietary", "agreement", "end user license agreement", 2, 0.6),
    # documents, data and fonts
    ("cc0-1.0", "deed", "the person who associated a work with this deed has dedicated the work to the public domain", 1, 0.95),
    ("cc0-1.0", "waived", "to the extent possible under law (?:[^ ]+ ){1,12}waived all copyright and related or neighboring rights", 1, 0.9),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0", 1, 0.95),
    ("cc0-1.0", "cc0", "(?:dedicated|released|waived)(?: to the public domain)? under(?: the)? cc0", 1, 0.95),
    ("public-domain", "creativecommons", "creativecommons org publicdomain mark 1 0", 1, 0.95),
    ("cc-by", "creative", "under (?:a|the) creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)? licen[cs]e", 1, 0.9),
    ("cc-by-sa", "creative", "under (?:a|the) creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)? licen[cs]e", 1, 0.95),
    ("cc-by-nd", "creative", "under (?:a|the) creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported| generic)? licen[cs]e", 1, 0.95),
    ("cc-by-nc", "creative", "under (?:a|the) creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)? licen[cs]e", 1, 0.95),
    ("cc-by-nc-sa", "creative", "under (?:a|the) creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)? licen[cs]e", 1, 0.95),
    ("cc-by-nc-nd", "creative", "under (?:a|the) creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported| generic)? licen[cs]e", 1, 0.95),
    ("cc-by", "creativecommons", "creativecommons org licenses by [1-4] [05]", 1, 0.95),
    ("cc-by-sa", "creativecommons", "creativecommons org licenses by sa [1-4] [05]", 1, 0.95),
    ("cc-by-nd", "creativecommons", "creativecommons org licenses by nd [1-4] [05]", 1, 0.95),
    ("cc-by-nc", "creativecommons", "creativecommons org licenses by nc [1-4] [05]", 1, 0.95),
    ("cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa [1-4] [05]", 1, 0.95),
    ("cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd [1-4] [05]", 1, 0.95),
    ("cc-by", "creative", "you are free to share copy and redistribute the material in any medium or format (?:[^ ]+ ){0,40}creative commons", 1, 0.7),
    ("cc-by", "cc", "licensed under cc by(?: [1-4] [05])?", 1, 0.9),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license version 1 1", 1, 1.0),
    ("ofl-1.1", "font", "this license is copied below and is also available with a faq at (?:https? )?scripts sil org ofl (?:[^ ]+ ){0,12}font", 1, 0.95),
    ("ufl-1.0", "ubuntu", "ubuntu font licen[cs]e version 1 0", 1, 1.0),
    ("odbl-1.0", "database", "(?:is|are) made available under the open database license", 1, 0.95),
    ("odbl-1.0", "opendatacommons", "opendatacommons org licenses odbl(?: 1 0)?", 1, 0.95),
    ("odc-by-1.0", "opendatacommons", "opendatacommons org licenses by(?: 1 0)?", 1, 0.95),
    ("pddl-1.0", "opendatacommons", "opendatacommons org licenses pddl(?: 1 0)?", 1, 0.95),
    ("cdla-permissive-2.0", "community", "community data license agreement permissive(?: version)? 2 0", 1, 1.0),
    ("cdla-permissive-1.0", "community", "community data license agreement permissive(?: version)? 1 0", 1, 1.0),
    ("cdla-sharing-1.0", "community", "community data license agreement sharing(?: version)? 1 0", 1, 1.0),
    ("ogl-uk-3.0", "government", "(?:contains public sector information )?licensed under the open government licen[cs]e v3 0", 1, 1.0),
    ("ogl-uk-2.0", "government", "(?:contains public sector information )?licensed under the open government licen[cs]e v2 0", 1, 1.0),
    ("etalab-2.0", "etalab", "licence ouverte(?: open licence)? etalab(?: 2 0)?|etalab open licence", 1, 0.9),
    ("dl-de-by-2.0", "datenlizenz", "datenlizenz deutschland namensnennung(?: version)? 2 0 (?:[^ ]+ ){0,12}licen[cs]e", 1, 0.9),
    ("public-domain", "domain", "(?:released|placed|dedicated|put)(?: in)?(?: to| into)? the public domain", 1, 0.9),
    ("public-domain", "domain", "this work (?:has been|is) (?:identified|marked) as being free of known restrictions under copyright law (?:[^ ]+ ){0,30}public domain", 1, 0.9),
    ("public-domain", "domain", "(?:is|are) (?:in )?(?:the )?public domain", 2, 0.7),
)

#: label, keywords of which every alternative of the name holds one, name in running text, words of the short identifier
NAMES = (
    ("mit", "mit|expat", "mit|expat|mit expat|mit x11", "mit"),
    ("mit-0", "mit", "mit no attribution|mit 0", "mit 0"),
    ("apache-2", "apache|asl", "apache(?: software)?(?: license)?(?: version)? 2(?: 0)?|asl 2 0", "apache 2 0"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version)? 1 1", "apache 1 1"),
    ("apache-1.0", "apache", "apache(?: software)?(?: license)?(?: version)? 1 0", "apache 1 0"),
    ("gpl-3.0", "general", "(?:gnu )?general public license(?: version)?(?: v)? ?3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl-2.0", "general", "(?:gnu )?general public license(?: version)?(?: v)? ?2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-1.0", "general", "(?:gnu )?general public license(?: version)?(?: v)? ?1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl(?: version)? ?v?3(?: 0)?", "gplv3"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl(?: version)? ?v?2(?: 0)?", "gplv2"),
    ("gpl", "general", "gnu general public license", "gpl"),
    ("lgpl-3.0", "lesser", "(?:gnu )?lesser general public license(?: version)?(?: v)? ?3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser", "(?:gnu )?lesser general public license(?: version)?(?: v)? ?2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-2.0", "library", "(?:gnu )?library general public license(?: version)?(?: v)? ?2(?: 0)?", "lgpl 2 0(?: only| or later)?"),
    ("lgpl", "lesser", "gnu lesser general public license", "lgpl"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public license(?: version)?(?: v)? ?3(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("agpl", "affero", "gnu affero general public license", "agpl"),
    ("gfdl-1.3", "documentation", "(?:gnu )?free documentation license(?: version)? 1 3", "gfdl 1 3(?: only| or later)?"),
    ("bsd-2-clause", "bsd", "bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "bsd 4 clause|4 clause bsd|original bsd|old bsd", "bsd 4 clause"),
    ("0bsd", "bsd", "0bsd|zero clause bsd|bsd zero clause", "0bsd"),
    ("bsd", "bsd", "bsd", "bsd"),
    ("isc", "isc|internet systems", "isc|internet systems consortium", "isc"),
    ("mpl-2.0", "mozilla", "mozilla public license(?: version)?(?: v)? 2(?: 0)?", "mpl 2 0"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: version)?(?: v)? 1 1", "mpl 1 1"),
    ("epl-2.0", "eclipse", "eclipse public license(?: version)?(?: v)? 2(?: 0)?", "epl 2 0"),
    ("epl-1.0", "eclipse", "eclipse public license(?: version)?(?: v)? 1(?: 0)?", "epl 1 0"),
    ("cddl-1.0", "development", "common development and distribution license(?: version)? 1 0", "cddl 1 0"),
    ("artistic-2.0", "artistic", "artistic(?: license)?(?: version)? 2(?: 0)?", "artistic 2 0"),
    ("bsl-1.0", "boost", "boost(?: software)?(?: license)?(?: version)? 1(?: 0)?", "bsl 1 0"),
    ("busl-1.1", "business", "business source license(?: version)?(?: 1 1)?", "busl 1 1"),
    ("zlib", "zlib", "zlib|zlib libpng", "zlib"),
    ("libpng", "libpng", "libpng", "libpng(?: 2 0)?"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("afl-3.0", "academic", "academic free license(?: version)?(?: v)? ?3(?: 0)?", "afl 3 0"),
    ("osl-3.0", "open", "open software license(?: version)?(?: v)? ?3(?: 0)?", "osl 3 0"),
    ("eupl-1.2", "european", "european union public licen[cs]e(?: version)?(?: v)?(?: 1 2)?", "eupl 1 2"),
    ("ms-pl", "microsoft", "microsoft public license", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal license", "ms rl"),
    ("ncsa", "ncsa", "university of illinois ncsa(?: open source)?|ncsa(?: open source)?", "ncsa"),
    ("python-2.0", "python|psf", "python software foundation|psf|python(?: license)? 2(?: 0)?", "python 2 0|psf 2 0"),
    ("ruby", "ruby", "ruby", "ruby"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl", "openssl"),
    ("ofl-1.1", "font", "(?:sil )?open font license(?: version)?(?: 1 1)?", "ofl 1 1"),
    ("odbl-1.0", "database", "open database license(?: version)?(?: v)?(?: 1 0)?", "odbl 1 0"),
    ("odc-by-1.0", "commons", "open data commons attribution license(?: version)?(?: 1 0)?", "odc by 1 0"),
    ("cecill-2.1", "cecill", "cecill(?: version)?(?: 2 1)?", "cecill 2 1"),
    ("upl-1.0", "universal", "universal permissive license(?: version)?(?: 1 0)?", "upl 1 0"),
    ("mulan-psl-2.0", "mulan", "mulan psl(?: v2)?|mulan permissive software license(?: version)? 2", "mulanpsl 2 0"),
    ("openrail", "rail", "(?:creativeml )?open ?rail(?: m)?", "openrail"),
    ("sspl-1.0", "server", "server side public license(?: version)?(?: v)?(?: 1)?", "sspl 1 0"),
    ("elastic-2.0", "elastic", "elastic license(?: version)?(?: v)? ?2(?: 0)?", "elastic 2 0"),
    ("polyform-nc-1.0", "polyform", "polyform noncommercial(?: license)?(?: 1 0 0)?", "polyform noncommercial 1 0 0"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    *(
        (f"cc-{code.replace(' ', '-')}-{v}.0", "cc", f"cc {code} {v} 0", f"cc {code} {v} 0")
        for code in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
        for v in (1, 2, 3, 4)
    ),
)

#: form, priority, confidence; NAME and ID stand for the two columns above
FORMS = (
    ("spdx license identifier (?:ID)", 0, 1.0),
    ("(?:licens|releas|distribut|publish|provid|offer|cover|govern)ed under(?: the)?(?: terms of)?(?: the)? (?:NAME)(?: licen[cs]e)?", 1, 0.95),
    ("available under(?: the)?(?: terms of)?(?: the)? (?:NAME)(?: licen[cs]e)?", 1, 0.95),
    ("(?:NAME) licen[cs]e(?:d)?|licen[cs]e (?:NAME)", 2, 0.8),
    ("licen[cs]e (?:ID)", 2, 0.8),
)


def fixed(pattern: str) -> list[list[str]]:
    """For each alternative of a pattern, the pieces of text that every match of it holds: what stands outside of groups,
    classes and what is optional. No pattern has groups in groups' place of a whole alternative."""
    out, held, depth, i = [[]], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[":
            i = pattern.index("]", i)
            c = "]"
        if c in "(":
            depth += 1
        if depth or c in "]{}?*+|.":
            if c in "?*{" and not depth:  # the sign before is optional
                held = held[:-1]
            if held:
                out[-1].append(held)
            held = ""
            if c == "|" and not depth:
                out.append([])
            if c == "{" and not depth:
                i = pattern.index("}", i)
        else:
            held += c
        if c == ")":
            depth -= 1
        i += 1
    if held:
        out[-1].append(held)
    return out


def kin(pattern: str) -> str:
    """The first of KIN that every match of a pattern holds."""
    return next(k for k in KIN if all(any(k in piece for piece in pieces) for pieces in fixed(pattern)))


#: Where a name or an identifier, whose groups hold no groups, has another alternative.
ALTERNATIVE = r"\|(?![^(]*\))"


def piece(pattern: str) -> str:
    """The longest piece of text that every match of a pattern holds; empty for one with alternatives."""
    whole = fixed(pattern)
    return max((p.strip() for p in whole[0]), key=len, default="") if len(whole) == 1 else ""


def named() -> list[tuple[str, str, str, int, float]]:
    """Every name in every form; one row for each keyword, with the alternatives that hold it, or for each identifier."""
    out = []
    for form, priority, score in FORMS:
        for label, keyword, name, short in NAMES:
            if "ID" in form:
                out += [(label, piece(one), form.replace("ID", one), priority, score) for one in re.split(ALTERNATIVE, short)]
                continue
            left = re.split(ALTERNATIVE, name)
            for key in keyword.split("|"):
                some = [x for x in left if key in x]
                left = [x for x in left if key not in x]
                out.append((label, key, form.replace("NAME", "|".join(some)), priority, score))
    return out
