"""License scans: ordered signature rules.

Texts are reduced to lower-case words. Rules are regular expressions over the words: signatures written by hand, and
the forms in which a licence's name or tag stands in a notice. Each has a label, a priority and keywords, of which all
that it matches contains one, and only rules with a keyword that the text contains run (one pass of an Aho-Corasick
automaton finds the keywords). Of overlapping detections one that lies inside another
stays only if it has the higher priority; of equal spans the higher priority, then the earlier rule, wins.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that every scan reports, wherever their words stand consecutively, and their labels.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label, keyword, expression for the name, tag (as in a machine-readable identifier).
FAMILIES = (
    ("mit", "mit|expat", r"mit(?: expat)?|expat", r"mit(?: 0)?"),
    ("apache-1", "apache", r"apache(?: software)? license(?: version| v)? 1(?: [01])?", r"apache 1(?: [01])?"),
    ("apache-2", "apache", r"apache(?: software)?(?: public)? license(?: version| v)? ?2(?: 0)?|apache 2(?: 0)?", r"apache 2(?: 0)?"),
    ("bsd-2", "bsd", r"(?:simplified|2 clause|two clause|freebsd) bsd|bsd 2(?: clause)?", r"bsd 2 clause(?: \w+)?"),
    ("bsd-3", "bsd", r"(?:new|modified|revised|3 clause|three clause) bsd|bsd 3(?: clause)?", r"bsd 3 clause(?: \w+)?"),
    ("bsd-4", "bsd", r"(?:original|old|4 clause|four clause) bsd|bsd 4(?: clause)?", r"bsd 4 clause"),
    ("bsd-0", "bsd|0bsd", r"(?:zero clause|0 clause) bsd", r"0bsd"),
    ("gpl-1", "gpl|gpl1|general public", r"(?:gnu )?(?:gpl|general public license)(?: version| v)? ?1(?: 0)?", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2", "gpl|gpl2|general public", r"(?:gnu )?(?:gpl|general public license)(?: version| v)? ?2(?: 0)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3", "gpl|gpl3|general public", r"(?:gnu )?(?:gpl|general public license)(?: version| v)? ?3(?: 0)?", r"gpl 3 0(?: only| or later)?"),
    ("lgpl-2", "lgpl|lgpl2|library general", r"(?:gnu )?(?:lgpl|library general public license)(?: version| v)? ?2(?: 0)?", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lgpl|lgpl2|lesser general", r"(?:gnu )?(?:lgpl|lesser general public license)(?: version| v)? ?2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "lgpl|lgpl3|lesser general", r"(?:gnu )?(?:lgpl|lesser general public license)(?: version| v)? ?3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    ("agpl-3", "agpl|agpl3|affero", r"(?:gnu )?(?:agpl|affero general public license)(?: version| v)? ?3(?: 0)?", r"agpl 3 0(?: only| or later)?"),
    ("fdl", "fdl|gfdl|free documentation", r"(?:gnu )?(?:fdl|gfdl|free documentation license)(?: version| v)?(?: 1 [123])?", r"gfdl 1 [123](?: only| or later)?"),
    ("mpl-1", "mpl|mpl1|mozilla", r"(?:mpl|mozilla public license)(?: version| v)? ?1(?: [01])?", r"mpl 1 [01]"),
    ("mpl-2", "mpl|mpl2|mozilla", r"(?:mpl|mozilla public license)(?: version| v)? ?2(?: 0)?", r"mpl 2 0"),
    ("epl-1", "epl|epl1|eclipse", r"(?:epl|eclipse public license)(?: version| v)? ?1(?: 0)?", r"epl 1 0"),
    ("epl-2", "epl|epl2|eclipse", r"(?:epl|eclipse public license)(?: version| v)? ?2(?: 0)?", r"epl 2 0"),
    ("cddl", "cddl|common development", r"cddl(?: 1 [01])?|common development and distribution license", r"cddl 1 [01]"),
    ("cpl", "cpl|common public", r"cpl 1 0|common public license", r"cpl 1 0"),
    ("eupl", "eupl|european union public", r"eupl(?: v?1 [012])?|european union public licen[cs]e", r"eupl 1 [012]"),
    ("isc", "isc", r"isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?", r"zlib"),
    ("bsl-1", "boost|bsl 1 0", r"boost software(?: license)?(?: version)?(?: 1 0)?", r"bsl 1 0"),
    ("artistic-1", "artistic", r"artistic license(?: version)? 1(?: 0)?", r"artistic 1 0(?: perl)?"),
    ("artistic-2", "artistic", r"artistic license(?: version)? 2(?: 0)?", r"artistic 2 0"),
    ("python-2", "python|psf", r"(?:python software foundation|psf)(?: license)?(?: version 2)?", r"python 2 0|psf 2 0"),
    ("php-3", "php", r"php license(?: version)? 3(?: 0[01]?)?", r"php 3 0[01]?"),
    ("ruby", "ruby", r"ruby", r"ruby"),
    ("openssl", "openssl", r"openssl", r"openssl"),
    ("postgresql", "postgresql", r"postgresql", r"postgresql"),
    ("unlicense", "unlicense", r"unlicense", r"unlicense"),
    ("wtfpl", "wtfpl|do what the fuck", r"wtfpl|do what the fuck you want to public license", r"wtfpl"),
    ("ofl-1.1", "ofl|open font", r"(?:sil )?(?:ofl|open font license)(?: version)?(?: 1 1)?", r"ofl 1 1"),
    ("ms-pl", "microsoft public|ms pl", r"microsoft public license|ms pl", r"ms pl"),
    ("ms-rl", "microsoft reciprocal|ms rl", r"microsoft reciprocal license|ms rl", r"ms rl"),
    ("afl-3", "academic free|afl 3 0", r"academic free license(?: version| v)?(?: 3 0)?", r"afl 3 0"),
    ("osl-3", "open software license|osl 3 0", r"open software license(?: version| v)?(?: 3 0)?", r"osl 3 0"),
    ("upl-1", "universal permissive|upl 1 0", r"universal permissive license(?: version| v)?(?: 1 0)?", r"upl 1 0"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?", r"ncsa"),
    ("cecill", "cecill", r"cecill(?: [bc])?(?: 2 [01])?", r"cecill(?: \w+)*?"),
    ("busl-1.1", "business source|busl 1 1", r"business source license(?: 1 1)?", r"busl 1 1"),
    ("sspl-1", "sspl|server side public", r"sspl|server side public license(?: version 1)?", r"sspl 1 0"),
    ("elastic-2", "elastic license|elastic 2 0", r"elastic license(?: version)?(?: 2(?: 0)?)?", r"elastic 2 0"),
    ("odbl", "odbl|open database", r"odbl|open database license", r"odbl 1 0"),
    ("odc-by", "odc by|open data commons attribution", r"odc by|open data commons attribution license", r"odc by 1 0"),
    ("pddl", "pddl|public domain dedication and license", r"pddl|public domain dedication and license", r"pddl 1 0"),
    ("cc0", "cc0|creative commons zero", r"cc0(?: 1 0)?|creative commons zero", r"cc0 1 0"),
    ("cc-by", "cc by|creative commons", r"cc by|creative commons attribution", r"cc by [1234] [05]"),
    ("cc-by-sa", "cc by sa|creative commons", r"cc by sa|creative commons attribution share ?alike", r"cc by sa [1234] [05]"),
    ("cc-by-nd", "cc by nd|creative commons", r"cc by nd|creative commons attribution no ?deriv(?:ative)?s?(?: works)?", r"cc by nd [1234] [05]"),
    ("cc-by-nc", "cc by nc|creative commons", r"cc by nc|creative commons attribution non ?commercial", r"cc by nc [1234] [05]"),
    ("cc-by-nc-sa", "cc by nc sa|creative commons", r"cc by nc sa|creative commons attribution non ?commercial share ?alike", r"cc by nc sa [1234] [05]"),
    ("cc-by-nc-nd", "cc by nc nd|creative commons", r"cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?", r"cc by nc nd [1234] [05]"),
)

#: What stands around a family's name: expression, priority, confidence. {n}: the name, {t}: the tag.
FORMS = (
    (r"spdx license identifier (?:{t})", 5, 1.0),
    (r"(?:licen[cs]ed|released|distributed|available|published|provided)(?: to you)? (?:under|subject to)(?: the)?(?: terms of)?(?: the)? (?:{n})(?: licen[cs]e)?", 4, 0.95),
    (r"(?:under|subject to|terms of|covered by|governed by)(?: the)? (?:{n})(?: licen[cs]e)?", 3, 0.85),
    (r"licen[cs]e (?:is )?(?:the )?(?:{n})", 3, 0.8),
    (r"(?:the )?(?:{n}) licen[cs]e", 2, 0.7),
)

#: Signatures of licence texts, notices and addresses, written by hand: label, keywords (of which all that the expression
#: matches contains one), expression, priority, confidence.
TEXTS = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 6, 1.0),
    ("mit", "above copyright notice and this permission", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 5, 0.95),
    ("mit", "without warranty of any kind", r"the software is provided as is without warranty of any kind express or implied including but not limited to", 4, 0.7),
    ("mit", "mit style", r"(?:an? )?mit style licen[cs]e", 3, 0.8),
    ("mit", "mit license", r"see (?:the )?file mit license", 2, 0.6),
    ("mit", "opensource org", r"opensource org licenses mit(?: license)?", 5, 0.95),
    ("mit-0", "without restriction including", r"mit no attribution(?: license)? without restriction including", 5, 0.9),
    ("mit-0", "mit no attribution", r"mit no attribution", 4, 0.9),
    ("x11", "x consortium", r"except as contained in this notice the name of the x consortium shall not be used", 6, 1.0),
    ("x11", "x11 license", r"(?:the )?x11 license", 3, 0.8),
    ("isc", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee", 6, 1.0),
    ("isc", "disclaims all warranties", r"the author disclaims all warranties with regard to this software including all implied warranties", 5, 0.9),
    ("isc", "internet systems consortium", r"internet systems consortium licen[cs]e", 4, 0.9),
    ("hpnd", "permission to use copy modify", r"permission to use copy modify and distribute this software and its documentation for any purpose", 6, 0.95),
    ("bsd-3", "neither the name", r"neither the name of [\w ]{1,80}? nor the names of its contributors may be used to endorse", 6, 1.0),
    ("bsd-3", "the names of its contributors", r"nor the names of its contributors may be used to endorse or promote products", 5, 0.9),
    ("bsd-3", "opensource org", r"opensource org licenses bsd 3 clause", 5, 0.95),
    ("bsd-2", "redistribution and use in source", r"redistribution and use in source and binary forms with or without modification are permitted", 5, 0.9),
    ("bsd-2", "redistributions of source code", r"redistributions of source code must retain the above copyright notice", 4, 0.7),
    ("bsd-2", "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice", 4, 0.7),
    ("bsd-2", "opensource org", r"opensource org licenses bsd 2 clause", 5, 0.95),
    ("bsd-4", "all advertising materials", r"all advertising materials mentioning features or use of this software must display", 6, 1.0),
    ("bsd", "bsd style", r"(?:an? )?bsd style licen[cs]e", 3, 0.7),
    ("bsd", "bsd like", r"(?:an? )?bsd like licen[cs]e", 3, 0.7),
    ("bsd", "berkeley software distribution", r"berkeley software distribution licen[cs]e", 3, 0.7),
    ("zlib", "this software is provided as is", r"this software is provided as is without any express or implied warranty in no event will the authors", 6, 0.95),
    ("zlib", "origin of this software", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 6, 0.95),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such", 5, 0.9),
    ("libpng", "libpng|png reference", r"(?:png reference library|libpng) license(?: version 2)?", 4, 0.9),
    ("unlicense", "free and unencumbered", r"this is free and unencumbered software released into the public domain", 6, 1.0),
    ("unlicense", "unlicense org", r"unlicense org", 4, 0.9),
    ("unlicense", "dedicate any and all copyright interest", r"(?:we )?dedicate any and all copyright interest in the software to the public domain", 6, 1.0),
    ("bsl-1", "boost software license", r"boost software license version 1 0 august 17th 2003", 6, 1.0),
    ("bsl-1", "boost org", r"boost org license 1 0(?: txt)?", 5, 0.95),
    ("apache-2", "apache license", r"licensed under the apache license version 2 0 the license", 6, 1.0),
    ("apache-2", "apache org", r"(?:https? )?www apache org licenses license 2 0", 6, 1.0),
    ("apache-2", "except in compliance with the license", r"you may not use this file except in compliance with the license", 4, 0.8),
    ("apache-2", "distributed on an as is basis", r"software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", 4, 0.8),
    ("apache-2", "asl 2 0", r"asl 2 0", 3, 0.8),
    ("apache-2", "licensed to the apache software foundation", r"licensed to the apache software foundation asf under one or more contributor license agreements", 6, 0.95),
    ("apache-2", "grant of patent license", r"grant of patent license subject to the terms and conditions of this license each contributor hereby grants", 5, 0.9),
    ("apache-1", "developed by the apache", r"this product includes software developed by the apache (?:software foundation|group)", 5, 0.9),
    ("gpl-2", "either version 2", r"either version 2 of the license or (?:at your option )?any later version", 5, 0.9),
    ("gpl-2", "version 2 june 1991", r"gnu general public license version 2 june 1991", 6, 1.0),
    ("gpl-2", "version 2 as published", r"general public license version 2 as published by the free software foundation", 6, 0.95),
    ("gpl-2", "2 only|v2 only|gpl2 only|gplv2 only", r"gpl (?:v|version )?2 only|gplv?2 only", 4, 0.9),
    ("gpl-3", "either version 3", r"either version 3 of the license or (?:at your option )?any later version", 5, 0.9),
    ("gpl-3", "version 3 29 june 2007", r"gnu general public license version 3 29 june 2007", 6, 1.0),
    ("gpl-3", "version 3 as published", r"general public license version 3 as published by the free software foundation", 6, 0.95),
    ("gpl", "general public", r"(?:gnu )?general public license", 1, 0.5),
    ("gpl", "free software foundation", r"it under the terms of the gnu general public license as published by the free software foundation", 4, 0.8),
    ("gpl", "received a copy of the gnu general", r"you should have received a copy of the gnu general public license", 4, 0.8),
    ("gpl", "www gnu org", r"www gnu org licenses(?: gpl(?: html)?)?", 3, 0.7),
    ("gpl-classpath", "classpath", r"classpath exception", 4, 0.9),
    ("gpl-classpath", "linking this library statically", r"linking this library statically or dynamically with other modules is making a combined work", 6, 0.95),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public license", 1, 0.5),
    ("lgpl", "received a copy of the gnu lesser", r"you should have received a copy of the gnu lesser general public license", 4, 0.8),
    ("lgpl", "www gnu org", r"www gnu org licenses lgpl(?: html)?", 4, 0.8),
    ("lgpl-2", "version 2 june 1991", r"gnu library general public license version 2 june 1991", 6, 1.0),
    ("lgpl-2.1", "version 2 1 february 1999", r"gnu lesser general public license version 2 1 february 1999", 6, 1.0),
    ("lgpl-2.1", "either version 2 1", r"either version 2 1 of the license or (?:at your option )?any later version", 5, 0.9),
    ("lgpl-3", "version 3 29 june 2007", r"gnu lesser general public license version 3 29 june 2007", 6, 1.0),
    ("agpl-3", "version 3 19 november 2007", r"gnu affero general public license version 3 19 november 2007", 6, 1.0),
    ("agpl-3", "received a copy of the gnu affero", r"you should have received a copy of the gnu affero general public license", 4, 0.85),
    ("agpl-3", "remote network interaction", r"remote network interaction use with the gnu general public license", 5, 0.9),
    ("fdl", "invariant sections", r"with no invariant sections no front cover texts and no back cover texts", 6, 1.0),
    ("fdl", "copy distribute and or modify this document", r"permission is granted to copy distribute and or modify this document under the terms of", 5, 0.9),
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0", 6, 1.0),
    ("mpl-2", "mozilla org", r"(?:https? )?mozilla org mpl 2 0", 5, 0.95),
    ("mpl-2", "incompatible with secondary licenses", r"incompatible with secondary licenses", 4, 0.9),
    ("mpl-1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 [01]", 6, 1.0),
    ("mpl-1", "mozilla org", r"(?:https? )?www mozilla org mpl", 4, 0.8),
    ("npl", "netscape public", r"netscape public license(?: version 1 [01])?", 4, 0.9),
    ("epl-1", "eclipse org", r"eclipse org legal epl v10(?: html)?", 6, 0.95),
    ("epl-2", "eclipse org", r"eclipse org legal epl 2 0", 6, 0.95),
    ("epl-2", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", 6, 1.0),
    ("epl-1", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", 6, 1.0),
    ("edl", "eclipse distribution", r"eclipse distribution license(?: v 1 0)?", 4, 0.9),
    ("cddl", "subject to the terms of the common development", r"the contents of this file are subject to the terms of the common development and distribution license", 6, 1.0),
    ("cpl", "provided under the terms of this common public", r"the accompanying program is provided under the terms of this common public license", 6, 1.0),
    ("eupl", "eupl", r"licensed under the eupl version 1 [012] or as soon they will be approved by the european commission(?: european union)?", 6, 1.0),
    ("artistic-2", "artistic", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed artistic license 2 0", 5, 0.9),
    ("artistic-1", "same terms as perl", r"(?:under )?the same terms as perl(?: 5)? itself", 4, 0.85),
    ("artistic-1", "clarified artistic", r"clarified artistic license", 4, 0.9),
    ("python-2", "python software foundation", r"python software foundation license version 2", 5, 0.95),
    ("python-2", "psf hereby grants", r"psf hereby grants licensee a nonexclusive royalty free world wide license", 6, 1.0),
    ("cnri", "corporation for national research", r"corporation for national research initiatives (?:hereby grants|python licen[cs]e)", 5, 0.9),
    ("php-3", "php software", r"this product includes php software freely available from", 5, 0.9),
    ("php-3", "php license", r"this source file is subject to version 3 0?1? ?of the php license", 6, 1.0),
    ("ruby", "ruby", r"you may make and give away verbatim copies of the source form of the software without restriction ruby", 4, 0.8),
    ("openssl", "openssl project", r"this product includes software developed by the openssl project for use in the openssl toolkit", 6, 1.0),
    ("ssleay", "eric young", r"this product includes cryptographic software written by eric young", 6, 1.0),
    ("postgresql", "postgresql", r"postgresql database management system formerly known as postgres", 5, 0.9),
    ("postgresql", "regents of the university of california", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee (?:[\w ]{0,119} )?regents of the university of california", 4, 0.6),
    ("ofl-1.1", "open font license", r"this font software is licensed under the sil open font license version 1 1", 6, 1.0),
    ("ofl-1.1", "reserved font name", r"with reserved font name", 5, 0.9),
    ("ofl-1.1", "scripts sil org", r"scripts sil org ofl", 5, 0.95),
    ("ubuntu-font", "ubuntu font", r"ubuntu font licen[cs]e(?: version 1 0)?", 4, 0.9),
    ("wtfpl", "you just do what", r"you just do what the fuck you want to", 6, 1.0),
    ("beerware", "beer ware", r"the beer ware license", 5, 0.95),
    ("beerware", "buy me a beer", r"you can buy me a beer in return", 5, 0.9),
    ("json", "for good not evil", r"the software shall be used for good not evil", 6, 1.0),
    ("ms-pl", "microsoft", r"this license governs use of the accompanying software if you use the software you accept this license microsoft", 4, 0.7),
    ("ncsa", "developed by the university of illinois", r"developed by the university of illinois", 3, 0.6),
    ("curl", "daniel stenberg", r"copyright c 1996 20\d\d daniel stenberg", 6, 0.95),
    ("icu", "unicode", r"unicode inc license agreement data files and software", 6, 1.0),
    ("unicode", "unicode license", r"unicode license v3", 5, 0.95),
    ("w3c", "w3c", r"w3c software (?:notice and license|and document notice and license)", 5, 0.95),
    ("zpl", "zope public", r"zope public license(?: zpl)?(?: version 2 [01])?", 4, 0.9),
    ("ijg", "independent jpeg group", r"this software is based in part on the work of the independent jpeg group", 6, 0.95),
    ("ftl", "freetype project", r"freetype project license", 5, 0.9),
    ("qpl", "q public", r"q public license(?: version 1 0)?", 4, 0.9),
    ("sleepycat", "sleepycat", r"sleepycat (?:public )?license", 4, 0.9),
    ("blueoak-1", "blue oak", r"blue oak model license(?: 1 0 0)?", 5, 0.95),
    ("mulan-2", "mulan", r"mulan (?:psl v2|permissive software license v2|psl2)", 5, 0.95),
    ("cc0", "no copyright", r"no copyright the person who associated a work with this deed has dedicated the work to the public domain", 6, 0.95),
    ("cc0", "publicdomain zero", r"(?:creativecommons org )?publicdomain zero 1 0", 5, 0.95),
    ("cc-by", "creativecommons org", r"creativecommons org licenses by [1234] [05]", 5, 0.95),
    ("cc-by-sa", "creativecommons org", r"creativecommons org licenses by sa [1234] [05]", 5, 0.95),
    ("cc-by-nd", "creativecommons org", r"creativecommons org licenses by nd [1234] [05]", 5, 0.95),
    ("cc-by-nc", "creativecommons org", r"creativecommons org licenses by nc [1234] [05]", 5, 0.95),
    ("cc-by-nc-sa", "creativecommons org", r"creativecommons org licenses by nc sa [1234] [05]", 5, 0.95),
    ("cc-by-nc-nd", "creativecommons org", r"creativecommons org licenses by nc nd [1234] [05]", 5, 0.95),
    ("cc-by", "must give appropriate credit", r"you must give appropriate credit provide a link to the license and indicate if changes were made", 3, 0.7),
    ("cc-by-sa", "distribute your contributions under the same license", r"(?:you must )?distribute your contributions under the same license as the original", 4, 0.8),
    ("cc-by-nc", "for commercial purposes", r"you may not use the material for commercial purposes", 4, 0.8),
    ("cc-by-nd", "distribute the modified material", r"you may not distribute the modified material", 4, 0.8),
    ("odbl", "opendatacommons org", r"opendatacommons org licenses odbl 1 0", 6, 0.95),
    ("odc-by", "opendatacommons org", r"opendatacommons org licenses by 1 0", 6, 0.95),
    ("pddl", "opendatacommons org", r"opendatacommons org licenses pddl 1 0", 6, 0.95),
    ("cdla-permissive", "community data license", r"community data license agreement permissive(?: version [12] 0)?", 5, 0.95),
    ("cdla-sharing", "community data license", r"community data license agreement sharing(?: version 1 0)?", 5, 0.95),
    ("ogl-uk", "open government license|open government licence", r"open government licen[cs]e(?: v3 0)?", 4, 0.9),
    ("busl-1.1", "change license", r"the change license (?:is|means|shall be)", 3, 0.6),
    ("busl-1.1", "additional use grant", r"additional use grant", 4, 0.85),
    ("commons-clause", "commons clause", r"commons clause license condition(?: v1 0)?", 5, 0.95),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|internal use|perimeter|free trial)(?: license)?", 4, 0.9),
    ("fair-source", "fair source", r"fair source license", 4, 0.9),
    ("openrail", "openrail", r"(?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: license)?", 4, 0.9),
    ("llama", "community license", r"llama ?[23]?(?: 1| 2| 3)? community license(?: agreement)?", 5, 0.95),
    ("gemma", "gemma terms", r"gemma terms of use", 5, 0.95),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", 3, 0.8),
    ("public-domain", "public domain", r"public domain", 1, 0.4),
    ("public-domain", "work of the united states government", r"(?:a )?work of the united states government", 4, 0.85),
    ("public-domain", "no rights reserved", r"no rights reserved", 3, 0.8),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved", 1, 0.6),
    ("all-rights-reserved", "alle rechte vorbehalten", r"alle rechte vorbehalten", 1, 0.6),
    ("all-rights-reserved", "tous droits", r"tous droits r\S+", 1, 0.6),
    ("all-rights-reserved", "todos los derechos reservados", r"todos los derechos reservados", 1, 0.6),
    ("all-rights-reserved", "prior written permission", r"may not be reproduced (?:[\w ]{1,80}? )?without (?:the )?prior written permission", 3, 0.7),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)*", 1, 0.5),
    ("copyright", "copr", r"copr (?:19|20)\d\d", 1, 0.4),
    ("proprietary", "proprietary", r"(?:proprietary and confidential|confidential and proprietary)", 3, 0.8),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited", 5, 0.9),
    ("proprietary", "trade secret|trade secrets", r"(?:contains|constitutes) (?:the )?trade secrets?", 3, 0.6),
    ("proprietary", "end user license|end user licence", r"end user licen[cs]e agreement", 2, 0.6),
    ("non-commercial", "non commercial", r"(?:for )?non commercial use only", 3, 0.7),
    ("non-commercial", "noncommercial", r"(?:for )?noncommercial use only", 3, 0.7),
    ("non-commercial", "academic use only", r"(?:for )?academic use only", 3, 0.7),
    ("no-ai-training", "machine learning|artificial intelligence|language model|language models", r"may not be used (?:to train|for training|for the training of)(?: any)? (?:machine learning|artificial intelligence|language models?)", 5, 0.9),
    ("no-ai-training", "text and data mining", r"(?:all rights|rights) (?:are )?reserved (?:[\w ]{1,60}? )?text and data mining", 5, 0.9),
    ("no-ai-training", "noai", r"noai(?: noimageai)?", 3, 0.7),
    ("no-ai-training", "training of artificial intelligence", r"(?:no|not for) training of artificial intelligence", 4, 0.85),
)


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    priority: int
    confidence: float


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All rules in order; words are separated by one space, and patterns match whole words only."""
    spec = [(label, label_keys, form.format(n=name, t=tag), priority, confidence) for label, label_keys, name, tag in FAMILIES for form, priority, confidence in FORMS]
    spec = [*TEXTS, *spec]
    return tuple(Rule(label, tuple(keys.split("|")), re.compile(rf"(?<= )(?:{text})(?= )"), priority, confidence) for label, keys, text, priority, confidence in spec)


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    by_keyword: dict[str, list[int]] = {}
    for i, rule in enumerate(rules()):
        for key in rule.keywords:
            by_keyword.setdefault(key, []).append(i)
    for key, ids in by_keyword.items():
        found.add_word(f" {key} ", tuple(ids))
    found.make_automaton()
    return found


#: Lower-cases A-Z, keeps digits, letters and all that is not ASCII, and turns the rest into spaces.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def scan(line: str, base: tuple[tuple[str, str], ...] = BASE_PHRASES) -> tuple[list[tuple[str, int, int, float]], list[tuple[str, int]]]:
    """Detections (label, first word, end word, confidence) left after suppression, and places of base phrases
    (label, first word), in a text given as lower-case words with one space before, between and after them."""
    places = []
    for phrase, label in base:
        at = line.find(f" {phrase} ")
        while at >= 0:
            places.append((label, at))
            at = line.find(f" {phrase} ", at + 1)
    wanted = {i for ids in {ids for _, ids in _automaton().iter(line)} for i in ids}
    hits = []
    for i in sorted(wanted):
        rule = rules()[i]
        hits += [(m.start(), m.end(), rule.priority, -i) for m in rule.pattern.finditer(line)]
    if not hits and not places:
        return [], []
    spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), "<u4") == 32)
    kept = suppress(hits)
    first, end, at = (np.searchsorted(spaces, x).tolist() for x in ([k[0] for k in kept], [k[1] for k in kept], [p for _, p in places]))
    found = [(rules()[-i].label, a - 1, b, rules()[-i].confidence) for (_, _, _, i), a, b in zip(kept, first, end, strict=True)]
    return found, sorted((label, a) for (label, _), a in zip(places, at, strict=True))


def suppress(hits: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """What stays of hits (start, end, priority, minus the rule's number), by place.

    A hit inside another goes unless it has the higher priority; of equal spans the higher priority, then the earlier
    rule, stays. What is left then gives way to a hit of higher priority inside it. Both are one sweep each with one
    number for each priority.
    """
    levels = sorted({h[2] for h in hits})
    kept, reach = [], dict.fromkeys(levels, -1)
    # wider first; in order of start, an interval can only lie in one that starts at or before it
    for hit in sorted(hits, key=lambda h: (h[0], -h[1], -h[2], -h[3])):
        if not any(reach[p] >= hit[1] for p in levels if p >= hit[2]):
            kept.append(hit)
            reach[hit[2]] = max(reach[hit[2]], hit[1])
    out, least = [], dict.fromkeys(levels, 2**62)
    for _, group in itertools.groupby(reversed(kept), key=lambda h: h[0]):
        same = list(group)
        for h in same:
            least[h[2]] = min(least[h[2]], h[1])
        out += [h for h in same if not any(least[p] <= h[1] for p in levels if p > h[2])]
    return out[::-1]


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, detections and base places.

    detections: array of (label, first_word, end_word, confidence), by place; places: array of (label, first_word)
    of base phrases. Needs doc_id and text; other columns are ignored. Null texts count as empty, texts are scanned
    whole, repeated rows give repeated results, and an empty table gives an empty result.
    """
    kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("confidence", pa.float64())]))
    place = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, places = [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py() or b"")
                hits, base = scan(f" {b' '.join(words).decode('utf-8', 'replace')} ")
                counts.append(len(words))
                found.append([dict(zip(("label", "first_word", "end_word", "confidence"), h, strict=True)) for h in hits])
                places.append([dict(zip(("label", "first_word"), h, strict=True)) for h in base])
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(places, place)], names=["doc_id", "n_words", "detections", "places"])

    schema = "doc_id long, n_words long, detections array<struct<label:string,first_word:long,end_word:long,confidence:double>>, places array<struct<label:string,first_word:long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)
