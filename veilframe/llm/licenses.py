"""License scans by ordered signature rules (operator 4), by DataFrame functions only.

A text becomes its words (A-Z lower-cased; digits, letters and everything beyond ASCII), each tagged with its number. A rule is a
regular expression over words: rules are written with plain spaces, which ``tagged`` turns into "tag, space", so a match carries
the numbers of its first and last word. ``GRANTS`` are signatures of license texts and notices, one by one: grants, conditions, disclaimers,
titles, addresses. Names of licenses (``LICENSES``) and their SPDX identifiers are signatures that a few wordings (``WORDINGS``)
surround. All are in order of priority; each has a keyword, and only rules whose keyword a text contains are tried, and only in texts that
the gate lets through. A detection is suppressed if one of the same or a better priority contains it, so that a name within a notice, or a
grant within a longer text of another license, does not count.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from veilframe.llm.shared import count_words, lower_ascii

#: Everything that is no part of a word, once A-Z are lower-cased; and what stands between words in a text as it is.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"

#: Phrases that always count, and their labels (fixed values).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label, keyword that every wording contains (at the start of a word, with * anywhere), how the license is named in prose, its SPDX identifier as words.
LICENSES = [
    ("0bsd", "zero clause", "(?:bsd zero clause|zero clause bsd)", "0bsd"),
    ("afl-3.0", "academic free", "academic free licen[cs]e(?: v(?:ersion)? ?3(?: 0)?)?", "afl 3 0"),
    ("agpl-3.0", "affero", "gnu affero general public licen[cs]e(?: as published by the free software foundation)?(?: (?:either )?version 3(?: 0)?)?", "agpl 3 0(?: only| or later)?"),
    ("apache-1.1", "apache", "apache(?: software)? licen[cs]e (?:version )?1 1", "apache 1 1"),
    ("apache-2.0", "apache", "apache(?: software)? licen[cs]e (?:version |v)?2(?: 0)?", "apache 2 0"),
    ("apsl-2.0", "apple public", "apple public source licen[cs]e(?: version 2(?: 0)?)?", "apsl 2 0"),
    ("artistic-2.0", "artistic", "artistic licen[cs]e (?:version )?2(?: 0)?", "artistic 2 0"),
    ("artistic-perl", "artistic", "(?:perl artistic|artistic) licen[cs]e(?: for perl)?", "artistic 1 0 perl"),
    ("beerware", "beer", "beer ?ware licen[cs]e", "beerware"),
    ("blueoak-1.0.0", "blue oak", "blue oak model licen[cs]e(?: 1 0 0)?", "blueoak 1 0 0"),
    ("bsd-1-clause", "bsd", "bsd 1 clause(?: licen[cs]e)?", "bsd 1 clause"),
    ("bsd-2-clause", "*bsd", "(?:(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]e)?|freebsd licen[cs]e)", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)?", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[cs]e)?", "bsd 4 clause"),
    ("bsl-1.0", "boost", "boost software licen[cs]e(?: version 1(?: 0)?)?", "bsl 1 0"),
    ("busl-1.1", "business source", "business source licen[cs]e(?: 1 1)?", "busl 1 1"),
    ("bzip2", "bzip2 licen", "bzip2 licen[cs]e", "bzip2 1 0 6"),
    ("cc0-1.0", "cc0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by-4.0", "attribution", "creative commons attribution(?: international)?(?: 4 0)?(?: international)?(?: public)? licen[cs]e", "cc by 4 0"),
    ("cc-by-nc-4.0", "attribution non", "creative commons attribution non ?commercial(?: 4 0)?(?: international)? licen[cs]e", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "attribution no", "creative commons attribution no ?deriv(?:ative)?s?(?: 4 0)?(?: international)? licen[cs]e", "cc by nd 4 0"),
    ("cc-by-sa-4.0", "attribution share", "creative commons attribution share ?alike(?: 4 0)?(?: international)? licen[cs]e", "cc by sa 4 0"),
    ("cc-by-nc-sa-4.0", "attribution non", "creative commons attribution non ?commercial share ?alike(?: 4 0)?(?: international)? licen[cs]e", "cc by nc sa 4 0"),
    ("cddl-1.0", "common development", "common development and distribution licen[cs]e(?: version 1 [01])?", "cddl 1 0"),
    ("cecill-2.1", "cecill", "cecill(?: free software)? licen[cs]e(?: (?:agreement )?version 2 1)?", "cecill 2 1"),
    ("cpl-1.0", "common public", "common public licen[cs]e(?: version 1 0)?", "cpl 1 0"),
    ("curl", "curl licen", "curl licen[cs]e", "curl"),
    ("ecl-2.0", "educational community", "educational community licen[cs]e(?: version 2 0)?", "ecl 2 0"),
    ("efl-2.0", "eiffel", "eiffel forum licen[cs]e(?: v(?:ersion )?2(?: 0)?)?", "efl 2 0"),
    ("epl-1.0", "eclipse", "eclipse public licen[cs]e (?:version |v)?1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", "eclipse public licen[cs]e (?:version |v)?2(?: 0)?", "epl 2 0"),
    ("eupl-1.2", "european union", "european union public licen[cs]e(?: (?:version |v)?1 [12])?", "eupl 1 2"),
    ("fsfap", "all permissive", "fsf all permissive licen[cs]e", "fsfap"),
    ("ftl", "freetype", "freetype(?: project)? licen[cs]e", "ftl"),
    ("gfdl-1.3", "free documentation", "gnu free documentation licen[cs]e(?: version 1 [123])?", "gfdl 1 3(?: only| or later)?"),
    ("gpl-1.0", "general public", "(?:gnu )?general public licen[cs]e (?:version |v)?1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "general public", "(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)? (?:either )?(?:version |v)?2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "general public", "(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)? (?:either )?(?:version |v)?3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("hpnd", "historical permission", "historical permission notice and disclaimer", "hpnd"),
    ("icu", "icu licen", "icu licen[cs]e", "icu"),
    ("ijg", "jpeg group", "independent jpeg group licen[cs]e", "ijg"),
    ("imagemagick", "imagemagick", "imagemagick licen[cs]e", "imagemagick"),
    ("ipl-1.0", "ibm public", "ibm public licen[cs]e(?: version 1 0)?", "ipl 1 0"),
    ("isc", "isc licen", "isc licen[cs]e", "isc"),
    ("lgpl-2.0", "library general", "gnu library general public licen[cs]e(?: (?:version |v)?2(?: 0)?)?", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser general", "(?:gnu )?lesser general public licen[cs]e (?:version |v)?2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lesser general", "(?:gnu )?lesser general public licen[cs]e (?:version |v)?3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("libpng", "libpng licen", "libpng licen[cs]e(?: version 2)?", "libpng"),
    ("lppl-1.3c", "latex", "latex project public licen[cs]e(?: (?:version |v)?1 3c)?", "lppl 1 3c"),
    ("mit", "mit licen", "(?:the )?mit licen[cs]e", "mit"),
    ("mit-0", "mit no", "mit no attribution(?: licen[cs]e)?", "mit 0"),
    ("mpl-1.1", "mozilla", "mozilla public licen[cs]e (?:version |v)?1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public licen[cs]e (?:version |v)?2(?: 0)?", "mpl 2 0"),
    ("ms-pl", "microsoft public", "microsoft public licen[cs]e", "ms pl"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[cs]e", "ms rl"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e", "ncsa"),
    ("odbl-1.0", "database licen", "open (?:data commons )?(?:open )?database licen[cs]e(?: v?1 0)?", "odbl 1 0"),
    ("ofl-1.1", "open font", "(?:sil )?open font licen[cs]e(?: version 1 1)?", "ofl 1 1"),
    ("openssl", "openssl licen", "openssl licen[cs]e", "openssl"),
    ("osl-3.0", "open software", "open software licen[cs]e(?: (?:version |v)?3(?: 0)?)?", "osl 3 0"),
    ("php-3.01", "php licen", "php licen[cs]e(?: (?:version |v)?3 01)?", "php 3 01"),
    ("postgresql", "postgresql licen", "postgresql licen[cs]e", "postgresql"),
    ("psf-2.0", "python software", "python software foundation licen[cs]e(?: (?:version |v)?2)?", "psf 2 0"),
    ("public-domain", "public domain", "public domain(?: dedication)?", "licenseref public domain"),
    ("qpl-1.0", "q public", "q public licen[cs]e(?: version 1 0)?", "qpl 1 0"),
    ("ruby", "ruby licen", "ruby licen[cs]e", "ruby"),
    ("sleepycat", "sleepycat", "sleepycat licen[cs]e", "sleepycat"),
    ("sspl-1.0", "server side", "server side public licen[cs]e(?: (?:version |v)?1)?", "sspl 1 0"),
    ("tcl", "tcl ", "tcl tk licen[cs]e", "tcl"),
    ("unlicense", "unlicen", "(?:the )?unlicen[cs]e", "unlicense"),
    ("upl-1.0", "universal permissive", "universal permissive licen[cs]e(?: (?:version |v)?1 0)?", "upl 1 0"),
    ("vim", "vim licen", "vim licen[cs]e", "vim"),
    ("w3c", "w3c ", "w3c(?: software)?(?: notice and)? licen[cs]e", "w3c"),
    ("wtfpl", "do what the", "do what the f[a-z]+ you want to public licen[cs]e(?: version 2)?", "wtfpl"),
    ("x11", "x11 licen", "x11 licen[cs]e", "x11"),
    ("zlib", "zlib licen", "zlib licen[cs]e", "zlib"),
    ("zpl-2.1", "zope", "zope public licen[cs]e(?: version 2 1)?", "zpl 2 1"),
]

#: Signatures of texts and notices: label, keyword, pattern, confidence. ``~`` stands for any word.
GRANTS = [
    ("mit", "associated documentation", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction", 1.0),
    ("mit", "substantial portions", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software", 0.95),
    ("mit", "copyright holders", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise", 0.7),
    ("mit-0", "without restriction", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is", 1.0),
    ("x11", "without prior written", "except as contained in this notice the name of(?: ~){1,12}? shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization", 0.95),
    ("ncsa", "deal with the software", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction", 1.0),
    ("bsl-1.0", "or organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 1.0),
    ("bsl-1.0", "boost org", "(?:http )?(?:www )?boost org license 1 0", 0.95),
    ("upl-1.0", "software associated documentation", "permission is hereby granted free of charge to any person obtaining a copy of this software associated documentation and or data", 1.0),
    ("icu", "unicode data", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", 0.9),
    ("icu", "supporting documentation", "provided that the above copyright notice s and this permission notice appear in all copies of the software and that both the above copyright notice s and this permission notice appear in supporting documentation", 0.95),
    ("isc", "with or without fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 1.0),
    ("0bsd", "with or without fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 0.95),
    ("isc", "the author disclaims", "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", 0.6),
    ("hpnd", "supporting documentation", "permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose(?: and without fee)? is hereby granted(?: without fee)? provided that the above copyright notice appears? in all copies and that both(?: that)?(?: the)? copyright notice and this permission notice appear in supporting documentation", 1.0),
    ("postgresql", "without a written agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 1.0),
    ("ntp", "with or without fee", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice appears in all copies", 0.95),
    ("w3c", "fee or royalty", "permission to copy modify and distribute this(?: software and its)? documentation with or without modification for any purpose and without fee or royalty is hereby granted", 0.95),
    ("w3c", "w3c", "w3c software notice and license", 0.9),
    ("bsd-2-clause", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?", 0.9),
    ("bsd-4-clause", "advertising materials", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met(?: ~){0,160}? all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment(?: ~){0,160}? specific prior written permission", 1.0),
    ("bsd-3-clause", "specific prior written", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met(?: ~){0,160}? (?:neither the names? of(?: ~){1,30}? nor the names of|the names? of(?: ~){1,12}? may not be used to endorse)(?: ~){0,30}? specific prior written permission", 1.0),
    ("bsd-3-clause", "to endorse or promote", "(?:neither the names? of(?: ~){1,30}? nor the names of(?: ~){1,6}?|the names? of(?: ~){1,12}?) may (?:not )?be used to endorse or promote products derived from this software without specific prior written permission", 0.85),
    ("bsd-3-clause-clear", "express or implied licenses", "no express or implied licenses to any party s patent rights are granted by this license", 0.95),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment", 0.9),
    ("bsd-1-clause", "in source form", "redistribution and use in source forms? with or without modification are permitted provided that the following conditions are met", 0.7),
    ("bsd-source-code", "redistributions of source code must retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.5),
    ("freebsd-doc", "sgml docbook", "redistribution and use in source sgml docbook and compiled forms", 0.9),
    ("apache-2.0", "apache license", "licensed under the apache license version 2 0 the license you may not use this(?: file| work| software)? except in compliance with the license", 1.0),
    ("apache-2.0", "january 2004", "apache license version 2 0 january 2004", 1.0),
    ("apache-2.0", "apache org", "(?:www )?apache org licenses license 2 0", 1.0),
    ("apache-2.0", "royalty free irrevocable", "hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of", 0.9),
    ("apache-2.0", "royalty free irrevocable", "hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license", 0.9),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation http www apache org", 0.8),
    ("apache-1.0", "apache group", "this product includes software developed by the apache group for use in the apache http server project", 0.9),
    ("ecl-2.0", "educational community", "licensed under the educational community license version 2 0 the license", 1.0),
    ("gpl-3.0", "version 3", "(?:this program|this file|~) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation(?: either)? version 3", 1.0),
    ("gpl-2.0", "version 2", "(?:this program|this file|~) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation(?: either)? version 2", 1.0),
    ("gpl-1.0", "version 1", "(?:this program|this file|~) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation(?: either)? version 1", 1.0),
    ("lgpl-2.1", "version 2 1", "(?:this library|this program|~) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation(?: either)? version 2 1", 1.0),
    ("lgpl-3.0", "version 3", "(?:this library|this program|~) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation(?: either)? version 3", 1.0),
    ("lgpl-2.0", "library general public", "(?:this library|this program|~) is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation(?: either)? version 2", 1.0),
    ("agpl-3.0", "affero general public", "(?:this program|this file|~) is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation(?: either)? version 3", 1.0),
    ("gpl-3.0", "29 june 2007", "gnu general public license version 3 29 june 2007", 1.0),
    ("gpl-2.0", "june 1991", "gnu general public license version 2 june 1991", 1.0),
    ("gpl-1.0", "february 1989", "gnu general public license version 1 february 1989", 1.0),
    ("lgpl-3.0", "29 june 2007", "gnu lesser general public license version 3 29 june 2007", 1.0),
    ("lgpl-2.1", "february 1999", "gnu lesser general public license version 2 1 february 1999", 1.0),
    ("lgpl-2.0", "june 1991", "gnu library general public license version 2 june 1991", 1.0),
    ("agpl-3.0", "19 november 2007", "gnu affero general public license version 3 19 november 2007", 1.0),
    ("gfdl-1.3", "3 november 2008", "gnu free documentation license version 1 3 3 november 2008", 1.0),
    ("gfdl-1.2", "november 2002", "gnu free documentation license version 1 2 november 2002", 1.0),
    ("gfdl-1.3", "free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3", 1.0),
    ("gfdl-1.2", "free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2", 1.0),
    ("gfdl-1.1", "free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 1", 1.0),
    ("gpl-3.0", "free copyleft license", "the gnu general public license is a free copyleft license for software and other kinds of works", 1.0),
    ("agpl-3.0", "network server software", "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software", 1.0),
    ("gpl-3.0", "affero general public", "permission to link or combine any covered work with a work licensed under version 3 of the gnu affero general public license into a single combined work", 0.9),
    ("gpl", "linking proprietary applications", "linking proprietary applications with the library if this is what you want to do use the gnu (?:lesser|library) general public license instead of this license", 0.8),
    ("gpl", "to share and change", "the licenses for most software(?: and other practical works)? are designed to take away your freedom to share and change", 0.8),
    ("lgpl-2.1", "ordinary general public", "when a program is linked with a library whether statically or using a shared library the combination of the two is legally speaking a combined work a derivative of the original library the ordinary general public license", 0.9),
    ("lgpl-3.0", "additional permissions listed", "incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below", 1.0),
    ("gpl-3.0", "gnu org licenses gpl", "(?:www )?gnu org licenses gpl 3 0", 0.9),
    ("gpl-2.0", "gnu org licenses", "(?:www )?gnu org licenses (?:old licenses )?gpl 2 0", 0.9),
    ("lgpl-2.1", "gnu org licenses", "(?:www )?gnu org licenses (?:old licenses )?lgpl 2 1", 0.9),
    ("lgpl-3.0", "gnu org licenses lgpl", "(?:www )?gnu org licenses lgpl 3 0", 0.9),
    ("agpl-3.0", "gnu org licenses agpl", "(?:www )?gnu org licenses agpl 3 0", 0.9),
    ("classpath-exception-2.0", "independent modules", "as a special exception the copyright holders of this library give you permission to link this library with independent modules to produce an executable", 0.95),
    ("classpath-exception-2.0", "classpath exception", "with classpath exception(?: 2 0)?", 0.9),
    ("gcc-exception-3.1", "gcc runtime library", "gcc runtime library exception(?: version 3 1)?", 0.9),
    ("gcc-exception-3.1", "gcc exception", "with gcc exception 3 1", 0.9),
    ("llvm-exception", "llvm exception", "with llvm exceptions?", 0.9),
    ("llvm-exception", "llvm exceptions", "llvm exceptions to the apache 2 0 license", 0.95),
    ("autoconf-exception", "autoconf exception", "with autoconf exception(?: [23] 0)?", 0.9),
    ("bison-exception", "bison parser skeleton", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton", 0.95),
    ("font-exception-2.0", "font exception", "with font exception(?: 2 0)?", 0.9),
    ("openssl-exception", "openssl library", "permission to link the code of(?: ~){1,20}? with the openssl library", 0.8),
    ("mpl-2.0", "mozilla public", "this source code form is subject to the terms of the mozilla public license v 2 0", 1.0),
    ("mpl-2.0", "incompatible with secondary", "this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0", 1.0),
    ("mpl-2.0", "mozilla org mpl 2", "(?:https? )?mozilla org mpl 2 0", 0.9),
    ("mpl-1.1", "mozilla public", "the contents of this file are subject to the mozilla public license version 1 1", 1.0),
    ("mpl-1.0", "mozilla public", "the contents of this file are subject to the mozilla public license version 1 0", 1.0),
    ("cddl-1.0", "common development", "the contents of this file are subject to the terms of the common development and distribution license", 1.0),
    ("cpal-1.0", "common public attribution", "the contents of this file are subject to the common public attribution license version 1 0", 1.0),
    ("epl-2.0", "eclipse public", "this program and the accompanying materials are made available under the terms of the eclipse public license(?: v)? 2 0", 1.0),
    ("epl-1.0", "eclipse public", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", 1.0),
    ("epl-2.0", "eclipse org", "(?:www )?eclipse org legal epl 2 0", 0.95),
    ("epl-1.0", "eclipse org", "(?:www )?eclipse org legal epl v10", 0.95),
    ("cpl-1.0", "common public license", "the accompanying program is provided under the terms of this common public license agreement", 1.0),
    ("eupl-1.2", "european union public", "licensed under the eupl(?: version)? 1 2(?: or as soon they will be approved by the european commission)?(?: ~){0,20}? european union public li[cz]en[cs]e", 0.9),
    ("osl-3.0", "open software license", "licensed under the open software license version 3 0", 1.0),
    ("afl-3.0", "academic free", "licensed under the academic free license version 3 0", 1.0),
    ("artistic-2.0", "free software package", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", 1.0),
    ("artistic-1.0", "artistic control", "to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control", 1.0),
    ("artistic-perl", "under the same terms", "under the same terms as (?:the )?perl(?: 5)?(?: itself)?", 0.8),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 1.0),
    ("unlicense", "unlicense org", "(?:https? )?unlicense org", 0.8),
    ("cc0-1.0", "creativecommons org publicdomain", "creativecommons org publicdomain zero 1 0", 1.0),
    ("cc0-1.0", "statement of purpose", "cc0 1 0 universal(?: ~){0,10}? statement of purpose", 1.0),
    ("cc0-1.0", "associated a work", "the person who associated a work with this deed has dedicated the work to the public domain", 1.0),
    ("cc0-1.0", "waived all copyright", "to the extent possible under law(?: ~){1,12}? (?:has|have) waived all copyright and related or neighboring rights to", 1.0),
    ("cc-pdm-1.0", "public domain mark", "public domain mark(?: 1 0)?", 0.9),
    ("cc-pdm-1.0", "creativecommons org publicdomain", "creativecommons org publicdomain mark 1 0", 1.0),
    ("zlib", "express or implied", "this software is provided as is without any express or implied warranty in no event will the authors? be held liable for any damages arising from the use of this software", 1.0),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", 0.95),
    ("zlib", "altered source", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 0.95),
    ("ijg", "independent jpeg", "this software is based in part on the work of the independent jpeg group", 1.0),
    ("ftl", "freetype", "portions of this software are copyright(?: ~){0,12}? the freetype project", 1.0),
    ("ftl", "freetype", "this file is part of the freetype project and may only be used modified and distributed under the terms of the freetype project license", 1.0),
    ("openssl", "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit", 1.0),
    ("ssleay", "eric young", "this product includes cryptographic software written by eric young", 1.0),
    ("curl", "daniel stenberg", "copyright(?: c)?(?: ~){0,6}? daniel stenberg(?: ~){0,30}? permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", 1.0),
    ("python-2.0", "psf is making", "psf is making python available to licensee on an as is basis", 1.0),
    ("psf-2.0", "python software foundation", "this license agreement is between the python software foundation psf and the individual or organization licensee", 1.0),
    ("ruby", "duplicate all of the original", "you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices", 0.8),
    ("tcl", "existing copyright notices", "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose provided that existing copyright notices are retained in all copies", 1.0),
    ("sleepycat", "complete source code", "redistributions in any form must be accompanied by information on how to obtain complete source code for the", 0.95),
    ("jsli", "not evil", "the software shall be used for good not evil", 1.0),
    ("ofl-1.1", "open font", "this font software is licensed under the sil open font license version 1 1", 1.0),
    ("ofl-1.1", "collaborative font", "the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects", 1.0),
    ("lppl-1.3c", "latex project public", "this work may be distributed and or modified under the conditions of the latex project public license", 1.0),
    ("busl-1.1", "business source", "the business source license this document or the license is not an open source license", 1.0),
    ("busl-1.1", "fourth anniversary", "effective on the change date or the fourth anniversary of the first publicly available distribution of a specific version of the licensed work", 1.0),
    ("elastic-2.0", "hosted or managed service", "you may not provide the software to third parties as a hosted or managed service", 1.0),
    ("commons-clause", "commons clause", "commons clause license condition(?: v?1 0)?", 1.0),
    ("polyform-noncommercial", "polyform", "polyform noncommercial license(?: 1 0 0)?", 1.0),
    ("blueoak-1.0.0", "protecting contributors", "this license gives everyone as much permission to work with this software as possible while protecting contributors from liability", 1.0),
    ("ms-pl", "microsoft", "this license governs use of the accompanying software if you use the software you accept this license(?: ~){0,300}? microsoft public license", 0.9),
    ("qpl-1.0", "q public", "this license applies to any software containing a notice placed by the copyright holder saying that it may be distributed under the terms of the q public license", 1.0),
    ("odbl-1.0", "opendatacommons org", "opendatacommons org licenses odbl", 1.0),
    ("odc-by-1.0", "opendatacommons org", "opendatacommons org licenses by", 1.0),
    ("pddl-1.0", "opendatacommons org", "opendatacommons org licenses pddl", 1.0),
    ("ogl-uk-3.0", "open government", "open government licen[cs]e(?: v(?:ersion)? ?3(?: 0)?)?", 0.9),
    ("all-rights-reserved", "all rights reserved", "all rights reserved(?: ~){0,12}? (?:may not|no part)(?: ~){0,12}? (?:reproduced|copied|distributed)", 0.7),
    ("proprietary", "confidential and proprietary", "confidential and proprietary(?: ~){0,30}? (?:unauthorized|strictly prohibited)", 0.7),
    ("fsfap", "any medium without royalty", "copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved", 1.0),
    ("fsful", "unlimited permission", "this configure script is free software the free software foundation gives unlimited permission to copy distribute and modify it", 1.0),
    ("cc-by-4.0", "creativecommons org licenses", "creativecommons org licenses by 4 0", 1.0),
    ("cc-by-3.0", "creativecommons org licenses", "creativecommons org licenses by 3 0", 1.0),
    ("cc-by-2.0", "creativecommons org licenses", "creativecommons org licenses by 2 [05]", 1.0),
    ("cc-by-sa-4.0", "creativecommons org licenses", "creativecommons org licenses by sa 4 0", 1.0),
    ("cc-by-sa-3.0", "creativecommons org licenses", "creativecommons org licenses by sa 3 0", 1.0),
    ("cc-by-sa-2.0", "creativecommons org licenses", "creativecommons org licenses by sa 2 [05]", 1.0),
    ("cc-by-nc-4.0", "creativecommons org licenses", "creativecommons org licenses by nc 4 0", 1.0),
    ("cc-by-nc-3.0", "creativecommons org licenses", "creativecommons org licenses by nc 3 0", 1.0),
    ("cc-by-nd-4.0", "creativecommons org licenses", "creativecommons org licenses by nd 4 0", 1.0),
    ("cc-by-nd-3.0", "creativecommons org licenses", "creativecommons org licenses by nd 3 0", 1.0),
    ("cc-by-nc-sa-4.0", "creativecommons org licenses", "creativecommons org licenses by nc sa 4 0", 1.0),
    ("cc-by-nc-sa-3.0", "creativecommons org licenses", "creativecommons org licenses by nc sa 3 0", 1.0),
    ("cc-by-nc-nd-4.0", "creativecommons org licenses", "creativecommons org licenses by nc nd 4 0", 1.0),
    ("cc-by-nc-nd-3.0", "creativecommons org licenses", "creativecommons org licenses by nc nd 3 0", 1.0),
    ("cc-by-sa-4.0", "cc by sa", "cc by sa 4 0(?: international)?", 0.95),
    ("cc-by-sa-3.0", "cc by sa", "cc by sa 3 0(?: unported)?", 0.95),
    ("cc-by-sa", "cc by sa", "cc by sa", 0.8),
    ("cc-by-nc-sa-4.0", "cc by nc sa", "cc by nc sa 4 0(?: international)?", 0.95),
    ("cc-by-nc-sa-3.0", "cc by nc sa", "cc by nc sa 3 0(?: unported)?", 0.95),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa", 0.8),
    ("cc-by-nc-nd-4.0", "cc by nc nd", "cc by nc nd 4 0(?: international)?", 0.95),
    ("cc-by-nc-nd-3.0", "cc by nc nd", "cc by nc nd 3 0(?: unported)?", 0.95),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd", 0.8),
    ("cc-by-nc-4.0", "cc by nc", "cc by nc 4 0(?: international)?", 0.95),
    ("cc-by-nc-3.0", "cc by nc", "cc by nc 3 0(?: unported)?", 0.95),
    ("cc-by-nc", "cc by nc", "cc by nc", 0.8),
    ("cc-by-nd-4.0", "cc by nd", "cc by nd 4 0(?: international)?", 0.95),
    ("cc-by-nd-3.0", "cc by nd", "cc by nd 3 0(?: unported)?", 0.95),
    ("cc-by-nd", "cc by nd", "cc by nd", 0.8),
    ("cc-by-4.0", "cc by 4", "cc by 4 0(?: international)?", 0.95),
    ("cc-by-3.0", "cc by 3", "cc by 3 0(?: unported)?", 0.95),
    ("cc-by-2.0", "cc by 2", "cc by 2 [05](?: generic)?", 0.95),
    ("cc-by-4.0", "attribution 4 0 international", "creative commons attribution 4 0 international public license", 1.0),
    ("cc-by-sa-4.0", "sharealike 4 0", "creative commons attribution sharealike 4 0 international public license", 1.0),
    ("cc-by-nc-4.0", "noncommercial 4 0", "creative commons attribution noncommercial 4 0 international public license", 1.0),
    ("cc-by-nd-4.0", "noderivatives 4 0", "creative commons attribution noderivatives 4 0 international public license", 1.0),
    ("cc-by-nc-sa-4.0", "noncommercial sharealike", "creative commons attribution noncommercial sharealike 4 0 international public license", 1.0),
    ("cc-by-nc-nd-4.0", "noncommercial noderivatives", "creative commons attribution noncommercial noderivatives 4 0 international public license", 1.0),
]

#: Wordings by priority, the best first: text around NAME or ID (ANY stands for any identifier), what the text must hold besides, confidence.
WORDINGS = [
    (1, "spdx licen[cs]e identifier ID", "spdx", 1.0),
    (1, "(?:ANY) (?:and|or) ID", "spdx licen", 1.0),
    (1, "(?:opensource|spdx) org licenses ID", "org licenses", 0.95),
    (2, "(?:licen[cs]ed|released|distributed|available|published|provided) under(?: the)?(?: terms (?:and conditions )?of)?(?: the)? NAME", "under", 0.9),
    (2, "(?:subject to|governed by|covered by|see)(?: the)?(?: terms (?:and conditions )?of)?(?: the)? NAME", None, 0.8),
    (3, "NAME", None, 0.6),
]
LEVELS = 4
#: What a text must contain, in any case of A-Z, for any rule or phrase to have a chance: one of the words, or one of the pairs with no letter or digit between.
GATE_WORDS = ("licen", "spdx", "software", "copyright", "creative", "cc0", "bsd", "permission", "permitted", "exception", "terms", "misrepresent", "unencumber", "redistribut", "mozilla", "eclipse", "rights", "proprietary")
GATE_PAIRS = (("cc", "by"), ("public", "domain"), ("mit", "no"))
GATE = "(?i)" + "|".join([*GATE_WORDS, *(rf"{a}[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+{b}" for a, b in GATE_PAIRS)])


def passes_gate(text: Column) -> Column:
    """Whether ``GATE`` matches. Plain searches for words cost a fraction of the alternation; the regular expressions of pairs are tried where their first word is."""

    def of_lower(low: Column) -> Column:
        found = F.lit(False)
        for w in GATE_WORDS:
            found = found | F.contains(low, F.lit(w))
        for a, b in GATE_PAIRS:
            found = found | (F.contains(low, F.lit(a)) & low.rlike(f"{a}[^0-9a-z]+{b}"))
        return found

    return _let(F.lower(text), of_lower)


@dataclass(frozen=True)
class Rule:
    id: int
    label: str
    priority: int
    context: str
    keyword: str
    pattern: str
    confidence: float


def rules() -> list[Rule]:
    """All signature rules in order; the phrases of ``BASE`` are the last."""
    every = "|".join(spdx for *_, spdx in LICENSES)
    made = [(label, 1, "", keyword, pattern, c) for label, keyword, pattern, c in GRANTS]
    made += [(label, p, own or "", spdx.split()[0] if "ID" in text else keyword, text.replace("NAME", name).replace("ID", spdx).replace("ANY", every), c) for p, text, own, c in WORDINGS for label, keyword, name, spdx in LICENSES]
    made += [(label, LEVELS, "", phrase, phrase, 0.5) for phrase, label in BASE.items()]
    return [Rule(i, label, p, f" {own}", f" {keyword}".replace(" *", ""), pattern.replace("~", r"\S+"), c) for i, (label, p, own, keyword, pattern, c) in enumerate(made)]


def tagged(pattern: str) -> str:
    """A pattern over words as one over tagged words ("word#number")."""
    return "(?<= )" + pattern.replace(" ?", "(?:#[0-9]+ )?").replace(" ", "#[0-9]+ ").replace("(?:#[0-9]+#[0-9]+ )?", "(?:#[0-9]+ )?") + "#[0-9]+(?= )"


def _let(value: Column, body) -> Column:  # noqa: ANN001
    return F.element_at(F.transform(F.array(value), body), 1)


def spaced(text: Column) -> Column:
    """The words with one space before, between and after them; a single space if there is none."""
    return F.concat(F.lit(" "), F.ltrim(F.concat(F.trim(F.regexp_replace(lower_ascii(text), NO_WORD, " ")), F.lit(" "))))


def _detections(norm: Column) -> Column:
    """Sorted ``array<struct<start, minus_end, priority, rule, label, confidence>>``, by start, the longest first."""
    # one literal: a few hundred expressions would cost more to plan than to run
    rows = json.dumps([asdict(r) | {"pattern": tagged(r.pattern)} for r in rules()])
    table = F.from_json(F.lit(rows), "array<struct<id:int,label:string,priority:int,context:string,keyword:string,pattern:string,confidence:double>>")

    def found(tags: Column) -> Column:
        tried = F.filter(table, lambda r: F.contains(norm, r["keyword"]) & F.contains(norm, r["context"]))
        number = lambda m, end: F.regexp_extract(m, r"#([0-9]+)$" if end else r"#([0-9]+)", 1).cast("long")
        each = lambda r: F.transform(F.regexp_extract_all(tags, r["pattern"], F.lit(0)), lambda m: F.struct(number(m, False).alias("start"), (-number(m, True) - 1).alias("minus_end"), r["priority"].alias("priority"), r["id"].alias("rule"), r["label"].alias("label"), r["confidence"].alias("confidence")))
        return F.array_sort(F.flatten(F.transform(tried, each)))

    tags = F.concat(F.lit(" "), F.array_join(F.transform(F.split(F.trim(norm), " "), lambda w, i: F.concat(w, F.lit("#"), i.cast("string"))), " "), F.lit(" "))
    return _let(tags, found)


def _verdict(detections: Column) -> Column:
    """Labels and best confidence of the detections that no other suppresses, in one pass over them in order.

    A containing span comes first in the order, so the largest end so far of each priority is all that is needed.
    """
    ends = F.array(*(F.lit(-1).cast("long") for _ in range(LEVELS)))
    start = F.struct(ends.alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(a: Column, d: Column) -> Column:
        end = -d["minus_end"]
        hidden = F.exists(F.slice(a["ends"], F.lit(1), d["priority"]), lambda e: e >= end)
        kept = F.struct(
            F.transform(a["ends"], lambda e, i: F.when(i + 1 == d["priority"], F.greatest(e, end)).otherwise(e)).alias("ends"),
            F.array_union(a["labels"], F.array(d["label"])).alias("labels"),
            F.greatest(a["score"], d["confidence"]).alias("score"),
        )
        return F.when(hidden, a).otherwise(kept)

    return F.aggregate(detections, start, step)


def _spaces(s: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")


def license_scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)``, a row for each row of ``docs``.

    No shuffle, and text without any of the gate's words costs two scans of it. Null texts count as empty: no words, no labels,
    score 0, null first and last word. Equal texts and repeated rows give equal values, also with null ids; detections that tie in span and
    priority go by rule number and count once a label. A very long text is scanned whole; only one that passes the gate is held as words. Columns other
    than id and text are not read, whatever their names; an empty table gives an empty one.
    """
    body = F.coalesce(F.col("_text"), F.lit(""))
    phrase_start = " (?=(?:" + "|".join(map(re.escape, BASE)).replace("\\ ", " ") + ") )"

    def judge(norm: Column) -> Column:
        base = lambda s, n: F.struct((F.size(s) - 1).cast("long").alias("n_base"), F.when(F.size(s) > 1, _spaces(F.get(s, F.lit(0)))).alias("first_word"), F.when(F.size(s) > 1, n - _spaces(F.element_at(s, -1))).alias("last_word"))
        names = F.array_sort(F.array_compact(F.array(*(F.when(F.contains(norm, F.lit(f" {p} ")), F.lit(label)) for p, label in BASE.items()))))
        return F.struct(_let(F.split(norm, phrase_start), lambda s: base(s, _spaces(norm) - 1)).alias("base"), names.alias("names"), _verdict(_detections(norm)).alias("verdict"))

    scanned = docs.select(F.col(id_col), F.col(text).alias("_text")).select(
        id_col,
        count_words(F.col("_text"), RAW_SEPARATORS).alias("n_words"),
        F.when(passes_gate(body), _let(spaced(body), judge)).alias("f"),
    )
    names, found = F.coalesce("f.names", F.array().cast("array<string>")), F.coalesce("f.verdict.labels", F.array().cast("array<string>"))
    return scanned.select(
        id_col, "n_words", F.coalesce("f.base.n_base", F.lit(0)).cast("long").alias("n_base"), F.col("f.base.first_word").alias("first_word"), F.col("f.base.last_word").alias("last_word"),
        F.array_join(names, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(names, found)), ",").alias("labels"), F.coalesce("f.verdict.score", F.lit(0.0)).alias("score"),
    )


def license_detections(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(id, row, start, end, label, priority, rule, confidence)``: each unsuppressed detection as a span of word numbers.

    ``row`` tells rows with equal ids apart. Suppression is a running maximum, linear in the number of detections.
    """
    gated = docs.select(F.col(id_col), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("row")).where(passes_gate(F.col("_text")))
    each = gated.select(id_col, "row", F.explode(_let(spaced(F.col("_text")), _detections)).alias("d")).select(id_col, "row", "d.start", (-F.col("d.minus_end")).alias("end"), "d.priority", "d.rule", "d.label", "d.confidence")
    before = W.partitionBy("row").orderBy("start", F.desc("end"), "priority", "rule").rowsBetween(W.unboundedPreceding, -1)
    hidden = F.lit(False)
    for p in range(1, LEVELS + 1):
        reach = F.max(F.when(F.col("priority") <= p, F.col("end"))).over(before)
        hidden = hidden | ((F.col("priority") == p) & F.coalesce(reach >= F.col("end"), F.lit(False)))
    return each.withColumn("hidden", hidden).where("not hidden").select(id_col, "row", "start", "end", "label", "priority", "rule", "confidence")
