"""Signature rules for licence texts, notices, names, tags and addresses.

A rule is (licence, priority, keywords, pattern). The pattern is matched without regard to
case; a space in it stands for any run of white space and comment signs. It can only match
where all words of one of its keywords (lower case) occur, so each alternative of a pattern
needs a keyword; that is what the prefilter relies on.
Priorities: 90 clauses that identify a licence's text, 80 SPDX tags, 70 names with their
version, 60 addresses, 50 bare names beside "licence", 20 unspecific notices.
"""

from __future__ import annotations

TEXT, TAG, NAME, LINK, SHORT, VAGUE = 90, 80, 70, 60, 50, 20

_L = r"licen[sc]e"
_BLANK = r"\n[ *#;/%]*\n"
_V = r"(?:,? (?:version|v\.?|ver\.?) ?| v?)"



def _until(*stops: str) -> str:
    """A gap over lines and comment signs, as short as it can be, that doesn't enter any of the stops."""
    return rf"(?:(?!{'|'.join(stops)})[\s\S])*?"


#: Clauses found in one licence's text or standard header only.
TEXTS = [
    ("MIT", ("permission is hereby granted",), r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", ("the software is provided",), r"the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability"),
    ("MIT-0", ("without restriction",), r"to deal in the software without restriction, including without limitation the rights to use[^.]*?persons to whom the software is furnished to do so\.(?! subject)"),
    ("ISC", ("permission to use",), r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above"),
    ("0BSD", ("permission to use",), r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\."),
    ("BSD-3-Clause", ("neither the name",), rf"neither the names? of {_until('neither the names? of', 'this software is provided')} nor the names of (?:its|their|any) contributors may be used to endorse or promote products"),
    ("BSD-2-Clause", ("redistributions in binary",), r"redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution\."),
    ("BSD-4-Clause", ("all advertising",), r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("Apache-2.0", ("you may not use this file",), r"licensed under the apache license, version 2\.0 \(the \"license\"\); you may not use this file except in compliance with the license"),
    ("Apache-2.0", ("terms and conditions for use",), rf"apache license,? version 2\.0, january 2004{_until('january 2004', 'definitions')}terms and conditions for use, reproduction, and distribution"),
    ("Apache-1.1", ("apache software foundation",), r"this product includes software developed by the apache software foundation"),
    ("GPL-2.0-or-later", ("either version 2",), r"under the terms of the gnu general public license as published by the free software foundation[;,] either version 2 of the license,? or \(at your option\) any later version"),
    ("GPL-3.0-or-later", ("either version 3",), r"under the terms of the gnu general public license as published by the free software foundation[;,] either version 3 of the license,? or \(at your option\) any later version"),
    ("GPL-2.0-only", ("general public license",), r"under the terms of (?:version 2 of the gnu general public license|the gnu general public license,? version 2,? (?:only )?as published)"),
    ("GPL-3.0-only", ("general public license",), r"under the terms of (?:version 3 of the gnu general public license|the gnu general public license,? version 3,? (?:only )?as published)"),
    ("LGPL-2.1-or-later", ("lesser general",), r"under the terms of the gnu lesser general public license as published by the free software foundation[;,] either version 2\.1 of the license,? or"),
    ("LGPL-3.0-or-later", ("lesser general",), r"under the terms of the gnu lesser general public license as published by the free software foundation[;,] either version 3 of the license,? or"),
    ("LGPL-2.0-or-later", ("library general",), r"under the terms of the gnu library general public license as published by the free software foundation[;,] either version 2 of the license,? or"),
    ("AGPL-3.0-or-later", ("affero",), r"under the terms of the gnu affero general public license as published by the free software foundation[;,] either version 3 of the license,? or"),
    ("GFDL-1.3-or-later", ("free documentation",), r"under the terms of the gnu free documentation license,? version 1\.3 or any later version"),
    ("GFDL-1.2-or-later", ("free documentation",), r"under the terms of the gnu free documentation license,? version 1\.2 or any later version"),
    ("MPL-2.0", ("source code form",), r"this source code form is subject to the terms of the mozilla public license,? v(?:ersion|\.)? ?2\.0"),
    ("MPL-1.1", ("mozilla public",), r"subject to the mozilla public license version 1\.1 \(the \"license\"\)"),
    ("EPL-1.0", ("eclipse public",), r"made available under the terms of the eclipse public license v(?:ersion)? ?1\.0"),
    ("EPL-2.0", ("eclipse public",), r"made available under the terms of the eclipse public license (?:v(?:ersion)? ?)?2\.0"),
    ("Unlicense", ("unencumbered",), r"this is free and unencumbered software released into the public domain"),
    ("WTFPL", ("what the fuck",), r"do what the fuck you want to public license"),
    ("Zlib", ("authors be held liable",), r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("Zlib", ("must not be misrepresented",), r"the origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("BSL-1.0", ("machine-executable",), r"all derivative works of the software, unless such copies or derivative works are solely in the form of machine-executable object code"),
    ("CC0-1.0", ("waived all copyright",), r"waived all copyright and related (?:or|and) neighbou?ring rights"),
    ("OFL-1.1", ("reserved font name",), r"no modified version of the font software may use the reserved font name"),
    ("OFL-1.1", ("open font",), r"this font software is licensed under the sil open font license,? version 1\.1"),
    ("PostgreSQL", ("without a written agreement",), r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("PSF-2.0", ("python software foundation",), r"this license agreement is between the python software foundation"),
    ("OpenSSL", ("openssl toolkit",), r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("curl", ("copyright notice and this permission",), r"permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Beerware", ("buy me a beer",), r"you can buy me a beer in return"),
    ("JSON", ("good, not evil",), r"shall be used for good, not evil"),
    ("Ms-PL", ("microsoft public",), rf"microsoft public license{_until('this license governs', 'microsoft [a-z]+ license', 'definitions')}this license governs use of the accompanying software|this license governs use of the accompanying software{_until('this license governs', 'definitions')}microsoft public license"),
    ("Artistic-2.0", ("artistic license",), r"the artistic license 2\.0 copyright"),
    ("CDDL-1.0", ("development and distribution",), r"subject to the terms of the common development and distribution license"),
    ("EUPL-1.2", ("eupl", "european union public"), r"licensed under the eupl,? version 1\.2|european union public licence v\. ?1\.2"),
    ("X11", ("name of the x consortium",), r"except as contained in this notice, the name of the x consortium shall not be used"),
    ("NCSA", ("documentation files",), r"documentation files \(the \"software\"\), to deal(?:ing)? with the software without restriction"),
    ("HPND", ("documentation for any purpose",), r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose (?:and|with) "),
    ("SSPL-1.0", ("server side public",), r"under the terms of the server side public license,? version 1"),
    ("BUSL-1.1", ("change date",), rf"licensed work will be made available{_until('licensed work will be', _BLANK)}change date|effective on the change date, or the fourth anniversary of the first publicly available distribution"),
    ("Elastic-2.0", ("elastic license",), r"licensed under the elastic license 2\.0"),
    ("Vim", ("vim license",), r"this license applies to copies of vim|vim license"),
]

#: Names in running text, hand-written; {v} is one or more spellings of "version".
NAMES = [
    ("MIT", ("mit ",), rf"\b(?:the )?mit(?:/x11|[ -]style)? {_L}"),
    ("MIT", ("expat",), rf"\bexpat {_L}"),
    ("X11", ("x11",), rf"\bx11 {_L}"),
    ("MIT-0", ("no attribution",), rf"\bmit no attribution(?: {_L})?"),
    ("ISC", ("isc ",), rf"\bisc {_L}"),
    ("BSD-2-Clause", ("bsd", "simplified"), rf"\b(?:2|two)[- ]clause bsd {_L}|\b(?:simplified|freebsd) bsd? ?{_L}|\bbsd[- ]2[- ]clause\b"),
    ("BSD-3-Clause", ("bsd",), rf"\b(?:3|three)[- ]clause bsd {_L}|\b(?:new|modified|revised) bsd {_L}|\bbsd[- ]3[- ]clause\b"),
    ("BSD-4-Clause", ("bsd",), rf"\b(?:4|four)[- ]clause bsd {_L}|\b(?:original|old) bsd {_L}|\bbsd[- ]4[- ]clause\b"),
    ("0BSD", ("bsd",), rf"\b(?:zero|0)[- ]clause bsd {_L}|\b0bsd\b"),
    ("Apache-2.0", ("apache",), rf"\bapache(?: software)?(?: {_L})?{_V}2(?:\.0)?\b(?: {_L})?"),
    ("Apache-1.1", ("apache",), rf"\bapache(?: software)? {_L}{_V}1\.1\b"),
    ("Apache-1.0", ("apache",), rf"\bapache(?: software)? {_L}{_V}1\.0\b"),
    ("GPL-1.0", ("general public",), rf"\bgnu general public {_L}{_V}1(?:\.0)?\b"),
    ("GPL-2.0-or-later", ("general public",), rf"\bgnu general public {_L}{_V}2(?:\.0)? or (?:any )?later"),
    ("GPL-2.0-only", ("general public",), rf"\bgnu general public {_L}{_V}2(?:\.0)?\b"),
    ("GPL-3.0-or-later", ("general public",), rf"\bgnu general public {_L}{_V}3(?:\.0)? or (?:any )?later"),
    ("GPL-3.0-only", ("general public",), rf"\bgnu general public {_L}{_V}3(?:\.0)?\b"),
    ("GPL-2.0-or-later", ("gpl",), r"\b(?:gnu )?gpl[- ]?v?2(?:\.0)?(?:\+| or (?:any )?later)"),
    ("GPL-2.0-only", ("gpl",), r"\b(?:gnu )?gpl[- ]?(?:version )?v?2(?:\.0)?\b"),
    ("GPL-3.0-or-later", ("gpl",), r"\b(?:gnu )?gpl[- ]?v?3(?:\.0)?(?:\+| or (?:any )?later)"),
    ("GPL-3.0-only", ("gpl",), r"\b(?:gnu )?gpl[- ]?(?:version )?v?3(?:\.0)?\b"),
    ("LGPL-2.0", ("library general",), rf"\bgnu library general public {_L}(?:{_V}2(?:\.0)?\b)?"),
    ("LGPL-2.1", ("lesser general",), rf"\bgnu lesser general public {_L}{_V}2\.1\b"),
    ("LGPL-3.0", ("lesser general",), rf"\bgnu lesser general public {_L}{_V}3(?:\.0)?\b"),
    ("LGPL-2.1", ("lgpl",), r"\b(?:gnu )?lgpl[- ]?v?2\.1\+?"),
    ("LGPL-3.0", ("lgpl",), r"\b(?:gnu )?lgpl[- ]?v?3(?:\.0)?\+?"),
    ("AGPL-3.0", ("affero",), rf"\b(?:gnu )?affero general public {_L}(?:{_V}3(?:\.0)?\b)?"),
    ("AGPL-3.0", ("agpl",), r"\b(?:gnu )?agpl[- ]?v?3(?:\.0)?\+?"),
    ("GFDL-1.1", ("free documentation",), rf"\bgnu free documentation {_L}{_V}1\.1\b"),
    ("GFDL-1.2", ("free documentation",), rf"\bgnu free documentation {_L}{_V}1\.2\b"),
    ("GFDL-1.3", ("free documentation",), rf"\bgnu free documentation {_L}{_V}1\.3\b"),
    ("MPL-1.0", ("mozilla public",), rf"\bmozilla public {_L}{_V}1\.0\b"),
    ("MPL-1.1", ("mozilla public",), rf"\bmozilla public {_L}{_V}1\.1\b"),
    ("MPL-2.0", ("mozilla public",), rf"\bmozilla public {_L}{_V}2(?:\.0)?\b"),
    ("MPL-2.0", ("mpl",), r"\bmpl[- ]?v?2(?:\.0)?\b"),
    ("EPL-1.0", ("eclipse public",), rf"\beclipse public {_L}{_V}1\.0\b"),
    ("EPL-2.0", ("eclipse public",), rf"\beclipse public {_L}{_V}2(?:\.0)?\b"),
    ("EPL-2.0", ("epl",), r"\bepl[- ]?v?2(?:\.0)?\b"),
    ("CDDL-1.0", ("development and distribution",), rf"\bcommon development and distribution {_L}(?:{_V}1\.0\b)?"),
    ("CDDL-1.1", ("development and distribution",), rf"\bcommon development and distribution {_L}{_V}1\.1\b"),
    ("CPL-1.0", ("common public",), rf"\bcommon public {_L}(?:{_V}1\.0\b)?"),
    ("IPL-1.0", ("ibm public",), rf"\bibm public {_L}(?:{_V}1\.0\b)?"),
    ("APSL-2.0", ("apple public",), rf"\bapple public source {_L}(?:{_V}2\.0\b)?"),
    ("Artistic-1.0", ("artistic",), rf"\bartistic {_L}{_V}1\.0\b"),
    ("Artistic-2.0", ("artistic",), rf"\bartistic {_L}{_V}2(?:\.0)?\b"),
    ("AFL-3.0", ("academic free",), rf"\bacademic free {_L}(?:{_V}3(?:\.0)?\b)?"),
    ("OSL-3.0", ("open software",), rf"\bopen software {_L}{_V}3(?:\.0)?\b"),
    ("BSL-1.0", ("boost",), rf"\bboost software {_L}(?:{_V}1\.0\b)?"),
    ("BUSL-1.1", ("business source",), rf"\bbusiness source {_L}(?:{_V}1\.1\b)?"),
    ("SSPL-1.0", ("server side public",), rf"\bserver side public {_L}(?:{_V}1(?:\.0)?\b)?"),
    ("Elastic-2.0", ("elastic",), rf"\belastic {_L}(?:{_V}2(?:\.0)?\b)?"),
    ("Unlicense", ("unlicense",), r"\bthe unlicense\b"),
    ("WTFPL", ("wtfpl",), r"\bwtfpl\b(?: v(?:ersion)? ?2)?"),
    ("Zlib", ("zlib",), rf"\bzlib(?:/libpng)? {_L}"),
    ("libpng-2.0", ("libpng",), rf"(?<!/)\blibpng {_L}(?:{_V}2\b)?"),
    ("PostgreSQL", ("postgresql",), rf"\bpostgresql {_L}"),
    ("PSF-2.0", ("python software",), rf"\bpython software foundation {_L}(?:{_V}2\b)?"),
    ("PHP-3.01", ("php",), rf"\bphp {_L}(?:{_V}3\.01\b)?"),
    ("Ruby", ("ruby",), rf"\bruby {_L}"),
    ("OpenSSL", ("openssl",), rf"\bopenssl {_L}"),
    ("NCSA", ("ncsa",), rf"\b(?:university of illinois/)?ncsa open source {_L}"),
    ("Ms-PL", ("microsoft public", "ms-pl"), rf"\bmicrosoft public {_L}|\bms-pl\b"),
    ("Ms-RL", ("microsoft reciprocal",), rf"\bmicrosoft reciprocal {_L}"),
    ("OFL-1.1", ("open font",), rf"\b(?:sil )?open font {_L}(?:{_V}1\.1\b)?"),
    ("EUPL-1.1", ("european union public",), rf"\beuropean union public {_L}{_V}1\.1\b"),
    ("EUPL-1.2", ("european union public",), rf"\beuropean union public {_L}(?:{_V}1\.2\b)?"),
    ("CECILL-2.1", ("cecill",), r"\bcecill(?:-| v?)2\.1\b"),
    ("CECILL-B", ("cecill",), r"\bcecill-b\b"),
    ("CECILL-C", ("cecill",), r"\bcecill-c\b"),
    ("LPPL-1.3c", ("latex project",), rf"\blatex project public {_L}(?:{_V}1\.3c?\b)?"),
    ("Vim", ("vim ",), rf"\bvim {_L}"),
    ("Beerware", ("beerware",), rf"\bbeerware(?: {_L})?"),
    ("CC0-1.0", ("cc0",), r"\bcc0(?:[- ]1\.0)?(?: universal)?\b"),
    ("CC0-1.0", ("creative commons",), r"\bcreative commons (?:cc0|zero)(?: v?1\.0)?(?: universal)?"),
    ("CC-BY-1.0", ("cc by", "cc-by"), r"\bcc[- ]by[- ]1\.0\b"),
    ("CC-BY-2.0", ("cc by", "cc-by"), r"\bcc[- ]by[- ]2\.0\b"),
    ("CC-BY-2.5", ("cc by", "cc-by"), r"\bcc[- ]by[- ]2\.5\b"),
    ("CC-BY-3.0", ("cc by", "cc-by"), r"\bcc[- ]by[- ]3\.0\b"),
    ("CC-BY-4.0", ("cc by", "cc-by"), r"\bcc[- ]by[- ]4\.0\b"),
    ("CC-BY-SA-2.0", ("cc by", "cc-by"), r"\bcc[- ]by-sa[- ]2\.0\b"),
    ("CC-BY-SA-2.5", ("cc by", "cc-by"), r"\bcc[- ]by-sa[- ]2\.5\b"),
    ("CC-BY-SA-3.0", ("cc by", "cc-by"), r"\bcc[- ]by-sa[- ]3\.0\b"),
    ("CC-BY-SA-4.0", ("cc by", "cc-by"), r"\bcc[- ]by-sa[- ]4\.0\b"),
    ("CC-BY-NC-2.0", ("cc by", "cc-by"), r"\bcc[- ]by-nc[- ]2\.0\b"),
    ("CC-BY-NC-3.0", ("cc by", "cc-by"), r"\bcc[- ]by-nc[- ]3\.0\b"),
    ("CC-BY-NC-4.0", ("cc by", "cc-by"), r"\bcc[- ]by-nc[- ]4\.0\b"),
    ("CC-BY-ND-3.0", ("cc by", "cc-by"), r"\bcc[- ]by-nd[- ]3\.0\b"),
    ("CC-BY-ND-4.0", ("cc by", "cc-by"), r"\bcc[- ]by-nd[- ]4\.0\b"),
    ("CC-BY-NC-SA-3.0", ("cc by", "cc-by"), r"\bcc[- ]by-nc-sa[- ]3\.0\b"),
    ("CC-BY-NC-SA-4.0", ("cc by", "cc-by"), r"\bcc[- ]by-nc-sa[- ]4\.0\b"),
    ("CC-BY-NC-ND-3.0", ("cc by", "cc-by"), r"\bcc[- ]by-nc-nd[- ]3\.0\b"),
    ("CC-BY-NC-ND-4.0", ("cc by", "cc-by"), r"\bcc[- ]by-nc-nd[- ]4\.0\b"),
    ("CC-BY-3.0", ("creative commons",), rf"\bcreative commons attribution(?: {_L})? 3\.0(?: unported| international)?(?: {_L})?"),
    ("CC-BY-4.0", ("creative commons",), rf"\bcreative commons attribution(?: {_L})? 4\.0(?: international)?(?: {_L})?"),
    ("CC-BY-SA-3.0", ("creative commons",), rf"\bcreative commons attribution[- ]share-?alike 3\.0(?: unported)?(?: {_L})?"),
    ("CC-BY-SA-4.0", ("creative commons",), rf"\bcreative commons attribution[- ]share-?alike 4\.0(?: international)?(?: {_L})?"),
    ("CC-BY-NC-3.0", ("creative commons",), rf"\bcreative commons attribution[- ]non-?commercial 3\.0(?: unported)?(?: {_L})?"),
    ("CC-BY-NC-4.0", ("creative commons",), rf"\bcreative commons attribution[- ]non-?commercial 4\.0(?: international)?(?: {_L})?"),
    ("CC-BY-ND-4.0", ("creative commons",), rf"\bcreative commons attribution[- ]no-?deriv(?:ative)?s 4\.0(?: international)?(?: {_L})?"),
    ("CC-BY-NC-SA-4.0", ("creative commons",), rf"\bcreative commons attribution[- ]non-?commercial[- ]share-?alike 4\.0(?: international)?(?: {_L})?"),
    ("CC-BY-NC-ND-4.0", ("creative commons",), rf"\bcreative commons attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s 4\.0(?: international)?(?: {_L})?"),
    ("ODbL-1.0", ("open database",), rf"\bopen (?:data commons )?open database {_L}|\bopen database {_L}(?:{_V}1\.0\b)?"),
    ("PDDL-1.0", ("public domain dedication",), r"\bpublic domain dedication and licen[sc]e\b"),
    ("ODC-By-1.0", ("open data commons",), rf"\bopen data commons attribution {_L}"),
    ("OpenRAIL-M", ("openrail", "open rail"), r"\b(?:big(?:science|code) )?open ?rail(?:-m)?\b"),
    ("Public-Domain", ("public domain",), r"\b(?:released|placed|dedicated|put) (?:in|into|to|under) the public domain\b"),
]

#: Addresses at which a licence's text stands.
LINKS = [
    ("MIT", ("opensource.org",), r"(?:https?://)?(?:www\.)?opensource\.org/licen[sc]es?/mit(?:-license)?(?:\.php|\.html)?"),
    ("ISC", ("opensource.org",), r"(?:https?://)?(?:www\.)?opensource\.org/licen[sc]es?/isc(?:-license)?(?:\.txt)?"),
    ("BSD-2-Clause", ("opensource.org",), r"(?:https?://)?(?:www\.)?opensource\.org/licen[sc]es?/bsd-2-clause"),
    ("BSD-3-Clause", ("opensource.org",), r"(?:https?://)?(?:www\.)?opensource\.org/licen[sc]es?/bsd-3-clause"),
    ("Artistic-2.0", ("opensource.org",), r"(?:https?://)?(?:www\.)?opensource\.org/licen[sc]es?/artistic-license-2\.0"),
    ("Zlib", ("opensource.org",), r"(?:https?://)?(?:www\.)?opensource\.org/licen[sc]es?/zlib(?:-license)?"),
    ("NCSA", ("opensource.org",), r"(?:https?://)?(?:www\.)?opensource\.org/licen[sc]es?/ncsa"),
    ("CDDL-1.0", ("opensource.org",), r"(?:https?://)?(?:www\.)?opensource\.org/licen[sc]es?/cddl-?1(?:\.0)?"),
    ("Ms-PL", ("opensource.org",), r"(?:https?://)?(?:www\.)?opensource\.org/licen[sc]es?/ms-pl"),
    ("AFL-3.0", ("opensource.org",), r"(?:https?://)?(?:www\.)?opensource\.org/licen[sc]es?/afl-3\.0"),
    ("OSL-3.0", ("opensource.org",), r"(?:https?://)?(?:www\.)?opensource\.org/licen[sc]es?/osl-3\.0"),
    ("Apache-2.0", ("apache.org",), r"(?:https?://)?(?:www\.)?apache\.org/licen[sc]es/license-2\.0(?:\.txt|\.html)?"),
    ("Apache-1.1", ("apache.org",), r"(?:https?://)?(?:www\.)?apache\.org/licen[sc]es/license-1\.1"),
    ("GPL-2.0-only", ("gnu.org",), r"(?:https?://)?(?:www\.)?gnu\.org/licen[sc]es/(?:old-licen[sc]es/)?gpl-2\.0(?:\.txt|\.html)?"),
    ("GPL-3.0-only", ("gnu.org",), r"(?:https?://)?(?:www\.)?gnu\.org/licen[sc]es/gpl-3\.0(?:\.txt|\.html)?"),
    ("LGPL-2.1", ("gnu.org",), r"(?:https?://)?(?:www\.)?gnu\.org/licen[sc]es/(?:old-licen[sc]es/)?lgpl-2\.1(?:\.txt|\.html)?"),
    ("LGPL-3.0", ("gnu.org",), r"(?:https?://)?(?:www\.)?gnu\.org/licen[sc]es/lgpl-3\.0(?:\.txt|\.html)?"),
    ("AGPL-3.0", ("gnu.org",), r"(?:https?://)?(?:www\.)?gnu\.org/licen[sc]es/agpl-3\.0(?:\.txt|\.html)?"),
    ("GFDL-1.3", ("gnu.org",), r"(?:https?://)?(?:www\.)?gnu\.org/licen[sc]es/fdl-1\.3(?:\.txt|\.html)?"),
    ("GPL", ("gnu.org",), r"(?:https?://)?(?:www\.)?gnu\.org/licen[sc]es/gpl\.(?:txt|html)"),
    ("MPL-1.1", ("mozilla.org",), r"(?:https?://)?(?:www\.)?mozilla\.org/mpl/1\.1"),
    ("MPL-2.0", ("mozilla.org",), r"(?:https?://)?(?:www\.)?mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("EPL-1.0", ("eclipse.org",), r"(?:https?://)?(?:www\.)?eclipse\.org/legal/epl-v10(?:\.html)?"),
    ("EPL-2.0", ("eclipse.org",), r"(?:https?://)?(?:www\.)?eclipse\.org/legal/epl-(?:2\.0|v20)(?:\.html)?"),
    ("BSL-1.0", ("boost.org",), r"(?:https?://)?(?:www\.)?boost\.org/license_1_0\.txt"),
    ("Unlicense", ("unlicense.org",), r"(?:https?://)?(?:www\.)?unlicense\.org"),
    ("WTFPL", ("wtfpl.net",), r"(?:https?://)?(?:www\.|sam\.zoy\.org/)?wtfpl\.net"),
    ("OFL-1.1", ("scripts.sil.org",), r"(?:https?://)?scripts\.sil\.org/ofl"),
    ("PHP-3.01", ("php.net",), r"(?:https?://)?(?:www\.)?php\.net/license/3_01\.txt"),
    ("CC0-1.0", ("creativecommons.org",), r"(?:https?://)?(?:www\.)?creativecommons\.org/publicdomain/zero/1\.0"),
    ("Public-Domain", ("creativecommons.org",), r"(?:https?://)?(?:www\.)?creativecommons\.org/publicdomain/mark/1\.0"),
    ("CC-BY-2.0", ("creativecommons.org",), r"(?:https?://)?(?:www\.)?creativecommons\.org/licenses/by/2\.0"),
    ("CC-BY-3.0", ("creativecommons.org",), r"(?:https?://)?(?:www\.)?creativecommons\.org/licenses/by/3\.0"),
    ("CC-BY-4.0", ("creativecommons.org",), r"(?:https?://)?(?:www\.)?creativecommons\.org/licenses/by/4\.0"),
    ("CC-BY-SA-2.0", ("creativecommons.org",), r"(?:https?://)?(?:www\.)?creativecommons\.org/licenses/by-sa/2\.0"),
    ("CC-BY-SA-3.0", ("creativecommons.org",), r"(?:https?://)?(?:www\.)?creativecommons\.org/licenses/by-sa/3\.0"),
    ("CC-BY-SA-4.0", ("creativecommons.org",), r"(?:https?://)?(?:www\.)?creativecommons\.org/licenses/by-sa/4\.0"),
    ("CC-BY-NC-3.0", ("creativecommons.org",), r"(?:https?://)?(?:www\.)?creativecommons\.org/licenses/by-nc/3\.0"),
    ("CC-BY-NC-4.0", ("creativecommons.org",), r"(?:https?://)?(?:www\.)?creativecommons\.org/licenses/by-nc/4\.0"),
    ("CC-BY-ND-4.0", ("creativecommons.org",), r"(?:https?://)?(?:www\.)?creativecommons\.org/licenses/by-nd/4\.0"),
    ("CC-BY-NC-SA-4.0", ("creativecommons.org",), r"(?:https?://)?(?:www\.)?creativecommons\.org/licenses/by-nc-sa/4\.0"),
    ("CC-BY-NC-ND-4.0", ("creativecommons.org",), r"(?:https?://)?(?:www\.)?creativecommons\.org/licenses/by-nc-nd/4\.0"),
    ("ODbL-1.0", ("opendatacommons.org",), r"(?:https?://)?(?:www\.)?opendatacommons\.org/licenses/odbl(?:/1[.-]0)?"),
    ("PDDL-1.0", ("opendatacommons.org",), r"(?:https?://)?(?:www\.)?opendatacommons\.org/licenses/pddl(?:/1[.-]0)?"),
    ("ODC-By-1.0", ("opendatacommons.org",), r"(?:https?://)?(?:www\.)?opendatacommons\.org/licenses/by(?:/1[.-]0)?"),
]

#: SPDX tags: "SPDX-License-Identifier: X", one rule per identifier, each with the spellings in use.
TAGS = [
    ("MIT", r"mit(?![-\w])"), ("MIT-0", r"mit-0"), ("X11", r"x11"), ("ISC", r"isc"), ("0BSD", r"0bsd"),
    ("BSD-2-Clause", r"bsd-2-clause(?:-freebsd)?"), ("BSD-3-Clause", r"bsd-3-clause(?:-clear|-lbnl)?"), ("BSD-4-Clause", r"bsd-4-clause(?:-uc)?"),
    ("Apache-1.0", r"apache-1\.0"), ("Apache-1.1", r"apache-1\.1"), ("Apache-2.0", r"apache-2\.0"),
    ("GPL-1.0", r"gpl-1\.0(?:\+|-only|-or-later)?"), ("GPL-2.0-or-later", r"gpl-2\.0(?:\+|-or-later)"), ("GPL-2.0-only", r"gpl-2\.0(?:-only)?(?![-+\w])"),
    ("GPL-3.0-or-later", r"gpl-3\.0(?:\+|-or-later)"), ("GPL-3.0-only", r"gpl-3\.0(?:-only)?(?![-+\w])"),
    ("LGPL-2.0", r"lgpl-2\.0(?:\+|-only|-or-later)?"), ("LGPL-2.1", r"lgpl-2\.1(?:\+|-only|-or-later)?"), ("LGPL-3.0", r"lgpl-3\.0(?:\+|-only|-or-later)?"),
    ("AGPL-3.0", r"agpl-3\.0(?:\+|-only|-or-later)?"), ("GFDL-1.2", r"gfdl-1\.2(?:-only|-or-later)?"), ("GFDL-1.3", r"gfdl-1\.3(?:-only|-or-later)?"),
    ("MPL-1.1", r"mpl-1\.1"), ("MPL-2.0", r"mpl-2\.0(?:-no-copyleft-exception)?"), ("EPL-1.0", r"epl-1\.0"), ("EPL-2.0", r"epl-2\.0"),
    ("CDDL-1.0", r"cddl-1\.0"), ("CDDL-1.1", r"cddl-1\.1"), ("BSL-1.0", r"bsl-1\.0"), ("BUSL-1.1", r"busl-1\.1"), ("SSPL-1.0", r"sspl-1\.0"),
    ("Elastic-2.0", r"elastic-2\.0"), ("Unlicense", r"unlicense"), ("WTFPL", r"wtfpl"), ("Zlib", r"zlib"), ("libpng-2.0", r"libpng-2\.0"),
    ("PostgreSQL", r"postgresql"), ("PSF-2.0", r"(?:psf|python)-2\.0"), ("PHP-3.01", r"php-3\.01"), ("Ruby", r"ruby"), ("OpenSSL", r"openssl"),
    ("NCSA", r"ncsa"), ("Ms-PL", r"ms-pl"), ("Ms-RL", r"ms-rl"), ("OFL-1.1", r"ofl-1\.1(?:-rfn|-no-rfn)?"), ("EUPL-1.1", r"eupl-1\.1"), ("EUPL-1.2", r"eupl-1\.2"),
    ("CECILL-2.1", r"cecill-2\.1"), ("CECILL-B", r"cecill-b"), ("CECILL-C", r"cecill-c"), ("LPPL-1.3c", r"lppl-1\.3c"), ("Artistic-1.0", r"artistic-1\.0(?:-perl|-cl8)?"), ("Artistic-2.0", r"artistic-2\.0"),
    ("AFL-3.0", r"afl-3\.0"), ("OSL-3.0", r"osl-3\.0"), ("APSL-2.0", r"apsl-2\.0"), ("CPL-1.0", r"cpl-1\.0"), ("IPL-1.0", r"ipl-1\.0"), ("Vim", r"vim"), ("curl", r"curl"), ("HPND", r"hpnd(?:-sell-variant)?"),
    ("Beerware", r"beerware"), ("JSON", r"json"), ("CC0-1.0", r"cc0-1\.0"), ("CC-BY-3.0", r"cc-by-3\.0"), ("CC-BY-4.0", r"cc-by-4\.0"), ("CC-BY-SA-3.0", r"cc-by-sa-3\.0"), ("CC-BY-SA-4.0", r"cc-by-sa-4\.0"),
    ("CC-BY-NC-4.0", r"cc-by-nc-4\.0"), ("CC-BY-ND-4.0", r"cc-by-nd-4\.0"), ("CC-BY-NC-SA-4.0", r"cc-by-nc-sa-4\.0"), ("CC-BY-NC-ND-4.0", r"cc-by-nc-nd-4\.0"), ("ODbL-1.0", r"odbl-1\.0"), ("PDDL-1.0", r"pddl-1\.0"), ("ODC-By-1.0", r"odc-by-1\.0"),
]

#: Names without a version, and notices that name no licence.
LOOSE = [
    ("Apache", SHORT, ("apache",), rf"\bapache(?: software)? {_L}"),
    ("BSD", SHORT, ("bsd",), rf"\bbsd(?:[- ]style)? {_L}"),
    ("GPL", SHORT, ("general public",), rf"\bgnu general public {_L}"),
    ("GPL", SHORT, ("gpl",), rf"\b(?:gnu )?gpl(?: {_L}d?)?\b"),
    ("LGPL", SHORT, ("lesser general",), rf"\bgnu lesser general public {_L}"),
    ("LGPL", SHORT, ("lgpl",), r"\b(?:gnu )?lgpl\b"),
    ("AGPL", SHORT, ("agpl",), r"\b(?:gnu )?agpl\b"),
    ("GFDL", SHORT, ("free documentation",), rf"\bgnu free documentation {_L}"),
    ("MPL", SHORT, ("mozilla public",), rf"\bmozilla public {_L}"),
    ("EPL", SHORT, ("eclipse public",), rf"\beclipse public {_L}"),
    ("Artistic", SHORT, ("artistic",), rf"\bartistic {_L}"),
    ("CC-BY", SHORT, ("creative commons",), rf"\bcreative commons attribution(?: {_L})?"),
    ("CC", SHORT - 10, ("creative commons",), rf"\bcreative commons {_L}"),
    ("CC-BY", SHORT - 10, ("cc by", "cc-by"), r"\bcc[- ]by(?:-nc)?(?:-sa|-nd)?\b(?![- ]?\d)"),
    ("Public-Domain", VAGUE + 5, ("public domain",), r"\bpublic domain\b"),
    ("Proprietary", VAGUE + 15, ("proprietary",), r"\bproprietary and confidential\b"),
    ("Proprietary", VAGUE + 15, ("strictly prohibited",), r"\bunauthori[sz]ed (?:copying|use|distribution) of this file[^.]*?is strictly prohibited"),
    ("All-Rights-Reserved", VAGUE + 2, ("all rights reserved",), r"\ball rights reserved\b"),
    ("Unknown-Reference", VAGUE, ("licen",), rf"\bsee (?:the )?(?:accompanying )?{_L}(?: file|\.txt|\.md)?\b"),
    ("Unknown-Reference", VAGUE, ("licen",), r"\b(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the |an? |this )?[\w .,-]{0,60}?licen[sc]e\b"),
    ("Unknown-Reference", VAGUE, ("spdx-license-identifier",), r"spdx-license-identifier: ?[\w.+-]+"),
]


_GRANTS = ("licensed under", "licenced under", "released under", "distributed under", "available under")
_UNDER = r"(?:licen[sc]ed|released|distributed|available) under(?: the)?(?: terms of)?(?: the)?"


def all_rules() -> list[tuple[str, int, tuple[str, ...], str]]:
    """(licence, priority, keywords, pattern) in the rules' order."""
    rules = [(a, TEXT, k, p) for a, k, p in TEXTS]
    rules += [(a, TAG, ("spdx-license-identifier",), rf"spdx-license-identifier: ?\(?{p}(?![-\w])") for a, p in TAGS]
    # the further names of an expression, and identifiers in a list of licences: each a detection of its own
    rules += [(a, TAG, ("spdx-license-identifier",), rf"(?<=spdx-license-identifier: ?(?:\(*[\w.+-]+\)* (?:or|and|with) )+\(*){p}(?![-\w])") for a, p in TAGS]
    rules += [(a, NAME, _GRANTS, rf"(?<=\b{_UNDER} (?:(?:either )?[\w.+-]+(?: {_L})?(?:/|, ?| or | and | and/or )(?:the )?)*){p}(?![-\w])") for a, p in TAGS]
    rules += [(a, NAME, k, p) for a, k, p in NAMES]
    rules += [(a, LINK, k, p) for a, k, p in LINKS]
    rules += [tuple(r) for r in LOOSE]
    return rules
