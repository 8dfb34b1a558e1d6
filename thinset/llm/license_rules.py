"""Hand-written signature rules: tier, label, keyword, expression.

An expression is matched on text with A-Z lower-cased.  A blank stands for any run of
characters that are no part of a word (so "2 0" also reads "2.0" and "2-0"), LIC for
license or licence, and an expression begins and ends at a word's edge.  The keyword
has to occur in the text before the expression is tried.  Tiers: 1 notice, 2 full
name with version, 3 name, 4 address or short form, 5 generic hint.
"""

from __future__ import annotations

RULES = """
1|apache-2.0|apache|licensed under the apache LIC (version )?2 0
1|apache-2.0|apache|licensed under the terms of the apache LIC (version )?2 0
1|gpl-2.0|general public|gnu general public LIC as published by the free software foundation (either )?version 2
1|gpl-3.0|general public|gnu general public LIC as published by the free software foundation (either )?version 3
1|lgpl-2.1|lesser general|gnu lesser general public LIC as published by the free software foundation (either )?version 2 1
1|lgpl-3.0|lesser general|gnu lesser general public LIC as published by the free software foundation (either )?version 3
1|agpl-3.0|affero|gnu affero general public LIC as published by the free software foundation (either )?version 3
1|mit|hereby granted|permission is hereby granted free of charge to any person obtaining a copy of this software
1|isc|permission to use|permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted
1|bsd|redistribution and use|redistribution and use in source and binary forms with or without modification are permitted
1|bsd-3-clause|neither the name|neither the name of [^.]{1,80} nor the names of its contributors may be used
1|bsd-4-clause|advertising materials|all advertising materials mentioning features or use of this software
1|zlib|misrepresented|the origin of this software must not be misrepresented you must not claim
1|bsl-1.0|boost software|boost software LIC version 1 0 august 17th 2003
1|unlicense|unencumbered|this is free and unencumbered software released into the public domain
1|mpl-2.0|mozilla public|subject to the terms of the mozilla public LIC v(ersion )? ?2 0
1|mpl-1.1|mozilla public|subject to the mozilla public LIC version 1 1
1|epl-1.0|eclipse public|made available under the terms of the eclipse public LIC v ?1 0
1|epl-2.0|eclipse public|made available under the terms of the eclipse public LIC (v ?)?2 0
1|wtfpl|do what|do what the fuck you want to public LIC
1|beerware|beer|buy me a beer in return
1|postgresql|postgresql|permission to use copy modify and distribute this software and its documentation .{0,80}without a written agreement
1|cc0-1.0|creative commons|dedicated .{0,60}public domain .{0,60}creative commons (cc0|zero)
1|cc-by-4.0|creative commons|licensed under a creative commons attribution 4 0 international
1|cc-by-sa-4.0|sharealike|licensed under a creative commons attribution sharealike 4 0 international
1|cc-by-nc-4.0|noncommercial|licensed under a creative commons attribution noncommercial 4 0 international
1|cc-by-nd-4.0|noderivatives|licensed under a creative commons attribution noderivatives 4 0 international
1|cc-by-nc-sa-4.0|noncommercial|licensed under a creative commons attribution noncommercial sharealike 4 0 international
1|cc-by-nc-nd-4.0|noncommercial|licensed under a creative commons attribution noncommercial noderivatives 4 0 international
1|proprietary|all rights reserved|confidential and proprietary .{0,80}all rights reserved
1|proprietary|without prior|may not be (reproduced|copied) .{0,80}without prior (written )?(permission|consent)
2|gpl-1.0|general public|gnu general public LIC v(ersion )? ?1
2|gpl-2.0|general public|gnu general public LIC v(ersion )? ?2( 0)?
2|gpl-3.0|general public|gnu general public LIC v(ersion )? ?3( 0)?
2|gpl-2.0-or-later|later version|general public LIC .{0,90}version 2 .{0,60}any later version
2|gpl-3.0-or-later|later version|general public LIC .{0,90}version 3 .{0,60}any later version
2|lgpl-2.0|library general|gnu library general public LIC v(ersion )? ?2( 0)?
2|lgpl-2.1|lesser general|gnu lesser general public LIC v(ersion )? ?2 1
2|lgpl-3.0|lesser general|gnu lesser general public LIC v(ersion )? ?3( 0)?
2|agpl-3.0|affero|gnu affero general public LIC v(ersion )? ?3( 0)?
2|gfdl-1.1|documentation|gnu free documentation LIC v(ersion )? ?1 1
2|gfdl-1.2|documentation|gnu free documentation LIC v(ersion )? ?1 2
2|gfdl-1.3|documentation|gnu free documentation LIC v(ersion )? ?1 3
2|apache-1.0|apache|apache (software )?LIC v(ersion )? ?1 0
2|apache-1.1|apache|apache (software )?LIC v(ersion )? ?1 1
2|apache-2.0|apache|apache (software )?LIC v(ersion )? ?2( 0)?
2|apache-2.0|apache|apache (LIC )?2 0
2|mpl-1.0|mozilla public|mozilla public LIC v(ersion )? ?1 0
2|mpl-1.1|mozilla public|mozilla public LIC v(ersion )? ?1 1
2|mpl-2.0|mozilla public|mozilla public LIC (v(ersion )? ?)?2 0
2|epl-1.0|eclipse public|eclipse public LIC (v(ersion )? ?)?1 0
2|epl-2.0|eclipse public|eclipse public LIC (v(ersion )? ?)?2 0
2|eupl-1.1|european union|european union public LIC (v(ersion )? ?)?1 1
2|eupl-1.2|european union|european union public LIC (v(ersion )? ?)?1 2
2|cddl-1.0|common development|common development and distribution LIC (v(ersion )? ?)?1 0
2|cddl-1.1|common development|common development and distribution LIC (v(ersion )? ?)?1 1
2|cpl-1.0|common public|common public LIC (v(ersion )? ?)?1 0
2|ipl-1.0|ibm public|ibm public LIC (v(ersion )? ?)?1 0
2|bsl-1.0|boost software|boost software LIC (v(ersion )? ?)?1 0
2|bsl-1.1|business source|business source LIC (v(ersion )? ?)?1 1
2|artistic-1.0|artistic|artistic LIC (v(ersion )? ?)?1 0
2|artistic-2.0|artistic|artistic LIC (v(ersion )? ?)?2 0
2|osl-1.0|open software|open software LIC (v(ersion )? ?)?1 0
2|osl-2.0|open software|open software LIC (v(ersion )? ?)?2 0
2|osl-2.1|open software|open software LIC (v(ersion )? ?)?2 1
2|osl-3.0|open software|open software LIC (v(ersion )? ?)?3 0
2|afl-1.2|academic free|academic free LIC (v(ersion )? ?)?1 2
2|afl-2.0|academic free|academic free LIC (v(ersion )? ?)?2 0
2|afl-2.1|academic free|academic free LIC (v(ersion )? ?)?2 1
2|afl-3.0|academic free|academic free LIC (v(ersion )? ?)?3 0
2|ecl-1.0|educational community|educational community LIC (v(ersion )? ?)?1 0
2|ecl-2.0|educational community|educational community LIC (v(ersion )? ?)?2 0
2|ofl-1.0|open font|(sil )?open font LIC (v(ersion )? ?)?1 0
2|ofl-1.1|open font|(sil )?open font LIC (v(ersion )? ?)?1 1
2|ms-pl|microsoft public|microsoft public LIC
2|ms-rl|microsoft reciprocal|microsoft reciprocal LIC
2|bsd-0-clause|bsd|(zero clause bsd|bsd (zero|0) clause) LIC
2|bsd-1-clause|bsd|(bsd )?(one|1) clause bsd( LIC)?
2|bsd-2-clause|bsd|((two|2) clause bsd|bsd (two|2) clause|simplified bsd|freebsd)( LIC)?
2|bsd-3-clause|bsd|((three|3) clause bsd|bsd (three|3) clause|(new|revised|modified) bsd)( LIC)?
2|bsd-4-clause|bsd|((four|4) clause bsd|bsd (four|4) clause|original bsd)( LIC)?
2|mit-0|mit|mit no attribution( LIC)?
2|mit-x11|x11|(mit x11|x11 mit|x11) LIC
2|cc-by-1.0|cc|cc by 1 0
2|cc-by-2.0|cc|cc by 2 0
2|cc-by-2.5|cc|cc by 2 5
2|cc-by-3.0|cc|cc by 3 0
2|cc-by-4.0|cc|cc by 4 0
2|cc-by-sa-1.0|cc|cc by sa 1 0
2|cc-by-sa-2.0|cc|cc by sa 2 0
2|cc-by-sa-2.5|cc|cc by sa 2 5
2|cc-by-sa-3.0|cc|cc by sa 3 0
2|cc-by-sa-4.0|cc|cc by sa 4 0
2|cc-by-nc-1.0|cc|cc by nc 1 0
2|cc-by-nc-2.0|cc|cc by nc 2 0
2|cc-by-nc-2.5|cc|cc by nc 2 5
2|cc-by-nc-3.0|cc|cc by nc 3 0
2|cc-by-nc-4.0|cc|cc by nc 4 0
2|cc-by-nd-2.0|cc|cc by nd 2 0
2|cc-by-nd-3.0|cc|cc by nd 3 0
2|cc-by-nd-4.0|cc|cc by nd 4 0
2|cc-by-nc-sa-2.0|cc|cc by nc sa 2 0
2|cc-by-nc-sa-3.0|cc|cc by nc sa 3 0
2|cc-by-nc-sa-4.0|cc|cc by nc sa 4 0
2|cc-by-nc-nd-2.0|cc|cc by nc nd 2 0
2|cc-by-nc-nd-3.0|cc|cc by nc nd 3 0
2|cc-by-nc-nd-4.0|cc|cc by nc nd 4 0
2|cc0-1.0|cc0|cc0 1 0( universal)?
2|cc-by-4.0|creative commons|creative commons attribution 4 0
2|cc-by-3.0|creative commons|creative commons attribution 3 0
2|cc-by-sa-4.0|creative commons|creative commons attribution share ?alike 4 0
2|cc-by-sa-3.0|creative commons|creative commons attribution share ?alike 3 0
2|cc-by-nc-4.0|creative commons|creative commons attribution non ?commercial 4 0
2|cc-by-nc-3.0|creative commons|creative commons attribution non ?commercial 3 0
2|odbl-1.0|open data|open data(base|base commons| commons open database) LIC( v(ersion )? ?1 0)?
2|odc-by-1.0|attribution|open data commons attribution LIC( v(ersion )? ?1 0)?
2|pddl-1.0|public domain dedication|open data commons public domain dedication( and)? LIC
2|ncsa|ncsa|(university of illinois ncsa|uiuc ncsa|illinois ncsa) open source LIC
2|python-2.0|python|python software foundation LIC( version 2)?
2|ruby|ruby|ruby LIC
2|php-3.0|php|php LIC (version )?3 0
2|php-3.01|php|php LIC (version )?3 01
2|zope-2.1|zope|zope public LIC (version )?2 1
2|w3c|w3c|w3c software (notice and )?LIC
2|qpl-1.0|q public|q public LIC( version 1 0)?
2|sleepycat|sleepycat|sleepycat LIC
2|sspl-1.0|server side|server side public LIC( v(ersion )? ?1)?
2|elastic-2.0|elastic|elastic LIC (v(ersion )? ?)?2( 0)?
2|polyform-nc|polyform|polyform noncommercial LIC
2|rail|rail|(bigscience |creativeml )?open ?rail( m)?( LIC)?
2|llama|llama|llama [23]( [0-9])? community LIC
2|vim|vim|vim LIC
2|tcl|tcl|tcl( tk)? LIC
2|curl|curl|curl LIC
2|openssl|openssl|openssl LIC
2|libpng|png|(png reference library|libpng) LIC
2|imagemagick|imagemagick|imagemagick LIC
2|unicode|unicode|unicode (data files and software )?LIC
2|upl-1.0|universal permissive|universal permissive LIC
2|mulan-2.0|mulan|mulan (permissive software|psl) LIC (v(ersion )? ?)?2
2|cecill|cecill|cecill( [bc])?( LIC| v ?2( [01])?)
2|nasa-1.3|nasa|nasa open source agreement
2|intel|intel|intel open source LIC
2|apsl-2.0|apple public|apple public source LIC( (version )?2 0)?
2|lppl|latex project|latex project public LIC
2|spl|sun public|sun public LIC
2|npl|netscape public|netscape public LIC
2|rpl-1.5|reciprocal public|reciprocal public LIC
2|watcom|watcom|sybase open watcom public LIC
2|xnet|x net|x net LIC
2|blueoak-1.0|blue oak|blue oak model LIC
2|parity|parity|parity public LIC
2|hippocratic|hippocratic|hippocratic LIC
2|json|good not evil|shall be used for good not evil
2|open-government|government|open government LIC( v(ersion )? ?[123]( 0)?)?
2|etalab-2.0|ouverte|(etalab )?licence ouverte( 2 0)?
3|gpl|general public|(gnu )?general public LIC
3|lgpl|lesser general|(gnu )?(lesser|library) general public LIC
3|agpl|affero|(gnu )?affero general public LIC
3|gfdl|documentation|(gnu )?free documentation LIC
3|apache|apache|apache (software )?LIC
3|mit|mit|(the )?mit LIC
3|mit|expat|expat LIC
3|isc|isc|isc LIC
3|bsd|bsd|bsd( style)? LIC
3|mpl|mozilla|mozilla public LIC
3|epl|eclipse|eclipse public LIC
3|eupl|european union|european union public LIC
3|cddl|common development|common development and distribution LIC
3|boost|boost|boost (software )?LIC
3|artistic|artistic|artistic LIC
3|zlib|zlib|zlib( libpng)? LIC
3|ofl|open font|open font LIC
3|unlicense|unlicense|(the )?unlicense
3|php|php|php LIC
3|python|python|python LIC
3|zope|zope|zope public LIC
3|creative-commons|creative commons|creative commons( LIC)?
3|cc-by-sa|cc|cc by sa
3|cc-by-nc|cc|cc by nc
3|cc-by-nd|cc|cc by nd
3|cc-by-nc-sa|cc|cc by nc sa
3|cc-by-nc-nd|cc|cc by nc nd
3|public-domain|public domain|(released (in)?to|in|dedicated to) the public domain
4|gpl-2.0|gpl|gpl ?v?2( 0)?( or later| only)?
4|gpl-3.0|gpl|gpl ?v?3( 0)?( or later| only)?
4|lgpl-2.1|lgpl|lgpl ?v?2 1( or later| only)?
4|lgpl-3.0|lgpl|lgpl ?v?3( 0)?( or later| only)?
4|agpl-3.0|agpl|agpl ?v?3( 0)?( or later| only)?
4|apache-2.0|apache|apache org licenses LIC 2 0
4|gpl|gnu|gnu org licenses gpl
4|gpl|gnu|gnu org copyleft gpl
4|lgpl|gnu|gnu org licenses lgpl
4|agpl|gnu|gnu org licenses agpl
4|mit|opensource|opensource org licen[cs]es mit
4|bsd-2-clause|opensource|opensource org licen[cs]es bsd 2 clause
4|bsd-3-clause|opensource|opensource org licen[cs]es bsd 3 clause
4|isc|opensource|opensource org licen[cs]es isc
4|mpl-2.0|mozilla|mozilla org (en us )?mpl 2 0
4|epl|eclipse|eclipse org legal epl
4|bsl-1.0|boost|boost org license 1 0
4|unlicense|unlicense|unlicense org
4|ofl|sil|scripts sil org ofl
4|cc-by|creativecommons|creativecommons org licenses by [0-9] [0-9]
4|cc-by-sa|creativecommons|creativecommons org licenses by sa [0-9] [0-9]
4|cc-by-nc|creativecommons|creativecommons org licenses by nc [0-9] [0-9]
4|cc-by-nd|creativecommons|creativecommons org licenses by nd [0-9] [0-9]
4|cc-by-nc-sa|creativecommons|creativecommons org licenses by nc sa [0-9] [0-9]
4|cc-by-nc-nd|creativecommons|creativecommons org licenses by nc nd [0-9] [0-9]
4|cc0-1.0|creativecommons|creativecommons org publicdomain zero 1 0
4|public-domain|creativecommons|creativecommons org publicdomain mark 1 0
5|unknown|copyright|copyright (c )?[12][0-9]{3}
5|unknown|all rights reserved|all rights reserved
5|unknown|licensed under|licensed under (the|a) terms
5|unknown|see|see (the )?LIC (file|txt|md)( for details)?
"""

# Identifiers of "SPDX-License-Identifier:" lines are read by one expression each, built
# from the labels above.
TAG = "spdx LIC identifier {}( or later| only)?"
"""Rule of tier 0 made for every versioned label."""


def rules() -> list[tuple[int, str, str, str]]:
    """(tier, label, keyword, expression) in order of precedence."""
    written = []
    for line in RULES.strip().split("\n"):
        tier, label, keyword, expression = line.split("|", 3)
        written.append((int(tier), label, keyword.lower(), expression))
    labels = dict.fromkeys(label for _, label, _, _ in written if label not in ("unknown", "proprietary"))
    tags = [(0, label, "spdx", TAG.format(label.replace("-", " ").replace(".", " "))) for label in labels]
    return tags + written
