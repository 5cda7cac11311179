"""The signature rules of the license scan, composed from names and forms of mention."""

from __future__ import annotations

from dataclasses import dataclass

V = r"(?: v(?:ersion)?)?"
OLD = r"(?: or(?: at your option)?(?: any)? later(?: version)?)?"


@dataclass(frozen=True)
class Rule:
    """``regex`` is for words in lower case that single spaces separate; ``keyword`` must occur for it to match."""

    number: int
    label: str
    form: str
    priority: int
    keyword: str
    regex: str


# Phrases and labels every scan reports.
BASE_PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# Hand-written: SPDX label, words of the identifier, words of the name.
NAMES = (
    ("MIT", "mit", "(?:the )?mit"),
    ("MIT-0", "mit 0", "mit no attribution"),
    ("X11", "x11", "x11|mit x11"),
    ("ISC", "isc", "isc|internet systems consortium"),
    ("0BSD", "0bsd", "(?:bsd )?(?:zero clause|0 clause)(?: bsd)?|0bsd"),
    ("BSD-2-Clause", "bsd 2 clause", "(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)"),
    ("BSD-3-Clause", "bsd 3 clause", "(?:bsd (?:3|three) clause|(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)"),
    ("BSD-4-Clause", "bsd 4 clause", "(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)"),
    ("BSD", "bsd", "(?:bsd|berkeley software distribution)"),
    ("Apache-1.0", "apache 1 0", f"apache(?: software)?{V} 1(?: 0)?"),
    ("Apache-1.1", "apache 1 1", f"apache(?: software)?{V} 1 1"),
    ("Apache-2.0", "apache 2 0", f"apache(?: licen[cs]e)?{V} 2(?: 0)?"),
    ("Apache", "apache", "apache(?: software)?"),
    ("GPL-1.0", "gpl 1 0(?: only| or later)?", f"(?:gnu )?(?:general public licen[cs]e|gpl){V} ?1(?: 0)?{OLD}"),
    ("GPL-2.0", "gpl 2 0(?: only| or later)?", f"(?:gnu )?(?:general public licen[cs]e|gpl){V} ?2(?: 0)?{OLD}"),
    ("GPL-3.0", "gpl 3 0(?: only| or later)?", f"(?:gnu )?(?:general public licen[cs]e|gpl){V} ?3(?: 0)?{OLD}"),
    ("GPL", "gpl", "(?:gnu )?(?:general public|gpl)"),
    ("LGPL-2.0", "lgpl 2 0(?: only| or later)?", f"(?:gnu )?(?:library general public licen[cs]e|lgpl){V} ?2(?: 0)?{OLD}"),
    ("LGPL-2.1", "lgpl 2 1(?: only| or later)?", f"(?:gnu )?(?:lesser general public licen[cs]e|lgpl){V} ?2 1{OLD}"),
    ("LGPL-3.0", "lgpl 3 0(?: only| or later)?", f"(?:gnu )?(?:lesser general public licen[cs]e|lgpl){V} ?3(?: 0)?{OLD}"),
    ("LGPL", "lgpl", "(?:gnu )?(?:(?:lesser|library) general public|lgpl)"),
    ("AGPL-3.0", "agpl 3 0(?: only| or later)?", f"(?:gnu )?(?:affero general public licen[cs]e|agpl){V} ?3(?: 0)?{OLD}"),
    ("AGPL", "agpl", "(?:gnu )?(?:affero general public|agpl)"),
    ("GFDL-1.2", "gfdl 1 2(?: only| or later)?", f"(?:gnu )?(?:free documentation licen[cs]e|gfdl){V} ?1 2{OLD}"),
    ("GFDL-1.3", "gfdl 1 3(?: only| or later)?", f"(?:gnu )?(?:free documentation licen[cs]e|gfdl){V} ?1 3{OLD}"),
    ("GFDL", "gfdl", "(?:gnu )?(?:free documentation|gfdl)"),
    ("MPL-1.0", "mpl 1 0", f"(?:mozilla public licen[cs]e|mpl){V} 1 0"),
    ("MPL-1.1", "mpl 1 1", f"(?:mozilla public licen[cs]e|mpl){V} 1 1"),
    ("MPL-2.0", "mpl 2 0", f"(?:mozilla public licen[cs]e|mpl){V} 2(?: 0)?"),
    ("MPL", "mpl", "(?:mozilla public|mpl)"),
    ("EPL-1.0", "epl 1 0", f"(?:eclipse public licen[cs]e|epl){V} 1 0"),
    ("EPL-2.0", "epl 2 0", f"(?:eclipse public licen[cs]e|epl){V} 2(?: 0)?"),
    ("EPL", "epl", "(?:eclipse public|epl)"),
    ("CDDL-1.0", "cddl 1 0", f"(?:common development and distribution licen[cs]e|cddl){V} 1(?: 0)?"),
    ("CDDL-1.1", "cddl 1 1", f"(?:common development and distribution licen[cs]e|cddl){V} 1 1"),
    ("EUPL-1.1", "eupl 1 1", f"(?:european union public licen[cs]e|eupl){V} 1 1"),
    ("EUPL-1.2", "eupl 1 2", f"(?:european union public licen[cs]e|eupl){V} 1 2"),
    ("EUPL", "eupl", "(?:european union public|eupl)"),
    ("Artistic-1.0", "artistic 1 0", f"artistic{V} 1(?: 0)?"),
    ("Artistic-2.0", "artistic 2 0", f"artistic(?: licen[cs]e)?{V} 2(?: 0)?"),
    ("BSL-1.0", "bsl 1 0", "boost(?: software)?"),
    ("BUSL-1.1", "busl 1 1", "business source"),
    ("Zlib", "zlib", "zlib(?: libpng)?"),
    ("Libpng", "libpng", "libpng|png reference library"),
    ("PostgreSQL", "postgresql", "postgresql"),
    ("Python-2.0", "python 2 0", "(?:python(?: software foundation)?|psf)"),
    ("Ruby", "ruby", "ruby"),
    ("PHP-3.01", "php 3 01", f"php(?: licen[cs]e)?{V} 3 01"),
    ("OpenSSL", "openssl", "openssl"),
    ("Unlicense", "unlicense", "unlicense"),
    ("WTFPL", "wtfpl", "(?:wtfpl|do what the [^ ]+ you want to public)"),
    ("CC0-1.0", "cc0 1 0", f"(?:cc0|cc zero|creative commons zero){V}(?: 1 0)?(?: universal)?"),
    ("CC-BY-NC-ND", "cc by nc nd [0-9] [0-9]", f"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s){V}(?: [0-9](?: [0-9])?)?(?: international)?"),
    ("CC-BY-NC-SA", "cc by nc sa [0-9] [0-9]", f"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike){V}(?: [0-9](?: [0-9])?)?(?: international)?"),
    ("CC-BY-NC", "cc by nc [0-9] [0-9]", f"(?:cc by nc|creative commons attribution non ?commercial){V}(?: [0-9](?: [0-9])?)?(?: international)?"),
    ("CC-BY-ND", "cc by nd [0-9] [0-9]", f"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s){V}(?: [0-9](?: [0-9])?)?(?: international)?"),
    ("CC-BY-SA", "cc by sa [0-9] [0-9]", f"(?:cc by sa|creative commons attribution share ?alike){V}(?: [0-9](?: [0-9])?)?(?: international)?"),
    ("CC-BY", "cc by [0-9] [0-9]", f"(?:cc by|creative commons attribution){V}(?: [0-9](?: [0-9])?)?(?: international)?"),
    ("ODbL-1.0", "odbl 1 0", f"(?:open database|odbl){V}(?: 1 0)?"),
    ("ODC-By-1.0", "odc by 1 0", "(?:open data commons attribution|odc by)"),
    ("OFL-1.1", "ofl 1 1", f"(?:sil )?open font(?: licen[cs]e)?{V}(?: 1 1)?"),
    ("MS-PL", "ms pl", "(?:microsoft public|ms pl)"),
    ("MS-RL", "ms rl", "(?:microsoft reciprocal|ms rl)"),
    ("NCSA", "ncsa", "(?:university of illinois ncsa(?: open source)?|ncsa)"),
    ("AFL-3.0", "afl 3 0", f"academic free(?: licen[cs]e)?{V}(?: 3 0)?"),
    ("OSL-3.0", "osl 3 0", f"open software(?: licen[cs]e)?{V}(?: 3 0)?"),
    ("CPAL-1.0", "cpal 1 0", "common public attribution"),
    ("IPL-1.0", "ipl 1 0", "ibm public"),
    ("SSPL-1.0", "sspl 1 0", "server side public"),
    ("Elastic-2.0", "elastic 2 0", "elastic"),
    ("OGL-3.0", "ogl uk 3 0", "open government"),
)

VERBS = "licen[cs]ed|sublicen[cs]ed|released|distributed|redistributed|available|published|provided|offered|shared|covered"
UNDER = f"(?:{VERBS})(?: [^ ]+)? under(?: an?)?(?: the)?(?: terms(?: and conditions)? of(?: the)?)?"
# form, priority, keyword, pattern around a name
FORMS = (
    ("identifier", 4, "spdx", "spdx licen[cs]e identifier {id}"),
    ("notice", 3, " under ", UNDER + " (?:{name})(?: licen[cs]e)?(?:" + V + " [0-9]+(?: [0-9]+)?)?" + OLD),
    ("name", 2, "licen", "(?:{name}) licen[cs]e(?:" + V + " [0-9]+(?: [0-9]+)?)?" + OLD),
)
# Hand-written rules that no name leads to.
OTHERS = (
    ("reserved", "all rights reserved", 2, "reserved", "all rights (?:are )?reserved"),
    ("reserved", "some rights reserved", 2, "reserved", "some rights (?:are )?reserved"),
    ("public-domain", "dedication", 3, "public domain", "(?:released|placed|dedicated|put)(?: [^ ]+)? (?:in|into|to) the public domain"),
    ("public-domain", "mention", 1, "public domain", "(?:in the )?public domain"),
    ("proprietary", "notice", 3, "proprietary", "proprietary and confidential|confidential and proprietary"),
    ("copyright", "notice", 1, "copyright", "copyright(?: c)? [0-9]{4}(?: [0-9]{4})?"),
    ("MIT", "grant", 4, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("ISC", "grant", 4, "permission to use", "permission to use copy modify and or distribute this software for any purpose"),
    ("BSD", "grant", 4, "redistribution and use", "redistribution and use in source and binary forms with or without modification"),
    ("warranty-disclaimer", "clause", 1, "warranty", "without warranty of any kind"),
    ("CC-BY", "mention", 1, "cc by", "cc by"),
    ("GPL", "mention", 1, "general public", "general public licen[cs]e"),
    ("GPL", "mention", 1, "gpl", "gpl(?:v[123])?"),
    ("LGPL", "mention", 1, "lgpl", "lgpl(?:v[23])?"),
    ("AGPL", "mention", 1, "agpl", "agpl(?:v3)?"),
    ("copyleft", "mention", 1, "copyleft", "copyleft"),
)
# Words one of which any rule's match contains, as they stand in unchanged lower-case text.
TRIGGERS = (
    "licen", "spdx", "reserved", "domain", "proprietary", "copyright", "permission", "redistribut", "warranty",
    "gpl", "copyleft", "under",
)
MAX_MATCH_WORDS = 40  # no match of a rule is longer


def rules() -> list[Rule]:
    """All rules in order; a match starts and ends at a word boundary."""
    found = []

    def add(label: str, form: str, priority: int, keyword: str, body: str) -> None:
        regex = f"(?<= )(?:{body})(?= )"
        found.append(Rule(len(found) + 1, label, form, priority, keyword, regex))

    for label, identifier, name in NAMES:
        for form, priority, keyword, body in FORMS:
            add(label, form, priority, keyword, body.replace("{id}", identifier).replace("{name}", name))
    for other in OTHERS:
        add(*other)
    return found
