"""License scans by sentence rules, in DataFrame functions only.

Texts are normalised and split into pieces at line ends and at the ends of sentences. A known licence
sentence is one piece, or a run of pieces that only single line breaks part, with comment marks or
without: wrapped texts count as whole ones. Semicolons, colons, full stops of abbreviations and the starts of
web addresses part pieces as line breaks do: a sentence may end there or go on. Blank lines, other full stops and a
colon before a line end stop a run. A line that names licences by tags or after "licensed under" may hold several,
joined by and, or, with; each gives its identifier. A document's identifiers, in order, are then matched with licence
rules: sequences of identifiers between which others may stand. A rule whose identifiers all belong to a longer
matching rule gives way to it.

Edge cases: null and empty texts have no sentence and no licence; repeated rows each get their row; a null
id is kept; other columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, normalised (lower case, single spaces, letters, digits and dots
# inside numbers), with their identifiers. A tilde stands for up to twelve words.
SENTENCES = {
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "licensed under the apache license version 2.0": "apache-ref",
    "licensed under the apache license version 2.0 the license": "apache-ref",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-obtain",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "this work is licensed under the gnu general public license version 2": "gpl2-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "licensed under cc by nc 4.0": "ccbync4-ref",
    "licensed under cc by 4.0": "ccby4-ref",
    "licensed under cc by sa 4.0": "ccbysa4-ref",
    "this work is licensed under a creative commons attribution 4.0 international license": "ccby4-ref",
    "this work is licensed under a creative commons attribution noncommercial 4.0 international license": "ccbync4-ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "neither the name of ~ nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "neither the name of ~ nor the names of ~ may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "the name of ~ may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "all rights reserved": "reserved",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license": "gpl2-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license": "gpl3-ref",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "lgpl21-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-later",
    "gnu general public license version 2 june 1991": "gpl2-ref",
    "gnu general public license version 3 29 june 2007": "gpl3-ref",
    "gnu lesser general public license version 2.1 february 1999": "lgpl21-ref",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3-ref",
    "gnu affero general public license version 3 19 november 2007": "agpl3-ref",
    "apache license version 2.0 january 2004": "apache-ref",
    "mozilla public license version 2.0": "mpl2-ref",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-form",
    "if a copy of the mpl was not distributed with this file you can obtain one at ~ mozilla org mpl 2.0": "mpl2-copy",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "to the extent possible under law ~ waived all copyright and related or neighboring rights to ~": "cc0-waiver",
    "this is free and unencumbered software released into the public domain": "unlicense-domain",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-grant",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-grant",
}
# Licence rules, each an ordered sequence of sentence identifiers.
RULES = {
    "Apache-2.0": ("apache-ref",),
    "Apache-2.0-header": ("apache-ref", "apache-comply", "apache-obtain"),
    "0BSD": ("0bsd-grant", "isc-warranty"),
    "AGPL-3.0-only": ("agpl3-ref",),
    "AGPL-3.0-or-later": ("agpl3-later",),
    "BSD-2-Clause": ("bsd-grant", "bsd-source", "bsd-binary"),
    "BSD-3-Clause": ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"),
    "BSD-4-Clause": ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names"),
    "BSL-1.0": ("bsl-grant",),
    "CC-BY-4.0": ("ccby4-ref",),
    "CC-BY-NC-4.0": ("ccbync4-ref",),
    "CC-BY-NC-ND-4.0": ("ccbyncnd4-ref",),
    "CC-BY-NC-SA-4.0": ("ccbyncsa4-ref",),
    "CC-BY-ND-4.0": ("ccbynd4-ref",),
    "CC-BY-SA-4.0": ("ccbysa4-ref",),
    "GPL-2.0-only": ("gpl2-ref",),
    "GPL-2.0-or-later": ("gpl2-later", "gpl-warranty"),
    "GPL-3.0-only": ("gpl3-ref",),
    "GPL-3.0-or-later": ("gpl3-later", "gpl-warranty"),
    "ISC": ("isc-grant", "isc-warranty"),
    "CC0-1.0": ("cc0-waiver",),
    "LGPL-2.1-only": ("lgpl21-ref",),
    "LGPL-2.1-or-later": ("lgpl21-later",),
    "LGPL-3.0-only": ("lgpl3-ref",),
    "LGPL-3.0-or-later": ("lgpl3-later",),
    "MIT": ("mit-grant", "mit-notice", "mit-warranty"),
    "MIT-reference": ("mit-ref",),
    "MPL-2.0": ("mpl2-ref",),
    "MPL-2.0-header": ("mpl-form", "mpl2-copy"),
    "Unlicense": ("unlicense-domain", "unlicense-grant"),
    "Zlib": ("zlib-grant",),
    "proprietary": ("reserved",),
}
#: Words that a tilde in a known sentence stands for.
ANY_WORDS = 12
# Parts of the names of public copyright licences, with their short forms.
_PARTS = {"noncommercial ": "nc", "noderivatives ": "nd", "sharealike ": "sa", "noncommercial noderivatives ": "ncnd", "noncommercial sharealike ": "ncsa", "": ""}
for _words, _short in _PARTS.items():
    for _before in ("", "this work is licensed under a ", "this work is licensed under the ", "licensed under a ", "licensed under the "):
        for _after in ("", " license"):
            SENTENCES[f"{_before}creative commons attribution {_words}4.0 international{_after}"] = f"ccby{_short}4-ref"
# Names by which tag lines and references call a licence beside its identifier.
NAMES = {
    "agpl 3.0": "AGPL-3.0-only",
    "apache 2": "Apache-2.0",
    "apache license 2.0": "Apache-2.0",
    "apache license version 2.0": "Apache-2.0",
    "bsd 2 clause license": "BSD-2-Clause",
    "bsd 3 clause license": "BSD-3-Clause",
    "boost software license 1.0": "BSL-1.0",
    "gnu general public license version 2": "GPL-2.0-only",
    "gnu general public license version 3": "GPL-3.0-only",
    "gpl 2.0": "GPL-2.0-only",
    "gpl 3.0": "GPL-3.0-only",
    "isc license": "ISC",
    "lgpl 2.1": "LGPL-2.1-only",
    "lgpl 3.0": "LGPL-3.0-only",
    "mit license": "MIT",
    "mozilla public license 2.0": "MPL-2.0",
    "mozilla public license version 2.0": "MPL-2.0",
}


def _plain(name: str) -> str:
    return " ".join(re.split(r"[^a-z0-9.]+", name.lower()))


#: A tag line names a licence by its identifier: one more sentence and rule for each.
for _name in [n for n in RULES if n not in ("Apache-2.0-header", "MIT-reference", "MPL-2.0-header", "proprietary")]:
    NAMES[_plain(_name)] = _name
    RULES[f"{_name}-tag"] = (f"tag-{_name.lower()}",)
for _name, _of in NAMES.items():
    SENTENCES[f"spdx license identifier {_name}"] = f"tag-{_of.lower()}"
#: What may stand before names of licences, and what an exception to one is called.
_BEFORE = "spdx license identifier|license|(?:this [a-z]+ is )?(?:(?:dual|double|triple|multi) )?licensed under(?: the terms of)?(?: either)?(?: of)?(?: the| a)?"
_EXCEPTION = "(?:[a-z0-9.]+ ){1,4}(?:exception|note)(?: [0-9.]+)?"
#: Words after which a full stop need not end a sentence.
ABBREVIATED = "inc|ltd|corp|co|llc|gmbh|dr|mr|mrs|ms|jr|prof"
#: Sentences end at line ends, and at a full stop, question or exclamation mark before white space or the end.
SENTENCE_END = r"[\r\n]+|[.!?]+(?:[ \t]+|$)|[.!?]+[\r\n]+"


def normalised(sentence: Column) -> Column:
    """Lower case; all but letters, digits and dots inside numbers are blanks; single blanks."""
    plain = F.regexp_replace(F.lower(sentence), r"[^a-z0-9.]+", " ")
    return F.trim(F.regexp_replace(plain, r"(^|[^0-9])[.]+|[.]+($|[^0-9])", "$1 $2"))


#: Stand in normalised texts for a single line break, over which a sentence may go on, and for the end of a sentence.
SOFT, HARD = "\x01", "\x02"


def marked(text: Column) -> Column:
    """The whole text as ``normalised`` leaves its sentences, with ``SOFT`` and ``HARD`` between them and ``HARD`` at both ends."""
    out = F.regexp_replace(F.translate(F.lower(text), SOFT + HARD, "  "), r"\r\n?", "\n")
    # a plus behind a version
    out = F.regexp_replace(out, r"(?<=[a-z]-[0-9.]{1,4})[+](?![^ \t\n)])", "-or-later")
    out = F.regexp_replace(out, rf"\b({ABBREVIATED})[.](?=[ \t\n])", f"$1{SOFT}")
    out = F.regexp_replace(out, r"[.!?]+(?=[ \t\n]|$)", HARD)
    # a line without a letter or digit is blank: comment marks, rules of dashes
    out = F.regexp_replace(out, r"\n(?=[^\p{L}\p{N}\n]*+\n)|:(?=[^\p{L}\p{N}\n]{0,8}\n)", HARD)
    out = F.regexp_replace(out, r"(?=\bhttps?://)", SOFT)
    out = F.concat(F.lit(HARD), F.translate(out, "\n:;", SOFT * 3), F.lit(HARD))
    out = F.regexp_replace(out, rf"[^a-z0-9.{SOFT}{HARD}]+", " ")
    out = F.regexp_replace(out, r"(^|[^0-9])[.]+|[.]+($|[^0-9])", "$1 $2")
    out = F.regexp_replace(F.regexp_replace(out, " +", " "), f" ?([{SOFT}{HARD}]) ?", "$1")
    return F.regexp_replace(out, f"{SOFT}{SOFT}+", SOFT)


def _open(sentence: str, blank: str = " ") -> str:
    """A pattern of a known sentence: tildes are words, and ``blank`` matches what parts words."""
    words = rf"(?:[a-z0-9.]+{blank}){{0,{ANY_WORDS - 1}}}[a-z0-9.]+"
    return re.escape(sentence).replace(r"\~", "~").replace(r"\ ", blank).replace("~", words)


#: What may stand before a sentence of a list.
_ITEM = "(?:[a-z]|[ivx]{1,4}|[0-9]{1,2})"


def _names() -> str:
    return "(?:" + "|".join(re.escape(n).replace(r"\ ", " ") for n in sorted(NAMES, key=len, reverse=True)) + ")(?: license)?"


def _tags() -> str:
    """Matches a run of licence names behind what may stand before them."""
    one = f"{_names()}(?: with {_EXCEPTION})?"
    return f"(?:{_BEFORE}) {one}(?: (?:and or|and|or)(?: the)? {one})*"


def _known() -> str:
    """Matches a known sentence in a marked text, the longest one first, behind the mark of a list's item or without."""
    any_of = "|".join(_open(s, f"[ {SOFT}]") for s in sorted(SENTENCES, key=len, reverse=True))
    tags = _tags().replace(" ", f"[ {SOFT}]")
    return f"(?<=[{SOFT}{HARD}])(?:{_ITEM} )?(?:{any_of}|{tags})(?=[{SOFT}{HARD}])"


def _rules_for(ids: Column) -> Column:
    """Names of the rules that ``ids`` (``;a;b;``) satisfies, without those that a longer one covers."""
    found = []
    for name, seq in sorted(RULES.items()):
        longer = [s for other, s in RULES.items() if other != name and set(seq) < set(s)]
        match = ids.rlike(_pattern(seq))
        for s in longer:
            match = match & ~ids.rlike(_pattern(s))
        found.append(F.when(match, F.lit(name)))
    return F.array_compact(F.array(*found))


def _pattern(seq: tuple[str, ...]) -> str:
    return "(?:;.*)?".join(f";{s}" for s in seq) + ";"


#: Texts without one of these are not looked at: every known sentence holds one.
WORDS = "licen|creative commons|permi|copyright|reserved|free software|gnu|warrant|redistribut|compliance|mpl|public domain|anyone is free"


def scan(docs: DataFrame, key: list[str] = ("doc_id",)) -> DataFrame:
    """``key`` columns, ``n_sentences`` (known ones), ``sentence_ids`` and ``licenses`` (both joined by commas) for every row.

    Only texts with a licence word are normalised; the lookup is an array expression within the row, so
    nothing is exploded, joined or shuffled.
    """
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    open_ = [(f"^(?:{_ITEM} )?{_open(s)}$", i) for s, i in SENTENCES.items() if "~" in s]

    def id_of(sentence: Column) -> Column:
        whole = F.try_element_at(known, sentence)
        item = F.try_element_at(known, F.regexp_replace(sentence, f"^{_ITEM} ", ""))
        return F.coalesce(whole, item, *[F.when(sentence.rlike(p), F.lit(i)) for p, i in open_])

    named = F.create_map(*[F.lit(x) for n, of in NAMES.items() for x in (n, f"tag-{of.lower()}")])

    def tags_of(sentence: Column) -> Column:
        """Identifiers of the names in a run, behind its opening words."""
        run = F.regexp_replace(sentence, f"^(?:{_ITEM} )?(?:{_BEFORE}) ", "")
        names = F.regexp_extract_all(run, F.lit(f"(?:^|(?:and|or|the) )({_names()})(?= (?:and|or|with) |$)"), F.lit(1))
        return F.transform(names, lambda n: F.coalesce(F.try_element_at(named, n), F.try_element_at(named, F.regexp_replace(n, " license$", ""))))

    def ids_of(sentence: Column) -> Column:
        one = id_of(sentence)
        return F.when(one.isNotNull(), F.array(one)).otherwise(tags_of(sentence))

    word = WORDS
    found = F.when(F.lower("text").rlike(word), F.regexp_extract_all(marked(F.col("text")), F.lit(_known()), F.lit(0)))
    found = F.coalesce(found, F.array().cast("array<string>"))
    ids = F.array_compact(F.flatten(F.transform(found, lambda s: ids_of(F.translate(s, SOFT, " ")))))
    rows = docs.select(*key, ids.alias("_ids"))
    joined = F.concat(F.lit(";"), F.array_join("_ids", ";"), F.lit(";"))
    return rows.select(
        *key,
        F.size("_ids").cast("long").alias("n_sentences"),
        F.array_join("_ids", ",").alias("sentence_ids"),
        F.array_join(F.when(F.size("_ids") > 0, _rules_for(joined)).otherwise(F.array().cast("array<string>")), ",").alias("licenses"),
    )


def oracle_sql() -> str:
    """The same in DuckDB SQL."""
    values = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items() if "~" not in s)
    open_ = " ".join(f"WHEN regexp_full_match(sentence, '{_open(s)}') THEN '{i}'" for s, i in SENTENCES.items() if "~" in s)
    rules = []
    for name, seq in sorted(RULES.items()):
        tests = [f"regexp_matches(ids, '{_pattern(seq)}')"]
        tests += [f"NOT regexp_matches(ids, '{_pattern(s)}')" for other, s in RULES.items() if other != name and set(seq) < set(s)]
        rules.append(f"CASE WHEN {' AND '.join(tests)} THEN '{name}' END")
    return f"""
WITH known(sentence, sid) AS (VALUES {values}),
parts AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '{SENTENCE_END}')) AS s,
                 generate_subscripts(string_split_regex(coalesce(text, ''), '{SENTENCE_END}'), 1) AS k FROM documents),
norm AS (SELECT doc_id, k, regexp_replace(trim(regexp_replace(regexp_replace(lower(s), '[^a-z0-9.]+', ' ', 'g'),
                '(^|[^0-9])[.]+|[.]+($|[^0-9])', '\\1 \\2', 'g')), ' +', ' ', 'g') AS sentence
         FROM parts WHERE regexp_matches(lower(s), '{WORDS}')),
named AS (SELECT doc_id, k, coalesce(known.sid, CASE {open_} END) AS sid FROM norm LEFT JOIN known USING (sentence)),
hits AS (SELECT doc_id, count(*) AS n, string_agg(sid, ',' ORDER BY k) AS sids, ';' || string_agg(sid, ';' ORDER BY k) || ';' AS ids
         FROM named WHERE sid IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(sids, '') AS sentence_ids,
       CASE WHEN ids IS NULL THEN '' ELSE concat_ws(',', {', '.join(rules)}) END AS licenses
FROM documents d LEFT JOIN hits h USING (doc_id)
"""
