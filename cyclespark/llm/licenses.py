"""License scan by ordered signature rules (operator 3), DataFrame functions only.

Texts without any keyword are passed over by plain substring tests. In the others, the
words are joined by single blanks, each rule whose own keyword occurs is matched as a
regular expression on whole words, and detections are resolved: one that lies inside the
interval of a detection of higher priority is suppressed. All steps are linear in the text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Words of a text in lower case; the same class on mixed case (fixed values).
LOWER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The contract's phrases and their labels (fixed values).
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: (label, keyword, name as words, SPDX identifier as words); names are regular expressions.
#: Every string that a name matches contains the keyword; names without a common one have a
#: row each, without an identifier but the first.
FAMILIES = [
    ("mit", "licen", r"(?:expat|mit) licen[cs]e", "mit"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?", "mit 0"),
    ("apache-2", "apache", r"apache(?: software)? licen[cs]e(?: version)? (?:v2|2)(?: 0)?", "apache 2 0"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e(?: version)? 1 1", "apache 1 1"),
    ("gpl-3", "public", r"(?:gnu )?general public licen[cs]e(?: gpl)?(?: version)? (?:v3|3)(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl-2", "public", r"(?:gnu )?general public licen[cs]e(?: gpl)?(?: version)? (?:v2|2)(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("lgpl-3", "lesser", r"(?:gnu )?lesser general public licen[cs]e(?: lgpl)?(?: version)? (?:v3|3)(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[cs]e(?: lgpl)?(?: version)? 2(?: [01])?", "lgpl 2 [01](?: only| or later)?"),
    ("lgpl-2.1", "library", r"(?:gnu )?library general public licen[cs]e(?: lgpl)?(?: version)? 2(?: [01])?", None),
    ("agpl-3", "affero", r"(?:gnu )?affero general public licen[cs]e(?: agpl)?(?: version)? (?:v3|3)(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd)(?: licen[cs]e)?", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)?", "bsd 4 clause"),
    ("0bsd", "bsd", r"(?:zero clause bsd|bsd zero clause)(?: licen[cs]e)?", "0bsd"),
    ("mpl-2", "mozilla", r"mozilla public licen[cs]e(?: mpl)?(?: version)? (?:v2|2)(?: 0)?", "mpl 2 0"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e(?: mpl)?(?: version)? 1 1", "mpl 1 1"),
    ("epl-2", "eclipse", r"eclipse public licen[cs]e(?: epl)?(?: version)? (?:v2|2)(?: 0)?", "epl 2 0"),
    ("epl-1", "eclipse", r"eclipse public licen[cs]e(?: epl)?(?: version)? (?:v1|1)(?: 0)?", "epl 1 0"),
    ("cddl-1", "common", r"common development and distribution licen[cs]e(?: cddl)?(?: version)? 1 0", "cddl 1 0"),
    ("eupl-1.2", "european", r"european union public licen[cs]e(?: eupl)?(?: version)? 1 2", "eupl 1 2"),
    ("isc", "isc", r"isc licen[cs]e", "isc"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", "zlib"),
    ("boost-1", "boost", r"boost software licen[cs]e(?: version)?(?: 1 0)?", "bsl 1 0"),
    ("unlicense", "unlicen", r"(?:the )?unlicen[cs]e", "unlicense"),
    ("wtfpl", "wtf", r"wtfpl", "wtfpl"),
    ("wtfpl", "fuck", r"do what the fuck you want to public licen[cs]e", None),
    ("artistic-2", "artistic", r"artistic licen[cs]e(?: version)?(?: 2 0)?", "artistic 2 0"),
    ("perl", "perl", r"same terms as perl(?: itself)?", "artistic 1 0 perl"),
    ("php-3", "php", r"php licen[cs]e(?: version)?(?: 3 0[01]?)?", "php 3 0[01]?"),
    ("python-2", "python", r"python software foundation licen[cs]e(?: version)?(?: 2)?", "(?:psf|python) 2 0"),
    ("python-2", "psf", r"psf licen[cs]e(?: version)?(?: 2)?", None),
    ("ruby", "ruby", r"ruby licen[cs]e", "ruby"),
    ("openssl", "openssl", r"openssl licen[cs]e", "openssl"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", "postgresql"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", "ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", "ms rl"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[cs]e(?: version)?(?: 1 1)?", "ofl 1 1"),
    ("odbl-1", "open da", r"open (?:data commons open )?database licen[cs]e(?: odbl)?", "odbl 1 0"),
    ("cc0-1", "cc0", r"cc0(?: 1 0)?", "cc0 1 0"),
    ("cc0-1", "creative", r"creative commons zero(?: 1 0)?", None),
    ("cc-by", "cc", r"cc by(?: [1-4] 0)?(?! (?:sa|nc|nd))", "cc by [1-4] 0"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] 0)?", "cc by sa [1-4] 0"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] 0)?", "cc by nd [1-4] 0"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4] 0)?(?! (?:sa|nd))", "cc by nc [1-4] 0"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] 0)?", "cc by nc sa [1-4] 0"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] 0)?", "cc by nc nd [1-4] 0"),
    ("cc-by", "creative", r"creative commons attribution(?: [1-4] 0)?(?! (?:share|non))(?: international)?", "cc by"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4] 0)?", "cc by sa"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1-4] 0)?", "cc by nc"),
    ("elastic-2", "elastic", r"elastic licen[cs]e(?: version)?(?: 2 0)?", "elastic 2 0"),
    ("sspl-1", "server", r"server side public licen[cs]e(?: version)?(?: 1)?", "sspl 1 0"),
    ("busl-1.1", "business", r"business source licen[cs]e(?: version)?(?: 1 1)?", "busl 1 1"),
]

#: (template, priority, score): lower priority numbers win.
TEMPLATES = [
    (r"spdx licen[cs]e identifier {spdx}", 1, 1.0),
    (r"(?:licen[cs]ed|released|distributed|published|provided|covered|made available|available) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}", 1, 0.95),
    (r"(?:subject to|governed by|pursuant to|see|accept) (?:the )?(?:terms of )?(?:the )?{name}", 2, 0.85),
    (r"(?:licen[cs]e|licen[cs]es|licen[cs]ing) (?:is )?(?:the )?{name}", 2, 0.8),
    (r"{name}", 3, 0.7),
]

#: Sentences of the notices and bodies of licenses: (label, keyword, expression, priority, score).
SIGNATURES = [
    ("mit", "person obtaining", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 1, 0.98),
    ("mit", "permission notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", 2, 0.9),
    ("boost-1", "organization obtaining", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software", 1, 0.98),
    ("isc", "without fee", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 1, 0.95),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 2, 0.9),
    ("bsd-3-clause", "endorse", r"contributors may be used to endorse or promote products derived from this software", 1, 0.95),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display", 1, 0.97),
    ("apache-2", "compliance", r"you may not use this file except in compliance with the licen[cs]e", 1, 0.95),
    ("apache-2", "applicable", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e", 2, 0.9),
    ("apache-2", "perpetual", r"hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e", 1, 0.97),
    ("gpl-2", "foundation", r"gnu general public licen[cs]e as published by the free software foundation either version 2", 1, 0.98),
    ("gpl-3", "foundation", r"gnu general public licen[cs]e as published by the free software foundation either version 3", 1, 0.98),
    ("lgpl-2.1", "foundation", r"gnu (?:lesser|library) general public licen[cs]e as published by the free software foundation either version 2", 1, 0.98),
    ("lgpl-3", "foundation", r"gnu lesser general public licen[cs]e as published by the free software foundation either version 3", 1, 0.98),
    ("agpl-3", "foundation", r"gnu affero general public licen[cs]e as published by the free software foundation either version 3", 1, 0.98),
    ("gpl", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu", 3, 0.7),
    ("gfdl", "documentation", r"under the terms of the gnu free documentation licen[cs]e", 1, 0.95),
    ("mpl-2", "source code form", r"this source code form is subject to the terms of the mozilla public licen[cs]e", 1, 0.98),
    ("mpl-1.1", "contents of this file", r"the contents of this file are subject to the mozilla public licen[cs]e", 1, 0.95),
    ("epl-2", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v|version )?2", 1, 0.97),
    ("epl-1", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v|version )?1", 1, 0.97),
    ("cddl-1", "contents of this file", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e", 1, 0.97),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 1, 0.98),
    ("zlib", "liable", r"in no event will the authors be held liable for any damages arising from the use of this software", 1, 0.9),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 1, 0.93),
    ("wtfpl", "verbatim", r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document", 1, 0.95),
    ("gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed", 2, 0.85),
    ("cc0-1", "neighboring", r"waived all copyright and related or neighboring rights", 1, 0.95),
    ("cc-by", "creative", r"this work is licen[cs]ed under a creative commons attribution [1-4] 0", 1, 0.95),
    ("cc-by-sa", "creative", r"this work is licen[cs]ed under a creative commons attribution share ?alike", 1, 0.95),
    ("cc-by-nc", "creative", r"this work is licen[cs]ed under a creative commons attribution non ?commercial", 1, 0.95),
    ("ofl-1.1", "font software", r"this font software is licen[cs]ed under the sil open font licen[cs]e", 1, 0.98),
    ("artistic-2", "package", r"licen[cs]e establishes the terms under which a given free software package may be copied", 1, 0.95),
    ("artistic-1", "package", r"the intent of this document is to state the conditions under which a package may be copied", 1, 0.95),
    ("python-2", "individual or organization", r"between the python software foundation psf and the individual or organization", 1, 0.95),
    ("ms-pl", "governs", r"this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e", 1, 0.9),
    ("eupl-1.2", "eupl", r"licen[cs]ed under the eupl(?: version 1 2)?", 1, 0.93),
    ("openssl", "toolkit", r"software developed by the openssl project for use in the openssl toolkit", 1, 0.95),
    ("json", "evil", r"the software shall be used for good not evil", 1, 0.97),
    ("sspl-1", "server side", r"server side public licen[cs]e as published by mongodb", 1, 0.97),
    ("elastic-2", "managed service", r"you may not provide the software to third parties as a hosted or managed service", 1, 0.95),
    ("busl-1.1", "production use", r"the licensor may make an additional use grant above permitting limited production use", 1, 0.95),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|distribution|use) of this (?:file|software|document|program)", 3, 0.6),
    ("proprietary", "trade secret", r"contains (?:confidential and )?(?:proprietary )?trade secrets?", 4, 0.5),
]

#: Rules of their own: (label, keyword, expression, priority, score).
GENERIC = [
    ("gpl", "public", r"(?:gnu )?general public licen[cs]e", 3, 0.6),
    ("public-domain", "public domain", r"(?:in|into|to) the public domain", 3, 0.6),
    ("proprietary", "rights", r"all rights reserved", 4, 0.5),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)", 4, 0.5),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9]", 4, 0.3),
    ("unknown-license", "licen", r"licen[cs]ed under", 4, 0.2),
]

#: No rule and no base phrase matches a text without one of these.
GATES = (
    "licen", "spdx", "copyright", "public domain", "rights", "terms", "confidential", "wtf", "bsd", "attribution", "creative", "cc0",
    "hereby", "permission", "redistribution", "endorse", "advertising", "merchantability", "unencumbered", "liable", "misrepresented", "neighboring",
    "package", "foundation", "toolkit", "evil", "hosted", "production", "unauthorized", "secret",
)


def rules() -> list[tuple[str, str, str, int, float]]:
    """All rules in order: (label, keyword, expression, priority, score)."""
    made = [
        (label, "spdx" if "{spdx}" in t else keyword, t.format(name=name, spdx=spdx), priority, score)
        for t, priority, score in TEMPLATES
        for label, keyword, name, spdx in FAMILIES
        if spdx or "{spdx}" not in t
    ]
    return made + SIGNATURES + GENERIC


def _whole_words(expression: str) -> str:
    return rf"(?<![^ ])((?:{expression}))(?![^ ])"


def _places(joined: Column, expression: Column) -> Column:
    """First and last word of each match, by marking the matches with control characters."""
    marked = F.split(F.regexp_replace(joined, expression, F.lit("\x01$1\x02")), " ")

    def at(words: Column, mark: str) -> Column:
        return F.array_compact(F.transform(words, lambda w, i: F.when(F.contains(w, F.lit(mark)), i)))

    return let(marked, lambda m: F.arrays_zip(at(m, "\x01").alias("s"), at(m, "\x02").alias("e")))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels and score.

    n_base counts all places of the base phrases, first_word and last_word are their
    smallest and largest starts (words from 0, else null). labels are the base labels and
    those of the rules that no detection of higher priority contains, distinct, sorted,
    joined by commas. score is the best score of a kept rule, at least 0.7 with a base
    label, 0 without labels. A null text counts as empty: no words, no labels. Rows are
    independent, so ties, copies and empty tables need no care; columns of these names are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(whole)
    gate = F.lit(False)
    for g in GATES:
        gate = gate | F.contains(low, F.lit(g))
    gate = gate | (F.contains(low, F.lit("cc")) & low.rlike(r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"))
    gate = gate | F.contains(low, F.lit("public"))

    table = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.lit(keyword).alias("keyword"), F.lit(_whole_words(e)).alias("e"), F.lit(p).alias("p"), F.lit(s).alias("score"))
            for label, keyword, e, p, s in rules()
        ]
    )

    def detections(joined: Column) -> Column:
        asked = F.filter(table, lambda r: F.contains(joined, r["keyword"]))
        found = F.transform(
            asked,
            lambda r: F.transform(
                _places(joined, r["e"]),
                lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), r["p"].alias("p"), r["label"].alias("label"), r["score"].alias("score")),
            ),
        )
        return F.array_sort(F.flatten(found))  # containers before what they contain

    def resolved(found: Column) -> Column:
        """Labels and best score of what no higher priority contains; ends so far by priority."""
        start = F.struct(
            *[F.lit(-1).alias(f"m{p}") for p in (1, 2, 3)], F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score")
        )

        def step(a: Column, d: Column) -> Column:
            inside = F.lit(False)
            for p in (1, 2, 3):
                inside = inside | ((d["p"] > p) & (a[f"m{p}"] >= -d["e"]))
            return F.struct(
                *[F.when(d["p"] == p, F.greatest(a[f"m{p}"], -d["e"])).otherwise(a[f"m{p}"]).alias(f"m{p}") for p in (1, 2, 3)],
                F.when(inside, a["labels"]).otherwise(F.array_union(a["labels"], F.array(d["label"]))).alias("labels"),
                F.when(inside, a["score"]).otherwise(F.greatest(a["score"], d["score"])).alias("score"),
            )

        return F.aggregate(found, start, step)

    def one(joined: Column) -> Column:
        base = F.array(
            *[F.struct(F.transform(_places(joined, F.lit(_whole_words(phrase))), lambda x: x["s"]).alias("at"), F.lit(label).alias("label")) for phrase, label in BASE.items()]
        )
        return F.struct(base.alias("base"), resolved(detections(joined)).alias("rest"))

    words = F.regexp_extract_all(F.translate(whole, UPPER, LOWER), F.lit(LOWER_WORD), F.lit(0))
    made = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    carry = [c for c in docs.columns if c not in made]
    n_words = F.regexp_count(whole, F.lit(WORD)).cast("long")
    out = docs.select(F.struct(*carry).alias("_rest"), n_words.alias("n_words"), F.when(gate, let(F.array_join(words, " "), one)).alias("_scan"))
    starts = F.flatten(F.transform(F.col("_scan.base"), lambda b: b["at"]))
    labels = F.transform(F.filter(F.col("_scan.base"), lambda b: F.size(b["at"]) > 0), lambda b: b["label"])
    out = out.withColumns({"_starts": starts, "_labels": labels})
    every = F.array_sort(F.array_union(F.col("_labels"), F.col("_scan.rest.labels")))
    based = F.size("_labels") > 0
    out = out.withColumns(
        {
            "n_base": F.coalesce(F.when(F.col("_scan").isNotNull(), F.size("_starts")), F.lit(0)).cast("long"),
            "first_word": F.array_min("_starts").cast("long"),
            "last_word": F.array_max("_starts").cast("long"),
            "base_labels": F.coalesce(F.array_join(F.array_sort("_labels"), ","), F.lit("")),
            "labels": F.coalesce(F.array_join(every, ","), F.lit("")),
            "score": F.coalesce(F.greatest(F.col("_scan.rest.score"), F.when(based, 0.7).otherwise(0.0)), F.lit(0.0)),
        }
    )
    return out.select(*[F.col("_rest")[c].alias(c) for c in carry], *made)


def gated(text: str) -> bool:
    """Whether ``scan`` looks at a text at all; for tests of the gate against the rules."""
    low = text.lower()
    return any(g in low for g in (*GATES, "public")) or bool(re.search(r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by", low))
