"""License scans: ordered signature rules with a keyword prefilter, priorities and suppression of contained detections.

A text is reduced to its words, runs of digits, letters a-z (lower-cased) and characters beyond ASCII, with one blank
between. Every signature is a regular expression over whole words, with a label, a priority (0 is best), a confidence, and
a keyword that each text with a match contains. A text without any keyword is done; in the others only the signatures whose
keyword occurs are matched. Each match is a detection from its first to its last word. A detection is suppressed when one
of the same or a better priority spans all its words, the earlier rule winning if both span the same; as detections are
read by start, longest first, one running maximum of ends per priority decides that, so work is linear in detections.

The base phrases are places of their own: all of them count, suppressed or not, and their labels always stay. Signatures
without a label deny a license; they suppress what they span. The score is the chance that one surviving detection with a
label is right, taking confidences as independent, but for names that stand alone, which count once however many there
are; 0 without detections. A null text
counts as empty and has no words. Rows repeat as they are; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import quoted

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MARK = "\u0001"
NONE = ""  # the label of signatures that say what isn't so
BARE = 3  # the priority of names without a word of licensing beside them
CONFIDENCE = (0.95, 0.85, 0.6, 0.3)


@dataclass(frozen=True)
class Signature:
    label: str
    pattern: str
    keyword: str
    priority: int


# The phrases whose places are counted, and their labels.
BASE = (
    Signature("mit", "under the mit license", "under the mit license", 0),
    Signature("apache-2", "apache license version 2", "apache license version 2", 0),
    Signature("cc-by-nc", "cc by nc", "cc by nc", 0),
)

# Names of licenses by family: keyword of the family, then label and the expression of the name.
NAMES: dict[str, tuple[tuple[str, str], ...]] = {
    " mit ": (("mit", "mit"), ("mit", "mit expat"), ("mit-0", "mit no attribution"), ("mit-0", "mit 0")),
    "expat": (("mit", "expat"),),
    "apache": (("apache-2", "apache 2(?: 0)?"), ("apache-2", "apache (?:software )?license v?(?:ersion )?2(?: 0)?"),
               ("apache-1.1", "apache (?:software )?license v?(?:ersion )?1 1"), ("apache-1", "apache (?:software )?license v?(?:ersion )?1 0")),
    "general public": (
        ("gpl-3", "(?:gnu )?general public license v(?:ersion )?3"), ("gpl-2", "(?:gnu )?general public license v(?:ersion )?2"),
        ("gpl-1", "(?:gnu )?general public license v(?:ersion )?1"), ("gpl", "(?:gnu )?general public licen[cs]e")),
    "lesser general": (
        ("lgpl-3", "(?:gnu )?lesser general public license v(?:ersion )?3"),
        ("lgpl-2.1", "(?:gnu )?lesser general public license v(?:ersion )?2 1"), ("lgpl", "(?:gnu )?lesser general public licen[cs]e")),
    "library general": (("lgpl-2", "(?:gnu )?library general public license v(?:ersion )?2"), ("lgpl", "(?:gnu )?library general public licen[cs]e")),
    "affero": (("agpl-3", "(?:gnu )?affero general public license v(?:ersion )?3"), ("agpl", "(?:gnu )?affero general public licen[cs]e")),
    "gpl": (("gpl-3", "(?:gnu )?gpl ?v?3(?: 0)?"), ("gpl-2", "(?:gnu )?gpl ?v?2(?: 0)?"), ("gpl-1", "(?:gnu )?gpl ?v?1(?: 0)?"),
            ("agpl-3", "(?:gnu )?agpl ?v?3(?: 0)?"), ("lgpl-3", "(?:gnu )?lgpl ?v?3(?: 0)?"),
            ("lgpl-2.1", "(?:gnu )?lgpl ?v?2 1"), ("lgpl-2", "(?:gnu )?lgpl ?v?2(?: 0)?")),
    "documentation license": (("gfdl-1.3", "(?:gnu )?free documentation license v(?:ersion )?1 3"),
                              ("gfdl-1.2", "(?:gnu )?free documentation license v(?:ersion )?1 2"), ("gfdl", "(?:gnu )?free documentation license")),
    "bsd": (("bsd-3", "(?:new |modified |revised )bsd"), ("bsd-3", "(?:3|three) clause bsd"), ("bsd-3", "bsd (?:3|three)(?: clause)?"),
            ("bsd-2", "(?:simplified |free)bsd"), ("bsd-2", "(?:2|two) clause bsd"), ("bsd-2", "bsd (?:2|two)(?: clause)?"),
            ("bsd-4", "(?:4|four) clause bsd"), ("bsd-4", "bsd (?:4|four)(?: clause)?"), ("bsd-0", "zero clause bsd"), ("bsd", "bsd")),
    "mozilla public": (("mpl-2", "mozilla public license v?(?:ersion )?2(?: 0)?"), ("mpl-1.1", "mozilla public license v?(?:ersion )?1 1"),
                       ("mpl", "mozilla public license")),
    "mpl": (("mpl-2", "mpl ?v?2(?: 0)?"), ("mpl-1.1", "mpl ?v?1 1")),
    "eclipse": (("epl-2", "eclipse public license v?(?:ersion )?2(?: 0)?"), ("epl-1", "eclipse public license v?(?:ersion )?1(?: 0)?"),
                ("epl", "eclipse public license"), ("edl-1", "eclipse distribution license(?: v?(?:ersion )?1 0)?")),
    "common public": (("cpl-1", "common public license(?: v?(?:ersion )?1 0)?"),),
    "common development": (("cddl-1.1", "common development and distribution license v?(?:ersion )?1 1"),
                           ("cddl-1", "common development and distribution license")),
    "cddl": (("cddl-1", "cddl(?: 1 0)?"),),
    "boost": (("bsl-1", "boost software license(?: v?(?:ersion )?1 0)?"),),
    "artistic": (("artistic-2", "artistic license v?(?:ersion )?2(?: 0)?"), ("artistic-1", "artistic license(?: v?(?:ersion )?1 0)?")),
    "isc license": (("isc", "isc license"),),
    "zlib": (("zlib", "zlib(?: libpng)? license"), ("zlib", "zlib acknowledgement")),
    "unlicense": (("unlicense", "unlicense"),),
    "wtfpl": (("wtfpl", "wtfpl(?: v?2)?"),),
    "european union public": (("eupl-1.2", "european union public licen[cs]e v?(?:ersion )?1 2"), ("eupl", "european union public licen[cs]e")),
    "python software": (("psf-2", "python software foundation license(?: v?(?:ersion )?2)?"),),
    "microsoft": (("ms-pl", "microsoft public license"), ("ms-rl", "microsoft reciprocal license")),
    "open font": (("ofl-1.1", "(?:sil )?open font license(?: v?(?:ersion )?1 1)?"),),
    "open database": (("odbl-1", "open database license(?: v?(?:ersion )?1 0)?"),),
    "open data commons": (("odc-by-1", "open data commons attribution license(?: v1 0)?"), ("pddl-1", "open data commons public domain dedication and license")),
    "academic free": (("afl-3", "academic free license(?: v?(?:ersion )?3 0)?"),),
    "open software": (("osl-3", "open software license(?: v?(?:ersion )?3 0)?"),),
    "universal permissive": (("upl-1", "universal permissive license(?: v?(?:ersion )?1 0)?"),),
    "server side public": (("sspl-1", "server side public license(?: v?(?:ersion )?1)?"),),
    "elastic": (("elastic-2", "elastic license(?: v?(?:ersion )?2(?: 0)?)?"),),
    "business source": (("busl-1.1", "business source license(?: v?(?:ersion )?1 1)?"),),
    "llama": (("llama", "llama(?: 2| 3)? community license"),),
    "rail": (("openrail", "(?:creativeml )?open ?rail(?: m)?(?: license)?"),),
    "creative commons": (
        ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?"),
        ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike"),
        ("cc-by-nc", "creative commons attribution non ?commercial"), ("cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s?"),
        ("cc-by-sa", "creative commons attribution share ?alike"), ("cc-by", "creative commons attribution"),
        ("cc0-1", "creative commons (?:cc0|zero)"), ("cc", "creative commons")),
    "cc by": (("cc-by-nc-nd", "cc by nc nd"), ("cc-by-nc-sa", "cc by nc sa"), ("cc-by-nd", "cc by nd"), ("cc-by-sa", "cc by sa"), ("cc-by", "cc by")),
    "cc0": (("cc0-1", "cc0(?: 1 0)?(?: universal)?"),),
}

# Ways to name a license: expression with the name's place, and what it adds to the priority of the name.
FORMS = (
    ("licen[cs]ed under (?:the )?(?:terms of )?(?:the )?{}(?: licen[cs]e)?(?: v?(?:ersion )?[0-9](?: [0-9])?)?", 1),
    ("(?:released|distributed|available|published|provided|shared) under (?:the )?(?:terms of )?(?:the )?{}(?: licen[cs]e)?", 1),
    ("(?:subject to|governed by|in accordance with|pursuant to) (?:the )?(?:terms of )?(?:the )?{}(?: licen[cs]e)?", 1),
    ("spdx license identifier {}(?: only| or later)?", 0),
    ("{} licen[cs]e", 2),
    ("{}", 3),
)

# Texts that tell of rights without a license's name.
PHRASES = (
    Signature("proprietary", "all rights reserved", "rights reserved", 3),
    Signature("proprietary", "proprietary and confidential", "proprietary", 2),
    Signature("proprietary", "unauthorized (?:copying|reproduction|distribution)", "unauthorized", 2),
    Signature("proprietary", "may not be (?:copied|reproduced|distributed) without", "may not be", 3),
    Signature("public-domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain", "public domain", 1),
    Signature("public-domain", "public domain", "public domain", 3),
    Signature("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby", 1),
    Signature("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use", 1),
    Signature("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution and use", 1),
    Signature("gpl", "you can redistribute it and or modify it under the terms", "redistribute it", 2),
    Signature("unlicense", "this is free and unencumbered software", "unencumbered", 1),
    Signature("zlib", "this software is provided as is without any express or implied warranty", "implied warranty", 2),
    Signature("wtfpl", "do what the fuck you want to public license", "want to public license", 1),
    # notices in the heads of files
    Signature("apache-2", "you may not use this file except in compliance with the license", "except in compliance with the license", 1),
    Signature("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license", "required by applicable law", 1),
    Signature("apache-2", "licensed to the apache software foundation asf under one or more contributor license agreements", "contributor license agreements", 1),
    Signature("gpl-3", "either version 3 (?:of the license )?or at your option any later version", "at your option any later version", 2),
    Signature("gpl-2", "either version 2 (?:of the license )?or at your option any later version", "at your option any later version", 2),
    Signature("gpl", "along with this program if not (?:see|write to)", "along with this program", 2),
    Signature("lgpl", "this library is free software you can redistribute it", "library is free software", 1),
    Signature("gpl", "this program is free software you can redistribute it", "program is free software", 1),
    Signature("agpl", "notwithstanding any other provision of this license if you modify the program your modified version must prominently offer", "must prominently offer", 1),
    Signature("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "source code form is subject", 0),
    Signature("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at", "copy of the mpl", 1),
    Signature("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "contents of this file are subject", 0),
    Signature("cddl-1", "the contents of this file are subject to the terms of the common development and distribution license", "contents of this file are subject", 0),
    Signature("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "accompanying materials", 0),
    Signature("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", "accompanying materials", 0),
    Signature("bsd", "use of this source code is governed by a bsd style license", "governed by a bsd style", 0),
    Signature("mit", "use of this source code is governed by an mit style license", "governed by an mit style", 0),
    Signature("unlicense", "released into the public domain by (?:the|its) authors? anyone is free to copy modify publish", "anyone is free to copy", 1),
    Signature("cc0-1", "to the extent possible under law [^ ]+(?: [^ ]+){0,8} has waived all copyright and related or neighboring rights", "to the extent possible under law", 0),
    Signature("cc0-1", "waived all copyright and related or neighboring rights", "neighboring rights", 1),
    Signature("proprietary", "no part of this (?:publication|document|work|file) may be reproduced", "may be reproduced", 2),
    Signature("proprietary", "for internal use only", "internal use only", 3),
    Signature("proprietary", "contains trade secrets", "trade secrets", 3),
    Signature("proprietary", "strictly prohibited without (?:the )?(?:prior|express) (?:written )?(?:permission|consent)", "strictly prohibited", 2),
    # grants and conditions
    Signature("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions", "permission notice shall be included", 1),
    Signature("bsd-3", "neither the name of (?:the )?[^ ]+(?: [^ ]+){0,10} nor the names of its contributors may be used to endorse or promote", "nor the names of its contributors", 1),
    Signature("bsd-4", "all advertising materials mentioning features or use of this software must display the following acknowledgement", "all advertising materials", 1),
    Signature("bsd", "redistributions of source code must retain the above copyright notice", "redistributions of source code", 1),
    Signature("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions in binary form", 1),
    Signature("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", "without fee is hereby granted", 1),
    Signature("zlib", "altered source versions must be plainly marked as such", "altered source versions", 1),
    Signature("zlib", "the origin of this software must not be misrepresented", "must not be misrepresented", 1),
    Signature("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation",
              "any person or organization obtaining", 0),
    Signature("ofl-1.1", "the font software may be sold as part of a larger software package", "font software", 1),
    Signature("ofl-1.1", "reserved font names?", "reserved font", 2),
    Signature("artistic-1", "the intent of this document is to state the conditions under which a package may be copied", "intent of this document is to state", 1),
    Signature("cc", "some rights reserved", "some rights reserved", 3),
    Signature("cc-by-sa", "you may share and adapt [^ ]+(?: [^ ]+){0,12} as long as you give appropriate credit [^ ]+(?: [^ ]+){0,8} under the same license", "appropriate credit", 2),
    # disclaimers
    Signature("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", "authors or copyright holders be liable", 2),
    Signature("isc", "the author disclaims all warranties with regard to this software", "disclaims all warranties with regard", 2),
    Signature("bsd", "this software is provided by the copyright holders and contributors as is", "copyright holders and contributors as is", 1),
    Signature("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose", "without even the implied warranty", 2),
    Signature("apache-2", "distributed on an as is basis without warranties or conditions of any kind", "warranties or conditions of any kind", 1),
    # addresses of licenses
    Signature("apache-2", "(?:www )?apache org licenses license 2 0", "apache org licenses", 0),
    Signature("apache-1.1", "(?:www )?apache org licenses license 1 1", "apache org licenses", 0),
    Signature("gpl-3", "(?:www )?gnu org licenses gpl 3 0", "gnu org licenses", 0), Signature("gpl-2", "(?:www )?gnu org licenses (?:old licenses )?gpl 2 0", "gnu org licenses", 0),
    Signature("lgpl-3", "(?:www )?gnu org licenses lgpl 3 0", "gnu org licenses", 0),
    Signature("lgpl-2.1", "(?:www )?gnu org licenses (?:old licenses )?lgpl 2 1", "gnu org licenses", 0),
    Signature("agpl-3", "(?:www )?gnu org licenses agpl 3 0", "gnu org licenses", 0), Signature("gfdl-1.3", "(?:www )?gnu org licenses fdl 1 3", "gnu org licenses", 0),
    Signature("gpl", "(?:www )?gnu org licenses", "gnu org licenses", 2), Signature("mpl-2", "(?:www )?mozilla org mpl 2 0", "mozilla org mpl", 0),
    Signature("mit", "opensource org licenses mit(?: license)?", "opensource org licenses", 0), Signature("bsd-3", "opensource org licenses bsd 3 clause", "opensource org licenses", 0),
    Signature("bsd-2", "opensource org licenses bsd 2 clause", "opensource org licenses", 0), Signature("isc", "opensource org licenses isc", "opensource org licenses", 0),
    Signature("cc-by", "creativecommons org licenses by [0-9] [0-9]", "creativecommons org", 0),
    Signature("cc-by-sa", "creativecommons org licenses by sa [0-9] [0-9]", "creativecommons org", 0),
    Signature("cc-by-nc", "creativecommons org licenses by nc [0-9] [0-9]", "creativecommons org", 0),
    Signature("cc-by-nd", "creativecommons org licenses by nd [0-9] [0-9]", "creativecommons org", 0),
    Signature("cc-by-nc-sa", "creativecommons org licenses by nc sa [0-9] [0-9]", "creativecommons org", 0),
    Signature("cc-by-nc-nd", "creativecommons org licenses by nc nd [0-9] [0-9]", "creativecommons org", 0),
    Signature("cc0-1", "creativecommons org publicdomain zero 1 0", "creativecommons org", 0), Signature("unlicense", "unlicense org", "unlicense org", 1),
    Signature("wtfpl", "www wtfpl net", "wtfpl net", 1), Signature("bsl-1", "(?:www )?boost org license 1 0 txt", "boost org license", 0),
    Signature("epl-2", "(?:www )?eclipse org legal epl (?:2 0|v20)", "eclipse org legal", 0), Signature("epl-1", "(?:www )?eclipse org legal epl v10", "eclipse org legal", 0),
    # sentences that deny a license: they suppress what they span, and have no label
    Signature(NONE, "(?:not|never|no longer|isn t|aren t) (?:licen[cs]ed|released|distributed|available|published|covered) (?:under|by) (?:[^ ]+ ){1,8}?licen[cs]e(?: v?(?:ersion )?[0-9](?: [0-9])?)?",
              "licen", 0),
    Signature(NONE, "(?:not|never|no longer) (?:licen[cs]ed|covered|governed) by (?:[^ ]+ ){1,8}?licen[cs]e", "licen", 0),
    Signature(NONE, "(?:not |in)compatible with (?:[^ ]+ ){1,8}?licen[cs]e(?: v?(?:ersion )?[0-9](?: [0-9])?)?", "compatible with", 0),
)


def signatures() -> list[Signature]:
    """All rules in order: the base phrases, the names in each form, other phrases. The family " mit " has names that are
    common words, and takes all forms but the bare name."""
    named = [Signature(label, form.format(f"(?:{name})"), keyword, priority)
             for form, priority in FORMS for keyword, names in NAMES.items() for label, name in names
             if keyword != " mit " or form != "{}"]
    return [*BASE, *named, *PHRASES]


def normalised(text: Column) -> Column:
    """The words of a text, each with a blank on both sides; one blank for none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = F.trim(F.regexp_replace(lowered, SEPARATORS, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _matches(norm: Column, s: Column) -> Column:
    """The detections of one signature in a text: a struct each, sorted as `_resolved` wants them."""
    marked = F.regexp_replace(norm, s["pattern"], F.lit(MARK + "$0"))
    starts = F.filter(F.transform(F.split(F.trim(marked), " "), lambda w, i: F.when(w.startswith(MARK), i)), lambda i: i.isNotNull())
    lengths = F.transform(F.regexp_extract_all(norm, s["pattern"], F.lit(0)), lambda m: F.size(F.split(m, " ")))
    return F.zip_with(starts, lengths, lambda a, n: F.struct(
        a.cast("long").alias("start"), (-(a + n - 1)).cast("long").alias("minus_end"), s["priority"].alias("priority"),
        s["id"].alias("id"), s["label"].alias("label")))


def _resolved(detections: Column) -> Column:
    """struct(labels, miss) of what survives; miss: the chance that no surviving detection is right."""
    levels = len(CONFIDENCE)
    wrong = F.array(*[F.lit(1 - c) for c in CONFIDENCE])
    start = F.struct(F.array_repeat(F.lit(-1).cast("long"), levels).alias("ends"),
                     F.array().cast("array<string>").alias("labels"), F.lit(1.0).alias("miss"), F.lit(False).alias("bare"))

    def read(state: Column, x: Column) -> Column:
        end = -x["minus_end"]
        hidden = F.get(state["ends"], x["priority"]) >= end
        silent = hidden | (x["label"] == NONE)
        bare = x["priority"] == BARE
        ends = F.transform(state["ends"], lambda e, p: F.when(p >= x["priority"], F.greatest(e, end)).otherwise(e))
        return F.struct(ends.alias("ends"),
                        F.when(silent, state["labels"]).otherwise(F.array_union(state["labels"], F.array(x["label"]))).alias("labels"),
                        F.when(silent | (bare & state["bare"]), state["miss"]).otherwise(state["miss"] * F.get(wrong, x["priority"])).alias("miss"),
                        (state["bare"] | (bare & ~silent)).alias("bare"))

    return F.aggregate(detections, start, read, lambda s: F.struct(s["labels"].alias("labels"), s["miss"].alias("miss")))


def scanned(docs: DataFrame, rules: list[Signature] | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and `detections` as they were found
    (start, end, label, priority). The first len(BASE) rules are the base phrases."""
    rules = signatures() if rules is None else rules
    norm = docs.select(quoted(id).alias("doc_id"), normalised(quoted(text)).alias("norm"))
    some = F.lit(False)
    for keyword in sorted({r.keyword for r in rules}):
        some = some | F.contains(F.col("norm"), F.lit(keyword))
    families: dict[str, list[Column]] = {}
    for n, r in enumerate(rules):
        families.setdefault(r.keyword, []).append(F.struct(
            F.lit(n).alias("id"), F.lit(r.label).alias("label"), F.lit(f"(?<= )(?:{r.pattern})(?= )").alias("pattern"),
            F.lit(r.priority).alias("priority")))
    table = F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*v).alias("rules")) for k, v in families.items()])
    hit = F.filter(table, lambda f: F.contains(F.col("norm"), f["keyword"]))
    able = F.filter(F.flatten(F.transform(hit, lambda f: f["rules"])), lambda s: F.regexp_like(F.col("norm"), s["pattern"]))  # most don't match
    found = F.sort_array(F.flatten(F.transform(able, lambda s: _matches(F.col("norm"), s))))
    none = F.array().cast("array<struct<start:bigint,minus_end:bigint,priority:int,id:int,label:string>>")
    rows = norm.select("doc_id", F.inline(F.array(F.struct(
        (F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) - 1).cast("long").alias("n_words"),
        F.when(some, found).otherwise(none).alias("found")))))
    base = F.filter("found", lambda x: x["id"] < len(BASE))
    rows = rows.select("doc_id", "n_words", "found", F.inline(F.array(F.struct(base.alias("base"), _resolved(F.col("found")).alias("kept")))))
    labels = F.array_distinct(F.transform("base", lambda x: x["label"]))
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["start"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["start"])).alias("last_word"),
        F.array_join(F.sort_array(labels), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(labels, F.col("kept.labels"))), ",").alias("labels"),
        (1 - F.col("kept.miss")).alias("score"),
        F.transform("found", lambda x: F.struct(x["start"].alias("start"), (-x["minus_end"]).alias("end"), x["label"].alias("label"),
                                                x["priority"].alias("priority"))).alias("detections"))
