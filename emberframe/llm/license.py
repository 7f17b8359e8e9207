"""License scan by ordered signature rules, in DataFrame functions only.

A rule is a label, keywords, a regex, a priority and a weight: hand-written notices, and the wordings in which a license
is named, for every license. A few plain substrings, one of which every match holds, decide whether a text is looked at;
then only rules are run of which the text holds a keyword: every match of a rule holds at least one. Whether a rule
matches at all is asked by constant regexes, compiled once a task; only rules that match are asked where.

Detections resolve in two steps. One that lies inside another (or at the same place, with a worse priority) is dropped.
Of the rest, by priority and then by place, each is kept unless it overlaps one that is kept already; so what a dropped
one would have displaced stays. Everything happens within a row, so nothing is shuffled and no key can be hot.

Nulls count as empty texts: no words, no labels, score 0. Repeated rows give repeated results; ids may be any long. Other
columns are not read.
"""

from __future__ import annotations

import json
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import pick

WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels, fixed values.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Every base phrase holds one of the first, and every rule's match one of the second, whatever the case.
BASE_GATE = ("license", "cc")
GATE = (
    "licen", "spdx", "permission", "redistribution", "copyright", "rights reserved", "public domain", "as-is", "as is", "free software", "source code form",
    "unencumbered", "neither the name", "do what the", " under ", "promote products", "advertising materials", "altered", "warrant", "free to copy", "software developed by",
    "includes php", "good, not evil", "buy me a beer", "same terms as perl", "creativecommons.org", "reproduced", "proprietary", "unauthorized", "non-commercial", "noncommercial",
    "personal use", "evaluation purposes", "patent rights", "jpeg group", "opensource.org", "gnu.org", "mozilla.org", "unlicense.org", "apache.org", "eclipse.org", "x consortium", "later version",
    "not distributed with this file", "cryptographic software",
)
#: label | keywords, one of which every name holds | name as a regex | SPDX identifier as a regex
LICENSES = r"""
mit|mit|(?:the )?mit(?:/x11)?|mit(?:-0|-feh)?
x11|x11|(?:the )?x11|x11
apache-2|apache|(?:the )?apache(?: software)?(?: license)?,? ?(?:version |v)?2(?:\.0)?|apache-2\.0
apache-1.1|apache|(?:the )?apache(?: software)?(?: license)?,? ?(?:version |v)?1\.1|apache-1\.1
bsd-2|bsd|(?:the )?(?:simplified|2-clause|two-clause) bsd|bsd-2-clause(?:-patent|-views)?
bsd-3|bsd|(?:the )?(?:new|modified|revised|3-clause|three-clause) bsd|bsd-3-clause(?:-clear|-lbnl)?
bsd-4|bsd|(?:the )?(?:original|4-clause|four-clause) bsd|bsd-4-clause(?:-uc)?
bsd-0|bsd|(?:the )?(?:zero-clause|0-clause) bsd|0bsd
isc|isc|(?:the )?isc|isc
zlib|zlib|(?:the )?zlib(?:/libpng)?|zlib
gpl-3|gnu|(?:the )?gnu (?:general public license|gpl),? ?(?:version |v)?3(?:\.0)?|gpl-3\.0(?:-only|-or-later|\+)?
gpl-2|gnu|(?:the )?gnu (?:general public license|gpl),? ?(?:version |v)?2(?:\.0)?|gpl-2\.0(?:-only|-or-later|\+)?
gpl-1|gnu|(?:the )?gnu (?:general public license|gpl),? ?(?:version |v)?1(?:\.0)?|gpl-1\.0(?:-only|-or-later|\+)?
gpl|general public|(?:the )?(?:gnu )?general public license|gpl
lgpl-3|lesser|(?:the )?gnu lesser general public license,? ?(?:version |v)?3(?:\.0)?|lgpl-3\.0(?:-only|-or-later|\+)?
lgpl-2.1|lesser|(?:the )?gnu lesser general public license,? ?(?:version |v)?2\.1|lgpl-2\.1(?:-only|-or-later|\+)?
lgpl-2|library|(?:the )?gnu library general public license,? ?(?:version |v)?2(?:\.0)?|lgpl-2\.0(?:-only|-or-later|\+)?
agpl-3|affero|(?:the )?gnu affero general public license,? ?(?:version |v)?3(?:\.0)?|agpl-3\.0(?:-only|-or-later|\+)?
fdl-1.3|documentation|(?:the )?gnu free documentation license,? ?(?:version |v)?1\.3|gfdl-1\.3(?:-only|-or-later)?
fdl-1.2|documentation|(?:the )?gnu free documentation license,? ?(?:version |v)?1\.2|gfdl-1\.2(?:-only|-or-later)?
mpl-2|mozilla|(?:the )?mozilla public license,? ?(?:version |v)?2(?:\.0)?|mpl-2\.0(?:-no-copyleft-exception)?
mpl-1.1|mozilla|(?:the )?mozilla public license,? ?(?:version |v)?1\.1|mpl-1\.1
epl-2|eclipse|(?:the )?eclipse public license,? ?(?:version |v)?2(?:\.0)?|epl-2\.0
epl-1|eclipse|(?:the )?eclipse public license,? ?(?:version |v)?1(?:\.0)?|epl-1\.0
cddl-1|development and distribution|(?:the )?common development and distribution license,? ?(?:version |v)?1(?:\.0)?|cddl-1\.0
cpl-1|common public|(?:the )?common public license,? ?(?:version |v)?1(?:\.0)?|cpl-1\.0
eupl-1.2|european union|(?:the )?european union public licen[cs]e,? ?(?:version |v)?1\.2|eupl-1\.2
artistic-2|artistic|(?:the )?artistic license,? ?(?:version |v)?2(?:\.0)?|artistic-2\.0
artistic-1|artistic|(?:the )?artistic license,? ?(?:version |v)?1(?:\.0)?|artistic-1\.0
bsl-1|boost|(?:the )?boost software license,? ?(?:version |v)?1(?:\.0)?|bsl-1\.0
unlicense|unlicense|(?:the )?unlicense|unlicense
wtfpl|wtfpl|(?:the )?wtfpl|wtfpl
psf-2|python|(?:the )?python software foundation license,? ?(?:version |v)?2?|psf-2\.0
openssl|openssl|(?:the )?openssl(?:/ssleay)?|openssl
postgresql|postgresql|(?:the )?postgresql|postgresql
ncsa|ncsa|(?:the )?(?:university of illinois/)?ncsa(?: open source)?|ncsa
ofl-1.1|open font|(?:the )?sil open font license,? ?(?:version |v)?1\.1|ofl-1\.1
ms-pl|microsoft|(?:the )?microsoft public license|ms-pl
ms-rl|microsoft|(?:the )?microsoft reciprocal license|ms-rl
odbl-1|open database|(?:the )?open database license(?: \(odbl\))?,? ?(?:version |v)?1?(?:\.0)?|odbl-1\.0
cc0|zero,cc0|(?:creative commons )?(?:zero|cc0)(?: 1\.0)?(?: universal)?|cc0-1\.0
cc-by-nc-sa|creative commons,cc by,cc-by|(?:creative commons attribution-noncommercial-sharealike|cc[ -]by[ -]nc[ -]sa)(?: [1-4]\.0)?|cc-by-nc-sa-[1-4]\.0
cc-by-nc-nd|creative commons,cc by,cc-by|(?:creative commons attribution-noncommercial-noderiv(?:ative)?s|cc[ -]by[ -]nc[ -]nd)(?: [1-4]\.0)?|cc-by-nc-nd-[1-4]\.0
cc-by-nc|creative commons,cc by,cc-by|(?:creative commons attribution-noncommercial|cc[ -]by[ -]nc)(?![ -](?:sa|nd))(?: [1-4]\.0)?|cc-by-nc-[1-4]\.0
cc-by-sa|creative commons,cc by,cc-by|(?:creative commons attribution-sharealike|cc[ -]by[ -]sa)(?: [1-4]\.0)?|cc-by-sa-[1-4]\.0
cc-by-nd|creative commons,cc by,cc-by|(?:creative commons attribution-noderiv(?:ative)?s|cc[ -]by[ -]nd)(?: [1-4]\.0)?|cc-by-nd-[1-4]\.0
cc-by|creative commons,cc by,cc-by|(?:creative commons attribution|cc[ -]by)(?![ -](?:nc|sa|nd))(?: [1-4]\.0)?|cc-by-[1-4]\.0
"""
#: priority | weight | pattern around {name} or {spdx}
TEMPLATES = r"""
1|1.0|spdx-license-identifier:\s*{spdx}(?![0-9a-z.-])
2|0.95|(?:is |are )?(?:re-?)?licensed under (?:the terms of )?{name}(?: licen[cs]e)?(?![0-9a-z])
3|0.9|(?:released|distributed|available|published|provided|covered) under (?:the terms of )?{name}(?: licen[cs]e)?(?![0-9a-z])
4|0.85|(?:subject to|in accordance with|governed by|conditions of) (?:the )?(?:terms of )?{name} licen[cs]e(?![0-9a-z])
5|0.8|licen[cs]e\s*[:=]\s*['"]?{name}(?: licen[cs]e)?(?![0-9a-z])
6|0.6|(?<![0-9a-z]){name} licen[cs]e(?![0-9a-z])
"""
#: Notices, each written by hand: priority | weight | label | keywords | regex
NOTICES = r"""
2|0.95|mit|permission is hereby|permission is hereby granted, free of charge, to any person obtaining a copy
2|0.95|mit|permission notice|(?:the )?above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies or substantial portions
3|0.7|mit|without warranty of any kind|the software is provided ["'“]?as is["'”]?,? without warranty of any kind, express or implied
3|0.8|mit|opensource.org/licenses/mit|opensource\.org/licenses/mit(?:-license)?(?![0-9a-z])
2|0.95|x11|x consortium|except as contained in this notice, the name of the x consortium shall not be used
2|0.95|isc|permission to use|permission to use, copy, modify, and(?:/or)? distribute this software for any purpose
3|0.7|isc|disclaims all warranties|the software is provided ["'“]?as is["'”]? and (?:the author|isc) disclaims all warranties
3|0.8|isc|opensource.org/licenses/isc|opensource\.org/licenses/isc(?:-license)?(?![0-9a-z])
2|0.95|bsd-3|neither the name|neither the name of .{1,80}? nor the names of its contributors
3|0.8|bsd-3|endorse or promote|may be used to endorse or promote products derived from this software without specific prior written permission
2|0.9|bsd-2|redistribution and use|redistribution and use in source and binary forms, with or without modification
3|0.8|bsd-2|retain the above copyright|redistributions? of source code must retain the above copyright notice
3|0.8|bsd-2|reproduce the above copyright|redistributions? in binary form must reproduce the above copyright notice
2|0.95|bsd-4|advertising materials|all advertising materials mentioning features or use of this software must display
3|0.7|bsd|this list of conditions|copyright notice, this list of conditions and the following disclaimer
3|0.8|bsd-3|opensource.org/licenses/bsd-3|opensource\.org/licenses/bsd-3-clause
3|0.8|bsd-2|opensource.org/licenses/bsd-2|opensource\.org/licenses/bsd-2-clause
2|0.9|bsd-patent|patent rights|additional grant of patent rights can be found in the patents file
2|0.95|zlib|as-is|this software is provided 'as-is', without any express or implied warranty
3|0.8|zlib|altered source|altered source versions must be plainly marked as such
3|0.8|zlib|altered from any source|this notice may not be removed or altered from any source distribution
2|0.95|apache-2|in compliance with the license|you may not use (?:this file|these files|this work) except in compliance with the license
3|0.9|apache-2|apache.org/licenses/license-2.0|(?:www\.)?apache\.org/licenses/license-2\.0
3|0.9|apache-1.1|apache.org/licenses/license-1.1|(?:www\.)?apache\.org/licenses/license-1\.1
2|0.9|apache-1.1|apache software foundation|this product includes software developed by the apache software foundation
2|0.95|gpl|free software|this program is free software[:;] you can redistribute it and/or modify
2|0.95|gpl-3|version 3 of the license|gnu general public license as published by the free software foundation[,;:] (?:either )?version 3 of the license
2|0.95|gpl-2|version 2 of the license|gnu general public license as published by the free software foundation[,;:] (?:either )?version 2 of the license
3|0.8|gpl|gnu general public license along|you should have received a copy of the gnu general public license along with
3|0.8|gpl|gnu.org/licenses/gpl|gnu\.org/licenses/gpl(?:\.html|\.txt)?(?![0-9a-z-])
3|0.9|gpl-3|gnu.org/licenses/gpl-3|gnu\.org/licenses/gpl-3\.0
3|0.9|gpl-2|gnu.org/licenses/|gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
3|0.7|gpl|any later version|\(at your option\) any later version
3|0.8|gpl-exception|special exception|as a special exception,? .{0,80}?(?:gives? you permission|permission) to link
2|0.95|lgpl-3|version 3 of the license|gnu lesser general public license as published by the free software foundation[,;:] (?:either )?version 3 of the license
2|0.95|lgpl-2.1|version 2.1 of the license|gnu lesser general public license as published by the free software foundation[,;:] (?:either )?version 2\.1 of the license
2|0.95|lgpl-2|version 2 of the license|gnu library general public license as published by the free software foundation[,;:] (?:either )?version 2 of the license
3|0.8|lgpl|lesser general public license along|you should have received a copy of the gnu lesser general public license along with
3|0.9|lgpl-3|gnu.org/licenses/lgpl-3|gnu\.org/licenses/lgpl-3\.0
3|0.9|lgpl-2.1|gnu.org/licenses/|gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
2|0.95|agpl-3|affero|gnu affero general public license as published by the free software foundation[,;:] (?:either )?version 3 of the license
3|0.9|agpl-3|gnu.org/licenses/agpl|gnu\.org/licenses/agpl-3\.0
2|0.95|fdl|free documentation license|permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license
2|0.95|mpl-2|source code form|this source code form is subject to the terms of the mozilla public license
3|0.8|mpl-2|was not distributed with this file|if a copy of the mpl was not distributed with this file
3|0.9|mpl-2|mpl/2.0|mozilla\.org/(?:en-us/)?mpl/2\.0
2|0.9|mpl-1.1|subject to the mozilla|the contents of this file are subject to the mozilla public license version 1\.1
3|0.9|mpl-1.1|mozilla.org/mpl/mpl-1.1|mozilla\.org/mpl/mpl-1\.1
2|0.9|epl-2|eclipse public license|made available under the terms of the eclipse public license (?:v ?|version )?2\.0
2|0.9|epl-1|eclipse public license|made available under the terms of the eclipse public license (?:v ?|version )?1\.0
3|0.9|epl-2|eclipse.org/legal/epl-|eclipse\.org/legal/epl-(?:2\.0|v20)
3|0.9|epl-1|eclipse.org/legal/epl-|eclipse\.org/legal/epl-(?:1\.0|v10)
2|0.9|cddl-1|common development and distribution|the contents of this file are subject to the terms of the common development and distribution license
3|0.8|cddl-1|cddl|opensource\.org/licenses/cddl-?1
2|0.9|cpl-1|common public license|this program and the accompanying materials are made available under the terms of the common public license
3|0.9|eupl|european union|licensed under the european union public licen[cs]e
2|0.95|bsl-1|person or organization|permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
3|0.9|bsl-1|license_1_0|boost\.org/license_1_0\.txt
2|0.95|unlicense|unencumbered|free and unencumbered software released into the public domain
2|0.9|unlicense|free to copy|anyone is free to copy, modify, publish, use, compile, sell, or distribute this software
3|0.8|unlicense|unlicense.org|(?:please )?refer to <?https?://unlicense\.org
3|0.9|wtfpl|do what the|do what the fuck you want to public license
2|0.9|openssl|openssl project|this product includes software developed by the openssl project
2|0.9|ssleay|eric young|this product includes cryptographic software (?:written|software developed) by eric young
2|0.9|postgresql|without a written agreement|permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement
2|0.8|hpnd|without fee|permission to use, copy, modify,? and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
2|0.95|ofl-1.1|font software|this font software is licensed under the sil open font license
2|0.95|php|php software|this product includes php software
2|0.95|json|good, not evil|the software shall be used for good, not evil
2|0.95|beerware|buy me a beer|you can buy me a beer in return
3|0.9|beerware|beer-ware|the beer-ware license
2|0.9|perl|same terms as perl|under the same terms as perl(?: itself)?
3|0.9|lppl|latex project|under the (?:conditions|terms) of the latex project public license
2|0.9|ijg|jpeg group|this software is based in part on the work of the independent jpeg group
3|0.9|ftl|freetype|distributed under (?:the terms of )?the freetype (?:project )?license
3|0.9|w3c|w3c|w3c(?:\(r\)|®)? (?:software notice and license|software and document license)
3|0.9|unicode|unicode|unicode,? inc\.? license agreement
3|0.9|afl|academic free|academic free license,? ?(?:version |v)?[123]\.[0-9]
3|0.9|osl|open software license|open software license,? ?(?:version |v)?[123]\.[0-9]
3|0.9|qpl|q public license|the q public license
3|0.9|cecill|cecill|(?:governed by|under) (?:the )?cecill(?:-[bc])? licen[cs]e
3|0.9|upl|universal permissive|the universal permissive license
3|0.9|ecl-2|educational community|educational community license,? ?(?:version |v)?2\.0
3|0.9|blueoak|blue oak|blue oak model license(?: 1\.0\.0)?
3|0.9|ncsa|university of illinois|university of illinois(?:/ncsa)? open source license
3|0.9|ruby|ruby|under the (?:terms of the )?ruby license
3|0.9|cern-ohl|cern|cern open hardware licen[cs]e
2|0.95|sspl|server side public|(?:the )?server side public license,? ?(?:version |v)?1
2|0.95|busl|business source|business source license(?: 1\.1)?
2|0.95|elastic|elastic license|elastic license(?: 2\.0)?
2|0.95|commons-clause|commons clause|commons clause.{0,3} license condition v1\.0
2|0.95|polyform|polyform|polyform (?:noncommercial|small business|shield|strict|free trial|internal use|perimeter) license(?: 1\.0\.[01])?
2|0.9|ms-pl|accompanying software|this license governs use of the accompanying software\. if you use the software, you accept this license
2|0.95|cc0|waived all copyright|to the extent possible under law,? .{1,120}? has waived all copyright and related or neighboring rights
3|0.9|cc0|publicdomain/zero|creativecommons\.org/publicdomain/zero/1\.0
3|0.9|cc-by|licenses/by/|creativecommons\.org/licenses/by/[1-4]\.[05]
3|0.9|cc-by-sa|licenses/by-sa|creativecommons\.org/licenses/by-sa/[1-4]\.[05]
3|0.9|cc-by-nd|licenses/by-nd|creativecommons\.org/licenses/by-nd/[1-4]\.[05]
3|0.9|cc-by-nc|licenses/by-nc/|creativecommons\.org/licenses/by-nc/[1-4]\.[05]
3|0.9|cc-by-nc-sa|licenses/by-nc-sa|creativecommons\.org/licenses/by-nc-sa/[1-4]\.[05]
3|0.9|cc-by-nc-nd|licenses/by-nc-nd|creativecommons\.org/licenses/by-nc-nd/[1-4]\.[05]
3|0.9|odc-by|open data commons|open data commons attribution license
3|0.9|pddl|public domain dedication|open data commons public domain dedication and licen[cs]e
3|0.9|ogl-uk|open government|(?:the )?open government licen[cs]e,? ?(?:version |v)?[123]\.0
3|0.8|public-domain|public domain|(?:released|placed|dedicated) (?:in|into|to) the public domain
4|0.7|public-domain|public domain|(?:is|are) (?:hereby )?in the public domain
4|0.7|public-domain|no copyright|no copyright is claimed
4|0.7|non-commercial|commercial|for (?:personal and )?non-?commercial (?:use|purposes) only
4|0.7|non-commercial|personal use|free for personal use(?: only)?
5|0.6|evaluation|evaluation purposes|for evaluation purposes only
5|0.7|proprietary|unauthorized copying|unauthorized copying of this (?:file|software|work)
5|0.7|proprietary|may be reproduced|no part of this (?:publication|book|document|work|software) may be reproduced
5|0.7|proprietary|confidential|(?:proprietary and confidential|confidential and proprietary)
7|0.4|proprietary|all rights reserved|all rights reserved
7|0.4|copyright|copyright|copyright (?:\(c\) |© )?(?:19|20)[0-9]{2}
"""


def _lines(table: str, n: int) -> list[list[str]]:
    return [line.split("|", n - 1) for line in table.strip().splitlines()]


def rules() -> list[dict]:
    """All signature rules, best priority first."""
    out = []
    for priority, weight, template in _lines(TEMPLATES, 3):
        for label, keywords, name, spdx in map(_split_license, LICENSES.strip().splitlines()):
            by_id = "{spdx}" in template
            out.append({"priority": int(priority), "weight": float(weight), "label": label, "keywords": ["spdx"] if by_id else keywords.split(","), "pattern": "(?i)" + template.replace("{name}", f"(?:{name})").replace("{spdx}", f"(?:{spdx})")})
    for priority, weight, label, keywords, pattern in _lines(NOTICES, 5):
        out.append({"priority": int(priority), "weight": float(weight), "label": label, "keywords": keywords.split(","), "pattern": "(?i)" + pattern})
    return sorted(out, key=lambda r: r["priority"])


def _split_license(line: str) -> list[str]:
    """Fields of a line of LICENSES; bars inside brackets belong to the regexes."""
    fields, depth = [""], 0
    for ch in line:
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and not depth:
            fields.append("")
        else:
            fields[-1] += ch
    return fields


def phrase_pattern(phrase: str) -> str:
    """The phrase's words one after another, whatever non-words stand between them; ASCII case is ignored."""
    return f"(?<!{WORD}){GAP.join(phrase.split())}(?!{WORD})"


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{WORD}+")).cast("long")


@cache
def which_rules() -> str:
    """SQL for the numbers of the rules that match t: one text, which Spark parses at once, instead of a call for each part.
    Rules with the same keywords share the look for these."""
    own: dict[tuple, list[tuple[int, str]]] = {}
    for n, rule in enumerate(rules()):
        own.setdefault(tuple(rule["keywords"]), []).append((n, rule["pattern"]))
    text = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    groups = []
    for keywords, each in own.items():
        held = " OR ".join(f"contains(lower_t, {text(k)})" for k in keywords)
        groups.append(f"if({held}, array({', '.join(f'if(rlike(t, {text(p)}), {n}, NULL)' for n, p in each)}), NULL)")
    return f"array_compact(flatten(array_compact(array({', '.join(groups)}))))"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections).

    detections: what is left of the rules' matches, as structs of start, end (characters), priority, label and weight.
    """
    base = "(?i)" + "|".join(phrase_pattern(p) for p, _ in BASE)
    table = rules()
    kind = "array<struct<priority:int,weight:double,label:string,pattern:string>>"
    df = pick(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    low = F.lower("t")
    gated = reduce(Column.__or__, (F.contains(low, F.lit(x)) for x in GATE))
    may_hold_base = reduce(Column.__or__, (F.contains(low, F.lit(x)) for x in BASE_GATE))
    df = df.select("doc_id", "t", count_words(F.col("t")).alias("n_words"), (may_hold_base & F.col("t").rlike(base)).alias("has_base"), gated.alias("gated"))
    df = df.withColumn("lower_t", F.when(F.col("gated"), F.lower("t")))
    df = df.withColumn("which", F.when(F.col("gated"), F.expr(which_rules())).otherwise(F.array().cast("array<int>")))
    every = F.from_json(F.lit(json.dumps([{k: v for k, v in rule.items() if k != "keywords"} for rule in table])), kind)
    active = F.transform("which", lambda n: F.get(every, n))
    none = F.array().cast("array<struct<start:int,nend:int,priority:int,label:string,weight:double>>")

    def spans(r: Column) -> Column:
        """All matches of a rule: the gaps between them and their own lengths give their places."""
        hits = F.regexp_extract_all(F.col("t"), r["pattern"], F.lit(0))
        gaps = F.split(F.col("t"), r["pattern"], -1)
        pairs = F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"))
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(acc: Column, x: Column) -> Column:
            a = acc["at"] + F.length(x["gap"])
            b = a + F.length(x["hit"])
            one = F.struct(a.alias("start"), (-b).alias("nend"), r["priority"].alias("priority"), r["label"].alias("label"), r["weight"].alias("weight"))
            return F.struct(b.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(pairs, start, step, lambda acc: acc["out"])

    # By start, longest first, best priority first: a detection inside an earlier one ends no later than the furthest so far.
    found = F.when(F.size("which") > 0, F.array_sort(F.flatten(F.transform(active, spans)))).otherwise(none)
    fresh = F.struct(F.lit(0).alias("far"), none.alias("out"))

    def outer(acc: Column, d: Column) -> Column:
        kept = -d["nend"] > acc["far"]
        return F.struct(F.greatest(acc["far"], -d["nend"]).alias("far"), F.when(kept, F.concat(acc["out"], F.array(d))).otherwise(acc["out"]).alias("out"))

    def settle(acc: Column, d: Column) -> Column:
        clash = F.exists(acc, lambda k: (k["start"] < -d["nend"]) & (d["start"] < -k["nend"]))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(d)))

    fields = ("start", "nend", "priority", "label", "weight")
    ranked = lambda x, names: F.array_sort(F.transform(x, lambda d: F.struct(*(d[c].alias(c) for c in names))))
    apart = F.aggregate(found, fresh, outer, lambda acc: acc["out"])
    first = F.transform(ranked(apart, ("priority", *(c for c in fields if c != "priority"))), lambda d: F.struct(*(d[c].alias(c) for c in fields)))
    df = df.withColumn("found", F.array_sort(F.aggregate(first, none, settle)))
    pieces = F.split("t", base, -1)
    matches = F.regexp_extract_all("t", F.lit(base), F.lit(0))
    labels = F.array_compact(F.array(*(F.when(F.col("t").rlike("(?i)" + phrase_pattern(p)), F.lit(label)) for p, label in BASE)))
    df = df.select(
        "doc_id", "n_words", "found",
        F.when(F.col("has_base"), F.size(matches)).otherwise(0).cast("long").alias("n_base"),
        F.when(F.col("has_base"), count_words(F.element_at(pieces, 1))).alias("first_word"),
        F.when(F.col("has_base"), F.col("n_words") - count_words(F.element_at(pieces, -1)) - count_words(F.element_at(matches, -1))).alias("last_word"),
        F.when(F.col("has_base"), F.array_sort(labels)).otherwise(F.array().cast("array<string>")).alias("base"),
    )
    weights = F.transform("found", lambda d: d["weight"])
    detections = F.transform("found", lambda d: F.struct(d["start"].alias("start"), (-d["nend"]).alias("end"), d["priority"].alias("priority"), d["label"].alias("label"), d["weight"].alias("weight")))
    return df.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.transform("found", lambda d: d["label"]))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(weights), F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(0.95)).otherwise(0.0)).alias("score"),
        detections.alias("detections"),
    )
