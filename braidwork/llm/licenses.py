"""Licence scan: normalised lines, paragraphs, whole texts and word windows against licence templates by Dice over word bigrams.

DataFrame functions only, row by row: nothing is shuffled. Two prunings lose no match. A text is looked into only if
it has a word out of those that no matching passage can do without; a passage meets only templates whose number of
bigrams is near enough to its own. Windows have a template's number of words and stand where one of the bigrams that
no match can do without would place the template.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short notices by which works name their licence, and permission notices. A parameter of the scan.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Licence texts: the short ones whole, without their copyright lines; of each long one a passage that it alone has. A parameter of the scan.
TEXTS = {
    "0bsd-text": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_AS_IS}",
    "agpl-3.0-opening": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "apache-2.0-definitions": "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.",
    "bsd-2-clause-text": f"{_BSD_CONDITIONS} {_BSD_DISCLAIMER}",
    "bsd-3-clause-text": f"{_BSD_CONDITIONS} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_DISCLAIMER}",
    "bsl-1.0-text": f"Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. {_WARRANTY}, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "cc-by-4.0-opening": "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License",
    "cc0-1.0-opening": "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an \"owner\") of an original work of authorship and/or a database (each, a \"Work\").",
    "epl-2.0-opening": "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
    "gpl-2.0-opening": "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "gpl-3.0-opening": "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works.",
    "isc-text": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_AS_IS}",
    "lgpl-3.0-opening": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "mit-text": f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY} AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mpl-2.0-definitions": "\"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    "unlicense-text": f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_WARRANTY} AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
DICE = 0.8


def _words(text: str) -> list[str]:
    return [w for w in re.sub("[^a-z0-9]+", " ", text.lower()).split(" ") if w]


def _bigrams(text: str) -> list[str]:
    words = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _anchor_bigrams(text: str, dice: float) -> list[str]:
    """Bigrams of which every passage that matches a template has one. It shares over dice/(2-dice) of the template's, so it has one out of any set that leaves fewer outside; the set with the longest words is taken."""
    grams = sorted(_bigrams(text), key=lambda g: (-max(map(len, g.split())), g))
    return grams[: len(grams) - int(-(-len(grams) * dice // (2 - dice))) + 1]


def _anchors(templates: dict[str, str], dice: float) -> list[str]:
    """Words of which every matching passage has one: the longest of each anchor bigram."""
    return sorted({max(g.split(), key=lambda w: (len(w), w)) for text in templates.values() for g in _anchor_bigrams(text, dice)})


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def bigrams(text: Column) -> Column:
    """Distinct word bigrams of a normalised text."""
    words = F.split(text, " ")
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, dice: float = DICE, text: str = "text") -> DataFrame:
    """docs without the text, with license_id and license_score of the best match, and license_ids, all matched ones.

    Lines, paragraphs (between empty lines), the whole text, and windows of a template's length around its anchor
    bigrams anywhere in the text are compared to all templates, by default TEMPLATES and TEXTS; ties go to the
    smaller id. Null, empty and unmatched texts have a null license_id and score and an empty list. Rows are
    independent; an empty table gives an empty one; columns named as an output are replaced.
    """
    templates = TEMPLATES | TEXTS if templates is None else templates
    names = ["license_id", "license_score", "license_ids"]
    kept = [c for c in docs.columns if c != text and c not in names]
    anchor = r"(?i)(?<![a-z0-9])(?:" + "|".join(_anchors(templates, dice)) + ")(?![a-z0-9])"
    none = F.array().cast("array<string>")
    has = F.col(text).rlike(anchor)
    lines = F.filter(F.split(text, "\n", -1), lambda l: l.rlike(anchor))
    wholes = F.filter(F.array_distinct(F.concat(F.split(text, r"\n\s*\n", -1), F.array(F.col(text)))), lambda p: p.rlike(anchor) & F.contains(p, F.lit("\n")))
    passages = F.when(has, F.array_distinct(F.transform(F.concat(lines, wholes), normalised))).otherwise(none)
    df = docs.select(*kept, text).withColumn("_p", passages).withColumn("_g", F.transform("_p", bigrams))
    df = df.withColumn("_w", F.when(has, F.split(normalised(F.col(text)), " ")).otherwise(none))
    df = df.withColumn("_h", _hits("_w", sorted({g for t in templates.values() for g in _anchor_bigrams(t, dice)})))
    scored = F.transform(_table(templates, dice), lambda t: F.struct(_best(t).alias("score"), t["id"].alias("id")))
    # the sizes are also a second use of _g and _h, which keeps the optimizer from moving their making into the loop over templates
    some = (F.size("_g") > 0) | (F.size("_h") > 0)
    df = df.withColumn("_m", F.when(some, F.filter(scored, lambda m: m["score"] >= dice)).otherwise(F.array().cast("array<struct<score:double,id:string>>")))
    top = F.element_at(F.array_sort(F.transform("_m", lambda m: F.struct((-m["score"]).alias("s"), m["id"].alias("id")))), 1)
    top = F.when(F.size("_m") > 0, top)
    return df.select(*kept, top["id"].alias("license_id"), (-top["s"]).alias("license_score"), F.array_sort(F.transform("_m", lambda m: m["id"])).alias("license_ids"))


def _table(templates: dict[str, str], dice: float) -> Column:
    """The templates as one constant: id, number of words, grams, sizes that a match may have, and places of the anchors."""
    rows = []
    for name in sorted(templates):
        words, grams, anchors = _words(templates[name]), _bigrams(templates[name]), set(_anchor_bigrams(templates[name], dice))
        places = [{"g": f"{a} {b}", "j": j} for j, (a, b) in enumerate(zip(words, words[1:], strict=False)) if f"{a} {b}" in anchors]
        rows.append({"id": name, "words": len(words), "grams": grams, "least": len(grams) * dice / (2 - dice), "most": len(grams) * (2 - dice) / dice, "places": places})
    kind = "array<struct<id:string,words:int,grams:array<string>,least:double,most:double,places:array<struct<g:string,j:int>>>>"
    return F.from_json(F.lit(json.dumps(rows)), kind)


def _hits(words: str, grams: list[str]) -> Column:
    """array<struct<at, g>> of the given bigrams among the words, with the places of their first words from 1."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    placed = F.transform(pairs, lambda g, i: F.struct((i + 1).alias("at"), g.alias("g")))
    return F.filter(placed, lambda h: h["g"].isin(grams))


def _best(t: Column) -> Column:
    """The highest Dice coefficient of the template with a passage of fitting size or a window."""
    near = F.filter("_g", lambda g: (F.size(g) >= t["least"]) & (F.size(g) <= t["most"]))
    within = F.transform(_windows(t), lambda w: bigrams(F.array_join(w, " ")))
    return F.array_max(F.transform(F.concat(near, within), lambda g: (F.lit(2.0) * F.size(F.array_intersect(g, t["grams"]))) / (F.size(g) + F.size(t["grams"]))))


def _windows(t: Column) -> Column:
    """Windows of as many words as the template has, placed by each hit of an anchor at each of the anchor's places in the template; no longer than the text."""
    last = F.greatest(F.size("_w") - t["words"] + 1, F.lit(1))
    starts = F.transform("_h", lambda h: F.transform(F.filter(t["places"], lambda p: p["g"] == h["g"]), lambda p: F.greatest(F.lit(1), F.least(last, h["at"] - p["j"]))))
    return F.transform(F.array_distinct(F.flatten(starts)), lambda s: F.slice("_w", s, t["words"]))


def oracle(templates: dict[str, str] | None = None, dice: float = DICE) -> str:
    """DuckDB SQL for scan_licenses over documents, without the prunings, the windows and, by default, TEXTS; the list is comma-joined as there."""
    templates = TEMPLATES if templates is None else templates
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(templates.items()))
    norm = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
    grams = "list_distinct(list_transform(range(1, len(string_split({0}, ' '))), lambda i: string_split({0}, ' ')[i] || ' ' || string_split({0}, ' ')[i + 1]))"
    return f"""
WITH t(id, raw) AS (VALUES {values}), tg AS (SELECT id, {grams.format(norm.format("raw"))} AS g FROM t),
p AS (SELECT doc_id, {norm.format("piece")} AS s FROM (SELECT doc_id, unnest(list_distinct(string_split(text, chr(10)) || regexp_split_to_array(text, '\\n\\s*\\n') || [text])) AS piece FROM documents) x),
q AS (SELECT DISTINCT doc_id, s FROM p),
g AS (SELECT doc_id, {grams.format("s")} AS g FROM q),
m AS (SELECT doc_id, id, max(2.0::DOUBLE * len(list_intersect(g.g, tg.g)) / (len(g.g) + len(tg.g))) AS score FROM g, tg WHERE len(g.g) >= len(tg.g) * {dice / (2 - dice)!r}::DOUBLE AND len(g.g) <= len(tg.g) * {(2 - dice) / dice!r}::DOUBLE GROUP BY 1, 2),
k AS (SELECT * FROM m WHERE score >= {dice!r}::DOUBLE),
b AS (SELECT doc_id, arg_min(id, struct_pack(s := -score, i := id)) AS license_id, max(score) AS license_score, string_agg(id, ',' ORDER BY id) AS license_ids FROM k GROUP BY 1)
SELECT d.doc_id, b.license_id, b.license_score, coalesce(b.license_ids, '') AS license_ids FROM documents d LEFT JOIN b USING (doc_id)"""
