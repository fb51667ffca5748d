"""License scans by sentence rules, with DataFrame functions.

A text is cut into sentences, which are normalised (lower case, runs of anything but a-z and 0-9 become one space) and
looked up in a table of known licence sentences. A known sentence may stand on one line or run over line ends, behind
comment marks as well; marks before white space and blank lines end it. Some have a slot for the name of a holder. In a text
with a known sentence every other one counts too: those that speak of licences, warranties, permission, redistribution or
copyright are `Unknown`, the rest are gaps, as are copyright lines and titles of licences. The identifiers, in text order,
are matched against ordered rules: each rule is a sequence of identifiers that must stand next to each other, so an unknown
sentence or a gap between them breaks it; what a rule matches is used up, and later rules see a gap there. Companions (who is
liable, where to find the text) may be left over. The verdict is `known` if there is a licence and nothing else is left, so a
text with a sentence that may restrict it is `unmatched`, whatever licence it names besides.

Cases: null text is the empty text; texts without known sentences give an empty array, "" and verdict `none`; a licence
that occurs more than once is named once; very long texts are read whole; repeated rows stay; an empty table gives no rows;
other columns are carried along, but sentence_ids, licences and verdict are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railyard.llm.frames import fresh

#: Well-known licence sentences by identifier.
SENTENCES = {
    "MitName": ["Released under the MIT License.", "This project is licensed under the MIT License.", "Licensed under the MIT License."],
    "MitGrant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "MitNotice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "AsIsMit": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "ApacheName": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "This project is licensed under the Apache License 2.0."],
    "ApacheUse": ["you may not use this file except in compliance with the License."],
    "ApacheCopy": ["You may obtain a copy of the License at"],
    "ApacheAsIs": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "GplName3": ["This work is licensed under the GNU General Public License, version 3.", "This program is licensed under the GNU General Public License version 3."],
    "GplFree": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GplHope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "CcByNc4": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CcBy4": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "CcBySa4": ["Licensed under CC BY-SA 4.0."],
    "BsdPre": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BsdSource": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "BsdBinary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BsdEndorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "GplFree2": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GplName2": ["This work is licensed under the GNU General Public License, version 2.", "This program is licensed under the GNU General Public License version 2."],
    "LgplFree": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LgplHope": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "LgplFree3": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AgplFree": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MplCopy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "IscGrant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "ZeroGrant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "Unencumbered": ["This is free and unencumbered software released into the public domain."],
    "EplTerms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0/"],
    "BoostName": ["Distributed under the Boost Software License, Version 1.0."],
    "ZlibGrant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "CcZero": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."],
    "Rights": ["All rights reserved."],
    "MitLiable": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "ApacheSee": ["See the License for the specific language governing permissions and limitations under the License."],
    "ApacheUrl": ["http://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0"],
    "GplSee": ["See the GNU General Public License for more details.", "See the GNU Lesser General Public License for more details.", "See the GNU Affero General Public License for more details."],
    "GplCopy": ["You should have received a copy of the GNU General Public License along with this program.", "You should have received a copy of the GNU Lesser General Public License along with this library.", "You should have received a copy of the GNU Affero General Public License along with this program."],
    "GplWhere": ["If not, see <https://www.gnu.org/licenses/>.", "If not, see <http://www.gnu.org/licenses/>."],
    "BsdAds": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "BsdAsIs": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "BsdLiable": ["IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."],
    "IscAsIs": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "ZlibAsIs": ["This software is provided 'as-is', without any express or implied warranty."],
    "MplTerms": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}

#: Normalised sentences with a slot for a holder's name.
SLOTS = {
    "BsdEndorse": "neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BsdAck": "this product includes software developed by {}",
}
SLOT_CHARS = 90

#: Identifiers that may be left over, patterns of sentences that count as gaps, and what licence-like ones hold.
COMPANIONS = ("MitLiable", "ApacheSee", "ApacheUrl", "GplSee", "GplCopy", "GplWhere", "BsdAsIs", "BsdLiable", "IscAsIs", "ZlibAsIs")
TITLE = "^((c )?copyright( c)?( [a-z0-9 ]*)?|(the )?(mit|isc|zlib|apache|boost software|(new |simplified |modified |original )?bsd|bsd [234] clause|[234] clause bsd|mozilla public|eclipse public|gnu (lesser |affero )?general public) licen[sc]e( mit)?( (version |v )?[0-9 ]+)?)$"
LICENCE_LIKE = "licen[sc]|warrant|permi|redistribut|copyright"
UNKNOWN, GAP = "Unknown", "~"

#: Fixed values: (licence, identifiers next to each other), first rule first.
RULES = (
    ("BSD-4-Clause", ("BsdPre", "BsdSource", "BsdBinary", "BsdAds", "BsdAck", "BsdEndorse")),
    ("BSD-3-Clause", ("BsdPre", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdPre", "BsdSource", "BsdBinary")),
    ("MIT", ("MitGrant", "MitNotice", "AsIsMit")),
    ("MIT", ("MitGrant", "MitNotice")),
    ("MIT", ("MitName",)),
    ("Apache-2.0", ("ApacheName", "ApacheUse", "ApacheCopy", "ApacheUrl", "ApacheAsIs")),
    ("Apache-2.0", ("ApacheName", "ApacheUse", "ApacheCopy", "ApacheAsIs")),
    ("Apache-2.0", ("ApacheName", "ApacheUse")),
    ("Apache-2.0", ("ApacheName",)),
    ("GPL-3.0-or-later", ("GplFree", "GplHope")),
    ("GPL-3.0-or-later", ("GplFree",)),
    ("AGPL-3.0-or-later", ("AgplFree", "GplHope")),
    ("AGPL-3.0-or-later", ("AgplFree",)),
    ("LGPL-3.0-or-later", ("LgplFree3", "LgplHope")),
    ("LGPL-3.0-or-later", ("LgplFree3",)),
    ("LGPL-2.1-or-later", ("LgplFree", "LgplHope")),
    ("LGPL-2.1-or-later", ("LgplFree",)),
    ("GPL-2.0-or-later", ("GplFree2", "GplHope")),
    ("GPL-2.0-or-later", ("GplFree2",)),
    ("GPL-3.0", ("GplName3",)),
    ("GPL-2.0", ("GplName2",)),
    ("MPL-2.0", ("MplTerms", "MplCopy")),
    ("MPL-2.0", ("MplCopy",)),
    ("ISC", ("IscGrant",)),
    ("0BSD", ("ZeroGrant",)),
    ("Unlicense", ("Unencumbered",)),
    ("EPL-2.0", ("EplTerms",)),
    ("BSL-1.0", ("BoostName",)),
    ("Zlib", ("ZlibGrant",)),
    ("CC0-1.0", ("CcZero",)),
    ("CC-BY-NC-4.0", ("CcByNc4",)),
    ("CC-BY-SA-4.0", ("CcBySa4",)),
    ("CC-BY-4.0", ("CcBy4",)),
)

#: A sentence ends with its line or after a mark before white space.
BREAK = r"[.!?;:][ \t\r\n]+|[\r\n]+"


def normalise(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def parts_of(text: str) -> list[str]:
    return [normalise(p) for p in re.split(BREAK, text) if p.strip()]


def table_of(sentences: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Normalised sentence -> identifier. One that BREAK cuts is known by its parts; a part that several share has the first one's identifier."""
    found = {}
    for name, texts in sentences.items():
        for text in texts:
            parts = parts_of(text)
            for k, part in enumerate(parts):
                found.setdefault(part, name if len(parts) == 1 else f"{name}.{k}")
    return found


#: In lower-case text capitals are free to stand for an end (E) and for a line end that a sentence may run over (L).
_STEPS = ((r"[.!?;:](?=[ \t\r\n])", "E"), (r"\r\n?|\n", "L"), (r"[^a-z0-9EL]+", " "), (r"(?:^|L) ?(?:dnl|rem)(?![a-z0-9])", "L"), (r"L(?: ?L)+", "E"))


def found_in(text: Column, known: Mapping[str, str]) -> Column:
    """The sentences of a text that holds a known one, in its order: a known one is what stands between two ends, or line ends, and may hold line ends; others end with their line."""
    words = sorted({max(s.split(" "), key=len) for s in [*known, *(part for s in SLOTS.values() for part in s.split(" {} " if " {} " in s else " {}") if part)]})
    least = [w for w in words if not any(v != w and v in w for v in words)]
    over = "(?: L?|L) ?"
    either = [s.replace(" ", over) for s in sorted(known, key=len, reverse=True)] + [s.replace(" ", over).replace("{}", f"[a-z0-9 EL]{{1,{SLOT_CHARS}}}?") for s in SLOTS.values()]
    cut = text
    for pattern, to in _STEPS:
        cut = F.regexp_replace(cut, pattern, to)
    hits = F.regexp_extract_all(cut, F.lit(f"(?:^|(?<=[EL])) ?({'|'.join(either)}|[^EL]*[a-z0-9])(?= ?(?:[EL]|$))"), F.lit(1))
    flat = F.transform(hits, lambda s: F.regexp_replace(s, r"[ EL]+", " "))
    # no sentence is there without its longest word
    return F.when(text.rlike("|".join(least)), flat).otherwise(F.array().cast("array<string>"))


def _slot(name: str) -> str:
    return f"^{SLOTS[name].format(f'[a-z0-9 ]{{1,{SLOT_CHARS}}}')}$"


def _parts(name: str, sentences: Mapping[str, Sequence[str]], known: Mapping[str, str]) -> list[str]:
    """The identifiers that a rule's one stands for."""
    return [known[p] for p in parts_of(sentences[name][0])] if name in sentences else [name]


def scan(df: DataFrame, text_col: str = "text", sentences: Mapping[str, Sequence[str]] = SENTENCES, rules: Sequence[tuple[str, Sequence[str]]] = RULES) -> DataFrame:
    """Adds sentence_ids (array), licences (joined by a comma, in rule order) and verdict (none, known or unmatched)."""
    known = table_of(sentences)
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    names = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    kind = lambda s: F.coalesce(F.try_element_at(names, s), *(F.when(s.rlike(_slot(n)), n) for n in SLOTS), F.when(s.rlike(TITLE), GAP), F.when(s.rlike(LICENCE_LIKE), UNKNOWN), F.lit(GAP))
    own = df.drop("sentence_ids", "licences", "verdict")
    tokens, rest, *flags = (fresh(x, own.columns) for x in ("tokens", "rest", *(f"hit{k}" for k in range(len(rules)))))
    out = own.withColumn(tokens, F.transform(found_in(text, known), kind))
    any_known = F.exists(tokens, lambda x: ~x.isin(UNKNOWN, GAP))
    out = out.withColumn(tokens, F.when(any_known, F.col(tokens)).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("sentence_ids", F.filter(tokens, lambda x: x != GAP))

    # ",A,,B,~": each identifier between commas of its own, so that neighbours stay apart when one is used up ("|")
    out = out.withColumn(rest, F.array_join(F.transform(tokens, lambda x: F.when(x == GAP, x).otherwise(F.concat(F.lit(","), x, F.lit(",")))), ""))
    for flag, (_, sequence) in zip(flags, rules, strict=True):
        wanted = "".join(f",{x}," for name in sequence for x in _parts(name, sentences, known))
        out = out.withColumn(flag, F.contains(rest, F.lit(wanted))).withColumn(rest, F.replace(rest, F.lit(wanted), F.lit("|")))
    licences = list(dict.fromkeys(name for name, _ in rules))
    either = lambda name: F.greatest(*(F.col(f) for f, r in zip(flags, rules, strict=True) if r[0] == name), F.lit(False))
    left = F.regexp_replace(rest, f"[|{GAP}]|,({'|'.join(COMPANIONS)}),", "")
    verdict = F.when(F.size("sentence_ids") == 0, "none").when((left == "") & F.contains(rest, F.lit("|")), "known").otherwise("unmatched")
    return out.withColumns({"licences": F.concat_ws(",", *(F.when(either(name), F.lit(name)) for name in licences)), "verdict": verdict}).drop(tokens, rest, *flags)


def oracle() -> str:
    """DuckDB SQL of op3's rows."""
    known = table_of(SENTENCES)
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    names = "MAP {" + ", ".join(f"{quoted(s)}: {quoted(n)}" for s, n in known.items()) + "}"
    slots = "".join(f" WHEN regexp_matches(s, {quoted(_slot(n))}) THEN {quoted(n)}" for n in SLOTS)
    kind = f"CASE WHEN {names}[s] IS NOT NULL THEN {names}[s]{slots} WHEN regexp_matches(s, {quoted(TITLE)}) THEN '{GAP}' WHEN regexp_matches(s, {quoted(LICENCE_LIKE)}) THEN '{UNKNOWN}' ELSE '{GAP}' END"
    steps, hits, rest = [], [], "r0"
    for k, (_, sequence) in enumerate(RULES):
        wanted = quoted("".join(f",{x}," for name in sequence for x in _parts(name, SENTENCES, known)))
        steps.append(f"s{k + 1} AS (SELECT *, contains({rest}, {wanted}) AS h{k}, replace({rest}, {wanted}, '|') AS r{k + 1} FROM s{k})")
        hits.append(f"h{k}")
        rest = f"r{k + 1}"
    licences = list(dict.fromkeys(name for name, _ in RULES))
    named = ", ".join("CASE WHEN " + " OR ".join(f"h{k}" for k, r in enumerate(RULES) if r[0] == name) + f" THEN {quoted(name)} END" for name in licences)
    return f"""
WITH cut AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[.!?;:][ \\t\\r\\n]+|[\\r\\n]+', chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)) AS parts FROM documents),
told AS (SELECT doc_id, list_transform(list_filter(list_transform(parts, lambda s: trim(s)), lambda s: s <> ''), lambda s: {kind}) AS kinds FROM cut),
ids AS (SELECT doc_id, CASE WHEN len(list_filter(kinds, lambda x: x NOT IN ('{UNKNOWN}', '{GAP}'))) > 0 THEN kinds ELSE [] END AS kinds FROM told),
s0 AS (SELECT doc_id, list_filter(kinds, lambda x: x <> '{GAP}') AS ids, coalesce(array_to_string(list_transform(kinds, lambda x: CASE WHEN x = '{GAP}' THEN x ELSE ',' || x || ',' END), ''), '') AS r0 FROM ids),
{", ".join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids, concat_ws(',', {named}) AS licences,
  CASE WHEN len(ids) = 0 THEN 'none' WHEN regexp_replace({rest}, '[|{GAP}]|,({"|".join(COMPANIONS)}),', '', 'g') = '' AND contains({rest}, '|') THEN 'known' ELSE 'unmatched' END AS verdict FROM s{len(RULES)}"""
