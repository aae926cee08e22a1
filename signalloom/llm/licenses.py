"""License scans by matching template markup with token automata.

A template is license text with regions: ``[[ ... ]]`` may be left out, and
``{{name|n}}`` stands for 0 to n words of any kind (holders, years, product
names). It is compiled to an automaton over words whose states also hold how
many words a replaceable region still takes. A text is accepted where its
words run from the start to the final state, so mandatory wording must match
word for word; case, punctuation and layout don't matter. Of templates that
are accepted from the same word on, the longest match counts, so that a
license isn't also taken for another one that it begins with.

Before an automaton runs, every mandatory stretch of its template must occur
in the document, which is necessary for acceptance and cheap to test; runs
start only where the first mandatory stretch stands.

Base labels come from fixed phrases. Defined cases: null or empty texts have
no words and no labels; a very long text is scanned whole; overlapping places
all count; repeated rows are scanned each; other columns go along unseen,
whatever their names, but those that this adds are replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD_WORDS, append, read

# Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wording of public licenses.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT_KEEP = ", subject to the following conditions: The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the Software."
_MIT_NO_WARRANTY = " THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT [[OF THIRD PARTY RIGHTS]]. IN NO EVENT SHALL {{holder|12}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_NO_ADVERTISING = " Except as contained in this notice, the name of {{holder|12}} shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization"
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_KEEP = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_NO_WARRANTY = " THE SOFTWARE IS PROVIDED AS IS AND {{holder|8}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{holder|8}} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_SOURCE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: [[1]] Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = " [[2]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = " {{number|1}} Neither the name of {{holder|15}} may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_ADVERTISING = " [[3]] All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by {{holder|15}}"
_BSD_NO_WARRANTY = " THIS SOFTWARE IS PROVIDED BY {{holder|12}} AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{holder|12}} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."
_GNU_NO_WARRANTY = " {{what|4}} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {{license|5}} for more details."
_GNU = {
    "gpl-2.0": ("GNU General Public License", "2", "June 1991"), "gpl-3.0": ("GNU General Public License", "3", "29 June 2007"),
    "lgpl-2.1": ("GNU Lesser General Public License", "2 1", "February 1999"), "lgpl-3.0": ("GNU Lesser General Public License", "3", "29 June 2007"),
    "agpl-3.0": ("GNU Affero General Public License", "3", "19 November 2007"),
}
_CC = {
    "cc-by-4.0": "Attribution 4.0", "cc-by-sa-4.0": "Attribution ShareAlike 4.0", "cc-by-nc-4.0": "Attribution NonCommercial 4.0", "cc-by-nd-4.0": "Attribution NoDerivatives 4.0",
    "cc-by-nc-sa-4.0": "Attribution NonCommercial ShareAlike 4.0", "cc-by-nc-nd-4.0": "Attribution NonCommercial NoDerivatives 4.0",
}

# Fixed values: (label, weight, template). Weight 1 is all mandatory wording of a text or notice, 0.9 its title, 0.7 a reference to it.
TEMPLATES = (
    ("mit", 1.0, _MIT_GRANT + _MIT_KEEP + _MIT_NO_WARRANTY),
    ("mit-0", 1.0, _MIT_GRANT + "." + _MIT_NO_WARRANTY),
    ("json", 1.0, _MIT_GRANT + _MIT_KEEP + " The Software shall be used for Good, not Evil." + _MIT_NO_WARRANTY),
    ("x11", 1.0, _MIT_GRANT + _MIT_KEEP + _MIT_NO_WARRANTY + _NO_ADVERTISING + " from {{holder|12}}"),
    ("curl", 1.0, _ISC_GRANT.replace("and/or", "and") + _ISC_KEEP + _MIT_NO_WARRANTY + _NO_ADVERTISING + " of the copyright holder"),
    ("isc", 1.0, _ISC_GRANT + _ISC_KEEP + _ISC_NO_WARRANTY),
    ("isc", 1.0, _ISC_GRANT.replace("and/or", "and") + _ISC_KEEP + _ISC_NO_WARRANTY),
    ("0bsd", 1.0, _ISC_GRANT + "." + _ISC_NO_WARRANTY),
    ("bsd-1-clause", 1.0, _BSD_SOURCE + _BSD_NO_WARRANTY),
    ("bsd-2-clause", 1.0, _BSD_SOURCE + _BSD_BINARY + _BSD_NO_WARRANTY),
    ("bsd-3-clause", 1.0, _BSD_SOURCE + _BSD_BINARY + _BSD_NAME + _BSD_NO_WARRANTY),
    ("bsd-4-clause", 1.0, _BSD_SOURCE + _BSD_BINARY + _BSD_ADVERTISING + _BSD_NAME + _BSD_NO_WARRANTY),
    ("ncsa", 1.0, "to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers."),
    ("zlib", 1.0, "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: [[1]] The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. [[2]] Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. [[3]] This notice may not be removed or altered from any source distribution."),
    ("unlicense", 1.0, "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("bsl-1.0", 1.0, "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("wtfpl", 1.0, "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("postgresql", 1.0, "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."),
    ("hpnd", 1.0, "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation"),
    ("beerware", 1.0, "As long as you retain this notice you can do whatever you want with this stuff. If we meet some day, and you think this stuff is worth it, you can buy me a beer in return"),
    ("fsfap", 1.0, "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved. This file is offered as-is, without any warranty."),
    ("upl-1.0", 1.0, "Subject to the condition set forth below, permission is hereby granted to any person obtaining a copy of this software, associated documentation and/or data (collectively the Software), free of charge and under any and all copyright rights in the Software"),
    ("ms-pl", 1.0, "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software."),
    ("apache-2.0", 1.0, _APACHE + " You may obtain a copy of the License at {{address|10}} Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache-2.0", 0.9, _APACHE),
    ("apache-2.0", 0.9, "Apache License Version 2.0, January 2004"),
    ("mpl-2.0", 1.0, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("mpl-2.0", 0.9, "Mozilla Public License Version 2.0 1. Definitions"),
    ("mpl-1.1", 1.0, "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License."),
    ("epl-1.0", 1.0, "made available under the terms of the Eclipse Public License [[Version]] [[v]] 1.0 which accompanies this distribution, and is available at"),
    ("epl-2.0", 1.0, "made available under the terms of the Eclipse Public License [[Version]] [[v]] [[v.]] 2.0 which [[accompanies this distribution, and]] is available at"),
    ("cddl-1.0", 1.0, "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("eupl-1.2", 1.0, "Licensed under the EUPL, Version 1.2"),
    ("ofl-1.1", 1.0, "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
    ("odbl-1.0", 1.0, "is made available under the Open Database License"),
    ("afl-3.0", 1.0, "Licensed under the Academic Free License version 3.0"),
    ("artistic-2.0", 0.9, "The Artistic License 2.0"),
    ("cc0-1.0", 1.0, "To the extent possible under law, {{person|12}} waived all copyright and related or neighboring rights to"),
    *((label, 1.0, f"licensed under [[a]] [[the]] Creative Commons {name} International License") for label, name in _CC.items()),
    *((label, 1.0, f"under the terms of the {name} as published by the Free Software Foundation [[,]] either version {n} of the License, or [[(at your option)]] any later version." + _GNU_NO_WARRANTY) for label, (name, n, _) in _GNU.items()),
    *((label, 0.9, f"under the terms of the {name} as published by the Free Software Foundation either version {n} of the License, or [[(at your option)]] any later version") for label, (name, n, _) in _GNU.items()),
    *((label, 0.9, f"{name} Version {n}, {day}") for label, (name, n, day) in _GNU.items()),
    *((label, 0.7, f"under the [[terms of the]] {name} [[,]] version {n}") for label, (name, n, _) in _GNU.items()),
    *((label, 0.7, f"{verb} under the [[terms of the]] {name}") for label, name in (("mit", "MIT License"), ("apache-2.0", "Apache License, Version 2.0"), ("mpl-2.0", "Mozilla Public License, Version 2.0")) for verb in ("licensed", "released", "distributed")),
)

_MARK = re.compile(r"\[\[(.*?)\]\]|\{\{\w+\|(\d+)\}\}|([^\[\]{}]+)")


#: Of these the first that a template holds must be in a document before its stretches are searched for.
_KEYS = (b" licensed ", b" license ", b" warranties ", b" granted ", b" permitted ", b" copyright ", b" notice ")


class Automaton:
    """States are word positions of the template; replaceable regions keep a count."""

    def __init__(self, template: str):
        #: One step a state: ("word", word), ("any", most words) or ("skip", state after an optional region).
        self.steps: list[tuple] = []
        runs: list[bytes] = []
        for optional, most, plain in _MARK.findall(template):
            words = (optional or plain).encode().translate(FOLD_WORDS).split()
            if optional and words:
                inner = Automaton(optional).steps
                self.steps.append(("skip", len(self.steps) + 1 + len(inner)))
                shift = len(self.steps)
                self.steps += [(k, v + shift) if k == "skip" else (k, v) for k, v in inner]
            elif most:
                self.steps.append(("any", int(most)))
            elif words and not optional:
                runs.append(b" " + b" ".join(words) + b" ")
                self.steps += [("word", w) for w in words]
        self.mandatory = sorted(runs, key=len, reverse=True)
        self.anchor = runs[0] if runs else b""
        self.key = next((k for k in _KEYS if any(k in run for run in runs)), b" ")
        #: An optional region at the start changes nothing about acceptance, so runs start after it.
        while self.steps and self.steps[0][0] == "skip":
            cut = self.steps[0][1]
            self.steps = [(k, v - cut) if k == "skip" else (k, v) for k, v in self.steps[cut:]]

    def _open(self, states: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """States reachable without a word; (state, words that an open region has taken)."""
        todo, seen = list(states), set(states)
        while todo:
            at, _ = todo.pop()
            if at < len(self.steps):
                kind, value = self.steps[at]
                more = [(at + 1, 0), (value, 0)] if kind == "skip" else [(at + 1, 0)] if kind == "any" else []
                for x in more:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
        return seen

    def accepts(self, words: list[bytes], start: int) -> int:
        """The end of the longest accepted run from ``start``, or -1."""
        end, now = -1, self._open({(0, 0)})
        for i in range(start, len(words) + 1):
            if any(at == len(self.steps) for at, _ in now):
                end = i
            if i == len(words):
                break
            after = set()
            for at, taken in now:
                if at < len(self.steps):
                    kind, value = self.steps[at]
                    if kind == "word" and value == words[i]:
                        after.add((at + 1, 0))
                    elif kind == "any" and taken < value:
                        after.add((at, taken + 1))
            if not after:
                break
            now = self._open(after)
        return end


@lru_cache(1)
def automata() -> list[tuple[str, float, Automaton]]:
    return [(label, weight, Automaton(t)) for label, weight, t in TEMPLATES]


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers where a phrase (with a space at both ends) stands."""
    out, at, words, before = [], joined.find(phrase), 0, 0
    while at >= 0:
        words += joined.count(b" ", before, at)
        before = at
        out.append(words)
        at = joined.find(phrase, at + 1)
    return out


def scan(text: bytes) -> dict:
    words = text.translate(FOLD_WORDS).split()
    out = {"n_words": len(words), "places": [], "base_labels": [], "labels": [], "matches": [], "license_score": 0.0}
    joined = b" " + b" ".join(words) + b" "
    labels: dict[str, float] = {}
    for phrase, label in PHRASES.items():
        if at := _places(joined, f" {phrase} ".encode()):
            out["places"] += at
            labels[label] = 0.5
    out["base_labels"] = sorted(labels)
    there = {k: k in joined for k in (*_KEYS, b" ")}
    ends: dict[int, int] = {}
    found = []
    for label, weight, auto in automata():
        if there[auto.key] and all(run in joined for run in auto.mandatory):
            for start in _places(joined, auto.anchor):
                if (end := auto.accepts(words, start)) >= 0:
                    found.append((label, start, end, weight))
                    ends[start] = max(end, ends.get(start, 0))
    for label, start, end, weight in found:
        if end == ends[start]:
            out["matches"].append((label, start, end))
            labels[label] = max(weight, labels.get(label, 0.0))
    out["places"].sort()
    out["labels"] = sorted(labels)
    out["license_score"] = max(labels.values(), default=0.0)
    return out


def find_licenses(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with n_words, places, base_labels, labels, matches, license_score."""

    def make():
        def work(rows: list[bytes]) -> dict:
            each = [scan(text) for text in rows]
            out = {k: [x[k] for x in each] for k in ("n_words", "places", "base_labels", "labels", "license_score")}
            return out | {"matches": [[{"label": k, "first": a, "end": b} for k, a, b in x["matches"]] for x in each]}

        return work

    return append(
        docs, text_col, make,
        "n_words long, places array<long>, base_labels array<string>, labels array<string>, matches array<struct<label:string,first:long,`end`:long>>, license_score double",
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        F.col("license_score").alias("score"),
    )
