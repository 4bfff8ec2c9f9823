"""License scans: template markup compiled into token automata.

A template is text with two kinds of marked regions, as in public license
lists: ``[[ ... ]]`` may be left out, ``{{n}}`` stands for up to n words of any
kind (names, years, addresses). Everything else is mandatory wording and must
match word for word, in order, with nothing in between. Each template becomes an
automaton over words; all run together from every place where a template may
begin.

Base labels come from fixed phrases; a template adds its own label.
"""

from __future__ import annotations

import pkgutil
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from fluxline.llm.common import alnum_words, map_rows, texts

# Phrase and label.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Licenses whose texts lie in license_texts as they are published.
WHOLE = ("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0", "CC0-1.0")


def _whole(name: str) -> str:
    """Template of a text: its terms to their end, addresses replaceable. What
    tells how to apply it to a work of one's own comes after the terms."""
    text = pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()
    terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
    terms = re.sub(r"51 Franklin\s+Street, Fifth\s+Floor, Boston, MA\s+02110-1301,?\s+USA", " {{12}} ", terms)
    return re.sub(r"<?https?://[^\s>]+>?", " {{8}} ", terms) + (f"[[{end}]]" if end else "")


_BSD = """
    Redistribution and use in source and binary forms, with or without modification, are permitted provided
    that the following conditions are met: [[1.]] Redistributions of source code must retain the above
    copyright notice, this list of conditions and the following disclaimer. [[2.]] Redistributions in binary
    form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
    the documentation and/or other materials provided with the distribution. """
_BSD_NAMES = """
    Neither the name of {{12}} nor the names of [[its]] [[{{4}}]] contributors may be used to endorse or promote
    products derived from this software without specific prior written permission. """
_BSD_END = """
    THIS SOFTWARE IS PROVIDED BY {{12}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
    TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
    SHALL {{12}} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
    (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
    BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
    TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
    THE POSSIBILITY OF SUCH DAMAGE."""

# Wording of public licenses and of the usual notices. Several templates may
# carry one label.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit-text", """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice [[(including the next
        paragraph)]] shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {{12}} BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit-notice", "[[is]] released under the [[terms of the]] MIT License"),
    ("mit-notice", "licensed under the [[terms of the]] MIT License"),
    ("isc-text", """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all
        copies. THE SOFTWARE IS PROVIDED "AS IS" AND {{12}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{12}} BE LIABLE FOR
        ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
        USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT
        OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd-2-text", _BSD + _BSD_END),
    ("bsd-3-text", _BSD + "[[3.]]" + _BSD_NAMES + _BSD_END),
    ("bsd-4-text", _BSD + """[[3.]] All advertising materials mentioning features or use of this software must
        display the following [[acknowledgement]] [[acknowledgment]]: This product includes software developed by
        {{12}} [[4.]]""" + _BSD_NAMES + _BSD_END),
    ("unlicense-text", """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize
        copyright laws, the author or authors of this software dedicate any and all copyright interest in the
        software to the public domain. We make this dedication for the benefit of the public at large and to the
        detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
        perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
        OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
        SOFTWARE."""),
    ("zlib-text", """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors
        be held liable for any damages arising from the use of this software. Permission is granted to anyone to
        use this software for any purpose, including commercial applications, and to alter it and redistribute it
        freely, subject to the following restrictions: [[1.]] The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. If you use this software in a
        product, an acknowledgment in the product documentation would be appreciated but is not required. [[2.]]
        Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. [[3.]] This notice may not be removed or altered from any source distribution."""),
    *((f"{name.lower()}-text", _whole(name)) for name in WHOLE),
    ("apache-notice", "Licensed under the Apache License, Version {{2}}"),
    ("apache-header", """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at {{10}} Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("gpl-notice", "licensed under the [[terms of the]] GNU [[Lesser]] [[Affero]] General Public License [[version {{1}}]]"),
    ("gpl-header", """
        This program is free software[[:]] you can redistribute it and/or modify it under the terms of the GNU
        [[Lesser]] [[Affero]] General Public License as published by the Free Software Foundation[[,]] either
        version {{1}} of the License, or [[(at your option)]] any later version."""),
    ("cc-notice", "Licensed under [[a]] [[the]] CC BY [[NC]] [[SA]] [[ND]] {{2}}"),
    ("cc-notice", """
        This work is licensed under a Creative Commons Attribution [[NonCommercial]] [[ShareAlike]]
        [[NoDerivatives]] {{2}} [[International]] License"""),
)

_MARK = re.compile(r"\[\[|\]\]|\{\{(\d+)\}\}")

FIELDS = ("n_words bigint, places array<struct<word:bigint,phrase:string>>, "
          "matches array<struct<label:string,first_word:bigint,last_word:bigint>>")


class Automaton:
    """Word automata of all templates, as one set of numbered states.

    ``step[s]`` maps a word to the next state, ``skip[s]`` lists states reached
    without a word, ``free[s]`` is the state any word leads to, ``label[s]``
    names the template that begins in s.
    """

    def __init__(self, templates):
        self.step: list[dict[bytes, int]] = []
        self.skip: list[list[int]] = []
        self.free: list[int | None] = []
        self.accepting: set[int] = set()
        self.label: dict[int, str] = {}
        for label, text in templates:
            begin = self._state()
            self.label[begin] = label
            self.accepting.add(self._compile(text, begin))
        # A word that can open a template, with the states to begin in.
        self.first: dict[bytes, tuple[int, ...]] = {}
        for begin in self.label:
            closed = self.closure({begin})
            if any(self.free[s] is not None for s in closed):
                raise ValueError("a template must begin with mandatory wording")
            for s in closed:
                for word in self.step[s]:
                    self.first[word] = (*self.first.get(word, ()), begin)

    def _state(self) -> int:
        self.step.append({})
        self.skip.append([])
        self.free.append(None)
        return len(self.step) - 1

    def _compile(self, text: str, at: int) -> int:
        opened: list[int] = []
        done = 0
        for mark in [*_MARK.finditer(text), None]:
            for word in alnum_words(text[done:mark.start() if mark else None].encode()):
                new = self._state()
                self.step[at][word] = new
                at = new
            if mark is None:
                break
            done = mark.end()
            if mark[0] == "[[":
                # A region of its own start state, so that skipping it cannot
                # be mixed with an earlier word.
                new = self._state()
                self.skip[at].append(new)
                opened.append(at)
                at = new
            elif mark[0] == "]]":
                new = self._state()
                self.skip[at].append(new)
                self.skip[opened.pop()].append(new)
                at = new
            else:
                end = self._state()
                for _ in range(int(mark[1])):
                    self.skip[at].append(end)
                    new = self._state()
                    self.free[at] = new
                    at = new
                self.skip[at].append(end)
                at = end
        if opened:
            raise ValueError("an optional region is not closed")
        return at

    @lru_cache(maxsize=100_000)  # noqa: B019  lives as long as the task
    def _closed(self, states: frozenset[int]) -> frozenset[int]:
        seen, left = set(states), list(states)
        while left:
            for s in self.skip[left.pop()]:
                if s not in seen:
                    seen.add(s)
                    left.append(s)
        return frozenset(seen)

    def closure(self, states) -> frozenset[int]:
        return self._closed(frozenset(states))

    def match_at(self, words: list[bytes], i: int, begin: int) -> int | None:
        """End (exclusive) of the longest match of one template from word i."""
        live, end = self.closure({begin}), None
        while live:
            if live & self.accepting:
                end = i
            if i == len(words):
                break
            word, after = words[i], set()
            for s in live:
                if (n := self.step[s].get(word)) is not None:
                    after.add(n)
                if self.free[s] is not None:
                    after.add(self.free[s])
            live = self.closure(after)
            i += 1
        return end

    def matches(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        found = []
        for i, begins in self._openings(words):
            for begin in begins:
                if (end := self.match_at(words, i, begin)) is not None:
                    found.append((self.label[begin], i, end))
        return sorted(set(found), key=lambda m: (m[1], m[2], m[0]))

    def _openings(self, words: list[bytes]):
        present = self.first.keys() & set(words)
        if present:
            for i, word in enumerate(words):
                if word in present:
                    yield i, self.first[word]


def phrase_places(words: list[bytes], phrases) -> list[tuple[int, str]]:
    """Start and label of every place where a phrase's words stand together."""
    out = []
    for phrase, label in phrases:
        want = phrase.encode().split(b" ")
        i = -1
        try:
            while True:
                i = words.index(want[0], i + 1)
                if words[i:i + len(want)] == want:
                    out.append((i, label))
        except ValueError:
            pass
    return sorted(out)


def scan_licenses(
    docs: DataFrame,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    phrases: tuple[tuple[str, str], ...] = PHRASES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``places`` (phrases and
    where they start, in words) and ``matches`` (templates and their words, end
    exclusive).

    No row moves. Null and empty texts have no words; null ids are kept; repeated
    rows are scanned each.
    """

    def start():
        auto = Automaton(templates)

        def work(rows):
            out = [[], [], []]
            for text in rows["text"]:
                words = alnum_words(text or b"")
                out[0].append(len(words))
                out[1].append([{"word": i, "phrase": p} for i, p in phrase_places(words, phrases)])
                out[2].append([{"label": m, "first_word": a, "last_word": b} for m, a, b in auto.matches(words)])
            return out

        return work

    return map_rows(texts(docs, id_col, text_col), FIELDS, start, weigh="text", carry=("doc_id",))


def score(n_places: Column, longest: Column) -> Column:
    """How sure it is that a text states a license: 0 without a sign, 0.5 for a
    phrase alone, and towards 1 with the words of the longest match."""
    matched = 0.5 + 0.5 * (1 - F.exp(-longest / 10.0))
    return F.when(longest > 0, matched).when(n_places > 0, F.lit(0.5)).otherwise(F.lit(0.0))
