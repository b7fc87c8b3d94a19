"""What whole texts are compared with: full licence texts (the folder beside this module) and the usual headers of source files."""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import numpy as np

_GNU = "This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name}General Public License{tail} as published by the Free Software Foundation{either}version {version} of the License{later}. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name}General Public License for more details."
_SEE = " You should have received a copy of the GNU {name}General Public License along with this {what}. If not, see <http://www.gnu.org/licenses/>."
_WRITE = " You should have received a copy of the GNU {name}General Public License along with this {what}; if not, write to the Free Software Foundation, Inc., {where} USA."
_WHERE = ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301", "59 Temple Place, Suite 330, Boston, MA 02111-1307")


def _gnu():
    for key, name, version, what in (("GPL-2.0", "", "2", "program"), ("GPL-3.0", "", "3", "program"), ("LGPL-2.1", "Lesser ", "2.1", "library"), ("LGPL-3.0", "Lesser ", "3", "library"), ("AGPL-3.0", "Affero ", "3", "program")):
        for either, later in ((", either ", ", or (at your option) any later version"), (", ", "")):
            head = {"what": what, "colon": ":", "name": name, "tail": "", "either": either, "version": version, "later": later}
            yield key, _GNU.format(**head)
            yield key, (_GNU + _SEE).format(**head)
            for where in _WHERE:
                yield key, (_GNU + _WRITE).format(**head, where=where)


HEADERS = (
    *_gnu(),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", 'Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org>'),
)
TERM = re.compile(r"version[\s#*/;%-]+[0-9]+(?:\.[0-9]+)*|[a-z]+[0-9]*|[0-9]+(?:\.[0-9]+)*")
#: A block counts only with one of these in it; their words may be parted by ends of lines and marks of comments. Any text with a cue has one of the words of SIGN.
CUE = re.compile(r"licen[cs]e|copyright|spdx|rights\W+reserved|redistribution\W+and\W+use|permission|general\W+public|warrant|public\W+domain", re.I | re.A)
SIGN = r"(?i)licen[cs]e|copyright|spdx|reserved|redistribution|permission|public|warrant"
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() -]*[A-Za-z0-9.+)])")
MARK = re.compile(r"\s*(#|//|\*|--|;|%|dnl\b|rem\b)", re.I)
#: Least similarity of a block of text. Blocks that end in so many paragraphs in a row are ruled out by one bound.
LEAST = 0.75
ENDS = 64
#: Texts that differ from their siblings in little but the title; the folder lacks the siblings.
AFFERO = re.compile(r"^\W*gnu affero general public license\W*$", re.I | re.M)
CREATIVE = re.compile(r"attribution((?:-(?:noncommercial|sharealike|noderivatives))*) 4\.0 international", re.I)


def terms(text: str) -> Counter:
    return Counter(re.sub(r"[^a-z0-9.]+", " ", t) for t in TERM.findall(text.lower()))


def paragraphs(text: str) -> list[str]:
    """Runs of lines with letters, all inside or all outside of line comments."""
    out, marked = [[]], None
    for line in re.split(r"\r\n|\r|\n", text):
        if not re.search(r"[A-Za-z0-9]", line):
            marked = None
            if out[-1]:
                out.append([])
            continue
        now = bool(MARK.match(line))
        if out[-1] and now != marked:
            out.append([])
        out[-1].append(line)
        marked = now
    return ["\n".join(p) for p in out if p]


class Texts:
    """TF-IDF vectors of the texts and headers. Terms that all of them have weigh nothing, terms that none has most."""

    def __init__(self):
        folder = Path(__file__).with_suffix("")
        held = [(f.stem, f.read_text()) for f in sorted(folder.glob("*.txt"))] + list(HEADERS)
        self.ids = [k for k, _ in held]
        counts = [terms(t) for _, t in held]
        df = Counter(t for c in counts for t in c)
        self.unseen = math.log(1 + len(held))
        self.idf = {t: math.log((1 + len(held)) / (1 + n)) for t, n in df.items()}
        self.of = {}
        for i, c in enumerate(counts):
            norm = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in c.items()))
            for t, n in c.items():
                self.of.setdefault(t, np.zeros(len(held)))[i] = n * self.idf[t] / norm

    def best(self, text: str) -> tuple[str, float] | None:
        """(license, similarity) of the identifier that a text declares, else of that run of its paragraphs, of any length, that is most like a text or header."""
        if declared := SPDX.search(text):
            return declared[1].strip(), 1.0
        parts = paragraphs(text)
        cue = [bool(CUE.search(p)) for p in parts]
        counts = [terms(p) for p in parts]
        # no block is more like a text than the root of the squares of those of the text's weights whose terms occur at all (Cauchy and Schwarz)
        most = sum((self.of[t] ** 2 for t in set().union(*counts) if t in self.of), np.zeros(len(self.ids)))
        if not any(cue) or most.max() < LEAST**2 - 1e-9:
            return None
        similarity, k = self._block(counts, cue)
        return (self._named(self.ids[k], text), round(min(1.0, similarity), 6)) if similarity >= LEAST else None

    def _block(self, counts: list[Counter], cue: list[bool]) -> tuple[float, int]:
        """The highest similarity of any run of paragraphs with a cue in it, and the first text that has it; a similarity below LEAST may be reported as 0.

        All starts, from the last to the first, meet all ends. A start's squared norms are those of the start after it and the
        products of its paragraph with all that follow. Ends in a row need no look if the dot products at the last of them over the
        norm at the first are too small: both only grow with the end.
        """
        n = len(counts)
        dots = np.zeros((n + 1, len(self.ids)))
        weights, where = [], {}
        for p, c in enumerate(counts):
            dots[p + 1] = dots[p] + sum((self.of[t] * (k * self.idf[t]) for t, k in c.items() if t in self.of), 0.0)
            weights.append({t: w for t, k in c.items() if (w := k * self.idf.get(t, self.unseen))})
            for t, w in weights[p].items():
                where.setdefault(t, []).append((p, w))
        places = {t: (np.array([p for p, _ in x]), np.array([w for _, w in x]), [len(x)]) for t, x in where.items()}
        norms, cued, top = np.zeros(n), n, (0.0, 0)
        for i in reversed(range(n)):
            products = np.zeros(n - i)
            for t, w in weights[i].items():
                at, v, first = places[t]
                first[0] -= 1
                products[at[first[0] :] - i] += w * v[first[0] :]
            norms[i:] += 2 * np.cumsum(products) - products[0]
            cued = i if cue[i] else cued
            low = np.arange(cued, n, ENDS)
            high = np.minimum(low + ENDS, n)
            bar = max(LEAST, top[0]) - 1e-9
            near = (dots[high] - dots[i]).max(axis=1) >= bar * np.sqrt(norms[low])
            for a, b in zip(low[near], high[near]):
                length = np.sqrt(norms[a:b, None])
                alike = np.round(np.divide(dots[a + 1 : b + 1] - dots[i], length, out=np.zeros((b - a, len(self.ids))), where=length > 0), 9).max(axis=0)
                k = int(np.argmax(alike))
                top = max(top, (float(alike[k]), -k))
        return top[0], -top[1]

    def _named(self, found: str, text: str) -> str:
        if found == "GPL-3.0" and AFFERO.search(text):
            return "AGPL-3.0"
        if found == "CC-BY-SA-4.0" and (title := CREATIVE.search(text)):
            short = {"noncommercial": "NC", "sharealike": "SA", "noderivatives": "ND"}
            return "-".join(["CC-BY", *[short[p] for p in title[1].lower().split("-") if p], "4.0"])
        return found
