"""Operator 9: licence scan by sparse TF-IDF cosine, with inheritance from the nearest directory above.

Every line of a text is a sparse vector of word uni- and bigrams, weighted by their inverse frequency among the
templates, and is compared with each template. Statements wrap: a line that resembles a template in part (OPENS) is
joined with the lines around it for as long as the cosine rises, up to WINDOW lines; comment marks count for nothing. A
line or window counts at `threshold` or more. (The window's vector is the sum of its lines', so one of at most eight
lines has at least 1/sqrt(8) of its cosine, but for the bigrams across line ends.) A file whose words are mostly such lines is a licence file and speaks for its directory. Files without a licence of their own take that of the nearest
directory above that has one: directories are matched with their ancestors by a join on paths, once per directory, and
files with their directory.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.llm.common import materialise, spread_join, with_row_id

#: Licence statements by name (fixed values: wordings in common use).
TEMPLATES = {
    "Apache-2.0": ["Apache License Version 2.0, January 2004", "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "MIT": ["MIT License", "The MIT License (MIT)", "Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction."],
    "GPL-3.0": ["GNU General Public License Version 3, 29 June 2007", "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["GNU General Public License Version 2, June 1991", "This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved."],
}
#: Paragraphs of licence texts beyond their headers (fixed values). BSD-3-Clause has those of BSD-2-Clause too.
BODIES = {
    "MIT": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "BSD-2-Clause": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "Apache-2.0": [
        "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "Derivative Works shall mean any work, whether in Source or Object form, that is based on (or derived from) the Work and for which the editorial revisions, annotations, elaborations, or other modifications represent, as a whole, an original work of authorship. For the purposes of this License, Derivative Works shall not include works that remain separable from, or merely link (or bind by name) to the interfaces of, the Work and Derivative Works thereof.",
        "Contribution shall mean any work of authorship, including the original version of the Work and any modifications or additions to that Work or Derivative Works thereof, that is intentionally submitted to Licensor for inclusion in the Work by the copyright owner or by an individual or Legal Entity authorized to submit on behalf of the copyright owner. For the purposes of this definition, submitted means any form of electronic, verbal, or written communication sent to the Licensor or its representatives, including but not limited to communication on electronic mailing lists, source code control systems, and issue tracking systems that are managed by, or on behalf of, the Licensor for the purpose of discussing and improving the Work, but excluding communication that is conspicuously marked or otherwise designated in writing by the copyright owner as Not a Contribution.",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work, where such license applies only to those patent claims licensable by such Contributor that are necessarily infringed by their Contribution(s) alone or by combination of their Contribution(s) with the Work to which such Contribution(s) was submitted. If You institute patent litigation against any entity (including a cross-claim or counterclaim in a lawsuit) alleging that the Work or a Contribution incorporated within the Work constitutes direct or contributory patent infringement, then any patent licenses granted to You under this License for that Work shall terminate as of the date such litigation is filed.",
        "Redistribution. You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions:",
        "Submission of Contributions. Unless You explicitly state otherwise, any Contribution intentionally submitted for inclusion in the Work by You to the Licensor shall be under the terms and conditions of this License, without any additional terms or conditions. Notwithstanding the above, nothing herein shall supersede or modify the terms of any separate license agreement you may have executed with Licensor regarding such Contributions.",
        "Disclaimer of Warranty. Unless required by applicable law or agreed to in writing, Licensor provides the Work (and each Contributor provides its Contributions) on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied, including, without limitation, any warranties or conditions of TITLE, NON-INFRINGEMENT, MERCHANTABILITY, or FITNESS FOR A PARTICULAR PURPOSE. You are solely responsible for determining the appropriateness of using or redistributing the Work and assume any risks associated with Your exercise of permissions under this License.",
        "Limitation of Liability. In no event and under no legal theory, whether in tort (including negligence), contract, or otherwise, unless required by applicable law (such as deliberate and grossly negligent acts) or agreed to in writing, shall any Contributor be liable to You for damages, including any direct, indirect, special, incidental, or consequential damages of any character arising as a result of this License or out of the use or inability to use the Work (including but not limited to damages for loss of goodwill, work stoppage, computer failure or malfunction, or any and all other commercial damages or losses), even if such Contributor has been advised of the possibility of such damages.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
}
#: Whose header stands above a body of another name.
HEADED_AS = {"BSD-2-Clause": "BSD-3-Clause"}
#: Lines of a window at most, and the cosine at which a line opens one.
WINDOW, OPENS = 8, 0.25
_TOKEN = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def grams(line: str) -> Counter:
    words = _TOKEN.findall(line.lower())
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


class Matcher:
    """Cosines of lines with the templates. Terms that no template has count with the largest weight, so that other
    words around a statement lower its cosine."""

    def __init__(self, templates: dict[str, list[str]]):
        rows = [(name, grams(t)) for name, texts in templates.items() for t in texts]
        df = Counter(g for _, c in rows for g in c)
        self.idf = {g: 1 + math.log((1 + len(rows)) / (1 + n)) for g, n in df.items()}
        self.other = 1 + math.log(1 + len(rows))
        self.index: dict[str, list[tuple[int, float]]] = {}
        self.names = [name for name, _ in rows]
        for i, (_, c) in enumerate(rows):
            v = {g: n * self.idf[g] for g, n in c.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            for g, x in v.items():
                self.index.setdefault(g, []).append((i, x / norm))
        # A template's telling words: its longer ones and those of no other licence; where it has none of them, all.
        held: dict[str, set[str]] = {}
        for name, c in rows:
            for g in c:
                held.setdefault(g, set()).add(name)
        self.words = set()
        for _, c in rows:
            single = {g for g in c if " " not in g}
            self.words |= {g for g in single if len(g) > 4 or len(held[g]) == 1 and len(g) > 2 and not g.isdigit()} or single
        self.words |= {"cc"} & set(self.idf)

    def best(self, line: str) -> tuple[str | None, float]:
        """The nearest template's name and its cosine; of equal ones the first."""
        c = grams(line)
        dots = [0.0] * len(self.names)
        norm = 0.0
        for g, n in c.items():
            x = n * self.idf.get(g, self.other)
            norm += x * x
            for i, y in self.index.get(g, ()):
                dots[i] += x * y
        if not norm or not any(dots):
            return None, 0.0
        i = max(range(len(dots)), key=lambda k: (dots[k], -k))
        return self.names[i], dots[i] / math.sqrt(norm)


@functools.lru_cache(maxsize=4)
def _matcher(key: tuple) -> Matcher:
    return Matcher({k: list(v) for k, v in key})


def windows(lines: list[str], matcher: Matcher, threshold: float):
    """(licence, cosine, first line, line after the last) of every line that resembles a template, widened while the cosine
    rises, where that reaches the threshold."""
    for k, line in enumerate(lines):
        # Without a telling word of a template no cosine reaches a threshold: what is left is shared by all of them.
        if matcher.words.isdisjoint(_TOKEN.findall(line.lower())):
            continue
        name, cosine = matcher.best(line)
        if cosine < OPENS:
            continue
        lo, hi = k, k + 1
        while hi - lo < WINDOW:
            wider = [(*matcher.best(" ".join(lines[a:b])), a, b) for a, b in ((lo - 1, hi), (lo, hi + 1)) if a >= 0 and b <= len(lines)]
            found = max(wider, key=lambda f: f[1], default=(None, 0.0))
            if found[1] <= cosine + 1e-12:
                break
            name, cosine, lo, hi = found
        if cosine >= threshold:
            yield name, cosine, lo, hi


def paragraphs(lines: list[str]):
    """(first line, line after the last) of every run of lines that have words."""
    start = None
    for k, line in enumerate([*lines, ""]):
        if _TOKEN.search(line):
            start = k if start is None else start
        elif start is not None:
            yield start, k
            start = None


def scan_text(text: str, matcher: Matcher, threshold: float, bodies: Matcher | None = None) -> tuple[str | None, float, int | None, float]:
    """(licence, cosine, first line, share of the text's words in licence lines) of the best line or window; a tie goes to
    the first. An empty text has none. Where paragraphs of a licence's body are there, that licence's statement goes before
    others; of bodies the one with most lines counts, but a body that adds to another goes before it."""
    lines = text.split("\n")
    many = [len(x.split()) for x in lines]
    hits: dict[str, tuple[float, int]] = {}
    inside = set()
    for name, cosine, lo, hi in windows(lines, matcher, threshold):
        inside.update(range(lo, hi))
        if name not in hits or cosine > hits[name][0] + 1e-12:
            hits[name] = cosine, lo
    best = (None, 0.0, None)
    for name, (cosine, lo) in sorted(hits.items(), key=lambda h: h[1][1]):
        if cosine > best[1] + 1e-12:
            best = name, cosine, lo
    if hits and bodies is not None and bodies.names:
        found: dict[str, set[int]] = {}
        for lo, hi in paragraphs(lines):
            name, cosine = bodies.best(" ".join(lines[lo:hi]))
            if cosine >= threshold:
                found.setdefault(name, set()).update(range(lo, hi))
        for name, _, lo, hi in windows(lines, bodies, threshold):
            found.setdefault(name, set()).update(range(lo, hi))
        inside.update(*found.values())
        for name in sorted(found, key=lambda n: (n in HEADED_AS.values(), len(found[n])), reverse=True):
            said = hits.get(name) or hits.get(HEADED_AS.get(name))
            if said:
                best = name, *said
                break
    return *best, sum(many[k] for k in inside) / max(sum(many), 1)


def scan(files: DataFrame, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.75, templates: dict[str, list[str]] | None = None, license_share: float = 0.5, bodies: dict[str, list[str]] | None = None) -> DataFrame:
    """keep, license, score, line, is_license_file, effective_license and distance of every row of files (path, text).

    license is the row's own (null if none), distance how many directories above the file's own the effective licence
    comes from (0: its own directory; null: its own text, or none at all). Of a directory's licence files the highest
    cosine counts, then the first name. Null paths have no directory; null and empty texts have no licence. Rows are
    kept apart even if repeated; texts are read whole, however long; an empty table gives no rows. Columns other than
    keep, path and text are not read, and may have any name. bodies: further paragraphs of licences (see scan_text); with
    templates of the caller's none unless given.
    """
    key, body_key = (tuple((k, tuple(v)) for k, v in t.items()) for t in (templates or TEMPLATES, bodies if bodies is not None else {} if templates else BODIES))
    kinds = {f.name: f.dataType.simpleString() for f in files.schema.fields}
    k = len(keep)
    kept = [f"_keep{i}" for i in range(k)]
    names = [*kept, "_dir", "license", "score", "line", "share"]

    def run(batches):
        m, more = _matcher(key), _matcher(body_key)
        for batch in batches:
            found = [scan_text(t or "", m, threshold, more) for t in batch.column(k + 1).to_pylist()]
            cols = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k + 1)), *cols], names=names)

    folder = F.regexp_extract(F.col("path").cast("string"), r"^(.*)/[^/]*$", 1).alias("_dir")
    own = files.select(*keep, folder, F.col("text").cast("string").alias("_text")).mapInArrow(run, ", ".join([f"{a} {kinds[c]}" for a, c in zip(kept, keep)] + ["_dir string, license string, score double, line int, share double"]))
    own = own.withColumn("is_license_file", F.col("license").isNotNull() & (F.col("share") >= license_share)).drop("share")
    own = materialise(with_row_id(own), "license_scan")
    # A row per directory, then per directory and ancestor: paths are short, so this grows with directories alone.
    said = own.where("is_license_file and _dir is not null").groupBy(F.col("_dir").alias("_above")).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license"))).alias("v")).select("_above", F.col("v.license").alias("_taken"))
    parts = F.split("_dir", "/")
    above = own.where("_dir is not null").select("_dir").distinct().select("_dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), "/"))).alias("_up", "_above"))
    nearest = above.join(said, "_above").groupBy("_dir").agg(F.min(F.struct("_up", "_taken")).alias("v"))
    # The files of a large directory are dealt over several tasks.
    own = spread_join(own, nearest.select("_dir", F.col("v._up").alias("_up"), F.col("v._taken").alias("_taken")), ["_dir"], ["_row"], "left")
    return own.select(
        *[F.col(a).alias(c) for a, c in zip(kept, keep)], "license", "score", "line", "is_license_file", F.coalesce("license", "_taken").alias("effective_license"), F.when(F.col("license").isNull(), F.col("_up")).alias("distance")
    )
