"""License scanning in built-in SQL functions alone: MinHash bands over text windows, then exact containment.

Texts are compared as lower-cased words of ASCII letters and digits, by SHINGLE-word
shingles.  A template of L shingles belongs to the size class c, the power of two from
which L <= c < 2L.  The windows of class c are 2c shingles long and begin at every
multiple of c, so each place where a template may stand lies inside one window, whose
Jaccard similarity to the template is then at least CONTAINED * L / (2c + L) > 0.15.

Sketches are one-permutation MinHash: a shingle's hash puts it in one of BINS bins, and a
bin's least hash is a band of its own.  A window and a template that share a band meet in
an equi-join of bands.  Only the bins whose least hash is a band of some template can meet
one, so the others are not written.  With as many bins as here, a window that contains
CONTAINED of a template shares a band with it with probability > 0.9999 (``collision``).
Retrieved templates are verified by the exact share of their shingles that the window
contains.  Of findings in overlapping windows that name different licenses only the one
with the highest share stays, or of equal shares the longest notice: the notice of one
version of a license contains most shingles of the next version's.

Defined results: null and empty texts, and those shorter than a shingle, contain nothing; a
text of any length is read whole, its windows one by one; findings of equal share and
length all stay; repeated rows give one row for each id and license; a null id is an id of
its own; further columns are ignored, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import let

SHINGLE = 3
CONTAINED = 0.8
BINS = 1024

#: The licenses' usual notices, and the texts of the short licenses in passages.
TEMPLATES = {
    "MIT": [
        "under the MIT License",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "under the Apache License, Version 2.0",
        "under the Apache 2.0 License",
        "under Apache License 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    ],
    "GPL-2.0": [
        "GNU General Public License, version 2",
        "SPDX-License-Identifier: GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    ],
    "GPL-3.0": [
        "GNU General Public License, version 3",
        "SPDX-License-Identifier: GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ],
    "LGPL-2.1": [
        "GNU Lesser General Public License, version 2.1",
        "SPDX-License-Identifier: LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "GNU Lesser General Public License, version 3",
        "SPDX-License-Identifier: LGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "GNU Affero General Public License, version 3",
        "SPDX-License-Identifier: AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD": [
        "under the BSD License",
        "SPDX-License-Identifier: BSD-2-Clause",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "ISC": [
        "under the ISC License",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": [
        "Mozilla Public License, version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "EPL-2.0": [
        "under the terms of the Eclipse Public License 2.0 which is available at",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "CC0-1.0": [
        "SPDX-License-Identifier: CC0-1.0",
        "has waived all copyright and related or neighboring rights to this work",
        "under CC0 1.0",
    ],
    "CC-BY-4.0": [
        "under a Creative Commons Attribution 4.0 International License",
        "under CC BY 4.0",
    ],
    "CC-BY-SA-4.0": [
        "under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "under CC BY-SA 4.0",
    ],
    "CC-BY-NC-4.0": [
        "under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "under CC BY-NC 4.0",
    ],
    "CC-BY-NC-SA-4.0": [
        "under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
        "under CC BY-NC-SA 4.0",
    ],
    "CC-BY-ND-4.0": [
        "under a Creative Commons Attribution-NoDerivatives 4.0 International License",
        "under CC BY-ND 4.0",
    ],
    "Zlib": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "WTFPL": [
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    ],
    "Proprietary": [
        "All rights reserved.",
    ],
}


def collision(template: int, window: int, bins: int = BINS) -> float:
    """Probability that a template of so many shingles shares a band with a window that contains CONTAINED of them.

    A common shingle is a band of both if no other shingle of either in its bin is less; with
    ``load`` others expected there that is (1 - e ** -load) / load, for each of them.
    """
    load = (template + window) / bins
    return 1 - (1 - (1 - math.exp(-load)) / load) ** math.ceil(CONTAINED * template)


def shingles(text: Column) -> Column:
    """Hashes of the text's shingles in order."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")
    hashed = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*(w[i + k] for k in range(SHINGLE))))
    return let(words, lambda w: F.when(F.size(w) >= SHINGLE, hashed(w)).otherwise(F.array().cast("array<bigint>")))


def _bin(h: Column) -> Column:
    return F.pmod(h, F.lit(BINS))


def sketch(window: Column) -> Column:
    """The window's bands: the hashes that are the least of their bin."""
    least = lambda h: ~F.exists(window, lambda o: (_bin(o) == _bin(h)) & (o < h))
    return F.array_distinct(F.filter(window, least))


def size_class(n: int) -> int:
    return 1 << (n - 1).bit_length()


def templates(spark: SparkSession) -> DataFrame:
    """(tid, license, need, cls): TEMPLATES with their distinct shingles; as many rows as there are notices."""
    rows = [(i, name, text) for i, (name, text) in enumerate((n, t) for n, ts in TEMPLATES.items() for t in ts)]
    out = spark.createDataFrame(rows, "tid int, license string, text string")
    out = out.select("tid", "license", F.array_distinct(shingles(F.col("text"))).alias("need"), F.size(shingles(F.col("text"))).alias("n"))
    cls = F.pow(F.lit(2), F.ceil(F.log2(F.col("n")))).cast("int")
    return out.select("tid", "license", "need", cls.alias("cls"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, containment, first_word, windows): the licenses found in each document."""
    spark = docs.sparkSession
    known = templates(spark).withColumn("bands", let(F.col("need"), sketch))
    fixed = known.collect()  # TEMPLATES, a constant of this module
    banded = sorted({h for r in fixed for h in r["bands"]})
    classes = sorted({r["cls"] for r in fixed})
    known = spark.createDataFrame(fixed, known.schema)

    def windows(g: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: g[i].isin(banded))

        def of_class(at: Column, c: int) -> Column:
            starts = F.array_distinct(F.flatten(F.transform(at, lambda p: F.array((p - p % c) / c, (p - p % c) / c - 1))))
            starts = F.filter(F.transform(starts, lambda j: j.cast("int")), lambda j: j >= 0)
            return F.transform(starts, lambda j: F.struct(F.lit(c).alias("cls"), (j * c).alias("at"), F.slice(g, j * c + 1, 2 * c).alias("win")))

        return let(hits, lambda at: F.when(F.size(at) > 0, F.concat(*(of_class(at, c) for c in classes))))

    def met(win: Column) -> Column:
        """The window's bands that some template has."""
        least = lambda h: ~F.exists(win, lambda o: (_bin(o) == _bin(h)) & (o < h))
        return F.filter(F.array_distinct(F.filter(win, lambda h: h.isin(banded))), least)

    found = let(shingles(F.col(text_col)), lambda g: F.when(F.size(g) > 0, windows(g)))
    rows = docs.select(F.col(id_col), F.explode(found).alias("w")).select(id_col, "w.cls", "w.at", "w.win")
    table = known.select("tid", "cls", F.explode("bands").alias("band"))
    retrieved = rows.withColumn("band", F.explode(let(F.col("win"), met))).join(F.broadcast(table), ["cls", "band"])
    retrieved = retrieved.select(id_col, "at", "win", "tid").distinct()
    checked = retrieved.join(F.broadcast(known.select("tid", "license", "need", "cls")), "tid").withColumn("containment", F.size(F.array_intersect("need", "win")) / F.size("need"))
    hit = F.struct("license", "containment", F.size("need").alias("n"), F.col("at").cast("long").alias("at"), (F.col("at") + 2 * F.col("cls")).cast("long").alias("stop"))
    hits = checked.where(F.col("containment") >= CONTAINED).groupBy(id_col).agg(F.collect_list(hit).alias("hits"))  # of one document
    better = lambda o, h: (o["license"] != h["license"]) & (o["at"] < h["stop"]) & (h["at"] < o["stop"]) & (F.struct(o["containment"], o["n"]) > F.struct(h["containment"], h["n"]))
    best = let(F.col("hits"), lambda hs: F.filter(hs, lambda h: ~F.exists(hs, lambda o: better(o, h))))
    out = hits.select(id_col, F.explode(best).alias("h")).select(id_col, "h.*")
    return out.groupBy(id_col, "license").agg(F.max("containment").alias("containment"), F.min("at").alias("first_word"), F.count("*").alias("windows"))
