"""License scans with DataFrame functions only.

Texts and license templates are cut into five-word shingles (lower case; anything but letters and digits separates
words). A shingle that no template has cannot count for any, so only a document's template shingles go on; they fall
into overlapping windows of ``WINDOW`` words, ``STEP`` apart. Templates have such a window at every word. Each window
has ``HASHES`` min-hashes, each a band of its own: a window pair of similarity s meets with probability
1 - (1 - s)^HASHES, over 0.99998 at s = 0.5, and a passage copied whole has an equal window (s = 1). So that this holds
for short templates beside other license text too, there are windows of each number of shingles in ``SCALES`` at every
shingle, and templates have those of the three largest numbers that do not exceed their own. Pairs of document
and template that meet are verified by exact containment of the template's shingles, ``PERCENT`` of 100 at least.

Documents are read once; what is left of them is written and used for retrieval and verification. The tables of templates
are broadcast up to ``MOST`` rows each (counted first), beyond that joins shuffle. Templates of fewer words than a shingle
have none and match nothing. Null, empty and short texts match nothing. Each row is judged by itself, also where rows share
a doc_id or have none, and gives a result row for each license found. Words are compared by 64-bit hashes of five-word shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_size, cut

SHINGLE, WINDOW, STEP, HASHES, PERCENT, MOST = 5, 32, 16, 16, 80, 1_000_000

SCALES = (1, 2, 4, 8, 16)

#: Notices and texts of public licenses.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
]


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(TEMPLATES)], "template_id int, license string, template string")


def _spots(text: Column) -> Column:
    """Shingles of a text as structs of hash h and first word i, from 1."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    made = lambda w: F.when(F.size(w) < SHINGLE, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.struct(F.xxhash64(F.slice(w, i, SHINGLE)).alias("h"), i.alias("i")))
    )
    return F.transform(F.array(words), made)[0]


def _bands(windows: DataFrame, *keys: str) -> DataFrame:
    """(keys, band, value) from windows (keys, h)."""
    least = windows.groupBy(*keys).agg(*(F.min(F.xxhash64("h", F.lit(j))).alias(f"m{j}") for j in range(HASHES)))
    return least.select(*keys, F.posexplode(F.array(*(F.col(f"m{j}") for j in range(HASHES)))).alias("band", "value"))


def scan(docs: DataFrame, templates: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of docs and license found: doc_id, license, template_id (the best), containment, first_word, n_places."""
    spark = docs.sparkSession
    spots = cut(spark, templates.select("template_id", "license", F.explode(_spots(F.col("template"))).alias("s")).select("template_id", "license", "s.h", "s.i"), "templates")
    need = by_size(spots.select("h").distinct(), MOST)
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), _spots(F.col("text")).alias("spots"))
    own = numbered.select("doc_id", "row", F.explode("spots").alias("s")).select("doc_id", "row", "s.h", "s.i").join(need, "h")
    own = cut(spark, own, "shingles")  # documents are read, numbered and cut into shingles once

    last = WINDOW - SHINGLE  # shingles of a window start at most so far after its first word
    place = F.floor((F.col("i") - 1) / STEP).cast("int")
    windows = own.select("row", "h", F.lit(0).alias("scale"), F.explode(F.filter(F.array(place, place - 1), lambda w: F.col("i") - 1 - w * STEP <= last)).alias("w"))
    for s in SCALES:
        windows = windows.unionByName(own.select("row", "h", F.lit(s).alias("scale"), F.explode(F.sequence(F.col("i") - (s - 1), F.col("i"))).alias("w")))
    length = spots.groupBy("template_id").agg(F.max("i").alias("length"))
    fits = F.filter(F.array(*map(F.lit, SCALES)), lambda s: s <= F.col("length"))
    scales = length.select("template_id", "length", F.explode(F.concat(F.array(F.lit(0)), F.slice(F.reverse(fits), 1, 3))).alias("scale"))
    inside = F.expr(f"b.i between a.i and a.i + if(scale = 0, {last}, scale - 1) and (scale = 0 or a.i + scale - 1 <= length)")
    every = spots.alias("a").join(spots.alias("b"), "template_id").join(scales, "template_id").where(inside).select("template_id", "scale", F.col("a.i").alias("w"), F.col("b.h").alias("h"))
    known = by_size(cut(spark, _bands(every, "template_id", "scale", "w").select("scale", "band", "value", "template_id").distinct(), "bands"), MOST)
    met = _bands(windows, "row", "scale", "w").join(known, ["scale", "band", "value"]).select("row", "template_id").distinct()

    sizes = by_size(spots.groupBy("template_id", "license").agg(F.countDistinct("h").alias("n_template")), MOST)
    holders = by_size(spots.select("template_id", "h").distinct(), MOST)
    # Only a document's own template shingles are joined, each with the few templates that have it.
    shared = own.groupBy("row", "h").agg(F.first("doc_id").alias("doc_id"), F.min("i").alias("i"), F.count("*").alias("c")).join(holders, "h")
    counts = shared.groupBy("row", "template_id").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("k"), F.min("i").alias("first_word"), F.max("c").alias("n_places"))
    counts = counts.join(met, ["row", "template_id"], "left_semi")
    found = counts.join(sizes, "template_id").where(F.col("k") * 100 >= F.col("n_template") * percent).select("row", "doc_id", "license", "template_id", "n_template", (F.col("k") / F.col("n_template")).alias("containment"), "first_word", "n_places")
    best = F.max_by(F.struct("template_id", "first_word", "n_places"), F.struct("containment", F.col("n_template"), -F.col("template_id")))
    out = found.groupBy("row", "license").agg(F.first("doc_id").alias("doc_id"), F.max("containment").alias("containment"), best.alias("b"))
    return out.select("doc_id", "license", "b.template_id", "containment", "b.first_word", "b.n_places")
