"""License notices by min-hash bands over overlapping windows, verified by exact containment.

Templates are grouped by how many shingles of ``SHINGLE`` words they have (1, 2, 3-4, 5-8, ...). For a group whose largest
has m shingles, texts are read in windows of m + m // 2 shingles that start every m // 2, so that every stretch of m lies
whole in a window. A window retrieves the templates with which it shares one of ``BANDS`` bands of ``ROWS`` min-hashes. A
window that holds ``CONTAINMENT`` of a template has a Jaccard similarity to it of at least about 0.27, so that it is missed
with a probability below 0.73 ** 64, about 2e-9. A retrieved template matches if the share of its distinct shingles that the
window has, counted exactly, reaches ``CONTAINMENT``.

A band can only be equal if a shingle is, so windows and texts that have no shingle of any template are left before
min-hashing; that changes no result. Templates are configuration: they are handled in blocks of ``BLOCK``, each a literal of
bounded size. Everything is an expression over the row at hand: no shuffle, no join, and copies cost what other rows cost.

Defined cases: null, empty and shorter texts match nothing; an empty table gives no rows; templates shorter than a shingle
are refused; equal texts get equal matches; other columns pass through.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.llm import common

SHINGLE, BANDS, ROWS, CONTAINMENT = 5, 64, 1, 0.8
BLOCK = 200
BETWEEN = r"[\x00-/:-`{-\x7f]+"

#: Notices, headers and short licence texts as they are published. A licence has an entry for each usual wording.
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-header-full": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-released": "Released under the Apache License 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA-3.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "CC0-1.0-waived": "has waived all copyright and related or neighboring rights to this work",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "EUPL-1.2": "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL",
    "GPL-2.0": "This program is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-header": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "Zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def shingles(w: Column, size: int) -> Column:
    """Hashes of the shingles of an array of words, in order."""
    n = F.size(w)
    one = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size)))
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), one)).otherwise(F.expr("cast(array() as array<bigint>)"))


def bands(window: Column, n: int, rows: int) -> Column:
    """Band keys of a window: hashes of ``rows`` min-hashes each."""
    seeds = F.array(*map(F.lit, range(n)))
    least = lambda seed: F.array_min(F.transform(window, lambda h: F.xxhash64(h, seed)))
    return F.transform(seeds, lambda b: F.xxhash64(b, *(least(b * rows + r) for r in range(rows))))


@functools.cache
def _prepared(spark: SparkSession, templates: tuple[tuple[str, str], ...], size: int, n: int, rows: int) -> list[tuple[str, list[int], list[int]]]:
    """Name, distinct shingles and band keys of each template, by the same expressions as texts'."""
    table = spark.createDataFrame(list(templates), "name string, text string").withColumn("w", words(F.col("text"))).select("name", F.array_distinct(shingles(F.col("w"), size)).alias("s"))
    got = [(r["name"], r["s"], r["b"]) for r in table.withColumn("b", F.when(F.size("s") > 0, bands(F.col("s"), n, rows))).collect()]
    if short := [name for name, s, _ in got if not s]:
        raise ValueError(f"templates shorter than {size} words: {short}")
    return got


def group(n: int) -> int:
    """The largest number of shingles in the group of a template that has n."""
    return 1 << (n - 1).bit_length()


def matches(shingled: Column, found: list[tuple[str, list[int], list[int]]], containment: float, n: int, rows: int) -> Column:
    """array<struct<license,containment,start,end>>: matches of one block of templates, in word positions."""
    longs = lambda values: F.expr(f"array({', '.join(f'cast({v} as bigint)' for v in values)})")
    def of_group(most: int) -> Column:
        own = [t for t in found if group(len(t[1])) == most]
        step = max(1, most // 2)
        width = most + step
        every = longs(sorted({h for _, s, _ in own for h in s}))
        known = F.array(*(F.struct(F.lit(name).alias("license"), longs(s).alias("s"), longs(b).alias("b")) for name, s, b in own))
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(shingled) - most), F.lit(step))
        windows = F.transform(starts, lambda i: F.struct(i.alias("start"), F.slice(shingled, i + 1, F.lit(width)).alias("s")))
        windows = F.filter(windows, lambda w: F.arrays_overlap(w["s"], every))
        banded = F.transform(windows, lambda w: F.struct(w["start"].alias("start"), w["s"].alias("s"), bands(w["s"], n, rows).alias("b")))

        def verified(w: Column) -> Column:
            got = F.filter(known, lambda t: F.arrays_overlap(w["b"], t["b"]))
            share = lambda t: F.size(F.array_intersect(w["s"], t["s"])) / F.size(t["s"]).cast("double")
            scored = F.transform(got, lambda t: F.struct(t["license"].alias("license"), share(t).alias("containment"), w["start"].alias("start"), (w["start"] + F.size(w["s"]) + (SHINGLE - 1)).alias("end")))
            return F.filter(scored, lambda m: m["containment"] >= containment)

        return F.flatten(F.transform(banded, verified))

    parts = [of_group(most) for most in sorted({group(len(s)) for _, s, _ in found})]
    return F.concat(*parts)


def scan(
    docs: DataFrame, *, text_col: str = "text", templates: dict[str, str] | None = None, containment: float = CONTAINMENT, n: int = BANDS, rows: int = ROWS, prefix: str = "",
) -> DataFrame:
    """``docs`` with license_matches: array<struct<license,containment,start,end>>, where each license matches best (first window on ties)."""
    name = prefix + "license_matches"
    out = common.without(docs, [name])
    prepared = _prepared(docs.sparkSession, tuple(sorted((TEMPLATES if templates is None else templates).items())), SHINGLE, n, rows)
    split, own = common.fresh(out, "words"), common.fresh(out, "shingles")
    out = out.withColumn(split, words(F.col(text_col))).withColumn(own, shingles(F.col(split), SHINGLE)).drop(split)
    none = F.expr("cast(array() as array<struct<license:string,containment:double,start:int,end:int>>)")
    found = none
    for at in range(0, len(prepared), BLOCK):
        block = prepared[at : at + BLOCK]
        every = F.expr(f"array({', '.join(f'cast({h} as bigint)' for h in sorted({h for _, s, _ in block for h in s}))})")
        found = F.concat(found, F.when(F.arrays_overlap(own, every), matches(F.col(own), block, containment, n, rows)).otherwise(none))
    ordered = F.array_sort(F.transform(found, lambda m: F.struct(m["license"], (-m["containment"]).alias("less"), m["start"], m["end"])))
    out = out.withColumn(name, ordered).drop(own)
    best = F.filter(name, lambda m, i: (i == 0) | (F.get(F.col(name), i - 1)["license"] != m["license"]))
    return out.withColumn(name, F.transform(best, lambda m: F.struct(m["license"], (-m["less"]).alias("containment"), m["start"], m["end"])))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all templates."""
    found = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("license_matches").cast("long").alias("n_licenses"), F.array_join(F.transform("license_matches", lambda m: m["license"]), ",").alias("licenses"),
        F.array_join(F.transform("license_matches", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",").alias("spans"),
        F.coalesce(F.array_max(F.transform("license_matches", lambda m: m["containment"])), F.lit(0.0)).alias("containment"),
    )


def _split(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[\\x00-/:-`{{-\\x7f]+'), lambda x: x <> '')"


ORACLE = f"""
with t as (select name, {_split("text")} w from (values {", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in TEMPLATES.items())}) v(name, text)),
ts as (select distinct name, array_to_string(w[i : i + 4], ' ') s from (select name, w, unnest(range(1, len(w) - 3)) i from t)),
tn as (select name, count(*) n, cast(pow(2, ceil(log2(count(*)))) as bigint) most from ts group by name),
d as (select row_number() over () r, doc_id, {_split("text")} w from documents),
ds as (select r, i - 1 i, array_to_string(w[i : i + 4], ' ') s from (select r, w, unnest(range(1, len(w) - 3)) i from d where len(w) >= 5)),
size as (select r, len(w) - 4 n from d),
hit as (select ds.r, ds.i, ts.name, ts.s, tn.n, tn.most, greatest(1, tn.most // 2) step from ds join ts using (s) join tn using (name)),
win as (select distinct r, name, s, hit.n, most, step, k * step as start from (select *, unnest(range(greatest(0, (i - most - step + step) // step), i // step + 1)) k from hit) hit join size z using (r)
  where k * step <= greatest(0, z.n - 1 - (most - 1)) and i >= k * step and i < k * step + most + step),
c as (select r, name, start, most + step width, count(*) / n::double containment from win group by r, name, start, most, step, n having count(*) / n::double >= {CONTAINMENT}),
b as (select r, name, containment, start, least(start + width, z.n) + 4 as e from c join size z using (r) qualify row_number() over (partition by r, name order by containment desc, start) = 1)
select doc_id, cast(count(name) as bigint) n_licenses, coalesce(string_agg(name, ',' order by name), '') licenses, coalesce(string_agg(start::varchar || '-' || e::varchar, ',' order by name), '') spans, coalesce(max(containment), 0.0::double) containment
from d left join b using (r) group by r, doc_id
"""
