"""License scan by MinHash bands over overlapping text windows, in DataFrame functions only.

A text is its 5-word shingles in order (fewer words are one shingle). Words are split at white space, case folded and
freed of all but letters, marks and digits at both ends; what is left empty, as comment signs, is no word. A window
of ``WINDOW`` shingles starts at every shingle of a text and of a template, and its minimum, one row, is a band. A text
and a template that share a band value are a candidate. Of a template of more than ``TINY`` shingles, of which a text
holds four fifths, ``WINDOW`` in a row are left whole wherever the others fell out, so both have a window of the very
same shingles and the template is retrieved with certainty; more minima of each window would add nothing but cost.
Candidates are then decided by exact containment of the template's shingles in the text's.

Templates of up to ``TINY`` shingles, and those shorter than a shingle, are sought in windows of one shingle (of their
own number of words, if that is less than five), whose minimum is the shingle itself: a text that holds four fifths
of so few holds at least one of any two, so both of the template's least shingles are bands.

There is no shuffle: the templates, a table or mapping of ``MOST_BYTES`` at most (checked), are literals. Null and
empty texts hold nothing; very long ones are scanned whole; texts are judged one by one, so repeated rows give
repeated results, and ids and ties need nothing special. An empty table gives no rows. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, WINDOW, TINY, MOST_BYTES = 5, 3, 5, 16 << 20
#: Names and notices of public licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}
#: Further passages of the same licenses.
PASSAGES = {
    "MIT-notice-clause": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "Apache-2.0-disclaimer": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-source-clause": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-binary-clause": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "GPL-disclaimer": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC-disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
}
#: Notices shorter than a shingle.
SHORT_NOTICES = {
    "All-rights-reserved": "All rights reserved.",
    "Apache-2.0-name": "Apache License, Version 2.0",
    "GPL-name": "GNU General Public License",
    "MPL-name": "Mozilla Public License",
    "MIT-name": "The MIT License",
} | {f"SPDX-{k}": f"SPDX-License-Identifier: {k}" for k in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "CC-BY-4.0", "CC-BY-NC-4.0")}


#: White space with the signs at its side, or those at a text's ends; possessive, so linear in long runs of signs.
_SIGN, _SPACE = "[^\\p{L}\\p{M}\\p{N}\\x20\\x09-\\x0D]", "[\\x20\\x09-\\x0D]"
_CUT = f"(?:(?<!{_SIGN}){_SIGN}++)?{_SPACE}++{_SIGN}*+|^{_SIGN}++|(?<!{_SIGN}){_SIGN}++$"


def _shingles(text: str) -> Column:
    """Hashes of a text's words in order."""
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(folded, _CUT), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(hashes: str, length: int) -> Column:
    """The combined hashes of a text's windows; it has that many words at least."""
    many = F.col(hashes)
    return F.transform(F.sequence(F.lit(1), F.size(hashes) - length + 1), lambda k: F.xxhash64(F.slice(many, k, length)))


def _combined(hashes: str) -> Column:
    n, many = F.size(hashes), F.col(hashes)
    return F.when(n >= SHINGLE, _windows(hashes, SHINGLE)).when(n > 0, F.array(F.xxhash64(many))).otherwise(F.array().cast("array<bigint>"))


def _lesser(a: Column, b: Column) -> Column:
    return F.least(a, b)  # passes over the null beyond a text's end


def _minima(shingles: str) -> Column:
    """The band values of all windows; those at the text's end are shorter."""
    least = F.col(shingles)
    for k in range(1, WINDOW):
        least = F.zip_with(least, F.slice(shingles, F.lit(k + 1), F.greatest(F.size(shingles) - k, F.lit(0))), _lesser)
    return least


def _template_bands(shingles: list[int]) -> set[int]:
    """The same values for a template's windows."""
    return {min(shingles[k : k + WINDOW]) for k in range(max(1, len(shingles) - WINDOW + 1))}


def _once(value: Column) -> Column:
    """The value as a generated column: the optimizer would copy a projected one into filters and lambdas above it
    and so compute it again for every element."""
    return F.explode(F.array(value))


def _longs(values: list[int]) -> Column:
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")


def _known(spark: SparkSession, templates: dict[str, str] | DataFrame) -> list:
    """Name, number of words and shingles in order of each template with a word."""
    if isinstance(templates, DataFrame):
        given = templates.select(F.col("name"), F.col("text"))
        if (given.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > MOST_BYTES:
            raise ValueError(f"templates of more than {MOST_BYTES} bytes; scan with parts of them")
    else:
        named = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(v).alias("text")) for k, v in templates.items()))
        given = spark.range(1, numPartitions=1).select(F.explode(named).alias("t")).select("t.*")
    hashed = given.select("name", _once(_shingles("text")).alias("h")).select("name", F.size("h").alias("n"), _once(_combined("h")).alias("s"))
    return hashed.where(F.size("s") > 0).collect()


def scan(df: DataFrame, templates: dict[str, str] | DataFrame = TEMPLATES, containment: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each text and template (name, text) found in it: id_col, license, template_shingles,
    shared_shingles. The containment is 0.8 at least, else small templates may be missed."""
    given = _known(df.sparkSession, templates)
    if not given:
        return df.limit(0).select(F.col(id_col).cast("long").alias(id_col), F.lit("").alias("license"), F.lit(0).alias("template_shingles"), F.lit(0).alias("shared_shingles"))
    small = lambda t: t.n < SHINGLE or len(set(t.s)) <= TINY
    least_two = lambda t: sorted(set(t.s))[:2]
    bands, windows = set(), {}
    for t in given:
        if small(t):
            windows.setdefault(min(t.n, SHINGLE), set()).update(least_two(t))
        else:
            bands |= _template_bands(t.s)
    # The text's values become the hash set, and the literals are passed over.
    known = F.array(*(F.struct(F.lit(t.name).alias("name"), _longs(sorted(set(t.s))).alias("s"), _longs(sorted(least_two(t) if small(t) else _template_bands(t.s))).alias("bands")) for t in given))
    none = F.array().cast("array<bigint>")
    short = sorted(n for n in windows if n < SHINGLE)
    brief = [F.when(F.size("h") >= n, F.array_intersect(_longs(sorted({x for t in given if t.n == n for x in t.s})), _windows("h", n))).otherwise(none) for n in short]
    rows = df.select(F.col(id_col).cast("long").alias(id_col), _once(_shingles(text_col)).alias("h"))
    rows = rows.select(id_col, (_once(F.concat(*brief)) if brief else none).alias("brief"), _once(_combined("h")).alias("s"))
    ones = F.array_intersect(_longs(sorted(windows.get(SHINGLE, ()))), "s")
    rows = rows.select(id_col, "s", "brief", _once(F.concat("brief", ones, F.array_intersect(_longs(sorted(bands)), _minima("s")))).alias("hits")).where(F.size("hits") > 0)
    rows = rows.select(id_col, "s", "brief", F.explode(F.filter(known, lambda t: F.arrays_overlap(t.bands, F.col("hits")))).alias("t"))
    rows = rows.select(id_col, F.col("t.name").alias("license"), F.size("t.s").alias("template_shingles"), F.size(F.array_intersect("t.s", F.concat("s", "brief"))).alias("shared_shingles"))
    return rows.where(F.col("shared_shingles") >= containment * F.col("template_shingles") - 1e-9)


def oracle(templates: dict[str, str] = TEMPLATES) -> str:
    """Plain SQL for the same result: every text's shingles against every template's, of as many words as the
    template has if these are fewer than five."""
    values = ", ".join(f"('{k}', '" + v.replace("'", "''") + "')" for k, v in templates.items())
    sign = "[^\\p{L}\\p{M}\\p{N}]+"
    split = "regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+')".format
    cut = lambda c: f"list_filter(list_transform({split(c)}, lambda w: regexp_replace(w, '^{sign}|{sign}$', '', 'g')), lambda w: w <> '')"
    grams = "list_distinct(list_transform(generate_series(1, len(w) - {0} + 1), lambda i: array_to_string(w[i:i + {0} - 1], ' ')))".format
    return f"""
WITH tw AS (SELECT name, {cut('text')} AS w FROM (VALUES {values}) v(name, text)),
tg AS (SELECT name, least(len(w), {SHINGLE}) AS k, {grams(f'least(len(w), {SHINGLE})')} AS g FROM tw),
t AS (SELECT name, k, len(g) AS n, unnest(g) AS g FROM tg),
dw AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, {cut("coalesce(text, '')")} AS w FROM documents),
dg AS (SELECT d, doc_id, k, unnest({grams('k')}) AS g FROM dw, (SELECT DISTINCT k FROM t) WHERE len(w) >= k)
SELECT doc_id, name AS license, CAST(n AS INTEGER) AS template_shingles, CAST(count(*) AS INTEGER) AS shared_shingles
FROM dg JOIN t USING (k, g) GROUP BY d, doc_id, name, n HAVING count(*) >= 0.8 * n - 1e-9
"""


#: All that op7 seeks.
ALL = TEMPLATES | PASSAGES | SHORT_NOTICES
