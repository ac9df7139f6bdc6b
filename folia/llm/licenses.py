"""Operator 2, licence scans: sparse TF-IDF cosine to templates, inheritance from directories.

Compared is whatever could match a template: sentences of single lines, paragraphs with their lines
joined and the sentences of these (headers, wrapped or not), and the text as a whole (licence file).
A line without letters and digits, such as an empty comment line, ends a paragraph. Term weights are
(1 + ln tf) x idf with idf over TEMPLATES; function words are no terms; terms that TEMPLATES don't
have get the greatest idf, so prose lowers the cosine. A match shares two terms at least: a name alone
is no notice. NOTICES are further templates, the complete
paragraphs of headers, weighed by the same idf. The vectors are rows (segment, term), joined with the templates'
rows, a table of constant size.

These units are filtered before that without loss. A template's cosine with a text is at most the norm
of its weights for the terms they share. Each template contributes so many of its heaviest terms
that its other weights and the heaviest stay below the threshold together: a unit with fewer than
two of these anchors can't match any template. Nor can one with many other words: with c occurrences
of templates' terms and d distinct terms that no template has, the cosine's square is at most
1.4716 c / (1.4716 c + d), because (1 + ln tf)^2 <= (4 / e) tf and no term's idf exceeds that of the d.

A document is a licence file if it matches as a whole, or matches at all and is named like one. Each
directory's licence is that of its best licence file; every directory then takes the licence of its
nearest ancestor that has one, by an equi-join on ancestor paths of distinct directories. Of several
licences in a document the best match counts, but those of GIVE_WAY after all others: a copyright line's
"All rights reserved" doesn't outweigh the licence below it.

Edge cases: null or empty text has no licence of its own; null path inherits nothing; of equal
cosines the first template by name wins; very long texts are compared whole and in all their parts;
repeated rows are judged each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.common import cut, lookup, table

THRESHOLD = 0.75
TOKEN = r"[\p{L}0-9]+(?:\.[0-9]+)*"
SENTENCE = r"\n|(?<=[.!?;])\s+"
#: Between paragraphs: lines without letters and digits. Words that begin comment lines in some languages.
PARAGRAPH, COMMENT_WORD = r"\n(?:[^\p{L}0-9\n]*\n)+", r"(?m)^[ \t]*(?:dnl|REM)\b"
FILE_NAME = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense)(?:[.-][^/]*)?$"

# What stands beside more specific licences and is part of them; the last gives way to all.
GIVE_WAY = ("BSD-2-Clause", "All-Rights-Reserved")

# Words that are no terms.
FUNCTION_WORDS = ("a", "all", "an", "and", "any", "are", "as", "at", "be", "by", "can", "for", "from", "has", "in", "into", "is", "it", "may", "met", "not", "of", "on", "or", "that", "the", "this", "to", "under", "with", "you")

# Notices as their licences word them.
TEMPLATES = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("All-Rights-Reserved", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_NO_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"

_PROMOTION = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."

# Complete paragraphs of the usual headers, titles of complete texts.
NOTICES = (
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-3-Clause", _PROMOTION),
    *((name, text.format(title, version)) for name, title, version in (("AGPL-3.0", "Affero General Public License", 3), ("GPL-2.0", "General Public License", 2), ("GPL-3.0", "General Public License", 3), ("LGPL-3.0", "Lesser General Public License", 3)) for text in (_GNU, f"{_GNU} {_NO_WARRANTY}")),
    ("Apache-2.0", _APACHE),
    ("BSD-2-Clause", _REDISTRIBUTION),
    ("BSD-3-Clause", f"{_REDISTRIBUTION} 3. {_PROMOTION}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)


def terms(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda w: ~w.isin(*FUNCTION_WORDS))


class Library:
    """The templates' weights: (name, number, term, weight), norms to 1; idf of known terms. Rows of
    templates come first; `all_rows` also has those of the notices."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, notices: tuple[tuple[str, str], ...] = NOTICES):
        found = [Counter(w for w in re.findall(r"[^\W_]+(?:\.[0-9]+)*", t.lower()) if w not in FUNCTION_WORDS) for _, t in (*templates, *notices)]
        have = Counter(w for f in found[: len(templates)] for w in f)
        self.most = math.log(1 + len(templates)) + 1
        self.idf = {w: math.log((1 + len(templates)) / (1 + n)) + 1 for w, n in have.items()}
        self.all_rows, anchors = [], set()
        for i, ((name, _), f) in enumerate(zip((*templates, *notices), found, strict=True)):
            weight = {w: (1 + math.log(n)) * self.idf.get(w, self.most) for w, n in f.items()}
            norm = math.sqrt(sum(v * v for v in weight.values()))
            rest, most = 1.0, (max(weight.values()) / norm) ** 2
            for w, v in sorted(weight.items(), key=lambda x: (-x[1], x[0])):
                self.all_rows.append((name, i, w, v / norm))
                if rest + most >= 0.99 * threshold**2:
                    anchors.add(w)
                    rest -= (v / norm) ** 2
        self.terms = sorted({w for f in found for w in f})
        self.rows = [r for r in self.all_rows if r[1] < len(templates)]
        self.threshold = threshold
        self.anchors = rf"(?iu)(?<![\p{{L}}0-9])(?:{'|'.join(re.escape(w) for w in sorted(anchors))})(?![\p{{L}}0-9])"


def matches(docs: DataFrame, library: Library, text: str = "text") -> DataFrame:
    """docs without text, with licence, score, licences (all that pass), whole (matches as a whole)."""
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c != text]
    near = lambda s: F.regexp_count(s, F.lit(library.anchors)) >= 2
    sentences = lambda s: F.filter(F.split(s, SENTENCE), near)
    paragraphs = F.filter(F.split(F.regexp_replace(F.col(text), COMMENT_WORD, ""), PARAGRAPH), near)
    joined = F.transform(paragraphs, lambda p: F.regexp_replace(p, r"\n[^\p{L}0-9]*", " "))
    units = F.concat(sentences(F.col(text)), F.flatten(F.transform("_joined", sentences)), "_joined")
    x = docs.withColumn("_row", F.monotonically_increasing_id()).withColumn("_near", F.coalesce(near(F.col(text)), F.lit(False)))
    x = x.withColumn("_joined", F.when(F.col("_near"), joined))
    # Most texts with anchors are prose: the bound drops them before anything is written.
    known, room = F.array(*[F.lit(w) for w in library.terms]), 4 / math.e * (1 / (0.99 * library.threshold**2) - 1)
    some = lambda w: F.size(F.array_except(w, known)) <= room * F.size(F.filter(w, lambda t: t.isin(*library.terms)))
    part = lambda p, whole: F.struct(p.alias("part"), F.lit(whole).alias("whole"), terms(p).alias("terms"))
    every = F.concat(F.transform(F.array_distinct(units), lambda p: part(p, False)), F.array(part(F.col(text), True)))
    parts = F.when(F.col("_near"), F.transform(F.filter(every, lambda p: some(p["terms"])), lambda p: F.struct(p["part"].alias("part"), p["whole"].alias("whole"))))
    cut_up = cut(x.select("_row", *keep, parts.alias("_parts")), "licences")
    segments = cut_up.where(F.size("_parts") > 0).select("_row", F.posexplode("_parts").alias("seg", "p"))
    tf = segments.select("_row", "seg", "p.whole", F.explode(terms(F.col("p.part"))).alias("term")).groupBy("_row", "seg", "whole", "term").agg(F.count("*").alias("tf"))
    # Constant size: the terms of the templates.
    idf = F.broadcast(spark.createDataFrame(sorted(library.idf.items()), "term string, idf double"))
    weights = F.broadcast(spark.createDataFrame(library.all_rows, "licence string, number int, term string, weight double"))
    weighed = tf.join(idf, "term", "left").select("_row", "seg", "whole", "term", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(library.most))).alias("w"))
    norms = weighed.groupBy("_row", "seg", "whole").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(weights, "term").groupBy("_row", "seg", "licence", "number").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"), F.count("*").alias("shared")).where(F.col("shared") >= 2)
    # A sentence's licence is its best template; a document may have several sentences.
    best = dots.join(norms, ["_row", "seg"]).groupBy("_row", "seg", "whole").agg(F.min(F.struct((-F.round(F.col("dot") / F.col("norm"), 6)).alias("s"), "licence")).alias("b"))
    best = best.select("_row", "whole", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score")).where(F.col("score") >= library.threshold)
    way = F.array_position(F.array(*map(F.lit, GIVE_WAY)), F.col("licence")).alias("way")
    per = best.groupBy("_row").agg(F.min(F.struct(way, (-F.col("score")).alias("s"), F.col("licence").alias("l"))).alias("m"), F.sort_array(F.collect_set("licence")).alias("licences"), F.max("whole").alias("whole"))
    out = cut_up.drop("_parts").join(per, "_row", "left")
    return out.select(*keep, F.col("m.l").alias("licence"), (-F.col("m.s")).alias("score"), F.coalesce("licences", F.array().cast("array<string>")).alias("licences"), F.coalesce("whole", F.lit(False)).alias("whole"))


def inherit(found: DataFrame, path: str = "path") -> DataFrame:
    """found with inherited and inherited_from: licence and directory of the nearest ancestor."""
    folder = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).when(F.col(path).isNotNull(), F.lit(""))
    x = found.withColumn("_dir", folder)
    files = x.where(F.col("licence").isNotNull() & F.col("_dir").isNotNull() & (F.col("whole") | F.col(path).rlike(FILE_NAME)))
    way = F.array_position(F.array(*map(F.lit, GIVE_WAY)), F.col("licence")).alias("way")
    owned = files.groupBy(F.col("_dir").alias("up")).agg(F.min(F.struct(way, (-F.col("score")).alias("s"), F.col("licence").alias("l"))).alias("m")).select("up", F.col("m.l").alias("l"))
    dirs = x.where(F.col("_dir").isNotNull()).select("_dir").distinct()
    parts = F.split("_dir", "/")
    ups = dirs.select("_dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("up")))).alias("u"))
    nearest = lookup(ups.select("_dir", "u.depth", "u.up"), owned, "up", "owned").groupBy("_dir").agg(F.max(F.struct("depth", "up", "l")).alias("n"))
    nearest = nearest.select("_dir", F.col("n.l").alias("inherited"), F.col("n.up").alias("inherited_from"))
    return lookup(x, nearest, "_dir", "directories", "left").drop("_dir")


def scan(docs: DataFrame, library: Library | None = None, text: str = "text", path: str = "path") -> DataFrame:
    """docs (with a path) without text: own licence and score, all licences, inherited licence.
    Columns of these names are replaced."""
    docs = docs.drop("licence", "score", "licences", "whole", "inherited", "inherited_from")
    return inherit(matches(docs, library or Library(), text), path)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.lit("corpus"), "source", F.concat(F.lit("doc-"), "doc_id", F.lit(".txt")))
    out = scan(docs.select("doc_id", path.alias("path"), "text"))
    return out.select("doc_id", "path", "licence", "score", F.array_join("licences", ",").alias("licences"), "inherited", F.coalesce("licence", "inherited").alias("effective"))


def oracle(library: Library | None = None) -> str:
    """SQL for op2_licenses: all units of all documents, without any filter before the cosine. The
    templates' weights are a literal table."""
    library = library or Library()
    weights = ", ".join(f"('{n}', {i}, '{w}', {v!r})" for n, i, w, v in library.all_rows)
    idf = ", ".join(f"('{w}', {v!r})" for w, v in sorted(library.idf.items()))
    stop = ", ".join(f"'{w}'" for w in FUNCTION_WORDS)
    way = " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(GIVE_WAY, 1))
    split = lambda t: rf"string_split(regexp_replace({t}, '([.!?;])\s+', '\1' || chr(10), 'g'), chr(10))"
    return rf"""
WITH weights(licence, number, term, weight) AS (VALUES {weights}), idf(term, idf) AS (VALUES {idf}),
t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, regexp_replace(unnest(regexp_split_to_array(regexp_replace(t, '(?m)^[ \t]*(?:dnl|REM)\b', '', 'g'), '\n(?:[^\p{{L}}0-9\n]*\n)+')), '\n[^\p{{L}}0-9]*', ' ', 'g') AS part FROM t),
unit AS (SELECT doc_id, FALSE AS whole, unnest({split('t')}) AS part FROM t UNION SELECT doc_id, FALSE, unnest({split('part')}) FROM p UNION SELECT doc_id, FALSE, part FROM p UNION SELECT doc_id, TRUE, t FROM t),
seg AS (SELECT *, row_number() OVER () AS seg FROM unit),
tok AS (SELECT seg, unnest(list_filter(regexp_extract_all(lower(part), '[\p{{L}}0-9]+(?:\.[0-9]+)*'), lambda w: w NOT IN ({stop}))) AS term FROM seg),
tf AS (SELECT seg, term, count(*) AS n FROM tok GROUP BY 1, 2),
w AS (SELECT seg, tf.term, (1 + ln(n)) * coalesce(idf, {library.most!r}) AS w FROM tf LEFT JOIN idf ON tf.term = idf.term),
norm AS (SELECT seg, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
dot AS (SELECT seg, licence, number, sum(w * weight) AS d FROM w JOIN weights ON w.term = weights.term GROUP BY 1, 2, 3 HAVING count(*) >= 2),
hit AS (SELECT dot.seg, licence, round(d / norm, 6) AS score, row_number() OVER (PARTITION BY dot.seg ORDER BY round(d / norm, 6) DESC, licence) AS r FROM dot JOIN norm ON dot.seg = norm.seg),
best AS (SELECT doc_id, whole, licence, score, CASE licence {way} ELSE 0 END AS way FROM hit JOIN seg ON hit.seg = seg.seg WHERE r = 1 AND score >= {library.threshold}),
per AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT licence)), ',') AS licences, bool_or(whole) AS whole FROM best GROUP BY doc_id),
top AS (SELECT doc_id, licence, score, way FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY way, score DESC, licence) AS q FROM best) WHERE q = 1),
owned AS (SELECT source, licence FROM (SELECT source, top.licence, row_number() OVER (PARTITION BY source ORDER BY way, score DESC, top.licence) AS q FROM documents JOIN top ON documents.doc_id = top.doc_id JOIN per ON per.doc_id = top.doc_id WHERE whole) WHERE q = 1)
SELECT documents.doc_id, 'corpus/' || documents.source || '/doc-' || CAST(documents.doc_id AS VARCHAR) || '.txt' AS path, top.licence, score, coalesce(licences, '') AS licences, owned.licence AS inherited, coalesce(top.licence, owned.licence) AS effective
FROM documents LEFT JOIN top ON documents.doc_id = top.doc_id LEFT JOIN per ON documents.doc_id = per.doc_id LEFT JOIN owned ON documents.source = owned.source
"""
