"""Licence scan by sentence rules.

A text is cut into sentences, each is normalised and looked up among known
licence sentences.  The identifiers found, in text order, are then matched
against ordered rules, longest first; a rule needs its sentences one after
another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Identifier -> licence sentence, as published with each licence.  Case, punctuation and
#: spacing don't matter (see ``normalise``).
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-work": "This work is licensed under the MIT License",
    "bsd-permit": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "apache-2": "Licensed under the Apache License, Version 2.0",
    "apache-2-the": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-2-comply": "you may not use this file except in compliance with the License",
    "apache-2-line": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "apache-2-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3-short": "Licensed under the GNU General Public License, version 3",
    "gpl-2-short": "Licensed under the GNU General Public License, version 2",
    "lgpl-3-short": "Licensed under the GNU Lesser General Public License, version 3",
    "agpl-3-short": "Licensed under the GNU Affero General Public License, version 3",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl-2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "cc0": "Licensed under CC0 1.0",
    "cc-by": "Licensed under CC BY 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-nd": "Licensed under CC BY-ND 4.0",
    "cc-by-nc-sa": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-nc-nd": "Licensed under CC BY-NC-ND 4.0",
}
#: Fixed values: (licence, sentence identifiers in order); longer rules win over those they contain.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-work",)),
    ("BSD-3-Clause", ("bsd-permit", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-permit", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-2-line", "apache-2-copy", "apache-2-as-is")),
    ("Apache-2.0", ("apache-2-the", "apache-2-comply", "apache-2-copy", "apache-2-as-is")),
    ("Apache-2.0", ("apache-2-line",)),
    ("Apache-2.0", ("apache-2-the",)),
    ("Apache-2.0", ("apache-2",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl-2-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl-2-free",)),
    ("GPL-3.0-only", ("gpl-3-work",)),
    ("GPL-3.0-only", ("gpl-3-short",)),
    ("GPL-2.0-only", ("gpl-2-short",)),
    ("LGPL-3.0-only", ("lgpl-3-short",)),
    ("AGPL-3.0-only", ("agpl-3-short",)),
    ("MPL-2.0", ("mpl-2", "mpl-2-copy")),
    ("MPL-2.0", ("mpl-2",)),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("cc0",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-ND-4.0", ("cc-by-nd",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd",)),
)

#: A sentence ends at a stop or mark followed by white space, and at an empty line; by lines, also at every line break.
WRAPPED = r"[.!?]\s+|\n\s*\n"
BY_LINE = r"[.!?]\s+|\n\s*"
_GAP = r"[^a-z0-9.]+|[.](?![a-z0-9])"
#: Not a sentence: nothing but marks, a number, the letter of a list item.
ITEM = r"^[^A-Za-z0-9]*[A-Za-z]?[^A-Za-z0-9]*$|^[^A-Za-z]*$"


def normalise(sentence: Column) -> Column:
    """Lower case; anything but ASCII letters, digits and inner stops becomes one space."""
    return F.trim(F.regexp_replace(F.lower(sentence), _GAP, " "))


def hints(sentences=SENTENCES) -> list[str]:
    """A few words of which every known sentence has one: each time the longest word of the first sentence without any."""
    chosen: list[str] = []
    for text in sorted(sentences.values()):
        plain = "".join(c if c.isascii() and c.isalpha() else " " for c in text.lower())
        if not any(h in plain for h in chosen):
            chosen.append(min(plain.split(), key=lambda w: (w not in ("license", "licensed", "software"), -len(w), w)))
    return [h for h in chosen if not any(o != h and o in h for o in chosen)]


def parts_of(text: Column, breaks: str) -> Column:
    return F.filter(F.split(text, breaks), lambda s: ~s.rlike(ITEM))


def identifiers(parts: Column, sentences=SENTENCES) -> Column:
    """Identifiers of sentences in order, null for each that isn't known."""
    entries = [F.struct(normalise(F.lit(t)), F.lit(sid)) for sid, t in sentences.items()]
    known = F.map_from_entries(F.array(*entries))
    return F.transform(parts, lambda s: F.try_element_at(known, normalise(s)))


def match(ids: Column, rules=RULES) -> Column:
    """array<struct<licence, n>>: the rules found in a sequence of identifiers, the longest tried first.

    A sentence serves one match; a sentence that isn't known keeps a rule from
    matching across it.
    """
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    table = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit("".join(f"<{i}>" for i in ids_)).alias("mark")) for name, ids_ in ordered])
    line = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), F.coalesce(i, F.lit("?")), F.lit(">"))), "")
    start = F.struct(line.alias("rest"), F.array().cast("array<struct<licence:string,n:bigint>>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        left = F.replace(state["rest"], rule["mark"], F.lit("<?>"))
        n = ((F.length(state["rest"]) - F.length(left)) / (F.length(rule["mark"]) - 3)).cast("bigint")
        here = F.struct(rule["licence"].alias("licence"), n.alias("n"))
        hit = F.contains(state["rest"], rule["mark"])
        return F.struct(
            F.when(hit, left).otherwise(state["rest"]).alias("rest"),
            F.when(hit, F.array_append(state["found"], here)).otherwise(state["found"]).alias("found"),
        )

    return F.aggregate(table, start, step, lambda state: state["found"])


def scan(documents: DataFrame, sentences=SENTENCES, rules=RULES) -> DataFrame:
    """One row per document: doc_id, n_sentences, n_known, sentence_ids, licenses, n_matches.

    The whole text is read twice: with every line break ending a sentence, and
    with lines joined, for licences wrapped over lines.  ``n_sentences`` counts
    the first reading.  ``sentence_ids`` are the known identifiers in text
    order, comma-joined, and ``n_matches`` the rule matches, of the reading
    that has more of them (the first if equal).  ``licenses`` are the licences
    of both readings, sorted, each once, comma-joined.

    Null and empty texts have no sentence and no licence.  Repeated rows and
    null ids are kept as they are (nothing is joined or grouped), further
    columns are ignored, an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    # A text without any word that a known sentence must have holds none; its sentences are only counted.
    may = F.lit(False)
    for word in hints(sentences):
        may = may | F.contains(low, F.lit(word))
    none = F.array().cast("array<string>")
    cut = documents.select("doc_id", text.alias("_text"), may.alias("_may"), parts_of(text, BY_LINE).alias("_parts"))
    read = cut.select(
        "doc_id", F.size("_parts").cast("bigint").alias("n_sentences"),
        F.when(F.col("_may"), identifiers(F.col("_parts"), sentences)).otherwise(none).alias("_lines"),
        F.when(F.col("_may"), identifiers(parts_of(F.col("_text"), WRAPPED), sentences)).otherwise(none).alias("_wrapped"),
    )
    found = read.select(
        "doc_id", "n_sentences",
        *[F.array_compact(c).alias(f"{c}_ids") for c in ("_lines", "_wrapped")],
        *[match(F.col(c), rules).alias(f"{c}_found") for c in ("_lines", "_wrapped")],
    )
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    lines, wrapped = total("_lines_found"), total("_wrapped_found")
    better = (wrapped > lines) | ((wrapped == lines) & (F.size("_wrapped_ids") > F.size("_lines_ids")))
    names = F.array_union(F.transform("_lines_found", lambda x: x["licence"]), F.transform("_wrapped_found", lambda x: x["licence"]))
    ids = F.when(better, F.col("_wrapped_ids")).otherwise(F.col("_lines_ids"))
    return found.select(
        "doc_id", "n_sentences", F.size(ids).cast("bigint").alias("n_known"), F.array_join(ids, ",").alias("sentence_ids"),
        F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("licenses"), F.greatest(lines, wrapped).alias("n_matches"),
    )
