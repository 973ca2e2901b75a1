"""Licence scans: known sentences of a text become identifiers, ordered rules turn runs of identifiers into licences."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of licences, as they read when normalised, and their identifiers.
SENTENCES = {
    "all rights reserved": "AllRightsReserved",
    "copyright": "Copyright",
    "apache license": "ApacheTitle",
    "licensed under the apache license version 2 0": "ApacheRef",
    "licensed under the apache license version 2 0 the license": "ApacheRef",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at": "ApacheCopy",
    "http www apache org licenses license 2 0": "ApacheUrl",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheWarranty",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "released under the mit license": "MITRef",
    "licensed under the mit license": "MITRef",
    "mit license": "MITTitle",
    "the mit license": "MITTitle",
    "the mit license mit": "MITTitle",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MITWarranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MITLiability",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDBinary",
    "neither the name of may be used to endorse or promote products derived from this software without specific prior written permission": "BSDEndorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSDWarranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCGrant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISCWarranty",
    "this work is licensed under the gnu general public license version 3": "GPL3Ref",
    "this work is licensed under the gnu general public license version 2": "GPL2Ref",
    "gnu general public license": "GPLTitle",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3Later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2Later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPLWarranty",
    "see the gnu general public license for more details": "GPLSee",
    "you should have received a copy of the gnu general public license along with this program": "GPLCopy",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "LGPL21Later",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2Ref",
    "this is free and unencumbered software released into the public domain": "UnlicenseGrant",
    "licensed under cc by 4 0": "CCBY4Ref",
    "licensed under cc by sa 4 0": "CCBYSA4Ref",
    "licensed under cc by nc 4 0": "CCBYNC4Ref",
    "licensed under cc by nd 4 0": "CCBYND4Ref",
    "licensed under cc by nc sa 4 0": "CCBYNCSA4Ref",
    "licensed under cc by nc nd 4 0": "CCBYNCND4Ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "CCBY4Ref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CCBYSA4Ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CCBYNC4Ref",
    "spdx license identifier mit": "MITRef",
    "spdx license identifier apache 2 0": "ApacheRef",
    "spdx license identifier gpl 3 0 only": "GPL3Ref",
    "spdx license identifier bsd 3 clause": "BSD3Ref",
}
# Licences and the run of identifiers that is one; the first rule that fits takes its identifiers.
RULES = [
    ("Apache-2.0", ["ApacheRef", "ApacheComply", "ApacheCopy", "ApacheUrl", "ApacheWarranty", "ApacheSee"]),
    ("Apache-2.0", ["ApacheRef", "ApacheComply", "ApacheCopy", "ApacheWarranty", "ApacheSee"]),
    ("MIT", ["MITGrant", "MITNotice", "MITWarranty", "MITLiability"]),
    ("BSD-3-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse", "BSDWarranty"]),
    ("BSD-2-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDWarranty"]),
    ("GPL-3.0-or-later", ["GPL3Later", "GPLWarranty", "GPLSee", "GPLCopy"]),
    ("GPL-2.0-or-later", ["GPL2Later", "GPLWarranty", "GPLSee", "GPLCopy"]),
    ("ISC", ["ISCGrant", "ISCWarranty"]),
    ("MIT", ["MITGrant", "MITNotice"]),
    ("GPL-3.0-or-later", ["GPL3Later"]),
    ("GPL-2.0-or-later", ["GPL2Later"]),
    ("LGPL-2.1-or-later", ["LGPL21Later"]),
    ("MPL-2.0", ["MPL2Ref"]),
    ("Unlicense", ["UnlicenseGrant"]),
    ("Apache-2.0", ["ApacheRef"]),
    ("MIT", ["MITRef"]),
    ("BSD-3-Clause", ["BSD3Ref"]),
    ("GPL-3.0-only", ["GPL3Ref"]),
    ("GPL-2.0-only", ["GPL2Ref"]),
    ("CC-BY-4.0", ["CCBY4Ref"]),
    ("CC-BY-SA-4.0", ["CCBYSA4Ref"]),
    ("CC-BY-NC-4.0", ["CCBYNC4Ref"]),
    ("CC-BY-ND-4.0", ["CCBYND4Ref"]),
    ("CC-BY-NC-SA-4.0", ["CCBYNCSA4Ref"]),
    ("CC-BY-NC-ND-4.0", ["CCBYNCND4Ref"]),
    ("Proprietary", ["AllRightsReserved"]),
]
# How a text is cut and normalised, for Spark and for SQL alike: pattern and what it is replaced with.
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
CUTS = [(r"[ \t\r]*\n[ \t]*([a-z])", r" \1"),  # a line that goes on in lower case is wrapped
        (r"([.!?])[ \t\r]+", "\\1\n")]
NORMS = [(r"[^a-z0-9]+", " "), (r"^ | $", ""), (r"^copyright .*$", "copyright"),
         (r"^(neither the name of) .* (may be used to endorse)", r"\1 \2"), (r"^[0-9a-z] (redistributions) ", r"\1 ")]
# Sentences that say what several of SENTENCES say, as notices are published, and their identifiers.
VARIANTS = {
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": ["ApacheRef", "ApacheComply"],
    "you may obtain a copy of the license at http www apache org licenses license 2 0": ["ApacheCopy", "ApacheUrl"],
}
TAIL = (r"^(you should have received a copy of the gnu general public license along with this program) if not .*$", r"\1")
OPEN_NAME = "neither the name of"  # any name may follow


def anchors(sentences: dict[str, str]) -> list[str]:
    """Few words of which every known sentence has one; texts without them need not be cut."""
    open_ones, out = [set(s.split()) for s in sentences], []
    while open_ones:
        words = sorted({w for s in open_ones for w in s if len(w) > 4} or {w for s in open_ones for w in s})
        best = max(words, key=lambda w: (sum(w in s for s in open_ones), len(w)))
        out.append(best)
        open_ones = [s for s in open_ones if best not in s]
    return out


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _replaced(c: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by.replace("\\1", "$1").replace("\\2", "$2"))
    return c


def _let(c: Column, then) -> Column:
    return F.element_at(F.transform(F.array(c), then), 1)


def _identifiers(pieces: Column, sentences: dict[str, str]) -> Column:
    """Identifiers of known sentences in order: single pieces, and runs of pieces that are wrapped sentences.

    Walks over the pieces with the runs that can still become a known sentence; one that does takes the place of what its
    pieces were by themselves.
    """
    table = {s: [i] for s, i in sentences.items()} | {s: i for s, i in VARIANTS.items() if set(i) <= set(sentences.values())}
    known = F.create_map(*[x for s, i in table.items() for x in (F.lit(s), F.array(*map(F.lit, i)))])
    texts = F.array(*map(F.lit, table))
    names = any(s.startswith(OPEN_NAME) for s in table)
    wild = lambda c: F.startswith(c, F.lit(f"{OPEN_NAME} ")) & F.lit(names)
    goes_on = lambda c: wild(c) | F.exists(texts, lambda s: F.startswith(s, F.concat(c, F.lit(" "))))
    # Of a sentence with a name only the end matters: all that follows the name is within its last 200 characters.
    short = lambda c: F.when(wild(c) & (F.length(c) > 400), F.concat(F.lit(f"{OPEN_NAME} "), F.right(c, F.lit(200)))).otherwise(c)
    whole = lambda c: known[_replaced(c, [NORMS[3], TAIL])]

    def looked_up(raw):
        first = _replaced(raw, [NORMS[4]])
        return F.struct(raw.alias("raw"), first.alias("first"), whole(first).alias("whole"),
                        F.coalesce(known[_replaced(raw, NORMS[2:])], whole(first)).alias("ids"), goes_on(first).alias("goes_on"))

    none = F.array().cast("array<struct<text:string,at:int>>")

    def step(state, x):
        ids, runs = state["ids"], state["runs"]
        named = x["whole"].isNotNull() | F.startswith(x["raw"], F.lit(OPEN_NAME))  # a name does not reach over these
        longer = F.transform(F.filter(runs, lambda r: ~(named & wild(r["text"]))),
                             lambda r: F.struct(short(F.concat(r["text"], F.lit(" "), x["raw"])).alias("text"), r["at"].alias("at")))

        def grown(longer):
            hit = F.array_position(F.transform(longer, lambda r: whole(r["text"]).isNotNull()), True).cast("int")  # the longest
            new = F.struct(x["first"].alias("text"), F.size(ids).alias("at"))
            left = lambda rs: F.filter(rs, lambda r: goes_on(r["text"]))
            alone = F.struct(F.when(x["ids"].isNotNull(), F.concat(ids, x["ids"])).otherwise(ids).alias("ids"),
                             F.when(x["goes_on"], F.array_append(left(longer), new)).otherwise(left(longer)).alias("runs"))
            run = _let(F.get(longer, hit - 1), lambda r: F.struct(
                F.concat(F.slice(ids, F.lit(1), r["at"]), whole(r["text"])).alias("ids"), left(F.slice(longer, F.lit(1), hit)).alias("runs")))
            return F.when(hit > 0, run).otherwise(alone)

        idle = (F.size(runs) == 0) & x["ids"].isNull() & ~x["goes_on"]
        return F.when(idle, state).when(x["raw"] == "", F.struct(ids.alias("ids"), none.alias("runs"))).otherwise(_let(longer, grown))

    start = F.struct(F.array().cast("array<string>").alias("ids"), none.alias("runs"))
    raws = F.transform(pieces, lambda p: _replaced(_lower(p), NORMS[:2]))
    return F.aggregate(F.transform(raws, looked_up), start, step, lambda s: s["ids"])


def scanned(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES,
            text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: rest (a struct of its columns), sentences, licenses, unmatched (arrays of text).

    ``sentences`` are the identifiers of all known sentences in order; sentences that are not
    known are passed over. Rules are tried in order: each run of identifiers that is a rule's is
    taken away, its licence is noted once; ``unmatched`` are the identifiers that are left, in order.
    A piece ends at ``.!?`` before white space and at a line break that a small letter does not follow. Pieces in a row
    that make up a known sentence are that sentence, however it is wrapped and whatever marks its lines begin with,
    unless a line without letters and digits is between them; other pieces are looked up one by one.

    Null and empty texts have empty arrays; repeated rows are scanned alike. All is done in the row itself: tables of
    sentences and rules are small, nothing is shuffled, and the whole text is read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    some = _lower(text).rlike("|".join(anchors(sentences)))
    pieces = F.split(_replaced(text, [(r"[ \t\r]+\n", "\n"), *CUTS]), "\n")
    ids = _identifiers(pieces, sentences)
    found = docs.select(F.struct("*").alias("rest"), F.when(some, ids).otherwise(F.array().cast("array<string>")).alias("sentences"))
    # A run is found in the text of all identifiers, each between commas of its own.
    joined = F.concat(F.lit(","), F.array_join("sentences", ",,"), F.lit(","))
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f",{i}," for i in run)).alias("run")) for name, run in rules])
    start = F.struct(joined.alias("left"), F.array().cast("array<string>").alias("names"))

    def apply(state, rule):
        hit = F.contains(state["left"], rule["run"])
        return F.struct(F.replace(state["left"], rule["run"], F.lit("")).alias("left"),
                        F.when(hit, F.array_union(state["names"], F.array(rule["name"]))).otherwise(state["names"]).alias("names"))

    done = F.aggregate(table, start, apply)
    none = F.array().cast("array<string>")
    found = found.withColumn("done", F.when(F.size("sentences") > 0, done))
    left = F.filter(F.split(F.col("done.left"), ","), lambda x: x != "")
    return found.select("rest", "sentences", F.coalesce("done.names", none).alias("licenses"), F.coalesce(left, none).alias("unmatched"))


def sql(table: str = "documents", id_col: str = "doc_id", sentences: dict[str, str] = SENTENCES,
        rules: list[tuple[str, list[str]]] = RULES) -> str:
    """The query of op1 in SQL: every text is cut, sentences are joined with their table, rules are tried one by one."""
    def q(s):
        return "'" + s.replace("'", "''") + "'"

    def replaced(c, steps):
        for pattern, by in steps:
            c = f"regexp_replace({c}, {q(pattern)}, {q(by)}, 'g')"
        return c

    values = ", ".join(f"({q(s)}, {q(i)})" for s, i in sentences.items())
    steps, last = [], "r0"
    for n, (name, run) in enumerate(rules, 1):
        run = q("".join(f",{i}," for i in run))
        steps.append(f"r{n} as (select id, sentences, replace(left_, {run}, '') as left_, case when contains(left_, {run}) and not "
                     f"list_contains(names, {q(name)}) then list_append(names, {q(name)}) else names end as names from {last})")
        last = f"r{n}"
    return f"""
with known(sentence, identifier) as (values {values}),
pieces as (
  select {id_col} as id, unnest(string_split({replaced("coalesce(text, '')", CUTS)}, chr(10))) as piece,
    generate_subscripts(string_split({replaced("coalesce(text, '')", CUTS)}, chr(10)), 1) as place
  from {table}
), found as (
  select id, string_agg(identifier, ',,' order by place) as sentences
  from pieces join known on sentence = {replaced(f"translate(piece, '{UPPER}', '{LOWER}')", NORMS)} group by id
), r0 as (
  select {id_col} as id, coalesce(sentences, '') as sentences, ',' || coalesce(sentences, '') || ',' as left_, []::varchar[] as names
  from {table} left join found on found.id = {table}.{id_col}
), {", ".join(steps)}
select id as {id_col}, replace(sentences, ',,', ',') as sentences, array_to_string(names, ',') as licenses,
  trim(replace(left_, ',,', ','), ',') as unmatched
from {last}"""
