"""Licence scans by sentence rules, in DataFrame functions only and without a shuffle.

A text is cut into sentences, these are normalised and looked up among known licence sentences, and the sequence of
identifiers found is matched against ordered rules. Sentences and rules are parameters; the dictionary is a literal
map in the plan, so its size is that of the parameter. A sentence may be a line, a part of one, or wrapped over several
lines with comment leaders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import fresh, table

#: Known sentences, normalised: lower case, every run of other characters than a-z and 0-9 one space.
SENTENCES = {
    "apache-ref": "licensed under the apache license version 2 0",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "mit-ref": "released under the mit license",
    "cc-by-nc-ref": "licensed under cc by nc 4 0",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "reserved": "all rights reserved",
}
#: Ordered rules: name, class, identifiers that must follow one another (sentences that are not known may lie between).
RULES = (
    ("Apache-2.0-header", "permissive", ("apache-ref", "apache-use", "apache-copy")),
    ("Apache-2.0", "permissive", ("apache-ref",)),
    ("GPL-3.0-header", "copyleft", ("gpl-free", "gpl-hope", "gpl-details")),
    ("GPL-3.0", "copyleft", ("gpl3-ref",)),
    ("MIT-text", "permissive", ("mit-grant", "mit-notice")),
    ("MIT", "permissive", ("mit-ref",)),
    ("CC-BY-NC-4.0", "noncommercial", ("cc-by-nc-ref",)),
    ("proprietary", "proprietary", ("reserved",)),
)
#: Sentences of licences as they are published, and their rules. The SQL of the query has those above only.
GENUINE = {
    "apache-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-at": "you may obtain a copy of the license at",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl2-ref": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "cc-by-ref": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-text": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
}
GENUINE_RULES = (
    ("Apache-2.0-header", "permissive", ("apache-header", "apache-at")),
    ("Apache-2.0-header", "permissive", ("apache-header", "apache-copy")),
    ("Apache-2.0", "permissive", ("apache-header",)),
    ("GPL-2.0-header", "copyleft", ("gpl2-free", "gpl-hope", "gpl-details")),
    ("GPL-2.0", "copyleft", ("gpl2-free",)),
    ("GPL-3.0", "copyleft", ("gpl-free",)),
    ("LGPL-3.0", "copyleft", ("lgpl3-free",)),
    ("LGPL-2.1", "copyleft", ("lgpl21-free",)),
    ("AGPL-3.0", "copyleft", ("agpl3-free",)),
    ("MPL-2.0", "copyleft", ("mpl2-ref",)),
    ("BSD", "permissive", ("bsd-grant",)),
    ("MIT", "permissive", ("mit-grant",)),
    ("ISC", "permissive", ("isc-grant",)),
    ("Unlicense", "permissive", ("unlicense-free",)),
    ("CC-BY-4.0", "permissive", ("cc-by-ref",)),
    ("CC-BY-NC-4.0", "noncommercial", ("cc-by-nc-text",)),
)
#: The class of a document is the strictest of its matches.
STRICTEST = ("proprietary", "noncommercial", "copyleft", "permissive")


def normalise(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _wrapped(parts: Column, known: Column, shortest: int) -> Column:
    """array<struct<place, last, id>>: known sentences over several parts (lines), with their first and last place.

    Parts follow one another in a sentence unless one ends in .!? or a part without letters and digits or a copyright
    notice lies between. Cuts become SOH, one for one, so that places stay countable.
    """
    word, text = "(?:(?:rem|dnl)[ \\t]*)?", F.translate(F.array_join(parts, "\n"), "\x01", "\x02")
    text = F.regexp_replace(text, r"(?<=[.!?])\n", "\x01")
    text = F.regexp_replace(text, rf"(?i)\n(?=[^a-z0-9\n\x01]*{word}(?:[\n\x01]|\z))", "\x01")
    text = F.regexp_replace(text, r"(?i)((?:^|[\n\x01])[^a-z0-9\n\x01]*copyright[^a-z0-9\n\x01]*(?:c\)|[0-9]{4})[^\n\x01]*)\n", "$1\x01")
    groups = F.split(text, "\x01")
    lines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    blank = rf"(?i)\A[^a-z0-9\n]*{word}\n"
    clean = lambda x: normalise(F.regexp_replace(x, r"(?im)^[^a-z0-9\n]*(?:rem|dnl)[ \t]+", ""))
    looked = F.transform(groups, lambda x, i: F.struct(i.alias("i"), F.when(F.contains(x, F.lit("\n")) & (F.length(x) >= shortest), F.try_element_at(known, clean(x))).alias("id")))

    def placed(x: Column) -> Column:
        before = F.aggregate(F.slice(groups, 1, x["i"]), F.lit(0), lambda n, g: n + lines(g) + 1)
        own = F.get(groups, x["i"])
        return F.struct((before + 1 + F.rlike(own, F.lit(blank)).cast("int")).alias("place"), (before + 1 + lines(own)).alias("last"), x["id"].alias("id"))

    return F.transform(F.filter(looked, lambda x: x["id"].isNotNull()), placed)


def sentence_ids(text: Column, sentences=SENTENCES | GENUINE) -> Column:
    """array<struct<place int, id string>>: the known sentences of the text in order, with their place among all lines and parts of lines.

    A wrapped sentence has the place of its first line; lines inside it do not count on their own.
    """
    shortest = min(map(len, sentences.values()), default=0)
    known = F.create_map(*[F.lit(x) for i, s in sentences.items() for x in (s, i)])
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])[\x09-\x0D\x20]+", "$1\n"), "\n")
    looked = F.transform(parts, lambda s, i: F.struct((i + 1).alias("place"), F.when(F.length(s) >= shortest, F.try_element_at(known, normalise(s))).alias("id")))
    single, wrapped = F.filter(looked, lambda x: x["id"].isNotNull()), _wrapped(parts, known, shortest)
    alone = F.filter(single, lambda x: ~F.exists(wrapped, lambda w: x["place"].between(w["place"], w["last"])))
    return F.array_sort(F.concat(alone, F.transform(wrapped, lambda w: F.struct(w["place"].alias("place"), w["id"].alias("id")))))


def scan(docs: DataFrame, sentences=SENTENCES | GENUINE, rules=RULES + GENUINE_RULES) -> DataFrame:
    """docs with license_sentences (places and identifiers), license_matches (rule names) and license_class.

    Null and empty texts have no sentences; a rule counts once however often it matches; columns of these names in
    docs are replaced. Rows are neither dropped nor repeated.
    """
    docs = docs.drop("license_sentences", "license_matches", "license_class")
    line = fresh(docs, "license_line")
    out = docs.withColumn("license_sentences", sentence_ids(F.col("text"), sentences))
    out = out.withColumn(line, F.concat(F.lit("|"), F.array_join(F.transform("license_sentences", lambda x: x["id"]), "|"), F.lit("|")))
    hits = [F.when(F.contains(F.col(line), F.lit(f"|{'|'.join(ids)}|")), F.struct(F.lit(name).alias("rule"), F.lit(kind).alias("kind"))) for name, kind, ids in rules]
    out = out.withColumn(line, F.array_compact(F.array(*hits)))
    kinds = F.transform(F.col(line), lambda x: x["kind"])
    strict = F.coalesce(*[F.when(F.array_contains(kinds, kind), F.lit(kind)) for kind in STRICTEST], F.lit("none"))
    return out.withColumn("license_matches", F.transform(F.col(line), lambda x: x["rule"])).withColumn("license_matches", F.array_distinct("license_matches")).withColumn("license_class", strict).drop(line)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    places = F.array_join(F.transform("license_sentences", lambda x: F.concat(x["place"].cast("string"), F.lit(":"), x["id"])), ",")
    return found.select("doc_id", F.size("license_sentences").cast("long").alias("n_sentences"), places.alias("sentences"), F.array_join("license_matches", ",").alias("licenses"), "license_class")


def _sql() -> str:
    known = ", ".join(f"('{i}', '{s}')" for i, s in SENTENCES.items())
    hits = ", ".join(f"CASE WHEN contains(line, '|{'|'.join(ids)}|') THEN '{name}' END" for name, _, ids in RULES)
    kinds = " ".join(f"WHEN {' OR '.join(f"list_contains(hits, '{name}')" for name, k, _ in RULES if k == kind)} THEN '{kind}'" for kind in STRICTEST)
    return rf"""
WITH k(id, sentence) AS (VALUES {known}),
p AS (SELECT rowid_ AS r, unnest(s) AS sentence, generate_subscripts(s, 1) AS place FROM (SELECT row_number() OVER () AS rowid_, string_split(regexp_replace(coalesce(text, ''), '([.!?])[\x09-\x0D\x20]+', '\1' || chr(10), 'g'), chr(10)) AS s FROM (SELECT text FROM documents ORDER BY doc_id, text))),
d AS (SELECT row_number() OVER () AS r, doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id, text)),
f AS (SELECT r, count(*) AS n, string_agg(place::VARCHAR || ':' || id, ',' ORDER BY place) AS sentences, '|' || string_agg(id, '|' ORDER BY place) || '|' AS line
  FROM p JOIN k ON trim(regexp_replace(lower(p.sentence), '[^a-z0-9]+', ' ', 'g')) = k.sentence GROUP BY r),
h AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(sentences, '') AS sentences, list_filter([{hits}], lambda x: x IS NOT NULL) AS hits FROM d LEFT JOIN f USING (r))
SELECT doc_id, n_sentences, sentences, array_to_string(hits, ',') AS licenses, CASE {kinds} ELSE 'none' END AS license_class FROM h
"""


OP7_SQL = _sql()
