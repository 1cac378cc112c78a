"""License scans (9) by sentence rules.

A text is normalised to words and the places where a sentence may begin or end, and sentences known from licences are named.
A sentence ends for certain at [.!?] before white space and at a line without words; it may end at a line end, at [:;] and
at a dash, or go on there, so lines may be wrapped, with comment leaders or not, and titles are sentences. Of the known
sentences that begin at a place, the longest is named. The sequence of names
is matched against ordered rules: each rule is a sequence of names that must follow one another, with other known
sentences between them or not; the first rule that fits gives the licence, all that fit are listed.

Everything happens in the row: no shuffle, whatever repeats. A text without any of the anchor words cannot hold a
known sentence (a test sees to that) and is not cut.

Defined results: a null or empty text has no names and no licence; repeated rows are each answered; other columns are
not looked at. Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences by which licences are known, normalised, and their names.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2-short",
    "licensed under the apache license version 2 0 the license": "apache2-head",
    "the asf licenses this file to you under the apache license version 2 0 the license": "apache2-head",
    "apache license version 2 0 january 2004": "apache2-short",
    "you may not use this file except in compliance with the license": "apache2-use",
    "you may obtain a copy of the license at": "apache2-copy",
    "released under the mit license": "mit-short",
    "licensed under the mit license": "mit-short",
    "the mit license": "mit-title",
    "mit license": "mit-title",
    "the mit license mit": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "this work is licensed under the gnu general public license version 3": "gpl3-short",
    "this work is licensed under the gnu general public license version 2": "gpl2-short",
    "gnu general public license version 3 29 june 2007": "gpl3-short",
    "gnu general public license version 2 june 1991": "gpl2-short",
    "gnu general public license": "gpl-title",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-warranty",
    "licensed under cc by nc 4 0": "cc-by-nc4-short",
    "licensed under cc by 4 0": "cc-by4-short",
    "licensed under cc by sa 4 0": "cc-by-sa4-short",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by4-long",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc4-long",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa4-long",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    "spdx license identifier apache 2 0": "apache2-spdx",
    "spdx license identifier mit": "mit-spdx",
    "all rights reserved": "reserved",
}
#: What often stands before a sentence that begins with "licensed" or "released".
LEAD_INS = tuple(f"this {what} is" for what in ("program", "project", "software", "file", "work", "code", "library", "package"))
SENTENCES |= {f"{lead} {sentence}": name for sentence, name in list(SENTENCES.items()) if sentence.startswith(("licensed ", "released ")) for lead in LEAD_INS}
#: Licences and the names that must follow one another, the most telling rules first.
RULES = (
    ("apache-2.0", ("apache2-head", "apache2-use")),
    ("apache-2.0", ("apache2-use", "apache2-copy")),
    ("apache-2.0", ("apache2-spdx",)),
    ("apache-2.0", ("apache2-short",)),
    ("gpl-3.0", ("gpl3-grant", "gpl-warranty")),
    ("gpl-3.0", ("gpl3-grant",)),
    ("gpl-3.0", ("gpl3-short",)),
    ("gpl-2.0", ("gpl2-grant",)),
    ("gpl-2.0", ("gpl2-short",)),
    ("bsd-3-clause", ("bsd-grant", "bsd-name")),
    ("bsd-2-clause", ("bsd-grant",)),
    ("cc-by-nc-4.0", ("cc-by-nc4-long",)),
    ("cc-by-nc-4.0", ("cc-by-nc4-short",)),
    ("cc-by-sa-4.0", ("cc-by-sa4-long",)),
    ("cc-by-sa-4.0", ("cc-by-sa4-short",)),
    ("cc-by-4.0", ("cc-by4-long",)),
    ("cc-by-4.0", ("cc-by4-short",)),
    ("mit", ("mit-title", "mit-grant", "mit-notice")),
    ("mit", ("mit-grant",)),
    ("mit", ("mit-spdx",)),
    ("mit", ("mit-short",)),
    ("mit", ("mit-title",)),
    ("gpl", ("gpl-title",)),
    ("reserved", ("reserved",)),
)
#: Every known sentence holds one of these.
ANCHORS = ("licens", "permission", "copyright", "redistribut", "warranty", "reserved")

SPACE = r"[\x20\x09-\x0D]"
#: Text is brought to words with one of three marks between them: a blank, ~ where a sentence may end, | where it must.
MARKS = (
    (rf"[.!?]{SPACE}+", "\n\n"),
    (rf"[:;](?={SPACE})|(?<=\x20)[-–—]{{1,3}}(?=\x20)|[.!?][\"')\]]{{1,3}}(?={SPACE})", "~"),
    (r"[^a-z0-9\n~]+", " "),
    (r"\n[ ~]*+\n[ ~\n]*+", "|"),
    (r" ?[~\n][ ~\n]*+", "~"),
    (r"[ ~]?\|[ ~|]*+", "|"),
    # The BSD sentence names its holder, such as "Example Inc."
    (
        r"(?<![^~|])neither[ ~]the[ ~]names?[ ~]of[ ~](?:[a-z0-9]+[ ~|]){1,12}?nor[ ~]the[ ~]names[ ~]of[ ~](?:(?:its|any|the|their|other)[ ~])?contributors",
        "neither the name of the copyright holder nor the names of its contributors",
    ),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ~", "abcdefghijklmnopqrstuvwxyz "


def sentence_names(text: Column, sentences: dict[str, str]) -> Column:
    """The names of the known sentences of a text in their order."""
    small = F.translate(text, UPPER, LOWER)
    marked = F.trim(reduce(lambda value, mark: F.regexp_replace(value, *mark), MARKS, small))
    longest_first = "|".join(s.replace(" ", "[ ~]") for s in sorted(sentences, key=len, reverse=True))
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    found = F.regexp_extract_all(marked, F.lit(rf"(?<![^~|])(?:{longest_first})(?![^~|])"), F.lit(0))
    named = F.transform(found, lambda s: F.try_element_at(known, F.translate(s, "~", " ")))
    return F.when(reduce(Column.__or__, [F.contains(small, F.lit(a)) for a in ANCHORS]), named).otherwise(
        F.array().cast("array<string>")
    )


def license_scan(
    docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES
) -> DataFrame:
    """``doc_id``, ``n_sentences`` (known ones), ``sentence_ids`` (joined by >), ``license`` and ``licenses``."""
    named = docs.select("doc_id", F.coalesce(sentence_names(F.col("text"), sentences), F.array().cast("array<string>")).alias("names"))
    joined = named.select("doc_id", F.size("names").alias("n"), F.array_join("names", ">").alias("ids"), F.concat(F.lit("<"), F.array_join("names", "><"), F.lit(">")).alias("chain"))

    def fits(names: tuple[str, ...]) -> Column:
        return F.col("chain").like("%" + "%".join(f"<{name}>" for name in names) + "%")

    hits = F.array_compact(F.array(*[F.when(fits(names), F.lit(licence)) for licence, names in rules]))
    return joined.select(
        "doc_id",
        F.col("n").cast("long").alias("n_sentences"),
        F.col("ids").alias("sentence_ids"),
        F.get(hits, F.lit(0)).alias("license"),
        F.array_join(F.array_distinct(hits), ",").alias("licenses"),
    )
