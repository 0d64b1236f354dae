"""License scans by a positional rare-token index; DataFrame functions only.

A template is a notice: a label, its text, and the key phrases that a file must hold to have the label. Document
frequencies of all template words are counted over the whole table. The index has the postings (template, place) of the
rare ones (in at most ``common`` of all files). Of each file, the ``rarest`` licence words of highest IDF are looked up;
the places that their postings imply are intersected by relative position, so each template and shift gathers the IDF of
the words that stand in place. Key phrases are posted under their word of highest IDF, and each place where that word
stands is verified, word by word; no place of a phrase can be missed.
"""

from __future__ import annotations

import math
import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Template(NamedTuple):
    label: str
    text: str
    #: All of these must stand in a file.
    keys: tuple[str, ...]


#: The phrases and labels that always count.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Usual notices and the beginnings of licence texts, in words as ``words`` gives them, and their key phrases.
MORE = (
    Template("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu affero general public license",)),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", ("you may not use this file except in compliance with the license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice", ("redistribution and use in source and binary forms with or without modification", "are permitted provided that the following conditions are met")),
    Template("bsl-1", "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("boost software license version 1 0",)),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike license cc by sa", ("cc by sa",)),
    Template("cc0", "to the extent possible under law the person who associated cc0 1 0 universal with this work has waived all copyright and related or neighboring rights", ("cc0 1 0 universal",)),
    Template("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation", ("gnu general public license version 2",)),
    Template("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation", ("gnu general public license version 3",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify and or distribute this software for any purpose", "with or without fee is hereby granted")),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge to any person obtaining a copy of this software", "to deal in the software without restriction")),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("subject to the terms of the mozilla public license v 2 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("free and unencumbered software released into the public domain",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications", ("in no event will the authors be held liable for any damages arising from the use of this software",)),
)
#: Highest score of a file without a label.
PARTLY = 0.99


def words(text: str) -> Column:
    """Words of a text: runs of ASCII digits, letters (A-Z lower-cased) and non-ASCII characters."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def scan(docs: DataFrame, base: tuple = BASE, more: tuple[Template, ...] = MORE, rarest: int = 8, common: float = 0.05) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of ``docs`` (doc_id, text).

    n_base counts all places of base phrases, first_word and last_word are their smallest and largest start (words from
    0; null without one). base_labels and labels (those of base phrases, and of templates whose key phrases all stand in
    the text) are distinct, sorted and comma-joined ('' if none). score is 1 with a label. Else it is the greatest IDF, over
    templates and shifts, of the places in a template where the file has one of its own ``rarest`` indexed words (ties by
    word), as a share of the IDF of the template's ``rarest`` indexed words, and 0.99 at most. Null and empty texts have
    no words; rows that repeat repeat; extra columns are ignored; an empty table gives an empty result. One pass counts
    document frequencies, one scans; nothing is shuffled but those counts.
    """
    templates = [(label, phrase.split()) for label, phrase in base] + [(t.label, t.text.split()) for t in more]
    phrases = [phrase.split() for _, phrase in base] + [key.split() for t in more for key in t.keys]
    vocabulary = sorted({w for _, text in templates for w in text} | {w for phrase in phrases for w in phrase})
    held = F.array_intersect(words("text"), F.array(*map(F.lit, vocabulary)))
    stats = docs.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    df = {r["w"]: r["n"] for r in stats.collect()}  # at most a row for each template word
    n = df.get("", 0)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-9 for w in vocabulary}
    by_idf = sorted((w for w in vocabulary if df.get(w, 0) <= common * n), key=lambda w: (df.get(w, 0), w))
    postings: dict[str, list[tuple[int, int]]] = {w: [] for w in by_idf}
    whole = []
    for t, (_, text) in enumerate(templates):
        for k, w in enumerate(text):
            if w in postings:
                postings[w].append((t, k))
        whole.append(sum(sorted((idf[w] for w in set(text) if w in postings), reverse=True)[:rarest]))
    anchors: dict[str, list[tuple[int, int]]] = {}
    for q, phrase in enumerate(phrases):
        at = min(range(len(phrase)), key=lambda k: (df.get(phrase[k], 0), k))
        anchors.setdefault(phrase[at], []).append((q, at))

    def index(entries: dict[str, list[tuple[int, int]]]) -> Column:
        pairs = [x for w, found in sorted(entries.items()) if found for x in (F.lit(w), F.array(*[F.struct(F.lit(a).alias("t"), F.lit(k).alias("k")) for a, k in found]))]
        return F.create_map(*pairs) if pairs else F.expr("map('', array(struct(0 AS t, 0 AS k)))")

    none = F.expr("cast(array() as array<struct<w:string,i:int>>)")

    def places(chosen: Column) -> Column:
        """Where the chosen words stand."""
        found = F.filter(F.transform("w", lambda w, i: F.when(F.array_contains(chosen, w), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
        return F.when(F.size(chosen) > 0, found).otherwise(none)

    def implied(hits: str, entries: dict[str, list[tuple[int, int]]]) -> Column:
        """The starts that the postings of the words imply, with the weight of the word."""
        of = index(entries)
        return F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(of, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["k"]).alias("s"), h["w"].alias("w")))))

    weight = F.create_map(*[F.lit(x) for w in by_idf for x in (w, idf[w])]) if by_idf else F.expr("map('', 0D)")
    words_of = F.array(*[F.array(*map(F.lit, phrase)) for phrase in phrases])
    rows = docs.select("doc_id", words("text").alias("w"))
    # the index is in descending order of IDF, and so is what a file has of it
    ordered = F.array(*map(F.lit, by_idf)) if by_idf else F.expr("cast(array() as array<string>)")
    rows = rows.withColumn("own", F.slice(F.array_intersect(ordered, F.col("w")), 1, rarest))
    rows = rows.withColumn("keys", F.array_intersect(F.array(*map(F.lit, sorted(anchors))), F.col("w")))
    rows = rows.withColumn("hits", places(F.col("own"))).withColumn("places", places(F.col("keys")))
    votes = F.array_sort(F.transform(implied("hits", postings), lambda c: F.struct(c["t"].alias("t"), c["s"].alias("s"), F.element_at(weight, c["w"]).alias("x"))))
    verified = F.filter(implied("places", anchors), lambda c: (c["s"] >= 0) & (F.slice("w", F.greatest(c["s"], F.lit(0)) + 1, F.size(F.get(words_of, c["t"]))) == F.get(words_of, c["t"])))
    found = rows.select("doc_id", "w", votes.alias("votes"), F.transform(verified, lambda c: F.struct(c["t"].alias("t"), c["s"].alias("s"))).alias("v"))
    totals = F.array(*[F.lit(float(x)) for x in whole])
    zero = F.struct(F.lit(-1).alias("t"), F.lit(0).alias("s"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def gather(a: Column, v: Column) -> Column:
        total = F.when((a["t"] == v["t"]) & (a["s"] == v["s"]), a["sum"]).otherwise(F.lit(0.0)) + v["x"]
        return F.struct(v["t"].alias("t"), v["s"].alias("s"), total.alias("sum"), F.greatest(a["best"], total / F.get(totals, v["t"])).alias("best"))

    has = F.array_distinct(F.transform("v", lambda c: c["t"]))
    n_base, at = len(base), len(base)
    labels = [F.when(F.array_contains("has", q), F.lit(label)) for q, (label, _) in enumerate(base)]
    for t in more:
        keys = range(at, at + len(t.keys))
        at += len(t.keys)
        labels.append(F.when(F.size(F.array_intersect("has", F.array(*map(F.lit, keys)))) == len(keys), F.lit(t.label)))
    joined = lambda columns: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*columns)))), ",")
    rated = found.withColumn("has", has).withColumn("b", F.transform(F.filter("v", lambda c: c["t"] < n_base), lambda c: c["s"]))
    rated = rated.withColumn("labels", F.when(F.size("has") > 0, joined(labels)).otherwise(F.lit(""))).withColumn("best", F.aggregate("votes", zero, gather, lambda a: a["best"]))
    return rated.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.size("b").cast("long").alias("n_base"),
        F.array_min("b").cast("long").alias("first_word"),
        F.array_max("b").cast("long").alias("last_word"),
        F.when(F.size("b") > 0, joined(labels[:n_base])).otherwise(F.lit("")).alias("base_labels"),
        "labels",
        F.round(F.when(F.col("labels") != "", 1.0).otherwise(F.least("best", F.lit(PARTLY))), 6).alias("score"),
    )
