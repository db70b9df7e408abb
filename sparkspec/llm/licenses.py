"""License scans with a positional index of rare words, in DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from .work import Work

#: Fixed values of the contract: phrases that count wherever their words stand consecutively, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Licence texts and notices with their label and the key phrase without which the label is not given.
TEMPLATES = [
    ("mit", "released under the MIT license", "mit license"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.""", "permission is hereby granted free of charge"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies.""", "for any purpose with or without fee is hereby granted"),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions""", "alter it and redistribute it freely"),
    ("apache-2.0", "licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    ("apache-2.0", """you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0""", "in compliance with the license"),
    ("gpl-3.0", "this work is licensed under the GNU General Public License, version 3", "gnu general public license version 3"),
    ("gpl-2.0", "this work is licensed under the GNU General Public License, version 2", "gnu general public license version 2"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""", "gnu general public license"),
    ("lgpl", "licensed under the GNU Lesser General Public License", "lesser general public license"),
    ("agpl", "licensed under the GNU Affero General Public License", "affero general public license"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.""", "redistribution and use in source and binary forms"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", "cc by sa"),
    ("cc-by-nd", "licensed under CC BY-ND 4.0", "cc by nd"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution"),
    ("cc0", "dedicated to the public domain under CC0 1.0 Universal", "cc0 1 0 universal"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
means.""", "free and unencumbered software"),
    ("copyright", "Copyright (c) All rights reserved", "all rights reserved"),
]

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), 0)


def _low(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def template_words(text: str) -> list[str]:
    """The words of a template or phrase, cut as those of documents are."""
    return re.findall(_WORD, text.translate(str.maketrans(_UPPER, _LOWER)))


def _given(docs: DataFrame) -> Column:
    return _words_of(_low(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Number of rows that hold each word of ``vocabulary``: as many numbers as the templates have words."""
    mine = F.array_distinct(F.filter(_given(docs), lambda w: w.isin(vocabulary)))
    return {r.w: r.n for r in docs.select(F.explode(mine).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


class TemplateIndex:
    """Positional postings of the ``rarest`` words of each template, and an anchor word for each phrase.

    Inverse document frequencies come from all rows. A word that no row holds
    cannot be met and is left out, and so are a phrase with such a word and a
    template whose key phrase it is. ``leads`` holds of each template the
    words of highest idf without which the others cannot reach ``share``: a
    row without any of them has no template.
    """

    def __init__(self, templates, frequencies: dict[str, int], n_rows: int, rarest: int, share: float):
        idf = {w: math.log1p(n_rows / n) for w, n in frequencies.items()}
        rare = lambda words: sorted((w for w in set(words) if w in idf), key=lambda w: (-idf[w], w))
        self.postings: list[tuple] = []
        leads: set[str] = set()
        for t, (_, text, phrase) in enumerate(templates):
            if not all(w in idf for w in template_words(phrase)):
                continue
            words = template_words(text)
            top = rare(words)[:rarest]
            need = sum(idf[w] for w in sorted(top))
            self.postings += [(w, t, i, idf[w], need) for i, w in enumerate(words) if w in top]
            left = need
            for w in top:
                if left < share * need * (1 - 1e-9):
                    break
                leads.add(w)
                left -= idf[w]
        self.leads = sorted(leads)
        self.phrases: dict[str, tuple[str, int]] = {}
        for phrase in [*BASE_PHRASES, *(p for *_, p in templates)]:
            words = template_words(phrase)
            if words and all(w in idf for w in words):
                self.phrases[phrase] = (rare(words)[0], words.index(rare(words)[0]))
        self.base = sorted({self.phrases[p][0] for p in BASE_PHRASES if p in self.phrases})
        self.lookup = sorted({w for w, *_ in self.postings} | {w for w, _ in self.phrases.values()})
        self.longest = max((len(template_words(p)) for p in self.phrases), default=1)


def word_hits(docs: DataFrame, index: TemplateIndex) -> DataFrame:
    """(row columns, n_words, hits): hits are the places of looked-up words, with the words before and after that the longest phrase may need.

    A row without any leading word of a template is looked up for base phrases
    only. One pass over the text; a row without hits carries an empty array.
    """
    reach = index.longest - 1
    joined = lambda words, a, n: F.concat_ws(" ", F.slice(words, a, n))

    def of(words: Column) -> Column:
        among = lambda some: F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.get(words, i - 1).isin(some))
        places = F.when(F.exists(words, lambda w: w.isin(index.leads)), among(index.lookup)).otherwise(among(index.base))
        near = F.when(F.size(words) > 0, F.transform(places, lambda i: F.struct(
            F.get(words, i - 1).alias("word"), (i - 1).alias("pos"),
            joined(words, F.greatest(F.lit(1), i - reach), i - F.greatest(F.lit(1), i - reach)).alias("behind"), joined(words, i, F.lit(reach + 1)).alias("ahead"))))
        return F.struct(F.size(words).cast("long").alias("n_words"), near.alias("hits"))

    # the array is bound once as a lambda variable, so the words are cut once a row
    found = F.get(F.transform(F.array(_given(docs)), of), F.lit(0))
    none = F.array().cast("array<struct<word:string,pos:int,behind:string,ahead:string>>")
    return docs.withColumn("_f", found).select(*docs.columns, F.col("_f.n_words").alias("n_words"), F.coalesce("_f.hits", none).alias("hits"))


def _at(hit: Column, phrase: str, index: TemplateIndex) -> Column:
    """Whether the words of a phrase stand around a hit of its anchor."""
    anchor, place = index.phrases[phrase]
    words = template_words(phrase)
    after, before = " ".join(words[place:]), " ".join(words[:place])
    found = (hit["word"] == anchor) & ((hit["ahead"] == after) | hit["ahead"].startswith(after + " "))
    return found & ((hit["behind"] == before) | hit["behind"].endswith(" " + before)) if before else found


def _places(phrase: str, label: str, index: TemplateIndex) -> Column:
    """Where a base phrase begins in a row, with its label."""
    mine = F.filter("hits", lambda h: _at(h, phrase, index))
    return F.transform(mine, lambda h: F.struct((h["pos"] - index.phrases[phrase][1]).alias("pos"), F.lit(label).alias("label")))


def scan(docs: DataFrame, *, templates=TEMPLATES, rarest: int = 6, share: float = 0.6, slack: int = 8) -> DataFrame:
    """Licences of each row of ``docs`` (doc_id, text): one result row for each input row.

    Columns: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score. Words are runs of digits, letters and non-ASCII characters,
    A-Z lower-cased. Base places are where a base phrase's words stand
    consecutively. The positional index holds each template's ``rarest`` words
    of highest inverse document frequency (counted over all rows; ties by
    word), and every place of such a word in a row is looked up in it; a
    template is found where words weighing at least ``share`` of its rarest
    ones' idf agree on one relative position and the key phrase stands within
    ``slack`` words of its own place there (anywhere over the template's
    length, if the template does not hold its phrase). ``score`` is the
    largest such share, 1 where only base places were found, 0 without labels.

    A null or empty text has no words, empty labels and null places. Rows
    repeat as they come; a null doc_id is kept. An empty table gives an empty
    result. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    work = Work(spark)
    docs = docs.select("doc_id", "text")
    vocabulary = sorted({w for _, text, phrase in templates for w in template_words(text) + template_words(phrase)} | {w for p in BASE_PHRASES for w in template_words(p)})
    index = TemplateIndex(templates, document_frequencies(docs, vocabulary), docs.count(), rarest, share)
    hits = work.table(word_hits(docs, index).drop("text").withColumn("row", F.monotonically_increasing_id()), "hits")
    base = {p: label for p, label in BASE_PHRASES.items() if p in index.phrases}
    none = F.array().cast("array<struct<pos:int,label:string>>")
    places = F.flatten(F.array(*[_places(p, label, index) for p, label in base.items()])) if base else none
    plain = hits.withColumn("_base", places).select(
        "row", "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min("_base.pos").cast("long").alias("first_word"), F.array_max("_base.pos").cast("long").alias("last_word"),
        F.array_sort(F.array_distinct("_base.label")).alias("_base_labels"))

    each = hits.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h"))
    # as many rows as the templates have words, and one for each template
    postings = F.broadcast(spark.createDataFrame(index.postings, "word string, template int, at int, idf double, need double"))
    agree = each.select("row", "h.word", "h.pos").join(postings, "word").groupBy("row", "template", (F.col("pos") - F.col("at")).alias("shift"), "need").agg(F.sum("idf").alias("got"))
    likely = agree.select("row", "template", "shift", F.least(F.lit(1.0), F.col("got") / F.col("need")).alias("share")).where(F.col("share") >= share)
    keys = []
    for t, (label, text, phrase) in enumerate(templates):
        if phrase in index.phrases:
            words, key = template_words(text), template_words(phrase)
            own = next((i for i in range(len(words)) if words[i : i + len(key)] == key), None)
            keys.append((t, label, phrase, -len(key) if own is None else own - slack, len(words) if own is None else own + slack))
    named = F.broadcast(spark.createDataFrame(keys, "template int, label string, phrase string, lo int, hi int"))
    phrases = sorted({k[2] for k in keys})
    stands = F.array(*[F.when(_at(F.col("h"), p, index), F.struct(F.lit(p).alias("phrase"), (F.col("h.pos") - index.phrases[p][1]).alias("start"))) for p in phrases]) if phrases else F.array().cast("array<struct<phrase:string,start:int>>")
    found = each.select("row", F.explode(F.array_compact(stands)).alias("p")).select("row", "p.phrase", "p.start")
    sure = likely.join(named, "template").join(found, ["row", "phrase"]).where((F.col("start") - F.col("shift")).between(F.col("lo"), F.col("hi")))
    more = sure.groupBy("row").agg(F.collect_set("label").alias("_more"), F.max("share").alias("_share"))
    return plain.join(more, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base_labels", F.coalesce("_more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("_share", F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("score"))
