"""Licence scan by a positional rare-token index, in DataFrame and SQL functions only."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mktstream.llm.common import ascii_lower

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases of the contract and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Texts, openings and notices of public licences, by label, each with a phrase that must stand in its place.
TEMPLATES: dict[str, list[tuple[str, str]]] = {
    "mit": [
        (
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
            "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
            "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
            "permission is hereby granted",
        ),
        (
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
            "permission is hereby granted",
        ),
        ("released under the mit license", "mit license"),
    ],
    "apache": [
        (
            "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses "
            "license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
            "either express or implied see the license for the specific language governing permissions and limitations under the license",
            "apache license",
        ),
        ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license"),
        ("licensed under the apache license version 2 0", "apache license"),
    ],
    "gpl": [
        (
            "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license "
            "or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a "
            "particular purpose see the gnu general public license for more details",
            "general public license",
        ),
        ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "general public license"),
        ("this work is licensed under the gnu general public license version 3", "general public license"),
    ],
    "lgpl": [
        (
            "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the "
            "license or at your option any later version",
            "lesser general public license",
        ),
        ("redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ],
    "bsd": [
        (
            "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above "
            "copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
            "in the documentation and or other materials provided with the distribution",
            "source and binary forms",
        ),
        ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ],
    "isc": [
        (
            "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
            "with or without fee",
        ),
        ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ],
    "mpl": [
        (
            "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
            "mozilla public license",
        ),
        ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ],
    "zlib": [
        (
            "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone "
            "to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
            "permission is granted to anyone",
        ),
    ],
    "cc-by-nc": [("licensed under cc by nc 4 0", "cc by nc")],
    "cc-by-sa": [("licensed under cc by sa 4 0", "cc by sa")],
    "cc-by": [("licensed under cc by 4 0", "cc by 4 0"), ("this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution")],
    "unlicense": [
        (
            "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled "
            "binary for any purpose commercial or non commercial and by any means",
            "public domain",
        ),
        ("this is free and unencumbered software released into the public domain", "public domain"),
    ],
}

MIN_SCORE = 0.8


def words_of(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, re.sub("[A-Z]+", lambda m: m[0].lower(), text)) if w]


@dataclass
class Template:
    label: str
    words: list[str]
    phrase: list[str]
    weights: list[float]
    #: (word, position) of its rarest words.
    postings: list[tuple[str, int]]

    @property
    def at(self) -> int:
        """Where the mandatory phrase begins."""
        return next(i for i in range(len(self.words)) if self.words[i : i + len(self.phrase)] == self.phrase)


class RareTokenIndex:
    """Postings (template, position) of the rarest words of each template, by the words' IDF in the documents.

    Of each template so many of the rarest words are indexed that of a place that reaches min_score at least two stand where they
    should: their weights less the largest exceed what such a place may lack. The index's size is that of the
    templates, so it travels inside the expression as literals.
    """

    def __init__(self, idf: dict[str, float] | None = None, templates: dict[str, list[tuple[str, str]]] = TEMPLATES, min_score: float = MIN_SCORE):
        self.min_score, self.templates = min_score, []
        for label, texts in templates.items():
            for text, phrase in texts:
                words = words_of(text)
                raw = [(idf or {}).get(w, 1.0) for w in words]
                weights = [x / sum(raw) for x in raw]
                own: dict[str, float] = {}
                for w, x in zip(words, weights):
                    own[w] = own.get(w, 0.0) + x
                rarest = sorted(own, key=lambda w: (-(idf or {}).get(w, 1.0), words.index(w)))
                k = 2
                while k < len(rarest) and sum(own[w] for w in rarest[:k]) - max(own[w] for w in rarest[:k]) <= 1 - min_score + 1e-9:
                    k += 1
                chosen = set(rarest[:k])
                self.templates.append(Template(label, words, words_of(phrase), weights, [(w, i) for i, w in enumerate(words) if w in chosen]))

    @property
    def vocabulary(self) -> list[str]:
        return sorted({w for t in self.templates for w, _ in t.postings} | {w for p in PHRASES for w in p.split()})


def document_words(docs: DataFrame, text_col: str) -> Column:
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return F.array_remove(F.split(text, SEPARATORS, -1), "")


def idf_of(docs: DataFrame, text_col: str = "text", templates: dict[str, list[tuple[str, str]]] = TEMPLATES) -> dict[str, float]:
    """ln(1 + documents / (1 + documents with the word)) of each word of the templates, over all documents."""
    words = sorted({w for texts in templates.values() for text, _ in texts for w in words_of(text)})
    known = F.array_distinct(F.filter(document_words(docs, text_col), lambda w: w.isin(words)))
    counts = docs.select(F.explode(F.concat(F.array(F.lit("")), known)).alias("w")).groupBy("w").count()
    found = {r["w"]: r["count"] for r in counts.collect()}  # a row for each word of the templates at most
    return {w: math.log(1 + found.get("", 0) / (1 + found.get(w, 0))) + 1e-6 for w in words}


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _held(array: Column, use) -> Column:
    """use(array) with the array made once, however often use refers to it."""
    return F.element_at(F.transform(F.array(array), use), 1)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: RareTokenIndex | None = None) -> DataFrame:
    """Licence labels of every whole text.

    Words are runs outside SEPARATORS after lower-casing A-Z. Returns doc_id, n_words, n_base (places where
    a phrase of PHRASES stands), first_word and last_word (smallest and largest start of these, null without
    one), base_labels, labels (these and the method's), score (largest of the templates' scores from min_score on and, with a
    base place, 1).

    A text's rare licence words are looked up in the index. Each posting gives the places at which the text would hold the template;
    the postings of different words are intersected: a place that at least two give is a candidate. Its score is the share,
    weighted by IDF, of the template's words that stand where they should, and it counts if its mandatory phrase stands there. The
    contract's phrases are found likewise, by intersecting the places that all their words give. All happens inside
    the row: no shuffle but for the word counts of the IDF, and a row's work grows with its words. Null and empty texts have no words;
    rows are taken one by one, so repeated rows, ties and null identifiers do no harm; very long texts are read whole; an empty table
    gives no rows; further columns aren't read.
    """
    index = index or RareTokenIndex(idf_of(docs, text_col))
    base = docs.select(F.col(id_col).alias("doc_id"), document_words(docs, text_col).alias("w"))
    hits = F.filter(F.transform(F.col("w"), lambda w, i: F.when(w.isin(index.vocabulary), F.struct(w.alias("w"), i.alias("i")))), lambda h: h.isNotNull())
    found = base.withColumn("h", hits)

    def places(word: str, position: int) -> Column:
        """Where a text would begin that has the word at the position."""
        return F.transform(F.filter("h", lambda h: h["w"] == word), lambda h: h["i"] - position)

    def phrase_places(phrase: list[str], label: str) -> Column:
        starts = reduce(F.array_intersect, [places(w, i) for i, w in enumerate(phrase)])
        return F.transform(starts, lambda i: F.struct(i.alias("i"), F.lit(label).alias("label")))

    def candidates(t: Template) -> Column:
        given = F.array_sort(F.concat(*[places(w, i) for w, i in t.postings]))
        least = min(2, len(t.postings))
        agreed = _held(given, lambda s: F.filter(s, lambda x, i: (x >= 0) & (F.lit(least == 1) | F.coalesce(F.get(s, i - 1) == x, F.lit(False)))))
        return F.array_distinct(agreed)

    def scored(t: Template) -> Column:
        template = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(x).alias("x")) for w, x in zip(t.words, t.weights)])

        def score(s: Column) -> Column:
            there = F.slice(F.col("w"), s + 1, F.lit(len(t.words)))
            pairs = F.arrays_zip(template.alias("t"), there.alias("d"))
            share = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.when(p["t"]["w"] == p["d"], p["t"]["x"]).otherwise(0.0))
            stands = F.slice(F.col("w"), s + t.at + 1, F.lit(len(t.phrase))) == _strings(t.phrase)
            return F.when(stands, F.least(F.round(share, 9), F.lit(1.0))).otherwise(0.0)

        return F.coalesce(F.array_max(F.transform(candidates(t), score)), F.lit(0.0))

    any_hit = F.size("h") > 0
    scores = F.array(*[scored(t) for t in index.templates])
    labels = _strings([t.label for t in index.templates])
    full = found.withColumn("p", F.when(any_hit, F.concat(*[phrase_places(p.split(), label) for p, label in PHRASES.items()]))).withColumn("s", F.when(any_hit, scores))
    base_set = F.array_sort(F.array_distinct(F.transform("p", lambda p: p["label"])))
    own = F.transform(F.filter(F.arrays_zip(labels.alias("label"), F.col("s").alias("s")), lambda x: x["s"] >= index.min_score), lambda x: x["label"])
    n_base = F.when(F.col("p").isNull(), 0).otherwise(F.size("p"))
    best = F.coalesce(F.array_max(F.filter("s", lambda s: s >= index.min_score)), F.lit(0.0))
    return full.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        n_base.cast("long").alias("n_base"),
        F.array_min(F.transform("p", lambda p: p["i"])).cast("long").alias("first_word"),
        F.array_max(F.transform("p", lambda p: p["i"])).cast("long").alias("last_word"),
        F.coalesce(F.array_join(base_set, ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join(F.array_sort(F.array_union(base_set, own)), ","), F.lit("")).alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
