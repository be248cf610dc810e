"""License scans (operator 9), in DataFrame functions only: a positional rare-token index.

Text is lower-cased (A-Z) and cut into words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+.

Base labels: every place where a phrase's words stand consecutively.

The method's labels.  The index maps each template word of INDEX_MIN letters or more to its postings (template, place).
One aggregation gives each index word's document frequency, so its IDF.  In a file the index words that it holds are
looked up, and for each template the CHOSEN of them with the highest IDF are taken: these are the file's own rarest
licence words, so a changed word only makes way for the next one.  Each of their occurrences votes, by each posting, for
the template's start (its place less the place in the template), and the postings are intersected by relative
position: a start on which AGREE different words meet is an alignment.  An alignment gives the template's label if
every mandatory key phrase stands where the template has it, give or take SHIFT words.

Texts are read and split once: the pass keeps the counts, the index words found, and the words of those files alone
that hold AGREE index words of one template; frequencies and labels are made of that.  The index has as many rows as the
templates have words, a fixed number; no text is shuffled.

score: 1 with a label; else the largest number of words that agree on a start, over CHOSEN + 1; 0 without any vote.

Defined results: null and empty texts have no words, null places and score 0; repeated rows get the same result each;
an empty table gives an empty result; index words that no document has are the rarest of all, ties go by the alphabet.
Other columns are not looked at.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import lower_ascii, source, table

#: Fixed values of the contract: phrase to label.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_GPL = (
    "this program is free software you can redistribute it and or modify it under the terms of the gnu {0} as published by"
    " the free software foundation either version {1} of the license or at your option any later version this program is"
    " distributed in the hope that it will be useful but without any warranty without even the implied warranty of"
    " merchantability or fitness for a particular purpose see the gnu {0} for more details you should have received a copy"
    " of the gnu {0} along with this program"
)


def _gnu(label: str, name: str, version: int) -> list[tuple]:
    """The notice, and the short form."""
    return [
        (label, _GPL.format(name, version), [f"terms of the gnu {name}", f"either version {version} of the license"]),
        (label, f"licensed under the gnu {name} version {version}", [f"gnu {name} version {version}"]),
    ]


#: (label, template, mandatory key phrases): the texts by which public licences are granted.
TEMPLATES = [
    *_gnu("agpl-3", "affero general public license", 3),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"
        " you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or"
        " agreed to in writing software distributed under the license is distributed on an as is basis without warranties or"
        " conditions of any kind either express or implied see the license for the specific language governing permissions and"
        " limitations under the license",
        ["except in compliance with the license", "unless required by applicable law"],
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following"
        " conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the"
        " following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and"
        " the following disclaimer in the documentation and or other materials provided with the distribution",
        ["source and binary forms", "conditions are met"],
    ),
    (
        "bsl-1",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying"
        " documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
        ["person or organization obtaining a copy", "use reproduce display distribute execute and transmit"],
    ),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    (
        "cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license",
        ["creative commons attribution sharealike"],
    ),
    ("cc0", "creative commons zero universal public domain dedication", ["public domain dedication"]),
    *_gnu("gpl-2", "general public license", 2),
    *_gnu("gpl-3", "general public license", 3),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
        " provided that the above copyright notice and this permission notice appear in all copies the software is provided as is"
        " and the author disclaims all warranties with regard to this software",
        ["with or without fee is hereby granted"],
    ),
    *_gnu("lgpl-3", "lesser general public license", 3),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation"
        " files the software to deal in the software without restriction including without limitation the rights to use copy modify"
        " merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is"
        " furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be"
        " included in all copies or substantial portions of the software",
        ["granted free of charge", "associated documentation files"],
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed"
        " with this file you can obtain one at",
        ["mozilla public license"],
    ),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0", ["mozilla public license version 2"]),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile"
        " sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non"
        " commercial and by any means",
        ["released into the public domain"],
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any"
        " damages arising from the use of this software permission is granted to anyone to use this software for any purpose"
        " including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        ["alter it and redistribute it freely"],
    ),
]
#: Words of five letters or more are indexed; shorter ones say little and stand everywhere.
INDEX_MIN = 5
CHOSEN, AGREE, SHIFT = 8, 3, 2

_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _normal(text: Column) -> Column:
    """The words, each with a space before and behind; one space if there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), lower_ascii(F.coalesce(text, F.lit(""))), F.lit(" ")), _SEPARATORS, " ")


def _words(norm: Column) -> Column:
    return F.when(norm == " ", F.array().cast("array<string>")).otherwise(F.split(F.btrim(norm), " ", -1))


def template_words(text: str) -> set[str]:
    return {w for w in text.split() if len(w) >= INDEX_MIN}


def index_words(templates: list[tuple] = TEMPLATES) -> list[str]:
    return sorted(set().union(*(template_words(text) for _, text, _ in templates)))


def _texts(words) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def scan(docs: DataFrame, templates: list[tuple] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base, present (index words), norm (of files that may be aligned, else null)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _normal(F.col("text")).alias("norm"))
    rows = rows.select("*", _words(F.col("norm")).alias("w"))

    def places(phrase: str) -> Column:
        own = phrase.split()
        return F.when(
            F.col("norm").contains(f" {phrase} "),
            F.filter(
                F.sequence(F.lit(0), F.size("w") - len(own)),
                lambda i: reduce(and_, (F.get("w", i + k) == x for k, x in enumerate(own))),
            ),
        ).otherwise(F.array().cast("array<int>"))

    found = rows.select(
        "doc_id", "norm", F.size("w").cast("long").alias("n_words"), F.array_intersect(_texts(index_words(templates)), F.col("w")).alias("present"),
        *(places(p).alias(f"p{k}") for k, p in enumerate(PHRASES)),
    )
    every = F.flatten(F.array(*(F.col(f"p{k}") for k in range(len(PHRASES)))))
    base = F.array_compact(F.array(*(F.when(F.size(f"p{k}") > 0, F.lit(x)) for k, x in enumerate(PHRASES.values()))))
    enough = reduce(
        lambda a, b: a | b, (F.size(F.array_intersect("present", _texts(sorted(template_words(text))))) >= AGREE for _, text, _ in templates)
    )
    return found.select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        base.alias("base"), "present", F.when((F.size("present") >= AGREE) & enough, F.col("norm")).alias("norm"),
    )


def frequencies(scanned: DataFrame) -> tuple[int, dict[str, int]]:
    """The number of documents, and of those with each index word: a row for each index word."""
    rows = scanned.select(F.explode("present").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    return scanned.count(), {r.word: r.n for r in rows}


def by_idf(words: set[str], n_docs: int, df: dict[str, int]) -> list[str]:
    return sorted(words, key=lambda w: (-math.log((1 + n_docs) / (1 + df.get(w, 0))), w))


def label(docs: DataFrame, templates: list[tuple] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    scanned = table(scan(docs, templates), "licenses")
    n_docs, df = frequencies(scanned)

    def own_rarest(k: int, text: str) -> Column:
        """The file's words of template k with the highest IDF, as "template:word"."""
        words = F.slice(F.array_intersect(_texts(by_idf(template_words(text), n_docs, df)), F.col("present")), 1, CHOSEN)
        return F.transform(words, lambda x: F.concat(F.lit(f"{k}:"), x))

    rarest = F.flatten(F.array(*(own_rarest(k, text) for k, (_, text, _) in enumerate(templates))))
    postings: dict[str, list[Column]] = {}
    for k, (_, text, _) in enumerate(templates):
        for at, word in enumerate(text.split()):
            if len(word) >= INDEX_MIN:
                postings.setdefault(word, []).append(F.struct(F.lit(k).alias("t"), F.lit(at).alias("at"), F.lit(f"{k}:{word}").alias("key")))
    index = F.create_map(*(x for word, own in sorted(postings.items()) for x in (F.lit(word), F.array(*own))))

    some = scanned.where("norm IS NOT NULL").withColumn("w", _words(F.col("norm"))).select(
        "*", rarest.alias("rarest"),
        F.filter(F.transform("w", lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda e: e["w"].isin(*index_words(templates))).alias("hits"),
    )
    votes = F.flatten(F.transform(
        "hits",
        lambda e: F.transform(
            F.filter(F.element_at(index, e["w"]), lambda p: F.array_contains("rarest", p["key"])),
            lambda p: F.struct(p["t"].alias("t"), (e["i"] - p["at"]).alias("start"), e["w"].alias("w")),
        ),
    ))
    some = some.withColumn("votes", F.array_sort(F.array_distinct(votes)))
    same = lambda a, b: (a["t"] == b["t"]) & (a["start"] == b["start"])
    most = F.aggregate(
        "votes", F.struct(F.lit(-1).alias("t"), F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(0).alias("best")),
        lambda acc, e: F.struct(
            e["t"].alias("t"), e["start"].alias("start"), F.when(same(acc, e), acc["n"] + 1).otherwise(1).alias("n"),
            F.greatest(acc["best"], F.when(same(acc, e), acc["n"] + 1).otherwise(1)).alias("best"),
        ),
        lambda acc: acc["best"],
    )
    # sorted votes of one start are neighbours, so the AGREE-th next one tells whether so many words meet there
    meets = F.filter("votes", lambda e, k: same(F.get("votes", k + AGREE - 1), e).eqNullSafe(True))
    aligned = F.array_distinct(F.transform(meets, lambda e: F.struct(e["t"].alias("t"), e["start"].alias("start"))))
    phrases = F.array(*(
        F.array(*(F.struct(F.lit(_place(text, p)).alias("at"), F.lit(len(p.split())).alias("n"), F.lit(f" {p} ").alias("text")) for p in own))
        for _, text, own in templates
    ))

    def stands(start: Column, p: Column) -> Column:
        begin = start + p["at"] + 1 - SHIFT
        own = F.slice("w", F.greatest(F.lit(1), begin), F.greatest(F.lit(0), p["n"] + 2 * SHIFT + F.least(F.lit(0), begin - 1)))
        return F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" ")).contains(p["text"])

    verified = F.filter("aligned", lambda c: F.forall(F.element_at(phrases, c["t"] + 1), lambda p: stands(c["start"], p)))
    names = _texts(name for name, _, _ in templates)
    own = F.transform(verified, lambda c: F.element_at(names, c["t"] + 1))
    some = some.select("*", aligned.alias("aligned"), most.alias("best")).select(*scanned.columns, own.alias("own"), "best")
    rest = scanned.where("norm IS NULL").select("*", _texts([]).alias("own"), F.lit(None).cast("int").alias("best"))
    every = some.unionByName(rest)
    labels = F.array_sort(F.array_distinct(F.concat("base", "own")))
    # a file without norm has too few words of any template to be aligned, but those it has still vote one by one
    votes_alone = F.when(F.size("present") > 0, F.lit(1)).otherwise(0)
    return every.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size(labels) > 0, F.lit(1.0)).otherwise(F.coalesce("best", votes_alone) / (CHOSEN + 1)).alias("score"),
    )


def _place(text: str, phrase: str) -> int:
    """The place, in words, where a phrase first stands in its template."""
    words, own = text.split(), phrase.split()
    return next(i for i in range(len(words)) if words[i : i + len(own)] == own)


def query(spark, sf_dir: str) -> DataFrame:
    return label(source(spark, sf_dir, "documents"))
