"""Operator 6: licence scans by a positional index of rare words, with built-in functions only.

Each known notice is a word sequence. Its words are weighed by inverse document frequency over the scanned table,
and its rarest words with their places are its postings. A text's licence words look up these postings, place
minus place gives where the notice would start, starts on which enough weight agrees are candidates, and a
candidate counts when the mandatory key phrases stand at their places. Beside it stand fixed base phrases.

Everything about one text happens in its row: the index is a small literal, there is no shuffle of texts, and a
skewed key or a group of copies costs no more than its bytes. Only word counts over the notices' vocabulary
(a few hundred words) are aggregated.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import CARRIED, ascii_lower, carry, unpack

#: What is no part of a word, base phrases with their labels.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices as (label, words, mandatory key phrases).
NOTICES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "this project is licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ["gnu general public license", "version 3 of the license"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ["gnu general public license", "version 2 of the license"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl-3", "under the terms of the gnu affero general public license", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("bsl-1", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
    ("wtfpl", "do what the fuck you want to public license", ["what the fuck you want to public license"]),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    ("eupl-1.2", "licensed under the eupl version 1 2", ["eupl version 1 2"]),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", ["common development and distribution license"]),
    ("artistic-2", "licensed under the artistic license 2 0", ["artistic license 2 0"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international license"]),
]
#: Rarest words of a notice that are its postings; the share of their weight that must agree on one start.
RARE_WORDS, MIN_SHARE = 8, 0.7


def words(text: Column) -> Column:
    """Lower-cased words of a text; a null text has none. Letters other than A-Z may be lower-cased too, which no ASCII phrase can tell."""
    t = F.coalesce(text, F.lit(""))
    # beyond A-Z, lower() puts an ASCII letter only for these two
    odd = t.contains("\u212a") | t.contains("\u0130")
    return F.array_remove(F.split(F.when(odd, ascii_lower(t)).otherwise(F.lower(t)), NO_WORD), "")


def document_frequencies(df: DataFrame, words_col: str) -> tuple[int, dict[str, int]]:
    """Rows, and the number of rows that hold each word of the notices. Bounded by the notices' vocabulary."""
    vocabulary = sorted({w for _, t, _ in NOTICES for w in t.split()})
    known = F.array_intersect(F.col(words_col), F.array(*map(F.lit, vocabulary)))
    counts = df.select(F.explode(F.concat(F.array(F.lit("")), known)).alias("w")).groupBy("w").count().collect()
    found = {r["w"]: r["count"] for r in counts}
    return found.pop("", 0), found


def _index(rows: int, found: dict[str, int]) -> tuple[Column, list[str], list[str]]:
    """The notices as an array literal: label, total weight, postings (word, place, weight), key phrases at their places.

    Also the words of all postings, and anchors: of each notice its rarest words without which the others cannot
    reach MIN_SHARE, so that a text without any anchor names no notice.
    """

    def idf(w: str) -> float:
        return round(math.log((1 + rows) / (1 + found.get(w, 0))) + 0.01, 6)

    out, posted, anchors = [], set(), set()
    for label, text, phrases in NOTICES:
        seq = text.split()
        rare = sorted(sorted(range(len(seq)), key=lambda i: (-idf(seq[i]), i))[:RARE_WORDS])
        posted |= {seq[i] for i in rare}
        left = total = sum(idf(seq[i]) for i in rare)
        for w in sorted({seq[i] for i in rare}, key=lambda w: (-idf(w), w)):
            if left < MIN_SHARE * total - 1e-6:
                break
            anchors.add(w)
            left -= idf(w) * sum(seq[i] == w for i in rare)
        keys = []
        for p in phrases:
            k = p.split()
            at = next(i for i in range(len(seq)) if seq[i : i + len(k)] == k)
            keys.append(F.struct(F.lit(at).alias("at"), F.array(*map(F.lit, k)).alias("words")))
        out.append(
            F.struct(
                F.lit(label).alias("label"),
                F.lit(total).alias("total"),
                F.array(*(F.struct(F.lit(seq[i]).alias("w"), F.lit(i).alias("p"), F.lit(idf(seq[i])).alias("x")) for i in rare)).alias("rare"),
                F.array(*keys).alias("keys"),
            )
        )
    return F.array(*out), sorted(posted), sorted(anchors)


def _found(index: Column, tokens: Column, all_words: Column) -> Column:
    """For each notice (label, best share of agreeing weight among its verified starts)."""

    def one(t: Column) -> Column:
        hits = F.flatten(F.transform(tokens, lambda k: F.transform(F.filter(t["rare"], lambda p: p["w"] == k["w"]), lambda p: F.struct((k["p"] - p["p"]).alias("start"), p["x"].alias("x")))))

        def agreeing(h: Column) -> Column:
            # hits of one start are neighbours, one a posting at most, so a start looks at a fixed number of them
            begins = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == 0) | (F.get(h, i - 1)["start"] != F.get(h, i)["start"]))
            weight = lambda i: reduce(lambda a, b: a + b, (F.when(F.get(h, i + k)["start"] == F.get(h, i)["start"], F.get(h, i + k)["x"]).otherwise(F.lit(0.0)) for k in range(RARE_WORDS)))
            weighed = F.transform(begins, lambda i: F.struct(F.get(h, i)["start"].alias("start"), (weight(i) / t["total"]).alias("share")))
            verified = F.filter(
                weighed,
                lambda c: (c["share"] >= MIN_SHARE) & F.forall(t["keys"], lambda k: F.when(c["start"] + k["at"] >= 0, F.slice(all_words, c["start"] + k["at"] + 1, F.size(k["words"])) == k["words"]).otherwise(False)),
            )
            return F.when(F.size(h) > 0, F.array_max(F.transform(verified, lambda c: c["share"])))

        return F.struct(t["label"].alias("label"), F.get(F.transform(F.array(F.array_sort(hits)), agreeing), F.lit(0)).alias("share"))

    return F.filter(F.transform(index, one), lambda r: r["share"].isNotNull())


def scan(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with the licences of ``text_col``.

    n_words; n_base, first_word, last_word (all places of the base phrases; null where there is none); base_labels
    and labels (distinct, sorted, comma-joined; labels also has the notices found); score (1 with a base phrase,
    else the best agreeing share). A null or empty text has no words, no labels and score 0. Repeated rows stay.
    """
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    split = df.select(carry(df, keep), words(F.col(text_col)).alias("_words"))
    rows, found = document_frequencies(split, "_words")
    index, rare, anchors = _index(rows, found)
    # words between double spaces, so that neighbouring places of a phrase share no character
    out = split.withColumn("_joined", F.concat(F.lit(" "), F.array_join("_words", "  "), F.lit(" ")))
    per_phrase = []
    for k, phrase in enumerate(BASE):
        seq = phrase.split()
        parts = F.when(F.col("_joined").contains(mark := f" {'  '.join(seq)} "), F.split("_joined", mark))
        out = out.withColumn(f"_parts{k}", parts)
        p = F.col(f"_parts{k}")
        spaces = lambda c: ((F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))) / 2).cast("long")
        n = F.coalesce(F.size(p) - 1, F.lit(0)).cast("long")
        per_phrase.append((n, F.when(p.isNotNull(), spaces(F.get(p, F.lit(0)))), F.when(p.isNotNull(), F.size("_words") - spaces(F.element_at(p, -1)) - len(seq))))
    base_labels = F.array_compact(F.array(*(F.when(F.col(f"_parts{k}").isNotNull(), F.lit(label)) for k, label in enumerate(BASE.values()))))
    lookup = F.arrays_overlap("_words", F.array(*map(F.lit, anchors)))
    tokens = F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.alias("p"))), lambda e: e["w"].isin(*rare))
    out = out.select(
        CARRIED,
        F.size("_words").cast("long").alias("n_words"),
        sum((n for n, _, _ in per_phrase[1:]), per_phrase[0][0]).alias("n_base"),
        F.array_min(F.array(*(a for _, a, _ in per_phrase))).alias("first_word"),
        F.array_max(F.array(*(b for _, _, b in per_phrase))).cast("long").alias("last_word"),
        base_labels.alias("_base"),
        "_words",
        F.when(lookup, tokens).alias("_tokens"),
    )
    out = out.withColumn("_found", F.when(F.size("_tokens") >= 2, _found(index, F.col("_tokens"), F.col("_words")))).drop("_words", "_tokens")
    known = F.coalesce(F.transform("_found", lambda r: r["label"]), F.array().cast("array<string>"))
    named = {c: F.col(c) for c in ("n_words", "n_base", "first_word", "last_word")}
    best = F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("_found", lambda r: r["share"])), F.lit(0.0)))
    return unpack(
        out, keep, **named,
        base_labels=F.array_join(F.array_sort(F.array_distinct("_base")), ","),
        labels=F.array_join(F.array_sort(F.array_distinct(F.concat("_base", known))), ","),
        score=F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(best),
    )
