"""License scans: a positional index of rare licence words, checked by relative position."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATORS, lower_ascii, table

#: (label, phrase): base phrases, whose every place counts.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Fixed values: (label, template, mandatory key phrase). Notices as licences word them, words as the scan takes
#: them; words outside the key phrase may differ.
TEMPLATES = (
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "except in compliance with the license you may obtain a copy of the license at",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistribution and use in source and binary forms",
    ),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    (
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "under the terms of the gnu general public license as published by the free software foundation",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
        "with or without fee is hereby granted",
    ),
    ("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    ("mit", "released under the mit license", "the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "permission is hereby granted free of charge to any person obtaining a copy",
    ),
    ("mpl-2", "mozilla public license version 2 0", "mozilla public license"),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        "subject to the terms of the mozilla public license",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "free and unencumbered software released into the public domain",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        "to alter it and redistribute it freely",
    ),
)
#: A template counts where at least so much of its words' IDF stands in place.
MIN_MATCH = 0.6


def with_parts(rows: DataFrame) -> DataFrame:
    """(_id, n_words, _parts): words in order as they are written; the last may be empty.

    The array of words is a column of its own, so that it is made once a row and
    not again for each use in a lambda.
    """
    text = F.regexp_replace(F.coalesce(F.col("_text"), F.lit("")), "^" + SEPARATORS, "")
    parts = F.col("_parts")
    empty_end = F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return rows.select("_id", F.split(text, SEPARATORS).alias("_parts")).select("_id", "_parts", (F.size(parts) - empty_end).cast("long").alias("n_words"))


def _templates(base, templates) -> list[dict]:
    out = []
    for label, phrase, key, is_base in [(a, b, b, True) for a, b in base] + [(a, b, c, False) for a, b, c in templates]:
        words, keyed = phrase.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(keyed)] == keyed)
        out.append({"label": label, "words": words, "key": list(range(at, at + len(keyed))), "base": is_base})
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES, min_match: float = MIN_MATCH) -> DataFrame:
    """Find licence phrases and templates in every whole text.

    The licence words' document frequencies over all rows give each word's IDF. A
    template is indexed under the highest-IDF word of its mandatory key phrase: as the
    key phrase must stand in place, no occurrence is lost. The places of indexed words
    in a text give (template, start) candidates; at each the key phrase is verified
    first, then the template's postings are intersected with the text's by relative
    position: the share of the template's IDF that stands in place is its score. A
    base phrase is its own key phrase. Words are looked up by place, so a row's work
    follows its words and its candidates' templates, however often a phrase repeats.

    Plan: two passes over the texts without a shuffle of them, and one small
    aggregation between (a record a licence word).

    Null and empty texts have no words, no labels and score 0; a very long text is
    one array of words; repeated rows and null or repeated ids give a row each; equal
    scores need no order, as the highest is given. An empty table gives no rows; other
    columns take no part.

    Returns ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels,
    score, and matches: array of (label, start, score).
    """
    ts = _templates(base, templates)
    vocabulary = sorted({w for t in ts for w in t["words"]})
    rows = with_parts(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")))
    licence = lambda words: F.filter(F.transform(F.filter("_parts", lambda w: F.lower(w).isin(words)), lower_ascii), lambda w: w.isin(words))
    seen = rows.select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct(licence(vocabulary)))).alias("w"))
    counts = {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each licence word
    total = counts.get("", 0)
    idf = {w: math.log((1 + total) / (1 + counts.get(w, 0))) + 1 for w in vocabulary}

    index: dict[str, list[tuple[int, int]]] = {}
    for t, x in enumerate(ts):
        k = max(x["key"], key=lambda i: (idf[x["words"][i]], -i))
        index.setdefault(x["words"][k], []).append((t, k))
    array = lambda xs: F.array(*[F.lit(x) for x in xs])
    arrays = lambda xss: F.array(*[array(xs) for xs in xss])
    words, keys = arrays([x["words"] for x in ts]), arrays([x["words"][x["key"][0] : x["key"][-1] + 1] for x in ts])
    key_at = array([x["key"][0] for x in ts])
    weight = arrays([[idf[w] / sum(idf[v] for v in x["words"]) for w in x["words"]] for x in ts])
    is_base, labels = array([x["base"] for x in ts]), array([x["label"] for x in ts])
    lookup = F.create_map(*[c for w, es in index.items() for c in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")) for t, k in es]))])

    places = F.filter(F.transform("_parts", lambda w, i: F.struct(i.alias("p"), F.when(F.lower(w).isin(list(index)), lower_ascii(w)).alias("w"))), lambda x: x["w"].isin(list(index)))
    found = F.flatten(F.transform(places, lambda x: F.transform(F.element_at(lookup, x["w"]), lambda e: F.struct(e["t"].alias("t"), (x["p"] - e["k"]).alias("s")))))

    def keyed(c: Column) -> Column:
        at = c["s"] + F.get(key_at, c["t"])
        here = F.slice("_parts", F.greatest(at, F.lit(0)) + 1, F.size(F.get(keys, c["t"])))
        return (at >= 0) & (F.transform(here, lower_ascii) == F.get(keys, c["t"]))

    def scored(c: Column) -> Column:
        # each array is made once a candidate; a template may begin before the text
        skip, size = F.greatest(-c["s"], F.lit(0)), F.size(F.get(words, c["t"]))
        here = F.slice("_parts", F.greatest(c["s"], F.lit(0)) + 1, size)
        same = F.zip_with(F.slice(F.get(words, c["t"]), skip + 1, size), here, lambda mine, w: lower_ascii(w) == mine)
        sums = F.aggregate(F.zip_with(F.slice(F.get(weight, c["t"]), skip + 1, size), same, lambda w, m: F.when(m, w).otherwise(0.0)), F.lit(0.0), lambda a, w: a + F.coalesce(w, F.lit(0.0)))
        got = F.when(F.get(is_base, c["t"]), F.lit(1.0)).otherwise(sums)
        return F.struct(F.get(labels, c["t"]).alias("label"), c["s"].cast("long").alias("start"), F.least(F.lit(1.0), F.round(got, 9)).alias("score"), F.get(is_base, c["t"]).alias("base"))

    out = rows.select("_id", "n_words", "_parts", found.alias("found")).select("_id", "n_words", F.transform(F.filter("found", keyed), scored).alias("all"))
    out = out.withColumn("all", F.filter("all", lambda c: c["base"] | (c["score"] >= min_match)))
    out = out.withColumn("starts", F.transform(F.filter("all", lambda c: c["base"]), lambda c: c["start"]))
    named = lambda keep: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("all", keep), lambda c: c["label"]))), ",")
    return out.select(
        F.col("_id").alias(id_col),
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        named(lambda c: c["base"]).alias("base_labels"),
        named(lambda c: F.lit(True)).alias("labels"),
        F.coalesce(F.array_max(F.transform("all", lambda c: c["score"])), F.lit(0.0)).alias("score"),
        F.transform("all", lambda c: F.struct(c["label"], c["start"], c["score"])).alias("matches"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


QUERIES = {"op4_license_scan": op4_license_scan}


def _sql() -> str:
    """The same by comparing every place of every text with every template."""
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    rows = ",\n".join(f"({t}, '{x['label']}', {x['base']}, {quoted(x['words'])}, {x['key'][0]}, {quoted(x['words'][x['key'][0] : x['key'][-1] + 1])})" for t, x in enumerate(_templates(BASE, TEMPLATES)))
    return f"""
WITH t(t, label, base, words, k, key) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT DISTINCT unnest(words) AS word FROM t),
n AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT r, unnest(w) AS word FROM d) WHERE word IN (SELECT word FROM v) GROUP BY word),
idf AS (SELECT word, ln((1 + (SELECT count(*) FROM d)) / (1 + coalesce(n, 0))::DOUBLE) + 1 AS x FROM v LEFT JOIN n USING (word)),
tw AS (SELECT t, i, words[i + 1] AS word, x / sum(x) OVER (PARTITION BY t) AS weight FROM (SELECT t, words, unnest(range(len(words))) AS i FROM t) JOIN idf ON words[i + 1] = word),
p AS (SELECT r, w, unnest(range(len(w))) AS p FROM d),
c AS (SELECT r, w, t, label, base, p - k AS s FROM p JOIN t ON w[p + 1] = key[1] AND w[p + 1:p + len(key)] = key),
m AS (SELECT r, t, label, base, s, least(1.0, round(sum(CASE WHEN s + i >= 0 AND w[s + i + 1] = word THEN weight ELSE 0 END), 9)) AS score FROM c JOIN tw USING (t) GROUP BY r, t, label, base, s),
kept AS (SELECT * FROM m WHERE base OR score >= {MIN_MATCH}),
g AS (SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
      string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(CASE WHEN base THEN 1.0 ELSE score END) AS score FROM kept GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN g USING (r)
"""


SQL = {"op4_license_scan": _sql()}
