"""License scans as an exact set-similarity join, in DataFrame functions only.

Base: places where a phrase's words stand consecutively in a document's words.

Method: a text block is a run of up to BLOCK words, or twice a template's words if that is
more; it may start at any word. A block meets a template if it holds at least ``threshold``
of the template's distinct words. Texts are cut into stretches of two blocks that start at
every block, so each block lies whole in the stretch in which it starts. The words of
templates are ordered by how many documents hold them, rarest first:

* prefix filter: a stretch that misses at most |T| - need words of T holds one of the
  |T| - need + 1 rarest, so stretches and templates are joined on those words alone;
* length filter: a stretch needs at least `need` template words in all;
* positional filter: pairs are kept at their first shared word only, so if it stands at place i
  of T and place j of the stretch's ordered words, common words are at most 1 + min(what follows
  either);
* candidates are verified by the size of the intersection with every block that starts at a
  word of the template, as no other block holds more.

Only the order of the template vocabulary (a constant number of rows) comes to the driver.

Defined cases: null and empty text have no words, no labels and score 0; repeated rows are
scanned each on its own; equal frequencies are ordered by the word; blocks of one document
count once per label; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

BLOCK, THRESHOLD = 64, 0.9
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Opening statements of well-known licenses.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}


def normal(text: str = "text") -> Column:
    """The words of a text joined by single spaces."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, NOT_WORD, " "))


def words_of(norm: Column) -> Column:
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def row_name(key: str, text: str) -> list[Column]:
    body = F.coalesce(F.col(text), F.lit(""))
    return [F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.xxhash64(body).alias("t"), F.octet_length(body).alias("nb")]


def token_order(docs: DataFrame, templates: dict[str, str] = TEMPLATES, text: str = "text") -> list[str]:
    """The templates' words by document frequency over all documents, rarest first, ties by word."""
    vocab = sorted({w for t in templates.values() for w in t.split()})
    held = F.array_intersect(words_of(normal(text)), F.array(*map(F.lit, vocab)))
    counts = docs.select(F.explode(held).alias("w")).groupBy("w").count()
    found = {r["w"]: r["count"] for r in counts.collect()}  # at most as many rows as vocab
    return sorted(vocab, key=lambda w: (found.get(w, 0), w))


def matches(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (k, t, nb, label, containment): every (document, template) with a block that meets the threshold.

    A document is told by its key as a string, a hash of its text and the text's bytes.
    """
    spark = docs.sparkSession
    order = token_order(docs, templates, text)
    place = {w: i for i, w in enumerate(order)}
    sets = {name: sorted({place[w] for w in t.split()}) for name, t in templates.items()}
    need = {name: math.ceil(threshold * len(s) - 1e-9) for name, s in sets.items()}
    span = {name: max(BLOCK, 2 * len(t.split())) for name, t in templates.items()}
    most = max(span.values())
    prefix = [(p, name, i, len(s), need[name], span[name], s, [order[p] for p in s]) for name, s in sets.items() for i, p in enumerate(s[: len(s) - need[name] + 1])]
    probes = spark.createDataFrame(prefix, "p int, label string, i int, size int, need int, span int, members array<int>, told array<string>")
    places = F.create_map(*[F.lit(x) for w in order for x in (w, place[w])])
    rare = F.array(*[F.lit(order[p]) for p in sorted({x[0] for x in prefix})])
    words = docs.select(*row_name(key, text), words_of(normal(text)).alias("words")).filter(F.arrays_overlap("words", rare))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(most))
    vocab = F.array(*map(F.lit, order))
    name = ["k", "t", "nb"]
    near = F.transform(starts, lambda s: F.slice("words", s + 1, 2 * most))
    blocks = words.select(*name, F.explode(F.transform(near, lambda w: F.struct(w.alias("near"), F.array_intersect(w, vocab).alias("held")))).alias("s")).select(*name, "s.*")
    blocks = blocks.filter(F.size("held") >= min(need.values())).filter(F.arrays_overlap("held", rare))
    blocks = blocks.select(*name, "near", F.array_sort(F.transform("held", lambda w: F.element_at(places, w))).alias("b"))
    tokens = blocks.select(*name, "near", "b", F.posexplode("b").alias("j", "p"))
    shared = F.array_intersect("members", "b")
    pairs = tokens.join(F.broadcast(probes), "p")  # one row for each prefix word: a constant
    pairs = pairs.filter((F.size("b") >= F.col("need")) & (F.least(F.col("size") - F.col("i"), F.size("b") - F.col("j")) >= F.col("need")))
    pairs = pairs.filter((shared[0] == F.col("p")) & (F.size(shared) >= F.col("need")))
    begins = F.filter(F.transform(F.slice("near", 1, most), lambda w, i: F.when(F.array_contains("told", w), i + 1)), lambda i: i.isNotNull())
    common = F.array_max(F.transform(begins, lambda i: F.size(F.array_intersect("told", F.slice("near", i, F.col("span"))))))
    pairs = pairs.withColumn("common", common).filter(F.col("common") >= F.col("need"))
    return pairs.groupBy(*name, "label").agg(F.max(F.col("common") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: base places, labels of base and method, score."""
    found = matches(docs, key, text, templates, threshold).groupBy("k", "t", "nb").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    x = docs.select(key, *row_name(key, text), normal(text).alias("norm")).withColumns({"padded": F.concat(F.lit(" "), F.col("norm"), F.lit(" "))})
    gaps = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    n_words = F.when(F.col("norm") == "", 0).otherwise(gaps(F.col("norm")) + 1)
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE.items():
        held = F.col("padded").contains(f" {phrase} ")
        counts.append(F.when(held, F.regexp_count("padded", F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0))
        firsts.append(F.when(held, gaps(F.substring_index("padded", f" {phrase} ", 1))))
        lasts.append(F.when(held, n_words - gaps(F.substring_index("padded", f" {phrase} ", -1)) - len(phrase.split())))
        labels.append(F.when(held, F.lit(label)))
    x = x.select("k", "t", "nb", F.col(key).alias("_key"), n_words.cast("long").alias("n_words"), sum(counts[1:], counts[0]).cast("long").alias("n_base"), F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"), F.array_compact(F.array(*labels)).alias("base"))
    x = x.join(found, ["k", "t", "nb"], "left")
    both = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return x.select(F.col("_key").alias(key), "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """Every block that starts at a word of a template against every template, by intersection. No template needs a block of more than BLOCK words."""
    templates = ", ".join(f"('{k}', {sorted(set(v.split()))!r})" for k, v in TEMPLATES.items())
    doubled, phrases = "' ' || replace(norm, ' ', '  ') || ' '", list(BASE.items())
    q = {p: f"' {p.replace(' ', '  ')} '" for p in BASE}
    words_in = lambda s: f"(length({s}) - length(replace({s}, ' ', ''))) // 2"
    n = {p: f"((length(dd) - length(replace(dd, {x}, ''))) // {len(p.replace(' ', '  ')) + 2})" for p, x in q.items()}
    first = {p: f"CASE WHEN {n[p]} > 0 THEN {words_in(f'split_part(dd, {x}, 1)')} END" for p, x in q.items()}
    last = {p: f"CASE WHEN {n[p]} > 0 THEN n_words - {words_in(f'split_part(dd, {x}, -1)')} - {len(p.split())} END" for p, x in q.items()}
    return f"""
WITH t(label, members) AS (VALUES {templates}),
v AS (SELECT list_distinct(flatten(list(members))) AS vocab FROM t),
d AS (SELECT row_number() OVER () AS r, doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{NOT_WORD}', ' ', 'g'), ' ') AS norm FROM documents),
w AS (SELECT r, doc_id, norm, {doubled} AS dd, CASE WHEN norm = '' THEN [] ELSE string_split(norm, ' ') END AS words, CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END AS n_words FROM d),
b AS (SELECT r, list_distinct(words[s + 1 : s + {BLOCK}]) AS block FROM (SELECT r, words, unnest(range(0, n_words)) AS s FROM w), v WHERE list_contains(vocab, words[s + 1])),
m AS (SELECT r, label, max(len(list_intersect(block, members)) / len(members)) AS c FROM b, t WHERE len(list_intersect(block, members)) >= ceil({THRESHOLD} * len(members) - 1e-9) GROUP BY ALL),
f AS (SELECT r, list(label) AS found, max(c) AS best FROM m GROUP BY r),
p AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {n[p]} > 0 THEN '{label}' END" for p, label in phrases)}], lambda v: v IS NOT NULL) AS base FROM w LEFT JOIN f USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, ({' + '.join(n.values())})::BIGINT AS n_base,
  least({', '.join(first.values())})::BIGINT AS first_word, greatest({', '.join(last.values())})::BIGINT AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') AS labels,
  CASE WHEN len(base) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM p"""


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLE = {"op1_license_scan": _oracle()}
