"""License scan by a positional index of rare template words. DataFrame functions only."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters A-Z are lowered before words are cut, so what is left of ASCII are digits and a-z.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A wording of a license: its words and the run of them that must stand as it is."""

    label: str
    words: str
    phrase: str


# The phrases of the base labels.
BASE = (
    Template("mit", "under the mit license", "under the mit license"),
    Template("apache-2", "apache license version 2", "apache license version 2"),
    Template("cc-by-nc", "cc by nc", "cc by nc"),
)
# Usual wordings of licenses, after the texts that their stewards publish.
TEMPLATES = (
    Template("agpl", "gnu affero general public license version 3", "gnu affero general public license"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc0", "creative commons zero v1 0 universal", "creative commons zero"),
    Template("gpl-2", "gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3", "gnu general public license version 3", "gnu general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose",
             "permission to use copy modify and or distribute this software"),
    Template("lgpl", "gnu lesser general public license version", "gnu lesser general public license"),
    Template("mit", "released under the mit license", "under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "permission is hereby granted free of charge"),
    Template("mpl-2", "mozilla public license version 2 0", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             "free and unencumbered software"),
)


def words_of(text: str) -> Column:
    """Words of a text column, A-Z lowered; null has none."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lowered = F.translate(value, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def document_frequency(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows each word of a fixed vocabulary stands; one pass over all rows."""
    wanted = F.array(*[F.lit(w) for w in vocabulary])
    seen = words.select(F.explode(F.array_intersect("words", wanted)).alias("word"))
    return dict(seen.groupBy("word").count().collect())  # at most one row per vocabulary word


def _find(phrase: list[str], words: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def scan_licenses(
    docs: DataFrame,
    templates: tuple[Template, ...] = TEMPLATES,
    base: tuple[Template, ...] = BASE,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Licenses named in every document: one row per input row.

    All documents are counted first: of each template's mandatory phrase the two words with
    the highest inverse document frequency become its index words. A document's places of
    first index words are then looked up; a place holds if the second word stands at its
    distance and, verified last, the whole phrase stands around it. Every place of a phrase
    holds its index words, so none is missed.

    Columns: ``doc_id``, ``n_words``, ``n_base`` (places of base phrases), ``first_word`` and
    ``last_word`` (their smallest and largest start, from 0, or null), ``base_labels``,
    ``labels`` (distinct, sorted, joined by commas; those of ``templates`` too), ``score`` (the
    largest share of a found template's words that stand in their places; 0 without any).
    Null and empty texts have no words and no labels. Repeated rows and null or repeated ids
    pass through row by row; other columns are not read. An empty table gives an empty one.
    """
    everything = [*base, *templates]
    phrases = [t.phrase.split() for t in everything]
    words = docs.select(F.col(doc_id).alias("doc_id"), words_of(text).alias("words"))
    vocabulary = sorted({w for p in phrases for w in p})
    known = document_frequency(words, vocabulary)

    postings: dict[str, list[Column]] = {}
    for number, (template, phrase) in enumerate(zip(everything, phrases)):
        # Fewest documents first: the highest inverse document frequency.
        ranked = sorted(set(phrase), key=lambda w: (known.get(w, 0), w))
        if not known.get(ranked[0]):
            continue  # a word that no document has
        first, second = ranked[0], ranked[min(1, len(ranked) - 1)]
        whole = template.words.split()
        posting = F.struct(
            F.lit(template.label).alias("label"),
            F.lit(number < len(base)).alias("base"),
            F.lit(phrase.index(first)).alias("at"),
            F.lit(phrase.index(second) - phrase.index(first)).alias("distance"),
            F.lit(second).alias("second"),
            F.array(*[F.lit(w) for w in phrase]).alias("phrase"),
            F.lit(_find(phrase, whole)).alias("offset"),
            F.array(*[F.lit(w) for w in whole]).alias("whole"),
        )
        postings.setdefault(first, []).append(posting)

    counted = words.withColumn("n_words", F.size("words").cast("bigint"))
    if postings:
        index = F.map_from_arrays(F.array(*[F.lit(w) for w in postings]), F.array(*[F.array(*p) for p in postings.values()]))
        everywhere = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1))
        hit = F.filter(everywhere, lambda i: F.get("words", i).isin(list(postings)))

        def verified(i: Column, p: Column) -> Column:
            start = i - p["at"]
            near = F.get("words", i + p["distance"]) == p["second"]
            return (start >= 0) & F.coalesce(near, F.lit(False)) & (F.slice("words", start + 1, F.size(p["phrase"])) == p["phrase"])

        def place(i: Column, p: Column) -> Column:
            start = i - p["at"]
            origin = start - p["offset"]
            same = F.filter(
                F.sequence(F.lit(0), F.size(p["whole"]) - 1),
                lambda j: F.coalesce(F.get("words", origin + j) == F.get(p["whole"], j), F.lit(False)),
            )
            return F.struct(
                p["label"].alias("label"),
                p["base"].alias("base"),
                start.cast("bigint").alias("start"),
                (F.size(same) / F.size(p["whole"])).alias("share"),
            )

        at_hit = lambda i: F.transform(
            F.filter(F.element_at(index, F.get("words", i)), lambda p: verified(i, p)), lambda p: place(i, p)
        )
        # Two steps, so that the places are looked for once and then used several times.
        counted = counted.withColumn("hits", F.coalesce(hit, F.array().cast("array<int>")))
        counted = counted.withColumn("places", F.flatten(F.transform("hits", at_hit)))
    else:
        counted = counted.withColumn("places", F.array().cast("array<struct<label:string,base:boolean,start:bigint,share:double>>"))
    of_base = F.filter("places", lambda p: p["base"])
    starts = F.transform(of_base, lambda p: p["start"])

    def joined(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    return counted.select(
        F.col("doc_id").alias(doc_id),
        "n_words",
        F.size(of_base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(of_base).alias("base_labels"),
        joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The same rows in DuckDB's SQL: every phrase is looked for at every word."""

    def listed(words: str) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"

    parts = []
    for number, t in enumerate([*BASE, *TEMPLATES]):
        phrase, whole = t.phrase.split(), t.words.split()
        offset = _find(phrase, whole)
        same = " + ".join(
            f"coalesce(cast(case when i + {j - offset} >= 1 then words[i + {j - offset}] = '{w}' end as int), 0)" for j, w in enumerate(whole)
        )
        parts.append(
            f"select doc_id, '{t.label}' as label, {str(number < len(BASE)).lower()} as base, i - 1 as start, ({same}) / {len(whole)}::double as share "
            f"from spots where words[i] = '{phrase[0]}' and words[i:i + {len(phrase) - 1}] = {listed(t.phrase)}"
        )
    return f"""
with words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
                                                '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as words
  from documents),
spots as (select doc_id, words, unnest(range(1, len(words) + 1)) as i from words),
places as ({" union all ".join(parts)}),
found as (
  select doc_id, count(*) filter (base) as n_base, min(start) filter (base) as first_word, max(start) filter (base) as last_word,
         string_agg(distinct label, ',' order by label) filter (base) as base_labels,
         string_agg(distinct label, ',' order by label) as labels, max(share) as score
  from places group by doc_id)
select w.doc_id, len(w.words) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0) as score
from words w left join found f on w.doc_id = f.doc_id"""
