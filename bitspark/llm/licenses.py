"""Licence scans.

Templates are notices and whole licence texts, cut into passages of at most ``STEP`` words; three dots stand
for what may come between two of them.  A file is read
through windows of ``2 * STEP`` words, so that every passage that it holds lies whole in one of them, wherever
lines are broken.  Windows and passages are sparse TF-IDF vectors over words and pairs of neighbouring words; a
window is compared with a passage by the cosine over the passage's own terms, so that words round a notice
can't dilute it, and document frequencies are those of the templates, so that a verdict doesn't depend on
how large the corpus is.  A template's score is the mean of its passages' best cosines in the file.

What tells licences of a family apart is a word or a number, which a cosine hardly weighs.  So names are read first:
every way to write a licence's name and version becomes one word (``gpl30``, ``lgpl21``, ``ccbysa40``), in
templates and in texts alike, and a passage that holds such a word is found only where the window holds it too.

A file without a licence of its own inherits that of the nearest directory above it that holds a licence
file, by joins of paths with their ancestors.  DataFrame operations only.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitspark.llm.quality import let
from bitspark.llm.scratch import Stored, small

# How names of licences and their versions are written, each pattern to become what stands beside it; \1 is its first group.
# Words are lower case, with a space on either side of each, so that neighbours have two between them.
SPELLINGS = [
    (r" licence ", " license "), (r" v(\d) ", r" \1 "), (r" (?:version|ver|v)  (\d) ", r" \1 "), (r" ([al]?)gplv?(\d) ", r" \1gpl  \2 "), (r" (?:lesser|library)  general  public  license ", " lgpl "),
    (r" affero  general  public  license ", " agpl "), (r" general  public  license ", " gpl "), (r" (?:lesser|library)  gpl ", " lgpl "), (r" affero  gpl ", " agpl "), (r" mozilla  public  license ", " mpl "),
    (r" apache  (?:software  )?license ", " apache "), (r" ([al]?)gpl  as  published  by  the  free  software  foundation  (?:either  )?(\d) ", r" \1gpl  \2 "),
    (r" (\d)  (\d)  of  the  (?:gnu  )?([al]?)gpl ", r" \3gpl  \1  \2 "), (r" (\d)  of  the  (?:gnu  )?([al]?)gpl ", r" \2gpl  \1 "), (r" ([al]?)gpl  (\d)  (\d) ", r" \1gpl\2\3 "), (r" ([al]?)gpl  (\d) ", r" \1gpl\g<2>0 "),
    (r" mpl  (\d)  (\d) ", r" mpl\1\2 "), (r" mpl  (\d) ", r" mpl\g<1>0 "), (r" apache  (\d)  (\d) ", r" apache\1\2 "), (r" apache  (\d) ", r" apache\g<1>0 "), (r" two  clause ", " 2  clause "), (r" three  clause ", " 3  clause "),
    (r" bsd  (\d)  clause ", r" bsd\1 "), (r" (\d)  clause  bsd ", r" bsd\1 "), (r" simplified  bsd ", " bsd2 "), (r" (?:new|modified|revised)  bsd ", " bsd3 "),
    (r" non  commercial ", " nc "), (r" noncommercial ", " nc "), (r" no  derivatives ", " nd "), (r" noderivatives ", " nd "), (r" noderivs ", " nd "), (r" share  alike ", " sa "), (r" sharealike ", " sa "),
    (r" (?:creative  commons|cc)  zero ", " cc0 "), (r" creative  commons  attribution ", " cc  by "), (r" attribution  (nc|sa|nd|\d) ", r" cc  by  \1 "), (r" creative  commons  by ", " cc  by "),
    (r" cc  by  (nc|sa|nd)  (sa|nd)  (\d)  (\d) ", r" ccby\1\2\3\4 "), (r" cc  by  (nc|sa|nd)  (\d)  (\d) ", r" ccby\1\2\3 "), (r" cc  by  (\d)  (\d) ", r" ccby\1\2 "), (r" cc0  (\d)  (\d) ", r" cc0\1\2 "),
    (r" not  (?:be  )?(?:licensed|released|distributed|available)  under  (?:the  )?(?:gnu  )?[^ ]+ ", " notunder "),
]
#: Words without one of which a text is left as it is written.
CUES = ["license", "licence", "licensed", "licenses", "released", "gpl", "lgpl", "agpl", "gplv2", "gplv3", "lgplv2", "lgplv3", "agplv3", "gpl2", "gpl3", "lgpl2", "lgpl3", "agpl3", "mpl", "apache", "bsd", "cc", "cc0", "creative", "attribution"]
#: What names are once they are read: a passage is found only where these words of it are.
IDENTITY = re.compile(r"[al]?gpl\d\d|mpl\d\d|apache\d\d|bsd\d|ccby\w*\d\d|cc0\d\d|mit|isc|unlicense")

# Names of the licences, in full (after "the") and short.
FULL_NAMES = {
    "MIT": ("MIT License", "MIT"), "ISC": ("ISC License", "ISC"), "Unlicense": ("Unlicense", "Unlicense"), "Apache-2.0": ("Apache License, Version 2.0", "Apache-2.0"), "Apache-1.1": ("Apache License, Version 1.1", "Apache-1.1"),
    "GPL-2.0": ("GNU General Public License, version 2", "GPL-2.0"), "GPL-3.0": ("GNU General Public License, version 3", "GPL-3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL-2.1"), "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0"), "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause"), "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause"), "MPL-1.1": ("Mozilla Public License, v. 1.1", "MPL-1.1"), "MPL-2.0": ("Mozilla Public License, v. 2.0", "MPL-2.0"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0-1.0"),
} | {
    f"CC-BY{short}-{v}": (f"Creative Commons Attribution{full} {v} International License", f"CC BY{short} {v}")
    for v in ("3.0", "4.0") for short, full in (("", ""), ("-NC", "-NonCommercial"), ("-SA", "-ShareAlike"), ("-ND", "-NoDerivatives"), ("-NC-SA", "-NonCommercial-ShareAlike"), ("-NC-ND", "-NonCommercial-NoDerivatives"))
}
# The texts of short licences, and the opening and the marking clauses of long ones.
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
BODIES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Apache-2.0": ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "LGPL-2.1": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "AGPL-3.0": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",),
    "BSD-2-Clause": (BSD_GRANT,),
    "BSD-3-Clause": (f"{BSD_GRANT} ... {BSD_NAME}",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0 Universal.", "CC0 1.0 Universal Statement of Purpose"),
    "Proprietary": ("All rights reserved.", "Confidential and proprietary."),
}
GNU_NOTICE = "you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License"


def _notices(name: str) -> tuple[str, ...]:
    """Sentences by which a file names its licence."""
    full, short = FULL_NAMES[name]
    said = [f"{verb} under {x}" for verb in ("Licensed", "Released") for x in (f"the {full}", short)] + [f"SPDX-License-Identifier: {short}"]
    if full.startswith("GNU"):
        family, version = full.split(", version ")
        said.append(GNU_NOTICE.format(family, version))
    return tuple(said)


TEMPLATES = {name: (_notices(name) if name in FULL_NAMES else ()) + BODIES.get(name, ()) for name in sorted({*FULL_NAMES, *BODIES})}
#: Bare names; they must be there in full, and count where no notice or text is found.
MENTIONS = {name: (full if name in ("MIT", "ISC") else short,) for name, (full, short) in FULL_NAMES.items() if name != "Unlicense"}
#: Claims that stand beside many licences; they count where nothing else is found.
WEAK = ("Proprietary",)
#: Words too common to make a text worth reading closely.
COMMON = "a above all an and any are as at be by for free from holder in into is it may name not of on or other people person program public so terms that the this to under use used version with without work you your 0 1 2 3 4".split()
#: Names of licence files; a file by another name is one if its template makes up at least half of its words.
NAMES = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"
STEP = 32


def _terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _read_names(words: Column) -> Column:
    """Words with the names of licences put into one word each."""
    spaced = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    for pattern, made in SPELLINGS:
        spaced = F.regexp_replace(spaced, pattern, re.sub(r"\\(?:g<)?(\d)>?", r"$\1", made))
    return F.array_remove(F.split(spaced, " +"), "")


def _cued(words: Column) -> Column:
    return F.exists(words, lambda x: x.isin(CUES))


def read_names(words: list[str]) -> list[str]:
    """``_read_names`` of the words of a template."""
    spaced = f" {'  '.join(words)} "
    for pattern, made in SPELLINGS:
        spaced = re.sub(pattern, made, spaced)
    return spaced.split() if set(words) & set(CUES) else words


@dataclass
class Shapes:
    """Templates as tables: ``passages`` (passage, template, norm, needs, by_name), ``terms`` (passage, term, weight, needed), ``templates`` (template, license, kind, passages, words)."""

    passages: list[tuple[int, int, int, int, bool]]
    terms: list[tuple[int, str, int, int]]
    templates: list[tuple[int, str, int, int, int]]
    strong: list[str]
    least: int

    def vocabulary(self, named: bool) -> list[str]:
        """Terms of the passages that hold a name, or of the others."""
        some = {p[0] for p in self.passages if p[4] == named}
        return sorted({t[1] for t in self.terms if t[0] in some})

    @property
    def needed(self) -> list[str]:
        return sorted({t[1] for t in self.terms if t[3] and self.passages[t[0]][4] and " " not in t[1]})


def shapes(templates: dict[str, tuple[str, ...]], threshold: float, mentions: dict[str, tuple[str, ...]] | None = None) -> Shapes:
    """Vectors of the templates, with squared weights as whole millionths, and which words a text must have to reach ``threshold``."""
    found, passages = [], []
    bodies = [(name, 2 if name in WEAK else 0, body) for name, some in sorted(templates.items()) for body in some] + [(name, 1, body) for name, some in sorted((mentions or {}).items()) for body in some]
    known: set[tuple] = set()
    for name, kind, body in bodies:
        cuts = []
        for part in body.lower().split("..."):
            words = read_names(re.findall(r"[^\W_]+", part))
            size = math.ceil(len(words) / math.ceil(len(words) / STEP))  # passages of about equal length
            cuts += [tuple(words[k : k + size]) for k in range(0, len(words), size)]
        if (name, kind > 0, *cuts) in known:  # ways to write the same
            continue
        known.add((name, kind > 0, *cuts))
        passages += [(len(found), kind == 1 or any(map(IDENTITY.fullmatch, c)), kind == 1 or len(c) <= 3, {*c, *(f"{a} {b}" for a, b in zip(c, c[1:], strict=False))}) for c in cuts]
        found.append((len(found), name, kind, len(cuts), sum(map(len, cuts))))
    df: dict[str, int] = {}
    for *_, terms in passages:
        for t in terms:
            df[t] = df.get(t, 0) + 1
    weight = {t: round(1e6 * (math.log((1 + len(passages)) / (1 + k)) + 1) ** 2) for t, k in df.items()}
    needed = [{t for t in terms if whole or IDENTITY.fullmatch(t)} for *_, whole, terms in passages]  # of three words a cosine tells little
    common, least, strong = set(COMMON), 2, set()
    for k, (*_, terms) in enumerate(passages):
        if passages[k][1]:
            continue
        total = sum(weight[t] for t in terms)
        rare = [t for t in terms if " " not in t and t not in common]
        strong |= set(rare)
        for some in ([], *[[t] for t in rare]):  # what a text with no or one word that isn't common can reach
            reach = sum(weight[t] for t in terms if all(w in common or w in some for w in t.split()))
            if reach >= threshold**2 * total:
                least = min(least, len(some))
        if least == 0:  # any text may match a template of common words alone: then every word counts
            strong |= {t for t in terms if " " not in t}
    return Shapes(
        [(k, p, sum(weight[t] for t in terms), len(needed[k]), by_name) for k, (p, by_name, _, terms) in enumerate(passages)], [(k, t, weight[t], int(t in needed[k])) for k, (*_, terms) in enumerate(passages) for t in sorted(terms)],
        found, sorted(strong), max(least, 1),
    )


def _shapes_of(templates: dict[str, tuple[str, ...]] | None, threshold: float) -> Shapes:
    return shapes(TEMPLATES, threshold, MENTIONS) if templates is None else shapes(templates, threshold)


def scan(files: DataFrame, *, path: str = "path", text: str = "text", templates: dict[str, tuple[str, ...]] | None = None, threshold: float = 0.75) -> DataFrame:
    """Licence of every file: ``path, own_license, own_score, inherited_license, inherited_from, license``.

    ``own_license`` is that of the template with the highest score of ``threshold`` or more; of equal scores
    the one that comes first in the file counts, then the longest template, then the first name.  A bare name counts
    only where no notice or text is found, and a claim in ``WEAK`` only without any of them.  A name without a version, where there are
    several, names no licence.  A licence file's licence holds for its directory (of several
    the most certain, ties: the first name) and is inherited by files in and below it that have none of their
    own; the nearest counts.

    A null or blank text has no licence of its own but may inherit; a null path is in no directory and
    repeated rows give repeated rows.  Texts of any length are read whole.  Other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    spark = files.sparkSession
    shape = _shapes_of(templates, threshold)

    def read(t: Column) -> Column:
        # over ten literals become one hash set
        tells = F.size(F.array_distinct(F.filter(t, lambda x: x.isin(shape.strong)))) >= shape.least
        names = lambda w: F.array_distinct(F.flatten(F.transform(_places(w, shape.needed), lambda i: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(i / STEP).cast("int") + k))))
        return F.when(tells | _cued(t), let(F.when(_cued(t), _read_names(t)).otherwise(t), lambda w: F.struct(
            F.size(w).alias("n"), F.when(tells, _hits(w, shape.vocabulary(False))).alias("plain"),
            # words that a named passage has count only near a name
            let(names(w), lambda near: F.when(_cued(t) & (F.size(near) > 0), F.filter(_hits(w, shape.vocabulary(True)), lambda h: F.array_contains(near, h["at"])))).alias("named"),
        )))

    rows = files.select(F.col(f"`{path}`").cast("string").alias("path"), let(_terms(F.col(f"`{text}`")), read).alias("s"))
    rows = Stored(rows.select("path", "s.*", F.monotonically_increasing_id().alias("file")), "words").df
    kinds = F.array(F.struct(F.lit(False).alias("by_name"), F.col("plain").alias("hits")), F.struct(F.lit(True).alias("by_name"), F.col("named").alias("hits")))
    hits = rows.where("plain is not null or named is not null").select("file", F.explode(kinds).alias("k")).select("file", "k.by_name", F.explode("k.hits").alias("h"))
    hits = hits.select("file", "by_name", "h.term", F.explode(F.array(F.col("h.at"), F.col("h.at") - 1)).alias("win")).where("win >= 0").distinct()
    # the tables of templates are of fixed size
    every = spark.createDataFrame(shape.passages, "passage int, template int, norm bigint, needs int, by_name boolean")
    passages = F.broadcast(every)
    terms = F.broadcast(spark.createDataFrame(shape.terms, "passage int, term string, weight bigint, needed int").join(every.select("passage", "by_name"), "passage"))
    shown = F.broadcast(spark.createDataFrame(shape.templates, "template int, license string, kind int, passages int, words int"))
    shares = hits.join(terms, ["by_name", "term"]).groupBy("file", "win", "passage").agg(F.sum("weight").alias("w"), F.sum("needed").alias("has")).join(passages.select("passage", "needs"), "passage").where("has >= needs")
    best = shares.groupBy("file", "passage").agg(F.max(F.struct("w", (-F.col("win")).alias("before"))).alias("b")).join(passages.drop("by_name"), "passage")
    scores = best.groupBy("file", "template").agg(F.sum(F.sqrt(F.col("b.w") / F.col("norm"))).alias("s"), F.max("b.before").alias("before")).join(shown, "template")
    scores = scores.withColumn("score", F.round(F.col("s") / F.col("passages"), 9)).where(F.col("score") >= threshold)
    own = scores.groupBy("file").agg(F.min(F.struct("kind", -F.col("score"), -F.col("before"), -F.col("words"), "license", F.col("score").alias("score"), F.col("words").alias("words"))).alias("o"))
    own = own.select("file", F.col("o.license").alias("own_license"), F.col("o.score").alias("own_score"), F.col("o.words").alias("words"))
    own = rows.select("file", "path", "n").join(own.hint("merge"), "file", "left").withColumn("mostly", F.coalesce(F.col("words") * 2 >= F.col("n"), F.lit(False))).drop("n", "words")
    return _inherited(Stored(own, "own").df)


def _places(t: Column, words: list[str]) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.get(t, i).isin(words)) if words else F.array().cast("array<int>")


def _hits(t: Column, vocabulary: list[str]) -> Column:
    """Words and pairs of ``t`` that are in ``vocabulary``, each with the number of its ``STEP``."""
    pairs = [v for v in vocabulary if " " in v]

    def at(i: Column) -> Column:
        one, two = F.get(t, i), F.concat_ws(" ", F.get(t, i), F.get(t, i + 1))
        hit = lambda term: F.struct(F.floor(i / STEP).cast("int").alias("at"), term.alias("term"))
        return F.when(two.isin(pairs), F.array(hit(one), hit(two))).otherwise(F.array(hit(one))) if pairs else F.array(hit(one))

    return F.array_distinct(F.flatten(F.transform(_places(t, [v for v in vocabulary if " " not in v]), at)))


def _inherited(own: DataFrame) -> DataFrame:
    """``path, own_license, own_score, mostly`` -> with the licence of the nearest directory that has one."""
    slash = F.length("path") - F.length(F.substring_index("path", "/", -1))
    located = own.withColumn("dir", F.when(slash > 0, F.substring("path", F.lit(1), slash)).otherwise(F.when(F.col("path").isNotNull(), F.lit(""))))
    holds = located.where("own_license is not null and path is not null").where(F.col("path").rlike(NAMES) | F.col("mostly"))
    # greatest score first, then the first name: of a directory's licence files only one row goes on
    at_dir = holds.groupBy("dir").agg(F.min(F.struct(-F.col("own_score"), "own_license", "path")).alias("l")).select(F.col("dir").alias("holder"), F.col("l.own_license").alias("inherited_license"), F.col("l.path").alias("inherited_from"))
    dirs = located.where("own_license is null and dir is not null").select("dir").distinct()
    above = dirs.withColumn("holder", F.explode(ancestors(F.col("dir"))))
    near = above.join(at_dir, "holder").groupBy("dir").agg(F.max(F.struct(F.length("holder").alias("depth"), "inherited_license", "inherited_from")).alias("n")).select("dir", "n.inherited_license", "n.inherited_from")
    none = located.where("own_license is null").join(small(Stored(near, "near").df), "dir", "left")
    some = located.where("own_license is not null").withColumn("inherited_license", F.lit(None).cast("string")).withColumn("inherited_from", F.lit(None).cast("string"))
    cols = ["path", "own_license", "own_score", "inherited_license", "inherited_from"]
    return some.select(*cols).union(none.select(*cols)).withColumn("license", F.coalesce("own_license", "inherited_license"))


def ancestors(folder: Column) -> Column:
    """A directory (with a slash at its end, or empty) and all above it, the empty one last."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))))


def oracle(files: str, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = 0.75) -> str:
    """The same scan as one SQL statement over ``files``, a query that gives unique ``doc_id``, ``path`` and ``text``; paths aren't null."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    show = lambda rows: ", ".join("(" + ", ".join(quote(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    shape, spaced = _shapes_of(templates, threshold), "' ' || array_to_string(p, '  ') || ' '"
    for pattern, made in SPELLINGS:
        spaced = f"regexp_replace({spaced}, {quote(pattern)}, {quote(re.sub(r'g<(.)>', r'\1', made))}, 'g')"
    return f"""
WITH terms AS (SELECT * FROM (VALUES {show(shape.terms)}) AS v(passage, term, weight, needed)),
passages AS (SELECT * FROM (VALUES {show(shape.passages)}) AS v(passage, template, norm, needs, by_name)),
shown AS (SELECT * FROM (VALUES {show(shape.templates)}) AS v(template, license, kind, passages, words)),
src AS ({files}),
plain AS (SELECT doc_id, path, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: len(x) > 0) AS p FROM src),
t AS (SELECT doc_id, path, list_has_any(p, [{', '.join(map(quote, CUES))}]) AS cued, CASE WHEN cued THEN list_filter(regexp_split_to_array({spaced}, ' +'), lambda x: len(x) > 0) ELSE p END AS t FROM plain),
w AS (SELECT doc_id, unnest(t) AS a, generate_subscripts(t, 1) - 1 AS i, unnest(list_concat(t[2:], [NULL])) AS b FROM t WHERE len(t) > 0),
said AS (
  SELECT doc_id, i // {STEP} AS step, a AS term FROM w WHERE a IN (SELECT term FROM terms)
  UNION ALL SELECT doc_id, i // {STEP}, a || ' ' || b FROM w WHERE b IS NOT NULL AND a || ' ' || b IN (SELECT term FROM terms)),
hits AS (SELECT DISTINCT doc_id, term, win FROM (SELECT doc_id, term, step AS win FROM said UNION ALL SELECT doc_id, term, step - 1 FROM said) WHERE win >= 0),
shares AS (SELECT doc_id, win, passage, w FROM (SELECT doc_id, win, passage, CAST(sum(weight) AS BIGINT) AS w, sum(needed) AS has FROM hits JOIN terms USING (term) GROUP BY ALL) JOIN passages USING (passage) JOIN t USING (doc_id) WHERE has >= needs AND (cued OR NOT by_name)),
best AS (SELECT doc_id, passage, max(struct_pack(w := w, before := -win)) AS b FROM shares GROUP BY ALL),
scores AS (
  SELECT doc_id, license, kind, words, before, round(s / passages, 9) AS score FROM (
    SELECT doc_id, template, sum(sqrt(CAST(b.w AS DOUBLE) / norm)) AS s, max(b.before) AS before FROM best JOIN passages USING (passage) GROUP BY ALL) JOIN shown USING (template)),
firsts AS (
  SELECT doc_id, license AS own_license, score AS own_score, words FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, score DESC, before DESC, words DESC, license) AS r FROM scores WHERE score >= {threshold}) WHERE r = 1),
own AS (SELECT doc_id, path, coalesce(words * 2 >= len(t), false) AS mostly, own_license, own_score, regexp_replace(path, '[^/]*$', '') AS dir FROM t LEFT JOIN firsts USING (doc_id)),
held AS (
  SELECT dir AS holder, own_license AS inherited_license, path AS inherited_from FROM (
    SELECT *, row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, own_license, path) AS r FROM own WHERE own_license IS NOT NULL AND (regexp_matches(path, {quote(NAMES)}) OR mostly)) WHERE r = 1),
above AS (SELECT dir, unnest(list_transform(generate_series(0, len(string_split(dir, '/')) - 1), lambda k: CASE WHEN k = 0 THEN '' ELSE array_to_string(string_split(dir, '/')[1:k], '/') || '/' END)) AS holder
  FROM (SELECT DISTINCT dir FROM own)),
near AS (SELECT dir, inherited_license, inherited_from FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY len(holder) DESC) AS r FROM above JOIN held USING (holder)) WHERE r = 1)
SELECT doc_id, path, own_license, own_score, CASE WHEN own_license IS NULL THEN inherited_license END AS inherited_license, CASE WHEN own_license IS NULL THEN inherited_from END AS inherited_from,
  coalesce(own_license, inherited_license) AS license
FROM own LEFT JOIN near USING (dir)
"""
