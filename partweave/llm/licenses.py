"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along the path.

A document's licence text is, for a licence file, its whole text, and otherwise its header lines: every line that
holds a licence word, wherever it stands, since notices come first or last.  Terms are lower-case words; weights are
log(1 + tf) * idf with idf over the templates and unit length, so a template is a sparse vector and the cosine is a
join on terms.  A licence has several templates: short notices, SPDX lines with its id as one term, and its full text.
Of the templates at ``threshold`` or more the most similar one gives the document's own licence; equal cosines go to
the licence of least name.

A document without one inherits from the nearest ancestor directory that has a licence file: directories are joined by
path, one row per ancestor, and the longest path wins.  If a directory has several licence files, the most frequent
licence among them is its licence, ties to the least name.

Defined results: null text has no licence of its own; a null path has no ancestors; repeated rows count one by one;
extra columns are not read; an empty table gives an empty table; templates are a parameter of at most
``MOST_TEMPLATES`` and are the only thing that is broadcast.
"""
from __future__ import annotations

from importlib.resources import files as package_files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialise

MOST_TEMPLATES = 1000

#: What the notices of common licences say.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                  "compliance with the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under Creative Commons Attribution CC BY 4.0 International.",
    "CC-BY-NC-4.0": "Licensed under Creative Commons Attribution NonCommercial CC BY-NC 4.0 International.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3, as published by the Free "
               "Software Foundation.",
    "MIT": "Released under the MIT License. Permission is hereby granted, free of charge.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

#: SPDX ids of each licence.
SPDX_IDS = {name: [name] for name in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC0-1.0",
                                      "ISC", "MIT", "MPL-2.0")} | {
    name: [name, f"{name}-only", f"{name}-or-later"]
    for name in ("AGPL-3.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0")}

#: Further notices, as files and headers hold them.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "BSD-2-Clause": ["Redistribution and use are permitted under the BSD 2-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0 Universal."],
    "ISC": ["Released under the ISC License. Permission to use, copy, modify, and distribute this software is hereby granted."],
    "MIT": ["Released under the MIT License."],
} | {
    f"{short}-{version}": [
        f"This work is licensed under the GNU {name} General Public License, version {number}.",
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General "
        f"Public License as published by the Free Software Foundation, either version {number} of the License, or (at your "
        "option) any later version."]
    for short, name, version, number in (
        ("AGPL", "Affero", "3.0", "3"), ("GPL", "", "1.0", "1"), ("GPL", "", "2.0", "2"), ("GPL", "", "3.0", "3"),
        ("LGPL", "Library", "2.0", "2"), ("LGPL", "Lesser", "2.1", "2.1"), ("LGPL", "Lesser", "3.0", "3"))}

#: What the AGPL says beyond the GPL of the same version.
AFFERO = ("Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of "
          "this License, if you modify the Program, your modified version must prominently offer all users interacting with "
          "it remotely through a computer network (if your version supports such interaction) an opportunity to receive the "
          "Corresponding Source of your version by providing access to the Corresponding Source from a network server at no "
          "charge, through some standard or customary means of facilitating copying of software.")


def full_texts() -> dict[str, str]:
    """Licence -> full text.  That of the AGPL is composed from the GPL's; the CC BY texts are not included."""
    found = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8")
             for f in package_files(__package__).joinpath("licence_texts").iterdir() if f.name.endswith(".txt")}
    affero = " ".join(found["GPL-3.0"].split()).replace("GNU GENERAL", "GNU AFFERO GENERAL").replace("GNU General", "GNU Affero General")
    return found | {"AGPL-3.0": f"{affero} {AFFERO}"}


def all_templates() -> dict[str, list[str]]:
    """Licence -> its notices, SPDX lines and full text."""
    texts = full_texts()
    return {name: [*([TEMPLATES[name]] if name in TEMPLATES else []), *NOTICES.get(name, []),
                   *[f"SPDX-License-Identifier: {i}" for i in ids], *([texts[name]] if name in texts else [])]
            for name, ids in SPDX_IDS.items()}


LICENCE_WORDS = r"(?i)licen[sc]e|copyright|spdx|redistribution|permission is hereby"
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:[.-][a-z0-9]+)*"), F.lit(0))


def header_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda l: l.rlike(LICENCE_WORDS))


def _weighted(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(key, term, weight): log(1 + tf) * idf over unit length; unknown terms count for the length."""
    unknown = F.log(F.lit(2.0))
    rows = counts.join(F.broadcast(idf), "term", "left").withColumn(
        "raw", F.log1p("tf") * F.coalesce("idf", unknown))
    length = rows.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"))
    return rows.join(length, key).select(key, "term", (F.col("raw") / F.col("length")).alias("weight"))


def template_vectors(spark, templates: dict[str, str | list[str]]) -> tuple[DataFrame, DataFrame]:
    """(template, term, weight) and (term, idf); a template is a struct of its licence and its place there."""
    given = [(name, n, text) for name, of in sorted(templates.items()) for n, text in enumerate([of] if isinstance(of, str) else of)]
    if len(given) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    rows = spark.createDataFrame(given, "licence string, n int, text string")
    counts = rows.select(F.struct("licence", "n").alias("template"), F.explode(terms(F.col("text"))).alias("term")).groupBy(
        "template", "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = counts.groupBy("term").agg(
        (F.log(F.lit(1.0 + len(given)) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    return _weighted(counts, idf, "template"), idf


def own_licences(files: DataFrame, templates: dict[str, str | list[str]], threshold: float) -> DataFrame:
    """(notice, licence, cosine) of the distinct notices of ``files`` (notice).

    Notices repeat across most of a corpus, so each distinct text is scored once."""
    vectors, idf = template_vectors(files.sparkSession, templates)
    notices = files.filter("notice <> ''").select("notice").distinct()
    counts = notices.select("notice", F.explode(terms(F.col("notice"))).alias("term")).groupBy("notice", "term").agg(
        F.count(F.lit(1)).alias("tf"))
    scored = (
        _weighted(counts, idf, "notice").alias("n").join(F.broadcast(vectors).alias("t"), "term")
        .groupBy("notice", "template").agg(F.round(F.sum(F.col("n.weight") * F.col("t.weight")), 9).alias("cosine"))
    )
    best = scored.filter(F.col("cosine") >= threshold).groupBy("notice").agg(
        F.min(F.struct((-F.col("cosine")).alias("less"), F.col("template"))).alias("b"))
    return best.select("notice", F.col("b.template.licence").alias("licence"), (-F.col("b.less")).alias("cosine"))


def ancestors(path: Column) -> Column:
    """Directories above a path, the root ('') included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def licence_scan(docs: DataFrame, templates=None, threshold=0.5, doc_id="doc_id", text="text", path="path",
                 is_licence_file: Column | None = None) -> DataFrame:
    """One row per document: own_licence, cosine, licence, inherited_from (directory, null if not inherited)."""
    templates = all_templates() if templates is None else templates
    whole = F.coalesce(is_licence_file if is_licence_file is not None else F.col(path).rlike(LICENCE_FILE), F.lit(False))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = materialise(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(path).alias("path"), whole.alias("whole"),
        F.when(whole, F.trim(F.regexp_replace(body, f"[{SPACE}]+", " ")))
        .otherwise(F.array_join(header_lines(body), "\n")).alias("notice")))
    found = own_licences(rows, templates, threshold)
    silent = rows.filter("notice = ''").select(
        "doc_id", "path", "whole", F.lit(None).cast("string").alias("own_licence"), F.lit(None).cast("double").alias("cosine"))
    owned = materialise(rows.filter("notice <> ''").join(found, "notice", "left").select(
        "doc_id", "path", "whole", F.col("licence").alias("own_licence"), "cosine").unionAll(silent))
    directory = F.regexp_replace(F.col("path"), r"/?[^/]*$", "")
    votes = owned.filter("whole and own_licence is not null and path is not null").groupBy(
        directory.alias("directory"), "own_licence").agg(F.count(F.lit(1)).alias("n"))
    granted = votes.groupBy("directory").agg(
        F.min(F.struct((-F.col("n")).alias("less"), F.col("own_licence"))).alias("v")).select("directory", F.col("v.own_licence").alias("granted"))
    # Directories, not documents, look upwards: one row per directory and ancestor.
    places = owned.filter("path is not null").select(directory.alias("place")).distinct()
    above = places.select("place", F.explode(ancestors(F.concat("place", F.lit("/x")))).alias("directory"))
    nearest = above.join(granted, "directory").groupBy("place").agg(
        F.max(F.struct(F.length("directory").alias("depth"), F.col("directory"), F.col("granted"))).alias("a")).select(
        "place", F.col("a.directory").alias("from"), F.col("a.granted").alias("granted"))
    return owned.withColumn("place", directory).join(nearest, "place", "left").select(
        "doc_id", "path", "own_licence", "cosine", F.coalesce("own_licence", "granted").alias("licence"),
        F.when(F.col("own_licence").isNull(), F.col("from")).alias("inherited_from"))
