"""Licence scan: sparse TF-IDF cosine to licence texts, then inheritance from the nearest ancestor directory.

DataFrame code only.  A file is its sequence of terms, so comment marks and line
breaks don't matter.  Every window of a file as long as a template and starting
at one of its terms is compared with it over term weights tf * idf, the idf of
every term counted on all files; a file shorter than a template is one window.
Templates are one-line notices, file headers, whole short licences, openings of
long ones and SPDX tags.

Three tests thin out the comparisons and lose nothing: a window without any of
a template's heaviest terms can't reach the needed cosine, nor can a file whose
terms hold less than the cosine's square of the template's squared weight; and
a running sum over the template's terms in a file bounds the cosine of each
window from above.  Files without a notice of their own take the licence of the
licence file in the nearest directory above.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_hash

_PERMISSION = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
               "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
               "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
               "subject to the following conditions:")
_AS_IS = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
          "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. ")
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."


def _free_program(kind: str, version: int) -> str:
    return (f"This program is free software: you can redistribute it and/or modify it under the terms of the {kind} as published by the Free "
            f"Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the "
            f"hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
            f"PURPOSE. See the {kind} for more details.")


#: Public licences: notices, headers, short texts and openings (fixed values).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",
                 _free_program("GNU Affero General Public License", 3),
                 "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _VERBATIM),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
                   "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
                   "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
                   "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION "
                   "1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 "
                   "through 9 of this document."),
    "BSD-2-Clause": (_BSD + _AS_IS,),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
                     _BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                     "derived from this software without specific prior written permission. " + _AS_IS),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",
                "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization "
                "obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, "
                "distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights, CC0 1.0.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", _free_program("GNU General Public License", 2),
                "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. " + _VERBATIM),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", _free_program("GNU General Public License", 3),
                "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _VERBATIM),
    "ISC": ("Released under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies."),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.",
                 "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. " + _VERBATIM),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", _free_program("GNU Lesser General Public License", 3),
                 "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _VERBATIM),
    "MIT": ("Released under the MIT License.", "This project is licensed under the terms of the MIT license.", _PERMISSION,
            _PERMISSION + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
                "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes "
                "to the creation of, or owns Covered Software."),
    "Proprietary": ("All rights reserved.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
                  "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and "
                  "by any means.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
             "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
             "applications, and to alter it and redistribute it freely",),
}
#: Word before an SPDX id; a file may name any licence of the templates so.
SPDX = "SPDX-License-Identifier: "
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"
#: What parts terms: anything but lower-case ASCII letters, digits and characters beyond ASCII.
PART = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


@dataclass(frozen=True)
class LicenceParams:
    """``templates`` (licence -> texts) are parameters: their terms come as small tables and literals into the plan.

    A template of up to ``short`` terms counts only if the window has all its numbers (another version
    is another licence), one of up to ``tiny`` terms only if it has all of them, an SPDX tag only if it
    has all terms of the id.
    """
    cosine: float = 0.8
    templates: Mapping[str, Sequence[str]] = field(default_factory=lambda: TEMPLATES)
    short: int = 30
    tiny: int = 4
    spdx: bool = True


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), PART), lambda w: w != "")


def _py_terms(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9\x80-\U0010ffff]+", text.lower()) if w]


@dataclass(frozen=True)
class Template:
    licence: str
    terms: tuple[str, ...]
    needs: frozenset[str]


def templates(p: LicenceParams) -> list[Template]:
    """All templates by licence name, then text."""
    out = []
    for licence, texts in sorted(p.templates.items()):
        for text in texts:
            ts = _py_terms(text)
            needs = ts if len(ts) <= p.tiny else [t for t in ts if t.isdigit()] if len(ts) <= p.short else []
            out.append(Template(licence, tuple(ts), frozenset(needs)))
        if p.spdx:
            out.append(Template(licence, tuple(_py_terms(SPDX + licence)), frozenset(_py_terms(licence))))
    return out


def _tell(weights: dict[str, float], cosine: float) -> set[str]:
    """Terms of a template, heaviest first, without all of which no text reaches the cosine."""
    total = sum(w * w for w in weights.values())
    out, rest = set(), total
    for t, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        if rest < cosine * cosine * total * (1 - 1e-9):
            break
        out.add(t)
        rest -= w * w
    return out


def notices(files: DataFrame, p: LicenceParams = LicenceParams()) -> DataFrame:
    """(path, th, licence, cosine): the best template of each file that has a window at ``cosine`` or above.

    ``th`` is the hash of the file's text.  Ties go to the licence name that
    sorts first.  Files of equal path and text are one file.  Null and empty
    texts have no window.
    """
    spark = files.sparkSession
    scratch = Scratch(spark, "licences")
    known = templates(p)
    vocab = sorted({t for x in known for t in x.terms})
    terms = _terms(F.coalesce("text", F.lit("")))
    # files that hold each term, counted in one pass over all files; '' counts the files
    df = scratch.keep(files.select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct(terms))).alias("t"))
                      .groupBy("t").agg(F.count(F.lit(1)).alias("n")), "df")
    held = {r["t"]: r["n"] for r in df.where(F.col("t").isin("", *vocab)).collect()}
    n = held.get("", 0)
    idf = {t: math.log(1 + n / (1 + held.get(t, 0))) for t in vocab}
    lowest = math.log(1 + n / (1 + n))  # no term weighs less
    weights = [{t: f * idf[t] for t, f in Counter(x.terms).items()} for x in known]
    norms = [math.sqrt(sum(w * w for w in ws.values())) for ws in weights]
    tell = sorted({t for ws in weights for t in _tell(ws, p.cosine)})
    of_term = F.broadcast(spark.createDataFrame(
        [(k, t, w, idf[t], t in x.needs) for k, (x, ws) in enumerate(zip(known, weights)) for t, w in ws.items()],
        "k int, t string, w double, idf double, needed boolean"))
    of_template = F.broadcast(spark.createDataFrame(
        [(k, x.licence, len(x.terms), norms[k], len(x.needs)) for k, x in enumerate(known)],
        "k int, licence string, len int, norm double, n_needs int"))
    some = files.select("path", text_hash(F.col("text")).alias("th"), terms.alias("terms"))
    some = some.where(F.arrays_overlap("terms", F.array(*[F.lit(t) for t in tell]))).dropDuplicates(["path", "th"])
    some = scratch.keep(some.withColumn("f", F.monotonically_increasing_id()), "some")
    # files whose terms hold enough of a template's weight
    weight = F.sum(F.col("w") * F.col("w"))
    able = (some.select("f", F.explode(F.array_distinct("terms")).alias("t")).join(of_term, "t").groupBy("f", "k").agg(weight.alias("w2"))
            .join(of_template, "k").where(F.col("w2") >= p.cosine ** 2 * (1 - 1e-9) * F.col("norm") * F.col("norm")).select("f", "k", "len", "norm"))
    able = scratch.keep(able, "able")
    # windows that start at a term of the template: no other term weighs less than the lowest idf
    places = some.select("f", F.size("terms").alias("size"), F.posexplode("terms").alias("at", "t"))
    places = places.join(able.select("f").distinct(), "f", "left_semi").join(of_term, "t").join(able, ["f", "k"])
    unit = 1_000_000_000  # places in units of the template's length, so that all windows have one size
    ahead = Window.partitionBy("f", "k").orderBy(F.call_function("div", F.col("at") * F.lit(unit).cast("long"), F.col("len"))).rangeBetween(0, unit - 1)
    dot = F.sum(F.col("w") * F.col("idf")).over(ahead)
    spare = F.least("len", F.col("size") - F.col("at")) - F.count(F.lit(1)).over(ahead)
    least = F.sum(F.col("idf") * F.col("idf")).over(ahead) + spare * lowest * lowest
    # a file shorter than the template is one window, whatever it starts with
    first = F.when(F.col("size") <= F.col("len"), 0).otherwise(F.col("at"))
    windows = places.select("f", "k", "len", "size", first.alias("at"), (dot / F.col("norm") / F.sqrt(least)).alias("bound"))
    windows = scratch.keep(windows.where((F.col("bound") >= p.cosine * (1 - 1e-9)) | (F.col("size") <= F.col("len")))
                           .select("f", "k", "at", "len").distinct(), "windows")
    inside = (windows.join(some.select("f", "terms"), "f")
              .select("f", "k", "at", F.explode(F.slice("terms", F.col("at") + 1, F.col("len"))).alias("t"))
              .groupBy("f", "k", "at", "t").agg(F.count(F.lit(1)).alias("c")))
    inside = scratch.keep(inside, "inside")
    idfs = df.join(inside.select("t").distinct(), "t", "left_semi").select("t", F.log(1 + n / (1 + F.col("n"))).alias("own"))
    x = F.col("c") * F.col("own")
    scored = (inside.join(idfs, "t").join(of_term, ["k", "t"], "left").groupBy("f", "k", "at").agg(
        F.sum(x * F.coalesce("w", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(x * x)).alias("size"), F.count_if(F.col("needed")).alias("has")))
    scored = scored.join(of_template, "k").where(F.col("has") == F.col("n_needs"))
    scored = scored.select("f", "licence", F.round(F.col("dot") / F.col("size") / F.col("norm"), 9).alias("cosine")).where(F.col("cosine") >= p.cosine)
    best = scored.groupBy("f").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "licence")).alias("b"))
    return best.join(some.select("f", "path", "th"), "f").select("path", "th", F.col("b.licence").alias("licence"), (-F.col("b.minus")).alias("cosine"))


def _dir(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


#: Columns that ``scan`` adds.
ADDED = ("licence", "licence_by", "licence_cosine", "licence_dir")


def scan(files: DataFrame, p: LicenceParams = LicenceParams()) -> DataFrame:
    """``files`` (path, text and any further columns) without the text, with ``licence``, ``licence_by``, ``licence_cosine``, ``licence_dir``.

    licence_by is ``notice`` (found in the file), ``inherited`` (from the
    licence file of the nearest directory at or above the file's own, given in
    licence_dir) or null.  Of several licence files of a directory the one with
    the highest cosine counts, then the licence name that sorts first.  A null path has no
    directory; null and empty texts hold no notice.  Every row is returned once.
    Columns of ``files`` that have the names of the four new ones are replaced.
    """
    cols = [c for c in files.columns if c not in ("text", *ADDED)]
    found = notices(files.select("path", "text").where("path IS NOT NULL"), p)
    row = F.struct(*[F.col(f"`{c}`") for c in cols])
    own = files.select(row.alias("r"), F.col("path").alias("__p"), text_hash(F.col("text")).alias("__t"))
    own = own.join(found.select(F.col("path").alias("fp"), F.col("th").alias("ft"), "licence", "cosine"),
                   (F.col("__p") == F.col("fp")) & (F.col("__t") == F.col("ft")), "left").withColumn("__dir", _dir(F.col("__p")))
    # one licence a directory, and the nearest one for each directory that has files: directories, not files, are joined
    of_dir = (found.where(F.substring_index("path", "/", -1).rlike(LICENCE_FILE)).groupBy(_dir(F.col("path")).alias("above"))
              .agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "licence")).alias("l")))
    levels = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(levels)), lambda k: F.struct(
        F.concat_ws("/", F.slice(levels, F.lit(1), k)).alias("above"), k.alias("depth")))
    dirs = files.where("path IS NOT NULL").select(_dir(F.col("path")).alias("dir")).distinct()
    nearest = (dirs.select("dir", F.explode(F.array_distinct(ups)).alias("u")).select("dir", "u.*").join(of_dir, "above")
               .groupBy("dir").agg(F.max(F.struct("depth", "above", "l")).alias("n")))
    joined = own.join(nearest, F.col("__dir") == F.col("dir"), "left")
    has = F.col("licence").isNotNull()
    return joined.select("r.*", F.coalesce(F.col("licence"), F.col("n.l.licence")).alias("licence"),
                         F.when(has, F.lit("notice")).when(F.col("n").isNotNull(), F.lit("inherited")).alias("licence_by"),
                         F.coalesce(F.col("cosine"), -F.col("n.l.minus")).alias("licence_cosine"),
                         F.when(~has, F.col("n.above")).alias("licence_dir"))
