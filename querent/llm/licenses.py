"""License scan: ordered signature rules over whole texts, with DataFrame functions only.

A text is read as words: A-Z lower-cased, every run of ASCII characters other than letters and digits
parts two words, all other characters belong to words. Rules are regular expressions over the words,
each with a label, a level and a keyword: a word without which the rule can't match. A text is searched
by the rules whose keyword it holds, and by no others, so most texts are split once and searched never.

Detections are intervals of words. A detection gives way to one that contains it and has a level as
high or higher; of equal intervals the higher level stays, then the earlier rule. Detections of level
``BASE`` always count. A score is the weight of the best detection that stays.

One scan yields a row a document and a row a detection; it is written to the shared folder, so that the row numbers
which keep repeated documents apart hold for good. Only detections are shuffled, by row number, and
resolved by windows that spill, so a text of one phrase a million times is no special case.

Cases: a null or empty text has no words, no labels and score 0; ``first_word`` and ``last_word`` are
null without base places; a null or repeated doc_id is a row like any other; an empty table gives no
rows; extra columns, whatever their names, are ignored. Very long texts are read whole.
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent.llm.common import written

__all__ = ["RULES", "SQL", "detections", "report", "resolved", "scan"]

#: What parts words, but for capitals, and what it becomes.
GAP = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
FROM, TO = string.ascii_uppercase + GAP, string.ascii_lowercase + " " * len(GAP)
#: Weight of a detection by level: base phrases, weak phrases, named licenses, license texts and tags.
WEIGHTS = (0.5, 0.6, 0.9, 1.0)
BASE = 0

#: The base phrases: label, keyword, words.
PHRASES = [("cc-by", "cc", "cc by"), ("gpl", "general", "general public license"), ("reserved", "reserved", "all rights reserved")]

#: Licenses by name: label, keyword, words. A version may stand behind "v" or "version"; "2 0" is 2.0.
NAMES = """
Apache-2.0          apache      apache(?: software)? licen[cs]e(?: version| v)? v?2(?: 0)?
Apache-2.0          apache      apache 2(?: 0)? licen[cs]e
Apache-1.1          apache      apache(?: software)? licen[cs]e(?: version| v)? v?1 1
Apache-1.0          apache      apache(?: software)? licen[cs]e(?: version| v)? v?1 0
MIT                 mit         mit(?: x11| style)? licen[cs]e
MIT                 mit         under(?: the)? mit
MIT                 expat       expat licen[cs]e
MIT-0               mit         mit no attribution(?: licen[cs]e)?
X11                 x11         x11 licen[cs]e
ISC                 isc         isc licen[cs]e
BSD-2-Clause        bsd         bsd 2 clause(?: licen[cs]e)?
BSD-2-Clause        bsd         (?:2|two) clause bsd(?: licen[cs]e)?
BSD-2-Clause        simplified  simplified bsd(?: licen[cs]e)?
BSD-2-Clause        freebsd     freebsd licen[cs]e
BSD-3-Clause        bsd         bsd 3 clause(?: licen[cs]e)?
BSD-3-Clause        bsd         (?:3|three) clause bsd(?: licen[cs]e)?
BSD-3-Clause        bsd         (?:new|revised|modified) bsd(?: licen[cs]e)?
BSD-3-Clause        bsd         new bsd licen[cs]e
BSD-4-Clause        bsd         bsd 4 clause(?: licen[cs]e)?
BSD-4-Clause        bsd         (?:4|four) clause bsd(?: licen[cs]e)?
0BSD                bsd         zero clause bsd(?: licen[cs]e)?
GPL-1.0             general     (?:gnu )?general public licen[cs]e(?: gpl)?(?: version| v)? v?1(?: 0)?
GPL-2.0             general     (?:gnu )?general public licen[cs]e(?: gpl)?(?: version| v)? v?2(?: 0)?
GPL-3.0             general     (?:gnu )?general public licen[cs]e(?: gpl)?(?: version| v)? v?3(?: 0)?
GPL-2.0-only        general     (?:gnu )?general public licen[cs]e(?: version| v)? v?2(?: 0)? only
GPL-3.0-only        general     (?:gnu )?general public licen[cs]e(?: version| v)? v?3(?: 0)? only
GPL-2.0-or-later    general     (?:gnu )?general public licen[cs]e(?: version| v)? v?2(?: 0)? or(?: at your option)?(?: any)? later(?: version)?
GPL-3.0-or-later    general     (?:gnu )?general public licen[cs]e(?: version| v)? v?3(?: 0)? or(?: at your option)?(?: any)? later(?: version)?
GPL-2.0             gpl         (?:gnu )?gpl(?: version| v)? v?2(?: 0)?
GPL-3.0             gpl         (?:gnu )?gpl(?: version| v)? v?3(?: 0)?
GPL-2.0             gplv2       (?:gnu )?gplv2
GPL-3.0             gplv3       (?:gnu )?gplv3
LGPL-2.0            library     (?:gnu )?library general public licen[cs]e(?: version| v)? v?2(?: 0)?
LGPL-2.1            lesser      (?:gnu )?lesser general public licen[cs]e(?: version| v)? v?2 1
LGPL-3.0            lesser      (?:gnu )?lesser general public licen[cs]e(?: version| v)? v?3(?: 0)?
LGPL                lesser      (?:gnu )?lesser general public licen[cs]e
LGPL                library     (?:gnu )?library general public licen[cs]e
LGPL-2.1            lgpl        (?:gnu )?lgpl(?: version| v)? v?2 1
LGPL-3.0            lgpl        (?:gnu )?lgpl(?: version| v)? v?3(?: 0)?
LGPL-3.0            lgplv3      (?:gnu )?lgplv3
AGPL-3.0            affero      (?:gnu )?affero general public licen[cs]e(?: version| v)? v?3(?: 0)?
AGPL                affero      (?:gnu )?affero general public licen[cs]e
AGPL-3.0            agpl        (?:gnu )?agpl(?: version| v)? v?3(?: 0)?
AGPL-3.0            agplv3      (?:gnu )?agplv3
GFDL-1.2            documentation  (?:gnu )?free documentation licen[cs]e(?: version| v)? v?1 2
GFDL-1.3            documentation  (?:gnu )?free documentation licen[cs]e(?: version| v)? v?1 3
GFDL                documentation  (?:gnu )?free documentation licen[cs]e
MPL-1.1             mozilla     mozilla public licen[cs]e(?: version| v)? v?1 1
MPL-2.0             mozilla     mozilla public licen[cs]e(?: version| v)? v?2(?: 0)?
MPL                 mozilla     mozilla public licen[cs]e
MPL-2.0             mpl         mpl(?: version| v)? v?2(?: 0)?
EPL-1.0             eclipse     eclipse public licen[cs]e(?: version| v)? v?1(?: 0)?
EPL-2.0             eclipse     eclipse public licen[cs]e(?: version| v)? v?2(?: 0)?
EPL                 eclipse     eclipse public licen[cs]e
CPL-1.0             common      common public licen[cs]e(?: version| v)? v?1(?: 0)?
CDDL-1.0            cddl        cddl(?: version| v)? v?1(?: 0)?
CDDL-1.1            cddl        cddl(?: version| v)? v?1 1
CDDL                distribution  common development and distribution licen[cs]e
EUPL-1.1            eupl        eupl(?: version| v)? v?1 1
EUPL-1.2            eupl        eupl(?: version| v)? v?1 2
EUPL                european    european union public licen[cs]e
Artistic-1.0        artistic    artistic licen[cs]e(?: version| v)? v?1(?: 0)?
Artistic-2.0        artistic    artistic licen[cs]e(?: version| v)? v?2(?: 0)?
Artistic            artistic    artistic licen[cs]e
BSL-1.0             boost       boost software licen[cs]e(?: version 1 0| v1 0| 1 0)?
BUSL-1.1            business    business source licen[cs]e(?: version 1 1| v1 1| 1 1)?
SSPL-1.0            side        server side public licen[cs]e(?: version 1 0| v1 0| 1 0)?
Elastic-2.0         elastic     elastic licen[cs]e(?: version| v)? v?2(?: 0)?
Zlib                zlib        zlib(?: libpng)? licen[cs]e
Libpng              libpng      libpng licen[cs]e
curl                curl        curl licen[cs]e
PostgreSQL          postgresql  postgresql licen[cs]e
PHP-3.01            php         php licen[cs]e(?: version| v)? v?3 0?1
PSF-2.0             python      python software foundation licen[cs]e(?: version 2| v2| 2)?
Ruby                ruby        ruby licen[cs]e
OpenSSL             openssl     openssl licen[cs]e
NCSA                ncsa        (?:university of illinois )?ncsa(?: open source)? licen[cs]e
Unlicense           unlicense   the unlicense
WTFPL               wtfpl       wtfpl(?: version 2| v2| 2)?
WTFPL               fuck        do what the fuck you want to public licen[cs]e
Beerware            beerware    beerware(?: licen[cs]e)?
OFL-1.1             font        (?:sil )?open font licen[cs]e(?: version 1 1| v1 1| 1 1)?
ODbL-1.0            database    open database licen[cs]e(?: version 1 0| v1 0| 1 0)?
ODC-By-1.0          attribution open data commons attribution licen[cs]e
PDDL-1.0            dedication  (?:open data commons )?public domain dedication and licen[cs]e
OGL-UK-3.0          government  open government licen[cs]e(?: version| v)? v?3(?: 0)?
OGL-UK              government  open government licen[cs]e
OSL-3.0             open        open software licen[cs]e(?: version| v)? v?3(?: 0)?
AFL-3.0             academic    academic free licen[cs]e(?: version| v)? v?3(?: 0)?
MS-PL               microsoft   microsoft public licen[cs]e
MS-RL               microsoft   microsoft reciprocal licen[cs]e
Vim                 vim         vim licen[cs]e
W3C                 w3c         w3c(?: software)?(?: notice and)? licen[cs]e
ZPL-2.1             zope        zope public licen[cs]e(?: version 2 1| v2 1| 2 1)?
CC0-1.0             cc0         cc0(?: 1 0)?(?: universal)?
CC0-1.0             zero        creative commons zero(?: licen[cs]e)?(?: 1 0)?
CC-BY-NC-ND         noncommercial  (?:creative commons )?attribution noncommercial noderivatives(?: 4 0)?(?: international)?
CC-BY-NC-SA         noncommercial  (?:creative commons )?attribution noncommercial sharealike(?: 4 0)?(?: international)?
CC-BY-NC            noncommercial  (?:creative commons )?attribution noncommercial(?: 4 0)?(?: international)?
CC-BY-ND            noderivatives  (?:creative commons )?attribution noderivatives(?: 4 0)?(?: international)?
CC-BY-SA            sharealike  (?:creative commons )?attribution sharealike(?: 4 0)?(?: international)?
CC-BY               creative    creative commons attribution(?: 4 0)?(?: international)?(?: licen[cs]e)?
CC-BY               cc          cc by(?: 1 0| 2 0| 2 5| 3 0| 4 0)
CC-BY-SA            cc          cc by sa(?: 1 0| 2 0| 2 5| 3 0| 4 0)?
CC-BY-ND            cc          cc by nd(?: 1 0| 2 0| 2 5| 3 0| 4 0)?
CC-BY-NC            cc          cc by nc(?: 1 0| 2 0| 2 5| 3 0| 4 0)?
CC-BY-NC-SA         cc          cc by nc sa(?: 1 0| 2 0| 2 5| 3 0| 4 0)?
CC-BY-NC-ND         cc          cc by nc nd(?: 1 0| 2 0| 2 5| 3 0| 4 0)?
Proprietary         proprietary proprietary and confidential
Public-Domain       domain      (?:released|placed|dedicated) (?:in|into|to) the public domain
"""

#: Sentences of license texts and notices, which name no license: label, keyword, words.
TEXTS = """
MIT                 merge       without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
MIT                 copies      the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
ISC                 fee         permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
BSD-2-Clause        binary      redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
BSD-2-Clause        retain      redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
BSD-3-Clause        endorse     neither the names? of .{1,80}? may be used to endorse or promote products derived from this software without specific prior written permission
BSD-4-Clause        advertising all advertising materials mentioning features or use of this software must display the following acknowledge?ment
Apache-2.0          compliance  you may not use this file except in compliance with the license
Apache-2.0          perpetual   perpetual worldwide non exclusive no charge royalty free irrevocable
GPL-notice          redistribute  you can redistribute it and or modify it under the terms of the gnu(?: lesser| library| affero)? general public license
GPL-notice          useful      distributed in the hope that it will be useful but without any warranty
GPL-notice          copyleft    the gnu general public license is a free copyleft license for software and other kinds of works
GPL-notice          foundation  published by the free software foundation either version [123] of the license or(?: at your option)? any later version
MPL-2.0             obtain      if a copy of the mpl was not distributed with this file you can obtain one at
EPL-2.0             accompanying  this program and the accompanying materials are made available under the terms of the eclipse public license
Zlib                misrepresented  the origin of this software must not be misrepresented you must not claim that you wrote the original software
Zlib                altered     altered source versions must be plainly marked as such and must not be misrepresented as being the original software
BSL-1.0             organization  permission is hereby granted free of charge to any person or organization obtaining a copy of the software
Unlicense           unencumbered  this is free and unencumbered software released into the public domain
WTFPL               fuck        you just do what the fuck you want to
Beerware            beer        you can buy me a beer in return
OFL-1.1             reserved    with reserved font names?
CC0-1.0             waived      has waived all copyright and related or neighboring rights to
CC-BY               appropriate you must give appropriate credit provide a link to the license and indicate if changes were made
PSF-2.0             psf         psf hereby grants licensee a nonexclusive royalty free world wide license
NCSA                deal        to deal with the software without restriction
MS-PL               contributor each contributor grants you a non exclusive worldwide royalty free copyright license
"""

#: Phrases that hint at terms without naming them: label, keyword, words.
HINTS = """
gpl                 gnu         gnu gpl
gpl                 gpl         under(?: the)? gpl
bsd                 bsd         bsd(?: style)? licen[cs]e
apache              apache      apache(?: software)? licen[cs]e
creative-commons    creative    creative commons
copyright           copyright   copyright(?: c)?(?: by)? (?:19|20)[0-9]{2}
copyright           copyrighted (?:is|are) copyrighted
notice              permission  permission is hereby granted
notice              warranty    without warranty of any kind
notice              warranties  without warranties of any kind
notice              warranty    as is without(?: any)? warranty
notice              merchantability  (?:implied )?warranties of merchantability
notice              noninfringement  (?:and|or) noninfringement
notice              liable      in no event shall .{1,60}? be liable
restricted          permission  without(?: the)?(?: express| prior)*(?: written)? permission
restricted          reproduced  may(?: not)? be reproduced
restricted          redistribute  (?:do|may) not redistribute
restricted          commercial  (?:non|not for) commercial use(?: only)?
restricted          confidential  strictly confidential
terms               licensed    licensed under
terms               licensed    licensed to you under
terms               terms       terms of use
terms               released    released under the terms of
terms               dual        dual licensed
terms               royalty     royalty free
public-domain       domain      public domain
free-software       libre       free libre(?: and)? open source software
shareware           shareware   shareware
freeware            freeware    freeware
eula                eula        (?:end user licen[cs]e agreement )?eula
eula                agreement   end user licen[cs]e agreement
"""

#: Identifiers that a tag "SPDX-License-Identifier:" may name; the label is the identifier.
TAGS = """
0BSD AAL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0
Artistic-1.0 Artistic-2.0 Beerware BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1
CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.0 CECILL-2.1
CECILL-B CECILL-C CPAL-1.0 CPL-1.0 curl ECL-2.0 EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 Fair FTL GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-2.0-only
GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ICU IJG IPL-1.0 ISC JSON LGPL-2.0 LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only
LGPL-3.0-or-later Libpng LPL-1.02 LPPL-1.3c MirOS MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NASA-1.3 NCSA NTP ODbL-1.0 OFL-1.1 OpenSSL OSL-2.1
OSL-3.0 PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SSPL-1.0 TCL Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
"""


def _rules() -> list[tuple[int, str, int, str, str]]:
    """``rule, label, level, keyword, pattern`` in order; patterns are over words parted by one blank."""
    found = [(label, BASE, word, words) for label, word, words in PHRASES]
    for level, lines in ((1, HINTS), (2, NAMES), (3, TEXTS)):
        found += [(label, level, word, words) for label, word, words in (line.split(None, 2) for line in lines.strip().splitlines())]
    for tag in TAGS.split():
        found.append((tag, 3, "spdx", "spdx license identifier " + tag.lower().replace("-", " ").replace(".", " ")))
    return [(i, *r) for i, r in enumerate(found)]


RULES = _rules()


def _wide(pattern: str) -> str:
    """A pattern over texts whose words have a blank of their own on either side, so that neighbours share none."""
    return f" {pattern.replace(' ', '  ')} "


def _count(text: Column) -> Column:
    """Words of a piece of wide text: each has two blanks."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / 2).cast("int")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_row, key, n_words`` and a row a match of a rule: ``rule, label, level, at, before, words`` (its number among
    the rule's matches, and the words between it and the match before, and in it). A document without any
    has one row, with nulls."""
    plain = F.trim(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), FROM, TO))
    keywords = F.split(F.lit(" ".join(sorted({r[3] for r in RULES}))), " ")
    # one literal, folded when the plan is optimised
    rules = F.from_json(F.lit(json.dumps([{"rule": i, "label": label, "level": level, "keyword": word, "pattern": _wide(p)} for i, label, level, word, p in RULES])), "array<struct<rule int, label string, level int, keyword string, pattern string>>")
    rows = docs.select(F.col(key), F.regexp_replace(plain, " +", "  ").alias("_t")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.withColumn("_words", F.when(F.col("_t") == "", F.array().cast("array<string>")).otherwise(F.split("_t", "  ")))
    rows = rows.select("_row", key, F.size("_words").cast("long").alias("n_words"), F.array_intersect("_words", keywords).alias("_held"), F.concat(F.lit(" "), "_t", F.lit(" ")).alias("_t"))
    # Only rules whose keyword is held are tried, and only what matches goes on. A match is marked at both ends
    # and the text split at the marks, in one pass each; words have no control characters.
    parted = lambda r: F.split(F.regexp_replace("_t", r["pattern"], F.lit("\x01$0\x01")), "\x01")
    tried = F.transform(F.filter(rules, lambda r: F.array_contains("_held", r["keyword"])), lambda r: F.struct(r["rule"].alias("rule"), r["label"].alias("label"), r["level"].alias("level"), F.transform(parted(r), _count).alias("p")))
    met = rows.withColumn("_r", F.explode_outer(F.when(F.size("_held") > 0, F.filter(tried, lambda r: F.size(r["p"]) > 1))))
    before, inside = F.filter("_r.p", lambda x, i: i % 2 == 0), F.filter("_r.p", lambda x, i: i % 2 == 1)
    cells = F.zip_with(F.slice(before, F.lit(1), F.size(inside)), inside, lambda x, y: F.struct(x.alias("before"), y.alias("words")))
    listed = met.select("_row", key, "n_words", "_r.rule", "_r.label", "_r.level", F.when(F.col("_r").isNotNull(), cells).alias("_c"))
    return listed.select("_row", key, "n_words", "rule", "label", "level", F.posexplode_outer("_c").alias("at", "_c")).select("_row", key, "n_words", "rule", "label", "level", "at", "_c.before", "_c.words")


def resolved(found: DataFrame) -> DataFrame:
    """Detections of ``scan`` as intervals ``begin, end`` (end exclusive) of words, with ``kept``."""
    hits = found.filter("rule is not null").repartition("_row")
    upto = Window.partitionBy("_row", "rule").orderBy("at")
    hits = hits.withColumn("end", F.sum(F.col("before") + F.col("words")).over(upto)).withColumn("begin", F.col("end") - F.col("words")).drop("before", "words", "at")
    earlier = Window.partitionBy("_row").orderBy("begin", F.desc("end"), F.desc("level"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("level") >= i, F.col("end"))).over(earlier) for i in range(len(WEIGHTS))]
    hits = hits.withColumn("_reach", F.element_at(F.array(*reach), F.col("level") + 1))
    return hits.withColumn("kept", (F.col("level") == BASE) | F.coalesce(F.col("_reach") < F.col("end"), F.lit(True))).drop("_reach")


def detections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, rule, label, level, begin, end, kept``: every match of a rule, as words from 0."""
    return resolved(written(scan(docs, key, text))).select(key, "rule", "label", "level", "begin", "end", "kept")


def report(docs: DataFrame) -> DataFrame:
    """One row a document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    found = written(scan(docs))
    base, kept = F.col("level") == BASE, F.col("kept")
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")  # noqa: E731  as many labels as rules at most
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("level") + 1)
    held = resolved(found).groupBy("_row", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("begin"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("begin"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.when(kept, F.col("label"))).alias("labels"),
        F.max(F.when(kept, weight)).alias("score"),
    )
    none = F.lit(None).cast("long")
    bare = found.filter("rule is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), none.alias("first_word"), none.alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"))
    return held.drop("_row").unionByName(bare)


def _sql() -> str:
    """The report in DuckDB's SQL, from the same rules."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ",\n".join(f"({i}, {text(label)}, {level}, {WEIGHTS[level]}::DOUBLE, {text(word)}, {text(_wide(p))})" for i, label, level, word, p in RULES)
    return rf"""
WITH rules(rule, label, level, weight, keyword, pattern) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, ' ' || trim(regexp_replace(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g'), ' ') || ' ' AS t FROM documents),
met AS (SELECT rid, doc_id, t, rule, label, level, weight, pattern, regexp_extract_all(t, pattern) AS m FROM docs JOIN rules ON contains(t, ' ' || keyword || ' ')),
cells AS (SELECT rid, rule, label, level, weight, string_split_regex(t, pattern) AS p, m, unnest(range(1, len(m) + 1)) AS i FROM met WHERE len(m) > 0),
counted AS (SELECT rid, rule, label, level, weight, i, (length(p[i]) - length(replace(p[i], ' ', ''))) // 2 AS before, (length(m[i]) - length(replace(m[i], ' ', ''))) // 2 AS words FROM cells),
places AS (SELECT rid, rule, label, level, weight, words, sum(before + words) OVER (PARTITION BY rid, rule ORDER BY i)::BIGINT AS e FROM counted),
spans AS (SELECT *, e - words AS b FROM places),
kept AS (SELECT * FROM spans d WHERE level = 0 OR NOT EXISTS (SELECT 1 FROM spans c WHERE c.rid = d.rid AND c.b <= d.b AND c.e >= d.e AND c.level >= d.level
  AND (c.words > d.words OR (c.words = d.words AND (c.level > d.level OR (c.level = d.level AND c.rule < d.rule)))))),
base AS (SELECT rid, count(*) AS n_base, min(b) AS first_word, max(b) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM spans WHERE level = 0 GROUP BY rid),
named AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight) AS score FROM kept GROUP BY rid)
SELECT doc_id, CASE WHEN t = '  ' THEN 0 ELSE (length(t) - length(replace(t, ' ', ''))) // 2 END AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM docs LEFT JOIN base USING (rid) LEFT JOIN named USING (rid)"""


SQL = _sql()
