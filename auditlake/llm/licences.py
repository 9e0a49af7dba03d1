"""Licence scans by sentence rules: normalised sentences become licence-sentence ids, id sequences are matched against ordered rules.

A text is first cut into segments that no sentence crosses: at blank lines, around copyright lines, after headings that name a licence, and at
the numbers or bullets of clauses. Within a segment a sentence may be a line or run over line ends.

Everything is a column expression over one row, so a scan needs no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: sentences of public licence texts and notices, normalised (lower case, runs of other characters than letters
# and digits as one space)
SENTENCES: dict[str, str] = {
    "mit-ref": "released under the mit license",
    "mit-ref-2": "licensed under the mit license",
    "mit-ref-3": "this project is licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-grant-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection "
    "with the software or the use or other dealings in the software",
    "apache-ref": "licensed under the apache license version 2 0",
    "apache-grant": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed "
    "on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-obtain": "you may obtain a copy of the license at",
    "apache-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
    "either express or implied",
    "apache-limits": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl3-ref-2": "licensed under the gnu general public license version 3",
    "gpl3-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the "
    "license or at your option any later version",
    "gpl2-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the "
    "license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "bsd-forms": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-names-owner": "neither the name of the copyright owner nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and "
    "fitness for a particular purpose are disclaimed",
    "bsd-liability": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of "
    "substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or "
    "otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd-liability-owner": "in no event shall the copyright owner or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement "
    "of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or "
    "otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-liability": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of "
    "contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "lgpl21-grant": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either "
    "version 2 1 of the license or at your option any later version",
    "agpl3-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either "
    "version 3 of the license or at your option any later version",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc-by-nc-ref": "licensed under cc by nc 4 0",
    "cc-by-ref": "licensed under cc by 4 0",
    "cc-by-sa-ref": "licensed under cc by sa 4 0",
    "cc-by-nc-ref-2": "this work is licensed under cc by nc 4 0",
    "cc-by-ref-2": "this work is licensed under cc by 4 0",
    "cc-by-sa-ref-2": "this work is licensed under cc by sa 4 0",
}

#: Ordered rules: a licence and the sentence ids it takes, one after the other (unknown sentences may stand between). An earlier rule
#: takes its sentences away from later ones, so longer rules come first.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant-notice", "mit-warranty", "mit-liability"]),
    ("Apache-2.0", ["apache-grant", "apache-obtain", "apache-unless", "apache-limits"]),
    ("Apache-2.0", ["apache-grant", "apache-copy", "apache-limits"]),
    ("GPL-3.0-or-later", ["gpl3-grant", "gpl-warranty", "gpl-details", "gpl-copy"]),
    ("GPL-2.0-or-later", ["gpl2-grant", "gpl-warranty", "gpl-details", "gpl-copy"]),
    ("GPL-3.0-or-later", ["gpl3-grant", "gpl-warranty", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-grant", "gpl-warranty", "gpl-details"]),
    ("BSD-3-Clause", ["bsd-forms", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty", "bsd-liability"]),
    ("BSD-3-Clause", ["bsd-forms", "bsd-source", "bsd-binary", "bsd-names-owner", "bsd-warranty", "bsd-liability-owner"]),
    ("BSD-3-Clause", ["bsd-forms", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-3-Clause", ["bsd-forms", "bsd-source", "bsd-binary", "bsd-names-owner"]),
    ("BSD-2-Clause", ["bsd-forms", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability"]),
    ("BSD-2-Clause", ["bsd-forms", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant", "isc-warranty", "isc-liability"]),
    ("ISC", ["isc-grant", "mit-warranty"]),
    ("ISC", ["isc-grant"]),
    ("MIT", ["mit-grant-notice"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-ref"]),
    ("MIT", ["mit-ref-2"]),
    ("MIT", ["mit-ref-3"]),
    ("Apache-2.0", ["apache-grant"]),
    ("Apache-2.0", ["apache-ref"]),
    ("GPL-3.0-or-later", ["gpl3-grant"]),
    ("GPL-2.0-or-later", ["gpl2-grant"]),
    ("LGPL-2.1-or-later", ["lgpl21-grant"]),
    ("AGPL-3.0-or-later", ["agpl3-grant"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("Unlicense", ["unlicense"]),
    ("GPL-3.0-only", ["gpl3-ref"]),
    ("GPL-3.0-only", ["gpl3-ref-2"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-ref"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-ref-2"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-ref"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-ref-2"]),
    ("CC-BY-4.0", ["cc-by-ref"]),
    ("CC-BY-4.0", ["cc-by-ref-2"]),
]

_NAMES, _KNOWN = list(SENTENCES), list(SENTENCES.values())
_LEAST, _MOST = min(map(len, _KNOWN)), max(map(len, _KNOWN))


#: Every sentence holds one of these: other segments need no closer look.
_TELLING = ("licen", "permission", "redistribut", "warrant", "liab", "copyright", "public domain")
_HINT = f"(?i){'|'.join(_TELLING)}"
_BREAK = "\x01"
#: (pattern, what stands for it, with the groups' numbers in braces); the patterns mean the same in Java and in RE2.
_CUTS = [
    (r"\r\n?", "\n"),
    # around a copyright line
    (r"(?mi)^([^\w\n]*(?:copyright[ \t]*(?:\([cC]\)|©|[0-9]{4}|<|\[)|\([cC]\)[ \t]*[0-9]{4}|©)[^\n]*)$", _BREAK + "{1}" + _BREAK),
    # after a heading that names a licence
    (r"(?m)^([A-Z][^\n.,]{0,40}Licen[sc]e(?: \([A-Za-z0-9.-]+\))?)[ \t]*\n([A-Z])", "{1}" + _BREAK + "{2}"),
    # before a clause's number or bullet, which goes
    (r"(?m)^[ \t]*(?:[0-9]{1,2}[.)]|\([a-z0-9]{1,2}\))[ \t]+", _BREAK),
    (r"(?m)^[ \t]*[*•-][ \t]+([A-Z][a-z])", _BREAK + "{1}"),
    # the signs that begin comment lines
    (r"(?m)^[ \t]*(?:#+|//+|\*+/?|;+|/\*+)[ \t]*", ""),
    (r"\n[ \t]*\n\s*", _BREAK),
]


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def _ids(sentences: Column) -> Column:
    """Places (from 1) in ``SENTENCES`` of the known sentences among ``sentences``, in order."""
    possible = F.filter(sentences, lambda x: F.length(x).between(_LEAST, 4 * _MOST))
    known = F.array(*[F.lit(x) for x in _KNOWN])
    return F.filter(F.transform(possible, lambda x: F.array_position(known, _normal(x))), lambda i: i > 0)


def _segment_ids(segment: Column) -> Column:
    """Of the sentences that are lines (or parts of them) and of those that run over line ends: those of either way that finds all, else of both."""
    by_line = _ids(F.split(F.regexp_replace(segment, r"([.!?])\s+", "$1\n"), "\n"))
    running = _ids(F.split(F.regexp_replace(F.regexp_replace(segment, r"\s+", " "), r"([.!?]) ", "$1\n"), "\n"))
    one = F.when(F.size(F.array_except(running, by_line)) == 0, by_line).when(F.size(F.array_except(by_line, running)) == 0, running)
    return one.otherwise(F.array_distinct(F.concat(by_line, running)))


def sentence_ids(text: Column) -> Column:
    """Ids of the licence sentences in a text, in order."""
    cut = text
    for pattern, put in _CUTS:
        cut = F.regexp_replace(cut, pattern, put.replace("{1}", "$1").replace("{2}", "$2"))
    segments = F.filter(F.split(cut, _BREAK), lambda x: F.rlike(x, F.lit(_HINT)))
    places = F.when(F.rlike(text, F.lit(_HINT)), F.flatten(F.transform(segments, _segment_ids)))
    names = F.array(*[F.lit(x) for x in _NAMES])
    return F.coalesce(F.transform(places, lambda i: F.element_at(names, i.cast("int"))), F.array().cast("array<string>"))


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_sentences, sentence_ids, licences)`` per row of ``docs (doc_id, text)``.

    ``sentence_ids``: the known sentences in order, as ``<id>`` after ``<id>``; ``licences``: the distinct licences whose rules match, sorted and joined
    by commas. Null and empty texts have none: 0 and empty strings. Repeated rows give repeated rows; other columns are ignored.
    """
    found = docs.select("doc_id", sentence_ids(F.col("text")).alias("ids"))
    found = found.select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"),
        F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "").alias("sentence_ids"),
    )
    left, matched = F.col("sentence_ids"), []
    for licence, ids in RULES:
        sequence = F.lit("".join(f"<{x}>" for x in ids))
        matched.append(F.when(F.contains(left, sequence), F.lit(licence)))
        left = F.replace(left, sequence, F.lit("|"))
    licences = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*matched)))), ",")
    return found.withColumn("licences", F.when(F.col("n_sentences") > 0, licences).otherwise(F.lit("")))


def scan_sql() -> str:
    """The same scan as DuckDB SQL over the view ``documents``."""
    def quoted(x: str) -> str:
        return "'" + x + "'"

    def split(text: str) -> str:
        normal = "trim(regexp_replace(lower(x), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
        return (
            f"list_filter(list_transform(list_filter(string_split({text}, chr(10)), lambda x: length(x) between {_LEAST} and {4 * _MOST}), "
            f"lambda x: list_position([{', '.join(map(quoted, _KNOWN))}], {normal})), lambda i: i > 0)"
        )

    def put(what: str) -> str:
        return "'" + what.replace("{1}", "\\1").replace("{2}", "\\2").replace("\n", "' || chr(10) || '").replace(_BREAK, "' || chr(1) || '") + "'"

    cut = "coalesce(text, '')"
    for pattern, what in _CUTS:
        cut = f"regexp_replace({cut}, '{pattern}', {put(what)}, 'g')"

    steps, last = [], "found"
    for k, (_, ids) in enumerate(RULES):
        sequence = quoted("".join(f"<{x}>" for x in ids))
        steps.append(f"s{k} as (select * exclude (rest), contains(rest, {sequence}) as m{k}, replace(rest, {sequence}, '|') as rest from {last})")
        last = f"s{k}"
    licences = ", ".join(f"case when m{k} then {quoted(name)} end" for k, (name, _) in enumerate(RULES))
    ws = r"[ \t\n\v\f\r]"
    return f"""
with pieces as (
  select row_number() over () as row, doc_id, list_filter(string_split({cut}, chr(1)), lambda x: regexp_matches(x, '{_HINT}')) as pieces from documents),
parts as (select row, unnest(pieces) as piece, unnest(range(len(pieces))) as place from pieces),
lines as (
  select row, place, {split(f"regexp_replace(piece, '([.!?]){ws}+', '\\1' || chr(10), 'g')")} as a,
    {split(f"regexp_replace(regexp_replace(piece, '{ws}+', ' ', 'g'), '([.!?]) ', '\\1' || chr(10), 'g')")} as b
  from parts),
told as (
  select row, flatten(list(case when list_has_all(a, b) then a when list_has_all(b, a) then b
    else list_filter(list_concat(a, b), lambda x, i: list_position(list_concat(a, b), x) = i) end order by place)) as places from lines group by row),
named as (
  select doc_id, list_transform(coalesce(places, []), lambda i: [{', '.join(map(quoted, _NAMES))}][i]) as ids from pieces left join told using (row)),
found as (
  select doc_id, cast(len(ids) as bigint) as n_sentences, array_to_string(list_transform(ids, lambda x: '<' || x || '>'), '') as sentence_ids,
    array_to_string(list_transform(ids, lambda x: '<' || x || '>'), '') as rest from named),
{", ".join(steps)}
select doc_id, n_sentences, coalesce(sentence_ids, '') as sentence_ids,
  coalesce(array_to_string(list_sort(list_distinct(list_filter([{licences}], lambda x: x is not null))), ','), '') as licences from {last}"""
