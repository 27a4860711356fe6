"""Licence scans by sentence rules.

A text is cut into sentences at ``.``, ``!``, ``?`` before white space or a line
end, and a sentence into its lines. Lines are normalised (A-Z lower-cased, runs
of other characters than ``[a-z0-9]`` to one blank; lines without any are left
out). A known licence sentence is found where it equals one line or several
consecutive lines of one sentence, so it may be wrapped, span blank lines, and
stand beside other paragraphs without a full stop, such as a copyright line.
Identifiers are listed in the order of their first line, the longer one first
at the same line. A licence rule is an ordered list of identifiers; it matches
when they occur in this order in the document's identifier sequence, other
sentences between them allowed. A rule that is part of a longer one is tried on
what is left when the longer one's matches are taken out, so a three-clause text
is not a two-clause text as well; a ``LAST`` licence is named only where no
other one is.

A line loses an opening (``this project is``), so statements about any subject
are one sentence; an enumeration mark after a colon (``are met: 1.``) is a line
end; no sentence is found after a line that ends in an ``OPEN`` word (``is not``).

Everything is one expression in the scan stage. Every known sentence holds an
anchor word, so texts without any anchor are not cut at all.

Defined cases: null or empty text has no sentence and no licence; a repeated
sentence counts each time; repeated rows are scanned one by one; an empty table
gives an empty result. The dictionary is a parameter of at most
``MAX_SENTENCES`` entries (checked).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from tidemark.functions.sqltext import lit, str_array

MAX_SENTENCES = 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Known sentences by identifier (fixed values: public licence texts, normalised).
SENTENCES: dict[str, str] = {
    "mit_short": "released under the mit license",
    "mit_short_2": "licensed under the mit license",
    "mit_grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
        "permit persons to whom the software is furnished to do so subject to the following conditions the above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "software"),
    "as_is": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to "
        "the warranties of merchantability fitness for a particular purpose and noninfringement"),
    "apache_short": "licensed under the apache license version 2 0",
    "apache_head": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
        "with the license"),
    "apache_limits": (
        "see the license for the specific language governing permissions and limitations under the license"),
    "gpl3_short": "this work is licensed under the gnu general public license version 3",
    "isc_grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies"),
    "mpl_head": "this source code form is subject to the terms of the mozilla public license v",
    "zlib_grant": (
        "permission is granted to anyone to use this software for any purpose including commercial applications and "
        "to alter it and redistribute it freely subject to the following restrictions"),
    "cc_by": "licensed under cc by 4 0",
    "cc_by_sa": "licensed under cc by sa 4 0",
    "cc_by_nc": "licensed under cc by nc 4 0",
    "bsd_use": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met"),
    "bsd_source": (
        "redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer"),
    "bsd_binary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution"),
    "bsd_names": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission"),
    "reserved": "all rights reserved",
}
#: GNU licences: identifier, name, versions (heads differ in name and version only).
GNU = (("gpl", "general", "GPL", ("2", "3")), ("lgpl", "lesser general", "LGPL", ("2.1", "3")),
       ("agpl", "affero general", "AGPL", ("3",)))
for _id, _name, _, _versions in GNU:
    SENTENCES[f"{_id}_copy"] = (
        f"you should have received a copy of the gnu {_name} public license along with this program")
    SENTENCES[f"{_id}_copy_lib"] = SENTENCES[f"{_id}_copy"].replace("program", "library")
    for _v in _versions:
        SENTENCES[f"{_id}{_v[0]}_head"] = (
            "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            f"{_name} public license as published by the free software foundation either version "
            f"{_v.replace('.', ' ')} of the license or at your option any later version")
#: (licence, identifiers in order); a licence may have several rules.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache_short",)),
    ("Apache-2.0", ("apache_head", "apache_limits")),
    ("BSD-2-Clause", ("bsd_use", "bsd_source", "bsd_binary")),
    ("BSD-3-Clause", ("bsd_use", "bsd_source", "bsd_binary", "bsd_names")),
    ("CC-BY-4.0", ("cc_by",)),
    ("CC-BY-NC-4.0", ("cc_by_nc",)),
    ("CC-BY-SA-4.0", ("cc_by_sa",)),
    ("GPL-3.0", ("gpl3_short",)),
    *((f"{short}-{v if '.' in v else v + '.0'}", (f"{i}{v[0]}_head", f"{i}_copy{lib}"))
      for i, _, short, versions in GNU for v in versions for lib in ("", "_lib")),
    ("ISC", ("isc_grant",)),
    ("MIT", ("mit_short",)),
    ("MIT", ("mit_short_2",)),
    ("MIT", ("mit_grant", "as_is")),
    ("MPL-2.0", ("mpl_head",)),
    ("Proprietary", ("reserved",)),
    ("Zlib", ("zlib_grant",)),
)
#: Licences named only where no other licence is.
LAST = ("Proprietary",)
#: What a sentence may open with, and words that leave a line's sentence open.
OPENING = ("^(this (project|software|code|library|package|program|repository|file|document|text|work|module|tool) is"
           "|it is)( |$)")
OPEN = ("not", "never", "nor", "no", "neither", "longer", "t", "cannot")
#: An enumeration mark behind a colon.
MARK = "(:[ \\t\\r\\n*#/;-]*)[(]?([0-9]{1,2}|[a-z])[.)][ \\t]+"
ANCHORS = ("license", "rights reserved", "permission", "licensed", "redistribution", "without warranty")
#: A sentence's end.
_END = "[.!?][ \\t\\r\\f\\n]+"


def _order(ids: tuple[str, ...]) -> str:
    """A pattern for the identifiers in order in ``|a||b|`` text."""
    return ".*".join(f"[|]{i}[|]" for i in ids)


def _longer(ids: tuple[str, ...], rules: tuple) -> list[tuple[str, ...]]:
    """The rules that hold all of ``ids`` in order and more, longest first."""
    def part(other: tuple[str, ...]) -> bool:
        left = iter(other)
        return len(other) > len(ids) and all(i in left for i in ids)

    return sorted({r for _, r in rules if part(r)}, key=lambda r: (-len(r), r))


def _take_out(ids: tuple[str, ...], group: str) -> tuple[str, str]:
    """Pattern and replacement that take one match out of a sequence each time."""
    return ("(.*?)".join(f"[|]{i}[|]" for i in ids), "".join(f"{group}{j}" for j in range(1, len(ids))))


def _opened(sentences: dict[str, str]) -> dict[str, str]:
    """The sentences without their openings, as lines are compared."""
    return {k: re.sub(OPENING, "", s) for k, s in sentences.items()}


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 sentences: dict[str, str] | None = None,
                 rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES,
                 anchors: tuple[str, ...] = ANCHORS, last: tuple[str, ...] = LAST) -> DataFrame:
    """doc_id, n_license_sentences, sentence_ids (in order), licenses (sorted,
    joined by '+', null without any) of every document."""
    known = _opened(SENTENCES if sentences is None else sentences)
    if len(known) > MAX_SENTENCES:
        raise ValueError(f"more than {MAX_SENTENCES} sentences")
    for s in known.values():
        if not any(a in s for a in anchors):
            raise ValueError(f"no anchor in: {s}")
    # an anchor of several words may be wrapped or punctuated in a text, so only its longest word is looked for
    words = sorted({max(a.split(), key=len) for a in anchors})
    held = " or ".join(f"contains(low, {lit(w)})" for w in words)
    longest = sorted(known, key=lambda k: -len(known[k]))
    table = "array(" + ", ".join(f"named_struct('s', {lit(known[k])}, 'n', {len(known[k].split())}, 'id', {lit(k)})"
                                 for k in longest) + ")"
    lines = ("filter(transform(split(p, '\n'), x -> regexp_replace(trim(regexp_replace(x, '[^a-z0-9]+', ' ')), "
             f"{lit(OPENING)}, '')), x -> x <> '')")
    closed = f"(i = 0 or not get(ls, i - 1) rlike {lit('(^| )(' + '|'.join(OPEN) + ')$')})"
    # a run of lines that equals a sentence has at most as many lines as the sentence has words
    equal = (f"startswith(k.s, x) and {closed}"
             " and (x = k.s or startswith(concat(array_join(slice(ls, i + 1, k.n), ' '), ' '), "
             "concat(k.s, ' ')) and exists(sequence(1, least(k.n, size(ls) - i)), "
             "m -> array_join(slice(ls, i + 1, m), ' ') = k.s))")
    hits = f"flatten(transform(ls, (x, i) -> transform(filter({table}, k -> {equal}), k -> k.id)))"
    marked = f"regexp_replace(low, {lit(MARK)}, '$1\n')"
    seq = (f"case when {held} then flatten(transform(transform(split({marked}, {lit(_END)}), p -> {lines}), ls -> {hits})) "
           "else cast(array() as array<string>) end")

    def fits(rule: tuple[str, ...]) -> str:
        rest = "seq"
        for other in _longer(rule, rules):
            pattern, left = _take_out(other, "$")
            rest = f"regexp_replace({rest}, {lit(pattern)}, {lit(left)})"
        return f"{rest} rlike {lit(_order(rule))}"

    def names(of: list) -> str:
        each = ", ".join(f"case when {fits(r)} then {lit(name)} end" for name, r in of)
        return (f"nullif(array_join(array_sort(array_distinct(filter(array({each or 'cast(null as string)'}), "
                "x -> x is not null))), '+'), '')")

    found = f"coalesce({names([r for r in rules if r[0] not in last])}, {names([r for r in rules if r[0] in last])})"
    return (
        docs.selectExpr(f"`{doc_id}` as doc_id", f"coalesce(translate(`{text}`, '{UPPER}', '{LOWER}'), '') as low")
        .selectExpr("doc_id", f"{seq} as ids")
        .selectExpr("doc_id", "ids", "concat('|', array_join(ids, '||'), '|') as seq")
        .selectExpr("doc_id", "cast(size(ids) as bigint) as n_license_sentences",
                    "array_join(ids, ',') as sentence_ids",
                    f"{found} as licenses")
    )


def license_scan_sql() -> str:
    """DuckDB SQL of the rows of texts whose known sentences are each one line, or stand alone between sentence
    ends: every sentence looked up, those found only with line ends as blanks after the others."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    keys = "[" + ", ".join(q(s) for s in _opened(SENTENCES).values()) + "]"
    names = "[" + ", ".join(q(s) for s in SENTENCES) + "]"

    def ids(t: str) -> str:
        return (f"list_filter(list_transform(string_split(regexp_replace({t}, '([.!?])[ \\t\\r\\f]+', "
                f"'\\1' || chr(10), 'g'), chr(10)), lambda s: ({names})[list_position({keys}, "
                f"regexp_replace(trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')), '{OPENING}', ''))]), "
                "lambda x: x is not null)")

    blank = "translate(low, chr(10) || chr(13) || chr(9), '   ')"

    def fits(rule: tuple[str, ...]) -> str:
        rest = "seq"
        for other in _longer(rule, RULES):
            pattern, left = _take_out(other, "\\")
            rest = f"regexp_replace({rest}, {q(pattern)}, {q(left)}, 'g')"
        return f"regexp_matches({rest}, {q(_order(rule))})"

    def licences(of: list) -> str:
        each = ", ".join(f"case when {fits(r)} then {q(n)} end" for n, r in of)
        return f"nullif(array_to_string(list_sort(list_distinct(list_filter([{each}], lambda x: x is not null))), '+'), '')"

    first = licences([r for r in RULES if r[0] not in LAST])
    return f"""
with a as (
  select doc_id, regexp_replace(coalesce(translate(text, '{UPPER}', '{LOWER}'), ''), {q(MARK)}, '\\1' || chr(10), 'g') as low
  from documents),
b as (select doc_id, {ids('low')} as own, {ids(blank)} as joined from a),
c as (select doc_id, list_concat(own, list_filter(joined, lambda x: not list_contains(own, x))) as ids from b),
d as (select doc_id, ids, '|' || array_to_string(ids, '||') || '|' as seq from c)
select doc_id, cast(len(ids) as bigint) as n_license_sentences, array_to_string(ids, ',') as sentence_ids,
       coalesce({first}, {licences([r for r in RULES if r[0] in LAST])}) as licenses
from d
"""
