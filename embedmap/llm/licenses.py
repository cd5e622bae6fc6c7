"""Licence recognition: known licence sentences, then ordered rules over their sequence.

A text is cut into sentences at stops and blank lines. Each line of a sentence is normalised and mapped
to the identifier of the first known licence sentence that it holds; a sentence of several lines is also
read as a whole, for those that run over line ends. The identifiers in order of appearance are matched against the rules
from the longest to the shortest; a rule needs its identifiers next to each other and uses them up, so
the header of one licence is not also read as a shorter one. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: public licence sentences, lower-cased, anything but letters and digits as one space
SENTENCES = (
    ("mit_grant", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit_notice", "the above copyright notice and this permission notice shall be included"),
    ("mit_asis", "the software is provided as is without warranty of any kind"),
    ("mit_named", "(licensed|released|distributed|available) under the (terms of the )?mit license"),
    ("isc_grant", "permission to use copy modify and or distribute this software for any purpose"),
    ("isc_asis", "the software is provided as is and the author disclaims all warranties"),
    ("bsd_head", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd_source", "redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_endorse", "may be used to endorse or promote products derived from this software"),
    ("bsd_asis", "this software is provided by .* as is and any express or implied warranties"),
    ("apache2_named", "licensed under the apache license version 2 0"),
    ("apache2_comply", "you may not use this file except in compliance with the license"),
    ("apache2_copy", "you may obtain a copy of the license at"),
    ("apache2_asis", "software distributed under the license is distributed on an as is basis"),
    ("agpl3_named", "gnu affero general public license.* version 3"),
    ("lgpl_named", "gnu (lesser|library) general public license"),
    ("gpl3_named", "gnu general public license.* version 3"),
    ("gpl2_named", "gnu general public license.* version 2"),
    ("gpl_hope", "in the hope that it will be useful but without any warranty"),
    ("gpl_received", "you should have received a copy of the gnu"),
    ("mpl2_named", "subject to the terms of the mozilla public license v 2 0"),
    ("cc_by_nc_nd", "under (a )?(cc|creative commons) by nc nd [34] 0"),
    ("cc_by_nc_sa", "under (a )?(cc|creative commons) by nc sa [34] 0"),
    ("cc_by_nc", "under (a )?(cc|creative commons) by nc [34] 0"),
    ("cc_by_nd", "under (a )?(cc|creative commons) by nd [34] 0"),
    ("cc_by_sa", "under (a )?(cc|creative commons) by sa [34] 0"),
    ("cc_by", "under (a )?(cc|creative commons) by [34] 0"),
    ("cc0", "under (a )?(cc0|creative commons zero)"),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
)
# fixed values: rules in the order in which they are tried
RULES = (
    ("BSD-3-Clause", ("bsd_head", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_asis")),
    ("BSD-2-Clause", ("bsd_head", "bsd_source", "bsd_binary", "bsd_asis")),
    ("Apache-2.0", ("apache2_named", "apache2_comply", "apache2_copy", "apache2_asis")),
    ("MIT", ("mit_grant", "mit_notice", "mit_asis")),
    ("ISC", ("isc_grant", "isc_asis")),
    ("AGPL-3.0", ("agpl3_named", "gpl_hope", "gpl_received")),
    ("LGPL", ("lgpl_named", "gpl_hope", "gpl_received")),
    ("GPL-3.0", ("gpl3_named", "gpl_hope", "gpl_received")),
    ("GPL-2.0", ("gpl2_named", "gpl_hope", "gpl_received")),
    ("Apache-2.0", ("apache2_named",)),
    ("MIT", ("mit_named",)),
    ("AGPL-3.0", ("agpl3_named",)),
    ("LGPL", ("lgpl_named",)),
    ("GPL-3.0", ("gpl3_named",)),
    ("GPL-2.0", ("gpl2_named",)),
    ("MPL-2.0", ("mpl2_named",)),
    ("CC-BY-NC-ND", ("cc_by_nc_nd",)),
    ("CC-BY-NC-SA", ("cc_by_nc_sa",)),
    ("CC-BY-NC", ("cc_by_nc",)),
    ("CC-BY-ND", ("cc_by_nd",)),
    ("CC-BY-SA", ("cc_by_sa",)),
    ("CC-BY", ("cc_by",)),
    ("CC0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("All-Rights-Reserved", ("reserved",)),
)
# a sentence ends at a full stop and the like before white space, or at lines without a letter or digit
STOP = r"[.!?][ \t\f\r\n]+"
BLANK = r"\n[^A-Za-z0-9\x01]*\n"
# words without which no known sentence can occur; matched on whole texts, in any case
HINT = r"(?i)licen|permission|redistribut|reserved|warrant|copyright|endorse|unencumbered|creative|mozilla|gnu|under[^A-Za-z0-9]+(a[^A-Za-z0-9]+)?cc"
HINT_PLAIN = "licen|permission|redistribut|reserved|warrant|copyright|endorse|unencumbered|creative|mozilla|gnu|under (a )?cc"
# the SQL twin is kept as it was: its own hint, and sentences that end with their line
SQL_STOP = r"([.!?])[ \t\f\r]+"
SQL_HINT = "licen|permission|redistribut|reserved|public domain|warrant|copyright|endorse|unencumbered|creative|as is|mozilla|gnu"


def _rule_text(ids: tuple[str, ...]) -> str:
    return ";" + ";".join(ids) + ";"


def _sentence_id(sentence: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, pattern in reversed(SENTENCES):
        found = F.when(sentence.rlike(pattern), name).otherwise(found)
    return F.when(sentence.rlike(HINT_PLAIN), found)


def _position(text: Column, pattern: str) -> Column:
    return F.regexp_instr(text, F.lit(pattern))


def _line_matches(lines: Column) -> Column:
    """(at, id) of the lines of one sentence that hold a known one; ``at`` counts in the joined lines."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,id:string>>").alias("found"))

    def step(state: Column, line: Column) -> Column:
        name = _sentence_id(line)
        at = F.lit(None).cast("int")
        for known, pattern in reversed(SENTENCES):
            at = F.when(name == known, _position(line, pattern)).otherwise(at)
        one = F.array(F.struct((state["at"] + at - 1).alias("at"), name.alias("id")))
        return F.struct((state["at"] + F.length(line) + 1).alias("at"), F.when(name.isNotNull(), F.concat(state["found"], one)).otherwise(state["found"]).alias("found"))

    return F.aggregate(lines, start, step, lambda s: s["found"])


def _wrapped_matches(lines: Column) -> Column:
    """(at, id) of the known sentences in the joined lines; of two at one place the first listed counts."""
    whole = F.array_join(lines, " ")
    each = F.array(*[F.struct(_position(whole, pattern).alias("at"), F.lit(name).alias("id")) for name, pattern in SENTENCES])
    start = F.array().cast("array<struct<at:int,id:string>>")
    first = lambda state, x: F.when((x["at"] > 0) & ~F.exists(state, lambda y: y["at"] == x["at"]), F.concat(state, F.array(x))).otherwise(state)
    return F.when((F.size(lines) > 1) & whole.rlike(HINT_PLAIN), F.aggregate(each, start, first)).otherwise(start)


def _both(m: Column) -> Column:
    """Identifiers of one sentence in order of place; what a line holds is not also read over line ends."""
    new = F.filter(m["wrapped"], lambda x: ~F.exists(m["own"], lambda y: (y["id"] == x["id"]) | (y["at"] == x["at"])))
    return F.transform(F.array_sort(F.concat(m["own"], new)), lambda x: x["id"])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, sentence_ids, licenses, unmatched) of every row.

    ``sentence_ids`` are the known licence sentences in order of appearance, ``licenses`` the names of
    the rules that matched, each once, in rule order, and ``unmatched`` the identifiers that no rule
    used. Null and empty texts give empty arrays. Repeated rows stay rows, null ids stay null, other
    columns are not read. Of two known sentences in one line of a sentence, the first listed counts.
    Comment marks are no letters and so no part of a line.
    """
    text = F.col("text")
    normal = lambda s: F.trim(F.lower(F.regexp_replace(s, "[^A-Za-z0-9]+", " ")))
    cut = F.regexp_replace(F.regexp_replace(F.translate(text, "\x01", " "), STOP, "\x01"), BLANK, "\x01")
    sentences = F.transform(F.split(cut, "\x01", -1), lambda s: F.filter(F.transform(F.split(s, "\n", -1), normal), lambda x: x != ""))
    matches = F.transform(sentences, lambda s: F.struct(_line_matches(s).alias("own"), _wrapped_matches(s).alias("wrapped")))
    ids = F.flatten(F.transform(matches, _both))
    empty = F.array().cast("array<string>")
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    rows = rows.select(id_col, F.when(text.rlike(HINT), ids).otherwise(empty).alias("sentence_ids"))

    # doubled separators keep neighbours apart when one of them is used up
    sequence = F.concat(F.lit(";"), F.array_join("sentence_ids", ";"), F.lit(";"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_rule_text(ids)).alias("ids")) for name, ids in RULES])
    start = F.struct(sequence.alias("rest"), empty.alias("names"))

    def apply(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["ids"])
        return F.struct(
            F.when(hit, F.replace(state["rest"], rule["ids"], F.lit(";"))).otherwise(state["rest"]).alias("rest"),
            F.when(hit, F.array_union(state["names"], F.array(rule["name"]))).otherwise(state["names"]).alias("names"),
        )

    none = F.struct(F.lit(";").alias("rest"), empty.alias("names"))
    state = F.when(F.size("sentence_ids") > 0, F.aggregate(rules, start, apply)).otherwise(none)
    found = rows.withColumn("state", state)
    return found.select(id_col, "sentence_ids", F.col("state.names").alias("licenses"), F.filter(F.split("state.rest", ";"), lambda x: x != "").alias("unmatched"))


def scan_sql() -> str:
    """The same in SQL over documents, with joined lists."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(f"WHEN regexp_matches(s, {quote(p)}) THEN {quote(n)}" for n, p in SENTENCES)
    sql = (
        "WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), "
        + quote(SQL_STOP)
        + r", '\1' || chr(10), 'g'), chr(10)), lambda x: trim(lower(regexp_replace(x, '[^A-Za-z0-9]+', ' ', 'g')))), lambda s: "
        + f"regexp_matches(s, {quote(SQL_HINT)})) AS s FROM documents),\n"
        + f"r0 AS (SELECT doc_id, list_filter(list_transform(s, lambda s: CASE {cases} END), lambda x: x IS NOT NULL) AS ids FROM s),\n"
        + "q0 AS (SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, ';' || array_to_string(ids, ';') || ';' AS rest, CAST([] AS VARCHAR[]) AS names FROM r0)"
    )
    for i, (name, ids) in enumerate(RULES):
        rule = quote(_rule_text(ids))
        sql += f",\nq{i + 1} AS (SELECT doc_id, sentence_ids, replace(rest, {rule}, ';') AS rest, CASE WHEN contains(rest, {rule}) AND NOT list_contains(names, {quote(name)}) THEN list_append(names, {quote(name)}) ELSE names END AS names FROM q{i})"
    return sql + f"\nSELECT doc_id, sentence_ids, array_to_string(names, ',') AS licenses, trim(rest, ';') AS unmatched FROM q{len(RULES)}"
