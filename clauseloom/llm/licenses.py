"""License scans by ordered signature rules, by DataFrame functions alone.

Texts that name a license somewhere are written as words, two spaces apart, so that a rule
is a regular expression over whole words. A rule runs only where a word that it requires occurs. Of
overlapping detections the one of higher priority suppresses those inside its interval;
among equals the longer one, then the earlier rule, stays.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .matches import match_sizes, positions
from .storage import staged

#: A word: letters A-Z in either case, digits, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
LEVELS = (1, 2, 3, 4)
CONFIDENCE = {0: 0.9, 1: 0.6, 2: 0.8, 3: 0.95, 4: 1.0}

#: Families: label, keyword, its names (words; a word may be a regular expression, "?" after it makes it optional), versions, identifiers as words.
FAMILIES = [
    ("gpl", "gnu", ["gnu general public licen[sc]e", "gnu gpl"], ["1", "2", "3"], ["gpl {v} 0 (?:only|or)?", "gpl {v} 0"]),
    ("lgpl", "gnu", ["gnu (?:lesser|library) general public licen[sc]e", "gnu lgpl"], ["2", "2 1", "3"], ["lgpl {v} (?:only|or)?"]),
    ("agpl", "gnu", ["gnu affero general public licen[sc]e", "gnu agpl"], ["1", "3"], ["agpl {v} 0 (?:only|or)?"]),
    ("gfdl", "gnu", ["gnu free documentation licen[sc]e"], ["1 1", "1 2", "1 3"], ["gfdl {v} (?:only|or)?"]),
    ("apache", "apache", ["apache software? licen[sc]e", "asl"], ["1 0", "1 1", "2 0", "2"], ["apache {v}"]),
    ("mit", "mit", ["mit licen[sc]e", "expat licen[sc]e", "mit x11 licen[sc]e"], [], ["mit", "mit 0", "mit cmu", "mit advertising", "mit feh"]),
    ("bsd", "bsd", ["(?:new|modified|simplified|revised|original|free)? bsd licen[sc]e", "bsd (?:2|3|4) clause licen[sc]e?", "bsd style licen[sc]e", "berkeley software distribution licen[sc]e"], [], ["bsd 1 clause", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "0bsd"]),
    ("mpl", "mozilla", ["mozilla public licen[sc]e"], ["1 0", "1 1", "2 0"], ["mpl {v}"]),
    ("epl", "eclipse", ["eclipse public licen[sc]e"], ["1 0", "2 0"], ["epl {v}"]),
    ("edl", "eclipse", ["eclipse distribution licen[sc]e"], ["1 0"], []),
    ("eupl", "european", ["european union public licen[sc]e"], ["1 0", "1 1", "1 2"], ["eupl {v}"]),
    ("cddl", "distribution", ["common development and distribution licen[sc]e"], ["1 0", "1 1"], ["cddl {v}"]),
    ("cpl", "common", ["common public licen[sc]e"], ["1 0"], ["cpl {v}"]),
    ("cpal", "common", ["common public attribution licen[sc]e"], ["1 0"], ["cpal {v}"]),
    ("artistic", "artistic", ["perl? artistic licen[sc]e"], ["1 0", "2 0"], ["artistic {v}"]),
    ("isc", "isc", ["isc licen[sc]e", "internet systems consortium licen[sc]e"], [], ["isc"]),
    ("zlib", "zlib", ["zlib libpng? licen[sc]e"], [], ["zlib"]),
    ("libpng", "libpng", ["libpng licen[sc]e"], ["1", "2 0"], ["libpng {v}"]),
    ("boost", "boost", ["boost software licen[sc]e"], ["1 0"], ["bsl {v}"]),
    ("unlicense", "unlicense", ["the? unlicense"], [], ["unlicense"]),
    ("wtfpl", "wtfpl", ["wtfpl licen[sc]e?"], ["2", "2 0"], ["wtfpl"]),
    ("ofl", "font", ["sil? open font licen[sc]e"], ["1 0", "1 1"], ["ofl {v}"]),
    ("openssl", "openssl", ["openssl licen[sc]e"], [], ["openssl"]),
    ("postgresql", "postgresql", ["postgresql licen[sc]e"], [], ["postgresql"]),
    ("python", "python", ["python software foundation? licen[sc]e", "psf licen[sc]e"], ["2", "2 0"], ["python {v}", "psf {v}"]),
    ("php", "php", ["php licen[sc]e"], ["3 0", "3 01"], ["php {v}"]),
    ("ruby", "ruby", ["ruby licen[sc]e"], [], ["ruby"]),
    ("zpl", "zope", ["zope public licen[sc]e"], ["1 1", "2 0", "2 1"], ["zpl {v}"]),
    ("w3c", "w3c", ["w3c software (?:notice)? (?:and)? licen[sc]e"], [], ["w3c"]),
    ("cecill", "cecill", ["cecill free? software? licen[sc]e (?:agreement)?"], ["1 0", "2 0", "2 1"], ["cecill {v}", "cecill b", "cecill c"]),
    ("ms-pl", "microsoft", ["microsoft public licen[sc]e"], [], ["ms pl"]),
    ("ms-rl", "microsoft", ["microsoft reciprocal licen[sc]e"], [], ["ms rl"]),
    ("ncsa", "ncsa", ["university of illinois ncsa open source licen[sc]e", "ncsa open source licen[sc]e"], [], ["ncsa"]),
    ("afl", "academic", ["academic free licen[sc]e"], ["1 1", "2 0", "2 1", "3 0"], ["afl {v}"]),
    ("osl", "open", ["open software licen[sc]e"], ["1 0", "2 0", "2 1", "3 0"], ["osl {v}"]),
    ("odbl", "database", ["open data commons? open database licen[sc]e", "open database licen[sc]e"], ["1 0"], ["odbl {v}"]),
    ("odc-by", "attribution", ["open data commons attribution licen[sc]e"], ["1 0"], ["odc by {v}"]),
    ("pddl", "dedication", ["public domain dedication and licen[sc]e"], ["1 0"], ["pddl {v}"]),
    ("qpl", "q", ["q public licen[sc]e"], ["1 0"], ["qpl {v}"]),
    ("lppl", "latex", ["latex project public licen[sc]e"], ["1 0", "1 2", "1 3"], ["lppl {v}"]),
    ("vim", "vim", ["vim licen[sc]e"], [], ["vim"]),
    ("curl", "curl", ["curl licen[sc]e"], [], ["curl"]),
    ("x11", "x11", ["x11 licen[sc]e", "x consortium licen[sc]e"], [], ["x11"]),
    ("unicode", "unicode", ["unicode licen[sc]e agreement?"], [], ["unicode dfs 2015", "unicode dfs 2016", "unicode 3 0"]),
    ("ipl", "ibm", ["ibm public licen[sc]e"], ["1 0"], ["ipl {v}"]),
    ("npl", "netscape", ["netscape public licen[sc]e"], ["1 0", "1 1"], ["npl {v}"]),
    ("spl", "sun", ["sun public licen[sc]e"], ["1 0"], ["spl {v}"]),
    ("sspl", "server", ["server side public licen[sc]e"], ["1"], ["sspl {v} 0"]),
    ("bsl", "business", ["business source licen[sc]e"], ["1 0", "1 1"], ["busl {v}"]),
    ("elastic", "elastic", ["elastic licen[sc]e"], ["1", "2", "2 0"], ["elastic {v}"]),
    ("ecl", "educational", ["educational community licen[sc]e"], ["1 0", "2 0"], ["ecl {v}"]),
    ("upl", "permissive", ["universal permissive licen[sc]e"], ["1 0"], ["upl {v}"]),
    ("mulan", "mulan", ["mulan permissive software licen[sc]e"], ["1", "2"], ["mulanpsl {v} 0"]),
    ("blue-oak", "oak", ["blue oak model licen[sc]e"], ["1 0 0"], ["blueoak {v}"]),
    ("nasa", "nasa", ["nasa open source agreement"], ["1 3"], ["nasa {v}"]),
    ("apsl", "apple", ["apple public source licen[sc]e"], ["1 0", "1 1", "1 2", "2 0"], ["apsl {v}"]),
    ("openrail", "rail", ["open? rail (?:m|d|s)? licen[sc]e", "responsible ai licen[sc]e"], [], ["openrail"]),
    ("llama", "llama", ["llama (?:2|3)? community licen[sc]e agreement?"], [], []),
    ("cc0", "cc0", ["cc0 licen[sc]e?", "cc0 1 0 universal?"], [], ["cc0 1 0"]),
]
#: Creative Commons: label, the words of its short and long form.
COMMONS = [
    ("cc-by", "by", "attribution"), ("cc-by-sa", "by sa", "attribution (?:share alike|sharealike)"), ("cc-by-nd", "by nd", "attribution (?:no derivatives|noderivatives|noderivs)"),
    ("cc-by-nc", "by nc", "attribution (?:non commercial|noncommercial)"), ("cc-by-nc-sa", "by nc sa", "attribution (?:non commercial|noncommercial) (?:share alike|sharealike)"),
    ("cc-by-nc-nd", "by nc nd", "attribution (?:non commercial|noncommercial) (?:no derivatives|noderivatives|noderivs)"), ("cc0", "zero", "zero"),
]
#: Notices without a family: label, keyword, words.
NOTICES = [
    ("public-domain", "domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"), ("public-domain", "domain", "public domain dedication"), ("public-domain", "domain", "this (?:work|file|software|text) is in the public domain"),
    ("proprietary", "proprietary", "proprietary licen[sc]e"), ("proprietary", "license", "all rights reserved no licen[sc]e is granted"), ("proprietary", "license", "end user licen[sc]e agreement"),
    ("copyleft", "copyleft", "copyleft"), ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy"), ("isc", "permission", "permission to use copy modify and or? distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"), ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e"), ("agpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e"),
]


def _regex(words: str) -> str:
    """Words to an expression over " w1  w2 " text. Groups of alternatives may hold several words."""
    out, depth, token = [], 0, ""
    for c in words + " ":
        depth += (c == "(") - (c == ")")
        if c == " " and not depth:
            optional = token.endswith("?")
            body = token.removesuffix("?").replace(" ", "  ")
            out.append(f"(?: (?:{body}) )?" if optional else f" (?:{body}) ")
            token = ""
        else:
            token += c
    return "".join(out)


def worded_rules() -> list[tuple[str, int, str, str]]:
    """All rules in order: label, priority (0: base phrases), keyword of its family, words."""
    out = [(label, 0, words.split()[0], words) for words, label in BASE]
    for label, keyword, names, versions, identifiers in FAMILIES:
        for words in identifiers:
            out += [(label if "{v}" not in words else f"{label}-{v.replace(' ', '.')}", 4, "spdx", "spdx licen[sc]e identifier " + words.replace("{v}", v)) for v in (versions if "{v}" in words else [""])]
        for name in names:
            out.append((label, 3, keyword, f"(?:licensed|released|available|distributed|published|provided|covered) under (?:the|a)? (?:terms|conditions)? (?:of)? (?:the)? {name}"))
            out += [(f"{label}-{v.replace(' ', '.')}", 3, keyword, f"{name} (?:version|v)? {v}") for v in versions]
            out += [(f"{label}-{v.replace(' ', '.')}", 3, keyword, f"{name} v{v}") for v in versions]
            out.append((label, 1, keyword, name))
    for label, short, long in COMMONS:
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            out.append((f"{label}-{v.replace(' ', '.')}", 4, "spdx", f"spdx licen[sc]e identifier cc {short} {v}"))
            out.append((f"{label}-{v.replace(' ', '.')}", 3, "cc", f"cc {short} {v}"))
            out.append((f"{label}-{v.replace(' ', '.')}", 3, "commons", f"creative commons {long} {v}"))
            out.append((f"{label}-{v.replace(' ', '.')}", 3, "commons", f"creative commons {long} licen[sc]e {v}"))
        out.append((label, 2, "cc", f"cc {short}"))
        out.append((label, 2, "commons", f"creative commons {long} (?:international|unported)? licen[sc]e?"))
    return out + [(label, 2, keyword, words) for label, keyword, words in NOTICES]


def rules() -> list[tuple[int, str, int, str, str]]:
    """All rules in order: number, label, priority, keyword of its family, expression. The number decides last, the lower first."""
    return [(n, label, priority, keyword, _regex(words)) for n, (label, priority, keyword, words) in enumerate(worded_rules())]


def _required(words: str) -> list[str]:
    """The words of a rule that are in every text it matches; those with alternatives within as they are written."""
    flat = re.sub(r"\(\?:[^()]*\)\??", " ", words)
    return [w for w in flat.split() if not w.endswith("?")]


def needed_words() -> list[str]:
    """For each rule a word that every match holds: its family's keyword where that is one, else the longest."""
    out = []
    for _, _, keyword, words in worded_rules():
        plain = [w for w in _required(words) if w.isalnum() and w != "under"]  # "under" stands in too many texts
        out.append(keyword if keyword in plain else max(plain, key=len))
    return out


def gate() -> str:
    """Matches every text that some rule matches: it names a license, or holds the needed word of a rule that does not."""
    alone = {need for need, (*_, words) in zip(needed_words(), worded_rules()) if not any("licen[sc]e" in w or "license" in w for w in _required(words))}
    return f"(?i)licen[sc]e|(?<!{WORD[:-1]})(?:{'|'.join(sorted(alone))})(?!{WORD[:-1]})"


_WORDS = lambda s: ((F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))) / 2).cast("int")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, n_words, and detections, an array of (start, end, number, label, priority) in words, end exclusive, sorted.

    Suppressed detections are left out; base phrases (priority 0) neither suppress nor are suppressed.
    A null or empty text has no words. Repeated rows are scanned on their own, null ids kept; an
    empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.transform(F.regexp_extract_all(F.translate("text", upper, lower), F.lit(WORD), F.lit(0)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("key"), text.alias("text"))
    found = staged(
        rows.select("rid", "key", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), F.when(F.col("text").rlike(gate()), F.array_join(words, "")).alias("words")), "licenses"
    )
    needs = needed_words()
    named = [(n, label, priority, need, rule) for (n, label, priority, _, rule), need in zip(rules(), needs)]
    table = F.broadcast(spark.createDataFrame(named, "number int, label string, priority int, keyword string, rule string"))  # a few hundred rules
    keywords = sorted(set(needs))
    present = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.col("words"), F.concat(F.lit(" "), k, F.lit(" "))))
    pairs = found.where("words is not null").select("rid", "words", F.explode(present).alias("keyword")).join(table, "keyword")
    sizes = pairs.select("rid", "number", "label", "priority", F.posexplode(match_sizes(F.col("words"), F.col("rule"), _WORDS)).alias("nth", "m"))
    seen = positions(sizes.select("rid", "number", "label", "priority", "nth", "m.*"), ["rid", "number"])
    order = Window.partitionBy("rid").orderBy("start", F.desc("end"), F.desc("priority"), "number").rowsBetween(Window.unboundedPreceding, -1)
    outer = F.coalesce(*(F.when(F.col("priority") == p, F.max(F.when(F.col("priority") >= p, F.col("end"))).over(order)) for p in LEVELS))
    kept = seen.withColumn("outer", outer).where("priority = 0 or outer is null or outer < end")
    each = kept.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end", "number", "label", "priority"))).alias("detections"))
    none = F.array().cast(each.schema["detections"].dataType)
    return found.select("rid", "key", "n_words").join(each, "rid", "left").select(F.col("key").alias(id_col), "n_words", F.coalesce("detections", none).alias("detections"))


def license_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels, labels and score (that of the surest detection) of :func:`scan_licenses`."""
    base = F.filter("detections", lambda d: d["priority"] == 0)
    starts = F.transform(base, lambda d: d["start"])
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda d: d["label"]))), ",")
    sure = F.transform("detections", lambda d: F.element_at(F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv)), d["priority"]))
    return found.select(
        id_col, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        names(base).alias("base_labels"), names(F.col("detections")).alias("labels"), F.coalesce(F.array_max(sure), F.lit(0.0)).alias("score"),
    )


def license_oracle() -> str:
    """DuckDB SQL for the digests of table documents."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({n}, {quote(label)}, {priority}, {quote(need)}, {quote(rule)})" for (n, label, priority, _, rule), need in zip(rules(), needed_words()))
    count = lambda x: f"((length({x}) - length(replace({x}, ' ', ''))) // 2)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    outer = " ".join(f"when prio = {p} then max(case when prio >= {p} then e end) over o" for p in LEVELS)
    sure = " ".join(f"when {p} then {c}" for p, c in CONFIDENCE.items())
    return f"""
with r(n, label, prio, keyword, rule) as (values {values}),
d as (select doc_id k, coalesce(text, '') t from documents),
w as (select k, len(regexp_extract_all(t, {quote(WORD)})) n_words, array_to_string(list_transform(regexp_extract_all(translate(t, '{upper}', '{lower}'), {quote(WORD)}), lambda x: ' ' || x || ' '), '') s from d),
h as (select k, n, label, prio, regexp_extract_all(s, rule) hits, regexp_split_to_array(s, rule) gaps from w, r where contains(s, ' ' || keyword || ' ')),
m as (select k, n, label, prio, unnest(list_transform(gaps[1:len(hits)], lambda x: {count("x")})) g, unnest(list_transform(hits, lambda x: {count("x")})) l, generate_subscripts(hits, 1) i from h where len(hits) > 0),
p as (select k, n, label, prio, (sum(g + l) over c)::bigint e, (sum(g + l) over c)::bigint - l s from m window c as (partition by k, n order by i)),
q as (select *, case {outer} end above from p window o as (partition by k order by s, e desc, prio desc, n rows between unbounded preceding and 1 preceding)),
v as (select * from q where prio = 0 or above is null or above < e)
select w.k doc_id, any_value(n_words)::bigint n_words, count(*) filter (prio = 0) n_base, (min(s) filter (prio = 0))::bigint first_word, (max(s) filter (prio = 0))::bigint last_word,
coalesce(array_to_string(list_sort(list_distinct(list(label) filter (prio = 0))), ','), '') base_labels, coalesce(array_to_string(list_sort(list_distinct(list(label) filter (label is not null))), ','), '') labels,
coalesce(max(case prio {sure} end), 0)::double score
from (select k, n_words from w) w left join v on v.k = w.k group by w.k"""
