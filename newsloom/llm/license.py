"""Licence scan by sentence rules.

A text is split into sentences; each is normalised to words (lower case, no markup, quotes, brackets or commas, one spelling of
license) and looked up among the known licence sentences, which are indexed by their first words. A known sentence may stand
anywhere in a sentence of the text, the leftmost first and of those the longest, unless it is marked as standing alone or
at the start. What is negated ("not licensed under ...") names nothing. The identifiers of a text, in order,
are matched against the ordered rules (SPDX tags count as sentences, their expressions are kept as written): at each place the first rule whose identifiers stand there names its licence and
uses them up; identifiers that no rule uses are reported as unmatched.

Defined results: null and empty texts have no sentences; a licence named twice is listed once; repeated rows
give a row each; texts may be of any length; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import read, schema_of, texts_of

# How known sentences are written: words; a|b for either; a trailing ? for a word that may be missing; ^ and $ for the ends of
# the sentence; <v> a version, <n> a number, <w> a word, <*> 1 to LOOSE words, <year> years, <bsd> a number of clauses,
# <cc> attribution terms.
LOOSE = 20
UNDER = "licensed|released|distributed|available|published|provided under the|a? terms? of? the?"
GNU = {"gpl": "general public license", "lgpl": "lesser|library general public license", "agpl": "affero general public license"}
# Known licence sentences by identifier, in normalised words.
SENTENCES = {
    "apache-version": [f"{UNDER} apache software? license? version? <v>"],
    "apache-title": ["^ apache license version <v> <w> <n>", "^ apache license version <v> $"],
    "apache-terms": ["terms and conditions for use reproduction and distribution"],
    "apache-grant": ["you may not use this file|work|software except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at"],
    "apache-asis": ["distributed under the license is distributed on an as is basis"],
    "apache-limits": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit-named": [f"{UNDER} mit|expat license", "licensed under the? mit", "mit licensed", "^ license mit license? $"],
    "mit-title": ["^ the? mit license mit? $"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions"],
    "asis-warranty": ["software is provided as is without warranty of any kind"],
    "asis-liability": ["in no event shall the author|authors or copyright holder|holders be liable"],
    "bsd-named": [f"{UNDER} <bsd> bsd license", f"{UNDER} bsd <bsd> license"],
    "bsd-plain": [f"{UNDER} bsd license", "bsd licensed", "^ license bsd license? $"],
    "bsd-title": ["^ the? <bsd> bsd license $", "^ the? bsd <bsd> license $"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice"],
    "bsd-names": ["neither the name|names of <*> nor the names of its|the|specific contributors may be used to endorse"],
    "bsd-asis": ["software is provided by the copyright holder|holders and contributors as is", "software is provided by <*> as is"],
    "bsd-liability": ["in no event shall the? copyright holder|holders|owner or contributors be liable"],
    "gpl-hope": ["distributed in the hope that it will be useful but without any warranty"],
    "gpl-later": ["or at your option any later version", "or any later version"],
    "gpl-received": ["you should have received a copy of the gnu <*> license along with"],
    "cc": [f"{UNDER} cc <cc> <v>", f"{UNDER} creative commons <cc> license? <v>", f"{UNDER} creative? commons? cc0 <v>", "^ license cc <cc> <v> $"],
    "mpl-version": ["subject to the terms of the mozilla public license version|v? <v>"],
    "mpl-copy": ["if a copy of the mpl was not distributed with this file"],
    "mpl-named": [f"{UNDER} mozilla public license version|v? <v>", f"{UNDER} mpl version|v? <v>"],
    "mpl-title": ["^ mozilla public license version <v> $"],
    "isc-named": [f"{UNDER} isc license"],
    "isc-title": ["^ the? isc license $"],
    "isc-grant": ["permission to use copy modify and/or|and distribute this software for any purpose with or without fee is hereby granted"],
    "isc-asis": ["software is provided as is and the author disclaims all warranties"],
    "unlicense-named": [f"{UNDER} unlicense"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "unlicense-grant": ["anyone is free to copy modify publish use compile sell or distribute this software"],
    "boost-named": [f"{UNDER} boost software license", "^ boost software license version? <v> <w>? <w>? <n>? $"],
    "boost-grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software"],
    "epl-named": [f"{UNDER} eclipse public license version|v? <v>", f"{UNDER} epl version|v? <v>", "^ eclipse public license version|v? <v> $"],
    "eupl-named": [f"{UNDER} european union public license version|v? <v>", f"{UNDER} eupl version|v? <v>", "^ european union public license version|v? <v> $"],
    "zlib-named": [f"{UNDER} zlib license", f"{UNDER} zlib/libpng license", "^ the? zlib license $"],
    "zlib-asis": ["software is provided as-is without any express or implied warranty"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"],
    "artistic-version": [f"{UNDER} artistic license version|v? <v>", "^ the? artistic license version|v? <v> $"],
    "artistic-named": [f"{UNDER} artistic license"],
    "wtfpl": ["do what the fuck you want to public license", f"{UNDER} wtfpl", "^ license wtfpl $"],
    "gfdl-version": ["gnu free documentation license version|v? <v>", f"{UNDER} gfdl version|v? <v>"],
    "public-domain": ["is|are in the public domain", "dedicated|placed|put|released in|into|to the public domain", "^ public domain $"],
    "reserved": ["all rights reserved"],
    "copyright": ["^ copyright (c)? <year>", "^ (c) copyright? <year>"],
}
for _k, _name in GNU.items():
    SENTENCES |= {
        f"{_k}-version": [f"gnu {_name} as published by the free software foundation either? version <v>"],
        f"{_k}-named": [f"{UNDER} gnu? {_name} version|v? <v>", f"{UNDER} gnu? {_k} version|v? <v>", f"^ license? gnu? {_k} version|v? <v> $"],
        f"{_k}-named-later": [f"{UNDER} gnu? {_name} version|v? <v> or later|newer", f"{UNDER} gnu? {_k} version|v? <v> or later|newer"],
        f"{_k}-title": [f"^ gnu {_name} version <v> <n>? <w> <n> $", f"^ gnu {_name} version <v> $"],
    }
# Rules in order of trial; a trailing ? for an identifier that may be missing; a name takes what was captured.
_HEAD = "copyright? reserved?"
RULES = [
    ("Apache-{}", f"{_HEAD} apache-version apache-grant? apache-copy? apache-asis? apache-limits?"),
    ("Apache-{}", "apache-title apache-terms?"),
    ("MIT", f"mit-title? mit-named? {_HEAD} mit-grant mit-notice? asis-warranty? asis-liability?"),
    ("MIT", "mit-named"),
    ("MIT", f"mit-title {_HEAD}"),
    ("BSD-3-Clause", f"bsd-title? {_HEAD} bsd-grant bsd-source bsd-binary bsd-names bsd-asis? bsd-liability?"),
    ("BSD-2-Clause", f"bsd-title? {_HEAD} bsd-grant bsd-source bsd-binary bsd-asis? bsd-liability?"),
    ("BSD-{}-Clause", "bsd-named"),
    ("BSD-{}-Clause", "bsd-title"),
    *((f"{k.upper()}-{{}}-or-later", f"{_HEAD} {k}-version gpl-later gpl-hope? gpl-received?") for k in GNU),
    *((f"{k.upper()}-{{}}", f"{_HEAD} {k}-version gpl-hope? gpl-received?") for k in GNU),
    *((f"{k.upper()}-{{}}-or-later", f"{k}-named-later") for k in GNU),
    *((f"{k.upper()}-{{}}-or-later", f"{k}-named gpl-later gpl-hope? gpl-received?") for k in GNU),
    *((f"{k.upper()}-{{}}", f"{k}-named") for k in GNU),
    *((f"{k.upper()}-{{}}", f"{k}-title") for k in GNU),
    ("CC-{}", "cc"),
    ("MPL-{}", f"{_HEAD} mpl-version mpl-copy?"),
    ("MPL-{}", "mpl-named"),
    ("MPL-{}", "mpl-title"),
    ("ISC", f"isc-title? isc-named? {_HEAD} isc-grant isc-asis?"),
    ("ISC", "isc-named"),
    ("ISC", f"isc-title {_HEAD}"),
    ("Unlicense", "unlicense unlicense-grant?"),
    ("Unlicense", "unlicense-named"),
    ("BSD", "bsd-plain"),
    ("BSL-1.0", "boost-named boost-grant?"),
    ("BSL-1.0", "boost-grant"),
    ("EPL-{}", "epl-named"),
    ("EUPL-{}", "eupl-named"),
    ("Zlib", f"zlib-named? {_HEAD} zlib-asis? zlib-grant"),
    ("Zlib", "zlib-named"),
    ("Artistic-{}", "artistic-version"),
    ("Artistic", "artistic-named"),
    ("WTFPL", "wtfpl"),
    ("GFDL-{}-or-later", "gfdl-version gpl-later"),
    ("GFDL-{}", "gfdl-version"),
    ("Public-domain", "public-domain"),
    ("{}", "spdx"),
    ("All-rights-reserved", "copyright? reserved"),
    ("Copyright-notice", "copyright"),
]
# Words before a known sentence that negate it, how far before, and the word that ends their reach.
NEGATIONS, NEAR, TURN = frozenset("not no never nor neither isn't wasn't aren't weren't cannot without whether unclear n't".split()), 3, "but"
CC = {"by": "BY", "nc": "NC", "nd": "ND", "sa": "SA", "attribution": "BY", "noncommercial": "NC", "noderivatives": "ND", "noderivs": "ND", "sharealike": "SA"}
CLAUSES = {"2-clause": "2", "two-clause": "2", "3-clause": "3", "three-clause": "3", "simplified": "2", "new": "3", "modified": "3", "revised": "3"}

#: Every known sentence holds one of these; sentences without are not looked up.
CUES = (
    "licens", "licenc", "copyright", "©", "(c)", "warrant", "permission", "redistribut", "reserved", "unencumbered", "later", "liable", "endorse", "mpl", "gpl", "apache",
    "commons", "cc0", "provided", "reproduction", "anyone", "public domain",
)
SHORT_CUE = re.compile(r"cc[\s-]+(?:by|attribution|nc|nd|sa)|\b(?:epl|eupl|wtfpl|gfdl)\b")
LEAD = r"[ \t]*(?:[*#/;-]+[ \t]*)?"
END = re.compile(rf"(?<![\s,][vV]\.)(?<=[.!?])\s+|\n{LEAD}(?=\n)|\n(?={LEAD}(?i:copyright|©|\(c\)|spdx-license|all rights reserved))|(?<=;)\s+(?=(?i:copyright|©|\(c\)))")
WORD = re.compile(r"\(c\)|[^\W_]+(?:[.+'/-]+[^\W_]+)*\+?")
VERSION, YEAR = re.compile(r"v?([0-9]+(?:\.[0-9]+)*)$"), re.compile(r"[0-9]{4}(?:-[0-9]{2,4})?$")
#: A tag, and the parts of the expression that follows it in its line: brackets, and names and operators in their own case.
TAG = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*", re.I)
PART = re.compile(r"[ \t]*(\(|\)|(?:DocumentRef-[A-Za-z0-9.-]+:)?[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\+?)")
OPERATORS = frozenset("AND OR WITH".split())
SHORT = re.compile(r"\b([al]?gpl)[- ]?v?(?=[0-9])")


def normalise(sentence: str) -> list[str]:
    low = sentence.lower().replace("©", "(c)").replace("’", "'").replace("licence", "license")
    return WORD.findall(SHORT.sub(r"\1 ", low))


def _cc(words, k):
    parts = []
    while k < len(words) and len(parts) < 8 and all(p in CC for p in re.split("[-/]", words[k])):
        parts += [CC[p] for p in re.split("[-/]", words[k])]
        k += 1
        yield k, "-".join(parts)


def _one(test):
    def run(words, k):
        value = test(words[k]) if k < len(words) else None
        if value is not None:
            yield k + 1, value

    return run


#: What a slot takes at a place: (end, captured) in order of trial; an empty capture is none.
SLOTS = {
    "<v>": _one(lambda w: m[1] if (m := VERSION.match(w)) else None),
    "<n>": _one(lambda w: "" if w.isdecimal() else None),
    "<w>": _one(lambda w: ""),
    "<year>": _one(lambda w: "" if YEAR.match(w) else None),
    "<bsd>": _one(CLAUSES.get),
    "<cc>": _cc,
    "<*>": lambda words, k: ((e, "") for e in range(k + 1, min(k + LOOSE, len(words)) + 1)),
    "^": lambda words, k: ((k, ""),) if k == 0 else (),
    "$": lambda words, k: ((k, ""),) if k == len(words) else (),
}


def _compile(sentence: str) -> tuple:
    out = []
    for part in sentence.split():
        maybe = part.endswith("?")
        part = part[: len(part) - maybe]
        out.append((SLOTS.get(part) or _one(lambda w, of=frozenset(part.split("|")): "" if w in of else None), maybe))
    return tuple(out)


def match_at(pattern: tuple, words: list[str], k: int, p: int = 0):
    """(end, captured) of the first way that a known sentence stands at a place, or None."""
    while p < len(pattern):
        slot, maybe = pattern[p]
        p += 1
        for end, value in slot(words, k):
            if (rest := match_at(pattern, words, end, p)) is not None:
                return rest[0], ((value,) if value else ()) + rest[1]
        if not maybe:
            return None
    return k, ()


def _first_words(sentence: str) -> list[str]:
    out = []
    for part in sentence.split():
        if part != "^":
            out += part.rstrip("?").split("|")
            if not part.endswith("?"):
                break
    return out


KNOWN = [(name, _compile(s)) for name, some in SENTENCES.items() for s in some]
INDEX: dict[str, list] = {}
for (_name, _pattern), _s in zip(KNOWN, (s for some in SENTENCES.values() for s in some)):
    for _w in dict.fromkeys(CLAUSES if _first_words(_s) == ["<bsd>"] else [*_first_words(_s), *(CLAUSES if "<bsd>" in _first_words(_s) else ())]):
        INDEX.setdefault(_w, []).append((_name, _pattern))


def negated(words: list[str], k: int) -> bool:
    for w in reversed(words[max(0, k - NEAR) : k]):
        if w == TURN:
            return False
        if w in NEGATIONS or w.endswith("n't"):
            return True
    return False


def known(words: list[str]):
    """(identifier, captured) of the known sentences in the words of one sentence."""
    k = 0
    while k < len(words):
        best = None
        for name, pattern in INDEX.get(words[k], ()):
            got = match_at(pattern, words, k)
            if got is not None and (best is None or got[0] > best[0]):
                best = got[0], name, got[1]
        if best is None or best[0] == k:
            k += 1
            continue
        if not negated(words, k):
            yield best[1], best[2]
        k = best[0]


def has_cue(text: str) -> bool:
    low = text.lower()
    return any(c in low for c in CUES) or SHORT_CUE.search(low) is not None


def expression(text: str, at: int) -> tuple[str, int]:
    """The licence expression that stands at a place, and its end: the longest in which every bracket is closed and every operator has
    its operand; "" if none does."""
    parts, depth, whole, end, want = [], 0, 0, at, True
    while m := PART.match(text, at):
        part, at = m[1], m.end()
        operator = part.upper() in OPERATORS
        if want and part == "(":
            depth += 1
        elif want and part != ")" and not operator:
            want = False
        elif not want and part == ")" and depth:
            depth -= 1
        elif not want and operator:
            part, want = part.upper(), True
        else:
            break
        parts.append(part)
        if not want and not depth:
            whole, end = len(parts), at
    return " ".join(parts[:whole]).replace("( ", "(").replace(" )", ")"), end


def in_sentence(sentence: str):
    """What known() finds in a sentence, and licence expressions behind their tags, which are read as they are written."""
    at = 0
    for m in TAG.finditer(sentence):
        if m.start() < at:
            continue
        name, end = expression(sentence, m.end())
        if name:
            yield from known(normalise(sentence[at : m.start()]))
            yield "spdx", (name,)
            at = end
    yield from known(normalise(sentence[at:]))


def sentences(text: str) -> list[tuple[str, tuple]]:
    """(identifier, captured) of the known licence sentences of a text, in order."""
    if not has_cue(text):
        return []
    return [x for s in END.split(text.replace("\r\n", "\n")) if has_cue(s) for x in in_sentence(s)]


ORDERED = [(name, [(p.rstrip("?"), p.endswith("?")) for p in ids.split()]) for name, ids in RULES]


def uses(ids: list, found: list, at: int) -> int:
    """How many identifiers a rule uses up at a place; 0 if it does not stand there."""
    k = at
    for name, maybe in ids:
        if k < len(found) and found[k][0] == name:
            k += 1
        elif not maybe:
            return 0
    return k - at


def named(name: str, part: list[tuple[str, tuple]]) -> str:
    value = "-".join(v for _, captured in part for v in captured)
    if name == "CC-{}" and not value.startswith("BY"):
        return f"CC0-{value}"
    return name.format(value)


def licences(found: list[tuple[str, tuple]]) -> tuple[list[str], list[str]]:
    """(licences in order without repeats, identifiers that no rule used)."""
    names, left, at = [], [], 0
    while at < len(found):
        for rule, ids in ORDERED:
            if n := uses(ids, found, at):
                name = named(rule, found[at : at + n])
                if name not in names:
                    names.append(name)
                at += n
                break
        else:
            left.append(found[at][0])
            at += 1
    return names, left


def scan(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, sentences, licenses, unmatched): arrays of identifiers, licence names and unused identifiers."""
    names = pa.list_(pa.string())

    def run(batches):
        for b in batches:
            found = [sentences(t) for t in texts_of(b.column(1))]
            named = [licences(f) for f in found]
            cols = [[k for k, _ in f] for f in found], [n for n, _ in named], [x for _, x in named]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, names) for c in cols)], ["id", "sentences", "licenses", "unmatched"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, schema_of(src.schema["id"].dataType, "sentences array<string>, licenses array<string>, unmatched array<string>"))


def op1(spark, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("sentences").cast("long").alias("n_sentences"),
        F.concat_ws(",", "sentences").alias("sentence_ids"),
        F.concat_ws(",", "licenses").alias("licenses"),
    )
