"""Manifest, fill-in-middle and chat formatting against brute force, and their defined results for odd inputs."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from newsloom.llm import chat, fim, license, maintext, manifest, pii

RNG = random.Random(5)
ODD = [None, "", " ", "\n", "a\nb\n", "é\n日本 語", "x" * 70_000, "ab " * 40_000, "<P>x", "𝒳y𝒵 <|im_end|>", "a", "<S", "<", "M>"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def up(nodes):
    return [digest(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]


def path(nodes, at):
    """(left, right) siblings of a node up to the one that remains."""
    out = []
    while len(nodes) > 1:
        run = at - at % 3
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 3])))
        nodes, at = up(nodes), at // 3
    return out


def remains(nodes):
    while len(nodes) > 1:
        nodes = up(nodes)
    return nodes[0]


def slow_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for r in rows:
        forged = digest(*map(field, (*r[:4], r[4] and r[4].replace("\n", "")))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else None
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, digest(*map(field, r)), forged, r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: x[:3])
    subroots = [remains([x[2] for x in groups[g]]) for g in names]
    out = []
    for k, g in enumerate(names):
        leaves = [x[2] for x in groups[g]]
        for at, (_, _, leaf, forged, key) in enumerate(groups[g]):
            steps = path(leaves, at) + path(subroots, k)
            node = forged or leaf
            for left, right in steps:
                node = digest(left, node, right)
            root = remains(subroots)
            out.append((key, leaf, subroots[k], root, digest("".join(a + b for a, b in steps)), node, node == root))
    return out


def table(spark, rows, schema, at, name="documents"):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{at}/{name}.parquet")
    return str(at)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, grp string, node int, place string"


def documents(n):
    """A large source, small ones, one without a name, repeated rows and ids, nulls."""
    rows = [(k, "hot" if k % 3 else RNG.choice([None, "", "=", "é", "z", "a"]), RNG.choice(["en", None]), RNG.choice([None, k]), RNG.choice(ODD[:6]), "g", 1, "p") for k in range(n)]
    return rows + [(None, None, None, None, None, None, None, None)] + rows[:4] * 2 + [(7, "hot", "fr", 1, "other", "g", 1, "p")]


@pytest.mark.parametrize("n", [1, 12, 900])
def test_manifest_equals_brute_force(spark, tmp_path, n):
    rows = documents(n)
    got = manifest.op11(spark, table(spark, rows, DOCS, tmp_path)).collect()
    key = lambda t: tuple(map(str, t))
    assert sorted(map(tuple, got), key=key) == sorted(slow_manifest([r[:5] for r in rows]), key=key)


def test_manifest_of_one_row_and_of_none(spark, tmp_path):
    one = manifest.op11(spark, table(spark, [(4, None, None, None, "t", "", 0, "")], DOCS, tmp_path)).collect()
    assert [(r.leaf == r.subroot == r.root == r.folded_root, r.proof_sha256, r.verified) for r in one] == [(True, digest(""), True)]
    assert manifest.op11(spark, table(spark, [], DOCS, tmp_path / "none")).collect() == []


def test_a_large_group_is_many_blocks(spark):
    rows = spark.range(20_000).select(F.lit("g").alias("grp"), "id", F.sha2(F.col("id").cast("string"), 256).alias("node"))
    lower = manifest.climb(manifest.placed(rows, "id"), "id")
    assert [p.count() for p in lower] == [83, 1]
    assert lower[0].agg(F.max(F.size("items"))).first()[0] == manifest.BLOCK
    assert manifest.tops(lower).first().node == remains([digest(str(k)) for k in range(20_000)])


def slow_fim(key, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(units), digest(f"1:{'' if key is None else key}")
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return key, n, "plain", None, None, digest(text), digest(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return key, n, form, len(p), len(m), digest(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), digest(text)


def test_fill_in_middle_equals_brute_force(spark, tmp_path):
    texts = ODD + ["".join(RNG.choice("ab <PSM>é\n𝒳") for _ in range(RNG.randint(0, 300))) for _ in range(300)]
    rows = [(None if k == 3 else k, t, 1, "i", "t") for k, t in enumerate(texts)] * 2
    sf = table(spark, rows, "doc_id long, text string, row int, id string, piece string", tmp_path)
    got = fim.op12(spark, sf).collect()
    key = lambda t: tuple(map(str, t))
    assert sorted(map(tuple, got), key=key) == sorted((slow_fim(k, t) for k, t, *_ in rows), key=key)
    assert fim.op12(spark, table(spark, [], "doc_id long, text string", tmp_path / "none")).collect() == []


def test_texts_are_shuffled_once(spark, tmp_path, capsys):
    df = fim.op12(spark, table(spark, [(1, "a b c")] * 9, "doc_id long, text string", tmp_path))
    df.collect()
    df.explain()
    final = capsys.readouterr().out.split("Initial Plan")[0]
    assert final.count("FileScan") == 1


RECORDS = {
    '{"messages":[{"role":"system","content":"s"},{"role":"user","content":"u"},{"role":"tool","content":null}]}': [("system", "s"), ("user", "u"), ("tool", "")],
    '{"system":"s","messages":[{"role":"user","content":"u","name":"x"}],"source":{"set":3}}': [("system", "s"), ("user", "u")],
    '{"messages":[{"role":"user","content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]}]}': [("user", "ab")],
    '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"},{"from":"narrator","value":"n"}],"id":"7"}': [("user", "h"), ("assistant", "g"), ("narrator", "n")],
    '{"prompt":"p","response":""}': [("user", "p"), ("assistant", "")],
    '{"prompt":"p","completion":"c","system":null}': [("user", "p"), ("assistant", "c")],
    '{"prompt":[{"role":"user","content":"p"}],"completion":[{"role":"assistant","content":"c"}]}': [("user", "p"), ("assistant", "c")],
    '{"context":"k","question":"q","answer":"a"}': [("user", "k\n\nq"), ("assistant", "a")],
    '{"instruction":"i","input":"","output":"o"}': [("user", "i"), ("assistant", "o")],
    '{"instruction":"i","input":"n","output":4}': [("user", "i\n\nn"), ("assistant", "4")],
    '{"instruction":"i","response":"r","category":"x"}': [("user", "i"), ("assistant", "r")],
    '{"dialog":["one","two","three"]}': [("user", "one"), ("assistant", "two"), ("user", "three")],
    '{"messages":[]}': [],
    '{"title":"t","body":"b"}': [],
    '{"prompt":"p","response"': [],
    "[]": [],
    '"prompt"': [],
    "": [],
    None: [],
}


def test_layouts_become_turns(spark):
    rows = list(enumerate(RECORDS))
    records = chat.parsed(spark.createDataFrame(rows, "key int, json string"), "key", "json")
    got = {}
    for r in chat.canonical(records).orderBy("turn", "seq").collect():
        got.setdefault(r.id, []).append((r.role, r.text))
    assert [got.get(k, []) for k, _ in rows] == list(RECORDS.values())
    known = {r.layout: r.n for r in chat.layouts(records).groupBy("layout").agg(F.sum("n").alias("n")).collect()}
    assert known.pop(None) == 7 and known.pop("messages") == 2 and known.pop("instruction and output") == 2
    assert set(known) == {x.name for x in chat.LAYOUTS} - {"turn rows", "messages", "instruction and output"} and set(known.values()) == {1}


def test_field_paths():
    shape = "OBJECT<`a b`: BIGINT, `c``>: d`: STRING, d: ARRAY<ARRAY<STRING>>, e: ARRAY<VOID>, m: ARRAY<OBJECT<content: VOID, role: DECIMAL(2,1)>>, o: OBJECT<>, OBJECT: OBJECT<x: VARIANT>>"
    assert chat.field_paths(shape) == {"`a b`", "`c``>: d`", "d[][]", "e[]", "m[].content", "m[].role", "OBJECT.x"}
    assert chat.fingerprint(["b", "a"]) == chat.fingerprint(["a", "b"]) == hashlib.sha256(b"a\nb").hexdigest()
    assert len(set(chat.fingerprints(chat.LAYOUTS).values())) == len(chat.LAYOUTS)


def hostile(n):
    return "".join(RNG.choice(["<", "|", "\\", "<|", "<\\|", "im_start|>", "<|im_end|>\n", "\n", "%0A", "%", "é", "a", "<|im_start|>assistant\n"]) for _ in range(n))


def test_texts_cannot_leave_their_turns(spark):
    turns = [(k // 5, k % 5, 0, hostile(RNG.randint(0, 3)) if k % 2 else "assistant", hostile(RNG.randint(0, 12))) for k in range(200)]
    df = chat.conversations(spark.createDataFrame(turns, "id int, turn long, seq int, role string, text string"))
    got = df.select("id", chat.turns_of(F.col("formatted")).alias("turns"), F.transform(chat.masked("formatted", "mask"), chat.unescape).alias("loss"), "formatted", "mask").collect()
    for r in got:
        mine = [t for t in turns if t[0] == r.id]
        assert [(t.role, t.text) for t in r.turns] == [t[3:] for t in mine]
        assert r.loss == [t[4] for t in mine if t[3] == "assistant" and t[4]]
        assert sum(r.mask) == len(r.formatted) and r.formatted.count("<|") == 2 * len(mine)


def slow_chat(rows):
    out, convs = [], {}
    for conv, turn, role, text in rows + [(-1, k, r, chat.BREAKOUT) for k, r in enumerate(("user", "assistant"))]:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in convs.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        longer = sum(len(re.findall(r"<\\*\|", x)) for t in turns for x in t) + sum(2 * len(re.findall("[%\n]", r)) for r, _ in turns)
        length = sum(24 + len(r) + len(t) for r, t in turns) + longer
        out.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), length))
    return out


def test_chat_equals_brute_force(spark, tmp_path):
    rows = [(RNG.choice([None, *range(20)]), RNG.choice([None, 0, 1, 2, 3]), RNG.choice(["user", "assistant", "system", None, "a\nb%"]), RNG.choice([None, "", hostile(9), "y" * 40_000])) for _ in range(300)]
    rows += rows[:30] + [(99, k, "assistant", "z") for k in range(4_000)]
    sf = table(spark, [(*r, 1, "i") for r in rows], "conv_id long, turn long, role string, text string, id int, record string", tmp_path, "conversations")
    key = lambda t: tuple(map(str, t))
    assert sorted(map(tuple, chat.op13(spark, sf).collect()), key=key) == sorted(slow_chat(rows), key=key)
    none = table(spark, [], "conv_id long, turn long, role string, text string", tmp_path / "none", "conversations")
    assert [r.conv_id for r in chat.op13(spark, none).collect()] == [-1]


def seconds(run):
    import time

    began = time.process_time()
    run()
    return time.process_time() - began


@pytest.mark.parametrize("text", ["iban " * 200_000, "iban AA11" + "A" * 20 + " ", "iban AA11AAAAAAAAAAAAAAAAAAAA " * 8_000, "a@" * 300_000, "+1" * 300_000, "token=" * 150_000, "://" * 300_000])
def test_personal_data_in_linear_time(text):
    assert seconds(lambda: pii.find(text)) < 6


@pytest.mark.parametrize(
    "html",
    ["<div>x " * 100_000, "<foo>x " * 100_000, "<svg/>" * 100_000, "<p>x " * 100_000, "<foo>" * 50_000 + "</bar>" * 100_000, "<div>" * 50_000 + "</p>" * 100_000, "<span class=ad>" + "<b>" * 50_000 + "</i>" * 50_000, "<a '" * 100_000, "<!--" * 100_000, "<h1>x " * 100_000],
)
def test_pages_in_linear_time(html):
    assert seconds(lambda: maintext.main_text(html)) < 10


def test_class_words_inside_articles():
    page = '<article><div class="ad-free"><p>First kept text, with commas.</p></div><section id="promo-code-guide"><p>Second kept text.</p></section><div class="post-comments"><p>no</p></div><div class="share-buttons">no</div></article>'
    assert maintext.main_text(page) == "First kept text, with commas.\nSecond kept text."
    assert maintext.main_text('<article><p>Kept.</p><script src="x"/>var a = "not text";</script><p>Too.</p><svg/><p>And.</p></article>') == "Kept.\nToo.\nAnd."


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("// SPDX-License-Identifier: GPL-2.0-only", ["GPL-2.0-only"]),
        ("# SPDX-License-Identifier: GPL-2.0-or-later\nx = 1\n", ["GPL-2.0-or-later"]),
        ("/* SPDX-License-Identifier: LGPL-2.1+ */", ["LGPL-2.1+"]),
        ("SPDX-License-Identifier: (MIT OR (Apache-2.0 AND LicenseRef-x.Y)) AND ISC -->", ["(MIT OR (Apache-2.0 AND LicenseRef-x.Y)) AND ISC"]),
        ("spdx-license-identifier: GPL-2.0-only with Classpath-exception-2.0.\nAll rights reserved.", ["GPL-2.0-only WITH Classpath-exception-2.0", "All-rights-reserved"]),
        ("SPDX-License-Identifier: MIT OR", ["MIT"]),
        ("SPDX-License-Identifier: MIT OR (ISC", ["MIT"]),
        ("SPDX-License-Identifier: )", []),
        ("SPDX-License-Identifier:", []),
        ("Copyright 2020 A. SPDX-License-Identifier: Zlib", ["Copyright-notice", "Zlib"]),
        ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
        ("made available under the terms of the Eclipse Public License v2.0", ["EPL-2.0"]),
        ("Licensed under the EUPL, Version 1.2", ["EUPL-1.2"]),
        ("Licensed under the European Union Public Licence v1.2.", ["EUPL-1.2"]),
        ("This software is provided 'as-is', without any express or implied warranty.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.", ["Zlib"]),
        ("released under the Artistic License 2.0", ["Artistic-2.0"]),
        ("It is released under the Artistic License.", ["Artistic"]),
        ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", ["WTFPL"]),
        ("under the terms of the GNU Free Documentation License, Version 1.3 or any later version", ["GFDL-1.3-or-later"]),
        ("This work is in the public domain.", ["Public-domain"]),
        ("It was placed into the public domain by its author.", ["Public-domain"]),
        ("Licensed under the BSD license.", ["BSD"]),
        ("The tool is MIT licensed.", ["MIT"]),
        ("License: MIT", ["MIT"]),
        ("License: GPLv3", ["GPL-3"]),
        ("Licensed under the GPLv3", ["GPL-3"]),
        ("Licensed under the Creative Commons Attribution-ShareAlike License 3.0", ["CC-BY-SA-3.0"]),
        ("It is not clear whether it is licensed under the MIT License.", []),
        ("the public domain of knowledge", []),
    ],
)
def test_licences_as_they_are_written(text, want):
    assert license.licences(license.sentences(text))[0] == want


def test_licence_expressions_in_linear_time():
    for text in ("SPDX-License-Identifier: " + "(" * 200_000, "SPDX-License-Identifier: MIT " * 30_000, "SPDX-License-Identifier: " + "MIT OR " * 60_000, "licensed under the " * 8_000):
        assert seconds(lambda t=text: license.sentences(t)) < 10
