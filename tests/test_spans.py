"""Spans, edits, brackets and logs against plain searches."""

import random
import re

import pytest

from tallyloom.operators import spans


def test_innermost_against_a_search(spark):
    rng = random.Random(1)
    rows = []
    for doc in range(12):
        def nest(a, z, depth, doc=doc):
            rows.append((doc, a, z, rng.choice(["build", "life", "inert"])))
            while depth and z - a > 2 and rng.random() < 0.8:
                m = rng.randint(a, z - 1)
                nest(m, rng.randint(m, z), depth - 1)
                a = m
        nest(0, rng.choice([1, 7, 64, 1000, 70_000]), 5)
    rows += [(3, 40, 60, "made"), (3, 50, 55, "build"), (5, 9, 9, "made"), (None, 0, 9, "life"), (20, 5, 6, "life")]
    points = [(i, rng.randint(0, 21), rng.choice([rng.randint(0, 100), rng.randint(0, 80_000)])) for i in range(1500)] + [(1500, None, 4), (1501, 3, None), (1502, 20, 5), (1503, 20, 6)]
    df, s = spark.createDataFrame(points, "id int, doc int, at int"), spark.createDataFrame(rows, "doc int, start int, end int, kind string")
    for above in (None, "made"):
        want = {}
        for i, doc, at in points:
            inside = [r for r in rows if r[0] == doc and doc is not None and at is not None and r[1] <= at < r[2]]
            want[i] = min(inside, key=lambda r: (-r[1], r[2], r[3]))[3] if inside else None
            if above and doc == 3 and at is not None and at >= 40:
                want[i] = above
        got = spans.innermost(df, s, "doc", "at", "kind", above)
        assert {r.id: r.region for r in got.collect()} == want and got.count() == len(points)


def test_edits_against_slices(spark):
    rng = random.Random(2)
    texts, edits = [(98, "keep"), (99, None), (97, "")], [(500, 0, 1, "x", "a"), (97, 0, 0, "new", "b")]
    want = {98: ("keep", 0, 0), 99: (None, 0, 0), 97: ("new", 0, 1)}
    for k in range(30):
        t = "".join(rng.choice("abé日\U0001f600 ") for _ in range(rng.randint(1, 400)))
        cuts = sorted(rng.sample(range(len(t) + 1), min(len(t) + 1, 2 * rng.randint(0, 6))))
        own = [(a, z, rng.choice(["", "X", "éé"]), rng.choice("ab")) for a, z in zip(cuts[::2], cuts[1::2])]
        out, byte = t, lambda i, t=t: len(t[:i].encode())
        for a, z, r, _ in reversed(own):
            out = out[:a] + r + out[z:]
        texts.append((k, t))
        edits += [(k, byte(a), byte(z), r, kind) for a, z, r, kind in own]
        want[k] = (out, sum(o[3] == "a" for o in own), sum(o[3] == "b" for o in own))
    frame = lambda e: spark.createDataFrame(e, "k int, start long, end long, replacement string, kind string")
    df = spark.createDataFrame(texts, "k int, text string")
    got = spans.apply_edits(df, frame(edits).repartition(3), "k", "text", ["a", "b"]).collect()
    assert {r.k: (r.rewritten, r.n_a, r.n_b) for r in got} == want
    for bad in ([(98, 0, 2, "", "a"), (98, 1, 3, "", "a")], [(98, 3, 5, "", "a")], [(98, 2, 1, "", "a")]):
        with pytest.raises(Exception, match="edits of 98"):
            spans.apply_edits(df, frame(bad), "k", "text", ["a"]).collect()


def test_found_edits_have_byte_offsets(spark):
    texts = [(1, "é12 日本 3x45"), (2, "none"), (3, ""), (4, None), (5, "7")]
    got = spans.find_edits(spark.createDataFrame(texts, "k int, t string"), "k", "t", "[0-9]+").collect()
    want = [(k, len(t[: m.start()].encode()), len(t[: m.end()].encode()), m[0]) for k, t in texts if t for m in re.finditer("[0-9]+", t)]
    assert sorted(map(tuple, got)) == want


def braces(text, mark):
    m = re.search(mark, text or "")
    i = text.find("{", m.end() - 1 if m[0].endswith("{") else m.end()) if m else -1
    if i < 0:
        return None
    depth = 0
    for j in range(i, len(text)):
        depth += (text[j] == "{") - (text[j] == "}")
        if not depth:
            return text[i : j + 1]
    return None


def test_blocks(spark):
    rng = random.Random(3)
    texts = ["", None, "build(x) {", "build(x) { a; }", "} } build(y) } {b{}}c", "no mark {}", "build() { '}' } }", "xbuild() {}{} build(z) {q}"]
    texts += ["build(a)" + "".join(rng.choice("{{}}ab ") for _ in range(rng.randint(0, 40))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for mark in (r"\bbuild\s*\([^)]*\)", r"\bbuild\s*\([^)]*\)\s*\{"):
        got = {r.k: r.block for r in spans.brace_block(df, "k", "t", mark).collect()}
        assert got == {k: braces(t, mark) for k, t in enumerate(texts)}
    some = spark.createDataFrame([(1, "f() { a('}'); /* } */ // }\n b(\"{\"); } rest }")], "k int, t string")
    assert spans.brace_block(some, "k", "t", r"f\(\)", strings=True).first().block == "{ a('}'); /* } */ // }\n b(\"{\"); }"


def test_initialisers(spark):
    cases = {
        "final x = 1;": "1",
        "final x =\n  [1,\n   2] ; more": "[1, 2]",
        "x = 'a;b' + \"];\" ;": "'a;b' + \"];\"",
        "x = f(a, // no ; here\n  b);": "f(a, b)",
        "x = /* ; */ {k: (1, 2)};": "{k: (1, 2)}",
        "x = a /* c */ b;": "a b",
        "x = 'it\\'s;';": "'it\\'s;'",
        "x = r'\\';": "r'\\'",
        "x = '''a';\n''';": "'''a';\n'''",
        "x = '${f(\"a;\")}  ;';": "'${f(\"a;\")}  ;'",
        "x = 'two  spaces'  +  y;": "'two  spaces' + y",
        "x = a / b;": "a / b",
        "x = ;": None,
        "x = 1": None,
        "x = );": None,
        "x = 'open;": None,
        "x = [1;": None,
        "y = 1;": None,
        "": None,
    }
    df = spark.createDataFrame([*enumerate(cases), (99, None)], "k int, t string")
    got = {r.k: r.init for r in spans.initialiser(df, "k", "t", r"\bx").collect()}
    assert got == {**dict(enumerate(cases.values())), 99: None}


FRAME = r"#0\s+.*\(package:made/view\.dart:\d+"


def test_log_lines(spark):
    hit, frame, own = "I/flutter ( 12): lost %d", "I/flutter ( 12): #0  build (package:made/view.dart:9)", "I/flutter (1): #1 up (package:x)"
    logs = {
        "near": {1: hit % 1, 3: own, 4: "D/gl: x", 5: frame},
        "edge": {1: hit % 2, 40: frame, 41: hit % 3},
        "far": {1: hit % 4, 41: frame},
        "second": {50: frame, 60: hit % 5, 61: frame},
        "named": {1: "x [err] #0 no", 7: "[err]  it broke ", 8: frame},
        "empty": {3: "I/flutter ( 2): ", 4: frame},
        "none": {1: hit % 6},
    }
    lines = [(k, n, t) for k, own in logs.items() for n, t in own.items()]
    got = {r.k: r.message for r in spans.thrown(spark.createDataFrame(lines, "k string, n int, t string"), "k", "n", "t", FRAME, r"\[err\]\s+(.*)$").collect()}
    general = "an exception was thrown from the build"
    assert got == {"near": "lost 1", "edge": "lost 2", "far": general, "second": general, "named": "it broke", "empty": general, "none": None}


def test_texts_are_not_shuffled_for_offsets(spark):
    d = spark.createDataFrame([(1, "Ab cd. E"), (2, None), (3, "")], "k long, t string")
    found = spans.find_edits(d, "k", "t", "[A-Z]+").select("k", "start", "end")
    assert sorted(map(tuple, found.collect())) == [(1, 0, 1), (1, 7, 8)]
    below = found._jdf.queryExecution().optimizedPlan().toString().split("Window", 1)[1].split("Generate", 1)[0]
    assert "found" not in below.split("Project", 1)[1].split(" AS ", 1)[0] and "AS found" not in below


def test_blocks_are_cut_in_one_pass(spark):
    d = spark.createDataFrame([(1, "Ab cd {x{y}} E"), (2, None), (3, "")], "k long, t string")
    block = spans.brace_block(d, "k", "t", "cd")
    assert {r.k: r.block for r in block.collect()} == {1: "{x{y}}", 2: None, 3: None}
    # one pass over the tokens: the closing brace is found in the same windows
    assert block._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
