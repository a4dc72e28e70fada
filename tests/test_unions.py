"""Fixture unions, import covers and audits against loops in the order that the rules state."""

import random
import re
from collections import defaultdict

from tallyloom.operators import unions

DECLARED = "grp int, role string, at int, name string, header string, text string, section string, needs_value boolean"


def sig(d):
    flat = lambda s: re.sub(r"\s+", " ", s).strip()
    return ("class", flat(d[4])) if d[4] is not None else ("other", flat(d[5]))


def union(rows):
    """{(group, role): (accepted, clash, kind)} and {(group, name): first role}."""
    out, reg = {}, {}
    by = defaultdict(list)
    for r in rows:
        by[r[0], r[1]].append(r)
    for g, role in sorted(by):
        merged, clash = dict(reg.get(g, {})), None
        for d in sorted(by[g, role], key=lambda d: d[2]):
            was = merged.get(d[3])
            if was is None:
                merged[d[3]] = (sig(d), d[6] == "lifted", d)
            elif was[0] != sig(d):
                clash = d[3], "lifted_value" if was[1] or d[6] == "lifted" else "stand_in"
                break
        if clash:
            out[g, role] = (False, *clash)
        else:
            out[g, role] = (True, None, None)
            reg[g] = merged
    return out, {(g, n): d for g, own in reg.items() for n, (_, _, d) in own.items()}


def test_union_against_a_loop(spark):
    rng = random.Random(7)
    rows, members = [], []
    for g in range(5):
        for r in range(40):
            for at in range(rng.randint(1, 4)):
                name = f"n{rng.randint(0, 12)}"
                cls = int(name[1:]) % 3 == 0
                head = f"class {name} extends  {'A' if rng.random() < 0.9 else 'B'}" if cls else None
                text = "x" if cls else f"var {name} =\n{1 if rng.random() < 0.85 else 2};"
                rows.append((g, f"r{r:02d}", at, name, head, text, "seed", rng.random() < 0.2))
                if cls:
                    members += [(g, f"r{r:02d}", name, f"m{k}", "f(" + "a" * rng.randint(0, 3) + f"{r % 2})") for k in range(rng.randint(0, 3))]
    rows += [(9, "a", 0, "q", None, "1", "lifted", False), (9, "b", 0, "q", None, "2", "seed", False), (9, "c", 0, "z", None, "1", "seed", False), (9, "c", 1, "z", None, "2", "seed", False), (9, "d", 0, "z", None, "2", "seed", True)]
    df = spark.createDataFrame(rows, DECLARED).repartition(3)
    want, first = union(rows)
    acc = unions.accepted_roles(df, "grp", "role")
    got = {(r.grp, r.role): (r.accepted, r.clash, r.kind) for r in acc.collect()}
    assert got == want and sum(not w[0] for w in want.values()) > 20
    assert got[9, "b"] == (False, "q", "lifted_value") and got[9, "c"][0] is False and got[9, "d"][0] is True
    reg = {(r.grp, r.name): r for r in unions.registry(df, acc, spark.createDataFrame(members, "grp int, role string, name string, member string, text string"), "grp", "role").collect()}
    assert reg.keys() == first.keys()
    for (g, n), r in reg.items():
        assert (r.header, r.text) == (first[g, n][4], first[g, n][5])
        assert r.needs_value == any(d[7] for d in rows if (d[0], d[3]) == (g, n) and want[g, d[1]][0])
        own = {}
        for m in sorted((m for m in members if (m[0], m[2]) == (g, n) and want[g, m[1]][0]), key=lambda m: m[1]):
            if m[3] not in own or len(m[4]) > len(own[m[3]]):
                own[m[3]] = m[4]
        assert {m.member: m.text for m in r.members or []} == own


def cover(imports, used, exports):
    out, covered, plain = {}, set(), []
    for uri, at, how, names in imports:
        gives = exports.get(uri)
        if gives is None:
            out[uri, at] = "unknown"
        elif how == "plain":
            plain.append((uri, at))
        else:
            out[uri, at] = "fixed"
            covered |= {"show": gives & set(names or []), "hide": gives - set(names or []), "as": set()}[how]
    for uri, at in sorted(plain, key=lambda i: (-len(exports[i[0]]), i[1])):
        out[uri, at] = "keep" if any(n in used and n not in covered for n in exports[uri]) else "drop"
        if out[uri, at] == "keep":
            covered |= exports[uri]
    return out


def test_imports_against_a_loop(spark):
    rng = random.Random(8)
    exports = {f"u{k}": {f"N{rng.randint(0, 30)}" for _ in range(rng.randint(1, 12))} for k in range(9)}
    imports, used, want = [], [], {}
    for f in range(60):
        own = [(rng.choice([*exports, "package:x", "dart:y"]), at, rng.choice(["plain"] * 5 + ["as", "show", "hide"]), rng.choice([None, [f"N{rng.randint(0, 30)}" for _ in range(4)]])) for at in range(rng.randint(0, 7))]
        names = {f"N{rng.randint(0, 30)}" for _ in range(rng.randint(0, 12))}
        imports += [(f, *i) for i in own]
        used += [(f, n) for n in names for _ in range(2)]
        want |= {(f, *k): v for k, v in cover(own, names, exports).items()}
    got = unions.kept_imports(spark.createDataFrame(imports, "file int, uri string, at int, how string, names array<string>"), spark.createDataFrame(used, "file int, name string"), spark.createDataFrame([(u, n) for u, own in exports.items() for n in own], "uri string, name string"))
    assert {(r.file, r.uri, r.at): r.action for r in got.collect()} == want and {"keep", "drop", "fixed", "unknown"} == set(want.values())


def test_audit(spark):
    pairs = [(1, "deeper", "slower", 1), (2, "deeper", "slower", 0), (3, "deeper", None, 1), (4, "new", "Stable", 0), (5, "const", "faster", None), (6, "const", "odd", 1)]
    deltas = [(1, "depth", 2), (1, "size", 1), (2, "depth", -1), (2, "loops", 3), (3, "size", 0), (4, "depth", 1), (5, "const", -1), (6, "const", -2), (6, "depth", 1)]
    out = unions.audited(
        spark.createDataFrame(pairs, "pair int, directive string, expect string, label int"),
        spark.createDataFrame(deltas, "pair int, feature string, delta int"),
        spark.createDataFrame([("deeper", "depth", 1), ("const", "const", -1)], "directive string, feature string, sign int"),
        spark.createDataFrame([("deeper", "size"), ("const", "depth")], "directive string, feature string"),
    )
    assert {r.pair: r.notes for r in out.collect()} == {1: [], 2: ["label disagreement", "tangled loops", "weak depth"], 3: ["weak depth"], 4: ["tangled depth", "unknown directive"], 5: [], 6: []}
