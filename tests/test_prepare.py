"""Causes of errors and verdicts of rounds against plain loops over the same rows."""

import random
import re

from tallyloom.operators import prepare

KEYS = ["repo", "round"]


def causes(errors, committed):
    """One repository and round, error by error."""
    out = dict.fromkeys(prepare.CAUSES, 0)
    poisoned = {f for f, c, _ in errors if c == "uri_does_not_exist"}
    for f, c, m in errors:
        f, c, m = f or "", c or "", m or ""
        path = re.search(r"'package:[a-zA-Z0-9_]+/([^']+)'", m)
        if "package:flutter_gen/" in m:
            out["obsolete_toolchain_api"] += 1
        elif re.search(prepare.GENERATED, m) or re.search(prepare.GENERATED, f):
            out["missing_codegen"] += 1
        elif c != "uri_does_not_exist" and f in poisoned:
            pass
        elif c == "uri_does_not_exist" and path and committed is not None and "lib/" + path[1] not in committed:
            out["missing_untracked_file"] += 1
        elif c in ("uri_does_not_exist", "depend_on_referenced_packages"):
            out["unresolved_dependency"] += 1
        else:
            out["missing_codegen" if c in prepare.GENERATED_CODES else "broken_source"] += 1
    return out


def test_causes_against_a_loop(spark):
    rng = random.Random(1)
    codes = ["uri_does_not_exist", "undefined_class", "depend_on_referenced_packages", "uri_has_not_been_generated", "syntax", None]
    messages = ["no 'package:a/x1.dart'", "no 'package:a/x2.dart'", "no 'src/x.dart'", "see x.g.dart", "no 'package:flutter_gen/l.dart'", None, "a/l10n/b", "missing 'package:a/generated/l10n.dart'"]
    rows = [(rng.randint(0, 9), rng.randint(1, 3), f"lib/{rng.randint(0, 3)}{rng.choice(['.dart', '.freezed.dart'])}", rng.choice(codes), rng.choice(messages)) for _ in range(900)]
    rows += [(3, 1, "lib/hot.dart", "syntax", "boom")] * 800
    known = {(r, f"lib/x{k}.dart") for r in range(10) for k in (1, 2) if (r + k) % 3}
    df = spark.createDataFrame(rows, "repo int, round int, file string, code string, message string")
    paths = spark.createDataFrame(sorted(known) * 2, "repo int, path string")
    for committed in (paths, None):
        got = {(r.repo, r.round): r.asDict() for r in prepare.attribute_errors(df, committed, KEYS).collect()}
        for key in {r[:2] for r in rows}:
            own = [r[2:] for r in rows if r[:2] == key]
            want = causes(own, {p for r, p in known if r == key[0]} if committed is not None else None)
            assert {c: got[key][c] for c in prepare.CAUSES} == want and got[key]["errors"] == len(own)
    assert prepare.attribute_errors(df.filter("false"), paths, KEYS).count() == 0


def verdict(rounds, most):
    was = None
    for k, (_, ok, errors, c, u, t) in enumerate(sorted(rounds)[:most]):
        if errors == 0:
            return "clean", k + 1
        if not ok:
            return "unsatisfiable_dependencies", k + 1
        if c + u == 0:
            return ("missing_untracked_file" if t else "broken_source"), k + 1
        if was == errors:
            return "no_progress", k + 1
        was = errors
    return "exhausted_rounds", min(len(rounds), most)


def test_verdicts_against_a_loop(spark):
    rng = random.Random(2)
    by_repo = {repo: [(k, rng.random() > 0.1, rng.choice([0, 3, 4, 5, 6]), rng.choice([0, 1]), rng.choice([0, 2]), rng.choice([0, 1])) for k in range(1, rng.randint(2, 8))] for repo in range(400)}
    rows = [(repo, *r) for repo, rounds in by_repo.items() for r in rounds]
    df = spark.createDataFrame(rows, "repo int, round int, ok boolean, errors int, missing_codegen int, unresolved_dependency int, missing_untracked_file int")
    got = {r.repo: (r.status, r.round) for r in prepare.round_verdicts(df, "repo", 5).collect()}
    assert got == {repo: verdict(rounds, 5) for repo, rounds in by_repo.items()}
    assert {s for s, _ in got.values()} == {"clean", "unsatisfiable_dependencies", "missing_untracked_file", "broken_source", "no_progress", "exhausted_rounds"}
