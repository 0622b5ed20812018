"""Measurements, bits, policies and ablations against plain Python."""

import random
import re
from collections import Counter

from quire.llm import rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    ls = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, g in enumerate(windows) if seen[g] > 1 for k in range(5)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_lines": len(ls),
        "n_dup_lines": len(ls) - len(set(ls)), "n_repeat_words": len(covered), "n_upper": sum("A" <= c <= "Z" for c in t),
        "n_lower": sum("a" <= c <= "z" for c in t), "n_bangs": t.count("!"),
    }


def plain_bits(m):
    fails = [m["n_words"] < 10, 100 * m["n_repeat_words"] > 20 * m["n_words"], 100 * m["n_symbols"] > 10 * m["n_words"], 100 * m["n_dup_lines"] > 30 * m["n_lines"],
             m["n_upper"] > m["n_lower"], 100 * m["n_bangs"] > 30 * m["n_words"], m["word_chars"] < 2 * m["n_words"], m["word_chars"] > 20 * m["n_words"]]
    return sum(1 << i for i, f in enumerate(fails) if f)


def rows():
    rng = random.Random(3)
    out = [None, "", "   \n\t", "a " * 30_000, "one two three four five", "x" * 50_000, "漢字🙂 é " * 20, "A! B! C!\n" * 6, "\n".join(["same line here"] * 3 + ["other"]), "a b c d e a b c d e a b c d e f"]
    for _ in range(60):
        words = [rng.choice(["ab", "cd", "e", "F!", "##g", "h|"]) for _ in range(rng.randrange(80))]
        out.append("".join(w + rng.choice([" ", "\n", "  ", "\r\n"]) for w in words))
    return list(enumerate(out))


def test_ledger_policies_and_ablations(spark):
    data = rows() + [(None, "a null id"), (3, rows()[3][1])]
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t in data], "doc_id long, text string, n_words int, w string")
    entries = R.ledger(docs)
    found = sorted((tuple(r.asDict().items()) for r in entries.collect()), key=str)
    want = sorted((tuple({"doc_id": i, **plain(t), "fail_bits": plain_bits(plain(t))}.items()) for i, t in data), key=str)
    assert [sorted(x) for x in found] == [sorted(x) for x in want] or sorted(map(sorted, map(list, found)), key=str) == sorted(map(sorted, map(list, want)), key=str)
    bits, policies = [plain_bits(plain(t)) for _, t in data], R.Policies()
    got = {(r.version, r.rule): r for r in R.ablations(entries).collect()}
    assert len(got) == sum(map(len, policies.versions.values()))
    for (v, name), r in got.items():
        m, b = R.mask(*policies.versions[v]), R.mask(name)
        assert (r.n_rows, r.n_kept, r.n_failed, r.n_only) == (len(bits), sum(not x & m for x in bits), sum(bool(x & b) for x in bits), sum(x & m == b for x in bits))
    assert entries.where(policies.keeps(1)).count() == sum(not x & 3 for x in bits)


def test_empty_table_and_native_plan(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert R.ledger(empty).collect() == []
    plan = R.ledger(empty)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan and "InArrow" not in plan
