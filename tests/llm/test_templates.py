"""Templates and dropped lines against a plain implementation."""

import random
import re
from collections import Counter, defaultdict

from quire.llm import templates as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    """doc key -> (line numbers dropped), from the definition."""
    docs = {(1 << 63 if d is None else d, t): (t or "") for d, t in rows}
    lines = []
    for key, t in docs.items():
        for no, line in enumerate(t.split("\n")):
            w = tuple("<*>" if re.search("[0-9]", x) else x for x in WORD.findall(line))
            if len(w) >= 3:
                lines.append((key, no, w))
    leaves = defaultdict(set)
    for _, _, w in lines:
        leaves[len(w), w[:3]].add(w)
    name = {w: w for ws in leaves.values() for w in ws}
    groups = [((leaf,), ws) for leaf, ws in leaves.items() if leaf[0] > 3]
    for _ in range(T.ROUNDS):
        further = defaultdict(set)
        for path, ws in groups:
            if len(ws) < 2:
                continue
            n = len(next(iter(ws)))
            votes = [Counter(w[i] for w in ws) for i in range(n)]
            constant = {i: next((t for t, c in votes[i].items() if 2 * c > len(ws)), None) for i in range(3, n)}
            settled = 10 * sum(c is not None for c in constant.values()) >= 7 * (n - 3)
            other = [(c, -i) for i in range(3, n) for c in votes[i].values() if 2 * c <= len(ws)]
            for w in ws:
                if 10 * sum(w[i] == constant[i] for i in range(3, n)) >= 7 * (n - 3):
                    name[w] = path
                elif settled:
                    further[*path, "rest"].add(w)
                elif other:
                    cut = -max(other)[1]
                    further[*path, (cut, w[cut])].add(w)
        groups = list(further.items())
    holders = defaultdict(set)
    for key, _, w in lines:
        holders[name[w]].add(key)
    order = {k: i for i, k in enumerate(sorted(docs, key=str))}
    out = defaultdict(set)
    for key, no, w in lines:
        h = holders[name[w]]
        if len(h) >= (5 if len(w) < 10 else 2):
            out[key].add((no, frozenset(h)))
    return docs, out


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(60):
        lines = [" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines)), passage)
        if i % 4 == 0:
            lines.append(f"User number {i} of group {word()} has signed in from host {word()} on day {i % 7} with success again")
        if i % 5 == 0:
            lines += ["All rights reserved.", ""]
        rows.append((i, "\n".join(lines)))
    for k in range(90):  # three templates in one leaf, and a fourth that half of a leaf has
        name, rest = word(), ["sent to the main office by", "taken from a small store at", "held for some other guest of"][k % 3]
        rows.append((200 + k, f"The parcel was {rest} {name} at noon of day {k}"))
        rows.append((300 + k, f"One more thing {['is left to do today for', 'is left to do today for', 'was never done at all by', 'has gone wrong again with'][k % 4]} {name} so it goes"))
    return [*rows, (100, rows[0][1]), (5, rows[5][1]), (101, None), (102, ""), (103, "\n\n"), (None, passage), (104, ("long line " * 9 + "\n") * 500)]


def test_report_matches_definition(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, line string")
    found = [(r.doc_id, r.text, list(r.dropped), r.n_lines) for r in T.line_report(docs).collect()]
    assert len(found) == len(rows)
    keys, want = plain(rows)
    by_doc = defaultdict(list)
    for key in keys:
        by_doc[key[0]].append(key)
    for d, text, dropped, n in found:
        (key,) = by_doc[1 << 63 if d is None else d]
        first = {no for no, holders in want[key] if min(holders, key=lambda k: k[0]) == key}
        assert set(dropped) == {no for no, _ in want[key]} - first, (d, dropped)
        source = keys[key]
        assert n == (len(source.split("\n")) if key[1] is not None else 0)
        assert (text or "") == "\n".join(x for i, x in enumerate(source.split("\n")) if i not in dropped)
    assert sum(len(x[2]) for x in found) > 40


def test_documents_keep_their_columns(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, len(t or ""), "x", "y") for d, t in rows], "doc_id long, text string, n_chars long, numbers string, ord string")
    out = T.drop_lines(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    ids = [r.doc_id for r in kept]
    assert 0 in ids and 100 not in ids and None not in ids and {101, 102, 103} <= set(ids)
    assert all(r.n_chars == len(r.text or "") for r in kept)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert T.line_report(empty).collect() == [] and T.drop_lines(empty).collect() == []


def test_text_of_its_own_is_never_lost(spark):
    """A short page with its own line beside a long shared passage stays, and a chain of near copies loses no line."""
    rng = random.Random(4)
    line = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 8))) for _ in range(n))
    a, b, c, d, own = line(90), line(90), line(14), line(14), line(40)
    rows = [(0, f"{a}\n{b}"), (1, f"{a}\n{b}\n{c}"), (2, f"{a}\n{b}\n{c}\n{d}"), (3, f"{line(80)}\n{d}"), (4, f"{a}\n{own}"), (5, f"{b}\n{a}"), (6, f"{a}\n\n \nÜber")]
    kept = {r.doc_id: r.text for r in T.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0: rows[0][1], 1: c, 2: d, 3: rows[3][1].split("\n")[0], 4: own, 6: "\n \nÜber"}


def test_templates_of_one_leaf_do_not_hide_each_other(spark):
    """Three templates of a leaf, each with lines of its own, give the same drops together as each alone, and with twice as many others."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    kinds = ["sent to the main office by {} at noon of this day", "taken from a small store at {} in spite of rain", "held for some other guest of {} until late at night"]
    lines = {k: [f"The parcel was {kinds[k].format(word())}" for _ in range(30)] for k in range(3)}

    def dropped(chosen):
        docs = spark.createDataFrame([(1000 * k + i, line) for k in chosen for i, line in enumerate(lines[k])], "doc_id long, text string")
        return {r.doc_id for r in T.line_report(docs).collect() if r.dropped}

    alone = [dropped([k]) for k in range(3)]
    assert [len(x) for x in alone] == [29, 29, 29]
    assert dropped([0, 1, 2]) == alone[0] | alone[1] | alone[2]
    lines[1] += [f"The parcel was {kinds[1].format(word())}" for _ in range(30)]
    assert dropped([0, 1]) & set(range(1000)) == alone[0]
