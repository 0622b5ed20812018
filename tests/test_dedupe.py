"""Greedy leaders by a plain loop, and the input's schema left as it was."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import markup as M
from quire.functions import text
from quire.operators import dedupe


def test_greedy_leaders_match_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, rng.normal(size=4).tolist(), bool(i % 5 == 0)) for g in (1, 2) for i in range(20)]
    df = spark.createDataFrame(rows, "g long, i long, v array<double>, safe boolean")
    expected = set()
    for g in (1, 2):
        leaders = []
        for _, i, v, safe in (r for r in rows if r[0] == g):
            if safe or not any(np.corrcoef(v, x)[0, 1] >= 0.6 for x in leaders):
                expected.add((g, i))
                if not safe:
                    leaders.append(v)
    found = dedupe.greedy_leaders(df, "g", "i", "v", 0.6, "safe")
    assert {(r.g, r.i) for r in found.where("kept").collect()} == expected and found.count() == 40
    assert df.columns == ["g", "i", "v", "safe"]


def test_greedy_leaders_with_all_rows_in_one_group(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 5)).tolist()
    rows = [(1, i, base[int(rng.integers(12))], i % 9 == 0) for i in range(400)] + [(1, 400, None, False), (1, 401, [], False), (1, 402, [2.0, 2.0], False), (1, 403, [2.0, 2.0], False), (1, 5, base[0], False), (1, 5, base[0], False)]
    df = spark.createDataFrame(rows, "g int, i long, v array<double>, safe boolean").repartition(4)
    leaders, kept = [], 0
    for _, _, v, safe in sorted(rows, key=lambda r: r[1]):
        flat = not v or min(v) == max(v)
        near = not safe and not flat and any(np.corrcoef(v, x)[0, 1] >= 0.95 for x in leaders)
        kept += not near
        if not near and not safe and not flat:
            leaders.append(v)
    found = dedupe.greedy_leaders(df, "g", "i", "v", 0.95, "safe")
    assert found.count() == len(rows) and found.where("kept").count() == kept


def _prints(rng, n, families):
    base = [(int(rng.integers(700, 760)), rng.integers(-(2**63), 2**63, 4), rng.integers(-(2**63), 2**63, 4)) for _ in range(families)]
    rows = []
    for i in range(n):
        a, d, h = base[int(rng.integers(families))]
        d, h = d.copy(), h.copy()
        for words, most in ((d, 20), (h, 24)):
            for bit in rng.choice(256, int(rng.integers(0, most)), replace=False):
                words[bit // 64] ^= np.int64(np.uint64(1) << np.uint64(bit % 64))
        rows.append((i, a + int(rng.integers(-6, 7)), d.tolist(), h.tolist()))
    return rows


def test_nearest_fingerprint_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = _prints(rng, 300, 40)
    rows += [(1000 + k, *rows[0][1:]) for k in range(50)] + [(2000, None, [1, 2, 3, 4], [1, 2, 3, 4]), (2001, 700, None, [1, 2, 3, 4]), (2002, 700, [1, 2], [1, 2, 3, 4])]
    schema = "id long, aspect int, difference array<long>, average array<long>"
    found = {r.id: (r.difference_bits, r.average_bits, r.match_id) for r in dedupe.nearest_fingerprint(spark.createDataFrame(rows, schema), spark.createDataFrame(rows, schema), "id").collect()}
    apart = lambda x, y: sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(x, y, strict=True))
    want = {}
    whole = [r for r in rows if r[0] < 2000]
    for p in whole:
        near = [(apart(p[2], q[2]), apart(p[3], q[3]), q[0]) for q in whole if q[0] != p[0] and abs(p[1] - q[1]) <= 8]
        near = [x for x in near if x[0] <= 16 and x[1] <= 20]
        if near:
            want[p[0]] = min(near)
    assert found == want and len(want) > 100


@pytest.mark.parametrize("part,slice_", [(50_000, 500_000), (60, 70)])
def test_fingerprints_of_few_bits_are_found_without_pairs(spark, part, slice_, monkeypatch):
    """Few bits of forty are set, so bands agree by chance; ids come under several fingerprints, and not all are of both tables."""
    rng = np.random.default_rng(7)
    bits = lambda: [int(sum(1 << int(b) for b in rng.choice(40, int(rng.integers(0, 4)), replace=False))) - (1 << 63) * int(rng.random() < 0.1) for _ in range(4)]
    rows = [(int(rng.integers(400)), int(rng.integers(700, 740)), bits(), bits()) for _ in range(400)]
    rows += [(500 + k, *rows[0][1:]) for k in range(30)] + [(9, 700, [-1] * 4, [0] * 4), (600, None, [1, 2, 3, 4], [1, 2, 3, 4])]
    schema = "id long, aspect int, difference array<long>, average array<long>"
    small = dedupe._nearest_two
    monkeypatch.setattr(dedupe, "_nearest_two", lambda *args: small(*args, part, slice_))
    monkeypatch.setattr(dedupe, "near_prints", None)  # bands aren't asked
    found = {r.id: (r.difference_bits, r.average_bits, r.match_id) for r in dedupe.nearest_fingerprint(spark.createDataFrame(rows[50:], schema), spark.createDataFrame(rows[:410], schema), "id", chance=1).collect()}
    apart = lambda x, y: sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(x, y, strict=True))
    want = {}
    for p in rows[50:]:
        for q in rows[:410]:
            if None not in (p[1], q[1]) and p[0] != q[0] and abs(p[1] - q[1]) <= 8 and (d := apart(p[2], q[2])) <= 16 and (a := apart(p[3], q[3])) <= 20:
                want[p[0]] = min(want.get(p[0], (99,)), (d, a, q[0]))
    assert found == want and len(want) > 200
    both = spark.createDataFrame(rows, schema)
    assert dedupe.nearest_fingerprint(both, both, "id", chance=1).count() > 200  # one table on both sides


def test_pairs_looked_at_grow_with_the_rows(spark):
    """Ten times the rows, of which a third are copies, make about ten times the candidates of equal bands, and copies make none."""
    rng = np.random.default_rng(6)
    schema = "id long, aspect int, difference array<long>, average array<long>"

    def candidates(n):
        rows = [(i, int(rng.integers(600, 900)), rng.integers(-(2**63), 2**63, 4).tolist(), [0, 0, 0, 0]) for i in range(2 * n // 3)]
        rows += [(10**6 + i, *rows[0][1:]) for i in range(n // 3)]
        once = spark.createDataFrame(rows, schema).select(*dedupe.PRINT).distinct()
        assert dedupe.near_prints(once, once).count() == once.count()  # each finds itself, once
        return dedupe.band_pairs(once, once, 17, 8).count(), 2 * n // 3

    (few, n), (many, m) = candidates(300), candidates(3000)
    assert 17 * n <= few <= 17.5 * n and 17 * m <= many <= 17.5 * m  # itself in each band, and hardly any other


def test_lists_and_references(spark):
    assert M.clean_list("B、a、b、A、c") == ["B", "a", "c"]
    rows = [("p.html", "img/1.jpg"), ("OPS/p.html", "../img/%31.jpg#x")]
    found = spark.createDataFrame(rows, "base string, ref string").select(text.resolved_path(F.col("base"), F.col("ref")).alias("p")).collect()
    assert [r.p for r in found] == ["img/1.jpg", "img/1.jpg"]
