"""Hard negatives, substring dedup and conversation repair against brute-force versions."""

import collections
import hashlib
import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import conversation_repair, hard_negatives, queries, substring_dedup
from ledgerlens.session import ship_package

from .test_small_cases import ODD, prose

# -------------------------------------------------------------------------------------------------- hard negatives


def brute_negatives(rows):
    """rows: (vec_id, label, vector), labels as they are mined."""
    ok = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows
          if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = collections.Counter()
    for n, (a, lab, v) in enumerate(ok):
        if a is None or a % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j is None, j or 0, k) for m, (j, k, w) in enumerate(ok)
                  if m != n and len(w) == len(v)]
        scored.sort()
        for p, p_null, p_id, _ in [s for s in scored if s[3] == lab][:5]:
            hard = [s for s in scored if s[3] != lab and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            for r, (s, s_null, s_id, _) in enumerate(hard):
                out[a, None if p_null else p_id, r + 1, None if s_null else s_id, -p, -s] += 1
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, int(rng.integers(0, 4)), (centres[i % 6] + rng.normal(size=8) * 0.4).astype(np.float32).tolist())
            for i in range(400)]
    rows += [(50, 1, rows[50][2]), rows[100], rows[100], (None, 2, rows[7][2]), (None, 1, rows[8][2]), (900, None, rows[9][2]),
             (950, 1, None), (901, 1, [1.0, float("nan")] * 4), (902, 1, [float("inf")] * 8), (903, 1, [None] * 8),
             (1000, 1, []), (1001, 1, []), (1002, 2, []), (1050, 3, [1.0, 2.0]), (1051, 3, [1.0, 2.0]), (1052, 0, [0.9, 1.5]),
             (1053, 3, [1.0, 2.0]), (1100, 5, [3e6, -1.0, 0.5]), (1101, 5, [2e6, 4.0, 0.25]), (1102, 6, [1.5e6, 4.0, 7.0]),
             (1150, 7, rows[0][2]), (-50, 1, rows[11][2])]
    return rows


@pytest.mark.parametrize("block_bytes", [1 << 24, 300])
def test_hard_negatives_equal_brute_force(spark, vectors, block_bytes):
    ship_package(spark)
    df = (spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").repartition(4)
          .selectExpr("*", "'x' AS anchor", "'x' AS slot", "'x' AS score", "'x' AS vec", "'x' AS rank"))
    got = collections.Counter(tuple(r) for r in hard_negatives.mine_hard_negatives(df, block_bytes=block_bytes).collect())
    assert got == brute_negatives(vectors) and len(got) > 50
    assert hard_negatives.mine_hard_negatives(df.limit(0)).count() == 0


def test_packed_products_are_exact():
    rng = np.random.default_rng(0)
    for low, high, d in [(-256, 256, 64), (-5, 6, 3), (0, 1, 4), (7, 9, 5), (-10**6, 10**6, 20), (-2**52, 2**52, 5),
                         (2**52 - 5, 2**52, 40)]:
        a, c = rng.integers(low, high, (17, d)), rng.integers(low, high, (101, d))
        assert (hard_negatives.packed_products(a, c) == a.astype(object) @ c.astype(object).T).all(), (low, high, d)
    wide = hard_negatives._whole(np.array([[1e30, -2.5], [0.3, 1e200]]))
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in wide] for r in wide]
    assert hard_negatives.packed_products(wide, wide).tolist() == want


# ------------------------------------------------------------------------------------------------ substring dedup


def brute_repeats(docs, n=13):
    big = 1 << 64
    words = [(t or "").encode().split() for _, t in docs]
    least = {}
    for (d, _), ws in zip(docs, words):
        for i in range(len(ws) - n + 1):
            key = b" ".join(ws[i:i + n])
            least[key] = min(least.get(key, big), big if d is None else d)
    out = collections.Counter()
    for (d, _), ws in zip(docs, words):
        gone = set()
        for i in range(len(ws) - n + 1):
            if least[b" ".join(ws[i:i + n])] < (big if d is None else d):
                gone |= set(range(i, i + n))
        out[d, len(ws), len(gone), b" ".join(w for i, w in enumerate(ws) if i not in gone).decode()] += 1
    return out


@pytest.mark.parametrize("block_bytes,bucket_bytes", [(4 << 20, 32 << 20), (700, 900)])
def test_substring_dedup_equals_brute_force(make_docs, block_bytes, bucket_bytes):
    rng = np.random.default_rng(9)
    passages = [prose(70 + i, n) for i, n in enumerate([12, 13, 14, 20, 60, 200])]
    docs = list(ODD) + [(None, "no id at all"), (None, prose(70, 30)), (400, passages[4]), (400, passages[4].upper())]
    for i in range(60):
        parts = [prose(500 + i, int(rng.integers(1, 40)))]
        for p in rng.choice(len(passages), int(rng.integers(0, 3))):
            parts += [passages[p], prose(int(rng.integers(600, 9999)), int(rng.integers(1, 30)))]
        docs.append((100 + i, rng.choice([" ", "\n", "\t\t", "\x0b "]).join(parts)))
    docs += [(30, "a " * 200), (29, "a " * 50), (31, "\xa0".join(["b"] * 40)), (32, " ".join(["b"] * 13)), (33, "b " * 13),
             (300, docs[20][1]), (300, docs[20][1]), (301, docs[20][1])]
    df = make_docs(docs)
    out = substring_dedup.remove_repeats(df, block_bytes, bucket_bytes)
    assert out.columns == [*df.columns, "n_words", "n_removed"]
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in out.collect())
    assert got == brute_repeats(docs)
    assert sum(k[2] > 0 for k in got) > 20
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_cover_has_every_difference():
    p, cover = substring_dedup.PERIOD, substring_dedup.COVER
    assert {(a - b) % p for a in cover for b in cover} == set(range(p))


def test_text_is_shuffled_once(make_docs, capsys):
    substring_dedup.remove_repeats(make_docs([(1, prose(1, 50))])).explain()
    plan = capsys.readouterr().out
    assert plan.count("FlatMapCoGroupsInArrow") == 2 or "FlatMapCoGroups" in plan


# -------------------------------------------------------------------------------------------- conversation repair


def brute_repair(rows):
    """rows in order: (turn, role, text) after damage."""
    space, seen, faults = " \t\n\x0b\x0c\r", set(), []
    for _, role, text in rows:
        kept = text.rstrip(space)
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else
                      "truncated" if kept[-1] not in ".!?" else None)
        seen.add((role, text))
    best = None

    def fits(roles):
        s = "".join(r[:1] or "-" for r in roles)
        s = s[1:] if s[:1] == "s" else s
        return (not roles) or (s and len(s) % 2 == 0 and s == "ua" * (len(s) // 2))

    def walk(i, cost, audit, out):
        nonlocal best
        roles = [r for r, _ in out]
        if best is not None and cost > best[0]:
            return
        if roles and not (fits(roles) or fits([*roles, "u", "a"]) or fits([*roles, "a"])):
            return
        if i == len(rows):
            for k in range(3):
                for more in itertools.product(["user", "assistant"], repeat=k):
                    done = out + [(r, "") for r in more]
                    if fits([r for r, _ in done]):
                        found = (cost + 2 * k, audit + "I" * k, "\n".join(f"{r}:{t}" for r, t in done))
                        best = found if best is None else min(best, found)
            return
        _, role, text = rows[i]
        for k in range(3):
            for more in itertools.product(["user", "assistant"], repeat=k):
                base = out + [(r, "") for r in more]
                walk(i + 1, cost + 2 * k + 3, audit + "I" * k + "D", base)
                if faults[i] not in ("blank", "duplicate"):
                    t = faults[i] == "truncated"
                    walk(i + 1, cost + 2 * k + t, audit + "I" * k + "K", base + [(role, text)])
                    for r in ("user", "assistant"):
                        walk(i + 1, cost + 2 * k + 2 + t, audit + "I" * k + "R", base + [(r, text)])

    walk(0, 0, "", [])
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    count = collections.Counter(faults)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), best[0], best[1],
            hashlib.sha256(best[2].encode()).hexdigest())


def conversations(n, seed):
    rng = np.random.default_rng(seed)
    texts = ["Hi.", "hi", "", " \n", "What? ", "ok!", "ok!\x0b", "Wait", "\xa0", "so.\n"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", ""]
    out = []
    for c in range(n):
        for t in range(int(rng.integers(1, 6))):
            out.append((c, None if rng.random() < 0.05 else int(t + (rng.random() < 0.2) * 3), str(rng.choice(roles)),
                        str(rng.choice(texts))))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


@pytest.mark.parametrize("block_rows", [65_536, 1, 2])
def test_repair_equals_brute_force(spark, block_rows):
    rows = conversations(150, 3) + [(None, 1, "user", "Hi."), (None, 2, None, "x."), (None, None, "assistant", None),
                                    (500, -5, "system", "Be kind."), (501, 7, "user", "a."), (501, 7, "user", "a.")]
    held = collections.defaultdict(list)
    for c, t, r, x in rows:
        held[c].append((t, " " if r is None else r, " " if x is None else x))
    df = (spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
          .selectExpr("*", "'x' AS again", "'x' AS fault", "'x' AS kind"))
    got = {r[0]: tuple(r[1:]) for r in conversation_repair.repair(df, block_rows).collect()}
    assert got == {c: brute_repair(ordered(v)) for c, v in held.items()}
    assert conversation_repair.repair(df.limit(0)).count() == 0


def test_dropped_rows_and_damage(spark):
    rows = conversations(60, 8) + [(None, None, None, None), (None, 3, "user", "Hello. You?")]
    held = collections.defaultdict(list)
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind = zlib.crc32(key.encode()) % 20
        held[c] += []
        if kind == 0:
            continue
        x = "" if kind == 1 else "".join(ch for ch in x if ch not in ".!?") if kind == 2 else x
        held[c] += [(t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r[0]: tuple(r[1:]) for r in conversation_repair.repair(conversation_repair.damage(df)).collect()}
    assert got == {c: brute_repair(ordered(v)) for c, v in held.items()}
    all_dropped = df.withColumn("dropped", F.lit(True))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {tuple(r[1:]) for r in conversation_repair.repair(all_dropped).collect()} == {empty}


def test_giant_conversation_spills(spark):
    rows = [(1, i, ["user", "assistant", "user"][i % 3], f"t{i}.") for i in range(3000)] + [(2, 0, "user", "x.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = sorted(conversation_repair.repair(df).collect())
    assert whole == sorted(conversation_repair.repair(df, 256).collect()) == sorted(conversation_repair.repair(df, block_bytes=500).collect())


def test_queries_are_registered():
    assert {"op11_hard_negatives", "op12_substring_dedup", "op13_conversation_repair"} <= set(queries.QUERIES)
