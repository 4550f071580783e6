"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import collections
import hashlib
import json
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import (credentials, decontamination, fingerprints, html_extract, language_id, line_dedup, ngram_lm,
                            packing, simhash, url_filter)

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) + "."


ODD = [(None, "no id at all"), (1, None), (2, ""), (3, "   \n\t"), (4, "x"), (5, "Ünïcode 𝔘 text\nsecond line"),
       (6, prose(6, 40_000)), (7, "same text here"), (8, "same text here"), (9, "same text here"), (9, "same text here")]


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# ------------------------------------------------------------------------------------------------------ line dedup


def brute_lines(docs, min_docs, keep_first=False):
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = collections.defaultdict(set)
    for d in docs:
        for line in (d[1] or "").split("\n"):
            held[line.strip(strip).translate(low)].add(d)
    out = collections.Counter()
    for d in docs:
        lines = (d[1] or "").split("\n")
        keys = [x.strip(strip).translate(low) for x in lines]
        kept = [x for x, k in zip(lines, keys) if not k or len(held[k]) < min_docs]
        out[d[0], len(lines), len(lines) - len(kept), None if d[1] is None else "\n".join(kept)] += 1
    return out


def test_line_dedup_equals_brute_force(make_docs):
    docs = [(i, f"Common line\n{prose(i, 5)}\n  COMMON LINE \t\n\nown {i}\nrare") for i in range(12)]
    docs += ODD + [(50, "common line"), (51, "\n".join(["Common Line"] * 200 + ["last"])), (52, "\xa0common line")]
    df = make_docs(docs)
    out = line_dedup.apply_bitmaps(df, line_dedup.line_bitmaps(df, min_docs=3))
    got = collections.Counter((r.row.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect())
    assert got == brute_lines(docs, 3)


def test_line_dedup_keeps_columns_and_first(make_docs):
    df = make_docs([(1, "a\nb\na"), (2, "b\nc"), (3, None)])
    out = line_dedup.deduplicate_lines(df, min_docs=1, keep_first=True)
    assert out.columns == df.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("a\nb", 3), 2: ("c", 1), 3: (None, None)}
    assert line_dedup.deduplicate_lines(df.limit(0)).count() == 0


# --------------------------------------------------------------------------------------------------------- packing


@pytest.mark.parametrize("window,open_windows", [(16, 2), (1024, 32)])
def test_packing_round_trip(spark, make_docs, window, open_windows):
    docs = ODD + [(100 + i, prose(i, 1 + 7 * i)) for i in range(30)]
    df = make_docs(docs)
    got = packing.pack_documents(df, window=window, open_windows=open_windows, merge_fan_in=2).collect()
    encode = packing.token_encoder()
    want = collections.Counter((d, zlib.crc32(b"".join(p for p in [encode(t or "") + bytes(4)]))) for d, t in docs)
    ids = collections.defaultdict(list)
    for d, t in docs:
        ids[d].append(encode(t or "") + bytes(4))
    for r in got:  # every piece is what it says
        assert any(zlib.crc32(x[4 * r.start:4 * (r.start + r.length)]) == r.ids_crc32 and len(x) // 4 == r.doc_tokens
                   for x in ids[r.doc_id])
    for d, xs in ids.items():  # each id lies in exactly one piece
        assert sum(r.length for r in got if r.doc_id == d) == sum(len(x) // 4 for x in xs)
    assert sum(want.values()) == len(docs)
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    partial = 0
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window
        partial += at < window
    assert partial <= 3  # one per merge group
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_token_encoder_equals_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    encode = packing.token_encoder()
    for x in ["", " ", "a", " a", "a ", "a  b", "a\n\nb", "a\n b", "a \nb", "\n", "\na\n", "it's I'll\nwe've", "x\ty", "x\u00a0y",
              "1²³ 12a", "汉字 かな", "a\u2009b", "<|endoftext|> a", "a" * 5000, " " * 700 + "x", "ab\u3000" * 300, "a  " * 300, "\n" * 199, "\n" * 201, "tab\t\tz\n\t\tq", "é\u0301 ñ", "word. Word, ab! it's. 12. é, ªº. .. ,", "don't. x's,", prose(1, 300)]:
        assert encode(x) == b"".join(i.to_bytes(4, "little") for i in t.encode(x, add_special_tokens=False).ids), repr(x)


# --------------------------------------------------------------------------------------------------------- simhash


def brute_components(docs, bits=3):
    fps = [simhash.fingerprint(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return collections.Counter((d, fps[i], least.get(find(i))) for i, (d, _) in enumerate(docs))


def test_simhash_components_equal_brute_force(make_docs):
    base = prose(3, 400).split()
    near = []
    for i in range(60):
        w = list(base)
        w[(i * 13) % 400] = f"w{i % 20}"
        near.append((200 + i, " ".join(w)))
    docs = ODD + near + [(300 + i, prose(300 + i, 30)) for i in range(60)]
    df = make_docs(docs)
    got = collections.Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == brute_components(docs)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    names = {c for _, _, c in brute_components(docs)} | {None}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((n is None, n or 0) for n in names)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_fingerprint_equals_its_definition():
    """Hashes, seed and majority by the definition, word by word and bit by bit."""
    import re

    import xxhash

    for text in [*(t for _, t in ODD if t is None or len(t) < 1000), prose(1, 3), prose(2, 4), prose(3, 50), "a b", "A\xa0B c d", "x y z " * 9]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
        shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) == want, text


def test_keep_one_row_of_each_component(make_docs):
    t, u = prose(81, 60), prose(82, 60)
    docs = [(1, t), (1, u), (5, t), (6, u), (None, t), (None, t), (None, prose(83, 60)), (None, prose(83, 60)), (7, "own"), (7, "own")]
    got = collections.Counter((r.doc_id, r.text) for r in simhash.keep_one(make_docs(docs)).collect())
    assert got == collections.Counter({(1, t): 1, (1, u): 1, (None, prose(83, 60)): 1, (7, "own"): 1})
    assert simhash.keep_one(make_docs(docs[:1]).limit(0)).count() == 0


def test_simhash_links_random_fingerprints(spark):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = {int(x) for x in seeds}
    for x in seeds.tolist():
        for _ in range(6):
            fps.add(x ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long").repartition(4)
    for bucket_rows in (20_000, 2):  # whole buckets, and buckets cut in blocks
        edges = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.links(df, 3, bucket_rows).collect()]
        assert all((u ^ v).bit_count() <= 3 for u, v in edges)
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in edges:
            root[find(u)] = find(v)
        for i, u in enumerate(fps):
            for v in fps[:i]:
                assert (u ^ v).bit_count() > 3 or find(u) == find(v)


# ------------------------------------------------------------------------------------------------------ url filter


def test_url_filter(spark):
    urls = {"http://a.net/": ("a.net", "/", "net/", "block"), "http://a.net": ("a.net", "", None, "allow"),
            "https://EXAMPLE.net/en/x?q#f": ("example.net", "/en/x", "example.net/en/", "allow"),
            "https://b.example.net/de/": ("b.example.net", "/de/", "net/", "block"),
            "x://example.com/de/1#t": ("example.com", "/de/1", "example.com/de/", "block"),
            "http://badexample.com/de/1": ("badexample.com", "/de/1", None, "allow"),
            "http://casino.org/fr/": ("casino.org", "/fr/", "org/fr/", "allow"),
            "http://m.casino-win.example.com/en/": ("m.casino-win.example.com", "/en/", None, "block"),
            "http://free.example.com/en/": ("free.example.com", "/en/", None, "allow"),
            "http://free-bets.example.com/en/": ("free-bets.example.com", "/en/", None, "block"),
            "http://freedom-betsy.example.com/": ("freedom-betsy.example.com", "/", None, "allow"),
            "http://free.free.example.com/": ("free.free.example.com", "/", None, "allow"),
            "nothing": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
            "casino": ("", "", None, "block"), "http://a?x://b.net/": ("a", "", None, "allow")}
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got == urls
    assert url_filter.judge(df.limit(0)).count() == 0


# ----------------------------------------------------------------------------------------------------- language id


def test_language_id(make_docs):
    de = "der schnelle braune fuchs springt über den faulen hund und läuft weiter"
    en = "the quick brown fox jumps over the lazy dog and runs along the river"
    docs = [(i, f"{en} {i}", "en") for i in range(20)] + [(100 + i, f"{de} {i}", "de") for i in range(20)]
    docs += [(200, "the brown fox runs", "xx"), (201, "und der hund läuft", None), (202, None, "en"), (203, "", "en"),
             (204, "123 !!", "en"), (205, f"{en} {de}", "en"), (206, en * 3000, "en")]
    df = make_docs(docs)
    model = language_id.learn(df.where("doc_id < 200"))
    assert model.langs == ["de", "en"]
    got = {r.doc_id: r.p for r in df.select(
        "doc_id", language_id.predict(df.sparkSession, model, F.col("text")).alias("p")).collect()}
    assert [got[i].lang for i in (200, 201, 202, 203, 204, 206)] == ["en", "de", "und", "und", "und", "en"]
    assert got[202].share == got[204].share == 0
    assert sorted(got[205].langs) == ["de", "en"] and abs(sum(got[205].shares) - 1) < 1e-6
    assert got[206].langs == ["en"]
    assert all(0 <= p.share <= 1 for p in got.values())
    none = language_id.learn(df.limit(0))
    assert {r.p.lang for r in df.select(language_id.predict(df.sparkSession, none, F.col("text")).alias("p")).collect()} == {"und"}


# ------------------------------------------------------------------------------------------------- decontamination


def brute_best(docs, items, n=5, least=0.8):
    def grams(w):
        return collections.Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))

    out = {}
    for d, t in docs:
        words = (t or "").encode().lower().split()
        for item, s in items:
            iw = (s or "").encode().lower().split()
            if len(iw) < n or len(words) < n:
                continue
            g = grams(iw)
            for at in range(max(1, len(words) - len(iw) + 1)):
                w = grams(words[at:at + len(iw)])
                both = sum((w & g).values())
                sim = both / (sum(w.values()) + sum(g.values()) - both)
                if sim >= least and sim > out.get((d, item), (0,))[0]:
                    out[d, item] = (sim, at)
    return out


def test_decontamination_of_a_long_item(spark, make_docs):
    """Hundreds of windows of thousands of shingles: whole batches, the true place, and nothing of the clean text."""
    words = [f"w{i * i % 7919}x{i}" for i in range(2000)]
    other = [f"v{i}" for i in range(9000)]
    df = make_docs([(1, " ".join(other[:700] + words + other[700:1500])), (2, " ".join(other)), (None, " ".join(words[:1850])),
                    (3, " ".join(words[:1500]))])
    bench = spark.createDataFrame([(7, " ".join(words)), (8, " ".join(words[100:107]))], "item_id long, text string")
    rows = decontamination.contaminated_windows(df, bench).collect()
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, round(r.similarity, 6)) for r in rows}
    assert got == {(1, 7): (700, 2000, 1.0), (1, 8): (800, 7, 1.0), (3, 8): (100, 7, 1.0), (None, 8): (100, 7, 1.0),
                   (None, 7): (0, 2000, round(1846 / 1996, 6))}


def test_decontamination_equals_brute_force(spark, make_docs):
    items = [(1, prose(901, 30)), (2, prose(902, 17)), (3, "too few words"), (4, None), (5, ""), (6, "a b a b a b a b a b"),
             (7, prose(902, 17)), (8, "one two three four five")]
    docs = [(i, prose(i, 60)) for i in range(8)]
    docs += [(20, prose(20, 40) + " " + prose(901, 30).upper() + " " + prose(21, 40)), (21, prose(902, 17)),
             (22, " ".join(prose(901, 30).split()[:28])), (23, prose(5, 9) + "\n" + "A b " * 12), (24, None), (25, ""),
             (26, "zero one two three four five six"), (27, prose(901, 30).replace(prose(901, 30).split()[29], "changed"))]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS size", "'x' AS shingles")
    df = make_docs(docs)
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in
           decontamination.contaminated_windows(df, bench).collect()}
    assert got == brute_best(docs, items)
    kept = decontamination.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert decontamination.contaminated_windows(df.limit(0), bench).count() == 0
    assert decontamination.contaminated_windows(df, bench.limit(0)).count() == 0


def test_decontamination_index_holds_all_within_its_radius():
    """Block keys of fingerprints at every distance: none within the radius is missed, few at random meet."""
    import random

    rng = random.Random(5)
    widths = [bits for bits, _ in decontamination.BLOCKS]
    assert sum(widths) == 64

    def meet(x, y):
        at = 0
        for bits, radius in decontamination.BLOCKS:
            if ((x ^ y) >> at & ((1 << bits) - 1)).bit_count() <= radius:
                return True
            at += bits
        return False

    for _ in range(2000):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), rng.randrange(decontamination.RADIUS + 1)):
            y ^= 1 << bit
        assert meet(x, y)
    assert sum(meet(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(4000)) < 1000


def test_decontamination_index_in_sql_equals_its_definition(spark):
    fps = [0, -1, 1, 0x1234567890ABCDEF, -0x1234567890ABCDE]
    df = spark.createDataFrame([(f,) for f in fps], "fp long").selectExpr(
        "fp", f"{decontamination._blocks('fp', False)} AS own", f"{decontamination._blocks('fp', True)} AS near")
    for r in df.collect():
        want_own, want_near, at = [], set(), 0
        for k, (bits, radius) in enumerate(decontamination.BLOCKS):
            own = (r.fp & (1 << 64) - 1) >> at & ((1 << bits) - 1)
            want_own.append((k << 16) + own)
            want_near |= {(k << 16) + v for v in range(1 << bits) if (v ^ own).bit_count() <= radius}
            at += bits
        assert r.own == want_own and set(r.near) == want_near and len(r.near) == decontamination.ENTRIES


def test_window_hashes_tell_runs_apart():
    import numpy as np

    rng = np.random.default_rng(3)
    prints = decontamination._Prints()
    for n in (50, 5, 300):  # a shorter text after a longer one
        s = rng.integers(0, 1 << 64, 4, np.uint64)[rng.integers(0, 4, n)]  # hashes, many equal runs
        prints.start(s)
        seen = {}
        for size in (1, 2, 3, 7):
            for at, h in enumerate(prints.of(np.arange(max(0, n - size + 1)), size).tolist() if n >= size else ()):
                run = tuple(s[at:at + size].tolist())
                assert seen.setdefault(run, h) == h
        assert len(set(seen.values())) == len(seen)


def test_decontamination_of_items_without_or_with_repeated_ids(spark, make_docs):
    """Items without an id count, a repeated id keeps its best window, repeated documents give one row a document."""
    docs = [(1, prose(1, 20) + " " + prose(901, 30)), (1, prose(1, 20) + " " + prose(901, 30)), (2, prose(902, 17)),
            (3, prose(3, 40)), (None, prose(902, 17))]
    bench = spark.createDataFrame([(None, prose(901, 30)), (5, prose(902, 17)), (5, prose(901, 30)), (5, prose(902, 17))],
                                  "item_id long, text string")
    df = make_docs(docs)
    got = sorted(((r.doc_id, r.item_id, r.start_word, r.n_words, r.similarity)
                  for r in decontamination.contaminated_windows(df, bench).collect()), key=str)
    assert got == sorted([(1, None, 20, 30, 1.0), (1, 5, 20, 30, 1.0), (2, 5, 0, 17, 1.0), (None, 5, 0, 17, 1.0)], key=str)
    assert [r.doc_id for r in decontamination.decontaminate(df, bench).collect()] == [3]


def test_decontamination_of_an_item_of_twenty_thousand_words(spark, make_docs):
    """Thousands of windows of twenty thousand words are written by their place, and the true one is found."""
    words = [f"w{i * i % 7919}x{i}" for i in range(20_000)]
    df = make_docs([(1, " ".join([f"a{i}" for i in range(500)] + words + ["end"] * 30)), (2, " ".join(words[:5000]))])
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert [(r.doc_id, r.start_word, r.n_words, r.similarity) for r in
            decontamination.contaminated_windows(df, bench).collect()] == [(1, 500, 20_000, 1.0)]


# ---------------------------------------------------------------------------------------------------- secret scans


def brute_base(text):
    import re

    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(credentials.ASSIGN, text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secret_scan(make_docs):
    key = "a1B2c3D4e5F6g7H8i9J0kLmN"
    docs = [(1, None, "en", "a"), (2, "", "en", "a"), (3, 'Password: "hunter2hunter2" token=short', "en", "a"),
            (4, "𝔘 api_key = 'abcdefgh' AKIAAKIA1234567890 AKIA123", "en", "b"), (5, "0" * 31 + " " + "ab" * 20, "en", "b"),
            (6, "secret: token: abcdefghij secret=token=abcdefghijk", "en", "b"), (7, "mark \ue000 token=abcdefgh1", "en", None),
            (8, f"live {key}", "en", "x"), (9, f"live {key}", "en", "x"), (10, "TOKEN = abcdefgh\n" * 3000, "en", "y")]
    docs += [(20 + i, "copied EXAMPLEexample0123456789", "en", f"o{i}") for i in range(5)]
    df = make_docs(docs)
    got = {r.doc_id: r for r in credentials.digest(credentials.find_secrets(df)).collect()}
    for d, t, _, _ in docs:
        base = brute_base(t)
        text = ",".join(f"{credentials.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert got[d].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), d
        assert [got[d].n_assign, got[d].n_access, got[d].n_hex] == [sum(b[1] == k for b in base) for k in range(3)]
    assert got[8].spans == f"live:5:{5 + len(key)}" and got[20].spans == "" and got[20].n_examples == 1
    assert credentials.find_secrets(df.limit(0)).count() == 0


def test_secret_of_one_owner_is_live_in_any_number_of_documents(make_docs):
    key, example = "a1B2c3D4e5F6g7H8i9J0kLmN", "z9Y8x7W6v5U4t3S2r1Q0pOnM"
    docs = [(i, f"key {key}", "en", "hot") for i in range(30)] + [(100 + i, f"own text {i} {key}", "en", "hot") for i in range(30)]
    docs += [(200 + i, example, "en", f"o{i}") for i in range(3)]
    got = {r.doc_id: r for r in credentials.digest(credentials.find_secrets(make_docs(docs))).collect()}
    assert all(got[i].n_live == got[100 + i].n_live == 1 and got[i].spans == f"live:4:{4 + len(key)}" for i in range(30))
    assert all((got[200 + i].n_live, got[200 + i].n_examples) == (0, 1) for i in range(3))


def test_secret_spans_are_linear(spark):
    import time

    from ledgerlens.llm.common import stored

    text = "token=abcdefgh1 " * 100_000
    df = stored(spark.createDataFrame([(1, text, "a"), (2, "token=abcdefgh1", "a")], "doc_id long, text string, source string"), "t")
    credentials.scan(df.where("doc_id = 2")).collect()
    t = time.perf_counter()
    r = credentials.scan(df.where("doc_id = 1")).select("assign").first()
    assert time.perf_counter() - t < 15 and [(x.start, x.end) for x in r.assign] == [(16 * i, 16 * i + 15) for i in range(100_000)]


def test_secrets_equal_their_sql(make_docs, tmp_path):
    import duckdb

    from ledgerlens.llm import oracle

    key, example = "a1B2c3D4e5F6g7H8i9J0kLmN", "z9Y8x7W6v5U4t3S2r1Q0pOnM"
    docs = [(i, f"key {key} {i}", "en", "hot") for i in range(40)] + [(100 + i, f"{i} {example}", "en", f"o{i}") for i in range(25)]
    docs += [(200, None, "en", "a"), (201, 'Password: "hunter2hunter2" ' + "ab" * 20, "en", None), (202, example, "en", None)]
    make_docs(docs, clash=False).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = credentials.digest(credentials.find_secrets(make_docs(docs)))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle.SQL['op10_secret_scan']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(r[got.columns.index("n_live")] for r in want) >= 40


# ---------------------------------------------------------------------------------------------------- fingerprints


def test_fingerprints(make_docs):
    docs = ODD[:-1] + [(40 + i, prose(i, 30 + 40 * i)) for i in range(10)] + [(60, "a" * 5000)]
    got = fingerprints.fingerprint_with_next(make_docs(docs), ranges=4).collect()
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(docs) == len(by_id)
    for i, (d, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        r, changed = by_id[d], fingerprints.edited(t, following)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = (fingerprints.Fingerprint(x) for x in (t, changed, following))
        assert (r.fingerprint, r.edited_fingerprint) == (str(a), str(b))
        assert (r.near_edited, r.near_next) == (a.likeness(b), fingerprints.Fingerprint.parse(str(a)).likeness(c))
    assert 0.4 < by_id[5].near_edited < 1 and 0.5 < by_id[6].near_edited < 0.95
    assert by_id[7].fingerprint == by_id[8].fingerprint and by_id[7].near_next == 1.0
    assert fingerprints.fingerprint_with_next(make_docs(docs).limit(0)).count() == 0
    assert fingerprints.fingerprint_with_next(make_docs([(1, "only one of its kind here")])).first().near_next == 1.0


def test_ranges_of_ids_are_found_by_halving(spark):
    import bisect

    for n in (0, 1, 2, 3, 7, 8, 1000, fingerprints.MAX_RANGES):
        cuts = [-(1 << 63) + 1, *range(-5, 10 * (n - 1) - 5, 10)][:n]
        df = spark.range(-20, 200).unionAll(spark.createDataFrame([(-(1 << 63) + 1,), (-(1 << 62),), ((1 << 63) - 1,)], "id long"))
        got = df.selectExpr("id", f"{fingerprints._count_below('id', cuts)} AS n").collect()
        assert all(r.n == bisect.bisect_left(cuts, r.id) for r in got)


def test_syncmers_are_context_free():
    passage = prose(77, 60)
    inside = fingerprints.anchors(prose(1, 50) + passage + prose(2, 50))[0]
    alone = fingerprints.anchors(passage)[0]
    assert set(alone) <= set(inside)


def test_fingerprints_keep_all_anchors(make_docs):
    passage = prose(78, 70)
    rng = np.random.default_rng(9)
    long = [" ".join("".join(rng.choice(list("abcdefghij"), 7)) for _ in range(3000)) for _ in range(2)]
    texts = [f"{t[:9000]} {passage} {t[9000:]}" for t in long]
    got = {r.doc_id: r for r in fingerprints.fingerprint_with_next(make_docs(list(enumerate(texts))), ranges=1).collect()}
    both = [fingerprints.anchors(t)[0] for t in texts]
    shared = len(set(fingerprints.anchors(passage)[0]))
    assert all(len(fingerprints.Fingerprint.parse(got[i].fingerprint).hashes) == len(both[i]) > 3000 for i in (0, 1))
    assert got[0].near_next >= 2 * shared / (len(both[0]) + len(both[1])) > 0
    whole = [fingerprints.anchors(x) for x in (texts[0], fingerprints.edited(*texts))]
    common = len(np.intersect1d(whole[0][0], whole[1][0]))
    assert got[0].near_edited == pytest.approx(2 * common / sum(len(h) for h, _ in whole), abs=0.002)
    for t in (texts[0], "a" * 100_000 + texts[1], ""):
        fp = fingerprints.Fingerprint(t)
        back = fingerprints.Fingerprint.parse(str(fp))
        assert (back.hashes == fp.hashes).all() and (back.places == fp.places).all() and str(back) == str(fp)


def test_fingerprints_across_the_border_of_short_texts(make_docs):
    near = prose(5, 40)
    for n in (30, 95, 96, 97, 100, 127, 128):
        for following in ("", None, "few words", prose(6, 60)):
            docs = [(1, near[:n]), (2, following)]
            r = next(r for r in fingerprints.fingerprint_with_next(make_docs(docs), ranges=1).collect() if r.doc_id == 1) \
                if n in (96, 127) and following != "" else None
            a, b = fingerprints.Fingerprint(near[:n]), fingerprints.Fingerprint(fingerprints.edited(near[:n], following or ""))
            assert a.likeness(b) == b.likeness(a) >= 0.25, (n, following)
            assert r is None or r.near_edited == a.likeness(b)
    for n in range(30, 140):
        a, b = fingerprints.Fingerprint(near[:n]), fingerprints.Fingerprint(near[:n + 1])
        assert a.likeness(b) > 0.6 and a.likeness(a) == 1.0, n
    a, b = fingerprints.Fingerprint(near[:95]), fingerprints.Fingerprint(near[:97])
    assert fingerprints.Fingerprint.parse(str(b), near[:97]).likeness(a) == a.likeness(b) > 0.9
    # nothing of a text without any anchor is like nothing
    assert not any(fingerprints.Fingerprint(x).likeness(fingerprints.Fingerprint(y)) for x in ("", "uvwxy", "uvwxyz")
                   for y in ("abcde", "ABCDE", "klmno", "fghij"))


# -------------------------------------------------------------------------------------------------- html extraction


def page(i, body, extra=""):
    return (f"<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style><script>var a='</p>{i}';</script></head><body>"
            f"<nav><ul><li><a href=/x{i}>menu {i}</a></li></ul></nav>{extra}<div class=box>Welcome to our site</div>{body}"
            f"<div class='comments'><p>reader {i}</p></div><footer>&copy; {i}</footer></body></html>")


def test_html_extraction(spark):
    pages = [(i, f"http://h.com/{i}", page(i, f"<div class=text><h1>Head {i}</h1><p>Body&amp;  text\n {i}<br>more<p>Second {i}</div>"))
             for i in range(8)]
    pages += [(20, "http://h.com/20", page(20, "<div class=other><p>Unlike <b>any</b> other page of this host it is</div>")), (21, None, None), (22, "", ""),
              (23, "http://few.com/", page(23, "<p>few pages here, all of it kept</p>")), (24, "http://few.com/", "<div>" * 3000 + "deep"),
              (25, "http://few.com/", "<article><p>in</p></article><p>out"), (26, "http://few.com/", "plain < text & more"),
              (26, "http://few.com/", "plain < text & more"), (27, "http://few.com/", "<p>" + "long text " * 50_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'x' AS tree")
    got = collections.defaultdict(list)
    for r in html_extract.extract_text(df).collect():
        got[r.page_id].append(r.text)
    for i in range(8):
        assert got[i] == [f"Head {i}\n\nBody& text {i} more\n\nSecond {i}"]
    assert got[20] == ["Unlike any other page of this host it is"]
    assert got[21] == [""] and got[22] == [""]
    assert got[23] == ["Welcome to our site\n\nfew pages here, all of it kept"]
    assert got[24] == ["deep"] and got[25] == ["in"]
    assert got[26] == ["plain < text & more"] * 2
    assert got[27] == [("long text " * 50_000).strip()]
    assert html_extract.extract_text(df.limit(0)).count() == 0


def test_html_template_of_layouts_sections_and_short_articles(spark):
    notice = "This constant notice is longer than the short article that stands below it on the page."
    pages = []
    for i in range(8):
        pages += [(100 + i, f"http://a.com/{i}", f"<div class=q>{notice}</div><p>Short {i}</p>"),  # mostly template
                  (200 + i, f"http://b.com/en/{i}", f"<div class=q>{notice}</div><p>English {i}</p>"),  # two languages
                  (300 + i, f"http://b.com/de/{i}", f"<div class=q>Immer derselbe Hinweis</div><p>Deutsch {i}</p>"),
                  (400 + i, f"http://c.com/{i}", f"<section><p>One layout {i}</p></section>"),  # a node the other lacks
                  (500 + i, f"http://d.com/{i}", f"<div class=z{'abcdefgh'[i]}></div><p>{notice}</p>")]  # copies
    pages += [(450 + i, f"http://c.com/x{i}", f"<div class=q>{notice}</div><div class=r>Other layout {i}</div>") for i in range(6)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_text(df).collect()}
    for i in range(8):
        assert [got[k + i] for k in (100, 200, 300, 400, 500)] == [
            f"Short {i}", f"English {i}", f"Deutsch {i}", f"One layout {i}", notice]
    assert [got[450 + i] for i in range(6)] == [f"Other layout {i}" for i in range(6)]


def test_html_everyday_words_and_teasers():
    def text(page):
        return [b.text for b in html_extract.main_blocks(html_extract.parse(page)[1])]

    body = "This is running text of a page with well over a dozen words, and nobody may drop it."
    for attrs in ("id=search-algorithms", "id=privacy", "class=response", "id=social-impact", "class='legal'", "id=menu-theory"):
        for page in (f"<section {attrs}><h2>Head</h2><p>{body}</section>", f"<article><p>a</p><div {attrs}><h2>Head</h2><p>{body}</div></article>",
                     f"<div {attrs}><h2 {attrs}>Head</h2><p>{body}</div>"):
            assert text(page)[-2:] == ["Head", body], page
    assert text(f"<main><h2 id=social-impact>Head</h2><section id=sidebar><p>{body}</section></main>") == ["Head", body]
    # the same words without running text, and names of boilerplate, still drop
    for attrs in ("class=share", "id=search", "class='x cookies'", "class=site-sidebar", "id=comments", "class=related"):
        assert text(f"<div {attrs}><p>a few words</p><a href=/x>{body}</a></div><p>{body}") == [body], attrs
    assert text(f"<div class=comments><p>Other {body}</div><article><p>{body}<div class=ad>{body}</div></article>") == [body]
    # a teaser in an article element is not the page; a page in an article element is
    assert text(f"<div><p>{body}<p>{body}</div><article><p>Teaser</article>") == [body, body, "Teaser"]
    assert text(f"<div><p>aside</div><article><p>{body}</article><p>few words") == [body]


def test_html_short_paragraphs_and_widgets_stay():
    def text(page):
        return [b.text for b in html_extract.main_blocks(html_extract.parse(page)[1])]

    short = [f"Short paragraph {i}." for i in range(30)]
    page = "<div>" + "".join(f"<p>{x}" for x in short) + "</div><article><p>A teaser of one line</article>"
    assert text(page) == [*short, "A teaser of one line"]
    running = " ".join(f"word{i}" for i in range(120))
    for name in ("widget", "login", "promo", "menu", "teaser"):
        assert text(f"<main><div class={name}>{running}</div></main>") == [running], name


def test_html_of_broken_tags_is_linear():
    import time

    for piece in ("</x ", "<a ", "<a '", '<a "', "<!x ", "<p title=\"'", "<", "<a <!--", "&#"):
        for end in ("", ">", "'>", '">x<p>y'):
            t = time.perf_counter()
            html_extract.parse(piece * ((1 << 20) // len(piece)) + end)
            assert time.perf_counter() - t < 5, (piece, end)
    assert [b.text for b in html_extract.parse("a <b>c</b> < d <e")[1]] == ["a c < d <e"]


def test_html_template_without_telling_names(spark):
    """Planted hosts whose classes say nothing: what the method removes is what stands on all pages, and nothing else."""
    rng = np.random.default_rng(4)
    pages, want = [], {}
    for h in range(4):
        constant = [prose(1000 + 10 * h + k, int(rng.integers(3, 30))) for k in range(5)]
        for i in range(12):
            body = [prose(int(rng.integers(10**6)), int(rng.integers(3, 40))) + f" {h} {i} {k}" for k in range(int(rng.integers(1, 6)))]
            left, right = constant[:int(rng.integers(2, 4))], constant[3:]
            pages.append((100 * h + i, f"http://h{h}.com/s/{i}", "<div class=q1>" + "".join(f"<div class=w{'abc'[k]}>{x}</div>" for k, x in enumerate(left))
                          + "</div><div class=q2>" + "".join(f"<p>{x}</p>" for x in body) + "</div>"
                          + "".join(f"<div class=z{'ab'[k]}><div>{x}</div></div>" for k, x in enumerate(right))))
            want[100 * h + i] = ("\n\n".join(body), len(left) + len(right))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: (r.text, r.n_template) for r in html_extract.extract_text(df).collect()} == want


def test_label_paths_hold_the_tree_matching():
    a, b = (json.loads(html_extract.written(html_extract.parse(x)[0])) for x in (
        "<div class=a><p>x</p><ul><li>y</ul></div><p>z", "<div class=a><ul><li>y<li>w</ul><p>x</p></div><h1>t</h1><p>z"))
    paths = [dict(html_extract.node_paths(t)) for t in (a, b)]
    pairs = html_extract.match_trees(a, b)[1]
    assert len(pairs) > 3 and all(paths[0][x] == paths[1][y] for x, y in pairs)
    assert all(len(set(p.values())) == len(p) for p in paths)


def test_tree_matching_keeps_order_and_ancestry():
    a = ["", 0, [["x", 1, []], ["y", 2, [["z", 3, []]]]]]
    b = ["", 0, [["y", 1, [["z", 2, []], ["q", 3, []]]], ["x", 4, []]]]
    score, pairs = html_extract.match_trees(a, b)
    assert score == 3 and sorted(pairs) == [(0, 0), (2, 1), (3, 2)]


# ------------------------------------------------------------------------------------------------------- LM scoring


def test_lm_scores_equal_brute_force(make_docs):
    docs = ODD + [(500 + i, prose(i, 20 + i)) for i in range(40)]
    df = make_docs(docs).withColumn("train", F.coalesce("doc_id", F.lit(0)) % 3 != 0)
    text = {}
    uni, bi, ctx = collections.Counter(), collections.Counter(), collections.Counter()
    for d, t in docs:
        words = (t or "").encode().lower().split() + [None]
        text[d] = words
        if (d or 0) % 3:
            uni.update(words)
            bi.update(zip([0] + words[:-1], words))
            ctx.update([0] + words[:-1])
    n, v, m = sum(uni.values()), len(uni), ngram_lm.DIRICHLET
    got = ngram_lm.score_documents(df, block_bytes=2000).collect()
    assert len(got) == len(docs)
    for r in got:
        words = text[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(uni[w] > 0 for w in words), n)
        assert r.held_out == ((r.doc_id or 0) % 3 == 0)
        p = {w: (uni[w] + 1) / (n + v + 1) for w in set(words)}
        assert r.base_score == pytest.approx(sum(math.log10(p[w]) for w in words), abs=1e-6)
        want = sum(math.log10((bi[h, w] + m * p[w]) / (ctx[h] + m)) for h, w in zip([0] + words[:-1], words))
        assert r.score == pytest.approx(want, abs=2e-4 * len(words))
    assert ngram_lm.score_documents(df.limit(0)).count() == 0
    none = ngram_lm.score_documents(df.withColumn("train", F.lit(False))).collect()
    assert len(none) == len(docs) and {r.n_known for r in none} == {0}


def test_lm_query_scores_trigrams(spark, make_docs, tmp_path):
    """Scores of the query against a plain trigram model, with hot pairs of words whose trigrams are cut in many slices."""
    import zlib

    from ledgerlens.llm import queries

    docs = ODD + [(500 + i, prose(i, 20 + i)) for i in range(40)] + [(600 + i, "the the " * i + prose(i, 9)) for i in range(30)]
    make_docs(docs, clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    train = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2
    uni, bi, tri, ctx, ctx2 = (collections.Counter() for _ in range(5))
    for d, t in docs:
        words = [0, *(t or "").encode().lower().split(), None]
        if train(d):
            uni.update(words[1:])
            for c, n, of in ((bi, 2, 0), (ctx, 1, 1), (tri, 3, 0), (ctx2, 2, 1)):
                c.update(tuple(words[i:i + n]) for i in range(len(words) - n + 1 - of))
    n, v, m = sum(uni.values()), len(uni), ngram_lm.DIRICHLET

    def p(*w):
        if len(w) == 1:
            return (uni[w[0]] + 1) / (n + v + 1)
        count, of = (bi[w], ctx[w[:1]]) if len(w) == 2 else (tri[w], ctx2[w[:2]])
        return (count + m * p(*w[1:])) / (of + m)

    def score(t):
        words = [0, *(t or "").encode().lower().split(), None]
        return sum(math.log10(p(*words[max(0, i - 2):i + 1])) for i in range(1, len(words)))

    want = collections.Counter((d, train(d), round(score(t), 4)) for d, t in docs)
    got = queries.op4_lm_scoring(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, not r.held_out, round(r.score, 4)) for r in got) == want
    blocks = ngram_lm.score_documents(make_docs(docs).withColumn("train", F.crc32(F.coalesce(
        F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2), block_bytes=500, order=3).collect()
    assert collections.Counter((r.doc_id, not r.held_out, round(r.score, 4)) for r in blocks) == want


def test_lm_trie_finds_what_it_holds(tmp_path):
    """Counts of bigrams and trigrams, from a memory map; nodes that only lead on and n-grams without a count have none."""
    contexts = np.array([3, 9, 1 << 40], np.uint64)
    parent, child = np.array([0, 0, 1, 2, 2]), np.array([5, 700, 5, 0, 1], np.uint64)
    count = np.array([1, 0, 123_456, 0, 999])
    owner, grand = np.array([0, 1, 1, 3, 4]), np.array([1, 0, 8, 7, 7], np.uint64)
    count3 = np.array([1, 0, 17, 0, 2])
    built = ngram_lm.TrieShard.build(contexts, parent, child, count, owner, grand, count3)
    assert built.bigrams.children.n == 4 and built.trigrams.children.n == 3
    (tmp_path / "shard").write_bytes(built.to_bytes())
    trie = ngram_lm.TrieShard.from_buffer(np.memmap(tmp_path / "shard", np.uint8, "r"))
    codes = trie.codes(contexts, parent, child, owner, grand)
    assert ngram_lm._count(codes[0]) == pytest.approx(count, rel=3e-4)
    assert (ngram_lm._count(codes[1]) == count3).all() and (ngram_lm._count(codes[0])[[0, 1, 3, 4]] == [1, 0, 0, 999]).all()
    other = trie.codes(np.array([4, 9], np.uint64), np.array([0, 1]), np.array([5, 1 << 31], np.uint64), np.array([0, 1]),
                       np.array([1, 1], np.uint64))
    assert [c.tolist() for c in other] == [[0, 0], [0, 0]]


def test_lm_contexts_are_cut_by_their_uses():
    """A context with a third of all uses goes to many shards and floods none; a rare one is in one shard; bigrams of
    words or contexts that training lacks are not asked for."""
    rng = np.random.default_rng(4)
    vocab = np.sort(rng.integers(0, 1 << 64, 30_001, np.uint64))
    n, shards = len(vocab), 40
    word = np.arange(n - 1)
    context = np.where(word % 3 == 0, 0, word)  # number 0 is the hot one
    uses = np.append(np.ones(n), 1.0)
    uses[0] = 10_000
    total = uses.copy()
    total[[5, 7]] = 0
    _, _, order = ngram_lm._bigram_questions(context, word, vocab, total, uses, 30_000, shards)
    hot = [np.count_nonzero(context[at] == 0) for _, at in order]
    assert sum(h > 0 for h in hot) > shards / 2 and max(len(at) for _, at in order) < 3 * n / shards
    rare = np.flatnonzero(context == 100)
    assert sum(bool(np.isin(rare, at).any()) for _, at in order) == 1
    asked = np.concatenate([at for _, at in order])
    assert set(range(n - 1)) - set(asked.tolist()) == {5, 7}


def test_elias_fano_round_trip(tmp_path):
    rng = np.random.default_rng(0)
    for universe in (10, 1000, 1 << 40, 1 << 62):
        values = np.sort(rng.integers(0, universe, 500, dtype=np.uint64))
        ef = ngram_lm.EliasFano.encode(values, universe)
        (tmp_path / "level").write_bytes(ef.to_bytes())
        ef, _ = ngram_lm.EliasFano.from_buffer(np.memmap(tmp_path / "level", np.uint8, "r"), 0)
        assert (ef.values() == values).all()
        x = rng.integers(0, universe, 300, dtype=np.uint64)
        assert (ef.successor(x) == np.searchsorted(values, x, "left")).all()
