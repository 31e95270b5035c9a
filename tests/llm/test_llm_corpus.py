"""Token alignment, SimHash and the filter audit: whole tables and odd rows against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from compare import connect, rows_of_duckdb, rows_of_spark
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from plumbline.llm import alignment, filter_audit, queries, simhash  # noqa: E402

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, n int, chain int, blocks int, fp string, pair int, uid string, part int, mask int, _n int"
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, 2, 3, "x", 4, "u", 5, 6, 7) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    made = lambda n: " ".join("".join(rng.choice(("th", "An", "er", "IN", "on", "at", "é", "ß", "日本")) for _ in range(rng.randint(1, 3))) for _ in range(n))
    out = [(0, None, "en"), (1, "", None), (2, " \n\t ", "en"), (3, "one two", "en"), (3, "one two", "en"), (None, "one two", "en"), (9, "one two", "")]
    odd = ["The É ß 日本 \U0001f389 x\x00y", " <|endoftext|> <s> </s> <unk>", "a▁b", "▁", "  a  b   c\n\n d\t\te 　 f", "don't we'll 12,345 ...", "a b c \x1cd \x85e", "x" * 3000, " ".join("ab cd" for _ in range(300)), "é ́x ​ y"]
    out += [(10 + k, t, "de") for k, t in enumerate(odd)]
    base = made(400)
    for k in range(30, 60):
        words = base.split(" ")
        words[rng.randrange(400)] = f"w{k % 4}"
        out.append((k, " ".join(words), rng.choice(("en", "de"))))
    out += [(k, made(rng.randint(1, 150)), rng.choice(("en", "de", None))) for k in range(60, 90)]
    out += [(k, base, "fr") for k in range(90, 99)]
    out += [(99, made(40_000), "en"), (100, made(300) + "#", "en")]
    # one length, one first block, and others that differ late
    late = made(2_000)
    out += [(110 + k, late[: len(late) - 1 - k] + "Z" + late[len(late) - k :], "en") for k in (0, 1, 1, 1500, 1500, 7)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).cache()


@pytest.fixture(scope="module")
def small_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# alignment


def aligned_by_loop(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    level = alignment.byte_level()
    docs = []
    for t in texts:
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        xb = [bytes(level[c] for c in a.id_to_token(i)) for i in x]
        yb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        whole = (" " + (t or "")).encode()
        if not t or b"".join(xb) != whole or b"".join(yb) != whole:
            docs.append(([], [], []))
            continue
        xe, ye = list(itertools.accumulate(map(len, xb))), list(itertools.accumulate(map(len, yb)))
        groups, i, j = [], 0, 0
        for end in sorted(set(xe) & set(ye)):
            k, m = xe.index(end, i) + 1, ye.index(end, j) + 1
            groups.append((x[i:k], y[j:m]))
            i, j = k, m
        links, j = [], 0
        for i in range(len(x)):
            start = xe[i - 1] if i else 0
            while ye[j] <= start:
                j += 1
            k = j
            while k < len(y) and (ye[k - 1] if k else 0) < xe[i]:
                links.append((x[i], y[k]))
                k += 1
        docs.append(((x, y), groups, links))
    counts = collections.Counter(p for d in docs for p in set(d[2]))
    best = {}
    for (i, _), c in counts.items():
        best[i] = max(best.get(i, 0), c)
    out = []
    for ids, groups, links in docs:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        x, y = ids or ([], [])
        out.append((len(x), len(y), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if ids else ""))
    return out, counts


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def as_bag(ids, values):
    return collections.Counter(zip(ids, values, strict=True))


@pytest.mark.parametrize("hot", [alignment.HOT_PAIRS, 60, 0])
@pytest.mark.parametrize("section", [alignment.SECTION, 300])
def test_alignment_equals_a_loop(monkeypatch, spark, rows, docs, hot, section):
    from plumbline.llm.common import stored

    monkeypatch.setattr(alignment, "SECTION", section)
    want, counts = aligned_by_loop([t for _, t, _ in rows])
    found = stored(alignment.linked(docs, A, B), "t")
    pairs = alignment.pair_counts(found, 32000)
    assert {(r.a_id, r.b_id): r.docs for r in pairs.collect()} == counts
    got = alignment.scores(found, pairs, hot).collect()
    assert as_bag([r.doc_id for r in got], [tuple(r[c] for c in COLUMNS) for r in got]) == as_bag([i for i, *_ in rows], want)


def test_sections_cut_long_texts_alike(spark, rows):
    """Keys and sections give what the whole text gives, here in this process."""
    two = alignment.Aligner(A, B)
    for _, t, _ in rows:
        if t:
            whole, parts = " " + t, []
            low = 0
            while (m := alignment.CUT.search(whole, low + 40)) and len(whole) - low > 40:
                parts.append(whole[low : m.start()])
                low = m.start()
            parts.append(whole[low:])
            a, b = two.align([whole]), two.align(parts)
            if a[2][0]:
                assert a[0][0] == ";".join(b[0]) and b[2].all()
            else:
                assert not b[2].all()


def test_alignment_query(spark, sf_dir, small_docs):
    ids = small_docs.collect()
    want, _ = aligned_by_loop([r.text for r in ids])
    got = queries.op11_alignment(spark, sf_dir)
    assert got.columns == ["doc_id", *COLUMNS]
    got = got.collect()
    assert as_bag([r.doc_id for r in got], [tuple(r[c] for c in COLUMNS) for r in got]) == as_bag([r.doc_id for r in ids], want)


def test_alignment_keeps_groups(spark):
    got = alignment.linked(table(spark, [(1, "Hello wörld", "en"), (2, None, "en"), (3, "a▁", "en")]), A, B, keep_groups=True).orderBy("doc_id").collect()
    assert hashlib.sha256(got[0].groups.encode()).hexdigest() == got[0].groups_sha256 and got[0].groups.count(";") + 1 == got[0].n_groups
    assert [(r.groups, r.groups_sha256, r.n_a) for r in got[1:]] == [(None, "", 0), (None, "", 0)]


def test_union_find_gives_least_nodes():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (50, 20), (400, 380), (300, 2000)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        near = [{k} for k in range(n)]
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            both = near[a] | near[b]
            for k in both:
                near[k] = both
        assert alignment.union_find(n, u, v).tolist() == [min(x) for x in near]
    chain = np.arange(5000)
    assert not alignment.union_find(5001, chain, chain + 1).any()


def test_alignment_of_nothing(spark, empty):
    assert alignment.digests(empty, A, B).count() == 0


# simhash


def fingerprint(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(WORDS, low)
    s = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_loop(values, near):
    """values: distinct; near(a, b)."""
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(values, 2):
        if near(a, b) and find(a) != find(b):
            root[find(a)] = find(b)
    return {v: find(v) for v in values}


def simhash_by_loop(rows):
    prints = [fingerprint(t) for _, t, *_ in rows]
    root = components_by_loop(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, *_), f in zip(rows, prints, strict=True):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return collections.Counter((i, f"{f:016x}", least.get(root[f])) for (i, *_), f in zip(rows, prints, strict=True))


@pytest.mark.parametrize("section", [simhash.SECTION, 50])
def test_simhash_equals_brute_force(monkeypatch, spark, rows, docs, section):
    monkeypatch.setattr(simhash, "SECTION", section)
    assert collections.Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == simhash_by_loop(rows)


def test_simhash_query(spark, sf_dir, small_docs):
    got = queries.op12_simhash(spark, sf_dir)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert collections.Counter(tuple(r) for r in got.collect()) == simhash_by_loop([tuple(r) for r in small_docs.collect()])


@pytest.mark.parametrize("most", [512, 3, 1])
def test_simhash_links_reach_all(monkeypatch, spark, most):
    """Random fingerprints in clusters of several radii, with short and long lists."""
    monkeypatch.setattr(simhash, "LIST", 512)
    rng = random.Random(most)
    made = {0, (1 << 64) - 1, 3, 7, 15}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(30):
            made.add(x)
            y = x
            for _ in range(rng.randint(0, 4)):
                y ^= 1 << rng.randrange(64)
            made.add(y)
            x = y if rng.random() < 0.2 else x
    signed = lambda v: v - (v >> 63 << 64)
    links = simhash.links(spark.createDataFrame([(signed(v),) for v in made], "fp long"), most).collect()
    for r in links:
        assert ((r.p ^ r.x) & ((1 << 64) - 1)) and {r.p, r.x} <= {signed(v) for v in made}
    want = components_by_loop(sorted(made), lambda a, b: (a ^ b).bit_count() <= 2)
    group = lambda root: sorted(tuple(sorted(signed(k) for k in root if root[k] == v)) for v in set(root.values()))
    got = {v: v for v in made}
    for r in links:
        a, b = (got[v & ((1 << 64) - 1)] for v in (r.p, r.x))
        got = {k: b if v == a else v for k, v in got.items()}
    assert group(got) == group(want)


def test_simhash_of_nothing(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0


# filter audit


def masks_by_loop(rows):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(WORDS, t)
        n = least.get(t)
        fails = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), n is not None and (i is None or i > n))
        out.append((i, lang or "", {c for c, f in zip("ABCDE", fails, strict=True) if f}))
    return out


def audit_by_loop(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    masks, out = masks_by_loop(rows), []
    for part in {p for _, p, _ in masks}:
        mine = [(i, m) for i, p, m in masks if p == part]
        steps, shapley = [], collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for k, c in enumerate(order):
                removed = [(i, m) for i, m in left if c in m]
                left = [(i, m) for i, m in left if c not in m]
                failing = sum(c in m for _, m in mine)
                shapley[c] += len(removed)
                steps.append((order, k + 1, len(left), len(removed), failing - len(removed), sum(m == {c} for _, m in mine), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)))
        out += [(part, *s, shapley[s[0][s[1] - 1]]) for s in steps]
    return sorted(out)


LABELS = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 120, 3)] + [(3, 0, 1), (30, None, None), (None, 1, 1), (500, 1, 1)]


def test_audit_equals_a_loop(spark, rows, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    good = [r for r in LABELS if r[0] is not None]
    assert sorted(tuple(r) for r in filter_audit.audit(docs, labels).collect()) == audit_by_loop(rows, good)


def test_audit_query_against_sql(spark, sf_dir):
    got, want = rows_of_spark(queries.op13_filter_audit(spark, sf_dir)), rows_of_duckdb(connect(sf_dir), filter_audit.SQL)
    assert got == want


@pytest.mark.parametrize("digest", [F.xxhash64, lambda c: F.lit(0).cast("long"), lambda c: F.length(c).cast("long") % 2])
def test_duplicates_with_strong_and_weak_hashes(monkeypatch, spark, rows, docs, digest):
    """Where hashes can't tell texts apart their full texts do; where the first block can't, later ones do."""
    monkeypatch.setattr(filter_audit, "BLOCK", 16)
    got = collections.Counter(r.doc_id for r in filter_audit.duplicates(docs, digest=digest).collect())
    assert got == collections.Counter(i for i, _, m in masks_by_loop(rows) if "E" in m)


def test_hot_classes_are_split_off(monkeypatch, spark, rows, docs):
    monkeypatch.setattr(filter_audit, "MANY_ROWS", 3)
    monkeypatch.setattr(simhash, "MANY_COPIES", 3)
    assert collections.Counter(r.doc_id for r in filter_audit.duplicates(docs).collect()) == collections.Counter(i for i, _, m in masks_by_loop(rows) if "E" in m)
    assert collections.Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == simhash_by_loop(rows)


def test_audit_of_nothing(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, labels).count() == 0
