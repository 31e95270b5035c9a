"""Each operator on a small table with nulls, empty, long and repeated texts, ties, and columns of clashing names."""

import collections
import copy
import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from plumbline.llm import bbpe, langid, lm, media, mixing, ngram_join, quality, records, sharding, toxicity  # noqa: E402

BPE, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, size string, node int, score string, taken int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, 2, "x", 3, "y", 4) for i, t, lang, s in rows], SCHEMA)


def word(rng):
    return "".join(rng.choice(("th", "an", "er", "in", "on", "at")) for _ in range(rng.randint(1, 3)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = [(0, None, "en", "a"), (1, "", "en", None), (2, " \n\t ", None, "a"), (3, "one two", "en", "b"), (3, "one two", "en", "b"), (None, "one two", "en", "c"), (4, "1 2 3 ###", "en", None), (5, "The É ß 日本 \U0001f389 x\x00y", "de", "a")]
    for k in range(6, 40):
        lines = [" ".join(word(rng) for _ in range(rng.randint(3, 12))).capitalize() + "." for _ in range(rng.randint(1, 6))]
        out.append((k, "\n".join(lines), rng.choice(("en", "de", None)), rng.choice("abc")))
    base = " ".join(word(rng) for _ in range(120)).split(" ")
    for k in range(40, 60):
        other = list(base)
        other[rng.randrange(120)] = f"w{k % 5}"
        out.append((k, " ".join(other), "en", "hot"))
    out += [(k, " ".join(base), "en", "hot") for k in range(60, 75)]
    out.append((75, " ".join(word(rng) for _ in range(30_000)), "en", "a"))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(rows):
    return {i: t or "" for i, t, *_ in rows}


# ---- quality ----


def base_statistics(t):
    w = re.findall("[^\x20\x09-\x0d]+", t)
    at = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if at[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)


def test_statistics_equal_a_loop(spark):
    rng = random.Random(4)
    cases = ["", "a", "a b c d e", "a b c d e a b c d e", "x x x x x x x", "l\nl\n\nl \n", "# $ <a>|", "\x0b\x0c a\x1cb"]
    cases += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) + rng.choice(("", "\n", " ")) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string")
    got = {r.doc_id: r for r in quality.statistics(df).collect()}
    for k, t in enumerate(cases):
        want = base_statistics(t)
        assert tuple(got[k][c] for c in quality.BASE) == want, t
        assert got[k].base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_rules_are_found_and_keep_the_rest(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(900):
        bad = k % 5 == 0
        w = [f"w{rng.randint(0, 10**6)}" + ("#" if bad and rng.random() < 0.8 else "") for _ in range(40)]
        rows.append((k, " ".join(w)))
        labels.append((k, 0 if bad else 1))
    labels += [(None, 0), (10**6, 0), (1, None)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(docs, known).collect()}
    assert len(got) == 900 and all(got[k].kept == (k % 5 != 0) for k in range(900))
    assert not any("Python" in x for x in [quality.judge(docs, known)._jdf.queryExecution().executedPlan().toString()])
    assert quality.judge(docs, known.filter("false")).filter("kept").count() == 900


def test_quality_edge_cases(spark, docs, rows, empty):
    labels = spark.createDataFrame([(6, 1), (7, 0), (6, 0)], "doc_id long, quality int")
    out = quality.judge(docs, labels)
    assert out.count() == len(rows) and out.filter("doc_id = 0").first().base_failed
    assert quality.judge(empty.select("doc_id", "text"), labels).count() == 0


# ---- media ----


def test_media_round_trip(spark, docs, rows, empty):
    folder = media.write_archives(docs)
    got = media.digests(media.members(spark, folder, range_bytes=2000)).collect()
    assert sorted((r.doc_id is not None, r.doc_id) for r in got) == sorted((i is not None, i) for i, *_ in rows)
    t = texts(rows)
    for r in got:
        data = t[r.doc_id].encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert len({r.media_sha256 for r in got if t[r.doc_id] == "one two"}) == 1
    assert media.members(spark, media.write_archives(empty)).count() == 0


def test_member_is_retried_alone_by_offset(tmp_path):
    path = tmp_path / "a"
    path.write_bytes(b"xxhello")
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("gone")
        return path.open("rb")

    assert media.read_at(flaky, 2, 5, zlib.crc32(b"hello"), attempts=3, wait=0) == (b"hello", None)
    data, error = media.read_at(lambda: path.open("rb"), 2, 5, 1, attempts=2, wait=0)
    assert data is None and "checksum" in error


def test_damaged_member_leaves_the_others(spark, docs, tmp_path):
    folder = media.write_archives(docs.filter("doc_id in (6, 7, 8)").coalesce(1))
    (name, size) = open(f"{folder.removeprefix('file://')}/list").read().split()
    path = f"{folder.removeprefix('file://')}/archives/{name}"
    entries = media.directory(lambda: open(path, "rb"), int(size))
    with open(path, "r+b") as f:
        f.seek(entries[1][3] + 40)
        f.write(b"\x00\x01\x02\x03")
    got = media.members(spark, folder).collect()
    assert len(got) == 3 and sum(r.error is not None for r in got) == 1 and sum(r.media is not None for r in got) == 2


def test_png_is_lossless():
    for n in (1, 2, 7):
        payload = bytes(random.Random(n).randrange(256) for _ in range(192 * n))
        assert media.decode(media.encode(payload)) == payload
    with pytest.raises(ValueError, match="PNG"):
        media.decode(b"no")


# ---- toxicity ----


def test_toxicity_finds_words_and_ignores_groups(spark, docs, rows, empty):
    rng = random.Random(1)
    made = []
    for k in range(1200):
        w = [word(rng) + str(rng.randint(0, 30)) for _ in range(30)]
        toxic = k % 4 == 0
        if toxic:
            w[rng.randrange(30)] = rng.choice(("vilex", "nastyx", "foulx"))
        if rng.random() < (0.6 if toxic else 0.1):  # the group is named more often in toxic texts
            w[rng.randrange(30)] = "muslims"
        made.append((k, " ".join(w), int(toxic)))
    frame = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    labels = frame.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    model = toxicity.learn(frame, labels)
    scores = model.scores([m[1] for m in made])
    right = sum((s >= 0.5) == bool(m[2]) for s, m in zip(scores, made, strict=True))
    assert right / len(made) > 0.97
    plain = " ".join(word(rng) for _ in range(20))
    a, b = model.scores([plain, plain + " muslims"])
    assert abs(a - b) < 0.1
    unfair = toxicity.learn(frame, labels, fair=0.0)
    c, d = unfair.scores([plain, plain + " muslims"])
    assert abs(a - b) < abs(c - d)
    out = toxicity.score(docs, model)
    assert out.count() == len(rows) and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(empty, model).count() == 0
    one = toxicity.learn(frame, labels.filter("toxic = 1"))
    assert not one.trained and one.scores(["x"]).tolist() == [0.0]


def test_identity_terms_are_runs_of_letters_in_texts_of_any_length():
    names = toxicity.terms()[0]
    texts = ["Muslims, (women) womenfolk", "no term", None, "x " * (1 << 19) + "Jüdisch.", "man-woman"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([1, 0, 0, 1, 0], pa.int32())], names=["text", "toxic"])
    (got,) = toxicity._rows(iter([batch]), np.ones(toxicity.TABLE, bool))
    assert [{names[s["term"]] for s in x} for x in got.column("swaps").to_pylist()] == [{"muslims", "women"}, set(), set(), {"jüdisch"}, {"man", "woman"}]


def letters(t):
    """The lower-case runs of letters and marks."""
    return ["".join(g) for is_in, g in itertools.groupby(t.lower(), lambda c: unicodedata.category(c)[0] in "LM") if is_in]


def loop_features(t):
    """Hashed words and beginnings, one number at a time."""
    out, mask = set(), (1 << 64) - 1
    for w in letters(t):
        for k in (0, *[k for k in toxicity.PREFIXES if k < len(w)]):
            h = sum((ord(c) + 1) * pow(0xD6E8FEB86659FD93, i, 1 << 64) for i, c in enumerate(w[:k] if k else w)) + k & mask
            h = (h ^ h >> 31) * 0x9FB21C651E98DF25 & mask
            out.add((h ^ h >> 29) % toxicity.TABLE)
    return out


def test_swaps_are_those_of_the_swapped_text():
    texts = [
        "Muslims meet muslim men, and Christians; (Muslims) stay. Women and woman walk.",
        "muslims",
        "An old man and old friends oldest of all",
        "whitest white whites, black-white",
        "no term",
        "Jüdisch und jüdischer Witz, jüdisch",
    ]
    names = toxicity.terms()[0]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([1, 0, 0, 1, 0, 1], pa.int32())], names=["text", "toxic"])
    (got,) = toxicity._rows(iter([batch]), np.ones(toxicity.TABLE, bool))
    made = 0
    for text, n, features, swaps in zip(texts, *(got.column(c).to_pylist() for c in ("n", "features", "swaps")), strict=True):
        old = letters(text)
        assert (n, set(features)) == (len(old), loop_features(text))
        assert sorted({names[s["term"]] for s in swaps}) == sorted(set(old) & set(names)) and len(swaps) == 2 * len(set(old) & set(names))
        for s in swaps:
            new = [names[s["to"]] if w == names[s["term"]] and s["to"] is not None else w for w in old if w != names[s["term"]] or s["to"] is not None]
            a, b = loop_features(text), loop_features(" ".join(new))
            assert (set(s["gone"]), set(s["come"]), s["words"]) == (a - b, b - a, len(old) - len(new))
            made += 1
    assert made >= 14


def test_toxicity_scores_equal_a_loop(spark, docs, rows):
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(0, 0.2, toxicity.TABLE) * (rng.random(toxicity.TABLE) < 0.3), -0.1, 0.2, True)
    few = [r for r in rows if len(r[1] or "") < 10_000]
    got = toxicity.score(docs.filter("text is null or length(text) < 10000"), model).collect()
    want = []
    for i, text, *_ in few:
        z = 0.2 - 0.1 * math.log1p(len(letters(text or ""))) + sum(model.weights[f] for f in loop_features(text or ""))
        want.append((i if i is not None else -1, 1 / (1 + math.exp(-z))))
    key = lambda r: (r[0], r[1])
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.score) for r in got), key=key)
    assert len(got) == len(want) and all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 for a, b in zip(got, sorted(want, key=key), strict=True))


def test_toxicity_learns_an_id_once(spark):
    made = [(k, f"plain words number {k}", 0) for k in range(20)] + [(100 + k, f"vilex words number {k}", 1) for k in range(20)]
    frame = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    labels = frame.select("doc_id", "toxic")
    once, often = toxicity.learn(frame, labels), toxicity.learn(frame.union(frame.filter("doc_id = 3")).union(frame), labels)
    assert once.trained and np.allclose(once.weights, often.weights, atol=1e-6) and once.scores(["vilex"])[0] > once.scores(["plain"])[0]


# ---- mixing ----


def loop_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, capped, total = {}, set(), sum(sizes.values())
    while True:
        rest, w = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / w for s in names}
        more = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not more:
            return target
        capped |= more


def test_mix(spark, docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size, src = collections.Counter(), {(i, t): s for i, t, _, s in rows}
    for i, t, _, s in rows:
        size[s] += len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    want = loop_targets(size)
    by = {i: s for i, _, _, s in rows}
    taken, most = collections.Counter(), collections.Counter()
    for r in got:
        s = by[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s])
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[s] += r.taken
        most[s] = max(most[s], r.size)
    assert all(abs(taken[s] - want[s]) <= most[s] / 2 + 1 for s in size)
    assert src and sorted(map(tuple, mixing.mix(docs.repartition(7)).select("doc_id", "taken").collect()), key=str) == sorted(((r.doc_id, r.taken) for r in got), key=str)
    assert mixing.mix(empty).count() == 0
    names = docs.columns
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == names
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    want_copies = collections.Counter()
    for r in got:
        want_copies[r.doc_id] += r.taken // r.size if r.size else 0
    assert copies == +want_copies


def by_sql(sql, rows):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[3] for r in rows], pa.string())}))
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return [dict(zip(names, r, strict=True)) for r in found.fetchall()]


@pytest.mark.parametrize("seed", range(4))
def test_mix_of_repeated_rows_equals_the_sql(spark, seed):
    rng = random.Random(seed)
    rows = [(7, " ".join(["w"] * 30), "en", "a")] * 100 + [(8, " ".join(["w"] * 10), "en", "b")] * 300
    rows += [(rng.randrange(40), " ".join(["w"] * rng.choice((0, 1, 5, 9))), "en", rng.choice(("a", "b", "c", None))) for _ in range(200)]
    rows += [(None, "w w w", "en", rng.choice(("a", "c"))) for _ in range(50)]
    rng.shuffle(rows)
    docs = table(spark, rows).repartition(5)
    got = [(r.doc_id, r.size, r.source_size, r.taken) for r in mixing.mix(docs).collect()]
    want = [(r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in by_sql(mixing.SQL, rows)]
    assert sorted(got, key=str) == sorted(want, key=str)
    words = collections.Counter()
    for r in mixing.mixed_rows(docs).select("doc_id", "text").collect():
        words[r.doc_id] += len(r.text.split())
    taken = collections.Counter()
    for i, _, _, t in got:
        taken[i] += t
    assert +words == +taken


def test_one_repeated_row_meets_its_target(spark):
    rows = [(7, " ".join(["w"] * 30), "en", "a")] * 100 + [(k, " ".join(["v"] * 30), "en", "b") for k in range(10, 30)]
    got = mixing.mix(table(spark, rows)).filter("doc_id = 7").agg(F.sum("taken"), F.max("target")).first()
    assert abs(got[0] - got[1]) <= 15


@pytest.mark.parametrize("seed", range(8))
def test_targets_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice((0, 1, 5, 100, 10_000)) for s in ["a", "B", "é", "z", None][: rng.randint(1, 5)]}
    if not sum(sizes.values()):
        sizes["a"] = 3
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(loop_targets(sizes))


# ---- byte BPE ----


def test_bpe_equals_the_library(spark, docs, rows, empty):
    tiktoken = pytest.importorskip("tiktoken")
    t = bbpe.tokenizer(BPE, P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=t.ranks, special_tokens={})
    rng = random.Random(6)
    alphabet = list(" \n\t abcé'st!1日\x1c \xa0\U0001f389")
    for _ in range(1500):
        x = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert t.encode(x) == own.encode_ordinary(x) and t.decode(t.encode(x)) == x.encode()
    long = "ab" * 20_000
    assert t.decode(t.encode(long)) == long.encode()
    want = texts(rows)
    got = bbpe.digests(docs, BPE, P.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = own.encode_ordinary(want[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(want[r.doc_id].encode()).hexdigest())
    ids = bbpe.encoded(docs, BPE, P.PATTERN)
    assert all(r.data.decode() == want[r.doc_id] for r in bbpe.decoded(ids, BPE, P.PATTERN).collect())
    assert bbpe.digests(empty, BPE, P.PATTERN).count() == 0


def test_hash_is_perfect_and_minimal():
    keys = [f"k{i}".encode() for i in range(3001)]
    h = bbpe.PerfectHash(keys)
    assert sorted(map(h.slot, keys)) == list(range(3001))
    t = bbpe.tokenizer(BPE, P.PATTERN)
    assert all(t.whole(k) == i for k, i in itertools.islice(t.ranks.items(), 0, None, 97)) and t.whole(b"zzqqzzqq") == -1


# ---- language ID ----


@pytest.mark.parametrize(("states", "paths"), [(3, 1 << 24), (3, 20), (300, 1 << 24), (300, 1 << 17)])
def test_viterbi_is_exact(monkeypatch, states, paths):
    monkeypatch.setattr(langid, "PATHS", paths)
    rng = np.random.default_rng(2)
    for sizes in ([1], [1, 2, 3], [31, 32, 33], [100, 1, 64, 65]):
        ends = np.cumsum(sizes)
        s = rng.normal(size=(ends[-1], states)) * 4
        s[:, -1] += 30  # the last state is the best one
        assert set(langid.viterbi(s, ends).tolist()) == {states - 1}
        s[:, -1] -= 30
        labels = langid.viterbi(s, ends)
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            v = s[a]
            for t in range(a + 1, b):
                v = np.maximum(v, v.max() - langid.SWITCH) + s[t]
            mine = s[np.arange(a, b), labels[a:b]].sum() - langid.SWITCH * (np.diff(labels[a:b]) != 0).sum()
            assert mine == pytest.approx(v.max(), abs=1e-2)


def test_equal_rows_are_spread_over_shards(spark):
    rows = spark.range(7_999).select(F.when(F.col("id") < 4_000, 0).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 4_000, "the same").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    sizes = [r["count"] for r in lm.deal(rows, 12).groupBy("shard").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 1.3 * min(sizes)


def test_copies_are_summed_in_rounds(monkeypatch, spark):
    from plumbline.llm.common import stored

    monkeypatch.setattr(lm, "SUMMED", 3)
    rng = np.random.default_rng(1)
    for many in (0, 1, 3, 29):
        rows = [(k, int(rng.integers(1, 9)), rng.normal(size=5)) for k in range(many)]
        copies = stored(spark.createDataFrame([(k, n, w.tobytes()) for k, n, w in rows], lm.COPIES), "t")
        n, weights = lm.summed(copies)
        assert n == sum(r[1] for r in rows)
        assert weights is None if not many else np.allclose(weights, sum(r[2] for r in rows))


def test_language_spans(spark, docs, rows, empty):
    english = "the quick brown fox jumps over the lazy dog and then they went with that thing"
    german = "der schnelle braune fuchs springt über den faulen hund und dann gingen sie nicht"
    russian = "быстрая коричневая лиса прыгает через ленивую собаку"
    made = [(k, " ".join(random.Random(k).sample(x.split(), 7)), lang, "s") for k, (x, lang) in enumerate([(english, "en"), (german, "de"), (russian, "ru")] * 40)] + [(500, "x", None, "s")]
    model = langid.learn(table(spark, made))
    assert model.languages == ["de", "en", "ru"]
    lang, score, spans = langid.label(model, [english, german, russian, "", "12 34", english + " " + german, "日本語"], spans=True)
    assert lang[:5] == ["en", "de", "ru", "und", "und"] and score[3:5] == [0.0, 0.0] and lang[6] != "und"
    assert [x["lang"] for x in spans[5]] == ["en", "de"]
    out = langid.predict(docs, model, spans=True)
    assert out.count() == len(rows) and out.columns == [*(c for c in docs.columns if c != "score"), "lang_pred", "score", "spans"]
    assert {r.lang_pred for r in out.filter("doc_id in (0, 1, 2, 4)").collect()} == {"und"}
    none = langid.learn(empty)
    assert langid.label(none, ["abc"])[0] == ["und"] and langid.predict(empty, model).count() == 0


# ---- sharding ----


def test_languages_of_repeated_ids(spark):
    rng = random.Random(3)
    one = [(1, "the cat and the dog", "en", "a")] * 300 + [(1, "der hund und die katze", "de", "a")] * 300
    one += [(k, " ".join(rng.choice(("the", "and", "cat")) for _ in range(9)), "en", "a") for k in range(2, 30)]
    model = langid.learn(table(spark, one).select("doc_id", "text", "lang"))
    assert model.languages == ["de", "en"]
    found = langid.predict(table(spark, one).select("doc_id", "text"), model).select("text", "lang_pred").distinct().collect()
    assert all(r.lang_pred == ("de" if "hund" in r.text else "en") for r in found)


def test_lower_case_of_one_character_leaves_the_rest():
    words = langid.Words(["\u0130THE CAT"])
    assert bytes(words.cp[1:4].astype(np.uint8)) == b"the" and words.ends[0] == 9


def test_shards(spark, docs, rows, empty):
    got = sharding.shard(docs).collect()
    assert len(got) == len(rows) and sharding.shard(empty).count() == 0
    t = texts(rows)
    by = collections.defaultdict(list)
    for r in got:
        assert r.size == len(t[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(t[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None
        by[r.shard].append(r.slot)
    assert set(by) <= set(range(16)) and all(sorted(x) == list(range(len(x))) for x in by.values())


def test_shards_are_even_and_keep_groups(spark):
    rng = random.Random(2)
    rows = [(k, "".join(rng.choice("ab") for _ in range(rng.randint(20, 400)))) for k in range(3000)]
    rows += [(3000 + k, f"group {k // 20} " * 8) for k in range(400)] + [(4000 + k, "hot " * 30) for k in range(1700)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    sizes = collections.Counter()
    groups = collections.defaultdict(set)
    for r in got:
        sizes[r.shard] += r.size
        groups[dict(rows)[r.doc_id]].add(r.shard)
    assert max(sizes.values()) < 1.01 * min(sizes.values())
    assert sum(len(v) > 1 for k, v in groups.items() if k.startswith("group")) <= 2


# ---- records ----


def test_linked_shards_are_even(spark):
    """Pairs of equal texts alone: no document without links can level the shards."""
    rows = [(2 * k + j, f"{k} " + "x" * (20 + 37 * k % 211)) for k in range(400) for j in range(2)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes, at = collections.Counter(), collections.defaultdict(set)
    for r in got:
        sizes[r.shard] += r.size
        at[r.doc_id // 2].add(r.shard)
    even = sum(sizes.values()) / 16
    assert len(got) == 800 and all(abs(sizes[k] - even) <= 0.01 * even for k in range(16)), sizes
    assert sum(len(x) == 1 for x in at.values()) > 300


def test_crc32c():
    assert records.crc32c(b"123456789") == 0xE3069283
    rng = np.random.default_rng(3)
    sizes = [0, 1, 2, 3, 255, 256, 257, 513, 1, 4000]
    ends = np.cumsum(sizes)
    ids = rng.integers(0, 65536, ends[-1]).astype(np.uint16)
    assert records.crc32c_many(ids, ends) == [records.crc32c(ids[e - n : e].tobytes()) for n, e in zip(sizes, ends, strict=True)]


def test_records_round_trip(spark, docs, rows, empty):
    tokenizers = pytest.importorskip("tokenizers")
    tk = tokenizers.Tokenizer.from_file(WORDS)
    folder = records.write_records(docs, WORDS, parts=3)
    got = records.read_back(spark, folder).collect()
    t = texts(rows)
    want = sorted(((i is not None, i or 0, len(ids := [*tk.encode(t[i], add_special_tokens=False).ids, 1]), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, *_ in rows))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, *sorted(i for i, *_ in rows if i is not None)]
    assert records.read_back(spark, records.write_records(empty, WORDS)).count() == 0
    name = spark.read.parquet(f"{folder}/committed").filter("records > 2").first().file
    a, b = records.read_records(folder, name, [2, 0])
    assert a[-1] == 1 and b[-1] == 1
    path = f"{folder.removeprefix('file://')}/files/{name}.rec"
    with open(path, "r+b") as f:
        f.seek(12)
        f.write(b"\xff\xff")
    with pytest.raises(ValueError, match="damaged"):
        records.read_records(folder, name, [0])


def test_words_encode_as_the_whole_text():
    w = records.WordIds(WORDS)
    rng = random.Random(2)
    alphabet = list("  ab'sé.,!1ßÀÿ÷×日µªİſΣσ́ı\x1c\xa0\x00\x7f<|>")
    cases = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["<|endoftext|> x", "don't 'S i'LL", "Straße Ünï"]
    for x, e in zip(cases, w.tokenizer.encode_batch(cases, add_special_tokens=False), strict=True):
        assert np.frombuffer(w.encode([x])[0], w.kind).tolist() == e.ids, x


def test_special_tokens_encode_as_in_the_library():
    from tokenizers import Tokenizer

    w, library = records.WordIds(WORDS), Tokenizer.from_file(WORDS)
    rng = random.Random(4)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", " ", "\n", "Ab", "é", "日", "\x00", "\u0301", "1"]
    cases = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(2000)]
    for x, e in zip(cases, library.encode_batch(cases, add_special_tokens=False), strict=True):
        assert np.frombuffer(w.encode([x])[0], w.kind).tolist() == e.ids, x
    assert np.frombuffer(w.encode(["a<|endoftext|>b"])[0], w.kind).tolist()[1] == 49407


# ---- Jaccard join ----


def brute_components(rows, n, percent):
    """(sizes, components) by comparing all pairs of a few rows."""
    sets = []
    for _, t, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        sets.append({tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        o = len(sets[a] & sets[b])
        if o and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
            root[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        r = find(k)
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    return [(i, len(sets[k]), least[find(k)] if sets[k] else i) for k, (i, *_) in enumerate(rows)]


def test_join_equals_the_sql(spark, rows):
    whole = [r for r in rows if r[0] is not None and r[0] not in (3, 75)]
    got = ngram_join.Join(table(spark, whole), n=4, percent=85).run().select("doc_id", "n_shingles", "component_id").collect()
    want = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in by_sql(ngram_join.SQL, whole)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_join_edge_cases(spark, docs, rows, empty):
    got = ngram_join.Join(docs, n=4, percent=85).run()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()))) == sorted(map(str, brute_components(rows, 4, 85)))
    assert ngram_join.Join(empty).run().count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_join_random_near_copies(spark, seed):
    """Clusters whose similarities lie on both sides of the threshold, with shared passages."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(25)]
    rows = []
    for c in range(12):
        base = [f"c{c}w{rng.randint(0, 60)}" for _ in range(rng.randint(20, 60))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3))):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 3)}"
            if rng.random() < 0.5:
                at = rng.randrange(len(w))
                w[at:at] = passage[: rng.randint(4, 25)]
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, " ".join(passage)) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.Join(df, n=3, percent=70).run()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(brute_components(rows, 3, 70))


def test_join_of_truncated_copies(spark):
    """Chains of copies cut short: each links to the next, which needn't link to the pivot it lies in."""
    rows = []
    for c in range(40):
        for size in (100, 88, 78) if c % 2 else (100, 88, 78, 69, 61):
            rows.append((len(rows), " ".join(f"c{c}w{k}" for k in range(size + 3))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.Join(df, n=4, percent=85).run()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(brute_components(rows, 4, 85))


@pytest.mark.parametrize("few", [1, 6])
def test_join_of_large_groups(spark, monkeypatch, few):
    """Groups of copies by exchanged, dropped, added and cut words, longer than lists that are paired as they are."""
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "HOT", 20)
    monkeypatch.setattr(ngram_join, "MEMBERS", 7)
    rng, rows = random.Random(few), []
    for c in range(6):
        base = [f"c{c}w{k}" for k in range(rng.choice((30, 60, 90)))]
        for _ in range(70):
            w = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3, 4, 5))):
                at, kind = rng.randrange(len(w)), rng.choice(("x", "drop", "add", "cut") if c % 2 else ("x",))
                w[at : at + (kind != "add")] = [] if kind in ("drop", "cut") else [f"x{rng.randint(0, 500)}"]
                w = w[: -rng.randint(1, 4)] if kind == "cut" else w
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.Join(df, n=4, percent=85).run()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(brute_components(rows, 4, 85))


@pytest.mark.parametrize("part", [1_000_000, 7])
def test_components(spark, part):
    rng = random.Random(part)
    edges = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)]
    edges = [e for e in edges if e[0] != e[1]]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = ngram_join.components(spark.createDataFrame(edges, "p long, x long").repartition(5), part=part)
    assert {r._v: r.root for r in got.collect()} == {x: find(x) for x in root if find(x) != x}


def test_one_of_each_keeps_the_least(spark, docs, rows):
    left = ngram_join.one_of_each(docs, n=4, percent=85)
    want = {i for i, _, c in brute_components(rows, 4, 85) if i == c}
    assert {r.doc_id for r in left.collect()} == want and left.columns == docs.columns
    assert left.filter("doc_id = 3").count() == 1


def test_one_of_each_tells_rows_of_one_id_apart(spark):
    """A row goes for its own text, not for its id; repeated rows and null ids are treated alike."""
    u, v, z = (" ".join(f"{c}{k}" for k in range(20)) for c in "uvz")
    rows = [(1, u), (5, u), (5, z), (5, z), (7, ""), (7, ""), (8, None), (None, v), (None, v), (None, u)]
    left = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted((tuple(r) for r in left.collect()), key=key) == sorted([(1, u), (5, z), (7, ""), (7, ""), (8, None), (None, v)], key=key)


def test_sets_equal_words():
    rng = random.Random(3)
    cases = ["".join(rng.choice(" \n\x0b\x1cABcé") for _ in range(rng.randint(0, 25))) for _ in range(300)]
    for t, s in zip(cases, ngram_join.shingle_sets([t.encode() for t in cases], 2), strict=True):
        w = t.encode().lower().split()
        assert len(s) == len({tuple(w)} if len(w) == 1 else {tuple(w[k : k + 2]) for k in range(len(w) - 1)})
        assert (ngram_join.unpack(ngram_join.pack(s)) == s >> np.uint64(8) << np.uint64(8)).all()


# ---- language model ----


def test_base_scores_equal_a_loop(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 40)
    monkeypatch.setattr(lm, "CLOSED", 20)
    train = docs.filter("doc_id is null or doc_id % 7 <> 2").select("doc_id", "text")
    model, counts = lm.learn(train)
    c = collections.Counter()
    for i, t, *_ in rows:
        if i is None or i % 7 != 2:
            c.update([*(t or "").encode().lower().split(), b"\n"])
    n, v = sum(c.values()), len(c)
    want = []
    for i, t, *_ in rows:
        w = [*(t or "").encode().lower().split(), b"\n"]
        want.append((str(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)))
    got = lm.score(docs, model, counts).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == sorted(want)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score(empty, model, counts).count() == 0
    nothing, none = lm.learn(empty)
    assert all(r.n_known == 0 and r.base_score == 0 and np.isfinite(r.score) for r in lm.score(docs.limit(5), nothing, none).collect())


def test_network_gradients():
    net = lm.Network(np.array([5.0, 9, 3, 2, 1, 1]), units=4, classes=3, seed=1)
    rng = np.random.default_rng(0)
    h, y = rng.normal(size=(7, 4)).astype(np.float32), rng.integers(0, 6, 7)
    g = {k: np.zeros_like(v) for k, v in net.p.items()}
    _, dh = net.log_probs(h, y, g)
    for name in ("C", "O", "cb"):
        at = tuple(0 for _ in net.p[name].shape)
        loss = []
        for e in (1e-2, -1e-2):
            net.p[name][at] += e
            loss.append(-net.log_probs(h, y)[0].sum())
            net.p[name][at] -= e
        assert g[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-2, abs=2e-2)
    up, down = h.copy(), h.copy()
    up[0, 0] += 1e-2
    down[0, 0] -= 1e-2
    assert dh[0, 0] == pytest.approx(-(net.log_probs(up, y)[0].sum() - net.log_probs(down, y)[0].sum()) / 2e-2, abs=2e-2)


def test_network_is_a_distribution_and_carries_its_state():
    counts = np.array([3.0, 50, 40, 30, 20, 10, 5, 5])
    net = lm.Network(counts, units=8, classes=3)
    h = np.random.default_rng(1).normal(size=(1, 8)).astype(np.float32)
    total = sum(np.exp(net.log_probs(h, np.array([w]))[0][0]) for w in range(8))
    assert total == pytest.approx(1, abs=1e-4)
    rng = np.random.default_rng(2)
    docs = [np.concatenate((np.tile([2, 3, 4], rng.integers(3, 30)), [1])) for _ in range(60)]
    before = net.score(docs, end=1)
    net.train(docs, end=1, epochs=20)
    after = net.score(docs, end=1)
    assert after.sum() > 0.5 * before.sum()
    alone = np.array([net.score([d], end=1)[0] for d in docs])
    assert np.allclose(alone, after, atol=1e-2)


def test_network_scores_equal_a_loop():
    """A plain loop over words with the gates, the state and the two softmaxes written out."""
    net = lm.Network(np.array([5.0, 9, 3, 2, 1, 1, 1]), units=3, classes=3, seed=4)
    rng = np.random.default_rng(3)
    for k in ("W", "U", "E", "C", "O"):
        net.p[k] = (rng.normal(size=net.p[k].shape) * 0.7).astype(np.float32)
    docs = [np.append(rng.integers(2, 7, k), 1).astype(np.int32) for k in (0, 1, 5, 40, 3, 0)]
    p = {k: v.astype(float) for k, v in net.p.items()}

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    want = []
    for d in docs:
        h, x, total = np.zeros(3), 1, 0.0
        for y in d:
            e = p["E"][x]
            r, z = (sigmoid(e @ p["W"][k] + p["b"][k, 0] + h @ p["U"][k]) for k in (0, 1))
            c = np.tanh(e @ p["W"][2] + p["b"][2, 0] + r * (h @ p["U"][2]))
            h = z * h + (1 - z) * c
            cls, pos = divmod(int(net.place[y]), net.per)
            a, b = h @ p["C"] + p["cb"], h @ p["O"][cls] + p["ob"][cls]
            total += a[cls] - np.log(np.exp(a).sum())
            if cls:
                total += b[pos] - np.log(np.exp(b).sum())
            x = y
        want.append(total)
    assert np.allclose(net.score(docs, end=1), want, atol=1e-4)
    assert np.allclose(net.score(docs, end=1, most=1), want, atol=1e-4)


def test_backpropagation_equals_differences(monkeypatch):
    """One window holds both documents, and the first step of the optimizer moves a weight against its gradient's sign."""
    net = lm.Network(np.array([5.0, 9, 3, 2, 1]), units=3, classes=2, seed=4)
    rng = np.random.default_rng(6)
    for k in ("W", "U", "E", "C", "O"):
        net.p[k] = (rng.normal(size=net.p[k].shape) * 0.7).astype(np.float32)
    docs = [np.array([2, 3, 2, 1], np.int32), np.array([4, 2, 3, 4, 2, 1], np.int32)]
    for name in ("W", "U", "E", "b"):
        moved = copy.deepcopy(net)
        moved.train(docs, end=1, epochs=1, most=1, rate=1e-3)
        for at in np.ndindex(net.p[name].shape):
            loss = []
            for e in (1e-2, -1e-2):
                near = copy.deepcopy(net)
                near.p[name][at] += e
                loss.append(-near.score(docs, end=1).sum())
            slope = (loss[0] - loss[1]) / 2e-2
            if abs(slope) > 5e-3:
                assert np.sign(net.p[name][at] - moved.p[name][at]) == np.sign(slope), (name, at, slope)


def test_words_of_odd_texts():
    texts = [None, "", " ", " A  b\x0bC\x1cd\u0085\xc0É\u2003x ", "\t\r\n", "x" * 100_000, "K\u212a İ a", "a a"]
    words, sizes = lm.words_of(pa.array(texts))
    want = [(t or "").encode().lower().split() for t in texts]
    assert [w.encode() for w in words.to_pylist()] == sum(want, []) and sizes.tolist() == [len(w) for w in want]
    assert lm.words_of(pa.array([], pa.string()))[1].tolist() == []
    batch = pa.record_batch([pa.array(range(8)), pa.array(texts)], names=["a", "text"])
    for size in (1, 7, 100_000, 1 << 20):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(lm, "SLICE", size)
            got = list(lm._slices(iter([batch.slice(0, 3), batch.slice(3, 0), batch.slice(3)])))
        assert sum((b.column(1).to_pylist() for b in got), []) == texts and all(b.num_rows for b in got)


def test_network_learns_from_every_document(spark, monkeypatch):
    """Nothing is in the sample that the copies begin with, so what they know comes from the shards."""
    monkeypatch.setattr(lm, "TRAIN_DOCS", 0)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 40_000, raising=False)
    rows = [(k, "a b c d e " * 40) for k in range(395)] + [(395, "a b c d e " * 3_000), (396, None), (None, "a b"), (7, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model, counts = lm.learn(df)
    got = lm.score(spark.createDataFrame(rows[:1], df.schema), model, counts).first()
    assert got.score / got.n_tokens > got.base_score / got.n_tokens + 0.3
    assert model.learned == model.total == sum(len((t or "").split()) + 1 for _, t in rows)


# ---- folds ----


def test_folds(spark):
    df = spark.range(200).select(F.col("id"), toxicity.held_out(F.col("id")).alias("a"), langid.held_out(F.col("id")).alias("b"), lm.held_out(F.col("id")).alias("c"))
    for r in df.collect():
        x = zlib.crc32(str(r.id).encode())
        assert (r.a, r.b, r.c) == (x % 3 == 1, x % 5 == 0, x % 7 == 2)
