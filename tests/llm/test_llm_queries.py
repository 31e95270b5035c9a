"""The registered queries over whole tables: columns, folds and digests against plain loops or the libraries."""

import collections
import hashlib
import math
import re
import struct
import zlib

import pytest

P = pytest.importorskip("public_tokenizers")

from plumbline.llm import queries  # noqa: E402
from plumbline.llm.common import table  # noqa: E402


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    assert len({r.doc_id for r in rows}) == len(rows) > 20
    return {r.doc_id: r.text for r in rows}


def run(name, spark, sf_dir, texts, columns):
    out = queries.QUERIES[name](spark, sf_dir)
    assert out.columns[: len(columns)] == columns
    rows = out.collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(got) and got.keys() == texts.keys()
    return got


def remainder(doc_id, of):
    return zlib.crc32(str(doc_id).encode()) % of


def sha256(data):
    return hashlib.sha256(data).hexdigest()


def test_quality(spark, sf_dir, texts):
    got = run("op1_quality", spark, sf_dir, texts, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        at = collections.Counter(windows)
        again = len({j for k, x in enumerate(windows) if at[x] > 1 for j in range(k, k + 5)})
        lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        failed = len(w) < 10 or 100 * again > 20 * len(w)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), again, failed)
        assert tuple(got[i])[1:7] == want and not (failed and got[i].kept)


def test_media(spark, sf_dir, texts):
    got = run("op2_media", spark, sf_dir, texts, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
    for i, t in texts.items():
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        assert tuple(got[i])[1:5] == (len(raw), len(payload), sha256(payload), zlib.crc32(payload[-16:]))
        assert got[i].media_bytes > 0 and re.fullmatch("[0-9a-f]{64}", got[i].media_sha256)


def test_toxicity(spark, sf_dir, texts):
    got = run("op3_toxicity", spark, sf_dir, texts, ["doc_id", "held_out", "score", "predicted"])
    for i, r in got.items():
        assert r.held_out == (remainder(i, 3) == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_mixing(spark, sf_dir, texts):
    got = run("op4_mixing", spark, sf_dir, texts, ["doc_id", "size", "source_size", "target", "taken"])
    for i, t in texts.items():
        assert got[i].size == len(re.findall("[^\x20\x09-\x0d]+", t or "")) and 0 <= got[i].taken <= 3 * got[i].size


def test_bpe(spark, sf_dir, texts):
    tiktoken = pytest.importorskip("tiktoken")
    from tiktoken.load import load_tiktoken_bpe

    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=load_tiktoken_bpe(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = run("op5_bpe", spark, sf_dir, texts, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    for i, t in texts.items():
        ids = library.encode_ordinary(t or "")
        assert tuple(got[i])[1:4] == (len(ids), sha256(",".join(map(str, ids)).encode()), sha256((t or "").encode()))


def test_languages(spark, sf_dir, texts):
    got = run("op6_langid", spark, sf_dir, texts, ["doc_id", "held_out", "lang_pred", "score"])
    langs = {r.doc_id: r.lang for r in table(spark, sf_dir, "documents").select("doc_id", "lang").collect()}
    learned = {x for i, x in langs.items() if x is not None and remainder(i, 5)}
    right = [r.lang_pred == langs[i] for i, r in got.items() if r.held_out and langs[i] in learned]
    assert sum(right) >= 0.9 * len(right) > 0
    for i, r in got.items():
        assert r.held_out == (remainder(i, 5) == 0) and 0 <= r.score <= 1
        assert r.lang_pred in learned if any(c.isalpha() for c in texts[i] or "") else r.lang_pred == "und"


def test_sharding(spark, sf_dir, texts):
    got = run("op7_sharding", spark, sf_dir, texts, ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"])
    slots, sizes = collections.defaultdict(list), collections.Counter()
    for i, t in texts.items():
        raw = (t or "").encode()
        r = got[i]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1 if t is not None else 1, zlib.crc32(raw) if t is not None else r.text_crc32, "bytes", None)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert slots.keys() <= set(range(16)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= max(r.size for r in got.values())


def test_records(spark, sf_dir, texts):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = run("op8_records", spark, sf_dir, texts, ["doc_id", "start", "n_tokens", "ids_crc32"])
    start = 0
    for i in sorted(texts):
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        assert tuple(got[i])[1:4] == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_jaccard(spark, sf_dir, texts):
    got = run("op9_jaccard", spark, sf_dir, texts, ["doc_id", "n_shingles", "component_id"])
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(texts)
    for k, a in enumerate(order):
        for b in order[:k]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 85 * (len(sets[a]) + len(sets[b]) - same):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {i: tuple(r)[1:3] for i, r in got.items()} == {i: (len(sets[i]), find(i)) for i in texts}


def test_language_model(spark, sf_dir, texts):
    got = run("op10_lm", spark, sf_dir, texts, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    tokens = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in texts.items()}
    c = collections.Counter(x for i, w in tokens.items() if remainder(i, 7) != 2 for x in w)
    n, v = sum(c.values()), len(c)
    for i, w in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(i, 7) == 2, len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 * len(w) + 1e-6
        assert math.isfinite(r.score) and r.score < 0


def test_each_operator_has_a_query():
    assert {int(re.match(r"op(\d+)_", q).group(1)) for q in queries.QUERIES} == set(range(1, 14))
