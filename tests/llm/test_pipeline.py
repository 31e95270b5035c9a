"""The pipeline stage by stage against the operators that it calls."""

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as c  # noqa: E402
from plumbline.llm import bbpe, langid, mixing, ngram_join, quality  # noqa: E402
from plumbline.llm.common import stored, table  # noqa: E402


def ids(df):
    return sorted((r[0] is not None, r[0] or 0) for r in df.select("doc_id").collect())


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = docs.columns
    out = [docs]
    for name, stage in c.STAGES:
        out.append(stored(stage(spark, out[-1], sf_dir), "test"))
        if name != c.STAGES[-1][0]:
            assert out[-1].columns == names, name
    judged = quality.judge(out[0], table(spark, sf_dir, "labels"))
    assert ids(out[1]) == ids(judged.filter("kept")) and out[1].count() < out[0].count()
    model = langid.learn(out[1].filter(~langid.held_out(out[1].doc_id)))
    assert ids(out[2]) == ids(langid.predict(out[1], model).filter(f"lang_pred <> 'und' and score >= {c.LEAST_SCORE}"))
    found = ngram_join.Join(out[2]).run()
    assert ids(out[3]) == ids(found.filter("doc_id = component_id"))
    took = {r.doc_id: r.taken // r.size for r in mixing.mix(out[3]).collect() if r.taken}
    assert out[4].count() == sum(took.values())
    assert out[5].count() == out[4].count()
    t = bbpe.tokenizer(*[c.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), c.public_tokenizers.PATTERN])
    text = {r.doc_id: r.text for r in out[4].collect()}
    assert all(t.decode(r.ids).decode() == text[r.doc_id] and r.n_tokens == len(r.ids) for r in out[5].collect())
    assert c.run(spark, sf_dir).count() == out[5].count()


@pytest.mark.parametrize("name", [n for n, _ in c.STAGES])
def test_stage_on_odd_rows(spark, sf_dir, name):
    """Nulls, empty texts, repeated rows and clashing columns; and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, taken string, size string, score string"
    long = " ".join(f"word{k}" for k in range(40)) + "."
    rows = [(0, None, None, None, None, *"abcde"), (1, "", "en", "a", 0, *"abcde"), (2, long, "en", "a", 1, *"abcde"), (2, long, "en", "a", 1, *"abcde"), (None, long, None, "b", 1, *"abcde"), (3, long.upper(), "de", None, 1, *"abcde")]
    docs, stage = spark.createDataFrame(rows, schema), dict(c.STAGES)[name]
    out = stage(spark, docs, sf_dir)
    got = out.collect()
    if name != c.STAGES[-1][0]:
        assert out.columns == docs.columns and all(tuple(r) in rows for r in got)
    assert stage(spark, docs.filter("false"), sf_dir).count() == 0


def test_language_stage_rejects_mixed_texts(spark, sf_dir):
    """Texts of equal parts of four languages go, clean ones of each language stay."""
    docs = table(spark, sf_dir, "documents")
    by = {}
    for r in docs.filter("n_chars > 600").orderBy("doc_id").collect():
        by.setdefault(r.lang, []).append(r)
    mixed = [(100_000 + k, "\n".join(x[k].text[:500] for x in by.values()), None, "a", 2000) for k in range(5)]
    both = docs.unionByName(spark.createDataFrame(mixed, docs.schema))
    kept = {r.doc_id for r in c.language_id(spark, both, sf_dir).collect()}
    clean = {x.doc_id for rows in by.values() for x in rows}
    assert not kept & {m[0] for m in mixed} and len(clean - kept) <= len(clean) // 50
