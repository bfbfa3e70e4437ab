import hashlib
import re

import corpus_pipeline
from urlintel.llm import pii


def test_pipeline(spark, tmp_path):
    prose = lambda k, n=60: " ".join(f"{a}{hashlib.md5(f'{k}{i}'.encode()).hexdigest()[:3].translate(str.maketrans('0123456789', 'ghijklmnop'))}" for i, a in zip(range(n), ["the", "of", "and", "with", "in"] * n))
    item = prose("item", 30)
    texts = [prose("a"), prose("a"), prose("a") + " new", prose("b") + " " + " ".join(item.split()[5:17]) + " end", "12 34 56", None, "", prose("c") + " mail x.y@z.example.com or 10.1.2.3 ok", prose("d"), prose("e")]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)] + [(8, texts[8], "en", "s0", len(texts[8]))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(out) == [0, 7, 8, 9]
    assert out[8]["text"] == texts[8] and "[EMAIL]" in out[7]["text"] and "[IP]" in out[7]["text"]
    assert all(r["decodes"] and len(r["ids"]) == 4 * r["n_tokens"] > 0 and r["n_chars"] == len(r["text"]) for r in out.values())
    assert not any(pii.base_spans(r["text"]) for r in out.values()) and not re.search("@", out[7]["text"])


def test_missing_and_shared_ids(spark, tmp_path):
    prose = lambda k, n=60: " ".join(f"{a}{hashlib.md5(f'{k}{i}'.encode()).hexdigest()[:3].translate(str.maketrans('0123456789', 'ghijklmnop'))}" for i, a in zip(range(n), ["the", "of", "and", "with", "in"] * n))
    texts = [(None, prose("a")), (5, prose("a")), (7, prose("b")), (7, prose("c")), (None, prose("d")), (None, prose("d")), (None, None), (9, prose("e")), (3, prose("e") + " more")]
    rows = [(i, t, "en", f"s{n % 2}", len(t or ""), "x") for n, (i, t) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)
    assert out == sorted([(5, prose("a")), (7, prose("b")), (7, prose("c")), (None, prose("d")), (3, prose("e") + " more")], key=str)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
