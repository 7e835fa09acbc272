"""The pipeline's stages after the first, whose scores are learned, in plain Python on the small table."""

from __future__ import annotations

import plain
from tokenizers import Tokenizer

from tributary.llm import secrets
from tributary.llm.shared import public_vocabulary


def without_passages(rows, window: int = 13) -> dict:
    """doc -> text without the words of windows that a smaller id has; documents that lose all words are left out."""
    split = {doc: plain.words(text) for doc, text in rows}
    least: dict = {}
    for doc, w in split.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, doc), doc)
    out = {}
    for doc, text in rows:
        w = split[doc]
        gone = {k + j for k in range(len(w) - window + 1) if least[tuple(w[k : k + window])] < doc for j in range(window)}
        rest = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else text
        if rest:
            out[doc] = rest
    return out


def masked(text: str, spans) -> str:
    out, at = "", 0
    for s, _, e in sorted(spans):
        if s >= at:
            out += text[at:s] + "[secret]"
        at = max(at, e)
    return out + text[at:]


def test_pipeline_in_plain_python(spark, sf_dir, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    small = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = small.where("size(split(text, ' ')) > 60").orderBy("doc_id").limit(2)
    own = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(150)), lambda k: F.concat(F.lit("own"), F.col("doc_id"), F.lit("x"), k)), " ")
    planted = long.withColumn("text", F.concat_ws(" ", "text", own, F.lit("password = hunter2hunter2 end"))).withColumn("doc_id", F.col("doc_id") + 100_000)
    small.unionByName(planted).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    sf_dir = str(tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_toxic(spark, docs, sf_dir).collect()]
    near = plain.near_copies(clean, size=5)
    once = without_passages([(doc, text) for doc, text in clean if near[doc][2]])
    # Spans beside the base patterns depend on all texts; they are taken from the operator.
    scanned = secrets.scan(spark.createDataFrame(list(once.items()), "doc_id long, text string")).collect()
    more = {r["doc_id"]: [(x["s"], x["k"], x["e"]) for x in r["spans"] if x["k"] == 3] for r in scanned}
    hidden = [(doc, masked(text, plain.base_spans(text) + more[doc])) for doc, text in once.items()]
    assert any("[secret]" in text for _, text in hidden) and any(text != dict(clean)[doc] for doc, text in once.items())
    want = plain.pieces(hidden, Tokenizer.from_file(public_vocabulary("byte_bpe_50k.json")))
    found = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert found == want


def test_pipeline_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(7, 0), (4, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, docs in (("odd", odd), ("none", none)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        rows = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, f"{tmp_path}/{name}")
            assert rows.columns == docs.columns
        packed = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        # Copies and passages go; null and empty texts stay.
        assert {r["doc_id"] for r in packed} >= ({1, 2, 3, 4, 5, 7} if name == "odd" else set()) and 8 not in {r["doc_id"] for r in packed}
