import random

import numpy as np

import corpus_pipeline
from lathe.llm import bpe
from tests.llm.test_neardup import plain_groups, plain_simhash
from tests.llm.test_rules_secrets import base_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choices(["ta", "re", "on", "li", "mu", "vo", "sen"], k=rnd.randrange(1, 4)))
    rows, labels = [], []
    for i in range(420):
        lines = [" ".join(word() for _ in range(rnd.randrange(8, 20))) + "." for _ in range(rnd.randrange(3, 7))]
        toxic, bad = i % 7 == 0, i % 5 == 0
        if toxic:
            lines = [x.replace(" ", " blorg ", 1) for x in lines]
        if bad:
            lines = [x.upper().replace(" ", "!! ") for x in lines]
        if i % 11 == 3:
            lines[-1] += " token=abcdefghijklmnop"
        text = "\n".join(lines)
        rows.append((len(rows), text))
        labels.append((len(rows) - 1, int(not bad), int(toxic)))
        if i % 13 == 0:
            rows.append((len(rows), text.replace("\n", " \n")))
    return [(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows] + [(5000, None, None, None, None)], labels


def test_stages_against_plain_python(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    truth = {i: (q, t) for i, q, t in labels}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == COLUMNS
        docs.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept.append({r.doc_id: r for r in docs.collect()})
    before = {r[0] for r in rows}
    assert {i for i in before & truth.keys() if not truth[i][1]} == kept[0].keys() & truth.keys()
    assert {i for i in kept[0].keys() & truth.keys() if truth[i][0]} == kept[1].keys() & truth.keys()
    fps = {i: plain_simhash(r.text or "") for i, r in kept[1].items()}
    groups = plain_groups(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert kept[2].keys() == set(groups.values()) and len(kept[2]) < len(kept[1])
    assert kept[3].keys() == kept[2].keys()
    for i, r in kept[3].items():
        assert not base_spans(r.text or "") and r.n_chars == (None if r.text is None else len(r.text))
        if not base_spans(kept[2][i].text or ""):
            assert r.text == kept[2][i].text
    assert any("[SECRET]" in (r.text or "") for r in kept[3].values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    own = bpe.Encoder(bpe.default_tokenizer())
    sizes = {i: len(own.encode(r.text or "")) // 4 + 1 for i, r in kept[3].items()}
    assert {i: sum(r.length for r in packed if r.doc_id == i) for i in sizes} == sizes
    used = {}
    for r in packed:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [at for at, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_run_gives_the_rows_of_the_stages(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows[:120], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns) and out.count() > 40


def test_stages_on_empty_and_null_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, label_ int, fp string, norm string"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in ([], [(None,) * 8, (1, None, None, None, None, 1, "a", None), (2, "", "en", "s", 0, None, None, "b"), (2, "", "en", "s", 0, None, None, "b"), (3, "x " * 40_000, None, "s", 80_000, 0, None, None)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            assert out.count() <= len(rows)
            if "near-dedup" in name and rows:
                assert sorted(r.doc_id for r in out.collect()) == [1, 3]
            if "secret" in name:
                assert out.count() == len(rows)
        assert corpus_pipeline.pack(spark, docs, str(tmp_path)).count() >= len(rows)


def test_texts_come_to_workers_in_small_batches(spark, tmp_path):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from lathe.llm.common import BATCH_BYTES

    @F.arrow_udf("long")
    def in_batch(texts: pa.Array) -> pa.Array:
        return pa.array([texts.nbytes] * len(texts), pa.int64())

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = [(i, f"{i} " + "a few words " * 800, "en", "s", 9_600) for i in range(1500)]  # 14 MB, once a batch
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    spark.createDataFrame([(0, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in (corpus_pipeline.STAGES[0], corpus_pipeline.STAGES[1]):
        spark.conf.unset(name)
        stage(spark, docs, str(tmp_path))
        assert docs.select(in_batch("text").alias("n")).agg(F.max("n")).first()[0] <= 1.5 * BATCH_BYTES
    spark.conf.set(name, "1000b")
    corpus_pipeline.small_batches(spark)
    assert spark.conf.get(name) == "1000b"
    spark.conf.unset(name)


def test_packing_plans_need_no_workers_of_another_kind(spark, monkeypatch):
    from lathe.llm import packing

    docs = spark.createDataFrame([(i, "word " * i) for i in range(40)], "doc_id long, text string")
    monkeypatch.setattr(spark.sparkContext, "parallelize", lambda *a, **k: 1 / 0)
    assert packing.packed_documents(docs).count() == 40
