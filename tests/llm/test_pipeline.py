import random
from collections import Counter

import corpus_pipeline
from attestra.llm import mixing, pieces
from tests.llm.test_setjoin import brute
from fractions import Fraction


def test_every_stage_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "w" + str(rng.randint(0, 400))
    texts = [[word() for _ in range(rng.randint(8, 60))] for _ in range(150)]
    for k in range(150, 210):  # copies, exact or near
        ws = list(texts[k - 150])
        if k % 2:
            ws[-1] = word()
        texts.append(ws)
    toxic = set(rng.sample(range(210), 40))
    rows = [(i, " ".join([*ws[:4], "idiot", "scum", *ws[4:]] if i in toxic else ws), "en", f"src{i % 3}", 1) for i, ws in enumerate(texts)] + [(900, None, "en", "src0", 0), (901, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 210, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    at, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:3]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
        kept.append([tuple(r) for r in at.collect()])
    clean, single, mixed = kept
    assert {r[0] for r in clean} == {r[0] for r in rows if r[0] not in toxic}
    groups = brute([(r[0], r[1]) for r in clean], 5, Fraction(4, 5))
    assert sorted(r[0] for r in single) == sorted({c for _, _, c in groups})
    want = {(r.doc_id, r.source): r.copies for r in mixing.mix(spark.createDataFrame(single, docs.schema)).collect() if r.copies}
    assert Counter((r[0], r[3]) for r in mixed) == Counter(want)
    last = corpus_pipeline.STAGES[3][1](spark, spark.createDataFrame(mixed, docs.schema), str(tmp_path)).collect()
    coder = pieces.Encoder(pieces.default_model(), 0.1, 1)
    text = {r[0]: r[1] for r in rows}
    assert len(last) == len(mixed) and all(coder.decode(__import__("numpy").array(r.ids)) == text[r.doc_id] for r in last)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in whole) == sorted(r.doc_id for r in last)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
