"""Stems, weights of parts, and nearness of terms."""

import random
from itertools import product

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestra.functions.stems import russian_stem, russian_stems
from attestra.operators import retrieval
from attestra.plans import fixtures

# Words and stems from the published sample of the algorithm.
STEMS = """в в|вавиловка вавиловк|вагнера вагнер|вагона вагон|вагоне вагон|вагонов вагон|вагоном вагон|вагоны вагон|важная важн|важнее важн|важнейшие важн|важнейшими важн|важничал важнича|важно важн|важного важн
важности важност|важность важност|важною важн|важную важн|важны важн|важным важн|важных важн|вазах ваз|вазы ваз|вакханка вакханк|валандался валанда|валериановых валерианов|валерию валер|валетами валет|павел павел|павильонам павильон
павла павл|павлиний павлин|павлиньи павлин|павлиньим павлин|павловна павловн|падает пада|падаешь пада|падал пада|падала пада|падаль падал|падать пада|падаю пада|падают пада|падение паден|падением паден|падении паден|падения паден
паденье паден|паденья паден|падеж падеж|пакость пакост|палатах палат"""


def test_stems_of_the_published_sample(spark):
    pairs = [tuple(x.split()) for line in STEMS.split("\n") for x in line.split("|")]
    pairs += [("running", "running"), ("", ""), ("ёлками", "елк"), ("стр", "стр"), ("прочитавшись", "прочита"), ("mixedслово", "mixedслов")]
    got = spark.createDataFrame(pairs, "w string, want string").select("w", "want", russian_stem(F.col("w")).alias("got")).collect()
    assert [(r.w, r.got) for r in got if r.got != r.want] == []


def test_inflected_questions_find_their_chunks(spark):
    texts = [(1, "Ёмкости вагонов и павильонов"), (2, "важнейшие пункты"), (3, "nothing of it"), (4, "вагонетка")]
    chunks = spark.createDataFrame(texts, "chunk_id int, text string").select("chunk_id", F.split("text", " ").alias("words"))
    asked = retrieval.bounded_terms(spark.createDataFrame([(1, "вагоном важная")], "query_id int, text string"), F.split("text", " "))
    assert asked.first().terms == ["вагон", "вагоном", "важн", "важная"]
    terms = retrieval.search_weights(chunks, F.array(), F.col("words"), asked.select(F.explode("terms").alias("term")))
    assert [(r.chunk_id, r.score) for r in retrieval.lexical_topk(asked, terms).orderBy("rank").collect()] == [(1, 1.4), (2, 1.4)]
    parts = retrieval.weighted_terms(chunks, retrieval.search_parts(F.array(F.lit("вагон")), F.col("words")))
    by_parts = parts.join(asked.select(F.explode("terms").alias("term")), "term", "left_semi").groupBy("chunk_id").agg(F.round(F.sum(F.col("weight") * F.col("n")), 9).alias("s")).collect()
    summed = retrieval.search_weights(chunks, F.array(F.lit("вагон")), F.col("words"), asked.select(F.explode("terms").alias("term"))).groupBy("chunk_id").agg(F.round(F.sum("weight"), 9).alias("s")).collect()
    assert sorted(by_parts) == sorted(summed) and {r.chunk_id: r.s for r in summed}[3] == 2.4


def density(hits, terms):
    """By all windows: hits (pos, weight, term)."""
    starts, ends = [h[0] for h in hits], [h[0] for h in hits]
    whole = [(p, q) for p, q in product(starts, ends) if {h[2] for h in hits if p <= h[0] <= q} >= set(range(terms))]
    least = {(p, q) for p, q in whole if not any(p <= a and b <= q and (a, b) != (p, q) for a, b in whole)}
    total = 0.0
    for p, q in least:
        inside = [h for h in hits if p <= h[0] <= q]
        total += len(inside) / sum(1 / h[1] for h in inside) / (1 + (q - p) - (len(inside) - 1))
    return round(total, 9)


def test_cover_density_against_all_windows(spark):
    rng, rows = random.Random(3), []
    for c in range(60):
        for pos in sorted(rng.sample(range(40), rng.randint(2, 9))):
            rows.append((c, rng.choice(["a", "b", "c"]), pos, rng.choice([0.1, 0.4, 1.0])))
    queries = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b", "c"]), (3, ["c"]), (4, ["a", "none"]), (5, [])], "query_id int, terms array<string>")
    got = {(r.query_id, r.chunk_id): r.score for r in retrieval.cover_topk(queries, spark.createDataFrame(rows, "chunk_id int, term string, pos int, weight double"), 100).collect()}
    want = {}
    for q, terms in ((1, "ab"), (2, "abc"), (3, "c")):
        for c in range(60):
            hits = [(p, w, terms.index(t)) for k, t, p, w in rows if k == c and t in terms]
            if {h[2] for h in hits} == set(range(len(terms))):
                want[q, c] = density(hits, len(terms))
    assert got == want and len(want) > 60


def test_nearness_outranks_more_matches(spark):
    rows = [(1, "a", 0, 1.0), (1, "b", 1, 1.0), (2, "a", 0, 1.0), (2, "a", 30, 1.0), (2, "b", 60, 1.0), (2, "b", 90, 1.0)]
    near = retrieval.cover_topk(spark.createDataFrame([(1, ["a", "b"])], "query_id int, terms array<string>"), spark.createDataFrame(rows, "chunk_id int, term string, pos int, weight double"))
    assert [r.chunk_id for r in near.orderBy("rank").collect()] == [1, 2]
    counted = spark.createDataFrame([(c, t, w, 1) for c, t, _, w in rows], "chunk_id int, term string, weight double, n long")
    assert [r.chunk_id for r in retrieval.lexical_topk(spark.createDataFrame([(1, ["a", "b"])], "query_id int, terms array<string>"), counted).orderBy("rank").collect()] == [2, 1]


def test_stems_in_a_task_are_those_of_the_column(spark):
    rng = random.Random(5)
    words = [x.split()[0] for line in STEMS.split("\n") for x in line.split("|")] + ["", "running", "ёлками", "стр", "mixedслово", "новейшее", "длинный", "радость"]
    words += ["".join(rng.choices("абвеиоостьнйщшмлюяxё", k=rng.randint(1, 9))) for _ in range(3000)]
    want = [r.s for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(russian_stem(F.col("w")).alias("s")).collect()]
    assert russian_stems(pa.array(words)).to_pylist() == want
    assert russian_stems(pa.array(["a", None])).to_pylist() == ["a", None]


@pytest.mark.parametrize("few, hits", [(200_000, 4_000_000), (40, 500)])
def test_search_within_rows_gives_what_joined_terms_give(spark, monkeypatch, few, hits):
    rng = random.Random(7)
    vocabulary = ["Вагон", "вагоном", "павлин", "павлиний", "the", "The", "of", *(f"w{i}" for i in range(30))]
    pick = lambda n: [vocabulary[min(int(rng.expovariate(0.2)), len(vocabulary) - 1)] for _ in range(n)]
    rows = [(i // 2 if i < 40 else i, pick(rng.randint(0, 2)), pick(rng.randint(0, 12))) for i in range(400)]  # some ids come twice
    chunks = spark.createDataFrame(rows, "chunk_id long, head array<string>, words array<string>").repartition(5)
    asked = retrieval.bounded_terms(spark.createDataFrame([(q, pick(6)) for q in range(30)] + [(99, [])], "query_id long, w array<string>"), F.col("w"))
    terms = retrieval.search_weights(chunks, F.col("head"), F.col("words"), asked.select(F.explode("terms").alias("term")))
    want = sorted(retrieval.lexical_topk(asked, terms, 7).select("query_id", "chunk_id", "score", "rank").collect())
    monkeypatch.setattr(retrieval, "FEW_TERMS", few)
    monkeypatch.setattr(retrieval, "HITS", hits)
    got = retrieval.search_topk(asked, chunks, F.col("head"), F.col("words"), 7)
    assert sorted(got.select("query_id", "chunk_id", "score", "rank").collect()) == want and len(want) > 200


def test_long_texts_are_cut_after_every_forty_words(spark, tmp_path):
    words = [f"w{i}" for i in range(30_011)]
    texts = [(1, " \n\t" + "  ".join(words) + " "), (2, "one"), (3, " \n"), (4, ""), (5, None), (6, "x" * 200_000 + " y")]
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = fixtures.chunks(spark, str(tmp_path))
    got = {r.chunk_id: r.words for r in plan.collect()}
    assert got == {1000 + i // 40: words[i : i + 40] for i in range(0, len(words), 40)} | {2000: ["one"], 6000: ["x" * 200_000, "y"]}
    assert "slice(" not in plan._jdf.queryExecution().optimizedPlan().toString()  # which goes through a whole text for each chunk


def test_nearest_vectors_in_blocks_against_all_pairs(spark, monkeypatch):
    rng = random.Random(11)
    vectors = [[rng.choice([-1.0, 0.5, 2.0]) for _ in range(3)] for _ in range(300)]  # many equal directions
    none = [(900, [0.0, 0.0, 0.0]), (901, None), (902, [1.0, None, 1.0]), (903, [float("nan"), 1.0, 1.0])]
    chunks = spark.createDataFrame([*enumerate(vectors), *none], "chunk_id long, embedding array<float>")
    monkeypatch.setattr(retrieval, "BLOCK", 4)
    monkeypatch.setattr(retrieval, "PACK", 16)
    monkeypatch.setattr(retrieval, "CLOSE", 10)
    queries = chunks.where("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    got = sorted((r.query_id, r["rank"], r.chunk_id, r.distance) for r in retrieval.dense_topk(queries, chunks, 9).collect())
    size = lambda v: sum(x * x for x in v) ** 0.5
    want = []
    for q in range(0, 300, 10):
        near = sorted((round(1 - sum(x * y for x, y in zip(vectors[q], v)) / (size(vectors[q]) * size(v)), 9) + 0.0, c) for c, v in enumerate(vectors))
        want += [(q, i + 1, c, d) for i, (d, c) in enumerate(near[:9])]
    assert [x[:3] for x in got] == [x[:3] for x in want] and all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, want, strict=True))


def test_terms_of_a_chunk_are_counted_in_its_row(spark):
    rows = [(1, ["a", "B", "b"], ["a"]), (2, [], ["a", None, None]), (3, None, ["x"]), (3, ["x"], ["x", "X"]), (4, None, None)]  # 3 comes twice
    chunks = spark.createDataFrame(rows, "chunk_id int, h array<string>, t array<string>").repartition(3)
    parts = {"A": F.col("h"), "C": F.col("t"), 0.2: F.col("h")}
    got = retrieval.weighted_terms(chunks, parts)
    want = {(1, "a", 1.0, 1), (1, "b", 1.0, 2), (1, "a", 0.2, 2), (1, "b", 0.2, 2), (2, "a", 0.2, 1), (2, None, 0.2, 2), (3, "x", 1.0, 1), (3, "x", 0.2, 4)}
    assert set(map(tuple, got.collect())) == want and got.count() == len(want)
    asked = spark.createDataFrame([("b",), ("x",)], "term string")
    assert set(map(tuple, retrieval.weighted_terms(chunks, parts, asked).collect())) == {w for w in want if w[1] in ("b", "x")}
    once = retrieval.weighted_terms(chunks.where("chunk_id < 3"), parts)
    assert "Aggregate" not in once._jdf.queryExecution().optimizedPlan().toString()  # rows of words met in a shuffle


def test_places_of_words_that_no_query_has_are_not_dealt(spark):
    rows = spark.createDataFrame([(c, f"w{i}", i, 1.0) for c in range(50) for i in range(20)], "chunk_id int, term string, pos int, weight double")
    near = retrieval.cover_topk(spark.createDataFrame([(1, ["w3", "w4"]), (2, ["w3", "none"])], "query_id int, terms array<string>"), rows, 100)
    assert sorted((r.query_id, r.chunk_id, r.score) for r in near.collect()) == [(1, c, 1.0) for c in range(50)]
    assert "LeftSemi" in near._jdf.queryExecution().optimizedPlan().toString()  # before, all places met in a shuffle
