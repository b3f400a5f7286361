"""The whole pipeline on a small fixture, against a plain version of its stages."""
import random
import re

import pytest

P = pytest.importorskip("public_tokenizers")


def test_pipeline_matches_a_plain_version(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline
    from tests.llm.test_text_operators import plain_components, plain_contamination

    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(["lana", "mola", "tani", "reno", "sola", "vema"]) + rng.choice(["", "ri", "sto", "ka"]) for _ in range(n))
    items = [(i, text(14)) for i in range(3)]
    rows = [(i, text(rng.randint(20, 60))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, rows[7][1] + " lana"), (300, f"{text(9)} {items[1][1]} {text(9)}")]
    rows += [(400, f"{text(20)} password: hunter2xyz {text(5)}"), (500, None), (501, "12 34")]
    spark.createDataFrame([(i, t, "aa", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}

    known = [(i, t) for i, t in rows if t and re.search("[a-z]", t)]
    root = plain_components(known, 5, 80)
    first = [(i, t) for i, t in known if root[i][1] == i]
    clean = {x[0] for x in plain_contamination(first, items) if not x[2]}
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = {i: model.encode(re.sub(r"password: \S+", "[secret]", t)) for i, t in first if i in clean}
    assert got == want and 400 in got and 300 not in got and 100 not in got and [n for n, _ in corpus_pipeline.STAGES][0] == "language_id"


def test_pipeline_takes_odd_rows_and_names(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice(["lana", "mola", "tani", "reno", "sola", "vema"]) + rng.choice(["", "ri", "sto", "ka"]) for _ in range(n))
    one, two, long = text(40), text(40), text(9000)
    rows = [(i, text(rng.randint(20, 60)), "aa") for i in range(60)]
    rows += [(70, one, "aa"), (70, one, "aa"), (None, two, None), (None, two, "aa"), (None, f"{two} lana", None), (71, long, "aa"), (72, None, None), (73, "", "aa"), (74, " \n", None), (75, "!", None)]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, kept_ string, own_0 long, key_ int, `_spans` string, ids string, row_ long, gone_ string"
    data = [(i, t, g, "s", 1, "x", 2, 3, "y", "z", 4, "w") for i, t, g in rows]
    spark.createDataFrame(data, ddl).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(1, "nothing that anyone says")], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    got = [r["doc_id"] for r in corpus_pipeline.run(spark, f"file://{tmp_path}/a").collect()]
    assert sorted(map(str, got)) == sorted([*map(str, range(60)), "70", "None", "71"])
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, f"file://{tmp_path}/a").columns == docs.columns, name
    spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/b").collect() == []
