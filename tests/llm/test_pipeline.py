import collections
import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.tables import docs, prose


def test_stages_one_after_the_other(spark, tmp_path):
    toxic = [(i, prose(i, 30) + " nastyword grubby " + prose(900 + i, 5)) for i in range(60)]
    clean = [(1000 + i, prose(2000 + i, 40)) for i in range(150)]
    copies = [(3000, clean[0][1]), (3001, clean[0][1]), (3002, None), (3003, "")]
    near = [(4000, clean[1][1].replace(clean[1][1].split()[20], "changed", 1))]
    rows = [(i, t, f"s{i % 3}") for i, t in toxic + clean + copies + near]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, 1) for i, _ in toxic] + [(i, 0) for i, _ in clean]
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = table.columns
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        table = stage(spark, table, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert table.columns == columns, name
        table.write.parquet(f"{tmp_path}/{k}.parquet")
        table = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        seen.append(collections.Counter(r.doc_id for r in table.collect()))
    assert not set(seen[0]) & {i for i, _ in toxic} and {i for i, _ in clean} <= set(seen[0])
    assert set(seen[0]) - set(seen[1]) == {1000, 3000, 3002} and max(seen[1].values()) == 1
    assert set(seen[1]) - set(seen[2]) == {4000}
    assert set(seen[3]) <= set(seen[2]) and max(seen[3].values()) <= 3
    assert seen[4] == seen[3]

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {i: t or "" for i, t, _ in rows}
    for r in table.collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert collections.Counter(r.doc_id for r in run.collect()) == seen[4]


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(1, "", "s"), (1, "", "s")]])
def test_stages_on_next_to_nothing(spark, tmp_path, rows):
    table = docs(spark, rows)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, str(tmp_path))
        assert table.count() <= len(rows)


def test_long_texts_and_many_repeated_rows(spark, tmp_path):
    """Rows with one doc_id, most of them alike, and a very long text among others; nothing but copies goes."""
    long = prose(77, 60_000)
    same = prose(5, 30)
    rows = [(i, prose(i, 40), f"s{i % 2}") for i in range(80)]
    rows += [(500, same, "s0")] * 200 + [(501, same, "s0")] * 100 + [(None, prose(6, 30), "s1")] * 50 + [(502, prose(100 + i, 25), "s1") for i in range(20)]
    rows += [(600, long, "s0"), (601, long, "s0"), (602, long + " more words at its end", "s1"), (700, None, None), (701, " \n", None)]
    table = docs(spark, rows)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        table = stage(spark, table, str(tmp_path))
        table.write.parquet(f"{tmp_path}/{name}.parquet")
        table = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        assert set(table.columns) == set(docs(spark, []).columns)
        seen.append(collections.Counter(r.doc_id for r in table.collect()))
    assert sum(seen[0].values()) == len(rows)
    assert seen[1] == collections.Counter([*range(80), 501, None, *[502] * 20, 601, 602, 700, 701])
    assert seen[1] - seen[2] == collections.Counter([602]) and seen[2] <= seen[1]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(r.doc_id for r in out) == seen[3]
    assert {r.decoded_sha256 for r in out if r.doc_id == 601} <= {hashlib.sha256(long.encode()).hexdigest()}
