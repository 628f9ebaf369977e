import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

from .conftest import DOCS, prose

ITEM = "Which of these rivers flows through the old market town, past seven stone bridges, before it meets the winter harbour?"


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    clean = [(i, prose(150, i), "en", f"s{i % 4}", 1) for i in range(80)]
    copies = [(200 + i, clean[i][1] + (" also" if i % 2 else ""), "en", "s1", 1) for i in range(10)]
    leaks = [(300 + i, prose(80, 400 + i) + " " + ITEM + " " + prose(80, 500 + i), "en", "s2", 1) for i in range(3)]
    junk = [(400, "%%% *** " * 200, "en", "s3", 1), (401, "too short", "en", "s3", 1), (402, None, "en", None, None)]
    docs = spark.createDataFrame([(*r, "x", 7, "f", "n", 1) for r in clean + copies + leaks + junk], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids, frame = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        ids[name] = {r.doc_id for r in frame.select("doc_id").collect()}
    good = {r[0] for r in clean}
    assert ids["quality_rules"] == good | {r[0] for r in copies + leaks}
    assert ids["near_copies"] == good | {r[0] for r in leaks}
    assert ids["decontaminate"] == good
    assert ids["mix_sources"] <= good and len(ids["mix_sources"]) > 40
    mixed = frame.orderBy("doc_id").collect()
    words = sum(len(r.text.split()) for r in mixed)
    assert abs(words - sum(len(r[1].split()) for r in clean)) < 200
    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    whole, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for r, want in zip(got, mixed, strict=True):
        tokens = np.array(whole.encode(want.text, add_special_tokens=False).ids + [1], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (want.doc_id, start, len(tokens), zlib.crc32(tokens.tobytes()))
        start += len(tokens)


def test_stage_names_are_distinct():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == len(set(names)) == 5
