"""The five stages of the corpus pipeline over one small corpus with planted cases, against what each must leave."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from texlake.llm import bpe
from texlake.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, body string, node long"


def prose(seed, n):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 9))) for _ in range(300)]
    return " ".join(r.choice(pool) for _ in range(n))


PASSAGE = prose(900, 52)  # less than 400 bytes
ITEM = prose(901, 30)
COPY = prose(902, 120)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    toxic = [k for k in range(200) if k % 5 == 0]
    texts = {k: prose(k, 40) + (" you idiot and scum" if k in toxic else "") for k in range(200)}
    texts |= {200: COPY, 201: COPY, 202: " ".join([*COPY.split()[:60], "changed", *COPY.split()[61:]])}
    texts |= {203: f"{prose(910, 50)} {PASSAGE} {prose(911, 30)}", 204: f"{prose(912, 20)} {PASSAGE} {prose(913, 70)}"}
    texts |= {205: f"{prose(914, 40)} {ITEM} {prose(915, 40)}", 206: None, 207: "", 208: prose(916, 5000), 209: "one two", 210: prose(917, 50) + " what an idiot, such scum"}
    rows = [(k, t) for k, t in texts.items()] + [(208, texts[208]), (None, prose(918, 30)), (None, COPY)]
    base = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(k, t, "en", "s", len(t or ""), "k", "b", 1) for k, t in rows], SCHEMA).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(k, int(k in toxic)) for k in range(200)] + [(3, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base, texts, toxic


def test_stages(spark, corpus):
    base, texts, toxic = corpus
    docs = spark.read.parquet(f"{base}/documents.parquet")
    columns, left = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, base), name)
        assert docs.columns == columns
        left.append(sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr))
    ids = [[k for k, _ in rows] for rows in left]
    # toxicity: the toxic go, all others stay, repeated rows and null ids as well
    gone = set(toxic) | {210}
    assert sorted(ids[0], key=repr) == sorted([k for k in texts if k not in gone] + [208, None, None], key=repr)
    # near duplicates: one of each group, the least id; rows that repeat are one; null texts stay
    assert sorted(ids[1], key=repr) == sorted([k for k in texts if k not in gone | {201, 202}] + [None], key=repr)
    # repeated passages: the shared words go from both texts, nothing else changes
    cut = dict(left[2])
    assert ids[2] == ids[1] and all(PASSAGE not in (cut[k] or "") for k in (203, 204))
    assert cut[203] == texts[203].replace(PASSAGE, "") and cut[204] == texts[204].replace(PASSAGE, "")
    assert all(cut[k] == texts[k] for k in ids[2] if k is not None and k not in (203, 204))
    assert all(r["n_chars"] == len(cut[r["doc_id"]]) for r in docs.where("doc_id IN (203, 204)").collect())
    # decontamination
    assert sorted(ids[3], key=repr) == sorted([k for k in ids[2] if k != 205], key=repr)


def test_run(spark, corpus):
    base, texts, toxic = corpus
    got = corpus_pipeline.run(spark, base).toPandas()
    kept = [k for k in texts if k not in set(toxic) | {210, 201, 202, 205}]
    assert sorted(got.doc_id.dropna().unique()) == kept and got.doc_id.isna().sum() == 1
    tok = bpe.PieceEncoder(vocabulary("byte_bpe_50k.json")).tokenizer
    for k in kept:
        text = (texts[k] or "").replace(PASSAGE, "") if k in (203, 204) else texts[k] or ""
        ids = tok.encode(text, add_special_tokens=False).ids + [2]
        mine = got[got.doc_id == k].sort_values("piece")
        assert mine.length.sum() == len(ids)
        assert all(x.ids_crc32 == zlib.crc32(np.array(ids[x.start : x.start + x.length], "<u4").tobytes()) for x in mine.itertuples())
    laid = got.sort_values(["sequence_id", "offset"])
    assert (laid.groupby("sequence_id").length.cumsum() - laid.length == laid.offset).all() and laid.groupby("sequence_id").length.sum().max() <= 1024


def test_empty_tables(spark, corpus, tmp_path):
    base, _, _ = corpus
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{base}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    # without labels or items the stages that need them keep all
    some = spark.read.parquet(f"{base}/documents.parquet").where(F.col("doc_id") < 20)
    assert corpus_pipeline.toxicity(spark, some, str(tmp_path)).count() == 20
    assert corpus_pipeline.decontamination(spark, some, str(tmp_path)).count() == 20


def test_last_stage_remembers_fewer_pieces_and_packs_the_same(spark):
    import corpus_pipeline
    from texlake.llm import bpe, packing
    from texlake.llm.queries import vocabulary

    path = vocabulary("byte_bpe_50k.json")
    small = bpe.encoder(path, 4)
    texts = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(6)]
    ids = [small.encode(t).tolist() for t in texts]
    assert ids == [bpe.encoder(path).encode(t).tolist() for t in texts] and small is not bpe.encoder(path)
    assert corpus_pipeline.KNOWN < bpe.MOST
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    packed = [sorted(map(tuple, packing.pack_documents(docs, path, known=n).select("doc_id", "piece", "start", "length", "ids_crc32").collect())) for n in (4, bpe.MOST)]
    assert packed[0] == packed[1]
