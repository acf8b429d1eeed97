import random
import struct
import zlib

import pytest
from tokenizers import Tokenizer

from sievemill.llm import token_files
from sievemill.llm.tokens import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start string"


def test_round_trip(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(10**6), " ".join(rng.choice(["the", "Ünder", "漢字", "x9", "\n"]) for _ in range(rng.choice([1, 5, 300]))), "c") for _ in range(400)]
    rows += [(10**7, None, ""), (10**7 + 1, "", ""), (6, "a <|endoftext|> b", ""), (5, "twice", ""), (5, "twice", ""), (5, "other", ""), (10**8, "w " * 30_000, ""), (None, "no id", "")]
    folder = token_files.new_folder(spark)
    manifest = token_files.write(spark.createDataFrame(rows, SCHEMA).repartition(4), folder, PATH)
    got = token_files.read(manifest, folder, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids))
    assert sorted(map(str, want)) == sorted(str((r[0], r[2], r[3], r[4])) for r in got)
    got.sort(key=lambda r: r["start"])
    at, last = 0, -1
    for r in got:
        assert r["start"] == at and (r["doc_id"] or 0) >= last
        at, last = at + r["n_tokens"], r["doc_id"] or 0
    first = manifest.orderBy("shard").first()
    shard = token_files.Shard(folder, first["file"])
    token_files.READ, before = 300, token_files.READ
    assert [x.tolist() for _, ids in shard.every() for x in ids] == [shard.ids(k).tolist() for k in range(len(shard.doc_ids))]
    token_files.READ = before
    k = len(shard.doc_ids) - 1
    assert shard.ids(k).tolist() == got[k]["ids"] and shard.doc_ids[k] == got[k]["doc_id"]


def test_ids_that_do_not_fit(spark):
    docs = spark.createDataFrame([(1, "a", "")], SCHEMA)
    for width, end_id in ((2, 70_000), (3, 0), (2, -1)):
        with pytest.raises(ValueError):
            token_files.write(docs, token_files.new_folder(spark), PATH, end_id=end_id, width=width)


def test_few_rows_and_none(spark):
    for rows in ([], [(1, "a", "")], [(None, None, None)]):
        folder = token_files.new_folder(spark)
        manifest = token_files.write(spark.createDataFrame(rows, SCHEMA), folder, PATH, width=4)
        assert token_files.read(manifest, folder).count() == len(rows)
