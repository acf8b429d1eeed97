import random
import struct
import zlib
from collections import defaultdict

from tokenizers import Tokenizer

from sievemill.llm.packing import pack, plan
from sievemill.llm.tokens import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, piece string"


def check(rows, got, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k, lo in enumerate(range(0, len(ids), capacity)):
            part = ids[lo : lo + capacity]
            want.append((i, k, lo, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_pieces_and_places(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "ünder", "Straße", "x9", "don't"]) for _ in range(rng.choice([1, 5, 30, 300, 2500]))), "c") for i in range(300)]
    rows += [(900, None, ""), (901, "", ""), (None, "no id", ""), (904, "a <|endoftext|> b", ""), (902, "twice", ""), (902, "twice", ""), (903, "w" * 20_000, "")]
    for capacity in (2048, 64):
        got = pack(spark.createDataFrame(rows, SCHEMA).repartition(4), PATH, capacity).collect()
        used = check(rows, got, capacity)
        sizes = [r["length"] for r in got]
        # none can do with fewer than either: all tokens, or pieces over half a sequence
        least = max(-(-sum(sizes) // capacity), sum(2 * n > capacity for n in sizes))
        assert used <= 1.05 * least + 1, (used, least)
    with_ids = pack(spark.createDataFrame(rows, SCHEMA), PATH, with_ids=True).collect()
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in with_ids)
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_plans_cover_every_piece_once():
    rng = random.Random(1)
    for _ in range(40):
        capacity = rng.choice([1, 7, 64, 2048])
        counts = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(0, 60))}
        rows = plan(dict(counts), capacity, groups=rng.choice([1, 5, 40])).tolist()
        use, seen = defaultdict(int), defaultdict(list)
        for n, (length, rank, first, offset) in enumerate(rows):
            end = rows[n + 1][1] if n + 1 < len(rows) and rows[n + 1][0] == length else counts[length]
            for q in range(first, first + end - rank):
                use[q] += length
                seen[q].append((offset, length))
        assert sum(use.values()) == sum(k * n for k, n in counts.items()) and max(use.values(), default=0) <= capacity
        for parts in seen.values():
            parts.sort()
            assert all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0
