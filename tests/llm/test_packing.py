import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from newsloom.llm import packing, queries
from tokenizers import Tokenizer

S = packing.Settings()
SMALL = packing.Settings(window=64, shard_ids=2_000)


def whole(texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [t.encode(x, add_special_tokens=False).ids + [1] for x in texts]


def test_chunked_encoding_equals_whole_texts():
    texts = ["", " ", "Hello  World's\n it'll <|endoftext|> don't", "x<|startoftext|>Y <|ENDOFTEXT|> <| a|>", "Éá ÎΣ ΑΣ Σ x y \x85z \x1cq", "a\tb\x0bc\x0cd", "the&&& th%%% 12 3½ 日本語 text", "İstanbul ǅ ﬁ ́ ̈u", "x" * 5000, "a\x01b c \x01 d", "\x01", "straße, año 2nd (ça) e\u0301t", None]
    encoder = packing.ChunkEncoder(packing.default_tokenizer(), packing.Settings(cache_pieces=20))
    assert encoder.simple
    for part in (texts, texts[3:], ["a a b b", "Éá a"], texts, texts):  # the cache overflows in between
        column = pa.array(["before", *part]).slice(1)
        ids, sizes = encoder.encode(column)
        assert [[*x, 1] for x in np.split(ids.tolist(), np.cumsum(sizes)[:-1])] == whole([t or "" for t in part])


def test_the_registered_query_agrees_with_the_default_tokenizer(spark, tmp_path):
    rows = [(1, "Rain <|endoftext|> fell."), (2, None), (3, "word " * 3000), (4, "Rain <|endoftext|> fell.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op7_packing(spark, str(tmp_path))
    assert dict(out.dtypes) == {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    want = dict(zip([i for i, _ in rows], whole([t or "" for _, t in rows])))
    assert 49407 in want[1]
    got = out.collect()
    for p in got:
        ids = np.array(want[p.doc_id][p.start : p.start + p.length], "<u4")
        assert (p.ids_crc32, p.doc_tokens, p.length) == (zlib.crc32(ids.tobytes()), len(want[p.doc_id]), len(ids))
    assert sum(p.length for p in got) == sum(map(len, want.values()))


def test_equal_scores_are_taken_in_order():
    docs = [np.array([5, 6, 1], np.uint32) for _ in range(6)]
    assert packing.pack_shard(docs, packing.Settings(window=9)) == [(0, 0, 3, 0, 0), (1, 0, 3, 0, 3), (2, 0, 3, 0, 6), (3, 0, 3, 1, 0), (4, 0, 3, 1, 3), (5, 0, 3, 1, 6)]


def check(rows, pieces, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    want = dict(zip([d for d, _ in rows], whole([t or "" for _, t in rows])))
    assert set(by_doc) == set(want)
    for d, own in by_doc.items():
        own.sort(key=lambda p: p.start)
        assert np.concatenate([np.frombuffer(bytes(p.ids), "<u4") for p in own]).tolist() == want[d]
        assert [p.start for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
        assert all(p.doc_tokens == len(want[d]) and p.length == len(p.ids) // 4 for p in own)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
        assert sum(p.length for p in own) <= window
    total = sum(map(len, want.values()))
    return 1 - total / (len(by_sequence) * window)


def test_every_id_in_one_piece_and_little_padding(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "news market rain goal vote".split() for b in "er ing ed ist".split()]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 90)))) for i in range(300)] + [(300, None), (301, ""), (302, "long " * 3000)]
    docs = spark.createDataFrame([(d, t, "e") for d, t in rows], "doc_id long, text string, ids string")
    assert check(rows, packing.pack(docs, settings=SMALL).collect(), 64) < 0.05


def test_neighbours_share_a_sequence(spark):
    topics = ["copper mine ore shaft", "tennis serve racket court", "flute violin concert opera"]
    docs = [np.array(x, np.uint32) for x in whole([" ".join([t] * 3) for _ in range(4) for t in topics])]
    pieces = packing.pack_shard(docs, packing.Settings(window=4 * max(map(len, docs)), least_cut=64))
    together = defaultdict(set)
    for d, _, _, sequence, _ in pieces:
        together[sequence].add(d % 3)
    assert all(len(t) == 1 for t in list(together.values())[:2])


def test_shards_hold_related_documents_at_two_sizes(spark):
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "ba ce di fo gu ha je ki lo mu na pe ri so tu".split() for b in "ban cel dim for gut hal jen kip lom mus".split()]
    for topics in (8, 32):
        texts = [(t, " ".join(rng.choice(vocabulary[4 * t : 4 * t + 4]) for _ in range(20))) for t in range(topics) for _ in range(40)]
        docs = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(texts)], "doc_id long, text string")
        s = packing.Settings(window=512, shard_ids=2_500)
        mates = defaultdict(list)
        for p in packing.pack(docs, settings=s).collect():
            mates[p.sequence_id].append(texts[p.doc_id][0])
        pairs = [(a, b) for own in mates.values() for i, a in enumerate(own) for b in own[i + 1 :]]
        assert sum(a == b for a, b in pairs) / len(pairs) > 0.8


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty).collect() == []
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (4, "c")], "doc_id long, text string")
    got = packing.pack(docs).collect()
    assert sorted((p.doc_id or -1, p.length) for p in got) == [(-1, 3), (-1, 3), (4, 2)]
