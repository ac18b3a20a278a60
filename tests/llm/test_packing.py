import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quarry.llm.packing import hilbert_keys, pack, powers_of_two

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_hilbert_curve_steps_to_neighbours():
    points = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = hilbert_keys(points, 3)
    assert sorted(keys) == list(range(512))
    along = points[np.argsort(keys)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_powers():
    assert powers_of_two(1300) == [1024, 256, 16, 4]


def test_pack_round_trip(spark):
    texts = {1: "Hello world " * 900, 2: None, 3: "", 4: "É x\x1cy don't <|endoftext|> Σίσυφος ΣΑΣ ź é", 5: "a", 6: "word " * 5000, 7: "a", None: "n"}
    docs = spark.createDataFrame([(k, v, "s", 3) for k, v in texts.items()], "doc_id long, text string, ids string, n_tokens int")
    docs = docs.union(docs.where("doc_id = 5"))
    model = Tokenizer.from_file(PATH)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in pack(docs, PATH).collect():
        assert len(r.ids) == 4 * r.length
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, text in texts.items():
        want = model.encode(text or "", add_special_tokens=False).ids + [1]
        got = sorted(pieces[doc], key=lambda r: r.start)
        if doc == 5:  # repeated row
            got = got[::2]
        assert b"".join(r.ids for r in got) == np.array(want, "<u4").tobytes()
        assert all(r.doc_tokens == len(want) for r in got)
        assert zlib.crc32(b"".join(r.ids for r in got)) == zlib.crc32(np.array(want, "<u4").tobytes())
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0


def test_word_tokenizer_is_exact():
    import random

    from quarry.llm.packing import WordTokenizer

    rng = random.Random(5)
    alphabet = "abcXYZ'tsrevmld09 \n\t\r.,!*-_<|>ßéÉñÑİŒſ²½ªº×÷\u017f"
    wild = alphabet + "\x1c\x85\xa0Σς中文e\u0301\u0130𝒳١\u2003"
    texts = ["".join(rng.choice(alphabet if i % 2 else wild) for _ in range(rng.randrange(60))) for i in range(4000)]
    texts += ["<|endoftext|>", "a<|startoftext|>b", "", " ", "don't DON'T we'll'd"]
    ours, model = WordTokenizer(PATH), Tokenizer.from_file(PATH)
    got = ours.encode(texts)
    for t, g in zip(texts, got, strict=True):
        assert g == np.array(model.encode(t, add_special_tokens=False).ids, "<u2").tobytes(), repr(t)


def test_pack_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack(docs, PATH).count() == 0
