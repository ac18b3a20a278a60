import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters():
    plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    out, free = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            out[chr(free)] = b
            free += 1
    return out


def plain(texts):
    """The contract, token by token."""
    a_model, b_model, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_letters()
    a_model.encode_special_tokens = True

    def b_bytes(i):
        piece = b_model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    found = []
    for text in texts:
        a = [(i, bytes(letters[c] for c in a_model.id_to_token(i))) for i in a_model.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, b_bytes(i)) for i in b_model.encode(text or "")]
        want = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            found.append(([], [], [], []))
            continue
        spans = []
        for tokens in (a, b):
            at, out = 0, []
            for i, x in tokens:
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, before = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(x[2]) for x in side if before <= x[0] < e) for side in spans))
            before = e
        found.append((a, b, links, groups))
    counts = Counter(p for _, _, links, _ in found for p in set(links))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return [(len(a), len(b), len(g), len(ln), sum(counts[p] == best[p[0]] for p in ln), sum(counts[p] for p in ln), ";".join(g)) for a, b, ln, g in found]


def hostile_texts():
    rng = random.Random(11)
    letters = "abcXYZ 'tsrevm09 \n\t.,!*-_<|>éÑ中文́\U0001d4b3▁ "
    texts = ["".join(rng.choice(letters[:-2] if i % 3 else letters) for _ in range(rng.randrange(1, 50))) for i in range(150)]
    words = ["alignment", "of", "tokenizers", "don't", "Straße", "naïve", "x=1;", "the", "http://a.b/c"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(50)]
    return [*texts, None, "", " ", "   a   b  ", "<|endoftext|> x <s> </s> <0x41>", "a", "a", "▁", "a b " * 3000]


def test_against_plain_version(spark):
    texts = hostile_texts()
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, a_ids int, pair string").repartition(5)
    out = ta.align(docs, A, B).collect()
    assert [tuple(r)[1:] for r in sorted(out, key=lambda r: r.doc_id)] == plain(texts)


def test_pieces_and_stretches_make_no_difference(monkeypatch):
    texts = [t for t in hostile_texts() if t] + ["ends \n", "\n\n x\u3000y \u2003\x1cz\x85 \xa0a ", "\u2581 lost", "kept"]
    pair = ta.Pair(A, B)
    whole = pair.encode([t.encode() for t in texts])
    words = [np.array(pair.b.encode(" " + t), pair.dtype).tobytes() for t in texts]
    assert [w[1] for w in whole] == [w if ids[0] else b"" for w, ids in zip(words, whole, strict=True)]
    assert sum(not w[0] for w in whole) == sum("\u2581" in t for t in texts)
    monkeypatch.setattr(ta, "PIECE", 5)
    monkeypatch.setattr(ta, "CACHED_WORDS", 50)
    assert pair.encode([t.encode() for t in texts]) == whole
    a_ids, b_ids = (np.frombuffer(b"".join(w[k] for w in whole), pair.dtype) for k in (0, 1))
    bounds = np.cumsum([len(w[0]) // 2 for w in whole])
    for most in (1, 7, 1000):
        keys, docs, seen = [], [], 0
        for s in ta.stretches(a_ids, b_ids, pair.a_size, pair.b_size, most):
            assert s.marks[-1] == 3 and s.a_from == seen
            seen += len(s.a_ids)
            links = ta.links_of(s, bounds)
            keys.append(links.keys)
            docs.append(links.docs)
        assert seen == len(a_ids)
        once = ta.links_of(next(ta.stretches(a_ids, b_ids, pair.a_size, pair.b_size)), bounds)
        assert np.array_equal(np.concatenate(keys), once.keys) and np.array_equal(np.concatenate(docs), once.docs)


def test_ids_out_of_merge_order_take_the_slow_encoder(tmp_path):
    import json

    with open(A, encoding="utf-8") as f:
        file = json.load(f)
    vocab = file["model"]["vocab"]
    vocab["he"], vocab["in"] = vocab["in"], vocab["he"]
    (tmp_path / "other.json").write_text(json.dumps(file))
    tokens, other = ta.ByteTokens(A), ta.ByteTokens(str(tmp_path / "other.json"))
    swapped = {vocab["he"]: vocab["in"], vocab["in"]: vocab["he"]}
    text = " he is in<|endoftext|> hein"
    assert [swapped.get(i, i) for i in other.encode(text)] == list(tokens.encode(text))


def test_shards_without_a_file_system_to_map(spark, monkeypatch):
    partials = spark.createDataFrame([(k % 50 << 32 | k % 7, 1) for k in range(1000)], "pair long, count long").repartition(6)
    shards, best = ta.count_shards(spark, partials)
    keys, counts = np.unique([k % 50 << 32 | k % 7 for k in range(1000)], return_counts=True)
    assert np.array_equal(ta.looked_up(keys, shards), counts)
    monkeypatch.setattr(ta, "_mapped", lambda path: None)
    assert np.array_equal(ta.looked_up(keys[3::5], shards), counts[3::5])
    assert best == {a: max(n for k, n in zip(keys.tolist(), counts.tolist(), strict=True) if k >> 32 == a) for a in range(50)}


def test_hostile_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    docs = docs.unionAll(spark.range(1).selectExpr("7L", "cast(unhex('61FF') as string)"))
    out = {(r.doc_id, r.n_a, r.count_sum) for r in ta.align(docs, A, B).collect()}
    assert out == {(None, 2, 6), (1, 2, 6), (2, 0, 0), (7, 0, 0)}
    assert ta.align(docs.where("false"), A, B).count() == 0
    assert ta.align(docs.where("doc_id = 2"), A, B).where(F.col("groups") == "").count() == 1
